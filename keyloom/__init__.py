"""A PySpark-native analytics engine for multi-model keyed collections."""
