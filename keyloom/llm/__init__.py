"""Training-data operators: each module holds one operator and its query.

Nothing outside this subpackage imports it; ``keyloom.llm.registry`` lists the
queries and their SQL for the driver's entry file.
"""
