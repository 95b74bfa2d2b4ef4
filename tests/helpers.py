"""What several test modules share."""

DATA = "/root/testdata/sf0.001"


def rows(df, *order):
    """The rows as tuples, sorted by the given columns or by all."""
    got = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(got, key=lambda r: tuple((x is not None, x) for x in r))
