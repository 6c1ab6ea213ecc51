"""Shared by the tests: the smallest tables, and comparable rows."""

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> list:
    """Comparable rows of a pandas frame: columns by name, numbers rounded, order ignored."""
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, (bool, int, float)) or hasattr(x, "dtype"):
            return round(float(x), 6) + 0.0
        return str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))
