"""What several test modules share."""


def rows(df, *columns):
    """Sorted tuples of the columns."""
    found = [tuple(r[c] for c in columns or df.columns) for r in df.collect()]
    return sorted(found, key=lambda t: [(x is None, str(x)) for x in t])
