"""Rows of a DataFrame for comparison."""


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    return sorted((tuple(r) for r in df.select(*(order or df.columns)).collect()), key=key)
