SF = "/root/testdata/sf0.001"


def same(got, want):
    """Two pandas frames hold the same rows, in any order."""
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)
