"""Comparing results whatever the order of their rows."""


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if v != v else v
    return v


def rows(df, *columns):
    """Rows of a DataFrame as sorted plain lists."""
    columns = columns or sorted(df.columns)
    return sorted([[plain(r[c]) for c in columns] for r in df.collect()], key=repr)


def same(spark_df, duck):
    """Whether a Spark result and a DuckDB relation hold the same rows under the same names."""
    names = sorted(spark_df.columns)
    assert names == sorted(duck.columns)
    at = [duck.columns.index(n) for n in names]
    want = sorted([[plain(r[i]) for i in at] for r in duck.fetchall()], key=repr)
    return rows(spark_df, *names) == want
