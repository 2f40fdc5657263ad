"""Comparing a query with its SQL."""


def rows(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple("None" if v is None or v != v else str(v) for v in r) for r in frame[cols].itertuples(index=False))


def compare(spark, duck, sf_dir, query, sql) -> None:
    got, want = query(spark, sf_dir).toPandas(), duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
