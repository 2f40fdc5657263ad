import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import compare  # noqa: E402

from tomewright.plans import core_queries as Q  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, Q.QUERIES[name], Q.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_runs(spark, sf_dir, name):
    n = Q.QUERIES[name](spark, sf_dir).count()
    assert n == 0 if name == "chunk_invariants" else n > 0


def test_cleaners_change_the_decorated_text(spark, sf_dir):
    docs = Q._docs(spark, sf_dir)
    from pyspark.sql import functions as F

    from tomewright.functions import text as X

    for how in (X.unify_line_ends, X.drop_image_marks, X.plain_punctuation, X.collapse_space, X.drop_page_artifacts, X.demote_code_headings, lambda c: X.apply_footnotes(c, "skip")):
        assert docs.filter(how(F.col("t")) != F.col("t")).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_use_the_lexicon_of_the_book(spark, tmp_path):
    import json

    said = lambda text, *hints: json.dumps({"adapted_text": text, "pronunciation_hints": [{"term": t, "spoken_as": s, "reason": ""} for t, s in hints]})
    rows = [("a", 0, said("The nginx and the sql.", ("sql", "sequel")), 1), ("a", 1, said("More nginx, more sql.", ("nginx", "engine x"), ("sql", "squeal")), 2), ("b", 0, said("No nginx here."), 3)]
    spark.createDataFrame(rows, "book_id string, chapter_index int, payload string, row_id long").write.parquet(f"{tmp_path}/adapted.parquet")
    spark.createDataFrame([(*r[:2], "<p>x</p>", r[3]) for r in rows], "book_id string, chapter_index int, html string, row_id long").write.parquet(f"{tmp_path}/chapters_raw.parquet")
    got = {(r.book_id, r.chapter_index): r.text for r in Q.QUERIES["chunks"](spark, str(tmp_path)).collect()}
    assert got == {("a", 0): "The engine x and the sequel.", ("a", 1): "More engine x, more sequel.", ("b", 0): "No nginx here."}
    hints = {(r.book_id, r.chapter_index): [h.term for h in r.hints] for r in Q._texts(spark, str(tmp_path)).collect()}
    assert hints[("a", 0)] == ["sql", "nginx", "sql"]


def test_file_names_come_from_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 90 + "?b\n c.. ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.QUERIES["safe_filename_whole"](spark, str(tmp_path)).collect()[0].name == "a" * 90 + "b c"
