"""The queries of this subpackage, ``pN_...`` for problem N, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import read_payload
from ..session import spread, table
from .cuts import judge_cuts
from .forms import find_variants, fold_texts
from .leaks import find_leaks
from .mixing import actual_shares, mix_sources
from .pieces import split_oversized
from .privacy import find_entities, replace_entities
from .scans import find_faults, repair_pages
from .sentences import sentence_texts, split_sentences
from .survivors import survivors


def _adapted_texts(spark: SparkSession, d: str, *states: str) -> DataFrame:
    """``row_id``, ``adapter``, ``adapted_text`` of the payloads in one of ``states`` that hold a text."""
    rows = spread(table(spark, d, "adapted", "row_id", "adapter", "payload")).withColumn("p", read_payload("payload"))
    return rows.filter(F.col("p.state").isin(*states) & F.col("p.adapted_text").isNotNull()).select("row_id", "adapter", F.col("p.adapted_text").alias("adapted_text"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pieces of every over-long chunk text and adapted text."""
    chunks = table(spark, d, "chunks", "row_id", "text").select(F.lit("chunk_text").alias("field_name"), "row_id", "text")
    adapted = _adapted_texts(spark, d, "object").select(F.lit("adapted_text").alias("field_name"), "row_id", F.col("adapted_text").alias("text"))
    limits = table(spark, d, "size_limits")
    return split_oversized(chunks.unionByName(adapted).join(limits, "field_name"), ["field_name", "row_id"], "text", "max_chars", "overlap_chars")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).filter("piece_no = 1").select("field_name", "row_id").distinct()


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    """The visible text of every chapter in one consistent form."""
    return fold_texts(spread(table(spark, d, "chapters_raw", "row_id", "html")), "row_id", "html", markup=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return find_variants(spread(table(spark, d, "chapters_raw", "row_id", "html")), "row_id", "html", markup=True)


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The ordered sentences of every readable payload."""
    return sentence_texts(_adapted_texts(spark, d, "object", "wrapped"), "row_id", "adapted_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(_adapted_texts(spark, d, "object"), "row_id", "adapted_text")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "adapted", "row_id", "book_id", "chapter_index", "adapter", "payload")).withColumn("p", read_payload("payload"))
    rows = rows.select("row_id", "book_id", "chapter_index", "adapter", F.col("p.state").alias("state"), F.col("p.adapted_text").alias("adapted_text"))
    return judge_cuts(rows, "row_id", "adapter", "adapted_text", "state", ["book_id", "chapter_index"])


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """For each adapter, whatever its spelling, its rows and the share of them that are cut off."""
    return _judged(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if("cut").alias("cut_rows"), F.avg(F.col("cut").cast("double")).alias("cut_share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).filter("cut").select("row_id").distinct()


def p7_passages(spark: SparkSession, d: str, least: float = 0.5) -> DataFrame:
    """Documents with the items they leak and the share of each item's words."""
    docs = spread(table(spark, d, "documents", "doc_id", "text"))
    return find_leaks(docs, "doc_id", "text", table(spark, d, "eval_items", "item_id", "text"), "item_id", "text", least)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_passages(spark, d).select("doc_id", "item_id").distinct()


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "books", "book_id", F.col("title").alias("book_title"))
    return spread(table(spark, d, "chapters_raw", "row_id", "book_id", "title", "html")).join(books, "book_id", "left")


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every scanned chapter as continuous clean paragraphs."""
    return repair_pages(_chapters(spark, d), "row_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return find_faults(_chapters(spark, d), "row_id").select("row_id", "line_no", "kind", "fixed").distinct()


def _survivors(spark: SparkSession, d: str, missing: str) -> DataFrame:
    lexicon = table(spark, d, "lexicon", "book_id", "term", "spoken_as", "reason", "hint_id", "origin", "recorded_at")
    return survivors(lexicon, "book_id", "term", "hint_id", ["spoken_as", "reason"], "origin", "recorded_at", table(spark, d, "origin_trust"), missing)


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One row for each term of each book; rows without a timestamp take the place learned for their value."""
    return _survivors(spark, d, "learned").select("book_id", "term", "spoken_as", "reason", "rows", F.col("first_hint_id").cast("long"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _survivors(spark, d, "earliest").filter("rows >= 2")
    return rows.select("first_hint_id", F.col("spoken_as_hint_id").alias("spoken_hint_id"), F.col("reason_hint_id").alias("reason_hint_id"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their repeats."""
    docs = spread(table(spark, d, "documents", "doc_id", "source", "text"))
    return mix_sources(docs, "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The actual share of each source of the mixture."""
    return actual_shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of as many tokens as there are: the exponent is bisected to the largest that the repetition limits allow."""
    docs = spread(table(spark, d, "documents", "doc_id", "source", "text"))
    return mix_sources(docs, "doc_id", "text", "source", table(spark, d, "mix_targets"), total="there")


def p8_tempered_shares(spark: SparkSession, d: str) -> DataFrame:
    return actual_shares(p8_tempered(spark, d), table(spark, d, "mix_targets"))


#: The key of the registered queries; a real run has its own.
PII_KEY = "key of the registered queries"


def p9_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed, keyed placeholders in place of personal information."""
    return replace_entities(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text", PII_KEY)


def p9_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Every document with made-up values of the same kind and format instead."""
    return replace_entities(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text", PII_KEY, style="surrogate")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_entities(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text").select("doc_id", "kind", "found").distinct()


#: Outer white space for RE2, whose own class is ASCII only.
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

ORACLE = {
    "p1_found": rf"""
        WITH texts AS (
            SELECT 'chunk_text' AS field_name, row_id, text FROM chunks
            UNION ALL
            SELECT 'adapted_text', row_id, CASE WHEN json_type(payload, '$.adapted_text') = 'VARCHAR' THEN json_extract_string(payload, '$.adapted_text') END
            FROM (SELECT row_id, payload FROM adapted WHERE json_valid(payload)) WHERE json_type(payload) = 'OBJECT'
        )
        SELECT DISTINCT field_name, row_id FROM texts JOIN size_limits USING (field_name)
        WHERE length(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) > max_chars
    """,
}


def queries() -> dict:
    return {k: v for k, v in sorted(globals().items()) if k[0] == "p" and k[1].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
