"""Problem 1: cutting oversized texts into overlapping pieces at natural boundaries.

One bounded-quantifier pattern does the cutting. Its alternatives stand in order of boundary strength, each consumes at
most ``max_chars - overlap_chars`` code points, and the last ones fall back to characters. A piece is what its match
consumed with ``overlap_chars`` code points before it, taken by offset from the text. Everything stays in the JVM, a row
is cut where it is read, and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outer white space in the sense of Unicode's White_Space property, the non-breaking kinds included.
OUTER_SPACE = r"(?U)\A\s+|\s+\z"

#: (least share of the budget that a piece cut here must fill, what must stand before the cut). Strongest first.
BOUNDARIES = [
    (0.50, r"(?<=\n[ \t]{0,8}\n)"),
    (0.50, r"(?<=[.!?…]['\"’”»)\]]{0,3}\s|[。！？।][」』”’）]{0,2})(?![\s」』”’）])"),
    (0.40, r"(?<=\n)"),
    (0.40, r"(?<=[,;:–—]\s|[，；：、])"),
    (0.0, r"(?<=\s)(?!\s)"),
]


def strip_outer(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_SPACE, "")


def cutting_pattern(budget: Column) -> Column:
    """The pattern for pieces of up to ``budget`` code points, as a column."""
    upto = budget.cast("string")
    alternatives = [F.concat(F.lit("(?:.{1,"), upto, F.lit(r"}\z)"))]
    for share, behind in BOUNDARIES:
        least = F.greatest(F.lit(1), (budget * share).cast("int")).cast("string")
        alternatives.append(F.concat(F.lit("(?:.{"), least, F.lit(","), upto, F.lit("}"), F.lit(behind), F.lit(")")))
    # never between a letter and its mark or joiner, unless nothing else is left
    alternatives.append(F.concat(F.lit("(?:.{1,"), upto, F.lit(r"}(?![\p{M}‍‌])(?<!‍))")))
    alternatives.append(F.concat(F.lit("(?:.{1,"), upto, F.lit("})")))
    return F.concat(F.lit("(?s)"), F.concat_ws("|", *alternatives))


def split_oversized(df: DataFrame, keys: list[str], text: str, max_chars: str, overlap_chars: str) -> DataFrame:
    """Ordered pieces of every text longer than its limit: ``keys``, ``piece_no`` (from 1), ``start``, ``n_chars``, ``piece``.

    ``max_chars`` and ``overlap_chars`` name columns. Outer white space is dropped first and not counted. A text within
    its limit, a null or blank text and a null or non-positive limit give no row; a negative or null overlap counts as 0,
    one that reaches the limit as ``max_chars - 1``. Repeated rows give repeated pieces. Other columns of ``df``, of
    whatever name, are not read. ``start`` counts code points of the stripped text from 0.
    """
    limit, lap = F.col(max_chars).cast("int"), F.coalesce(F.col(overlap_chars).cast("int"), F.lit(0))
    base = df.select(F.struct(*keys).alias("k"), strip_outer(F.col(text)).alias("t"), limit.alias("most"), F.greatest(F.lit(0), F.least(lap, limit - 1)).alias("lap"))
    over = base.filter((F.col("most") > 0) & (F.length("t") > F.col("most")))
    parts = over.withColumn("parts", F.regexp_extract_all("t", cutting_pattern(F.col("most") - F.col("lap")), F.lit(0)))
    ends = F.aggregate(
        "parts",
        F.array(F.lit(0)),
        lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))),
    )
    cut = parts.withColumn("starts", ends).select("k", "t", "lap", F.posexplode("parts").alias("i", "part"), "starts")
    begin = F.col("starts")[F.col("i")]
    lead = F.least(begin, F.col("lap"))
    piece = F.substring(F.col("t"), begin - lead + 1, F.length("part") + lead)
    return cut.select("k.*", (F.col("i") + 1).cast("int").alias("piece_no"), (begin - lead).cast("int").alias("start"), F.length(piece).alias("n_chars"), piece.alias("piece"))
