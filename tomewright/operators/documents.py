"""Extracted documents: guards, warnings, repair of broken words, sections, front matter, chapter numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.batches import filled


def scan_guard(pages: DataFrame, doc: str, text: str, encrypted: str | None = None, least_total: int = 100, least_mean: float = 50.0) -> DataFrame:
    """``doc``, ``pages``, ``chars``, ``error_kind``: ``encrypted``, ``scanned`` or null, one row for each document.

    A null page counts as empty; a document is scanned if it has too few characters in all or by the page.
    """
    size = F.length(X.strip(F.coalesce(F.col(text), F.lit(""))))
    locked = F.coalesce(F.bool_or(encrypted), F.lit(False)) if encrypted else F.lit(False)
    got = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.sum(size).alias("chars"), locked.alias("locked"))
    kind = F.when(F.col("locked"), "encrypted").when((F.col("chars") < least_total) | (F.col("chars") / F.col("pages") < least_mean), "scanned")
    return got.select(doc, "pages", "chars", kind.alias("error_kind"))


def quality_warnings(pages: DataFrame, doc: str, text: str, long_doc: int = 20, low: float = 0.3, most: float = 0.4) -> DataFrame:
    """``doc``, ``pages``, ``median_chars``, ``low_pages``, ``no_headings``, ``uneven``; the median is exact."""
    size = F.length(X.strip(F.coalesce(F.col(text), F.lit(""))))
    rows = pages.select(doc, size.alias("n"), F.coalesce(F.col(text).rlike(r"(?m)^#{1,6} +\S"), F.lit(False)).alias("head"))
    stats = rows.groupBy(doc).agg(F.median("n").alias("median_chars"), F.count(F.lit(1)).alias("pages"), F.bool_or("head").alias("head"))
    lows = rows.join(stats.select(doc, "median_chars"), doc).groupBy(doc).agg(F.count_if(F.col("n") < low * F.col("median_chars")).alias("low_pages"))
    both = stats.join(lows, doc)
    uneven = (F.col("pages") >= 4) & (F.col("median_chars") > 0) & (F.col("low_pages") / F.col("pages") > most)
    return both.select(doc, "pages", "median_chars", "low_pages", ((F.col("pages") > long_doc) & ~F.col("head")).alias("no_headings"), uneven.alias("uneven"))


#: Fixed value: a word broken at a line's end.
_BROKEN = r"([A-Za-z]+)-\n([A-Za-z]+)"


def _mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, known in zip(pdf["text"], pdf["known"]):
            words = set(known) if known is not None else set()
            out.append(re.sub(_BROKEN, lambda m: m[1] + m[2] if (m[1] + m[2]).lower() in words else f"{m[1]}-{m[2]}", text) if isinstance(text, str) else None)
        yield pd.DataFrame({"key": pdf["key"], "text": out})


def vocabulary(df: DataFrame, text: str, least: int = 2) -> DataFrame:
    """``word``: lower-case ASCII words that stand in at least ``least`` rows."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z\-])[A-Za-z]{2,}(?![A-Za-z\-])"), F.lit(0)), F.lower))
    return df.select(F.explode(words).alias("word")).groupBy("word").count().filter(F.col("count") >= least).select("word")


def dehyphenate(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """``key``, ``text``: words broken at a line's end joined if ``words`` has the joined form; else only the break goes.

    Only the joined forms that stand in the documents are looked up, by a join, so the dictionary may be of any size.
    """
    pairs = F.transform(F.regexp_extract_all(text, F.lit(_BROKEN), F.lit(0)), lambda x: F.lower(F.replace(x, F.lit("-\n"), F.lit(""))))
    base = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    asked = df.select(F.col(key).alias("key"), F.explode(F.array_distinct(pairs)).alias("word"))
    known = asked.join(words.select("word").distinct(), "word", "left_semi").groupBy("key").agg(F.collect_set("word").alias("known"))
    schema = T.StructType([base.schema["key"], T.StructField("text", T.StringType())])
    return base.join(known, "key", "left").mapInPandas(filled(_mend), schema).withColumnsRenamed({"key": key, "text": text})


def outline_sections(outline: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """``doc``, ``section_ix``, ``title``, ``page_ix`` (from 1): the pages of each top-level outline entry.

    ``outline`` has ``doc``, ``ix``, ``level``, ``title``, ``start_page``; ``pages`` has ``doc``, ``page_count``. Documents
    with fewer than two such entries give nothing; an entry without pages gives nothing; pages before the first are lost.
    """
    top = outline.filter((F.col("level") == 1) & (F.col("start_page") >= 1)).join(pages.select(doc, "page_count"), doc)
    w = Window.partitionBy(doc).orderBy("ix")
    many = F.count(F.lit(1)).over(Window.partitionBy(doc))
    spans = top.withColumn("until", F.coalesce(F.lead("start_page").over(w), F.col("page_count") + 1)).withColumn("many", many)
    spans = spans.withColumn("section_ix", F.row_number().over(w) - 1).filter((F.col("many") >= 2) & (F.col("start_page") < F.col("until")))
    return spans.select(doc, "section_ix", "title", F.explode(F.sequence(F.col("start_page"), F.col("until") - 1)).alias("page_ix"))


#: Headings of the first and second level.
_LEVELS = (r"(?m)^# +\S", r"(?m)^## +\S")


def heading_level(text: Column, forced: Column | None = None) -> Column:
    """The heading level to split at: the one forced, else 1 or 2 if the text has such headings, else null."""
    found = F.when(text.rlike(_LEVELS[0]), 1).when(text.rlike(_LEVELS[1]), 2)
    return found if forced is None else F.coalesce(forced, found)


def section_array(text: Column, level: Column, fallback_title: Column) -> Column:
    """The sections of a text: array of ``title``, ``body`` in order; see :func:`split_sections`."""

    def made(lines: Column) -> Column:
        size = F.size(lines)
        is_head = lambda x: level.isNotNull() & (F.length(F.regexp_extract(x, r"^(#+) +\S", 1)) == level)
        heads = F.filter(F.sequence(F.lit(1), size), lambda i: F.coalesce(is_head(F.element_at(lines, i)), F.lit(False)))
        # text before the first heading begins behind a heading at 0
        starts = X.let(heads, lambda hs: F.concat(F.array(F.lit(0)), hs, F.array(size + 1)))

        def one(starts: Column) -> Column:
            def section(at: Column, k: Column) -> Column:
                last = F.element_at(starts, k + 2)
                title = X.strip(F.regexp_replace(F.regexp_replace(F.try_element_at(lines, F.greatest(at, F.lit(1))), r"^#+ +", ""), r"\s*#+\s*$", ""))
                first = F.when(level.isNull(), fallback_title).otherwise(F.lit("Front Matter"))
                return F.struct(F.when(at == 0, first).otherwise(title).alias("title"), X.strip(F.array_join(F.slice(lines, at + 1, last - at - 1), "\n")).alias("body"))

            return F.filter(F.transform(F.slice(starts, 1, F.size(starts) - 1), section), lambda s: s["body"] != "")

        return X.let(starts, one)

    return X.let(F.split(text, "\n"), made)


def split_sections(df: DataFrame, doc: str, text: str, level: str, fallback_title: str) -> DataFrame:
    """``doc``, ``section_ix``, ``title``, ``body``: the sections of every document, those without a body left out.

    ``level`` names a column; where it is null the document is one section titled by the column ``fallback_title``.
    Text before the first heading is titled ``Front Matter``. A document is cut inside its row: there is no shuffle. A
    null text has no section.
    """
    sections = section_array(F.col(text), F.col(level), F.col(fallback_title))
    return df.select(doc, F.posexplode(sections).alias("section_ix", "s")).select(doc, "section_ix", "s.title", "s.body")


#: Titles of front and back matter.
SKIPPED_TITLES = r"(?i)copyright|acknowledg|dedication|^index$|bibliograph"


def likely_skip(title: Column, text: Column) -> Column:
    return F.coalesce(title.rlike(SKIPPED_TITLES), F.lit(False)) | (F.coalesce(X.word_count(text), F.lit(0)) < 10)


def number_chapters(sections: DataFrame, book: str, order: str, title: str, text: str, key: str | None = None) -> DataFrame:
    """The sections that are kept, with ``chapter_index`` from 0 in their order; equal orders are settled by title.

    With ``key``, which names a unique column, only keys, orders and titles are sorted by book and the texts are met
    again by the key; without, the whole rows are sorted.
    """
    w = Window.partitionBy(book).orderBy(order, title)
    kept = sections.filter(~likely_skip(F.col(title), F.col(text)))
    number = (F.row_number().over(w) - 1).alias("chapter_index")
    if key is None:
        return kept.select("*", number)
    return kept.join(kept.select(book, order, title, key).select(F.col(key).alias("_key"), number), F.col(key) == F.col("_key")).drop("_key")


def markdown_sections(docs: DataFrame, pages: DataFrame, outline: DataFrame, doc: str, title: str, text: str, page: str = "page_ix", footnotes: str = "inline", forced: int | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chapters, refused) of extracted documents, from the guard to the numbered chapter.

    ``docs`` has ``doc``, ``title`` and its whole Markdown ``text``; ``pages`` has ``doc``, ``page`` (from 1) and ``text``;
    ``outline`` is that of :func:`outline_sections`. A document that the guard refuses is in ``refused`` (``doc``,
    ``error_kind``), or with ``strict`` an error. A document with an outline is cut by its pages, any other by its
    headings, at the ``forced`` level if given. Chapters have ``doc``, ``chapter_index``, ``title``, ``html``,
    ``word_count_estimate``, ``has_code``, ``has_math``, ``has_tables``. A document without text gives none.
    """
    guard = scan_guard(pages, doc, text)
    refused = guard.filter("error_kind IS NOT NULL").select(doc, "error_kind")
    if strict:
        guard = guard.withColumn("error_kind", F.when(F.col("error_kind").isNotNull(), F.raise_error(F.concat_ws(": ", F.col(doc).cast("string"), "error_kind"))))
    fine = guard.filter("error_kind IS NULL").select(doc)
    counts = pages.groupBy(doc).agg(F.max(page).alias("page_count"))
    spans = outline_sections(outline, counts, doc).join(fine, doc, "left_semi")
    # the pages of a section, in order: as many as a chapter has
    parts = spans.withColumnRenamed("page_ix", page).join(pages.select(doc, page, text), [doc, page])
    by_page = parts.groupBy(doc, "section_ix", "title").agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("ps"))
    by_page = by_page.select(doc, "section_ix", F.col("title").alias("_title"), F.array_join(F.transform("ps", lambda p: F.coalesce(p[text], F.lit(""))), "\n\n").alias("_body"))
    rest = docs.join(fine, doc, "left_semi").join(spans.select(doc).distinct(), doc, "left_anti").select(doc, F.col(title).alias("_fb"), X.unify_line_ends(F.col(text)).alias("_t"))
    rest = rest.withColumn("_lv", heading_level(F.col("_t"), F.lit(forced) if forced else None))
    by_head = split_sections(rest, doc, "_t", "_lv", "_fb").select(doc, "section_ix", F.col("title").alias("_title"), F.col("body").alias("_body"))
    sections = by_page.unionByName(by_head).withColumn("_body", X.clean_markdown(F.col("_body"), footnotes))
    chapters = number_chapters(sections, doc, "section_ix", "_title", "_body").withColumn("html", X.markdown_html("_body"))
    features = X.html_features(F.col("html"))
    math = features["has_math"] | X.markdown_math(F.col("_body"))
    return chapters.select(doc, "chapter_index", F.col("_title").alias("title"), "html", X.word_count(F.col("_body")).alias("word_count_estimate"), features["has_code"].alias("has_code"), math.alias("has_math"), features["has_tables"].alias("has_tables")), refused


def text_parts(chapters: DataFrame, book: str, order: str, title: str, text: str) -> DataFrame:
    """``book``, ``order``, ``part``: each chapter under its title, for books too large for one cell; a sink joins them in order."""
    return chapters.select(book, order, F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.col(text)).alias("part"))


def full_text(chapters: DataFrame, book: str, order: str, title: str, text: str) -> DataFrame:
    """``book``, ``full_text``: the chapters of a book in order, each under its title; one cell a book, see :func:`text_parts`."""
    rows = text_parts(chapters, book, order, title, text).groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("part").alias("p")))).alias("ps"))
    return rows.select(book, F.concat(F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n"), F.lit("\n")).alias("full_text"))
