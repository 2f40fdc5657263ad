"""From adapted text to timed chunks: lexicon, paragraphs, beats, sentences, pieces, pauses.

A chapter is worked on inside its row with array functions, so chunking needs no shuffle and no Python; only the text of
one chapter is ever in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..settings import ChunkSettings

BEAT = "[[beat]]"
RULE = "---"


# ---- lexicon


def sanitize_spoken(c: Column) -> Column:
    """A spelling as it can be read aloud: mixed case lowered, dashes and underscores as spaces."""
    lowered = F.when(c.rlike(r"\p{Lu}") & c.rlike(r"\p{Ll}"), F.lower(c)).otherwise(c)
    return X.strip(F.regexp_replace(F.regexp_replace(lowered, "[-_]+", " "), X.SPACE, " "))


def is_redundant(term: Column, spoken: Column) -> Column:
    """Whether a sanitized spelling only spells the term out in single letters."""
    letters = F.lower(F.regexp_replace(term, "[^A-Za-z]", ""))
    return F.coalesce(spoken.rlike(r"^\p{L}(?: \p{L})+$") & (F.lower(F.replace(spoken, F.lit(" "), F.lit(""))) == letters), F.lit(False))


def term_pattern(term: Column) -> Column:
    """A whole-word pattern for a term; terms without capitals match in any case."""
    quoted = F.concat(F.lit(r"\b\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return F.concat(F.when(term != F.lower(term), F.lit("(?U)")).otherwise(F.lit("(?iuU)")), quoted)


def apply_lexicon(text: Column, hints: Column) -> Column:
    """``text`` with the terms of ``hints`` (array of ``term``, ``spoken_as``) replaced, in order; later hints see what earlier ones wrote."""
    ready = F.filter(
        F.transform(hints, lambda h: F.struct(h["term"].alias("term"), sanitize_spoken(h["spoken_as"]).alias("say"))),
        lambda h: h["term"].isNotNull() & h["say"].isNotNull() & ~is_redundant(h["term"], h["say"]),
    )
    literal = lambda s: F.regexp_replace(s, r"([\\$])", r"\\$1")
    return F.aggregate(ready, text, lambda acc, h: F.regexp_replace(acc, term_pattern(h["term"]), literal(h["say"])))


def hints_for(texts: DataFrame, lexicon: DataFrame, keys: list[str], book: str, text: str, order: list[str]) -> DataFrame:
    """``keys``, ``hints``: for each text the hints of its book that can change it, by ``order``; a text without one gives no row.

    ``lexicon`` has ``book``, ``term``, ``spoken_as`` and ``order``; ``book`` is one of ``keys``, which are unique and not null.
    A term can only match where its first word stands, in the text or in what another hint of the book writes, so that a
    long lexicon of a long book is not tried on every chapter. Null texts and terms match nothing.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.upper(c)), F.lit(r"(?U)\w+"), F.lit(0)))
    given = lexicon.filter(F.col("term").isNotNull()).select(book, *order, "term", "spoken_as", F.coalesce(F.try_element_at(words(F.col("term")), F.lit(1)), F.lit("")).alias("_word"))
    written = given.select(book, F.explode(words(sanitize_spoken(F.col("spoken_as")))).alias("_word")).distinct()
    # a hint that another may call for, like one without a word, is tried on every text of the book
    called = given.filter("_word != ''").join(written, [book, "_word"], "left_semi").withColumn("_word", F.lit(""))
    asking = texts.select(*keys, F.explode(F.array_union(F.array(F.lit("")), words(F.col(text)))).alias("_word"))
    hits = asking.join(given.unionByName(called), [book, "_word"]).select(*keys, *order, "term", "spoken_as").distinct()
    placed = F.array_sort(F.collect_list(F.struct(*order, F.struct("term", "spoken_as").alias("hint"))))
    return hits.groupBy(*keys).agg(F.transform(placed, lambda x: x["hint"]).alias("hints"))


# ---- units


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), X.strip), lambda p: p != "")


#: Abbreviations behind which a sentence goes on.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "vs", "etc", "No", "Nr", "Fig", "Abb", "approx", "ca", "bzw", "Inc", "Ltd", "Sr", "Sra", "Dra", "Mme", "e\\.g", "i\\.e", "a\\.m", "p\\.m", "[A-Z]"]

_SENTENCE_END = rf"(?<=[.!?…][\"'”’»)\]]{{0,2}})(?<!\b(?:{'|'.join(ABBREVIATIONS)})\.)\s+(?=[\"'“‘«(\[¿¡]?[\p{{Lu}}\p{{N}}])|(?<=[。！？][」』”）]{{0,2}})(?![」』”）。！？])(?=.)"


def sentences(segment: Column) -> Column:
    """Sentences by rule; the operator for texts of all languages is in the optional subpackage."""
    return F.split(segment, _SENTENCE_END)


def merge_orphans(parts: Column, least: int) -> Column:
    """Parts shorter than ``least`` joined to the next one, the last to the one before; a sole one stays."""
    clean = F.filter(F.transform(parts, X.strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("merged"), F.lit(None).cast("string").alias("pending"))

    def step(acc: Column, s: Column) -> Column:
        whole = F.concat_ws(" ", acc["pending"], s)
        small = F.length(whole) < least
        return F.struct(F.when(small, acc["merged"]).otherwise(F.concat(acc["merged"], F.array(whole))).alias("merged"), F.when(small, whole).alias("pending"))

    def finish(acc: Column) -> Column:
        m, p = acc["merged"], acc["pending"]
        tail = F.concat(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), F.array(F.concat(F.element_at(m, -1), F.lit(" "), p)))
        return F.when(p.isNull(), m).when(F.size(m) > 0, tail).otherwise(F.array(p))

    return F.aggregate(clean, start, step, finish)


def split_long(sentence: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters: clauses packed together, and what has none cut at its last space."""
    start = F.struct(F.array().cast("array<string>").alias("packed"), F.lit(None).cast("string").alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        full = F.length(acc["buf"]) + 1 + F.length(p) > most
        return F.struct(
            F.when(acc["buf"].isNotNull() & full, F.concat(acc["packed"], F.array(acc["buf"]))).otherwise(acc["packed"]).alias("packed"),
            F.when(acc["buf"].isNull() | full, p).otherwise(F.concat(acc["buf"], F.lit(" "), p)).alias("buf"),
        )

    # the rest of a piece if it fits, else up to the last space within the limit, else the limit
    hard = rf"(?sU)\s*(.{{1,{most}}}\z|.{{1,{most - 1}}}(?= )|.{{{most}}})"
    rstrip = lambda x: F.regexp_replace(x, r"(?U)\s+\z", "")

    def cut(s: Column) -> Column:
        packed = F.aggregate(F.split(s, r"(?U)(?<=[,;:])\s+"), start, step, lambda acc: F.concat(acc["packed"], F.array(acc["buf"])))
        pieces = F.flatten(F.transform(packed, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.transform(F.regexp_extract_all(p, F.lit(hard), F.lit(1)), rstrip))))
        return F.filter(pieces, lambda p: p != "")

    return X.let(X.strip(sentence), lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(cut(s)))


def _units(paragraph: Column, cfg: ChunkSettings) -> Column:
    """Units of a paragraph: array of (pieces, whether a beat follows)."""
    none = F.array().cast("array<struct<pieces:array<string>,beat:boolean>>")
    unit = lambda u: F.struct(split_long(u, cfg.max_chars).alias("pieces"), F.lit(False).alias("beat"))

    def blocks(segments: Column) -> Column:
        return F.transform(
            segments,
            lambda s, i: F.struct(F.when(s == "", none).otherwise(F.transform(merge_orphans(sentences(s), cfg.orphan_chars), unit)).alias("units"), (i < F.size(segments) - 1).alias("beat")),
        )

    def marked(both: Column) -> Column:
        last = F.element_at(both, -1)
        return F.concat(F.slice(both, 1, F.greatest(F.size(both) - 1, F.lit(0))), F.array(F.struct(last["pieces"].alias("pieces"), F.lit(True).alias("beat"))))

    def step(acc: Column, b: Column) -> Column:
        return X.let(F.concat(acc, b["units"]), lambda both: F.when(b["beat"] & (F.size(both) > 0), marked(both)).otherwise(both))

    return X.let(F.transform(F.split(paragraph, r"\[\[beat\]\]"), X.strip), lambda segments: F.aggregate(blocks(segments), none, step))


def chunk_array(text: Column, headings: Column, cfg: ChunkSettings, first_is_title: bool = True) -> Column:
    """The chunks of a text: array of ``text``, ``trailing_silence_ms`` in order."""

    def pieces(units: Column, title: Column, is_last: Column) -> Column:
        def one(u: Column, k: Column) -> Column:
            final = k == F.size(units) - 1
            pause = F.greatest(
                F.when(~final, cfg.sentence_ms).when(is_last, 0).otherwise(cfg.paragraph_ms),
                F.when(u["beat"], cfg.beat_ms).otherwise(0),
                F.when(title & final, cfg.title_ms).otherwise(0),
            )
            return F.transform(u["pieces"], lambda piece, j: F.struct(piece.alias("text"), F.when(j < F.size(u["pieces"]) - 1, 0).otherwise(pause).alias("trailing_silence_ms")))

        return F.flatten(F.transform(units, one))

    rule = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(cfg.section_ms).alias("trailing_silence_ms")))

    def rows(paras: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            title = F.coalesce(F.array_contains(headings, p), F.lit(False))
            if first_is_title:
                title = title | (i == 0)
            return F.when(p == RULE, rule).otherwise(X.let(_units(p, cfg), lambda units: pieces(units, title, i == F.size(paras) - 1)))

        return F.flatten(F.transform(paras, one))

    # a rule has no text; it lengthens the pause of the chunk right before it
    def timed(made: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            after = F.try_element_at(made, i + 2)
            rest = F.when(after.isNotNull() & after["text"].isNull(), cfg.section_ms).otherwise(0)
            return F.struct(r["text"].alias("text"), F.greatest(r["trailing_silence_ms"], rest).alias("trailing_silence_ms"))

        return F.filter(F.transform(made, one), lambda r: r["text"].isNotNull())

    return X.let(X.let(paragraphs(text), rows), timed)


def chunk_chapters(chapters: DataFrame, keys: list[str], text: str, hints: str | None = None, headings: str | None = None, cfg: ChunkSettings | None = None, first_is_title: bool = True) -> DataFrame:
    """``keys``, ``chunk_id`` (four digits from 0000), ``text``, ``trailing_silence_ms``.

    ``hints`` names an array of ``term`` and ``spoken_as``, ``headings`` an array of texts. A null or blank text gives no
    chunk. The id has more digits from the ten-thousandth chunk of a chapter on.
    """
    cfg = cfg or ChunkSettings()
    said = apply_lexicon(F.col(text), F.col(hints)) if hints else F.col(text)
    heads = F.col(headings) if headings else F.array().cast("array<string>")
    # the lexicon is applied once, before the text is taken apart
    ready = chapters.filter(F.col(text).isNotNull()).select(*keys, said.alias("_text"), heads.alias("_heads"))
    rows = ready.select(*keys, F.posexplode(chunk_array(F.col("_text"), F.col("_heads"), cfg, first_is_title)).alias("_i", "c"))
    number = F.col("_i").cast("string")
    return rows.select(*keys, F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number).alias("chunk_id"), "c.text", "c.trailing_silence_ms")


def chunk_missing(raw: DataFrame, adapted: DataFrame, chunks: DataFrame, keys: list[str], text: str, valid: str, **how) -> DataFrame:
    """Chunks of the chapters that have a raw row and an adapted one, and no chunk yet in ``chunks`` (``keys``).

    ``adapted`` has ``keys``, ``text`` and ``valid``; a chapter that would be chunked and is not valid is an error. ``how``
    goes to :func:`chunk_chapters`; its columns are those of ``adapted``. Repeated raw rows count once.
    """
    todo = adapted.join(raw.select(*keys).distinct(), keys, "left_semi").join(chunks.select(*keys).distinct(), keys, "left_anti")
    good = F.coalesce(F.col(valid), F.lit(False))
    made = chunk_chapters(todo.filter(good), keys, text, **how)
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    # a row of the other kind is an error when it is read
    wrong = F.raise_error(F.concat(F.lit("adapted chapter is not valid: "), name)).cast("string")
    return made.unionByName(todo.filter(~good).select(*keys, wrong.alias("chunk_id"), F.lit("").alias("text"), F.lit(0).alias("trailing_silence_ms")))


def chunk_faults(chunks: DataFrame, keys: list[str], most: int = 400) -> DataFrame:
    """``keys``, ``chunk_id``, ``fault`` of chunks that break the schema: repeated_id, bad_id, empty_text, long_text, bad_silence."""
    rows = chunks.groupBy(*keys, "chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty"), F.max(F.length("text")).alias("longest"),
        F.bool_or(~F.coalesce(F.col("trailing_silence_ms").between(0, 10_000), F.lit(False))).alias("silence"),
    )
    kinds = F.array(
        F.when(F.col("n") > 1, "repeated_id"), F.when(~F.coalesce(F.col("chunk_id").rlike(r"^\d{4}$"), F.lit(False)), "bad_id"), F.when(F.col("empty"), "empty_text"), F.when(F.col("longest") > most, "long_text"), F.when(F.col("silence"), "bad_silence"),
    )
    return rows.select(*keys, "chunk_id", F.explode(F.array_compact(kinds)).alias("fault"))
