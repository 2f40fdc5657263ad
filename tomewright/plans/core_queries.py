"""Queries over the driver's tables for the operators of this package, with their SQL.

Texts of ``documents`` have none of the faults that the cleaners mend, so the cleaning queries first put such faults in,
by one rule that is written once and spelled for both engines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.payload import read_payload
from ..operators import adaptation as A
from ..operators import audio as U
from ..operators import chunking as C
from ..operators import documents as D
from ..session import cut_lineage, spread, table
from ..sources import files as S

#: What is put behind a line, by its number.
FAULTS = [
    "\n", " “quoted” – and ‘so’ on…\n", "\n\n12\n", "\n\n[^3]: A note on the text\n", "\n==> picture 1 <==\n", "\n# Part (A) = 1\n", "\n\n---\n\n", "\nin-\nfirst-\npass\n", "\r\n", " tail  \t  x \n\n\n\n", "\nRunning Head\n", "\n## **A Plain Heading**\n",
]


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def decorated(text: str) -> Column:
    cases = " ".join(f"WHEN {i} THEN {_quoted(f)}" for i, f in enumerate(FAULTS))
    return F.expr(f"array_join(transform(split({text}, '\\n'), (l, i) -> concat(l, CASE i % {len(FAULTS)} {cases} END)), '')")


def _duck_decorated(text: str) -> str:
    cases = " ".join(f"WHEN {i} THEN E{_quoted(f)}" for i, f in enumerate(FAULTS))
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda l, i: l || CASE (i - 1) % {len(FAULTS)} {cases} END), '')"


#: White space in RE2, which knows ASCII only; Java's and Python's are those of Unicode.
W = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DOCS = f"SELECT doc_id, {_duck_decorated('text')} AS t FROM documents"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", decorated("text").alias("t"))


def _cleaned(how) -> object:
    def query(spark: SparkSession, d: str) -> DataFrame:
        # the cleaned text is used twice and made once
        both = X.let(how(F.col("t")), lambda c: F.struct(F.md5(c).alias("digest"), F.length(c).cast("long").alias("chars")))
        return _docs(spark, d).select("doc_id", both.alias("b")).select("doc_id", "b.digest", "b.chars")

    return query


def _cleaned_sql(x: str, source: str = _DOCS) -> str:
    return f"SELECT doc_id, md5(c) AS digest, length(c) AS chars FROM (SELECT doc_id, {x} AS c FROM ({source}))"


_PUNCT = "replace(translate(t, '“”‘’–—' || chr(160), '\"\"''''-- '), '…', '...')"
_SPLIT = r"string_split(regexp_replace(regexp_replace(t, '\r\n|[\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n$', ''), chr(10))"
_NOTE = rf"^{W}*\[\^?[0-9]+\]:?{W}+[^\s]"
_BODY = f"array_to_string(list_filter(ls, lambda l: NOT regexp_matches(l, '{_NOTE}')), chr(10))"


def _artifacts_sql(source: str) -> str:
    return f"""
    WITH d AS (SELECT doc_id, {_SPLIT} AS ls FROM ({source})),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
    n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, {_strip('line')}) AS k FROM l),
    kept AS (SELECT doc_id, i, line FROM n WHERE NOT regexp_matches(line, '^{W}*[0-9]{{1,4}}{W}*$')
             AND NOT (k >= 3 AND {_strip('line')} <> '' AND NOT starts_with({_strip('line')}, '#') AND length({_strip('line')}) < 60))
    SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS c FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
    """


def _endnotes_sql(source: str) -> str:
    return f"""SELECT doc_id, {_BODY} || CASE WHEN len(ns) > 0 THEN E'\\n\\n---\\n\\n## Notes\\n\\n' || array_to_string(ns, chr(10)) ELSE '' END AS c
        FROM (SELECT doc_id, ls, list_transform(list_filter(ls, lambda l: regexp_matches(l, '{_NOTE}')), lambda l: {_strip('l')}) AS ns FROM (SELECT doc_id, {_SPLIT} AS ls FROM ({source})))"""


def _headings_sql(source: str) -> str:
    return f"""SELECT doc_id, array_to_string(list_transform(ls, lambda l: CASE WHEN NOT regexp_matches(l, '{_HEAD}') THEN l
        WHEN length({_INNER}) > 70 OR regexp_matches({_INNER}, '{_CODE}') THEN {_INNER} ELSE regexp_extract(l, '^(#{{1,6}})', 1) || ' ' || {_INNER} END), chr(10)) AS c FROM (SELECT doc_id, {_SPLIT} AS ls FROM ({source}))"""


def _digest_sql(source: str) -> str:
    return f"SELECT doc_id, md5(c) AS digest, length(c) AS chars FROM ({source})"


_SPACES = _strip(r"regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[\t\r \x{0B}\x{0C}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+(\n|$)', '\1', 'g'), '\n{3,}', E'\n\n', 'g')")
_IMAGES = r"regexp_replace(t, '(?s)==>.*?<==', '', 'g')"
_ENDS = r"regexp_replace(t, '\r\n?', chr(10), 'g')"


def _pipeline_sql() -> str:
    """All cleaners in order, each over the one before."""
    step = lambda x, source: f"SELECT doc_id, {x} AS t FROM ({source})"
    named = lambda source: f"SELECT doc_id, c AS t FROM ({source})"
    first = step(_PUNCT, step(_IMAGES, step(_ENDS, _DOCS)))
    return _digest_sql(f"SELECT doc_id, {_SPACES} AS c FROM ({named(_headings_sql(named(_endnotes_sql(named(_artifacts_sql(first))))))})")



def _filename_sql(x: str) -> str:
    name = _strip("trim(" + _strip("regexp_replace(regexp_replace(" + x + ", '[\\\\/:*?\"<>|\\x00-\\x1f]', '', 'g'), '" + W + "+', ' ', 'g')") + ", '.')")
    return f"coalesce(nullif({name}, ''), CASE WHEN {x} IS NOT NULL THEN 'book' END)"


_WORDS = lambda x: f"CASE WHEN {_strip(x)} = '' THEN 0 ELSE len(string_split_regex({_strip(x)}, '{W}+')) END"


# ---- documents


def _dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    mended = D.dehyphenate(docs, "doc_id", "t", D.vocabulary(docs, "t", 3))
    return mended.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


def _slug(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chapters_raw", "row_id", "title").filter("title IS NOT NULL")
    return rows.select("row_id", X.slugify(F.col("title"), 24).alias("slug"))


def _filename_whole(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", X.safe_filename(F.col("text")).alias("name"))


def _filename_titles(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "books", "title").unionByName(table(spark, d, "chapters_raw", "title")).filter("title IS NOT NULL").distinct()
    return titles.select("title", X.safe_filename(F.col("title")).alias("name"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the pages of the book they are from."""
    return table(spark, d, "documents", "book_id", "text").filter("book_id IS NOT NULL")


def _guard(spark: SparkSession, d: str) -> DataFrame:
    return D.scan_guard(_pages(spark, d), "book_id", "text", least_mean=600.0).withColumn("pages", F.col("pages").cast("long"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return D.quality_warnings(_pages(spark, d), "book_id", "text", low=0.6, most=0.2)


def _outline(spark: SparkSession, d: str) -> DataFrame:
    """Outlines made of the chapters: some on a lower level, starting at pages with gaps and ties."""
    chapters = table(spark, d, "chapters_raw", "book_id", "chapter_index", "title").groupBy("book_id", "chapter_index").agg(F.min("title").alias("title"))
    outline = chapters.select("book_id", F.col("chapter_index").alias("ix"), F.when(F.col("chapter_index") % 4 == 3, 2).otherwise(1).alias("level"), "title", (F.col("chapter_index") * 3 - F.col("chapter_index") % 3).alias("start_page"))
    pages = chapters.groupBy("book_id").agg((F.max("chapter_index") * 3 + 2).alias("page_count"))
    return D.outline_sections(outline, pages, "book_id").select("book_id", F.col("section_ix").cast("long"), "title", F.col("page_ix").cast("long"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", X.unify_line_ends(F.col("t")).alias("t"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("fb"))
    docs = docs.withColumn("lv", D.heading_level(F.col("t")))
    got = D.split_sections(docs, "doc_id", "t", "lv", "fb")
    return got.select("doc_id", F.col("section_ix").cast("long"), "title", F.md5("body").alias("digest"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chapters_raw", "book_id", "row_id", "title", "html").withColumn("body", F.regexp_replace("html", r"<[^>]+>", " "))
    got = D.number_chapters(rows.withColumn("title", F.coalesce("title", F.lit(""))), "book_id", "row_id", "title", "body", key="row_id")
    return got.select("row_id", F.col("chapter_index").cast("long"), X.word_count(F.col("body")).cast("long").alias("words"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters_raw", "row_id", "html").filter("html IS NOT NULL").select("row_id", X.html_features(F.col("html")).alias("f"), X.markdown_math(F.col("html")).alias("dollar_math")).select("row_id", "f.*", "dollar_math")


def _headings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chapters_raw", "row_id", "html").filter("html IS NOT NULL")
    return rows.select("row_id", F.explode(X.html_headings(F.col("html"))).alias("heading"))


def _page_text(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "chapters_raw", "row_id", "html")).filter("html IS NOT NULL").withColumn("t", X.html_text("html"))
    return rows.select("row_id", X.word_count(F.col("t")).cast("long").alias("words"), F.length("t").cast("long").alias("chars"))


def _book_text(spark: SparkSession, d: str) -> DataFrame:
    rows = A.latest(table(spark, d, "chapters_raw", "book_id", "chapter_index", "title", "html", "row_id"), ["book_id", "chapter_index"], ["row_id"])
    rows = rows.withColumn("md", X.html_markdown(F.coalesce("html", F.lit("")))).withColumn("title", F.coalesce("title", F.lit("")))
    return D.full_text(rows, "book_id", "chapter_index", "title", "md").select("book_id", F.md5("full_text").alias("digest"), F.length("full_text").cast("long").alias("chars"))


# ---- adaptation


_KEYS = ["book_id", "chapter_index"]


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chapter, the last that was delivered, with its visible text."""
    rows = A.latest(table(spark, d, "chapters_raw", *_KEYS, "html", "row_id"), _KEYS, ["row_id"])
    return rows.select(*_KEYS, F.regexp_replace("html", "<[^>]+>", " ").alias("source"))


def _adapted(spark: SparkSession, d: str) -> DataFrame:
    return spread(A.latest(table(spark, d, "adapted", *_KEYS, "payload", "row_id"), _KEYS, ["row_id"]))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return A.gate(_raw(spark, d), _adapted(spark, d), _KEYS, "source")


def _gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).withColumn("length_ratio", F.round("length_ratio", 6))


def _report(spark: SparkSession, d: str) -> DataFrame:
    return A.gate_report(_gated(spark, d), "book_id")


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return A.pending(_raw(spark, d), _gated(spark, d).filter("ok"), _KEYS).select(*_KEYS)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lexicon", "book_id", "term", "spoken_as", "reason", "hint_id").filter("term IS NOT NULL AND spoken_as IS NOT NULL")
    rows = rows.withColumn("reason", F.coalesce("reason", F.lit("")))
    return A.merge_lexicon(rows, "book_id", ["hint_id"]).select("book_id", "term", "spoken_as", "reason", "first_hint_id")


def _payload_hints(spark: SparkSession, d: str) -> DataFrame:
    hints = A.hints_of(spread(table(spark, d, "adapted", *_KEYS, "row_id", "payload")), [*_KEYS, "row_id"])
    return A.merge_lexicon(hints, "book_id", ["chapter_index", "row_id", "pos"]).select("book_id", "term", "spoken_as", "reason")


def _budget(spark: SparkSession, d: str) -> DataFrame:
    return A.context_budget(table(spark, d, "chunks", "book_id", "text"), "book_id", "text", 20_000)


def _report_json(spark: SparkSession, d: str) -> DataFrame:
    return A.report_json(_gated(spark, d), "book_id", "chapter_index", "error_kind")


def _render_report_json(spark: SparkSession, d: str) -> DataFrame:
    return A.report_json(U.render_gate(table(spark, d, "chunks", *_CHUNK), table(spark, d, "wav_probe"), _CHUNK), "book_id", "chapter_index", "chunk_id", "error_kind")


def _run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of the loop's result as it stands: what passes is accepted, what does not has failed."""
    gated = _gated(spark, d)
    passing = _adapted(spark, d).join(gated.filter("ok").select(*_KEYS), _KEYS, "left_semi").select("payload", (F.col("chapter_index") % 3).alias("attempt"))
    return A.run_summary(passing, gated.filter("NOT ok"))


def _token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", A.token_estimate(F.col("text")).alias("tokens"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """The request for each chapter that fails the gate, by its length and digest."""
    failing = _gated(spark, d).filter("NOT ok").select(*_KEYS, "error_kind", "detail")
    rows = _raw(spark, d).join(failing, _KEYS).withColumn("m", A.build_message(F.coalesce("source", F.lit("")), F.lit(None).cast("string"), F.col("error_kind"), F.col("detail")))
    return rows.select(*_KEYS, F.md5("m").alias("digest"), F.length("m").cast("long").alias("chars"))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """The status of a ledger made of the deliveries of raw and adapted chapters."""
    raw = table(spark, d, "chapters_raw", "book_id", "row_id", "loaded_at").select("book_id", F.lit("parse").alias("stage"), F.col("row_id").alias("detail"), F.col("loaded_at").alias("at"))
    done = table(spark, d, "adapted", "book_id", "row_id", "received_at").select("book_id", F.lit("adapt").alias("stage"), F.col("row_id").alias("detail"), F.col("received_at").alias("at"))
    got = A.ledger_status(raw.unionByName(done).filter("at IS NOT NULL"))
    return got.select("book_id", "stage", "detail", "entries")


def _latest_adapted(spark: SparkSession, d: str) -> DataFrame:
    return A.latest(table(spark, d, "adapted", *_KEYS, "row_id", "adapter"), _KEYS, ["row_id"]).select(*_KEYS, "row_id", "adapter")


def _adapt_loop(spark: SparkSession, d: str) -> DataFrame:
    """The retry loop with a stub in place of a model: it echoes the source, the first time with a wrong key."""
    import json

    def stub(batches):
        for pdf in batches:
            wrong = pdf["error_kind"].isna() & (pdf["chapter_index"] % 2 == 1)
            yield pdf[_KEYS].assign(payload=[json.dumps({"adapted_text": s or "", "extra": 1} if w else {"adapted_text": s or ""}) for s, w in zip(pdf["source"], wrong)])

    got, failed = A.adapt_chapters(_raw(spark, d), _adapted(spark, d), _KEYS, "source", stub)
    return got.select(*_KEYS, "attempt").unionByName(failed.select(*_KEYS, F.lit(-1).alias("attempt")))


# ---- lexicon and chunks


def _sanitized(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lexicon", "hint_id", "term", "spoken_as").filter("spoken_as IS NOT NULL AND term IS NOT NULL")
    said = C.sanitize_spoken(F.col("spoken_as"))
    return rows.select("hint_id", said.alias("spoken"), C.is_redundant(F.col("term"), said).alias("redundant"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The adapted text of each chapter, with the hints of its book's merged lexicon that it may need and then those of its payload, and the headings of its source."""
    # used for the lexicon, for the words that ask for it and for the result: the payloads are read once
    parsed = cut_lineage(_adapted(spark, d).select(*_KEYS, "row_id", read_payload("payload").alias("p")))
    order = ["chapter_index", "row_id", "pos"]
    lexicon = A.merge_lexicon(A.parsed_hints(parsed, [*_KEYS, "row_id"]), "book_id", order).select("book_id", "term", "spoken_as", *(F.col(f"first_{o}").alias(f"at_{o}") for o in order))
    rows = parsed.filter("p.state = 'object' AND p.adapted_text IS NOT NULL")
    hint = "array<struct<term:string,spoken_as:string>>"
    own = F.coalesce(F.from_json("p.hints", hint), F.array().cast(hint))
    rows = rows.select(*_KEYS, F.col("p.adapted_text").alias("text"), own.alias("own"))
    book = C.hints_for(rows, lexicon, _KEYS, "book_id", "text", [f"at_{o}" for o in order])
    heads = A.latest(table(spark, d, "chapters_raw", *_KEYS, "html", "row_id"), _KEYS, ["row_id"]).select(*_KEYS, X.html_headings(F.coalesce("html", F.lit(""))).alias("headings"))
    rows = rows.join(book, _KEYS, "left").select(*_KEYS, "text", F.concat(F.coalesce("hints", F.array().cast(hint)), "own").alias("hints"))
    rows = rows.join(heads, _KEYS)
    # joins leave a small input on few tasks, and chunking is the dear part; a large one keeps its partitions
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if parsed.rdd.getNumPartitions() <= cores else rows


def _book_lexicon_applied(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select(*_KEYS, F.md5(C.apply_lexicon(F.col("text"), F.col("hints"))).alias("digest"))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.posexplode(C.paragraphs(F.col("t"))).alias("i", "p"))
    return rows.select("doc_id", F.col("i").cast("long").alias("para_ix"), F.md5("p").alias("digest"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text")
    return rows.select("doc_id", F.posexplode(C.merge_orphans(F.split("text", " "), 20)).alias("i", "p")).select("doc_id", F.col("i").cast("long").alias("part_ix"), F.md5("p").alias("digest"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks", "row_id", "text").filter("text IS NOT NULL")
    return rows.select("row_id", F.posexplode(C.split_long(F.col("text"), 120)).alias("i", "piece")).select("row_id", F.col("i").cast("long").alias("piece_ix"), "piece")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_chapters(_texts(spark, d), _KEYS, "text", "hints", "headings")


def _chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy("book_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("trailing_silence_ms").alias("silence_ms"), F.max(F.length("text")).alias("longest"))


def _chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Chapters in which chunking lost or added a letter, or made a chunk that is too long: none."""
    letters = lambda c: F.regexp_replace(F.regexp_replace(c, r"\[\[beat\]\]|(?m)^[^\S\n]*---[^\S\n]*$", ""), r"(?U)\s+", "")
    texts = _texts(spark, d)
    there = texts.select(*_KEYS, F.length(letters(C.apply_lexicon(F.col("text"), F.col("hints")))).alias("n"))
    made = C.chunk_chapters(texts, _KEYS, "text", "hints", "headings").groupBy(*_KEYS).agg(F.sum(F.length(letters(F.col("text")))).alias("m"), F.max(F.length("text")).alias("longest"))
    return there.join(made, _KEYS).filter((F.col("n") != F.col("m")) | (F.col("longest") > 400))


def _input_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The reader chosen for the books, were they files of four kinds."""
    path = F.concat(F.lit("in/"), F.col("book_id"), F.element_at(F.array(*map(F.lit, (".epub", ".v2.PDF", ".txt", ""))), (F.length("title") % 4 + 1).cast("int")))
    return table(spark, d, "books", "book_id", "title").filter("title IS NOT NULL").select("book_id", S.input_kind(path).alias("kind"))


def _voices(spark: SparkSession, d: str) -> DataFrame:
    """The voices of a listing made of the books: a recording each, for some a preview."""
    listing = table(spark, d, "books", "book_id", "title").select(F.concat(F.lit("voices/"), F.col("book_id"), F.when(F.length("title") % 3 == 0, ".preview.wav").when(F.length("title") % 3 == 1, ".txt").otherwise(".wav")).alias("path"))
    return S.voice_files(listing, "voices/bk0000001.wav")


def _chunk_missing(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the chapters that pass the gate and have none yet."""
    ok = _gated(spark, d).filter("ok").select(*_KEYS)
    texts = _adapted(spark, d).join(ok, _KEYS, "left_semi").withColumn("p", read_payload("payload")).select(*_KEYS, F.col("p.adapted_text").alias("text"), (F.col("p.state") == "object").alias("valid"))
    return C.chunk_missing(table(spark, d, "chapters_raw", *_KEYS), texts, table(spark, d, "chunks", *_KEYS), _KEYS, "text", "valid")


def _composed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as extracted books of one page each, through all steps of the document source."""
    docs = _docs(spark, d).withColumn("title", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    pages = docs.select("doc_id", F.lit(1).alias("page_ix"), "t")
    none = docs.select("doc_id", F.lit(0).alias("ix"), F.lit(1).alias("level"), "title", F.lit(1).alias("start_page")).limit(0)
    chapters, _ = D.markdown_sections(docs, pages, none, "doc_id", "title", "t", footnotes="endnote")
    return chapters.select("doc_id", F.col("chapter_index").cast("long"), "title", F.col("word_count_estimate").cast("long").alias("words"), "has_code", "has_math", "has_tables")


def _faults(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_faults(table(spark, d, "chunks", *_KEYS, "chunk_id", "text", "trailing_silence_ms"), _KEYS)


# ---- audio


_CHUNK = [*_KEYS, "chunk_id"]


def _render_gate(spark: SparkSession, d: str) -> DataFrame:
    got = U.render_gate(table(spark, d, "chunks", *_CHUNK), table(spark, d, "wav_probe"), _CHUNK)
    return got.withColumn("duration_s", F.round("duration_s", 6))


def _duration_faults(spark: SparkSession, d: str) -> DataFrame:
    got = U.duration_faults(table(spark, d, "chunks", *_CHUNK, "text"), table(spark, d, "wav_probe"), _CHUNK)
    return got.withColumn("duration_s", F.round("duration_s", 6))


def _quiet(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d)
    return rows.select(*_CHUNK, F.round(U.silence_ratio(F.col("samples")), 6).alias("quiet"))


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return U.chapter_durations(table(spark, d, "wav_probe"), _KEYS)


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return U.timeline(_durations(spark, d), "book_id", "chapter_index", "duration_ns", 1_000_000)


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "chapters_raw", *_KEYS, "title").groupBy(*_KEYS).agg(F.min("title").alias("title"))
    books = table(spark, d, "books", "book_id", F.col("title").alias("book_title"), "author")
    rows = _timeline(spark, d).join(titles, _KEYS, "left").join(books, "book_id", "left")
    return U.ffmetadata(rows, "book_id", "chapter_index", "title", "book_title", "author")


def _progress(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "wav_probe").groupBy("book_id").agg(F.count_if(F.col("readable")).alias("done"), F.count(F.lit(1)).alias("total"))
    return rows.select("book_id", "done", "total", U.progress(F.col("done"), F.col("total")).alias("percent"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """A short signal for each probe, made of its frame count: three bursts with gaps between them."""
    rows = table(spark, d, "wav_probe", *_CHUNK, "frames").filter("frames IS NOT NULL").groupBy(*_CHUNK).agg(F.max("frames").alias("frames"))
    x = F.expr("transform(sequence(1, 400), i -> CASE WHEN (i + frames) % 97 < frames % 40 THEN 0.001D ELSE ((i * 7 + frames) % 200 - 100) / 101.0D END)")
    return rows.select(*_CHUNK, x.alias("samples"), F.lit(1000).alias("rate"))


def _silence(spark: SparkSession, d: str) -> DataFrame:
    got = U.compress_silence(_signals(spark, d), "samples", "rate", max_gap_ms=10, edge_ms=5)
    return got.select(*_CHUNK, F.size("samples").cast("long").alias("kept"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d)
    return rows.select(*_CHUNK, F.round(U.peak_db(F.col("samples")), 6).alias("peak_db"))


def _voice(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d).select(F.concat_ws("/", *_CHUNK).alias("name"), "samples", F.lit(40).alias("rate"), F.lit(1).alias("channels"))
    return U.voice_checks(rows, "name", "samples", "rate", "channels").select("name", "ok", F.array_join("problems", ",").alias("problems"), F.array_join("warnings", ",").alias("warnings"))


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """Audio of a sine in place of a voice for the chunks that have no readable file, probed again."""
    chunks = A.latest(table(spark, d, "chunks", *_CHUNK, "text", "trailing_silence_ms", "row_id"), _CHUNK, ["row_id"])
    done = table(spark, d, "wav_probe").filter("readable AND frames > 0").select(*_CHUNK)

    def sine(text: str) -> tuple[np.ndarray, int]:
        return 0.5 * np.sin(np.arange(10 * max(1, len(text))) / 5), 1000

    wavs = U.render_chunks(spread(chunks), _CHUNK, done, sine)
    files = wavs.select(F.concat_ws("/", *_CHUNK).alias("path"), F.col("wav").alias("content"))
    return U.probe_wavs(files)


QUERIES = {
    "clean_line_ends": _cleaned(X.unify_line_ends),
    "clean_image_marks": _cleaned(X.drop_image_marks),
    "clean_punctuation": _cleaned(X.plain_punctuation),
    "clean_space": _cleaned(X.collapse_space),
    "clean_page_artifacts": _cleaned(X.drop_page_artifacts),
    "clean_footnotes_skip": _cleaned(lambda c: X.apply_footnotes(c, "skip")),
    "clean_footnotes_endnote": _cleaned(lambda c: X.apply_footnotes(c, "endnote")),
    "clean_footnotes_inline": _cleaned(lambda c: X.apply_footnotes(c, "inline")),
    "clean_code_headings": _cleaned(X.demote_code_headings),
    "clean_dehyphenate": _dehyphenate,
    "clean_pipeline": _cleaned(lambda c: X.clean_markdown(c, "endnote")),
    "slugify": _slug,
    "safe_filename_whole": _filename_whole,
    "safe_filename_titles": _filename_titles,
    "scan_guard": _guard,
    "quality_warnings": _quality,
    "outline_sections": _outline,
    "heading_sections": _sections,
    "kept_chapters": _kept,
    "page_features": _features,
    "page_headings": _headings,
    "page_text": _page_text,
    "book_full_text": _book_text,
    "gate_adapted": _gate,
    "gate_report": _report,
    "resume_pending": _pending,
    "merge_lexicon": _merged,
    "merge_payload_hints": _payload_hints,
    "context_budget": _budget,
    "latest_adapted": _latest_adapted,
    "gate_report_json": _report_json,
    "render_report_json": _render_report_json,
    "run_summary": _run_summary,
    "token_estimates": _token_estimates,
    "retry_messages": _messages,
    "ledger_status": _ledger,
    "input_kinds": _input_kinds,
    "voice_files": _voices,
    "chunk_missing": _chunk_missing,
    "document_source": _composed,
    "adapt_loop": _adapt_loop,
    "sanitize_hints": _sanitized,
    "apply_book_lexicon": _book_lexicon_applied,
    "paragraphs": _paragraphs,
    "merge_orphans": _orphans,
    "split_long": _long,
    "chunks": _chunks,
    "chunk_totals": _chunk_totals,
    "chunk_invariants": _chunk_invariants,
    "chunk_faults": _faults,
    "render_gate": _render_gate,
    "render_missing": _rendered,
    "duration_faults": _duration_faults,
    "silence_ratio": _quiet,
    "chapter_durations": _durations,
    "chapter_timeline": _timeline,
    "ffmetadata": _metadata,
    "progress": _progress,
    "compress_silence": _silence,
    "peak_level": _levels,
    "voice_checks": _voice,
}

# ---- SQL

_LAST_RAW = "(SELECT book_id, chapter_index, html FROM chapters_raw QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY row_id DESC) = 1)"
_LAST_ADAPTED = "(SELECT book_id, chapter_index, payload, row_id, adapter FROM adapted QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY row_id DESC) = 1)"
_GATE = rf"""
    WITH a AS (SELECT *, json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT' AS whole FROM {_LAST_ADAPTED}),
    p AS (SELECT book_id, chapter_index, row_id, payload, coalesce(whole, false) AS whole, CASE WHEN whole THEN payload::JSON END AS j FROM a),
    s AS (SELECT *, json_extract_string(j, '$.adapted_text') AS text,
        coalesce(json_type(j, '$.adapted_text') = 'VARCHAR' AND json_extract_string(j, '$.adapted_text') <> '', false)
        AND coalesce(json_type(j, '$.notes') = 'VARCHAR', true) AND coalesce(json_type(j, '$.pronunciation_hints') = 'ARRAY', true)
        AND len(list_filter(json_keys(j), lambda k: k NOT IN ('adapted_text', 'pronunciation_hints', 'notes'))) = 0
        AND len(list_filter(coalesce(CASE WHEN json_type(j, '$.pronunciation_hints') = 'ARRAY' THEN json_extract(j, '$.pronunciation_hints[*]') END, []), lambda h:
            NOT (json_type(h) = 'OBJECT' AND coalesce(json_extract_string(h, '$.term'), '') <> '' AND coalesce(json_extract_string(h, '$.spoken_as'), '') <> ''
            AND coalesce(json_type(h, '$.reason'), 'VARCHAR') = 'VARCHAR' AND json_type(h, '$.term') = 'VARCHAR' AND json_type(h, '$.spoken_as') = 'VARCHAR'
            AND len(list_filter(json_keys(h), lambda k: k NOT IN ('term', 'spoken_as', 'reason'))) = 0))) = 0 AS schema_ok FROM p),
    r AS (SELECT r.book_id, r.chapter_index, s.payload, s.whole, s.schema_ok, s.text, regexp_replace(r.html, '<[^>]+>', ' ', 'g') AS source
          FROM {_LAST_RAW} r LEFT JOIN s USING (book_id, chapter_index)),
    c AS (SELECT *, CASE WHEN regexp_matches(text, '<pre[\s>]') THEN '<pre' WHEN contains(text, '```') THEN '```' WHEN regexp_matches(text, '<table[\s>]') THEN '<table'
          WHEN contains(text, '$$') THEN '$$' WHEN regexp_matches(text, '(?i)<h1[\s>]') THEN '<h1' END AS bad,
          ({_WORDS('text')}) / greatest(({_WORDS("coalesce(source, '')")}), 1) AS ratio FROM r),
    g AS (SELECT *, CASE WHEN payload IS NULL THEN 'missing_file' WHEN NOT whole THEN 'json_parse_error' WHEN NOT schema_ok THEN 'schema_error'
          WHEN bad IS NOT NULL THEN 'markdown_artifact' WHEN ratio < 0.30 OR ratio > 1.10 THEN 'length_anomaly' END AS error_kind FROM c)
"""
_HINTS = _GATE.split("r AS (SELECT r.book_id")[0].replace(_LAST_ADAPTED, "adapted") + """
    l AS (SELECT book_id, chapter_index, row_id, json_extract(j, '$.pronunciation_hints[*]') AS hs FROM s WHERE whole AND schema_ok AND json_type(j, '$.pronunciation_hints') = 'ARRAY'),
    h AS (SELECT book_id, chapter_index, row_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS pos FROM l),
    x AS (SELECT *, json_extract_string(h, '$.term') AS term, json_extract_string(h, '$.spoken_as') AS say, coalesce(json_extract_string(h, '$.reason'), '') AS why FROM h),
    m AS (SELECT book_id, term, list(say ORDER BY chapter_index, row_id, pos)[1] AS spoken_as, list(why ORDER BY chapter_index, row_id, pos)[1] AS reason, list_sort(list_distinct(list(say))) AS s FROM x GROUP BY 1, 2),
    o AS (SELECT *, list_filter(s, lambda v: v <> spoken_as) AS others FROM m)
    SELECT book_id, term, spoken_as, CASE WHEN len(others) = 0 THEN reason ELSE CASE WHEN reason = '' THEN '' ELSE reason || ' ' END || '[conflict with: ' || array_to_string(others, ', ') || ']' END AS reason FROM o
"""
_BEST_PROBE = "(SELECT book_id, chapter_index, chunk_id, coalesce(readable, false) AS readable, coalesce(frames, 0) AS frames, coalesce(sample_rate, 0) AS sample_rate FROM wav_probe QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, chunk_id ORDER BY coalesce(readable, false) DESC, coalesce(frames, 0) DESC, coalesce(sample_rate, 0) DESC) = 1)"
_DURATIONS = """SELECT book_id, chapter_index, sum(n)::BIGINT AS chunks, sum(f::HUGEINT * 1000000000 // sample_rate)::BIGINT AS duration_ns
    FROM (SELECT book_id, chapter_index, sample_rate, count(*) AS n, sum(frames) AS f FROM wav_probe WHERE readable AND frames > 0 AND sample_rate > 0 GROUP BY ALL) GROUP BY ALL"""
_TIMELINE = f"SELECT book_id, chapter_index, ((sum(duration_ns) OVER w - duration_ns) // 1000000)::BIGINT AS start_ms, (sum(duration_ns) OVER w // 1000000)::BIGINT AS end_ms FROM ({_DURATIONS}) WINDOW w AS (PARTITION BY book_id ORDER BY chapter_index)"
_SIGNALS = "SELECT book_id, chapter_index, chunk_id, f, list_transform(range(1, 401), lambda i: CASE WHEN (i + f) % 97 < f % 40 THEN 0.001 ELSE ((i * 7 + f) % 200 - 100) / 101.0::DOUBLE END) AS x FROM (SELECT book_id, chapter_index, chunk_id, max(frames) AS f FROM wav_probe WHERE frames IS NOT NULL GROUP BY ALL)"
_HEAD = f"^#{{1,6}}{W}+.*[^ \t]{W}*$"
_INNER = _strip("regexp_replace(" + _strip(f"regexp_replace(l, '^#+{W}+', '')") + r", '^\*+|\*+$', '', 'g')")
_CODE = X.CODE_TOKEN

ORACLE = {
    "clean_line_ends": _cleaned_sql(_ENDS),
    "clean_image_marks": _cleaned_sql(_IMAGES),
    "clean_punctuation": _cleaned_sql(_PUNCT),
    "clean_space": _cleaned_sql(_SPACES),
    "clean_page_artifacts": _digest_sql(_artifacts_sql(_DOCS)),
    "clean_footnotes_skip": _digest_sql(f"SELECT doc_id, {_BODY} AS c FROM (SELECT doc_id, {_SPLIT} AS ls FROM ({_DOCS}))"),
    "clean_footnotes_endnote": _digest_sql(_endnotes_sql(_DOCS)),
    "clean_footnotes_inline": _cleaned_sql("t"),
    "clean_code_headings": _digest_sql(_headings_sql(_DOCS)),
    "clean_pipeline": _pipeline_sql(),
    "clean_dehyphenate": rf"""WITH d AS ({_DOCS}),
        v AS (SELECT w FROM (SELECT DISTINCT doc_id, lower(unnest(string_split_regex(t, '[^A-Za-z\-]+'))) AS w FROM d) WHERE regexp_matches(w, '^[a-z]{{2,}}$') GROUP BY w HAVING count(*) >= 3),
        p AS (SELECT doc_id, string_split_regex(t, '[A-Za-z]+-\n[A-Za-z]+') AS outs, regexp_extract_all(t, '[A-Za-z]+-\n[A-Za-z]+') AS hits FROM d),
        h AS (SELECT doc_id, unnest(hits) AS x, generate_subscripts(hits, 1) AS i FROM p),
        f AS (SELECT doc_id, i, replace(x, E'-\n', CASE WHEN v.w IS NULL THEN '-' ELSE '' END) AS y FROM h LEFT JOIN v ON v.w = lower(replace(x, E'-\n', ''))),
        g AS (SELECT doc_id, list(y ORDER BY i) AS ys FROM f GROUP BY 1),
        r AS (SELECT p.doc_id, array_to_string(list_transform(list_zip(outs, coalesce(ys, [])), lambda z: z[1] || coalesce(z[2], '')), '') AS c FROM p LEFT JOIN g USING (doc_id))
        SELECT doc_id, md5(c) AS digest, length(c) AS chars FROM r""",
    "merge_orphans": f"""WITH r AS (SELECT doc_id, list_reduce(list_transform(list_filter(list_transform(string_split(text, ' '), lambda x: {_strip('x')}), lambda x: x <> ''), lambda x: {{'m': []::VARCHAR[], 'p': x}}),
        lambda a, b: CASE WHEN length(concat_ws(' ', nullif(a.p, ''), b.p)) < 20 THEN {{'m': a.m, 'p': concat_ws(' ', nullif(a.p, ''), b.p)}} ELSE {{'m': list_append(a.m, concat_ws(' ', nullif(a.p, ''), b.p)), 'p': ''}} END, {{'m': []::VARCHAR[], 'p': ''}}) AS s FROM documents WHERE text IS NOT NULL),
        f AS (SELECT doc_id, CASE WHEN s.p = '' THEN s.m WHEN len(s.m) > 0 THEN list_append(s.m[1:-2], s.m[-1] || ' ' || s.p) ELSE [s.p] END AS parts FROM r)
        SELECT doc_id, i - 1 AS part_ix, md5(p) AS digest FROM (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM f)""",
    "split_long": rf"""WITH s AS (SELECT row_id, {_strip('text')} AS s FROM chunks WHERE text IS NOT NULL),
        k AS (SELECT row_id, s, list_reduce(list_transform(string_split(regexp_replace(s, '([,;:]){W}+', '\1' || chr(31), 'g'), chr(31)), lambda x: {{'m': []::VARCHAR[], 'p': x}}),
            lambda a, b: CASE WHEN length(a.p) + 1 + length(b.p) > 120 THEN {{'m': list_append(a.m, a.p), 'p': b.p}} ELSE {{'m': a.m, 'p': a.p || ' ' || b.p}} END) AS r FROM s WHERE length(s) > 120),
        q AS (SELECT row_id, list_append(r.m, r.p) AS ps FROM k),
        c AS (SELECT row_id, list_filter(flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 120 THEN [p] ELSE list_transform(regexp_extract_all(p, '(?s){W}*(.{{1,120}}$|.{{1,119}} |.{{120}})', 1), lambda x: regexp_replace(x, '{W}+$', '')) END)), lambda p: p <> '') AS ps FROM q
            UNION ALL SELECT row_id, [s] FROM s WHERE length(s) <= 120)
        SELECT row_id, i - 1 AS piece_ix, piece FROM (SELECT row_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM c)""",
    "slugify": """SELECT row_id, CASE WHEN slug = '' THEN 'untitled' ELSE slug END AS slug FROM (SELECT row_id, CASE WHEN length(s) <= 24 THEN s
        WHEN trim(regexp_replace(s[1:24], '-[^-]*$', ''), '-') <> '' THEN trim(regexp_replace(s[1:24], '-[^-]*$', ''), '-') ELSE s[1:24] END AS slug
        FROM (SELECT row_id, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM chapters_raw WHERE title IS NOT NULL))""",
    "safe_filename_whole": f"SELECT doc_id, {_filename_sql('text')} AS name FROM documents",
    "safe_filename_titles": f"SELECT title, {_filename_sql('title')} AS name FROM (SELECT title FROM books UNION SELECT title FROM chapters_raw) WHERE title IS NOT NULL",
    "scan_guard": f"""SELECT book_id, pages, chars::BIGINT AS chars, CASE WHEN chars < 100 OR chars / pages < 600 THEN 'scanned' END AS error_kind
        FROM (SELECT book_id, count(*) AS pages, sum(length({_strip("coalesce(text, '')")})) AS chars FROM documents WHERE book_id IS NOT NULL GROUP BY 1)""",
    "quality_warnings": f"""WITH p AS (SELECT book_id, length({_strip("coalesce(text, '')")}) AS n, coalesce(regexp_matches(text, '(?m)^#{{1,6}} +[^\\s]'), false) AS h FROM documents WHERE book_id IS NOT NULL),
        s AS (SELECT book_id, count(*) AS pages, median(n) AS m, bool_or(h) AS h FROM p GROUP BY 1),
        l AS (SELECT book_id, count(*) FILTER (n < 0.6 * m) AS low FROM p JOIN s USING (book_id) GROUP BY 1)
        SELECT book_id, pages, m AS median_chars, low AS low_pages, pages > 20 AND NOT h AS no_headings, pages >= 4 AND m > 0 AND low / pages > 0.2 AS uneven FROM s JOIN l USING (book_id)""",
    "outline_sections": """WITH c AS (SELECT book_id, chapter_index AS ix, min(title) AS title FROM chapters_raw GROUP BY ALL),
        n AS (SELECT book_id, max(ix) * 3 + 2 AS pages FROM c GROUP BY 1),
        o AS (SELECT book_id, ix, title, ix * 3 - ix % 3 AS a FROM c WHERE ix % 4 <> 3 AND ix * 3 - ix % 3 >= 1),
        s AS (SELECT o.*, coalesce(lead(a) OVER w, pages + 1) AS b, row_number() OVER w - 1 AS section_ix, count(*) OVER (PARTITION BY o.book_id) AS k FROM o JOIN n USING (book_id) WINDOW w AS (PARTITION BY o.book_id ORDER BY ix))
        SELECT book_id, section_ix, title, unnest(range(a, b))::BIGINT AS page_ix FROM s WHERE k >= 2 AND a < b""",
    "heading_sections": rf"""WITH d AS (SELECT doc_id, regexp_replace(t, '\r\n?', chr(10), 'g') AS t FROM ({_DOCS})),
        v AS (SELECT *, CASE WHEN regexp_matches(t, '(?m)^# +[^\s]') THEN 1 WHEN regexp_matches(t, '(?m)^## +[^\s]') THEN 2 END AS lv FROM d),
        l AS (SELECT doc_id, lv, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM v),
        h AS (SELECT *, lv IS NOT NULL AND length(regexp_extract(line, '^(#+) +[^\s]', 1)) = lv AS head FROM l),
        n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sid FROM h),
        s AS (SELECT doc_id, sid, max(CASE WHEN head THEN {_strip("regexp_replace(regexp_replace(line, '^#+ +', ''), '[\\s]*#+[\\s]*$', '')")} END) AS title, any_value(lv) AS lv, {_strip("coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), '')")} AS body FROM n GROUP BY 1, 2)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS section_ix, coalesce(title, CASE WHEN lv IS NULL THEN 'doc ' || doc_id ELSE 'Front Matter' END) AS title, md5(body) AS digest FROM s WHERE body <> ''""",
    "kept_chapters": f"""SELECT row_id, row_number() OVER (PARTITION BY book_id ORDER BY row_id, title) - 1 AS chapter_index, words FROM (SELECT book_id, row_id, title, {_WORDS('body')} AS words
        FROM (SELECT book_id, row_id, coalesce(title, '') AS title, regexp_replace(html, '<[^>]+>', ' ', 'g') AS body FROM chapters_raw)) WHERE words >= 10 AND NOT regexp_matches(title, '(?i)copyright|acknowledg|dedication|^index$|bibliograph')""",
    "page_features": r"""SELECT row_id, regexp_matches(html, '(?i)<(?:pre|code)[\s>/]') AS has_code, regexp_matches(html, '(?i)<math[\s>/]|<[a-z][^>]*\sclass\s*=\s*(?:"(?:[^"]*\s)?math(?:\s[^"]*)?"|''(?:[^'']*\s)?math(?:\s[^'']*)?''|math[\s>])') AS has_math,
        regexp_matches(html, '(?i)<table[\s>/]') AS has_tables, regexp_matches(html, '\$\$|\\\(|\\\[') AS dollar_math FROM chapters_raw WHERE html IS NOT NULL""",
    "page_headings": f"""SELECT DISTINCT row_id, heading FROM (SELECT row_id, {_strip("regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)), '<[^>]+>', '', 'g'), '" + W + "+', ' ', 'g')")} AS heading FROM chapters_raw) WHERE heading <> ''""",
    "gate_adapted": _GATE + "SELECT book_id, chapter_index, error_kind IS NULL AS ok, error_kind, CASE WHEN error_kind = 'markdown_artifact' THEN bad END AS detail, round(CASE WHEN error_kind IS NULL OR error_kind = 'length_anomaly' THEN ratio END, 6) AS length_ratio FROM g",
    "gate_report": _GATE + "SELECT book_id, bool_and(error_kind IS NULL) AS ok, count(*) AS chapters, count(error_kind) AS failed, " + ", ".join(f"count(*) FILTER (error_kind = '{k}') AS {k}" for k in ("missing_file", "json_parse_error", "schema_error", "markdown_artifact", "length_anomaly")) + " FROM g GROUP BY 1",
    "resume_pending": _GATE + "SELECT book_id, chapter_index FROM g WHERE error_kind IS NOT NULL",
    "merge_lexicon": """WITH h AS (SELECT book_id, term, spoken_as, coalesce(reason, '') AS reason, hint_id FROM lexicon WHERE term IS NOT NULL AND spoken_as IS NOT NULL),
        m AS (SELECT book_id, term, arg_min(spoken_as, hint_id) AS spoken_as, arg_min(reason, hint_id) AS reason, min(hint_id) AS first_hint_id, list_sort(list_distinct(list(spoken_as))) AS s FROM h GROUP BY 1, 2),
        o AS (SELECT *, list_filter(s, lambda x: x <> spoken_as) AS others FROM m)
        SELECT book_id, term, spoken_as, CASE WHEN len(others) = 0 THEN reason ELSE CASE WHEN reason = '' THEN '' ELSE reason || ' ' END || '[conflict with: ' || array_to_string(others, ', ') || ']' END AS reason, first_hint_id FROM o""",
    "merge_payload_hints": _HINTS,
    "context_budget": "SELECT book_id, greatest(1, floor(n / 4))::BIGINT AS tokens, n > 0 AND greatest(1, floor(n / 4)) <= 12000 AS included FROM (SELECT book_id, sum(length(coalesce(text, ''))) AS n FROM chunks GROUP BY 1)",
    "adapt_loop": _GATE + rf"""SELECT book_id, chapter_index, CASE WHEN error_kind IS NULL THEN 0
        WHEN ({_WORDS("coalesce(source, '')")}) = 0 OR regexp_matches(source, '<pre[\s>]|```|<table[\s>]|\$\$|(?i:<h1[\s>])') THEN -1 WHEN chapter_index % 2 = 1 THEN 2 ELSE 1 END AS attempt FROM g""",
    "render_missing": """WITH c AS (SELECT book_id, chapter_index, chunk_id, text, trailing_silence_ms FROM chunks QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, chunk_id ORDER BY row_id DESC) = 1)
        SELECT concat_ws('/', book_id, chapter_index, chunk_id) AS path, true AS readable, 10 * greatest(1, length(coalesce(text, ''))) + greatest(0, coalesce(trailing_silence_ms, 0)) AS frames, 1000 AS sample_rate
        FROM c ANTI JOIN (SELECT * FROM wav_probe WHERE readable AND frames > 0) USING (book_id, chapter_index, chunk_id)""",
    "input_kinds": r"""SELECT book_id, CASE WHEN e IN ('epub', 'pdf') THEN e END AS kind FROM (SELECT book_id, lower(regexp_extract('in/' || book_id || ['.epub', '.v2.PDF', '.txt', ''][length(title) % 4 + 1], '\.([^./\\]+)$', 1)) AS e FROM books WHERE title IS NOT NULL)""",
    "voice_files": "SELECT book_id AS name, 'voices/' || book_id || '.wav' AS path, book_id = 'bk0000001' AS active FROM books WHERE title IS NULL OR length(title) % 3 = 2",
    "token_estimates": "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL",
    "gate_report_json": _GATE + """SELECT book_id, '{"ok":' || bool_and(error_kind IS NULL) || ',"results":[' || string_agg('{"chapter_index":' || chapter_index || CASE WHEN error_kind IS NULL THEN '' ELSE ',"error_kind":"' || error_kind || '"' END || ',"ok":' || (error_kind IS NULL) || '}', ',' ORDER BY chapter_index) || ']}' AS report FROM g GROUP BY 1""",
    "run_summary": _GATE + """SELECT count(*) FILTER (error_kind IS NULL) AS succeeded, count(*) FILTER (error_kind IS NULL AND chapter_index % 3 > 1) AS retried, coalesce(sum(greatest(1, length(payload) // 4)) FILTER (error_kind IS NULL), 0)::BIGINT AS tokens_out, count(*) FILTER (error_kind IS NOT NULL) AS failed FROM g""",
    "retry_messages": _GATE + r"""SELECT book_id, chapter_index, md5(m) AS digest, length(m) AS chars FROM (SELECT book_id, chapter_index, E'The chapter, as JSON:\n' || coalesce(source, '') || E'\n\nThe last answer was refused (error_kind ' || error_kind || '): ' || coalesce(CASE WHEN error_kind = 'markdown_artifact' THEN bad END, 'no detail') || E'\nAnswer again without this fault.' AS m FROM g WHERE error_kind IS NOT NULL)""",
    "ledger_status": """SELECT book_id, stage, arg_max(detail, row(t, detail)) AS detail, count(*) AS entries FROM (SELECT book_id, 'parse' AS stage, row_id AS detail, loaded_at AS t FROM chapters_raw UNION ALL SELECT book_id, 'adapt', row_id, received_at FROM adapted) WHERE t IS NOT NULL GROUP BY 1, 2""",
    "chunk_invariants": "SELECT book_id, chapter_index, 0 AS n, 0 AS m, 0 AS longest FROM adapted WHERE false",
    "latest_adapted": f"SELECT book_id, chapter_index, row_id, adapter FROM {_LAST_ADAPTED}",
    "sanitize_hints": f"""WITH s AS (SELECT hint_id, term, {_strip("regexp_replace(regexp_replace(CASE WHEN regexp_matches(spoken_as, '\\p{Lu}') AND regexp_matches(spoken_as, '\\p{Ll}') THEN lower(spoken_as) ELSE spoken_as END, '[-_]+', ' ', 'g'), '" + W + "+', ' ', 'g')")} AS spoken FROM lexicon WHERE spoken_as IS NOT NULL AND term IS NOT NULL)
        SELECT hint_id, spoken, regexp_matches(spoken, '^\\p{{L}}(?: \\p{{L}})+$') AND lower(replace(spoken, ' ', '')) = lower(regexp_replace(term, '[^A-Za-z]', '', 'g')) AS redundant FROM s""",
    "paragraphs": f"SELECT doc_id, i - 1 AS para_ix, md5(p) AS digest FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\\n{W}*\\n'), lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM ({_DOCS})))",
    "chunk_faults": """WITH g AS (SELECT book_id, chapter_index, chunk_id, count(*) AS n, bool_or(coalesce(length(text), 0) = 0) AS e, max(length(text)) AS m, bool_or(NOT coalesce(trailing_silence_ms BETWEEN 0 AND 10000, false)) AS s FROM chunks GROUP BY ALL)
        SELECT book_id, chapter_index, chunk_id, unnest(list_filter([CASE WHEN n > 1 THEN 'repeated_id' END, CASE WHEN NOT coalesce(regexp_matches(chunk_id, '^[0-9]{4}$'), false) THEN 'bad_id' END, CASE WHEN e THEN 'empty_text' END, CASE WHEN m > 400 THEN 'long_text' END, CASE WHEN s THEN 'bad_silence' END], lambda x: x IS NOT NULL)) AS fault FROM g""",
    "render_report_json": f"""WITH c AS (SELECT DISTINCT book_id, chapter_index, chunk_id FROM chunks), g AS (SELECT c.*, CASE WHEN p.readable IS NULL THEN 'missing' WHEN NOT p.readable THEN 'unreadable' WHEN p.frames <= 0 OR p.sample_rate <= 0 THEN 'zero_duration' END AS error_kind
        FROM c LEFT JOIN {_BEST_PROBE} p USING (book_id, chapter_index, chunk_id)) SELECT book_id, '{{"ok":' || bool_and(error_kind IS NULL) || ',"results":[' || string_agg('{{"chapter_index":' || chapter_index || ',"chunk_id":"' || chunk_id || '"' || CASE WHEN error_kind IS NULL THEN '' ELSE ',"error_kind":"' || error_kind || '"' END || ',"ok":' || (error_kind IS NULL) || '}}', ',' ORDER BY chapter_index, chunk_id) || ']}}' AS report FROM g GROUP BY 1""",
    "render_gate": f"""WITH c AS (SELECT DISTINCT book_id, chapter_index, chunk_id FROM chunks), g AS (SELECT c.*, p.frames, p.sample_rate, CASE WHEN p.readable IS NULL THEN 'missing' WHEN NOT p.readable THEN 'unreadable' WHEN p.frames <= 0 OR p.sample_rate <= 0 THEN 'zero_duration' END AS error_kind
        FROM c LEFT JOIN {_BEST_PROBE} p USING (book_id, chapter_index, chunk_id)) SELECT book_id, chapter_index, chunk_id, error_kind IS NULL AS ok, error_kind, round(CASE WHEN error_kind IS NULL THEN frames / sample_rate END, 6) AS duration_s FROM g""",
    "duration_faults": f"""WITH c AS (SELECT book_id, chapter_index, chunk_id, max(length(coalesce(text, ''))) AS n FROM chunks GROUP BY ALL),
        r AS (SELECT c.*, p.frames / p.sample_rate AS s FROM c JOIN {_BEST_PROBE} p USING (book_id, chapter_index, chunk_id) WHERE p.readable AND p.frames > 0 AND p.sample_rate > 0)
        SELECT book_id, chapter_index, chunk_id, CASE WHEN s < 0.5 THEN 'too_short' ELSE 'too_long' END AS fault, round(s, 6) AS duration_s FROM r WHERE s < 0.5 OR s > n / 10.0""",
    "silence_ratio": f"SELECT book_id, chapter_index, chunk_id, round(len(list_filter(x, lambda v: abs(v) < 0.0031622776601683795)) / len(x), 6) AS quiet FROM ({_SIGNALS})",
    "chapter_durations": _DURATIONS,
    "chapter_timeline": _TIMELINE,
    "ffmetadata": f"""WITH t AS ({_TIMELINE}), n AS (SELECT book_id, chapter_index, min(title) AS title FROM chapters_raw GROUP BY ALL),
        r AS (SELECT t.*, n.title, b.title AS bt, b.author AS a FROM t LEFT JOIN n USING (book_id, chapter_index) LEFT JOIN books b ON b.book_id = t.book_id)
        SELECT book_id, E';FFMETADATA1\\ntitle=' || coalesce(max(bt), '') || E'\\nartist=' || coalesce(max(a), '') || E'\\n' || string_agg(E'\\n[CHAPTER]\\nTIMEBASE=1/1000\\nSTART=' || start_ms || E'\\nEND=' || end_ms || E'\\ntitle=' || coalesce(title, ''), E'\\n' ORDER BY chapter_index) || E'\\n' AS metadata FROM r GROUP BY 1""",
    "progress": "SELECT book_id, done, total, CASE WHEN total > 0 THEN round_even(done * 100 / total, 0)::INT ELSE 0 END AS percent FROM (SELECT book_id, count(*) FILTER (readable) AS done, count(*) AS total FROM wav_probe GROUP BY 1)",
    "peak_level": f"SELECT book_id, chapter_index, chunk_id, round(CASE WHEN m > 0 THEN 20 * log10(m) END, 6) AS peak_db FROM (SELECT book_id, chapter_index, chunk_id, list_max(list_transform(x, lambda v: abs(v))) AS m FROM ({_SIGNALS}))",
    "compress_silence": f"""WITH s AS ({_SIGNALS}), v AS (SELECT book_id, chapter_index, chunk_id, list_filter(range(1, 401), lambda i: abs(x[i]) > 0.01) AS v FROM s)
        SELECT book_id, chapter_index, chunk_id, CASE WHEN len(v) = 0 THEN 5 ELSE len(v) + least(v[1] - 1, 5) + least(400 - v[-1], 5) + coalesce(list_sum(list_transform(range(1, len(v)), lambda i: least(v[i + 1] - v[i] - 1, 10))), 0) END::BIGINT AS kept FROM v""",
    "voice_checks": f"""WITH s AS (SELECT book_id || '/' || chapter_index || '/' || chunk_id AS name, x FROM ({_SIGNALS})), m AS (SELECT name, len(x) / 40 AS secs, list_max(list_transform(x, lambda v: abs(v))) AS peak, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms FROM s)
        SELECT name, secs >= 5 AND rms >= 1e-3 AS ok, array_to_string(list_filter([CASE WHEN secs < 5 THEN 'too_short' END, CASE WHEN rms < 1e-3 THEN 'silent' END], lambda e: e IS NOT NULL), ',') AS problems,
        array_to_string(list_filter([CASE WHEN secs >= 5 AND (secs < 10 OR secs > 20) THEN 'length' END, 'rate', CASE WHEN peak >= 0.99 THEN 'clipping' END], lambda e: e IS NOT NULL), ',') AS warnings FROM m""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
