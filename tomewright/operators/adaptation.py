"""The gate for adapted chapters, what it reports, and the driver that asks for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import filled
from ..functions.payload import read_payload
from ..session import cut_lineage

LEAST_RATIO, MOST_RATIO = 0.30, 1.10


def markdown_artifact(text: Column) -> Column:
    """The first trace of markup in an adapted text, or null."""
    return (
        F.when(text.rlike(r"<pre[\s>]"), "<pre").when(text.rlike("```"), "```").when(text.rlike(r"<table[\s>]"), "<table").when(text.rlike(r"\$\$"), "$$").when(text.rlike(r"(?i)<h1[\s>]"), "<h1")
    )


def gate(raw: DataFrame, adapted: DataFrame, keys: list[str], source_text: str) -> DataFrame:
    """``keys``, ``ok``, ``error_kind``, ``detail``, ``length_ratio`` for every raw chapter.

    ``adapted`` has ``keys`` and ``payload``; both sides are unique on ``keys``. The first check that fails names the
    kind: missing_file, json_parse_error, schema_error, markdown_artifact, length_anomaly. Adapted rows without a raw
    chapter are not reported.
    """
    parsed = adapted.select(*keys, F.lit(True).alias("there"), read_payload("payload").alias("p"))
    rows = raw.select(*keys, F.col(source_text).alias("source")).join(parsed, keys, "left")
    text = F.col("p.adapted_text")
    rows = rows.withColumns({"bad": markdown_artifact(text), "ratio": X.word_count(text) / F.greatest(X.word_count(F.coalesce(F.col("source"), F.lit(""))), F.lit(1))})
    kind = (
        F.when(F.col("there").isNull() | (F.col("p.state") == "null"), "missing_file")
        .when(F.col("p.state") != "object", "json_parse_error")
        .when(~F.col("p.schema_ok"), "schema_error")
        .when(F.col("bad").isNotNull(), "markdown_artifact")
        .when((F.col("ratio") < LEAST_RATIO) | (F.col("ratio") > MOST_RATIO), "length_anomaly")
    )
    rows = rows.withColumn("error_kind", kind)
    reached = F.col("error_kind").isNull() | (F.col("error_kind") == "length_anomaly")
    return rows.select(*keys, F.col("error_kind").isNull().alias("ok"), "error_kind", F.when(F.col("error_kind") == "markdown_artifact", F.col("bad")).alias("detail"), F.when(reached, F.col("ratio")).alias("length_ratio"))


def gate_report(gated: DataFrame, scope: str) -> DataFrame:
    """``scope``, ``ok`` (all of its chapters pass), ``chapters``, ``failed`` and one count for each kind."""
    kinds = ("missing_file", "json_parse_error", "schema_error", "markdown_artifact", "length_anomaly")
    return gated.groupBy(scope).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.count(F.lit(1)).alias("chapters"), F.count_if(~F.col("ok")).alias("failed"), *(F.count_if(F.col("error_kind") == k).alias(k) for k in kinds))


_HINTS = "array<struct<term:string,spoken_as:string,reason:string>>"


def hints_of(adapted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``pos``, ``term``, ``spoken_as``, ``reason``: the hints of the payloads that keep the schema."""
    return parsed_hints(adapted.select(*keys, read_payload("payload").alias("p")), keys)


def parsed_hints(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`hints_of`, of payloads that were read into ``p`` already."""
    rows = parsed.filter((F.col("p.state") == "object") & F.col("p.schema_ok"))
    got = rows.select(*keys, F.posexplode(F.from_json("p.hints", _HINTS)).alias("pos", "h"))
    return got.select(*keys, "pos", "h.term", "h.spoken_as", F.coalesce("h.reason", F.lit("")).alias("reason"))


def merge_lexicon(hints: DataFrame, book: str, order: list[str]) -> DataFrame:
    """``book``, ``term``, ``spoken_as``, ``reason``: for each exact term the first spelling in ``order``; others are noted.

    Other spellings are added to the reason, sorted, as ``[conflict with: a, b]``. A hot term is aggregated before the
    shuffle; only its distinct spellings are gathered.
    """
    first = F.min(F.struct(*order, "spoken_as", "reason")).alias("f")
    merged = hints.groupBy(book, "term").agg(first, F.collect_set("spoken_as").alias("all"))
    others = F.array_sort(F.array_remove(F.col("all"), F.col("f.spoken_as")))
    note = F.concat(F.lit("[conflict with: "), F.array_join(others, ", "), F.lit("]"))
    reason = F.when(F.size(others) == 0, F.col("f.reason")).when(F.col("f.reason") == "", note).otherwise(F.concat_ws(" ", "f.reason", note))
    return merged.select(book, "term", F.col("f.spoken_as").alias("spoken_as"), reason.alias("reason"), *(F.col(f"f.{o}").alias(f"first_{o}") for o in order))


def token_estimate(text: Column) -> Column:
    return _tokens(F.length(text))


def _tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("long")


def context_budget(parts: DataFrame, book: str, text: str, window: int, share: float = 0.6) -> DataFrame:
    """``book``, ``tokens``, ``included``: whether a whole book fits into the share of the context window; empty books do not.

    ``parts`` are the texts of each book in any number of rows; only their lengths are summed. A null text has none.
    """
    sizes = parts.groupBy(book).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars"))
    tokens = _tokens(F.col("chars"))
    return sizes.select(book, tokens.alias("tokens"), ((F.col("chars") > 0) & (tokens <= int(window * share))).alias("included"))


def build_message(chapter_json: Column, context: Column, kind: Column, detail: Column) -> Column:
    """The request for one chapter: the chapter, the book if it is given, the last failure if there was one."""
    failed = F.concat(F.lit("\nThe last answer was refused (error_kind "), kind, F.lit("): "), F.coalesce(detail, F.lit("no detail")), F.lit("\nAnswer again without this fault."))
    book = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\nThe whole book, in Markdown:\n"), context))
    return F.concat_ws("\n", F.concat(F.lit("The chapter, as JSON:\n"), chapter_json), book, F.when(kind.isNotNull(), failed))


def pending(raw: DataFrame, passing: DataFrame, keys: list[str]) -> DataFrame:
    """The chapters whose work is not done: those without a passing row."""
    return raw.join(passing.select(*keys).distinct(), keys, "left_anti")


Adapter = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def adapt_chapters(raw: DataFrame, done: DataFrame, keys: list[str], source_text: str, adapter: Adapter, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(accepted, failed) after up to ``attempts`` rounds of an injected ``adapter``.

    ``adapter`` maps batches of ``keys``, the source text, ``error_kind`` and ``detail`` to batches of ``keys`` and
    ``payload``. Chapters that ``done`` (``keys``, ``payload``) already has in passing form are not asked for. Each round
    asks for what still fails, with its failure, and is written once.
    """
    gated = gate(raw, done, keys, source_text)
    ok = gated.filter("ok").select(*keys)
    accepted = done.select(*keys, "payload").join(ok, keys, "left_semi").withColumn("attempt", F.lit(0))
    todo = pending(raw, ok, keys).select(*keys, source_text).withColumns({"error_kind": F.lit(None).cast("string"), "detail": F.lit(None).cast("string")})
    schema = T.StructType([*(raw.schema[k] for k in keys), T.StructField("payload", T.StringType())])
    for n in range(1, attempts + 1):
        todo = cut_lineage(todo)
        if todo.isEmpty():
            break
        answers = cut_lineage(todo.mapInPandas(filled(adapter), schema))
        checked = gate(todo, answers, keys, source_text)
        passed = checked.filter("ok").select(*keys)
        accepted = accepted.unionByName(answers.join(passed, keys, "left_semi").withColumn("attempt", F.lit(n)))
        todo = todo.select(*keys, source_text).join(checked.filter("NOT ok").select(*keys, "error_kind", "detail"), keys)
    return accepted, todo.select(*keys, "error_kind", "detail")


def run_summary(accepted: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: chapters that succeeded, those of them that were retried, those that failed, tokens of the answers."""
    a = accepted.agg(F.count(F.lit(1)).alias("succeeded"), F.count_if(F.col("attempt") > 1).alias("retried"), F.coalesce(F.sum(token_estimate(F.col("payload"))), F.lit(0)).alias("tokens_out"))
    return a.crossJoin(failed.agg(F.count(F.lit(1)).alias("failed")))  # one row each


def report_json(gated: DataFrame, scope: str, *fields: str) -> DataFrame:
    """``scope``, ``report``: the report of either gate as JSON, ``{"ok": ..., "results": [...]}``, results in the order of ``fields``.

    ``gated`` has ``ok`` and ``fields``, the first of which tell the rows of a scope apart. One cell a scope: the results
    are short and as many as a book has chapters or chunks.
    """
    rows = F.array_sort(F.collect_list(F.struct(*fields, "ok")))
    return gated.groupBy(scope).agg(F.to_json(F.struct(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), rows.alias("results"))).alias("report"))


#: The stages of a run, in order.
STAGES = ("parse", "adapt", "chunk", "render", "assemble")


def append_ledger(df: DataFrame, path: str) -> None:
    """Adds ``df`` (``book_id``, ``stage``, ``detail``, ``at``) to the ledger at ``path``; what is there is never rewritten."""
    unknown = ~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False))
    rows = df.select("book_id", F.when(unknown, F.raise_error(F.concat(F.lit("unknown stage "), F.coalesce("stage", F.lit("null"))))).otherwise(F.col("stage")).alias("stage"), "detail", "at")
    rows.write.mode("append").parquet(path)


def ledger_status(ledger: DataFrame) -> DataFrame:
    """``book_id``, ``stage``, ``detail``, ``at``, ``entries``: the last entry of each stage of each book; an empty ledger has none."""
    got = ledger.groupBy("book_id", "stage").agg(F.max(F.struct("at", "detail")).alias("l"), F.count(F.lit(1)).alias("entries"))
    return got.select("book_id", "stage", "l.detail", "l.at", "entries")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``, which tells the rows of a key apart: repeated deliveries settled, as a ledger is read.

    Only keys and order are aggregated, before the shuffle; the wide columns are met once, by a semi-join that is a
    broadcast where the keys are few. A null key is a key of its own.
    """
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    last = rows.groupBy(*keys).agg(F.max(place).alias("_last")).select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "_last")
    same = place.eqNullSafe(F.col("_last"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(last, same, "left_semi")
