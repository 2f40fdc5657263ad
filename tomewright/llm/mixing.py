"""Problem 8: mixing sources to target weights.

Weights come from a temperature: source shares are tilted from what there is (exponent 0) towards the target shares
(exponent 1), and the exponent is bisected to the largest that the repetition limits allow at the wanted size; without
targets the plain form ``share ** exponent`` is bisected to a target entropy. Without a wanted size the largest mixture
is taken that reaches the targets exactly.

A budget becomes whole passes over a source and the first blocks of a permutation of its blocks. The block that the
budget ends in is parted into blocks again, and so on until it is small, so that no task orders more than :data:`FANOUT`
blocks or some :data:`BLOCK_DOCS` documents of a source, however large the source is.
"""

from __future__ import annotations

import math
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage
from .cuts import source_name

#: Blocks that a source, or a block of it, is parted into at most, and the documents a block has about, at least.
FANOUT, BLOCK_DOCS = 4096, 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_counter(path: str = TOKENIZER):
    """A UDF that counts the tokens of texts with the tokenizer in the file ``path``; null has 0."""
    kept: list = []

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        if not kept:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            kept.append(Tokenizer.from_file(path))
            kept[0].encode_special_tokens = True
        return pd.Series([len(e.ids) for e in kept[0].encode_batch(text.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(fits, low: float, high: float) -> float:
    """The largest exponent in [low, high] for which ``fits`` holds, if it holds at ``low`` and breaks off once."""
    if fits(high):
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def temperature_weights(tokens: dict[str, int], targets: dict[str, float] | None = None, caps: dict[str, int] | None = None, total: float | None = None, least_entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, exponent, total size) for sources that have ``tokens``.

    Sources without tokens get no weight. With ``targets`` the weights lie on the path from the shares there are to the
    target shares; without, they are the shares to the power of the exponent, which is lowered from 1 until their
    entropy reaches ``least_entropy``. ``caps`` are the repetitions allowed (1 if not given).
    """
    have = {s: n for s, n in tokens.items() if n > 0 and (targets is None or targets.get(s, 0) > 0)}
    if not have:
        return {}, 1.0, 0.0
    caps = caps or {}
    size = sum(have.values())
    share = {s: n / size for s, n in have.items()}

    def norm(w: dict[str, float]) -> dict[str, float]:
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    goal = norm({s: targets[s] for s in have}) if targets else None

    def at(a: float) -> dict[str, float]:
        if goal:
            return norm({s: share[s] * (goal[s] / share[s]) ** a for s in have})
        return norm({s: share[s] ** a for s in have})

    def room(w: dict[str, float]) -> float:
        return min(max(1, caps.get(s, 1)) * have[s] / w[s] for s in have)

    if goal:
        a = 1.0 if total is None else _bisect(lambda x: room(at(x)) >= total * (1 - 1e-12), 0.0, 1.0)
    elif least_entropy is not None:
        a = 1 - _bisect(lambda x: entropy(at(1 - x)) <= least_entropy, 0.0, 1.0)
    elif total is not None:
        a = 1 - _bisect(lambda x: room(at(1 - x)) >= total * (1 - 1e-12), 0.0, 1.0)
    else:
        a = 1.0
    w = at(a)
    return w, a, min(room(w), total) if total is not None else room(w)


def _first_blocks(rows: DataFrame, docs: int, seed: int) -> DataFrame:
    """``rows`` (``key``, ``source``, ``tokens``, ``rest``, ``docs``) with ``extra``: 1 for the documents that ``rest`` tokens of their source go to, else 0.

    ``docs`` is the number of documents of the largest source; it sets how often blocks are parted.
    """
    done, level, size = None, 0, BLOCK_DOCS
    keep = ["key", "source", "tokens", "passes"]
    while True:
        n = F.greatest(F.lit(1), F.least(F.lit(FANOUT), F.floor(F.col("docs") / size))).cast("long")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed + 10 * level)), n))
        blocks = rows.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("size"))
        order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 10 * level + 1)), "block")
        upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        blocks = blocks.withColumn("before", upto - F.col("size")).filter(F.col("before") < F.col("rest"))
        blocks = blocks.select("source", "block", (F.col("before") + F.col("size") <= F.col("rest")).alias("whole"), (F.col("rest") - F.col("before")).alias("left"))
        placed = rows.join(blocks, ["source", "block"], "left")
        settled = placed.filter(F.coalesce("whole", F.lit(True))).select(*keep, F.when(F.col("whole"), 1).otherwise(0).alias("extra"))
        done = settled if done is None else done.unionByName(settled)
        split = placed.filter(~F.coalesce("whole", F.lit(True))).select(*keep, "docs", F.col("left").alias("rest"))
        level, size = level + 1, size * FANOUT
        if docs < 2 * size:
            break
        rows = cut_lineage(split)
    inner = Window.partitionBy("source").orderBy(F.xxhash64("key", F.lit(seed + 2)), "key").rowsBetween(Window.unboundedPreceding, 0)
    return done.unionByName(split.withColumn("extra", (F.sum("tokens").over(inner) <= F.col("rest")).cast("int")).select(*keep, "extra"))


def mix_sources(
    docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, total: float | str | None = None, seed: int = 20, tokenizer: str = TOKENIZER, copies: str = "once"
) -> DataFrame:
    """The chosen documents: ``key``, ``source`` (as in ``targets``), ``tokens``, ``repeats`` (1 or more).

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``; sources are compared without regard to spelling,
    repeated ones count once. Documents with a null or other source, or without a token, are left out. With
    ``copies="once"`` copies of a text, exact or with other white space, count as one document, that of the smallest
    ``key``; with ``"keep"`` each is a document of its own. ``total`` is the wanted size in tokens or ``"there"``, as many
    as the sources have; without it the largest mixture that meets the targets is taken. No document is used more than
    ``max_repeats`` times; a source misses its budget by less than one document. The same seed gives the same choice.
    """
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    counted = docs.select(F.col(key).alias("key"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")).join(goal.select("source"), "source", "left_semi")
    if copies not in ("once", "keep"):
        raise ValueError(f"unknown treatment of copies {copies!r}")
    body = F.regexp_replace(F.regexp_replace("text", r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " ")
    counted = counted.select("key", "source", F.sha2(body, 256).alias("same"), token_counter(tokenizer)("text").alias("tokens")).filter("tokens > 0")
    one = counted.groupBy("same").agg(F.min(F.struct("key", "source", "tokens")).alias("r")).select("r.*") if copies == "once" else counted.drop("same")
    one = cut_lineage(one)
    sums = one.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    # one row for each source of the mixture
    known = {r["source"]: r for r in goal.toLocalIterator()}
    have = {r["source"]: r for r in sums.toLocalIterator()}
    tokens = {s: have[s]["tokens"] if s in have else 0 for s in known}
    size = float(sum(tokens.values())) if total == "there" else total
    weights, _, size = temperature_weights(tokens, {s: r["share"] or 0.0 for s, r in known.items()}, {s: r["cap"] or 1 for s, r in known.items()}, size)
    plan = []
    for s, w in weights.items():
        budget, there = math.floor(w * size + 1e-6), have[s]["tokens"]
        plan.append((s, min(budget // there, known[s]["cap"] or 1), budget % there if budget < there * (known[s]["cap"] or 1) else 0, have[s]["docs"]))
    plans = docs.sparkSession.createDataFrame(plan, T.StructType([T.StructField("source", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("passes", "rest", "docs"))]))
    rows = one.join(F.broadcast(plans), "source")  # a row a source
    chosen = _first_blocks(rows, max((p[3] for p in plan), default=0), seed).withColumn("repeats", (F.col("passes") + F.col("extra")).cast("int")).filter("repeats > 0")
    return chosen.select(F.col("key").alias(key), "source", "tokens", "repeats")


def actual_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``target_share``, ``tokens`` (with repeats), ``share``, ``most_repeats`` for every source of ``targets``."""
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share").groupBy("source").agg(F.max("target_share").alias("target_share"))
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    both = goal.join(used, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0).cast("long")), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
    total = F.sum("tokens").over(Window.partitionBy())  # one row for each source
    return both.select("source", "target_share", "tokens", F.when(total > 0, F.col("tokens") / total).alias("share"), "most_repeats")
