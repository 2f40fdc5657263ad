"""Problem 6: texts cut off by a field limit or in transfer.

For every source a log-normal distribution of text lengths is fitted by maximum likelihood, lengths at a candidate limit
counting as right-censored (EM with the moments of the truncated normal). A candidate limit is a length, or a short
window below one for sources that cut at a word, that holds many more texts than its surroundings and mostly texts
without an end. The posterior that a text of that length was censored is one minus expected over observed; its log-odds
are added to the evidence of the ending itself.

A text that stops without any end is blatant, wherever it stands. What the doubtful endings are worth is learned from the
same rows: how often each stands among the texts at the limits, where most are cut, against those far from any, where
few are. An ending that closes its sentence is no cut wherever it stands; a doubtful one may be a cut at a limit and whole
away from it.

Only a histogram of lengths is gathered for a source, never its rows; the texts are read once and not shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import filled
from ..session import cut_lineage
from .sentences import MAY_END, NEVER_FINAL

# Words of closing lines that stand without a mark, and marks that sources put behind a cut.
CLOSING_WORDS = {"end", "fin", "ende", "fine", "fim", "конец", "完", "終", "终", "おわり", "終わり", "समाप्त", "จบ"}
CUT_MARK = r"(?:\((?:more|continued|cont\.?|truncated|cut|…|\.\.\.)\)|\[(?:more|continued|cont\.?|truncated|cut|…|\.\.\.)\]|<(?:truncated|more|cut)>)\s*$"

_TAIL = re.compile(r"(?:\s|\[\[beat\]\]|(?:(?<=\n)|\A)[^\S\n]*(?:-{3,}|\*{3,})[^\S\n]*(?=\n|\Z))+\Z")
_ENDED = re.compile(r"[.!?。！？｡।॥؟۔።‽]+[\s]?[\"”“’»)\]）」』》*_']*\Z")
_DOTS = re.compile(r"(?:\.\.\.+|…+)[\"”“’»)\]）」』》*_']*\Z")
_MARKUP = re.compile(r"(?:</?[A-Za-z][^>]*>|\$\$|```|\|)\s*\Z")
_THAI = re.compile(r"[฀-๿]")
_ADDRESS = re.compile(r"(?:https?://)?[\w-]+(?:\.[\w-]+)+(?:/\S*)?\Z")

#: Blatant endings, and the log-likelihood ratio of "cut" against "whole" that each is worth.
BLATANT = {"marked_cut": 9.0, "no_end": 5.0, "dots": 4.5, "thai_odd": 4.5}
#: Doubtful endings, and the ratio expected of each before the rows are seen; it counts as :data:`PSEUDO` observations.
DOUBTFUL = {"open_quote": 2.0, "doubtful_stop": -1.5, "bare_quote": -4.0, "thai": -1.0}
PSEUDO = 4.0
#: Least posterior of a length at a candidate limit, and the prior away from any.
BASE = 0.02

ENDING = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "tail", "suffix")])


def source_name(col: Column) -> Column:
    """A source's name without regard to case, white space and joiners; null and blank stay null."""
    name = F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)\A[\s_\-]+|[\s_\-]+\z", "")), r"(?U)[\s_\-]+", "-")
    return F.when(name != "", name)


_BLANK = re.compile(r"\n[^\S\n]*(?=\n)")


def last_paragraph(text: str) -> str:
    """What follows the last blank line."""
    at = len(text)
    while (at := text.rfind("\n", 0, at)) >= 0:
        if (m := _BLANK.match(text, at)) is not None:
            return text[m.end() + 1 :].strip()
    return text.strip()


def ending(text: str) -> tuple[str, str, str]:
    """(kind, tail, suffix) of a text's ending: one of :data:`BLATANT` or :data:`DOUBTFUL`, or closing or ended; the last paragraph or sentence, whole, where it may recur; its last letters if Thai."""
    t = _TAIL.sub("", text)
    if not t:
        return "ended", "", ""
    para = last_paragraph(t)
    line = para.split("\n")[-1].strip()
    if re.search(CUT_MARK, t[t.rfind("\n") + 1 :], re.I):
        return "marked_cut", "", ""
    if _MARKUP.search(line):
        return "closing", "", ""
    if _DOTS.search(line):
        return "dots", re.split(r"(?<=[.!?])[\"”’»)]*\s+", line)[-1], ""
    if _ENDED.search(line):
        low_quotes = "„" in para
        quotes = (
            para.count('"') % 2
            or low_quotes and para.count("„") > para.count("“") + para.count("”")
            or not low_quotes and para.count("“") > para.count("”")
            or para.count("«") > para.count("»")
            or para.count("「") > para.count("」")
            or para.count("(") > para.count(")")
        )
        if quotes:
            return "open_quote", "", ""
        m = re.search(r"([^\s(]+)\.\Z", line)
        if m:
            token = m[1].lower()
            if token in NEVER_FINAL and token not in MAY_END or re.fullmatch(r"\d{1,3}|[vV]?\d+(\.\d+)*|[^\W\d_]", m[1]):
                return "doubtful_stop", "", ""
        if re.search(r"[!?]\s?[\"”“»]\Z", line):
            return "bare_quote", "", ""
        return "ended", "", ""
    words = re.findall(r"\w+", para.lower())
    if len(para) <= 60 and (_ADDRESS.search(para) or (len(words) <= 5 and (words[:1] and words[-1] in CLOSING_WORDS or words[0] in CLOSING_WORDS or "".join(words) in CLOSING_WORDS or len(words) > 1 and words[0] == "the" and words[-1] == "end"))):
        return "closing", "", ""
    if _THAI.search(t[-6:]):
        return "thai", "", t[-6:]
    return "no_end", para, ""


#: Kind of the rows that count the last letters of Thai clauses.
_SEEN = "#seen"


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ending of every text, and the last letters of the Thai clauses inside the texts with their number in the batch."""
    for pdf in batches:
        got = [ending(t) if isinstance(t, str) else (None, "", "") for t in pdf["text"]]
        out = pdf.drop(columns=["text"])
        out["n"] = [len(t) if isinstance(t, str) else 0 for t in pdf["text"]]
        # the tail is only compared, so that a digest of it does
        out["kind"] = [k for k, _, _ in got]
        out["tail"] = [hashlib.blake2b(x.encode(), digest_size=16).hexdigest() if x else "" for _, x, _ in got]
        out["suffix"] = [x for _, _, x in got]
        yield out
        seen: dict[str, int] = {}
        for t in pdf["text"]:
            if isinstance(t, str) and _THAI.search(t):
                for m in re.finditer(r"[ก-๎]{6}(?=\s+[ก-ฮเ-ไ]{8}|\s*\n)", t[: len(t.rstrip())]):
                    seen[m[0]] = seen.get(m[0], 0) + 1
        if seen:
            rows = {c: [None] * len(seen) for c in out.columns} | {"n": list(seen.values()), "kind": [_SEEN] * len(seen), "suffix": list(seen)}
            yield pd.DataFrame(rows)


def fit_censored(log_len: np.ndarray, weight: np.ndarray, censored_at: np.ndarray, censored_weight: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of a normal by maximum likelihood from exact values and right-censored ones (EM)."""
    total = weight.sum() + censored_weight.sum()
    values = np.concatenate([log_len, censored_at])
    w = np.concatenate([weight, censored_weight])
    if total <= 0:
        return 0.0, 1.0
    mu = float((values * w).sum() / total)
    sigma = max(0.05, math.sqrt(float((w * (values - mu) ** 2).sum() / total)))
    for _ in range(60):
        a = (censored_at - mu) / sigma
        phi = np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi)
        tail = np.maximum(0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in a]), 1e-12)
        hazard = phi / tail
        first = mu + sigma * hazard
        second = mu * mu + sigma * sigma + sigma * (censored_at + mu) * hazard
        m = float(((log_len * weight).sum() + (first * censored_weight).sum()) / total)
        s = math.sqrt(max(2.5e-3, float(((log_len**2 * weight).sum() + (second * censored_weight).sum()) / total - m * m)))
        if abs(m - mu) + abs(s - sigma) < 1e-6:
            return m, s
        mu, sigma = m, s
    return mu, sigma


WINDOW = 16


def limits_of(hist: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source from its histogram (``n``, ``rows``, ``unended``): ``n``, ``posterior`` for each length at one."""
    empty = pd.DataFrame({"n": pd.Series(dtype="int64"), "posterior": pd.Series(dtype="float64")})
    hist = hist[hist["n"] > 0].sort_values("n")
    if hist.empty:
        return empty
    n, rows, un = hist["n"].to_numpy(np.int64), hist["rows"].to_numpy(float), hist["unended"].to_numpy(float)
    c_rows, c_un = np.concatenate([[0], np.cumsum(rows)]), np.concatenate([[0], np.cumsum(un)])

    def within(lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
        return c[np.searchsorted(n, hi, "right")] - c[np.searchsorted(n, lo, "left")]

    at = np.zeros(len(n), bool)
    for width in (1, WINDOW):
        here, lost = within(n - width + 1, n, c_rows), within(n - width + 1, n, c_un)
        around = within(n - 160, n + 144, c_rows) - here
        spike = (here >= 4) & (lost >= 0.5 * here) & (here > 6 * around * width / (305 - width) + 2)
        for i in np.flatnonzero(spike):
            at |= (n > n[i] - width) & (n <= n[i])
    mu, sigma = fit_censored(np.log(n), rows - np.where(at, un, 0), np.log(n[at]), un[at])
    if not at.any():
        return empty
    x = n[at].astype(float)
    density = np.exp(-0.5 * ((np.log(x) - mu) / sigma) ** 2) / (x * sigma * math.sqrt(2 * math.pi))
    # observed mass is smoothed over the window, so that a window's lone lengths are not each taken for chance
    observed = np.maximum(within(n[at] - WINDOW + 1, n[at] + WINDOW - 1, c_rows) / (2 * WINDOW - 1), rows[at])
    return pd.DataFrame({"n": n[at], "posterior": np.clip(1 - rows.sum() * density / observed, BASE, 0.995)})


def _limits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    got = limits_of(pdf)
    if got.empty:
        return pd.DataFrame()
    return pd.DataFrame({"source": pd.Series([key[0]] * len(got), dtype=object), "n": got["n"].to_numpy(), "posterior": got["posterior"].to_numpy()})


def learn_endings(table: list[tuple[float | None, str, int]]) -> dict[str, float]:
    """The log-likelihood ratio of each doubtful ending from (posterior of the length, None away from any limit; kind; rows).

    A row at a limit counts as cut with its posterior and as whole with the rest; a row away from any counts as whole
    unless its ending is blatant.
    """
    cut, whole = dict.fromkeys(DOUBTFUL, 0.0), dict.fromkeys(DOUBTFUL, 0.0)
    all_cut = all_whole = 1.0
    for p, kind, n in table:
        p = float(kind in BLATANT) if p is None else p
        all_cut += p * n
        all_whole += (1 - p) * n
        if kind in DOUBTFUL:
            cut[kind] += p * n
            whole[kind] += (1 - p) * n
    # as many observations as expected: their number among all cut and all whole texts stands in the expected ratio
    out = {}
    for kind, expected in DOUBTFUL.items():
        rate = PSEUDO / max(all_cut, all_whole)
        a, b = rate * min(1.0, math.exp(expected)), rate * min(1.0, math.exp(-expected))
        out[kind] = math.log((cut[kind] / all_cut + a) / (whole[kind] / all_whole + b))
    return out


def judge_cuts(df: DataFrame, key: str, source: str, text: str, state: str, place: list[str]) -> DataFrame:
    """``key``, ``source`` (normalised), ``n`` (code points), ``posterior``, ``score``, ``cut`` for every row of ``df``.

    ``posterior`` is that of the length alone, null away from any limit; ``score`` is null where the ending closes its
    sentence. ``state`` names a column that is ``open`` where the record itself breaks off; such a row is cut. A row with
    null text that is not open is not cut. ``place`` names the columns that tell the places apart at which one closing
    line may recur (a re-sent row counts once). A null source is a source of its own. Repeated rows are judged alike.
    """
    base = df.select(F.col(key).alias("key"), source_name(F.col(source)).alias("source"), F.col(state).alias("state"), F.xxhash64(*place).alias("place"), F.col(text).alias("text"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in base.schema.fields if f.name != "text"), T.StructField("n", T.LongType()), *ENDING.fields])
    # used for the limits, the recurring tails, the Thai clauses and the result: the texts are read once
    read = cut_lineage(base.mapInPandas(filled(_endings), schema))
    ends, thai = read.filter(~F.col("kind").eqNullSafe(_SEEN)), read.filter(F.col("kind") == _SEEN).groupBy("suffix").agg(F.sum("n").alias("seen"))
    lost = F.col("kind").isin("no_end", "marked_cut", "dots").cast("long")
    hist = ends.filter(F.col("kind").isNotNull()).groupBy("source", "n").agg(F.count(F.lit(1)).alias("rows"), F.sum(lost).alias("unended"))
    out = T.StructType([T.StructField("source", T.StringType()), T.StructField("n", T.LongType()), T.StructField("posterior", T.DoubleType())])
    limits = hist.groupBy("source").applyInPandas(_limits, out)
    rows = ends.join(limits.withColumnRenamed("source", "s2").withColumnRenamed("n", "n2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("n") == F.col("n2")), "left").drop("s2", "n2")
    # an unmarked or dotted ending that recurs at other places, mostly away from any limit, is one by nature
    tails = (
        rows.filter(F.col("kind").isin("no_end", "dots") & (F.col("tail") != ""))
        .groupBy("kind", "tail", "place").agg(F.min(F.coalesce("posterior", F.lit(0.0))).alias("posterior"))
        .groupBy("kind", "tail").agg(F.count(F.lit(1)).alias("places"), F.avg("posterior").alias("mean"))
        .filter((F.col("places") >= 2) & (F.col("mean") < 0.3)).select("kind", "tail", F.lit(True).alias("natural"))
    )
    # rows that ask for nothing get a key of their own, so that they don't meet in one task
    alone = F.concat(F.lit("#"), F.col("key").cast("string"))
    rows = rows.withColumns({"tail": F.when(F.col("kind").isin("no_end", "dots"), F.col("tail")).otherwise(alone), "suffix": F.when(F.col("kind") == "thai", F.col("suffix")).otherwise(alone)})
    rows = rows.join(tails, ["kind", "tail"], "left").join(thai, "suffix", "left")
    kind = F.when(F.col("natural"), "closing").when((F.col("kind") == "thai") & (F.coalesce("seen", F.lit(0)) < 2), "thai_odd").otherwise(F.col("kind"))
    rows = cut_lineage(rows.select("key", "source", "state", "n", "posterior", kind.alias("kind")))
    # at most a hundred posteriors of ten kinds
    table = rows.filter(F.col("kind").isNotNull()).groupBy(F.round("posterior", 2).alias("p"), "kind").agg(F.count(F.lit(1)).alias("rows"))
    worth = BLATANT | learn_endings([(r["p"], r["kind"], r["rows"]) for r in table.toLocalIterator()])
    prior = F.coalesce("posterior", F.lit(BASE))
    score = F.log(prior / (1 - prior)) + F.coalesce(*(F.when(F.col("kind") == k, F.lit(w)) for k, w in worth.items()))
    cut = (F.col("state") == "open") | (score > 0)
    return rows.select(F.col("key").alias(key), "source", "n", "posterior", score.alias("score"), F.coalesce(cut, F.lit(False)).alias("cut"))
