"""Problem 2: repairing text that was recognised from scanned pages.

Lines: a classifier over pairs of neighbouring lines tells running heads from text; page numbers have a form of their
own. Joins: another classifier decides for the end of a line and the next line of text whether a broken word goes on,
and whether its hyphen stays. Letters: words that the corpus does not trust fetch candidates through an inverted join on
character q-grams, each on its rarest ones only, as many as cannot all be missing, and gradient-boosted trees rank the
candidates by what all rows tell of the edits between them.

All three models are trained here, on bounded samples (:data:`SAMPLE_ROWS`, :data:`SAMPLE_WORDS`, :data:`SAMPLE_EDITS`)
that label themselves: lines that equal a title, words broken on purpose, words misread on purpose by edits seen in the
corpus. Word counts, edit counts, candidates and decisions cover all rows. Words are joined by shuffle and on distinct
words only; what is brought to the driver is the samples.
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import filled
from ..session import cut_lineage
from .gbm import Boosted
from .joins import beside

SAMPLE_ROWS, SAMPLE_WORDS, SAMPLE_EDITS = 600, 6000, 400
#: Letters from which on a word is examined for misreading; shorter ones are alike by chance.
LEAST_LETTERS = 3
#: Share of a row's lines that stop within a sentence from which on it counts as scanned, and their least number.
WRAPPED_SHARE, WRAPPED_LEAST = 0.25, 2
#: How many times as common as the suspect a candidate must be, unless clean text is silent about the suspect.
RATIO = 20

# Fixed values
HYPHENS = "-‐‑¬\xad"
ALWAYS_SOFT = "¬\xad"
CONJUNCTIONS = {"and", "or", "to", "nor", "und", "oder", "bis", "bzw", "sowie", "et", "ou", "y", "e", "o", "u", "и", "или"}
_TERMINAL = re.compile(r"[.!?:;…。！？।»”\"“’)\]」』]+\Z")
#: Scripts that end sentences without a mark.
_UNMARKED = re.compile(r"[฀-๿຀-໿ក-៿]{4}")
_TAG = re.compile(r"<[/!?]?[A-Za-z][^>]*>")
#: Signs without width, which would part a word; at a line's end a soft hyphen means something.
_HIDDEN = re.compile(r"[\u200b-\u200f\u2060-\u2064\ufeff]|\xad(?!\Z)")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_PAGE = re.compile(
    r"[\[({|<~*·•—–\-\s.]*(?:(?:page|pg\.?|p\.|seite|s\.|página|pág\.?|pagina|стр\.?|страница|blatt|folio|f\.|第)\s*)?(\d{1,5}|[ivxlcdm]{1,9})(?:\s*(?:of|von|de|sur|di|из|/)\s*(?:\d{1,5}))?\s*(?:頁|页|ページ)?[\])}|>~*·•—–\-\s]*",
    re.I,
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_LOOKS = str.maketrans("015689", "olsbbg")


class Line:
    __slots__ = ("no", "text", "raw", "kind")

    def __init__(self, no: int, text: str, raw: str, kind: str) -> None:
        self.no, self.text, self.raw, self.kind = no, text, raw, kind


def lines_of(markup: str) -> list[Line]:
    """The lines of ``markup`` from 1 on; ``kind`` is text, blank, skip (table, code, formula) or heading."""
    out, inside = [], ""
    for no, raw in enumerate(markup.split("\n"), 1):
        low = raw.lower()
        kind = "text"
        if inside or re.search(r"<(?:table|pre|code|script|style)\b", low):
            kind = "skip"
            m = re.findall(r"<(/?)(table|pre|code|script|style)\b", low)
            for slash, tag in m:
                if not slash and not inside:
                    inside = tag
                elif slash and tag == inside:
                    inside = ""
        elif re.search(r"<h[1-6]\b", low):
            kind = "heading"
        elif 'class="math"' in low or "<math" in low:
            kind = "skip"
        text = _HIDDEN.sub("", htmllib.unescape(_TAG.sub("", raw)).strip(" \t\r\n\xa0"))
        out.append(Line(no, text, raw, kind if text or kind != "text" else "blank"))
    return out


def is_scanned(lines: list[Line]) -> bool:
    """Whether the lines are those of a page: many of them stop within a sentence."""
    text = [x for x in lines if x.kind == "text"]
    # where sentences end without a mark, a line that leaves its element open tells
    wrapped = sum("</" not in x.raw and any("</" in y.raw for y in lines) if _UNMARKED.search(x.text) else not _TERMINAL.search(x.text) for x in text)
    return wrapped >= WRAPPED_LEAST and wrapped >= WRAPPED_SHARE * len(text)


def is_page_number(text: str) -> bool:
    m = _PAGE.fullmatch(text)
    if not m or text.rstrip().endswith("."):
        return False
    return m[1].isdigit() or bool(_ROMAN.fullmatch(m[1]))


def _folded(text: str) -> str:
    """The letters of ``text``, digits read as the letters they look like; a number at either end is a page's."""
    text = re.sub(r"\A\W*\d+\s+|\s+\d+\W*\Z", "", text)
    return "".join(c for c in text.lower().translate(_LOOKS) if c.isalpha())


def _grams(s: str) -> set[str]:
    s = f"##{s}##"
    return {s[i : i + 3] for i in range(len(s) - 2)} if len(s) > 4 else set()


LINE_FEATURES = 14


def line_features(lines: list[Line], titles: list[str]) -> tuple[list[int], np.ndarray]:
    """Indexes of the lines that might be running heads, and the features of each with its neighbours."""
    text = [i for i, x in enumerate(lines) if x.kind == "text"]
    if not text:
        return [], np.zeros((0, LINE_FEATURES))
    median = float(np.median([len(lines[i].text) for i in text])) or 1.0
    names = [(_grams(t), len(t)) for t in (_folded(t) for t in titles if t) if len(t) > 4]
    keys = Counter(_folded(lines[i].text) for i in text)
    at, rows = [], []
    for n, i in enumerate(text):
        s = lines[i].text
        letters = _folded(s)
        if len(letters) < 3:
            continue
        own = _grams(letters)
        cover, back, more = max(((len(own & g) / len(g), len(own & g) / max(1, len(own)), len(letters) - n) for g, n in names), default=(0.0, 0.0, 0))
        before = next((lines[j].text for j in reversed(text[:n]) if not is_page_number(lines[j].text)), "")
        after = next((lines[j].text for j in text[n + 1 :] if not is_page_number(lines[j].text)), "")
        caps = [c for c in s if c.isalpha()]
        words = s.split()
        at.append(i)
        rows.append([
            cover, back, sum(c.isupper() for c in caps) / max(1, len(caps)), sum(w[:1].isupper() or not w[:1].isalpha() for w in words) / len(words),
            bool(_TERMINAL.search(s)), s[:1].isdigit() or s[-1:].isdigit(), not _TERMINAL.search(before), after[:1].islower(), len(s) / median, min(3, keys[letters]),
            "<p" in lines[i].raw and "</p>" in lines[i].raw, more, bool(re.search(r"[.!?;]\s", s)), s[:1].islower(),
        ])
    return at, np.array(rows, float).reshape(len(rows), LINE_FEATURES)


def _misread(rng: random.Random, s: str) -> str:
    i = rng.randrange(len(s))
    return s[:i] + rng.choice("abcdeilnorstu0158") + s[i + 1 :]


def train_lines(sample: list[tuple[str, str, str]]) -> Boosted | None:
    """The model for running heads, from (markup, chapter title, book title) rows that label themselves.

    Certain heads are lines that spell a title; certain text are lines that end a sentence or share little with one.
    Heads are also learned in worse states: with letters misread and with words put before them.
    """
    rng, xs, ys = random.Random(5), [], []
    for markup, *titles in sample:
        lines = lines_of(markup)
        if not is_scanned(lines):
            continue
        at, x = line_features(lines, titles)
        for i, f in zip(at, x):
            spelled = f[0] > 0.999 and f[1] > 0.999
            if spelled:
                xs.append(f)
                ys.append(1)
                for how in range(4):
                    kept = lines[i].text
                    worse = _misread(rng, kept) if how != 1 else kept
                    if how % 2:
                        worse = f"{rng.choice(('Draft of', 'Review copy,', 'Part one'))} {worse}"
                    lines[i].text = worse
                    got, again = line_features(lines, titles)
                    lines[i].text = kept
                    if i in got:
                        xs.append(again[got.index(i)])
                        ys.append(1)
                # text that happens to have a title's words in it
                kept, near = lines[i].text, next((lines[j].text.split() for j in at if j > i + 1 and len(lines[j].text.split()) > 5), ["and", "so", "on"])
                title = max(titles, key=len).strip()
                if title:
                    for mark in (".", ","):
                        lines[i].text = f"{title[:1].lower()}{title[1:]}{mark} {' '.join(near[:3])}"
                        got, again = line_features(lines, titles)
                        lines[i].text = kept
                        if i in got:
                            xs.append(again[got.index(i)])
                            ys.append(0)
            elif f[4] or max(f[0], f[1]) < 0.5 or f[1] < 0.4 or f[11] > 20:
                xs.append(f)
                ys.append(0)
    if sum(ys) < 5 or len(ys) - sum(ys) < 5:
        return None
    return Boosted(rounds=40).fit(np.array(xs), np.array(ys, float))


class Page:
    """One scanned row taken apart: its furniture, its broken words and the words of its lines."""

    def __init__(self, markup: str, titles: list[str], model: Boosted | None) -> None:
        self.lines = lines_of(markup)
        self.scanned = is_scanned(self.lines)
        self.furniture: dict[int, str] = {}
        self.breaks: list[tuple[int, str, str, str, int]] = []  # (line, left, right, hyphen, line of right)
        self.words: list[tuple[int, str]] = []
        if not self.scanned:
            return
        text = [i for i, x in enumerate(self.lines) if x.kind == "text"]
        for i in text:
            if is_page_number(self.lines[i].text):
                self.furniture[i] = "page_number"
        at, x = line_features(self.lines, titles)
        if model is not None and at:
            for i, p in zip(at, model.score(x)):
                # a line that ends a sentence is text, unless it spells a title with its own mark
                ends = bool(_TERMINAL.search(self.lines[i].text))
                if p > 0.5 and i not in self.furniture and not (ends and min(x[at.index(i)][:2]) < 0.9):
                    self.furniture[i] = "header"
        flow = [i for i in text if i not in self.furniture]
        skip_first: dict[int, bool] = {}
        for n, i in enumerate(flow):
            s = self.lines[i].text
            words = list(_WORD.finditer(s))
            broken = n + 1 < len(flow) and s[-1:] in HYPHENS and len(s) > 1 and s[-2].isalnum()
            if broken:
                left = re.search(r"[^\W_]+(?:[\-‐‑’'][^\W_]+)*\Z", s[:-1])
                right = re.match(r"[^\W_]+(?:[\-‐‑’'][^\W_]+)*", self.lines[flow[n + 1]].text)
                if left and right and _LETTER.search(left[0]) and _LETTER.search(right[0]):
                    self.breaks.append((i, left[0], right[0], s[-1], flow[n + 1]))
                    words = [w for w in words if w.start() < left.start()]
                    skip_first[flow[n + 1]] = True
            for k, w in enumerate(words):
                if not (skip_first.get(i) and not s[: w.start()].strip()):
                    self.words.append((i, w[0].lower()))


# ---- words of the corpus


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words in small letters with their counts in clean rows and in scanned ones; hyphenated words count whole too."""
    for pdf in batches:
        clean, scanned = Counter(), Counter()
        for markup in pdf["html"]:
            lines = lines_of(markup)
            into = scanned if is_scanned(lines) else clean
            for x in lines:
                if x.kind in ("text", "heading"):
                    s = x.text.lower()
                    if s[-1:] in HYPHENS:
                        s = re.sub(r"\S+\Z", "", s)
                    for m in re.finditer(r"[^\W_]+(?:[\-‐‑’'][^\W_]+)*", s):
                        w = m[0].replace("‐", "-").replace("‑", "-")
                        into[w] += 1
                        if "-" in w:
                            into.update(w.split("-"))
        words = sorted(set(clean) | set(scanned))
        yield pd.DataFrame({"word": words, "clean": pd.Series([clean[w] for w in words], dtype="int64"), "scanned": pd.Series([scanned[w] for w in words], dtype="int64")})


def _string(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def count_words(rows: DataFrame) -> DataFrame:
    """``word``, ``clean``, ``scanned`` over all rows (column ``html``)."""
    schema = T.StructType([*_string("word"), T.StructField("clean", T.LongType()), T.StructField("scanned", T.LongType())])
    return rows.select("html").mapInPandas(filled(_count_words), schema).groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"))


# ---- broken words

_JOIN_FEATURES = 10


def join_features(left: str, right: str, mark: str, counts: Callable[[str], float]) -> list[float]:
    """Features of one broken word: what the corpus knows of its forms and its parts."""
    last, first = left.split("-")[-1], right.split("-")[0]
    joined, kept = counts(left + right), counts(f"{left}-{right}")
    return [math.log1p(joined), math.log1p(kept), math.log1p(kept) - math.log1p(joined), math.log1p(counts(last)), math.log1p(counts(first)), math.log1p(counts(last + first)), first in CONJUNCTIONS, mark in ALWAYS_SOFT, len(last), len(first)]


def train_joins(words: dict[str, float]) -> tuple[Boosted, Boosted] | None:
    """(does the word go on, does its hyphen stay) from words of the corpus broken on purpose."""
    rng = random.Random(7)
    known = sorted(words)
    plain = [w for w in known if w.isalpha() and len(w) >= 4]
    compound = [w for w in known if re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)+", w)]
    if len(plain) < 40 or len(compound) < 3:
        return None
    on, stay = [], []

    def count(w: str) -> float:
        return words.get(w, 0.0)

    for w in plain:
        k = rng.randrange(2, len(w) - 1)
        f = join_features(w[:k], w[k:], rng.choice(HYPHENS), count)
        on.append((f, 1))
        stay.append((f, 0))
    for w in compound * max(1, min(40, len(plain) // (4 * len(compound)))):
        cuts = [m.start() for m in re.finditer("-", w)]
        c = rng.choice(cuts)
        f = join_features(w[:c], w[c + 1 :], rng.choice("-‐"), count)
        on.append((f, 1))
        stay.append((f, 1))
        part = rng.choice([p for p in w.split("-")])
        if len(part) >= 4:  # a compound may also break inside a part
            k = rng.randrange(2, len(part) - 1)
            at = w.index(part) + k
            f = join_features(w[:at], w[at:], rng.choice(HYPHENS), count)
            on.append((f, 1))
            stay.append((f, 0))
    for w in rng.sample(plain, len(plain) // 2):
        # members left open, and words that merely stand beside a dash
        conj = rng.choice([c for c in sorted(CONJUNCTIONS)])
        on.append((join_features(w, conj, rng.choice("-‐"), count), 0))
        if compound:
            on.append((join_features(rng.choice(compound).split("-")[0], conj, "-", count), 0))
        on.append((join_features(w, rng.choice(plain), "-", count), 0))
    fit = lambda rows: Boosted(rounds=50).fit(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float))
    return fit(on), fit(stay)


# ---- misread letters


def edit_of(bad: str, good: str) -> tuple[str, str]:
    """What differs between two words, their common ends left off."""
    i = 0
    while i < min(len(bad), len(good)) and bad[i] == good[i]:
        i += 1
    j = 0
    while j < min(len(bad), len(good)) - i and bad[len(bad) - 1 - j] == good[len(good) - 1 - j]:
        j += 1
    return bad[i : len(bad) - j], good[i : len(good) - j]


def edits_of(bad: str, good: str) -> tuple[str, list[tuple[str, str]]]:
    """The edit that turns ``good`` into ``bad``, and all ways to see it as two, each as ``bad>good``."""
    a, b = edit_of(bad, good)
    whole = f"{a}>{b}"
    if len(a) <= 1 and len(b) <= 1:
        return whole, []
    m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    if m.size:
        ways = [((a[: m.a], b[: m.b]), (a[m.a + m.size :], b[m.b + m.size :]))]
    else:
        ways = [((a[:i], b[:j]), (a[i:], b[j:])) for i in range(len(a) + 1) for j in range(len(b) + 1)]
    return whole, [(f"{x[0]}>{x[1]}", f"{y[0]}>{y[1]}") for x, y in ways if any(x) and any(y)]


def rank_features(bad: str, good: str, shared: int, n_bad: float, n_good: float, d: int, once: float, twice: float) -> list[float]:
    """``once`` and ``twice``: how often the corpus has the edit, and the rarer one of the best two edits it may be made of."""
    a, b = edit_of(bad, good)
    grams = len(bad) + len(good) + 4 - shared
    return [d, len(a), len(b), math.log1p(once or twice), 1 if once else 2, shared / max(1, grams), math.log1p(n_good), math.log1p(n_good) - math.log1p(n_bad), any(c.isdigit() for c in bad), len(good)]


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


Candidate = tuple[str, str, int, float, float]


def misread_on_purpose(words: dict[str, float], edits: dict[tuple[str, str], float]) -> list[tuple[Candidate, bool]]:
    """Candidates (bad, good, shared grams, counts of both) with whether they are right: words of the sample misread by
    ``edits``, and words left as they are."""
    rng = random.Random(11)
    plain = sorted(w for w in words if w.isalpha() and len(w) >= LEAST_LETTERS)
    if len(plain) < 60 or len(edits) < 3:
        return []
    index: dict[str, list[str]] = {}
    for w in plain:
        for g in _grams(w):
            index.setdefault(g, []).append(w)
    kinds, weights = zip(*sorted(edits.items()))
    out: list[tuple[Candidate, bool]] = []

    def near(w: str) -> list[tuple[str, int]]:
        got = Counter(v for g in _grams(w) for v in index.get(g, ()))
        return [(v, n) for v, n in got.most_common(12) if v != w and abs(len(v) - len(w)) <= 2]

    for w in rng.sample(plain, min(len(plain), 2500)):
        choice = [(k, p) for k, p in zip(kinds, weights) if k[1] and k[1] in w]
        if choice:
            bad = w
            for _ in range(1 + (rng.random() < 0.1)):
                (x, y), _ = rng.choices(choice, [p for _, p in choice])[0]
                spots = [m.start() for m in re.finditer(re.escape(y), bad)]
                if spots:
                    at = rng.choice(spots)
                    bad = bad[:at] + x + bad[at + len(y) :]
            if bad != w and bad not in words:
                out += [((bad, v, n, rng.choice((1, 1, 1, 2, 4)), words[v]), v == w) for v, n in near(bad)]
        out += [((w, v, n, rng.choice((1, 1, 2, 3)), words[v]), False) for v, n in near(w)[:4]]  # a rare word of its own
    return out


def train_ranker(made: list[tuple[Candidate, bool]], counts: dict[str, float]) -> Boosted | None:
    """The ranking model, from candidates made on purpose and the ``counts`` of the edits between them."""
    if sum(right for _, right in made) < 20:
        return None
    xs, ys = [], []
    for (bad, good, shared, n_bad, n_good), right in made:
        whole, ways = edits_of(bad, good)
        twice = max((min(counts.get(x, 0.0), counts.get(y, 0.0)) for x, y in ways), default=0.0)
        xs.append(rank_features(bad, good, shared, n_bad, n_good, _levenshtein(bad, good), counts.get(whole, 0.0), twice))
        ys.append(right)
    return Boosted(rounds=80, depth=4).fit(np.array(xs, float), np.array(ys, float))


def _ranked(model: Boosted | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = np.zeros(len(pdf))
            if model is not None and len(pdf):
                x = np.array([rank_features(*r) for r in zip(*(pdf[c] for c in ("bad", "good", "shared", "n_bad", "n_good", "d", "once", "twice")))], float)
                score = model.score(x)
            yield pdf[["bad", "good"]].assign(score=score)

    return run


def _with_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [edits_of(a, b) for a, b in zip(pdf["bad"], pdf["good"])]
        yield pdf.assign(whole=[w for w, _ in got], ways=[[list(x) for x in ways] for _, ways in got])


GRAM = 3


def _grams_column(word: str) -> Column:
    """The distinct padded trigrams of ``word``."""
    padded = F.concat(F.lit("##"), F.translate(F.col(word), "015689", "olsbbg"), F.lit("##"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(GRAM))))


def candidates(suspects: DataFrame, counts: DataFrame) -> DataFrame:
    """``bad``, ``good``, ``n_bad``, ``n_good``, ``d``, ``shared``: the words that each suspect may stand for.

    Candidates share at least a third of the suspect's trigrams, differ in length by two at most, and by three letters at
    most. A suspect of G distinct trigrams that must share T of them shares one of any G - T + 1, so that it is looked up
    by its rarest ones.
    """
    good = counts.filter(F.length("good") >= LEAST_LETTERS).select("good", "n", F.length("good").alias("g_size"), F.explode(_grams_column("good")).alias("gram"))
    common = good.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    bad = suspects.filter(F.length("bad") >= LEAST_LETTERS).select("bad", "n_bad", F.explode(_grams_column("bad")).alias("gram"))
    rare = beside(bad, common, ["gram"], ["bad"]).groupBy("bad").agg(F.first("n_bad").alias("n_bad"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("gs"))
    must = F.ceil((F.length("bad") + 2) / 3).cast("int")
    rare = rare.select("bad", "n_bad", F.explode(F.slice("gs", 1, F.greatest(F.lit(0), F.size("gs") - must + 1))).alias("g")).filter("g.df > 0")
    # keyed on the gram and the length, so that a common gram is spread over the lengths
    size = F.length("bad")
    near = rare.select("bad", "n_bad", F.col("g.gram").alias("gram"), F.explode(F.sequence(F.greatest(F.lit(LEAST_LETTERS), size - 2), size + 2)).alias("g_size"))
    pairs = near.join(good, ["gram", "g_size"]).withColumn("d", F.levenshtein("bad", "good")).filter("d <= 3")
    pairs = pairs.groupBy("bad", "good").agg(F.first("n_bad").alias("n_bad"), F.first("n").alias("n_good"), F.first("d").cast("int").alias("d"))
    return pairs.withColumn("shared", F.size(F.array_intersect(_grams_column("bad"), _grams_column("good")))).filter(F.col("shared") >= must)


def correct_words(suspects: DataFrame, counts: DataFrame, words: dict[str, float]) -> DataFrame:
    """``bad``, ``good``, ``score``: the best correction of each suspect that the ranking accepts; see :func:`candidates`.

    ``suspects`` has ``bad`` and ``n_bad``; ``counts`` are the trusted words with their ``n``, ``words`` a sample of them.
    """
    spark = suspects.sparkSession
    pairs = candidates(suspects, counts)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in pairs.schema.fields), *_string("whole"), T.StructField("ways", T.ArrayType(T.ArrayType(T.StringType())))])
    pairs = cut_lineage(pairs.mapInPandas(filled(_with_edits), schema))
    # edits: what differs where a suspect has a single closest candidate
    close = pairs.filter("d <= 2").groupBy("bad").agg(F.min("d").alias("d"))
    close = pairs.join(close, ["bad", "d"]).groupBy("bad").agg(F.count(F.lit(1)).alias("k"), F.max("whole").alias("edit")).filter("k = 1")
    edits = cut_lineage(close.groupBy("edit").agg(F.count(F.lit(1)).cast("double").alias("n")))
    # the model learns from the commonest short ones, and from what all rows tell of the edits it meets
    short = edits.filter((F.length("edit") <= 5) & F.col("edit").rlike(r"^.{0,2}>.{0,2}$") & (F.col("n") >= 2)).orderBy(F.desc("n"), "edit").limit(SAMPLE_EDITS)
    made = misread_on_purpose(words, {tuple(r["edit"].split(">")): r["n"] for r in short.toLocalIterator()})
    met = sorted({e for (b, g, *_), _ in made for whole, ways in [edits_of(b, g)] for e in (whole, *(x for way in ways for x in way))})
    told = spark.createDataFrame([(e,) for e in met], "edit string").join(edits, "edit")
    model = train_ranker(made, {r["edit"]: r["n"] for r in told.toLocalIterator()})
    # the edits of every pair, whole and in two, meet the counts
    asked = pairs.select("bad", "good", F.explode(F.concat(F.array(F.array("whole")), "ways")).alias("way")).select("bad", "good", F.xxhash64("way").alias("h"), F.size("way").alias("parts"), F.explode("way").alias("edit"))
    seen = beside(asked, edits, ["edit"], ["bad", "good"]).groupBy("bad", "good", "h", "parts").agg(F.min(F.coalesce("n", F.lit(0.0))).alias("n"))
    weight = seen.groupBy("bad", "good").agg(F.coalesce(F.max(F.when(F.col("parts") == 1, F.col("n"))), F.lit(0.0)).alias("once"), F.coalesce(F.max(F.when(F.col("parts") == 2, F.col("n"))), F.lit(0.0)).alias("twice"))
    schema = T.StructType([*_string("bad", "good"), T.StructField("score", T.DoubleType())])
    ranked = pairs.drop("whole", "ways").join(weight, ["bad", "good"]).mapInPandas(filled(_ranked(model)), schema)
    return ranked.groupBy("bad").agg(F.max(F.struct("score", "good")).alias("b")).select("bad", F.col("b.good").alias("good"), F.col("b.score").alias("score")).filter("score > 0.5")


# ---- rows


def _taken_apart(model: Boosted | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, markup, chapter, book in zip(pdf["key"], pdf["html"], pdf["title"], pdf["book_title"]):
                page = Page(markup, [chapter or "", book or ""], model)
                rows += [(key, page.lines[i].no, kind, "", "", "") for i, kind in page.furniture.items()]
                rows += [(key, page.lines[i].no, "hyphen", left, right, mark) for i, left, right, mark, _ in page.breaks]
                rows += [(key, page.lines[i].no, "word", w, "", "") for i, w in sorted(set(page.words)) if len(w) >= LEAST_LETTERS and _LETTER.search(w)]
            yield pd.DataFrame(rows, columns=["key", "line_no", "kind", "a", "b", "mark"])

    return run


def _joined(models: tuple[Boosted, Boosted] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fixed: list[str | None] = []
            if models is None:
                fixed = [l + r if m in ALWAYS_SOFT or j > k else None for l, r, m, j, k in zip(pdf["left"], pdf["right"], pdf["mark"], pdf["c0"], pdf["c1"])]
            elif len(pdf):
                cols = pdf[["left", "right", "mark", "c0", "c1", "c2", "c3", "c4"]].itertuples(index=False)
                x = []
                for l, r, m, c0, c1, c2, c3, c4 in cols:
                    last, first = l.split("-")[-1], r.split("-")[0]
                    known = {l + r: c0, f"{l}-{r}": c1}
                    known.setdefault(last + first, c4)
                    known.setdefault(last, c2)
                    known.setdefault(first, c3)
                    x.append(join_features(l, r, m, lambda w, k=known: k.get(w, 0.0)))
                go, stay = (model.score(np.array(x, float)) for model in models)
                fixed = [
                    None if g <= 0.5 and m not in ALWAYS_SOFT or r in CONJUNCTIONS and j == 0 else f"{l}-{r}" if k > j or (s > 0.5 and j == 0 and m not in ALWAYS_SOFT) else l + r
                    for l, r, m, g, s, j, k in zip(pdf["left"], pdf["right"], pdf["mark"], go, stay, pdf["c0"], pdf["c1"])
                ]
            yield pdf[["left", "right", "mark"]].assign(fixed=fixed, known=(pdf["c0"] + pdf["c1"]) > 0)

    return run


def find_faults(rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``line_no``, ``kind``, ``was``, ``fixed``: every fault of every scanned row.

    ``rows`` has ``key`` (unique), ``html``, ``title`` and ``book_title``; other columns are not read, and only
    null or empty ``html`` or text that was not scanned give no row. Kinds are hyphen, ocr, header and page_number.
    With a corpus too small to train a model on, heads and letters are left alone, and words are joined where the joined
    form is known or the hyphen is a soft one.
    """
    base = rows.select(F.col(key).alias("key"), "html", "title", "book_title").filter(F.col("html").isNotNull())
    counts = cut_lineage(count_words(base))
    # samples: bounded, and drawn by hash so that every row and word has the same chance
    sample = base.select("html", "title", "book_title", F.xxhash64("key").alias("h")).orderBy("h").limit(SAMPLE_ROWS)
    heads = train_lines([(r["html"], r["title"] or "", r["book_title"] or "") for r in sample.toLocalIterator()])
    trusted = counts.filter("clean > 0").withColumn("n", (F.col("clean") + F.col("scanned")).cast("double"))
    words = {r["word"]: r["n"] for r in trusted.orderBy(F.xxhash64("word")).limit(SAMPLE_WORDS).toLocalIterator()}
    schema = T.StructType([base.schema["key"], T.StructField("line_no", T.IntegerType()), *_string("kind", "a", "b", "mark")])
    parts = cut_lineage(base.mapInPandas(filled(_taken_apart(heads)), schema))
    furniture = parts.filter("kind IN ('header', 'page_number')").select("key", "line_no", "kind", F.lit("").alias("was"), F.lit("").alias("fixed"))
    # broken words
    cases = parts.filter("kind = 'hyphen'").select("key", "line_no", "a", "b", F.lower(F.regexp_replace("a", "[‐‑]", "-")).alias("left"), F.lower(F.regexp_replace("b", "[‐‑]", "-")).alias("right"), "mark")
    kinds = cases.select("left", "right", "mark").distinct()
    last, first = F.element_at(F.split("left", "-"), -1), F.split("right", "-")[0]
    forms = kinds.withColumn("f", F.array(F.concat("left", "right"), F.concat_ws("-", "left", "right"), last, first, F.concat(last, first)))
    asked = forms.select("left", "right", "mark", F.posexplode("f").alias("i", "word"))
    known = asked.join(counts.select("word", (F.col("clean") * 4 + F.col("scanned")).cast("double").alias("n")), "word", "left")
    wide = known.groupBy("left", "right", "mark").agg(*(F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0.0)).alias(f"c{i}") for i in range(5)))
    schema = T.StructType([*_string("left", "right", "mark", "fixed"), T.StructField("known", T.BooleanType())])
    joined = cut_lineage(wide.mapInPandas(filled(_joined(train_joins(words))), schema).filter(F.col("fixed").isNotNull()))
    # suspects: words of scanned lines that no clean row has, and joined words that no row has
    said = parts.filter("kind = 'word'").groupBy(F.col("a").alias("bad")).agg(F.count(F.lit(1)).cast("double").alias("n_bad"))
    said = said.unionByName(joined.filter(~F.col("known") & ~F.col("fixed").contains("-")).select(F.col("fixed").alias("bad"), F.lit(1.0).alias("n_bad"))).groupBy("bad").agg(F.sum("n_bad").alias("n_bad"))
    suspects = said.join(trusted.select(F.col("word").alias("bad")), "bad", "left_anti")
    good = counts.select(F.col("word").alias("good"), (F.col("clean") + F.col("scanned")).cast("double").alias("n"), "clean").filter((F.col("clean") > 0) & F.col("good").rlike(r"^\p{L}+$")).drop("clean")
    fixes = cut_lineage(correct_words(suspects, good, words))
    hyphens = cases.join(joined, ["left", "right", "mark"]).join(fixes.select(F.col("bad").alias("fixed"), F.col("good").alias("better")), "fixed", "left")
    hyphens = hyphens.select("key", "line_no", F.lit("hyphen").alias("kind"), F.concat_ws("\n", "a", "b").alias("was"), F.coalesce("better", "fixed").alias("fixed"))
    ocr = parts.filter("kind = 'word'").select("key", "line_no", F.col("a").alias("bad")).join(fixes, "bad").select("key", "line_no", F.lit("ocr").alias("kind"), F.col("bad").alias("was"), F.col("good").alias("fixed"))
    return furniture.unionByName(hyphens).unionByName(ocr).withColumnRenamed("key", key)


def _cased(fixed: str, was: str) -> str:
    return fixed.upper() if len(was) > 1 and was.isupper() else fixed[:1].upper() + fixed[1:] if was[:1].isupper() else fixed


def repaired(markup: str, faults: list[dict]) -> list[str] | None:
    """The paragraphs of a scanned row with its faults mended; None if it was not scanned."""
    lines = lines_of(markup)
    if not is_scanned(lines):
        return None
    drop = {f["line_no"] for f in faults if f["kind"] in ("header", "page_number")}
    words = {(f["line_no"], f["was"]): f["fixed"] for f in faults if f["kind"] == "ocr"}
    breaks = {f["line_no"]: f for f in faults if f["kind"] == "hyphen"}
    paragraphs: list[str] = []
    carry, open_ = "", False
    for x in lines:
        if x.kind in ("blank", "skip") or x.no in drop:
            continue
        s = _WORD.sub(lambda m: _cased(words[x.no, m[0].lower()], m[0]) if (x.no, m[0].lower()) in words else m[0], x.text)
        if carry:
            s = carry + re.sub(r"\A[^\W_]+(?:[\-‐‑’'][^\W_]+)*", "", s)
            carry = ""
        f = breaks.get(x.no)
        if f:
            left = f["was"].split("\n")[0]
            if s[:-1].endswith(left):
                s = s[: -1 - len(left)]
                carry = _cased(f["fixed"], left)
        if x.kind == "heading" or not open_:
            paragraphs.append(s)
        else:
            paragraphs[-1] = f"{paragraphs[-1]} {s}" if s and paragraphs[-1] and not paragraphs[-1].endswith(" ") else paragraphs[-1] + s
        # a paragraph closed by a page break within a sentence goes on behind it
        open_ = x.kind != "heading" and (bool(carry) or not re.search(r"</p>", x.raw) or not _TERMINAL.search(x.text))
    if carry:
        paragraphs[-1] += carry
    return [re.sub(r"\s+", " ", p).strip() for p in paragraphs if p.strip()]


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, markup, faults in zip(pdf["key"], pdf["html"], pdf["faults"]):
            for n, p in enumerate(repaired(markup, list(faults) if faults is not None else []) or [], 1):
                rows.append((key, n, p))
        yield pd.DataFrame(rows, columns=["key", "para_no", "text"])


def repair_pages(rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``para_no`` (from 1), ``text``: the continuous clean paragraphs of every scanned row; see :func:`find_faults`."""
    faults = find_faults(rows, key).groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("line_no", "kind", "was", "fixed")).alias("faults"))
    base = rows.select(F.col(key).alias("key"), "html").filter(F.col("html").isNotNull()).join(faults, "key", "left")
    schema = T.StructType([base.schema["key"], T.StructField("para_no", T.IntegerType()), *_string("text")])
    return base.mapInPandas(filled(_rebuilt), schema).withColumnRenamed("key", key)
