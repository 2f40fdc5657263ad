"""Problem 7: passages of test items inside a corpus.

The items are cut into windows of a few words, and these windows are searched in all documents at once by the
multi-pattern method of Wu and Manber: a table tells for each block of three characters how far the search may jump, the
blocks that end a window lead to its bucket by hash, and a direct comparison confirms it. The search runs over a whole
batch of documents as one array, with thousands of cursors that jump side by side. Items of which a window was met in a
document are aligned with it word by word, all pairs of a batch side by side, so that words changed, added or left out do
not matter. Only pairs that provably cannot reach the share wanted are not aligned.

The items are held by every task, in blocks of about :data:`BLOCK_ITEMS` items and :data:`BLOCK_SIGNS` characters at most;
more items make more passes over the documents, none makes the broadcast larger. What a line or a window is worth does not
depend on the blocks. The documents are read where they lie: there is no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import filled
from ..session import cut_lineage

#: Items of one pass and their characters. An item's windows take some kilobytes, so a block stays within tens of megabytes.
BLOCK_ITEMS, BLOCK_SIGNS = 5000, 10_000_000
#: Windows under this length are searched by themselves, as the shortest window sets how far a search may jump.
SHORT = 8
#: Words of a window, and characters of one in scripts without spaces.
WINDOW_WORDS, WINDOW_SIGNS = 4, 8
CURSORS = 4096
#: Score of an equal word and of one changed, added or left out: a passage may lose two words in five, not more.
MATCH, EDIT = 2, -3
#: Cells of the tables that are filled at once.
CELLS = 1 << 22

_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]|(?:(?![぀-ヿ㐀-鿿豈-﫿฀-๿])[^\W_])+(?:[̀-ͯऀ-ःऺ-ॏ]+(?:(?![฀-๿])[^\W_])*)*")
_SIGN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]")


def words_of(text: str) -> list[str]:
    """Words without case and punctuation; each sign of a script without spaces is a word."""
    return _WORD.findall(text.casefold())


def lines_of(text: str) -> set[str]:
    return {" ".join(words_of(x)) for x in text.splitlines()}


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(b, x) for b, t in zip(pdf["block"], pdf["text"]) for x in lines_of(t)], columns=["block", "line"])


class WuManber:
    """Search of many strings of code points at once in an array of code points."""

    BITS = 18

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = patterns
        self.m = max(3, min(map(len, patterns), default=3))
        heads = np.array([np.frombuffer(p[: self.m].ljust(self.m).encode("utf-32-le"), np.uint32) for p in patterns], np.uint32).reshape(len(patterns), self.m)
        self.shift = np.full(1 << self.BITS, self.m - 2, np.int64)
        for end in range(2, self.m):
            h = self._block(heads[:, end - 2], heads[:, end - 1], heads[:, end])
            np.minimum.at(self.shift, h, self.m - 1 - end)
        keys = self._key(heads)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order

    def _block(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64) * np.uint64(0x85EBCA77) + c.astype(np.uint64) * np.uint64(0xC2B2AE3D)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _key(self, heads: np.ndarray) -> np.ndarray:
        key = np.zeros(len(heads), np.uint64)
        for j in range(self.m):
            key = key * np.uint64(0x100000001B3) + heads[:, j].astype(np.uint64)
        return key

    def search(self, text: str) -> list[tuple[int, int]]:
        """(position, pattern) of every occurrence."""
        t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(t)
        if n < self.m or not self.patterns:
            return []
        step = max(64, -(-n // CURSORS))
        pos = np.arange(0, n, step, dtype=np.int64) + self.m - 1
        stop = np.minimum(pos + step, n)
        found = []
        live = pos < stop
        pos, stop = pos[live], stop[live]
        while len(pos):
            jump = self.shift[self._block(t[pos - 2], t[pos - 1], t[pos])]
            found.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        ends = np.concatenate(found)
        starts = ends - self.m + 1
        keys = np.zeros(len(starts), np.uint64)
        for j in range(self.m):
            keys = keys * np.uint64(0x100000001B3) + t[starts + j].astype(np.uint64)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = []
        for i in np.flatnonzero(hi > lo):
            s = int(starts[i])
            out += [(s, int(p)) for p in self.order[lo[i] : hi[i]] if text.startswith(self.patterns[p], s)]
        return out


class Items:
    """The windows of a block of items, ready to be searched."""

    def __init__(self, rows: list[tuple[int, str]], shared: set[str] | None = None) -> None:
        """``shared``: the lines of these items that several items of all blocks have; without, they are counted in ``rows``."""
        if shared is None:
            lines = Counter()
            for _, text in rows:
                lines.update(lines_of(text))
            shared = {x for x, n in lines.items() if n > 1}
        self.words: dict[int, list[str]] = {}
        windows: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, text in rows:
            # a line that several items share is an instruction, not the item
            own = [x for x in text.splitlines() if " ".join(words_of(x)) not in shared]
            w = words_of("\n".join(own)) or words_of(text)
            self.words[item] = w
            size = WINDOW_SIGNS if sum(bool(_SIGN.match(x)) for x in w) > len(w) / 2 else WINDOW_WORDS
            size = max(1, min(size, len(w) // 2))
            for i in range(len(w) - size + 1):
                windows[" " + " ".join(w[i : i + size]) + " "].append((item, i))
        self.patterns = sorted(windows)
        self.places = [windows[p] for p in self.patterns]
        short = [k for k, p in enumerate(self.patterns) if len(p) < SHORT]
        long = [k for k, p in enumerate(self.patterns) if len(p) >= SHORT]
        self.searches = [(ks, WuManber([self.patterns[k] for k in ks])) for ks in (short, long) if ks]
        self.ids: dict[str, int] = {}
        self.coded = {item: np.array([self.ids.setdefault(x, len(self.ids)) for x in w], np.int32) for item, w in self.words.items()}

    def found(self, text: str) -> Iterator[tuple[int, int]]:
        """(position, number of the window) of every occurrence of a window."""
        for ks, search in self.searches:
            for at, k in search.search(text):
                yield at, ks[k]


def align(items: list[np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of each two lists of word codes: item from, item to, document from, document to; 0 without any.

    Codes are 0 or more; a document has -2 for words of no item. Pairs of like size are filled in side by side.
    """
    out = np.zeros((len(items), 4), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(docs[k]), len(items[k])))
    at = 0
    while at < len(order):
        stop, rows = at, 0
        while stop < len(order):
            rows = max(rows, len(items[order[stop]]))
            if stop > at and (rows + 1) * (len(docs[order[stop]]) + 1) * (stop + 1 - at) > CELLS:
                break
            stop += 1
        some = order[at:stop]
        out[some] = _align([items[k] for k in some], [docs[k] for k in some])
        at = stop
    return out


def _align(items: list[np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    n, rows, cols = len(items), max(map(len, items)), max(map(len, docs))
    a, b = np.full((rows, n), -1, np.int32), np.full((n, cols), -2, np.int32)
    for k, (x, y) in enumerate(zip(items, docs)):
        a[: len(x), k], b[k, : len(y)] = x, y
    kind = np.int16 if MATCH * rows - EDIT * (cols + 1) < 32000 else np.int32
    table = np.zeros((rows + 1, n, cols + 1), kind)
    ramp = (-EDIT * np.arange(cols)).astype(kind)
    best, end_i, end_j = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(1, rows + 1):
        last = table[i - 1]
        v = (b == a[i - 1][:, None]).astype(kind)
        v *= kind(MATCH - EDIT)
        v += kind(EDIT)
        v += last[:, :-1]
        np.maximum(v, last[:, 1:] + kind(EDIT), out=v)
        np.maximum(v, kind(0), out=v)
        # the best way from the left: a running maximum of what a gap from there would leave
        v += ramp
        np.maximum.accumulate(v, axis=1, out=v)
        v -= ramp
        table[i, :, 1:] = v
        top = v.max(axis=1)
        more = np.flatnonzero(top > best)
        if len(more):
            best[more], end_i[more], end_j[more] = top[more], i, v[more].argmax(axis=1) + 1
    i, j, live = end_i.copy(), end_j.copy(), np.flatnonzero(best > 0)
    while len(live):
        x, y = i[live], j[live]
        v = table[x, live, y]
        diagonal = v == table[x - 1, live, y - 1] + np.where(a[x - 1, live] == b[live, y - 1], MATCH, EDIT)
        up = ~diagonal & (v == table[x - 1, live, y] + EDIT)
        i[live] -= diagonal | up
        j[live] -= ~up
        live = live[(i[live] > 0) & (j[live] > 0)]
        live = live[table[i[live], live, j[live]] > 0]
    return np.stack([i, end_i, j, end_j], axis=1)


def groups_of(seeds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Seeds that follow each other in both texts; a seed is an (item, document) word position."""
    groups: list[list[tuple[int, int]]] = []
    near: list[list[tuple[int, int]]] = []  # the groups that a seed may still join
    for s in sorted(set(seeds), key=lambda s: (s[1], s[0])):
        near = [g for g in near if s[1] - g[-1][1] <= 24]
        for g in reversed(near):
            i, j = g[-1]
            if 0 <= s[0] - i <= 24 and 0 < s[1] - j and abs((s[0] - i) - (s[1] - j)) <= 8:
                g.append(s)
                break
        else:
            groups.append([s])
            near.append(groups[-1])
    return groups


def regions(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], least: float, here: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Where to align: (item from, item to, document from, document to) for each group of seeds that may help to reach ``least``.

    A passage of n item words with a score of 0 or more has at least n * -EDIT / (MATCH - EDIT) equal ones, so the item's
    words that occur near the seeds at all bound what its two best passages can cover. ``here`` has a free mark for each code.
    """
    out, most = [], []
    for g in groups_of(seeds):
        i0, i1 = max(0, g[0][0] - 30), min(len(item), g[-1][0] + 34)
        j0, j1 = max(0, g[0][1] - 34), min(len(doc), g[-1][1] + 38)
        near = doc[j0:j1]
        here[near] = True
        equal = np.count_nonzero(here[item[i0:i1]])
        here[near] = False
        out.append((i0, i1, j0, j1))
        most.append(min(i1 - i0, equal * (MATCH - EDIT) / -EDIT))
    second, first = sorted([0, *most])[-2:]
    with_best = [m + (second if k == most.index(first) else first) for k, m in enumerate(most)]
    return [r for r, m in zip(out, with_best) if m >= least * len(item)]


def coverage(n: int, spans: list[tuple[int, int, int, int]]) -> float:
    """Share of an item of ``n`` words that lies in the one or two best of the passages ``spans``, as :func:`align` gives them."""
    # of all passages with the same words of the item, the one that ends first and the one that begins last
    ends: dict[tuple[int, int], int] = {}
    begins: dict[tuple[int, int], int] = {}
    for a, b, c, e in spans:
        ends[a, b] = min(e, ends.get((a, b), e))
        begins[a, b] = max(c, begins.get((a, b), c))
    best = 0
    for (a, b), e in ends.items():
        best = max(best, b - a)
        for (x, y), c in begins.items():
            if a < x and e <= c + 2:
                best = max(best, min(n, b - a + y - max(x, b)))
    return best / max(1, n)


def _search(items: Items, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = np.zeros(len(items.ids) + 2, bool)
        for pdf in batches:
            docs = [words_of(t) if isinstance(t, str) else [] for t in pdf["text"]]
            parts = [" " + " ".join(w) + " " for w in docs]
            starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
            text = "\n".join(parts)
            hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for at, p in items.found(text):
                d = int(np.searchsorted(starts, at, "right")) - 1
                for item, i in items.places[p]:
                    hits[d, item].append((i, at))
            marks: dict[int, np.ndarray] = {}
            coded: dict[int, np.ndarray] = {}
            todo: list[tuple[tuple[int, int], tuple[int, int, int, int]]] = []
            for (d, item), got in hits.items():
                if d not in marks:
                    marks[d] = np.flatnonzero(np.frombuffer(parts[d].encode("utf-32-le"), np.uint32) == 32)
                    coded[d] = np.array([items.ids.get(x, -2) for x in docs[d]], np.int32)
                seeds = [(i, int(np.searchsorted(marks[d], at - starts[d]))) for i, at in got]
                todo += [((d, item), r) for r in regions(items.coded[item], coded[d], seeds, least, here)]
            spans = align([items.coded[item][r[0] : r[1]] for (_, item), r in todo], [coded[d][r[2] : r[3]] for (d, _), r in todo])
            passages: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)
            for (pair, (i0, _, j0, _)), (a, b, c, e) in zip(todo, spans.tolist()):
                if b - a >= 4:
                    passages[pair].append((i0 + a, i0 + b, j0 + c, j0 + e))
            rows = [(pdf["key"].iloc[d], item, share) for (d, item), x in passages.items() if (share := coverage(len(items.words[item]), x)) >= least]
            yield pd.DataFrame(rows, columns=["key", "item", "share"])

    return run


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: float = 0.5) -> DataFrame:
    """``key``, ``item_key``, ``share``: each document and item of which it holds at least ``least`` of the words.

    The words must stand in the item's order in one or two passages; case, punctuation, spacing and single words changed,
    added or left out within a passage do not matter. Items with null or empty text and documents without text give no
    row; repeated documents and items give a row each. Other columns are not read.
    """
    rows = items.select(F.col(item_key).cast("long"), F.col(item_text)).filter(F.col(item_text).isNotNull() & F.col(item_key).isNotNull())
    there = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("signs")).first()
    blocks = max(1, -(-there["n"] // BLOCK_ITEMS), -(-there["signs"] // BLOCK_SIGNS))
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", base.schema["key"].dataType), T.StructField("item", T.LongType()), T.StructField("share", T.DoubleType())])
    if blocks > 1:  # lines that several items share, wherever these are; each block gets its own of them
        lines = rows.select(F.pmod(F.xxhash64(item_key), F.lit(blocks)).alias("block"), F.col(item_text).alias("text")).mapInPandas(filled(_lines), "block long, line string")
        places = cut_lineage(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.collect_set("block").alias("in")).filter("n > 1"))
    out = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == b)
        shared = None if blocks == 1 else {r[0] for r in places.filter(F.array_contains("in", F.lit(b).cast("long"))).select("line").toLocalIterator()}
        got = Items(sorted((r[0], r[1]) for r in part.toLocalIterator()), shared)
        found = base.mapInPandas(filled(_search(got, least)), schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key), "share")
