"""Problem 4: one consistent form for text that looks alike.

A batch of texts is joined once, turned into one array of code points and worked on as arrays only: a lookup table gives
each code point its class and, by expansion offsets, its ordinary letters; look-alike letters are decided word by word
with ``reduceat``; base letters and marks are composed by binary search in the table of pairs. No string call is made for
a row; strings are cut out only for words that are reported.

The tables are built from :mod:`unicodedata` by rule; only the look-alike letters, which it does not know, are listed.
Punctuation keeps its form (wide signs are ordinary in Chinese and Japanese), and so do superscripts, joiners that a
script requires, emoji sequences and words genuinely written in another script.
"""

from __future__ import annotations

import functools
import html
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets and the Latin letters they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԛ": "q", "ԝ": "w", "ԁ": "d", "ӏ": "l", "ѵ": "v", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "Ё": "Ë", "Ї": "Ï",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "ι": "i", "κ": "k", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "ε": "e", "τ": "t", "ω": "w", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U",
    "ɡ": "g", "ɑ": "a", "ⲟ": "o", "Ꭺ": "A", "Ꮪ": "S", "Ꮲ": "P", "Ꭲ": "T", "Ꮯ": "C", "Ꭼ": "E",
}
#: Of those, the ones that stand for each other in a Cyrillic word too (Latin letter: Cyrillic letter).
TO_CYRILLIC = {v: k for k, v in LOOKALIKES.items() if "Ѐ" <= k <= "ԯ"} | {"k": "к", "m": "м", "t": "т", "b": "в", "n": "п", "u": "и", "r": "г"}

SEP = "\x1e"
OTHER, LATIN, CYRILLIC, GREEK, ARMENIAN, KATAKANA, HIRAGANA, HAN, LETTER = range(9)
_NAMES = {"LATIN": LATIN, "CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN, "KATAKANA": KATAKANA, "KATAKANA-HIRAGANA": KATAKANA, "HIRAGANA": HIRAGANA, "CJK": HAN, "COPTIC": GREEK, "CHEROKEE": GREEK}
_COMPAT = {"<wide>", "<narrow>", "<font>", "<compat>", "<circle>"}
_ALPHABETS = (1 << LATIN) | (1 << CYRILLIC) | (1 << GREEK) | (1 << ARMENIAN)


class Tables:
    """Lookup tables over all code points, built once in each worker."""

    def __init__(self) -> None:
        n = sys.maxunicode + 1
        self.script, self.mark, self.order = np.zeros(n, np.uint8), np.zeros(n, bool), np.zeros(n, np.uint8)
        self.hidden, self.space, self.lower = np.zeros(n, bool), np.zeros(n, bool), np.arange(n, dtype=np.uint32)
        self.latin, self.cyrillic = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.exp_len, self.exp_at = np.ones(n, np.uint8), np.zeros(n, np.int64)
        self.foreign_form = np.zeros(n, bool)  # reported as another form even where the letter itself stays Latin
        data, expanding, pairs = [], [], {}
        for cp in range(n):
            if 0x4E00 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7B0 or 0x20000 <= cp < 0x323B0:
                self.script[cp] = HAN if cp < 0xA000 or cp >= 0x20000 else LETTER
                continue
            if 0x323B0 <= cp < 0xE0000 or cp >= 0xE01F0 or 0xD800 <= cp < 0xF900:
                continue
            c = chr(cp)
            cat = unicodedata.category(c)
            if cat == "Cn":
                continue
            if cat[0] == "L":
                self.script[cp] = _NAMES.get(unicodedata.name(c, "").split(" ")[0], LETTER)
                low = c.lower()
                if len(low) == 1:
                    self.lower[cp] = ord(low)
            elif cat[0] == "M":
                self.mark[cp] = True
                self.order[cp] = unicodedata.combining(c)
            elif cat == "Cf":
                self.hidden[cp] = cp < 0xE0000 and not 0x600 <= cp <= 0x605 and cp not in (0x6DD, 0x70F, 0x8E2)
            elif cat == "Zs" and cp != 0x20:
                self.space[cp] = True
            parts = unicodedata.decomposition(c).split()
            if parts and parts[0] in _COMPAT and (cat[0] in "LN"):
                out = unicodedata.normalize("NFKC", c)
                if not any(0xE00 <= ord(x) < 0x1000 or 0x600 <= ord(x) < 0x900 or 0x3130 <= ord(x) < 0x3190 for x in out) and all(unicodedata.category(x)[0] in "LNM" for x in out):
                    self.exp_len[cp], self.exp_at[cp] = len(out), len(data)
                    data.extend(map(ord, out))
                    expanding.append(cp)
                    if self.script[cp] == OTHER or cat == "Nl":
                        self.script[cp] = LATIN
            elif len(parts) == 2 and parts[0][0] != "<":
                a, b = int(parts[0], 16), int(parts[1], 16)
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == c:
                    pairs[(a << 21) | b] = cp
        for low in (0x30FC, 0xFF70):  # the sign that lengthens a kana
            self.script[low] = KATAKANA
        self.exp_data = np.array(data, np.uint32)
        self.has_exp = np.zeros(n, bool)
        self.has_exp[expanding] = True
        for a, b in LOOKALIKES.items():
            self.latin[ord(a)] = ord(b)
            self.foreign_form[ord(a)] = unicodedata.name(a).startswith("LATIN")
        for a, b in TO_CYRILLIC.items():
            self.cyrillic[ord(a)] = ord(b)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_to = keys, np.array([pairs[k] for k in keys], np.uint32)


@functools.lru_cache(1)
def tables() -> Tables:
    return Tables()


def _join(col: pa.Array) -> str:
    """All values of a string column as one string, parted by :data:`SEP`; entities resolved."""
    col = col.fill_null("")
    one = pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col.cast(pa.string()))
    return html.unescape(pc.binary_join(one, SEP)[0].as_py())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "replace")


class Folded:
    """The consistent form of one joined text: ``points``, the ``row`` of each, and what was changed."""

    def __init__(self, text: str) -> None:
        t = tables()
        cps = _points(text)
        # expansion: each code point becomes its ordinary letters
        n = t.exp_len[cps].astype(np.int64)
        src = np.repeat(np.arange(len(cps)), n)
        starts = np.cumsum(n) - n
        is_exp = t.has_exp[cps]
        at = t.exp_at[cps][src] + (np.arange(len(src)) - starts[src])
        out = np.where(is_exp[src], t.exp_data[np.minimum(at, len(t.exp_data) - 1)], cps[src])
        changed = is_exp[src]
        # spaces
        odd = t.space[out]
        # signs without width go, unless their script needs them
        hid = t.hidden[out]
        script = t.script[out]
        letterish = (script > 0) | t.mark[out]
        plainish = (script > 0) & (script != LETTER) | (t.mark[out] & (out < 0x370))
        ix = np.arange(len(out))
        left = np.maximum.accumulate(np.where(~hid, ix, -1))
        right = np.minimum.accumulate(np.where(~hid, ix, len(out))[::-1])[::-1]
        in_word = hid & (left >= 0) & (right < len(out))
        lw, rw = np.where(in_word, left, 0), np.where(in_word, right, 0)
        needed = in_word
        if len(out):
            needed = in_word & ~(plainish[lw] & plainish[rw]) & (letterish[lw] | letterish[rw] | (out[lw] > 0x2000))
        gone = hid & ~needed
        inside = gone & in_word & ~needed
        keep = ~gone
        held = np.zeros(len(out), bool)  # a removed sign stood before this kept code point
        if len(out):
            held[right[inside]] = True
        out, changed, odd, held = out[keep], changed[keep], odd[keep], held[keep]
        # words: runs of letters and marks, cut where the kind of writing changes between kana, Han and the rest
        script = t.script[out]
        mark = t.mark[out]
        letter = (script > 0)
        ix = np.arange(len(out))
        base = np.maximum.accumulate(np.where(letter, ix, 0)) if len(out) else ix
        wordy = letter | (mark & (np.concatenate([[False], letter[:-1] | mark[:-1]]) if len(out) else mark))
        kind = script[base] if len(out) else script
        kind = np.where(np.isin(kind, (KATAKANA, HIRAGANA, HAN)), kind, LATIN)
        begins = wordy.copy()
        if len(out):
            begins[1:] &= ~(wordy[:-1] & (kind[1:] == kind[:-1]))
        word = np.where(wordy, np.cumsum(begins) - 1, -1)
        self.points, self.changed, self.held, self.odd, self.word, self.begins, self.kind = out, changed, held & ~begins & wordy, odd, word, begins, kind
        self.row = np.cumsum(out == ord(SEP)) if len(out) else out.astype(np.int64)
        self._lookalikes(t)
        self._compose(t)

    def _lookalikes(self, t: Tables) -> None:
        at = np.flatnonzero(self.word >= 0)
        if not len(at):
            return
        p, w = self.points[at], self.word[at]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        script, lat, cyr = t.script[p], t.latin[p] > 0, t.cyrillic[p] > 0
        mark = t.mark[p]
        known = (script >= LATIN) & (script <= ARMENIAN)
        bits = np.bitwise_or.reduceat(np.where(known, 1 << script.astype(np.int64), np.where(mark, 0, 1 << 15)), first)
        latinable = np.logical_and.reduceat((script == LATIN) | lat | mark, first)
        cyrillicable = np.logical_and.reduceat((script == CYRILLIC) | cyr | mark, first)
        n_letters = np.add.reduceat(~mark, first)
        rows = self.row[at][first]
        n_lat = np.bincount(self.row[at], weights=(script == LATIN) & ~lat, minlength=rows[-1] + 1)
        n_cyr = np.bincount(self.row[at], weights=(script == CYRILLIC) & ~lat, minlength=rows[-1] + 1)
        row_latin = (n_lat >= n_cyr)[rows]
        only = (bits & ~np.int64(_ALPHABETS)) == 0
        mixed = only & ((bits & (bits - 1)) != 0)
        # a whole word of look-alikes counts only in Latin text and away from genuine words of its alphabet
        alone = only & ~mixed & (bits != 1 << LATIN) & latinable & (n_letters >= 3) & row_latin
        real = only & ~mixed & ~latinable
        near = np.zeros(len(first), bool)
        near[1:] |= real[:-1] & (bits[:-1] == bits[1:])
        near[:-1] |= real[1:] & (bits[1:] == bits[:-1])
        to_latin = (mixed & latinable & (row_latin | ~cyrillicable)) | (alone & ~near) | (only & (bits == 1 << LATIN) & np.logical_or.reduceat(t.foreign_form[p], first))
        to_cyr = mixed & cyrillicable & ~to_latin & ((bits >> CYRILLIC & 1) > 0)
        spread = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
        l_at, c_at = to_latin[spread] & lat, to_cyr[spread] & cyr & (script == LATIN)
        new = np.where(l_at, t.latin[p], np.where(c_at, t.cyrillic[p], p))
        self.points[at] = new
        self.changed[at] |= l_at | c_at

    def _compose(self, t: Tables) -> None:
        """Marks in canonical order, then each joined to the letter right before it; a letter that is composed already is not taken apart."""
        rank = t.order[self.points].astype(np.int64)
        key = np.cumsum(rank == 0) * 256 + rank
        if (key[1:] < key[:-1]).any():
            by = np.argsort(key, kind="stable")
            self.points, self.changed = self.points[by], self.changed[by]
        while len(self.points) > 1:
            a, b = self.points[:-1].astype(np.int64), self.points[1:].astype(np.int64)
            can = np.flatnonzero(t.mark[self.points[1:]])
            if not len(can):
                return
            key = (a[can] << 21) | b[can]
            pos = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
            hit = can[t.pair_keys[pos] == key]
            if not len(hit):
                return
            self.points[hit] = t.pair_to[np.searchsorted(t.pair_keys, key[t.pair_keys[pos] == key])]
            self.changed[hit] = True
            keep = np.ones(len(self.points), bool)
            keep[hit + 1] = False
            for name in ("points", "changed", "held", "odd", "word", "begins", "kind", "row"):
                setattr(self, name, getattr(self, name)[keep])

    def texts(self) -> list[str]:
        """The consistent texts, odd spaces made plain and not doubled."""
        pts = np.where(self.odd, np.uint32(0x20), self.points)
        if len(pts):
            blank = pts == 0x20
            pts = pts[~(self.odd & np.concatenate([[False], blank[:-1]])) & ~(blank & ~self.odd & np.concatenate([[False], self.odd[:-1]]))]
        return _text(pts).split(SEP)

    def found(self) -> list[tuple[int, str]]:
        """(row, word) of the words in other characters, and of pairs of words parted by an odd space."""
        t = tables()
        at = np.flatnonzero(self.word >= 0)
        if not len(at):
            return []
        w = self.word[at]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        ends = np.append(first[1:], len(at))
        low = t.lower[self.points]
        n_letters = np.add.reduceat(t.script[self.points[at]] > 0, first)
        touched = np.logical_or.reduceat(self.changed[at] | self.held[at], first) & (n_letters >= 3)
        begin, end = at[first], at[ends - 1] + 1
        rows = self.row[begin]
        res = [(int(rows[i]), _text(low[begin[i] : end[i]])) for i in np.flatnonzero(touched)]
        # gaps between neighbouring words: only spaces, at least one of them odd
        if len(begin) > 1:
            gap = begin[1:] - end[:-1]
            odd_sum, space_sum = np.concatenate([[0], np.cumsum(self.odd)]), np.concatenate([[0], np.cumsum(self.odd | (self.points == 0x20))])
            g0, g1 = end[:-1], begin[1:]
            east = np.isin(self.kind[begin], (KATAKANA, HIRAGANA, HAN))
            pair = (gap > 0) & (odd_sum[g1] > odd_sum[g0]) & (space_sum[g1] - space_sum[g0] == gap) & ~east[:-1] & ~east[1:] & (rows[1:] == rows[:-1])
            res += [(int(rows[i]), f"{_text(low[begin[i]:end[i]])} {_text(low[begin[i + 1]:end[i + 1]])}") for i in np.flatnonzero(pair)]
        return res


def visible(markup: Column) -> Column:
    """``markup`` without code blocks and tags; tags of blocks part words, tags within a line do not. Entities stay."""
    text = F.translate(markup, SEP, " ")
    text = F.regexp_replace(text, r"(?is)<(pre|code|script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "\n")
    text = F.regexp_replace(text, r"(?is)</?(?:span|b|i|em|strong|a|u|s|small|sub|sup|font|q|abbr|mark|tt)\b[^>]*>", "")
    return F.regexp_replace(text, r"(?s)<[/!?]?[A-Za-z][^>]*>", "\n")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits = sorted(set(Folded(_join(b.column(1))).found()))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in hits], pa.int64())), pa.array([w for _, w in hits], pa.string())], ["key", "plain"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = pa.array(Folded(_join(b.column(1))).texts() if b.num_rows else [], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(pc.is_valid(b.column(1)), out, pa.scalar(None, pa.string()))], ["key", "plain"])


def _run(df: DataFrame, key: str, text: Column, how) -> DataFrame:
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("plain", T.StringType())])
    return df.select(F.col(key).alias("key"), text.alias("text")).mapInArrow(how, schema).withColumnRenamed("key", key)


def find_variants(df: DataFrame, key: str, text: str, markup: bool = False) -> DataFrame:
    """``key``, ``plain``: each word (three letters or more) that stands in other than ordinary characters, in ordinary lower case, and each pair of words parted by an odd space.

    Rows with null or empty text give nothing; repeated rows repeat their words; other columns are not read.
    """
    rows = df.filter(F.col(text).isNotNull())
    return _run(rows, key, visible(F.col(text)) if markup else F.translate(text, SEP, " "), _words)


def fold_texts(df: DataFrame, key: str, text: str, markup: bool = False) -> DataFrame:
    """``key``, ``plain``: every text in one consistent form, one row for each row of ``df``; null stays null."""
    return _run(df, key, visible(F.col(text)) if markup else F.translate(text, SEP, " "), _texts)
