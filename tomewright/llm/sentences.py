"""Problem 5: sentences of texts in any language or script.

Whether a full stop ends a sentence is decided from the document itself where it is unambiguous: a token seen there with
its stop before a small letter, a comma or a number is an abbreviation, one seen at the end of paragraphs may end a
sentence, a word seen in small letters is no proper name, one seen with a capital within sentences is. Where the document
is silent, the counts of the whole corpus decide, and only then a short list of well-known abbreviations. Other
terminators follow rules of their script; quotations and brackets are paired first.

The corpus counts are made in two steps: each task counts its own documents and lists what they will ask about, then one
row for each token is summed over the tasks. A document gets only the rows of its own tokens, by a join on the token, so that nothing that grows with the
corpus is broadcast or collected; the counts are repeated :data:`SALT` times, so that a token that most documents ask for
is spread over as many tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import filled
from ..session import cut_lineage

# Abbreviations for documents and corpora too small to show them. Those of the first list never end a
# sentence before a capital, those of the second may.
NEVER_FINAL = {"mr", "mrs", "ms", "dr", "prof", "st", "gen", "rev", "fig", "no", "nr", "vol", "pp", "vs", "e.g", "i.e", "cf", "approx", "ca", "abb", "bzw", "z.b", "d.h", "u.a", "vgl", "hr", "fr", "s", "m", "mm", "mme", "mlle", "p.ex", "art", "sr", "sra", "dra", "srta", "pág", "p.ej", "núm", "стр", "г", "гл", "рис", "т.е", "напр", "см", "им", "डॉ", "श्री", "ดร"}
MAY_END = {"etc", "inc", "ltd", "co", "corp", "a.m", "p.m", "u.s", "u.k", "jr", "usw", "ff", "т.д", "т.п", "др", "ee.uu"}
#: Those of the first list that only stand before a name.
TITLES = {"mr", "mrs", "ms", "dr", "prof", "gen", "rev", "hr", "fr", "m", "mm", "mme", "mlle", "sr", "sra", "dra", "srta", "डॉ", "श्री", "ดร"}
MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "jänner"}

_BLANK = re.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+")
_RULE = re.compile(r"(?m)^[^\S\n]*(?:---+|\*\*\*+)[^\S\n]*$")
_BEAT = re.compile(r"\[\[beat\]\]")
_MARKUP = re.compile(r"</?[A-Za-z]|\$\$|```|\||#{1,6}\s|!\[")
_MARK = re.compile(r"[.!?…‽⁇⁈⁉]+|[。！？｡]+|[।॥؟۔።]+")
_TOKEN = re.compile(r"(?<![\w.])(?:(?:(?:[^\W\d_]|[A-ZА-Я]{2})\.){1,4}|(?:(?:[^\W\d_]|[A-ZА-Я]{2})\.\s){1,4})[^\W\d_]{1,2}$|[^\W_](?:[^\W_]|[\-’'][^\W_]|[̀-ःऺ-्ัิ-ฺ็-๎ॊ-ॏ])*$")
_WORD = re.compile(r"[^\W\d_][^\W\d_'’\-]*")
_WORD_STOP = re.compile(rf"({_WORD.pattern})(\.?)")
_STOP = re.compile(r"\.(?!\w|\.)")
_PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "»": "«"}
_CLOSERS = "\"”“’»)]）」』】》*_'«"
_THAI = re.compile(r"[฀-๿]")
_EAST = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
_INDIC = re.compile(r"[ऀ-෿]")
_ZH_SAID = re.compile(r"^[^。！？“”「」]{0,16}?(?:说|說|问|問|道|答|喊|叫|嚷|表示)")
_HI_SAID = re.compile(r"^[^।?!\"“”]{0,60}?(?:कहा|पूछा|बोल|बताया|चिल्ला|उत्तर दिया|जवाब दिया)")

#: Counts kept for a token: with its stop before a small letter or comma, a number, a capital, the end of a paragraph;
#: without a stop; in small letters; with a capital behind a small word.
FIELDS = ("low", "digit", "cap", "final", "plain", "small", "name")
#: Characters of the longest abbreviation with its inner stops and spaces; what is longer is a word.
LONGEST = 24
#: Copies of the corpus counts in the join with the documents.
SALT = 16


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the paragraphs, ``---`` lines left out."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        chunk = text[at:end]
        a = at + len(chunk) - len(chunk.lstrip())
        b = at + len(chunk.rstrip())
        if a < b:
            yield a, b
        if m:
            at = m.end()


def masked(text: str) -> str:
    """``text`` with pause tokens and rules blanked, every position kept."""
    text = _BEAT.sub(lambda m: " " * len(m[0]), text)
    return _RULE.sub(lambda m: "\n" * len(m[0]), text).replace("\r", " ")


def _after(text: str, at: int, end: int) -> tuple[str, str, int]:
    """What follows position ``at``: its kind, the next word, and where that begins."""
    k = at
    while k < end and (text[k].isspace() or text[k] in "—–-¿¡\"“«„「『（([‘"):
        k += 1
    if k >= end:
        return "final", "", k
    c = text[k]
    if c.isdigit():
        return "digit", "", k
    m = _WORD.match(text, k, end)
    if m:
        w = m[0]
        return ("low" if w[0].islower() else "cap" if w[0].isupper() else "other"), w, k
    return ("low" if c in ",;:" else "other"), "", k


def _norm(token: str) -> str:
    return "".join(token.split())


def _token(text: str, a: int, i: int) -> re.Match | None:
    """The token that ends before the stop at ``i``; a longer one than :data:`LONGEST` is a word and gives its last letters."""
    return _TOKEN.search(text, max(a, i - LONGEST), i)


_INNER = re.compile(r"(?<=[a-zà-öø-ÿа-яё][a-zà-öø-ÿа-яё] )[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_'’\-]*")


def count_stops(text: str, asked: set[str] | None = None) -> Counter:
    """(token, field) counts of the tokens that stand before a stop in a masked text.

    ``asked`` takes the tokens about which :class:`Judge` may ask for this text: those before a stop that may end a
    sentence, and the words with a capital behind it.
    """
    got: Counter = Counter()
    for a, b in paragraphs(text):
        for m in _STOP.finditer(text, a, b):
            i = m.start()
            t = _token(text, a, i)
            if not t or t[0].isdigit() or text[i - 1] == ".":
                continue
            token = _norm(t[0])
            kind, word, k = _after(text, i + 1, b)
            if asked is not None and kind not in ("low", "final"):
                e = i + 1
                while e < b and text[e] in _CLOSERS:
                    e += 1
                asked.add(token)
                if e > i + 1:
                    _, word, _ = _after(text, e, b)
                if word[:1].isupper():
                    asked.update((word, word.lower()))
            if kind == "other" or (k == i + 1 and kind not in ("low", "final")):
                continue
            got[token, kind] += 1
    return got


def count_words(text: str) -> Counter:
    """(token, field) counts of the words of a masked text, which may be several texts joined."""
    got: Counter = Counter()
    for (word, stop), n in Counter(_WORD_STOP.findall(text)).items():
        if not stop:
            got[word, "plain"] += n
        if word[0].islower():
            got[word, "small"] += n
    # a capital right behind a small word and a space stands within a sentence
    for word, n in Counter(_INNER.findall(text)).items():
        got[word, "name"] += n
    return got


def count_tokens(text: str) -> Counter:
    """(token, field) counts of one document; tokens with a stop keep their case, words in small letters have field ``small``."""
    text = masked(text)
    return count_stops(text) + count_words(text)


class Judge:
    """Answers for one document: its own counts first, the corpus where those are silent."""

    def __init__(self, text: str, corpus: Callable[[str], dict[str, int]]) -> None:
        self.text, self.corpus = text, corpus
        self.kept: Counter | None = None

    @property
    def own(self) -> Counter:
        if self.kept is None:
            self.kept = count_tokens(self.text)
        return self.kept

    def counts(self, token: str) -> list[dict[str, int]]:
        return [{f: self.own[token, f] for f in FIELDS}, self.corpus(token)]

    def is_small(self, word: str) -> bool:
        """Whether a word also stands in small letters."""
        return any(c.get("small", 0) > 0 for c in self.counts(word.lower()))

    def is_name(self, word: str) -> bool:
        """Whether a word stands with a capital within sentences and hardly ever in small letters."""
        return any(c.get("name", 0) > 10 * low.get("small", 0) for c, low in zip(self.counts(word), self.counts(word.lower())))

    def abbreviation(self, token: str) -> bool:
        long = len(token.replace(".", "")) > 7
        everywhere = self.corpus(token)
        # the corpus has the document in it: what is clear nowhere is not clear in the document
        if everywhere and not everywhere["low"] + everywhere["digit"] and not token[:1].isupper() and "." not in token and (long or token not in NEVER_FINAL and token not in MAY_END):
            return False
        for c in self.counts(token):
            clear = c.get("low", 0) + c.get("digit", 0)
            dots = clear + c.get("cap", 0) + c.get("final", 0)
            plain = c.get("plain", 0)
            if long:  # so long a token needs more evidence
                if clear >= 3 and clear >= 0.5 * dots and not plain:
                    return True
                continue
            if "." in token and clear:
                return True
            if clear and clear >= 0.1 * dots and plain <= dots:
                return True
            if dots >= 4 and not plain and c.get("final", 0) <= 0.02 * dots and len(token) <= 5 and token[:1].isupper():
                return True
            if plain > 2 * dots and dots:
                return False
        if long:
            return False
        if re.fullmatch(r"(?:[^\W\d_]\.)*[^\W\d_]", token) and token.isupper():
            return True  # initials
        return token.lower() in NEVER_FINAL or token.lower() in MAY_END

    def may_end(self, token: str) -> bool | None:
        """Whether an abbreviation ends sentences: seen at the end of paragraphs, or often and never there; None if too seldom."""
        for c in self.counts(token):
            dots = sum(c.get(f, 0) for f in ("low", "digit", "cap", "final"))
            if dots and c.get("final", 0) >= max(2, 0.02 * dots):
                return True
            if dots >= 20 and c.get("final", 0) < 0.005 * dots:
                return False
        return None

    def stop_ends(self, text: str, a: int, i: int, kind: str, word: str) -> bool:
        """Whether the single full stop at ``i`` ends its sentence; ``kind`` and ``word`` follow it."""
        if kind == "low":
            return False
        t = _token(text, a, i)
        if not t:
            return True
        token = _norm(t[0])
        if len(token) <= 2 and len(word) == 1 and re.match(r"\s+[^\W\d_]\.", text[i + 1 : i + 6]):
            return False  # a chain of single letters goes on
        if token.isdigit():
            return not (len(token) <= 2 and word.lower() in MONTHS)
        if _INDIC.match(token) or _THAI.match(token):
            return not (self.abbreviation(token) or len(token) <= 4)
        if not self.abbreviation(token):
            return True
        if kind == "digit":
            return False
        if kind == "cap":
            if len(word) == 1 and "." not in token and len(token) == 1:
                return False
            ends = self.may_end(token)
            if ends is not None:
                return ends
            low = token.lower()
            if low in MAY_END:
                return not self.is_name(word)
            # no title, so the word behind it tells: a sentence begins with a word that is no name
            return len(token) > 1 and low not in TITLES and self.is_small(word) and not self.is_name(word)
        return True


_QUOTES = re.compile(f"[{re.escape(chr(34) + ''.join(_PAIRS) + ''.join(_PAIRS.values()))}]")


def _pairs(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Matched quotations and brackets of a paragraph, outermost first."""
    found, stack, straight = [], [], -1
    for m in _QUOTES.finditer(text, a, b):
        i, c = m.start(), m[0]
        if c == '"':
            before = text[i - 1] if i > a else " "
            opens = before.isspace() or before in "([—–-“«„「（"
            if straight >= 0 and not (opens and i + 1 < b and not text[i + 1].isspace() and text[i - 1 : i].isspace()):
                found.append((straight, i))
                straight = -1
            elif opens or straight < 0:
                straight = i
        elif stack and c in _PAIRS[text[stack[-1]]]:
            found.append((stack.pop(), i))
        elif c in _PAIRS:
            if c == "»" and not any(text[j] == "»" for j in stack) and text.find("«", i + 1, b) < 0:
                continue
            stack.append(i)
        elif c in "”»」』）)]" and stack:
            for n in range(len(stack) - 1, -1, -1):
                if c in _PAIRS[text[stack[n]]]:
                    found.append((stack[n], i))
                    del stack[n:]
                    break
    found.sort()
    outer, reach = [], -1
    for p in found:
        if p[0] > reach:
            outer.append(p)
            reach = p[1]
    return outer


def _reported(text: str, k: int, b: int, first: bool, closer: str) -> bool:
    """Whether the words after a quotation in a script without capitals belong to its sentence."""
    rest = text[k:b].lstrip()
    if rest[:1] in "とっ" and closer in "」』":
        return True
    if _EAST.match(rest):
        if closer in "」』" and not first:
            return "぀" <= rest[0] <= "ゟ"
        return first and bool(_ZH_SAID.match(rest))
    if _INDIC.match(rest):
        return first and bool(_HI_SAID.match(rest))
    return False


def sentence_ends(text: str, judge: Judge) -> list[int]:
    """End positions (code points from the start of ``text``) of the sentences of ``text``, in order."""
    text = masked(text)
    ends: list[int] = []
    for a, b in paragraphs(text):
        if not _MARKUP.match(text, a, b):
            ends += _paragraph_ends(text, a, b, judge)
        if not ends or ends[-1] != b:
            ends.append(b)
    return ends


def _paragraph_ends(text: str, a: int, b: int, judge: Judge) -> list[int]:
    ends: list[int] = []
    start = a
    pairs = _pairs(text, a, b)
    opens = [p[0] for p in pairs]
    cuts = [(m.start(), m.end(), m[0]) for m in _MARK.finditer(text, a, b)]
    if _THAI.search(text, a, b):
        cuts += _thai_gaps(text, a, b)
        cuts.sort()
    for i, j, mark in cuts:
        if i < start:
            continue
        if mark == " ":
            ends.append(i)
            start = i
            continue
        # where the mark stands: inside a pair only its last mark counts
        n = bisect_left(opens, i) - 1
        inside = n >= 0 and pairs[n][0] < i < pairs[n][1]
        e = j
        closer, first = "", False
        if inside:
            close = pairs[n][1]
            if text[j:close].strip():
                continue
            begin = start
            while begin < b and text[begin].isspace():
                begin += 1
            first = pairs[n][0] <= begin or not text[begin : pairs[n][0]].strip("—–-*_ ")
            if text[close] in ")]）" and not first:
                continue
            e, closer = close + 1, text[close]
        while e < b and text[e] in _CLOSERS and (text[e] != '"' or text[e - 1] != " "):
            if text[e] in "“«'*_" and (e + 1 < b and not text[e + 1].isspace()):
                break
            closer = text[e]
            e += 1
        kind, word, k = _after(text, e, b)
        if kind == "final":
            continue
        if mark[0] in "。！？｡":
            if closer and _reported(text, e, b, first, closer):
                continue
            if text[e] in "，、；：,":
                continue
        elif mark[0] in "।॥؟۔።":
            if closer and _reported(text, e, b, first, closer):
                continue
        else:
            if kind == "low":
                continue
            dots = mark.strip(".…") == "" and (len(mark) > 1 or mark == "…")
            if dots and (_EAST.match(text, k) or (k == e and kind != "other")):
                continue
            if e == k and not closer and not _EAST.match(text, k):
                continue  # inside a number, a name of a file, an address
            if closer and _reported(text, e, b, first, closer):
                continue
            if mark == "." and not judge.stop_ends(text, a, i, kind, word):
                continue
        ends.append(e)
        start = e
    return ends


def _thai_gaps(text: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """Spaces between Thai letters with a clause on either side: Thai ends a sentence with a space."""
    gaps, last = [], a
    for m in re.finditer(r"(?<=[ก-ฯะ-ฺเ-๎])\s+(?=[ก-ฮเ-ไ])", text[a:b]):
        i = a + m.start()
        nxt = re.search(r"\s", text[a + m.end() : b])
        ahead = nxt.start() if nxt else b - a - m.end()
        if text[i - 1] not in "ๆฯ" and i - last >= 12 and (ahead >= 12 or re.match(r"\S+\s+[\d(]", text[a + m.end() : b])):
            gaps.append((i, a + m.end(), " "))
            last = a + m.end()
    return gaps


# ---- Spark


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with a key: a token that the document may ask about. Rows without: the counts of a token in the batch."""
    for pdf in batches:
        total: Counter = Counter()
        texts = [masked(x) if x else "" for x in pdf["text"]]
        keys, tokens = [], []
        for key, x in zip(pdf["key"], texts):
            asked: set[str] = set()
            total.update(count_stops(x, asked))
            keys += [key] * len(asked)
            tokens += asked
        total.update(count_words("\n\n".join(texts)))
        rows: dict[str, list[int]] = {}
        for (tok, f), n in total.items():
            rows.setdefault(tok, [0] * len(FIELDS))[FIELDS.index(f)] += n
        n = len(keys)
        out = {"key": pd.Series(keys + [None] * len(rows), dtype=object), "token": tokens + list(rows)}
        for i, f in enumerate(FIELDS):
            out[f] = np.array([0] * n + [v[i] for v in rows.values()], np.int64)
        yield pd.DataFrame(out)


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, ends = [], []
        for key, text, known in zip(pdf["key"], pdf["text"], pdf["known"]):
            if not text:
                continue
            corpus = {k["token"]: dict(zip(FIELDS, (k[f] for f in FIELDS))) for k in known} if known is not None else {}
            got = sentence_ends(text, Judge(text, lambda t, c=corpus: c.get(t, {})))
            keys += [key] * len(got)
            ends += got
        yield pd.DataFrame({"key": pd.Series(keys, dtype=pdf["key"].dtype if len(pdf) else "int64"), "end_pos": pd.Series(ends, dtype="int32")})


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``end_pos`` (int): one row for each sentence of every text.

    ``end_pos`` is the number of code points from the start of the text to the sentence's last character, closing quotes
    and brackets included. ``key`` must be unique and not null; rows with null, empty or blank text give no row. Other
    columns are not read. Very long texts are worked on whole, in one task each.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), T.StructField("token", T.StringType()), *(T.StructField(f, T.LongType()) for f in FIELDS)])
    survey = cut_lineage(docs.mapInPandas(filled(_survey), schema))
    counts = survey.filter("key IS NULL").groupBy("token").agg(*(F.sum(f).alias(f) for f in FIELDS))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
    asked = survey.filter("key IS NOT NULL").select("key", "token", F.pmod(F.xxhash64("key"), F.lit(SALT)).alias("salt"))
    known = asked.join(salted, ["token", "salt"]).groupBy("key").agg(F.collect_list(F.struct("token", *FIELDS)).alias("known"))
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), T.StructField("end_pos", T.IntegerType())])
    return docs.join(known, "key", "left").mapInPandas(filled(_split), schema).withColumnRenamed("key", key)


def sentence_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``sentence_no`` (from 1), ``end_pos``, ``sentence``: the sentences themselves, in order."""
    ends = split_sentences(df, key, text).groupBy(key).agg(F.sort_array(F.collect_list("end_pos")).alias("ends"))
    rows = df.select(key, F.col(text).alias("text")).join(ends, key).select(key, "text", "ends", F.posexplode("ends").alias("i", "end_pos"))
    start = F.when(F.col("i") == 0, 0).otherwise(F.col("ends")[F.greatest(F.col("i") - 1, F.lit(0))])
    piece = F.expr("substring(text, s + 1, end_pos - s)")
    cleaned = F.regexp_replace(F.regexp_replace(piece, r"\[\[beat\]\]|(?m)^[^\S\n]*(?:-{3,}|\*{3,})[^\S\n]*$", ""), r"(?U)\A\s+|\s+\z", "")
    return rows.withColumn("s", start).select(key, (F.col("i") + 1).alias("sentence_no"), "end_pos", cleaned.alias("sentence"))
