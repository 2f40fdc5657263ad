"""Problem 9: personal information inside free text.

Detection runs on whole texts in Arrow batches and gives spans. Numbers, addresses and emails are told by their forms
and the words beside them. Names need evidence: a title, a salutation or another cue; the first names and surnames met
there, counted over the corpus, then carry over to names without a cue, and words that the corpus also writes in small
letters are no names. Names in capitals are judged by the same evidence. It is joined on the token, repeated
for the sake of common names; it is never collected. In scripts without capitals only names with a title or another
cue can be found.

Replacement is by keyed surrogates: each entity, or each part of a name, gets a code from a keyed hash, the same
wherever it occurs and however it is written (``Last, First`` like ``First Last``). Codes are checked for collisions over
the whole corpus, and entities that share one get a longer code, until none is shared. A code becomes a typed placeholder or, with
``style="surrogate"``, a made-up value of the same gender, script and format.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import filled
from ..session import cut_lineage
from .joins import beside

#: Characters of the longest cue that may stand before a name, and of a line before a number in which a telephone cue counts.
CUE_REACH, PHONE_REACH = 40, 80

_S = r"[ \u00A0\u2007\u202F]?\n?[ ]?"  # at most one gap, a line break included
_G = r"(?:[ \u00A0\u202F]*\n[ ]*|[ \u00A0\u2007\u202F])"

# ---- emails

_LABEL = r"[\p{L}\d](?:[\p{L}\d\-]*[\p{L}\d])?"
_AT = r"(?:[ ]?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\{(?:at|AT)\}|<(?:at|AT)>)[ ]?)"
_DOT = r"(?:[ ]?(?:\((?:dot|DOT|punkt|punto|point)\)|\[(?:dot|DOT|punkt|punto|point)\]|\{(?:dot|DOT)\})[ ]?|\.)"
EMAIL = regex.compile(
    rf"(?<![\w.+\-@])[\w](?:[\w.+\-]*[\w])?(?:[@＠]{_LABEL}(?:\.{_LABEL})*\.\p{{L}}{{2,}}|{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,}}"
    rf"|[ ](?:at|AT)[ ]{_LABEL}(?:[ ](?:dot|DOT)[ ]{_LABEL})+)(?![\w@])"
)

MAYBE_EMAIL = re.compile(r"[@＠]|[ (\[{<](?:at|AT)[ )\]}>]")  # without one there is none

# ---- identity numbers: forms that tell by themselves, and anything number-like behind a label

ID_FORMS = regex.compile(
    rf"(?<![\w\-./])(?:\p{{Lu}}{{2}}\d{{2}}(?:{_S}[\dA-Z]{{4}}){{3,7}}(?:{_S}[\dA-Z]{{1,4}})?(?![\w])"
    rf"|\p{{Lu}}{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}[A-D](?![\w])"
    rf"|\d{{3}}(?:-|{_G})\d{{2}}(?:-|{_G})\d{{4}}(?![\w\-])"
    r"|\d{6}[\-+]\d{4}(?![\w\-])|[A-Z]{1,2}\d{7,9}(?![\w\-])|[XYZ]?\d{7,8}[\-]?[A-Z](?![\w\-]))"
)
_ID_CUE = (
    r"(?:identity(?: card)?(?: number)?|passport(?: number| no\.?)?|social security(?: number)?|ssn|tax(?: id| number| identification number)?|national insurance(?: number)?|account(?: number| no\.?)?|iban"
    r"|ausweis(?:nummer)?|pass(?:nummer)?|steuer(?:nummer|-id)|kontonummer|personalausweis|pi[èe]ce d['’]identit[ée]|passeport|num[ée]ro fiscal|documento|pasaporte|dni|nie|cuenta|паспорт|инн|снилс|身份证(?:号码?)?|护照|パスポート|マイナンバー|पहचान संख्या|บัตรประชาชน)"
)
ID_LABELLED = regex.compile(rf"(?i:{_ID_CUE})(?:[ ](?:is|ist|lautet|es|est|porte le num[ée]ro|no\.?|number|nr\.?|n[°º.]+))*[ :#]*[ ]?((?-i:\p{{Lu}}{{0,3}})[ ]?\d(?:[ \-./]?[\dA-Z]){{5,25}})(?![\w])")

MAYBE_LABELLED = re.compile(r"\d(?:[ \-./]?[\dA-Z]){5}")

# ---- telephone numbers

MAYBE_PHONE = re.compile(r"\d(?:\W*\d){6}")

_SEP = rf"(?:[.\-/]|{_G})"
PHONE_FORMS = regex.compile(
    rf"(?<![\w.\-/+@#$€£])(?:(?:\+|00)\d{{1,3}}{_SEP}?(?:\(0?\d{{0,4}}\){_SEP}?)?\d(?:{_SEP}?\d){{5,12}}"
    rf"|1[3-9]\d{_SEP}?\d{{4}}{_SEP}?\d{{4}}"
    rf"|(?:1{_SEP})?\(?[2-9]\d{{2}}\)?{_SEP}\d{{3}}{_SEP}\d{{4}}"
    rf"|\(0\d{{1,4}}\){_SEP}?\d(?:{_SEP}?\d){{4,9}}"
    rf"|0\d{{1,4}}(?:{_SEP}\d{{2,8}}){{1,4}}"
    rf"|[6-9]\d{{2}}(?:{_SEP}\d{{2}}){{3}}|[6-9]\d{{2}}{_SEP}\d{{3}}{_SEP}\d{{3}})(?![\w\-]|[.,]\d|[ ]?%)"
)
PHONE_STRONG = regex.compile(rf"1[3-9]\d{_SEP}\d{{4}}{_SEP}\d{{4}}|(?:1{_SEP})?[2-9]\d\d{_SEP}\d{{3}}{_SEP}\d{{4}}|0\d{{1,4}}(?:{_SEP}\d{{2,8}}){{1,4}}")
PHONE_CUE = regex.compile(r"(?i)(?:tel(?:ephone|efon|éfono|\.)?|phone|call|mobile|cell|fax|number is|reach me|numéro|teléfono|erreichbar|telefonisch|телефон|тел\.|電話(?:番号)?|电话|फ़ोन|फोन|โทร|contact)[^\n]{0,60}\Z")

# ---- addresses

_NAME = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*"
_TOWN = rf"{_NAME}(?:[ ](?:am|an|der|upon|on|sur|de|la|del|le)[ ]{_NAME}|[ ](?!ZZ\b)(?:{_NAME})(?=,?[ ]\p{{Lu}}{{2}}[ ]?\d)|)"
_STREET_WORD = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Row|Close|Way|Place|Square|Terrace|Crescent|Boulevard|Blvd\.?|Hill|Walk|Mews|Gardens|Parkway|Highway)"
_ZIP = r"(?:\p{Lu}{2}(?:[ ]|\n)\d{5}(?:-\d{4})?|\p{Lu}{1,2}\d{1,2}\p{Lu}?(?:[ ]|\n)\d\p{Lu}{2}|\d{5})"
_C = rf",?{_G}"
_FLAT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Wohnung|Appt\.?|Piso)[ ]\d+\p{L}?)"
ADDRESS = regex.compile(
    rf"(?<![\w\-./])(?:(?:P\.?[ ]?O\.?[ ]Box|Postfach|Apartado|Boîte postale|BP|а/я)[ ]\d+{_C}(?:\d{{5}}{_G})?{_TOWN}(?:{_C}{_ZIP})?"
    rf"|(?:{_FLAT}{_C})?\d{{1,5}}\p{{L}}?{_G}{_NAME}(?:{_G}{_NAME}){{0,2}}{_G}{_STREET_WORD}(?:{_C}{_FLAT})?{_C}{_TOWN}(?:{_C}{_ZIP})?"
    rf"|(?:{_NAME}|{_NAME}[ \-])(?<=stra(?:ß|ss)e|Stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ring|damm|ufer){_G}\d{{1,4}}[ ]?\p{{Ll}}?{_C}(?:\d{{5}}{_G})?{_TOWN}"
    rf"|(?:Am|An der|Auf dem|Im|Zum|Zur|Unter den){_G}{_NAME}{_G}\d{{1,4}}[ ]?\p{{Ll}}?{_C}(?:\d{{5}}{_G})?{_TOWN}"
    rf"|\d{{1,4}}(?:[ ]?(?:bis|ter))?,?{_G}(?:rue|avenue|boulevard|place|chemin|quai|impasse|allée|route|cours){_G}(?:(?:de la|de l['’]|des|du|de)[ ]?)?{_NAME}(?:{_G}{_NAME})?{_C}(?:\d{{5}}{_G})?{_TOWN}"
    rf"|(?:Calle|C/|Avenida|Av\.|Avda\.|Plaza|Paseo|Camino|Carrera|Ronda|Via|Viale|Piazza){_G}(?:(?:de la|del|de|los|las)[ ])?{_NAME}(?:{_G}{_NAME})?,?{_G}\d{{1,4}}(?:{_C}\d{{1,2}}[.]?[ºª°](?:{_G}\p{{Lu}}(?![\w]))?)?{_C}(?:\d{{5}}{_G})?{_TOWN}"
    rf"|(?:ул\.|улица|пр\.|проспект|пер\.){_G}{_NAME},?{_G}(?:д\.[ ]?)?\d{{1,4}}(?:{_C}кв\.[ ]?\d+)?{_C}(?:г\.[ ]?)?{_TOWN})"
)

# ---- names

TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "mx": "", "dr": "", "prof": "", "sir": "m", "dame": "f", "herr": "m", "hr": "m", "frau": "f", "fr": "f", "monsieur": "m", "mme": "f", "mlle": "f", "madame": "f", "sr": "m", "sra": "f", "srta": "f", "señor": "m", "señora": "f", "don": "m", "doña": "f", "г-н": "m", "г-жа": "f", "господин": "m", "госпожа": "f"}
_W = r"\p{Lu}\p{Ll}['’\p{L}]*\p{Ll}(?:-\p{Lu}\p{Ll}+)*"
_TITLE = r"(?<![\w])(?:(?:" + "|".join(sorted((regex.escape(t[0].upper()) + regex.escape(t[1:]) for t in TITLES), key=len, reverse=True)) + r")(?:\.|(?![\w])))"
NAME = regex.compile(
    rf"(?:(?P<title>{_TITLE}{_G})+)?(?<![\w\-’'@./])(?:(?P<l1>{_W}),{_G}(?P<f1>{_W}|\p{{Lu}}\.)(?:{_G}\p{{Lu}}\.)?(?![\w@\-])"
    rf"|(?P<f2>{_W}|\p{{Lu}}\.)(?P<mid>(?:{_G}\p{{Lu}}\.){{0,2}}){_G}(?P<l2>{_W})(?![\w@\-])|(?P<l3>{_W})(?![\w@\-]))",
)
# a name in capitals, in either order
NAME_CAPS = regex.compile(
    rf"(?<![\w\-'’@./])(?:(?P<l1>\p{{Lu}}{{2,}}(?:['’\-]\p{{Lu}}+)*),{_G}(?P<f1>\p{{Lu}}{{2,}}(?:-\p{{Lu}}+)*|\p{{Lu}}\.)|(?P<f2>\p{{Lu}}{{2,}}(?:-\p{{Lu}}+)*|\p{{Lu}}\.)(?:{_G}\p{{Lu}}\.){{0,2}}{_G}(?P<l2>\p{{Lu}}{{2,}}(?:['’\-]\p{{Lu}}+)*))(?![\w@\-])"
)
# Titles and cues beside names in scripts without capitals, and words that stand there without being names.
NAME_CUED = regex.compile(
    r"(?:我叫|我的名字是|名字[是:：]|姓名[是为:：]|联系人[是为:：]?)[ ]?(?P<a>\p{Han}{2,4}(?:·\p{Han}{1,6})*)(?=[，。,.；;、！？\s]|$)|(?<![\p{Han}])(?P<b>\p{Han}{1,4})(?=先生|女士|小姐)"
    r"|(?:名前は|氏名[は:：]|担当者?[は:：])[ ]?(?P<c>[\p{Han}\p{Hiragana}\p{Katakana}ー・]{2,10}?)(?=です|と申|といい|[。、\s]|$)|(?<![\p{Han}\p{Katakana}ー])(?P<d>\p{Han}{1,4}|[\p{Katakana}ー]{2,8})(?=さん|様(?![子々式])|氏(?![名族]))"
    r"|(?:श्रीमती|श्री|सुश्री|कुमारी|डॉ\.?|मेरा नाम)[ ](?P<e>[\p{Devanagari}]+(?:[ ](?!(?:है|ने|को|से|का|की|के|हैं|और)\b)[\p{Devanagari}]+)?)|(?:คุณ|นางสาว|นาย|นาง|ชื่อ)[ ]?(?P<f>[ก-๎]{2,20}(?:[ ][ก-๎]{2,20})?)(?=[\s,.]|$)"
)
NO_NAMES = {"お客", "皆", "奥", "神", "王", "客", "各位", "同", "両", "彼", "某", "一", "女", "老"}
CUE = regex.compile(
    r"(?:(?:According to|Narrator|Narrated by|Read by|Bill(?:ed)? (?:it )?to|[Nn]ame on it is|[Mm]y name is|[Nn]ame:|[Ss]igned(?:,| by)?|[Dd]ear|Attn:?|[Cc]/o|Contact:|Sprecher(?:in)?:|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|Меня зовут)[ ]"
    r"|^(?:From|To|Cc|Bcc|Reply-To|Von|An|De|À|Para|От|Кому):[ ]|(?<=[\s>])(?:From|Von|De|От):[ ]"
    r"|(?:[Rr]egards|[Ss]incerely|[Cc]heers|[Tt]hanks|[Tt]hank you|[Bb]est(?: wishes)?|Yours(?: truly)?|Grüßen|Grüße|Gruß|[Cc]ordialement|[Ss]alutations|Bien à vous|[Ss]aludos|[Aa]tentamente|Un saludo|[Сс] уважением),?[ ]*\n[ ]*)\Z",
    regex.M,
)
WORD = regex.compile(r"(?<![\p{L}\p{M}])\p{Ll}[\p{L}\p{M}]*(?:-\p{L}[\p{L}\p{M}]*)*")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("kind", "found", "proof", "first", "last", "gender")])


def detect(text: str) -> list[tuple]:
    """Spans of one text as in :data:`SPAN`; ``proof`` is ``sure``, or for names ``title``, ``cue`` or ``none``."""
    taken: list[tuple[int, int]] = []
    out: list[tuple] = []

    def put(a: int, b: int, kind: str, proof: str = "sure", first: str = "", last: str = "", gender: str = "") -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind, text[a:b], proof, first, last, gender))

    if MAYBE_EMAIL.search(text):
        for m in EMAIL.finditer(text):
            put(m.start(), m.end(), "email")
    for m in ADDRESS.finditer(text):
        put(m.start(), m.end(), "address")
    for m in ID_FORMS.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if digits >= 6:
            put(m.start(), m.end(), "id_number")
    for m in PHONE_FORMS.finditer(text) if MAYBE_PHONE.search(text) else ():
        digits = sum(c.isdigit() for c in m[0])
        if not 7 <= digits <= 15 or regex.match(r"\d{4}-\d\d-\d\d(?!\d)", m[0]):
            continue
        strong = m[0][0] in "+(" or m[0].startswith("00") or PHONE_STRONG.fullmatch(m[0])
        if (strong and digits >= 8) or PHONE_CUE.search(text[max(0, m.start() - PHONE_REACH) : m.start()]):
            a, b = m.span()
            if m[0].count(")") > m[0].count("(") and text[b - 1] == ")":
                b -= 1
            put(a, b, "phone")
    for m in ID_LABELLED.finditer(text) if MAYBE_LABELLED.search(text) else ():
        put(m.start(1), m.end(1), "id_number")
    at = 0
    while m := NAME.search(text, at):
        if not m["title"] and m["l3"]:
            at = m.end("l3")
            continue
        title = regex.sub(r"[\s.]", "", m["title"]).lower() if m["title"] else ""
        cue = bool(CUE.search(text[max(0, m.start() - CUE_REACH) : m.start()])) or bool(regex.match(r"[ ]<[^\s>]+@", text[m.end() : m.end() + 60]))
        if m["l1"]:
            a, b, first, last = m.start("l1"), m.end(), m["f1"], m["l1"]
        elif m["f2"]:
            a, b, first, last = m.start("f2"), m.end(), m["f2"], m["l2"]
        else:
            a, b, first, last = *m.span("l3"), "", m["l3"]
        if first or title:
            proof = "title" if title else "cue" if cue else "none"
            if all(b <= x or a >= y for x, y in taken):
                out.append((a, b, "name", text[a:b], proof, first, last, TITLES.get(title, "")))
        # without a cue the next word may begin a name of its own
        at = b if title or cue and first else m.end("l1") if m["l1"] else m.end("f2") if m["f2"] else b
    at = 0
    while m := NAME_CAPS.search(text, at):
        f, l = ("f1", "l1") if m["l1"] else ("f2", "l2")
        cue = bool(CUE.search(text[max(0, m.start() - CUE_REACH) : m.start()]))
        if all(m.end() <= x or m.start() >= y for x, y in taken):
            out.append((m.start(), m.end(), "name", m[0], "cue" if cue else "none", m[f].title(), m[l].title(), ""))
        at = m.end() if cue else min(m.end(f), m.end(l))
    for m in NAME_CUED.finditer(text):
        kind = m.lastgroup
        if m[kind] not in NO_NAMES and all(m.end(kind) <= x or m.start(kind) >= y for x, y in taken):
            out.append((*m.span(kind), "name", m[kind], "title", "", m[kind], ""))
    return sorted(out)


#: Kind of the rows that count words in small letters.
_SMALL = "#small"


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The spans of every text, and the words in small letters with their number in the batch."""
    names = [f.name for f in SPAN.fields]
    for pdf in batches:
        rows = [(k, *s) for k, t in zip(pdf["key"], pdf["text"]) if isinstance(t, str) for s in detect(t)]
        yield pd.DataFrame(rows, columns=["key", *names])
        seen: Counter = Counter()
        for t in pdf["text"]:
            if isinstance(t, str):
                seen.update(WORD.findall(EMAIL.sub(" ", t) if MAYBE_EMAIL.search(t) else t))
        if seen:
            rows = {"key": [None] * len(seen), "start": list(seen.values()), "stop": 0, "kind": _SMALL, "found": list(seen), **{n: "" for n in names[4:]}}
            yield pd.DataFrame(rows)


def find_entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``start``, ``stop``, ``kind``, ``found``, ``first``, ``last``, ``gender``: every entity of every text.

    ``kind`` is email, phone, id_number, address or name; ``found`` is the text as it stands there, from code point
    ``start`` (from 0) to before ``stop``. Spans of one text do not overlap. Rows with null or empty text give nothing,
    repeated rows give their spans again; other columns are not read.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["key"], *SPAN.fields])
    # used many times below: the texts are searched once
    read = cut_lineage(docs.mapInPandas(filled(_spans), schema))
    spans = read.filter(F.col("kind") != _SMALL)
    sure = spans.filter("kind != 'name'").select("key", "start", "stop", "kind", "found", "first", "last", "gender")
    names = spans.filter("kind = 'name'")
    # tokens that stand in small letters elsewhere, and first names and surnames met beside a cue
    tokens = names.select(F.explode(F.array("first", "last")).alias("token")).filter("token != ''").distinct().withColumn("low", F.lower("token"))
    small = read.filter(F.col("kind") == _SMALL).groupBy(F.col("found").alias("low")).agg(F.sum(F.col("start").cast("long")).alias("small"))
    cued = names.filter("proof = 'cue' AND first NOT RLIKE '^.[.]$'")
    firsts = cued.groupBy(F.col("first").alias("token")).agg(F.count(F.lit(1)).alias("firsts"))
    lasts = names.filter("proof IN ('cue', 'title')").groupBy(F.col("last").alias("token")).agg(F.count(F.lit(1)).alias("lasts"))
    proof = tokens.join(small, "low", "left").join(firsts, "token", "left").join(lasts, "token", "left").select("token", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("small", "firsts", "lasts")))
    proof = cut_lineage(proof)
    of_first = proof.select(F.col("token").alias("first"), F.col("small").alias("f_small"), F.col("firsts").alias("f_first"))
    of_last = proof.select(F.col("token").alias("last"), F.col("small").alias("l_small"), F.col("lasts").alias("l_last"), F.col("firsts").alias("l_first"))
    judged = beside(beside(names, of_first, ["first"], ["key", "start"]), of_last, ["last"], ["key", "start"]).na.fill(0, ["f_small", "f_first", "l_small", "l_last", "l_first"])
    initial = F.col("first").rlike(r"^.\.$")
    known = (F.col("l_last") >= 2) & ((F.col("f_first") >= 2) | initial)
    good = (
        F.when(F.col("proof") == "cue", ~((F.col("l_small") > F.col("l_last")) & ((F.col("f_small") > F.col("f_first")) | initial)) & ~((F.col("f_small") > 3 * F.col("f_first")) & ~initial))
        .when(F.col("proof") == "title", F.lit(True))
        .otherwise(known & (F.col("l_small") <= F.col("l_last")) & (F.col("f_small") <= F.col("f_first")))
    )
    # behind a title "Ms First Verb": only the first word, if the second is no surname
    alone = (F.col("proof") == "title") & (F.col("first") != "") & ~initial & ((F.col("l_small") > 0) | ((F.col("l_last") < 2) & (F.col("f_first") < 1)))
    kept = judged.filter(good).select(
        "key", "start", F.when(alone, F.col("start") + F.length("first")).otherwise(F.col("stop")).cast("int").alias("stop"), "kind",
        F.when(alone, F.col("first")).otherwise(F.col("found")).alias("found"), F.when(alone, F.lit("")).otherwise(F.col("first")).alias("first"), F.when(alone, F.col("first")).otherwise(F.col("last")).alias("last"), "gender",
    )
    return sure.unionByName(kept).withColumnRenamed("key", key)


# ---- surrogates

# Given names for made-up persons.
GIVEN = {
    "f": ["Alba", "Britt", "Carla", "Dora", "Edith", "Flora", "Gisela", "Helga", "Ilse", "Judith", "Karin", "Laura", "Mira", "Nora", "Olga", "Petra", "Ruth", "Silvia", "Tilda", "Vera"],
    "m": ["Albert", "Bruno", "Carl", "Dirk", "Emil", "Frank", "Georg", "Henrik", "Igor", "Jakob", "Karl", "Lars", "Marek", "Nils", "Otto", "Pavel", "Rolf", "Stefan", "Theo", "Viktor"],
    "": ["Alex", "Bo", "Charlie", "Dominique", "Eden", "Frankie", "Gale", "Harper", "Indigo", "Jules", "Kim", "Luca", "Morgan", "Nico", "Quinn", "Robin", "Sasha", "Toni", "Val", "Yael"],
}
# The same for names in other scripts.
GIVEN_IN = {
    "cyrillic": {
        "f": ["Алла", "Белла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Зоя", "Инна", "Кира", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Тамара", "Ульяна", "Фаина", "Яна"],
        "m": ["Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Макар", "Назар", "Олег", "Павел", "Роман", "Степан", "Тимур", "Фёдор", "Эдуард", "Юрий"],
        "": ["Саша", "Женя", "Валя", "Шура", "Слава", "Паша", "Тоня", "Вася", "Миша", "Сима"],
    },
    "greek": {
        "f": ["Άννα", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία", "Φωτεινή"],
        "m": ["Ανδρέας", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Λευτέρης", "Μιχάλης", "Νίκος", "Πέτρος", "Στέφανος"],
        "": ["Αλέξ", "Βαλ", "Γκαμπριέλ", "Κιμ", "Νικό", "Ρόμπιν", "Σάσα", "Τζο"],
    },
}
_SYLLABLES = {"latin": ["ba", "den", "fo", "gar", "hol", "ke", "lin", "mor", "na", "pel", "ros", "sta", "tur", "ven", "wal", "zim"], "cyrillic": ["ба", "ден", "фо", "гар", "хол", "ке", "лин", "мор", "на", "пел", "рос", "ста", "тур", "вен", "вал", "зим"], "greek": ["βα", "δεν", "φο", "γαρ", "χολ", "κε", "λιν", "μορ", "να", "πελ", "ρος", "στα", "τουρ", "βεν", "βαλ", "ζιμ"]}
_B32 = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def norm_entity(kind: str, found: str) -> str:
    """One form for the ways of writing an entity."""
    s = regex.sub(r"\s+", " ", found.strip()).lower()
    if kind in ("phone", "id_number"):
        s = regex.sub(r"[^\p{L}\d+]", "", s)
    elif kind == "email":
        s = regex.sub(r"\s*[\(\[{<](?:dot|punkt|punto|point)[\)\]}>]\s*| dot ", ".", regex.sub(r"\s*[\(\[{<]at[\)\]}>]\s*| at |＠", "@", s))
    elif kind == "address":
        s = regex.sub(r"[,.]", "", s)
    return s


def code(secret: str, kind: str, value: str, size: int = 10) -> str:
    """A keyed code of ``size`` signs; a longer one begins with the shorter."""
    n = int.from_bytes(hmac.new(secret.encode(), f"{kind}\x1f{value}".encode(), hashlib.sha256).digest(), "big")
    return "".join(_B32[(n >> (5 * i)) & 31] for i in range(size))


@lru_cache(maxsize=None)
def _pool(c: str) -> str:
    """The letters that may stand for a letter: those near it of its script and case."""
    script, case = unicodedata.name(c, "").split(" ")[0], unicodedata.category(c)
    if script == "LATIN" and case in ("Lu", "Ll"):
        return "abcdefghijklmnopqrstuvwxyz".upper() if case == "Lu" else "abcdefghijklmnopqrstuvwxyz"
    if script == "CYRILLIC" and case in ("Lu", "Ll"):
        return "абвгдежзийклмнопрстуфхцчшщъыьэюя".upper() if case == "Lu" else "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    block = [chr(x) for x in range(ord(c) & ~127, (ord(c) & ~127) + 128)]
    return "".join(x for x in block if unicodedata.category(x) == case and unicodedata.name(x, "").split(" ")[0] == script)


def _digits(secret: str, kind: str, value: str, like: str) -> str:
    """``like`` with its letters and digits replaced by others of their script and case, its signs kept."""
    h = hmac.new(secret.encode(), f"form\x1f{kind}\x1f{value}".encode(), hashlib.sha512).digest() * (1 + len(like) // 32)
    out, n = [], 0
    for c in like:
        if c.isdecimal():
            out.append(chr(ord(c) - unicodedata.decimal(c) + h[n] % 10))
        elif c.isdigit():
            out.append(str(h[n] % 10))
        elif c.isalpha():
            pool = _pool(c)
            out.append(pool[h[n] % len(pool)])
        else:
            out.append(c)
            continue
        n += 1
    return "".join(out)


def _script(like: str) -> str:
    return next((k for k in ("cyrillic", "greek", "latin") if regex.search(rf"\p{{{k}}}", like)), "")


def _surname(secret: str, value: str, like: str, size: int) -> str:
    kind = _script(like)
    if not kind:
        return _digits(secret, "surname", value + "+" * (size - 12), like)
    c = code(secret, "surname", value, size)
    return "".join(_SYLLABLES[kind][_B32.index(x) % 16] for x in c[: max(4, size // 3)]).capitalize()


def surrogate(secret: str, kind: str, found: str, first: str, last: str, gender: str, size: int = 12) -> str:
    """A made-up value for an entity in its format; equal entities get equal ones."""
    if kind == "name" and last not in found and last.upper() in found:  # written in capitals
        return surrogate(secret, kind, found.replace(last.upper(), last).replace(first.upper(), first), first, last, gender, size).upper()
    if kind != "name":
        value = norm_entity(kind, found)
        if kind == "email":
            return f"user-{code(secret, kind, value, size).lower()}@example.invalid"
        return _digits(secret, kind, value + "+" * (size - 12), found)
    new_last = _surname(secret, last.lower(), last, 12 if first else size)
    if not first:
        return found.replace(last, new_last)
    if first.endswith("."):
        return found.replace(last, new_last).replace(first, f"{code(secret, 'initial', first + last.lower())[0]}.", 1)
    if script := _script(first):
        pool = GIVEN_IN.get(script, GIVEN)[gender or _gender(first)]
        new_first = pool[int(hmac.new(secret.encode(), first.lower().encode(), hashlib.sha256).hexdigest(), 16) % len(pool)]
    else:
        new_first = _digits(secret, "given", first.lower(), first)
    if size > 12:  # its plain form is taken by another person
        new_first += f" {'. '.join(c for c in code(secret, 'name', f'{last}|{first}'.lower()) if c.isalpha())[:4]}"
    parts = sorted([(found.find(first), first, new_first), (found.find(last), last, new_last)], reverse=True)
    for at, old, new in parts:
        found = found[:at] + new + found[at + len(old) :]
    return found


def _gender(first: str) -> str:
    """The gender of a first name that never stands behind a title that tells it."""
    for given in (GIVEN, *GIVEN_IN.values()):
        for g in ("f", "m"):
            if first in given[g]:
                return g
    return "f" if regex.search(r"(?:a|ia|ine|elle|ette)\Z|[ая]\Z", first.lower()) else ""


def _with_genders(found: DataFrame) -> DataFrame:
    """``found`` with the gender that titles give a person, else a first name, most often in the corpus: one for a person."""
    person, name = [F.lower("first").alias("_first"), F.lower("last").alias("_last")], [F.lower("first").alias("_first")]
    votes = F.count_if(F.col("gender") == "f") - F.count_if(F.col("gender") == "m")
    told = found.filter("kind = 'name' AND first != '' AND gender IN ('f', 'm')")
    out = found.withColumns({"_first": F.lower("first"), "_last": F.lower("last")})
    out = beside(out, told.groupBy(*person).agg(votes.alias("_person")), ["_first", "_last"], ["key", "start"])
    out = beside(out, told.groupBy(*name).agg(votes.alias("_name")), ["_first"], ["key", "start"])
    n = F.when(F.coalesce("_person", F.lit(0)) != 0, F.col("_person")).otherwise(F.coalesce("_name", F.lit(0)))
    return out.withColumn("gender", F.when(n > 0, "f").when(n < 0, "m").otherwise("")).select(*found.columns)


#: Codes are made longer in steps of this, and checked this often at most.
CODE, ROUNDS = 10, 8


def _valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = zip(pdf["kind"], pdf["found"], pdf["first"], pdf["last"])
        yield pdf.assign(value=[f"{l.lower()}|{f.lower()}" if k == "name" else norm_entity(k, x) for k, x, f, l in parts])


def _coder(secret: str, style: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = []
            for k, v, x, f, l, g, size in zip(*(pdf[c] for c in ("kind", "value", "found", "first", "last", "gender", "size"))):
                if style == "placeholder":
                    codes.append(code(secret, k, v, size))
                elif k == "name":  # one order and form of a name, so that its ways of writing don't count as persons
                    codes.append(surrogate(secret, k, f"{f} {l}".strip(), f, l, g, size + 2).lower())
                else:
                    codes.append(norm_entity(k, surrogate(secret, k, x, f, l, g, size + 2)))
            yield pdf.assign(code=codes)

    return run


def _distinct_codes(valued: DataFrame, secret: str, style: str) -> DataFrame:
    """``kind``, ``value``, ``size`` of the entities that need a longer code than :data:`CODE`.

    A code is taken again, longer, as long as it stands for two entities of the corpus or is itself one that occurs
    there. A number whose form leaves too little room may still share one after :data:`ROUNDS` rounds.
    """
    entities = valued.groupBy("kind", "value").agg(*(F.max(c).alias(c) for c in ("found", "first", "last", "gender"))).withColumn("size", F.lit(CODE))
    coder = filled(_coder(secret, style))
    for _ in range(ROUNDS):
        coded = cut_lineage(entities.mapInPandas(coder, T.StructType([*(T.StructField(f.name, f.dataType) for f in entities.schema.fields), T.StructField("code", T.StringType())])))
        taken = coded.groupBy(F.col("kind").alias("k"), F.col("code").alias("c")).agg(F.min("value").alias("a"), F.max("value").alias("b")).filter("a != b").select("k", "c")
        if style != "placeholder":
            # a name's value is "last|first"
            real = F.when(F.col("kind") == "name", F.trim(F.regexp_replace("value", r"^([^|]*)\|(.*)$", "$2 $1"))).otherwise(F.col("value"))
            taken = taken.unionByName(coded.select(F.col("kind").alias("k"), real.alias("c"))).distinct()
        clash = coded.join(taken.withColumn("clash", F.lit(True)), (F.col("kind") == F.col("k")) & (F.col("code") == F.col("c")), "left").drop("k", "c")
        if clash.filter("clash").isEmpty():
            break
        entities = clash.withColumn("size", F.when(F.col("clash"), F.col("size") + CODE).otherwise(F.col("size"))).drop("clash", "code")
    return coded.filter(F.col("size") > CODE).select("kind", "value", "size")


def _replacer(secret: str, style: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                if not isinstance(text, str) or spans is None:
                    out.append(text)
                    continue
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                    if s["start"] < at:
                        continue
                    size = s["size"]
                    new = f"[{s['kind'].upper()}:{code(secret, s['kind'], s['value'], size)}]" if style == "placeholder" else surrogate(secret, s["kind"], s["found"], s["first"], s["last"], s["gender"], size + 2)
                    parts += [text[at : s["start"]], new]
                    at = s["stop"]
                out.append("".join(parts) + text[at:])
            yield pd.DataFrame({"key": pdf["key"], "text": out})

    return run


def replace_entities(df: DataFrame, key: str, text: str, secret: str, style: str = "placeholder") -> DataFrame:
    """``key``, ``text``: every text with its entities replaced and everything else unchanged.

    ``secret`` is the key of the codes; who has it can tell by trial which value a code stands for, so there is no default.

    ``style="placeholder"`` writes ``[KIND:CODE]``, ``"surrogate"`` a made-up value. ``key`` must be unique. Null and
    empty texts come out as they are. Codes that collide anywhere in the corpus are made longer; see :func:`_distinct_codes`.
    """
    if not secret:
        raise ValueError("a key is needed")
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = find_entities(docs, "key", "text")
    if style == "surrogate":
        found = _with_genders(cut_lineage(found))
    valued = cut_lineage(found.mapInPandas(filled(_valued), T.StructType([*found.schema.fields, T.StructField("value", T.StringType())])))
    longer = _distinct_codes(valued, secret, style)
    marked = beside(valued, longer, ["kind", "value"], ["key", "start"]).withColumn("size", F.coalesce("size", F.lit(CODE)))
    spans = marked.groupBy("key").agg(F.collect_list(F.struct("start", "stop", "kind", "found", "first", "last", "gender", "value", "size")).alias("spans"))
    return docs.join(spans, "key", "left").mapInPandas(filled(_replacer(secret, style)), docs.schema).withColumnsRenamed({"key": key})
