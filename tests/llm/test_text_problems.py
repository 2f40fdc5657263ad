"""Problems 1, 2, 4, 5, 6, 9: cases, edges, and brute force where there is one."""


import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tomewright.llm import cuts, forms, pieces, privacy, scans, sentences
from tomewright.llm.gbm import Boosted


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- 1


def make(spark, texts, most=50, lap=10):
    return spark.createDataFrame([(i, t, most, lap, "x") for i, t in enumerate(texts)], "k int, t string, m int, o int, piece string")


def cut(spark, texts, most=50, lap=10):
    got = pieces.split_oversized(make(spark, texts, most, lap), ["k"], "t", "m", "o").orderBy("k", "piece_no").collect()
    out = {}
    for r in got:
        out.setdefault(r.k, []).append((r.start, r.piece))
    return out


def test_pieces_cover_and_overlap(spark):
    rng = random.Random(1)
    alphabet = ["word", "longerword", "a", "x" * 70, "Ende.", "終わり。", "é́", "😀", "\n\n", "eins, zwei;"]
    texts = [" ".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(150)]
    got = cut(spark, texts)
    for i, t in enumerate(texts):
        s = t.strip()
        if len(s) <= 50:
            assert i not in got
            continue
        assert all(0 < len(p) <= 50 for _, p in got[i])
        assert all(s[a : a + len(p)] == p for a, p in got[i])
        ends = [a + len(p) for a, p in got[i]]
        assert got[i][0][0] == 0 and ends[-1] == len(s)
        assert all(got[i][n + 1][0] == ends[n] - min(10, ends[n]) for n in range(len(ends) - 1))


def test_pieces_end_at_natural_places(spark):
    text = "One sentence is here now. Another one is there too. And a third one follows here."
    assert [p for _, p in cut(spark, [text], 40, 0)[0]] == ["One sentence is here now. ", "Another one is there too. ", "And a third one follows here."]


def test_pieces_edges(spark):
    nbsp = " " * 40 + "short" + "　" * 40
    assert set(cut(spark, [None, "", " ", nbsp, "y" * 51])) == {4}
    assert len(cut(spark, ["z" * 200_000], 400, 40)[0]) == -(-200_000 // 360)
    assert all(len(p) <= 5 for _, p in cut(spark, ["abcdefghij" * 3], 5, 99)[0])
    assert cut(spark, ["abc" * 40], 0, 0) == {}
    assert make(spark, ["a"]).limit(0).count() == 0 and pieces.split_oversized(make(spark, ["a"]).limit(0), ["k"], "t", "m", "o").count() == 0
    twice = make(spark, ["w " * 60]).union(make(spark, ["w " * 60]))
    assert pieces.split_oversized(twice, ["k"], "t", "m", "o").count() == 2 * pieces.split_oversized(make(spark, ["w " * 60]), ["k"], "t", "m", "o").count()


# ---- 4


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｔｏｋｅｎ plain", {"token"}),
        ("re​solves si‎lently", {"resolves", "silently"}),
        ("cօrriⅾor аѕk сасһе", {"corridor", "ask", "cache"}),
        ("oтчёт Kaждый слово", {"отчёт", "каждый"}),
        ("The word слово stays, so does хор слово", set()),
        ("café naïve", {"café"}),
        ("отчёт йод", {"отчёт", "йод"}),
        ("conﬁrm ﬁ", {"confirm"}),
        ("短いﾏｲｸは完全なｴﾝｼﾞﾝを", {"マイク", "エンジン"}),
        ("eager editor and  more", {"eager editor", "and more"}),
        ("می‌خواهم 👩‍💻 α, β", set()),
        ("n.º n° « bien » ？！", set()),
        ("clean­\nly", set()),
        ("", set()),
        ("don’t ab", set()),
        ("ÉTÉ 𝐍𝐨𝐛𝐨𝐝𝐲", {"nobody"}),
    ],
)
def test_variants(spark, text, want):
    df = spark.createDataFrame([(7, text, "z")], "k long, t string, plain string")
    assert {r.plain for r in forms.find_variants(df, "k", "t").collect()} == want


def test_folding_equals_unicodedata(spark):
    rng = random.Random(2)
    pool = [*"abcéñöÅｋＺ oﬀ①ｶﾊ漢字가の 12３", "e\u0301", "o\u0308", "A\u030a", "ｶﾞ", "ﾊﾟ", "q\u0301"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [None, "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.plain for r in forms.fold_texts(df, "k", "t").collect()}
    assert len(got) == len(texts) and got[300] is None
    for i, t in enumerate(texts[:300]):
        assert got[i] == unicodedata.normalize("NFKC", t), t


def test_visible_text_and_empty(spark):
    df = spark.createDataFrame([(1, "<p>a&zwj;bcd</p><pre>wｉde</pre><b>wo</b>rｄ &nbsp;x"), (2, None)], "k long, h string")
    assert rows(forms.find_variants(df, "k", "h", markup=True)) == [(1, "abcd"), (1, "word"), (1, "word x")]
    assert forms.find_variants(df.limit(0), "k", "h", markup=True).count() == 0


# ---- 5


def ends(spark, text):
    df = spark.createDataFrame([(1, text, "x")], "k long, t string, end_pos string")
    got = [r.end_pos for r in sentences.split_sentences(df, "k", "t").orderBy("end_pos").collect()]
    return [text[a:b].replace("[[beat]]", "").strip() for a, b in zip([0, *got], got)], got


@pytest.mark.parametrize(
    "want",
    [
        ["Dr. Smith went at 9 a.m. sharp.", "He paid $4.50 for it."],
        ["“Stop it!” cried the man.", "Nobody did."],
        ['The editor wrote "Trim it. Then wait." on the page.', "It was fine."],
        ["(All of this is so.)", "And J. R. Vance agrees, e.g. in Fig. 3 and No. 12."],
        ["„Ist es müde?“, fragte der Mann.", "Das kostet z. B. 3 Euro.", "Am 3. Mai ist Schluss."],
        ["«¿Está bien?», preguntó ella.", "¡Qué rápido!", "¿Por qué?"],
        ["« Il est parti », dit-elle, « mais il revient. »", "Voilà."],
        ["«Где он?» — спросил редактор.", "Он читает и т. д. до вечера."],
    ],
)
def test_sentences_of_alphabets(spark, want):
    assert ends(spark, " ".join(want))[0] == want


@pytest.mark.parametrize(
    "want",
    [
        ["为什么要替换？", "编辑说：“好的，不必。”", "“要检查吗？”编辑问道。", "比例从12.5升到95.3。", "停下……然后走。"],
        ["「章を開く。」と編集者は言った。", "読者（古い。）は変わった。", "終わり！"],
        ["क्या यह ठीक है?", '"कहाँ है?" संपादक ने पूछा।', "डॉ. केस शाम को आए।"],
    ],
)
def test_sentences_without_spaces(spark, want):
    sep = " " if want[0][0] == "क" else ""
    assert ends(spark, sep.join(want))[0] == want


def test_sentence_edges(spark):
    assert ends(spark, "A Title\n\nFirst one. [[beat]] Second one.\n\n---\n\n<pre>x. Y.</pre>\n\nThe cut te")[0] == ["A Title", "First one.", "Second one.", "---\n\n<pre>x. Y.</pre>", "The cut te"]
    assert ends(spark, "First.\nSecond. ")[1] == [6, 14]
    for blank in ("", "   ", "---", "[[beat]]"):
        assert ends(spark, blank)[1] == []
    df = spark.createDataFrame([(1, None)], "k long, t string")
    assert sentences.split_sentences(df, "k", "t").count() == 0
    assert sentences.split_sentences(df.limit(0), "k", "t").count() == 0
    assert len(ends(spark, "This is one. " * 5000)[1]) == 5000


def test_document_decides_before_the_corpus(spark):
    known = "It was approved by the zbd. committee of the zbd. office. Ask the zbd. Members may come."
    assert ends(spark, known)[0][-1].endswith("Members may come.")
    got = sentences.sentence_texts(spark.createDataFrame([(1, "One. [[beat]] Two.")], "k long, t string"), "k", "t")
    assert [r.sentence for r in got.orderBy("sentence_no").collect()] == ["One.", "Two."]


def test_counts_come_before_the_lists(spark):
    seen = "He drew the fig.\n\nWe saw a fig.\n\nThey cut one fig.\n\nIt is in fig. 3 here."
    got = sentences.sentence_texts(spark.createDataFrame([(i, seen) for i in range(300)] + [(900, "She ate the fig. Then she left.")], "k long, t string"), "k", "t")
    assert [r.sentence for r in got.filter("k = 900").orderBy("sentence_no").collect()] == ["She ate the fig.", "Then she left."]
    assert ends(spark, "She saw the fig. Then she left.")[0] == ["She saw the fig. Then she left."]  # only the list is left


def test_a_name_behind_a_doubtful_stop(spark):
    known = [(i, "They go with Ruvexa and then with Ruvexa. All of the then known and later ones go then.") for i in range(20)]
    got = sentences.sentence_texts(spark.createDataFrame([*known, (900, "See the vol. Ruvexa wrote."), (901, "See the vol. Then go.")], "k long, t string"), "k", "t")
    by = {k: [r.sentence for r in got.filter(f"k = {k}").orderBy("sentence_no").collect()] for k in (900, 901)}
    assert by == {900: ["See the vol. Ruvexa wrote."], 901: ["See the vol.", "Then go."]}


def test_long_abbreviations_and_long_words(spark):
    seen = [(i, "Die Abteilungsl. der Firma und die Abteilungsl. des Hauses, dazu die Abteilungsl. am Ort.") for i in range(5)]
    got = sentences.sentence_texts(spark.createDataFrame([*seen, (900, "Frag die Abteilungsl. Es ist gut."), (901, f"{'w' * 300}. Then more.")], "k long, t string"), "k", "t")
    assert [r.sentence[-5:] for r in got.filter("k = 901").orderBy("sentence_no").collect()] == ["wwww.", "more."]
    assert sentences.Judge(seen[0][1], lambda t: {}).abbreviation("Abteilungsl")


# ---- 6


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("All is well.", "ended"), ("All is w", "no_end"), ("All is [truncated]", "marked_cut"), ("All is (more)", "marked_cut"), ("All is…", "dots"), ("So.\n\nThe End", "closing"), ("So.\n\nFin du chapitre", "closing"),
        ("So. [[beat]]\n\n---", "ended"), ("So.\n\n<pre>x</pre>", "closing"), ("", "ended"), ("See example.org/a", "closing"), ("完了。", "ended"), ("He saw Dr.", "doubtful_stop"), ('He wrote "Trim it.', "open_quote"),
    ],
)
def test_endings(text, kind):
    assert cuts.ending(text)[0] == kind


def test_censored_fit_finds_the_distribution():
    rng = np.random.default_rng(3)
    x = rng.normal(6.0, 0.7, 20_000)
    c = 6.5
    exact = x[x < c]
    mu, sigma = cuts.fit_censored(exact, np.ones(len(exact)), np.array([c]), np.array([float((x >= c).sum())]))
    assert abs(mu - 6.0) < 0.03 and abs(sigma - 0.7) < 0.03


def cut_rows(spark, given):
    df = spark.createDataFrame([(i, s, t, st, i) for i, (s, t, st) in enumerate(given)], "k long, s string, t string, st string, p int")
    return df, cuts.judge_cuts(df, "k", "s", "t", "st", ["p"])


def test_cuts_at_a_limit(spark):
    rng = random.Random(4)
    given = []
    for _ in range(300):
        full = " ".join("The quick fox ran over the hill again today." for _ in range(rng.randrange(1, 30)))
        given.append(("North_A" if rng.random() < 0.5 else "north-a ", full[:700], "object"))
    given += [(None, None, "open"), (None, None, "null"), ("q", "", "object"), ("q", "And then, nothing...", "object"), ("q", "And then, nothing...", "object"), ("q", "The pub...", "object"), ("q", "x " * 50_000 + "end.", "object")]
    df, got = cut_rows(spark, given)
    cut = {r.k for r in got.collect() if r.cut}
    want = {i for i, (_, t, _) in enumerate(given[:300]) if not t.endswith(".")} | {300, 305}
    assert cut == want
    assert {r.source for r in got.collect()} == {"north-a", None, "q"}
    assert cuts.judge_cuts(df.limit(0), "k", "s", "t", "st", ["p"]).count() == 0


def test_one_ending_at_a_limit_and_away_from_it(spark):
    rng = random.Random(6)
    given = []
    for _ in range(400):
        full = " ".join("The quick fox ran over the hill again today." for _ in range(rng.randrange(1, 40)))
        given.append(("s", full[:700], "object"))
    stop = "It was shown to them all by the kind Dr."
    given += [("s", ("The quick fox ran over the hill again today. " * 20)[: 700 - len(stop)] + stop, "object"), ("s", f"The quick fox ran. {stop}", "object")]
    _, got = cut_rows(spark, given)
    by = {r.k: r for r in got.collect()}
    assert by[400].cut and not by[401].cut and by[400].posterior > 0.9 and by[401].posterior is None


@pytest.mark.parametrize("scale", [1, 120])
def test_limits_of_any_length(scale):
    rng = np.random.default_rng(5)
    n = np.minimum(rng.lognormal(math.log(600 * scale), 0.4, 4000), 700 * scale + 3).astype(int)
    hist = pd.DataFrame({"n": n, "unended": (n == 700 * scale + 3).astype(int), "rows": 1}).groupby("n", as_index=False).sum()
    got = cuts.limits_of(hist)
    at = dict(zip(got["n"], got["posterior"]))
    assert at[700 * scale + 3] > 0.98 and max(at) == 700 * scale + 3 and min(at) > 700 * scale - 16


def test_recurring_tails_of_any_length(spark):
    tail = "This closing line is long and has no mark of its own though it stands in many of the chapters of one publisher who likes it"
    _, got = cut_rows(spark, [("q", f"Some text {'so ' * 9 * i}.\n \n{tail}", "object") for i in range(4)] + [("q", f"Some text.\n\n{tail[:60]}", "object")])
    assert {r.k for r in got.collect() if r.cut} == {4}


def test_learned_endings():
    far = [(None, "ended", 9000), (None, "no_end", 200)]
    kept = cuts.learn_endings([*far, (None, "open_quote", 300), (0.99, "no_end", 500)])
    lost = cuts.learn_endings([*far, (0.99, "no_end", 500), (0.99, "open_quote", 60)])
    assert kept["open_quote"] < 0 < lost["open_quote"]
    assert cuts.learn_endings([])["thai"] == cuts.DOUBTFUL["thai"]


# ---- 9

TEXT = (
    "Regards,\nJulia Okandre\n415.555.0199 Write to o.k_1@post.lanternway.test or max at mail dot example. According to Brack, Paul, it is late. Ms Okandre called. "
    "Passport XX94 3770 8840 2514 4714 and id 911-65-3785. Send it to Flat 3, 12 Oak Row, Northam ZZ1 2ZZ. Order ref CH-00039-77, chunk 0412-59, pages 212-23, version 6.5.5, the Oak filter. According to Paul Brack, fine. Paul Brack wrote it. Regards,\nPaul Brack"
)
WANT = {
    ("name", "Julia Okandre"), ("phone", "415.555.0199"), ("email", "o.k_1@post.lanternway.test"), ("email", "max at mail dot example"), ("name", "Brack, Paul"), ("name", "Okandre"), ("name", "Paul Brack"),
    ("id_number", "XX94 3770 8840 2514 4714"), ("id_number", "911-65-3785"), ("address", "Flat 3, 12 Oak Row, Northam ZZ1 2ZZ"),
}


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "f", 0) for i, t in enumerate(texts)], "k long, t string, found string, start int")


def test_entities(spark):
    got = privacy.find_entities(docs(spark, [TEXT, None, "", "nothing here"]), "k", "t").collect()
    assert {(r.kind, r.found) for r in got} == WANT
    assert all(TEXT[r.start : r.stop] == r.found and r.k == 0 for r in got)
    assert privacy.find_entities(docs(spark, [TEXT]).limit(0), "k", "t").count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("Die Sendung geht an Am Oldmill 19a, Norrbridge.", "address", "Am Oldmill 19a, Norrbridge"),
        ("geht an Oldmillstraße 283, 99368 Pinehollow.", "address", "Oldmillstraße 283, 99368 Pinehollow"),
        ("au 286 rue Pennywhistle, 99626 Vaubrune.", "address", "286 rue Pennywhistle, 99626 Vaubrune"),
        ("a Calle Marlock 41, 2.º B, 99945 Norrbridge.", "address", "Calle Marlock 41, 2.º B, 99945 Norrbridge"),
        ("PO Box 6152, Ostmark-Neu and more", "address", "PO Box 6152, Ostmark-Neu"),
        ("at 20 Oak Court\nNortham ZZ 99654 and", "address", "20 Oak Court\nNortham ZZ 99654"),
        ("unter 0049 30 23125 636 erreichbar", "phone", "0049 30 23125 636"),
        ("(tel. (01632) 960 961) was", "phone", "(01632) 960 961"),
        ("Mi teléfono es 999 42 42 07.", "phone", "999 42 42 07"),
        ("on 020 7946\n0332 then", "phone", "020 7946\n0332"),
        ("number is QQ 33 64 24 A.", "id_number", "QQ 33 64 24 A"),
        ("749388-9354 it is", "id_number", "749388-9354"),
    ],
)
def test_forms(text, kind, found):
    assert (kind, found) in {(s[2], s[3]) for s in privacy.detect(text)}


@pytest.mark.parametrize("text", ["Install tool@86.2 now", "Use @narrate here", "The build of 2025-05-27 took 555 seconds", "978-0-0000-19 is printed", "retry after 360023 ms", "kostet 345.000 Euro", "24000.59 hertz"])
def test_no_forms(text):
    assert [s for s in privacy.detect(text) if s[2] != "name"] == []


def test_replacement_keeps_the_rest(spark):
    texts = [TEXT, None, "", "plain", TEXT]
    got = {r.k: r.text for r in privacy.replace_entities(docs(spark, texts), "k", "t", "key").collect()}
    assert (got[1], got[2], got[3]) == (None, "", "plain") and got[0] == got[4]
    assert re.sub(r"\[[A-Z_]+:[A-Z2-9]+\]", "#", got[0]) == re.sub("|".join(re.escape(f) for _, f in sorted(WANT, key=lambda x: -len(x[1]))), "#", TEXT)
    codes = re.findall(r"\[NAME:(\w+)\]", got[0])
    assert codes[1] == codes[3] == codes[4]  # "Brack, Paul" is "Paul Brack"


def test_surrogates_keep_kind_and_format(spark):
    got = {r.k: r.text for r in privacy.replace_entities(docs(spark, [TEXT]), "k", "t", "key", style="surrogate").collect()}[0]
    assert not any(f in got for _, f in WANT)
    assert re.search(r"Regards,\n\w+ \w+\n\d{3}\.\d{3}\.\d{4} Write to user-\w+@example\.invalid", got)
    assert privacy.surrogate("k", "name", "Brack, Paul", "Paul", "Brack", "m").split(", ")[::-1] == privacy.surrogate("k", "name", "Paul Brack", "Paul", "Brack", "m").split(" ")


def test_surrogates_stay_distinct(spark):
    names = [f"{f} {s}" for s in ("Oakhurst", "Elmwood", "Birchall") for f in ("Anna", "Clara", "Rosa", "Julia", "Marta", "Nadia", "Sofia", "Lucia", "Greta", "Maya", "Hana", "Emma", "Elena", "Leila", "Priya", "Aisha", "Fatima", "Diana", "Laura", "Paula", "Carla", "Vera", "Nora", "Ida", "Ada")]
    got = [r.text for r in privacy.replace_entities(docs(spark, [f"According to {n}, it is so." for n in names]), "k", "t", "key", style="surrogate").orderBy("k").collect()]
    assert len(set(got)) == len(names) and not any(n in t for n, t in zip(names, got))
    women = set(privacy.GIVEN["f"])
    assert all(re.match(r"According to (\w+)", t)[1] in women for t in got)



def test_surrogates_replace_letters_of_every_script():
    for like in ("ул. Садовая, д. 12, Тверь", "Große Straße 5, Köln", "朝日通り１２", "Οδός Ερμού 7"):
        got = privacy.surrogate("k", "address", like, "", "", "")
        assert len(got) == len(like) and not any(w in got for w in re.findall(r"[^\W\d_]{2,}", like))
        for a, b in zip(like, got):
            assert unicodedata.category(a) == unicodedata.category(b) and (not a.isalpha() or unicodedata.name(a).split()[0] == unicodedata.name(b).split()[0])


def test_surrogates_keep_gender_and_script(spark):
    texts = ["We met Mr Andrea Brack there.", "According to Andrea Brack, it is so.", "We met Mr Holger Brack there.", "According to Holger Elmwood, it is so."]
    got = [r.text for r in privacy.replace_entities(docs(spark, texts), "k", "t", "key", style="surrogate").orderBy("k").collect()]
    first = [re.search(r"(?:Mr|to) (\w+)", t)[1] for t in got]
    assert set(first) <= set(privacy.GIVEN["m"]) and first[0] == first[1] and first[2] == first[3]
    assert re.fullmatch(r"[а-яё]+ [а-яё]+", privacy.surrogate("k", "name", "Иван Петров", "Иван", "Петров", "m").lower())


# ---- 2


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted().fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_lines_and_page_numbers():
    got = scans.lines_of("<h1>T</h1>\n<p>one<br/>\n<table>\n12\n</table>\n\n&amp; two</p>")
    assert [(x.no, x.kind, x.text) for x in got] == [(1, "heading", "T"), (2, "text", "one"), (3, "skip", ""), (4, "skip", "12"), (5, "skip", ""), (6, "blank", ""), (7, "text", "& two")]
    for s in ("12", "- 12 -", "[ 4 ]", "Page 3 of 9", "xvii", "Seite 4"):
        assert scans.is_page_number(s), s
    for s in ("12.", "in 12", "mild", "12 %", "", "iiii"):
        assert not scans.is_page_number(s), s


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    stems = ["river", "mountain", "garden", "window", "letter", "winter", "summer", "kitchen", "market", "forest", "castle", "bridge", "shadow", "silver", "golden", "market", "pepper", "carpet", "basket", "button", "candle", "dinner", "engine", "finger", "hammer", "island", "jacket", "ladder", "mirror", "needle", "orange", "pencil", "rabbit", "saddle", "tunnel", "valley", "walnut", "yellow", "cottage", "harbour", "blanket", "feather", "chimney", "lantern", "compass", "village", "orchard", "teacher", "weather", "station"]
    words = sorted({w + s for w in stems for s in ("", "s")}) + ["old-fashioned", "well-known", "hand-made", "the", "and", "with", "over", "under"]
    clean, dirty, truth = [], [], []

    def sentence(n):
        return [rng.choice(words) for _ in range(n)]

    for i in range(150):
        clean.append((1000 + i, "<h1>Some Plain Title</h1>\n" + "\n".join(f"<p>{' '.join(sentence(25)).capitalize()}.</p>" for _ in range(3)), "Some Plain Title", "A Book About Things"))
    for i in range(80):
        lines = ["<h1>On Rivers And Castles</h1>", "<p>Start of the text with"]
        for n in range(8):
            s = sentence(8)
            w = s[rng.randrange(8)]
            swaps = [(a, b) for a, b in (("e", "c"), ("o", "0"), ("l", "1"), ("d", "cl"), ("t", "l"), ("m", "rn")) if a in w]
            if n % 4 == 1 and w.isalpha() and len(w) >= 6 and swaps:
                s[s.index(w)] = w.replace(*rng.choice(swaps), 1)
                truth.append((i, len(lines) + 1, "ocr", w))
            lines.append(" ".join(s))
            if n % 4 == 2:
                w = rng.choice([x for x in words if len(x) >= 6])
                k = w.index("-") if "-" in w else 3
                lines[-1] += f" {w[:k]}-"
                truth.append((i, len(lines), "hyphen", w))
                lines.append("ON RIVERS AND CASTLES" if n == 2 else f"{i}  A Book About Things")
                truth.append((i, len(lines), "header", ""))
                lines.append(str(100 + i))
                truth.append((i, len(lines), "page_number", ""))
                lines.append(w[k:].lstrip("-") + " goes on with the over-")
                lines.append("and under river garden")
        dirty.append((i, "\n".join(lines) + " end.</p>", "On Rivers And Castles", "A Book About Things"))
    return spark.createDataFrame(clean + dirty + [(5000, None, None, None), (5001, "", "t", "b")], "row_id long, html string, title string, book_title string"), set(truth)


def test_faults_are_found(spark, corpus):
    df, truth = corpus
    got = {(r.row_id, r.line_no, r.kind, r.fixed) for r in scans.find_faults(df.withColumn("kind", F.lit("x")), "row_id").collect()}
    assert len(got & truth) >= 0.95 * len(truth)
    assert len(got - truth) <= 0.05 * len(truth)


def test_pages_are_rebuilt(spark, corpus):
    df, _ = corpus
    got = scans.repair_pages(df.filter("row_id < 1010"), "row_id")
    assert {r.row_id for r in got.select("row_id").distinct().collect()} == set(range(80))
    text = " ".join(r.text for r in got.filter("row_id = 0").orderBy("para_no").collect())
    assert "ON RIVERS" not in text and "over- and under" in text and not re.search(r"[a-z]- goes", text)


def test_small_and_empty_corpora(spark):
    df = spark.createDataFrame([(1, "<p>one two thr­\nee four\nfive six.</p>", None, None)], "row_id long, html string, title string, book_title string")
    assert {(r.kind, r.fixed) for r in scans.find_faults(df, "row_id").collect()} == {("hyphen", "three")}
    assert scans.find_faults(df.limit(0), "row_id").count() == 0


def test_names_in_capitals(spark):
    texts = ["Dear Noor Brack,", "Dear Noor Brack,", "Signed by Paul Vossen", "Signed by Paul Vossen", "the reviewer, NOOR VOSSEN, WANTS A REFUND", "BRACK, PAUL", "WANTS A NEW HEADING"]
    got = privacy.find_entities(docs(spark, texts), "k", "t").filter("kind = 'name'").select("k", "found", "first", "last")
    assert {tuple(r) for r in got.collect() if r.k >= 4} == {(4, "NOOR VOSSEN", "Noor", "Vossen"), (5, "BRACK, PAUL", "Paul", "Brack")}
    made = privacy.surrogate("k", "name", "NOOR VOSSEN", "Noor", "Vossen", "f")
    assert made == privacy.surrogate("k", "name", "Noor Vossen", "Noor", "Vossen", "f").upper() and "VOSSEN" not in made


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("电话 138 0013 8000。", "138 0013 8000"), ("电话：13800138000", "13800138000"), ("我叫李明。", "李明"), ("王芳女士来了", "王芳"), ("田中さんは来た", "田中"), ("お客様は来た", None), ("名前は佐藤花子です", "佐藤花子"),
        ("श्री राजेश कुमार आए", "राजेश कुमार"), ("คุณสมชาย ใจดี มาแล้ว", "สมชาย ใจดี"),
    ],
)
def test_scripts_without_capitals(text, found):
    assert [s[3] for s in privacy.detect(text)] == ([found] if found else [])


def test_common_names_and_a_missing_key(spark):
    texts = ["Dear Noor Brack,"] * 500 + ["Hello Ms Brack"] * 500
    got = privacy.find_entities(docs(spark, texts), "k", "t").groupBy("found").count().collect()
    assert {tuple(r) for r in got} == {("Noor Brack", 500), ("Brack", 500)}
    with pytest.raises(ValueError):
        privacy.replace_entities(docs(spark, texts), "k", "t", "")


# ---- 2, candidates and edits


def test_edits_in_one_and_in_two():
    assert scans.edits_of("tlme", "time") == ("l>i", [])
    assert scans.edits_of("rnodem", "modern")[0] == "rnodem>modern"
    whole, ways = scans.edits_of("tlmc", "time")
    assert whole == "lmc>ime" and ways == [("l>i", "c>e")]
    assert ("rn>m", "1>l") in scans.edits_of("rn1x", "mlx")[1]


def test_candidates_like_brute_force(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    words = sorted({"".join(rng.choice("abcdei") for _ in range(rng.randrange(3, 9))) for _ in range(250)} | {long})
    bad = sorted(({"".join(rng.choice("abcdei1") for _ in range(rng.randrange(3, 9))) for _ in range(80)} | {f"{long[:30]}1{long[31:]}"}) - set(words))
    suspects, counts = spark.createDataFrame([(b, 1.0) for b in bad], "bad string, n_bad double"), spark.createDataFrame([(w, 9.0) for w in words], "good string, n double")
    got = {(r.bad, r.good) for r in scans.candidates(suspects, counts).collect()}

    def grams(w):
        s = f"##{w.translate(scans._LOOKS)}##"
        return {s[i : i + 3] for i in range(len(s) - 2)}

    want = {(b, w) for b in bad for w in words if abs(len(b) - len(w)) <= 2 and scans._levenshtein(b, w) <= 3 and 3 * len(grams(b) & grams(w)) >= len(b) + 2}
    assert got == want and any(len(b) > 40 for b, _ in got)


def test_a_page_in_a_script_without_stops():
    page = "<p>ถ้าบรรณาธิการเงียบย่อหน้าก็จะอ่านผู้<br/>\nอ่านเพราะเหตุใดเสียงจึงแก้ไขผู้อ่านถ้า<br/>\nผู้แปลยาวผู้อ่านก็จะแก้ไขผู้แปล</p>"
    clean = "<p>ถ้าบรรณาธิการเงียบย่อหน้าก็จะอ่านผู้</p>\n<p>อ่านเพราะเหตุใดเสียงจึงแก้ไขผู้อ่านถ้า</p>"
    assert scans.is_scanned(scans.lines_of(page)) and not scans.is_scanned(scans.lines_of(clean))


def test_codes_are_made_longer_until_they_are_distinct(spark, monkeypatch):
    monkeypatch.setattr(privacy, "code", lambda secret, kind, value, size=10: hashlib.sha256(value.encode()).hexdigest()[:1] + ("" if size < 40 else value))
    values = spark.createDataFrame([(i, 0, 9, "email", f"u{i}@x.org", "", "", "", f"u{i}@x.org") for i in range(60)], "key long, start int, stop int, kind string, found string, first string, last string, gender string, value string")
    got = {r.value: r.size for r in privacy._distinct_codes(values, "k", "placeholder").collect()}
    assert len(got) >= 45 and set(got.values()) == {40}


def test_a_surrogate_is_no_value_of_the_corpus(spark):
    made = privacy.surrogate("k", "phone", "+44 20 7946 0786", "", "", "", 12)
    texts = ["Call +44 20 7946 0786 now", f"Call {made} now"]
    got = [r.text for r in privacy.replace_entities(docs(spark, texts), "k", "t", "k", style="surrogate").orderBy("k").collect()]
    assert made not in got[0] and len(set(got)) == 2 and re.fullmatch(r"Call \+\d\d \d\d \d{4} \d{4} now", got[0])
