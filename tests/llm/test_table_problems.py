"""Problems 3, 7, 8 and the queries."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.llm import leaks, mixing, queries, survivors

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import compare  # noqa: E402

# ---- 3

LEX = "book string, term string, say string, why string, id long, origin string, at timestamp, root string"


def lexicon(spark, given):
    import datetime as dt

    base = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(b, t, s, w, i, o, None if d is None else base + dt.timedelta(days=d), "x") for i, (b, t, s, w, o, d) in enumerate(given, 1)], LEX)


def survive(spark, given, missing="earliest"):
    trust = spark.createDataFrame([("House-Editor", 5), ("bulk import", 1)], "origin string, trust int")
    return survivors.survivors(lexicon(spark, given), "book", "term", "id", ["say", "why"], "origin", "at", trust, missing)


PAIRS = [
    ("Welkrawix", "wELKRAWIX.", True), ("Welkrawix", "Wеlkrаwіх", True), ("Ｗｅｌｋ", "welk", True), ("DNVКN", "dn\u200bvkn", True), ("Dortal Forge", "dortal‑forge", True), ("Étikdorulf", "E\u0301tikdorulf", True),
    ("Welkrawix", "Welkrrawix", True), ("Welkrawix", "Welkrawxi", True), ("Welkrawix", "Welkrewix", True), ("Welkrawix", "Welkrawix 2", False), ("valyunpen 2", "valyunpen 3", False), ("Dortal Forge", "Dortal Forge Lite", False),
    ("dorpen", "dorpan", False), ("dortal-sync", "dortal-synk", False), ("“Quill”", "(quill)", True), ("Straße", "STRASSE", True),
]


def test_which_terms_are_one(spark):
    given = [(f"book{i}", t, "x", "y", None, 1) for i, (a, b, _) in enumerate(PAIRS) for t in (a, b)] + [("other", "Welkrawix", "x", "y", None, 1)]
    groups = {}
    for r in survive(spark, given).collect():
        groups.setdefault(r.book, []).append(r.rows)
    assert groups.pop("other") == [1]
    assert {i: groups[f"book{i}"] for i in range(len(PAIRS))} == {i: [2] if same else [1, 1] for i, (*_, same) in enumerate(PAIRS)}


def test_slips_chain_into_one_group(spark):
    got = survive(spark, [("b", t, "x", None, None, 1) for t in ("abcdefghij", "abcdefghijk", "abcdefghijkl", "abcdefghijklm", "abcdefghijklmn")])
    assert [r.rows for r in got.collect()] == [5]


def brute(given, trust, field):
    real = [g for g in given if g[field] not in (None, "", "n/a", "?", " ")]
    key = lambda g: (trust.get((g[4] or "").lower().strip().replace("_", "-").replace(" ", "-"), 0), g[5] is not None, g[5] or 0, g[6])
    return max(real, key=key)[6] if real else 0


def test_survivors_like_brute_force(spark):
    rng = random.Random(6)
    given = [("b", rng.choice(("Alpha", "ALPHA", "al-pha")), rng.choice(("one", "two", None, "", "n/a", "?")), rng.choice(("r", " ", None)), rng.choice((None, "house_editor", "BULK-IMPORT ", "odd")), rng.choice((None, 1, 2, 3))) for _ in range(60)]
    trust = {"house-editor": 5, "bulk-import": 1}
    numbered = [(*g, i) for i, g in enumerate(given, 1)]
    r = survive(spark, given).first()
    assert (r.rows, r.first_id, r.say_id, r.why_id) == (60, 1, brute(numbered, trust, 2), brute(numbered, trust, 3))


def test_survivor_edges(spark):
    got = survive(spark, [("b", "t", "n/a", None, None, None), ("b", None, "x", "y", None, 1), (None, "t", "x", "y", None, 1), ("b", "---", "s", "w", None, 1)])
    assert {(r.root, r.say, r.say_id) for r in got.collect()} == {("t", None, 0), ("---", "s", 4)}
    empty = lexicon(spark, [("b", "t", "x", "y", None, 1)]).limit(0)
    trust = spark.createDataFrame([], "origin string, trust int")
    assert survivors.survivors(empty, "book", "term", "id", ["say"], "origin", "at", trust).count() == 0
    hot = survive(spark, [("b", "same", f"v{i}", "w", None, i % 50) for i in range(3000)])
    assert [r.rows for r in hot.collect()] == [3000]


def test_currency_is_learned(spark):
    given = []
    for i in range(40):  # "draft" is followed by "final" wherever there are dates
        given += [("b", f"term{chr(97 + i % 26)}{chr(97 + i // 26)}", "draft", None, None, 1), ("b", f"term{chr(97 + i % 26)}{chr(97 + i // 26)}", "final", None, None, 5)]
    given += [("b", "undated", "final", None, None, None), ("b", "undated", "draft", None, None, None)]
    learned = {r.root: r.say for r in survive(spark, given, "learned").collect()}
    plain = {r.root: r.say for r in survive(spark, given).collect()}
    assert (learned["undated"], plain["undated"]) == ("final", "draft")


def test_precedence_without_cycles():
    later = survivors.precedences({("a", "b"): 5, ("b", "c"): 4, ("c", "a"): 1, ("b", "a"): 2})
    assert later == {"a": {"b", "c"}, "b": {"c"}}
    assert survivors.precedences({}) == {}
    apart = survivors.precedences({("a", "b"): 5, ("x", "y"): 5})
    assert apart == {"a": {"b"}, "x": {"y"}}


def test_given_edges_come_before_learned_ones():
    counts = {("a", "b"): 9, ("b", "c"): 4}
    assert survivors.precedences(counts, [("b", "a")]) == {"b": {"a", "c"}}
    assert survivors.precedences(counts, [("?", "a"), ("?", "b")]) == {"?": {"a", "b", "c"}, "a": {"b", "c"}, "b": {"c"}}


def test_p3_found_goes_through_the_learned_order(spark, tmp_path, monkeypatch):
    name = lambda i: f"term{chr(97 + i % 26)}{chr(97 + i // 26)}"
    given = [x for i in range(40) for x in (("b", name(i), "draft", "r", None, 1), ("b", name(i), "final", "r", None, 5))]
    given += [("b", "dated", "draft", "r", None, 1), ("b", "dated", "final", "r", None, None), ("b", "undated", "final", "r", None, None), ("b", "undated", "draft", "r", None, None)]
    rows = lexicon(spark, given).withColumnsRenamed({"book": "book_id", "say": "spoken_as", "why": "reason", "id": "hint_id", "at": "recorded_at"})
    rows.write.parquet(f"{tmp_path}/lexicon.parquet")
    spark.createDataFrame([("reviewer", 3)], "origin string, trust int").write.parquet(f"{tmp_path}/origin_trust.parquet")
    learn, orders = survivors.precedences, []
    monkeypatch.setattr(survivors, "precedences", lambda *a: orders.append(learn(*a)) or orders[-1])
    got = {r.first_hint_id: r.spoken_hint_id for r in queries.p3_found(spark, str(tmp_path)).collect()}
    # learned, behind the given edges from the rows without a timestamp; the rows are those of the given order
    assert {"?": {"=draft", "=final"}, "=draft": {"=final"}} in orders
    assert (len(got), got[81], got[83]) == (42, 81, 84)
    learned = {r.term: r.spoken_as for r in queries.p3_survivors(spark, str(tmp_path)).collect()}
    assert (learned["dated"], learned["undated"]) == ("final", "final")


def test_no_preference_without_a_precedence(spark):
    name = lambda i: f"term{chr(97 + i % 26)}{chr(97 + i // 26)}"
    given = []
    for i in range(40):
        given += [("b", name(i), "alpha", None, None, 1), ("b", name(i), "beta", None, None, 5)]
        given += [("c", name(i), "xi one", None, None, 1), ("c", name(i), "yps one", None, None, 5)]
    # a and x are in no order: the row with a timestamp stays, and of two without one the larger key wins
    given += [("b", "mixed", "xi one", None, None, 3), ("b", "mixed", "beta", None, None, None)]
    given += [("b", "undated", "alpha", None, None, None), ("b", "undated", "beta", None, None, None), ("b", "undated", "alpha", None, None, None)]
    given += [("b", "later", "alpha", None, None, 9), ("b", "later", "beta", None, None, None), ("b", "later", "alpha", None, None, None)]
    got = {(r.book, r.root): r.say for r in survive(spark, given, "learned").collect()}
    assert (got["b", "mixed"], got["b", "undated"], got["b", "later"]) == ("xi one", "beta", "beta")
    assert {r.root: r.say for r in survive(spark, given).filter("root = 'later'").collect()} == {"later": "alpha"}


def test_a_pair_of_values_decides_before_its_classes(spark):
    name = lambda i: f"term{chr(97 + i % 26)}{chr(97 + i // 26)}"
    given = []
    for i in range(300):  # most go from one word to two, one pair goes the other way
        given += [("b", name(i), f"say{i}", None, None, 1), ("b", name(i), f"say {i}", None, None, 5)]
    given += [("c", "w", "old two", None, None, 1), ("c", "w", "newone", None, None, 5)]
    given += [("d", "w", "old two", None, None, 1), ("d", "w", "newone", None, None, None), ("e", "w", "other one", None, None, 1), ("e", "w", "single", None, None, None)]
    got = {(r.book, r.root): r.say for r in survive(spark, given, "learned").collect()}
    assert (got["d", "w"], got["e", "w"]) == ("newone", "other one")


# ---- 7


def test_search_like_find():
    rng = random.Random(8)
    text = "".join(rng.choice("ab c") for _ in range(20_000)) + "終わり😀x終"
    patterns = sorted({"".join(rng.choice("ab c") for _ in range(rng.randrange(5, 12))) for _ in range(60)} | {"終わり😀x"})
    want = {(m, i) for i, p in enumerate(patterns) for m in range(len(text)) if text.startswith(p, m)}
    assert set(leaks.WuManber(patterns).search(text)) == want
    assert leaks.WuManber([]).search(text) == [] and leaks.WuManber(patterns).search("a") == []


def _words(rng, n, pool):
    return [rng.choice(pool) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(5)
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro", "sa", "ti") for b in ("ban", "der", "fin", "gol", "hat", "jun")]
    items = [_words(rng, 60, pool) for _ in range(20)]
    note = "Answer with one word only please."
    rows = [(i, " ".join(w).capitalize() + f".\n{note}", "x") for i, w in enumerate(items)] + [(98, None, "x"), (99, "", "x")]
    docs, want = [], set()
    filler = lambda n: " ".join(_words(rng, n, pool))
    for i, w in enumerate(items):
        edited = [x if rng.random() > 0.1 else rng.choice(["other", "", "two words"]) for x in w]
        docs.append((len(docs), f"{filler(30)} {' '.join(edited).upper()}, {filler(30)}"))
        want.add((len(docs) - 1, i))
        docs.append((len(docs), f"{filler(20)}\n{'-'.join(w[:18])} {filler(25)}; {', '.join(w[22:40])}. {filler(9)}"))
        want.add((len(docs) - 1, i))
        docs.append((len(docs), f"{filler(20)} {' '.join(w[:22])} {filler(20)}"))  # too little
        docs.append((len(docs), f"{filler(20)} {' '.join(w[30:60])} {filler(5)} {note}"))
        want.add((len(docs) - 1, i))
    docs += [(900, None), (901, ""), (902, note), (903, filler(30_000))]
    got = leaks.find_leaks(spark.createDataFrame(docs, "d long, t string").withColumn("share", F.lit(1)), "d", "t", spark.createDataFrame(rows, "i long, t string, key string"), "i", "t")
    assert {(r.d, r.i) for r in got.collect()} == want
    none = spark.createDataFrame([], "d long, t string")
    assert leaks.find_leaks(none, "d", "t", spark.createDataFrame(rows, "i long, t string, key string"), "i", "t").count() == 0
    assert leaks.find_leaks(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([], "i long, t string"), "i", "t").count() == 0


def test_more_items_than_a_block(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i} theta{i}") for i in range(30)], "i long, t string")
    docs = items.select(F.col("i").alias("d"), "t")
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 7)
    assert {(r.d, r.i) for r in leaks.find_leaks(docs, "d", "t", items, "i", "t").collect()} == {(i, i) for i in range(30)}


def test_blocks_change_nothing_and_planted_items_are_found(spark, monkeypatch):
    rng = random.Random(17)
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro", "sa", "ti", "ve", "zu") for b in ("ban", "der", "fin", "gol", "hat", "jun")]
    note = "Give a short reason for it please."
    items = [(i, " ".join(_words(rng, 30, pool)) + (f"\n{note}" if i % 3 == 0 else "")) for i in range(60)] + [(90, "ab cd"), (91, "ab cd ef")]
    docs, planted = [], set()
    for i, t in items[:60]:
        w = t.split("\n")[0].split()
        for part in (w, w[:17], w[12:], w[3:12] + ["so"] + w[14:24]):
            edited = [x if rng.random() > 0.08 else rng.choice(["other", ""]) for x in part]
            docs.append((len(docs), f"{' '.join(_words(rng, 40, pool))} {' '.join(edited)} {note} {' '.join(_words(rng, 40, pool))}"))
            planted.add((len(docs) - 1, i))
    df, given = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string")
    got = []
    for n, signs in ((5000, 10_000_000), (9, 10_000_000), (5000, 900)):
        monkeypatch.setattr(leaks, "BLOCK_ITEMS", n)
        monkeypatch.setattr(leaks, "BLOCK_SIGNS", signs)
        got.append({(r.d, r.i, round(r.share, 9)) for r in leaks.find_leaks(df, "d", "t", given, "i", "t").collect()})
    assert got[0] == got[1] == got[2]
    found = {(d, i) for d, i, _ in got[0]}
    assert len(found & planted) >= 0.95 * len(planted) and not found - planted


def test_signs_without_spaces(spark):
    text = "隐藏的话筒在周末拒绝读者因为目录是狭窄的档案打开文字"
    items = spark.createDataFrame([(1, text)], "i long, t string")
    docs = spark.createDataFrame([(1, f"别的文字。{text[:20]}，还有。"), (2, "别的文字没有关系吗是的没有"), (3, text[:8])], "d long, t string")
    assert [(r.d, r.i) for r in leaks.find_leaks(docs, "d", "t", items, "i", "t").collect()] == [(1, 1)]



def test_leaks_of_wordings_that_many_items_share(spark):
    shared = " ".join(f"common{i}" for i in range(20))
    items = spark.createDataFrame([(k, f"{shared} " + " ".join(f"own{k}x{i}" for i in range(20))) for k in range(5)], "i long, t string")
    # the shared half; 4 words unbroken, then a word changed behind every second; a passage of one item alone, too short
    broken = " ".join(["own1x0 own1x1 own1x2 own1x3 own1x4 own1x5", *(f"x own1x{i} own1x{i + 1}" for i in range(7, 19, 3)), "own1x19"])
    docs = spark.createDataFrame([(1, f"before {shared} behind"), (2, f"before common17 common18 common19 {broken} behind"), (3, " ".join(f"own2x{i}" for i in range(15)))], "d long, t string")
    assert {(r.d, r.i) for r in leaks.find_leaks(docs, "d", "t", items, "i", "t").collect()} == {(1, k) for k in range(5)} | {(2, 1)}


def test_batch_alignment_is_exact():
    def score(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            rows.append([0])
            for j, y in enumerate(b):
                rows[-1].append(max(0, rows[-2][j] + (leaks.MATCH if x == y else leaks.EDIT), rows[-2][j + 1] + leaks.EDIT, rows[-1][j] + leaks.EDIT))
        return max(map(max, rows))

    rng = random.Random(3)
    pairs = [([rng.randrange(6) for _ in range(rng.randrange(1, 40))], [rng.choice([-2, 0, 1, 2, 3, 4, 5]) for _ in range(rng.randrange(1, 60))]) for _ in range(60)]
    got = leaks.align([np.array(a, np.int32) for a, _ in pairs], [np.array(b, np.int32) for _, b in pairs])
    for (a, b), (i, i1, j, j1) in zip(pairs, got.tolist()):
        assert score(a[i:i1], b[j:j1]) == score(a, b) if i1 else score(a, b) == 0



def test_leaks_of_repeated_passages(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words)), (2, " ".join(x for i in range(9) for x in ("take", "one", "step", "back", f"v{i}a", f"v{i}b")))]
    gap = lambda k: " ".join(f"f{k}x{i}" for i in range(40))
    # 40 percent of the item seven times, 30 percent once behind them
    text = " ".join(f"{' '.join(words[:24])} {gap(k)}" for k in range(7)) + " " + " ".join(words[30:48])
    # the item whole: its phrase opens a diagonal for each of its places
    docs = spark.createDataFrame([(1, text), (2, f"{gap(0)} {items[1][1]} {gap(1)}")], "d long, t string")
    got = leaks.find_leaks(docs, "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t")
    assert {(r.d, r.i): round(r.share, 2) for r in got.collect()} == {(1, 1): 0.7, (2, 2): 1.0}



def test_lines_shared_across_blocks(spark, monkeypatch):
    own = lambda k: " ".join(f"{w}{k}" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"))
    note = lambda k: " ".join(f"say{k // 2}x{i}" for i in range(12))
    items = spark.createDataFrame([(k, f"{own(k)}\n{note(k)}") for k in range(12)], "i long, t string")
    docs = spark.createDataFrame([(k, own(k)) for k in range(12)] + [(100 + k, note(k)) for k in range(12)], "d long, t string")
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 1)
    assert {(r.d, r.i) for r in leaks.find_leaks(docs, "d", "t", items, "i", "t").collect()} == {(k, k) for k in range(12)}


# ---- 8


def test_weights():
    tokens, goal = {"a": 900, "b": 90, "c": 10, "d": 0}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.1}
    w, a, size = mixing.temperature_weights(tokens, goal, {"c": 4})
    assert a == 1 and math.isclose(w["b"] / w["c"], 1.5) and "d" not in w and math.isclose(size, min(900 / 0.5, 90 / 0.3, 40 / 0.2))
    w, a, size = mixing.temperature_weights(tokens, goal, {"c": 4}, total=600)
    assert 0 < a < 1 and math.isclose(size, 600) and all(w[s] * size <= {"c": 4}.get(s, 1) * tokens[s] * (1 + 1e-9) for s in w)
    w, a, _ = mixing.temperature_weights(tokens, least_entropy=0.8)
    assert math.isclose(mixing.entropy(w), 0.8, rel_tol=1e-6) and 0 < a < 1
    assert mixing.temperature_weights({}, goal) == ({}, 1.0, 0.0)


def test_mixture_meets_targets_and_caps(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["Big_One", "big-one ", "big one"]), " ".join(_words(rng, rng.randrange(5, 40), ["stone", "river", "tall", "grass"])) + f" {i}") for i in range(3000)]
    docs += [(5000 + i, "small", f"text number {i} of the small source with some words") for i in range(200)]
    docs += [(6000, "small", "text  number 0 of the small source\nwith some words"), (6001, None, "no source"), (6002, "other", "x"), (6003, "small", None), (6004, "small", "")]
    df = spark.createDataFrame(docs, "k long, s string, t string").withColumn("tokens", F.lit("x"))
    goal = spark.createDataFrame([("big-one", 0.9, 1), ("SMALL", 0.1, 3), ("absent", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = mixing.mix_sources(df, "k", "t", "s", goal)
    rows = got.collect()
    cap = {"big-one": 1, "small": 3}
    assert all(1 <= r.repeats <= cap[r.source] for r in rows) and len({r.k for r in rows}) == len(rows)
    assert not {6000, 6001, 6002, 6003, 6004} & {r.k for r in rows}
    shares = {r.source: r for r in mixing.actual_shares(got, goal).collect()}
    assert abs(shares["big-one"].share - 0.9) < 0.005 and abs(shares["small"].share - 0.1) < 0.005 and shares["absent"].tokens == 0
    assert sorted((r.k, r.repeats) for r in mixing.mix_sources(df, "k", "t", "s", goal).collect()) == sorted((r.k, r.repeats) for r in rows)
    assert mixing.mix_sources(df.limit(0), "k", "t", "s", goal).count() == 0


def test_wanted_size(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"some words of the text number {i}") for i in range(400)], "k long, s string, t string")
    goal = spark.createDataFrame([("a", 0.5, 5), ("b", 0.5, 5)], "source string, target_share double, max_repeats int")
    one = mixing.mix_sources(df, "k", "t", "s", goal, total=1000)
    used = one.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0]
    assert 970 <= used <= 1000 and {r.repeats for r in one.collect()} == {1}


# ---- queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, queries.queries()[name], queries.ORACLE[name])


COLUMNS = {
    "p1_found": ["field_name:string", "row_id:bigint"],
    "p2_found": ["row_id:bigint", "line_no:int", "kind:string", "fixed:string"],
    "p3_found": ["first_hint_id:bigint", "spoken_hint_id:bigint", "reason_hint_id:bigint"],
    "p4_found": ["row_id:bigint", "plain:string"],
    "p5_found": ["row_id:bigint", "end_pos:int"],
    "p6_found": ["row_id:bigint"],
    "p7_found": ["doc_id:bigint", "item_id:bigint"],
    "p9_found": ["doc_id:bigint", "kind:string", "found:string"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    if name in COLUMNS:
        assert [f"{n}:{t}" for n, t in df.dtypes] == COLUMNS[name]
    n = df.count()
    assert n > 0 and (name not in COLUMNS or df.distinct().count() == n)


def test_blocks_are_parted_however_many_there_are(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id"), F.lit("s").alias("source"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    want = 0.4 * mixing.mix_sources(docs, "id", "text", "source", targets).agg(F.sum("tokens")).first()[0]
    for fanout, least in ((4, 8), (3, 2), (4096, 64)):
        monkeypatch.setattr(mixing, "FANOUT", fanout)
        monkeypatch.setattr(mixing, "BLOCK_DOCS", least)
        got = mixing.mix_sources(docs, "id", "text", "source", targets, total=want).agg(F.sum("tokens"), F.max("repeats"), F.count("*"), F.countDistinct("id")).first()
        assert want - 8 < got[0] <= want and got[1] == 1 and got[2] == got[3]


def test_copies_and_the_size_there_is(spark):
    docs = spark.createDataFrame([(1, "a", "one text"), (2, "a", "one  text"), (3, "b", "two text")], "id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    ids = lambda **how: {r.id for r in mixing.mix_sources(docs, "id", "text", "source", targets, **how).collect()}
    assert ids() == {1, 3} and ids(copies="keep") == {1, 2, 3} and ids(total="there") == {1, 3}
    with pytest.raises(ValueError):
        ids(copies="drop")
