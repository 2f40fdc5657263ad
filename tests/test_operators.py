import io
import json
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright import settings as S
from tomewright.functions.payload import payload_record
from tomewright.operators import adaptation as A
from tomewright.operators import audio as U
from tomewright.operators import documents as D
from tomewright.sources import epub, files
from tomewright.streaming import ingest

GOOD = json.dumps({"adapted_text": "w " * 90, "pronunciation_hints": [{"term": "API", "spoken_as": "A P I"}]})


@pytest.mark.parametrize(
    ("payload", "state"),
    [(None, "null"), ("", "broken"), ("no json", "broken"), (GOOD, "object"), (f" {GOOD}\n", "object"), (f"Here: {GOOD}", "wrapped"), (GOOD[:60], "open"), ('{"adapted_text": "a } b', "open"), ("{'a': 1}", "broken"), ('{"a": 1} x', "wrapped")],
)
def test_payload_state(payload, state):
    assert payload_record(payload)[0] == state


@pytest.mark.parametrize(
    ("payload", "kind"),
    [
        (GOOD, None),
        (None, "missing_file"),
        (GOOD[:50], "json_parse_error"),
        ("Sure! " + GOOD, "json_parse_error"),
        (json.dumps({"adapted_text": "w " * 90, "hints": []}), "schema_error"),
        (json.dumps({"adapted_text": ""}), "schema_error"),
        (json.dumps({"adapted_text": "w " * 90, "pronunciation_hints": [{"term": "x", "spoken_as": ""}]}), "schema_error"),
        (json.dumps({"adapted_text": "w " * 90 + "<pre> x"}), "markdown_artifact"),
        (json.dumps({"adapted_text": "w " * 90 + "<H1>x"}), "markdown_artifact"),
        (json.dumps({"adapted_text": "w"}), "length_anomaly"),
        (json.dumps({"adapted_text": "w " * 111}), "length_anomaly"),
        (json.dumps({"adapted_text": "w " * 110}), None),
        (json.dumps({"adapted_text": "w " * 30}), None),
        (json.dumps({"adapted_text": "  "}), "length_anomaly"),
    ],
)
def test_gate(spark, payload, kind):
    raw = spark.createDataFrame([(1, "w " * 100)], "k int, source string")
    got = A.gate(raw, spark.createDataFrame([(1, payload), (2, GOOD)], "k int, payload string"), ["k"], "source").collect()
    assert [(r.k, r.ok, r.error_kind) for r in got] == [(1, kind is None, kind)]


def test_gate_without_a_row_and_empty(spark):
    raw = spark.createDataFrame([(1, None)], "k int, source string")
    none = spark.createDataFrame([], "k int, payload string")
    assert A.gate(raw, none, ["k"], "source").first().error_kind == "missing_file"
    assert A.gate(raw.limit(0), none, ["k"], "source").count() == 0


def test_lexicon_conflicts(spark):
    rows = [("b", 1, "API", "A P I", "acronym"), ("b", 2, "API", "appy", ""), ("b", 3, "API", "A P I", "z"), ("b", 4, "x", "ex", "")]
    got = A.merge_lexicon(spark.createDataFrame(rows, "book string, n int, term string, spoken_as string, reason string"), "book", ["n"])
    assert {(r.term, r.spoken_as, r.reason, r.first_n) for r in got.collect()} == {("API", "A P I", "acronym [conflict with: appy]", 1), ("x", "ex", "", 4)}


def test_retries_end_after_three_rounds(spark):
    raw = spark.createDataFrame([(i, "w " * 50) for i in range(4)], "k int, source string")
    done = spark.createDataFrame([(0, json.dumps({"adapted_text": "w " * 50}))], "k int, payload string")

    def adapter(batches):
        for pdf in batches:
            ok = [(k == 1) or (k == 2 and e is not None) for k, e in zip(pdf["k"], pdf["error_kind"])]
            yield pdf[["k"]].assign(payload=[json.dumps({"adapted_text": "w " * 50}) if o else "nothing" for o in ok])

    good, bad = A.adapt_chapters(raw, done, ["k"], "source", adapter)
    assert {(r.k, r.attempt) for r in good.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert [(r.k, r.error_kind) for r in bad.collect()] == [(3, "json_parse_error")]
    assert A.run_summary(good, bad).first().retried == 1


def test_message(spark):
    df = spark.createDataFrame([("{}", "book", "schema_error", None), ("{}", "", None, None)], "j string, c string, k string, d string")
    a, b = (r[0] for r in df.select(A.build_message(*(F.col(c) for c in "jckd"))).collect())
    assert all(x in a for x in ("{}", "book", "schema_error")) and b.endswith("{}") and "refused" not in b and "whole book" not in b


def test_context_budget(spark):
    df = spark.createDataFrame([("a", "x" * 400), ("b", ""), ("c", "x" * 4000)], "k string, t string")
    assert {(r.k, r.tokens, r.included) for r in A.context_budget(df, "k", "t", 200).collect()} == {("a", 100, True), ("b", 1, False), ("c", 1000, False)}


def test_dehyphenate(spark):
    df = spark.createDataFrame([(1, "a re-\ntrieval and well-\nknown"), (2, None), (3, "")], "k int, t string")
    words = spark.createDataFrame([("retrieval",)], "word string")
    assert {r.k: r.t for r in D.dehyphenate(df, "k", "t", words).collect()} == {1: "a retrieval and well-known", 2: None, 3: ""}


def test_sections(spark):
    text = "before\n# One #\nbody\n## Sub\nmore\n# Empty\n\n# Two\nlast"
    df = spark.createDataFrame([(1, text, "fb"), (2, "no headings here", "fb"), (3, "", "fb")], "k int, t string, fb string").withColumn("lv", D.heading_level(F.col("t")))
    got = [(r.k, r.section_ix, r.title, r.body) for r in D.split_sections(df, "k", "t", "lv", "fb").orderBy("k", "section_ix").collect()]
    assert got == [(1, 0, "Front Matter", "before"), (1, 1, "One", "body\n## Sub\nmore"), (1, 2, "Two", "last"), (2, 0, "fb", "no headings here")]


def test_outline(spark):
    outline = spark.createDataFrame([("d", 0, 1, "A", 2), ("d", 1, 2, "sub", 3), ("d", 2, 1, "B", 5), ("d", 3, 1, "C", 5), ("e", 0, 1, "only", 1)], "doc string, ix int, level int, title string, start_page int")
    pages = spark.createDataFrame([("d", 6), ("e", 9)], "doc string, page_count int")
    got = {(r.title, r.page_ix) for r in D.outline_sections(outline, pages, "doc").collect()}
    assert got == {("A", 2), ("A", 3), ("A", 4), ("C", 5), ("C", 6)}


def test_guard_and_skip(spark):
    pages = spark.createDataFrame([("a", "x" * 60), ("a", "x" * 60), ("b", " "), ("b", None)], "d string, t string")
    assert {(r.d, r.error_kind) for r in D.scan_guard(pages, "d", "t").collect()} == {("a", None), ("b", "scanned")}
    rows = spark.createDataFrame([("b", 0, "Copyright", "w " * 20), ("b", 1, "One", "w " * 20), ("b", 2, "Index", "w " * 20), ("b", 3, "Short", "w"), ("b", 4, "Index of names", "w " * 20)], "b string, o int, t string, x string")
    assert {(r.t, r.chapter_index) for r in D.number_chapters(rows, "b", "o", "t", "x").collect()} == {("One", 0), ("Index of names", 1)}


def test_silence():
    x = np.concatenate([np.zeros(200), np.ones(10), np.zeros(900), np.ones(10), np.zeros(300)])
    assert len(U.silence_compressed(x, 1000)) == 50 + 10 + 600 + 10 + 50
    assert len(U.silence_compressed(x, 1000, max_gap_ms=0)) == len(x)
    assert len(U.silence_compressed(np.zeros(500), 1000)) == 50
    assert len(U.silence_compressed(np.zeros(0), 1000)) == 0
    stereo = np.stack([x, np.zeros(len(x))], 1)
    assert U.silence_compressed(stereo, 1000).shape == (720, 2)


def test_wav_round_trip(spark):
    data = U.wav_bytes(np.array([0.0, 0.5, -1.0]), 24000, 10)
    with wave.open(io.BytesIO(data)) as w:
        assert (w.getnframes(), w.getframerate()) == (3 + 240, 24000)
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"junk")), ("c", bytearray())], "path string, content binary")
    assert {(r.path, r.readable, r.frames) for r in U.probe_wavs(df).collect()} == {("a", True, 243), ("b", False, None), ("c", False, None)}


def test_timeline_orders_numbers(spark):
    df = spark.createDataFrame([("b", 100, 5), ("b", 9, 7), ("b", 10, 1)], "b string, n int, duration_ms long")
    assert [(r.n, r.start_ms, r.end_ms) for r in U.timeline(df, "b", "n").orderBy("n").collect()] == [(9, 0, 7), (10, 7, 8), (100, 8, 13)]


def _epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(3))
        z.writestr("OEBPS/p.opf", f'<package xmlns="u"><metadata><title>T</title></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine><itemref idref="n"/><itemref idref="c0"/><itemref idref="gone"/><itemref idref="c1"/><itemref idref="c2"/></spine></package>')
        z.writestr("OEBPS/nav.xhtml", '<html xmlns="h"><body><a href="c0.xhtml">Old</a><a href="c0.xhtml#s">Start</a></body></html>')
        z.writestr("OEBPS/c0.xhtml", "<html><p>" + "word " * 20 + "</p></html>")
        z.writestr("OEBPS/c1.xhtml", "<html><h2>Two</h2><pre>x</pre>" + "word " * 20 + "</html>")
        z.writestr("OEBPS/c2.xhtml", "<html>short</html>")


def test_epub(spark, tmp_path):
    _epub(tmp_path / "a.epub")
    (tmp_path / "bad.epub").write_bytes(b"none")
    got = [(r.book_title, r.chapter_index, r.title, r.word_count_estimate, r.has_code) for r in epub.read_chapters(spark, str(tmp_path / "*.epub")).orderBy("chapter_index").collect()]
    assert got == [("T", 0, "Start", 20, False), ("T", 1, "Two", 22, True)]
    assert epub.spine_items(spark, str(tmp_path / "*.epub")).filter("error_kind = 'unreadable'").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "100_x.json").write_text("{}\n")
    (tmp_path / "02_y.json").write_text("{")
    assert {(r.chapter_index, r.payload) for r in files.read_payloads(spark, str(tmp_path)).collect()} == {(100, "{}\n"), (2, "{")}
    df = spark.createDataFrame([("a.EPUB",), ("b.pdf",), ("c.txt",), ("d",)], "p string")
    assert [r[0] for r in df.select(files.input_kind(F.col("p"))).collect()] == ["epub", "pdf", None, None]
    files.write_table(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    voices = spark.createDataFrame([("/v/a.wav",), ("/v/a.preview.wav",), ("/v/b.txt",)], "path string")
    assert [(r.name, r.active) for r in files.voice_files(voices, "/v/a.wav").collect()] == [("a", True)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [("b", i, json.dumps({"adapted_text": f"Text number {i} of the book."})) for i in range(3)] + [("b", 9, "broken")]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, payload string").withColumn("received_at", F.current_timestamp())
    df.write.parquet(src)
    ingest.chunk_stream(spark, src, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    df.filter("chapter_index = 0").withColumn("chapter_index", F.lit(7)).write.mode("append").parquet(src)
    ingest.chunk_stream(spark, src, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("[chunk]\nmax_chars = 300\nbeat_ms = 1\n")
    (tmp_path / "c.local.toml").write_text("[chunk]\nmax_chars = 200\n")
    cfg = S.chunk_settings(S.read_toml(str(tmp_path / "c.toml")))
    assert (cfg.max_chars, cfg.beat_ms, cfg.title_ms) == (200, 1, 800)
    with pytest.raises(ValueError):
        S.ChunkSettings(max_chars=10)
    with pytest.raises(ValueError):
        S.chunk_settings({"chunk": {"other": 1}})
    assert S.output_path(None, "", "out", "x") == "out/x.m4b"


def test_latest_rows(spark):
    rows = [("a", 1, 1, "old"), ("a", 1, 2, "new"), (None, 1, 5, "x"), (None, 1, 4, "y"), ("b", None, None, "only")]
    df = spark.createDataFrame(rows, "k string, n int, o int, v string")
    assert {r.v for r in A.latest(df, ["k", "n"], ["o"]).collect()} == {"new", "x", "only"}
    assert {r.v for r in A.latest(df, ["k", "n"], ["o", "v"]).collect()} == {"new", "x", "only"}
    assert A.latest(df.limit(0), ["k"], ["o"]).count() == 0


def test_duration_faults(spark):
    chunks = spark.createDataFrame([("a", "x" * 100), ("b", "x" * 100), ("c", "x" * 100), ("d", None), ("e", "x")], "k string, text string")
    probes = spark.createDataFrame([("a", True, 5000, 1000), ("b", True, 400, 1000), ("c", True, 11000, 1000), ("d", True, 1000, 1000), ("e", False, 0, 1000)], "k string, readable boolean, frames long, sample_rate int")
    assert {(r.k, r.fault) for r in U.duration_faults(chunks, probes, ["k"]).collect()} == {("b", "too_short"), ("c", "too_long"), ("d", "too_long")}
    levels = spark.createDataFrame([([0.0, 0.001, 0.5, -0.5],), ([],)], "x array<double>")
    assert [r[0] for r in levels.select(U.silence_ratio(F.col("x"))).collect()] == [0.5, None]


# ---- voices, modes, reports, ledger


@pytest.mark.parametrize(
    ("asked", "configured", "there", "want"),
    [
        ("/x/a.wav", None, ["/x/a.wav"], "/x/a.wav"), ("own/a.wav", "b", ["/r/own/a.wav"], "/r/own/a.wav"), ("a", None, ["/r/voices/a.wav", "/r/voices/default.wav"], "/r/voices/a.wav"), ("a.wav", None, ["/r/a.wav"], "/r/a.wav"),
        ("", "b", ["/r/voices/b.wav", "/r/voices/default.wav"], "/r/voices/b.wav"), (None, None, ["/r/voices/default.wav", "/r/voice/reference.wav"], "/r/voices/default.wav"), (None, "", ["/r/voice/reference.wav"], "/r/voice/reference.wav"),
        ("gone", None, ["/r/voices/default.wav"], None), (None, "gone", ["/r/voices/default.wav"], None), ("no/such.wav", "b", ["/r/voices/b.wav"], None), (None, None, ["/r/voices/other.wav"], None), (None, None, [], None),
    ],
)
def test_voice_resolution(spark, asked, configured, there, want):
    listing = spark.createDataFrame([(p,) for p in there], "path string")
    got = files.resolve_voice(listing, asked, configured, "/r")
    if want:
        assert [r.path for r in got.collect()] == [want]
    else:
        with pytest.raises(Exception, match="voice"):
            got.collect()


def test_adapt_mode():
    S.check_adapt_mode("api", "some-model")
    for mode, model in (("agent", "m"), ("other", "m"), ("api", "")):
        with pytest.raises(ValueError):
            S.check_adapt_mode(mode, model)


def test_report_json(spark):
    df = spark.createDataFrame([("b", 2, "x", False), ("b", 1, None, True), ("c", 1, None, True)], "book string, n int, error_kind string, ok boolean")
    got = {r.book: json.loads(r.report) for r in A.report_json(df, "book", "n", "error_kind").collect()}
    assert got == {"b": {"ok": False, "results": [{"n": 1, "ok": True}, {"n": 2, "error_kind": "x", "ok": False}]}, "c": {"ok": True, "results": [{"n": 1, "ok": True}]}}


def test_ledger(spark, tmp_path):
    cols = "book_id string, stage string, detail string, at long"
    path = str(tmp_path / "ledger")
    A.append_ledger(spark.createDataFrame([("a", "parse", "one", 1), ("a", "adapt", "x", 2)], cols), path)
    A.append_ledger(spark.createDataFrame([("a", "parse", "two", 3)], cols), path)
    got = {tuple(r) for r in A.ledger_status(spark.read.parquet(path)).collect()}
    assert got == {("a", "parse", "two", 3, 2), ("a", "adapt", "x", 2, 1)}
    with pytest.raises(Exception, match="unknown stage"):
        A.append_ledger(spark.createDataFrame([("a", "bake", "", 1)], cols), path)
    assert A.ledger_status(spark.createDataFrame([], cols)).count() == 0


# ---- audio


def test_silence_of_many_signals_like_one_by_one(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        x = np.where(rng.random(rng.integers(0, 90)) < rng.choice([0.0, 0.1, 0.5]), 0.5, 0.001)
        rows.append((i, None if i == 7 else [float(v) for v in x], int(rng.choice([500, 1000]))))
    df = spark.createDataFrame(rows, "i int, x array<double>, r int").repartition(3)
    got = {r.i: r.x for r in U.compress_silence(df, "x", "r", max_gap_ms=6, edge_ms=4).collect()}
    for i, x, r in rows:
        assert got[i] == (None if x is None else U.silence_compressed(np.array(x), r, max_gap_ms=6, edge_ms=4).tolist()), i
    assert U.compress_silence(df.limit(0), "x", "r").count() == 0
    assert U.compress_silence(df, "x", "r", max_gap_ms=0).filter("i = 3").first().x == rows[3][1]


def test_durations_lose_nothing_by_the_chunk(spark):
    df = spark.createDataFrame([("b", 1, True, 24001, 24000)] * 10_000 + [("b", 2, True, 1, 3), ("b", 2, True, 2, 3), ("b", 2, True, 22050, 44100), ("b", 2, False, 9, 9), ("b", 2, True, None, 9)], "b string, n int, readable boolean, frames long, sample_rate int")
    got = U.chapter_durations(df, ["b", "n"])
    assert {(r.n, r.chunks, r.duration_ns) for r in got.collect()} == {(1, 10_000, 24001 * 10_000 * 10**9 // 24000), (2, 3, 15 * 10**8)}
    marks = U.timeline(got, "b", "n", "duration_ns", 1_000_000).orderBy("n").collect()
    assert [(r.start_ms, r.end_ms) for r in marks] == [(0, 10_000_416), (10_000_416, 10_001_916)]


def test_wav_round_trip(spark):
    x = np.array([0.0, 0.5, -0.5, 0.25])
    df = spark.createDataFrame([("a", bytearray(U.wav_bytes(x, 8000, 1))), ("b", bytearray(b"junk"))], "path string, content binary")
    got = {r.path: r for r in U.read_wavs(df).collect()}
    assert (got["a"].sample_rate, got["a"].channels, len(got["a"].samples)) == (8000, 1, 4 + 8)
    assert np.allclose(got["a"].samples[:4], x, atol=1e-4) and got["b"].samples is None


# ---- documents


def test_document_source(spark):
    body = "word " * 60
    docs = [(1, "One", f"# A\n\n{body}\n\n## Sub\n\n`x`\n\n# Index\n\n{body}\n\n# B\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n{body}"), (2, "Two", f"{body}"), (3, "Scan", "x"), (4, "Out", "unused"), (5, "Nul", None)]
    pages = [(1, 1, docs[0][2]), (2, 1, docs[1][2]), (3, 1, "x"), (4, 1, f"front {body}"), (4, 2, f"first {body}"), (4, 3, f"second {body}"), (5, 1, None)]
    outline = [(4, 0, 1, "P1", 2), (4, 1, 1, "P2", 3)]
    args = [spark.createDataFrame(docs, "d int, name string, t string"), spark.createDataFrame(pages, "d int, page_ix int, t string"), spark.createDataFrame(outline, "d int, ix int, level int, title string, start_page int"), "d", "name", "t"]
    chapters, refused = D.markdown_sections(*args)
    got = {(r.d, r.chapter_index): r for r in chapters.collect()}
    assert {k: r.title for k, r in got.items()} == {(1, 0): "A", (1, 1): "B", (2, 0): "Two", (4, 0): "P1", (4, 1): "P2"}
    assert got[1, 0].has_code and not got[1, 0].has_tables and got[1, 1].has_tables and "<table>" in got[1, 1].html and got[4, 0].html.startswith("<p>first")
    assert {(r.d, r.error_kind) for r in refused.collect()} == {(3, "scanned"), (5, "scanned")}
    with pytest.raises(Exception, match="scanned"):
        D.markdown_sections(*args, strict=True)[0].collect()


def test_sections_at_a_forced_level_and_none(spark):
    df = spark.createDataFrame([(1, "a\n## x #\nb\n## y\n\n## z\nc", 2), (2, "# q\nb", None), (3, None, 1), (4, "", 1), (5, "# only", 1)], "d int, t string, lv int").withColumn("fb", F.lit("F"))
    got = [tuple(r) for r in D.split_sections(df, "d", "t", "lv", "fb").orderBy("d", "section_ix").collect()]
    assert got == [(1, 0, "Front Matter", "a"), (1, 1, "x", "b"), (1, 2, "z", "c"), (2, 0, "F", "# q\nb")]


def test_chapters_are_numbered_on_their_keys(spark):
    df = spark.createDataFrame([("b", o, t, "w " * 20, i) for i, (o, t) in enumerate([(3, "x"), (1, "y"), (1, "a"), (2, "Index")])], "b string, o int, t string, body string, k int")
    by_key = D.number_chapters(df, "b", "o", "t", "body", key="k")
    assert by_key.columns == [*df.columns, "chapter_index"]
    assert sorted(map(tuple, by_key.collect())) == sorted(map(tuple, D.number_chapters(df, "b", "o", "t", "body").collect()))
    assert {(r.k, r.chapter_index) for r in by_key.collect()} == {(2, 0), (1, 1), (0, 2)}


def test_no_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from tomewright import session

    unset = N(getCheckpointDir=lambda: N(isEmpty=lambda: True))
    context = N(_jsc=N(sc=lambda: unset), master="spark://host:7077", setCheckpointDir=lambda p: None)
    df = N(sparkSession=N(sparkContext=context, conf=N(get=lambda k, d: d)), checkpoint=lambda: "cut")
    with pytest.raises(ValueError, match="checkpoint"):
        session.cut_lineage(df)
    context.master = "local[4]"
    assert session.cut_lineage(df) == "cut"
