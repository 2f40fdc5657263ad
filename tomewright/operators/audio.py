"""Audio as tables: probes and gates, silence, levels, voice checks, durations, timelines and their metadata."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.batches import filled


def render_gate(chunks: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``ok``, ``error_kind`` (missing, unreadable, zero_duration), ``duration_s`` for every chunk.

    ``probes`` has ``keys``, ``readable``, ``frames``, ``sample_rate``. Repeated chunks are reported once; of repeated
    probes the best counts.
    """
    best = probes.groupBy(*keys).agg(F.max(F.struct(F.coalesce("readable", F.lit(False)).alias("readable"), F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("sample_rate", F.lit(0)).alias("sample_rate"))).alias("p"))
    rows = chunks.select(*keys).distinct().join(best, keys, "left")
    kind = F.when(F.col("p").isNull(), "missing").when(~F.col("p.readable"), "unreadable").when((F.col("p.frames") <= 0) | (F.col("p.sample_rate") <= 0), "zero_duration")
    rows = rows.withColumn("error_kind", kind)
    return rows.select(*keys, F.col("error_kind").isNull().alias("ok"), "error_kind", F.when(F.col("error_kind").isNull(), F.col("p.frames") / F.col("p.sample_rate")).alias("duration_s"))


def duration_faults(chunks: DataFrame, probes: DataFrame, keys: list[str], least_s: float = 0.5, chars_a_second: float = 10.0) -> DataFrame:
    """``keys``, ``fault`` (too_short, too_long), ``duration_s``: an extension of the gate for chunks that pass it.

    A chunk is too long if it takes more seconds than its characters at ``chars_a_second``. ``chunks`` also has ``text``;
    of repeated chunks the longest text counts, a null text has no characters.
    """
    sizes = chunks.groupBy(*keys).agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    rows = render_gate(chunks, probes, keys).filter("ok").join(sizes, keys)
    fault = F.when(F.col("duration_s") < least_s, "too_short").when(F.col("duration_s") > F.col("chars") / chars_a_second, "too_long")
    return rows.select(*keys, fault.alias("fault"), "duration_s").filter("fault IS NOT NULL")


def silence_ratio(samples: Column, below_db: float = -50.0) -> Column:
    """Share of samples under a level; null for no samples. Beside :func:`duration_faults` the other check of the extension."""
    limit = 10 ** (below_db / 20)
    quiet = F.size(F.filter(samples, lambda x: F.abs(x) < limit))
    return F.when(F.size(samples) > 0, quiet / F.size(samples))


def chapter_durations(probes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``chunks``, ``duration_ns``: of the readable probes.

    Frames are summed by sample rate and only the sums are divided, to whole nanoseconds, so that nothing is lost by the
    chunk and the result does not depend on an order.
    """
    ok = F.coalesce(F.col("readable"), F.lit(False)) & (F.col("frames") > 0) & (F.col("sample_rate") > 0)
    by_rate = probes.filter(ok).groupBy(*keys, F.col("sample_rate").alias("_rate")).agg(F.count(F.lit(1)).alias("_chunks"), F.sum("frames").alias("_frames"))
    ns = F.expr("cast(_frames as decimal(28,0)) * 1000000000 div _rate")
    return by_rate.groupBy(*keys).agg(F.sum("_chunks").alias("chunks"), F.sum(ns).alias("duration_ns"))


def timeline(durations: DataFrame, book: str, order: str, duration: str = "duration_ms", per_ms: int = 1) -> DataFrame:
    """``book``, ``order``, ``start_ms``, ``end_ms``: chapters laid end to end, in numeric order.

    ``duration`` is in whole parts of which ``per_ms`` make a millisecond; only the marks are cut to milliseconds.
    """
    w = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = durations.select(book, order, F.col(duration).alias("_part"), F.sum(duration).over(w).alias("_end"))
    return ends.select(book, order, F.expr(f"(_end - _part) div {per_ms}").alias("start_ms"), F.expr(f"_end div {per_ms}").alias("end_ms"))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([=;#\\\n])", r"\\$1")


def ffmetadata(chapters: DataFrame, book: str, order: str, title: str, book_title: str, author: str, escape: bool = False) -> DataFrame:
    """``book``, ``metadata``: the chapter file of each book; ``chapters`` has ``start_ms`` and ``end_ms``."""
    esc = _escaped if escape else (lambda c: c)
    block = F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), esc(F.coalesce(F.col(title), F.lit(""))))
    rows = chapters.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("bs"), F.max(book_title).alias("t"), F.max(author).alias("a"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), esc(F.coalesce("t", F.lit(""))), F.lit("\nartist="), esc(F.coalesce("a", F.lit(""))))
    return rows.select(book, F.concat(head, F.lit("\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n"), F.lit("\n")).alias("metadata"))


def progress(done: Column, total: Column) -> Column:
    """Whole percent, halves to even; 0 of nothing."""
    return F.when(total > 0, F.bround(done * 100 / total).cast("int")).otherwise(0)


# ---- samples


def silence_compressed(x: np.ndarray, rate: int, threshold: float = 0.01, max_gap_ms: int = 600, edge_ms: int = 50) -> np.ndarray:
    """Samples without long silences: edges cut to ``edge_ms``, gaps to ``max_gap_ms``; 0 switches it off."""
    if max_gap_ms <= 0 or not x.size:
        return x
    level = np.abs(x) if x.ndim == 1 else np.abs(x).max(axis=1)
    loud = np.flatnonzero(level > threshold)
    edge, gap = int(rate * edge_ms / 1000), int(rate * max_gap_ms / 1000)
    if not loud.size:
        return x[: min(len(x), edge)]
    # each frame's distance behind the last loud one tells whether it is kept
    ix = np.arange(len(x))
    behind = ix - np.maximum.accumulate(np.where(level > threshold, ix, -1))
    inner = (ix > loud[0]) & (ix < loud[-1])
    keep = np.where(ix <= loud[0], ix >= loud[0] - edge, np.where(inner, behind <= gap, ix <= loud[-1] + edge))
    return x[keep]


def _compressed(flat: np.ndarray, sizes: np.ndarray, rates: np.ndarray, threshold: float, max_gap_ms: int, edge_ms: int) -> np.ndarray:
    """Which of the samples of many signals, laid end to end, :func:`silence_compressed` would keep."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    loud = np.flatnonzero(np.abs(flat) > threshold)
    lo, hi = np.searchsorted(loud, starts), np.searchsorted(loud, ends)
    has = hi > lo
    edge, gap = (rates * edge_ms / 1000).astype(np.int64), (rates * max_gap_ms / 1000).astype(np.int64)
    # a signal without a loud sample keeps its first edge
    first = np.where(has, loud[np.minimum(lo, max(0, len(loud) - 1))] if len(loud) else 0, starts)
    last = np.where(has, loud[np.maximum(hi - 1, 0)] if len(loud) else 0, starts - 1)
    ix = np.arange(len(flat))
    behind = np.full(len(flat), -1, np.int64)
    behind[loud] = loud
    np.maximum.accumulate(behind, out=behind)
    spread = lambda x: np.repeat(x, sizes)
    f, e = spread(first), spread(edge)
    return np.where(ix <= f, ix >= np.where(spread(has), f - e, f), False) & spread(has) | (ix > f) & (ix < spread(last)) & (ix - behind <= spread(gap)) | (ix >= spread(last)) & (ix > np.where(spread(has), f, f - 1)) & (ix <= spread(last) + e)


def compress_silence(df: DataFrame, samples: str, rate: str, threshold: float = 0.01, max_gap_ms: int = 600, edge_ms: int = 50) -> DataFrame:
    """``df`` with ``samples`` (array of float) compressed; ``rate`` names its sample rate. Null and empty stay as they are.

    The signals of a batch are worked on as one array; see :func:`silence_compressed` for what is kept.
    """
    if max_gap_ms <= 0:
        return df
    kind = df.schema[samples].dataType

    @F.arrow_udf(kind)
    def run(x: pa.Array, r: pa.Array) -> pa.Array:
        valid = np.asarray(x.is_valid())
        sizes = np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64)
        flat = np.asarray(x.flatten())
        keep = _compressed(flat, sizes, np.asarray(pc.fill_null(r, 0), np.float64), threshold, max_gap_ms, edge_ms)
        kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes), keep, len(sizes)).astype(np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32), mask=np.concatenate([~valid, [False]]))
        return pa.ListArray.from_arrays(offsets, pa.array(flat[keep], x.type.value_type))

    return df.withColumn(samples, run(samples, rate))


def peak_db(samples: Column) -> Column:
    """Peak level in decibels of full scale; null for silence."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak > 0, 20 * F.log10(peak))


def voice_checks(df: DataFrame, key: str, samples: str, rate: str, channels: str) -> DataFrame:
    """``key``, ``ok``, ``problems``, ``warnings`` of recordings meant as a voice reference."""
    n = F.size(samples)
    secs = n / F.col(rate)
    peak = F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0))
    rms = F.when(n > 0, F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / n)).otherwise(0.0)
    problems = F.array_compact(F.array(F.when(secs < 5, "too_short"), F.when(rms < 1e-3, "silent")))
    warnings = F.array_compact(F.array(F.when((secs >= 5) & ((secs < 10) | (secs > 20)), "length"), F.when(F.col(rate) != 24_000, "rate"), F.when(F.col(channels) > 1, "channels"), F.when(peak >= 0.99, "clipping")))
    return df.select(key, (F.size(problems) == 0).alias("ok"), problems.alias("problems"), warnings.alias("warnings"))


# ---- WAV


def wav_bytes(x: np.ndarray, rate: int, trailing_ms: int = 0) -> bytes:
    """A 16-bit PCM file of mono samples from -1 to 1, followed by silence."""
    x = np.concatenate([np.asarray(x, np.float64), np.zeros(max(0, int(rate * trailing_ms / 1000)))])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(x * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with wave.open(io.BytesIO(content)) as w:
                    rows.append((path, True, w.getnframes(), w.getframerate()))
            except (wave.Error, EOFError, TypeError):
                rows.append((path, False, None, None))
        yield pd.DataFrame({"path": [r[0] for r in rows], "readable": [r[1] for r in rows], "frames": pd.array([r[2] for r in rows], "Int64"), "sample_rate": pd.array([r[3] for r in rows], "Int32")})


PROBE = T.StructType([T.StructField("path", T.StringType()), T.StructField("readable", T.BooleanType()), T.StructField("frames", T.LongType()), T.StructField("sample_rate", T.IntegerType())])


def probe_wavs(files: DataFrame) -> DataFrame:
    """``path``, ``readable``, ``frames``, ``sample_rate`` of files read as ``binaryFile``."""
    return files.select("path", "content").mapInPandas(filled(_probe), PROBE)


def _samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with wave.open(io.BytesIO(content)) as w:
                    if w.getsampwidth() != 2:
                        raise wave.Error("not 16-bit")
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
                    rows.append((path, x, w.getframerate(), w.getnchannels()))
            except (wave.Error, EOFError, TypeError, ValueError):
                rows.append((path, None, None, None))
        yield pd.DataFrame({"path": [r[0] for r in rows], "samples": [r[1] for r in rows], "sample_rate": pd.array([r[2] for r in rows], "Int32"), "channels": pd.array([r[3] for r in rows], "Int32")})


def read_wavs(files: DataFrame) -> DataFrame:
    """``path``, ``samples`` (-1 to 1, channels in turn), ``sample_rate``, ``channels`` of 16-bit files read as ``binaryFile``; null for others."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType())])
    return files.select("path", "content").mapInPandas(filled(_samples), schema)


Synth = Callable[[str], tuple[np.ndarray, int]]


def render_chunks(chunks: DataFrame, keys: list[str], done: DataFrame, synth: Synth, max_gap_ms: int = 600) -> DataFrame:
    """``keys``, ``wav``: audio of the chunks that ``done`` (``keys``) lacks, by an injected ``synth(text) -> (samples, rate)``.

    The parallelism is that of the partitions; an engine that is loaded lazily is loaded once in each worker.
    """
    todo = chunks.join(done.select(*keys).distinct(), keys, "left_anti").select(*keys, "text", "trailing_silence_ms")
    schema = T.StructType([*(chunks.schema[k] for k in keys), T.StructField("wav", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wavs = []
            for text, ms in zip(pdf["text"], pdf["trailing_silence_ms"]):
                x, rate = synth(text or "")
                wavs.append(wav_bytes(silence_compressed(np.asarray(x), rate, max_gap_ms=max_gap_ms), rate, int(ms) if pd.notna(ms) else 0))
            yield pdf[keys].assign(wav=wavs)

    return todo.mapInPandas(filled(run), schema)
