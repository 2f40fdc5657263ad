"""EPUB files as rows: the spine in order, each item with its title; one row of ``binaryFile`` in, one row an item out."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import filled
from ..operators.documents import number_chapters

ITEM = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("book_title", T.StringType()), T.StructField("spine_ix", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("source_spine_id", "nav_title", "name", "html", "error_kind")]
)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def nav_titles(z: zipfile.ZipFile, manifest: dict[str, tuple[str, str, str]], folder: str) -> dict[str, str]:
    """Title of each target, fragment left off, from the navigation; a later entry overwrites an earlier one."""
    titles: dict[str, str] = {}
    for href, kind, props in manifest.values():
        is_nav, is_ncx = "nav" in props.split(), kind == "application/x-dtbncx+xml"
        if not (is_nav or is_ncx):
            continue
        try:
            root = ET.fromstring(z.read(posixpath.normpath(posixpath.join(folder, href))))
        except (KeyError, ET.ParseError):
            continue
        base = posixpath.dirname(posixpath.join(folder, href))
        for e in root.iter():
            if is_nav and _local(e.tag) == "a" and e.get("href"):
                target, title = e.get("href"), "".join(e.itertext())
            elif is_ncx and _local(e.tag) == "navPoint":
                content = next((x for x in e if _local(x.tag) == "content"), None)
                label = next((x for x in e if _local(x.tag) == "navLabel"), None)
                if content is None or label is None:
                    continue
                target, title = content.get("src") or "", "".join(label.itertext())
            else:
                continue
            titles[posixpath.normpath(posixpath.join(base, unquote(target.split("#")[0])))] = " ".join(title.split())
    return titles


def read_epub(path: str, content: bytes) -> list[tuple]:
    """Rows of :data:`ITEM`; a file that can't be read gives one row with its ``error_kind``."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        container = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        package = ET.fromstring(z.read(opf))
    except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration, TypeError):
        return [(path, None, None, None, None, None, None, "unreadable")]
    folder = posixpath.dirname(opf)
    title = next((e.text for e in package.iter() if _local(e.tag) == "title"), None)
    manifest = {e.get("id"): (unquote(e.get("href", "")), e.get("media-type", ""), e.get("properties") or "") for e in package.iter() if _local(e.tag) == "item"}
    titles = nav_titles(z, manifest, folder)
    rows = []
    for ix, ref in enumerate(e for e in package.iter() if _local(e.tag) == "itemref"):
        item = manifest.get(ref.get("idref"))
        if item is None or item[1] not in ("application/xhtml+xml", "text/html") or "nav" in item[2].split():
            continue
        name = posixpath.normpath(posixpath.join(folder, item[0]))
        try:
            html = z.read(name).decode("utf-8", "replace")
        except KeyError:
            continue
        rows.append((path, title, ix, ref.get("idref"), titles.get(name), posixpath.basename(name), html, None))
    return rows


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in read_epub(p, c)]
        out = pd.DataFrame(rows, columns=[f.name for f in ITEM.fields])
        yield out.assign(spine_ix=out["spine_ix"].astype("Int32"))


def spine_items(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(filled(_items), ITEM)


def read_chapters(spark: SparkSession, glob: str) -> DataFrame:
    """The chapters of all EPUB files under ``glob`` as rows of ``chapters_raw``, front and back matter left out.

    A title is that of the navigation, else the first heading, else the item's name.
    """
    items = spine_items(spark, glob).filter("error_kind IS NULL")
    rows = items.withColumn("body", X.html_text("html")).withColumn("title", F.coalesce(F.when(F.col("nav_title") != "", F.col("nav_title")), F.try_element_at(X.html_headings(F.col("html")), F.lit(1)), "name"))
    numbered = number_chapters(rows, "path", "spine_ix", "title", "body")
    return numbered.select("path", "book_title", "chapter_index", "title", "source_spine_id", "html", X.word_count(F.col("body")).alias("word_count_estimate"), X.html_features(F.col("html")).alias("f")).select("path", "book_title", "chapter_index", "title", "source_spine_id", "html", "word_count_estimate", "f.*")
