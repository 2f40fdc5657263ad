"""Scalar text functions as Spark columns; all but :func:`ascii_fold` and the HTML ones stay in the JVM."""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it; else each use would compute it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without outer white space of any kind, non-breaking included."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def word_count(c: Column) -> Column:
    """Words parted by white space; 0 for blank text, null for null."""
    return let(strip(c), lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, SPACE))))


def unify_line_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def drop_image_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)==>.*?<==", "")


def plain_punctuation(c: Column) -> Column:
    """Typographic quotes, dashes, the ellipsis and the non-breaking space as ASCII."""
    return F.replace(F.translate(c, "“”‘’–— ", "\"\"''-- "), F.lit("…"), F.lit("..."))


def collapse_space(c: Column) -> Column:
    """Runs of blanks and tabs as one space, no blanks before a line's end, at most one empty line, no outer space."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"(?U)[^\S\n]+(?=\n|\z)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def split_lines(c: Column) -> Column:
    """Lines at any line boundary, without an empty one behind a final boundary."""
    at = "\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085\u2028\u2029]"
    none = F.array().cast("array<string>")
    cut = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return let(F.split(c, at), lambda p: F.when((F.size(p) == 1) & (p[0] == ""), none).otherwise(cut(p)))


def drop_page_artifacts(c: Column) -> Column:
    """Without lines that are page numbers, and without short lines (under 60 characters, no headings) that recur three times.

    Sorting a document's short lines puts equal ones side by side, so that one pass finds those that recur.
    """

    def repeated(lines: Column) -> Column:
        short = F.array_sort(F.filter(F.transform(lines, strip), lambda x: (x != "") & ~x.startswith("#") & (F.length(x) < 60)))
        return let(short, lambda s: F.array_distinct(F.filter(s, lambda x, i: (i >= 2) & (F.try_element_at(s, F.greatest(i - 1, F.lit(1))) == x))))

    def keep(lines: Column, often: Column) -> Column:
        return F.array_join(F.filter(lines, lambda x: ~x.rlike(r"(?U)^\s*\d{1,4}\s*$") & ~F.array_contains(often, strip(x))), "\n")

    return let(split_lines(c), lambda lines: let(repeated(lines), lambda often: keep(lines, often)))


#: Fixed value: the form of a note's line.
_NOTE = r"(?U)^\s*\[\^?\d+\]:?\s+\S"


def apply_footnotes(c: Column, policy: str) -> Column:
    """``inline`` keeps note lines, ``skip`` drops them, ``endnote`` moves them behind a Notes heading."""
    if policy == "inline":
        return c
    if policy not in ("skip", "endnote"):
        raise ValueError(f"unknown footnote policy {policy!r}")
    body = lambda lines: F.array_join(F.filter(lines, lambda x: ~x.rlike(_NOTE)), "\n")
    if policy == "skip":
        return body(split_lines(c))

    def moved(lines: Column, notes: Column) -> Column:
        return F.concat(body(lines), F.when(F.size(notes) > 0, F.concat(F.lit("\n\n---\n\n## Notes\n\n"), F.array_join(F.transform(notes, strip), "\n"))).otherwise(F.lit("")))

    return let(split_lines(c), lambda lines: let(F.filter(lines, lambda x: x.rlike(_NOTE)), lambda notes: moved(lines, notes)))


#: Tokens that show a heading to be flattened code, and the length from which on it is none.
CODE_TOKEN = r"[=(){}\[\];]|>>>|\$\s|::|\bprint\(|\bimport\s|\bdef\s|\bclass\s|\bnp\.|\bplt\.|\bself\."
HEADING_LENGTH = 70


def demote_code_headings(c: Column) -> Column:
    """Headings that are code or very long as plain lines; bold marks off the others."""

    def one(x: Column) -> Column:
        inner = strip(F.regexp_replace(strip(F.regexp_extract(x, r"(?U)^#{1,6}(?!#)\s+(.*\S)\s*$", 1)), r"^\*+|\*+$", ""))
        marks = F.regexp_extract(x, r"^(#{1,6})", 1)
        fixed = let(inner, lambda n: F.when((F.length(n) > HEADING_LENGTH) | n.rlike(CODE_TOKEN), n).otherwise(F.concat(marks, F.lit(" "), n)))
        return F.when(~x.rlike(r"(?U)^#{1,6}(?!#)\s+.*\S\s*$"), x).otherwise(fixed)

    return F.array_join(F.transform(split_lines(c), one), "\n")


def clean_markdown(c: Column, footnotes: str = "inline") -> Column:
    """All cleaners that need no dictionary, in the order they depend on each other."""
    c = plain_punctuation(drop_image_marks(unify_line_ends(c)))
    return collapse_space(demote_code_headings(apply_footnotes(drop_page_artifacts(c), footnotes)))


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, what is not ASCII left out; Spark has no function for it."""
    return s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def slugify(c: Column, longest: int | None = None) -> Column:
    """A lower-case ASCII slug, cut at a hyphen if it is longer than ``longest``; ``untitled`` if nothing remains."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")

    def shortened(x: Column) -> Column:
        head = F.substring(x, 1, longest)
        cut = F.regexp_replace(F.regexp_replace(head, r"-[^-]*$", ""), r"^-+|-+$", "")
        return F.when(F.length(x) <= longest, x).when(cut != "", cut).otherwise(head)

    if longest is not None:
        slug = let(slug, shortened)
    return let(slug, lambda x: F.when(x == "", "untitled").otherwise(x))


def safe_filename(c: Column, fallback: str = "book") -> Column:
    bare = strip(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', ""), SPACE, " "))
    return let(strip(F.regexp_replace(bare, r"^\.+|\.+$", "")), lambda n: F.when(n == "", fallback).otherwise(n))


# ---- HTML


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "nav")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "nav") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_text_of(markup: str | None) -> str | None:
    if markup is None:
        return None
    p = _Text()
    p.feed(markup)
    p.close()
    return " ".join(p.parts)


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Visible text: the parts between tags, stripped and joined by one space; script, style and nav left out."""
    return s.map(html_text_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(htmllib.unescape, na_action="ignore")


def html_features(c: Column) -> Column:
    """``has_code``, ``has_math``, ``has_tables`` of a page."""
    return F.struct(
        c.rlike(r"(?i)<(?:pre|code)[\s>/]").alias("has_code"),
        c.rlike(r"""(?i)<math[\s>/]|<[a-z][^>]*\sclass\s*=\s*(?:"(?:[^"]*\s)?math(?:\s[^"]*)?"|'(?:[^']*\s)?math(?:\s[^']*)?'|math[\s>])""").alias("has_math"),
        c.rlike(r"(?i)<table[\s>/]").alias("has_tables"),
    )


def markdown_math(c: Column) -> Column:
    return c.rlike(r"\$\$|\\\(|\\\[")


def html_headings(c: Column) -> Column:
    """The distinct texts of a page's headings, without tags, in order of appearance."""
    inner = F.regexp_extract_all(c, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    # headings are joined for one pass over the entities and parted again
    joined = unescape(F.array_join(F.transform(inner, lambda x: F.regexp_replace(x, r"<[^>]+>", "")), "\u001f"))
    texts = F.transform(F.split(joined, "\u001f"), lambda x: strip(F.regexp_replace(x, SPACE, " ")))
    return F.array_distinct(F.filter(texts, lambda x: x != ""))


def html_markdown(c: Column) -> Column:
    """A page's text as plain Markdown: headings as ``#`` lines, paragraphs parted by empty lines, code as ``[code block]``."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?is)<(pre|code)\b[^>]*>.*?</\1\s*>", "\n\n[code block]\n\n")
    for n in range(1, 7):
        c = F.regexp_replace(c, rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n\n" + "#" * n + " $1\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:p|div|table|ul|ol|section)>", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<li\b[^>]*>", "\n- "), r"(?s)<[^>]+>", "")
    return strip(F.regexp_replace(unescape(c), r"(?U)\n\s*\n\s*\n*", "\n\n"))


# ---- Markdown to HTML

_FENCE = re.compile(r"^(```+|~~~+)\s*([\w+-]*)\s*$")
_RULE_ROW = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$|^\s*\|\s*:?-+:?\s*\|\s*$")
_ITEM = re.compile(r"^\s{0,3}(?:([-*+])|(\d+)[.)])\s+(.*)$")


def _inline(text: str) -> str:
    """Code, links, images and emphasis of one run of text; everything else escaped."""
    kept: list[str] = []

    def code(m: re.Match) -> str:
        kept.append(f"<code>{htmllib.escape(m[2].strip(), quote=False)}</code>")
        return f"\x00{len(kept) - 1}\x00"

    text = htmllib.escape(re.sub(r"(`+)(.+?)\1", code, text.replace("\x00", "")), quote=False)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", lambda m: f'<img alt="{htmllib.escape(m[1])}" src="{htmllib.escape(m[2])}" />', text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)", lambda m: f'<a href="{htmllib.escape(m[2])}">{m[1]}</a>', text)
    text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"<strong>\2</strong>", text)
    text = re.sub(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"<em>\2</em>", text)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)


def _cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip().strip("|").split("|")]


def markdown_html_of(text: str | None) -> str | None:
    """HTML of Markdown: headings, paragraphs, flat lists, quotations, rules, tables and fenced code; see :func:`_inline`."""
    if text is None:
        return None
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        x = lines[i]
        if not x.strip():
            i += 1
        elif m := _FENCE.match(x):
            j = i + 1
            while j < len(lines) and not lines[j].startswith(m[1]):
                j += 1
            body = "".join(f"{htmllib.escape(y, quote=False)}\n" for y in lines[i + 1 : j])
            out.append(f"<pre><code{f' class=\"language-{m[2]}\"' if m[2] else ''}>{body}</code></pre>")
            i = j + 1
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", x):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
            i += 1
        elif re.match(r"^\s{0,3}(?:-\s*){3,}$|^\s{0,3}(?:\*\s*){3,}$", x):
            out.append("<hr />")
            i += 1
        elif "|" in x and i + 1 < len(lines) and _RULE_ROW.match(lines[i + 1]):
            head, j, rows = _cells(x), i + 2, []
            while j < len(lines) and "|" in lines[j] and lines[j].strip():
                rows.append((_cells(lines[j]) + [""] * len(head))[: len(head)])
                j += 1
            tr = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{_inline(c)}</{tag}>" for c in cells) + "</tr>"
            out.append("<table>\n<thead>\n" + tr(head, "th") + "\n</thead>\n<tbody>\n" + "".join(tr(r, "td") + "\n" for r in rows) + "</tbody>\n</table>")
            i = j
        elif m := _ITEM.match(x):
            tag, items = ("ul" if m[1] else "ol"), []
            while i < len(lines) and lines[i].strip():
                m = _ITEM.match(lines[i])
                if m:
                    items.append(m[3])
                else:
                    items[-1] += " " + lines[i].strip()
                i += 1
            out.append(f"<{tag}>\n" + "".join(f"<li>{_inline(y)}</li>\n" for y in items) + f"</{tag}>")
        elif x.lstrip().startswith(">"):
            part = []
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                part.append(re.sub(r"^\s*> ?", "", lines[i]))
                i += 1
            out.append(f"<blockquote>\n{markdown_html_of(chr(10).join(part))}\n</blockquote>")
        else:
            part = [x.strip()]
            i += 1
            while i < len(lines) and lines[i].strip() and not re.match(r"^#{1,6}\s|^\s*>", lines[i]) and not _FENCE.match(lines[i]):
                part.append(lines[i].strip())
                i += 1
            out.append(f"<p>{_inline(chr(10).join(part))}</p>")
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def markdown_html(s: pd.Series) -> pd.Series:
    """HTML of Markdown; Spark has no parser for it. Null stays null, blank text gives the empty string."""
    return s.map(markdown_html_of, na_action="ignore")
