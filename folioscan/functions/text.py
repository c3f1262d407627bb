"""Text as columns: HTML, entities, white space, titles, hashes, citations, fault logs.

All functions take and return Columns that Spark evaluates itself, except the
ones that need a callback or a match's place (numeric entities, image
references), which are Arrow-batched.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import ENTITIES, SECTION_WORDS
from ..regex import B1, WORD
from .binding import batched, words_array

#: The block-like tags that tell HTML.
TAGS = "p|div|br|h[1-6]|li|ul|ol|table|tr|td|span|img|a|section|article"
VERSION = 9


def replace_all(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def looks_like_html(text: Column) -> Column:
    """Three or more block-like tags in the first 4,000 characters."""
    return F.regexp_count(F.substring(text, 1, 4000), F.lit(rf"(?i)</?(?:{TAGS}){B1}")) >= 3


def decode_named(text: Column) -> Column:
    """Named character entities, in any case; &amp; last, so that nothing is decoded twice."""
    for name in [*(n for n in ENTITIES if n != "amp"), "amp"]:
        text = F.regexp_replace(text, f"(?i)&{name};", ENTITIES[name].replace("\\", "\\\\").replace("$", "\\$"))
    return text


_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);")


def decode_text(text: str) -> str:
    """One pass over named and numeric entities; unknown ones stay as they are."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return ENTITIES.get(body.lower(), m[0])
        try:
            code = int(body[2:], 16) if body[1] in "xX" else int(re.match(r"[0-9]+", body[1:])[0])
        except (ValueError, TypeError):
            return m[0]
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


@batched("string")
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(decode_text, na_action="ignore")


def mark_images(text: Column) -> Column:
    return replace_all(text, (rf"(?i)<img{B1}[^>]*>", " [image] "), (r"!\[\]\(\s*[^)\s]+(?:\s+\"[^\"]*\")?\s*\)", " [image] "), (r"!\[([^\]]+)\]\(\s*[^)\s]+(?:\s+\"[^\"]*\")?\s*\)", " [image: $1] "))


def strip_html(html: Column) -> Column:
    """Comments, scripts and tags go; block ends become line breaks. Entities stay."""
    text = replace_all(html, (r"(?s)<!--.*?-->", " "), (rf"(?is)<(script|style|noscript|svg|iframe|template){B1}[^>]*>.*?</\1>", " "))
    return replace_all(
        mark_images(text), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|section|article|header|footer|li|tr|h[1-6]|blockquote|pre|figure)>", "\n\n"),
        (rf"(?i)<(?:li|tr){B1}[^>]*>", "\n"), (rf"(?i)<h[1-6]{B1}[^>]*>", "\n\n"), (rf"(?i)<td{B1}[^>]*>", " · "), (r"<[^>]+>", " "),
    )


def normalise_space(text: Column) -> Column:
    text = replace_all(text, (r"\r\n?", "\n"), (" ", " "), (r"[ \t]+\n", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"[ \t\f\x0b]+(?=\n|$)", ""))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def prepare(raw: Column, decode=decode_entities) -> Column:
    """Any paste as one plain text; decode: how entities are decoded in pages."""
    raw = F.coalesce(raw, F.lit(""))
    return normalise_space(F.when(looks_like_html(raw), decode(strip_html(raw))).otherwise(mark_images(raw)))


def guess_title(text: Column) -> Column:
    """The first line of three characters or more, without heading and bold marks; 90 characters at most."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(replace_all(F.regexp_replace(x, r"^\s+|\s+$", ""), (r"^#{1,6}\s+", ""), (r"^\*{1,2}|\*{1,2}$", ""))))
    first = F.get(F.filter(lines, lambda x: F.length(x) >= 3), F.lit(0))
    cut = F.when(F.length(first) > 90, F.concat(F.substring(first, 1, 87), F.lit("…"))).otherwise(first)
    return F.coalesce(cut, F.lit("Untitled document"))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def searchable(heading: Column, text: Column) -> Column:
    """What is embedded: the heading comes first unless the text begins with it."""
    return F.when(heading.isNull() | F.startswith(text, heading), text).otherwise(F.concat(heading, F.lit("\n"), text))


def fingerprint(text: Column, model: str, version: int = VERSION) -> Column:
    return F.sha2(F.concat(F.lit(str(version)), F.char(F.lit(0)), F.lit(model), F.char(F.lit(0)), text), 256)


def citations(text: Column) -> Column:
    """Labels of up to 60 characters in square brackets."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\[\]\n]{1,60})\]"), F.lit(1))


# ---- headings ---------------------------------------------------------------


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def is_heading_candidate(line: Column) -> Column:
    v = trimmed(line)
    shape = v.rlike(r"^#{1,6}\s+") | (v.rlike(r"^[A-Z0-9][^.!?]*:?$") & (F.size(F.split(v, r"\s+")) <= 10))
    return (v != "") & (F.length(v) <= 80) & ~v.rlike(r"[.!?]$") & shape


def ends_sentence(line: Column) -> Column:
    return F.coalesce(trimmed(line).rlike(r"[.!?]$"), F.lit(False))


def contains_prose(text: Column) -> Column:
    return text.rlike(r"[.!?](?:\s|$)")


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: trimmed(x) != ""))


def is_section_name(line: Column, section_words=tuple(SECTION_WORDS)) -> Column:
    w = F.filter(F.split(F.regexp_replace(F.lower(trimmed(line)), r"[^a-z\s]", " "), r"\s+"), lambda x: x != "")
    known = words_array(section_words)
    by_first = F.array_contains(known, F.get(w, F.lit(0)))
    return ~F.contains(line, F.lit(":")) & F.size(w).between(1, 4) & F.coalesce(by_first | ((F.size(w) <= 2) & F.arrays_overlap(known, w)), F.lit(False))


def is_body(text: Column, heading: Column) -> Column:
    return contains_prose(text) | (nonblank_lines(text) >= 2) | is_section_name(heading)


def is_heading(line: Column, following: Column) -> Column:
    return is_heading_candidate(line) & ends_sentence(following)


def clean_heading(line: Column) -> Column:
    return trimmed(replace_all(line, (r"^#{1,6}\s+", ""), (r"^\*\*|\*\*$", ""), (r":$", "")))


# ---- images -----------------------------------------------------------------

_IMG, _MD, _URL = re.compile(r"<img\b[^>]*>", re.I | re.A), re.compile(r'!\[([^\]]*)\]\(\s*([^)\s]+)(?:\s+"([^"]*)")?\s*\)'), re.compile(r"https?://[^\s<>()\"']+", re.I)
_EXT = re.compile(r"\.(?:png|jpe?g|gif|webp|avif|svg|bmp)(?:\?[^\s)]*)?$", re.I)


def _attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", tag, re.I | re.A)
    return next((g for g in m.groups() if g is not None), None) if m else None


def absolute_url(url: str, base: str | None) -> str:
    url = re.sub(r"^['\"]|['\"]$", "", url.strip())
    if re.match(r"https?:|data:image/", url, re.I):
        return url
    return f"https:{url}" if url.startswith("//") else urljoin(base, url) if base else url


def find_images(text: str, base: str | None = None) -> list[tuple[str, str | None]]:
    """(url, caption) of pictures in document order, one for each URL; a caption wins over none."""
    found = []
    for m in _IMG.finditer(text):
        if src := _attribute(m[0], "src"):
            alt = _attribute(m[0], "alt")
            found.append((m.start(), absolute_url(src, base), alt if alt is not None else _attribute(m[0], "title")))
    found += [(m.start(), absolute_url(m[2], base), m[1] or m[3]) for m in _MD.finditer(text)]
    found += [(m.start(), url, None) for m in _URL.finditer(text) if _EXT.search(url := re.sub(r"[.,;:]+$", "", m[0]))]
    by_url: dict[str, str | None] = {}
    for _, url, caption in sorted(found, key=lambda x: x[0]):
        caption = decode_text(caption).strip() or None if caption else None
        by_url[url] = by_url.get(url) or caption
    return list(by_url.items())


@batched("array<struct<url:string,caption:string>>")
def images(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"url": u, "caption": c} for u, c in find_images(t or "")])


# ---- fault logs ---------------------------------------------------------------


def without_query(url: Column) -> Column:
    """A URL without query and fragment; a closing :line:column stays."""
    return F.regexp_replace(url, r"^([^?#]*)[?#](?:.*?)((?::[0-9]+:[0-9]+)?)$", "$1$2")


def redact_urls(text: Column, limit: int) -> Column:
    """Queries of URLs and paths go, white space is folded, and the text is cut at the limit."""
    keep_place = r"[?#][^\s)\"']*?((?::[0-9]+:[0-9]+)?)(?=[\s)\"']|$)"
    text = replace_all(F.coalesce(text, F.lit("")), (r"(?i)([a-z][a-z0-9+.-]*://[^\s)\"'?#]+)" + keep_place, "$1$2"), (r"((?:^|[\s(\"'=])/[^\s)\"'?#]*)" + keep_place, "$1$2"))
    text = replace_all(text, (r"[^\S\n]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))
    return F.substring(text, 1, limit)


#: Characters that each field of a fault may keep.
FAULT_LIMITS = {"route": 200, "message": 300, "stack": 4000, "source": 300}


def clean_fault(fault: Column) -> Column:
    """struct(route, message, stack, source, line, column) of a fault of strings, queries cut and lengths capped; null without a message.

    A route that is no path becomes `/`, a place that is no positive number 0.
    """
    field = {name: redact_urls(fault[name], limit) for name, limit in FAULT_LIMITS.items()}

    def whole(name: str) -> Column:
        n = F.coalesce(fault[name].try_cast("double"), F.lit(0.0))
        return F.when((n > 0) & (n < 2.0**53), F.floor(n + 0.5)).otherwise(F.lit(0)).cast("long")

    route = F.when(F.startswith(field["route"], F.lit("/")), field["route"]).otherwise(F.lit("/"))
    kept = F.struct(route.alias("route"), field["message"].alias("message"), field["stack"].alias("stack"), field["source"].alias("source"), whole("line").alias("line"), whole("column").alias("column"))
    return F.when(field["message"] != "", kept)


def stack_frames(stack: Column) -> Column:
    """array of (filename, lineno, colno, method), the most recent call last."""
    calls = F.filter(F.transform(F.split(stack, "\n"), trimmed), lambda x: x.startswith("at "))
    bare = F.transform(calls, lambda x: F.regexp_replace(F.regexp_replace(x, r"^at\s+", ""), r"^async\s+", ""))

    def frame(x: Column) -> Column:
        named = x.rlike(r"^.* \(.*\)$")
        method = F.when(named, trimmed(F.regexp_extract(x, r"^(.*) \((.*)\)$", 1))).otherwise(F.lit(""))
        place = F.when(named, F.regexp_extract(x, r"^(.*) \((.*)\)$", 2)).otherwise(x)
        part = lambda k: F.regexp_extract(place, r"^(.*):([0-9]+):([0-9]+)$", k)
        return F.struct(part(1).alias("filename"), part(2).try_cast("int").alias("lineno"), part(3).try_cast("int").alias("colno"), method.alias("method"))

    return F.reverse(F.filter(F.transform(bare, frame), lambda f: f["lineno"].isNotNull()))
