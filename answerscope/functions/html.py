"""HTML extraction as column expressions (C1-C6, C9-C11): no parser, no UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions.core import NOT_BEFORE_WORD, WS, ColumnOrName, as_col, bind, literals, squash_ws, trim_ws
from answerscope.functions.urls import resolve_url

B = NOT_BEFORE_WORD
# fixed value: elements whose content is no text
_HIDDEN = ["script", "style", "noscript", "svg", "template"]
_ENTITY = r"(?i)&(?:#x?[0-9a-f]+|[a-z]+);"


#: stands after the bracket of a start tag that is never closed, where no pattern may begin
_FENCE = "\x01"


def _up_to(s: Column, last: str) -> Column:
    """The text up to and including the last occurrence of a pattern, '' without one."""
    return F.regexp_extract(s, rf"(?is)\A.*(?:{last})", 0)


def _replace_within(s: Column, last: str, pattern: str, by: str) -> Column:
    """``regexp_replace`` where matches can end only: behind the last ``last`` every try would scan to the end."""
    return bind(s, lambda t: bind(_up_to(t, last), lambda head: F.concat(
        F.regexp_replace(head, pattern, by), F.substr(t, F.length(head) + 1))))


def fenced(s: Column, tags: list[str]) -> Column:
    """Start tags after which no end tag of theirs follows, marked so that block patterns skip them.

    A block pattern begun at such a tag scans to the end of the page and fails; thousands of
    them made a page quadratic.  Before the last bracket ahead of a tag's last end tag every
    start tag is closed, so each scan ends at a match.  ``unfenced`` restores the text.
    """
    def fence(tag: str) -> Callable[[Column], Column]:
        def mark(t: Column) -> Column:
            closed = F.regexp_extract(t, rf"(?is)\A(.*)</{tag}>", 1)
            head = F.regexp_extract(closed, r"(?s)\A.*>", 0)
            return bind(F.length(head), lambda n: F.concat(
                F.substr(t, F.lit(1), n), F.regexp_replace(F.substr(t, n + 1), rf"(?i)<(?={tag}{B})", "<" + _FENCE)))

        return lambda t: F.when(t.rlike(rf"(?i)<{tag}{B}"), mark(t)).otherwise(t)

    for tag in tags:
        s = bind(s, fence(tag))
    return s


def unfenced(s: Column) -> Column:
    return F.replace(s, F.lit("<" + _FENCE), F.lit("<"))


def _html(c: ColumnOrName) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def _decode_one(entity: Column) -> Column:
    """Character of one entity; unknown names and impossible code points stay as written."""
    names = F.map_from_arrays(literals(list(fixed.NAMED_ENTITIES)), literals(list(fixed.NAMED_ENTITIES.values())))
    hexa = F.regexp_extract(entity, "(?i)^&#x0*([0-9a-f]{1,6});$", 1)
    deci = F.regexp_extract(entity, "^&#0*([0-9]{1,7})[0-9a-fA-F]*;$", 1)
    code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).cast("long")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    valid = (code > 0) & (code < 0x110000)
    key = F.lower(F.regexp_replace(entity, "[&;]", ""))
    return F.when(F.startswith(entity, F.lit("&#")),
                  F.when(valid, char).otherwise(entity)
                  ).otherwise(F.coalesce(F.try_element_at(names, key), entity))


def decode_entities(s: ColumnOrName) -> Column:
    """Decode numeric and the common named entities in a single pass."""
    def woven(t: Column) -> Column:
        return F.array_join(F.zip_with(
            F.split(t, _ENTITY, -1), F.regexp_extract_all(t, F.lit(_ENTITY), 0),
            lambda piece, ent: F.concat(
                piece, F.when(ent.isNull(), "").otherwise(_decode_one(ent)))), "")

    return bind(_html(s), lambda t: F.when(
        F.contains(t, F.lit("&")) & F.contains(t, F.lit(";")), woven(t)).otherwise(t))


def to_text(html: ColumnOrName) -> Column:
    """Readable text of a page."""
    s = _replace_within(_html(html), "-->", r"(?s)<!--.*?-->", " ")
    s = unfenced(F.regexp_replace(
        fenced(s, _HIDDEN), rf"(?is)<({'|'.join(_HIDDEN)}){B}[^>]*>.*?</\1>", " "))
    s = F.regexp_replace(s, rf"(?i)</(?:{fixed.BLOCK_TAGS}){WS}*>", "\n")
    s = F.regexp_replace(s, rf"(?i)<br{WS}*/?>", "\n")
    s = _replace_within(s, ">", "<[^>]+>", " ")
    s = F.regexp_replace(decode_entities(s), r"[ \t\x{a0}]{2,}|[\t\x{a0}]", " ")
    return trim_ws(F.regexp_replace(s, rf"\n{WS}*\n{WS}*\n+", "\n\n"))


def title(html: ColumnOrName) -> Column:
    """Text of the first <title>, entities decoded a second time."""
    inner = F.regexp_extract(_html(html), rf"(?is)<title{B}[^>]*>(.*?)</title>", 1)
    return trim_ws(squash_ws(decode_entities(to_text(inner))))


def meta(html: ColumnOrName, key: str) -> Column:
    """Content of the first <meta> carrying ``key`` (C4)."""
    tag = F.regexp_extract(
        _html(html),
        rf"(?i)<meta{B}[^>]*(?:name|property|http-equiv)\s*=\s*[\"']\Q{key}\E[\"'][^>]*>", 0)
    return trim_ws(decode_entities(
        F.regexp_extract(tag, r"(?is)content\s*=\s*[\"'](.*?)[\"']", 1)))


def description(html: ColumnOrName) -> Column:
    return bind(meta(html, "description"), lambda d: F.when(d != "", d).otherwise(
        meta(html, "og:description")))


def headings(html: ColumnOrName) -> Column:
    """Headings in document order as array<struct<level, text>>."""
    found = F.regexp_extract_all(fenced(_html(html), [f"h{k}" for k in range(1, 7)]), F.lit(rf"(?is)<h([1-6]){B}[^>]*>.*?</h\1>"), 0)
    return F.filter(
        F.transform(found, lambda h: F.struct(
            F.substring(h, 3, 1).cast("int").alias("level"),
            trim_ws(squash_ws(to_text(
                unfenced(F.regexp_extract(h, rf"(?is)^<h[1-6]{B}[^>]*>(.*)</h[1-6]>$", 1))))).alias("text"))),
        lambda h: h["text"] != "")


def links(html: ColumnOrName, base: ColumnOrName) -> Column:
    """Absolute link targets of a page, distinct, in order."""
    raw = F.regexp_extract_all(
        _html(html), F.lit(rf"(?i)<a{B}[^>]*href\s*=\s*[\"']([^\"'#]+)[\"']"), 1)
    hrefs = F.filter(
        F.transform(raw, lambda h: trim_ws(decode_entities(h))),
        lambda h: (h != "") & ~h.rlike("(?i)^(?:javascript|mailto|tel|data):"))
    resolved = F.transform(hrefs, lambda h: resolve_url(h, as_col(base)))
    return F.array_distinct(F.filter(resolved, lambda u: u != ""))


def count_tag(html: ColumnOrName, tag: str) -> Column:
    return F.regexp_count(_html(html), F.lit(rf"(?i)<{tag}{B}"))


def looks_client_rendered(html: ColumnOrName, text: Column) -> Column:
    """An application shell: app root, three or more scripts, little text."""
    root = _html(html).rlike(
        rf"(?i)<div{B}[^>]*id\s*=\s*[\"'](?:root|app|__next|__nuxt)[\"']")
    return root & (count_tag(html, "script") >= 3) & (F.length(text) < 800)


def lead_copy(html: ColumnOrName, words: int = 80) -> Column:
    """First ``words`` words of the main copy, without page furniture (C11)."""
    furniture = ["header", "nav", "footer", "aside"]
    body = unfenced(F.regexp_replace(
        fenced(_html(html), furniture), rf"(?is)<({'|'.join(furniture)}){B}[^>]*>.*?</\1>", " "))
    main_rx = rf"(?is)<(main|article){B}[^>]*>(.*?)</\1>"

    def from_source(src: Column) -> Column:
        paras = F.filter(
            F.transform(F.regexp_extract_all(fenced(src, ["p"]), F.lit(rf"(?is)<p{B}[^>]*>(.*?)</p>"), 1),
                        lambda p: to_text(unfenced(p))),
            lambda t: F.size(F.split(t, f"{WS}+")) >= 8)
        return bind(paras, lambda ps: F.when(
            F.size(ps) > 0, F.array_join(ps, " ")).otherwise(to_text(src)))

    def cut(t: Column) -> Column:
        return F.array_join(F.slice(F.split(t, f"{WS}+"), 1, words), " ")

    return bind(body, lambda b: bind(
        bind(fenced(b, ["main", "article"]), lambda f: F.when(f.rlike(main_rx), unfenced(F.regexp_extract(f, main_rx, 2))).otherwise(b)),
        lambda src: bind(from_source(src), cut)))

