"""URL functions."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerscope.functions.core import NOT_AFTER_WORD, ColumnOrName, as_col, bind, char_class, trim_ws

_SCHEME = r"(?i)^(https?|ftp|wss?):[/\\]*"
_BAD_HOST = r"[\x00-\x20<>^|%\[\]]|:.*[^0-9]"


def _port_stripped(scheme: Column, host: Column) -> Column:
    """Drop the port a scheme implies, and a dangling colon."""
    return bind(host, lambda h: F.when(~F.contains(h, F.lit(":")), h)
                .when(F.endswith(h, F.lit(":")), F.regexp_replace(h, ":$", ""))
                .when(F.endswith(h, F.when(scheme.isin("http", "ws"), ":80")
                                 .when(scheme.isin("https", "wss"), ":443").otherwise(":21")),
                      F.substring_index(h, ":", 1)).otherwise(h))


@lru_cache(maxsize=1)
def _host_tables() -> tuple[str, str, dict[str, str], dict[str, str]]:
    """How host names are spelled before they are encoded, by rule from the Unicode database.

    One-to-one and dropped characters for ``translate``, one-to-many ones, and letter and mark to composite.
    """
    src, dst, dropped, many, pairs = [], [], [], {}, {}
    ignored = {0xAD, 0x34F, 0x200B, 0x2060, 0x2064, 0xFEFF, *range(0xFE00, 0xFE10)}
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pairs[chr(int(parts[0], 16)) + chr(int(parts[1], 16))] = ch
        # sharp s and final sigma are letters of their own in host names
        out = "" if cp in ignored else ch if ch in "\u00df\u03c2" else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", ch).lower())
        out = out.replace("\u3002", ".")
        if out == ch or 0xD800 <= cp <= 0xF8FF:
            continue
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        elif out:
            many[ch] = out
        else:
            dropped.append(ch)
    return "".join(src + dropped), "".join(dst), many, pairs


_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a code point (RFC 3492, 6.1)."""
    start = bind(F.when(first, F.floor(delta / 700)).otherwise(F.floor(delta / 2)), lambda d: d + F.floor(d / points))
    zero = F.struct(start.cast("long").alias("d"), F.lit(0).cast("long").alias("k"))
    shrunk = F.aggregate(F.sequence(F.lit(1), F.lit(12)), zero, lambda s, _: F.when(s["d"] > 455, F.struct(
        F.floor(s["d"] / 35).cast("long").alias("d"), (s["k"] + 36).alias("k"))).otherwise(s))
    return bind(shrunk, lambda s: (s["k"] + F.floor(36 * s["d"] / (s["d"] + 38))).cast("long"))


def _number(delta: Column, bias: Column) -> Column:
    """A number in digits whose weights follow the bias (RFC 3492, 3.3)."""
    nth = lambda d: F.substr(F.lit(_DIGITS), (d + 1).cast("int"), F.lit(1))
    zero = F.struct(delta.cast("long").alias("q"), F.lit("").alias("out"), F.lit(True).alias("more"))

    def step(s: Column, k: Column) -> Column:
        t = F.greatest(F.lit(1), F.least(F.lit(26), k * 36 - bias))
        return bind(t, lambda t: F.when(~s["more"], s).when(s["q"] < t, F.struct(
            s["q"].alias("q"), F.concat(s["out"], nth(s["q"])).alias("out"), F.lit(False).alias("more"))).otherwise(F.struct(
                F.floor((s["q"] - t) / (36 - t)).cast("long").alias("q"), F.concat(s["out"], nth(t + (s["q"] - t) % (36 - t))).alias("out"), F.lit(True).alias("more"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), zero, step)["out"]


def _puny(label: Column) -> Column:
    """A label's characters as letters and digits (RFC 3492): a fold over its code points beyond ASCII, in order, each over all characters."""
    kind = "struct<n:bigint,delta:bigint,bias:bigint,h:bigint,out:string>"
    chars = F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("long"))

    def of(cps: Column) -> Column:
        wide = F.array_sort(F.array_distinct(F.filter(cps, lambda c: c >= 128)))
        plain = F.regexp_replace(label, r"[^\x00-\x7f]", "")
        basic = F.length(plain).cast("long")

        def pass_over(s: Column, m: Column) -> Column:
            moved = s.withField("delta", s["delta"] + (m - s["n"]) * (s["h"] + 1)).withField("n", m)

            def meet(z: Column, c: Column) -> Column:
                written = F.struct(z["n"].alias("n"), F.lit(0).cast("long").alias("delta"), _adapted(z["delta"], z["h"] + 1, z["h"] == basic).alias("bias"),
                                   (z["h"] + 1).alias("h"), F.concat(z["out"], _number(z["delta"], z["bias"])).alias("out"))
                return F.when(c == z["n"], written).when(c < z["n"], z.withField("delta", z["delta"] + 1)).otherwise(z).cast(kind)

            return bind(F.aggregate(cps, moved.cast(kind), meet), lambda z: z.withField("delta", z["delta"] + 1).withField("n", z["n"] + 1).cast(kind))

        zero = F.struct(F.lit(128).alias("n"), F.lit(0).alias("delta"), F.lit(72).alias("bias"), basic.alias("h"),
                        F.when(basic > 0, F.concat(plain, F.lit("-"))).otherwise("").alias("out")).cast(kind)
        return F.concat(F.lit("xn--"), F.aggregate(wide, zero, pass_over)["out"])

    return bind(chars, of)


def ascii_host(host: ColumnOrName) -> Column:
    """A host name in the letters of the wire: compatibility-composed, lowercased, labels beyond ASCII in Punycode.

    ASCII hosts stay as they are.  Letters joined by several marks are composed one mark after another.
    """
    src, dst, many, pairs = _host_tables()
    from_literal = lambda table: F.from_json(F.lit(json.dumps(table)), "map<string,string>")

    def composed(text: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            last = F.element_at(acc, -1)
            joined = F.when(F.size(acc) > 0, F.try_element_at(from_literal(pairs), F.concat(last, c)))
            return bind(joined, lambda j: F.when(j.isNull(), F.concat(acc, F.array(c))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(j))))

        return F.array_join(F.aggregate(F.split(text, ""), F.array().cast("array<string>"), step), "")

    def spelled(h: Column) -> Column:
        unpacked = F.array_join(F.transform(F.split(F.translate(h, src, dst), ""), lambda c: F.when(
            c.rlike(char_class([ord(m) for m in many])), F.try_element_at(from_literal(many), c)).otherwise(c)), "")
        marked = bind(unpacked, lambda u: F.when(u.rlike(r"\p{M}"), composed(u)).otherwise(u))
        return bind(marked, lambda t: F.array_join(F.transform(F.split(t, r"\."), lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), _puny(x)).otherwise(x)), "."))

    return bind(as_col(host), lambda h: F.when(h.rlike(r"[^\x00-\x7f]"), spelled(F.lower(h))).otherwise(h))


def ascii_url(url: ColumnOrName) -> Column:
    """A URL whose host is in ASCII; the rest, and text that is no URL, stays as it is.

    Readers call it once for every URL they take in: hosts are compared all over the library, and
    after it both spellings of a host are one.
    """
    user = _SCHEME + r"(?:[^/\\?#]*@)?"

    def spelled(u: Column) -> Column:
        before, host = F.regexp_extract(u, user, 0), F.regexp_extract(u, user + r"([^/\\?#]*)", 2)
        return F.when(host.rlike(r"[^\x00-\x7f]"), F.concat(before, ascii_host(host), F.substr(u, F.length(before) + F.length(host) + 1))).otherwise(u)

    return bind(as_col(url), spelled)


def scheme_of(url: ColumnOrName) -> Column:
    return F.lower(F.regexp_extract(as_col(url), _SCHEME, 1))


def full_host(url: ColumnOrName) -> Column:
    """Host with explicit port, lowercased, '' when the URL does not parse."""
    def host(u: Column) -> Column:
        authority = F.regexp_extract(u, _SCHEME + r"([^/\\?#]*)", 2)
        bare = F.lower(F.element_at(F.split(authority, "@"), -1))
        return bind(_port_stripped(scheme_of(u), bare),
                    lambda h: F.when(h.rlike(_BAD_HOST), "").otherwise(h))

    return bind(trim_ws(F.coalesce(as_col(url), F.lit(""))), host)


def strip_www(host: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(as_col(host), F.lit(""))), r"^www\.", "")


def host_of(url: ColumnOrName) -> Column:
    """Host of a URL without ``www.``."""
    return strip_www(full_host(url))


def same_host(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Equal hosts, ignoring case and ``www.``; subdomains differ."""
    return strip_www(a) == strip_www(b)


def path_of(url: ColumnOrName) -> Column:
    """Path of an absolute URL, '/' when empty."""
    raw = F.regexp_extract(as_col(url), _SCHEME + r"[^/\\?#]*([^?#]*)", 2)
    return F.concat(F.when(F.startswith(raw, F.lit("/")), "").otherwise("/"), raw)


def path_or_self(url: ColumnOrName) -> Column:
    """Path of an absolute URL; text that is no URL stands for itself."""
    return F.when(as_col(url).rlike(_SCHEME), path_of(url)).otherwise(as_col(url))


def site_origin(site: ColumnOrName) -> Column:
    """Origin of a site given as domain or URL (B13), its host in ASCII; ``host_of`` of it is the host."""
    raw = trim_ws(as_col(site))
    url = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    return F.concat(scheme_of(url), F.lit("://"), ascii_host(full_host(url)))


def _percent_encode(s: Column, unsafe: str) -> Column:
    encoded = F.array_join(F.transform(F.split(s, ""), lambda c: F.when(
        c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    return F.when(s.rlike(unsafe), encoded).otherwise(s)


def fold_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == ".", acc)
            .when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(seg))))

    segments = F.split(F.substr(path, F.lit(2)), "/")
    folded = F.concat(F.lit("/"), F.array_join(
        F.aggregate(segments, F.array().cast("array<string>"), step), "/"))
    trailing = path.rlike(r"/\.{1,2}$") & (folded != "/")
    folded = F.when(trailing, F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), folded).otherwise(path)


def normalise_url(url: ColumnOrName) -> Column:
    """Canonical spelling of an absolute URL, '' when it does not parse."""
    def spelled(u: Column) -> Column:
        user = F.regexp_extract(u, _SCHEME + r"([^/\\?#]*@)", 2)
        return bind(full_host(u), lambda host: F.when(host == "", "").otherwise(F.concat(
            scheme_of(u), F.lit("://"), user, host,
            bind(path_of(u), lambda p: bind(fold_dots(p), lambda q: _percent_encode(
                q, r"[^\x21-\x7e]|[\"<>`{}]"))),
            bind(F.regexp_extract(u, r"[?#].*", 0), lambda t: _percent_encode(
                t, r"[^\x21-\x7e]|[\"<>]")))))

    return bind(trim_ws(F.coalesce(as_col(url), F.lit(""))), spelled)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` as found on page ``base``."""
    origin = F.regexp_extract(base, _SCHEME + r"[^/\\?#]*", 0)
    absolute = (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme_of(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path_of(base), href))
        .otherwise(F.concat(origin, F.regexp_extract(path_of(base), "^.*/", 0), href)))
    return bind(absolute, lambda a: F.when(a.rlike(_SCHEME), normalise_url(a)).otherwise(a))


def extract_urls(text: ColumnOrName) -> Column:
    """Links in prose (B8): markdown targets first, then bare URLs; normalised, distinct."""
    t = F.coalesce(as_col(text), F.lit(""))
    markdown = F.regexp_extract_all(t, F.lit(r"(?i)\]\((https?://[^\s)]+)\)"), 1)
    bare = F.regexp_extract_all(
        t, F.lit("(?i)(?<![(\"])" + NOT_AFTER_WORD + r"https?://[^\s<>\"')\]]+"), 0)
    cleaned = F.transform(
        F.concat(markdown, bare),
        lambda u: normalise_url(F.regexp_replace(u, r"[.,;:!?]+$", "")))
    found = F.array_distinct(F.filter(cleaned, lambda u: u != ""))
    return F.when(F.contains(F.lower(t), F.lit("http")), found).otherwise(
        F.array().cast("array<string>"))
