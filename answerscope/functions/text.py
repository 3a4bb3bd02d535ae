"""Text functions: normalisation, sentences, roles, sentiment, word counts."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions.core import (
    NON_WS, NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, ColumnOrName, any_contains, as_col, bind, char_class, clamp,
    count_contains, running, squash_ws, trim_ws,
)

SENTENCE_END = "[.!?]"
_CONNECTIVE = f"(?i){NOT_AFTER_WORD}(?:{'|'.join(fixed.CONNECTIVES)}){NOT_BEFORE_WORD}"
_LIST_MARKER = rf"^{WS}*(?:\d{{1,2}}{WS}*[.)]|[-*•]){WS}+"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Accent-folding tables derived from the Unicode database by rule.

    One-to-one folds and deletions feed ``translate``; the few one-to-many folds
    (ligatures, fractions ...) feed a map that is consulted only when one occurs.
    Hangul syllables are left to ``_jamo``; surrogates and private planes fold to themselves.
    """
    src, dst, dropped, many = [], [], [], {}
    for cp in range(0x80, 0xF0000):
        if 0xD800 <= cp <= 0xF8FF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        out = "".join(
            c for c in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if out == ch:
            continue
        if not out:
            dropped.append(ch)
        elif len(out) == 1:
            src.append(ch)
            dst.append(out)
        else:
            many[ch] = out
    members = char_class([ord(c) for c in many])
    return "".join(src + dropped), "".join(dst), many, members


_SYLLABLES = "[\uac00-\ud7a3]"


def _jamo(text: Column) -> Column:
    """Hangul syllables as their two or three letters, by the arithmetic of their block: 19 x 21 x 28 syllables."""
    lead, vowel, tail = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28)))

    def letters(c: Column) -> Column:
        nth = lambda table, k: F.substr(F.lit(table), (k + 1).cast("int"), F.lit(1))
        # without a third letter the remainder is 0
        return bind(F.ascii(c) - 0xAC00, lambda k: F.concat(nth(lead, F.floor(k / 588)), nth(vowel, F.floor(k % 588 / 28)), F.when(k % 28 == 0, "").otherwise(nth(tail, k % 28))))

    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(_SYLLABLES), letters(c)).otherwise(c)), "")


def normalise(s: ColumnOrName) -> Column:
    """Compatibility-decompose, drop combining accents, lowercase (B1).

    Every character folds as in NFKD; marks that stay keep the order they have in the text.
    """
    src, dst, many, members = _fold_tables()
    # one literal that the optimizer folds to a map, instead of thousands of literals
    pairs = F.from_json(F.lit(json.dumps(many)), "map<string,string>")

    def folded(text: Column) -> Column:
        unpacked = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(
            c.rlike(members), F.try_element_at(pairs, c)).otherwise(c)), "")
        rare = text.rlike(r"[^\x00-\x{17f}]|[\x{bc}-\x{be}\x{132}\x{133}\x{13f}\x{140}\x{149}]")
        expanded = F.when(rare & text.rlike(members), unpacked).otherwise(text)
        # the translation never makes a syllable, so the two can follow one another
        plain = bind(F.translate(expanded, src, dst), lambda t: F.when(t.rlike(_SYLLABLES), _jamo(t)).otherwise(t))
        return F.lower(F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text))

    return bind(F.coalesce(as_col(s), F.lit("")), folded)


def word_count(s: ColumnOrName) -> Column:
    """Whitespace-separated words."""
    return F.regexp_count(F.coalesce(as_col(s), F.lit("")), F.lit(f"{NON_WS}+"))


def is_answer_capsule(s: ColumnOrName) -> Column:
    """Opens with a direct statement of 6..45 words in a text of 15 words or more."""
    return bind(trim_ws(F.coalesce(as_col(s), F.lit(""))), lambda t: (
        (word_count(t) >= 15)
        & ~t.rlike(f"(?i)^(?:{fixed.CAPSULE_HEDGES})")
        & word_count(F.split(t, SENTENCE_END)[0]).between(6, 45)))


def sentences(text: ColumnOrName) -> Column:
    """All sentences of a text, in order (B4): split at newlines, then after . ! ? + space."""
    lines = F.split(F.coalesce(as_col(text), F.lit("")), "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, f"(?<={SENTENCE_END})(?={WS})")))
    return F.filter(F.transform(parts, lambda p: trim_ws(p)), lambda p: p != "")


def line_around(text: Column, idx: Column) -> tuple[Column, Column]:
    """The part of the line before offset ``idx`` (0-based) and the part from it on."""
    before = F.substring_index(text.substr(F.lit(1), idx), "\n", -1)
    after = F.substring_index(text.substr(idx + 1, F.length(text)), "\n", 1)
    return before, after


def sentence_from_line(before: Column, after: Column) -> Column:
    """The sentence holding the point between the two halves of a line."""
    head = F.regexp_replace(before, rf"(?s)^.*{SENTENCE_END}(?={WS})", "")
    tail = F.regexp_extract(after, rf"(?s)^.*?(?:{SENTENCE_END}(?={WS}|\z)|\z)", 0)
    return trim_ws(F.concat(head, tail))


def sentence_at(text: ColumnOrName, idx: ColumnOrName) -> Column:
    before, after = line_around(as_col(text), as_col(idx))
    return sentence_from_line(before, after)


def sentence_starts(text: Column) -> Column:
    """All sentences of a text, untrimmed, with their offsets: array<struct<idx, part>>."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.transform(
        F.split(x, f"(?<={SENTENCE_END})(?={WS})"), lambda p, j: F.struct(p.alias("part"), (j == 0).cast("int").alias("gap"))))

    def step(s: Column, x: Column) -> Column:
        at = s["next"] + x["gap"]
        return F.struct(at.alias("idx"), x["part"].alias("part"), (at + F.length(x["part"])).alias("next"))

    start = F.struct(F.lit(0).alias("idx"), F.lit("").alias("part"), F.lit(-1).alias("next"))
    return F.transform(running(F.flatten(lines), start, step, "struct<idx:int,part:string,next:int>"),
                       lambda s: F.struct(s["idx"].alias("idx"), s["part"].alias("part")))


def in_list_context(line: Column, sentence: Column) -> Column:
    """Whether a mention sits inside an enumeration."""
    def inside(s: Column) -> Column:
        commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
        return (
            line.rlike(_LIST_MARKER) | (commas >= 2) | ((commas >= 1) & s.rlike(_CONNECTIVE))
            | bind(F.lower(s), lambda low: any_contains(low, fixed.LEAD_IN)))

    return bind(sentence, inside)


def score_sentiment(
    sentence: ColumnOrName, positive: list[str] | None = None, negative: list[str] | None = None
) -> Column:
    """Lexicon sentiment of one sentence in -1..1."""
    pos = fixed.POSITIVE if positive is None else positive
    neg = fixed.NEGATIVE if negative is None else negative

    def score(t: Column) -> Column:
        net = count_contains(t, pos) - count_contains(t, neg)
        return clamp(net.cast("double") / 3.0, -1.0, 1.0)

    return bind(normalise(sentence), score)


def _is_foil(t: Column, name: Column) -> Column:
    """A 'move on from' phrase whose first occurrence is followed closely by the name."""
    out = F.lit(False)
    for term in fixed.FOIL:
        at = F.instr(t, term)
        window = t.substr(at, F.length(name) + len(term) + fixed.FOIL_REACH)
        out = out | ((at > 0) & F.contains(window, name))
    return (name != "") & out


def classify_role(sentence: ColumnOrName, name: Column, in_list: Column) -> Column:
    """recommended / listed / referenced / dismissed."""
    return bind(normalise(sentence), lambda t: bind(
        normalise(name), lambda n: (
            F.when(t == "", "referenced")
            .when(any_contains(t, fixed.DISMISS), "dismissed")
            .when(_is_foil(t, n), "dismissed")
            .when(any_contains(t, fixed.ENDORSE), "recommended")
            .when(in_list, "listed")
            .otherwise("referenced"))))


def snippet(text: Column, idx: Column, length: Column) -> Column:
    """Context around a mention."""
    start = F.greatest(F.lit(0), idx - fixed.SNIPPET_BEFORE)
    raw = text.substr(start + 1, idx + length + fixed.SNIPPET_AFTER - start)
    return trim_ws(squash_ws(raw))


def excerpt(text: ColumnOrName) -> Column:
    return F.substring(F.coalesce(as_col(text), F.lit("")), 1, fixed.EXCERPT_CHARS)


def name_variants(
    name: ColumnOrName, aliases: ColumnOrName, domain: ColumnOrName
) -> Column:
    """Spellings an entity is looked up by, distinct, in order of definition."""
    n = F.coalesce(as_col(name), F.lit(""))
    d = as_col(domain)
    none = F.array().cast("array<string>")
    label = F.split(F.regexp_replace(F.coalesce(d, F.lit("")), r"^www\.", ""), r"\.")[0]
    words = F.split(trim_ws(n), f"{WS}+")
    lead = F.when(
        (F.size(words) > 1) & (F.length(words[0]) >= 4)
        & ~normalise(words[0]).isin(fixed.GENERIC_LEADS), F.array(words[0])).otherwise(none)
    every = F.concat(
        F.array(n), F.coalesce(as_col(aliases), none),
        F.when(F.coalesce(d, F.lit("")) != "", F.array(d)).otherwise(none),
        F.when(F.length(label) >= 3, F.array(label)).otherwise(none), lead)
    trimmed = F.transform(F.filter(every, lambda v: v.isNotNull()), lambda v: trim_ws(v))
    return F.array_distinct(F.filter(trimmed, lambda v: F.length(v) >= 2))
