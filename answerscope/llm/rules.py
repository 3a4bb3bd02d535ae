"""Operator 4 [native]: line-first quality rules, in built-in functions only.

Every line is judged by itself (symbols, navigation, shouting, boilerplate, punctuation), lines
that fail and long lines that repeat an earlier one are removed, and a document is rejected if
the removed lines held more than ``LOST`` of its words, or if it fails the two base rules.
All work happens inside a document's row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.llm import common

#: a document goes if more than this share of its words stood in removed lines
LOST = 0.3
#: a line that repeats an earlier one is removed if it has at least so many words
REPEAT_WORDS = 8
#: the most words of a line that a boilerplate phrase condemns
BOILERPLATE_WORDS = 15
BOILERPLATE = (r"(?i)(?<![a-z0-9_])(all rights reserved|privacy policy|cookie policy|uses cookies|terms of (use|service)|click here|"
               r"sign (up|in)|log ?in|subscribe|javascript|lorem ipsum|powered by|skip to content|share this)(?![a-z0-9_])")
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"[|>\x{2022}\x{00BB}\x{203A}]"
#: marks that end or divide sentences: ASCII, ellipsis, Armenian, Hebrew, Arabic, Devanagari, Burmese, Ethiopic, Khmer, CJK, full width
MARKS = r".!?:;,\x{2026}\x{0589}\x{05C3}\x{060C}\x{061B}\x{061F}\x{06D4}\x{0964}\x{0965}\x{104A}\x{104B}\x{1362}-\x{1368}\x{17D4}\x{17D5}\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}"
ENDING = f"[{MARKS}]"


def line_fails(line: Column, words: Column, symbols: Column, separated: Column) -> Column:
    """Whether a line of so many words (one without a word never fails) breaks a rule.

    symbols: more than one symbol for every three words; navigation: three separators or more,
    at least one for every three words; shouting: five words or more, three fifths of the
    letters capital; boilerplate: a known phrase in a line of few words; punctuation: no letter
    and no digit, or five words or more without a single mark.  ``symbols`` and ``separated``
    tell whether the whole text has any symbol or separator.
    """
    # of four letters or more, three fifths are capital only where two follow one another: counting can wait for that
    maybe_shouted = line.rlike(r"\p{Lu}\P{L}*+\p{Lu}") | ~line.rlike(r"(?:\p{L}\P{L}*+){4}")
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    return (words > 0) & (
        (symbols & (count(SYMBOL) * 3 > words))
        | (separated & (count(SEPARATOR) >= 3) & (count(SEPARATOR) * 3 >= words))
        | ((words >= 5) & maybe_shouted & (count(r"\p{Lu}") * 5 > count(r"\p{L}") * 3))
        | ((words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
        | ~line.rlike(r"[\p{L}\p{N}]")
        | ((words >= 5) & ~line.rlike(ENDING)))


def repeated_words(words: Column) -> Column:
    """How many places of the array are covered by three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash.  Sorting (hash, place) puts equal windows side by
    side, so the work grows as n log n with the length of the text.
    """
    n = F.size(words)
    window = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    hashes = F.transform(F.sequence(F.lit(0), n - 3), window)

    def covered(windows):
        twice = lambda s: F.transform(F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])), lambda x: x["p"])
        steps = lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), x - F.get(p, j - 1)), F.lit(3))), F.lit(0), lambda a, x: a + x)
        return bound(F.array_sort(windows), lambda s: bound(F.array_sort(twice(s)), steps))

    pairs = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("h"), i.alias("p")))
    some = bound(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 3, 0).when(some, covered(pairs)).otherwise(0)


def without_repeats(lines: Column) -> Column:
    """The lines in order, less those of ``REPEAT_WORDS`` words or more that equal an earlier one.

    Sorting (long line, place) puts equal long lines side by side; shorter lines have no key and stay.
    """
    keyed = F.transform(lines, lambda x, i: F.struct(F.when(x["words"] >= REPEAT_WORDS, x["line"]).alias("key"), i.alias("place"), x.alias("line")))
    firsts = lambda s: F.filter(s, lambda x, j: x["key"].isNull() | ~F.get(s, j - 1)["key"].eqNullSafe(x["key"]))
    placed = lambda s: F.array_sort(F.transform(firsts(s), lambda x: F.struct(x["place"], x["line"])))
    return F.transform(bound(F.array_sort(keyed), placed), lambda x: x["line"])


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, whatever number of times ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def rules(docs: DataFrame, row: bool = False) -> DataFrame:
    """Every document with its counts, its verdict and its text without the failed lines.

    Null and empty texts have no word: they fail the base rule.  Repeated rows are judged each;
    null ids are carried; other columns are ignored, or kept whole in ``row``.
    """
    kept = ["row"] if row else []
    step = common.texts_of(docs, row).withColumns({
        "words": F.array_remove(F.split("text", common.SPACE), ""), "n_symbols": F.regexp_count("text", F.lit(SYMBOL)).cast("long"), "separated": F.col("text").rlike(SEPARATOR),
        "lines": F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(common.WORD)).alias("words")))})
    step = step.withColumns({
        # what holds for the whole text is bound: inlined into the lambda it would be worked out for every line
        "good": bound(F.struct((F.col("n_symbols") > 0).alias("symbols"), F.col("separated").alias("separated")), lambda f: F.filter(
            "lines", lambda x: ~line_fails(x["line"], x["words"], f["symbols"], f["separated"]))),
        "wordy": F.transform(F.filter("lines", lambda x: x["words"] > 0), lambda x: x["line"])})
    long = F.transform(F.filter("good", lambda x: x["words"] >= REPEAT_WORDS), lambda x: x["line"])
    repeats = bound(long, lambda x: F.size(x) > F.size(F.array_distinct(x)))
    step = step.withColumn("clean", F.when(repeats, without_repeats(F.col("good"))).otherwise(F.col("good")))
    step = step.select(
        "doc_id", *kept, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("wordy") - F.size(F.array_distinct("wordy"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"), F.array_join(F.transform("clean", lambda x: x["line"]), "\n").alias("cleaned"),
        F.aggregate("clean", F.lit(0), lambda a, x: a + x["words"]).alias("left"))
    step = step.withColumn("lost_words", F.col("n_words") - F.col("left")).drop("left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= LOST * F.col("n_words")))


def verdicts(docs: DataFrame) -> DataFrame:
    return rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


#: the same rules over ``documents`` in DuckDB; phrases and bounds are stated anew
RULES_SQL = r"""
rule_docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
              string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
rule_lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM rule_docs),
rule_judged AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(line, '\p{L}')) AS letters FROM rule_lines),
rule_good AS (
  SELECT doc_id, line, place, words FROM rule_judged WHERE NOT (words > 0 AND (
    len(regexp_extract_all(line, '[#*$%&|<>]')) * 3 > words
    OR (len(regexp_extract_all(line, '[|•»›>]')) >= 3 AND len(regexp_extract_all(line, '[|•»›>]')) * 3 >= words)
    OR (words >= 5 AND len(regexp_extract_all(line, '\p{Lu}')) * 5 > letters * 3)
    OR (words <= 15 AND regexp_matches(line, '(?i)\b(all rights reserved|privacy policy|cookie policy|uses cookies|terms of (use|service)|click here|sign (up|in)|log ?in|subscribe|javascript|lorem ipsum|powered by|skip to content|share this)\b'))
    OR NOT regexp_matches(line, '[\p{L}\p{N}]')
    OR (words >= 5 AND NOT regexp_matches(line, '[MARKS]'))))),
rule_clean AS (
  SELECT doc_id, place, line, words FROM rule_good QUALIFY words < 8 OR row_number() OVER (PARTITION BY doc_id, line ORDER BY place) = 1),
rule_left AS (SELECT doc_id, sum(words) AS left_words, string_agg(line, chr(10) ORDER BY place) AS cleaned FROM rule_clean GROUP BY doc_id),
rule_windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM rule_docs),
rule_named AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM rule_windows),
rule_covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rule_named, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
rule_dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM rule_judged WHERE words > 0 GROUP BY doc_id),
rules AS (
  SELECT *, NOT base_failed AND lost_words <= 0.3 * n_words AS kept FROM (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - coalesce(left_words, 0)::BIGINT AS lost_words FROM (
      SELECT d.doc_id, len(d.w) AS n_words, length(array_to_string(d.w, '')) AS word_chars, len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS n_symbols,
        coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, l.left_words, coalesce(l.cleaned, '') AS cleaned
      FROM rule_docs d LEFT JOIN rule_dups u USING (doc_id) LEFT JOIN rule_covered c USING (doc_id) LEFT JOIN rule_left l USING (doc_id))))
""".replace("MARKS", MARKS)
ORACLE = f"WITH {RULES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words FROM rules"
