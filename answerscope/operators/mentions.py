"""Finding entities in answers, ranking them, scoring each answer.

Everything about one answer is decided inside its own row: the brand's entities arrive as
one array per brand (one profile each), hits, sentences, roles and ranks are array
expressions, and the only exchange is the equi join on ``brand_key``.  Text never moves
because of a group or a window, so a brand holding a third of all answers costs no more
per row than any other, and the same expression runs on a stream.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions import text as T
from answerscope.functions.core import bind, clamp, lookup, running, rx_quote, trim_ws
from answerscope.functions.urls import host_of, strip_www
from answerscope.plans.joins import join_dimension

MIN_REACH = 4  # two hits closer than max(variant length, this) are one mention
#: from so many first words on, a text's words are looked up among them instead of searching the text for each spelling
INDEXED_FROM = 24
#: so many hits find their sentence one by one; more are merged with the sentences in order
FEW_HITS = 8
_WORD = "[a-z0-9_-]+"


def fold_case(text: Column) -> Column:
    """Lowercase that keeps every offset (U+0130 alone would grow by one)."""
    return F.lower(F.translate(text, "\u0130", "\u0131"))


def spelling_pattern(low: Column) -> Column:
    """Whole-name match in case-folded text.

    The literal comes first so the regex engine can skip ahead by it; the character before
    it is checked afterwards.
    """
    name = rx_quote(low)
    return F.concat(name, F.lit("(?<![a-z0-9_.-]"), name, F.lit(")(?![a-z0-9_-])"))


def entity_variants(entities: DataFrame) -> DataFrame:
    """One row per entity spelling (B3): brand_key, entity_ord, variant_ord, variant."""
    return entities.select(
        "brand_key", "entity_ord", "name",
        F.posexplode(T.name_variants("name", "aliases", "domain")).alias("variant_ord", "variant"))


def spelled_entities(entities: DataFrame) -> DataFrame:
    """Entities with their spellings and search patterns, longest spelling first: brand_key, domain, entity.

    ``anchor`` is a spelling's first word: it can only stand where that is a whole word of the text.
    Spellings that start with another character have none.
    """
    spellings = F.transform(T.name_variants("name", "aliases", "domain"), lambda v: bind(fold_case(v), lambda low: F.struct(
        F.length(v).alias("len"), low.alias("low"), spelling_pattern(low).alias("pattern"), F.regexp_extract(low, f"^{_WORD}", 0).alias("anchor"))))
    # array_sort is stable, so equal lengths keep the order of definition
    longest_first = F.array_sort(
        F.transform(spellings, lambda v, i: F.struct(v["len"].alias("len"), i.alias("i"), v.alias("v"))),
        lambda a, b: F.when(a["len"] != b["len"], b["len"] - a["len"]).otherwise(a["i"] - b["i"]))
    return entities.select("brand_key", "domain", F.struct(
        "entity_ord", "name", "is_brand",
        F.transform(longest_first, lambda x: x["v"]).alias("variants")).alias("entity"))


def entity_index(entities: DataFrame) -> DataFrame:
    """One row per brand with its entities and the first words of all their spellings (``anchors``).

    The arrays hold one brand profile (brand plus listed competitors), never answers.
    """
    index = spelled_entities(entities).groupBy("brand_key").agg(
        F.max(F.when(F.col("entity.is_brand"), strip_www("domain"))).alias("brand_host"),
        F.array_sort(F.collect_list("entity")).alias("entities"))
    return index.withColumn("anchors", F.array_distinct(F.flatten(F.transform("entities", lambda e: F.transform(e["variants"], lambda v: v["anchor"])))))


HIT = "struct<idx:int,len:int,ord:int,old:boolean>"


def _positions(low: Column, v: Column, i: Column) -> Column:
    """Hits of one spelling, in order: running lengths of the pieces between its matches."""
    def hit(at: Column) -> Column:
        return F.struct(at.alias("idx"), v["len"].alias("len"), i.alias("ord"), F.lit(False).alias("old")).cast(HIT)

    return bind(F.split(low, v["pattern"], -1), lambda pieces: F.transform(
        running(F.slice(pieces, 1, F.size(pieces) - 1), -v["len"], lambda at, p: at + v["len"] + F.length(p), "int"), hit))


def _accept(accepted: Column, hits: Column) -> Column:
    """Add the hits of one spelling that no accepted hit is near to, both lists being in order of offset.

    Accepted hits lie ``MIN_REACH`` or more apart and hits of one spelling its length, so whatever
    is near a hit stands among its three neighbours on either side.  Only spellings shorter than
    the reach can be near themselves: those are taken one after another.
    """
    reach = lambda x: F.greatest(x["len"], F.lit(MIN_REACH))

    def free(both: Column) -> Column:
        def near(x: Column, j: Column) -> Column:
            o = F.get(both, j)
            return F.coalesce(o["old"] & (F.abs(o["idx"] - x["idx"]) < reach(x)), F.lit(False))

        return F.filter(both, lambda x, j: ~x["old"] & ~(
            (j > 0) & (near(x, j - 1) | ((x["len"] < MIN_REACH) & (j > 1) & (near(x, j - 2) | ((j > 2) & near(x, j - 3)))))
            | near(x, j + 1) | ((x["len"] < MIN_REACH) & (near(x, j + 2) | near(x, j + 3)))))

    def apart(fresh: Column) -> Column:
        lasts = running(fresh, F.lit(-MIN_REACH), lambda last, x: F.when(x["idx"] - last >= MIN_REACH, x["idx"]).otherwise(last), "int")
        return bind(lasts, lambda at: F.filter(fresh, lambda x, j: F.get(at, j) == x["idx"]))

    short = F.get(hits, F.lit(0))["len"] < MIN_REACH
    new = bind(bind(F.array_sort(F.concat(accepted, hits)), free), lambda fresh: F.when(short, apart(fresh)).otherwise(fresh))
    kept = lambda found: F.transform(found, lambda x: x.withField("old", F.lit(True)))
    return (F.when(F.size(hits) == 0, accepted)
            # the first spelling found: its hits lie its length apart
            .when((F.size(accepted) == 0) & ~short, kept(hits))
            .otherwise(F.array_sort(F.concat(accepted, kept(new)))))


def _tone(marks: Column, hits: Column, lexicon: dict) -> Column:
    """Sum of the sentiment of the sentence around each hit; a sentence is scored once.

    ``marks`` are the text's sentences with their offsets.
    """
    nth = F.transform(hits, lambda h: F.size(F.filter(marks, lambda s: s["idx"] <= h["idx"])) - 1)
    few = bind(nth, lambda ns: F.transform(F.array_distinct(ns), lambda n: F.struct(n.alias("nth"), F.size(F.filter(ns, lambda x: x == n)).alias("n"))))
    counted = F.when(F.size(hits) <= FEW_HITS, few).otherwise(_merged(marks, hits))
    return F.aggregate(counted, F.lit(0.0), lambda acc, x: acc + x["n"] * T.score_sentiment(
        trim_ws(F.get(marks, x["nth"])["part"]), lexicon.get("positive"), lexicon.get("negative")))


def _merged(marks: Column, hits: Column) -> Column:
    """How many of many hits each sentence holds: sentences and hits in one order of offset, counted in one pass."""
    ends = F.concat(F.transform(marks, lambda s: F.struct(s["idx"].alias("idx"), F.lit(0).alias("hit"))), F.transform(hits, lambda h: F.struct(h["idx"].alias("idx"), F.lit(1).alias("hit"))))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["nth"] + 1 - x["hit"]).alias("nth"), F.when(x["hit"] == 1, s["n"] + 1).otherwise(0).alias("n")).cast("struct<nth:int,n:int>")

    counts = running(F.array_sort(ends), F.struct(F.lit(-1).alias("nth"), F.lit(0).alias("n")), step, "struct<nth:int,n:int>")
    # the last state of each sentence that holds a hit
    return bind(counts, lambda c: F.filter(c, lambda x, j: (x["n"] > 0) & (F.coalesce(F.get(c, j + 1)["n"], F.lit(0)) <= x["n"])))


def _mention(text: Column, entity: Column, hits: Column, marks: Column, lexicon: dict | None) -> Column:
    """``hits`` in order of offset; the role comes from the first hit of the longest spelling found."""
    by_spelling = F.array_sort(F.transform(hits, lambda h: F.struct(h["ord"].alias("ord"), h["idx"].alias("idx"), h["len"].alias("len"))))
    mean = _tone(marks, hits, lexicon or {}) / F.size(hits)

    def mention(named: bool, first: Column, count: Column, sentiment: Column, role: Column, sentence: Column, in_list: Column, snippets: Column) -> Column:
        return F.struct(
            entity["entity_ord"].alias("entity_ord"), entity["name"].alias("name"), entity["is_brand"].alias("is_brand"), F.lit(named).alias("mentioned"),
            first.alias("first_index"), count.alias("count"), sentiment.alias("sentiment"), role.alias("role"),
            sentence.alias("role_sentence"), in_list.alias("role_in_list"), snippets.alias("snippets"))

    def with_sentence(parts: Column, sentence: Column, spots: Column) -> Column:
        line = F.concat(parts["before"], parts["after"])
        return bind(T.in_list_context(line, sentence), lambda in_list: mention(
            True, F.array_min(F.transform(hits, lambda h: h["idx"])), F.size(hits), clamp(mean, -1.0, 1.0),
            T.classify_role(sentence, entity["name"], in_list), sentence, in_list,
            F.transform(F.slice(spots, 1, fixed.SNIPPETS_KEPT), lambda h: T.snippet(text, h["idx"], h["len"]))))

    def found(spots: Column) -> Column:
        before, after = T.line_around(text, F.get(spots, F.lit(0))["idx"])
        return bind(F.struct(before.alias("before"), after.alias("after")), lambda parts: bind(
            T.sentence_from_line(parts["before"], parts["after"]), lambda sentence: with_sentence(parts, sentence, spots)))

    absent = mention(False, F.lit(-1), F.lit(0), F.lit(0.0), F.lit("referenced"), F.lit(""), F.lit(False), F.array().cast("array<string>"))
    return F.when(F.size(hits) == 0, absent).otherwise(bind(by_spelling, found))


def mention_array(text: Column, entities: Column, lexicon: dict | None = None, anchors: Column | None = None) -> Column:
    """All entities of one answer as an array of mention structs, ranked (E1 + E2).

    With ``anchors`` (of ``entity_index``) a brand of many spellings costs a text one split into words
    and one look-up of these; only spellings whose first word the text holds are searched for.
    """
    body = F.coalesce(text, F.lit(""))
    words = F.lit(None).cast("array<string>") if anchors is None else F.when(
        F.size(anchors) >= INDEXED_FROM, F.array_intersect(F.split(F.regexp_replace(fold_case(body), "[^a-z0-9_-]+", " "), " "), anchors))

    def hits_of(low: Column, met: Column, e: Column) -> Column:
        worth = lambda v: F.coalesce((v["anchor"] == "") | F.array_contains(met, v["anchor"]), F.lit(True))
        spellings = F.transform(e["variants"], lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        present = F.filter(spellings, lambda x: worth(x["v"]) & F.contains(low, x["v"]["low"]) if anchors is not None else F.contains(low, x["v"]["low"]))
        return F.aggregate(present, F.array().cast(f"array<{HIT}>"), lambda acc, x: bind(
            _positions(low, x["v"], x["i"]), lambda found: _accept(acc, found)))

    def mentions(hits: Column) -> Column:
        # the text is cut into sentences once, and only if something stands in it
        none = F.array().cast("array<struct<idx:int,part:string>>")
        marks = F.when(F.exists(hits, lambda h: F.size(h) > 0), T.sentence_starts(body)).otherwise(none)
        return bind(marks, lambda m: F.transform(entities, lambda e, i: _mention(body, e, F.get(hits, i), m, lexicon)))

    def searched(met: Column) -> Column:
        # none of many first words stands in the text, and no spelling does without one
        nothing = F.coalesce((F.size(met) == 0) & ~F.array_contains(anchors, ""), F.lit(False)) if anchors is not None else F.lit(False)
        return bind(fold_case(body), lambda low: F.transform(entities, lambda e: F.when(
            nothing, F.array().cast(f"array<{HIT}>")).otherwise(hits_of(low, met, e))))

    return bind(bind(bind(words, searched), mentions), ranked)


def ranked(mentions: Column) -> Column:
    """Add ``rank``: order of first appearance among the mentioned, 0 when absent."""
    def rank_of(m: Column) -> Column:
        ahead = F.filter(mentions, lambda o: o["mentioned"] & (
            (o["first_index"] < m["first_index"])
            | ((o["first_index"] == m["first_index"]) & (o["entity_ord"] < m["entity_ord"]))))
        return F.when(m["mentioned"], F.size(ahead) + 1).otherwise(0)

    return F.transform(mentions, lambda m: m.withField("rank", rank_of(m)))


def find_mentions(answers: DataFrame, entities: DataFrame, lexicon: dict | None = None) -> DataFrame:
    """Answers with a ``mentions`` array (E1, E2); ``explode_mentions`` gives the long form.

    Answers meet the entity index of their brand: broadcast while its measured size allows,
    else a salted join that spreads a brand with an outsized share of the answers.
    """
    return (
        join_dimension(answers, entity_index(entities), ["brand_key"], spread="ord", measure=spelled_entities(entities))
        .withColumn("mentions", _search(SparkContext._active_spark_context.applicationId, json.dumps(lexicon, sort_keys=True)))
        .drop("entities", "anchors"))


@lru_cache(maxsize=16)
def _search(application: str, lexicon: str) -> Column:
    """The search over the columns of a joined answer, built once a session: it takes longer to spell than to plan."""
    return mention_array(F.col("text"), F.col("entities"), json.loads(lexicon), F.col("anchors"))


def explode_mentions(with_mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per answer and entity."""
    # the outer form keeps Spark from adding a size filter that would evaluate the array twice
    return with_mentions.select(*keys, F.inline_outer("mentions"))


def brand_of(mentions: Column) -> Column:
    return F.filter(mentions, lambda m: m["is_brand"])[0]


def own_cited(citations: Column, brand_host: Column) -> Column:
    return F.coalesce(F.exists(citations, lambda c: host_of(c) == brand_host), F.lit(False))


def outcome_score(status: Column, brand: Column, cited: Column) -> Column:
    """Visibility value of one answer in 0..1."""
    weight = lookup(F.coalesce(brand["role"], F.lit("referenced")), fixed.ROLE_WEIGHTS, 0.45)
    place = F.when(brand["rank"] > 0, 1.0 / (1.0 + 0.35 * (brand["rank"] - 1))).otherwise(0.5)
    tone = clamp(brand["sentiment"], -0.5, 0.5) * 0.2
    total = 0.55 * weight + 0.30 * place + tone + F.when(cited, 0.15).otherwise(0.0)
    silent = (status != "answered") | ~brand["mentioned"] | (weight == 0.0)
    return F.when(silent, 0.0).otherwise(clamp(total, 0.0, 1.0))


def score_answers(
    answers: DataFrame, prompts: DataFrame, entities: DataFrame, lexicon: dict | None = None
) -> DataFrame:
    """Outcomes (E3): answers joined with their prompt, mentions, own citation and score.

    The text is reduced to mentions and an excerpt before the prompt join, so only narrow
    rows take part in it.
    """
    p = prompts.select(
        "brand_key", "prompt_id", F.col("text").alias("prompt_text"), "intent",
        F.coalesce("lang", F.lit("en")).alias("lang"), "weight")
    found = find_mentions(answers, entities, lexicon).select(
        *[c for c in answers.columns if c not in ("text", "citations")], "citations", "mentions",
        brand_of(F.col("mentions")).alias("brand"),
        own_cited(F.col("citations"), F.col("brand_host")).alias("own_cited"),
        T.excerpt("text").alias("answer_excerpt"))
    scored = found.join(p, ["brand_key", "prompt_id"])
    return scored.withColumn("score", outcome_score(F.col("status"), F.col("brand"), F.col("own_cited")))
