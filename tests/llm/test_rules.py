import random
import re
from collections import Counter

from answerscope.llm import rules

WORD, SPLIT = re.compile(r"[^\x20\x09-\x0D]+"), "\n"


def brute(text):
    w = WORD.findall(text)
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    n = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_by_brute_force(spark, docs, corpus, none):
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(corpus, "doc_id long, text string"))
    got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.verdicts(both).collect())
    want = sorted((r["doc_id"] or -1, *brute(r["text"] or "")) for r in both.collect())
    assert got == want
    assert rules.verdicts(none).count() == 0


def test_verdicts_and_cleaned_text(spark):
    rng = random.Random(2)
    good = "This line has a proper end, and so it stays.\n" + "Another sentence of ten plain words stands in this line."
    body = "\n".join(" ".join("".join(rng.choice("aeiou") + rng.choice("dnrst") for _ in range(3)) for _ in range(12)) + "." for _ in range(20))
    cases = {
        1: body, 2: body + "\nhome | about | contact | more", 3: "\n".join(f"a{k} *** b{k * k} $$$ c{k + 50} ### d{k * 3} &&&." for k in range(30)), 4: body + "\n" + body,
        5: body + "\nAll rights reserved.", 6: "\n".join(f"SHOUT{k} {'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[k]}X WORDS{k} ARE LOUD{k} HERE TODAY." for k in range(20)), 7: good, 8: body + "\n\n" + "no mark at all in this long line of words",
    }
    got = {r["doc_id"]: r for r in rules.rules(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert [k for k, r in got.items() if r["kept"]] == [1, 2, 5, 8]
    assert got[1]["cleaned"] == body and got[2]["cleaned"] == body and got[5]["cleaned"] == body and got[8]["cleaned"] == body + "\n"
    assert got[7]["base_failed"] and not got[6]["base_failed"] and got[4]["base_failed"]


def test_repeats_are_judged_line_by_line(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("aeiou") + rng.choice("dnrst") for _ in range(3)) for _ in range(n)) + "."
    long, seven, eight = line(12), line(7), line(8)
    body = [line(12) for _ in range(20)]
    cases = {
        1: [*body, "Yes.", "", long, "Yes.", "", "Yes.", long, seven, seven, "", long, eight, "Yes.", eight],  # long lines go, short and blank ones stay
        2: [x for _ in range(30) for x in (line(4), "Yes.", "", "No.")] + [body[0], body[0]],  # kept: 12 of 204 words go, with the short lines they would be 70
        3: [*body, long, "", "Yes.", "Yes.", ""],
    }
    got = {r["doc_id"]: r for r in rules.rules(spark.createDataFrame([(k, "\n".join(v)) for k, v in cases.items()], "doc_id long, text string")).collect()}
    for k, lines in cases.items():
        stays = [x for i, x in enumerate(lines) if len(x.split()) < rules.REPEAT_WORDS or x not in lines[:i]]
        assert got[k]["cleaned"] == "\n".join(stays)
        assert got[k]["lost_words"] == sum(len(x.split()) for x in lines) - sum(len(x.split()) for x in stays)
    assert got[1]["lost_words"] == 32 and got[2]["lost_words"] == 12 and got[2]["kept"]


def test_phrases_are_whole_words_and_marks_of_all_scripts(spark):
    rng = random.Random(8)
    line = lambda n, end=".": " ".join("".join(rng.choice("aeiou") + rng.choice("dnrst") for _ in range(3)) for _ in range(n)) + end
    body = [line(12) for _ in range(20)]
    stays = ["The design in question was approved.", "See the catalog in the library.", "A dialog in two parts.", "unsubscribed", line(6, "।"), line(6, "؟"), line(6, "。"), line(6, "։")]
    goes = ["Please sign in now.", "Log in", "Subscribe!", "powered by something", line(6, "")]
    cleaned = rules.rules(spark.createDataFrame([(1, "\n".join(body + stays + goes))], "doc_id long, text string")).collect()[0]["cleaned"].split("\n")
    assert cleaned == body + stays


def test_sql_follows_refrains(spark, tmp_path):
    """The SQL of the query over texts with repeated long, short and blank lines."""
    import duckdb
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choice("aeiou") + rng.choice("dnrst") for _ in range(3)) for _ in range(n)) + "."
    texts = []
    for k in range(40):
        lines = [line(rng.randint(1, 14)) for _ in range(14)]
        texts.append("\n".join(rng.choice([*lines, "", "Yes.", "home | a | b | c"]) for _ in range(60)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    cur = con.execute(rules.ORACLE)
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=lambda r: r[names.index("doc_id")])
    got = sorted(rules.verdicts(df).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r[n] for n in names) for r in got] == want and len({r["lost_words"] for r in got}) > 5
