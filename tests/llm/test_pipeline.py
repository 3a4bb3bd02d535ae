import hashlib
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from answerscope.llm import common

DIR = "/root/testdata/sf0.001"


def near_groups(texts, width):
    """Groups of ids linked over full sets, by trying all pairs."""
    sets = {i: {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} for i, t in texts.items() for w in [t.encode().lower().split()]}
    group = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return {frozenset(g) for g in group.values()}


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = common.table(spark, DIR, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], DIR), name))
    return out


def test_all_but_the_last_return_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_each_stage_on_its_own_input(spark, stages):
    rows = [{r["doc_id"]: r for r in df.collect()} for df in stages[:-1]]
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, DIR, "labels").collect()}
    for i, r in rows[1].items():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", rows[0][i]["text"])) >= 50 and r["n_chars"] == len(r["text"])
        assert set(r["text"].split("\n")) <= set(rows[0][i]["text"].split("\n"))
    clean = [i for i in rows[0] if labels.get(i) == 1 and len(rows[0][i]["text"].split()) >= 50]
    assert sum(i in rows[2] for i in clean) >= 0.97 * len(clean)
    assert all(rows[2][i] == rows[1][i] for i in rows[2])
    kept = {min(g) for g in near_groups({i: r["text"] for i, r in rows[2].items()}, 5)}
    assert set(rows[3]) == kept and all(rows[3][i] == rows[2][i] for i in rows[3])
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert not re.search(r"[0-9a-f]{32}", r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == rows[3][i]["text"] or "[SECRET]" in r["text"]


def test_packing_holds_every_id_once(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in stages[-1].collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] for r in stages[-2].collect()}
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = b"".join(x.to_bytes(4, "little") for x in ids[at:at + r["length"]])
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids) == own[0]["doc_tokens"]


def test_run_is_the_stages_in_turn(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DIR)) == key(stages[-1])


def test_awkward_rows(spark, docs, none):
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = common.written(stage(spark, df, DIR), name)
        assert df.dtypes == docs.dtypes
    left = sorted((r["doc_id"] or -1, hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect())
    assert [i for i, _ in left] == [-1, 1, 8, 16]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DIR).count() == 0


def test_repeated_ids_with_different_texts_stay(spark):
    rows = [(5, "b", 1), (5, "a", 2), (5, "a", 3), (None, "a b c d e f", 4), (None, "a b c d e f", 4), (6, "a b c d e f g", 5), (7, "a b c d e f g", 5),
            (7, "x y z u v w", 6), (8, "q r s t u v", 7), (8, "q  r s t u v", 8), (9, "", 9), (9, None, 9), (4, "x y z u v w", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df, DIR).collect()
    assert sorted((r["doc_id"] or -1, " ".join((r["text"] or "").split())) for r in got) == [
        (-1, "a b c d e f"), (-1, "a b c d e f"), (4, "x y z u v w"), (5, "a"), (5, "b"), (6, "a b c d e f g"), (8, "q r s t u v"), (9, "")]
