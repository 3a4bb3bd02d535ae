import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from answerscope.llm import pieces
from answerscope.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "  a  b ", "a▁b", "日本\U0001F600x €", " \n\t", " ", "▁", "▁▁ a ", "x  ", "<s>hi</s>", "\x00", "don't  stop", "ｱﾞ x  ＡＢＣ½ﬁ", "  ¨ a ̈ é é ", "　　x y  ", "㍿ ​ z"]


def model_with(rule, squeeze, dummy):
    """The model's vocabulary under another normaliser."""
    def size(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    made = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = next(v for k, _, v, _ in pieces._fields(made) if k == 3)
    spec = b"".join(r for k, _, _, r in pieces._fields(spec) if k not in (3, 4, 5)) + bytes([0x18, dummy, 0x20, squeeze, 0x28, 1])
    with open(PATH, "rb") as f:
        model = f.read()
    return b"".join(r for k, _, _, r in pieces._fields(model) if k != 3) + b"\x1a" + size(len(spec)) + spec


@pytest.mark.parametrize("rule,squeeze,dummy", [("identity", 0, 1), ("nmt_nfkc", 1, 1), ("nmt_nfkc", 0, 0), ("nfkc", 1, 0), ("nmt_nfkc_cf", 0, 1)])
def test_ids_spans_and_decoding_are_the_librarys(rule, squeeze, dummy, corpus):
    model = model_with(rule, squeeze, dummy)
    codec, library = pieces.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = TEXTS + [t for _, t in corpus[:20]]
    for text, (ids, begins, ends) in zip(texts, codec.encode(texts)):
        want = library.encode(text, return_type="proto").pieces
        assert [p.id for p in want] == ids.tolist()
        assert [(p.begin, p.end) for p in want] == list(zip(begins, ends))
        assert codec.decode(ids) == library.decode(ids.tolist())


def test_decoding_any_ids():
    with open(PATH, "rb") as f:
        model = f.read()
    codec, library, rng = pieces.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(1)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_awkward_rows(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(docs, PATH).collect())
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((r["doc_id"] or -1, len(ids), *sha))
    assert got == sorted(want)
    assert pieces.digests(none, PATH).count() == 0
    back = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert back.count() == docs.count()


def test_query(spark):
    assert QUERIES["op1_pieces"](spark, "/root/testdata/sf0.001").count() == 200
