import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from answerscope.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_librarys(corpus):
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    library, own = Tokenizer.from_str(spec), packing.Tokens(spec)
    texts = ["", " ", "a  b", "foo\n bar", "foo\n \nbar", "a <|endoftext|> b", "don't  stop ", " a \x85 b", "\x1c a", *[t for _, t in corpus[:30]]]
    assert [library.encode(t, add_special_tokens=False).ids for t in texts] == [x.tolist() for x in own(texts)]


@pytest.mark.parametrize("counts", [
    {600: 5000, 700: 100, 30: 10}, {600: 1}, {512: 7}, {1: 3000}, {k: k % 7 for k in range(1, 1024)}, {300: 10, 724: 10}, {1023: 5, 1: 2}])
def test_plan_gives_each_rank_one_slot(counts):
    slots, sequences = packing.plan(dict(counts), 1024)
    fill, ranks = defaultdict(list), Counter()
    for rest, first, n, per, sequence, offset, cut in slots:
        assert first == ranks[rest]
        ranks[rest] += n
        for k in range(n):
            if cut:
                parts = packing.parts_of(rest)
                for j, p in enumerate(parts):
                    fill[sequence + k * len(parts) + j].append((0, p))
            else:
                fill[sequence + k // per].append((offset + k % per * rest, rest))
    assert ranks == Counter({r: n for r, n in counts.items() if n})
    assert set(fill) == set(range(sequences))
    padding = total = 0
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    assert padding <= 0.02 * total + 1024


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.array(sorted(rng.choice(np.arange(2, 30), 4, replace=False)))
        values = rng.random(4)
        best, chosen = packing.knapsack(sizes, values, 40)
        brute = max(sum(c * v for c, v in zip(cs, values)) for cs in np.ndindex(*(40 // s + 1 for s in sizes)) if sum(c * s for c, s in zip(cs, sizes)) <= 40)
        assert best == pytest.approx(brute)
        assert sum(sizes[j] * k for j, k in chosen.items()) <= 40


def test_awkward_rows(docs, none):
    library = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, keep_ids=True).collect()
    want = Counter((r["doc_id"], tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    for pieces in sequences.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= 1024
    for (doc_id, ids), copies in want.items():
        own = sorted(covered[doc_id, len(ids)])
        if copies == 1 and sum(1 for d, x in want if d == doc_id and len(x) == len(ids)) == 1:
            assert np.frombuffer(b"".join(b for _, b in own), "<u4").tolist() == list(ids)
        else:
            assert sum(len(b) for _, b in own) >= 4 * len(ids) * copies
    assert packing.pack(none, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, 1000)
