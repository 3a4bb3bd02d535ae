import random

import pytest

SYLLABLES = "ka lo mi ter an sch é ñu tion re st ou be ga".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    """``n`` words in sentences and lines."""
    out = []
    for k in range(n):
        w = word(rng)
        out.append((w.capitalize() if k % 11 == 0 else w) + (("." if k % 33 else ".\n") if k % 11 == 10 else ""))
    return " ".join(out) + "."


def awkward():
    """Ids and texts that every operator must take: nulls, empty, white space, repeats, ties, very long."""
    rng = random.Random(4)
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (7, "one"), (None, prose(rng, 60)), (None, None),
        (8, prose(rng, 20_000)), (9, "x" * 50_000), (10, "a b c d"), (11, "a b c d"), (12, "".join(c.upper() if c.isascii() else c for c in base)), (13, "日本 \U0001F600 \u2581 <|endoftext|>"),
        (14, "# $ % & | < >\n" * 40), (15, "the same line of eight words stands here again\n" * 30), (16, prose(rng, 300)),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with awkward rows and columns whose names clash with those the operators use."""
    rows = [(i, t, "en", "s", 0, "block", 1.5, [1], k) for k, (i, t) in enumerate(awkward())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string, score double, ids array<int>, row long")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def corpus():
    """A few hundred texts: prose, copies, near copies, chains of near copies, shared passages."""
    rng = random.Random(9)
    out = [prose(rng, rng.choice([3, 8, 30, 80, 200, 400])) for _ in range(120)]
    for _ in range(40):
        words = rng.choice(out).split(" ")
        for _ in range(rng.randint(0, max(1, len(words) // 30))):
            words[rng.randrange(len(words))] = word(rng)
        out.append(" ".join(words))
    chain = prose(rng, 100).split(" ")
    for k in range(12):  # each near the one before, the ends far apart
        chain[k * 7] = word(rng)
        chain[k * 7 + 1] = word(rng)
        out.append(" ".join(chain))
    passage = prose(rng, 60)
    out += [prose(rng, 25) + "\n" + passage + "\n" + prose(rng, 25) for _ in range(40)]
    base = prose(rng, 150).split(" ")
    for _ in range(60):  # copies each near the base, less near one another; the base comes late
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(len(copy))] = word(rng)
        out.append(" ".join(copy))
    out.append(" ".join(base))
    return [(k, t) for k, t in enumerate(out)]
