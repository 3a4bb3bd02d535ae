"""Operator 2: packing documents into sequences by cutting-stock column generation.

A document of L ids gives floor(L / size) full sequences and one rest.  Only the histogram of
rests (at most size - 1 numbers) reaches the driver.  There a linear program over patterns
(which rests share a sequence) is solved by column generation: a knapsack dynamic program
prices the next pattern against the duals.  Its first columns cut a rest into powers of two,
which need no padding, so a rest that fits nowhere is never padded far.  The rounded patterns
are then given to documents by their rank among documents of the same rest: rank arithmetic
alone says which sequence a rest goes to and where, so no row meets another.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerscope.llm import common

#: cost of one more sequence, and of padding, in sequences; see ``solve``
EACH, PADDING = 0.01, 4.0
#: the split of a byte-level model before its merges (a fixed value of the vocabulary's format)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_letter() -> dict[str, int]:
    """How vocabularies of byte-level models spell bytes: printable ones as themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """Ids of whole texts under a vocabulary file; byte-level models run in the quicker of two libraries with the same result."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        pre, model = d.get("pre_tokenizer") or {}, d["model"]
        self.fast = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not d.get("normalizer")
        if not self.fast:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(spec)
            return
        import tiktoken

        letters = _byte_of_letter()
        self.special = {x["content"]: x["id"] for x in d.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in w): k for w, k in model["vocab"].items() if w not in self.special}
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.fast:
            return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        names = set(self.special)
        return [self.engine.encode_to_numpy(t, allowed_special={s for s in names if s in t}, disallowed_special=()) for t in texts]


def parts_of(rest: int) -> list[int]:
    """Powers of two that add up to ``rest``, largest first."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


MEASURED = "doc_id long, part int, tokens long, full_crcs array<long>, full_before long, rest int, rest_before long, rest_crc long, cut_crcs array<long>, ids binary"


def measure(docs: DataFrame, path: str, size: int, keep_ids: bool) -> DataFrame:
    """Per document its id count, the checksums of its possible pieces, and its place among its task's rows."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    def work(batches):
        from pyspark import TaskContext

        part, tokens, full_before, seen = TaskContext.get().partitionId(), Tokens(spec), 0, Counter()
        for batch in common.slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens(batch.column("text").to_pylist())):
                data = ids.astype("<u4").tobytes() + b"\0\0\0\0"
                n = len(data) // 4
                full, rest = divmod(n, size)
                at, cuts = full * size * 4, []
                for k in parts_of(rest):
                    cuts.append(zlib.crc32(data[at:at + 4 * k]))
                    at += 4 * k
                rows.append((doc_id, part, n, [zlib.crc32(data[4 * size * k:4 * size * (k + 1)]) for k in range(full)], full_before, rest, seen[rest],
                             zlib.crc32(data[4 * full * size:]), cuts, data if keep_ids else None))
                full_before += full
                seen[rest] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()])],
                names=["doc_id", "part", "tokens", "full_crcs", "full_before", "rest", "rest_before", "rest_crc", "cut_crcs", "ids"])

    return common.texts_of(docs).mapInArrow(work, MEASURED)


def knapsack(sizes: np.ndarray, values: np.ndarray, size: int) -> tuple[float, Counter]:
    """The fullest worth of items (each as often as wished) that fit into ``size``, and which they are."""
    return fillings(sizes, values, size, 1)[0]


def fillings(sizes: np.ndarray, values: np.ndarray, size: int, most: int) -> list[tuple[float, Counter]]:
    """The best filling of all, then up to ``most`` in all the best that hold other items."""
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    fits = np.searchsorted(sizes, np.arange(size + 1), "right")
    for room in range(1, size + 1):
        best[room], pick[room] = best[room - 1], -1
        if k := fits[room]:
            worth = best[room - sizes[:k]] + values[:k]
            j = int(worth.argmax())
            if worth[j] > best[room] + 1e-12:
                best[room], pick[room] = worth[j], j

    def filling(room: int, chosen: Counter) -> Counter:
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                chosen[int(pick[room])] += 1
                room -= sizes[pick[room]]
        return chosen

    found = [(float(best[size]), filling(size, Counter()))]
    holding = best[size - sizes] + values
    for j in np.argsort(-holding, kind="stable")[:4 * most]:
        if len(found) < most and not any(int(j) in c for _, c in found):
            found.append((float(holding[j]), filling(size - int(sizes[j]), Counter([int(j)]))))
    return found


def first_patterns(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], bool]]:
    """A feasible start: longest rest first, filled up with the longest that fit, used until one rest runs out.

    Amounts are fractions, as in the program.  The pattern that uses a rest up stands for it in
    the basis, which is therefore triangular.  A pattern that would be padded dearly gives way
    to cutting its longest rest.
    """
    left, columns = {r: float(counts[r]) for r in sorted(counts, reverse=True)}, {}
    while left:
        room, pattern = size, {}
        for r, n in left.items():
            if k := min(room // r, math.ceil(n)):
                pattern[r] = k
                room -= r * k
                if not room:
                    break
        if (1 + PADDING) * room / size > EACH * sum(a * len(parts_of(r)) for r, a in pattern.items()):
            pattern, cut = {max(pattern): 1}, True
        else:
            cut = False
        times, spent = min((left[r] / a, r) for r, a in pattern.items())
        for r, a in pattern.items():
            left[r] -= a * times
        columns[spent] = (pattern, cut)
        for r in [r for r in pattern if left[r] <= 1e-9]:
            columns.setdefault(r, ({r: 1}, True))
            del left[r]
    return [columns[r] for r in sorted(counts)]


#: columns priced at a time, and entered before the basis is inverted anew; how much prices keep of those with the best bound
PRICED, REFACTOR, KEPT = 8, 64, 0.8


def solve(counts: dict[int, int], size: int, enough: float = 0.005, told: dict | None = None) -> list[tuple[dict[int, int], float, bool]]:
    """Patterns with how often the linear program uses each; the third value marks cut rests.

    A sequence costs 1 + PADDING x its padding (a share of ``size``); a rest cut into powers of
    two costs its own length plus EACH per sequence.  Columns are entered, however many it takes,
    until the cost is within ``enough`` of a lower bound: prices under which no column is worth more
    than ``k`` times its cost show that no solution costs less than what they pay over ``k``.  Columns
    are priced near the prices of the best bound so far, which keeps them from swinging.  ``told`` is
    given the bound, the number of columns, the cost and how far the demand is missed.
    """
    sizes = np.array(sorted(counts), np.int64)
    m, place = len(sizes), {s: k for k, s in enumerate(sorted(counts))}

    def column_of(pattern):
        column = np.zeros(m)
        for s, k in pattern.items():
            column[place[s]] = k
        return column

    def cost_of(pattern, cut):
        filled = sum(s * k for s, k in pattern.items())
        return filled / size + EACH * sum(k * len(parts_of(s)) for s, k in pattern.items()) if cut else 1 + PADDING * (size - filled) / size

    exact = np.array([counts[s] for s in sizes.tolist()], float)
    # demands a hair apart let no two patterns run out at once, so every column entered lowers the cost
    demand = exact * (1 + 1e-9 * np.arange(1, m + 1) / m)
    columns = first_patterns(counts, size)
    cost = np.array([cost_of(*c) for c in columns])
    alone = np.array([s / size + EACH * len(parts_of(s)) for s in sizes.tolist()])
    inverse, x, entered, bound, centre, kept = None, None, 0, 0.0, None, KEPT
    while True:
        if inverse is None or entered % REFACTOR < PRICED:
            inverse = np.linalg.inv(np.stack([column_of(p) for p, _ in columns], axis=1))
            x = np.maximum(inverse @ demand, 0)
        duals = cost @ inverse
        prices = duals if centre is None else kept * centre + (1 - kept) * duals
        single = int((duals - alone).argmax())
        full = fillings(sizes, prices + PADDING * sizes / size, size, PRICED)
        # a filled sequence costs one at least, so this is the most that a column is worth of its cost
        k = max(full[0][0] - PADDING, float((prices / alone).max()), 1e-9)
        if prices @ demand / k > bound:
            bound, centre = float(prices @ demand / k), prices
        if cost @ x <= bound * (1 + enough):
            break
        offers = [({int(sizes[single]): 1}, True)]
        offers += [({int(sizes[j]): n for j, n in chosen.items()}, False) for _, chosen in full if chosen]
        before = entered
        for pattern, cut in offers:
            d = inverse @ column_of(pattern)
            # worth its cost at the prices of this moment, which move with every column
            if cost @ d - cost_of(pattern, cut) <= 1e-9:
                continue
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            row = int(ratio.argmin())
            if not np.isfinite(ratio[row]):
                continue
            step = ratio[row]
            x = np.maximum(x - step * d, 0)
            x[row] = step
            pivot = inverse[row] / d[row]
            inverse -= np.outer(d, pivot)
            inverse[row] = pivot
            cost[row], columns[row] = cost_of(pattern, cut), (pattern, cut)
            entered += 1
        if entered > before:
            kept = KEPT
        elif kept:
            kept = 0.0  # nothing near the old prices: price at the current ones
        else:
            raise ArithmeticError(f"cost {cost @ x:.6g} above the bound {bound:.6g}, and no column can be entered")
    basis = np.stack([column_of(p) for p, _ in columns], axis=1)
    x = np.maximum(np.linalg.solve(basis, exact), 0)
    if told is not None:
        told |= {"bound": bound, "columns": entered, "cost": float(cost @ x), "missed": float(np.abs(basis @ x - exact).max())}
    return [(p, float(v), cut) for (p, cut), v in zip(columns, x)]


def best_fit(rests: list[int], size: int) -> list[list[int]]:
    """Sequences for the few rests that rounding leaves: each, longest first, where it leaves least room."""
    room: dict[int, list[list[int]]] = {}
    done = []
    for r in sorted(rests, reverse=True):
        free = min((f for f in room if f >= r and room[f]), default=None)
        held = room[free].pop() if free is not None else []
        held.append(r)
        room.setdefault((size if free is None else free) - r, []).append(held)
    for held in room.values():
        done += held
    return done


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int, bool]], int]:
    """Slots (rest, first rank, ranks, per sequence, first sequence, offset, cut) and the number of sequences.

    Floors of the program's solution come first; what they leave (less than one sequence per
    pattern) is packed by best fit.  Every rank of every rest gets exactly one slot.
    """
    counts = {r: n for r, n in counts.items() if r and n}
    used, slots, sequence = Counter(), [], 0

    def place(pattern: dict[int, int], times: int, cut: bool):
        nonlocal sequence
        at = 0
        for r, a in pattern.items():
            slots.append((r, used[r], times * a, a, sequence, at, cut))
            used[r] += times * a
            at += r * a
        sequence += times * (sum(len(parts_of(r)) for r in pattern) if cut else 1)

    for pattern, value, cut in solve(counts, size) if counts else []:
        times = min([int(value + 1e-6), *((counts[r] - used[r]) // a for r, a in pattern.items())])
        if times > 0:
            place(pattern, times, cut)
    for held in best_fit([r for r, n in counts.items() for _ in range(n - used[r])], size):
        pattern = Counter(held)
        padding = (1 + PADDING) * (size - sum(held)) / size
        if padding > EACH * sum(len(parts_of(r)) for r in held):
            for r, a in pattern.items():
                place({r: 1}, a, True)
        else:
            place(pattern, 1, False)
    return slots, sequence


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, path: str, size: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    ``size`` is a power of two.  Null and empty texts are the one closing id 0; an empty table
    gives no row; repeated rows are packed each; a null id is carried.  ``ids`` holds the piece's
    ids (32 bits each) if ``keep_ids``.  What the driver holds (histogram, patterns, slots) is
    bounded by ``size``, not by the number of documents.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    measured = common.written(measure(docs, path, size, keep_ids), "packing")
    counts = (measured.groupBy("part", F.col("rest").cast("int").alias("rest")).agg(F.count("*").alias("n"))
              .unionByName(measured.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("n")).withColumn("rest", F.lit(size))))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-counts")
    totals = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    slots, sequences = plan({r: n for r, n in totals.items() if 0 < r < size}, size)
    by_rest: dict[int, tuple] = {}
    for r in {s[0] for s in slots}:
        own = [s for s in slots if s[0] == r]
        by_rest[r] = (np.array([s[1] for s in own]), own)

    def work(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                full, ids = row["full_crcs"], row["ids"]

                def put(start, length, crc, sequence, offset):
                    out.append((row["doc_id"], start, length, crc, row["tokens"], sequence, offset, ids[4 * start:4 * (start + length)] if ids else None))  # noqa: B023

                first = sequences + row["full_offset"] + row["full_before"]
                for k, crc in enumerate(full):
                    put(k * size, size, crc, first + k, 0)
                if rest := row["rest"]:
                    rank, start = row["rest_offset"] + row["rest_before"], len(full) * size
                    firsts, own = by_rest[rest]
                    _, low, _, a, sequence, offset, cut = own[int(np.searchsorted(firsts, rank, "right")) - 1]
                    if cut:
                        parts = parts_of(rest)
                        for j, (length, crc) in enumerate(zip(parts, row["cut_crcs"])):
                            put(start, length, crc, sequence + (rank - low) * len(parts) + j, 0)
                            start += length
                    else:
                        put(start, rest, row["rest_crc"], sequence + (rank - low) // a, offset + (rank - low) % a * rest)
            if out:
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    at = counts.select("part", "rest", F.col("before").alias("rest_offset"))
    full_at = counts.where(F.col("rest") == size).select("part", F.col("before").alias("full_offset"))
    placed = measured.join(at, ["part", "rest"]).join(full_at, "part")
    return placed.select("doc_id", "tokens", "full_crcs", "full_before", "rest", "rest_before", "rest_crc", "cut_crcs", "ids", "rest_offset", "full_offset").mapInArrow(work, PACKED)
