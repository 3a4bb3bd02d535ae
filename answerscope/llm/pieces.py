"""Operator 1: SentencePiece encoding and decoding with offsets into the original bytes.

The normaliser walks the model's compiled character map, takes the longest mapped prefix at
each place and records for every byte of the normalised text the byte of the original it came
from.  Pieces are then projected through that alignment.  A normalised text is cut where no
piece of the vocabulary can cross (before a run of word marks), and each distinct segment is
split into pieces once per worker, by the library under a model whose normaliser is off.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm import common

MARK = "▁"
# fixed values: piece types of the model format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(blob: bytes) -> Iterator[tuple[int, int, object, bytes]]:
    """Number, wire type, value and raw bytes of each field of a protocol-buffer message."""

    def varint(at):
        value = shift = 0
        while True:
            value |= (blob[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if blob[at - 1] < 128:
                return value, at

    at = 0
    while at < len(blob):
        start = at
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = blob[at:at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = blob[at:at + size], at + size
        yield key >> 3, kind, value, blob[start:at]


class Normaliser:
    """Longest-prefix normalisation with the source of every normalised byte."""

    def __init__(self, spec: bytes, user_defined: list[str], suffix: bool):
        f = {n: v for n, _, v, _ in _fields(spec)}
        self.dummy, self.squeeze, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        self.suffix, self.user = suffix, sorted((u.encode() for u in user_defined), key=len, reverse=True)
        chars = f.get(2, b"")
        self.trie = None
        if chars:
            size = struct.unpack_from("<I", chars)[0]
            self.trie = np.frombuffer(chars, "<u4", size // 4, 4).tolist()
            self.texts = chars[4 + size:]
        self.plain = not (chars or self.user or self.squeeze or suffix or not self.escape)

    def prefix(self, b: bytes, at: int) -> tuple[bytes, int]:
        """The normalised form of the longest mapped prefix at ``at``, and how many bytes it takes."""
        for u in self.user:
            if b.startswith(u, at):
                return u, len(u)
        if self.trie:
            node, best, value = 0, 0, 0
            unit = self.trie[0]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            for i in range(at, len(b)):
                node ^= b[i]
                if node >= len(self.trie):
                    break
                unit = self.trie[node]
                if unit & (1 << 31 | 255) != b[i]:
                    break
                node ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    best, value = i + 1 - at, self.trie[node] & (1 << 31) - 1
            if best:
                return self.texts[value:self.texts.index(b"\0", value)], best
        first = b[at]
        size = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
        return b[at:at + size], size

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text; for each of its bytes and its end, the original byte."""
        b, at, out, source = text.encode(), 0, bytearray(), []
        space = MARK.encode() if self.escape else b" "
        if self.squeeze:
            while at < len(b):
                got, took = self.prefix(b, at)
                if got != b" ":
                    break
                at += took
        if at == len(b):
            return "", np.array([at], np.int64)

        def put(x):
            out.extend(x)
            source.extend([at] * len(x))

        if self.dummy and not self.suffix:
            put(space)
        after_space = self.squeeze
        while at < len(b):
            got, took = self.prefix(b, at)
            if after_space:
                got = got.lstrip(b" ")
            if got:
                put(got.replace(b" ", space))
                after_space = got.endswith(b" ")
            at += took
            after_space = after_space and self.squeeze
        end = at
        if self.squeeze:
            while out.endswith(space):
                end = source[len(out) - len(space)]
                del out[-len(space):], source[-len(space):]
        if self.dummy and self.suffix:
            out.extend(space)
            source.extend([end] * len(space))
        return out.decode(), np.array([*source, end], np.int64)


class Codec:
    """Encoder and decoder of one model; lives in a worker."""

    def __init__(self, model: bytes, most: int = 400_000):
        import sentencepiece

        self.pieces, self.types, spec, trainer, kept = [], [], b"", {}, []
        for number, _, value, raw in _fields(model):
            if number == 1:
                f = {n: v for n, _, v, _ in _fields(value)}
                self.pieces.append(f[1].decode())
                self.types.append(f.get(3, NORMAL))
            if number == 2:
                trainer = {n: v for n, _, v, _ in _fields(value)}
            if number == 3:
                spec = value
            else:
                kept.append(raw)
        off = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # normaliser off: the texts come normalised
        self.library = sentencepiece.SentencePieceProcessor(model_proto=b"".join(kept) + bytes([0x1A, len(off)]) + off)
        self.suffix = bool(trainer.get(24, 0))
        self.unknown_text = trainer[44].decode() if 44 in trainer else " ⁇ "
        user = [p for p, t in zip(self.pieces, self.types) if t == USER_DEFINED]
        self.normalise = Normaliser(spec, user, self.suffix)
        crosses = re.compile(f"[^{MARK}]{MARK}")
        self.cut = not self.suffix and not any(crosses.search(p) for p, t in zip(self.pieces, self.types) if t in (NORMAL, USER_DEFINED))
        n = len(self.pieces)
        self.byte = [int(p[3:5], 16) if t == BYTE else -1 for p, t in zip(self.pieces, self.types)]
        self.odd = np.array([t in (UNKNOWN, CONTROL) for t in self.types])       # not their own text when decoded
        self.wide = np.array([t in (UNKNOWN, BYTE) and b != b & 127 for t, b in zip(self.types, self.byte)])  # sized in context
        plain = self.normalise.plain
        self.sizes = np.array([1 if b >= 0 else len(p.encode()) - 2 * plain * p.count(MARK) for p, b in zip(self.pieces, self.byte)], np.int32)
        self.marks = np.array([p.count(MARK) for p in self.pieces])
        self.surface = [bytes([b]) if b >= 0 else p.replace(MARK, " ").encode() for p, b in zip(self.pieces, self.byte)]
        assert n == self.library.get_piece_size()
        self.words = common.Memory(self._split, most)   # word -> ids and sizes, the word having one mark before it
        self.others = common.Memory(lambda new: self._split(new, ""), most)

    def _split(self, words: list[str], before: str = MARK) -> list[bytes]:
        """For each word its ids and sizes, as pairs of 32-bit integers."""
        split = self.library.encode([before + w for w in words], num_threads=1)
        ids = np.fromiter(itertools.chain.from_iterable(split), np.int32)
        at = np.cumsum([0, *map(len, split)])
        sizes = self.sizes[ids] if len(ids) else ids
        for k in np.unique(np.searchsorted(at, np.flatnonzero(self.wide[ids]), "right") - 1) if len(ids) else []:
            sizes[at[k]:at[k + 1]] = self._odd_sizes(before + words[k], ids[at[k]:at[k + 1]])
        pairs, at = np.stack([ids, sizes], axis=1).astype(np.int32).tobytes(), (at * 8).tolist()
        return [pairs[x:y] for x, y in zip(at, at[1:])]

    def _odd_sizes(self, segment: str, ids: np.ndarray) -> np.ndarray:
        """Sizes where a piece is a byte (the last byte of a character holds it) or unknown."""
        if any(self.types[i] == UNKNOWN for i in ids):
            got = self.library.encode(segment, return_type="proto").pieces
            plain = self.normalise.plain
            return np.array([len(p.surface.encode()) - 2 * plain * p.surface.count(MARK) for p in got], np.int32)
        sizes, k = self.sizes[ids].copy(), 0
        while k < len(ids):
            lead = self.byte[ids[k]]
            if lead < 0:
                k += 1
                continue
            n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            sizes[k:k + n] = 0
            sizes[k + n - 1] = n
            k += n
        return sizes

    def _segments(self, normal: str) -> tuple[dict, list[str]]:
        if self.cut and normal.startswith(MARK) and MARK * 2 not in normal:
            return self.words, normal[1:].split(MARK)
        return self.others, (re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", normal) if self.cut else [normal] if normal else [])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids and the begin and end byte of every piece in the original text."""
        todo, new, strange = [], set(), set()
        for text in texts:
            if self.normalise.plain and MARK not in text:
                normal, source = (MARK * self.normalise.dummy + text.replace(" ", MARK) if text else ""), None
            else:
                normal, source = self.normalise(text)
            memory, cut = self._segments(normal)
            (new if memory is self.words else strange).update(cut)
            todo.append((memory, cut, source))
        self.words.learn(new)
        self.others.learn(strange)
        return [self._joined(*x) for x in todo]

    def _joined(self, memory, cut, source):
        got = map(memory.__getitem__, cut)
        ids, sizes = np.frombuffer(b"".join(got), np.int32).reshape(-1, 2).T
        if source is not None and self.normalise.plain:  # the text has marks of its own: sizes in normalised bytes
            sizes = sizes + 2 * self.marks[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        begins = ends - sizes
        if source is None:
            if self.normalise.dummy and len(ends):  # the mark before the text has no byte of its own
                begins, ends = np.maximum(begins - 1, 0), np.maximum(ends - 1, 0)
            return ids, begins, ends
        return ids, source[begins], source[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the pieces, by the library's rules for marks, unknown, control and byte pieces."""
        strip = self.normalise.dummy or self.normalise.squeeze
        if len(ids) and not self.odd[ids].any() and not self.normalise.squeeze and self.byte[ids[0]] < 0:
            try:  # bytes that make characters
                text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode()
                return text[1:] if strip and text.startswith(" ") else text
            except UnicodeDecodeError:
                pass
        out, run, begin, seen = [], bytearray(), True, False

        def flush():
            at = 0
            while at < len(run):
                lead = run[at]
                n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                try:
                    out.append(bytes(run[at:at + n]).decode())
                    at += n
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids.tolist():
            if self.types[i] == BYTE:
                run.append(self.byte[i])
                continue
            flush()
            if seen or any(out):
                begin = False
            seen = False
            if self.types[i] == CONTROL:
                continue
            if self.types[i] == UNKNOWN:
                out.append(self.unknown_text)
                continue
            piece = self.pieces[i]
            if begin and strip and piece.startswith(MARK):
                piece, seen = piece[1:], not self.normalise.squeeze
            out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)


SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def encode(docs: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """Ids, byte spans and (optionally) the decoded text of every whole text.

    ``begins``/``ends`` are byte offsets into the UTF-8 of the original text, end exclusive; all
    but the last byte piece of a character are empty spans.  Null and empty texts give empty
    arrays and ''; repeated rows and null ids are kept as they are; other columns are ignored.
    The model file is read on the driver and travels with the task (its size is fixed by the
    vocabulary).
    """
    with open(path, "rb") as f:
        model = f.read()

    def work(batches):
        codec = Codec(model)
        for batch in common.slices(batches):
            texts = batch.column("text").to_pylist()
            got = codec.encode(texts)
            sizes = [len(g[0]) for g in got]
            join = lambda k: np.concatenate([g[k] for g in got]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *[common.list_array(join(k), sizes, pa.int32()) for k in range(3)],
                pa.array([codec.decode(g[0]) for g in got] if decoded else [None] * len(got), pa.string()),
            ], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return common.texts_of(docs).mapInArrow(work, SCHEMA)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text`` of arrays ``ids``; null or empty ids give ''."""
    with open(path, "rb") as f:
        model = f.read()

    def work(batches):
        codec = Codec(model)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, and how far into the text the last piece reaches."""
    return encode(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("covered_bytes"),
    )
