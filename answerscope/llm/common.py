"""What the operators share: input columns, written tables, bounded word memory."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: white space as the contracts define words: the six ASCII characters that ``bytes.split()`` splits on
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, row: bool = False) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty) alone, whatever else the table holds; all its columns in ``row`` if asked for."""
    importable(docs.sparkSession)
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if row else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *whole)


def with_text(rows: DataFrame, text: str) -> DataFrame:
    """The columns held in ``row``, with another text and its length in ``n_chars`` (if there is one)."""
    names = rows.schema["row"].dataType.names
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*[new.get(n, F.col("row").getField(n)).alias(n) for n in names])


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, if it is not installed there."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


def held_out(folds: int, doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a session on one machine may leave that setting out; then a local folder serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="answerscope-")
    return f"{named.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut, columns can be pruned."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def written_and_told(df: DataFrame, name: str, **told: Column) -> tuple[DataFrame, dict]:
    """The same, and aggregates of the rows that are observed while they are written."""
    seen = Observation()
    return written(df.observe(seen, *[c.alias(k) for k, c in told.items()]), name), seen.get


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that memory does not follow the rows' length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def list_array(flat: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


class Memory(dict):
    """word -> value, filled in bulk; forgets all when it holds ``most`` entries, so that it stays small."""

    def __init__(self, fill, most: int = 400_000):
        super().__init__()
        self.fill, self.most = fill, most

    def learn(self, words: set) -> None:
        """Make every word of the set present."""
        if len(self) + len(words) > self.most:
            self.clear()
        new = [w for w in words if w not in self]
        if new:
            self.update(zip(new, self.fill(new)))


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        import xxhash

        super().__init__()
        self.most, self.of = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.of(word)
        return found

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: WordHashes, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words (A-Z lower-cased); of the whole text if it has fewer."""
    words = hashes(text.encode().lower().split())
    if not len(words):
        return words
    n, found = max(1, len(words) - width + 1), np.uint64(min(width, len(words)))
    total = np.full(n, found, np.uint64)
    for k in range(int(found)):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return total
