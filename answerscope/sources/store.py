"""The run store as a log of whole versions.

Every write puts its rows into a folder of its own below ``data/`` and then publishes a manifest,
``log/<version>.json``, that names the folders a reader needs: one base and the changes made since,
in order.  A manifest is published last and in one step, so a job that dies leaves a folder that
nobody reads, and of two writers only one can publish a version; the other puts its change on
top of that version and tries the next one.

A change holds ``rows`` (they replace stored rows of the same key), ``void`` (brands whose earlier
rows no longer count), or both.  A purge voids the brands that lose runs and rewrites their
survivors; an erasure names its brand in the manifest and then removes its files.  ``compact`` folds
the changes into a new base beside whatever else is written, ``vacuum`` removes what no manifest names.

Rows and the narrow index (see ``INDEX``) lie in one folder per brand, so a brand can be found and
removed without reading others.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from py4j.protocol import Py4JJavaError

from answerscope import fixed
from answerscope.operators.retention import is_expired

#: what the index keeps of a run, where the rows have it
INDEX = ["created_at", "composite", "grade", "readiness", "visibility", "mention_rate", "simulated", "blocked", "recommendations"]
#: changes a store gathers before the next write by a stream folds them into the base
CHANGES_KEPT = 16
#: seconds a folder that no manifest names is left alone, as a write may still be under way
GRACE = 24 * 3600.0


@dataclass(frozen=True)
class Change:
    """One published write: its folder, what lies in it, and the brands it erases."""

    folder: str
    rows: bool = False
    void: bool = False
    erased: tuple[str, ...] = ()


@dataclass(frozen=True)
class Manifest:
    """A version: the base folder (None: no rows yet), the changes since, the last batch of every stream, the columns of a row."""

    version: int = 0
    base: str | None = None
    changes: tuple[Change, ...] = ()
    streams: dict = field(default_factory=dict)
    schema: dict | None = None

    def text(self) -> str:
        return json.dumps({**vars(self), "changes": [vars(c) for c in self.changes]})

    @staticmethod
    def parse(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(**{**d, "changes": tuple(Change(**{**c, "erased": tuple(c["erased"])}) for c in d["changes"])})

    def folders(self) -> set[str]:
        return {f for f in (self.base, *[c.folder for c in self.changes]) if f}


class RunStore:
    """Runs under ``path``, one row per (brand_key, run_id).

    Rows without a brand or a run id cannot be addressed and are refused; of rows that repeat a key
    in one write the latest by ``order`` counts.  A store that was never written has no schema, so
    reading it raises ``LookupError``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("brand_key", "run_id"), order: str = "created_at"):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), list(keys), order
        self.brand = self.keys[0]

    # files, by the cluster's own file system

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @property
    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _publish(self, m: Manifest) -> bool:
        """Whether the version was free: a rename that never replaces, which file systems do in one step."""
        jvm, fs = self.spark._jvm, self._fs
        draft, final = self._at("log", f".draft-{uuid.uuid4().hex}"), self._at("log", f"{m.version:020d}.json")
        out = fs.create(draft, False)
        out.write(m.text().encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, final, never)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.toString()):
                raise
            fs.delete(draft, False)
            return False

    # versions

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("log") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the one asked for."""
        known = self.versions()
        if version is None and not known:
            return Manifest()
        stream = self._fs.open(self._at("log", f"{known[-1] if version is None else version:020d}.json"))
        try:
            return Manifest.parse(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        """Publish ``change`` of the newest version, whichever that is by then."""
        while True:
            now = self.manifest()
            new = change(now)
            if new is now:
                return now
            new = replace(new, version=now.version + 1)
            if self._publish(new):
                return new

    # writing

    def _write(self, rows: DataFrame | None, void: DataFrame | None = None) -> Change:
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        if rows is not None:
            rows.hint("rebalance", self.brand).write.partitionBy(self.brand).parquet(f"{at}/rows")
            stored = self.spark.read.schema(rows.schema).parquet(f"{at}/rows")
            narrow = [*self.keys, *[c for c in INDEX if c in rows.columns]]
            stored.select(*narrow).hint("rebalance", self.brand).write.partitionBy(self.brand).parquet(f"{at}/index")
        if void is not None:
            void.write.parquet(f"{at}/void")
        return Change(folder, rows is not None, void is not None)

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> Manifest:
        """Rows replace stored rows of the same key.  A batch of a stream that was published before changes nothing."""
        before = self.manifest()
        if stream is not None and before.streams.get(stream, -1) >= batch:
            return before
        rest = [c for c in rows.columns if c not in self.keys]
        addressed = F.assert_true(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys]), F.lit("a run without brand or id"))
        latest = F.max_by(F.struct(*rest), F.struct(F.col(self.order).isNotNull(), self.order)).alias("r")
        once = rows.where(addressed.isNull()).groupBy(*self.keys).agg(latest).select(*self.keys, "r.*").select(*rows.columns)
        change = self._write(once)

        def apply(m: Manifest) -> Manifest:
            if stream is not None and m.streams.get(stream, -1) >= batch:
                return m
            known = StructType.fromJson(m.schema) if m.schema else StructType()
            columns = StructType([*known, *[f for f in once.schema if f.name not in known.names]])
            streams = m.streams if stream is None else {**m.streams, stream: batch}
            return replace(m, changes=(*m.changes, change), streams=streams, schema=columns.jsonValue())

        return self._commit(apply)

    def erase(self, brand: str) -> int:
        """Remove a brand (L2): no version shows it any more and no file holds its rows.  How many runs it had.

        Its name stands in the manifest until the store is compacted and vacuumed, so that a compaction
        under way cannot bring its rows back.
        """
        if not self.versions():
            return 0
        had = self.index().where(F.col(self.brand) == brand).count()
        self._commit(lambda m: replace(m, changes=(*m.changes, Change("", erased=(brand,)))))
        self._remove((brand,))
        return had

    def _remove(self, brands: tuple[str, ...]) -> None:
        """Delete the brands' files in all folders, those of unfinished writes and older versions included."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for folder in self._names("data"):
            for kind in ("rows", "index"):
                for brand in brands:
                    self._fs.delete(self._at("data", folder, kind, f"{self.brand}={escape(brand)}"), True)

    def expired(self, as_of: Column, days: int = fixed.RETENTION_DAYS) -> DataFrame:
        """What a purge would remove (L1, the dry run): the index rows older than the window.  Rows without a date stay."""
        return self.index().where(is_expired(F.col("created_at"), as_of, days))

    def purge(self, as_of: Column, days: int = fixed.RETENTION_DAYS) -> int:
        """Remove runs older than the window (L1) and how many they were; a brand that loses all is gone.

        The survivors of the brands that lose runs take the place of all their rows in the version
        read; what others publish meanwhile comes after them.  The old rows' files are removed.
        """
        read = self.manifest()
        if not read.version:
            return 0
        gone = is_expired(F.col("created_at"), as_of, days)
        lost = self._state(read, "index").where(gone)
        # brands that lose runs, and how many: one narrow row each, written once and read twice
        told = self._write(None, lost.groupBy(self.brand).agg(F.count(F.lit(1)).alias("n")))
        per_brand = self.spark.read.schema(f"{self.brand} string, n long").parquet(f"{self.path}/data/{told.folder}/void")
        removed = per_brand.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if removed:
            survivors = self._state(read, "rows").join(per_brand, self.brand, "left_semi").where(~gone)
            change = self._write(survivors, per_brand)

            def apply(m: Manifest) -> Manifest:
                at = len(read.changes)
                if (m.base, m.changes[:at]) != (read.base, read.changes):
                    raise RuntimeError("the store was compacted or purged meanwhile; run the purge again")
                return replace(m, changes=(*m.changes[:at], change, *m.changes[at:]))

            # the purged rows still lie in older files: fold them away and drop those files
            self.compact(self._commit(apply))
            self.vacuum()
        self._fs.delete(self._at("data", told.folder), True)
        return removed

    def compact(self, read: Manifest | None = None) -> Manifest:
        """Fold base and changes into a new base.  Changes published meanwhile stay changes of the new base."""
        read = self.manifest() if read is None else read
        if not read.changes:
            return read
        base = self._write(self._state(read, "rows"))

        def apply(m: Manifest) -> Manifest:
            if (m.base, m.changes[:len(read.changes)]) != (read.base, read.changes):
                return m  # another compaction was first: its base holds the same rows
            return replace(m, base=base.folder, changes=m.changes[len(read.changes):])

        new = self._commit(apply)
        # a brand erased while the new base was written lies in it once more
        self._remove(tuple(b for c in new.changes for b in c.erased))
        return new

    def vacuum(self, grace: float = GRACE) -> list[str]:
        """Delete all manifests but the newest, the folders only they name, and folders that none ever named; the folders' names.

        The last may belong to writes under way: they stay until they are ``grace`` seconds old.  Readers
        of older versions lose their files.
        """
        versions = self.versions()
        kept = self.manifest(versions[-1]).folders() if versions else set()
        old = {f for v in versions[:-1] for f in self.manifest(v).folders()} - kept
        for v in versions[:-1]:
            self._fs.delete(self._at("log", f"{v:020d}.json"), False)
        dropped = []
        for folder in self._names("data"):
            age = time.time() - self._fs.getFileStatus(self._at("data", folder)).getModificationTime() / 1000
            if folder in old or (folder not in kept and age >= grace):
                self._fs.delete(self._at("data", folder), True)
                dropped.append(folder)
        return dropped

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """The runs of the newest version, or of one that was not vacuumed."""
        return self._state(self.manifest(version), "rows")

    def index(self, version: int | None = None) -> DataFrame:
        """A narrow row per run (see ``INDEX``); order it by ``created_at`` downwards for newest first."""
        return self._state(self.manifest(version), "index")

    def _columns(self, m: Manifest, kind: str) -> StructType:
        if not m.version:
            raise LookupError(f"nothing was ever written to {self.path}")
        columns = StructType.fromJson(m.schema)
        return columns if kind == "rows" else StructType([f for f in columns if f.name in (*self.keys, *INDEX)])

    def _table(self, folder: str, kind: str, columns: StructType) -> DataFrame | None:
        """Rows of a folder; None where it has none or all its brands have been removed."""
        if not any("=" in n for n in self._names("data", folder, kind)):
            return None
        return self.spark.read.schema(columns).parquet(f"{self.path}/data/{folder}/{kind}").select(*columns.names)

    def _state(self, m: Manifest, kind: str) -> DataFrame:
        """Base rows that no change replaces or voids, and the newest row of each changed key.

        The base meets only keys and brands of the changes, which are narrow: while they are few the
        join is a broadcast by measured size and the base stays where it was read.
        """
        columns = self._columns(m, kind)
        place, since = "_".join([*columns.names, "place"]), "_".join([*columns.names, "since"])
        base = self._table(m.base, kind, columns) if m.base else None
        tables = [(k, t) for k, c in enumerate(m.changes) if c.rows and (t := self._table(c.folder, kind, columns)) is not None]
        voids = [self.spark.read.schema(f"{self.brand} string").parquet(f"{self.path}/data/{c.folder}/void").withColumn(since, F.lit(k)) for k, c in enumerate(m.changes) if c.void]
        erased = [(b, k) for k, c in enumerate(m.changes) for b in c.erased]
        if erased:
            voids.append(self.spark.createDataFrame(erased, f"{self.brand} string, {since} int"))
        void = reduce(DataFrame.unionByName, voids).groupBy(self.brand).agg(F.max(since).alias(since)) if voids else None
        out = self.spark.createDataFrame([], columns)
        if base is not None:
            out = base if void is None else base.join(void, self.brand, "left_anti")
        if tables:
            changed = reduce(DataFrame.unionByName, [t.withColumn(place, F.lit(k)) for k, t in tables])
            if void is not None:
                # rows written together with a void are its survivors
                changed = changed.join(void, self.brand, "left").where(F.coalesce(F.col(place) >= F.col(since), F.lit(True))).drop(since)
            rest = [c for c in columns.names if c not in self.keys]
            newest = changed.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), place).alias(place)).select(*self.keys, f"{place}.*")
            out = newest if base is None else out.join(changed.select(*self.keys), self.keys, "left_anti").unionByName(newest)
        return out.select(*columns.names)
