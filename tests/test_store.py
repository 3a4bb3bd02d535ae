"""The run store's log: whole versions, conflicts, erasure, purge, compaction."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from answerscope.sources.store import RunStore
from answerscope.streaming import live as N

T = dt.datetime(2024, 1, 1)
SCHEMA = "brand_key string, run_id string, created_at timestamp, composite double, detail string"
AS_OF = "2024-06-01"


def frame(spark, rows):
    return spark.createDataFrame([(b, r, None if t is None else T + dt.timedelta(days=t), c, f"{b}/{r}/{c}") for b, r, t, c in rows], SCHEMA)


def held(df):
    return sorted((r["brand_key"], r["run_id"], r["composite"]) for r in df.collect())


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@pytest.fixture
def store(spark, tmp_path):
    s = RunStore(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, [("a", "r1", 0, 1.0), ("a", "r2", 140, 2.0), ("b", "r1", 1, 3.0), ("ü /x", "r1", 140, 4.0), ("d", "r1", None, 5.0)]))
    s.upsert(frame(spark, [("a", "r2", 140, 2.5), ("b", "r2", 2, 3.5)]))
    return s


ALL = [("a", "r1", 1.0), ("a", "r2", 2.5), ("b", "r1", 3.0), ("b", "r2", 3.5), ("d", "r1", 5.0), ("ü /x", "r1", 4.0)]


def holding(path, brand):
    """Folders of a brand and Parquet files whose bytes hold its rows."""
    return [p for p in path.rglob("*") if p.name == f"brand_key={brand}" or (p.suffix == ".parquet" and f"{brand}/r".encode() in p.read_bytes())]


def test_versions_replace_by_key(store):
    assert held(store.read()) == ALL and store.versions() == [1, 2]
    assert held(store.read(1)) == [("a", "r1", 1.0), ("a", "r2", 2.0), ("b", "r1", 3.0), ("d", "r1", 5.0), ("ü /x", "r1", 4.0)]
    assert held(store.index()) == ALL and "detail" not in store.index().columns
    assert all(r["detail"] == f"{r['brand_key']}/{r['run_id']}/{r['composite']}" for r in store.read().collect())


def test_repeated_keys_and_rows_without_a_key(spark, store):
    store.upsert(frame(spark, [("a", "r1", 9, 7.0), ("a", "r1", 11, 8.0), ("a", "r1", None, 9.0)]))
    assert ("a", "r1", 8.0) in held(store.read())
    with pytest.raises(Exception, match="without brand or id"):
        store.upsert(frame(spark, [(None, "r1", 9, 7.0)]))
    assert store.versions() == [1, 2, 3]


def test_new_columns(spark, store):
    store.upsert(frame(spark, [("a", "r9", 9, 7.0)]).withColumn("grade", F.lit("A")).drop("detail"))
    got = {(r["brand_key"], r["run_id"]): (r["grade"], r["detail"]) for r in store.read().collect()}
    assert got["a", "r9"] == ("A", None) and got["a", "r1"] == (None, "a/r1/1.0")
    store.compact()
    assert got == {(r["brand_key"], r["run_id"]): (r["grade"], r["detail"]) for r in store.read().collect()}


def test_a_write_that_dies_is_never_read(spark, store, monkeypatch):
    monkeypatch.setattr(store, "_publish", lambda m: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        store.upsert(frame(spark, [("a", "r1", 0, 99.0), ("e", "r1", 0, 99.0)]))
    monkeypatch.undo()
    assert held(store.read()) == ALL and store.versions() == [1, 2]
    assert store.vacuum() == []  # too young to be told from a write under way
    assert len(store.vacuum(grace=-60.0)) == 1 and held(store.read()) == ALL


def test_only_one_writer_publishes_a_version(spark, store):
    known = store.manifest()
    assert store._publish(type(known)(3, known.base, known.changes, known.streams, known.schema))
    assert not store._publish(type(known)(3, None, (), {}, known.schema))
    assert store.manifest().changes == known.changes
    assert not [n for n in store._names("log") if "draft" in n]


def test_writers_beside_one_another(spark, store):
    """Both have written before either publishes: both changes are kept."""
    barrier, publish = threading.Barrier(2), RunStore._publish

    class Slow(RunStore):
        met = False

        def _publish(self, m):
            if not self.met:
                self.met = True
                barrier.wait(60)
            return publish(self, m)

    jobs = [threading.Thread(target=Slow(spark, store.path).upsert, args=(frame(spark, [(f"w{k}", "r1", 0, 1.0)]),)) for k in (1, 2)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join(120)
    assert held(store.read()) == sorted([*ALL, ("w1", "r1", 1.0), ("w2", "r1", 1.0)]) and store.versions() == [1, 2, 3, 4]


@pytest.mark.parametrize("brand", ["a", "ü /x"])
def test_erased_brands_leave_no_file(store, tmp_path, brand):
    had = sum(r[0] == brand for r in ALL)
    assert len(holding(tmp_path, "a")) > 0
    assert store.erase(brand) == had and store.erase(brand) == 0 and store.erase("nobody") == 0
    assert held(store.read()) == [r for r in ALL if r[0] != brand] == held(store.index())
    assert not holding(tmp_path, brand) and not [p for p in tmp_path.rglob("*") if p.is_dir() and "x" in p.name and p.parent.name in ("rows", "index") and brand == "ü /x"]
    store.compact()
    store.vacuum()
    assert held(store.read()) == [r for r in ALL if r[0] != brand]
    assert store.manifest().changes == ()


def test_erasure_beside_a_compaction(store, tmp_path):
    """The brand is erased after the compaction has read it and before its base is published."""
    commit, first = store._commit, []

    def late(change):
        if not first:
            first.append(1)
            assert RunStore(store.spark, store.path).erase("a") == 2
        return commit(change)

    store._commit = late
    store.compact()
    assert held(store.read()) == [r for r in ALL if r[0] != "a"] and not holding(tmp_path, "a")


def test_a_brand_may_come_back(spark, store):
    store.erase("a")
    store.upsert(frame(spark, [("a", "r5", 0, 9.0)]))
    assert [r for r in held(store.read()) if r[0] == "a"] == [("a", "r5", 9.0)]
    store.compact()
    assert [r for r in held(store.read()) if r[0] == "a"] == [("a", "r5", 9.0)]


def test_purge(store, tmp_path):
    left = [r for r in ALL if r[:2] not in (("a", "r1"), ("b", "r1"), ("b", "r2"))]
    assert held(store.expired(as_of(), 30)) == [("a", "r1", 1.0), ("b", "r1", 3.0), ("b", "r2", 3.5)] and held(store.read()) == ALL
    assert store.purge(as_of(), 30) == 3
    # the brand that lost all is gone and its older versions do not come back; undated runs stay
    assert held(store.read()) == left == held(store.index())
    assert not holding(tmp_path, "b") and not [p for p in holding(tmp_path, "a") if p.suffix == ".parquet" and b"a/r1/" in p.read_bytes()]
    assert store.purge(as_of(), 30) == 0 and held(store.read()) == left


def test_a_write_during_a_purge_is_kept(spark, store):
    commit, first = store._commit, []

    def late(change):
        if not first:
            first.append(1)
            RunStore(spark, store.path).upsert(frame(spark, [("b", "r7", 150, 7.0), ("a", "r2", 141, 2.75)]))
        return commit(change)

    store._commit = late
    assert store.purge(as_of(), 30) == 3
    assert held(store.read()) == [("a", "r2", 2.75), ("b", "r7", 7.0), ("d", "r1", 5.0), ("ü /x", "r1", 4.0)]


def test_everything_may_go(spark, store, tmp_path):
    for brand in ("a", "b", "d", "ü /x"):
        store.erase(brand)
    assert held(store.read()) == [] and "composite" in store.read().columns
    store.compact()
    store.vacuum()
    assert held(store.read()) == [] and "detail" in store.read().columns and held(store.index()) == []
    empty = RunStore(spark, str(tmp_path / "none"))
    assert empty.erase("a") == 0 and empty.purge(as_of()) == 0 and empty.versions() == [] and empty.vacuum() == []
    with pytest.raises(LookupError):
        empty.read()


def test_compaction(spark, store):
    for k in range(3):
        store.upsert(frame(spark, [("a", "r1", 0, 10.0 + k), (f"n{k}", "r1", 0, 1.0)]))
    before = held(store.read())
    m = store.compact()
    assert m.changes == () and held(store.read()) == before and store.compact() == m
    assert len(store.vacuum()) == 5 and held(store.read()) == before and store.versions() == [m.version]


def test_compaction_beside_a_write(spark, store):
    commit, first = store._commit, []

    def late(change):
        if not first:
            first.append(1)
            RunStore(spark, store.path).upsert(frame(spark, [("a", "r1", 0, 77.0)]))
        return commit(change)

    store._commit = late
    assert len(store.compact().changes) == 1
    assert ("a", "r1", 77.0) in held(store.read()) and len(held(store.read())) == len(ALL)


def test_stream_batches_count_once(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    for batch in (0, 1, 1, 0):
        store.upsert(frame(spark, [("a", f"r{batch}", 0, float(batch))]), "runs", batch)
    store.upsert(frame(spark, [("a", "r0", 0, 5.0)]), "other", 0)
    store.compact()
    store.upsert(frame(spark, [("a", "r0", 0, 6.0)]), "runs", 1)  # replayed after the compaction
    assert held(store.read()) == [("a", "r0", 5.0), ("a", "r1", 1.0)] and store.versions() == [1, 2, 3, 4]


def test_stream_into_a_store(spark, tmp_path):
    """Reads meet one base and few changes, however many batches came."""
    store, src = RunStore(spark, str(tmp_path / "s")), str(tmp_path / "in")
    want = {}
    for k in range(5):
        rows = [("a", "r1", 0, float(k)), (f"b{k % 2}", f"r{k}", 0, 1.0)]
        frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
        want |= {(b, r): c for b, r, _, c in rows}
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        N.run_once(N.upsert_store(stream, store, "runs", str(tmp_path / "mark"), keep=2))
        assert len(store.manifest().changes) <= 2
        assert held(store.read()) == sorted((b, r, c) for (b, r), c in want.items())
    assert store.manifest().streams == {"runs": 4} and store.manifest().base
