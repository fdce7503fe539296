"""Tables on disk: scans, commits, pruning, upkeep, streams."""

import random
import threading
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.casts import UnsupportedCast, cast
from tidelake.functions.predicates import Builder as p
from tidelake.plans import indexes
from tidelake.plans.metadata import DataFile, Entry, live, plain, rich
from tidelake.sources.catalog import Catalog
from tidelake.sources.table import CommitConflict, CommitMessage
from tidelake.streaming.incremental import Follower, follow_to, sink


@pytest.fixture
def cat(spark, tmp_path):
    out = Catalog(spark, f"file://{tmp_path}/w{uuid.uuid4().hex}")
    out.create_database("db")
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data, schema="k long, v string"):
    return spark.createDataFrame(data, schema)


def test_catalog(cat):
    assert cat.databases() == ["db"] and cat.tables("db") == []
    cat.create_database("db", ignore_if_exists=True)
    cat.create_table("db.t", {"k": "BIGINT"})
    cat.create_table("db.t", {"k": "BIGINT"}, ignore_if_exists=True)
    assert cat.tables("db") == ["t"] and cat.table("db.t").schema.names == ["k"]
    for bad in (lambda: cat.create_database("db"), lambda: cat.create_database("sys"), lambda: cat.create_table("db.t", {"k": "INT"}), lambda: cat.create_table("no.t", {"k": "INT"}), lambda: cat.table("db.none"), lambda: cat.table("db")):
        with pytest.raises(ValueError):
            bad()


def test_empty_table(cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    assert t.scan().count() == 0 and t.plan().snapshot is None and list(Follower(t)) == []


def test_append_time_travel_and_errors(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    for i in range(3):
        t.append(frame(spark, [(i, "x")]), watermark=[5, None, 3][i])
    assert rows(t.scan(columns=["k"])) == [(0,), (1,), (2,)] and rows(t.scan(["k"], snapshot_id=2)) == [(0,), (1,)]
    assert [s.watermark for s in t.meta.snapshots()] == [5, 5, 5] and [s.total for s in t.meta.snapshots()] == [1, 2, 3]
    with pytest.raises(ValueError, match="not between"):
        t.scan(snapshot_id=9)
    with pytest.raises(ValueError, match="no columns"):
        t.scan(["nope"])
    assert t.snapshots().count() == 3 and t.files().count() == 3


def test_partitions_null_blank_and_special_characters(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, ["v"])
    t.append(frame(spark, [(1, "a/b=c"), (2, None), (3, "  "), (4, "é %"), (5, "a/b=c")]))
    assert rows(t.scan(partitions=[{"v": "a/b=c"}])) == [(1, "a/b=c"), (5, "a/b=c")]
    assert rows(t.scan(partitions=[{"v": "__DEFAULT_PARTITION__"}])) == [(2, None), (3, None)]
    assert len(rows(t.scan(partitions=[{}]))) == 5 and rows(t.scan(where=p.eq("v", "é %"))) == [(4, "é %")]
    assert len(t.plan(where=p.eq("v", "é %")).entries) == 1
    with pytest.raises(ValueError, match="partition keys"):
        t.scan(partitions=[{"k": "1"}])


@pytest.mark.parametrize("seed", range(4))
def test_pruned_scan_equals_full_scan(spark, cat, seed):
    """Every predicate, with nulls and with files written before a column was cast and added."""
    from tests.test_planning import random_predicate

    rng = random.Random(seed)
    t = cat.create_table("db.t", {"a": "INT", "b": "INT"}, options={"file-index.bitmap.columns": "a"})
    for _ in range(3):
        t.append(frame(spark, [(rng.choice([None, *range(5)]), rng.choice([None, *range(5)])) for _ in range(3)], "a int, b int").coalesce(1))
    for _ in range(12):
        w = random_predicate(rng)
        assert rows(t.scan(where=w)) == rows(t.scan().filter(w.column()))
    t.alter(("type", "a", "BIGINT"), ("drop", "b"), ("add", "b", "INT"))
    t.append(frame(spark, [(1, 2), (None, 3)], "a long, b int"))
    for _ in range(8):
        w = random_predicate(rng)
        assert rows(t.scan(where=w)) == rows(t.scan().filter(w.column()))


def test_statistics_skip_files(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    for i in range(4):
        t.append(frame(spark, [(10 * i + j, f"v{i}") for j in range(10)]).coalesce(1))
    assert len(t.plan(where=p.between("k", 12, 18)).entries) == 1 and t.scan(where=p.between("k", 12, 18)).count() == 7
    assert len(t.plan(limit=5).entries) == 1 and t.scan(limit=5).count() == 5
    assert [len(s) for s in t.plan().splits(1 << 30, 1)] == [4]


def test_value_conditions_wait_for_the_merge(spark, cat):
    """An old file alone would match: skipping the newer one would bring the old version back."""
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, [], ["k"], {"bucket": "2"})
    t.append(frame(spark, [(1, "old"), (2, "old")]))
    t.append(frame(spark, [(1, "new")]))
    assert rows(t.scan(where=p.eq("v", "old"))) == [(2, "old")] and rows(t.scan(where=p.eq("k", 1))) == [(1, "new")]
    assert rows(t.scan(bucket=0).union(t.scan(bucket=1))) == [(1, "new"), (2, "old")]


def test_conditions_and_columns_reach_the_scan(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING", "w": "STRING"}, [], ["k"], {"bucket": "1"})
    t.append(frame(spark, [(1, "a", "b")], "k long, v string, w string"))
    plan = t.scan(["k", "v"], where=p.ge("k", 1) & p.isin("v", ["a", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,1)" in plan and "In(v" not in plan.split("PushedFilters")[1].split("ReadSchema")[0] and "w:string" not in plan.split("ReadSchema")[1]
    u = cat.create_table("db.u", {"k": "BIGINT", "v": "STRING"})
    u.append(frame(spark, [(1, "a")]))
    plan = u.scan(["v"], where=p.eq("k", 1))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,1)" in plan


def test_bucket_column_matches_the_layout(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, options={"bucket": "3", "bucket-key": "k"})
    t.append(spark.range(50).selectExpr("id AS k", "'x' AS v"))
    from tidelake.sources.table import bucket_id

    for b in range(3):
        assert rows(t.scan(["k"], bucket=b)) == rows(spark.range(50).withColumnRenamed("id", "k").filter(bucket_id(["k"], 3) == b))


def test_arrival_order_decides_between_equal_sequences(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "s": "INT", "v": "STRING"}, [], ["k"], {"bucket": "1", "sequence.field": "s"})
    t.append(frame(spark, [(1, 5, "a"), (1, 5, "b"), (2, 9, "kept")], "k long, s int, v string").coalesce(1))
    t.append(frame(spark, [(1, 5, "c"), (2, 3, "late")], "k long, s int, v string"))
    assert rows(t.scan(["k", "v"])) == [(1, "c"), (2, "kept")]


def test_compaction_reads_raw_and_merges_with_what_follows(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, [], ["k"], {"bucket": "2"})
    t.append(frame(spark, [(i, "a") for i in range(6)]))
    t.append(frame(spark, [(0, "b", 0), (1, None, 3)], "k long, v string, _VALUE_KIND int"))
    t.compact()
    assert not t.plan().merged and "Aggregate" not in t.scan()._jdf.queryExecution().executedPlan().toString()
    t.append(frame(spark, [(2, "c")]))
    assert rows(t.scan()) == [(0, "b"), (2, "c"), (3, "a"), (4, "a"), (5, "a")]
    assert t.changes(2).count() == 2 and [i for i, _ in Follower(t, {"scan.mode": "from-snapshot", "scan.snapshot-id": "1"})] == [1, 2, 4]


def test_postponed_buckets_are_invisible_to_batches(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, [], ["k"], {"bucket": "-2"})
    t.append(frame(spark, [(1, "a")]))
    assert t.scan().count() == 0 and t.changes(1).count() == 1


def test_commit_is_idempotent_and_overwrites_check_partitions(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, ["v"])
    m = t.write(frame(spark, [(1, "a"), (2, "b")]))
    assert t.filter_and_commit({7: m}, "u") == 1 and t.filter_and_commit({7: m}, "u") == 0
    with pytest.raises(CommitConflict):
        t.commit(m, check=True)
    with pytest.raises(ValueError, match="outside"):
        t.overwrite(t.write(frame(spark, [(3, "z")])), [{"v": "a"}])
    assert t.filter_and_overwrite(t.write(frame(spark, [(9, "a")])), [{"v": "a"}], 8, "u") == 1
    assert t.filter_and_overwrite(CommitMessage(), [{"v": "a"}], 8, "u") == 0 and rows(t.scan()) == [(2, "b"), (9, "a")]
    with pytest.raises(ValueError):
        t.drop_partitions([])
    t.drop_partitions([{"v": "b"}])
    assert rows(t.scan()) == [(9, "a")] and t.commit(CommitMessage(), ignore_empty=True) is None
    old = [e for e in t.meta.entries(t.meta.snapshot(1))]
    with pytest.raises(CommitConflict, match="not in the table"):
        t.commit(CommitMessage([Entry("DELETE", e.partition, e.bucket, e.file) for e in old]))


def test_two_committers_lose_nothing(spark, cat):
    cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    tables = [cat.table("db.t") for _ in range(2)]
    messages = [[t.write(frame(spark, [(10 * n + i, "x")])) for i in range(4)] for n, t in enumerate(tables)]

    def work(n):
        for m in messages[n]:
            tables[n].commit(m, user=f"u{n}")

    threads = [threading.Thread(target=work, args=(n,)) for n in range(2)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(rows(cat.table("db.t").scan())) == 8 and [s.id for s in tables[0].meta.snapshots()] == list(range(1, 9))


def test_external_commit_request_publishes_nothing(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    request = t.commit(t.write(frame(spark, [(1, "a")])), request_only=True)
    assert t.meta.latest() is None and '"id": 1' in request["snapshot"] and request["partitions"][0]["records"] == 1


def test_manifests_are_merged(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, options={"manifest.merge-min-count": "3"})
    for i in range(7):
        t.append(frame(spark, [(i, "x")]))
    assert len(t.meta.read_list(t.meta.latest().base)) < 4 and t.scan().count() == 7


def test_expire_keeps_what_is_used(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    for i in range(5):
        t.append(frame(spark, [(i, "x")]))
    assert t.expire(retain_min=2, older_than=0) == 0 and t.expire(retain_min=2, older_than=2**62, limit=2) == 2
    assert t.expire(retain_min=1, retain_max=1, older_than=0) == 2 and t.meta.earliest_id() == 5 and t.scan().count() == 5
    f = Follower(t, position=2)
    with pytest.raises(ValueError, match="expired"):
        f.poll()


def test_orphans(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    t.append(frame(spark, [(1, "x")]))
    t.write(frame(spark, [(2, "lost")]))
    assert t.remove_orphans(older_than=0) == []
    kept = t.remove_orphans(older_than=2**62, retain=lambda f: True)
    assert kept == [] and any(f.endswith(".parquet") for f in t.remove_orphans(older_than=2**62)) and rows(t.scan()) == [(1, "x")]


def test_deletion_vectors_count_and_survive_appends(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, options={"deletion-vectors.enabled": "true"})
    t.append(frame(spark, [(i, "x") for i in range(10)]).coalesce(1))
    assert t.delete_rows(p.lt("k", 4)) == 4 and t.delete_rows(p.lt("k", 4)) == 0 and t.delete_rows(p.eq("k", 9)) == 1
    t.append(frame(spark, [(100, "y")]))
    assert rows(t.scan(["k"])) == sorted([(4,), (5,), (6,), (7,), (8,), (100,)], key=repr)
    assert t.scan(limit=6).count() == 6 and t.scan(snapshot_id=1).count() == 10
    with pytest.raises(ValueError):
        cat.create_table("db.u", {"k": "BIGINT"}).delete_rows(p.eq("k", 1))


def test_row_ids_and_partial_columns(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING", "w": "INT"}, options={"row-tracking.enabled": "true", "data-evolution.enabled": "true"})
    for i in range(2):
        t.append(frame(spark, [(10 * i + j, "a", 1) for j in range(3)], "k long, v string, w int").coalesce(1))
    ids = {r["k"]: r["_ROW_ID"] for r in t.scan(["k", "_ROW_ID"]).collect()}
    assert sorted(ids.values()) == list(range(6)) and t.meta.latest().next_row_id == 6
    t.commit(t.write(frame(spark, [(ids[0], "b", 2), (ids[11], None, 3)], "_ROW_ID long, v string, w int"), columns=["v", "w"]))
    t.commit(t.write(frame(spark, [(ids[0], 7)], "_ROW_ID long, w int"), columns=["w"]))
    assert rows(t.scan(["k", "v", "w"])) == sorted([(0, "b", 7), (1, "a", 1), (2, "a", 1), (10, "a", 1), (11, None, 3), (12, "a", 1)], key=repr)
    assert rows(t.scan(["k"], row_ranges=[(1, 1), (4, 9)])) == sorted([(k,) for k, i in ids.items() if i in (1, 4, 5)], key=repr)
    for w in (p.eq("k", 0), p.eq("w", 7), p.eq("w", 1), p.is_null("v"), p.ge("k", 11), p.lt("k", 2) & p.eq("v", "b")):
        assert rows(t.scan(["k", "v", "w"], where=w)) == rows(t.scan(["k", "v", "w"]).filter(w.column()))
    assert 2 <= len(t.plan(where=p.ge("k", 10)).entries) < t.plan().considered == len(t.plan(where=p.eq("w", 99)).entries)
    with pytest.raises(ValueError):
        t.write(frame(spark, [(1, "x")], "_ROW_ID long, nope string"), columns=["nope"])


def test_blob_column(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "b": "BLOB"}, options={"row-tracking.enabled": "true", "data-evolution.enabled": "true"})
    t.append(spark.createDataFrame([(1, bytearray(b"\0\xff")), (2, None)], "k long, b binary"))
    assert {r["k"]: r["b"] for r in t.scan().collect()} == {1: bytearray(b"\0\xff"), 2: None}
    with pytest.raises(ValueError):
        cat.create_table("db.u", {"b": "BLOB"}, options={"row-tracking.enabled": "true", "data-evolution.enabled": "true"})


def test_global_index_answers(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, options={"row-tracking.enabled": "true"})
    t.append(frame(spark, [(i % 5, f"v{i}") for i in range(20)]))
    indexes.build_global(t, "k")
    t.append(frame(spark, [(1, "tail"), (2, "tail")]))
    for w in (p.eq("k", 1), p.isin("k", [1, 3]) & p.eq("v", "v3"), p.eq("k", 1) & p.lt("k", 2), p.is_null("k"), p.eq("k", 1) | p.eq("v", "v0")):
        found = indexes.evaluate(t, w)
        assert rows(t.scan(index=found).filter(w.column())) == rows(t.scan().filter(w.column()))
    assert indexes.evaluate(t, p.eq("v", "v0")).ids is None and indexes.evaluate(t, p.eq("k", 1) | p.eq("v", "v0")).ids is None


def test_vector_scan(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "e": {"type": "ARRAY", "element": "FLOAT"}})
    t.append(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0])], "k long, e array<float>"))
    out = t.scan(["k"], vector=("e", [0.9, 0.0], 1))
    assert [(r["k"], round(r["_INDEX_SCORE"], 4)) for r in out.collect()] == [(2, 0.1)]
    assert rows(t.scan(["k"], where=p.lt("k", 2), vector=("e", [0.9, 0.0], 5)).select("k")) == [(1,)]


def test_adopt_checks_types(spark, cat, tmp_path):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    frame(spark, [(1, 2)], "k long, v int").coalesce(1).write.parquet(f"file://{tmp_path}/x")
    (path,) = [f for f, _, _ in cat.store.files(f"file://{tmp_path}/x") if f.endswith(".parquet")]
    with pytest.raises(ValueError, match="other types"):
        t.adopt([f"file://{tmp_path}/x/{path}"])


def test_external_paths(spark, cat, tmp_path):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, options={"data-file.external-paths": f"file://{tmp_path}/e1,file://{tmp_path}/e2", "data-file.external-paths.strategy": "round-robin"})
    for i in range(2):
        t.append(frame(spark, [(i, "x")]))
    assert rows(t.scan(["k"])) == [(0,), (1,)] and {e.file.path.split("/data/")[0][-2:] for e in t.meta.entries(t.meta.latest())} == {"e1", "e2"}


def test_follower_modes(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, ["v"])
    late = Follower(t, {"scan.mode": "latest"})
    assert late.poll() is None
    for i in range(3):
        t.append(frame(spark, [(i, "x")]))
    assert [i for i, _ in late] == [1, 2, 3]
    full = Follower(t)
    assert [(i, df.count()) for i, df in full] == [(3, 3)]
    t.drop_partitions([{"v": "x"}])
    t.append(frame(spark, [(9, "y")]))
    assert [(i, df.count()) for i, df in full] == [(5, 1)]  # an overwrite is no change
    assert [i for i, _ in Follower(t, {"scan.mode": "from-snapshot", "scan.snapshot-id": "2"})] == [2, 3, 5]
    with pytest.raises(ValueError, match="anew"):
        Follower(t, position=99).poll()


def test_follow_and_sink(spark, cat, tmp_path):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    put, seen = sink(t, "stream"), []
    for batch in (0, 1, 1):
        put(frame(spark, [(batch, "x")]), batch)
    handle = lambda df, i: seen.append((i, df.count()))
    for _ in range(2):
        follow_to(t, f"file://{tmp_path}/position", handle, {"scan.mode": "from-snapshot", "scan.snapshot-id": "1"})
    assert seen == [(1, 1), (2, 1)]


def test_structured_stream_into_a_table(spark, cat, tmp_path):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    spark.range(5).selectExpr("id AS k", "'x' AS v").write.parquet(f"file://{tmp_path}/in")
    q = spark.readStream.schema("k long, v string").parquet(f"file://{tmp_path}/in").writeStream.foreachBatch(sink(t, "q")).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert t.scan().count() == 5


def test_entries_round_trip():
    import datetime as dt
    from decimal import Decimal

    f = DataFile("data/x", 1, 2, 0, stats={"0": [dt.date(2020, 1, 1), dt.date(2021, 1, 1), 0], "1": [Decimal("1.5"), None, None], "2": [b"\1", b"\2", 1]}, write_cols=("a",))
    e = Entry("ADD", (None, "x", 3), 1, f)
    assert Entry.from_json(e.to_json()) == e and Entry.from_json(e.to_json()).file.stats == f.stats and rich(plain(f.stats)) == f.stats
    gone = Entry("DELETE", e.partition, 1, f)
    assert live([gone, e]) == [] and live([e, e]) == [e]


@pytest.mark.parametrize("value, source, target, want", [
    (300, "bigint", "tinyint", 44), (-129, "int", "tinyint", 127), (2**40 + 5, "bigint", "int", 5), (2.9, "double", "int", 2), (-2.9, "double", "bigint", -2), (1e30, "double", "int", 2**31 - 1), (True, "boolean", "double", 1.0),
    (7, "int", "boolean", True), ("YES", "string", "boolean", True), ("0", "string", "boolean", False), ("12", "string", "int", 12), ("1e400", "string", "double", float("inf")), ("19000", "string", "date", "2022-01-08"),
    ("2020-02-29", "string", "date", "2020-02-29"), ("12.345", "string", "decimal(4,2)", "12.35"), ("123.45", "string", "decimal(4,2)", None), (90, "bigint", "timestamp_ntz", "1970-01-01 00:01:30"), (None, "string", "int", None),
])
def test_casts(spark, value, source, target, want):
    kinds = [T._parse_datatype_string(x) if hasattr(T, "_parse_datatype_string") else None for x in (source, target)]
    df = spark.createDataFrame([(value,)], f"v {source}")
    got = df.select(cast(F.col("v"), *kinds).alias("v")).collect()[0]["v"]
    assert (str(got) if isinstance(want, str) else got) == want


@pytest.mark.parametrize("value, source, target", [("x", "string", "int"), ("1.5", "string", "int"), (" 1", "string", "boolean"), ("300", "string", "tinyint"), ("abc", "string", "decimal(4,2)"), ("2020-13-01", "string", "date"), (float("nan"), "double", "decimal(4,2)")])
def test_casts_that_fail(spark, value, source, target):
    kinds = [T._parse_datatype_string(x) for x in (source, target)]
    with pytest.raises(Exception, match="cannot cast"):
        spark.createDataFrame([(value,)], f"v {source}").select(cast(F.col("v"), *kinds)).collect()


def test_unregistered_casts():
    for a, b in ((T.DoubleType(), T.BooleanType()), (T.ArrayType(T.LongType()), T.StringType()), (T.DateType(), T.LongType()), (T.LongType(), T.DateType())):
        with pytest.raises(UnsupportedCast):
            cast(None, a, b)


def test_streaming_source(spark, cat, tmp_path):
    from tidelake.streaming.source import Source

    spark.dataSource.register(Source)
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, ["v"])
    t.append(frame(spark, [(1, "a"), (2, "b")]))
    t.drop_partitions([{"v": "b"}])
    t.alter(("add", "w", "INT"))
    t.append(frame(spark, [(3, "c", 7)], "k long, v string, w int"))

    def follow():
        got = []
        q = spark.readStream.format("tidelake").load(t.path).writeStream.foreachBatch(lambda df, i: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        return sorted(got, key=repr)

    assert follow() == [(0, 1, "a", None), (0, 2, "b", None), (0, 3, "c", 7)] and follow() == []
    t.append(frame(spark, [(4, "d", None)], "k long, v string, w int"))
    assert follow() == [(0, 4, "d", None)]


def test_messages_travel(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, ["v"])
    t.commit(CommitMessage.from_json(t.write(frame(spark, [(1, "a")])).to_json()))
    assert rows(t.scan()) == [(1, "a")]


def test_blobs_by_reference(spark, tmp_path):
    from tidelake.functions import blobs

    (tmp_path / "x").write_bytes(b"0123456789")
    df = spark.createDataFrame([(1, 2, 3), (2, 5, -1), (3, None, None)], "k int, a long, n long").withColumn("b", blobs.descriptor(F.when(F.col("a").isNotNull(), F.lit(f"file://{tmp_path}/x")), F.col("a"), F.col("n")))
    assert [r["b"] for r in blobs.fetched(df.select("k", "b"), "b").orderBy("k").collect()] == [b"234", b"56789", None]
    with pytest.raises(Exception, match="ends before"):
        blobs.fetched(df.select("k", F.when(F.col("b").isNotNull(), F.col("b").withField("length", F.lit(99).cast("long"))).alias("b")), "b").collect()


@pytest.mark.parametrize("options", [{"ignore-delete": "true"}, {}, {"partial-update.remove-record-on-sequence-group": "ga"}])
def test_any_columns_of_sequence_groups_read_alike(spark, cat, options):
    rng = random.Random(3)
    t = cat.create_table("db.t", {"k": "BIGINT", "ga": "INT", "a": "INT", "gb": "INT", "b": "INT", "c": "STRING"}, [], ["k"],
                         {"bucket": "1", "merge-engine": "partial-update", "fields.ga.sequence-group": "a", "fields.gb.sequence-group": "b", "fields.b.aggregate-function": "sum", **options})
    some = lambda *xs: rng.choice([None, *xs])
    for _ in range(2):
        t.append(frame(spark, [(rng.randrange(6), some(1, 2, 3), some(5, 6), some(1, 2, 3), some(7, 8), some("x", "y"), rng.choice([0, 0, 2, 3])) for _ in range(30)], "k long, ga int, a int, gb int, b int, c string, _VALUE_KIND int"))
    full = t.scan()
    for cols in (["k", "a"], ["b"], ["c", "k"], ["gb", "a"], ["k"]):
        assert rows(t.scan(cols)) == rows(full.select(cols))


def same_names(t):
    """That files of several partitions or buckets share a name, which these tests are about."""
    names = [e.file.name for e in t.meta.entries(t.meta.latest())]
    return len(set(names)) < len(names)


@pytest.mark.parametrize("keys, options", [(["v"], {}), ([], {"bucket": "4", "bucket-key": "k"}), (["v"], {"bucket": "2", "bucket-key": "k"})])
def test_deletions_stay_in_their_file(spark, cat, keys, options):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, keys, options={"deletion-vectors.enabled": "true", **options})
    data = [(i, ["a", "b c", "b", "+", "%", "/", "é"][i % 7]) for i in range(42)]
    t.append(frame(spark, data).coalesce(1))
    assert same_names(t)
    gone = p.eq("v", "a") | p.eq("k", 7) | p.eq("v", "/") | p.lt("k", 0)
    assert t.delete_rows(gone) == 12 and t.delete_rows(gone) == 0 and t.delete_rows(p.eq("k", 6)) == 1
    want = [r for r in data if r[1] not in "a/" and r[0] != 6]
    assert rows(t.scan()) == sorted(want, key=repr) and sum(r["is_deleted"] for r in t.is_deleted(t.positions()).collect()) == 13
    some = t.positions().filter("k = 1").select("_file", "_at")
    assert t.mark_deleted(some.union(some)) == 1 and t.mark_deleted(some) == 0 and len(rows(t.scan())) == len(want) - 1


def test_row_ids_of_partitions(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING", "w": "INT"}, ["v"], options={"row-tracking.enabled": "true", "data-evolution.enabled": "true"})
    t.append(frame(spark, [(i, "abc"[i % 3], 0) for i in range(6)], "k long, v string, w int").coalesce(1))
    t.append(frame(spark, [(i, "abc"[i % 3], 0) for i in range(6, 12)], "k long, v string, w int").coalesce(1))
    assert same_names(t)
    ids = {r["k"]: r["_ROW_ID"] for r in t.scan(["k", "_ROW_ID"]).collect()}
    assert sorted(ids.values()) == list(range(12))
    t.commit(t.write(frame(spark, [(ids[k], 10 + k) for k in (0, 1, 2, 8, 11)], "_ROW_ID long, w int"), columns=["w"]))
    assert {r["k"]: r["w"] for r in t.scan().collect()} == {k: 10 + k if k in (0, 1, 2, 8, 11) else 0 for k in range(12)}
    assert {r["k"] for r in t.scan(partitions=[{"v": "c"}]).collect()} == {2, 5, 8, 11} and {r["w"] for r in t.scan(partitions=[{"v": "b"}]).collect()} == {0, 11}
    t.drop_partitions([{"v": "c"}])
    assert sorted(r["k"] for r in t.scan().collect()) == [0, 1, 3, 4, 6, 7, 9, 10] and all(e.partition != ("c",) for e in t.meta.entries(t.meta.latest()))
    for w in (p.eq("w", 0), p.ge("k", 6), p.eq("w", 11)):
        assert rows(t.scan(where=w)) == rows(t.scan().filter(w.column()))


def test_adopted_files_of_one_name(spark, cat, tmp_path):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, options={"deletion-vectors.enabled": "true"})
    paths = []
    for i in range(2):
        frame(spark, [(5 * i + j, "x") for j in range(5)]).coalesce(1).write.parquet(f"file://{tmp_path}/{i}")
        (name,) = [f for f, _, _ in cat.store.files(f"file://{tmp_path}/{i}") if f.endswith(".parquet")]
        cat.store.rename(f"file://{tmp_path}/{i}/{name}", f"file://{tmp_path}/{i}/x.parquet")
        paths.append(f"file://{tmp_path}/{i}/x.parquet")
    t.adopt(paths[:1])
    t.adopt(paths[1:], move=False)
    assert t.delete_rows(p.eq("k", 1)) == 1 and t.delete_rows(p.eq("k", 8)) == 1
    assert sorted(r["k"] for r in t.scan().collect()) == [0, 2, 3, 4, 5, 6, 7, 9]


def test_external_files_and_their_deletions(spark, cat, tmp_path):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, ["v"], options={"deletion-vectors.enabled": "true", "data-file.external-paths": f"file://{tmp_path}/e1", "data-file.external-paths.strategy": "round-robin"})
    t.append(frame(spark, [(i, "ab"[i % 2]) for i in range(6)]).coalesce(1))
    assert t.delete_rows(p.eq("v", "a")) == 3 and sorted(r["k"] for r in t.scan().collect()) == [1, 3, 5]


def test_sequence_numbers_last(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, [], ["k"], {"bucket": "1"})
    for i in range(3):
        t.append(frame(spark, [(j, f"{i}") for j in range(8)]).repartition(8))
    per_load = max(e.file.max_seq for e in t.meta.entries(t.meta.latest())) / 3
    assert per_load < 2**30 and per_load / 8 * 100_000 * 10_000 < 2**56  # 10,000 loads of 100,000 partitions
    t.compact()
    assert max(e.file.max_seq for e in t.meta.entries(t.meta.latest())) == 0
    t.append(frame(spark, [(0, "new")]))
    assert len(t.scan().filter("v = '2'").collect()) == 7 and t.scan().filter("v = 'new'").count() == 1


def test_manifests_roll_and_still_prune(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, ["v"], options={"manifest.merge-min-count": "4", "manifest.target-file-size": "4kb", "manifest.full-compaction-threshold-size": "6kb"})
    for i in range(12):
        t.append(frame(spark, [(10 * i + j, f"p{j}") for j in range(5)]))
        if i % 4 == 3:
            t.overwrite(t.write(frame(spark, [(1000 + i, "p1")])), [{"v": "p1"}])
        own = t.meta.read_list(t.meta.latest().base)
        assert all(m["size"] <= 4096 for m in own) and len(own) <= 16
    want = [(10 * i + j, f"p{j}") for i in range(12) for j in range(5) if j != 1] + [(1011, "p1")]
    assert rows(t.scan()) == sorted(want, key=repr)
    latest, read = t.meta.latest(), []
    fresh = cat.table("db.t")
    load = fresh.meta.read_manifest
    fresh.meta.read_manifest = lambda name: read.append(name) or load(name)
    assert fresh.scan(partitions=[{"v": "p4"}]).count() == 12
    assert len(set(read)) < len(t.meta.read_list(latest.base)) + len(t.meta.read_list(latest.delta))


@pytest.mark.parametrize("seed", range(3))
def test_value_indexes_answer_every_condition(spark, cat, seed):
    from tests.test_planning import random_predicate

    rng = random.Random(100 + seed)
    t = cat.create_table("db.t", {"a": "INT", "b": "INT"}, options={"file-index.bitmap.columns": "a,b"})
    for _ in range(4):
        t.append(frame(spark, [(rng.choice([None, *range(6)]), rng.choice([None, *range(6)])) for _ in range(2)], "a int, b int").coalesce(1))
    for _ in range(15):
        w = random_predicate(rng)
        assert rows(t.scan(where=w)) == rows(t.scan().filter(w.column()))
    u = cat.create_table("db.u", {"a": "STRING", "b": "INT"}, options={"file-index.bitmap.columns": "a"})
    for values in ("abc", "ab", "a", "xz"):
        u.append(frame(spark, [(c, 1) for c in values], "a string, b int").coalesce(1))
    files = lambda w: len(u.plan(where=w).entries)
    assert files(p.not_in("a", ["a", "b"])) == 2 and files(p.ne("a", "a")) == 3 and files(p.eq("a", "y")) == 0 and files(p.is_not_null("a") & p.eq("b", 1)) == 4
    assert files(p.eq("a", "b") | p.eq("a", "z")) == 3 and files((p.eq("a", "c") | p.eq("b", 7)) & p.is_not_null("a")) == 1


def test_a_value_index_of_many_values_is_many_tasks(spark, cat):
    t = cat.create_table("db.t", {"a": "INT", "b": "STRING"}, options={"file-index.bitmap.columns": "a,b"})
    with_all = [(None if i % 50 == 0 else i, "xy"[i % 2]) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the tables are small
    try:
        t.append(frame(spark, with_all, "a int, b string").repartition(2))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    entries = t.meta.entries(t.meta.latest())
    df = spark.read.parquet(t.uri(entries[0].file.index))
    sizes = [r["count"] for r in df.groupBy(F.col("_metadata.file_name")).count().collect()]
    assert len(sizes) > 1 and max(sizes) < sum(sizes) / 2
    want = {("0", None if a is None else str(a)) for a, _ in with_all} | {("1", b) for _, b in with_all}
    assert len(entries) == 2 and {(r["column"], r["value"]) for r in df.collect()} == want and df.distinct().count() == df.count()
    parts = spark.read.schema("a int, b string").parquet(*(t.uri(e.file.path) for e in entries)).select("*", t.key_column().alias("_file"))
    found = {(r["_file"], r["value"]) for r in df.filter("column = '0'").collect()}
    assert found == {(r["_file"], None if r["a"] is None else str(r["a"])) for r in parts.collect()}
    assert rows(t.scan(where=p.eq("a", 7) | p.is_null("a"))) == rows(t.scan().filter("a = 7 or a is null"))
    assert len(t.plan(where=p.eq("a", 7)).entries) == 1 and t.plan(where=p.eq("b", "z")).entries == []


def test_global_index_reads_only_files_that_are_hit(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, ["v"], options={"row-tracking.enabled": "true"})
    for i in range(5):
        t.append(frame(spark, [(10 * i + j, "ab"[j % 2]) for j in range(6)]).coalesce(1))
    indexes.build_global(t, "k")
    found = indexes.evaluate(t, p.isin("k", [0, 1, 41]))
    assert rows(t.scan(["k"], index=found)) == [(0,), (1,), (41,)] and sum(r.count for r in found.ranges) == 9
    assert indexes.evaluate(t, p.eq("k", 999)).ranges == [] and t.scan(index=indexes.evaluate(t, p.eq("k", 999))).count() == 0


def test_orc_tables(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING", "w": "DOUBLE"}, ["v"], options={"file.format": "orc"})
    for i in range(2):
        t.append(frame(spark, [(10 * i + j, "ab"[j % 2], j / 2) for j in range(4)], "k long, v string, w double"))
    t.alter(("rename", "w", "x"), ("add", "y", "INT"))
    assert rows(t.scan(["k", "x"], where=p.gt("k", 9) & p.eq("v", "a"))) == [(10, 0.0), (12, 1.0)] and len(t.plan(where=p.gt("k", 9)).entries) == 2
    u = cat.create_table("db.u", {"k": "BIGINT", "v": "STRING"}, [], ["k"], {"bucket": "2", "file.format": "orc"})
    u.append(frame(spark, [(1, "a"), (2, "a")]))
    u.append(frame(spark, [(1, "b")]))
    assert rows(u.scan()) == [(1, "b"), (2, "a")]
    with pytest.raises(ValueError, match="parquet"):
        cat.create_table("db.x", {"k": "BIGINT"}, options={"file.format": "orc", "row-tracking.enabled": "true"})


@pytest.mark.parametrize("kind", ["orc", "parquet"])
def test_statistics_of_counted_files_sort_no_rows(spark, tmp_path, monkeypatch, kind):
    from tidelake.sources.files import counted

    data = [[(None if i % 7 == 0 else i * (-1) ** n, f"v{(i * 37) % 100}" if n else None, i / 4, i % 2 == 0) for i in range(50)] for n in range(3)]
    files = []
    for n, part in enumerate(data):
        at = tmp_path / f"a +%41 b{n}"
        frame(spark, part, "k int, v string, w double, x boolean").coalesce(1).write.format(kind).save(f"file://{at}")
        files += [f"file://{x}" for x in at.glob(f"part-*.{kind}")]
    plans, frames = [], type(spark.range(1))
    collect = frames.collect
    monkeypatch.setattr(frames, "collect", lambda df: (collect(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    got = counted(spark, files)
    monkeypatch.undo()
    assert len(plans) == 1 and "SortAggregate" not in plans[0] and "Sort [" not in plans[0]
    for told, part in zip(got, data, strict=True):
        assert told["rows"] == 50
        for c, values in zip("kvwx", zip(*part)):
            known = [v for v in values if v is not None]
            assert told["stats"][c] == [min(known, default=None), max(known, default=None), 50 - len(known)]


def test_a_table_changes_its_format(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"})
    t.append(frame(spark, [(1, "a")]))
    t.alter(("set", "file.format", "orc"))
    t.append(frame(spark, [(2, "b")]))
    assert {e.file.kind for e in t.meta.entries(t.meta.latest())} == {"parquet", "orc"} and rows(t.scan()) == [(1, "a"), (2, "b")]


def test_level_0_waits_where_deletions_are_by_position(spark, cat):
    t = cat.create_table("db.t", {"k": "BIGINT", "v": "STRING"}, [], ["k"], {"bucket": "2", "deletion-vectors.enabled": "true"})
    t.append(frame(spark, [(i, "old") for i in range(6)]))
    assert t.scan().count() == 0 and t.scan(levels=lambda n: True).count() == 6
    t.compact()
    assert t.delete_rows(p.lt("k", 2)) == 2 and sorted(r["k"] for r in t.scan().collect()) == [2, 3, 4, 5]
    t.append(frame(spark, [(1, "new"), (2, "new")]))
    assert sorted(r["k"] for r in t.scan().collect()) == [2, 3, 4, 5]
    t.compact()
    assert rows(t.scan()) == [(1, "new"), (2, "new"), (3, "old"), (4, "old"), (5, "old")] and not t.meta.read_index(t.meta.latest().index)
    u = cat.create_table("db.u", {"k": "BIGINT", "v": "STRING"}, [], ["k"], {"bucket": "1", "merge-engine": "first-row"})
    u.append(frame(spark, [(1, "a")]))
    u.append(frame(spark, [(1, "b"), (2, "c")]))
    assert u.scan().count() == 0
    u.compact()
    u.append(frame(spark, [(3, "d")]))
    assert rows(u.scan()) == [(1, "a"), (2, "c")]


def test_footers_by_reading(spark, tmp_path):
    from tidelake.sources.files import counted, footers

    spark.createDataFrame([(1, "a b", None, 1.5), (5, "é", None, None)], "k int, `v.w` string, n string, d double").coalesce(1).write.partitionBy("k").parquet(f"file://{tmp_path}/x y")
    paths = sorted(f"file://{tmp_path}/x y/{k.relative_to(tmp_path / 'x y')}" for k in (tmp_path / "x y").rglob("*.parquet"))
    told = counted(spark, paths)
    assert [t["rows"] for t in told] == [1, 1] and told[0]["stats"]["d"] == [1.5, 1.5, 0] and told[1]["stats"]["n"] == [None, None, 1] and [t["rows"] for t in footers(spark, paths)] == [1, 1]
