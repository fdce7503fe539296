"""Queries over the test tables, one or more for each operator of the table engine, with the SQL that says the same.

Row kinds come from the event type: error is -D, signup and view are +I, click and purchase are +U. Records of a key are
ordered by (ts, event_id). Tables are built in a new warehouse folder for each query.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.casts import cast
from .functions.predicates import Builder as p
from .operators import merge as M
from .operators.vector import SCORE, top_k
from .plans import indexes
from .plans import ranges as R
from .plans.store import Store
from .sources.catalog import Catalog
from .streaming.incremental import Follower

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession) -> Catalog:
    """A new warehouse below the shared folder, or this machine's own where none is set; it goes when the JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{root.rstrip('/')}/tidelake-warehouse-{uuid.uuid4().hex}"
    fs, at = Store(spark)._at(path)
    fs.deleteOnExit(at)
    out = Catalog(spark, path)
    out.create_database("db")
    return out


KINDS = "CASE WHEN event_type = 'error' THEN 3 WHEN event_type IN ('click', 'purchase') THEN 2 ELSE 0 END"


def records(spark: SparkSession, sf_dir: str, *values: str) -> DataFrame:
    """Events as versions of a user: sequence field ts (microseconds), sequence number event_id."""
    return read(spark, sf_dir, "events").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) AS t", *values, "event_id AS _SEQUENCE_NUMBER", f"cast({KINDS} AS tinyint) AS _VALUE_KIND")


EV = f"SELECT *, epoch_us(ts) AS t, {KINDS} AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn_last, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn_first, count(*) OVER (PARTITION BY user_id) AS n FROM events"


@query(f"SELECT user_id, CAST(t AS BIGINT) AS t, CAST(value AS DOUBLE) AS value, CAST(event_type AS VARCHAR) AS event_type FROM ({EV}) WHERE rn_last = 1 AND k NOT IN (1, 3)")
def merge_deduplicate(spark, sf_dir):
    """O-40, O-39, O-46: the last record of a user; a retraction hides the user."""
    return M.merge(records(spark, sf_dir, "value", "event_type"), M.MergeSpec(["user_id"], "deduplicate", ["t"]))


@query(f"""SELECT user_id, CAST(t AS BIGINT) AS t, CAST(value AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ({EV}) WHERE k NOT IN (1, 3)) WHERE r = 1""")
def merge_deduplicate_ignore_delete(spark, sf_dir):
    """O-40 with ignore-delete."""
    return M.merge(records(spark, sf_dir, "value"), M.MergeSpec(["user_id"], "deduplicate", ["t"], ignore_delete=True))


@query("""SELECT user_id, CAST(event_type AS VARCHAR) AS event_type, CAST(value AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC NULLS FIRST, event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id DESC) AS last FROM events) WHERE last = 1""")
def merge_deduplicate_descending(spark, sf_dir):
    """O-40 with a descending sequence field of a type without a negative: the least event type, latest arrival."""
    df = read(spark, sf_dir, "events").selectExpr("user_id", "event_type", "value", "event_id AS _SEQUENCE_NUMBER", "cast(0 AS tinyint) AS _VALUE_KIND")
    return M.merge(df, M.MergeSpec(["user_id"], "deduplicate", ["event_type"], descending=True)).select("user_id", "event_type", "value")


@query("SELECT o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def merge_first_row(spark, sf_dir):
    """O-41: the first order of a customer."""
    df = read(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "o_totalprice", "unix_micros(cast(o_orderdate as timestamp)) AS d", "o_orderkey AS _SEQUENCE_NUMBER", "cast(0 AS tinyint) AS _VALUE_KIND")
    return M.merge(df, M.MergeSpec(["o_custkey"], "first-row", ["d"])).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""SELECT user_id, CAST(sum(CASE WHEN k IN (1, 3) THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM ({EV}) GROUP BY user_id HAVING NOT (count(*) = 1 AND max(k) IN (1, 3))""")
def merge_sum_retract(spark, sf_dir):
    """O-42, O-47, O-46: sums with retractions; a lone retraction hides its user."""
    return M.merge(records(spark, sf_dir, "cast(round(value * 100) AS bigint) AS cents"), M.MergeSpec(["user_id"], "aggregation", ["t"], aggregates={"cents": "sum"})).select("user_id", "cents")


NULLED = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


@query(f"""SELECT user_id, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS greatest, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS cents, bool_and(v > 10) AS all_over, bool_or(v > 90) AS any_over,
  CAST(arg_max_null(v, (t, event_id)) AS DOUBLE) AS last, CAST(arg_max(v, (t, event_id)) AS DOUBLE) AS last_known, CAST(arg_min_null(v, (t, event_id)) AS DOUBLE) AS first, CAST(arg_min(v, (t, event_id)) AS DOUBLE) AS first_known
  FROM (SELECT *, {NULLED} AS v, epoch_us(ts) AS t FROM events WHERE event_type <> 'error') GROUP BY user_id""")
def merge_aggregates(spark, sf_dir):
    """O-47 to O-56: every aggregate function on one key."""
    df = records(spark, sf_dir, f"{NULLED} AS v").filter("_VALUE_KIND <> 3")
    df = df.selectExpr("user_id", "t", "v AS least", "v AS greatest", "cast(round(v * 100) AS bigint) AS cents", "v > 10 AS all_over", "v > 90 AS any_over", "v AS last", "v AS last_known", "v AS first", "v AS first_known", "_SEQUENCE_NUMBER", "_VALUE_KIND")
    spec = M.MergeSpec(["user_id"], "aggregation", ["t"], aggregates={"least": "min", "greatest": "max", "cents": "sum", "all_over": "bool_and", "any_over": "bool_or", "last": "last_value", "last_known": "last_non_null_value", "first": "first_value", "first_known": "first_non_null_value"})
    return M.merge(df, spec).drop("t")


@query(f"""SELECT user_id, CAST(max(CASE WHEN k <> 3 THEN value END) AS DOUBLE) AS greatest, CAST(arg_max_null(CASE WHEN k <> 3 THEN value END, (t, event_id)) AS DOUBLE) AS last FROM ({EV}) GROUP BY user_id HAVING NOT (count(*) = 1 AND max(k) = 3)""")
def merge_ignore_retract(spark, sf_dir):
    """O-57: a column that ignores retractions next to one that is emptied by them."""
    spec = M.MergeSpec(["user_id"], "aggregation", ["t"], aggregates={"greatest": "max", "last": "last_value"}, ignore_retract={"greatest"})
    return M.merge(records(spark, sf_dir, "value AS greatest", "value AS last"), spec).drop("t")


@query(f"""SELECT user_id, CAST(arg_max(v, (t, event_id)) AS DOUBLE) AS v, CAST(arg_max(e, (t, event_id)) AS VARCHAR) AS e FROM (SELECT *, {NULLED} AS v, CASE WHEN event_id % 2 = 0 THEN event_type END AS e, epoch_us(ts) AS t FROM events) WHERE event_type <> 'error' GROUP BY user_id""")
def merge_partial_update(spark, sf_dir):
    """O-43 with ignore-delete: the last known value of each column."""
    df = records(spark, sf_dir, f"{NULLED} AS v", "CASE WHEN event_id % 2 = 0 THEN event_type END AS e")
    return M.merge(df, M.MergeSpec(["user_id"], "partial-update", ["t"], ignore_delete=True)).select("user_id", "v", "e")


@query(f"""WITH e AS ({EV}), d AS (SELECT user_id, max((t, event_id)) AS gone FROM e WHERE k = 3 GROUP BY user_id)
SELECT e.user_id, CAST(arg_max({NULLED.replace('event_id', 'e.event_id').replace('value', 'e.value')}, (t, event_id)) AS DOUBLE) AS v FROM e LEFT JOIN d USING (user_id) WHERE gone IS NULL OR (t, event_id) > gone GROUP BY e.user_id""")
def merge_partial_update_remove(spark, sf_dir):
    """O-43 with remove-record-on-delete: a deletion wipes the row, later records start it anew."""
    return M.merge(records(spark, sf_dir, f"{NULLED} AS v"), M.MergeSpec(["user_id"], "partial-update", ["t"], remove_on_delete=True)).select("user_id", "v")


GROUPED = "SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN event_id % 5 <> 0 THEN (event_id * 7919) % 1000 END AS ga, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 4 <> 0 THEN (event_id * 104729) % 1000 END AS gb, CAST(round(value * 100) AS BIGINT) AS b, event_type AS c FROM events"


def grouped(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("user_id", "CASE WHEN event_id % 5 <> 0 THEN (event_id * 7919) % 1000 END AS ga", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a",
                                                    "CASE WHEN event_id % 4 <> 0 THEN (event_id * 104729) % 1000 END AS gb", "cast(round(value * 100) AS bigint) AS b", "event_type AS c", "event_id AS _SEQUENCE_NUMBER", "cast(0 AS tinyint) AS _VALUE_KIND")


GROUP_SPEC = {"groups": {("ga",): ["a"], ("gb",): ["b"]}, "aggregates": {"b": "sum"}}
GROUP_SQL = f"""WITH g AS ({GROUPED}) SELECT user_id, CAST(arg_max(ga, (ga, event_id)) FILTER (WHERE ga IS NOT NULL) AS BIGINT) AS ga, CAST(arg_max_null(a, (ga, event_id)) FILTER (WHERE ga IS NOT NULL) AS DOUBLE) AS a,
  CAST(max(gb) AS BIGINT) AS gb, CAST(sum(b) FILTER (WHERE gb IS NOT NULL) AS BIGINT) AS b, CAST(arg_max(c, event_id) AS VARCHAR) AS c FROM g GROUP BY user_id"""


@query(GROUP_SQL)
def merge_sequence_groups(spark, sf_dir):
    """O-44 in one aggregation: the newest of each column group by its own sequence, a sum over another."""
    return M.merge(grouped(spark, sf_dir), M.MergeSpec(["user_id"], "partial-update", insert_only=True, **GROUP_SPEC))


@query(GROUP_SQL)
def merge_sequence_groups_fold(spark, sf_dir):
    """O-44, O-45: the same by the ordered fold."""
    return M.merge(grouped(spark, sf_dir), M.MergeSpec(["user_id"], "partial-update", **GROUP_SPEC))


@query(f"""WITH l AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS lv FROM ({EV})), u AS (SELECT user_id, max(event_id) AS top FROM l WHERE lv > 0 GROUP BY user_id)
SELECT l.user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM l LEFT JOIN u USING (user_id) WHERE lv = 0 OR event_id = top GROUP BY l.user_id""")
def merge_lookup(spark, sf_dir):
    """O-46b: level 0 and the newest record above it."""
    df = read(spark, sf_dir, "events").selectExpr("user_id", "cast(round(value * 100) AS bigint) AS cents", "event_id AS _SEQUENCE_NUMBER", "cast(0 AS tinyint) AS _VALUE_KIND", "cast(CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS int) AS _LEVEL")
    return M.merge(df, M.MergeSpec(["user_id"], "aggregation", aggregates={"cents": "sum"}, lookup=True))


ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING"
ORDER_COLUMNS = [x.split()[0] for x in ORDERS.split(", ")]


def orders_table(spark, sf_dir, commits: int = 2, partitioned: bool = False, options: dict | None = None, tasks: int | None = None):
    """Orders in an append table, one commit for each remainder of the key. tasks: 1 gives files of all partitions one name."""
    cat = catalog(spark)
    t = cat.create_table("db.orders", {x.split()[0]: x.split()[1] for x in ORDERS.split(", ")}, ["o_orderstatus"] if partitioned else [], options=options)
    src = read(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    for i in range(commits):
        part = src.filter(F.col("o_orderkey") % commits == i)
        t.append(part.coalesce(tasks) if tasks else part, identifier=i + 1)
    return t


OUT = "CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderstatus AS VARCHAR) AS o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_orderpriority AS VARCHAR) AS o_orderpriority"


@query(f"SELECT {OUT} FROM orders")
def scan_latest(spark, sf_dir):
    """O-03, O-10, O-18, O-120, O-126: two commits, all rows."""
    return orders_table(spark, sf_dir).scan()


@query(f"SELECT {OUT} FROM orders WHERE o_orderkey % 2 = 0")
def scan_time_travel(spark, sf_dir):
    """O-11, O-17: the first of two snapshots."""
    return orders_table(spark, sf_dir).scan(options={"scan.snapshot-id": "1"})


@query("SELECT CAST(0 AS TINYINT) AS kind, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderkey % 2 = 1")
def scan_delta(spark, sf_dir):
    """O-14, O-16, O-37: what the second snapshot added."""
    t = orders_table(spark, sf_dir)
    (_, df), = list(Follower(t, {"scan.mode": "from-snapshot", "scan.snapshot-id": "2"}))
    return df.select(F.col("_VALUE_KIND").alias("kind"), "o_orderkey", "o_totalprice")


@query("SELECT CAST(1 + o_orderkey % 3 AS BIGINT) AS snapshot, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def stream_full_then_changes(spark, sf_dir):
    """O-12, O-15: all of the first snapshot, then each change."""
    t = orders_table(spark, sf_dir, 3)
    parts = [df.select(F.lit(i).cast("long").alias("snapshot"), "o_orderkey") for i, df in Follower(t, {"scan.mode": "from-snapshot-full", "scan.snapshot-id": "1"})]
    out = parts[0].union(parts[1]).union(parts[2])
    return out.groupBy("snapshot").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"SELECT {OUT} FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 150000")
def scan_partitions_and_predicate(spark, sf_dir):
    """O-19, O-22, O-32, O-81: a list of partitions and a predicate that prunes and filters."""
    t = orders_table(spark, sf_dir, partitioned=True)
    return t.scan(where=p.gt("o_totalprice", 150000.0), partitions=[{"o_orderstatus": "F"}, {"o_orderstatus": "P"}])


def leaf(name: str, make, sql: str):
    def run(spark, sf_dir):
        df = read(spark, sf_dir, "events").selectExpr("event_id", f"{NULLED} AS v", "event_type AS e")
        return df.filter(make().column()).select(F.col("event_id").cast("long").alias("event_id"))

    run.__name__ = name
    run.__doc__ = "O-81: one predicate."
    query(f"SELECT CAST(event_id AS BIGINT) AS event_id FROM (SELECT event_id, {NULLED} AS v, event_type AS e FROM events) WHERE {sql}")(run)


for _name, _make, _sql in (
    ("predicate_equal", lambda: p.eq("e", "click"), "e = 'click'"), ("predicate_not_equal", lambda: p.ne("e", "click"), "e <> 'click'"), ("predicate_less", lambda: p.lt("v", 50.0), "v < 50"),
    ("predicate_less_or_equal", lambda: p.le("v", 50.0), "v <= 50"), ("predicate_greater", lambda: p.gt("v", 50.0), "v > 50"), ("predicate_greater_or_equal", lambda: p.ge("v", 50.0), "v >= 50"),
    ("predicate_is_null", lambda: p.is_null("v"), "v IS NULL"), ("predicate_is_not_null", lambda: p.is_not_null("v"), "v IS NOT NULL"), ("predicate_in", lambda: p.isin("e", ["click", None, "view"]), "e IN ('click', 'view')"),
    ("predicate_not_in", lambda: p.not_in("e", ["click", "view"]), "e NOT IN ('click', 'view')"), ("predicate_not_in_null", lambda: p.not_in("e", ["click", None]), "FALSE"), ("predicate_between", lambda: p.between("v", 10.0, 20.0), "v BETWEEN 10 AND 20"),
    ("predicate_and_or", lambda: (p.eq("e", "click") & p.lt("v", 30.0)) | p.is_null("v"), "(e = 'click' AND v < 30) OR v IS NULL"),
    ("predicate_negate", lambda: ~((p.eq("e", "click") & p.lt("v", 30.0)) | p.is_null("v")), "NOT ((e = 'click' AND v < 30) OR v IS NULL) AND ((e <> 'click') OR (v >= 30)) AND v IS NOT NULL"),
):
    leaf(_name, _make, _sql)


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(length(o_orderpriority) AS INTEGER) END AS prio_len, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice FROM orders")
def schema_evolution(spark, sf_dir):
    """O-38, O-90 to O-112: a column renamed and cast, one added, one dropped, between two commits."""
    cat = catalog(spark)
    t = cat.create_table("db.t", {"o_orderkey": "INT", "o_custkey": "BIGINT", "o_totalprice": "DOUBLE", "gone": "STRING"})
    src = read(spark, sf_dir, "orders")
    t.append(src.filter("o_orderkey % 2 = 0").selectExpr("cast(o_orderkey as int) AS o_orderkey", "o_custkey", "o_totalprice", "'x' AS gone"))
    t.alter(("rename", "o_custkey", "customer"), ("type", "customer", "STRING"), ("type", "o_orderkey", "BIGINT"), ("type", "o_totalprice", "BIGINT"), ("drop", "gone"), ("add", "prio_len", "INT"))
    t.append(src.filter("o_orderkey % 2 = 1").selectExpr("o_orderkey", "cast(o_custkey as string) AS customer", "cast(o_totalprice as bigint) AS o_totalprice", "length(o_orderpriority) AS prio_len"))
    return t.scan(columns=["o_orderkey", "customer", "prio_len", "o_totalprice"])


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, CAST((event_id + 128) % 256 - 128 AS INTEGER) AS to_tinyint, CAST(trunc(value) AS BIGINT) AS to_bigint, value <> 0 AND event_id <> 0 AS to_boolean, CAST(event_id % 2 AS INTEGER) AS from_boolean,
CAST(CASE WHEN value < 100 THEN round(CAST(value AS DECIMAL(38,10)), 1) END AS DOUBLE) AS to_decimal, CAST(event_id * 86400 AS BIGINT) AS seconds, CAST(event_id AS VARCHAR) AS to_string FROM events WHERE value <> 0""")
def casts(spark, sf_dir):
    """O-90 to O-111: wrapping, truncating, overflow to null, booleans, timestamps and back, text."""
    df = read(spark, sf_dir, "events").filter("value <> 0")
    of = lambda c, a, b: cast(c if not isinstance(c, str) else F.col(c), a, b)
    long, double, boolean = T.LongType(), T.DoubleType(), T.BooleanType()
    stamp = of(F.col("event_id") * 86400, long, T.TimestampNTZType())
    decimal = T.DecimalType(38, 10)
    return df.select("event_id", of("event_id", long, T.ByteType()).cast("int").alias("to_tinyint"), of("value", double, long).alias("to_bigint"), of("event_id", long, boolean).alias("to_boolean"),
                     of(F.col("event_id") % 2 == 1, boolean, T.IntegerType()).alias("from_boolean"), of(of("value", double, decimal), decimal, T.DecimalType(3, 1)).cast("double").alias("to_decimal"),
                     of(stamp, T.TimestampNTZType(), long).alias("seconds"), of("event_id", long, T.StringType()).alias("to_string"))


@query(f"SELECT {OUT} FROM orders WHERE NOT (o_custkey < 200 OR o_totalprice >= 300000)")
def deletion_vectors(spark, sf_dir):
    """O-60 to O-63: rows deleted by position, twice, in files that stay."""
    t = orders_table(spark, sf_dir, options={"deletion-vectors.enabled": "true"})
    t.delete_rows(p.lt("o_custkey", 200))
    t.delete_rows(p.lt("o_custkey", 200) | p.ge("o_totalprice", 300000.0))
    return t.scan()


KEPT = f"SELECT {OUT} FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0 OR o_totalprice >= 300000 OR o_custkey < 100)"


def some_deleted(spark, sf_dir, t):
    """Deletes rows of one partition by their positions, and rows of all partitions by a predicate."""
    t.mark_deleted(t.positions().filter("o_orderstatus = 'F' AND o_custkey % 2 = 0").select("_file", "_at"))
    t.delete_rows(p.ge("o_totalprice", 300000.0) | p.lt("o_custkey", 100))
    return t.scan()


@query(KEPT)
def deletion_vectors_partitioned(spark, sf_dir):
    """O-60 to O-63 where files of several partitions share a name."""
    return some_deleted(spark, sf_dir, orders_table(spark, sf_dir, partitioned=True, options={"deletion-vectors.enabled": "true"}, tasks=1))


@query(KEPT)
def deletion_vectors_bucketed(spark, sf_dir):
    """O-60 to O-63 where files of several buckets share a name."""
    return some_deleted(spark, sf_dir, orders_table(spark, sf_dir, options={"deletion-vectors.enabled": "true", "bucket": "4", "bucket-key": "o_orderkey"}, tasks=1))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN d % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS deleted FROM (SELECT o_orderkey AS d FROM orders)")
def checked_delete(spark, sf_dir):
    """O-63: which positions are deleted, after the same ones were deleted twice."""
    t = orders_table(spark, sf_dir, partitioned=True, options={"deletion-vectors.enabled": "true"}, tasks=1)
    for _ in range(2):
        t.mark_deleted(t.positions().filter("o_orderkey % 3 = 0").select("_file", "_at"))
    return t.is_deleted(t.positions().select("_file", "_at")).agg(F.count("*").alias("n"), F.count_if("is_deleted").alias("deleted"))


def evolution_table(spark, sf_dir, options: dict | None = None):
    cat = catalog(spark)
    t = cat.create_table("db.t", {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "note": "STRING"}, options={"row-tracking.enabled": "true", "data-evolution.enabled": "true", **(options or {})})
    src = read(spark, sf_dir, "orders")
    for i in range(2):
        t.append(src.filter(F.col("o_orderkey") % 2 == i).selectExpr("o_orderkey", "o_custkey", "'old' AS note"))
    return t


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CASE WHEN o_custkey % 10 = 3 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS note, CAST(CASE WHEN o_custkey % 10 = 3 THEN 4 WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS seq FROM orders")
def data_evolution(spark, sf_dir):
    """O-70 to O-73, O-76, O-79: a column written again for some rows, twice; a newer null is a null."""
    t = evolution_table(spark, sf_dir)
    rows = t.scan(columns=["_ROW_ID", "o_orderkey", "o_custkey"])
    t.commit(t.write(rows.filter("o_orderkey % 2 = 0").selectExpr("_ROW_ID", "'new' AS note"), columns=["note"]))
    t.commit(t.write(rows.filter("o_custkey % 10 = 3").selectExpr("_ROW_ID", "cast(null AS string) AS note"), columns=["note"]))
    return t.scan(columns=["o_orderkey", "o_custkey", "note", "_SEQUENCE_NUMBER"]).withColumnRenamed("_SEQUENCE_NUMBER", "seq")


def evolution_by_status(spark, sf_dir):
    """The same in partitions, with files of one name."""
    t = catalog(spark).create_table("db.t", {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "status": "STRING", "note": "STRING"}, ["status"], options={"row-tracking.enabled": "true", "data-evolution.enabled": "true"})
    src = read(spark, sf_dir, "orders")
    for i in range(2):
        t.append(src.filter(F.col("o_orderkey") % 2 == i).selectExpr("o_orderkey", "o_custkey", "o_orderstatus AS status", "'old' AS note").coalesce(1))
    return t


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS ids, CAST(0 AS BIGINT) AS least, CAST(count(*) - 1 AS BIGINT) AS greatest, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def row_tracking_partitioned(spark, sf_dir):
    """O-72, O-73 where files of several partitions share a name: every row has an id of its own."""
    df = evolution_by_status(spark, sf_dir).scan(columns=["_ROW_ID", "o_orderkey"])
    return df.agg(F.count("*").alias("n"), F.count_distinct("_ROW_ID").alias("ids"), F.min("_ROW_ID").alias("least"), F.max("_ROW_ID").alias("greatest"), F.sum("o_orderkey").alias("keys"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderstatus AS VARCHAR) AS status, CASE WHEN o_custkey % 10 = 3 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS note FROM orders WHERE o_orderstatus <> 'P'")
def data_evolution_partitioned(spark, sf_dir):
    """O-70, O-74, O-76 where files of several partitions share a name; a partition goes with its later columns."""
    t = evolution_by_status(spark, sf_dir)
    rows = t.scan(columns=["_ROW_ID", "o_orderkey", "o_custkey"])
    t.commit(t.write(rows.filter("o_orderkey % 2 = 0").selectExpr("_ROW_ID", "'new' AS note"), columns=["note"]))
    t.commit(t.write(rows.filter("o_custkey % 10 = 3").selectExpr("_ROW_ID", "cast(null AS string) AS note"), columns=["note"]))
    t.drop_partitions([{"status": "P"}])
    return t.scan()


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(100 AS BIGINT) AS least, CAST(499 AS BIGINT) AS greatest FROM (SELECT 1 FROM orders LIMIT 350)")
def row_ranges(spark, sf_dir):
    """O-72, O-74: row ids within two ranges."""
    t = evolution_table(spark, sf_dir)
    df = t.scan(columns=["_ROW_ID"], row_ranges=[R.Range(100, 349), R.Range(400, 499)])
    return df.agg(F.count("*").alias("n"), F.min("_ROW_ID").alias("least"), F.max("_ROW_ID").alias("greatest"))


@query(f"SELECT {OUT} FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus = 'F'")
def file_bitmap_index(spark, sf_dir):
    """O-82 to O-87: files without the values are skipped, rows are filtered exactly."""
    t = orders_table(spark, sf_dir, options={"file-index.bitmap.columns": "o_orderpriority,o_orderstatus", "file-index.bloom-filter.columns": "o_custkey"})
    return t.scan(where=p.isin("o_orderpriority", ["1-URGENT", "5-LOW"]) & p.eq("o_orderstatus", "F"))


@query(f"SELECT {OUT} FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_custkey <> 7 AND (o_orderstatus > 'F' OR o_orderpriority = '2-HIGH')")
def file_index_not_in(spark, sf_dir):
    """O-82, O-83, O-86, O-88: negated and ordered conditions, AND and OR, by the files' values."""
    t = orders_table(spark, sf_dir, options={"file-index.bitmap.columns": "o_orderpriority,o_orderstatus,o_custkey"})
    return t.scan(where=p.not_in("o_orderpriority", ["1-URGENT", "5-LOW"]) & p.ne("o_custkey", 7) & (p.gt("o_orderstatus", "F") | p.eq("o_orderpriority", "2-HIGH")))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders WHERE o_custkey IN (7, 11, 100) OR o_custkey = 400")
def global_index(spark, sf_dir):
    """O-89a to O-89j: row ids from a table-level index, with a tail that came after it was built."""
    t = evolution_table(spark, sf_dir)
    indexes.build_global(t, "o_custkey")
    found = indexes.evaluate(t, p.isin("o_custkey", [7, 11, 100]) | p.eq("o_custkey", 400))
    return t.scan(columns=["o_orderkey", "o_custkey"], index=found)


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders WHERE o_custkey BETWEEN 40 AND 60 AND o_orderstatus <> 'P'")
def global_index_partitioned(spark, sf_dir):
    """O-89d, e, i: a range by a table-level index; only files that are hit are read, of all partitions but one."""
    t = evolution_by_status(spark, sf_dir)
    indexes.build_global(t, "o_custkey")
    return t.scan(columns=["o_orderkey", "o_custkey"], index=indexes.evaluate(t, p.between("o_custkey", 40, 60)), partitions=[{"status": "F"}, {"status": "O"}])


QUERY_VECTOR = [0.1] * 64


@query("""SELECT CAST(vec_id AS BIGINT) AS vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - 0.1) * (CAST(embedding[i] AS DOUBLE) - 0.1)))), 6) AS score FROM embeddings ORDER BY score, vec_id LIMIT 10""")
def vector_top_k(spark, sf_dir):
    """O-89c, O-80: the ten nearest by l2."""
    df = read(spark, sf_dir, "embeddings")
    return top_k(df, "embedding", QUERY_VECTOR, 10, tie="vec_id").select("vec_id", F.round(SCORE, 6).alias("score"))


@query("""SELECT CAST(vec_id AS BIGINT) AS vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * 0.1)) / (sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE)))) * sqrt(64 * 0.01)), 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY score, vec_id LIMIT 5""")
def vector_top_k_filtered(spark, sf_dir):
    """O-89g: the five nearest by cosine among some labels."""
    df = read(spark, sf_dir, "embeddings").filter(p.isin("label", [1, 2, 3]).column())
    return top_k(df, "embedding", QUERY_VECTOR, 5, "cosine", tie="vec_id").select("vec_id", F.round(SCORE, 6).alias("score"))


@query(f"SELECT {OUT} FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT {OUT} FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0")
def overwrite_partition(spark, sf_dir):
    """O-128, O-130: one partition's rows replaced."""
    t = orders_table(spark, sf_dir, partitioned=True)
    t.overwrite(t.write(read(spark, sf_dir, "orders").select(*ORDER_COLUMNS).filter("o_orderstatus = 'F' AND o_custkey % 2 = 0")), [{"o_orderstatus": "F"}])
    return t.scan()


@query(f"SELECT {OUT} FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def drop_partitions(spark, sf_dir):
    """O-129: two partitions dropped."""
    t = orders_table(spark, sf_dir, partitioned=True)
    t.drop_partitions([{"o_orderstatus": "F"}, {"o_orderstatus": "P"}])
    return t.scan()


@query("SELECT CAST(o_orderstatus AS VARCHAR) AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def partition_listing(spark, sf_dir):
    """O-28, O-168: record counts of partitions, from metadata alone."""
    return orders_table(spark, sf_dir, partitioned=True).partitions().select(F.col("partition")[0].alias("status"), F.col("record_count").alias("n"))


@query(f"SELECT {OUT} FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT {OUT} FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 2 = 0")
def fallback_branch(spark, sf_dir):
    """O-29: partitions that the main branch lacks come from another branch."""
    cat = catalog(spark)
    t = cat.create_table("db.orders", {x.split()[0]: x.split()[1] for x in ORDERS.split(", ")}, ["o_orderstatus"])
    src = read(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    t.create_branch("old").append(src.filter("o_orderkey % 2 = 0"))
    t.append(src.filter("o_orderstatus = 'O'"))
    return t.scan(options={"scan.fallback-branch": "old"})


def keyed_table(spark, sf_dir, engine: str = "deduplicate", options: dict | None = None):
    """Events as a keyed table of users, two commits, with row kinds."""
    cat = catalog(spark)
    t = cat.create_table("db.users", {"user_id": "BIGINT", "t": "BIGINT", "value": "DOUBLE", "event_type": "STRING"}, [], ["user_id"], {"bucket": "4", "merge-engine": engine, "sequence.field": "t", **(options or {})})
    src = records(spark, sf_dir, "value", "event_type")
    for i in range(2):
        t.append(src.filter(F.col("_SEQUENCE_NUMBER") % 2 == i))
    return t


KEYED = f"SELECT user_id, CAST(t AS BIGINT) AS t, CAST(value AS DOUBLE) AS value, CAST(event_type AS VARCHAR) AS event_type FROM ({EV}) WHERE rn_last = 1 AND k NOT IN (1, 3)"


@query(KEYED)
def keyed_scan(spark, sf_dir):
    """O-35, O-121, O-123: a keyed table's rows, versions of two commits merged."""
    return keyed_table(spark, sf_dir).scan()


@query(f"SELECT * FROM ({KEYED}) WHERE value > 50 AND user_id BETWEEN 10 AND 90")
def keyed_scan_predicate(spark, sf_dir):
    """O-35, §4: a condition on values counts after merging, one on keys prunes files before."""
    return keyed_table(spark, sf_dir).scan(where=p.gt("value", 50.0) & p.between("user_id", 10, 90))


@query(KEYED)
def keyed_compacted(spark, sf_dir):
    """O-25, O-34: after a rewrite the table reads without merging."""
    t = keyed_table(spark, sf_dir)
    t.compact()
    return t.scan()


@query(f"SELECT CAST(k AS TINYINT) AS kind, CAST(user_id AS BIGINT) AS user_id, CAST(value AS DOUBLE) AS value FROM ({EV}) WHERE event_id % 2 = 1")
def keyed_changes(spark, sf_dir):
    """O-36: the second commit's records with their kinds, unmerged."""
    return keyed_table(spark, sf_dir).changes(2).select(F.col("_VALUE_KIND").alias("kind"), "user_id", "value")


@query(f"""SELECT user_id, CAST(arg_max(value, (t, event_id)) AS DOUBLE) AS value FROM ({EV}) WHERE k <> 3 GROUP BY user_id""")
def keyed_partial_update(spark, sf_dir):
    """O-43 through a table."""
    return keyed_table(spark, sf_dir, "partial-update", {"ignore-delete": "true"}).scan(columns=["user_id", "value"])


@query(f"SELECT * FROM ({KEYED}) WHERE NOT (value > 80 OR user_id < 20)")
def keyed_deletion_vectors(spark, sf_dir):
    """O-60, O-21: rows of a compacted keyed table deleted by position; what came after waits at level 0."""
    t = keyed_table(spark, sf_dir, options={"deletion-vectors.enabled": "true"})
    t.compact()
    t.delete_rows(p.gt("value", 80.0) | p.lt("user_id", 20))
    t.append(records(spark, sf_dir, "value", "event_type").withColumn("value", F.lit(-1.0)))
    return t.scan()


@query("SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS r FROM orders) WHERE r = 1")
def keyed_first_row(spark, sf_dir):
    """O-41, O-21: the first order of a customer through a table, visible once it is compacted."""
    t = catalog(spark).create_table("db.t", {"o_custkey": "BIGINT", "o_orderkey": "BIGINT"}, [], ["o_custkey"], {"bucket": "4", "merge-engine": "first-row"})
    src = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    for i in range(2):
        t.append(src.filter(F.col("o_orderkey") % 2 == i).coalesce(1).sortWithinPartitions("o_orderkey"))
    assert t.scan().isEmpty()
    t.compact()
    return t.scan()


@query("SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(max(o_totalprice) AS DOUBLE) AS greatest, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def keyed_aggregation(spark, sf_dir):
    """O-42, O-47, O-49 through a table, with a compaction between two commits."""
    t = catalog(spark).create_table("db.t", {"o_custkey": "BIGINT", "greatest": "DOUBLE", "keys": "BIGINT"}, [], ["o_custkey"], {"bucket": "4", "merge-engine": "aggregation", "fields.greatest.aggregate-function": "max", "fields.keys.aggregate-function": "sum"})
    src = read(spark, sf_dir, "orders").selectExpr("o_custkey", "o_totalprice AS greatest", "o_orderkey AS keys")
    t.append(src.filter("keys % 2 = 0"))
    t.compact()
    t.append(src.filter("keys % 2 = 1"))
    return t.scan()


@query(KEYED)
def bucket_filter(spark, sf_dir):
    """O-20: the buckets of a keyed table one by one."""
    t = keyed_table(spark, sf_dir)
    return t.scan(bucket=0).union(t.scan(bucket=1)).union(t.scan(bucket=2)).union(t.scan(bucket=3))


@query(f"SELECT {OUT} FROM orders")
def scan_orc(spark, sf_dir):
    """O-151: a table in ORC."""
    return orders_table(spark, sf_dir, partitioned=True, options={"file.format": "orc"}).scan()


@query(f"SELECT {OUT} FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def scan_orc_predicate(spark, sf_dir):
    """O-151, O-155: pruned by the statistics of ORC files and filtered."""
    return orders_table(spark, sf_dir, partitioned=True, options={"file.format": "orc"}).scan(where=p.gt("o_totalprice", 200000.0) & p.eq("o_orderstatus", "O"))


@query(f"SELECT {OUT} FROM orders")
def external_paths(spark, sf_dir):
    """O-159: files in two other places by turns."""
    away = f"{catalog(spark).warehouse}/away"
    return orders_table(spark, sf_dir, options={"data-file.external-paths": f"{away}/1,{away}/2", "data-file.external-paths.strategy": "round-robin"}).scan()


@query(f"SELECT {OUT} FROM orders WHERE o_orderkey % 5 <> 2 OR o_orderstatus <> 'F'")
def manifests_merged(spark, sf_dir):
    """O-133, O-161: manifests rolled at a small size and merged while files come and go."""
    t = orders_table(spark, sf_dir, 5, True, {"manifest.merge-min-count": "2", "manifest.target-file-size": "4kb", "manifest.full-compaction-threshold-size": "8kb"})
    t.overwrite(t.write(read(spark, sf_dir, "orders").select(*ORDER_COLUMNS).filter("o_orderkey % 5 <> 2 AND o_orderstatus = 'F'")), [{"o_orderstatus": "F"}])
    return t.scan()


@query("SELECT CAST(o_orderkey % 3 + 1 AS BIGINT) AS id, CAST(70 AS BIGINT) AS watermark, CAST(count(*) AS BIGINT) AS delta FROM orders GROUP BY 1")
def watermarks(spark, sf_dir):
    """O-131, O-132: a snapshot's watermark never goes back; its count of records."""
    t = orders_table(spark, sf_dir, 0)
    src = read(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    for i, mark in enumerate((70, 50, None)):
        t.append(src.filter(F.col("o_orderkey") % 3 == i), watermark=mark)
    return t.snapshots().select("id", "watermark", "delta")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 2 = 1")
def stream_latest(spark, sf_dir):
    """O-13: a follower that starts at the latest snapshot sees only what comes after."""
    t = orders_table(spark, sf_dir, 0)
    src = read(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    t.append(src.filter("o_orderkey % 2 = 0"))
    late = Follower(t, {"scan.mode": "latest"})
    late.poll()
    t.append(src.filter("o_orderkey % 2 = 1"))
    (_, df), = list(late)
    return df.agg(F.count("*").alias("n"))


@query(f"SELECT CAST(k AS TINYINT) AS kind, CAST(user_id AS BIGINT) AS user_id, CAST(value AS DOUBLE) AS value FROM ({EV}) WHERE event_id % 2 = 0")
def postponed_buckets(spark, sf_dir):
    """O-122: records without a bucket yet are seen as changes only."""
    t = keyed_table(spark, sf_dir, options={"bucket": "-2"})
    assert t.scan().isEmpty()
    return t.changes(1).select(F.col("_VALUE_KIND").alias("kind"), "user_id", "value")


@query("""SELECT CAST(vec_id AS BIGINT) AS vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - 0.1) * (CAST(embedding[i] AS DOUBLE) - 0.1)))), 6) AS score FROM embeddings WHERE label <> 3 ORDER BY score, vec_id LIMIT 20""")
def vector_scan(spark, sf_dir):
    """O-89c, O-89g: the nearest rows of a table, among those that a predicate keeps."""
    t = catalog(spark).create_table("db.t", {"vec_id": "BIGINT", "label": "INT", "embedding": {"type": "ARRAY", "element": "FLOAT"}})
    t.append(read(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(label AS int) AS label", "cast(embedding AS array<float>) AS embedding"))
    return t.scan(["vec_id"], where=p.ne("label", 3), vector=("embedding", QUERY_VECTOR, 20)).select("vec_id", F.round(SCORE, 6).alias("score"))


@query("SELECT CAST(count(*) AS BIGINT) AS records, CAST(3 AS BIGINT) AS files FROM orders")
def append_splits(spark, sf_dir):
    """O-24: files in order of arrival, packed into splits, from metadata alone."""
    t = orders_table(spark, sf_dir, 3, tasks=1)
    splits = t.plan().splits(1 << 20, 1 << 19)
    return spark.createDataFrame([(sum(e.file.rows for s in splits for e in s), sum(map(len, splits)))], "records long, files long")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT 1 FROM orders LIMIT 7)")
def scan_limit(spark, sf_dir):
    """O-23: few files are planned, rows are cut exactly."""
    return orders_table(spark, sf_dir).scan(limit=7).agg(F.count("*").alias("n"))


@query(f"SELECT {OUT.replace('CAST(o_totalprice AS DOUBLE)', 'CAST(CASE WHEN o_orderstatus = chr(70) THEN o_totalprice * 2 ELSE o_totalprice END AS DOUBLE)')} FROM orders")
def expire_and_clean(spark, sf_dir):
    """O-135, O-136: old snapshots and unused files go, the latest rows of the whole table stay."""
    t = orders_table(spark, sf_dir, 4, True)
    src = read(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    t.overwrite(t.write(src.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2)), [{"o_orderstatus": "F"}])
    t.expire(retain_min=1, older_than=2**62)
    t.write(src)  # never committed
    t.remove_orphans(older_than=2**62)
    return t.scan()


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders")
def adopt_files(spark, sf_dir):
    """O-137: files written elsewhere become part of a table."""
    cat = catalog(spark)
    t = cat.create_table("db.t", {"o_orderkey": "BIGINT", "o_custkey": "BIGINT"})
    away = f"{cat.warehouse}/elsewhere"
    read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").write.parquet(away)
    t.adopt([f"{away}/{f}" for f, _, _ in cat.store.files(away) if f.endswith(".parquet")])
    return t.scan()


@query(f"SELECT {OUT} FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0)")
def adopt_same_names(spark, sf_dir):
    """O-137, O-60: adopted files that share a name keep their own rows when some are deleted."""
    cat = catalog(spark)
    t = cat.create_table("db.t", {x.split()[0]: x.split()[1] for x in ORDERS.split(", ")}, options={"deletion-vectors.enabled": "true"})
    for i in range(2):
        away = f"{cat.warehouse}/elsewhere{i}"
        read(spark, sf_dir, "orders").select(*ORDER_COLUMNS).filter(F.col("o_orderkey") % 2 == i).coalesce(1).write.parquet(away)
        (name,) = [f for f, _, _ in cat.store.files(away) if f.endswith(".parquet")]
        cat.store.rename(f"{away}/{name}", f"{away}/x.parquet")
        t.adopt([f"{away}/x.parquet"])
    t.mark_deleted(t.positions().filter("o_orderstatus = 'F' AND o_orderkey % 2 = 0").select("_file", "_at"))
    return t.scan()


@query(f"SELECT {OUT} FROM orders WHERE o_orderkey % 2 = 0")
def filter_and_commit(spark, sf_dir):
    """O-127: a message that was committed before isn't committed again."""
    t = orders_table(spark, sf_dir, 0)
    message = t.write(read(spark, sf_dir, "orders").select(*ORDER_COLUMNS).filter("o_orderkey % 2 = 0"))
    t.filter_and_commit({1: message}, "job")
    t.filter_and_commit({1: message}, "job")
    return t.scan()
