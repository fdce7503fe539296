"""Types, options, schemas, predicates, ranges: what the driver works out alone."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidelake.functions import predicates as P
from tidelake.plans import ranges as R
from tidelake.plans.schema import Options, TableSchema, duration, memory_size, parse_type, print_type

B = P.Builder


@pytest.mark.parametrize("text", ["INT NOT NULL", "DECIMAL(6, 3)", "TIMESTAMP(6)", "TIMESTAMP(6) WITH LOCAL TIME ZONE", "BYTES", "BOOLEAN", "TINYINT NOT NULL", "DATE"])
def test_types_round_trip(text):
    assert print_type(*parse_type(text)) == text


def test_nested_types_round_trip():
    spec = {"type": "ROW NOT NULL", "fields": [{"id": 3, "name": "a", "type": {"type": "ARRAY", "element": "FLOAT"}}, {"id": 4, "name": "m", "type": {"type": "MAP", "key": "TINYINT NOT NULL", "value": "SMALLINT"}}]}
    assert print_type(*parse_type(spec)) == spec
    with pytest.raises(ValueError):
        parse_type("INTERVAL")


def test_sizes_and_durations():
    assert [memory_size(x) for x in ("128mb", "1 GB", "512", "8 kb", "3b")] == [128 << 20, 1 << 30, 512, 8 << 10, 3]
    assert [duration(x) for x in ("1 hour", "30 s", "100", "2 days", "5 min")] == [3600, 30, 0.1, 172800, 300]
    for bad in ("x", "1 parsec"):
        with pytest.raises(ValueError):
            memory_size(bad)
        with pytest.raises(ValueError):
            duration(bad)


def test_options():
    o = Options.of({"bucket": 3, "fields.a,b.sequence-group": "c,d", "fields.c.aggregate-function": "sum", "fields.c.ignore-retract": "true", "sequence.field.sort-order": "descending", "target-file-size": "1 mb"})
    assert (o.bucket, o.groups, o.aggregates, o.ignore_retract, o.descending, o.target_file_size) == (3, {("a", "b"): ["c", "d"]}, {"c": "sum"}, {"c"}, True, 1 << 20)
    assert Options.of({}).mode() == "latest-full" and Options.of({"scan.snapshot-id": 2}).mode() == "from-snapshot"
    for bad in ({"merge-engine": "x"}, {"scan.mode": "x"}, {"ignore-delete": "maybe"}, {"sequence.field.sort-order": "up"}):
        with pytest.raises(ValueError):
            Options.of(bad)
    with pytest.raises(ValueError, match="scan.snapshot-id"):
        Options.of({"scan.mode": "from-snapshot"}).mode()


FIELDS = {"k": "INT", "p": "STRING", "v": "DOUBLE", "s": "BIGINT", "d": "DECIMAL(5, 2)", "arr": {"type": "ARRAY", "element": "INT"}}


@pytest.mark.parametrize("partition, key, options", [
    (["x"], [], {}), ([], ["arr"], {}), (["d"], [], {}), (["p"], ["p"], {}), ([], [], {"bucket": "2"}), ([], [], {"bucket": "0"}), ([], [], {"bucket-key": "k"}), ([], ["k"], {"bucket": "2", "bucket-key": "v"}),
    ([], [], {"bucket": "-2"}), ([], ["k"], {"sequence.field": "nope"}), ([], ["k"], {"merge-engine": "first-row", "sequence.field": "s"}), ([], ["k"], {"fields.zz.aggregate-function": "sum"}),
    ([], ["k"], {"fields.v.aggregate-function": "bool_or"}), ([], ["k"], {"fields.s.sequence-group": "v", "fields.d.sequence-group": "v"}), ([], [], {"changelog-producer": "input"}), ([], ["k"], {"row-tracking.enabled": "true"}),
    ([], [], {"data-evolution.enabled": "true"}), ([], [], {"snapshot.num-retained.min": "0"}), ([], [], {"snapshot.num-retained.min": "5", "snapshot.num-retained.max": "3"}), ([], ["k"], {"merge-engine": "first-row", "changelog-producer": "input"}),
])
def test_schema_refuses(partition, key, options):
    with pytest.raises(ValueError):
        TableSchema.create(FIELDS, partition, key, options)


def test_reserved_and_repeated_names():
    for name in ("_ROW_ID", "_KEY_x"):
        with pytest.raises(ValueError):
            TableSchema.create({name: "INT"})
    with pytest.raises(ValueError):
        TableSchema.create(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("a", T.IntegerType())]))


def test_schema_versions_keep_field_ids():
    s = TableSchema.create(FIELDS, ["p"], ["p", "k"], {"bucket": "2"})
    assert TableSchema.from_json(s.to_json()) == s and s.trimmed_keys == ["k"] and s.field("k").type == "INT NOT NULL"
    n = s.altered(("rename", "v", "w"), ("drop", "s"), ("add", "s", "INT"), ("type", "d", "STRING"), ("move", "w", 0))
    assert (n.id, n.field("w").id, n.names[0]) == (1, s.field("v").id, "w") and n.field("s").id == s.highest + 1
    for bad in (("drop", "k"), ("rename", "p", "q"), ("type", "arr", "INT"), ("add", "k", "INT"), ("drop", "none"), ("set", "merge-engine", "first-row")):
        with pytest.raises(ValueError):
            s.altered(bad)


spans = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 10)).map(lambda x: (x[0], x[0] + x[1])), max_size=8)


@given(spans, spans)
@settings(max_examples=150, deadline=None)
def test_range_algebra_is_set_algebra(a, b):
    ids = lambda rs: {i for x, y in rs for i in range(x, y + 1)}
    assert ids(R.union(a, b)) == ids(a) | ids(b)
    assert ids(R.intersection(a, b)) == ids(a) & ids(b)
    assert ids(R.exclude(a, b)) == ids(a) - ids(b)
    assert R.count(a) == len(ids(a)) and R.merge(a) == R.from_ids(ids(a)) and ids(R.shifted(a, 5)) == {i + 5 for i in ids(a)}


def python_value(p, row):
    """A predicate's value with SQL's nulls as false."""
    if isinstance(p, P.And):
        return all(python_value(c, row) for c in p.children)
    if isinstance(p, P.Or):
        return any(python_value(c, row) for c in p.children)
    v, x = row[p.field], p.literals[0] if p.literals else None
    if p.function in ("is_null", "is_not_null"):
        return (v is None) == (p.function == "is_null")
    if v is None:
        return False
    if p.function == "in":
        return v in [y for y in p.literals if y is not None]
    if p.function == "not_in":
        return None not in p.literals and v not in p.literals
    if x is None:
        return False
    return {"eq": v == x, "ne": v != x, "lt": v < x, "le": v <= x, "gt": v > x, "ge": v >= x}[p.function]


def random_predicate(rng, depth=2):
    if depth and rng.random() < 0.5:
        return rng.choice([P.And, P.Or])(tuple(random_predicate(rng, depth - 1) for _ in range(rng.randrange(2, 4))))
    f, c = rng.choice(["eq", "ne", "lt", "le", "gt", "ge", "is_null", "is_not_null", "in", "not_in"]), rng.choice("ab")
    lits = () if f.startswith("is_") else tuple(rng.choice([None, *range(5)]) for _ in range(3)) if f in ("in", "not_in") else (rng.choice([None, *range(5)]),)
    return P.Leaf(f, c, lits)


@pytest.mark.parametrize("seed", range(300))
def test_statistics_never_lose_a_row(seed):
    rng = random.Random(seed)
    rows = [{c: rng.choice([None, *range(5)]) if rng.random() < 0.8 else None for c in "ab"} for _ in range(rng.randrange(1, 4))]
    p = random_predicate(rng)

    def stats(c):
        known = [r[c] for r in rows if r[c] is not None]
        return rng.choice([None, P.Stats(len(rows)), P.Stats(len(rows), min(known, default=None), max(known, default=None), sum(r[c] is None for r in rows))])

    if any(python_value(p, r) for r in rows):
        assert p.may_match(stats)
    if any(python_value(~p, r) for r in rows):
        assert (~p).may_match(stats)


def test_predicates_in_spark_equal_the_truth_table(spark):
    rows = [{"a": x, "b": y} for x, y in itertools.product([None, 0, 1, 4], repeat=2)]
    df = spark.createDataFrame([(r["a"], r["b"]) for r in rows], "a int, b int").cache()
    for seed in range(40):
        p = random_predicate(random.Random(seed))
        assert sorted(map(repr, df.filter(p.column()).collect())) == sorted(repr(x) for x in df.collect() if python_value(p, x.asDict()))


def test_predicate_helpers():
    p = B.eq("a", 1) & B.lt("b", 2) & (B.eq("a", 1) | B.eq("c", 3))
    assert len(P.split_and(p)) == 3 and P.fields(p) == {"a", "b", "c"}
    assert P.only(p, ["a"]) == B.eq("a", 1) and P.fields(P.without(p, ["b"])) == {"a", "c"} and P.fields(P.renamed(p, {"a": "x", "b": "y"})) == {"x", "y"}
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.StringType()), T.StructField("m", T.ArrayType(T.LongType()))])
    P.validate(B.eq("a", 1) & B.isin("s", ["x", None]) & B.is_null("m"), schema)
    for bad in (B.eq("z", 1), B.eq("a", 1.0), B.eq("a", True), B.eq("s", 1), B.eq("m", 1)):
        with pytest.raises(ValueError):
            P.validate(bad, schema)
