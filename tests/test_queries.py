"""Every query of the table engine against its SQL, over the smallest tables."""

import duckdb
import pytest

from tests.conftest import SF
from tidelake.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return out


def normal(rows):
    return sorted(repr(tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None or isinstance(v, bool) else str(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert normal(rows) == normal(want)


def test_orc_statistics_sort_no_rows(spark, duck, monkeypatch):
    plans, frames = [], type(spark.range(1))
    collect = frames.collect
    monkeypatch.setattr(frames, "collect", lambda df: (collect(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    got = QUERIES["scan_orc_predicate"](spark, SF)
    monkeypatch.undo()
    assert len(plans) == 2 and not any("SortAggregate" in x for x in plans)  # one for each commit
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['scan_orc_predicate']})").fetchall()
    assert want and normal(tuple(r) for r in got.collect()) == normal(want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0
