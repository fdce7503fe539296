"""Column evolution: groups of columns of the same rows, written at different times, stitched by row id (O-70 to O-79)."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_ID, SEQUENCE = "_ROW_ID", "_SEQUENCE_NUMBER"


def groups(entries: list) -> list[list]:
    """Files whose row ids overlap, together."""
    out: list[list] = []
    last = -1
    for e in sorted(entries, key=lambda e: (e.file.first_row_id, -e.file.last_row_id)):
        if out and e.file.first_row_id <= last:
            out[-1].append(e)
        else:
            out.append([e])
        last = max(last, e.file.last_row_id)
    return out


def stitched(table, entries: list, schema, columns: list[str]) -> DataFrame:
    """Rows of full files, with the newest value of each column from the files that wrote it later. A newer null is a null.

    Files with a subset of columns carry their row ids; per set of columns the newest record of a row counts. Rows that
    no full file has are left out. Groups without later files are read as they are, without any join."""
    wide, plain, late = [], [], defaultdict(list)
    for g in groups(entries):
        more = [e for e in g if e.file.write_cols is not None]
        (wide if more else plain).extend(e for e in g if e.file.write_cols is None)
        for e in more:
            late[e.file.write_cols].append(e)
    every = [*schema.names, ROW_ID, SEQUENCE]
    out = [table.records(plain, schema, False, [ROW_ID, SEQUENCE]).select(*every)] if plain or not wide else []
    if wide:
        df = table.records(wide, schema, False, [ROW_ID, SEQUENCE])
        df = df.select(ROW_ID, F.col(SEQUENCE).alias("_s"), *(F.col(n).alias(f"_b_{n}") for n in schema.names))
        newer: dict[str, list[tuple]] = defaultdict(list)
        for i, (cols, es) in enumerate(sorted(late.items())):
            rows = table.records(es, schema, False, [ROW_ID, SEQUENCE])
            written = table.schema_of(es[0].file.schema_id)
            ids = {f.id for f in written.fields if f.name in cols}
            own = [f.name for f in schema.fields if f.id in ids]
            rows = rows.groupBy(ROW_ID).agg(F.max(SEQUENCE).alias(f"_s{i}"), F.max_by(F.struct(*own), SEQUENCE).alias(f"_v{i}"))
            df = df.join(rows, ROW_ID, "left")
            for n in own:
                newer[n].append((F.col(f"_s{i}"), F.col(f"_v{i}.`{n}`")))

        def newest(n: str):
            best, value = F.col("_s"), F.col(f"_b_{n}")
            for s, v in newer[n]:
                later = s.isNotNull() & (s >= best)
                best, value = F.when(later, s).otherwise(best), F.when(later, v).otherwise(value)
            return value.alias(n)

        last = reduce(lambda a, b: F.greatest(a, b), [F.col(f"_s{i}") for i in range(len(late))], F.col("_s"))
        out.append(df.select(*map(newest, schema.names), ROW_ID, last.alias(SEQUENCE)))
    return reduce(lambda a, b: a.unionByName(b), out).select(*dict.fromkeys(columns))
