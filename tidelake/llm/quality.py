"""Quality rules: plain limits first, then robust multivariate outliers.

Each text gives a vector of transformed statistics. For every language and source, a minimum-covariance-determinant
estimate (concentration steps from a median and quartile start) finds the centre and the shape of the tightest three
quarters of the vectors, and texts far from it by Mahalanobis distance are rejected. A concentration step is one pass:
the moments of each group are summed by bins of the distance, and the bins nearest to the centre that hold three
quarters of the rows make the next estimate. Groups only ever meet as sums by bin, so a hot group is no burden.
Everything is DataFrame functions.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, few, stored, table

SYMBOLS, BLANK = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Words in a window that counts as a repeat; limits of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Statistics, and for each the least standard deviation that counts: most texts have no symbols, so the core's may be 0.
STATS = {"mean_word": 0.06, "symbols": 0.25, "dup_lines": 0.04, "repeats": 0.08}
#: Share of a group in the core; rows that a group needs for its own estimate; concentration steps; bins per doubling.
CORE, OWN_ROWS, STEPS, BINS = 0.75, 100, 4, 16
#: Chi-square with 4 degrees of freedom: the factor that makes the covariance of the core (0.75) consistent, and the
#: squared distance beyond which a text is rejected (a chance of 0.001).
CONSISTENCY, CUT = 1.486, 18.47
P = len(STATS)
PAIRS = list(combinations_with_replacement(range(P), 2))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once, whatever the optimizer does."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of 8 words that occur more than once in the text, the first occurrence included."""

    def covered(order: Column) -> Column:
        n = F.size(order)
        nothing = F.array(F.lit(None).cast("struct<k:bigint,i:int>"))
        beside = F.zip_with(F.concat(nothing, F.slice(order, 1, n - 1)), F.concat(F.slice(order, 2, n - 1), nothing), lambda a, b: F.struct(a["k"].alias("a"), b["k"].alias("b")))
        twice = F.filter(F.zip_with(order, beside, lambda x, y: F.when(x["k"].eqNullSafe(y["a"]) | x["k"].eqNullSafe(y["b"]), x["i"])), lambda i: i.isNotNull())
        steps = let(F.array_sort(twice), lambda at: F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def looked(keys: Column) -> Column:
        order = lambda: F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), let(order(), covered)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) > WINDOW, let(windows, looked)).otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed. A null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    gone = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    by_words = let(F.filter(F.split(t, SPACE), lambda w: w != ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    df = df.withColumn("_w", by_words)
    return (df.withColumn("n_words", F.col("_w.n")).withColumn("word_chars", (F.length(t) - gone(BLANK)).cast("long")).withColumn("n_symbols", gone(SYMBOLS).cast("long"))
            .withColumn("n_dup_lines", F.when(F.instr(t, "\n") > 0, lines).otherwise(F.lit(0).cast("long"))).withColumn("n_repeat_words", F.col("_w.r")).drop("_w")
            .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))))


def vector() -> list[Column]:
    """The statistics, transformed so that ordinary texts spread alike in each."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log((F.col("word_chars") + 1) / n), F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def cholesky(cov) -> dict[tuple[int, int], Column]:
    """The lower factor of a covariance matrix given as columns, entry by entry."""
    low: dict[tuple[int, int], Column] = {}
    for j in range(P):
        low[j, j] = F.sqrt(F.greatest(cov(j, j) - sum((low[j, k] * low[j, k] for k in range(j)), F.lit(0.0)), F.lit(1e-6)))
        for i in range(j + 1, P):
            low[i, j] = (cov(i, j) - sum((low[i, k] * low[j, k] for k in range(j)), F.lit(0.0))) / low[j, j]
    return low


def distance() -> Column:
    """Squared Mahalanobis distance of _x0.. from the centre _m0.. with the factor _l00.."""
    z: list[Column] = []
    for i in range(P):
        z.append((F.col(f"_x{i}") - F.col(f"_m{i}") - sum((F.col(f"_l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))) / F.col(f"_l{i}{i}"))
    return sum((x * x for x in z), F.lit(0.0))


def estimates(rows: DataFrame) -> DataFrame:
    """For each _group of rows (_x0.., _core: takes part) the centre and factor, one row for each group."""
    floors = list(STATS.values())
    core = rows.filter("_core")
    quart = core.groupBy("_group").agg(*(F.percentile_approx(f"_x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"_q{i}") for i in range(P)))
    first = {f"_l{i}{j}": F.greatest((F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]) / 1.349, F.lit(floors[i])) if i == j else F.lit(0.0) for j, i in PAIRS}
    now = stored(quart.select("_group", *(F.col(f"_q{i}")[1].alias(f"_m{i}") for i in range(P)), *(c.alias(n) for n, c in first.items())), "mcd")
    for _ in range(STEPS):
        binned = core.join(few(now), "_group").withColumn("_bin", F.floor(BINS * F.log2(1 + distance())).cast("int"))
        sums = [F.count("*").alias("_n"), *(F.sum(f"_x{i}").alias(f"_s{i}") for i in range(P)), *(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_t{i}{j}") for i, j in PAIRS)]
        bins = binned.groupBy("_group", "_bin").agg(*sums)
        all_, upto = Window.partitionBy("_group"), Window.partitionBy("_group").orderBy("_bin")
        near = bins.withColumn("_all", F.sum("_n").over(all_)).withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).filter(F.col("_before") < CORE * F.col("_all"))
        total = near.groupBy("_group").agg(*(F.sum(c).alias(c) for c in bins.columns[2:]))
        mean = {i: F.col(f"_s{i}") / F.col("_n") for i in range(P)}
        cov = {(i, j): CONSISTENCY * (F.col(f"_t{i}{j}") / F.col("_n") - mean[i] * mean[j]) for i, j in PAIRS}
        cov |= {(i, i): F.greatest(cov[i, i], F.lit(floors[i] ** 2)) for i in range(P)}
        flat = total.select("_group", *(mean[i].alias(f"_m{i}") for i in range(P)), *(cov[i, j].alias(f"_c{i}{j}") for i, j in PAIRS))
        low = cholesky(lambda i, j: F.col(f"_c{min(i, j)}{max(i, j)}"))
        now = stored(flat.select("_group", *(f"_m{i}" for i in range(P)), *(low[i, j].alias(f"_l{i}{j}") for j, i in PAIRS)), "mcd")
    return now


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds the measures, base_failed, distance (squared; null where no estimate exists) and kept.

    Texts that fail the base rules are rejected and take no part in the estimates. A language and source with fewer than
    100 texts share an estimate with their language's other small ones, and these, if still too few, with all such; null
    counts as a language or source of its own. An empty table gives an empty result; with nothing to estimate from, the
    base rules decide.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]  # whatever df's columns are called
    inner = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)))
    at = dict(zip(df.columns, names, strict=True))
    rows = measures(inner, at[text]).drop(at[text])
    lang_, source_ = F.col(at[lang]).cast("string"), F.col(at[source]).cast("string")
    rows = rows.select("*", F.to_json(F.array(lang_, source_)).alias("_own"), F.to_json(F.array(lang_)).alias("_lang"), (~F.col("base_failed")).alias("_core"), *(v.alias(f"_x{i}") for i, v in enumerate(vector())))
    rows = stored(rows, "quality")
    counts = rows.groupBy("_own", "_lang").agg(F.count_if("_core").alias("_n"))
    counts = stored(counts, "quality-counts")
    small = stored(counts.groupBy("_lang").agg(F.sum(F.when(F.col("_n") < OWN_ROWS, F.col("_n")).otherwise(0)).alias("_small")), "quality-langs")
    groups = counts.join(few(small), "_lang").select("_own", F.when(F.col("_n") >= OWN_ROWS, F.col("_own")).when(F.col("_small") >= OWN_ROWS, F.col("_lang")).otherwise("rest").alias("_group"))
    rows = rows.join(few(stored(groups, "quality-groups")), "_own")
    done = rows.join(few(estimates(rows)), "_group", "left").withColumn("distance", distance())
    done = done.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT))
    mine = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    return done.select(*(F.col(at[c]).alias(c) for c in df.columns if c != text and c not in mine), *mine)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("lang", "source")
