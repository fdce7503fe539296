"""A corpus pipeline of five stages: toxic documents go, of near duplicates one stays, personal data is masked, sources
are mixed to their weights, and what is left is encoded.

Each stage's result is written as Parquet and read again as the next one's documents. run() returns the last stage's rows.

Stages look at the columns of documents alone, whatever else a table holds, and an empty table gives an empty result. Null
texts count as empty ones; what each stage does with them, with null idents and with repeated rows, its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import bpe, mixing, neardup, pii, toxicity
from tidelake.llm.common import few, n_words, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels outside the held-out fifth teach the scorer. Rows are judged one by one:
    texts without words, null ones too, stay whatever their score; rows without an ident are judged like others, equal texts
    alike."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), machine, name="_score").filter((F.col("_score") < 0.5) | (n_words(F.col("text")) == 0)).drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the least id stays: five words in a shingle, a similarity of 0.8.

    Documents without words link with nothing, so all of them stay, as do rows without an ident. Rows with one ident are one
    document: of them the row stays that sorts first by text, then the other columns."""
    gone = stored(neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    kept = docs.select(*COLUMNS).join(few(gone), "doc_id", "left_anti").select(*COLUMNS)
    again = stored(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return kept
    again = few(again)
    first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*(c for c in COLUMNS if c != "doc_id"))).alias("row"))
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(first.select("doc_id", "row.*").select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind's name in brackets. A row for each row; null texts stay null."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to weights 1, 2, 3, repeating: a row for the words that one pass over a document gives to one shard, in the
    shards' shuffled order. Documents of which nothing is drawn go, those without words among them; a null source is a
    source of its own; rows without an ident and repeated rows are drawn like others."""
    return mixing.mixed(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, a row for each row; null and empty texts have none."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores, components and permuted draws aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
