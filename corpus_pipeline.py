"""From raw documents to token ids in five stages.

Each stage takes and returns rows with the columns of ``documents`` (the last adds the
ids instead of the text), works on all that the stage before kept, and is written to
Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import bpe, langid, minhash, mixing, substring
from pressroom.llm.common import as_table, table, working_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language that the model knows: null, or without a letter.
    ``lang`` becomes the prediction."""
    found = langid.predict(docs.select(*COLUMNS), langid.train(docs))
    return found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five
    words a shingle, similarity 0.8); rows that repeat an id stand or fall together."""
    gone = as_table(minhash.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct(), "near-copies")
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    return kept.select(*COLUMNS)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every passage of 35 words or more that stands elsewhere too; documents
    of which nothing is left go."""
    left = substring.remove_repeats(docs.select(*COLUMNS), with_text=True)
    return left.filter("text <> ''").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source meets its target of words."""
    mixed = mixing.mix(docs, mixing.quality_weights(table(spark, sf_dir, "labels")), carry=COLUMNS)
    rows = mixed.filter("copies > 0").select(*[F.col(f"kept_{c}").alias(c) for c in COLUMNS], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, in place of its text."""
    return bpe.encode(docs.select(*COLUMNS))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", remove_passages),
    ("mixing", mix_sources),
    ("BPE", encode),
]
#: The stages learn, hash and encode; no SQL that DuckDB runs gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's working tables go when it ends, its own table
    when the next has been written."""
    docs, (*front, (last, finish)) = table(spark, sf_dir, "documents"), STAGES
    with working_tables(spark):
        for name, stage in front:
            with working_tables(spark):
                docs = as_table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), keep=True)
        return as_table(finish(spark, docs, sf_dir), "stage-" + last.replace(" ", "-"), keep=True)
