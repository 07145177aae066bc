"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's documents.  Stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from textloom.llm.common import saved, short_plans, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier rejects go, each judged by its own text.

    Null and empty texts are clean; repeated rows share their fate; a table
    without rows stays one; other columns than those of documents are dropped.
    """
    short_plans(spark)
    scored = toxicity.with_score(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), F.lit(True))
    return scored.filter(F.col("toxicity_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays, once.

    Rows without an id all stay, as do documents without text; of rows that
    share an id one stays; a table without rows stays one; other columns than
    those of documents are dropped.
    """
    short_plans(spark)
    found = jaccard_join.near_duplicates(docs)
    least = found.filter("doc_id = class_id").select("doc_id")
    named = docs.filter("doc_id is not null").select(*COLUMNS).join(least, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated by the benchmark go, each judged by its own text.

    Null and empty texts are clean; repeated rows share their fate; a table
    without rows stays one; other columns than those of documents are dropped.
    """
    short_plans(spark)
    judged = decontaminate.hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return judged.filter(~decontaminate.contaminated()).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every row stays.

    Null and empty texts have none; a row's secrets are those found in it, with
    an id or without; repeated rows are each redacted; a table without rows
    stays one; other columns than those of documents are dropped.
    """
    short_plans(spark)
    return secrets.redacted(docs.select(*COLUMNS), secrets.scan(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in training sequences.

    A null or empty text is one piece, its end; repeated rows are each packed; a
    table without rows gives no pieces; other columns are ignored.
    """
    short_plans(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the forest nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
