"""A corpus pipeline of five stages over ``documents``: toxicity, near-duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and gives back a DataFrame, which is written as Parquet and reread for the
next. The first four return the columns of documents, extra ones included; the mix returns a row per draw, whole documents
only. The last writes token shards and returns where each of their documents stands.

Edge cases: null texts are no less clean than empty ones and form one group of near-duplicates; the mix never
draws documents without words. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, table
from pulsefield.llm.decontaminate import contaminations
from pulsefield.llm.mixing import mixed_documents
from pulsefield.llm.similar import similar_groups
from pulsefield.llm.tokens import token_digest
from pulsefield.llm.toxicity import severity, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds less likely toxic than not."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(severity(model, F.col("text"))["toxicity"] < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of texts that share four fifths of their five-word shingles."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "numbered")
    texts = numbered.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    groups = similar_groups(texts).join(texts.select("rid", "doc_id"), "rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    kept = groups.groupBy("component").agg(first.alias("first")).select(F.col("first.rid").alias("rid"))
    return numbered.join(kept, "rid", "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = materialize(contaminations(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct(), "held")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k_id"), F.xxhash64(F.col("text").cast("string")).alias("k_text"))
    same = (F.col("k_text") == F.col("text_key")) & F.col("k_id").eqNullSafe(F.col("doc_id"))
    return rows.join(found, same, "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often and as far as the mix of sources draws them, in training order."""
    drawn = materialize(mixed_documents(docs), "drawn")
    return drawn.orderBy("draw.position", "row.doc_id", "draw.pass").select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document in the token shards, which keep the order of the rows.

    Rows come from Parquet, in the order of its files' numbers; rows from elsewhere in the order of their partitions.
    """
    file = F.col("_metadata.file_name")
    try:
        order = (F.regexp_extract(file, r"part-(\d+)", 1).try_cast("long"), file, F.col("_metadata.row_index"))
        docs.select(*order)
    except AnalysisException:
        order = (F.monotonically_increasing_id(),)
    return token_digest(spark, docs, order=order)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_shards", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Groups of similar texts, the trained model and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
