"""Preparing a training corpus: stages that each take the documents their predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm import quality_mil
from sentinela.llm.common import crc_of_id, stored
from sentinela.llm.minhash_join import decisions
from sentinela.llm.mixing import mixed_documents
from sentinela.llm.packing import pack
from sentinela.llm.queries import tokenizer_path
from sentinela.llm.secrets import redact_secrets

LEAST_QUALITY = 0.7


def _free(name: str, docs: DataFrame) -> str:
    """A column name that `docs` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score LEAST_QUALITY or more, with all their columns. Labels of one fold in four are not learned from.
    Without labels of both kinds nothing can be learned, and all documents stay. Null and empty texts have the score of an
    empty passage; repeated rows are scored each; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.pmod(crc_of_id(), F.lit(4)) != 2)
    model = quality_mil.learn(docs, labels)
    if not model:
        return docs
    # the other columns under numbers, so that none is taken for the score
    names = {c: c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}
    scored = quality_mil.score_texts(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), model)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select(*[F.col(n).alias(c) for c, n in names.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest id, null ids last, and of one id that of smallest hash
    of text; of rows with the same id and text one. A row is known by id and text, so unlike texts of one id, or without id,
    are decided on each for itself. Texts without words stay, one row of each id and text; an empty table stays empty."""
    own, gone_id, gone_hash = (_free(n, docs) for n in ("_hash", "_gone", "_gone_hash"))
    gone = decisions(docs).filter("not first").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    rest = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    rest = rest.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_hash)), "left_anti")
    return rest.dropDuplicates(["doc_id", own]).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind in brackets, and n_chars, where there is such a column, of the new
    text. Null texts stay null with their n_chars; repeated rows are changed alike; an empty table stays empty."""
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of a source with words at least once; small sources again, up to the target weights. A null source is the
    source ''. Null and empty texts come along with their source; a source without any words is left out, so a table without
    words becomes empty. Rows of one id and pass, such as repeated rows, are shown or left out together in the last pass."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence, with crc32 of its ids. A null or empty text is the end id alone, repeated rows are packed
    each, null ids stay null, a long text spans as many sequences as it needs; an empty table gives no pieces."""
    return pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
# Attention weights, compressed sizes and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
