"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.common import Scratch
from riverbed.llm.near_dup import drop_near_duplicates
from riverbed.llm.packing import pack
from riverbed.llm.quality import keep_good
from riverbed.llm.secrets import redact
from riverbed.llm.substring import drop_repeats


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, in the table's own type."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep. Null and empty texts have no words and go; repeated rows are judged one by one; a null doc_id or lang changes nothing but the reference."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near-duplicates, that of the smallest doc_id. Null and wordless texts are no copies of each other; rows without doc_id stay; of rows that repeat a doc_id one stays."""
    return drop_near_duplicates(docs).select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, text without its repeated passages. Null and empty texts, and rows without doc_id, pass as they are; rows that repeat doc_id and text count as one."""
    return _counted(drop_repeats(docs).select(docs.columns))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret in text replaced by a mask. A null text stays null; every row is treated by itself."""
    return _counted(redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's ids. A null text counts as empty, that is one end id; null and repeated doc_ids are packed like others."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("repeated passages", substring_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents; each is written and read again. An empty table gives no rows; columns beside doc_id, text, lang
    and n_chars are carried along, whatever their names, unless these begin with an underscore."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
