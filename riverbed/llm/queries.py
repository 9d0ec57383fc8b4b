"""The thin queries opN_<name> over the driver's tables, each with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, component_id, kept."""
    from riverbed.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_removed (words), removed (first:end of words, comma-joined), text without them."""
    from riverbed.llm.substring import drop_repeats

    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.filter(F.split("removed", ","), lambda x: x != "")
    n = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + F.substring_index(x, ":", -1).cast("long") - F.substring_index(x, ":", 1).cast("long"))
    return out.select("doc_id", n.alias("n_removed"), "removed", "text")


@query
def op4_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece, placed in sequences of at most 1024 ids."""
    import public_tokenizers

    from riverbed.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: number and digests of its ids and of the bytes decoded from them."""
    import public_tokenizers

    from riverbed.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base counts and the verdict of the quality rules."""
    from riverbed.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


@query
def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: numbers of spans, digest of the fixed patterns' spans, all spans."""
    from riverbed.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: places of license phrases, and labels of phrases and of similar templates."""
    from riverbed.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op1_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learnt from the rows that are not held out."""
    from riverbed.llm.langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    langs, prototypes = fit(docs.filter(~held_out(4, 2)))
    return identify(docs, langs, prototypes).withColumn("held_out", held_out(4, 2)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; learnt from the labels that are not held out."""
    from riverbed.llm.langid import held_out
    from riverbed.llm.toxicity import fit, labelled_sample, score

    docs = table(spark, sf_dir, "documents")
    machine = fit(labelled_sample(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0))))
    return score(docs, machine).withColumn("held_out", held_out(5, 0)).select("doc_id", "held_out", "score", "predicted")


@query
def op6_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    from riverbed.llm.vectors import range_join

    return range_join(table(spark, sf_dir, "embeddings"))


@query
def op11_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows at most for each vec_id divisible by 20: query_id, rank, vec_id, score of the nearest found among all others."""
    from riverbed.llm.ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op12_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: faults of its damaged turns, and the cheapest edits that repair them."""
    from riverbed.llm.conversations import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


@query
def op13_checkpoint_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: tokens, form, code points of prefix and middle, digests of the output and of the text rebuilt from it."""
    from riverbed.llm.fim import fill_in_middle, restored

    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored("output", "form")).alias("restored_sha256"))


def _oracles() -> dict[str, str]:
    from riverbed.llm.oracles import COMPONENTS, MIDDLES, licenses_sql, quality_sql, repair_sql

    return {"op6_pivot_range_join": COMPONENTS, "op7_license_join": licenses_sql(), "op10_divergence_rules": quality_sql(), "op12_viterbi_repair": repair_sql(), "op13_checkpoint_fim": MIDDLES}


ORACLES.update(_oracles())
