"""Documents to training tokens: language, exact and near duplicates, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import bpe_codec, exact_dedup, jaccard_join, language_id, mixing
from emberwatch.llm.queries import LANGUAGE_HELD_OUT, VOCABULARY
from emberwatch.sources.store import materialize

REPEATS = 1.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language by the model; those without a letter go, and those of which no language
    has 0.35 of the words (``language_id.LEAST_SCORE``). If nothing could be learned, all with a letter stay."""
    sample = language_id.labelled_sample(docs, F.expr(f"NOT ({LANGUAGE_HELD_OUT})"), "doc_id", "text", "lang")
    return language_id.known_language(docs, language_id.fit(*sample))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id.

    Kept rows are found again by id and SHA-256 of the text; of rows equal in both, one stays.
    """
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("sha"))
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    same = (keyed["sha"] == kept["sha"]) & keyed["row.doc_id"].eqNullSafe(kept["kept_id"])
    once = keyed.join(kept, same, "left_semi").withColumn("doc_id", F.col("row.doc_id")).dropDuplicates(["sha", "doc_id"])
    return once.select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: the first by id (null ids last), then by xxhash64 of the text.

    Of rows equal in id and text one stays; each document without words stays, whatever its id.
    """
    kept = materialize(jaccard_join.first_documents(docs).withColumnsRenamed({"doc_id": "kept_id", "text_key": "kept_key"}), "kept")
    key = F.xxhash64(docs["text"])

    def rows_of(keys: DataFrame) -> DataFrame:
        return docs.join(keys, docs["doc_id"].eqNullSafe(keys["kept_id"]) & (key == keys["kept_key"]), "left_semi")

    repeated = kept.where("copies > 1")
    if repeated.isEmpty():
        return rows_of(kept)
    once = rows_of(repeated).withColumn("near_key", key).dropDuplicates(["doc_id", "near_key"]).drop("near_key")
    return rows_of(kept.where("copies = 1")).unionByName(once)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix of their sources has them."""
    return mixing.realise(docs, repeats=REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests."""
    return bpe_codec.token_digests(bpe_codec.encode_decode(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [("language_crf", language), ("exact_dedup", exact), ("jaccard_join", near), ("temperature_mix", mix), ("bpe_codec", encode)]
# The language model, similarity components and BPE cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
