"""The corpus pipeline: language ID, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierview.llm import language, minhash, packing, suffix
from tierview.llm.common import cut

#: A document goes if its language can't be told: no letter, or a score below this.
LEAST_SCORE = 0.3
#: What language.identify counts as a letter.
LETTER = r"\p{L}"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network, trained on their labelled rows, can tell; without any labelled rows, those with a letter."""
    net = language.fitted(docs)
    if not net.langs:
        return docs.where(F.col("text").rlike(LETTER))
    found = language.identify(docs, net)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, of rows that share it the first by text and then by the
    other columns. Documents without an id stay."""
    found = minhash.near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows"))
    kept = cut(found.select("__kept", (F.col("__kept").isNotNull() & (F.col("__rows") > 1)).alias("__again")))
    several = kept.where("__again")
    if several.isEmpty():
        return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")
    once = docs.join(kept.where("not __again"), docs["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(*[F.asc_nulls_last(c) for c in ("text", *[c for c in docs.columns if c not in ("doc_id", "text")])])
    rest = docs.join(several, docs["doc_id"] == F.col("__kept"), "left_semi").withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    return once.unionByName(rest)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has; a character that loses a byte goes whole."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = suffix.remove_repeats(docs, carry=others, whole=True)
    out = out.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length(F.col("kept").cast("string")).cast("long"))
    return out.select(*[F.col(c if c in ("text", "n_chars") else f"__carried_{c}").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in as few sequences as can be."""
    return packing.pack(cut(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))


STAGES = [("language_id", language_id), ("minhash_dedup", minhash_dedup), ("suffix_dedup", suffix_dedup), ("pack", pack)]

#: Training, MinHash and tokenising are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
