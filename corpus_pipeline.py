"""From documents to packed training sequences, in five stages.

Every stage gets what its predecessor kept, written as Parquet and read again, and returns the columns of
documents; the last one returns the packed pieces. Rows with null or empty texts have no language and go in the
first stage; ties, repeated rows and empty tables pass through as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domora.llm import jaccard, language, packing, suffixes, toxicity
from domora.llm.bpe import public_path
from domora.session import materialise, ship, table

#: Near duplicates: five words a shingle, similarity of 0.8 or more.
NEAR = jaccard.Rule(5, 80)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a letter whose main language has half of the words or more."""
    ship(spark)
    return language.keep_identified(docs, language.fit(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted to be toxic; the model learns from the labelled ones in docs."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates."""
    ship(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = {c: f"in_{i}" for i, c in enumerate(rest)}
    kept = jaccard.keep_first(docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in inner.items())), NEAR, list(inner.values()))
    return kept.select("doc_id", "text", *(F.col(n).alias(c) for c, n in inner.items())).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the 100-byte repeats out of the texts; a character that a cut divides goes whole."""
    ship(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = {c: f"in_{i}" for i, c in enumerate(rest)}
    found = suffixes.without_repeats(docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in inner.items())), extra=list(inner.values()))
    # continuation bytes without a start, and starts without their continuation, are what a cut can leave
    text = suffixes.whole_characters("kept")
    out = found.withColumn("text", text).select("doc_id", "text", *(F.col(n).alias(c) for c, n in inner.items()))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of the documents into sequences of 2048."""
    ship(spark)
    return packing.pack(packing.token_pieces(docs, public_path("byte_bpe_50k.json")))


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]
#: Learned models have no SQL form; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
