"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import language_id
from shelfwise.llm.common import scratch
from shelfwise.llm.jaccard_join import near_duplicate_classes
from shelfwise.llm.line_dedup import dedup_units
from shelfwise.llm.mixing import mixed_documents
from shelfwise.llm.packing import cut_pieces, pack

MIN_LANGUAGE_SCORE = 0.5
SEQUENCE = 2048


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a clear language; those without letters, and mixtures without a main language, go.

    Where no document has a label, no language can be told: all stay.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs
    labelled = language_id.predict(docs, model)
    kept = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return labelled.filter(kept).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by Jaccard similarity the one with the smallest doc_id stays.

    Repeated rows of that document (same id and text) count as one; rows without an id can't be named and stay.
    """
    stays = near_duplicate_classes(docs.select("doc_id", "text")).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of clauses seen in earlier documents, or before in the same one, are cut; texts left empty go.

    Adds the empty column `mix`, in which the next stage tells the places.
    """
    cut = dedup_units(docs).filter("n_removed = 0 or length(trim(text)) > 0")
    return asks_for_places(cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns))


def asks_for_places(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mix", F.lit(None).cast("string"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their bytes, none above a quarter of the mix, interleaved block by block.

    What the cap holds back follows in later mixes: every document has a place. It is told in the column `mix` of
    docs; without one, by the order of the rows alone.
    """
    return mixed_documents(docs, later=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mixed documents in sequences of 2048 tokens, each of pieces near each other in the mix.

    Pieces keep the slot of their document, by which the sequences can be read in the order of the mix. Documents
    without places get the ones that the mix has for them.
    """
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    if "mix" not in docs.columns:
        docs = mix_sources(spark, asks_for_places(docs), sf_dir)
    placed = docs.withColumn("slot", F.col("mix.slot"))
    return pack(cut_pieces(placed, tokenizer, 0, SEQUENCE, carried="slot"), SEQUENCE, along="slot")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, union-find and genetic search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
