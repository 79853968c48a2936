"""Token counts through a digest cache.

A count depends on the content and on the tokenizer's version only. Documents are keyed by the SHA-256
of their UTF-8 text (null: empty), the cache by that digest and the SHA-256 of the tokenizer file.
Stored counts are joined; of the digests that miss, one document each is encoded and its count appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import batch, path_exists, ship, slices
from shelfwise.llm.encode import encoder

_COUNTED = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    known = encoder(path, 600_000)
    return lambda texts: [len(known.ids(t)) // 4 for t in texts]


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for rows in batches:
            texts = [t or "" for t in rows.column("text").to_pylist()]
            counts = [n for a, b in slices(texts) for n in count(texts[a:b])]
            yield batch(_COUNTED, [rows.column("digest"), counts])

    return run


def _stored(docs: DataFrame, cache: str) -> DataFrame:
    spark, schema = docs.sparkSession, "digest binary, n_tokens long"
    if not path_exists(spark, cache):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs, from the cache folder and from what it lacks.

    tokenizer: file of a tokenizers (.json) or sentencepiece (.model) vocabulary, at the same path on each
    machine. cache: folder on shared storage; a subfolder a tokenizer version. Null text counts as empty,
    null and repeated ids keep their rows, other columns are ignored; no rows give no rows. Two runs that
    append the same digest at once store equal counts, of which one is read.
    """
    spark = docs.sparkSession
    ship(spark)
    cache = f"{cache}/{tokenizer_version(tokenizer)}"
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(F.encode(body, "utf-8"), 256)).alias("digest"),
        body.alias("text"),
    )
    # A digest's document is chosen by ids alone; only the chosen texts are then encoded.
    chosen = keyed.groupBy("digest").agg(F.min("doc_id").alias("chosen_id"))
    misses = chosen.join(_stored(docs, cache).select("digest"), "digest", "left_anti")
    texts = keyed.alias("k").join(
        misses.alias("m"),
        (F.col("k.digest") == F.col("m.digest")) & F.col("k.doc_id").eqNullSafe(F.col("m.chosen_id")),
        "left_semi",
    )
    counted = texts.select("digest", "text").mapInArrow(_count_batches(tokenizer), "digest binary, n_tokens long")
    counted.write.mode("append").parquet(cache)
    return keyed.join(_stored(docs, cache), "digest").select("doc_id", "n_bytes", "n_tokens")
