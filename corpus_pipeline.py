"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All stages but the last
return the columns of ``documents``; further columns of the input pass through.

Defined results: rows with a null text have no words and are rejected by the
first stage, as are empty ones.  Null ids, ties and repeated rows are treated as
each operator's module says; a stage on an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoquery.llm import bpe, line_dedup, minhash, mixing, quality_rules
from sonoquery.llm.frames import cut, free_name, scratch, table
from sonoquery.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject, by the base rules or by the likelihood ratio, go."""
    weights = quality_rules.fit(docs, quality_rules.trusted(table(spark, sf_dir, "labels")))
    at = free_name(docs, "quality")
    return quality_rules.verdicts(docs, weights, out=at).where(F.col(at)["kept"]).drop(at)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and passages of lines go from the texts, and with them documents that have no word left."""
    at = free_name(docs, "lines")
    rows = line_dedup.dedup(docs, out=at, passages=True)
    text, removed = F.col(at)["unrepeated"], F.col(at)["n_repeated"]
    rows = rows.where((removed == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(removed > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumns(changed).drop(at)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles (similarity 0.8) make, the one with the least id stays."""
    gone = minhash.near_duplicates(docs, n=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole, in the order of their training positions."""
    at = free_name(docs, "position")
    return mixing.training_order(docs).drop(at)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed, little-endian, 32 bits), with digests of them and of the decoded text."""
    done = bpe.round_trip(docs, bpe.Model.read(vocabulary()), keep=["doc_id"])
    ids, decoded = F.col("bpe.ids"), F.col("bpe.decoded")
    return done.select(
        "doc_id",
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"),
        ids.alias("ids"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: The likelihood ratio, the chunk boundaries, the links and the merges aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # what a stage wrote on its way goes when its result stands
        with scratch() as written:
            docs = cut(stage(spark, docs, sf_dir))
            written.remove(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
