"""The pipeline over documents: toxic texts out, one of each group of near copies, repeated passages cut, sources mixed, sequences packed.

Every stage takes a table with the columns of documents and any others, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.chaining import repeats, without_repeats
from loomgraph.llm.jaccard_join import jaccard_join
from loomgraph.llm.mixing import domain_machines, mix
from loomgraph.llm.packing import pack
from loomgraph.llm.queries import TARGETS, table
from loomgraph.llm.store import drop, saved, unused, written
from loomgraph.llm.toxicity import labelled_terms, score, toxic_machine


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Null and empty texts have the score of no terms; null ids and repeated rows are judged like others."""
    machine = toxic_machine(labelled_terms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    mark = unused(docs.columns, "toxic_score")
    return score(docs, machine, docs.columns, name=mark).filter(F.col(mark) < 0.5).drop(mark)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. Documents without an id, without text or without words stay; of rows that repeat an id one stays."""
    joined = saved(jaccard_join(docs), "joined")
    dropped = joined.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = joined.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has, and their new n_chars; those that are nothing else go. Null, empty and blank texts and documents without an id stay as they are."""
    blank = unused(docs.columns, "blank")
    empty = lambda c: F.trim(F.translate(F.coalesce(c, F.lit("")), "\t\n\u000b\f\r", "     ")) == ""
    cut = without_repeats(docs.withColumn(blank, empty(F.col("text"))), saved(repeats(docs), "repeats"))
    left = cut.filter(F.col(blank) | ~empty(F.col("text")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says, once at least. Documents without an id or without words come once; rows that repeat an id come as often as the highest rate of them says."""
    machines = domain_machines(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rated = mix(docs, table(spark, sf_dir, "labels"), TARGETS, least=1.0, machines=machines)
    copies, at, copy = (unused(docs.columns, n) for n in ("copies", "at", "copy"))
    more = rated.filter("copies > 1 and doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias(copies))
    counted = docs.join(more, "doc_id", "left").withColumn(copies, F.coalesce(copies, F.lit(1).cast("long")))
    chunks = counted.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(1000).cast("long"))))  # no long arrays
    return chunks.withColumn(copy, F.explode(F.sequence(at, F.least(F.col(at) + 999, F.col(copies) - 1)))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a null or empty text is its end alone, null ids stay null, and repeated rows are packed each."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: A fitted model and similarity joins have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, each written and read again; the tables that a stage has made for itself are then deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written()
        docs = saved(stage(spark, docs, sf_dir), name)
        drop(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
