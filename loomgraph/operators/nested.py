"""Nested records put together bottom up, in groups of a documented size; larger ones stay rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import strip_pipe
from loomgraph.operators.predications import without_blacklisted
from loomgraph.operators.records import KINDS, entry_parts
from loomgraph.operators.rounds import parts_for, stored

#: Parts of one kind that are nested in one record, at most.
MOST = 1000


def gathered(rows: DataFrame, keys: list[str], value: Column, name: str, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(keys, name: sorted array, ``n``) of each group of rows with at most ``most`` of them, and the rows of the others.

    A group's rows are counted while they are gathered, and no more than ``most`` of them are held: a larger one has its count, a null array, and all its rows in the second table. Rows that are dealt by the keys already
    are not shuffled again.
    """
    group = Window.partitionBy(*keys)
    held = F.when(F.row_number().over(group.orderBy(keys[0])) <= most, value)  # any of them: the array of a larger group is null
    lists = rows.withColumn("_held", held).groupBy(*keys).agg(F.sort_array(F.collect_list("_held")).alias(name), F.count("*").alias("n"))
    many = rows.withColumn("_n", F.count("*").over(group)).filter(F.col("_n") > most).drop("_n")
    return lists.select(*keys, F.when(F.col("n") <= most, F.col(name)).alias(name), "n"), many


def nested_entries(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The entries of a record graph as nested records, and the parts of those that have too many.

    The first table has ui, name, kind, concepts (ui, name, preferred, relations: ui, name, scope; terms: ui, name, preferred), mapped, indexed, actions and substances (ui, name), all by ui; what an entry doesn't have is an empty
    array. A list of more than ``most`` parts is null, and its parts are rows (ui, part, other, name, preferred, scope) of the second table; a concept's list is null in the records that hold the concept. Terms
    go into concepts, and concepts into records. Entries of every kind have a row, terms and named concepts too.
    """
    parts = stored(entry_parts(nodes, edges))
    plain = F.struct(F.col("other").alias("ui"), "name")
    of = lambda part: parts.filter(F.col("part") == part)
    terms, many_terms = gathered(of("term"), ["ui"], F.struct(F.col("other").alias("ui"), "name", "preferred"), "terms", most)
    relations, many_relations = gathered(of("relation"), ["ui"], F.struct(F.col("other").alias("ui"), "name", "scope"), "relations", most)
    none = lambda c, kind: F.when(F.col(f"{c}_n").isNull(), F.array().cast(kind)).otherwise(F.col(c)).alias(c)
    named = lambda df, c: df.withColumnRenamed("n", f"{c}_n")
    concepts = of("concept").select(F.col("ui").alias("record"), F.col("other").alias("ui"), "name", "preferred")
    inside = concepts.join(named(relations, "relations"), "ui", "left").join(named(terms, "terms"), "ui", "left")
    concept = F.struct("ui", "name", "preferred", none("relations", "array<struct<ui:string,name:string,scope:string>>"), none("terms", "array<struct<ui:string,name:string,preferred:boolean>>"))
    held, many_concepts = gathered(inside.select("record", concept.alias("c")), ["record"], F.col("c"), "concepts", most)
    left = [many_terms, many_relations, of("concept").join(many_concepts.select(F.col("record").alias("ui")).distinct(), "ui", "left_semi")]
    out = nodes.select("ui", "name", "kind").join(named(held.withColumnRenamed("record", "ui"), "concepts"), "ui", "left")
    kinds = {"concepts": held.schema["concepts"].dataType.simpleString()}
    for part, name in (("mapped", "mapped"), ("indexed", "indexed"), ("action", "actions"), ("substance", "substances")):
        some, many = gathered(of(part), ["ui"], plain, name, most)
        out, kinds[name] = out.join(named(some, name), "ui", "left"), "array<struct<ui:string,name:string>>"
        left.append(many)
    rows = left[0]
    for more in left[1:]:
        rows = rows.unionByName(more.select(rows.columns))
    return out.select("ui", "name", "kind", *[none(c, k) for c, k in kinds.items()]), rows.select("ui", "part", "other", "name", "preferred", "scope")


def entry(records: DataFrame, ui: str) -> DataFrame:
    """The record of a ui: a filter that the scan of stored records gets."""
    return records.filter(F.col("ui") == ui)


def by_label(records: DataFrame) -> DataFrame:
    """Entries in the order of their kinds (descriptors first), then ui, name."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.coalesce("kind", F.lit("")))
    return records.orderBy(F.when(place > 0, place).otherwise(len(KINDS) + 1), "ui", "name")


def nested_predications(rows: DataFrame, sentences: DataFrame, pmids: DataFrame, semtypes: list[str] = (), concepts: list[str] = (), most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(pmid, predication, subject, subtype, predicate, object, objtype, evidence: array of number, sentence_id, sentence) of the predications of some articles, and the evidence rows of those with more than ``most``.

    ``rows`` are (pmid, predication, subject, subtype, predicate, object, objtype, sentence_id), ``sentences`` (sentence_id, number, sentence). Piped concepts count by their first part; predications with a type or concept of a black list
    are left out, as are rows without a sentence; a sentence is evidence once for a predication, in the order of its number.
    """
    parts = parts_for(rows)  # each step deals its rows to so many, the joins' other sides with them
    own = rows.repartition(parts, "pmid").join(pmids.select("pmid").distinct(), "pmid", "left_semi").withColumns({c: strip_pipe(F.col(c).cast("string")) for c in ("subject", "object")})
    said = without_blacklisted(own, semtypes, concepts).repartition(parts, "sentence_id").join(sentences, "sentence_id")
    keys = ["pmid", "predication", "subject", "subtype", "predicate", "object", "objtype"]
    said = said.select(*keys, "number", "sentence_id", "sentence").fillna("", ["subtype", "objtype"]).repartition(parts, *keys)  # distinct, counted and gathered where they are
    found, many = gathered(said.distinct(), keys, F.struct("number", "sentence_id", "sentence"), "evidence", most)
    return found.drop("n"), many
