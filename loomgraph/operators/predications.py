"""Predications (subject, predicate, object with evidence) and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import strip_pipe
from loomgraph.operators.rounds import parts_for

TRIPLE = ["subject", "predicate", "object"]


def without_blacklisted(rows: DataFrame, semtypes: list[str] = (), concepts: list[str] = ()) -> DataFrame:
    """Rows whose subject and object have no blacklisted semantic type or concept; a null is on no list."""
    out = rows
    for column, values in (("subtype", semtypes), ("objtype", semtypes), ("subject", concepts), ("object", concepts)):
        if values:
            out = out.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))
    return out


def predication_count(rows: DataFrame, least: int = 0) -> DataFrame:
    """Triples with more than ``least`` predications: types (the smallest, as they aren't grouped) and cnt."""
    return rows.groupBy(*TRIPLE).agg(F.min("subtype").alias("subtype"), F.min("objtype").alias("objtype"), F.count("*").alias("cnt")).filter(F.col("cnt") > least)


def around(rows: DataFrame, concept) -> DataFrame:
    """Rows with the concept as subject, then those with it as object; a row with both comes twice."""
    return rows.filter(F.col("subject") == concept).unionByName(rows.filter(F.col("object") == concept))


def with_evidence(triples: DataFrame, rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """Each row's sentence beside its triple: one equi-join in place of a lookup for each triple. Piped concepts count by their first part."""
    first = lambda df: df.withColumns({c: strip_pipe(F.col(c).cast("string")) for c in ("subject", "object")})
    evidence = first(rows).join(sentences, "sentence_id").select(*TRIPLE, "pmid", "sentence")
    return first(triples).join(evidence, TRIPLE)


def nested_evidence(found: DataFrame) -> DataFrame:
    """One row a triple with its evidence in the order of pmid."""
    return found.groupBy(*TRIPLE, "cnt").agg(F.sort_array(F.collect_list(F.struct("pmid", "sentence"))).alias("evidence"))


def by_pmid(rows: DataFrame, sentences: DataFrame, pmids: DataFrame) -> DataFrame:
    """Predications of the articles in pmids, with their sentences."""
    return rows.join(pmids.select("pmid").distinct(), "pmid", "left_semi").join(sentences, "sentence_id")


def with_predicate(rows: DataFrame, predicate: str) -> DataFrame:
    return rows.filter(F.col("predicate") == predicate)


def with_semtype(rows: DataFrame, semtype: str) -> DataFrame:
    return rows.filter((F.col("subtype") == semtype) | (F.col("objtype") == semtype))


def with_object(rows: DataFrame, concept: str) -> DataFrame:
    return rows.filter(F.lower(F.col("object").cast("string")) == concept.lower())


def summary(rows: DataFrame, concept=None) -> DataFrame:
    """(concept, kind, value, n) about each concept, or one: predicates, semantic types of both sides and objects that are concepts (``C...``) of its triples, and how many articles.

    A triple counts once, whatever its evidence, for its subject and for its object.
    """
    sides = lambda df, *more: df.select(F.explode(F.array("subject", "object")).alias("concept"), *more)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("subject", "object")})
    each = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
    kinds = F.array(each("predicate", "predicate"), each("semtype", "subtype"), each("semtype", "objtype"))
    # nearly every key is new to a task, so rows are dealt by their keys before they are grouped: a task holds its part, not what it has read
    parts = parts_for(rows)
    whole = predication_count(rows.repartition(parts, "subject", "object"))  # a subject's objects are counted there, too
    triples = sides(whole, "predicate", "subtype", "objtype")
    pmids = sides(rows, F.col("pmid").try_cast("long").alias("pmid"))
    named = whole.filter("object like 'C%'")
    others, own = named.filter("not (subject <=> object)"), named
    if concept is not None:
        triples, pmids = triples.filter(F.col("concept") == concept), pmids.filter(F.col("concept") == concept)
        others, own = others.filter(F.col("subject") == concept), own.filter(F.col("object") == concept)
    said = triples.repartition(2 * parts, "concept", "predicate").groupBy("concept", "predicate", "subtype", "objtype").agg(F.count("*").alias("n"))
    counts = said.select("concept", "n", F.explode(kinds).alias("v")).select("concept", "v.kind", "v.value", "n").repartition(parts, "concept", "kind", "value").groupBy("concept", "kind", "value").agg(F.sum("n").alias("n"))
    others = others.groupBy("subject", "object").agg(F.count("*").alias("n")).select(F.col("subject").alias("concept"), F.col("object").alias("value"), "n")
    own = own.groupBy("object").agg(F.sum(F.when(F.expr("subject <=> object"), 2).otherwise(1)).alias("n"))  # at its own side an object is a value, too
    objects = others.unionByName(own.select(F.col("object").alias("concept"), F.col("object").alias("value"), "n"))
    articles = pmids.repartition(2 * parts, "concept", "pmid").distinct().groupBy("concept").agg(F.count("pmid").alias("n"))
    told = lambda df, kind, value: df.select("concept", F.lit(kind).alias("kind"), value.alias("value"), "n")
    return counts.unionByName(told(objects, "concept", F.col("value"))).unionByName(told(articles, "pmids", F.lit("distinct")))


def related(rows: DataFrame, names: DataFrame, key: str, name: str, top: int, by_key: bool = False) -> DataFrame:
    """Objects by count, then name, or with ``by_key`` by count, then key (which is then a column too); those without a name are left out."""
    count = rows.groupBy(F.col("object").alias(key)).agg(F.count("*").alias("n"))
    found = count.join(names, key)
    if by_key:
        return found.select(key, name, "n").orderBy(F.desc("n"), key).limit(top)
    return found.select(name, "n").orderBy(F.desc("n"), name).limit(top)


def most_frequent(counts: DataFrame, top: int) -> DataFrame:
    """Counted triples by count, then subject, predicate, object."""
    return counts.orderBy(F.desc("cnt"), *TRIPLE).limit(top)


def resolved(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rows whose subject and object both are known concepts."""
    known = concepts.select("cui").distinct()
    return rows.join(known.withColumnRenamed("cui", "subject"), "subject", "left_semi").join(known.withColumnRenamed("cui", "object"), "object", "left_semi")
