"""Expanders that search for what they add, and expanders over links whose properties decide about them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.model import entity_id
from loomgraph.operators.expand import expander, facts
from loomgraph.operators.graph import without_tagged_neighbors
from loomgraph.operators.postings import search
from loomgraph.operators.search import first_n
from loomgraph.operators.trials import adverse_events

# What the properties of links are called, the level that a searched target must have, and how many a source gives.
ACTION, SOURCE, LEVEL = "Pharmalogical Action", "Data Source", "IDG Development Level"
NAMES = {"ligand": "IDG Ligand", "disease": "IDG Disease"}
INDICATION, CLINICAL = "DrugCentral Indication", "Tclin"
NODE_TYPES = {"target": "protein", "ligand": "drug", "disease": "disease"}
LINKED = {"protein": {"ligand": 20, "disease": 20}, "target": {"ligand": 20, "disease": 20}, "drug": {"target": 20, "disease": 20}, "disease": {"target": None, "ligand": 10}}
SEARCHED, PARTNERS, TEXTS, FOUND = 20, 10, 10, 100


def asked(nodes: DataFrame) -> DataFrame:
    """Nodes with the text they ask for: queries by their property ``term``, all others by their name; nodes without one are left out."""
    text = F.when(F.col("type") == "query", F.col("props")["term"]).otherwise(F.col("name"))
    return nodes.withColumn("asked", text).filter("asked is not null")


def _searched(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, top: int, phrase: bool) -> DataFrame:
    """(kgraph_id, id, found, place): the best texts for what each node asks for, as a phrase or by its words."""
    text = F.concat(F.lit('"'), F.translate("asked", '"', " "), F.lit('"')) if phrase else F.translate("asked", '"*', "  ")
    queries = asked(nodes).select(F.struct("kgraph_id", "id").alias("node"), text.alias("text"))
    return search(docs, id_col, text_col, queries, "node", "text", top).select("query.kgraph_id", "query.id", F.col("id").alias("found"), "place")


@expander("entry_search")
def entry_search(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Targets, ligands and diseases whose name has what a node asks for as a phrase, by the table ``entries`` (kind, ref, name, level): the 20 best of each kind, of those with a level only the clinical ones; ``resolve`` edges."""
    found = None
    for kind in NODE_TYPES:
        docs = tables["entries"].filter((F.col("kind") == kind) & (F.col("level").isNull() | (F.col("level") == CLINICAL))).groupBy("ref").agg(F.min("name").alias("name"))
        hits = _searched(nodes, docs, "ref", "name", SEARCHED, True).join(docs.select(F.col("ref").alias("found"), F.col("name").alias("found_name")), "found").withColumn("kind", F.lit(kind))
        found = hits if found is None else found.unionByName(hits)
    types = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])
    return facts(found, types[F.col("kind")], F.col("found_name"), F.col("found"), F.lit("resolve"), F.array("kind"))


def judged(links: DataFrame, given: str | None = None) -> DataFrame:
    """Links (…, kind, ref, properties: array of label, term, href) that count, with ``edge``, ``called`` (the name that a property gives) and ``href``.

    A ligand counts with an action or without any properties, a target with an action or at the clinical level, a disease as an indication; with a ``given`` type all of them do. The edge is the action or the given
    type in lower case, ``indication``, or ``assertion``. Of several actions the last counts.
    """
    props = F.coalesce("properties", F.array().cast(links.schema["properties"].dataType))
    of = lambda label: F.filter(props, lambda p: p["label"] == label)
    last = lambda label, field="term": F.get(of(label), F.size(of(label)) - 1)[field]
    type_ = F.lit(given).cast("string")
    action = F.coalesce(last(ACTION), type_)
    clinical = F.exists(of(LEVEL), lambda p: F.coalesce(p["term"] == CLINICAL, F.lit(False)))
    indicated = F.exists(of(SOURCE), lambda p: F.coalesce(p["term"] == INDICATION, F.lit(False)))
    by_kind = lambda ligand, target, disease: F.when(F.col("kind") == "ligand", ligand).when(F.col("kind") == "target", target).when(F.col("kind") == "disease", disease)
    keep = by_kind(action.isNotNull() | (F.size(props) == 0), action.isNotNull() | clinical, type_.isNotNull() | indicated)
    acted = F.coalesce(F.lower(action), F.lit("assertion"))
    return links.withColumns({
        "edge": by_kind(acted, acted, F.coalesce(type_, F.lit("indication"))), "called": by_kind(last(NAMES["ligand"]), F.lit(None).cast("string"), last(NAMES["disease"])), "href": F.when(F.col("kind") == "ligand", last(ACTION, "href")), "keep": keep,
    }).filter(F.coalesce("keep", F.lit(False))).drop("keep")


def _linked(rows: DataFrame, tables: Mapping[str, DataFrame], given: str | None = None) -> tuple[DataFrame, DataFrame]:
    names = tables["entries"].groupBy("kind", "ref").agg(F.min("name").alias("entry_name"))
    live = judged(rows, given).join(names, ["kind", "ref"], "left")
    types = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])
    href = F.map_filter(F.create_map(F.lit("href"), F.col("href")), lambda _, v: v.isNotNull())
    return facts(live, types[F.col("kind")], F.coalesce("called", "entry_name"), F.col("ref"), F.col("edge"), F.array("kind"), href)


@expander("kind_links")
def kind_links(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What targets, drugs and diseases are linked with, by the tables ``kind_links`` (uri, turn, kind, ref, properties) and ``entries``: the first links of each kind that their type asks for, of which those that count stay.
    Nodes without such a uri get the first 20 entries of their own kind with their name, by ref, and a ``resolve`` edge."""
    rows = nodes.select("kgraph_id", "id", "type", "uri").join(tables["kind_links"], "uri")
    wanted = F.create_map(*[F.lit(x) for t, kinds in LINKED.items() for k, n in kinds.items() for x in (f"{t} {k}", n or 1_000_000)])
    rows = rows.withColumn("most", wanted[F.concat_ws(" ", "type", "kind")]).filter("most is not null")
    place = F.row_number().over(Window.partitionBy("kgraph_id", "id", "kind").orderBy("turn", "ref"))
    capped = rows.filter("most < 1000000").withColumn("_place", place).filter("_place <= most").drop("_place")
    held = capped.unionByName(rows.filter("most >= 1000000"))  # all of a kind: no window
    n, e = _linked(held, tables)
    kinds = F.create_map(*[F.lit(x) for kind, t in NODE_TYPES.items() for x in (t, kind)])
    lone = nodes.filter("name is not null").join(tables["entries"].select(F.col("ref").alias("uri")).distinct(), "uri", "left_anti").select("kgraph_id", "id", "name", kinds[F.col("type")].alias("kind"))
    same = first_n(lone.join(tables["entries"].select("kind", "ref", "name").distinct(), ["kind", "name"]), ["kgraph_id", "id"], 20, "ref")
    n2, e2 = facts(same, F.lit(None).cast("string"), F.col("name"), F.col("ref"), F.lit("resolve"), F.array("kind"))
    types = same.select("kgraph_id", entity_id(F.col("kgraph_id"), F.col("ref")).alias("id"), F.col("kind")).distinct()
    typed = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])
    n2 = n2.drop("type").join(types, ["kgraph_id", "id"]).withColumn("type", typed[F.col("kind")])
    return n.unionByName(n2.select(n.columns)), e.unionByName(e2)


@expander("partners")
def partners(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The first ten partners of each interaction record of a target, by the table ``partners`` (uri, record, turn, ref, properties): ``ppi`` edges, or with the action that a property tells."""
    rows = nodes.select("kgraph_id", "id", "uri").join(tables["partners"], "uri")
    return _linked(first_n(rows, ["kgraph_id", "id", "record"], PARTNERS, "turn", "ref").withColumn("kind", F.lit("target")), tables, "ppi")


@expander("gene_texts")
def gene_texts(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The articles of a target's first texts, by the tables ``texts`` (uri, turn, pmid) and ``articles`` (pmid, title): article nodes, and edges with their uri as type."""
    first = first_n(nodes.select("kgraph_id", "id", "uri").join(tables["texts"], "uri"), ["kgraph_id", "id"], TEXTS, "turn", "pmid")
    rows = first.join(tables["articles"].groupBy("pmid").agg(F.min("title").alias("title")), "pmid")
    uri = F.concat(F.lit("article/"), F.col("pmid").cast("string"))
    return facts(rows, F.lit("article"), F.col("title"), uri, uri, F.array(F.lit("texts")))


@expander("name_concepts")
def name_concepts(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Concepts that have what a node asks for as a name, in any case, by the tables ``concept_names`` (name, cui) and ``concepts`` (cui, name, semantic_types): nodes tagged by the names of their semantic types, ``resolve`` edges that
    tell the name that matched."""
    names = tables["concept_names"].groupBy(F.lower("name").alias("low"), "cui").agg(F.min("name").alias("matched"))
    rows = asked(nodes).select("kgraph_id", "id", F.lower("asked").alias("low")).join(names, "low").join(tables["concepts"].select("cui", "name", "semantic_types"), "cui")
    tags = F.array_sort(F.coalesce("semantic_types", F.array().cast("array<string>")))
    return facts(rows, F.lit("concept"), F.col("name"), F.col("cui"), F.lit("resolve"), tags, F.create_map(F.lit("name"), F.col("matched")))


@expander("article_search")
def article_search(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Headings with exactly the label that a node asks for, the best articles for its words, and the genes of these, by the tables ``labels`` (label, ui, name), ``articles`` (pmid, title, text) and ``article_genes`` (pmid, gene, symbol).
    Edges to headings have their ui as type, those to articles and genes ``resolve``."""
    seeds = asked(nodes)
    heads = facts(seeds.select("kgraph_id", "id", F.col("asked").alias("label")).join(tables["labels"], "label"), F.lit("mesh"), F.col("name"), F.col("ui"), F.col("ui"), F.array(F.lit("mesh")))
    hits = _searched(nodes, tables["articles"], "pmid", "text", FOUND, False).withColumnRenamed("found", "pmid")
    titles = tables["articles"].groupBy("pmid").agg(F.min("title").alias("title"))
    texts = facts(hits.join(titles, "pmid"), F.lit("article"), F.col("title"), F.concat(F.lit("article/"), F.col("pmid").cast("string")), F.lit("resolve"), F.array(F.lit("articles")))
    genes = hits.join(tables["article_genes"], "pmid").select("kgraph_id", "id", "gene", "symbol").distinct()
    genes = facts(genes, F.lit("gene"), F.col("symbol"), F.concat(F.lit("gene/"), F.col("gene").cast("string")), F.lit("resolve"), F.array(F.lit("genes")))
    return tuple(a.unionByName(b).unionByName(c) for a, b, c in zip(heads, texts, genes, strict=True))


def anchored_drugs(nodes: DataFrame, edges: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What drugs bring, by their anchors: (nodes, edges), from the tables ``uniis`` (unii, preferred_term, name) and ``outcomes`` (unii, name, case_count, ror, prr).

    A drug's anchor is the entry whose preferred term is its name in any case, joined to it by ``resolve``; if the drug is the entry itself, it is its own. An anchor that has a neighbour tagged ``aeolus`` has been there before; each other
    one gets its ten adverse events that count most, tagged so. Names without an entry bring nothing.
    """
    drugs = nodes.filter("type = 'drug' and name is not null").select("kgraph_id", "id", F.lower("name").alias("term"))
    rows = drugs.join(tables["uniis"].select(F.lower("preferred_term").alias("term"), "unii", F.col("name").alias("entry")), "term")
    uri = F.concat(F.lit("unii/"), F.col("unii"))
    n, e = facts(rows, F.lit("drug"), F.col("entry"), uri, F.lit("resolve"), F.array(F.lit("unii")))
    anchors = rows.select("kgraph_id", entity_id(F.col("kgraph_id"), uri).alias("id"), "unii").distinct()
    waiting = without_tagged_neighbors(anchors, edges, nodes, "aeolus")
    best = adverse_events(tables["outcomes"], ["unii"])
    props = F.map_from_arrays(F.array(F.lit("case_count"), F.lit("prr"), F.lit("ror")), F.array(*[F.col(c).cast("string") for c in ("case_count", "prr", "ror")]))
    n2, e2 = facts(waiting.join(best, "unii"), F.lit("adverse"), F.col("name"), F.concat(F.lit("adverse/"), "name"), F.lit("assertion"), F.array(F.lit("aeolus")), props)
    return n.unionByName(n2), e.unionByName(e2)
