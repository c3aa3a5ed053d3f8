"""Expanders: what adds nodes and edges to a graph. An expander is a function (nodes, tables) -> (new nodes, new edges)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import before_last_space, strip_pipe, unquote
from loomgraph.model import entity_id
from loomgraph.operators.graph import first_per_key, upsert_edges, upsert_nodes
from loomgraph.operators.rounds import written
from loomgraph.operators.search import first_n
from loomgraph.operators.trials import adverse_events

#: New nodes, new edges, and perhaps changes of the nodes it started from (seeds.UPDATES).
Expander = Callable[[DataFrame, Mapping[str, DataFrame]], tuple[DataFrame, ...]]
REGISTRY: dict[str, Expander] = {}


def expander(name: str) -> Callable[[Expander], Expander]:
    def register(f: Expander) -> Expander:
        REGISTRY[name] = f
        return f

    return register


def facts(rows: DataFrame, type_: Column, name: Column, uri: Column, edge: Column, tags: Column, props: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from rows that have the seed's kgraph_id and id: one node a row, by its uri, and an edge from the seed unless it is the node itself."""
    none = F.create_map().cast("map<string,string>")
    rows = rows.withColumns({"_id": entity_id(F.col("kgraph_id"), uri), "_name": name, "_uri": uri, "_type": type_, "_edge": edge, "_tags": tags, "_props": none if props is None else props})
    nodes = rows.select("kgraph_id", F.col("_id").alias("id"), F.col("_type").alias("type"), F.col("_name").alias("name"), F.col("_uri").alias("uri"), F.lit(0).cast("long").alias("created"), F.col("_tags").alias("tags"), F.array().cast("array<string>").alias("synonyms"), none.alias("props"), F.col("_id").alias("seq"))
    edges = rows.filter("id != _id").select("kgraph_id", F.xxhash64("id", "_id", "_edge").alias("_e"), F.col("id").alias("src"), F.col("_id").alias("dst"), F.col("_edge").alias("type"), F.lit(False).alias("directed"), F.col("_props").alias("props"), F.xxhash64("id", "_id", "_edge").alias("seq"))
    return nodes, edges.withColumnRenamed("_e", "id")


@expander("links")
def linked(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Targets, ligands and diseases by the table ``links`` (uri, kind, ref, name, action): the edge's type is the action, or assertion."""
    rows = nodes.select("kgraph_id", "id", "uri").join(tables["links"], "uri")
    return facts(rows, F.col("kind"), F.col("name"), F.col("ref"), F.coalesce(F.lower("action"), F.lit("assertion")), F.array("kind"))


@expander("relations")
def related_concepts(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Concepts at the other end of the table ``relations`` (uri, rui, label, cui, name)."""
    rows = nodes.select("kgraph_id", "id", "uri").join(tables["relations"], "uri")
    return facts(rows, F.lit("concept"), F.col("name"), F.col("cui"), F.col("rui"), F.array("label"), F.create_map(F.lit("scope"), F.col("label")))


@expander("predications")
def predicated(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Objects of the predications of concepts, by the table ``predications`` (uri, predicate, object, name, pmid)."""
    rows = nodes.select("kgraph_id", "id", "uri").join(tables["predications"], "uri")
    return facts(rows, F.lit("concept"), F.col("name"), F.col("object"), F.col("predicate"), F.array(F.lit("predication")), F.create_map(F.lit("article"), F.col("pmid").cast("string")))


@expander("adverse")
def adverse(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The ten adverse events of each drug that count most, by the table ``outcomes`` (drug, name, case_count, ror, prr); drugs by name in any case."""
    drugs = nodes.select("kgraph_id", "id", F.lower("name").alias("_drug"))
    best = adverse_events(tables["outcomes"], ["drug"]).withColumn("_drug", F.lower("drug"))
    props = F.map_from_arrays(F.array(F.lit("case_count"), F.lit("prr"), F.lit("ror")), F.array(*[F.col(c).cast("string") for c in ("case_count", "prr", "ror")]))
    return facts(drugs.join(best, "_drug"), F.lit("adverse"), F.col("name"), F.concat(F.lit("adverse/"), "name"), F.lit("assertion"), F.array(F.lit("aeolus")), props)


@expander("headings")
def article_headings(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Headings of articles, by the table ``headings`` (uri, ui, name); edges have the heading's ui as their type."""
    rows = nodes.select("kgraph_id", "id", "uri").join(tables["headings"], "uri")
    return facts(rows, F.lit("mesh"), F.col("name"), F.col("ui"), F.col("ui"), F.array(F.lit("mesh")))


@expander("keywords")
def keyword_concepts(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Concepts by keyword, from the table ``keywords`` (keyword, clique, name, categories); the type is the categories."""
    rows = nodes.select("kgraph_id", "id", F.lower("name").alias("keyword")).join(tables["keywords"], "keyword")
    return facts(rows, F.array_join("categories", ";"), F.col("name"), F.col("clique"), F.lit("resolve"), F.col("categories"))


@expander("article_targets")
def article_targets(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The 20 first targets by ref of each node with a property pmid, by the table ``publications`` (pmid, ref, name)."""
    rows = nodes.select("kgraph_id", "id", F.col("props")["pmid"].alias("pmid")).join(tables["publications"].select(F.col("pmid").cast("string").alias("pmid"), "ref", "name").distinct(), "pmid")
    return facts(first_n(rows, ["kgraph_id", "id"], 20, "ref"), F.lit("target"), F.col("name"), F.col("ref"), F.lit("resolve"), F.array(F.lit("publication")))


@expander("interactions")
def interacting(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The ten first drugs that drugs interact with, by the table ``interactions`` (uri, turn, ref, name, description)."""
    rows = first_n(nodes.select("kgraph_id", "id", "uri").join(tables["interactions"], "uri"), ["kgraph_id", "id"], 10, "turn", "ref")
    return facts(rows, F.lit("drug"), F.col("name"), F.col("ref"), F.lit("ddi"), F.array(F.lit("drugbank")), F.create_map(F.lit("description"), F.col("description")))


def dispatched(nodes: DataFrame, rules: Mapping[str, list[str]], default: list[str]) -> dict[str, DataFrame]:
    """The nodes that each expander gets: those of a type that the rules name go to the expanders of the type, all others that have a name to the default ones."""
    named = F.coalesce(F.col("type").isin(*rules), F.lit(False))
    out = {}
    for name in dict.fromkeys([*chain.from_iterable(rules.values()), *default]):
        mine = F.col("type").isin(*[t for t, names in rules.items() if name in names])
        out[name] = nodes.filter(mine | (~named & F.col("name").isNotNull()) if name in default else mine)
    return out


def expand(nodes: DataFrame, edges: DataFrame, tables: Mapping[str, DataFrame], names: list[str], rounds: int = 1, rules: Mapping[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph after some rounds of the expanders; each round looks at the nodes that the one before added, and stops where none were. With rules (node type -> expanders)
    ``names`` are for named nodes of the types that these leave out."""
    front = nodes
    for _ in range(rounds):
        fronts = dict.fromkeys(names, front) if rules is None else dispatched(front, rules, names)
        found = [REGISTRY[name](mine, tables) for name, mine in fronts.items()]
        # all that a round finds goes into the graph at once, the first expander's node or edge first
        new = [reduce(DataFrame.unionByName, [f[i].select(have.columns).withColumn("_turn", F.lit(t)) for t, f in enumerate(found)]) for i, have in enumerate((nodes, edges))]
        grown = upsert_nodes(nodes, first_per_key(new[0], ["kgraph_id", "id"], "_turn", "seq").drop("_turn"), "id")
        updates = [f[2] for f in found if len(f) > 2]
        if updates:  # what expanders change in the nodes that they started from
            from loomgraph.operators.seeds import update_nodes

            grown = update_nodes(grown, updates)
        linked_ = upsert_edges(edges, first_per_key(new[1], ["kgraph_id", "id"], "_turn", "seq").drop("_turn"))
        if rounds == 1:  # nothing is read again
            return grown, linked_
        grown, linked_ = written(grown), written(linked_)
        front = grown.join(nodes.select("kgraph_id", "id"), ["kgraph_id", "id"], "left_anti")
        nodes, edges = grown, linked_
        if front.isEmpty():
            break
    return nodes, edges


def from_json(rows: DataFrame, column: str, schema: str, each: str | None = None) -> DataFrame:
    """Resolver: JSON texts as rows of a schema; ``each`` names an array of which every element becomes a row."""
    out = rows.withColumn("_json", F.from_json(column, schema))
    return out.select("*", F.explode(f"_json.{each}").alias("item")).drop("_json", column) if each else out.select("*", "_json.*").drop("_json", column)


def bridge_ids(aliases: Column, synonyms: Column, prefix: str) -> Column:
    """Distinct ids with a prefix among ``ns:id`` aliases and plain synonyms."""
    ids = F.transform(aliases, lambda a: F.substring_index(a, ":", -1))
    return F.array_distinct(F.filter(F.concat(ids, synonyms), lambda x: x.startswith(prefix)))


def links_with(links: DataFrame, kinds: Mapping[str, tuple[str, list[str]] | None]) -> DataFrame:
    """Links (kind, ref, properties: array of label and term) of the kinds asked for: those that have one of some terms under a label, or all of a kind (None)."""
    def held(label: str, terms: list[str]) -> Column:
        return F.coalesce(F.exists("properties", lambda p: (p["label"] == label) & p["term"].isin(*terms)), F.lit(False))

    keep = [(F.col("kind") == kind) & (F.lit(True) if wanted is None else held(*wanted)) for kind, wanted in kinds.items()]
    return links.filter(reduce(Column.__or__, keep, F.lit(False)))


def protein_targets(drugs: DataFrame, column: str) -> DataFrame:
    """(…, name, uniprot, action) of the curated proteins among a drug's targets (array of source, name, uniprot, actions): Swiss-Prot entries with an action, the first of which is the edge's type."""
    each = drugs.select(*[c for c in drugs.columns if c != column], F.explode(column).alias("_t")).filter("_t.source = 'Swiss-Prot' and _t.actions is not null")
    return each.select("*", F.col("_t.name").alias("name"), F.col("_t.uniprot").alias("uniprot"), F.get("_t.actions", F.lit(0)).alias("action")).drop("_t")


@expander("drug_targets")
def targeted(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Proteins that drugs act on, by the table ``drugs`` (uri, targets)."""
    rows = protein_targets(nodes.select("kgraph_id", "id", "uri").join(tables["drugs"].select("uri", "targets"), "uri"), "targets")
    return facts(rows, F.lit("protein"), F.col("name"), F.concat(F.lit("drugbank/"), "uniprot"), F.col("action"), F.array(F.lit("drugbank")))


@expander("mechanisms")
def mechanisms(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Proteins by the mechanisms of molecules, from the table ``mechanisms`` (uri, mechanism_of_action, target_id, action_type): the name is the mechanism without its last word."""
    rows = nodes.select("kgraph_id", "id", "uri").join(tables["mechanisms"], "uri")
    props = F.create_map(F.lit("mechanism"), unquote(F.col("mechanism_of_action")))
    return facts(rows, F.lit("protein"), unquote(before_last_space(F.col("mechanism_of_action"))), F.concat(F.lit("target/"), unquote(F.col("target_id"))), unquote(F.col("action_type")), F.array(F.lit("mechanism")), props)


def article_predications(articles: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What articles (kgraph_id, id, pmid) say, by rows (pmid, subject, predicate, object, sentence): concepts, one each; an edge for every predication, with its article and
    sentence as context; and edges from the article to the concepts, one each, with the concept as type. Piped concepts count by their first part."""
    rows = rows.withColumns({c: strip_pipe(F.col(c)) for c in ("subject", "object")})
    said = articles.select("kgraph_id", F.col("id").alias("article"), "pmid").join(rows, "pmid")
    node = lambda c: entity_id(F.col("kgraph_id"), F.col(c))
    ends = said.select("kgraph_id", "article", F.explode(F.array("subject", "object")).alias("uri")).distinct()
    concepts = ends.select("kgraph_id", "uri").distinct().select("kgraph_id", node("uri").alias("id"), F.lit("concept").alias("type"), "uri")
    context = F.create_map(F.lit("article"), F.col("pmid").cast("string"), F.lit("context"), F.col("sentence").cast("string"))
    typed = said.select("kgraph_id", node("subject").alias("src"), node("object").alias("dst"), F.col("predicate").alias("type"), context.alias("props"))
    return concepts, typed, ends.select("kgraph_id", F.col("article").alias("src"), node("uri").alias("dst"), F.col("uri").alias("type"))
