"""Expanders that change the nodes they start from, and predications as a part of a graph.

Nodes and the tables that they meet grow alike, and a few of their columns soon look small enough to broadcast: such joins are by merge, or by hash beside rows that are far more, so no table passes the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import before_last_space, put_all, strip_pipe, unquote
from loomgraph.model import entity_id
from loomgraph.operators.expand import bridge_ids, expander, facts
from loomgraph.operators.graph import upsert_edges, upsert_nodes
from loomgraph.operators.predications import without_blacklisted
from loomgraph.operators.rounds import stored

#: A change of a property of a node: put in its place, or added behind a comma.
UPDATES = "kgraph_id long, id long, key string, value string, how string, seq long"
EQUIVALENT = "is equivalent to"
#: Seeds and molecules of one name that are put together at a time.
SEEDS, OFFERS = 4096, 512


def update_nodes(nodes: DataFrame, updates: list[DataFrame]) -> DataFrame:
    """Nodes with the changes of some expanders (columns of UPDATES), those of the first expander first, each in the order of ``seq``, then value.

    A ``put`` takes the place of what is there, from before or from an earlier change; an ``add`` comes behind it with a comma. What can't matter, changes before a key's last ``put``, is left out before a key's changes are
    gathered. Null keys and values change nothing; changes of nodes that aren't there are left out.
    """
    each = reduce(DataFrame.unionByName, [u.select("kgraph_id", "id", "key", "value", "how", "seq", F.lit(i).alias("turn")) for i, u in enumerate(updates)]).filter("key is not null and value is not null")
    key = ["kgraph_id", "id", "key"]
    at = F.struct("turn", "seq", "value")
    last = each.filter("how = 'put'").groupBy(*key).agg(F.max(at).alias("_put"))
    live = each.join(last.hint("merge"), key, "left").filter("_put is null or (how = 'put' and struct(turn, seq, value) = _put) or (how != 'put' and struct(turn, seq, value) > _put)")
    put = F.max(F.when(F.col("how") == "put", F.col("value")))
    added = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("how") != "put", at))), lambda x: x["value"]), ",")
    merged = live.dropDuplicates([*key, "how", "turn", "seq", "value"]).groupBy(*key).agg(put.alias("put"), added.alias("added"))
    per_node = merged.groupBy("kgraph_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("put", "added")))).alias("_new"))
    joined = nodes.join(per_node.hint("merge"), ["kgraph_id", "id"], "left")
    base = lambda k, v: F.coalesce(v["put"], F.col("props")[k])
    value = lambda k, v: F.when(v["added"] == "", base(k, v)).otherwise(F.concat_ws(",", base(k, v), v["added"]))
    return joined.withColumn("props", put_all(F.col("props"), F.transform_values("_new", value))).select(nodes.columns)


def _grown(nodes: DataFrame, edges: DataFrame, tables: Mapping[str, DataFrame], names: list[str]) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None, list[DataFrame]]:
    """What `grown` gives, but of the edges that the search by name makes only those that may be there already; for all others the seeds and the molecules that `_met` puts together."""
    from loomgraph.operators.expand import REGISTRY

    found = {name: REGISTRY[name](nodes, tables) for name in names}
    made = [f[0].select(nodes.columns) for f in found.values()]
    new = reduce(DataFrame.unionByName, [f[1].select(edges.columns) for name, f in found.items() if name != "drug_search"], edges.limit(0))
    apart = None
    if "drug_search" in names:
        more, *apart = _search_apart(nodes, tables, edges.unionByName(new))
        new = new.unionByName(more.select(edges.columns))
    typed, untyped = new.filter("type is not null"), new.filter("type is null").dropDuplicates(["kgraph_id", "id"])  # equal ids are equal ends and types, so the upsert keeps one
    joined = upsert_edges(edges, typed.unionByName(untyped))
    return upsert_nodes(nodes, reduce(DataFrame.unionByName, made).dropDuplicates(["kgraph_id", "id"]), "id"), joined, apart, [f[2] for f in found.values() if len(f) > 2]


def grown(nodes: DataFrame, edges: DataFrame, tables: Mapping[str, DataFrame], names: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One round of expanders: the graph with their nodes and edges, and the changes that they make to the nodes they started from, which aren't applied yet."""
    more, joined, apart, updates = _grown(nodes, edges, tables, names)
    return more, joined.unionByName(_equivalents(_met(*apart)).select(edges.columns)) if apart else joined, updates


def grown_links(nodes: DataFrame, edges: DataFrame, tables: Mapping[str, DataFrame], names: list[str]) -> DataFrame:
    """(kgraph_id, src, dst, uri, type): the edges of `grown`, each with the uri of the node that it leads to. Uris join the molecules of the search before these meet the seeds that have their name, of which there may be very many."""
    more, joined, apart, _ = _grown(nodes, edges, tables, names)
    uris = more.select("kgraph_id", F.col("id").alias("dst"), "uri")
    links = joined.select("kgraph_id", "src", "dst", "type").join(uris.hint("shuffle_hash"), ["kgraph_id", "dst"]).select("kgraph_id", "src", "dst", "uri", "type")
    if not apart:
        return links
    seeds, offers = apart
    met = _met(seeds, offers.join(uris.hint("merge"), ["kgraph_id", "dst"]), "uri")
    return links.unionByName(met.select("kgraph_id", F.col("id").alias("src"), "dst", "uri", F.lit(EQUIVALENT).alias("type")))


def expand_with_updates(nodes: DataFrame, edges: DataFrame, tables: Mapping[str, DataFrame], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round of expanders that give nodes, edges and updates: all into the graph, and the changes of the nodes they started from, in the order of ``names``."""
    more, joined, updates = grown(nodes, edges, tables, names)
    return update_nodes(more, updates) if updates else more, joined


def molecule_ids(nodes: DataFrame, prefix: str = "CHEMBL") -> DataFrame:
    """(kgraph_id, id, molecule) of nodes with molecule ids among their synonyms (``ns:id`` or plain)."""
    return nodes.select("kgraph_id", "id", F.explode(bridge_ids(F.col("synonyms"), F.array().cast("array<string>"), prefix)).alias("molecule"))


def _facts_once(rows: DataFrame, columns: list[str], *told: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from rows as `facts` tells them, the nodes once for each graph and values of the columns that they are made of, not for each seed."""
    once = rows.select("kgraph_id", *columns).distinct().withColumn("id", F.lit(None).cast("long"))
    return facts(once, *told)[0], facts(rows, *told)[1]


def _drug(uri: Column) -> Column:
    return F.concat(F.lit("molecule/"), uri)


@expander("drug_forms")
def drug_forms(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The named forms of molecules, by the tables ``forms`` (molecule, form) and ``molecules`` (molecule, name, synonyms): drugs that the node is equivalent to."""
    named = tables["molecules"].select(F.col("molecule").alias("form"), "name").filter("name is not null")
    rows = molecule_ids(nodes).join(tables["forms"].hint("merge"), "molecule").join(named.hint("merge"), "form")
    told = F.lit("drug"), F.col("name"), _drug(F.col("form")), F.lit(EQUIVALENT), F.array(F.lit("molecules"))
    found, edges = _facts_once(rows, ["form", "name"], *told)
    return found.withColumn("synonyms", F.array(F.substring_index("uri", "/", -1))), edges


@expander("drug_actions")
def drug_actions(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The proteins that molecules act on, by the table ``actions`` (molecule, seq, mechanism, target, action); the mechanisms are added to the node's property ``mechanism``, with commas, in the order of seq."""
    said = molecule_ids(nodes).hint("shuffle_hash").join(tables["actions"], "molecule")
    plain = {c: unquote(F.col(c)) for c in ("mechanism", "target", "action")}
    rows, once = said.withColumns(plain), said.select("kgraph_id", F.lit(None).cast("long").alias("id"), *plain).distinct().withColumns(plain)
    told = F.lit("protein"), before_last_space(F.col("mechanism")), F.concat(F.lit("target/"), "target"), F.col("action"), F.array(F.lit("molecules"))
    found, edges = facts(once, *told)[0], facts(rows, *told)[1]
    changes = rows.select("kgraph_id", "id", F.lit("mechanism").alias("key"), F.col("mechanism").alias("value"), F.lit("add").alias("how"), "seq")
    return found.withColumn("synonyms", F.array(F.substring_index("uri", "/", -1))), edges, changes


@expander("drug_targets_of")
def drug_targets_of(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The targets tested with molecules, by the table ``targets`` (molecule, target, name)."""
    rows = molecule_ids(nodes).hint("shuffle_hash").join(tables["targets"].filter("name is not null"), "molecule")
    return _facts_once(rows, ["target", "name"], F.lit("protein"), F.col("name"), F.concat(F.lit("target/"), "target"), F.lit("target of"), F.array(F.lit("molecules")))


def _asked(nodes: DataFrame) -> DataFrame:
    known = molecule_ids(nodes).select("kgraph_id", "id").distinct()
    return nodes.filter("name is not null").join(known.hint("merge"), ["kgraph_id", "id"], "left_anti").select("kgraph_id", "id", F.lower("name").alias("asked"))


def _named(molecules: DataFrame) -> DataFrame:
    return molecules.select("molecule", "name", F.explode(F.array_distinct(F.transform(F.array_compact(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))), F.lower))).alias("asked"))


def _same_drugs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return facts(rows, F.lit("drug"), F.coalesce("name", "molecule"), _drug(F.col("molecule")), F.lit(EQUIVALENT), F.array(F.lit("molecules")))


@expander("drug_search")
def drug_search(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For nodes without a molecule id: the molecules whose name or synonym is the node's name in any case, by the table ``molecules``; drugs that the node is equivalent to. A molecule without a name has its id as one. The node's property ``found``
    tells the smallest id."""
    asked, named = _asked(nodes), _named(tables["molecules"])
    # a name that many nodes ask for has the same molecules for all: only edges are made for each pair
    _, edges = _same_drugs(asked.join(named.hint("merge"), "asked"))
    found, _ = _same_drugs(named.join(asked.select("kgraph_id", "asked").distinct().hint("merge"), "asked").select("kgraph_id", F.lit(None).cast("long").alias("id"), "molecule", "name").distinct())
    least = named.groupBy("asked").agg(F.min("molecule").alias("value"))
    changes = asked.join(least.hint("merge"), "asked").select("kgraph_id", "id", F.lit("found").alias("key"), "value", F.lit("put").alias("how"), F.lit(0).cast("long").alias("seq"))
    return found, edges, changes


def _search_apart(nodes: DataFrame, tables: Mapping[str, DataFrame], others: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges of `drug_search` in two parts: those whose ends another edge may join, among ``others`` or of the search itself, as rows; and for the rest, which are surely single, the seeds (kgraph_id, asked, id, without: ids of molecules that they don't
    meet here) and the molecules (kgraph_id, asked, dst) of which all that share a name are joined.

    Seeds that are there twice, or that have no id or graph, have all their edges in the first part."""
    named, whole = _named(tables["molecules"]), "kgraph_id is not null and id is not null"
    asked = stored(_asked(nodes))
    once = asked.filter(whole).groupBy("kgraph_id", "id").agg(F.min("asked").alias("asked"), F.count("*").alias("n"))
    many = asked.filter(whole).join(once.filter("n > 1").hint("merge"), ["kgraph_id", "id"], "left_semi").unionByName(asked.filter(f"not ({whole})"))
    plain = _same_drugs(many.join(named.hint("merge"), "asked"))[1]
    seeds = stored(once.filter("n = 1").drop("n"))
    offers = named.join(seeds.select("kgraph_id", "asked").distinct().hint("merge"), "asked").select("kgraph_id", "asked", entity_id(F.col("kgraph_id"), _drug(F.col("molecule"))).alias("dst"))
    offers = stored(offers.distinct())
    pair = ["kgraph_id", "id", "dst"]
    joined = others.unionByName(plain.select(others.columns)).filter(F.col("type") == EQUIVALENT)
    ends = joined.select("kgraph_id", F.explode(F.array(F.struct(F.col("src").alias("id"), "dst"), F.struct(F.col("dst").alias("id"), F.col("src").alias("dst")))).alias("e")).select("kgraph_id", "e.id", "e.dst").distinct()
    there = ends.join(seeds.hint("merge"), ["kgraph_id", "id"]).join(offers.hint("merge"), ["kgraph_id", "asked", "dst"]).select(pair)
    # two seeds that are molecules, too, may find each other
    both = seeds.join(offers.select("kgraph_id", F.col("dst").alias("id")).hint("merge"), ["kgraph_id", "id"], "left_semi")
    again = offers.join(seeds.select("kgraph_id", F.col("id").alias("dst")).hint("merge"), ["kgraph_id", "dst"], "left_semi")
    compared = stored(there.unionByName(both.join(again.hint("merge"), ["kgraph_id", "asked"]).select(pair)).distinct())
    without = compared.groupBy("kgraph_id", "id").agg(F.collect_set("dst").alias("without"))
    rows = _equivalents(compared)
    return rows.unionByName(plain.select(rows.columns)), seeds.join(without.hint("merge"), ["kgraph_id", "id"], "left"), offers


def _equivalents(pairs: DataFrame) -> DataFrame:
    """The edges that `facts` makes of seeds and molecules (kgraph_id, id, dst)."""
    key = F.xxhash64("id", "dst", F.lit(EQUIVALENT))
    none = F.create_map().cast("map<string,string>")
    return pairs.filter("id != dst").select("kgraph_id", key.alias("_e"), F.col("id").alias("src"), "dst", F.lit(EQUIVALENT).alias("type"), F.lit(False).alias("directed"), none.alias("props"), key.alias("seq")).withColumnRenamed("_e", "id")


def _met(seeds: DataFrame, offers: DataFrame, *held: str) -> DataFrame:
    """(kgraph_id, id, dst, held) of all seeds and molecules that share a name, but those of ``without`` and a seed with itself. Both come in blocks, and pairs are made of two blocks at a time where these are read."""
    on = ["kgraph_id", "asked"]

    def blocks(rows: DataFrame, key: str, size: int, *columns: str) -> DataFrame:
        sizes = rows.groupBy(*on).agg(F.ceil(F.count("*") / size).alias("_blocks"))
        dealt = rows.join(sizes.hint("merge"), on).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")))
        return dealt.groupBy(*on, "_block").agg(F.collect_list(F.struct(key, *columns)).alias(key)).drop("_block")

    spark = seeds.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = blocks(seeds, "id", SEEDS, "without").join(blocks(offers, "dst", OFFERS, *held).hint("merge"), on).repartition(parts)
    each = met.select("kgraph_id", F.explode("id").alias("s"), "dst").select("kgraph_id", "s", F.explode("dst").alias("m"))
    free = each.filter(F.col("s.id") != F.col("m.dst")).filter(F.coalesce(~F.array_contains("s.without", F.col("m.dst")), F.lit(True)))
    return free.select("kgraph_id", "s.id", "m.dst", *[f"m.{c}" for c in held])


def add_predications(nodes: DataFrame, edges: DataFrame, articles: DataFrame, rows: DataFrame, concepts: DataFrame, semtypes: list[str] = (), black: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A graph with what its articles (kgraph_id, id, pmid) say, by rows (pmid, predication, subject, subtype, predicate, object, objtype, sentence) and concepts (cui, name).

    Piped concepts count by their first part; predications with a type or concept of a black list, or with a concept that isn't known, are left out. Both concepts become nodes where they are none yet; every predication
    becomes an edge of its own with its article and sentence, also where one joins the two already; and the article gets an edge to each concept, with the concept as type, where it has none.
    """
    rows = without_blacklisted(rows.withColumns({c: strip_pipe(F.col(c)) for c in ("subject", "object")}), semtypes, black)
    named = concepts.groupBy("cui").agg(F.min("name").alias("name"))
    side = lambda c: named.select(F.col("cui").alias(c), F.col("name").alias(f"{c}_name"))
    said = articles.select("kgraph_id", F.col("id").alias("article"), "pmid").join(rows, "pmid").join(side("subject"), "subject").join(side("object"), "object")
    node = lambda c: entity_id(F.col("kgraph_id"), F.col(c))
    both = F.explode(F.array(F.struct(F.col("subject").alias("uri"), F.col("subject_name").alias("name")), F.struct(F.col("object").alias("uri"), F.col("object_name").alias("name"))))
    ends = said.select("kgraph_id", "article", both.alias("e")).select("kgraph_id", F.col("article").alias("id"), "e.uri", "e.name").distinct()
    found, members = facts(ends, F.lit("concept"), F.col("name"), F.col("uri"), F.col("uri"), F.array(F.lit("predications")))
    key = F.xxhash64("article", "predication", "subject", "predicate", "object", "sentence")
    typed = said.select(
        "kgraph_id", key.alias("id"), node("subject").alias("src"), node("object").alias("dst"), F.col("predicate").alias("type"), F.lit(True).alias("directed"),
        F.map_filter(F.create_map(F.lit("article"), F.col("pmid").cast("string"), F.lit("context"), F.col("sentence")), lambda _, v: v.isNotNull()).alias("props"), key.alias("seq"),
    )
    typed = typed.dropDuplicates(["kgraph_id", "id"]).join(edges.select("kgraph_id", "id"), ["kgraph_id", "id"], "left_anti").select(edges.columns)  # said again: the same edge
    grown = upsert_nodes(nodes, found.dropDuplicates(["kgraph_id", "id"]).select(nodes.columns), "id")
    return grown, upsert_edges(edges, members.select(edges.columns)).unionByName(typed)
