"""The property graph: filters, upserts, neighbours, degrees, stitching. A graph is a table of nodes and one of edges; changing it gives new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import put_all, visible
from loomgraph.operators.rounds import parts_for


def nodes_where(nodes: DataFrame, kgraph_id: int | None = None, where: Column | None = None) -> DataFrame:
    out = nodes if kgraph_id is None else nodes.filter(F.col("kgraph_id") == kgraph_id)
    return out if where is None else out.filter(where)


edges_where = nodes_where


def find_nodes(nodes: DataFrame, column: str, value) -> DataFrame:
    """Exact matches; an array column matches if any element equals the value."""
    is_array = dict(nodes.dtypes)[column].startswith("array")
    return nodes.filter(F.array_contains(column, value) if is_array else F.col(column) == value)


def has_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.filter(F.array_contains("tags", tag))


def first_per_key(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; rows with a null in the key stay as they are. Each task keeps one row a key before the shuffle (a window group limit), so a key with very many rows is no task of its own."""
    whole = rows.filter(F.expr(" and ".join(f"{k} is not null" for k in keys)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = whole.withColumn("_place", place).filter("_place = 1").drop("_place")
    return first.unionByName(rows.filter(F.expr(" or ".join(f"{k} is null" for k in keys))))


def upsert_nodes(nodes: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Nodes with the new ones that no node of their graph has the key of. The first of a batch wins; a null key always makes a node."""
    keys = ["kgraph_id", key]
    fresh = first_per_key(new, keys, "seq")
    return nodes.unionByName(fresh.join(nodes.select(*keys).distinct().hint("merge"), keys, "left_anti").select(nodes.columns))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones whose ends aren't joined by their type yet, in either direction; the first of a batch keeps its direction."""
    ends = [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")]
    fresh = first_per_key(new.select("*", *ends), ["kgraph_id", "_a", "_b", "type"], "seq")
    have = edges.select("kgraph_id", *ends, "type").distinct()
    return edges.unionByName(fresh.join(have.hint("merge"), ["kgraph_id", "_a", "_b", "type"], "left_anti").select(edges.columns))


def merge_edges(edges: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: new edges put their properties, in the order of ``seq``, on top of those of an edge that is there, and make one where there is none.

    That edge is the one of the same ends, direction and type with the same value of ``key``; without one, or for a new edge without the key, the first edge (by seq) that joins the ends
    by the type in either direction. New edges that meet none become one for each type and ends, with the direction of the first. Old and new edges are dealt by type and ends, by
    their number, in one shuffle in which all of that is found; properties are grouped one by one, so an edge with very many updates is not gathered.
    """
    ends = [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")]
    on = ["kgraph_id", "_a", "_b", "type"]
    whole = F.expr(" and ".join(f"{c} is not null" for c in on))
    held = lambda rows, old, props: rows.select("*", *ends).select(*on, "id", "src", "dst", "directed", "seq", F.col("props")[key].alias("_key"), props.alias("props"), F.lit(old).alias("_old"))
    none = F.lit(None).cast(new.schema["props"].dataType)
    rows = held(edges, True, none).unionByName(held(new, False, F.col("props")))
    rows = rows.filter(whole).repartition(parts_for(rows), *on)
    first = F.min(F.when(F.col("_old"), F.struct("seq", "id")))
    same = F.when(F.expr("_key is not null and src is not null and dst is not null"), first.over(Window.partitionBy(*on, "src", "dst", "_key"))["id"])
    made = F.min(F.when(F.col("_first").isNull(), F.struct("seq", "id", "src", "dst", "directed"))).over(Window.partitionBy(*on))
    met = rows.withColumn("_same", same).withColumn("_first", first.over(Window.partitionBy(*on))).withColumn("_made", made).filter("not _old")
    each = met.select(*on, F.coalesce("_same", "_first.id", "_made.id").alias("_to"), "_made", F.explode_outer("props").alias("_k", "_v"), "seq", F.col("id").alias("_id"))  # an edge without properties is made, too
    last = each.groupBy(*on, "_to", "_k").agg(F.max_by(F.struct("_v"), F.struct("seq", "_id")).alias("_v"), F.first("_made").alias("_made"))
    props = last.groupBy(*on, "_to").agg(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v._v"))).alias("_props"), F.first("_made").alias("_made")).withColumnRenamed("_to", "id")
    both = edges.select("*", *ends).join(props, [*on, "id"], "full")
    out = {c: F.coalesce(F.col(c), F.col(f"_made.{c}")).alias(c) for c in ("src", "dst", "directed", "seq")}
    out["props"] = put_all(F.col("props"), F.when(F.size("_props") > 0, F.map_from_entries("_props"))).alias("props")
    apart = new.select("*", *ends).filter(~whole).withColumn("props", F.create_map().cast(edges.schema["props"].dataType))  # meets none, not even its like
    return both.select(*[out.get(c, F.col(c)) for c in edges.columns]).unionByName(apart.select(edges.columns))


def incident(edges: DataFrame) -> DataFrame:
    """(node, other, …) in both directions; a loop once."""
    out = edges.withColumns({"node": F.col("src"), "other": F.col("dst")})
    back = edges.filter("src != dst").withColumns({"node": F.col("dst"), "other": F.col("src")})
    return out.unionByName(back)


def neighbors(edges: DataFrame, nodes: DataFrame, of: DataFrame | None = None, tags: list[str] | None = None) -> DataFrame:
    """Other ends of the edges of each node (of ``of``'s id, or of all), once for each edge; with tags only those that have one of them."""
    pairs = incident(edges).select("node", "other")
    if of is not None:
        pairs = pairs.join(of.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    found = nodes if tags is None else nodes.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return pairs.join(found.withColumnRenamed("id", "other"), "other")


def has_neighbors(nodes: DataFrame, edges: DataFrame, tags: list[str] | None = None) -> DataFrame:
    pairs = incident(edges).select("node", "other")
    if tags is not None:
        pairs = pairs.join(nodes.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))).select(F.col("id").alias("other")), "other", "left_semi")
    return nodes.join(pairs.select(F.col("node").alias("id")), "id", "left_semi")


def other_end(node: Column) -> Column:
    return F.when(F.col("src") == node, F.col("dst")).when(F.col("dst") == node, F.col("src"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree of every node; both sides are counted before they meet."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    count = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("id").join(count, "id", "left").select("id", zero(F.col("i")).alias("in_degree"), zero(F.col("o")).alias("out_degree"), zero(F.col("i") + F.col("o")).alias("degree"))


#: Rows of a key that meet another one together, and how many tasks a key's rows are dealt to.
BLOCK, SPREAD = 256, 8


def pairs_of(rows: DataFrame, keys: list[str], order: list[str], held: list[str], parts: int | None = None) -> DataFrame:
    """(keys, a, b) of all pairs of rows that share the keys, a being the later one by ``order`` (unique within a key, numbers from 0 if it is ``place``): structs of the columns ``held``.

    m rows of a key have m * (m - 1) / 2 pairs by definition; what is shuffled and held is linear. Earlier rows come in blocks of at most BLOCK, later ones are dealt to SPREAD tasks a key, and the number of tasks is fixed:
    pairs are many where rows are few, which the sizes of shuffles don't tell.
    """
    parts = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    whole = rows.filter(F.expr(" and ".join(f"{k} is not null" for k in keys)))
    if order != ["place"]:
        whole = whole.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    each = whole.select(*keys, "place", F.floor(F.col("place") / BLOCK).alias("_block"), F.struct(*held).alias("a"))
    blocks = each.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("place", "a"))).alias("_all"))
    blocks = blocks.select(*keys, F.col("_block").alias("_from"), F.transform("_all", lambda x: x["a"]).alias("_all"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_deal"))
    on = [*keys, "_deal"]
    dealt = each.withColumn("_deal", F.pmod(F.col("place"), F.lit(SPREAD)).cast("int"))
    met = dealt.repartition(parts, *on).join(blocks.repartition(parts, *on).hint("shuffle_hash"), on).filter("_from <= _block")
    earlier = F.when(F.col("_from") < F.col("_block"), F.col("_all")).otherwise(F.slice("_all", F.lit(1), (F.col("place") - F.col("_from") * BLOCK).cast("int")))
    return met.select(*keys, "a", F.explode(earlier).alias("b"))


def stitch(nodes: DataFrame) -> DataFrame:
    """A ``resolve`` edge from each node to each earlier one of its graph that shares a synonym, for each such synonym: m nodes with one synonym have m * (m - 1) / 2 edges, by definition. Nodes of the same ``seq`` have none."""
    each = nodes.select("kgraph_id", "id", "seq", F.explode(F.array_distinct("synonyms")).alias("value")).filter("seq is not null")
    met = pairs_of(each, ["kgraph_id", "value"], ["seq", "id"], ["id", "seq"]).filter("a.seq > b.seq")
    return met.select("kgraph_id", F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.lit("resolve").alias("type"), "value")


def graph_counts(nodes: DataFrame, edges: DataFrame, undirected_pattern: bool = False) -> DataFrame:
    """Nodes and edges of each graph. ``undirected_pattern`` counts an edge that is no loop twice, as a match without direction does."""
    n = nodes.groupBy("kgraph_id").agg(F.count("*").alias("node_count"))
    one = F.when(F.col("src") == F.col("dst"), 1).otherwise(2) if undirected_pattern else F.lit(1)
    e = edges.groupBy("kgraph_id").agg(F.sum(one).cast("long").alias("edge_count"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return n.join(e, "kgraph_id", "full").select("kgraph_id", zero("node_count"), zero("edge_count"))


def count_graphs(nodes: DataFrame) -> DataFrame:
    """One row: how many graphs have nodes."""
    return nodes.agg(F.countDistinct("kgraph_id").alias("graphs"))


def counts_by_tag(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def remove_graph(nodes: DataFrame, edges: DataFrame, kgraph_id: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without a graph's nodes and without the edges at them."""
    gone = nodes.filter(F.col("kgraph_id") == kgraph_id).select("id")
    left = edges.filter(F.col("kgraph_id") != kgraph_id)
    for end in ("src", "dst"):
        left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return nodes.filter(F.col("kgraph_id") != kgraph_id), left.select(edges.columns)


def create_graph(nodes: DataFrame, kgraph_id: int, name: str, type_: str, props: dict[str, str], created: int) -> DataFrame:
    """Nodes with the seed node of a new graph."""
    spark = nodes.sparkSession
    seed = spark.range(1).select(
        F.lit(kgraph_id).cast("long").alias("kgraph_id"), F.xxhash64(F.lit(kgraph_id).cast("long"), F.lit(name)).alias("id"), F.lit(type_).alias("type"), F.lit(name).alias("name"),
        F.lit(props.get("uri")).cast("string").alias("uri"), F.lit(created).cast("long").alias("created"), F.array(F.lit("KQuery")).alias("tags"), F.array().cast("array<string>").alias("synonyms"),
        F.create_map(*[F.lit(x) for pair in sorted(props.items()) for x in pair]).cast("map<string,string>").alias("props"), F.lit(0).cast("long").alias("seq"),
    )
    return nodes.unionByName(seed)


def valid_edges(new: DataFrame) -> DataFrame:
    """Edges with a type and both ends; the others are an error."""
    return new.filter(F.coalesce(F.assert_true(F.col("type").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull(), F.lit("an edge needs a type and two ends")).isNull(), F.lit(True)))


def entity_json(nodes: DataFrame) -> DataFrame:
    """id and the JSON form of each node: hidden properties out, nulls left out."""
    fields = F.struct(F.col("id").alias("@id"), F.col("type").alias("@type"), "name", "created", "uri", "tags", visible(F.col("props")).alias("props"))
    return nodes.select("kgraph_id", "id", F.to_json(fields).alias("json"))


#: Nodes and edges of the largest graph that is one JSON text.
MOST = 100_000


def graph_json(nodes: DataFrame, edges: DataFrame, full: bool = True, most: int = MOST) -> DataFrame:
    """One JSON text a graph: compact (counts only) or full (with its nodes and edges, in the order of their ids).

    Graphs with more than ``most`` nodes and edges have their compact form in both; ``graph_lines`` has graphs of any size. They are left out before anything is gathered.
    """
    counts = graph_counts(nodes, edges)
    compact = F.to_json(F.struct("kgraph_id", "node_count", "edge_count"))
    if not full:
        return counts.select("kgraph_id", compact.alias("json"))
    small = counts.filter(F.col("node_count") + F.col("edge_count") <= most).select("kgraph_id")
    n = nodes.join(small, "kgraph_id", "left_semi").groupBy("kgraph_id").agg(F.sort_array(F.collect_list(F.struct("id", "type", "name"))).alias("nodes"))
    e = edges.join(small, "kgraph_id", "left_semi").groupBy("kgraph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "type"))).alias("edges"))
    whole = F.to_json(F.struct("kgraph_id", "node_count", "edge_count", "nodes", "edges"))
    return counts.join(n, "kgraph_id", "left").join(e, "kgraph_id", "left").select("kgraph_id", whole.alias("json"))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kgraph_id, part, id, json): a line for each graph (its counts, id null), node and edge. Nodes and edges are not shuffled, so a graph may have any size; sort by graph, part and id to write it as JSON lines."""
    line = lambda rows, part, key, *fields: rows.select("kgraph_id", F.lit(part).alias("part"), key.alias("id"), F.to_json(F.struct(*fields)).alias("json"))
    head = line(graph_counts(nodes, edges), "graph", F.lit(None).cast("long"), "kgraph_id", "node_count", "edge_count")
    return head.unionByName(line(nodes, "node", F.col("id"), "id", "type", "name")).unionByName(line(edges, "edge", F.col("id"), "src", "dst", "type"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "append") -> None:
    """Both tables as Parquet, in folders by graph, so one graph is read or dropped alone."""
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.write.mode(mode).partitionBy("kgraph_id").parquet(f"{path}/{name}")


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def with_property(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes that have a property, with a value."""
    return nodes.filter(F.col("props")[key].isNotNull())


def without_tagged_neighbors(nodes: DataFrame, edges: DataFrame, others: DataFrame, tag: str) -> DataFrame:
    """Nodes without a neighbour (among ``others``) that has the tag: those for which a section of a source isn't done yet."""
    return nodes.join(neighbors(edges, others, tags=[tag]).select(F.col("node").alias("id")), "id", "left_anti")
