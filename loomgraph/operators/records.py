"""Graphs of heading records and of the articles that they index: nodes by ui, typed edges, and entries put together again, a row a part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.model import entity_id
from loomgraph.operators.ontology import ancestor_links

# What a node counts as when records of several kinds share its ui, the first that holds.
KINDS = ("Descriptor", "SupplementalDescriptor", "Qualifier", "Concept", "Term")


def _edge(src: Column, dst: Column, type_: str, preferred: Column | None = None, scope: Column | None = None, qualifiers: Column | None = None) -> list[Column]:
    """The columns of an edge; what it has no value for is null."""
    return [
        src.alias("src"), dst.alias("dst"), F.lit(type_).alias("type"), (F.lit(None) if preferred is None else preferred).cast("boolean").alias("preferred"),
        (F.lit(None) if scope is None else scope).cast("string").alias("scope"), (F.lit(None) if qualifiers is None else qualifiers).cast("array<string>").alias("qualifiers"),
    ]


def record_graph(records: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (ui, name, kind) and edges (src, dst, type, preferred, scope, qualifiers) of records (ui, name, kind, concepts: array of ui, name, preferred, relations (ui, name)
    and terms (ui, name, preferred); mapped and indexed: arrays of ui and qualifiers) and actions (ui, name, substances: array of ui and name).

    A ui is one node. Records and concepts have ``concept`` edges, related concepts point to a concept by one with a scope, ``term`` edges lead from concepts to the terms whose preference
    is known and from the others to their concept, ``mapped`` and ``indexed`` from supplements to descriptors, ``substance`` from actions. One edge for each pair and type, but for relations
    of several scopes. A ui without a name of its own (only referred to) has the name that the reference gives, or null. Null arrays count as empty.
    """
    return record_nodes(records, actions), record_edges(records, actions)


def record_nodes(records: DataFrame, actions: DataFrame) -> DataFrame:
    """The nodes of ``record_graph``; whether terms and concepts are preferred, names of relations and qualifiers may be missing."""
    concepts = records.select(F.explode("concepts").alias("c"))
    terms, relations = concepts.select(F.explode("c.terms").alias("t")), concepts.select(F.explode("c.relations").alias("r"))
    none, refers = F.lit(None).cast("string"), [records.select(F.explode(type_).alias("d")) for type_ in ("mapped", "indexed")]
    nodes = [
        records.select("ui", "name", "kind"), concepts.select("c.ui", "c.name", F.lit("Concept").alias("kind")), terms.select("t.ui", "t.name", F.lit("Term").alias("kind")), relations.select("r.ui", none.alias("name"), none.alias("kind")),
        actions.select("ui", "name", none.alias("kind")), actions.select(F.explode("substances").alias("s")).select("s.ui", "s.name", none.alias("kind")), *[d.select("d.ui", none.alias("name"), none.alias("kind")) for d in refers],
    ]
    place = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(0))
    rank = F.when(place > 0, place).otherwise(F.lit(len(KINDS) + 1))
    best = reduce(DataFrame.unionByName, nodes).filter("ui is not null").groupBy("ui").agg(F.min(F.struct(rank.alias("rank"), F.col("name").isNull().alias("unnamed"), "name", "kind")).alias("b"), F.min("name").alias("any"))
    return best.select("ui", F.coalesce("b.name", "any").alias("name"), "b.kind")


def record_edges(records: DataFrame, actions: DataFrame) -> DataFrame:
    """The edges of ``record_graph``; names and kinds may be missing, but for the names of relations."""
    concepts = records.select(F.col("ui").alias("record"), F.explode("concepts").alias("c"))
    terms = concepts.select(F.col("c.ui").alias("concept"), F.explode("c.terms").alias("t"))
    joined = terms.groupBy("concept", F.col("t.ui").alias("term")).agg(F.max("t.preferred").alias("preferred"))
    relations = concepts.select(F.col("c.ui").alias("concept"), F.explode("c.relations").alias("r"))
    substances = actions.select("ui", F.explode("substances").alias("s"))
    refers = {type_: records.select("ui", F.explode(type_).alias("d")) for type_ in ("mapped", "indexed")}
    known = F.col("preferred").isNotNull()
    edges = [
        concepts.select(*_edge(F.col("record"), F.col("c.ui"), "concept", F.col("c.preferred"))),
        relations.select(*_edge(F.col("r.ui"), F.col("concept"), "concept", scope=F.col("r.name"))),
        joined.select(*_edge(F.when(known, F.col("concept")).otherwise(F.col("term")), F.when(known, F.col("term")).otherwise(F.col("concept")), "term", F.col("preferred"))),
        *[d.select(*_edge(F.col("ui"), F.col("d.ui"), type_, qualifiers=F.col("d.qualifiers"))) for type_, d in refers.items()],
        substances.select(*_edge(F.col("ui"), F.col("s.ui"), "substance")),
    ]
    each = reduce(DataFrame.unionByName, edges).filter("src is not null and dst is not null")
    one = each.groupBy("src", "dst", "type", "scope").agg(F.max("preferred").alias("preferred"), F.max("qualifiers").alias("qualifiers"))
    return one.select("src", "dst", "type", "preferred", "scope", "qualifiers")


def entry_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What the entries of a record graph consist of, a row a part: (ui, kind, part, other, name, preferred, scope). Records have their concepts, pharmacological actions and (supplements)
    mapped and indexed descriptors, actions their substances, concepts their terms and the concepts related to them with the scope. A row a part, so that no entry is gathered in one task;
    entries of no kind have only substances."""
    named = nodes.select(F.col("ui").alias("other"), "name", F.col("kind").alias("_kind"))
    own = nodes.select("ui", "kind")
    away = edges.select(F.col("src").alias("ui"), F.col("dst").alias("other"), "type", "preferred", "scope", F.lit(True).alias("_out"))
    home = edges.select(F.col("dst").alias("ui"), F.col("src").alias("other"), "type", "preferred", "scope", F.lit(False).alias("_out"))
    met = away.unionByName(home).join(own, "ui").join(named, "other")
    out, concept, record = F.col("_out"), F.col("kind") == "Concept", F.col("kind").isin(*KINDS[:3])
    part = (
        F.when(record & out & (F.col("type") == "concept"), "concept").when(concept & ~out & (F.col("type") == "concept") & (F.col("_kind") == "Concept"), "relation")
        .when(concept & (F.col("type") == "term"), "term").when((F.col("kind") == "SupplementalDescriptor") & out & F.col("type").isin("mapped", "indexed"), F.col("type"))
        .when(~out & record & (F.col("type") == "substance"), "action").when(out & (F.col("type") == "substance"), "substance")
    )
    return met.withColumn("part", part).filter("part is not null").select("ui", "kind", "part", "other", "name", "preferred", "scope")


def heading_edges(articles: DataFrame, entries: DataFrame) -> DataFrame:
    """(pmid, ui, type, major, qualifiers) of articles (pmid, headings: array of descriptor, major and qualifiers; chemicals: array of ui) over entries (ui, name, kind).

    The type is the entry's kind; chemicals come before headings, have no ``major``, and the first edge of an article with an entry and type stays. Unknown uis are left out; the qualifiers of
    an unknown heading count with the known one before it, without one they are dropped. Qualifiers are given by name, unknown ones left out, in their order; null where there are none."""
    none = F.array().cast("array<string>")
    bare = lambda c: F.regexp_replace(c, r"^\*", "")
    rows = articles.select("pmid", F.posexplode("headings").alias("pos", "h")).select("pmid", "pos", bare(F.col("h.descriptor")).alias("ui"), F.col("h.major").alias("major"), F.coalesce("h.qualifiers", none).alias("quals"))
    known = rows.join(entries.select("ui", F.col("kind").alias("type")), "ui", "left")
    so_far = Window.partitionBy("pmid").orderBy("pos")
    known = known.withColumn("at", F.last(F.when(F.col("type").isNotNull(), F.col("pos")), ignorenulls=True).over(so_far)).filter("at is not null")
    named = known.select("pmid", "at", "pos", F.posexplode("quals").alias("turn", "q")).join(entries.filter("kind = 'Qualifier'").select(F.col("ui").alias("q"), "name"), "q")
    texts = named.groupBy("pmid", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "turn", "name"))), lambda x: x["name"]).alias("qualifiers"))
    main = known.filter("type is not null").select("pmid", F.col("pos").alias("at"), "ui", "type", "major").join(texts, ["pmid", "at"], "left")
    drugs = articles.select("pmid", F.posexplode("chemicals").alias("at", "ui")).join(entries.select("ui", F.col("kind").alias("type")), "ui")
    drugs = drugs.select("pmid", (F.col("at") - F.lit(1 << 30)).alias("at"), "ui", "type", F.lit(None).cast("boolean").alias("major"), F.lit(None).cast("array<string>").alias("qualifiers"))
    first = main.unionByName(drugs).groupBy("pmid", "ui", "type").agg(F.min(F.struct("at", "major", "qualifiers")).alias("f"))
    return first.select("pmid", "ui", "type", "f.major", "f.qualifiers")


def add_articles(known: DataFrame, articles: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles (pmid, title, date, …) that ``known`` (pmid) has not yet, one for each pmid (the first by title), with their year and a flag ``created``, and their heading edges.
    Articles that are known come back with ``created`` false and without edges; null ids are left out."""
    place = F.row_number().over(Window.partitionBy("pmid").orderBy(F.col("title").asc_nulls_last(), F.col("date").asc_nulls_last()))
    one = articles.filter("pmid is not null").withColumn("_place", place).filter("_place = 1").drop("_place")
    have = known.select("pmid").distinct().withColumn("_have", F.lit(True))
    flagged = one.join(have, "pmid", "left").withColumn("created", F.col("_have").isNull()).drop("_have").withColumn("year", F.year("date"))
    return flagged.drop("headings", "chemicals"), heading_edges(flagged.filter("created"), entries)


def article_headings_graph(articles: DataFrame, entries: DataFrame, graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (kgraph_id, id, type, name, uri) and edges (kgraph_id, src, dst, type, qualifiers) that articles (kgraph_id, uri, title, headings: array of descriptor and qualifiers) bring to
    a graph whose heading nodes are ``graph`` (kgraph_id, uri = ui, tree_numbers); entries are (ui, name, tree_numbers).

    An article without a known heading (one with tree numbers) brings nothing. Its edges have the heading's ui as type and the names of the heading's first qualifier; a heading that is new or
    met again is joined to every heading of its graph at a prefix of one of its tree numbers, the prefix as type."""
    found = articles.select("kgraph_id", F.col("uri").alias("article"), "title", F.explode("headings").alias("h")).select("kgraph_id", "article", "title", F.col("h.descriptor").alias("ui"), F.slice("h.qualifiers", 1, 1).alias("qualifiers"))
    found = found.join(entries.filter("size(tree_numbers) > 0").select("ui", "name", "tree_numbers"), "ui")
    node = lambda c: entity_id(F.col("kgraph_id"), F.col(c))
    texts = found.select("kgraph_id", node("article").alias("id"), F.lit("article").alias("type"), F.col("title").alias("name"), F.col("article").alias("uri"))
    headings = found.select("kgraph_id", node("ui").alias("id"), F.lit("mesh").alias("type"), "name", F.col("ui").alias("uri"))
    nodes = texts.unionByName(headings).groupBy("kgraph_id", "id").agg(F.min("type").alias("type"), F.min("name").alias("name"), F.min("uri").alias("uri"))
    named = found.filter("article != ui").groupBy("kgraph_id", node("article").alias("src"), node("ui").alias("dst"), F.col("ui").alias("type")).agg(F.max("qualifiers").alias("qualifiers"))
    met = found.select("kgraph_id", F.col("ui").alias("uri"), "tree_numbers").distinct()
    # links hold within a graph, so a graph's number is a part of what is joined
    within = lambda df: df.select(F.struct("kgraph_id", "uri").alias("ui"), F.transform("tree_numbers", lambda n: F.concat(F.col("kgraph_id").cast("string"), F.lit("/"), n)).alias("tree_numbers"))
    up = ancestor_links(within(graph.select("kgraph_id", "uri", "tree_numbers").unionByName(met).distinct())).join(within(met).select("ui").distinct(), "ui", "left_semi")
    above = up.select("ui.kgraph_id", entity_id(F.col("ui.kgraph_id"), F.col("ui.uri")).alias("src"), entity_id(F.col("ancestor.kgraph_id"), F.col("ancestor.uri")).alias("dst"), F.substring_index("type", "/", -1).alias("type"), F.lit(None).cast("array<string>").alias("qualifiers"))
    return nodes, named.select(above.columns).unionByName(above)
