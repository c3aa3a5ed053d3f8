"""Hierarchies: tree numbers, is_a links, closures, and climbing from terms to descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import strip_comment, tree_parent, tree_prefixes


def prefix_rule(c: Column, allowed: list[str], blocked: list[str]) -> Column:
    """True for an allowed prefix, else false for a blocked one, else true."""
    starts = lambda values: F.exists(F.array(*[F.lit(v) for v in values]).cast("array<string>"), lambda v: c.startswith(v))
    return F.when(starts(allowed), True).when(starts(blocked), False).otherwise(True)


def parent_links(entries: DataFrame) -> DataFrame:
    """(child, parent, type = the parent's tree number) of entries (ui, tree_numbers); children may come before parents."""
    each = entries.select("ui", F.explode("tree_numbers").alias("tn"))
    parents = each.select(F.col("ui").alias("parent"), F.col("tn").alias("type"))
    return each.select(F.col("ui").alias("child"), tree_parent(F.col("tn")).alias("type")).filter("type is not null").join(parents, "type").select("child", "parent", "type").distinct()


def ancestor_links(entries: DataFrame) -> DataFrame:
    """(ui, ancestor, type = prefix) for every prefix of every tree number that another entry has."""
    each = entries.select("ui", F.explode("tree_numbers").alias("tn"))
    prefixes = each.select("ui", F.explode(tree_prefixes(F.col("tn"))).alias("type")).distinct()
    return prefixes.join(each.select(F.col("ui").alias("ancestor"), F.col("tn").alias("type")), "type").filter("ui != ancestor").select("ui", "ancestor", "type").distinct()


def is_a_links(terms: DataFrame) -> DataFrame:
    """(child, parent) of terms (id, is_a, alt_id): parents by id or by one of their other ids; comments after ``!`` are no part of an id."""
    ids = terms.select(F.col("id").alias("parent"), F.col("id").alias("key")).unionByName(terms.select(F.col("id").alias("parent"), F.explode("alt_id").alias("key"))).distinct()
    asked = terms.select(F.col("id").alias("child"), F.explode("is_a").alias("raw")).select("child", strip_comment(F.col("raw")).alias("key"))
    return asked.join(ids, "key").select("child", "parent").distinct()


def closure(links: DataFrame, rounds: int = 32) -> DataFrame:
    """(child, ancestor, depth) over links (child, parent), the shortest way; paths double in each round, so 32 rounds reach any depth. A round joins only the pairs that the last one
    found with all others: the first half of a pair's shortest path, taken as long as the last round could see, is always one of these."""
    from loomgraph.operators.rounds import written

    now = new = written(links.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    for _ in range(rounds):
        upper = now.select(F.col("child").alias("_from"), F.col("ancestor").alias("_to"), F.col("depth").alias("_more"))
        longer = new.join(upper, F.col("ancestor") == F.col("_from")).groupBy("child", F.col("_to").alias("above")).agg(F.min(F.col("depth") + F.col("_more")).alias("depth"))
        unseen = longer.join(upper, (F.col("child") == F.col("_from")) & (F.col("above") == F.col("_to")), "left_anti")
        new = written(unseen.select("child", F.col("above").alias("ancestor"), "depth"))
        if new.isEmpty():
            break
        now = now.unionByName(new)
    return now


def climb(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(ui, descriptor) of entries (ui, kind): terms by their concept, concepts by their first descriptor, descriptors and supplements themselves; null if stuck."""
    top = entries.filter(F.col("kind").isin("Descriptor", "SupplementalDescriptor")).select(F.col("ui").alias("top"))
    up = links.groupBy(F.col("child").alias("ui")).agg(F.min("parent").alias("next"))
    one = entries.join(up, "ui", "left").join(top.withColumnRenamed("top", "t0"), F.col("ui") == F.col("t0"), "left")
    two = one.join(up.select(F.col("ui").alias("next"), F.col("next").alias("next2")), "next", "left")
    two = two.join(top.withColumnRenamed("top", "t1"), F.col("next") == F.col("t1"), "left").join(top.withColumnRenamed("top", "t2"), F.col("next2") == F.col("t2"), "left")
    return two.select("ui", F.coalesce("t0", "t1", "t2").alias("descriptor"))


def parents(links: DataFrame, ui) -> DataFrame:
    return links.filter(F.col("child") == ui).select("parent").distinct()


def qualified_by(entries: DataFrame, qualifier: str) -> DataFrame:
    """Entries that have the qualifier, by ui."""
    return entries.filter(F.array_contains("qualifiers", qualifier)).orderBy("ui")


def typed_neighbours(edges: DataFrame, types: list[str]) -> DataFrame:
    return edges.filter(F.col("type").isin(*types))


def descriptors_with_trees(rows: DataFrame) -> DataFrame:
    """ui -> (name, tree numbers), by ui, from rows (ui, name, tree_number)."""
    return rows.groupBy("ui").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("tree_number")).alias("tree_numbers")).orderBy("ui")


def known_headings(articles: DataFrame, entries: DataFrame) -> DataFrame:
    """(pmid, ui, name, major, qualifiers) of article headings whose ui is known; a leading ``*`` is no part of a ui."""
    each = articles.select("pmid", F.explode("headings").alias("h")).select("pmid", F.regexp_replace("h.descriptor", r"^\*", "").alias("ui"), F.col("h.major").alias("major"), F.col("h.qualifiers").alias("qualifiers"))
    return each.join(entries.select("ui", "name"), "ui")


def phenotype_diseases(annotations: DataFrame, terms: DataFrame) -> DataFrame:
    """(phenotype, disease, type) of annotations whose phenotype is known, one for each pair and type."""
    known = terms.select(F.col("id").alias("phenotype"))
    return annotations.join(known, "phenotype", "left_semi").select("phenotype", "disease", "type").distinct()


def phenotype_genes(rows: DataFrame, terms: DataFrame, linked: DataFrame) -> DataFrame:
    """(phenotype, gene) pairs of known phenotypes that no edge joins yet."""
    known = terms.select(F.col("id").alias("phenotype"))
    return rows.join(known, "phenotype", "left_semi").select("phenotype", "gene").distinct().join(linked, ["phenotype", "gene"], "left_anti")


def named_qualifiers(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Qualifiers among the entries by name."""
    return entries.filter("kind = 'Qualifier'").join(names, "name", "left_semi")


def context(entries: DataFrame, links: DataFrame, ui: str, skip: int, top: int) -> DataFrame:
    """What an entry stands in: a term's concept, all that a concept is linked with, a qualifier's users, a descriptor itself; by ui, ``top`` after ``skip``."""
    own = entries.filter(F.col("ui") == ui)
    near = links.filter(F.col("child") == ui).select(F.col("parent").alias("ui")).unionByName(links.filter(F.col("parent") == ui).select(F.col("child").alias("ui")))
    kind = own.select(F.col("kind").alias("_kind"))
    linked = entries.join(near.distinct(), "ui", "left_semi").join(kind.filter("_kind in ('Term', 'Concept')"), how="left_semi", on=F.lit(True))
    users = entries.filter(F.array_contains("qualifiers", ui)).join(kind.filter("_kind = 'Qualifier'"), how="left_semi", on=F.lit(True))
    self_ = own.filter("kind in ('Descriptor', 'SupplementalDescriptor')")
    return linked.unionByName(users).unionByName(self_).select("ui", "kind").orderBy("ui").offset(skip).limit(top)


def link_sets(rows: DataFrame, name: str) -> DataFrame:
    """(id, link) of the link sets of a name, from rows (id, linksets: array of linkname and links)."""
    sets = rows.select("id", F.explode("linksets").alias("s")).filter(F.col("s.linkname") == name)
    return sets.select("id", F.explode("s.links").alias("link"))
