"""Merkle manifest of a data set: a hash tree over the rows of each source, and one over the sources, built by a butterfly exchange.

Rows are sorted by range over all tasks, so every row knows its place in its source, and places are cut into aligned blocks of ``fanout ** height``
leaves: a hot source has many blocks. A task hashes the subtree of its block. Then blocks swap roots round by round: in round j the blocks that differ only
in digit j of their number (in base ``fanout``) meet, each holding the root of its aligned group of ``fanout ** j`` blocks; all of them hash the parent, and all keep the siblings. After the
last round every block holds the path from its root up, and none has been sent down. Where the last group of a run has fewer blocks than the groups before it, its blocks also
send their root to the places that have no partner (``ghosts``). The rounds over sources are the same, with the blocks of a group of sources numbered through.

A digest is the lowercase hex sha256 of the concatenated inputs; a node hashes the hex digests of its children.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.store import mapped, saved

PROOF = "array<struct<left:string,right:string>>"
BLOCKS = "place long, block long, n long, docs array<long>, leaves binary, seen binary, root string"
LEAVES = f"place long, doc_id long, leaf string, seen_leaf string, subroot string, root string, proof {PROOF}"
#: Leaves that one task sorts, roughly.
ROWS_A_TASK = 250_000


def leaf_digest(fields: list[Column]) -> Column:
    """Of each field ``-`` if it is null, else the count of its UTF-8 bytes, ``:`` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def _levels(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The nodes of each level from the leaves up: ``height`` levels above them, or as many as one root needs."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _hex(packed: bytes) -> list[str]:
    text = packed.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _blocks(batches: Iterator[pa.RecordBatch], fanout: int, height: int) -> Iterator[pa.RecordBatch]:
    """Sorted leaves -> one row for each block; a block may go on in the next batch."""
    key, docs, leaves, seen = None, [], [], []

    def block() -> pa.RecordBatch:
        packed = b"".join(leaves)
        root = _levels(_hex(packed), fanout, height if key[2] > fanout**height else None)[-1][0]
        values = [[key[0]], [key[1]], [key[2]], [pa.concat_arrays(docs)], [packed], [b"".join(seen)], [root]]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.string())
        return pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        place, number = batch.column("place").to_numpy(), batch.column("block").to_numpy()
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(number) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            own = (int(place[a]), int(number[a]), batch.column("n")[a].as_py())
            if own != key:
                if key is not None:
                    yield block()
                key, docs, leaves, seen = own, [], [], []
            docs.append(batch.column("doc_id").slice(a, b - a))
            leaves += batch.column("leaf").slice(a, b - a).to_pylist()
            seen += batch.column("seen").slice(a, b - a).to_pylist()
    if key is not None:
        yield block()


def _proofs(batches: Iterator[pa.RecordBatch], fanout: int, height: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Blocks with their upper proofs -> leaves with whole proofs."""
    for batch in batches:
        for r in batch.to_pylist():
            nodes, seen = _hex(r["leaves"]), _hex(r["seen"])
            levels = _levels(nodes, fanout, height if r["n"] > fanout**height else None)
            for a in range(0, len(nodes), rows):
                b = min(a + rows, len(nodes))
                proofs = []
                for i in range(a, b):
                    path, at = [], i
                    for level in levels[:-1]:
                        first = at - at % fanout
                        path.append({"left": "".join(level[first:at]), "right": "".join(level[at + 1 : first + fanout])})
                        at //= fanout
                    proofs.append(path + r["path"])
                same = lambda v: [v] * (b - a)
                values = [same(r["place"]), r["docs"][a:b], nodes[a:b], seen[a:b], same(r["subroot"]), same(r["root"]), proofs]
                types = (pa.int64(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
                yield pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["place", "doc_id", "leaf", "seen_leaf", "subroot", "root", "proof"])


def _exchange(members: DataFrame, parent: list[Column], digit: Column, lane: Column, size: Column, lanes: Column, more: Column) -> DataFrame:
    """One round: the members of sibling groups that have the same lane meet, at most ``fanout`` of them, and each gets its parent's root and the siblings of its own.

    ``size`` is the number of members in a member's group, ``lanes`` that of the largest sibling; a smaller group's members also stand in for the lanes that it lacks. Members without ``more`` pass.
    """
    columns = members.columns
    to = F.explode(F.when(more, F.sequence(lane, lanes - 1, size)).otherwise(F.array(lane)))
    sent = members.select(*[p.alias(f"p{i}") for i, p in enumerate(parent)], digit.cast("int").alias("digit"), lane.alias("own"), to.alias("lane"), more.alias("more"), F.struct(*columns).alias("member"))
    here = F.struct("digit", F.col("member.root").alias("root"), F.when(F.col("lane") == F.col("own"), F.col("member")).alias("member"))
    met = sent.groupBy(*[f"p{i}" for i in range(len(parent))], "lane", "more").agg(F.array_sort(F.collect_list(here), lambda a, b: a["digit"] - b["digit"]).alias("met"))
    known = met.select("met", "more", F.explode(F.filter("met", lambda m: m["member"].isNotNull())).alias("m"))
    side = lambda keep: F.concat_ws("", F.transform(F.filter("met", keep), lambda x: x["root"]))
    step = F.struct(side(lambda x: x["digit"] < F.col("m.digit")).alias("left"), side(lambda x: x["digit"] > F.col("m.digit")).alias("right"))
    up = F.sha2(F.concat_ws("", F.transform("met", lambda x: x["root"])), 256)
    new = {"root": F.when(F.col("more"), up).otherwise(F.col("m.member.root")), "path": F.when(F.col("more"), F.concat(F.col("m.member.path"), F.array(step))).otherwise(F.col("m.member.path"))}
    return known.select(*[new.get(c, F.col(f"m.member.{c}")).alias(c) for c in columns])


def _div(a: Column, b: int) -> Column:
    """Whole quotient."""
    return F.call_function("div", a, F.lit(b)) if b > 1 else a.cast("long")


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), source_col: str = "source", id_col: str = "doc_id", fanout: int = 3, height: int = 7,
    seen: dict[str, Column] | None = None,
) -> DataFrame:
    """A row for each row of docs: source, doc_id, leaf, seen_leaf, subroot (of its source), root (of all), proof (the siblings left and right of the path, from the leaf up).

    In each source leaves ascend by id (null ids first; equal ids by digest), every ``fanout`` consecutive nodes become one until one remains, and the subroots in the order of the
    sources (null first, UTF-8 bytewise) become the root likewise. ``seen`` replaces fields by what another copy of the data set has: ``seen_leaf`` is the digest of that. Null fields count as ``-``; a null
    source is a source; repeated rows are leaves each; an empty table gives an empty one; other columns are not read. Texts are hashed where they are read and never shuffled; a leaf travels as
    some 80 bytes. The driver learns three numbers: the counts of rows and sources, and of the rows of the largest source.
    """
    other = seen or {}
    key = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    digest = leaf_digest([F.col(f) for f in fields])
    leaves = docs.select(
        key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(digest).alias("leaf"), F.unhex(leaf_digest([other.get(f, F.col(f)) for f in fields]) if other else digest).alias("seen"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = saved(leaves, "leaves")
    total = leaves.count()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // ROWS_A_TASK + 1)
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    ordered = leaves.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
    ordered = saved(ordered, "ordered").withColumn("task", F.shiftright("at", 33))  # at: the task, and the place in it

    runs = ordered.groupBy("task", "key").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    block = fanout**height
    by_source = runs.groupBy("key").agg(F.min("task").alias("home"), F.sum("here").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    homes = by_source.groupBy("home").agg(F.count("*").alias("sources"), F.sum("blocks").alias("sum_blocks"))  # a row a task
    earlier = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    homes = homes.select("home", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("sources", "sum_blocks")])
    inside = Window.partitionBy("home").orderBy("key")
    by_source = by_source.join(homes, "home").select(
        "key", "n", "blocks", (F.col("sources") + F.row_number().over(inside) - 1).alias("place"),
        (F.col("sum_blocks") + F.sum("blocks").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks")).alias("blocks_before"),
    )
    by_source = saved(by_source, "sources")
    sources, largest = by_source.agg(F.count("*"), F.coalesce(F.max("blocks"), F.lit(0))).first()

    before = F.coalesce(F.sum("here").over(Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before).join(by_source.select("key", "n", "place"), "key")
    position = F.col("before") + F.col("at") - F.col("first")
    placed = ordered.join(runs.select("task", "key", "first", "before", "n", "place"), ["task", "key"]).select("place", _div(position, block).alias("block"), position.alias("position"), "n", "doc_id", "leaf", "seen")
    dealt = placed.repartition(tasks, "place", "block").sortWithinPartitions("place", "block", "position")
    blocks = saved(dealt.transform(mapped, partial(_blocks, fanout=fanout, height=height), BLOCKS), "blocks")

    members = blocks.select("place", "block", "root").join(by_source.select("place", "blocks", "blocks_before"), "place").withColumn("path", F.array().cast(PROOF))
    number, width = F.col("block"), 1
    while width < largest:  # rounds within the sources
        lanes = F.least(F.lit(width), F.col("blocks") - _div(number, width * fanout) * (width * fanout))
        size = F.least(F.lit(width), F.col("blocks") - _div(number, width) * width)
        members = _exchange(members, [F.col("place"), _div(number, width * fanout)], F.pmod(_div(number, width), F.lit(fanout)), F.pmod(number, F.lit(width)), size, lanes, F.col("blocks") > width)
        width *= fanout
    members = members.withColumn("subroot", F.col("root"))
    width = 1
    while width < sources:  # rounds over the sources
        groups = by_source.groupBy(_div(F.col("place"), width).alias("group")).agg(F.sum("blocks").alias("size"), F.min("blocks_before").alias("start"))
        groups = groups.withColumn("lanes", F.max("size").over(Window.partitionBy(_div(F.col("group"), fanout))))
        found = members.withColumn("group", _div(F.col("place"), width)).join(groups, "group")
        lane = F.col("blocks_before") + number - F.col("start")
        met = _exchange(found, [_div(F.col("group"), fanout)], F.pmod("group", F.lit(fanout)), lane, F.col("size"), F.col("lanes"), F.lit(True))
        members = met.drop("group", "size", "start", "lanes")
        width *= fanout
    upper = members.select("place", "block", "subroot", F.col("root").alias("root"), "path")
    whole = blocks.drop("root").join(upper, ["place", "block"]).transform(mapped, partial(_proofs, fanout=fanout, height=height), LEAVES)
    return whole.join(by_source.select("place", F.when(F.col("key") != "", F.expr("substr(key, 2)")).alias("source")), "place").select("source", *[c.split()[0] for c in LEAVES.split(", ")[1:]])


def verified(rows: DataFrame, leaf_col: str = "seen_leaf") -> DataFrame:
    """Rows of a manifest with proof_sha256 (of the siblings, level by level, left to right), folded_root (recomputed from the leaf of ``leaf_col`` and the siblings) and verified (it is the root); in the JVM."""
    siblings = F.concat_ws("", F.transform("proof", lambda p: F.concat(p["left"], p["right"])))
    folded = F.aggregate("proof", F.col(leaf_col), lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))
    rows = rows.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": folded})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy in which every row whose doc_id has an even unsigned crc32 (of its decimal digits) lost the line feeds of its text; rows without an id stay."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    copy = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verified(manifest(docs, seen={"text": copy})).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source")
