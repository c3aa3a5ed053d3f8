"""Text search over an inverted index, and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import tree_prefixes


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, size): how often each term is in each text, and how many terms the text has. Grouped by text and term, so no term's postings are gathered."""
    each = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("all")).select("id", F.size("all").alias("size"), F.explode("all").alias("term"))
    return each.groupBy("term", "id", "size").agg(F.count("*").alias("tf"))


#: Bytes of text whose terms one task counts at a time, about.
TASK_BYTES = 8 << 20


def dealt_texts(docs: DataFrame, id_col: str, text_col: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The ids and texts, dealt by id to as many parts as their bytes need, so that what one task holds doesn't grow with them. What is grouped by id and more is grouped within the parts: texts are shuffled, their terms are not."""
    least = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return docs.select(id_col, text_col).repartition(max(least, -(-size // task_bytes)), id_col)


def corpus_size(docs: DataFrame, text_col: str) -> tuple[Column, Column]:
    """How many texts there are and how many terms they have in the mean, as scalar subqueries that run with the query they are used in."""
    totals = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text_col)))).alias("mean"))
    return totals.select("n").scalar(), totals.select("mean").scalar()


def bm25(index: DataFrame, query: list[str], n_docs: int | Column, mean_size: float | Column, top: int, skip: int = 0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best texts for some terms: (id, score), ties by id. The index is filtered before anything is joined. Both numbers may be scalar subqueries (``corpus_size``)."""
    held = index.filter(F.col("term").isin(*[q.lower() for q in query]))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(mean_size)))
    return held.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").offset(skip).limit(top)


def substring_topk(docs: DataFrame, id_col: str, text_col: str, needle: str, top: int) -> DataFrame:
    """Occurrences of a string by length of text, best first."""
    low = F.lower(text_col)
    count = (F.length(low) - F.length(F.replace(low, F.lit(needle), F.lit("")))) / F.lit(len(needle))
    return docs.filter(F.contains(low, F.lit(needle))).select(F.col(id_col), (count / F.length(text_col)).alias("score")).orderBy(F.desc("score"), id_col).limit(top)


def labelled_hits(hits: DataFrame, nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Hits whose node has one of the labels: applied to the best k, so fewer may be left."""
    return hits.join(nodes.filter(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in labels]))).select("id"), "id", "left_semi")


def facets(docs: DataFrame, dims: list[str], top: int | None = None) -> DataFrame:
    """(dim, value, n) of each dimension, in one pass over the texts; with top only the most frequent values."""
    each = docs.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("f"))
    count = each.groupBy("f.dim", "f.value").agg(F.count("*").alias("n"))
    if top is None:
        return count
    from pyspark.sql import Window

    return count.withColumn("_place", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value"))).filter(F.col("_place") <= top).drop("_place")


def path_facets(docs: DataFrame, id_col: str, path: Column) -> DataFrame:
    """(path, n): texts below each prefix of their dotted paths."""
    return docs.select(F.col(id_col), F.explode(tree_prefixes(path)).alias("path")).distinct().groupBy("path").agg(F.count("*").alias("n"))


def in_range(rows: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose number is from low to high; a point if both are the same. The scan gets the filter."""
    return rows.filter(F.col(column).between(low, high))


def first_n(rows: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key in an order: the caps that some sources put on what they give (20 texts, 10 partners)."""
    from pyspark.sql import Window

    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")
