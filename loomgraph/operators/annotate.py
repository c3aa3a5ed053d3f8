"""Mentions of dictionary phrases in texts: all of them, or the leftmost longest with their concepts, semantic types and sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.rounds import stored
from loomgraph.operators.search import tokens

#: Bytes of phrases that are broadcast as a word trie; a larger dictionary is joined by hash.
TRIE_BYTES = 16 << 20
SPANS = "at int, words int, phrase string"


def _trie(phrases: list[str]) -> dict:
    """Words lead from node to node; a phrase ends at the key ``""``, which is no word."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for word in phrase.split(" "):
            node = node.setdefault(word, {})
        node[""] = phrase
    return root


def _walk(words: list[str], trie: dict, longest: bool) -> list[tuple[int, int, str]]:
    out, i, n = [], 0, len(words)
    while i < n:
        node, j, last = trie.get(words[i]), i + 1, 0
        while node is not None:
            if "" in node:
                if not longest:
                    out.append((i, j - i, node[""]))
                else:
                    last, found = j, node[""]
            if j == n:
                break
            node, j = node.get(words[j]), j + 1
        if last:
            out.append((i, last - i, found))
        i = last or i + 1
    return out


_tries: dict[str, dict] = {}


def _spans(batches: Iterator[pa.RecordBatch], shared, key: str, longest: bool) -> Iterator[pa.RecordBatch]:
    """Rows with their words in the last column -> their other columns, a row a span."""
    if key not in _tries:
        _tries.clear()
        _tries[key] = _trie(shared.value)
    trie = _tries[key]
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            row, spans = [], []
            for i, words in enumerate(part.column(part.num_columns - 1).to_pylist()):
                own = _walk(words or [], trie, longest)
                spans += own
                row += [i] * len(own)
            at, size, phrase = zip(*spans, strict=True) if spans else ((), (), ())
            kept = [c.take(pa.array(row, pa.int64())) for c in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(phrase, pa.string())], [*part.schema.names[:-1], "at", "words", "phrase"])


def _by_trie(texts: DataFrame, phrases: list[str], longest: bool) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(phrases)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(partial(_spans, shared=shared, key=uuid.uuid4().hex, longest=longest), f"{schema}, {SPANS}")


def _by_join(texts: DataFrame, wanted: DataFrame, longest: bool) -> DataFrame:
    """The same by an equi-join on the first word and one on the whole text's row: for dictionaries of any size."""
    texts = stored(texts.withColumn("_place", F.monotonically_increasing_id()))
    words, others = texts.columns[-2], texts.columns[:-2]
    starts = texts.select("_place", F.posexplode(words).alias("at", "first"))
    listed = wanted.select("phrase", F.split("phrase", " ").alias("p")).withColumn("first", F.get("p", F.lit(0)))
    met = starts.join(listed, "first").select("_place", "at", "phrase", "p").join(texts, "_place").filter(F.slice(F.col(words), F.col("at") + 1, F.size("p")) == F.col("p"))
    found = met.select("_place", "at", F.size("p").alias("words"), "phrase")
    if longest:
        spans = found.groupBy("_place").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("words")).alias("less"), "phrase"))).alias("spans"))  # of one text
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,words:int,phrase:string>>").alias("kept"))
        step = lambda acc, s: F.when(s["at"] >= acc["end"], F.struct((s["at"] - s["less"]).alias("end"), F.concat(acc["kept"], F.array(F.struct(s["at"].alias("at"), (-s["less"]).alias("words"), s["phrase"].alias("phrase")))).alias("kept"))).otherwise(acc)
        found = spans.select("_place", F.explode(F.aggregate("spans", start, step)["kept"]).alias("s")).select("_place", "s.*")
    return texts.select("_place", *others).join(found, "_place").select(*others, "at", "words", "phrase")


def spans(docs: DataFrame, columns: list[str], text_col: str, wanted: DataFrame, longest: bool, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``columns`` of docs with at, words (from which word, how many) and phrase of each mention of ``wanted`` (distinct normal phrases: lower-case words with single spaces)."""
    texts = docs.select(*columns, tokens(F.col(text_col)).alias("_words"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("phrase") + 64), F.lit(0))).first()[0]
    if size <= trie_bytes:
        return _by_trie(texts, [r[0] for r in wanted.collect()], longest)  # bounded by the line above
    return _by_join(texts, wanted, longest)


def normal(phrases: DataFrame, phrase_col: str) -> DataFrame:
    """With ``phrase``: its lower-case words with single spaces. Phrases without words are left out."""
    return phrases.withColumn("phrase", F.array_join(tokens(F.col(phrase_col)), " ")).filter("phrase != ''")


def mentions(docs: DataFrame, id_col: str, text_col: str, phrases: DataFrame, key: str, phrase_col: str, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, key, n): how often each whole phrase occurs in each row of docs, overlaps included; a row for each row of docs and key with mentions, also where ids repeat or are null.

    A small dictionary is broadcast as a word trie, which each text is walked through once; a larger one is joined by hash. Null and empty texts, and phrases without words, have no mentions.
    """
    listed = normal(phrases, phrase_col).select(F.col(key), "phrase")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    found = spans(rows, ["_row", "id"], "_text", listed.select("phrase").distinct(), False, trie_bytes).groupBy("_row", "id", "phrase").agg(F.count("*").alias("n"))
    return found.join(listed, "phrase").groupBy("_row", "id", key).agg(F.sum("n").alias("n")).select("id", key, "n")


def annotations(docs: DataFrame, columns: list[str], text_col: str, concepts: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``columns`` of docs, start, end (words, from 0, the end not included), phrase, concept, semtypes and sources of each mention, from concepts (concept, name, semtypes, sources: arrays).

    Of overlapping mentions the leftmost counts, of those with one start the longest; the text goes on behind it. A phrase that several concepts have gives a row for each; rows of one concept and
    phrase are joined. Repeated rows of docs are annotated each.
    """
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    listed = normal(concepts, "name").groupBy("phrase", "concept").agg(flat("semtypes").alias("semtypes"), flat("sources").alias("sources"))
    found = spans(docs, columns, text_col, listed.select("phrase").distinct(), True, trie_bytes)
    return found.join(listed, "phrase").select(*columns, F.col("at").alias("start"), (F.col("at") + F.col("words")).alias("end"), "phrase", "concept", "semtypes", "sources")


def annotation_facets(found: DataFrame, id_col: str, top: int | None = None) -> DataFrame:
    """(dim, value, n) of annotations: in how many texts each concept, semantic type and source is mentioned; with ``top`` only the most frequent values of each."""
    values = [("concept", F.array(F.col("concept").cast("string"))), ("semtype", F.col("semtypes")), ("source", F.col("sources"))]
    entry = lambda d, c: F.transform(c, lambda v: F.struct(F.lit(d).alias("dim"), v.alias("value")))
    each = found.select(id_col, F.explode(F.concat(*[entry(d, c) for d, c in values])).alias("v"))
    count = each.groupBy("v.dim", "v.value").agg(F.countDistinct(id_col).alias("n"))
    if top is None:
        return count
    return count.withColumn("_place", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value"))).filter(F.col("_place") <= top).drop("_place")
