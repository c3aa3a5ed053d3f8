"""Queries of full-text search and annotation: documents are the texts, benchmark items the queries and the dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import annotate as A
from loomgraph.operators import ontology as O
from loomgraph.operators import postings as X
from loomgraph.operators import search as T
from loomgraph.plans.catalog import query, table

WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x != '')"
BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5))"
PART = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))"
#: Views that the queries' SQL begins with: texts, postings, frequencies.
VIEWS = f"""t as (select doc_id as id, {WORDS} as t from documents), g as (select count(*) as n, cast(avg(len(t)) as double) as m from t),
    i as (select term, id, size, count(*) as tf from (select id, len(t) as size, unnest(t) as term from t) a group by 1, 2, 3), f as (select term, count(*) as df from i group by term)"""


def ranked(scored: str, top: int) -> str:
    return f"""r as (select query, id, score, cast(row_number() over (partition by query order by score desc, id) as integer) as place from ({scored}) s)
    select query, place, id, score from r where place <= {top}"""


BATCHED = f"select q as query, id, round(sum(w * {BM25} * {PART}), 9) as score from q join i using (term) join f using (term) cross join g group by q, id"


@query(f"""with {VIEWS}, p as (select item_id as query, {WORDS} as p from benchmark), w as (select query, sum({BM25}) as idf from (select query, unnest(p) as term from p) a join f using (term) cross join g group by query),
    h as (select query, id, len(t) as size, len(list_filter(range(1, len(t) - len(p) + 2), lambda x: t[x:x + len(p) - 1] = p)) as tf from t join p on len(p) > 0 and contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')),
    {ranked(f"select query, id, round(idf * {PART}, 9) as score from h join w using (query) cross join g", 5)}""")
def phrase_search(spark, d):
    """The best five documents for each benchmark text as a quoted phrase."""
    phrases = table(spark, d, "benchmark").select("item_id", F.concat(F.lit('"'), F.translate("text", '"', " "), F.lit('"')).alias("q"))
    return X.search(table(spark, d, "documents"), "doc_id", "text", phrases, "item_id", "q", 5)


@query(f"""with {VIEWS}, q as (select q, term, count(*) as w from (select item_id as q, unnest({WORDS}) as term from benchmark) a group by 1, 2),
    {ranked(BATCHED, 10)}""")
def batched_search(spark, d):
    """The best ten documents for the words of each benchmark text."""
    return X.search(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark").withColumn("q", F.translate("text", '"*', "  ")), "item_id", "q", 10)


@query(f"""with {VIEWS}, q as (select item_id as q, substr(p[1], 1, 3) as prefix, p[2] as term from (select item_id, {WORDS} as p from benchmark) a where len(p) > 1),
    h as (select q, id, size, sum(tf) as tf, 'prefix' as kind from q join i on starts_with(i.term, prefix) group by 1, 2, 3 union all select q, id, size, tf, 'term' from q join i using (term)),
    c as (select q, kind, count(*) as df from h group by 1, 2),
    {ranked(f"select q as query, id, round(sum({BM25} * {PART}), 9) as score from h join c using (q, kind) cross join g group by q, id", 3)}""")
def prefix_search(spark, d):
    """The best three documents for the first three letters of each benchmark text's first word as a prefix, and its second word."""
    words = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("p")).filter("size(p) > 1")
    asked = words.select("item_id", F.concat(F.substring(F.get("p", F.lit(0)), 1, 3), F.lit("* "), F.get("p", F.lit(1))).alias("q"))
    return X.search(table(spark, d, "documents"), "doc_id", "text", asked, "item_id", "q", 3)


@query(f"""with {VIEWS}, q as (select q, term, count(*) as w from (select item_id as q, unnest({WORDS}) as term from benchmark) a group by 1, 2),
    r as (select *, row_number() over (partition by query order by score desc, id) as place from ({BATCHED}) s),
    b as (select query as item, lang as descriptor, max(score) as score, first(doc_id order by score desc, cast(doc_id as varchar)) as entry from r join documents on doc_id = id where place <= 5 group by 1, 2)
    select item, descriptor, cast(entry as varchar) as entry, score from b where not (item % 2 = 0 and descriptor = 'en')""")
def searched_links(spark, d):
    """Benchmark texts searched among documents (terms of a source, which is a concept of a language, which is a descriptor), the best five climbed, and linked by score where no link is yet."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat_ws("/", "lang", "source").alias("concept"), "lang")
    hits = X.search(docs, "doc_id", "text", table(spark, d, "benchmark").withColumn("q", F.translate("text", '"*', "  ")), "item_id", "q", 5).withColumn("id", F.col("id").cast("string"))
    ui, kind = F.col("doc_id").cast("string"), lambda k: F.lit(k).alias("kind")
    entries = docs.select(ui.alias("ui"), kind("Term")).unionByName(docs.select(F.col("concept").alias("ui"), kind("Concept")).distinct()).unionByName(docs.select(F.col("lang").alias("ui"), kind("Descriptor")).distinct())
    links = docs.select(ui.alias("child"), F.col("concept").alias("parent")).unionByName(docs.select(F.col("concept").alias("child"), F.col("lang").alias("parent")).distinct())
    have = table(spark, d, "benchmark").filter("item_id % 2 = 0").select(F.col("item_id").alias("item"), F.lit("en").alias("descriptor"))
    return X.new_links(hits, O.climb(entries, links), have)


def benchmark_concepts(spark, d):
    """Three names of each item: its first word, its first two words, its text."""
    p = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("p"))
    names = F.array(*[F.struct(F.array_join(t, " ").alias("name"), F.lit(k).alias("kind")) for t, k in ((F.slice("p", 1, 1), "word"), (F.slice("p", 1, 2), "pair"), (F.col("p"), "text"))])
    each = p.select(F.col("item_id").alias("concept"), F.explode(names).alias("n"))
    return each.select("concept", "n.name", F.array("n.kind").alias("semtypes"), F.array(F.concat(F.lit("s"), (F.col("concept") % 3).cast("string"))).alias("sources"))


SPANS = f"""b as (select item_id as concept, {WORDS} as p from benchmark), names as (select concept, array_to_string(p[1:1], ' ') as phrase, 'word' as kind from b union all select concept, array_to_string(p[1:2], ' '), 'pair' from b
        union all select concept, array_to_string(p, ' '), 'text' from b),
    listed as (select phrase, concept, list_sort(list(distinct kind)) as semtypes, ['s' || concept % 3] as sources from names where phrase != '' group by phrase, concept),
    t as (select doc_id, {WORDS} as t from documents), ph as (select distinct string_split(phrase, ' ') as w from listed), starts as (select doc_id, unnest(range(1, len(t) + 1)) as i, unnest(t) as word from t),
    hits as (select s.doc_id, i - 1 as start, max(len(w)) as l from starts s join ph on word = w[1] join t on t.doc_id = s.doc_id where t[i:i + len(w) - 1] = w group by 1, 2),
    kept as (select doc_id, list_reduce(list_prepend({{'start': 0::bigint, 'l': 0::bigint, 'kept': []::struct(start bigint, l bigint)[]}}, list({{'start': start, 'l': l, 'kept': []::struct(start bigint, l bigint)[]}} order by start)),
        lambda a, x: case when x.start >= a.start + a.l then {{'start': x.start, 'l': x.l, 'kept': list_append(a.kept, {{'start': x.start, 'l': x.l}})}} else a end).kept as kept from hits group by doc_id),
    each as (select doc_id, unnest(kept) as k from kept),
    found as (select doc_id, cast(k.start as integer) as start, cast(k.start + k.l as integer) as stop, array_to_string(t[k.start + 1:k.start + k.l], ' ') as phrase from each join t using (doc_id))"""


@query(f"""with {SPANS} select doc_id, start, stop, phrase, concept, array_to_string(semtypes, ',') as semtypes, array_to_string(sources, ',') as sources from found join listed using (phrase)""")
def annotated_spans(spark, d):
    found = A.annotations(table(spark, d, "documents"), ["doc_id"], "text", benchmark_concepts(spark, d))
    return found.select("doc_id", "start", F.col("end").alias("stop"), "phrase", "concept", F.array_join("semtypes", ",").alias("semtypes"), F.array_join("sources", ",").alias("sources"))


@query(f"""with {SPANS}, v as (select doc_id, 'concept' as dim, cast(concept as varchar) as value from found join listed using (phrase) union all select doc_id, 'semtype', unnest(semtypes) from found join listed using (phrase)
        union all select doc_id, 'source', unnest(sources) from found join listed using (phrase)),
    c as (select dim, value, count(distinct doc_id) as n from v group by 1, 2)
    select dim, value, n from (select *, row_number() over (partition by dim order by n desc, value) as place from c) x where place <= 20""")
def annotation_facets(spark, d):
    return A.annotation_facets(A.annotations(table(spark, d, "documents"), ["doc_id"], "text", benchmark_concepts(spark, d)), "doc_id", 20)
