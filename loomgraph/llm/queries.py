"""The thin queries over the operators, one for each, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bpe import bpe_round_trip
from loomgraph.llm.brown import brown_scores
from loomgraph.llm.chaining import repeats
from loomgraph.llm.fingerprint import edited_fingerprints
from loomgraph.llm.jaccard_join import jaccard_join
from loomgraph.llm.merkle import tampered_manifest
from loomgraph.llm.mixing import mix
from loomgraph.llm.packing import pack
from loomgraph.llm.sql import MERKLE, VARIANTS
from loomgraph.llm.threshold_search import threshold_search
from loomgraph.llm.token_counts import token_counts
from loomgraph.llm.toxicity import is_held_out, toxicity
from loomgraph.llm.url_filter import filter_urls, site_rule
from loomgraph.llm.variants import spelling_variants, typo_words

URL_RULES = (
    site_rule("org/", "allow"),
    site_rule("example.org/es/", "block"),
    site_rule("example.org/en/1", "block"),
    site_rule("com/fr/", "allow"),
    site_rule("com/de/", "block"),
)
#: Shares of the tokens that each domain should have.
TARGETS = {"high": 0.6, "low": 0.35, "toxic": 0.05}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(table(spark, sf_dir, "documents"), is_held_out("doc_id", 1))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return threshold_search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(typo_words(table(spark, sf_dir, "documents")))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_url_filters, op3_token_counts, op4_source_mixing, op5_lm_scoring, op6_packing,
        op7_toxicity, op8_ngram_jaccard_join, op9_exact_topk, op10_document_fingerprints, op11_merkle_manifest, op12_spelling_variants, op13_bpe_round_trip,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": """
        with rules(rule, rhost, rpath, verdict) as (values
            ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'allow'),
            ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
        rest as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as r from pages),
        parts as (select page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as n from rest),
        fits as (select n, rule, verdict, row_number() over (partition by n order by length(rule) desc) as place from parts join rules
            on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
        select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict from parts p left join fits f on f.n = p.n and f.place = 1
    """,
    "op9_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) as bigint) as score
            from v a join v b on a.vec_id != b.vec_id where a.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s)
        select query_id, cast(place as integer) as rank, vec_id, score from r where place <= 5
    """,
    "op11_merkle_manifest": MERKLE,
    "op12_spelling_variants": VARIANTS,
}
