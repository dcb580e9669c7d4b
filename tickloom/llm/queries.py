"""The registered queries of the dealt operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import centroid_clusters, collision_search, filter_audit, itq_dedup, license_scan, mixing, ngram_join, packing, perspectives, repeats, sentencepiece_codec, toxicity, url_filters
from tickloom.llm.common import prepare, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with the same label."""
    return itq_dedup.near_duplicates(table(prepare(spark), sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    coded = sentencepiece_codec.encode_decode(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        "agrees",
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that are not held out."""
    scored = toxicity.score(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", F.col("_held_out").alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    base = table(prepare(spark), sf_dir, "embeddings")
    return collision_search.nearest(base, base.where("vec_id % 20 = 0"), 20)


# The rules of hosts and paths.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Words in a URL that speak of spam, advertising or adult pages.
BLOCKED_WORDS = ("cheap-pills", "casino", "xxx", "porn", "viagra", "free-money", "click-track", "adserver", "doubleclick", "warez", "phishing", "payday-loans")
URL_RULES = [url_filters.host_rule(*r) for r in HOST_RULES] + [url_filters.word_rule(w) for w in BLOCKED_WORDS]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    judged = url_filters.judge(table(prepare(spark), sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar shingle sets."""
    return ngram_join.similar_sets(table(prepare(spark), sf_dir, "documents"), n=4, percent=85)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template labels of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents")).documents


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes; in columns beside it, without its passages of over fifty words that repeat."""
    documents = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    cleaned = repeats.remove_repeats(documents, 400, passages=repeats.Passages())
    length, passages = (F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]) for c in ("_spans", "_passages"))
    return cleaned.select(
        "doc_id", F.col("_bytes").alias("n_bytes"), length.alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
        (F.col("_bytes") - length).alias("n_kept"), (F.size("_spans") > 0).alias("is_changed"),
        repeats.kept_text().alias("text"),
        F.size("_passages").cast("long").alias("n_passages"), passages.alias("n_passage_bytes"), repeats.kept_text("_rest").alias("text_without_passages"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, for each source."""
    return filter_audit.audit(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    rows = stored(mixing.ordered(table(prepare(spark), sf_dir, "documents"), keep=["doc_id"]), "mix-rows")
    taken = mixing.mix(rows).documents()
    return taken.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.size("_shards")).alias("taken"),
    )


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors after ten rounds."""
    return centroid_clusters.cluster(table(prepare(spark), sf_dir, "embeddings"))


_WORDS_SQL = "|".join(w.replace("-", "[-_.]") for w in BLOCKED_WORDS)
URL_SQL = f"""
WITH split AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS sep FROM pages
), rest AS (
  SELECT page_id, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS rest FROM split
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^([^?#]*)', 1) AS both_parts FROM rest
), hosts AS (
  SELECT page_id, rest, both_parts, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(both_parts, length(raw_host) + 1) AS path FROM parts
), rules AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM hosts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(lower(host || ' ' || path || substr(rest, length(both_parts) + 1)), '(^|[^a-z0-9])({_WORDS_SQL})([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM rules
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_itq_near_duplicates, op2_sentencepiece, op3_toxicity, op4_perspectives, op5_packing,
        op6_collision_search, op7_url_filters, op8_ngram_join, op9_license_scan, op10_repeats,
        op11_filter_audit, op12_mix, op13_centroid_clusters,
    )
}
SQL: dict[str, str] = {
    "op1_itq_near_duplicates": itq_dedup.LINKS_SQL,
    "op4_perspectives": perspectives.ROTATE_SQL,
    "op7_url_filters": URL_SQL,
    "op8_ngram_join": ngram_join.SETS_SQL,
    "op9_license_scan": license_scan.scan_sql(),
    "op11_filter_audit": filter_audit.AUDIT_SQL,
    "op12_mix": mixing.MIX_SQL,
    "op13_centroid_clusters": centroid_clusters.CLUSTERS_SQL,
}
