"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.canonical import forms_of, map_to_canonical
from quillon.llm.linkage import link
from quillon.llm.lookalike import normalize_looks, same_looking_pairs
from quillon.llm.mixing import mixture, shares
from quillon.llm.nearcopies import near_copies, near_pairs
from quillon.llm.setjoin import classed, overlapping_pairs, set_records, similar_classes
from quillon.llm.tokens import count_tokens, decode_corpus, encode_corpus
from quillon.operators.components import components
from quillon.plans.registry import Registry
from quillon.sources.tables import first_per_key, table

registry = Registry()


@registry.query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Free-entered property names and structures with the entry each one means."""
    lists = {"property_name": forms_of(table(spark, folder, "property_terms"), "property_name", "label", "aliases"), "structure": forms_of(table(spark, folder, "structure_terms"), "structure_name", "aliases")}
    return map_to_canonical(table(spark, folder, "csp_triples", "triple_id", "property_name", "structure"), "triple_id", lists)


@registry.query("p6_ids")
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k, without special tokens."""
    return encode_corpus(table(spark, folder, "documents", "doc_id", "text"))


@registry.query("p6_decoded", "SELECT DISTINCT doc_id, length(coalesce(text, '')) AS n_chars, true AS same FROM documents")
def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text decoded from its ids, and whether it equals the text."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    back = decode_corpus(encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", F.length("decoded").cast("bigint").alias("n_chars"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


@registry.query("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents whose texts look the same but are not the same string."""
    return same_looking_pairs(table(spark, folder, "documents", "doc_id", "text"))


@registry.query("p8_normalized")
def p8_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in one form of characters."""
    return normalize_looks(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "looks")


def _keyword_sets(spark: SparkSession, folder: str) -> DataFrame:
    papers = set_records(table(spark, folder, "papers", "paper_id", "keywords"), "paper_id", "keywords", "paper")
    return papers.unionByName(set_records(table(spark, folder, "paper_pairs", "pair_id", "bridge_keywords"), "pair_id", "bridge_keywords", "pair"))


@registry.query(
    "p4_found",
    r"""WITH r AS (SELECT 'paper' AS kind, paper_id AS k, keywords AS v FROM papers UNION ALL SELECT 'pair', pair_id, bridge_keywords FROM paper_pairs),
    s AS (SELECT kind, k, list_sort(list_distinct(list_filter(list_transform(v, lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x IS NOT NULL AND x <> ''))) AS s FROM r WHERE k IS NOT NULL),
    u AS (SELECT DISTINCT kind, k, s FROM s WHERE len(s) >= 4), t AS (SELECT kind, k, len(s) AS n, unnest(s) AS w FROM u)
    SELECT a.k AS key_a, b.k AS key_b FROM t a JOIN t b ON a.w = b.w AND a.k < b.k AND NOT (a.kind = 'pair' AND b.kind = 'pair') GROUP BY a.k, b.k, a.n, b.n HAVING count(*) * 10 >= 7 * (a.n + b.n - count(*))""",
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Two papers, or a paper and a paper pair, whose sets of at least four key words overlap by 0.7 or more."""
    return overlapping_pairs(_keyword_sets(spark, folder), 0.7, least=4, apart=("pair",)).select("key_a", "key_b")


@registry.query("p4_classes")
def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with its class of equal sets and the number of other classes that overlap with it."""
    classes, members = classed(_keyword_sets(spark, folder), 4)
    links = similar_classes(classes, 0.7, least=4)
    degree = links.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return members.join(degree, "id", "left").select("kind", "key", F.col("id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _paper_copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    papers = first_per_key(table(spark, folder, "papers", "paper_id", "title", "abstract", "ingested_at"), "paper_id", "ingested_at")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return near_copies(papers, "paper_id", text, threshold=0.5, words=3, least=30)


@registry.query(
    "p2_found",
    r"""WITH p AS (SELECT DISTINCT paper_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[a-z0-9]+') AS w FROM papers),
    s AS (SELECT paper_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM p WHERE len(w) >= 3),
    t AS (SELECT paper_id, len(s) AS n, unnest(s) AS r FROM s WHERE len(s) >= 30)
    SELECT a.paper_id AS paper_id_a, b.paper_id AS paper_id_b FROM t a JOIN t b ON a.r = b.r AND a.paper_id < b.paper_id GROUP BY a.paper_id, b.paper_id, a.n, b.n HAVING count(*) * 2 >= a.n + b.n - count(*)""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Two records of papers whose sets of three-word runs have a similarity of at least 0.5."""
    links, members = _paper_copies(spark, folder)
    return near_pairs(links, members, "paper_id")


@registry.query("p2_groups")
def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of at least 30 runs with the group of records that it is linked to, over any number of links."""
    links, members = _paper_copies(spark, folder)
    groups = components(links, "a", "b")
    label = members.join(groups, F.col("class") == F.col("node"), "left").select("paper_id", F.coalesce("component", "class").alias("g"))
    least = label.groupBy("g").agg(F.min("paper_id").alias("group_id"), F.count("*").alias("records"))
    return label.join(least, "g").select("paper_id", "group_id", "records")


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers", "paper_id", "source", "year", "title", "abstract", "authors", "keywords", "ingested_at")
    return link(first_per_key(papers, "paper_id", "ingested_at"))


@registry.query("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Two records of papers from different sources that describe the same work."""
    return _linked(spark, folder).where("confidence >= 0.5").select("paper_id_a", "paper_id_b")


@registry.query("p1_confidence")
def p1_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate with its votes and the posterior of a match."""
    return _linked(spark, folder).withColumn("votes", F.array_join(F.col("votes").cast("array<string>"), ",")).withColumn("confidence", F.round("confidence", 6))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source", "lang", "section")
    sizes = count_tokens(docs)
    return mixture(docs.drop("text").join(sizes, "doc_id"), table(spark, folder, "mix_targets"))


@registry.query("p7_mixture")
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a mixture with the target shares of mix_targets, and how often each is taken."""
    return _mixed(spark, folder)


@registry.query("p7_shares")
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source of mix_targets."""
    return shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))
