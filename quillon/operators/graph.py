"""The concept graph: papers, concepts and hypotheses as nodes and edges tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import cut

CONCEPTS_PER_PAPER, CONCEPTS_PER_HYPOTHESIS = 5, 3
WEIGHTS = {"relates_to": 1.0, "derives_from": 0.8, "validates": 0.6}


def concept_id(word: Column) -> Column:
    return F.concat(F.lit("concept_"), F.regexp_replace(F.lower(word), " ", "_"))


def _words(keywords: Column) -> Column:
    return F.filter(keywords, lambda k: k.isNotNull() & (F.trim(k) != ""))


def paper_edges(papers: DataFrame, key: str = "paper_id", keywords: str = "keywords") -> DataFrame:
    """(src, dst, relation, weight): each paper relates to its first five concepts. Null keys and null key words give no edge."""
    e = papers.where(F.col(key).isNotNull()).select(F.col(key).alias("src"), F.explode(F.slice(_words(F.col(keywords)), 1, CONCEPTS_PER_PAPER)).alias("k"))
    return e.select("src", concept_id(F.col("k")).alias("dst")).distinct().select("src", "dst", F.lit("relates_to").alias("relation"), F.lit(WEIGHTS["relates_to"]).alias("weight"))


def hypothesis_edges(hypotheses: DataFrame, edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges of hypotheses to papers that exist (derives_from) and to up to three concepts that the graph has (validates)."""
    ids = papers.select(F.col("paper_id").alias("dst")).distinct()
    origin = hypotheses.select(F.col("hypothesis_id").alias("src"), F.explode(F.array("paper_a_id", "paper_b_id")).alias("dst")).distinct().join(ids, "dst", "left_semi")
    at = hypotheses.select(F.col("hypothesis_id").alias("src"), F.posexplode(_words(F.col("keywords"))).alias("i", "k")).select("src", "i", concept_id(F.col("k")).alias("dst"))
    concepts = edges.select("dst").distinct()
    known = at.join(concepts, "dst", "left_semi").groupBy("src", "dst").agg(F.min("i").alias("i"))
    three = known.groupBy("src").agg(F.slice(F.sort_array(F.collect_list(F.struct("i", "dst"))), 1, CONCEPTS_PER_HYPOTHESIS).alias("c")).select("src", F.explode("c").alias("x")).select("src", F.col("x.dst").alias("dst"))
    edge = lambda d, r: d.select("src", "dst", F.lit(r).alias("relation"), F.lit(WEIGHTS[r]).alias("weight"))
    return edge(origin, "derives_from").unionByName(edge(three, "validates"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, near), each edge both ways, distinct."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("near"))).distinct()


def common_neighbours(edges: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, bridge) for each pair and each node next to both."""
    n = edges.select("src", "dst").distinct()
    left = pairs.join(n.select(F.col("src").alias(a), F.col("dst").alias("bridge")), a)
    return left.join(n.select(F.col("src").alias(b), F.col("dst").alias("bridge")), [b, "bridge"]).select(a, b, "bridge")


def hops(edges: DataFrame, start: str, most: int = 5) -> DataFrame:
    """(node, hops) of all nodes within ``most`` edges of ``start``, breadth first, edges taken both ways.

    One frontier join a hop; the frontier is cut from its lineage in the shared folder.
    """
    near = cut(neighbours(edges))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node string, hops int")
    frontier = seen
    for k in range(1, most + 1):
        step = frontier.select("node").join(near, "node").select(F.col("near").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(step.withColumn("hops", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def evict(nodes: DataFrame, edges: DataFrame, most: int, age: str = "added_at") -> tuple[DataFrame, DataFrame]:
    """The ``most`` youngest nodes and the edges between nodes that stay."""
    kept = nodes.orderBy(F.desc(age), "node_id").limit(most)
    ids = kept.select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return kept, e
