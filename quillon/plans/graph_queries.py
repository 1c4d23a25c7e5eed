"""Queries over the concept graph, gaps, search and directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import directions, gaps, graph, search
from quillon.operators.components import components
from quillon.plans.hypothesis_queries import _HYPO, hypotheses, stated, trials
from quillon.plans.material_queries import TRIPLES, triples
from quillon.plans.registry import Registry, typed
from quillon.plans.text_queries import PAPERS, paper_pairs, papers
from quillon.sources.tables import table

registry = Registry()

_KW5 = "list_filter(coalesce(keywords, []), lambda k: k IS NOT NULL AND trim(k) <> '')"
_EDGES = f"""{_HYPO}, pe AS (SELECT DISTINCT paper_id AS src, 'concept_' || replace(lower(k), ' ', '_') AS dst, 'relates_to' AS relation FROM (SELECT paper_id, unnest({_KW5}[1:5]) AS k FROM papers1)),
    he AS (SELECT DISTINCT hypothesis_id AS src, p AS dst, 'derives_from' AS relation FROM (SELECT hypothesis_id, unnest([paper_a_id, paper_b_id]) AS p FROM h) WHERE p IN (SELECT paper_id FROM papers1)),
    hk AS (SELECT src, dst, min(i) AS i FROM (SELECT hypothesis_id AS src, 'concept_' || replace(lower(unnest({_KW5})), ' ', '_') AS dst, generate_subscripts({_KW5}, 1) AS i FROM h) WHERE dst IN (SELECT dst FROM pe) GROUP BY src, dst),
    hv AS (SELECT src, dst, 'validates' AS relation FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY i, dst) AS rn FROM hk) WHERE rn <= 3),
    edges AS (SELECT * FROM pe UNION ALL SELECT * FROM he UNION ALL SELECT * FROM hv)"""


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    p = papers(spark, folder, "keywords")
    e = graph.paper_edges(p)
    return e.unionByName(graph.hypothesis_edges(hypotheses(spark, folder), e, p))


@registry.query("graph_summary", f"WITH {_EDGES} SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY relation")
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder).groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@registry.query("graph_nodes", f"WITH {_EDGES}, n AS (SELECT src AS node, CASE relation WHEN 'relates_to' THEN 'paper' ELSE 'hypothesis' END AS kind FROM edges UNION SELECT dst, CASE relation WHEN 'derives_from' THEN 'paper' ELSE 'concept' END FROM edges) SELECT kind, count(*) AS nodes FROM n GROUP BY kind")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of each kind that an edge has."""
    e = _graph(spark, folder)
    n = e.select(F.col("src").alias("node"), F.when(F.col("relation") == "relates_to", "paper").otherwise("hypothesis").alias("kind")).unionByName(e.select(F.col("dst").alias("node"), F.when(F.col("relation") == "derives_from", "paper").otherwise("concept").alias("kind")))
    return n.distinct().groupBy("kind").agg(F.count("*").alias("nodes"))


@registry.query("graph_degree", f"WITH {_EDGES}, b AS (SELECT DISTINCT * FROM (SELECT src AS node, dst AS near FROM edges UNION ALL SELECT dst, src FROM edges)) SELECT node, count(*) AS degree FROM b GROUP BY node ORDER BY degree DESC, node LIMIT 100")
def graph_degree(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred nodes with most neighbours."""
    return graph.neighbours(_graph(spark, folder)).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(100)


@registry.query("concept_clusters", f"WITH {_EDGES} SELECT dst AS concept, count(*) AS papers, min(src) AS first_paper FROM pe GROUP BY dst HAVING count(*) >= 2 ORDER BY papers DESC, concept LIMIT 50")
def concept_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty concepts with most papers."""
    e = graph.paper_edges(papers(spark, folder, "keywords"))
    return e.groupBy(F.col("dst").alias("concept")).agg(F.count("*").alias("papers"), F.min("src").alias("first_paper")).where("papers >= 2").orderBy(F.desc("papers"), "concept").limit(50)


@registry.query("graph_bridge_concepts", f"WITH {_EDGES}, pp AS (SELECT DISTINCT paper_a_id, paper_b_id FROM paper_pairs) SELECT paper_a_id, paper_b_id, a.dst AS bridge FROM pp JOIN pe a ON a.src = paper_a_id JOIN pe b ON b.src = paper_b_id AND a.dst = b.dst")
def graph_bridge_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts next to both papers of a pair."""
    e = graph.paper_edges(papers(spark, folder, "keywords"))
    pairs = table(spark, folder, "paper_pairs", "paper_a_id", "paper_b_id").distinct()
    return graph.common_neighbours(e, pairs, "paper_a_id", "paper_b_id")


_HOPS = ", ".join(f"s{i} AS (SELECT DISTINCT near AS node FROM b WHERE node IN (SELECT node FROM s{i - 1}) AND near NOT IN (SELECT node FROM u{i - 1})), u{i} AS (SELECT node FROM u{i - 1} UNION SELECT node FROM s{i})" for i in range(1, 6))


@registry.query("graph_bfs_hops", f"""WITH {_EDGES}, b AS (SELECT DISTINCT * FROM (SELECT src AS node, dst AS near FROM edges UNION ALL SELECT dst, src FROM edges)), s0 AS (SELECT min(paper_id) AS node FROM papers1), u0 AS (SELECT node FROM s0), {_HOPS}
    SELECT hops, count(*) AS nodes, min(node) AS first_node FROM ({" UNION ALL ".join(f"SELECT {i} AS hops, node FROM s{i}" for i in range(6))}) GROUP BY hops""")
def graph_bfs_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by their distance from the first paper, up to five edges."""
    start = table(spark, folder, "papers", "paper_id").agg(F.min("paper_id")).first()[0]
    return graph.hops(_graph(spark, folder), start, 5).groupBy("hops").agg(F.count("*").alias("nodes"), F.min("node").alias("first_node"))


@registry.query("graph_components", """WITH RECURSIVE e AS (SELECT DISTINCT paper_a_id AS a, paper_b_id AS b FROM paper_pairs WHERE paper_a_id <> paper_b_id), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, reached) AS (SELECT DISTINCT a, a FROM n UNION SELECT r.node, n.b FROM r JOIN n ON r.reached = n.a)
    SELECT component, count(*) AS papers FROM (SELECT node, min(reached) AS component FROM r GROUP BY node) GROUP BY component""")
def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of papers that delivered pairs link, by size (tested against union-find)."""
    c = components(paper_pairs(spark, folder, "paper_a_id", "paper_b_id"), "paper_a_id", "paper_b_id")
    return c.groupBy("component").agg(F.count("*").alias("papers"))


_BEFORE = "CASE WHEN regexp_matches(k, '^[\\p{L}\\p{N}]') THEN '(?:^|[^\\p{L}\\p{N}.]|(?:^|[^\\p{L}\\p{N}])\\.)' ELSE '' END"
_AFTER = "CASE WHEN regexp_matches(k, '[\\p{L}\\p{N}]$') THEN '(?:$|[^\\p{L}\\p{N}.]|\\.(?:$|[^\\p{L}\\p{N}]))' ELSE '' END"


@registry.query("gap_support", f"""WITH {_HYPO}, kw AS (SELECT DISTINCT hypothesis_id, trim(lower(k)) AS k FROM (SELECT hypothesis_id, unnest(keywords) AS k FROM h WHERE hypothesis_type IN ('gap', 'gap_filling')) WHERE k IS NOT NULL AND trim(lower(k)) <> ''),
    d AS MATERIALIZED (SELECT paper_id, t, regexp_extract_all(t, '{gaps.WORD}') AS ws FROM (SELECT paper_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM papers1)),
    u AS (SELECT DISTINCT k FROM kw), c AS MATERIALIZED (SELECT k, paper_id, t, ws FROM u, d WHERE contains(t, k)),
    m AS (SELECT k, paper_id FROM c WHERE CASE WHEN regexp_full_match(k, '{gaps.WORD}') THEN list_contains(ws, k) ELSE regexp_matches(k, '[\\p{{L}}\\p{{N}}]') AND regexp_matches(t, {_BEFORE} || regexp_escape(k) || {_AFTER}) END),
    n AS (SELECT hypothesis_id, paper_id, count(*) AS hits FROM kw JOIN m USING (k) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY hits DESC, paper_id) AS rn FROM n WHERE hits >= 2)
    SELECT hypothesis_id, string_agg(paper_id, '|' ORDER BY rn) AS papers, CAST(count(*) AS INTEGER) AS n FROM r WHERE rn <= 5 GROUP BY hypothesis_id""")
def gap_support(spark: SparkSession, folder: str) -> DataFrame:
    """For each gap hypothesis up to five papers that hold two of its key words or more (tested against brute force)."""
    h = stated(spark, folder).where(F.col("hypothesis_type").isin("gap", "gap_filling"))
    m = gaps.nearest(h, "hypothesis_id", "keywords", papers(spark, folder, "title", "abstract"), gaps.MOST_SUPPORT)
    return gaps.support(m, "hypothesis_id").select("hypothesis_id", F.array_join("papers", "|").alias("papers"), F.size("papers").alias("n"))


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    t = triples(spark, folder, "composition", "structure", "property_name", "property_value", "source_paper_id")
    return gaps.records(stated(spark, folder), t, papers(spark, folder, "title", "abstract"))


@registry.query("gap_score_rank")
def gap_score_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps scored by the papers and triples that speak for or against them (tested on a small fixture)."""
    return _gaps(spark, folder).select("gap_id", "review", "evidence", "novelty", "feasibility", "rank_score")


@registry.query("gap_records")
def gap_records(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct gaps with their evidence, chain and plan (tested on a small fixture)."""
    g = gaps.distinct_gaps(_gaps(spark, folder))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["role"], x["paper_id"])), "|")
    return g.select("gap_id", "gap_type", "description", flat("supporting").alias("supporting"), flat("counter_evidence").alias("counter_evidence"), F.coalesce(F.size("context"), F.lit(0)).alias("context"), "review", "why_not_known", "verification_plan", "rank_score")


_PARTS = "0.25 * evidence + 0.2 * novelty + 0.2 * plausibility + 0.15 * falsifiability + 0.1 * synthesizability + 0.1 * database_gap"


@registry.query("fitness_score", typed(f"""WITH {TRIPLES}, t AS (SELECT composition, coalesce(structure, 'unknown') AS structure, property_name, max((property_value IS NOT NULL)::INT) = 1 AS ranged FROM t1 WHERE composition IS NOT NULL AND property_name IS NOT NULL GROUP BY ALL ORDER BY composition, structure, property_name LIMIT 50),
    f AS (SELECT composition, count(*) AS n, count(DISTINCT source_paper_id) AS p, list(concat_ws('|', structure, property_name)) AS ex FROM t1 WHERE composition IS NOT NULL GROUP BY composition), j AS (SELECT t.*, n, p, list_contains(ex, structure || '|' || property_name) AS exact, length(regexp_replace(composition, '[^A-Z]', '', 'g')) AS el FROM t JOIN f USING (composition)),
    s AS (SELECT *, least(1.0, 0.15 * n + 0.1 * p) AS evidence, CASE WHEN p = 0 THEN 0.8 WHEN p <= 2 THEN 0.6 WHEN p <= 5 THEN 0.4 ELSE 0.2 END AS novelty, CASE WHEN {" OR ".join(f"(structure = '{k}' AND (el < {a} OR el > {b}))" for k, (a, b) in search.STOICHIOMETRY.items())} THEN 0.1 ELSE 0.8 END AS plausibility,
        CASE WHEN ranged THEN 0.9 ELSE 0.3 END AS falsifiability, CASE WHEN structure = 'unknown' THEN 0.3 ELSE 0.7 END AS synthesizability, CASE WHEN exact THEN 0.1 ELSE 0.8 END AS database_gap FROM j)
    SELECT 'cand_' || substring(md5(composition || '|' || structure || '|' || property_name), 1, 8) AS candidate_id, composition, structure, property_name, round({_PARTS}, 6) AS fitness FROM s""", "DOUBLE", "fitness"))
def fitness_score(spark: SparkSession, folder: str) -> DataFrame:
    """Fitness of the fifty seeds of a search."""
    t = triples(spark, folder, "composition", "structure", "property_name", "property_value", "source_paper_id")
    return search.fitness(search.seeds(t), search.facts_of(t)).select("candidate_id", "composition", "structure", "property_name", "fitness")


@registry.query("evolution_search")
def evolution_search(spark: SparkSession, folder: str) -> DataFrame:
    """The population after three generations (iterative; tested for its invariants)."""
    t = triples(spark, folder, "composition", "structure", "property_name", "property_value", "source_paper_id")
    names = [r[0] for r in table(spark, folder, "property_terms", "property_name").orderBy("property_name").collect()]
    return search.search(t, names, generations=3).select("candidate_id", "composition", "structure", "property_name", "generation", "fitness")


@registry.query("direction_state_replay")
def direction_state_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Directions of each hypothesis type after all trials in order (stateful; tested event by event)."""
    t = trials(spark, folder)
    events = t.select(F.coalesce("hypothesis_type", F.lit("other")).alias("host"), "created_at", F.col("hypothesis_id").alias("source"), F.when(F.col("passed"), "support").otherwise("failure").alias("kind"), "keywords", "score", F.coalesce("novelty", F.lit(0.0)).alias("novelty"), F.coalesce("hypothesis_type", F.lit("other")).alias("label"))
    d = directions.replay(events, "host", ["created_at", "source"])
    return d.select("host", "direction_id", "label", F.round("confidence", 6).alias("confidence"), "support", "failures", "promising")


@registry.query("literature_review", f"""WITH {PAPERS}, c AS (SELECT trim(lower(k)) AS word FROM (SELECT unnest(keywords) AS k FROM papers1) WHERE k IS NOT NULL AND trim(k) <> '') SELECT 'keyword' AS what, word AS name, count(*) AS n FROM c GROUP BY word QUALIFY row_number() OVER (ORDER BY count(*) DESC, word) <= 20
    UNION ALL SELECT 'category', coalesce(categories[1], 'unknown'), count(*) FROM papers1 GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, coalesce(categories[1], 'unknown')) <= 10""")
def literature_review(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most frequent key words and ten most frequent categories."""
    p = papers(spark, folder, "keywords", "categories")
    kw = p.select(F.explode(F.transform("keywords", lambda w: F.trim(F.lower(w)))).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(20)
    cat = p.groupBy(F.coalesce(F.get("categories", F.lit(0)), F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    return kw.select(F.lit("keyword").alias("what"), "name", "n").unionByName(cat.select(F.lit("category").alias("what"), "name", "n"))


@registry.query("corpus_sensors", f"""WITH {PAPERS}, k AS (SELECT count(DISTINCT lower(k)) AS n FROM (SELECT unnest(keywords) AS k FROM papers1) WHERE k IS NOT NULL), c AS (SELECT count(DISTINCT coalesce(categories[1], 'unknown')) AS n FROM papers1), pp AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY paired_at) rn FROM paper_pairs) WHERE rn = 1)
    SELECT least(1.0, (SELECT n FROM k) / 50.0)::DOUBLE AS diversity, (SELECT n FROM c) AS domains, round(avg(CASE WHEN cross_domain THEN 1.0 ELSE 0 END), 6) AS cross_ratio, round(avg(similarity), 6) AS mean_similarity FROM pp""")
def corpus_sensors(spark: SparkSession, folder: str) -> DataFrame:
    """Diversity, domains, share of cross-domain pairs and mean similarity of the corpus."""
    p = papers(spark, folder, "keywords", "categories")
    k = p.select(F.explode(F.transform("keywords", lambda w: F.lower(w))).alias("k")).where("k is not null").agg(F.least(F.lit(1.0), F.count_distinct("k") / 50.0).alias("diversity"))
    c = p.agg(F.count_distinct(F.coalesce(F.get("categories", F.lit(0)), F.lit("unknown"))).alias("domains"))
    s = paper_pairs(spark, folder, "cross_domain", "similarity").agg(F.round(F.avg(F.when(F.col("cross_domain"), 1.0).otherwise(0.0)), 6).alias("cross_ratio"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))
    one = F.lit(1).alias("one")
    return k.select(one, "*").join(c.select(one, "*"), "one").join(s.select(one, "*"), "one").drop("one")


_ = PAPERS
