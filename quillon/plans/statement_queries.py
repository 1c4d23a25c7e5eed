"""Queries over statements of hypotheses and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import units
from quillon.functions.lexicons import sql_list
from quillon.operators import gaps, generation, statements, titles
from quillon.plans.hypothesis_queries import _HYPO, _TRIAL, _any, hypotheses, stated, trials
from quillon.operators.quantities import resolved
from quillon.plans.material_queries import TRIPLES, property_forms, structure_forms, triples
from quillon.plans.registry import Registry, typed
from quillon.plans.text_queries import paper_pairs, papers, words_sql
from quillon.session import cut
from quillon.sources.tables import first_per_key, table

registry = Registry()

_TERMS = f"list_filter({words_sql('statement')}, lambda w: length(w) >= 5)"
_V = sql_list(statements.VAGUE_TERMS)


@registry.query("falsifiability", f"""WITH {_HYPO}, a AS (SELECT hypothesis_id, lower(coalesce(statement, '')) AS s, {_TERMS} AS t0 FROM h), b AS (SELECT *, list_filter(t0, lambda x, i: list_position(t0, x) = i)[1:5] AS t FROM a),
    c AS (SELECT *, len(list_filter(t, lambda w: NOT list_contains({_V}, w))) AS solid, len(list_filter({_V}, lambda w: contains(s, w))) AS vague, len(list_filter(regexp_extract_all(s, '[a-z]{{3,}}[- ][a-z]{{3,}}'), lambda p: len(list_filter({_V}, lambda v: contains(p, v))) = 0)) > 0 AS phrase FROM b)
    SELECT hypothesis_id, round(least(1.0, greatest(0.0, CASE WHEN solid >= 2 THEN 0.4 WHEN solid = 1 THEN 0.3 WHEN len(t) > 0 THEN 0.05 ELSE 0 END + CASE WHEN {_any('s', statements.OBSERVABLE)} THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(s, '≈\\s*[0-9]') THEN 0.2 ELSE 0 END
        - 0.1 * len(list_filter({sql_list(statements.FILLERS)}, lambda w: contains(s, w))) + CASE WHEN length(s) > 50 THEN 0.1 ELSE 0 END - CASE WHEN vague >= 2 AND NOT phrase AND NOT regexp_matches(s, '≈\\s*[0-9]') THEN 0.25 ELSE 0 END)), 6)::DOUBLE AS score FROM c""")
def falsifiability(spark: SparkSession, folder: str) -> DataFrame:
    return hypotheses(spark, folder).select("hypothesis_id", F.round(statements.falsifiability(F.col("statement")), 6).alias("score"))


@registry.query("content_gate")
def content_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons for which the content of hypotheses fails; back-references keep it out of RE2 (tested case by case)."""
    return statements.content_violations(hypotheses(spark, folder)).select("hypothesis_id", F.array_join("violations", ",").alias("violations"), (F.size("violations") == 0).alias("passes"))


@registry.query("stated_numbers")
def stated_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Properties with a number out of bounds near their name, and a range read from the statement (look-ahead keeps it out of RE2)."""
    low, high = statements.stated_range(F.col("statement"))
    return hypotheses(spark, folder).select("hypothesis_id", F.array_join(statements.number_violations(F.col("statement")), ",").alias("violations"), low.alias("low"), high.alias("high"))


_LABEL = "coalesce(CASE hypothesis_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in statements.LABELS.items()) + " END, 'Direction')"


@registry.query("direction_labels", f"WITH {_HYPO} SELECT hypothesis_id, {_LABEL} || ': ' || array_to_string(list_filter(coalesce(keywords, []), lambda k: k IS NOT NULL AND NOT list_contains({_V}, lower(k)))[1:3], ' + ') AS label FROM h")
def direction_labels(spark: SparkSession, folder: str) -> DataFrame:
    return hypotheses(spark, folder).select("hypothesis_id", statements.direction_label(F.col("hypothesis_type"), F.col("keywords")).alias("label"))


@registry.query("merged_keywords", """WITH pp AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY paired_at) rn FROM paper_pairs) WHERE rn = 1), a AS (SELECT pair_id, list_filter(list_concat(coalesce(paper_a_keywords, []), coalesce(paper_b_keywords, [])), lambda k: k IS NOT NULL) AS k FROM pp),
    b AS (SELECT pair_id, k, list_transform(k, lambda x: lower(x)) AS l FROM a) SELECT pair_id, array_to_string(list_filter(k, lambda x, i: list_position(l, lower(x)) = i)[1:10], '|') AS keywords FROM b""")
def merged_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Key words of both papers of a pair, the first of each whatever the case."""
    return paper_pairs(spark, folder, "paper_a_keywords", "paper_b_keywords").select("pair_id", F.array_join(statements.merged_keywords(F.col("paper_a_keywords"), F.col("paper_b_keywords")), "|").alias("keywords"))


@registry.query("search_queries")
def search_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Queries for each composition and property, by whatever name it was entered, with synonyms (tested case by case)."""
    t = triples(spark, folder, "composition", "property_name").where("composition is not null").select("composition", "property_name").distinct()
    t = resolved(t, "property_name", property_forms(spark, folder))
    t = t.select("composition", F.replace("property_name", F.lit("_"), F.lit(" ")).alias("property")).distinct()
    return t.select("composition", "property", F.array_join(statements.search_queries(F.col("composition"), F.col("property")), "|").alias("queries"))


def paper_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of papers with a composition, by the entries that their properties and structures mean."""
    t = triples(spark, folder, "source_paper_id", "property_name", "structure", "composition", "property_value", "property_unit").where("source_paper_id is not null and composition is not null")
    return resolved(resolved(t, "property_name", property_forms(spark, folder)), "structure", structure_forms(spark, folder))


@registry.query("material_branches")
def material_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Which kind of material hypothesis each pair of papers leads to, by what their triples share (tested case by case)."""
    t = paper_facts(spark, folder)
    g = t.groupBy("source_paper_id").agg(F.collect_set("property_name").alias("props"), F.collect_set("structure").alias("structs"), F.collect_set("composition").alias("comps"), (F.count("property_value") > 0).alias("val"))
    side = lambda s: g.select(F.col("source_paper_id").alias(f"paper_{s}_id"), *[F.col(c).alias(f"{c}_{s}") for c in ("props", "structs", "comps", "val")])
    j = paper_pairs(spark, folder, "paper_a_id", "paper_b_id").join(side("a"), "paper_a_id", "left").join(side("b"), "paper_b_id", "left")
    j = j.select("pair_id", F.col("props_a").isNotNull().alias("valid_a"), F.col("props_b").isNotNull().alias("valid_b"), F.arrays_overlap("props_a", "props_b").alias("shared"), F.col("val_a").alias("value_a"), F.col("val_b").alias("value_b"), F.arrays_overlap("structs_a", "structs_b").alias("same_structure"), F.arrays_overlap("comps_a", "comps_b").alias("same_composition"))
    b = statements.material_branches(j).select(F.when(F.col("pending"), F.concat("branch", F.lit("_pending"))).otherwise(F.col("branch")).alias("branch"))
    return b.groupBy("branch").agg(F.count("*").alias("pairs"))


@registry.query("general_hypotheses")
def general_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    """A hypothesis for each delivered pair of papers, by templates (tested case by case)."""
    return generation.general(pairs_with_categories(spark, folder)).select("hypothesis_id", "pair_id", "hypothesis_type", "statement", "falsifiability", F.array_join("keywords", "|").alias("keywords"), "novelty", "confidence")


@registry.query("material_hypotheses")
def material_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    """A hypothesis for each delivered pair, with a predicted interval where the triples of both papers give one (tested case by case)."""
    g = generation.material(pairs_with_categories(spark, folder), paper_facts(spark, folder))
    return g.select("hypothesis_id", "pair_id", "hypothesis_type", "statement", "low", "high", "unit", "pending", "fallback", "known_principle", "novelty", "confidence")


def pairs_with_categories(spark: SparkSession, folder: str) -> DataFrame:
    cols = [f"paper_{s}_{c}" for s in "ab" for c in ("id", "title", "keywords", "abstract")]
    pp = paper_pairs(spark, folder, *cols, "similarity", "cross_domain", "pair_type", "bridge_keywords", "connection_reason")
    c = papers(spark, folder, "categories").select("paper_id", F.get("categories", F.lit(0)).alias("c"))
    for s in "ab":
        pp = pp.join(c.select(F.col("paper_id").alias(f"paper_{s}_id"), F.col("c").alias(f"category_{s}")), f"paper_{s}_id", "left")
    return pp


@registry.query("template_statements")
def template_statements(spark: SparkSession, folder: str) -> DataFrame:
    """A statement for each pair with bridge words, from the template that a hash of the pair chooses (tested slot by slot)."""
    pp = paper_pairs(spark, folder, "paper_a_title", "paper_b_title", "pair_type", "bridge_keywords").where(F.size("bridge_keywords") > 0)
    kind = F.when(F.col("pair_type").isin("cross_domain_bridge", "method_transfer"), "analogy").when(F.col("pair_type") == "concept_complement", "combination").when(F.col("pair_type") == "contradiction", "contradiction").otherwise("gap")
    w = F.filter("bridge_keywords", lambda k: k.isNotNull())
    s = statements.template_statement(kind, F.col("pair_id"), w=F.get(w, F.lit(0)), c=F.coalesce(F.get(w, F.lit(1)), F.get(w, F.lit(0))), a=F.col("paper_a_title"), b=F.coalesce("paper_b_title", F.lit("other work")))
    return pp.select("pair_id", kind.alias("kind"), s.alias("statement"))


@registry.query("counter_evidence")
def counter_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Papers that speak against each gap, by strength (tested on a small fixture)."""
    h = stated(spark, folder).where(F.col("hypothesis_type").isin("gap", "gap_filling"))
    t = triples(spark, folder, "composition", "property_name", "property_value", "source_paper_id")
    terms = table(spark, folder, "property_terms", "property_name", F.lower("label").alias("label"))
    words = h.select("hypothesis_id", F.explode("keywords").alias("k")).where("k is not null")
    prop = words.join(F.broadcast(terms), F.lower("k") == F.col("label")).groupBy("hypothesis_id").agg(F.min("property_name").alias("property_name"))
    comp = words.where(F.col("k").rlike(r"^([A-Z][a-z]?[0-9.]*){2,}$")).groupBy("hypothesis_id").agg(F.min("k").alias("composition"))
    g = h.select("hypothesis_id").join(comp, "hypothesis_id", "left").join(prop, "hypothesis_id", "left").withColumnRenamed("hypothesis_id", "gap_id")
    p = papers(spark, folder, "title", "abstract")
    # Of the first papers five may be supporters; each exact match among them takes a place as well.
    m = cut(gaps.nearest(h.join(comp, "hypothesis_id", "left"), "hypothesis_id", "keywords", p, gaps.MOST_SUPPORT + gaps.MOST_COUNTER, own="composition"))
    mentioned = m.select(F.col("hypothesis_id").alias("gap_id"), "paper_id", "hits", (F.col("hits") == 1).alias("has_composition"))
    s = gaps.support(m, "hypothesis_id").select(F.col("hypothesis_id").alias("gap_id"), F.explode("papers").alias("paper_id"))
    return gaps.counter_evidence(g, t, mentioned, s)


@registry.query("unit_compatibility")
def unit_compatibility(spark: SparkSession, folder: str) -> DataFrame:
    """How often a recorded unit measures its property, by property (the table of units is the oracle, tested on its own)."""
    terms = table(spark, folder, "property_terms", "property_name", "common_unit")
    targets = [r[0] for r in terms.select("common_unit").distinct().collect() if r[0]]
    known = F.broadcast(spark.createDataFrame([(s, t) for s, t, _, _ in units.conversion_rows(targets)], "u string, common_unit string").withColumn("fits", F.lit(True)))
    t = triples(spark, folder, "property_name", "property_unit").where(F.trim("property_unit") != "").join(F.broadcast(terms), "property_name").withColumn("u", units.unit_key(F.col("property_unit")))
    return t.join(known, ["u", "common_unit"], "left").groupBy("property_name").agg(F.count("*").alias("triples"), F.count("fits").alias("fitting"))


@registry.query("hypothesis_trial_join", typed(_TRIAL + " SELECT t AS hypothesis_type, count(*) AS hypotheses, count_if(passed) AS passed, round(avg(score), 6) AS mean_score FROM tp GROUP BY t", "BIGINT", "passed"))
def hypothesis_trial_join(spark: SparkSession, folder: str) -> DataFrame:
    """Hypotheses met with their trials by id: how many of each type pass, and their mean score."""
    verdicts = trials(spark, folder).select("hypothesis_id", "passed", "score")
    h = table(spark, folder, "hypotheses", "hypothesis_id", "hypothesis_type", "created_at")
    h = first_per_key(h, "hypothesis_id", "created_at").select("hypothesis_id", F.coalesce("hypothesis_type", F.lit("other")).alias("hypothesis_type"))
    return h.join(verdicts, "hypothesis_id").groupBy("hypothesis_type").agg(F.count("*").alias("hypotheses"), F.count_if("passed").alias("passed"), F.round(F.avg("score"), 6).alias("mean_score"))


@registry.query("last_pairs_ratio", typed("""WITH pp AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY paired_at) rn FROM paper_pairs) WHERE rn = 1), l AS (SELECT * FROM pp ORDER BY paired_at DESC, pair_id LIMIT 100)
    SELECT count(*) AS pairs, count_if(cross_domain) AS cross_domain, count_if(NOT cross_domain) AS same_domain, count_if(similarity < 0.5 AND pair_type <> 'direct_similarity') AS implicit FROM l""", "BIGINT", "cross_domain", "same_domain", "implicit"))
def last_pairs_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Across and within domains among the last hundred pairs."""
    last = paper_pairs(spark, folder, "cross_domain", "similarity", "pair_type").orderBy(F.desc("paired_at"), "pair_id").limit(100)
    return last.agg(F.count("*").alias("pairs"), F.count_if("cross_domain").alias("cross_domain"), F.count_if(~F.col("cross_domain")).alias("same_domain"), F.count_if((F.col("similarity") < 0.5) & (F.col("pair_type") != "direct_similarity")).alias("implicit"))


@registry.query("title_containment", r"""WITH p AS (SELECT paper_id, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS k FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at) rn FROM papers) WHERE rn = 1), w AS (SELECT paper_id, k FROM p WHERE length(k) > 20)
    SELECT a.paper_id AS short_id, b.paper_id AS long_id FROM w a JOIN w b ON a.k <> b.k AND contains(b.k, a.k)""")
def title_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of over twenty characters that stand anywhere within another title."""
    k = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+", " "))
    return titles.contained(papers(spark, folder, "title").select("paper_id", k.alias("k")).where(F.length("k") > 20), "paper_id", "k", 20)
