"""Queries over hypotheses: evaluators, trials, verification, knowledge, directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.lexicons import sql_list
from quillon.operators import ensemble as en
from quillon.operators import statements as st
from quillon.plans.registry import Registry, typed
from quillon.plans.text_queries import PAPERS, papers
from quillon.sources.tables import first_per_key, table

registry = Registry()

# Rows delivered again count once; cross_domain comes from the first categories of the two papers.
_HYPO = f"""{PAPERS}, h1 AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY created_at) rn FROM hypotheses WHERE hypothesis_id IS NOT NULL) WHERE rn = 1),
    h AS (SELECT h1.*, coalesce(a.categories[1], 'unknown') <> coalesce(b.categories[1], 'unknown') AS cross_domain, true AS materials, coalesce(regexp_matches(statement, '[0-9]+([.][0-9]+)? *(K|GPa|MPa|eV|%|nm)'), false) AS num
        FROM h1 LEFT JOIN papers1 a ON a.paper_id = paper_a_id LEFT JOIN papers1 b ON b.paper_id = paper_b_id)"""


def stated(spark: SparkSession, folder: str) -> DataFrame:
    """Hypotheses once each, as they came."""
    return first_per_key(table(spark, folder, "hypotheses"), "hypothesis_id", "created_at")


def hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    h = stated(spark, folder)
    p = papers(spark, folder, "categories").select("paper_id", F.coalesce(F.get("categories", F.lit(0)), F.lit("unknown")).alias("c"))
    a, b = p.select(F.col("paper_id").alias("paper_a_id"), F.col("c").alias("ca")), p.select(F.col("paper_id").alias("paper_b_id"), F.col("c").alias("cb"))
    u = F.lit("unknown")
    numeric = F.coalesce(F.col("statement").rlike(r"[0-9]+([.][0-9]+)? *(K|GPa|MPa|eV|%|nm)"), F.lit(False))
    return h.join(a, "paper_a_id", "left").join(b, "paper_b_id", "left").withColumns({"cross_domain": F.coalesce("ca", u) != F.coalesce("cb", u), "materials": F.lit(True), "numeric": numeric}).drop("ca", "cb")


def _case(column: str, which: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{t}' THEN {v[which]}" for t, v in en.TYPES.items()) + f" ELSE {en.OTHER[which]} END"


def _any(text: str, words) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains({text}, w))) > 0"


_CUE = " OR ".join(f"(t = '{k}' AND {_any('lower(s)', w)})" for k, w in en.TYPE_CUES.items())
_EVAL = f"""WITH {_HYPO}, b AS (SELECT hypothesis_id, novelty, confidence, created_at, list_filter(coalesce(keywords, []), lambda k: k IS NOT NULL) AS k, coalesce(statement, '') AS s, coalesce(hypothesis_type, 'other') AS t, cross_domain AS x, num FROM h),
    c AS (SELECT *, {_any("s", en.PLACEHOLDERS)} AS ph, len(k) AS n, length(s) AS ln, k[1:len(k) // 2] AS ka, k[len(k) // 2 + 1:] AS kb FROM b),
    d AS (SELECT *, CASE WHEN NOT x THEN 0.6 WHEN n < 4 THEN 0.35 ELSE least(0.8, greatest(0.2, 0.3 + 0.35 * least(1.0, len(list_distinct(k)) / 8.0) + 0.1 * len(list_filter(list_distinct(ka), lambda w: list_contains(kb, w))))) END AS e1,
        CASE WHEN n = 0 THEN 0.2 WHEN ph THEN 0.15 ELSE least(0.8, greatest(0.1, 0.25 + {_case("t", 0)} + CASE WHEN n >= 4 THEN 0.05 WHEN n < 2 THEN -0.1 ELSE 0 END + CASE WHEN num THEN 0.1 ELSE 0 END)) END AS e2,
        least(1.0, greatest(0.1, 1 - 0.8 * least(1.0, greatest(0.0, (1 - least(1.0, n / 16.0 + ln / 400.0) + CASE WHEN ph THEN 0.2 ELSE 0 END + CASE WHEN n < 3 THEN 0.15 ELSE 0 END - CASE WHEN num THEN 0.15 ELSE 0 END + {_case("t", 1)}) / 2)))) AS e3,
        CASE WHEN ph THEN 0.2 ELSE least(0.85, {_case("t", 2)} + CASE WHEN num THEN 0.1 ELSE 0 END + CASE WHEN n >= 4 THEN 0.05 ELSE 0 END) END AS e4,
        least(1.0, 0.3 + 0.3 * CASE WHEN n > 0 THEN len(list_filter(k, lambda w: contains(lower(s), lower(w)))) / n::DOUBLE ELSE 0 END + CASE WHEN {_any("lower(s)", en.METHOD_CUES)} THEN 0.15 ELSE 0 END + CASE WHEN {_any("lower(s)", en.MATERIAL_CUES)} THEN 0.15 ELSE 0 END
            + CASE WHEN ln > 30 THEN 0.1 ELSE 0 END + CASE WHEN {_CUE} THEN 0.1 ELSE 0 END + CASE WHEN num THEN 0.1 ELSE 0 END) AS e5 FROM c),
    f AS (SELECT * REPLACE (e1::DOUBLE AS e1, e2::DOUBLE AS e2, e3::DOUBLE AS e3, e4::DOUBLE AS e4, e5::DOUBLE AS e5), list_sort([e1::DOUBLE, e2, e3, e4, e5])[3] AS med, (e1::DOUBLE + e2 + e3 + e4 + e5) / 5 AS mean FROM d),
    g AS (SELECT *, least(1.0, greatest(0.1, 0.6 * med + 0.2 * mean + 0.2 * (1 - 2 * abs(med - mean)))) AS e6 FROM f)"""


def _fuse_sql(cols: list[str]) -> tuple[str, str]:
    mean = "(" + " + ".join(cols) + f") / {len(cols)}"
    var = "(" + " + ".join(f"({c} - {mean}) * ({c} - {mean})" for c in cols) + f") / {len(cols)}"
    return f"round({mean}, 4)", f"round(greatest(0, 1 - 3 * sqrt({var})), 4)"


def _safe_sql(cols: list[str], mean: str, cons: str) -> str:
    return f"(least({', '.join(cols)}) >= 0.2 AND {cons} >= CASE WHEN num THEN 0.45 ELSE 0.6 END AND {mean} >= 0.3)"


_ALL = [f"e{i}" for i in range(1, 7)]
_MEAN, _CONS = _fuse_sql(_ALL)
_SUB = [_safe_sql(c, *_fuse_sql(c)) for c in ([f"e{en.OPERATORS.index(o) + 1}" for o in s] for s in en.SUBSETS)]
_MOVE = "trim(regexp_extract(low, 'from (.+?) to (.+?)(?:[,.;]|$)', {0}))"
_TWICE = "len(list_filter(regexp_extract_all(low, '\\b(\\w{{2,20}}) {0} ', 1), lambda x: regexp_matches(low, '\\b' || x || ' {0} ' || x || '\\b'))) > 0"
_BOUNDS = "[" + ", ".join(f"{{'n': '{n.replace(' ', '  ')}', 'a': {lo!r}::DOUBLE, 'b': {hi!r}::DOUBLE}}" for n, (lo, hi) in st.stated_bounds().items()) + "]"
_GATES = f""", ga AS (SELECT *, lower(s) AS low, replace(lower(s), ' ', '  ') AS low2, t IN ('analogy', 'combination') AS pairwise, list_transform(k, lambda w: lower(w)) AS kl FROM g),
    gm AS MATERIALIZED (SELECT hypothesis_id, low2, b FROM ga, (SELECT unnest({_BOUNDS}) AS b) WHERE contains(low2, b.n)),
    gn AS MATERIALIZED (SELECT DISTINCT hypothesis_id FROM gm WHERE len(list_filter(flatten(list_transform(regexp_extract_all(low2, '(?s).{{0,50}}\\b' || b.n || '\\b.{{0,150}}'), lambda w: regexp_extract_all(w, '{st.NUMBER}', 1))), lambda v: v::DOUBLE < b.a OR v::DOUBLE > b.b)) > 0),
    gb AS MATERIALIZED (SELECT *, (pairwise AND {_MOVE.format(1)} <> '' AND {_MOVE.format(1)} = {_MOVE.format(2)}) OR (pairwise AND {_TWICE.format("in")}) OR {_TWICE.format("and")} AS itself, hypothesis_id IN (SELECT hypothesis_id FROM gn) AS off FROM ga),
    gc AS (SELECT *, itself OR (pairwise AND len(kl) >= 2 AND len(list_distinct(kl)) < 0.5 * len(kl)) OR regexp_matches(low, '{st.FRAGMENT}') OR regexp_matches(low, '\\(unknown\\)|unknown structure') OR regexp_matches(low, '\\bgeneral\\b.*≈|general property') OR (t = 'analogy' AND contains(low, 'transfer') AND NOT x) OR length(trim(s)) < 20 AS bad FROM gb)"""
_TRIAL = _EVAL + _GATES + f""", tr AS (SELECT *, {_MEAN} AS raw_score, {_CONS} AS raw_consistency FROM gc), ts AS (SELECT *, {_safe_sql(_ALL, "raw_score", "raw_consistency")} AND NOT bad AS is_safe, CASE WHEN bad THEN 0.0 ELSE raw_consistency END AS consistency, CASE WHEN bad THEN 0.0 WHEN off THEN round(raw_score * 0.5, 6) WHEN num THEN least(1.0, round(raw_score * 1.15, 4)) ELSE raw_score END AS score FROM tr),
    tp AS (SELECT *, is_safe AND NOT off AND score >= 0.5 AS passed FROM ts)"""
_VERIFY = _TRIAL + f""", v0 AS (SELECT *, ({" + ".join(f"CASE WHEN is_safe AND score >= {t} THEN 1 ELSE 0 END" for t in en.THRESHOLDS)}) / 5.0 AS reproduce_rate, ({" + ".join(f"CASE WHEN {s} THEN 1 ELSE 0 END" for s in _SUB)}) / 3.0 AS cross_share FROM tp),
    v1 AS (SELECT *, CASE WHEN off OR itself THEN 0.0 ELSE round(greatest(0, least(0.5 * reproduce_rate + 0.5 * cross_share - CASE WHEN score > 0 THEN 0.1 ELSE 0 END, CASE WHEN num AND NOT list_contains(kl, 'unknown') AND NOT list_contains(kl, 'general') THEN 9 ELSE 0.79 END)), 6) END AS stability FROM v0),
    v2 AS (SELECT *, stability >= 0.55 AND reproduce_rate >= 0.6 AND cross_share > 0.999 AS discovery FROM v1), v AS (SELECT *, CASE WHEN NOT discovery THEN 'none' WHEN stability >= 0.8 THEN 'gold' WHEN stability >= 0.6 THEN 'silver' ELSE 'bronze' END AS level FROM v2)"""


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """All hypotheses tried, with the gates of content and numbers before."""
    h = st.content_violations(hypotheses(spark, folder))
    return en.trial(en.evaluate(h.withColumn("number_violations", st.number_violations(F.col("statement")))))


@registry.query("ensemble_scores", _EVAL + " SELECT hypothesis_id, " + ", ".join(f"round({e}, 6) AS {e}" for e in _ALL) + " FROM g")
def ensemble_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The six evaluators on every hypothesis."""
    return en.evaluate(hypotheses(spark, folder)).select("hypothesis_id", *[F.round(e, 6).alias(e) for e in _ALL])


@registry.query("trial_results", _TRIAL + " SELECT hypothesis_id, score, consistency, is_safe, passed FROM tp")
def trial_results(spark: SparkSession, folder: str) -> DataFrame:
    return trials(spark, folder).select("hypothesis_id", "score", "consistency", "is_safe", "passed")


@registry.query("failure_diagnosis", _TRIAL + " SELECT w AS weakest, count(*) AS failures, round(avg(consistency), 6) AS mean_consistency FROM (SELECT *, (list_sort([" + ", ".join(f"{{'s': round({e}, 6), 'o': '{o}'}}" for e, o in zip(_ALL, en.OPERATORS)) + "]))[1].o AS w FROM tp WHERE NOT passed) GROUP BY w")
def failure_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """Failed trials by their weakest evaluator."""
    t = trials(spark, folder).where("not passed")
    return t.groupBy("weakest").agg(F.count("*").alias("failures"), F.round(F.avg("consistency"), 6).alias("mean_consistency"))


@registry.query("verification_reports", _VERIFY + " SELECT hypothesis_id, round(reproduce_rate, 6) AS reproduce_rate, round(cross_share, 6) AS cross_share, stability, discovery, level FROM v")
def verification_reports(spark: SparkSession, folder: str) -> DataFrame:
    v = en.verify(trials(spark, folder))
    return v.select("hypothesis_id", F.round("reproduce_rate", 6).alias("reproduce_rate"), F.round("cross_share", 6).alias("cross_share"), "stability", "discovery", "level")


@registry.query("discovery_stats", typed(_VERIFY + " SELECT count(*) AS verified, count_if(discovery) AS discoveries, count_if(level = 'gold') AS gold, count_if(level = 'silver') AS silver, count_if(level = 'bronze') AS bronze, round(avg(stability), 6) AS mean_stability, round(avg(reproduce_rate), 6) AS mean_reproduce, round(count_if(discovery) / count(*), 6) AS rate FROM v WHERE passed", "BIGINT", "discoveries", "gold", "silver", "bronze"))
def discovery_stats(spark: SparkSession, folder: str) -> DataFrame:
    v = en.verify(trials(spark, folder)).where("passed")
    level = lambda x: F.count_if(F.col("level") == x).alias(x)
    return v.agg(F.count("*").alias("verified"), F.count_if("discovery").alias("discoveries"), level("gold"), level("silver"), level("bronze"), F.round(F.avg("stability"), 6).alias("mean_stability"), F.round(F.avg("reproduce_rate"), 6).alias("mean_reproduce"), F.round(F.count_if("discovery") / F.count("*"), 6).alias("rate"))


@registry.query("discoveries_ranked", _VERIFY + " SELECT hypothesis_id, stability, level, substring(s, 1, 120) AS statement FROM v WHERE discovery ORDER BY stability DESC, hypothesis_id LIMIT 50")
def discoveries_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 most stable discoveries."""
    v = en.verify(trials(spark, folder)).where("discovery")
    return v.select("hypothesis_id", "stability", "level", F.substring(F.coalesce("statement", F.lit("")), 1, 120).alias("statement")).orderBy(F.desc("stability"), "hypothesis_id").limit(50)


@registry.query("operator_calibration", _TRIAL + ", long AS (" + " UNION ALL ".join(f"SELECT '{o}' AS operator, {e} AS predicted, passed FROM tp" for e, o in zip(_ALL, en.OPERATORS)) + """) SELECT operator, count(*) AS n, round(avg(CASE WHEN (predicted >= 0.5) = passed THEN 1.0 ELSE 0 END), 6) AS accuracy,
    round(greatest(0.3, avg(CASE WHEN (predicted >= 0.5) = passed THEN 1.0 ELSE 0 END)), 6) AS weight, round(sqrt(avg(power(predicted - CASE WHEN passed THEN 1.0 ELSE 0 END, 2))), 6) AS rmse FROM long GROUP BY operator""")
def operator_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """How often each evaluator alone agrees with the trial, and the weight that follows."""
    t = trials(spark, folder)
    long = t.select("passed", F.explode(F.array(*[F.struct(F.lit(o).alias("operator"), F.col(e).alias("predicted")) for e, o in zip(_ALL, en.OPERATORS)])).alias("x")).select("passed", "x.*")
    return en.calibrate(long)


@registry.query("pre_trial_evaluator", f"""WITH {_HYPO}, b AS (SELECT hypothesis_id, coalesce(statement, '') AS s, coalesce(keywords, []) AS k, hypothesis_type AS t, cross_domain, coalesce(novelty, 0.5) AS novelty, coalesce(confidence, 0.5) AS confidence FROM h),
    c AS (SELECT *, length(s) AS n, least(1.0, 0.35 + CASE WHEN regexp_matches(lower(s), 'measur|above|below|increase|drop|gives|saturate') THEN 0.15 ELSE 0 END + CASE WHEN len(k) > 0 THEN 0.12 ELSE 0 END + CASE WHEN coalesce(t, '') <> 'contradiction' THEN 0.08 ELSE 0 END + CASE WHEN length(s) > 20 AND length(s) < 300 THEN 0.05 ELSE 0 END) AS testability,
        least(1.0, 0.3 + CASE WHEN len(k) > 0 THEN 0.2 ELSE 0 END + CASE WHEN cross_domain THEN 0.15 ELSE 0 END) AS relevance FROM b),
    d AS (SELECT *, least(1.0, greatest(0.1, 0.35 + CASE WHEN n > 30 AND n < 200 THEN 0.15 WHEN n >= 200 THEN 0.08 ELSE -0.1 END + CASE WHEN t IS NOT NULL THEN 0.08 ELSE 0 END)) AS clarity FROM c)
    SELECT hypothesis_id, round(0.25 * testability + 0.25 * novelty + 0.2 * relevance + 0.15 * clarity + 0.15 * confidence, 6) AS score, 0.25 * testability + 0.25 * novelty + 0.2 * relevance + 0.15 * clarity + 0.15 * confidence >= 0.4 AS keep FROM d""")
def pre_trial_evaluator(spark: SparkSession, folder: str) -> DataFrame:
    """A weighted score before the trial, and whether a quick filter keeps the hypothesis."""
    h = hypotheses(spark, folder)
    s, k = F.coalesce("statement", F.lit("")), F.size(F.coalesce("keywords", F.array().cast("array<string>")))
    n = F.length(s)
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    testability = F.least(F.lit(1.0), 0.35 + plus(F.lower(s).rlike("measur|above|below|increase|drop|gives|saturate"), 0.15) + plus(k > 0, 0.12) + plus(F.coalesce("hypothesis_type", F.lit("")) != "contradiction", 0.08) + plus((n > 20) & (n < 300), 0.05))
    relevance = F.least(F.lit(1.0), 0.3 + plus(k > 0, 0.2) + plus(F.col("cross_domain"), 0.15))
    clarity = en.clamp(0.35 + F.when((n > 30) & (n < 200), 0.15).when(n >= 200, 0.08).otherwise(-0.1) + plus(F.col("hypothesis_type").isNotNull(), 0.08), 0.1, 1.0)
    score = 0.25 * testability + 0.25 * F.coalesce("novelty", F.lit(0.5)) + 0.2 * relevance + 0.15 * clarity + 0.15 * F.coalesce("confidence", F.lit(0.5))
    return h.select("hypothesis_id", F.round(score, 6).alias("score"), (score >= 0.4).alias("keep"))


@registry.query("novelty_confidence", typed(f"""WITH {PAPERS}, pp AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY paired_at) rn FROM paper_pairs) WHERE rn = 1),
    t AS (SELECT pair_id, cross_domain, similarity AS sim, CASE pair_type WHEN 'cross_domain_bridge' THEN 'analogy' WHEN 'method_transfer' THEN 'analogy' WHEN 'concept_complement' THEN 'combination' WHEN 'contradiction' THEN 'contradiction' ELSE 'gap' END AS kind FROM pp WHERE similarity IS NOT NULL)
    SELECT pair_id, kind, round(least(1.0, 0.5 + CASE WHEN cross_domain THEN 0.2 ELSE 0 END + CASE WHEN sim < 0.3 THEN 0.15 ELSE 0 END + CASE kind WHEN 'contradiction' THEN 0.1 WHEN 'combination' THEN 0.05 ELSE 0 END), 6) AS novelty,
    round(least(0.9, greatest(0.1, 0.3 + 0.5 * sim + CASE WHEN kind = 'gap' THEN 0.1 ELSE 0 END - CASE WHEN cross_domain THEN 0.05 ELSE 0 END)), 6) AS confidence, 'hypo_' || substring(md5(pair_id), 1, 8) AS hypothesis_id FROM t""", "DOUBLE", "novelty"))
def novelty_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Kind, novelty, confidence and id of the hypothesis that each pair leads to."""
    pp = first_per_key(table(spark, folder, "paper_pairs", "pair_id", "similarity", "cross_domain", "pair_type", "paired_at"), "pair_id", "paired_at").where("similarity is not null")
    kind = F.when(F.col("pair_type").isin("cross_domain_bridge", "method_transfer"), "analogy").when(F.col("pair_type") == "concept_complement", "combination").when(F.col("pair_type") == "contradiction", "contradiction").otherwise("gap")
    t = pp.withColumn("kind", kind)
    x = F.coalesce("cross_domain", F.lit(False))
    novelty = F.least(F.lit(1.0), 0.5 + F.when(x, 0.2).otherwise(0.0) + F.when(F.col("similarity") < 0.3, 0.15).otherwise(0.0) + F.when(F.col("kind") == "contradiction", 0.1).when(F.col("kind") == "combination", 0.05).otherwise(0.0))
    confidence = en.clamp(0.3 + 0.5 * F.col("similarity") + F.when(F.col("kind") == "gap", 0.1).otherwise(0.0) - F.when(x, 0.05).otherwise(0.0), 0.1, 0.9)
    return t.select("pair_id", "kind", F.round(novelty, 6).alias("novelty"), F.round(confidence, 6).alias("confidence"), F.concat(F.lit("hypo_"), F.substring(F.md5(F.col("pair_id").cast("binary")), 1, 8)).alias("hypothesis_id"))


@registry.query("knowledge_summary", _TRIAL + " SELECT CASE WHEN passed THEN 'validated' ELSE 'failed' END AS entry_type, count(*) AS entries, round(avg(score), 6) AS mean_score, round(avg(novelty), 6) AS mean_novelty, round(avg(consistency), 6) AS mean_consistency FROM tp GROUP BY passed")
def knowledge_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = trials(spark, folder)
    return t.groupBy(F.when(F.col("passed"), "validated").otherwise("failed").alias("entry_type")).agg(F.count("*").alias("entries"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("score", "novelty", "consistency")])


@registry.query("top_validated", _TRIAL + " SELECT hypothesis_id, round(0.6 * score + 0.4 * coalesce(novelty, 0), 6) AS rank_score FROM tp WHERE passed ORDER BY rank_score DESC, hypothesis_id LIMIT 20")
def top_validated(spark: SparkSession, folder: str) -> DataFrame:
    t = trials(spark, folder).where("passed")
    return t.select("hypothesis_id", F.round(0.6 * F.col("score") + 0.4 * F.coalesce("novelty", F.lit(0.0)), 6).alias("rank_score")).orderBy(F.desc("rank_score"), "hypothesis_id").limit(20)


@registry.query("failure_patterns", typed(_TRIAL + " SELECT t AS hypothesis_type, count(*) AS trials, count_if(NOT passed) AS failures, round(count_if(NOT passed) / count(*), 6) AS failure_rate, count_if(score < 0.3) AS low_scores FROM tp GROUP BY t", "BIGINT", "failures", "low_scores"))
def failure_patterns(spark: SparkSession, folder: str) -> DataFrame:
    t = trials(spark, folder).withColumn("hypothesis_type", F.coalesce("hypothesis_type", F.lit("other")))
    return t.groupBy("hypothesis_type").agg(F.count("*").alias("trials"), F.count_if(~F.col("passed")).alias("failures"), F.round(F.count_if(~F.col("passed")) / F.count("*"), 6).alias("failure_rate"), F.count_if(F.col("score") < 0.3).alias("low_scores"))


@registry.query("knowledge_keywords", _TRIAL + ", kw AS (SELECT hypothesis_id, passed, score, trim(lower(unnest(k))) AS word FROM tp) SELECT word, count(DISTINCT hypothesis_id) AS entries, count(DISTINCT CASE WHEN passed THEN hypothesis_id END) AS validated FROM kw WHERE word <> '' GROUP BY word ORDER BY entries DESC, word LIMIT 10")
def knowledge_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The ten key words with most entries, and how many of these are validated."""
    kw = trials(spark, folder).select("hypothesis_id", "passed", F.explode(F.transform("keywords", lambda w: F.trim(F.lower(w)))).alias("word")).where("word <> ''").distinct()
    return kw.groupBy("word").agg(F.count("*").alias("entries"), F.count_if("passed").alias("validated")).orderBy(F.desc("entries"), "word").limit(10)


@registry.query("failure_learnings", _TRIAL + ", lo AS (SELECT hypothesis_id, trim(lower(unnest(k))) AS word FROM tp WHERE score < 0.3) SELECT word, count(DISTINCT hypothesis_id) AS low_scores FROM lo WHERE word <> '' GROUP BY word ORDER BY low_scores DESC, word LIMIT 5")
def failure_learnings(spark: SparkSession, folder: str) -> DataFrame:
    """The five key words that most low-scored hypotheses have."""
    kw = trials(spark, folder).where("score < 0.3").select("hypothesis_id", F.explode(F.transform("keywords", lambda w: F.trim(F.lower(w)))).alias("word")).where("word <> ''").distinct()
    return kw.groupBy("word").agg(F.count("*").alias("low_scores")).orderBy(F.desc("low_scores"), "word").limit(5)


@registry.query("failures_by_pair_type", typed(_TRIAL + """, pt AS (SELECT least(paper_a_id, paper_b_id) AS a, greatest(paper_a_id, paper_b_id) AS b, min(pair_type) AS pair_type FROM paper_pairs WHERE paper_a_id IS NOT NULL AND paper_b_id IS NOT NULL GROUP BY ALL), ids AS (SELECT hypothesis_id, paper_a_id, paper_b_id FROM h)
    SELECT coalesce(pair_type, '(none)') AS pair_type, count(*) AS trials, count_if(NOT passed) AS failures, round(avg(score), 6) AS mean_score FROM tp JOIN ids USING (hypothesis_id) LEFT JOIN pt ON a = least(paper_a_id, paper_b_id) AND b = greatest(paper_a_id, paper_b_id) AND paper_a_id IS NOT NULL AND paper_b_id IS NOT NULL GROUP BY 1""", "BIGINT", "failures"))
def failures_by_pair_type(spark: SparkSession, folder: str) -> DataFrame:
    """Trials by the type of the pair that the two papers of a hypothesis were delivered as, either way round."""
    ends = lambda: (F.least("paper_a_id", "paper_b_id").alias("a"), F.greatest("paper_a_id", "paper_b_id").alias("b"))
    both = F.col("paper_a_id").isNotNull() & F.col("paper_b_id").isNotNull()
    pt = table(spark, folder, "paper_pairs", "paper_a_id", "paper_b_id", "pair_type").where(both).select(*ends(), "pair_type").groupBy("a", "b").agg(F.min("pair_type").alias("pair_type"))
    t = trials(spark, folder).select("passed", "score", F.when(both, F.least("paper_a_id", "paper_b_id")).alias("a"), F.when(both, F.greatest("paper_a_id", "paper_b_id")).alias("b"))
    j = t.join(pt, ["a", "b"], "left").withColumn("pair_type", F.coalesce("pair_type", F.lit("(none)")))
    return j.groupBy("pair_type").agg(F.count("*").alias("trials"), F.count_if(~F.col("passed")).alias("failures"), F.round(F.avg("score"), 6).alias("mean_score"))


@registry.query("keyword_index_search", f"WITH {_HYPO}, ix AS (SELECT DISTINCT hypothesis_id, lower(unnest(keywords)) AS k FROM h) SELECT hypothesis_id, count(*) AS hits FROM ix WHERE contains(k, 'conductivity') OR contains('conductivity', k) GROUP BY hypothesis_id")
def keyword_index_search(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the inverted key-word index that hold a word, or that a word holds."""
    ix = hypotheses(spark, folder).select("hypothesis_id", F.explode(F.transform("keywords", lambda w: F.lower(w))).alias("k")).distinct()
    word = F.lit("conductivity")
    return ix.where(F.contains("k", word) | F.contains(word, F.col("k"))).groupBy("hypothesis_id").agg(F.count("*").alias("hits"))


@registry.query("gap_failure_clusters", _TRIAL + ", x AS (SELECT hypothesis_id, lower(unnest(k[1:3])) AS kw FROM tp WHERE NOT passed) SELECT kw, count(DISTINCT hypothesis_id) AS failures FROM x GROUP BY kw HAVING count(DISTINCT hypothesis_id) >= 3")
def gap_failure_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Key words (first three of each) on which three hypotheses or more failed."""
    t = trials(spark, folder).where("not passed")
    x = t.select("hypothesis_id", F.explode(F.slice(F.filter("keywords", lambda k: k.isNotNull()), 1, 3)).alias("k")).select("hypothesis_id", F.lower("k").alias("kw")).distinct()
    return x.groupBy("kw").agg(F.count("*").alias("failures")).where("failures >= 3")


@registry.query("recent_per_type", _TRIAL + " SELECT hypothesis_id, t AS hypothesis_type, rn FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY created_at DESC, hypothesis_id) AS rn FROM tp WHERE NOT passed) WHERE rn <= 5")
def recent_per_type(spark: SparkSession, folder: str) -> DataFrame:
    """The last five failures of each type."""
    t = trials(spark, folder).where("not passed").withColumn("hypothesis_type", F.coalesce("hypothesis_type", F.lit("other")))
    w = Window.partitionBy("hypothesis_type").orderBy(F.desc("created_at"), "hypothesis_id")
    return t.withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 5").select("hypothesis_id", "hypothesis_type", "rn")
