"""Queries over texts: tokens, key words, titles, TF-IDF, quality gate, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions.lexicons import EVIDENCE_TERMS, GENERIC_WORDS, MECHANISM_TERMS, METADATA_TERMS, METHOD_WORDS, METRIC_UNITS, PROBLEM_WORDS, STOP_WORDS, WEAK_BRIDGE_TERMS, sql_list
from quillon.operators import inverted, pairing, quality, tfidf
from quillon.plans.registry import Registry, typed
from quillon.session import cut
from quillon.sources.tables import first_per_key, table

registry = Registry()

# Papers once each, for all SQL here.
PAPERS = "papers1 AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at) rn FROM papers) WHERE rn = 1)"
STOP = sql_list(STOP_WORDS)
WORDS = f"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z]{{{{2,}}}}'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))"


def words_sql(text: str) -> str:
    return WORDS.format(text)


def bigrams_sql(w: str) -> str:
    return f"list_concat({w}, CASE WHEN len({w}) > 1 THEN list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) ELSE [] END)"


def papers(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    cols = dict.fromkeys(["paper_id", *columns, "ingested_at"])
    return first_per_key(table(spark, folder, "papers", *cols), "paper_id", "ingested_at")


PAPER_TEXT = "coalesce(title, '') || '. ' || coalesce(abstract, '')"


def paper_text() -> F.Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))


@registry.query(
    "text_tokenize_counts",
    f"""SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, CASE WHEN len(w) > 1 THEN len(w) - 1 ELSE 0 END AS n_bigrams
    FROM (SELECT doc_id, {words_sql("text")} AS w FROM documents)""",
)
def text_tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "documents", "doc_id", "text").select("doc_id", tx.unigrams(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.greatest(F.size("w") - 1, F.lit(0)).cast("bigint").alias("n_bigrams"))


@registry.query(
    "doc_freq_topk",
    f"""WITH t AS (SELECT DISTINCT doc_id, unnest({bigrams_sql("w")}) AS token FROM (SELECT doc_id, {words_sql("text")} AS w FROM documents)),
    n AS (SELECT count(*) AS n FROM documents)
    SELECT token, df, round(ln((1.0 + n) / (1 + df)) + 1, 6) AS idf FROM (SELECT token, count(*) AS df FROM t GROUP BY token), n
    WHERE df >= greatest(1, n // 100) AND df <= CASE WHEN n < 20 THEN n ELSE 0.98 * n END ORDER BY df DESC, token LIMIT 200""",
)
def doc_freq_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary of documents: frequency within its limits and smoothed idf."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return tfidf.vocabulary(tfidf.term_counts(docs, "doc_id", "text"), docs.count(), max_features=200).select("token", "df", F.round("idf", 6).alias("idf"))


_VECS = f"""WITH {PAPERS}, n AS (SELECT count(*) AS n FROM papers1),
    t AS (SELECT paper_id, unnest({bigrams_sql("w")}) AS token FROM (SELECT paper_id, {words_sql(PAPER_TEXT)} AS w FROM papers1)),
    tf AS (SELECT paper_id, token, count(*) AS tf FROM t GROUP BY ALL),
    v AS (SELECT token, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), n
          WHERE df >= greatest(1, n // 100) AND df <= CASE WHEN n < 20 THEN n ELSE 0.98 * n END ORDER BY df DESC, token LIMIT 2000),
    raw AS (SELECT paper_id, token, tf * idf AS w FROM tf JOIN v USING (token)),
    vec AS (SELECT paper_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY paper_id)) AS w FROM raw)"""


def _terms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Counts of the papers' tokens, and the vocabulary within the usual limits."""
    p = papers(spark, folder, "title", "abstract").withColumn("t", paper_text())
    counts = cut(tfidf.term_counts(p, "paper_id", "t"))
    return counts, cut(tfidf.vocabulary(counts, p.count()))


@registry.query("tfidf_topk_per_paper", _VECS + " SELECT paper_id, token, round(w, 6) AS w, rn FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(w, 9) DESC, token) AS rn FROM vec) WHERE rn <= 5")
def tfidf_topk_per_paper(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("paper_id").orderBy(F.desc(F.round("w", 9)), "token")
    return tfidf.vectors(*_terms(spark, folder), "paper_id").withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 5").select("paper_id", "token", F.round("w", 6).alias("w"), "rn")


@registry.query(
    "pair_cosine_topk",
    _VECS + """ SELECT a.paper_id AS paper_id_a, b.paper_id AS paper_id_b, round(sum(a.w * b.w), 6) AS similarity FROM vec a JOIN vec b ON a.token = b.token AND a.paper_id < b.paper_id
    GROUP BY ALL HAVING sum(a.w * b.w) >= 0.3 ORDER BY similarity DESC, paper_id_a, paper_id_b LIMIT 200""",
)
def pair_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: the most similar pairs of papers by TF-IDF cosine."""
    return tfidf.top_pairs(*_terms(spark, folder), "paper_id", 0.3, 200)


_KW = "list_filter(list_transform(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda x: regexp_replace(x, '^[.,;:!?()\\[\\]{{}}\"'']+|[.,;:!?()\\[\\]{{}}\"'']+$', '', 'g')), lambda w: length(w) > 3 AND NOT list_contains(" + STOP + ", w))"


def first_distinct_sql(l: str, n: int) -> str:
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)[1:{n}]"


@registry.query("keyword_extract", f"SELECT paper_id, array_to_string({first_distinct_sql('w', 10)}, ' ') AS kws FROM (SELECT paper_id, {_KW.format(PAPER_TEXT)} AS w FROM (WITH {PAPERS} SELECT * FROM papers1))")
def keyword_extract(spark: SparkSession, folder: str) -> DataFrame:
    p = papers(spark, folder, "title", "abstract").select("paper_id", paper_text().alias("t"))
    return p.select("paper_id", F.array_join(tx.keywords(F.col("t")), " ").alias("kws"))


_TITLE = "lower(coalesce(title, ''))"
for _p in tx.TITLE_OPENINGS:
    _TITLE = f"regexp_replace({_TITLE}, '^{_p} ', '')"
_TITLE = f"trim(regexp_replace(regexp_replace({_TITLE}, '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@registry.query("title_groups", f"WITH {PAPERS} SELECT title_key, count(*) AS papers, count(DISTINCT source) AS sources, min(paper_id) AS first_id FROM (SELECT *, {_TITLE} AS title_key FROM papers1) GROUP BY title_key HAVING count(*) > 1")
def title_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with one title once openings, signs and case are off."""
    p = papers(spark, folder, "title", "source").withColumn("title_key", tx.title_key(F.col("title")))
    return p.groupBy("title_key").agg(F.count("*").alias("papers"), F.count_distinct("source").alias("sources"), F.min("paper_id").alias("first_id")).where("papers > 1")


@registry.query("exact_dup_first_wins", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1")
def exact_dup_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of every text; copies are combined before the shuffle."""
    d = table(spark, folder, "documents", "doc_id", "text", "source").where("text is not null")
    return d.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min(F.struct("doc_id", "source")).alias("m")).select("m.doc_id", "m.source")


@registry.query("inverted_index_roundtrip", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ') AS decoded FROM documents WHERE text IS NOT NULL")
def inverted_index_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents decoded from their own inverted index (the form in which one source delivers abstracts)."""
    return inverted.texts_of(inverted.index_texts(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id")


_DOMAIN = "CASE coalesce(categories[1], '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.DOMAINS.items()) + " WHEN '' THEN 'the target domain' WHEN 'unknown' THEN 'the target domain' ELSE categories[1] END"


@registry.query("whitespace_and_domain", r"""WITH """ + PAPERS + r""" SELECT paper_id, trim(regexp_replace(lower(coalesce(title, '')), '\s+', ' ', 'g')) AS title_normal,
    """ + _DOMAIN + """ AS domain FROM papers1""")
def whitespace_and_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Title with one blank for any white space, and the name of the first category."""
    return papers(spark, folder, "title", "categories").select("paper_id", tx.whitespace_normal(F.col("title")).alias("title_normal"), tx.domain(F.get("categories", F.lit(0))).alias("domain"))


@registry.query("origin_tags", typed(f"""WITH {PAPERS} SELECT origin, count(*) AS papers, sum(CASE WHEN data_source = 'online' THEN 1 ELSE 0 END) AS marked_online
    FROM (SELECT *, CASE WHEN paper_id LIKE 'paper\\_%' ESCAPE '\\' THEN 'offline_fallback' ELSE 'online' END AS origin FROM papers1) GROUP BY origin""", "BIGINT", "marked_online"))
def origin_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Rows from the built-in corpus, told by their ids, against the rest."""
    p = papers(spark, folder, "data_source").withColumn("origin", F.when(F.startswith("paper_id", F.lit("paper_")), "offline_fallback").otherwise("online"))
    return p.groupBy("origin").agg(F.count("*").alias("papers"), F.sum(F.when(F.col("data_source") == "online", 1).otherwise(0)).alias("marked_online"))


# A materials vocabulary beside the default one, so that the gate can be seen at work on these papers.
MATERIALS_MECHANISMS = ("doping", "substitution", "sintering", "annealing", "grain boundar", "phonon", "vacanc", "dislocation", "interface", "hopping", "trapping", "diffusion", "precipitate", "twin", "strain")
MATERIALS_EVIDENCE = ("measured", "conductivity", "hardness", "mobility", "spectroscop", "diffraction", "microscopy", "strength", "modulus", "polarization", "capacity", "error", "reference")
RULES = quality.QualityRules(focus_terms=("thin film", "single crystal", "ceramics"), mechanism_terms=MATERIALS_MECHANISMS, evidence_terms=MATERIALS_EVIDENCE, require_focus=False)


def quality_sql(rules: quality.QualityRules, source: str) -> str:
    """The gate in SQL over a relation with title, abstract and keywords."""
    match = lambda terms: f"list_filter({sql_list(terms)}, lambda t: contains(txt, t))"
    phrase = f"list_filter({sql_list(rules.focus_terms)}, lambda t: contains(txt, t) OR (len(string_split(t, ' ')) > 1 AND list_bool_and(list_transform(string_split(t, ' '), lambda w: list_contains(string_split(txt, ' '), w)))))" if rules.focus_terms else "[]"
    focus = f"least(1.0, len(focus_terms) / {max(1, min(2, len(rules.focus_terms)))}.0)" if rules.focus_terms else "1.0"
    return f"""q0 AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || array_to_string(coalesce(keywords, []), ' ')), '\\s+', ' ', 'g')) AS txt,
        trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')) AS ttl, length(trim(coalesce(abstract, ''))) AS chars FROM {source}),
    q1 AS (SELECT *, {phrase} AS focus_terms, {match(rules.mechanism_terms)} AS mechanism_terms, {match(rules.evidence_terms)} AS evidence_terms, regexp_matches(txt, '[0-9]+(?:[.][0-9]+)?\\s*(?:{"|".join(METRIC_UNITS)})') AS has_metric FROM q0),
    q2 AS (SELECT *, round(0.35 * {focus} + 0.35 * least(1.0, len(mechanism_terms) / 2.0) + 0.25 * least(1.0, len(evidence_terms) / 2.0 + CASE WHEN has_metric THEN 0.25 ELSE 0 END) + 0.05 * CASE WHEN chars >= {rules.min_abstract_chars} THEN 1 ELSE 0 END, 3) AS score,
        chars < {rules.min_abstract_chars} AND NOT has_metric AND len(list_filter(list_distinct(regexp_extract_all(ttl, '[a-z][a-z0-9-]{{2,}}')), lambda w: NOT list_contains({sql_list(METADATA_TERMS)}, w))) < 2 AS metadata_only FROM q1),
    q AS (SELECT *, list_filter([CASE WHEN {str(bool(rules.require_focus and rules.focus_terms)).lower()} AND len(focus_terms) = 0 THEN 'no_focus_term' END, CASE WHEN len(mechanism_terms) < {rules.min_mechanism_hits} THEN 'insufficient_mechanism' END,
        CASE WHEN len(evidence_terms) < {rules.min_evidence_hits} AND NOT has_metric THEN 'insufficient_evidence' END, CASE WHEN metadata_only THEN 'metadata_only' END,
        CASE WHEN regexp_full_match(ttl, '[a-z0-9]+(?:[-_][a-z0-9]+)+') AND regexp_matches(ttl, '[0-9]') THEN 'identifier_title' END, CASE WHEN score < {rules.min_score} THEN 'score_below_threshold' END], lambda r: r IS NOT NULL) AS reasons FROM q2)"""


@registry.query("quality_score", f"WITH {PAPERS}, {quality_sql(RULES, 'papers1')} SELECT paper_id, score, len(reasons) = 0 AS accepted, array_to_string(reasons, ',') AS reasons, len(mechanism_terms) AS n_mechanism, len(evidence_terms) AS n_evidence, has_metric FROM q")
def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    """The gate with a materials vocabulary: score, verdict and reasons."""
    q = quality.assess(papers(spark, folder, "title", "abstract", "keywords"), RULES)
    return q.select("paper_id", "score", "accepted", F.array_join("reasons", ",").alias("reasons"), F.size("mechanism_terms").cast("bigint").alias("n_mechanism"), F.size("evidence_terms").cast("bigint").alias("n_evidence"), "has_metric")


@registry.query("quality_default", f"WITH {PAPERS}, {quality_sql(quality.QualityRules(), 'papers1')} SELECT array_to_string(reasons, ',') AS reasons, count(*) AS papers, round(avg(score), 6) AS mean_score FROM q GROUP BY ALL")
def quality_default(spark: SparkSession, folder: str) -> DataFrame:
    """How the gate's default rules judge these papers, by reasons."""
    q = quality.assess(papers(spark, folder, "title", "abstract", "keywords"))
    return q.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("papers"), F.round(F.avg("score"), 6).alias("mean_score"))


STRICT = quality.QualityRules(min_score=0.85, min_mechanism_hits=2)


@registry.query(
    "quality_degrade",
    f"""WITH {PAPERS}, {quality_sql(STRICT, 'papers1')}, b AS (SELECT *, date_trunc('hour', crawled_at) AS batch FROM q),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, batch ORDER BY score DESC, paper_id) AS rn, count(*) OVER (PARTITION BY source, batch) AS n, sum(CASE WHEN len(reasons) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, batch) AS ok FROM b)
    SELECT paper_id, score, ok = 0 AS degraded FROM r WHERE len(reasons) = 0 OR (ok = 0 AND rn <= greatest(1, n // 5))""",
)
def quality_degrade(spark: SparkSession, folder: str) -> DataFrame:
    """Strict rules by delivery (source and hour): where none passes, the best fifth is let through."""
    q = quality.assess(papers(spark, folder, "title", "abstract", "keywords", "source", "crawled_at"), STRICT).withColumn("batch", F.date_trunc("hour", "crawled_at"))
    return quality.gate(q, ["source", "batch"], "paper_id").select("paper_id", "score", "degraded")


_PAIRS = """pp AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY paired_at) rn FROM paper_pairs) WHERE rn = 1)"""


def paper_pairs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    cols = dict.fromkeys(["pair_id", *columns, "paired_at"])
    return first_per_key(table(spark, folder, "paper_pairs", *cols), "pair_id", "paired_at")


def _fold_sql(c: str) -> str:
    return f"list_filter(list_transform(coalesce({c}, []), lambda k: lower(k)), lambda k: k IS NOT NULL)"


def _dedupe_sql(l: str) -> str:
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


_G, _M, _P = sql_list(GENERIC_WORDS), sql_list(METHOD_WORDS), sql_list(PROBLEM_WORDS)


def _union_sql(a: str, b: str) -> str:
    return _dedupe_sql(f"list_concat({a}, {b})")


_LADDER = f"""WITH {PAPERS}, {_PAIRS},
    e0 AS (SELECT pair_id, similarity, coalesce(a.categories[1], 'unknown') AS ca, coalesce(b.categories[1], 'unknown') AS cb, {_dedupe_sql(_fold_sql("a.keywords"))} AS ka, {_dedupe_sql(_fold_sql("b.keywords"))} AS kb
        FROM pp JOIN papers1 a ON a.paper_id = paper_a_id JOIN papers1 b ON b.paper_id = paper_b_id WHERE similarity IS NOT NULL),
    e1 AS (SELECT *, ca <> cb AS cross_domain, list_filter(ka, lambda k: list_contains(kb, k) AND NOT list_contains({_G}, k)) AS br, list_filter({_M}, lambda k: list_contains(ka, k)) AS ma, list_filter({_M}, lambda k: list_contains(kb, k)) AS mb,
        list_filter({_P}, lambda k: list_contains(ka, k)) AS pa, list_filter({_P}, lambda k: list_contains(kb, k)) AS pb FROM e0 WHERE similarity >= CASE WHEN ca <> cb THEN 0.05 ELSE 0.10 END),
    e2 AS (SELECT *, CASE WHEN cross_domain THEN CASE WHEN len(br) > 0 THEN 'cross_domain_bridge' END WHEN (len(ma) > 0 AND len(pb) > 0) OR (len(mb) > 0 AND len(pa) > 0) THEN 'method_transfer'
        WHEN len(br) > 0 AND similarity < 0.5 AND len(list_filter(ka, lambda k: NOT list_contains(kb, k))) > 0 AND len(list_filter(kb, lambda k: NOT list_contains(ka, k))) > 0 THEN 'concept_complement'
        WHEN similarity >= 0.10 THEN 'direct_similarity' END AS pair_type FROM e1),
    e3 AS (SELECT *, CASE WHEN pair_type = 'method_transfer' THEN CASE WHEN len(ma) > 0 AND len(pb) > 0 THEN {_union_sql("ma", "pb")} ELSE {_union_sql("mb", "pa")} END ELSE br END AS b1,
        {_union_sql("ma", "mb")} AS ms, {_union_sql("pa", "pb")} AS ps, list_filter({_union_sql("ka[1:3]", "kb[1:3]")}, lambda k: NOT list_contains({_G}, k)) AS rest FROM e2 WHERE pair_type IS NOT NULL),
    e AS (SELECT *, (CASE WHEN len(b1) > 0 THEN b1 WHEN len(ms) > 0 THEN ms WHEN len(ps) > 0 THEN ps ELSE rest END)[1:5] AS bridge FROM e3)"""


@registry.query("pair_type_ladder", _LADDER + " SELECT pair_id, cross_domain, pair_type, array_to_string(bridge, '|') AS bridge FROM e WHERE len(bridge) > 0")
def pair_type_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of connection and bridge words of every delivered pair with a similarity."""
    p = papers(spark, folder, "categories", "keywords").select("paper_id", pairing.primary(F.col("categories")).alias("category"), pairing.folded(F.col("keywords")).alias("kw"))
    pp = paper_pairs(spark, folder, "paper_a_id", "paper_b_id", "similarity").where("similarity is not null")
    a, b = p.select(F.col("paper_id").alias("paper_a_id"), F.col("category").alias("category_a"), F.col("kw").alias("kw_a")), p.select(F.col("paper_id").alias("paper_b_id"), F.col("category").alias("category_b"), F.col("kw").alias("kw_b"))
    return pairing.evaluate(pp.join(a, "paper_a_id").join(b, "paper_b_id")).select("pair_id", "cross_domain", "pair_type", F.array_join("bridge", "|").alias("bridge"))


@registry.query("greedy_pair_matching")
def greedy_pair_matching(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best delivered pairs with at most five per paper, taken greedily (tested against brute force)."""
    pp = paper_pairs(spark, folder, "paper_a_id", "paper_b_id", "similarity").where("similarity is not null")
    return pairing.greedy(pp, "paper_a_id", "paper_b_id", "similarity")


@registry.query("pair_history_anti", f"WITH {_PAIRS} SELECT count(*) AS pairs, count(DISTINCT least(paper_a_id, paper_b_id) || '|' || greatest(paper_a_id, paper_b_id)) AS unordered_pairs FROM pp")
def pair_history_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered pairs and what is left once the same two papers count once, whichever way round."""
    pp = paper_pairs(spark, folder, "paper_a_id", "paper_b_id")
    return pp.select(F.concat_ws("|", F.least("paper_a_id", "paper_b_id"), F.greatest("paper_a_id", "paper_b_id")).alias("k")).agg(F.count("*").alias("pairs"), F.count_distinct("k").alias("unordered_pairs"))


@registry.query("technical_overlap_pairs", f"""WITH {PAPERS}, {_PAIRS}, {quality_sql(quality.QualityRules(mechanism_terms=MATERIALS_MECHANISMS), 'papers1')}
    SELECT pair_id, array_to_string(list_filter(a.mechanism_terms, lambda t: list_contains(b.mechanism_terms, t) AND NOT list_contains({sql_list(WEAK_BRIDGE_TERMS)}, t)), '|') AS shared
    FROM pp JOIN q a ON a.paper_id = paper_a_id JOIN q b ON b.paper_id = paper_b_id""")
def technical_overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Mechanism terms that both papers of a pair have."""
    q = quality.assess(papers(spark, folder, "title", "abstract", "keywords"), quality.QualityRules(mechanism_terms=MATERIALS_MECHANISMS)).select("paper_id", "mechanism_terms")
    pp = paper_pairs(spark, folder, "paper_a_id", "paper_b_id")
    a, b = q.select(F.col("paper_id").alias("paper_a_id"), F.col("mechanism_terms").alias("ma")), q.select(F.col("paper_id").alias("paper_b_id"), F.col("mechanism_terms").alias("mb"))
    return pp.join(a, "paper_a_id").join(b, "paper_b_id").select("pair_id", F.array_join(quality.technical_overlap(F.col("ma"), F.col("mb")), "|").alias("shared"))


@registry.query("keyword_cooccurrence", f"""WITH {PAPERS}, k AS (SELECT DISTINCT paper_id, trim(lower(k)) AS k FROM (SELECT paper_id, unnest(keywords) AS k FROM papers1) WHERE k IS NOT NULL AND trim(k) <> ''),
    c AS (SELECT k FROM k GROUP BY k HAVING count(*) >= 3) SELECT a.k AS kw_a, b.k AS kw_b, count(*) AS papers FROM k a JOIN k b ON a.paper_id = b.paper_id AND a.k < b.k WHERE a.k IN (SELECT k FROM c) AND b.k IN (SELECT k FROM c) GROUP BY ALL HAVING count(*) >= 3""")
def keyword_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Key words that stand together on three papers or more."""
    k = papers(spark, folder, "keywords").select("paper_id", F.explode("keywords").alias("k")).select("paper_id", F.trim(F.lower("k")).alias("k")).where("k <> ''").distinct()
    often = k.groupBy("k").agg(F.count("*").alias("n")).where("n >= 3").select("k")
    sets = k.join(often, "k", "left_semi").groupBy("paper_id").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    a = sets.select("ks", F.posexplode("ks").alias("i", "kw_a"))
    pairs = a.select("kw_a", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("kw_b"))
    return pairs.groupBy("kw_a", "kw_b").agg(F.count("*").alias("papers")).where("papers >= 3")


_ = (EVIDENCE_TERMS, MECHANISM_TERMS)
