"""Queries over composition-structure-property triples and the texts they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import chemistry as ch
from quillon.functions.lexicons import sql_list
from quillon.operators.extraction import extract
from quillon.operators import coverage, physics
from quillon.operators.quantities import common_units, name_forms, resolved
from quillon.plans.registry import Registry, typed
from quillon.plans.text_queries import PAPERS, papers
from quillon.sources.tables import first_per_key, table

registry = Registry()

TRIPLES = "t1 AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY triple_id ORDER BY loaded_at) rn FROM csp_triples WHERE triple_id IS NOT NULL) WHERE rn = 1)"


def triples(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    cols = dict.fromkeys(["triple_id", *columns, "loaded_at"])
    return first_per_key(table(spark, folder, "csp_triples", *cols), "triple_id", "loaded_at")


@registry.query("triple_prune", f"WITH {TRIPLES} SELECT triple_id, property_value IS NULL AS is_prediction FROM t1 WHERE NOT ((coalesce(structure, '') = '' AND property_value IS NULL) OR (coalesce(property_name, 'general') IN ('general', 'unknown') AND property_value IS NULL))")
def triple_prune(spark: SparkSession, folder: str) -> DataFrame:
    """Triples that say something: not those without structure and value, or without property and value."""
    t = triples(spark, folder, "structure", "property_name", "property_value")
    empty = F.col("property_value").isNull() & ((F.coalesce("structure", F.lit("")) == "") | F.coalesce("property_name", F.lit("general")).isin("general", "unknown"))
    return t.where(~empty).select("triple_id", F.col("property_value").isNull().alias("is_prediction"))


@registry.query("triple_fuzzy_read", f"WITH {TRIPLES} SELECT triple_id, composition, property_name FROM t1 WHERE contains(lower(composition), 'tio3') AND contains(lower(property_name), 'conduct') ORDER BY triple_id LIMIT 100")
def triple_fuzzy_read(spark: SparkSession, folder: str) -> DataFrame:
    """The first 100 triples whose composition and property hold given parts, whatever the case."""
    t = triples(spark, folder, "composition", "property_name")
    return t.where(F.contains(F.lower("composition"), F.lit("tio3")) & F.contains(F.lower("property_name"), F.lit("conduct"))).select("triple_id", "composition", "property_name").orderBy("triple_id").limit(100)


@registry.query("triple_property_counts", f"WITH {TRIPLES} SELECT property_name, count(*) AS triples, count(property_value) AS with_value, count(DISTINCT composition) AS compositions FROM t1 WHERE property_name IS NOT NULL GROUP BY property_name ORDER BY triples DESC, property_name LIMIT 10")
def triple_property_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent properties."""
    t = triples(spark, folder, "property_name", "property_value", "composition").where("property_name is not null")
    return t.groupBy("property_name").agg(F.count("*").alias("triples"), F.count("property_value").alias("with_value"), F.count_distinct("composition").alias("compositions")).orderBy(F.desc("triples"), "property_name").limit(10)


@registry.query("triple_structure_counts", f"WITH {TRIPLES} SELECT structure, count(*) AS triples, count(DISTINCT composition) AS compositions, count(DISTINCT property_name) AS properties FROM t1 WHERE structure IS NOT NULL AND structure <> '' GROUP BY structure ORDER BY triples DESC, structure LIMIT 10")
def triple_structure_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent structures."""
    t = triples(spark, folder, "structure", "composition", "property_name").where("structure is not null and structure <> ''")
    return t.groupBy("structure").agg(F.count("*").alias("triples"), F.count_distinct("composition").alias("compositions"), F.count_distinct("property_name").alias("properties")).orderBy(F.desc("triples"), "structure").limit(10)


@registry.query("triple_dedup_first", f"WITH {TRIPLES} SELECT composition, structure, property_name, min(triple_id) AS triple_id, count(*) AS n FROM t1 GROUP BY ALL")
def triple_dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first triple of each composition, structure and property."""
    return triples(spark, folder, "composition", "structure", "property_name").groupBy("composition", "structure", "property_name").agg(F.min("triple_id").alias("triple_id"), F.count("*").alias("n"))


_ST = "CASE " + " ".join(f"WHEN structure = '{s}' AND n < {a} THEN 'too_few_elements' WHEN structure = '{s}' AND n > {b} THEN 'too_many_elements'" for s, (a, b) in ch.STOICHIOMETRY.items()) + " END"


@registry.query("triple_stoichiometry", f"WITH {TRIPLES}, c AS (SELECT *, length(regexp_replace(composition, '[^A-Z]', '', 'g')) AS n FROM t1 WHERE composition IS NOT NULL) SELECT structure, {_ST} AS violation, count(*) AS triples FROM c WHERE structure IN ({', '.join(repr(s) for s in ch.STOICHIOMETRY)}) GROUP BY ALL")
def triple_stoichiometry(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the number of elements suits the structure."""
    t = triples(spark, folder, "composition", "structure").where(F.col("composition").isNotNull() & F.col("structure").isin(*ch.STOICHIOMETRY))
    return t.groupBy("structure", ch.stoichiometry_violation(F.col("composition"), F.col("structure")).alias("violation")).agg(F.count("*").alias("triples"))


@registry.query("known_principles", f"WITH {TRIPLES} SELECT structure, property_name, count(*) AS triples FROM t1 WHERE (structure = 'perovskite' AND property_name IN ('dielectric_constant', 'tc')) OR (structure = 'amorphous' AND property_name = 'thermal_conductivity') OR (structure = 'layered' AND property_name IN ('thermal_conductivity', 'conductivity', 'seebeck', 'zt')) OR (structure = 'hexagonal' AND property_name = 'bandgap') GROUP BY ALL")
def known_principles(spark: SparkSession, folder: str) -> DataFrame:
    """Triples that only state common knowledge."""
    t = triples(spark, folder, "structure", "property_name")
    return t.where(ch.known_principle(F.col("structure"), F.col("property_name"))).groupBy("structure", "property_name").agg(F.count("*").alias("triples"))


@registry.query("prediction_interval", f"WITH {TRIPLES} SELECT triple_id, round(least(property_value * 0.85, property_value * 1.15), 9) AS low, round(greatest(property_value * 0.85, property_value * 1.15), 9) AS high FROM t1 WHERE property_value IS NOT NULL")
def prediction_interval(spark: SparkSession, folder: str) -> DataFrame:
    t = triples(spark, folder, "property_value").where("property_value is not null")
    low, high = ch.prediction_interval(F.col("property_value"), 0.15, 9)
    return t.select("triple_id", low.alias("low"), high.alias("high"))


def property_forms(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    return name_forms(table(spark, folder, "property_terms"))


def structure_forms(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    return name_forms(table(spark, folder, "structure_terms"), "structure_name", None)


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """(triple_id, property_name, common): every readable quantity in the common unit of its property."""
    t = table(spark, folder, "csp_triples", "triple_id", "property_name", "property_value", "property_unit", "value_str", "loaded_at")
    return common_units(t, table(spark, folder, "property_terms")).select("triple_id", "property_name", "common")


@registry.query("property_range_check")
def property_range_check(spark: SparkSession, folder: str) -> DataFrame:
    """All readings, converted to the common unit, against the plausible bounds of their property (tested on a small fixture)."""
    terms = table(spark, folder, "property_terms", "property_name", "common_unit")
    j = physics.check_ranges(readings(spark, folder).join(F.broadcast(terms), "property_name"), "property_name", "common", "common_unit").where("reference_unit is not null")
    return j.groupBy("property_name").agg(F.count("*").alias("readings"), F.count_if("in_range").alias("in_range"))


PROFILE = [("mass_density", "max", 8.0), ("yield_strength", "min", 200.0), ("hardness", "min", 1.0)]


@registry.query("profile_constraints")
def profile_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """A light, strong material's limits on density, strength and hardness in common units; what is missing is a warning only (tested on a small fixture)."""
    comp = triples(spark, folder, "composition").where("composition is not null").select("triple_id", "composition")
    wanted = readings(spark, folder).where(F.col("property_name").isin([p for p, _, _ in PROFILE]))
    v = comp.join(wanted, "triple_id", "left").select("composition", "property_name", F.col("common").alias("value"))
    return physics.profile(v, "composition", PROFILE)


@registry.query("triple_coverage_gap")
def triple_coverage_gap(spark: SparkSession, folder: str) -> DataFrame:
    """For each composition the first peer of its structures that has one to three properties more, whatever the names that were entered (tested by brute force)."""
    t = triples(spark, folder, "composition", "structure", "property_name").where("composition is not null").select("composition", "structure", "property_name")
    facts = resolved(t.select("composition", "property_name").distinct(), "property_name", property_forms(spark, folder)).distinct()
    places = resolved(t.select("composition", "structure").distinct(), "structure", structure_forms(spark, folder)).distinct()
    return coverage.coverage_gaps(facts, places)


@registry.query("shared_property_pairs", f"""WITH {TRIPLES}, pp AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY paired_at) rn FROM paper_pairs) WHERE rn = 1),
    f AS (SELECT * EXCLUDE rn FROM (SELECT source_paper_id, property_name, composition, property_value, row_number() OVER (PARTITION BY source_paper_id, property_name ORDER BY triple_id) rn FROM t1 WHERE source_paper_id IS NOT NULL AND property_name IS NOT NULL) WHERE rn = 1)
    SELECT pair_id, a.property_name, a.composition <> b.composition AS compositions_differ, a.property_value IS NOT NULL AS a_has_value FROM pp JOIN f a ON a.source_paper_id = paper_a_id JOIN f b ON b.source_paper_id = paper_b_id AND a.property_name = b.property_name""")
def shared_property_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Properties that both papers of a pair report, by their first triples."""
    t = triples(spark, folder, "source_paper_id", "property_name", "composition", "property_value").where("source_paper_id is not null and property_name is not null")
    f = t.groupBy("source_paper_id", "property_name").agg(F.min_by(F.struct("composition", "property_value"), "triple_id").alias("r"))
    pp = first_per_key(table(spark, folder, "paper_pairs", "pair_id", "paper_a_id", "paper_b_id", "paired_at"), "pair_id", "paired_at")
    a, b = f.select(F.col("source_paper_id").alias("paper_a_id"), "property_name", F.col("r").alias("ra")), f.select(F.col("source_paper_id").alias("paper_b_id"), "property_name", F.col("r").alias("rb"))
    j = pp.join(a, "paper_a_id").join(b, ["paper_b_id", "property_name"])
    return j.select("pair_id", "property_name", (F.col("ra.composition") != F.col("rb.composition")).alias("compositions_differ"), F.col("ra.property_value").isNotNull().alias("a_has_value"))


_PLAIN = r"regexp_replace(regexp_replace(translate({0}, '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '\$_\{{?([0-9.]+)\}}?\$', '\1', 'g'), '<sub>([0-9.]+)</sub>', '\1', 'g')"
_EL = sql_list(ch.ELEMENTS)
_FORM = r"list_filter(regexp_extract_all({0}, '\b(?:[A-Z][a-z]?(?:\d+(?:\.\d+)?)?){{2,}}\b'), lambda w: length(w) BETWEEN 2 AND 40 AND len(regexp_extract_all(w, '([A-Z][a-z]?)(?:\d+(?:\.\d+)?)?', 1)) >= 2 AND len(list_filter(regexp_extract_all(w, '([A-Z][a-z]?)(?:\d+(?:\.\d+)?)?', 1), lambda e: NOT list_contains(" + _EL + r", e))) = 0 AND regexp_matches(w, '\d') AND NOT regexp_matches(w, '^[A-Za-z]{{5,}}$'))"


@registry.query("formula_extract", f"WITH {PAPERS}, w AS (SELECT paper_id, {_FORM.format('x')} AS f FROM (SELECT paper_id, {_PLAIN.format(chr(34) + 'title' + chr(34))} AS x FROM papers1 WHERE title IS NOT NULL)) SELECT paper_id, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), '|') AS formulas FROM w")
def formula_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct formulas in each title, in order."""
    p = papers(spark, folder, "title").where("title is not null").select("paper_id", ch.plain_formula(F.col("title")).alias("x"))
    return p.select("paper_id", F.array_join(ch.formulas(F.col("x")), "|").alias("formulas"))


@registry.query("carry_forward_context", f"""WITH {PAPERS}, s AS (SELECT paper_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(abstract, ''), '(\\d)\\.(\\d)', '\\1<DOT>\\2', 'g'), '[;.\\n]+'), lambda x: trim(replace(x, '<DOT>', '.'))), lambda x: length(x) > 5)) AS sentence,
        generate_subscripts(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(abstract, ''), '(\\d)\\.(\\d)', '\\1<DOT>\\2', 'g'), '[;.\\n]+'), lambda x: trim(replace(x, '<DOT>', '.'))), lambda x: length(x) > 5), 1) - 1 AS ord FROM papers1),
    f AS (SELECT paper_id, ord, {_FORM.format(_PLAIN.format('sentence'))}[1] AS own FROM s) SELECT paper_id, ord, own, last_value(own IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY ord) AS carried FROM f""")
def carry_forward_context(spark: SparkSession, folder: str) -> DataFrame:
    """The first formula of each sentence, and the last one seen so far in its abstract."""
    s = papers(spark, folder, "abstract").select("paper_id", F.posexplode(ch.sentences(F.col("abstract"))).alias("ord", "sentence"))
    own = s.select("paper_id", F.col("ord").cast("bigint").alias("ord"), ch.plain_formula(F.col("sentence")).alias("x")).select("paper_id", "ord", F.get(ch.formulas(F.col("x")), F.lit(0)).alias("own"))
    w = Window.partitionBy("paper_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("carried", F.last("own", ignorenulls=True).over(w))


@registry.query("structure_property_mentions", f"""WITH {PAPERS}, x AS (SELECT paper_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM papers1), st AS (SELECT structure_name AS n FROM structure_terms), pr AS (SELECT property_name AS n, label FROM property_terms)
    SELECT paper_id, (SELECT count(*) FROM st WHERE contains(t, lower(n))) AS structures, (SELECT count(*) FROM pr WHERE contains(t, lower(label))) AS properties FROM x""")
def structure_property_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """How many structures and properties of the reference lists each paper names; the lists are of fixed size."""
    st = [r[0].lower() for r in table(spark, folder, "structure_terms", "structure_name").collect()]
    pr = [r[0].lower() for r in table(spark, folder, "property_terms", "label").collect()]
    x = papers(spark, folder, "title", "abstract").select("paper_id", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("t"))
    return x.select("paper_id", F.size(ch.mentioned(F.col("t"), st)).cast("bigint").alias("structures"), F.size(ch.mentioned(F.col("t"), pr)).cast("bigint").alias("properties"))


@registry.query("csp_extract")
def csp_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of every abstract (tested sentence by sentence)."""
    forms = name_forms(table(spark, folder, "property_terms"))
    structures = [r[0] for r in table(spark, folder, "structure_terms", "structure_name").orderBy("structure_name").collect()]
    return extract(papers(spark, folder, "abstract"), forms, structures)
