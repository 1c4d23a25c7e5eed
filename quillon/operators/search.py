"""Evolutionary search of candidates (composition, structure, property): seeds, mutations, fitness, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.chemistry import ELEMENT_GROUPS, STOICHIOMETRY, stoichiometry_violation
from quillon.functions.text import short_id
from quillon.session import cut

SEEDS, MOST_GENERATIONS = 50, 20
FITNESS = {"evidence": 0.25, "novelty": 0.20, "plausibility": 0.20, "falsifiability": 0.15, "synthesizability": 0.10, "database_gap": 0.10}
COLUMNS = ["candidate_id", "composition", "structure", "property_name", "ranged", "generation", "parent_id", "history"]


def candidate(df: DataFrame, generation: Column, parent: Column, history: Column) -> DataFrame:
    out = df.withColumns({"candidate_id": short_id("cand_", F.col("composition"), F.col("structure"), F.col("property_name")), "generation": generation, "parent_id": parent, "history": history})
    return out.select(*COLUMNS).dropDuplicates(["candidate_id"])


def seeds(triples: DataFrame, most: int = SEEDS) -> DataFrame:
    """The first ``most`` distinct candidates by composition, structure and property (a top-k)."""
    t = triples.where("composition is not null and property_name is not null").select("composition", F.coalesce("structure", F.lit("unknown")).alias("structure"), "property_name", F.col("property_value").isNotNull().alias("ranged"))
    firsts = t.groupBy("composition", "structure", "property_name").agg(F.max("ranged").alias("ranged")).orderBy("composition", "structure", "property_name").limit(most)
    return candidate(firsts, F.lit(0), F.lit(None).cast("string"), F.array().cast("array<string>"))


def _pick(options: Column, *salt: Column | str) -> Column:
    return F.get(options, F.pmod(F.xxhash64(*[F.lit(s) if isinstance(s, str) else s for s in salt]), F.greatest(F.size(options), F.lit(1))).cast("int"))


def mutations(parents: DataFrame, properties: list[str], seed: int = 0) -> DataFrame:
    """Up to three children of each parent: another element of the group, another fitting structure, another property.

    Choices are hashes of the parent and ``seed``, so that a run can be repeated.
    """
    s = str(seed)
    element = _pick(F.regexp_extract_all("composition", F.lit("([A-Z][a-z]?)"), F.lit(1)), "element", F.col("candidate_id"), s)
    alternatives = F.array().cast("array<string>")
    for members in reversed(list(ELEMENT_GROUPS.values())):
        group = members.split()
        alternatives = F.when(F.col("_e").isin(*group), F.filter(F.array(*[F.lit(x) for x in group]), lambda x: x != F.col("_e"))).otherwise(alternatives)
    base = parents.withColumn("_e", element).withColumn("_r", _pick(alternatives, "replacement", F.col("candidate_id"), s))
    at = F.instr("composition", F.col("_e"))
    swapped = F.concat(F.substring("composition", F.lit(1), at - 1), F.col("_r"), F.substring("composition", at + F.length("_e"), F.length("composition")))
    grow = lambda d, name: candidate(d.withColumn("_p", F.col("candidate_id")), F.col("generation") + 1, F.col("_p"), F.array_append("history", F.lit(name)))
    one = grow(base.where(F.col("_r").isNotNull() & (at > 0)).withColumn("composition", swapped), "element_substitution")
    known = F.array(*[F.lit(x) for x in STOICHIOMETRY])
    fitting = F.filter(known, lambda x: (x != F.col("structure")) & stoichiometry_violation(F.col("composition"), x).isNull())
    two = grow(parents.withColumn("_s", _pick(fitting, "structure", F.col("candidate_id"), s)).where("_s is not null").withColumn("structure", F.col("_s")), "structure_replacement")
    others = F.filter(F.array(*[F.lit(p) for p in properties]), lambda x: x != F.col("property_name"))
    three = grow(parents.withColumn("_q", _pick(others, "property", F.col("candidate_id"), s)).where("_q is not null").withColumns({"property_name": F.col("_q"), "ranged": F.lit(False)}), "property_swap")
    return one.unionByName(two).unionByName(three).dropDuplicates(["candidate_id"])


def fitness(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds the parts of FITNESS and their weighted sum. ``facts``: (composition, n_triples, n_papers, exact set of 'structure|property')."""
    j = candidates.join(facts, "composition", "left")
    n, p = F.coalesce("n_triples", F.lit(0)), F.coalesce("n_papers", F.lit(0))
    exact = F.coalesce(F.array_contains("exact", F.concat_ws("|", "structure", "property_name")), F.lit(False))
    parts = {
        "evidence": F.least(F.lit(1.0), 0.15 * n + 0.10 * p),
        "novelty": F.when(p == 0, 0.8).when(p <= 2, 0.6).when(p <= 5, 0.4).otherwise(0.2),
        "plausibility": F.when(stoichiometry_violation(F.col("composition"), F.col("structure")).isNull(), 0.8).otherwise(0.1),
        "falsifiability": F.when(F.col("ranged"), 0.9).otherwise(0.3),
        "synthesizability": F.when(F.col("structure") == "unknown", 0.3).otherwise(0.7),
        "database_gap": F.when(exact, 0.1).otherwise(0.8),
    }
    out = j.withColumns(parts)
    return out.withColumn("fitness", F.round(sum((F.col(k) * w for k, w in list(FITNESS.items())[1:]), F.col("evidence") * 0.25), 6)).drop("n_triples", "n_papers", "exact")


def facts_of(triples: DataFrame) -> DataFrame:
    t = triples.where("composition is not null")
    return t.groupBy("composition").agg(F.count("*").alias("n_triples"), F.count_distinct("source_paper_id").alias("n_papers"), F.collect_set(F.concat_ws("|", "structure", "property_name")).alias("exact"))


def search(triples: DataFrame, properties: list[str], *, generations: int = 5, parents: int = 10, population: int = 50, seed: int = 0) -> DataFrame:
    """The best ``population`` candidates after ``generations`` rounds of mutation and selection.

    A generation holds at most ``population`` rows plus three children for each parent,
    and is cut from its lineage in the shared folder. Children that the population has
    already are left out. Properties are the names of a reference list.
    """
    facts = cut(facts_of(triples))
    order = [F.desc("fitness"), F.col("candidate_id")]
    pop = cut(fitness(seeds(triples, population), facts))
    for g in range(min(generations, MOST_GENERATIONS)):
        children = mutations(pop.orderBy(*order).limit(parents).select(*COLUMNS), properties, seed + g).join(pop.select("candidate_id"), "candidate_id", "left_anti")
        pop = cut(pop.unionByName(fitness(children, facts)).orderBy(*order).limit(population))
    return pop.orderBy(*order)
