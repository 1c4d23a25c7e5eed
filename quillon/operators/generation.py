"""Hypotheses from pairs of papers: relevance, method names, templates, statement checks, material branches, replies of a model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions.chemistry import prediction_interval
from quillon.functions.lexicons import EVIDENCE_TERMS, GENERIC_WORDS, METHOD_WORDS, STOP_WORDS
from quillon.functions.replies import checked_hypotheses, parse_list
from quillon.functions.settle import settle
from quillon.functions.text import literal
from quillon.operators import physics, quality
from quillon.operators.statements import FRAGMENT, falsifiability, material_branches, merged_keywords

# Statements of this engine; each kind has one in which a number or an observable can be checked.
TEMPLATES = {
    "analogy": (
        "Transferring {method_a} from {domain_a} to {domain_b} is expected to improve {problem} by way of {bridge}",
        "If {bridge} limits {problem} in {domain_b}, then {method_a} from {domain_a} is expected to raise its efficiency",
    ),
    "combination": (
        "Combining {method_a} with {method_b} through {bridge} is expected to improve {problem}",
        "{method_a} together with {method_b} is expected to give a higher efficiency for {problem} than either alone",
    ),
    "contradiction": (
        "{method_a} and {method_b} conflict on {bridge}: the boundary where {problem} changes sign is expected to be measurable",
        "The opposite effects of {method_a} and {method_b} on {problem} are expected to meet at one value of {bridge}",
    ),
    "gap": (
        "The effect of {bridge} on {problem} with {method_a} is not yet studied; a measured efficiency is expected to decide it",
        "{method_a} and {method_b} share {bridge}, but how {problem} responds is unexplored; an improvement of its resistance is expected",
    ),
}
KINDS = {"cross_domain_bridge": "analogy", "method_transfer": "analogy", "concept_complement": "combination", "contradiction": "contradiction", "direct_similarity": "gap"}
LEAST_SIMILARITY, LEAST_FALSIFIABILITY, GATED_FALSIFIABILITY = 0.05, 0.3, 0.45
REPLY = "array<struct<statement: string, hypothesis_type: string, confidence: double, predicted_variable: string, predicted_direction: string, rationale: string>>"
SCORE = "array<struct<score: double, reasoning: string>>"


class Client(Protocol):
    """What answers prompts, one text for each; it is pickled to the workers. None is built in."""

    def complete(self, prompts: list[str]) -> list[str]: ...


def ask(df: DataFrame, prompt: str, client: Client | None, reply: str = "reply", retries: int = 2) -> DataFrame:
    """``df`` with the ``reply`` of ``client`` to each ``prompt``; null where there is no client, no prompt or no answer.

    Equal prompts of a batch are asked once; a call that fails is repeated ``retries``
    times, and then its rows stay without an answer.
    """
    if client is None:
        return df.withColumn(reply, F.lit(None).cast("string"))
    rest = [f for f in df.schema.fields if f.name != reply]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", `{reply}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str, str] = {}
            asked = [p for p in dict.fromkeys(b[prompt]) if p is not None]
            for _ in range(retries + 1):
                try:
                    known = dict(zip(asked, client.complete(asked))) if asked else {}
                    break
                except Exception:  # noqa: BLE001  a model that fails is a model without an answer
                    known = {}
            yield b.assign(**{reply: [known.get(p) for p in b[prompt]]})[[f.name for f in rest] + [reply]]

    return df.select(*[f.name for f in rest]).mapInPandas(run, schema)


def hypothesis_kind(pair_type: Column) -> Column:
    out = F.lit("gap")
    for k, v in KINDS.items():
        out = F.when(pair_type == k, v).otherwise(out)
    return out


def relevant(pairs: DataFrame, domain_words: list[str]) -> DataFrame:
    """Pairs of which either side's title, key words or abstract holds one of ``domain_words``; all pairs if there are none."""
    if not domain_words:
        return pairs
    both = F.lower(F.concat_ws(" ", *[x for s in "ab" for x in (F.col(f"paper_{s}_title"), F.col(f"paper_{s}_keywords"), F.col(f"paper_{s}_abstract"))]))
    return pairs.where(F.exists(literal([w.lower() for w in domain_words]), lambda w: F.contains(both, w)))


def of_quality(pairs: DataFrame, rules: quality.QualityRules) -> DataFrame:
    """Pairs of which both sides pass the quality gate; all pairs if it is off."""
    if not rules.enabled:
        return pairs
    out = pairs
    for s in "ab":
        kept = quality.assess(out.withColumn("_title", F.col(f"paper_{s}_title")).withColumn("_abstract", F.col(f"paper_{s}_abstract")).withColumn("_kw", F.col(f"paper_{s}_keywords")), rules, title="_title", abstract="_abstract", keywords="_kw")
        out = kept.where("accepted").select(*pairs.columns)
    return out


def method_name(title: Column, bridge: Column, words: Column) -> Column:
    """What a paper is about: the first bridge word in its title, else its own key word there, else a method word, else its first word of substance; '' if none.

    Generic words, and words of fewer than four letters, name nothing.
    """
    low = F.lower(F.coalesce(title, F.lit("")))
    none = F.array().cast("array<string>")
    named = lambda c: F.get(F.filter(F.coalesce(c, none), lambda k: k.isNotNull() & (F.length(F.trim(k)) >= 4) & F.contains(low, F.lower(F.trim(k))) & ~F.lower(F.trim(k)).isin(*GENERIC_WORDS)), F.lit(0))
    method = F.get(F.filter(literal(METHOD_WORDS), lambda w: F.contains(low, w)), F.lit(0))
    bare = F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]]+|[.,;:!?()\[\]]+$", ""))
    long = F.get(F.filter(bare, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*GENERIC_WORDS, *STOP_WORDS)), F.lit(0))
    return F.coalesce(named(bridge), named(words), method, long, F.lit(""))


def statement_violations(statement: Column, kind: Column, cross: Column, method_a: Column, method_b: Column) -> Column:
    """Reasons for which a statement is no hypothesis: a method or place named twice, transfer within a domain, a title's fragment, an empty slot, too short."""
    low = F.lower(statement)
    move = lambda k: F.trim(F.regexp_extract(low, r"from (.+?) to (.+?)(?: is |[,.;]|$)", k))
    checks = [
        (kind.isin("analogy", "combination", "contradiction") & (F.lower(method_a) == F.lower(method_b)) & (method_a != ""), "same_method"),
        ((move(1) != "") & (move(1) == move(2)), "same_source_and_target"),
        (low.rlike(r"\b(\w{2,20}) (?:in|and|with) \1\b"), "refers_to_itself"),
        ((kind == "analogy") & F.contains(low, F.lit("transfer")) & ~F.coalesce(cross, F.lit(False)), "not_across_domains"),
        (low.rlike(FRAGMENT), "title_fragment"),
        (method_a == "", "no_method"),
        (low.rlike(r"  |^ | $|\( *\)"), "empty_slot"),
        (F.length(F.trim(statement)) < 30, "too_short"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def general(pairs: DataFrame, *, domain_words: list[str] | None = None, rules: quality.QualityRules | None = None) -> DataFrame:
    """One hypothesis for each pair of which a template gives a valid and falsifiable statement.

    ``pairs``: pair_id, paper_{a,b}_{id,title,keywords,abstract}, similarity, cross_domain,
    pair_type, bridge_keywords, connection_reason, and category_a, category_b if there
    are. Templates of the pair's kind are tried from the one that a hash of the pair
    chooses; an analogy within one domain or method is a combination. Pairs below
    LEAST_SIMILARITY (or with none), irrelevant ones and, where ``rules`` are on, those
    of poor papers give nothing. Rows with a null pair_id are left out; other nulls count
    as empty.
    """
    rules = rules or quality.QualityRules(enabled=False)
    out = of_quality(relevant(pairs.where(F.col("pair_id").isNotNull() & (F.col("similarity") >= LEAST_SIMILARITY)), domain_words or []), rules)
    category = lambda s: tx.domain(F.col(f"category_{s}")) if f"category_{s}" in pairs.columns else F.lit("the target domain")
    none = F.array().cast("array<string>")
    words = F.filter(F.transform(F.coalesce("bridge_keywords", none), lambda k: F.trim(k)), lambda k: k.isNotNull() & (k != ""))
    out = settle(out, {"_k": F.slice(words, 1, 3), "_ta": tx.without_opening(F.col("paper_a_title")), "_tb": tx.without_opening(F.col("paper_b_title")), "_da": category("a"), "_db": category("b")})
    made = {"method_a": method_name(F.col("_ta"), F.col("_k"), F.col("paper_a_keywords")), "method_b": method_name(F.col("_tb"), F.col("_k"), F.col("paper_b_keywords")), "bridge": F.coalesce(F.get("_k", F.lit(0)), F.lit("a shared concept")), "problem": F.when(F.size("_k") > 1, F.element_at("_k", -1)).otherwise(F.col("_db"))}
    out = settle(out, {f"_{k}": c for k, c in made.items()} | {"hypothesis_type": hypothesis_kind(F.col("pair_type"))})
    alike = (F.col("_da") == F.col("_db")) | (F.lower("_method_a") == F.lower("_method_b"))
    out = settle(out, {"_form": F.when((F.col("hypothesis_type") == "analogy") & alike, "combination").otherwise(F.col("hypothesis_type"))})
    slots = {"{method_a}": "_method_a", "{method_b}": "_method_b", "{domain_a}": "_da", "{domain_b}": "_db", "{bridge}": "_bridge", "{problem}": "_problem"}

    def filled(template: str) -> Column:
        c = F.lit(template)
        for slot, name in slots.items():
            c = F.replace(c, F.lit(slot), F.col(name))
        return c

    most = max(map(len, TEMPLATES.values()))
    turn = F.pmod(F.xxhash64("pair_id"), F.lit(most)).cast("int")
    metric = F.get(F.filter(literal(EVIDENCE_TERMS), lambda w: F.contains(F.lower(F.concat_ws(" ", "paper_a_keywords", "paper_b_keywords", "paper_a_abstract", "paper_b_abstract")), w)), F.lit(0))
    least = GATED_FALSIFIABILITY if rules.enabled else LEAST_FALSIFIABILITY
    for i in range(most):
        s = F.lit(None).cast("string")
        for kind, templates in TEMPLATES.items():
            for j, t in enumerate(templates):
                s = F.when((F.col("_form") == kind) & (F.pmod(turn + i, F.lit(len(templates))) == j), filled(t)).otherwise(s)
        if rules.enabled:
            s = F.when(metric.isNotNull() & ~F.exists(literal(EVIDENCE_TERMS), lambda w: F.contains(F.lower(s), w)), F.concat(s, F.lit(", observed by "), metric)).otherwise(s)
        out = settle(out, {f"_s{i}": s})
        out = settle(out, {f"_f{i}": falsifiability(F.col(f"_s{i}")), f"_v{i}": statement_violations(F.col(f"_s{i}"), F.col("_form"), F.col("cross_domain"), F.col("_method_a"), F.col("_method_b"))})
    good = [F.when((F.size(f"_v{i}") == 0) & (F.col(f"_f{i}") >= least), F.struct(F.col(f"_s{i}").alias("statement"), F.col(f"_f{i}").alias("falsifiability"))) for i in range(most)]
    out = settle(out, {"_g": F.coalesce(*good)}).where("_g is not null")
    return _finished(out.withColumns({"statement": F.col("_g.statement"), "falsifiability": F.round("_g.falsifiability", 6)}), "template")


def _finished(df: DataFrame, method: str) -> DataFrame:
    """Ids, novelty, confidence and key words of general hypotheses."""
    t, cross, sim = F.col("hypothesis_type"), F.coalesce("cross_domain", F.lit(False)), F.col("similarity")
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    novelty = F.least(F.lit(1.0), 0.5 + plus(cross, 0.2) + plus(sim < 0.3, 0.15) + plus(t == "contradiction", 0.1) + plus(t == "combination", 0.05))
    confidence = F.least(F.lit(0.9), F.greatest(F.lit(0.1), 0.3 + 0.5 * sim + plus(t == "gap", 0.1) - plus(cross, 0.05)))
    return df.select(
        tx.short_id("hypo_", F.col("pair_id"), F.lit(method)).alias("hypothesis_id"), "hypothesis_type", "statement", "falsifiability", "pair_id", "paper_a_id", "paper_b_id", "paper_a_title", "paper_b_title", F.col("connection_reason").alias("rationale"),
        merged_keywords(F.col("bridge_keywords"), merged_keywords(F.col("paper_a_keywords"), F.col("paper_b_keywords"))).alias("keywords"), F.round(novelty, 3).alias("novelty"), F.round(confidence, 3).alias("confidence"), cross.alias("cross_domain"), "similarity", F.lit(method).alias("generation_method"),
    )


def accepted_replies(pairs: DataFrame, reply: str = "reply", *, least: float = LEAST_FALSIFIABILITY) -> DataFrame:
    """Hypotheses that the ``reply`` of a model gives for each pair, the first valid and falsifiable one.

    As ``general``, with 0.1 more novelty, the model's own confidence, and the predicted
    variable first among at most ten key words. Replies that cannot be read give nothing.
    """
    one = pairs.where(F.col("pair_id").isNotNull()).withColumn("_o", F.explode(parse_list(F.col(reply), REPLY)))
    one = one.withColumns({"statement": F.col("_o.statement"), "hypothesis_type": F.col("_o.hypothesis_type"), "confidence": F.coalesce("_o.confidence", F.lit(0.5))}).where("statement is not null")
    one = settle(checked_hypotheses(one), {"falsifiability": F.round(falsifiability(F.col("statement")), 6), "_v": statement_violations(F.col("statement"), F.col("hypothesis_type"), F.col("cross_domain"), F.lit("a"), F.lit("b"))})
    one = one.where((F.size("_v") == 0) & (F.col("falsifiability") >= least))
    best = one.groupBy("pair_id").agg(F.max_by(F.struct(*[c for c in one.columns if c not in ("pair_id", "_v")]), F.struct("falsifiability", "statement")).alias("r")).select("pair_id", "r.*")
    done = _finished(best, "model").drop("confidence", "novelty").join(best.select("pair_id", "confidence", F.col("_o.predicted_variable").alias("_p"), F.col("_o.rationale").alias("_r")), "pair_id")
    base = F.least(F.lit(1.0), 0.6 + F.when(F.col("cross_domain"), 0.2).otherwise(0.0) + F.when(F.col("similarity") < 0.3, 0.15).otherwise(0.0) + F.when(F.col("hypothesis_type") == "contradiction", 0.1).when(F.col("hypothesis_type") == "combination", 0.05).otherwise(0.0))
    words = F.when(F.coalesce(F.trim("_p"), F.lit("")) != "", merged_keywords(F.array("_p"), F.col("keywords"))).otherwise(F.col("keywords"))
    return done.withColumns({"novelty": F.round(base, 3), "confidence": F.round("confidence", 3), "keywords": words, "rationale": F.coalesce(F.nullif("_r", F.lit("")), "rationale")}).drop("_p", "_r")


def first_facts(triples: DataFrame) -> DataFrame:
    """(paper_id, facts): of each paper and property the first triple, in order of property; at most as many as there are properties."""
    named = triples.where("source_paper_id is not null and composition is not null and coalesce(structure, '') not in ('', 'unknown') and coalesce(property_name, 'general') not in ('general', 'unknown')")
    one = named.groupBy("source_paper_id", "property_name").agg(F.min_by(F.struct("composition", "structure", "property_value", "property_unit"), "triple_id").alias("r"))
    return one.groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.sort_array(F.collect_list(F.struct("property_name", "r.composition", "r.structure", "r.property_value", "r.property_unit"))).alias("facts"))


def material(pairs: DataFrame, triples: DataFrame, **options) -> DataFrame:
    """Hypotheses of pairs from what the triples of both papers share; the general one where they give none.

    ``triples``: triple_id, source_paper_id, composition, structure, property_name,
    property_value, property_unit. Added to the columns of ``general``: numeric, pending,
    fallback, low, high, unit, composition_a, composition_b, structure_a, property_name,
    known_principle. The shared property is the first by name. A statement that is
    physically impossible gives way to the general one; one that states a known principle
    loses novelty (x 0.4) and confidence (x 0.7).
    """
    f = first_facts(triples)
    side = lambda s: f.select(F.col("paper_id").alias(f"paper_{s}_id"), F.col("facts").alias(f"_f{s}"))
    j = pairs.where(F.col("pair_id").isNotNull()).join(side("a"), "paper_a_id", "left").join(side("b"), "paper_b_id", "left")
    names = lambda s, c: F.transform(f"_f{s}", lambda x: x[c])
    j = settle(j, {"_p": F.get(F.sort_array(F.array_intersect(names("a", "property_name"), names("b", "property_name"))), F.lit(0))})
    pick = lambda s: F.coalesce(F.get(F.filter(f"_f{s}", lambda x: x["property_name"] == F.col("_p")), F.lit(0)), F.get(F.filter(f"_f{s}", lambda x: x["property_value"].isNotNull()), F.lit(0)), F.get(F.col(f"_f{s}"), F.lit(0)))
    j = settle(j, {"_a": pick("a"), "_b": pick("b")})
    flags = {
        "valid_a": F.col("_a").isNotNull(), "valid_b": F.col("_b").isNotNull(), "shared": F.col("_p").isNotNull(), "value_a": F.col("_a.property_value").isNotNull(), "value_b": F.col("_b.property_value").isNotNull(),
        "same_structure": F.arrays_overlap(names("a", "structure"), names("b", "structure")), "same_composition": F.col("_a.composition") == F.col("_b.composition"),
    }
    j = material_branches(settle(j, flags))
    gap = F.col("branch") == "gap_filling"
    target = F.when(gap, F.col("_a.composition")).otherwise(F.col("_b.composition"))
    low, high = prediction_interval(F.col("_a.property_value"), F.col("u"))
    j = settle(j.where("branch <> 'fallback'"), {"low": low, "high": high, "unit": F.coalesce("_a.property_unit", F.lit("")), "property_name": F.col("_a.property_name"), "composition_a": F.col("_a.composition"), "composition_b": F.when(~gap, F.col("_b.composition")), "structure_a": F.col("_a.structure"), "structure_b": F.col("_b.structure"), "_t": target})
    shown = F.replace("property_name", F.lit("_"), F.lit(" "))
    span = F.trim(F.concat(F.format_string("%.4g", "low"), F.lit("–"), F.format_string("%.4g", "high"), F.lit(" "), F.col("unit")))
    statement = (
        F.when(F.col("branch") == "structure_property", F.concat(F.lit("In the shared structure "), "structure_a", F.lit(" the "), shown, F.lit(" of "), "_t", F.lit(" is predicted at "), span, F.lit(" from that of "), "composition_a"))
        .when(gap, F.concat(F.lit("The "), shown, F.lit(" of "), "_t", F.lit(" in structures other than "), "structure_a", F.lit(" is unreported; predicted "), span))
        .otherwise(F.concat(F.lit("A hidden link between "), "composition_a", F.lit(" and "), "_t", F.lit(" suggests a "), shown, F.lit(" predicted at "), span))
    )
    j = settle(j, {"statement": statement, "predicted_value": F.col("_a.property_value"), "predicted_unit": F.col("unit")})
    j = physics.validate(j).where("severity <> 'reject'")
    cross, known = F.coalesce("cross_domain", F.lit(False)), F.col("known_principle")
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    novelty = F.least(F.lit(1.0), 0.5 + plus(cross, 0.2) + plus(F.col("composition_b").isNotNull() & (F.col("composition_a") != F.col("composition_b")), 0.15) + plus(F.col("value_a") | F.col("value_b"), 0.1)) * F.when(known, 0.4).otherwise(1.0)
    confidence = F.least(F.lit(0.9), F.greatest(F.lit(0.1), 0.3 + 0.5 * F.coalesce("similarity", F.lit(0.0)) - plus(cross, 0.05))) * F.when(known, 0.7).otherwise(1.0)
    terms = F.filter(F.array("composition_a", "composition_b", "structure_a", shown), lambda x: x.isNotNull())
    numeric = j.select(
        tx.short_id("hypo_", F.col("pair_id"), F.lit("material")).alias("hypothesis_id"), F.col("branch").alias("hypothesis_type"), "statement", F.round(falsifiability(F.col("statement")), 6).alias("falsifiability"), "pair_id", "paper_a_id", "paper_b_id", "paper_a_title", "paper_b_title",
        F.col("connection_reason").alias("rationale"), merged_keywords(terms, F.col("bridge_keywords")).alias("keywords"), F.round(novelty, 3).alias("novelty"), F.round(confidence, 3).alias("confidence"), cross.alias("cross_domain"), "similarity", F.lit("material").alias("generation_method"),
        F.lit(True).alias("numeric"), "pending", F.lit(False).alias("fallback"), "low", "high", "unit", "composition_a", "composition_b", "structure_a", "property_name", "known_principle",
    )
    rest = general(pairs.join(numeric.select("pair_id"), "pair_id", "left_anti"), **options)
    empty = {"numeric": F.lit(False), "pending": F.lit(False), "fallback": F.lit(True), "known_principle": F.lit(False)} | {c: F.lit(None).cast("double") for c in ("low", "high")} | {c: F.lit(None).cast("string") for c in ("unit", "composition_a", "composition_b", "structure_a", "property_name")}
    return numeric.unionByName(rest.withColumns(empty))
