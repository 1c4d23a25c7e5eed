"""A report of one run in ten sections, from aggregated tables of a few rows each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTIONS = ("Abstract", "Corpus", "Quality gate", "Extracted facts", "Paper pairs", "Hypotheses", "Trials", "Verification", "Research gaps", "Candidates", "Appendix")


def table_of(df: DataFrame, most: int = 10) -> str:
    """The first ``most`` rows as a Markdown table."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]])


def report(title: str, *, papers: DataFrame, assessed: DataFrame, triples: DataFrame, pairs: DataFrame, trials: DataFrame, verified: DataFrame, gaps: DataFrame, candidates: DataFrame) -> str:
    """Markdown with the sections of SECTIONS. Only aggregates and top lists come to the driver."""
    n = {k: d.count() for k, d in (("papers", papers), ("triples", triples), ("pairs", pairs), ("trials", trials), ("discoveries", verified.where("discovery")))}
    parts = [
        f"{n['papers']} papers, {n['pairs']} pairs, {n['trials']} trials and {n['discoveries']} discoveries.",
        table_of(papers.groupBy("source").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "source")),
        table_of(assessed.groupBy("accepted").agg(F.count("*").alias("papers"), F.round(F.avg("score"), 3).alias("mean_score")).orderBy("accepted")),
        table_of(triples.groupBy("property_name").agg(F.count("*").alias("triples")).orderBy(F.desc("triples"), "property_name")),
        table_of(pairs.groupBy("pair_type").agg(F.count("*").alias("pairs"), F.round(F.avg("similarity"), 4).alias("mean_similarity")).orderBy(F.desc("pairs"), "pair_type")),
        table_of(trials.groupBy("hypothesis_type").agg(F.count("*").alias("hypotheses")).orderBy(F.desc("hypotheses"), "hypothesis_type")),
        table_of(trials.groupBy("passed").agg(F.count("*").alias("trials"), F.round(F.avg("score"), 4).alias("mean_score")).orderBy("passed")),
        table_of(verified.groupBy("level").agg(F.count("*").alias("hypotheses"), F.round(F.avg("stability"), 4).alias("mean_stability")).orderBy("level")),
        table_of(gaps), table_of(candidates), "Scores are those of rule-based evaluators; a discovery is a reproducible one among them, no experiment.",
    ]
    body = "\n\n".join(f"## {i}. {s}\n\n{p}" if s != "Appendix" else f"## {s}\n\n{p}" for i, (s, p) in enumerate(zip(SECTIONS, parts), 1))
    return f"# {title}\n\n{body}\n"
