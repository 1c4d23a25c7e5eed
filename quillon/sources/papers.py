"""Readers of paper sources into one schema: saved JSON pages, an Atom feed, the built-in corpus with a cursor, manual rows.

Network access stays outside: a page is fetched by whoever owns the credentials and
lands as text; parsing is declarative and runs anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import from_inverted_index, keywords

SCHEMA = "paper_id string, title string, abstract string, authors array<string>, categories array<string>, keywords array<string>, year int, source string, data_source string, metadata map<string,string>"
_EMPTY = "array<string>"


def _conform(df: DataFrame) -> DataFrame:
    kinds = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def _meta(**fields: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


OPENALEX = "results array<struct<id: string, display_name: string, abstract_inverted_index: map<string, array<int>>, publication_year: int, cited_by_count: int, authorships: array<struct<author: struct<display_name: string>>>, concepts: array<struct<display_name: string, score: double>>>>"
SCIVERSE = "data array<struct<doc_id: string, title: string, abstract: string, chunk: string, year: int, authors: array<string>, topic: string, venue: string>>"


def from_openalex(pages: DataFrame, body: str = "body") -> DataFrame:
    """Papers of saved works pages: abstracts decoded from their index, rows without title or abstract left out.

    Malformed pages give no rows. Key words are the three best concepts, categories the first.
    """
    w = pages.select(F.explode(F.from_json(F.col(body), OPENALEX)["results"]).alias("w")).select("w.*")
    names = F.transform(F.coalesce("concepts", F.array().cast("array<struct<display_name: string, score: double>>")), lambda c: c["display_name"])
    out = w.select(
        F.concat(F.lit("openalex_"), F.regexp_extract("id", "([^/]+)$", 1)).alias("paper_id"), F.col("display_name").alias("title"), from_inverted_index(F.col("abstract_inverted_index")).alias("abstract"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.slice(names, 1, 1).alias("categories"), F.slice(names, 1, 3).alias("keywords"), F.col("publication_year").alias("year"),
        F.lit("openalex").alias("source"), F.lit("online").alias("data_source"), _meta(citation_count=F.col("cited_by_count")).alias("metadata"),
    )
    return _conform(out.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("abstract", F.lit("")) != "")))


def from_sciverse(pages: DataFrame, body: str = "body") -> DataFrame:
    """Papers of saved search pages: an empty abstract is the first 500 characters of the passage; titles once each.

    The topic may be plain text or a JSON object with a display_name.
    """
    d = pages.select(F.explode(F.from_json(F.col(body), SCIVERSE)["data"]).alias("d")).select("d.*").where(F.coalesce("title", F.lit("")) != "")
    topic = F.coalesce(F.get_json_object("topic", "$.display_name"), F.when(~F.startswith(F.trim("topic"), F.lit("{")), F.col("topic")))
    text = F.coalesce(F.nullif(F.trim("abstract"), F.lit("")), F.substring("chunk", 1, 500))
    first = d.groupBy("title").agg(F.min(F.struct("doc_id", text.alias("abstract"), topic.alias("topic"), "year", "authors", "venue")).alias("d")).select("title", "d.*")
    out = first.select(
        F.concat(F.lit("sciverse_"), F.substring(F.md5(F.coalesce("doc_id", "title").cast("binary")), 1, 7)).alias("paper_id"), "title", "abstract", "authors", F.filter(F.array("topic"), lambda t: t.isNotNull()).alias("categories"),
        keywords(F.concat_ws(" ", "title", "abstract")).alias("keywords"), "year", F.lit("sciverse").alias("source"), F.lit("online").alias("data_source"), _meta(venue=F.col("venue")).alias("metadata"),
    )
    return _conform(out)


ATOM = "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, category: array<struct<_term: string>>>>"


def from_atom(pages: DataFrame, body: str = "body") -> DataFrame:
    """Papers of a saved Atom feed; the year is that of publication."""
    e = pages.select(F.explode(F.from_xml(F.col(body), ATOM)["entry"]).alias("e")).select("e.*")
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = e.select(
        F.concat(F.lit("arxiv_"), F.regexp_replace(F.regexp_extract("id", "([^/]+)$", 1), r"v\d+$", "")).alias("paper_id"), clean(F.col("title")).alias("title"), clean(F.col("summary")).alias("abstract"), F.transform("author", lambda a: a["name"]).alias("authors"),
        F.transform("category", lambda c: c["_term"]).alias("categories"), keywords(F.concat_ws(" ", "title", "summary")).alias("keywords"), F.substring("published", 1, 4).try_cast("int").alias("year"), F.lit("arxiv").alias("source"), F.lit("online").alias("data_source"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return _conform(out)


READERS = {"openalex": from_openalex, "sciverse": from_sciverse, "arxiv": from_atom}


def collected(pages: DataFrame, mode: str, corpus: DataFrame | None = None, *, size: int = 20, cursor: int = 0) -> DataFrame:
    """Papers of saved ``pages`` (source, body) by ``mode``: one source, 'all' of them, or 'offline'.

    Each id counts once. Where the pages give no paper, and in the mode 'offline', the next
    ``size`` papers of the built-in ``corpus`` stand in, if there is one, tagged as such.
    Raises ``ValueError`` for a mode that is none.
    """
    if mode not in (*READERS, "all", "offline"):
        raise ValueError(f"unknown mode: {mode!r}")
    wanted = [] if mode == "offline" else list(READERS) if mode == "all" else [mode]
    found = None
    for source in wanted:
        part = READERS[source](pages.where(F.col("source") == source))
        found = part if found is None else found.unionByName(part)
    if found is not None:
        found = found.dropDuplicates(["paper_id"])
        if corpus is None or not found.isEmpty():
            return found
    if corpus is None:
        raise ValueError("the mode 'offline' needs a corpus")
    batch = offline_batch(corpus, size, cursor)
    return batch if mode == "offline" else batch.withColumn("data_source", F.lit("offline_fallback"))


def offline_batch(corpus: DataFrame, size: int, cursor: int = 0, seed: int = 0) -> DataFrame:
    """Rows ``cursor`` to ``cursor + size`` of a seeded permutation of a built-in corpus, tagged offline.

    A batch is what one round of collecting takes, so its size is part of the operator.
    """
    order = Window.orderBy(F.xxhash64("paper_id", F.lit(seed)), "paper_id")
    top = corpus.orderBy(F.xxhash64("paper_id", F.lit(seed)), "paper_id").limit(cursor + size)
    return top.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > cursor).drop("_n").withColumn("data_source", F.lit("offline"))


# Title openings of variants.
VARIANT_OPENINGS = ("Enhanced", "Adaptive", "Scalable", "Robust", "Efficient", "Unified", "Deep", "Progressive", "Towards", "A Novel")


def variants(papers: DataFrame, seed: int = 0) -> DataFrame:
    """A variant of each paper: another id, an opening before the title, another year; the same for the same seed."""
    h = F.xxhash64("paper_id", F.lit(seed))
    opening = F.element_at(F.array(*[F.lit(v) for v in VARIANT_OPENINGS]), (F.pmod(h, F.lit(len(VARIANT_OPENINGS))) + 1).cast("int"))
    return papers.withColumns({"paper_id": F.concat(F.col("paper_id"), F.lit("_"), F.substring(F.md5(F.concat_ws("|", "paper_id", F.lit(str(seed))).cast("binary")), 1, 6)), "title": F.concat_ws(" ", opening, "title"), "year": (F.lit(2018) + F.pmod(F.abs(h), F.lit(8))).cast("int")})


def manual(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Papers added by hand: id from the title's MD5, source 'manual'."""
    names = [x.split(" ", 1)[0] for x in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)
    own = F.concat(F.lit("manual_"), F.substring(F.md5(F.col("title").cast("binary")), 1, 8))
    return df.withColumns({"paper_id": F.coalesce("paper_id", own), "source": F.coalesce("source", F.lit("manual")), "data_source": F.coalesce("data_source", F.lit("manual"))})


def origin(papers: DataFrame) -> DataFrame:
    """``papers`` with data_source set where it is null: offline_fallback for ids of the built-in corpus, else online."""
    return papers.withColumn("data_source", F.coalesce("data_source", F.when(F.startswith("paper_id", F.lit("paper_")), "offline_fallback").otherwise("online")))


def fresh(papers: DataFrame, known: DataFrame) -> DataFrame:
    """Papers whose id is not known yet, each once."""
    return papers.dropDuplicates(["paper_id"]).join(known.select("paper_id").distinct(), "paper_id", "left_anti")


def lookup(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates with what a cache of external databases has on their composition; ``found`` is null where nothing was looked up."""
    return candidates.join(cache.select("composition", "database", "found", F.col("value").alias("known_value"), F.col("unit").alias("known_unit")), "composition", "left")


def submitted_triples(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Triples delivered by an agent: composition and property needed, value read or null, confidence 0.95, unknown keys only, the first of each."""
    key = ["composition", "structure", "property_name"]
    t = rows.where((F.coalesce("composition", F.lit("")) != "") & (F.coalesce("property_name", F.lit("")) != "")).select("composition", F.coalesce(F.nullif("structure", F.lit("")), F.lit("unknown")).alias("structure"), "property_name", F.col("property_value").cast("string").try_cast("double").alias("property_value"), "property_unit", "ord")
    first = t.groupBy(*key).agg(F.min_by(F.struct("property_value", "property_unit"), "ord").alias("v")).select(*key, "v.*", F.lit(0.95).alias("confidence"))
    return first.join(known.select(*key).distinct(), key, "left_anti")
