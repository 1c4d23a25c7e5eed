"""Research gaps: supporting papers, counter-evidence, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import set_jaccard
from quillon.session import cut

MOST_SUPPORT, MOST_COUNTER = 5, 8


WORD = r"[a-z0-9][a-z0-9.]*[a-z0-9]|[a-z0-9]"


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _foreign(text: Column) -> Column:
    """Runs of letters and digits that are not all ASCII."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: w.rlike(r"[^\x00-\x7f]")))


def _holds(text: Column, k: Column) -> Column:
    """Whether ``k`` stands in ``text`` with no letter or digit going on at an end that is one, nor a point between digits or letters."""
    before = F.when(k.rlike(r"^[\p{L}\p{N}]"), r"(?<![\p{L}\p{N}])(?<![\p{L}\p{N}]\.)").otherwise("")
    after = F.when(k.rlike(r"[\p{L}\p{N}]$"), r"(?![\p{L}\p{N}]|\.[\p{L}\p{N}])").otherwise("")
    return F.contains(text, k) & F.regexp_like(text, F.concat(before, F.lit(r"\Q"), k, F.lit(r"\E"), after))


LONGEST = 6  # words by which a key word is met; what a longer one has beyond them is looked for in the text
FEW = 200_000  # key words (a hash and a short text each) that are broadcast to the texts; more are met by a shuffle


def _grams(words: Column, gaps_: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words with what stands between them."""
    parts = lambda i: [x for j in range(n) for x in ([F.get(words, i + j)] if j == 0 else [F.get(gaps_, i + j), F.get(words, i + j)])]
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.concat(*parts(i))))


def _wanted(needles: DataFrame, key: str, words: str) -> DataFrame:
    """(_key, k): the key words of each key once, trimmed and in lower case."""
    return needles.select(F.col(key).alias("_key"), F.explode(words).alias("k")).where("k is not null").select("_key", F.trim(F.lower("k")).alias("k")).where("k <> ''").distinct()


def _numbered(k: DataFrame) -> DataFrame:
    """(k, i): the key words with a number each, those of fewer keys first."""
    return cut(k.groupBy("k").agg(F.count("*").alias("n")).orderBy("n", "k").select("k", F.monotonically_increasing_id().alias("i")))


def _found(k: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, ks): the numbers of the key words ``k`` (k, i) that each paper's title or abstract holds, in order.

    Every text gives out its runs of words, with the signs between them, in the lengths
    that key words have, and key words meet the runs that equal them; texts are not
    moved, nor compared with every key word. A key word with signs at its ends, or of more than
    LONGEST words, is then looked for as a whole in the texts that it met. One without
    ASCII letters and digits meets texts by its other letters; one of signs alone meets nothing.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    docs = papers.select("paper_id", text.alias("_t"))
    split = {"_w": F.regexp_extract_all("k", F.lit(WORD), F.lit(0)), "_g": F.split("k", WORD)}
    plain = k.where(F.col("k").rlike("[a-z0-9]")).select("k", "i", *[c.alias(n) for n, c in split.items()]).withColumn("n", F.least(F.size("_w"), F.lit(LONGEST)))
    # Whether the run of words is all of the key word.
    plain = plain.withColumn("all", (F.size("_w") <= LONGEST) & (F.get("_g", F.lit(0)) == "") & (F.element_at("_g", -1) == ""))
    lengths = [r[0] for r in plain.select("n").distinct().orderBy("n").collect()]  # at most LONGEST numbers
    hashed = F.lit(None).cast("array<bigint>")
    for n in lengths:
        hashed = F.when(F.col("n") == n, _grams(F.slice("_w", 1, n), F.col("_g"), n)).otherwise(hashed)
    needle = cut(plain.select("i", "all", F.get(hashed, F.lit(0)).alias("h")))
    foreign = k.where(~F.col("k").rlike("[a-z0-9]")).select("i", F.explode(_foreign(F.col("k"))).alias("w"))
    count, parts = needle.agg(F.count("*"), F.count_if(~F.col("all"))).first()
    runs = docs.select("paper_id", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"), F.split("_t", WORD).alias("_g"))
    grams = F.array_distinct(F.concat(*[_grams(F.col("_w"), F.col("_g"), n) for n in lengths])) if lengths else F.array().cast("array<bigint>")
    each = runs.select("paper_id", F.explode(grams).alias("h"))
    met = each.join(needle.hint("broadcast" if count <= FEW else "merge"), "h").select("paper_id", "i", "all")
    whole = met.where("all").select("paper_id", "i")
    # Texts are read again only where some key word has to be looked for as a whole.
    some = not foreign.isEmpty()
    if parts or some:
        rest = met.where("not all").select("paper_id", "i")
        if some:
            rest = rest.unionByName(docs.select("paper_id", F.explode(_foreign(F.col("_t"))).alias("w")).join(foreign, "w").select("paper_id", "i"))
        rest = rest.distinct().join(k, "i").join(docs, "paper_id").where(_holds(F.col("_t"), F.col("k")))
        whole = whole.unionByName(rest.select("paper_id", "i"))
    return whole.groupBy("paper_id").agg(F.sort_array(F.collect_set("i")).alias("ks"))


def mentions(needles: DataFrame, key: str, words: str, papers: DataFrame) -> DataFrame:
    """(key, paper_id, hits): how many of its key words each paper's title or abstract holds, as whole words or phrases.

    All pairs of a key and a paper, so as many as both make; ``nearest`` has the first of each key only.
    """
    k = cut(_wanted(needles, key, words))
    numbered = _numbered(k)
    found = _found(numbered, papers).select("paper_id", F.explode("ks").alias("i"))
    return k.join(numbered, "k").join(found, "i").groupBy("_key", "paper_id").agg(F.count("*").alias("hits")).withColumnRenamed("_key", key)


MOST_WORDS = 8  # key words of a key, of those that any paper holds, whose subsets are all listed


def nearest(needles: DataFrame, key: str, words: str, papers: DataFrame, most: int, own: str | None = None) -> DataFrame:
    """(key, paper_id, hits): of ``mentions`` the first ``most`` papers of each key by hits, then id, that have two hits or more, or one and its word ``own``.

    Neither all pairs of a key and a paper nor all papers of a pair of words are made. A
    paper is among the first of a key only if it is among the first ``most``, by id, that
    hold all the words which both have, as each of those before it has as many hits. So
    every set of two words or more of a key is listed once, with its first papers, and a
    key's papers are the best of its sets' lists. Papers meet the sets by the two words of
    fewest keys. A key of more than MOST_WORDS words has too many sets: it meets its papers
    word by word.
    """
    k = _wanted(needles, key, words).withColumns({"counts": F.lit(True), "own": F.lit(False)})
    if own:
        k = k.unionByName(needles.select(F.col(key).alias("_key"), F.trim(F.lower(own)).alias("k")).where("k <> ''").distinct().withColumns({"counts": F.lit(False), "own": F.lit(True)}))
    k = cut(k.groupBy("_key", "k").agg(F.max("counts").alias("counts"), F.max("own").alias("own")))
    numbered = _numbered(k)
    found = cut(_found(numbered, papers))
    each = found.select("paper_id", "ks", F.explode("ks").alias("i"))
    held = k.join(numbered, "k").join(each.select("i").distinct(), "i", "left_semi")
    sets = cut(held.groupBy("_key").agg(F.sort_array(F.collect_list(F.when(F.col("counts"), F.col("i")))).alias("ws"), F.sort_array(F.collect_list(F.when(F.col("own"), F.col("i")))).alias("os")))
    short, long = sets.where(F.size("ws") <= MOST_WORDS), sets.where(F.size("ws") > MOST_WORDS)
    empty = F.array().cast("array<bigint>")
    subsets = F.filter(F.aggregate("ws", F.array(empty), lambda done, w: F.concat(done, F.transform(done, lambda s: F.concat(s, F.array(w))))), lambda s: F.size(s) >= 2)
    with_own = F.flatten(F.transform("os", lambda o: F.when(F.array_contains("ws", o), F.array(F.array(o))).otherwise(F.transform("ws", lambda w: F.array(F.least(w, o), F.greatest(w, o))))))
    wanted = short.select("_key", F.explode(subsets).alias("s"), F.size("s").alias("hits")).unionByName(short.select("_key", F.explode(with_own).alias("s"), F.lit(1).alias("hits")))
    heads = cut(wanted.groupBy(F.get("s", F.lit(0)).alias("i"), F.get("s", F.lit(1)).alias("j")).agg(F.collect_set(F.slice("s", F.lit(3), F.size("s"))).alias("tails")))
    hint = "broadcast" if heads.count() <= FEW else "merge"
    ones = each.join(heads.where("j is null").select("i").hint(hint), "i").select("paper_id", F.array("i").alias("s"))
    pairs = each.withColumn("j", F.explode(F.filter("ks", lambda w: w > F.col("i")))).join(heads.where("j is not null").hint(hint), ["i", "j"])
    more = pairs.select("paper_id", "i", "j", F.explode(F.filter("tails", lambda s: F.forall(s, lambda w: F.array_contains("ks", w)))).alias("t")).select("paper_id", F.concat(F.array("i", "j"), "t").alias("s"))
    lists = ones.unionByName(more).withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy("paper_id"))).where(F.col("rn") <= most).drop("rn")
    met = wanted.join(lists, "s").groupBy("_key", "paper_id").agg(F.max("hits").cast("long").alias("hits"))
    if not long.isEmpty():
        words_of = long.select("_key", F.explode("ws").alias("i"), F.lit(1).alias("n"), F.array_contains("os", F.col("i")).cast("int").alias("o")).unionByName(long.select("_key", F.explode(F.array_except("os", "ws")).alias("i"), F.lit(0).alias("n"), F.lit(1).alias("o")))
        all_ = words_of.join(each.select("paper_id", "i"), "i").groupBy("_key", "paper_id").agg(F.sum("n").alias("hits"), F.max("o").alias("o"))
        met = met.unionByName(all_.where("hits >= 2 or (hits = 1 and o = 1)").select("_key", "paper_id", "hits"))
    best = met.withColumn("rn", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("hits"), "paper_id"))).where(F.col("rn") <= most)
    return best.select(F.col("_key").alias(key), "paper_id", "hits")


def support(mentioned: DataFrame, key: str, least: int = 2, most: int = MOST_SUPPORT) -> DataFrame:
    """(key, papers): up to ``most`` papers with at least ``least`` hits, by hits, then id."""
    # Ranked before the shuffle too, so a key word that all papers have brings no more than ``most`` rows from each part.
    w = Window.partitionBy(key).orderBy(F.desc("hits"), "paper_id")
    top = mentioned.where(F.col("hits") >= least).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    ranked = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rn", "paper_id"))).alias("r"))
    return ranked.select(key, F.transform("r", lambda x: x["paper_id"]).alias("papers"))


def scores(p: Column, c: Column, exact: Column, overlap: Column, comp: Column, csp: Column, plan: Column) -> dict[str, Column]:
    """Evidence, novelty and feasibility from counts: supporters, triples, exact, overlapping and composition counter-evidence, plan."""
    counter = exact + overlap + comp
    evidence = F.least(F.lit(1.0), 0.15 * p + 0.10 * c)
    novelty = F.when(exact > 0, F.greatest(F.lit(0.05), 0.2 - 0.05 * exact)).when(counter == 0, F.least(F.lit(0.95), 0.55 + 0.08 * p)).otherwise(F.greatest(F.lit(0.15), 0.65 - 0.08 * overlap - 0.12 * comp))
    feasibility = F.least(F.lit(0.95), F.greatest(F.lit(0.1), 0.3 + F.when(csp, 0.2).otherwise(0.0) + F.when(plan, 0.2).otherwise(0.0) + F.when(counter <= 1, 0.15).otherwise(0.0) - F.when(exact > 0, 0.1).otherwise(0.0)))
    weak = F.when(p < 2, 0.3).otherwise(1.0)
    review = F.when((p >= 3) & (counter == 0) & (c >= 1), "strong").when((p >= 2) & (counter <= 1), "moderate").when((p >= 2) & (counter <= 3), "conditional").otherwise("weak")
    return {"evidence": evidence * weak, "novelty": novelty * weak, "feasibility": feasibility, "review": review}


def counter_evidence(gaps: DataFrame, triples: DataFrame, mentioned: DataFrame, supporting: DataFrame, most: int = MOST_COUNTER) -> DataFrame:
    """(gap_id, paper_id, role): papers that speak against a gap, without its supporters.

    In order: papers whose triple has the very composition and property (all of them),
    papers with two of its key words or more, papers with its composition; of the latter
    two as many as bring the list to ``most``. ``gaps``: gap_id, composition,
    property_name. ``mentioned``: gap_id, paper_id, hits, has_composition. ``supporting``:
    gap_id, paper_id.
    """
    low = lambda c: F.lower(F.col(c))
    known = triples.where("property_value is not null and source_paper_id is not null").select(low("composition").alias("_c"), low("property_name").alias("_p"), F.col("source_paper_id").alias("paper_id")).distinct()
    exact = gaps.select("gap_id", low("composition").alias("_c"), low("property_name").alias("_p")).join(known, ["_c", "_p"]).select("gap_id", "paper_id", F.lit(1).alias("rank"), F.lit(0).alias("less"))
    rest = mentioned.select("gap_id", "paper_id", F.when(F.col("hits") >= 2, 2).when(F.col("has_composition"), 3).alias("rank"), (-F.col("hits")).cast("int").alias("less")).where("rank is not null")
    best = exact.unionByName(rest).join(supporting.select("gap_id", "paper_id"), ["gap_id", "paper_id"], "left_anti").groupBy("gap_id", "paper_id").agg(F.min(F.struct("rank", "less")).alias("r"))
    w = Window.partitionBy("gap_id").orderBy("r", "paper_id")
    kept = best.withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= most) | (F.col("r.rank") == 1))
    return kept.select("gap_id", "paper_id", F.element_at(F.array(F.lit("exact_match"), F.lit("keyword_overlap"), F.lit("composition_covered")), F.col("r.rank")).alias("role"))


def resolve(words: DataFrame, key: str, triples: DataFrame) -> DataFrame:
    """(key, composition, structure, property_name): the first of each, in order, that one of a key's ``words`` names, null if none does.

    ``words``: key, word. A word names a composition or structure that equals it, or a
    property whose words are its own, whatever the case.
    """
    w = words.where("word is not null").select(F.col(key).alias("_key"), F.trim(F.lower("word")).alias("w")).where("w <> ''").distinct()
    out = words.select(F.col(key).alias("_key")).distinct()
    for column in ("composition", "structure", "property_name"):
        names = triples.select(F.col(column).alias("n")).where("n is not null").distinct().select("n", F.replace(F.lower("n"), F.lit("_"), F.lit(" ")).alias("w"))
        out = out.join(w.join(names, "w").groupBy("_key").agg(F.min("n").alias(column)), "_key", "left")
    return out.withColumnRenamed("_key", key)


def context(words: DataFrame, key: str, triples: DataFrame, most: int = MOST_SUPPORT) -> DataFrame:
    """(key, triples): the first ``most`` triples, by id, whose composition or structure is one of a key's ``words`` or whose property contains one as whole words.

    Of each composition, structure and property only the first ``most`` triples can be
    among them, so these are chosen first, before and after the shuffle, and of each word
    likewise before it meets its keys.
    """
    w = words.where("word is not null").select(F.col(key).alias("_key"), F.replace(F.trim(F.lower("word")), F.lit("_"), F.lit(" ")).alias("w")).where("w <> ''").distinct()
    each = w.select("w").distinct()
    fields = ["composition", "structure", "property_name"]
    parts = []
    for column in fields:
        rank = Window.partitionBy(column).orderBy("triple_id")
        firsts = triples.where(F.col(column).isNotNull()).select("triple_id", *fields).withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= most).drop("rn")
        names = firsts.select(F.col(column).alias("n")).distinct().withColumn("t", F.replace(F.lower("n"), F.lit("_"), F.lit(" ")))
        if column == "property_name":
            # Words meet names by their first one and are then looked for as a whole.
            at = names.select("n", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("h"))
            met = each.withColumn("h", F.element_at(F.split("w", " "), 1)).join(at, "h").where(F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "w", F.lit(" "))))
        else:
            met = each.join(names, F.col("w") == F.col("t"))
        parts.append(met.select("w", "n").distinct().join(firsts.withColumn("n", F.col(column)), "n").drop("n"))
    firsts_of = lambda df, k: df.distinct().withColumn("rn", F.row_number().over(Window.partitionBy(k).orderBy("triple_id", *fields))).where(F.col("rn") <= most).drop("rn")
    of_words = firsts_of(parts[0].unionByName(parts[1]).unionByName(parts[2]), "w")
    top = firsts_of(w.join(of_words, "w").drop("w"), "_key")
    return top.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("triple_id", *fields))).alias("triples")).withColumnRenamed("_key", key)


def records(hypotheses: DataFrame, triples: DataFrame, papers: DataFrame) -> DataFrame:
    """Research gaps with their evidence, one row each, best first by rank_score.

    ``hypotheses`` of kinds gap and gap_filling with a statement of ten characters or more
    count: hypothesis_id, hypothesis_type, statement, keywords, paper_a_id, paper_b_id.
    Result: gap_id, gap_type, description, keywords (8), supporting (the two sources, then
    papers that hold two key words, five in all; at least two), counter_evidence (paper
    and role), context (triples), evidence, novelty, feasibility, rank_score, review,
    why_not_known, verification_plan, evidence_chain. Gaps with the same first three key
    words and type are one, with the evidence of all.
    """
    h = hypotheses.where(F.col("hypothesis_type").isin("gap", "gap_filling") & (F.length("statement") >= 10) & F.col("hypothesis_id").isNotNull()).withColumn("keywords", F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull()))
    low = F.lower("statement")
    kind = F.when(F.contains(low, F.lit("structure")) & ~F.contains(low, F.lit("unknown")), "structure_unexplored").when(F.contains(low, F.lit("property")) | F.contains(low, F.lit("performance")), "property_unpredicted").otherwise("csp_missing")
    g = h.select(F.col("hypothesis_id").alias("gap_id"), kind.alias("gap_type"), "statement", "keywords", "paper_a_id", "paper_b_id")
    words = g.select("gap_id", F.posexplode("keywords").alias("i", "word"))
    named = cut(resolve(words.select("gap_id", "word"), "gap_id", triples))
    # Of the first papers five may be supporters; each exact match among them takes a place as well.
    m = cut(nearest(g.join(named.select("gap_id", "composition"), "gap_id", "left"), "gap_id", "keywords", papers, MOST_SUPPORT + MOST_COUNTER, own="composition"))
    sources = g.select("gap_id", F.explode(F.array(F.struct("paper_a_id", F.lit("source_a").alias("role")), F.struct(F.col("paper_b_id").alias("paper_a_id"), F.lit("source_b").alias("role")))).alias("x")).select("gap_id", F.col("x.paper_a_id").alias("paper_id"), "x.role").where("paper_id is not null and paper_id <> ''")
    more = m.where("hits >= 2").join(sources.select("gap_id", "paper_id"), ["gap_id", "paper_id"], "left_anti").select("gap_id", "paper_id", F.lit("word_match").alias("role"), "hits")
    s = sources.withColumn("hits", F.lit(0).cast("long")).unionByName(more).withColumn("rn", F.row_number().over(Window.partitionBy("gap_id").orderBy(F.col("role") == "word_match", "role", F.desc("hits"), "paper_id"))).where(F.col("rn") <= MOST_SUPPORT)
    c = counter_evidence(named, triples, m.withColumn("has_composition", F.col("hits") == 1), s.select("gap_id", "paper_id"))
    ctx = context(words.where("i < 3").select("gap_id", "word"), "gap_id", triples)
    pack = lambda df, name: df.groupBy("gap_id").agg(F.sort_array(F.collect_list(F.struct("role", "paper_id"))).alias(name))
    j = g.join(pack(s, "supporting"), "gap_id").join(pack(c, "counter_evidence"), "gap_id", "left").join(ctx.withColumnRenamed("triples", "context"), "gap_id", "left")
    # One gap for equal first key words and type.
    j = j.withColumn("same", F.concat_ws("|", F.sort_array(F.transform(F.slice("keywords", 1, 3), lambda k: F.lower(k))), F.col("gap_type")))
    merged = j.groupBy("same").agg(F.min_by(F.struct("gap_id", "gap_type", "statement", "keywords", "context"), "gap_id").alias("first"), F.array_distinct(F.flatten(F.collect_list("supporting"))).alias("supporting"), F.array_distinct(F.flatten(F.collect_list("counter_evidence"))).alias("counter_evidence"))
    count = lambda role: F.size(F.filter("counter_evidence", lambda x: x["role"] == role))
    j = merged.select("first.*", F.sort_array("supporting").alias("supporting"), F.sort_array("counter_evidence").alias("counter_evidence")).where(F.size("supporting") >= 2)
    j = j.withColumns({"p": F.size("supporting"), "n": F.size("counter_evidence"), "c": F.coalesce(F.size("context"), F.lit(0)), "x": count("exact_match"), "o": count("keyword_overlap"), "k": count("composition_covered")})
    j = j.withColumn("c", F.greatest("c", F.lit(0))).withColumns(scores(F.col("p"), F.col("c"), F.col("x"), F.col("o"), F.col("k"), F.col("c") > 0, F.lit(True)))
    first = F.get("context", F.lit(0))
    why = F.when(F.col("x") > 0, "a triple of this composition and property is known; the range or the conditions may still be new").when(F.col("n") == 0, "no counter-evidence in the corpus, which proves nothing beyond it; search outside").when(F.col("n") <= 2, F.concat(F.col("n").cast("string"), F.lit(" papers overlap, none with the whole combination; probably new in part"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" papers overlap; close to known work, to be reviewed by hand")))
    plan = F.when(F.col("c") > 0, F.concat(F.lit("compute "), F.coalesce(first["property_name"], F.lit("the property")), F.lit(" of "), F.coalesce(first["composition"], F.lit("the material")), F.lit(" in the predicted structure, compare with the predicted range, measure if nothing is known"))).otherwise("search the literature, then compute the predicted property")
    chain = F.array(F.concat(F.col("p").cast("string"), F.lit(" supporting papers")), F.concat(F.col("c").cast("string"), F.lit(" related triples")), F.concat(F.col("n").cast("string"), F.lit(" papers with overlapping coverage")))
    rank = F.round(0.5 * F.col("novelty") + 0.3 * F.col("evidence") + 0.2 * F.col("feasibility"), 6)
    rounded = {x: F.round(x, 6) for x in ("evidence", "novelty", "feasibility")}
    done = j.withColumns({"rank_score": rank, "why_not_known": why, "verification_plan": plan, "evidence_chain": chain, "keywords": F.slice("keywords", 1, 8), **rounded}).withColumnRenamed("statement", "description")
    return done.drop("p", "n", "c", "x", "o", "k").orderBy(F.desc("rank_score"), "gap_id")


def distinct_gaps(gaps: DataFrame, key: str = "gap_id", description: str = "description", above: float = 0.7, head: int = 50) -> DataFrame:
    """``gaps`` without near-duplicates: in order of ``key`` each is kept whose words (of the first ``head`` characters) are no more alike than ``above``, by Jaccard, to those of any kept before.

    Of gaps with the same words only the first can be kept. Alike gaps meet by an equi-join
    on the rare words that a similarity above the limit forces them to share: up to three
    together, where the limit forces as many and heads are short. The sequential rule is settled in rounds on the cluster: a gap with
    no earlier one alike that is still open is kept, one alike to a kept one goes.
    """
    gaps = cut(gaps)
    w = gaps.select(F.col(key).alias("g"), F.array_distinct(F.filter(F.split(F.lower(F.substring(F.coalesce(description, F.lit("")), 1, head)), r"\s+"), lambda x: x != "")).alias("ws")).where(F.size("ws") > 0)
    same = None
    if above < 1:
        kinds = cut(w.groupBy(F.sort_array("ws").alias("ws")).agg(F.min("g").alias("g")).select("g", "ws"))
        same = w.select("g").join(kinds.select("g"), "g", "left_anti")
        w = kinds
    # Sets of fewer words than ``together`` are alike to equal ones only.
    together = max(n for n in (1, 2, 3) if n == 1 or head <= 60 and above * n > n - 1 + 1e-9)
    each = w.select("g", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    prefix = F.transform(F.slice("o", F.lit(1), F.col("n") - F.ceil(above * F.col("n")).cast("int") + together), lambda x: x["w"])
    runs = F.aggregate(prefix, F.array(F.array().cast("array<string>")), lambda done, x: F.concat(done, F.transform(F.filter(done, lambda s: F.size(s) < together), lambda s: F.concat(s, F.array(x)))))
    first = each.join(df, "w").groupBy("g", "n").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("o")).select("g", "n", F.explode(F.filter(runs, lambda s: F.size(s) == together)).alias("s")).select("g", "n", F.array_join("s", " ").alias("s"))
    met = first.select(F.col("g").alias("a"), F.col("n").alias("na"), "s").join(first.select(F.col("g").alias("b"), F.col("n").alias("nb"), "s"), "s").where("a < b").where(F.least("na", "nb") / F.greatest("na", "nb") > above).select("a", "b").distinct()
    ws = lambda c: w.select(F.col("g").alias(c), F.col("ws").alias(f"w{c}"))
    alike = cut(met.join(ws("a"), "a").join(ws("b"), "b").where(set_jaccard(F.col("wa"), F.col("wb")) > above).select("a", "b"))
    gone = same
    while not alike.isEmpty():
        # Those that no open earlier one is alike to are kept; what is alike to them goes, with its links.
        kept = alike.select(F.col("a").alias("g")).distinct().join(alike.select(F.col("b").alias("g")), "g", "left_anti")
        out = cut(alike.join(kept.withColumnRenamed("g", "a"), "a", "left_semi").select(F.col("b").alias("g")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        alike = cut(alike.join(out.withColumnRenamed("g", "a"), "a", "left_anti").join(out.withColumnRenamed("g", "b"), "b", "left_anti").join(kept.withColumnRenamed("g", "a"), "a", "left_anti"))
    return gaps if gone is None else gaps.join(gone.withColumnRenamed("g", key), key, "left_anti")


def failing_directions(directions: DataFrame, least: int = 3) -> DataFrame:
    """(gap_id, description, keywords) of directions that failed ``least`` times or more and found no support."""
    bad = directions.where((F.col("failures") >= least) & (F.col("support") == 0))
    return bad.select(F.concat(F.lit("gap_"), "direction_id").alias("gap_id"), F.concat(F.lit("trials in the direction '"), "label", F.lit("' failed "), F.col("failures").cast("string"), F.lit(" times; a technical gap may stand behind it")).alias("description"), F.slice("keywords", 1, 5).alias("keywords"))


def simple_report(hypotheses: DataFrame, entries: DataFrame, triples: DataFrame, directions: DataFrame | None = None, *, last: int = 5, most: int = 10) -> DataFrame:
    """(gap_id, description, gap_type, keywords, sources, known_entries, context) of the gaps among the ``last`` hypotheses, then of failing directions, ``most`` in all.

    ``known_entries`` counts entries of knowledge (entry_id, keywords) that have the gap's
    first key word: none means that the gap may well be new. A report, so short.
    """
    h = hypotheses.orderBy(F.desc("created_at"), "hypothesis_id").limit(last).where(F.col("hypothesis_type").isin("gap", "gap_filling"))
    g = h.select("hypothesis_id", F.col("statement").alias("description"), F.col("hypothesis_type").alias("gap_type"), F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 5).alias("keywords"), F.filter(F.array("paper_a_id", "paper_b_id"), lambda p: p.isNotNull()).alias("sources"))
    index = entries.select("entry_id", F.explode("keywords").alias("w")).select("entry_id", F.lower("w").alias("w")).distinct()
    seen = g.select("hypothesis_id", F.lower(F.get("keywords", F.lit(0))).alias("w")).join(index, "w").groupBy("hypothesis_id").agg(F.count("*").alias("known_entries"))
    ctx = context(g.select("hypothesis_id", F.explode(F.slice("keywords", 1, 3)).alias("word")), "hypothesis_id", triples).withColumnRenamed("triples", "context")
    out = g.join(seen, "hypothesis_id", "left").join(ctx, "hypothesis_id", "left").select(F.concat(F.lit("gap_"), "hypothesis_id").alias("gap_id"), "description", "gap_type", "keywords", "sources", F.coalesce("known_entries", F.lit(0)).cast("long").alias("known_entries"), "context")
    if directions is not None:
        more = failing_directions(directions).withColumns({"gap_type": F.lit("trial_failure_cluster"), "sources": F.array().cast("array<string>"), "known_entries": F.lit(0).cast("long")})
        out = out.unionByName(more, allowMissingColumns=True)
    return out.orderBy(F.col("gap_type") == "trial_failure_cluster", "gap_id").limit(most)
