"""What vectors tell about a corpus: tuned clusters and their labels, prototypes and decisions, training batches, recommendations, voids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import vectors as V
from corpusloom.operators.reports import min_max
from corpusloom.scratch import cut_lineage

# Bounds of the tuned similarity, and the floor where there is too little to tune.
LOWEST, HIGHEST, UNTUNED = 0.55, 0.92, 0.75
TUNED_NEIGHBOUR = 3


def tuned(rows: DataFrame, min_size: int = 2) -> tuple[float, int]:
    """(threshold, smallest community) for communities of rows (id, embedding): the upper median of the cosine to the third neighbour, within bounds, and a fifth of the rows."""
    n = rows.count()
    if n < 3:
        return UNTUNED, min_size
    k = min(TUNED_NEIGHBOUR, n - 1)
    kth = V.knn(rows, rows, k).where(F.col("rank") == k).select("score")
    # the score in place n // 2 of the ascending order: counts of the (rounded) values, not a sort of all rows
    counts = kth.groupBy("score").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("score")))  # rounded cosines: at most two million rows
    median = upto.where(F.col("upto") > n // 2).agg(F.min("score").alias("m")).first()["m"]
    return max(LOWEST, min(HIGHEST, median)), max(min_size, n // 5)


# Per kind the smallest community, the most that tuning may ask for, and how many members represent one.
KINDS = {"paper": (2, 20, 5), "claim": (2, 5, 5), "method": (2, 10, 5), "entity": (2, 5, 8)}


def clusters(rows: DataFrame, kind: str, threshold: float | None = None, min_size: int | None = None) -> DataFrame:
    """(community, size, id) of rows (id, embedding), tuned as its kind asks."""
    least, most, _ = KINDS[kind]
    if threshold is None or min_size is None:
        t, m = tuned(rows, least)
        threshold, min_size = threshold if threshold is not None else t, min_size if min_size is not None else max(least, min(m, most))
    return V.communities(V.pairs_above(rows, threshold), rows.select("id"), min_size)


def representatives(rows: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(community, nth, id, score): of each community the n rows nearest its centroid, ties by id."""
    placed = rows.join(members.select("community", "id"), "id")
    near = placed.join(V.centroids(placed, "community"), "community").withColumn("score", F.round(V.dot(V.normalise(F.col("embedding")), F.col("centroid")), 6))
    order = Window.partitionBy("community").orderBy(F.desc("score"), "id")
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).select("community", "nth", "id", "score")


# Words that no label is made of; those of clusters, and those of the axes a corpus starts with.
LABEL_STOP = "the a an and or but of for to from in on at by with as is are was were be been this that these those it its our their we they".split()
AXIS_STOP = (
    "the and for with from that this these those they their have has had was were been being are our use using used one two three also more most some such very can may will would could should "
    "its it's any all non than then only into out about over between among within toward towards here there where which who what how why when etc via per among same show shows found find study studies "
    "paper work approach approaches method methods results using based set data model models task tasks propose proposed novel new first large small high low better well also many few different given "
    "known important specific general"
).split()


def _bigrams(text: Column, stop: list[str], keep: str) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), keep, " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(set(stop))))
    return F.array_compact(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def bigram_labels(texts: DataFrame) -> DataFrame:
    """(community, label): the most frequent bigram of a community's sample texts (community, text), stop words left out first; ties to the smaller, ``unlabelled`` without any."""
    grams = texts.select("community", F.explode(_bigrams(F.col("text"), LABEL_STOP, r"[^a-z0-9\- ]")).alias("g")).groupBy("community", "g").agg(F.count("*").alias("n"))
    best = grams.groupBy("community").agg(F.min_by("g", F.struct(-F.col("n"), F.col("g"))).alias("label"))
    return texts.select("community").distinct().join(best, "community", "left").select("community", F.coalesce("label", F.lit("unlabelled")).alias("label"))


def axis_labels(texts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(community, label): the bigram that most of a community's texts (community, id, text) have for its frequency in corpus (id, text): c / sqrt(df).

    In a community of three and more a bigram has to be in two of its texts; ``cluster`` where none is left.
    """
    of = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct(_bigrams(F.col("text"), AXIS_STOP, r"[^a-z0-9\s-]"))).alias("g"))
    df = of(corpus, "id").groupBy("g").agg(F.count("*").alias("df"))
    sizes = texts.groupBy("community").agg(F.count("*").alias("size"))
    local = of(texts, "community", "id").groupBy("community", "g").agg(F.count("*").alias("c")).join(sizes, "community").where("c >= 2 or size <= 2")
    scored = local.join(df, "g").withColumn("score", F.round(F.col("c") / F.sqrt("df"), 6))
    best = scored.groupBy("community").agg(F.min_by("g", F.struct(-F.col("score"), F.col("g"))).alias("label"))
    return sizes.join(best, "community", "left").select("community", F.coalesce("label", F.lit("cluster")).alias("label"))


def seeded_axis(texts: DataFrame, rows: DataFrame, most: int, sample: int = 400) -> DataFrame:
    """(label, size): axis values for a corpus that has none, from communities of up to ``sample`` texts (id, text) with vectors (id, embedding); the largest ``most``.

    The sample is the feature: labels are for a person to correct. Fewer than four texts are a community each.
    """
    some = cut_lineage(texts.where(F.length("text") > 80).orderBy("id").limit(sample), "seed")
    near = rows.join(some.select("id"), "id", "left_semi")
    if some.count() < 4:
        members = some.select((F.row_number().over(Window.orderBy("id")) - 1).alias("community"), F.lit(1).alias("size"), "id")  # at most three rows
    else:
        members = V.communities(V.pairs_above(near, (t := tuned(near))[0]), near.select("id"), t[1])
    placed = cut_lineage(members.join(some, "id"), "seed")
    labels = axis_labels(placed.select("community", "id", "text"), some)
    return labels.join(members.select("community", "size").distinct(), "community").orderBy(F.desc("size"), "community").limit(most).select("label", "size")


def longest_methods(chunks: DataFrame, labels: tuple[str, ...] = ("methods", "experimental_setup", "abstract")) -> DataFrame:
    """(paper_id, text): each paper's longest chunk (paper_id, chunk_idx, label, text) of those sections or without a label; ties to the first."""
    may = chunks.where(F.col("label").isin(*labels) | F.col("label").isNull())
    order = Window.partitionBy("paper_id").orderBy(F.desc(F.length("text")), "chunk_idx")
    return may.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("paper_id", "text")


def distributions(members: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """(community, column…): for each community a map from value to its number among members (id); nulls and blanks do not count."""
    placed = members.select("community", "id").join(facts, "id")
    out = members.select("community").distinct()
    for c in columns:
        counts = placed.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy("community", c).agg(F.count("*").alias("n"))
        out = out.join(counts.groupBy("community").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(c).alias("k"), "n")))).alias(c)), "community", "left")
    return out


def sub_prototypes(rows: DataFrame, fewest: int = 6) -> DataFrame:
    """(id, size, embedding): centroids of the communities of labelled rows, and the rows in none as they are; below ``fewest`` rows all stand for themselves."""
    if rows.count() < fewest:
        return rows.select("id", F.lit(1).alias("size"), V.normalise(F.col("embedding")).alias("embedding"))
    threshold, least = tuned(rows)
    members = cut_lineage(V.communities(V.pairs_above(rows, threshold), rows.select("id"), least), "prototypes")
    placed = rows.join(members, "id")
    first = members.groupBy("community").agg(F.min("id").alias("id"), F.first("size").alias("size"))
    grouped = V.centroids(placed, "community").join(first, "community").select("id", "size", F.col("centroid").alias("embedding"))
    alone = rows.join(members, "id", "left_anti").select("id", F.lit(1).alias("size"), V.normalise(F.col("embedding")).alias("embedding"))
    return grouped.union(alone)


def side_scores(rows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, include, exclude): each row's best cosine to a prototype (side, embedding) of either side, in blocks, so prototypes may be many."""
    out = rows.select("id")
    for side in ("include", "exclude"):
        p = prototypes.where(F.col("side") == side).select((-1 - F.monotonically_increasing_id()).alias("id"), "embedding")
        best = V.knn(rows.select("id", "embedding"), p, 1).select(F.col("query_id").alias("id"), F.col("score").alias(side))
        out = out.join(best, "id", "left")
    return out


def proposed_decisions(scores: DataFrame, margin: float = 0.10, floor: float = 0.65) -> DataFrame:
    """scores (id, include, exclude) with ``decision``, most decided first: the better side by more than the margin and above the floor; else borderline."""
    gap = F.round(F.col("include") - F.col("exclude"), 6)
    label = F.when((gap > margin) & (F.col("include") > floor), "include").when((-gap > margin) & (F.col("exclude") > floor), "exclude").otherwise("borderline")
    return scores.withColumn("margin", gap).withColumn("decision", label).orderBy(F.desc(F.abs("margin")), "id")


def remaining_decisions(scores: DataFrame) -> DataFrame:
    """scores with ``decision``: the closer side, or maybe where both are alike. Rows that lack a side have none."""
    return scores.where("include is not null and exclude is not null").withColumn("decision", F.when(F.col("include") > F.col("exclude"), "include").when(F.col("exclude") > F.col("include"), "exclude").otherwise("maybe"))


def missed_includes(scores: DataFrame, labels: DataFrame, least: float = 0.6, limit: int = 20) -> DataFrame:
    """Rows labelled exclude that are like the included ones."""
    return scores.join(labels.where("label = 'exclude'").select("id"), "id", "left_semi").where(F.col("include") >= least).orderBy(F.desc("include"), "id").limit(limit)


def training_state(labels: DataFrame, fewest: int = 10) -> DataFrame:
    """(decided, include, exclude, maybe, pending, unlocked) of all rows (id, label): sorting by prototypes is unlocked once both sides are there and enough is decided."""
    n = lambda s: F.count_if(F.coalesce("label", F.lit("")) == s)
    counts = labels.agg(n("include").alias("include"), n("exclude").alias("exclude"), n("maybe").alias("maybe"), n("").alias("pending"))
    decided = F.col("include") + F.col("exclude") + F.col("maybe")
    return counts.select(decided.alias("decided"), "include", "exclude", "maybe", "pending", ((F.col("include") > 0) & (F.col("exclude") > 0) & (decided >= fewest)).alias("unlocked"))


def training_batch(rows: DataFrame, members: DataFrame, pending: DataFrame, n: int, least: float, most: int = 8) -> DataFrame:
    """(nth, centre, id): what a person is asked next, n centres, each with the pending rows its answer would be passed on to.

    Communities (community, id) come by number; a community's centre is its first pending row (id), and up to ``most`` rows with it that are at least
    ``least`` similar are passed on to, earlier ones first. If there are fewer communities than n, pending rows in none stand alone. Communities do not overlap, so each is decided by itself.
    """
    p = cut_lineage(pending.select("id").distinct(), "pending")
    inside = members.select("community", "id").join(p, "id").join(rows.select("id", V.normalise(F.col("embedding")).alias("v")), "id")
    centre = inside.groupBy("community").agg(F.min_by(F.struct(F.col("id").alias("centre"), F.col("v").alias("c")), "id").alias("x")).select("community", "x.*")
    near = inside.join(centre, "community").withColumn("similar", F.round(V.dot(F.col("v"), F.col("c")), 6))
    kept = near.where((F.col("id") == F.col("centre")) | (F.col("similar") >= least)).withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where(F.col("k") <= most)
    numbered = centre.select("centre", F.row_number().over(Window.orderBy("community")).alias("nth")).where(F.col("nth") <= n)  # a row for each community
    asked = cut_lineage(kept.select("centre", "id").join(numbered, "centre").select("nth", "centre", "id"), "batch")
    n_asked = asked.agg(F.max("nth").alias("m")).first()["m"] or 0
    rest = p.join(asked.select("id"), "id", "left_anti").orderBy("id").limit(max(0, n - n_asked))
    alone = rest.select((F.row_number().over(Window.orderBy("id")) + n_asked).alias("nth"), F.col("id").alias("centre"), "id")  # at most n rows
    return asked.union(alone)


def training_step(labels: DataFrame, decisions: DataFrame, batch: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, label, how) after a person's decisions (id, label) on a batch: given ones stand, then they are passed on to unlabelled rows, then, if unlocked, sure proposals are taken over."""
    given = decisions.where(F.col("label").isin("include", "exclude", "maybe")).select("id", "label")
    blank = F.coalesce("label", F.lit("")) == ""
    passed = batch.where("id <> centre").join(given.withColumnRenamed("id", "centre"), "centre").select("id", "label")
    now = labels.select("id", "label").join(given.toDF("id", "given"), "id", "left").join(passed.toDF("id", "passed"), "id", "left")
    how = F.when(F.col("given").isNotNull(), "decided").when(blank & F.col("passed").isNotNull(), "passed on").when(~blank, "before")
    now = cut_lineage(now.select("id", F.coalesce("given", F.when(~blank, F.col("label")), "passed").alias("label"), how.alias("how")), "step")
    if not training_state(now).first()["unlocked"]:
        return now
    sure = proposed_decisions(scores).where("decision <> 'borderline'").select("id", "decision")
    return now.join(sure, "id", "left").select("id", F.coalesce("label", "decision").alias("label"), F.coalesce("how", F.when(F.col("decision").isNotNull(), "proposed")).alias("how"))


def cosine_profile(rows: DataFrame, n_pairs: int = 5000, seed: int = 42) -> DataFrame:
    """(a, b, score): cosines of a seeded sample of pairs, for percentiles and a histogram.

    Row a is drawn with row b = the row whose hash follows that of (a, draw); the sample is the feature.
    """
    r = rows.select("id", V.normalise(F.col("embedding")).alias("v")).where("v is not null")
    n = max(2, r.count())
    share = min(1.0, (n_pairs / n) ** 0.5 * 2)
    kept = cut_lineage(r.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))), "profile")
    turns = max(1, -(-n_pairs // max(1, kept.count())))
    nth = lambda salt: F.row_number().over(Window.orderBy(F.xxhash64("id", salt), "id"))  # noqa: E731  a few thousand rows by the share above
    left = kept.select(F.col("id").alias("a"), F.col("v").alias("x"), nth(F.lit(seed)).alias("k"))
    parts = [left.join(kept.select(F.col("id").alias("b"), F.col("v").alias("y"), nth(F.lit(seed + t)).alias("k")), "k") for t in range(1, turns + 1)]
    pairs = parts[0]
    for more in parts[1:]:
        pairs = pairs.union(more)
    one = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(V.dot(F.col("x"), F.col("y")), 6).alias("score")).distinct()
    return one.orderBy(F.xxhash64("a", "b")).limit(n_pairs)


def recommend(claims: DataFrame, cites: DataFrame, papers: DataFrame, shortlist: DataFrame, alpha: float = 0.6, beta: float = 0.4, per_claim: int = 5, limit: int = 20) -> DataFrame:
    """(paper_id, score, claim_similarity, citation_pull): papers of the corpus like the shortlist's claims, or cited by it.

    claims (claim_id, paper_id, embedding): each claim of the shortlist adds its positive cosines to the ``per_claim`` nearest claims of other papers. cites (src, dst). Both signals
    are brought to 0 to 1 over all papers with that signal before they are mixed; papers outside the corpus are then left out.
    """
    short = shortlist.select("paper_id").distinct()
    rows = claims.select(F.col("claim_id").alias("id"), "paper_id", "embedding")
    mine, others = rows.join(short, "paper_id", "left_semi"), rows.join(short, "paper_id", "left_anti")
    near = V.knn(mine.select("id", "embedding"), others.select("id", "embedding"), per_claim).where("score > 0")
    pull = near.join(others.select("id", "paper_id"), "id").groupBy("paper_id").agg(F.sum("score").alias("raw"))
    cited = cites.join(short.withColumnRenamed("paper_id", "src"), "src", "left_semi").join(short.withColumnRenamed("paper_id", "dst"), "dst", "left_anti").groupBy(F.col("dst").alias("paper_id")).agg(F.count("*").cast("double").alias("raw"))
    a = min_max(pull, "raw").select("paper_id", F.col("scaled").alias("s"))
    b = min_max(cited, "raw").select("paper_id", F.col("scaled").alias("c"))
    both = a.join(b, "paper_id", "full").join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    s, c = F.coalesce("s", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    scored = both.select("paper_id", F.round(alpha * s + beta * c, 4).alias("score"), F.round(s, 4).alias("claim_similarity"), F.round(c, 4).alias("citation_pull"))
    return scored.orderBy(F.desc("score"), "paper_id").limit(limit)


def drift(queries: DataFrame, topic: DataFrame) -> DataFrame:
    """(query_id, score): each query's cosine to the one topic vector; low ones have drifted."""
    t = topic.select(V.normalise(F.col("embedding")).alias("t")).limit(1)
    return queries.crossJoin(F.broadcast(t)).select(F.col("id").alias("query_id"), F.round(V.dot(V.normalise(F.col("embedding")), F.col("t")), 6).alias("score"))  # one row


def search(queries: DataFrame, corpus: DataFrame, k: int, keep: Column | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The k nearest rows of those that pass a filter and are not among the excluded ids."""
    some = corpus if keep is None else corpus.where(keep)
    return V.knn(queries, some if exclude is None else some.join(exclude.select("id"), "id", "left_anti"), k)


def density_voids(probes: DataFrame, corpus: DataFrame, k: int = 5, limit: int = 20) -> DataFrame:
    """(id, void, neighbours): how far the corpus is from each probe, 1 - the best cosine, and its k nearest, emptiest first."""
    near = V.knn(probes, corpus, k)
    per = near.groupBy("query_id").agg(F.round(1 - F.max("score"), 6).alias("void"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("neighbours"))
    return per.orderBy(F.desc("void"), "query_id").limit(limit).select(F.col("query_id").alias("id"), "void", "neighbours")


def contradictions(rows: DataFrame, least: float = 0.75, limit: int = 30) -> DataFrame:
    """(a, b, score): pairs of notes of different papers (id, paper_id, embedding) so alike that their disagreement would matter."""
    pairs = V.pairs_above(rows.select("id", "embedding"), least)
    p = rows.select("id", "paper_id")
    named = pairs.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b").where("pa <> pb")
    return named.select("a", "b", "score").orderBy(F.desc("score"), "a", "b").limit(limit)


def themes(rows: DataFrame, threshold: float, min_size: int = 2) -> DataFrame:
    """(theme, size, n_papers, central, ids): communities of statements (id, paper_id, embedding), then those in none by themselves; ``central`` is the statement nearest the centroid."""
    members = cut_lineage(V.communities(V.pairs_above(rows.select("id", "embedding"), threshold), rows.select("id"), min_size), "themes")
    central = representatives(rows, members, 1).select("community", F.col("id").alias("central"))
    grouped = members.join(rows.select("id", "paper_id"), "id").groupBy("community").agg(F.count("*").alias("size"), F.count_distinct("paper_id").alias("n_papers"), F.array_sort(F.collect_list("id")).alias("ids"))
    grouped = grouped.join(central, "community").select(F.concat(F.lit("c"), F.col("community").cast("string")).alias("theme"), "size", "n_papers", "central", "ids")
    alone = rows.join(members, "id", "left_anti").select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("theme"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("n_papers"), F.col("id").alias("central"), F.array("id").alias("ids"))
    return grouped.union(alone)


def external_gaps(corpus: DataFrame, external: DataFrame, threshold: float, min_size: int, fewest_external: int = 3, most_corpus: int = 1) -> DataFrame:
    """(community, size, n_external, n_corpus): communities of both together that the corpus hardly reaches; ids of the two are told apart by sign."""
    both = corpus.select("id", "embedding").union(external.select((-1 - F.col("id")).alias("id"), "embedding"))
    members = V.communities(V.pairs_above(both, threshold), both.select("id"), min_size)
    per = members.groupBy("community").agg(F.count("*").alias("size"), F.count_if(F.col("id") < 0).alias("n_external"), F.count_if(F.col("id") >= 0).alias("n_corpus"))
    return per.where((F.col("n_external") >= fewest_external) & (F.col("n_corpus") <= most_corpus)).orderBy(F.desc("n_external"), "community")


def claim_clusters(claims: DataFrame, fields: DataFrame, categories: DataFrame, names: tuple[str, ...], threshold: float | None = None, min_size: int | None = None, most: int = 50) -> DataFrame:
    """(community, size, claim_id, paper_id, stance, claim_type, <names>, categories): members of the largest communities of claims with their papers' fields and categories; the rest with a null community.

    fields (paper_id, field_name, field_value), of which ``names`` become columns.
    """
    rows = claims.select(F.col("claim_id").alias("id"), "embedding")
    if threshold is None or min_size is None:
        t, m = tuned(rows)
        threshold, min_size = threshold if threshold is not None else t, min_size if min_size is not None else m
    members = V.communities(V.pairs_above(rows, threshold), rows.select("id"), min_size).where(F.col("community") < most)
    wide = fields.groupBy("paper_id").agg(*[F.max(F.when(F.col("field_name") == n, F.col("field_value"))).alias(n) for n in names])
    cats = categories.groupBy("paper_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    out = claims.join(members.withColumnRenamed("id", "claim_id"), "claim_id", "left").join(wide, "paper_id", "left").join(cats, "paper_id", "left")
    return out.select("community", "size", "claim_id", "paper_id", "stance", "claim_type", *names, F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def grounded_passages(passages: DataFrame, chunks: DataFrame, least: float = 0.30) -> DataFrame:
    """(id, chunk_id, page, score): for each passage (id, embedding) the chunk (id, page, embedding) that supports it best, if well enough."""
    near = V.knn(passages, chunks.select("id", "embedding"), 1, least)
    return near.join(chunks.select("id", "page"), "id").select(F.col("query_id").alias("id"), F.col("id").alias("chunk_id"), "page", "score")


def field_bundles(fields: DataFrame, chunks: DataFrame, k: int = 6, characters: int = 3000) -> DataFrame:
    """(field, text, chunk_ids): for each field's question (id, field, embedding) its k best chunks (id, text, embedding) in order, until the characters are used up; the last is cut."""
    near = V.knn(fields.select("id", "embedding"), chunks.select("id", "embedding"), k).join(chunks.select("id", "text"), "id").join(fields.select(F.col("id").alias("query_id"), "field"), "query_id")
    order = Window.partitionBy("field").orderBy("rank")
    used = near.withColumn("before", F.sum(F.length("text")).over(order) - F.length("text")).where(F.col("before") < characters)
    cut = used.withColumn("part", F.expr(f"substring(text, 1, cast({characters} - before as int))"))
    per = cut.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("rank", "part", "id"))).alias("p"))
    return per.select("field", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"), F.transform("p", lambda x: x["id"]).alias("chunk_ids"))
