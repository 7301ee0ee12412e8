"""Mixing sources to target weights, in DataFrame operations only.

Documents are cut into blocks of words. Each source's quota of words is exact:
whole passes over its blocks, then a last pass over the first blocks of a
pseudo-random permutation, the last of them cut short. A splitting tree deals
the quotas to output shards: a node halves its shards, and draws the left
half's number of blocks of each source from the multivariate hypergeometric
distribution, as if all drawn blocks were shuffled. Down to single shards this
gives, for each source, disjoint ranges of its permuted draws. Inside a shard
rows are shuffled by ``local_order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import materialize, word_count

#: No document and no source is taken more often than this.
MOST = 3
#: Hex digits of the permutation key that cut a source into buckets; ranks are summed over buckets, so no task sorts a whole source.
BUCKET_DIGITS = 3
#: A hypergeometric draw with a larger deviation is taken from the normal distribution, rounded.
EXACT_SIGMA = 64
MAX_SHARDS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, idx, weight, source_size, target, quota, passes, rest) from rows of (source, size).

    Sources by code point, null last, get the weights in turn. Targets share the
    sum of all sizes by weight and stop at MOST times the source's size; the
    excess is reshared by weight until none is above: in the order of size over
    weight, the first j sources are held at their cap for the smallest j at which
    the share of the others fits them all.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("idx", (F.row_number().over(by_name) - 1).cast("int")).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("idx") % len(weights)) + 1).cast("long")
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    fitted = (
        ranked.withColumn("t", F.sum("source_size").over(everything))
        .withColumn("w", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)))
        .withColumn("held", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("share", (F.col("t") - MOST * F.col("capped")).cast("double") / (F.col("w") - F.col("held")).cast("double"))
        .withColumn("fits", F.col("share") * F.col("weight") <= MOST * F.col("source_size"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("idx"), F.col("share")))).over(everything)["share"])
    )
    cap = (MOST * F.col("source_size")).cast("double")
    return (
        fitted.withColumn("target", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)))
        .withColumn("quota", F.least(F.round("target").cast("long"), MOST * F.col("source_size")))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
        .select("source", "idx", "weight", "source_size", "target", "quota", "passes", "rest")
    )


def _uniform(*parts: str) -> str:
    """SQL for a pseudo-random number in (0, 1) that depends on parts only."""
    return f"((pmod(xxhash64({', '.join(parts)}), 9007199254740992L) + 0.5D) / 9007199254740992D)"


def hypergeometric(good: str, bad: str, draws: str, *salt: str) -> str:
    """SQL for a hypergeometric draw: good balls among ``draws`` taken from good + bad.

    By inversion of the distribution within 8 deviations of its mean; where the
    deviation is above EXACT_SIGMA, a rounded normal. Always within the possible range.
    """
    n = f"({good} + {bad})"
    mean = f"({draws} * ({good} / {n}))"
    sigma = f"sqrt(greatest(0D, {draws} * ({good} / {n}) * ({bad} / {n}) * (({n} - {draws}) / greatest(1, {n} - 1))))"
    least, most = f"greatest(0L, {draws} - {bad})", f"least({good}, {draws})"
    lo = f"greatest({least}, cast(floor({mean} - 8 * {sigma}) as bigint) - 1)"
    hi = f"least({most}, cast(ceil({mean} + 8 * {sigma}) as bigint) + 1)"
    normal = f"least({most}, greatest({least}, cast(round({mean} + {sigma} * sqrt(-2 * ln({_uniform("'r'", *salt)})) * cos(2 * pi() * {_uniform("'a'", *salt)})) as bigint)))"
    # logs of the probabilities of lo, lo + 1, ... against that of lo, by the ratio of neighbours
    logs = f"""aggregate(sequence({lo}, {hi}), cast(array() as array<double>), (hl, hx) ->
        if(size(hl) = 0, array(0D), concat(hl, array(element_at(hl, -1) + ln(cast({good} - hx + 1 as double)) + ln(cast({draws} - hx + 1 as double)) - ln(cast(hx as double)) - ln(cast({bad} - {draws} + hx as double))))))"""
    picked = f"""aggregate(array({logs}), 0L, (h0, hlogs) -> aggregate(array(transform(hlogs, hy -> exp(hy - array_max(hlogs)))), 0L, (h1, hp) ->
        {lo} + aggregate(hp, named_struct('left', {_uniform("'u'", *salt)} * aggregate(hp, 0D, (hs, hz) -> hs + hz), 'at', 0L),
            (hs, hz) -> named_struct('left', hs.left - hz, 'at', if(hs.left - hz > 0, hs.at + 1, hs.at)), hs -> least(hs.at, {hi} - {lo}))))"""
    return f"case when {n} <= 0 or {draws} <= 0 or {good} <= 0 then 0L when {lo} >= {hi} then {lo} when {sigma} > {EXACT_SIGMA} then {normal} else {picked} end"


def splitting_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(idx, shard, lo, hi): the range of each source's draws that goes to a shard, from rows of (idx, blocks)."""
    if not 1 <= n_shards <= MAX_SHARDS:
        raise ValueError(f"n_shards must be 1 to {MAX_SHARDS}")
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "blocks"))), lambda s: s["blocks"]).alias("q")).selectExpr("0 as first", f"{n_shards} as n", "q")
    one = hypergeometric("x", "(s.pool - x)", "s.draws", str(seed), "first", "n", "size(s.out)")
    left = f"""aggregate(q, named_struct('pool', aggregate(q, 0L, (a, b) -> a + b), 'draws', cast(floor(aggregate(q, 0L, (a, b) -> a + b) * ((n div 2) / n)) as bigint), 'out', cast(array() as array<bigint>)),
        (s, x) -> aggregate(array({one}), s, (t, d) -> named_struct('pool', t.pool - x, 'draws', t.draws - d, 'out', concat(t.out, array(d)))), s -> s.out)"""
    for _ in range((n_shards - 1).bit_length()):
        nodes = nodes.withColumn("half", F.expr(f"if(n > 1, {left}, q)")).selectExpr(
            """explode(if(n > 1, array(named_struct('first', first, 'n', cast(n div 2 as int), 'q', half),
                named_struct('first', cast(first + n div 2 as int), 'n', cast(n - n div 2 as int), 'q', zip_with(q, half, (a, b) -> a - b))),
                array(named_struct('first', first, 'n', n, 'q', q)))) as node"""
        ).select("node.*")
    upto = Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    dealt = nodes.select(F.col("first").alias("shard"), F.posexplode("q").alias("idx", "blocks"))
    return dealt.withColumn("hi", F.sum("blocks").over(upto)).select("idx", "shard", (F.col("hi") - F.col("blocks")).alias("lo"), "hi")


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark, nth): a key for each row; nth tells apart rows of equal id, source and text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")
    )
    return rows.withColumn("nth", (F.row_number().over(Window.partitionBy("doc_id", "source", "mark").orderBy("size")) - 1).cast("int"))


def permutation_key(seed: int) -> Column:
    """Orders a source's blocks; md5, so that any engine can repeat it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("block").cast("string")).cast("binary"))


def mix_plan(rows: DataFrame, n_shards: int = 16, block_words: int = 512, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix's draws: doc_id, source, mark, nth, block, pass, words, shard, local_order.

    rows: from :func:`document_rows`. Each draw is the first ``words`` words of a
    block of ``block_words`` words of a document. ``words`` add up to each source's
    rounded target. Documents without words are in no draw.
    """
    targets = materialize(source_targets(rows, weights), "mix-targets")
    key = [F.col(c) for c in ("doc_id", "source", "mark", "nth")]
    blocks = (
        rows.where("size > 0")
        .select(*key, "size", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {block_words} as int)"))).alias("block"))
        .select(*key, "block", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("len"))
        .withColumn("key", permutation_key(seed))
        .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    )
    bucket = Window.partitionBy("source", "bucket")
    inside = bucket.orderBy("key", "doc_id", "block", "len", "mark", "nth").rowsBetween(Window.unboundedPreceding, -1)
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = materialize(
        blocks.withColumn("before", F.coalesce(F.sum("len").over(inside), F.lit(0)))
        .withColumn("rank", F.count("*").over(inside))
        .withColumn("first", F.col("rank") == 0)
        .withColumn("b_words", F.sum("len").over(whole))
        .withColumn("b_blocks", F.count("*").over(whole)),
        "mix-blocks",
    )
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.where("first").select(
        "source", "bucket", F.coalesce(F.sum("b_words").over(earlier), F.lit(0)).alias("w_off"), F.coalesce(F.sum("b_blocks").over(earlier), F.lit(0)).alias("r_off")
    )
    at = ranked.alias("a").join(offsets.alias("o"), F.col("a.source").eqNullSafe(F.col("o.source")) & (F.col("a.bucket") == F.col("o.bucket")))
    placed = at.select("a.doc_id", "a.source", "a.mark", "a.nth", "a.block", "a.len", (F.col("a.before") + F.col("o.w_off")).alias("before"), (F.col("a.rank") + F.col("o.r_off")).alias("rank"))
    t = targets.alias("t")
    sized = placed.alias("p").join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "t.idx", "t.passes", F.greatest(F.lit(0), F.least(F.col("p.len"), F.col("t.rest") - F.col("p.before"))).alias("last"))
    sized = materialize(sized, "mix-placed")
    quotas = sized.groupBy("idx").agg(F.count("*").alias("n"), F.sum(F.col("passes") + (F.col("last") > 0).cast("long")).alias("blocks"))
    ranges = splitting_tree(quotas, n_shards, seed).groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "hi"))), lambda s: s["hi"]).alias("ends"))
    dealt = materialize(quotas.join(ranges, "idx"), "mix-quotas")
    draws = (
        sized.join(dealt, "idx")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"))
        .withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("len")).otherwise(F.col("last")))
        .withColumn("draw", F.col("pass") * F.col("n") + F.col("rank"))
    )
    shard = F.size(F.filter("ends", lambda e: e <= F.col("draw")))
    return (
        draws.where("words > 0 and draw < blocks")
        .withColumn("shard", shard)
        .withColumn("local_order", F.xxhash64(F.lit(seed), "idx", "draw"))
        .select("doc_id", "source", "mark", "nth", "block", "pass", "words", "shard", "local_order")
    )


def mix_sources(docs: DataFrame, n_shards: int = 16, block_words: int = 512, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """What the mix takes of each document.

    Returns one row per input row: doc_id, source, mark, nth, size, source_size,
    target, taken, shards (the words that each shard's draws have of it; null where none is taken). A null source is a source of its own, after the others. Null
    and wordless texts have size 0 and are never taken. Repeated rows are
    documents of their own. An empty table gives an empty result.
    """
    rows = materialize(document_rows(docs), "mix-rows")
    targets = source_targets(rows, weights)
    dealt = mix_plan(rows, n_shards, block_words, seed, weights).groupBy("doc_id", "source", "mark", "nth", "shard").agg(F.sum("words").alias("words"))
    taken = dealt.groupBy("doc_id", "source", "mark", "nth").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shards"))  # at most n_shards
    r, k, t = rows.alias("r"), taken.alias("k"), targets.alias("t")
    same = F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.mark") == F.col("k.mark")) & (F.col("r.nth") == F.col("k.nth"))
    joined = r.join(k, same, "left").join(t, F.col("r.source").eqNullSafe(F.col("t.source")))
    return joined.select("r.*", "t.source_size", "t.target", F.coalesce("k.taken", F.lit(0).cast("long")).alias("taken"), "k.shards")


def mixed_documents(docs: DataFrame, n_shards: int = 16, block_words: int = 512, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix as documents: a row for each document and pass that it is drawn in.

    Keeps doc_id, text, lang, source, n_chars. A document drawn whole keeps its text as
    it is; of one drawn in part the text is the drawn words, joined by single
    spaces. Rows are dealt to ``shard`` in the order ``local_order``.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang"), F.col("source").cast("string").alias("source"))
    rows = materialize(document_rows(docs), "mix-rows")
    drawn = mix_plan(rows, n_shards, block_words, seed, weights).groupBy("doc_id", "source", "mark", "nth", "pass").agg(
        F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("block", "words"))).alias("blocks"), F.min_by("shard", "block").alias("shard"), F.min("local_order").alias("local_order")
    )
    texts = base.withColumn("mark", F.xxhash64("text")).withColumn("nth", (F.row_number().over(Window.partitionBy("doc_id", "source", "mark").orderBy(F.lit(0))) - 1).cast("int"))
    b, d = texts.alias("b"), drawn.alias("d")
    same = F.col("b.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("b.source").eqNullSafe(F.col("d.source")) & (F.col("b.mark") == F.col("d.mark")) & (F.col("b.nth") == F.col("d.nth"))
    joined = b.join(d, same)
    words = F.regexp_extract_all(F.col("b.text"), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("d.blocks", lambda s: F.slice(words, s["block"] * block_words + 1, s["words"].cast("int")))), " ")
    whole = word_count(F.col("b.text")) == F.col("d.words")
    out = joined.select("b.doc_id", F.when(whole, F.col("b.text")).otherwise(part).alias("text"), "b.lang", "b.source", "d.shard", "d.local_order")
    return out.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars", "shard", "local_order")
