"""From model scores to facts: rules over score tables. Models stay outside; each rule takes their scores as rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Floors and margins of the rules.
SIGNAL_COSINE, SIGNAL_SUPPORT = 0.72, 0.30
CATEGORY_COSINE, CATEGORY_MOST = 0.50, 3
FAMILY_COSINE, FAMILY_MARGIN = 0.55, 0.05
RELEVANCE_CORE, RELEVANCE_IMPORTANT = 0.55, 0.40
TYPE_COSINE, TYPE_MOST, TYPE_ENTAIL, TYPE_MARGIN = 0.40, 3, 0.45, 0.05
CONTEXT_ACCEPT = 0.40
#: (least score, least margin) of each zero-shot field.
FIELD_RULES = {"methodology_type": (0.18, 0.03), "system_domain": (0.18, 0.02), "sample_type": (0.22, 0.02)}


def _ranked(scores: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), label)
    return scores.withColumn("nth", F.row_number().over(order))


def _top_two(scores: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Each group's best label and score, and its margin before the second (the score itself where there is none)."""
    two = _ranked(scores, by, score, label).where("nth <= 2").groupBy(*by).agg(
        F.max(F.when(F.col("nth") == 1, F.col(label))).alias("top"), F.max(F.when(F.col("nth") == 1, F.col(score))).alias("score"), F.max(F.when(F.col("nth") == 2, F.col(score))).alias("second")
    )
    return two.withColumn("margin", F.round(F.col("score") - F.coalesce("second", F.lit(0.0)), 9)).drop("second")


def bool_signals(scored: DataFrame, links: DataFrame, floor: float = SIGNAL_COSINE, least: float = SIGNAL_SUPPORT) -> DataFrame:
    """(paper_id, signal, value, support, sentence_idx, mechanism): confirmed, refuted or unknown for each paper and signal.

    scored (paper_id, signal, sentence_idx, cosine, and entail and contradict for the claim, _pos, and its opposite, _neg). Support is what speaks for
    the claim less what speaks against it. The sentence of the strongest support either way decides, if that is enough. A matching
    address (links: paper_id, signal) confirms by itself.
    """
    near = scored.where(F.col("cosine") >= floor).withColumn("support", F.round(F.col("entail_pos") + F.col("contradict_neg") - F.col("entail_neg") - F.col("contradict_pos"), 9))
    best = near.groupBy("paper_id", "signal").agg(F.min_by(F.struct("support", "sentence_idx"), F.struct(-F.abs("support"), F.col("sentence_idx"))).alias("b"))
    every = scored.select("paper_id", "signal").union(links.select("paper_id", "signal")).distinct()
    out = every.join(best, ["paper_id", "signal"], "left").join(links.select("paper_id", "signal").distinct().withColumn("link", F.lit(True)), ["paper_id", "signal"], "left")
    s = F.col("b.support")
    value = F.when(F.col("link"), "confirmed").when(F.abs(s) < least, "unknown").when(s > 0, "confirmed").when(s < 0, "refuted").otherwise("unknown")
    how = F.when(F.col("link"), "url_match").when(s.isNull(), "unknown:no_cosine_candidate_above_floor").when(F.abs(s) < least, "unknown:support_below_floor").otherwise("cosine+nli")
    return out.select("paper_id", "signal", value.alias("value"), F.when(F.col("link").isNull(), s).alias("support"), F.when(F.col("link").isNull(), F.col("b.sentence_idx")).alias("sentence_idx"), how.alias("mechanism"))


def zero_shot_fields(scores: DataFrame, rules: dict[str, tuple[float, float]] = FIELD_RULES) -> DataFrame:
    """(paper_id, field, value, score, margin) of scores (paper_id, field, label, score): the best label with _ for spaces, or unknown if it is weak or close to the second."""
    best = _top_two(scores.where(F.col("field").isin(*rules)), ["paper_id", "field"], "score", "label")
    rule = F.create_map(*[x for k, (a, b) in rules.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])[F.col("field")]
    name = F.when(F.col("top") == "not applicable", "n/a").otherwise(F.regexp_replace("top", r"\s+", "_"))
    sure = (F.col("score") >= rule[0]) & (F.col("margin") >= rule[1])
    return best.select("paper_id", "field", F.when(sure, name).otherwise("unknown").alias("value"), "score", "margin")


def categories(scores: DataFrame, least: float = CATEGORY_COSINE, most: int = CATEGORY_MOST) -> DataFrame:
    """(paper_id, nth, category, score) of scores (paper_id, label, score): the best label always, and the next ones while they are good enough."""
    return _ranked(scores, ["paper_id"], "score", "label").where((F.col("nth") <= most) & ((F.col("nth") == 1) | (F.col("score") >= least))).select("paper_id", "nth", F.col("label").alias("category"), "score")


def method_families(scores: DataFrame, least: float = FAMILY_COSINE, margin: float = FAMILY_MARGIN) -> DataFrame:
    """(paper_id, method_family, score, margin): the best label, or other."""
    best = _top_two(scores, ["paper_id"], "score", "label")
    return best.select("paper_id", F.when((F.col("score") >= least) & (F.col("margin") >= margin), F.col("top")).otherwise("other").alias("method_family"), "score", "margin")


def topic_relevance(scores: DataFrame, edited: DataFrame, core: float = RELEVANCE_CORE, important: float = RELEVANCE_IMPORTANT) -> DataFrame:
    """(paper_id, relevance, score) of scores (paper_id, score); papers that a person has rated (edited: paper_id) are left out."""
    rated = F.when(F.col("score") >= core, "core").when(F.col("score") >= important, "important").otherwise("peripheral")
    return scores.join(edited.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", rated.alias("relevance"), "score")


def span_types(scores: DataFrame) -> DataFrame:
    """(span_id, kind, cosine, entail, margin) of scores (span_id, type, cosine, entail): of the three nearest types above the floor the best entailed one, if that is clear."""
    near = scores.groupBy("span_id", "type").agg(F.max("cosine").alias("cosine"), F.max("entail").alias("entail")).where(F.col("cosine") >= TYPE_COSINE)
    near = _ranked(near, ["span_id"], "cosine", "type").where(F.col("nth") <= TYPE_MOST).drop("nth")
    best = _top_two(near, ["span_id"], "entail", "type").where((F.col("score") >= TYPE_ENTAIL) & (F.col("margin") >= TYPE_MARGIN - 1e-9))
    return best.join(near.select("span_id", F.col("type").alias("top"), "cosine"), ["span_id", "top"]).select("span_id", F.col("top").alias("kind"), "cosine", F.col("score").alias("entail"), "margin")


def paper_entities(spans: DataFrame, resolved: DataFrame) -> DataFrame:
    """(paper_id, kind, canonical, raw, score, how): one row for each name that a paper uses, from its best-scored span.

    spans (paper_id, kind, raw, score); resolved (kind, raw, canonical, status) of an entity resolution. Names that it does not know become their slug; those without any letter or digit go.
    """
    new = F.nullif(F.regexp_replace(F.regexp_replace(F.lower("raw"), r"[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))
    known = resolved.select("kind", "raw", F.col("canonical").alias("known"), "status")
    named = spans.join(known, ["kind", "raw"], "left").withColumn("canonical", F.coalesce("known", new)).where("canonical is not null")
    order = Window.partitionBy("paper_id", "kind", "canonical").orderBy(F.desc("score"), "raw")
    best = named.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return best.select("paper_id", "kind", "canonical", "raw", "score", F.when(F.col("known").isNull(), "novel").otherwise(F.col("status")).alias("how"))


def context_classes(scores: DataFrame, least: float = CONTEXT_ACCEPT) -> DataFrame:
    """(src, dst, context_class, score) of scores (src, dst, label, score): the best label, none if it is weak."""
    best = _top_two(scores, ["src", "dst"], "score", "label")
    return best.select("src", "dst", F.when(F.col("score") >= least, F.col("top")).alias("context_class"), "score")


def section_labels(chunks: DataFrame, scores: DataFrame, temperature: float = 1.0, by_heading: Callable[[Column], Column] | None = None) -> DataFrame:
    """(chunk_id, label, score): what the heading's slug says, with score 1; else the label of the largest share.

    chunks (chunk_id, slug); scores (chunk_id, label, cosine), a row for each prototype. A label's score is that of its best prototype; shares are the softmax over labels.
    """
    from corpusloom.operators.passages import section_of_slug

    told = (by_heading or section_of_slug)(F.col("slug"))
    best = scores.groupBy("chunk_id", "label").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("chunk_id")
    e = F.exp((F.col("cosine") - F.max("cosine").over(w)) / temperature)
    shares = best.withColumn("share", e).withColumn("share", F.round(F.col("share") / F.sum("share").over(w), 6))
    top = _ranked(shares, ["chunk_id"], "share", "label").where("nth = 1").select("chunk_id", F.col("label").alias("guess"), "share")
    out = chunks.select("chunk_id", told.alias("told")).join(top, "chunk_id", "left")
    return out.select("chunk_id", F.coalesce("told", "guess", F.lit("other")).alias("label"), F.when(F.col("told").isNotNull(), 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


# Metric names looked for in a text, and patterns that hint at how a study was made.
METRICS = (
    "precision;recall;f1;f-score;f score;accuracy;auroc;auc-roc;auprc;auc;mae;mse;rmse;mape;r-squared;r2;bleu;rouge;meteor;cider;spice;exact match;em;iou;miou;dice;hausdorff;"
    "top-1;top-5;top-10;mrr;ndcg;map;perplexity;cross-entropy;log-likelihood;kappa;cohen kappa;fleiss kappa;sensitivity;specificity;pearson;spearman"
).split(";")
CASE_COUNT = (
    r"(?i)\b(\d{2,7}(?:[,.]\d{3})*)\s+(?:test\s+cases|test\s+examples|samples|instances|images|examples|articles|sentences|documents|papers|tweets|users|participants|subjects|patients|cases|"
    r"videos|recordings|sessions|trials|observations)\b"
)
HINTS = {
    "baseline_compared": r"(?i)\b(baseline|baselines|compared?\s+(?:to|against|with)\s+\w+|state[\s-]of[\s-]the[\s-]art|sota)\b",
    "uncertainty": r"(?i)\b(confidence\s+intervals?|standard\s+deviations?|standard\s+errors?|error\s+bars?|uncertainty\s+quantification|bootstrap|95%\s+ci)\b",
    "hobby_project_scale": r"(?i)\b(single\s+gpu|consumer\s+gpu|laptop|colab|reproducible\s+in\s+a\s+(?:weekend|day)|no\s+training\s+required)\b",
    "self_constructed_ground_truth": r"(?i)\b(?:we|the\s+authors)\s+(?:annotated|labeled|labelled|created|constructed|built|curated)\s+(?:our|a|the)\s+(?:own\s+)?(?:ground\s+truth|dataset|benchmark|test\s+set|labels|corpus)\b",
    "external_ground_truth": r"(?i)\b(public\s+(?:dataset|benchmark)|standard\s+benchmark|widely[\s-]used\s+dataset|established\s+benchmark)\b",
    "reproducible": r"(?i)\b(code\s+is\s+available|github\.com|data\s+is\s+(?:available|released)|we\s+release|publicly\s+available)\b",
}


def study_signals(docs: DataFrame) -> DataFrame:
    """(doc_id, metrics, case_count, <hint>…) of texts (doc_id, text): the metrics named, the first number of cases (0 if none), and whether each hint is there."""
    name = lambda m: F.lit(m.replace(" ", "_").replace("-", "_").replace("f_score", "f1"))
    found = [F.when(F.lower("text").rlike(r"\b" + m.replace("-", "[-.]?") + r"\b"), name(m)) for m in METRICS]
    count = F.regexp_replace(F.regexp_extract("text", CASE_COUNT, 1), "[,.]", "").try_cast("long")
    return docs.select("doc_id", F.array_distinct(F.array_compact(F.array(*found))).alias("metrics"), F.coalesce(count, F.lit(0)).alias("case_count"), *[F.coalesce(F.col("text").rlike(p), F.lit(False)).alias(k) for k, p in HINTS.items()])


def cut_relevance(score: Column, core: float = 0.65, adjacent: float = 0.45) -> Column:
    """The relevance bins of drafted notes."""
    return F.when(score >= core, "core").when(score >= adjacent, "adjacent").otherwise("peripheral")


def with_model(rows: DataFrame, text: str, model: Callable[[pd.Series], pd.Series], result: str, kind: str) -> DataFrame:
    """rows with a model's answers for a text column: the interface through which models are plugged in, a batch of texts at a time."""

    @F.pandas_udf(kind)
    def call(s: pd.Series) -> pd.Series:
        return model(s)

    return rows.withColumn(result, call(F.col(text)))


def hash_embedder(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A stand-in for an embedding model, for tests: words hashed into signed components, at unit length."""

    def embed(texts: pd.Series) -> pd.Series:
        import numpy as np
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1 if h >> 32 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def reranked(candidates: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): candidates (query_id, doc_id, query, text) in the order of a pair model, the best k; ties by id."""

    def run(batches):
        for b in batches:
            yield b[["query_id", "doc_id"]].assign(score=scorer(b).astype(float))

    ids = candidates.select("query_id", "doc_id").schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ids)
    scored = candidates.select("query_id", "doc_id", "query", "text").mapInPandas(run, f"{kinds}, score double").withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def overlap_scorer(pairs: pd.DataFrame) -> pd.Series:
    """A stand-in for a pair model, for tests: the share of the query's words that the text has."""
    out = []
    for q, t in zip(pairs["query"], pairs["text"]):
        words = set((q or "").lower().split())
        out.append(len(words & set((t or "").lower().split())) / len(words) if words else 0.0)
    return pd.Series(out)

