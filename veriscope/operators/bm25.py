"""BM25 over the passages of each evidence group, built once for all claims of the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriscope.functions import text as T
from veriscope.plans.shared import Workspace

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(passages: DataFrame, group: str, passage: str, text: str = "text", analyzer=T.tokens) -> DataFrame:
    """``group, passage, dl, term, tf`` with the number of tokens of the passage; passages without tokens are left out."""
    toks = passages.select(group, passage, analyzer(text).alias("_t")).filter(F.size("_t") > 0)
    return toks.select(group, passage, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(group, passage, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def statistics(posts: DataFrame, group: str, passage: str) -> tuple[DataFrame, DataFrame]:
    """``(terms, corpora)``: ``group, term, df, idf`` and ``group, n, avgdl, max_idf``.

    A term in more than half of the passages would weigh less than nothing; it gets a quarter of the mean weight.
    """
    docs = posts.select(group, passage, "dl").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = posts.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(docs, group).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(group).agg(F.avg("raw").alias("mean"))
    terms = raw.join(mean, group).select(group, "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    corpora = docs.join(terms.groupBy(group).agg(F.max("idf").alias("max_idf")), group)
    return terms, corpora


def scores(claims: DataFrame, posts: DataFrame, terms: DataFrame, corpora: DataFrame, claim_id: str, group: str, passage: str, claim: str = "claim", analyzer=T.tokens) -> DataFrame:
    """``claim_id, group, passage, score`` of passages that share a term with the claim; scores below 0 are 0."""
    asked = claims.select(claim_id, group, F.explode(analyzer(claim)).alias("term")).groupBy(claim_id, group, "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = posts.join(terms.select(group, "term", "idf"), [group, "term"]).join(corpora.select(group, "avgdl"), group)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = weighted.select(group, "term", passage, part.alias("w"))
    total = asked.join(weighted, [group, "term"]).groupBy(claim_id, group, passage).agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))
    return total.withColumn("score", F.greatest(F.lit(0.0), F.round("score", 9)))


def recalls(claims: DataFrame, posts: DataFrame, terms: DataFrame, corpora: DataFrame, claim_id: str, group: str, passage: str, claim: str = "claim", analyzer=T.tokens, background: DataFrame | None = None, blend: float = 0.5) -> DataFrame:
    """``claim_id, group, passage, recall``: share of the claim's term weight that a passage holds.

    Terms the corpus does not know weigh as much as its rarest. ``background`` (``term, rarity``) puts a floor of
    ``blend`` times the rarity under each weight. A claim without weight has the plain share of its terms.
    """
    asked = claims.select(claim_id, group, F.explode(F.array_distinct(analyzer(claim))).alias("term"))
    known = asked.join(terms.select(group, "term", "idf"), [group, "term"], "left").join(corpora.select(group, "max_idf"), group)
    weight = F.greatest(F.lit(0.0), F.coalesce("idf", "max_idf"))
    if background is not None:
        known = known.join(background.select("term", "rarity"), "term", "left")
        weight = F.greatest(weight, blend * F.coalesce("rarity", F.lit(9.0)))
    known = known.select(claim_id, group, "term", weight.alias("w"))
    whole = known.groupBy(claim_id, group).agg(F.sum("w").alias("all_w"), F.count(F.lit(1)).alias("all_n"))
    held = known.join(posts.select(group, passage, "term"), [group, "term"]).groupBy(claim_id, group, passage).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(F.col("n") / F.col("all_n"))
    return held.join(whole, [claim_id, group]).select(claim_id, group, passage, share.alias("recall"))


def best_passage(claims: DataFrame, passages: DataFrame, claim_id: str, group: str, passage: str, claim: str = "claim", text: str = "text", analyzer=T.tokens, work: Workspace | None = None) -> DataFrame:
    """``claim_id, group, passage, score, normalised, recall``: the best passage of each claim that has one above 0.

    The first passage wins ties (scores are compared to nine digits). ``normalised`` is the score over the claim's
    highest one, 1 for the winner. Postings and statistics are written once, as several branches read them, and the recall
    is measured on the winners alone.
    """
    work = work or Workspace(claims.sparkSession, "bm25")
    posts = work.save(postings(passages, group, passage, text, analyzer), "postings")
    terms, corpora = (work.save(x, "statistics") for x in statistics(posts, group, passage))
    scored = scores(claims, posts, terms, corpora, claim_id, group, passage, claim, analyzer).filter("score > 0")
    # a claim's winner by aggregation: no sort of all its passages
    won = scored.groupBy(claim_id, group).agg(F.max("score").alias("score"), F.min_by(passage, F.struct(-F.col("score"), F.col(passage))).alias(passage))
    won = work.save(won, "winners")
    return won.join(recall_of(won, claims, posts, terms, corpora, claim_id, group, passage, claim, analyzer), [claim_id, group, passage]).select(claim_id, group, passage, "score", F.lit(1.0).alias("normalised"), "recall")


def recall_of(won: DataFrame, claims: DataFrame, posts: DataFrame, terms: DataFrame, corpora: DataFrame, claim_id: str, group: str, passage: str, claim: str = "claim", analyzer=T.tokens) -> DataFrame:
    """As ``recalls``, for one passage a claim: ``claim_id, group, passage, recall``. A claim's terms meet no other passage."""
    asked = claims.select(claim_id, group, F.explode(F.array_distinct(analyzer(claim))).alias("term"))
    known = asked.join(terms.select(group, "term", "idf"), [group, "term"], "left").join(corpora.select(group, "max_idf"), group)
    known = known.select(claim_id, group, "term", F.greatest(F.lit(0.0), F.coalesce("idf", "max_idf")).alias("w")).join(won.select(claim_id, group, passage), [claim_id, group])
    held = known.join(posts.select(group, passage, "term", F.lit(True).alias("held")), [group, passage, "term"], "left")
    sums = held.groupBy(claim_id, group, passage).agg(F.sum("w").alias("all_w"), F.count(F.lit(1)).alias("all_n"), F.sum(F.when(F.col("held"), F.col("w")).otherwise(0.0)).alias("w"), F.count_if("held").alias("n"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(F.col("n") / F.col("all_n"))
    return sums.select(claim_id, group, passage, share.alias("recall"))


def rank_recalls(recall: DataFrame, claim_id: str, passage: str) -> DataFrame:
    """``claim_id, oracle, second``: the best recall over all passages and the second best (the best where it is alone)."""
    by = Window.partitionBy(claim_id).orderBy(F.desc("recall"), passage)
    top = recall.withColumn("_r", F.row_number().over(by)).filter("_r <= 2")
    return top.groupBy(claim_id).agg(F.max("recall").alias("oracle"), F.min("recall").alias("second"))
