"""Scores, verdicts and metadata of matched claims, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriscope.config import Settings
from veriscope.functions.text import ramp


def semantic_vote(c: Settings, score: Column, ratio: Column) -> Column:
    a, r = score >= c.voter_semantic_abs, ratio >= c.voter_semantic_ratio
    return {"abs_only": a, "ratio_only": r, "and": a & r}.get(c.voter_semantic_mode, a | r)


def voters(c: Settings, exact: Column, fuzzy: Column, recall: Column, score: Column, ratio: Column) -> Column:
    flags = (exact >= c.voter_exact, fuzzy >= c.voter_fuzzy, recall >= c.voter_bm25, semantic_vote(c, score, ratio))
    return reduce(lambda a, b: a + b, (f.cast("int") for f in flags))


def semantic_ramp(c: Settings, score: Column, ratio: Column) -> Column:
    by_ratio = F.when(ratio > 0, ramp(ratio, *c.semantic_ratio_ramp)).otherwise(0.0)
    return F.greatest(ramp(score, *c.semantic_abs_ramp), by_ratio)


def agreement(c: Settings, exact: Column, fuzzy: Column, recall: Column, score: Column, ratio: Column) -> Column:
    """Weighted agreement of the layers with a bonus where several speak for the claim."""
    w = c.agreement_weights
    raw = w[0] * F.when(exact >= c.voter_exact, 1.0).otherwise(0.0) + w[1] * ramp(fuzzy, *c.fuzzy_ramp) + w[2] * ramp(recall, *c.bm25_ramp) + w[3] * semantic_ramp(c, score, ratio)
    n = voters(c, exact, fuzzy, recall, score, ratio)
    return F.least(F.lit(1.0), raw + F.when(n >= 3, c.bonus_three).when(n == 2, c.bonus_two).otherwise(0.0))


def entity_penalty(c: Settings, agreed: Column, absent: Column, total: Column) -> Column:
    return F.when((total > 0) & (absent > 0), F.greatest(F.lit(0.0), agreed - c.entity_penalty * absent / total)).otherwise(agreed)


def combined(*scores: Column) -> Column:
    return F.greatest(*scores)


def winning_layer(exact: Column, fuzzy: Column, bm25: Column, semantic: Column) -> Column:
    """The strongest layer; the first of fuzzy, bm25, semantic wins ties, and semantic where nothing scored."""
    top = F.greatest(fuzzy, bm25, semantic)
    return F.when(exact >= 1, "exact").when(top <= 0, "semantic").when(fuzzy == top, "fuzzy").when(bm25 == top, "bm25").otherwise("semantic")


def head_verdict(probability: Column, threshold: Column, contradicted: Column, any_signal: Column, layer: Column) -> Column:
    """Contradiction first, then the head, else none."""
    return F.when(contradicted & any_signal, "contradicted").when(probability >= threshold, layer).otherwise("none")


def cascade_verdict(c: Settings, exact: Column, fuzzy: Column, bm25: Column, semantic: Column, agreed: Column, contradicted: Column) -> Column:
    """The deterministic order of layers, with agreement as the last resort in absolute mode."""
    signal = (exact > 0) | (fuzzy > 0) | (bm25 > 0) | (semantic > 0)
    out = F.when(contradicted & signal, "contradicted").when(exact == 1, "exact").when(fuzzy >= c.fuzzy_threshold, "fuzzy").when(bm25 >= c.bm25_threshold, "bm25").when(semantic >= c.semantic_threshold, "semantic")
    if c.classifier_mode == "absolute":
        agreed_on = F.when((semantic >= bm25) & (semantic >= fuzzy), "semantic").when(bm25 >= fuzzy, "bm25").when(fuzzy > 0, "fuzzy").otherwise("none")
        out = out.when(agreed >= c.agreement_threshold, agreed_on)
    return out.otherwise("none")


def bucket(label: Column) -> Column:
    return F.when(label == "contradicted", "contradicted").when(label == "none", "unconfirmed").otherwise("grounded")


def final_score(probability: Column, combined_score: Column) -> Column:
    return F.round(F.when(probability >= 0, probability).otherwise(combined_score), 4)


def co_support(c: Settings, fuzzy: Column, recall: Column) -> Column:
    return (fuzzy >= c.co_support_fuzzy) | (recall >= c.co_support_bm25)


def winning_passage(exact: Column, exact_text: Column, semantic: Column, semantic_text: Column, bm25: Column, bm25_text: Column, fuzzy: Column, fuzzy_text: Column, only_source: Column) -> Column:
    return F.when(exact == 1, exact_text).when((semantic > 0) & (semantic_text != ""), semantic_text).when((bm25 > 0) & (bm25_text != ""), bm25_text).when((fuzzy > 0) & (fuzzy_text != ""), fuzzy_text).otherwise(only_source)


def verification_reasons(c: Settings, label: Column, fuzzy: Column, bm25: Column, semantic: Column, threshold: Column, supported: Column, absent: Column, other_source: Column) -> Column:
    """Why a verdict needs a second look: near or below its threshold, a lone semantic vote, absent entities, other source."""
    score = F.when(label == "fuzzy", fuzzy).when(label == "bm25", bm25).when(label == "semantic", semantic)
    floor = F.when(label == "fuzzy", c.fuzzy_threshold).when(label == "bm25", c.bm25_threshold).when(label == "semantic", threshold)
    return F.array_compact(F.array(
        F.when(score - floor < c.proximity, "near_threshold"), F.when((label == "semantic") & ~supported, "semantic_only"),
        F.when(absent > 0, "entities_absent"), F.when(other_source, "other_source"),
    ))


def calibrator_features(c: Settings, exact: Column, fuzzy: Column, recall: Column, score: Column, ratio: Column, supported: Column, absent: Column, total: Column) -> dict[str, Column]:
    sem = F.when(ratio > 0, ramp(ratio, *c.semantic_ratio_ramp)).otherwise(ramp(score, *c.semantic_abs_ramp))
    return {
        "exact": F.when(exact >= 1, 1.0).otherwise(0.0), "fuzzy": fuzzy, "bm25_recall": recall, "semantic": sem,
        "voters": F.least(F.lit(1.0), voters(c, exact, fuzzy, recall, score, ratio) / 4), "lexical_cosupport": supported.cast("double"),
        "entity_absent": F.when(total > 0, absent / total).otherwise(0.0), "nli_entail": F.lit(0.0), "nli_contra": F.lit(0.0),
    }


def escalates(probability: Column, lo: float, hi: float, other_language: Column | None = None) -> Column:
    """Whether a record goes on to the costlier stage: inside the band, or in another language."""
    band = (probability >= lo) & (probability <= hi)
    return band if other_language is None else band | other_language
