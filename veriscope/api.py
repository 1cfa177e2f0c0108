"""Claims against evidence: the whole way from two tables to verdicts and documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.config import Settings
from veriscope.functions import entities as E
from veriscope.functions import kernels as K
from veriscope.operators import bm25, evaluate, matching, segment, verdict
from veriscope.plans.shared import Workspace


class SemanticLayer(Protocol):
    def __call__(self, asked: DataFrame, texts: DataFrame) -> DataFrame:
        """``qid, semantic_score, semantic_ratio, semantic_text, semantic_source`` from ``qid, group_id, claim`` and ``group_id, source_index, source_path, text``."""


class EntailmentLayer(Protocol):
    def __call__(self, premise: Column, claim: Column) -> Column:
        """A struct ``entailment, neutral, contradiction`` of a pair of texts."""


class VerdictHead(Protocol):
    threshold: float

    def probability(self) -> Column:
        """Probability over the columns of ``verdict.calibrator_features``."""


#: Claims of a group that meet a text together: a text is sent once for so many.
BLOCK = 64
#: Claims and texts that a task compares together.
AT_ONCE = 4000
#: Characters taken on either side of a fuzzy match when values are compared (fixed values).
BEFORE, AFTER = 100, 200


def _blocks(asked: DataFrame) -> DataFrame:
    """``group_id, blk, of, qs``: the claims of a group in blocks of about ``BLOCK``, dealt by a hash; ``of`` is the number of blocks."""
    sizes = asked.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("of"))
    dealt = asked.join(sizes, "group_id").withColumn("blk", F.pmod(F.xxhash64("qid"), F.col("of")).cast("int"))
    return dealt.groupBy("group_id", "of", "blk").agg(F.collect_list(F.struct("qid", "claim")).alias("qs"))


_SCANNED = f"qid string, source_index int, source_path string, exact boolean, exact_location {matching._LOC}, exact_text string, fuzzy double, fuzzy_text string, fuzzy_location {matching._LOC}, around string, held array<string>"
_SCANNED_PA = [("qid", pa.string()), ("source_index", pa.int32()), ("source_path", pa.string()), ("exact", pa.bool_()), ("exact_location", matching._LOC_PA), ("exact_text", pa.string()), ("fuzzy", pa.float64()), ("fuzzy_text", pa.string()), ("fuzzy_location", matching._LOC_PA), ("around", pa.string()), ("held", pa.list_(pa.string()))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact and fuzzy match, and the claim's names that the text holds, of each claim of a block with one text."""
    held: list[tuple] = []
    for b in chain(batches, [None]):
        for at in range(0, b.num_rows if b is not None else 0, BLOCK):
            part = b.slice(at, BLOCK)
            for qs, i, path, text in zip(*(part.column(n).to_pylist() for n in ("qs", "source_index", "source_path", "text"))):
                folded = K.one_case(text)
                for q in qs:
                    c = q["claim"] or ""
                    bare = K.one_case(c)
                    held.append((q["qid"], c, i, path, text, K.exact_span(c, text) if bare and bare in folded else None))
            if len(held) >= AT_ONCE:
                yield _scanned(held)
                held = []
    if held:
        yield _scanned(held)


def _scanned(held: list[tuple]) -> pa.RecordBatch:
    scores = iter(K.partial_ratios([(c, text) for _, c, _, _, text, hit in held if c and not hit]))
    rows: list[tuple] = []
    named: dict[str, list[str]] = {}
    for qid, c, i, path, text, hit in held:
        score, s, e = (1.0, *hit) if hit else next(scores) if c else (0.0, 0, 0)
        at = K.location(text, *hit) if hit else None
        names = named[c] if c in named else named.setdefault(c, E.entities(c))
        low = text.lower() if names else ""
        rows.append((qid, i, path, hit is not None, at, text[slice(*hit)] if hit else None, score, text[s:e], at or K.location(text, s, e), text[max(0, s - BEFORE) : e + AFTER], [x for x in names if x.lower() in low]))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), _SCANNED_PA)], [n for n, _ in _SCANNED_PA])


def _compared(rows: DataFrame) -> DataFrame:
    """``qid, numeric_mismatches, entity_mismatches, names`` of claims and their winning passages."""
    pairs = pa.list_(pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(E.number_conflicts(c or "", p or "") if p else [], E.name_conflicts(c or "", p or "") if p else [], E.entities(c or "")) for c, p in zip(b.column("claim").to_pylist(), b.column("passage").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("qid"), *(pa.array([[list(x) for x in o[k]] for o in out], pairs) for k in (0, 1)), pa.array([o[2] for o in out], pa.list_(pa.string()))], ["qid", "numeric_mismatches", "entity_mismatches", "names"])

    return rows.select("qid", "claim", "passage").mapInArrow(run, "qid string, numeric_mismatches array<array<string>>, entity_mismatches array<array<string>>, names array<string>")


def ground_batch(
    claims: DataFrame, sources: DataFrame, settings: Settings | None = None, *, semantic: SemanticLayer | None = None, nli: EntailmentLayer | None = None,
    head: VerdictHead | None = None, primary_source: str | None = None,
) -> DataFrame:
    """One row a claim with the scores of the layers, mismatches, verdict and provenance.

    ``claims``: ``claim_id, group_id, claim``; ``sources``: ``group_id, source_index, source_path, text``. A claim is
    compared with the texts of its group only, and equal claims of a group once. The claims of a group meet its texts in
    blocks, one text a row, so a hot group is many rows of many tasks; passages and term statistics are made once for a
    group. Claims without sources come out as ``none`` with scores of 0; null claims score 0 everywhere.

    Layers beyond the lexical ones are given as functions: ``semantic`` scores all claims, ``nli`` takes the best passage
    as premise, and ``head`` decides by its probability over the calibrator's features in place of the fixed thresholds.
    A contradiction, in values, names or entailment, comes first in any case.
    """
    c = settings or Settings()
    work = Workspace(claims.sparkSession, "ground")
    texts = sources.filter(F.length("text") > 0).select("group_id", "source_index", "source_path", "text")
    known = claims.select("claim_id", "group_id", "claim", F.md5(F.concat_ws("\x1f", F.coalesce("group_id", F.lit("")), F.coalesce("claim", F.lit("")))).alias("qid"))
    asked = work.save(known.filter("group_id is not null").groupBy("qid").agg(F.any_value("group_id").alias("group_id"), F.any_value("claim").alias("claim")), "asked")

    blocks = work.save(_blocks(asked), "blocks")
    spread = texts.join(blocks.select("group_id", "of").distinct(), "group_id").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")
    met = spread.join(blocks, ["group_id", "blk"]).select("qs", "source_index", "source_path", "text")
    # a stated number of partitions: few bytes are much work here, so small ones must not be put together
    tasks = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    layer = met.repartition(tasks, F.xxhash64(F.col("qs")[0]["qid"], "source_index")).mapInArrow(_scan, _SCANNED)
    best = layer.groupBy("qid").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct("source_index", "source_path", F.col("exact_location").alias("location"), F.col("exact_text").alias("text")), F.when(F.col("exact"), F.col("source_index"))).alias("x"),
        F.max("exact").alias("exact"),
        F.min_by(F.struct("fuzzy", F.col("fuzzy_text").alias("text"), F.col("fuzzy_location").alias("location"), "around", "source_index", "source_path"), F.struct(-F.col("fuzzy"), F.col("source_index"))).alias("f"),
        F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"),
    )
    best = work.save(best, "best")

    parts = work.save(segment.passages(texts, ["group_id", "source_index"]).select("group_id", F.struct("source_index", "passage_no").alias("pid"), "text"), "passages")
    won = bm25.best_passage(asked, parts, "qid", "group_id", "pid", work=work)
    won = won.join(parts.select("group_id", "pid", F.col("text").alias("bm25_text")), ["group_id", "pid"]).select("qid", F.col("pid.source_index").alias("bm25_source"), "bm25_text", "normalised", "recall")

    rows = asked.join(best, "qid", "left").join(won, "qid", "left")
    if semantic is not None:
        rows = rows.join(semantic(asked, texts).select("qid", "semantic_score", "semantic_ratio", "semantic_text", "semantic_source"), "qid", "left")
    else:
        rows = rows.withColumns({"semantic_score": F.lit(0.0), "semantic_ratio": F.lit(0.0), "semantic_text": F.lit(None).cast("string"), "semantic_source": F.lit(None).cast("int")})
    zero = F.lit(0.0)
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(zero, F.coalesce(x, zero)))
    rows = rows.withColumns({
        "exact_score": F.when(F.col("exact"), 1.0).otherwise(0.0), "fuzzy_score": F.coalesce("f.fuzzy", zero),
        "bm25_score": F.coalesce("normalised", zero), "bm25_token_recall": F.coalesce("recall", zero),
        "semantic_score": clamp(F.col("semantic_score")), "semantic_ratio": F.coalesce("semantic_ratio", zero),
    })
    ex, fu, bm, rc, se, ra = (F.col(n) for n in ("exact_score", "fuzzy_score", "bm25_score", "bm25_token_recall", "semantic_score", "semantic_ratio"))
    empty = F.lit("")
    passage = verdict.winning_passage(ex, F.col("x.text"), se, F.coalesce("semantic_text", empty), bm, F.coalesce("bm25_text", empty), fu, F.coalesce("f.around", empty), F.lit(None).cast("string"))
    rows = work.save(rows.withColumn("passage", passage), "layers")
    # the text itself where no layer has found a place and it is the group's only one
    lone = rows.filter("passage is null and _n = 1").select("qid", "group_id").join(texts.select("group_id", F.col("text").alias("only")), "group_id").select("qid", "only")
    rows = rows.join(lone, "qid", "left").withColumn("passage", F.coalesce("passage", "only")).drop("only")

    rows = rows.join(_compared(rows), "qid").withColumn("entities_absent", F.array_except("names", F.coalesce("held", F.array().cast("array<string>"))))
    rows = rows.withColumn("entities_absent", F.when(F.col("_n").isNull(), F.col("names")).otherwise(F.col("entities_absent")))
    contradicted = (F.size("numeric_mismatches") > 0) | (F.size("entity_mismatches") > 0)
    signal = (ex > 0) | (fu > 0) | (bm > 0) | (se > 0)
    entailed = None
    if nli is not None:
        premise = F.coalesce("bm25_text", "semantic_text", "x.text", "passage", empty)
        rows = work.save(rows.withColumn("_nli", nli(premise, F.coalesce("claim", empty))), "entailment")
        e, n, k = (F.col(f"_nli.{x}") for x in ("entailment", "neutral", "contradiction"))
        contradicted, signal = contradicted | ((k > e) & (k > n)), F.lit(True)
        entailed = (e >= n) & (e >= k)
    agreed = verdict.entity_penalty(c, verdict.agreement(c, ex, fu, rc, se, ra), F.size("entities_absent"), F.size("names"))
    rows = rows.withColumn("agreement_score", agreed).withColumn("combined_score", verdict.combined(ex, fu, bm, se))
    layer_name, supported = verdict.winning_layer(ex, fu, bm, se), verdict.co_support(c, fu, rc)
    probability = F.lit(-1.0)
    if head is not None:
        feats = verdict.calibrator_features(c, ex, fu, rc, se, ra, supported, F.size("entities_absent"), F.size("names"))
        if nli is not None:
            feats |= {"nli_entail": F.col("_nli.entailment"), "nli_contra": F.col("_nli.contradiction")}
        feats = {k: v.alias(k) for k, v in feats.items()}
        scored = rows.select("qid", *feats.values()).select("qid", head.probability().alias("verdict_probability"))
        rows = rows.join(scored, "qid")
        probability = F.col("verdict_probability")
        said = verdict.head_verdict(probability, F.lit(head.threshold), contradicted, signal, layer_name)
    elif entailed is not None:
        said = F.when(contradicted, "contradicted").when(entailed, layer_name).otherwise("none")
    else:
        said = verdict.cascade_verdict(c, ex, fu, bm, se, F.col("agreement_score"), contradicted)
    rows = rows.withColumns({"match_type": said, "lexical_co_support": supported, "_p": probability})
    source = F.when(F.col("match_type") == "exact", F.col("x.source_index")).when(F.col("match_type") == "bm25", F.col("bm25_source")).when(F.col("match_type") == "semantic", F.coalesce("semantic_source", "f.source_index")).otherwise(F.col("f.source_index"))
    where = F.when(F.col("match_type") == "exact", F.col("x.location")).otherwise(F.col("f.location"))
    elsewhere = F.lit(False) if primary_source is None else F.coalesce(F.when(F.col("match_type") == "exact", F.col("x.source_path")).otherwise(F.col("f.source_path")) != primary_source, F.lit(False))
    reasons = verdict.verification_reasons(c, F.col("match_type"), fu, bm, se, F.lit(c.semantic_threshold), supported, F.size("entities_absent"), elsewhere)
    if head is not None:
        near = F.col("match_type").isin("exact", "fuzzy", "bm25", "semantic") & (F.abs(probability - head.threshold) < c.proximity)
        reasons = F.when(near & ~F.array_contains(reasons, "near_threshold"), F.array_append(reasons, F.lit("near_threshold"))).otherwise(reasons)
    keep = ["match_type", "exact_score", "fuzzy_score", "bm25_score", "bm25_token_recall", "semantic_score", "semantic_ratio", "agreement_score", "combined_score", "numeric_mismatches", "entity_mismatches", "entities_absent", "lexical_co_support"]
    done = rows.select("qid", *keep, F.col("_p").alias("verdict_probability"), reasons.alias("verification_reasons"), source.alias("source_index"), where.alias("location"), F.col("f.text").alias("matched_text"))
    out = known.join(done, "qid", "left").drop("qid")
    none = {n: 0.0 for n in keep if n.endswith(("_score", "_ratio", "_recall"))} | {"match_type": "none", "lexical_co_support": False, "verdict_probability": -1.0}
    out = out.fillna(none)
    for n, kind in (("numeric_mismatches", "array<array<string>>"), ("entity_mismatches", "array<array<string>>"), ("entities_absent", "array<string>"), ("verification_reasons", "array<string>")):
        out = out.withColumn(n, F.coalesce(n, F.array().cast(kind)))
    return out.select("claim_id", "group_id", "claim", *keep, "verification_reasons", "source_index", "location", "matched_text", (F.size("verification_reasons") > 0).alias("verification_needed"), "verdict_probability")


def with_adaptive_gap(matches: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Unconfirmed claims above their group's widest gap in agreement become confirmed by their strongest layer."""
    c = settings or Settings()
    cut = evaluate.adaptive_gap(matches, "group_id", "agreement_score", "claim_id", least=c.adaptive_least_claims)
    layer = verdict.winning_layer(F.col("exact_score"), F.col("fuzzy_score"), F.col("bm25_score"), F.col("semantic_score"))
    joined = matches.join(cut, "group_id", "left")
    lifted = (F.col("match_type") == "none") & (F.col("agreement_score") >= F.col("threshold")) & (F.col("threshold") > 0)
    return joined.withColumn("match_type", F.when(lifted, layer).otherwise(F.col("match_type"))).drop("threshold", "gap")


def ground(spark, claim: str, sources: list, settings: Settings | None = None) -> DataFrame:  # noqa: ANN001
    """One claim against texts given in a list."""
    from veriscope.sources.readers import numbered_sources

    one = spark.createDataFrame([("c01", "", claim)], "claim_id string, group_id string, claim string")
    return ground_batch(one, numbered_sources(spark, sources), settings)


def grounding_documents(matches: DataFrame, by: str = "group_id") -> DataFrame:
    """``by, total, grounded, ungrounded, document``: a JSON document of the claims of each group with a summary."""
    m = matches.withColumn("verdict", verdict.bucket(F.col("match_type"))).withColumn("score", verdict.final_score(F.lit(-1.0), F.col("combined_score")))
    support = F.when(F.col("verdict") == "grounded", F.struct("source_index", "matched_text", "location"))
    entry = F.struct("claim_id", "claim", "verdict", "match_type", "score", support.alias("support"), "numeric_mismatches", "entity_mismatches", "entities_absent")
    got = m.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "grounded").alias("grounded"), F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["claim_id"] < b["claim_id"], -1).when(a["claim_id"] > b["claim_id"], 1).otherwise(0)).alias("claims"))
    got = got.withColumn("ungrounded", F.col("total") - F.col("grounded"))
    return got.select(by, "total", "grounded", "ungrounded", F.to_json(F.struct(F.struct("total", "grounded", "ungrounded").alias("summary"), "claims")).alias("document"))


def feature_frame(records: DataFrame, settings: Settings | None = None, key: str = "row_id") -> DataFrame:
    """``key, grounded, lang`` and the calibrator's features of labelled records, each held against its own evidence.

    Records that share an evidence text share its passages and statistics. Rows with a null label are left out.
    """
    c = settings or Settings()
    rows = records.filter(F.col("label").isNotNull()).withColumn("group_id", F.md5(F.coalesce("source_text", F.lit(""))))
    sources = rows.groupBy("group_id").agg(F.any_value("source_text").alias("text")).select("group_id", F.lit(0).alias("source_index"), F.lit("").alias("source_path"), "text")
    got = ground_batch(rows.select(F.col(key).alias("claim_id"), "group_id", "claim"), sources, c)
    names = F.size("entities_absent")
    feats = verdict.calibrator_features(c, *(F.col(n) for n in ("exact_score", "fuzzy_score", "bm25_token_recall", "semantic_score", "semantic_ratio")), F.col("lexical_co_support"), names, F.greatest(names, F.lit(1)))
    lang = F.col("lang") if "lang" in records.columns else F.lit(None).cast("string")
    said = rows.select(F.col(key).alias("claim_id"), F.col("label").cast("double").alias("grounded"), lang.alias("lang"))
    return got.select("claim_id", *(v.cast("double").alias(k) for k, v in feats.items())).join(said, "claim_id").withColumnRenamed("claim_id", key)
