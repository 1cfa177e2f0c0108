"""Scores and verdicts, aggregations, windows, set operations, evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriscope.config import Settings
from veriscope.functions import text as T
from veriscope.operators import calibrate, consistency, evaluate, features, gold, ranks, verdict
from veriscope.plans.registry import S_MACRO, S_MEASURES, S_SCORED, big, query, s_counts, s_norm, s_ratio, s_set, scored, table

C = Settings(classifier_mode="absolute")

#: Stand-in scores of the layers from the one word overlap ``p`` (a fixed function of it), to exercise the expressions.
_LAYERS = f"WITH {S_SCORED}, y AS (SELECT *, CASE WHEN p >= 1 THEN 1.0 ELSE 0.0 END AS ex, least(1.0, p * 1.1) AS fu, p AS rc, p * 0.9 AS bm, p * 0.8 AS se, 0.75 + p / 5 AS ra FROM scored)"


def _layers(spark, sf):
    p = F.col("p")
    return scored(spark, sf).select("*", F.when(p >= 1, 1.0).otherwise(0.0).alias("ex"), F.least(F.lit(1.0), p * 1.1).alias("fu"), p.alias("rc"), (p * 0.9).alias("bm"), (p * 0.8).alias("se"), (0.75 + p / 5).alias("ra"))


def _l(*names):
    return [F.col(n) for n in names]


def _ramp(x, lo, hi):
    return f"least(1.0, greatest(0.0, ({x} - {lo}) / ({hi} - {lo})))"


_SEM = f"greatest({_ramp('se', 0.5, 1.0)}, {_ramp('ra', 0.8, 1.0)})"
_VOTES = "((ex >= 1)::INT + (fu >= 0.55)::INT + (rc >= 0.15)::INT + (se >= 0.7 OR ra >= 0.9)::INT)"
_AGREE = f"least(1.0, 0.3 * (ex >= 1)::INT + 0.25 * {_ramp('fu', 0.5, 1.0)} + 0.2 * {_ramp('rc', 0.0, 0.5)} + 0.25 * {_SEM} + CASE WHEN {_VOTES} >= 3 THEN 0.35 WHEN {_VOTES} = 2 THEN 0.2 ELSE 0.0 END)"
_LAYER = "CASE WHEN ex >= 1 THEN 'exact' WHEN greatest(fu, bm, se) <= 0 THEN 'semantic' WHEN fu = greatest(fu, bm, se) THEN 'fuzzy' WHEN bm = greatest(fu, bm, se) THEN 'bm25' ELSE 'semantic' END"


@query("fp28_ramp_fp29_agreement", f"{_LAYERS} SELECT row_id, round({_AGREE}, 6) AS agreement, {_VOTES} AS voters FROM y")
def _(spark, sf):
    y = _layers(spark, sf)
    a = _l("ex", "fu", "rc", "se", "ra")
    return y.select("row_id", F.round(verdict.agreement(C, *a), 6).alias("agreement"), verdict.voters(C, *a).alias("voters"))


@query("fp30_penalty_fp31_combined", f"{_LAYERS} SELECT row_id, round(CASE WHEN n_words > 0 AND n_words % 4 > 0 THEN greatest(0.0, {_AGREE} - 0.15 * (n_words % 4) / n_words) ELSE {_AGREE} END, 6) AS penalised, round(greatest(ex, fu, bm, se), 6) AS combined FROM y")
def _(spark, sf):
    y = _layers(spark, sf)
    pen = verdict.entity_penalty(C, verdict.agreement(C, *_l("ex", "fu", "rc", "se", "ra")), F.col("n_words") % 4, F.col("n_words"))
    return y.select("row_id", F.round(pen, 6).alias("penalised"), F.round(verdict.combined(*_l("ex", "fu", "bm", "se")), 6).alias("combined"))


@query("fp32_calibrator_features", f"{_LAYERS} SELECT row_id, round({_ramp('ra', 0.8, 1.0)}, 6) AS semantic, round(least(1.0, {_VOTES} / 4.0), 6) AS voters, (fu >= 0.4 OR rc >= 0.1)::DOUBLE AS lexical_cosupport FROM y")
def _(spark, sf):
    y = _layers(spark, sf)
    f = verdict.calibrator_features(C, *_l("ex", "fu", "rc", "se", "ra"), verdict.co_support(C, F.col("fu"), F.col("rc")), F.lit(0), F.lit(0))
    return y.select("row_id", F.round(f["semantic"], 6).alias("semantic"), F.round(f["voters"], 6).alias("voters"), f["lexical_cosupport"].alias("lexical_cosupport"))


@query("fp33_winning_passage", f"{_LAYERS} SELECT row_id, CASE WHEN ex = 1 THEN 'exact' WHEN se > 0 THEN 'semantic' WHEN bm > 0 THEN 'bm25' WHEN fu > 0 THEN 'fuzzy' ELSE 'whole' END AS passage FROM y")
def _(spark, sf):
    w = verdict.winning_passage(F.col("ex"), F.lit("exact"), F.col("se"), F.lit("semantic"), F.col("bm"), F.lit("bm25"), F.col("fu"), F.lit("fuzzy"), F.lit("whole"))
    return _layers(spark, sf).select("row_id", w.alias("passage"))


_CASC = f"CASE WHEN n_words % 7 = 0 AND greatest(ex, fu, bm, se) > 0 THEN 'contradicted' WHEN ex = 1 THEN 'exact' WHEN fu >= 0.85 THEN 'fuzzy' WHEN bm >= 0.5 THEN 'bm25' WHEN se >= 0.6 THEN 'semantic' WHEN {_AGREE} >= 0.45 THEN CASE WHEN se >= bm AND se >= fu THEN 'semantic' WHEN bm >= fu THEN 'bm25' WHEN fu > 0 THEN 'fuzzy' ELSE 'none' END ELSE 'none' END"


def _cascade(y):
    return verdict.cascade_verdict(C, *_l("ex", "fu", "bm", "se"), verdict.agreement(C, *_l("ex", "fu", "rc", "se", "ra")), F.col("n_words") % 7 == 0)


@query("fp35_cascade_verdict_fp53_bucket", f"{_LAYERS}, v AS (SELECT row_id, {_CASC} AS verdict FROM y) SELECT row_id, verdict, CASE verdict WHEN 'contradicted' THEN 'contradicted' WHEN 'none' THEN 'unconfirmed' ELSE 'grounded' END AS bucket FROM v")
def _(spark, sf):
    y = _layers(spark, sf)
    return y.select("row_id", _cascade(y).alias("verdict")).withColumn("bucket", verdict.bucket(F.col("verdict")))


@query("fp34_head_verdict_fp36_layer_fp41_threshold", f"{_LAYERS} SELECT row_id, CASE WHEN n_words % 7 = 0 AND greatest(ex, fu, bm, se) > 0 THEN 'contradicted' WHEN p >= CASE WHEN lang_norm <> 'en' THEN 0.6 ELSE 0.45 END THEN {_LAYER} ELSE 'none' END AS verdict FROM y")
def _(spark, sf):
    y = _layers(spark, sf).withColumn("is_en", (F.col("lang_norm") == "en").cast("double"))
    signal = F.greatest(*_l("ex", "fu", "bm", "se")) > 0
    return y.select("row_id", verdict.head_verdict(F.col("p"), features.threshold("low", 0.6), F.col("n_words") % 7 == 0, signal, verdict.winning_layer(*_l("ex", "fu", "bm", "se"))).alias("verdict"))


@query("fp37_reasons_fp38_support_fp39_final", f"{_LAYERS} SELECT row_id, CASE {_LAYER} WHEN 'fuzzy' THEN fu - 0.85 < 0.05 WHEN 'bm25' THEN bm - 0.5 < 0.05 WHEN 'semantic' THEN se - 0.6 < 0.05 ELSE false END AS near, round(CASE WHEN n_words % 2 = 0 THEN p ELSE greatest(ex, fu, bm, se) END, 4) AS final FROM y")
def _(spark, sf):
    y = _layers(spark, sf)
    layer = verdict.winning_layer(*_l("ex", "fu", "bm", "se"))
    r = verdict.verification_reasons(C, layer, *_l("fu", "bm", "se"), F.lit(0.6), F.lit(True), F.lit(0), F.lit(False))
    prob = F.when(F.col("n_words") % 2 == 0, F.col("p")).otherwise(-1.0)
    return y.select("row_id", F.array_contains(r, "near_threshold").alias("near"), verdict.final_score(prob, verdict.combined(*_l("ex", "fu", "bm", "se"))).alias("final"))


_J = "1 / (1 + exp(-(-5.186199 + 5.300125 * p + 1.037737 * fu + 2.216246 * se + 3.751941 * ra - 0.897544 * 0 - 0.630457 * 0 + 2.914284 * 0)))"


@query("fp42_joint_head_c22", f"{_LAYERS} SELECT row_id, round({_J}, 6) AS probability FROM y")
def _(spark, sf):
    y = _layers(spark, sf).select("row_id", F.col("p").alias("lex_p"), F.col("fu").alias("rr_max"), F.col("se").alias("nli_ent"), F.col("ra").alias("cos_max"), F.lit(0.0).alias("nli_contra"), F.lit(0.0).alias("lex_contra"), F.lit(0.0).alias("lex_blocked"))
    return y.select("row_id", F.round(features.logistic(features.JOINT[0], features.JOINT[1]), 6).alias("probability"))


@query("fp43_escalation_c33", f"{_LAYERS} SELECT row_id, (lang_norm <> 'en') OR p BETWEEN 0.129863 AND 0.986142 AS escalates FROM y")
def _(spark, sf):
    return _layers(spark, sf).select("row_id", verdict.escalates(F.col("p"), 0.129863, 0.986142, F.col("lang_norm") != "en").alias("escalates"))


@query("fp44_rule_combiners", f"{_LAYERS} SELECT row_id, p >= 0.5 AS recall_only, CASE WHEN lang_norm = 'en' THEN p >= 0.6 ELSE p >= 0.4 END AS recall_split, p >= 0.5 AND n_words % 7 <> 0 AS recall_contra FROM y")
def _(spark, sf):
    p = F.col("p")
    return _layers(spark, sf).select("row_id", (p >= 0.5).alias("recall_only"), F.when(F.col("lang_norm") == "en", p >= 0.6).otherwise(p >= 0.4).alias("recall_split"), ((p >= 0.5) & (F.col("n_words") % 7 != 0)).alias("recall_contra"))


@query("fp48_interactions_fp49_triage_fp59_blocked_fp63", f"{_LAYERS} SELECT row_id, round(p * fu, 6) AS p_fu, fu >= 0.5 AND n_words % 7 = 0 AS triage, CASE WHEN lang_norm = 'none' THEN 0.0 ELSE p END AS unblocked, CASE WHEN n_words >= 8 THEN (p >= 0.5)::INT ELSE 1 END AS admitted FROM y")
def _(spark, sf):
    p = F.col("p")
    return _layers(spark, sf).select("row_id", F.round(p * F.col("fu"), 6).alias("p_fu"), ((F.col("fu") >= 0.5) & (F.col("n_words") % 7 == 0)).alias("triage"), F.when(F.col("lang_norm") == "none", 0.0).otherwise(p).alias("unblocked"), F.when(F.col("n_words") >= 8, (p >= 0.5).cast("int")).otherwise(1).alias("admitted"))


@query("fp55_query_fp56_compound_fp57_isin_fp58_dropna", "SELECT uid, lang FROM gold WHERE origin = 'inherited' AND label = 0 AND lang IN ('en', 'fr', 'nb') AND group_id IS NOT NULL AND source_text IS NOT NULL")
def _(spark, sf):
    g = table(spark, sf, "gold").filter("origin = 'inherited'").filter((F.col("label") == 0) & F.col("lang").isin("en", "fr", "nb"))
    return g.dropna(subset=["group_id", "source_text"]).select("uid", "lang")


@query("fp60_reindex", f"WITH {S_SCORED} SELECT row_id, p AS exact, 0.0 AS nli_entail FROM scored")
def _(spark, sf):
    s = scored(spark, sf).withColumnRenamed("p", "exact")
    have = [f for f in ("exact", "nli_entail") if f in s.columns]
    return s.select("row_id", *(F.col(f) if f in have else F.lit(0.0).alias(f) for f in ("exact", "nli_entail")))


# aggregations

_SAID = f"WITH {S_SCORED}, z AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS said FROM scored)"


def _said(spark, sf):
    return scored(spark, sf).withColumn("said", F.when(F.col("p") >= 0.5, 1).otherwise(0))


def _counts(df, *keys):
    return evaluate.confusion(df, list(keys), F.col("label"), F.col("said"))


@query("a3_prf_a4_macro_f1_a6_a7", f"{_SAID}, c AS (SELECT {s_counts()} FROM z) SELECT *, {S_MEASURES} FROM c")
def _(spark, sf):
    return evaluate.measures(_counts(_said(spark, sf)))


@query("a5_by_language_a9_slices_c8", f"{_SAID}, c AS (SELECT lang_norm, {s_counts()} FROM z GROUP BY 1) SELECT *, {S_MEASURES} FROM c")
def _(spark, sf):
    return evaluate.measures(_counts(_said(spark, sf), "lang_norm"))


@query("a5_rollup", f"{_SAID} SELECT coalesce(lang_norm, 'all') AS scope, grouping(lang_norm)::INT AS total, count(*) AS n, sum(said)::BIGINT AS said FROM z GROUP BY ROLLUP (lang_norm)")
def _(spark, sf):
    r = _said(spark, sf).rollup("lang_norm").agg(F.grouping("lang_norm").cast("int").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("said").alias("said"))
    return r.select(F.coalesce("lang_norm", F.lit("all")).alias("scope"), "total", "n", "said")


@query("a8_counts_at_thresholds", f"WITH {S_SCORED}, t AS (SELECT unnest([0.25, 0.5, 0.75]) AS threshold), z AS (SELECT threshold, label, (p >= threshold)::INT AS said FROM scored, t WHERE label IS NOT NULL) SELECT threshold::DOUBLE AS threshold, {s_counts()} FROM z GROUP BY 1")
def _(spark, sf):
    return evaluate.scan(scored(spark, sf), [], "p", "label", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


@query("a10_matrix", f"{_SAID} SELECT label, count(*) FILTER (WHERE said = 0) AS said_0, count(*) FILTER (WHERE said = 1) AS said_1 FROM z GROUP BY 1")
def _(spark, sf):
    m = _said(spark, sf).groupBy("label").pivot("said", [0, 1]).agg(F.count(F.lit(1)))
    return m.select("label", F.coalesce("0", F.lit(0)).alias("said_0"), F.coalesce("1", F.lit(0)).alias("said_1"))


_AUC = """r AS (SELECT {k} p, label, rank() OVER (PARTITION BY {pk} ORDER BY p) + (count(*) OVER (PARTITION BY {pk}, p) - 1) / 2.0 AS r FROM scored WHERE label IS NOT NULL)"""


@query("a11_auc", f"WITH {S_SCORED}, {_AUC.format(k='', pk='1')} SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS auc FROM r")
def _(spark, sf):
    return evaluate.auc(scored(spark, sf), [], "p", "label").select(F.round("auc", 6).alias("auc"))


@query("a12_cohens_d", f"WITH {S_SCORED} SELECT role, round((avg(p) FILTER (WHERE label = 1) - avg(p) FILTER (WHERE label = 0)) / sqrt((var_pop(p) FILTER (WHERE label = 1) + var_pop(p) FILTER (WHERE label = 0)) / 2), 6) AS d FROM scored GROUP BY 1")
def _(spark, sf):
    return evaluate.cohens_d(scored(spark, sf), ["role"], "p", "label").select("role", F.round("d", 6).alias("d"))


@query("a13_kappa", f"{_SAID}, k AS (SELECT label AS x, said AS y, count(*) AS c FROM z WHERE label IS NOT NULL GROUP BY 1, 2), n AS (SELECT sum(c) AS n, sum(c) FILTER (WHERE x = y) AS s FROM k), e AS (SELECT sum(a.r * b.s) AS e FROM (SELECT x, sum(c) AS r FROM k GROUP BY 1) a JOIN (SELECT y, sum(c) AS s FROM k GROUP BY 1) b ON a.x = b.y) SELECT n::BIGINT AS n, round(s / n, 6) AS agreement, round((s / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n, e")
def _(spark, sf):
    k = evaluate.kappa(_said(spark, sf), "label", "said")
    return k.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("a14_phi_a36_correlation", f"{_SAID} SELECT round(corr((said <> label)::INT, (n_words % 3 = 0)::INT), 6) AS phi, round(corr(p, n_words), 6) AS parity FROM z WHERE label IS NOT NULL")
def _(spark, sf):
    z = _said(spark, sf).filter("label is not null")
    return z.agg(F.round(F.corr((F.col("said") != F.col("label")).cast("double"), (F.col("n_words") % 3 == 0).cast("double")), 6).alias("phi"), F.round(F.corr("p", "n_words"), 6).alias("parity"))


@query("a15_group_sums", "SELECT origin, count(*) AS n, sum(label)::BIGINT AS supported FROM gold GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "gold").groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("supported"))


@query("a16_value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("a17_nunique", "SELECT count(DISTINCT group_id) AS n_groups, count(DISTINCT claim) AS n_claims FROM gold")
def _(spark, sf):
    return table(spark, sf, "gold").agg(F.count_distinct("group_id").alias("n_groups"), F.count_distinct("claim").alias("n_claims"))


@query("a18_by_language", f"{_SAID} SELECT lang_norm, count(*) AS n, round(avg(p), 6) AS mean, round(avg((said = 0)::INT), 6) AS rejected FROM z GROUP BY 1")
def _(spark, sf):
    return _said(spark, sf).groupBy("lang_norm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.avg((F.col("said") == 0).cast("int")), 6).alias("rejected"))


@query("a19_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    q = ranks.quantiles(e, ["event_type"], "value", [0.5, 0.9]).groupBy("event_type").pivot("q", [0.5, 0.9]).agg(F.round(F.max("value"), 6)).toDF("t", "median", "p90")
    mean = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return mean.join(q, F.col("event_type").eqNullSafe(F.col("t")), "left").select("event_type", "median", "p90", "mean")


@query("a20_pivot", f"WITH {S_SCORED} SELECT lang_norm, round(avg(p) FILTER (WHERE role = 'eval'), 6) AS eval, round(avg(p) FILTER (WHERE role = 'augmentation'), 6) AS augmentation FROM scored GROUP BY 1")
def _(spark, sf):
    m = scored(spark, sf).groupBy("lang_norm").pivot("role", ["eval", "augmentation"]).avg("p")
    return m.select("lang_norm", F.round("eval", 6).alias("eval"), F.round("augmentation", 6).alias("augmentation"))


@query("a18_mean_and_sd", f"WITH {S_SCORED} SELECT lang_norm, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd FROM scored GROUP BY 1")
def _(spark, sf):
    return scored(spark, sf).groupBy("lang_norm").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev("p"), 6).alias("sd"))


@query("a22_numeric_consistency", None)
def _(spark, sf):
    return consistency.numeric(table(spark, sf, "documents"), "doc_id").select("doc_id", "category", "n_values", F.size("occurrences").alias("n"))


@query("a23_name_variants", None)
def _(spark, sf):
    return consistency.name_variants(table(spark, sf, "documents"), "doc_id")


@query("a24_sets", None)
def _(spark, sf):
    return consistency.sets(table(spark, sf, "documents"), "doc_id")


@query("a25_set_pairs_j16_u4", None)
def _(spark, sf):
    return consistency.set_pairs(table(spark, sf, "documents"), "doc_id")


@query("a26_consistency_k6_report", None)
def _(spark, sf):
    return consistency.report(consistency.check(table(spark, sf, "documents"), "doc_id"), "doc_id")


@query("a15_least_and_missed", f"{_SAID} SELECT group_id, round(min(p), 6) AS least, max((said = 0)::INT) AS any_miss, sum(said)::BIGINT AS k, count(*) AS n FROM z GROUP BY 1")
def _(spark, sf):
    return _said(spark, sf).groupBy("group_id").agg(F.round(F.min("p"), 6).alias("least"), F.max((F.col("said") == 0).cast("int")).alias("any_miss"), F.sum("said").alias("k"), F.count(F.lit(1)).alias("n"))


@query("a5_blended_score", f"{_SAID}, c AS (SELECT lang_norm, {s_counts()}, min(p) FILTER (WHERE label = 1) AS lo, max(p) FILTER (WHERE label = 0) AS hi FROM z GROUP BY 1) SELECT lang_norm, round({s_ratio('tp+tn', 'tp+fp+fn+tn')} + 0.25 * {s_ratio('tp', 'tp+fn')} + 0.25 * least(1.0, greatest(0.0, coalesce(lo - hi, 0) / 0.1)), 6) AS score FROM c")
def _(spark, sf):
    z = _said(spark, sf)
    gap = z.groupBy("lang_norm").agg(F.min(F.when(F.col("label") == 1, F.col("p"))).alias("lo"), F.max(F.when(F.col("label") == 0, F.col("p"))).alias("hi"))
    c = _counts(z, "lang_norm").join(gap, "lang_norm")
    r = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = _l("tp", "fp", "fn", "tn")
    return c.select("lang_norm", F.round(r(tp + tn, tp + fp + fn + tn) + 0.25 * r(tp, tp + fn) + 0.25 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("lo") - F.col("hi"), F.lit(0.0)) / 0.1)), 6).alias("score"))


@query("a32_error_concentration_a33_asymmetry", f"{_SAID}, e AS (SELECT (said <> label)::INT AS err, (n_words > 20)::INT AS long, label, said FROM z WHERE label IS NOT NULL) SELECT round(avg(err) FILTER (WHERE long = 1), 6) AS long_rate, round(avg(err) FILTER (WHERE long = 0), 6) AS short_rate, count(*) FILTER (WHERE err = 1 AND said = 1) AS false_accepts, count(*) FILTER (WHERE err = 1 AND said = 0) AS false_rejects FROM e")
def _(spark, sf):
    e = _said(spark, sf).filter("label is not null").withColumn("err", (F.col("said") != F.col("label")).cast("int")).withColumn("long", F.col("n_words") > 20)
    return e.agg(F.round(F.avg(F.when(F.col("long"), F.col("err"))), 6).alias("long_rate"), F.round(F.avg(F.when(~F.col("long"), F.col("err"))), 6).alias("short_rate"), F.count_if((F.col("err") == 1) & (F.col("said") == 1)).alias("false_accepts"), F.count_if((F.col("err") == 1) & (F.col("said") == 0)).alias("false_rejects"))


@query("a34_standardised", f"WITH {S_SCORED}, m AS (SELECT avg(p) AS m, stddev_pop(p) AS s FROM scored) SELECT row_id, round((p - m) / s, 5) AS z FROM scored, m")
def _(spark, sf):
    s = scored(spark, sf)
    m = s.agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("s"))
    return s.crossJoin(F.broadcast(m)).select("row_id", F.round((F.col("p") - F.col("m")) / F.col("s"), 5).alias("z"))  # one row


@query("a35_feature_audit", f"WITH {S_SCORED}, u AS (SELECT 'p' AS feature, p AS v, label FROM scored UNION ALL SELECT 'n_words', n_words, label FROM scored), r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM u WHERE label IS NOT NULL) SELECT feature, round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS auc FROM r GROUP BY 1")
def _(spark, sf):
    u = scored(spark, sf).select("label", F.col("p"), F.col("n_words").cast("double").alias("n_words")).unpivot(["label"], ["p", "n_words"], "feature", "v")
    return evaluate.auc(u, ["feature"], "v", "label").select("feature", F.round("auc", 6).alias("auc"))


@query("a37_ensembles", f"{_SAID} SELECT row_id, p >= 0.5 OR n_words > 25 AS any_of, ((p >= 0.5)::INT + (n_words > 25)::INT + (lang_norm = 'en')::INT) >= 2 AS majority FROM z")
def _(spark, sf):
    a, b, c = F.col("p") >= 0.5, F.col("n_words") > 25, F.col("lang_norm") == "en"
    return _said(spark, sf).select("row_id", (a | b).alias("any_of"), (a.cast("int") + b.cast("int") + c.cast("int") >= 2).alias("majority"))


_G19 = "g AS (SELECT unnest(list_transform(range(0, 19), lambda i: round(0.05 + i * 0.9 / 18, 6))) AS threshold)"


@query("a38_detection_sweep", f"WITH {S_SCORED}, {_G19}, z AS (SELECT threshold, 1 - label AS t, (p < threshold)::INT AS said FROM scored, g WHERE label IS NOT NULL), c AS (SELECT threshold, {s_counts('t', 'said')} FROM z GROUP BY 1), r AS (SELECT threshold, {s_ratio('tp', 'tp+fn')} AS rec, {s_ratio('fp', 'fp+tn')} AS ff FROM c) SELECT arg_min(threshold, struct_pack(a := ff, b := threshold))::DOUBLE AS threshold, round(min(ff), 6) AS false_flag FROM r WHERE rec >= 0.85")
def _(spark, sf):
    c = evaluate.scan(scored(spark, sf), [], "p", "label", evaluate.grid(0.05, 0.95, 19))
    # hallucinations are what is detected: below the threshold
    r = c.select("threshold", (F.col("tn") / (F.col("tn") + F.col("fp"))).alias("rec"), (F.col("fn") / (F.col("fn") + F.col("tp"))).alias("ff")).filter("rec >= 0.85")
    return r.agg(F.min_by("threshold", F.struct("ff", "threshold")).alias("threshold"), F.round(F.min("ff"), 6).alias("false_flag"))


@query("a39_triage", f"{_LAYERS}, t AS (SELECT fu >= 0.5 AND n_words % 7 = 0 AS flag, label FROM y WHERE label IS NOT NULL) SELECT round(avg(flag::INT), 6) AS coverage, round(avg((label = 0)::INT) FILTER (WHERE flag), 6) AS precision FROM t")
def _(spark, sf):
    t = _layers(spark, sf).filter("label is not null").select(((F.col("fu") >= 0.5) & (F.col("n_words") % 7 == 0)).alias("flag"), "label")
    return t.agg(F.round(F.avg(F.col("flag").cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(F.col("flag"), (F.col("label") == 0).cast("int"))), 6).alias("precision"))


# windows, order, sets

_GAP = """n AS (SELECT lang_norm AS k, p, row_id, row_number() OVER w AS i, lead(p) OVER w AS nx, count(*) OVER (PARTITION BY lang_norm) AS n FROM scored WINDOW w AS (PARTITION BY lang_norm ORDER BY p, row_id)), g AS (SELECT *, round(nx - p, 9) AS gap FROM n WHERE nx IS NOT NULL AND n >= 4 {half})"""


@query("w3_adaptive_gap", f"WITH {S_SCORED}, {_GAP.format(half='AND i <= greatest(2, (n + 1) // 2)')} SELECT k AS lang_norm, round(arg_max((p + nx) / 2, struct_pack(a := gap, b := i)), 6) AS threshold, max(gap) AS gap FROM g GROUP BY 1")
def _(spark, sf):
    return evaluate.adaptive_gap(scored(spark, sf), "lang_norm", "p", "row_id").select("lang_norm", F.round("threshold", 6).alias("threshold"), "gap")


@query("w4_max_gap", f"WITH {S_SCORED}, {_GAP.format(half='')} SELECT k AS lang_norm, max(gap) AS gap FROM g GROUP BY 1")
def _(spark, sf):
    return evaluate.adaptive_gap(scored(spark, sf), "lang_norm", "p", "row_id", bottom_half=False).select("lang_norm", "gap")


@query("w5_jenks", f"""WITH {S_SCORED}, t AS (SELECT lang_norm, p, row_number() OVER w AS i, sum(p) OVER w AS s, sum(p * p) OVER w AS q, count(*) OVER a AS n, sum(p) OVER a AS ss, sum(p * p) OVER a AS qq, lead(p) OVER w AS nx FROM scored WINDOW w AS (PARTITION BY lang_norm ORDER BY p, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY lang_norm))
 SELECT lang_norm, round(min(round(q - s * s / i + (qq - q) - (ss - s) * (ss - s) / (n - i), 9)), 5) AS sse FROM t WHERE nx IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    from pyspark.sql import Window as W

    j = evaluate.jenks(scored(spark, sf), "lang_norm", "p", "row_id")
    s = scored(spark, sf).join(j, "lang_norm").withColumn("side", F.col("p") > F.col("threshold"))
    m = F.avg("p").over(W.partitionBy("lang_norm", "side"))
    return s.withColumn("d", (F.col("p") - m) * (F.col("p") - m)).groupBy("lang_norm").agg(F.round(F.sum("d"), 5).alias("sse"))


@query("w10_first", f"SELECT md5({s_norm('claim')}) AS k, arg_min(uid, row_id) AS uid FROM gold WHERE claim IS NOT NULL GROUP BY 1")
def _(spark, sf):
    g = table(spark, sf, "gold").filter("claim is not null").withColumn("k", F.md5(T.normalize_whitespace("claim")))
    return gold.first_by(g, ["k"], ["row_id"]).select("k", "uid")


@query("w8_running_total", "SELECT judgment_id, uid, row_number() OVER (PARTITION BY uid ORDER BY received_at, judgment_id, annotator_id, label, judged_at) AS n FROM judgments")
def _(spark, sf):
    w = Window.partitionBy("uid").orderBy(F.asc("received_at"), "judgment_id", "annotator_id", F.col("label").asc_nulls_last(), "judged_at")
    return table(spark, sf, "judgments").select("judgment_id", "uid", big(F.row_number().over(w)).alias("n"))


@query("t3_blank_lines", "SELECT doc_id, sum((trim(line) = '')::INT)::BIGINT AS blanks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", big(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) == ""))).alias("blanks"))


@query("w11_first_n_c27_balanced", "SELECT uid, label FROM (SELECT uid, label, row_number() OVER (PARTITION BY label ORDER BY row_id) AS r FROM gold WHERE label IS NOT NULL) WHERE r <= 100")
def _(spark, sf):
    return gold.first_n(table(spark, sf, "gold").filter("label is not null"), ["label"], ["row_id"], 100).select("uid", "label")


@query("w12_folds", "SELECT uid, (row_number() OVER (PARTITION BY label ORDER BY row_id) - 1) % 5 AS fold FROM gold")
def _(spark, sf):
    return gold.round_robin(table(spark, sf, "gold"), ["label"], ["row_id"], 5).select("uid", big("fold").alias("fold"))


@query("o4_ranked", f"WITH {S_SCORED}, m AS (SELECT lang_norm, count(*) AS n, round(avg(p), 6) AS mean FROM scored GROUP BY 1) SELECT lang_norm, n, row_number() OVER (ORDER BY mean DESC, lang_norm) AS rank FROM m")
def _(spark, sf):
    m = scored(spark, sf).groupBy("lang_norm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean"))
    return m.select("lang_norm", "n", big(F.row_number().over(Window.orderBy(F.desc("mean"), "lang_norm"))).alias("rank"))  # a row a language


@query("o5_head", "SELECT uid, row_id FROM gold ORDER BY row_id LIMIT 20")
def _(spark, sf):
    return table(spark, sf, "gold").orderBy("row_id").limit(20).select("uid", "row_id")


@query("o6_c12_c29_ranked_grid", f"WITH {S_SCORED}, g AS (SELECT unnest([0.3, 0.5, 0.7]) AS t), h AS (SELECT unnest([5, 10, 20]) AS w), z AS (SELECT t, w, label, (p >= t AND n_words >= w)::INT AS said FROM scored, g, h WHERE label IS NOT NULL), c AS (SELECT t, w, {s_counts()} FROM z GROUP BY 1, 2), m AS (SELECT t, w, {S_MACRO} AS macro_f1 FROM c) SELECT t::DOUBLE AS t, w, macro_f1, row_number() OVER (ORDER BY macro_f1 DESC, t, w) AS rank FROM m")
def _(spark, sf):
    s = scored(spark, sf).filter("label is not null")
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t in (0.3, 0.5, 0.7) for w in (5, 10, 20)]))
    # nine settings, counted with map-side combination
    z = s.withColumn("x", cells).select(F.col("x.t").alias("t"), F.col("x.w").alias("w"), "label", ((F.col("p") >= F.col("x.t")) & (F.col("n_words") >= F.col("x.w"))).cast("int").alias("said"))
    m = evaluate.measures(_counts(z, "t", "w")).select("t", "w", "macro_f1")
    return m.withColumn("rank", big(F.row_number().over(Window.orderBy(F.desc("macro_f1"), "t", "w"))))


@query("u1_union_u2_tagged", "SELECT 'gold' AS corpus, uid AS k, claim FROM gold UNION ALL SELECT 'extracted', claim_key, claim FROM extracted_claims")
def _(spark, sf):
    a = table(spark, sf, "gold").select(F.lit("gold").alias("corpus"), F.col("uid").alias("k"), "claim")
    return a.unionByName(table(spark, sf, "extracted_claims").select(F.lit("extracted").alias("corpus"), F.col("claim_key").alias("k"), "claim"))


@query("u3_distinct", "SELECT DISTINCT group_id, origin FROM gold")
def _(spark, sf):
    return table(spark, sf, "gold").select("group_id", "origin").distinct()


@query("u5_difference", f"SELECT row_id, len(list_filter({s_set('claim')}, lambda z: NOT list_contains({s_set('source_text')}, z))) AS n_absent FROM gold")
def _(spark, sf):
    return table(spark, sf, "gold").select("row_id", big(F.size(F.array_except(T.token_set("claim"), T.token_set("source_text")))).alias("n_absent"))


@query("u6_unused_claims", "SELECT claim FROM extracted_claims WHERE claim IS NOT NULL EXCEPT SELECT claim FROM gold")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").filter("claim is not null").select("claim").subtract(table(spark, sf, "gold").select("claim"))


@query("u7_complete", "SELECT uid, count(DISTINCT annotator_id) >= 3 AS complete FROM judgments GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "judgments").groupBy("uid").agg((F.count_distinct("annotator_id") >= 3).alias("complete"))


@query("u8_c30_replicated", "SELECT uid, label, unnest(range(1, CASE WHEN label = 0 THEN 3 ELSE 2 END)) AS copy FROM gold WHERE label IS NOT NULL")
def _(spark, sf):
    r = gold.replicate(table(spark, sf, "gold").filter("label is not null"), "label", {0: 2})
    return r.select("uid", "label", big("copy").alias("copy"))


# training and evaluation dataflow


def _grid_sql(lo, hi, n):
    return f"g AS (SELECT unnest(list_transform(range(0, {n}), lambda i: round({lo} + i * {hi - lo} / {n - 1}, 6))) AS threshold)"


_BEST = "arg_min(threshold, struct_pack(a := -macro_f1, b := threshold))::DOUBLE AS threshold, max(macro_f1) AS macro_f1"


@query("c11_best_threshold_c39", f"WITH {S_SCORED}, {_grid_sql(0.02, 0.98, 97)}, z AS (SELECT threshold, label, (p >= threshold)::INT AS said FROM scored, g WHERE label IS NOT NULL), c AS (SELECT threshold, {s_counts()} FROM z GROUP BY 1), m AS (SELECT threshold, {S_MACRO} AS macro_f1 FROM c) SELECT {_BEST} FROM m")
def _(spark, sf):
    return evaluate.best_threshold(evaluate.scan(scored(spark, sf), [], "p", "label", evaluate.grid(0.02, 0.98, 97)), [])


@query("c34_by_language", f"WITH {S_SCORED}, {_grid_sql(0.2, 0.8, 13)}, z AS (SELECT lang_norm, threshold, label, (p >= threshold)::INT AS said FROM scored, g WHERE label IS NOT NULL), c AS (SELECT lang_norm, threshold, {s_counts()}, count(*) AS n FROM z GROUP BY 1, 2), m AS (SELECT lang_norm, n, threshold, {S_MACRO} AS macro_f1 FROM c) SELECT lang_norm, {_BEST} FROM m WHERE n >= 40 GROUP BY 1")
def _(spark, sf):
    c = evaluate.scan(scored(spark, sf), ["lang_norm"], "p", "label", evaluate.grid(0.2, 0.8, 13)).filter(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= 40)
    return evaluate.best_threshold(c, ["lang_norm"])


@query("c13_leave_one_out", f"WITH {S_SCORED}, {_grid_sql(0.2, 0.8, 13)}, k AS (SELECT DISTINCT lang_norm AS held FROM scored WHERE label IS NOT NULL), z AS (SELECT held, threshold, label, (p >= threshold)::INT AS said FROM scored JOIN k ON lang_norm <> held CROSS JOIN g WHERE label IS NOT NULL), c AS (SELECT held, threshold, {s_counts()} FROM z GROUP BY 1, 2), m AS (SELECT held, threshold, {S_MACRO} AS macro_f1 FROM c) SELECT held AS lang_norm, {_BEST} FROM m GROUP BY 1")
def _(spark, sf):
    return evaluate.leave_one_out(scored(spark, sf), "lang_norm", "p", "label", evaluate.grid(0.2, 0.8, 13))


@query("c32_held_out_accuracy", f"WITH {S_SCORED}, {_grid_sql(0.2, 0.8, 13)}, k AS (SELECT DISTINCT lang_norm AS held FROM scored WHERE label IS NOT NULL), z AS (SELECT held, threshold, label, (p >= threshold)::INT AS said FROM scored JOIN k ON lang_norm <> held CROSS JOIN g WHERE label IS NOT NULL), c AS (SELECT held, threshold, {s_counts()} FROM z GROUP BY 1, 2), m AS (SELECT held, threshold, {S_MACRO} AS macro_f1 FROM c), t AS (SELECT held, {_BEST} FROM m GROUP BY 1) SELECT lang_norm, round(avg(((p >= threshold)::INT = label)::INT), 6) AS accuracy, count(*) AS n FROM scored JOIN t ON lang_norm = held WHERE label IS NOT NULL GROUP BY 1")
def _(spark, sf):
    s, grid = scored(spark, sf), evaluate.grid(0.2, 0.8, 13)
    tuned = evaluate.leave_one_out(s, "lang_norm", "p", "label", grid).select("lang_norm", "threshold")
    tp, fp, fn, tn = _l("tp", "fp", "fn", "tn")
    own = evaluate.scan(s, ["lang_norm"], "p", "label", grid).join(tuned, ["lang_norm", "threshold"])  # the counts that tuning has made already
    return own.select("lang_norm", F.round((tp + tn) / (tp + fp + fn + tn), 6).alias("accuracy"), (tp + fp + fn + tn).alias("n"))


@query("c14_halves", "SELECT label, half, count(*) AS n FROM (SELECT label, ntile(2) OVER (PARTITION BY label ORDER BY md5(uid), uid) AS half FROM gold) GROUP BY 1, 2")
def _(spark, sf):
    g = table(spark, sf, "gold").select("label", "uid", F.md5("uid").alias("d"))
    return gold.halves(g, ["label"], ["d", "uid"]).withColumn("half", big("half")).groupBy("label", "half").agg(F.count(F.lit(1)).alias("n"))


@query("c15_group_folds", None)
def _(spark, sf):
    s = scored(spark, sf).filter("label is not null").withColumn("fold", F.pmod(F.xxhash64("group_id"), F.lit(3)).cast("int"))
    out = None
    for k in range(3):
        head = calibrate.fit(s.filter(F.col("fold") != k), ["p", "n_words"], "label")
        part = s.filter(F.col("fold") == k).select("row_id", "fold", head.probability().alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


@query("c18_nine_bands", f"WITH {S_SCORED}, q AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.7, 0.8, 0.9]) AS q FROM scored WHERE label IS NOT NULL), b AS (SELECT unnest(q[1:3]) AS lo, q FROM q), bb AS (SELECT lo, unnest(q[4:6]) AS hi FROM b), z AS (SELECT lo, hi, label, (CASE WHEN p < lo THEN 0 WHEN p > hi THEN 1 ELSE (n_words >= 15)::INT END) AS said, (p BETWEEN lo AND hi)::INT AS esc FROM scored, bb WHERE label IS NOT NULL), c AS (SELECT lo, hi, {s_counts()}, avg(esc) AS share FROM z GROUP BY 1, 2) SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, {S_MACRO} AS macro_f1, round(share, 6) AS share FROM c")
def _(spark, sf):
    s = scored(spark, sf).filter("label is not null")
    q = s.agg(F.percentile("p", F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.7, 0.8, 0.9)))).alias("q")).first()["q"]
    cells = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a in q[:3] for b in q[3:]])
    z = s.withColumn("x", F.explode(F.array_distinct(cells))).select("label", "x.*", "p", "n_words")
    said = F.when(F.col("p") < F.col("lo"), 0).when(F.col("p") > F.col("hi"), 1).otherwise((F.col("n_words") >= 15).cast("int"))
    z = z.withColumn("said", said).withColumn("esc", F.col("p").between(F.col("lo"), F.col("hi")).cast("int"))
    share = z.groupBy("lo", "hi").agg(F.round(F.avg("esc"), 6).alias("share"))
    m = evaluate.measures(_counts(z, "lo", "hi")).join(share, ["lo", "hi"])
    return m.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "macro_f1", "share")


@query("c23_wirings", f"{_LAYERS}, v AS (SELECT label, (p >= 0.45)::INT AS lexical, (CASE WHEN p BETWEEN 0.129863 AND 0.986142 THEN ({_J} >= 0.579798)::INT ELSE (p >= 0.45)::INT END) AS w1, ({_J} >= 0.579798)::INT AS w2 FROM y WHERE label IS NOT NULL), u AS (SELECT 'lexical' AS wiring, label, lexical AS said FROM v UNION ALL SELECT 'w1', label, w1 FROM v UNION ALL SELECT 'w2', label, w2 FROM v) SELECT wiring, {s_counts()} FROM u GROUP BY 1")
def _(spark, sf):
    y = _layers(spark, sf).filter("label is not null")
    y = y.withColumns({"lex_p": F.col("p"), "rr_max": F.col("fu"), "nli_ent": F.col("se"), "cos_max": F.col("ra"), "nli_contra": F.lit(0.0), "lex_contra": F.lit(0.0), "lex_blocked": F.lit(0.0)})
    joint = (features.logistic(features.JOINT[0], features.JOINT[1]) >= features.JOINT[2]).cast("int")
    lexical = (F.col("p") >= 0.45).cast("int")
    v = y.select("label", lexical.alias("lexical"), F.when(verdict.escalates(F.col("p"), 0.129863, 0.986142), joint).otherwise(lexical).alias("w1"), joint.alias("w2"))
    return _counts(v.unpivot(["label"], ["lexical", "w1", "w2"], "wiring", "said"), "wiring")


@query("c24_gold_build", f"""SELECT row_id, 'eval_' || lpad(row_id::VARCHAR, 9, '0') AS uid, 'eval' AS role, string_split(lower(lang), '-')[1] AS lang_norm, substr(sha1(coalesce(source_text, '')), 1, 12) AS group_hash, label
 FROM (SELECT *, row_number() OVER (PARTITION BY md5({s_norm('claim')} || chr(31) || coalesce(source_text, '')) ORDER BY row_id) AS r FROM gold) WHERE r = 1""")
def _(spark, sf):
    return gold.build(table(spark, sf, "gold"))


@query("c26_negatives", "SELECT uid FROM gold WHERE label = 0 AND string_split(lower(lang), '-')[1] = 'en' AND claim NOT IN (SELECT claim FROM extracted_claims WHERE claim IS NOT NULL)")
def _(spark, sf):
    g = table(spark, sf, "gold").filter((F.col("label") == 0) & (T.lang_base("lang") == "en"))
    return g.join(table(spark, sf, "extracted_claims").select("claim"), "claim", "left_anti").select("uid")


@query("c3_short_sources", None)
def _(spark, sf):
    return gold.shortest_overlap(table(spark, sf, "gold").filter("source_text is not null"), "row_id", "claim", "source_text")


@query("c4_c5_calibrated_c7_c9", None)
def _(spark, sf):
    s = _layers(spark, sf).filter("label is not null").select("row_id", "label", F.col("ex").alias("exact"), F.col("fu").alias("fuzzy"), F.col("rc").alias("bm25_recall"))
    head = calibrate.fit(s, calibrate.varying(s, ["exact", "fuzzy", "bm25_recall"]), "label", calibrate.PRIOR)
    head = calibrate.update(head, s, "label")
    return s.select("row_id", head.probability().alias("probability"))


@query("c2_balanced_fit_c21", None)
def _(spark, sf):
    s = scored(spark, sf).filter("label is not null").withColumn("n_words", F.col("n_words").cast("double"))
    head = calibrate.fit_balanced(s, ["p", "n_words"], "label")
    return calibrate.evaluate(head, s, "label", "lang_norm")


@query("a16_languages_of_forty", "SELECT lang_norm, count(*) AS n FROM gold WHERE lang_norm IS NOT NULL GROUP BY 1 HAVING count(*) >= 40")
def _(spark, sf):
    return table(spark, sf, "gold").filter("lang_norm is not null").groupBy("lang_norm").agg(F.count(F.lit(1)).alias("n")).filter("n >= 40")


@query("c37_abstain", f"{_SAID}, k AS (SELECT *, p < 0.4 OR p > 0.6 AS covered FROM z WHERE label IS NOT NULL), c AS (SELECT {s_counts()} FROM k WHERE covered) SELECT round((SELECT avg(covered::INT) FROM k), 6) AS coverage, {S_MACRO} AS macro_f1 FROM c")
def _(spark, sf):
    k = _said(spark, sf).filter("label is not null").withColumn("covered", (F.col("p") < 0.4) | (F.col("p") > 0.6))
    m = evaluate.measures(_counts(k.filter("covered"))).select("macro_f1")
    return k.agg(F.round(F.avg(F.col("covered").cast("int")), 6).alias("coverage")).crossJoin(m)  # one row each


@query("c1_feature_frame_c28", None)
def _(spark, sf):
    g = table(spark, sf, "gold").filter("label is not null")
    return features.low_tier(g, features.rarity(table(spark, sf, "sources"))).join(g.select("row_id", F.col("label").alias("grounded")), "row_id")


@query("c35_chunk_sweep", None)
def _(spark, sf):
    g = table(spark, sf, "gold").filter("label is not null and source_text is not null").select("row_id", "label", T.token_set("claim").alias("c"), "source_text")
    out = None
    for size, overlap in ((300, 30), (1000, 100)):
        best = F.array_max(F.transform(T.char_windows("source_text", size, overlap), lambda w: T.overlap(F.col("c"), T.token_set(w))))
        a = evaluate.auc(g.withColumn("s", F.round(best, 6)), [], "s", "label").select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "auc")
        out = a if out is None else out.unionByName(a)
    return out


# sinks


@query("k1_parquet_roundtrip", "SELECT uid, label FROM gold")
def _(spark, sf):
    from veriscope.plans.shared import Workspace

    return Workspace(spark, "roundtrip").save(table(spark, sf, "gold").select("uid", "label"), "gold")


@query("k4_keys_of_json", "SELECT claim_key, count(*) AS n FROM extracted_claims GROUP BY 1")
def _(spark, sf):
    from veriscope.sources.writers import full_json

    j = full_json(table(spark, sf, "extracted_claims").select("claim_key", "claim"))
    return j.select(F.get_json_object("json", "$.claim_key").alias("claim_key")).groupBy("claim_key").agg(F.count(F.lit(1)).alias("n"))


@query("k5_one_line", f"WITH {S_SCORED} SELECT printf('[%s] %s score=%.4f %s', row_id::VARCHAR, CASE WHEN p >= 0.5 THEN 'bm25' ELSE 'none' END, round(p, 4), coalesce(group_id, '-')) AS line FROM scored")
def _(spark, sf):
    from veriscope.sources.writers import one_line

    s = scored(spark, sf)
    return one_line(s.select(F.col("row_id").alias("claim_id"), F.when(F.col("p") >= 0.5, "bm25").otherwise("none").alias("match_type"), F.round("p", 4).alias("score"), F.col("group_id").alias("where")))


@query("k11_shards", "SELECT ('0x' || substr(md5(uid), 1, 8))::BIGINT % 4 AS shard, count(*) AS n FROM gold GROUP BY 1")
def _(spark, sf):
    g = table(spark, sf, "gold").select("uid", F.pmod(F.conv(F.substring(F.md5("uid"), 1, 8), 16, 10).cast("bigint"), F.lit(4)).alias("shard"))
    return g.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
