"""Evaluation and training dataflow, part two: operators on the whole histogram, rank or fold, and files written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.functions import entities as E
from veriscope.functions import text as T
from veriscope.operators import calibrate, consistency, evaluate, features, gold, matching, ranks, segment, verdict
from veriscope.plans.q_eval import _AUC, _GAP, _J, _LAYERS, _SAID, _grid_sql, _layers, _said
from veriscope.plans.registry import S_MACRO, S_MEASURES, S_SCORED, big, query, s_counts, s_fold, s_norm, s_ratio, scored, table
from veriscope.plans.shared import Workspace

# order and places


@query("o3_length_order", "SELECT source_key, row_number() OVER (ORDER BY -length(coalesce(text, '')), source_key) AS place FROM sources")
def _(spark, sf):
    s = table(spark, sf, "sources").select("source_key", (-F.length(F.coalesce("text", F.lit("")))).alias("shorter"))
    return ranks.ranked(s, [], ["shorter", "source_key"]).select("source_key", big("_place").alias("place"))


@query("c31_even_odd_halves", "SELECT uid, (row_number() OVER (ORDER BY row_id, uid) - 1) % 2 AS half FROM gold")
def _(spark, sf):
    g = ranks.ranked(table(spark, sf, "gold").select("row_id", "uid"), [], ["row_id", "uid"])
    return g.select("uid", big((F.col("_place") - 1) % 2).alias("half"))


@query("j17_claims_to_matches_by_position", """WITH c AS (SELECT answer_id, claim_key, claim, row_number() OVER (PARTITION BY answer_id ORDER BY claim_key) AS position FROM extracted_claims),
 m AS (SELECT answer_id, position, length(claim) >= 40 AS found FROM c) SELECT claim_key, position, found FROM c JOIN m USING (answer_id, position)""")
def _(spark, sf):
    c = ranks.ranked(table(spark, sf, "extracted_claims").select("answer_id", "claim_key", "claim"), ["answer_id"], ["claim_key"]).withColumnRenamed("_place", "position")
    c = Workspace(spark, "positions").save(c, "claims")
    matches = c.select("answer_id", "position", (F.length("claim") >= 40).alias("found"))  # a result that has kept positions only
    return c.join(matches, ["answer_id", "position"]).select("claim_key", big("position").alias("position"), "found")


@query("a31_latency", "SELECT annotator_id, round(avg(s), 3) AS mean, round(quantile_cont(s, 0.5), 3) AS median, round(quantile_cont(s, 0.9), 3) AS p90 FROM (SELECT annotator_id, (epoch_us(received_at) - epoch_us(judged_at)) / 1e6 AS s FROM judgments) WHERE s IS NOT NULL GROUP BY 1")
def _(spark, sf):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    j = table(spark, sf, "judgments").select("annotator_id", ((us("received_at") - us("judged_at")) / 1e6).alias("s")).filter("s is not null")
    q = ranks.quantiles(j, ["annotator_id"], "s", [0.5, 0.9]).groupBy("annotator_id").agg(F.round(F.max(F.when(F.col("q") == 0.5, F.col("value"))), 3).alias("median"), F.round(F.max(F.when(F.col("q") == 0.9, F.col("value"))), 3).alias("p90"))
    mean = j.groupBy("annotator_id").agg(F.round(F.avg("s"), 3).alias("mean")).withColumnRenamed("annotator_id", "a")
    return q.join(mean, F.col("annotator_id").eqNullSafe(F.col("a"))).select("annotator_id", "mean", "median", "p90")


# scores of benchmarks

#: Weights of the five parts of the composite.
COMPOSITE = {"accuracy": 0.30, "gap": 0.25, "numeric": 0.25, "portable": 0.10, "rules": 0.10}


def _parts(spark, sf):
    z = _said(spark, sf).filter("label is not null").withColumn("other", (F.least(F.lit(1.0), F.col("p") * 1.1) >= 0.55).cast("int"))
    gap = F.min(F.when(F.col("label") == 1, F.col("p"))) - F.max(F.when(F.col("label") == 0, F.col("p")))
    same = F.min((F.col("said") == F.col("other")).cast("int"))
    return z.groupBy("lang_norm").agg(F.avg((F.col("said") == F.col("label")).cast("double")).alias("accuracy"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(gap, F.lit(0.0)) / 0.1)).alias("gap"), same.cast("double").alias("portable"), F.avg((F.col("n_words") > 12).cast("double")).alias("numeric"))


_PARTS = f"{_SAID}, parts AS (SELECT lang_norm, avg((said = label)::INT) AS accuracy, least(1.0, greatest(0.0, coalesce(min(p) FILTER (WHERE label = 1) - max(p) FILTER (WHERE label = 0), 0) / 0.1)) AS gap, min((said = (least(1.0, p * 1.1) >= 0.55)::INT)::INT)::DOUBLE AS portable, avg((n_words > 12)::INT) AS numeric FROM z WHERE label IS NOT NULL GROUP BY 1)"


@query("a28_composite", f"{_PARTS} SELECT lang_norm, round(0.30 * accuracy + 0.25 * gap + 0.25 * numeric + 0.10 * portable + 0.10, 4) AS quality, round(100 * (1 - (0.30 * accuracy + 0.25 * gap + 0.25 * numeric + 0.10 * portable + 0.10)), 1) AS score FROM parts")
def _(spark, sf):
    quality, score = evaluate.composite({**{k: F.col(k) for k in ("accuracy", "gap", "numeric", "portable")}, "rules": F.lit(1.0)}, COMPOSITE)
    return _parts(spark, sf).select("lang_norm", quality.alias("quality"), score.alias("score"))


@query("a29_cross_validation_score", f"{_PARTS} SELECT lang_norm, round(accuracy + 0.25 * portable + 0.25 * gap, 6) AS score FROM parts")
def _(spark, sf):
    return _parts(spark, sf).select("lang_norm", F.round(F.col("accuracy") + 0.25 * F.col("portable") + 0.25 * F.col("gap"), 6).alias("score"))


@query("a30_gap_attainment", f"{_PARTS} SELECT lang_norm, round(gap, 6) AS attained FROM parts")
def _(spark, sf):
    return _parts(spark, sf).select("lang_norm", F.round("gap", 6).alias("attained"))


@query("a27_clause_decomposition")
def _(spark, sf):
    """Least recall of a claim's clauses in its evidence, whether any number is missing there, and how many clauses reach .5."""
    g = table(spark, sf, "gold").select("row_id", F.col("claim").alias("text"))
    parts = segment.clauses(g, ["row_id"])
    source = table(spark, sf, "gold").select("row_id", T.token_set(F.coalesce("source_text", F.lit(""))).alias("_s"), F.coalesce("source_text", F.lit("")).alias("_t"))
    each = parts.join(source, "row_id").select("row_id", T.overlap(T.token_set("text"), F.col("_s")).alias("r"), E.number_recall_column(F.col("text"), F.col("_t")).alias("n"))
    return each.groupBy("row_id").agg(F.round(F.min("r"), 6).alias("least"), F.max(((F.col("n") >= 0) & (F.col("n") < 1)).cast("int")).alias("any_mismatch"), F.count_if(F.col("r") >= 0.5).alias("k"), F.count(F.lit(1)).alias("n"))


# thresholds and bands


@query("c16_scoped_thresholds", f"""WITH {S_SCORED}, {_grid_sql(0.2, 0.8, 13)}, f AS (SELECT *, ('0x' || substr(md5(coalesce(group_id, '')), 1, 8))::BIGINT % 5 AS fold, CASE WHEN lang_norm = 'en' THEN 'en' ELSE 'other' END AS en FROM scored WHERE label IS NOT NULL),
 x AS (SELECT 'global' AS scheme, 'all' AS part, fold, p, label FROM f UNION ALL SELECT 'en_other', en, fold, p, label FROM f UNION ALL SELECT 'by_language', lang_norm, fold, p, label FROM f),
 z AS (SELECT scheme, part, fold, threshold, label, (p >= threshold)::INT AS said FROM x, g), own AS (SELECT scheme, part, fold, threshold, {s_counts()} FROM z GROUP BY 1, 2, 3, 4),
 held AS (SELECT DISTINCT fold AS held FROM f), tot AS (SELECT scheme, part, threshold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM own GROUP BY 1, 2, 3),
 rest AS (SELECT t.scheme, t.part, held, t.threshold, t.tp - coalesce(o.tp, 0) AS tp, t.fp - coalesce(o.fp, 0) AS fp, t.fn - coalesce(o.fn, 0) AS fn, t.tn - coalesce(o.tn, 0) AS tn FROM tot t CROSS JOIN held LEFT JOIN own o ON o.scheme = t.scheme AND o.part = t.part AND o.threshold = t.threshold AND o.fold = held),
 m AS (SELECT *, {S_MACRO} AS macro_f1 FROM rest), b AS (SELECT scheme, part, held, arg_min(threshold, struct_pack(a := -macro_f1, b := threshold)) AS t, max(tp+fp+fn+tn) >= 30 AND max(tp+fn) > 0 AND max(fp+tn) > 0 AS enough FROM m GROUP BY 1, 2, 3)
 SELECT own.scheme, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM own JOIN b ON own.scheme = b.scheme AND own.part = b.part AND own.fold = b.held JOIN b a ON a.scheme = 'global' AND a.held = own.fold WHERE own.threshold = CASE WHEN b.enough THEN b.t ELSE a.t END GROUP BY 1""")
def _(spark, sf):
    fold = F.pmod(F.conv(F.substring(F.md5(F.coalesce("group_id", F.lit(""))), 1, 8), 16, 10).cast("bigint"), F.lit(5))
    s = scored(spark, sf).withColumn("fold", fold).withColumn("en", F.when(F.col("lang_norm") == "en", "en").otherwise("other"))
    s = Workspace(spark, "folds").save(s, "scores")
    return evaluate.scoped_thresholds(s, "p", "label", "fold", {"en_other": "en", "by_language": "lang_norm"}, evaluate.grid(0.2, 0.8, 13))


#: Two scores more from the one word overlap and the number of words (fixed functions), to exercise the sweeps.
_TWO = f"WITH {S_SCORED}, y AS (SELECT *, round(1 / (1 + exp(-(-2 + 4 * p + 0.02 * n_words))), 6) AS st, round(least(1.0, n_words / 40.0), 6) AS co FROM scored WHERE label IS NOT NULL)"


def _two(spark, sf):
    return Workspace(spark, "two").save(_with_two(scored(spark, sf).filter("label is not null")), "scores")  # read several times


def _with_two(df):
    p, n = F.col("p"), F.col("n_words")
    return df.withColumns({"st": F.round(1 / (1 + F.exp(-(-2 + 4 * p + 0.02 * n))), 6), "co": F.round(F.least(F.lit(1.0), n / 40.0), 6)})


def _quantile_list(df, column, lo, hi, n):
    got = ranks.quantiles(df, [], column, [lo + i * (hi - lo) / (n - 1) for i in range(n)]).collect()  # n numbers
    return [round(r["value"], 6) for r in got]


def _bounds(column, lo, hi, n):
    return f"(SELECT list_distinct(list_transform(quantile_cont({column}, list_transform(range(0, {n}), lambda i: {lo} + i * {hi - lo} / {n - 1})), lambda v: round(v, 6))) FROM y)"


def _sweep_sql(score, los, his, below, inside, above, keep="true"):
    return f"""{_TWO}, bl AS (SELECT unnest({los}) AS lo), bh AS (SELECT unnest({his}) AS hi), v AS (SELECT lo, hi, label, CASE WHEN {score} <= lo THEN {below} WHEN {score} < hi THEN {inside} ELSE {above} END AS said, ({score} > lo AND {score} < hi)::INT AS esc FROM y, bl, bh WHERE lo < hi AND {keep}),
 c AS (SELECT lo, hi, {s_counts()}, avg(esc) AS share FROM v GROUP BY 1, 2) SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, {S_MACRO} AS macro_f1, round(share, 6) AS share FROM c"""


def _swept(c):
    return evaluate.measures(c).select("lo", "hi", "macro_f1", F.round("share", 6).alias("share"))


@query("c18_escalation_bands", _sweep_sql("p", _bounds("p", 0.02, 0.5, 25), _bounds("p", 0.5, 0.98, 25), "(p >= 0.45)::INT", "(st >= 0.5)::INT", "(p >= 0.45)::INT", "lo <= 0.5 AND hi >= 0.5"))
def _(spark, sf):
    y = _two(spark, sf)
    lows = [x for x in _quantile_list(y, "p", 0.02, 0.5, 25) if x <= 0.5]
    highs = [x for x in _quantile_list(y, "p", 0.5, 0.98, 25) if x >= 0.5]
    lexical = F.col("p") >= 0.45
    return _swept(evaluate.band_sweep(y, "p", "label", lexical, F.col("st") >= 0.5, lexical, lows, highs))


@query("c19_cascade_bands", _sweep_sql("p", _bounds("p", 0.01, 0.99, 99), _bounds("p", 0.01, 0.99, 99), "(p >= 0.5)::INT", "(st >= 0.5)::INT", "(p >= 0.5)::INT", "lo <= 0.5 AND hi >= 0.5"))
def _(spark, sf):
    y = _two(spark, sf)
    q = _quantile_list(y, "p", 0.01, 0.99, 99)
    return _swept(evaluate.band_sweep(y, "p", "label", F.col("p") >= 0.5, F.col("st") >= 0.5, F.col("p") >= 0.5, [x for x in q if x <= 0.5], [x for x in q if x >= 0.5]))


@query("c20_cosine_gates", _sweep_sql("co", f"list_concat([-1.0], {_bounds('co', 0.005, 0.2, 40)})", f"list_concat({_bounds('co', 0.8, 0.995, 40)}, [2.0])", "0", "(st >= 0.5)::INT", "1"))
def _(spark, sf):
    y = _two(spark, sf)
    lows, highs = [-1.0, *_quantile_list(y, "co", 0.005, 0.2, 40)], [*_quantile_list(y, "co", 0.8, 0.995, 40), 2.0]  # -1 and 2: no gate
    return _swept(evaluate.band_sweep(y, "co", "label", F.lit(0), F.col("st") >= 0.5, F.lit(1), lows, highs))


_CUT = "WHERE label IS NOT NULL"


@query("c36_batch_strategies", f"""WITH {S_SCORED.replace('FROM gold)', 'FROM gold WHERE label IS NOT NULL)')}, {_grid_sql(0.05, 0.95, 181)},
 z AS (SELECT lang_norm, threshold, label, (p >= threshold)::INT AS said FROM scored, g), c AS (SELECT lang_norm, threshold, {s_counts()} FROM z GROUP BY 1, 2), m AS (SELECT lang_norm, threshold, {S_MACRO} AS macro_f1 FROM c),
 n AS (SELECT lang_norm, p, row_id, row_number() OVER w AS i, lead(p) OVER w AS nx, count(*) OVER a AS n, sum(p) OVER w AS s, sum(p * p) OVER w AS q, sum(p) OVER a AS ss, sum(p * p) OVER a AS qq FROM scored WINDOW w AS (PARTITION BY lang_norm ORDER BY p, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY lang_norm)),
 d AS (SELECT *, round(nx - p, 9) AS gap, round(q - s * s / i + (qq - q) - (ss - s) * (ss - s) / (n - i), 9) AS sse FROM n WHERE nx IS NOT NULL AND n >= 4),
 t AS (SELECT lang_norm, 'fixed' AS strategy, 0.45 AS threshold, 1.0 AS gap FROM n GROUP BY 1 UNION ALL SELECT lang_norm, 'tuned', arg_min(threshold, struct_pack(a := -macro_f1, b := threshold)), 1.0 FROM m GROUP BY 1
 UNION ALL SELECT lang_norm, 'gap', arg_max((p + nx) / 2, struct_pack(a := gap, b := i)), max(gap) FROM d GROUP BY 1 UNION ALL SELECT lang_norm, 'gap_bottom', arg_max((p + nx) / 2, struct_pack(a := gap, b := i)), max(gap) FROM d WHERE i <= greatest(2, (n + 1) // 2) GROUP BY 1
 UNION ALL SELECT lang_norm, 'jenks', arg_min((p + nx) / 2, struct_pack(a := sse, b := i)), arg_min(gap, struct_pack(a := sse, b := i)) FROM d GROUP BY 1)
 SELECT lang_norm, strategy, round(CASE WHEN gap < 0.02 THEN 0.45 ELSE threshold END, 6) AS threshold FROM t""")
def _(spark, sf):
    s = Workspace(spark, "batches").save(scored(spark, sf).filter("label is not null"), "scores")
    out = evaluate.batch_thresholds(s, "lang_norm", "p", "row_id", "label", 0.45, 0.02)
    return out.select("lang_norm", "strategy", F.round("threshold", 6).alias("threshold"))


@query("c39_prior_at_thresholds", f"{_LAYERS}, h AS (SELECT label, 1 / (1 + exp(-(-3.0 + 6.0 * ex + 2.0 * fu + 2.5 * rc + 4.5 * se))) AS pr FROM y WHERE label IS NOT NULL), t AS (SELECT unnest([0.3, 0.5, 0.7]) AS threshold), z AS (SELECT threshold, label, (pr >= threshold)::INT AS said FROM h, t), c AS (SELECT threshold::DOUBLE AS threshold, {s_counts()} FROM z GROUP BY 1) SELECT *, {S_MEASURES} FROM c")
def _(spark, sf):
    prior = {k: calibrate.PRIOR[k][0] for k in ("Intercept", "exact", "fuzzy", "bm25_recall", "semantic")}
    y = _layers(spark, sf).withColumns({"exact": F.col("ex"), "fuzzy": F.col("fu"), "bm25_recall": F.col("rc"), "semantic": F.col("se")}).withColumn("pr", calibrate.Head(prior).probability())
    return evaluate.measures(evaluate.scan(y, [], "pr", "label", F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))


# training sets


@query("c17_resampling_modes", f"""WITH {S_SCORED}, r AS (SELECT *, lang_norm <> 'en' AS away, row_number() OVER (PARTITION BY label ORDER BY md5(uid), uid) AS pl, count(*) OVER (PARTITION BY label) AS nl, row_number() OVER (PARTITION BY lang_norm <> 'en' ORDER BY md5(uid), uid) AS pf, count(*) OVER (PARTITION BY lang_norm <> 'en') AS nf FROM scored WHERE label IS NOT NULL),
 k AS (SELECT max(c) AS most, min(c) AS least FROM (SELECT count(*) AS c FROM r GROUP BY label)), e AS (SELECT count(*) AS home FROM r WHERE NOT away),
 m AS (SELECT 'oversample_minority' AS mode, uid, most // nl + (pl <= most % nl)::INT AS copies FROM r, k UNION ALL SELECT 'undersample_majority', uid, least // nl + (pl <= least % nl)::INT FROM r, k
 UNION ALL SELECT 'oversample_foreign', uid, CASE WHEN away THEN home // nf + (pf <= home % nf)::INT ELSE 1 END FROM r, e UNION ALL SELECT 'oversample_foreign_negatives', uid, CASE WHEN away AND label = 0 THEN 5 ELSE 1 END FROM r) SELECT mode, uid, copies::BIGINT AS copies FROM m WHERE copies > 0""")
def _(spark, sf):
    s = scored(spark, sf).select("uid", "label", "lang_norm")
    return gold.resampled(s, "uid", "label", F.col("lang_norm") != "en").select("mode", "uid", big("copies").alias("copies"))


@query("c10_anchor_frame", f"SELECT copy, {', '.join(f'v[{i + 1}] AS {n}' for i, n in enumerate(calibrate.ANCHOR_COLUMNS))} FROM (SELECT unnest({[list(map(float, r)) for r in calibrate.ANCHORS]}::DOUBLE[][]) AS v) CROSS JOIN (SELECT unnest(range(1, 5)) AS copy)")
def _(spark, sf):
    return calibrate.anchor_frame(spark).withColumn("copy", big("copy"))


@query("c9_default_head")
def _(spark, sf):
    """The head fitted to the anchor rows under the prior, one row a coefficient: mean and standard deviation (A21)."""
    return calibrate.summary(spark, calibrate.default_head(spark))


@query("a21_coefficient_posterior")
def _(spark, sf):
    s = _layers(spark, sf).filter("label is not null").select("label", F.col("ex").alias("exact"), F.col("fu").alias("fuzzy"), F.col("rc").alias("bm25_recall"))
    return calibrate.summary(spark, calibrate.fit(s, calibrate.varying(s, ["exact", "fuzzy", "bm25_recall"]), "label", calibrate.PRIOR))


@query("fp61_varying_features", f"{_LAYERS}, f AS (SELECT unnest([{{'feature': 'exact', 'v': ex}}, {{'feature': 'fuzzy', 'v': fu}}, {{'feature': 'nli_entail', 'v': 0.0}}], recursive := true) FROM y) SELECT feature FROM f GROUP BY 1 HAVING min(v) < max(v)")
def _(spark, sf):
    y = _layers(spark, sf).select(F.col("ex").alias("exact"), F.col("fu").alias("fuzzy"), F.lit(0.0).alias("nli_entail"))
    return spark.createDataFrame([(f,) for f in calibrate.varying(y, y.columns)], "feature string")


@query("c23_reuse_seam_w3")
def _(spark, sf):
    """W3: out of fold, a head over the lexical probability, the cosine and the entailment only."""
    y = _layers(spark, sf).filter("label is not null").select("row_id", "label", "group_id", F.col("p").alias("lex_p"), F.col("ra").alias("cos_max"), F.col("se").alias("nli_ent"))
    out = calibrate.out_of_fold(y, ["lex_p", "cos_max", "nli_ent"], "label", "group_id", "row_id")
    return evaluate.best_threshold(evaluate.scan(out, [], "probability", "label", evaluate.grid(0.02, 0.98, 97)), [])


@query("c28_boosted_ensemble_f7")
def _(spark, sf):
    """Out of fold probabilities of two model factories, boosted trees and logistic regression, over the same features."""
    from veriscope.operators import models

    y = _two(spark, sf).select("row_id", "label", "group_id", "p", F.col("n_words").cast("double").alias("n_words"), "co")
    return models.out_of_fold(y, ["p", "n_words", "co"], "label", "group_id", "row_id", {"boosted": models.boosted(), "logistic": models.logistic()})


def _tiers(spark, sf, effort, translate=None):
    g = table(spark, sf, "gold").withColumn("det", F.lower("det_lang"))
    s = table(spark, sf, "sources").filter("source_index = 0 and group_id <> ''").groupBy("group_id").agg(F.min("lang").alias("s_lang"))
    rows = g.join(s, "group_id", "left").select("row_id", "claim", "source_text", "det", "s_lang")
    return features.tier(rows, features.rarity(table(spark, sf, "sources")), effort, "det", "s_lang", translate).withColumn("probability", features.head(effort))


@query("fp24_medium_tier_features")
def _(spark, sf):
    return _tiers(spark, sf, "medium")


@query("fp24_high_tier_features_f5_translate")
def _(spark, sf):
    return _tiers(spark, sf, "high", lambda text, lang: F.lower(text))  # a translator's place


@query("c38_short_source_probe")
def _(spark, sf):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(features.PROBE)], "row_id bigint, claim string, source_text string, label int")
    got = features.low_tier(rows, features.rarity(rows.select(F.col("source_text").alias("text")))).withColumn("probability", features.head("low"))
    return got.join(rows.select("row_id", "label"), "row_id").select("row_id", "label", "probability", (F.col("probability") >= features.HEADS["low"][2]).cast("int").alias("said"))


# matches on texts that hold what is looked for


@query("m1_sentences_in_sources", f"""WITH c AS (SELECT source_key, group_id, {s_fold(s_norm("upper(substring(text, 1, 60))"))} AS c FROM sources WHERE group_id <> ''), s AS (SELECT group_id, source_index, {s_fold(s_norm('text'))} AS t FROM sources WHERE text IS NOT NULL)
 SELECT source_key, min(source_index) AS source_index FROM c JOIN s USING (group_id) WHERE length(c) > 0 AND contains(t, c) GROUP BY 1""")
def _(spark, sf):
    s = table(spark, sf, "sources").filter("group_id <> ''")
    claims = s.select("source_key", "group_id", F.upper(F.substring("text", 1, 60)).alias("claim"))
    return matching.exact_matches(claims, s, "source_key", "group_id", "source_index")


_ALL_NAMES = [(c, i, n) for c, ns in E.NAMES.items() for i, n in enumerate(ns)]
_NAMED = f"WITH d AS (SELECT doc_id, 'It ran on ' || {[n for _, _, n in _ALL_NAMES]}[1 + doc_id % {len(_ALL_NAMES)}] || ', then on ' || {[n for _, _, n in _ALL_NAMES]}[1 + (doc_id * 7) % {len(_ALL_NAMES)}] || '. ' || coalesce(text, '') AS text FROM documents), n(category, position, name) AS (VALUES {', '.join(f'''('{c}', {i}, '{n}')''' for c, i, n in _ALL_NAMES)}), hits AS (SELECT doc_id, category, position, name FROM d, n WHERE regexp_matches(text, '(?:^|[^A-Za-z0-9])' || replace(name, '.', '\\.') || '(?:$|[^A-Za-z0-9])'))"


def _named(spark, sf):
    names = F.array(*[F.lit(n) for _, _, n in _ALL_NAMES])
    pick = lambda k: F.element_at(names, (1 + F.pmod(F.col("doc_id") * k, F.lit(len(_ALL_NAMES)))).cast("int"))
    text = F.concat(F.lit("It ran on "), pick(1), F.lit(", then on "), pick(7), F.lit(". "), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.explode(E.names_column(text)).alias("x")).select("doc_id", "x.*")


@query("fp6_all_names", _NAMED + " SELECT doc_id, category, name FROM hits")
def _(spark, sf):
    return _named(spark, sf).select("doc_id", "category", "name")


@query("j15_categories_of_names", _NAMED + " SELECT doc_id, category, count(*) AS n, arg_min(name, position) AS first FROM hits GROUP BY 1, 2")
def _(spark, sf):
    return _named(spark, sf).groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "position").alias("first"))


def _inconsistent(spark, sf):
    n = F.col("n_nationkey")
    text = F.concat(F.lit("The plant has "), (n + 100).cast("string"), F.lit(" turbines.\nLater it has "), (F.col("n_regionkey") * 6 + 100).cast("string"), F.lit(" turbines.\nTeams: alpha, beta, gamma\nTeams now: alpha, beta, delta\nWe use Model Nova X2 here.\nWe use Model Vega X3 there."))
    return table(spark, sf, "nation").select(n.alias("doc_id"), text.alias("text"))


@query("a22_numbers_that_differ", "SELECT n_nationkey AS doc_id, 'turbines' AS category, 2::BIGINT AS n_values, 2::BIGINT AS n FROM nation WHERE n_nationkey <> n_regionkey * 6")
def _(spark, sf):
    return consistency.numeric(_inconsistent(spark, sf), "doc_id").select("doc_id", "category", big("n_values").alias("n_values"), big(F.size("occurrences")).alias("n"))


@query("a23_variants_of_a_name", "SELECT n_nationkey AS doc_id, 'Model' AS head, 'Model Nova X2|Model Vega X3' AS variants, 2::BIGINT AS occurrences FROM nation")
def _(spark, sf):
    return consistency.name_variants(_inconsistent(spark, sf), "doc_id").select("doc_id", "head", F.array_join("variants", "|").alias("variants"), big("occurrences").alias("occurrences"))


@query("a24_a25_j16_u4_pairs_of_sets", "SELECT n_nationkey AS doc_id, 'alpha|beta|gamma' AS set_a, 'alpha|beta|delta' AS set_b, 3::BIGINT AS line_a, 4::BIGINT AS line_b, 0.5::DOUBLE AS jaccard FROM nation")
def _(spark, sf):
    s = consistency.set_pairs(_inconsistent(spark, sf), "doc_id").filter("line_a = 3")
    members = lambda c: F.array_join(F.array(F.lit("alpha"), F.lit("beta"), F.array_except(c, F.array(F.lit("alpha"), F.lit("beta")))[0]), "|")
    return s.select("doc_id", members("set_a").alias("set_a"), members("set_b").alias("set_b"), big("line_a").alias("line_a"), big("line_b").alias("line_b"), "jaccard")


# pieces of texts: what must hold of every one


def _placed(name, make, most):
    @query(name, f"SELECT source_key, true AS placed, true AS within FROM sources WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')")
    def _(spark, sf):
        s = table(spark, sf, "sources").filter(F.col("text").rlike(r"[^\s\p{Z}]"))
        parts = make(s)
        each = parts.join(s.select("source_key", F.col("text").alias("_whole")), "source_key")
        # slivers between parts that are joined are left out, so what is compared is where a piece begins and ends
        part, own = T.trim(F.substring(F.col("_whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))), T.trim("text")
        head, tail = F.substring(part, 1, 12) == F.substring(own, 1, 12), F.substring(part, -12, 12) == F.substring(own, -12, 12)
        same = head & tail
        inside = F.length("text") <= most if most else F.col("char_end") <= F.length("_whole")
        ok = each.groupBy("source_key").agg(F.bool_and(same).alias("placed"), F.bool_and(inside).alias("within"))
        return s.select("source_key").join(ok, "source_key", "left").select("source_key", F.coalesce("placed", F.lit(True)).alias("placed"), F.coalesce("within", F.lit(True)).alias("within"))


_placed("t4_passages_in_place", lambda s: segment.passages(s, ["source_key"]), None)
_placed("t5_chunks_in_place_and_size", lambda s: segment.chunks(s, ["source_key"]), 1500)
_placed("t9_view_chunks_in_place_and_size", lambda s: segment.view_chunks(s, ["source_key"]), 300)


@query("e5_relocated_text", f"WITH k AS (SELECT 1) SELECT true AS found_as_said FROM k")
def _(spark, sf):
    """Every claim that is found again in its document reads there as it was extracted, white space and list marks aside."""
    d = table(spark, sf, "documents").filter("text is not null")
    r = segment.relocate(segment.extract_claims(d, "doc_id"), d, "doc_id").filter("char_start is not null").join(d.select("doc_id", "text"), "doc_id")
    there = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    same = T.normalize_whitespace(there) == T.normalize_whitespace("claim")
    return r.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("found_as_said"))


@query("t16_phonetic_skeletons", f"""WITH w AS (SELECT DISTINCT unnest({s_fold("regexp_extract_all(claim, '[A-Za-z]+')").replace("replace(lower(regexp_extract_all(claim, '[A-Za-z]+')), 'ς', 'σ')", "list_transform(regexp_extract_all(claim, '[A-Za-z]+'), lambda z: lower(z))")}) AS w FROM extracted_claims), r AS (SELECT w, string_split(regexp_replace(substring(w, 2), '[aeiou]', '', 'g'), '') AS c FROM w)
 SELECT w, substring(w, 1, 1) || list_aggregate(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), 'string_agg', '') AS skeleton FROM r WHERE len(c) > 0 AND c[1] <> '' UNION ALL SELECT w, substring(w, 1, 1) FROM r WHERE len(c) = 0 OR c[1] = ''""")
def _(spark, sf):
    words = F.explode(F.transform(F.regexp_extract_all("claim", F.lit("[A-Za-z]+"), F.lit(0)), lambda z: F.lower(z))).alias("w")
    return table(spark, sf, "extracted_claims").select(words).distinct().select("w", T.phonetic("w").alias("skeleton"))


# layers given from outside


@query("x2_hooks_f1_f2_f3_p32_p34")
def _(spark, sf):
    """All layers, with stand-ins for the three that need a model: word overlap as cosine and as entailment, and the default head."""
    from veriscope import api

    def semantic(asked, texts):
        first = texts.groupBy("group_id").agg(F.min_by(F.struct(F.substring("text", 1, 400).alias("t"), "source_index"), "source_index").alias("s"))
        score = T.overlap(T.token_set("claim"), T.token_set("s.t"))
        return asked.join(first, "group_id").select("qid", score.alias("semantic_score"), score.alias("semantic_ratio"), F.col("s.t").alias("semantic_text"), F.col("s.source_index").alias("semantic_source"))

    def nli(premise, claim):
        p = T.overlap(T.token_set(claim), T.token_set(premise))
        return F.struct(p.alias("entailment"), ((1 - p) * 0.8).alias("neutral"), ((1 - p) * 0.2).alias("contradiction"))

    g = table(spark, sf, "gold").select(F.col("row_id").alias("claim_id"), F.coalesce("group_id", F.lit("")).alias("group_id"), "claim")
    out = api.ground_batch(g, table(spark, sf, "sources"), semantic=semantic, nli=nli, head=calibrate.default_head(spark))
    return out.select("claim_id", "match_type", "semantic_score", "verdict_probability", "verification_needed")


# files


def _folder(spark, name):
    return f"{Workspace(spark, name).root}/files"


@query("s1_s9_text_files", "SELECT name || chr(10) AS text, length(name)::BIGINT + 1 AS n_bytes FROM languages WHERE regexp_full_match(name, '[ -~]+')")
def _(spark, sf):
    from veriscope.sources import readers

    at = _folder(spark, "texts")
    table(spark, sf, "languages").filter(F.col("name").rlike("^[ -~]+$")).select("code", F.col("name").alias("value")).write.partitionBy("code").text(at)
    seen = readers.mirror(spark, at, "*.txt").select(F.col("path"), F.col("length").alias("n_bytes"))
    return readers.evidence(spark, f"{at}/*/*.txt").join(seen, F.col("source_path") == F.col("path")).select("text", "n_bytes")


@query("s2_claim_files", "SELECT name AS claim FROM languages WHERE regexp_full_match(name, '[ -~]+')")
def _(spark, sf):
    from veriscope.sources import readers

    at = _folder(spark, "claims")
    named = table(spark, sf, "languages").filter(F.col("name").rlike("^[ -~]+$"))
    # half as a JSON list of objects, half one claim a line; there are a few dozen languages
    kinds = named.withColumn("json", F.pmod(F.xxhash64("code"), F.lit(2)) == 0).groupBy("json").agg(F.sort_array(F.collect_list("name")).alias("x"))
    body = F.when(F.col("json"), F.to_json(F.transform("x", lambda n: F.struct(n.alias("claim"))))).otherwise(F.array_join("x", "\n\n"))
    kinds.select("json", body.alias("value")).write.partitionBy("json").text(at)
    return readers.claims(spark, f"{at}/*/*.txt").select("claim")


@query("s11_trace_evidence_unescaped", "SELECT group_id, sum(n)::BIGINT AS n_chars FROM (SELECT DISTINCT group_id, 114 + length(group_id) AS n FROM sources WHERE group_id IS NOT NULL) GROUP BY 1")
def _(spark, sf):
    from veriscope.sources.readers import trace_evidence

    text = F.concat(F.lit("<p>"), F.rpad(F.lit("a &lt; b &amp;&amp; c &gt; d &quot;e&quot;"), 137, "x"), F.lit("</p><b>"), F.col("group_id"), F.lit("</b>"))
    s = table(spark, sf, "sources").filter("group_id is not null").select("group_id", F.lit("rag").alias("type"), text.alias("output"))
    return trace_evidence(s, "group_id").select("group_id", big(F.length("evidence")).alias("n_chars"))


@query("k2_embedding_cache", "SELECT DISTINCT substr(sha1('m1' || text), 1, 16) AS key, length(text)::DOUBLE AS v FROM chunks WHERE text IS NOT NULL")
def _(spark, sf):
    from veriscope.sources.writers import cached_vectors

    at, chunks = _folder(spark, "cache"), table(spark, sf, "chunks").filter("text is not null")
    embed = lambda d: d.withColumn("vec", F.array(F.length("text").cast("float")))  # noqa: E731  a model's place
    cached_vectors(spark, chunks.filter("chunk_no = 0"), "text", "m1", embed, at)
    return cached_vectors(spark, chunks, "text", "m1", embed, at).select("key", F.col("vec")[0].cast("double").alias("v"))


@query("k4_match_json", "SELECT row_id, '{\"row_id\":' || row_id || ',\"label\":' || coalesce(label::VARCHAR, 'null') || '}' AS json FROM gold")
def _(spark, sf):
    g = table(spark, sf, "gold").select("row_id", "label")
    return g.select("row_id", F.to_json(F.struct("row_id", "label"), {"ignoreNullFields": "false"}).alias("json"))


@query("k7_k8_head_files")
def _(spark, sf):
    """A head saved and loaded again, one row a coefficient."""
    at = _folder(spark, "head") + "/head.json"
    calibrate.default_head(spark).save(at)
    return calibrate.summary(spark, calibrate.Head.load(at))


@query("k9_ranking_csv", f"WITH {S_SCORED}, {_AUC.format(k='lang_norm,', pk='lang_norm')} SELECT lang_norm, round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 4) AS auc FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE label = 1) > 0 AND count(*) FILTER (WHERE label = 0) > 0")
def _(spark, sf):
    from veriscope.sources.writers import csv_sorted

    at = _folder(spark, "ranking")
    a = evaluate.auc(scored(spark, sf), ["lang_norm"], "p", "label").filter("auc is not null").withColumn("auc", F.round("auc", 4))
    csv_sorted(a, at, F.desc("auc"), F.col("lang_norm"))
    return spark.read.csv(at, header=True, schema="lang_norm string, auc double", nullValue="\\N")


@query("k10_resumed_append", "SELECT uid, CASE WHEN row_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM gold")
def _(spark, sf):
    from veriscope.sources.writers import append_pending

    at, g = _folder(spark, "append"), table(spark, sf, "gold").select("uid", "row_id")
    append_pending(spark, g.filter("row_id % 3 = 0"), "uid", at, lambda d: d.select("uid", F.lit(1).alias("run")))  # a run that broke off
    append_pending(spark, g, "uid", at, lambda d: d.select("uid", F.lit(2).alias("run")))
    return spark.read.parquet(at)
