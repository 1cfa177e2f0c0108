"""Matching layers, vectors, joins and the public entry points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriscope.functions import text as T
from veriscope.operators import bm25, gold, lexical, matching, segment, vectors
from veriscope.plans.q_text import _PASSAGES
from veriscope.plans.registry import SPACE, WORD, big, query, s_fold, s_norm, s_tokens, table


def _claims(spark, sf):
    return table(spark, sf, "gold").filter("group_id is not null and group_id <> ''").select("row_id", "group_id", "claim")


def _passages(spark, sf):
    s = table(spark, sf, "sources").filter("group_id is not null").select("group_id", "source_index", "text")
    return segment.line_passages(s, ["group_id", "source_index"]).withColumn("pid", F.col("source_index") * 100000 + F.col("passage_no"))


@query("m1_exact_containment", f"""WITH c AS (SELECT row_id, group_id, {s_fold(s_norm('claim'))} AS c FROM gold WHERE group_id <> ''), s AS (SELECT group_id, source_index, {s_fold(s_norm('text'))} AS t FROM sources WHERE text IS NOT NULL)
 SELECT row_id, min(source_index) AS source_index FROM c JOIN s USING (group_id) WHERE length(c) > 0 AND contains(t, c) GROUP BY 1""")
def _(spark, sf):
    return matching.exact_matches(_claims(spark, sf), table(spark, sf, "sources"), "row_id", "group_id", "source_index")


def _texts(spark, sf):
    g = table(spark, sf, "gold").select(F.coalesce("claim", F.lit("")).alias("claim"), "row_id", "group_id", "source_text").withColumn("_cd", F.md5("claim"))
    s = table(spark, sf, "sources").filter("text is not null and group_id <> ''").select("group_id", "source_index", "text").withColumn("_td", F.md5("text"))
    return g, s


def _evidence(spark, sf):
    """``row_id, _cd, _td, source_index``: digests of each claim and of every text it is to be found in, a text once.

    The texts are those of the sources of its group and its own ``source_text``, which counts as source 0.
    """
    g, s = _texts(spark, sf)
    own = g.filter("source_text is not null").select("row_id", "_cd", F.md5("source_text").alias("_td"), F.lit(0).alias("source_index"))
    theirs = g.filter("group_id <> ''").select("row_id", "_cd", "group_id").join(s.select("group_id", "_td", "source_index"), "group_id").drop("group_id")
    return own.unionByName(theirs).groupBy("row_id", "_cd", "_td").agg(F.min("source_index").alias("source_index"))


def _distinct_pairs(spark, sf, asked):
    """``_cd, _td, claim, text``: each pair of a claim and a text once, whatever number of rows has it."""
    g, s = _texts(spark, sf)
    texts = g.filter("source_text is not null").select(F.md5("source_text").alias("_td"), F.col("source_text").alias("text")).unionByName(s.select("_td", "text")).dropDuplicates(["_td"])
    return asked.select("_cd", "_td").distinct().join(g.select("_cd", "claim").dropDuplicates(["_cd"]), "_cd").join(texts, "_td")


@query("m2_m3_fuzzy_m31_location", None)
def _(spark, sf):
    asked = _evidence(spark, sf)
    layer = matching.fuzzy_and_exact(_distinct_pairs(spark, sf, asked), ["_cd", "_td"], "claim", "text").drop("exact_location")
    best = F.min_by(F.struct(F.round("fuzzy", 6).alias("fuzzy"), "fuzzy_text", "fuzzy_location", "source_index"), F.struct(-F.col("fuzzy"), "source_index", "_td"))
    return asked.join(layer, ["_cd", "_td"]).groupBy("row_id").agg(F.max("exact").alias("exact"), best.alias("x")).select("row_id", "exact", "x.*")


_BM = f"""WITH {_PASSAGES}, q AS (SELECT p.source_key, p.text, row_number() OVER (PARTITION BY p.source_key ORDER BY island) - 1 AS no FROM p WHERE regexp_matches(p.text, '{WORD}')),
 d AS (SELECT s.group_id, s.source_index * 100000 + q.no AS pid, {s_tokens('q.text')} AS t FROM q JOIN sources s USING (source_key) WHERE s.group_id IS NOT NULL),
 docs AS (SELECT group_id, pid, len(t) AS dl, t FROM d WHERE len(t) > 0),
 tf AS (SELECT group_id, pid, dl, term, count(*) AS tf FROM (SELECT group_id, pid, dl, unnest(t) AS term FROM docs) GROUP BY ALL),
 corp AS (SELECT group_id, count(*) AS n, avg(dl) AS avgdl FROM docs GROUP BY 1),
 df AS (SELECT group_id, term, count(*) AS df FROM tf GROUP BY ALL),
 raw AS (SELECT df.*, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN corp USING (group_id)),
 mean AS (SELECT group_id, avg(raw) AS mean FROM raw GROUP BY 1),
 idf AS (SELECT group_id, term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw JOIN mean USING (group_id)),
 top AS (SELECT group_id, max(idf) AS max_idf FROM idf GROUP BY 1),
 cl AS (SELECT row_id, group_id, claim, {s_tokens('claim')} AS t FROM gold WHERE group_id <> ''),
 qt AS (SELECT row_id, group_id, term, count(*) AS qtf FROM (SELECT row_id, group_id, unnest(t) AS term FROM cl) GROUP BY ALL),
 sc AS (SELECT row_id, group_id, pid, greatest(0.0, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9)) AS score FROM qt JOIN tf USING (group_id, term) JOIN idf USING (group_id, term) JOIN corp USING (group_id) GROUP BY ALL),
 win AS (SELECT row_id, group_id, pid, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, pid) AS r FROM sc WHERE score > 0) WHERE r = 1),
 w AS (SELECT row_id, qt.group_id, term, greatest(0.0, coalesce(idf, max_idf)) AS w FROM qt LEFT JOIN idf USING (group_id, term) LEFT JOIN top USING (group_id) WHERE max_idf IS NOT NULL),
 rec AS (SELECT x.row_id, x.pid, CASE WHEN sum(w) > 0 THEN sum(w) FILTER (WHERE tf IS NOT NULL) / sum(w) ELSE count(tf)::DOUBLE / count(*) END AS recall FROM (SELECT DISTINCT row_id, group_id, pid FROM sc) x JOIN w USING (row_id) LEFT JOIN tf ON tf.group_id = x.group_id AND tf.pid = x.pid AND tf.term = w.term GROUP BY 1, 2)"""


@query("m5_bm25_stats", _BM + " SELECT group_id, term, df, round(idf, 6) AS idf FROM idf")
def _(spark, sf):
    terms, _ = bm25.statistics(bm25.postings(_passages(spark, sf), "group_id", "pid"), "group_id", "pid")
    return terms.select("group_id", "term", big("df").alias("df"), F.round("idf", 6).alias("idf"))


@query("a2_corpus_stats", _BM + " SELECT group_id, n, round(avgdl, 6) AS avgdl, round(max_idf, 6) AS max_idf FROM corp JOIN top USING (group_id)")
def _(spark, sf):
    _, c = bm25.statistics(bm25.postings(_passages(spark, sf), "group_id", "pid"), "group_id", "pid")
    return c.select("group_id", big("n").alias("n"), F.round("avgdl", 6).alias("avgdl"), F.round("max_idf", 6).alias("max_idf"))


@query("m4_bm25_best_passage", _BM + " SELECT row_id, group_id, pid, round(score, 5) AS score, round(coalesce(recall, 0), 5) AS recall FROM win JOIN rec USING (row_id, pid)")
def _(spark, sf):
    out = bm25.best_passage(_claims(spark, sf), _passages(spark, sf), "row_id", "group_id", "pid")
    return out.select("row_id", "group_id", big("pid").alias("pid"), F.round("score", 5).alias("score"), F.round("recall", 5).alias("recall"))


@query("m7_normalised_scores", _BM + " SELECT row_id, pid, round(score / max(score) OVER (PARTITION BY row_id), 5) AS normalised FROM sc WHERE score > 0")
def _(spark, sf):
    posts = bm25.postings(_passages(spark, sf), "group_id", "pid")
    sc = bm25.scores(_claims(spark, sf), posts, *bm25.statistics(posts, "group_id", "pid"), "row_id", "group_id", "pid").filter("score > 0")
    return sc.select("row_id", big("pid").alias("pid"), F.round(F.col("score") / F.max("score").over(Window.partitionBy("row_id")), 5).alias("normalised"))


def _recall(spark, sf):
    posts = bm25.postings(_passages(spark, sf), "group_id", "pid")
    return bm25.recalls(_claims(spark, sf), posts, *bm25.statistics(posts, "group_id", "pid"), "row_id", "group_id", "pid")


@query("m8_m6_chunk_recalls", _BM + " SELECT row_id, pid, round(coalesce(recall, 0), 5) AS recall FROM rec")
def _(spark, sf):
    return _recall(spark, sf).select("row_id", big("pid").alias("pid"), F.round("recall", 5).alias("recall"))


@query("w2_oracle_and_second", _BM + ", r AS (SELECT row_id, round(coalesce(recall, 0), 5) AS recall FROM rec) SELECT row_id, max(recall) AS oracle, coalesce(list_sort(list(recall), 'DESC')[2], max(recall)) AS second FROM r GROUP BY 1")
def _(spark, sf):
    out = bm25.rank_recalls(_recall(spark, sf).withColumn("recall", F.round("recall", 5)), "row_id", "pid")
    return out.select("row_id", "oracle", "second")


@query("w1_argmax_m9_best_recall", _BM + " SELECT row_id, pid, round(coalesce(recall, 0), 5) AS recall FROM win JOIN rec USING (row_id, pid)")
def _(spark, sf):
    return bm25.best_passage(_claims(spark, sf), _passages(spark, sf), "row_id", "group_id", "pid").select("row_id", big("pid").alias("pid"), F.round("recall", 5).alias("recall"))


@query("m9_ngram_recall", None)
def _(spark, sf):
    best = lexical.best_recall(_claims(spark, sf), _passages(spark, sf), "row_id", "group_id", "pid")
    return best.select("row_id", F.round("recall", 6).alias("recall"))


_DOT = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_VEC = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_TOP = f"{_VEC}, s AS (SELECT a.vec_id AS q, b.vec_id AS b, round({_DOT}, 9) AS score, a.label AS qlabel FROM e a JOIN e b ON a.vec_id % 20 = 0)"


def _queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.filter("vec_id % 20 = 0"), e


@query("m10_vector_topk_o1_o2_m18", _TOP + " SELECT q, b, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, b) AS r FROM s) WHERE r <= 8")
def _(spark, sf):
    q, e = _queries(spark, sf)
    out = vectors.top_k(q.withColumnRenamed("vec_id", "q"), e.withColumnRenamed("vec_id", "b"), "q", "b", 8)
    return out.select("q", "b", F.round("score", 6).alias("score"), big("rank").alias("rank"))


def _pairs(spark, sf, k=50):
    q, e = _queries(spark, sf)
    return vectors.top_k(q.withColumnRenamed("vec_id", "q"), e.withColumnRenamed("vec_id", "b"), "q", "b", k).withColumn("score", F.round("score", 9))


_P50 = _TOP + ", p AS (SELECT q, b, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, b) AS r FROM s) WHERE r <= 50)"


@query("m17_max_cosine", _P50 + " SELECT q, round(max(score), 6) AS best FROM p WHERE q <> b GROUP BY 1")
def _(spark, sf):
    return _pairs(spark, sf).filter("q <> b").groupBy("q").agg(F.round(F.max("score"), 6).alias("best"))


@query("m12_self_score", _VEC + f" SELECT a.vec_id, round(least(1.0, greatest(0.0, {_DOT.replace('b.v', 'a.v')})), 6) AS self_score FROM e a")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), vectors.cosine(v, v))), 6).alias("self_score"))


@query("m13_semantic_ratio", _TOP + f", c AS (SELECT vec_id AS q, least(1.0, greatest(0.0, {_DOT.replace('b.v', 'a.v')})) AS own FROM e a) SELECT q, round(max(score), 6) AS best, round(max(score) / nullif(any_value(own), 0), 6) AS ratio FROM s JOIN c USING (q) WHERE q <> b GROUP BY 1")
def _(spark, sf):
    q, _e = _queries(spark, sf)
    v = F.col("embedding")
    own = q.select(F.col("vec_id").alias("q"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), vectors.cosine(v, v))).alias("own"))
    best = _pairs(spark, sf, 2).filter("q <> b").groupBy("q").agg(F.max("score").alias("best"))  # the nearest besides itself
    return best.join(own, "q").select("q", F.round("best", 6).alias("best"), F.when(F.col("own") > 0, F.round(F.col("best") / F.col("own"), 6)).alias("ratio"))


@query("m15_normalised_vectors", _VEC + " SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 5) AS total FROM e")
def _(spark, sf):
    n = vectors.normalise(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("m14_percentile_threshold", _P50 + " SELECT round(least(1.0, greatest(0.65, quantile_cont(score, 0.98))), 6) AS threshold FROM p WHERE q <> b")
def _(spark, sf):
    return vectors.percentile_threshold(_pairs(spark, sf).filter("q <> b"), "score").select(F.round("threshold", 6).alias("threshold"))


@query("m16_prefixes", "SELECT claim_key, 'query: ' || claim AS q, 'passage: ' || claim AS p FROM extracted_claims WHERE claim IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").filter("claim is not null").select("claim_key", F.concat(F.lit("query: "), "claim").alias("q"), F.concat(F.lit("passage: "), "claim").alias("p"))


@query("m22_early_exit_w6", _P50 + """, z AS (SELECT q, score, row_number() OVER (PARTITION BY q ORDER BY b) AS r FROM p WHERE rank BETWEEN 2 AND 9), y AS (SELECT *, CASE WHEN r <= 1 THEN 0 WHEN r <= 2 THEN 1 WHEN r <= 4 THEN 2 WHEN r <= 8 THEN 3 ELSE 4 END AS k FROM z),
 m AS (SELECT *, max(score) OVER (PARTITION BY q ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM y) SELECT q, round(max(score), 6) AS best, count(*) AS scored FROM m WHERE before IS NULL OR before < 0.3 GROUP BY 1""")
def _(spark, sf):
    out = vectors.early_exit_max(_pairs(spark, sf).filter("rank between 2 and 9"), "q", "b", "score", 0.3)
    return out.select("q", F.round("best", 6).alias("best"), "scored")


@query("m25_running_max", _P50 + " SELECT q, k, round(max(score), 6) AS best FROM (SELECT q, b, score, row_number() OVER (PARTITION BY q ORDER BY b) AS r FROM p WHERE q <> b) JOIN (SELECT unnest([1, 3, 8]) AS k) ON r <= k GROUP BY 1, 2")
def _(spark, sf):
    out = vectors.running_max(_pairs(spark, sf).filter("q <> b"), "q", ["b"], "score", (1, 3, 8))
    return out.select("q", "k", F.round("best", 6).alias("best"))


@query("m26_pair_distribution_w13", _P50 + """, r AS (SELECT q, score, row_number() OVER (PARTITION BY q ORDER BY score DESC) AS r FROM p WHERE q <> b)
 SELECT q, round(max(score), 5) AS top, round(avg(score) FILTER (WHERE r <= 2), 5) AS top2_mean, round(ln(sum(exp(score / 0.1))) * 0.1, 5) AS soft_max, round(ln(1 + count(*) FILTER (WHERE score >= 0.5)), 5) AS log_high, round(max(score) - coalesce(max(score) FILTER (WHERE r = 2), 0), 5) AS margin FROM r GROUP BY 1""")
def _(spark, sf):
    out = vectors.distribution(_pairs(spark, sf).filter("q <> b"), "q", "score")
    return out.select("q", *(F.round(c, 5).alias(c) for c in ("top", "top2_mean", "soft_max", "log_high", "margin")))


@query("m21_m19_m20_staged_cascade", _P50 + " SELECT q, b, round(CASE WHEN score < 0.1 THEN score ELSE (score + 1) / 2 END, 6) AS stage1, round(CASE WHEN score >= 0.1 AND (score + 1) / 2 BETWEEN 0.6 AND 0.9 THEN score * score END, 6) AS stage2 FROM p WHERE q <> b")
def _(spark, sf):
    p = _pairs(spark, sf).filter("q <> b").select("q", "b", "score")
    gate, band = F.col("score") >= 0.1, F.col("stage1").between(0.6, 0.9)
    out = vectors.staged(p.withColumn("stage1", F.col("score")), gate, band, lambda d: d.withColumn("stage1", (F.col("score") + 1) / 2), lambda d: d.withColumn("stage2", F.col("score") * F.col("score")))
    return out.select("q", "b", F.round("stage1", 6).alias("stage1"), F.round("stage2", 6).alias("stage2"))


# The queries with _P50 give what their SQL asks for, the 50 nearest; these give the same measures over all pairs.
_ALL = _TOP + ", p AS (SELECT q, b, score FROM s WHERE q <> b)"


def _summaries(spark, sf):
    q, e = _queries(spark, sf)
    return vectors.summaries(q.withColumnRenamed("vec_id", "q"), e.withColumnRenamed("vec_id", "b"), "q", "b")


@query("m14_all_pairs_threshold", _VEC + """, x AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM e WHERE v IS NOT NULL),
 d AS (SELECT d, n, ('0x' || substr(md5(d || ':a'), 1, 8))::BIGINT % n AS i, ('0x' || substr(md5(d || ':b'), 1, 8))::BIGINT % n AS j FROM range(200) t(d), (SELECT max(n) AS n FROM x) WHERE d < n * (n - 1) / 2),
 z AS (SELECT i, CASE WHEN i = j THEN (j + 1) % n ELSE j END AS j FROM d) SELECT round(least(1.0, greatest(0.65, quantile_cont(round(""" + _DOT + """, 9), 0.98))), 6) AS threshold, round(quantile_cont(round(""" + _DOT + """, 9), 0.98), 6) AS quantile FROM z JOIN x a ON a.pos = z.i JOIN x b ON b.pos = z.j""")
def _(spark, sf):
    s = vectors.sampled_pairs(table(spark, sf, "embeddings"), "vec_id")
    both = vectors.percentile_threshold(s, "score").crossJoin(vectors.percentile_threshold(s, "score", floor=-1.0).withColumnRenamed("threshold", "quantile"))  # one row each
    return both.select(F.round("threshold", 6).alias("threshold"), F.round("quantile", 6).alias("quantile"))


@query("m22_all_pairs_early_exit_w6", _ALL + """, z AS (SELECT q, score, row_number() OVER (PARTITION BY q ORDER BY b) AS r FROM p), y AS (SELECT *, CASE WHEN r <= 1 THEN 0 WHEN r <= 2 THEN 1 WHEN r <= 4 THEN 2 WHEN r <= 8 THEN 3 ELSE 4 + (r - 9) // 4 END AS k FROM z),
 m AS (SELECT *, max(score) OVER (PARTITION BY q ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM y) SELECT q, round(max(score), 6) AS best, count(*) AS scored FROM m WHERE before IS NULL OR before < 0.3 GROUP BY 1""")
def _(spark, sf):
    return _summaries(spark, sf).select("q", F.round("best", 6).alias("best"), "scored")


@query("m25_all_pairs_running_max", _ALL + " SELECT q, k, round(max(score), 6) AS best FROM (SELECT q, b, score, row_number() OVER (PARTITION BY q ORDER BY b) AS r FROM p) JOIN (SELECT unnest([1, 3, 8]) AS k) ON r <= k GROUP BY 1, 2")
def _(spark, sf):
    k = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("best")) for k in (1, 3, 8)))).alias("x")
    return _summaries(spark, sf).select("q", k).select("q", "x.k", F.round("x.best", 6).alias("best"))


@query("m26_all_pairs_distribution_w13", _ALL + """, r AS (SELECT q, score, row_number() OVER (PARTITION BY q ORDER BY score DESC) AS r FROM p)
 SELECT q, round(max(score), 5) AS top, round(avg(score) FILTER (WHERE r <= 2), 5) AS top2_mean, round(ln(sum(exp(score / 0.1))) * 0.1, 5) AS soft_max, round(ln(1 + count(*) FILTER (WHERE score >= 0.5)), 5) AS log_high, round(max(score) - coalesce(max(score) FILTER (WHERE r = 2), 0), 5) AS margin FROM r GROUP BY 1""")
def _(spark, sf):
    return _summaries(spark, sf).select("q", *(F.round(c, 5).alias(c) for c in ("top", "top2_mean", "soft_max", "log_high", "margin")))


@query("m21_all_pairs_cascade_m19_m20", _ALL + " SELECT q, b, round(CASE WHEN score < 0.1 THEN score ELSE (score + 1) / 2 END, 6) AS stage1, round(CASE WHEN score >= 0.1 AND (score + 1) / 2 BETWEEN 0.6 AND 0.9 THEN score * score END, 6) AS stage2 FROM p")
def _(spark, sf):
    q, e = _queries(spark, sf)
    p = vectors.all_pairs(q.withColumnRenamed("vec_id", "q"), e.withColumnRenamed("vec_id", "b"), "q", "b")
    gate, band = F.col("score") >= 0.1, F.col("stage1").between(0.6, 0.9)
    out = vectors.staged(p.withColumn("stage1", F.col("score")), gate, band, lambda d: d.withColumn("stage1", (F.col("score") + 1) / 2), lambda d: d.withColumn("stage2", F.col("score") * F.col("score")))
    return out.select("q", "b", F.round("stage1", 6).alias("stage1"), F.round("stage2", 6).alias("stage2"))


@query("m23_m24_pair_argmax", _P50 + " SELECT q, arg_max(b, struct_pack(s := score, n := -b)) AS b FROM p WHERE q <> b GROUP BY 1")
def _(spark, sf):
    return _pairs(spark, sf).filter("q <> b").groupBy("q").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"))


@query("m27_fused_context", "SELECT group_id, string_agg(substring(text, 1, 200), ' ' ORDER BY source_index, source_key) AS fused FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY source_index, source_key) AS r FROM sources WHERE text IS NOT NULL AND group_id IS NOT NULL) WHERE r <= 3 GROUP BY 1")
def _(spark, sf):
    s = gold.first_n(table(spark, sf, "sources").filter("text is not null and group_id is not null"), ["group_id"], ["source_index", "source_key"], 3)
    got = s.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("source_index", "source_key", F.substring("text", 1, 200).alias("t")))).alias("x"))
    return got.select("group_id", F.array_join("x.t", " ").alias("fused"))


@query("m28_packed_sentences", None)
def _(spark, sf):
    from veriscope.functions.kernels import pack_budget

    g = table(spark, sf, "gold").filter("source_text is not null").select("row_id", T.token_set("claim").alias("c"), T.sentences("source_text").alias("s"))
    scored = g.select("row_id", "s", F.transform("s", lambda x: T.overlap(F.col("c"), T.token_set(x))).alias("p"))

    @F.pandas_udf("string")
    def pack(s, p):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([pack_budget(list(zip(map(float, b), a)), 500) for a, b in zip(s, p)])

    return scored.select("row_id", pack("s", "p").alias("packed"))


@query("m29_top_statements", f"""WITH s AS (SELECT row_id, {s_tokens('claim')} AS c, unnest(string_split(regexp_replace(source_text, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(source_text, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) - 1 AS i FROM gold WHERE source_text IS NOT NULL),
 o AS (SELECT row_id, i, CASE WHEN len(c) > 0 THEN round(len(list_intersect(list_distinct(c), list_distinct({s_tokens('s')})))::DOUBLE / len(list_distinct(c)), 6) ELSE 0.0 END AS p FROM s WHERE length(trim(s)) > 0)
 SELECT row_id, r AS rank, p FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, i) AS r FROM o) WHERE r <= 3""")
def _(spark, sf):
    s = table(spark, sf, "gold").filter("source_text is not null").select("row_id", T.token_set("claim").alias("c"), F.posexplode(T.sentences("source_text")).alias("i", "s"))
    s = s.withColumn("p", F.round(T.overlap(F.col("c"), T.token_set("s")), 6))
    top = s.select("row_id", "i", "p").withColumn("rank", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("p"), "i"))).filter("rank <= 3")
    return top.select("row_id", big("rank").alias("rank"), "p")


@query("m30_longest_span", None)
def _(spark, sf):
    asked = _evidence(spark, sf)
    spans = _distinct_pairs(spark, sf, asked).select("_cd", "_td", matching.longest_span("claim", "text").alias("span"))
    return asked.join(spans, ["_cd", "_td"]).groupBy("row_id").agg(F.max("span").alias("span")).withColumn("long", F.col("span") >= 40)


@query("m31_locations", f"""WITH x AS (SELECT chunk_id, char_start, substring(s.text, 1, char_start) AS head FROM chunks c JOIN sources s USING (source_key) WHERE char_start >= 0)
 SELECT chunk_id, len(string_split(head, chr(10))) AS line, length(string_split(head, chr(10))[-1]) + 1 AS col, len(regexp_extract_all(head, '\\n{SPACE}*\\n')) + 1 AS paragraph, len(string_split(head, chr(12))) AS page FROM x""")
def _(spark, sf):
    x = table(spark, sf, "chunks").select("chunk_id", "source_key", "char_start").filter("char_start >= 0").join(table(spark, sf, "sources").select("source_key", "text"), "source_key")
    line, col, para, page = matching.locate("text", "char_start")
    return x.select("chunk_id", big(line).alias("line"), big(col).alias("col"), big(para).alias("paragraph"), big(page).alias("page"))


@query("m11_index_chunks_k2_cache_keys", "SELECT chunk_id, substr(sha1('e5' || text), 1, 16) AS key FROM chunks WHERE text IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "chunks").filter("text is not null").select("chunk_id", T.text_hash(F.concat(F.lit("e5"), "text")).alias("key"))


# joins


@query("j1_claims_by_sources", "SELECT g.row_id, s.source_key FROM gold g JOIN sources s ON g.group_id = s.group_id")
def _(spark, sf):
    return table(spark, sf, "gold").join(table(spark, sf, "sources"), "group_id").select("row_id", "source_key")


@query("j2_terms_by_postings", _BM + " SELECT row_id, count(*) AS n FROM qt JOIN tf USING (group_id, term) GROUP BY 1")
def _(spark, sf):
    posts = bm25.postings(_passages(spark, sf), "group_id", "pid")
    asked = _claims(spark, sf).select("row_id", "group_id", F.explode(T.tokens("claim")).alias("term")).distinct()
    return asked.join(posts, ["group_id", "term"]).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))


@query("j3_topk_pairs", _P50 + " SELECT q, b FROM p WHERE rank <= 3")
def _(spark, sf):
    return _pairs(spark, sf, 3).select("q", "b")


@query("j4_inner", "SELECT g.uid, g.label, j.annotator_id FROM gold g JOIN judgments j USING (uid)")
def _(spark, sf):
    return table(spark, sf, "gold").select("uid", "label").join(table(spark, sf, "judgments").select("uid", "annotator_id"), "uid")


@query("j5_left_fp62_overwrite", "SELECT g.uid, coalesce(j.n, -1) AS n FROM gold g LEFT JOIN (SELECT uid, count(*) AS n FROM judgments GROUP BY 1) j USING (uid)")
def _(spark, sf):
    j = table(spark, sf, "judgments").groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "gold").select("uid").join(j, "uid", "left").select("uid", F.coalesce("n", F.lit(-1)).alias("n"))


@query("j6_three_tables", "SELECT g.uid, s.source_key, j.n FROM gold g JOIN sources s ON g.group_id = s.group_id AND s.source_index = 0 LEFT JOIN (SELECT uid, count(*) AS n FROM judgments GROUP BY 1) j ON g.uid = j.uid")
def _(spark, sf):
    j = table(spark, sf, "judgments").groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf, "sources").filter("source_index = 0").select("group_id", "source_key")
    return table(spark, sf, "gold").select("uid", "group_id").join(s, "group_id").join(j, "uid", "left").select("uid", "source_key", "n")


@query("j7_semi", "SELECT uid FROM gold WHERE uid IN (SELECT uid FROM judgments WHERE label = 'UNSURE')")
def _(spark, sf):
    return table(spark, sf, "gold").select("uid").join(table(spark, sf, "judgments").filter("label = 'UNSURE'"), "uid", "left_semi")


@query("j8_anti_k10_pending", "SELECT uid FROM gold WHERE uid NOT IN (SELECT uid FROM judgments WHERE uid IS NOT NULL)")
def _(spark, sf):
    return gold.pending(table(spark, sf, "gold").select("uid"), table(spark, sf, "judgments").filter("uid is not null"), "uid")


@query("j9_linked_augmentation", "SELECT count(*) AS n FROM gold a WHERE role = 'augmentation' AND group_id IN (SELECT group_id FROM gold WHERE role = 'eval' AND group_id <> '')")
def _(spark, sf):
    g = table(spark, sf, "gold")
    return g.filter("role = 'augmentation'").join(g.filter("role = 'eval' and group_id <> ''").select("group_id"), "group_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("j10_j11_j12_best_known", None)
def _(spark, sf):
    e = table(spark, sf, "extracted_claims").filter("claim is not null")
    known = e.select("answer_id", F.col("claim_key").alias("known_key"), F.col("claim"))
    return matching.best_known(e, known, "answer_id", "claim_key", "known_key", 0.9)


_V = "CASE WHEN regexp_replace(upper(label), '[^A-Z0-9]', '', 'g') IN ('SUPPORTED', 'SUPPORTS', '1') THEN 1 WHEN regexp_replace(upper(label), '[^A-Z0-9]', '', 'g') IN ('HALLUCINATION', 'REFUTES', '0') THEN 0 END"


def _verdict():
    x = F.regexp_replace(F.upper("label"), "[^A-Z0-9]", "")
    return F.when(x.isin("SUPPORTED", "SUPPORTS", "1"), 1).when(x.isin("HALLUCINATION", "REFUTES", "0"), 0)


@query("j13_c25_agreeing_judges", f"WITH v AS (SELECT DISTINCT uid, annotator_id, {_V} AS verdict FROM judgments) SELECT a.uid, a.verdict FROM v a JOIN v b ON a.uid = b.uid AND a.verdict = b.verdict WHERE a.annotator_id = 'ann_22' AND b.annotator_id = 'ann_15' AND a.verdict IS NOT NULL")
def _(spark, sf):
    return gold.agreeing(table(spark, sf, "judgments"), ["uid"], "annotator_id", _verdict(), "ann_22", "ann_15")


@query("j14_number_keys", None)
def _(spark, sf):
    from veriscope.functions import entities as E

    g = table(spark, sf, "gold").filter("source_text is not null").withColumn("_d", F.md5("source_text"))
    x, none = F.col("x"), F.lit("")
    key = lambda rank, unit, context: F.struct(F.lit(rank).alias("rank"), unit.alias("ku"), context.alias("kc"))
    # unit and context, else the unit, else the context; a number with neither has no key
    keys = F.filter(F.array(key(0, x["unit"], x["context"]), key(1, x["unit"], none), key(2, none, x["context"])), lambda k: (k["ku"] != "") | (k["kc"] != ""))
    mine = g.select("row_id", "_d", F.explode(E.numbers_column(F.col("claim"))).alias("x")).select("row_id", "_d", x["value"].alias("v"), x["unit"].alias("unit"), x["context"].alias("context"), F.explode_outer(keys).alias("k")).select("row_id", "_d", "v", "unit", "context", "k.*")
    theirs = g.dropDuplicates(["_d"]).select("_d", F.explode(E.numbers_column(F.col("source_text"))).alias("x")).select("_d", x["value"].alias("w"), F.explode(keys).alias("k")).select("_d", "w", "k.ku", "k.kc")
    theirs = theirs.groupBy("_d", "ku", "kc").agg(F.collect_set("w").alias("ws"))
    found = F.min(F.when(F.col("ws").isNotNull(), F.struct("rank", F.array_contains("ws", F.col("v")).cast("int").alias("held"))))
    return mine.join(theirs, ["_d", "ku", "kc"], "left").groupBy("row_id", "v", "unit", "context").agg(found.alias("x")).select("row_id", "v", "unit", "context", F.coalesce("x.held", F.lit(-1)).alias("held"))


@query("j15_name_categories", None)
def _(spark, sf):
    from veriscope.functions import entities as E

    d = table(spark, sf, "documents").select("doc_id", F.explode(E.names_column(F.col("text"))).alias("x")).select("doc_id", "x.*")
    return d.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "position").alias("first"))


@query("w7_position_in_answer", "SELECT claim_key, row_number() OVER (PARTITION BY answer_id ORDER BY claim_key) AS position FROM extracted_claims")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").select("claim_key", big(F.row_number().over(Window.partitionBy("answer_id").orderBy("claim_key"))).alias("position"))


@query("j18_translations", "SELECT a.uid, p.uid AS parent, p.label AS parent_label FROM gold a JOIN gold p ON a.parent_sid = p.uid WHERE a.label = p.label")
def _(spark, sf):
    g = table(spark, sf, "gold")
    p = g.select(F.col("uid").alias("parent"), F.col("label").alias("parent_label"))
    return g.select("uid", "parent_sid", "label").join(p, F.col("parent_sid") == F.col("parent")).filter("label = parent_label").select("uid", "parent", "parent_label")


# public entry points


@query("x2_ground_batch", None)
def _(spark, sf):
    from veriscope import api

    g = table(spark, sf, "gold").select(F.col("row_id").alias("claim_id"), F.coalesce("group_id", F.lit("")).alias("group_id"), "claim")
    return api.ground_batch(g, table(spark, sf, "sources"))


@query("x3_x4_k3_documents_a1_summary", None)
def _(spark, sf):
    from veriscope import api

    g = table(spark, sf, "gold").select(F.col("row_id").alias("claim_id"), F.coalesce("group_id", F.lit("")).alias("group_id"), "claim")
    return api.grounding_documents(api.with_adaptive_gap(api.ground_batch(g, table(spark, sf, "sources"))))
