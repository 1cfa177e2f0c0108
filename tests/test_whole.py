"""Queries that must do the whole job: nothing cut away before it is measured."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.operators import vectors


def test_vector_summaries_count_more_than_50_partners(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=8) + 0.05 * rng.normal(size=(80, 8)), rng.normal(size=(60, 8))])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "b long, embedding array<double>").repartition(5)
    got = {r["q"]: r for r in vectors.summaries(df.filter("b % 20 = 0").withColumnRenamed("b", "q"), df, "q", "b").collect()}
    x = x.astype(np.float32).astype(float)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 7 and max(r["log_high"] for r in got.values()) > np.log1p(50)
    for q, r in got.items():
        s = np.round(np.delete(n @ n[q], q), 9)
        assert r["log_high"] == pytest.approx(np.log1p((s >= 0.5).sum()))
        assert r["soft_max"] == pytest.approx(0.1 * np.log(np.exp(s / 0.1).sum())) and r["top"] == pytest.approx(s.max())
        two = np.sort(s)[::-1][:2]
        assert (r["top2_mean"], r["margin"]) == (pytest.approx(two.mean()), pytest.approx(two[0] - two[1]))
        at, sizes = 0, [1, 1, 2] + [4] * 99
        while at < len(s) and not (s[:at] >= 0.3).any():
            at = min(len(s), at + sizes.pop(0))
        assert (r["best"], r["scored"]) == (pytest.approx(s[:at].max()), at)
        assert [r["k1"], r["k3"], r["k8"]] == pytest.approx([s[:k].max() for k in (1, 3, 8)])


def test_vector_sample_and_pairs_are_of_the_whole_table(spark):
    x = np.random.default_rng(4).normal(size=(70, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "b long, embedding array<double>").repartition(3)
    s = [r[0] for r in vectors.sampled_pairs(df, "b").collect()]
    assert len(s) == 200 and min(s) < 0 and max(s) < 1
    p = vectors.all_pairs(df.filter("b = 7").withColumnRenamed("b", "q"), df, "q", "b").collect()
    assert sorted(r["b"] for r in p) == [i for i in range(70) if i != 7]


def test_best_passage_is_of_the_whole_text(spark, tmp_path):
    import __spark_entry__ as e

    fill = " ".join(f"Sentence {chr(97 + i)}{chr(98 + i)} speaks of weather, roads and gardens in quiet towns." for i in range(20))
    late = fill + " The northern plant has 42 turbines in total."
    g = [(1, "The northern plant has 57 turbines in total.", late), (2, "The northern plant has 42 turbines in total.", late), (3, "x", None), (4, "", late), (5, "abc", "")]
    spark.createDataFrame(g, "row_id long, claim string, source_text string").write.parquet(str(tmp_path / "gold.parquet"))
    got = {r["row_id"]: r for r in e.queries()["fp15_anchor_fp16_specificity_fp17_conflict"](spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got[1]["conflict_flag"] == 1 and got[1]["num_edit_mag"] > 0 and got[1]["anchor_mm"] == 1
    assert got[2]["fuzzy"] > 0.95 and got[2]["conflict_flag"] == 0
    assert got[3]["fuzzy"] == got[4]["fuzzy"] == got[5]["fuzzy"] == 0


def test_every_row_is_matched_with_all_its_sources(spark, tmp_path):
    import __spark_entry__ as e

    said = "The old pump was closed for repairs in the spring of that year."
    g = [(1, "g", said, "Nothing of this."), (2, "g", said, "Nothing of this."), (3, None, said, said), (4, "none", said, said), (5, "g", None, ""), (6, "", said, None)]
    s = [("g", 0, "Nothing of this."), ("g", 1, "We saw: " + said), ("g", 2, said), ("g", 3, None), (None, 0, said)]
    spark.createDataFrame(g, "row_id long, group_id string, claim string, source_text string").write.parquet(str(tmp_path / "gold.parquet"))
    spark.createDataFrame(s, "group_id string, source_index int, text string").write.parquet(str(tmp_path / "sources.parquet"))
    got = {r["row_id"]: r for r in e.queries()["m2_m3_fuzzy_m31_location"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    for i, at, start in ((1, 1, 8), (2, 1, 8), (3, 0, 0), (4, 0, 0)):
        assert (got[i]["exact"], got[i]["fuzzy"], got[i]["source_index"], got[i]["fuzzy_location"]["char_start"]) == (True, 1.0, at, start)
    assert not got[5]["exact"] and got[5]["fuzzy"] == 0
    span = {r["row_id"]: (r["span"], r["long"]) for r in e.queries()["m30_longest_span"](spark, str(tmp_path)).collect()}
    assert span == {**dict.fromkeys([1, 2, 3, 4], (len(said), True)), 5: (0, False)}


def test_number_keys_fall_back_as_the_kernel_does(spark, tmp_path):
    import __spark_entry__ as e
    from veriscope.functions import entities as E

    pairs = [("It grew by 40 %.", "It has a 40 % share."), ("It grew by 40 %.", "It has a 30 % share."), ("It has 40 nodes.", "It has 40 nodes."), ("It has 40 nodes.", "We saw 30 GB nodes."), ("It weighs 40 GB.", "In all 12 files."), ("Just 40.", "Just 40."), ("A 40 % share.", "A 30 % share and 40 % profit.")]
    g = [(i, c, s) for i, (c, s) in enumerate(pairs)]
    spark.createDataFrame(g, "row_id long, claim string, source_text string").write.parquet(str(tmp_path / "gold.parquet"))
    got = {(r["row_id"], r["v"], r["unit"], r["context"]): r["held"] for r in e.queries()["j14_number_keys"](spark, str(tmp_path)).collect()}
    want = {}
    for i, c, s in g:
        for v, u, w in E.numbers(c):
            want[(i, v, u, w)] = -1
            for ku, kw in ((u, w), (u, ""), ("", w)):
                there = [x for x, xu, xw in E.numbers(s) if (ku, kw) in ((xu, xw), (xu, ""), ("", xw))] if (ku, kw) != ("", "") else []
                if there:
                    want[(i, v, u, w)] = int(v in there)
                    break
    assert got == want
    assert [{h for (i, *_), h in got.items() if i == k} for k in range(7)] == [{1}, {0}, {1}, {0}, {-1}, {-1}, {0}]


def test_ratio_and_held_out_accuracy_have_queries(spark, tmp_path):
    import __spark_entry__ as e

    v = [(0, [3.0, 0.0]), (1, [0.0, 2.0]), (20, [1.0, 1.0]), (40, None)]
    spark.createDataFrame([(i, x, 0) for i, x in v], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["q"]: r["ratio"] for r in e.queries()["m13_semantic_ratio"](spark, str(tmp_path)).collect()}
    assert got == {0: pytest.approx(0.707107), 20: pytest.approx(0.707107)}
    g = [("en", "red pump", "red pump", 1), ("en", "blue hose", "none", 0), ("de", "red pump", "red pump", 0), ("de", "tank", "tank", 1), ("de", "tank", "x", None)]
    spark.createDataFrame([(i, f"u{i}", "g", "eval", "o", *r) for i, r in enumerate(g)], "row_id long, uid string, group_id string, role string, origin string, lang string, claim string, source_text string, label int").write.parquet(str(tmp_path / "gold.parquet"))
    got = {r["lang_norm"]: (r["accuracy"], r["n"]) for r in e.queries()["c32_held_out_accuracy"](spark, str(tmp_path)).collect()}
    assert got == {"en": (1.0, 2), "de": (0.5, 2)}


def test_fuzzy_scores_of_many_pairs_are_those_of_each():
    import random

    from veriscope.functions import kernels as K

    rng = random.Random(5)
    draw = lambda most: "".join(rng.choices(rng.choice(["ab", "abcd ", "abcdefghij 日é😀"]), k=rng.randint(0, most)))
    pairs = [(draw(30), draw(90)) for _ in range(900)] + [("x" * 130, "xy" * 400), ("", ""), ("a", "a")]
    assert K.partial_ratios(pairs) == [K.partial_ratio(*p) for p in pairs]
    for c, t in [("Der  STRASSE ſee", "in der\nstrasse See dort"), ("İı", "iİ"), ("Kelvin", "30 Kelvin"), ("σας", "ΣΑΣ"), ("ab", "a b"), ("", "x"), ("ﬅ", "ﬆ")]:
        assert bool(K.exact_span(c, t)) == bool(K.one_case(c) and K.one_case(c) in K.one_case(t)), (c, t)


def test_records_in_one_pass_have_the_scores_of_the_postings(spark):
    from veriscope.functions import text as T
    from veriscope.operators import bm25, features, lexical, segment
    from veriscope.plans.shared import Workspace

    word = lambda i: "".join(chr(97 + i * k % 26) for k in (1, 3, 7, 11, 5))
    long = " ".join(f"Of {word(i)} and {word(i + 40)} tells pump {i % 3}, été {word(i + 80)}." for i in range(40))
    rows = [(i, f"The pump {i % 4} and {word(i)} ran in été {word(i + 41)}", long) for i in range(1200)]
    rows += [(2000, None, long), (2001, "pump", None), (2002, "pump", "..."), (2003, "...", "pump here"), (2004, "Nothing alike", "pump here"), (2005, "pump here", "pump here")]
    df = spark.createDataFrame(rows, "row_id long, claim string, source_text string")
    bg = features.rarity(df.select(F.col("source_text").alias("text")))
    got = {r["row_id"]: r for r in features.low_tier(df, bg, keep=("_claim", "_best")).collect()}
    assert len(got) == len(rows) and got[2000]["_claim"] is None and got[2001]["_best"] is None and got[2005]["oracle"] == 1
    rec = df.select("row_id", "claim", F.coalesce("source_text", F.lit("")).alias("s")).withColumn("d", F.md5("s"))
    work = Workspace(spark, "t")
    chunks = work.save(segment.view_chunks(rec.select("d", "s").distinct(), ["d"], "s"), "chunks")
    for name, analyzer in (("top", T.tokens), ("charng", T.bare_ngrams)):
        posts = work.save(bm25.postings(chunks, "d", "chunk_no", analyzer=analyzer), name)
        stats = bm25.statistics(posts, "d", "chunk_no")
        if name == "top":
            want = bm25.rank_recalls(bm25.recalls(rec, posts, *stats, "row_id", "d", "chunk_no", background=bg), "row_id", "chunk_no")
            want = {r["row_id"]: (r["oracle"], r["second"]) for r in want.collect()}
            assert all((got[i]["oracle"], got[i]["top3"]) == pytest.approx(want.get(i, (0, 0))) for i in got) and len(want) > 1000
        else:
            won = bm25.scores(rec, posts, *stats, "row_id", "d", "chunk_no", analyzer=analyzer).filter("score > 0").groupBy("row_id", "d").agg(F.min_by("chunk_no", F.struct(-F.col("score"), F.col("chunk_no"))).alias("chunk_no"))
            want = {r["row_id"]: r["recall"] for r in bm25.recall_of(won, rec, posts, *stats, "row_id", "d", "chunk_no", analyzer=analyzer).collect()}
            assert all(got[i]["charng"] == pytest.approx(want[i]) for i in want) and len(want) > 300
            # m9: the passages of a group in one row
            best = {r["row_id"]: r["recall"] for r in lexical.best_recall(rec, chunks, "row_id", "d", "chunk_no").collect()}
            want = {r["row_id"]: r["m"] for r in bm25.recalls(rec, posts, *stats, "row_id", "d", "chunk_no", analyzer=analyzer).groupBy("row_id").agg(F.max("recall").alias("m")).collect()}
            assert best == pytest.approx(want)
    texts = ["Straße ÉTÉ 2½ a_b Ⅳ x²", "ΣΊΣΥΦΟΣ İstanbul", "日本 語e\u0301", None, ""]
    t = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.tokens("x").alias("t"), T.bare_ngrams("x").alias("g")).collect()
    assert all((lexical.tokens(r["x"] or ""), lexical.bare_ngrams(r["x"] or "")) == (r["t"], r["g"]) for r in t)
