import json

import pytest
from pyspark.sql import functions as F

from veriscope import api
from veriscope.config import Settings, SettingsError, load
from veriscope.functions import text as T
from veriscope.operators import bm25, calibrate, consistency, evaluate, features, segment, vectors
from veriscope.sources import readers, writers


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_settings_layers(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"fuzzy_threshold": 0.7}))
    assert load(str(p), bm25_threshold=0.2).fuzzy_threshold == 0.7
    assert Settings().overlay(fuzzy_threshold=None).fuzzy_threshold == 0.85
    with pytest.raises(SettingsError):
        Settings(classifier_mode="other")
    with pytest.raises(SettingsError):
        Settings().overlay(nothing=1)


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ünder  SCORE_1 ΣΑΣ ",), (None,), ("",)], "t string")
    got = df.select(T.normalize_whitespace("t"), T.tokens("t")).collect()
    assert got[0][0] == "Ünder SCORE_1 ΣΑΣ" and got[0][1] == ["ünder", "score_1", "σασ"]
    assert got[1][1] == [] and got[2][1] == []
    one = spark.range(1)
    assert one.select(T.char_ngrams(F.lit("ab"))).first()[0] == ["#ab", "ab#", "#ab#"]
    assert one.select(T.char_windows(F.lit("abcdefg"), 4, 2)).first()[0] == ["abcd", "cdef", "efg", "g"]
    assert one.select(T.strip_markdown(F.lit("> - item")), T.strip_markdown(F.lit("# head")), T.strip_markdown(F.lit("| a |"))).first()[:] == ("item", "", "")


def test_bm25_needs_three_passages(spark):
    claims = spark.createDataFrame([(1, "g", "red pump"), (2, "g", ""), (3, "h", "red pump")], "id int, g string, claim string")
    ps = spark.createDataFrame([("g", 0, "red pump works"), ("g", 1, "blue hose"), ("g", 2, "green tank"), ("h", 0, "red pump")], "g string, p int, text string")
    got = bm25.best_passage(claims, ps, "id", "g", "p").collect()
    assert [(r["id"], r["p"], round(r["recall"], 6)) for r in got] == [(1, 0, 1.0)]


def test_extraction_numbers_lines(spark):
    d = spark.createDataFrame([(1, "# Head\n\nThe pump was closed in spring. It was opened later on.\n\n- A list item that has words"), (2, None), (3, "")], "k int, text string")
    got = rows(segment.extract_claims(d.filter("text is not null"), "k").orderBy("id"))
    assert got == [(1, "c01", 3, "The pump was closed in spring."), (1, "c02", 3, "It was opened later on."), (1, "c03", 5, "A list item that has words")]


def test_ground_batch(spark):
    claims = spark.createDataFrame([("c1", "g", "the pump  was CLOSED"), ("c2", "g", "It has 42 nodes in total"), ("c3", "none", "no sources"), ("c4", "g", None)], "claim_id string, group_id string, claim string")
    sources = spark.createDataFrame([("g", 0, "a.txt", "In spring the pump was closed.\n\nIt has 12 nodes in total"), ("g", 1, None, None), ("g", 2, "b.txt", "")], "group_id string, source_index int, source_path string, text string")
    got = {r["claim_id"]: r for r in api.ground_batch(claims, sources).collect()}
    assert got["c1"]["match_type"] == "exact" and got["c1"]["source_index"] == 0 and got["c1"]["location"]["line_start"] == 1
    assert got["c2"]["match_type"] == "contradicted" and got["c2"]["numeric_mismatches"] == [["42", "12"]]
    assert got["c3"]["match_type"] == "none" and got["c3"]["combined_score"] == 0
    assert len(got) == 4
    doc = api.grounding_documents(api.ground_batch(claims, sources)).filter("group_id = 'g'").first()
    assert (doc["total"], doc["grounded"]) == (3, 1) and json.loads(doc["document"])["claims"][0]["support"]["source_index"] == 0
    assert api.ground(spark, "pump was closed", ["the pump was closed"]).first()["match_type"] == "exact"
    assert api.ground_batch(claims.limit(0), sources).count() == 0


def test_measures(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0), (0.2, 1), (0.1, None)], "p double, y int")
    pos, neg = [0.9, 0.7, 0.2], [0.8, 0.2]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 6
    assert abs(evaluate.auc(df, [], "p", "y").first()["auc"] - want) < 1e-12
    scan = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in evaluate.scan(df, [], "p", "y", F.array(F.lit(0.2), F.lit(0.75))).collect()}
    assert scan == {0.2: (3, 2, 0, 0), 0.75: (1, 1, 2, 1)}
    assert evaluate.auc(df.limit(0), [], "p", "y").first()["auc"] is None


def test_gaps(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.1, 0.12, 0.5, 0.55, 0.9])] + [("b", 9, 0.3)], "k string, i int, p double")
    got = rows(evaluate.adaptive_gap(df, "k", "p", "i"))
    assert got == [("a", pytest.approx(0.31), pytest.approx(0.38))]
    assert rows(evaluate.jenks(df, "k", "p", "i")) == [("a", pytest.approx(0.31))]


def test_fit_recovers_direction(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 10) / 10, float(i % 3), int(i % 10 >= 5)) for i in range(200)], "x double, z double, y int")
    head = calibrate.fit_balanced(df, ["x", "z"], "y")
    assert head.mean["x"] > 3 and abs(head.mean["z"]) < 0.5 and 0.2 <= head.threshold <= 0.8
    head.save(str(tmp_path / "h.json"))
    assert calibrate.Head.load(str(tmp_path / "h.json")).mean == head.mean
    assert calibrate.evaluate(head, df, "y").first()["accuracy"] > 0.9


def test_vector_top_k_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "b long, embedding array<double>")
    got = vectors.top_k(df.filter("b % 20 = 0").withColumnRenamed("b", "q"), df, "q", "b", 3).orderBy("q", "rank").collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        assert [r["b"] for r in got if r["q"] == q] == np.argsort(-(n @ n[q]))[:3].tolist()


def test_early_exit(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.1, 0.9, 0.2, 0.95])] + [(2, 0, 0.0)], "k int, o int, s double")
    assert sorted(rows(vectors.early_exit_max(df, "k", "o", "s", 0.8))) == [(1, 0.9, 2), (2, 0.0, 1)]


def test_consistency(spark):
    d = spark.createDataFrame([(1, "We run 42 nodes.\nLater 12 nodes ran.\nEnvs: dev, test, prod\nEnvs again: dev, test, qa\nPython 3 and more\nPython Next X2"), (2, "")], "k int, text string")
    kinds = {r["kind"] for r in consistency.check(d, "k").collect()}
    assert kinds == {"numeric", "entity_set"}
    assert "Self-Consistency Report" in consistency.report(consistency.check(d, "k"), "k").first()["report"]


def test_readers(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\x00")
    assert [r["text"] for r in readers.evidence(spark, str(tmp_path)).collect()] == ["héllo"]
    for body, want in (('["a", "b"]', ["a", "b"]), ('[{"claim": "x", "id": "1", "other": 2}]', ["x"]), ("one\n\n two \n", ["one", "two"])):
        (tmp_path / "c.json").write_text(body)
        assert [r["claim"] for r in readers.claims(spark, str(tmp_path / "c.json")).orderBy("position").collect()] == want
    (tmp_path / "r.jsonl").write_text('{"c": "x", "s": "y", "l": 1}\n')
    assert rows(readers.records(spark, str(tmp_path / "r.jsonl"), "c", "s", "l")) == [("x", "y", 1, None)]
    with pytest.raises(ValueError):
        readers.records(spark, str(tmp_path / "r.jsonl"))
    with pytest.raises(ValueError):
        readers.records(spark, "x.xlsx")


def test_append_pending_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(5)], "k int")
    out = str(tmp_path / "out")
    writers.append_pending(spark, df.filter("k < 3"), "k", out, lambda d: d.withColumn("v", F.col("k") * 2))
    writers.append_pending(spark, df, "k", out, lambda d: d.withColumn("v", F.col("k") * 3))
    assert sorted(rows(spark.read.parquet(out))) == [(0, 0), (1, 2), (2, 4), (3, 9), (4, 12)]
    calls = []

    def embed(d):
        calls.append(d.count())
        return d.withColumn("vec", F.array(F.length("text").cast("float")))

    t = spark.createDataFrame([("a",), ("bb",), ("a",)], "t string")
    for _ in range(2):
        assert writers.cached_vectors(spark, t, "t", "m", embed, str(tmp_path / "cache")).count() == 2
    assert calls == [2, 0]


def test_low_tier_features(spark):
    g = spark.createDataFrame([(1, "The pump was closed in 1999", "In 1999 the pump was closed. " * 30), (2, "Something else", None), (3, "", "text")], "row_id long, claim string, source_text string")
    bg = features.rarity(spark.createDataFrame([("the pump was closed",)], "text string"))
    got = {r["row_id"]: r for r in features.low_tier(g, bg).collect()}
    assert len(got) == 3 and got[1]["oracle"] > 0.9 and got[2]["r1_direct"] == 0 and got[1]["anchor"] == 1.0


def test_streaming(spark, tmp_path):
    from veriscope.streaming import claims as S

    src = str(tmp_path / "in")
    spark.createDataFrame([("g", "the pump"), ("g", "nothing")], "group_id string, claim string").write.json(src)
    st = spark.readStream.schema("group_id string, claim string").json(src)
    sources = spark.createDataFrame([("g", 0, "The  Pump runs")], "group_id string, source_index int, text string")
    q = S.exact_in_evidence(st, sources).writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert [r["claim"] for r in spark.sql("select * from found").collect()] == ["the pump"]


def test_cli(spark, tmp_path, capsys):
    from veriscope.cli import main

    (tmp_path / "claims.txt").write_text("the pump was closed\n")
    (tmp_path / "e.txt").write_text("We saw that the pump was closed.")
    assert main(["ground", str(tmp_path / "claims.txt"), str(tmp_path / "e.txt")], spark) == 0
    assert '"grounded":1' in capsys.readouterr().out
    (tmp_path / "claims.txt").write_text("zzzz qqqq\n")
    assert main(["ground", str(tmp_path / "claims.txt"), str(tmp_path / "e.txt")], spark) == 1
    assert main(["nonsense"], spark) == 2
    assert main(["extract-claims", str(tmp_path / "e.txt")], spark) == 0


def test_every_query_has_a_name_and_sql_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150
