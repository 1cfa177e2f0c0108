"""Operators on ranks, histograms and folds against plain Python; layers given from outside; queries on the small tables."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from veriscope import api
from veriscope.functions import kernels as K
from veriscope.functions import text as T
from veriscope.operators import calibrate, evaluate, features, gold, ranks
from veriscope.plans import shared

SMALL = "/root/testdata/sf0.001"


def test_places_sums_and_next_of_keys_of_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.random(), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(5)
    got = {r["i"]: r for r in ranks.ranked(df, ["k"], ["v", "i"], sums=("v",), ahead="v").collect()}
    assert len(got) == 400
    for k in {r[0] for r in rows}:
        own = sorted((v, i) for kk, v, i in rows if kk == k)
        for place, (v, i) in enumerate(own, 1):
            r = got[i]
            assert (r["_place"], r["_rows"]) == (place, len(own)) and r["_sum_v"] == pytest.approx(sum(x for x, _ in own[:place])) and r["_all_v"] == pytest.approx(sum(x for x, _ in own))
            assert r["_next"] == (own[place][0] if place < len(own) else None)
    assert ranks.ranked(df.limit(0), ["k"], ["v", "i"]).count() == 0 and ranks.ranked(df, [], ["i"]).agg(F.max("_place")).first()[0] == 400


def test_quantiles_are_exact(spark):
    xs = [random.Random(2).gauss(0, 1) for _ in range(101)]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 5.0), ("c", None)], "k string, v double")
    got = {(r["k"], r["q"]): r["value"] for r in ranks.quantiles(df, ["k"], "v", [0.0, 0.25, 0.9, 1.0]).collect()}
    cut = statistics.quantiles(xs, n=20, method="inclusive")
    assert got["a", 0.25] == pytest.approx(cut[4]) and got["a", 0.9] == pytest.approx(cut[17]) and got["a", 0.0] == min(xs) and got["a", 1.0] == max(xs)
    assert got["b", 0.9] == 5.0 and not any(k == "c" for k, _ in got)


def test_bands_against_every_record(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.randint(0, 1), rng.random() < 0.5) for _ in range(300)] + [(None, 1, True), (0.5, None, True)]
    df = spark.createDataFrame(rows, "p double, y int, m boolean")
    got = evaluate.band_sweep(df, "p", "y", F.lit(0), F.col("m"), F.lit(1), [0.1, 0.3], [0.3, 0.8]).collect()
    assert {(r["lo"], r["hi"]) for r in got} == {(0.1, 0.3), (0.1, 0.8), (0.3, 0.8)}
    for r in got:
        say = lambda p, m: 0 if p <= r["lo"] else 1 if p >= r["hi"] else int(m)
        use = [(say(p, m), y, r["lo"] < p < r["hi"]) for p, y, m in rows if p is not None and y is not None]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == tuple(sum(s == a and y == b for s, y, _ in use) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
        assert r["share"] == pytest.approx(sum(x for *_, x in use) / len(use))


def test_resampling_modes(spark):
    rows = [(f"u{i}", int(i % 4 > 0), "en" if i % 3 else "de") for i in range(120)] + [("x", None, "en")]
    got = gold.resampled(spark.createDataFrame(rows, "uid string, label int, lang string"), "uid", "label", F.col("lang") != "en").collect()
    total = lambda mode, test: sum(r["copies"] for r in got if r["mode"] == mode and test(r))
    assert [total("oversample_minority", lambda r, k=k: r["label"] == k) for k in (0, 1)] == [90, 90]
    assert [total("undersample_majority", lambda r, k=k: r["label"] == k) for k in (0, 1)] == [30, 30]
    assert total("oversample_foreign", lambda r: r["lang"] == "de") == 80 == total("oversample_foreign", lambda r: r["lang"] == "en")
    assert total("oversample_foreign_negatives", lambda r: True) == 120 + 4 * sum(r[1] == 0 and r[2] == "de" for r in rows)
    assert max(r["copies"] for r in got if r["mode"] == "oversample_minority") - 3 <= 0


def test_anchor_head_means_what_the_prior_means(spark):
    head = calibrate.default_head(spark)
    assert calibrate.anchor_frame(spark).count() == 28 and head.mean["exact"] > 3 and head.mean["entity_absent"] < 0 and len(head.sd) == len(head.mean)
    s = calibrate.evaluate(head, calibrate.anchor_frame(spark), "grounded").first()
    assert s["accuracy"] == 1.0


def test_factories_learn_what_a_line_cannot(spark):
    from veriscope.operators import models

    rng = random.Random(4)
    rows = [(i, f"g{i % 30}", a := rng.random(), b := rng.random(), int((a > 0.5) != (b > 0.5))) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, g string, a double, b double, y int")
    out = models.out_of_fold(df, ["a", "b"], "y", "g", "i", {"boosted": models.boosted(), "logistic": models.logistic()})
    got = {r["model"]: r["auc"] for r in evaluate.auc(out, ["model"], "probability", "y").collect()}
    assert out.count() == 1200 and got["boosted"] > 0.9 > 0.65 > got["logistic"]


def test_accent_free_text_in_the_engine_equals_the_kernel(spark):
    texts = ["Élève à Ångström", "naïve Ü ñ ç", "Ё Й ά", "ｆｕｌｌ ²", "éx", None, "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.strip_accents("t")).collect()] == [K.strip_accents(t) if t is not None else None for t in texts]
    assert df.limit(1).select(T.bare_ngrams("t", 3, 3)).first()[0][:3] == ["#el", "ele", "lev"]


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: Conf()})()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(Session())
    work = shared.Workspace(spark, "closing")
    work.save(spark.range(3), "t")
    assert shared.exists(spark, work.root)
    work.close()
    assert not shared.exists(spark, work.root)


def _hot(spark, n=300):
    claims = spark.createDataFrame([(f"c{i}", "hot" if i < n else f"g{i}", f"The pump number {i % 40} was closed in spring") for i in range(n + 20)] + [("n", None, "x"), ("m", "hot", None)], "claim_id string, group_id string, claim string")
    texts = [("hot", k, f"p{k}", f"We saw it. The pump number {k * 3} was closed in spring of that year.\n\nNothing else.\n\nMore words.") for k in range(12)]
    return claims, spark.createDataFrame(texts, "group_id string, source_index int, source_path string, text string")


def test_a_hot_group_is_dealt_in_blocks_and_every_claim_has_a_row(spark):
    claims, sources = _hot(spark)
    sizes = [len(r["qs"]) for r in api._blocks(claims.filter("claim is not null and group_id = 'hot'").withColumn("qid", F.md5("claim_id"))).collect()]
    assert sum(sizes) == 300 and max(sizes) < 3 * api.BLOCK and len(sizes) == 5
    got = {r["claim_id"]: r for r in api.ground_batch(claims, sources).collect()}
    assert len(got) == 322
    assert got["c3"]["match_type"] == "exact" and got["c3"]["source_index"] == 1 and got["c43"]["source_index"] == 1
    assert got["c305"]["match_type"] == got["n"]["match_type"] == "none" and got["m"]["combined_score"] == 0 and got["n"]["entities_absent"] == []


def test_layers_from_outside_decide(spark):
    claims = spark.createDataFrame([("a", "g", "Water flows downhill here"), ("b", "g", "Seven cats sleep")], "claim_id string, group_id string, claim string")
    sources = spark.createDataFrame([("g", 0, "main.txt", "Nothing alike stands in this text at all.")], "group_id string, source_index int, source_path string, text string")
    assert {r["match_type"] for r in api.ground_batch(claims, sources).collect()} == {"none"}

    def semantic(asked, texts):
        return asked.select("qid", F.when(F.col("claim").startswith("Water"), 0.9).otherwise(0.1).alias("semantic_score"), F.lit(1.0).alias("semantic_ratio"), F.lit("a passage").alias("semantic_text"), F.lit(0).alias("semantic_source"))

    got = {r["claim_id"]: r for r in api.ground_batch(claims, sources, semantic=semantic, primary_source="other.txt").collect()}
    assert got["a"]["match_type"] == "semantic" and "other_source" in got["a"]["verification_reasons"] and got["b"]["match_type"] == "none"

    def nli(premise, claim):
        no = claim.startswith("Seven")
        return F.struct(F.when(no, 0.1).otherwise(0.8).alias("entailment"), F.lit(0.1).alias("neutral"), F.when(no, 0.8).otherwise(0.1).alias("contradiction"))

    got = {r["claim_id"]: r["match_type"] for r in api.ground_batch(claims, sources, nli=nli).collect()}
    assert got == {"a": "fuzzy", "b": "contradicted"}
    head = calibrate.Head({"Intercept": 2.0, "nli_contra": -9.0}, threshold=0.6)
    got = {r["claim_id"]: r for r in api.ground_batch(claims, sources, nli=nli, head=head).collect()}
    assert got["a"]["verdict_probability"] > 0.6 and got["a"]["match_type"] == "fuzzy" and got["b"]["match_type"] == "contradicted"


def test_tiers_with_a_translator(spark):
    text = "Die Pumpe wurde geschlossen. " * 3
    rows = spark.createDataFrame([(1, "the pump was closed", text, "en", "de"), (2, "la pompe", text, "fr", "de"), (3, None, None, None, None)], "row_id long, claim string, source_text string, l string, s string")
    bg = features.rarity(rows.select(F.col("source_text").alias("text")))
    high = {r["row_id"]: r for r in features.tier(rows, bg, "high", "l", "s", lambda t, lang: F.lit("die pumpe wurde geschlossen")).collect()}
    assert high[2]["r1_mt"] == high[2]["r1_best"] > 0.9 > high[2]["r1_direct"] and high[1]["r1_mt"] == high[1]["r1_direct"] and (high[1]["is_en"], high[1]["same_lang"]) == (1.0, 0.0)
    assert features.tier(rows, bg, "medium", "l", "s").columns == ["row_id", *features.MEDIUM] and len(high) == 3


SLOW = ("c1_", "c28_", "fp24_", "x2_", "x3_", "c38_", "c23_", "c15_", "c4_", "c2_", "c9_", "a21_c", "k7_")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no small tables here")
def test_core_queries_run_on_the_small_tables(spark):
    """Every query is planned, and those run that no SQL is held against; with ``VERISCOPE_ALL`` all of them run."""
    from veriscope import catalogue

    wrong, sql, every = [], catalogue.oracle_sql(), "VERISCOPE_ALL" in os.environ
    for name, q in catalogue.queries().items():
        if not name.startswith(SLOW):  # fits and whole passes have tests of their own
            try:
                df = q(spark, SMALL)
                if every or name not in sql:
                    df.write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001
                wrong.append((name, str(e)[:200]))
    assert wrong == []


def test_commands_for_settings_and_calibration(spark, tmp_path, capsys):
    import json

    from veriscope.cli import main

    assert main(["config"], spark) == 0 and json.loads(capsys.readouterr().out)["fuzzy_threshold"] == 0.85
    rows = [{"claim": f"The pump number {i} was closed", "source_text": f"In spring the pump number {i} was closed. Then rain fell.", "label": 1, "lang": "en"} for i in range(6)]
    rows += [{"claim": f"Tall towers stood in city {i}", "source_text": "Only fields and rivers are told of here.", "label": 0, "lang": "de"} for i in range(6)]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    head = str(tmp_path / "head.json")
    assert main(["calibration", "fit", str(tmp_path / "r.jsonl"), head], spark) == 0 and main(["calibration", "eval", str(tmp_path / "r.jsonl"), head], spark) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {r["scope"] for r in out} == {"all", "en", "de"} and next(r for r in out if r["scope"] == "all")["accuracy"] == 1.0
    assert main(["calibration", "export", head], spark) == 0 and calibrate.Head.load(head).mean["exact"] > 3
    assert main(["calibration"], spark) == 2


def test_sets_meet_on_their_rarest_members(spark):
    from veriscope.operators import consistency

    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    lines = [", ".join(rng.sample(words, rng.randint(2, 5))) for _ in range(40)]
    d = spark.createDataFrame([(1, "\n".join(f"Teams: {x}" for x in lines))], "k int, text string")
    got = {(tuple(r["set_a"]), tuple(r["set_b"])) for r in consistency.set_pairs(d, "k").collect()}
    sets = {(tuple(r["members"]), r["line"]) for r in consistency.sets(d, "k").collect()}
    want = {(a, b) for a, i in sets for b, j in sets if (i, a) < (j, b) and len({*a} & {*b}) >= 0.5 * len({*a} | {*b})}
    assert got == want and len(want) > 20
