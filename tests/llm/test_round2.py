import collections
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from veriscope.llm import canonical_text as C  # noqa: E402
from veriscope.llm import consensus as V  # noqa: E402
from veriscope.llm import fill_containers as B  # noqa: E402
from veriscope.llm import language_labels as L  # noqa: E402
from veriscope.llm import related_splits as R  # noqa: E402
from veriscope.llm import sentences as S  # noqa: E402
from veriscope.llm import tokenize_automaton as T  # noqa: E402
from veriscope.plans.shared import Workspace  # noqa: E402

LANGS = [("en", "eng", "English"), ("fr", "fra", "French")]


def test_language_sample_is_of_distinct_texts_and_bounded(spark):
    hot = [("one text that nine rows in ten have", "en" if i % 10 else "fr", f"g{i}") for i in range(3600)]
    df = spark.createDataFrame(hot + [(f"text number {i}", "fr", "g") for i in range(400)] + [(None, "fr", "g"), ("x", None, None)], "claim string, lang string, group_id string").repartition(7)
    got = L.training_sample(df, LANGS, size=100).collect()
    assert 80 < len(got) < 170 and len({r["t"] for r in got}) == len(got)
    assert {r["c"] for r in L.training_sample(df, LANGS, size=10_000).filter("t like 'one%'").collect()} == {"en"}
    assert L.training_sample(df, LANGS, size=10_000).count() == 401 and L.training_sample(df.limit(0), LANGS).count() == 0


def test_sentence_sample_bounds_an_answer(spark):
    rows = [("hot", f"k{i}", f"Claim {i}.") for i in range(3000)] + [(f"a{i}", f"k{i}-{j}", "Claim.") for i in range(300) for j in range(3)] + [(None, "k", "x"), ("a", "k", None)]
    df = spark.createDataFrame(rows, "answer_id string, claim_key string, claim string").repartition(6)
    got = collections.Counter(r["answer_id"] for r in S.training_sample(df, size=10_000, most=40).collect())
    assert got["hot"] == 40 and len(got) == 301 and sum(got.values()) == 940
    assert S.training_sample(df, size=100, most=40).count() < 200


def test_annotators_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(f"a{i}", i) for i in range(500)], "annotator_id string, n_judgments long")
    got = V._numbered(df, Workspace(spark, "t")).collect()
    assert sorted(r["a"] for r in got) == list(range(500)) and all(r["annotator_id"] == f"a{r['n_judgments']}" for r in got)


def test_both_ways_stop_by_the_same_rule(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i * 9 + k, f"u{i}", f"a{k}", "1" if rng.random() < (0.9 if i % 2 else 0.15) else "0") for i in range(80) for k in range(9)]
    df = spark.createDataFrame(rows, "judgment_id long, uid string, annotator_id string, label string").withColumn("judged_at", F.expr("timestamp_ntz '2024-01-01'"))
    one = V.pass_messages(V.standing_judgments(df), spark, Workspace(spark, "t"))
    monkeypatch.setattr(V, "SENT_ANNOTATORS", 0)
    two = V.pass_messages(V.standing_judgments(df), spark, Workspace(spark, "t"))
    a, b = ({r["uid"]: r["total"] for r in x[0].collect()} for x in (one, two))
    assert all(x == pytest.approx(y, abs=1e-5) for u in a for x, y in zip(a[u], b[u]))
    monkeypatch.setattr(V, "MOST_ROUNDS", 1)
    with pytest.warns(UserWarning, match="after 1 rounds"):
        V.pass_messages(V.standing_judgments(df), spark, Workspace(spark, "t"))


def test_forest_spans_its_components_with_and_without_hubs(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(i, (i * 7) % 60) for i in range(1, 60)]
    df = spark.createDataFrame([(min(e), max(e)) for e in set(edges) if e[0] != e[1]], "a long, b long").distinct()
    for hub in (R.HUB, 4):
        monkeypatch.setattr(R, "HUB", hub)
        labels, forest = R.spanning_forest(df, Workspace(spark, "t"))
        got = forest.collect()
        assert len(got) == 91 - 2 and labels.select("root").distinct().count() == 2
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for r in got:
            assert find(r["a"]) != find(r["b"])
            parent[find(r["a"])] = find(r["b"])


def test_every_merge_and_token_of_the_vocabulary():
    machine, _ = T.automaton()
    whole, machine._whole = machine._whole, {}
    try:
        for label, raw in machine.label_bytes.items():
            text = raw.decode("utf-8", "ignore")
            if text.encode() == raw and len(machine.split.findall(text)) == 1:
                assert machine.encode_word(raw) == [label], raw
    finally:
        machine._whole = whole


def test_arcs_are_bounded_and_ids_decode(spark, monkeypatch):
    monkeypatch.setattr(T, "ARCS_KEPT", 50)
    machine = T.Automaton()
    raw = " unquestionably antidisestablishmentarianistically".encode()
    assert machine.decode(machine.encode_word(raw)) == raw and len(machine._arcs) <= 50
    df = spark.createDataFrame([(1, "Grüße 今日\n"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["text"] for r in T.decode_documents(T.encode_documents(df)).collect()] == ["Grüße 今日\n", "", ""]


def _bins(rows, out):
    by = collections.defaultdict(list)
    for i, part, _, n, b, _ in out:
        by[b].append((rows[i], part, n))
    return by


def test_strict_conflicts_and_little_room_left():
    rng = random.Random(8)
    rows = [(i, min(1900, int(rng.expovariate(1 / 400)) + 20), f"s{min(int(rng.expovariate(0.25)), 30)}", None) for i in range(3000)]
    by = _bins(rows, B.pack(rows, 2048))
    need = math.ceil(sum(r[1] for r in rows) / 2048)
    count = collections.Counter(r[2] for r in rows)
    assert max(count.values()) > need  # is divided into two parts
    for x in by.values():
        for source, n in collections.Counter(r[2] for r, _, _ in x).items():
            assert n <= math.ceil(count[source] / need)
    rows = [(i, n, f"s{i % 60 if i % 4 else 0}", c) for i, n, _, c in rows]
    by = _bins(rows, B.pack(rows, 2048))
    assert all(max(collections.Counter(r[2] for r, _, _ in x).values()) == 1 for x in by.values()) or max(collections.Counter(r[2] for r in rows).values()) > need
    assert len(by) <= 1.03 * need


def test_crowded_copies_take_one_container_each_as_far_as_there_are_any():
    rows = [(i, 500, None, 7) for i in range(4)] + [(10 + i, 1500, None, None) for i in range(4)]
    by = _bins(rows, B.pack(rows, 2048))
    assert len(by) == 4 and all(sum(r[3] == 7 for r, _, _ in x) == 1 for x in by.values())


def test_rows_that_repeat_a_key_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 100)
    df = spark.createDataFrame([(1, f"word {i}", "a") for i in range(500)] + [(None, "x", "b")] * 3 + [(i, "y", None) for i in range(2, 100)], "doc_id long, text string, source string")
    got = B.fill_containers(df, spark, capacity=64).collect()
    assert len(got) == 601 and len({r["container"] >> 32 for r in got if r["doc_id"] == 1}) > 3
    audit = B.audit(df.filter("doc_id > 1"), B.fill_containers(df.filter("doc_id > 1"), spark, capacity=64), capacity=64).first()
    assert tuple(audit) == (98, 0, 0, 0, 0)


def test_kept_form_is_readable_and_folds_to_the_same():
    texts = ["Привет, как дела? Он и я.", "Mоscow is оn", "Καλημέρα σας, ο κόσμος από", "Мoсква", "The cop", None, "", "так", "no letters 12"]
    kept = C.readable_array(pa.array(texts))
    assert kept.to_pylist() == ["Привет, как дела? Он и я.", "Moscow is on", "Καλημέρα σας, ο κόσμος από", "Москва", "The cop", None, "", "так", "no letters 12"]
    assert C.fold_array(kept).to_pylist() == C.fold_array(pa.array(texts)).to_pylist() and C.readable_array(kept) == kept


def test_look_alikes_by_the_library(spark):
    alike = C.look_alikes(spark)
    assert len(alike) > 180
    for odd, plain in zip("ρναυᎪօՏ", "pvauAoS"):
        assert alike[odd] == plain
    scripts = collections.Counter((k, C.unicodedata.name(c).split()[0]) for c, k in alike.items() if c.isalpha() and c not in C.LOOK_ALIKE)
    assert max(scripts.values()) == 1 and "σ" not in alike


def test_look_alike_classes(spark):
    df = spark.createDataFrame([(1, "one ﬁsh"), (2, "one fish"), (3, "one fish"), (4, "One fish"), (5, None), (6, "  "), (7, "ОNE")], "doc_id long, text string")
    got = sorted(map(tuple, C.look_alike_classes(df, Workspace(spark, "t")).collect()))
    assert got == [(1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 4, 0), (7, 7, 0)]
    assert C.look_alike_classes(df.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("jvm", ["none", "no library", "few"])
def test_look_alikes_without_the_library_are_an_error(jvm):
    from types import SimpleNamespace as N

    class Missing:
        def __getattr__(self, name):  # what py4j gives for a class that is not there
            return Missing() if name != "SpoofChecker" else N(Builder="a package")

    few = N(com=N(ibm=N(icu=N(text=N(SpoofChecker=N(Builder=lambda: N(build=lambda: N(getSkeleton=lambda s: s[:9]))))))))
    session = {"none": N(), "no library": N(_jvm=Missing()), "few": N(_jvm=few)}[jvm]
    with pytest.raises(RuntimeError, match="ICU"):
        C.look_alikes(session)
