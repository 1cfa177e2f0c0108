import random

from hypothesis import given, settings
from hypothesis import strategies as st

from veriscope.functions import entities as E
from veriscope.functions import kernels as K


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _brute(a, b):
    if not a or not b:
        return float(a == b)
    s, t = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
    m, n = len(s), len(t)
    windows = [t[:k] for k in range(1, m)] + [t[i : i + m] for i in range(n - m + 1)] + [t[n - k :] for k in range(1, m)]
    return max(2 * _lcs(s, w) / (m + len(w)) for w in windows)


@settings(max_examples=60, deadline=None)
@given(st.text("abc é", max_size=80), st.text("abc é", max_size=100))
def test_partial_ratio_against_brute_force(a, b):
    assert abs(K.partial_ratio(a, b)[0] - _brute(a, b)) < 1e-12


def test_partial_ratio_window_and_long_pattern():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdef ") for _ in range(200))
    text = "z" * 50 + a + "z" * 70
    assert K.partial_ratio(a, text) == (1.0, 50, 250)
    assert K.partial_ratio("", "") == (1.0, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.text("ab. \nC", max_size=400))
def test_passages_and_chunks_keep_their_places(t):
    for s, e, p in K.passages(t):
        assert 0 <= s < e <= len(t) and (p == t[s:e] or len(t) > 1500)
    last = -1
    for s, e, p in K.recursive_chunks(t, 60, 0.25, 5):
        assert s >= last and e <= len(t) and p.strip() == p
        last = s


def test_passage_of_blanks_takes_the_next_line():
    assert K.passages("one\n   \ntwo") == [(0, 3, "one"), (4, 11, "   \ntwo")]
    assert [p for _, _, p in K.passages("one\ntwo\n\nthree")] == ["one\ntwo", "three"]


def test_long_single_passage_falls_back_to_sentences():
    t = "Short one. " + "This is a sentence that is long enough to stand. " * 40
    got = K.passages(t)
    assert len(got) > 30 and got[0][2].startswith("Short one. This")


def test_window_steps_are_fixed():
    got = K.word_windows("word " * 30, 100, 40, 10)
    assert [s for s, _, _ in got][:3] == [100, 130, 160]


def test_numbers_follow_the_format_not_the_word():
    assert E.numbers("330 metres and H100") == [("330", "m", "etres"), ("100", "", "")][:2]
    assert E.numbers("in 1820 and 42 nodes, 1,234.50 percent, 5") == [("1820", "", "year"), ("42", "", "nodes"), ("1234.5", "%", "")]


def test_conflicts():
    assert E.number_conflicts("It has 42 nodes", "The cluster has 12 nodes") == [("42", "12")]
    assert E.number_conflicts("over 42 nodes", "12 nodes") == []
    assert E.number_conflicts("42 nodes and 43 nodes", "12 nodes") == []
    assert E.name_conflicts("runs on H100", "runs on A100 and V100") == [("H100", "A100")]
    assert E.absent("it uses RoPE-Mid on H100", "only H100 here") == ["RoPE-Mid"]
    assert E.number_recall("4,5 and 6", "4.5 only") == 0.5 and E.number_recall("none", "4") == -1


def test_relocate_and_location():
    t = "a\nThe  big\nclaim here.\n\nend"
    s, e = K.relocate(t, "The big claim here.")
    assert t[s:e] == "The  big\nclaim here."
    loc = K.location(t, s, e)
    assert (loc["line_start"], loc["line_end"], loc["column_start"], loc["paragraph"], loc["context_before"]) == (2, 3, 1, 1, "a")
    assert K.relocate(t, "nowhere") == (-1, -1)


def test_budget_skips_what_does_not_fit():
    assert K.pack_budget([(0.9, "aaaa"), (0.8, "b" * 20), (0.7, "cc")], 8) == "aaaa cc"
    assert K.longest_common_span("xxabcdyy", "zabcdz") == 4
