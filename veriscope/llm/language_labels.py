"""p6: language of each claim and of each segment of a mixed one, by word-first backoff.

A word the model knows is scored for each language by its log frequency there. For an unknown word the model falls back
to character n-grams, from long to short, and takes the longest length at which it knows any. A word that most often
stands capitalised and only in few evidence groups is a name and says nothing, nor does an unknown capitalised Latin
word; scores are bounded, so no single word decides. The best sequence of languages over the words of a claim, with a
price for each change (a lower one at a sentence end), gives its segments.

The model is trained on a bounded sample of the distinct labelled claims. As labels err, it is trained twice, the second time
without the claims whose label the first model contradicts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.sampling import share_of, within

#: Bound of the training sample: distinct labelled claims, drawn by their hash.
SAMPLE = 12_000
#: Price of a change of language inside a sentence and at its end.
CHANGE, CHANGE_AT_END = 9.0, 4.0
#: Lead over the claim's other language that a segment must have to stand.
LEAD = 6.0
#: Bounds of the evidence of one word: known, unknown in Latin script, unknown in another script.
KNOWN_MOST, LATIN_MOST, OTHER_MOST = 4.0, 1.0, 8.0
GRAMS = (4, 3, 2, 1)
#: Labels that name no language.
NO_LABEL = ("", "-", "--", "?", "??", "n/a", "na", "none", "null", "unknown", "und", "undetermined", "xx", "zxx", "mul")
WORD = regex.compile(r"\p{Latin}[\p{Latin}\p{M}]*(?:['’]\p{Latin}[\p{Latin}\p{M}]*)*|[\p{Han}\p{Hiragana}\p{Katakana}ー々]+|\p{Thai}+|[\p{L}\p{M}]+")
SENTENCE_END = regex.compile(r"[.!?。！？।؟…;]|\s[-–—|]\s|\n")


def stated_code(lang: Column, languages: list[tuple[str, str, str]]) -> Column:
    """Code of the language that a label names (by code, three-letter code or name, any case and region), else null."""
    names: dict[str, str] = {}
    for code, code3, name in sorted(languages, key=lambda x: x[0] == "no", reverse=True):
        for k in (code, code3, name):
            if k:
                names[k.lower()] = "nb" if code == "no" else code
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    said = F.lower(F.trim(lang))
    return F.coalesce(F.element_at(table, said), F.element_at(table, F.regexp_extract(said, r"^([a-z]{2,3})[-_].*$", 1)))


def language_list(languages: DataFrame) -> list[tuple[str, str, str]]:
    """The languages that occur (a fixed table of under a hundred rows; more are refused)."""
    rows = languages.select("code", "code3", "name").filter("code is not null").limit(1000).collect()
    if len(rows) == 1000:
        raise ValueError("languages has too many rows for a table of languages")
    return sorted((r[0], r[1], r[2]) for r in rows)


SCRIPTS = tuple((name, regex.compile(rf"[{classes}]")) for name, classes in (("kana", r"\p{Hiragana}\p{Katakana}"), ("han", r"\p{Han}"), ("latin", r"\p{Latin}"), ("thai", r"\p{Thai}"), ("arabic", r"\p{Arabic}"), ("greek", r"\p{Greek}"), ("cyrillic", r"\p{Cyrillic}"), ("devanagari", r"\p{Devanagari}")))
#: Least share of a language's known words in a script for the language to be written in it.
SCRIPT_SHARE = 0.2


def script(word: str) -> str:
    return next((name for name, r in SCRIPTS if r.search(word)), "other")


class Model:
    """Scores of words and n-grams as vectors over the languages.

    ``scripts``: by script a vector that is 0 for the languages written in it and negative for others.
    """

    def __init__(self, codes: list[str], words: dict[str, np.ndarray], grams: list[dict[str, np.ndarray]], scripts: dict[str, np.ndarray]):
        self.codes, self.words, self.grams, self.scripts = codes, words, grams, scripts
        self._zero = np.zeros(len(codes), np.float32)
        self._seen: dict[str, np.ndarray] = {}

    def word(self, w: str, shouting: bool) -> np.ndarray:
        key = "!" + w if shouting else w
        v = self._seen.get(key)
        if v is None:
            if len(self._seen) > 300_000:
                self._seen.clear()
            v = self._seen[key] = self._score(w, shouting)
        return v

    def _score(self, w: str, shouting: bool) -> np.ndarray:
        low = w.lower()
        v = self.words.get(low)
        kind = script(w)
        wrong = self.scripts.get(kind, self._zero) if kind != "latin" else self._zero
        if v is not None:
            return v + wrong
        latin = "LATIN" if regex.match(r"\p{Latin}", w) else ""
        if latin and (w[0].isupper() or shouting or len(w) <= 2):
            return self._zero
        s = f" {low} " if latin else low
        for n, table in zip(GRAMS, self.grams):
            hits = [table[s[i : i + n]] for i in range(len(s) - n + 1) if s[i : i + n] in table]
            if hits:
                v = np.mean(hits, axis=0) if latin else np.sum(hits, axis=0)
                most = LATIN_MOST if latin else OTHER_MOST
                return np.maximum(v - v.max(), -most).astype(np.float32) + wrong
        return wrong


def _vectors(counts: dict[str, np.ndarray], totals: np.ndarray, most: float) -> dict[str, np.ndarray]:
    alpha = 0.2
    out = {}
    base = np.log((alpha) / (totals + alpha * max(1, len(counts))))
    floor = base.min()
    for w, c in counts.items():
        v = np.where(c > 0, np.log((c + alpha) / (totals + alpha * len(counts))), floor)
        out[w] = np.maximum(v - v.max(), -most).astype(np.float32)
    return out


def train(rows: list[tuple[str, str, str]], codes: list[str]) -> Model:
    """Model from ``(claim, code, group)`` of labelled claims."""
    number = {c: i for i, c in enumerate(codes)}
    seen_words = [(claim, [(m[0], m[0].lower()) for m in WORD.finditer(claim)], number[code], group) for claim, code, group in rows if code in number]
    model = None
    for _ in range(2):
        use = seen_words
        if model is not None:
            use = [r for r in seen_words if _agrees(model, r[0], r[2])]
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(codes), np.float32))
        big, groups, n = Counter(), defaultdict(set), Counter()
        per_lang = np.zeros(len(codes))
        other = [defaultdict(lambda: np.zeros(len(codes), np.float32)) for _ in GRAMS]
        for claim, words, k, group in use:
            shouting = claim.isupper()
            for w, low in words:
                n[low] += 1
                counts[low][k] += 1
                if w[0].isupper() and not shouting:
                    big[low] += 1
                if len(groups[low]) < 6:
                    groups[low].add(group)
                if not regex.match(r"\p{Latin}", low):
                    for g, table in zip(GRAMS, other):
                        for i in range(len(low) - g + 1):
                            table[low[i : i + g]][k] += 1
        # known: seen at least twice, and not a name (capitalised, in few groups)
        known = {w: c for w, c in counts.items() if n[w] > 1 and (len(groups[w]) >= 5 or big[w] * 2 < n[w]) and len(groups[w]) >= 2}
        for c in known.values():
            per_lang += c
        words = _vectors(known, per_lang + 1, KNOWN_MOST)
        for w, c in known.items():
            if regex.match(r"\p{Latin}", w):
                s = f" {w} "
                for g, table in zip(GRAMS, other):
                    if g > 1:
                        for i in range(len(s) - g + 1):
                            table[s[i : i + g]] += np.minimum(c, 20)
        in_script: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(codes)))
        for w, c in known.items():
            in_script[script(w)] += c
        totals = sum(in_script.values(), np.zeros(len(codes)))
        scripts = {}
        for name, c in in_script.items():
            fits = c >= SCRIPT_SHARE * totals
            fits &= c > 0
            if fits.any():
                scripts[name] = np.where(fits, 0.0, -OTHER_MOST).astype(np.float32)
        if "han" in scripts and "kana" in scripts:  # what is written with kana is written with Han signs too
            scripts["han"] = np.maximum(scripts["han"], scripts["kana"])
        grams = []
        for g, table in zip(GRAMS, other):
            kept = {x: c for x, c in table.items() if c.sum() > 1}
            # shares and not frequencies: a rare script's few n-grams would otherwise look frequent in it
            share = {x: c + 0.02 * c.sum() for x, c in kept.items()}
            grams.append({x: np.log(c / c.sum()).astype(np.float32) for x, c in share.items()})
        model = Model(codes, words, grams, scripts)
    return model


def _agrees(model: Model, claim: str, k: int) -> bool:
    m, _, _ = _matrix(model, claim)
    if not len(m):
        return False
    s = m.sum(0)
    return s[k] >= s.max() - 1.0


def _matrix(model: Model, claim: str) -> tuple[np.ndarray, list[int], list[int]]:
    shouting = claim.isupper()
    found = list(WORD.finditer(claim))
    if not found:
        return np.zeros((0, len(model.codes)), np.float32), [], []
    return np.array([model.word(m[0], shouting) for m in found]), [m.start() for m in found], [m.end() for m in found]


def segments(model: Model, claim: str) -> list[tuple[int, int, int, float]]:
    """``(language, start, end, confidence)`` of the segments of a claim, in code points; none without evidence."""
    m, starts, ends = _matrix(model, claim)
    if not len(m):
        return []
    total = m.sum(0)
    best = int(total.argmax())
    if total.max() == total.min():
        return []
    whole = [(best, 0, len(claim), _confidence(total, best))]
    # no path with a change can beat one language if its gain is below the price
    if m.max(1).sum() - total[best] <= CHANGE_AT_END:
        return whole
    n, k = m.shape
    price = np.full(n, CHANGE, np.float32)
    for i in range(1, n):
        if SENTENCE_END.search(claim, ends[i - 1], starts[i]):
            price[i] = CHANGE_AT_END
    score, back = m[0].copy(), np.zeros((n, k), np.int32)
    for i in range(1, n):
        top = int(score.argmax())
        change = score[top] - price[i]
        stay = score >= change
        back[i] = np.where(stay, np.arange(k), top)
        score = np.where(stay, score, change) + m[i]
    path = np.empty(n, np.int64)
    path[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), n]
    parts = [(int(path[a]), a, b) for a, b in zip(cuts, cuts[1:])]
    main = max(parts, key=lambda p: m[p[1] : p[2], p[0]].sum() - m[p[1] : p[2]].min(1).sum())[0]
    strong: list[tuple[int, int, int]] = []
    for lang, a, b in parts:
        own = m[a:b].sum(0)
        others = {p[0] for p in parts if p[0] != lang}
        lead = min((own[lang] - own[o] for o in others), default=0.0)
        if lang != main and lead < LEAD:
            lang = main
        if strong and strong[-1][0] == lang:
            strong[-1] = (lang, strong[-1][1], b)
        else:
            strong.append((lang, a, b))
    if len({s[0] for s in strong}) == 1:
        return whole if strong[0][0] == best else [(strong[0][0], 0, len(claim), _confidence(total, strong[0][0]))]
    out = []
    for j, (lang, a, b) in enumerate(strong):
        begin = 0 if j == 0 else _seam(claim, ends[a - 1], starts[a])
        stop = len(claim) if j == len(strong) - 1 else _seam(claim, ends[b - 1], starts[b])
        out.append((lang, begin, stop, _confidence(m[a:b].sum(0), lang)))
    return out


def _seam(claim: str, end: int, start: int) -> int:
    """Where a segment begins between two words: behind the sentence mark, else at the next word."""
    m = SENTENCE_END.search(claim, end, start)
    at = m.end() if m else start
    while at < start and claim[at].isspace():
        at += 1
    return at


def _confidence(scores: np.ndarray, k: int) -> float:
    e = np.exp((scores - scores.max()) / 2)
    return float(e[k] / e.sum())


def training_sample(df: DataFrame, languages: list[tuple[str, str, str]], text: str = "claim", lang: str = "lang", group: str = "group_id", size: int = SAMPLE) -> DataFrame:
    """``t, c, g``: about ``size`` distinct labelled texts with the label that most of their rows have.

    Texts are drawn by their hash before anything is gathered, and copies are one text, so a text with most of the rows
    neither fills the sample nor reaches the driver more than once. ``g`` is the smallest group of the text.
    """
    rows = df.select(F.col(text).alias("t"), stated_code(F.col(lang), languages).alias("c"), F.coalesce(F.col(group), F.lit("")).alias("g")).filter("c is not null and length(t) > 0")
    drawn = rows.filter(within(F.col("t"), share_of(rows, F.xxhash64("t"), size)))
    said = drawn.groupBy("t", "c").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("g"))
    return said.groupBy("t").agg(F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("c"), F.min("g").alias("g"))


def train_on(df: DataFrame, languages: list[tuple[str, str, str]], text: str = "claim", lang: str = "lang", group: str = "group_id") -> Model:
    codes = sorted({"nb" if c == "no" else c for c, _, _ in languages})
    rows = sorted(map(tuple, training_sample(df, languages, text, lang, group).collect()), key=lambda r: (xxhash.xxh64_intdigest(r[0].encode("utf-8", "surrogatepass")), r[0]))
    return train(rows[:SAMPLE], codes)


_SEGMENTS = "k {kind}, stated string, named boolean, segments array<struct<lang:string,char_start:int,char_end:int,confidence:double>>"


def language_segments(df: DataFrame, model: Model, languages: list[tuple[str, str, str]], key: str = "row_id", text: str = "claim", lang: str = "lang") -> DataFrame:
    """``<key>, stated, named, segments``: the label's code (null: none), whether the label names anything, and the segments.

    One pass, no shuffle. A null, empty or wordless text has no segments.
    """
    kind = df.schema[key].dataType.simpleString()
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = []
            for t in b.column("t").to_pylist():
                out.append([{"lang": m.codes[k], "char_start": s, "char_end": e, "confidence": c} for k, s, e, c in segments(m, t)] if t else [])
            kinds = pa.list_(pa.struct([("lang", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("stated"), b.column("named"), pa.array(out, kinds)], ["k", "stated", "named", "segments"])

    named = ~F.coalesce(F.lower(F.trim(F.col(lang))).isin(*NO_LABEL), F.lit(True))
    rows = df.select(F.col(key).alias("k"), stated_code(F.col(lang), languages).alias("stated"), named.alias("named"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, _SEGMENTS.format(kind=kind)).withColumnRenamed("k", key)


def mislabelled(gold: DataFrame, languages: DataFrame) -> DataFrame:
    """``row_id, lang``: the languages of each claim whose label is missing or another, or that holds more than one."""
    known = language_list(languages)
    out = language_segments(gold, train_on(gold, known), known)
    langs = F.array_distinct(F.col("segments.lang"))
    cases = out.select("row_id", "stated", langs.alias("langs")).filter("size(langs) > 1 or (size(langs) = 1 and not (stated <=> langs[0]))")
    return cases.select("row_id", F.explode("langs").alias("lang"))
