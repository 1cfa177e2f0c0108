"""Numbers and named entities of a text, and where two texts disagree about them."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number format, the units as they are recognised (single letters win over longer units), words that
# are no context, comparatives, and the names looked for by category.
VALUE = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
UNIT = r"%|percent|[kKmMbB]|GB|TB|s|h|px|em|rem|pt|g|lbs|cm|USD|EUR"
CONTEXT = r"[A-Za-z][A-Za-z\-]{2,}"
NUMBER = rf"({VALUE})\s*({UNIT})?(?:\s*({CONTEXT}))?"
NO_CONTEXT = [
    "and", "or", "but", "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "is", "was", "were", "are", "be", "been", "that", "this", "these", "those", "then", "than", "per",
]
YEAR = r"1[5-9]\d{2}|20\d{2}"
COMPARATIVE = (
    r"(?:more than|greater than|over|above|at least|at most|no more than|no fewer than|less than|fewer than|under|below|up to|nearly|"
    r"almost|about|approximately|around|roughly|>=|<=|>|<|≥|≤|~)\s*"
)
NAMES = {
    "nvidia_gpu": ["H100", "A100", "V100", "P100", "K80", "T4", "L4", "L40", "H200", "B100", "A10"],
    "amd_gpu": ["MI250", "MI300", "MI300X", "MI100", "MI210"],
    "apple_soc": ["M1", "M2", "M3", "M4", "M1 Pro", "M2 Pro", "M3 Pro"],
    "llm_model": ["GPT-3", "GPT-3.5", "GPT-4", "GPT-4o", "GPT-5", "Claude", "Claude 2", "Claude 3", "Claude 3.5", "Llama", "Llama 2", "Llama 3", "PaLM", "PaLM 2", "Gemini", "Mistral", "Mixtral"],
    "deep_learning_framework": ["PyTorch", "TensorFlow", "JAX", "MXNet", "Keras"],
    "cloud": ["AWS", "Azure", "GCP", "OCI"],
    "database": ["PostgreSQL", "MySQL", "MongoDB", "Cassandra", "DynamoDB", "SQLite", "Redis"],
}
# Words whose capital says nothing.
PLAIN_CAPITALS = [
    "The", "This", "That", "These", "Those", "A", "An", "And", "Or", "But", "If", "When", "Where", "While", "I", "We", "You", "They", "He", "She", "It", "Our", "Their", "My", "Your", "His", "Her",
]
NUMBER_RUN = r"\d[\d.,   ]*\d|\d"

_NUMBER, _YEAR, _COMPARATIVE = re.compile(NUMBER), re.compile(rf"\b(?:{YEAR})\b"), re.compile(rf"{COMPARATIVE}({VALUE})", re.I)
_NAMES = {c: [(n, re.compile(rf"(?<![A-Za-z0-9]){re.escape(n)}(?![A-Za-z0-9])")) for n in names] for c, names in NAMES.items()}
_CAPITAL = r"[A-Z][a-zA-Z0-9]*(?:-[A-Za-z0-9]+)*"
_PHRASE = re.compile(rf"\b{_CAPITAL}(?:\s+{_CAPITAL}){{0,3}}\b")
_RUN = re.compile(NUMBER_RUN)


#: Texts whose numbers and names are kept, as a passage meets many claims.
KEPT = 1000


def plain_value(raw: str) -> str:
    v = raw.replace(",", "")
    return f"{float(v):g}" if "." in v and not float(v).is_integer() else str(int(float(v))) if "." in v else v


@functools.lru_cache(KEPT)
def numbers(text: str | None) -> list[tuple[str, str, str]]:
    """Value, unit and context word of each number; a bare year has the context ``year``, a bare digit does not count."""
    out = []
    for m in _NUMBER.finditer(text or ""):
        value, unit, word = plain_value(m[1]), (m[2] or "").lower(), (m[3] or "").lower()
        unit, word = "%" if unit == "percent" else unit, "" if word in NO_CONTEXT else word
        if not unit and not word and re.fullmatch(YEAR, value):
            word = "year"
        if unit or word or len(value) > 1:
            out.append((value, unit, word))
    known = {v for v, _, _ in out}
    for m in _YEAR.finditer(text or ""):
        if m[0] not in known:
            known.add(m[0])
            out.append((m[0], "", "year"))
    return out


@functools.lru_cache(KEPT)
def comparatives(text: str) -> set[str]:
    return {plain_value(m[1]) for m in _COMPARATIVE.finditer(text)}


@functools.lru_cache(KEPT)
def names(text: str) -> dict[str, list[str]]:
    found = {c: [n for n, p in ps if n in text and p.search(text)] for c, ps in _NAMES.items()}
    return {c: v for c, v in found.items() if v}


@functools.lru_cache(KEPT)
def phrases(text: str | None) -> list[str]:
    """Capitalised phrases; single words only with a digit, a hyphen or a capital inside."""
    out: dict[str, None] = {}
    for m in _PHRASE.finditer(text or ""):
        p = m[0].strip()
        if len(p.split()) == 1 and (p in PLAIN_CAPITALS or not (re.search(r"[\d-]", p) or any(c.isupper() for c in p[1:]))):
            continue
        out[p] = None
    return list(out)


def entities(claim: str) -> list[str]:
    return list(dict.fromkeys([n for v in names(claim).values() for n in v] + phrases(claim)))


@functools.lru_cache(KEPT)
def _lower(text: str) -> str:
    return text.lower()


def absent(claim: str, source: str) -> list[str]:
    found = entities(claim)
    low = _lower(source) if found else ""
    return [e for e in found if e.lower() not in low]


def _like(there: list[tuple[str, str, str]], unit: str, context: str) -> list[str]:
    """Values with this unit and this context; an empty one is any."""
    return [v for v, u, w in there if unit in ("", u) and context in ("", w)]


def number_conflicts(claim: str, passage: str) -> list[tuple[str, str]]:
    """Pairs of a claim's and a passage's value for the same unit and context.

    A claim's number is held against the passage's numbers of its unit and context, where there are none against those
    of its unit, and then of its context. It must be the only one held against these; bounds (``over 5000``) never
    conflict, nor does a value that is among them.
    """
    mine = numbers(claim)
    there, held = numbers(passage) if mine else [], {}
    for v, u, w in mine:
        for want in dict.fromkeys(((u, w), (u, ""), ("", w))):
            met = _like(there, *want) if any(want) else []
            if met:
                held.setdefault(want, (met, []))[1].append(v)
                break
    alone = [(met, own[0]) for met, own in held.values() if len(own) == 1 and own[0] not in met and own[0] not in comparatives(claim)]
    firm = [(one, [v for v in met if v not in comparatives(passage)]) for met, one in alone]
    return [(one, values[0]) for one, values in firm if values]


def name_conflicts(claim: str, passage: str) -> list[tuple[str, str]]:
    """A claim's only name of a category against the passage's first one, where the passage lacks the claim's."""
    mine = names(claim)
    other = names(passage) if mine else {}
    return [(v[0], other[c][0]) for c, v in mine.items() if len(v) == 1 and c in other and v[0] not in other[c]]


def variants(number: str) -> set[str]:
    base = number.strip(" .,  ")
    return {v for v in (base, base.replace(",", "."), base.replace(".", ","), re.sub("[.,   ]", "", base)) if v}


@functools.lru_cache(KEPT)
def _spellings(text: str) -> frozenset[str]:
    return frozenset().union(*(variants(m[0]) for m in _RUN.finditer(text)))


def number_recall(claim: str, source: str) -> float:
    """Share of the claim's numbers that the source has in some spelling; -1 without numbers."""
    mine = [variants(m[0]) for m in _RUN.finditer(claim)]
    theirs = _spellings(source) if mine and source else frozenset()
    return sum(bool(v & theirs) for v in mine) / len(mine) if mine else -1.0


def anchors(claim: str, source: str, best: str) -> tuple[float, float]:
    """Share of entities and numbers that the whole source has, and whether the best passage disagrees on one."""
    ents, rec = entities(claim), number_recall(claim, source)
    parts = len(ents) + (rec >= 0)
    held = len(ents) - len(absent(claim, source)) + max(rec, 0.0)
    wrong = bool(best) and bool(number_conflicts(claim, best) or name_conflicts(claim, best) or 0 <= number_recall(claim, best) < 1)
    return (held / parts if parts else 0.0), float(wrong)


def conflicts(claim: str, best: str) -> tuple[float, float, float]:
    """Share of conflicts among aligned anchors, whether there is one, and the largest relative difference of numbers."""
    if not best:
        return 0.0, 0.0, 0.0
    nums, low = number_conflicts(claim, best), _lower(best)
    n = len(nums) + len(name_conflicts(claim, best))
    aligned = sum(e.lower() in low for e in entities(claim)) + (number_recall(claim, best) > 0) + n
    far = [abs(float(a) - float(b)) / max(abs(float(a)), abs(float(b))) for a, b in nums if max(abs(float(a)), abs(float(b)))]
    return (n / aligned if aligned else 0.0), float(n > 0), max(far, default=0.0)


# Expressions that stay inside the JVM


def value_column(raw: Column) -> Column:
    """Number without thousands separators and trailing zeros (up to six significant digits, as printed by ``%g``)."""
    v = F.regexp_replace(raw, ",", "")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"(\.\d*?)0+$", "$1"), r"\.$", ""), r"^0+(?=\d)", "")
    return F.when(F.contains(v, F.lit(".")), short).otherwise(v)


def numbers_column(text: Column) -> Column:
    """Array of ``value, unit, context`` of the numbers of a text (without the bare single digits)."""
    cols = [F.regexp_extract_all(text, F.lit(NUMBER), F.lit(i)) for i in (1, 2, 3)]

    def entry(x: Column) -> Column:
        value, unit, word = value_column(x["0"]), F.lower(x["1"]), F.lower(x["2"])
        unit = F.when(unit == "percent", "%").otherwise(unit)
        word = F.when(word.isin(NO_CONTEXT), "").otherwise(word)
        word = F.when((unit == "") & (word == "") & value.rlike(f"^(?:{YEAR})$"), "year").otherwise(word)
        return F.struct(value.alias("value"), unit.alias("unit"), word.alias("context"))

    return F.filter(F.transform(F.arrays_zip(*cols), entry), lambda x: (x["unit"] != "") | (x["context"] != "") | (F.length(x["value"]) > 1))


def number_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER_RUN), F.lit(0))


def variants_column(number: Column) -> Column:
    base = F.regexp_replace(number, "^[ .,  ]+|[ .,  ]+$", "")
    all_ = F.array(base, F.replace(base, F.lit(","), F.lit(".")), F.replace(base, F.lit("."), F.lit(",")), F.regexp_replace(base, "[.,   ]", ""))
    return F.filter(F.array_distinct(all_), lambda v: v != "")


def number_recall_column(claim: Column, source: Column) -> Column:
    """As ``number_recall``."""
    theirs = F.flatten(F.transform(number_runs(source), variants_column))
    mine = number_runs(claim)
    held = F.size(F.filter(mine, lambda n: F.arrays_overlap(variants_column(n), theirs)))
    return F.when(F.size(mine) > 0, held / F.size(mine)).otherwise(-1.0)


def names_column(text: Column) -> Column:
    """Array of ``category, name, position`` of the fixed names in a text."""
    hits = []
    for c, group in NAMES.items():
        for i, n in enumerate(group):
            hits.append(F.when(text.rlike(rf"(?<![A-Za-z0-9]){re.escape(n)}(?![A-Za-z0-9])"), F.struct(F.lit(c).alias("category"), F.lit(n).alias("name"), F.lit(i).alias("position"))))
    return F.array_compact(F.array(*hits))
