"""Text expressions that stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters as the tokeniser means them: letters, numbers and the underscore, but no combining marks.
WORD = r"[\p{L}\p{N}_]+"
#: White space including the blanks of all scripts.
SPACE = r"[\s\p{Z}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_whitespace(x: Column | str) -> Column:
    """Runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(_c(x), rf"{SPACE}+", " "))


def trim(x: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(x), rf"^{SPACE}+|{SPACE}+$", "")


def fold(x: Column | str) -> Column:
    """Lower case, with both small sigmas as one (engines differ in which one a capital becomes)."""
    return F.translate(F.lower(_c(x)), "ς", "σ")


def tokens(x: Column | str) -> Column:
    """Lower-case word tokens in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(fold(x), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def token_set(x: Column | str) -> Column:
    return F.array_distinct(tokens(x))


def char_ngrams(x: Column | str, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams of ``#token#`` for each lower-case token."""
    marked = F.transform(tokens(x), lambda t: F.concat(F.lit("#"), t, F.lit("#")))

    def grams(t: Column) -> Column:
        per = [F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in range(lo, hi + 1)]
        return F.concat(*per)

    return F.flatten(F.transform(marked, grams))


def _plain_letters() -> tuple[str, str]:
    """Characters that are one other character without their marks, and these; by rule from the character database."""
    pairs = []
    for c in (*range(0xA0, 0x600), *range(0x1D00, 0x2100), *range(0x2160, 0x2190), *range(0xFF00, 0xFFF0)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != chr(c):
            pairs.append((chr(c), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _marks() -> str:
    """Character class of the combining marks, by rule from the character database."""
    found = [c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]+"


_MARKED, _PLAIN = _plain_letters()
_MARKS = _marks()


def strip_accents(x: Column | str) -> Column:
    """Without accents and other combining marks; a character that would become several is left as it is."""
    return F.regexp_replace(F.translate(_c(x), _MARKED, _PLAIN), _MARKS, "")


def bare_ngrams(x: Column | str, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams of the accent-free text."""
    return char_ngrams(strip_accents(x), lo, hi)


def char_windows(x: Column | str, size: int, overlap: int, most: int | None = None) -> Column:
    """Blind windows of ``size`` characters that overlap by ``overlap``; at most ``most`` of them."""
    x, step = _c(x), max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(x) - 1), F.lit(step))
    out = F.transform(starts, lambda i: F.substring(x, i + 1, F.lit(size)))
    out = F.when(F.length(x) > 0, out).otherwise(F.array().cast("array<string>"))
    return F.slice(out, 1, most) if most else out


def phonetic(x: Column | str) -> Column:
    """Skeleton of a word: first letter, then the rest without vowels and doubled letters."""
    x = fold(x)
    rest = F.regexp_replace(F.substring(x, 2, 1_000_000), "[aeiou]", "")
    return F.concat(F.substring(x, 1, 1), F.regexp_replace(rest, r"(.)\1+", "$1"))


def hash_codepoint(c: Column, buckets: int = 8192) -> Column:
    """Bucket of a code point under each of eight multiplicative hashes."""
    primes = (31, 43, 59, 61, 73, 97, 103, 113)  # fixed values
    return F.array(*[F.pmod((c + 1) * p, F.lit(buckets)) for p in primes])


def strip_markdown(line: Column | str) -> Column:
    """A line without its markdown dress; headings and table rows become empty."""
    s = F.regexp_replace(_c(line), rf"^{SPACE}+", "")
    quoted = F.when(s.startswith(">"), trim(F.regexp_replace(s, "^[> ]+", ""))).otherwise(s)
    bare = trim(F.regexp_replace(quoted, rf"^(?:[-*+]|\d+[.)]){SPACE}+", ""))
    return F.when(s.startswith("#") | quoted.startswith("|"), "").otherwise(bare)


def sentences(x: Column | str) -> Column:
    """Parts between a sentence mark with white space and a capital letter or digit."""
    return F.filter(F.split(_c(x), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.length(trim(s)) > 0)


def looks_like_claim(x: Column | str, least: int = 20) -> Column:
    """Long enough and with a copula or a word that ends like a verb."""
    x = _c(x)
    copula = x.rlike(r"(?i)(?:^|[^A-Za-z0-9_])(?:is|are|was|were|has|have|had|will|can|should|must)(?:$|[^A-Za-z0-9_])")
    return (F.length(x) >= least) & (copula | x.rlike(r"[A-Za-z0-9_](?:ed|ing|s)(?:$|[^A-Za-z0-9_])"))


def agnostic_gate(x: Column | str, least_chars: int = 20, least_tokens: int = 4) -> Column:
    return (F.length(_c(x)) >= least_chars) & (F.size(tokens(x)) >= least_tokens)


def content_gate(x: Column | str, least: int = 3) -> Column:
    return F.size(F.filter(tokens(x), lambda t: t.rlike(r"\p{L}"))) >= least


def lang_base(x: Column | str) -> Column:
    """``fr-FR`` to ``fr``."""
    return F.element_at(F.split(F.lower(_c(x)), "-"), 1)


def group_hash(x: Column | str) -> Column:
    return F.substring(F.sha1(_c(x)), 1, 12)


def text_hash(x: Column | str) -> Column:
    return F.substring(F.sha1(_c(x)), 1, 16)


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 below ``lo``, 1 above ``hi``, linear between."""
    return F.lit(0.0) if hi <= lo else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the members of ``a`` that ``b`` has; 0 for an empty ``a``."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
