"""p9: one consistent form for texts that look the same, computed on numpy code-point arrays.

A batch's text buffer is decoded once into code points. Then, for the whole batch at a time:

1. a lookup table gives each code point a target (same code point, nothing, or an expansion),
2. expansions are written at offsets found by a running sum,
3. runs of combining marks are put into canonical order,
4. look-alike letters are folded to one of them, and
5. base letter and mark are composed again by binary search in a pair table.

That is the form in which texts are compared; from it alone follows the form that is kept: a word of letters that
Cyrillic or Greek has too gets them back where its other letters, or else most of the words of its text, are of that
script. So texts that look alike are equal in either form, and Russian stays Russian.

What is folded: canonical equivalents; full-width, half-width, ligature, no-break and presentation forms; blanks of any
width to a plain one; line ends to ``\\n``; invisible characters (zero-width, soft hyphen, direction and variation
marks) to nothing; hyphens that look alike; letters of scripts with capitals (Cyrillic, Greek, Armenian, Cherokee, Coptic and
others) drawn like Latin ones or like each other, by the Unicode confusables data of Spark's ICU library. What is not:
letter case, superscripts, subscripts, fractions, enclosed and mathematical letters, dashes of other lengths, letters of
scripts without capitals, one letter for several (``rn`` for ``m``) and letters for digits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.plans.shared import Workspace

#: Letters and signs drawn alike, against the one they are folded to. They come before those of the library.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "Ӏ": "I", "ο": "o", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ɡ": "g",
    "‐": "-", "‑": "-", "−": "−", "·": "·", "·": "·", ";": ";", "`": "`",
}
#: Characters without a look of their own.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0000, 0xE0FFF),
)
#: Compatibility decompositions that leave the look unchanged.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
LIMIT = 0x110000


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters drawn alike, against the first of them: ASCII where it has one, else the one of the lowest code point.

    Two cased letters count as drawn alike if they have one skeleton in the Unicode confusables data and are both
    capitals or both small. Latin letters beyond ASCII and letters with marks of their own are left as they are, and so
    is a letter whose place another one of its script has taken: no two letters of one script become equal.

    Where the library can't be reached (a session without a JVM of its own, or one without ICU) this raises: with the
    fixed values alone pairs would be missing, and the result would look like any other.
    """
    letters = [c for c in range(0x41, 0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll") and not unicodedata.decomposition(chr(c))]
    letters = [c for c in letters if c < 0x80 or not unicodedata.name(chr(c), "LATIN").startswith("LATIN")]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = checker.getSkeleton("\n".join(map(chr, letters))).split("\n")
    except (AttributeError, TypeError, Py4JError, PySparkException) as e:
        raise RuntimeError("look-alike letters need the ICU library (com.ibm.icu) of the session's own JVM") from e
    if len(skeletons) != len(letters):
        raise RuntimeError(f"the ICU library gave {len(skeletons)} skeletons of {len(letters)} letters")
    script = lambda ch: unicodedata.name(ch, "").split(" ")[0]
    first: dict[tuple[str, str], str] = {}
    out, taken = dict(LOOK_ALIKE), {(kin, script(ch)) for ch, kin in LOOK_ALIKE.items()}
    for c, skeleton in zip(letters, skeletons):
        ch = chr(c)
        kin = first.setdefault((skeleton, unicodedata.category(ch)), ch)
        if ch not in LOOK_ALIKE and (kin, script(ch)) not in taken:
            taken.add((kin, script(ch)))
            if kin != ch:
                out[ch] = kin
    return out


def _target(c: int, alike: dict[str, str] = LOOK_ALIKE) -> str:
    """What one code point becomes before marks are ordered and composed."""
    ch = chr(c)
    if any(a <= c <= b for a, b in INVISIBLE):
        return ""
    if c in (0x0D, 0x85, 0x2028, 0x2029):
        return "\n"
    if c == 0x09 or unicodedata.category(ch) == "Zs":
        return " "
    deco = unicodedata.decomposition(ch)
    if not deco:
        # Hangul syllables compose and decompose by rule and are left composed
        return alike.get(ch, ch)
    tag, parts = (deco.split(" ", 1)[0], deco.split(" ")[1:]) if deco[0] == "<" else ("", deco.split(" "))
    if tag == "<compat>":
        whole = "".join(chr(int(p, 16)) for p in parts)
        if whole[0] == " " or c in (0x017F, 0x00B4) or 0x03D0 <= c <= 0x03F6 or 0x2460 <= c <= 0x249B or 0x3200 <= c <= 0x33FF:
            return ch
    elif tag and tag not in SAME_LOOK:
        return ch
    if ch == "ẞ":
        return ch
    return "".join(_target(int(p, 16), alike) for p in parts)


#: What is known of a letter: that it is one, of Cyrillic or Greek alone, without a twin in Cyrillic, in Greek, in Latin, a capital.
LETTER, CYRILLIC, GREEK, NOT_CYRILLIC, NOT_GREEK, NOT_LATIN, CAPITAL = 1, 2, 4, 8, 16, 32, 64


class _Tables:
    """Lookup tables over all code points, built by rule from the character database; once per worker."""

    def __init__(self, alike: dict[str, str]) -> None:
        self.one = np.arange(LIMIT, dtype=np.uint32)
        self.count = np.ones(LIMIT, np.uint8)
        self.expand_at = np.zeros(LIMIT, np.int32)
        self.ccc = np.zeros(LIMIT, np.uint8)
        extra: list[int] = []
        pairs: dict[tuple[int, int], int] = {}
        for c in range(LIMIT):
            if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF or 0x20000 <= c <= 0x2F7FF or 0x3400 <= c <= 0x9FFF or 0xF0000 <= c or 0x30000 <= c < 0xE0000:
                if 0xE0000 <= c <= 0xE0FFF:
                    self.count[c] = 0
                continue
            ch = chr(c)
            self.ccc[c] = unicodedata.combining(ch)
            to = _target(c, alike)
            self.count[c] = len(to)
            if len(to) == 1:
                self.one[c] = ord(to)
            elif len(to) > 1:
                self.expand_at[c] = len(extra)
                extra += map(ord, to)
            deco = unicodedata.decomposition(ch)
            if deco and deco[0] != "<" and " " in deco and len(unicodedata.normalize("NFC", ch)) == 1:
                a, b = (int(x, 16) for x in deco.split(" "))
                pairs.setdefault((int(ord(alike.get(chr(a), chr(a)))), b), c)
        # a folded base may give a pair two compositions; the Latin one is listed first by code point
        self.count[0xE0000:0xE1000] = 0
        self.extra = np.array(extra, np.uint32)
        keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_to = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        self._scripts()

    def _scripts(self) -> None:
        """``kind`` of each code point, and its twins in Cyrillic and Greek (itself where it has none)."""
        self.kind = np.zeros(LIMIT, np.uint8)
        self.twin = {CYRILLIC: np.arange(LIMIT, dtype=np.uint32), GREEK: np.arange(LIMIT, dtype=np.uint32)}
        for script, lo, hi in ((CYRILLIC, 0x400, 0x460), (GREEK, 0x386, 0x3CF)):
            own = np.arange(hi - 1, lo - 1, -1, dtype=np.uint32)  # of several the lowest is kept
            to, rows = fold(own, np.arange(len(own) + 1), self)
            single = np.diff(rows) == 1
            self.twin[script][to[rows[:-1][single]]] = own[single]
        for c in (*range(0x41, 0x530), *range(0x1E00, 0x2000)):
            name = unicodedata.name(chr(c), "")
            if not unicodedata.category(chr(c)).startswith("L"):
                continue
            cyrillic, greek = self.twin[CYRILLIC][c] != c, self.twin[GREEK][c] != c
            k = LETTER
            if name.startswith("CYRILLIC"):
                k |= CYRILLIC | NOT_GREEK | NOT_LATIN
            elif name.startswith("GREEK"):
                k |= (NOT_LATIN if cyrillic else GREEK | NOT_CYRILLIC | NOT_LATIN)
            else:
                k |= (0 if cyrillic else NOT_CYRILLIC) | (0 if greek else NOT_GREEK)
            self.kind[c] = k | (CAPITAL if unicodedata.category(chr(c)) == "Lu" else 0)


_tables: dict[int, _Tables] = {}


def _get(alike: dict[str, str]) -> _Tables:
    key = hash(tuple(sorted(alike.items())))
    if key not in _tables:
        _tables[key] = _Tables(alike)
    return _tables[key]


def fold(points: np.ndarray, rows: np.ndarray, t: _Tables | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of many rows (``rows``: offsets, one more than rows) in the form of comparison, with new offsets."""
    t = t or _get(LOOK_ALIKE)
    if not len(points):
        return points, rows
    # line ends: of CR LF only LF is kept
    cr = points == 13
    if cr.any():
        drop = np.zeros(len(points), bool)
        drop[:-1] = cr[:-1] & (points[1:] == 10)
        inner = rows[1:-1]
        last = inner[(inner > 0) & (inner < len(points))] - 1
        drop[last] = False
        moved = np.concatenate(([0], np.cumsum(~drop)))
        points, rows = points[~drop], moved[rows]
    counts = t.count[points]
    out, at = _expand(points, counts, t)
    rows = at[rows]
    marks = t.ccc[out]
    where = np.flatnonzero(marks)
    if len(where):
        out, marks = _order(out, marks, where)
        out, rows = _compose(out, marks, rows, t)
    return out, rows


def _expand(points: np.ndarray, counts: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    single = counts == 1
    out = np.empty(at[-1], np.uint32)
    out[at[:-1][single]] = t.one[points[single]]
    many = np.flatnonzero(counts > 1)
    if len(many):
        n = counts[many].astype(np.int64)
        total = np.cumsum(n)
        step = np.arange(total[-1]) - np.repeat(total - n, n)
        out[np.repeat(at[many], n) + step] = t.extra[np.repeat(t.expand_at[points[many]].astype(np.int64), n) + step]
    return out, at


def _order(out: np.ndarray, marks: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable exchange of neighbouring marks until each run is in order of its class."""
    while True:
        i = where[where > 0]
        wrong = i[(marks[i - 1] > marks[i])]
        if not len(wrong):
            return out, marks
        wrong = wrong[np.concatenate(([True], np.diff(wrong) > 1))]
        out[wrong - 1], out[wrong] = out[wrong], out[wrong - 1].copy()
        marks[wrong - 1], marks[wrong] = marks[wrong], marks[wrong - 1].copy()
        where = np.flatnonzero(marks)


def _compose(out: np.ndarray, marks: np.ndarray, rows: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Joins a letter with the marks behind it, the first of each class, as far as one character exists for them."""
    alive = np.ones(len(out), bool)
    first = np.zeros(len(out) + 1, bool)
    first[rows] = True
    # letter in front of each mark: the last position of class 0 up to it
    idx = np.where(marks == 0, np.arange(len(out)), -1)
    base = np.maximum.accumulate(idx)
    starts = np.maximum.accumulate(np.where(first[:-1], np.arange(len(out)), 0))
    m = np.flatnonzero(marks)
    m = m[(base[m] >= starts[m]) & (base[m] >= 0)]
    blocked = np.zeros(len(out), np.int16)  # by base: class of the last mark left uncomposed
    depth = m - base[m]
    for d in np.unique(depth):
        k = m[depth == d]
        b = base[k]
        free = blocked[b] < marks[k]
        k, b = k[free], b[free]
        key = (out[b].astype(np.int64) << 21) | out[k]
        pos = np.searchsorted(t.pair_key, key)
        pos[pos == len(t.pair_key)] = 0
        hit = t.pair_key[pos] == key
        out[b[hit]] = t.pair_to[pos[hit]]
        alive[k[hit]] = False
        blocked[b[~hit]] = marks[k[~hit]]
    moved = np.concatenate(([0], np.cumsum(alive)))
    return out[alive], moved[rows]


def readable(points: np.ndarray, rows: np.ndarray, t: _Tables) -> np.ndarray:
    """The form that is kept, from the form of comparison: letters are exchanged, none is added or lost."""
    kind = t.kind[points]
    letter = kind > 0
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    begins[rows[:-1][rows[:-1] < len(points)]] |= letter[rows[:-1][rows[:-1] < len(points)]]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return points
    word = np.bitwise_or.reduceat(kind, starts)
    row = np.searchsorted(rows, starts, "right") - 1
    cyrillic = (word & CYRILLIC > 0) & (word & NOT_CYRILLIC == 0)
    greek = (word & GREEK > 0) & (word & NOT_GREEK == 0)
    latin = (word & (NOT_CYRILLIC | NOT_GREEK) > 0) & (word & NOT_LATIN == 0)
    # what a text is written in: Latin names stand in texts of any script, so Latin words in capitals do not count
    c, g, ll = (np.bincount(row, x, len(rows) - 1)[row] for x in (cyrillic, greek, latin & (kind[starts] & CAPITAL == 0)))
    either = ~(cyrillic | greek | latin)
    rather = (np.maximum(c, g) > ll) | (word & NOT_LATIN > 0)
    as_g = either & rather & (word & NOT_GREEK == 0) & (g > c)
    as_c = either & rather & (word & NOT_CYRILLIC == 0) & ~as_g
    at = np.cumsum(begins) - 1
    out = points.copy()
    for script, of in ((CYRILLIC, cyrillic | as_c), (GREEK, greek | as_g)):
        own = letter & of[np.maximum(at, 0)]
        out[own] = t.twin[script][points[own]]
    return out


def _decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
    """Code points of all rows, row offsets, and which rows are not null (None: all)."""
    column = column.cast(pa.large_string())
    valid = None
    if column.offset or column.null_count:
        valid = column.is_valid()
        column = pa.concat_arrays([column.fill_null("")])
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return points.copy(), heads[offsets - lo], valid


def _encoded(out: np.ndarray, rows: np.ndarray, valid: pa.Array | None) -> pa.Array:
    """An Arrow string array of the rows; bytes per code point give the offsets."""
    width = 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + (out > 0xFFFF)
    ends = np.zeros(len(out) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    text = out.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    result = pa.LargeStringArray.from_buffers(len(rows) - 1, pa.py_buffer(ends[rows].astype(np.int64).tobytes()), pa.py_buffer(text))
    if valid is not None:
        import pyarrow.compute as pc

        result = pc.if_else(valid, result, pa.scalar(None, pa.large_string()))
    return result.cast(pa.string())


def fold_array(column: pa.Array, alike: dict[str, str] = LOOK_ALIKE) -> pa.Array:
    """The form of comparison of an Arrow string array; nulls stay null."""
    points, rows, valid = _decoded(column)
    return _encoded(*fold(points, rows, _get(alike)), valid)


def readable_array(column: pa.Array, alike: dict[str, str] = LOOK_ALIKE) -> pa.Array:
    """The form that is kept; nulls stay null."""
    points, rows, valid = _decoded(column)
    t = _get(alike)
    out, rows = fold(points, rows, t)
    return _encoded(readable(out, rows, t), rows, valid)


def _mapped(df: DataFrame, key: str, text: str, form, *carried: Column) -> DataFrame:  # noqa: ANN001
    """``k``, the columns carried along and ``form`` of the text; one pass, no shuffle."""
    alike = look_alikes(df.sparkSession)
    names = [f"c{i}" for i in range(len(carried))]
    rows = df.select(F.col(key).alias("k"), *(c.alias(n) for c, n in zip(carried, names)), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], form(part.columns[-1], alike)], ["k", *names, "form"])

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("k", *names))
    return rows.mapInArrow(run, f"{schema}, form string")


def canonical_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, canonical``: the form that is kept, in one pass, no shuffle. Null stays null, empty stays empty."""
    out = _mapped(df, key, text, readable_array, F.col(text))
    return out.select(F.col("k").alias(key), F.col("c0").alias(text), F.col("form").alias("canonical"))


def _looks(df: DataFrame, work: Workspace, key: str, text: str) -> DataFrame:
    """``k, look, raw``: digests of the form of comparison and of the stored text, for rows that show anything.

    Blanks at either end have no look. The stored text is digested before it goes through the kernel and does not come
    back from it.
    """
    shown = F.regexp_replace(F.col("form"), r"^[ \n]+|[ \n]+$", "")
    rows = _mapped(df, key, text, fold_array, F.unhex(F.md5(text))).select("k", F.col("c0").alias("raw"), shown.alias("s"))
    return work.save(rows.filter(F.length("s") > 0).select("k", F.unhex(F.md5("s")).alias("look"), "raw"), "looks")


def look_alike_pairs(df: DataFrame, workspace: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>_a, <key>_b``: rows whose texts differ in their characters but have one consistent form.

    Only digests are shuffled. Classes with a single spelling (exact copies, however many) are left out before the
    join, so a hot class costs one row a spelling until it has a real pair. Texts that show nothing (null, empty, blank)
    form no pairs. Blanks at either end are not compared: they have no look. For a table in which one look may have a
    large share of the rows, ``look_alike_classes`` gives the same without pairs.
    """
    rows = _looks(df, workspace, key, text)
    mixed = rows.join(rows.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("look"), "look", "left_semi")
    a, b = mixed.alias("a"), mixed.alias("b")
    pairs = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.raw") != F.col("b.raw")) & (F.col("a.k") < F.col("b.k")))
    return pairs.select(F.col("a.k").alias(f"{key}_a"), F.col("b.k").alias(f"{key}_b")).distinct()


def look_alike_classes(df: DataFrame, workspace: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, class_id, n_links``: every row that shows anything with the smallest key of its look, one row each.

    ``n_links`` is the number of rows that look the same and are spelt otherwise. Rows are counted by look and spelling
    before anything is joined, so a hot look costs one row a spelling.
    """
    rows = _looks(df, workspace, key, text)
    spelt = rows.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    looks = spelt.groupBy("look").agg(F.sum("n").alias("all"), F.min("k").alias("class_id"))
    known = spelt.drop("k").join(looks, "look").select("look", "raw", "class_id", (F.col("all") - F.col("n")).alias("n_links"))
    return rows.join(known, ["look", "raw"]).select(F.col("k").alias(key), "class_id", "n_links")
