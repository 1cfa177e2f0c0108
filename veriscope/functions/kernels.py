"""Algorithms that scan characters in order; plain Python and numpy, without Spark."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")
LOOSE_SENTENCE = re.compile(r"(?<=[.!?])\s+")
BLANK = re.compile(r"\n\s*\n")


def strip_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _growing(pattern: str, text: str, most: int) -> list[int]:
    """Length of the longest common subsequence of a pattern with each beginning of a text, up to ``most`` characters."""
    masks, full = _masks(pattern), (1 << len(pattern)) - 1
    v, out = full, []
    for c in text[:most]:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
        out.append(len(pattern) - v.bit_count())
    return out


def _sliding(pattern: str, text: str) -> np.ndarray:
    """The same for each window of the pattern's length, all windows at a time, in words of 64 bits."""
    m, n = len(pattern), len(text)
    words, count = -(-m // 64), n - m + 1
    letters, code = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    masks = _masks(pattern)
    of = [masks.get(chr(c), 0) for c in letters.tolist()]
    hits = [np.array([(x >> 64 * w) & 0xFFFFFFFFFFFFFFFF for x in of], np.uint64)[code] for w in range(words)]
    v = [np.full(count, 0xFFFFFFFFFFFFFFFF, np.uint64) for _ in range(words)]
    for t in range(m):
        carry = None
        for w in range(words):
            u = v[w] & hits[w][t : t + count]
            x = v[w] + u
            over = x < u
            if carry is not None:
                x += carry
                over |= x < carry
            carry = over.astype(np.uint64) if w + 1 < words else None
            v[w] = x | (v[w] ^ u)
    zeros = np.zeros(count, np.int64)
    for w in range(words):
        bits = min(64, m - 64 * w)
        zeros += np.bitwise_count(~v[w] & np.uint64((1 << bits) - 1)).astype(np.int64)
    return zeros


def partial_ratio(a: str, b: str) -> tuple[float, int, int]:
    """Best similarity (0 to 1) of the shorter text with a window of the longer one, and the window.

    Similarity is twice the common subsequence over the sum of lengths. Windows have the shorter length, or less at
    either end of the longer text; the first best one wins (beginnings, then whole windows, then ends). With both texts
    empty it is 1, with one empty 0.
    """
    if not a or not b:
        return (1.0 if a == b else 0.0), 0, 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    best, s, e = -1.0, 0, 0
    for k, c in enumerate(_growing(short, long, m - 1), 1):
        if 2 * c / (m + k) > best:
            best, s, e = 2 * c / (m + k), 0, k
    middle = _sliding(short, long)
    k = int(middle.argmax())
    if middle[k] / m > best:
        best, s, e = float(middle[k] / m), k, k + m
    ends = _growing(short[::-1], long[::-1], m - 1)
    for k in range(len(ends), 0, -1):
        if 2 * ends[k - 1] / (m + k) > best:
            best, s, e = 2 * ends[k - 1] / (m + k), n - k, n
    return best, *((s, e) if long is b else (0, len(b)))


#: Pairs that are compared together, and under how many each is compared by itself.
TOGETHER, FEW = 256, 4


def partial_ratios(pairs: list[tuple[str, str]]) -> list[tuple[float, int, int]]:
    """``partial_ratio`` of many pairs, with the same results; pairs of like lengths are compared together."""
    out: dict[tuple[str, str], tuple[float, int, int]] = {}
    todo: list[tuple[int, int, int, str, str, tuple[str, str]]] = []
    for p in dict.fromkeys(pairs):
        short, long = p if len(p[0]) <= len(p[1]) else p[::-1]
        if not short or len(short) + len(long) > 40_000:
            out[p] = partial_ratio(*p)
        else:
            todo.append((int(np.log(len(long)) * 8), len(short), len(long), short, long, p))
    todo.sort(key=lambda x: x[:3])
    for at in range(0, len(todo), TOGETHER):
        part = todo[at : at + TOGETHER]
        if len(part) < FEW or max(x[1] for x in part) + max(x[2] for x in part) > 50_000:
            out |= {x[5]: partial_ratio(*x[5]) for x in part}
            continue
        for x, (score, s, e) in zip(part, _combed([x[3] for x in part], [x[4] for x in part])):
            out[x[5]] = (score, *((s, e) if x[4] is x[5][1] else (0, len(x[5][1]))))
    return [out[p] for p in pairs]


def _coded(texts: list[str], fill: int) -> np.ndarray:
    """Code points, a text a column, filled up at the end."""
    out = np.full((len(texts), max(map(len, texts))), fill, np.uint32)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(out.T)


def _combed(shorts: list[str], longs: list[str]) -> list[tuple[float, int, int]]:
    """Score and window of each pair, by one pass over all cells of the pairs' grids that gives the common subsequence
    of the shorter text with every window of the longer one (semi-local comparison by strands: two strands that meet at
    a cell go on bent where the characters are equal or the strands have crossed before, else they cross). A window holds
    its length less the strands that begin and end in it. Steps are diagonals, so all cells of a step are independent.
    """
    a, b = _coded(shorts, 0x110000), _coded(longs, 0x110001)
    (m, count), n = a.shape, len(b)
    seen = np.zeros(0x110002, bool)
    seen[a], seen[b] = True, True
    letters = np.flatnonzero(seen)
    off = 1 << len(letters).bit_length()  # codes stay below the numbers of strands
    kind = np.uint16 if off + m + n < 65535 else np.uint32
    code = np.zeros(len(seen), kind)
    code[letters] = np.arange(len(letters))
    a, b = code[a[::-1]], code[b]
    h = np.repeat(np.arange(off, off + m, dtype=kind)[:, None], count, 1)
    v = np.repeat(np.arange(off + m, off + m + n, dtype=kind)[:, None], count, 1)
    held, one = np.empty((m, count), kind), kind(1)
    for d in range(m + n - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        left, top, x = h[m - 1 - d + lo : m - 1 - d + hi], v[lo:hi], held[: hi - lo]
        np.bitwise_xor(a[m - 1 - d + lo : m - 1 - d + hi], b[lo:hi], out=x)
        np.subtract(x, one, out=x)  # the largest number where characters are equal, else less than any strand
        np.maximum(x, left, out=x)
        np.minimum(x, top, out=x)
        np.add(top, left, out=top)
        np.subtract(top, x, out=top)
        left[...] = x
    ms, ns = np.array(list(map(len, shorts))), np.array(list(map(len, longs)))
    begin, end = v.astype(np.int64) - (off + m), np.arange(n)[:, None]
    e, p = np.nonzero((begin >= 0) & (end < ns))  # strands from top to bottom within the text itself
    s = begin[e, p]
    tally = lambda row, rows, p=p: np.bincount(row * count + p, minlength=rows * count).reshape(rows, count)
    k = np.arange(1, m + 1)[:, None]
    inner = k < ms
    heads = np.where(inner, 2 * (k - np.cumsum(tally(e, n), 0)[:m]) / (ms + k), -1.0)
    tails = np.cumsum(tally(ns[p] - 1 - s, n), 0)[:m]
    tails = np.where(inner, 2 * (k - tails) / (ms + k), -1.0)[::-1]
    at, last = np.arange(n)[:, None], ns - ms
    near = e - s < ms[p]
    e, s, p = e[near], s[near], p[near]
    opened, closed = tally(np.maximum(0, e - ms[p] + 1), n + 1, p), tally(s + 1, n + 1, p)
    whole = np.where(at <= last, (ms - np.cumsum(opened - closed, 0)[:n]) / ms, -1.0)
    out = []
    firsts = [(x.argmax(0), x.max(0)) for x in (heads, whole, tails)]
    for i, (mi, ni) in enumerate(zip(ms.tolist(), ns.tolist())):
        (h0, hv), (w0, wv), (t0, tv) = ((int(x[i]), float(y[i])) for x, y in firsts)
        best, lo, hi = (hv, 0, h0 + 1) if hv > -1 else (-1.0, 0, 0)
        if wv > best:
            best, lo, hi = wv, w0, w0 + mi
        if tv > best:
            best, lo, hi = tv, ni - (m - t0), ni
        out.append((best, lo, hi))
    return out


def longest_common_span(a: str, b: str) -> int:
    """Length of the longest run of characters that both texts hold."""
    if not a or not b:
        return 0
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(x) > len(y):
        x, y = y, x
    run, best = np.zeros(len(y) + 1, np.int32), 0
    for c in x:
        nxt = np.zeros_like(run)
        nxt[1:] = np.where(y == c, run[:-1] + 1, 0)
        best = max(best, int(nxt.max()))
        run = nxt
    return best


def passages(text: str, long: int = 1500, least: int = 40) -> list[tuple[int, int, str]]:
    """Passages with offsets: runs of lines; a long text that is one run is cut into sentences, short ones joined on."""
    if not text:
        return []
    runs: list[list[int]] = []
    at, open_ = 0, False
    lines = text.split("\n")
    for k, line in enumerate(lines):
        end = at + len(line)
        if not line:
            open_ = False
        else:
            # a line of blanks before another line begins a new run
            new = not open_ or (not line.strip() and k < len(lines) - 1)
            if new:
                runs.append([at, end])
            else:
                runs[-1][1] = end
            open_ = True
        at = end + 1
    out = [(s, e, text[s:e]) for s, e in runs if WORD.search(text, s, e)]
    if len(out) != 1 or len(text) <= long:
        return out
    base, stop, body = out[0]
    cuts = [(m.start(), m.end()) for m in SENTENCE.finditer(body)]
    edges = list(zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(body)]))
    parts = [(base + s, base + e, body[s:e].strip()) for s, e in edges if body[s:e].strip()]
    joined: list[tuple[int, int, str]] = []
    for s, e, p in parts:
        if joined and len(joined[-1][2]) < least:
            joined[-1] = (joined[-1][0], e, f"{joined[-1][2]} {p}")
        else:
            joined.append((s, e, p))
    return joined if len(joined) > 1 else out


def word_windows(text: str, base: int, most: int, back: int) -> list[tuple[int, int, str]]:
    """Windows of at most ``most`` characters that end at a blank in their second half where there is one.

    The next window begins a fixed step further, wherever the last one ended.
    """
    step, out, at, n = max(most - back, most // 2), [], 0, len(text)
    while at < n:
        end = at + most
        if end < n:
            blank = text.rfind(" ", at, end)
            end = blank if blank > at + most // 2 else end
        end = min(end, n)
        out.append((base + at, base + end, text[at:end]))
        if end == n:
            break
        at += step
    return out


def loose_sentences(text: str, base: int) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for m in [*LOOSE_SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            out.append((base + at, base + end, text[at:end]))
        at = m.end() if m else end
    return out


def merge_adjacent(chunks: list[tuple[int, int, str]], most: int) -> list[tuple[int, int, str]]:
    """Neighbours joined by a blank as long as their span in the text stays within ``most``."""
    out: list[tuple[int, int, str]] = []
    for s, e, t in chunks:
        if out and e - out[-1][0] <= most:
            out[-1] = (out[-1][0], e, f"{out[-1][2]} {t}")
        else:
            out.append((s, e, t))
    return out


def recursive_chunks(text: str, most: int = 1500, overlap_ratio: float = 0.25, least: int = 20) -> list[tuple[int, int, str]]:
    """Chunks with offsets: paragraphs, oversized ones by sentence, oversized sentences by word window, then merged."""
    if not text:
        return []
    back, raw = int(most * overlap_ratio), []
    edges, at = [], 0
    for m in BLANK.finditer(text):
        edges.append((at, m.start()))
        at = m.end()
    edges.append((at, len(text)))
    for s, e in edges:
        if e <= s:
            continue
        if e - s <= most:
            raw.append((s, e, text[s:e]))
            continue
        for a, b, t in loose_sentences(text[s:e], s):
            raw += [(a, b, t)] if b - a <= most else word_windows(t, a, most, back)
    clean = []
    for s, e, t in raw:
        bare = t.strip()
        if len(bare) >= least:
            clean.append((s + len(t) - len(t.lstrip()), e - (len(t) - len(t.rstrip())), bare))
    return merge_adjacent(clean, most)


def pack_by_sentence(text: str, most: int) -> list[str]:
    """Sentences put together greedily, up to ``most`` characters."""
    out: list[str] = []
    for _, _, s in loose_sentences(text, 0):
        if out and len(out[-1]) + 1 + len(s) <= most:
            out[-1] = f"{out[-1]} {s}"
        else:
            out.append(s)
    return out


CONNECTIVES = re.compile(r"\s*(?:[;,]\s+|\s+)(?:and|but|while|whereas|because|although|und|aber|weil|obwohl|et|mais|car|og|men|fordi)\s+", re.I)


def clauses(text: str, least: int = 40) -> list[str]:
    """Clauses between connectives; one that is short goes to the one before it."""
    out: list[str] = []
    for part in CONNECTIVES.split(text):
        part = part.strip()
        if not part:
            continue
        if out and len(part) < least:
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return out


def pack_budget(items: list[tuple[float, str]], budget: int) -> str:
    """Highest scored texts that fit into a budget of characters, skipping what does not, in their own order."""
    taken, used = [], 0
    for k in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size = len(items[k][1]) + (1 if taken else 0)
        if used + size <= budget:
            taken.append(k)
            used += size
    return " ".join(items[k][1] for k in sorted(taken))


def relocate(text: str, sentence: str, at: int = 0) -> tuple[int, int]:
    """Where a sentence stands in a text, whatever white space is between its words; looked for from ``at``, then anywhere."""
    words = sentence.split()
    if not words:
        return -1, -1
    pattern = re.compile(r"\s+".join(map(re.escape, words)))
    m = pattern.search(text, max(0, at - 1)) or pattern.search(text)
    return m.span() if m else (-1, -1)


@functools.cache
def _one_case() -> dict[int, int]:
    """One character for all that a search without regard to case takes for each other, and perhaps for a few more."""
    top: dict[str, str] = {}

    def find(x: str) -> str:
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for c in map(chr, range(0x20000)):  # no letter beyond has a case
        for x in {c.lower(), c.upper(), *("i" if c == "\u0130" else "")} - {c}:
            a, b = sorted((find(c), find(x)))
            top[b] = a
    first: dict[str, int] = {}
    single = sorted(c for c in top if len(c) == 1)
    for c in single:
        first.setdefault(find(c), ord(c))
    return {ord(c): first[find(c)] for c in single if first[find(c)] != ord(c)}


def one_case(text: str) -> str:
    """A text without case and with single blanks: it holds that of a claim just where ``exact_span`` may find the claim."""
    return " ".join(text.translate(_one_case()).split())


def exact_span(claim: str, source: str) -> tuple[int, int] | None:
    words = claim.split()
    if not words:
        return None
    m = re.search(r"\s+".join(map(re.escape, words)), source, re.I)
    return m.span() if m else None


def location(text: str, start: int, end: int, context: int = 80) -> dict:
    """Line, column, paragraph and page (1-based) of a span, and the text around it on its own and the neighbouring line."""
    head, to_end = text[:start], text[:end]
    first, before = head.rfind("\n"), text.rfind("\n", 0, max(0, head.rfind("\n")))
    left = head[before + 1 if first >= 0 else 0 :].replace("\n", " ").strip()
    stop = text.find("\n", end)
    stop = len(text) if stop < 0 else stop
    far = text.find("\n", stop + 1)
    right = text[end : len(text) if far < 0 else far].replace("\n", " ").strip()
    return {
        "char_start": start, "char_end": end, "line_start": head.count("\n") + 1, "line_end": to_end.count("\n") + 1,
        "column_start": start - first, "column_end": end - to_end.rfind("\n"), "paragraph": 1 + len(BLANK.findall(head)), "page": 1 + head.count("\f"),
        "context_before": left if len(left) <= context else "…" + left[-context:], "context_after": right if len(right) <= context else right[:context] + "…",
    }
