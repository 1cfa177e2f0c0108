"""p4: near-duplicate records by a chosen-path set similarity join.

A claim is the set of its distinct substrings of three characters. From each root a claim goes down a tree: a node
selects a few of the claim's minwise tokens (by a hash of the node, so that all claims in a node select alike, and none
that was selected on the way to it), and for each the claim goes on to the child named by the token. Two claims of similarity J take such a step together with
probability J, so similar ones stay together and others part. A node that is small is not branched on but compared
exhaustively, on sketches of 192 parities. Independent trees are repeated until the recall asked for, and surviving pairs
are measured exactly on the texts.

Which nodes are large is told from a bounded sample of the texts before anything is shuffled: it gives the numbers of
claims in large nodes and, for nodes too small to be met in it, their mean size by depth. So paths depend on the claim
and this plan alone, and what is shuffled is one packed record for each leaf a claim reaches, once. The plan decides how
far paths go and how many trees there are; every claim follows all of its paths. Trees with many records are shuffled in rounds,
so that disk does not grow with their number. A large node of claims too alike to be
parted is divided into blocks, and pairs of blocks are compared in tasks of their own.

Repeats of one text are joined once and expanded at the end, so a group of copies costs one record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.sampling import within
from veriscope.plans.shared import Workspace

THRESHOLD = 0.7
GRAM = 3
#: Minwise tokens of a claim.
TOKENS = 48
#: Share of the pairs just at the threshold that the trees are to bring together.
RECALL = 0.99
#: Children that a node selects below the root, level by level and then in turn.
BRANCHES = (2, 1)
#: Claims in a node up to which it is compared exhaustively; the last level.
LEAF, DEEPEST = 200, 16
#: Distinct texts in the sample that the sizes of nodes are told from, and of how many of them a large node is known.
SAMPLE, SEEN = 20_000, 3
#: A node is branched on if its children need less than this share of its comparisons.
SAVES = 0.8
#: Claims in a block of a node that stays large.
BLOCK_ROWS = 4000
#: Bits of a claim's sketch: the parities of its tokens hashed to so many places.
SKETCH = 192
#: Standard deviations that the sketches of a pair may differ more than at the threshold and still be measured.
SLACK = 2.0
#: Bytes of records aimed at in one group of leaves.
GROUP_BYTES = 12_000_000
#: Rows whose tokens are hashed at a time, and records compared at a time (both fit in a core's cache).
ROWS_AT_ONCE, RECORDS_AT_ONCE = 1000, 20_000
#: Records of a text that are shuffled at a time: further trees follow in rounds, so that disk does not grow with their number.
RECORDS_IN_ROUND = 16
#: Records packed by a task at a time.
RECORDS_PACKED = 2_000_000
#: Pairs held by a task at a time.
PAIRS_AT_ONCE = 1_000_000
#: Leaves up to this size are compared together; rows of larger ones compared at a time.
SMALL, BLOCK = 16, 64
#: One packed record: leaf, representative, sketch, number of tokens.
_REC = np.dtype([("leaf", "<u4"), ("rep", "<i8"), ("s0", "<u8"), ("s1", "<u8"), ("s2", "<u8"), ("n", "<u2")])


def normal_claim(c: Column) -> Column:
    """Lower case, white space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and row offsets."""
    texts = column.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum(lengths)))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) of the distinct grams of all rows, and row offsets; rows have at least one gram."""
    points, rows = _points(column)
    p = points.astype(np.uint64)
    gram = _mix((p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:]) >> np.uint64(32)
    inner = np.ones(len(points), bool)
    for k in range(1, GRAM):
        inner[rows[1:] - k] = False
    lengths = np.diff(rows) - (GRAM - 1)
    keyed = (np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) << np.uint64(32)) | gram[inner[: len(gram)]]
    keyed.sort()
    keyed = keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))]
    starts = np.searchsorted(keyed, np.arange(len(lengths) + 1, dtype=np.uint64) << np.uint64(32))
    return keyed.astype(np.uint32), starts


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minwise tokens (``rows x TOKENS``), sketch (words x rows), and numbers of grams."""
    seeds = _mix(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64)).astype(np.uint32)
    n = len(column)
    out, sketch, size = np.empty((n, TOKENS), np.uint32), np.empty((SKETCH // 64, n), np.uint64), np.empty(n, np.int64)
    for at in range(0, n, ROWS_AT_ONCE):
        gram, starts = _grams(column.slice(at, ROWS_AT_ONCE))
        to, begin = slice(at, at + len(starts) - 1), starts[:-1]
        for t in range(TOKENS):
            x = (gram ^ seeds[2 * t]) * (seeds[2 * t + 1] | np.uint32(1))
            x ^= x >> np.uint32(15)
            out[to, t] = np.minimum.reduceat(x, begin)
        place = (_mix(gram.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) % np.uint64(SKETCH)).astype(np.uint64)
        bit = np.uint64(1) << (place & np.uint64(63))
        for w in range(SKETCH // 64):
            sketch[w, to] = np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == w, bit, np.uint64(0)), begin)
        size[to] = np.diff(starts)
    return out, sketch, size


def _pick(node: np.ndarray, used: np.ndarray, child: int) -> np.ndarray:
    """The token that each node selects for a child, none of those ``used`` (bits): they would keep all claims together."""
    drawn = _mix(node + np.uint64(0x9E3779B97F4A7C15 * (child + 1) % 2**64))
    pick = drawn % np.uint64(TOKENS)
    while len(again := np.flatnonzero((used >> pick) & np.uint64(1))):
        drawn[again] = _mix(drawn[again] + np.uint64(1))
        pick[again] = drawn[again] % np.uint64(TOKENS)
    return pick


class _Nodes:
    """A set of nodes."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.sort(ids)

    def at(self, node: np.ndarray) -> np.ndarray:
        """Place of each node in the set, -1 for others."""
        if not len(self.ids):
            return np.full(len(node), -1)
        at = np.minimum(np.searchsorted(self.ids, node), len(self.ids) - 1)
        return np.where(self.ids[at] == node, at, -1)


class Plan:
    """How far paths go: by depth the nodes that are branched on, those that are not, and whether all others are."""

    def __init__(self, roots: int):
        self.roots = roots
        self.branched: list[_Nodes] = []
        self.stuck: list[_Nodes] = []
        self.open: list[bool] = []
        self.divided, self.parts = _Nodes(np.zeros(0, np.uint64)), np.zeros(0, np.int64)  # large leaves and their blocks
        self.copies = 0  # records of the sample's texts that the division adds

    def goes_on(self, node: np.ndarray, depth: int) -> np.ndarray:
        if depth >= len(self.open):
            return np.zeros(len(node), bool)
        if self.open[depth]:
            return self.stuck[depth].at(node) < 0
        return self.branched[depth].at(node) >= 0


@cache
def _root_ids(roots: int) -> np.ndarray:
    """Roots that select different tokens, as long as there are such."""
    ids: list[int] = []
    taken: set[int] = set()
    k = 0
    while len(ids) < roots:
        k += 1
        node = _mix(np.array([k], np.uint64))
        pick = int(_pick(node, np.zeros(1, np.uint64), 0)[0])
        if pick not in taken:
            ids.append(int(node[0]))
            taken.add(pick)
        if len(taken) == TOKENS:
            taken.clear()
    return np.array(ids, np.uint64)


def _roots(n: int, roots: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = _root_ids(roots.stop)[roots.start :]
    return np.tile(np.arange(n), len(roots)), np.repeat(ids, n), np.zeros(n * len(roots), np.uint64)


def _width(depth: int) -> int:
    return 1 if depth == 0 else BRANCHES[(depth - 1) % len(BRANCHES)]  # a root's further children are further roots


def _step(rows: np.ndarray, node: np.ndarray, used: np.ndarray, tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The children, one level down, and the tokens selected on the way to them."""
    width, taken = _width(depth), used
    nodes, ways = [], []
    for c in range(width):
        pick = _pick(node, taken, c)
        bit = np.uint64(1) << pick
        taken = taken | bit
        nodes.append(_mix(node ^ _mix((tokens[rows, pick.astype(np.int64)].astype(np.uint64) << np.uint64(8)) | pick)))
        ways.append(used | bit)
    return np.tile(rows, width), np.concatenate(nodes), np.concatenate(ways)


def _kept(tokens: np.ndarray, used: int, own: int) -> float:
    """Share of the pairs of these claims that stay together on a token, on average over those not yet used."""
    n, free = len(tokens), [t for t in range(TOKENS) if not used >> t & 1]
    counts = [np.unique(tokens[:, t], return_counts=True)[1].astype(np.float64) for t in free]
    return sum((c * (c - own)).sum() for c in counts) / max(1.0, len(free) * float(n) * (n - own))


def _sized(tokens: np.ndarray, n: int, roots: int) -> tuple[Plan, np.ndarray]:
    """The plan for ``roots`` trees over ``n`` texts from the tokens of a sample, and how many paths end at each depth.

    A large node is branched on while that saves comparisons: where its claims are so alike that most stay together on
    every child, it is left whole. The same goes, by their mean, for the nodes too small to be told from the sample. A
    node so large that it would be divided is left whole only if its claims stay together on most other tokens too, not
    because it happens to select one that many texts have: what is divided is copied once a block, which grows with the table.
    """
    s, plan = len(tokens), Plan(roots)
    scale, own = n / max(1, s), int(s < n)  # of a node's claims in a sample one has been counted for itself
    rows, node, used = _roots(s, range(roots))
    ends = np.zeros(DEEPEST + 1)
    divided: dict[int, int] = {}
    for depth in range(DEEPEST + 1):
        ids, at, count = np.unique(node, return_inverse=True, return_counts=True)
        large = (count * scale > LEAF) & ((count >= SEEN) | (s == n))
        pairs = count.astype(np.float64) * (count - own)
        mean = pairs[~large].sum() / max(1, count[~large].sum()) * scale
        on = np.full(len(node), mean > LEAF) | large[at]
        saves = np.zeros(len(ids), bool)
        opens = False
        if depth < DEEPEST and on.any():
            _, below, _ = _step(rows[on], node[on], used[on], tokens, depth)
            kids, first, each = np.unique(below, return_index=True, return_counts=True)
            parent = np.tile(at[on], len(below) // int(on.sum()))[first]
            after = np.bincount(parent, each.astype(np.float64) * (each - own), len(ids))
            saves = after < SAVES * pairs
            opens = mean > LEAF and after[~large].sum() < SAVES * pairs[~large].sum()
            whole = np.flatnonzero(large & ~saves & (count * scale > BLOCK_ROWS))
            order, start = np.argsort(at, kind="stable"), np.cumsum(count) - count
            for k in whole.tolist():
                own_paths = order[start[k] : start[k] + count[k]]
                saves[k] = _width(depth) * _kept(tokens[rows[own_paths]], int(used[own_paths[0]]), own) < SAVES
        branched = large & saves
        stuck = large & ~saves
        for k, c in zip(ids[stuck].tolist(), count[stuck].tolist()):
            if c * scale > BLOCK_ROWS:
                divided[k] = -(-int(c * scale) // BLOCK_ROWS)
                plan.copies += c * (divided[k] - 1)
        on = (opens & ~stuck[at]) | branched[at]
        plan.branched.append(_Nodes(ids[branched]))
        plan.stuck.append(_Nodes(ids[stuck]))
        plan.open.append(bool(opens))
        ends[depth] += (~on).sum()
        if not on.any():
            break
        rows, node, used = _step(rows[on], node[on], used[on], tokens, depth)
    plan.divided = _Nodes(np.array(list(divided), np.uint64))
    plan.parts = np.array([divided[int(k)] for k in plan.divided.ids], np.int64)
    return plan, ends


def _together(common: int, depth: int) -> float:
    """Probability that two texts with so many of their tokens in common share a node at this depth below one root."""
    q = 1.0
    for d in range(depth - 1, -1, -1):
        q = 1 - (1 - max(0, common - d) / (TOKENS - d) * q) ** _width(d)
    return q


def make_plan(tokens: np.ndarray, n: int, threshold: float, recall: float) -> tuple[Plan, float]:
    """The plan with as many trees as pairs at the threshold need, and the records of a text.

    Of their tokens such pairs have the share ``threshold`` in common on average only; those with fewer are missed more often.
    """
    _, ends = _sized(tokens, n, 1)
    share = ends / max(1.0, ends.sum())
    often = np.array([math.comb(TOKENS, m) * threshold**m * (1 - threshold) ** (TOKENS - m) for m in range(TOKENS + 1)])
    miss = np.array([[1 - _together(m, d) for d in range(len(share))] for m in range(TOKENS + 1)])
    roots = 1
    while often @ miss**roots @ share > 1 - recall and roots < 64:
        roots += 1
    plan, ends = _sized(tokens, n, roots)
    return plan, (ends.sum() + plan.copies) / max(1, len(tokens))


def _leaves(tokens: np.ndarray, rep: np.ndarray, plan: Plan, roots: range) -> tuple[np.ndarray, np.ndarray]:
    """Row and leaf of every path of these trees."""
    all_rows, all_nodes = [], []
    rows, node, used = _roots(len(tokens), roots)
    for depth in range(DEEPEST + 1):
        on = plan.goes_on(node, depth)
        all_rows.append(rows[~on])
        all_nodes.append(node[~on])
        if not on.any():
            break
        rows, node, used = _step(rows[on], node[on], used[on], tokens, depth)
    rows, node = np.concatenate(all_rows), np.concatenate(all_nodes)
    return _blocks(rows, node, rep, plan) if len(plan.parts) else (rows, node)


def _blocks(rows: np.ndarray, node: np.ndarray, rep: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Divides the leaves that are large: a record goes to each pair of blocks that its own block is in."""
    at = plan.divided.at(node)
    k = np.where(at >= 0, plan.parts[np.maximum(at, 0)], 1)
    own = (_mix(rep[rows].astype(np.uint64)) % k.astype(np.uint64)).astype(np.int64)
    again = np.repeat(np.arange(len(rows)), k)
    other = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
    lo, hi = np.minimum(own[again], other), np.maximum(own[again], other)
    cell = _mix(node[again] ^ _mix(((lo << 24) | hi).astype(np.uint64) + np.uint64(1)))
    return rows[again], np.where(k[again] > 1, cell, node[again])


def _pack(rows: np.ndarray, node: np.ndarray, rep: np.ndarray, sketch: np.ndarray, size: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Records of each group of leaves, byte planes apart and compressed."""
    import zstandard

    group = (node % np.uint64(groups)).astype(np.int64)
    leaf = (node >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((leaf, group))
    rec = np.empty(len(rows), _REC)
    own = rows[order]
    rec["leaf"], rec["rep"], rec["n"] = leaf[order], rep[own], np.minimum(size[own], 65535)
    for w in range(SKETCH // 64):
        rec[f"s{w}"] = sketch[w, own]
    ids, at = np.unique(group[order], return_index=True)
    press = zstandard.ZstdCompressor(level=1)
    for g, a, b in zip(ids.tolist(), at.tolist(), [*at[1:].tolist(), len(rec)]):
        plane = np.ascontiguousarray(rec[a:b].view(np.uint8).reshape(-1, _REC.itemsize).T)
        yield g, press.compress(plane.tobytes())


def _unpack(blobs: list[bytes]) -> np.ndarray:
    import zstandard

    d = zstandard.ZstdDecompressor()
    planes = [np.frombuffer(d.decompress(b), np.uint8).reshape(_REC.itemsize, -1) for b in blobs]
    return np.ascontiguousarray(np.concatenate(planes, axis=1).T).view(_REC).ravel()


def _spread(groups: int, plan: Plan, paths: float, roots: range | None = None):
    """Packed records of the leaves of these trees, all by default; ``paths`` is how many a text has."""
    trees = range(plan.roots) if roots is None else roots
    # texts whose records are made together; where large leaves are divided a text has a record for each block
    step = max(1, int(RECORDS_PACKED / max(1.0, paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # batches are gathered, so that a group's records of a task are few blobs
        for rep, text in _gather(batches, 40_000):
            tokens, sketch, size = _tokens(text)
            for at in range(0, len(rep), step):
                part = slice(at, at + step)
                got = list(_pack(*_leaves(tokens[part], rep[part], plan, trees), rep[part], sketch[:, part], size[part], groups))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], ["g", "blob"])

    return run


def _gather(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    held: list[pa.RecordBatch] = []
    for b in chain(batches, [None]):
        if b is not None:
            held.append(b)
        if held and (b is None or sum(x.num_rows for x in held) >= size):
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows:
                yield t["rep"].to_numpy(), t["t"].chunk(0)
            held = []


def _most_apart(threshold: float, slack: float | None) -> np.ndarray:
    """By the sum of two numbers of grams, how many bits of their sketches may differ for the pair to be measured.

    At similarity J the sets differ in (1-J)/(1+J) of the sum of their sizes; these grams, thrown at the places of the
    sketch, leave an odd number in so many of them on average.
    """
    apart = np.arange(2 * 65535 + 1) * (1 - threshold) / (1 + threshold)
    if slack is None:
        return np.full(len(apart), float(SKETCH))
    return SKETCH / 2 * (1 - np.exp(-2 * apart / SKETCH)) + slack * np.sqrt(SKETCH / 4 * (1 - np.exp(-4 * apart / SKETCH)))


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches (words first) differ."""
    off = np.bitwise_count(x[0] ^ y[0])
    for w in range(1, len(x)):
        off += np.bitwise_count(x[w] ^ y[w])
    return off


def _met(rec: np.ndarray, threshold: float, slack: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that share a leaf and whose sketches differ little. ``rec`` is sorted by leaf and size.

    In a leaf of any size each claim is compared with all others whose size allows the similarity. Small leaves are
    taken together, by distance in the sorted records; larger ones block by block.
    """
    if not len(rec):
        return
    bound = _most_apart(threshold, slack)
    leaf, n = np.ascontiguousarray(rec["leaf"]), rec["n"].astype(np.int64)
    sketch = np.stack([np.ascontiguousarray(rec[f"s{w}"]) for w in range(SKETCH // 64)])
    starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(rec)])))

    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for at in range(0, len(small), RECORDS_AT_ONCE):
        own = small[at : at + RECORDS_AT_ONCE]
        for d in range(1, SMALL):
            own = own[own + d < len(rec)]
            own = own[leaf[own + d] == leaf[own]]
            if not len(own):
                break
            far = own + d
            near = _near(sketch[:, own], sketch[:, far]) <= bound[n[own] + n[far]]
            yield own[near], far[near]
    for lo, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        size = n[lo : lo + m]
        for at in range(0, m, BLOCK):
            to = min(m, at + BLOCK)
            reach = int(np.searchsorted(size, size[to - 1] / threshold + 1e-9, "right")) if size[to - 1] < 65535 else m
            off = _near(sketch[:, lo + at : lo + to, None], sketch[:, None, lo + at : lo + reach])
            i, j = np.nonzero(off <= bound[size[to - 1] + size[reach - 1]])
            later = j > i
            i, j = i[later], j[later]
            near = off[i, j] <= bound[size[at + i] + size[at + j]]
            yield lo + at + i[near], lo + at + j[near]


def _compared(rec: np.ndarray, threshold: float, slack: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of representatives, smaller first, some ``PAIRS_AT_ONCE`` at a time and without repeats among these."""
    rep, n = np.ascontiguousarray(rec["rep"]), rec["n"].astype(np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for got in chain(_met(rec, threshold, slack), [None]):
        if got is not None:
            held.append(got)
            count += len(got[0])
        if not held or (got is not None and count < PAIRS_AT_ONCE):
            continue
        a, b = (np.concatenate(x) for x in zip(*held))
        held, count = [], 0
        most = np.maximum(n[a], n[b])
        fits = ((np.minimum(n[a], n[b]) >= threshold * most - 1e-9) | (most == 65535)) & (rep[a] != rep[b])
        a, b = rep[a[fits]], rep[b[fits]]
        pairs = np.stack([np.minimum(a, b), np.maximum(a, b)])
        pairs = pairs[:, np.lexsort(pairs[::-1])]
        keep = np.ones(pairs.shape[1], bool)
        keep[1:] = (np.diff(pairs, axis=1) != 0).any(axis=0)
        yield pairs[0, keep], pairs[1, keep]


def _compare(rec: np.ndarray, threshold: float, slack: float | None = SLACK) -> tuple[np.ndarray, np.ndarray]:
    got = list(_compared(rec, threshold, slack)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*got))


def _leaf_join(threshold: float, slack: float | None):
    """Pairs ``a, b`` of the leaves of the one group in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in b.column("blob").to_pylist()]
        if blobs:
            rec = _unpack(blobs)
            rec = rec[np.argsort((rec["leaf"].astype(np.uint64) << np.uint64(16)) | rec["n"], kind="stable")]
            for a, b in _compared(rec, threshold, slack):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = _tokens(b.column("t"))[0] if b.num_rows else np.zeros((0, TOKENS), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in tokens], pa.binary())], ["tokens"])


def _set(s: str) -> set[str]:
    return {s[i : i + GRAM] for i in range(len(s) - GRAM + 1)}


def _alike(ta: pa.Array, tb: pa.Array, threshold: float) -> np.ndarray:
    """Which pairs of texts are alike; exact.

    Common grams are counted on their hashes by merging the sorted hashes of both sides; where the count is so near to
    what is needed that a few equal hashes of different grams could matter, the grams themselves are compared.
    """
    keyed, sizes = [], []
    for side in (ta, tb):
        gram, starts = _grams(side)
        sizes.append(np.diff(starts))
        keyed.append((np.repeat(np.arange(len(side), dtype=np.uint64), sizes[-1]) << np.uint64(32)) | gram)
    both = np.concatenate(keyed)
    both.sort(kind="stable")  # two sorted runs
    twice = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
    common = np.bincount(twice.astype(np.int64), minlength=len(ta))
    # |A & B| >= t (|A| + |B| - |A & B|)
    need = threshold * (sizes[0] + sizes[1]) / (1 + threshold)
    keep = common >= need
    for i in np.flatnonzero(np.abs(common - need) <= 3).tolist():
        p, q = _set(ta[i].as_py()), _set(tb[i].as_py())
        n = len(p & q)
        keep[i] = n >= threshold * (len(p) + len(q) - n) - 1e-9
    return keep


def _measure(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                mask = pa.array(_alike(b.column("ta"), b.column("tb"), threshold), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    return run


def representatives(df: DataFrame, key: str, text: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """``(members, reps)``: ``row, rep`` of every row with a text of three characters or more; ``rep, t`` of each distinct text."""
    rows = df.select(F.col(key).alias("row"), normal_claim(F.col(text)).alias("t")).filter(F.length("t") >= GRAM)
    rows = rows.withColumn("h", F.unhex(F.md5("t")))
    reps = work.save(rows.groupBy("h").agg(F.min("row").alias("rep"), F.any_value("t").alias("t")), "texts")
    members = rows.select("row", "h").join(reps.select("h", "rep"), "h").select("row", "rep")
    return members, reps.select("rep", "t")


def similar_representatives(reps: DataFrame, work: Workspace, threshold: float = THRESHOLD, recall: float = RECALL, slack: float | None = SLACK) -> DataFrame:
    """``a, b`` (``a < b``) of the distinct texts that are alike to at least ``threshold``.

    Of pairs just at the threshold the trees lose the share ``1 - recall`` and the sketches what lies beyond ``slack``
    standard deviations; more alike pairs are lost far less often. With ``slack=None`` no pair is left out by its
    sketch: all that meet in a leaf are measured.
    """
    n = reps.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    drawn = reps.filter(within(F.col("rep"), share)) if share < 1 else reps
    sample = [r[0] for r in drawn.select("rep", "t").mapInArrow(_token_rows, "tokens binary").collect()]  # SAMPLE times 192 bytes, about
    tokens = np.frombuffer(b"".join(sample), np.uint32).reshape(-1, TOKENS)
    plan, paths = make_plan(tokens, n if share < 1 else len(tokens), threshold, recall)
    rounds = max(1, min(plan.roots, math.ceil(paths / RECORDS_IN_ROUND)))
    parts = []
    for k in range(rounds):
        roots = range(plan.roots * k // rounds, plan.roots * (k + 1) // rounds)
        own = paths * len(roots) / plan.roots
        groups = max(12, math.ceil(n * own * _REC.itemsize / GROUP_BYTES))
        blobs = reps.mapInArrow(_spread(groups, plan, own, roots), "g int, blob binary")
        # a partition for each group of leaves: what a task reads does not grow with the table
        parts.append(work.save(blobs.repartitionById(groups, "g").mapInArrow(_leaf_join(threshold, slack), "a bigint, b bigint"), "leaves"))
    found = reduce(DataFrame.unionByName, parts)
    texts_a, texts_b = reps.select(F.col("rep").alias("a"), F.col("t").alias("ta")), reps.select(F.col("rep").alias("b"), F.col("t").alias("tb"))
    return found.distinct().join(texts_a, "a").join(texts_b, "b").select("a", "b", "ta", "tb").mapInArrow(_measure(threshold), "a bigint, b bigint")


def similar_pairs(df: DataFrame, spark: SparkSession, key: str = "row_id", text: str = "claim", threshold: float = THRESHOLD) -> DataFrame:
    """``<key>_a, <key>_b``: all pairs of rows whose texts are alike, copies included, each pair once, smaller key first.

    Rows with a null text or one under three characters are in no pair.
    """
    work = Workspace(spark, "neardup", release=True)
    members, reps = representatives(df, key, text, work)
    members = work.save(members, "members")
    alike = work.save(similar_representatives(reps, work, threshold), "alike")
    # copies: all pairs in the class of a text that is there more than once
    several = members.groupBy("rep").count().filter("count > 1").select("rep")
    same = members.join(several, "rep", "left_semi")
    x, y = same.alias("x"), same.alias("y")
    copies = x.join(y, F.col("x.rep") == F.col("y.rep")).filter("x.row < y.row").select(F.col("x.row").alias("i"), F.col("y.row").alias("j"))
    ma, mb = members.select(F.col("row").alias("i"), F.col("rep").alias("a")), members.select(F.col("row").alias("j"), F.col("rep").alias("b"))
    across = alike.join(ma, "a").join(mb, "b").select("i", "j")
    both = across.unionByName(copies)
    return both.select(F.least("i", "j").alias(f"{key}_a"), F.greatest("i", "j").alias(f"{key}_b"))


def near_duplicate_classes(df: DataFrame, spark: SparkSession, key: str = "row_id", text: str = "claim", threshold: float = THRESHOLD) -> DataFrame:
    """``<key>, class_id, n_links``: every row with its group of near-duplicates, one row each.

    Groups are the components of the links between distinct texts; ``class_id`` is the smallest key in the group and
    ``n_links`` the number of other rows that the row's text is alike to. A row with a null or too short text is alone.
    """
    from veriscope.llm.related_splits import spanning_forest

    work = Workspace(spark, "neardup", release=True)
    members, reps = representatives(df, key, text, work)
    members = work.save(members, "members")
    alike = work.save(similar_representatives(reps, work, threshold), "alike")
    labels, _ = spanning_forest(alike, work)
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    ends = alike.select("a", "b").union(alike.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.join(size, F.col("b") == F.col("rep")).groupBy("a").agg(F.sum("copies").alias("others"))
    tops = labels.select(F.col("node").alias("rep"), "root")
    lowest = tops.groupBy("root").agg(F.min("rep").alias("class_id"))
    per = size.join(tops, "rep", "left").join(lowest, "root", "left").join(links.withColumnRenamed("a", "rep"), "rep", "left")
    per = per.select("rep", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    grouped = members.join(per, "rep").select(F.col("row").alias(key), "class_id", "n_links")
    alone = df.filter(F.coalesce(F.length(normal_claim(F.col(text))), F.lit(0)) < GRAM).select(key, F.col(key).alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return grouped.unionByName(alone)
