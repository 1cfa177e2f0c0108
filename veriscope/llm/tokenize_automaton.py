"""p7: encoding a corpus with a public byte-level BPE by a tokenization automaton.

The merge list is compiled, one merge gadget after another, into a deterministic automaton over token labels that
accepts exactly the tokenizer's own segmentations. For the merge ``(u, v) -> w`` the gadget

* redirects every arc labelled ``u`` to a copy of its target that has lost the arc ``v``, and
* adds an arc ``w`` from every state with an arc ``u`` to the state that ``v`` led to.

All arcs with one label lead to one state, so a state is known by the label read last, and a copy differs from its
original by the arcs removed. The compiled form is therefore a table of removals ``(label, lost label) -> time`` and the
life spans of the labels along the right edge (of the state) and the left edge (of the next label) of their merge
trees; an arc exists unless a removal fell in the common life span of such a pair. Arcs are tabulated on first use.

Every prefix of a word has one accepted segmentation, so a word is encoded left to right by one state per byte
position, and decoded by emitting the labels of the arcs taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Pre-split of the public tokenizer (fixed value).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per worker; beyond that the table is started anew (results are the same, only slower).
WORDS_KEPT = 400_000
#: Arcs kept in the table, likewise.
ARCS_KEPT = 2_000_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    table.update((chr(256 + n), b) for n, b in enumerate(rest))
    return table


class Automaton:
    """Deterministic automaton of a byte-level BPE, compiled from its merges."""

    START = -1

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        alphabet = _byte_alphabet()
        self.split = regex.compile(PRE_SPLIT)
        self.label_bytes: dict[int, bytes] = {}
        self._root: dict = {}
        born = {}  # label -> time of creation; base labels are there from the start
        parts: dict[int, tuple[int, int]] = {}
        lost: dict[tuple[int, int], int] = {}
        for text, label in vocab.items():
            if len(text) == 1 and text in alphabet:
                born[label] = 0
        for k, merge in enumerate(model["merges"], 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in born:  # the gadgets know one way to make a label
                raise ValueError(f"{a + b!r} is made by two merges")
            self._gadget(lost, u, v, w, 2 * k)
            born[w], parts[w] = 2 * k, (u, v)
        self._lost = lost
        # life spans of a label's own state (right edge) and of its arc (left edge)
        self._right = {w: self._edge(w, parts, born, 1) for w in born}
        self._left = {w: self._edge(w, parts, born, 0) for w in born}
        for text, label in vocab.items():
            if label in born:
                raw = bytes(alphabet[c] for c in text)
                self.label_bytes[label] = raw
                node = self._root
                for byte in raw:
                    node = node.setdefault(byte, {})
                node[-1] = label
        self._arcs: dict[int, bool] = {}
        self._whole = {raw: label for label, raw in self.label_bytes.items()}

    @staticmethod
    def _gadget(lost: dict, u: int, v: int, w: int, time: int) -> None:
        lost[u, v] = time
        if u == v:  # runs are merged from the left: u must not come before the merged label
            lost[u, w] = time + 1

    @staticmethod
    def _edge(w: int, parts: dict, born: dict, side: int) -> tuple[tuple[int, int, int], ...]:
        out, until = [], 1 << 60
        while True:
            out.append((w, born[w], until))
            if w not in parts:
                return tuple(out)
            until, w = born[w], parts[w][side]

    def arc(self, state: int, label: int) -> bool:
        """Whether the state reached by one label has an arc with another."""
        key = state * 1_048_576 + label
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= ARCS_KEPT:
                self._arcs.clear()
            known = self._arcs[key] = self._build(state, label)
        return known

    def _build(self, state: int, label: int) -> bool:
        lost = self._lost
        for a, a0, a1 in self._right[state]:
            for b, b0, b1 in self._left[label]:
                t = lost.get((a, b))
                if t is not None and a0 < t < a1 and b0 < t < b1:
                    return False
        return True

    def encode_word(self, raw: bytes) -> list[int]:
        """Labels of the one accepted path over a pre-split word."""
        label = self._whole.get(raw)
        if label is not None:
            return [label]
        n, root, arcs = len(raw), self._root, self._arcs
        state = [self.START] + [-2] * n
        came = [0] * (n + 1)
        for i in range(n):
            s = state[i]
            base = s * 1_048_576
            node = root
            for j in range(i, n):
                node = node.get(raw[j])
                if node is None:
                    break
                label = node.get(-1)
                if label is not None and state[j + 1] == -2:
                    if s == -1:
                        ok = True
                    else:
                        ok = arcs.get(base + label)
                        if ok is None:
                            ok = self.arc(s, label)
                    if ok:
                        state[j + 1], came[j + 1] = label, i
        out, at = [], n
        while at:
            out.append(state[at])
            at = came[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.label_bytes[i] for i in ids)


_compiled: dict[str, tuple[Automaton, dict[str, list[int]]]] = {}


def automaton(path: str = TOKENIZER) -> tuple[Automaton, dict[str, list[int]]]:
    """The compiled automaton and the table of words met so far, once per worker."""
    if path not in _compiled:
        _compiled[path] = (Automaton(path), {})
    return _compiled[path]


class _Words(dict):
    """Words to ids, encoded on first sight."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        ids = self[word] = self.machine.encode_word(word.encode("utf-8", "surrogatepass"))
        return ids


_words: dict[str, _Words] = {}


def _encoder(path: str):
    if path not in _words:
        _words[path] = _Words(automaton(path)[0])
    words = _words[path]
    find = words.machine.split.findall

    def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets and all ids, one after another."""
        parts, lengths = [], np.zeros(len(texts) + 1, np.int32)
        for k, text in enumerate(texts, 1):
            if text:
                ids = np.fromiter(chain.from_iterable(map(words.__getitem__, find(text))), np.int32)
                lengths[k] = len(ids)
                parts.append(ids)
        return np.cumsum(lengths, dtype=np.int32), (np.concatenate(parts) if parts else np.zeros(0, np.int32))

    return encode


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, ids``: the ids of each text; null and empty texts give the empty list. One pass, no shuffle.

    Rows are kept as they are (repeated rows give repeated results, a null key stays null); other columns are dropped
    before any text is sent to a worker.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                offsets, ids = encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["k", "ids"])

    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind.simpleString()}, ids array<int>")
    return out.select(F.col("k").alias(key), "ids")


def decode_documents(encoded: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, text`` from ``key, ids``: the labels of the arcs taken, put one after another. Null ids give null."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = automaton(tokenizer)
        for batch in batches:
            texts = [machine.decode(ids).decode("utf-8", "replace") if ids is not None else None for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (0 for null and empty texts)."""
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)] + ["n_tokens int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                offsets, _ = encode(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(offsets).astype(np.int32))], [*(f"k{i}" for i in range(len(keep))), "n_tokens"])

    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    out = df.select(*cols, F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_tokens")
