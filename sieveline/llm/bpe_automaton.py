"""BPE by a tokenization automaton (operator 5).

`Automaton` is compiled from the merges in rank order, one gadget for each. Every label leads to one state, so states
are named by the label that was read last; they start with the bytes, each of which may follow each. The gadget
of `u v -> w`: `w` leads where `v` leads (its state gets the row of v's); the arc `v` leaves the state of `u` no
more; and `w` may be read wherever `u` may (it gets u's column). If the arc `v` has already gone from the state of
`u`, no arc ever bears `w`. Labels with equal rows, or equal columns, share them until a gadget tells them apart, so the
whole automaton is one table of bits, some 15 000 rows by 11 000 columns for a vocabulary of 50 000, 20 MB.
`explicit_automaton` builds the same arcs as plain sets for tests.

A pre-split word has one path whose labels spell it. All labels that can be read at each byte come from a trie in flat
arrays; then, byte by byte and for all new words at once, the table tells which of them continues the path,
and paths are read backwards. Decoding emits the labels of the arcs.

Results for edge cases: null and empty texts have no ids (digest of the empty string); rows that repeat
give equal values; special tokens in a text become their id, as the library does by default; columns
besides doc_id and text are ignored, clashing names included.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, spans, table, text_steps
from .words import BatchEncoder


@cache
def byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies use for each byte, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The automaton as flat arrays: `row` and `column` of each label (-1: no arc bears it), `table` of bits by both,
    and the arcs of the labels' trie in an open hash table by (node, byte)."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        """labels: spelling of each id. merges: (u, v, w) by rank. special: strings that are ids of their own."""
        self.labels, self.special = labels, special
        n = max([*labels, *special.values(), 0]) + 1
        self._gadgets(n, merges)
        self.size = np.zeros(n, np.int32)
        self.size[list(labels)] = [len(x) for x in labels.values()]
        self._trie()

    def _gadgets(self, n: int, merges: list[tuple[int, int, int]]) -> None:
        made_from = {w for _, _, w in merges}
        row, column = [-1] * n, [-1] * n
        for t in self.labels:
            if t not in made_from:
                row[t] = column[t] = 0
        in_row, in_column = [sum(x == 0 for x in row)], [sum(x == 0 for x in column)]  # how many labels share it
        table = np.zeros((1024, 128), np.uint8)
        table[0, 0] = 1
        seen = {t for t in self.labels if t not in made_from}
        for rank, (u, v, w) in enumerate(merges, 1):
            if u not in seen or v not in seen or w in seen:
                raise ValueError(f"merge {rank} uses a label before it is made, or makes one twice")
            seen.add(w)
            r, c = row[u], column[v]
            if r < 0 or c < 0 or not table[r, c >> 3] >> (c & 7) & 1:
                continue  # earlier merges never leave this pair: no arc gets the label
            row[w] = row[v]  # w leads where v led
            in_row[row[v]] += 1
            if in_row[r] > 1:  # u shares its row: it gets one of its own
                in_row[r] -= 1
                row[u] = len(in_row)
                in_row.append(1)
                if len(in_row) > len(table):
                    table = np.concatenate((table, np.zeros_like(table)))
                table[row[u]] = table[r]
                r = row[u]
            if in_column[c] > 1:
                in_column[c] -= 1
                column[v] = new = len(in_column)
                in_column.append(1)
                if len(in_column) > 8 * table.shape[1]:
                    table = np.concatenate((table, np.zeros_like(table)), axis=1)
                used = table[: len(in_row)]
                used[:, new >> 3] |= (used[:, c >> 3] >> (c & 7) & 1) << (new & 7)
                c = new
            table[r, c >> 3] &= 255 ^ 1 << (c & 7)  # no arc v leaves u any more
            column[w] = column[u]  # w may follow what u may follow
            in_column[column[u]] += 1
        self.width = (len(in_column) + 7) // 8
        self.table = table[: len(in_row), : self.width].reshape(-1).copy()
        self.row, self.column = np.array(row, np.int64), np.array(column, np.int64)

    def _trie(self) -> None:
        arcs, final = {}, [-1]
        for t, spelling in self.labels.items():
            at = 0
            for b in spelling:
                key = at << 8 | b
                at = arcs.get(key, -1)
                if at < 0:
                    at = arcs[key] = len(final)
                    final.append(-1)
            if self.column[t] >= 0:
                final[at] = t
        self.final = np.array(final, np.int32)
        self.arc_bits = max(4, (4 * len(arcs) + 1).bit_length())
        self.arcs, self.leads = np.full(1 << self.arc_bits, -1, np.int32), np.zeros(1 << self.arc_bits, np.int32)
        key, to = np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int32)
        slot = self._slot(key)
        while len(key):  # one of those that meet in a free slot gets it, the others try the next
            free = np.flatnonzero(self.arcs[slot] < 0)
            self.arcs[slot[free]] = key[free]
            held = self.arcs[slot] == key
            self.leads[slot[held]] = to[held]
            key, to, slot = key[~held], to[~held], (slot[~held] + 1) & len(self.arcs) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - self.arc_bits

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's node after a byte, or -1."""
        key = node << 8 | byte
        slot = self._slot(key)
        held = self.arcs[slot]
        out = np.where(held == key, self.leads[slot], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & len(self.arcs) - 1
            held = self.arcs[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.leads[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether label b may be read after label a (neither is -1)."""
        column = self.column[b]
        return (self.table[self.row[a] * self.width + (column >> 3)] >> (column & 7).astype(np.uint8) & 1).astype(bool)

    def arc(self, a: int, b: int) -> bool:
        return self.row[a] >= 0 and self.column[b] >= 0 and bool(self.follows(np.array([a]), np.array([b]))[0])

    def spelt(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, byte after the last, label) of every label that can be read at `starts` up to `stops`."""
        at, node, out = starts, np.zeros(len(starts), np.int64), []
        depth = 0
        while len(at):
            node = self.step(node, data[at + depth])
            ok = np.flatnonzero(node >= 0)
            at, stops, node = at[ok], stops[ok], node[ok].astype(np.int64)
            depth += 1
            label = self.final[node]
            real = np.flatnonzero(label >= 0)
            out.append((at[real], at[real] + depth, label[real]))
            more = np.flatnonzero(at + depth < stops)
            at, stops, node = at[more], stops[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def encode_bytes(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) of words back to back. All words go in step, a byte at a time."""
        ends = np.cumsum(size)
        first = np.repeat(ends - size, size)
        begin, end, label = self.spelt(data, np.arange(len(data)), np.repeat(ends, size))
        read = end - first[begin]
        order = np.argsort(read, kind="stable")
        begin, end, label = begin[order], end[order], label[order]
        initial = begin == first[begin]
        last = np.full(len(data) + 1, -1, np.int64)  # the label that the path reads up to each byte of a word
        for a, b in pairwise(np.flatnonzero(np.diff(read[order], prepend=-1, append=-1))):
            ok = initial[a:b].copy()
            rest = a + np.flatnonzero(~ok)
            ok[rest - a] = self.follows(last[begin[rest] - 1], label[rest])
            last[end[a:b][ok] - 1] = label[a:b][ok]
        return self._backwards(last, ends, size)

    def _backwards(self, last: np.ndarray, ends: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read the paths from the ends of the words."""
        keep = np.zeros(len(last), bool)
        at, start = ends.copy(), ends - size
        count = np.zeros(len(size), np.int64)
        live = np.flatnonzero(at > start)
        while len(live):
            place = at[live] - 1
            keep[place] = True
            count[live] += 1
            at[live] -= self.size[last[place]]
            live = live[at[live] > start[live]]
        return last[keep].astype(np.int32), count

    def encode_long(self, word: bytes, window: int = 1 << 15) -> list[int]:
        """The ids of one long word: the same path, by windows of bytes, so that memory doesn't follow its length times labels."""
        data, last, n = np.frombuffer(word, np.uint8), [-1] * len(word), len(word)
        for low in range(0, n, window):
            at = np.arange(low, min(n, low + window))
            begin, end, label = self.spelt(data, at, np.full(len(at), n))
            order = np.lexsort((end, begin))
            row, column = self.row, self.column[label[order]].tolist()
            for s, e, t, c in zip(begin[order].tolist(), end[order].tolist(), label[order].tolist(), column):
                if last[e - 1] < 0 and (not s or self.table[row[last[s - 1]] * self.width + (c >> 3)] >> (c & 7) & 1):
                    last[e - 1] = t
        out = []
        while n:
            out.append(last[n - 1])
            n -= int(self.size[out[-1]])
        return out[::-1]

    def encode_word(self, word: bytes) -> list[int]:
        return self.encode_bytes(np.frombuffer(word, np.uint8), np.array([len(word)]))[0].tolist()

    def encode_words(self, words: list[str], most: int = 1 << 16, long: int = 1 << 10) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words back to back, number of ids of each), in steps of about `most` bytes."""
        spelt = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, spelt), np.int64, len(spelt))
        ids, count = [np.zeros(0, np.int32)], np.zeros(len(size), np.int64)
        cuts = [0, *(x for k in np.flatnonzero(size > long).tolist() for x in (k, k + 1)), len(size)]
        for k, (a, b) in enumerate(pairwise(cuts)):
            if k % 2:  # one long word
                ids.append(np.array(self.encode_long(spelt[a]), np.int32))
                count[a] = len(ids[-1])
                continue
            for c, d in spans(size[a:b], most):
                some, count[a + c : a + d] = self.encode_bytes(np.frombuffer(b"".join(spelt[a + c : a + d]), np.uint8), size[a + c : a + d])
                ids.append(some)
        return np.concatenate(ids), count


def explicit_automaton(bytes_used: list[int], merges: list[tuple[int, int, int]]) -> dict[int, set[int]]:
    """What may follow each label, built gadget by gadget on plain sets. For small merge lists."""
    after = {t: set(bytes_used) for t in bytes_used}
    for u, v, w in merges:
        led = set(after[v])
        if v not in after[u]:
            after[w] = set()
            continue
        after[u].discard(v)
        after[w] = led
        for followers in after.values():
            if u in followers:
                followers.add(w)
    return after


@cache
def load(path: str) -> Automaton:
    """The automaton of a byte-level BPE vocabulary file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    signs, vocab = byte_signs(), spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    labels = {t: bytes(signs[c] for c in s) for s, t in vocab.items() if s not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)


@cache
def batch_encoder(path: str) -> BatchEncoder:
    automaton = load(path)
    return BatchEncoder(automaton.encode_words, automaton.special)


def forget() -> None:
    """Drop the automaton and the words it has met: some 100 MB that an idle worker need not hold."""
    batch_encoder.cache_clear()
    load.cache_clear()


def _text(data: bytes) -> str:
    """Invalid UTF-8 becomes U+FFFD."""
    return data.decode("utf-8", "replace")


class Decoder:
    """Emits the labels of ids, for whole batches."""

    def __init__(self, labels: dict[int, bytes]):
        n = max(labels) + 1
        self.size = np.zeros(n, np.int64)
        for t, spelling in labels.items():
            self.size[t] = len(spelling)
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.pool = np.frombuffer(b"".join(labels.get(t, b"") for t in range(n)), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all labels back to back, where the bytes of each id end)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def parts(self, ids: np.ndarray, step: int = 1 << 17) -> Iterator[bytes]:
        """The bytes of all labels, by steps of ids."""
        for a in range(0, len(ids), step):
            yield self.decode(ids[a : a + step])[0].tobytes()


@cache
def decoder(path: str) -> Decoder:
    automaton = load(path)
    return Decoder(automaton.labels | {t: s.encode() for s, t in automaton.special.items()})


def encode(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of each row."""

    def kernel(batch):
        for a, b, texts in text_steps(batch.column(1)):
            ids, n = batch_encoder(tokenizer).encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(arrow_map(kernel, forget), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(ids: DataFrame, tokenizer: str, column: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of each row of ids; invalid UTF-8 becomes U+FFFD."""

    def kernel(batch):
        emit = decoder(tokenizer)
        texts = [_text(b"".join(emit.parts(np.array(row or [], np.int64)))) for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = ids.schema[key].dataType.simpleString()
    return ids.select(ids[key].alias("key"), ids[column].alias("ids")).mapInArrow(arrow_map(kernel), f"key {kind}, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded and decoded again."""

    def kernel(batch):
        encoder, emit = batch_encoder(tokenizer), decoder(tokenizer)
        for a, b, texts in text_steps(batch.column(1)):
            ids, n = encoder.encode(texts)
            of_ids, of_text = [], []
            for stop, count in zip(np.cumsum(n).tolist(), n.tolist()):
                own = ids[stop - count : stop]
                of_ids.append(hashlib.sha256(own.astype("<u4")).hexdigest())
                of_text.append(hashlib.sha256(_text(b"".join(emit.parts(own))).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(arrow_map(kernel), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all of `documents`."""
    return digests(table(spark, sf_dir, "documents"), default_tokenizer())
