"""Pre-splitting for byte-level BPE, and the ids of whole batches of texts, both vectorised.

The pattern is the public one of byte-level BPE: contractions, then runs of letters, numbers or other
signs with one space before them, then white space. Runs are found from a table of code point classes;
texts that hold an apostrophe go through the `regex` module instead, so contractions are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import regex

from .common import spans

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_PRIME = 0x9E3779B97F4A7C15 | 1


@cache
def _classes() -> np.ndarray:
    """The class of each code point. Surrogates are OTHER; UTF-8 has none."""
    points = "".join(map(chr, (x for x in range(0x110000) if not 0xD800 <= x < 0xE000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, points):
            a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    return out


@cache
def _compiled():
    return regex.compile(PATTERN)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse mod 2**64, `n` of each at least."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        room, out = 1 << max(16, int(n).bit_length()), []
        for base in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            x = np.full(room, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[:] = [tuple(out)]
    return _POWERS[0]


def hashes(cp: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words that differ may share one."""
    power, inverse = powers(len(cp))
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp + np.uint64(0x9E37)) * power[: len(cp)], out=total[1:])
    return mixed((total[starts + length] - total[starts]) * inverse[starts] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_signs(a: np.ndarray, a_at: np.ndarray, a_length: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """Whether the words of two arrays of code points are equal, pair by pair."""
    out = a_length == b_length
    some = np.flatnonzero(out)
    n = a_length[some]
    ends = np.cumsum(n)
    index, first = np.arange(int(ends[-1]) if len(ends) else 0), ends - n
    wrong = np.flatnonzero(a[index + np.repeat(a_at[some] - first, n)] != b[index + np.repeat(b_at[some] - first, n)])
    out[some[np.searchsorted(ends, wrong, side="right")]] = False
    return out


def pieces_of(text: str, step: int) -> Iterator[str]:
    """`text` in pieces of about `step` code points, cut before a space that follows another sign: a word ends there anyway."""
    at = 0
    while len(text) - at > step:
        to = text.find(" ", at + step)
        while to > 0 and text[to - 1].isspace():
            to = text.find(" ", to + 1)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def starts_of_words(text: str, doc_starts: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """Positions in `text`, several documents back to back, where a pre-split word starts."""
    kind = _classes()[cp]
    n = len(cp)
    edge = np.zeros(n + 1, bool)
    edge[doc_starts[doc_starts < n]] = True  # documents start words
    first = edge.copy()
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[1:n] |= first[1:n]
    edge[0] = edge[n] = True
    space = kind == SPACE
    # the last white space before a sign of the same document
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    edge[last] = True
    blank = last[cp[last] == 32]
    edge[blank + 1] = False
    out = np.flatnonzero(edge)
    return out[:-1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class BatchEncoder:
    """Ids of batches of texts. `encode_words` gives the ids of new words; a table of bounded size keeps them.

    The table has 2**bits slots and two places for each word; a word that finds both taken replaces what is there.
    A 64-bit hash says where to look; words are the same only if their code points are. `encode_words` returns
    the ids of all words back to back and how many each has. Texts are taken in steps of about `step` code points.
    """

    POOL = 1 << 22  # ids, or code points, that the table may hold before it starts anew
    LONG = 256  # longer words are not kept

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int] | None = None, bits: int = 20, step: int = 1 << 18):
        self.encode_words, self.special, self.bits = encode_words, special or {}, bits
        self.step = step if not any(" " in s for s in self.special) else 1 << 62
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.reset()

    def reset(self) -> None:
        n = 1 << self.bits
        self.key = np.zeros(n, np.uint64)
        self.spelt, self.length = np.zeros(n, np.int32), np.full(n, -1, np.int32)  # the word in `signs`
        self.at, self.size = np.zeros(n, np.int32), np.zeros(n, np.int32)  # its ids in `ids`
        self.signs, self.ids = _Pool(np.uint32), _Pool(np.int32)

    def _positions(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The texts back to back, their code points, where words start, and where each text starts."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        doc_starts = np.concatenate(([0], np.cumsum(lengths)))
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = starts_of_words(joined, doc_starts, cp) if len(cp) else np.zeros(0, np.int64)
        odd = [k for k, t in enumerate(texts) if "'" in t or self.splitter is not None and self.splitter.search(t)] if "'" in joined or self.splitter is not None and self.splitter.search(joined) else []
        if odd:
            bounds = np.searchsorted(starts, doc_starts)
            parts, before = [], 0
            for k in odd:
                parts += [starts[before : bounds[k]], doc_starts[k] + np.fromiter(self._slow(texts[k]), np.int64)]
                before = bounds[k + 1]
            starts = np.concatenate([*parts, starts[before:]])
        return joined, cp, starts, doc_starts

    def _slow(self, text: str):
        at = 0
        pattern = _compiled()
        cuts = [(m.start(), m.end()) for m in self.splitter.finditer(text)] if self.splitter is not None else []
        for a, b in [*cuts, (len(text), None)]:
            for m in pattern.finditer(text[at:a]):
                yield at + m.start()
            if b is not None:
                yield a
                at = b

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of each word stand in the pool, how many there are)."""
        special = [self.special.get(w, -1) for w in words] if self.special else []
        if any(t >= 0 for t in special):
            marked = np.array(special)
            plain = np.flatnonzero(marked < 0)
            ids, few = self.encode_words([words[k] for k in plain])
            size = np.ones(len(words), np.int64)
            size[plain] = few
            of = np.repeat(marked, size)
            of[of < 0] = ids
            ids = of
        else:
            ids, size = self.encode_words(words)
        return self.ids.put(ids) + np.cumsum(size) - size, size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts back to back, number of ids of each text)."""
        pieces, owner = [], []
        for k, text in enumerate(texts):
            for piece in pieces_of(text, self.step):
                pieces.append(piece)
                owner.append(k)
        ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(pieces), np.int64)
        for a, b in spans(np.fromiter(map(len, pieces), np.int64, len(pieces)), self.step):
            some, sizes[a:b] = self._step(pieces[a:b])
            ids.append(some)
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, np.array(owner, np.int64), sizes)
        return np.concatenate(ids), total

    def _step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, cp, starts, doc_starts = self._positions(texts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        length = np.diff(np.append(starts, len(cp)))
        key = hashes(cp, starts, length)
        if self.ids.used > self.POOL or self.signs.used > self.POOL:
            self.reset()
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = self._is(cp, starts, length, key, slot)
        other = np.flatnonzero(~hit)
        second = ((key[other] >> np.uint64(8)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        hit[other] = self._is(cp, starts[other], length[other], key[other], second)
        slot[other] = second
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, index, back = np.unique(key[miss], return_index=True, return_inverse=True)
            where = miss[index]  # one word for each key
            alike = same_signs(cp, starts[miss], length[miss], cp, starts[where][back], length[where][back])
            new_at, new_size = self._new([joined[a : a + n] for a, n in zip(starts[where].tolist(), length[where].tolist())])
            at[miss], size[miss] = new_at[back], new_size[back]
            self._keep(cp, starts[where], length[where], key[where], slot[where], new_at, new_size)
            if not alike.all():  # other words with the key of one
                apart = miss[~alike]
                at[apart], size[apart] = self._new([joined[a : a + n] for a, n in zip(starts[apart].tolist(), length[apart].tolist())])
        stops = np.cumsum(size)
        ids = self.ids.body[np.repeat(at - (stops - size), size) + np.arange(int(stops[-1]))]
        before = np.concatenate(([0], stops))[np.searchsorted(starts, doc_starts)]
        return ids, np.diff(before)

    def _is(self, cp, starts, length, key, slot) -> np.ndarray:
        """Whether each slot holds the word."""
        out = (self.key[slot] == key) & (self.length[slot] == length)
        some = np.flatnonzero(out)
        out[some] = same_signs(cp, starts[some], length[some], self.signs.body, self.spelt[slot[some]], length[some])
        return out

    def _keep(self, cp, starts, length, key, second, at, size) -> None:
        short = np.flatnonzero(length <= self.LONG)
        to = (key[short] >> np.uint64(64 - self.bits)).astype(np.int64)
        taken = self.length[to] >= 0
        to[taken] = second[short[taken]]
        self.key[to] = key[short]
        kept = np.flatnonzero(self.key[to] == key[short])  # of words that met in a slot, the one that was written last
        to, short = to[kept], short[kept]
        n = length[short]
        ends = np.cumsum(n)
        signs = cp[np.repeat(starts[short] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.spelt[to], self.length[to] = self.signs.put(signs) + ends - n, n
        self.at[to], self.size[to] = at[short], size[short]


class _Pool:
    """An array that grows."""

    def __init__(self, kind):
        self.body, self.used = np.zeros(1 << 16, kind), 0

    def put(self, values: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(values)
        if self.used > len(self.body):
            grown = np.zeros(max(2 * len(self.body), self.used), self.body.dtype)
            grown[:at] = self.body[:at]
            self.body = grown
        self.body[at : self.used] = values
        return at
