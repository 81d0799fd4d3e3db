"""Byte-pair coding of many texts at once, for vocabularies whose ids follow the order of their merges.

A text falls apart before every space that follows something else than white space: no piece of the split pattern spans such
a place, and what the pattern finds behind it doesn't depend on what comes before. So each distinct word of some texts is
split once, and words met again lately aren't split at all. The pieces of new words are merged together: rows of a
matrix that have the same number of symbols, each by its first pair of lowest rank, go on as rows of one symbol less.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np

from geotally.llm.bpe import LONGEST_KEPT, PairCoder
from geotally.llm.op1_bpe import STEP, Split, TextCoder

#: Characters of texts that are coded together, words known up to which new ones are added to the younger memo, bytes of the longest piece in a matrix.
TOGETHER, MOST, WIDEST = 500_000, 400_000, 64
#: Of the places in the table of merges (over a million, so most pairs are where they are looked for first), and what stands for no merge.
BITS = 20
NONE = 1 << 17


class Merges:
    """A PairCoder's merges as a hash table in an array, and the merging of many pieces."""

    def __init__(self, coder: PairCoder):
        self.coder = coder
        keys, ids = (np.fromiter(x, np.int64, len(coder.pairs)) for x in (coder.pairs.keys(), coder.pairs.values()))
        self.table, at = np.full((1 << BITS) + len(keys), -1, np.int64), self._slots(keys)
        while len(keys):  # each to the first free place from its slot on
            free = self.table[at] < 0
            self.table[at[free]] = keys[free] << 17 | ids[free]
            lost = self.table[at] >> 17 != keys
            keys, ids, at = keys[lost], ids[lost], at[lost] + 1
        self.atoms = np.zeros(256, np.int32)
        self.atoms[[ord(t) for t in coder.tokens[:256]]] = np.arange(256)
        self.first = self.rank(*np.divmod(np.arange(1 << 16, dtype=np.int32), np.int32(256)))

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b make, which is the merge's rank too; NONE: they aren't merged."""
        keys = a.astype(np.int64) << 17 | b
        at = self._slots(keys)
        value = self.table[at]
        hit = value >> 17 == keys
        found = np.where(hit, value & (NONE - 1), NONE).astype(np.int32)
        rest = np.flatnonzero(~hit & (value >= 0))
        while len(rest):  # another pair has this place
            at[rest] += 1
            value = self.table[at[rest]]
            hit = value >> 17 == keys[rest]
            found[rest[hit]] = value[hit] & (NONE - 1)
            rest = rest[~hit & (value >= 0)]
        return found

    def ids(self, flat: bytes, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that follow one another and end there, in a row, and where each piece's end."""
        size = np.diff(end, prepend=0)
        symbols, start = self.atoms[np.frombuffer(flat, np.uint8)], end - size
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(size > WIDEST).tolist():  # a row's work is quadratic; this coder's is linear
            done.append((np.array([i]), np.array([self.coder.encode(flat[start[i] : end[i]].decode("latin-1"))])))
        order = np.argsort(size, kind="stable")
        bounds = np.searchsorted(size[order], np.arange(WIDEST + 2))
        which, rows, ranks = order[:0], np.zeros((0, WIDEST + 2), np.int32), np.zeros((0, WIDEST + 1), np.int32)
        for width in range(WIDEST, 0, -1):  # rows have a mark at both ends, which no merge takes; ranks[:, k] is that of rows[:, k] and the next
            new = order[bounds[width] : bounds[width + 1]]
            rows, ranks = rows[:, : width + 2], ranks[:, : width + 1]
            if len(new):
                fresh, ahead = np.full((len(new), width + 2), NONE - 1, np.int32), np.full((len(new), width + 1), NONE, np.int32)
                fresh[:, 1:-1] = symbols[start[new][:, None] + np.arange(width)]
                ahead[:, 1:-1] = self.first[fresh[:, 1:-2] << 8 | fresh[:, 2:-1]]
                which, rows, ranks = np.concatenate((which, new)), np.concatenate((rows, fresh)), np.concatenate((ranks, ahead))
            if not len(which):
                continue
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(j)), j]
            on = best < NONE
            if not on.all():
                done.append((which[~on], rows[~on, 1:-1]))
                which, rows, ranks, j, best = which[on], rows[on], ranks[on], j[on], best[on]
            n = np.arange(len(j))
            rows[n, j] = best
            keep = np.ones(rows.shape, bool)
            keep[n, j + 1] = False
            rows = rows[keep].reshape(len(j), width + 1)
            keep = np.ones(ranks.shape, bool)
            keep[n, j] = False
            ranks = ranks[keep].reshape(len(j), width)
            ranks[n, j - 1] = self.rank(rows[n, j - 1], best)
            ranks[n, j] = self.rank(best, rows[n, j + 1])
        count = np.zeros(len(end), np.int64)
        for i, found in done:
            count[i] = found.shape[1]
        stop = np.cumsum(count)
        out = np.zeros(count.sum(), "<u4")
        for i, found in done:
            out[(stop[i] - count[i])[:, None] + np.arange(found.shape[1])] = found
        return out, stop


class WordCoder:
    """Ids of many texts. Two memos of words are kept: when the younger is full it takes the older one's place."""

    def __init__(self, coder: PairCoder, split: Split, space: str, special: dict[str, int] | None = None):
        """space: the white space of the split pattern, as the inside of a character set; special: as TextCoder takes it."""
        self.texts, self.merges = TextCoder(coder, split, special), Merges(coder)
        self.loose, self.cut = re.compile(f"[{space}] "), re.compile(f" (?<=[^{space}] )")
        self.marks = re.compile(f"({self.texts.marks.pattern})") if self.texts.marks else None
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # words with a space before them, and first words
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def packed(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, in order. Of longer texts TOGETHER characters and a word are held as words at a time."""
        held, size = [], 0
        for text in texts:
            if len(text) > TOGETHER:
                yield from self._coded(held)
                held, size = [], 0
                yield b"".join([x for part in self._parts(text) for x in self._coded([[part]])])
                continue
            held.append([text] if self.marks is None or not self.marks.search(text) else list(self._parts(text)))
            size += len(text)
            if size > TOGETHER:
                yield from self._coded(held)
                held, size = [], 0
        yield from self._coded(held)

    def _parts(self, text: str) -> Iterator[str | bytes]:
        """Stretches of a text that are coded by themselves, ids of special strings between them."""
        for k, section in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield self.texts.special[section]
                continue
            at = 0
            while len(section) - at > TOGETHER and (m := self.cut.search(section, at + TOGETHER)):
                yield section[at : m.start()]
                at = m.start()
            yield section[at:]

    def _words(self, text: str) -> tuple[str, list[str]]:
        words = self.cut.split(text) if self.loose.search(text) else text.split(" ")
        return words.pop(0), words

    def _coded(self, texts: list[list[str | bytes]]) -> list[bytes]:
        split = [[part if isinstance(part, bytes) else self._words(part) for part in parts] for parts in texts]
        words = [part for parts in split for part in parts if isinstance(part, tuple)]
        long = self._learn(set().union(*(w for _, w in words)), {first for first, _ in words})
        rest, begin = self.known[0].__getitem__, self.known[1].__getitem__
        out = [b"".join(part if isinstance(part, bytes) else b"".join([begin(part[0]), *map(rest, part[1])]) for part in parts) for parts in split]
        for memo, word in long:
            del memo[word]
        return out

    def _learn(self, *seen: set[str]) -> list[tuple[dict[str, bytes], str]]:
        """Adds words to the memos; those too long to stay there."""
        if sum(map(len, self.known)) > MOST:
            self.known, self.older = ({}, {}), self.known
        long = []
        for words, memo, old, before in zip(seen, self.known, self.older, (" ", ""), strict=True):
            new = words.difference(memo)
            again = new & old.keys()
            memo.update((w, old[w]) for w in again)
            new = list(new - again)
            memo.update(zip(new, self._ids([before + w for w in new]), strict=True))
            long += [(memo, w) for w in new if len(w) > LONGEST_KEPT]
        return long

    def _ids(self, words: list[str]) -> list[bytes]:
        pieces: list[str] = []
        ends, whole = [0], {}
        ascii, every = self.texts.ascii.findall, self.texts.pattern.findall
        for i, word in enumerate(words):
            if len(word) > STEP:
                whole[i] = self.texts.packed(word)
            else:
                pieces += ascii(word) if word.isascii() else every(word)
            ends.append(len(pieces))
        flat = "".join(pieces).encode()
        starts = np.flatnonzero(np.frombuffer(flat, np.uint8) & 0xC0 != 0x80)  # of characters
        ids, stop = self.merges.ids(flat, np.append(starts, len(flat))[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        packed, at = ids.tobytes(), np.append(0, 4 * stop)[ends].tolist()
        found = [packed[a:b] for a, b in pairwise(at)]
        for i, value in whole.items():
            found[i] = value
        return found


def word_coder(shared, split: Split, space: str, special: dict[str, int] | None = None) -> WordCoder:
    """The WordCoder of a broadcast PairCoder; a Python worker makes it once and keeps it."""
    coder = shared.value
    if not hasattr(coder, "words"):
        coder.words = WordCoder(coder, split, space, special)
    return coder.words
