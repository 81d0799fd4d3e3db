"""Byte-pair coding by longest matches with backtracking.

Tokens are strings over a small alphabet: byte ``b`` is ``chr(b)`` (Latin-1), and vocabularies
with word ends write the last byte of a word as ``chr(256 + b)``. An Aho-Corasick automaton over
all tokens gives the longest token at every position. The encoder walks left to right: it takes the
longest token that may follow the previous one, falls back to the next shorter prefix token, and
steps back when none fits. Whether two tokens may stand side by side depends on the two alone and
is memoised, every position is left at most once, so the work is linear in the input.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick

#: Pieces longer than this are encoded but not kept in the memo.
LONGEST_KEPT = 48


class PairCoder:
    """Exact byte-pair merges. Build it once, from ranks or from a list of merges."""

    def __init__(self, tokens: list[str], split: list[tuple[int, int]], whole: dict[str, int]):
        """tokens by id; split[id]: the two ids whose merge made it (the id twice: an atom; (-1, -1): never made)."""
        self.tokens, self.split, self.whole = tokens, split, whole
        self.pairs = {(a << 17) | b: i for i, (a, b) in enumerate(split) if a != i and a >= 0}
        self.ids = {t: i for i, t in enumerate(tokens) if split[i][0] >= 0}
        self._automaton = None
        self._fits: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> PairCoder:
        """Ranks as in a .tiktoken file. A token's own two parts are found from the lower ranks."""
        tokens = [""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            tokens[rank] = raw.decode("latin-1")
        coder = cls(tokens, [(-1, -1)] * len(tokens), {t: i for i, t in enumerate(tokens) if t})
        for rank, token in enumerate(tokens):
            if len(token) == 1:
                coder.split[rank] = (rank, rank)
                coder.ids[token] = rank
            for i in range(1, len(token)):
                a, b = coder.ids.get(token[:i], rank), coder.ids.get(token[i:], rank)
                if a < rank and b < rank and coder.fits(a, b):
                    coder.split[rank] = (a, b)
                    coder.pairs[(a << 17) | b] = rank
                    coder.ids[token] = rank
                    break
        coder._fits = {}
        return coder

    @classmethod
    def from_merges(cls, tokens: list[str], atoms: int, merges: list[tuple[str, str]]) -> PairCoder:
        """The first ``atoms`` tokens are symbols; the rest were made by ``merges``, in this order."""
        ids = {t: i for i, t in enumerate(tokens)}
        split = [(i, i) if i < atoms else (-1, -1) for i in range(len(tokens))]
        for a, b in merges:
            if split[ids[a + b]][0] < 0:
                split[ids[a + b]] = (ids[a], ids[b])
        return cls(tokens, split, {})

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for token, i in self.ids.items():
                self._automaton.add_word(token, i)
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return self.tokens, self.split, self.whole

    def __setstate__(self, state):
        self.__init__(*state)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side: none that crosses their border comes first."""
        key = (a << 17) | b
        known = self._fits.get(key)
        if known is not None:
            return known
        limit, pairs, split, fits = 1 << 30, self.pairs, self.split, True
        while True:
            if pairs.get((a << 17) | b, 1 << 30) < limit:
                fits = False
                break
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        break
        if len(self._fits) > 600_000:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1: none."""
        found = self._shorter.get(token)
        if found is None:
            text, found = self.tokens[token], -1
            for end in range(len(text) - 1, 0, -1):
                if (i := self.ids.get(text[:end])) is not None:
                    found = i
                    break
            self._shorter[token] = found
        return found

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece, in the coder's alphabet."""
        if (i := self.whole.get(piece)) is not None:
            return [i]
        iter_long, known = self.automaton.iter_long, self._fits
        found = list(iter_long(piece))  # longest matches throughout: right if all neighbours fit
        out: list[int] = []
        last = -1
        for _, token in found:
            if last >= 0 and not (fit if (fit := known.get((last << 17) | token)) is not None else self.fits(last, token)):
                break
            out.append(token)
            last = token
        else:
            return out
        n, shut, longest, fits, tokens, next_shorter = len(piece), set(), {}, self.fits, self.tokens, self._shorter
        pos = found[len(out) - 1][0] + 1
        while pos < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = pos + len(tokens[token])
                if end not in shut:
                    if last < 0 or (fit := known.get((last << 17) | token)):
                        break
                    if fit is None and fits(last, token):
                        break
                token = next_shorter[token] if token in next_shorter else self.shorter(token)
            if token >= 0:
                out.append(token)
                pos = end
                if pos < n and (token := longest.get(pos, -1)) < 0:
                    token = longest[pos] = next(iter_long(piece, pos))[1]
            else:  # nothing fits here: leave this position for good and shorten the previous token
                shut.add(pos)
                out.pop()
                pos -= len(tokens[last])
                token = last
        return out


class PieceMemo(dict):
    """Piece of text -> its ids as packed little-endian unsigned 32-bit integers; bounded, emptied when full."""

    def __init__(self, coder: PairCoder, most: int = 400_000):
        super().__init__()
        self.coder, self.most = coder, most

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", self.coder.encode(piece.encode().decode("latin-1"))).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
