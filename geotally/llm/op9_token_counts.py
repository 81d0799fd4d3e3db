"""Operator 9: token counts by a compiled finite-state transducer.

A vocabulary of byte-pair merges with word ends is compiled, state by state as texts need them, into a deterministic
transducer. A state is what the rest of a word can depend on: the longest suffix read that still begins some token, and
for each place in it where a token may begin, the last token before it and the count up to there. Reading a symbol finds
the one token that may end there (op1's rule of neighbours) and emits the change of the token count; a word's last symbol
leads back to the start.

Texts are cut into chunks of CHUNK code points, wherever that is. A chunk's state map takes the state before it to the state after it
and a count. It has two parts: up to the first word end it depends on the state before (the head), from there on the state is the
start whatever came before, so the rest (the tail) is a constant. All tails run side by side, one symbol a step. Maps are then
composed: each head is evaluated at the state that the chunk before it is known or, inside a word longer than a chunk, supposed to end in,
all side by side, and again only where that state turned out otherwise. States forget: two runs over the same bytes soon meet, so
a word of any number of chunks takes a few rounds in practice (at worst one a chunk, which texts would have to be made for). When nothing changes any more, every map was evaluated at
the very state that the one before it gives. A prefix scan over the composed counts gives each text's. Transitions live in a hash table of arrays that grows with a long word and is emptied afterwards.

Classes of characters are the library's own (see characters.py).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from geotally.llm.bpe import PairCoder
from geotally.llm.characters import Normalizer, of_tokenizers, strange
from geotally.llm.common import id_text, read

#: Code points to a chunk and to a run over chunks; the hash table's size as a power of two; transitions by single bytes that are kept.
CHUNK, RUN, BITS, BYTES = 256, 1_000_000, 22, 600_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
GAP, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_coder(path: str) -> tuple[PairCoder, list[str]]:
    """The coder of a tokenizers .json file of the word-end kind, and the strings that stand for one token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, symbol = spec["model"], byte_symbols()
    end = model["end_of_word_suffix"]

    def own(token: str) -> str:
        last = token.endswith(end)
        raw = [symbol[c] for c in (token[: -len(end)] if last else token)]
        return "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * last)

    tokens = [""] * len(model["vocab"])
    for token, i in model["vocab"].items():
        tokens[i] = own(token)
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    coder = PairCoder.from_merges(tokens, 512, [(own(a), own(b)) for a, b in pairs])
    if any(max(s) >= i for i, s in enumerate(coder.split) if i >= 512):
        raise ValueError("tokens must stand in the order of their merges")
    return coder, [t["content"] for t in spec["added_tokens"]]


class Transducer:
    """Compiled as it is used; start state 0."""

    def __init__(self, coder: PairCoder, kinds: np.ndarray):
        """kinds: GAP, LETTER, NUMBER or OTHER of every code point."""
        self.coder, self.kinds = coder, kinds
        self.begins = {t[:i] for t in coder.ids for i in range(1, len(t) + 1)} | {""}
        self.reset()

    def reset(self) -> None:
        start = ("", ((-1, 0),))
        self.states, self.number, self.by_byte = [start], {start: 0}, {}
        self.bits, self.filled = BITS, 0
        self.keys = np.full(1 << BITS, -1, np.int64)
        self.to, self.emits = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int8)

    def grow(self) -> None:
        """Twice the table."""
        held = np.flatnonzero(self.keys >= 0)
        keys, to, emits = self.keys[held], self.to[held], self.emits[held]
        self.bits += 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to, self.emits = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int8)
        at, left = self.home(keys), np.arange(keys.size)
        while left.size:
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.to[at[won]], self.emits[at[won]] = to[won], emits[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MULTIPLIER) >> np.uint64(64 - self.bits)).view(np.int64)

    def read_byte(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the change of the token count. symbol: a byte, plus 256 if it ends a word."""
        known = self.by_byte.get((state, symbol))
        if known is not None:
            return known
        suffix, places = self.states[state]
        suffix, ids, fits = suffix + chr(symbol), self.coder.ids, self.coder.fits
        for j, place in enumerate(places):
            if place is not None and (t := ids.get(suffix[j:])) is not None and (place[0] < 0 or fits(place[0], t)):
                token, change = t, place[1] + 1
                break
        if symbol >= 256:
            found = 0, change
        else:
            cut = next(j for j in range(len(suffix) + 1) if suffix[j:] in self.begins)
            kept = [(p[0], p[1] - change) if p is not None and suffix[j:] in self.begins else None for j, p in enumerate(places)][cut:]
            new = (suffix[cut:], (*kept, (token, 0)))
            if new not in self.number:
                self.number[new] = len(self.states)
                self.states.append(new)
            found = self.number[new], change
        if len(self.by_byte) >= BYTES:
            self.by_byte.clear()
        self.by_byte[state, symbol] = found
        return found

    def _compile(self, key: int) -> tuple[int, int]:
        state, change, symbol = key >> 22, 0, key & 0x3FFFFF
        if symbol == 0:
            return 0, 0
        raw = chr((symbol >> 1) - 1).encode()
        for i, b in enumerate(raw):
            state, d = self.read_byte(state, b + 256 * (symbol & 1 and i == len(raw) - 1))
            change += d
        return state, change

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Places of the transitions in the table; missing ones are compiled. The table is never more than half full."""
        at = self.places(keys)
        missing = np.unique(keys[at < 0])
        if missing.size:
            while self.filled + missing.size > 1 << (self.bits - 1):
                self.grow()
            mask = (1 << self.bits) - 1
            for key, place in zip(missing.tolist(), self.home(missing).tolist(), strict=True):
                while self.keys[place] >= 0:
                    place = (place + 1) & mask
                self.to[place], self.emits[place] = self._compile(key)
                self.keys[place] = key
            self.filled += missing.size
            at = self.places(keys)
        return at

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, -1 if it isn't."""
        at = self.home(keys)
        off = np.flatnonzero(self.keys[at] != keys)
        while off.size:
            none = self.keys[at[off]] < 0
            at[off[none]] = -1
            off = off[~none]
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            off = off[self.keys[at[off]] != keys[off]]
        return at

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each normalised text."""
        if self.filled > 1 << (BITS - 2):
            self.reset()
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))  # each text and its gap
        kind = self.kinds[points]
        n = points.size
        last = np.empty(n, bool)  # of a word
        last[:-1] = (kind[:-1] != kind[1:]) | (kind[:-1] == NUMBER)
        last[-1] = True
        quote = np.flatnonzero(points[:-1] == 39)
        quote = quote[(quote == 0) | (kind[quote - 1] != OTHER)]
        if quote.size:  # 's 't 'm 'd 're 've 'll are words, cut off from letters that follow
            one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
            short = np.isin(one, [115, 116, 109, 100])
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            last[quote[short | long]] = False
            last[quote[short] + 1] = True
            last[quote[long] + 2] = True
        gap = kind == GAP
        symbol = np.where(gap, 0, points.astype(np.int64) * 2 + 2 + last)
        free = np.concatenate(([0], np.flatnonzero(last | gap) + 1))  # where the start state holds, whatever came before
        bounds = np.unique(np.concatenate((np.arange(0, n, CHUNK), [0], ends)))
        begin, end = bounds[:-1], bounds[1:]
        where = np.searchsorted(free, begin)
        tail = np.minimum(free[np.minimum(where, free.size - 1)], end)
        constant = (where < free.size) & (free[np.minimum(where, free.size - 1)] <= end)
        after, count = self.run(symbol, tail, end - tail, np.zeros(begin.size, np.int64))
        heads = np.flatnonzero(tail > begin)
        given, emitted = np.full(heads.size, -1, np.int64), np.zeros(heads.size, np.int64)
        while True:  # a head's state before it is what the map before gives
            now = np.flatnonzero(given != after[heads - 1])
            if not now.size:
                break
            at = heads[now]
            given[now] = after[at - 1]
            state, emitted[now] = self.run(symbol, begin[at], tail[at] - begin[at], given[now])
            within = ~constant[at]  # no word ended in the chunk
            after[at[within]] = state[within]
        count[heads] += emitted
        scan = np.concatenate(([0], np.cumsum(count)))
        return np.diff(scan[np.searchsorted(bounds, ends)], prepend=0)

    def run(self, symbol: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after some ranges of symbols and the changes of the count, all ranges side by side."""
        order = np.argsort(-length, kind="stable")
        begin, length, state = begin[order], length[order], state[order].astype(np.int64)
        emitted = np.zeros(begin.size, np.int64)
        live = np.searchsorted(-length, -np.arange(length[0] if length.size else 0), side="left")
        for step, m in enumerate(live):  # ranges of this length or more come first
            at = self.look_up((state[:m] << 22) | symbol[begin[:m] + step])
            state[:m] = self.to[at]
            emitted[:m] += self.emits[at]
        back = np.empty_like(order)
        back[order] = np.arange(order.size)
        return state[back], emitted[back]


def kinds_of(letters: str, numbers: str, gaps: str) -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for members, kind in ((letters, LETTER), (numbers, NUMBER), (gaps, GAP)):
        kinds[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    return kinds


class Compiled:
    """What workers get: the coder, the library's classes and normalizer, special strings; each makes its own transducer."""

    def __init__(self, path: str):
        self.coder, self.special = word_coder(path)
        self.classes = [of_tokenizers(c) for c in (r"\p{L}", r"\p{N}", r"\s")]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bare = {"version": spec["version"], "truncation": None, "padding": None, "added_tokens": [], "normalizer": spec["normalizer"], "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.normalised = Normalizer(strange(), json.dumps(bare))
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    @property
    def machine(self) -> Transducer:
        if self._machine is None:
            self._machine = Transducer(self.coder, kinds_of(*self.classes))
        return self._machine


#: Where a word surely ends: between a letter or digit and white space or a sign other than '. No sign here joins what is before it.
WORD_END = re.compile(r"(?<=[^\W_])(?=[\s!-&(-/:-@\[-^`{-~\u3000-\u3029\uff01-\uff06\uff08-\uff0f])")


def pieces(text: str, most: int = RUN) -> Iterator[str]:
    """A long text in parts of about most code points, cut at word ends; a longer word stays whole."""
    at = 0
    while len(text) - at > most:
        found = WORD_END.search(text, at + most)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def token_counts(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens) of every whole text.

    vocabulary: path of a .json file of the word-end kind on the driver. Null and empty texts: 0 bytes, 0 tokens.
    Strings of the file's special tokens count as one token wherever they stand. Texts over RUN code points are counted in parts
    cut at word ends; a word of millions of letters is one part, in memory of about 100 bytes a letter. Repeated rows each give theirs. An empty table gives none.
    """
    compiled = Compiled(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(compiled)  # the vocabulary: fixed size
    marks = re.compile("|".join(map(re.escape, compiled.special)) or r"(?!)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, normalised = shared.value.machine, shared.value.normalised
        for batch in batches:
            n_tokens = np.zeros(batch.num_rows, np.int64)
            held, owner, size = [], [], 0
            for row, value in enumerate(batch.column(1)):
                text = value.as_py()
                parts = marks.split(text) if "<|" in text else [text]
                n_tokens[row] += len(parts) - 1
                for part in parts:
                    for piece in pieces(part):
                        held.append(normalised(piece))
                        owner.append(row)
                        size += len(piece)
                        if size >= RUN:
                            np.add.at(n_tokens, owner, machine.counts(held))
                            held, owner, size = [], [], 0
            if held:
                np.add.at(n_tokens, owner, machine.counts(held))
            n_bytes = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
