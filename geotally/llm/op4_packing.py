"""Operator 4: packing documents into sequences by bin completion.

Documents of one length are interchangeable, so what has to be packed is the histogram of piece lengths: at most
``capacity`` numbers, however large the corpus. The driver solves it. Around the largest length left it enumerates the
fillings of the remaining space that nothing more fits into, each length as often as it goes or less often, and drops dominated ones
(every part of one fits beside the others into a part of another). A choice is a filling and how often it is used, the most
first; after fewer uses than could be, that filling isn't taken again for this length. A search over these choices is cut where the waste so
far, or what is left by the bound of least(), can't beat the best solution known; that incumbent starts as best-fit decreasing.
The search ends with a proof at the bound of least(), or when every choice was tried and no list of fillings was cut short, or without one after NODES
choices. Where there are too many fillings only some are tried. Limits bound the time of the search, never what is
packed. Executors then number the pieces of each length and read sequence and offset off the plan's ranges.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotally.llm.bpe import PairCoder
from geotally.llm.characters import of_tokenizers, ranges
from geotally.llm.common import id_text, read, saved
from geotally.llm.op1_bpe import split_by
from geotally.llm.op9_token_counts import byte_symbols
from geotally.llm.word_coder import word_coder

#: Choices the search makes (its first descent takes about one a length), fillings tried for one space where not all are, steps to find them, all
#: fillings that are compared at most, sizes decided on within one another, and parts of fillings up to which dominance is settled by trying everything.
NODES, FILLINGS, STEPS, MANY, DEEP, PARTS = 4000, 6, 2000, 150, 500, 10
Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


def json_coder(path: str) -> tuple[PairCoder, dict[str, int]]:
    """The coder of a tokenizers .json file of the byte-level kind and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbol = byte_symbols()

    def own(token: str) -> str:
        return "".join(chr(symbol[c]) for c in token)

    tokens = [""] * len(spec["model"]["vocab"])
    for token, i in spec["model"]["vocab"].items():
        tokens[i] = own(token)
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    return PairCoder.from_merges(tokens, 256, [(own(a), own(b)) for a, b in pairs]), {t["content"]: t["id"] for t in spec["added_tokens"]}


def all_fillings(space: int, sizes: list[int], count: dict[int, int]) -> list[tuple[int, int, Filling]] | None:
    """(left over, parts, filling) of every filling that none of what is left still fits into; None if there are too many."""
    found: list[tuple[int, int, Filling]] = []
    steps = 0

    def grow(i: int, left: int, skipped: int, taken: Filling, depth: int = 0) -> bool:
        """Sizes up to the i-th are still to decide on; skipped is the least that was passed over."""
        nonlocal steps
        steps += 1
        if steps > STEPS or len(found) > MANY or depth > DEEP:
            return False
        while i >= 0 and sizes[i] > left:
            i -= 1
        if i < 0:
            if left < skipped:
                found.append((left, sum(n for _, n in taken), taken))
            return True
        size = sizes[i]
        most = min(count[size], left // size)
        for n in range(most, -1, -1):
            rest = left - n * size
            passed = min(skipped, size) if n < count[size] else skipped
            if not grow(i - 1, rest, passed, (*taken, (size, n)) if n else taken, depth + 1):
                return False
        return True

    return found if grow(len(sizes) - 1, space, space + 1, ()) else None


def some_fillings(space: int, sizes: list[int], count: dict[int, int]) -> list[tuple[int, int, Filling]]:
    """Fillings found in STEPS steps: a few next sizes are tried at each place, each as often as it goes."""
    found: list[tuple[int, int, Filling]] = []
    steps, least = 0, space

    def grow(left: int, top: int, taken: Filling) -> None:
        nonlocal steps, least
        steps += 1
        i = bisect_right(sizes, min(left, top)) - 1
        if i < 0 or steps > STEPS:
            if taken or i < 0:
                found.append((left, sum(n for _, n in taken), taken))
                least = min(least, left)
            return
        tried = 0
        while i >= 0 and tried < FILLINGS and steps <= STEPS:
            size = sizes[i]
            most = min(count[size], left // size)
            if most * size + (size - 1) * 64 < left - least and len(taken) > 4:  # can't beat what is known
                break
            grow(left - most * size, size - 1, (*taken, (size, most)))
            if least == 0 and taken:
                return
            i, tried = i - 1, tried + 1

    grow(space, space, ())
    return found


def fillings(space: int, sizes: list[int], count: dict[int, int]) -> tuple[list[Filling], bool]:
    """Undominated fillings of a space from what is left, least waste first, and whether these are all."""
    every = all_fillings(space, sizes, count)
    found = sorted(some_fillings(space, sizes, count) if every is None else every)
    kept: list[Filling] = []
    for _, _, f in found:
        if every is None and len(kept) == FILLINGS:
            break
        if not any(dominates(g, f) for g in kept):
            kept.append(f)
    return kept or [()], every is not None


def dominates(a: Filling, b: Filling) -> bool:
    """Whether b's parts fit, together, into a's parts. Of fillings with many parts only what filling one after another shows counts."""
    parts, rooms = ([s for s, n in f for _ in range(n)] for f in (b, a))
    if sum(parts) > sum(rooms) or (parts and (not rooms or parts[0] > rooms[0])):
        return False
    every = len(parts) <= PARTS and len(rooms) <= PARTS

    def fit(i: int) -> bool:
        if i == len(parts):
            return True
        tried = set()
        for j, room in enumerate(rooms):
            if parts[i] <= room and room not in tried:
                tried.add(room)
                rooms[j] -= parts[i]
                if fit(i + 1):
                    return True
                if not every:
                    return False
                rooms[j] += parts[i]
        return False

    return len(parts) <= 900 and fit(0)


def least(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound on the sequences: for each size, longer pieces that can't share one with a piece of that size or more have their own,
    those over half a sequence too, and what of the rest doesn't fit beside these needs more."""
    count = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        count[s] = n
    n, size = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * np.arange(capacity + 1))))
    at = np.arange(capacity // 2 + 1)  # pieces of at least this, of at most half
    half, alone = capacity // 2 + 1, capacity - at + 1  # first sizes over half, and too long for a piece of this size
    big, middle = n[-1] - n[alone], n[alone] - n[half]
    room = middle * capacity - (size[alone] - size[half])
    rest = size[half] - size[at]
    return int((big + middle + np.maximum(0, -((room - rest) // capacity))).max(initial=0))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: each piece, longest first, goes to the fullest sequence that takes it. Equal sequences are handled together."""
    rooms: dict[int, dict[Filling, int]] = {}
    order: list[int] = []  # what is left in open sequences

    def put(left: int, filling: Filling, times: int) -> None:
        if left not in rooms:
            rooms[left] = {}
            insort(order, left)
        rooms[left][filling] = rooms[left].get(filling, 0) + times

    for s in sorted((s for s, n in histogram.items() if n), reverse=True):
        left_over = histogram[s]
        while left_over:
            i = bisect_left(order, s)
            if i < len(order):
                room = order[i]
                filling, times = next(iter(rooms[room].items()))
            else:
                room, filling, times = capacity, (), left_over
            k = room // s  # the sequence just filled is the fullest one as long as it takes more
            used, each = (min(times, left_over // k), k) if left_over >= k else (1, left_over)
            if i < len(order):
                if used == times:
                    del rooms[room][filling]
                    if not rooms[room]:
                        del rooms[room]
                        order.pop(i)
                else:
                    rooms[room][filling] = times - used
            put(room - each * s, (*filling, (s, each)), used)
            left_over -= used * each
    return [(f, n) for r in rooms.values() for f, n in r.items()]


class Left:
    """The pieces that aren't packed yet: count by size, sizes in order."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {s: n for s, n in histogram.items() if n}
        self.sizes = sorted(self.count)

    def take(self, filling: Filling, times: int) -> None:
        for s, n in filling:
            self.count[s] -= n * times
            if not self.count[s]:
                del self.count[s]
                self.sizes.pop(bisect_left(self.sizes, s))

    def give(self, filling: Filling, times: int) -> None:
        for s, n in filling:
            if s not in self.count:
                self.count[s] = 0
                insort(self.sizes, s)
            self.count[s] += n * times

    def choices(self, capacity: int, without: frozenset[Filling]) -> tuple[Iterator[tuple[Filling, int]], bool]:
        """(filling with the largest piece in it, times), most times first, and whether these are all choices. without: fillings that aren't to be used."""
        largest = self.sizes[-1]
        self.take(((largest, 1),), 1)
        rest, every = fillings(capacity - largest, self.sizes, self.count)
        self.give(((largest, 1),), 1)
        whole = [tuple(sorted((dict(f) | {largest: dict(f).get(largest, 0) + 1}).items(), reverse=True)) for f in rest]
        whole = [(f, min(self.count[s] // n for s, n in f)) for f in whole if f not in without]
        fewer = ((f, t) for f, most in whole for t in range(most - 1, 0, -1))
        return chain(whole, fewer), every


def search(histogram: dict[int, int], capacity: int, nodes: int | None = None) -> tuple[list[tuple[Filling, int]], bool]:
    """Fillings and how often each is used, which hold exactly the histogram's pieces; and whether no plan has fewer sequences."""
    best = best_fit(histogram, capacity)
    most, bound, total = sum(t for _, t in best), least(histogram, capacity), sum(s * n for s, n in histogram.items())
    left, every, made = Left(histogram), True, 0
    path: list[list] = []  # [choices still to try, the one in use or None, its largest size, fillings not to use again for that size]
    used, waste, limit = 0, 0, NODES if nodes is None else nodes
    if most == bound:
        return best, True

    def opened(without: frozenset[Filling]) -> list:
        nonlocal every
        found, whole = left.choices(capacity, without)
        every = every and whole
        return [found, None, left.sizes[-1], without]

    path.append(opened(frozenset()))
    while path:
        top = path[-1]
        if top[1] is not None:  # take the last choice back
            (filling, times), top[1] = top[1], None
            left.give(filling, times)
            used, waste = used - times, waste - times * (capacity - sum(s * n for s, n in filling))
        following = next(top[0], None)
        if following is None:
            path.pop()
            continue
        if made >= limit:
            return best, False
        made += 1
        filling, times = following
        could = min(left.count[s] // n for s, n in filling)
        left.take(filling, times)
        top[1] = following
        used, waste = used + times, waste + times * (capacity - sum(s * n for s, n in filling))
        if not left.sizes:
            if used < most:
                best, most = [p[1] for p in path], used
                if most == bound:
                    return best, True
            continue
        # even one sequence fewer than the best can't waste more than this, or hold more than this
        if waste > (most - 1) * capacity - total or used + least(left.count, capacity) >= most:
            continue
        again = top[3] | {filling} if times < could else top[3]
        path.append(opened(again if left.sizes[-1] == top[2] else frozenset()))
    return best, every


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    return search(histogram, capacity)[0]


def pieces(df: DataFrame, vocabulary: str, capacity: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    import public_tokenizers

    coder, special = json_coder(vocabulary)
    shared, split = df.sparkSession.sparkContext.broadcast(coder), split_by(public_tokenizers.PATTERN, of_tokenizers)  # the vocabulary: fixed size
    space = ranges(of_tokenizers(r"\s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stop = word_coder(shared, split, space, special), array("I", [end]).tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            texts = (value.as_py() for value in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.packed(texts), strict=True):
                packed = ids + stop
                n = len(packed) // 4
                start = 0
                for k in range(-(-n // capacity)):
                    length = min((n - 1) % capacity + 1, n) if k == 0 else capacity
                    for column, v in zip(out, (doc_id, k, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)])), strict=True):
                        column.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(df: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence_id and offset; columns as pieces() gives them besides.

    A document is its ids and then ``end``; longer ones than capacity are cut, the first piece taking what is over.
    Null and empty texts: one piece, the end alone. Repeated rows are pieces of their own. An empty table gives none.
    Pieces of one length are numbered within salted groups and these are added up, so no length is one task's work.
    """
    spark = df.sparkSession
    found = saved(pieces(df, vocabulary, capacity, end, id_col, text_col))
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counted = saved(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    ranges, base, used = [], 0, dict.fromkeys(histogram, 0)
    for filling, times in plan(histogram, capacity):
        at = 0
        for size, n in filling:
            ranges.append((size, used[size], base, n, at))
            used[size] += n * times
            at += n * size
        base += times
    ranges.sort()
    table = np.array(ranges, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)  # at most a few rows for each of capacity lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, start, each, at = shared.value.T
        span = int(first.max(initial=0)) + 1
        keys = size.astype(object) * span + first if capacity * span > 1 << 62 else size * span + first
        for batch in batches:
            length, k = batch.column("length").to_numpy(), batch.column("k").to_numpy()
            i = np.searchsorted(keys, length * span + np.minimum(k, span - 1), side="right") - 1
            k = k - first[i]
            columns = [*batch.columns[:5], pa.array(start[i] + k // each[i]), pa.array(at[i] + k % each[i] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    numbered = salted.withColumn("k", number).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("k") + F.col("before")).alias("k"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
