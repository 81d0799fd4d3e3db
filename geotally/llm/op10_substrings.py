"""Operator 10: removal of repeated byte strings by merging Burrows-Wheeler transforms.

Which strings of SPAN bytes also start in a document with a smaller id? Every such string has an anchor, the least hash of
its k-grams, so equal strings have equal anchors, and neighbouring strings mostly share theirs: a context is a
run of strings with one anchor. Three steps, each written down:

1. Tasks send the anchors of their documents, packed by hash; an anchor of one document alone can't repeat. An anchor
   that several documents of a batch share is sent once. Anchors with more than HOT contexts are listed.
2. Contexts of shared anchors go to the partition of their anchor. Of equal contexts in a batch one is sent, the
   smallest document's; the others are settled where they are. A partition sorts the suffixes of each shard of contexts
   into a Burrows-Wheeler transform and merges the shards' transforms by refining their interleaving symbol by symbol, which
   sorts no suffix again. The step in which the refinement first parts neighbours is the length of their common prefix; runs of
   neighbours with SPAN or more in common are the repeated strings, and the smallest document of each decides.
   Contexts of a listed anchor don't meet in one partition: each batch settles their strings among its own documents
   and sends what is left, the smallest document's, to the partition of the string.
3. Documents take out what was found in them.

There are as many partitions as the corpus has PART bytes, and each gets the anchors, documents or strings of one route.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm.common import id_text, read, saved

SPAN, GRAM = 50, 16
SIDE, ANYWHERE = (SPAN - GRAM) // 2, 255
#: Strings in a context at most, suffixes merged at a time, shards they are dealt to.
RUN, BLOCK, SHARDS = 64, 120_000, 6
#: Contexts of an anchor that are merged in one task at most, and strings that are settled at a time where there are more.
HOT, STRINGS = 10_000, 300_000
#: Bytes of text to a partition.
PART = 12 << 20
#: Set in the key of a string that is sent by itself; anchors have 48 bits.
ALONE = np.uint64(1 << 63)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def hashes(raw: bytes) -> np.ndarray:
    """A hash of every k-gram."""
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    power, width = MIX[0], 1
    while width < GRAM:
        h = h[:-width] * power + h[width:]
        with np.errstate(over="ignore"):
            power = power * power
        width *= 2
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    h ^= h >> np.uint64(32)
    return h


def contexts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, anchor) of every context of a document."""
    none = np.zeros(0, np.int64)
    if len(raw) < SPAN:
        return none, none, none.astype(np.uint64)
    h = hashes(raw)
    least, width, whole = h, 1, SPAN - GRAM + 1
    while width * 2 <= whole:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < whole:
        least = np.minimum(least[: least.size - (whole - width)], least[whole - width :])
    anchor = least >> np.uint64(16)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(first, anchor.size))
    if count.max() > RUN:
        parts = -(-count // RUN)
        order = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, left = np.repeat(first, parts) + order * RUN, np.repeat(count, parts) - order * RUN
        count = np.minimum(left, RUN)
    return first, count, anchor[first]


def anchor_places(raw: bytes, first: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Where in each context its anchor's k-gram starts; ANYWHERE if not all strings share one."""
    h = hashes(raw) >> np.uint64(16)
    reach = np.arange(SPAN - GRAM + 1)
    at = (h[first[:, None] + reach] == anchor[:, None]).argmax(axis=1)
    return np.where(at >= count - 1, at, ANYWHERE).astype(np.uint8)


def binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """values cut at starts (of the first value too), as binary."""
    data = np.ascontiguousarray(values)
    offsets = (np.append(starts, data.size) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def cut(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if sorted_keys.size else np.zeros(0, np.int64)


def packed(route: np.ndarray, columns: list[np.ndarray]) -> list[pa.Array]:
    """One row a route: its number and each column's values as binary."""
    order = np.argsort(route, kind="stable")
    route = route[order]
    starts = cut(route)
    return [pa.array(route[starts].astype(np.int32)), *(binaries(c[order], starts) for c in columns)]


def announced(docs: DataFrame, routes: int) -> DataFrame:
    """Rows (route, known, doc, anchor, contexts), packed: anchors to be matched, and (doc, anchor) pairs known to be shared.

    contexts: how many the batch has of an anchor to be matched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *np.unique(contexts(v.as_buffer().to_pybytes())[2], return_counts=True)) for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if i is not None]
            doc = np.repeat(np.array([i for i, *_ in found], np.int64), [a.size for _, a, _ in found])
            anchor, count = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.uint64) for k in (1, 2))
            order = np.lexsort((doc, anchor))
            doc, anchor, count = doc[order], anchor[order], count[order]
            if not anchor.size:
                continue
            starts = cut(anchor)
            sizes = np.diff(np.append(starts, anchor.size))
            last = np.maximum.reduceat(doc, starts)
            known = np.repeat((sizes > 1) & (last > doc[starts]), sizes)
            total = np.add.reduceat(count, starts).astype(np.int32)
            for flag, doc_, anchor_, total_, route in ((False, doc[starts], anchor[starts], total, anchor[starts] % np.uint64(routes)), (True, doc[known], anchor[known], None, doc[known].view(np.uint64) * MIX[0] % np.uint64(routes))):
                rows = packed(route, [doc_, anchor_] if total_ is None else [doc_, anchor_, total_])
                rows += [pa.nulls(len(rows[0]), pa.binary())] * flag
                yield pa.RecordBatch.from_arrays([rows[0], pa.array([flag] * len(rows[0]), pa.bool_()), *rows[1:]], ["route", "known", "doc", "anchor", "contexts"])

    return docs.mapInArrow(run, "route int, known boolean, doc binary, anchor binary, contexts binary")


def in_routes(rows: DataFrame, routes: int) -> DataFrame:
    """A partition a route; rows without one (-1) go anywhere."""
    return rows.repartitionById(routes, F.pmod("route", F.lit(routes)).cast("int"))


def by_document(packed_rows: DataFrame, name: str, routes: int) -> DataFrame:
    """Rows (route, doc, values), packed by routes of documents -> one row a document: (doc_id, values as binary under this name).

    Values without documents (route -1) stay in rows without doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for route, d, v in zip(*(batch.column(c).to_pylist() for c in ("route", "doc", "values")), strict=True):
                if route < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([v], pa.binary())], ["doc_id", name])
                else:
                    parts.append((np.frombuffer(d, np.int64), np.frombuffer(v, np.uint64)))
        if parts:
            doc, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(doc, kind="stable")
            starts = cut(doc[order])
            yield pa.RecordBatch.from_arrays([pa.array(doc[order][starts]), binaries(value[order], starts)], ["doc_id", name])

    return in_routes(packed_rows, routes).mapInArrow(run, f"doc_id long, {name} binary")


def routed(doc: np.ndarray, value: np.ndarray, routes: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(packed(doc.view(np.uint64) * MIX[0] % np.uint64(routes), [doc, value]), ["route", "doc", "values"])


def shared_anchors(announcements: DataFrame, routes: int) -> DataFrame:
    """(doc_id, anchors packed): each document's anchors that another document has too; in rows without doc_id those with more than HOT contexts."""
    most = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {True: [], False: []}
        for batch in batches:
            for known, doc, anchor, n in zip(*(batch.column(c).to_pylist() for c in ("known", "doc", "anchor", "contexts")), strict=True):
                parts[known].append((np.frombuffer(doc, np.int64), np.frombuffer(anchor, np.uint64), *([] if known else [np.frombuffer(n, np.int32)])))
        out = parts[True]
        if parts[False]:
            doc, anchor, n = (np.concatenate(x) for x in zip(*parts[False], strict=True))
            order = np.lexsort((doc, anchor))
            doc, anchor = doc[order], anchor[order]
            starts = cut(anchor)
            hot = anchor[starts][np.add.reduceat(n[order], starts, dtype=np.int64) > most] if starts.size else anchor
            if hot.size:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([hot.tobytes()], pa.binary())], ["route", "doc", "values"])
            sizes = np.diff(np.append(starts, anchor.size))
            some = np.repeat(doc[starts] != doc[starts + sizes - 1], sizes)
            out.append((doc[some], anchor[some]))
        if out:
            yield routed(*(np.concatenate(x) for x in zip(*out, strict=True)), routes)

    return by_document(in_routes(announcements, routes).mapInArrow(run, "route int, doc binary, values binary"), "anchors", routes)


def spans_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal ones."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, ends.size - 1)]


def string_keys(strings: np.ndarray) -> np.ndarray:
    """A hash of each row of SPAN bytes."""
    h = np.full(strings.shape[0], MIX[1])
    for k in range(SPAN):
        h = (h ^ strings[:, k]) * MIX[0]
        h ^= h >> np.uint64(29)
    return h | ALONE


def of_smaller_documents(doc: np.ndarray, keys: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Which of some strings (rows of SPAN bytes, keys their hashes) a smaller document among them has too."""
    found = np.zeros(doc.size, bool)
    order = np.lexsort((doc, keys))
    while order.size:
        starts = cut(keys[order])
        lead = np.repeat(order[starts], np.diff(np.append(starts, order.size)))
        same = np.concatenate([(strings[order[i : i + STRINGS]] == strings[lead[i : i + STRINGS]]).all(axis=1) for i in range(0, order.size, STRINGS)])
        found[order] = same & (doc[lead] < doc[order])
        order = order[~same]  # other strings with the same hash
    return found


def sent_strings(joined: bytes, doc: np.ndarray, first: np.ndarray, count: np.ndarray, origin: np.ndarray, routes: int) -> Iterator[pa.RecordBatch]:
    """The rows of sent_contexts for contexts of anchors with too many: string by string."""
    every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), SPAN)
    piece = np.cumsum(count) // STRINGS
    for p in np.unique(piece):
        own = np.flatnonzero(piece == p)
        n = count[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        docs, start = np.repeat(doc[own], n), at - np.repeat(origin[own], n)
        strings = every[at]
        keys = string_keys(strings)
        settled = of_smaller_documents(docs, keys, strings)
        context = np.repeat(np.arange(own.size), n)
        here = np.flatnonzero(settled)
        new = cut(here - np.arange(here.size) + (strings.shape[0] + 1) * context[here])  # runs of settled strings within a context
        size, none = np.diff(np.append(new, here.size)), np.zeros(new.size, np.uint64)
        yield _row(True, docs[here[new]].view(np.uint64) * MIX[0] % np.uint64(routes), docs[here[new]], start[here[new]], size, none, none.astype(np.uint8), None)
        left = np.flatnonzero(~settled)
        yield _row(False, keys[left] % np.uint64(routes), docs[left], start[left], np.ones(left.size, np.int64), keys[left], np.full(left.size, ANYWHERE, np.uint8), [s.tobytes() for s in strings[left]])


def sent_contexts(candidates: DataFrame, routes: int, hot: np.ndarray) -> DataFrame:
    """Rows (route, settled, doc, first, count, anchor, at, data), packed. candidates: doc_id, text, anchors. hot: the anchors with too many contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                docs, firsts, counts, anchors, places, texts, base = [], [], [], [], [], [], 0
                for doc, value, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    raw = value.as_buffer().to_pybytes()
                    first, count, anchor = contexts(raw)
                    keep = np.isin(anchor, np.frombuffer(shared, np.uint64))
                    docs.append(np.full(int(keep.sum()), doc, np.int64))
                    firsts.append(first[keep] + base)
                    counts.append(count[keep])
                    anchors.append(anchor[keep])
                    places.append(anchor_places(raw, first[keep], count[keep], anchor[keep]) if keep.any() else np.zeros(0, np.uint8))
                    texts.append((raw, base))
                    base += len(raw)
                joined = b"".join(t for t, _ in texts)
                doc, first, count, anchor, place_at = (np.concatenate(x) for x in (docs, firsts, counts, anchors, places))
                origin = np.repeat(np.array([b for _, b in texts], np.int64), [d.size for d in docs])
                if not doc.size:
                    continue
                cuts = [joined[f : f + c + SPAN - 1] for f, c in zip(first.tolist(), count.tolist(), strict=True)]
                keys = np.fromiter(map(hash, cuts), np.int64, doc.size)
                order = np.lexsort((doc, keys))
                least, place = order[cut(keys[order])], np.cumsum(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) - 1
                lead = np.empty(doc.size, np.int64)
                lead[order] = least[place]  # the smallest document's entry with these bytes
                same = np.fromiter((c == cuts[k] for c, k in zip(cuts, lead.tolist(), strict=True)), bool, doc.size)
                settled = same & (doc[lead] < doc)
                many = ~settled & np.isin(anchor, hot)
                open_ = ~settled & ~many
                start = first - origin
                yield _row(True, doc[settled].view(np.uint64) * MIX[0] % np.uint64(routes), doc[settled], start[settled], count[settled], anchor[settled], place_at[settled], None)
                yield _row(False, anchor[open_] % np.uint64(routes), doc[open_], start[open_], count[open_], anchor[open_], place_at[open_], [cuts[i] for i in np.flatnonzero(open_)])
                if many.any():
                    yield from sent_strings(joined, doc[many], first[many], count[many], origin[many], routes)

    return candidates.mapInArrow(run, "route int, settled boolean, doc binary, first binary, count binary, anchor binary, at binary, data binary")


def _row(settled: bool, route, doc, first, count, anchor, at_anchor, data) -> pa.RecordBatch:
    order = np.argsort(route, kind="stable")
    route, doc, first, count, anchor, at_anchor = (a[order] for a in (route, doc, first, count, anchor, at_anchor))
    starts = cut(route)
    if data is None or not route.size:
        body = binaries(np.zeros(0, np.uint8), np.zeros(len(starts), np.int64))
    else:
        texts = [data[i] for i in order]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        body = binaries(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], ends[:-1]))[starts])
    return pa.RecordBatch.from_arrays([pa.array(route[starts].astype(np.int32)), pa.array([settled] * len(starts), pa.bool_()), *(binaries(c, starts) for c in (doc, first, count.astype(np.uint8), anchor, at_anchor)), body], ["route", "settled", "doc", "first", "count", "anchor", "at", "data"])


class Transform:
    """Burrows-Wheeler transform of a shard of strings (rows of symbols, 0 after their ends): suffixes in order and what precedes each."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        width = rows.shape[1]
        text = np.zeros((rows.shape[0], 2 * width), np.uint8)
        text[:, :width] = rows
        views = np.lib.stride_tricks.sliding_window_view(text, width, axis=1)[:, : width + 1]
        real = np.arange(width + 1) <= lengths[:, None]  # the end of a string is a suffix too
        row, at = np.nonzero(real)
        keys = np.ascontiguousarray(views[row, at]).view(f"S{width}").ravel()
        order = np.argsort(keys, kind="stable")
        self.row, self.at = row[order], at[order]
        self.before = np.where(self.at > 0, text[self.row, self.at - 1], 0).astype(np.uint8)
        place = np.empty((rows.shape[0], width + 1), np.int64)
        place[self.row, self.at] = np.arange(order.size)
        self.step = place[self.row, np.where(self.at > 0, self.at - 1, lengths[self.row])]  # the suffix that starts with what precedes


def merged(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the suffixes of all shards (counted one shard after another), and at each place the length of the common
    prefix with the suffix before, up to depth. Refines the interleaving of the transforms symbol by symbol."""
    base = np.cumsum([0, *(s.before.size for s in shards)])
    before = np.concatenate([s.before for s in shards])
    step = np.concatenate([s.step + b for s, b in zip(shards, base, strict=False)]).astype(np.int32)
    ends = np.concatenate([b + np.arange(int((s.before == 0).sum())) for s, b in zip(shards, base, strict=False)])  # the empty suffixes come first
    order, interval = np.arange(before.size, dtype=np.int32), np.zeros(before.size, np.int32)  # the interleaving: each shard's suffixes stay in their order
    common = np.zeros(before.size, np.uint8)
    for _ in range(depth):
        symbol = before[order]
        by = np.argsort(symbol, kind="stable")
        symbol, interval = symbol[by], interval[by]
        new = np.ones(before.size, bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        order = step[order[by]]
        order[: ends.size], new[1 : ends.size] = ends, False
        interval = np.cumsum(new, dtype=np.int32) - 1
        common += ~new  # places that are parted stay where they are
    return order, common


def repeated(texts: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each of some different contexts, the smallest document of each of its strings. least: the smallest of each context."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(lengths.max())
    rows = np.frombuffer(b"".join(t.ljust(width, b"\xff") for t in texts), np.uint8).reshape(-1, width) + np.uint8(1)  # UTF-8 has no byte 255
    shards = [Transform(rows[i::SHARDS], lengths[i::SHARDS]) for i in range(min(SHARDS, len(texts)))]
    order, common = merged(shards, SPAN)
    interval = np.empty(order.size, np.int64)
    interval[order] = np.cumsum(common < SPAN) - 1  # neighbours with SPAN symbols in common are in one
    row = np.concatenate([s.row * SHARDS + i for i, s in enumerate(shards)])
    at = np.concatenate([s.at for s in shards])
    string = at + SPAN <= lengths[row]
    row, at, interval = row[string], at[string], interval[string]
    smallest = np.full(int(interval.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, interval, least[row])
    in_order = np.lexsort((at, row))
    value = smallest[interval[in_order]]
    return np.split(value, np.cumsum(lengths - SPAN + 1)[:-1])


def worth_merging(group: dict[bytes, tuple]) -> list[tuple[bytes, list]]:
    """The contexts of an anchor that may share a string with another. A string has SIDE bytes or more beside its anchor on the left or on
    the right, so contexts that share one share the anchor with SIDE bytes of that side; contexts alone with both have no repeat."""
    sides: dict = {}
    keys = []
    for text, (at, _) in group.items():
        if at == ANYWHERE:
            keys.append(((None,), (None,)))
            sides[None,] = 2
            continue
        own = (0, text[at - SIDE : at]) if at >= SIDE else None, (1, text[at + GRAM : at + GRAM + SIDE]) if at + GRAM + SIDE <= len(text) else None
        keys.append(own)
        for k in own:
            if k is not None:
                sides[k] = sides.get(k, 0) + 1
    if (None,) in sides:
        return [(text, entries) for text, (_, entries) in group.items()]
    return [(text, entries) for (text, (_, entries)), own in zip(group.items(), keys, strict=True) if any(k is not None and sides[k] > 1 for k in own)]


def decided(sent: DataFrame, routes: int) -> DataFrame:
    """(doc_id, spans): what is removed from a document, each span as start * 2^20 + length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        docs, begins, ends = [], [], []
        by_anchor: dict[int, dict[bytes, tuple]] = {}
        alone: list[tuple] = []
        for batch in batches:
            for settled, *columns in zip(*(batch.column(c).to_pylist() for c in ("settled", "doc", "first", "count", "anchor", "at", "data")), strict=True):
                doc, first, count, anchor, place = (np.frombuffer(c, t) for c, t in zip(columns, (np.int64, np.int64, np.uint8, np.uint64, np.uint8), strict=False))
                size = count.astype(np.int64) + SPAN - 1
                if settled:
                    out.append((doc, first, first + size))
                    continue
                data, at = columns[5], 0
                if anchor.size and anchor[0] >= ALONE:
                    alone.append((doc, first, anchor, np.frombuffer(data, np.uint8).reshape(-1, SPAN)))
                    continue
                for d, f, s, a, p in zip(doc.tolist(), first.tolist(), size.tolist(), anchor.tolist(), place.tolist(), strict=True):
                    by_anchor.setdefault(a, {}).setdefault(data[at : at + s], (p, []))[1].append((d, f))
                    at += s
        held: list[tuple[bytes, list]] = []
        total = 0

        def settle() -> None:
            nonlocal held, total
            least = np.array([min(e)[0] for _, e in held], np.int64)
            for (text, entries), value in zip(held, repeated([t for t, _ in held], least), strict=True):
                for d, f in entries:
                    hit = np.flatnonzero(value < d)
                    if hit.size:
                        low, high = int(hit[0]), int(hit[-1])
                        a, b = ([f + low], [f + high + SPAN]) if high - low < hit.size else (x.tolist() for x in spans_of(hit + f, hit + f + SPAN))
                        docs.extend([d] * len(a))
                        begins.extend(a)
                        ends.extend(b)
            held, total = [], 0

        for group in by_anchor.values():
            for text, (_, entries) in group.items():  # all strings of a context repeat in its copies, and its smallest document has them first
                if len(entries) > 1:
                    smallest = min(entries)[0]
                    for d, f in entries:
                        if d > smallest:
                            docs.append(d)
                            begins.append(f)
                            ends.append(f + len(text))
                    entries[:] = [e for e in entries if e[0] == smallest]
            if len(group) == 1:
                continue
            some = worth_merging(group)
            held += some
            total += sum(len(t) + 1 for t, _ in some)
            if total >= BLOCK:
                settle()
        if held:
            settle()
        if docs:
            out.append(tuple(np.array(x, np.int64) for x in (docs, begins, ends)))
        if alone:
            doc, first, keys, strings = (np.concatenate(x) for x in zip(*alone, strict=True))
            gone = of_smaller_documents(doc, keys, strings)
            out.append((doc[gone], first[gone], first[gone] + SPAN))
        if out:
            doc, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield routed(doc, (a * (1 << 20) + (b - a)).view(np.uint64), routes)

    return by_document(in_routes(sent, routes).mapInArrow(run, "route int, doc binary, values binary"), "spans", routes)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with keep_bytes the kept bytes as column kept.

    Null and empty texts have nothing to remove, and texts under SPAN bytes neither. Very long texts are taken whole. Rows that repeat a doc_id don't repeat each
    other: only a smaller doc_id counts. A row without doc_id neither loses bytes nor makes others lose some. An empty table gives none.
    """
    spark = df.sparkSession
    docs = id_text(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(8, -(-size // PART))
    wanted = saved(shared_anchors(announced(docs, routes), routes))
    listed = [np.frombuffer(r[0], np.uint64) for r in wanted.where("doc_id is null").select("anchors").collect()]  # at most one anchor in HOT contexts
    hot = np.concatenate([np.zeros(0, np.uint64), *listed])
    removed = saved(decided(sent_contexts(docs.join(wanted, "doc_id").select("doc_id", "text", "anchors"), routes, hot), routes))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = value.as_buffer().to_pybytes()
                kept, gone, runs = raw, 0, 0
                if spans:
                    packed_spans = np.frombuffer(spans, np.int64)
                    a, b = packed_spans >> 20, (packed_spans >> 20) + (packed_spans & 0xFFFFF)
                    a, b = spans_of(a, b)
                    gone, runs = int((b - a).sum()), a.size
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                rows.append((len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), *[kept] * keep_bytes))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * keep_bytes]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.join(removed, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"))
