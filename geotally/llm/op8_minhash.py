"""Operator 8: near-duplicates by circulant MinHash, with every link verified on full shingle sets.

A first permutation (a bijective mix of the shingle's hash) puts a document's shingles on a circle of CIRCLE places. One
second permutation of the circle, read at every circular shift in turn, gives all signature coordinates: coordinate k is the
least value among the places shifted by k. Bands of ROWS coordinates bring candidates together; there are so many bands
that a pair at the threshold shares none with a probability of at most MISS.

Documents with the same shingle set are one node. What has to be known of a band's group is only which nodes
are connected, so its pairs are never listed. First each member is compared with the group's smallest id, on whole texts; that
connects most groups. Groups that aren't connected by then are gathered into clusters of overlapping groups. A member can
have a link to another label only if enough of its shingles also stand in members of other labels of its cluster; the
others are settled by counting. What is left is compared exactly through an inverted index, in pairs of blocks whose number grows as
the root of the cluster, so that large clusters spread over many tasks. A task sends an edge only where it joins two labels that
it hasn't joined yet. No link between different components is left out and no group or partner is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm.common import id_text, passing, read, saved, unused
from geotally.llm.components import components
from geotally.llm.op5_quality_rules import windows, word_hashes

CIRCLE, ROWS, MISS, SEED = 1 << 20, 5, 1e-7, 20240229
#: Shingles whose coordinates are worked out at a time, and sets a task keeps at hand when it verifies pairs.
STEP, HELD = 4096, 256
#: Shingles to a block of a cluster at most, shingles to a pair of blocks in small clusters, and groups that rows with one set are dealt to.
BLOCK, PAIR, SALTS = 1_000_000, 4000, 64


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of fewer words than one, the whole sequence; none without words."""
    hashes = word_hashes(raw.lower().split())  # bytes.lower() is A-Z only; bytes.split() is at \x09-\x0d and \x20
    if not hashes.size:
        return hashes
    if hashes.size < words:
        return windows(hashes, hashes.size) ^ np.uint64(hashes.size)
    return np.unique(windows(hashes, words))


class Circle:
    """The two permutations. Signatures of one process come from one of these."""

    def __init__(self, coordinates: int):
        second = np.random.default_rng(SEED).permutation(CIRCLE).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)
        out = self.shifted[place[:STEP]].min(axis=0)
        for at in range(STEP, place.size, STEP):
            np.minimum(out, self.shifted[place[at : at + STEP]].min(axis=0), out=out)
        return out


_circles: dict[int, Circle] = {}


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def signed(df: DataFrame, words: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set; null if empty), bands: array of band keys. df: doc_id, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if bands not in _circles:
            _circles[bands] = Circle(bands * ROWS)
        circle = _circles[bands]
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sizes, keys, rows = [], [], []
                for value in batch.column(1):
                    s = shingles(value.as_buffer().to_pybytes(), words)
                    sizes.append(s.size)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if s.size else None)
                    if s.size:
                        sig = circle.signature(s).astype(np.uint64).reshape(bands, ROWS)
                        h = salt.copy()
                        for r in range(ROWS):
                            h = (h ^ sig[:, r]) * np.uint64(0xFF51AFD7ED558CCD)
                            h ^= h >> np.uint64(33)
                        rows.append(h.view(np.int64))
                    else:
                        rows.append(())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def with_nodes(light: DataFrame) -> DataFrame:
    """light (what signed() gave, saved) with rep, the smallest doc_id of the rows with the same set; bands stay at that row alone.

    A set of many rows meets by salts, so no task has them all.
    """
    salted = light.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    part = salted.where("set_key is not null").groupBy("set_key", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    several = part.groupBy("set_key").agg(F.min("least").alias("rep"), F.sum("c").alias("c")).where("c > 1").select("set_key", "rep")
    known = part.join(several, "set_key").select("set_key", "salt", "rep")
    rep = F.when(F.col("set_key").isNotNull(), F.coalesce("rep", "doc_id"))
    return salted.join(known, ["set_key", "salt"], "left").select("doc_id", "n_shingles", rep.alias("rep"), F.when(F.col("doc_id") == rep, F.col("bands")).alias("bands"))


def verified(pairs: DataFrame, texts: DataFrame, words: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: 100 * intersection >= per_cent * union. texts: rep, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def of(key, text) -> np.ndarray:
            s = held.get(key)
            if s is None:
                if len(held) >= HELD:
                    held.clear()
                s = held[key] = shingles(text.as_buffer().to_pybytes(), words)
            return s

        for batch in batches:
            out = []
            for a, b, g, h, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "g", "h")), batch.column("x"), batch.column("y"), strict=True):
                s, t = of((a, g), x), of((b, h), y)
                if s.size > t.size:
                    s, t = t, s
                i = np.minimum(np.searchsorted(t, s), t.size - 1)
                both = int((t[i] == s).sum())
                out.append(100 * both >= per_cent * (s.size + t.size - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    left = texts.select(F.col("rep").alias("a"), F.col("h").alias("g"), F.col("text").alias("x"))
    right = texts.select(F.col("rep").alias("b"), "h", F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "g", "h", "x", "y").mapInArrow(run, "a long, b long")


def may_link(members: DataFrame, words: int, per_cent: int) -> DataFrame:
    """The rows of members (cluster, rep, h, label, text) that may have a link to another label of their cluster, with n shingles.

    Texts that are similar share at least per_cent of either one's shingles, so a member whose shingles stand in other
    labels less often than that has no such link.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(v.as_buffer().to_pybytes(), words).view(np.int64) for v in batch.column("text")]
            offsets = np.cumsum([0, *(s.size for s in found)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "rep", "h", "label")), values], ["cluster", "rep", "h", "label", "s"])

    each = saved(members.mapInArrow(run, "cluster long, rep long, h long, label long, s array<long>"))
    single = each.select("cluster", "rep", "h", "label", F.size("s").alias("n"), F.explode("s").alias("s"))
    mixed = saved(single.groupBy("cluster", "s").agg(F.min("label").alias("l"), F.max("label").alias("g")).where("l <> g").select("cluster", "s"))
    counts = single.join(mixed, ["cluster", "s"]).groupBy("rep", "h", "n").agg(F.count("*").alias("c")).where(F.col("c") * 100 >= F.col("n") * per_cent)
    return members.join(counts.drop("c"), ["rep", "h"])


def linked(table: pa.Table, words: int, per_cent: int) -> pa.Table:
    """Edges that join the labels which are linked: fewer than there are labels.

    table: rep, label, block, text and the pair of blocks (i, j) to be compared. Intersections are counted through an inverted index
    of the shingles, so only shared shingles cost time, and no pair is listed that isn't a link.
    """
    table = table.sort_by("rep")
    reps, label, block = (table.column(c).to_numpy() for c in ("rep", "label", "block"))
    i, j = (table.column(c)[0].as_py() for c in "ij")
    sets = [shingles(v.as_buffer().to_pybytes(), words) for v in table.column("text")]
    size = np.array([s.size for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    posting, first = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    start = np.cumsum(size) - size
    values, label, count = np.unique(label, return_inverse=True, return_counts=True)
    common, parent = count.argmax(), list(range(values.size))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    a, b = [], []
    for u in np.flatnonzero(label != common):
        mine = code[start[u] : start[u] + size[u]]
        n = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=len(sets))
        link = (100 * both >= per_cent * (size[u] + size - both)) & (label != label[u])
        if i != j:
            link &= block != block[u]
        hits = np.flatnonzero(link)
        for other, at_hit in zip(*np.unique(label[hits], return_index=True), strict=True):
            if (x := root(int(label[u]))) != (y := root(int(other))):
                parent[y] = x
                a.append(reps[u])
                b.append(reps[hits[at_hit]])
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())}) if a else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def near_duplicates(df: DataFrame, per_cent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept of every row.

    Null, empty and wordless texts have no shingles and link with nothing. Rows with one set are always linked. Rows that
    repeat a doc_id are one document, which has the links of all its texts. A null doc_id has the component of rows with its set
    and makes none. Very long texts are taken whole, STEP shingles at a time. An empty table gives none.
    """
    spark, docs = df.sparkSession, id_text(df, id_col, text_col)
    with passing(spark):
        light = saved(signed(docs, words, bands_for(per_cent / 100)))
        rows = saved(with_nodes(light), lasting=True)
        labels = saved(_labels(docs, rows, words, per_cent), lasting=True)
    result = rows.select("doc_id", "n_shingles", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _labels(docs: DataFrame, rows: DataFrame, words: int, per_cent: int) -> DataFrame:
    """(v, label) of every node that is linked with another."""
    nodes = rows.where("bands is not null").select("rep", "n_shingles", "bands").distinct()
    grouped = nodes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    sizes = grouped.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("first")).where("m > 1").select("band", "first")
    members = saved(grouped.join(sizes, "band"))
    wanted = docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("h"), "text")
    texts = saved(wanted.groupBy("rep", "h").agg(F.first("text").alias("text")))

    # every member with the first of its group; and the texts of one document
    close = (F.col("n") * 100 >= F.col("first.n") * per_cent) & (F.col("first.n") * 100 >= F.col("n") * per_cent)
    pairs = members.where((F.col("rep") != F.col("first.rep")) & close).select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).distinct()
    repeated = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z and doc_id is not null").select("doc_id", "a")
    own = rows.join(repeated, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    edges = saved(verified(pairs, texts, words, per_cent).unionByName(own))
    labels = components(edges)

    # groups that aren't connected yet: members of different labels, block by block
    now = members.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
    apart = now.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("g"), F.min("rep").alias("first")).where("l <> g").select("band", "first")
    open_ = saved(now.join(apart, "band").select("rep", "label", "first").distinct())
    together = components(open_.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")))
    cluster = open_.select("rep", "label").distinct().join(together.select(F.col("v").alias("rep"), F.col("label").alias("cluster")), "rep")
    left = saved(may_link(saved(cluster.join(texts, "rep")), words, per_cent))
    wide = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sqrt(F.sum("n") / PAIR))).cast("int")
    blocks = left.groupBy("cluster").agg(wide.alias("blocks"), F.min("label").alias("l"), F.max("label").alias("g")).where("l <> g").select("cluster", "blocks")
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")  # so that a large cluster doesn't meet its row of blocks in one task
    every = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = left.withColumn("salt", salt).join(every, ["cluster", "salt"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.select("*", other.alias("o")).select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep", "label", "text")
    more = saved(spread.groupBy("cluster", "i", "j").applyInArrow(lambda t: linked(t, words, per_cent), "a long, b long"))
    return components(edges.unionByName(more))


def one_of_each(docs: DataFrame, per_cent: int = 80) -> DataFrame:
    """docs, all columns, with one document of each group of near-duplicates."""
    name = unused(docs, "dropped_id")
    dropped = near_duplicates(docs, per_cent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped[name], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), 85)
