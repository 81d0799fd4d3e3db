"""Operator 2: exact dedup through a cuckoo-filter index of live digests.

Every row's text is reduced by built-in functions to its content key: SHA-256, byte length and an independent
64-bit hash. A task's index is a cuckoo filter beside buckets of content keys. The filter holds fingerprints alone, in two candidate
groups of slots each, the second found from the first by the fingerprint, so they can move and be deleted. A key whose fingerprint isn't
in the filter is new. A hit is verified against the content keys in the key's bucket, so collisions never merge different
texts. When an insertion finds no free slot after MOVES moves, the filter doubles and is rebuilt from the stored keys.

Groups of copies are summed up on the map side first: each task runs its own index over its rows and sends one
row a distinct text, so a text with a third of all rows costs a bucket as many rows as there are map tasks. Partitions are as many
as the distinct keys need. Only texts with several rows meet their rows again, by salts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm.common import id_text, read, saved, unused

#: Fingerprints a slot group holds, moves before the filter grows, keys to a partition, and groups that rows with one text are dealt to.
SLOTS, MOVES, KEYS, SALTS = 4, 200, 250_000, 64
MASK = (1 << 64) - 1
#: Stands for a null doc_id.
NONE = -(1 << 63)


class CuckooIndex:
    """Live content keys (bytes, uniformly distributed) with a value each: [largest id, live rows]."""

    def __init__(self, groups: int = 64):
        self.groups = groups  # a power of two
        self.filter: list[list[int]] = [[] for _ in range(groups)]
        self.buckets: list[list[tuple]] = [[] for _ in range(groups)]
        self.size = self.rebuilds = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") | 1 << 16  # never 0
        first = int.from_bytes(key[:8], "little") & (self.groups - 1)
        return mark, first, self._other(first, mark)

    def _other(self, group: int, mark: int) -> int:
        return group ^ (((mark * 0x9E3779B97F4A7C15) & MASK) >> 32) & (self.groups - 1)

    def find(self, key: bytes) -> list | None:
        """The value of a live key: a fingerprint's hit, verified against the bucket's content keys."""
        mark, first, second = self._places(key)
        if mark not in self.filter[first] and mark not in self.filter[second]:
            return None
        for stored, value in self.buckets[first]:
            if stored == key:
                return value
        return None

    def insert(self, key: bytes, largest: int, rows: int = 1) -> None:
        value = self.find(key)
        if value is None:
            self.buckets[self._places(key)[1]].append((key, [largest, rows]))
            self.size += 1
            self._mark(key)
        else:
            value[0] = max(value[0], largest)
            value[1] += rows

    def delete(self, key: bytes, rows: int = 1) -> bool:
        """Take rows of a live key away; the key and its fingerprint go with its last row. False: no such key."""
        value = self.find(key)
        if value is None:
            return False
        value[1] -= rows
        if value[1] <= 0:
            mark, first, second = self._places(key)
            self.buckets[first] = [e for e in self.buckets[first] if e[0] != key]
            self.filter[first if mark in self.filter[first] else second].remove(mark)
            self.size -= 1
        return True

    def _mark(self, key: bytes) -> None:
        mark, group, second = self._places(key)
        for g in (group, second):
            if len(self.filter[g]) < SLOTS:
                self.filter[g].append(mark)
                return
        for move in range(MOVES):  # evict in turn, deterministically
            slot = move % SLOTS
            mark, self.filter[group][slot] = self.filter[group][slot], mark
            group = self._other(group, mark)
            if len(self.filter[group]) < SLOTS:
                self.filter[group].append(mark)
                return
        live = list(self.items())  # the key that found no place is among them
        self.groups *= 2
        self.rebuilds += 1
        self.filter, self.buckets = [[] for _ in range(self.groups)], [[] for _ in range(self.groups)]
        for e in live:
            self.buckets[self._places(e[0])[1]].append(e)
        for e in live:
            self._mark(e[0])

    def items(self) -> Iterator[tuple]:
        return (e for bucket in self.buckets for e in bucket)


def _live(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    live = list(index.items())
    for at in range(0, len(live), 20_000):
        part = live[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.binary()), pa.array([e[1][0] for e in part], pa.int64()), pa.array([e[1][1] for e in part], pa.int64())], ["key", "largest", "rows"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, largest, rows) -> one row a distinct key, through one index."""
    index = CuckooIndex()
    for batch in batches:
        for key, largest, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            index.insert(key, NONE if largest is None else largest, rows)
    yield from _live(index)


def content_key(text: Column) -> Column:
    """SHA-256, byte length and an independent 64-bit hash of a text, as bytes."""
    number = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))
    return F.concat(F.unhex(F.sha2(text.cast("binary"), 256)), number(F.octet_length(text)), number(F.xxhash64(text)))


def content_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 and the content key of every row, by built-in functions alone."""
    key = content_key(F.col("text"))
    return id_text(df, id_col, text_col).select("doc_id", key.alias("key")).select("doc_id", F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"), "key")


SCHEMA = "key binary, largest long, rows long"


def groups(keys: DataFrame) -> DataFrame:
    """key, largest (doc_id), rows of every distinct content key: map-side indexes, then one index a partition of keys."""
    local = saved(keys.select("key", F.col("doc_id").alias("largest"), F.lit(1).cast("long").alias("rows")).mapInArrow(_indexed, SCHEMA))
    return local.repartition(1 + local.count() // KEYS, "key").mapInArrow(_indexed, SCHEMA)


def keep_id(largest: Column) -> Column:
    return F.when(largest > F.lit(NONE), largest)


def with_groups(keys: DataFrame) -> DataFrame:
    """keys (doc_id, text_sha256, key) with largest and rows of their group, null where the row is alone with its text."""
    several = groups(keys).where("rows > 1")
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    met = salted.select("key", "salt").distinct().join(several, "key")  # at most SALTS rows a key
    return salted.join(met, ["key", "salt"], "left")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as empty. Of equal texts the row with the largest doc_id stays; were doc_id repeated, all its rows
    are marked as kept. A null doc_id loses to any other. Very long texts are digested whole. An empty table gives an empty result.
    """
    found = with_groups(content_keys(df, id_col, text_col))
    keep = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(keep_id(F.col("largest")))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


LIVE = "key binary, doc_id long, rows long"


def live_rows(keys: DataFrame) -> DataFrame:
    """The index that update() keeps: key, doc_id, rows of every live document. keys: as content_keys() gives them."""
    return keys.groupBy("key", "doc_id").agg(F.count("*").alias("rows"))


def update(live: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """A kept index (live_rows()) after insertions and deletions, rows as content_keys() gives them; group_of() reads it.

    Deleting takes rows off a live digest of a document and the digest with its last row; deleting what isn't there changes
    nothing. Digests carry their document, so a text with many copies is spread over all partitions.
    """
    one = lambda df, sign: df.select("key", "doc_id", F.lit(sign).cast("long").alias("rows"))
    merged = saved(live.select("key", "doc_id", "rows").unionByName(live_rows(inserted)).unionByName(one(deleted, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, gone = CuckooIndex(), []
        for batch in batches:
            for key, doc_id, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = NONE if doc_id is None else doc_id
                digest = hashlib.sha256(key + own.to_bytes(8, "little", signed=True)).digest() + key
                if rows < 0:
                    gone.append(digest)
                else:
                    index.insert(digest, own, rows)
        for digest in gone:
            index.delete(digest)
        for part in _live(index):
            ids = [None if i == NONE else i for i in part.column("largest").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k[32:] for k in part.column("key").to_pylist()], pa.binary()), pa.array(ids, pa.int64()), part.column("rows")], ["key", "doc_id", "rows"])

    return merged.repartition(1 + merged.count() // KEYS, "key", "doc_id").mapInArrow(run, LIVE)


def group_of(live: DataFrame) -> DataFrame:
    """key, keep_id, rows of every live text."""
    return live.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("rows"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that exact_groups() drops; of repeated rows one stays. Texts are shuffled once, twice if rows repeat."""
    found = with_groups(content_keys(docs, id_col, text_col)).where("rows is not null")
    key, own, largest, n = (unused(docs, c) for c in ("content_key", "own_id", "largest_id", "n_rows"))
    counted = saved(found.groupBy(F.col("key").alias(key), F.coalesce("doc_id", F.lit(NONE)).alias(own)).agg(F.first("largest").alias(largest), F.count("*").alias(n)))
    keyed = docs.withColumns({key: content_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), own: F.coalesce(F.col(id_col).cast("long"), F.lit(NONE))})
    gone = counted.where((F.col(own) != F.col(largest)) | (F.col(n) > 1)).select(key, own)
    others = keyed.join(gone.hint("merge"), [key, own], "left_anti")  # never a broadcast: the same plan at every size
    again = counted.where((F.col(own) == F.col(largest)) & (F.col(n) > 1)).select(key, own)
    if again.isEmpty():
        return others.select(*docs.columns)
    repeated = keyed.join(again.hint("merge"), [key, own], "left_semi").dropDuplicates([key, own])
    return others.unionByName(repeated).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
