"""Operator 13: ranked lexical search by scanning the documents with an Aho-Corasick automaton of all items' terms.

There is no index of the documents. Every term stands in the automaton between two spaces and a text is laid out with
spaces for all that belongs to no term, so a match is a whole term; matches are counted as they come and lead to the items that hold the
term. A first scan gives the number and length of documents and in how many each term occurs, a second one the scores; each
task keeps the best of its documents for every item. Items are scanned for in blocks of at most BLOCK bytes, so what a task
holds doesn't grow with their number. Text is handled as bytes, each as the Latin-1 character of the same number.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotally.llm.common import id_text, read, saved

#: Documents ranked for an item, bytes of items scanned for at a time, and groups in which an item's best of all tasks are first compared.
TOP, BLOCK, SALTS = 10, 4 << 20, 64
#: Bytes of terms (the digits, the letters, A-Z lower-cased, and all of longer characters); any other is a space.
LAID = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def laid_out(raw: bytes) -> bytes:
    return raw.translate(LAID)


def terms_of(text: str) -> list[str]:
    return [t.decode("latin-1") for t in laid_out(text.encode()).split()]


class Scanner:
    """The automaton of some items' terms. items: their texts' terms, repeats included."""

    def __init__(self, items: list[list[str]]):
        held = [Counter(i) for i in items]
        self.terms = sorted(set().union(*held))
        self.number = {t: k for k, t in enumerate(self.terms)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, k in self.number.items():
            self.automaton.add_word(f" {t} ", k)
        self.automaton.make_automaton()
        pairs = sorted((self.number[t], i, c) for i, h in enumerate(held) for t, c in h.items())
        self.first = np.searchsorted([p[0] for p in pairs], np.arange(len(self.terms) + 1))
        self.item, self.times = np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], np.int64)

    def counts(self, laid: bytes) -> Counter:
        """How often each of the terms occurs in a laid-out text."""
        return Counter(k for _, k in self.automaton.iter(f" {laid.decode('latin-1')} ")) if self.terms else Counter()


def scanner(shared) -> Scanner:
    """Built once a worker process and broadcast."""
    if getattr(scanner, "of", None) != shared.id:
        scanner.of, scanner.built = shared.id, Scanner(shared.value)
    return scanner.built


class Shared:
    """A broadcast value with a name by which workers know it."""

    def __init__(self, spark: SparkSession, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def statistics(docs: DataFrame, shared: Shared) -> tuple[int, int, dict[int, int]]:
    """N, L and in how many documents each term of the block occurs. docs: doc_id, text. A task sends a row a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, length, held, found = 0, 0, scanner(shared), Counter()
        for batch in batches:
            for value in batch.column(0):
                laid = laid_out(value.as_buffer().to_pybytes())
                n = len(laid.split())
                some, length = some + (n > 0), length + n
                found.update(held.counts(laid).keys())
        found[-1], found[-2] = some, length
        yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.int64()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    found = dict(docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())  # a row a term of the block
    return found.pop(-1, 0), found.pop(-2, 0), found


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def best(docs: DataFrame, shared: Shared, top: int) -> DataFrame:
    """item (its number), doc_id, score: the best documents of each task for each item of the block."""
    total, length, holding = statistics(docs, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = scanner(shared)
        weights = np.array([weight(total, holding.get(k, 0)) for k in range(len(held.terms))], np.int64)
        n_items = len(shared.value)
        heaps, least, scores = [[] for _ in range(n_items)], np.zeros(n_items, np.int64), np.zeros(n_items, np.int64)
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                laid = laid_out(value.as_buffer().to_pybytes())
                found = held.counts(laid)
                if not found:
                    continue
                m = 25 + 75 * len(laid.split()) * total // length
                k, tf = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
                gain = weights[k] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                sizes = held.first[k + 1] - held.first[k]
                at = np.repeat(held.first[k] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                np.add.at(scores, held.item[at], np.repeat(gain, sizes) * held.times[at])
                place = -math.inf if doc_id is None else -doc_id
                for i in np.flatnonzero((scores >= least) & (scores > 0)).tolist():
                    entry = (int(scores[i]), place)
                    if len(heaps[i]) < top:
                        heapq.heappush(heaps[i], entry)
                    elif entry > heaps[i][0]:
                        heapq.heapreplace(heaps[i], entry)
                    if len(heaps[i]) == top:
                        least[i] = heaps[i][0][0]
                scores[:] = 0
        rows = [(i, None if place == -math.inf else -place, score) for i, heap in enumerate(heaps) for score, place in heap]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, doc_id long, score long")


def highest(df: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The highest scores of each group with their rank; equal ones by ascending doc_id, null last."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(df: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the documents with the highest scores above 0.

    Every row of items is an item of its own: rows that share an id, or all they have, are ranked each by itself (equal ones alike). Null
    and empty texts have no terms: such an item finds nothing and such a document is never found. Null ids stay as they
    are, last among equal scores. Repeated documents count and are ranked each. A very long text is scanned whole. Without documents or items no row comes.
    """
    docs = id_text(df, id_col, text_col)
    spark = df.sparkSession
    named = id_text(items, item_col, item_text_col).withColumnRenamed("doc_id", "item_id").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("rows"))
    size = named.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = int(size // block) + 1
    named = saved(named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartition(min(blocks, 200), "block"))
    out = None
    for b in range(blocks):
        found = sorted(named.where(F.col("block") == b).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))  # about BLOCK bytes
        if not found:
            continue
        shared = Shared(spark, [terms_of(r["text"]) for r in found])
        ids = spark.createDataFrame([(i, r["item_id"], r["rows"]) for i, r in enumerate(found)], "item long, item_id long, rows long")
        of_tasks = best(docs, shared, top).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        of_all = highest(highest(of_tasks, ["item", "salt"], top).drop("rank"), ["item"], top)
        part = of_all.join(F.broadcast(ids), "item").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
        part = part.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
with words as (select doc_id, unnest({_WORDS.format("text")}) as term from documents),
tf as (select doc_id, term, count(*) as tf from words group by doc_id, term),
lengths as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
whole as (select count(*) as docs, sum(n)::bigint as total from lengths),
wanted as (select item_id, term, count(*) as times from (select item_id, unnest({_WORDS.format("text")}) as term from benchmark) group by item_id, term),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, whole where term in (select term from wanted) group by term),
scores as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score
  from wanted join weights using (term) join tf using (term) join lengths using (doc_id), whole group by item_id, doc_id),
ranks as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranks where rank <= 10
"""
