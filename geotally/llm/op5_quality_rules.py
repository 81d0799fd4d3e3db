"""Operator 5: quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams: one of trusted documents, one of the whole corpus. A document's ratio is the
mean over its n-grams of log p(trusted) - log p(raw), so length doesn't matter; every document is kept or not by a
fixed threshold, never by chance. The corpus is counted whole: each task sums its own documents, and what it sends
is at most one row a bucket. So are all trusted documents, which are named by id.
Simple counts of words, symbols, repeated lines and repeated word windows go before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm.common import id_text, read

#: Buckets, bytes to an n-gram, the threshold of the mean log ratio.
BUCKETS, GRAM, THRESHOLD = 1 << 15, 4, -0.5
#: Words in a window, and the fewest words and most repeated words (per cent) of a document that passes.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS, SPACES = b"#*$%&|<>", b"\t\n\x0b\x0c\r "
STEP = 1 << 22
#: Ids of trusted documents that are broadcast at most (16 bytes each and their table); more are joined by a shuffle.
HELD_IDS = 1_000_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = value
        return value


WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words."""
    out = np.zeros(max(0, hashes.size - n + 1), np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + out.size]
    return out


def grams(raw: bytes) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams of bytes, some at a time; none of a text shorter than one."""
    for at in range(0, max(0, len(raw) - GRAM + 1), STEP):
        b = np.frombuffer(raw[at : at + STEP + GRAM - 1], np.uint8).astype(np.uint32)
        g = b[: b.size - GRAM + 1].copy()
        for i in range(1, GRAM):
            g = (g << np.uint32(8)) | b[i : b.size - GRAM + 1 + i]
        yield (g * np.uint32(2654435761)) >> np.uint32(17)


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    repeated = 0
    if n > WINDOW:
        w = windows(word_hashes(words), WINDOW)
        _, where, count = np.unique(w, return_inverse=True, return_counts=True)
        if (count > 1).any():
            twice = np.flatnonzero(count[where] > 1)
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, twice, 1)
            np.add.at(edges, twice + WINDOW, -1)
            repeated = int((np.cumsum(edges)[:n] > 0).sum())
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def log_ratios(df: DataFrame, trusted: DataFrame, held_ids: int = HELD_IDS) -> np.ndarray:
    """log p(trusted) - log p(raw) of each bucket, add-one smoothed; zeros if no document is trusted. df: doc_id, text.

    Up to held_ids trusted ids go to the texts; only beyond that are the texts shuffled to the ids. The result is the same.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct().withColumn("known", F.lit(True))
    if ids.count() <= held_ids:
        ids = F.broadcast(ids)
    else:
        ids = ids.hint("merge")
    flagged = df.join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("known", F.lit(False)).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for value, known in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                for g in grams(value.as_buffer().to_pybytes()):
                    c = np.bincount(g, minlength=BUCKETS)
                    counts[0] += c
                    if known:
                        counts[1] += c
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "raw", "trusted"])

    sums = flagged.mapInArrow(run, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    counts = np.ones((2, BUCKETS))
    for r in sums.collect():  # at most BUCKETS rows
        counts[0, r[0]] += r[1]
        counts[1, r[0]] += r[2]
    if counts[1].sum() == BUCKETS:
        return np.zeros(BUCKETS)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return logs[1] - logs[0]


def quality_rules(df: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio of every row.

    trusted: rows with the doc_id of trusted documents (repeated and null ids don't matter; none: all ratios are 0).
    Null and empty texts have no words and fail the base rules. Very long texts are taken whole, STEP bytes of n-grams at a time.
    Repeated rows each give theirs and count as often. An empty table gives none.
    """
    docs = id_text(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted))  # BUCKETS numbers
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text, raw = value.as_py(), value.as_buffer().to_pybytes()
                counts = base_counts(text, raw)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
                total = sum(float(ratios[g].sum()) for g in grams(raw))
                mean = total / max(1, len(raw) - GRAM + 1)
                rows.append((*counts, failed, not failed and mean >= threshold, mean))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(read(spark, sf_dir, "documents"), good)
