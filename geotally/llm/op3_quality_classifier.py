"""Operator 3: document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of its own text and of its neighbours. Only documents carry labels, so
in training a document's label stands for each of its lines. A document's score is the mean of its lines' forward-backward
marginals of "good", weighted by length in bytes. The field is fitted on at most SAMPLE labelled documents (by hash of the id) of LINES lines in
all: of the sample, the documents of most lines are left out until the rest has no more than that; scoring is one pass over all documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm.common import id_text, read, saved
from geotally.llm.crf import Chains, Model, forward_backward

#: Labelled documents and lines used to fit at most; a score from here on predicts label 1; texts and bytes scored at a time.
SAMPLE, LINES, PREDICTS, TEXTS, BYTES = 4000, 400_000, 0.3, 2000, 16 << 20
#: Values of a feature.
VALUES = 8
#: Byte classes: 0 other, 1 lower case letter or part of a longer character, 2 upper case, 3 digit, 4 white space, 5 symbol, 6 bar, 7 exclamation mark, 8 sentence punctuation.
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(97, 123), *range(128, 256)]], CLASS[65:91], CLASS[48:58], CLASS[[*range(9, 14), 32]] = 1, 2, 3, 4
CLASS[list(b"#*$%&<>~^=+@\\{}[]_`")], CLASS[ord("|")], CLASS[ord("!")], CLASS[list(b".,;:?")] = 5, 6, 7, 8
CLASSES = 9
#: Upper ends of the values' ranges.
SHARES, LENGTHS = np.array([0.001, 0.01, 0.03, 0.08, 0.2, 0.5, 0.8]), np.array([1, 12, 40, 100, 250, 600, 1500])
WORD_LENGTHS, DISTINCT = np.array([2.5, 3.5, 4.5, 5.5, 7.0, 9.0, 14.0]), np.array([0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95])
FEATURES = 13


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values [line, feature] and bytes of each line of a text; an empty text is one empty line."""
    lines = raw.split(b"\n")
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = CLASS[np.frombuffer(raw, np.uint8)]
    owner = np.repeat(np.arange(len(lines)), size + (np.arange(len(lines)) < len(lines) - 1))
    counts = np.bincount(owner * CLASSES + kinds, minlength=len(lines) * CLASSES).reshape(-1, CLASSES)
    counts[:-1, 4] -= 1  # the newlines themselves
    seen: set[bytes] = set()
    distinct, again = np.ones(len(lines)), np.zeros(len(lines), np.uint8)
    for i, line in enumerate(lines):
        words = line.split()
        if words:
            distinct[i] = len(set(words)) / len(words)
            again[i] = 1 + (line in seen)
            seen.add(line)
    n = np.maximum(size, 1)
    word = (size - counts[:, 4]) / np.maximum(1, counts[:, 4] + 1)
    ends = np.fromiter((line[-1] if line else 10 for line in lines), np.int64, len(lines))
    x = np.empty((len(lines), FEATURES), np.uint8)
    for k, c in enumerate((0, 1, 2, 3, 5, 6, 7, 8)):
        x[:, k] = np.searchsorted(SHARES, counts[:, c] / n)
    x[:, 8] = np.searchsorted(LENGTHS, size)
    x[:, 9] = np.searchsorted(WORD_LENGTHS, word)
    x[:, 10] = np.searchsorted(DISTINCT, distinct)
    x[:, 11] = again
    x[:, 12] = np.minimum(CLASS[ends], VALUES - 1)
    return x, size


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id, quality. Learns only from rows whose crc32(doc_id) mod 5 isn't 0.

    Null ids and labels are left out; of contradicting labels of one id the lower counts. Without labels the field
    is neutral: 0.5 everywhere.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(v.as_buffer().to_pybytes())[0].tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "quality", "x"])

    found = saved(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary"))  # of at most sample documents
    text = F.xxhash64("doc_id", "x").alias("k")
    sizes = found.groupBy(text).agg(F.sum(F.octet_length("x") / FEATURES).cast("long").alias("n")).collect()  # at most sample texts; repeated rows count each
    within, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["n"], r["k"])):
        total += r["n"]
        if total > LINES:
            break
        within.append(r["k"])
    rows = found.select("doc_id", "quality", "x", text).where(F.col("k").isin(within)).collect() if within else []
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    model = Model(FEATURES, VALUES)
    if rows:
        x = [np.frombuffer(r["x"], np.uint8).reshape(-1, FEATURES) for r in rows]
        lengths = np.array([len(a) for a in x])
        model.fit(np.concatenate(x), np.repeat([int(r["quality"] > 0) for r in rows], lengths), Chains(lengths))
    return model


def batch_scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Length-weighted mean marginal of the lines of each text; null counts as empty."""
    out = []
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        most = int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, side="right"))
        n = max(1, min(TEXTS, most - at))
        found = [line_features(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in texts.slice(at, n)]
        at += n
        x, weight = np.concatenate([f[0] for f in found]), np.maximum(1, np.concatenate([f[1] for f in found]))
        chains = Chains(np.array([len(f[0]) for f in found]))
        good, _, _ = forward_backward(model.score(x, chains), model.moves, chains)
        first = np.cumsum(chains.lengths) - chains.lengths
        out.append(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first))
    return np.clip(np.concatenate(out), 0.0, 1.0) if out else np.zeros(0)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row. docs: doc_id, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch_scores(batch.column(1), shared.value))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classified(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null counts as the empty text, which gets the score of one empty line. Repeated rows get equal scores. A null doc_id
    is never held out. Very long texts are scored whole, in the memory of one task. An empty table gives none.
    """
    docs = id_text(df, id_col, text_col)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scores(docs, fit(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICTS).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the documents that the classifier rejects. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(id_text(docs, id_col, text_col), labels))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(batch.column(at), shared.value) >= PREDICTS))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
