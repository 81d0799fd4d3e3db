"""Operator 1: byte-level BPE encoding and decoding (see bpe.py for the method)."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm.bpe import PairCoder, PieceMemo, read_ranks
from geotally.llm.characters import explicit, of_tiktoken
from geotally.llm.common import id_text, read

#: What the tokenizers' split pattern means on texts of ASCII characters alone, where Python's faster re can find it.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Pieces held at a time of a text longer than this.
STEP = 200_000


@dataclass(frozen=True)
class Split:
    """A split pattern with its classes written out; short: whether ASCII_PATTERN does the same on ASCII texts."""

    pattern: str
    short: bool


def split_by(pattern: str, members: Callable[[str], str] = of_tiktoken) -> Split:
    """members: what a class of characters holds, as the library to be matched knows it."""
    import public_tokenizers

    return Split(explicit(pattern, members), pattern == public_tokenizers.PATTERN)


class TextCoder:
    """Ids of whole texts: split by the pattern, each piece by the coder, pieces kept in a bounded memo."""

    def __init__(self, coder: PairCoder, split: Split, special: dict[str, int] | None = None):
        """special: strings that stand for one id wherever they are in a text."""
        self.pattern, self.memo = re.compile(split.pattern), PieceMemo(coder)
        self.ascii = ASCII_PATTERN if split.short else self.pattern
        self.special = {k: array("I", [v]).tobytes() for k, v in (special or {}).items()}
        self.marks = re.compile("|".join(map(re.escape, self.special))) if special else None

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.marks is not None and self.marks.search(text):
            out, at = [], 0
            for m in self.marks.finditer(text):
                out += [self._plain(text[at : m.start()]), self.special[m.group()]]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        pattern, get = self.ascii if text.isascii() else self.pattern, self.memo.__getitem__
        if len(text) <= STEP:
            return b"".join(map(get, pattern.findall(text)))
        found, out = (m.group() for m in pattern.finditer(text)), []
        while step := b"".join(map(get, islice(found, STEP))):
            out.append(step)
        return b"".join(out)


def text_coder(shared, split: Split, special: dict[str, int] | None = None) -> TextCoder:
    """The TextCoder of a broadcast PairCoder; a Python worker makes it once and keeps it."""
    coder = shared.value
    if not hasattr(coder, "texts"):
        coder.texts = TextCoder(coder, split, special)
    return coder.texts


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every whole text; null and empty texts have no ids.

    ranks: path of a .tiktoken file on the driver. No shuffle: one pass over the input, a batch at a time.
    """
    shared, split = df.sparkSession.sparkContext.broadcast(PairCoder.from_ranks(read_ranks(ranks))), split_by(pattern)  # the vocabulary: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(shared, split)
        for batch in batches:
            ids = [array("i", coder.packed(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the text of ids; unknown ids are an error, bytes that aren't UTF-8 become U+FFFD; null ids give an empty text."""
    vocabulary = {v: k for k, v in read_ranks(ranks).items()}
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = shared.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(word, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts: 0 tokens and the digests of nothing. Repeated rows each give their row. Of texts over STEP characters
    that many pieces are held at a time, and their ids whole. An empty table gives none.
    """
    shared, split = df.sparkSession.sparkContext.broadcast(PairCoder.from_ranks(read_ranks(ranks))), split_by(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(shared, split)
        if not hasattr(coder, "bytes_of"):
            coder.bytes_of = [t.encode("latin-1") for t in shared.value.tokens].__getitem__
        sha, word = hashlib.sha256, coder.bytes_of
        for batch in batches:
            counts, ids, back = [], [], []
            for value in batch.column(1):
                packed = coder.packed(value.as_py())
                counts.append(len(packed) // 4)
                ids.append(sha(packed).hexdigest())
                back.append(sha(b"".join(map(word, array("I", packed)))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
