"""Repeated rows, ids with several texts, null ids, very long texts and clashing column names, for the operators and the pipeline."""

import hashlib
from array import array

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geotally.llm import op1_bpe, op2_exact_dedup, op3_quality_classifier, op4_packing, op5_quality_rules, op6_html_extraction, op7_secret_scans, op8_minhash, op9_token_counts, op10_substrings

LONG = "one two three four five six " * 50_000  # 1.4 million characters: beyond every step in the code
#: (doc_id, text): a repeated row, an id with two texts, null ids and texts, a long text.
ROWS = [(1, "the first text of some words " * 6), (1, "the first text of some words " * 6), (2, "a text"), (2, "another text that follows"), (None, "the first text of some words " * 6), (None, None), (3, None), (4, LONG), (5, "token=abcdef123456 " * 3)]
CLASH = "content_key string, own_id string, found string, dropped_id string, whole_html string, salt int, rep long, label int, band long, known boolean, key string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")}).cache()


def texts_of(rows, *names):
    return sorted(((r["doc_id"], *(r[n] for n in names)) for r in rows), key=repr)


def test_byte_bpe(docs):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op1_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = [(i, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(array("I", ids).tobytes()).hexdigest()) for i, t in ROWS]
    assert texts_of(op1_bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect(), "n_tokens", "ids_sha256") == sorted(want, key=repr)


def test_token_counts(docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS]
    assert texts_of(op9_token_counts.token_counts(docs, P.path("word_bpe_49k.json")).collect(), "n_tokens") == sorted(want, key=repr)


def test_exact_dedup(docs):
    got = op2_exact_dedup.exact_groups(docs).collect()
    assert texts_of(got, "keep_id", "group_size", "kept") == sorted([(1, 1, 3, True)] * 2 + [(None, 1, 3, False), (2, 2, 1, True), (2, 2, 1, True), (None, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True)], key=repr)
    kept = op2_exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 2, 3, 4, 5]


def test_packing(docs):
    out = op4_packing.packed(docs, P.path("byte_bpe_50k.json")).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in out) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) and b[1] + b[2] <= 2048 for a, b in zip([(None, 0, 0), *places], places))


def test_classifier_and_rules(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = op3_quality_classifier.classified(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert op3_quality_classifier.accepted(docs, labels).columns == docs.columns
    rules = op5_quality_rules.quality_rules(docs, labels.select("doc_id")).collect()
    assert texts_of(rules, "n_words") == sorted([(i, len((t or "").split())) for i, t in ROWS], key=repr)


def test_secrets(docs):
    got = op7_secret_scans.secrets(docs).collect()
    assert texts_of(got, "n_assign") == sorted([(i, 3 * (i == 5)) for i, _ in ROWS], key=repr)
    clean = op7_secret_scans.redacted(docs)
    assert clean.columns == docs.columns and next(r["text"] for r in clean.collect() if r["doc_id"] == 5) == "<secret> " * 3


def test_near_duplicates_and_repeats(docs):
    got = op8_minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and {r["component_id"] for r in got if r["doc_id"] == 1} == {1} and {r["component_id"] for r in got if r["doc_id"] == 2} == {2}
    assert op8_minhash.one_of_each(docs).columns == docs.columns
    gone = op10_substrings.without_repeats(docs).collect()
    assert texts_of(gone, "n_bytes", "n_removed") == sorted([(i, len((t or "").encode()), 0) for i, t in ROWS], key=repr)  # rows of one id don't repeat each other


def test_pages(spark):
    page = "<body><article>" + "".join(f"<p>Paragraph {i} of a long page about nothing much.</p>" for i in range(3000)) + "</article>"
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "y")], "page_id long, url string, html string, whole_html string")
    got = op6_html_extraction.extracted(df).collect()
    assert sorted(len(r["text"].split("\n\n")) for r in got) == [1, 3000, 3000] and [r["n_chars"] for r in got if r["page_id"] is None] == [0]


def test_pipeline_of_nothing_and_of_awkward_rows(spark, docs, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, d in (("none", docs.limit(0)), ("some", docs)):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(out) == (name == "some") and all(r["offset"] + r["length"] <= 2048 for r in out)
