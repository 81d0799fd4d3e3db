"""Whitening, language identification and lexical search against brute force, held-out accuracy and on awkward tables."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geotally.llm import op11_whitening, op12_language, op13_search

CLASH = "x string, copies string, weight string, whitened string, n string, deviation string, rank string, score string, item string, term string, lang_pred string, first string, side string"


def clashing(df):
    return df.withColumns({c.split()[0]: F.lit(None).cast("string") for c in CLASH.split(", ") if c.split()[0] not in df.columns})


def vectors(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))


def brute_whitened(rows, weights, k=4):
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in e] for _, e in rows], np.int64)
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if weights == "counts" else np.ones_like(counts)
    n, s = int(w.sum()), w @ distinct
    c = distinct - s / n
    values, vecs = np.linalg.eigh((c * w[:, None]).T @ c / n)
    values, vecs = values[::-1], vecs.T[::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vecs[:k].T / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_equals_brute_force(spark, weights):
    r = np.random.default_rng(3)
    base = (r.normal(size=(60, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]).astype(np.float32)
    rows = [(i, base[min(int(r.integers(0, 120)), 59)].tolist()) for i in range(200)]  # half the rows hold one vector
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [math.nan] * 6), (903, [math.inf] * 6), (904, [1e30] * 6), (905, []), (906, [1.0, 2.0])]
    got = sorted(op11_whitening.whitened(vectors(spark, rows + bad), weights=weights, share=10).collect(), key=lambda v: v["vec_id"])
    n, deviation, white, explained = brute_whitened(rows, weights)
    assert [v["vec_id"] for v in got] == list(range(200)) and {v["n"] for v in got} == {n} and [v["deviation"] for v in got] == deviation.tolist()
    found = np.array([v["whitened"] for v in got])
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found - white * sign).max() < 1e-9 and np.allclose(got[0]["explained"], explained) and 0 <= got[0]["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    assert op11_whitening.whitened(vectors(spark, [(1, None)])).count() == 0
    got = op11_whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(got) == 3 and {(v["n"], v["deviation"], v["identity_error"], tuple(v["whitened"])) for v in got} == {(1, 0, None, (None, None))}
    huge = op11_whitening.whitened(vectors(spark, [(1, [3e16]), (2, [-3e16]), (3, [0.0])])).collect()
    assert {v["deviation"] for v in huge} == {None, 0} and all(v["identity_error"] < 1e-9 for v in huge)


def test_whitening_query(spark, tmp_path):
    r = np.random.default_rng(1)
    vectors(spark, [(i, r.normal(size=3).tolist()) for i in range(50)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_whitening.query(spark, str(tmp_path)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(got) == 150 and sorted(got.component.unique()) == [1, 2, 3]
    assert (got.groupby("component").explained.first().diff().dropna() <= 0).all() and abs(got.whitened.var(ddof=0) - 1) < 0.01


SOUNDS = {"de": "sch ei ung ver ich en er", "en": "th ing ed and tion es er", "fr": "eux ment é que ai tion en", "es": "ción ar os ñ que en do", "q1": "xu zq wa ku", "q2": "pl om bi ra"}


def sentence(lang, r, words=12):
    parts = SOUNDS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(words))


def language_rows():
    r = random.Random(7)
    rows = [(i, sentence(lang, r), lang) for i, lang in enumerate(r.choice(list(SOUNDS)) for _ in range(900))]
    return [(i, t, None if i % 10 == 0 else lang) for i, t, lang in rows], {i: lang for i, _, lang in rows}


def test_languages_of_held_out_texts(spark):
    rows, truth = language_rows()
    awkward = [(2000, None, "de"), (2001, "", "de"), (2002, "12 ²½ !?", "de"), (2003, sentence("fr", random.Random(1), 200_000), None), (None, sentence("de", random.Random(2)), "fr"), (5, rows[5][1], rows[5][2])]
    df = clashing(spark.createDataFrame(rows + awkward, "doc_id long, text string, lang string").repartition(3))
    got = op12_language.identified(df).collect()
    assert len(got) == 906 and all(0 <= v["score"] <= 1 for v in got)
    by = {v["doc_id"]: v for v in got}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i]["held_out"] == (i in set(held)) for i in truth)
    assert np.mean([by[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert [by[i]["lang_pred"] for i in (2000, 2001, 2002, 2003)] == ["und"] * 3 + ["fr"] and by[2000]["score"] == 0
    assert by[None]["lang_pred"] == "de" and not by[None]["held_out"]


def test_families_come_first(spark):
    rows, _ = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op12_language.fit(df)
    assert model.families == {"Germanic": ["de", "en"], "Romance": ["es", "fr"], "other": ["q1", "q2"]} and len(model.place) == 6
    one = op12_language.fit(df, families={"all": "de en es fr q1 q2"})
    assert len(one.place) == 15 and one.predict([sentence("es", random.Random(4))])[0] == ["es"]
    assert op12_language.fit(df, per_language=5).predict([sentence("q1", random.Random(4))])[0] == ["q1"]


def test_language_of_nothing(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {v["lang_pred"] for v in op12_language.identified(df).collect()} == {"und"} and op12_language.identified(df.limit(0)).count() == 0
    one = op12_language.identified(df.withColumn("lang", F.lit("xx"))).collect()
    assert sorted((v["lang_pred"], v["score"]) for v in one) == [("und", 0.0), ("xx", 1.0)]


def test_machine_separates_with_the_largest_margin():
    x, y = np.array([[0.0, 0], [0, 1], [2, 0], [2, 1]]), np.array([-1, -1, 1, 1])
    w = op12_language.machine(x, y, cost=1e4, rounds=5000, enough=1e-9)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).all() and abs(w[0] / (-w[2]) - 1) < 0.3 and abs(w[1]) < 0.05


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute_ranks(docs, items, top=10):
    words = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    some = [sum(w.values()) for _, w in words if w]
    df = Counter(t for _, w in words for t in w)
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            n = sum(w.values())
            m = 25 + 75 * n * len(some) // sum(some) if n else 0
            s = sum(math.floor(1000 * math.log((2 * len(some) + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOW)) if t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def search_tables():
    r = random.Random(11)
    words = ["the", "The", "naïve", "ÄÖ", "äö", "x1", "漢字", "a", "b", "cat", "scatter", "cat-alog", "é", "I", "ı", "under_score", "don't"]
    docs = [(i, r.choice([" ", "\n", ", "]).join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(120)]
    docs += [(3, docs[3][1]), (None, "cat cat x1"), (None, None), (500, None), (501, ""), (502, "-- !"), (503, "cat " * 300_000 + "dog"), (504, "dog"), (505, "dog"), (506, "a\x7fcat\x00b")]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 8)))) for i in range(25)] + [(1, "cat cat dog"), (1, "cat cat dog"), (None, "cat"), (77, None), (78, ""), (79, "nowhere"), (80, "dog DOG")]
    return docs, items


@pytest.mark.parametrize("block", [op13_search.BLOCK, 700])
def test_search_equals_brute_force(spark, block):
    docs, items = search_tables()
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    got = op13_search.ranked(df, clashing(spark.createDataFrame(items, "item_id long, text string")), block=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute_ranks(docs, items)


def test_search_of_nothing(spark):
    docs, items = search_tables()
    df, of = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert op13_search.ranked(df.limit(0), of).count() == 0 and op13_search.ranked(df, of.limit(0)).count() == 0


def test_search_sql_says_the_same(spark, tmp_path):
    docs, items = search_tables()
    docs, items = [d for d in docs if d[0] is not None and d[0] != 3], [i for i in items if i[0] is not None and i[0] != 1]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(c.sql(op13_search.SQL).fetchall()) == sorted(map(tuple, op13_search.query(spark, str(tmp_path)).collect()))
