"""Operator 7's added spans: random tokens planted among identifiers, paths, names and prose in base64."""

import base64
import random
import string

import pytest

from geotally.llm import op7_secret_scans

WORDS = "the of river stone under light many people house went over small green when time market city old water and field road report final draft data table load user config value server test".split()


def corpus(seed=3, n=400):
    """Texts and their planted random tokens (text, start, end)."""
    r, texts, planted = random.Random(seed), [], []
    kinds = [string.ascii_letters + string.digits, "0123456789ABCDEF", string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits]
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(60, 120))]
        for _ in range(3):
            some = [r.choice(WORDS) for _ in range(r.randint(5, 9))]
            year = str(r.randint(1990, 2030))
            words.insert(r.randrange(len(words)), r.choice(["_".join([*some, year]), "/".join(["home", *some, year]), "".join(w.capitalize() for w in some) + year, "-".join([year, *some, "v2"])]))
        if i % 40 == 0:
            words.insert(5, base64.b64encode(" ".join(r.choice(WORDS) for _ in range(40)).encode()).decode().rstrip("="))
        if i % 4 == 0:
            token = "".join(r.choice(kinds[i // 4 % 4]) for _ in range(r.choice([28, 32, 40, 64, 100])))
            if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
                at = r.randrange(len(words))
                start = len(" ".join(words[:at])) + (at > 0)
                words.insert(at, token)
                planted.append((i, start, start + len(token)))
        texts.append(" ".join(words))
    return texts, planted


def test_planted_tokens_are_found_and_ordinary_text_is_not(spark):
    texts, planted = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("random")] for r in op7_secret_scans.secrets(df).collect()}
    found = {(i, a, b) for i, spans in got.items() for a, b in spans}
    hit = sum((i, a, b) in found for i, a, b in planted)
    wrong = len(found) - hit
    print("planted", len(planted), "found", hit, "false", wrong, [texts[i][a:b] for i, a, b in found - set(planted)][:5])
    assert hit >= 0.95 * len(planted) and wrong <= 0.02 * len(found)


def test_one_half_of_normal_tails(spark):
    import math

    from pyspark.sql import functions as F

    for z in (0.0, 0.5, -1.7, 3.0, 6.0):
        assert spark.range(1).select(op7_secret_scans.two_sided(F.lit(z))).first()[0] == pytest.approx(math.erfc(abs(z) / 2**0.5), abs=2e-7)


def test_randomness_of_random_and_of_ordinary_strings(spark):
    """p-values of the battery: even for random strings, small for words."""
    from pyspark.sql import functions as F

    r = random.Random(1)
    some = [("".join(r.choice(string.ascii_letters + string.digits) for _ in range(64)), 1) for _ in range(300)] + [("_".join(r.choice(WORDS) for _ in range(12)) + "_2", 0) for _ in range(100)]
    got = spark.createDataFrame(some, "t string, r int").select("r", op7_secret_scans.randomness(F.col("t")).alias("p")).collect()
    even = sorted(x["p"] for x in got if x["r"])
    assert all(abs(even[int(300 * q)] - q) < 0.1 for q in (0.1, 0.5, 0.9)) and max(x["p"] for x in got if not x["r"]) < 1e-3


def test_many_matches_are_placed_right(spark):
    import re

    from pyspark.sql import functions as F

    for n in (0, 1, 2, 9, 137):
        text = "é".join(["xy 12"] * n)
        got = spark.createDataFrame([(text,)], "t string").select(op7_secret_scans.located(F.col("t"), "[0-9]+").alias("f")).first()["f"]
        assert [(m["start"], m["end"], m["part"]) for m in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
