"""Operator 12: language identification in two steps, families of languages first, then the languages within one.

A text is its hashed n-grams of bytes (of the lower-cased text, with one space for all that is neither letter nor part of a longer character),
square roots of their shares, so its length doesn't matter. A linear support vector machine a family, against all others, picks the
family; within it one machine for each pair of languages votes. All machines are fitted on the same bounded sample of
labelled texts, each as a group of one Spark job; predicting is one pass over all texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotally.llm.common import id_text, read, saved

#: Buckets of n-grams, longest n-gram, sample of labelled texts in all and of one language at most, languages learned at most (the most frequent).
BUCKETS, GRAM, SAMPLE, PER_LANGUAGE, LANGUAGES = 4096, 3, 4000, 500, 200
#: Texts and bytes handled at a time.
TEXTS, STEP = 256, 1 << 20
#: Families of languages by their codes of two letters. Languages that aren't here make up one more family.
FAMILIES = {
    "Romance": "ca es fr gl it la oc pt ro",
    "Germanic": "af da de en fy is lb nb nl nn no sv yi",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Baltic": "lt lv",
    "Celtic": "br cy ga gd",
    "Uralic": "et fi hu",
    "Turkic": "az kk ky tr tt ug uz",
    "Semitic": "am ar he mt",
    "Indo-Aryan": "bn gu hi mr ne pa si ur",
    "Iranian": "fa ku ps tg",
    "Dravidian": "kn ml ta te",
    "Austronesian": "id jv mg ms tl",
    "Sinitic": "zh",
    "Hellenic": "el",
    "Japonic": "ja",
    "Koreanic": "ko",
    "Tai": "lo th",
    "Austroasiatic": "km vi",
    "Bantu": "rw sw xh zu",
}
NO_LANGUAGE = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes as they count: letters and parts of longer characters themselves, all else a space.
PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263, 374761393)


def family_of(lang: str, families: dict[str, str]) -> str:
    return next((name for name, codes in families.items() if lang in codes.split()), "other")


def features(texts: list[str]) -> np.ndarray:
    """[text, bucket]: square roots of the shares of the text's n-grams of each length, at unit length; zeros for a text without letters."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in enumerate(texts):
        raw = b" " + b" ".join(text.lower().encode().translate(PLAIN).split()) + b" "
        if len(raw) == 2:
            continue
        total = np.zeros(BUCKETS)
        for at in range(0, len(raw), STEP):
            b = np.frombuffer(raw[at : at + STEP + GRAM - 1], np.uint8).astype(np.uint32)
            code = np.zeros(b.size, np.uint32)
            for n in range(1, GRAM + 1):
                if n > b.size:
                    break
                code = (code[: b.size - n + 1] << np.uint32(8)) | b[n - 1 :]
                total += np.bincount((code[:STEP] * np.uint32(MULTIPLIERS[n - 1])) >> np.uint32(20), minlength=BUCKETS)
        out[row] = np.sqrt(total / total.sum())
    return out


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60, enough: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with hinge loss, by dual coordinate descent; y: 1 or -1.

    Both sides weigh the same in all. Deterministic. Rows of one side only: a machine that always says so.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    sides = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    most = np.array([cost * len(y) / (2 * sides[int(s)]) for s in y])
    square, alpha, w = (x * x).sum(axis=1), np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(y)):
            g = y[i] * (w @ x[i]) - 1
            step = min(max(alpha[i] - g / square[i], 0.0), most[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                worst = max(worst, abs(step))
        if worst < enough * cost:
            break
    return w


class Model:
    """Machines of families and of pairs within them. families: name -> its languages, sorted."""

    def __init__(self, families: dict[str, list[str]], machines: dict[tuple[str, str], np.ndarray]):
        self.names = sorted(families)
        self.families = families
        keys = [*((f, "") for f in self.names if len(families) > 1), *(p for f in self.names for p in combinations(families[f], 2))]
        self.place = {k: i for i, k in enumerate(keys)}
        self.weights = np.array([machines[k] for k in keys]).reshape(len(keys), BUCKETS + 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: the product of how surely the family beats the next one and how surely the language its rivals on average, each a logistic of margins."""
        langs, scores = [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
        for at in range(0, len(texts) if self.names else 0, TEXTS):
            rows = [i for i, t in enumerate(texts[at : at + TEXTS], at) if t and LETTER.search(t)]
            x = features([texts[i] for i in rows])
            margins = x @ self.weights[:, :-1].T.astype(np.float32) + self.weights[:, -1].astype(np.float32)
            for i, margin in zip(rows, margins.astype(float), strict=True):
                langs[i], scores[i] = self.choose(margin)
        return langs, scores

    def choose(self, margin: np.ndarray) -> tuple[str, float]:
        if len(self.names) > 1:
            found = margin[[self.place[f, ""] for f in self.names]]
            best = int(np.argmax(found))
            family, sure = self.names[best], logistic(found[best] - np.delete(found, best).max())
        else:
            family, sure = self.names[0], 1.0
        langs = self.families[family]
        votes, sums, odds = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), {a: [] for a in langs}
        for a, b in combinations(langs, 2):
            m = margin[self.place[a, b]]
            votes[a if m >= 0 else b] += 1
            for lang, gain in ((a, m), (b, -m)):
                sums[lang] += gain
                odds[lang].append(logistic(gain))
        lang = min(langs, key=lambda n: (-votes[n], -sums[n], n))
        return lang, float(sure * (np.mean(odds[lang]) if odds[lang] else 1.0))


def logistic(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(margin, -30, 30))))


def sample(docs: DataFrame, per_language: int, most: int, languages: int) -> DataFrame:
    """doc_id, text, lang: of each of the most frequent languages up to min(per_language, most / languages) texts, those with the least hash of the id.

    A plain filter on the hash leaves about twice as many; only those are put in order, so no language lands in one task whole.
    """
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(languages)
    found = counts.collect()  # at most so many languages
    each = max(1, min(per_language, most // max(1, len(found))))
    part = F.create_map(*(F.lit(v) for r in found for v in (r["lang"], min(1.0, (2 * each + 50) / r["rows"])))) if found else F.lit(None).cast("map<string,double>")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = docs.where(place < F.coalesce(part[F.col("lang")], F.lit(0.0)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    return few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("doc_id", "text", "lang")


def fit(docs: DataFrame, families: dict[str, str] | None = None, per_language: int = PER_LANGUAGE, most: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """docs: doc_id, text, lang. Learns only from rows with a lang and an id whose crc32 mod 4 isn't 2; without any the model knows no language."""
    usable = docs.where(F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                x = [row.tobytes() for row in features(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    found = saved(sample(usable, per_language, most, languages).mapInArrow(featured, "doc_id long, lang string, x binary"))  # at most `most` rows
    names = sorted(r[0] for r in found.select("lang").distinct().collect())
    groups: dict[str, list[str]] = {}
    for lang in names:
        groups.setdefault(family_of(lang, FAMILIES if families is None else families), []).append(lang)
    plan = [(f, "", lang, 1 if lang in groups[f] else -1) for f in groups if len(groups) > 1 for lang in names]
    plan += [(a, b, lang, side) for langs in groups.values() for a, b in combinations(langs, 2) for lang, side in ((a, 1), (b, -1))]
    if not plan:
        return Model(groups, {})

    def trained(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("x", "ascending")])
        x = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in table["x"]])
        w = machine(x, table["side"].to_numpy())
        return pa.table({"first": [table["first"][0].as_py()], "second": [table["second"][0].as_py()], "w": pa.array([w.tobytes()], pa.binary())})

    spark = docs.sparkSession
    tasks = F.broadcast(spark.createDataFrame(plan, "first string, second string, lang string, side int"))
    machines = found.join(tasks, "lang").select("first", "second", "doc_id", "side", "x").groupBy("first", "second").applyInArrow(trained, "first string, second string, w binary")
    return Model(groups, {(r["first"], r["second"]): np.frombuffer(r["w"]) for r in machines.collect()})  # 32 KB a family and pair


def identified(df: DataFrame, families: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    families: name -> codes of its languages, separated by spaces. Null and empty texts and texts without a letter
    are "und" with score 0, and so is everything if no row teaches a language. With a single learned language it is predicted with score 1. Rows
    with a null id teach nothing and aren't held out. Ties in votes go to the larger sum of margins, then to the first code.
    Repeated rows get the same result. Very long texts count whole, STEP bytes of n-grams at a time. An empty table gives none.
    """
    docs = id_text(df, id_col, text_col).select("doc_id", "text")
    model = fit(df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")), families, **bounds)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 32 KB a family and pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held.alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(read(spark, sf_dir, "documents"))
