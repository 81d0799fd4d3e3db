"""Operator 7: secret scans by patterns and a battery of randomness tests; DataFrame functions only.

Base spans come from three patterns. Beyond them, every long run of encoding characters that has letters and digits is a
candidate. Two questions are asked of each, both answered with p-values.

Is it a uniformly random string over its inferred encoding's alphabet? Three tests: chi-squared of the alphabet's eighths, runs above and
below the middle, and serial correlation, combined by Fisher's method. For each class of length, Benjamini-Hochberg at level LEVEL
names the candidates that are not random; they are no secrets.

Is it ordinary text? Ordinary text has the pairs of neighbouring characters that the words of the whole corpus have, with their spread
from word to word. A candidate whose pairs are far less likely than that gets a small p-value. For each class of length,
Benjamini-Hochberg at level LEVEL over these p-values, those of candidates named before counting as 1, makes the discoveries. So at
most LEVEL of what is reported in a class of length is expected to be ordinary text.

All of it is counted over all documents; what comes to the driver are tables of fixed size: pairs of characters and
histograms of p-values by class of length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotally.llm.common import id_text, passing, read, saved, unused

#: The patterns of the three base kinds, in the order of their listing.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: A candidate run, the level of both controls of false discoveries, and the classes' least lengths.
CANDIDATE, LEVEL, CLASSES = r"[A-Za-z0-9+/_-]{24,}={0,2}", 0.01, (24, 32, 48, 96)
#: The characters whose pairs are counted.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: p-values are kept as -log10 p in this many steps a unit, up to TOP steps.
STEPS, TOP = 20, 1000
#: Inferred encodings: what their strings match, and their alphabets in order.
ENCODINGS = (
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, part), in code points; part: the group asked for.

    The fold goes over blocks of matches, as many as a block has, so that long lists aren't copied once a match.
    """
    pattern = F.lit(pattern)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"), F.regexp_extract_all(text, pattern, F.lit(group)).alias("part"))
    empty = F.expr("cast(array() as array<struct<start:int, end:int, part:string>>)")
    none = F.expr("cast(array() as array<array<struct<start:int, end:int, part:string>>>)")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), m["part"].alias("part")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    def block(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def blocks(matches: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(matches))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(matches) - 1, width), lambda k: F.slice(matches, k + 1, width))

    matches = F.filter(found, lambda m: m["whole"].isNotNull())
    spans = let(matches, lambda x: F.aggregate(blocks(x), F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: F.flatten(acc["out"])))
    return F.when(F.rlike(text, pattern), spans).otherwise(empty)


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal Z, by a published rational approximation of erfc (error under 2e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.lit(1e-45), series * F.exp(-x * x))


def randomness(token: Column) -> Column:
    """p-value of "this string is uniformly random over its inferred alphabet"."""
    core = F.rtrim(token, F.lit("="))
    alphabet = F.coalesce(*(F.when(core.rlike(m), F.lit(a)) for m, a in ENCODINGS))

    def battery(v: Column, size: Column) -> Column:
        n = F.size(v).cast("double")
        eighth = F.transform(v, lambda a: F.floor(a * 8 / size).cast("int"))
        share = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.ceil((k + 1) * size / 8) - F.ceil(k * size / 8)) / size * n)
        chi = let(F.struct(eighth.alias("e"), share.alias("s")), lambda d: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, k: acc + F.pow(F.size(F.filter(d["e"], lambda e: e == k)) - F.get(d["s"], k), F.lit(2.0)) / F.get(d["s"], k)))
        uniform = (F.cbrt(chi / 7) - (1 - 2 / 63)) / (2 / 63) ** 0.5
        high = F.transform(v, lambda a: (a * 2 >= size).cast("int"))
        places = F.sequence(F.lit(1), F.size(v) - 1)
        runs = let(high, lambda h: F.struct((F.size(F.filter(places, lambda i: F.get(h, i) != F.get(h, i - 1))) + 1).cast("double").alias("r"), F.aggregate(h, F.lit(0), lambda a, b: a + b).cast("double").alias("up")))
        up = runs["up"]
        mean_runs = 2 * up * (n - up) / n + 1
        by_runs = F.when((up < 2) | (n - up < 2), F.lit(9.0)).otherwise((runs["r"] - mean_runs) / F.sqrt(F.greatest(F.lit(0.25), (mean_runs - 1) * (mean_runs - 2) / (n - 1))))
        mean = F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n
        serial = let(mean, lambda m: F.aggregate(places, F.lit(0.0), lambda a, i: a + (F.get(v, i) - m) * (F.get(v, i - 1) - m)) / F.greatest(F.lit(1e-9), F.aggregate(v, F.lit(0.0), lambda a, b: a + (b - m) * (b - m))))
        upper = F.when(uniform > 0, two_sided(uniform) / 2).otherwise(1 - two_sided(uniform) / 2)
        by_serial = serial * F.sqrt(n) + 1 / F.sqrt(n)
        logs = -(F.ln(F.greatest(F.lit(1e-45), upper)) + F.ln(two_sided(by_runs)) + F.ln(two_sided(by_serial)))  # Fisher: half its statistic
        return let(logs, lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return let(F.struct(alphabet.alias("a"), F.split(core, "").alias("c")), lambda d: let(F.transform(F.filter(d["c"], lambda c: c != ""), lambda c: F.call_function("locate", c, d["a"]) - 1), lambda v: battery(v, F.length(d["a"]).cast("double"))))


class Ordinary:
    """What pairs of neighbouring characters are like in the words of a corpus."""

    def __init__(self, df: DataFrame, text: Column):
        spark, width = df.sparkSession, len(SYMBOLS)
        with passing(spark):
            word = F.explode(F.split(text, " ", -1)).alias("w")  # other characters between words stand in no pair of symbols
            words = saved(df.select(word).where(F.length("w") > 1).groupBy("w").agg(F.count("*").alias("n")))
            letters = F.filter(F.split("w", ""), lambda c: c != "")
            two = F.explode(let(letters, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.get(c, i - 1), F.get(c, i))))).alias("two")
            counted = words.select(two, "n").groupBy("two").agg(F.sum("n").alias("n"))
            symbol = lambda i: F.substring(F.lit(SYMBOLS), i.cast("int") + 1, F.lit(1))
            every = spark.range(width * width).select("id", F.concat(symbol(F.floor(F.col("id") / width)), symbol(F.col("id") % width)).alias("two"))
            smooth = every.join(counted, "two", "left").select("id", "two", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
            score = F.ln(F.col("n") / F.sum("n").over(Window.partitionBy(F.substring("two", 1, 1))) * width)
            pairs = saved(smooth.select("id", "two", "n", score.alias("s")))
            mean = F.sum(F.col("n") * F.col("s")) / F.sum("n")
            self.mean, self.variance = pairs.agg(mean, F.sum(F.col("n") * F.col("s") * F.col("s")) / F.sum("n") - mean * mean).first()
            self.scores = [r["s"] for r in pairs.select("id", "s").orderBy("id").collect()]  # a number a pair of symbols
            # how much more words differ than independent pairs would
            likeness = words.select("n", let(self.places(F.col("w")), self.likeness).alias("x")).where("x.m > 0")
            excess = F.pow(F.col("x.s") - F.col("x.m") * self.mean, 2) / F.col("x.m")
            found = likeness.agg(F.sum(F.col("n") * excess) / F.sum("n")).first()[0]
            self.spread = max(self.variance, found or 0.0, 1e-6)

    @staticmethod
    def places(token: Column) -> Column:
        """The place of each character in SYMBOLS; -1: none."""
        return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(SYMBOLS)) - 1)

    def likeness(self, v: Column) -> Column:
        """(s, m): the sum of scores of the pairs of symbols among some places, and how many they are."""
        scores, width = F.split(F.lit(",".join(f"{s:.6f}" for s in self.scores)), ",").cast("array<double>"), len(SYMBOLS)
        pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v) - 1)), lambda i: F.when((F.get(v, i - 1) >= 0) & (F.get(v, i) >= 0), F.get(v, i - 1) * width + F.get(v, i))), lambda p: p.isNotNull())
        return let(pairs, lambda x: F.struct(F.aggregate(x, F.lit(0.0), lambda acc, p: acc + F.get(scores, p)).alias("s"), F.size(x).cast("double").alias("m")))

    def probability(self, token: Column) -> Column:
        """p-value of "this string has the pairs of ordinary text": small if they are less likely than its words' are."""
        def tail(x: Column) -> Column:
            return let((x["s"] - x["m"] * self.mean) / F.sqrt(x["m"] * self.spread), lambda z: F.when(z < 0, two_sided(z) / 2).otherwise(1 - two_sided(z) / 2))

        return let(let(self.places(F.rtrim(token, F.lit("="))), self.likeness), tail)


def scanned(df: DataFrame, text: Column, ordinary: Ordinary, name: str) -> DataFrame:
    """df with a column of this name: base spans and, for each candidate, its span and two p-values as steps. One pass."""
    def base(kind: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    def step(p: Column) -> Column:
        return F.least(F.lit(TOP), F.floor(-F.log10(p) * STEPS)).cast("int")

    assigned = F.filter(located(text, ASSIGN, 1), lambda m: F.length(m["part"]) >= 6)
    spans = F.array_sort(F.concat(base(0, assigned), base(1, located(text, ACCESS)), base(2, located(text, HEX))))
    likely = F.filter(located(text, CANDIDATE), lambda m: m["part"].rlike("[0-9]") & m["part"].rlike("[A-Za-z]"))
    kind = len(KINDS) - 1
    tested = F.transform(likely, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), step(randomness(m["part"])).alias("step"), step(ordinary.probability(m["part"])).alias("unlike")))
    return df.withColumn(name, F.struct(spans.alias("base"), tested.alias("tested")))


def length_class(span: Column) -> Column:
    return F.coalesce(*(F.when(span["end"] - span["start"] >= n, n) for n in reversed(CLASSES)), F.lit(CLASSES[0]))


def by_class(column: Column, least: dict[int, int]) -> Column:
    return F.coalesce(*(F.when(length_class(column) == c, s) for c, s in least.items()), F.lit(TOP + 1))


def discoveries(histogram: DataFrame, p: str, where: Column) -> dict[int, int]:
    """class -> the least step of p that Benjamini-Hochberg rejects. histogram: class, n and steps; what isn't in where has p-value 1."""
    up_to = Window.partitionBy("class").orderBy(F.desc(p))
    some = histogram.groupBy("class", p).agg(F.sum(F.when(where, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("all"))
    ranked = some.withColumn("k", F.sum("n").over(up_to)).withColumn("m", F.sum("all").over(Window.partitionBy("class")))
    rejected = ranked.where((F.col("n") > 0) & (F.pow(F.lit(10.0), -F.col(p) / STEPS) <= LEVEL * F.col("k") / F.col("m")))
    return {r["class"]: r[p] for r in rejected.groupBy("class").agg(F.min(p).alias(p)).collect()}  # at most a row a class


def base_and_all(scan: DataFrame, name: str) -> tuple[Column, Column]:
    """Base spans and all spans of scan (what scanned() gave, saved): arrays of (start, kind, end) in order."""
    one = scan.select(F.explode(f"{name}.tested").alias("t")).select(length_class(F.col("t")).alias("class"), "t.step", "t.unlike")
    histogram = saved(one.groupBy("class", "step", "unlike").agg(F.count("*").alias("n")))
    even = discoveries(histogram, "step", F.lit(True))
    regular = F.coalesce(*(F.when(F.col("class") == c, F.col("step") >= s) for c, s in even.items()), F.lit(False))
    strange = discoveries(histogram, "unlike", ~regular)
    found = F.col(name)

    def secret(t: Column) -> Column:
        return (t["step"] < by_class(t, even)) & (t["unlike"] >= by_class(t, strange))

    def inside(t: Column) -> Column:
        return F.exists(found["base"], lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"]))

    added = F.transform(F.filter(found["tested"], lambda t: secret(t) & ~inside(t)), lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    return found["base"], F.array_sort(F.concat(found["base"], added))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Null and empty texts have no spans. Repeated rows each give theirs, and count as often in the statistics. Very long texts are
    taken whole. An empty table gives none.
    """
    docs, text = id_text(df, id_col, text_col), F.col("text")
    scan = saved(scanned(docs, text, Ordinary(docs, text), "found").drop("text"))
    base, spans = base_and_all(scan, "found")

    def count(kind: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return scan.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs, all columns, each run of touching spans in the text replaced by mark. Texts without spans, null ones too, stay."""
    text, whole = F.col(text_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = unused(docs, "found")
    scan = saved(scanned(docs, whole, Ordinary(docs, whole), name))
    _, spans = base_and_all(scan, name)

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] > acc["at"]
        out = F.when(apart | (acc["out"] == ""), F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return scan.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))
