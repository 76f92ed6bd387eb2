"""Secret scan: fixed patterns, and a battery of randomness tests over long runs of key characters.

Fixed kinds: ``assign`` (a secret's name, a sign and a value), ``access`` (an access key id) and ``hex`` (a long hexadecimal
run). Kind ``random`` comes from the battery, over runs of at least ``least`` letters, digits and ``+/_-``, with ``=`` at the end:

1. A run's encoding is inferred: digits, hexadecimal of one case, letters of one case, base32, letters and digits of one case, or
   base64 (also its URL form). Digits alone are never random: ordinary numbers and ids look as uniform as secret ones.
2. Three tests of the hypothesis that the run was drawn uniformly from its alphabet: chi-squared over bins of the alphabet
   (vowels, common, rare and other letters, digits, signs), the number of runs of a character class, and the lag-1 correlation of
   alphabet places. The Cauchy combination, which holds under dependence, makes one probability of them.
3. The null of a discovery is an ordinary run. ``ordinary_fit`` makes ordinary runs of the corpus's own words (compounds, paths,
   identifiers, words with numbers) in each encoding at several lengths, from every whole document, and fits location and lower tail
   of y = sqrt(-ln p) of step 2 by length, from counts of y in bins. A run's probability is that of an ordinary run of its length looking so uniform; short runs
   can't reach small ones.
4. False discoveries are controlled over all runs of the table by the weighted Benjamini-Hochberg step-up at level
   ``rate``, a run weighing in proportion to its length up to ``full`` characters, with mean weight 1. The runs are
   counted in bins of log10(p / weight), each read at its upper edge, so the driver sees one number.

All of it is DataFrame expressions; texts are scanned whole, once for step 3 and once for the rest, and nothing but the bins is shuffled.
A document's words are dealt out to step 3 in pieces of PIECE_WORDS, the last one shorter; each makes one run, whose encoding and length its hash chooses.
Runs under test make no words for it, or secrets would widen the null that they are held against.

Edge cases: null and empty texts have no spans. Spans count code points, ends exclusive. Repeated rows are documents of their
own. Spans of different kinds may overlap. A corpus with too few Latin words for the fit uses DEFAULT_FIT. An empty table yields no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, release, table

#: Fixed patterns, by kind.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
BLOCK = 512
#: Characters that are apart at one time, however long a run is.
PIECE = 1024
BINS = 4000
VOWELS, COMMON, RARE, OTHER = "aeiou", "dhlnrst", "jkqvwxyz", "bcfgmp"
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Words that make one ordinary run, and bins of y in which such runs are counted, a unit.
PIECE_WORDS, Y_BINS = 30, 1000
#: Per encoding its alphabet, the bins of the chi-squared test and the character classes of the runs test, as symbols. All but base64
#: are tested in lower case, base64 with + and / for - and _.
ENCODINGS = {
    "hex": (DIGITS + "abcdef", ("0123", "4567", "89", "abc", "def"), (DIGITS, "abcdef")),
    "letters": (LOWER, (VOWELS, COMMON, RARE, OTHER), (VOWELS, COMMON + RARE + OTHER)),
    "base32": (LOWER + "234567", (VOWELS, COMMON, RARE, OTHER, "234567"), ("234567", LOWER)),
    "base36": (DIGITS + LOWER, (VOWELS, COMMON, RARE, OTHER, DIGITS), (DIGITS, LOWER)),
    "base64": (LOWER.upper() + LOWER + DIGITS + "+/", ("ABCDEFGHIJKLM", "NOPQRSTUVWXYZ", VOWELS, COMMON, RARE + OTHER, DIGITS, "+/"), (LOWER.upper(), LOWER, DIGITS, "+/")),
}
#: Lengths at which ordinary runs are made, and the longest at which y still grows with length.
LENGTHS = (20, 26, 34, 46, 64, 96)
#: Mean and lower-tail deviation of y as linear functions of sqrt(length): the fit on all documents of the sf0.1 table.
DEFAULT_FIT = {"hex": (0.402, 0.382, 0.345, -0.008), "letters": (0.15, 0.559, 0.343, 0.043), "base32": (0.433, 0.474, 0.343, 0.033), "base36": (0.387, 0.509, 0.32, 0.047), "base64": (1.01, 0.674, 0.83, 0.022)}


def running(lengths: Column) -> Column:
    """For each number the sum of those before it, in time linear in practice: blocks, then sums over blocks."""

    def before(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: before(F.transform(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, F.size(lengths)) - 1), lambda i: F.get(lengths, i))))
    return F.flatten(F.zip_with(blocks, before(F.transform(blocks, lambda b: b["sum"]))["all"], lambda b, base: F.transform(b["all"], lambda x: x + base)))


def _matches(rows: DataFrame, name: str, pattern: str, likely: Column | None = None) -> DataFrame:
    """Adds an array of (s, e, m) of the leftmost non-overlapping matches in column text."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = rows.withColumn("_m", found if likely is None else F.when(likely, found).otherwise(F.array().cast("array<string>")))
    # What lies between the matches has one piece more than there are matches.
    between = F.when(F.size("_m") > 0, F.split("text", pattern, -1))
    rows = rows.withColumn("_gap", F.transform(between, lambda p: F.length(p).cast("long")))
    steps = F.zip_with(F.slice("_gap", 1, F.size("_m")), F.col("_m"), lambda gap, m: gap + F.length(m))
    rows = rows.withColumn("_before", F.when(F.size("_m") > 0, running(steps)))
    started = F.transform(F.arrays_zip(F.col("_before").alias("b"), F.slice("_gap", 1, F.size("_m")).alias("g"), F.col("_m").alias("m")), lambda z: F.struct((z["b"] + z["g"]).alias("s"), (z["b"] + z["g"] + F.length(z["m"])).alias("e"), z["m"].alias("m")))
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    return rows.withColumn(name, F.when(F.size("_m") > 0, started).otherwise(empty)).drop("_m", "_gap", "_before")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normal_below(z: Column) -> Column:
    """The standard normal distribution function, by the logistic-free rational form of 26.2.17 in Abramowitz and Stegun."""

    def tail(z: Column, t: Column) -> Column:
        return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))

    return let(z, lambda z: let(1 / (1 + 0.2316419 * F.abs(z)), lambda t: F.when(z > 0, 1 - tail(z, t)).otherwise(tail(z, t))))


def _two_sided(z: Column) -> Column:
    return 2 * normal_below(-F.abs(z))


def _parameters() -> Column:
    """A constant map from an encoding to what its tests need."""

    def of(alphabet: str, bins: tuple, classes: tuple) -> Column:
        symbols, df = len(alphabet), len(bins) - 1
        # Changes of class in a uniform sequence: their mean, and the variance with the covariance of neighbouring places.
        s2, s3 = (sum((len(c) / symbols) ** power for c in classes) for power in (2, 3))
        numbers = {"df": float(df), "s2": s2, "s3": s3}
        arrays = {"bins": [f"[{x}]" for x in bins], "classes": [f"[{x}]+" for x in classes], "shares": [len(x) / symbols for x in bins]}
        return F.struct(F.lit(alphabet).alias("alphabet"), *[F.lit(v).alias(k) for k, v in numbers.items()], *[F.array(*map(F.lit, v)).alias(k) for k, v in arrays.items()])

    return F.create_map(*[x for name, parts in ENCODINGS.items() for x in (F.lit(name), of(*parts))])


def _serial(m: Column, alphabet: Column) -> Column:
    """Lag-1 correlation of the alphabet places of a run's characters, a piece of the run at a time."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("last"), zero.alias("n"), zero.alias("x"), zero.alias("xx"), zero.alias("xy"))

    def add(a: Column, x: Column) -> Column:
        return F.struct(x.alias("last"), (a["n"] + 1).alias("n"), (a["x"] + x).alias("x"), (a["xx"] + x * x).alias("xx"), (a["xy"] + a["last"] * x).alias("xy"))  # last is 0 at first

    def finish(a: Column) -> Column:
        spread = lambda mean: F.greatest(a["xx"] / a["n"] - mean * mean, F.lit(1e-9))
        return let(a["x"] / a["n"], lambda mean: F.least((a["xy"] / (a["n"] - 1) - mean * mean) / spread(mean), F.lit(1.0)))

    places = lambda piece: F.transform(F.split(piece, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return F.aggregate(F.regexp_extract_all(m, F.lit(".{1,%d}" % PIECE), F.lit(0)), start, lambda a, piece: F.aggregate(places(piece), a, add), finish)


def uniform_p(run: Column, encoding: Column) -> Column:
    """The combined probability of the three tests that a run of that encoding was drawn uniformly from its alphabet."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def measured(z: Column) -> Column:
        m, at = z["m"], z["at"]
        count = lambda c: F.regexp_count(m, c).cast("double")
        return F.struct(F.length(m).cast("double").alias("n"), at.alias("at"), F.transform(at["bins"], count).alias("k"), total(F.transform(at["classes"], count)).alias("runs"), _serial(m, at["alphabet"]).alias("serial"))

    def tested(x: Column) -> Column:
        n, df, s2, s3 = x["n"], x["at"]["df"], x["at"]["s2"], x["at"]["s3"]
        chi = total(F.zip_with(x["k"], x["at"]["shares"], lambda k, share: (k - n * share) * (k - n * share) / (n * share)))
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson and Hilferty
        z_runs = (x["runs"] - 1 - (n - 1) * (1 - s2)) / F.sqrt((n - 1) * (s2 - s2 * s2) + 2 * (n - 2) * (s3 - s2 * s2))
        z_serial = (x["serial"] + 1 / n) * F.sqrt(n)
        # The first is one-sided, the others two-sided.
        ps = F.transform(F.array(-z_chi, -F.abs(z_runs), -F.abs(z_serial)), lambda z, i: F.least(F.greatest(normal_below(z) * F.when(i == 0, 1).otherwise(2), F.lit(1e-30)), F.lit(0.99)))
        return F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.when(p < 1e-12, 1 / (p * math.pi)).otherwise(F.tan((0.5 - p) * math.pi)) / 3)

    bare = F.translate(F.regexp_replace(run, "=+$", ""), "-_", "+/")
    ready = F.struct(F.when(encoding == "base64", bare).otherwise(F.lower(bare)).alias("m"), F.element_at(_parameters(), encoding).alias("at"))
    # The Cauchy tail, in the form that stays exact for large values.
    return let(let(let(ready, measured), tested), lambda t: F.when(t > 1e6, 1 / (t * math.pi)).otherwise(0.5 - F.atan(t) / math.pi))


def _y(p: Column) -> Column:
    return F.sqrt(-F.log(F.greatest(p, F.lit(1e-30))))


def inferred(m: Column) -> Column:
    """The encoding of a run, null for digits alone."""
    hit = F.when(m.rlike("^[0-9]+=*$"), F.lit(None).cast("string")).when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(m.rlike("^([a-z]+|[A-Z]+)$"), "letters")
    return hit.when(m.rlike("^[A-Z2-7]+=*$"), "base32").when(m.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36").otherwise("base64")


def ordinary_runs(docs: DataFrame, text_col: str, least: int = 20) -> DataFrame:
    """encoding, n and run: ordinary runs made of the words of all documents outside the runs of ``least`` key characters, which are tested."""
    text = F.col(text_col).cast("string")
    plain = F.regexp_replace(text, "[A-Za-z0-9+/_-]{%d,}" % least, " ")  # the runs under test are not ordinary words of their own null
    found = docs.select(F.xxhash64(text).alias("tie"), F.filter(F.split(F.lower(plain), "[^a-z]+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    each_piece = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / PIECE_WORDS).cast("int")), lambda i: F.slice("w", i * PIECE_WORDS + 1, PIECE_WORDS))
    pieces = found.select("tie", F.posexplode(each_piece).alias("at", "w"))
    pieces = pieces.withColumn("h", F.xxhash64("tie", "at"))
    names = tuple(ENCODINGS)
    pick = lambda values, h: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))
    pieces = pieces.select("w", "h", pick(names, F.col("h")).alias("encoding"), pick(LENGTHS, F.shiftright("h", 8)).alias("n"))

    def number(h: Column, sizes: tuple) -> Column:
        return F.substr(F.abs(F.xxhash64(h)).cast("string"), F.lit(3), pick(sizes, F.shiftright(h, 20)))

    def each(make):
        return F.array_join(F.transform("w", lambda w, i: make(w, F.xxhash64(w, F.col("h"), i))), "")

    numbered = each(lambda w, h: F.when(F.pmod(h, F.lit(10)) < 3, F.concat(w, number(h, (1, 2, 4, 6, 8)))).otherwise(w))
    path = each(lambda w, h: F.concat(F.lit("/"), w))
    camel = each(lambda w, h: F.concat(F.initcap(w), F.when(F.pmod(h, F.lit(5)) == 0, number(h, (1, 2, 4))).otherwise("")))
    snake = each(lambda w, h: F.concat(pick(("_", "-"), h), F.when(F.pmod(h, F.lit(10)) < 7, w).otherwise(F.upper(w))))
    mixed = each(lambda w, h: F.concat(pick(("/", "_", "-"), F.shiftright(h, 4)), F.when(F.pmod(h, F.lit(4)) == 0, w).when(F.pmod(h, F.lit(4)) == 1, F.initcap(w)).when(F.pmod(h, F.lit(4)) == 2, F.upper(w)).otherwise(number(h, (2, 4, 8)))))
    style = F.pmod(F.shiftright("h", 16), F.lit(4))
    made = (
        F.when(F.col("encoding") == "letters", F.array_join("w", ""))
        .when(F.col("encoding") == "base36", numbered)
        .when(F.col("encoding") == "base32", F.translate(numbered, "0189", "2345"))
        .when(F.col("encoding") == "hex", each(lambda w, h: F.concat(number(h, (6, 8, 10, 12)), F.regexp_extract(w, "[a-f]", 0))))
        .otherwise(F.when(style == 0, path).when(style == 1, camel).when(style == 2, snake).otherwise(mixed))
    )
    return pieces.select("encoding", "n", F.substr(made, F.lit(1), F.col("n")).alias("run")).where(F.length("run") == F.col("n"))


def ordinary_fit(docs: DataFrame, text_col: str = "text", least: int = 20, least_runs: int = 30) -> dict[str, tuple[float, float, float, float]]:
    """Per encoding, intercept and slope over sqrt(length) of the mean and of the lower-tail deviation of y for ordinary runs.

    Both come from whole counts in bins, so that they don't depend on the order of the rows.
    """
    y = _y(uniform_p(F.col("run"), F.col("encoding")))
    runs = ordinary_runs(docs, text_col, least).select("encoding", "n", F.floor(y * Y_BINS).alias("bin"))
    counts = materialize(runs.groupBy("encoding", "n", "bin").agg(F.count("*").alias("k")), "ordinary")
    cell = Window.partitionBy("encoding", "n")
    summed = counts.select("*", F.sum("k").over(cell).alias("rows"), F.sum("k").over(cell.orderBy("bin")).alias("upto"))
    # The hundredth part of the runs ends within the first bin that reaches it.
    beyond = F.col("upto") - F.col("rows") * 0.01
    within = F.when((beyond >= 0) & (beyond < F.col("k")), F.col("bin") + 1 - beyond / F.col("k"))
    mean = F.sum((F.col("bin") * 2 + 1) * F.col("k")) / F.sum("k") / (2 * Y_BINS)
    cells = summed.groupBy("encoding", "n").agg(F.sum("k").alias("rows"), mean.alias("mean"), (F.min(within) / Y_BINS).alias("low")).collect()  # at most a row for each encoding and length
    release(counts)
    fit = dict(DEFAULT_FIT)
    for name in ENCODINGS:
        mine = [(math.sqrt(c.n), c.rows, c.mean, (c.mean - c.low) / 2.326) for c in cells if c.encoding == name and c.rows >= least_runs]
        if len(mine) > 2:
            fit[name] = (*_line([(x, w, mean) for x, w, mean, _ in mine]), *_line([(x, w, tail) for x, w, _, tail in mine]))
    return fit


def _line(points: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Intercept and slope of the weighted least-squares line through (x, weight, y)."""
    total = sum(w for _, w, _ in points)
    mx, my = (sum(p[1] * p[k] for p in points) / total for k in (0, 2))
    slope = sum(w * (x - mx) * (y - my) for x, w, y in points) / sum(w * (x - mx) ** 2 for x, w, _ in points)
    return my - slope * mx, slope


def battery(c: Column, fit: dict[str, tuple[float, float, float, float]] | None = None) -> Column:
    """The probability that an ordinary run of its length looks as uniform as c, a struct (s, e, m)."""
    fits = F.create_map(*[x for name, values in (fit or DEFAULT_FIT).items() for x in (F.lit(name), F.array(*map(F.lit, values)))])

    def against(z: Column) -> Column:
        expected, tail = (F.get(z["fit"], F.lit(i)) + F.get(z["fit"], F.lit(i + 1)) * z["root"] for i in (0, 2))
        return F.greatest(normal_below((_y(uniform_p(c["m"], z["kind"])) - expected) / F.greatest(tail, F.lit(0.2))), F.lit(1e-30))

    kind = inferred(c["m"])
    root = F.sqrt(F.least(F.length(c["m"]), F.lit(LENGTHS[-1])).cast("double"))
    ready = F.struct(kind.alias("kind"), root.alias("root"), F.element_at(fits, kind).alias("fit"))
    return let(ready, lambda z: F.when(z["kind"].isNull(), F.lit(1.0)).otherwise(against(z)))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, full: int = 64, rate: float = 0.01) -> DataFrame:
    """doc_id, base and spans, arrays of (s, kind, e, k): start, kind, end and the kind's place in KINDS.

    n_new counts the random spans that touch no base span.
    """
    fit = ordinary_fit(docs, text_col, least)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    rows = _matches(rows, "assign", ASSIGN, low.rlike("passw(?:or)?d|secret|token|api_?key"))
    rows = _matches(rows, "access", ACCESS, F.col("text").contains("AKIA"))
    rows = _matches(rows, "hex", HEX.replace("+", "{32,}"))  # the same as whole runs that are long enough
    rows = _matches(rows, "run", "[A-Za-z0-9+/_-]{%d,}={0,2}" % least)
    kept = rows.select(
        "doc_id",
        F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8).alias("assign"),
        F.filter("access", lambda x: F.length(x["m"]) >= 16).alias("access"),
        "hex",
        F.transform("run", lambda c: F.struct(c["s"], c["e"], F.length(c["m"]).alias("n"), battery(c, fit).alias("p"))).alias("run"),
    )
    plain = lambda name: F.transform(name, lambda x: F.struct(x["s"], x["e"])).alias(name)
    held = materialize(kept.select("doc_id", plain("assign"), plain("access"), plain("hex"), "run"), "secrets")

    runs = held.select(F.explode("run").alias("r")).select("r.n", "r.p")
    mean = runs.agg(F.avg(F.least(F.col("n"), F.lit(full)))).first()[0] or 1.0
    score = lambda n, p: F.floor(F.greatest(-F.log10(p * mean / F.least(n, F.lit(full))), F.lit(0.0)) * 100).cast("int")
    counts = runs.groupBy(F.least(score(F.col("n"), F.col("p")), F.lit(BINS)).alias("bin")).count().collect()  # at most BINS + 1 rows
    limit = step_up({r["bin"]: r["count"] for r in counts}, rate)
    random = F.filter("run", lambda c: score(c["n"], c["p"]) >= limit)

    def tagged(arrays: list[Column]) -> Column:
        def tag(a: Column, k: int) -> Column:
            return F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), F.lit(KINDS[k]).alias("kind"), x["e"].alias("e")))

        return F.sort_array(F.concat(*[tag(a, k) for k, a in enumerate(arrays)]))

    base = [F.col(k) for k in KINDS[:3]]
    new = F.filter(random, lambda x: ~F.exists(F.concat(*[F.transform(b, lambda y: F.struct(y["s"], y["e"])) for b in base]), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return held.select(F.size(new).cast("long").alias("n_new"), "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], tagged(base).alias("base"), tagged([*base, random]).alias("spans"))


def step_up(bins: dict[int, int], rate: float) -> int:
    """The lowest bin of 100 * -log10(p) that the Benjamini-Hochberg step-up at that rate still takes."""
    total, above, limit = sum(bins.values()), 0, BINS * 10
    for b in sorted(bins, reverse=True):
        above += bins[b]
        if 10 ** (-b / 100) <= rate * above / total:
            limit = b
    return limit


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_random"), "n_new")
