"""The randomness battery against a plain form, and its power and false discoveries on planted runs."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from pulsefield.llm import secrets
from tests.llm.helpers import frame

ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
WORDS = "the station under another morning people answer question river garden window letter number system market paper history family water nothing company second general country moment".split()


def plain_p(text, groups, classes, order):
    """The three tests by counting, combined."""
    size, n = len(order), len(text)
    chi = sum((sum(c in g for c in text) - n * len(g) / size) ** 2 / (n * len(g) / size) for g in groups)
    df = len(groups) - 1
    z = [((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))]
    label = [next(i for i, g in enumerate(classes) if c in g) for c in text]
    s2, s3 = (sum((len(g) / size) ** k for g in classes) for k in (2, 3))
    z.append((sum(a != b for a, b in zip(label, label[1:])) - (n - 1) * (1 - s2)) / math.sqrt((n - 1) * (s2 - s2 * s2) + 2 * (n - 2) * (s3 - s2 * s2)))
    x = [order.index(c) for c in text]
    mean = sum(x) / n
    spread = sum(v * v for v in x) / n - mean * mean
    z.append(((sum(a * b for a, b in zip(x, x[1:])) / (n - 1) - mean * mean) / spread + 1 / n) * math.sqrt(n))
    upper = lambda v: 0.5 * math.erfc(v / math.sqrt(2))
    ps = [upper(z[0]), 2 * upper(abs(z[1])), 2 * upper(abs(z[2]))]
    return 0.5 - math.atan(sum(math.tan((0.5 - min(p, 0.99)) * math.pi) for p in ps) / 3) / math.pi


def test_tests_equal_a_plain_form(spark):
    rng = random.Random(1)
    vowels, common, rare, other = "aeiou", "dhlnrst", "jkqvwxyz", "bcfgmp"
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    plain = {
        "hex": (["0123", "4567", "89", "abc", "def"], [digits, "abcdef"], digits + "abcdef"),
        "base36": ([vowels, common, rare, other, digits], [digits, letters], digits + letters),
        "base64": (["ABCDEFGHIJKLM", "NOPQRSTUVWXYZ", vowels, common, rare + other, digits, "+/"], [letters.upper(), letters, digits, "+/"], letters.upper() + letters + digits + "+/"),
    }
    runs = [(k, "".join(rng.choice(ALPHABETS[k].replace("/", "+")) for _ in range(n))) for k in plain for n in (20, 33, 64)]
    df = spark.createDataFrame(runs, "k string, run string")
    for name in plain:
        for r in df.where(F.col("k") == name).select("run", secrets.uniform_p(F.col("run"), F.col("k")).alias("p")).collect():
            groups, classes, order = plain[name]
            assert abs(r.p - plain_p(r.run, groups, classes, order)) < 1e-3, (name, r.run)


def test_power_and_false_discoveries(spark):
    rng = random.Random(2)
    rows = []

    def add(kind, make, times):
        for _ in range(times):
            rows.append((kind, make()))

    word = lambda: rng.choice(WORDS)
    for n in (32, 40, 64):
        for k, alphabet in ALPHABETS.items():
            add(f"secret {k}", lambda a=alphabet, n=n: "".join(rng.choice(a) for _ in range(n)), 0 if k == "hex" else 30)
        add("digits", lambda n=n: "".join(rng.choice("0123456789") for _ in range(n)), 60)
        add("path", lambda n=n: "".join(f"/{word()}" for _ in range(20))[:n], 60)
        add("words", lambda n=n: "".join(word() for _ in range(20))[:n], 60)
        add("names", lambda n=n: "_".join(rng.choice([word(), word().title(), str(rng.randrange(3000))]) for _ in range(20))[:n], 60)
    prose = [(5000 + i, " ".join(word() for _ in range(100)), "a") for i in range(300)]
    docs = frame(spark, [(i, f"see {t} there", "a") for i, (_, t) in enumerate(rows)] + prose)
    got = {r.doc_id: r.n for r in secrets.scan_secrets(docs).select("doc_id", F.size(F.filter("spans", lambda x: x["kind"] == "random")).alias("n")).collect()}
    hits, total = Counter(), Counter()
    for i, (kind, _) in enumerate(rows):
        hits[kind] += got[i] > 0
        total[kind] += 1
    found = sum(v for k, v in hits.items() if k.startswith("secret"))
    false = sum(hits.values()) - found
    assert false <= max(2, 0.02 * found), hits
    for kind in total:
        if kind.startswith("secret"):
            assert hits[kind] / total[kind] >= (0.95 if kind.endswith("64") else 0.8), (kind, hits)


def test_fit_without_words_is_the_default(spark):
    assert secrets.ordinary_fit(frame(spark, [(1, None, "a"), (2, "日本 語", "b")])) == secrets.DEFAULT_FIT
    assert secrets.ordinary_fit(frame(spark, [])) == secrets.DEFAULT_FIT


def test_ordinary_runs_come_from_every_document_and_its_whole_text(spark):
    rng = random.Random(12)
    short = lambda n: " ".join("".join(rng.choices("aeionrstldhc", k=rng.randrange(4, 9))) for _ in range(n))
    names = set(secrets.ENCODINGS)
    # One long text, many short ones: each is enough for a fit of its own.
    for rows in ([(1, short(60_000), "a")], [(i, short(45), "a") for i in range(1500)]):
        docs = frame(spark, rows)
        assert secrets.ordinary_runs(docs, "text").count() >= sum(len(t.split()) // 30 for _, t, _ in rows)
        fit = secrets.ordinary_fit(docs)
        assert {n for n in names if fit[n] != secrets.DEFAULT_FIT[n]} == names
        assert fit == secrets.ordinary_fit(docs.repartition(5))
