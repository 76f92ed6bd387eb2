"""Small documents with gaps, copies, ties and odd cases, and brute-force forms of the operators."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, copy string, start int, text_key int, rid int, tie int, h int, fingerprint int, row int, draw int, severity int, w int, hashes int, k int"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=1):
    """(doc_id, text, source): nulls, empties, blanks, copies, near copies, a shared passage, repeated lines, long text, repeated rows."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 120)
    out = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, base, "a"), (5, base, "b"), (6, base + " tail", "b"), (None, base, "c"), (8, "Über ǅ 😀 " + base.upper(), None)]
    out += [(10 + i, f"{prose(rng, 30)} {passage} {prose(rng, 20)}", "a") for i in range(4)]
    out += [(20 + i, "\n".join([f"line {i}", "shared one", "shared two", "shared three", f"end {i}", "shared two", "shared three"]), "b") for i in range(3)]
    out += [(30, prose(rng, 6000, 5000), "c"), (31, "one", "c"), (32, "one two three", "c"), (33, "x " * 80, "a"), (33, "x " * 80, "a"), (33, "other text of one id", "a")]
    out += [(40 + i, prose(rng, rng.randrange(5, 80)), rng.choice(["a", "b", "c", None])) for i in range(30)]
    return out


def frame(spark, rows):
    """With extra columns whose names clash with those the operators use inside."""
    full = [(i, t, "en", s, len(t or ""), 7, "x", 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
