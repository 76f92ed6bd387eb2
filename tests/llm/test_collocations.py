"""Collocations against a plain form, with shards, blocks and ranges so small that every cut happens."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pulsefield.llm import collocations as C


def plain(rows, most=3, least=10, top=2000, contained=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    found = []
    for p, a in held.items():
        words = p[1:]
        if any(q[0] == p[0] and len(q) > len(p) and any(q[i : i + len(words)] == words for i in range(1, len(q))) and 100 * b >= contained * a for q, b in held.items()):
            continue
        cuts = [(1000000 * a * a // (f[(p[0], *words[:k])] * f[(p[0], *words[k:])]), k, f[(p[0], *words[:k])], f[(p[0], *words[k:])]) for k in range(1, len(words))]
        score, _, l, r = min(cuts)
        found.append((p[0], -score, -a, " ".join(words).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(seed=2, n=250):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Über", "a\x01", "a", "ſ", "😀"]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(["New York City", "hot hot hot", "of the", "OF THE"]) for _ in range(rng.randrange(2, 60))]
        out.append((rng.choice(["en", "en", "de", None]), "".join(w + rng.choice([" ", " ", "\t", ", ", ". ", "\n", "\x0b"]) for w in words)))
    return [*out, ("en", None), ("de", ""), (None, " \t\n"), ("und", "of the of the"), ("xx", "one two " * 9), ("en", "of the " * 3000), ("en", "of the")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", ["w"]) for r in rows], "lang string, text string, n int, phrase string, w array<string>").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 500, "block_nodes": 40, "range_nodes": 100}, {"shard_words": 90, "block_nodes": 7, "range_nodes": 5}])
def test_rows_equal_plain_form(spark, sizes):
    rows = texts()
    got = sorted(map(tuple, C.collocations(frame(spark, rows), **sizes).collect()))
    assert got == plain(rows) and len(got) > 20


@pytest.mark.parametrize("most, least, top, contained", [(2, 3, 5, 50), (4, 4, 2000, 80), (3, 2, 1, 0)])
def test_parameters(spark, most, least, top, contained):
    rows = texts(n=60)
    got = C.collocations(frame(spark, rows), most=most, least=least, top=top, contained=contained, shard_words=200, block_nodes=16, range_nodes=50)
    assert sorted(map(tuple, got.collect())) == plain(rows, most, least, top, contained)


def test_scores_are_exact_beyond_64_bits(spark):
    counts = [(10**15 + 7, 10**15 + 9, 10**15 + 11), (3, 7, 11), (10**16 - 1, 10**16 - 1, 10**16 - 1), (999_999_937, 10**12 + 39, 10**10 + 19)]
    df = spark.createDataFrame([(["a", "b"], a, [l], [r]) for a, l, r in counts], "w array<string>, f long, left array<long>, right array<long>")
    assert [r.c.score for r in df.selectExpr(f"{C._WEAKEST} c").collect()] == [1000000 * a * a // (l * r) for a, l, r in counts]


def test_blocks_round_trip_and_wide_keys():
    words = [b"a", b"b\x01", "é".encode()]
    keys, counts = np.array([[1, 0, 0], [1, 3, 0], [3, 1, 1]], np.int32), np.array([5, 1, 2**40])
    got_words, got_keys, got_counts = C.decoded(*C.encoded(words, keys, counts), most=3)
    assert [C._path(got_words, k) for k in got_keys] == [C._path(words, k) for k in keys] and got_counts.tolist() == counts.tolist()
    wide = np.array([[2**30, 5, 7], [1, 2**30, 0], [2**30, 5, 7]], np.int32)
    merged, sums = C.merged_nodes(wide, np.array([1, 2, 3]))
    assert merged.tolist() == [[1, 2**30, 0], [2**30, 5, 7]] and sums.tolist() == [2, 4]


def test_empty_table(spark):
    df = C.collocations(frame(spark, texts()).limit(0))
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and df.count() == 0
