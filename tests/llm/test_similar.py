"""Groups of similar texts and the near-duplicate stage against brute force."""

import random

import corpus_pipeline
from pulsefield.llm import similar, simhash
from tests.llm.helpers import documents, frame, prose


def shingles(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def groups(texts):
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def edited(rng, text, n):
    out = text.split()
    for i in range(n):
        out[(i + 1) * len(out) // (n + 1)] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    """Copies with 1 to 12 edits of 300 words: similarities from 0.98 to 0.67, between copies down to 0.42."""
    rng = random.Random(3)
    rows = documents()
    for k in range(12):
        base = prose(rng, 300, 5000)
        rows += [(1000 + 20 * k, base, "a")] + [(1001 + 20 * k + i, edited(rng, base, n), "b") for i, n in enumerate(rng.sample(range(1, 13), 5))]
    return rows


def test_groups_equal_brute_force(spark):
    texts = [t for _, t, _ in corpus()]
    got = dict(map(tuple, similar.similar_groups(spark.createDataFrame(list(enumerate(texts)), "rid long, text string")).collect()))
    want = groups(texts)
    assert [got[i] for i in range(len(texts))] == [want.index(g) for g in want]


def test_stage_drops_copies_of_four_fifths(spark):
    rows = corpus()
    kept = [r.text for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()]
    assert len(kept) == len(set(groups([t for _, t, _ in rows])))


def test_large_loose_group(spark):
    # Copies of one text, each too far from it but some near each other, by edits at the same places.
    rng = random.Random(4)
    base, rows = prose(rng, 200, 5000), []
    for k in range(60):
        loose = edited(rng, base, 11)
        rows += [loose, edited(rng, loose, 1), loose + " end"]
    texts = [base, *rows]
    got = dict(map(tuple, similar.similar_groups(spark.createDataFrame(list(enumerate(texts)), "rid long, text string")).collect()))
    want = groups(texts)
    assert [got[i] for i in range(len(texts))] == [want.index(g) for g in want]


def compared(spark, monkeypatch, texts):
    """The groups of texts and how many pairs were compared by their texts."""
    counts, exact = [], similar.similarities
    monkeypatch.setattr(similar, "similarities", lambda pairs, *a: counts.append(pairs.count()) or exact(pairs, *a))
    got = dict(map(tuple, similar.similar_groups(spark.createDataFrame(list(enumerate(texts)), "rid long, text string")).collect()))
    monkeypatch.undo()
    return got, sum(counts)


def scattered(rng, text, n):
    out = text.split()
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_comparisons_grow_with_the_texts(spark, monkeypatch):
    # Copies of one text with 14 edits each are in one another's buckets, but none is similar to another.
    rng, seen = random.Random(5), []
    base = prose(rng, 200, 5000)
    for size in (100, 200, 400):
        got, pairs = compared(spark, monkeypatch, [scattered(rng, base, 14) for _ in range(size)])
        assert len(set(got.values())) == size
        seen.append(pairs / size)
    assert max(seen) <= 16 and seen[2] <= 1.5 * seen[0]


def test_groups_inside_a_loose_group(spark, monkeypatch):
    # Versions of one text, far from it and each other, have many near copies; chains of edits leave the first version behind.
    rng = random.Random(6)
    base, texts = prose(rng, 200, 5000), []
    for _ in range(4):
        version = scattered(rng, base, 14)
        texts += [version, *(scattered(rng, version, rng.randrange(1, 5)) for _ in range(30))]
    step = base
    for _ in range(12):
        step = scattered(rng, step, 3)
        texts.append(step)
    texts += [" ".join(base.split()[:n]) for n in range(165, 200, 7)]
    rng.shuffle(texts)
    got, pairs = compared(spark, monkeypatch, texts)
    want = groups(texts)
    assert [got[i] for i in range(len(texts))] == [want.index(g) for g in want]
    assert pairs < 20 * len(texts)


def test_fingerprints_give_the_first_groups(spark, monkeypatch):
    # Without bands, only the index over fingerprints is left to join copies; what it proposes is checked by the exact similarity.
    rng, texts = random.Random(7), []
    for _ in range(6):
        base = prose(rng, 400, 5000)
        texts += [base, edited(rng, base, 1), base.upper() + " end"]
    texts += ["one two three four five six", "one two three four five seven", "one", "", "  "]
    monkeypatch.setattr(similar, "_bands", lambda least: [])
    got = dict(map(tuple, similar.similar_groups(spark.createDataFrame(list(enumerate(texts)), "rid long, text string")).collect()))
    want, bits = groups(texts), [simhash.simhash(t, 5) for t in texts]
    linked = [(i, j) for i in range(18) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 4]
    assert len(linked) >= 6 and all(got[i] == got[j] for i, j in linked)
    assert all(want[i] == want[j] for i in range(len(texts)) for j in range(i) if got[i] == got[j])
    assert got[21] == got[22] and len({got[i] for i in (18, 19, 20, 21)}) == 4
