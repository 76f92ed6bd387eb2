"""Lone lines, blank ones, and repeats told apart where one hash doesn't."""

import numpy as np

from pulsefield.llm import lines, substring
from tests.llm.helpers import frame


def test_lone_lines_go_and_lone_blanks_stay(spark):
    texts = ["one\n\ntwo\n \nthree", "four\n\ntwo\n \nfive", "six\n\nseven\n\ntwo", "eight\n\n\nnine", "ten\n\n\nnine"]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r.kept_text for r in lines.remove_repeated_lines(docs, min_lines=1, lone_blanks=False).collect()}
    # Blanks go with the runs they are in: "", "two" is one, and so are two blank lines.
    assert got == {0: texts[0], 1: "four\nfive", 2: "six\n\nseven", 3: texts[3], 4: "ten"}


def test_words_that_collide_in_every_base(spark):
    # The Thue-Morse word of 4,096 letters and its complement have equal polynomial hashes modulo 2**64.
    morse = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    other = morse.translate(str.maketrans("ab", "ba"))
    rest = [f"a{i}" for i in range(40)]
    docs = frame(spark, [(1, " ".join([morse, *rest[:34]]), "a"), (2, " ".join([other, *rest[:34]]), "a"), (3, " ".join(rest), "a"), (4, " ".join(rest[:36]), "a")])
    chunk = substring.Chunk([f"{morse} {other}"], 1)
    assert all(len(np.unique(chunk.hashes(k))) == 2 for k in (0, 1))
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(docs, window=35).collect()}
    assert got == {1: 0, 2: 0, 3: 36, 4: 36}


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("x", "a b"), (None, "c")], "doc_id string, text string")
    assert {r.doc_id for r in substring.remove_repeats(docs).collect()} == {"x", None}
