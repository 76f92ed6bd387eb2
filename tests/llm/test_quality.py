"""The quality rules against plain forms, on odd texts and by hand."""

import re
from collections import Counter

import pytest

from pulsefield.llm import quality
from tests.llm.helpers import WORD, documents, frame


def plain(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = {i + k for i, w in enumerate(zip(found, found[1:], found[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_forms(spark, monkeypatch):
    rows = documents()
    rows += [(60, "a b c a b c a b", "a"), (61, "x x x x", "a"), (62, "x x x", "b"), (63, "a b c d a b c", "b"), (64, "\n\na\n \na\n\t\n", "b"), (65, "#1 &c <a|b> 😀😀 %", "b"), (66, "a b c x a b c y c x a", None)]
    rows += [(67, " ".join(f"q{i % 90}" for i in range(400)), "a")]
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for few in (4096, 3):  # both ways to find the places
        monkeypatch.setattr(quality, "FEW", few)
        got = quality.measured(frame(spark, rows)).collect()
        assert Counter((r.doc_id, *(r[c] for c in columns)) for r in got) == Counter((i, *plain(t)) for i, t, _ in rows)


def test_table_decides(spark):
    clean = " ".join(["The river and the town of stone"] + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} in" for i in range(40)])
    texts = {
        1: clean,
        2: "word " * 80,
        3: " ".join(f"{w}###" for w in clean.split()),
        4: " ".join(w.upper() + "!!" for w in clean.split()),
        5: " ".join(f"7{i}" for i in range(60)) + " the of",
        6: "\n".join(["same line of the text"] * 6 + [clean]),
        7: "\n".join(f"- {x} and the" for x in clean.split("in")),
        8: "\n".join(f"{x} and the…" for x in clean.split("in")),
        9: None,
        10: clean + " " + "y" * 3000,
    }
    docs = frame(spark, [(i, t, "a") for i, t in texts.items()])
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    names = {1: None, 2: "repeat_word_ratio", 3: "symbol_ratio", 4: "exclaim_ratio", 5: "alpha_word_ratio", 6: "dup_line_ratio", 7: "bullet_line_ratio", 8: "ellipsis_line_ratio", 9: "n_words", 10: "mean_word_chars"}
    for i, name in names.items():
        assert (got[i].kept, name is None or name in got[i].failed) == (name is None, True), (i, got[i])
    one = quality.judged(docs, (quality.Rule("n_words", most=10),)).where("kept").collect()
    assert [r.doc_id for r in one] == [9]
    assert quality.judged(docs, ()).where("not kept").count() == 0


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids_and_empty_tables(spark, kind):
    docs = spark.createDataFrame([("1", "a"), (None, None), ("1", "a")], "id string, body string").selectExpr(f"cast(id as {kind}) doc", "body text", "body w", "id _w")
    got = quality.judged(docs, id_col="doc").collect()
    assert Counter(str(r.doc_id) for r in got) == {"1": 2, "None": 1} and not any(r.kept for r in got)
    assert quality.judged(docs.limit(0), id_col="doc").count() == 0


def test_no_user_functions_and_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = quality.op11_quality_rules(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan
