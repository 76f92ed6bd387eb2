"""Visibility rules as data: a row more changes the result and no code; scopes, absent columns, keeping, and children of hidden parents."""

from pulsefield.operators import visibility as V

IDS = {"person": {"people": ("id", "phone", "gone"), "visits": ("person",)}, "place": {"visits": ("place", "town")}, "odd": {"people": ("nothing",)}}
REFS = [V.Ref("visits", "person", "people", "id"), V.Ref("notes", "visit", "visits", "visit")]


def frames(spark):
    return {
        "people": spark.createDataFrame([(1, "+1 23"), (2, "123"), (3, None), (4, "9"), (4, "8")], "id int, phone string"),
        "visits": spark.createDataFrame([(10, 1, "A-1"), (11, 2, "b"), (12, 3, None), (13, 99, "a1"), (14, None, "b"), (15, 4, "c")], "visit int, person int, place string"),
        "notes": spark.createDataFrame([(i, v) for i, v in enumerate([10, 11, 12, 13, 14, 77, None])], "note int, visit int"),
    }


def left(spark, rules):
    df = spark.createDataFrame([(*r, True) if len(r) == 5 else r for r in rules], V.RULES)
    out = V.apply_rules(frames(spark), df, IDS, REFS, "s")
    return [sorted(r[0] for r in out[t].collect()) for t in ("people", "visits", "notes")]


ALL = [[1, 2, 3, 4, 4], [10, 11, 12, 13, 14, 15], list(range(7))]


def test_rules_are_data(spark):
    assert left(spark, []) == ALL
    assert left(spark, [("x", "person", None, "hide", "1"), ("s", "person", None, "hide", "1", False), ("s", "odd", None, "hide", "1"), ("s", "person", None, "hide", " - "), ("s", "unknown", None, "hide", "1")]) == ALL
    # By phone, in another spelling: both people with it, their visits, the notes of these.
    assert left(spark, [("s", "person", None, "hide", "1-2-3")]) == [[3, 4, 4], [12, 13, 14, 15], [2, 3, 4, 5, 6]]
    # In one table only, and then what belongs to its rows.
    assert left(spark, [("s", "person", "visits", "hide", "3")]) == [ALL[0], [10, 11, 13, 14, 15], [0, 1, 3, 4, 5, 6]]
    assert left(spark, [("S", "place", None, "hide", "A1")]) == [ALL[0], [11, 12, 14, 15], [1, 2, 4, 5, 6]]
    assert left(spark, [("s", "place", None, "keep_only", "b"), ("s", "place", None, "keep_only", "c"), ("s", "person", None, "hide", "2")]) == [[1, 3, 4, 4], [14, 15], [4, 5, 6]]
    # A parent of which a row is left isn't gone.
    assert left(spark, [("s", "person", "people", "hide", "9")]) == [[1, 2, 3, 4], ALL[1], ALL[2]]


def test_the_catalogue_says_what_is_there(spark):
    got = V.options(frames(spark), IDS, "s")
    assert ("s", "people", "person", "gone", False) in got and ("s", "visits", "place", "place", True) in got and len(got) == 7
