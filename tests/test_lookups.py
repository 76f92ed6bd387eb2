"""A value by steps against the rule written out, with keys that hit late, values that say nothing and steps without keys."""

import random

from pyspark.sql import functions as F

from pulsefield.operators.lookups import Step, by_steps


def test_first_key_of_a_step_and_first_step_with_a_valid_value(spark):
    rng = random.Random(4)
    steps = [Step("one", "x", ("a", "b")), Step("two", "y", ("b",)), Step("three", "x", ("c",))]
    key = lambda: rng.choice([None, "", *[f"k{i}" for i in range(9)]])
    rows = [(i, key(), key(), key()) for i in range(300)]
    index = {(kind, f"k{i}"): rng.choice(["north", "south", "none", None]) for kind in "xy" for i in range(9) if rng.random() < 0.6}
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    ix = spark.createDataFrame([(*k, v) for k, v in index.items()], "kind string, key string, st string")
    got = {r.id: (r.st, r.via) for r in by_steps(df, "id", steps, ix, "st", F.col("st") != "none", "?").collect()}
    for i, a, b, c in rows:
        want = ("?", "none")
        for s in steps:
            hit = next((index[s.kind, k] for k in ({"a": a, "b": b, "c": c}[n] for n in s.keys) if k and (s.kind, k) in index), None)
            if hit is not None and hit != "none":
                want = (hit, s.name)
                break
        assert got[i] == want, (i, a, b, c)
    assert by_steps(df.limit(0), "id", steps, ix, "st").count() == 0
    assert {r.via for r in by_steps(df, "id", steps, ix.limit(0), "st").collect()} == {"none"}
