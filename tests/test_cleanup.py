"""The states of a cleanup: all of them reached, guards compared, and attempts that change nothing when run again."""

from pyspark.sql import functions as F

from pulsefield.operators import cleanup as C


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, guard string")


def test_manifest_takes_the_last_copy(spark):
    got = C.manifest([frame(spark, [("1", "a"), (" 2 ", "b"), ("", "x"), (None, "x"), ("3", "c"), ("3", "d")]), frame(spark, [("2", "z"), ("3", None)])])
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "a"), ("2", "z"), ("3", None)]


def test_all_states_and_reruns(spark):
    rows = frame(spark, [(str(i), "g") for i in range(5)] + [("5", None)])
    source = frame(spark, [("0", "g"), ("1", "other"), ("3", "g"), ("4", "g"), ("5", None), ("9", "g")])
    log, seen = spark.createDataFrame([], C.EVENTS), []

    def delete(refused):
        def run(df):
            seen.append(sorted(r.key for r in df.collect()))
            return df.withColumn("error", F.when(F.col("key").isin(*refused), "locked"))

        return run

    state = lambda: {r.key: (r.status, r.attempts) for r in C.states(rows, log).collect()}
    assert set(state().values()) == {("PENDING", 0)}
    log = log.unionByName(C.attempt(rows, log, source, delete(["3", "4"]), 1))
    assert state() == {"0": ("DELETED", 1), "1": ("GUARD_BLOCKED", 1), "2": ("ALREADY_ABSENT", 1), "3": ("FAILED", 1), "4": ("FAILED", 1), "5": ("DELETED", 1)}
    assert C.run_summary(C.states(rows, log)).first().status == "PARTIAL_SUCCESS"
    source = frame(spark, [("1", "g"), ("3", "g"), ("4", "changed")])
    log = log.unionByName(C.attempt(rows, log, source, delete([]), 2))
    assert state() == {"0": ("DELETED", 1), "1": ("GUARD_BLOCKED", 1), "2": ("ALREADY_ABSENT", 1), "3": ("DELETED", 2), "4": ("GUARD_BLOCKED", 2), "5": ("DELETED", 1)}
    assert C.attempt(rows, log, source, delete([]), 3).count() == 0
    assert seen[0] == ["0", "3", "4", "5"] and seen[1] == ["3"] and seen[-1] == []
    lone = frame(spark, [("1", "g")])
    blocked = C.attempt(lone, spark.createDataFrame([], C.EVENTS), frame(spark, [("1", "other")]), delete([]), 1, guarded=False)
    assert [r.status for r in blocked.collect()] == ["DELETED"]
    failed = C.attempt(lone, spark.createDataFrame([], C.EVENTS), lone, delete(["1"]), 1)
    assert C.run_summary(C.states(lone, failed)).first().status == "FAILED"
