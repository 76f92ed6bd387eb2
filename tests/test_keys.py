"""Surrogate keys that stay and references that are rewritten or reported; ids made of names; the reports of a run."""

import uuid
from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from pulsefield.functions.text import stable_uuid
from pulsefield.operators.keys import Entity, build, surrogate_keys
from pulsefield.plans import migration


def holder(spark, root):
    def hold(df, name):
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return hold


def test_keys_stay_and_grow_in_order(spark, tmp_path):
    ids = lambda xs: spark.createDataFrame([(x, 1) for x in xs], "k string, v int").repartition(5)
    first = surrogate_keys(ids(["d", "b", None, "b", *[f"x{i:03}" for i in range(300)]]), None, ["k"], holder(spark, f"{tmp_path}/1"), "r").drop("is_new")
    old = {r.k: r.key for r in first.collect()}
    assert old == {k: i + 1 for i, k in enumerate(sorted(["b", "d", *[f"x{i:03}" for i in range(300)]]))}
    second = surrogate_keys(ids(["a", "d", "c", "zz"]), first, ["k"], holder(spark, f"{tmp_path}/2"), "r")
    new = {r.k: (r.key, r.is_new) for r in second.collect()}
    assert {k: v for k, v in new.items() if v[1]} == {"a": (303, True), "c": (304, True), "zz": (305, True)}
    assert {k: v[0] for k, v in new.items() if not v[1]} == old
    assert surrogate_keys(ids([]), None, ["k"], holder(spark, f"{tmp_path}/3"), "r").count() == 0


def test_references_hold_or_are_reported(spark, tmp_path):
    parents = spark.createDataFrame([(2, "x"), (1, "x"), (1, "y"), (2, "x")], "a int, b string")
    children = spark.createDataFrame([("c1", 1, "y"), ("c2", 9, "x"), ("c3", None, "x"), ("c4", 2, "x")], "id string, pa int, pb string")
    graph = [Entity("child", children, ["id"], {"parent": ("parent", ["pa", "pb"])}), Entity("parent", parents, ["a", "b"])]
    out = build(graph, {}, holder(spark, tmp_path))
    assert {(r.a, r.b): r.key for r in out.keys["parent"].collect()} == {(1, "x"): 1, (1, "y"): 2, (2, "x"): 3}
    assert {r.id: (r.key, r.parent_key) for r in out.tables["child"].collect()} == {"c1": (1, 2), "c2": (2, None), "c3": (3, None), "c4": (4, 3)}
    assert [tuple(r) for r in out.unresolved.collect()] == [("child", "c2", "parent", "9|x")]
    assert out.tables["parent"].count() == 4
    with pytest.raises(CycleError):
        build([Entity("x", parents, ["a"], {"r": ("y", ["a"])}), Entity("y", parents, ["a"], {"r": ("x", ["a"])})], {}, holder(spark, tmp_path))


def test_ids_of_names_are_version_5(spark):
    namespace = uuid.UUID("8a2f1b96-bf9c-47e3-a2c6-3c4eb266a2e2")
    rows = [("1", "é"), (" a ", "None"), (None, "NULL"), ("", "x:y")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", stable_uuid("kind", F.col("a"), F.col("b")).alias("u")).collect()
    clean = lambda v: "" if v is None or v.strip().lower() in ("null", "none") else v.strip()
    assert all(r.u == uuid.uuid5(namespace, f"kind:{clean(r.a)}:{clean(r.b)}").hex for r in got)


def test_reports_say_what_is_missing(spark, tmp_path):
    src = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    table = migration.sourced(src.limit(1), "s", "t", "id")
    audit = migration.audit_rows({"t": src}, {"t": table})
    assert sorted(r.migration_status for r in audit.collect()) == ["AUDIT_PRESERVED_ONLY", "SEMANTIC_MAPPED"]
    strange = migration.sourced(spark.createDataFrame([(7, "z")], "id long, v string"), "s", "t", "id")
    failed = spark.createDataFrame([("t", "1", "r", "9")], "entity string, natural string, ref string, value string")
    checks = migration.validation({"t": src}, {"t": strange}, audit, failed)
    got = {r.check_name: r.status for r in checks.collect()}
    assert got == {"v1_row_audit_preservation": "PASS", "v2_table_row_count": "PASS", "semantic_v2_payload_source_match": "FAIL", "failed_record_count": "FAIL"}
    paths = migration.write_reports(str(tmp_path), audit, failed, checks)
    summary = [r.value for r in spark.read.text(paths["final_summary"]).collect()]
    assert "failed_record_count | all | source= | target=1 | FAIL" in summary and len(summary) == 4
    assert spark.read.option("header", True).csv(paths["failed_transfers"]).count() == 1
