"""Alias columns with all, some and no optional tables."""

from itertools import product

from pulsefield.operators.aliases import alias_columns
from pulsefield.plans.aliases import alias_sources, existing


def key(value):
    return "".join(c for c in str("" if value is None else value) if c.isascii() and c.isalnum()).lower()


REPS = [(1, 10, "F-1"), (2, 20, None), (3, None, "F 3"), (4, 40, " - "), (5, 10, "f1")]
ACCOUNTS = [(10, "A.b@x.org", "Ann"), (20, None, "bob"), (30, "c@x.org", ""), (40, "", None)]
LOCAL = [(100, "f1", None, None), (101, "f-1", "AB@xorg", "ann"), (102, None, "", "BOB"), (103, "", None, None), (101, "f-1", "AB@xorg", "ann")]
LEGACY = [(7, "F3", None, None, "99 1"), (8, None, None, "a.b@x.org", None), (9, None, None, None, None)]


def plain(accounts, local, legacy):
    out = set()
    for rep, user, field in REPS:
        mine = [a for a in accounts or [] if key(user) and key(a[0]) == key(user)] or [None]
        for a in mine:
            account = tuple(map(key, a)) if a else (key(user) if accounts is None else "", "", "")
            same = lambda x, y: key(x) != "" and key(x) == key(y)
            ours = [r for r in local or [] if same(field, r[1]) or same(account[1], r[2]) or same(account[2], r[3])] or [(None,) * 4]
            old = [r for r in legacy or [] if same(field, r[1]) or same(account[1], r[2]) or same(account[1], r[3])] or [(None,) * 5]
            out |= {(rep, *account, *map(key, x), *map(key, y)) for x, y in product(ours, old)}
    return sorted(out)


def test_alias_columns_whichever_tables_exist(spark):
    reps = spark.createDataFrame(REPS, "rep long, user_ref long, field_id string")
    tables = [
        spark.createDataFrame(ACCOUNTS, "id long, email string, username string"),
        spark.createDataFrame(LOCAL, "id long, field_id string, email string, username string"),
        spark.createDataFrame(LEGACY, "id long, field_id string, email string, gmail string, whatsapp string"),
    ]
    columns = set()
    for there in ((1, 1, 1), (0, 1, 1), (1, 0, 1), (0, 0, 0)):
        got = alias_columns(reps, alias_sources(*[t if x else None for t, x in zip(tables, there, strict=True)])).drop("user_ref", "field_id")
        want = plain(*[t if x else None for t, x in zip((ACCOUNTS, LOCAL, LEGACY), there, strict=True)])
        assert sorted(map(tuple, got.collect())) == want
        columns.add(tuple(got.columns))
    assert len(columns) == 1  # the same columns in every case


def test_missing_and_empty_tables(spark, tmp_path):
    assert existing(spark, str(tmp_path), "legacy_reps") is None
    reps = spark.createDataFrame([], "rep long, user_ref long, field_id string")
    accounts = spark.createDataFrame(ACCOUNTS, "id long, email string, username string")
    assert alias_columns(reps, alias_sources(accounts, None, None)).collect() == []
