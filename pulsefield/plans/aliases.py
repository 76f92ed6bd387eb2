"""Representatives with the keys that they have in other systems, whichever of these there are."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.operators.aliases import AliasSource, alias_columns
from pulsefield.plans.base import query
from pulsefield.session import table


def existing(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The table, or None if it doesn't exist."""
    try:
        return table(spark, sf_dir, name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def alias_sources(accounts: DataFrame | None, local: DataFrame | None, legacy: DataFrame | None) -> list[AliasSource]:
    """Accounts by user, local users by field id or account, old representatives by field id or an account's mail."""
    return [
        AliasSource(accounts, (("user_ref", "id"),), {"auth_user_id_key": "id", "auth_email_key": "email", "auth_username_key": "username"}, {"auth_user_id_key": "user_ref"}),
        AliasSource(
            local,
            (("field_id", "field_id"), ("auth_email_key", "email"), ("auth_username_key", "username")),
            {"local_user_id_key": "id", "local_field_id_key": "field_id", "local_email_key": "email", "local_username_key": "username"},
            {},
        ),
        AliasSource(
            legacy,
            (("field_id", "field_id"), ("auth_email_key", "email"), ("auth_email_key", "gmail")),
            {"legacy_rep_id_key": "id", "legacy_field_id_key": "field_id", "legacy_email_key": "email", "legacy_gmail_key": "gmail", "legacy_whatsapp_key": "whatsapp"},
            {},
        ),
    ]


KEYS = """reps AS (SELECT s_suppkey AS rep, s_suppkey * 3 AS user_ref, 'F-' || s_suppkey AS field_id FROM supplier),
  au AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN 'u.' || c_custkey || '@X.org' END AS email, c_name AS username FROM customer),
  lu AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'f ' || (p_partkey // 2) END AS field_id, CASE WHEN p_partkey % 2 = 0 THEN 'U' || (p_partkey // 2 * 3) || '@x.org' ELSE '' END AS email,
    CASE WHEN p_partkey % 5 = 0 THEN 'customer ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS username FROM part)"""


def _norm(c: str) -> str:
    return f"regexp_replace(lower(coalesce(CAST({c} AS VARCHAR), '')), '[^a-z0-9]', '', 'g')"


_SAME = " OR ".join(f"({_norm(a)} <> '' AND {_norm(a)} = {_norm(b)})" for a, b in (("lu.field_id", "reps.field_id"), ("lu.email", "au.email"), ("lu.username", "au.username")))
_NAMED = ", ".join(f"{_norm(c)} AS {name}_key" for name, c in (("auth_user_id", "au.id"), ("auth_email", "au.email"), ("auth_username", "au.username"), ("local_user_id", "lu.id"), ("local_field_id", "lu.field_id"), ("local_email", "lu.email"), ("local_username", "lu.username")))
_ABSENT = ", ".join(f"'' AS legacy_{name}_key" for name in ("rep_id", "field_id", "email", "gmail", "whatsapp"))


@query(f"WITH {KEYS} SELECT DISTINCT rep, {_NAMED}, {_ABSENT} FROM reps LEFT JOIN au ON au.id = reps.user_ref LEFT JOIN lu ON {_SAME}")
def rep_alias_columns(spark, sf_dir):
    # The given tables have no table of old representatives, so its columns are empty.
    c, p, half = F.col("c_custkey"), F.col("p_partkey"), F.expr("p_partkey div 2")
    reps = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rep"), (F.col("s_suppkey") * 3).alias("user_ref"), F.concat(F.lit("F-"), "s_suppkey").alias("field_id"))
    accounts = table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 4 != 0, F.concat(F.lit("u."), c, F.lit("@X.org"))).alias("email"), F.col("c_name").alias("username"))
    local = table(spark, sf_dir, "part").select(
        p.alias("id"),
        F.when(p % 3 == 0, F.concat(F.lit("f "), half)).alias("field_id"),
        F.when(p % 2 == 0, F.concat(F.lit("U"), half * 3, F.lit("@x.org"))).otherwise("").alias("email"),
        F.when(p % 5 == 0, F.concat(F.lit("customer "), F.lpad(p.cast("string"), 9, "0"))).alias("username"),
    )
    return alias_columns(reps, alias_sources(accounts, local, existing(spark, sf_dir, "legacy_reps"))).drop("user_ref", "field_id")
