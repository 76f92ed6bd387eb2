"""Row-level privacy, visibility and correction rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefield.functions.text import campaign_alnum, email_loose, phone_last10


def allow_campaigns(df: DataFrame, allowed: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of which any campaign field is allowed; no allowed campaign at all lets every row pass."""
    keys = allowed.select(campaign_alnum(F.col(allowed.columns[0])).alias("_c")).where("_c <> ''").distinct()
    if keys.isEmpty():
        return df
    out, hit = df, F.lit(False)
    for i, f in enumerate(fields):
        side = keys.select(F.col("_c").alias(f"_c{i}"))
        out = out.join(side, campaign_alnum(F.col(f)) == F.col(f"_c{i}"), "left")
        hit = hit | F.col(f"_c{i}").isNotNull()
    return out.where(hit).select(*df.columns)


def person_visible(df: DataFrame, rules: DataFrame, row_id: str, campaign: str, email: str, phone: str) -> DataFrame:
    """Rows that no rule (email, phone, campaign) matches by email or phone, or whose campaign a matching rule allows."""
    r = rules.select(email_loose(F.col("email")).alias("r_email"), F.nullif(phone_last10(F.col("phone")), F.lit("")).alias("r_phone"), campaign_alnum(F.col("campaign")).alias("r_campaign"))
    p = df.select(row_id, campaign_alnum(F.col(campaign)).alias("p_campaign"), email_loose(F.col(email)).alias("p_email"), F.nullif(phone_last10(F.col(phone)), F.lit("")).alias("p_phone"))
    met = p.join(r, p.p_email == r.r_email).unionByName(p.join(r, p.p_phone == r.r_phone))
    ruled = met.groupBy(row_id).agg(F.max((F.col("p_campaign") != "") & (F.col("p_campaign") == F.col("r_campaign"))).alias("_ok"))
    return df.join(ruled, row_id, "left").where(F.coalesce("_ok", F.lit(True))).drop("_ok")


def visible(df: DataFrame, ids: DataFrame, key: str, mode: str) -> DataFrame:
    """Without the ids (hide) or with only them (keep_only)."""
    return df.join(ids.select(key).distinct(), key, "left_anti" if mode == "hide" else "left_semi")


def prune(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Dimension rows that some fact still refers to."""
    return dimension.join(facts.select(key).distinct(), key, "left_semi")


def keep_with_rep(df: DataFrame, rules: DataFrame, phone: str, rep: str) -> DataFrame:
    """Correction: a doctor named by a rule (phone, rep) stays with that rep only; a rule without a rep drops the phone."""
    r = rules.select(phone_last10(F.col("phone")).alias("_phone"), F.col("rep").alias("_rep"))
    joined = df.withColumn("_phone", phone_last10(F.col(phone)))
    bad = r.where("_rep is null").select("_phone").distinct()
    kept = r.where("_rep is not null").groupBy("_phone").agg(F.collect_set("_rep").alias("_reps"))
    out = joined.join(bad, "_phone", "left_anti").join(kept, "_phone", "left")
    return out.where(F.col("_reps").isNull() | F.array_contains("_reps", F.col(rep))).drop("_phone", "_reps")


def split_ids(c: Column) -> Column:
    """Several ids in one field."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[,/\s]+"), "")
