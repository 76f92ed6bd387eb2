"""Scalar functions over text, dates and scores. All are column expressions, null-safe, and stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "nothing", in lower case.
NULL_WORDS = ("", "null", "none", "nil", "n/a", "na")
#: The clinic sources use "na" as a value.
CLINIC_NULL_WORDS = ("", "null", "none", "nil", "n/a")
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")
#: Course states by their spellings.
COURSE_STATES = {
    "started": "In Progress",
    "in progress": "In Progress",
    "inprogress": "In Progress",
    "incomplete": "In Progress",
    "complete": "Completed",
    "completed": "Completed",
    "course completed": "Completed",
    "pending": "Not Started",
    "not started": "Not Started",
    "notstarted": "Not Started",
}


def trimmed(c: Column) -> Column:
    """Text without outer blanks, null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def clean_text(c: Column, words: tuple[str, ...] = NULL_WORDS) -> Column:
    """Trimmed text, null for the words that mean nothing."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*words), t)


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[clean_text(c) for c in columns])


def as_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(c.cast("string")).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def as_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(float(default)))


def parse_bool(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def phone_local(c: Column) -> Column:
    """Digits; of longer numbers that start with country code 91 the last ten."""
    d = digits(clean_text(c))
    return F.nullif(F.when((F.length(d) > 10) & d.startswith("91"), F.right(d, F.lit(10))).otherwise(d), F.lit(""))


def phone_international(c: Column, least: int = 7) -> Column:
    """Digits, with a leading plus kept; null if there are too few."""
    t = trimmed(c)
    return F.when(F.length(digits(t)) >= least, F.concat(F.when(t.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits(t)))


def phone_last10(c: Column) -> Column:
    d = digits(F.coalesce(clean_text(c, ("", "null", "none")), F.lit("")))
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10))).otherwise(d)


def email_loose(c: Column) -> Column:
    t = clean_text(c)
    return F.when(t.contains("@"), F.lower(t))


def email_strict(c: Column) -> Column:
    """Lower case; a local part and a domain with a dot."""
    return F.when(trimmed(c).rlike(r"^[^@]+@.*\..*$"), F.lower(trimmed(c)))


def identifier(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]", ""), F.lit(""))


def campaign_dashless(c: Column) -> Column:
    return F.replace(F.lower(clean_text(c)), F.lit("-"), F.lit(""))


def campaign_alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(clean_text(c, ("", "null", "none")), F.lit(""))), "[^a-z0-9]+", "")


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(clean_text(c), F.lit("unknown"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def key_variants(c: Column) -> Column:
    """Spellings under which an id is looked up: as it is, compact, with underscores, with dashes, letters and digits only."""
    t = F.lower(clean_text(c))
    return F.array_distinct(F.array(t, F.regexp_replace(t, "[-_ ]", ""), F.regexp_replace(t, "[- ]", "_"), F.regexp_replace(t, "[_ ]", "-"), F.regexp_replace(t, "[^a-z0-9]", "")))


#: The formats that sources use, then the forms of ISO 8601: dates by day, week or without signs, times of hours, minutes or seconds.
DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
ISO_FORMATS = tuple(f"{d}{t}" for d in ("yyyy-MM-dd", "yyyyMMdd") for t in (" HH:mm:ss.SSS", " HH:mm:ss.SSSXXX", " HH:mm", " HH:mmXXX", " HH", " HHXXX", " HHmmss", " HHmm", "")) + ("yyyyMMdd HH:mm:ss", "yyyyMMdd HH:mm:ssXXX")


def parse_datetime(c: Column, day_first: bool = True) -> Column:
    """The formats sources use, tried in turn, then other forms of ISO 8601; null if none fits. day_first: dd-MM-yyyy as well."""
    t = F.replace(F.replace(clean_text(c), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("+00:00"))
    known = DATETIME_FORMATS + (("dd-MM-yyyy",) if day_first else ())
    tried = lambda formats: [F.try_to_timestamp(t, F.lit(f)) for f in formats]
    return F.coalesce(*tried(known), F.when(t.rlike("^[0-9]{4}-?[0-9]{2}-?[0-9]{2}"), F.coalesce(*tried(ISO_FORMATS))))


def iso_date(c: Column) -> Column:
    return F.date_format(parse_datetime(c), "yyyy-MM-dd")


def iso_datetime(c: Column) -> Column:
    t = parse_datetime(c)
    whole = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.unix_micros(t) % 1_000_000 == 0, whole).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def joined_hash(kind: str, separator: str, *parts: Column) -> Column:
    """md5 or sha256 of the non-empty parts."""
    text = F.concat_ws(separator, *[trimmed(p) for p in parts])
    return F.md5(text) if kind == "md5" else F.sha2(text, 256)


def row_hash(*columns: Column) -> Column:
    """A fingerprint of a row's values in which null differs from empty text."""
    return F.md5(F.to_json(F.array(*[c.cast("string") for c in columns])))


def course_state(c: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(clean_text(c, CLINIC_NULL_WORDS), "[_-]", " ")))
    spelled = F.create_map(*[F.lit(x) for pair in COURSE_STATES.items() for x in pair])
    return F.when(t.isNotNull(), F.try_element_at(spelled, t))


def metric_flags(event: Column, action: Column) -> Column:
    """A struct of what a metric event means: reminder, patient_education, doctor_education."""
    e, a = (F.lower(F.coalesce(clean_text(c, CLINIC_NULL_WORDS), F.lit(""))) for c in (event, action))
    return F.struct((a == "reminder_sent").alias("reminder"), (a == "patient_edu").alias("patient_education"), ((e == "doctor_edu_click") | (a == "doctor_video_click")).alias("doctor_education"))


def json_fields(c: Column) -> Column:
    """A JSON object as a map of texts; an empty map if it isn't one."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def picked(payload: Column, row_value: Column, *names: str) -> Column:
    """The first non-empty of the payload's fields and then the row's own."""
    return first_non_empty(*[F.try_element_at(payload, F.lit(n)) for n in names], row_value)


def follow_ups(explicit: list[Column], first: Column, every: Column, times: Column, unit: Column) -> Column:
    """Dates of follow-ups, ascending: the explicit ones, then every so many days from the first, a date once.

    An array of structs (due, sequence, method); explicit dates win over derived ones.
    """
    given = F.array(*[F.struct(d.alias("due"), F.lit(i).alias("sequence"), F.lit("explicit").alias("method")) for i, d in enumerate(explicit, 1)])
    given = F.filter(given, lambda x: x["due"].isNotNull())
    usable = first.isNotNull() & (times > 0) & (every > 0) & F.lower(F.coalesce(clean_text(unit), F.lit(""))).isin("d", "day", "days")
    steps = F.when(usable, F.sequence(F.lit(1), F.greatest(times.cast("int"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    derived = F.transform(steps, lambda i: F.struct(F.date_add(first, ((i - 1) * every).cast("int")).alias("due"), i.alias("sequence"), F.lit("derived").alias("method")))
    derived = F.filter(derived, lambda x: ~F.exists(given, lambda g: g["due"] == x["due"]))
    every_one = F.array_sort(F.concat(given, derived))
    return F.filter(every_one, lambda x, i: (i == 0) | (F.get(every_one, i - 1)["due"] != x["due"]))


def display_name(full: Column, first: Column, last: Column, *contacts: Column) -> Column:
    name = F.nullif(F.trim(F.concat_ws(" ", clean_text(first), clean_text(last))), F.lit(""))
    return F.coalesce(clean_text(full), name, *[clean_text(c) for c in contacts], F.lit("Unknown Doctor"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) != 0, part.cast("double") / whole * 100.0).otherwise(F.lit(0.0))


def capped_percent(part: Column, whole: Column) -> Column:
    return F.least(percent(part, whole), F.lit(100.0))


def engagement_health(reached: Column, opened: Column, consumed: Column, base: Column) -> Column:
    """The mean of three capped steps; for a week the base is a quarter of the doctors."""
    return (capped_percent(reached, base) + capped_percent(opened, reached) + capped_percent(consumed, opened)) / 3.0


def sharing_health(enrolled: Column, sharing: Column, shares: Column, played: Column, half: Column, whole: Column) -> Column:
    """The mean of activation, play, half-way and completion rates; 0 without enrolments."""
    parts = percent(sharing, enrolled) + percent(played, shares) + percent(half, shares) + percent(whole, shares)
    return F.when(F.coalesce(enrolled, F.lit(0)) == 0, F.lit(0.0)).otherwise(parts / 4.0)


def health_band(score: Column, red_includes_40: bool = True) -> Column:
    red = score <= 40 if red_includes_40 else F.coalesce(score, F.lit(0.0)) < 40
    return F.when(red, F.lit("red")).when(score < 60, F.lit("yellow")).otherwise(F.lit("green"))


def saturday(d: Column) -> Column:
    """The Saturday that ends the week of a date, Sunday to Saturday."""
    return F.next_day(F.date_sub(d, 1), "SAT")


def monday(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def anchored_week(d: Column, start: Column) -> Column:
    """The number, from 1, of the seven-day week after a start date."""
    return (F.floor(F.datediff(d, start) / 7) + 1).cast("int")


def format_number(c: Column) -> Column:
    """Grouped thousands; one decimal unless the number is whole. Text that is no number counts as 0."""
    n = as_float(c)
    return F.when(n == F.floor(n), F.format_number(n, 0)).otherwise(F.format_number(n, 1))


def format_percent(c: Column) -> Column:
    """One decimal, halves to even."""
    return F.concat(F.replace(F.format_number(as_float(c), 1), F.lit(","), F.lit("")), F.lit("%"))


def pretty_date(c: Column) -> Column:
    """Jan 05, 2024 for a date or time; text that is neither as it is, nothing as an empty text."""
    t = F.coalesce(F.trim(c.cast("string")), F.lit(""))
    day = F.to_date(F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))
    rest = F.substring(t, 11, 9)
    return F.when(rest.rlike("^$|^[T ][0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.coalesce(F.date_format(day, "MMM dd, yyyy"), t)).otherwise(t)


def reporting_window(start: Column, end: Column) -> Column:
    a, b = pretty_date(start), pretty_date(end)
    both = F.when((a != "") & (b != ""), F.concat(a, F.lit(" to "), b))
    return F.coalesce(both, F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit("No dated activity yet"))


#: The namespace of ids that are made of names, and the words that stand for nothing in these names.
ID_NAMESPACE = "8a2f1b96bf9c47e3a2c63c4eb266a2e2"
ID_NULL_WORDS = ("null", "none")


def id_part(c: Column) -> Column:
    """Text without outer blanks, empty for null and the words for nothing."""
    t = F.coalesce(F.trim(c.cast("string")), F.lit(""))
    return F.when(F.lower(t).isin(*ID_NULL_WORDS), "").otherwise(t)


def stable_uuid(kind: str, *parts: Column) -> Column:
    """A version 5 UUID of the parts joined by colons, in 32 hexadecimal digits: equal parts have equal ids on any system, without a registry."""
    name = F.concat_ws(":", F.lit(kind), *[id_part(p) for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(ID_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
