"""Candidates: what can be said of a profile without a model, and which version of it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify

# A line that is only a heading of work experience.
EXPERIENCE_HEADING = (
    r"(?imU)^(?:(?:work|professional|employment|relevant|industry|practical)\s+)?(?:experience|employment(?:\s+history)?|career\s+history|work\s+history)\s*:?\s*$"
    r"|^ניסיון(?:\s+(?:תעסוקתי|מקצועי|בעבודה|רלוונטי))?\s*:?\s*$"
)
LISTS = ("programming_languages", "frameworks", "databases", "cloud", "devops")


def has_experience_heading(text: Column) -> Column:
    return F.coalesce(text.rlike(EXPERIENCE_HEADING), F.lit(False))


def string_list(x: Column) -> Column:
    """A field that a model wrote as a list, a text, an object or nothing, as JSON: trimmed texts, an object's values on one line."""
    raw = F.trim(x)

    def line(item: Column) -> Column:
        values = F.map_values(F.from_json(item, "map<string,string>"))
        said = F.filter(values, lambda v: v.isNotNull() & ~v.isin("", "[]", "{}"))
        return F.when(item.startswith("{"), F.array_join(said, ", ")).otherwise(item)

    text = F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw)
    items = (
        F.when(raw.startswith("["), F.transform(F.from_json(raw, "array<string>"), line)).when(raw.startswith("{"), F.array(line(raw)))
        .when(raw.isNull() | (raw == "null"), F.array().cast("array<string>")).otherwise(F.array(text))
    )
    return F.filter(F.transform(items, lambda t: F.trim(t)), lambda t: t != "")


def profile_rules(profiles: DataFrame) -> DataFrame:
    """profiles (text, years_of_experience, seniority, skills and LISTS) with level and skills settled.

    Without a heading of work experience there is none, and the level is junior; else the level follows from the years
    where they are known. Without skills those that the text names and no list has stand in.
    """
    worked = has_experience_heading(F.col("text"))
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in LISTS if c in profiles.columns]
    listed = F.transform(F.concat(*lists), F.lower) if lists else F.array().cast("array<string>")
    named = F.filter(classify.extract_skills(F.col("text")), lambda s: ~F.array_contains(listed, F.lower(s)))
    empty = F.coalesce(F.size("skills") == 0, F.lit(True))
    return profiles.withColumns({
        "seniority": F.when(~worked, "junior").otherwise(F.coalesce(classify.level_from_years(F.col("years_of_experience")), "seniority")),
        "years_of_experience": F.when(~worked, 0.0).otherwise(F.col("years_of_experience")), "skills": F.when(empty, named).otherwise(F.col("skills")),
    })


def single_active(profiles: DataFrame, active: Column) -> DataFrame:
    """profiles of which only the one of an id is active."""
    return profiles.withColumn("is_active", F.col("id") == active)


def add_profile(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """profiles (id, file_hash, version, is_active, …) after a file came in: a known one is active again, a new one is the next version. new: one row with id, file_hash."""
    n = new.select(F.col("id").alias("__new"), F.col("file_hash").alias("__hash"))
    known = profiles.join(n, F.col("file_hash") == F.col("__hash")).agg(F.max("id").alias("__known"))  # one row, as new is
    last = profiles.agg(F.coalesce(F.max("version"), F.lit(0)).alias("__last"))
    target = n.crossJoin(known).crossJoin(last)
    old = profiles.crossJoin(target.select(F.coalesce("__known", "__new").alias("__active"))).withColumn("is_active", F.col("id") == F.col("__active")).drop("__active")
    fresh = new.crossJoin(target.select("__known", "__last")).where("__known is null").withColumns({"version": F.col("__last") + 1, "is_active": F.lit(True)}).drop("__known", "__last")
    return old.unionByName(fresh, allowMissingColumns=True)
