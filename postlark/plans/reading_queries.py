"""Registered queries of what is read from texts of postings: levels, skills, places, small fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as T
from ..functions.vocabulary import ABROAD_TERMS, LOCATION_SPELLINGS, REGION_PLACES, SKILL_NAMES
from ..operators import profiles, scoring
from .registry import query
from .views import table


def _listed(values: list[str | None]) -> str:
    """A list of texts in SQL."""
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _nth(values: list[str], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


_TITLES = ["Senior Dev", "Dev", "Dev I", "Team Lead", "Junior Analyst", "Student", "Builder"]


@query(f"""WITH a AS (SELECT o_orderkey AS id, o_orderkey % 7 AS t, o_orderkey % 6 AS k, o_orderkey % 9 + 1 AS n, o_orderkey % 4 AS most FROM orders),
  y AS (SELECT *, CAST(CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 4 THEN 5 END AS INT) AS asked, list_extract(['senior', NULL, 'junior', 'lead', 'junior', 'intern', NULL], t + 1) AS word FROM a),
  l AS (SELECT *, CASE WHEN word IS NOT NULL THEN word WHEN asked >= 5 THEN 'senior' WHEN asked <= 2 THEN 'junior' WHEN asked IS NOT NULL THEN 'mid' WHEN k = 2 THEN 'junior' ELSE 'unknown' END AS level,
    CASE WHEN word IS NOT NULL THEN asked WHEN asked IS NULL AND k = 2 THEN 0 ELSE asked END AS years,
    CASE WHEN word IS NOT NULL THEN list_extract({_listed(["title contains 'senior'", None, "title ends in 'I' (entry-level tier convention)", "title contains 'lead'", "title contains 'junior'", "title contains 'student'", None])}, t + 1)
      WHEN asked >= 5 THEN concat('requires ', asked, '+ years') WHEN asked <= 2 THEN concat('requires ', asked, ' years (entry-friendly)') WHEN asked IS NOT NULL THEN concat('requires ', asked, ' years')
      WHEN k = 2 THEN 'posting says no experience is needed' ELSE 'no clear seniority signal in title or requirements' END AS signal FROM y)
  SELECT id, level, CAST(years AS INT) AS years, signal, CAST(CASE WHEN level IN ('senior', 'lead') THEN 0.05 WHEN level = 'intern' THEN 0.3 WHEN years <= most THEN 1 WHEN years > most THEN greatest(0, 1 - (years - most) * 0.25) WHEN level = 'junior' THEN 1 ELSE 0.5 END AS DOUBLE) AS score,
    CASE WHEN level IN ('senior', 'lead') THEN concat('looks senior-level (', signal, ')') WHEN level = 'intern' THEN concat('a student position (', signal, ')') WHEN years <= most THEN concat('requires ', years, 'y, within your target range')
      WHEN years > most THEN concat('requires ', years, 'y, ', years - most, ' more than your target ceiling') WHEN level = 'junior' THEN concat('entry-level signal (', signal, ')') ELSE 'no clear seniority signal' END AS why FROM l""")
def levels_read(spark, d):
    """Level and years of titles and texts of several forms, and how they fit what a role expects at most."""
    n = (F.col("o_orderkey") % 9 + 1).cast("int")
    texts = [
        F.concat(F.lit("About\nRequirements:\nat least "), n.cast("string"), F.lit(" years of experience")), F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit(" years of experience")),
        F.lit("No prior experience needed"), F.lit("We began over 10 years ago"), F.lit("five years building things"), F.lit(""),
    ]
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("most"),
        classify.assess_level(_nth(_TITLES, F.col("o_orderkey") % 7), F.get(F.array(*texts), (F.col("o_orderkey") % 6).cast("int"))).alias("r"),
    )
    score = classify.level_score(F.col("r.level"), F.col("r.years"), F.col("r.signal"), F.col("most"))
    return rows.select("id", "r.*", score.alias("s")).select("id", "level", "years", "signal", "s.score", "s.why")


_ALIASES = [(alias, name) for name, aliases in SKILL_NAMES.items() for alias in aliases]
_HAVE = ["docker", "python", "sql"]
_SKILLS_SQL = f"""a AS (SELECT p_partkey, list_extract({_listed([n for _, n in _ALIASES])}, p_partkey % {len(_ALIASES)} + 1) AS x, list_extract({_listed([n for _, n in _ALIASES])}, (p_partkey * 7 + 3) % {len(_ALIASES)} + 1) AS y FROM part),
  s AS (SELECT p_partkey, list_sort(list_distinct([x, y])) AS asked FROM a)"""


@query(f"""WITH {_SKILLS_SQL} SELECT p_partkey, array_to_string(asked, ',') AS asked, array_to_string(list_filter(asked, lambda v: list_contains({_listed(_HAVE)}, v)), ',') AS matched, array_to_string(list_filter(asked, lambda v: NOT list_contains({_listed(_HAVE)}, v)), ',') AS missing,
  len(list_filter(asked, lambda v: list_contains({_listed(_HAVE)}, v))) / len(asked) AS score FROM s""")
def skills_scored(spark, d):
    """A skill by any of its names in a list and another in a text, against what a candidate has; the candidate's own list reads the same."""
    first, second = (_nth([a for a, _ in _ALIASES], F.expr(f"({e}) % {len(_ALIASES)}")) for e in ("p_partkey", "p_partkey * 7 + 3"))
    text = F.concat(F.lit("Work with "), second, F.lit(", daily"))
    rows = table(spark, d, "part").select("p_partkey", scoring.job_skills(F.array(F.concat(F.lit(" "), F.upper(first))), F.lit(None).cast("array<string>"), text).alias("asked"), scoring.candidate_skills([F.array(first)], text).alias("own"))
    rows = rows.withColumn("s", classify.skill_score(F.array(*map(F.lit, _HAVE)), F.col("asked"))).where(F.array_sort("asked") == F.col("own"))
    return rows.select("p_partkey", F.array_join("own", ",").alias("asked"), F.array_join("s.matched", ",").alias("matched"), F.array_join("s.missing", ",").alias("missing"), "s.score")


@query("""SELECT p_partkey, concat(p_name, chr(10), p_brand, CASE WHEN p_partkey % 3 <> 0 THEN concat(chr(10), p_type) ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN concat(chr(10), 'Keywords: ', p_type, ', ', p_name) ELSE '' END,
  CASE WHEN p_partkey % 5 = 0 THEN concat(chr(10), 'Preferred skills: ', p_brand) ELSE '' END) AS role_text FROM part""")
def role_texts(spark, d):
    """What roles are embedded by."""
    k = F.col("p_partkey")
    described = F.when(k % 3 != 0, F.col("p_type")).otherwise("")
    return table(spark, d, "part").select("p_partkey", scoring.role_text(F.col("p_name"), F.array("p_brand"), described, F.when(k % 2 == 0, F.array("p_type", "p_name")), F.when(k % 5 == 0, F.array("p_brand"))).alias("role_text"))


_PLACES: list[tuple[str, str | None, str]] = [
    *((p, "center" if p == "modiin illit" else region, "home") for region, places in REGION_PLACES.items() for p in places),  # that name begins with another region's
    ("israel", None, "home"), ("ישראל", None, "home"), *((p, None, "abroad") for p in ABROAD_TERMS), ("anywhere", None, "unclear"),
]


def _spelled() -> str:
    out = "lower(place)"
    for variant, city in sorted(LOCATION_SPELLINGS.items(), key=lambda p: -len(p[0])):
        out = f"""replace({out}, '{variant.replace("'", "''")}', '{city}')"""
    return out


@query(f"""WITH a AS (SELECT c_custkey, CAST(c_custkey % {len(_PLACES)} + 1 AS INT) AS k FROM customer),
  p AS (SELECT c_custkey, concat('Office in ', list_extract({_listed([p for p, _, _ in _PLACES])}, k)) AS place, list_extract({_listed([r for _, r, _ in _PLACES])}, k) AS region, list_extract({_listed([w for _, _, w in _PLACES])}, k) AS w FROM a)
  SELECT c_custkey, {_spelled()} AS spelled, CASE WHEN w = 'home' THEN 'Israel' END AS country, region, w = 'abroad' AS abroad,
    CAST(CASE WHEN c_custkey % 5 = 0 THEN 1 WHEN w = 'home' THEN 1 WHEN w = 'abroad' THEN 0.1 ELSE 0.5 END AS DOUBLE) AS score,
    CASE WHEN c_custkey % 5 = 0 THEN 'remote position' WHEN w = 'home' THEN 'located in Israel' WHEN w = 'abroad' THEN concat('located outside Israel (', place, ')') ELSE 'location unclear from the posting' END AS why FROM p""")
def places_read(spark, d):
    """Country, region, and score of every known place here and abroad."""
    place = F.concat(F.lit("Office in "), _nth([p for p, _, _ in _PLACES], F.col("c_custkey") % len(_PLACES)))
    rows = table(spark, d, "customer").select("c_custkey", place.alias("place")).withColumns({"country": classify.country(F.col("place")), "region": classify.region(F.col("place")), "abroad": classify.clearly_abroad(F.col("place"))})
    score = classify.location_score(F.col("country"), F.col("place"), F.when(F.col("c_custkey") % 5 == 0, "remote").otherwise("unknown"))
    return rows.withColumn("s", score).select("c_custkey", T.normalize_location(F.col("place")).alias("spelled"), "country", "region", "abroad", "s.score", "s.why")


_EMPLOYED = {"Full-time": "full_time", "Part time": "part_time", "Internship": "internship", "Freelance": "contract", "Temp": "contract", "חלקית": "part_time", "מלאה": "full_time", "": "unknown", "Shift": "unknown"}
_REMOTE = {"Fully Remote": "remote", "Hybrid": "hybrid", "On-Site": "onsite", "onsite": "onsite", "": "unknown", "office": "unknown", "remote or hybrid": "remote"}
_HEADS = {"Senior Engineer": True, "Engineer": False, "Read more": False, "Data - Analyst": True, "QA/Tester": True, "מהנדס תוכנה": True, "": False, "Full Stack": True, "About our team": True}


@query(f"""SELECT event_id, list_extract({_listed(list(_EMPLOYED.values()))}, CAST(event_id % {len(_EMPLOYED)} + 1 AS INT)) AS employment, list_extract({_listed(list(_REMOTE.values()))}, CAST(event_id % {len(_REMOTE)} + 1 AS INT)) AS remote,
  list_extract([{', '.join(str(v).lower() for v in _HEADS.values())}], CAST(event_id % {len(_HEADS)} + 1 AS INT)) AS is_title, CAST(date_trunc('day', ts) AS TIMESTAMP) AS shown, concat(json_extract_string(props, '$.k'), CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('|', event_type) ELSE '|x' END) AS listed FROM events""")
def fields_read(spark, d):
    """Kinds of employment and of remote work, titles among other links, dates as shown, and lists as models write them."""
    k = F.col("event_id")
    object_, quoted = F.col("props"), F.concat(F.lit('"'), "event_type", F.lit('"'))
    written = F.when(k % 3 == 0, object_).when(k % 3 == 1, F.concat(F.lit("["), object_, F.lit(", "), quoted, F.lit("]"))).otherwise(F.concat(F.lit("["), object_, F.lit(', " x ", ""]')))
    shown = F.when(k % 2 == 0, F.date_format("ts", "MMM d, yyyy")).otherwise(F.date_format("ts", "MMMM d, yyyy"))
    return table(spark, d, "events").select(
        "event_id", T.employment_type(_nth(list(_EMPLOYED), k % len(_EMPLOYED))).alias("employment"), T.remote_type(_nth(list(_REMOTE), k % len(_REMOTE))).alias("remote"),
        T.looks_like_job_title(_nth(list(_HEADS), k % len(_HEADS))).alias("is_title"), T.display_date(shown).alias("shown"), F.array_join(profiles.string_list(written), "|").alias("listed"),
    )
