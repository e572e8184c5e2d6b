"""Counts and measures for the people who run the service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.vocabulary import NEGATIVE, POSITIVE
from . import scoring
from .search import latest_feedback, local_midnight
from .tables import shared_folder


RANGES = 256


def dashboard_counts(companies: DataFrame, sources: DataFrame, postings: DataFrame, matches: DataFrame, runs: DataFrame, as_of: Column, zone: str = "UTC") -> DataFrame:
    """Eleven counts in one row; each table is read once."""
    day, hour = as_of - F.make_dt_interval(F.lit(1)), as_of - F.make_dt_interval(F.lit(0), F.lit(1))
    open_ = F.col("status") == "active"
    parts = [
        companies.agg(F.count_if("enabled").alias("companies")),
        sources.agg(F.count_if("enabled").alias("sources")),
        postings.agg(
            F.count_if(open_).alias("active"), F.count_if(open_ & classify.home_only(F.col("country"), F.col("location_text"))).alias("active_listed"),
            F.count_if(open_ & (F.col("country") == "Israel")).alias("active_home"), F.count_if(open_ & F.col("location_text").isNull()).alias("active_no_location"),
            F.count_if(F.col("first_seen_at") >= day).alias("found_24h"), F.count_if(F.col("first_seen_at") >= local_midnight(as_of, 0, zone)).alias("found_today"),
        ),
        matches.agg(F.count("*").alias("matches")),
        runs.agg(F.count_if(F.col("started_at") >= hour).alias("runs_hour"), F.count_if((F.col("started_at") >= hour) & (F.col("status") == "failed")).alias("failed_hour")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def by_source_type(sources: DataFrame, postings: DataFrame) -> DataFrame:
    p = postings.select(F.col("career_source_id").alias("__source"), "status", "country", F.lit(1).alias("__one"))
    open_ = F.col("status") == "active"
    both = sources.select("id", "source_type").join(p, F.col("id") == F.col("__source"), "left")
    counts = both.groupBy("source_type").agg(F.countDistinct("id").alias("sources"), F.count_if(open_).alias("active"), F.count_if(open_ & (F.col("country") == "Israel")).alias("active_home"))
    return counts.orderBy(F.desc("active"), "source_type")


def sources_per_type(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").groupBy("source_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_type")


def failing_sources(sources: DataFrame, companies: DataFrame, runs: DataFrame, least: int = 2, limit: int = 30) -> DataFrame:
    """Enabled sources that keep failing, with the error of their last failed run."""
    last = runs.where("status = 'failed'").groupBy("source_id").agg(F.max_by("error_type", "run_id").alias("error_type"), F.max("run_id").alias("run_id"))
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    s = sources.where(F.col("enabled") & (F.col("consecutive_failures") >= least))
    out = s.join(c, "company_id").join(last, s["id"] == last["source_id"], "left")
    return out.select("id", "company", "source_type", "consecutive_failures", "run_id", "error_type").orderBy(F.desc("consecutive_failures"), "company", "id").limit(limit)


def recent_runs(runs: DataFrame, sources: DataFrame, companies: DataFrame, limit: int = 25) -> DataFrame:
    s = sources.select(F.col("id").alias("source_id"), "company_id", "source_type")
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    out = runs.join(s, "source_id").join(c, "company_id")
    return out.select("run_id", "company", "source_type", "status", "jobs_seen", "started_at").orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def runs_by_status(runs: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    return runs.where(F.col("started_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).groupBy("status").agg(F.count("*").alias("n"))


def application_counts(applications: DataFrame) -> DataFrame:
    return applications.groupBy("status").agg(F.count("*").alias("n"))


#: Ranges that a pass over the rows counts in, and rows that are few enough to be put in order.
BINS, FEW = 1024, 4096


def median_by_class(rows: DataFrame, kind: str, score: str) -> DataFrame:
    """kind, median_score (the mean of the two middle ones of an even number) and n of each class, exactly.

    Passes count the rows of ranges and go on in those that hold the middle ones, until each is one value or has FEW rows.
    So no task ever holds a class: what a pass gathers is at most BINS counts for each. Scores that are null count in n
    alone, those that are no numbers too.
    """
    spark = rows.sparkSession
    v = F.col(score).cast("double")
    scores = rows.where(v.isNotNull() & ~F.isnan(v)).select(F.col(kind).alias("kind"), v.alias("v"))
    folder = shared_folder(spark, "median")
    ends = scores.groupBy("kind").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    halves = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank")
    # A state: the rank is counted from the least value of the range.
    state = ends.select("kind", halves, "low", "high", F.col("n").alias("inside"))
    step = 0
    while True:
        path = f"{folder}/{step}"
        state.write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        wide = (F.col("low") < F.col("high")) & (F.col("inside") > FEW)
        if state.where(wide).isEmpty():
            break
        some = state.where(wide)
        # A range's ends are two of its values, so that each pass leaves out one of them at least.
        half = F.col("high") / 2 - F.col("low") / 2
        place = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / half * BINS), F.lit(BINS - 1)).alias("bin")
        counted = scores.join(some, scores["kind"].eqNullSafe(some["kind"]) & F.col("v").between(F.col("low"), F.col("high"))).select(some["kind"], "rank", "v", place)
        bins = counted.groupBy("kind", "rank", "bin").agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("inside").over(Window.partitionBy("kind", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = bins.withColumn("before", before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("inside")))
        state = state.where(~wide).unionByName(found.select("kind", (F.col("rank") - F.col("before")).alias("rank"), "low", "high", "inside"))
        step += 1
    one = state.where("low = high").select("kind", F.col("low").alias("v"))
    few = state.where("low < high").alias("f")
    left = scores.join(few, scores["kind"].eqNullSafe(F.col("f.kind")) & F.col("v").between(F.col("low"), F.col("high"))).select(F.col("f.kind").alias("kind"), "rank", "low", "v")
    order = Window.partitionBy("kind", "rank", "low").orderBy("v")
    picked = left.withColumn("at", F.row_number().over(order) - 1).where(F.col("at") == F.col("rank")).select("kind", "v")
    middle = one.unionByName(picked).groupBy("kind").agg(F.avg("v").alias("median_score"))
    n = rows.groupBy(F.col(kind).alias("__kind")).agg(F.count("*").alias("n"))
    return n.join(middle, F.col("__kind").eqNullSafe(F.col("kind")), "left").select(F.col("__kind").alias(kind), "median_score", "n")


def pairwise_accuracy(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Share of pairs of a positive and another row that the score puts in the right order, ties half; null without both.

    By ranks of the distinct scores, so the pairs are never made: rows are counted by score, the scores dealt into RANGES
    ranges and summed up inside each; the ranges' totals, one row for each, give what lies below a range.
    """
    counted = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    # Bounds are a fixed number of quantiles of the distinct scores: however rough they are, the sums are exact.
    bounds = sorted(set(counted.select(F.col("s").cast("double").alias("s")).approxQuantile("s", [k / RANGES for k in range(1, RANGES)], 0.002)))
    below_it = F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("s")) if bounds else F.array()
    ranged = counted.withColumn("part", F.size(below_it))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("part_n"), F.min("s").alias("least"))
    before = totals.select("part", F.coalesce(F.sum("part_n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    below = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("inside", F.coalesce(F.sum("n").over(below), F.lit(0))).join(before, "part").withColumn("less", F.col("before") + F.col("inside"))
    got = ranked.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("less") + F.col("n") / 2)).alias("right"))
    return got.select(F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("negatives", F.lit(0)).alias("negatives"), F.try_divide("right", F.col("positives") * F.col("negatives")).alias("accuracy"))


def agreement_report(feedback: DataFrame, matches: DataFrame, rules: str, judged: str) -> DataFrame:
    """How well the rules' score and the judgement's order what people liked before what they did not."""
    last = latest_feedback(feedback).where(F.col("action").isin(*POSITIVE, *NEGATIVE)).withColumn("liked", F.col("action").isin(*POSITIVE))
    rows = last.join(matches, "job_id").select("liked", rules, judged)
    a, b = pairwise_accuracy(rows, rules, "liked"), pairwise_accuracy(rows, judged, "liked")
    a = a.select("positives", "negatives", F.col("accuracy").alias("rules_pairwise"))
    return a.crossJoin(b.select(F.col("positives").alias("judged_positives"), F.col("negatives").alias("judged_negatives"), F.col("accuracy").alias("judged_pairwise")))


def agreement(feedback: DataFrame, matches: DataFrame, judged: DataFrame, w: scoring.Weights = scoring.Weights()) -> DataFrame:
    """agreement_report of the rules alone, computed anew from a match's parts, and of the judgements (scoring.PAIR and probability)."""
    j = judged.groupBy(*scoring.PAIR).agg(F.max("probability").alias("__judged"))
    rows = matches.withColumn("__rules", scoring.rules_score(w)).join(j, scoring.PAIR, "left")
    return agreement_report(feedback, rows.select("job_id", "__rules", "__judged"), "__rules", "__judged")


def append_feedback(feedback: DataFrame, applications: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback with the new rows (id, job_id, action, created_at), and applications with one opened for each job first marked applied."""
    applied = new.where("action = 'applied'").groupBy("job_id").agg(F.min("created_at").alias("applied_at"))
    opened = applied.join(applications.select("job_id"), "job_id", "left_anti").select("job_id", F.lit("applied").alias("status"), "applied_at", F.col("applied_at").alias("updated_at"), F.lit(None).cast("string").alias("notes"))
    return feedback.unionByName(new), applications.unionByName(opened)


def update_applications(applications: DataFrame, patch: DataFrame, as_of: Column) -> DataFrame:
    """patch: job_id, new_status, new_notes, clear_notes. Blank notes count as none."""
    both = applications.join(patch, "job_id", "left")
    touched = F.col("clear_notes").isNotNull()
    notes = F.when(F.col("clear_notes"), None).otherwise(F.coalesce(F.nullif(F.trim("new_notes"), F.lit("")), F.col("notes")))
    return both.select("job_id", F.coalesce("new_status", "status").alias("status"), "applied_at", F.when(touched, as_of).otherwise(F.col("updated_at")).alias("updated_at"), notes.alias("notes"))


def score_tone(score: Column) -> Column:
    return F.when(score >= 75, "great").when(score >= 65, "good").when(score >= 50, "fair").otherwise("low")


def notification_key() -> Column:
    return F.concat_ws(":", "job_id", "channel")


def notifications_due(candidates: DataFrame, sent: DataFrame) -> DataFrame:
    """One row for each job and channel that has not been sent."""
    return candidates.withColumn("dedup_key", notification_key()).dropDuplicates(["dedup_key"]).join(sent.select("dedup_key"), "dedup_key", "left_anti")


def notifications_once(candidates: DataFrame, at: str = "created_at", within: str = "7 days") -> DataFrame:
    """On a stream of candidates, the first of each job and channel: repeats no later than ``within`` go, across batches and restarts.

    State is a key for each that was sent in that time. On a batch this is the first by time of all.
    """
    keyed = candidates.withColumn("dedup_key", notification_key())
    if candidates.isStreaming:
        return keyed.withWatermark(at, within).dropDuplicatesWithinWatermark(["dedup_key"])
    first = Window.partitionBy("dedup_key").orderBy(at)
    return keyed.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
