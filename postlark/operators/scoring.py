"""Match scores of postings against roles and a candidate, as column expressions, and their table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, vectors


@dataclass(frozen=True)
class Weights:
    """Shares of the quality, which sum to one; the gate's floor; where raw similarities begin and end."""

    level: float = 0.45
    skills: float = 0.30
    candidate: float = 0.12
    intent: float = 0.08
    location: float = 0.03
    recency: float = 0.02
    gate_floor: float = 0.2
    judgement: float = 0.0
    candidate_range: tuple[float, float] = (0.15, 0.55)
    intent_range: tuple[float, float] = (0.10, 0.50)
    intent_as_role: float = 0.6

    def __post_init__(self) -> None:
        total = self.level + self.skills + self.candidate + self.intent + self.location + self.recency
        if abs(total - 1) > 0.01:
            raise ValueError(f"the quality weights have to sum to 1, not {total:.4f}")


#: Roles that are sent to every task, at most.
MOST_ROLES = 1_000
SCORES = ("candidate_semantic_score", "intent_semantic_score", "skill_score", "role_score", "seniority_score", "location_score", "recency_score", "final_score")


def role_fit(title_score: Column, vetoed: Column, intent: Column, w: Weights = Weights()) -> Column:
    """The title's score; where nothing excludes it, a close intent can stand in for part of it."""
    return F.when(vetoed, title_score).otherwise(F.greatest(title_score, w.intent_as_role * intent))


def quality(level: Column, skills: Column, candidate: Column, intent: Column, location: Column, recency: Column, judged: Column | None = None, w: Weights = Weights()) -> Column:
    """The weighted sum; a judgement takes its share where there is one."""
    rules = w.level * level + w.skills * skills + w.candidate * candidate + w.intent * intent + w.location * location + w.recency * recency
    if judged is None or not w.judgement:
        return rules
    return F.when(judged.isNull(), rules).otherwise((1 - w.judgement) * rules + w.judgement * judged)


def final_score(fit: Column, quality_: Column, w: Weights = Weights()) -> Column:
    return F.round(100 * (w.gate_floor + (1 - w.gate_floor) * fit) * quality_, 1)


def _similarity(a: Column, b: Column, between: tuple[float, float], product: Column | None = None) -> Column:
    """Of vectors of length one, or zero. product: theirs, where it is known."""
    raw = vectors.dot(a, b) if product is None else product
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(vectors.calibrate(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), *between))


def _compact(*parts: Column) -> Column:
    return F.array_compact(F.concat(*parts))


def _if_any(x: Column) -> Column:
    """An array of x, empty where that is null."""
    return F.when(x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<string>"))


def job_skills(required: Column, preferred: Column, *texts: Column) -> Column:
    listed = F.transform(F.concat(F.coalesce(required, F.array()), F.coalesce(preferred, F.array())), classify.normalize_skill)
    return F.array_union(listed, classify.extract_skills(F.concat_ws(" ", *texts)))


def candidate_skills(lists: list[Column], text: Column) -> Column:
    """Sorted skills of a candidate: what the lists of a profile name, and what its text mentions."""
    listed = F.transform(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), classify.normalize_skill)
    return F.array_sort(F.array_distinct(F.array_union(F.filter(listed, lambda x: x != ""), classify.extract_skills(text))))


def role_text(name: Column, aliases: Column, description: Column, positive_keywords: Column, preferred_skills: Column) -> Column:
    """What a role's embedding is made of: a line for its name, each alias and the description, then its keywords and skills where it has any."""
    none = F.array().cast("array<string>")

    def listed(head: str, xs: Column) -> Column:
        return F.when(F.size(F.coalesce(xs, none)) > 0, F.concat(F.lit(head), F.array_join(xs, ", ")))

    lines = F.concat(F.array(name), F.coalesce(aliases, none), F.array(F.nullif(description, F.lit("")), listed("Keywords: ", positive_keywords), listed("Preferred skills: ", preferred_skills)))
    return F.array_join(F.array_compact(lines), "\n")


POSTING_PARTS = (
    "title", "department", "qualifications", "normalized_description", "description", "responsibilities", "required_skills", "preferred_skills", "country", "location_text", "remote_type", "embedding"
)
ROLE_PARTS = ("canonical_name", "aliases", "positive_keywords", "negative_keywords", "max_expected_years", "embedding")
PAIR = ["candidate_profile_id", "target_role_id", "job_id"]


def open_postings(postings: DataFrame, as_of: Column) -> DataFrame:
    """Open postings with age, and job_key: a hash of all that their scores depend on. Age is in it by its step, so a posting changes when it passes one."""
    open_ = postings.where((F.col("status") == "active") & F.col("archived_at").isNull())
    aged = open_.withColumn("age", classify.recency_score(F.coalesce("source_published_at", "first_seen_at"), as_of))
    return aged.withColumn("job_key", F.xxhash64(*POSTING_PARTS, F.col("age.why")))


def asked_roles(roles: DataFrame, candidate: DataFrame, w: Weights) -> DataFrame:
    """Enabled roles with the candidate, and role_key: a hash of both and of the weights."""
    r = roles.where("enabled").select(F.col("id").alias("target_role_id"), *ROLE_PARTS[:-1], F.col("embedding").alias("__role_vector"))
    c = candidate.select(F.col("candidate_id").alias("candidate_profile_id"), F.col("skills").alias("have"), F.col("embedding").alias("__candidate_vector"))
    both = c.crossJoin(r)  # one candidate, and the roles that one person looks for
    key = F.xxhash64(*ROLE_PARTS[:-1], "__role_vector", "have", "__candidate_vector", F.lit(repr(w)))
    return both.select("candidate_profile_id", "target_role_id", *ROLE_PARTS[:-1], key.alias("role_key"), vectors.normalized(F.col("__role_vector")).alias("role_embedding"))


def _asking(candidate: DataFrame) -> DataFrame:
    """What a candidate's part of a score is made of."""
    return candidate.select(F.col("candidate_id").alias("__candidate"), F.col("skills").alias("have"), vectors.normalized(F.col("embedding")).alias("candidate_embedding"))


def score_pairs(postings: DataFrame, roles: DataFrame, candidate: DataFrame, as_of: Column, w: Weights = Weights(), judged: DataFrame | None = None, keys: bool = False) -> DataFrame:
    """A match row for every open posting and enabled role. keys: with job_key and role_key, by which maintained_scores goes on from it.

    roles are those one person looks for, and candidate is one row: both go to every task, the postings stay
    where they are. What depends on a posting and the candidate alone is computed before the roles multiply it.
    candidate: candidate_id, skills array<string>, embedding. judged: PAIR and probability, of what was judged.
    """
    asked = asked_roles(roles, candidate, w)
    rows = _score(open_postings(postings, as_of), asked, candidate, _few(asked, candidate), w)
    out = with_judgement(rows, judged, w)
    return out if keys else out.drop("job_key", "role_key")


def maintained_scores(old: DataFrame, postings: DataFrame, roles: DataFrame, candidate: DataFrame, as_of: Column, w: Weights = Weights(), judged: DataFrame | None = None) -> DataFrame:
    """What score_pairs gives, with job_key and role_key, from what it gave before: only changed postings meet all roles, and only changed roles the other postings.

    old: a result of this function, or of score_pairs with keys. Rows of postings that are no longer open and of roles that
    are no longer asked for go. A change of the candidate or of the weights changes all roles.
    """
    kept, due = _split(old, postings, roles, candidate, as_of, w)
    return with_judgement(kept.select(*MATCH_COLUMNS).unionByName(due), judged, w)


def rescored(old: DataFrame, postings: DataFrame, roles: DataFrame, candidate: DataFrame, as_of: Column, w: Weights = Weights()) -> tuple[DataFrame, DataFrame]:
    """The rows that maintained_scores has to score, and the keys of those that go: what an upsert into a stored table needs."""
    kept, rows = _split(old, postings, roles, candidate, as_of, w)
    return rows, old.select(*PAIR).join(kept.select(*PAIR), PAIR, "left_anti").join(rows.select(*PAIR), PAIR, "left_anti")


def _few(asked: DataFrame, candidate: DataFrame) -> dict[int | None, list[float] | None] | None:
    """Vectors by role_key, and the candidate's by None; nothing if there are several candidates or more than MOST_ROLES."""
    one = _asking(candidate).select("candidate_embedding").limit(2).collect()
    some = asked.select("role_key", "role_embedding").limit(MOST_ROLES + 1).collect() if len(one) <= 1 else []
    if len(one) > 1 or len(some) > MOST_ROLES:
        return None
    return {None: one[0][0] if one else None} | dict(map(tuple, some))


def _split(old: DataFrame, postings: DataFrame, roles: DataFrame, candidate: DataFrame, as_of: Column, w: Weights) -> tuple[DataFrame, DataFrame]:
    """The rows of old that still hold, and those that have to be scored: of changed postings with all roles, and of changed roles with all postings."""
    p, r = open_postings(postings, as_of), asked_roles(roles, candidate, w)
    few = _few(r, candidate)
    jobs, asked = old.select("job_id", "job_key").distinct(), old.select("candidate_profile_id", "target_role_id", "role_key").distinct()
    p = p.withColumnRenamed("id", "job_id")
    job, role = ["job_id", "job_key"], ["candidate_profile_id", "target_role_id", "role_key"]
    kept = old.join(p.select(*job), job, "left_semi").join(F.broadcast(r.select(*role)) if few is not None else r.select(*role), role, "left_semi")
    # Postings move once: what is new is marked, and the pairs without anything new are left out.
    yes = F.lit(True)
    marked = p.join(jobs.withColumn("__known", yes), job, "left").withColumnRenamed("job_id", "id")
    r = r.join(asked.withColumn("__met", yes), role, "left").withColumn("__fresh", F.col("__met").isNull()).drop("__met")
    some = r.agg(F.coalesce(F.max("__fresh"), F.lit(False)).alias("__some"))
    marked = marked.crossJoin(F.broadcast(some)).where(F.col("__known").isNull() | F.col("__some"))
    return kept, _score(marked, r, candidate, few, w, unless=F.col("__known").isNotNull() & ~F.col("__fresh"), marks=("__known",))


MATCH_COLUMNS = (*PAIR, *SCORES, "reasons", "concerns", "job_key", "role_key")


def _score(open_: DataFrame, asked: DataFrame, candidate: DataFrame, few: dict | None, w: Weights, unless: Column | None = None, marks: tuple[str, ...] = ()) -> DataFrame:
    """MATCH_COLUMNS of all pairs of postings and roles, but those that unless says, from marks of the postings and columns of asked.

    few: of _few. Where it has them, vectors are multiplied with all of them at once; else pair by pair, and the sizes decide how the tables are joined.
    """
    sent = F.broadcast if few is not None else lambda x: x
    place_of = {key: k for k, key in enumerate(few or {})}
    text = F.coalesce(F.when(F.col("qualifications") != "", F.col("qualifications")), F.when(F.col("normalized_description") != "", F.col("normalized_description")), "description")
    p = open_.select(
        F.col("id").alias("job_id"), "job_key", "age", *marks,
        *((vectors.normalized(F.col("embedding")).alias("embedding"),) if few is None else (F.col("embedding"), vectors.products(F.col("embedding"), list(few.values())).alias("__products"))),
        *(x.alias(n) for n, x in zip(("words", "all_words"), classify.role_words(F.col("title"), F.col("department")), strict=True)),
        job_skills(F.col("required_skills"), F.col("preferred_skills"), F.col("normalized_description"), F.col("qualifications"), F.col("responsibilities")).alias("asked"),
        classify.assess_level(F.col("title"), text).alias("level"),
        classify.location_score(F.col("country"), F.col("location_text"), F.col("remote_type")).alias("place"),
    )
    p = p.crossJoin(sent(_asking(candidate)))
    said = lambda part, yes, no: (F.when(F.col(f"{part}.score") >= yes, F.col(f"{part}.why")), F.when(F.col(f"{part}.score") <= no, F.col(f"{part}.why")))
    place_for, place_against = said("place", 0.7, 0.3)
    missing = F.transform(F.slice("skill.missing", 1, 4), lambda x: F.concat(x, F.lit(" experience requested")))
    p = p.withColumn("skill", classify.skill_score(F.col("have"), F.col("asked"))).withColumns({
        "candidate_semantic_score": _similarity(F.col("candidate_embedding"), F.col("embedding"), w.candidate_range, None if few is None else F.get("__products", F.lit(place_of[None]))),
        "skill_score": F.col("skill.score"), "location_score": F.col("place.score"), "recency_score": F.col("age.score"),
        "for_first": F.array_compact(F.slice("skill.matched", 1, 6)), "for_last": _compact(F.array(place_for), F.array(F.when(F.col("age.score") >= 0.85, F.col("age.why")))),
        "against_first": F.array_compact(missing), "against_last": _if_any(place_against),
    })
    p = p.drop("candidate_embedding", "have", "asked", "skill", "place", "age")
    if few is not None:  # of the roles' vectors no more than which product is theirs
        keys = F.array(*(F.lit(k) for k in few if k is not None)).cast("array<bigint>")
        at = F.array_position(keys, F.col("role_key")).cast("int")  # the candidate's product is before them, at 0
        p, asked = p.withColumn("embedding", F.when(F.col("embedding").isNotNull(), True)), asked.withColumns({"__at": at, "role_embedding": F.when(F.col("role_embedding").isNotNull(), True)})
    both = p.join(sent(asked), F.col("__candidate").eqNullSafe(F.col("candidate_profile_id")))
    if unless is not None:
        both = both.where(~unless)
    both = both.withColumns({
        "intent_semantic_score": _similarity(F.col("role_embedding"), F.col("embedding"), w.intent_range, None if few is None else F.get("__products", F.col("__at"))),
        "role": classify.role_score_of(F.col("words"), F.col("all_words"), F.col("canonical_name"), F.col("aliases"), F.col("positive_keywords"), F.col("negative_keywords")),
        "seniority": classify.level_score(F.col("level.level"), F.col("level.years"), F.col("level.signal"), F.col("max_expected_years")),
    })
    both = both.withColumn("role_score", role_fit(F.col("role.score"), F.col("role.vetoed"), F.col("intent_semantic_score"), w))
    none = F.lit(None).cast("string")
    free = ~F.col("role.vetoed")
    like = F.lit("reads like the target role, even though the title doesn't say so")
    role_for = F.when(free & (F.col("role.score") >= 0.7), F.col("role.why")).when(free & (F.col("role_score") >= 0.5), like).otherwise(none)
    role_against = (
        F.when(~free, F.col("role.why")).when(F.col("role.score") >= 0.7, none).when(F.col("role_score") >= 0.5, none)
        .when(F.col("role_score") <= 0.35, F.lit("doesn't look like the role you're looking for")).when(F.col("role.score") <= 0.3, F.col("role.why"))
    )
    level_for, level_against = said("seniority", 0.7, 0.3)
    rows = both.select(
        *PAIR, "candidate_semantic_score", "intent_semantic_score", "skill_score", "role_score", F.col("seniority.score").alias("seniority_score"), "location_score", "recency_score",
        F.concat("for_first", _if_any(role_for), _if_any(level_for), "for_last").alias("reasons"),
        F.concat("against_first", _if_any(role_against), _if_any(level_against), "against_last").alias("concerns"), "job_key", "role_key",
    )
    return rows.withColumn("final_score", rules_score(w)).select(*MATCH_COLUMNS)


def rules_score(w: Weights = Weights(), judged: Column | None = None) -> Column:
    """The final score from the parts that a match row holds; without judged, of the rules alone."""
    parts = ("seniority_score", "skill_score", "candidate_semantic_score", "intent_semantic_score", "location_score", "recency_score")
    return final_score(F.col("role_score"), quality(*map(F.col, parts), judged=judged, w=w), w)


SHORTLIST, PASS_OVER = "a recruiter would shortlist you (", "a recruiter would probably pass ("


def with_judgement(matches: DataFrame, judged: DataFrame | None, w: Weights = Weights()) -> DataFrame:
    """matches scored with the judgements there are, each taking the share w gives it, and what they say among reasons and concerns.

    judged: PAIR and probability (that a recruiter would consider the candidate); of several for a pair the highest counts. What
    an earlier judgement said goes, so that this can be done again. No row is scored anew: the parts are in it.
    """
    if judged is None or not w.judgement:
        return matches
    j = judged.groupBy(*PAIR).agg(F.max("probability").alias("__p"))
    p = F.col("__p")
    percent = F.concat(F.round(100 * p, 0).cast("int").cast("string"), F.lit("%)"))
    kept = lambda c, start: F.filter(c, lambda x: ~x.startswith(start))
    rows = matches.join(j, PAIR, "left")
    rows = rows.withColumns({
        "final_score": rules_score(w, p), "reasons": _compact(kept(F.col("reasons"), SHORTLIST), F.array(F.when(p >= 0.7, F.concat(F.lit(SHORTLIST), percent)))),
        "concerns": _compact(kept(F.col("concerns"), PASS_OVER), F.array(F.when(p <= 0.3, F.concat(F.lit(PASS_OVER), percent)))),
    })
    return rows.select(*matches.columns)


def judgements(matches: DataFrame) -> DataFrame:
    """PAIR and probability of the judged matches. fit: struct with content_hash and would_be_considered."""
    return matches.where("fit is not null").select(*PAIR, F.col("fit.would_be_considered").cast("double").alias("probability"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The table after new rows replace old ones of the same keys; columns of keep stay the old row's."""
    o, n = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"n.{c}", f"o.{c}")
        if c in keep or c not in new.columns:
            return F.col(f"o.{c}")
        return F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*(pick(c).alias(c) for c in old.columns))


def answered(matches: DataFrame, answers: DataFrame) -> DataFrame:
    """matches with the fits of newly answered pairs (PAIR and fit) in place of theirs."""
    return upsert(matches, answers.join(matches.select(*PAIR), PAIR, "left_semi"), PAIR)


def upsert_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["candidate_profile_id", "target_role_id", "job_id"], keep=("fit",))


def needs_judgement(matches: DataFrame, postings: DataFrame, least_role: float = 0.5) -> DataFrame:
    """Matches close enough to a role whose judgement is of another text than the posting's, or none."""
    p = postings.where("status = 'active'").select(F.col("id").alias("job_id"), "content_hash")
    both = matches.where(F.col("role_score") >= least_role).join(p, "job_id")
    return both.where(~F.col("fit.content_hash").eqNullSafe(F.col("content_hash")))
