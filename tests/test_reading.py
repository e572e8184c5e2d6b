"""Golden cases of the readers of postings' words."""

import pytest
from pyspark.sql import functions as F

from postlark.functions import classify as C
from postlark.functions import text as T
from postlark.functions import vectors as V


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(*columns).first()


def column(spark, function, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_years(spark):
    cases = {
        "3-5 years of experience": 3, "5+ years": 5, "at least two years": 2, "minimum of 4 years": 4, "1.5 years of experience": 2, "7 years of proven record": 7, "we were founded 20 years ago": None,
        "over 30 years in the industry": None, "You are 18 years old": None, "two to four years experience": 2, "Requirements\n2 years with Python\n5 years as a developer": 5, "": None,
        "about: 12 years in business\nRequirements:\n1 year of experience": 1, "3 שנות ניסיון": 3, "ניסיון של שנתיים": 2, "תואר של 3 שנים": None, "חמש שנות ניסיון בפיתוח": 5, "no numbers": None,
    }
    assert column(spark, C.min_years, list(cases)) == list(cases.values())
    assert column(spark, C.min_years, [None]) == [None]


def test_title_level(spark):
    cases = {
        "Senior Engineer": "senior", "Sr. Engineer": "senior", "Quality Assurance Engineer": None, "Team Lead": "lead", "Junior Dev": "junior", "Software Engineer I": "junior", "Software Engineer II": None,
        "Student position": "intern", "Engineering Manager": "manager", "Leadership program": None, "מפתח בכיר": "senior", "סטודנט לפיתוח": "intern", "Entry-level analyst": "junior",
    }
    assert column(spark, lambda x: C.title_level(x)["level"], list(cases)) == list(cases.values())


def test_assessment_and_fit(spark):
    rows = spark.createDataFrame([("Engineer", "6+ years", 2), ("Engineer", "2 years of experience", 2), ("Engineer", "no prior experience required", 2), ("Engineer", "", 2), ("Junior Engineer", "4+ years", 2), ("Engineer", "3+ years", None)], "t string, r string, most int")
    level = C.assess_level(F.col("t"), F.col("r"))
    got = rows.select(level["level"].alias("level"), level["years"].alias("years"), C.level_fit(level["level"], level["years"], F.col("most")).alias("fit"), C.level_score(level["level"], level["years"], level["signal"], F.col("most"))["score"].alias("score")).collect()
    assert [tuple(r) for r in got] == [("senior", 6, "experienced", 0.05), ("junior", 2, "fit", 1.0), ("junior", 0, "fit", 1.0), ("unknown", None, "unknown", 0.5), ("junior", 4, "experienced", 0.5), ("mid", 3, "experienced", 0.5)]


def test_places(spark):
    cases = {
        "Tel Aviv, IL": ("Israel", "tel_aviv", False), "Kiryat-Gat": ("Israel", "south", False), "Lodz, Poland": (None, None, True), "Lod": ("Israel", "center", False), "Haifa or Tel Aviv": ("Israel", "haifa", False),
        "New-York": (None, None, True), "Israel": ("Israel", None, False), "Mars": (None, None, False), "Tel Aviv / New York": ("Israel", "tel_aviv", False), "JerUSAlem": ("Israel", "jerusalem", False), "תל אביב": ("Israel", "tel_aviv", False),
    }
    got = column(spark, lambda x: F.struct(C.country(x), C.region(x), C.clearly_abroad(x)), list(cases))
    assert [tuple(g) for g in got] == list(cases.values())
    assert column(spark, lambda x: C.home_only(C.country(x), x), ["New-York", "New York", None, "Haifa"]) == [True, False, True, True]


def test_skills(spark):
    cases = {
        "Node.js and React.js": ["node.js", "react"], "go-to-market, react quickly": [], "Go developer with Spring Boot": ["go", "spring"], "Python, Go, Java": ["go", "java", "python"], "mail jobs@company.net": [],
        "ASP.NET or .NET": ["c#"], "C++ / C#": ["c#", "c++"], "JavaScript": ["javascript"], "experience with Go": ["go"], "k8s, CI/CD": ["ci/cd", "kubernetes"], "": [],
    }
    assert column(spark, C.extract_skills, list(cases)) == list(cases.values())
    assert column(spark, C.normalize_skill, [" NodeJS ", "Excel  Macros"]) == ["node.js", "excel macros"]


def test_skill_spans_by_blanking():
    """Against blanking one name after the other, longest first, over texts in which names overlap and touch."""
    import random
    import re

    from postlark.functions.vocabulary import SKILL_NAMES, SKILL_NOUNS

    names = {a: n for n, aliases in SKILL_NAMES.items() for a in aliases if a not in SKILL_NOUNS}

    def blanked(text):
        low, found = text.lower(), set()
        for alias in sorted(names, key=lambda a: (-len(a), a)):
            if names[alias] in found:
                continue
            e = re.escape(alias)
            pattern = rf"(?<![\w.@]){e}\b" if alias == ".net" else e if re.search(r"[.+#]", alias) else rf"\b{e}\b"
            if re.search(pattern, low):
                found.add(names[alias])
                low = re.sub(pattern, lambda m: " " * len(m[0]), low)
        return sorted(found)

    rng = random.Random(3)
    parts = [*names, *(w for a in names for w in re.split(r"([\s.])", a) if w), " ", " ", "-", "/", ", ", "x", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert [s for s in C.skills_in(text) if s not in SKILL_NOUNS] == [s for s in blanked(text) if s not in SKILL_NOUNS], text
    assert C.skills_in("vb.net and asp.net core, react native apps with Go") == ["c#", "go", "react"]


def test_role_score(spark):
    terms = lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    score = lambda x: C.role_score(x, F.lit(None).cast("string"), F.lit("Software Engineer"), terms("Backend Dev"), terms("java", "cloud"), terms("manager", ""))["score"]
    cases = {"Software Engineer": 1.0, "Software Engineering Manager": 0.1, "JavaScript Person": 0.3, "Java Person": 0.8, "Java Cloud Person": 1.0, "backend dev": 1.0}
    assert column(spark, score, list(cases)) == pytest.approx(list(cases.values()))


def test_text(spark):
    assert column(spark, T.normalize_whitespace, ["a\u0000  b\t c \r\n\n\n\n d "]) == ["a b c\n\nd"]
    assert column(spark, T.strip_boilerplate, ["keep\nWe are an Equal Opportunity Employer\nkeep too"]) == ["keep\nkeep too"]
    assert column(spark, T.html_to_text, ["<p>a &amp; b</p><ul><li>c</li><li>d</ul><script>x()</script>", "&lt;p&gt;x&lt;/p&gt;", None]) == ["a & b\nc\nd", "x", ""]
    assert column(spark, T.normalize_location, ["Tel Aviv-Yafo,  Israel", ""]) == ["tel aviv, israel", None]
    assert column(spark, lambda x: T.chunk_words(x, 2), ["a b c", "a  b", ""]) == [["a b", "c"], ["a  b"], [""]]
    assert column(spark, T.employment_type, ["Full-time", "Internship", "part", "משרה מלאה", None]) == ["full_time", "internship", "part_time", "full_time", "unknown"]
    assert column(spark, T.registrable_host, ["jobs.a.co.il", "www.b.com", "c.io"]) == ["a.co.il", "b.com", "c.io"]
    assert column(spark, T.safe_link, ["javascript:alert(1)", "https://a", "/b"]) == [None, "https://a", "/b"]
    assert column(spark, T.source_url, [" a.com ", "http://b", ""]) == ["https://a.com", "http://b", None]
    assert [str(x) for x in column(spark, T.parse_timestamp, ["2024-01-10", "1700000000", "1700000000000", "soon"])] == ["2024-01-10 00:00:00", "2023-11-14 22:13:20", "2023-11-14 22:13:20", "None"]
    assert [str(x) for x in column(spark, T.display_date, ["Sep 14, 2026", "September 17, 2026", "x"])] == ["2026-09-14 00:00:00", "2026-09-17 00:00:00", "None"]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(V.cosine_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in rows.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 2.0, None]
    x = spark.createDataFrame([(0.15,), (0.35,), (0.9,)], "x double").select(V.calibrate(F.col("x"), 0.15, 0.55)).collect()
    assert [r[0] for r in x] == pytest.approx([0.0, 0.5, 1.0])
    pooled = {r["k"]: r["v"] for r in V.mean_pool(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0])], "k int, v array<double>"), "k", "v").collect()}
    assert pooled[1] == pytest.approx([2**-0.5, 2**-0.5]) and pooled[2] == [3.0, 4.0]
    h = spark.createDataFrame([("a b a",), ("",)], "t string").select(V.hashed_terms(F.col("t"), 16).alias("v")).collect()
    assert sum(x * x for x in h[0]["v"]) == pytest.approx(1.0) and sum(h[1]["v"]) == 0.0


def test_length_of_a_vector_is_computed_once(spark):
    """Not for each of its places: a long vector then took a time that grows with the square of its length."""
    import time

    rows = spark.range(8).select(F.transform(F.sequence(F.lit(1), F.lit(32768)), lambda x: (x + F.col("id")).cast("double")).alias("v")).localCheckpoint()
    began = time.time()
    got = rows.select(V.normalized(F.col("v")).alias("v")).select(V.norm(F.col("v")).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert time.time() - began < 20 and all(abs(n - 1) < 1e-9 for n in got)
    odd = spark.createDataFrame([([0.0, 0.0],), ([],), (None,), ([1.0, None],)], "v array<double>").select(V.normalized(F.col("v"))).collect()
    assert [r[0] for r in odd] == [[0.0, 0.0], [], None, [1.0, None]]


def test_products_with_fixed_vectors(spark):
    """The same to the bit as dot, for vectors of any length, without length, with null places, and where there is none."""
    import random

    rng = random.Random(3)
    vec = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    rows = [vec(5) for _ in range(3000)] + [vec(3), [], None, [0.0] * 5, [1.0, None, 1.0, 1.0, 1.0], vec(5)]
    fixed = [vec(5), vec(3), None, [], [1.0, None, 0.0, 0.0, 0.0], vec(5)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, v array<double>")
    kind = "array<double>"
    plain = [F.lit(None).cast("double") if y is None else V.dot(V.normalized(F.col("v")), F.array(*map(F.lit, y)).cast(kind)) for y in fixed]
    got = df.select("id", V.products(F.col("v"), fixed).alias("p"), F.array(*plain).alias("q")).collect()
    assert len(got) == len(rows) and all(r["p"] == r["q"] for r in got)
    assert df.where("id < 0").select(V.products(F.col("v"), fixed)).collect() == []


def test_words_are_looked_for_where_they_may_stand(spark):
    """Signs that stand for a found term inside are no mention, the looks before the patterns change nothing else."""
    cases = {"plain title \x01 here": False, "Java dev": True, "JavaScript dev": False, "JavaScript and JAVA": True, None: False}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in rows.select(C.mentions(F.col("t"), F.lit(" java "))).collect()] == list(cases.values())
    titles = {"sr. dev": "senior", "Entry-Level Dev": "junior", "Dev I": "junior", "stafflead": None, "campus lead": "lead", None: None}
    assert column(spark, lambda x: C.title_level(x)["level"], list(titles)) == list(titles.values())
    places = {"Paris-France": True, "tel-aviv": False, "New-York, USA": True, "south-korea": True, "Paris / Tel Aviv": False, "somewhere": False, None: False}
    assert column(spark, C.clearly_abroad, list(places)) == list(places.values())


def test_recency(spark):
    rows = spark.createDataFrame([("2024-01-10 00:00:00",), ("2024-01-09 23:00:00",), ("2023-12-31 00:00:00",), (None,)], "t string")
    got = rows.select(C.recency_score(F.col("t").cast("timestamp"), F.lit("2024-01-10 12:00:00").cast("timestamp"))["score"]).collect()
    assert [r[0] for r in got] == [1.0, 1.0, 0.4, 0.5]


def test_country_in_text_is_country(spark):
    """The first look for places never hides one that the patterns find."""
    texts = [
        None, "", "Haifa", "xhaifa", "haifa2", "haifa²", "TEL-AVIV", "kiryat-gat.", "KİRYAT GAT", "Kiryat ıono", "miſgav", "bat-yam", "ra'anana!", "ra-anana", "or", "or yehuda", "בחיפה", "חיפה", "(נצרת)",
        "lod́", "_lod_", "long text without a place", "netanya\n", "a-lod-b", "נגב", "ISRAEL", "Israeli", "modi'in‍", "omer١",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.country(F.col("t")).alias("a"), C.country_in_text(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and {r["t"] for r in rows if r["a"]} > {"Haifa", "TEL-AVIV", "חיפה"}
    assert C._may_name_here("Office: Haifa") and not any(map(C._may_name_here, ["xhaifa", "a word of prose", ""]))
