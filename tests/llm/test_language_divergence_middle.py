"""Language models, source divergence and fill-in-middle against plain versions of the same rules."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlark.llm import divergence, fill_middle, language, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
DOCS = "doc_id long, text string, lang string, source string"
EXTRA = ", N long, form string, lead string, __parts string, score double, pieces int"
SYLLABLES = {"aa": ["the", "ing", "er", "th", "wh"], "bb": ["eau", "é", "oux", "le", "ç"], "cc": ["sch", "ung", "ß", "ei", "ver"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 40)), lang, f"s{rng.randrange(4)}") for i in range(240)]
    out += [(500, None, "aa", "s1"), (501, "", "aa", None), (502, "12 — 34!", None, "s2"), (503, "\n\t", "bb", "lonely"), (504, out[5][1], None, "s0"), (504, out[5][1], None, "s0"), (None, "the wher", "aa", "s9"), (505, "Ünï 𝒳 中文字 é" * 3, "dd", "s1")]
    out.append((506, " ".join(prose(rng, "aa", 50) for _ in range(4000)), "aa", "s0"))  # over a megabyte
    return out + out[:20]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "l", "p", 0.5, 7) for r in rows], DOCS + EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + EXTRA)


# --- language ---


def read(text):
    return " " * 4 + re.sub(r"^ ", "", re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "))


def plain_model(rows):
    """p(window) by language, straight from the definition."""
    counts = collections.defaultdict(collections.Counter)
    for doc_id, text, lang, *_ in rows:
        if doc_id is None or lang is None or text is None:
            continue
        crc = zlib.crc32(str(doc_id).encode())
        if crc % 4 == 2 or crc // 4 % language.EIGHTH == 0:
            continue
        t = read(text)
        if t.strip():
            counts[lang].update(t[i : i + 5] for i in range(len(t) - 4))
    levels = {}
    for lang, c in counts.items():
        levels[lang] = {5: c}
        for k in (4, 3, 2, 1):
            levels[lang][k] = collections.Counter(g[1:] for g in levels[lang][k + 1])
    letters = len({g for by in levels.values() for g in by[1]})

    def p(lang, window):
        got = 1 / (letters + 1)
        for k in range(1, 6):
            c = levels[lang][k]
            once, twice = (sum(n == x for n in c.values()) for x in (1, 2))
            off = min(0.9, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))
            g = window[5 - k :]
            same = [n for w, n in c.items() if w[:-1] == g[:-1]]
            if same:
                got = max(c.get(g, 0) - off, 0) / sum(same) + off * len(same) / sum(same) * got
        return got

    return sorted(levels), p


def test_language_models(spark, docs, rows):
    model = language.fit(docs)
    langs, p = plain_model(rows)
    assert model.langs == langs
    some = ["the wher", "Éaux, le oux", "xyzzy", "Schung ßver — the!"]
    n, h = language.Scorer(model).cross_entropy(some)
    for i, text in enumerate(some):
        t = read(text)
        windows = [t[k : k + 5] for k in range(len(t) - 4)]
        assert n[i] == len(windows)
        for j, lang in enumerate(langs):
            assert h[i, j] == pytest.approx(-sum(math.log(p(lang, w)) for w in windows) / len(windows), rel=1e-4)


def test_language_is_calibrated_on_all_calibrating_texts(docs, rows, monkeypatch):
    """Curve, spreads and limit against plain ones, however few texts a limit might have let in."""
    monkeypatch.setattr(language, "CALIBRATION_ROWS", 8, raising=False)
    model = language.fit(docs)
    some = [(t, lang) for i, t, lang, _ in rows if i is not None and t is not None and lang is not None and (c := zlib.crc32(str(i).encode())) % 4 != 2 and c // 4 % language.EIGHTH == 0]
    n, h = language.Scorer(model).cross_entropy([t for t, _ in some])
    some, h, n = [s for s, k in zip(some, n, strict=True) if k], h[n > 0], n[n > 0].astype(float)
    best, low = h.argmin(1), h.min(1)
    lead = np.partition(h, 1, 1)[:, 1] - low
    x = np.stack([np.append(np.log1p(np.minimum(lead * n, 1e6)), [0, 0]), np.ones(len(n) + 2)], 1)
    y = np.append([model.langs[b] == lang for b, (_, lang) in zip(best, some, strict=True)], [1, 0]).astype(float)
    slope = x.T @ (1 / (1 + np.exp(-x @ np.array(model.curve))) - y) + 1e-3 * np.array(model.curve)
    assert len(n) > 16 and np.abs(slope).max() < 1e-4
    for k, lang in enumerate(model.langs):
        of = [i for i, (_, x) in enumerate(some) if x == lang and best[i] == k]
        if len(of) >= 3:
            mean = np.average(low[of], weights=np.minimum(n[of], 1000))
            square, inverse = (low[of] - mean) ** 2, 1 / n[of]
            by = max(np.cov(inverse, square)[0, 1] / max(inverse.var(ddof=1), 1e-12), 0)
            assert model.spread[k] == pytest.approx((mean, max(np.median(square - by * inverse), 1e-4), by), rel=1e-5)
    assert model.limit == pytest.approx(max(4.0, np.quantile(language._deviation(model, n, low, best), 1 - language.BEYOND)), rel=1e-5)


def test_language_cases(docs, empty, rows):
    got = language.language(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (500, 501, 502, 503))
    assert by[506]["lang_pred"] == "aa" and by[None]["held_out"] is False and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    right = [by[i]["lang_pred"] == lang for i, text, lang, _ in rows[:240] if by[i]["held_out"]]
    assert sum(right) >= 0.97 * len(right) > 30
    assert language.language(empty).collect() == []
    none = language.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == len(rows) and {r["lang_pred"] for r in none} == {"und"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_language_held_out(spark):
    got = queries.op11_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got) and sum(r["rejected"] for r in got) <= 0.02 * len(got)


# --- divergence ---


def plain_divergence(rows, least, top):
    langs = collections.defaultdict(list)
    for _, text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
        langs[lang or ""].append((source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in terms]))
    out = []
    for lang, docs in langs.items():
        df = collections.Counter(t for _, ts in docs for t in set(ts))
        kept = {t for t, n in df.items() if n >= least}
        groups = {s: collections.Counter() for s, _ in docs}
        for s, ts in docs:
            groups[s].update(t for t in ts if t in kept)
        whole = sum(groups.values(), collections.Counter())

        def p(c, t):
            return 1 + 10**9 * (c.get(t, 0) + 2) // (sum(c.values()) + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(sum(f(p(c, t), p(o, t)) for t in kept), x) for x, o in groups.items() if x != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in kept if c.get(t) and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(lang, s, part, x, v, k + 1) for k, (v, x) in enumerate(ordered)]
    return sorted(out)


def test_divergence(docs, empty, rows):
    for least, top in ((3, 4), (10**6, 4)):
        got = sorted(tuple(r) for r in divergence.divergence(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == plain_divergence(rows, least, top)
    assert divergence.divergence(empty).collect() == []


def test_pairs_are_named_the_same_way_round_in_every_block():
    """Whatever the order in which the rows of a block come; else their sum would fall into two."""
    two = [pa.table({"lang": ["x"] * 2, "block": [k] * 2, "size": [2] * 2, "source": names, "starts": [[0, 1]] * 2, "counts": [[1, 2], [5, 0]], "total": [9] * 2, "vocabulary": [4] * 2}) for k, names in enumerate((["s", "t"], ["t", "s"]))]
    assert {(r["a"], r["b"]) for t in two for r in divergence._compared(t).to_pylist()} == {("s", "t")}


def test_run_length_columns_hold_the_counts(docs):
    terms = divergence.kept_terms(docs, 3)
    columns = divergence.run_length_columns(terms, block=7).collect()
    assert max(r["size"] for r in columns) <= 7 and len({(r["lang"], r["block"]) for r in columns}) > 10
    total = {}
    for r in columns:
        ends = [*r["starts"][1:], r["size"]]
        total[r["lang"], r["source"]] = total.get((r["lang"], r["source"]), 0) + sum(n * (b - a) for n, a, b in zip(r["counts"], r["starts"], ends, strict=True))
    assert total == {(r["lang"], r["source"]): r["n"] for r in terms.groupBy("lang", "source").agg(F.sum("n").alias("n")).collect()}


def test_shares_do_not_overflow(spark):
    big = [(0, 1, 1), (10**12, 3 * 10**12, 10**7), (8 * 10**15, 8 * 10**15, 1), (5, 7, 3), (7, 7, 0)]
    want = [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in big if t + 2 * v]
    df = spark.createDataFrame(big, "n long, t long, v long").coalesce(1)
    assert [r[0] for r in df.select(divergence.share(F.col("n"), F.col("t"), F.col("v"))).collect()] == want
    assert [int(divergence._shares(np.array([n]), t, v)[0]) for n, t, v in big] == want


# --- fill in middle ---


def plain_middle(doc_id, text):
    t = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_middle(spark, docs, empty, rows):
    rng = random.Random(7)
    odd = [(600 + i, "".join(rng.choices(["<", "S", "P>", "M", ">", "é", "🙂", "\x00", "ab"], k=rng.randint(0, 9))), None, None) for i in range(400)]
    odd += [(2000 + i, t, None, None) for i, t in enumerate(["x<P>y", "<S>", "a<M>", "<p>", "< P>", "x", "é"])]
    every = docs.unionByName(spark.createDataFrame([(*r, 1, "f", "l", "p", 0.5, 7) for r in odd], DOCS + EXTRA))
    want = collections.Counter((d, *plain_middle(d, t)) for d, t, *_ in [*rows, *odd])
    out = fill_middle.outputs(every)
    assert {"N", "lead", "__parts", "score", "pieces"} - set(out.columns) <= {"N", "pieces"} and {r["__parts"] for r in out.select("__parts").collect()} == {"p"}
    assert collections.Counter(tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()) == want
    back = out.select("text", fill_middle.original(F.col("output"), F.col("form")).alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in back)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    hashed = collections.Counter((d, *(m := plain_middle(d, t))[:4], sha(m[4]), sha(t or "")) for d, t, *_ in [*rows, *odd])
    assert collections.Counter(tuple(r) for r in fill_middle.digests(every).collect()) == hashed
    assert {m[1] for m in want} and {k[2] for k in want} == {"plain", "psm", "spm"}
    assert fill_middle.digests(empty).collect() == [] and fill_middle.outputs(empty).collect() == []
