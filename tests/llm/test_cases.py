"""Names that clash, rows that are odd, and rules that looked right until a text broke them."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlark.llm import bpe, decontamination, jaccard, main_text, passages, pii, repetition, site_quality, token_store, toxicity

CLASHES = "__site string, __part string, part_rate double, evidence double, kept string, base_spans string, added_spans string, __email string, __doc string, __key string, __gone string, __again string, __n string, __s string, __base string"


def say(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + rng.choice(["ing", "tion", "er", "ly"]) for _ in range(n))


def test_clashing_columns_stay(spark):
    rng = random.Random(1)
    names = [c.split()[0] for c in CLASHES.split(", ")]
    kinds = [c.split()[1] for c in CLASHES.split(", ")]
    extra = [0.25 if k == "double" else "mine" for k in kinds]
    text = say(rng, 80)
    rows = [(1, text, "a", "en", *extra), (1, text + " x", "a", "en", *extra), (2, text, "a", "en", *extra), (3, say(rng, 70) + " mail me@x.org", None, None, *extra), (4, "bad " * 90, "b", "en", *extra)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, {CLASHES}")
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, say(rng, 20))], "item_id long, text string")

    def same(got):
        assert got.columns == docs.columns
        found = got.collect()
        assert found and all(tuple(r[n] for n in names) == tuple(extra) for r in found)
        return sorted(r["doc_id"] for r in found)

    assert 4 not in same(site_quality.accepted(docs, labels))
    assert same(pii.redact(docs)) == [1, 1, 2, 3, 4] and same(decontamination.drop_leaking(docs, bench)) == [1, 1, 2, 3, 4] and same(jaccard.one_of_each(docs)) == [1, 3, 4]
    scored = site_quality.score(docs, labels)
    assert set(docs.columns) <= set(scored.columns) and {r["__site"] for r in scored.select("__site").collect()} == {"mine"} and {r["evidence"] for r in scored.select("evidence").collect()} != {0.25}
    assert pii.find_pii(docs).where("doc_id = 3").select(F.size("base_spans")).first()[0] == 1


def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))  # over a megabyte in one row
    rows = [(1, say(rng, 90)), (1, say(rng, 90)), (2, None), (None, None), (None, "lone row " + say(rng, 60)), (3, ""), (4, long), (5, say(rng, 90))]
    rows.append((6, rows[-1][1]))
    for name, some in (("odd", rows), ("empty", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 5 else "s", len(t or "")) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        got = out.collect()
        assert all(r["exact"] for r in got)
        assert sorted(r["doc_id"] or -1 for r in got) == ([-1, -1, 1, 2, 3, 4, 5] if some else [])


def test_sites_are_hosts_and_paths(spark):
    rows = spark.createDataFrame([("https://a.org/news/1?x", "en"), ("a.org/news/2", "fr"), ("a.org/", "en"), ("a.org", None), (None, "en")], "source string, lang string")
    got = [(r["s"], r["p"]) for r in rows.coalesce(1).select(site_quality.site_of("source").alias("s"), site_quality.part_of("source", "lang").alias("p")).collect()]
    assert got == [("a.org", "/news"), ("a.org", "/news"), ("a.org", "en"), ("a.org", "\0"), ("\0", "en")]


def test_quotation_marks_come_in_pairs():
    def weight(text):
        return toxicity._context(text, text.index("scumbag"), text.index("scumbag") + 7)

    assert weight("i don't know, he said you are a scumbag and it's so") == 1.0
    assert weight('she said "you are a scumbag" to him') == weight("he wrote «scumbag» there") == weight("the word 'scumbag' is") == toxicity.QUOTED
    assert weight('he said "hello" and then scumbag "bye"') == 1.0 and weight('you "scumbag" you') == 1.0


def test_terms_beyond_one_automaton_count(monkeypatch):
    weights = {"=scumbag": 3.0, "=worthless": 3.0, "=idiot": 2.0, "gob": 2.0, "=moron": 2.0}
    texts = [b"a w0rthless scumbagg", b"gobbing idiots and a moron", b"none of it"]
    whole = toxicity.document_hits([toxicity.Automaton(k) for k in toxicity.Lexicon(weights).keys()], texts)
    monkeypatch.setattr(toxicity, "ENTRIES", 2)
    keys = toxicity.Lexicon(weights).keys()
    assert len(keys) == 3
    parts = toxicity.document_hits([toxicity.Automaton(k) for k in keys], texts)
    assert [dict(x) for x in parts[0]] == [dict(x) for x in whole[0]] and (parts[1] == whole[1]).all() and whole[0][0] and not whole[0][2]


def test_signs_and_slots_of_templates(spark):
    item = "If a farmer has 12 apples and sells 5 apples to Maria then how many apples are left with the farmer of 12 at the end"
    split = "If a farmer has 40 apples and sells 5 apples to Anna Belle then how many apples are left with the farmer of 50 at the end"
    steady = split.replace("50", "40")
    rows = [(1, "(" * 200 + item.replace(" ", " " + '"' * 90, 1) + "!" * 150), (2, split), (3, steady)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["share"] for r in decontamination.leaks(docs, bench, copied=True).collect()}
    assert got[1] == 1.0 and got[3] >= 0.5 and got[3] > got.get(2, 0)  # in 2 the 12 is 40 before the name and 50 after it: not both count


def test_many_spans_of_one_text(spark):
    text = "x@y.org, 10.0.0.1; " * 3000
    r = pii.redact(spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")).first()
    assert r["text"] == "[EMAIL], [IP]; " * 3000


def test_round_trip_and_any_pattern(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "Hello  wörld"), (2, None), (None, "x" * 5000), (1, "Hello  wörld")], "doc_id long, text string")
    got = bpe.round_trip(docs, path, P.PATTERN).collect()
    assert all(r["exact"] for r in got) and len(got) == 4 and got[1]["ids"] == []


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    rng = random.Random(9)
    names = [c.split()[0] for c in CLASHES.split(", ")]
    extra = [0.25 if c.split()[1] == "double" else "mine" for c in CLASHES.split(", ")]
    rows = [(i, say(rng, 80) + (" mail me@x.org" if i % 5 == 0 else ""), "en", "a", *extra) for i in range(20)]
    rows += [(30, rows[0][1], "en", "a", *extra), *((40 + i, "bad " * (90 + i), "en", "b", *extra) for i in range(20))]
    d = str(tmp_path)
    now = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASHES}")
    spark.createDataFrame([(r[0], int(r[0] < 40)) for r in rows], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, say(rng, 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, d).cache()
        assert after.columns == now.columns and all(tuple(r[n] for n in names) == tuple(extra) for r in after.collect())
        now = after
    got = corpus_pipeline.STAGES[-1][1](spark, now, d).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(20)) and all(r["exact"] for r in got)


def test_texts_over_a_megabyte(spark):
    """What stands at the end of a very long text counts as at its beginning."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = [f"w{rng.randrange(10**7)}" for _ in range(150_000)]
    end = [f"e{k}" for k in range(30)]
    long = " ".join([*words, *end, "scumbag", *end, *words[:40]])
    docs = spark.createDataFrame([(1, " ".join(end)), (2, long), (3, " ".join(words))], "doc_id long, text string")
    assert len(long) > 1 << 20
    of = lambda df: {r["doc_id"]: r for r in df.collect()}
    got, every = of(repetition.repetition_rules(docs)), long.split(" ")
    seen = Counter(zip(every, every[1:], every[2:], strict=False))
    repeated = {k + j for k in range(len(every) - 2) if seen[tuple(every[k : k + 3])] > 1 for j in range(3)}
    assert (got[2]["n_words"], got[2]["word_chars"], got[2]["n_repeat_words"], got[2]["base_failed"]) == (len(every), sum(map(len, every)), len(repeated), False)
    assert len(repeated) >= 140
    path = P.path("word_bpe_49k.json")
    ids = [*Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids, 1]
    stored = of(token_store.token_store(docs, path))
    assert (stored[2]["n_tokens"], stored[2]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and stored[3]["start"] == stored[2]["start"] + len(ids)
    lexicon = toxicity.Lexicon({"=scumbag": 9.0})
    scores = of(toxicity.score(docs, lexicon))
    assert scores[2]["score"] > 0.9 > 0.1 > scores[3]["score"] and scores[2]["hits"] == ["scumbag"]
    cut = of(passages.remove_repeated(docs))
    assert (cut[1]["n_removed"], cut[2]["n_removed"], cut[3]["n_removed"]) == (0, 60, len(words))


def test_repeated_rows_are_alike(spark):
    """A row that comes three times gives three equal rows, whatever else the table holds; equal texts have equal scores."""
    rng = random.Random(6)
    item = say(rng, 30)
    text = say(rng, 40) + " " + item + " you scumbag"
    docs = spark.createDataFrame([(1, text)] * 3 + [(2, text), (3, say(rng, 60))], "doc_id long, text string").withColumns({"source": F.lit("a"), "lang": F.lit("en")})

    def alike(df, n=3, key="doc_id"):
        rows = [tuple(r) for r in df.where(f"{key} = 1").collect()]
        assert len(rows) == n and len(set(map(repr, rows))) == 1
        return df

    alike(repetition.repetition_rules(docs))
    scored = alike(toxicity.score(docs, toxicity.Lexicon({"=scumbag": 9.0}))).collect()
    assert len({r["score"] for r in scored if r["doc_id"] < 3}) == 1
    judged = alike(site_quality.score(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))).collect()
    assert len({r["quality_score"] for r in judged if r["doc_id"] < 3}) == 1
    bench = spark.createDataFrame([(1, item)] * 2, "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.drop_leaking(docs, bench).collect()) == [3]
    html = "<nav><a href=1>x</a></nav><article><h1>Title</h1><p>The text of this page says many things about the matter at hand.</p></article>"
    alike(main_text.main_text(spark.createDataFrame([(1, "u", html)] * 3, "page_id long, url string, html string")), key="page_id")
