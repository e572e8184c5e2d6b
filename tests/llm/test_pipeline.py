"""The pipeline's stages in a row, and that each one's decisions take effect."""

import corpus_pipeline
from postlark.llm import jaccard


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    item = say(30)
    rows = [(i, say(80), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, say(20) + " " + item + " " + say(20), "en", "s1", 0), (102, say(60) + " mail me@x.org", "en", "s2", 0), (103, "bad " * 120, "en", "s0", 0)]
    rows += [(200 + i, "bad " * (80 + i), "en", "s0", 0) for i in range(20)]
    d = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 103), 0) for r in rows if r[0] != 103], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    ids, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
    clean = set(range(60)) | {102}
    assert ids[0] == clean | {100, 101} and ids[1] == clean | {101} and ids[2] == clean and ids[3] == clean and ids[4] == clean
    assert now.where("not exact").count() == 0
    out = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in out.collect()} == clean
    assert jaccard.one_of_each(docs.limit(0)).count() == 0
