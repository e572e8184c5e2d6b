"""Each corpus operator against brute force or the library, over texts with the cases that break things."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlark.llm import bpe, decontamination, jaccard, main_text, passages, pii, queries, repetition, site_quality, token_store, toxicity

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, hash long, comp int"
MULTI, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def prose(rng, n):
    parts = ["the", "of", "an", "ing", "er", "ción", "è", "ß", "tion", "wh"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) + rng.choice(["", "", "", ".", ","]) for _ in range(n)).replace(". ", ".\n", 1)


def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    shared = prose(rng, 60)
    out = [None, "", " \n\t ", "one", "two words", base, base, base.upper(), base + " tail", "x " + base[: len(base) // 2], "Shti " * 200, "a\x1cb c\x85d e　f", "中文字 🙂 é İ ß", "y" * 3000, "  double  blanks \n\n lines "]
    out += [prose(rng, 40) + " " + shared + " " + prose(rng, rng.randint(0, 30)) for _ in range(6)]
    words = base.split(" ")
    for _ in range(12):  # near copies
        w = list(words)
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
        out.append(" ".join(w))
    return out + [prose(rng, 4000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "k", 1, 2) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_repetition(docs, empty):
    got = by_id(repetition.repetition_rules(docs))
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines, seen = 0, set()
        for line in (t or "").split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), lines, len(covered)), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert got[5]["kept"] and not got[10]["kept"]
    assert repetition.repetition_rules(empty).count() == 0


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got, start = by_id(token_store.token_store(docs, WORDS)), 0
    for i, x in enumerate(texts()):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert token_store.token_store(empty, WORDS).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in token_store.token_store(twice, WORDS).orderBy("start").collect()] == [(None, 0), (1, 2), (1, 4)]


def test_token_store_is_the_plain_library_call(spark):
    """Special strings, marks that combine, other scripts, and texts taken in parts."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(WORDS), random.Random(3)
    glue = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "Ab", " ", "  ", "\n", "'s", "don't", "É", "e\u0301", "ß", "×", "12", "x1", "...", "!?", "中文", "Σς", "İ", "\xa0", "\x85", "\x1c", "🙂", "</w>", "&"]
    xs = ["".join(rng.choices(glue, k=rng.randint(0, 16))) for _ in range(1500)] + ["a<|endoftext|>b c", " ".join(rng.choices(glue, k=4000))]
    got = by_id(token_store.token_store(spark.createDataFrame(list(enumerate(xs)), "doc_id long, text string"), WORDS))
    for i, x in enumerate(xs):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(x)
    long = [x.encode() for x in ("", prose(rng, 3000), "x", prose(rng, 900))]
    encoder = token_store._Encoder(WORDS)
    whole = encoder.encode(long, 1)
    cut = [list(parts) for parts in token_store.parts(long, 500)]
    assert len(cut) > 8 and b"".join(p for some, _ in cut for p in some) == b"".join(long)
    assert whole[0].tolist() == [i for x in long for i in [*t.encode(x.decode(), add_special_tokens=False).ids, 1]]
    some = [encoder._part(p)[0].tolist() for p, _ in cut]
    assert [i for x in some for i in x] == [i for x in long for i in t.encode(x.decode(), add_special_tokens=False).ids]


def test_kept_pieces_stay_right_when_trimmed(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "KEPT_PIECES", 50)
    encoder, t, rng = token_store._Encoder(WORDS), Tokenizer.from_file(WORDS), random.Random(1)
    for _ in range(20):
        x = prose(rng, 60)
        assert encoder.encode([x.encode()], 1)[0].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]


def test_packed_blocks():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, np.int64), np.array([7]), rng.integers(0, 50000, 1000), np.r_[rng.integers(0, 8, 700), [2**31 - 1], rng.integers(0, 8, 300)], np.full(513, 9)):
        image = token_store.pack(ids.astype("<u4"))
        assert (token_store.unpack(image) == ids).all()
        for first in range(-(-len(ids) // token_store.BLOCK)):
            assert (token_store.unpack(image, first, first + 1) == ids[first * token_store.BLOCK : (first + 1) * token_store.BLOCK]).all()


def test_byte_bpe(docs, empty):
    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.decode(bpe.encode(docs, MULTI, P.PATTERN), MULTI))
    both = by_id(bpe.encode_decode(docs, MULTI, P.PATTERN, with_text=True))
    for i, x in enumerate(texts()):
        assert got[i]["ids"] == t.encode_ordinary(x or "") == both[i]["ids"], i
        assert bytes(got[i]["decoded"]).decode() == (x or "") and both[i]["text"] == x
    assert bpe.encode_decode(empty, MULTI, P.PATTERN).count() == 0


def test_byte_bpe_on_odd_pieces():
    import tiktoken

    codec = bpe.Codec(MULTI, P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    xs = ["".join(rng.choice("ab cd  é\n\t 'st1²½٣中🙂́\xa0\x1c\x85.,!-_ßİ ") for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["ab" * 900, "don't  stop ", " " * 300 + "x", "x" * 63 + "y" * 5]
    # Long pieces: runs of one letter, of two, random letters and signs, another script.
    xs += ["y" * 3001, "".join(rng.choices("aab", k=2000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000)), "".join(rng.choices("abcxyzABCXYZ0123456789+/", k=2000)), "".join(rng.choices("中文字国人大的是不了在有", k=900))]
    texts = [x.encode() for x in xs]
    ids, count = codec.encode(texts)
    ends = np.cumsum(count)
    for x, a, b in zip(xs, ends - count, ends, strict=True):
        assert ids[a:b].tolist() == t.encode_ordinary(x), repr(x)
    assert codec.decode(ids, count) == texts
    long = [x for x in xs if len(x) > 200]
    some = [codec._part(p)[0].tolist() for p, _ in bpe.parts([x.encode() for x in [prose(rng, 2000), *long]], 300)]
    assert len(some) > 20
    again = bpe.Codec(MULTI, r"\w+|\W+")  # a pattern that is not followed by bytes
    other = tiktoken.Encoding("other", pat_str=r"\w+|\W+", mergeable_ranks=codec.ranks, special_tokens={})
    assert again.encode(texts[:300])[0].tolist() == [i for x in xs[:300] for i in other.encode_ordinary(x)]


def test_passages(spark, docs, empty):
    first, ws = {}, {i: WORD.findall(t or "") for i, t in enumerate(texts())}
    for i, w in ws.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = by_id(passages.remove_repeated(docs))
    for i, w in ws.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"], got[i]["kept_sha256"]) == (len(w), sum(gone), left, hashlib.sha256(left.encode()).hexdigest()), i
    assert passages.remove_repeated(empty).count() == 0
    t = " ".join(map(str, range(20)))
    same = spark.createDataFrame([(3, t), (3, t), (3, t + " more"), (None, t), (9, t)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in passages.remove_repeated(same).collect()) == [(-1, 20), (3, 0), (3, 0), (3, 0), (9, 20)]


def test_passages_tell_rows_of_one_doc_id_apart(spark):
    """Rows that share a doc_id and a short key lose only what is repeated; so do many rows without a doc_id."""
    rng = random.Random(21)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = say(20)
    rows = [(1, shared), (7, shared + " " + say(12)), (7, say(30)), (7, say(5) + " " + shared)] + [(None, say(20) + (" " + shared if i % 50 == 0 else "")) for i in range(600)]
    want = sorted((d or -1, len(t.split()), 20 if d != 1 and shared in t else 0) for d, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    run = lambda: sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in passages.remove_repeated(df).collect())
    assert run() == want
    texts = [t.encode() for _, t in rows]
    assert len({passages.words_check(t) for t in texts}) == len(texts) and passages.words_check(b"a  b") == passages.words_check([b"a", b"b"])
    import pyarrow as pa

    cut = [{"start": 0, "stop": 20, "check": passages.words_check(shared.encode())}]
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 7], "text": [rows[1][1], rows[2][1]], "ranges": [cut, cut]})  # as if both had one key
    assert [r["n_removed"] for r in next(passages._kept(iter([batch]), True)).to_pylist()] == [20, 0]


def test_main_text(spark):
    page = """<html><head><title>t</title><script>var x="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=1>Menu</a></li></ul></nav><div class="ad">Buy &lt;now&gt;</div>
    <article><h1>Head &amp; line</h1><p>First   <b>bold</b><br>text that is long enough to matter here.<p>Second&nbsp;one.</p><aside>side</aside><div class="comments"><p>I agree with all of this a lot.</p></div></article><footer>&copy; me</footer>"""
    cases = {page: "Head & line\nFirst bold text that is long enough to matter here.\nSecond one.", "": "", None: "", "<p>plain": "plain", "just words": "just words", "<article><p>cut off mid <b": "cut off mid", "<p>a</p><!-- open": "a", '<p>a</p><img alt="open': "a"}
    rows = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate(cases)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in main_text.main_text(rows).collect()}
    assert [got[i]["text"] for i in range(len(cases))] == list(cases.values())
    assert got[0]["n_chars"] == len(cases[page])
    assert main_text.main_text(rows.limit(0)).count() == 0


PARAGRAPH = "The long paragraph of this text says many things about the matter at hand, and number {} goes on for a while."
LAYOUTS = {
    "article": ("<nav><a href=1>x</a></nav><div class='ad'>Buy now and save a lot</div><article><h1>Title</h1>{p}<section class='share-prices'>{p}</section></article><footer>foot</footer>", 2),
    "plain boxes": ("<div class='top'><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div id='content'><h1>Title</h1>{p}{p}<div id='related-work'>{p}</div></div><div class='sidebar'>Some things beside</div>", 3),
    "tables": ("<table><tr><td><a href=1>one</a><br><a href=2>two</a></td><td><h1>Title</h1>{p}{p}<br>{p}</td></tr></table>", 3),
    "body alone": ("<h1>Title</h1>{p}{p}<ul><li><a href=1>link one</a><li><a href=2>link two</a></ul>", 2),
    "many links": ("<div><ul>" + "".join(f"<li><a href={i}>a long link text with number {i}</a></li>" for i in range(40)) + "</ul></div><div><h1>Title</h1>{p}{p}{p}</div>", 3),
    "two boxes": ("<div class='page'><div><h1>Title</h1>{p}{p}</div><div>{p}{p}{p}</div></div><div class='site-footer'>All rights</div>", 5),
    "comments": ("<main><header><h1>Title</h1></header><div class='body'>{p}{p}</div><div class='comments'><p>I agree with all of this, as it says many things</p></div></main>", 2),
    "named box that is the text": ("<div class='widget'><h1>Title</h1>{p}{p}</div><p>little</p>", 2),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_main_text_of_layouts(layout):
    page, n = LAYOUTS[layout]
    says = [PARAGRAPH.format(i) for i in range(n)]
    assert page.count("{p}") == n
    got = main_text.extract("<html><body>" + page.replace("{p}", "<p>{}</p>").format(*says) + "</body></html>").split("\n")
    assert [x for x in got if x != "little"] == ["Title", *says]


VOICES = "".join(f"<p>I have read all of this and say, as reader number {k}, that I do not agree with any part of what it says here.</p>" for k in range(6))
OTHERS = {
    "talk after the article": ("<article><h1>Title</h1>{p}{p}{p}{p}</article><section class='xyz'>" + VOICES + "</section>", 4),
    "talk beside boxes": ("<div class='story'><h1>Title</h1>{p}{p}{p}</div><div class='below'>" + VOICES + "</div>", 3),
    "named talk in the article": ("<article><h1>Title</h1>{p}{p}{p}{p}{p}{p}{p}<div class='responses'>" + VOICES[: len(VOICES) // 2] + "</p></div></article>", 7),
    "two articles": ("<div class='all'><article><h1>Title</h1>{p}{p}</article><article>{p}{p}{p}</article></div>", 5),
    "slogan": ("<div class='top'>We bring all of the world to your very own door, each and every day of the year, for all and for free</div><article><h1>Title</h1>{p}</article>", 1),
    "head alone": ("<div class='k'><h1>Title</h1></div><div class='text'>{p}{p}{p}</div>", 3),
    "head in a group": ("<main><hgroup><h1>Title</h1></hgroup><div>{p}{p}</div></main><div>" + VOICES + "</div>", 2),
    "sections": ("<div id='c'><h1>Title</h1><section>{p}{p}</section><section>{p}{p}</section></div><ul>" + "".join(f"<li><a href={i}>more on the matter of number {i} for you</a></li>" for i in range(9)) + "</ul>", 4),
    "logo": ("<div class='bar'><h1><a href='/'>The Site of All</a></h1></div><div class='text'><h2>Title</h2>{p}{p}{p}</div>", 3),
    "deep": ("<div><div><div><div><h1>Title</h1></div><div><div>{p}{p}</div></div></div></div></div><div><div>" + VOICES + "</div></div>", 2),
}


def _of_layout(layout):
    page, n = OTHERS[layout]
    says = [PARAGRAPH.format(i) for i in range(n)]
    assert page.count("{p}") == n
    return "<html><body>" + page.replace("{p}", "<p>{}</p>").format(*says) + "</body></html>", ["Title", *says]


@pytest.mark.parametrize("layout", OTHERS)
def test_headlines_in_and_talk_out(layout):
    page, want = _of_layout(layout)
    assert main_text.extract(page).split("\n") == want


#: No h1, no names, no marks: how dense the parts are is all there is.
DENSE = {
    "links first": ("<div>" + "".join(f"<p><a href={k}>Some link text of number {k}</a></p>" for k in range(30)) + "</div><div>{p}{p}{p}</div>", 3),
    "cells": ("<table><tr><td>" + "".join(f"<p><a href={k}>Link number {k} in a cell</a></p>" for k in range(25)) + "</td><td>{p}{p}{p}</td></tr></table>", 3),
    "rows of figures": ("<div>{p}{p}{p}</div><div>" + "".join(f"<p><a href={k}>{k}</a></p>" for k in range(60)) + "</div>", 3),
    "nested": ("<div><div>" + "".join(f"<p><a href={k}>See also the page of number {k}</a></p>" for k in range(20)) + "</div><div><div>{p}{p}</div></div></div>", 2),
}


def _dense(layout):
    page, n = DENSE[layout]
    says = [PARAGRAPH.format(i) for i in range(n)]
    return "<html><body>" + page.replace("{p}", "<p>{}</p>").format(*says) + "</body></html>", says


def test_density_decides(monkeypatch):
    """With one density for all, most of these come out wrong."""
    pages = [_dense(n) for n in DENSE]
    assert [n for n, (page, want) in zip(DENSE, pages, strict=True) if main_text.extract(page).split("\n") != want] == []
    monkeypatch.setattr(main_text, "_density", lambda chars, *_: float(chars > 0))
    assert sum(main_text.extract(page).split("\n") != want for page, want in pages) >= 3


def test_main_text_of_deep_pages():
    """Deep, unclosed and badly nested pages take time in proportion to their length."""
    import time

    start = time.perf_counter()
    assert main_text.extract("<div>" * 50_000 + "x y" + "</div>" * 50_000) == "x y"
    for page in ("<b>" * 20_000 + "<div></div>" * 20_000 + "text", "<b>" * 20_000 + "<li></li>" * 20_000 + "text", "<div class=ad>" * 30_000 + "text", "<span>" * 50_000 + "text" + "</p>" * 20_000):
        assert main_text.extract(page) == "text"
    assert time.perf_counter() - start < 40


def test_decontamination(spark, docs, empty):
    item = "If a farmer has 12 apples and sells 5 apples to Maria then how many apples are left with the farmer at the end"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    swap = item.replace("12", "40").replace(" 5 ", " 7 ").replace("Maria", "Peter")
    rows = [(1, "Intro words here. " + item + ". More words"), (2, "Before. " + swap), (3, item.replace("12", "5")), (4, "If a farmer has no apples at all today"), (5, None), (6, item.upper()), (6, item.upper())]
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["changed"] > 0) for r in got if r["doc_id"] in (1, 2)) == [(1, 1, False), (2, 1, True)]
    assert {r["doc_id"] for r in got} <= {1, 2, 6}  # in 3 one value stands for two of the item's
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_leaking(docs, bench).columns == docs.columns and decontamination.drop_leaking(docs, bench).count() == docs.count()


def test_decontamination_keeps_windows_word_for_word(spark, tmp_path):
    item = "If a farmer has 12 apples and sells 5 apples to Maria then how many apples are left with the farmer at the end of a day for Maria"
    rows = [(1, item.replace("12", "5")), (2, item[: item.rindex("Maria")] + "Peter"), (3, item.replace("12", "5").replace("with the", "by the")), (4, item), (5, item.replace("12", "40").replace(" 5 ", " 7 "))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (round(r["share"] * 21), r["changed"]) for r in queries.op8_decontamination(spark, str(tmp_path)).collect()}
    assert got == {1: (16, 0), 2: (21, 1), 4: (21, 0), 5: (21, 2)}  # in 3 too few windows are left
    assert [r["doc_id"] for r in decontamination.drop_leaking(docs, bench).collect()] == [3]


def test_decontamination_searches_items_without_template_windows(spark):
    items = {1: "What is 2 + 2?", 2: "Who Wrote The Old Song About Blue Rivers And Red Hills", 3: "1 2 3 4 5 6 7 8 9 10 11 12", 4: "Yes.", 5: "", 6: "17 - 4 ="}
    texts = {
        1: "He asked: what is 2 + 2? Nobody knew", 2: "What is 2 - 2? And what is 3 + 2?", 3: "As in " + items[2] + ", so here", 4: "Numbers: 1 2 3 4 5 6 7 8 9 10 11 12.", 5: "Numbers: 1 2 3 4 5 6 7 8 9 99 11 12.",
        6: 'They said "yes" to it', 7: "yesterday 17 + 4 =", 8: "Work out (17 - 4 = 13)", 9: None, 10: "Who wrote the old song about", 11: "what is 2 +",
    }
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["changed"]) for r in decontamination.leaks(docs, bench, copied=True).collect())
    assert got == [(1, 1, 0), (3, 2, 0), (4, 3, 0), (6, 4, 0), (8, 6, 0)]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark, empty):
    rng = random.Random(4)
    glue = ["@", ".", "-", " ", "+", "a", "b1", "é", "12", "4111 1111 1111 1111", "4111111111111111", "x@y.z", "10.0.0.1", "256.1.1.1", "+1 (523) 555-1055", "+44", "..", "--", "%", "_", "🙂", "1.2.3.4.5.6.7.8", "\n"]
    xs = ["".join(rng.choices(glue, k=rng.randint(0, 14))) for _ in range(1500)] + [None, "", "a@b.c_d@e.f", "9" * 2000, "a" * 20000 + "@", "+" + "1 " * 3000]
    df = spark.createDataFrame(list(enumerate(xs)), "doc_id long, text string")
    got = by_id(pii.find_pii(df).select("doc_id", pii.listed(F.col("base_spans")).alias("s")))
    for i, x in enumerate(xs):
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, x or "") if valid(k, m[0]))
        assert got[i]["s"] == want, repr(x)
    assert pii.find_pii(empty).count() == 0


def test_pii_added_and_redacted(spark):
    rows = [(1, "my IBAN is GB82 WEST 1234 5698 7654 32 ok", 5), (2, "GB82 WEST 1234 5698 7654 33", 5), (3, "ssn 123-45-6789", 5), (4, "code 123-45-6789", 5), (5, None, None), (6, "é mail a@b.co, call (555) 123-4567", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kinds = {r["doc_id"]: [s["kind"] for s in r["added_spans"]] for r in pii.find_pii(df).collect()}
    assert kinds == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: [], 6: ["local_phone"]}
    got = by_id(pii.redact(df))
    assert got[6]["text"] == "é mail [EMAIL], call [LOCAL_PHONE]" and got[6]["n_chars"] == len(got[6]["text"]) and got[5]["text"] is None and got[4]["n_chars"] == 5


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, up = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in up}


def test_jaccard(spark, docs, empty):
    want = brute_components(list(enumerate(texts())))
    got = jaccard.jaccard_components(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(shingles(t)), want[i]) for i, t in enumerate(texts())}
    assert jaccard.jaccard_components(empty).count() == 0
    t = prose(random.Random(9), 30)
    rows = spark.createDataFrame([(5, t), (5, t + " a"), (None, t), (7, t), (None, ""), (8, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.jaccard_components(rows).collect())
    assert got == [(-1, 5), (-1, 5), (5, 5), (5, 5), (7, 5), (8, 8)]
    assert sorted((r["doc_id"] or -1) for r in jaccard.one_of_each(rows).collect()) == [-1, -1, 5, 8]


def test_jaccard_between_groups(spark):
    """Many sets on either side of the limit that share one long passage, so that groups meet."""
    rng = random.Random(11)
    core, rows = [f"w{k}" for k in range(60)], []
    for i in range(160):
        rows.append((i, " ".join([*core, *(f"u{rng.randrange(40)}" for _ in range(rng.randrange(0, 24)))])))
    want = brute_components(rows)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 3


def labelled(spark, n=600):
    rng, rows, labels = random.Random(6), [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.2, rng.random() < 0.25
        t = prose(rng, 80)
        if junk:
            t = " ".join([rng.choice(["Shti", "Hare"])] * 90)
        if toxic:
            t += " " + " ".join(rng.choice(["gobshite", "worthless", "scumbag"]) for _ in range(3)) + " " + prose(rng, 5)
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        if i % 5:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None, None, None, 0), (n + 1, "", "en", "s9", 0), (n + 2, "you w0rthless scumbagg " + prose(rng, 60), "en", "s1", 9), (n + 3, 'she said "worthless" was a word ' + prose(rng, 60), "en", "s1", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([*labels, (None, 1, 1), (999_999, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got, truth = by_id(toxicity.toxicity(docs, labels)), {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = [i for i in truth if i in got and got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    right = sum(got[i]["predicted"] == truth[i] for i in held) / len(held)
    assert right > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[602]["score"] > got[603]["score"] and got[602]["hits"] and got[600]["predicted"] == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_words_under_a_beginning_keep_their_automaton(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, prose(rng, 60) + (" " + rng.choice(["gobshite", "gobshitery", "gobshitish"]) if toxic else "")))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(t[0] != "=" and "gobshite".startswith(t) for t in lexicon.weights)
    odd = spark.createDataFrame([(1, "you gibshite"), (2, "you gbshitery"), (3, "you gobshites"), (4, "you there")], "doc_id long, text string")
    got = by_id(toxicity.score(odd, lexicon))
    assert got[1]["hits"] == ["gibshite"] and got[2]["hits"] == ["gbshitery"] and got[3]["hits"] and not got[4]["hits"]


def test_automaton_is_levenshtein():
    words = ["=worthless", "=idiot", "=loser", "=ab"]
    a = toxicity.Automaton(tuple(words))

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i, *row[1:]], row
            for j, e in enumerate(y, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != e))
        return row[-1]

    rng = random.Random(8)
    tried = {"".join(rng.choices("worthlesidab", k=rng.randint(1, 11))) for _ in range(300)}
    for w in [x[1:] for x in words]:
        for _ in range(200):
            s = list(w)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(s) + 1)
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
            tried.add("".join(s))
    for t in sorted(x for x in tried if x):
        allowed = any(distance(t, w[1:]) <= (2 if len(w) > 9 else 1 if len(w) > 5 else 0) for w in words)
        assert bool(a.hits(t)[0]) == allowed, t


def test_site_quality(spark):
    docs, labels = labelled(spark)
    got, truth = by_id(site_quality.score(docs, labels)), {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    assert sum(got[i]["kept"] == bool(truth[i]) for i in truth if i in got) / (len(truth) - 2) > 0.97 and len(got) == docs.count()
    post, overall = site_quality.site_posteriors(docs, labels)
    rates = {(r["__site"], r["__part"]): r["part_rate"] for r in post.collect()}
    assert 0 < overall < 1 and rates["s9", "en"] == pytest.approx(overall) and ("\0", "\0") in rates
    none = site_quality.score(docs, labels.limit(0))
    assert none.where("kept").count() == docs.count()
    assert site_quality.score(docs.limit(0), labels).count() == 0
