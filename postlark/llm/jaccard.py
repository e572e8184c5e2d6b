"""N-gram Jaccard join by a token-group matrix.

Texts become sets of hashed word shingles. Four steps, each exact:

1. Shingles that a single document has cannot be shared. Counted in buckets of the hash, they leave only
   documents most of whose shingles occur elsewhere; nobody else has a partner.
2. Equal sets become one class. Classes with a common min-hash meet in blocks of bounded size, each with
   its bucket's leader, and are compared by matrix products. Links join them into groups of similar texts.
3. The matrix: for every group the union of its shingles. A shingle of one group only links nothing new,
   so just texts with enough shingles of other groups go on as queries. The rarest shingles of a query name
   candidate groups; its overlap with a group's union bounds its overlap with any member.
4. Groups whose bound is high enough are opened: the query meets their members, in blocks again.

Links between groups join them; a document's component is the smallest doc_id it reaches.

Defined cases: a text without words, or a null one, has no shingles and no links; one with fewer words than
a shingle is a single shingle; rows with the same doc_id are one document with the links of all its rows;
rows with a null doc_id are one such document, larger than all others; very long texts are whole sets; equal sets
are one class, led by its smallest doc_id; other columns, whatever their names, are ignored (one_of_each keeps
them); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import Words, bitmap, kept, mix, private, releasing, rolled, text_slices, windows

SHINGLE, SIMILAR = 5, 80
CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 60_000
BITMAP_BITS = 23
BLOCK = 256
SEEDS = 3
LAST = (1 << 63) - 1
COLUMNS = 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text's number and hash of each distinct shingle, by text and hash."""
    w = Words(texts)
    w.bytes = _LOWER[w.bytes]
    h = w.hashes()
    ok = windows(w.text, SHINGLE)
    doc, token = w.text[: len(ok)][ok], mix(rolled(h, SHINGLE))[ok] if len(ok) else np.zeros(0, np.uint64)
    before = np.cumsum(w.n_words) - w.n_words
    extra_doc, extra = [], []
    for k in range(1, SHINGLE):
        short = np.flatnonzero(w.n_words == k)
        if len(short):
            value = np.full(len(short), k, np.uint64)
            for j in range(k):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[before[short] + j])
            extra_doc.append(short)
            extra.append(value)
    if extra:
        doc, token = np.concatenate([doc, *extra_doc]), np.concatenate([token, *extra])
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def _chunk(chunk: int, ids: list[int], sizes: np.ndarray, doc: np.ndarray, token: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: shingles in the order of documents, how many each has there; and a head row."""
    n = len(ids)
    order = np.argsort(token, kind="stable")
    sorted_ = token[order]
    first = np.ones(len(order), bool)
    first[1:] = sorted_[1:] != sorted_[:-1]
    runs = np.diff(np.append(np.flatnonzero(first), len(order)))
    many = np.repeat(runs > 1, runs)
    known = np.bincount(doc[order[many]], minlength=n)  # shared already inside the chunk
    ship = order[first]
    owner = np.where(many[first], n, doc[ship])  # of those, one goes for all, marked by no owner
    bucket = (token[ship] >> np.uint64(32)) % np.uint64(buckets)
    by = np.lexsort((owner, bucket))
    bucket, owner, low = bucket[by].astype(np.int64), owner[by], token[ship][by].astype(np.uint32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    codec = pa.Codec("zstd", 1)
    rows = [(int(mix(np.array([chunk], np.uint64))[0] % np.uint64(buckets)), -1, np.array(ids, "<i8").tobytes(), np.concatenate([sizes, known]).astype("<i4").tobytes())]
    for b in np.unique(bucket).tolist():
        own = np.bincount(owner[cuts[b] : cuts[b + 1]], minlength=n + 1).astype("<u4")
        rows.append((b, n, low[cuts[b] : cuts[b + 1]].astype("<u4").tobytes(), codec.compress(own.tobytes(), asbytes=True)))
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["bucket", "chunk", "docs", "data", "more"])


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 24
    ids: list[int] = []
    sizes, docs, tokens, held = [], [], [], 0
    for batch in batches:
        own = batch.column("doc").to_pylist()
        for a, b, texts in text_slices(batch.column("text")):
            doc, token = shingle_sets(texts)
            sizes.append(np.bincount(doc, minlength=b - a))
            docs.append(doc + len(ids))
            tokens.append(token)
            ids += own[a:b]
            held += len(token)
            if held >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                yield _chunk(chunk, ids, np.concatenate(sizes), np.concatenate(docs), np.concatenate(tokens), buckets)
                chunk, ids, sizes, docs, tokens, held = chunk + 1, [], [], [], [], 0
    if ids:
        yield _chunk(chunk, ids, np.concatenate(sizes), np.concatenate(docs), np.concatenate(tokens), buckets)


def _shared(table: pa.Table) -> pa.Table:
    """For each chunk's documents, how many of the bucket's shingles some other document has."""
    codec = pa.Codec("zstd")
    heads = [r for r in table.to_pylist() if r["docs"] < 0]
    rows = [r for r in table.to_pylist() if r["docs"] >= 0]
    out = [(h["chunk"], h["data"], h["more"]) for h in heads]
    if rows:
        own = [np.frombuffer(codec.decompress(r["more"], 4 * (r["docs"] + 1), asbytes=True), "<u4") for r in rows]
        tokens = [np.frombuffer(r["data"], "<u4") for r in rows]
        flat = np.concatenate(tokens)
        weight = np.concatenate([np.repeat(np.append(np.ones(len(o) - 1, np.int8), np.int8(2)), o) for o in own])
        order = np.argsort(flat, kind="stable")
        first = np.ones(len(flat), bool)
        first[1:] = flat[order][1:] != flat[order][:-1]
        run = np.cumsum(first) - 1
        many = np.empty(len(flat), bool)
        many[order] = (np.bincount(run, weight[order]) > 1)[run]
        at = 0
        for r, o, t in zip(rows, own, tokens, strict=True):
            count = np.bincount(np.repeat(np.arange(len(o)), o)[many[at : at + len(t)]], minlength=len(o))[:-1]
            at += len(t)
            there = np.flatnonzero(count)
            out.append((r["chunk"], None, np.stack([there, count[there]]).astype("<i4").tobytes()))
    columns = list(zip(*out, strict=True))
    return pa.table({"chunk": pa.array(columns[0], pa.int64()), "ids": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary())})


def _sizes(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    ids = np.frombuffer(head["ids"], "<i8")
    size, shared = np.frombuffer(head["counts"], "<i4").reshape(2, -1).astype(np.int64)
    for r in rows:
        if r["ids"] is None:
            at, count = np.frombuffer(r["counts"], "<i4").reshape(2, -1)
            shared[at] += count
    return pa.table({"doc": pa.array(ids), "n_shingles": pa.array(size), "shared": pa.array(shared)})


def _sets(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """Sets of the documents whose bit is set: hash of the set, size, sorted hashes."""
    have = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    for batch in batches:
        keys = batch.column("key").to_numpy().view(np.uint64)
        rows = np.flatnonzero(have[(keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
        if not len(rows):
            continue
        batch = batch.take(pa.array(rows))
        for a, b, texts in text_slices(batch.column("text")):
            doc, token = shingle_sets(texts)
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            # Two sums of mixed hashes: equal sets have equal ones, and others have not, but for one in 2**128.
            total = [np.add.reduceat(np.append(mix(token ^ np.uint64(s)), np.uint64(0)), np.minimum(cut[:-1], len(token))) for s in (1, 2)]
            rows = [(i, token[cut[i] : cut[i + 1]]) for i in range(b - a) if cut[i + 1] > cut[i]]
            take = [i for i, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc")[a:b].take(pa.array(take, pa.int64())), pa.array(total[0][take].view(np.int64)), pa.array(total[1][take].view(np.int64)), pa.array([len(t) for _, t in rows], pa.int64()), pa.array([t.astype("<u8").tobytes() for _, t in rows], pa.binary())],
                ["doc", "print_1", "print_2", "n", "tokens"],
            )


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, by products over blocks of their common members."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    if not len(common):
        return out.astype(np.int64)

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        ok = common[at] == flat
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], row[ok][order]

    col_a, row_a = places(flat_a, a)
    col_b, row_b = places(flat_b, b)
    for first in range(0, len(common), COLUMNS):
        parts = []
        for col, row, n in ((col_a, row_a, len(a)), (col_b, row_b, len(b))):
            lo, hi = np.searchsorted(col, [first, first + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(common) - first)), np.float32)
            m[row[lo:hi], col[lo:hi] - first] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _linked(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    both = overlaps(a, b)
    n_a, n_b = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None]
    return 100 * both >= SIMILAR * (n_a + n_b - both)


def _block(table: pa.Table) -> pa.Table:
    """Links of a block as stars: each set with the least document of its part of the block."""
    rep, sets = table.column("rep").to_numpy(), [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
    rep, at = np.unique(rep, return_index=True)
    link = _linked([sets[i] for i in at], [sets[i] for i in at])
    label = np.arange(len(rep))
    while True:  # the least label of all neighbours, until nothing changes
        low = np.where(link, label[None], len(rep)).min(1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(len(rep)))
    return pa.table({"a": pa.array(rep[other]), "b": pa.array(rep[label[other]])})


def _min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, "<u8") for x in batch.column("tokens").to_pylist()]
        for seed in range(SEEDS):
            salt = mix(np.array([seed + 101], np.uint64))
            low = [int(mix(s ^ salt).min().view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([seed] * len(low), pa.int32()), pa.array(low, pa.int64())], ["rep", "seed", "low"])


def components(nodes: DataFrame, edges: DataFrame, name: str = "components") -> DataFrame:
    """node, comp: the least node that each reaches. Labels spread along edges and jump to their label's label; every round is written."""
    edges = kept(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name + "-edges")
    labels = kept(nodes.select("node", F.col("node").alias("comp")), name)
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        step = kept(step, name + "-step")
        # A component's least node labels all of it and is its own label: only labels that lead on are joined back.
        leads = step.where("next < node").select(F.col("node").alias("next"), F.col("next").alias("far")).join(step.select("next").distinct(), "next", "left_semi")
        both = kept(step.join(leads, "next", "left").select("node", F.least("next", "far").alias("comp"), "was"), name)
        if not both.where("comp <> was").limit(1).count():
            return both.select("node", "comp")
        labels = both.select("node", "comp")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a set."""
    for batch in batches:
        rep, comp, n = (batch.column(c).to_numpy() for c in ("rep", "comp", "n"))
        raw = batch.column("tokens").to_pylist()
        for k in range(0, len(raw), 512):
            tokens = [np.frombuffer(x, "<i8") for x in raw[k : k + 512]]
            size = [len(t) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c[k : k + 512], size)) for c in (rep, comp, n)] + [pa.array(np.concatenate(tokens))], ["rep", "comp", "n", "token"])


def _opened(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links of queries with the members of one block of a group."""
    out: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        queries, members = ([(np.frombuffer(x, "<u8"), r) for x, r in zip(t.column("tokens").to_pylist(), t.column("rep").to_pylist(), strict=True)] for t in (left, right))
        for side in (queries, members):
            side.sort(key=lambda s: len(s[0]))
        q, m = (np.array([r for _, r in side], np.int64) for side in (queries, members))
        queries, members = ([s for s, _ in side] for side in (queries, members))
        for i in range(0, len(q), BLOCK):
            for j in range(0, len(m), BLOCK):
                large, small = queries[i : i + BLOCK], members[j : j + BLOCK]
                if len(small[0]) > len(large[-1]) or 100 * len(small[-1]) < SIMILAR * len(large[0]):
                    continue  # members of such sizes are no smaller set of these queries
                x, y = np.nonzero(_linked(large, small))
                out += zip(q[i + x].tolist(), m[j + y].tolist(), strict=True)
    return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def _across(sets: DataFrame) -> DataFrame:
    """Links between groups. sets: rep, comp, n, tokens."""
    schema = "rep long, comp long, n long, token long"
    rows = sets.mapInArrow(_exploded, schema)
    wide = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    # ceil(SIMILAR * n / 100) of a set's shingles have to be of other groups too.
    need = F.ceil(F.col("n") * SIMILAR / 100)
    some = rows.join(wide, "token").groupBy("rep", "n").agg(F.count("*").alias("there")).where(F.col("there") >= need).select("rep")
    sets = kept(sets.join(some, "rep", "left_semi"), "queries")
    rows = sets.mapInArrow(_exploded, schema)
    matrix = kept(rows.groupBy("token", "comp").agg(F.count("*").alias("times")), "matrix")
    often = matrix.groupBy("token").agg(F.sum("times").alias("df"), F.count("*").alias("groups")).where("groups > 1")
    ranked = rows.join(often.select("token", "df"), "token").groupBy("rep", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by"))
    # Of a set's shingles, those of its own group alone come first: they are rarest for others and match nobody.
    # A larger set needs SIMILAR / 100 of its shingles in common, a smaller one 2 t / (1 + t) of them for t of that:
    # so a smaller one is found by the first ninth of its shingles, and a shingle that very many share is seldom there.
    alone = F.col("n") - F.size("by")
    probe, index = F.col("n") - need + 1 - alone, F.col("n") - F.ceil(F.col("n") * 2 * SIMILAR / (100 + SIMILAR)) + 1 - alone

    def first(upto: Column, *columns: str) -> DataFrame:
        return ranked.where(upto > 0).select(*columns, "n", F.explode(F.slice("by", 1, upto.cast("int"))).alias("x")).select(*columns, "n", "x.token")

    found = first(index, "comp").groupBy("token", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    asked = first(probe, "rep", "comp").withColumnRenamed("comp", "own")
    fits = (F.col("comp") != F.col("own")) & (F.col("least") <= F.col("n")) & (100 * F.col("most") >= SIMILAR * F.col("n"))
    candidates = asked.join(found, (asked["token"] == found["token"]) & fits).select("rep", "own", "n", "comp").distinct()
    tokens = rows.select("rep", "token")
    bound = candidates.join(tokens, "rep").join(matrix.select("token", "comp"), ["token", "comp"]).groupBy("rep", "n", "comp").agg(F.count("*").alias("most"))
    open_ = kept(bound.where(F.col("most") >= need).select("rep", F.col("comp").alias("group")), "open")
    sizes = sets.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = sets.join(sizes, "comp").select(F.col("comp").alias("group"), F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "rep", "tokens")
    # Queries of a group go to each of its blocks; many queries of one group are dealt out as well.
    asked = open_.join(sizes, open_["group"] == sizes["comp"]).join(open_.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("deals")), "group")
    asked = asked.withColumn("deal", F.pmod(F.xxhash64("rep"), "deals")).select("group", "deal", "deals", "blocks", "rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    queries = asked.join(sets.select("rep", "tokens"), "rep").select("group", "block", "deal", "rep", "tokens")
    deals = asked.select("group", "deals").distinct()
    members = members.join(deals, "group").select("group", "block", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "rep", "tokens")
    return queries.groupBy("group", "block", "deal").cogroup(members.groupBy("group", "block", "deal")).applyInArrow(_opened, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    buckets = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").cast("string").alias("text"))
    chunks = texts.mapInArrow(lambda batches: releasing(_chunks(batches, buckets)), "bucket int, chunk long, docs int, data binary, more binary")
    counted = chunks.groupBy("bucket").applyInArrow(_shared, "chunk long, ids binary, counts binary")
    sizes = kept(counted.groupBy("chunk").applyInArrow(_sizes, "doc long, n_shingles long, shared long"), "sizes")
    maybe = sizes.where((F.col("n_shingles") > 0) & (100 * F.col("shared") >= SIMILAR * F.col("n_shingles")))
    bits = bitmap(maybe.select(F.xxhash64("doc").alias("hash")), BITMAP_BITS)
    found = texts.select("doc", F.xxhash64("doc").alias("key"), "text").mapInArrow(lambda batches: releasing(_sets(batches, bits)), "doc long, print_1 long, print_2 long, n long, tokens binary")
    found = kept(found, "sets")
    classes = kept(found.groupBy("print_1", "print_2").agg(F.min("doc").alias("rep"), F.count("*").alias("times")), "classes")
    member = found.select("doc", "print_1", "print_2").join(classes, ["print_1", "print_2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    # A document with several rows may stand for several classes: its sets keep apart by their prints.
    sets = found.join(classes.select("print_1", "print_2", "rep"), ["print_1", "print_2"]).where("doc = rep").dropDuplicates(["print_1", "print_2"]).select("rep", "n", "tokens")
    sets = kept(sets, "class-sets")

    lows = kept(sets.select("rep", "tokens").mapInArrow(_min_hashes, "rep long, seed int, low long"), "lows")
    buckets_ = lows.groupBy("seed", "low").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    placed = lows.join(buckets_.select("seed", "low", "blocks"), ["seed", "low"]).select("seed", "low", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "rep")
    led = buckets_.where("blocks > 1").select("seed", "low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("rep"))
    near = placed.union(led).join(sets.select("rep", "tokens"), "rep").groupBy("seed", "low", "block").applyInArrow(_block, "a long, b long")
    near = kept(near, "near")
    groups = components(sets.select(F.col("rep").alias("node")).distinct(), near, "groups")
    more = _across(sets.join(groups, sets["rep"] == groups["node"]).select("rep", "comp", "n", "tokens"))

    edges = member.union(near).union(kept(more, "across"))
    final = components(found.select(F.col("doc").alias("node")).distinct(), edges, "components")
    out = sizes.join(final, sizes["doc"] == final["node"], "left")
    return out.select(
        F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "n_shingles", F.when(F.coalesce("comp", "doc") < LAST, F.coalesce("comp", "doc")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that a link, or a chain of links, leads to one of a smaller doc_id; of rows with one doc_id one stays.

    Documents without shingles and rows without a doc_id, which nothing tells apart, all stay. Which of
    several rows of a kept doc_id stays is settled by the least text.
    """
    found = jaccard_components(docs)
    name, number = private(docs, "doc", "n")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 and doc_id is not null").select(F.col("doc_id").alias(name))
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    if not again.limit(1).count():
        return left
    lead = Window.partitionBy(F.col("doc_id").cast("long")).orderBy(F.col("text").asc_nulls_last())
    twice = left.join(again, F.col("doc_id").cast("long") == F.col(name), "left_semi").withColumn(number, F.row_number().over(lead)).where(F.col(number) == 1).drop(number)
    return left.join(again, F.col("doc_id").cast("long") == F.col(name), "left_anti").unionByName(twice)
