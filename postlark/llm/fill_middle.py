"""Fill-in-middle: documents as piece tables over two buffers that never change.

The buffers are a document's text and the sentinels. A piece is a descriptor (buffer, start, length in code
points) and a document a list of them: cutting splits a descriptor in two, a form permutes the three parts
between sentinels, the inverse permutation picks them out again. Descriptors are columns; text is copied only
where ``outputs`` asks for it, and ``digests`` streams the bytes that descriptors point at into the hash.

Where a text is cut, and its form, come from a hash of its doc_id alone.

Defined cases: a null or empty text is plain and its output is empty; a text that holds a sentinel is plain; a
null doc_id counts as no digits; rows of the same doc_id are cut at the places of that id, each by its own length;
parts may be empty; very long texts are hashed where they stand; other columns stay, but those named as the
results are replaced, in any case; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import private

TEXT, SENTINEL = 0, 1
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
_BUFFER = "".join(SENTINELS.values())
#: Parts (0 prefix, 1 middle, 2 suffix) of each form in their order, each after its sentinel.
FORMS = {"psm": (("prefix", 0), ("suffix", 2), ("middle", 1)), "spm": (("suffix", 2), ("prefix", 0), ("middle", 1))}
#: Of 100 documents so many stay plain, and of 100 others so many are spm.
PLAIN, SPM = 10, 20


def piece(buffer: int, start: Column | int, length: Column | int) -> Column:
    whole = [F.lit(x).cast("int") if isinstance(x, int) else x.cast("int") for x in (buffer, start, length)]
    return F.struct(whole[0].alias("buffer"), whole[1].alias("start"), whole[2].alias("length"))


def cut_first(pieces: Column, at: Column) -> Column:
    """pieces with the first of them split ``at`` code points from its start; either half may be empty."""
    first = F.get(pieces, F.lit(0))
    left = F.struct(first["buffer"].alias("buffer"), first["start"].alias("start"), at.cast("int").alias("length"))
    right = F.struct(first["buffer"].alias("buffer"), (first["start"] + at).cast("int").alias("start"), (first["length"] - at).cast("int").alias("length"))
    return F.concat(F.array(left, right), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))))


def sentinel(name: str) -> Column:
    return piece(SENTINEL, _BUFFER.index(SENTINELS[name]), len(SENTINELS[name]))


def arranged(parts: Column, form: Column) -> Column:
    """The output's pieces: the three parts as the form orders them, or all parts as they are where it is plain."""
    out = F.when(form == "plain", parts)
    for name, order in FORMS.items():
        out = out.when(form == name, F.array(*(x for s, k in order for x in (sentinel(s), F.get(parts, F.lit(k))))))
    return out


def restored(pieces: Column, form: Column) -> Column:
    """The text's pieces, from an output's pieces and its form: the inverse of ``arranged``."""
    out = F.when(form == "plain", pieces)
    for name, order in FORMS.items():
        place = {part: 2 * i + 1 for i, (_, part) in enumerate(order)}
        out = out.when(form == name, F.array(*(F.get(pieces, F.lit(place[k])) for k in range(3))))
    return out


def fill_middle(docs: DataFrame, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and pieces, the output as descriptors; no text is copied and nothing shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest, size, cuts, parts, ends = private(docs, "digest", "size", "cuts", "parts", "ends")
    # Step by step, so that no step repeats the expressions of the one before.
    rows = docs.withColumns({digest: F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), size: F.char_length(text).cast("long")})
    rows = rows.withColumn(cuts, F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))))
    marked = F.lit(False)
    for s in SENTINELS.values():
        marked = marked | F.contains(text, F.lit(s))
    h = [F.get(cuts, F.lit(k)) for k in range(4)]
    form = F.when((F.col(size) == 0) | marked | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, ends: F.sort_array(F.array(h[0] % (F.col(size) + 1), h[1] % (F.col(size) + 1)))})
    first, last = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    cut = F.col("form") != "plain"
    rows = rows.withColumns({"n": F.col(size), "prefix_chars": F.when(cut, first), "middle_chars": F.when(cut, last - first)})
    whole = F.array(piece(TEXT, 0, F.col("n")))
    for at in (last, first):
        rows = rows.withColumn(parts, F.when(cut, cut_first(F.col(parts) if parts in rows.columns else whole, at)).otherwise(whole))
    return rows.withColumn("pieces", arranged(F.col(parts), F.col("form"))).drop(digest, size, cuts, parts, ends)


def rendered(pieces: Column, text: Column) -> Column:
    """The text that pieces describe."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_join(F.transform(pieces, lambda p: F.when(p["buffer"] == TEXT, F.substr(t, p["start"] + 1, p["length"])).otherwise(F.substr(F.lit(_BUFFER), p["start"] + 1, p["length"]))), "")


def outputs(docs: DataFrame, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output, the text to train on."""
    return fill_middle(docs, plain, spm).withColumn("output", rendered(F.col("pieces"), F.col("text"))).drop("pieces")


def original(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: the sentinels' places give the output's pieces, the inverse permutation the text's.

    No sentinel can stand in a part, nor across its ends: all begin with a sign that their rest does not hold.
    """
    t = F.coalesce(output.cast("string"), F.lit(""))
    n, text = F.char_length(t), F.when(form == "plain", t)
    for name, order in FORMS.items():
        at = [F.locate(SENTINELS[s], t) for s, _ in order]  # from 1
        starts = [a - 1 + len(SENTINELS[s]) for a, (s, _) in zip(at, order, strict=True)]
        stops = [*(a - 1 for a in at[1:]), n]
        pieces = [x for (s, _), a, b in zip(order, starts, stops, strict=True) for x in (sentinel(s), piece(TEXT, a, b - a))]
        text = text.when(form == name, rendered(restored(F.array(*pieces), F.lit(name)), t))
    return text


def _stream(pieces: list[dict], text: memoryview, offset) -> str:
    """Hash of what pieces point at, piece by piece. offset: the byte of a code point."""
    h, sentinels = hashlib.sha256(), memoryview(_BUFFER.encode())
    for p in pieces:
        a, b = p["start"], p["start"] + p["length"]
        h.update(sentinels[a:b] if p["buffer"] == SENTINEL else text[offset(a) : offset(b)])
    return h.hexdigest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [c for c in batch.schema.names if c not in ("text", "pieces", "back")]
        texts, found = batch.column("text"), []
        for i, (pieces, back) in enumerate(zip(batch.column("pieces").to_pylist(), batch.column("back").to_pylist(), strict=True)):
            text = memoryview(texts[i].as_buffer() or b"") if texts[i].is_valid else memoryview(b"")
            ends = sorted({e for p in pieces if p["buffer"] == TEXT for e in (p["start"], p["start"] + p["length"])})
            if len(text) == (ends[-1] if ends else 0):  # one byte a code point
                found.append((_stream(pieces, text, int), _stream(back, text, int)))
                continue
            raw = np.frombuffer(text, np.uint8)
            lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            place = {e: int(lead[e]) for e in ends}
            del lead
            found.append((_stream(pieces, text, place.__getitem__), _stream(back, text, place.__getitem__)))
        both = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *both], [*kept, "output_sha256", "restored_sha256"])


def digests(docs: DataFrame, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of output and of the text restored from its pieces and form."""
    rows = fill_middle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), plain, spm)
    rows = rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "text", "pieces", restored(F.col("pieces"), F.col("form")).alias("back"))
    return rows.mapInArrow(_digested, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
