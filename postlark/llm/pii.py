"""Personal data: spans by pattern, confirmed by checksums, scored by the words nearby. Spark SQL functions only.

A pattern's matches and the pieces between them give every match's place in code points. Validators
then drop what cannot be meant: parts of an address over 255, card numbers that fail Luhn, account
numbers that fail mod-97, phone numbers with too few or too many digits. Nearby words raise a span's
score; patterns that are weak alone count only with such a word.

Patterns start at the edge of a run of their characters, or where the last match ended, so that long
runs are not tried from each of their characters; the matches are those of the plain patterns.

Defined cases: a null or empty text has no spans; very long texts are searched whole, in time that grows with
their length; spans of one place are listed in the order of kinds; repeated rows are searched each; other columns
stay, whatever their names, but for those that the results replace; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import private

_CONTEXT = 48
CHUNK = 256
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """base: its spans always count. score: without a word nearby; near: words, as a pattern, that add to it."""

    name: str
    pattern: str
    base: bool
    score: float
    near: str


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.9, "mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", True, 0.6, "ip|address|host|server|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", True, 0.8, "card|visa|credit|debit|pay|amex"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", True, 0.8, "phone|call|tel|mobile|fax|cell"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", False, 0.7, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, 0.3, "ssn|social security|taxpayer"),
    Kind("local_phone", r"(?<![0-9+(.-])(?<!\+1 )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", False, 0.3, "phone|call|tel|mobile|fax|cell"),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")

    def worth(x: Column, i: Column) -> Column:
        twice = x.cast("int") * 2
        return F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, blanks and all, leaves 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(a: Column, x: Column) -> Column:
        return F.when(x.rlike("[0-9]"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)

    return (F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step) == 1) & F.length(plain).between(15, 34)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
        return F.forall(plain, lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255"))
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _scan(items: Column, out: str, state: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each item in turn step(state, item) gives a struct<state, out>; the outs as an array of the given type.

    Arrays grow by CHUNK items at once, so that many items of one text do not copy the whole array each.
    """
    none = F.expr(f"cast(array() as array<{out}>)")

    def one(a: Column, x: Column) -> Column:
        return F.get(F.transform(F.array(step(a["state"], x)), lambda s: F.struct(s["state"].alias("state"), F.concat(a["outs"], F.array(s["out"])).alias("outs"))), F.lit(0))

    def chunk(a: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(a["state"].alias("state"), none.alias("outs")), one)
        return F.get(F.transform(F.array(inner), lambda s: F.struct(s["state"].alias("state"), F.concat(a["outs"], s["outs"]).alias("outs"))), F.lit(0))

    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK)), lambda k: F.slice(items, k, F.lit(CHUNK)))
    return F.aggregate(chunks, F.struct(state.alias("state"), none.alias("outs")), chunk, lambda a: a["outs"])


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern, places in code points."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
    pieces = F.zip_with(between, values, lambda b, v: F.struct(F.length(b).alias("gap"), v.alias("value")))

    def step(at: Column, p: Column) -> Column:
        begin = at + p["gap"]
        end = begin + F.length(p["value"])
        return F.struct(end.alias("state"), F.struct(begin.alias("start"), end.alias("end"), p["value"].alias("value")).alias("out"))

    return _scan(pieces, "struct<start:int,end:int,value:string>", F.lit(0), step)


def _spans(text: Column, kind: Kind) -> Column:
    valid = F.filter(_matches(text, kind.pattern), lambda m: _valid(kind.name, m["value"]))

    def scored(m: Column) -> Column:
        first = F.greatest(m["start"] - _CONTEXT, F.lit(0))
        around = F.lower(F.concat(F.substr(text, first + 1, m["start"] - first), F.lit(" "), F.substr(text, m["end"] + 1, F.lit(_CONTEXT))))
        near = around.rlike(rf"(?<![a-z])(?:{kind.near})")
        return F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.when(near, min(kind.score + 0.3, 1.0)).otherwise(kind.score).alias("score"))

    found = F.transform(valid, scored)
    return found if kind.base else F.filter(found, lambda s: s["score"] >= LEAST_SCORE)


def _found(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: base spans and added ones."""
    base_spans, added_spans, *columns = private(docs, "base", "added", *(k.name for k in KINDS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Most texts hold no digit run, sign or address: a cheap look spares them the patterns.
    looks = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -]{11}"), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "ssn": text.rlike("-[0-9]{2}-"), "local_phone": text.rlike("[.-][0-9]{4}")}
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    found = docs.withColumns({c: F.when(looks[k.name], _spans(text, k)).otherwise(empty) for c, k in zip(columns, KINDS, strict=True)})
    base = F.concat(*(F.col(c) for c, k in zip(columns, KINDS, strict=True) if k.base))
    more = F.concat(*(F.col(c) for c, k in zip(columns, KINDS, strict=True) if not k.base))
    found = found.withColumn(base_spans, base)
    free = F.filter(more, lambda m: ~F.exists(base_spans, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.withColumn(added_spans, free).drop(*columns), base_spans, added_spans


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with base_spans (email, ip, card, phone) and added_spans (the others, where they cross no base span).

    Both are array<struct<kind, start, end, score>> in the order of KINDS, then of places; the end is exclusive.
    Columns of these names in docs are replaced.
    """
    found, base, added = _found(docs)
    others = [c for c in docs.columns if c.lower() not in ("base_spans", "added_spans")]
    return found.select(*others, F.col(base).alias("base_spans"), F.col(added).alias("added_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets, and n_chars, if there is one, counted anew.

    Spans that cross are replaced as one, by the first one's kind. A null text stays null.
    """
    found, base, added = _found(docs)
    spans = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("turned"), s["kind"].alias("kind"))))
    text = F.col("text").cast("string")

    def step(at: Column, s: Column) -> Column:
        """What stands before the span and its kind; nothing for one that an earlier one reaches."""
        more = F.concat(F.substr(text, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(at, -s["turned"]).alias("state"), F.when(s["start"] >= at, more).otherwise("").alias("out"))

    last = F.array_max(F.transform(spans, lambda s: -s["turned"]))
    masked = F.concat(F.array_join(_scan(spans, "string", F.lit(0), step), ""), F.substr(text, last + 1, F.length(text)))
    has = (F.size(base) > 0) | (F.size(added) > 0)
    out = found.withColumn("text", F.when(has, masked).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
