"""Text columns: cleaning, hashing, parsing. Native expressions throughout."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import BOILERPLATE, LOCATION_SPELLINGS

# The line that opens what a posting asks for.
REQUIREMENTS_HEADING = (
    r"(?imU)^\s*(?:requirements?|(?:required |minimum |basic )?qualifications?|all you need|what(?:'s| is) needed"
    r"|what you(?:'ll| will)? (?:need|bring)|what we(?:'re| are) looking for|experience (?:and|&) skills|who you are|about you"
    r"|your profile|your experience|your background|skills?(?: (?:and|&) (?:experience|qualifications?))?|must[- ]haves?"
    r"|you (?:have|bring|are)|we(?:'re| are) looking for|דרישות(?: התפקיד)?|כישורים(?: נדרשים)?)\b[^\n]{0,60}$"
)
_REFERENCE = r"&(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};?)"
_NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
_LATER_NAMES = {name: text for name, text in html5.items() if name.endswith(";") and name[:-1] not in _NAMES}
#: What HTML reads numbers of control characters as.
_CONTROLS = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}


def any_of(terms: list[str] | tuple[str, ...], flags: str = "iU", edge: str = r"\b") -> str:
    """A pattern for whole terms, longest first; an edge stands only beside a letter or digit."""

    def one(term: str) -> str:
        escaped = re.sub(r"([^\w\s])", r"\\\1", term)
        return (edge if term[0].isalnum() else "") + escaped + (edge if term[-1].isalnum() else "")

    ordered = sorted(terms, key=len, reverse=True)
    if all(t[0].isalnum() and t[-1].isalnum() for t in terms):  # edges that all share are tried once
        edge, around = "", edge
        return f"(?{flags}){around}(?:" + "|".join(one(t) for t in ordered) + f"){around}"
    return f"(?{flags})(?:" + "|".join(one(t) for t in ordered) + ")"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x written, planned and computed a single time."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def collapsed(x: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends: titles and company names compare by this."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def collapsed_text(x: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_whitespace(x: Column) -> Column:
    x = F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t ]+", " ")
    x = F.regexp_replace(x, r"(?mU)^[^\S\n]+|[^\S\n]+$", "")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_boilerplate(x: Column) -> Column:
    marks = "|".join(re.escape(m) for m in BOILERPLATE)
    return F.array_join(F.filter(F.split(x, "\n", -1), lambda line: ~F.lower(line).rlike(marks)), "\n")


def normalized_description(x: Column) -> Column:
    return normalize_whitespace(strip_boilerplate(F.coalesce(x, F.lit(""))))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def normalize_location(x: Column) -> Column:
    out = collapsed(x)
    for variant, city in sorted(LOCATION_SPELLINGS.items(), key=lambda p: -len(p[0])):
        out = F.replace(out, F.lit(variant), F.lit(city))
    return F.when(x != "", out)


def _value_of(name: Column, values: dict[str, str]) -> Column:
    """What a name without signs stands for; null if unknown.

    All of values are one text: a map would be as many objects, in every task and for each use of the expression.
    """
    every = F.lit("\x01" + "".join(f"{k}\x02{v}\x01" for k, v in values.items()))
    after = F.call_function("substring_index", every, F.concat(F.lit("\x01"), name, F.lit("\x02")), F.lit(-1))
    return F.nullif(F.substring_index(after, "\x01", 1), F.lit(""))  # all of it, and so nothing before its first mark, where the name is not found


def unescape(x: Column) -> Column:
    """Character references, by name or by number, once; what is none stays. Names that came with HTML 5 need their semicolon."""
    def sign(body: Column) -> Column:
        digits = F.regexp_extract(body, "^#[xX]?([0-9a-fA-F]+)", 1)
        number = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        known = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        code = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        numbered = F.coalesce(_value_of(number.cast("string"), _CONTROLS), F.when(known, code).otherwise("\ufffd"))
        return F.when(body.startswith("#"), numbered).otherwise(F.coalesce(_value_of(F.rtrim(body, F.lit(";")), _NAMES), _value_of(body, _LATER_NAMES), F.concat(F.lit("&"), body)))

    def read(text: Column) -> Column:
        bodies = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1))
        pieces = F.split(text, _REFERENCE, -1)
        rest = F.zip_with(F.transform(bodies, sign), F.slice(pieces, F.lit(2), F.size(bodies)), lambda a, b: F.concat(a, b))
        return F.when(text.contains("&"), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(text)

    return once(x, read)


def html_to_text(x: Column) -> Column:
    """Text of an HTML fragment, one line for each block. Nested or broken tags are read as they come, without a tree."""
    raw = once(x, lambda text: F.when(text.contains("&lt;") & ~text.contains("<"), unescape(text)).otherwise(text))
    out = F.regexp_replace(raw, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?(?:-->|\z)", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)\s*>", "\n")
    out = unescape(F.regexp_replace(out, r"(?s)<[^>]*>", ""))
    lines = F.transform(F.split(out, r"\r\n|\n|\r"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.array_join(F.filter(lines, lambda line: line != ""), "\n"), F.lit(""))


def requirements_section(x: Column) -> Column:
    """From the first heading of requirements on, or all."""

    def cut(text: Column) -> Column:
        return once(F.regexp_extract(text, REQUIREMENTS_HEADING, 0), lambda heading: F.when(heading != "", F.substr(text, F.position(heading, text))).otherwise(text))

    return once(x, cut)


def embedding_text(title: Column, department: Column, location: Column, employment: Column, required: Column, preferred: Column, responsibilities: Column, qualifications: Column, description: Column) -> Column:
    """What a posting is embedded by: labelled parts, then its own words, requirements first where they are buried."""

    return once(normalized_description(description), lambda body: _embedding_text(body, title, department, location, employment, required, preferred, responsibilities, qualifications))


def _embedding_text(body: Column, title: Column, department: Column, location: Column, employment: Column, required: Column, preferred: Column, responsibilities: Column, qualifications: Column) -> Column:
    def labelled(label: str, x: Column) -> Column:
        return F.when(x != "", F.concat(F.lit(label), x))

    own = (F.coalesce(responsibilities, F.lit("")) == "") & (F.coalesce(qualifications, F.lit("")) == "")
    section = requirements_section(body)
    parts = F.array(
        title,
        labelled("Team: ", department),
        labelled("Location: ", location),
        F.when(employment != "unknown", F.concat(F.lit("Employment type: "), employment)),
        F.when(F.size(required) > 0, F.concat(F.lit("Required skills: "), F.array_join(required, ", "))),
        F.when(F.size(preferred) > 0, F.concat(F.lit("Preferred skills: "), F.array_join(preferred, ", "))),
        F.when(responsibilities != "", responsibilities),
        F.when(qualifications != "", qualifications),
        F.when(own & (section != body), section),
        F.when(body != "", body),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")


def chunk_words(x: Column, size: int = 220) -> Column:
    """The text itself if it has few words, else its words in slices."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size)), lambda k: F.array_join(F.slice(words, k, size), " "))
        return F.when(n > size, pieces).otherwise(F.array(x))

    # The words stand in an array of one, so that they are split once and not for each slice.
    return F.get(F.transform(F.array(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")), cut), F.lit(0))


def employment_type(x: Column) -> Column:
    low = F.lower(x)
    has = lambda *words: F.lower(low).rlike("|".join(words))
    return (
        F.when(F.coalesce(low, F.lit("")) == "", "unknown").when(has("intern"), "internship").when(has("part", "חלקית"), "part_time")
        .when(has("contract", "temp", "freelance"), "contract").when(has("full", "מלאה"), "full_time").otherwise("unknown")
    )


def remote_type(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(low.contains("remote"), "remote").when(low.contains("hybrid"), "hybrid").when(low.rlike("on[- _]?site"), "onsite").otherwise("unknown")


def parse_timestamp(x: Column) -> Column:
    """ISO 8601 text, or seconds or milliseconds since 1970; text without a zone is UTC; anything else is null."""
    number = F.when(x.rlike(r"^\d{9,}(\.\d+)?$"), x.try_cast("double"))
    seconds = F.when(number > 10_000_000_000, number / 1000).otherwise(number)
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), x.try_cast("timestamp"))
    return F.when(number.isNotNull(), F.timestamp_millis((seconds * 1000).cast("long"))).otherwise(iso)


def display_date(x: Column) -> Column:
    """Dates as shown to people: Sep 14, 2026 or September 14, 2026."""
    return F.coalesce(F.try_to_timestamp(x, F.lit("MMM d, yyyy")), F.try_to_timestamp(x, F.lit("MMMM d, yyyy")))


def registrable_host(host: Column) -> Column:
    parts = F.split(F.lower(host), r"\.")
    n = F.size(parts)
    three = (n >= 3) & F.element_at(parts, -2).isin("co", "com", "org", "net", "ac", "gov")
    return F.array_join(F.slice(parts, F.greatest(n - F.when(three, 2).otherwise(1), F.lit(1)), 3), ".")


def source_url(x: Column) -> Column:
    """Trimmed, with a scheme; null if blank."""
    t = F.trim(x)
    return F.when(t != "", F.when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t)))


def url_id(url: Column) -> Column:
    return F.substr(F.sha2(url, 256), F.lit(1), F.lit(32))


def safe_link(url: Column) -> Column:
    """Null for a scheme other than http and https; relative links stay."""
    return F.when(~(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~url.rlike("(?i)^https?:")), url)


# Words that name a role.
ROLE_WORDS = (
    r"(?iU)\b(?:engineer|developer|programmer|architect|analyst|scientist|manager|designer|devops|qa|tester|specialist|lead|intern|student|researcher|administrator"
    r"|consultant|product|data|software|backend|frontend|full[- ]?stack|support|sales|marketing|hr|finance|operations|coordinator|director|head|officer|technician|team)\b"
    r"|מפתח|מהנדס|מנהל|אנליסט|בודק|ארכיטקט|מתכנת|סטודנט|ראש צוות|מומחה|יועץ|תומך|רכז|נציג"
)


def looks_like_job_title(x: Column) -> Column:
    """Two words or more, one of them a role."""
    words = F.filter(F.split(x, r"(?U)[\s/,\-–|]+"), lambda w: w != "")
    return (F.size(words) >= 2) & x.rlike(ROLE_WORDS)


def domain_label(host: Column) -> Column:
    """The company's part of a host: the label before its public end."""
    return F.split(registrable_host(host), r"\.")[0]


def naive_as_local(x: Column, zone: str) -> Column:
    """A time without a zone, as the clock of a place shows it, in UTC."""
    return F.to_utc_timestamp(x, zone)
