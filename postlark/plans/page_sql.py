"""SQL that reads a page as elements.py does: its marks, the elements that these open and close, and the texts in headings."""

from __future__ import annotations

from itertools import zip_longest
from string import Template

_WHITE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BLANK = rf"\x1c-\x1f{_WHITE}"  # between attributes
_EQUALS = rf"[{_BLANK}]*=+[{_BLANK}]*"
_NAME = rf"[^{_BLANK}/>][^{_BLANK}/=>]*"
_IN_QUOTES = "'[^']*'|\"[^\"]*\""
_BARE = rf"(?:[^'\">{_BLANK}][^>{_BLANK}]*)?"
_GAP = rf"[{_BLANK}/]+(?:{_NAME}{_EQUALS}(?:{_IN_QUOTES}))*"
_LAST = rf"{_NAME}(?:{_EQUALS}{_BARE})?"
_ATTRIBUTES = rf"(?:{_GAP}(?:{_LAST})?)*"
_TAG = r"[a-zA-Z][^\t\n\r\f />\x00]*"
# What may stand before the > of a tag that is not closed by a slash of its own.
_OPEN = rf"(?:{_ATTRIBUTES}(?:[{_BLANK}]|{_GAP}(?:{_NAME}{_EQUALS}(?:{_IN_QUOTES})|{_LAST})))?>"
_COMMENT = rf"<!--.*?--[{_BLANK}]*>"
_SECTIONS = (("(?:temp|cdata|ignore|include|rcdata)", rf"\][{_BLANK}]*\][{_BLANK}]*>"), ("(?:if|else|endif)", rf"\][{_BLANK}]*>"))
_SECTION = "|".join(rf"(?i:<!\[{names})(?:[^-_.a-zA-Z0-9].*?)??{end}" for names, end in _SECTIONS)
_RAW = "|".join(rf"<{name}{_OPEN}.*?(?:</[{_BLANK}]*{name}[{_BLANK}]*>|\z)" for name in ("[sS][cC][rR][iI][pP][tT]", "[sS][tT][yY][lL][eE]"))
_SILENT = f"{_COMMENT}|{_SECTION}|{_RAW}"
_PATTERNS = {
    "marks": rf"(?s){_SILENT}|<{_TAG}{_ATTRIBUTES}[{_BLANK}]*/?>|</[^>]*>|<[!?][^>]*>|<[a-zA-Z][^>]*>|<[a-zA-Z/!?][^<]*|[^<]+|<",
    "silent": f"(?s){_SILENT}",
    "unended": r"^<!(?:--|\[(?i:temp|cdata|ignore|include|rcdata|if|else|endif)[^-_.a-zA-Z0-9])",
    "open": f"<{_TAG}{_OPEN}",
    "alone": rf"<{_TAG}{_ATTRIBUTES}[{_BLANK}]*/>",
    "ended": rf"^</[{_BLANK}]*([a-zA-Z][-.a-zA-Z0-9:_]*)[{_BLANK}]*>$",
    "tag": f"^</?({_TAG})",
    "attribute": f"({_NAME})(?:{_EQUALS}({_IN_QUOTES}|{_BARE}))?",
    "quoted": r"""(?s)^['"](.*)['"]$""",
    "white": f"[{_WHITE}]+",
    "ends": rf"^[{_WHITE}]+|[{_WHITE}]+\z",
}


def _unless(*tags: str) -> str:
    return "{" + ", ".join(f"'{x}': '{tag}'" for x, tag in zip_longest("abcdef", tags, fillvalue="")) + "}"


_WORDS = {
    "signs": "replace(replace(replace(v, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')",
    # What is left of the open elements, innermost first, after a step: all, or those around the element that it closes.
    "left": "CASE WHEN list_contains(s.tags, o.closes) AND NOT (" + " OR ".join(f"list_contains(s.tags[:list_position(s.tags, o.closes)], o.unless.{x})" for x in "abcdef") + ") THEN list_position(s.tags, o.closes) + 1 ELSE 1 END",
    "none": "NULL::VARCHAR",
    "any": _unless(), "lists": _unless("ul", "ol"), "tables": _unless("table", "tbody", "thead"), "rows": _unless("tr"), "select": _unless("select"), "dl": _unless("dl"), "boxes": _unless("div", "td", "th", "li", "section", "article"),
    "void": "('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr')",
}
#: Common table expressions over pages: named has page_id, h1, headings (four of h2 and h3), og, and head (the title up to a bar or dash), a row for each page.
NAMED = Template(
    r"""marks AS (SELECT page_id, list_transform(list_filter(regexp_extract_all(coalesce(html, ''), $marks), lambda m: m <> '</>'), lambda m, i: {'at': i, 'mark': m, 'tag': lower(coalesce(nullif(regexp_extract(m, $ended, 1), ''), regexp_extract(m, $tag, 1))),
      'kind': CASE WHEN NOT regexp_matches(m, '^<[a-zA-Z/!?]') THEN 'text' WHEN regexp_full_match(m, $silent) THEN 'silent' WHEN m LIKE '</%>' THEN 'end' WHEN regexp_matches(m, $unended) THEN 'text'
        WHEN m LIKE '<!%>' OR m LIKE '<?%>' THEN 'silent' WHEN regexp_full_match(m, $open) THEN 'start' WHEN regexp_full_match(m, $alone) THEN 'alone' ELSE 'text' END}) AS marks FROM pages),
  steps AS (SELECT page_id, marks, flatten(list_transform(marks, lambda m: CASE m.kind
      WHEN 'text' THEN [{'at': m.at, 'closes': $none, 'unless': $any, 'opens': []::VARCHAR[], 'new': []::BIGINT[], 'text': CASE WHEN m.at > 1 AND marks[m.at - 1].kind = 'text' THEN '' ELSE ' ' END || m.mark}]
      WHEN 'end' THEN [{'at': m.at, 'closes': m.tag, 'unless': $any, 'opens': []::VARCHAR[], 'new': []::BIGINT[], 'text': $none}] WHEN 'silent' THEN []
      ELSE [{'at': m.at, 'closes': CASE WHEN m.tag IN ('li', 'tr', 'td', 'th', 'option', 'dt', 'dd') THEN m.tag END,
          'unless': CASE m.tag WHEN 'li' THEN $lists WHEN 'tr' THEN $tables WHEN 'option' THEN $select WHEN 'dt' THEN $dl WHEN 'dd' THEN $dl ELSE $rows END, 'opens': []::VARCHAR[], 'new': []::BIGINT[], 'text': $none},
        {'at': m.at, 'closes': CASE WHEN m.tag IN ('p', 'div', 'li', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 'p' END, 'unless': $boxes,
          'opens': CASE WHEN m.kind = 'start' AND m.tag NOT IN $void THEN [m.tag] ELSE [] END, 'new': CASE WHEN m.kind = 'start' AND m.tag NOT IN $void THEN [m.at] ELSE [] END, 'text': $none}] END)) AS steps FROM marks),
  texts AS (SELECT page_id, marks, list_reduce(steps, lambda s, o: {'tags': o.opens || s.tags[$left:], 'at': o.new || s.at[$left:],
      'texts': CASE WHEN o.text IS NOT NULL AND (list_contains(s.tags, 'h1') OR list_contains(s.tags, 'h2') OR list_contains(s.tags, 'h3') OR list_contains(s.tags, 'title')) THEN s.texts || [{'of': s.at, 'text': o.text}] ELSE s.texts END
    }, {'tags': []::VARCHAR[], 'at': []::BIGINT[], 'texts': []::STRUCT("of" BIGINT[], "text" VARCHAR)[]}).texts AS texts FROM steps),
  found AS (SELECT page_id, list_filter(marks, lambda m: m.kind IN ('start', 'alone') AND m.tag IN ('h1', 'h2', 'h3', 'meta', 'title')) AS found, texts FROM texts),
  heads AS (SELECT page_id, list_transform(found, lambda m: {'tag': m.tag,
      'text': trim(regexp_replace(array_to_string(list_transform(list_transform(list_filter(texts, lambda x: list_contains(x.of, m.at)), lambda x: x.text), lambda v: $signs), ''), $white, ' ', 'g')),
      'names': list_transform(regexp_extract_all(substr(m.mark, 6), $attribute, 1), lambda n: lower(n)),
      'values': list_transform(list_transform(regexp_extract_all(substr(m.mark, 6), $attribute, 2), lambda v: regexp_replace(v, $quoted, '\1')), lambda v: $signs)}) AS heads FROM found),
  named AS (SELECT page_id, list_filter(heads, lambda h: h.tag = 'h1')[1].text AS h1, list_transform(list_filter(heads, lambda h: h.tag IN ('h2', 'h3'))[:4], lambda h: h.text) AS headings,
    regexp_replace(list_filter(list_transform(list_filter(heads, lambda h: h.tag = 'meta' AND h.values[list_position(h.names, 'property')] = 'og:title'), lambda h: h.values[list_position(h.names, 'content')]), lambda v: v IS NOT NULL)[1], $ends, '', 'g') AS og,
    trim(string_split(string_split(list_filter(heads, lambda h: h.tag = 'title')[1].text, '|')[1], ' - ')[1]) AS head FROM heads)"""
).substitute(_WORDS, **{name: "'" + pattern.replace("'", "''") + "'" for name, pattern in _PATTERNS.items()})
