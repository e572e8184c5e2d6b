"""One registered query for each corpus operator, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, divergence, fill_middle, jaccard, language, main_text, passages, pii, repetition, site_quality, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repetition.repetition_rules(_table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return got.select(*first, *(c for c in got.columns if c not in first))


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return site_quality.score(docs, _table(spark, sf_dir, "labels")).drop("text")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.token_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode_decode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("hits")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeated(_table(spark, sf_dir, "documents"), with_text=False)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), copied=True).drop("key")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"), pii.listed(F.concat("base_spans", "added_spans")).alias("spans"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_repetition, op2_site_quality, op3_token_store, op4_byte_bpe, op5_toxicity, op6_passages, op7_main_text, op8_decontamination, op9_pii, op10_jaccard, op11_language, op12_source_divergence, op13_fill_middle)
}

_WORDS = """words_of AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""


def _repetition_sql() -> str:
    """The rules by grouping: every window of every length is a row."""
    parts, joins, columns = [], [], []
    for n in sorted({3, *repetition.TOP, *repetition.AGAIN}):
        parts.append(f"""
          g{n} AS (SELECT doc_id, k, array_to_string(ws[k : k + {n - 1}], ' ') AS g, len(array_to_string(ws[k : k + {n - 1}], '')) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS k FROM words_of)),
          r{n} AS (SELECT doc_id, g, count(*) AS times, max(c) AS c FROM g{n} GROUP BY doc_id, g HAVING count(*) > 1),
          t{n} AS (SELECT doc_id, max(times * c) AS took FROM r{n} GROUP BY doc_id),
          w{n} AS (SELECT doc_id, count(*) AS words, sum(len(w.x)) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(k, k + {n})) AS i FROM g{n} JOIN r{n} USING (doc_id, g)) c
                   JOIN (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM words_of) w USING (doc_id, i) GROUP BY doc_id)""")
        joins.append(f"LEFT JOIN t{n} USING (doc_id) LEFT JOIN w{n} USING (doc_id)")
        if n in repetition.TOP:
            columns.append(f"least(coalesce(t{n}.took, 0) / greatest(word_chars, 1)::DOUBLE, 1.0) AS top_{n}")
        if n in repetition.AGAIN:
            columns.append(f"coalesce(w{n}.chars, 0) / greatest(word_chars, 1)::DOUBLE AS again_{n}")
    bad = [f"top_{n} > {most}" for n, most in repetition.TOP.items()] + [f"again_{n} > {most}" for n, most in repetition.AGAIN.items()]
    bad += [
        f"(n_dup_lines >= {repetition.DUP_LINES} AND (n_dup_lines > {repetition.DUP_LINE_SHARE} * n_lines OR dup_line_chars > {repetition.DUP_LINE_CHARS} * word_chars))",
        f"n_symbols > {repetition.SYMBOLS_PER_WORD} * n_words",
    ]
    failed = f"(n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
    return f"""WITH {_WORDS}, {','.join(parts)},
      lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, coalesce(sum(len(line)) FILTER (nth > 1), 0)::BIGINT AS dup_line_chars
        FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words_of) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) GROUP BY doc_id),
      base AS (SELECT doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars FROM words_of LEFT JOIN lines USING (doc_id)),
      all_ AS (SELECT base.*, coalesce(w3.words, 0) AS n_repeat_words, {', '.join(columns)} FROM base {' '.join(joins)})
      SELECT *, {failed} AS base_failed, NOT {failed} AND NOT ({' OR '.join(bad)}) AS kept FROM all_"""


SQL: dict[str, str] = {
    "op12_source_divergence": """WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
      w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d), kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 10),
      c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
      tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL), whole AS (SELECT lang, sum(total) AS total FROM tot GROUP BY lang),
      p AS (SELECT tot.lang, tot.source, term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (tot.total + 2 * v.v))::BIGINT AS p FROM tot JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
      q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(whole.total) + 2 * any_value(v.v)))::BIGINT AS q FROM c JOIN whole USING (lang) JOIN v USING (lang) GROUP BY lang, term),
      f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
      pair AS (SELECT x.lang, x.source, y.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
      term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
      SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
      UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term) WHERE rank <= 10""",
    "op13_fill_middle": """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS h FROM documents),
      u AS (SELECT *, CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2, CAST(concat('0x', h[17:24]) AS BIGINT) AS h3, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM h),
      f AS (SELECT doc_id, t, n, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
        least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
      p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN t ELSE concat(pre, mid, suf) END) AS restored_sha256 FROM p""",
    "op1_repetition": _repetition_sql(),
    "op6_passages": f"""WITH {_WORDS}, g AS (SELECT doc_id, k, md5(array_to_string(ws[k : k + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM words_of)),
      late AS (SELECT doc_id, k FROM g JOIN (SELECT h, min(doc_id) AS least FROM g GROUP BY h) USING (h) WHERE least < doc_id), gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i, TRUE AS cut FROM late),
      w AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM words_of),
      left_ AS (SELECT doc_id, count(cut) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (cut IS NULL) AS t FROM w LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
      SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words_of LEFT JOIN left_ USING (doc_id)""",
    "op10_jaccard": f"""WITH RECURSIVE {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
      sets AS (SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(ws) >= 5 THEN ws[k : k + 4] ELSE ws END, ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM words_of WHERE len(ws) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id), both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
      link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
      reach AS (SELECT doc_id AS a, doc_id AS b FROM words_of UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
      SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
}
