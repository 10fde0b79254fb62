"""DuckDB SQL for the queries that SQL can express; each states its own rules."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS r FROM documents
), w AS (
  SELECT r, unnest(regexp_extract_all(text, '{WORD}')) AS word, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS i FROM d
), t AS (
  SELECT r, i, word, lead(word, 1) OVER s AS b, lead(word, 2) OVER s AS c FROM w WINDOW s AS (PARTITION BY r ORDER BY i)
), hit AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) > 1 AS twice FROM t WHERE c IS NOT NULL
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit WHERE twice) GROUP BY r
), ws AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY r
), m AS (
  SELECT doc_id, CAST(COALESCE(n_words, 0) AS BIGINT) AS n_words, CAST(COALESCE(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(COALESCE(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(rep.n, 0) AS BIGINT) AS n_repeat_words,
    COALESCE(n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_bangs,
    length(text) - length(replace(text, '|', '')) AS n_bars
  FROM d LEFT JOIN ws USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r)
), f AS (
  SELECT *, [n_words < 50, n_repeat_words > 0.5 * n_words, n_symbols > 0.1 * n_words, n_dup_lines > 0.3 * n_lines,
    n_upper > 0.5 * word_chars, n_bangs > 0.1 * n_words, n_bars > 0.1 * n_words,
    word_chars > 15 * n_words OR word_chars < 2 * n_words, n_repeat_words > 0.3 * n_words] AS bad FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad[1] OR bad[2] AS base_failed,
  NOT list_bool_or(bad) AS kept,
  CAST({" + ".join(f"CASE WHEN bad[{i + 1}] THEN {1 << i} ELSE 0 END" for i in range(9))} AS BIGINT) AS failed
FROM f
"""


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hits_sql(docs: str, items: str) -> str:
    """CTEs ``hit`` (doc_id, p: a hit word's place) and ``held`` (doc_id, item_id) by joining 13-word windows."""
    low = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    windows = "SELECT {id}, p, CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END AS n, w[p:p + 12] AS g FROM {t}, LATERAL (SELECT unnest(range(1, greatest(len(w) - 11, 2))) AS p) WHERE len(w) > 0"
    return f"""
dw AS (SELECT doc_id, regexp_extract_all({low}, '{ALNUM}') AS w FROM {docs}),
iw AS (SELECT item_id, regexp_extract_all({low}, '{ALNUM}') AS w FROM {items}),
ig AS (SELECT DISTINCT item_id, n, g FROM ({windows.format(id="item_id", t="iw")})),
sizes AS (SELECT DISTINCT n FROM ig),
dg AS (
  SELECT doc_id, n, p, w[p:p + n - 1] AS g FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p) WHERE len(w) >= n
), m AS (SELECT doc_id, dg.n, p, item_id FROM dg JOIN ig ON ig.g = dg.g AND ig.n = dg.n),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM (SELECT DISTINCT doc_id, p, n FROM m)),
held AS (SELECT DISTINCT doc_id, item_id FROM m)"""


ORACLES["op1_decontamination"] = f"""
WITH {hits_sql("documents", "benchmark")},
h AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM held GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


ORACLES["op4_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS w FROM documents),
g AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS p) WHERE len(w) >= 50
), m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM g JOIN m USING (h) WHERE least < doc_id),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (
  SELECT w.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
    string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY w.doc_id
)
SELECT doc_id, COALESCE(n_words, 0) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def mix_sql(docs: str, weights: dict[str, float], default: float, size: float, seed: int, columns: str) -> str:
    """Copies by the inverse Poisson distribution at the MD5 number of each id."""
    arms = " ".join(f"WHEN '{name}' THEN {value}" for name, value in weights.items())
    number = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0"
    unit = number.format(f"'{seed}|' || COALESCE(CAST(doc_id AS VARCHAR), '')")
    order = number.format(f"'{seed + 1}|' || COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)")
    return f"""
WITH RECURSIVE d AS (SELECT * FROM {docs}),
n AS (
  SELECT source, count(*) AS n, CAST(CASE source {arms} ELSE {default} END AS DOUBLE) AS weight FROM d GROUP BY source
), rate AS (
  SELECT source, weight / (SELECT sum(weight) FROM n) * CAST({size} AS DOUBLE) * (SELECT count(*) FROM d) / n AS rate FROM n
), pmf(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rate
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM pmf WHERE k < rate + 12 * sqrt(rate) + 40
), c AS (
  SELECT d.*, CAST((SELECT count(*) FROM pmf WHERE pmf.source IS NOT DISTINCT FROM d.source AND cdf <= {unit}) AS INTEGER) AS times FROM d
), e AS (SELECT *, unnest(range(1, times + 1)) AS copy FROM c)
SELECT {columns}, CAST(copy AS INTEGER) AS copy, {order} AS shuffle_key FROM e
"""


ORACLES["op3_mix_sources"] = mix_sql(
    "documents", {"src0": 2.0, "src1": 3.0, "src2": 0.5}, 1.0, 1.0, 17, "doc_id, text, lang, source, n_chars"
)

ORACLES["op6_chat_preferences"] = """
WITH t AS (
  SELECT conv_id, COALESCE(role, 'user') AS role, COALESCE(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, 'user'), COALESCE(text, '')) AS i
  FROM conversations
), k AS (SELECT conv_id, max(i) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT t.conv_id - 1 AS conv_id, role, text FROM t JOIN k USING (conv_id) WHERE i = last),
chosen AS (SELECT t.* FROM t JOIN k USING (conv_id) WHERE i <= last),
rejected AS (
  SELECT t.* FROM t JOIN k USING (conv_id) WHERE i < last
  UNION ALL SELECT conv_id, role, text, last FROM reply JOIN k USING (conv_id)
), both_ AS (
  SELECT k.conv_id, COALESCE(min(c.i) FILTER (WHERE r.i IS NULL OR c.role <> r.role OR c.text <> r.text) - 1, max(c.i)) AS cut
  FROM k JOIN chosen c USING (conv_id) LEFT JOIN rejected r ON r.conv_id = k.conv_id AND r.i = c.i GROUP BY k.conv_id
), parts AS (
  SELECT conv_id, 'c' AS side, i, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body, role FROM chosen
  UNION ALL
  SELECT conv_id, 'r', i, '<|im_start|>' || role || chr(10), text || '<|im_end|>' || chr(10), role FROM rejected
)
SELECT b.conv_id AS pair_id, CAST(b.cut AS INTEGER) AS n_prompt_turns,
  COALESCE(string_agg(p.head || p.body, '' ORDER BY p.i) FILTER (WHERE side = 'c' AND i <= cut), '') AS prompt,
  array_to_string(COALESCE(flatten(list([p.head, p.body] ORDER BY p.i) FILTER (WHERE side = 'c' AND i > cut)), []), '|') AS chosen_texts,
  array_to_string(COALESCE(flatten(list([0, CAST(role = 'assistant' AS INTEGER)] ORDER BY p.i) FILTER (WHERE side = 'c' AND i > cut)), []), '|') AS chosen_masks,
  array_to_string(COALESCE(flatten(list([p.head, p.body] ORDER BY p.i) FILTER (WHERE side = 'r' AND i > cut)), []), '|') AS rejected_texts,
  array_to_string(COALESCE(flatten(list([0, CAST(role = 'assistant' AS INTEGER)] ORDER BY p.i) FILTER (WHERE side = 'r' AND i > cut)), []), '|') AS rejected_masks,
  count(*) FILTER (WHERE i > cut) = 0 AS identical
FROM both_ b JOIN parts p USING (conv_id) GROUP BY b.conv_id, b.cut
"""

ORACLES["op11_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS text, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS s,
    regexp_extract_all(COALESCE(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, COALESCE(array_to_string(u[1:a], ''), '') AS prefix, COALESCE(array_to_string(u[a + 1:b], ''), '') AS middle,
    COALESCE(array_to_string(u[b + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
