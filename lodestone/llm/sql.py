"""SQL (DuckDB) for the queries that SQL can express, generated from the operators' own rules."""

from __future__ import annotations

from . import embeds, licenses, quality, urls

_WORD = r"[^\x20\x09-\x0D]"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules() -> str:
    stock = " OR ".join(f"contains(lower(line), {_quoted(p)})" for p in quality.BOILERPLATE)
    inner = " OR ".join(f"contains(line, {_quoted(x)})" for x in quality.INNER_ENDS)
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
windows AS (
  SELECT r, i, hash(list_slice(ws, i, i + {quality.WINDOW - 1})) AS h
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM docs)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, sum(least({quality.WINDOW}, coalesce(lead_i - i, {quality.WINDOW}))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS lead_i FROM again) GROUP BY r),
lines AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}')),
judged AS (
  SELECT r, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
    (NOT contains({_quoted(quality.ENDINGS)}, right(rtrim(line, {_BLANKS}), 1)) AND NOT (length(line) >= {quality.INNER_LENGTH} AND ({inner})))
    OR (regexp_matches(line, '[#*$%&|<>]|!!') AND len(regexp_extract_all(line, {_quoted(quality.SYMBOL_WORD)})) >= {quality.SYMBOL_SHARE} * len(regexp_extract_all(line, '{_WORD}+')))
    OR (length(line) <= {quality.NAVIGATION_LENGTH} AND (regexp_matches(line, {_quoted(quality.NAVIGATION.replace("(?iu:", "(?i:"))}) OR regexp_matches(line, {_quoted("^" + quality.MARKS)})))
    OR (length(line) <= {quality.BOILERPLATE_LENGTH} AND ({stock})) AS fails
  FROM lines),
summed AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(chars) FILTER (fails), 0) AS lost_chars
  FROM judged GROUP BY r),
counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM docs LEFT JOIN summed USING (r) LEFT JOIN covered USING (r)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= {quality.MOST_LOST} * word_chars AS kept, n_lines, n_failed_lines, lost_chars
FROM based"""


def line_dedup() -> str:
    key = f"translate(trim(line, {_BLANKS}), {_AZ})"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs),
keyed AS (SELECT r, doc_id, i, line, {key} AS key FROM lines),
often AS (SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
kept AS (SELECT r, i, line, often.key IS NOT NULL AND doc_id IS DISTINCT FROM stays AS gone FROM keyed LEFT JOIN often USING (key)),
joined AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM kept GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM docs JOIN joined USING (r)"""


def license_scans() -> str:
    split = licenses.SPLIT
    phrase = " UNION ALL ".join(
        f"SELECT r, i, {_quoted(label)} AS label FROM placed WHERE " + " AND ".join(f"w{k or ''} = {_quoted(p)}" for k, p in enumerate(text.split())) for text, label in licenses.PHRASES
    )
    longest = max(len(p.split()) for p, _ in licenses.PHRASES)
    leads = ", ".join(f"lead(w, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, longest))
    plan = licenses.containment_plan({})
    templates = ", ".join(f"({k}, {_quoted(label)}, {_quoted(w)}, {len(words)}, {least}, {span})" for k, (label, words, least, span) in enumerate(plan) for w in words)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), {_AZ}) AS text FROM documents),
worded AS (SELECT r, list_filter(regexp_split_to_array(text, '{split}'), lambda w: w <> '') AS ws FROM docs),
placed AS (SELECT r, i, w, {leads} FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM worded)),
found AS ({phrase}),
based AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list_distinct(list(label))) AS labels FROM found GROUP BY r),
templates(t, label, w, size, least, span) AS (VALUES {templates}),
hits AS (SELECT r, i, t, label, placed.w, size, least, span FROM placed JOIN templates USING (w)),
near AS (SELECT a.r, a.t, a.label, a.i, a.size, count(DISTINCT b.w) AS n FROM hits a JOIN hits b ON a.r = b.r AND a.t = b.t AND b.i >= a.i AND b.i < a.i + a.span GROUP BY ALL HAVING count(DISTINCT b.w) >= any_value(a.least)),
more AS (SELECT r, max(n::DOUBLE / size) AS score, list(label) AS labels FROM near GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(based.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.score, 0.0)::DOUBLE END AS score
FROM docs JOIN worded USING (r) LEFT JOIN based USING (r) LEFT JOIN more USING (r)"""


def url_filters() -> str:
    """The rounds of the propagation are unrolled."""
    rule = "NULL"
    for name, _ in sorted(urls.RULES, key=lambda r: (len(r[0]), r[0])):
        host, tail = name.split("/", 1)
        rule = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{tail}') THEN '{name}' ELSE {rule} END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in urls.RULES) + " END"
    d = f"{urls.DAMPING}::DOUBLE"
    rest = lambda flows, c, k: f"(SELECT sum(CASE WHEN {flows} THEN 1 - {d} ELSE 1 END * {c}) FROM s{k} JOIN flows USING (host))"
    rounds = ",\n".join(
        f"s{k + 1} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT host, {rest('gives', 'trust', k)} * good AS trust, {rest('takes', 'distrust', k)} * bad AS distrust FROM seeds UNION ALL SELECT dst, {d} * along * trust, {d} * back * distrust FROM s{k} JOIN way USING (host)) GROUP BY host)"
        for k in range(urls.ROUNDS)
    )
    return f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
    list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), {_quoted(urls.LINK)}, 1), lambda h: translate(h, {_AZ}))) AS links
  FROM pages),
matched AS (SELECT *, {rule} AS rule FROM split),
ruled AS (SELECT *, {verdict} AS ruled FROM matched),
hosts AS (SELECT host, count(*) AS n, 2 * count(*) FILTER (ruled = 'allow') > count(*) AS good, 2 * count(*) FILTER (ruled = 'block') > count(*) AS bad FROM ruled GROUP BY host),
total AS (SELECT count(*) AS hosts, greatest(1, count(*) FILTER (good)) AS good, greatest(1, count(*) FILTER (bad)) AS bad FROM hosts),
seeds AS (SELECT host, CASE WHEN hosts.good THEN 1.0::DOUBLE / total.good ELSE 0 END AS good, CASE WHEN hosts.bad THEN 1.0::DOUBLE / total.bad ELSE 0 END AS bad FROM hosts, total),
pairs AS (SELECT host AS src, dst, count(*)::DOUBLE AS n FROM (SELECT host, unnest(links) AS dst FROM ruled) WHERE host <> dst AND dst IN (SELECT host FROM hosts) GROUP BY 1, 2),
edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w, n / sum(n) OVER (PARTITION BY dst) AS v FROM pairs),
way AS (SELECT src AS host, dst, w AS along, 0.0::DOUBLE AS back FROM edges UNION ALL SELECT dst, src, 0.0::DOUBLE, v FROM edges),
flows AS (SELECT host, host IN (SELECT src FROM edges) AS gives, host IN (SELECT dst FROM edges) AS takes FROM hosts),
s0 AS (SELECT host, good AS trust, bad AS distrust FROM seeds),
{rounds},
scaled AS (SELECT host, trust * hosts AS trust, distrust * hosts AS distrust FROM s{urls.ROUNDS}, total)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust >= {urls.BLOCK_AT} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, round(trust, 6) AS trust, round(distrust, 6) AS distrust
FROM ruled JOIN scaled USING (host)"""


def embedding_near_dedup() -> str:
    """All pairs of a label; the operator's tables miss none of them where near vectors have near codes."""
    return f"""
WITH RECURSIVE
seen AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (SELECT * FROM seen WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {embeds.THRESHOLD}),
reach AS (SELECT r, vec_id AS least FROM seen UNION SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT r, min(least) AS component_id FROM reach GROUP BY r),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM seen JOIN least USING (r) LEFT JOIN counts USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules(), "op2_url_filters": url_filters(), "op5_line_dedup": line_dedup(), "op7_license_scans": license_scans(), "op9_embedding_near_dedup": embedding_near_dedup()}
