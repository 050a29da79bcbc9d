"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from . import quality

_WORD_GAP = r"[\x20\x09-\x0D]+"
_MEASURES = {
    "mark_ratio": "(n_marks + 1) / (word_chars + 50)",
    "word_length": "word_chars / n_words",
    "sameness": "1 - ln(n_distinct) / ln(n_words + 1)",
    "stutter_ratio": "(n_stutter + 1) / (n_words + 50)",
    "dup_line_ratio": "(n_dup_lines + 1) / (n_lines + 2)",
}


def quality_sql() -> str:
    """Counts by unnesting words, sketches as grouped bucket counts, fences and verdicts."""
    g, least = quality.GAMMA, quality.LEAST
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    measures = " UNION ALL ".join(f"SELECT doc_id, lang_key, source_key, '{m}' AS measure, ({e})::DOUBLE AS x FROM c WHERE NOT {failed}" for m, e in _MEASURES.items())
    both = ", ".join(f"'{m}'" for m, two in quality.MEASURES.items() if two)

    def quantiles(name: str, keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        value = f"CASE WHEN bucket = 0 THEN 0 ELSE {least} * power({g}, bucket) * 2 / ({g} + 1) END"
        cum = f"SELECT {by}, bucket, n, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY ALL)"
        return f"{name} AS (SELECT {by}, max(total) AS n, min({value}) FILTER (upto >= 0.25 * total) AS q25, min({value}) FILTER (upto >= 0.75 * total) AS q75 FROM ({cum}) GROUP BY {by})"

    def drawn(n: str, own: str, parent: str) -> str:
        return f"({n} * {own} + {quality.PRIOR} * {parent}) / ({n} + {quality.PRIOR})"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS lang_key, coalesce('=' || source, '') AS source_key FROM documents),
 w AS (SELECT *, list_filter(string_split_regex(t, '{_WORD_GAP}'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 p AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
 r AS (SELECT doc_id, count(DISTINCT i + k.range) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS often FROM p), range(0, 3) k WHERE often > 1 GROUP BY 1),
 s AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w) WHERE ws[i] = ws[i + 1] GROUP BY 1),
 c AS (SELECT doc_id, lang_key, source_key, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines, coalesce(s.n, 0) AS n_stutter,
   length(t) - length(regexp_replace(t, '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]', '', 'g')) AS n_marks, len(list_distinct(ws)) AS n_distinct FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
 m AS ({measures}),
 sketch AS (SELECT lang_key, source_key, measure, CASE WHEN x <= {least} THEN 0 ELSE ceil(ln(x / {least}) / ln({g}))::INT END AS bucket, count(*) AS n FROM m GROUP BY ALL),
 {quantiles("own", "lang_key, source_key")}, {quantiles("lang", "lang_key")}, {quantiles("every", "")},
 l AS (SELECT lang_key, measure, a AS q25, b AS q75, greatest(b - a, ({g} - 1) * b, {quality.PARENT_RANGE} * wide) AS wide
   FROM (SELECT lang_key, lang.measure, {drawn("lang.n", "lang.q25", "every.q25")} AS a, {drawn("lang.n", "lang.q75", "every.q75")} AS b, greatest(every.q75 - every.q25, ({g} - 1) * every.q75) AS wide FROM lang JOIN every ON lang.measure = every.measure)),
 cut AS (SELECT lang_key, source_key, measure, a - {quality.FENCE} * greatest(b - a, ({g} - 1) * b, {quality.PARENT_RANGE} * wide) AS low, b + {quality.FENCE} * greatest(b - a, ({g} - 1) * b, {quality.PARENT_RANGE} * wide) AS high
   FROM (SELECT own.lang_key, source_key, own.measure, {drawn("own.n", "own.q25", "l.q25")} AS a, {drawn("own.n", "own.q75", "l.q75")} AS b, l.wide AS wide FROM own JOIN l ON own.lang_key = l.lang_key AND own.measure = l.measure)),
 good AS (SELECT doc_id, bool_and(x <= high AND (x >= low OR measure NOT IN ({both}))) AS good FROM m JOIN cut USING (lang_key, source_key, measure) GROUP BY 1)
 SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  {failed} AS base_failed, coalesce(good, false) AS kept FROM c LEFT JOIN good USING (doc_id)"""


def embeddings_sql(threshold: float = 0.95) -> str:
    """All pairs, and reachability by recursion; for small tables."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
 reach(s, r) AS (SELECT a, a FROM links UNION SELECT reach.s, links.b FROM reach JOIN links ON reach.r = links.a),
 c AS (SELECT s AS vec_id, min(r) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
 SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""


def interaction_sql() -> str:
    """Masks by expressions and a window minimum, orders by recursion over the letters."""
    return """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
 f AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(smallest < doc_id, false)] AS fails FROM w),
 g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
 m AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY ALL),
 o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || letter FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(filter_order, letter)),
 s AS (SELECT filter_order, i::INT AS step, ord(filter_order[i]) - 64 AS own, list_transform(range(1, i), lambda j: ord(filter_order[j]) - 64) AS before FROM o, range(1, 6) r(i) WHERE length(filter_order) = 5),
 x AS (SELECT *, fails[own] AS failing, len(list_filter(before, lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS k FROM s, m),
 y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
   coalesce(sum(n) FILTER (failing AND k = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
 SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM y"""


def repair_sql() -> str:
    """CRC-32 by bits, faults by windows, the cheapest edits by recursion over rows and states, the replay by positions of letters."""
    return """WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 h AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT), lambda acc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, b)), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM c),
 d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
 o AS (SELECT *, coalesce('=' || conv_id, '') AS ck, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i FROM d),
 f AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank, row_number() OVER (PARTITION BY ck, role, text ORDER BY i) > 1 AS seen,
   NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY ck ORDER BY i) || left(role, 1) AS pair FROM o),
 r AS (SELECT *, CASE WHEN is_blank OR seen THEN 'x' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS role_symbol, NOT is_blank AND NOT seen AND cut AS is_cut FROM f),
 ins(s, mid, ic, il) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (2, 2, 10, 'II'), (3, 3, 0, ''), (3, 2, 5, 'I'), (3, 3, 10, 'II')),
 ops(mid, symbol, t, oc, ol) AS (SELECT mid, symbol, mid, 2, 'D' FROM (VALUES (0), (1), (2), (3)) a(mid), (VALUES ('s'), ('u'), ('a'), ('o'), ('x')) b(symbol)
   UNION ALL SELECT mid, symbol, CASE mid WHEN 2 THEN 3 ELSE 2 END, 1, 'R' FROM (VALUES (0), (1), (2), (3)) a(mid), (VALUES ('s'), ('u'), ('a'), ('o')) b(symbol)
   UNION ALL VALUES (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'), (3, 'u', 2, 0, 'K')),
 dp(ck, i, s, cost, audit) AS (SELECT DISTINCT ck, 0::BIGINT, 0, 0::BIGINT, '' FROM r UNION ALL
   SELECT ck, i, s, cost, audit FROM (SELECT dp.ck, dp.i + 1 AS i, ops.t AS s, dp.cost + ic + oc + CASE WHEN r.is_cut AND ol <> 'D' THEN 5 ELSE 0 END AS cost, dp.audit || il || ol AS audit
     FROM dp JOIN r ON r.ck = dp.ck AND r.i = dp.i + 1 JOIN ins ON ins.s = dp.s JOIN ops ON ops.mid = ins.mid AND ops.symbol = r.role_symbol) QUALIFY row_number() OVER (PARTITION BY ck, s ORDER BY cost, audit) = 1),
 n AS (SELECT ck, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (seen AND NOT is_blank) AS duplicate, count(*) FILTER (is_cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
 e AS (SELECT dp.ck, cost + ic AS cost, audit || il AS audit FROM dp JOIN n ON n.ck = dp.ck AND n.n = dp.i JOIN ins ON ins.s = dp.s AND ins.mid IN (0, 3) QUALIFY row_number() OVER (PARTITION BY dp.ck ORDER BY cost + ic, audit || il) = 1),
 l AS (SELECT ck, j, audit[j] AS letter, length(replace(audit[:j], 'I', '')) AS i, length(replace(audit[:j], 'D', '')) AS p FROM (SELECT ck, audit, unnest(range(1, length(audit) + 1)) AS j FROM e)),
 p AS (SELECT l.ck, l.p, l.letter, r.role, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text, bool_or(l.p = 1 AND letter = 'K' AND r.initial = 's') OVER (PARTITION BY l.ck) AS has_system FROM l JOIN r ON r.ck = l.ck AND r.i = greatest(l.i, 1) WHERE letter <> 'D'),
 q AS (SELECT ck, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - has_system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS sha FROM p GROUP BY 1)
 SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS ck FROM conversations) ids LEFT JOIN n USING (ck) LEFT JOIN e USING (ck) LEFT JOIN q USING (ck)"""


def lines_sql() -> str:
    """Lines unnested, keys grouped, the others joined again in order."""
    gap = r"[\x20\x09-\x0D]"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 l AS (SELECT r, doc_id, i, ls[i] AS line, translate(regexp_replace(regexp_replace(ls[i], '^{gap}+', ''), '{gap}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
 o AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY 1 HAVING count(DISTINCT r) >= 5),
 m AS (SELECT l.*, o.k IS NOT NULL AND l.doc_id IS DISTINCT FROM o.last AS dropped FROM l LEFT JOIN o USING (k))
 SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality": quality_sql(), "op5_embeddings": embeddings_sql(), "op11_filter_audit": interaction_sql(), "op12_line_dedup": lines_sql(),
        "op13_conversations": repair_sql(),
    }
