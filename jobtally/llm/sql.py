"""The same results in DuckDB SQL, for the operators that SQL can express."""

# Targets: sources in the order of cap by weight are capped as long as the cap lies below the common level of the rest.
# Selection: whole passes, then the seeded order up to the remainder, then the one document that brings the sum nearest.
MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '') || chr(31) || md5(coalesce(text, ''))) AS place, row_number() OVER () AS nr_row FROM documents),
held AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1)::INT % 3 + 1]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS nr FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, nr) AS turn FROM held),
level AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM ordered),
stop AS (
  SELECT min(turn) AS first_shared, arg_min(rest / rest_weight, turn) AS shared FROM level WHERE cap / weight > rest / rest_weight),
targets AS (
  SELECT source, source_size, CASE WHEN turn >= first_shared THEN weight * shared ELSE cap END AS target FROM level, stop),
needed AS (
  SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS want,
         CASE WHEN source_size > 0 THEN least(floor(target + 0.5)::BIGINT, 2 * source_size) // source_size ELSE 0 END AS passes
  FROM targets),
running AS (
  SELECT s.*, n.source_size, n.target, n.passes, n.want - n.passes * n.source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY place, nr_row ROWS UNBOUNDED PRECEDING)
           <= n.want - n.passes * n.source_size AS fits
  FROM sized s JOIN needed n ON s.source IS NOT DISTINCT FROM n.source),
gaps AS (
  SELECT source, max(rest) - coalesce(sum(size) FILTER (fits), 0) AS gap FROM running GROUP BY source),
last AS (
  SELECT r.source, arg_min(nr_row, (abs(gap - size), place, nr_row)) AS best
  FROM running r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source
  WHERE NOT fits AND abs(gap - size) < gap GROUP BY r.source)
SELECT doc_id, size, r.source_size, r.target,
       ((passes + CASE WHEN fits OR nr_row = best THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM running r LEFT JOIN last l ON r.source IS NOT DISTINCT FROM l.source
"""

# The marker character that breaks "<|" up in texts is the zero-width space.
PREFERENCE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         role, text FROM conversations WHERE conv_id IS NOT NULL),
answers AS (SELECT conv_id, max(pos) AS pos FROM t WHERE role = 'assistant' GROUP BY conv_id),
partners AS (
  SELECT a.conv_id, a.pos AS last, o.conv_id IS NOT NULL AS found, o.role, o.text
  FROM answers a LEFT JOIN (SELECT t.* FROM t JOIN answers USING (conv_id, pos)) o ON o.conv_id = xor(a.conv_id, 1)),
rejected AS (
  SELECT t.conv_id, t.pos, CASE WHEN t.pos = last THEN p.role ELSE t.role END AS role, CASE WHEN t.pos = last THEN p.text ELSE t.text END AS text
  FROM t LEFT JOIN partners p ON t.conv_id = p.conv_id WHERE p.conv_id IS NULL OR found OR t.pos < last),
common AS (
  SELECT t.conv_id, coalesce(min(t.pos) FILTER (r.pos IS NULL OR t.text IS DISTINCT FROM r.text OR t.role IS DISTINCT FROM r.role) - 1,
                             max(t.pos)) AS n
  FROM t LEFT JOIN rejected r ON t.conv_id = r.conv_id AND t.pos = r.pos GROUP BY t.conv_id),
sides AS (SELECT conv_id, pos, 'c' AS side, role, text FROM t UNION ALL SELECT conv_id, pos, 'r', role, text FROM rejected),
parts AS (
  SELECT s.*, n, '<|' || replace(coalesce(role, ''), '<|', '<​|') || '|>' || chr(10) AS head,
         replace(coalesce(text, ''), '<|', '<​|') || '<|end|>' || chr(10) AS body
  FROM sides s JOIN common USING (conv_id)),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side, pos > n ORDER BY pos) AS stop FROM parts)
SELECT conv_id, CAST(any_value(n) AS INT) AS n_common,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side = 'c' AND pos <= n), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side = 'c' AND pos > n), '') AS chosen_text,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY pos)
                FILTER (side = 'c' AND pos > n AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side = 'r' AND pos > n), '') AS rejected_text,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY pos)
                FILTER (side = 'r' AND pos > n AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
"""

# Bins hold the leading ten binary digits of a whole number; quartiles are the middle of the bin that reaches them.
QUALITY_RULES = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
windows AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
often AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS times FROM windows) WHERE times > 1),
covered AS (SELECT rid, count(DISTINCT i + step) AS n FROM often, (VALUES (0), (1), (2)) AS s(step) GROUP BY rid),
counts AS (
  SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
measured AS (
  SELECT rid, lang, source, base_failed, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS measure,
         unnest([1000000 * word_chars // greatest(n_words, 1), 1000000 * n_symbols // greatest(n_words, 1),
                 1000000 * n_dup_lines // greatest(n_lines, 1), 1000000 * n_repeat_words // greatest(n_words, 1)]) AS v,
         unnest([100000, 50000, 150000, 100000]) AS least_spread FROM judged),
binned AS (
  SELECT lang, source, measure, least_spread, (v >> greatest(length(bin(v)) - 10, 0)) << greatest(length(bin(v)) - 10, 0) AS bin
  FROM measured WHERE NOT base_failed),
grouped AS (
  SELECT 0 AS level, lang, source, measure, least_spread, bin FROM binned
  UNION ALL SELECT 1, lang, NULL, measure, least_spread, bin FROM binned UNION ALL SELECT 2, NULL, NULL, measure, least_spread, bin FROM binned),
summed AS (SELECT level, lang, source, measure, least_spread, bin, count(*) AS n FROM grouped GROUP BY ALL),
running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS reached,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM summed),
quartiles AS (
  SELECT level, lang, source, measure, least_spread, max(total) AS n, min(bin) FILTER (4 * reached >= total) AS q1,
         min(bin) FILTER (4 * reached >= 3 * total) AS q3 FROM running GROUP BY ALL),
middles AS (
  SELECT * REPLACE (q1 + ((1::BIGINT << greatest(length(bin(q1)) - 10, 0)) >> 1) AS q1,
                    q3 + ((1::BIGINT << greatest(length(bin(q3)) - 10, 0)) >> 1) AS q3) FROM quartiles),
chosen AS (
  SELECT o.lang, o.source, o.measure, o.least_spread,
         CASE WHEN o.n >= 100 THEN o.q1 WHEN l.n >= 100 THEN l.q1 ELSE e.q1 END AS q1,
         CASE WHEN o.n >= 100 THEN o.q3 WHEN l.n >= 100 THEN l.q3 ELSE e.q3 END AS q3
  FROM middles o JOIN middles l ON o.level = 0 AND l.level = 1 AND o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure
  JOIN middles e ON e.level = 2 AND e.measure = o.measure),
outside AS (
  SELECT DISTINCT rid FROM measured m JOIN chosen c
    ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source AND m.measure = c.measure
  WHERE v < q1 - 3 * greatest(q3 - q1, c.least_spread) OR v > q3 + 3 * greatest(q3 - q1, c.least_spread))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM outside) AS kept FROM judged
"""

SEARCH = r"""
WITH words AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
sizes AS (SELECT d, doc_id, count(*) AS n FROM words GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
held AS (SELECT d, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, whole GROUP BY term, docs),
gains AS (
  SELECT d, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS gain
  FROM held JOIN weights USING (term) JOIN sizes USING (d), whole),
scored AS (SELECT i, item_id, d, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN sizes USING (d) WHERE score > 0) WHERE rank <= 50
"""

ORACLES: dict[str, str] = {"op6_preference": PREFERENCE, "op9_mixing": MIXING, "op11_quality_rules": QUALITY_RULES,
                           "op13_lexical_search": SEARCH}
