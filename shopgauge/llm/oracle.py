"""The operators that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _four_steps(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, two steps of four bits for each byte."""
    table = f"[{', '.join(str(_four_steps(n)) for n in range(16))}]"
    digit = "(strpos('0123456789ABCDEF', d[{}]) - 1)".format
    values = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda d: 16 * {digit(1)} + {digit(2)})"
    one = f"xor(xor(c, x) >> 4, {table}[(xor(c, x) & 15) + 1])"
    return f"xor(list_reduce({values}, lambda c, x: xor({one} >> 4, {table}[({one} & 15) + 1]), 4294967295), 4294967295)"


def _folded(text: str) -> str:
    """SQL for the words of a text, split at all of ASCII but digits and letters, A-Z in lower case."""
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def curve_steps(source: str, bits: int = 8) -> str:
    """Nested SELECTs that turn the axes x0, x1, x2 of `source` into the curve index, one bit of one axis at a time."""
    found = source
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(3):
            is_set, swap = f"(x{i} & {1 << bit}) != 0", f"(xor(x0, x{i}) & {low})"
            columns = f"CASE WHEN {is_set} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END AS x0"
            columns += f", CASE WHEN {is_set} THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}" if i else ""
            found = f"(SELECT * REPLACE ({columns}) FROM {found})"
    found = f"(SELECT * REPLACE (xor(x1, x0) AS x1, xor(xor(x2, x1), x0) AS x2) FROM {found})"
    flip = "0"
    for bit in range(1, bits):
        flip = f"xor({flip}, CASE WHEN (x2 & {1 << bit}) != 0 THEN {(1 << bit) - 1} ELSE 0 END)"
    found = f"(SELECT *, {flip} AS flip FROM {found})"
    parts = [f"(((xor(x{i}, flip) >> {bit}) & 1) << {3 * bit + 2 - i})" for bit in range(bits) for i in range(3)]
    return f"SELECT * EXCLUDE (x0, x1, x2, flip), {' + '.join(parts)} AS curve FROM {found}"


PAIRED = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"

ORACLE: dict[str, str] = {
    "op4_fair_queue": rf"""
WITH base AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size
  FROM documents
), units AS (
  SELECT doc_id, source, digest, size, count(*) AS copies_in, size * count(*) AS words,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || digest) AS place
  FROM base GROUP BY doc_id, source, digest, size
), sources AS (
  SELECT source, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM units GROUP BY source
), capped AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM capped
), targets AS (
  SELECT source, no, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels
), queued AS (
  SELECT u.*, t.no, t.source_size, t.target,
         sum(words) OVER (PARTITION BY t.no ORDER BY place, doc_id, digest ROWS UNBOUNDED PRECEDING)::BIGINT AS ahead
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, (copy * source_size + ahead)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND copy * source_size + ahead - words < target
), line AS (
  SELECT *, sum(words) OVER (ORDER BY finish, no, place, doc_id, digest, copy ROWS UNBOUNDED PRECEDING) AS sent FROM copies
), taken AS (
  SELECT doc_id, source, digest, count(*) AS n FROM line WHERE sent <= (SELECT sum(source_size) FROM sources) GROUP BY ALL
)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, q.target, (q.size * coalesce(t.n, 0))::BIGINT AS taken
FROM queued q
LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.digest = t.digest,
     unnest(range(q.copies_in)) AS each_row(i)
""",
    "op5_digest_index": rf"""
WITH rows_ AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{GAPS}', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, text_sha256
FROM rows_ WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
""",
    "op3_minhash": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM words UNION SELECT r.doc_id, b FROM reach r JOIN ways ON r.other = a
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
""",
    "op6_automata": rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM words, unnest(range(1, len(w) - 11)) AS t(i)
), firsts AS (
  SELECT k, min(doc_id) AS keeper FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (k) WHERE keeper < doc_id
), kept AS (
  SELECT doc_id, p, words.w[p] AS word, gone.p IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p FROM words) places JOIN words USING (doc_id) LEFT JOIN gone USING (doc_id, p)
)
SELECT words.doc_id, count(p)::BIGINT AS n_words, (count(p) FILTER (WHERE gone))::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) GROUP BY words.doc_id
""",
    "op10_simhash": rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents
), bench AS (
  SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark
), item AS (
  SELECT item_id, len(w) AS n, array_to_string(w[j:j + 4], ' ') AS k FROM bench, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(j)
), bag AS (
  SELECT *, sum(c) OVER (PARTITION BY item_id) AS total FROM (SELECT item_id, n, k, count(*) AS c FROM item GROUP BY item_id, n, k)
), places AS (
  SELECT doc_id, len(w) AS m, p - 1 AS p, array_to_string(w[p:p + 4], ' ') AS k
  FROM texts, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(p) WHERE len(w) > 0
), starts AS (
  SELECT DISTINCT doc_id, item_id, n, total, m, least(total, greatest(m - 4, 1)) AS span, least(p, greatest(m - n, 0)) AS s
  FROM places JOIN bag USING (k)
), held AS (
  SELECT starts.doc_id, starts.item_id, starts.n, starts.total, span, s, any_value(b.c) AS ic, count(*) AS dc
  FROM starts JOIN places USING (doc_id) JOIN bag b ON b.item_id = starts.item_id AND b.k = places.k
  WHERE p >= s AND p < s + span GROUP BY starts.doc_id, starts.item_id, starts.n, starts.total, span, s, places.k
), weighed AS (
  SELECT doc_id, item_id, n, s, sum(least(ic, dc)) AS shared, any_value(total) AS total, any_value(span) AS span
  FROM held GROUP BY doc_id, item_id, n, s
), best AS (
  SELECT *, shared::DOUBLE / (total + span - shared)::DOUBLE AS similarity FROM weighed WHERE 100 * shared >= 75 * (total + span - shared)
)
SELECT doc_id, item_id, arg_min(s, (-similarity, s))::INTEGER AS start_word, any_value(n)::INTEGER AS n_words, max(similarity) AS similarity
FROM best WHERE n >= 5 GROUP BY doc_id, item_id
UNION ALL
SELECT doc_id, item_id, min(p)::INTEGER - 1, any_value(len(b.w))::INTEGER, 1::DOUBLE
FROM bench b JOIN texts ON len(b.w) BETWEEN 1 AND 4, unnest(range(1, len(texts.w) - len(b.w) + 2)) AS t(p)
WHERE texts.w[p:p + len(b.w) - 1] = b.w GROUP BY doc_id, item_id
""",
    "op8_hilbert": f"""
WITH langs AS (
  SELECT lang, (row_number() OVER (ORDER BY lang NULLS FIRST) - 1) * 256 // count(*) OVER () AS step FROM (SELECT DISTINCT lang FROM documents)
), sources AS (
  SELECT source, (row_number() OVER (ORDER BY source NULLS FIRST) - 1) * 256 // count(*) OVER () AS step FROM (SELECT DISTINCT source FROM documents)
), sized AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size, length(bin(strlen(coalesce(text, '')) + 8)) AS bits FROM documents
), axes AS (
  SELECT doc_id, size, {crc32("text")} AS text_crc32, md5(coalesce(doc_id::VARCHAR, '') || ':' || text) AS place,
         langs.step::BIGINT AS x0, sources.step::BIGINT AS x1, least((bits - 1) * 4 + (((size << 2) >> (bits - 1)::INT) & 3), 255)::BIGINT AS x2
  FROM sized JOIN langs ON langs.lang IS NOT DISTINCT FROM sized.lang JOIN sources ON sources.source IS NOT DISTINCT FROM sized.source
), placed AS (
  {curve_steps("axes")}
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY curve, place, doc_id) - 1 AS r, count(*) OVER () AS n FROM placed
)
SELECT doc_id, size, text_crc32, 'rows' AS law, curve::BIGINT AS curve, (r * 24 // n)::INTEGER AS shard,
       r - ((r * 24 // n) * n + 23) // 24 AS slot, NULL::INTEGER AS grown_shard
FROM ranked
""",
    "op11_arrow_resampling": f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_folded("text")} AS w FROM documents
), target AS (
  SELECT {_folded("text")} AS w FROM benchmark
), grams AS (
  SELECT r, {PAIRED} AS f FROM docs
), wanted AS (
  SELECT {PAIRED} AS f FROM target
), hashed AS (
  SELECT f, {crc32("f")} % 10000 AS bucket FROM (SELECT f FROM grams UNION SELECT f FROM wanted)
), here AS (
  SELECT bucket, count(*) AS s FROM grams JOIN hashed USING (f) GROUP BY bucket
), there AS (
  SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (f) GROUP BY bucket
), counts AS (
  SELECT range AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, sum(coalesce(s, 0)) OVER () AS s_all, sum(coalesce(t, 0)) OVER () AS t_all
  FROM range(10000) LEFT JOIN here ON here.bucket = range LEFT JOIN there ON there.bucket = range
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), sums AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM grams JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r
), weighed AS (
  SELECT r, doc_id, len(w) >= 20 AS enough, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         (('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM docs LEFT JOIN sums USING (r)
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM weighed
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= drawn THEN place END AS rank
FROM (
  SELECT *, row_number() OVER (ORDER BY enough DESC, score DESC, doc_id NULLS LAST) AS place, 25 * count(*) FILTER (WHERE enough) OVER () // 100 AS drawn
  FROM scored
)
""",
    "op13_double_array": f"""
WITH own AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS donor, {crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, 0 AS part, pos, k, bytes FROM convs c JOIN own ON own.conv_id = donor AND pos <= h
  UNION ALL SELECT c.conv_id, 1 AS part, pos, k, bytes FROM convs c JOIN own ON own.conv_id = c.conv_id AND pos > h
), paths AS (
  SELECT conv_id, coalesce(any_value(l), []) AS l
  FROM convs LEFT JOIN (SELECT conv_id, list({{'k': k, 'bytes': bytes}} ORDER BY part, pos) AS l FROM turns GROUP BY conv_id) USING (conv_id) GROUP BY conv_id
), nodes AS (
  SELECT l[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(l) = d) AS ends
  FROM paths, unnest(range(0, len(l) + 1)) AS t(d) GROUP BY l[1:d], d
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY p[1:d - 1]
), known AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n - 1) * p[d].bytes ELSE 0 END AS saved FROM nodes LEFT JOIN children USING (p)
), below AS (
  SELECT p[1:e] AS p, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM known, unnest(range(0, d + 1)) AS t(e) GROUP BY p[1:e]
)
SELECT k.conv_id, k.d AS depth, up.conv_id AS parent_conv_id, k.n AS n_convs, k.n_children, n_leaves, saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM known k JOIN below ON below.p = k.p LEFT JOIN known up ON k.d > 0 AND up.d = k.d - 1 AND up.p = k.p[1:k.d - 1]
""",
}
