"""SQL that should give the rows of the encoder's core: code tables by a recursive query over a sorted list as heap, greedy
codes by an equi-join of all places with the keys' first bits and a recursive walk from match to match."""

from __future__ import annotations

from helixframe.constants import FALLBACK, FNV_PRIME, FNV_SEED, PAYLOAD_NT, PRIMER_LEFT, PRIMER_RIGHT, STRAND_NT


def pairs_sql(text: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FALLBACK.items())
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({text}, '..?'), lambda z: CASE z {whens} END), ''), '')"


def book_sql(reps: str, count_sql, g: str) -> str:
    """CTEs up to book(g, substr, code, n): n, the shortest key's length. g: doc_id, or another column of documents."""
    return f"""{reps}, o AS (SELECT doc_id, {g} AS g FROM documents),
c AS (SELECT g, substr, {count_sql('s', 'substr')} AS hits FROM (
SELECT doc_id, s, s[1 : lp] AS substr FROM r WHERE len(s) > 3 AND lp >= 3
UNION ALL SELECT doc_id, s, s[len(s) - ls + 1 :] FROM r WHERE len(s) > 3 AND ls >= 3 AND NOT (ls <= lp AND s[len(s) - ls + 1 :] = s[1 : ls])) JOIN o USING (doc_id)),
f AS (SELECT g, substr, sum(hits)::BIGINT AS freq FROM c GROUP BY g, substr),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY len(substr) DESC, freq DESC, substr) AS rank, least(512, count(*) OVER (PARTITION BY g)) AS n0 FROM f),
z AS (SELECT g, n0, count(*) FILTER (WHERE rank <= 512 AND len(substr) >= 2 * (SELECT min(e) FROM range(0, 11) y(e) WHERE (1 << e) >= n0) + 1) AS m FROM k GROUP BY g, n0),
t AS MATERIALIZED (SELECT k.g, substr, freq, rank FROM k JOIN z ON k.g IS NOT DISTINCT FROM z.g WHERE CASE WHEN z.n0 <= 1 THEN rank <= z.n0 WHEN m > 0 THEN rank <= m ELSE true END),
heaps(g, fresh, heap, a, b) AS (
SELECT g, count(*), list_sort(list({{'f': freq, 'k': rank - 1}})), -1::BIGINT, -1::BIGINT FROM t GROUP BY g
UNION ALL SELECT g, fresh + 1, list_sort(list_append(heap[3:], {{'f': heap[1].f + heap[2].f, 'k': fresh}})), heap[1].k, heap[2].k FROM heaps WHERE len(heap) > 1),
e AS MATERIALIZED (SELECT g, fresh - 1 AS parent, a AS child, 0 AS side FROM heaps WHERE a >= 0 UNION ALL SELECT g, fresh - 1, b, 1 FROM heaps WHERE a >= 0),
w(g, node, code) AS (SELECT g, max(parent), '' FROM e GROUP BY g
UNION ALL SELECT w.g, child, code || CASE WHEN len(code) % 2 = 0 THEN 'GC'[side + 1] ELSE 'AT'[side + 1] END FROM w JOIN e ON w.g IS NOT DISTINCT FROM e.g AND node = parent),
book AS MATERIALIZED (SELECT t.g, substr, code, min(len(substr)) OVER (PARTITION BY t.g) AS n FROM t JOIN w ON t.g IS NOT DISTINCT FROM w.g AND node = rank - 1 WHERE len(code) > 1)"""


def coded_sql(reps: str, count_sql, g: str) -> str:
    """CTEs up to coded(doc_id, seg_id, dna)."""
    return f"""{book_sql(reps, count_sql, g)},
place AS (SELECT doc_id, seg_id, s, r.g, unnest(range(1, len(s) - n + 2)) AS i, n FROM (SELECT r.*, g FROM r JOIN o USING (doc_id)) r JOIN (SELECT DISTINCT g, n FROM book) u ON r.g IS NOT DISTINCT FROM u.g WHERE len(s) >= n),
hit AS (SELECT doc_id, seg_id, i, max(len(substr)) AS n, arg_max(code, len(substr)) AS code FROM place JOIN (SELECT *, substr[1 : n] AS head FROM book) x ON place.g IS NOT DISTINCT FROM x.g AND substring(s, i, place.n) = head
WHERE substring(s, i, len(substr)) = substr GROUP BY doc_id, seg_id, i),
hits AS (SELECT doc_id, seg_id, list({{'i': i, 'n': n, 'code': code}} ORDER BY i) AS rest FROM hit GROUP BY doc_id, seg_id),
walk(doc_id, seg_id, s, pos, rest, out, nx) AS (
SELECT doc_id, seg_id, s, 1::BIGINT, rest, '', list_filter(rest, lambda x: x.i % 2 = 1)[1] FROM r LEFT JOIN hits USING (doc_id, seg_id)
UNION ALL SELECT doc_id, seg_id, s, nx.i + nx.n, rest, out || {pairs_sql('s[pos : nx.i - 1]')} || nx.code, list_filter(rest, lambda x: x.i >= nx.i + nx.n AND (x.i - nx.i - nx.n) % 2 = 0)[1] FROM walk WHERE nx IS NOT NULL),
coded AS (SELECT doc_id, seg_id, out || {pairs_sql('s[pos :]')} AS dna FROM walk WHERE nx IS NULL)"""


def payload_sql(reps: str, count_sql, g: str) -> str:
    """CTEs up to n(doc_id, n_bytes, segments, dna) and b(doc_id, block_id, block)."""
    return f"""{coded_sql(reps, count_sql, g)},
n AS MATERIALIZED (SELECT doc_id, octet_length(encode(any_value(text)))::BIGINT AS n_bytes, count(*) AS segments, string_agg(dna, '' ORDER BY seg_id) AS dna FROM coded JOIN documents USING (doc_id) GROUP BY doc_id),
b AS (SELECT doc_id, i::INT AS block_id, dna[i * {PAYLOAD_NT} + 1 : i * {PAYLOAD_NT} + {PAYLOAD_NT}] AS block FROM (SELECT doc_id, dna, unnest(range(0, (len(dna) + {PAYLOAD_NT - 1}) // {PAYLOAD_NT})) AS i FROM n))"""


CHECKED = """x AS (SELECT doc_id, block_id, block, len(regexp_replace(block, '[AT]', '', 'g'))::INT AS gc, list_max(list_transform(regexp_extract_all(block, 'A+|C+|G+|T+'), lambda z: len(z)))::INT AS rll, len(regexp_replace(right(block, 5), '[AT]', '', 'g'))::INT AS endgc FROM b)"""


def fold_sql(text: str) -> str:
    """The fingerprint of a text, a character at a time."""
    numbers = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::UHUGEINT)"
    fold = f"list_reduce(list_prepend({FNV_SEED}::UHUGEINT, {numbers}), lambda h, z: (xor(h, z) * {FNV_PRIME}::UHUGEINT) & 18446744073709551615::UHUGEINT)"
    return f"lower(lpad(printf('%x', {fold}::UBIGINT), 16, '0'))"


def oracle_sql(reps: str, count_sql, digits_sql) -> dict[str, str]:
    o = {}
    start = "WITH RECURSIVE "
    o["huffman_codes"] = f"{start}{book_sql(reps, count_sql, 'doc_id')} SELECT g AS doc_id, substr AS keys, code AS codes FROM book"
    o["corpus_codes"] = f"{start}{book_sql(reps, count_sql, 'source')} SELECT g AS source, substr AS keys, code AS codes FROM book"
    o["encode_segments"] = f"{start}{coded_sql(reps, count_sql, 'doc_id')} SELECT * FROM coded"
    o["payload_dna"] = f"{start}{payload_sql(reps, count_sql, 'doc_id')} SELECT * FROM n"
    o["encode_corpus"] = f"{start}{payload_sql(reps, count_sql, 'source')} SELECT * FROM n"
    o["storage_strands"] = f"{start}{payload_sql(reps, count_sql, 'doc_id')} SELECT doc_id, block_id, '{PRIMER_LEFT}' || {digits_sql('block_id::BIGINT')} || rpad(block, {PAYLOAD_NT}, 'A') || '{PRIMER_RIGHT}' AS strand FROM b"
    o["dna_fingerprint"] = f"""{start}{payload_sql(reps, count_sql, 'doc_id')},
y AS (SELECT doc_id, string_agg('{PRIMER_LEFT}' || {digits_sql('block_id::BIGINT')} || rpad(block, {PAYLOAD_NT}, 'A') || '{PRIMER_RIGHT}', '' ORDER BY block_id) AS strands FROM b GROUP BY doc_id)
SELECT doc_id, {fold_sql('dna')} AS dna_hash_payload, {fold_sql('strands')} AS dna_hash_storage FROM n JOIN y USING (doc_id)"""
    o["timed_documents"] = f"""{start}{payload_sql(reps, count_sql, 'doc_id')}, {CHECKED},
y AS (SELECT doc_id, round(avg(gc / 120.0::DOUBLE), 6) AS gc_mean, max(rll)::INT AS rll_max, (count(*) FILTER (WHERE rll > 2))::INT AS rll_violations, (count(*) FILTER (WHERE endgc > 3))::INT AS end_violations, count(*)::INT AS seq_count FROM x GROUP BY doc_id)
SELECT doc_id::VARCHAR AS dataset, coalesce(source, '') AS file_name, n_bytes AS file_size_bytes, 1::INT AS runs, segments::INT AS segments, seq_count, rll_max, rll_violations, end_violations, gc_mean, true AS timed FROM n JOIN y USING (doc_id) JOIN documents USING (doc_id)"""
    o["encode_metrics"] = f"""{start}{payload_sql(reps, count_sql, 'doc_id')}, {CHECKED},
y AS (SELECT doc_id, avg(gc / 120.0::DOUBLE) AS gc_mean, var_pop(gc / 120.0::DOUBLE) AS gc_var, max(rll)::BIGINT AS rll_max, count(*) FILTER (WHERE rll > 2) AS rll_violations, count(*) FILTER (WHERE endgc > 3) AS end_violations, count(*) AS strands FROM x GROUP BY doc_id),
q AS (SELECT doc_id, avg(CASE WHEN len(s) < 4 THEN 0 ELSE greatest(lp, ls) END) AS best FROM r GROUP BY doc_id)
SELECT doc_id, n_bytes, n_bytes * 8 AS n_bits, segments, len(dna)::BIGINT AS nt, strands AS storage_seq_count, rll_max, rll_violations, end_violations, round(gc_mean, 6) AS gc_mean, round(gc_var, 6) AS gc_var,
round(n_bytes * 8 / len(dna)::DOUBLE, 6) AS encoding_rate_bits_per_nt, round(n_bytes * 8 / ({STRAND_NT} * strands)::DOUBLE, 6) AS gross_rate_bits_per_nt, round(best, 6) AS avg_best_lsbm_len FROM n JOIN y USING (doc_id) JOIN q USING (doc_id)"""
    return o
