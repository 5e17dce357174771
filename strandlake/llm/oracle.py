"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import quality_rules as Q

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"[^\x20\x09-\x0D]+"

#: Similar sets share one of their rarest n - ceil(0.8 n) + 1 shingles; sets are compared in full.
NEAR_DEDUP = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM split),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
each AS (SELECT c, n, unnest(s) AS x FROM classes),
often AS (SELECT x, count(*) AS df FROM each GROUP BY x),
rare AS (SELECT c, n, x FROM (SELECT c, n, x, df, row_number() OVER (PARTITION BY c ORDER BY df, x) AS k FROM each JOIN often USING (x)) WHERE k <= n - (8 * n + 9) // 10 + 1 AND df > 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM rare a JOIN rare b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS MATERIALIZED (SELECT a, b FROM (SELECT p.a, p.b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS i FROM pairs p JOIN classes x ON x.c = p.a JOIN classes y ON y.c = p.b) WHERE 100 * i >= 80 * (total - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS root FROM classes UNION SELECT ways.b, reach.root FROM reach JOIN ways USING (a)),
named AS (SELECT a AS c, min(root) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(n.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(n.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN classes k ON k.s = d.s LEFT JOIN named n USING (c)
"""

#: Strings of 100 bytes as 200 hexadecimal digits; runs of repeats less than 100 starts apart are one span.
SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM docs)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM starts) WHERE k > 1),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= 100 THEN 0 ELSE 1 END AS head FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked) GROUP BY doc_id, span),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS k FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

# Java's classes of letters in the other engine's spelling are the same for these patterns.
_COUNTS = ", ".join(f"(length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')))::DOUBLE AS c_{k}" for k, p in Q.CLASSES.items())
_CLASSES = ", ".join(f"c_{k}" for k in Q.CLASSES)
_KNOWN = ", ".join(f"len(list_filter(low, lambda x: x = '{w}'))::DOUBLE" for w in Q.WORDS)


def _distance(counts: str, reference: str) -> str:
    """The least distance over the references' histograms, as a correlated subquery."""
    share = lambda x: f"list_transform({x}, lambda v: v / list_sum({x}))"
    entropy = lambda x: f"-list_sum(list_transform({x}, lambda v: CASE WHEN v > 0 THEN v * log2(v) ELSE 0 END))"
    p, q = share(f"m.{counts}"), share(f"r.{reference}")
    middle = f"list_transform(list_zip({p}, {q}), lambda z: (z[1] + z[2]) / 2)"
    return f"sqrt(greatest(0, {entropy(middle)} - ({entropy(p)} + {entropy(q)}) / 2))"


QUALITY_RULES = f"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '{WORDS}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM docs),
tri AS (SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM tri), range(0, 3) u(k) WHERE times > 1 GROUP BY doc_id),
counted AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(t) AS chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, list_transform(list_filter(w, lambda x: length(x) <= {Q.LONGEST}), lambda x: lower(x)) AS low, {_COUNTS} FROM split LEFT JOIN again USING (doc_id)),
m AS MATERIALIZED (SELECT doc_id, lang, n_words, (chars - c_space)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{_CLASSES}, chars - ({' + '.join(f'c_{k}' for k in Q.CLASSES)})] AS cc, list_concat(known, [n_words - list_sum(known)]) AS wc FROM (SELECT *, [{_KNOWN}] AS known FROM counted)),
long AS (SELECT lang, 'c' AS kind, unnest(range(1, len(cc) + 1)) AS k, unnest(cc) AS x FROM m WHERE NOT base_failed AND lang IN {Q.LANGUAGES} UNION ALL SELECT lang, 'w', unnest(range(1, len(wc) + 1)), unnest(wc) FROM m WHERE NOT base_failed AND lang IN {Q.LANGUAGES}),
refs AS MATERIALIZED (SELECT lang, kind, list(x ORDER BY k) AS q FROM (SELECT lang, kind, k, sum(x) AS x FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2),
near AS (SELECT m.doc_id, min(CASE WHEN kind = 'c' AND chars >= {Q.MIN_CHARS} THEN {_distance('cc', 'q')} END) AS cd, min(CASE WHEN kind = 'w' AND n_words >= {Q.MIN_WORDS} THEN {_distance('wc', 'q')} END) AS wd FROM m, refs r GROUP BY m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd <= {Q.MAX_CHAR_DISTANCE}, true) AND coalesce(wd <= {Q.MAX_WORD_DISTANCE}, true) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM m LEFT JOIN near USING (doc_id)
"""

#: The table of the byte-wise checksum, made from its polynomial; `crc` takes a column of bytes as a list of integers.
_CRC_TABLE = "(SELECT list(c ORDER BY b) FROM (SELECT b, list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) AS c FROM range(256) r(b)))"


def _crc(text: str, table: str) -> str:
    h = f"hex(encode({text}))"
    values = f"list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {values}), lambda x, y: xor(x >> 8, {table}[(xor(x, y) & 255) + 1])))"


#: Equal words q apart, in unbroken stretches; the least period of a stretch is that of the run.
PERIODIC_RUNS = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w, coalesce({_crc("doc_id::VARCHAR", "crc")}, 1) AS h FROM documents, crc),
made AS (SELECT r, doc_id, w, h, len(w) AS n, h // 10 AS g FROM docs),
turned AS MATERIALIZED (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE w END AS w, n FROM made),
words AS MATERIALIZED (SELECT r, i, n, w[i + 1] AS x FROM (SELECT r, n, w, unnest(range(0, n)) AS i FROM turned)),
equal AS (SELECT a.r, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.r = b.r AND a.x = b.x AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal) GROUP BY r, q, island),
runs AS MATERIALIZED (SELECT r, s, size, min(q) AS q FROM stretches WHERE size >= 24 AND size >= 3 * q GROUP BY r, s, size),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
best AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY r ORDER BY size / q DESC, s, q) AS k FROM runs x) WHERE k = 1),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, size::BIGINT AS length, q::BIGINT AS period, (1000 * size // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM turned LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

#: Words one edit apart agree with a letter left out at some place (or one of them as a whole does).
SPELLING_VARIANTS = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
found AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n FROM found WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT w, n, coalesce({_crc("doc_id::VARCHAR || ':' || w", "crc")}, 1) AS h FROM each, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS p FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.d = b.d AND a.p = b.p AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN forms f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, k) AS root FROM way GROUP BY word) USING (word)
"""

SQL = {"op12_periodic_runs": PERIODIC_RUNS, "op13_spelling_variants": SPELLING_VARIANTS, "op3_near_dedup": NEAR_DEDUP, "op4_suffix_dedup": SUFFIX_DEDUP, "op9_quality_rules": QUALITY_RULES}
