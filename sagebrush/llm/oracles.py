"""DuckDB SQL of the operators that SQL can express, on the registered views."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FEATURES = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

MINHASH = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, md5_number(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS reach FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reach),
c AS (SELECT id, min(reach) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""

LINES = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (SELECT *, translate(trim(line, {_BLANK}), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS dropped FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS et,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS er FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + length(er) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS last FROM d GROUP BY h),
bits AS (SELECT h, array_to_string(list_transform(range(1, 41), lambda i: right(CAST(CAST(CAST('0x' || substr(h, i, 1) AS INTEGER) AS BIT) AS VARCHAR), 4)), '') AS b FROM m),
b32 AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, CAST(i * 5 + j + 1 AS BIGINT), 1) AS INTEGER) * (1 << CAST(4 - j AS INTEGER)))) AS BIGINT) + 1, 1)), '') AS s FROM bits)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, b32.s AS payload_digest,
  CASE WHEN d.page_id = m.last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> m.last THEN m.last END AS refers_to
FROM d JOIN m ON m.h = d.h JOIN b32 ON b32.h = d.h
"""

MIXING = """
WITH RECURSIVE c AS (SELECT source, (count(*) + 63) // 64 AS blocks, CAST(floor(sqrt(count(*)) * 1048576) AS HUGEINT) AS w FROM documents GROUP BY source),
o AS (SELECT list(w ORDER BY source NULLS FIRST) AS w, list(blocks ORDER BY source NULLS FIRST) AS b, list(source ORDER BY source NULLS FIRST) AS s, sum(blocks) AS n, CAST(sum(w) AS HUGEINT) AS whole FROM c),
sim AS (
  SELECT CAST(0 AS HUGEINT) AS slot, CAST(0 AS HUGEINT) AS start, list_transform(w, lambda x: CAST(0 AS HUGEINT)) AS base, list_transform(w, lambda x: CAST(0 AS HUGEINT)) AS done,
    list_transform(w, lambda x: true) AS live, whole, true AS target, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS HUGEINT) AS turn FROM o
  UNION ALL
  SELECT CASE WHEN done[best] < b[best] THEN slot + 1 ELSE slot END,
    CASE WHEN done[best] < b[best] THEN start ELSE slot END,
    CASE WHEN done[best] < b[best] THEN base ELSE done END,
    CASE WHEN done[best] < b[best] THEN list_transform(done, lambda v, i: v + CASE WHEN i = best THEN 1 ELSE 0 END) ELSE done END,
    CASE WHEN done[best] < b[best] THEN live ELSE list_transform(live, lambda v, i: v AND i <> best) END,
    CASE WHEN done[best] < b[best] THEN whole ELSE whole - w[best] END,
    target AND done[best] < b[best],
    CASE WHEN done[best] < b[best] THEN best END,
    CASE WHEN done[best] < b[best] THEN done[best] END
  FROM (
    SELECT * EXCLUDE (due), CAST(list_position(due, list_min(due)) AS BIGINT) AS best FROM (
      SELECT sim.slot, sim.start, sim.base, sim.done, sim.live, sim.whole, sim.target, o.w, o.b, list_transform(sim.done, lambda v, i: CASE
        WHEN sim.live[i] AND (v - sim.base[i]) * sim.whole // o.w[i] <= sim.slot - sim.start
        THEN ((v - sim.base[i] + 1) * sim.whole + o.w[i] - 1) // o.w[i] END) AS due
      FROM sim, o WHERE sim.slot < o.n
    )
  )
),
t AS (SELECT o.s[pick] AS source, turn, slot - 1 AS slot, target FROM sim, o WHERE pick IS NOT NULL),
k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM documents)
SELECT doc_id, k.source, CAST(t.slot AS BIGINT) AS mix_slot, CAST(rank % 64 AS BIGINT) AS mix_pos, t.target AS in_target
FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source AND t.turn = k.rank // 64
"""

# the patterns and classes are those of the operator, written out
SECRETS = r"""
WITH k(kind, name, pattern, own, wide, bits) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8, 0, 0.0),
  (1, 'access', 'AKIA[A-Z0-9]+', 16, 0, 0.0), (2, 'hex', '[0-9a-f]+', 32, 0, 0.0),
  (3, 'entropy_hex', '[0-9A-Fa-f]+', 16, 16, 2.8), (4, 'entropy_alnum', '[0-9A-Za-z]+', 20, 20, 3.8), (5, 'entropy_base64', '[0-9A-Za-z+/_=-]+', 24, 24, 4.05)
), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (
  SELECT doc_id, kind, regexp_split_to_array(text, pattern) AS pieces, regexp_extract_all(text, pattern, 0) AS ms, regexp_extract_all(text, pattern, 2) AS vs FROM d, k WHERE kind = 0
  UNION ALL SELECT doc_id, kind, regexp_split_to_array(text, pattern), regexp_extract_all(text, pattern, 0), regexp_extract_all(text, pattern, 0) FROM d, k WHERE kind > 0
),
g AS (
  SELECT doc_id, kind, unnest(ms) AS m, unnest(vs) AS v, unnest(pieces[1:len(ms)]) AS piece, generate_subscripts(ms, 1) AS nth FROM f WHERE len(ms) > 0
), p AS (
  SELECT *, CAST(sum(length(piece) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY nth) - length(m) AS BIGINT) AS s FROM g
), q AS (SELECT p.*, k.name, k.wide, k.bits FROM p JOIN k USING (kind) WHERE length(v) >= own),
c AS (
  SELECT * FROM q WHERE wide > 0 AND regexp_matches(m, '[0-9+=]|[A-Za-z][A-Z]') AND NOT regexp_matches(m, '(?i)example|sample|placeholder|changeme|dummy|redacted|xxxx|abcdefgh|01234567|98765432|qwertyui')
    AND NOT regexp_matches(m, '^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$')
), w AS (SELECT *, unnest(range(0, length(m) - wide + 1)) AS i FROM c),
h AS (SELECT doc_id, kind, name, s + i AS a, s + i + wide AS b FROM w WHERE list_entropy(string_split(substr(m, i + 1, wide), '')) >= bits),
n AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY doc_id, kind ORDER BY a) THEN 0 ELSE 1 END AS fresh FROM h),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kind ORDER BY a) AS part FROM n),
o AS (
  SELECT doc_id, kind, name, s AS a, s + length(m) AS b FROM q WHERE wide = 0
  UNION ALL SELECT doc_id, kind, name, min(a), max(b) FROM r GROUP BY doc_id, kind, name, part
), t AS (SELECT doc_id, kind, a, name || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS shown FROM o)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(shown, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(shown, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id
"""

IMPORTANCE = rf"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)
  )
), d AS (SELECT doc_id, {_FEATURES} AS w FROM documents),
b AS (SELECT {_FEATURES} AS w FROM benchmark),
x AS (SELECT DISTINCT unnest(w) AS w FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
y AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM x),
z AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c // 256, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, tab),
e AS (SELECT doc_id, unnest(w) AS w FROM d),
s AS (SELECT bucket, count(*) AS s FROM e JOIN z USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS w FROM b) JOIN z USING (w) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
g AS (
  SELECT u.bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM range(10000) u(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n
), p AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM e JOIN z USING (w) JOIN g USING (bucket) GROUP BY doc_id),
q AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM d LEFT JOIN p USING (doc_id)
), r AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= fit * 10 // 100 THEN place END AS rank FROM r
"""

ORACLES = {"op3_minhash": MINHASH, "op6_line_dedup": LINES, "op7_chat_format": CHAT, "op8_warc": WARC, "op10_mixing": MIXING, "op11_secrets": SECRETS, "op13_importance": IMPORTANCE}
