"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest([array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS g FROM iw),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS g FROM dw),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM s JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

OP5 = """
WITH v AS (
  SELECT vec_id, [cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), q AS (SELECT vec_id AS query_id, c AS qc FROM v WHERE vec_id % 50 = 0),
parts AS (SELECT query_id, unnest(qc) AS a, unnest(range(len(qc))) AS i FROM q),
cand AS (SELECT vec_id, unnest(c) AS b, unnest(range(len(c))) AS i FROM v),
s AS (SELECT query_id, vec_id, sum(a * b) AS score FROM parts JOIN cand USING (i) WHERE query_id <> vec_id GROUP BY ALL),
r AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id,
      cast(score AS BIGINT) AS score FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_PATTERNS = {"assign": (_ASSIGN, 2), "access": ("AKIA[A-Z0-9]{14,}", 0), "hex": ("[0-9a-f]{16,}", 0), "key": ("[A-Za-z0-9/+]{40,}", 0), "endpoint": ("https?://[A-Za-z0-9.-]+", 0)}


def _matches(kind: str, k: int) -> str:
    rx, group = _PATTERNS[kind]
    return f"""
m_{kind} AS (
  SELECT r, i, {k} AS k, m, g, p FROM (
    SELECT r, unnest(regexp_extract_all(text, '{rx}')) AS m, unnest(regexp_extract_all(text, '{rx}', {group})) AS g,
           unnest(string_split_regex(text, '{rx}')[:-2]) AS p, unnest(range(len(regexp_extract_all(text, '{rx}')))) AS i
    FROM d WHERE regexp_matches(text, '{rx}'))
), s_{kind} AS (
  SELECT r, k, m, g, sum(length(p)) OVER w + sum(length(m)) OVER w - length(m) AS s, sum(length(p)) OVER w + sum(length(m)) OVER w AS e
  FROM m_{kind} WINDOW w AS (PARTITION BY r ORDER BY i)
)"""


OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{','.join(_matches(kind, k) for kind, k in (("assign", 0), ("access", 1), ("hex", 2), ("key", 4), ("endpoint", 5)))},
strong AS (
  SELECT r, k, s, e FROM s_assign WHERE length(g) >= 12 UNION ALL SELECT r, k, s, e FROM s_access UNION ALL SELECT r, k, s, e FROM s_hex
), weak AS (
  SELECT r, 3 AS k, s, e FROM s_assign WHERE length(g) BETWEEN 8 AND 11
  UNION ALL SELECT r, k, s, e FROM s_key WHERE length(m) = 40 AND NOT regexp_matches(m, '^[0-9a-f]+$')
  UNION ALL SELECT r, k, s, e FROM s_endpoint
), parts AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
linked AS (
  SELECT w.r, w.k, w.s, w.e,
    bool_or(p.k = 1) AS i, bool_or(p.k NOT IN (1, 5)) AS t, bool_or(p.k = 5) AS u
  FROM weak w JOIN parts p ON p.r = w.r AND abs(p.s - w.s) <= 256 GROUP BY ALL
), spans AS (
  SELECT * FROM strong UNION ALL
  SELECT r, k, s, e FROM linked WHERE CASE WHEN k = 5 THEN i AND t ELSE i OR u END
), named AS (
  SELECT r, k, s, e, ['assign', 'access', 'hex', 'weak', 'key', 'endpoint'][k + 1] || ':' || cast(s AS BIGINT) || ':' || cast(e AS BIGINT) AS x FROM spans
), listed AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    count(*) FILTER (k > 2) AS n_weak,
    coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k <= 2), '') AS base, string_agg(x, ',' ORDER BY s, k) AS spans
  FROM named GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(n_weak, 0) AS n_weak, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)
"""

OP7 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    (cast(cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id AS VARCHAR), '')), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight,
       source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (
  SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s1
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, place) FROM s2 WHERE level <= ratio) * weight), cap) AS target FROM s2
), t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
cn AS (SELECT d.source, size, count(*) AS n, any_value(target - whole * source_size) AS rest FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source WHERE size > 0 GROUP BY d.source, size),
lv AS (
  SELECT source, size, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(n * size * sqrt(size::DOUBLE)) OVER (PARTITION BY source ORDER BY size) AS level FROM cn
), l2 AS (SELECT source, arg_max(level, size) AS level FROM lv WHERE level * sqrt(size::DOUBLE) < 1 GROUP BY source),
o0 AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
    CASE WHEN size > 0 AND target - whole * source_size > 0 THEN least(1.0::DOUBLE, level * sqrt(size::DOUBLE)) END AS chance
  FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source LEFT JOIN l2 ON d.source IS NOT DISTINCT FROM l2.source
), o AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) * (1 - chance) / chance END AS q FROM o0), f AS (
  SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size, rid) <= rest AS fits FROM o
), g AS (SELECT *, rest - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM f),
h AS (
  SELECT *, CASE WHEN NOT fits AND q IS NOT NULL AND abs(size - gap) < gap
    THEN row_number() OVER (PARTITION BY source, (NOT fits AND q IS NOT NULL AND abs(size - gap) < gap) ORDER BY abs(size - gap), q, doc_id, size, rid) END AS nth FROM g
)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN size > 0 THEN whole + fits::INT + coalesce((nth = 1)::INT, 0) ELSE whole END::INTEGER AS copies,
  (CASE WHEN size > 0 THEN whole + fits::INT + coalesce((nth = 1)::INT, 0) ELSE 0 END * size)::BIGINT AS taken
FROM h
"""

OP8 = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS x FROM p),
d AS (
  SELECT page_id, r, payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(x, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)
      FOR i IN range(32)], '') AS payload_digest FROM h
), f AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, r) AS nth,
    first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, r) AS last_id FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN last_id END AS refers_to FROM f
"""

OP10 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[k : k + 3], ' ') FOR k IN range(1, len(w) - 2)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.doc_id WHERE r.root < e.b
), c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: CRC-32 of a list of bytes; the table comes from the polynomial.
_CRC_TABLE = "SELECT [list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS tab"


def _bytes(text: str) -> str:
    """UTF-8 bytes of a text of code points below U+0800."""
    return f"flatten([CASE WHEN unicode(x) < 128 THEN [cast(unicode(x) AS BIGINT)] ELSE [cast(192 + (unicode(x) >> 6) AS BIGINT), cast(128 + (unicode(x) & 63) AS BIGINT)] END FOR x IN string_split({text}, '')])"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {_bytes(text)}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEVER = "n1 = 0 OR n2 = 0 OR n3 = 0 OR n4 = 0 OR 1 - 2 * n1 / (n1 + 2 * n2) * n2 / n1 <= 0 OR 2 - 3 * n1 / (n1 + 2 * n2) * n3 / n2 <= 0 OR 3 - 4 * n1 / (n1 + 2 * n2) * n4 / n3 <= 0"
_DISCOUNTS = f"""CASE WHEN {_NEVER} THEN [0.0, 0.5, 1.0, 1.5]::DOUBLE[]
  ELSE [0.0, 1 - 2 * n1 / (n1 + 2 * n2) * n2 / n1, 2 - 3 * n1 / (n1 + 2 * n2) * n3 / n2, 3 - 4 * n1 / (n1 + 2 * n2) * n4 / n3]::DOUBLE[] END"""

OP11 = rf"""
WITH tab AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_crc("coalesce(cast(doc_id AS VARCHAR), '')")} % 5 = 1 AS held_out,
  list_append(regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+'), ' e') AS w FROM documents, tab),
t AS (SELECT r, held_out, unnest(list_prepend(' b', w)[:-2]) AS c, unnest(w) AS w FROM d),
big AS (SELECT c, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY ALL),
ctx AS (SELECT c, sum(n) AS total, count(*) FILTER (n = 1) AS o, count(*) FILTER (n = 2) AS tw, count(*) FILTER (n > 2) AS mo FROM big GROUP BY c),
uni AS (SELECT w, count(*) AS lefts, sum(n) AS said FROM big GROUP BY w),
d2 AS (SELECT {_DISCOUNTS} AS db FROM (SELECT count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n = 3) AS n3, count(*) FILTER (n = 4) AS n4 FROM big)),
d1 AS (SELECT {_DISCOUNTS} AS du, ones, twos, more, tot, nv, ntok FROM (SELECT count(*) FILTER (lefts = 1) AS n1, count(*) FILTER (lefts = 2) AS n2,
  count(*) FILTER (lefts = 3) AS n3, count(*) FILTER (lefts = 4) AS n4, count(*) FILTER (lefts = 1) AS ones, count(*) FILTER (lefts = 2) AS twos, count(*) FILTER (lefts > 2) AS more,
  coalesce(sum(lefts), 0) AS tot, count(*) AS nv, coalesce(sum(said), 0) AS ntok FROM uni)),
p1 AS (SELECT r, coalesce(u.said, 0) AS said, coalesce(b.n, 0) AS n, x.total, x.o, x.tw, x.mo, db, nv, ntok,
  greatest(coalesce(lefts, 0) - du[least(coalesce(lefts, 0), 3) + 1], 0) / greatest(tot, 1)
  + CASE WHEN tot > 0 THEN (du[2] * ones + du[3] * twos + du[4] * more) / tot ELSE 1 END / (nv + 1) AS p
  FROM t LEFT JOIN uni u USING (w) LEFT JOIN big b USING (c, w) LEFT JOIN ctx x USING (c), d1, d2),
p2 AS (SELECT r, said, log10((said + 0.5::DOUBLE) / (ntok + 0.5::DOUBLE * (nv + 1))) AS base, log10(CASE WHEN total > 0
  THEN greatest(n - db[least(n, 3) + 1], 0) / total + (db[2] * o + db[3] * tw + db[4] * mo) / total * p ELSE p END) AS lp FROM p1),
s AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (said > 0) AS n_known, sum(base) AS base_score, sum(lp) AS score FROM p2 GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, cast((SELECT ntok FROM d1) AS BIGINT) AS train_tokens, base_score, score, 10 ** (-score / n_tokens) AS perplexity FROM d JOIN s USING (r)
"""

OP12 = rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
r AS (SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, count(*) AS k
  FROM (SELECT coalesce(cast(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS x FROM documents) WHERE length(x) >= 7 GROUP BY ALL),
h AS (SELECT low, k, {_crc("concat(doc_id, ':', low)")} AS h FROM r, tab),
o AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(low, 1, h % length(low)), substr(low, h % length(low) + 2)) ELSE low END AS word, k FROM h),
v AS (SELECT word, cast(sum(k) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut_ AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
del AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS part FROM cut_),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM del a JOIN del b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM del a JOIN v b ON a.part = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM del a JOIN v b ON a.part = b.word),
best AS (SELECT word, n, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word AND k = 1),
way(word, at_, more) AS (SELECT word, coalesce(form, word), form IS NOT NULL FROM f UNION ALL SELECT way.word, f.form, true FROM way JOIN f ON way.at_ = f.word WHERE more AND f.form IS NOT NULL),
root AS (SELECT way.word, at_ AS root FROM way JOIN f ON f.word = at_ WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": OP1, "op5_topk": OP5, "op6_secret_scan": OP6, "op7_source_mix": OP7, "op8_warc": OP8, "op10_near_dedup": OP10,
    "op11_ngrams": OP11, "op12_spelling": OP12,
}
