"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: A-Z lowered only, as the contracts ask.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
spot AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(p)),
hits AS (SELECT spot.doc_id, spot.p, spot.k, win.item_id FROM spot JOIN win ON spot.k = win.k AND spot.s = win.s),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM hits, unnest(range(p, p + k)) AS t(q) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(names.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spot AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(p)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM spot) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, q FROM late, unnest(range(p, p + 20)) AS t(q)),
kept AS (SELECT d.doc_id, string_agg(d.w[q], ' ' ORDER BY q) AS s, count(*) AS n
  FROM d, unnest(range(1, len(d.w) + 1)) AS t(q) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = d.doc_id AND gone.q = t.q) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
part AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, part.component_id, e.vec_id = part.component_id AS kept
FROM embeddings e JOIN part USING (vec_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
spot AS (SELECT doc_id, p, hash(b[p:p + 399]) AS h FROM d, unnest(range(1, n - 398)) AS t(p)),
again AS (SELECT h FROM spot GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 400 THEN 0 ELSE 1 END AS fresh FROM spot JOIN again USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
run AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit),
span AS (SELECT doc_id, r, min(p) AS lo, max(p) + 399 AS hi FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, count(*) AS k, sum(hi - lo + 1) AS gone FROM span GROUP BY doc_id),
part AS (SELECT doc_id, r, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY r), 0) + 1 AS a, lo - 1 AS z FROM span
  UNION ALL SELECT doc_id, 1000000000, max(hi) + 1, 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT part.doc_id, string_agg(hex(d.b[a:least(z, d.n)]), '' ORDER BY r) AS x FROM part JOIN d ON d.doc_id = part.doc_id GROUP BY part.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(cut.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(cut.k, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN cut.k IS NULL THEN d.b ELSE unhex(kept.x) END) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + least(len(w), 5) - 1], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
part AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, part.component_id, d.doc_id = part.component_id AS kept
FROM d JOIN part USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP8 = r"""
WITH l AS (SELECT doc_id, p, string_split(text, chr(10))[p] AS s FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(p)),
f AS (SELECT s, length(s) AS n, min(doc_id * 1000000000 + p) AS first FROM l WHERE length(s) >= 20 GROUP BY s),
late AS (SELECT DISTINCT b.s FROM f a JOIN f b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.first < b.first AND levenshtein(a.s, b.s) <= 2),
kept AS (SELECT l.doc_id, l.p, l.s FROM l LEFT JOIN f ON l.s = f.s LEFT JOIN late ON l.s = late.s
  WHERE f.s IS NULL OR (late.s IS NULL AND l.doc_id * 1000000000 + l.p = f.first)),
k AS (SELECT doc_id, count(*) AS n, string_agg(s, chr(10) ORDER BY p) AS s FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


def _crc32_step() -> str:
    """One byte of CRC-32 over ``c`` (remainder so far) and ``b``, four bits at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    nibble = lambda c: f"xor([{', '.join(map(str, table))}][1 + (({c}) & 15)], ({c}) >> 4)"
    return nibble(nibble("xor(c, b)"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

OP12 = f"""
WITH RECURSIVE sums AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {_crc32_step()}), 4294967295) AS crc FROM documents),
d AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
  CASE WHEN crc % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS shown FROM sums),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
tree AS (SELECT 0 AS k, source, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT k + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY k, source, pos // 3, (n + 2) // 3),
subroots AS MATERIALIZED (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS k, pos, n, subroot AS h FROM subroots
  UNION ALL SELECT k + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY k, pos // 3, (n + 2) // 3),
fold AS (SELECT 0 AS part, 0 AS k, doc_id, source, leaf, pos, n, shown AS h, '' AS proof FROM leaves
  UNION ALL SELECT * FROM (
    SELECT f.part, f.k + 1, f.doc_id, f.source, f.leaf, f.pos // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.h END, '' ORDER BY t.pos)),
      f.proof || string_agg(CASE WHEN t.pos = f.pos THEN '' ELSE t.h END, '' ORDER BY t.pos)
    FROM fold f JOIN tree t ON f.part = 0 AND f.n > 1 AND t.k = f.k AND t.source IS NOT DISTINCT FROM f.source AND t.pos // 3 = f.pos // 3
    GROUP BY f.part, f.k, f.doc_id, f.source, f.leaf, f.pos, f.n, f.h, f.proof
    UNION ALL SELECT 1, 0, f.doc_id, f.source, f.leaf, s.pos, s.n, f.h, f.proof FROM fold f JOIN subroots s ON f.part = 0 AND f.n = 1 AND s.source IS NOT DISTINCT FROM f.source
    UNION ALL SELECT f.part, f.k + 1, f.doc_id, f.source, f.leaf, f.pos // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.h END, '' ORDER BY t.pos)),
      f.proof || string_agg(CASE WHEN t.pos = f.pos THEN '' ELSE t.h END, '' ORDER BY t.pos)
    FROM fold f JOIN top t ON f.part = 1 AND f.n > 1 AND t.k = f.k AND t.pos // 3 = f.pos // 3
    GROUP BY f.part, f.k, f.doc_id, f.source, f.leaf, f.pos, f.n, f.h, f.proof))
SELECT f.doc_id, f.leaf, s.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM fold f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source WHERE f.part = 1 AND f.n = 1
"""


def _op13(rounds: int = 6) -> str:
    """Rounds of assigning and averaging, one after the other."""
    near = "{0} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(e, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * 16 + e) AS e, min(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS gap FROM parts JOIN {1} USING (p) GROUP BY vec_id, label, p, x)"
    mean = """{0} AS MATERIALIZED (SELECT {1}.p, {1}.e, coalesce(m.c, {1}.c) AS c FROM {1} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c
  FROM (SELECT p, e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM {2}, unnest(range(1, len(x) + 1)) AS t(j) GROUP BY p, e, j) GROUP BY p, e) m USING (p, e))"""
    steps = []
    for k in range(rounds):
        steps += [near.format(f"near{k}", f"book{k}"), mean.format(f"book{k + 1}", f"book{k}", f"near{k}")]
    steps.append(near.format("last", f"book{rounds}"))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1:p * w + w] AS x FROM kept, unnest(range(8)) AS t(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
{", ".join(steps)},
coded AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(gap) AS BIGINT) AS error FROM last GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


OP13 = _op13()

ORACLES: dict[str, str] = {"op1_embeddings": OP1, "op6_suffixes": OP6, "op7_minhash": OP7, "op8_lines": OP8, "op4_decontaminate": OP4, "op10_windows": OP10, "op12_merkle": OP12, "op13_codes": OP13}
