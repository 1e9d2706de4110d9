"""The SQL that states what a query returns, for DuckDB over the same tables."""

ORACLES: dict[str, str] = {}

ORACLES["op8_tree_merge_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

# The base32 alphabet maps each five bits of the SHA-1 digest; SQL has no base32, so it is spelled by digits.
ORACLES["op9_splittable_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS kept FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i + 1]) - 1), 4, '0')), '') AS bits
      FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(5), lambda j: CAST(bits[i * 5 + j + 1] AS INT) << (4 - j)))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < kept THEN kept END AS refers_to
FROM b
"""

ORACLES["op10_fm_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM k)),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS win
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, item_id, s, dw.n FROM dw JOIN iw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""

ORACLES["op5_circulant_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(4, len(w)) - 1) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""

# crc32 of a text of ASCII characters: the table of its 256 remainders, then a step for each character.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], list_transform(range(8), lambda z: 0::UBIGINT)),
                lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t"""


def _crc(codes: str) -> str:
    """SQL of the crc32 of a list of byte values, with the table as ``t``."""
    return (f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), "
            "lambda c, b: xor(t[(xor(c, b) & 255::UBIGINT)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT)")


def _merkle_tree(name: str, leaves: str) -> str:
    """CTEs of the nodes ``name`` of trees and their siblings, from leaves (k, idx, n, d)."""
    return f"""
{name}(k, lvl, idx, n, d) AS (
  SELECT k, 0, idx, n, d FROM {leaves}
  UNION ALL SELECT k, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY idx)) FROM {name} WHERE n > 1
  GROUP BY k, lvl, idx // 8, n),
{name}_sib AS (
  SELECT a.k, a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name} b ON a.k = b.k AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL)"""


def _merkle_fold(name: str, tree: str, start: str) -> str:
    """CTEs that fold the rows of ``start`` (id, k, idx, acc, sibs) up to the one node of their tree."""
    return f"""
{name}_steps(id, k, lvl, idx, acc, sibs) AS (
  SELECT id, k, 0, idx, acc, sibs FROM {start}
  UNION ALL SELECT f.id, f.k, f.lvl + 1, f.idx // 8, sha256(s.l || f.acc || s.r), f.sibs || s.l || s.r
  FROM {name}_steps f JOIN {tree}_sib s ON s.k = f.k AND s.lvl = f.lvl AND s.idx = f.idx),
{name} AS (SELECT id, k, max_by(acc, lvl) AS acc, max_by(sibs, lvl) AS sibs FROM {name}_steps GROUP BY id, k)"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_LEAF = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_ID = _crc("list_transform(range(length(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, i + 1, 1))::UBIGINT)")

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
docs AS (SELECT doc_id, coalesce('=' || lang, '') AS k, sha256({_LEAF}) AS d,
                CASE WHEN {_CRC_ID} % 3 = 0 THEN sha256({_LEAF.replace(_field("text"), _field(_LOWER))}) END AS found FROM documents, tab),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, d) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM docs),
{_merkle_tree("nodes", "leaves").strip()},
subs AS (SELECT '' AS k, k AS name, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n, d FROM nodes WHERE n = 1),
{_merkle_tree("tops", "subs").strip()},
low AS (SELECT doc_id AS id, k, idx, coalesce(found, d) AS acc, '' AS sibs FROM leaves),
{_merkle_fold("inner_fold", "nodes", "low").strip()},
high AS (SELECT f.id, '' AS k, s.idx, f.acc, f.sibs FROM inner_fold f JOIN subs s ON s.name = f.k),
{_merkle_fold("outer_fold", "tops", "high").strip()}
SELECT doc_id, leaves.d AS leaf, subs.d AS subroot, root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM leaves JOIN subs ON subs.name = leaves.k JOIN outer_fold f ON f.id = doc_id, (SELECT d AS root FROM tops WHERE n = 1)
"""

_BYTES = """list_transform(range(length(hx) // 2), lambda i: (16 * (strpos('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1)
                + strpos('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1)::UBIGINT)"""

ORACLES["op13_partenum_variants"] = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents),
lowered AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM runs WHERE length(r) >= 6),
tallied AS (SELECT r, hex(encode(doc_id || ':' || r)) AS hx, count(*) AS m FROM lowered GROUP BY ALL),
hashed AS (SELECT r, m, {_crc(_BYTES)}::BIGINT AS h FROM tallied, tab),
typed AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, m FROM hashed),
words AS (SELECT word, sum(m)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cuts AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS x, b.word AS y FROM cuts a JOIN cuts b USING (i, short) WHERE a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.short = b.word),
best AS (SELECT x, count(*) AS n_near, arg_min(row(y, n), row(-n, y)) AS b FROM pairs JOIN words ON word = y GROUP BY x),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b[2] >= 5 * n THEN b[1] END AS form, CASE WHEN b[2] >= 5 * n THEN b[2] END AS form_n
         FROM words LEFT JOIN best ON x = word),
ends(word, last, step) AS (
  SELECT word, word, 0 FROM told
  UNION ALL SELECT e.word, t.form, step + 1 FROM ends e JOIN told t ON t.word = e.last WHERE t.form IS NOT NULL)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, max_by(last, step) AS root FROM ends GROUP BY word) USING (word)
"""
