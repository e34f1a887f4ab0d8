"""Reference SQL (DuckDB) of the text queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def _words(text: str, pattern: str = _WORD) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


def _window(n: int | str) -> str:
    """The ``n`` words from ``i`` on, joined by a space."""
    return f"array_to_string(l[i:i + {n} - 1], ' ')"


SQL = {
    "op5_superkmers": f"""
WITH docs AS (SELECT doc_id, {_words('text')} AS l FROM documents),
words AS (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM docs),
windows AS (SELECT doc_id, i, md5({_window(50)}) AS h FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 48, 1))) AS i FROM docs)),
later AS (SELECT doc_id, i AS p, 1 AS hit FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE least < doc_id),
marked AS (SELECT doc_id, p, w, coalesce(max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM words LEFT JOIN later USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) FILTER (gone = 1) AS n, string_agg(w, ' ' ORDER BY p) FILTER (gone = 0) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)""",
    "op6_decontaminate": f"""
WITH docs AS (SELECT doc_id, {_words(_lower('text'), _ITEM_WORD)} AS l FROM documents),
items AS (SELECT item_id, {_words(_lower('text'), _ITEM_WORD)} AS l FROM benchmark),
sized AS (SELECT item_id, l, least(len(l), 10) AS n FROM items WHERE len(l) > 0),
grams AS (SELECT DISTINCT item_id, n, {_window('n')} AS g FROM (SELECT *, unnest(range(1, len(l) - n + 2)) AS i FROM sized)),
windows AS (SELECT doc_id, n, i, {_window('n')} AS g FROM (
  SELECT doc_id, l, n, unnest(range(1, greatest(len(l) - n + 2, 1))) AS i FROM docs, (SELECT DISTINCT n FROM grams))),
hits AS (SELECT doc_id, n, i, item_id FROM windows JOIN grams USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_warc": """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
firsts AS (SELECT *, sha1(body) AS s, min(page_id) OVER (PARTITION BY body) AS least FROM payloads)
SELECT page_id, strlen(body) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(s, j // 4 * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM firsts""",
    "url_rules": """
WITH parts AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', ['host', 'path']) AS r FROM pages),
addresses AS (SELECT page_id, """
    + _lower("r.host")
    + """ AS host, r.path AS path FROM parts),
rules(site, start, rule) AS (VALUES ('org', '/', 'org/'), ('example.org', '/es/', 'example.org/es/'), ('example.org', '/en/1', 'example.org/en/1'),
  ('com', '/fr/', 'com/fr/'), ('com', '/de/', 'com/de/')),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM addresses JOIN rules
  ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rule_verdict
FROM addresses LEFT JOIN fits USING (page_id)""",
    "op9_quality": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {_words('text')} AS l FROM documents),
words AS (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM docs),
totals AS (SELECT doc_id, CAST(sum(length(w)) AS BIGINT) AS chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}')),
again AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '{_SPACE}', '', 'g'))) AS chars FROM lines WHERE k > 1 GROUP BY doc_id),
grams AS (SELECT doc_id, n, i, {_window('n')} AS g FROM (
  SELECT doc_id, l, n, unnest(range(1, greatest(len(l) - n + 2, 1))) AS i FROM docs, (VALUES (3), (5), (7), (10)) sizes(n))),
twice AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS k FROM grams) WHERE k > 1),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM twice),
shares AS (SELECT doc_id, count(*) FILTER (n = 3) AS words3, sum(length(w)) FILTER (n = 5) AS chars5,
  sum(length(w)) FILTER (n = 7) AS chars7, sum(length(w)) FILTER (n = 10) AS chars10 FROM inside JOIN words USING (doc_id, p) GROUP BY doc_id),
measures AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(t.chars, 0) AS word_chars,
  length(regexp_replace(docs.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(a.n, 0) AS n_dup_lines, coalesce(words3, 0) AS n_repeat_words,
  coalesce(a.chars, 0) AS line_chars, coalesce(chars5, 0) AS c5, coalesce(chars7, 0) AS c7, coalesce(chars10, 0) AS c10
  FROM docs LEFT JOIN totals t USING (doc_id) LEFT JOIN again a USING (doc_id) LEFT JOIN shares USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(word_chars, 1)::DOUBLE AS total FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR line_chars / total > 0.3::DOUBLE OR c5 / total > 0.3::DOUBLE OR c7 / total > 0.25::DOUBLE
    OR c10 / total > 0.2::DOUBLE) AS kept
FROM judged""",
    "op12_setsketch": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words(_lower('text'))} AS l FROM documents),
shingles AS (SELECT DISTINCT doc_id, {_window(5)} AS s FROM (
  SELECT doc_id, l, unnest(range(1, CASE WHEN len(l) = 0 THEN 1 ELSE greatest(len(l) - 3, 2) END)) AS i FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached(doc_id, component) AS (SELECT doc_id, doc_id FROM docs
  UNION SELECT b, component FROM reached JOIN edges ON a = reached.doc_id AND b > component),
least AS (SELECT doc_id, min(component) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
}


def _piece(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join([*map(_piece, ('doc_id', 'source', 'lang', 'n_chars')), _piece(text)])})"


def _tree(name: str, leaves: str) -> str:
    """Nodes of the trees of runs of eight over ``leaves`` (grp, idx, h, size), and what stands beside each node."""
    return f"""
{name}(grp, lvl, idx, h, size) AS (SELECT grp, 0, idx, h, size FROM {leaves}
  UNION ALL SELECT grp, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (size + 7) // 8 FROM {name} WHERE size > 1
  GROUP BY grp, lvl, idx // 8, size),
{name}_beside AS (SELECT grp, lvl, idx,
  coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
  coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM {name} WHERE size > 1 WINDOW run AS (PARTITION BY grp, lvl, idx // 8 ORDER BY idx))"""


def _climb(name: str, tree: str, start: str) -> str:
    """From ``start`` (id, grp, idx, f, proof) up a tree: the digest folded with its siblings, and the siblings passed."""
    return f"""
{name}(id, grp, lvl, idx, f, proof) AS (SELECT id, grp, 0, idx, f, proof FROM {start}
  UNION ALL SELECT id, c.grp, c.lvl + 1, c.idx // 8, sha256(lefts || f || rights), proof || lefts || rights
  FROM {name} c JOIN {tree}_beside b ON b.grp = c.grp AND b.lvl = c.lvl AND b.idx = c.idx),
{name}_end AS (SELECT id, grp, arg_max(f, lvl) AS f, arg_max(proof, lvl) AS proof FROM {name} GROUP BY id, grp)"""


SQL["op13_merkle"] = f"""
WITH RECURSIVE remainders AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
checked AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc FROM documents, remainders),
entries AS (SELECT doc_id, coalesce('+' || lang, '') AS grp, {_leaf('text')} AS h,
  CASE WHEN crc % 3 = 0 THEN {_leaf(_lower('text'))} END AS tampered FROM checked),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS size FROM entries),
{_tree('low', 'leaves')},
subroots AS (SELECT grp AS lang, h, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS size FROM low WHERE size = 1),
{_tree('high', 'subroots')},
start AS (SELECT doc_id AS id, grp, idx, coalesce(tampered, h) AS f, '' AS proof FROM leaves),
{_climb('climbed', 'low', 'start')},
halfway AS (SELECT id, s.grp, s.idx, f, proof FROM climbed_end e JOIN subroots s ON s.lang = e.grp),
{_climb('topped', 'high', 'halfway')}
SELECT doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.f AS folded_root, e.f = r.h AS verified
FROM leaves l JOIN subroots s ON s.lang = l.grp JOIN topped_end e ON e.id = l.doc_id, (SELECT h FROM high WHERE size = 1) r"""
