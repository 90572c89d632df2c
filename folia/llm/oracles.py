"""SQL equivalents (DuckDB) where plain SQL can say what an operator returns."""

#: Windows of ten words (all words of a shorter item), found by equality of their spelling.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
DECONTAMINATION = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS words
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
doc_windows AS (
  SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS words
  FROM doc_words, (SELECT DISTINCT k FROM item_windows) ks, unnest(range(1, len(w) - k + 2)) AS t(s)),
hits AS (SELECT r, s, k, item_id FROM doc_windows JOIN item_windows USING (k, words)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, s, k FROM hits), unnest(range(s, s + k)) AS t(p) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""


# CRC-32 of a list of bytes, by the table of its polynomial.
_CRC_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i)))"""


def _crc32(codes: str) -> str:
    """Letters beyond ASCII are from the block whose UTF-8 form is 195 and the code less 64."""
    octets = f"flatten(list_transform(string_split({codes}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, levels: int) -> list[str]:
    """Nodes ``{name}0(tree, pos, h, n)`` up to ``{name}{levels}``, and the runs of each level."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h, "
            f"(max(n) + 15) // 16 AS n FROM {name}{k} GROUP BY tree, pos // 16)"
        )
        out.append(f"{name}_runs{k} AS (SELECT tree, pos // 16 AS run, list(h ORDER BY pos) AS hs, max(n) AS n FROM {name}{k} GROUP BY tree, pos // 16)")
    return out


def _walk(name: str, tree: str, levels: int) -> list[str]:
    """``{name}0(r, tree, pos, node, proof)`` up the runs of a tree."""
    return [
        f"{name}{k + 1} AS (SELECT r, {name}{k}.tree, pos // 16 AS pos, "
        f"CASE WHEN n > 1 THEN sha256(array_to_string(list_concat(hs[1:pos % 16], [node], hs[pos % 16 + 2:]), '')) ELSE node END AS node, "
        f"proof || CASE WHEN n > 1 THEN array_to_string(list_concat(hs[1:pos % 16], hs[pos % 16 + 2:]), '') ELSE '' END AS proof "
        f"FROM {name}{k} JOIN {tree}_runs{k} ON {tree}_runs{k}.tree = {name}{k}.tree AND run = pos // 16)"
        for k in range(levels)
    ]


def _leaf(text: str) -> str:
    def field(x: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"

    return f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Trees of up to 16^6 leaves a source and 16^3 sources.
MANIFEST = ",\n".join(
    [
        "WITH" + _CRC_TABLE,
        f"""leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(_lower("text"))} END AS altered
  FROM documents, crc_table)""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves)",
        "a0 AS (SELECT tree, pos, leaf AS h, n FROM placed)",
        *_tree("a", 6),
        "b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n, tree AS name FROM a6)",
        *_tree("b", 3),
        "v0 AS (SELECT r, tree, pos, coalesce(altered, leaf) AS node, '' AS proof FROM placed)",
        *_walk("v", "a", 6),
        "w0 AS (SELECT r, b0.tree, b0.pos, node, proof FROM v6 JOIN b0 ON name = v6.tree)",
        *_walk("w", "b", 3),
    ]
) + """
SELECT doc_id, leaf, a6.h AS subroot, b3.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = b3.h AS verified
FROM placed JOIN w3 USING (r) JOIN a6 ON a6.tree = placed.tree, b3
"""

#: Windows of 13 words found by equality of their spelling.
SUBSTRINGS = """
WITH doc_words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, s, array_to_string(w[s:s + 12], ' ') AS words FROM doc_words, unnest(range(1, len(w) - 11)) AS t(s)),
least AS (SELECT words, min(doc_id) AS first_id FROM windows GROUP BY words),
gone AS (
  SELECT r, list(DISTINCT p) AS places
  FROM (SELECT r, s FROM windows JOIN least USING (words) WHERE first_id < doc_id), unnest(range(s, s + 13)) AS t(p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(places, []), i)), ' ')) AS kept_sha256
FROM doc_words LEFT JOIN gone USING (r)
"""

#: Pairs at one edit by the words without one code point each.
SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_lower("run")} AS run
  FROM documents, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS t(run)),
hashed AS (SELECT run, {_crc32("id || ':' || run")} AS h FROM runs, crc_table),
spelled AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, count(*) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON b.word = a.rest),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, last(root ORDER BY step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""

ORACLES = {
    "op9_decontamination": DECONTAMINATION, "op11_merkle_manifest": MANIFEST, "op12_substring_dedup": SUBSTRINGS,
    "op13_spelling_variants": SPELLING,
}
