"""The queries of this folder as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP7 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS pos
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM sources
), sums AS (
  SELECT *, sum(source_size) OVER ()
         - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM ordered
), level AS (
  SELECT left_over::DOUBLE / weights::DOUBLE AS l FROM sums
  WHERE 3.0 * source_size >= left_over::DOUBLE / weights::DOUBLE * weight ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, least(3.0 * source_size::DOUBLE, l * weight::DOUBLE) AS target FROM sources, level
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), placed AS (
  SELECT doc_id, size, source_size, target, whole, pos, target - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY pos, doc_id
                                  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before,
         sum(size) OVER (PARTITION BY s.source, pos, doc_id) AS alike
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       (size * (whole + CASE WHEN 2 * before + alike <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

OP9 = f"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), {WHITE}, '') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
"""

OP10 = f"""
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), judged AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))} || {_field(text)})"


def _levels(name: str, count: int) -> str:
    """Levels above the table ``name_0 (tree, place, n, h)``, and for each level what stands beside a node in its run."""
    ctes = []
    run = "OVER (PARTITION BY tree, place // 8 ORDER BY place ROWS BETWEEN"
    for k in range(count):
        ctes.append(f"""{name}_side_{k} AS (
  SELECT tree, place, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{k}
), {name}_{k + 1} AS (
  SELECT tree, place // 8 AS place, any_value((n + 7) // 8) AS n,
         CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE any_value(h) END AS h
  FROM {name}_{k} GROUP BY tree, place // 8
)""")
    return ",\n".join(ctes)


def _folds(source: str, name: str, tree: str, place: str, count: int) -> str:
    """``source`` with its proof and fold carried up the levels of ``name``; ``source_0`` is there, ``source_<count>`` the result."""
    return ",\n".join(f"""{source}_{k + 1} AS (
  SELECT f.* REPLACE (f.proof || s.l || s.r AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || f.fold || s.r) ELSE f.fold END AS fold)
  FROM {source}_{k} f JOIN {name}_side_{k} s ON s.tree = {tree} AND s.place = {place} // {8**k}
)""" for k in range(count))


#: Levels of the SQL form: up to 8^7 rows a group and 8^3 groups.
LOWER, UPPER = 7, 3
HALF = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"

OP11 = f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS x, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, {HALF}, k + 1 FROM bits WHERE k < 8
), crc_table AS (
  SELECT i, x FROM bits WHERE k = 8
), crcs AS (
  SELECT DISTINCT doc_id AS crc_id, doc_id::VARCHAR AS s, 4294967295::BIGINT AS crc, 1 AS k FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT crc_id, s, xor(crc // 256, x), k + 1 FROM crcs JOIN crc_table ON i = xor(crc % 256, ascii(substr(s, k, 1))::BIGINT) WHERE k <= length(s)
), tampered AS (
  SELECT crc_id FROM crcs WHERE k = length(s) + 1 AND xor(crc, 4294967295) % 3 = 0
), hashed AS (
  SELECT doc_id, lang, crc_id IS NOT NULL AS touched, {_leaf("text")} AS leaf,
         {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered
  FROM documents LEFT JOIN tampered ON crc_id = doc_id
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), low_0 AS (
  SELECT tree, place, n, leaf AS h FROM placed
), {_levels("low", LOWER)}, top_0 AS (
  SELECT -1 AS tree, tree AS place, count(*) OVER () AS n, h FROM low_{LOWER}
), {_levels("top", UPPER)}, below_0 AS (
  SELECT *, '' AS proof, CASE WHEN touched THEN lowered ELSE leaf END AS fold FROM placed
), {_folds("below", "low", "f.tree", "f.place", LOWER)}, above_0 AS (
  SELECT * FROM below_{LOWER}
), {_folds("above", "top", "-1", "f.tree", UPPER)}
SELECT doc_id, leaf, low_{LOWER}.h AS subroot, top_{UPPER}.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
       fold = top_{UPPER}.h AS verified
FROM above_{UPPER} f JOIN low_{LOWER} ON low_{LOWER}.tree = f.tree CROSS JOIN top_{UPPER}
"""

ORACLES: dict[str, str] = {
    "op7_source_mixing": OP7,
    "op9_exact_dedup": OP9,
    "op10_line_dedup": OP10,
    "op11_merkle_manifest": OP11,
}
