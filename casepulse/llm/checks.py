"""SQL for the operators that SQL can express, in other words than the operators'."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_CHECKS: dict[str, str] = {}

_CHECKS["op9_exact_dedup"] = rf"""
WITH plain AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS body
  FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM plain WINDOW same AS (PARTITION BY body)
"""


#: Chunks as windows over numbered lines, numbered occurrences instead of group minima.
_CHECKS["op1_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM split
), worded AS (
  SELECT doc_id, i, ('0x' || substr(md5(l), 1, 12))::BIGINT AS h FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), chunks AS (
  SELECT doc_id, i, CASE WHEN (31 * h + lead(h) OVER doc) % 3 = 0 THEN coalesce(lead(i, 2) OVER doc, lead(i) OVER doc)
                         ELSE lead(i) OVER doc END AS till
  FROM worded WINDOW doc AS (PARTITION BY doc_id ORDER BY i)
), told AS (
  SELECT doc_id, i, till, row_number() OVER (PARTITION BY array_to_string(ls[i + 1:till + 1], chr(10)) ORDER BY doc_id, i) > 1 AS later
  FROM chunks JOIN split USING (doc_id) WHERE till IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, till + 1)) AS i FROM told WHERE later
), rest AS (
  SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
         coalesce(string_agg(l, chr(10) ORDER BY lines.i) FILTER (gone.i IS NULL), '') AS body
  FROM lines LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(body) AS n_left, sha256(body) AS left_sha256 FROM rest
"""

_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "list_bool_and(list_transform(string_split(m, '.'), lambda x: try_cast(x AS HUGEINT) <= 255))",
    ),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", """length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(
        range(1, length(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN digits[-k]::INT
        WHEN digits[-k]::INT > 4 THEN 2 * digits[-k]::INT - 9 ELSE 2 * digits[-k]::INT END)) % 10 = 0"""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15"),
}


def _found(rank: int, kind: str, pattern: str, valid: str) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, "at", "at" + length(m) AS till FROM (
        SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM (
            SELECT doc_id, ms[k] AS m,
                list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS "at"
            FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
                SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs
                FROM documents WHERE text IS NOT NULL)))) WHERE {valid}"""


#: The base kinds; the test tables hold no account numbers or social security numbers.
_CHECKS["op5_pii"] = f"""
WITH found AS ({" UNION ALL ".join(_found(n, k, *v) for n, (k, v) in enumerate(_KINDS.items()))}),
joined AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)},
         string_agg(kind || ':' || "at"::BIGINT || ':' || till::BIGINT, ',' ORDER BY rank, "at") AS spans
  FROM found GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _KINDS)},
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined USING (doc_id)
"""


def _crc32(value: str) -> str:
    """The unsigned CRC-32 of a number's decimal text, bit by bit."""
    digits = f"list_transform(range(1, length({value}::VARCHAR) + 1), lambda k: ascii(substr({value}::VARCHAR, k, 1))::BIGINT)"
    byte = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, b: {byte}), 4294967295)"


def _leaf(text: str) -> str:
    parts = (f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


_UP = """SELECT tree, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16
  FROM {0} WHERE n > 1 GROUP BY tree, level, pos // 16, n"""
_SIDES = """SELECT *, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {0} WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, pos // 16 ORDER BY pos)"""
_FOLD = """SELECT id, tree, level + 1, pos // 16, sha256(before || d || after), sides || before || after
  FROM {0} JOIN {1} USING (tree, level, pos)"""

#: Levels as steps of recursive queries: up both kinds of trees, then from each leaf through its siblings.
_CHECKS["op11_merkle_manifest"] = f"""
WITH RECURSIVE named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, {_leaf("text")} AS h,
         {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered FROM documents
), up AS (
  SELECT tree, 0 AS level, pos, h, n FROM named UNION ALL {_UP.format("up")}
), subroots AS (SELECT tree, h FROM up WHERE n = 1
), top AS (
  SELECT 0 AS tree, 0 AS level, tree AS pos, h, (SELECT count(*) FROM subroots) AS n FROM subroots UNION ALL {_UP.format("top")}
), sides AS ({_SIDES.format("up")}), top_sides AS ({_SIDES.format("top")}),
inner_fold AS (
  SELECT id, tree, 0 AS level, pos, CASE WHEN {_crc32("doc_id")} % 5 = 0 THEN lowered ELSE h END AS d, '' AS sides FROM named
  UNION ALL {_FOLD.format("inner_fold", "sides")}
), outer_fold AS (
  SELECT id, 0 AS tree, 0 AS level, tree AS pos, d, sides FROM (SELECT *, max(level) OVER (PARTITION BY id) AS most FROM inner_fold) WHERE level = most
  UNION ALL {_FOLD.format("outer_fold", "top_sides")}
), folded AS (SELECT * FROM (SELECT *, max(level) OVER (PARTITION BY id) AS most FROM outer_fold) WHERE level = most)
SELECT doc_id, named.h AS leaf, subroots.h AS subroot, top.h AS root, sha256(sides) AS proof_sha256, d AS folded_root, d = top.h AS verified
FROM named JOIN subroots ON subroots.tree = named.tree JOIN folded ON folded.id = named.id JOIN top ON top.n = 1
"""

_CHECKS["op12_top_k"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER best AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""

#: Nodes as lists of turns; totals by joining every node with all of its beginnings.
_CHECKS["op13_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS own,
         {_crc32("conv_id")} % 9 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), made AS (
  SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS s
  FROM turns a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 5
), steps AS (
  SELECT conv_id, d, s[1:d] AS k, d = len(s) AS last FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM made)
), nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce((count(*) - 1) * octet_length(encode(k[d].t)), 0) AS gain,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM steps GROUP BY k, d
), kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT b.k[1:b.up] AS k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum(gain) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM nodes) b LEFT JOIN kids ON kids.k = b.k GROUP BY ALL
)
SELECT nodes.conv_id, nodes.d AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN below ON below.k = nodes.k LEFT JOIN kids ON kids.k = nodes.k
LEFT JOIN nodes parent ON parent.k = nodes.k[1:nodes.d - 1] AND nodes.d > 0
"""


def oracle_sql() -> dict[str, str]:
    return dict(_CHECKS)
