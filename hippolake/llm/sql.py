"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import re

URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM cut
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.rverdict,
         row_number() OVER (PARTITION BY p.host, p.path, p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), keyed AS (
  SELECT *, md5(concat_ws('|', '7', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), coalesce(digest, ''))) AS order_key FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM keyed GROUP BY source
), weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources
), lined AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, i) AS k FROM weighed
), summed AS (
  SELECT *, sum(n) OVER () AS total, sum(w) OVER () AS wtotal,
         coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM lined
), capped AS (
  SELECT *, w * (total - cap_before) > 3 * n * (wtotal - w_before) AS is_full FROM summed
), rest_of AS (
  SELECT coalesce(sum(3 * n) FILTER (is_full), 0) AS cap_full, sum(w) FILTER (NOT is_full) AS w_open FROM capped
), goals AS (
  SELECT source, n, CASE WHEN is_full OR n = 0 THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * (total - cap_full) AS DOUBLE) / CAST(w_open AS DOUBLE) END AS target
  FROM capped, rest_of
), plans AS (
  SELECT source, n, target, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS whole,
         greatest(1, CAST(ceil(n / 200000.0) AS BIGINT)) AS blocks FROM goals
), placed AS (
  SELECT d.doc_id, d.source, d.size, d.order_key, p.n, p.target, p.whole, p.target - p.whole * p.n AS rest,
         CAST('0x' || substr(d.order_key, 1, 8) AS BIGINT) % p.blocks AS block
  FROM keyed d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source
), blocks AS (
  SELECT source, block, rest, sum(size) AS words, md5(concat_ws('|', '8', coalesce(source, ''), CAST(block AS VARCHAR))) AS bkey
  FROM placed GROUP BY source, block, rest
), upto AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bkey, block ROWS UNBOUNDED PRECEDING) AS upto FROM blocks
), parted AS (
  SELECT source, block, upto - words AS before, CASE WHEN upto <= rest THEN 2 WHEN upto - words < rest THEN 1 ELSE 0 END AS part FROM upto
), ordered AS (
  SELECT p.*, b.part, b.before, row_number() OVER (PARTITION BY p.source, p.block ORDER BY order_key, doc_id, size) AS turn,
         b.before + sum(size) OVER (PARTITION BY p.source, p.block ORDER BY order_key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM placed p JOIN parted b ON p.source IS NOT DISTINCT FROM b.source AND p.block = b.block
), fitted AS (
  SELECT *, upto <= rest AS fits,
         rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source, block), before) AS gap FROM ordered
), missed AS (
  SELECT *, CASE WHEN NOT fits THEN abs(gap - size) END AS miss FROM fitted
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, block ORDER BY miss NULLS LAST, turn) AS best FROM missed
)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * (whole + CASE WHEN part = 2 THEN 1 WHEN part = 0 THEN 0 WHEN fits OR (best = 1 AND miss IS NOT NULL AND miss < gap) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""


def _secret_kinds() -> list[str]:
    """One list of {start, place, end, kind} per rule, as DuckDB expressions over `text`."""
    from hippolake.llm.secrets import RULES

    out = []
    for place, rule in enumerate(RULES):
        # DuckDB's expressions look neither back nor ahead and never try anything twice: a guard becomes a group before the match.
        guarded = re.match(r"\(\?<!\[([^\]]*)\]\)(.*)", rule.pattern)
        p, lead = (f"(^|[^{guarded[1]}]){guarded[2].replace('}+', '}')}", 1) if guarded else (rule.pattern, 0)
        p = p.replace("'", "''")
        found = lambda group: f"regexp_extract_all(text, '{p}', {group})"  # noqa: E731, B023
        before = found(1) if lead else "list_transform(m, lambda x: '')"
        start = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        out.append(
            f"SELECT doc_id, row_id, {place} AS place, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, CAST({start} + length(b[i]) AS BIGINT) AS first, CAST({start} + length(m[i]) AS BIGINT) AS last, length(t[i]) >= {rule.at_least} AS counts "
            f"FROM (SELECT doc_id, row_id, m, g, t, {before} AS b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, row_id, text, {found(0)} AS m, string_split_regex(text, '{p}') AS g, {found(rule.group)} AS t FROM texts))"
        )
    return out


def secrets_sql() -> str:
    spans = "\nUNION ALL ".join(_secret_kinds())
    counts = ", ".join(f"count(s.doc_id) FILTER (s.kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    written = "s.kind || ':' || s.first || ':' || s.last"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
spans AS (SELECT * FROM ({spans}) WHERE counts)
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({written}, ',' ORDER BY s.first, s.place) FILTER (s.base), '')) AS base_sha256,
       coalesce(string_agg({written}, ',' ORDER BY s.first, s.place), '') AS spans
FROM texts d LEFT JOIN spans s ON d.row_id = s.row_id
GROUP BY d.row_id, d.doc_id
"""


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 14 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

NEAR_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM worded
), nodes AS (
  SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), parts AS (
  SELECT id, n, unnest(s) AS t FROM nodes
), links AS (
  SELECT a.id AS a, b.id AS b FROM parts a JOIN parts b ON a.t = b.t AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached(id, other) AS (
  SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a
), named AS (
  SELECT n.s, min(r.other) AS component FROM nodes n JOIN reached r USING (id) GROUP BY n.s
)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets s LEFT JOIN named USING (s)
"""

TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         list_filter([CASE WHEN len(words) < 200 THEN 'A' END,
                      CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
                      CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) THEN 'C' END,
                      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                      CASE WHEN doc_id > first THEN 'E' END], lambda x: x IS NOT NULL) AS failed
  FROM worded LEFT JOIN marked USING (doc_id)
), counted AS (
  SELECT part, failed, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, failed
), letters(f) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS before
  FROM orders, range(1, 6) t(step)
), cells AS (
  SELECT part, filter_order, step, f, docs, good, toxic, failed,
         list_contains(failed, f) AS fails, len(list_intersect(failed, before)) > 0 AS gone
  FROM counted, steps
), rows AS (
  SELECT part, filter_order, step, f,
         CAST(coalesce(sum(docs) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(docs) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(docs) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(docs) FILTER (failed = [f]), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM cells GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rows
"""

#: The tables' pages mark their article, so SQL can cut it out and take its markup off, without any classifier or cut.
MAIN_TEXT_SQL = r"""
WITH cut AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS inner_html FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '<(/?p|/?h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS text FROM cut
), decoded AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(text, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS text FROM bare
), folded AS (
  SELECT page_id, url, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM decoded
)
SELECT page_id, url, text, CAST(len(text) AS BIGINT) AS n_chars FROM folded
"""
