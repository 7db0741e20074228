"""DuckDB SQL with the rows of the queries of the same names."""

from __future__ import annotations

from tidemark.llm.url_rules import BLOCKED_WORDS

_SPACE = r"[^ \t\n\x0B\f\r]+"


def line_dedup_sql() -> str:
    return r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), norms AS (
  SELECT *, regexp_replace(trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g')), '[0-9]+', '<*>', 'g') AS norm FROM split
), toks AS (
  SELECT *, string_split(norm, ' ') AS t, len(string_split(norm, ' ')) AS n FROM norms
), parsed AS (
  SELECT doc_id, line_no, norm, t, n, least(4, (2 * n + 4) // 5) AS depth FROM toks WHERE norm <> ''
), deep AS (
  SELECT doc_id, norm, t, n, unnest(['^ ' || array_to_string(t[1:depth], ' '), '$ ' || array_to_string(t[n - depth + 1:n], ' ')]) AS leaf FROM parsed WHERE n >= 4
), leaves AS (
  SELECT n, leaf FROM deep GROUP BY n, leaf HAVING count(DISTINCT doc_id) >= 3
), lines AS (
  SELECT n, leaf, norm, any_value(t) AS t, min(doc_id) AS least_doc, max(doc_id) AS most_doc FROM deep JOIN leaves USING (n, leaf) GROUP BY n, leaf, norm
), parts AS (
  SELECT n, leaf, norm, least_doc, most_doc, unnest(t) AS token, generate_subscripts(t, 1) AS place FROM lines
), supports AS (
  SELECT *, count(*) OVER w AS support, min(least_doc) OVER w < max(most_doc) OVER w AS shared FROM parts WINDOW w AS (PARTITION BY n, leaf, place, token)
), measured AS (
  SELECT *, list_reverse_sort(list(support) OVER (PARTITION BY n, leaf, norm))[ceil(0.75 * n)::INT] AS measure FROM supports
), judged AS (
  SELECT *, shared AND 2 * support > measure AS fixed FROM measured WHERE measure >= 2
), general AS (
  SELECT DISTINCT norm, n, template FROM (
    SELECT norm, n, leaf, concat(n, '|', string_agg(CASE WHEN fixed THEN token ELSE '<*>' END, ' ' ORDER BY place)) AS template
    FROM judged GROUP BY norm, n, leaf HAVING 4 * count(*) FILTER (WHERE fixed) >= 3 * n)
), named AS (
  SELECT doc_id, line_no, CASE WHEN n < 4 THEN 3 ELSE 2 END AS need, norm AS template FROM parsed
  UNION ALL
  SELECT DISTINCT p.doc_id, p.line_no, CASE WHEN g.n < 8 THEN 10 ELSE 3 END + 100, g.template FROM parsed p JOIN general g USING (norm)
), stats AS (
  SELECT need, template, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM named GROUP BY ALL
), firsts AS (
  SELECT s.need, s.template, s.first_doc, min(n.line_no) AS first_line
  FROM stats s JOIN named n ON n.need = s.need AND n.template = s.template AND n.doc_id = s.first_doc WHERE s.docs >= s.need % 100 GROUP BY ALL
), dropped AS (
  SELECT DISTINCT n.doc_id, n.line_no FROM named n JOIN firsts f USING (need, template) WHERE n.doc_id <> f.first_doc OR n.line_no <> f.first_line
), rebuilt AS (
  SELECT s.doc_id, count(*) AS n_lines, count(d.doc_id) AS n_dropped,
         coalesce(string_agg(s.line, chr(10) ORDER BY s.line_no) FILTER (WHERE d.doc_id IS NULL), '') AS text
  FROM split s LEFT JOIN dropped d ON d.doc_id = s.doc_id AND d.line_no = s.line_no GROUP BY s.doc_id
)
SELECT o.doc_id, coalesce(r.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_dropped, 0)::BIGINT AS n_dropped, r.text FROM documents o LEFT JOIN rebuilt r ON r.doc_id = o.doc_id"""


def mixing_sql(domain: str, weights: list[tuple], max_epochs: int, seed: int) -> str:
    """The tree's levels, each filled like the one above, then the seeded prefixes."""
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    values = ", ".join(f"({quoted(d)}, {quoted(g)}, {quoted(s)}, {w})" for d, g, s, w in weights)
    levels, above, parents = "", "SELECT 0 AS root, (sum(tokens) * 6 // 10)::BIGINT AS budget FROM leaves", ["root"]
    names = ["domain", "lang", "source"]
    for depth in (1, 2, 3):
        own = names[:depth]
        cols, part = ", ".join(own), ", ".join(parents)
        given = " AND ".join(f"{c} IS {'NOT ' if c in own else ''}NULL" for c in names)
        levels += f""", above{depth} AS ({above})
, nodes{depth} AS (
  SELECT n.*, coalesce(w.weight, 1) AS weight, a.budget FROM
    (SELECT 0 AS root, {cols}, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {max_epochs} AS capacity FROM leaves GROUP BY {cols}) n
  LEFT JOIN (SELECT * FROM weights WHERE {given}) w ON {' AND '.join(f'w.{c} = n.{c}' for c in own)}
  JOIN above{depth} a ON {' AND '.join(f'a.{c} = n.{c}' for c in parents)}
), sums{depth} AS (
  SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on
  FROM nodes{depth} WINDOW o AS (PARTITION BY {part} ORDER BY capacity::DOUBLE / weight, {cols})
), fulls{depth} AS (SELECT *, capacity * weight_on <= weight * (budget - before) AS is_full FROM sums{depth}
), shares{depth} AS (
  SELECT *, CASE WHEN is_full THEN capacity ELSE weight * (budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER p)
     // sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER p END AS share FROM fulls{depth} WINDOW p AS (PARTITION BY {part})
)"""
        above, parents = f"SELECT {cols}, share AS budget FROM shares{depth}", own
    return f"""
WITH small AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS tokens FROM documents
), weights(domain, lang, source, weight) AS (VALUES {values}
), leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM small WHERE tokens > 0 GROUP BY ALL){levels}
, plan AS (SELECT domain, lang, source, (share // tokens)::BIGINT AS epochs, (share % tokens)::BIGINT AS rest FROM shares3
), keyed AS (SELECT s.*, p.epochs, p.rest, md5(concat_ws('|', '{seed}', p.epochs, s.doc_id)) AS key FROM small s JOIN plan p USING (domain, lang, source) WHERE s.tokens > 0
), placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed
), taken AS (SELECT *, CASE WHEN upto <= rest THEN epochs ELSE epochs - 1 END AS last FROM placed)
SELECT doc_id, domain, lang, source, unnest(range(0, last + 1))::BIGINT AS epoch FROM taken WHERE last >= 0"""


#: Parameters of op2 as registered: domains are dealt by the source's number.
MIX_DOMAIN = "CASE coalesce(try_cast(regexp_extract(source, '[0-9]+$', 0) AS INT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END"
MIX_WEIGHTS = [("web", None, None, 3), ("books", None, None, 5), ("code", None, None, 2), *[(d, g, None, w) for d in ("web", "books", "code") for g, w in (("en", 4), ("de", 3), ("fr", 2), ("es", 3))]]
MIX_EPOCHS, MIX_SEED = 2, 17

#: Rules of op8: the contract's; the method's own for other pages are url_rules.default_rules.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def url_rules_sql() -> str:
    rows = [f"('{h}', '{p}', '{v}', 0)" for h, p, v in URL_RULES] + [f"('~{w}', '', 'block', 1)" for w in BLOCKED_WORDS]
    parts = r"'^(?s:.*?)://([^/?#]*)([^?#]*)'"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rules(rh, rp, v, tier) AS (VALUES {', '.join(rows)}
), p AS (
  SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, {parts}, 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, {parts}, 2), '') AS path FROM pages
), m AS (
  SELECT p.*, rh || rp AS r, v, tier, row_number() OVER (PARTITION BY rid ORDER BY tier, length(rh || rp) DESC NULLS LAST, length(rh) DESC, v DESC) AS k
  FROM p LEFT JOIN rules ON CASE WHEN rh[1] = '~' THEN list_contains(string_split(replace(host, '-', '.'), '.'), rh[2:]) ELSE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) END
)
SELECT page_id, host, path, CASE WHEN tier = 0 THEN r END AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1"""


def decontamination_sql(window: int = 13) -> str:
    """Windows as joined words; longest and longest_at are left to the suffix arrays, so the
    SQL extends each occurrence word by word through the numbered words of both sides."""
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words('text')}, []) AS w FROM documents
), b AS (SELECT item_id, coalesce({words('text')}, []) AS w FROM benchmark
), windows AS (
  SELECT item_id, w, s, least({window}, len(w)) AS size, array_to_string(w[s:s + least({window}, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window} + 2, 2))) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows
), grams AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT g.doc_id, g.p, g.size, v.item_id, v.s, v.w AS iw FROM grams g JOIN windows v ON g.size = v.size AND g.gram = v.gram
), long AS (
  SELECT h.doc_id, h.p, h.size + coalesce((SELECT min(x) FROM range(0, len(h.iw) - h.s - h.size + 2) t(x) WHERE h.s + h.size + x > len(h.iw) OR d.w[h.p + h.size + x] IS DISTINCT FROM h.iw[h.s + h.size + x]), 0) AS n
  FROM hits h JOIN d USING (doc_id)
), best AS (SELECT doc_id, max(n) AS longest FROM long GROUP BY doc_id
), best_at AS (SELECT l.doc_id, any_value(b.longest) AS longest, min(l.p) - 1 AS longest_at FROM long l JOIN best b ON l.doc_id = b.doc_id AND l.n = b.longest GROUP BY l.doc_id
), covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM hits) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated, coalesce(a.longest, 0)::INT AS longest, a.longest_at::INT AS longest_at
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id LEFT JOIN best_at a ON a.doc_id = d.doc_id"""


_REAL = "embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"
_WHOLE = "[floor(256 * x::DOUBLE)::BIGINT for x in embedding]"


def negatives_sql() -> str:
    """All anchors against all rows; exact copies of a row count once."""
    return f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_REAL}
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, a.x AS ax, b.vec_id, b.label, list_inner_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, anchor_label, ax, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_label, ax ORDER BY score DESC, vec_id) <= 5
), inside AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.ax, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s USING (anchor_id, anchor_label, ax)
  WHERE s.label <> p.anchor_label AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM inside WHERE rank <= 10"""


def centroids_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Each round written out: all distances, the nearest, the floors of the means."""
    gaps = "[(p[1] - p[2])::DOUBLE for p in list_zip(v.x, c.x)]"
    square = f"list_inner_product({gaps}, {gaps})::BIGINT"
    steps = ""
    for n in range(rounds + 1):
        steps += f""", assigned{n} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT v.rid, c.cluster, {square} AS d FROM v, c{n} c) GROUP BY rid
)"""
        if n < rounds:
            steps += f""", means{n} AS (
  SELECT cluster, list(m ORDER BY i) AS x FROM (
    SELECT a.cluster, i, ((sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM assigned{n} a JOIN v USING (rid), range(1, {size + 1}) t(i) GROUP BY a.cluster, i) GROUP BY cluster
), c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN means{n} m USING (cluster))"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, {_WHOLE} AS x FROM embeddings WHERE len(embedding) = {size} AND {_REAL}
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1)::INT AS cluster, x FROM v QUALIFY cluster < {k}
){steps}
SELECT v.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN assigned{rounds} a USING (rid) JOIN c{rounds} c USING (cluster)"""


ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing_sql(MIX_DOMAIN, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED),
    "op5_lines": line_dedup_sql(),
    "op7_decontamination": decontamination_sql(),
    "op8_urls": url_rules_sql(),
    "op11_negatives": negatives_sql(),
    "op12_centroids": centroids_sql(),
}
