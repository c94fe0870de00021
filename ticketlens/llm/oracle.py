"""DuckDB SQL of the registered queries of this subpackage, where SQL can
express the operator. The SQL follows the contracts, not the Spark code."""

from __future__ import annotations

from ticketlens.llm import centroid_clustering as CC
from ticketlens.llm import hard_negatives as HN
from ticketlens.llm import quality_rules as Q
from ticketlens.llm import substring_dedup as SD
from ticketlens.llm import url_filter as U

SP = r"[\x20\x09-\x0D]"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op2() -> str:
    rules = ", ".join(f"({k}, {_q(v)}, {_q(r)}, {_q(h)}, {_q(p)})" for k, (v, r, h, p) in enumerate(U.ordered(U.RULES)))
    ctes = [f"""
rules(pri, verdict, rule, rhost, rpath) AS (VALUES {rules}),
cutp AS (SELECT page_id, html, row_number() OVER () AS rid,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, html, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{U.UPPER}', '{U.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cutp),
fit AS (SELECT rid, rule, verdict FROM (
    SELECT rid, rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY pri) AS k
    FROM hp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) WHERE k = 1),
ruled AS (SELECT hp.rid, page_id, host, path, rule, verdict FROM hp LEFT JOIN fit USING (rid)),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, {_q(U.HREF)}, 1)) AS link FROM hp),
ends AS (SELECT src, translate(regexp_extract(regexp_replace(link, {_q(U.ABSOLUTE)}, ''), '^([^/?#]*)', 1), '{U.UPPER}', '{U.LOWER}') AS dst
    FROM links WHERE regexp_matches(link, {_q(U.ABSOLUTE)})),
edge AS (SELECT src, dst, count(*) AS n FROM ends WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
both_ways AS (SELECT 't' AS kind, src AS u, dst AS v, n FROM edge UNION ALL SELECT 'd', dst, src, n FROM edge),
step AS (SELECT kind, u, v, n, sum(n) OVER (PARTITION BY kind, u) AS n_out FROM both_ways),
hits AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM ruled GROUP BY 1),
s0 AS (SELECT 't' AS kind, host, CAST(floor(a * {float(U.UNIT)!r}::DOUBLE / n) AS BIGINT) AS score FROM hits WHERE a > 0
    UNION ALL SELECT 'd', host, CAST(floor(b * {float(U.UNIT)!r}::DOUBLE / n) AS BIGINT) FROM hits WHERE b > 0)"""]
    return "WITH RECURSIVE " + ",".join(ctes) + f""",
walk AS (SELECT kind, host, score FROM s0 UNION ALL
    SELECT w.kind, v, CAST(sum(CAST(floor(score * {U.DAMPING!r}::DOUBLE * n / n_out) AS BIGINT)) AS BIGINT)
    FROM walk w JOIN step ON w.kind = step.kind AND w.host = step.u WHERE score >= {U.TOLERANCE} GROUP BY 1, 2),
bad AS (SELECT host FROM walk GROUP BY 1
    HAVING coalesce(sum(score) FILTER (kind = 'd'), 0) > coalesce(sum(score) FILTER (kind = 't'), 0) * {U.RATIO!r}::DOUBLE)
SELECT page_id, ruled.host, path, rule, coalesce(verdict, CASE WHEN bad.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN bad ON ruled.host = bad.host"""


def op3() -> str:
    n = SD.WINDOW
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '{SP}+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + {n - 1}], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY md5_number(x)) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM twice, (SELECT unnest(range(0, {n})) AS k)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (rid, i) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""


def op4() -> str:
    words = ", ".join(_q(w) for w in Q.WORD_LIST)
    langs = ", ".join(_q(x) for x in sorted(Q.COMMON_WORDS))
    removed, classes, left = "text", [], "text"
    for name, pattern in Q.CLASSES:
        removed = f"regexp_replace({left}, {_q(pattern)}, '', 'g')"
        classes.append(f"length({left}) - length({removed}) AS c_{name}")
        left = removed
    classes.append(f"length({left}) AS c_rest")
    bins = " UNION ALL ".join(f"SELECT rid, lang, '{n}' AS bin, c_{n} AS n FROM d" for n in Q.CLASS_NAMES)

    def above(js, size, limits):
        return "CASE " + " ".join(f"WHEN {size} >= {a} THEN coalesce({js} > {b}, false)" for a, b in sorted(limits, reverse=True)) + " ELSE false END"

    def js(doc, ref, out):
        return f"""
{out}_j AS (SELECT d.rid, r.lang, greatest(0, (1 + sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q)) - q)) / 2) AS js2
    FROM {doc} d JOIN {ref} r ON d.bin = r.bin AND (r.lang IN ({langs}) OR r.lang = d.lang) GROUP BY 1, 2),
{out} AS (SELECT rid, min(sqrt(js2)) AS {out} FROM {out}_j GROUP BY 1)"""

    return f"""WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
d AS (SELECT rid, doc_id, lang, text, length(text) AS n_chars,
    list_filter(string_split_regex(text, '{SP}+'), lambda x: x <> '') AS w,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, {", ".join(classes)} FROM d0),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d0)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
tok AS (SELECT rid, lang, unnest(list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D.,]+'), lambda x: x <> '')) AS x FROM d),
wc AS (SELECT rid, lang, CASE WHEN x IN ({words}) THEN x ELSE '' END AS bin, count(*) AS n FROM tok GROUP BY ALL),
cc AS ({bins}),
known AS (SELECT DISTINCT lang FROM d WHERE lang IN ({langs})),
wbins AS (SELECT unnest([{words}, '']) AS bin), cbins AS (SELECT unnest([{", ".join(_q(n) for n in Q.CLASS_NAMES)}]) AS bin),
wr0 AS (SELECT k.lang, b.bin, coalesce(sum(n), 0) + 1 AS n FROM known k CROSS JOIN wbins b LEFT JOIN wc ON wc.lang = k.lang AND wc.bin = b.bin GROUP BY 1, 2),
wr AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang) AS q FROM wr0),
clang AS (SELECT lang FROM known UNION ALL SELECT lang FROM d WHERE lang IS NOT NULL AND lang NOT IN ({langs}) GROUP BY 1
    HAVING count(*) >= {Q.MIN_DOCUMENTS} AND count(*) >= {Q.MIN_SHARE!r}::DOUBLE * (SELECT count(*) FROM d)),
cr0 AS (SELECT k.lang, b.bin, coalesce(sum(n), 0) + 1 AS n FROM clang k CROSS JOIN cbins b LEFT JOIN cc ON cc.lang = k.lang AND cc.bin = b.bin GROUP BY 1, 2),
cr AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang) AS q FROM cr0),
wd AS (SELECT rid, lang, bin, n / sum(n) OVER (PARTITION BY rid) AS p FROM wc),
cd AS (SELECT rid, lang, bin, n / sum(n) OVER (PARTITION BY rid) AS p FROM cc WHERE n > 0),{js("wd", "wr", "word_js")},{js("cd", "cr", "class_js")},
b AS (SELECT d.*, len(w) AS n_words, coalesce(n_dup_lines, 0) AS dup, coalesce(n_repeat_words, 0) AS rw, word_js, class_js
    FROM d LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN word_js USING (rid) LEFT JOIN class_js USING (rid)),
f AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * rw > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, n_chars - c_space AS word_chars, n_symbols, dup AS n_dup_lines, rw AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (((lang IS NULL OR lang IN (SELECT lang FROM known)) AND {above("word_js", "n_words", Q.WORD_LIMITS)})
    OR {above("class_js", "n_chars", Q.CLASS_LIMITS)}) AS kept FROM f"""


def op11() -> str:
    """Rounds are chained tables; distances are taken from components, not
    from dot products."""
    parts = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding,
    lambda e: CAST(floor(greatest(-{float(CC.LIMIT)!r}::DOUBLE, least({float(CC.LIMIT)!r}::DOUBLE, CAST(e AS DOUBLE) * {CC.SCALE}))) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = {CC.DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {CC.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{CC.SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS INTEGER) AS c, x FROM v
    QUALIFY c < {CC.CLUSTERS}),"""]
    near = """d{k} AS (SELECT rid, vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, t.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{k} t),
a{k} AS MATERIALIZED (SELECT rid, vec_id, x, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),"""
    for k in range(CC.ROUNDS):
        parts.append(near.format(k=k) + f"""
m{k} AS (SELECT c, i, CAST(floor(sum(CAST(e AS HUGEINT)) / count(*)) AS BIGINT) AS e FROM (SELECT c, unnest(x) AS e, unnest(range({CC.DIMENSIONS})) AS i FROM a{k}) GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(n.x, o.x) AS x FROM c{k} o LEFT JOIN (SELECT c, list(e ORDER BY i) AS x FROM m{k} GROUP BY 1) n USING (c)),""")
    parts.append(near.format(k=CC.ROUNDS) + f"""
h AS (SELECT c, sha256(array_to_string(x, ',')) AS digest FROM c{CC.ROUNDS})
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256 FROM a{CC.ROUNDS} JOIN h USING (c)""")
    return "\n".join(parts)


def op12() -> str:
    return f"""WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: CAST(floor(greatest(-{float(HN.LIMIT)!r}::DOUBLE, least({float(HN.LIMIT)!r}::DOUBLE, CAST(e AS DOUBLE) * {HN.SCALE}))) AS BIGINT)) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
s AS MATERIALIZED (SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
    FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % {HN.EVERY} = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= {HN.POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST, s.b) AS INTEGER) AS rank
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND {HN.SHARE} * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {HN.NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": op2(), "op3_substring_dedup": op3(), "op4_quality_rules": op4(),
            "op11_centroid_clustering": op11(), "op12_hard_negatives": op12()}
