"""The SQL that some of this package's queries must equal, written for DuckDB."""

from __future__ import annotations

from fieldspark.llm import mixing, urls

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def reach(nodes: str, pairs: str) -> str:
    """CTEs ``comp``: the least node reachable from each of ``nodes`` over ``pairs`` (a, b)."""
    return f"""reach AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM {pairs} UNION ALL SELECT b, a FROM {pairs}) e ON e.a = r.b),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)"""


def mixing_sql() -> str:
    dims = ("source", "lang", "topic")
    text = "coalesce(text, '')"
    docs = f"""SELECT doc_id, source, lang, CASE WHEN {text} = '' THEN 0 ELSE length({text}) - length(replace({text}, ' ', '')) + 1 END AS tokens,
CASE WHEN contains({text}, 'icense') THEN 'licence' WHEN contains({text}, ' | ') THEN 'table' WHEN contains({text}, '***') OR contains({text}, '###') OR contains({text}, '&&&') THEN 'noise'
WHEN length({text}) < 1000 THEN 'short' ELSE 'long' END AS topic, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents"""
    ctes = [f"d AS ({docs})", "c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS base, sum(tokens)::DOUBLE AS weight FROM d GROUP BY ALL)"]
    for x in dims:
        ctes.append(f"g_{x} AS (SELECT {x}, pow(sum(base), {mixing.POWER}) / sum(pow(sum(base), {mixing.POWER})) OVER () AS target FROM c0 GROUP BY 1)")
    at = 0
    for _ in range(mixing.PASSES):
        for x in dims:
            ctes.append(f"c{at + 1} AS (SELECT c.source, c.lang, c.topic, base, least(base, CASE WHEN sum(weight) OVER (PARTITION BY c.{x}) > 0 THEN weight * (target * {mixing.KEEP} * (SELECT sum(base) FROM c0) / sum(weight) OVER (PARTITION BY c.{x})) "
                        f"ELSE weight END) AS weight FROM c{at} c JOIN g_{x} g ON g.{x} IS NOT DISTINCT FROM c.{x})")
            at += 1
    p = "CASE WHEN base > 0 THEN weight / base ELSE 1.0 END"
    return (f"WITH {', '.join(ctes)} SELECT doc_id, tokens::BIGINT AS tokens, d.topic, round(weight, 3) AS weight, round({p}, 6) AS p, u < {p} AS kept FROM d JOIN c{at} c "
            "ON c.source IS NOT DISTINCT FROM d.source AND c.lang IS NOT DISTINCT FROM d.lang AND c.topic = d.topic")


JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(len(l) - 3, 2)), lambda i: array_to_string(l[i:i + 4], ' ')))) AS g FROM w),
t AS (SELECT id, CASE WHEN g = [''] THEN [] ELSE g END AS g FROM s),
cls AS (SELECT g, min(id) AS id, count(*) AS size, len(g) AS n FROM t GROUP BY g),
e AS (SELECT id, unnest(g) AS x FROM cls),
k AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT a, b, x.size AS sa, y.size AS sb FROM k JOIN cls x ON x.id = a JOIN cls y ON y.id = b WHERE k >= 0.8 * (x.n + y.n - k)),
others AS (SELECT id, sum(n) AS n FROM (SELECT a AS id, sb AS n FROM p UNION ALL SELECT b, sa FROM p) q GROUP BY 1),
{reach('cls', 'p')}
SELECT t.id AS doc_id, c.id AS class_id, component AS component_id, (size - 1 + coalesce(o.n, 0))::BIGINT AS n_links, t.id = component AS kept
FROM t JOIN cls c USING (g) JOIN comp m ON m.id = c.id LEFT JOIN others o ON o.id = c.id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT id, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
p AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.id < b.id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
{reach('v', 'p')}
SELECT v.id AS vec_id, (SELECT count(*) FROM p WHERE a = v.id OR b = v.id) AS n_links, component AS component_id, v.id = component AS kept FROM v JOIN comp USING (id)"""


def urls_sql(levels: int = 3) -> str:
    """``levels`` are path segments looked at: more than any given URL has."""
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = {h + p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules}
    rule = "CASE " + " ".join(f"WHEN {fits[h + p]} THEN '{h + p}'" for h, p, _ in rules) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h + p}' THEN '{v}'" for h, p, v in rules) + " END"
    ctes = [f"""u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {LETTERS}), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
            f"r AS (SELECT *, {rule} AS rule FROM u)",
            f"""t0 AS (SELECT *, {verdict} AS ruled, '' AS template, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '[0-9a-fA-F]{{16,}}', '*', 'g'), '[0-9]+', '*', 'g')) AS s FROM r)"""]
    for i in range(levels):
        ctes.append(f"v{i} AS (SELECT host, template FROM (SELECT host, template, s[{i + 1}] AS x, count(*) AS n FROM t{i} WHERE len(s) > {i} GROUP BY ALL) q GROUP BY 1, 2 HAVING sum(n) >= {urls.LEAST_PAGES} AND count(*) >= {urls.VARIED} * sum(n))")
        ctes.append(f"t{i + 1} AS (SELECT t.* REPLACE (CASE WHEN len(s) > {i} THEN template || '/' || CASE WHEN v.host IS NOT NULL THEN '*' ELSE s[{i + 1}] END ELSE template END AS template) "
                    f"FROM t{i} t LEFT JOIN v{i} v USING (host, template))")
    ctes.append(f"leaf AS (SELECT host, template, string_split(host, '.')[-1] AS suf, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS b FROM t{levels} GROUP BY ALL)")
    before = "leaf"
    for name, keys in (("a", ""), ("s", "suf"), ("h", "host"), ("p", "suf, template"), ("m", "template")):
        over = f"PARTITION BY {keys}" if keys else ""
        ctes.append(f"l{name} AS (SELECT *, sum(n) OVER ({over}) AS n{name}, sum(b) OVER ({over}) AS b{name} FROM {before})")
        before = f"l{name}"
    k = urls.SMOOTHING

    def smooth(b: str, n: str, prior: str) -> str:
        return f"(({b} + {k} * {prior}) / ({n} + {k}))"

    every = smooth("ba", "na", "0.5")
    host = smooth("bh", "nh", smooth("bs", "ns", smooth("bm", "nm", every)))
    pool = smooth("bp", "np", host)
    rate = "(bp / greatest(np, 1))"
    merged = f"(n = 0 OR abs(b / greatest(n, 1) - {rate}) <= {urls.APART} * sqrt({rate} * (1 - {rate}) / greatest(n, 1)) + 1e-12)"
    ctes.append(f"known AS (SELECT host, template, CASE WHEN {merged} THEN {smooth('b', 'n', pool)} ELSE {smooth('b', 'n', host)} END AS purity FROM lm)")
    return (f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {urls.CUT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity "
            f"FROM t{levels} JOIN known USING (host, template)")


def phrases_sql() -> str:
    gram = "SELECT lang, array_to_string(w[i:i + {k} - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM p) GROUP BY ALL"
    whole = "CAST(1000000 AS HUGEINT) * a * a"
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
f1 AS ({gram.format(k=1)}), f2 AS ({gram.format(k=2)}), f3 AS ({gram.format(k=3)}),
n AS (SELECT lang, sum(a) AS n FROM f1 GROUP BY 1),
c3 AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f3 WHERE a >= 10),
c2 AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f2 WHERE a >= 10),
kept AS (SELECT * FROM c2 WHERE NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = c2.lang AND (c3.w[1:2] = c2.w OR c3.w[2:3] = c2.w) AND 100 * c3.a >= 50 * c2.a)),
cut AS (SELECT k.lang, k.phrase, k.a, x.a AS l, y.a AS r, 1 AS cut_at FROM kept k JOIN f1 x ON x.lang = k.lang AND x.phrase = k.w[1] JOIN f1 y ON y.lang = k.lang AND y.phrase = k.w[2]
UNION ALL SELECT k.lang, k.phrase, k.a, x.a, y.a, 1 FROM c3 k JOIN f1 x ON x.lang = k.lang AND x.phrase = k.w[1] JOIN f2 y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[2:3], ' ')
UNION ALL SELECT k.lang, k.phrase, k.a, x.a, y.a, 2 FROM c3 k JOIN f2 x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:2], ' ') JOIN f1 y ON y.lang = k.lang AND y.phrase = k.w[3]),
scored AS (SELECT lang, phrase, a, l, r, cut_at, ({whole}) // (CAST(l AS HUGEINT) * r) AS score FROM cut),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM top JOIN n USING (lang)"""


ORACLE = {"op1_mixing": mixing_sql(), "op3_ngram_join": JOIN, "op4_near_vectors": VECTORS, "op6_urls": urls_sql(),
          "op12_collocations": phrases_sql()}
