"""Text auditing, bound to the given tables."""

from __future__ import annotations

from fieldspark.operators import text
from fieldspark.plans.q_joins import tokens_sql
from fieldspark.plans.registry import query


@query("numeric_tokens", tokens_sql("documents"))
def _(t):
    return text.numeric_tokens(t.documents)


_TOK = tokens_sql("documents")
_LINES = """SELECT page_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT page_id, string_split(replace(html, ',', ''), chr(10)) AS l FROM pages) p"""
_VERB = f"SELECT token, min((page_id, line_no)) AS pos FROM ({_TOK}) t JOIN ({_LINES}) l ON contains(line, token) GROUP BY 1"
_DEC = rf"SELECT DISTINCT page_id, line_no, unnest(regexp_extract_all(line, '\d+\.\d+')) AS d FROM ({_LINES}) l"
_REST = f"SELECT token, length(split_part(token, '.', 2))::INTEGER AS places FROM ({_TOK}) t WHERE token NOT IN (SELECT token FROM ({_VERB}) v) AND contains(token, '.') AND NOT contains(token, 'e')"
_ROUND = f"""SELECT token, min((page_id, line_no)) AS pos FROM ({_REST}) r JOIN ({_DEC}) d ON TRY_CAST(d AS DECIMAL(38, 12)) IS NOT NULL
AND (TRY_CAST(d AS DECIMAL(38, 12)) - CAST(token AS DECIMAL(38, 12)))::DOUBLE * 2 * pow(10, places) >= -1
AND (TRY_CAST(d AS DECIMAL(38, 12)) - CAST(token AS DECIMAL(38, 12)))::DOUBLE * 2 * pow(10, places) < 1 GROUP BY 1"""
TRACE = f"""SELECT token, pos[1] AS page_id, pos[2]::INTEGER AS line_no, coalesce(how, 'missing') AS how FROM ({_TOK}) t LEFT JOIN (SELECT token, pos, 'verbatim' AS how FROM ({_VERB}) v
UNION ALL SELECT token, pos, 'rounded' FROM ({_ROUND}) r) f USING (token)"""


@query("trace_tokens", TRACE)
def _(t):
    return text.trace_tokens(text.numeric_tokens(t.documents), text.lines_of(t.pages, "page_id", "html"), "page_id")


@query("word_budget", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::INTEGER AS words, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) <= 2000 AS within FROM documents")
def _(t):
    return text.word_budget(t.documents, 2000, "doc_id")


@query("pattern_guard", r"""SELECT doc_id, min(i)::INTEGER AS first_line, count(*) AS lines FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM
(SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) d) x WHERE regexp_matches(line, '[0-9]{2}') GROUP BY 1""")
def _(t):
    return text.pattern_guard(t.documents, "[0-9]{2}", t.labels.where("toxic = 1"), "doc_id")
