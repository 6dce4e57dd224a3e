"""Pieces of the checking SQL (DuckDB)."""

from __future__ import annotations

from ..functions.constants import STOPWORDS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"


def tokens_of(normal: str, stopwords=STOPWORDS) -> str:
    return f"list_filter(regexp_extract_all({normal}, '[a-zA-Z0-9äöüÄÖÜß]{{2,}}'), lambda tok: NOT list_contains({array(stopwords)}, tok))"


def tokens(c: str) -> str:
    return tokens_of(norm(c))


def ordered_distinct(values: str) -> str:
    return f"list_filter({values}, lambda el, pos: list_position({values}, el) = pos)"


def ngrams(t: str, n: int) -> str:
    joined = " || ' ' || ".join(f"{t}[i + {k}]" for k in range(n))
    return f"CASE WHEN len({t}) >= {n} THEN list_distinct(list_transform(range(1, len({t}) - {n} + 2), lambda i: {joined})) ELSE []::varchar[] END"


def plain(c: str) -> str:
    out = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def cosine(a: str, b: str) -> str:
    a, b = f"{a}::double[]", f"{b}::double[]"
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1] * p[2]))"
    return f"round({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0), 9)"


#: Postings of documents and their BM25 statistics.
POSTINGS = f"""toks AS (SELECT doc_id AS id, unnest({tokens('text')}) AS term FROM documents),
posts AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
lens AS (SELECT id, sum(tf) AS dl FROM posts GROUP BY id),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term)"""

BM25_WEIGHT = "tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * ln(1 + (n - df + 0.5) / (df + 0.5))"


def bm25(queries: str) -> str:
    """Scores of documents for a table of (query_id, text)."""
    return f"""wanted AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM {queries})),
bm AS (SELECT query_id, id, round(sum({BM25_WEIGHT}), 4) AS score FROM posts JOIN wanted USING (term) JOIN lens USING (id) JOIN dfs USING (term) CROSS JOIN stats GROUP BY query_id, id)"""


def ranks(source: str, k: int | None = None, by: str = "query_id", score: str = "score", id_: str = "id") -> str:
    where = f" WHERE rank <= {k}" if k else ""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, {id_}) AS rank FROM {source}){where})"


def hay(t: str, u: str) -> str:
    return f"({norm(t)} || ' ' || {norm(u)})"


def share(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN {part}::double / {whole} ELSE 0 END)"


def found(values: str, h: str) -> str:
    return f"list_filter({values}, lambda f: contains({h}, f))"


def lexical_f(q: str, t: str, h: str) -> str:
    long = f"list_filter({t}, lambda g: length(g) >= 6)"
    return f"(CASE WHEN len({t}) = 0 THEN 0 ELSE least(1, greatest(0, 0.7 * {share(f'len(list_distinct({found(t, h)}))', f'len({t})')} + CASE WHEN length({q}) >= 6 AND contains({h}, {q}) THEN 0.2 ELSE 0 END + 0.1 * {share(f'len({found(long, h)})', f'len({long})')})) END)::double"


def lexical_b(q: str, t: str, h: str) -> str:
    long = f"list_filter({t}, lambda g: length(g) >= 6)"
    two, three = ngrams(t, 2), ngrams(t, 3)
    return (
        f"(CASE WHEN len({t}) = 0 THEN 0 ELSE least(1, greatest(0, 0.55 * {share(f'len(list_distinct({found(t, h)}))', f'len({t})')} + 0.25 * {share(f'len({found(two, h)})', f'len({two})')}"
        f" + 0.15 * {share(f'len({found(three, h)})', f'len({three})')} + CASE WHEN length({q}) >= 6 AND contains({h}, {q}) THEN 0.3 ELSE 0 END + 0.1 * {share(f'len({found(long, h)})', f'len({long})')})) END)::double"
    )


def strict(t: str, quoted: str, h: str) -> str:
    core = f"list_filter({t}, lambda g: length(g) >= 4)"
    return f"(len(list_filter({quoted}, lambda f: NOT contains({h}, f))) = 0 AND (len({core}) = 0 OR len({found(core, h)}) > 0))"


def phrases(c: str) -> str:
    inner = norm("w")
    return f"list_filter(list_transform(regexp_extract_all({c}, '\"([^\"]+)\"', 1), lambda w: {inner}), lambda w: w <> '')"
