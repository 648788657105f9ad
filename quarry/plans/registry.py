"""Named queries and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with DuckDB SQL for the same rows where SQL can state them."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL that several queries share -------------------------------------------------------------

#: sanitised lines with text of every document, numbered, with their token estimate
LINES = r"""
split AS (SELECT doc_id AS document_id, string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(10)) AS l FROM documents),
flat AS (SELECT document_id, unnest(range(1, len(l) + 1)) AS i, l FROM split),
cut AS (SELECT document_id, i, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS u FROM flat),
sized AS (SELECT document_id, i, u, length(regexp_replace(u, '[\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]', '', 'g')) AS o FROM cut WHERE u <> ''),
units AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) AS pos, u, (length(u) - o + ceil(o / 4.0))::BIGINT AS tokens FROM sized)
"""

#: chunks of the lines by greedy packing at 256 tokens, lines over 384 alone
CHUNKS = (
    LINES
    + r""",
pack AS (
  SELECT document_id, pos, u, tokens, 0::BIGINT AS chunk_index, CASE WHEN tokens >= 256 THEN 0 ELSE tokens END AS buf FROM units WHERE pos = 1
  UNION ALL
  SELECT n.document_id, n.pos, n.u, n.tokens,
    p.chunk_index + CASE WHEN p.buf = 0 OR n.tokens > 384 OR p.buf + n.tokens > 256 THEN 1 ELSE 0 END,
    CASE WHEN n.tokens > 384 THEN 0
         WHEN p.buf = 0 OR p.buf + n.tokens > 256 THEN CASE WHEN n.tokens >= 256 THEN 0 ELSE n.tokens END
         WHEN p.buf + n.tokens >= 256 THEN 0 ELSE p.buf + n.tokens END
  FROM pack p JOIN units n ON n.document_id = p.document_id AND n.pos = p.pos + 1),
packed AS (SELECT document_id, chunk_index, string_agg(u, chr(10) || chr(10) ORDER BY pos) AS content FROM pack GROUP BY ALL),
counted AS (SELECT *, length(regexp_replace(content, '[\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]', '', 'g')) AS o FROM packed),
chunks AS (SELECT document_id * 1048576 + chunk_index AS chunk_id, document_id, chunk_index, content, (length(content) - o + ceil(o / 4.0))::BIGINT AS token_count FROM counted)
"""
)

#: tokens of a text without CJK characters
TOKENS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"

#: BM25 of every benchmark text over the chunks, the first 50 of each
BM25 = (
    CHUNKS
    + rf""",
tok AS (SELECT chunk_id, {TOKENS.format('content')} AS t FROM chunks),
lens AS (SELECT chunk_id, greatest(len(t), 1) AS dl FROM tok),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS term FROM queries)),
scored AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (chunk_id), stats GROUP BY query_id, chunk_id),
sparse AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 50)
"""
)

BENCHMARK = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"

#: the same for a second reading of each query, its first half of words, as channel sparse_x; fused
HYBRID = (
    "variants AS (SELECT item_id AS query_id, text, list_aggregate(string_split(text, ' ')[1:ceil(len(string_split(text, ' ')) / 2.0)::BIGINT], 'string_agg', ' ') AS translated FROM benchmark), "
    "queries AS (SELECT query_id * 2 AS query_id, text FROM variants UNION ALL SELECT query_id * 2 + 1, translated FROM variants WHERE translated <> '' AND translated <> text), "
    + BM25
    + """,
hits AS (SELECT query_id // 2 AS query_id, CASE WHEN query_id % 2 = 0 THEN 'sparse' ELSE 'sparse_x' END AS channel, chunk_id, score, rank FROM sparse),
fusing AS (SELECT query_id, chunk_id, round(sum({weight} / (60 + rank)), 9) AS score, min(rank) AS sparse_rank FROM hits GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM fusing)
"""
)


def hybrid(weight: str = "1.0") -> str:
    return HYBRID.replace("{weight}", weight)
