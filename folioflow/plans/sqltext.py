"""DuckDB SQL fragments shared by the checks."""

from __future__ import annotations

# DuckDB's patterns know no Unicode flag, so the space characters are listed.
SPACE_CHARS = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE = f"[{SPACE_CHARS}]"
WORD_CHARS = r"\p{L}\p{N}_"
URL_PATTERN = f"http[^{SPACE_CHARS}]+|www[^{SPACE_CHARS}]+|https[^{SPACE_CHARS}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def string_list(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda t: t <> '')"


def token_set(x: str) -> str:
    return f"list_distinct({words(f'lower({x})')})"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+\\z', '')"


def overlap(part: str, whole: str) -> str:
    """Share of the distinct items of one list found in another."""
    return (
        f"CASE WHEN len({part}) > 0 THEN len(list_intersect({part}, {whole}))::DOUBLE / len({part}) "
        f"ELSE 0.0::DOUBLE END"
    )


def first_seen(x: str) -> str:
    """Distinct items of a list in order of first occurrence."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def chunk_ctes(size: int = 256, step: int = 128) -> str:
    return f"""
    toks AS (SELECT doc_id, lang, source, {words("text")} AS t FROM documents),
    chunks AS (
      SELECT doc_id, lang, source, i::INT AS chunk_index, doc_id || '-' || i AS chunk_id,
             array_to_string(t[i * {step} + 1 : i * {step} + {size}], ' ') AS chunk_text
      FROM (SELECT *, unnest(range(0, greatest(ceil((len(t) - {size}) / {step}.0)::BIGINT, 0) + 1)) AS i
            FROM toks WHERE len(t) > 0))
    """


QUESTIONS = f"""
    questions AS (SELECT item_id AS query_id, substring({strip("text")}, 1, 512) AS question
                  FROM benchmark)
"""

HITS = f"""
    qt AS (SELECT query_id, unnest({token_set("question")}) AS term FROM questions),
    qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1),
    ct AS (SELECT chunk_id, unnest({token_set("chunk_text")}) AS term FROM chunks),
    pairs AS (SELECT query_id, chunk_id, count(*) AS c FROM qt JOIN ct USING (term) GROUP BY ALL),
    hits AS (
      SELECT query_id, chunk_id, c::DOUBLE / n AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY c::DOUBLE / n DESC, chunk_id) AS rank
      FROM pairs JOIN qn USING (query_id) QUALIFY rank <= 10),
    final AS (
      SELECT query_id, question, doc_id, chunk_index, chunk_id, chunk_text, score AS overlap,
             row_number() OVER (PARTITION BY query_id ORDER BY hits.rank) AS rank
      FROM hits JOIN chunks USING (chunk_id) JOIN questions USING (query_id)
      WHERE score > 0.1 QUALIFY rank <= 5)
"""

RETRIEVAL = f"{chunk_ctes()}, {QUESTIONS}, {HITS}"

# User turns joined to the assistant turn after them.
ANSWERS = """
    answers AS (
      SELECT u.conv_id || '-' || u.turn AS query_id, u.text AS question, a.text AS answer
      FROM conversations u JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant')
"""

CENTROIDS = """
    centroids AS (
      SELECT label, list(m ORDER BY i) AS v
      FROM (SELECT label, i, avg(x::DOUBLE) AS m
            FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
                  FROM embeddings)
            GROUP BY ALL)
      GROUP BY 1),
    scored AS (
      SELECT c.label AS query_id, e.vec_id,
             round(list_cosine_similarity(c.v, e.embedding::DOUBLE[]), 10) AS score
      FROM centroids c, embeddings e)
"""
