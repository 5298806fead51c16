"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Round by round: the squared distance of every part to every entry, the least one, the new entries."""
    steps = [
        """kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS MATERIALIZED (
            SELECT vec_id, CAST(p.p AS INT) AS p, CAST(k.k AS INT) AS k, v[p.p * (len(v) // {parts}) + k.k + 1] AS x
            FROM kept, range({parts}) AS p(p), LATERAL (SELECT unnest(range(len(v) // {parts})) AS k) AS k)""",
        f"""b0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p, k ORDER BY vec_id) - 1 AS e, k, x AS c
            FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, p, min({{'d': d, 'e': e}}) AS best
            FROM (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS d FROM x JOIN b{r} USING (p, k) GROUP BY vec_id, p, e) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
                SELECT b.p, b.e, b.k, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, b.c) AS c FROM b{r} AS b LEFT JOIN (
                    SELECT p, a.best.e AS e, k, sum(x) AS s, count(*) AS n FROM x JOIN a{r} AS a USING (vec_id, p) GROUP BY ALL
                ) AS s USING (p, e, k))""")
    steps.append(f"""coded AS (
        SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


COLLOCATIONS = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
phrases AS MATERIALIZED (
    SELECT lang, ws[i.i : i.i + k.k - 1] AS ws, k.k AS k, count(*) AS f
    FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) AS k, LATERAL (SELECT unnest(range(1, len(ws) - k.k + 2)) AS i) AS i GROUP BY ALL),
candidates AS MATERIALIZED (SELECT lang, ws, k, f AS a FROM phrases WHERE k > 1 AND f >= 30),
cuts AS (
    SELECT c.lang, c.ws, c.a, min({'score': CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f), 'j': j.j, 'l': x.f, 'r': y.f}) AS low
    FROM candidates AS c, LATERAL (SELECT unnest(range(1, c.k)) AS j) AS j
    JOIN phrases AS x ON x.lang = c.lang AND x.ws = c.ws[1 : j.j] JOIN phrases AS y ON y.lang = c.lang AND y.ws = c.ws[j.j + 1 : c.k] GROUP BY ALL),
inner_phrases AS (
    SELECT c.lang, c.ws[i.i : i.i + s.s - 1] AS ws, max(c.a) AS longer
    FROM candidates AS c, LATERAL (SELECT unnest(range(2, c.k)) AS s) AS s, LATERAL (SELECT unnest(range(1, c.k - s.s + 2)) AS i) AS i GROUP BY ALL),
kept AS (
    SELECT cuts.lang, array_to_string(cuts.ws, ' ') AS phrase, a, low.l AS l, low.r AS r, CAST(low.score AS BIGINT) AS score
    FROM cuts LEFT JOIN inner_phrases AS i ON i.lang = cuts.lang AND i.ws = cuts.ws WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang) USING (lang) QUALIFY rank <= 2000
"""

ORACLE_SQL = {"op12_vector_codes": _codes_sql(), "op13_collocations": COLLOCATIONS}
