"""DuckDB SQL of the two Lloyd operators: plain rounds over all centroids, one common table expression a step."""

from __future__ import annotations


def floor_mean(total: str, n: str) -> str:
    """floor(total / n) of whole numbers, without a division that rounds towards zero."""
    return f"({total} - (({total} % {n}) + {n}) % {n}) // {n}"


WHOLE = """SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def op11(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    gap = "list_sum(list_transform(range(1, {0} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))".format(dim)
    steps = [f"""w AS (SELECT row_number() OVER () AS rid, vec_id, v FROM ({WHOLE}) x WHERE len(v) = {dim})""",
             f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM w WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}) x)"""]
    nearest = "a{0} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS cluster, min(d) AS distance FROM (SELECT rid, vec_id, v, k, " + gap + " AS d FROM w, c{0}) x GROUP BY rid)"
    for n in range(rounds):
        steps += [
            nearest.format(n),
            f"s{n} AS (SELECT cluster, i, sum(x) AS total, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {dim} + 1)) AS i FROM a{n}) y GROUP BY 1, 2)",
            f"m{n} AS (SELECT cluster, list(CAST({floor_mean('total', 'n')} AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY 1)",
            f"c{n + 1} AS (SELECT k, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m ON m.cluster = o.k)",
        ]
    steps.append(nearest.format(rounds))
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate(c, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} o ON a.cluster = o.k"""  # fmt: skip


def op12(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = [f"w AS (SELECT row_number() OVER () AS rid, vec_id, label, v, len(v) // {parts} AS wide FROM ({WHOLE}) x)",
             f"p AS (SELECT rid, part, v[part * wide + 1 : part * wide + wide] AS x FROM (SELECT *, unnest(range({parts})) AS part FROM w) y)",
             f"e AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM w WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT {entries})",
             "b0 AS (SELECT part, CAST(e AS INTEGER) AS e, x AS c FROM p JOIN e USING (rid))"]
    nearest = "a{0} AS (SELECT rid, p.part, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT rid, p.part, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM p JOIN b{0} b ON p.part = b.part) p GROUP BY rid, p.part)"
    for n in range(rounds):
        steps += [
            nearest.format(n),
            f"s{n} AS (SELECT part, e, i, sum(x) AS total, count(*) AS n FROM (SELECT part, e, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM a{n}) y GROUP BY 1, 2, 3)",
            f"m{n} AS (SELECT part, e, list(CAST({floor_mean('total', 'n')} AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY 1, 2)",
            f"b{n + 1} AS (SELECT o.part, o.e, coalesce(m.c, o.c) AS c FROM b{n} o LEFT JOIN m{n} m ON m.part = o.part AND m.e = o.e)",
        ]
    steps += [
        nearest.format(rounds),
        f"h AS (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})",
        f"f AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN w USING (rid), h"


OP11_SQL, OP12_SQL = op11(), op12()
