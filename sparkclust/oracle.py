"""Independent SQL formulations (DuckDB dialect) of the registered queries.

They are the correctness oracle: plain joins, groups and windows over the
fixture tables, with Lloyd's iterations unrolled into one CTE per pass.
Nothing here runs on Spark.
"""

from __future__ import annotations

ROUND = 4


def _dist_cols(d: int, a: str = "p", b: str = "c") -> str:
    return " + ".join(f"(({a}.x{j} - {b}.x{j}) * ({a}.x{j} - {b}.x{j}))" for j in range(d))


def _dist_list(d: int, a: str = "p", b: str = "c") -> str:
    return f"list_sum(list_transform(range(1, {d + 1}), lambda j: ({a}.v[j] - {b}.v[j]) * ({a}.v[j] - {b}.v[j])))"


def seeds_sql(d: int, k: int, src: str = "p", vector: bool = False) -> str:
    """First K points by id, zero-padded to K rows."""
    if vector:
        return (
            f"SELECT r.range AS cid, coalesce(s.v, list_transform(range(1, {d + 1}), lambda j: 0.0::DOUBLE)) AS v "
            f"FROM range({k}) r LEFT JOIN (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, v FROM {src} "
            f"ORDER BY id LIMIT {k}) s ON s.cid = r.range"
        )
    cols = ", ".join(f"coalesce(s.x{j}, 0.0)::DOUBLE AS x{j}" for j in range(d))
    inner = ", ".join(f"x{j}" for j in range(d))
    return (
        f"SELECT r.range AS cid, {cols} FROM range({k}) r LEFT JOIN "
        f"(SELECT row_number() OVER (ORDER BY id) - 1 AS cid, {inner} FROM {src} ORDER BY id LIMIT {k}) s "
        f"ON s.cid = r.range"
    )


def assign_sql(d: int, centers: str, src: str = "p", vector: bool = False) -> str:
    dist = _dist_list(d) if vector else _dist_cols(d)
    return f"SELECT p.id, (min(row({dist}, c.cid)))[2] AS cid FROM {src} p CROSS JOIN {centers} c GROUP BY p.id"


def update_sql(d: int, prev: str, assigned: str, src: str = "p", vector: bool = False, add: str = "sum") -> str:
    """Mean per cluster; a cluster without points keeps its previous centre. ``add="fsum"`` compensates the rounding of sums."""
    if vector:
        return (
            f"SELECT c.cid, CASE WHEN m.cnt IS NULL THEN c.v ELSE m.v END AS v FROM {prev} c LEFT JOIN ("
            f"SELECT cid, list(s / n ORDER BY j) AS v, max(n) AS cnt FROM ("
            f"SELECT cid, j, {add}(x) AS s, count(*) AS n FROM ("
            f"SELECT a.cid, generate_subscripts(p.v, 1) AS j, unnest(p.v) AS x FROM {assigned} a JOIN {src} p ON p.id = a.id"
            f") GROUP BY cid, j) GROUP BY cid) m ON m.cid = c.cid"
        )
    cols = ", ".join(
        f"CASE WHEN count(p.id) > 0 THEN {add}(p.x{j}) / count(p.id) ELSE any_value(c.x{j}) END AS x{j}" for j in range(d)
    )
    return (
        f"SELECT c.cid, {cols} FROM {prev} c LEFT JOIN {assigned} a ON a.cid = c.cid "
        f"LEFT JOIN {src} p ON p.id = a.id GROUP BY c.cid"
    )


def lloyd_ctes(points_sql: str, d: int, k: int, iters: int, vector: bool = False, add: str = "sum") -> list[str]:
    """CTE list: p, c0, then a{t} (assignment against c{t-1}) and c{t} for t = 1..iters."""
    ctes = [f"p AS MATERIALIZED ({points_sql})", f"c0 AS MATERIALIZED ({seeds_sql(d, k, vector=vector)})"]
    for t in range(1, iters + 1):
        ctes.append(f"a{t} AS MATERIALIZED ({assign_sql(d, f'c{t - 1}', vector=vector)})")
        ctes.append(f"c{t} AS MATERIALIZED ({update_sql(d, f'c{t - 1}', f'a{t}', vector=vector, add=add)})")
    return ctes


def history_ctes(iters: int) -> list[str]:
    out = ["h1 AS (SELECT 1 AS iteration, count(*) AS n, count(*) AS changed FROM a1)"]
    for t in range(2, iters + 1):
        out.append(
            f"h{t} AS (SELECT {t} AS iteration, count(*) AS n, "
            f"sum(CASE WHEN b.cid IS DISTINCT FROM a.cid THEN 1 ELSE 0 END) AS changed "
            f"FROM a{t} a LEFT JOIN a{t - 1} b ON a.id = b.id)"
        )
    return out


def with_clause(ctes: list[str]) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def threshold_ctes(points_sql: str, d: int, k: int, max_iter: int, threshold: float) -> list[str]:
    """Lloyd with a change-fraction stop: centres freeze after the first pass with delta <= threshold."""
    ctes = [
        f"p AS MATERIALIZED ({points_sql})",
        f"c0 AS MATERIALIZED ({seeds_sql(d, k)})",
        "s0 AS (SELECT false AS stopped, 0 AS iters)",
    ]
    for t in range(1, max_iter + 1):
        ctes.append(f"a{t} AS MATERIALIZED ({assign_sql(d, f'c{t - 1}')})")
        if t == 1:
            ctes.append("d1 AS (SELECT 1.0::DOUBLE AS delta)")
        else:
            ctes.append(
                f"d{t} AS (SELECT sum(CASE WHEN b.cid IS DISTINCT FROM a.cid THEN 1 ELSE 0 END)::DOUBLE / count(*) AS delta "
                f"FROM a{t} a LEFT JOIN a{t - 1} b ON a.id = b.id)"
            )
        upd = update_sql(d, f"c{t - 1}", f"a{t}")
        cols = ", ".join(f"CASE WHEN s.stopped THEN o.x{j} ELSE u.x{j} END AS x{j}" for j in range(d))
        ctes.append(
            f"c{t} AS MATERIALIZED (SELECT o.cid, {cols} FROM c{t - 1} o JOIN ({upd}) u ON u.cid = o.cid CROSS JOIN s{t - 1} s)"
        )
        ctes.append(
            f"s{t} AS (SELECT s.stopped OR NOT (d.delta > {threshold!r}) AS stopped, "
            f"s.iters + CASE WHEN s.stopped THEN 0 ELSE 1 END AS iters FROM s{t - 1} s CROSS JOIN d{t} d)"
        )
    return ctes


# ---- text features in SQL -------------------------------------------------


def tf_long_sql(bracketed: bool = True, n: int = 1000) -> str:
    """(id, bucket, tf) of the hashed character bigrams of every document."""
    text = "'[' || coalesce(text, 'null') || ']'" if bracketed else "coalesce(text, 'null')"
    return (
        "SELECT id, b AS bucket, count(*)::DOUBLE AS tf FROM ("
        "SELECT id, unnest(CASE WHEN len(u) >= 2 THEN "
        f"list_transform(range(1, len(u)), lambda i: (31 * u[i] + u[i + 1]) % {n}) "
        f"WHEN len(u) = 1 THEN [u[1] % {n}] ELSE []::BIGINT[] END) AS b FROM ("
        f"SELECT doc_id AS id, list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT) AS u "
        "FROM documents)) GROUP BY id, b"
    )


def tf_dense_sql(bracketed: bool = True, n: int = 1000) -> str:
    """(id, v DOUBLE[n]) dense term-frequency vectors."""
    return (
        f"SELECT d.id, list(coalesce(t.tf, 0.0) ORDER BY r.range) AS v FROM "
        f"(SELECT doc_id AS id FROM documents) d CROSS JOIN range({n}) r "
        f"LEFT JOIN ({tf_long_sql(bracketed, n)}) t ON t.id = d.id AND t.bucket = r.range GROUP BY d.id"
    )
