"""Named SQL blocks behind the oracle queries (same tables as ``Tables``)."""

from __future__ import annotations

MI = "CAST(12 * year({0}) + month({0}) - 23941 AS INTEGER)"

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "calendar": (
        (),
        """SELECT CAST(i AS INTEGER) AS month_idx, CAST(23941 + i AS INTEGER) AS month_ord,
        CAST((23940 + i) // 12 AS INTEGER) AS year, CAST((23940 + i) % 12 + 1 AS INTEGER) AS month,
        printf('%04d-%02d', (23940 + i) // 12, (23940 + i) % 12 + 1) AS month_label FROM range(84) t(i)""",
    ),
    "cells": (
        (),
        """SELECT c_custkey AS grid_id, CAST(c_custkey // 32 AS INTEGER) AS grid_row,
        CAST(c_custkey % 32 AS INTEGER) AS grid_col, (c_custkey // 32) * 100000 + c_custkey % 32 AS cell_id,
        (c_custkey % 32) * 1000.0::DOUBLE AS x, (c_custkey // 32) * 1000.0::DOUBLE AS y FROM customer""",
    ),
    "cells_small": (
        (),
        """SELECT s_suppkey AS grid_id, CAST(s_suppkey // 10 AS INTEGER) AS grid_row,
        CAST(s_suppkey % 10 AS INTEGER) AS grid_col, (s_suppkey // 10) * 100000 + s_suppkey % 10 AS cell_id,
        (s_suppkey % 10) * 1000.0::DOUBLE AS x, (s_suppkey // 10) * 1000.0::DOUBLE AS y FROM supplier""",
    ),
    "baseline": (
        (),
        """SELECT c_custkey AS grid_id, (c_custkey // 32) * 100000 + c_custkey % 32 AS cell_id,
        CAST(round(c_acctbal * 100) AS BIGINT) / 123456.7::DOUBLE AS base_wtd,
        CASE c_nationkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'linear' WHEN 2 THEN 'nearest' ELSE 'unknown' END
          AS fill_source, CAST(c_nationkey AS DOUBLE) AS n_points FROM customer""",
    ),
    "connectivity": (
        (),
        "SELECT c_custkey AS grid_id, NULLIF(CAST(c_nationkey % 7 - 3 AS INTEGER), 0) AS cls FROM customer",
    ),
    "obs": (
        (),
        f"""SELECT o_custkey AS grid_id, {MI.format('o_orderdate')} AS month_idx,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 9876543.21::DOUBLE AS wtd,
        CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS INTEGER) AS n_days,
        CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n_sites, CAST(count(*) AS INTEGER) AS n_site_days
        FROM orders GROUP BY 1, 2""",
    ),
    "panel": (
        (),
        f"""SELECT l_suppkey AS grid_id, {MI.format('l_shipdate')} AS month_idx,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 987654.321::DOUBLE AS wtd
        FROM lineitem GROUP BY 1, 2""",
    ),
    "dense_panel": (
        ("cells_small", "calendar", "panel"),
        """SELECT c.grid_id, m.month_idx, p.wtd FROM cells_small c CROSS JOIN calendar m
        LEFT JOIN panel p ON p.grid_id = c.grid_id AND p.month_idx = m.month_idx""",
    ),
    "forcing_sparse": (
        (),
        f"""SELECT o_custkey AS grid_id, {MI.format('l_shipdate')} AS month_idx,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 7.3::DOUBLE AS infiltration,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 12345678.9::DOUBLE AS pumping
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE {MI.format('l_shipdate')} BETWEEN 0 AND 83 GROUP BY 1, 2""",
    ),
    "forcing": (
        ("cells", "calendar", "forcing_sparse"),
        """SELECT c.grid_id, m.month_idx, coalesce(f.infiltration, 0.0::DOUBLE) AS infiltration,
        coalesce(f.pumping, 0.0::DOUBLE) AS pumping FROM cells c CROSS JOIN calendar m
        LEFT JOIN forcing_sparse f ON f.grid_id = c.grid_id AND f.month_idx = m.month_idx""",
    ),
    "daily": (
        (),
        """SELECT user_id AS grid_id, CAST(ts AS DATE) + 17 AS day,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 73.1::DOUBLE AS inches FROM events GROUP BY 1, 2""",
    ),
    "profile_layers": (
        (),
        """SELECT vec_id AS grid_id, CAST(i AS INTEGER) AS layer, 2.5::DOUBLE + 5.0::DOUBLE * i AS depth_m,
        CASE WHEN (vec_id + i) % 13 <> 0 THEN CAST(embedding[i + 1] AS DOUBLE) END AS value
        FROM embeddings, range(64) t(i)""",
    ),
    "pairs": (
        ("obs",),
        """SELECT s.grid_id, s.month_idx AS start_idx, t.month_idx AS target_idx, CAST(h AS INTEGER) AS h,
        s.wtd AS wtd_t, t.wtd AS wtd_target, -(t.wtd - s.wtd) AS delta_h, s.n_days AS n_days_t,
        t.n_days AS n_days_target, s.n_sites AS n_sites_t, t.n_sites AS n_sites_target,
        (s.grid_id * 1000 + s.month_idx) * 10 + h AS sample_key,
        CASE WHEN t.month_idx + 23941 <= 23988 THEN 'train' WHEN t.month_idx + 23941 <= 24000 THEN 'validation'
             WHEN t.month_idx + 23941 <= 24024 THEN 'test' END AS split
        FROM obs s JOIN (VALUES (1), (3), (6)) hz(h) ON TRUE
        JOIN obs t ON t.grid_id = s.grid_id AND t.month_idx = s.month_idx + h""",
    ),
    "predictions": (
        ("pairs",),
        """SELECT p.*, CAST(seed AS INTEGER) AS seed, delta_h AS y_true,
        delta_h * 0.8::DOUBLE + ((sample_key * 7919 + seed * 104729) % 1000 - 500) / 2531.7::DOUBLE AS y_pred
        FROM pairs p, (VALUES (11), (22), (33), (44), (55)) sd(seed)""",
    ),
    "ensemble": (
        ("predictions",),
        """SELECT sample_key, grid_id, start_idx, target_idx, h, split, y_true, avg(y_pred) AS ens_mean,
        coalesce(stddev_samp(y_pred), 0) AS ens_std, stddev_pop(y_pred) AS ens_std_pop, count(*) AS n_members
        FROM predictions GROUP BY ALL HAVING count(DISTINCT seed) = 5""",
    ),
}


def _ordered(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        deps, _ = BLOCKS[n]
        _ordered(list(deps), seen)
        if n not in seen:
            seen.append(n)
    return seen


def with_blocks(names: str, body: str, *extra: tuple[str, str]) -> str:
    """``WITH`` the named blocks (and dependencies), then extra CTEs, then body.

    A CTE that several groups of extras hold stands once; two under one name are an error.
    A query that begins with ``RECURSIVE`` refers to itself and keeps the last row of each (grid_id, month_idx), one that begins with ``RECURSIVE ALL`` every row.
    """
    ctes = {n: BLOCKS[n][1] for n in _ordered(names.split(), [])}
    for n, q in extra:
        if ctes.setdefault(n, q) != q:
            raise ValueError(f"two queries are called {n}")

    def cte(n: str, q: str) -> str:
        if q.startswith("RECURSIVE ALL"):
            return f"{n} AS ({q.removeprefix('RECURSIVE ALL')})"
        if q.startswith("RECURSIVE"):
            return f"{n} USING KEY (grid_id, month_idx) AS ({q.removeprefix('RECURSIVE')})"
        return f"{n} AS MATERIALIZED ({q})"

    parts = [cte(n, q) for n, q in ctes.items()]
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return head + body
