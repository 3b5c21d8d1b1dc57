"""SQL generators for the iterative and step-wise operators (oracle side only)."""

from __future__ import annotations

Ctes = tuple[tuple[str, str], ...]
#: longest interval of the January anchors
TOP = 12


def pcg(name: str, system: str, lam: float, rounds: int, nodes: str = "cells", exact: str = "TRUE") -> Ctes:
    """Preconditioned conjugate gradients, ``rounds`` steps, all months at once.

    ``system`` has grid_id, month_idx, value, quality; needs CTEs sym and deg.
    """
    n = name
    ctes = [
        (f"{n}_m", f"SELECT month_idx, avg(value) AS m FROM {system} GROUP BY 1"),
        (
            f"{n}_s",
            f"""SELECT c.grid_id, m.month_idx, coalesce(s.quality, 0.0::DOUBLE) AS w, {lam}::DOUBLE * coalesce(deg, 0) AS ld, m.m AS x,
            coalesce(s.quality * (s.value - m.m), 0.0::DOUBLE) AS r FROM {nodes} c CROSS JOIN {n}_m m LEFT JOIN {system} s ON s.grid_id = c.grid_id AND s.month_idx = m.month_idx
            LEFT JOIN deg ON deg.grid_id = c.grid_id""",
        ),
        (f"{n}_0", f"SELECT *, r / greatest(w + ld, 1e-6) AS z, r / greatest(w + ld, 1e-6) AS p FROM {n}_s"),
    ]
    for k in range(rounds):
        ctes += [
            (
                f"{n}_q{k}",
                f"""SELECT t.*, (w + ld) * p - {lam}::DOUBLE * coalesce(a, 0) AS q FROM {n}_{k} t LEFT JOIN
                (SELECT src, month_idx, sum(weight * p) AS a FROM sym JOIN {n}_{k} ON dst = grid_id GROUP BY 1, 2) g ON g.src = t.grid_id AND g.month_idx = t.month_idx""",
            ),
            (f"{n}_a{k}", f"SELECT month_idx, sum(r * z) AS rz, sum(p * q) AS pq FROM {n}_q{k} GROUP BY 1"),
            (
                f"{n}_r{k}",
                f"""SELECT t.grid_id, t.month_idx, w, ld, x + coalesce(rz / nullif(pq, 0), 0) * p AS x, r - coalesce(rz / nullif(pq, 0), 0) * q AS r, p, rz
                FROM {n}_q{k} t JOIN {n}_a{k} USING (month_idx)""",
            ),
            (f"{n}_b{k}", f"SELECT month_idx, sum(r * r / greatest(w + ld, 1e-6)) AS rz2 FROM {n}_r{k} GROUP BY 1"),
            (
                f"{n}_{k + 1}",
                f"""SELECT grid_id, month_idx, w, ld, x, r, r / greatest(w + ld, 1e-6) AS z, r / greatest(w + ld, 1e-6) + coalesce(rz2 / nullif(rz, 0), 0) * p AS p
                FROM {n}_r{k} JOIN {n}_b{k} USING (month_idx)""",
            ),
        ]
    ctes.append(
        (
            n,
            f"""SELECT t.grid_id, t.month_idx, CASE WHEN s.grid_id IS NOT NULL AND {exact} THEN s.value ELSE x END AS value FROM {n}_{rounds} t
            LEFT JOIN {system} s ON s.grid_id = t.grid_id AND s.month_idx = t.month_idx""",
        )
    )
    return tuple(ctes)


def converged(name: str, system: str, lam: float, rounds: int = 150, nodes: str = "cells", exact: str = "TRUE") -> Ctes:
    """The same system, iterated until nothing changes any more (``rounds`` is far beyond that point)."""
    n, d = name, "greatest(w + ld, 1e-6)"
    start, scaled = pcg(name, system, lam, 0, nodes, exact)[:2], f"sum(r * r / {d}) OVER (PARTITION BY month_idx)"
    step = f"""RECURSIVE SELECT 0 AS k, grid_id, month_idx, w, ld, x, r, r / {d} AS p FROM {n}_s
    UNION SELECT k + 1, grid_id, month_idx, w, ld, x, r, r / {d} + coalesce({scaled} / nullif(rz, 0), 0) * p AS p FROM
    (SELECT k, grid_id, month_idx, w, ld, x + a * p AS x, r - a * q AS r, p, rz FROM
    (SELECT *, coalesce(rz / nullif(sum(p * q) OVER (PARTITION BY month_idx), 0), 0) AS a FROM
    (SELECT t.*, (w + ld) * p - {lam}::DOUBLE * coalesce(g.s, 0) AS q, sum(r * r / {d}) OVER (PARTITION BY t.month_idx) AS rz FROM {n}_i t LEFT JOIN
    (SELECT src, month_idx, sum(weight * p) AS s FROM sym JOIN {n}_i ON dst = grid_id GROUP BY 1, 2) g ON g.src = t.grid_id AND g.month_idx = t.month_idx))) WHERE k < {rounds}"""
    last = f"""SELECT t.grid_id, t.month_idx, CASE WHEN s.grid_id IS NOT NULL AND {exact} THEN s.value ELSE x END AS value FROM {n}_i t
    LEFT JOIN {system} s ON s.grid_id = t.grid_id AND s.month_idx = t.month_idx"""
    return (*start, (f"{n}_i", step), (n, last))


def assimilated(m: str, o: str, q: str, n: str, exact_min: int, alpha: float, scale: float) -> str:
    return f"""CASE WHEN {o} IS NULL THEN {m} WHEN {n} >= {exact_min} THEN {o} ELSE {m} +
    least(greatest((0.05 + 0.15 * least(greatest({q} / 5.0, 0), 1)) / (1 + abs({o} - {m}) / {scale}::DOUBLE), 0.02), {alpha}::DOUBLE) * ({o} - {m}) END"""


def last_step(gap: int) -> tuple[int, int]:
    """Steps of 6 come first, then of 3, then of 1."""
    h = 1 if gap % 3 else 3 if gap % 6 else 6
    return gap - h, h


def propagate(name: str, seg: str, drv: str, obs: str, exact_min: int, alpha: float, scale: float, top: int = TOP) -> Ctes:
    plan = ", ".join(["(0, NULL, NULL)"] + [f"({k}, {last_step(k)[0]}, {last_step(k)[1]})" for k in range(1, top + 1)])
    cols = ", ".join(
        [f"max(base) FILTER (k = {k}) AS b{k}, max(slope) FILTER (k = {k}) AS m{k}" for k in range(1, top + 1)]
        + [f"max(o.value) FILTER (k = {k}) AS o{k}, max(o.quality) FILTER (k = {k}) AS q{k}" for k in range(top + 1)]
    )
    ctes = [
        (
            f"{name}_i",
            f"""SELECT s.segment_id, s.grid_id, s.left_idx, s.right_idx, s.right_idx - s.left_idx AS gap, s.state AS s0, {cols}, max(o.n_months) AS n_months FROM {seg} s
            JOIN (VALUES {plan}) pl(k, prev, h) ON k <= s.right_idx - s.left_idx LEFT JOIN {drv} d ON d.grid_id = s.grid_id AND d.start_idx = s.left_idx + prev AND d.h = pl.h
            LEFT JOIN {obs} o ON o.grid_id = s.grid_id AND o.month_idx = s.left_idx + k GROUP BY s.segment_id, s.grid_id, s.left_idx, s.right_idx, s.state""",
        )
    ]
    src = f"{name}_i"
    for k in range(1, top + 1):
        prev, _ = last_step(k)
        inner = f"SELECT *, CASE WHEN gap >= {k} THEN s{prev} - (b{k} + m{k} * s{prev}) END AS mv FROM {src}"
        ctes.append((f"{name}_s{k}", f"SELECT * EXCLUDE (mv), {assimilated('mv', f'o{k}', f'q{k}', 'n_months', exact_min, alpha, scale)} AS s{k} FROM ({inner})"))
        src = f"{name}_s{k}"
    ctes.append((name, f"SELECT * FROM {src}"))
    return tuple(ctes)


def at_gap(p: str, top: int) -> str:
    return "CASE gap " + " ".join(f"WHEN {k} THEN {p}{k}" for k in range(1, top + 1)) + " END"


def state_rows(name: str, states: str, top: int = TOP) -> Ctes:
    return ((name, " UNION ALL ".join(f"SELECT segment_id, grid_id, gap, {k} AS k, s{k} AS state FROM {states} WHERE gap >= {k}" for k in range(top + 1))),)


def endpoints(name: str, states: str, anchors: str, counts: str, exact_min: int, alpha: float, scale: float, top: int = TOP) -> Ctes:
    return (
        (
            f"{name}_x",
            f"""SELECT p.*, a.value AS av, {at_gap('s', top)} AS end_state, {at_gap('o', top)} AS oo, {at_gap('q', top)} AS qq, coalesce(n_month, 0) AS nm FROM {states} p
            JOIN {anchors} a ON a.grid_id = p.grid_id AND a.month_idx = p.right_idx LEFT JOIN {counts} c ON c.month_idx = p.right_idx""",
        ),
        (f"{name}_y", f"SELECT *, {assimilated('av', 'oo', 'qq', 'n_months', exact_min, alpha, scale)} AS right_anchor, coalesce(oo IS NOT NULL AND n_months >= {exact_min}, FALSE) AS ex FROM {name}_x"),
        (
            f"{name}_z",
            f"""SELECT *, CASE WHEN ex THEN 1.0 ELSE least(greatest(least(greatest(nm / 100.0, 0.10), 0.80) / (1 + abs(right_anchor - end_state) / 3.0), 0.02), 1.0) END AS alpha FROM {name}_y""",
        ),
        (name, f"SELECT *, CASE WHEN ex THEN oo ELSE end_state + alpha * (right_anchor - end_state) END AS effective_anchor FROM {name}_z"),
    )


def corrected(name: str, ends: str, top: int = TOP) -> Ctes:
    parts = " UNION ALL ".join(
        f"""SELECT segment_id, grid_id, left_idx, right_idx, left_idx + {k} AS month_idx, coalesce(o{k}, s{k} + ({k}::DOUBLE / gap) * ({k}::DOUBLE / gap) * ({k}::DOUBLE / gap) * (effective_anchor - end_state)) AS value
        FROM {ends} WHERE gap >= {k}"""
        for k in range(top + 1)
    )
    return ((name, parts),)


def summary(name: str, ends: str) -> Ctes:
    return (
        (
            name,
            f"""SELECT segment_id, left_idx, right_idx, count(*) AS n, sqrt(avg(pow(end_state - right_anchor, 2))) AS rmse, avg(abs(end_state - right_anchor)) AS mae, avg(end_state - right_anchor) AS bias,
            quantile_cont(abs(right_anchor - end_state), 0.95) AS p95_abs_diff, avg(alpha) AS alpha_mean, quantile_cont(alpha, 0.05) AS alpha_p05, quantile_cont(alpha, 0.5) AS alpha_p50,
            quantile_cont(alpha, 0.95) AS alpha_p95 FROM {ends} GROUP BY ALL""",
        ),
    )


def local_anchors(name: str, panel: str, obs: str, alpha_min: float, alpha_max: float, gap_scale: float, edge_window: int, edge_alpha: float, single_alpha: float, single_scale: float) -> Ctes:
    last = "last_value({0} IGNORE NULLS) OVER (PARTITION BY grid_id ORDER BY month_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    first = "first_value({0} IGNORE NULLS) OVER (PARTITION BY grid_id ORDER BY month_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    t = "CASE WHEN o IS NOT NULL THEN month_idx END"
    return (
        (f"{name}_j", f"SELECT p.grid_id, p.month_idx, p.value AS x, b.value AS o, b.quality AS q FROM {panel} p LEFT JOIN {obs} b ON b.grid_id = p.grid_id AND b.month_idx = p.month_idx"),
        (
            f"{name}_w",
            f"""SELECT *, {last.format(t)} AS pt, {last.format('o')} AS pv, {last.format('q')} AS pq, {first.format(t)} AS nt, {first.format('o')} AS nv, {first.format('q')} AS nq,
            count(o) OVER (PARTITION BY grid_id) AS cnt, lag(x) OVER (PARTITION BY grid_id ORDER BY month_idx) AS xb, lead(x) OVER (PARTITION BY grid_id ORDER BY month_idx) AS xa FROM {name}_j""",
        ),
        (
            f"{name}_v",
            f"""SELECT *, least(greatest(({alpha_min}::DOUBLE + {alpha_max - alpha_min!r}::DOUBLE * least(greatest(0.5 * (pq + nq) / 5.0, 0), 1)) / (1 + greatest(nt - pt - 1, 0) / {gap_scale}::DOUBLE), 0.05), 0.95) AS ba,
            coalesce(pv, nv) AS near, abs(month_idx - coalesce(pt, nt)) AS dist, coalesce(CASE WHEN xb IS NULL THEN xa WHEN xa IS NULL THEN xb ELSE 0.5 * (xb + xa) END, x) AS around FROM {name}_w""",
        ),
        (
            name,
            f"""SELECT grid_id, month_idx, CASE WHEN cnt = 0 THEN 'none' WHEN cnt < 2 THEN CASE WHEN o IS NOT NULL THEN 'single_obs' ELSE 'none' END WHEN o IS NOT NULL THEN 'exact'
            WHEN pt IS NOT NULL AND nt IS NOT NULL THEN 'bridge' ELSE 'edge' END AS mode,
            CASE WHEN cnt = 0 THEN x WHEN cnt < 2 THEN CASE WHEN o IS NULL THEN x ELSE around +
              least(greatest((0.05 + 0.15 * least(greatest(q / 5.0, 0), 1)) / (1 + abs(o - around) / {single_scale}::DOUBLE), 0.02), {single_alpha}::DOUBLE) * (o - around) END
            WHEN o IS NOT NULL THEN o WHEN pt IS NOT NULL AND nt IS NOT NULL THEN (1 - ba) * x + ba * (pv + (nv - pv) * (month_idx - pt) / (nt - pt))
            WHEN dist <= {edge_window} THEN (1 - ta) * x + ta * near ELSE x END AS value FROM
            (SELECT *, least(greatest({edge_alpha}::DOUBLE * (1 - dist / {float(edge_window)}::DOUBLE), 0), {edge_alpha}::DOUBLE) AS ta FROM {name}_v)""",
        ),
    )


def priors(name: str, obs: str, anchor_cells: str, extrap: int, single: int, span_scale: float) -> Ctes:
    return (
        (f"{name}_st", f"SELECT grid_id, count(*) AS n_obs, stddev_pop(value) AS sd, avg(quality) AS aq FROM {obs} GROUP BY 1"),
        (
            f"{name}_b",
            f"""SELECT a.grid_id, a.month_idx, n_obs, p.month_idx AS pt, p.value AS pv, n.month_idx AS nt, n.value AS nv,
            least(greatest(0.35 + 0.55 * least(greatest(n_obs / 6.0, 0), 1) / (1 + CASE WHEN n_obs > 1 THEN sd ELSE 0 END / 5.0), 0.20), 0.90) AS mw,
            least(greatest(0.05 + 0.10 * least(greatest(aq / 5.0, 0), 1), 0.05), 0.20) AS sw FROM {anchor_cells} a JOIN {name}_st st ON st.grid_id = a.grid_id
            ASOF LEFT JOIN {obs} p ON p.grid_id = a.grid_id AND p.month_idx <= a.month_idx ASOF LEFT JOIN {obs} n ON n.grid_id = a.grid_id AND n.month_idx >= a.month_idx""",
        ),
        (
            f"{name}_c",
            f"""SELECT *, abs(month_idx - coalesce(pt, nt)) AS gp, CASE WHEN pt = month_idx THEN NULL WHEN n_obs >= 2 AND pt IS NULL AND nt - month_idx <= {extrap} THEN 'pre_nearest'
            WHEN n_obs >= 2 AND nt IS NULL AND month_idx - pt <= {extrap} THEN 'post_nearest' WHEN n_obs >= 2 AND pt IS NOT NULL AND nt IS NOT NULL THEN 'interpolate'
            WHEN n_obs < 2 AND abs(month_idx - coalesce(pt, nt)) <= {single} THEN 'single_near' END AS mode FROM {name}_b""",
        ),
        (
            name,
            f"""SELECT * FROM (SELECT grid_id, month_idx, n_obs, mode, CASE WHEN mode = 'interpolate' THEN pv + (month_idx - pt) / greatest(nt - pt, 1) * (nv - pv) ELSE coalesce(pv, nv) END AS prior_value,
            CASE mode WHEN 'interpolate' THEN mw / (1 + greatest(nt - pt, 1) / {span_scale}::DOUBLE) WHEN 'single_near' THEN sw * greatest(1 - gp / {single + 1.0}::DOUBLE, 0)
            ELSE mw * greatest(1 - gp / {extrap + 1.0}::DOUBLE, 0) * 0.7 END AS prior_weight FROM {name}_c WHERE mode IS NOT NULL) WHERE prior_weight > 0""",
        ),
    )


def eliminate(name: str, src: str, n: int) -> tuple[list[tuple[str, str]], str]:
    """Solve ``n`` x ``n`` systems held in columns a.., b.. for c..; the CTEs and the last one's name."""
    ctes = []
    for k in range(n - 1):
        f = ", ".join(f"a{i}{k} / CASE WHEN abs(a{k}{k}) > 1e-9 THEN a{k}{k} END AS f{i}" for i in range(k + 1, n))
        upd = ", ".join(
            [f"a{i}{j} - f{i} * a{k}{j} AS a{i}{j}" for i in range(k + 1, n) for j in range(k + 1, n)]
            + [f"b{i} - f{i} * b{k} AS b{i}" for i in range(k + 1, n)]
        )
        ctes.append((f"{name}_x{k}", f"SELECT * EXCLUDE ({', '.join(f'f{i}' for i in range(k + 1, n))}) REPLACE ({upd}) FROM (SELECT *, {f} FROM {src})"))
        src = f"{name}_x{k}"
    for i in reversed(range(n)):
        acc = f"b{i}" + "".join(f" - a{i}{j} * c{j}" for j in range(i + 1, n))
        ctes.append((f"{name}_c{i}", f"SELECT *, ({acc}) / CASE WHEN abs(a{i}{i}) > 1e-9 THEN a{i}{i} END AS c{i} FROM {src}"))
        src = f"{name}_c{i}"
    return ctes, src


def harmonic(name: str, obs: str, min_obs: int = 12) -> Ctes:
    """Normal equations of six terms, eliminated column by column."""
    a = "(month_idx * {0}::DOUBLE)".format(repr(2.0 * 3.141592653589793 / 12.0))
    basis = ["1.0::DOUBLE", "((month_idx - 42.0::DOUBLE) / 24.0::DOUBLE)", f"cos({a})", f"sin({a})", f"cos(2 * {a})", f"sin(2 * {a})"]
    n = len(basis)
    sums = ", ".join(
        [f"sum({basis[i]} * {basis[j]}) AS a{i}{j}" for i in range(n) for j in range(i, n)] + [f"sum({basis[i]} * value) AS b{i}" for i in range(n)]
    )
    ctes = [
        (f"{name}_u", f"SELECT grid_id, count(*) AS n_obs, {sums} FROM {obs} GROUP BY 1 HAVING count(*) >= {min_obs}"),
        (f"{name}_e0", f"SELECT *, {', '.join(f'a{j}{i} AS a{i}{j}' for i in range(n) for j in range(i))} FROM {name}_u"),
    ]
    solved, src = eliminate(name, f"{name}_e0", n)
    ctes += solved
    fit = " + ".join(f"c{i} * {b}" for i, b in enumerate(basis))
    ctes.append(
        (
            name,
            f"""SELECT grid_id, any_value(n_obs) AS n_obs, {', '.join(f'any_value(c{i}) AS c{i}' for i in range(n))}, greatest(0.0, 1 - sum(pow(value - ({fit}), 2)) / greatest(var_pop(value) * count(*), 1e-6)) AS r2
            FROM {obs} JOIN {src} USING (grid_id) GROUP BY 1""",
        )
    )
    ctes.append((f"{name}_fit", f"SELECT grid_id, month_idx, r2, {fit} AS value FROM {name}, calendar WHERE r2 >= 0.5"))
    return tuple(ctes)
