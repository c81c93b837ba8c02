"""SQL for DuckDB that gives the same rows as each registered query."""

from __future__ import annotations

_VIEWS = {
    "vox": "SELECT l_suppkey AS study_id, CAST(l_partkey % 16 AS INTEGER) AS i, CAST(l_orderkey % 16 AS INTEGER) AS j, CAST(l_linenumber - 1 AS INTEGER) AS k, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "vol": "SELECT s_suppkey AS study_id, CAST(2 + s_nationkey % 3 AS DOUBLE) AS sx, -CAST(s_suppkey % 5 AS DOUBLE) AS ox, (2 + s_nationkey % 3) * 4.0::DOUBLE * 4.0::DOUBLE / 1000.0::DOUBLE AS v, s_name AS name FROM supplier",
    "grid": "SELECT s_suppkey AS study_id, CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, CAST(c.k AS INTEGER) AS k FROM supplier, range(16) a(i), range(16) b(j), range(7) c(k)",
    "segs": "SELECT s_suppkey AS study_id, t.* FROM supplier, (VALUES ('liver', 1), ('tumor', 2), ('lungs', 3), ('edge', 4), ('ghost', 5)) t(segment_id, ord)",
    "sv": """SELECT study_id, 'liver' AS segment_id, i, j, k FROM grid WHERE i <= 9
        UNION ALL SELECT study_id, 'tumor', i, j, k FROM grid WHERE (i - 4 - study_id % 3) * (i - 4 - study_id % 3) + (j - 8) * (j - 8) + (k - 3) * (k - 3) <= 9
        UNION ALL SELECT study_id, 'lungs', i, j, k FROM grid WHERE i >= 11
        UNION ALL SELECT study_id, 'edge', i, j, k FROM grid WHERE i BETWEEN 8 AND 12""",
    "masked": "SELECT * FROM vox WHERE i <= 9 AND i >= 0 AND study_id IN (SELECT study_id FROM vol)",
    "sums": "SELECT s.study_id, s.ord, s.segment_id, count(p.i) AS n, coalesce(sum(x.value), 0.0::DOUBLE) AS total FROM segs s LEFT JOIN sv p USING (study_id, segment_id) LEFT JOIN vox x ON x.study_id = p.study_id AND x.i = p.i AND x.j = p.j AND x.k = p.k GROUP BY ALL",
    "msums": "SELECT s.study_id, s.ord, s.segment_id, count(p.i) AS n, coalesce(sum(x.value), 0.0::DOUBLE) AS total FROM segs s LEFT JOIN sv p USING (study_id, segment_id) LEFT JOIN masked x ON x.study_id = p.study_id AND x.i = p.i AND x.j = p.j AND x.k = p.k GROUP BY ALL",
    "fac": "SELECT vol.study_id, v, m.total AS liver_sum, 1000.0::DOUBLE * (1.0::DOUBLE - 10.0::DOUBLE / 100.0::DOUBLE) * 49.67::DOUBLE / nullif(v * 1.05::DOUBLE * m.total, 0) AS factor FROM vol JOIN msums m ON m.study_id = vol.study_id AND segment_id = 'liver'",
    "rel": "SELECT m.study_id, ord, segment_id, factor * (total / nullif(n, 0)::DOUBLE) AS dose, v * n AS vol_ml, v * n * (factor * (total / nullif(n, 0)::DOUBLE)) / 49.67::DOUBLE * 1.05::DOUBLE AS act FROM msums m JOIN fac USING (study_id)",
    "named": "SELECT *, CASE WHEN segment_id = 'edge' THEN 'tumor' ELSE segment_id END AS name FROM rel",
    "last": "SELECT study_id, min(ord) AS ord, name, arg_max(segment_id, ord) AS segment_id, arg_max(struct_pack(d := dose, w := vol_ml, a := act), ord) AS x FROM named GROUP BY study_id, name",
    "trel": "SELECT s_suppkey AS study_id, 0 AS ord, 'Estimated Lung Dose' AS name, 1000.0::DOUBLE * 10.0::DOUBLE * 0.01::DOUBLE * 49.67::DOUBLE / 1000.0::DOUBLE AS dose, NULL::DOUBLE AS vol_ml, NULL::DOUBLE AS act FROM supplier UNION ALL SELECT study_id, ord, name, x.d, x.w, x.a FROM last",
    "ep": "SELECT user_id AS study_id, (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / 3.6e9::DOUBLE * 0.2::DOUBLE AS hours FROM events GROUP BY user_id",
    "ef": "SELECT study_id, hours, pow(2.0::DOUBLE, hours / 64.2::DOUBLE) AS growth, pow(2.0::DOUBLE, hours / 64.2::DOUBLE) * 49.67::DOUBLE / (1.05::DOUBLE * 1e6::DOUBLE) AS factor FROM ep",
    "es": "SELECT user_id AS study_id, event_type AS name, sum(value::DECIMAL(18, 2))::DOUBLE * 1e6::DOUBLE AS total, count(*) AS n FROM events GROUP BY ALL",
    "eabs": "SELECT study_id, CAST(row_number() OVER (PARTITION BY study_id ORDER BY name) AS INTEGER) AS ord, name, factor * (total / n::DOUBLE) AS dose, 0.064::DOUBLE * n AS vol_ml, 0.064::DOUBLE * n * (factor * (total / n::DOUBLE)) / 49.67::DOUBLE * 1.05::DOUBLE AS act FROM es JOIN ef USING (study_id)",
    "et": "SELECT u.study_id, t * 0.064::DOUBLE / 1e6::DOUBLE AS total_mbq, t * 0.064::DOUBLE / 1e6::DOUBLE * growth AS decayed FROM (SELECT user_id AS study_id, sum(value::DECIMAL(18, 2))::DOUBLE * 1e6::DOUBLE AS t FROM events GROUP BY user_id) u JOIN ef USING (study_id)",
    "stats": "SELECT vol.study_id, 1792::BIGINT AS n_grid, v, 1792 * v AS total_ml, coalesce(sum(value), 0.0::DOUBLE) AS total, CASE WHEN count(value) < 1792 THEN greatest(coalesce(max(value), 0.0::DOUBLE), 0.0::DOUBLE) ELSE max(value) END AS most FROM vol LEFT JOIN vox USING (study_id) GROUP BY vol.study_id, v",
    "varied": "SELECT s_suppkey AS study_id, (s_suppkey % 120)::DOUBLE AS lsf, (s_suppkey % 7 * 2000)::DOUBLE AS act, CASE WHEN s_suppkey % 11 = 0 THEN 0.0::DOUBLE ELSE 1000.0::DOUBLE END AS mass FROM supplier",
    "turned": "SELECT study_id, study_id % 2 = 0 AS moved, sx, ox FROM vol",
    "target": "SELECT vol.study_id, CAST(a.i AS INTEGER) AS ti, CAST(b.j AS INTEGER) AS tj, CAST(c.k AS INTEGER) AS tk, CAST(floor((a.i * 3.0::DOUBLE - ox) / sx + 0.5) AS INTEGER) AS i, CAST(floor(b.j * 3.0::DOUBLE / 4.0 + 0.5) AS INTEGER) AS j, CAST(floor(c.k * 3.0::DOUBLE / 4.0 + 0.5) AS INTEGER) AS k FROM vol, range(12) a(i), range(20) b(j), range(8) c(k)",
    "bins": "SELECT study_id, i, j, k, CAST(least(floor(value / 25.0), 7) AS INTEGER) AS bin FROM vox",
}


def _mi(pairs: str) -> str:
    return f"""joint AS (SELECT study_id, cand, fbin, mbin, count(*)::DOUBLE AS n FROM ({pairs}) GROUP BY ALL),
        scored AS (SELECT study_id, cand, round(sum(n / t * ln(n * t / (nf * nm))), 6) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY study_id, cand) AS t, sum(n) OVER (PARTITION BY study_id, cand, fbin) AS nf,
        sum(n) OVER (PARTITION BY study_id, cand, mbin) AS nm FROM joint) GROUP BY study_id, cand)"""


_SELF = "SELECT f.study_id, f.cand, f.bin AS fbin, coalesce(m.bin, 0) AS mbin FROM (SELECT * FROM bins, (VALUES (0, 0), (1, -1), (2, 1)) c(cand, si)) f LEFT JOIN bins m ON m.study_id = f.study_id AND m.i = f.i + f.si AND m.j = f.j AND m.k = f.k"
_SEARCH = ", ".join(f"({3 * x + y}, {a}, {b})" for x, a in enumerate((0, -1, 1)) for y, b in enumerate((0, -1, 1)))
_MOVED = f"SELECT f.study_id, f.cand, f.bin AS fbin, coalesce(m.bin, 0) AS mbin FROM (SELECT * FROM bins, (VALUES {_SEARCH}) c(cand, si, sj)) f LEFT JOIN bins m ON m.study_id = f.study_id AND m.i + m.study_id % 3 - 1 = f.i + f.si AND m.j = f.j + f.sj AND m.k = f.k"


def _search(rounds: int = 3, share: float = 0.1, before: str = "", start: str = "") -> str:
    """The coarse-to-fine search from a start: each round's candidates, their pairs, their scores, and the best of them."""
    names, steps = ("tx", "ty", "tz", "rx", "ry", "rz", "g"), (4.0, 4.0, 4.0, 0.08, 0.08, 0.08, 0.1)
    turn = lambda t, u, v: (f"((1.0::DOUBLE - {t} * {t}) / (1.0::DOUBLE + {t} * {t}) * {u} - 2.0::DOUBLE * {t} / (1.0::DOUBLE + {t} * {t}) * {v})", f"(2.0::DOUBLE * {t} / (1.0::DOUBLE + {t} * {t}) * {u} + (1.0::DOUBLE - {t} * {t}) / (1.0::DOUBLE + {t} * {t}) * {v})")
    out = [
        "pts AS (SELECT v.study_id, least(floor(value / 25.0), 7)::INTEGER AS fbin, sx, ox, v.i * sx + ox - (7.5 * sx + ox) AS x0, v.j * 4.0::DOUBLE + 2.0::DOUBLE - 32.0::DOUBLE AS y0, v.k * 4.0::DOUBLE - 3.0::DOUBLE - 9.0::DOUBLE AS z0 FROM vox v JOIN vol USING (study_id) WHERE (v.i::BIGINT * 73856093 + v.j::BIGINT * 19349663 + v.k::BIGINT * 83492791 + v.study_id * 2654435761) % 1000000 < " + f"{int(share * 1_000_000)})",
        "best_0 AS (SELECT " + (f"*, {', '.join(f'0.0::DOUBLE AS {p}' for p in names[3:])} FROM ({start}))" if start else "study_id, " + ", ".join(f"0.0::DOUBLE AS {p}" for p in names) + " FROM vol)"),
    ]
    for r in range(rounds):
        signs = (0.0, 1.0, -1.0)
        rows = [[a * steps[0], b * steps[1], c * steps[2], 0.0, 0.0, 0.0, 0.0] for a in signs for b in signs for c in signs]
        rows += [[sign * steps[n] if m == n else 0.0 for m in range(7)] for n in range(3, 7) for sign in signs[1:]]
        rows = [[x / 2**r for x in row] for row in rows]
        values = ", ".join("(" + ", ".join([str(n), *(f"{v!r}::DOUBLE" for v in row)]) + ")" for n, row in enumerate(rows))
        y, z = turn("rx", "y0", "z0")
        out.append(f"tried_{r} AS (SELECT study_id, cand, {', '.join(f'b.{p} + c.{p} AS {p}' for p in names)} FROM best_{r} b, (VALUES {values}) c(cand, {', '.join(names)}))")
        out.append(f"a_{r} AS (SELECT *, {y} AS y1, {z} AS z1 FROM pts JOIN tried_{r} USING (study_id))")
        z, x = turn("ry", "z1", "x0")
        out.append(f"b_{r} AS (SELECT *, {z} AS z2, {x} AS x1 FROM a_{r})")
        x, y = turn("rz", "x1", "y1")
        grown = lambda v, c, t: f"({v} * (1.0::DOUBLE + g) + {c} + {t})"
        at = [f"floor((1.0::DOUBLE / sx) * {grown(x, '(7.5 * sx + ox)', 'tx')} + -((1.0::DOUBLE / sx) * ox) + 0.5::DOUBLE)", f"floor(0.25::DOUBLE * {grown(y, '32.0::DOUBLE', 'ty')} + -0.5::DOUBLE + 0.5::DOUBLE)", f"floor(0.25::DOUBLE * {grown('z2', '9.0::DOUBLE', 'tz')} + 0.75::DOUBLE + 0.5::DOUBLE)"]
        out.append(f"c_{r} AS (SELECT study_id, cand, fbin, {', '.join(f'{e}::INTEGER AS m{c}' for e, c in zip(at, 'ijk', strict=True))} FROM b_{r})")
        out.append(f"p_{r} AS (SELECT c.study_id, cand, fbin, coalesce(b.bin, 0) AS mbin FROM c_{r} c LEFT JOIN bins b ON b.study_id = c.study_id AND b.i + b.study_id % 3 - 1 = mi AND b.j = mj AND b.k = mk)")
        out.append(_mi(f"SELECT * FROM p_{r}").replace("joint", f"joint_{r}").replace("scored", f"scored_{r}"))
        out.append(f"win_{r} AS (SELECT study_id, arg_max(cand, mi * 1000000 * 100 - cand) AS cand, max(mi) AS mi FROM scored_{r} GROUP BY study_id)")
        out.append(f"best_{r + 1} AS (SELECT study_id, {', '.join(names)}, mi FROM tried_{r} JOIN win_{r} USING (study_id, cand))")
    out = [x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out]
    return "+" + before + ", ".join(out) + f" SELECT study_id, {', '.join(f'round({p}, 6) AS {p}' for p in names)}, mi FROM best_{rounds}"


def _candidates() -> str:
    """The best shift in voxels, and the search from there over all voxels."""
    first = f"{_mi(_MOVED)}, shift AS MATERIALIZED (SELECT study_id, arg_max(cand, mi * 1000000 * 100 - cand) AS cand, max(mi) AS mi FROM scored GROUP BY study_id), "
    start = f"SELECT vol.study_id, coalesce(sx * si, 0.0) AS tx, coalesce(4.0::DOUBLE * sj, 0.0) AS ty, 0.0::DOUBLE AS tz FROM vol LEFT JOIN shift USING (study_id) LEFT JOIN (VALUES {_SEARCH}) c(cand, si, sj) USING (cand)"
    searched = _search(share=1.0, before=first, start=start).split(" SELECT study_id, round(tx")[0]
    return f"{searched} SELECT s.study_id, s.cand, s.mi, {', '.join(f'round({p}, 6) AS {p}' for p in ('tx', 'ty', 'tz', 'rx', 'ry', 'rz', 'g'))}, b.mi AS fine_mi FROM shift s LEFT JOIN (SELECT * FROM best_3 QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY mi DESC, tx DESC, ty DESC, tz DESC, rx DESC, ry DESC, rz DESC, g DESC) = 1) b USING (study_id)"


def _sampled(f: int, share: float) -> str:
    """Sampled places of the level with blocks of f ** 3 places, with values."""
    ni, nj, nk = -(-16 // f), -(-16 // f), -(-7 // f)
    n = ni * nj * nk
    m = min(n, -int(-n * min(1.0, share * f**3) // 1))
    lo, hi = f"floor(s * {n}::DOUBLE / {m})::BIGINT", f"floor((s + 1) * {n}::DOUBLE / {m})::BIGINT"
    return f"""SELECT a.study_id, a.i, a.j, a.k, coalesce(value, 0.0::DOUBLE) AS value FROM (
        SELECT study_id, (place % {ni})::INTEGER AS i, (place // {ni} % {nj})::INTEGER AS j, (place // {ni * nj})::INTEGER AS k FROM (
        SELECT study_id, {lo} + ((s % 1000003) * 48271 + (study_id % 1000003) * 69621) % 2147483647 % ({hi} - {lo}) AS place FROM vol, range({m}) r(s))) a LEFT JOIN ({_blocks(f)}) b USING (study_id, i, j, k)"""


def _blocks(f: int) -> str:
    held = " * ".join(f"least({f}, {d} - {c} // {f} * {f})" for c, d in zip("ijk", (16, 16, 7), strict=True))
    return f"SELECT study_id, (i // {f})::INTEGER AS i, (j // {f})::INTEGER AS j, (k // {f})::INTEGER AS k, sum(value) / any_value({held}) AS value FROM vox SEMI JOIN vol USING (study_id) GROUP BY study_id, i // {f}, j // {f}, k // {f}"


def _rigid(levels: tuple[int, ...] = (2, 1), share: float = 0.1, first: float = 8.0, least: float = 2.0, rounds: int = 3) -> str:
    """The search of ``register_rigid``: 21 starts on the first level, then each level's rounds, one row a study between them."""
    P = range(6)
    ps, us = [f"p{n}" for n in P], [f"u{n}" for n in P]
    cols = ", ".join(ps)
    off = "CASE WHEN study_id % 2 = 0 THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END"
    mass = lambda o, w: f"sx * (({w} * 1.0::DOUBLE) / n) + ({o})"
    out = [
        f"geo AS (SELECT study_id, sx, ox, ox + ({off}) AS mx, 7.5 * sx + ox AS c0, 32.0::DOUBLE AS c1, 9.0::DOUBLE AS c2, ((sx * 15.5 + ox) - (sx * -0.5 + ox) + 64.0::DOUBLE + 28.0::DOUBLE) / 6 AS reach FROM vol)",
        "mass AS (SELECT study_id, sum(value) AS n, sum(value * i) AS si, sum(value * (i + study_id % 3 - 1)) AS mi, sum(value * j) AS sj, sum(value * k) AS sk FROM vox GROUP BY study_id HAVING sum(value) > 0)",
        f"shifts AS (SELECT study_id, 0 AS placement, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM geo UNION ALL SELECT study_id, 1, 7.5 * sx + mx - c0, 0.0, 0.0 FROM geo UNION ALL SELECT study_id, 2, CASE WHEN n IS NULL THEN 7.5 * sx + mx - c0 ELSE ({mass('mx', 'mi')}) - ({mass('ox', 'si')}) END, 0.0, 0.0 FROM geo LEFT JOIN mass USING (study_id))",
        "begun AS (SELECT study_id, placement * 7 + t.n AS start, 0 AS cand, x AS p0, y AS p1, z AS p2, t.a AS p3, t.b AS p4, t.c AS p5 FROM shifts, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.1, 0.0, 0.0), (2, -0.1, 0.0, 0.0), (3, 0.0, 0.1, 0.0), (4, 0.0, -0.1, 0.0), (5, 0.0, 0.0, 0.1), (6, 0.0, 0.0, -0.1)) t(n, a, b, c))",
    ]

    def scored(name: str, tried: str, f: int) -> None:
        """Scores of (study_id, start, cand, p0 to p5) on one level."""
        one = "1.0::DOUBLE"
        sincos = ", ".join(f"({one} - p{n + 3} * p{n + 3}) / ({one} + p{n + 3} * p{n + 3}) AS k{n + 1}, 2.0::DOUBLE * p{n + 3} / ({one} + p{n + 3} * p{n + 3}) AS s{n + 1}" for n in range(3))
        r = ["k3 * k2", "k3 * s2 * s1 - s3 * k1", "k3 * s2 * k1 + s3 * s1", "s3 * k2", "s3 * s2 * s1 + k3 * k1", "s3 * s2 * k1 - k3 * s1", "-s2", "k2 * s1", "k2 * k1"]
        out.append(f"{name}_r AS (SELECT t.*, sx, ox, mx, c0, c1, c2, {sincos} FROM {tried} t JOIN geo USING (study_id))")
        out.append(f"{name}_a AS (SELECT *, {', '.join(f'{x} AS a{n}' for n, x in enumerate(r))} FROM {name}_r)")
        out.append(f"{name}_b AS (SELECT *, {', '.join(f'c{n} + p{n} - (a{3 * n} * c0 + a{3 * n + 1} * c1 + a{3 * n + 2} * c2) AS b{n}' for n in range(3))} FROM {name}_a)")
        # places of the moving level's grid from space, then of the fixed level's grid into space
        back = [(f"(1.0::DOUBLE / (sx * {f}))", f"(mx + sx * {(f - 1) / 2}::DOUBLE)"), (f"{1 / (4 * f)!r}::DOUBLE", f"{2.0 + 2.0 * (f - 1)!r}::DOUBLE"), (f"{1 / (4 * f)!r}::DOUBLE", f"{-3.0 + 2.0 * (f - 1)!r}::DOUBLE")]
        rows = []
        for n, (g, o) in enumerate(back):
            x = [f"({g} * a{3 * n + c})" for c in range(3)] + [f"({g} * b{n} + -({g} * {o}))"]
            rows += [f"{x[0]} * (sx * {f})", f"{x[1]} * {4.0 * f!r}::DOUBLE", f"{x[2]} * {4.0 * f!r}::DOUBLE", f"{x[0]} * (ox + sx * {(f - 1) / 2}::DOUBLE) + {x[1]} * {2.0 + 2.0 * (f - 1)!r}::DOUBLE + {x[2]} * {-3.0 + 2.0 * (f - 1)!r}::DOUBLE + {x[3]}"]
        out.append(f"{name}_m AS (SELECT study_id, start, cand, {', '.join(f'{x} AS m{n}' for n, x in enumerate(rows))} FROM {name}_b)")
        at = [f"floor(m{4 * n} * i + m{4 * n + 1} * j + m{4 * n + 2} * k + m{4 * n + 3} + 0.5)::INTEGER AS {c}" for n, c in enumerate("ijk")]
        out.append(f"{name}_at AS (SELECT study_id, start * 100 + cand AS cand, fbin, {', '.join(at)} FROM points_{f} JOIN {name}_m USING (study_id))")
        out.append(_mi(f"SELECT a.study_id, a.cand, a.fbin, least(floor(coalesce(value, 0.0) / 25.0), 7)::INTEGER AS mbin FROM {name}_at a LEFT JOIN moving_{f} v USING (study_id, i, j, k)").replace("joint", f"{name}_joint").replace("scored", f"{name}_scored"))

    state = ""
    for f in levels:
        mixed = "(i::BIGINT * 7919 + j::BIGINT * 104729 + k::BIGINT * 1299709 + study_id % 1000003 * 15485863)"
        moved = ", ".join(f"{c} + ({mixed} * {m} % 1009 - 504) / 1009.0::DOUBLE + ({mixed} * {m + 90} % 997 - 498) / 997.0::DOUBLE AS {c}" for c, m in zip("ijk", (1, 331, 659), strict=True))
        out.append(f"points_{f} AS (SELECT study_id, {moved}, least(floor(value / 25.0), 7)::INTEGER AS fbin FROM ({_sampled(f, share)}))")
        out.append(f"moving_{f} AS (" + _blocks(f).replace("FROM vox", "FROM (SELECT study_id, (i + study_id % 3 - 1)::INTEGER AS i, j, k, value FROM vox WHERE i + study_id % 3 - 1 BETWEEN 0 AND 15) vox").replace("i // ", "floor(i / ").replace(f"floor(i / {f}", f"floor(i / {f}.0)") + ")")
        if not state:
            scored("s", "begun", f)
            out.append("ranked AS (SELECT study_id, cand // 100 AS start, mi, row_number() OVER (PARTITION BY study_id ORDER BY mi DESC, cand) AS n FROM s_scored)")
            unit = ", ".join([f"1.0::DOUBLE AS u{n}" for n in range(3)] + [f"0.5 / reach AS u{n}" for n in range(3, 6)])
            out.append(f"state_0 AS (SELECT study_id, start, {cols}, {first}::DOUBLE AS step, {', '.join(f'0.0::DOUBLE AS w{n}' for n in P)}, {unit}, mi FROM begun JOIN ranked USING (study_id, start) JOIN geo USING (study_id) WHERE n = 1)")
            state = "state_0"
        else:
            out.append(f"state_{f}_again AS (SELECT * REPLACE (step * 2 AS step, {', '.join(f'0.0::DOUBLE AS w{n}' for n in P)}) FROM {state})")
            state = f"state_{f}_again"
        for r in range(rounds):
            name = f"l{f}r{r}"
            rows = [[0] * 6] + [[sign * (m == k) for m in P] for k in P for sign in (1, -1)]
            moves = ", ".join("(" + ", ".join([str(n), *(f"{float(v)!r}::DOUBLE" for v in row)]) + ")" for n, row in enumerate(rows))
            live = f"(SELECT * FROM {state} WHERE step >= {least * f!r})"
            d = ", ".join(f"d{n}" for n in P)
            out.append(f"{name}_d AS (SELECT s.*, cand, {d} FROM {live} s, (VALUES {moves}) v(cand, {d}) UNION ALL SELECT s.*, 13, {', '.join(f'w{n}' for n in P)} FROM {live} s)")
            out.append(f"{name}_tried AS (SELECT study_id, start, cand, {', '.join(f'p{n} + d{n} * u{n} * step AS p{n}' for n in P)} FROM {name}_d)")
            scored(name, f"{name}_tried", f)
            out.append(f"{name}_of AS (SELECT study_id, list(mi ORDER BY cand) AS of, arg_max(cand % 100, mi * 1000000 * 100 - cand % 100) AS best, max(mi) AS top FROM {name}_scored GROUP BY study_id)")
            pull = ", ".join(f"CASE WHEN of[{2 * n + 2}] > of[1] AND of[{2 * n + 2}] >= of[{2 * n + 3}] THEN 1.0::DOUBLE WHEN of[{2 * n + 3}] > of[1] THEN -1.0 ELSE 0.0 END AS w{n}" for n in P)
            went = ", ".join(f"t.p{n}" for n in P)
            out.append(f"{name}_next AS (SELECT s.study_id, s.start, {went}, CASE WHEN best = 0 THEN step / 2 ELSE step END AS step, {pull}, {', '.join(us)}, top AS mi FROM {state} s JOIN {name}_of o USING (study_id) JOIN {name}_tried t ON t.study_id = s.study_id AND t.cand = o.best UNION ALL SELECT study_id, start, {cols}, step, {', '.join(f'w{n}' for n in P)}, {', '.join(us)}, mi FROM {state} WHERE step < {least * f!r})")
            state = f"{name}_next"
    out.append(f"ent AS (SELECT study_id, sum(-q * ln(q)) AS h FROM (SELECT study_id, count(*) / sum(count(*)) OVER (PARTITION BY study_id) AS q FROM points_{levels[-1]} GROUP BY study_id, fbin) GROUP BY study_id)")
    out.append(f"done AS (SELECT study_id, {cols}, mi, coalesce(mi / nullif(h, 0), 0.0) AS fit FROM {state} JOIN ent USING (study_id))")
    return "+" + ", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out)


_RIGID = _rigid()
_HARDENED = f"""{_RIGID},
    back AS (SELECT study_id, fit, c0, c1, c2, 7.5 * sx + mx AS m0, 7.5 * sx + mx - (c0 + p0) AS x, 32.0 - (c1 + p1) AS y, 9.0 - (c2 + p2) AS z, {', '.join(f'(1 - p{n + 3} * p{n + 3}) / (1 + p{n + 3} * p{n + 3}) AS k{n + 1}, 2 * p{n + 3} / (1 + p{n + 3} * p{n + 3}) AS s{n + 1}' for n in range(3))} FROM done JOIN geo USING (study_id)),
    hard AS (SELECT *, k3 * k2 * x + s3 * k2 * y - s2 * z + c0 AS hx, (k3 * s2 * s1 - s3 * k1) * x + (s3 * s2 * s1 + k3 * k1) * y + k2 * s1 * z + c1 AS hy, (k3 * s2 * k1 + s3 * s1) * x + (s3 * s2 * k1 - k3 * s1) * y + k2 * k1 * z + c2 AS hz FROM back)
    SELECT geo.study_id, v AS volume_id, round(CASE WHEN fit >= 0.3 THEN hx ELSE 7.5 * geo.sx + geo.mx END, 6) AS x, round(CASE WHEN fit >= 0.3 THEN hy ELSE 32.0 END, 6) AS y, round(CASE WHEN fit >= 0.3 THEN hz ELSE 9.0 END, 6) AS z FROM geo LEFT JOIN hard USING (study_id), (VALUES ('ct'), ('nm')) t(v)"""


_TABLE = "SELECT study_id, ord, name, round(dose, 6) AS dose_gy, round(vol_ml, 6) AS volume_ml, round(act, 6) AS activity_mbq FROM"
_CENTER = "CASE WHEN moved THEN {a} ELSE {b} END"
_XYZ = {
    "x": "(CASE WHEN moved THEN 5.0 - (7.5 * 4.0 + 2.0) ELSE 7.5 * sx + ox END)",
    "y": "(CASE WHEN moved THEN 1.5 * (7.5 * sx + ox) - 2.0 ELSE 7.5 * 4.0 + 2.0 END)",
    "z": "(CASE WHEN moved THEN 3.0 * 4.0 - 3.0 + 7.0 ELSE 3.0 * 4.0 - 3.0 END)",
}
_WEIGHT = "CASE {s} WHEN 0 THEN (1 - {u}) * (1 - {u}) * (1 - {u}) / 6 WHEN 1 THEN (3 * {u} * {u} * {u} - 6 * {u} * {u} + 4) / 6 WHEN 2 THEN (-3 * {u} * {u} * {u} + 3 * {u} * {u} + 3 * {u} + 1) / 6 ELSE {u} * {u} * {u} / 6 END"
_AXES = ", ".join(f"CAST(floor(({a} * 4.0::DOUBLE + 8.0) / 16.0) AS INTEGER) AS n{a}, ({a} * 4.0::DOUBLE + 8.0) / 16.0 - floor(({a} * 4.0::DOUBLE + 8.0) / 16.0) AS u{a}" for a in "ijk")
_CODE = r"chr(92) || 'line' || chr(10)"


def _report(title: str, rows: str, heads: str, lines: str, compat: bool = False) -> str:
    feed = "chr(92) || 'line' || chr(92) || 'n '" if compat else _CODE
    part = lambda c, label, unit: f"CASE WHEN {c} IS NULL THEN NULL ELSE '{label} = ' || printf('%.2f', {c}) || ' {unit}' END"
    line = f"'Segment: ' || name || ', ' || concat_ws(', ', {part('dose', 'Dose', 'Gy')}, {part('vol_ml', 'Volume', 'mL')}, {part('act', 'Activity', 'MBq')}) || {feed}"
    return f"""SELECT h.study_id, '{{' || chr(92) || 'rtf1' || chr(92) || 'ansi' || chr(92) || 'deff0' || chr(10) || '{{' || chr(92) || 'b {title}}}' || {_CODE} || 'Generated: 2024-01-01 00:00:00' || {_CODE} || {_CODE} || '{{' || chr(92) || 'b Parameters}}' || {_CODE} || {lines} || {_CODE}
        || '{{' || chr(92) || 'b Segment Doses}}' || {_CODE} || coalesce(l.lines, '') || {feed} || 'End of Report}}' AS report FROM {heads} h LEFT JOIN (SELECT study_id, string_agg({line}, '' ORDER BY ord) AS lines FROM {rows} GROUP BY study_id) l USING (study_id)"""


def _with(body: str) -> str:
    """The views that a query needs, as common table expressions."""
    used: list[str] = []

    def need(sql: str) -> None:
        import re

        for name, view in _VIEWS.items():
            if name not in used and re.search(rf"\b{name}\b", sql):
                need(view)
                if name not in used:
                    used.append(name)

    need(body)
    head = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in used)
    if body.startswith("+"):
        return f"WITH {head}, {body[1:]}"
    return f"WITH {head} {body}" if head else body


_L = lambda label, x, unit: f"'{label}: ' || printf('%.2f', {x}) || '{unit}' || {_CODE}"

_LINES_REL = " || ".join([_L("Activity", "1000.0", " MBq"), _L("Lung Shunt", "10.0", "%"), _L("Conversion Factor", "49.67", " Gy/MBq/g"), _L("Lung Mass", "1000.0", " g"), _L("Liver Density", "1.05", " g/mL")])
#: Voxels of the whole grid with the place that a B-spline's displacement sends them to.
_BENT = f"""SELECT q.study_id, q.i, q.j, q.k, floor((q.i * sx + ox + sum(coalesce(w * c.value / 64, 0)) - ox) / sx + 0.5)::INTEGER AS mi, floor((q.j * 4 + 2 + sum(coalesce(w * c.value / 128, 0)) - 2) / 4 + 0.5)::INTEGER AS mj, floor((q.k * 4 - 3 + sum(coalesce(-w * c.value / 64, 0)) + 3) / 4 + 0.5)::INTEGER AS mk FROM (
        SELECT p.study_id, p.i, p.j, p.k, sx, ox, ni + s % 4 - 1 AS ci, nj + s // 4 % 4 - 1 AS cj, nk + s // 16 - 1 AS ck, ({_WEIGHT.format(s="s % 4", u="ui")}) * ({_WEIGHT.format(s="s // 4 % 4", u="uj")}) * ({_WEIGHT.format(s="s // 16", u="uk")}) AS w
        FROM (SELECT *, floor(x)::INTEGER AS ni, x - floor(x) AS ui, floor(y)::INTEGER AS nj, y - floor(y) AS uj, floor(z)::INTEGER AS nk, z - floor(z) AS uk FROM (SELECT grid.*, sx, ox, (i * sx + ox + 8.0) / 16.0 AS x, (j * 4.0::DOUBLE + 2.0 + 8.0) / 16.0 AS y, (k * 4.0::DOUBLE - 3.0 + 8.0) / 16.0 AS z FROM grid JOIN vol USING (study_id))) p, range(64) r(s)) q
        LEFT JOIN (SELECT study_id AS cs, i AS pi, j AS pj, k AS pk, value FROM vox WHERE i < 6 AND j < 7) c ON cs = study_id AND pi = ci AND pj = cj AND pk = ck GROUP BY q.study_id, q.i, q.j, q.k, sx, ox"""
_HARD = f"SELECT b.study_id, b.i, b.j, b.k, v.value FROM ({_BENT}) b JOIN vox v ON v.study_id = b.study_id AND v.i = mi AND v.j = mj AND v.k = mk WHERE v.value <> 0"
_FIRST = "CAST(greatest(ceil(7.5 - 10.0::DOUBLE / sx - 1e-9), 0) AS INTEGER)"
_LAST = "CAST(least(floor(7.5 + 10.0::DOUBLE / sx + 1e-9), 15) AS INTEGER)"
_ABSENT = "study_id % 2 <> 0", "study_id % 3 = 0", "study_id % 3 = 0", "study_id % 5 = 0", "study_id % 7 = 0"

_SQL = {
    "voxels_from_bricks": "SELECT label::BIGINT AS study_id, CAST(vec_id * 4 + (p - 1) % 4 AS INTEGER) AS i, CAST((p - 1) // 4 % 4 AS INTEGER) AS j, CAST((p - 1) // 16 AS INTEGER) AS k, round(e::DOUBLE, 6) AS value FROM (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings)",
    "bricks_from_voxels": """SELECT study_id, bi, bj, bk, string_agg(CAST(CAST(coalesce(value, 0) AS INTEGER) AS VARCHAR), ',' ORDER BY p) AS "values" FROM (SELECT b.*, r.p, x.value FROM (SELECT DISTINCT study_id, i // 4 AS bi, j // 4 AS bj, k // 4 AS bk FROM vox) b, range(64) r(p)
        LEFT JOIN vox x ON x.study_id = b.study_id AND x.i = bi * 4 + p % 4 AND x.j = bj * 4 + p // 4 % 4 AND x.k = bk * 4 + p // 16) GROUP BY study_id, bi, bj, bk""",
    "verify_manifest": "SELECT printf('study_%06d.nrrd', study_id) AS file_name, CASE study_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'checksum differs' ELSE 'missing' END AS status FROM (SELECT DISTINCT study_id FROM vox)",
    "ingest_nrrd": "SELECT study_id, i, j, k, value, 'ok' AS status FROM vox WHERE value <> 0",
    "ingest_split": "SELECT study_id, i, j, k, value, 'ok' AS status FROM vox WHERE value <> 0",
    "ingest_volumes": "SELECT study_id, 16::INTEGER AS ni, 16::INTEGER AS nj, 7::INTEGER AS nk, sx AS si, 4.0::DOUBLE AS sj, 4.0::DOUBLE AS sk, ox AS ox, 2.0::DOUBLE AS oy, -3.0::DOUBLE AS oz, 1::INTEGER AS layers, 'ok' AS status FROM vol WHERE study_id IN (SELECT study_id FROM vox)",
    "ingest_segments": "SELECT study_id, segment_id, segment_id AS name, CAST(ord AS INTEGER) AS ord, CAST(ord AS INTEGER) AS label_value, CASE segment_id WHEN 'tumor' THEN 1 WHEN 'edge' THEN 2 ELSE 0 END AS layer, 'ok' AS status FROM segs",
    "ingest_segment_voxels": "SELECT study_id, segment_id, count(*) AS n, sum(i)::BIGINT AS si, sum(j)::BIGINT AS sj, sum(k)::BIGINT AS sk FROM sv GROUP BY study_id, segment_id",
    "derive_volume": "SELECT study_id, 'dose' AS volume_id, 'Dose Map (Gy)' AS name, sx, '1' AS dose_volume FROM vol",
    "voxel_volume": "SELECT study_id, round(v, 6) AS v_ml FROM stats",
    "total_volume": "SELECT study_id, round(total_ml, 6) AS total_ml FROM stats",
    "volume_center": "SELECT study_id, round(7.5 * sx + ox, 6) AS x, 32.0::DOUBLE AS y, 9.0::DOUBLE AS z FROM vol",
    "default_roi": "SELECT study_id, round(7.5 * sx + ox, 6) AS x, 32.0::DOUBLE AS y, 9.0::DOUBLE AS z, 400.0::DOUBLE AS sx, 300.0::DOUBLE AS sy, 250.0::DOUBLE AS sz FROM vol",
    "crop_roi": f"SELECT x.study_id, x.i - {_FIRST} AS i, x.j - 4 AS j, x.k - 1 AS k, value FROM vox x JOIN vol USING (study_id) WHERE abs(i * sx + ox - (7.5 * sx + ox)) <= 10 AND abs(j * 4 + 2 - 32) <= 15 AND abs(k * 4 - 3 - 9) <= 8",
    "crop_volume": f"SELECT study_id, {_LAST} - {_FIRST} + 1 AS ni, 8::INTEGER AS nj, 5::INTEGER AS nk, round(sx * {_FIRST} + ox, 6) AS x, 18.0::DOUBLE AS y, 1.0::DOUBLE AS z FROM vol",
    "segment_list": "SELECT study_id, ord, segment_id, segment_id AS name FROM segs",
    "mask_volume": "SELECT * FROM masked",
    "rasterize_segment": "SELECT study_id, segment_id, count(*) AS n, sum(ti)::BIGINT AS si, sum(tj)::BIGINT AS sj, sum(tk)::BIGINT AS sk FROM target JOIN sv USING (study_id, i, j, k) GROUP BY study_id, segment_id",
    "threshold_volume": "SELECT study_id, i, j, k, CASE WHEN value >= 40 THEN value ELSE 0 END AS value FROM vox",
    "threshold_volume_inverted": "SELECT study_id, i, j, k, CASE WHEN value <= 40 THEN value ELSE 0 END AS value FROM vox",
    "segment_counts": "SELECT study_id, segment_id, n, total FROM sums",
    "lsf_percent": "SELECT study_id, a.total AS liver_counts, b.total AS lung_counts, round(b.total / nullif(b.total + a.total, 0) * 100, 6) AS lsf_percent FROM sums a JOIN sums b USING (study_id) WHERE a.segment_id = 'liver' AND b.segment_id = 'lungs'",
    "grid_mean": "SELECT study_id, round(total / n_grid::DOUBLE, 6) AS mean FROM stats",
    "max_dose": "SELECT study_id, round(most, 6) AS max FROM stats",
    "segment_stats_rel": f"SELECT study_id, ord, segment_id AS name, round(dose, 6) AS dose_gy, round(vol_ml, 6) AS volume_ml, round(act, 6) AS activity_mbq FROM rel",
    "segment_stats_abs": f"{_TABLE} eabs",
    "isotope_factor": "SELECT s_suppkey AS study_id, CASE s_suppkey % 3 WHEN 0 THEN 'Y-90' WHEN 1 THEN 'Ho-166' ELSE 'other' END AS isotope, CASE s_suppkey % 3 WHEN 0 THEN 49.67::DOUBLE WHEN 1 THEN 14.85::DOUBLE END AS conv_factor, CASE s_suppkey % 3 WHEN 0 THEN 64.2::DOUBLE END AS half_life_h FROM supplier",
    "shunt_corrected_activity": "SELECT study_id, round(act * (1.0::DOUBLE - lsf / 100.0::DOUBLE), 6) AS activity_mbq FROM varied",
    "rescale_factor": "SELECT vol.study_id, round(d, 6) AS mean_dose_gy, round(d / nullif(coalesce(m.total, 0) / 1792.0::DOUBLE, 0), 6) AS factor FROM (SELECT *, 1000.0::DOUBLE * (1.0::DOUBLE - 10.0::DOUBLE / 100.0::DOUBLE) / (1792 * v * 1.05::DOUBLE) * 49.67::DOUBLE AS d FROM vol) vol LEFT JOIN msums m ON m.study_id = vol.study_id AND m.segment_id = 'liver'",
    "dose_map_relative": "SELECT study_id, i, j, k, round(value * factor, 6) AS dose FROM masked JOIN fac USING (study_id)",
    "dose_map_absolute": "SELECT user_id AS study_id, event_id AS i, round(value * 1e6::DOUBLE * factor, 6) AS dose FROM events JOIN ef ON study_id = user_id",
    "total_activity": "SELECT study_id, round(total_mbq, 6) AS total_mbq FROM et",
    "decay_corrected_activity": "SELECT study_id, round(decayed, 6) AS decay_corrected_mbq FROM et",
    "lung_dose": "SELECT study_id, round(act * lsf * 0.01::DOUBLE * 49.67::DOUBLE / nullif(mass, 0), 6) AS lung_dose_gy FROM varied",
    "activity_for_target": """SELECT study_id, round(d, 6) AS dose_at_1000_gy, round(a, 6) AS activity_mbq, round(least(a, 10000.0), 6) AS activity_reported_mbq, CASE WHEN a IS NOT NULL THEN 'ok' WHEN coalesce(liver_sum, 0) = 0 THEN 'zero_signal' ELSE 'no_target_dose' END AS status
        FROM (SELECT *, CASE WHEN study_id % 4 > 0 THEN (study_id % 4 * 5000)::DOUBLE / nullif(d, 0) * 1000.0::DOUBLE ELSE 1000.0::DOUBLE END AS a FROM (SELECT f.study_id, liver_sum, factor * (total / nullif(n, 0)::DOUBLE) AS d FROM fac f JOIN msums m ON m.study_id = f.study_id AND segment_id = 'tumor'))""",
    "segment_dedup": "SELECT study_id, ord, name, segment_id, round(x.d, 6) AS dose_gy, round(x.w, 6) AS volume_ml, round(x.a, 6) AS activity_mbq FROM last",
    "dose_table_relative": f"{_TABLE} trel",
    "dose_table_absolute": f"{_TABLE} eabs",
    "format_counts": "SELECT study_id, printf('%.2f', a.total) AS liver, printf('%.2f', b.total) AS lung, printf('%.2f', b.total / nullif(b.total + a.total, 0) * 100) || '%' AS lsf FROM sums a JOIN sums b USING (study_id) WHERE a.segment_id = 'liver' AND b.segment_id = 'lungs'",
    "report_relative": _report("Patient Relative Quantification", "trel", "vol", _LINES_REL),
    "report_relative_compat": _report("Patient Relative Quantification", "trel", "vol", _LINES_REL, compat=True),
    "report_absolute": _report("Absolute Quantification", "eabs", "et", " || ".join([_L("Activity During Imaging", "h.total_mbq", " MBq"), _L("Decay Corrected Activity", "h.decayed", " MBq"), _L("Conversion Factor", "49.67", " Gy/MBq/g"), _L("Liver Density", "1.05", " g/mL")])),
    "report_files": f"SELECT replace(vol.name, '#', '-') || '.rtf' AS path, sha256(report) AS sha256 FROM ({_report('Patient Relative Quantification', 'trel', 'vol', _LINES_REL)}) r JOIN vol USING (study_id)",
    "report_path": "SELECT study_id, name || CASE WHEN study_id % 2 = 0 THEN '.RTF' ELSE '.rtf' END AS path FROM vol",
    "missing_inputs": "SELECT s_suppkey AS study_id, concat_ws(', ', CASE WHEN s_suppkey % 2 <> 0 THEN 'Input SPECT/PET Volume' END, CASE WHEN s_suppkey % 3 = 0 THEN 'Segmentation' END, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 7 = 0 THEN 'Whole Liver Segment' END, CASE WHEN s_suppkey % 5 = 0 THEN 'Output Volume' END) AS missing FROM supplier",
    "missing_inputs_absolute": f"SELECT study_id, concat_ws(chr(10), CASE WHEN {_ABSENT[0]} THEN 'Input PET Volume' END, CASE WHEN {_ABSENT[1]} THEN 'Segmentation' END, CASE WHEN {_ABSENT[3]} THEN 'Output Volume' END) AS missing FROM vol",
    "mode_messages": f"""SELECT study_id, 'shunt' AS mode, CASE WHEN {_ABSENT[0]} OR {_ABSENT[1]} THEN 'Please select valid input nodes.' ELSE '' END AS message FROM vol
        UNION ALL SELECT study_id, 'target', CASE WHEN {' OR '.join(_ABSENT[:4])} THEN 'Please select valid input and output nodes, and ensure the liver segment is specified.' ELSE '' END FROM vol
        UNION ALL SELECT study_id, 'registration', CASE WHEN {_ABSENT[0]} OR {_ABSENT[4]} THEN 'Please select both SPECT CT and Reference CT volumes before registration.' ELSE '' END FROM vol""",
    "study_status": "SELECT study_id, CASE study_id % 4 WHEN 0 THEN 'no_volume' WHEN 1 THEN 'zero_volume' WHEN 2 THEN 'no_voxels' ELSE CASE WHEN study_id IN (SELECT study_id FROM vox) THEN 'ok' ELSE 'no_voxels' END END AS status FROM vol",
    "param_violations": "SELECT study_id, concat_ws(',', CASE WHEN act > 10000 THEN 'activity_mbq' END, CASE WHEN lsf > 100 THEN 'lsf_percent' END, CASE WHEN study_id % 9 * 50 > 200 THEN 'hours' END) AS violations FROM varied",
    "apply_linear_transform": """SELECT study_id, CASE WHEN moved THEN printf('0.000 -4.000 0.000 %.3f %.3f 0.000 0.000 %.3f 0.000 0.000 4.000 4.000 0.000 0.000 0.000 1.000', 3.0::DOUBLE, 1.5 * sx, 1.5 * ox - 2.0)
        ELSE printf('%.3f 0.000 0.000 %.3f 0.000 4.000 0.000 2.000 0.000 0.000 4.000 -3.000 0.000 0.000 0.000 1.000', sx, ox) END AS matrix FROM turned""",
    "apply_bspline": f"""SELECT study_id, i, j, k, round(sum(coalesce(w * c.value / 64, 0)), 6) AS dx, round(sum(coalesce(w * c.value / 128, 0)), 6) AS dy, round(sum(coalesce(-w * c.value / 64, 0)), 6) AS dz FROM (
        SELECT p.study_id, p.i, p.j, p.k, ni + s % 4 - 1 AS ci, nj + s // 4 % 4 - 1 AS cj, nk + s // 16 - 1 AS ck, ({_WEIGHT.format(s="s % 4", u="ui")}) * ({_WEIGHT.format(s="s // 4 % 4", u="uj")}) * ({_WEIGHT.format(s="s // 16", u="uk")}) AS w
        FROM (SELECT *, {_AXES} FROM vox) p, range(64) r(s)) q LEFT JOIN (SELECT study_id AS cs, i AS pi, j AS pj, k AS pk, value FROM vox WHERE i < 6 AND j < 7) c ON cs = study_id AND pi = ci AND pj = cj AND pk = ck GROUP BY study_id, i, j, k""",
    "geometry_align": f"SELECT study_id, round({_XYZ['x']} - (7.5 * sx + ox), 6) AS x, round({_XYZ['y']} - 32.0, 6) AS y, round({_XYZ['z']} - 9.0, 6) AS z FROM turned",
    "mi_score": f"+{_mi(_SELF)} SELECT study_id, cand, mi FROM scored",
    "register_candidates": _candidates(),
    "register_methods": f"SELECT study_id, method, round({_XYZ['x']}, 6) AS x, round({_XYZ['y']}, 6) AS y, round({_XYZ['z']}, 6) AS z FROM (SELECT study_id, sx, ox, study_id % 4 < 2 AS moved, ['Rigid', 'Affine', 'BSpline', 'none'][study_id % 4 + 1] AS method FROM vol)",
    "harden_bspline": _HARD,
    "register_affine": _search(),
    "register_rigid": f"{_RIGID} SELECT study_id, 'Rigid' AS method, {', '.join(f'round(p{n}, 6) AS {p}' for n, p in enumerate(('tx', 'ty', 'tz', 'rx', 'ry', 'rz')))}, mi, round(fit, 6) AS fit FROM done",
    "register_and_harden": _HARDENED,
    "image_pyramid": f"SELECT study_id, i, j, k, round(value, 6) AS value FROM ({_blocks(2)})",
    "chain_transforms": "SELECT study_id, format('0.000 -1.000 0.000 {:.3f} 1.500 0.000 0.000 -2.000 0.000 0.000 1.000 7.000 0.000 0.000 0.000 1.000', 5.0 + study_id % 5) AS matrix FROM vol",
    "sample_lattice": _sampled(1, 0.1),
    "register_methods_voxels": f"""SELECT study_id, ['Rigid', 'Affine', 'BSpline', 'none'][study_id % 4 + 1] AS method, count(*) AS n, sum(value) AS total, sum(value * i) AS si, sum(value * j) AS sj, sum(value * k) AS sk
        FROM (SELECT * FROM ({_HARD}) WHERE study_id % 4 = 2 UNION ALL SELECT vox.* FROM vox JOIN vol USING (study_id) WHERE study_id % 4 <> 2) GROUP BY study_id""",
    "resample_to_grid": "SELECT study_id, ti AS i, tj AS j, tk AS k, value FROM target JOIN vox USING (study_id, i, j, k)",
    "sample_voxels": "SELECT * FROM vox WHERE (i::BIGINT * 73856093 + j::BIGINT * 19349663 + k::BIGINT * 83492791 + study_id * 2654435761) % 1000000 < 2000",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(body) for name, body in _SQL.items()}
