"""Query registry and the shared SQL fragments of the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CTE = {
    "items": """
SELECT l_orderkey AS event, l_extendedprice / CAST(1000 AS DOUBLE) AS pt,
       (l_discount - CAST(0.05 AS DOUBLE)) * CAST(50 AS DOUBLE) AS eta,
       (l_quantity - CAST(25.5 AS DOUBLE)) / CAST(25.5 AS DOUBLE) * pi() AS phi,
       l_extendedprice / CAST(1000 AS DOUBLE) * CAST(0.1 AS DOUBLE) AS mass,
       (CASE WHEN l_linestatus = 'F' THEN 11 ELSE 13 END)
         * (CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END) AS pdgId,
       l_tax / CAST(0.08 AS DOUBLE) AS score,
       CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 4 ELSE 0 END AS flavour,
       CASE WHEN l_linenumber <= 3 THEN 'lepton' ELSE 'jet' END AS kind,
       l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_shipdate AS ship
FROM lineitem""",
    "ev": """
SELECT o_orderkey AS event,
       CASE o_orderstatus WHEN 'P' THEN 'DATA' WHEN 'O' THEN 'SIG' ELSE 'BKG' END AS sample,
       o_custkey % 3 AS dataset,
       CASE WHEN o_orderstatus = 'P' THEN CAST(1 AS DOUBLE)
            ELSE CAST(2 AS DOUBLE) * (CASE o_orderpriority WHEN '1-URGENT' THEN CAST(1.5 AS DOUBLE)
                   WHEN '5-LOW' THEN CAST(-0.5 AS DOUBLE)
                   WHEN '4-NOT SPECIFIED' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) END AS weight,
       o_totalprice / CAST(1000 AS DOUBLE) AS total, o_orderpriority AS priority
FROM orders""",
    # per kind, objects with their rank
    "obj": """
SELECT *, row_number() OVER (PARTITION BY event, kind ORDER BY pt DESC, line, part, supp, ship) - 1 AS idx
FROM items""",
    "lep": "SELECT * FROM obj WHERE kind = 'lepton' AND idx < 3",
    "jet": "SELECT * FROM obj WHERE kind = 'jet' AND idx < 4",
    # events with leading objects side by side
    "wide": """
SELECT event, """ + ", ".join(
        f"max(CASE WHEN kind='{kind}' AND idx={i} THEN {f} END) AS {p}{i + 1}_{f}"
        for kind, p, k in (("lepton", "l", 3), ("jet", "j", 4)) for i in range(k)
        for f in ("pt", "eta", "phi", "mass", "pdgId", "score", "flavour")) + """,
       least(count(*) FILTER (kind='lepton'), 3) AS nlep, least(count(*) FILTER (kind='jet'), 4) AS njet
FROM obj GROUP BY event""",
    # the same for every event, with or without objects
    "every": """
SELECT ev.*, wide.* EXCLUDE (event, nlep, njet), coalesce(nlep, 0) AS nlep, coalesce(njet, 0) AS njet
FROM ev LEFT JOIN wide USING (event)""",
    "rec": "SELECT ev.*, wide.* EXCLUDE (event) FROM ev JOIN wide USING (event)",
}
_NEEDS = {"obj": ["items"], "lep": ["obj"], "jet": ["obj"], "wide": ["obj"], "rec": ["ev", "wide"], "every": ["ev", "wide"]}


def _closure(names) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in _closure(_NEEDS.get(n, [])):
            if d not in out:
                out.append(d)
        if n not in out:
            out.append(n)
    return out


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """``body`` behind the named shared fragments and the extra ones, in order."""
    parts = [f"{n} AS ({CTE[n]})" for n in _closure(names)]
    parts += [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison across engines; the sum removes a negative zero."""
    return F.round(col, digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + CAST(0 AS DOUBLE))"


def p4_sql(o: str) -> dict[str, str]:
    """px, py, pz, e of an object with columns ``<o>_pt`` and so on."""
    pt, eta, phi, m = (f"{o}_{f}" for f in ("pt", "eta", "phi", "mass"))
    pz = f"({pt} * sinh({eta}))"
    return {"px": f"({pt} * cos({phi}))", "py": f"({pt} * sin({phi}))", "pz": pz,
            "e": f"sqrt({pt}*{pt} + {pz}*{pz} + {m}*{m})"}


def mass_sql(*objs: str) -> str:
    vs = [p4_sql(o) for o in objs]
    s = {k: "(" + " + ".join(v[k] for v in vs) + ")" for k in ("px", "py", "pz", "e")}
    m2 = f"({s['e']}*{s['e']} - {s['px']}*{s['px']} - {s['py']}*{s['py']} - {s['pz']}*{s['pz']})"
    return f"(CASE WHEN {m2} >= 0 THEN sqrt(abs({m2})) ELSE -sqrt(abs({m2})) END)"


def wrap_sql(d: str) -> str:
    return f"(CASE WHEN {d} > pi() THEN {d} - 2*pi() WHEN {d} <= -pi() THEN {d} + 2*pi() ELSE {d} END)"


def dr2_sql(a: str, b: str, wrap: bool = True) -> str:
    de, dp = f"({a}_eta - {b}_eta)", f"({a}_phi - {b}_phi)"
    if wrap:
        dp = wrap_sql(dp)
    return f"({de}*{de} + {dp}*{dp})"


def bin_sql(x: str, n: int, lo: float, hi: float) -> str:
    """Uniform bins as the check's own CASE."""
    return (f"CAST(CASE WHEN {x} < {lo} THEN 0 WHEN {x} >= {hi} THEN {n + 1} "
            f"ELSE least(floor(CAST({n} AS DOUBLE) * ({x} - CAST({lo} AS DOUBLE)) / CAST({hi - lo} AS DOUBLE)) + 1, {n}) END AS INTEGER)")


def edges_sql(x: str, edges) -> str:
    cases = " ".join(f"WHEN {x} < CAST({e} AS DOUBLE) THEN {i}" for i, e in enumerate(edges))
    return f"CAST(CASE {cases} ELSE {len(edges)} END AS INTEGER)"


def map_sql(bmap, x: str, y: str, what: str = "values") -> str:
    """Content of a binned map at (x, y) as nested CASEs over the edges."""
    grid = getattr(bmap, what)
    out = []
    for iy, row in enumerate(grid):
        for ix, v in enumerate(row):
            out.append(f"WHEN {x} >= CAST({bmap.x_edges[ix]} AS DOUBLE) AND {x} < CAST({bmap.x_edges[ix + 1]} AS DOUBLE) "
                       f"AND {y} >= CAST({bmap.y_edges[iy]} AS DOUBLE) AND {y} < CAST({bmap.y_edges[iy + 1]} AS DOUBLE) THEN CAST({v} AS DOUBLE)")
    return f"(CASE {' '.join(out)} ELSE CAST(0 AS DOUBLE) END)"
