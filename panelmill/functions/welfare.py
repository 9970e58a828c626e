"""Welfare of a price floor as Catalyst expressions (V1, V2, V3).

Each formula is written once, as a SQL expression string over column names,
and evaluated by Spark through ``F.expr`` (a native Catalyst expression,
inside whole-stage codegen) and by DuckDB verbatim in the oracle. Numbers
are written as double literals (``0.5e0``) so neither engine switches to
decimal arithmetic.

With g = m - p, Q = production, q = procurement (+ eta * g / 100 when eta > 0):

    dPS = u (g q + 1/2 eps_s g^2 / p Q)
    dCS = u (1[g > 0] |g| (Q - q) + 1/2 |eps_d| g^2 / p (Q - q))
    GC  = u g q (1 + kappa)
    DWL = u 1/2 (eps_s + |eps_d|) g^2 / p Q
    W   = alpha dPS - beta dCS - gamma GC - delta DWL

Expected input columns: ``p`` (forecast price), ``eps_s``, ``eps_d``,
``q_proc``, ``q_total``, ``alpha``, ``beta``, ``gamma``, ``delta``, ``eta``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.params import KAPPA, SEARCH_HIGH, SEARCH_LOW, UNIT_SCALE


def num(x: float) -> str:
    """A double literal both engines parse as DOUBLE."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


U = num(UNIT_SCALE)
K = num(KAPPA)
HALF = num(0.5)


def _q(g: str, eta: str = "eta", q0: str = "q_proc") -> str:
    return f"(CASE WHEN {eta} > 0 THEN {q0} + {eta} * {g} / {num(100)} ELSE {q0} END)"


def components_sql(m: str, p: str = "p", eps_s: str = "eps_s", eps_d: str = "eps_d",
                   eta: str = "eta", cs_kink_only_positive: bool = False) -> dict[str, str]:
    """Expressions of dPS, dCS, GC, DWL at floor ``m``.

    ``cs_kink_only_positive`` gives V2's variant, where dCS is 0 for g <= 0
    (V1 keeps the quadratic term there; both are kept, D14).
    """
    g = f"(({m}) - {p})"
    q = _q(g, eta)
    sq = f"({g} * {g} / {p})"
    qc = f"(q_total - {q})"
    ps = f"({g} * {q} * {U} + {HALF} * {eps_s} * {sq} * q_total * {U})"
    cs_lin = f"(CASE WHEN {g} > 0 THEN abs({g}) * {qc} * {U} ELSE {num(0)} END)"
    cs_quad = f"({HALF} * abs({eps_d}) * {sq} * {qc} * {U})"
    cs = (f"(CASE WHEN {g} > 0 THEN {cs_lin} + {cs_quad} ELSE {num(0)} END)"
          if cs_kink_only_positive else f"({cs_lin} + {cs_quad})")
    gc = f"({g} * {q} * ({num(1)} + {K}) * {U})"
    dwl = f"({HALF} * ({eps_s} + abs({eps_d})) * {sq} * q_total * {U})"
    return {"delta_ps": ps, "delta_cs": cs, "govt_cost": gc, "dwl": dwl}


def welfare_sql(m: str, p: str = "p", eps_s: str = "eps_s", eps_d: str = "eps_d",
                eta: str = "eta") -> str:
    """V1: W(m)."""
    c = components_sql(m, p, eps_s, eps_d, eta)
    return (f"(alpha * {c['delta_ps']} - beta * {c['delta_cs']} - gamma * {c['govt_cost']}"
            f" - delta * {c['dwl']})")


def optimum_stages(p: str = "p", eps_s: str = "eps_s", eps_d: str = "eps_d", eta: str = "eta",
                   low: float = SEARCH_LOW, high: float = SEARCH_HIGH,
                   prefix: str = "") -> list[tuple[str, str]]:
    """V3: closed-form global maximiser of W on g in [low, high].

    W/u is c1 g + c2 g^2 + c3 g^3 on each side of the kink at g = 0 (c3 = 0
    without endogenous procurement). Candidates: both bounds, the kink, and
    the real stationary points strictly inside each piece. The answer is the
    candidate with the largest W, the smallest g on ties. Returns staged
    (column, expression) pairs ending in ``m_star`` and ``w_star``.
    """
    x = prefix
    lo, hi = num(low), num(high)
    e = f"(CASE WHEN {eta} > 0 THEN {eta} / {num(100)} ELSE {num(0)} END)"
    stages = [
        (f"{x}_e", e),
        (f"{x}_ak", f"(alpha - gamma * ({num(1)} + {K}))"),
    ]
    stages += [
        (f"{x}_c1_0", f"({x}_ak * q_proc)"),
        (f"{x}_c1_1", f"({x}_ak * q_proc - beta * (q_total - q_proc))"),
        (f"{x}_c2_0", f"({x}_ak * {x}_e + {HALF} * (alpha * {eps_s} * q_total"
                      f" - beta * abs({eps_d}) * (q_total - q_proc)"
                      f" - delta * ({eps_s} + abs({eps_d})) * q_total) / {p})"),
        (f"{x}_c3", f"({HALF} * beta * abs({eps_d}) * {x}_e / {p})"),
    ]
    stages.append((f"{x}_c2_1", f"({x}_c2_0 + beta * {x}_e)"))
    for j in (0, 1):
        c1, c2, c3 = f"{x}_c1_{j}", f"{x}_c2_{j}", f"{x}_c3"
        disc = f"({num(4)} * {c2} * {c2} - {num(12)} * {c3} * {c1})"
        ra = (f"(CASE WHEN {c3} = 0 THEN (CASE WHEN {c2} <> 0 THEN -{c1} / ({num(2)} * {c2}) END)"
              f" WHEN {disc} >= 0 THEN (-{num(2)} * {c2} + sqrt({disc})) / ({num(6)} * {c3}) END)")
        rb = (f"(CASE WHEN {c3} <> 0 AND {disc} >= 0"
              f" THEN (-{num(2)} * {c2} - sqrt({disc})) / ({num(6)} * {c3}) END)")
        a, b = (lo, num(0)) if j == 0 else (num(0), hi)
        stages.append((f"{x}_ra_{j}", f"(CASE WHEN {ra} > {a} AND {ra} < {b} THEN {ra} END)"))
        stages.append((f"{x}_rb_{j}", f"(CASE WHEN {rb} > {a} AND {rb} < {b} THEN {rb} END)"))
    cands = [lo, num(0), hi, f"{x}_ra_0", f"{x}_rb_0", f"{x}_ra_1", f"{x}_rb_1"]
    for i, c in enumerate(cands):
        stages.append((f"{x}_g{i}", c))
    for i in range(len(cands)):
        stages.append((f"{x}_w{i}", f"(CASE WHEN {x}_g{i} IS NOT NULL THEN "
                                    f"{welfare_sql(f'{p} + {x}_g{i}', p, eps_s, eps_d, eta)} END)"))
    ws = ", ".join(f"{x}_w{i}" for i in range(len(cands)))
    stages.append((f"{x}_wbest", f"greatest({ws})"))
    gs = ", ".join(f"CASE WHEN {x}_w{i} = {x}_wbest THEN {x}_g{i} END" for i in range(len(cands)))
    stages.append((f"{x}_gbest", f"least({gs})"))
    stages.append((f"{x}m_star" if x else "m_star", f"({p} + {x}_gbest)"))
    stages.append((f"{x}w_star" if x else "w_star", f"{x}_wbest"))
    return stages


def apply_stages(df: DataFrame, stages: Sequence[tuple[str, str]], keep_scratch: bool = False
                 ) -> DataFrame:
    """Add staged expressions as columns (Spark side)."""
    for name, expr in stages:
        df = df.withColumn(name, F.expr(expr))
    if not keep_scratch:
        df = df.drop(*[n for n, _ in stages if n.startswith("_")])
    return df


def stages_sql(src: str, stages: Sequence[tuple[str, str]]) -> str:
    """The same staged expressions as nested DuckDB subqueries over ``src``."""
    sql = f"SELECT * FROM {src}"
    for name, expr in stages:
        sql = f"SELECT *, {expr} AS {name} FROM ({sql})"
    scratch = [n for n, _ in stages if n.startswith("_")]
    return f"SELECT * EXCLUDE ({', '.join(scratch)}) FROM ({sql})" if scratch else sql
