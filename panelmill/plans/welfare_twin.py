"""DuckDB twins of V1-V3, written by hand from the formulas and apart from ``functions.welfare``.

With g = m - p and q = q_proc + eta g / 100 (eta > 0), unit 10, kappa 0.15:

    W = 10 [ alpha (g q + eps_s g^2 Q / 2p)
             - beta (max(g, 0) + |eps_d| g^2 / 2p) (Q - q)
             - 1.15 gamma g q
             - delta (eps_s + |eps_d|) g^2 Q / 2p ]

On either side of the kink W / 10 is the cubic c1 g + c2 g^2 + c3 g^3; the optimum on [-200, 1500] is at a
bound, at the kink or at a stationary point, and is found here with list functions.
"""

from __future__ import annotations


def quantity(g: str) -> str:
    return f"(q_proc + greatest(eta, 0.0e0) * {g} / 100.0e0)"


def square(g: str, p: str) -> str:
    return f"({g} * {g} / (2.0e0 * {p}))"


def parts(m: str, p: str = "p", v2: bool = False) -> dict[str, str]:
    """The four terms at floor ``m``; ``v2`` has no consumer term below the forecast price."""
    g = f"(({m}) - {p})"
    rest = f"(q_total - {quantity(g)})"
    consumer = f"10.0e0 * (greatest({g}, 0.0e0) + abs(eps_d) * {square(g, p)}) * {rest}"
    return {
        "delta_ps": f"(10.0e0 * ({g} * {quantity(g)} + eps_s * {square(g, p)} * q_total))",
        "delta_cs": f"(CASE WHEN {g} > 0 THEN {consumer} ELSE 0.0e0 END)" if v2 else f"({consumer})",
        "govt_cost": f"(11.5e0 * {g} * {quantity(g)})",
        "dwl": f"(10.0e0 * (eps_s + abs(eps_d)) * {square(g, p)} * q_total)",
    }


def welfare(m: str, p: str = "p") -> str:
    c = parts(m, p)
    return f"(alpha * {c['delta_ps']} - beta * {c['delta_cs']} - gamma * {c['govt_cost']} - delta * {c['dwl']})"


def optimum(src: str, p: str = "p", m_out: str = "m_star", w_out: str = "w_star") -> str:
    """``src`` with the best floor and its welfare; ties go to the lowest floor."""
    def stationary(c1: str, c2: str, low: str, high: str) -> str:
        root = f"sqrt(greatest(4.0e0 * {c2} * {c2} - 12.0e0 * _c3 * {c1}, 0.0e0))"
        real = f"(4.0e0 * {c2} * {c2} - 12.0e0 * _c3 * {c1} >= 0)"
        return (f"list_filter(CASE WHEN _c3 = 0 AND {c2} = 0 THEN [] WHEN _c3 = 0 THEN [-{c1} / (2.0e0 * {c2})] "
                f"WHEN {real} THEN [(-2.0e0 * {c2} + {root}) / (6.0e0 * _c3), (-2.0e0 * {c2} - {root}) / (6.0e0 * _c3)] "
                f"ELSE [] END, lambda g: g > {low} AND g < {high})")
    w = welfare(f"{p} + g", p)
    return f"""SELECT * EXCLUDE (_e, _k, _b, _c1l, _c1r, _c2l, _c2r, _c3, _cand, _best), _best AS {w_out},
      {p} + list_min(list_filter(_cand, lambda g: {w} = _best)) AS {m_out}
    FROM (SELECT *, list_max(list_transform(_cand, lambda g: {w})) AS _best
    FROM (SELECT *, list_concat([-200.0e0, 0.0e0, 1500.0e0], list_concat(
            {stationary('_c1l', '_c2l', '-200.0e0', '0.0e0')}, {stationary('_c1r', '_c2r', '0.0e0', '1500.0e0')})) AS _cand
    FROM (SELECT *, _k * q_proc AS _c1l, _k * q_proc - beta * (q_total - q_proc) AS _c1r,
            _k * _e + _b AS _c2l, _k * _e + _b + beta * _e AS _c2r,
            beta * abs(eps_d) * _e / (2.0e0 * {p}) AS _c3
    FROM (SELECT *, greatest(eta, 0.0e0) / 100.0e0 AS _e, alpha - 1.15e0 * gamma AS _k,
            (alpha * eps_s * q_total - beta * abs(eps_d) * (q_total - q_proc)
             - delta * (eps_s + abs(eps_d)) * q_total) / (2.0e0 * {p}) AS _b
    FROM {src}))))"""
