"""Layout-independent random numbers from hashes.

A uniform is a pure function of a key string, so a draw does not depend on
partitioning, task retries or executor loss (a re-run task recomputes the
same numbers), and the DuckDB oracle reproduces it exactly:

    u = (first 48 bits of md5(key) + 0.5) / 2^48
    z = sqrt(-2 ln u1) cos(2 pi u2)                (Box-Muller)
"""

from __future__ import annotations

import math

TWO48 = float(2 ** 48)


def uniform_sql(key: str, dialect: str = "spark") -> str:
    if dialect == "spark":
        bits = f"CAST(conv(substr(md5({key}), 1, 12), 16, 10) AS BIGINT)"
    else:
        bits = f"CAST(('0x' || substr(md5({key}), 1, 12)) AS BIGINT)"
    return f"((CAST({bits} AS DOUBLE) + 0.5e0) / {TWO48!r}e0)"


def key_sql(parts: list[str], dialect: str = "spark") -> str:
    """``parts`` are SQL expressions; integers are cast to text in each dialect."""
    t = "STRING" if dialect == "spark" else "VARCHAR"
    return "concat_ws('|', " + ", ".join(f"CAST({p} AS {t})" for p in parts) + ")"


def normal_sql(parts: list[str], dialect: str = "spark") -> str:
    u1 = uniform_sql(key_sql(parts + ["'a'"], dialect), dialect)
    u2 = uniform_sql(key_sql(parts + ["'b'"], dialect), dialect)
    return f"(sqrt(-2.0e0 * ln({u1})) * cos({2 * math.pi!r}e0 * {u2}))"
