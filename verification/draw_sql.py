"""Hashed uniforms and triangular draws in DuckDB SQL, step by step as nested selects."""

from __future__ import annotations

MASK, WEYL, MUL_A, MUL_B = 4294967295, 0x1E3779B1, 0x7FEB352D, 0x2C1B3C6D


def stream(variable: str, *keys: str) -> str:
    """Both halves of the 64 bits, so that no step leaves the range of a BIGINT."""
    parts = ", ".join(["'2025'", f"'{variable}'", *[f"coalesce(CAST({k} AS VARCHAR), '~')" for k in keys]])
    halves = [f"CAST('0x' || substr(md5(concat_ws('|', {parts})), {at}, 8) AS BIGINT)" for at in (1, 9)]
    return f"{{'h': {halves[0]}, 'l': {halves[1]}}}"


def uniforms(source: str, streams: dict[str, str], sample: str = "Id_sample") -> str:
    """Subquery text: `source` plus one column u_<name> per stream expression."""
    def each(fmt: str) -> str:
        return ", ".join(fmt.format(n=n) for n in streams)

    text = f"SELECT *, (CAST({sample} AS BIGINT) * {WEYL}) & {MASK} AS nz, " \
        + ", ".join(f"{expr} AS s_{n}" for n, expr in streams.items()) + f" FROM {source}"
    text = f"SELECT * REPLACE (xor(nz, nz >> 16) AS nz) FROM ({text})"
    text = f"SELECT * REPLACE ((nz * {MUL_A}) & {MASK} AS nz) FROM ({text})"
    text = f"SELECT * REPLACE (xor(nz, nz >> 15) AS nz) FROM ({text})"
    text = f"SELECT *, {each(f'(xor(s_{{n}}.l, nz) * {MUL_A}) & {MASK} AS u_{{n}}')} FROM ({text})"
    text = f"SELECT * EXCLUDE (nz, {each('s_{n}')}) REPLACE ({each('xor(xor(u_{n}, u_{n} >> 15), s_{n}.h) AS u_{n}')}) FROM ({text})"
    text = f"SELECT * REPLACE ({each(f'(u_{{n}} * {MUL_B}) & {MASK} AS u_{{n}}')}) FROM ({text})"
    text = f"SELECT * REPLACE ({each('xor(u_{n}, u_{n} >> 16) AS u_{n}')}) FROM ({text})"
    text = f"SELECT * REPLACE ({each(f'(u_{{n}} * {MUL_A}) & {MASK} AS u_{{n}}')}) FROM ({text})"
    text = f"SELECT * REPLACE ({each('xor(u_{n}, u_{n} >> 15) AS u_{n}')}) FROM ({text})"
    return f"SELECT * REPLACE ({each('(u_{n} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u_{n}')}) FROM ({text})"


def triangular(u: str, low: str, mode: str, high: str) -> str:
    a, c, b = f"({low})", f"({mode})", f"({high})"
    return (f"CASE WHEN NOT ({a} <= {c} AND {c} <= {b}) THEN NULL WHEN {a} = {b} THEN {a} "
            f"WHEN {u} * ({b} - {a}) < {c} - {a} THEN {a} + sqrt({u} * ({b} - {a}) * ({c} - {a})) "
            f"WHEN {a} <= {c} AND {c} <= {b} THEN {b} - sqrt((1 - {u}) * ({b} - {a}) * ({b} - {c})) END")


def samples(source: str, n: int) -> str:
    return f"SELECT t.*, CAST(i AS INT) AS Id_sample FROM {source} t, range(1, {n + 1}) r(i)"
