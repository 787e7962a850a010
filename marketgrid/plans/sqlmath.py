"""Distribution functions as SQL text for the checks: Simpson's rule and Newton steps over ranges."""

from __future__ import annotations

STEPS = 400


def _simpson(f: str, top: str) -> str:
    """Integral from 0 to top of f, an expression in v."""
    c = f"CASE WHEN k = 0 OR k = {STEPS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({top})/{3.0 * STEPS}*list_sum(list_transform(range(0, {STEPS + 1}), lambda k: {c}*{f.replace('v', f'(({top})*k/{STEPS}.0)')})))"


def phi(x: str) -> str:
    """Normal distribution function."""
    return f"(0.5 + {_simpson('exp(-0.5*v*v)', x)}/sqrt(2*pi()))"


def t_cdf(t: str, df: str) -> str:
    scale = f"exp(lgamma((({df}) + 1)/2.0) - lgamma(({df})/2.0))/sqrt(pi())"
    return f"(0.5 + {scale}*{_simpson(f'pow(cos(v), ({df}) - 1)', f'atan(({t})/sqrt({df}))')})"


def newton(cdf, density: str, p: float | str, start: float, rounds: int = 30) -> str:
    """Quantile p by Newton steps; ``cdf`` takes an expression, ``density`` is one in z."""
    return f"list_reduce(list_prepend({start}::DOUBLE, list_transform(range(0, {rounds}), lambda i: 0.0)), lambda z, i: z - ({cdf('z')} - {p})/({density}))"


def quantile(p: float) -> str:
    """Normal quantile of a constant."""
    return newton(phi, "exp(-0.5*z*z)/sqrt(2*pi())", p, 0.0)


def t_quantile(p: float, df: str) -> str:
    density = f"exp(lgamma((({df}) + 1)/2.0) - lgamma(({df})/2.0))/sqrt(pi()*({df}))*pow(1 + z*z/({df}), -(({df}) + 1)/2.0)"
    return newton(lambda z: t_cdf(z, df), density, p, 1.0)


# ---- small matrices as lists of lists, stepped by recursion; each function gives (view name, text) pairs ----


def erc_views(prefix: str, src: str, rounds: int = 300) -> list[tuple[str, str]]:
    """Equal-risk weights (k, asset, w) of upper triangles src(k, i, j, s), by exact steps of one coordinate at a time."""
    root = "(sqrt(cross_*cross_ + 4*m[i][i]/len(m)) - cross_)/(2*m[i][i])"
    return [
        (f"{prefix}_f", f"SELECT k, i, j, s FROM ({src}) UNION ALL SELECT k, j, i, s FROM ({src}) WHERE i <> j"),
        (f"{prefix}_m", f"SELECT k, list(i ORDER BY i) AS names, list(r ORDER BY i) AS m FROM (SELECT k, i, list(s ORDER BY j) AS r FROM {prefix}_f GROUP BY k, i) GROUP BY k"),
        (f"{prefix}_it", f"""SELECT k, names, m, list_transform(range(1, len(m) + 1), lambda i: 1/sqrt(m[i][i])) AS y, 0 AS it FROM {prefix}_m UNION ALL
          SELECT k, names, m, list_transform(range(1, len(m) + 1), lambda j: CASE WHEN j = i THEN {root} ELSE y[j] END), it + 1 FROM (
          SELECT *, list_dot_product(m[i], y) - m[i][i]*y[i] AS cross_ FROM (SELECT *, it % len(m) + 1 AS i FROM {prefix}_it WHERE it < {rounds}*len(m)))"""),
        (prefix, f"SELECT k, unnest(names) AS asset, unnest(list_transform(y, lambda x: x/list_sum(y))) AS w FROM {prefix}_it WHERE it = {rounds}*len(m)"),
    ]


def solve_views(prefix: str, src: str, size: int) -> list[tuple[str, str]]:
    """Solutions (k, x) of src(k, a), a list of `size` rows with the right side appended, by Gauss-Jordan steps."""
    other = f"list_transform(range(1, {size + 2}), lambda j: a[i][j] - a[i][c]*a[c][j]/a[c][c])"
    row = f"CASE WHEN i = c THEN list_transform(a[c], lambda x: x/a[c][c]) ELSE {other} END"
    return [
        (f"{prefix}_gj", f"SELECT k, a, 1 AS c FROM ({src}) UNION ALL SELECT k, list_transform(range(1, {size + 1}), lambda i: {row}), c + 1 FROM {prefix}_gj WHERE c <= {size}"),
        (prefix, f"SELECT k, list_transform(a, lambda r: r[{size + 1}]) AS x FROM {prefix}_gj WHERE c = {size + 1}"),
    ]


def top_views(prefix: str, src: str, size: int, rounds: int = 40) -> list[tuple[str, str]]:
    """Largest eigenvalue and its vector (k, value, v) of src(k, m), symmetric, by squaring the matrix again and again."""
    cells = f"range(1, {size + 1})"
    square = f"list_transform({cells}, lambda i: list_transform({cells}, lambda j: list_dot_product(p[i], p[j])))"
    trace = f"list_sum(list_transform({cells}, lambda i: q[i][i]))"
    column = "list_position(list_transform(p, lambda r: list_dot_product(r, r)), list_max(list_transform(p, lambda r: list_dot_product(r, r))))"
    return [
        (f"{prefix}_sq", f"""SELECT k, m, m AS p, 0 AS it FROM ({src}) UNION ALL
          SELECT k, m, list_transform(q, lambda r: list_transform(r, lambda x: x/{trace})), it + 1 FROM (SELECT *, {square} AS q FROM {prefix}_sq WHERE it < {rounds})"""),
        (f"{prefix}_u", f"SELECT k, m, list_transform(p[{column}], lambda x: x/sqrt(list_dot_product(p[{column}], p[{column}]))) AS v FROM {prefix}_sq WHERE it = {rounds}"),
        (prefix, f"SELECT k, m, v, list_sum(list_transform({cells}, lambda i: v[i]*list_dot_product(m[i], v))) AS value FROM {prefix}_u"),
    ]


def net_views(prefix: str, src: str, size: int, l1: float, l2: float, rounds: int = 1200) -> list[tuple[str, str]]:
    """Minimisers (k, x) of x'Gx/2 - c'x + l1 |x|_1 + l2 |x|^2/2 for src(k, g, c), by proximal steps."""
    cells = f"range(1, {size + 1})"
    grad = f"list_transform({cells}, lambda i: x[i] - t*(list_dot_product(g[i], x) - c[i] + {l2}*x[i]))"
    return [
        (f"{prefix}_px", f"""SELECT k, g, c, 1/({l2} + list_max(list_transform(g, lambda r: list_sum(list_transform(r, lambda y: abs(y)))))) AS t, list_transform(c, lambda y: 0.0::DOUBLE) AS x, 0 AS it FROM ({src}) UNION ALL
          SELECT k, g, c, t, list_transform(z, lambda y: sign(y)*greatest(abs(y) - t*{l1}, 0)), it + 1 FROM (SELECT *, {grad} AS z FROM {prefix}_px WHERE it < {rounds})"""),
        (prefix, f"SELECT k, x FROM {prefix}_px WHERE it = {rounds}"),
    ]
