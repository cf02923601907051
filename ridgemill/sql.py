"""Pieces of DuckDB SQL that restate the catalogue's fixtures and operators."""

from __future__ import annotations

LAMBDA, N_RAND, N = 10, 100, 25

#: Draws of the Mersenne Twister and cumulative shuffles of 25 rows.
TWISTER = f"""
seeded AS MATERIALIZED (
  SELECT list_reduce(range(1, 624), lambda acc, i: list_append(acc, (1812433253 * xor(acc[len(acc)], acc[len(acc)] >> 30) + i) & 4294967295), [4357::BIGINT]) AS s),
words AS MATERIALIZED (
  SELECT list_reduce(range(0, {N_RAND * (N - 1)}), lambda acc, k: list_append(acc, xor(acc[k + 398], xor(((acc[k + 1] & 2147483648) | (acc[k + 2] & 2147483647)) >> 1, CASE WHEN acc[k + 2] & 1 = 1 THEN 2567483615 ELSE 0 END))), s) AS w FROM seeded),
raw AS MATERIALIZED (SELECT unnest(w[625:]) AS y0, generate_subscripts(w[625:], 1) - 1 AS k FROM words),
temper1 AS (SELECT k, xor(y0, y0 >> 11) AS y FROM raw),
temper2 AS (SELECT k, xor(y, (y << 7) & 2636928640) AS y FROM temper1),
temper3 AS (SELECT k, xor(y, (y << 15) & 4022730752) AS y FROM temper2),
draws AS MATERIALIZED (SELECT k, xor(y, y >> 18) AS v, k % {N - 1} AS i FROM temper3),
jumps AS MATERIALIZED (SELECT k, i, i + v // (4294967295 // ({N} - i) + 1) AS j FROM draws),
steps(k, a) AS (
  SELECT 0::BIGINT, range(0, {N})
  UNION ALL
  SELECT s.k + 1, list_transform(range(1, {N + 1}), lambda p: CASE WHEN p = q.i + 1 THEN s.a[q.j + 1] WHEN p = q.j + 1 THEN s.a[q.i + 1] ELSE s.a[p] END)
  FROM steps s JOIN jumps q ON q.k = s.k),
perms AS MATERIALIZED (
  SELECT (k // {N - 1} - 1)::INT AS perm_id, unnest(range(0, {N}))::INT AS row_idx, unnest(a)::INT AS src_idx FROM steps WHERE k > 0 AND k % {N - 1} = 0)
"""

def solved(x: str, size: int, t: str = "t") -> str:
    """`t` (feature, row_idx, value), the projection of the long table `x` with
    `size` features: its regularised Gram matrix swept on one feature after the
    other, which leaves minus its inverse."""
    steps = [
        f"{t}_f AS MATERIALIZED (SELECT feature, row_number() OVER (ORDER BY feature) AS i FROM (SELECT DISTINCT feature FROM {x}))",
        f"{t}_x AS MATERIALIZED (SELECT i, row_idx, value FROM {x} JOIN {t}_f USING (feature))",
        f"{t}_0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.value * b.value) + CASE WHEN a.i = b.i THEN {LAMBDA} ELSE 0 END AS v FROM {t}_x a JOIN {t}_x b USING (row_idx) GROUP BY a.i, b.i)",
    ]
    for k in range(1, size + 1):
        steps.append(f"""{t}_{k} AS MATERIALIZED (
  SELECT a.i, a.j, CASE WHEN a.i = {k} AND a.j = {k} THEN -1 / d.v WHEN a.i = {k} OR a.j = {k} THEN a.v / d.v ELSE a.v - c.v * r.v / d.v END AS v
  FROM {t}_{k - 1} a JOIN {t}_{k - 1} c ON c.i = a.i AND c.j = {k} JOIN {t}_{k - 1} r ON r.i = {k} AND r.j = a.j JOIN {t}_{k - 1} d ON d.i = {k} AND d.j = {k})""")
    steps.append(f"{t} AS MATERIALIZED (SELECT f.feature, x.row_idx, -sum(m.v * x.value) AS value FROM {t}_{size} m JOIN {t}_f f USING (i) JOIN {t}_x x ON x.i = m.j GROUP BY ALL)")
    return ",\n".join(steps) + ","


SOLVE = solved("xs", 5)

FIXTURE = f"""
x0 AS MATERIALIZED (
  SELECT n.n_nationkey::INT AS row_idx, s.feature, coalesce(a.v, 0.0) AS value
  FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment AS feature FROM customer) s
  LEFT JOIN (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS v FROM customer GROUP BY ALL) a ON a.c_nationkey = n.n_nationkey AND a.c_mktsegment = s.feature),
y0 AS MATERIALIZED (
  SELECT c.c_nationkey::INT AS row_idx, o.o_orderpriority AS sample, avg(o.o_totalprice) AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL),
sparse0 AS MATERIALIZED (
  SELECT user_id::INT AS row_idx, event_type || '-' || day(ts) AS sample, sum(value) AS value FROM events GROUP BY ALL),
months AS MATERIALIZED (
  SELECT c.c_nationkey::INT AS row_idx, o.o_orderpriority || '-' || year(o.o_orderdate) || '-' || month(o.o_orderdate) AS sample, sum(o.o_totalprice) / 100000 AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL),
xs AS MATERIALIZED (SELECT row_idx, feature, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM x0 WINDOW w AS (PARTITION BY feature)),
ys AS MATERIALIZED (SELECT row_idx, sample, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM y0 WINDOW w AS (PARTITION BY sample)),
{SOLVE}
beta AS MATERIALIZED (SELECT feature, sample, sum(t.value * ys.value) AS value FROM t JOIN ys USING (row_idx) GROUP BY ALL)
"""

#: A factor as a whole number: sums of their products are exact, so that equal coefficients are equal whatever the order of the sum.
WHOLE = "round({v} * 1000000000000::DOUBLE)::HUGEINT"

TEST = f"""
moved AS MATERIALIZED (
  SELECT perm_id, feature, sample, sum(t.value * {{y}}.value) AS value, sum({WHOLE.format(v="t.value")} * {WHOLE.format(v="{y}.value")}) AS e
  FROM perms JOIN {{y}} ON {{y}}.row_idx = perms.src_idx JOIN {{t}} t ON t.row_idx = perms.row_idx GROUP BY ALL),
seen AS MATERIALIZED (
  SELECT feature, sample, sum({WHOLE.format(v="t.value")} * {WHOLE.format(v="{y}.value")}) AS e FROM {{t}} t JOIN {{y}} USING (row_idx) GROUP BY ALL),
sums AS (
  SELECT m.feature, m.sample, b.value AS beta, sum(m.value) AS s1, sum(m.value * m.value) AS s2, count(*) FILTER (abs(m.e) >= abs(coalesce(s.e, 0))) AS hits
  FROM moved m JOIN {{beta}} b USING (feature, sample) LEFT JOIN seen s USING (feature, sample) GROUP BY ALL),
scored AS (SELECT feature, sample, beta, s1 / 100 AS mean, sqrt(greatest(s2 / 100 - (s1 / 100) * (s1 / 100), 0)) AS se, hits FROM sums),
result AS MATERIALIZED (
  SELECT feature, sample, beta, se, CASE WHEN se > 1e-12 THEN (beta - mean) / se ELSE 0 END AS zscore, (hits + 1) / 101.0::DOUBLE AS pvalue FROM scored)
"""


def over(select: str, *ctes: str) -> str:
    """A query over the fixture and further common tables."""
    return f"WITH RECURSIVE {', '.join([FIXTURE.strip(), *(c.strip() for c in ctes)])}\n{select}"


def tested(select: str, y: str = "ys", beta: str = "beta", *ctes: str, t: str = "t") -> str:
    """A query over the permutation test's result."""
    return over(select, TWISTER, *ctes, TEST.format(y=y, beta=beta, t=t))


def r6(column: str, name: str | None = None) -> str:
    return f"round({column}, 6) + 0.0 AS {name or column}"


RESULT = f"SELECT feature, sample, {r6('beta')}, {r6('se')}, {r6('zscore')}, round(pvalue, 9) AS pvalue FROM result"
