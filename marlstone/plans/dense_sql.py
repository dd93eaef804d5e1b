"""Dense linear algebra and clustering as DuckDB SQL, for the queries' oracles.

A matrix is a row (window_id, n, names, m) with m its entries row by row. Each
function gives common table expressions for a ``with recursive`` list; they read
the tables named in their arguments and end in one called ``out``. Nothing here
is shared with the kernels: eigenvalues come from Jacobi rotations, and clusters
from lists that shrink merge by merge.
"""

from __future__ import annotations


def at(i: str, j: str) -> str:
    """Place of an entry (0-based row and column) in a list."""
    return f"({i}) * n + ({j}) + 1"


def pairs(returns: str, out: str) -> str:
    """(window_id, i, j, rho) of i < j from (window_id, date, asset, ret)."""
    return f"{out} as (select a.window_id, a.asset as i, b.asset as j, corr(a.ret, b.ret) as rho from {returns} a join {returns} b on a.window_id = b.window_id and a.date = b.date and a.asset < b.asset group by all)"


def shrunk(returns: str, of: str, out: str) -> str:
    """Pairs shrunk by the closed form of Ledoit and Wolf, with shrinkage."""
    return f"""{out}_z as (select window_id, date, asset, (ret - avg(ret) over w) / stddev_samp(ret) over w as z from {returns} window w as (partition by window_id, asset)),
{out}_d as (select window_id, date, sum(z * z) as s, count(*) as n from {out}_z group by all),
{out}_p as (select window_id, sum(s * s) as b, count(*)::double as t, max(n)::double as n from {out}_d group by all),
{out}_q as (select window_id, sum(rho * rho) as r from {of} group by all),
{out}_v as (select window_id, b, t, n, (t - 1) / t as a, pow((t - 1) / t, 2) * (n + 2 * r) as d0 from {out}_p join {out}_q using (window_id)),
{out}_u as (select window_id, (b / t - d0) / (n * t) as beta, (d0 - 2 * a * n * a + n * a * a) / n as delta from {out}_v),
{out}_s as (select window_id, case when least(beta, delta) = 0 then 0 else least(beta, delta) / delta end as shrinkage from {out}_u),
{out} as (select window_id, i, j, (1 - shrinkage) * rho as rho from {of} join {out}_s using (window_id))"""


def matrix(of: str, out: str) -> str:
    """Pairs i < j to one matrix a window, assets in name order."""
    return f"""{out}_x as (select window_id, i as a, j as b, rho from {of} union all select window_id, j, i, rho from {of}
  union all select distinct window_id, a, a, 1.0 from (select window_id, i as a from {of} union all select window_id, j from {of})),
{out} as (select window_id, count(*) filter (a = b) as n, list(a order by a) filter (a = b) as names, list(greatest(-1.0, least(1.0, rho)) order by a, b) as m from {out}_x group by window_id)"""


def eigen(of: str, out: str, sweeps: int = 9) -> str:
    """(window_id, n, w, v): eigenvalues, and eigenvectors as columns of v, by
    rounds of Jacobi rotations. In a round of a circle tournament every index
    has one partner (or none), so a round's rotations don't touch each other."""
    last = "(n + n % 2 - 1)"  # rounds of a sweep; the index that stays in place
    turn = f"((2 * s - i) % {last} + {last}) % {last}"
    partner = f"case when i = {last} then s % {last} when {turn} = i then case when n % 2 = 1 then i else {last} end else {turn} end"
    row, col = "k // n", "k % n"
    lo, hi = "least(i, p[i + 1])", "greatest(i, p[i + 1])"
    return f"""{out}_r(window_id, n, s, a, v) as (
  select window_id, n, 0::bigint, m, list_transform(range(n * n), lambda k: case when {row} = {col} then 1.0::double else 0.0::double end) from {of}
  union all
  select window_id, n, s + 1,
    list_transform(range(n * n), lambda k: c[{row} + 1] * (c[{col} + 1] * a[k + 1] + g[{col} + 1] * a[{at(row, f'p[{col} + 1]')}])
      + g[{row} + 1] * (c[{col} + 1] * a[{at(f'p[{row} + 1]', col)}] + g[{col} + 1] * a[{at(f'p[{row} + 1]', f'p[{col} + 1]')}])),
    list_transform(range(n * n), lambda k: c[{col} + 1] * v[k + 1] + g[{col} + 1] * v[{at(row, f'p[{col} + 1]')}])
  from (select *, list_transform(t, lambda x: 1 / sqrt(1 + x * x)) as c, list_transform(range(n), lambda i: (case when i < p[i + 1] then -1 else 1 end) * t[i + 1] / sqrt(1 + t[i + 1] * t[i + 1])) as g
    from (select *, list_transform(h, lambda x: case when x is null then 0.0 else (case when x >= 0 then 1 else -1 end) / (abs(x) + sqrt(x * x + 1)) end) as t
      from (select *, list_transform(range(n), lambda i: case when p[i + 1] <> i then (a[{at(hi, hi)}] - a[{at(lo, lo)}]) / nullif(2 * a[{at(lo, hi)}], 0) end) as h
        from (select *, list_transform(range(n), lambda i: {partner}) as p from {out}_r where s < {sweeps} * {last}))))),
{out} as (select window_id, n, list_transform(range(n), lambda i: a[{at('i', 'i')}]) as w, v from {out}_r where s = {sweeps} * {last})"""


def clipped(of: str, observations: str, out: str) -> str:
    """A matrix with the eigenvalues under the random-matrix edge replaced by
    their mean; {out}_f has the fit: sigma_squared, lambda_plus, n_factors.
    observations: (window_id, t)."""
    edge = "s2 * pow(1 + sqrt(q), 2)"
    entry = f"list_sum(list_transform(range(n), lambda i: clean[i + 1] * v[{at('{0}', 'i')}] * v[{at('{1}', 'i')}]))"
    return f"""{eigen(of, f'{out}_e')},
{out}_q as (select e.*, n / t::double as q from {out}_e e join {observations} using (window_id)),
{out}_i(window_id, q, w, it, s2, done) as (
  select window_id, q, w, 0, 1.0::double, false from {out}_q
  union all
  select window_id, q, w, it + 1, coalesce(mean, s2), mean is null or abs(mean - s2) < 1e-12
  from (select *, list_avg(list_filter(w, lambda x: x <= {edge})) as mean from {out}_i where not done and it < 100)),
{out}_s as (select window_id, arg_max(s2, it) as s2 from {out}_i group by 1),
{out}_f as (select *, {edge} as lambda_plus, len(list_filter(w, lambda x: x > {edge})) as n_factors from {out}_q join {out}_s using (window_id)),
{out}_c as (select *, list_transform(w, lambda x: case when x > lambda_plus then x else list_avg(list_filter(w, lambda y: y <= lambda_plus)) end) as clean from {out}_f),
{out}_m as (select window_id, n, n_factors, list_transform(range(n * n), lambda k: {entry.format('k // n', 'k % n')}) as r from {out}_c),
{out} as (select window_id, n, names, list_transform(range(n * n), lambda k: case when k // n = k % n then 1.0 when n_factors = 0 then 0.0
    else greatest(-1.0, least(1.0, r[k + 1] / sqrt(r[{at('k // n', 'k // n')}]) / sqrt(r[{at('k % n', 'k % n')}]))) end) as m from {out}_m join (select window_id, names from {of}) using (window_id))"""


def spectral(of: str, out: str) -> str:
    """(window_id, n, spectrum, mean_correlation, absorption_ratio, pc1_share,
    effective_dimension, condition_number) of matrices."""
    return f"""{eigen(of, f'{out}_e')},
{out}_w as (select e.window_id, e.n, list_reverse_sort(e.w) as spectrum, (list_sum(m) - e.n) / (e.n * (e.n - 1)) as mean_correlation from {out}_e e join {of} c on e.window_id = c.window_id),
{out} as (select *, list_sum(spectrum[:greatest(1, round(0.2 * n))::bigint]) / list_sum(spectrum) as absorption_ratio, spectrum[1] / list_sum(spectrum) as pc1_share,
  pow(list_sum(spectrum), 2) / list_sum(list_transform(spectrum, lambda x: x * x)) as effective_dimension,
  case when spectrum[n] <= 1e-12 then 'inf'::double else spectrum[1] / spectrum[n] end as condition_number from {out}_w)"""


def entries(of: str, out: str) -> str:
    """(window_id, i, j, rho, d) of i < j from matrices."""
    return f"""{out}_k as (select window_id, n, names, m, unnest(range(n * n)) as k from {of}),
{out} as (select window_id, names[k // n + 1] as i, names[k % n + 1] as j, m[k + 1] as rho, sqrt(2 * (1 - m[k + 1])) as d from {out}_k where k // n < k % n)"""


def linkage(of: str, out: str, method: str = "average") -> str:
    """(window_id, n, step, lft, rgt, height, size, la, lb): the merges, and the
    leaves of both sides in their order. d holds distances of live clusters."""
    x, y = f"d[{at('i', 'x')}]", f"d[{at('j', 'x')}]"
    new = {
        "single": f"least({x}, {y})", "complete": f"greatest({x}, {y})", "average": f"(sa * {x} + sb * {y}) / (sa + sb)",
        "ward": f"sqrt(greatest(((sizes[x + 1] + sa) * {x} * {x} + (sizes[x + 1] + sb) * {y} * {y} - sizes[x + 1] * h * h) / (sizes[x + 1] + sa + sb), 0))",
    }[method]
    row, col = "k // n", "k % n"
    return f"""{out}_r(window_id, n, step, d, sizes, ids, leaves, lft, rgt, height, size, la, lb) as (
  select window_id, n, -1::bigint, list_transform(range(n * n), lambda k: case when {row} <> {col} then sqrt(2 * (1 - m[k + 1])) end), list_transform(range(n), lambda i: 1.0::double), range(n), list_transform(range(n), lambda i: [i]),
    null::bigint, null::bigint, null::double, null::bigint, null::bigint[], null::bigint[] from {of}
  union all
  select window_id, n, step + 1,
    list_transform(range(n * n), lambda k: case when {row} = j or {col} = j then null when {row} = i then fresh[{col} + 1] when {col} = i then fresh[{row} + 1] else d[k + 1] end),
    list_transform(range(n), lambda x: case when x = i then sa + sb else sizes[x + 1] end), list_transform(range(n), lambda x: case when x = i then n + step + 1 else ids[x + 1] end),
    list_transform(range(n), lambda x: case when x = i then f || l else leaves[x + 1] end), least(ids[i + 1], ids[j + 1]), greatest(ids[i + 1], ids[j + 1]), h, (sa + sb)::bigint, f, l
  from (select *, list_transform(range(n), lambda x: case when {x} is not null and {y} is not null then {new} end) as fresh,
      case when ids[i + 1] < ids[j + 1] then leaves[i + 1] else leaves[j + 1] end as f, case when ids[i + 1] < ids[j + 1] then leaves[j + 1] else leaves[i + 1] end as l
    from (select *, sizes[i + 1] as sa, sizes[j + 1] as sb from (select *, (place - 1) // n as i, (place - 1) % n as j
      from (select *, list_min(d) as h, list_position(d, list_min(d)) as place from {out}_r where step < n - 2))))),
{out} as (select window_id, n, step, lft, rgt, height, size, la, lb from {out}_r where step >= 0)"""


def cophenetic(links: str, of: str, out: str) -> str:
    """(window_id, cophenetic, depth_ratio, leaf_order); cophenetic is null where
    distances or heights don't vary."""
    return f"""{out}_p as (select window_id, height, a, unnest(lb) as b from (select window_id, height, unnest(la) as a, lb from {links})),
{out}_d as (select p.window_id, p.height, sqrt(2 * (1 - m[{at('a', 'b')}])) as d from {out}_p p join {of} c on p.window_id = c.window_id),
{out}_c as (select window_id, case when least(stddev_pop(d), stddev_pop(height)) > 1e-12 then corr(d, height) end as cophenetic from {out}_d group by 1),
{out}_h as (select window_id, list_reverse_sort(list(height)) as h, arg_max(la || lb, step) as leaf_order from {links} group by 1),
{out} as (select window_id, cophenetic, (h[1] - h[2]) / h[1] as depth_ratio, leaf_order from {out}_c join {out}_h using (window_id))"""


def flat(links: str, of: str, out: str) -> str:
    """(window_id, asset, cluster): at most max(2, min(8, n // 4)) clusters,
    numbered by first leaf; heights must differ."""
    return f"""{out}_l as (select window_id, n, names, unnest(range(n)) as leaf from {of}),
{out}_m as (select l.window_id, l.names, l.leaf, max(k.step) as top from {out}_l l left join {links} k on k.window_id = l.window_id and k.step < l.n - greatest(2, least(8, l.n // 4)) and list_contains(k.la || k.lb, l.leaf) group by all),
{out}_f as (select *, min(leaf) over (partition by window_id, coalesce(top, -1 - leaf)) as head from {out}_m),
{out} as (select window_id, names[leaf + 1] as asset, dense_rank() over (partition by window_id order by head)::int as cluster from {out}_f)"""


def parity(order: str, of: str, returns: str, out: str) -> str:
    """(window_id, asset, h, v): hierarchical risk parity and inverse-variance
    weights; order has leaf_order, covariances are rho * sd * sd."""
    def risk(items: str) -> str:
        total = f"list_sum(list_transform({items}, lambda i: 1 / (sd[i + 1] * sd[i + 1])))"
        both = f"list_sum(list_transform({items}, lambda i: list_sum(list_transform({items}, lambda j: m[{at('i', 'j')}] / (sd[i + 1] * sd[j + 1])))))"
        return f"{both} / pow({total}, 2)"

    return f"""{out}_s as (select window_id, list(s order by asset) as sd from (select window_id, asset, stddev_samp(ret) as s from {returns} group by all) group by 1),
{out}_b as (select c.window_id, c.n, c.names, c.m, s.sd, o.leaf_order from {of} c join {out}_s s on c.window_id = s.window_id join {order} o on c.window_id = o.window_id),
{out}_r(window_id, n, m, sd, items, w) as (
  select window_id, n, m, sd, leaf_order, 1.0::double from {out}_b
  union all
  select window_id, n, m, sd, case when side = 0 then a else b end, w * case when side = 0 then 1 - ra / (ra + rb) else ra / (ra + rb) end
  from (select *, {risk('a')} as ra, {risk('b')} as rb, unnest([0, 1]) as side from (select *, items[:len(items) // 2] as a, items[len(items) // 2 + 1:] as b from {out}_r where len(items) > 1))),
{out}_v as (select window_id, unnest(names) as asset, unnest(list_transform(sd, lambda x: 1 / (x * x) / list_sum(list_transform(sd, lambda y: 1 / (y * y))))) as v from {out}_b),
{out}_h as (select r.window_id, b.names[r.items[1] + 1] as asset, w as h from {out}_r r join {out}_b b using (window_id) where len(r.items) = 1),
{out} as (select window_id, asset, h, v from {out}_h join {out}_v using (window_id, asset))"""
