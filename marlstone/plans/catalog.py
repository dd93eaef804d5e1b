"""Named queries over the driver's tables, with SQL that must agree.

Each query builds a panel, aligns it and runs one operator. Doubles are rounded
to ``PLACES`` so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import figures, kernels
from ..operators import alignment, backtest, rolling, structure
from ..sources import panels, store, universes
from ..sources.shared import cut, new_path
from . import dense_sql, experiments

PLACES = 7
TIE = 1.23e-7
WINDOW, STEP = 104, 26
LOOKBACK, EVERY = 60, 21

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, negative zero made zero, timestamps as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            # prices often end in an exact half, which two engines round apart
            c = F.round(c + TIE, 4) if name == "price" else F.round(c, PLACES) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def prices(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return panels.panel(spark, sf_dir, key)


def returns(spark: SparkSession, sf_dir: str, key: str, limit: int = 3) -> DataFrame:
    """The aligned returns, cut: a row per date and asset, which most queries
    read more than once."""
    return cut(alignment.returns_panel(prices(spark, sf_dir, key).drop("grp"), limit=limit), "returns")


def groups(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return prices(spark, sf_dir, key).select("asset", "grp").distinct()


# -- SQL ---------------------------------------------------------------------


def r(expr: str, name: str) -> str:
    return f"round({expr} + {TIE}, 4) as {name}" if name == "price" else f"round({expr}, {PLACES}) + 0.0 as {name}"


def day(c: str = "date") -> str:
    return f"strftime({c}, '%Y-%m-%d') as {c}"


def aligned_sql(key: str, limit: int = 3, start: str | None = None, tag: str = "") -> str:
    """CTEs k, sp, kept, cells, gp, px (aligned prices) and rt (log returns)."""
    t = tag
    where = f"where date >= '{start}'" if start else ""
    return f"""k{t} as (select date, asset, price from ({panels.SQL[key]}) {where}),
sp{t} as (select *, not late and (max(case when not late then l end) over ())::date - l::date > 7 as stale from (
  select *, f::date - (min(f) over ())::date > 7 as late from (select asset, min(date) as f, max(date) as l from k{t} group by asset))),
kept{t} as (select asset, l from sp{t} where not late and not stale),
own{t} as (select k{t}.* from k{t} semi join kept{t} using (asset)),
cells{t} as (select g.date, g.asset, g.l, o.price, last_value(o.price ignore nulls) over (partition by g.asset order by g.date rows between {limit} preceding and current row) as value
  from (select d.date, kept{t}.asset, kept{t}.l from (select distinct date from own{t}) d cross join kept{t}) g left join own{t} o on g.date = o.date and g.asset = o.asset),
gp{t} as (select asset, count(*) filter (price is null and value is not null) as filled, count(*) filter (value is null) as gaps, count(*) filter (value is null and date > l) as tail from cells{t} group by asset),
px{t} as (select date, asset, value as price from cells{t} semi join (select asset from gp{t} where gaps = 0) using (asset)),
rt{t} as (select date, asset, ret from (select date, asset, ln(price) - lag(ln(price)) over (partition by asset order by date) as ret from px{t}) where ret is not null)"""


PAIRS = "pr as (select a.asset as i, b.asset as j, corr(a.ret, b.ret) as rho from rt a join rt b on a.date = b.date and a.asset < b.asset group by all),\ndd as (select i, j, sqrt(2 * (1 - rho)) as d from pr)"


def tree_sql(rounds: int, by: str = "") -> str:
    """CTE mst from dd, by squaring the (min, max) matrix."""
    b = f"{by}, " if by else ""
    on = f"a.{by} = b.{by} and " if by else ""
    ab = f"a.{by}, " if by else ""
    out = [f"b0 as (select {b}i, j, d from dd union all select {b}j, i, d from dd)"]
    for n in range(rounds):
        out.append(f"b{n + 1} as (select {b}i, j, min(d) as d from (select * from b{n} union all select {ab}a.i, b.j, greatest(a.d, b.d) from b{n} a join b{n} b on {on}a.j = b.i and a.i <> b.j) group by all)")
    using = f"{by}, i, j" if by else "i, j"
    return ",\n".join(out) + f",\nmst as (select dd.* from dd join b{rounds} m using ({using}) where dd.d <= m.d)"


def windows_sql(window: int = WINDOW, step: int = STEP) -> str:
    """CTE wr: returns once per window, with window_id."""
    return f"""ps as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from rt)),
ws as (select unnest(range(0, ((select max(pos) + 1 - {window} from ps) // {step})::bigint + 1)) as window_id),
wr as (select ws.window_id, rt.date, rt.asset, rt.ret from rt join ps using (date) join ws on ps.pos >= ws.window_id * {step} and ps.pos < ws.window_id * {step} + {window})"""


def weights_sql(signal: str, share: str, length: int = LOOKBACK) -> str:
    """CTE wt: weights on decision dates from CTE rt."""
    return f"""ps as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from rt)),
na as (select count(distinct asset) as n from rt),
sg as (select rt.date, asset, ret, pos, n, {signal} as s from rt join ps using (date) cross join na window w as (partition by asset order by rt.date rows between {length - 1} preceding and current row)),
wt as (select date, asset, case when pos >= {length - 1} and (pos - {length - 1}) % {EVERY} = 0 then {share} end as weight from sg)"""


MOMENTUM = weights_sql(f"case when count(*) over w >= {LOOKBACK} then sum(ret) over w end", "case when s > 0 then 1.0 else 0.0 end / n")
DAILY = """tg as (select rt.date, rt.asset, ret, coalesce(last_value(weight ignore nulls) over (partition by rt.asset order by rt.date rows between unbounded preceding and current row), 0.0) as target
  from rt left join wt on rt.date = wt.date and rt.asset = wt.asset),
hd as (select *, coalesce(lag(target) over (partition by asset order by date), 0.0) as held from tg),
dy as (select date, sum(held * ret) as gross, sum(abs(target - held)) as turnover, sum(held) as exposure from hd group by date)"""
CURVE = """nt as (select *, gross - turnover * 0.0025 as net from dy),
eq as (select *, product(1 + net) over (order by date rows between unbounded preceding and current row) as equity from nt),
cv as (select *, equity / max(equity) over (order by date rows between unbounded preceding and current row) - 1 as drawdown from eq)"""
PPY = """with_ppy as (select *, case when n < 2 or dd_ <= 0 then 252.0 else n / (dd_ / 365.25) end as ppy from (
  select avg(net) as m, stddev_samp(net) as s, count(*)::double as n, max(date)::date - min(date)::date as dd_, arg_max(equity, date) as e, min(drawdown) as mdd, avg(turnover) as t, avg(exposure) as x from cv))"""
FIGURES = f"""select {r("m / s * sqrt(ppy)", "sharpe")}, {r("m / s * sqrt(ppy) * sqrt(n / ppy)", "t_statistic")}, {r("case when e >= 0 then pow(e, ppy / n) - 1 end", "cagr")}, {r("s * sqrt(ppy)", "vol")},
  {r("mdd", "max_drawdown")}, {r("t * ppy", "turnover_per_year")}, {r("x", "average_exposure")}, n::bigint as n_obs, {r("ppy", "periods_per_year")} from with_ppy"""
STATS = f"{PPY}\n{FIGURES}"
STATS_TABLE = f"{PPY},\nsx as ({FIGURES})"


# -- panels ------------------------------------------------------------------

for _key in panels.PANELS:
    _d = day() if _key != "PN-H" else "strftime(date, '%Y-%m-%d %H:%M:%S') as date"
    query(f"panel_{_key[3:].lower()}", f"select {_d}, asset, grp, {r('price', 'price')} from ({panels.SQL[_key]})")(lambda s, d, key=_key: prices(s, d, key))

query("aligned_prices", f"with {aligned_sql('PN-S')} select {day()}, asset, {r('price', 'price')} from px")(lambda s, d: alignment.align(prices(s, d, "PN-S")).prices)
query("aligned_prices_hourly", f"with {aligned_sql('PN-H', 6)} select strftime(date, '%Y-%m-%d %H:%M:%S') as date, asset, {r('price', 'price')} from px")(lambda s, d: alignment.align(prices(s, d, "PN-H"), limit=6).prices)

REPORT = """select sp.asset, case when reason is null then 'retained' else 'dropped' end as status, reason, gaps, filled from (
  select sp.asset, case when late then 'history starts ' || strftime(f, '%Y-%m-%d') when stale then 'history ends ' || strftime(l, '%Y-%m-%d')
    when tail > 0 and tail = gaps then 'no data after ' || strftime(l, '%Y-%m-%d') || ' (delisting or halt); ' || gaps || ' missing sessions'
    when gaps > 0 then gaps || ' unfillable gaps (> 3d)' end as reason, coalesce(gaps, 0) as gaps, coalesce(filled, 0) as filled from sp left join gp using (asset)) sp"""
query("panel_report", f"with {aligned_sql('PN-S')} {REPORT}")(lambda s, d: alignment.align(prices(s, d, "PN-S")).report)
query(
    "panel_summary",
    f"""with {aligned_sql('PN-S')}, rp as ({REPORT})
select count(*) as requested, count(*) filter (status = 'retained') as retained, sum(filled)::bigint as filled_values, (select strftime(min(date), '%Y-%m-%d') from px) as start, (select strftime(max(date), '%Y-%m-%d') from px) as "end", (select count(distinct date) from px) as n_obs from rp""",
)(lambda s, d: alignment.align(prices(s, d, "PN-S")).summary)
query("log_returns", f"with {aligned_sql('PN-S')} select {day()}, asset, {r('ret', 'ret')} from rt")(lambda s, d: returns(s, d, "PN-S"))
STARTS = ["1995-01-02", "1997-01-06", "1999-01-04"]
query(
    "coverage_frontier",
    "with " + ",\n".join(aligned_sql("PN-S", 3, s, str(k)) for k, s in enumerate(STARTS)) + "\n" + "\nunion all ".join(
        f"select '{s}' as start, count(distinct asset) as n_assets, count(distinct date) as n_obs, {r('round(count(distinct asset) / 252.0, 3)', 'q_at_252')} from px{k}" for k, s in enumerate(STARTS)),
)(lambda s, d: alignment.coverage_frontier(prices(s, d, "PN-S"), STARTS))
query(
    "explore_holdout",
    f"""with {aligned_sql('PN-F')}, ps as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from rt)), c as (select floor(count(*) * 0.7)::bigint as c from ps)
select case when pos < c then 'explore' else 'holdout' end as part, count(*) as n, strftime(min(date), '%Y-%m-%d') as first, strftime(max(date), '%Y-%m-%d') as last from ps cross join c group by 1""",
)(lambda s, d: _parts(returns(s, d, "PN-F")))


def _parts(rt: DataFrame) -> DataFrame:
    a, b = alignment.split(rt)
    both = a.withColumn("part", F.lit("explore")).unionByName(b.withColumn("part", F.lit("holdout")))
    return both.select("part", "date").distinct().groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


# -- structure ---------------------------------------------------------------

for _key, _name in (("PN-E", "events"), ("PN-S", "nations"), ("PN-M", "monthly")):
    _base = f"with {aligned_sql(_key)}, {PAIRS}"
    query(f"sample_correlation_{_name}", f"{_base} select i, j, {r('rho', 'rho')} from pr")(lambda s, d, key=_key: structure.sample_correlation(returns(s, d, key)))
    query(f"coupling_{_name}", f"{_base}, n as (select count(distinct asset)::double as n from rt) select {r('avg(rho)', 'mean_correlation')}, {r('max(n) * max(n) / (max(n) + 2 * sum(rho * rho))', 'effective_dimension')} from pr cross join n")(
        lambda s, d, key=_key: structure.coupling(structure.sample_correlation(returns(s, d, key))))
    query(
        f"ledoit_wolf_{_name}",
        f"""{_base}, zz as (select date, asset, (ret - avg(ret) over w) / stddev_samp(ret) over w as z from rt window w as (partition by asset)),
ds as (select date, sum(z * z) as s, count(*) as n from zz group by date), p as (select sum(s * s) as b, count(*)::double as t, max(n)::double as n from ds), q as (select sum(rho * rho) as r from pr),
v as (select b, t, n, (t - 1) / t as a, pow((t - 1) / t, 2) * (n + 2 * r) as d0 from p cross join q),
u as (select (b / t - d0) / (n * t) as beta, (d0 - 2 * a * n * a + n * a * a) / n as delta from v), sh as (select case when least(beta, delta) = 0 then 0 else least(beta, delta) / delta end as s from u)
select i, j, {r('(1 - s) * rho', 'rho')}, {r('s', 'shrinkage')} from pr cross join sh""",
    )(lambda s, d, key=_key: structure.ledoit_wolf(returns(s, d, key)))

for _key, _name, _rounds in (("PN-E", "", 2), ("PN-S", "_nations", 5)):
    _tree = f"with {aligned_sql(_key)}, {PAIRS}, {tree_sql(_rounds)}"
    _edges = lambda s, d, key=_key: structure.mst(structure.distances(structure.sample_correlation(returns(s, d, key))))
    query(f"mst_edges{_name}", f"{_tree} select i as source, j as target, {r('d', 'distance')} from mst")(_edges)
    query(f"mst_hub{_name}", f"{_tree}, g as (select asset, count(*) as degree from (select i as asset from mst union all select j from mst) group by 1) select asset as hub, degree from g order by degree desc, asset limit 1")(
        lambda s, d, e=_edges: structure.hub(e(s, d)))
    query(f"tree_length{_name}", f"{_tree} select {r('avg(d)', 'tree_length')}, count(*) as n_edges from mst")(lambda s, d, e=_edges: structure.tree_length(e(s, d)))
    query(f"degrees{_name}", f"{_tree} select asset, count(*) as degree from (select i as asset from mst union all select j from mst) group by 1")(lambda s, d, e=_edges: structure.degrees(e(s, d)))
    query(
        f"group_purity{_name}",
        f"""{_tree}, gr as (select distinct asset, grp from ({panels.SQL[_key]})), nd as (select distinct asset from (select i as asset from mst union all select j from mst)),
c as (select grp, count(*)::double as c from nd join gr using (asset) group by grp), bl as (select sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) as b from c),
pu as (select avg(case when x.grp = y.grp then 1.0 else 0.0 end) as p, count(*) as n from mst join gr x on x.asset = mst.i join gr y on y.asset = mst.j)
select {r('p', 'purity')}, {r('b', 'baseline')}, case when b > 0 then round(p / b, {PLACES}) + 0.0 end as lift, n as n_edges from pu cross join bl""",
    )(lambda s, d, e=_edges, key=_key: structure.group_purity(e(s, d), groups(s, d, key)))

query("mst_relational", f"with {aligned_sql('PN-E')}, {PAIRS}, {tree_sql(2)} select i as source, j as target, {r('d', 'distance')} from mst")(
    lambda s, d: structure.mst_relational(structure.distances(structure.sample_correlation(returns(s, d, "PN-E"))), 5))
_dist = f"with {aligned_sql('PN-S')}, {PAIRS}"
query("distances", f"{_dist} select i, j, {r('d', 'distance')} from dd")(lambda s, d: structure.distances(structure.sample_correlation(returns(s, d, "PN-S"))))
query("nearest_neighbours", f"{_dist}, b as (select i, j, d from dd union all select j, i, d from dd) select i, j, {r('d', 'distance')}, rank::int as rank from (select *, row_number() over (partition by i order by d, j) as rank from b) where rank <= 5")(
    lambda s, d: structure.nearest(structure.distances(structure.sample_correlation(returns(s, d, "PN-S"))), 5))
# three planted distances break the triangle rule, and two planted assets don't vary
query("metric_violations", f"{_dist}, dp as (select i, j, d from dd union all values ('X', 'Y', 1.9::double), ('X', 'Z', 0.5::double), ('Y', 'Z', 0.6::double)), b as (select i, j, d from dp union all select j, i, d from dp) select dp.i, dp.j, x.j as k from dp join b x on x.i = dp.i join b y on y.i = x.j and y.j = dp.j where dp.d > x.d + y.d + 1e-9")(
    lambda s, d: structure.metric_violations(structure.distances(structure.sample_correlation(returns(s, d, "PN-S"))).unionByName(s.createDataFrame([("X", "Y", 1.9), ("X", "Z", 0.5), ("Y", "Z", 0.6)], "i string, j string, distance double"))))
query("constant_assets", f"with {aligned_sql('PN-S')}, rp as (select date, asset, ret from rt union all select distinct date, 'FLAT', 0.25 from rt union all select max(date), 'ONCE', 0.1 from rt) select asset from rp group by asset having coalesce(stddev_samp(ret), 0) <= 100 * 2.220446049250313e-16 * greatest(max(abs(ret)), 1.0)")(
    lambda s, d: structure.constant_assets(_flattened(returns(s, d, "PN-S"))))


def _flattened(rt: DataFrame) -> DataFrame:
    flat = rt.select("date").distinct().select("date", F.lit("FLAT").alias("asset"), F.lit(0.25).alias("ret"))
    once = rt.agg(F.max("date").alias("date")).select("date", F.lit("ONCE").alias("asset"), F.lit(0.1).alias("ret"))
    return rt.select("date", "asset", "ret").unionByName(flat).unionByName(once)


_cov = f"with {aligned_sql('PN-S')}, {PAIRS}, sd as (select asset, stddev_samp(ret) as s from rt group by asset), cv as (select i, j, rho * x.s * y.s as cov from pr join sd x on x.asset = i join sd y on y.asset = j union all select asset, asset, s * s from sd)"
query("covariance", f"{_cov} select i, j, round(cov, {PLACES}) + 0.0 as cov from cv")(lambda s, d: structure.covariance(structure.sample_correlation(returns(s, d, "PN-S")), returns(s, d, "PN-S")))
_ivp = "iw as (select asset, (1 / v) / sum(1 / v) over () as w from (select asset, var_samp(ret) as v from rt group by asset))"
query("inverse_variance_weights", f"with {aligned_sql('PN-S')}, {_ivp} select asset, {r('w', 'weight')} from iw")(lambda s, d: structure.inverse_variance_weights(returns(s, d, "PN-S")))
query("effective_positions", f"with {aligned_sql('PN-S')}, {_ivp} select {r('1 / sum(w * w)', 'effective_positions')} from iw")(lambda s, d: structure.effective_positions(structure.inverse_variance_weights(returns(s, d, "PN-S"))))
query("portfolio_variance", f"{_cov}, {_ivp} select {r('sum(case when i = j then 1 else 2 end * x.w * y.w * cov)', 'variance')} from cv join iw x on x.asset = i join iw y on y.asset = j")(
    lambda s, d: structure.portfolio_variance(structure.covariance(structure.sample_correlation(returns(s, d, "PN-S")), returns(s, d, "PN-S")), structure.inverse_variance_weights(returns(s, d, "PN-S"))))
query(
    "adjusted_rand",
    """with v as (select vec_id, label as a, (case when embedding[1] > 0 then 1 else 0 end + case when embedding[2] > 0 then 2 else 0 end) as b from embeddings),
n as (select a, b, count(*)::double as n from v group by all), x as (select sum(n * (n - 1) / 2) as ij, sum(n) as t from n),
y as (select sum(m * (m - 1) / 2) as si from (select sum(n) as m from n group by a)), z as (select sum(m * (m - 1) / 2) as sj from (select sum(n) as m from n group by b))
select """ + r("(ij - si * sj / (t * (t - 1) / 2)) / ((si + sj) / 2 - si * sj / (t * (t - 1) / 2))", "ari") + " from x cross join y cross join z",
)(lambda s, d: _rand(s, d))


def _rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = panels.read(spark, sf_dir, "embeddings")
    a = v.select(F.col("vec_id").alias("asset"), F.col("label").alias("cluster"))
    b = v.select(F.col("vec_id").alias("asset"), (F.when(F.col("embedding")[0] > 0, 1).otherwise(0) + F.when(F.col("embedding")[1] > 0, 2).otherwise(0)).alias("cluster"))
    return structure.adjusted_rand(a, b)


# -- matrix stage ------------------------------------------------------------

_three = f"""with {aligned_sql('PN-F')}, {PAIRS}, c as (select sum(rho * rho) as p1, 2 * product(rho) as dt from pr),
e as (select 2 * sqrt(p1 / 3) as p, acos(greatest(-1, least(1, (dt / 2) / pow(p1 / 3, 1.5)))) / 3 as phi from c),
w as (select 1 + p * cos(phi) as l1, 1 + p * cos(phi + 2 * pi() / 3) as l3 from e)"""
query(
    "spectrum_indices",
    f"{_three} select {r('l1', 'l1')}, {r('3 - l1 - l3', 'l2')}, {r('l3', 'l3')}, {r('l1 / 3', 'pc1_share')}, {r('l1 / 3', 'absorption_ratio')}, {r('9 / (l1 * l1 + (3 - l1 - l3) * (3 - l1 - l3) + l3 * l3)', 'effective_dimension')}, {r('l1 / l3', 'condition_number')} from w",
)(lambda s, d: _matrix(s, d, "PN-F", "sample").select(*(F.col("spectrum")[k].alias(f"l{k + 1}") for k in range(3)), "pc1_share", "absorption_ratio", "effective_dimension", "condition_number"))


def _matrix(spark: SparkSession, sf_dir: str, key: str, estimator: str, method: str = "average") -> DataFrame:
    return structure.matrices(returns(spark, sf_dir, key).withColumn("one", F.lit(1)), ["one"], estimator, method)


ONE = "wr as (select 0 as window_id, date, asset, ret from rt)"


def estimated_sql(estimator: str) -> str:
    """CTEs from wr: wp (pairs), ob (dates of a window), cm (the estimator's
    matrices), fc (pairs of it), sh (shrinkage) or cm_f (random-matrix fit)."""
    out = [
        dense_sql.pairs("wr", "wp"),
        "ob as (select window_id, count(distinct date) as t, strftime(min(date), '%Y-%m-%d') as window_start, strftime(max(date), '%Y-%m-%d') as window_end from wr group by 1)",
    ]
    if estimator == "sample":
        out.append(dense_sql.matrix("wp", "cm"))
    elif estimator == "ledoit_wolf":
        out += [dense_sql.shrunk("wr", "wp", "lp"), dense_sql.matrix("lp", "cm")]
    else:
        out += [dense_sql.matrix("wp", "rm"), dense_sql.clipped("rm", "ob", "cm")]
    return ",\n".join([*out, dense_sql.entries("cm", "fc")])


def info_sql(estimator: str) -> tuple[str, str]:
    """(join, columns) of an estimator's own diagnostics, null for the others'."""
    fit = "n_factors::int as n_factors, " + r("lambda_plus", "lambda_plus") + ", " + r("s2", "sigma_squared") if estimator == "rmt_clipped" else "null::int as n_factors, null::double as lambda_plus, null::double as sigma_squared"
    shrinkage = r("shrinkage", "shrinkage") if estimator == "ledoit_wolf" else "null::double as shrinkage"
    join = {"rmt_clipped": "join (select window_id, n_factors, lambda_plus, s2 from cm_f) using (window_id)", "ledoit_wolf": "join lp_s using (window_id)"}.get(estimator, "")
    return join, f"{fit}, {shrinkage}"


SPECTRAL = ", ".join(r(c, c) for c in ("mean_correlation", "absorption_ratio", "pc1_share", "effective_dimension", "condition_number"))
for _e in ("sample", "ledoit_wolf", "rmt_clipped"):
    _join, _info = info_sql(_e)
    query(f"matrix_{_e}", f"with recursive {aligned_sql('PN-S')}, {ONE}, {estimated_sql(_e)},\n{dense_sql.spectral('cm', 'sx')}\nselect n::int as n_assets, t::int as n_obs, {r('n / t::double', 'q')}, {SPECTRAL}, {_info} from sx join ob using (window_id) {_join}")(
        lambda s, d, e=_e: _matrix(s, d, "PN-S", e).select("n_assets", "n_obs", "q", "mean_correlation", "absorption_ratio", "pc1_share", "effective_dimension", "n_factors", "lambda_plus", "sigma_squared", "shrinkage", "condition_number"))
_shrunk = f"with recursive {aligned_sql('PN-S')}, {ONE}, {estimated_sql('ledoit_wolf')}"
for _m in ("single", "complete", "average", "ward"):
    query(f"linkage_{_m}", f"{_shrunk},\n{dense_sql.linkage('cm', 'lk', _m)}\nselect step::int as step, lft::int as \"left\", rgt::int as \"right\", {r('height', 'height')}, size::int as size from lk")(
        lambda s, d, m=_m: _matrix(s, d, "PN-S", "ledoit_wolf", m).select(F.posexplode("merges").alias("step", "m")).select("step", "m.*"))
LINKS = f"{dense_sql.linkage('cm', 'lk')},\n{dense_sql.cophenetic('lk', 'cm', 'co')}"
query("cluster_members", f"{_shrunk},\n{LINKS},\n{dense_sql.flat('lk', 'cm', 'fl')},\n{dense_sql.parity('co', 'cm', 'wr', 'hp')}\nselect asset, cluster, {r('h', 'hrp')}, {r('v', 'ivp')} from fl join hp using (window_id, asset)")(
    lambda s, d: _matrix(s, d, "PN-S", "ledoit_wolf").select(F.explode(F.arrays_zip("assets", "clusters", "hrp", "ivp")).alias("x")).select(F.col("x.assets").alias("asset"), F.col("x.clusters").alias("cluster"), F.col("x.hrp").alias("hrp"), F.col("x.ivp").alias("ivp")))
ASOF = "1997-12-31"
_asof = f"""with recursive {aligned_sql('PN-S')}, wd as (select date from (select distinct date from rt) where date <= date '{ASOF}' order by date desc limit {WINDOW}), wr as (select 0 as window_id, date, asset, ret from rt join wd using (date)), {estimated_sql('rmt_clipped')}"""
query("clustering_asof", f"{_asof},\n{LINKS}\nselect {r('cophenetic', 'cophenetic')}, {r('depth_ratio', 'depth_ratio')}, array_to_string(list_transform(leaf_order, lambda i: names[i + 1]), ',') as leaf_order from co join (select window_id, names from cm) using (window_id)")(
    lambda s, d: rolling.clustering(returns(s, d, "PN-S"), ASOF, WINDOW).select("cophenetic", "depth_ratio", F.array_join("leaf_order", ",").alias("leaf_order")))
query("marchenko_pastur", "select q::double as q, s2::double as s2, round(s2 * pow(1 + sqrt(q), 2), 7) + 0.0 as edge from (values (0.0, 1.0), (0.25, 1.0), (1.0, 1.0), (0.25, 2.0)) t(q, s2)")(
    lambda s, d: s.createDataFrame([(0.0, 1.0), (0.25, 1.0), (1.0, 1.0), (0.25, 2.0)], "q double, s2 double").mapInPandas(lambda parts: (x.assign(edge=[float(kernels.marchenko_pastur_edge(q, v)) for q, v in zip(x["q"], x["s2"])]) for x in parts), "q double, s2 double, edge double"))


# -- rolling -----------------------------------------------------------------

_rolled = f"with {aligned_sql('PN-S')}, {windows_sql()}"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.hopping(returns(spark, sf_dir, "PN-S"), WINDOW, STEP)


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample correlations of every window from vectors of dates: no row goes to
    each of its windows, and no pairs of a window's rows are joined."""
    return rolling.rolling_matrices(returns(spark, sf_dir, "PN-S"), WINDOW, STEP, "sample", keep_matrix=False)


query("hopping_windows", f"{_rolled} select window_id::int as window_id, strftime(min(date), '%Y-%m-%d') as window_start, strftime(max(date), '%Y-%m-%d') as window_end, count(*) as n, count(distinct date) as n_obs from wr group by 1")(
    lambda s, d: _windows(s, d).groupBy("window_id", "window_start", "window_end").agg(F.count("*").alias("n"), F.countDistinct("date").alias("n_obs")))
_wpairs = "pr as (select a.window_id, a.asset as i, b.asset as j, corr(a.ret, b.ret) as rho from wr a join wr b on a.window_id = b.window_id and a.date = b.date and a.asset < b.asset group by all),\ndd as (select window_id, i, j, sqrt(2 * (1 - rho)) as d from pr)"
query("rolling_coupling", f"{_rolled}, {_wpairs}, n as (select count(distinct asset)::double as n from rt) select window_id::int as window_id, {r('avg(rho)', 'mean_correlation')}, {r('max(n) * max(n) / (max(n) + 2 * sum(rho * rho))', 'effective_dimension')} from pr cross join n group by 1")(
    lambda s, d: _sampled(s, d).select("window_id", "mean_correlation", "effective_dimension"))
_wedges = lambda s, d: _sampled(s, d).select("window_id", F.inline("edges"))
query("rolling_tree_length", f"{_rolled}, {_wpairs}, {tree_sql(5, 'window_id')} select window_id::int as window_id, {r('avg(d)', 'tree_length')}, count(*) as n_edges from mst group by 1")(lambda s, d: structure.tree_length(_wedges(s, d), ["window_id"]))
query("edge_survival", f"{_rolled}, {_wpairs}, {tree_sql(5, 'window_id')}, sv as (select y.window_id, count(x.i) / count(*)::double as s from mst p join (select distinct window_id from mst) y on y.window_id = p.window_id + 1 left join mst x on x.window_id = y.window_id and x.i = p.i and x.j = p.j group by 1) select w.window_id::int as window_id, {r('s', 'edge_survival')} from (select distinct window_id from mst) w left join sv using (window_id)")(
    lambda s, d: structure.edge_survival(_wedges(s, d), "window_id"))


def _built(spark: SparkSession, sf_dir: str, estimator: str) -> dict[str, DataFrame]:
    return rolling.windows_table(returns(spark, sf_dir, "PN-S"), groups(spark, sf_dir, "PN-S"), WINDOW, STEP, estimator)


def built_sql(estimator: str) -> str:
    """CTEs of the rolling build: wide (a row a window), mst, fl and hp besides
    those of estimated_sql."""
    join, info = info_sql(estimator)
    return f"""with recursive {aligned_sql('PN-S')}, {windows_sql()}, {estimated_sql(estimator)},
{dense_sql.spectral('cm', 'sx')},
{LINKS},
{dense_sql.flat('lk', 'cm', 'fl')},
{dense_sql.parity('co', 'cm', 'wr', 'hp')},
dd as (select window_id, i, j, d as length, row_number() over (partition by window_id order by d, i, j) as d from fc),
{tree_sql(5, 'window_id')},
gr as (select distinct asset, grp from ({panels.SQL['PN-S']})),
tl as (select window_id, avg(length) as tree_length from mst group by 1),
dg as (select window_id, asset, count(*) as degree from (select window_id, i as asset from mst union all select window_id, j from mst) group by all),
hb as (select window_id, arg_min(asset, (-degree, asset)) as hub from dg group by 1),
pu as (select window_id, avg(case when x.grp = y.grp then 1.0 else 0.0 end) as purity from mst join gr x on x.asset = mst.i join gr y on y.asset = mst.j group by 1),
bl as (select window_id, sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) as baseline from (select window_id, grp, count(*)::double as c from dg join gr using (asset) group by all) group by 1),
sv as (select y.window_id, count(x.i) / count(*)::double as edge_survival from mst p join (select distinct window_id from mst) y on y.window_id = p.window_id + 1 left join mst x on x.window_id = y.window_id and x.i = p.i and x.j = p.j group by 1),
wide as (select *, n / t::double as q, case when baseline > 0 then purity / baseline end as purity_lift from sx join ob using (window_id) join (select window_id, cophenetic, depth_ratio from co) using (window_id)
  join tl using (window_id) join hb using (window_id) join pu using (window_id) join bl using (window_id) left join sv using (window_id) {join})"""


_INDICES = ("q", "mean_correlation", "absorption_ratio", "pc1_share", "effective_dimension", "condition_number", "cophenetic", "depth_ratio", "tree_length", "purity", "purity_lift", "edge_survival")
for _e, _name in (("rmt_clipped", "rolling_windows"), ("sample", "rolling_windows_sample"), ("ledoit_wolf", "rolling_windows_ledoit_wolf")):
    query(_name, f"{built_sql(_e)}\nselect window_end, window_start, n::int as n_assets, t::int as n_obs, hub, {', '.join(r(c, c) for c in _INDICES)}, {info_sql(_e)[1]} from wide")(lambda s, d, e=_e: _built(s, d, e)["windows"])
query("rolling_edges", f"{built_sql('rmt_clipped')}\nselect window_end, i as source, j as target, {r('length', 'distance')} from mst join ob using (window_id)")(lambda s, d: _built(s, d, "rmt_clipped")["edges"].drop("window_id"))
_LAST = f"with recursive {aligned_sql('PN-S')}, wd as (select date from (select distinct date from rt) order by date desc limit {WINDOW}), wr as (select 0 as window_id, date, asset, ret from rt join wd using (date)), {estimated_sql('rmt_clipped')}"
query("correlation_at", f"{_LAST}\nselect i, j, {r('rho', 'rho')} from fc")(lambda s, d: _at_end(s, d))
query("window_frames", f"""{built_sql('rmt_clipped')}, fr as (select window_end, absorption_ratio, row_number() over (order by window_end) - 1 as k from wide where window_end between '1997-01-01' and '2001-12-31')
select window_end, (k // 2)::int as frame, row_number() over (order by absorption_ratio desc, window_end) = 1 as peak from fr where k % 2 = 0""")(lambda s, d: figures.frames(_built(s, d, "rmt_clipped")["windows"], "1997-01-01", "2001-12-31"))
query("window_ends", f"{built_sql('sample')}\nselect distinct window_end from wide")(lambda s, d: figures.window_ends(_built(s, d, "sample")["windows"]))
query("edges_at", f"{built_sql('sample')}\nselect i as source, j as target, {r('length', 'distance')} from mst where window_id = (select max(window_id) from mst)")(lambda s, d: _last_edges(s, d))
query("index_series", f"""{built_sql('sample')}, ev as (select date '1997-03-01' + (300 * k)::int as date, 'event ' || k as label from range(4) t(k)), si as (select window_end, absorption_ratio, mean_correlation, lag(window_end) over (order by window_end) as since from wide)
select window_end, {r('any_value(absorption_ratio)', 'absorption_ratio')}, {r('any_value(mean_correlation)', 'mean_correlation')}, coalesce(string_agg(label, ',' order by label), '') as labels from si left join ev on strftime(ev.date, '%Y-%m-%d') <= window_end and (since is null or strftime(ev.date, '%Y-%m-%d') > since) group by 1""")(
    lambda s, d: figures.index_series(_built(s, d, "sample")["windows"], s.range(4).select(F.date_add(F.lit("1997-03-01").cast("date"), (F.col("id") * 300).cast("int")).alias("date"), F.concat(F.lit("event "), F.col("id")).alias("label"))).withColumn("labels", F.array_join("labels", ",")))


def _at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    rt = returns(spark, sf_dir, "PN-S")
    end = rt.agg(F.max("date")).first()[0]
    m = rolling.correlation_at(rt, str(end), WINDOW).select("assets", F.posexplode("matrix").alias("i", "line"))
    m = m.select("assets", "i", F.posexplode("line").alias("j", "rho")).where("i < j")
    return m.select(F.col("assets")[F.col("i")].alias("i"), F.col("assets")[F.col("j")].alias("j"), "rho")


def _last_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _built(spark, sf_dir, "sample")
    return figures.at_window(t["edges"].drop("window_id"), str(t["windows"].agg(F.max("window_end")).first()[0]))


query("rolling_layout_drift")(lambda s, d: rolling.layout_drift(_built(s, d, "rmt_clipped")["layouts"]))
STABILITY = """n2 as (select x.window_id, x.cluster as a, y.cluster as b, count(*)::double as n from fl x join fl y on y.window_id = x.window_id - 1 and y.asset = x.asset group by all),
ij as (select window_id, sum(n * (n - 1) / 2) as ij, sum(n) as t from n2 group by 1), si as (select window_id, sum(m * (m - 1) / 2) as si from (select window_id, sum(n) as m from n2 group by window_id, a) group by 1),
sj as (select window_id, sum(m * (m - 1) / 2) as sj from (select window_id, sum(n) as m from n2 group by window_id, b) group by 1),
cs as (select window_id, case when (si + sj) / 2 - e = 0 then 1.0 else (ij - e) / ((si + sj) / 2 - e) end as cluster_stability from (select *, si * sj / (t * (t - 1) / 2) as e from ij join si using (window_id) join sj using (window_id)))"""
query("rolling_cluster_stability", f"{built_sql('ledoit_wolf')},\n{STABILITY}\nselect window_end, {r('cluster_stability', 'cluster_stability')} from cs join ob using (window_id)")(lambda s, d: rolling.cluster_stability(_built(s, d, "ledoit_wolf")["matrices"]))
ALLOCATION = """al as (select *, 1.0 / count(*) over (partition by window_id) as e, lag(h) over w as ph, lag(v) over w as pv from hp window w as (partition by asset order by window_id)),
aw as (select window_id, max(abs(h - v)) as max_gap_hrp_ivp, max(abs(h - e)) as max_gap_hrp_ew, corr(h, v) as corr_hrp_ivp, 1 / sum(h * h) as eff_n_hrp, 1 / sum(v * v) as eff_n_ivp, max(h) as max_weight_hrp, sum(abs(h - ph)) as turnover_hrp, sum(abs(v - pv)) as turnover_ivp from al group by 1)"""
query("allocation_sensitivity", f"{built_sql('ledoit_wolf')},\n{ALLOCATION}\nselect window_end, {', '.join(r(c, c) for c in rolling.ALLOCATION)} from aw join ob using (window_id)")(lambda s, d: rolling.allocation(_built(s, d, "ledoit_wolf")["matrices"]))
query(
    "allocation_summary",
    f"""{built_sql('ledoit_wolf')},
{ALLOCATION}
select count(*) as n_windows, {r('median(max_gap_hrp_ivp)', 'median_max_gap_hrp_ivp')}, {r('max(max_gap_hrp_ivp)', 'largest_max_gap_hrp_ivp')}, {r('median(max_gap_hrp_ew)', 'median_max_gap_hrp_ew')}, {r('median(corr_hrp_ivp)', 'median_corr_hrp_ivp')}, {r('min(corr_hrp_ivp)', 'least_corr_hrp_ivp')},
  {r('median(eff_n_hrp)', 'median_eff_n_hrp')}, {r('median(eff_n_ivp)', 'median_eff_n_ivp')}, {r('median(max_weight_hrp)', 'median_max_weight_hrp')}, {r('median(turnover_hrp)', 'median_turnover_hrp')}, {r('median(turnover_ivp)', 'median_turnover_ivp')},
  {r('quantile_cont(turnover_hrp, 0.9)', 'p90_turnover_hrp')}, {r('quantile_cont(turnover_ivp, 0.9)', 'p90_turnover_ivp')}, {r('median(turnover_hrp) / median(turnover_ivp)', 'turnover_ratio')} from aw""",
)(lambda s, d: rolling.allocation_summary(rolling.allocation(_built(s, d, "ledoit_wolf")["matrices"])))
DIAGNOSED = ("mean_correlation", "absorption_ratio", "pc1_share", "effective_dimension", "tree_length", "cophenetic", "depth_ratio", "edge_survival", "purity", "purity_lift", "cluster_stability")


@query(
    "diagnostic_summary",
    f"""{built_sql('ledoit_wolf')},
{STABILITY},
wc as (select wide.*, cluster_stability from wide left join cs using (window_id)),
ms as ({" union all ".join(f"select '{c}' as metric, {c} as v from wc" for c in DIAGNOSED)})
select metric, {r('min(v)', 'min')}, {r('median(v)', 'median')}, {r('max(v)', 'max')}, {r('quantile_cont(v, 0.25)', 'q25')}, {r('quantile_cont(v, 0.75)', 'q75')} from ms where v is not null group by 1""",
)
def _diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _built(spark, sf_dir, "ledoit_wolf")
    w = rolling.diagnostic_windows(t["matrices"], groups(spark, sf_dir, "PN-S"))
    return rolling.diagnostic_summary(w, [c for c in w.columns if c != "window_end"])


# -- signals and backtests ---------------------------------------------------

_f = f"with {aligned_sql('PN-F')}"


def _rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir, "PN-F")


def _momentum(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rt = _rt(spark, sf_dir)
    return rt, backtest.momentum_weights(rt, LOOKBACK, EVERY)


query("trailing_return", f"{_f} select {day()}, asset, {r('ret', 'ret')}, case when count(*) over w >= {LOOKBACK} then round(sum(ret) over w, {PLACES}) + 0.0 end as signal from rt window w as (partition by asset order by rt.date rows between {LOOKBACK - 1} preceding and current row)")(
    lambda s, d: backtest.trailing_return(_rt(s, d), LOOKBACK))
query("realised_volatility", f"{_f} select {day()}, asset, {r('ret', 'ret')}, case when count(*) over w >= {LOOKBACK} then round(stddev_samp(ret) over w * sqrt(252.0), {PLACES}) + 0.0 end as vol from rt window w as (partition by asset order by rt.date rows between {LOOKBACK - 1} preceding and current row)")(
    lambda s, d: backtest.realised_volatility(_rt(s, d), LOOKBACK, 252.0))
query("momentum_weights", f"{_f}, {MOMENTUM} select {day()}, asset, {r('weight', 'weight')} from wt")(lambda s, d: _momentum(s, d)[1])
_conc = MOMENTUM.replace("then case when s > 0 then 1.0 else 0.0 end / n end", "then coalesce(case when s > 0 then 1.0 else 0.0 end / nullif(count(*) filter (s > 0) over (partition by date), 0), 0.0) end")
query("concentrated_weights", f"{_f}, {_conc} select {day()}, asset, {r('weight', 'weight')} from wt")(lambda s, d: backtest.momentum_weights(_rt(s, d), LOOKBACK, EVERY, concentrated=True))
query(
    "volatility_managed_weights",
    f"""{_f}, ps as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from rt)), na as (select count(distinct asset) as n from rt), bs as (select date, avg(ret) as ret from rt group by date),
vl as (select date, case when count(*) over w >= {LOOKBACK} then stddev_samp(ret) over w * sqrt(252.0) end as vol from bs window w as (order by date rows between {LOOKBACK - 1} preceding and current row))
select strftime(rt.date, '%Y-%m-%d') as date, asset, case when pos >= {LOOKBACK - 1} and (pos - {LOOKBACK - 1}) % {EVERY} = 0 then round(least(1.0 / vol, 1.5) / n, {PLACES}) + 0.0 end as weight from rt join vl using (date) join ps using (date) cross join na""",
)(lambda s, d: backtest.volatility_managed_weights(_rt(s, d), 1.0, LOOKBACK))
for _ls in (False, True):
    _short = " when r > m - 1 then -1.0" if _ls else ""
    query(
        f"low_volatility_weights_{'ls' if _ls else 'long'}",
        f"""{_f}, ps as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from rt)),
vl as (select date, asset, case when count(*) over w >= {LOOKBACK} then stddev_samp(ret) over w end as vol from rt window w as (partition by asset order by date rows between {LOOKBACK - 1} preceding and current row)),
rk as (select *, row_number() over (partition by date order by vol nulls last, asset) as r, count(vol) over (partition by date) as m from vl join ps using (date))
select {day()}, asset, case when pos >= {LOOKBACK - 1} and (pos - {LOOKBACK - 1}) % {EVERY} = 0 and m >= 2 then round(case when vol is null then 0.0 when r <= 1 then 1.0{_short} else 0.0 end, {PLACES}) + 0.0 end as weight from rk""",
    )(lambda s, d, ls=_ls: backtest.low_volatility_weights(_rt(s, d), LOOKBACK, 0.2, ls))
query("backtest_path", f"{_f}, {MOMENTUM}, {DAILY}, {CURVE} select {day()}, {', '.join(r(c, c) for c in ('gross', 'turnover', 'exposure', 'net', 'equity', 'drawdown'))} from cv")(lambda s, d: backtest.run(*_momentum(s, d)))
query("backtest_stats", f"{_f}, {MOMENTUM}, {DAILY}, {CURVE}, {STATS}")(lambda s, d: backtest.stats(backtest.run(*_momentum(s, d))))
query(
    "backtest_summary",
    f"""{_f}, {MOMENTUM}, {DAILY}, {CURVE}, {STATS_TABLE} select 'Sharpe ' || coalesce(printf('%+.3f', sharpe), 'n/a') || '  CAGR ' || coalesce(printf('%+.2f%%', cagr * 100), 'n/a') || '  volatility ' || coalesce(printf('%.2f%%', vol * 100), 'n/a') || '  drawdown ' || coalesce(printf('%.2f%%', max_drawdown * 100), 'n/a')
  || '  turnover ' || coalesce(printf('%.1fx a year', turnover_per_year), 'n/a') || '  exposure ' || coalesce(printf('%.0f%%', average_exposure * 100), 'n/a') as summary from sx""",
)(lambda s, d: backtest.summary_text(backtest.stats(backtest.run(*_momentum(s, d)))))
query("panel_text", f"""with {aligned_sql('PN-S')}, rp as ({REPORT}) select format('{{}} of {{}} assets, {{}} rows from {{}} to {{}}, {{}} values filled', count(*) filter (status = 'retained'), count(*), (select count(distinct date) from px), (select strftime(min(date), '%Y-%m-%d') from px), (select strftime(max(date), '%Y-%m-%d') from px), sum(filled)::bigint) as summary from rp""")(
    lambda s, d: alignment.summary_text(alignment.align(prices(s, d, "PN-S"))))
query("returns_summary", f"""with {aligned_sql('PN-S')}, rp as ({REPORT})
select count(*) as requested, count(*) filter (status = 'retained') as retained, sum(filled)::bigint as filled_values, (select strftime(min(date), '%Y-%m-%d') from rt) as start, (select strftime(max(date), '%Y-%m-%d') from rt) as "end", (select count(distinct date) from rt) as n_obs from rp""")(
    lambda s, d: alignment.returns_report(prices(s, d, "PN-S"))[1].summary)
_equal = f"ps as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from rt)), na as (select count(distinct asset) as n from rt), wt as (select rt.date, asset, case when pos % {EVERY} = 0 then 1.0 / n end as weight from rt join ps using (date) cross join na)"
query("equal_weight_stats", f"{_f}, {_equal}, {DAILY}, {CURVE}, {STATS}")(lambda s, d: backtest.stats(backtest.run(_rt(s, d), backtest.equal_weights(_rt(s, d)))))
query("single_asset_stats", f"{_f}, wt as (select date, asset, case when asset = 'A' then 1.0 else 0.0 end as weight from rt), {DAILY}, {CURVE}, {STATS}")(lambda s, d: backtest.stats(backtest.run(_rt(s, d), backtest.single_asset_weights(_rt(s, d), "A"))))
query(
    "cost_sharpes",
    f"""{_f}, {MOMENTUM}, {DAILY}, mo as (select *, case when n < 2 or d <= 0 then 252.0 else n / (d / 365.25) end as ppy from (select avg(gross) as g, avg(turnover) as t, count(*)::double as n, max(date)::date - min(date)::date as d,
  stddev_samp(gross - turnover * 0.001) as s10, stddev_samp(gross - turnover * 0.0025) as s25, stddev_samp(gross - turnover * 0.005) as s50 from dy))
select {r('(g - t * 0.001) / s10 * sqrt(ppy)', 'sharpe_10')}, {r('(g - t * 0.0025) / s25 * sqrt(ppy)', 'sharpe_25')}, {r('(g - t * 0.005) / s50 * sqrt(ppy)', 'sharpe_50')},
  {r('case when g <= 0 then 0.0 when t = 0 then 500.0 * (1 - pow(2.0, -41)) else least(g / t * 1e4, 500.0 * (1 - pow(2.0, -41))) end', 'breakeven_bps')} from mo""",
)(lambda s, d: backtest.cost_sharpes(backtest.daily(*_momentum(s, d))).select(*(F.col("sharpe_by_cost")[str(c)].alias(f"sharpe_{c}") for c in (10, 25, 50)), "breakeven_bps"))
query("periods_per_year", f"{_f} select {r('count(distinct date) / ((max(date) - min(date)) / 365.25)', 'periods_per_year')} from rt")(lambda s, d: backtest.periods_per_year(_rt(s, d)))


# -- store, universes, experiments, figures ----------------------------------


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from the event stream, with an overlapping restatement."""
    e = panels.read(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), "value", "event_id")
    return e.groupBy("ticker", "date").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("close"), F.count("*").cast("double").alias("volume"))


_bars_sql = "bars as (select event_type as ticker, cast(ts as date) as date, min(value) as low, max(value) as high, avg(value) as close, count(*)::double as volume from events group by all), cut as (select max(date) - 7 as c from bars)"
_merged_sql = f"with {_bars_sql}, m as (select ticker, date, low, high, case when date >= c then close * 2 else close end as close, volume from bars cross join cut)"


def _restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    edge = b.agg(F.date_sub(F.max("date"), 7).alias("c"))
    tail = b.crossJoin(F.broadcast(edge)).where("date >= c").drop("c").withColumn("close", F.col("close") * 2)
    bars = store.Store(spark, new_path(spark, "bars"))
    bars.write(b)
    bars.write(tail)
    return bars.read()


query("store_upsert", f"{_merged_sql} select ticker, {day()}, {r('low', 'low')}, {r('high', 'high')}, {r('close', 'close')}, {r('volume', 'volume')} from m")(lambda s, d: _restated(s, d).select("ticker", "date", "low", "high", "close", "volume"))
query("store_coverage", f"{_merged_sql} select ticker, strftime(min(date), '%Y-%m-%d') as start, strftime(max(date), '%Y-%m-%d') as \"end\" from m group by 1")(lambda s, d: store.coverage(_restated(s, d)))
query("store_summary", f"{_merged_sql}, q as (select distinct ticker from m union all select 'MISSING') select ticker, count(date) as rows, strftime(min(date), '%Y-%m-%d') as start, strftime(max(date), '%Y-%m-%d') as \"end\" from q left join m using (ticker) group by 1")(
    lambda s, d: store.summary(_restated(s, d), _restated(s, d).select("ticker").distinct().union(s.createDataFrame([("MISSING",)], "ticker string"))))
query("fetch_starts", f"{_merged_sql}, q as (select distinct ticker from m union all select 'MISSING') select ticker, strftime(case when max(date) is null or min(date) > date '2024-01-10' then date '2024-01-10' else max(date) - 7 end, '%Y-%m-%d') as fetch_start from q left join m using (ticker) group by 1")(
    lambda s, d: store.fetch_starts(_restated(s, d).select("ticker").distinct().union(s.createDataFrame([("MISSING",)], "ticker string")), _restated(s, d), "2024-01-10"))
query("file_stems", "select c_name as name, regexp_replace(upper(trim(c_name)), '[^A-Z0-9]+', '_', 'g') as stem from customer")(lambda s, d: panels.read(s, d, "customer").select(F.col("c_name").alias("name"), store.file_stem(F.col("c_name")).alias("stem")))
# fixed values: members of each group, in the order of the rosters
MEMBERS = {
    "core_equity": {"Information Technology": 12, "Health Care": 9, "Financials": 9, "Consumer Discretionary": 8, "Consumer Staples": 7, "Industrials": 9, "Energy": 7, "Materials": 5, "Utilities": 6, "Real Estate": 4, "Communication Services": 5},
    "cross_asset": {"Equity": 7, "Rates": 4, "Credit": 3, "Commodities": 4, "Real assets": 1, "Currency": 1},
    "crypto_majors": {"Store of value": 1, "Smart contract L1": 5, "Interoperability L1": 2, "Payments": 3, "DeFi": 3, "Exchange": 1, "Meme": 1},
    "sector_etfs": {"Sector ETF": 11},
    "crypto_core": {"Store of value": 1, "Smart contract L1": 2, "Payments": 3, "Meme": 1},
}
query("universe_groups", "select universe, grp, n from (values " + ", ".join(f"('{u}', '{g}', {n}::bigint)" for u, gs in MEMBERS.items() for g, n in gs.items()) + ") t(universe, grp, n)")(
    lambda s, d: reduce(DataFrame.union, (u.table(s) for u in universes.UNIVERSES.values())).groupBy("universe", "grp").agg(F.count("*").alias("n")))
query("universe_sizes", "select * from (values ('core_equity', 81::bigint, 3), ('cross_asset', 20::bigint, 3), ('sector_etfs', 11::bigint, 3), ('crypto_majors', 16::bigint, 1), ('crypto_core', 7::bigint, 1)) t(universe, n, fill_limit)")(
    lambda s, d: s.createDataFrame([(u.key, len(set(u.tickers)), u.limit) for u in universes.UNIVERSES.values()], "universe string, n long, fill_limit int"))
query("chart_events", "select * from (values ('2008-09-15', 'Lehman'), ('2010-05-06', 'Flash crash'), ('2011-08-05', 'US downgrade')) t(date, label)")(lambda s, d: figures.events_between(universes.events(s), "2008-09-01", "2011-08-05"))

_GRID = (experiments.Cell("60d", "momentum", 60), experiments.Cell("managed_60d", "managed", 60, 1.0), experiments.Cell("low_60d", "low_long", 60), experiments.Cell("low_60d_ls", "low_short", 60))


def experiment_sql(part: str, variants: tuple[str, ...], columns: str) -> str:
    """The cells of _GRID on one part of PN-F: every variant's weights, one path
    each, statistics, ratios by cost, and the two benchmarks."""
    at_ = f"pos >= {LOOKBACK - 1} and (pos - {LOOKBACK - 1}) % {EVERY} = 0"
    names = ", ".join(f"('{v}')" for v in (*variants, "equal", "single"))
    sharpe = "case when s > 0 then m / s * sqrt(ppy) end"
    cost = lambda c: f"case when s{c} > 0 then (g - t * {c / 1e4}) / s{c} * sqrt(ppy) end"
    return f"""with {aligned_sql('PN-F', tag='a')},
pa as (select date, row_number() over (order by date) - 1 as place, count(*) over () as all_ from (select distinct date from rta)),
rt as (select rta.* from rta join pa using (date) where place {'<' if part == 'explore' else '>='} floor(all_ * 0.7)),
ps as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from rt)),
na as (select count(distinct asset) as n from rt),
tr as (select date, asset, pos, n, case when count(*) over w >= {LOOKBACK} then sum(ret) over w end as s, case when count(*) over w >= {LOOKBACK} then stddev_samp(ret) over w end as vol
  from rt join ps using (date) cross join na window w as (partition by asset order by date rows between {LOOKBACK - 1} preceding and current row)),
bs as (select date, avg(ret) as ret from rt group by date),
bv as (select date, case when count(*) over w >= {LOOKBACK} then stddev_samp(ret) over w * sqrt(252.0) end as base from bs window w as (order by date rows between {LOOKBACK - 1} preceding and current row)),
rk as (select *, row_number() over (partition by date order by vol nulls last, asset) as r, count(vol) over (partition by date) as m from tr join bv using (date)),
va as (select * from (values {names}) t(variant)),
wt as (select variant, date, asset, case variant
    when '60d' then case when {at_} then case when s > 0 then 1.0 else 0.0 end / n end
    when 'managed_60d' then case when {at_} then least(1.0 / base, 1.5) / n end
    when 'low_60d' then case when {at_} and m >= 2 then case when vol is not null and r <= 1 then 1.0 else 0.0 end end
    when 'low_60d_ls' then case when {at_} and m >= 2 then case when vol is null then 0.0 when r <= 1 then 1.0 when r > m - 1 then -1.0 else 0.0 end end
    when 'equal' then case when pos % {EVERY} = 0 then 1.0 / n end
    else case when asset = 'A' then 1.0 else 0.0 end end as weight from rk cross join va),
tg as (select variant, date, asset, ret, coalesce(last_value(weight ignore nulls) over (partition by variant, asset order by date rows between unbounded preceding and current row), 0.0) as target from rt join wt using (date, asset)),
hd as (select *, coalesce(lag(target) over (partition by variant, asset order by date), 0.0) as held from tg),
dy as (select variant, date, sum(held * ret) as gross, sum(abs(target - held)) as turnover, sum(held) as exposure from hd group by all),
eq as (select *, gross - turnover * 0.0025 as net, product(1 + gross - turnover * 0.0025) over (partition by variant order by date rows between unbounded preceding and current row) as equity from dy),
cv as (select *, equity / max(equity) over (partition by variant order by date rows between unbounded preceding and current row) - 1 as drawdown from eq),
st as (select *, case when n < 2 or d <= 0 then 252.0 else n / (d / 365.25) end as ppy from (
  select variant, avg(net) as m, stddev_samp(net) as s, count(*)::double as n, max(date)::date - min(date)::date as d, arg_max(equity, date) as e, min(drawdown) as max_drawdown, avg(gross) as g, avg(turnover) as t, avg(exposure) as average_exposure,
    {', '.join(f'stddev_samp(gross - turnover * {c / 1e4}) as s{c}' for c in experiments.COSTS)} from cv group by 1)),
ce as (select 'PN-F' as universe, variant, (select n from na)::int as n_assets, n::bigint as n_obs, {sharpe} as sharpe, {sharpe} * sqrt(n / ppy) as t_statistic, case when e >= 0 then pow(e, ppy / n) - 1 end as cagr, s * sqrt(ppy) as vol, max_drawdown, t * ppy as turnover_per_year, average_exposure,
  {', '.join(f'{cost(c)} as sharpe_{c}' for c in experiments.COSTS)}, case when g <= 0 then 0.0 when t = 0 then 500.0 * (1 - pow(2.0, -41)) else least(g / t * 1e4, 500.0 * (1 - pow(2.0, -41))) end as breakeven_bps from st),
fi as (select ce.*, e.sharpe as equal_weight_sharpe, o.sharpe as single_sharpe, coalesce(ce.sharpe >= {experiments.KILL}, false) as passes_kill, coalesce(ce.sharpe > greatest(e.sharpe, o.sharpe), false) as beats_benchmarks
  from ce cross join (select sharpe from ce where variant = 'equal') e cross join (select sharpe from ce where variant = 'single') o where ce.variant not in ('equal', 'single'))
select universe, variant, n_assets, n_obs, {', '.join(r(c, c) for c in ('sharpe', 't_statistic', 'cagr', 'vol', 'max_drawdown', 'turnover_per_year', 'average_exposure', 'sharpe_10', 'sharpe_25', 'sharpe_50', 'breakeven_bps', 'equal_weight_sharpe', 'single_sharpe'))}, passes_kill, beats_benchmarks{columns} from fi"""


query("experiment_explore", experiment_sql("explore", tuple(c.name for c in _GRID), ""))(lambda s, d: experiments.explore(_rt(s, d), "PN-F", _GRID, "A"))
query("experiment_holdout", experiment_sql("holdout", tuple(c.name for c in _GRID[:2]), f", case when beats_benchmarks and coalesce(abs(t_statistic) > {experiments.HOLDOUT_T['momentum']}, false) and coalesce(sharpe > 0, false) then 'survives' else 'fails' end as verdict"))(
    lambda s, d: experiments.holdout(_rt(s, d), "PN-F", _GRID, s.createDataFrame([(c.name,) for c in _GRID[:2]], "variant string"), experiments.HOLDOUT_T["momentum"], "A"))
query("figure_heatmap", f"{_shrunk},\n{LINKS},\nhm as (select names, m, n, leaf_order, unnest(range(n * n)) as k from cm join (select window_id, leaf_order from co) using (window_id))\nselect (list_position(leaf_order, k // n) - 1)::int as row, (list_position(leaf_order, k % n) - 1)::int as column, names[k // n + 1] as a, names[k % n + 1] as b, {r('m[k + 1]', 'rho')} from hm")(lambda s, d: figures.heatmap(_matrix(s, d, "PN-S", "ledoit_wolf")))
query("figure_spectrum", f"with recursive {aligned_sql('PN-S')}, {ONE}, {estimated_sql('rmt_clipped')},\n{dense_sql.spectral('cm', 'sx')}\nselect k::int as rank, {r('spectrum[k]', 'eigenvalue')}, {r('lambda_plus', 'lambda_plus')} from (select *, unnest(range(1, n + 1)) as k from sx) join (select window_id, lambda_plus from cm_f) using (window_id)")(lambda s, d: figures.spectrum_series(_matrix(s, d, "PN-S", "rmt_clipped")))


@query("figure_network_nodes")
def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _built(spark, sf_dir, "ledoit_wolf")
    last = t["layouts"].agg(F.max("window_end").alias("window_end"))
    lay, e = t["layouts"].join(last, "window_end"), t["edges"].join(last, "window_end")
    return figures.network(e, lay, groups(spark, sf_dir, "PN-S"))[1]
