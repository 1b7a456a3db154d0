"""Registered price-series queries over the daily ``prices`` view."""

from __future__ import annotations


from lakeloom.functions.scalar import round6
from lakeloom.operators import portfolio as P
from lakeloom.plans.registry import register
from lakeloom.sources.derived import view

AMOUNT = 10000

_COMPLETE = """
complete as (
  select dt, symbol, price from (
    select dt, symbol, price, count(*) over (partition by dt) as n,
      (select count(distinct symbol) from prices where price is not null) as syms
    from prices where price is not null) x where n = syms),
rets as (
  select dt, symbol, price,
    cast(price as double) / nullif(lag(price) over (partition by symbol order by dt), 0) - 1 as ret
  from complete)"""


def _rets(s, d):
    return P.returns(view(s, d, "prices"))


@register("returns", views=("prices",), oracle=f"""
with {_COMPLETE}
select dt, symbol, price, round(ret, 6) as ret from rets""")
def q_returns(s, d):
    r = _rets(s, d)
    return r.select("dt", "symbol", "price", round6("ret").alias("ret"))


@register("covariance", views=("prices",), oracle=f"""
with {_COMPLETE}
select a.symbol as symbol_a, b.symbol as symbol_b, round(covar_samp(a.ret, b.ret), 6) as cov,
  round(avg(a.ret), 6) as mean_a, round(avg(b.ret), 6) as mean_b
from rets a join rets b on a.dt = b.dt group by a.symbol, b.symbol""")
def q_covariance(s, d):
    c = P.covariance(_rets(s, d))
    return c.select("symbol_a", "symbol_b", round6("cov").alias("cov"), round6("mean_a").alias("mean_a"),
                    round6("mean_b").alias("mean_b"))


_BACKTEST = f"""
, w as (select symbol, 1.0 / count(*) over () as weight from (select distinct symbol from rets) s),
vals as (
  select r.dt, r.symbol,
    case when r.ret is not null then
      exp(sum(ln(1 + r.ret)) over (partition by r.symbol order by r.dt rows between unbounded preceding and current row))
    end * w.weight * {AMOUNT} as value
  from rets r join w on r.symbol = w.symbol),
tot as (select dt, coalesce(sum(value), 0) as total from vals group by dt),
dd as (select dt, total, max(total) over (order by dt rows between unbounded preceding and current row) as peak
       from tot)"""


@register("backtest", views=("prices",), oracle=f"""
with {_COMPLETE}{_BACKTEST}
select dt, symbol, round(value, 6) as value from vals""")
def q_backtest(s, d):
    r = _rets(s, d)
    v = P.backtest(r, P.equal_weights(r), AMOUNT)
    return v.select("dt", "symbol", round6("value").alias("value"))


@register("drawdown", views=("prices",), oracle=f"""
with {_COMPLETE}{_BACKTEST}
select dt, round(total, 6) as total, round(peak, 6) as peak,
  round(case when peak <> 0 then (total - peak) / peak end, 6) as drawdown from dd""")
def q_drawdown(s, d):
    r = _rets(s, d)
    dd = P.drawdown(P.backtest(r, P.equal_weights(r), AMOUNT))
    return dd.select("dt", round6("total").alias("total"), round6("peak").alias("peak"),
                     round6("drawdown").alias("drawdown"))


@register("max_drawdown", views=("prices",), oracle=f"""
with {_COMPLETE}{_BACKTEST}
select round(min(case when peak <> 0 then (total - peak) / peak end), 6) as max_drawdown from dd""")
def q_max_drawdown(s, d):
    r = _rets(s, d)
    m = P.max_drawdown(P.drawdown(P.backtest(r, P.equal_weights(r), AMOUNT)))
    return m.select(round6("max_drawdown").alias("max_drawdown"))


def _grid_sql(n: int = 5) -> str:
    ws = [f"w{i}" for i in range(1, n)]
    ranges = ", ".join(f"range(0, 11) t{i}({w})" for i, w in enumerate(ws, 1))
    last = "10 - " + " - ".join(ws)
    wlist = ws + [f"({last})"]
    ret = " + ".join(f"{w} * 0.1 * m{i}.mu" for i, w in enumerate(wlist, 1))
    var = " + ".join(f"{wi} * 0.1 * {wj} * 0.1 * (select cov from cv where i = {i} and j = {j})"
                     for i, wi in enumerate(wlist, 1) for j, wj in enumerate(wlist, 1))
    mus = " ".join(f"join mu m{i} on m{i}.i = {i}" for i in range(1, n + 1))
    order = ", ".join(wlist)
    zipped = " union all ".join(
        f"select (select symbol from mu where i = {i}) as symbol, {w} * 0.1 as weight, ret, risk, sharpe from best"
        for i, w in enumerate(["b" + x for x in ["w1", "w2", "w3", "w4", "w5"][:n]], 1))
    return f"""
with {_COMPLETE},
mu as (select symbol, row_number() over (order by symbol) as i, avg(ret) as mu from rets group by symbol),
cv as (select ma.i as i, mb.i as j, covar_samp(a.ret, b.ret) as cov
       from rets a join rets b on a.dt = b.dt join mu ma on ma.symbol = a.symbol join mu mb on mb.symbol = b.symbol
       group by ma.i, mb.i),
grid as (select {", ".join(ws)}, {last} as w{n} from {ranges} where {" + ".join(ws)} <= 10),
scored as (
  select {", ".join(f"w{i}" for i in range(1, n + 1))},
    ({ret.replace("(" + last + ")", "w" + str(n))}) * 252 as ret,
    sqrt({var.replace("(" + last + ")", "w" + str(n))}) * sqrt(252) as risk
  from grid {mus}),
best as (select {", ".join(f"w{i} as bw{i}" for i in range(1, n + 1))}, ret, risk, ret / risk as sharpe
         from scored order by ret / risk desc, {", ".join(f"w{i} desc" for i in range(1, n + 1))} limit 1)
select symbol, round(cast(weight as double), 6) as weight, round(ret, 6) as ret, round(risk, 6) as risk,
  round(sharpe, 6) as sharpe from ({zipped}) z"""


@register("best_weights", views=("prices",), oracle=_grid_sql(5))
def q_best_weights(s, d):
    b = P.best_weights(_rets(s, d))
    return b.select("symbol", round6("weight").alias("weight"), round6("ret").alias("ret"),
                    round6("risk").alias("risk"), round6("sharpe").alias("sharpe"))


@register("symbol_status", views=("prices",), oracle="""
with req as (select * from (values ('click'), ('view'), ('purchase'), ('ticker-x')) t(symbol)),
c as (select symbol, count(*) as n_days from prices group by symbol)
select req.symbol, coalesce(c.n_days, 0) as n_days,
  case when c.n_days > 0 then 'Data Lookup complete' else 'No history found' end as status
from req left join c on req.symbol = c.symbol""")
def q_symbol_status(s, d):
    req = s.createDataFrame([("click",), ("view",), ("purchase",), ("ticker-x",)], "symbol string")
    return P.symbol_status(view(s, d, "prices"), req)
