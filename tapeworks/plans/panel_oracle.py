"""DuckDB SQL giving the same rows as ``panel_queries``."""

from __future__ import annotations

from tapeworks import constants as K
from tapeworks.plans import market as M

W = "PARTITION BY ticker ORDER BY bar"
FEATURES = K.PRICE_FEATURES
TICKER = "upper(replace(p_brand, '#', '-'))"


def cents(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


PX = f"""px AS (
  SELECT {TICKER} AS ticker, CAST(l_shipdate AS DATE) AS dt,
         (CAST(sum({cents('l_extendedprice')}) AS BIGINT) * 200 + CAST(sum(l_quantity) AS BIGINT)) // (CAST(sum(l_quantity) AS BIGINT) * 2) / 1e4 AS close,
         sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
BARS = PX + """,
bars AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS bar FROM px)"""

KEEP = "(1 - 1 / 14.0::DOUBLE)"
EWM = ("pow({keep}, bar - 1) * sum(greatest({x}, 0) * CASE WHEN bar = 1 THEN 1 ELSE 1 / 14.0::DOUBLE END"
       " * pow({keep}, -(bar - 1))) OVER ({w} ROWS UNBOUNDED PRECEDING)")


def features(source: str, rule: str, out: str = "feats") -> str:
    """CTEs adding the seven features to ``source`` (ticker, dt, close, volume, bar)."""
    live = rule in ("snapshot", "panel")
    frame = "58" if live else "59"
    short = "0.0" if rule == "backtest" else "NULL"
    moms = []
    for name, k in K.MOMENTUM_BARS.items():
        x = f"close / nullif(lag(close, {k}) OVER ({W}), 0) - 1"
        moms.append(f"CASE WHEN bar + 1 > {k} THEN {f'round({x}, 6)' if live else x} ELSE {short} END AS {name}")
    if live:
        vol = "CASE WHEN bar + 1 >= 61 THEN round(sd_, 6) END"
        rsi = ("CASE WHEN bar >= 1 THEN CASE WHEN al_ = 0 THEN 100.0 ELSE round(100 - 100 / (1 + ag_ / al_), 2) END END")
    else:
        vol = "CASE WHEN bar + 1 > 10 AND nr_ > 1 THEN sd_ END"
        rsi = "CASE WHEN bar + 1 > 15 THEN 100 - 100 / (1 + ag_ / (al_ + 1e-9)) END"
    high = "CASE WHEN hi_ > 0 THEN close / hi_ - 1 END"
    if rule == "snapshot":
        high = f"CASE WHEN bar + 1 >= 252 THEN {high} END"
    if rule == "backtest":
        vol, rsi, high = f"coalesce({vol}, 0.20)", f"coalesce({rsi}, 50.0)", f"coalesce({high}, 0.0)"
    return f"""
{out}_a AS (SELECT *, ln(close) - ln(lag(close) OVER ({W})) AS lr_, close - lag(close) OVER ({W}) AS d_ FROM {source}),
{out}_b AS (SELECT *, {', '.join(moms)},
  stddev_samp(lr_) OVER ({W} ROWS BETWEEN {frame} PRECEDING AND CURRENT ROW) * sqrt(252.0) AS sd_,
  count(lr_) OVER ({W} ROWS BETWEEN {frame} PRECEDING AND CURRENT ROW) AS nr_,
  max(close) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hi_,
  {EWM.format(keep=KEEP, x='d_', w=W)} AS ag_, {EWM.format(keep=KEEP, x='-d_', w=W)} AS al_
  FROM {out}_a),
{out} AS (SELECT * EXCLUDE (lr_, d_, sd_, nr_, hi_, ag_, al_), {vol} AS vol_60d, {rsi} AS rsi_14,
  {high} AS price_vs_52w_high FROM {out}_b)"""


def rank(v: str, keys: str) -> str:
    part = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    lead = f"PARTITION BY {keys} " if keys else ""
    return (f"CASE WHEN {v} IS NOT NULL AND count({v}) OVER ({lead}) > 1 THEN (rank() OVER ({lead}ORDER BY {v} NULLS LAST)"
            f" + (count(*) OVER ({part}{v}) - 1) / 2.0::DOUBLE) / count({v}) OVER ({lead}) END")


def ranks(keys: str, fill: bool = True) -> str:
    return ", ".join(
        (f"coalesce({rank(c, keys)}, 0.5)" if fill else rank(c, keys)) + f" AS {c}_rank" for c in FEATURES)


def r6(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split())


PANEL = BARS + """,
gate AS (SELECT ticker, count(*) AS n FROM px GROUP BY 1 HAVING count(*) >= 252 + 63 + 30),
used AS (SELECT bars.* FROM bars JOIN gate USING (ticker)),""" + features("used", "backtest") + f""",
fwd AS (SELECT *, lead(close, 1) OVER ({W}) AS p0, lead(close, 253) OVER ({W}) AS p1,
  lead(dt, 1) OVER ({W}) AS start_dt, lead(dt, 253) OVER ({W}) AS end_dt FROM feats),
panel AS (SELECT (bar + 1) // 63 AS period, ticker, start_dt, end_dt, {', '.join(FEATURES)},
    p1 / p0 - 1 AS fwd_ret, coalesce(nullif(vol_60d, 0), 0.20) AS vol
  FROM fwd WHERE (bar + 1) % 63 = 0 AND bar + 1 + 252 < (SELECT min(n) FROM gate) AND bar >= 4 AND p0 > 0 AND p1 IS NOT NULL),
big AS (SELECT period FROM panel GROUP BY 1 HAVING count(*) >= 2),
ranked AS (SELECT *, {ranks('period')}, median(fwd_ret) OVER (PARTITION BY period) AS median_ret,
    avg(fwd_ret) OVER (PARTITION BY period) AS bench_ret
  FROM panel WHERE period IN (FROM big))"""
SCORED = PANEL + f""",
scored AS (SELECT period, ticker, start_dt, end_dt, round(({' + '.join(c + '_rank' for c in FEATURES)}) / 7, 6) AS model_score,
  fwd_ret, vol, bench_ret FROM ranked)"""
IC = """ic_in AS (SELECT * FROM scored WHERE period IN (SELECT period FROM scored GROUP BY 1
   HAVING count(*) >= 2 AND count(DISTINCT model_score) >= 2 AND count(DISTINCT fwd_ret) >= 2)),
ic_r AS (SELECT period, rank() OVER (PARTITION BY period ORDER BY model_score) + (count(*) OVER (PARTITION BY period, model_score) - 1) / 2.0 AS a,
   rank() OVER (PARTITION BY period ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY period, fwd_ret) - 1) / 2.0 AS b FROM ic_in),
ics AS (SELECT period, count(*) AS n, corr(a, b) AS ic FROM ic_r GROUP BY 1)"""
HITS = """hm AS (SELECT *, model_score >= median(model_score) OVER (PARTITION BY period) AS up FROM scored),
hits AS (SELECT period, avg(fwd_ret) FILTER (up) AS top_ret, avg(fwd_ret) FILTER (NOT up) AS bottom_ret FROM hm GROUP BY 1
   HAVING count(*) FILTER (up) > 0 AND count(*) FILTER (NOT up) > 0)"""
# Reference form of the books: an explicit ticker x period grid.
TOP = SCORED + """,
valid AS (SELECT period, n, row_number() OVER (ORDER BY period) - 1 AS idx FROM (
   SELECT period, count(*) AS n FROM scored GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT model_score) >= 2)),
top AS (SELECT s.*, v.idx, v.n, greatest(1, v.n // 5) AS n_top,
   row_number() OVER (PARTITION BY s.period ORDER BY model_score DESC, ticker) <= greatest(1, v.n // 5) AS in_top,
   model_score >= median(model_score) OVER (PARTITION BY s.period) AS above
  FROM scored s JOIN valid v ON s.period = v.period),
grid AS (SELECT v.idx, v.period, t.ticker, coalesce(top.in_top, false) AS in_top, coalesce(top.above, false) AS above,
   top.fwd_ret, top.vol, top.model_score
  FROM valid v CROSS JOIN (SELECT DISTINCT ticker FROM top) t LEFT JOIN top ON top.idx = v.idx AND top.ticker = t.ticker),
eq_g AS (SELECT *, coalesce(lag(in_top) OVER (PARTITION BY ticker ORDER BY idx), false) AS was FROM grid),
eq AS (SELECT idx, period, avg(fwd_ret) FILTER (in_top) AS gross,
   avg(fwd_ret) FILTER (in_top) - (count(*) FILTER (in_top AND NOT was)) / (count(*) FILTER (in_top))::DOUBLE * 30 / 10000 AS net,
   CASE WHEN idx > 0 THEN 1 - (count(*) FILTER (in_top AND was)) / (count(*) FILTER (in_top))::DOUBLE END AS turnover
  FROM eq_g GROUP BY 1, 2),
sz_a AS (SELECT *, CASE WHEN in_top THEN greatest(model_score - 0.5, 0) / greatest(vol, 0.05) END AS w0 FROM grid),
sz_b AS (SELECT *, CASE WHEN in_top THEN CASE WHEN sum(w0) OVER (PARTITION BY idx) <= 0 THEN 1.0 / count(w0) OVER (PARTITION BY idx)
   ELSE w0 / sum(w0) OVER (PARTITION BY idx) END END AS w1 FROM sz_a),
sz_c AS (SELECT *, CASE WHEN in_top THEN least(w1, 0.25) END AS w2 FROM sz_b),
sz_d AS (SELECT *, coalesce(w2 / sum(w2) OVER (PARTITION BY idx), 0) AS w FROM sz_c),
sz_e AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY ticker ORDER BY idx), 0)) AS mv FROM sz_d),
sized AS (SELECT idx, period, sum(w * fwd_ret) AS gross, sum(w * fwd_ret) - sum(mv) * 30 / 10000 AS net, sum(mv) / 2 AS turnover
  FROM sz_e GROUP BY 1, 2),
hy_a AS (SELECT *, max(CASE WHEN in_top THEN idx END) OVER (PARTITION BY ticker ORDER BY idx)
    > coalesce(max(CASE WHEN NOT above THEN idx END) OVER (PARTITION BY ticker ORDER BY idx), -1) AS h FROM grid),
hy_b AS (SELECT *, coalesce(h, false) AS held, coalesce(lag(coalesce(h, false)) OVER (PARTITION BY ticker ORDER BY idx), false) AS was FROM hy_a),
hyst AS (SELECT idx, period, avg(fwd_ret) FILTER (held) AS gross,
   avg(fwd_ret) FILTER (held) - (count(*) FILTER (held AND NOT was)) / (count(*) FILTER (held))::DOUBLE * 30 / 10000 AS net,
   CASE WHEN idx > 0 THEN 1 - (count(*) FILTER (held AND was)) / (count(*) FILTER (held))::DOUBLE END AS turnover
  FROM hy_b GROUP BY 1, 2)"""


def stats(source: str, keys: str) -> str:
    """Drawdown and moments per book of rows (book, idx, net, turnover)."""
    return f"""dd_a AS (SELECT *, product(1 + net) OVER (PARTITION BY {keys} ORDER BY idx) AS cum FROM {source}),
dd_b AS (SELECT *, (cum - max(cum) OVER (PARTITION BY {keys} ORDER BY idx)) / (max(cum) OVER (PARTITION BY {keys} ORDER BY idx) + 1e-9) AS dd FROM dd_a)"""


EXAMPLES = SCORED + """,
ends AS (SELECT DISTINCT period FROM scored ORDER BY period DESC LIMIT 6),
ex_a AS (SELECT *, model_score >= 0.5 AS predicted_top, fwd_ret >= median(fwd_ret) OVER (PARTITION BY period) AS actual_top
  FROM scored WHERE period IN (FROM ends)),
ex AS (SELECT period, strftime(start_dt, '%b %Y') || ' → ' || strftime(end_dt, '%b %Y') AS date_range,
  count(*) OVER (PARTITION BY period) AS n_stocks,
  round_even(100 * avg(CAST(predicted_top = actual_top AS INT)) OVER (PARTITION BY period), 1) AS hit_rate_pct, ticker,
  round_even(model_score * 100, 1) AS model_score, predicted_top, round_even(fwd_ret * 100, 1) AS actual_return_pct,
  actual_top, predicted_top = actual_top AS correct FROM ex_a)"""

INDUSTRY = f"""industry AS (SELECT ticker, CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in M.INDUSTRY.items())} END AS industry
  FROM (SELECT {TICKER} AS ticker, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn
        FROM part GROUP BY p_brand, p_type) WHERE rn = 1),
sectors AS (SELECT *, CASE industry WHEN 'Beverages' THEN 'Consumer Staples' WHEN 'Utilities' THEN 'Utilities'
   WHEN 'Media' THEN 'Communication Services' WHEN 'Machinery' THEN 'Industrials' WHEN 'Banking' THEN 'Financials'
   WHEN 'Pharmaceuticals' THEN 'Healthcare' END AS sector FROM industry)"""
MONTHLY = f"""monthly AS (SELECT {TICKER} AS ticker, last_day(CAST(l_shipdate AS DATE)) AS period,
   CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS cents, count(*) FILTER (l_returnflag = 'A') AS buy,
   count(*) FILTER (l_returnflag = 'N') AS hold, count(*) FILTER (l_returnflag = 'R') AS sell
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
earnings AS (SELECT ticker, period, period + 45 AS announce_date, surprise_pct FROM (
   SELECT *, (cents / lag(cents) OVER (PARTITION BY ticker ORDER BY period) - 1) * 100 AS surprise_pct FROM monthly)
   WHERE surprise_pct IS NOT NULL)"""
WINDOWS = BARS + """,
wr AS (SELECT e.ticker, e.bar AS end_bar, b.bar, b.close FROM bars e JOIN bars b ON b.ticker = e.ticker
   AND b.bar BETWEEN e.bar - 252 AND e.bar WHERE e.bar >= 252 AND (e.bar - 252) % 21 = 0),
wl AS (SELECT *, coalesce(ln(close) - ln(lag(close) OVER w), 0) AS logret, lag(bar) OVER w AS pb FROM wr
   WINDOW w AS (PARTITION BY ticker, end_bar ORDER BY bar)),
wc AS (SELECT *, CASE WHEN count(*) OVER w >= 2 THEN stddev_pop(logret) OVER w ELSE 0 END AS vol FROM wl WHERE pb IS NOT NULL
   WINDOW w AS (PARTITION BY ticker, end_bar ORDER BY bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
REF = PX.replace("px AS", "px AS") + f""", {INDUSTRY},
bars AS (SELECT px.*, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS bar FROM px),
e4 AS (SELECT bars.*, sector, CAST(round(close * 10000) AS BIGINT) AS u FROM bars JOIN sectors USING (ticker)),
refs AS (SELECT *, CAST(sum(u) OVER (PARTITION BY dt) AS DOUBLE) / (count(*) OVER (PARTITION BY dt) * 10000.0::DOUBLE) AS mk,
   CAST(sum(u) OVER (PARTITION BY sector, dt) AS DOUBLE) / (count(*) OVER (PARTITION BY sector, dt) * 10000.0::DOUBLE) AS sc FROM e4)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


EXACT_RANKS = ", ".join(f"round({c}_rank, 6) AS {c}_rank" for c in FEATURES)


SQL = {
    "q01_price_panel": with_(BARS, "SELECT ticker, dt, close, volume, bar FROM bars WHERE ticker IN (SELECT ticker FROM px GROUP BY 1 HAVING count(*) >= 60)"),
    "q02_coverage": with_(PX, f"""SELECT ticker, count(*) AS bars, min(dt) AS first_dt, max(dt) AS last_dt,
        round(date_diff('second', max(dt)::TIMESTAMP, TIMESTAMP '{M.AS_OF}') / 3600.0::DOUBLE, 1) AS age_hours,
        date_diff('second', max(dt)::TIMESTAMP, TIMESTAMP '{M.AS_OF}') / 3600.0 < 168 AS fresh FROM px GROUP BY 1"""),
    "q03_momentum": with_(BARS + "," + features("bars", "snapshot"), "SELECT ticker, dt, mom_1m, mom_3m, mom_6m, mom_12m FROM feats"),
    "q04_vol_52w": with_(BARS + "," + features("bars", "snapshot"), f"SELECT ticker, dt, {r6('vol_60d price_vs_52w_high')} FROM feats"),
    "q05_rsi": with_(BARS + "," + features("bars", "label"), f"SELECT ticker, dt, {r6('rsi_14')} FROM feats"),
    "q06_channels_volume": with_(BARS + f""",
      a AS (SELECT *, coalesce(ln(close) - ln(lag(close) OVER ({W})), 0) AS logret FROM bars),
      b AS (SELECT *, CASE WHEN count(*) OVER f >= 2 THEN stddev_pop(logret) OVER f ELSE 0 END AS vol, median(volume) OVER f AS m
        FROM a WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
      f"""SELECT ticker, dt, {r6('logret vol')}, round(CASE WHEN volume > 0 AND m > 0 THEN ln(volume / m) ELSE 0 END, 6) AS rel_volume,
        round(CASE WHEN close * volume > 0 THEN ln(close * volume) ELSE 0 END, 6) AS log_dollar_vol FROM b"""),
    "q07_excess_return": with_(REF, f"""SELECT ticker, dt,
        round(coalesce(ln(close) - ln(lag(close) OVER w), 0) - coalesce(ln(mk) - ln(lag(mk) OVER w), 0), 6) AS excess_ret_vs_market,
        round(coalesce(ln(close) - ln(lag(close) OVER w), 0) - coalesce(ln(sc) - ln(lag(sc) OVER w), 0), 6) AS rel_strength_vs_sector
        FROM refs WINDOW w AS ({W})"""),
    "q08_earnings_pulse": with_(PX + ", " + MONTHLY, """SELECT px.ticker, px.dt,
        CASE WHEN date_diff('day', e.announce_date, px.dt) <= 63 THEN e.announce_date END AS announce_date,
        round(coalesce(CASE WHEN date_diff('day', e.announce_date, px.dt) <= 63 THEN greatest(least(surprise_pct / 50, 1), -1)
          * exp(-date_diff('day', e.announce_date, px.dt) / 21.0::DOUBLE) END, 0), 6) AS earn_surprise_pulse
        FROM px ASOF LEFT JOIN earnings e ON px.ticker = e.ticker AND px.dt >= e.announce_date"""),
    "q09_analyst_net": with_(PX + ", " + MONTHLY, """SELECT px.ticker, px.dt,
        round(coalesce((buy - sell) / nullif(buy + hold + sell, 0), 0), 6) AS analyst_net_buy_ts
        FROM px ASOF LEFT JOIN monthly m ON px.ticker = m.ticker AND px.dt >= m.period"""),
    "q10_pct_rank": with_(PANEL, f"SELECT period, ticker, {EXACT_RANKS} FROM ranked"),
    "q11_winsor_fill": with_(BARS + "," + features("bars", "snapshot") + f""",
      s AS (SELECT (bar - 62) // 63 AS period, ticker, {', '.join(FEATURES)} FROM feats WHERE bar % 63 = 62),
      b AS (SELECT period, {', '.join(f'quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi' for c in FEATURES)} FROM s GROUP BY 1),
      c AS (SELECT period, ticker, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_lo), {c}_hi) END AS {c}' for c in FEATURES)} FROM s JOIN b USING (period)),
      m AS (SELECT period, {', '.join(f'median({c}) AS {c}_m' for c in FEATURES)} FROM c GROUP BY 1)""",
      f"SELECT period, ticker, {', '.join(f'round(coalesce({c}, {c}_m, 0.5), 6) AS {c}' for c in FEATURES)} FROM c JOIN m USING (period)"),
    "q12_reference_rank": with_(BARS + "," + features("bars", "panel") + f""",
      z AS (SELECT *, max(bar) OVER (PARTITION BY ticker) - bar AS back FROM feats),
      ref AS (SELECT * FROM z WHERE back = 0 AND bar >= 29)""",
      "SELECT ticker, dt, " + ", ".join(
          f"""round(CASE WHEN (SELECT count({c}) FROM ref) >= 20 AND (SELECT count(*) FROM ref) >= 20 THEN
          CASE WHEN {c} IS NULL THEN 0.5 ELSE (SELECT count(*) FROM ref WHERE ref.{c} <= z.{c}) / (SELECT count({c}) FROM ref)::DOUBLE END END, 6) AS {c}_rank"""
          for c in FEATURES) + " FROM z WHERE back = 63"),
    "q13_emb_zscore": """WITH e AS (SELECT vec_id, label AS grp, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
      s AS (SELECT *, avg(v) OVER g AS mu, stddev_samp(v) OVER g AS sd FROM e WINDOW g AS (PARTITION BY grp, dim))
      SELECT grp, vec_id, dim, round(coalesce(CASE WHEN sd >= 1e-8 THEN (v - mu) / sd END, 0), 6) AS z FROM s""",
    "q14_forward_label": with_(PANEL, f"""SELECT period, ticker, start_dt, end_dt, {r6('fwd_ret median_ret bench_ret')},
        CAST(fwd_ret >= median_ret AS BIGINT) AS label FROM ranked"""),
    "q15_multi_horizon": with_(BARS + "," + features("bars", "label") + "," + ",".join(f"""
      g{h} AS (SELECT ticker, count(*) AS n FROM px GROUP BY 1 HAVING count(*) >= 2 * {h}),
      f{h} AS (SELECT f.*, lead(close, {h}) OVER ({W}) / nullif(close, 0) - 1 AS fwd_ret FROM feats f JOIN g{h} USING (ticker)),
      r{h} AS (SELECT {h} AS horizon, bar AS t_start, ticker, {ranks('bar')}, fwd_ret FROM f{h}
        WHERE bar % {h} = 0 AND bar >= 4 AND bar < ((SELECT min(n) FROM g{h}) - {h}) // {h} * {h})""" for h in K.LABEL_HORIZONS) + """,
      u AS (""" + " UNION ALL ".join(f"SELECT * FROM r{h}" for h in K.LABEL_HORIZONS) + """),
      v AS (SELECT *, count(*) OVER k AS n, median(fwd_ret) OVER k AS m FROM u WHERE fwd_ret IS NOT NULL WINDOW k AS (PARTITION BY horizon, t_start))""",
      f"""SELECT horizon::BIGINT AS horizon, t_start, ticker, {EXACT_RANKS}, round(fwd_ret, 6) AS fwd_ret, CAST(fwd_ret > m AS BIGINT) AS label FROM v WHERE n >= 3"""),
    "q16_cv_folds": with_(PANEL + """,
      p AS (SELECT DISTINCT period FROM panel), q AS (SELECT *, row_number() OVER (ORDER BY period) AS pos FROM p),
      f AS (SELECT period, ntile(5) OVER (ORDER BY period) AS fold FROM q WHERE pos > 1),
      g AS (SELECT *, min(period) OVER (PARTITION BY fold) - 4 AS train_below FROM f)""",
      "SELECT fold::BIGINT AS fold, period, train_below FROM g WHERE train_below > (SELECT min(period) FROM p)"),
    "q17_spearman_ic": with_(SCORED + "," + IC, "SELECT period, n, round(ic, 6) AS ic FROM ics"),
    "q18_pooled_ic": with_(SCORED + """,
      r AS (SELECT rank() OVER (ORDER BY model_score) + (count(*) OVER (PARTITION BY model_score) - 1) / 2.0 AS a,
                   rank() OVER (ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY fwd_ret) - 1) / 2.0 AS b FROM scored)""",
      "SELECT count(*) AS n, round(corr(a, b), 6) AS ic FROM r"),
    "q19_hit_rate": with_(SCORED + "," + HITS, f"SELECT period, {r6('top_ret bottom_ret')}, CAST(top_ret > bottom_ret AS BIGINT) AS hit FROM hits"),
    "q20_equal_book": with_(TOP, f"SELECT idx, period, {r6('gross net turnover')} FROM eq"),
    "q21_sized_book": with_(TOP, f"SELECT idx, period, {r6('gross net turnover')} FROM sized"),
    "q22_hysteresis_book": with_(TOP, f"SELECT idx, period, {r6('gross net turnover')} FROM hyst"),
    "q23_book_stats": with_(TOP + """,
      al AS (SELECT 'equal_weight' AS book, * FROM eq UNION ALL SELECT 'sized', * FROM sized UNION ALL SELECT 'hysteresis', * FROM hyst),
      """ + stats("al", "book") + """,
      s AS (SELECT book, count(*) AS n_periods, pow(product(1 + net), 4.0 / count(*)) - 1 AS ann,
        (avg(net) - 0.045 / 4) / (stddev_pop(net) + 1e-9) * 2 AS sh, min(dd) AS dd, avg(turnover) AS turn FROM dd_b GROUP BY 1)""",
      """SELECT book, n_periods, round(ann * 100, 2) AS ann_return_pct, round(sh, 3) AS sharpe, round(dd * 100, 2) AS max_drawdown_pct,
        round(CASE WHEN dd < -1e-6 THEN ann / abs(dd) END, 3) AS calmar, round(turn * 100, 1) AS avg_turnover_pct FROM s"""),
    "q24_beta_alpha": with_(TOP + "," + IC + "," + HITS + """,
      b AS (SELECT period, max(bench_ret) AS bench FROM scored GROUP BY 1),
      al AS (SELECT 1 AS book, eq.*, bench FROM eq JOIN b USING (period)), """ + stats("al", "book") + """,
      s AS (SELECT count(*) AS n_periods, pow(product(1 + gross), 4.0 / count(*)) - 1 AS ag, pow(product(1 + net), 4.0 / count(*)) - 1 AS an,
        pow(product(1 + bench), 4.0 / count(*)) - 1 AS ab, (avg(net) - 0.045 / 4) / (stddev_pop(net) + 1e-9) * 2 AS sh, min(dd) AS dd,
        CASE WHEN count(*) > 1 AND stddev_pop(bench) > 0 THEN covar_samp(net, bench) / (var_pop(bench) + 1e-9) ELSE 1 END AS beta,
        coalesce(avg(turnover), 0.5) AS turn FROM dd_b),
      i AS (SELECT coalesce(avg(ic), 0) AS m, CASE WHEN count(ic) > 1 THEN stddev_pop(ic) ELSE 0 END AS sd FROM ics),
      h AS (SELECT coalesce(avg(CAST(top_ret > bottom_ret AS INT)), 0.5) AS hit FROM hits)""",
      """SELECT CASE WHEN n_periods > 0 THEN 'ok' ELSE 'No valid test periods' END AS status, n_periods, round(ag * 100, 2) AS ann_portfolio_return, round(an * 100, 2) AS ann_portfolio_net,
        round(ab * 100, 2) AS ann_benchmark_return, round((ag - ab) * 100, 2) AS ann_alpha, round((an - ab) * 100, 2) AS ann_alpha_net,
        round(sh, 3) AS sharpe_ratio, round(dd * 100, 2) AS max_drawdown, round(CASE WHEN dd < -1e-6 THEN ag / abs(dd) END, 3) AS calmar_ratio,
        round(hit * 100, 1) AS hit_rate, round(m, 4) AS ic_mean, round(sd, 4) AS ic_std, round(m / (sd + 1e-9), 3) AS icir,
        round(beta, 3) AS beta_vs_benchmark, round(turn * 100, 1) AS avg_turnover,
        CASE WHEN hit > 0.55 THEN 'Strong' WHEN hit > 0.45 THEN 'Moderate' ELSE 'Weak' END AS says_hit_rate,
        CASE WHEN m > 0.10 THEN 'Strong (>0.10)' WHEN m > 0.05 THEN 'Good (0.05–0.10)' WHEN m > 0 THEN 'Weak (<0.05)' ELSE 'Negative' END AS says_ic,
        CASE WHEN sh > 2 THEN 'Excellent (>2)' WHEN sh > 1 THEN 'Good (1–2)' WHEN sh > 0 THEN 'Acceptable' ELSE 'Poor (<0)' END AS says_sharpe,
        CASE WHEN dd > -0.10 THEN 'Low (<10%)' WHEN dd > -0.20 THEN 'Moderate' ELSE 'High (>20%)' END AS says_drawdown,
        CASE WHEN an - ab > 0 THEN 'Positive — model adding value' ELSE 'Negative — model underperforming equal-weight' END AS says_alpha
        FROM s, i, h"""),
    "q25_period_examples": with_(EXAMPLES, "SELECT * FROM ex"),
    "q26_band_hit": with_(EXAMPLES + """,
      c AS (SELECT CASE WHEN model_score >= 70 THEN 'High' WHEN model_score >= 55 THEN 'Moderate' WHEN model_score >= 38 THEN 'Low' ELSE 'Bearish' END AS band, actual_top FROM ex)""",
      """SELECT b.band, count(actual_top) AS n, round_even(avg(CAST(actual_top AS INT)) * 100, 1) AS hit_rate
        FROM (VALUES ('High'), ('Moderate'), ('Low'), ('Bearish')) b(band) LEFT JOIN c ON c.band = b.band GROUP BY 1"""),
    "q43_window_zscore": with_(WINDOWS + """,
      z AS (SELECT *, (logret - avg(logret) OVER p) / CASE WHEN stddev_pop(logret) OVER p < 1e-8 THEN 1 ELSE stddev_pop(logret) OVER p END AS lz,
         (vol - avg(vol) OVER p) / CASE WHEN stddev_pop(vol) OVER p < 1e-8 THEN 1 ELSE stddev_pop(vol) OVER p END AS vz
        FROM wc WINDOW p AS (PARTITION BY ticker, end_bar))""",
      """SELECT ticker, end_bar, count(*) AS steps, round(arg_max(lz, bar), 6) AS last_logret_z, round(arg_max(vz, bar), 6) AS last_vol_z,
        round(min(lz), 6) AS min_logret_z, round(max(vz), 6) AS max_vol_z FROM z GROUP BY 1, 2"""),
    "q45_thresholds": with_(SCORED, """SELECT round(quantile_cont(model_score, 0.8), 6) AS strong_buy, round(quantile_cont(model_score, 0.55), 6) AS buy,
        round(quantile_cont(model_score, 0.3), 6) AS hold, count(*) AS n_scores FROM scored HAVING count(*) >= 10"""),
    "q59_stitch_chunks": f"""WITH d AS (SELECT {TICKER} AS ticker, CAST(l_shipdate AS DATE) AS dt, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS chunk,
         (CAST(sum({cents('l_extendedprice')}) AS BIGINT) * 200 + CAST(sum(l_quantity) AS BIGINT)) // (CAST(sum(l_quantity) AS BIGINT) * 2) / 1e4 AS close, sum(l_quantity) AS volume
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
      SELECT ticker, dt, close, volume FROM d QUALIFY row_number() OVER (PARTITION BY ticker, dt ORDER BY chunk DESC) = 1""",
    "q60_ic_summary": with_(SCORED + "," + IC, """SELECT count(*) AS n_ic, round(avg(ic), 6) AS ic_mean, round(stddev_pop(ic), 6) AS ic_std,
        round(avg(ic) / (stddev_pop(ic) + 1e-9), 6) AS icir FROM ics"""),
    "q61_walk_forward_pairs": with_(PANEL + """, p AS (SELECT DISTINCT period FROM panel),
      j AS (SELECT a.period AS test, b.period AS train, count(*) OVER (PARTITION BY a.period) AS n FROM p a JOIN p b ON b.period <= a.period - 4 - 1)""",
      "SELECT test, train FROM j WHERE n >= 3"),
    "q62_window_embedding": with_(WINDOWS, """SELECT ticker, end_bar, round(avg(logret), 6) AS emb_0, round(stddev_pop(logret), 6) AS emb_1,
        round(arg_max(logret, bar), 6) AS emb_2, count(*)::DOUBLE AS emb_3 FROM wc GROUP BY 1, 2"""),
    "q63_lookback": with_(PX, """SELECT min(n) AS min_bars, round(min(n) / 252.0::DOUBLE, 1) AS lookback_years,
        CASE WHEN round(min(n) / 252.0::DOUBLE, 1) < 2.0 THEN 'short history' ELSE 'ok' END AS status
        FROM (SELECT ticker, count(*) AS n FROM px GROUP BY 1)"""),
}
