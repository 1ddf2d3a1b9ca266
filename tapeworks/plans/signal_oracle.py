"""DuckDB SQL giving the same rows as ``signal_queries``."""

from __future__ import annotations

import re

from tapeworks import constants as K
from tapeworks.plans import market as M
from tapeworks.plans.panel_oracle import (
    BARS, EXAMPLES, INDUSTRY, MONTHLY, SCORED, TICKER, cents, features, r6, rank, with_,
)
from tapeworks.plans.signal_queries import NOW

PF = K.PRICE_FEATURES


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill(template: str, *args: str) -> str:
    parts, at, slots = [], 0, iter(args)
    for m in re.finditer(r"\{(?::\.(\d)f)?\}", template):
        x = next(slots)
        parts += [text(template[at:m.start()]), f"CAST({x} AS VARCHAR)" if m.group(1) is None else f"printf('%.{m.group(1)}f', {x})"]
        at = m.end()
    return " || ".join(parts + [text(template[at:])])


def points(rules, of: str) -> str:
    hits = []
    for name, above, below, factor, words in rules:
        if name == "ratings":
            hits.append(f"CASE WHEN ratings >= 3 AND {of} / ratings > {above} THEN {fill(words, of, 'ratings')} END")
            continue
        tests = [f"{name} <> 0"] + ([f"{name} > {above}"] if above is not None else []) + ([f"{name} < {below}"] if below is not None else [])
        hits.append(f"CASE WHEN {' AND '.join(tests)} THEN {fill(words, f'{name} * {factor}')} END")
    return f"[x FOR x IN [{', '.join(hits)}] IF x IS NOT NULL]"


def joined(lst: str, n: int) -> str:
    return f"coalesce(array_to_string(({lst})[1:{n}], ' | '), '')"


FUND = f"""tot AS (SELECT {TICKER} AS ticker, count(*) AS c, CAST(sum(l_quantity) AS BIGINT) AS q,
   CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS v, CAST(sum({cents('l_tax')}) AS BIGINT) AS t, CAST(sum({cents('l_discount')}) AS BIGINT) AS d,
   count(*) FILTER (l_returnflag = 'A') AS ra, count(*) FILTER (l_returnflag = 'N') AS rn, count(*) FILTER (l_returnflag = 'R') AS rr
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
raw AS (SELECT ticker, {', '.join(f'{e} AS {k}' for k, e in M.FUNDAMENTAL_TEXT.items())},
   {', '.join(f'{e} AS {k}' for k, e in M.RATING_COUNTS.items())},
   c * 13 % 70 / 100.0::DOUBLE + 0.2::DOUBLE AS prior_score, (v + q) % 100 / 100.0::DOUBLE AS inst_ownership, (c + d) % 30 / 100.0::DOUBLE AS insider_ownership FROM tot),
fund AS (SELECT ticker, try_cast(pe AS DOUBLE) AS pe_ratio, try_cast(forward_pe AS DOUBLE) AS forward_pe, try_cast(pb AS DOUBLE) AS pb_ratio,
   try_cast(roe AS DOUBLE) AS roe, try_cast(net_margin AS DOUBLE) AS net_margin, try_cast(fcf_yield_pct AS DOUBLE) / 100 AS fcf_yield,
   coalesce(nullif(try_cast(ev_ebitda_annual AS DOUBLE), 0), nullif(try_cast(ev_ebitda AS DOUBLE), 0)) AS ev_ebitda,
   try_cast(revenue_growth AS DOUBLE) AS revenue_growth, try_cast(debt_equity AS DOUBLE) AS debt_equity,
   try_cast(dividend_yield_pct AS DOUBLE) / 100 AS dividend_yield, try_cast(beta AS DOUBLE) AS beta,
   coalesce(try_cast(cap_millions AS DOUBLE), 0) * 1000000 AS market_cap, analyst_buy, analyst_hold, analyst_sell,
   ln(greatest(coalesce(try_cast(cap_millions AS DOUBLE), 0) * 1000000, 1e6)) AS log_mktcap,
   CASE WHEN analyst_buy + analyst_hold + analyst_sell >= 3 THEN (analyst_buy - analyst_sell) / (analyst_buy + analyst_hold + analyst_sell) END AS analyst_consensus,
   prior_score, inst_ownership, insider_ownership FROM raw)"""
CORE = [c for c in PF if c != "price_vs_52w_high"]
LATEST = BARS + "," + features("bars", "panel", "lf") + f""", {FUND}, {MONTHLY}, {INDUSTRY},
sur AS (SELECT ticker, greatest(least(avg(surprise_pct) / 50, 1), -1) AS earnings_surprise FROM (
   SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS rn FROM earnings) WHERE rn <= 4 GROUP BY 1),
latest AS (SELECT f.ticker, f.bar, f.close AS last_price, {', '.join('f.' + c for c in CORE)}, f.price_vs_52w_high AS high_any,
   CASE WHEN f.bar + 1 >= 252 THEN f.price_vs_52w_high END AS price_vs_52w_high, f.mom_12m AS trailing_ret,
   fund.* EXCLUDE (ticker), earnings_surprise, industry, sector
  FROM lf f LEFT JOIN fund USING (ticker) LEFT JOIN sur USING (ticker) LEFT JOIN sectors USING (ticker)
  QUALIFY f.bar = max(f.bar) OVER (PARTITION BY f.ticker)),
meta AS (SELECT ticker, last_price, trailing_ret, market_cap, analyst_buy, analyst_hold, analyst_sell, inst_ownership, insider_ownership,
   prior_score, sector, analyst_buy + analyst_hold + analyst_sell AS ratings FROM latest),
bnd AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi' for c in K.FEATURES)} FROM latest),
win AS (SELECT ticker, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_lo), {c}_hi) END AS {c}' for c in K.FEATURES)} FROM latest, bnd),
rnk AS (SELECT ticker, {', '.join(f'{rank(c, "")} AS {c}_rank' for c in K.FEATURES)} FROM win),
med AS (SELECT {', '.join(f'median({c}) AS {c}_m' for c in K.FEATURES)} FROM win),
ff AS (SELECT ticker, {', '.join(f'coalesce({c}, {c}_m, 0.5) AS {c}' for c in K.FEATURES)} FROM win, med)"""


def ref_col(c: str) -> str:
    return "high_any" if c == "price_vs_52w_high" else c


PROFILE = """round(100 * (CASE WHEN pe_ratio > 0 AND 1 / pe_ratio > 0.06 THEN 0.03 WHEN pe_ratio > 0 AND 1 / pe_ratio < 0.02 THEN -0.02 ELSE 0 END
   + CASE WHEN ev_ebitda > 0 AND ev_ebitda < 12 THEN 0.01 WHEN ev_ebitda > 22 THEN -0.01 ELSE 0 END)::DOUBLE, 2) AS value,
 round(100 * (CASE WHEN net_margin > 0.20 THEN 0.025 WHEN net_margin < 0.08 THEN -0.015 ELSE 0.005 END
   + CASE WHEN fcf_yield > 0.04 THEN 0.01 WHEN fcf_yield < 0 THEN -0.01 ELSE 0 END)::DOUBLE, 2) AS quality,
 (CASE WHEN revenue_growth < 0.05 THEN 1.5 WHEN revenue_growth > 0.20 THEN -2 ELSE 0 END)::DOUBLE AS investment,
 (CASE WHEN log_mktcap < ln(1e10) THEN 4 WHEN log_mktcap < ln(5e10) THEN 1 ELSE -1 END)::DOUBLE AS size,
 (CASE WHEN mom_12m > 0.20 THEN 3 WHEN mom_12m < -0.05 THEN -2.5 ELSE 0.5 END)::DOUBLE AS momentum"""
RESULTS = LATEST + f""",
ref AS (SELECT {', '.join(f'{ref_col(c)} AS {c}' for c in PF)} FROM latest WHERE bar >= 29),
live AS (SELECT ff.ticker, {', '.join(f'''CASE WHEN (SELECT count({c}) FROM ref) >= 20 AND (SELECT count(*) FROM ref) >= 20
   THEN (SELECT count(*) FROM ref WHERE ref.{c} <= ff.{c}) / (SELECT count({c}) FROM ref)::DOUBLE ELSE coalesce({c}_rank, 0.5) END AS {c}_rank''' for c in PF)}
  FROM ff JOIN rnk USING (ticker)),
sc AS (SELECT ff.*, meta.* EXCLUDE (ticker), round(({' + '.join(f'live.{c}_rank' for c in PF)}) / 7, 6) AS prob,
   CASE WHEN prior_score > 0.68 THEN 'STRONG BUY' WHEN prior_score > 0.54 THEN 'BUY' WHEN prior_score > 0.38 THEN 'HOLD' ELSE 'SELL' END AS prior_signal
  FROM ff JOIN meta USING (ticker) JOIN live USING (ticker)),
cp AS (SELECT *, coalesce(nullif(beta, 0), 1.0) AS b1, least(greatest(prob - CASE WHEN coalesce(nullif(beta, 0), 1.0) > 1.5 THEN (coalesce(nullif(beta, 0), 1.0) - 1.5) * 0.10 ELSE 0 END
   + CASE WHEN ratings >= 3 THEN (analyst_buy / ratings - 0.5) * 0.10 ELSE 0 END, 0.05), 0.97) AS composite FROM sc),
s0 AS (SELECT *, CASE WHEN composite > 0.68 THEN 'STRONG BUY' WHEN composite > 0.54 THEN 'BUY' WHEN composite > 0.38 THEN 'HOLD' ELSE 'SELL' END AS sig0,
   prior_signal IN ('BUY', 'STRONG BUY') AS held FROM cp),
s1 AS (SELECT *, held AND sig0 = 'SELL' AND composite >= 0.38 - 0.05::DOUBLE AS soft FROM s0),
res AS (SELECT *, CASE WHEN soft THEN 'HOLD' ELSE sig0 END AS signal, round_even(composite * 100, 1) AS composite_score FROM s1)"""
WHEN = "' on 30 Sep 2001'"


def note(kind: str) -> str:
    head, tail = K.HYSTERESIS_NOTES[kind].split("{when}")
    return f"{text(head)} || {WHEN} || {text(tail)}"


HOLD = f"""hold AS (SELECT o_custkey AS portfolio_id, {TICKER} AS ticker, sum(l_quantity) AS units
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
holdings AS (SELECT portfolio_id, ticker, sector, CASE WHEN portfolio_id % 3 = 0 AND ticker = 'BRAND-7' THEN NULL ELSE units END AS weight
   FROM hold LEFT JOIN sectors USING (ticker)),
wt AS (SELECT *, bool_and(coalesce(weight > 0, false)) OVER p AS ok, sum(weight) OVER p AS total, count(*) OVER p AS n
   FROM holdings WINDOW p AS (PARTITION BY portfolio_id)),
comp AS (SELECT portfolio_id, coalesce(sector, 'Unknown') AS sector,
   round_even(CASE WHEN any_value(ok) THEN sum(weight) / any_value(total) ELSE count(*) / any_value(n)::DOUBLE END * 100, 1) AS pct FROM wt GROUP BY 1, 2)"""
OVER_HEAD, OVER_REST = K.OVER_MESSAGE.split("{pct}")
OVER_MID, OVER_TAIL = OVER_REST.split("{sector}")
GAP_HEAD, GAP_TAIL = K.GAP_MESSAGE.split("{sector}")

DRIFT = """li AS (SELECT *, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS quarter FROM lineitem),
dr AS (SELECT quarter, 'l_quantity' AS feature, l_quantity * CASE quarter WHEN '2000-Q2' THEN 1.25 WHEN '2001-Q1' THEN 2.0 ELSE 1.0 END::DOUBLE AS value FROM li
   UNION ALL SELECT quarter, 'l_extendedprice', round(l_extendedprice * 100) FROM li UNION ALL SELECT quarter, 'l_discount', round(l_discount * 100) FROM li
   UNION ALL SELECT quarter, 'l_tax', round(l_tax * 100) FROM li)"""


def stats_cols(v: str = "value") -> str:
    qs = ", ".join(f"round(quantile_cont({v}, {q}), 4) AS {n}" for n, q in (("p5", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95)))
    return f"round(avg({v}), 4) AS mean, round(stddev_pop({v}), 4) AS std, {qs}"


def drift_ctes(base: str, live: str, by: str) -> str:
    cuts = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(11))
    return f"""
bs AS (SELECT feature, list_sort(list_distinct([{cuts}])) AS e FROM {base} GROUP BY 1),
be AS (SELECT feature, e[2:len(e) - 1] AS inner_e, len(e) - 1 AS bins FROM bs WHERE len(e) >= 2),
bc AS (SELECT b.feature, len([z FOR z IN inner_e IF z <= value]) AS bin, count(*) / sum(count(*)) OVER (PARTITION BY b.feature) AS p
   FROM {base} b JOIN be USING (feature) GROUP BY b.feature, 2),
lc AS (SELECT l.{by}, l.feature, len([z FOR z IN inner_e IF z <= value]) AS bin, count(*) / sum(count(*)) OVER (PARTITION BY l.{by}, l.feature) AS p
   FROM {live} l JOIN be USING (feature) GROUP BY 1, 2, 3),
cell AS (SELECT g.{by}, be.feature, unnest(range(bins)) AS bin FROM be CROSS JOIN (SELECT DISTINCT {by} FROM {live}) g),
psi AS (SELECT c.{by}, c.feature, sum((greatest(coalesce(lc.p, 0), 1e-6) - greatest(coalesce(bc.p, 0), 1e-6))
     * ln(greatest(coalesce(lc.p, 0), 1e-6) / greatest(coalesce(bc.p, 0), 1e-6))) AS psi
   FROM cell c LEFT JOIN lc ON lc.{by} = c.{by} AND lc.feature = c.feature AND lc.bin = c.bin
   LEFT JOIN bc ON bc.feature = c.feature AND bc.bin = c.bin GROUP BY 1, 2),
st AS (SELECT {by}, feature, {stats_cols()}, round(1 - count(value) / count(*), 4) AS missing_rate, min(value) AS lo_, max(value) AS hi_ FROM {live} GROUP BY 1, 2),
drift AS (SELECT st.*, round(psi, 4) AS psi, psi AS psi_raw, CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.10 THEN 'warning' ELSE 'stable' END AS status
   FROM st JOIN psi USING ({by}, feature))"""


FEATURE_DRIFT = DRIFT + """, dbase AS (SELECT * FROM dr WHERE quarter < '1998'), dlive AS (SELECT * FROM dr WHERE quarter >= '1998'),""" + drift_ctes("dbase", "dlive", "quarter")
PRED_DRIFT = SCORED + """, pr AS (SELECT period, 'prediction' AS feature, model_score AS value FROM scored),
pbase AS (SELECT * FROM pr WHERE period <= 6), plive AS (SELECT * FROM pr WHERE period > 6),""" + drift_ctes("pbase", "plive", "period")


def hist(source: str, keys: str) -> str:
    on = " AND ".join(f"c.{k} = e.{k}" for k in keys.split(", "))
    return f"""
he AS (SELECT {keys}, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
   CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM {source} GROUP BY {keys}),
hb AS (SELECT {keys}, CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS c FROM {source} JOIN he USING ({keys}) GROUP BY ALL),
hc AS (SELECT {keys}, lo, hi, unnest(range(20)) AS bin FROM he),
hh AS (SELECT {', '.join('e.' + k for k in keys.split(', '))}, e.lo, e.hi, string_agg(CAST(coalesce(c.c, 0) AS VARCHAR), ',' ORDER BY e.bin) AS hist
   FROM hc e LEFT JOIN hb c ON {on} AND c.bin = e.bin GROUP BY ALL)"""


MATURED = SCORED + f""",
preds AS (SELECT period || ':' || ticker AS pred_id, '{M.MODEL}+enc:v1' AS model_version, period AS period_key,
   start_dt - CAST(period % 3 AS INT) AS predicted_at, ticker, model_score AS prediction, 63 AS horizon_days FROM scored),
mt_a AS (SELECT p.*, CASE WHEN predicted_at + 91 <= DATE '{NOW}' THEN (SELECT min(bar) FROM bars b WHERE b.ticker = p.ticker AND b.dt >= p.predicted_at) END AS sb FROM preds p),
mt AS (SELECT a.* EXCLUDE (sb), CASE WHEN b0.close > 0 THEN b1.close / b0.close - 1 END AS realized_return FROM mt_a a
   LEFT JOIN bars b0 ON b0.ticker = a.ticker AND b0.bar = a.sb LEFT JOIN bars b1 ON b1.ticker = a.ticker AND b1.bar = a.sb + 63)"""
ROLLING = MATURED + """,
pi_a AS (SELECT * FROM mt WHERE realized_return IS NOT NULL),
pi_b AS (SELECT *, rank() OVER (PARTITION BY period_key ORDER BY prediction) + (count(*) OVER (PARTITION BY period_key, prediction) - 1) / 2.0 AS ra,
   rank() OVER (PARTITION BY period_key ORDER BY realized_return) + (count(*) OVER (PARTITION BY period_key, realized_return) - 1) / 2.0 AS rb FROM pi_a),
pics AS (SELECT model_version, period_key, min(predicted_at) AS ts, corr(ra, rb) AS spearman, corr(prediction, realized_return) AS pearson FROM pi_b GROUP BY 1, 2
   HAVING count(*) >= 2 AND count(DISTINCT prediction) >= 2 AND count(DISTINCT realized_return) >= 2),
roll AS (""" + " UNION ALL ".join(f"""SELECT *, {w} AS "window", avg(spearman) OVER w{w} AS ic_mean, stddev_pop(spearman) OVER w{w} AS ic_std, count(*) OVER w{w} AS n_obs
   FROM pics WINDOW w{w} AS (ORDER BY ts, period_key ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)""" for w in K.IC_WINDOWS) + """),
rolled AS (SELECT *, CASE WHEN ic_std > 1e-9 THEN ic_mean / ic_std ELSE 0 END AS ic_ir FROM roll)"""

SQL = {
    "q27_composite_signal": with_(RESULTS, f"""SELECT ticker, composite_score, round_even(prob * 100, 1) AS fundamental_score, signal,
        signal IN ('STRONG BUY', 'BUY') AS is_buy,
        CASE WHEN signal = 'SELL' THEN 'Avoid' WHEN signal = 'HOLD' THEN '—' WHEN signal = 'STRONG BUY' THEN CASE WHEN vol_60d > 0.45 OR b1 > 1.5 THEN 'Medium' ELSE 'Large' END
          ELSE CASE WHEN vol_60d > 0.45 OR b1 > 1.5 THEN 'Small' ELSE 'Medium' END END AS size_tier,
        CASE WHEN signal IN ('STRONG BUY', 'BUY') AND (vol_60d > 0.45 OR b1 > 1.5) THEN 'Size smaller — ' || concat_ws(', ',
          CASE WHEN vol_60d > 0.45 THEN 'high volatility (' || printf('%.0f', vol_60d * 100) || '% annualised)' END,
          CASE WHEN b1 > 1.5 THEN 'high beta (' || printf('%.1f', b1) || ')' END) END AS size_note,
        CASE WHEN least(abs(composite - 0.68), abs(composite - 0.54), abs(composite - 0.38)) < 0.03 THEN 'Borderline' ELSE 'Firm' END AS signal_stability,
        CASE WHEN least(abs(composite - 0.68), abs(composite - 0.54), abs(composite - 0.38)) < 0.03 THEN {text(K.STABILITY_NOTE)} END AS stability_note,
        CASE signal {' '.join(f'WHEN {text(k)} THEN {text(v)}' for k, v in K.ACTION_NOTES.items())} END AS action_note, prior_signal,
        CASE WHEN soft THEN {note('softened')} WHEN held AND signal = 'HOLD' THEN {note('intact')} WHEN held AND signal = 'SELL' THEN {note('broken')} END AS hysteresis_note,
        soft AS hysteresis_applied FROM res"""),
    "q28_factor_profile": with_(LATEST, f"SELECT ticker, {PROFILE} FROM ff"),
    "q29_thesis": with_(RESULTS, f"""SELECT ticker, signal, CASE WHEN signal IN ('STRONG BUY', 'BUY') THEN {joined(points(K.BULL_RULES, 'analyst_buy'), 4)}
        ELSE {joined(points(K.BEAR_RULES, 'analyst_sell'), 4)} END AS reasons,
        {joined(points(K.BULL_RULES, 'analyst_buy'), 3)} AS bull, {joined(points(K.BEAR_RULES, 'analyst_sell'), 3)} AS bear FROM res"""),
    "q30_profile_score": with_(LATEST + f""",
      st AS (SELECT ticker, pe_ratio AS pe, pb_ratio AS pb, roe, debt_equity AS de, dividend_yield AS dy, revenue_growth AS rg, net_margin AS mg,
        mom_12m AS m12, mom_3m AS m3, beta, market_cap / 1e9 AS mc FROM ff JOIN meta USING (ticker)),
      mm AS (SELECT ticker, pe, mg, rg, m12, beta, mc, {', '.join(f'coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0.5) AS n_{c}' for c in K.PROFILE_COLUMNS)} FROM st),
      w({', '.join(['profile'] + ['w_' + c for c in K.PROFILE_COLUMNS])}) AS (VALUES {', '.join('(' + ', '.join([text(k)] + [f'{x}::DOUBLE' for x in v]) + ')' for k, v in K.PROFILE_WEIGHTS.items())}),
      f AS (SELECT profile, ticker, least(greatest({' + '.join(f'w_{c} * n_{c}' for c in K.PROFILE_COLUMNS)} - 0.10 * greatest(0, beta - 1.5) - 0.10 * 0.05 + 0.42, 0), 1) AS fund,
        CASE WHEN pe > 0 AND 1 / pe > 0.06 THEN 0.03 WHEN pe > 0 AND 1 / pe < 0.02 THEN -0.02 ELSE 0 END::DOUBLE + CASE WHEN mg > 0.20 THEN 0.025 WHEN mg < 0.08 THEN -0.015 ELSE 0.005 END::DOUBLE
        + CASE WHEN rg < 0.05 THEN 0.015 WHEN rg > 0.20 THEN -0.02 ELSE 0 END::DOUBLE + CASE WHEN m12 > 0.20 THEN 0.03 WHEN m12 < -0.05 THEN -0.025 ELSE 0.005 END::DOUBLE AS tilt,
        CASE WHEN mc < 100 THEN 0.04 WHEN mc < 400 THEN 0.01 ELSE -0.01 END::DOUBLE AS size FROM mm, w)""",
      """SELECT profile, ticker, round(fund, 3) AS fund_score, round((tilt + size) * 100 / 5 + 50, 1) AS quant_score,
        round(least(greatest(fund + tilt * 0.35, 0.04), 0.97), 6) AS score FROM f"""),
    "q31_prior_signals": """WITH r AS (SELECT *, 'T' || json_extract_string(props, '$.k') AS ticker FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 60)
      SELECT user_id, ticker, CASE WHEN value > 80 THEN 'STRONG BUY' WHEN value > 50 THEN 'BUY' WHEN value > 20 THEN 'HOLD' ELSE 'SELL' END AS signal,
        round(least(value, 100), 6) AS score, strftime(ts, '%d %b %Y') AS date FROM r
      QUALIFY row_number() OVER (PARTITION BY user_id, ticker ORDER BY ts DESC, event_id DESC) = 1""",
    "q32_composition": with_(INDUSTRY + ", " + HOLD, "SELECT portfolio_id, sector, pct FROM comp"),
    "q33_flags": with_(INDUSTRY + ", " + HOLD, f"""SELECT portfolio_id, 'over' AS type, sector, pct,
        {text(OVER_HEAD)} || printf('%.0f', pct) || {text(OVER_MID)} || sector || {text(OVER_TAIL)} AS message FROM comp WHERE sector <> 'Unknown' AND pct > 40
        UNION ALL SELECT p.portfolio_id, 'gap', s, 0.0, {text(GAP_HEAD)} || s || {text(GAP_TAIL)}
        FROM (SELECT DISTINCT portfolio_id FROM comp) p CROSS JOIN (SELECT unnest({K.CORE_SECTORS}) AS s)
        WHERE NOT EXISTS (SELECT 1 FROM comp c WHERE c.portfolio_id = p.portfolio_id AND c.sector = s AND c.pct > 0)"""),
    "q34_recommend": with_(RESULTS + ", " + HOLD + f""",
      gp AS (SELECT p.portfolio_id, s AS sector, coalesce(c.pct, 0) AS pct, 100.0::DOUBLE / 11 - coalesce(c.pct, 0) AS gap
        FROM (SELECT DISTINCT portfolio_id FROM comp) p CROSS JOIN (SELECT unnest({K.SECTORS}) AS s) LEFT JOIN comp c ON c.portfolio_id = p.portfolio_id AND c.sector = s),
      pool AS (SELECT g.*, r.ticker, r.composite_score, r.signal FROM gp g JOIN res r ON r.sector = g.sector WHERE gap > 0
        AND NOT EXISTS (SELECT 1 FROM hold h WHERE h.portfolio_id = g.portfolio_id AND h.ticker = r.ticker)),
      two AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY portfolio_id, sector ORDER BY composite_score DESC, ticker) <= 2),
      five AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY gap DESC, composite_score DESC, ticker) AS rank FROM two)""",
      """SELECT portfolio_id, rank, ticker, sector, composite_score,
        'Adds ' || sector || ' exposure (you hold ' || printf('%.0f', pct) || '%); the model rates it ' || signal || '.' AS rationale FROM five WHERE rank <= 5"""),
    "q35_build_portfolio": with_(RESULTS + """,
      k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY composite_score DESC, ticker) <= 3 AS capped FROM res),
      o AS (SELECT *, row_number() OVER (ORDER BY capped DESC, composite_score DESC, ticker) AS place FROM k), z AS (SELECT * FROM o WHERE place <= 15)""",
      """SELECT place, ticker, sector, composite_score, round_even(100.0 / count(*) OVER (), 1)::DOUBLE AS weight,
        signal || ' · ' || sector || ' — among the model''s strongest current picks' AS rationale FROM z"""),
    "q36_dist_stats": with_(DRIFT, f"SELECT feature, {stats_cols()}, round(1 - count(value) / count(*), 4) AS missing_rate, count(*) AS n FROM dr GROUP BY 1"),
    "q37_feature_psi": with_(FEATURE_DRIFT, "SELECT * EXCLUDE (psi_raw, lo_, hi_) FROM drift"),
    "q38_mature_labels": with_(MATURED, """SELECT pred_id, model_version, period_key, predicted_at, ticker, prediction, horizon_days,
        round(realized_return, 6) AS realized_return, realized_return IS NOT NULL AS matured FROM mt"""),
    "q39_rolling_ic": with_(ROLLING, f"""SELECT model_version, period_key, ts, "window", n_obs, {r6('spearman pearson ic_mean ic_std ic_ir')} FROM rolled"""),
    "q40_alert_decide": with_(ROLLING + ", " + FEATURE_DRIFT + f""",
      tr AS (SELECT avg(spearman) AS train FROM pics WHERE period_key <= 6),
      lv AS (SELECT *, ic_mean / train AS ratio, year(ts) || '-Q' || quarter(ts) AS at_q, CASE WHEN train IS NULL OR train <= 0 THEN 'ok'
          WHEN count(*) OVER w3 = 3 AND max(ic_mean) OVER w3 < 0.5 * train THEN 'RETRAIN' WHEN ic_mean < 0.5 * train THEN 'CRITICAL'
          WHEN ic_mean < 0.7 * train THEN 'WARNING' ELSE 'ok' END AS level, train FROM rolled, tr WHERE "window" = 60
          WINDOW w3 AS (ORDER BY ts, period_key ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
      pd AS (SELECT period, psi_raw AS ppsi, status AS pstatus, year(began) || '-Q' || quarter(began) AS at_q, began
          FROM ({with_(PRED_DRIFT, "SELECT period, psi_raw, status FROM drift")}) JOIN (SELECT period, min(start_dt) AS began FROM scored GROUP BY 1) USING (period)),
      dq AS (SELECT quarter, max(psi_raw) AS mx, coalesce(list(feature ORDER BY feature) FILTER (status = 'critical'), []) AS cr,
          coalesce(list(feature ORDER BY feature) FILTER (status = 'warning'), []) AS wa FROM drift GROUP BY 1),
      j AS (SELECT dq.*, period_key, ic_mean, level, CASE WHEN train > 0 THEN ratio END AS ratio, ppsi, pstatus,
          coalesce(CAST(level IN ('RETRAIN', 'CRITICAL') AS INT), 0) + CAST(len(cr) > 0 AS INT) + coalesce(CAST(pstatus = 'critical' AS INT), 0) AS r,
          coalesce(CAST(level = 'WARNING' AS INT), 0) + CAST(len(cr) = 0 AND len(wa) > 0 AS INT) + coalesce(CAST(pstatus = 'warning' AS INT), 0) AS w
        FROM dq LEFT JOIN LATERAL (SELECT * FROM lv WHERE lv.at_q <= dq.quarter ORDER BY ts DESC, period_key DESC LIMIT 1) ic ON true
          LEFT JOIN LATERAL (SELECT * FROM pd WHERE pd.at_q <= dq.quarter ORDER BY began DESC, period DESC LIMIT 1) p ON true)""",
      f"""SELECT '{M.MODEL}+enc:v1' AS model_version, quarter, period_key AS ic_period, round(ic_mean, 6) AS rolling_ic, level AS ic_level, round(ratio, 6) AS ic_ratio, round(mx, 6) AS max_psi,
        CASE WHEN r > 0 THEN 'retrain' WHEN w > 0 THEN 'watch' ELSE 'healthy' END AS status,
        CASE WHEN r > 0 THEN round(r / 3, 2) WHEN w > 0 THEN round(w / 3, 2) ELSE 1.0 END AS confidence,
        array_to_string(cr, ',') AS critical, array_to_string(wa, ',') AS warning,
        array_to_string([x FOR x IN [
          CASE level WHEN 'RETRAIN' THEN 'IC below ' || printf('%.2f', ratio) || '× training IC for consecutive windows'
            WHEN 'CRITICAL' THEN 'Rolling IC critically low (' || printf('%.2f', ratio) || '× training IC)'
            WHEN 'WARNING' THEN 'Rolling IC deteriorating (' || printf('%.2f', ratio) || '× training IC)' END,
          CASE WHEN len(cr) > 0 THEN 'Critical feature drift (PSI≥0.25): ' || array_to_string(cr[1:5], ', ')
            WHEN len(wa) > 0 THEN 'Moderate feature drift on ' || len(wa) || ' feature(s)' END,
          CASE pstatus WHEN 'critical' THEN 'Prediction distribution drift (PSI=' || printf('%.2f', ppsi) || ')' WHEN 'warning' THEN 'Mild prediction distribution drift' END,
          CASE WHEN r = 0 AND w = 0 THEN 'IC stable and no material drift' END] IF x IS NOT NULL], ' | ') AS reasons FROM j"""),
    "q44_sector_norm": """SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Consumer Discretionary' WHEN 'MACHINERY' THEN 'Industrials'
        WHEN 'HOUSEHOLD' THEN 'Consumer Staples' ELSE 'Unknown' END AS sector FROM customer""",
    "q58_sector_etf": """SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'XLY' WHEN 'MACHINERY' THEN 'XLI' END AS benchmark FROM customer""",
    "q46_paging": "SELECT event_id, user_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100",
    "q47_summaries": with_(RESULTS + f""", pr AS (SELECT ticker, {PROFILE} FROM ff)""", """
        SELECT 'headline' AS section, 'buys' AS name, count(*) FILTER (signal IN ('BUY', 'STRONG BUY'))::DOUBLE AS x FROM res
        UNION ALL SELECT 'headline', 'holds', count(*) FILTER (signal = 'HOLD') FROM res UNION ALL SELECT 'headline', 'sells', count(*) FILTER (signal = 'SELL') FROM res
        UNION ALL SELECT 'headline', 'stocks', count(*) FROM res UNION ALL SELECT 'headline', 'avg_score', round_even(avg(composite_score), 0) FROM res
        UNION ALL (SELECT 'top_pick', ticker || '/' || signal, 1.0 FROM res ORDER BY composite_score DESC, ticker LIMIT 1)
        UNION ALL SELECT 'factor', 'value', round(avg(value), 2) FROM pr UNION ALL SELECT 'factor', 'quality', round(avg(quality), 2) FROM pr
        UNION ALL SELECT 'factor', 'investment', round(avg(investment), 2) FROM pr UNION ALL SELECT 'factor', 'size', round(avg(size), 2) FROM pr
        UNION ALL SELECT 'factor', 'momentum', round(avg(momentum), 2) FROM pr
        UNION ALL SELECT 'exposure', 'US:' || left(sector, 12), count(*) FROM res GROUP BY 2
        UNION ALL (SELECT 'showcase', ticker, composite_score FROM res WHERE signal IN ('BUY', 'STRONG BUY') ORDER BY composite_score DESC, ticker LIMIT 4)
        UNION ALL (SELECT 'showcase', ticker, composite_score FROM res WHERE signal = 'SELL' ORDER BY composite_score, ticker DESC LIMIT 2)"""),
    "q48_clean_fundamentals": with_(FUND, f"""SELECT ticker, {r6('pe_ratio forward_pe pb_ratio roe net_margin fcf_yield ev_ebitda revenue_growth debt_equity dividend_yield beta market_cap log_mktcap analyst_consensus')},
        analyst_buy, analyst_hold, analyst_sell, 'US' AS market FROM fund"""),
    "q49_holdings_clean": f"""WITH raw AS (SELECT l_orderkey AS portfolio_id, l_linenumber * 100000000000 + l_partkey * 1000 + CAST(l_quantity AS BIGINT) AS pos,
        CASE WHEN l_partkey % 17 = 0 THEN CAST(l_partkey AS VARCHAR) WHEN l_linenumber % 3 = 0 THEN ' ' || lower({TICKER}) || '  ' ELSE {TICKER} END AS ticker,
        CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 'abc' WHEN l_partkey % 11 = 0 THEN '-5' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS weight
        FROM lineitem JOIN part ON l_partkey = p_partkey),
      t AS (SELECT *, upper(trim(ticker)) AS u, try_cast(weight AS DOUBLE) AS w, count(*) OVER (PARTITION BY portfolio_id) AS size FROM raw),
      x AS (SELECT *, CASE WHEN size > 40 THEN 'too many holdings' WHEN NOT (regexp_matches(u, '^[A-Z0-9.\\-]{{1,15}}$') AND regexp_matches(u, '[A-Z]')) THEN 'invalid ticker'
        WHEN weight IS NOT NULL AND w IS NULL THEN 'weight is not a number' WHEN w < 0 OR w > 100 THEN 'weight out of range' END AS reason FROM t)
      SELECT portfolio_id, pos, u AS ticker, 'ok' AS outcome, w AS weight FROM x WHERE reason IS NULL
        QUALIFY row_number() OVER (PARTITION BY portfolio_id, u ORDER BY pos) = 1
      UNION ALL SELECT portfolio_id, pos, ticker, reason, w FROM x WHERE reason IS NOT NULL""",
    "q50_symbol_search": """WITH s AS (SELECT CASE WHEN p_type = 'PROMO' THEN 'X:' ELSE '' END || 'P' || p_partkey AS symbol, p_name AS name,
        CASE WHEN p_type IN ('SMALL', 'LARGE', 'PROMO') THEN 'Common Stock' WHEN p_type = 'MEDIUM' THEN 'ETF' ELSE 'ADR' END AS type FROM part)
      SELECT symbol AS ticker, name, type FROM s WHERE (contains(lower(symbol), 'ring') OR contains(lower(name), 'ring')) AND type = 'Common Stock' AND NOT contains(symbol, ':')
      ORDER BY 1, 2 LIMIT 15""",
    "q51_flat_record": with_(BARS + ", " + FUND + """,
      k AS (SELECT *, max(bar) OVER (PARTITION BY ticker) - bar AS back FROM bars),
      m AS (SELECT ticker, max(close) FILTER (back = 0) AS last_price, max(close) FILTER (back = 251) AS y, max(close) FILTER (back = 62) AS q3 FROM k GROUP BY 1)""",
      """SELECT ticker, last_price, round(pe_ratio, 6) AS pe_ratio, round(pb_ratio, 6) AS pb_ratio, round(beta, 6) AS beta, market_cap,
        round(last_price / y - 1, 4) AS momentum_12m, round(last_price / q3 - 1, 4) AS momentum_3m, round(market_cap / 1e9, 1) AS market_cap_bn FROM m LEFT JOIN fund USING (ticker)"""),
    "q52_freshness": """SELECT user_id, event_id, ts, ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2 HOURS AS fresh FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "q53_prediction_drift": with_(PRED_DRIFT + "," + hist("plive", "period, feature"),
        "SELECT period, feature, psi, status, mean, std, p5, p25, p50, p75, p95, round(lo, 4) AS lo, round(hi, 4) AS hi, hist FROM drift JOIN hh USING (period, feature)"),
    "q54_latest_state": "WITH a AS (" + with_(FEATURE_DRIFT, "SELECT feature, psi, status, mean, std, quarter AS period_key FROM drift QUALIFY row_number() OVER (PARTITION BY feature ORDER BY quarter DESC) = 1")
        + "), b AS (" + with_(PRED_DRIFT, "SELECT feature, psi, status, mean, std, CAST(period AS VARCHAR) AS period_key FROM drift ORDER BY period DESC LIMIT 1")
        + f") SELECT '{M.MODEL}+enc:v1' AS model_version, * FROM a UNION ALL SELECT '{M.MODEL}+enc:v1', * FROM b",
    "q55_snapshot_features": with_(LATEST, f"""SELECT ticker, {r6(' '.join(K.FEATURES))}, {r6(' '.join(c + '_rank' for c in K.FEATURES))} FROM ff JOIN rnk USING (ticker)"""),
    "q56_snapshot_labels": with_(LATEST + """, lb AS (SELECT *, median(trailing_ret) OVER () AS m, count(*) OVER () AS n FROM meta WHERE trailing_ret IS NOT NULL)""",
        f"""SELECT ticker, {', '.join(f'round(coalesce({c}_rank, 0.5), 6) AS {c}_rank' for c in PF)}, trailing_ret AS fwd_ret, CAST(trailing_ret > m AS BIGINT) AS label,
        true AS is_snapshot, CAST(coalesce(mom_12m_rank, 0.5) >= 0.5 AS BIGINT) AS fallback_label FROM lb JOIN rnk USING (ticker) WHERE n >= 3"""),
    "q57_ownership_earnings": with_(MONTHLY + f""",
      h AS (SELECT {TICKER} AS ticker, l_suppkey, sum(l_quantity) AS u FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
      p AS (SELECT *, u / sum(u) OVER (PARTITION BY ticker) * 100 AS pct FROM h),
      o AS (SELECT ticker, least(greatest(sum(pct) / 100, 0), 1) AS inst FROM (FROM p QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pct DESC, l_suppkey) <= 20) GROUP BY 1),
      e AS (SELECT ticker, min(announce_date) AS nx FROM earnings WHERE announce_date BETWEEN DATE '2001-10-01' AND DATE '2001-10-01' + 90 GROUP BY 1)""",
      """SELECT o.ticker, round(inst, 6) AS inst_ownership, nx AS next_earnings_date, date_diff('day', DATE '2001-10-01', nx) AS days_to_earnings FROM o LEFT JOIN e USING (ticker)"""),
    "q64_retention": f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '{M.AS_OF}' - INTERVAL 730 DAYS",
    "q65_training_universe": "SELECT DISTINCT c_name AS ticker FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') AND c_custkey IN (SELECT o_custkey FROM orders)",
    "q66_market_histogram": with_(DRIFT + "," + hist("dr", "feature"), "SELECT feature, round(lo, 6) AS lo, round(hi, 6) AS hi, hist FROM hh"),
    "q67_signal_payload": with_(RESULTS, "SELECT 'run' AS run, ticker, signal, composite_score AS score FROM res"),
}
_BANDS = EXAMPLES + """,
      c AS (SELECT CASE WHEN model_score >= 70 THEN 'High' WHEN model_score >= 55 THEN 'Moderate' WHEN model_score >= 38 THEN 'Low' ELSE 'Bearish' END AS band, actual_top FROM ex)"""
SQL["q68_insights"] = (
    "WITH bands AS (" + with_(_BANDS, "SELECT band, round_even(avg(CAST(actual_top AS INT)) * 100, 1) AS band_hit_rate FROM c GROUP BY 1") + "), rr AS ("
    + with_(RESULTS, f"""SELECT ticker, signal, composite_score, CASE WHEN composite_score >= 70 THEN 'High' WHEN composite_score >= 55 THEN 'Moderate'
        WHEN composite_score >= 38 THEN 'Low' ELSE 'Bearish' END AS band, {joined(points(K.BULL_RULES, 'analyst_buy'), 3)} AS bull,
        {joined(points(K.BEAR_RULES, 'analyst_sell'), 3)} AS bear FROM res""")
    + ") SELECT rr.*, band_hit_rate FROM rr LEFT JOIN bands USING (band)")
