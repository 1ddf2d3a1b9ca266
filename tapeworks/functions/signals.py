"""Signals and explanations: row-level expressions over a scored universe."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions.scalars import clip, col


def fixed(x: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, half-even on the exact binary value, keeping -0."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def filled(template: str, *values: Column) -> Column:
    """A template with ``{}`` and ``{:.nf}`` slots as one string expression."""
    parts, at, slots = [], 0, iter(values)
    for m in re.finditer(r"\{(?::\.(\d)f)?\}", template):
        value = next(slots)
        parts += [F.lit(template[at:m.start()]),
                  value.cast("string") if m.group(1) is None else fixed(value, int(m.group(1)))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:])) if parts else F.lit(template)


def n0(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def composite_score(prob: Column | str, risk: str = "medium", beta: Column | str = "beta",
                    buy="analyst_buy", hold="analyst_hold", sell="analyst_sell") -> Column:
    """Probability minus a beta penalty plus a ratings boost, within [0.05, 0.97]."""
    b = F.coalesce(F.nullif(col(beta), F.lit(0.0)), F.lit(1.0))
    penalty = F.lit(0.0)
    if risk == "low":
        penalty = F.when(b > 0.8, (b - 0.8) * 0.15).otherwise(0.0)
    elif risk == "medium":
        penalty = F.when(b > 1.5, (b - 1.5) * 0.10).otherwise(0.0)
    total = n0(buy) + n0(hold) + n0(sell)
    boost = F.when(total >= 3, (n0(buy) / total - 0.5) * 0.10).otherwise(0.0)
    return clip(col(prob) - penalty + boost, 0.05, 0.97)


def signal_of(score: Column | str, t: dict | None = None) -> Column:
    t = {**K.THRESHOLDS, **(t or {})}
    s = col(score)
    return (F.when(s > t["strong_buy"], "STRONG BUY").when(s > t["buy"], "BUY")
            .when(s > t["hold"], "HOLD").otherwise("SELL"))


def stability(score: Column | str, t: dict | None = None, margin: float = 0.03) -> Column:
    t = {**K.THRESHOLDS, **(t or {})}
    near = F.least(*[F.abs(col(score) - e) for e in t.values()])
    return F.when(near < margin, "Borderline").otherwise("Firm")


def stability_note(state: Column) -> Column:
    return F.when(state == "Borderline", K.STABILITY_NOTE)


def after_hysteresis(signal: Column, score: Column | str, prior: Column | str, prior_date: Column | str,
                     t: dict | None = None, grace: float = 0.05) -> Column:
    """struct(signal, note, applied): a fresh SELL on a name held as BUY may soften to HOLD."""
    floor = {**K.THRESHOLDS, **(t or {})}["hold"] - grace
    held = F.coalesce(col(prior).isin("BUY", "STRONG BUY"), F.lit(False))
    when = F.coalesce(F.concat(F.lit(" on "), F.nullif(col(prior_date), F.lit(""))), F.lit(" recently"))

    def note(kind: str) -> Column:
        head, tail = K.HYSTERESIS_NOTES[kind].split("{when}")
        return F.concat(F.lit(head), when, F.lit(tail))

    soft = held & (signal == "SELL") & (col(score) >= floor)
    text = (F.when(soft, note("softened")).when(held & (signal == "HOLD"), note("intact"))
            .when(held & (signal == "SELL"), note("broken")))
    return F.struct(F.when(soft, "HOLD").otherwise(signal).alias("signal"), text.alias("note"), soft.alias("applied"))


def size_tier(signal: Column, vol: Column | str, beta: Column | str) -> Column:
    """struct(tier, note): conviction tier, one notch down for volatile names."""
    v, b = col(vol), col(beta)
    wild = F.coalesce(v > 0.45, F.lit(False))
    steep = F.coalesce(b > 1.5, F.lit(False))
    down = wild | steep
    tier = (F.when(signal == "SELL", "Avoid").when(signal == "HOLD", "—")
            .when(signal == "STRONG BUY", F.when(down, "Medium").otherwise("Large"))
            .otherwise(F.when(down, "Small").otherwise("Medium")))
    why = F.concat_ws(
        ", ",
        F.when(wild, filled("high volatility ({:.0f}% annualised)", v * 100)),
        F.when(steep, filled("high beta ({:.1f})", b)))
    note = F.when(down & ~signal.isin("SELL", "HOLD"), F.concat(F.lit("Size smaller — "), why))
    return F.struct(tier.alias("tier"), note.alias("note"))


def action_note(signal: Column) -> Column:
    notes = F.create_map(*[F.lit(v) for kv in K.ACTION_NOTES.items() for v in kv])
    return F.coalesce(F.try_element_at(notes, signal), F.lit(""))


def factor_profile(pe="pe_ratio", ev="ev_ebitda", mg="net_margin", fcf="fcf_yield", rg="revenue_growth",
                   mc="log_mktcap", m12="mom_12m") -> Column:
    """struct of five rule scores in percent."""
    pe, ev, mg, fcf, rg, mc, m12 = [col(c) for c in (pe, ev, mg, fcf, rg, mc, m12)]
    yield_ = F.when(pe > 0, 1 / pe)
    value = F.when(yield_ > 0.06, 0.03).when(yield_ < 0.02, -0.02).otherwise(0.0) + (
        F.when(ev > 0, F.when(ev < 12, 0.01).when(ev > 22, -0.01).otherwise(0.0)).otherwise(0.0))
    quality = F.when(mg > 0.20, 0.025).when(mg < 0.08, -0.015).otherwise(0.005) + (
        F.when(fcf > 0.04, 0.01).when(fcf < 0, -0.01).otherwise(0.0))
    investment = F.when(rg < 0.05, 0.015).when(rg > 0.20, -0.020).otherwise(0.0)
    import math
    size = F.when(mc < math.log(1e10), 0.04).when(mc < math.log(5e10), 0.01).otherwise(-0.01)
    momentum = F.when(m12 > 0.20, 0.03).when(m12 < -0.05, -0.025).otherwise(0.005)
    scores = {"value": value, "quality": quality, "investment": investment, "size": size, "momentum": momentum}
    return F.struct(*[F.round(v * 100, 2).alias(k) for k, v in scores.items()])


def _points(rules, ratings_of: str) -> Column:
    buy, hold, sell = n0("analyst_buy"), n0("analyst_hold"), n0("analyst_sell")
    total = buy + hold + sell
    hits = []
    for name, above, below, factor, text in rules:
        if name == "ratings":
            of = buy if ratings_of == "buy" else sell
            rule = (total >= 3) & (of / F.nullif(total, F.lit(0)) > above)
            hits.append(F.when(rule, filled(text, of, total)))
            continue
        x = F.col(name)
        tests = [x != 0]
        if above is not None:
            tests.append(x > above)
        if below is not None:
            tests.append(x < below)
        hits.append(F.when(reduce(lambda a, b: a & b, tests), filled(text, x * factor)))
    return F.array_compact(F.array(*hits))


def bull_points() -> Column:
    """Reasons for, in fixed order, from the feature columns of the row."""
    return _points(K.BULL_RULES, "buy")


def bear_points() -> Column:
    return _points(K.BEAR_RULES, "sell")


def is_buy(signal: Column) -> Column:
    return signal.isin("STRONG BUY", "BUY")


def reasons(signal: Column, bull: Column, bear: Column, n: int = 4) -> Column:
    """One side by signal: for a buy the bull points, else the bear points."""
    return F.slice(F.when(is_buy(signal), bull).otherwise(bear), 1, n)


def thesis(bull: Column, bear: Column, n: int = 3) -> Column:
    return F.struct(F.slice(bull, 1, n).alias("bull"), F.slice(bear, 1, n).alias("bear"))
