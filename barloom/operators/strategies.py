"""Rule strategies as column builders, with a declared output vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.functions.cols import c, flag
from pyspark.sql import functions as F


def one_hot(df: DataFrame, strategy: str, column: str, vocabulary: list[str]) -> DataFrame:
    """``strategy__id__column__value`` flags over a declared vocabulary; null counts as ``missing``."""
    v = F.coalesce(c(column), F.lit("missing"))
    return df.withColumns({f"strategy__{strategy}__{column}__{x}": flag(v == x) for x in vocabulary})


def complete_vocabulary(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Zero columns for vocabulary entries whose strategy column has at least one sibling present."""
    stem = lambda n: n.rsplit("__", 1)[0]
    present = {stem(n) for n in df.columns if n.startswith("strategy__")}
    return df.withColumns({n: F.lit(0) for n in vocabulary if n not in df.columns and stem(n) in present})


# ---- parameterised rules ----------------------------------------------------------------------------------------------------
# Each takes block rows and a frame and adds columns; ``lookback`` in RULES is the halo it needs.
from collections.abc import Callable  # noqa: E402
from dataclasses import dataclass, field  # noqa: E402

from barloom.functions import clock  # noqa: E402
from barloom.functions.cols import pct, safe_div, sign3, true_range  # noqa: E402
from barloom.operators.blocks import Frame, blocked  # noqa: E402


def side(up, down):
    return F.when(up, "long").when(down, "short").otherwise("neutral")


def wma(w: Frame, x: str, n: int):
    """Linearly weighted mean, newest heaviest."""
    win = F.collect_list(x).over(w.rows(-(n - 1), 0))
    wt = F.array(*[F.lit(float(k)) for k in range(1, n + 1)])
    tot = F.aggregate(F.zip_with(win, wt, lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(win) == n, tot / (n * (n + 1) / 2.0))


def ma_cross(d, w, fast=5, slow=20, kind="sma", name="ma"):
    """Fast versus slow average: level state and the bar on which it changes. ``ema`` expects ema_<n> columns."""
    avg = {"sma": lambda n: w.mean("close", n), "wma": lambda n: wma(w, "close", n), "ema": lambda n: c(f"ema_{n}")}[kind]
    d = d.withColumns({"_f": avg(fast), "_s": avg(slow)})
    d = d.withColumn(f"{name}_state", sign3(c("_f") > c("_s"), c("_f") < c("_s")))
    prev = F.coalesce(w.lag(f"{name}_state"), F.lit(0))
    s = c(f"{name}_state")
    return d.withColumn(f"{name}_signal", side((s == 1) & (prev != 1), (s == -1) & (prev != -1))).drop("_f", "_s")


def envelope(d, w, n=20, width=0.25):
    d = d.withColumn("_m", w.mean("close", n))
    return d.withColumn("envelope_signal", side(c("close") > c("_m") * (1 + width), c("close") < c("_m") * (1 - width))).drop("_m")


def rsi_levels(d, w, n=14, high=70.0, low=30.0):
    """Simple-mean RSI with level crosses; the Wilder form is the rsi_14 column."""
    chg = c("close") - w.lag("close")
    d = d.withColumns({"_u": F.when(chg.isNotNull(), F.greatest(chg, F.lit(0.0))), "_d": F.when(chg.isNotNull(), F.greatest(-chg, F.lit(0.0)))})
    d = d.withColumns({"_u": w.mean("_u", n), "_d": w.mean("_d", n)})
    d = d.withColumn("rsi_simple", F.when(c("_d") != 0, 100 - 100 / (1 + c("_u") / c("_d"))))
    r, p = c("rsi_simple"), w.lag("rsi_simple")
    return d.withColumn("rsi_signal", side((r > low) & (p <= low), (r < high) & (p >= high))).drop("_u", "_d")


def macd_rules(d, w):
    """MACD line over its signal and the percentage oscillator; expects the smooth kernel's columns."""
    d = d.withColumns({"_x": c("macd_line") - c("macd_signal"), "ppo": safe_div(c("ema_8") - c("ema_21"), "ema_21") * 100})
    return d.withColumn("macd_signal_side", side((c("_x") > 0) & (w.lag("_x") <= 0), (c("_x") < 0) & (w.lag("_x") >= 0))).drop("_x")


def stochastic(d, w, k=14, smooth=3, high=80.0, low=20.0):
    d = d.withColumns({"_h": w.max("high", k), "_l": w.min("low", k)})
    d = d.withColumns({"stoch_k": safe_div(c("close") - c("_l"), c("_h") - c("_l")) * 100, "williams_r": safe_div(c("_h") - c("close"), c("_h") - c("_l")) * -100})
    d = d.withColumn("stoch_d", w.mean("stoch_k", smooth))
    return d.withColumn("stoch_signal", side((c("stoch_d") < low) & (c("stoch_k") > c("stoch_d")), (c("stoch_d") > high) & (c("stoch_k") < c("stoch_d")))).drop("_h", "_l")


def bollinger(d, w, n=20, k=2.0):
    d = d.withColumns({"_m": w.mean("close", n), "_s": w.std("close", n)})
    d = d.withColumns({"bb_low": c("_m") - k * c("_s"), "bb_high": c("_m") + k * c("_s")})
    d = d.withColumn("percent_b", safe_div(c("close") - c("bb_low"), c("bb_high") - c("bb_low")))
    return d.withColumn("bb_signal", side((c("close") > c("bb_low")) & (w.lag("close") <= w.lag("bb_low")), (c("close") < c("bb_high")) & (w.lag("close") >= w.lag("bb_high")))).drop("_m", "_s")


def keltner(d, w, n=20, atr=14, mult=1.0):
    d = d.withColumn("_tr", true_range(w))
    d = d.withColumns({"_m": w.mean("close", n), "_a": w.mean("_tr", atr)})
    return d.withColumn("keltner_signal", side(c("close") > c("_m") + mult * c("_a"), c("close") < c("_m") - mult * c("_a"))).drop("_tr", "_m", "_a")


def breakout(d, w, n=20):
    d = d.withColumns({"_h": w.max("high", n, 1), "_l": w.min("low", n, 1)})
    return d.withColumn("donchian_signal", side(c("high") > c("_h"), c("low") < c("_l"))).drop("_h", "_l")


def trend_strength(d, w, n=14):
    """Efficiency ratio, vertical-horizontal filter, Aroon and choppiness."""
    d = d.withColumns({"_step": F.abs(c("close") - w.lag("close")), "_tr": true_range(w)})
    hi, lo = w.max("close", n), w.min("close", n)
    win = w.rows(-n, 0)
    full = F.count("high").over(win) == n + 1
    d = d.withColumns({
        "efficiency": safe_div(F.abs(c("close") - w.lag("close", n)), w.sum("_step", n)), "vhf": safe_div(hi - lo, w.sum("_step", n)),
        "aroon_up": F.when(full, (n - (c("bar_idx") - F.max_by("bar_idx", F.struct("high", "bar_idx")).over(win))) * 100.0 / n),
        "aroon_down": F.when(full, (n - (c("bar_idx") - F.max_by("bar_idx", F.struct(-c("low"), c("bar_idx"))).over(win))) * 100.0 / n)})
    return d.withColumn("aroon_signal", side((c("aroon_up") > 70) & (c("aroon_down") < 30), (c("aroon_down") > 70) & (c("aroon_up") < 30))).drop("_step", "_tr")


def window_momentum(d, w, n=20):
    d = d.withColumn("_tp", (c("high") + c("low") + c("close")) / 3.0)
    win = F.collect_list("_tp").over(w.rows(-(n - 1), 0))
    m = F.aggregate(win, F.lit(0.0), lambda a, v: a + v) / n
    d = d.withColumns({"_m": w.mean("_tp", n), "_w": win})
    mad = F.aggregate(F.transform("_w", lambda v: F.abs(v - c("_m"))), F.lit(0.0), lambda a, v: a + v) / n
    d = d.withColumns({"cci": safe_div(c("_tp") - c("_m"), 0.015 * mad), "roc_12": pct(w, "close", 12) * 100, "dpo": w.lag("close", n // 2 + 1) - w.mean("close", n)})
    return d.withColumn("cci_signal", side(c("cci") > 100, c("cci") < -100)).drop("_tp", "_m", "_w")


def volume_flow(d, w, n=14):
    rng = c("high") - c("low")
    d = d.withColumns({"_mfv": safe_div((c("close") - c("low")) - (c("high") - c("close")), rng, 0.0) * c("volume"), "_tp": (c("high") + c("low") + c("close")) / 3.0,
                       "_pv": c("close") * c("volume")})
    chg = c("_tp") - w.lag("_tp")
    d = d.withColumns({"_pos": F.when(chg > 0, c("_tp") * c("volume")).otherwise(0.0), "_neg": F.when(chg < 0, c("_tp") * c("volume")).otherwise(0.0)})
    neg = w.sum("_neg", n)
    d = d.withColumns({"cmf": safe_div(w.sum("_mfv", n), w.sum("volume", n)), "mfi": F.when(neg != 0, 100 - 100 / (1 + w.sum("_pos", n) / neg)),
                       "vwma": safe_div(w.sum("_pv", n), w.sum("volume", n)), "force_index": (c("close") - w.lag("close")) * c("volume")})
    return d.withColumn("cmf_signal", side(c("cmf") > 0.05, c("cmf") < -0.05)).drop("_mfv", "_tp", "_pv", "_pos", "_neg")


def gaps(d, w):
    return d.withColumns({"gap_signal": side(c("open") > w.lag("high"), c("open") < w.lag("low")),
                          "gap_reversal": side((c("open") < w.lag("low")) & (c("close") > w.lag("low")), (c("open") > w.lag("high")) & (c("close") < w.lag("high")))})


def bar_patterns(d, w):
    rng = c("high") - c("low")
    up = flag(c("close") > w.lag("close"))
    d = d.withColumns({"_r": rng, "_u": up, "ibs": safe_div(c("close") - c("low"), rng)})
    body, prev = c("close") - c("open"), w.lag("close") - w.lag("open")
    return d.withColumns({
        "inside_bar": flag((c("high") < w.lag("high")) & (c("low") > w.lag("low"))), "key_reversal": flag((c("low") < w.lag("low")) & (c("close") > w.lag("close"))),
        "nr7": flag(c("_r") == w.min("_r", 7)), "three_up": flag(w.sum("_u", 3) == 3),
        "engulfing": sign3((body > 0) & (prev < 0) & (c("close") >= w.lag("open")) & (c("open") <= w.lag("close")),
                           (body < 0) & (prev > 0) & (c("open") >= w.lag("close")) & (c("close") <= w.lag("open")))}).drop("_r", "_u")


def calendar_rules(d, w=None):
    day = F.to_date("ts")
    return d.withColumns({"monday_long": flag(F.weekday(day) == 0), "turn_of_month": flag((F.dayofmonth(day) <= 3) | (F.datediff(F.last_day(day), day) < 1)),
                          "winter_season": flag((F.month(day) >= 11) | (F.month(day) <= 4)), "expiry_week": flag(F.abs(F.datediff(clock.third_friday(day), day)) <= 4)})


def regressions(d, w, n=14):
    win = w.rows(-(n - 1), 0)
    full = F.count("close").over(win) == n
    kern = [2.718281828459045 ** (-0.5 * (k / 2.0) ** 2) for k in range(n - 1, -1, -1)]
    box = F.collect_list("close").over(win)
    g = F.aggregate(F.zip_with(box, F.array(*[F.lit(x) for x in kern]), lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v) / sum(kern)
    d = d.withColumns({"slope": F.when(full, F.regr_slope(c("close"), c("bar_idx").cast("double")).over(win)), "gaussian": F.when(full, g), "_m": w.mean("close", n), "_s": w.std("close", n)})
    return d.withColumns({"anomaly_z": safe_div(c("close") - c("_m"), "_s"), "regression_signal": side(c("slope") > 0, c("slope") < 0)}).drop("_m", "_s")


def derived_levels(d, w):
    mid = lambda n: (w.max("high", n) + w.min("low", n)) / 2.0
    ph, pl, pc = w.lag("high"), w.lag("low"), w.lag("close")
    d = d.withColumns({"pivot_point": (ph + pl + pc) / 3.0, "camarilla_h3": pc + (ph - pl) * 1.1 / 4.0, "camarilla_l3": pc - (ph - pl) * 1.1 / 4.0, "tenkan": mid(9), "kijun": mid(26),
                       "typical": (c("high") + c("low") + c("close")) / 3.0})
    return d.withColumn("ichimoku_signal", side((c("tenkan") > c("kijun")) & (c("close") > c("kijun")), (c("tenkan") < c("kijun")) & (c("close") < c("kijun"))))


def exits(d, w, n=20, trail=0.5):
    d = d.withColumns({"_hh": w.max("high", n), "_e": w.lag("close", 5)})
    return d.withColumns({"trailing_exit": flag(c("close") < c("_hh") * (1 - trail)), "target_exit": flag(c("close") >= c("_e") * 1.5), "stop_exit": flag(c("close") <= c("_e") * 0.5)}).drop("_hh", "_e")


def allocation(d, w):
    d = d.withColumns({"_fast": pct(w, "close", 10), "_slow": pct(w, "close", 40), "losing": flag(c("close") < w.lag("close"))})
    return d.withColumns({"dual_momentum": side((c("_fast") > 0) & (c("_slow") > 0), (c("_fast") < 0) & (c("_slow") < 0)),
                          "dca_buy": flag(c("bar_idx") % 24 == 0)}).drop("_fast", "_slow")


def one_bar(d, w, size=0.5):
    r = pct(w, "close")
    return d.withColumn("bar_return_signal", side(r > size, r < -size))


@dataclass(frozen=True)
class Rule:
    name: str
    build: Callable
    lookback: int
    outputs: tuple[str, ...]
    aliases: tuple[str, ...] = field(default=())


RULES: dict[str, Rule] = {}


def register(name, build, lookback, outputs, aliases=()):
    """Register a rule by name and aliases; unknown names raise on :func:`resolve`."""
    RULES[name] = Rule(name, build, lookback, tuple(outputs), tuple(aliases))


def resolve(name: str) -> Rule:
    for r in RULES.values():
        if name == r.name or name in r.aliases:
            return r
    raise KeyError(f"unknown strategy {name!r}")


register("ma_cross", ma_cross, 21, ["ma_signal"], ["golden_cross", "mov_avg_two_lines"])
register("envelope", envelope, 20, ["envelope_signal"])
register("rsi", rsi_levels, 17, ["rsi_signal"])
register("stochastic", stochastic, 18, ["stoch_signal"], ["williams"])
register("bollinger", bollinger, 22, ["bb_signal"])
register("keltner", keltner, 21, ["keltner_signal"])
register("donchian", breakout, 21, ["donchian_signal"], ["channel_breakout"])
register("aroon", trend_strength, 16, ["aroon_signal"])
register("cci", window_momentum, 22, ["cci_signal"])
register("cmf", volume_flow, 16, ["cmf_signal"])
register("gap", gaps, 1, ["gap_signal"])
register("regression", regressions, 15, ["regression_signal"])
register("ichimoku", derived_levels, 26, ["ichimoku_signal"])
register("dual_momentum", allocation, 41, ["dual_momentum"])
register("one_bar", one_bar, 1, ["bar_return_signal"])

SIDES = ["long", "short", "neutral"]


def run_rules(bars: DataFrame, names: list[str]) -> DataFrame:
    """Requested rules in one block partitioning, one-hot over the declared vocabulary."""
    chosen = [resolve(n) for n in names]

    def build(d, w):
        for r in chosen:
            d = r.build(d, w)
        return d
    out = blocked(bars, build, before=max(r.lookback for r in chosen))
    for r in chosen:
        for o in r.outputs:
            out = one_hot(out, r.name, o, SIDES)
    return out


def title_case(bars: DataFrame) -> DataFrame:
    """Input adapter: Title-case price aliases and New York date/time columns."""
    t = clock.local("ts")
    return bars.withColumns({**{x.title(): c(x) for x in ("open", "high", "low", "close", "volume")}, "Date": F.date_format(t, "yyyy-MM-dd"), "Time": F.date_format(t, "HH:mm:ss")})
