"""Time series: aggregation, gaps, stationarity, Granger causality, ARIMA and additive forecasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from statloom.functions.ordered import lagged, weighted_quantiles
from statloom.functions.special import f_upper
from statloom.operators.relational import as_timestamp, date_columns
from statloom.roles import number, quoted, roles
from statloom.session import cut_lineage, discard

# Words that mark a column to be summed per date (fixed values).
SUM_WORDS = ["revenue", "sales", "amount", "total", "income", "omzet"]
FUTURE_DAYS = 90
ARIMA_STEPS = 30
#: Order of the long autoregression in the first stage of Hannan–Rissanen.
LONG_AR = 10
ORDERS = tuple((p, d, q) for p in range(3) for d in range(2) for q in range(3))
Z_95 = 1.959963984540054
Z_80 = 1.2815515655446004


def series_columns(df: DataFrame, params: dict) -> tuple[str, str]:
    """Date and target: parameters, else the first date column and the first other number."""
    date = params.get("date_column")
    if not date:
        found = date_columns(df)
        date = found[0] if found else None
    target = params.get("target_column") or next((c for c in roles(df).numeric if c != date), None)
    if not date or not target:
        raise ValueError("time series needs a date column and a numeric target")
    return date, target


def is_summed(target: str) -> bool:
    return any(w in target.lower() for w in SUM_WORDS)


def aggregate_by_date(
    df: DataFrame, date: str, target: str, keys: list[str] | None = None, grain: str | None = None
) -> DataFrame:
    """(keys, ds, y): the sum per date for revenue-like names, else the mean.

    ``grain`` (day, week, month, ...) folds timestamps first; without it equal timestamps are folded.
    """
    ds = as_timestamp(df, date)
    ds = F.date_trunc(grain, ds).cast("timestamp_ntz") if grain else ds
    rows = df.select(
        *[quoted(k) for k in (keys or [])], ds.alias("ds"), number(target).alias("y")
    ).where("ds is not null and y is not null")
    fold = F.sum("y") if is_summed(target) else F.avg("y")
    return rows.groupBy(*(keys or []), "ds").agg(fold.alias("y"))


def month_summary(forecast: DataFrame, value: str = "yhat") -> DataFrame:
    """Mean of the forecast per calendar month."""
    return forecast.groupBy(F.month("ds").alias("month")).agg(F.avg(value).alias("mean_value"))


def peak_and_low(months: DataFrame) -> DataFrame:
    """Month with the highest and lowest mean, the earlier month on ties."""
    return months.agg(
        F.max_by("month", F.struct("mean_value", -F.col("month"))).alias("peak_month"),
        F.min_by("month", F.struct("mean_value", "month")).alias("low_month"),
    )


def _days(ts: Column) -> Column:
    """Days since 1970 as a double, fractions kept."""
    day = F.to_date(ts)
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("double") + clock / 86400.0


def date_gaps(df: DataFrame, date: str) -> DataFrame:
    """(n, median_gap, max_gap) in days between sorted rows; repeated dates give gaps of 0."""
    days = df.select(_days(as_timestamp(df, date)).alias("d")).where("d is not null")
    # both tables are read several times below
    counted = cut_lineage(days.groupBy("d").agg(F.count("*").alias("n")))
    steps = lagged(counted, ["d"], ["d"], 1, ["n"])
    gaps = steps.select((F.col("d_l0") - F.col("d_l1")).alias("gap"), F.lit(1).cast("long").alias("n")).where(
        "gap is not null"
    )
    repeats = counted.where("n > 1").select(F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("n"))
    table = cut_lineage(gaps.unionByName(repeats).groupBy("gap").agg(F.sum("n").alias("n")))
    discard(counted)
    q = weighted_quantiles(table, "gap", {"median_gap": 0.5, "max_gap": 1.0})
    return q.select((F.col("_n") + 1).alias("n"), "median_gap", "max_gap")


def _gram(rows: DataFrame, columns: list[Column]) -> np.ndarray:
    k = len(columns)
    named = rows.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    sums = [F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i in range(k) for j in range(i, k)]
    flat = list(named.agg(F.count("*"), *sums).first())
    out = np.zeros((k + 1, k + 1))
    it = iter(flat[1:])
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = next(it) or 0.0
    out[k, k] = flat[0]
    return out


def _solve(g: np.ndarray, xs: list[int], y: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse from a Gram matrix."""
    a = g[np.ix_(xs, xs)]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    inverse = np.linalg.pinv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ g[xs, y]
    return beta, float(max(g[y, y] - beta @ g[xs, y], 0.0)), inverse


# MacKinnon (1994) response surface, constant only, one series (fixed values).
ADF_MAX, ADF_MIN, ADF_STAR = 2.74, -18.83, -1.61
ADF_SMALL = [2.1659, 1.4412, 0.038269]
ADF_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]


def adf_p_value(tau: float) -> float:
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    poly = ADF_SMALL if tau <= ADF_STAR else ADF_LARGE
    z = sum(c * tau**i for i, c in enumerate(poly))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf(series: DataFrame, lags: int | None = None) -> DataFrame:
    """Augmented Dickey–Fuller with constant; the lag count by AIC unless given.

    Gram matrices over the lagged table come from one aggregation each, and every candidate lag
    count is solved from the same matrix.
    """
    spark = series.sparkSession
    stats = series.agg(F.count("*").alias("n"), F.avg("y").alias("m")).first()
    n, centre = stats["n"], float(stats["m"] or 0.0)
    if n < 5:
        raise ValueError("stationarity needs at least 5 points")
    top = lags if lags is not None else min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 3)
    top = max(0, top)
    table = lagged(series.select("ds", (F.col("y") - centre).alias("y")), ["ds"], ["y"], top + 1)
    if lags is None:
        table = table.persist()
    diff = lambda j: F.col(f"y_l{j}") - F.col(f"y_l{j + 1}")

    def fit(most: int) -> np.ndarray:
        columns = [F.lit(1.0), F.col("y_l1"), *[diff(j) for j in range(1, most + 1)], diff(0)]
        return _gram(table, columns)

    best = top
    if lags is None:
        g = fit(top)
        rows, y = g[-1, -1], top + 2
        scores = []
        for p in range(top + 1):
            _, sse, _ = _solve(g, list(range(2 + p)), y)
            scores.append(rows * math.log(max(sse, 1e-300) / rows) + 2 * (2 + p))
        best = int(np.argmin(scores))
    g = fit(best)
    y, rows = best + 2, g[-1, -1]
    beta, sse, inverse = _solve(g, list(range(2 + best)), y)
    sigma2 = sse / (rows - (2 + best))
    tau = float(beta[1] / math.sqrt(sigma2 * inverse[1, 1]))
    if lags is None:
        table.unpersist()
    return spark.createDataFrame(
        [(tau, adf_p_value(tau), best, int(rows))], "adf_stat double, p_value double, lags int, nobs long"
    )


def granger(df: DataFrame, date: str, effect: str, cause: str, max_lag: int = 5) -> DataFrame:
    """(lag, f_stat, p_value): does ``cause`` help to predict ``effect``? Rows are ordered by date.

    Values of one date are folded first (sum or mean by name), so that the order is unique.
    """
    spark = df.sparkSession
    rows = df.select(as_timestamp(df, date).alias("ds"), number(effect).alias("y"), number(cause).alias("x")).dropna()
    fold = lambda c, name: (F.sum(c) if is_summed(name) else F.avg(c)).alias(c)
    series = rows.groupBy("ds").agg(fold("y", effect), fold("x", cause))
    stats = series.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("x").alias("x")).first()
    n = stats["n"]
    top = max(1, min(max_lag, n // 5))
    centred = series.select("ds", (F.col("y") - float(stats["y"])).alias("y"), (F.col("x") - float(stats["x"])).alias("x"))
    table = lagged(centred, ["ds"], ["y", "x"], top)
    names = [("one", 0), *[("y", j) for j in range(top + 1)], *[("x", j) for j in range(1, top + 1)]]
    value = lambda c: F.lit(1.0) if c[0] == "one" else F.col(f"{c[0]}_l{c[1]}")
    sums, keys = [], []
    for lag in range(1, top + 1):
        used = [c for c in names if c[1] <= lag]
        for i, a in enumerate(used):
            for b in used[i:]:
                keys.append((lag, a, b))
                sums.append(F.sum(F.when(F.col("_pos") > lag, value(a) * value(b))))
    flat = dict(zip(keys, table.agg(*sums).first()))
    out = []
    for lag in range(1, top + 1):
        used = [c for c in names if c[1] <= lag]
        g = np.array([[flat[(lag, *sorted((a, b), key=used.index))] or 0.0 for b in used] for a in used])
        at = {c: i for i, c in enumerate(used)}
        own = [at[("one", 0)], *[at[("y", j)] for j in range(1, lag + 1)]]
        full = own + [at[("x", j)] for j in range(1, lag + 1)]
        _, restricted, _ = _solve(g, own, at[("y", 0)])
        _, unrestricted, _ = _solve(g, full, at[("y", 0)])
        dof = int(n - lag - 2 * lag - 1)
        f = ((restricted - unrestricted) / lag) / (unrestricted / dof) if dof > 0 and unrestricted > 0 else None
        out.append((lag, f, dof))
    table = spark.createDataFrame(out, "lag int, f_stat double, dof int")
    return table.withColumn("p_value", f_upper(F.col("f_stat"), F.col("lag"), F.col("dof")))


def _stable(coefficients: np.ndarray) -> bool:
    """Roots of 1 − c₁z − c₂z² … outside the unit circle."""
    if len(coefficients) == 0:
        return True
    return bool(np.all(np.abs(np.roots(np.r_[1.0, -coefficients])) < 0.999))


def _triangle(columns: list[Column]) -> Column:
    """Sums of all products c_i c_j (i <= j) of the columns, as one array per group."""
    k = len(columns)
    return F.array(*[F.sum(columns[i] * columns[j]) for i in range(k) for j in range(i, k)])


def _square(flat, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    it = iter(flat)
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = next(it)
    return out


def _long_ar(m: int):
    """First stage of Hannan–Rissanen per series: the long autoregression's coefficients from its Gram."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(grams: pd.Series) -> pd.Series:
        out = []
        for flat in grams:
            empty = flat is None or any(v is None or v != v for v in flat)
            g = None if empty else _square(flat, m + 2)
            if g is None or g[0, 0] < m + 1 + 5:
                out.append(None)
                continue
            beta, _, _ = _solve(g, list(range(m + 1)), m + 1)
            out.append(beta.tolist())
        return pd.Series(out)

    return solve


FIT = T.ArrayType(
    T.StructType(
        [
            T.StructField("p", T.IntegerType()),
            T.StructField("q", T.IntegerType()),
            T.StructField("aic", T.DoubleType()),
            T.StructField("rmse", T.DoubleType()),
            T.StructField("mean", T.ArrayType(T.DoubleType())),
            T.StructField("sd", T.ArrayType(T.DoubleType())),
        ]
    )
)


def fit_orders(g: np.ndarray, state: list[float], d: int, pq: list[tuple[int, int]], pmax: int, qmax: int, steps: int) -> list[dict]:
    """Second stage for every order from one Gram of [1, w₋₁..w₋pmax, ê₋₁..ê₋qmax, w]: each order is
    the regression on its sub-matrix. ``state`` is (w_T, w_T−1, ê_T, ê_T−1, y_T)."""
    y, n = pmax + qmax + 1, g[0, 0]
    w_last, w_before, e_last, e_before, y_last = state
    out = []
    for p, q in pq:
        xs = ([0] if d == 0 else []) + list(range(1, p + 1)) + list(range(pmax + 1, pmax + 1 + q))
        k = len(xs)
        if n < k + 5:
            continue
        beta, rss, _ = _solve(g, xs, y) if k else (np.zeros(0), float(g[y, y]), None)
        const = float(beta[0]) if d == 0 else 0.0
        ar, ma = beta[int(d == 0) : int(d == 0) + p], beta[int(d == 0) + p :]
        if not _stable(ar) or not _stable(-ma):
            continue
        sigma2 = rss / n
        aic = n * (math.log(2 * math.pi * max(sigma2, 1e-300)) + 1) + 2 * (k + 1)
        past, shocks = [w_before, w_last], [e_before, e_last]
        for _ in range(steps):
            value = const + sum(ar[i] * past[-1 - i] for i in range(p))
            value += sum(ma[j] * shocks[-1 - j] for j in range(q))
            past.append(value)
            shocks.append(0.0)
        mean = np.array(past[2:])
        psi = np.zeros(steps)
        psi[0] = 1.0
        for j in range(1, steps):
            psi[j] = (ma[j - 1] if j <= q else 0.0) + sum(ar[i] * psi[j - 1 - i] for i in range(min(p, j)))
        if d:
            mean = y_last + np.cumsum(mean)
            psi = np.cumsum(psi)
        sd = np.sqrt(sigma2 * np.cumsum(psi**2))
        out.append({"p": p, "q": q, "aic": aic, "rmse": math.sqrt(sigma2), "mean": mean.tolist(), "sd": sd.tolist()})
    return out


def _second_stage(d: int, pq: list[tuple[int, int]], pmax: int, qmax: int, steps: int):
    k = pmax + qmax + 2

    @F.pandas_udf(FIT)
    def fit(grams: pd.Series, states: pd.Series) -> pd.Series:
        out = []
        for flat, state in zip(grams, states):
            if flat is None or state is None or any(v is None or v != v for v in flat):
                out.append([])
                continue
            values = [0.0 if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) for v in state]
            out.append(fit_orders(_square(flat, k), values, d, pq, pmax, qmax, steps))
        return pd.Series(out)

    return fit


def _join_series(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    cond = [left[k].eqNullSafe(right[k]) for k in keys]
    joined = left.join(right, cond, "left")
    for k in keys:
        joined = joined.drop(right[k])
    return joined


def _triangle_if(columns: list[Column], keep: Column) -> Column:
    """``_triangle`` over the rows where ``keep`` holds."""
    k = len(columns)
    return F.array(*[F.sum(F.when(keep, columns[i] * columns[j])) for i in range(k) for j in range(i, k)])


def _with_order(d: int):
    """The fit struct with its difference order (a one-argument function, as ``transform`` wants)."""

    def add(f: Column) -> Column:
        names = ("p", "q", "aic", "rmse", "mean", "sd")
        return F.struct(f["p"].alias("p"), F.lit(d).alias("d"), *[f[n].alias(n) for n in names[1:]])

    return add


def _fits_all(series: DataFrame, keys: list[str], orders: tuple, steps: int, m: int) -> DataFrame:
    """Every order of every series from two windows and two grouped sums shared by all difference orders."""
    plan = {d: [(p, q) for p, dd, q in orders if dd == d] for d in sorted({o[1] for o in orders})}
    most = {d: (max(p for p, _ in pq), max(q for _, q in pq)) for d, pq in plan.items()}
    win = Window.partitionBy(*keys).orderBy("ds")
    micros = F.unix_micros(F.col("ds").cast("timestamp"))
    need = max(max(pm, 1, m if qm else 0) + d for d, (pm, qm) in most.items())
    rows = series.select(*keys, "ds", F.col("y").cast("double").alias("y")).select(
        "*", *[F.lag("y", i).over(win).alias(f"y{i}") for i in range(1, need + 1)], (micros - F.lag(micros).over(win)).alias("_gap")
    )

    def level(i: int) -> Column:
        return F.col("y") if i == 0 else F.col(f"y{i}")

    def w(d: int, i: int) -> Column:
        return level(i) if d == 0 else level(i) - level(i + 1)

    moving = [d for d, (_, qm) in most.items() if qm]
    if moving:
        grams = rows.groupBy(*keys).agg(
            *[_triangle_if([F.lit(1.0), *[w(d, i) for i in range(1, m + 1)], w(d, 0)], w(d, m).isNotNull()).alias(f"_g1_{d}") for d in moving]
        )
        coef = grams.select(*keys, *[_long_ar(m)(f"_g1_{d}").alias(f"_a{d}") for d in moving])
        rows = _join_series(rows, coef, keys)
        for d in moving:
            a = F.col(f"_a{d}")
            rows = rows.withColumn(f"_e{d}", w(d, 0) - (a[0] + sum((a[i] * w(d, i) for i in range(1, m + 1)), F.lit(0.0))))
        rows = rows.select("*", *[F.lag(f"_e{d}", j).over(win).alias(f"_e{d}_{j}") for d in moving for j in range(1, most[d][1] + 1)])

    def e(d: int, j: int) -> Column:
        if not most[d][1]:
            return F.lit(0.0)
        return F.col(f"_e{d}") if j == 0 else F.col(f"_e{d}_{j}")

    sums, states = [], []
    for d, (pm, qm) in most.items():
        keep = w(d, 0).isNotNull() & w(d, max(pm, 1)).isNotNull()
        if qm:
            keep = keep & e(d, qm).isNotNull()
        v2 = [F.lit(1.0), *[w(d, i) for i in range(1, pm + 1)], *[e(d, j) for j in range(1, qm + 1)], w(d, 0)]
        sums.append(_triangle_if(v2, keep).alias(f"_g2_{d}"))
        states.append(F.max_by(F.array(w(d, 0), w(d, 1), e(d, 0), e(d, 1), F.col("y")), F.col("ds")).alias(f"_st{d}"))
    ends = rows.groupBy(*keys).agg(
        *sums, *states, F.max(micros).alias("last_us"), F.coalesce(F.median("_gap"), F.lit(86_400_000_000.0)).alias("gap_us")
    )
    found = []
    for d, pq in plan.items():
        pm, qm = most[d]
        fitted = _second_stage(d, pq, pm, qm, steps)(f"_g2_{d}", f"_st{d}")
        found.append(F.transform(fitted, _with_order(d)))
    fits = ends.select(*keys, "last_us", "gap_us", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("f"))
    return fits.select(*keys, "last_us", "gap_us", "f.p", "f.d", "f.q", "f.aic", "f.rmse", "f.mean", "f.sd")


def arima_fits(
    series: DataFrame, keys: list[str], steps: int = ARIMA_STEPS, orders: tuple = ORDERS, long_ar: int = LONG_AR
) -> DataFrame:
    """A row per series and order (default p 0..2, d 0..1, q 0..2): aic, rmse and the forecast.

    Hannan–Rissanen by Gram sums, all in Spark: per series and difference order, a long
    autoregression of order ``long_ar`` is fitted from one aggregation of lag products; its
    residuals stand in for the shocks, and one more aggregation of products of the lags of the
    series and of those residuals gives every (p, q) as a regression on a sub-matrix. Orders
    share the sample of the largest lags, so their AIC values compare. The work per series is two
    windows over its dates (one row per date, bounded by the calendar) and two grouped sums, shared
    by both difference orders; only
    Gram matrices of a few dozen numbers reach Python. AR orders without MA terms skip the first
    stage and are ordinary least squares. A non-stationary AR or non-invertible MA part drops the
    order; a series with fewer than about ``long_ar`` + 2 + 5 points has no MA fits.
    """
    keys = list(keys)
    work = series if keys else series.withColumn("_series", F.lit(0))
    ks = keys or ["_series"]
    fits = _fits_all(work, ks, orders, steps, long_ar)
    ds_type = series.schema["ds"].dataType.simpleString()
    at = lambda i: F.timestamp_micros(F.col("last_us") + (F.col("gap_us") * i).cast("long")).cast(ds_type)
    forecast = F.transform(
        F.sequence(F.lit(1), F.lit(steps)),
        lambda i: F.struct(
            i.alias("step"),
            at(i).alias("ds"),
            F.col("mean")[i - 1].alias("yhat"),
            (F.col("mean")[i - 1] - Z_95 * F.col("sd")[i - 1]).alias("yhat_lower"),
            (F.col("mean")[i - 1] + Z_95 * F.col("sd")[i - 1]).alias("yhat_upper"),
        ),
    )
    return fits.select(*keys, "p", "d", "q", "aic", "rmse", forecast.alias("forecast"))


def arima(series: DataFrame, keys: list[str] | None = None, steps: int = ARIMA_STEPS, orders: tuple = ORDERS) -> DataFrame:
    """Best order per series by AIC with its forecast array."""
    keys = keys or []
    fits = arima_fits(series, keys, steps, orders)
    best = fits.groupBy(*keys).agg(
        F.min_by(F.struct("p", "d", "q", "aic", "rmse", "forecast"), F.struct("aic", "p", "d", "q")).alias("b")
    )
    return best.select(*keys, "b.*")


def arima_forecast(best: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return best.select(*(keys or []), F.inline("forecast"))


def _fourier(day: Column, period: float, order: int) -> list[Column]:
    out = []
    for k in range(1, order + 1):
        angle = day * (2 * math.pi * k / period)
        out += [F.sin(angle), F.cos(angle)]
    return out


def laplace_bends(gram: np.ndarray, bends: list[int], rounds: int = 20000) -> tuple[np.ndarray, float]:
    """Posterior mode of y on [1, features] from their Gram matrix (last row and column: y, then the
    count): ½|y − Xβ|²/σ² + Σ|β_bend| + ½Σβ_other², intercept free, σ² the least-squares residual
    variance. Proximal gradient steps (FISTA) with soft thresholding of the bends; (β, rmse)."""
    p = gram.shape[0] - 2
    a, b, n = gram[:p, :p], gram[:p, p], max(gram[p + 1, p + 1], 1.0)
    free, _, _ = _solve(gram, list(range(p)), p)
    sigma2 = max(float(gram[p, p] - free @ b) / n, 1e-6 * float(gram[p, p]) / n, 1e-300)
    ridge = np.ones(p)
    ridge[0] = 0.0
    ridge[bends] = 0.0
    lipschitz = float(np.linalg.eigvalsh(a).max()) / sigma2 + 1.0
    step = 1.0 / lipschitz
    beta = np.zeros(p)
    beta[0] = b[0] / max(a[0, 0], 1e-300)
    ahead, t = beta.copy(), 1.0
    for _ in range(rounds):
        grad = (a @ ahead - b) / sigma2 + ridge * ahead
        moved = ahead - step * grad
        moved[bends] = np.sign(moved[bends]) * np.maximum(np.abs(moved[bends]) - step, 0.0)
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = moved + (t - 1) / t_next * (moved - beta)
        if np.max(np.abs(moved - beta)) < 1e-12 * max(1.0, np.max(np.abs(moved))):
            beta = moved
            break
        beta, t = moved, t_next
    rss = float(gram[p, p] - 2 * beta @ b + beta @ a @ beta)
    return beta, math.sqrt(max(rss, 0.0) / n)


def additive_forecast(series: DataFrame, future_days: int = FUTURE_DAYS) -> DataFrame:
    """(ds, y, yhat, yhat_lower, yhat_upper, trend, weekly, yearly, is_future).

    y is explained by a piecewise linear trend with 25 possible bends on the first 80 % of the
    range, weekly (order 3) and yearly (order 10) waves where the span allows. One Spark
    aggregation gives the Gram matrix; the fit is the posterior mode with a Laplace prior on the
    bends and normal priors on slope and waves (``laplace_bends``), so unused bends are exactly 0.
    The 80 % band widens with the trend's past bends.
    """
    day = _days(F.col("ds"))
    s = series.agg(
        F.count("*").alias("n"),
        F.min(day).alias("lo"),
        F.max(day).alias("hi"),
        F.max(F.abs("y")).alias("top"),
    ).first()
    if not s["n"] or s["n"] < 2:
        raise ValueError("forecast needs at least two dates")
    span = float(s["hi"] - s["lo"]) or 1.0
    scale = float(s["top"]) or 1.0
    spacing = span / max(1, s["n"] - 1)
    future = (
        series.agg(F.max("ds").alias("last"))
        .select(F.explode(F.sequence(F.lit(1), F.lit(future_days))).alias("k"), "last")
        .selectExpr("last + make_dt_interval(k) as ds", "cast(null as double) as y", "true as is_future")
    )
    rows = series.select("ds", "y", F.lit(False).alias("is_future")).unionByName(future)
    t = (F.col("day") - float(s["lo"])) / span
    bends = [0.8 * j / 26 for j in range(1, 26)]
    # Prior widths: bends 0.05, slope 5, waves 10; a wider prior is a larger feature.
    blocks: dict[str, list[Column]] = {
        "trend": [t * 5.0, *[F.greatest(t - b, F.lit(0.0)) * 0.05 for b in bends]],
        "weekly": [c * 10.0 for c in _fourier(F.col("day"), 7.0, 3)] if span >= 14 and spacing < 7 else [],
        "yearly": [c * 10.0 for c in _fourier(F.col("day"), 365.25, 10)] if span >= 730 else [],
    }
    names: dict[str, list[str]] = {}
    design = rows.withColumn("day", _days(F.col("ds")))
    chosen: list[Column] = []
    for block, columns in blocks.items():
        names[block] = [f"{block}{i}" for i in range(len(columns))]
        chosen += [c.alias(n) for c, n in zip(columns, names[block])]
    design = design.select("ds", "y", "is_future", "day", *chosen)
    flat = [n for block in names.values() for n in block]
    fit_rows = design.where("not is_future").withColumn("label", F.col("y") / scale)
    gram = _gram(fit_rows, [F.lit(1.0), *[F.col(n) for n in flat], F.col("label")])
    beta, rmse = laplace_bends(gram, [i + 1 for i, n in enumerate(flat) if n in names["trend"][1:]])
    weight = dict(zip(flat, map(float, beta[1:])))
    intercept = float(beta[0])
    part = {
        block: sum((F.col(n) * weight[n] for n in cols), F.lit(0.0)) * scale for block, cols in names.items()
    }
    part["trend"] = part["trend"] + intercept * scale
    sigma = rmse * scale
    deltas = [abs(weight[n]) * 0.05 * scale for n in names["trend"][1:]]
    bend = float(np.mean(deltas))
    ahead = F.greatest(F.lit(0.0), (F.col("day") - float(s["hi"])) / span)
    drift = (25 / 0.8) * 2 * bend**2 * ahead**3 / 3
    reach = Z_80 * F.sqrt(F.lit(sigma**2) + drift)
    out = design.select(
        "ds", "y", "is_future", "day", *[part[b].alias(b) for b in ("trend", "weekly", "yearly")]
    ).withColumn("yhat", F.col("trend") + F.col("weekly") + F.col("yearly"))
    return out.select(
        "ds",
        "y",
        "yhat",
        (F.col("yhat") - reach).alias("yhat_lower"),
        (F.col("yhat") + reach).alias("yhat_upper"),
        "trend",
        "weekly",
        "yearly",
        "is_future",
    )


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Training points, future days, trend direction, peak and low month, 30-day mean."""
    months = peak_and_low(month_summary(forecast))
    return (
        forecast.agg(
            F.count_if(~F.col("is_future")).alias("training_points"),
            F.count_if("is_future").alias("forecast_days"),
            F.when(F.max_by("trend", "ds") > F.min_by("trend", "ds"), "up").otherwise("down").alias("trend_direction"),
        )
        .withColumn("_m", months.select(F.struct("peak_month", "low_month")).scalar())
        .withColumn("mean_30_days", forecast_mean(forecast).scalar())
        .select("training_points", "forecast_days", "trend_direction", "_m.peak_month", "_m.low_month", "mean_30_days")
    )


def forecast_mean(forecast: DataFrame, rows: int = 30) -> DataFrame:
    """Mean of the first ``rows`` future values."""
    ahead = forecast.where("is_future") if "is_future" in forecast.columns else forecast
    return ahead.orderBy("ds").limit(rows).agg(F.avg("yhat").alias("mean_30_days"))
