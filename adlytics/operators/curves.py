"""Curve fitting per group (M-5 .. M-17).

Closed forms where the model is linear in its parameters (line, quadratic,
A + B ln x): sums per group in one aggregate, the k x k solve in columns.

Nonlinear curves (power, diminishing, Gaussian bump, sigmoid) use
Levenberg-Marquardt where every iteration is ONE grouped aggregate over the
data (J'J, J'r and the residual sum of squares as ``sum`` columns); the
driver solves the k x k systems of all groups with numpy and sends the new
parameters back as a broadcast table keyed by group, joined null-safely.  All groups
advance together.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

E = F.col


@dataclass
class Curve:
    name: str
    params: list[str]
    f: Callable[[Column, list[Column]], Column]
    grads: Callable[[Column, list[Column]], list[Column]]


def _pow(x, b):
    return F.pow(x, b)


CURVES: dict[str, Curve] = {
    "power": Curve(
        "power", ["a", "b"],
        lambda x, p: F.exp(p[0]) * _pow(x, p[1]),
        lambda x, p: [F.exp(p[0]) * _pow(x, p[1]), F.when(x > 0, F.exp(p[0]) * _pow(x, p[1]) * F.ln(x)).otherwise(0.0)]),
    "diminishing": Curve(
        "diminishing", ["a", "b", "c"],
        lambda x, p: p[0] + _pow(x, p[1]) / p[2],
        lambda x, p: [F.lit(1.0), F.when(x > 0, _pow(x, p[1]) * F.ln(x) / p[2]).otherwise(0.0),
                      -_pow(x, p[1]) / (p[2] * p[2])]),
    "gauss": Curve(
        "gauss", ["a", "x0", "sigma"],
        lambda x, p: p[0] * F.exp(-(x - p[1]) * (x - p[1]) / (2 * p[2] * p[2])),
        lambda x, p: [F.exp(-(x - p[1]) * (x - p[1]) / (2 * p[2] * p[2])),
                      p[0] * F.exp(-(x - p[1]) * (x - p[1]) / (2 * p[2] * p[2])) * (x - p[1]) / (p[2] * p[2]),
                      p[0] * F.exp(-(x - p[1]) * (x - p[1]) / (2 * p[2] * p[2])) * (x - p[1]) * (x - p[1])
                      / (p[2] * p[2] * p[2])]),
    "sigmoid": Curve(
        "sigmoid", ["A", "k", "x0", "offset"],
        lambda x, p: p[0] / (1 + F.exp(-p[1] * (x - p[2]))) + p[3],
        lambda x, p: [1 / (1 + F.exp(-p[1] * (x - p[2]))),
                      p[0] * (x - p[2]) * F.exp(-p[1] * (x - p[2])) / ((1 + F.exp(-p[1] * (x - p[2]))) ** 2),
                      -p[0] * p[1] * F.exp(-p[1] * (x - p[2])) / ((1 + F.exp(-p[1] * (x - p[2]))) ** 2),
                      F.lit(1.0)]),
}


# ------------------------------------------------------------ closed forms
def linear_fit(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """M-5 + M-13: y = a + b x per group, with parameter standard errors
    s^2 (X'X)^-1 (s^2 = SSR / (n - 2)) and 95 % bounds."""
    s = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.regr_sxx(E(y), E(x)).alias("sxx"), F.regr_sxy(E(y), E(x)).alias("sxy"),
        F.regr_syy(E(y), E(x)).alias("syy"))
    s = s.withColumn("b", E("sxy") / E("sxx")).withColumn("a", E("my") - E("b") * E("mx"))
    s = s.withColumn("s2", (E("syy") - E("sxy") * E("sxy") / E("sxx")) / (E("n") - 2))
    s = s.withColumns({"se_b": F.sqrt(E("s2") / E("sxx")),
                       "se_a": F.sqrt(E("s2") * (1 / E("n") + E("mx") * E("mx") / E("sxx")))})
    return s.select(*group, "n", "a", "b", "se_a", "se_b",
                    (E("a") - 1.96 * E("se_a")).alias("a_lower"), (E("a") + 1.96 * E("se_a")).alias("a_upper"),
                    (E("b") - 1.96 * E("se_b")).alias("b_lower"), (E("b") + 1.96 * E("se_b")).alias("b_upper"))


def quadratic_fit(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """M-11: y = a x^2 + b x + c from the 3 x 3 normal equations (Cramer),
    on x centred by its group mean for conditioning, then shifted back."""
    m = df.groupBy(*group).agg(F.avg(x).alias("_m"))
    d = df.join(m, group).withColumn("_u", E(x) - E("_m"))
    u, yy = E("_u"), E(y)
    s = d.groupBy(*group, "_m").agg(
        F.count(F.lit(1)).cast("double").alias("s0"), F.sum(u).alias("s1"), F.sum(u * u).alias("s2"),
        F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"),
        F.sum(yy).alias("t0"), F.sum(u * yy).alias("t1"), F.sum(u * u * yy).alias("t2"))
    # system [[s4 s3 s2] [s3 s2 s1] [s2 s1 s0]] (A B C)' = (t2 t1 t0)'
    def det(a11, a12, a13, a21, a22, a23, a31, a32, a33):
        return a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31) + a13 * (a21 * a32 - a22 * a31)
    S = {k: E(k) for k in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}
    D = det(S["s4"], S["s3"], S["s2"], S["s3"], S["s2"], S["s1"], S["s2"], S["s1"], S["s0"])
    A = det(S["t2"], S["s3"], S["s2"], S["t1"], S["s2"], S["s1"], S["t0"], S["s1"], S["s0"]) / D
    Bc = det(S["s4"], S["t2"], S["s2"], S["s3"], S["t1"], S["s1"], S["s2"], S["t0"], S["s0"]) / D
    C = det(S["s4"], S["s3"], S["t2"], S["s3"], S["s2"], S["t1"], S["s2"], S["s1"], S["t0"]) / D
    s = s.withColumns({"A": A, "B": Bc, "C": C})
    # a(x-m)^2 + b(x-m) + c  ->  a x^2 + (b - 2am) x + (a m^2 - b m + c)
    return s.select(*group, E("A").alias("a"), (E("B") - 2 * E("A") * E("_m")).alias("b"),
                    (E("A") * E("_m") * E("_m") - E("B") * E("_m") + E("C")).alias("c"))


def log_fit(df: DataFrame, group: list[str], x: str, y: str, c: float = 1.0, d: float = 5.0) -> DataFrame:
    """M-8: a + b ln(x c) / ln(d) has two free parameters: fit A + B ln x in
    closed form (x > 0) and express it with c, d fixed at the start values:
    b = B ln d, a = A - b ln(c) / ln(d)."""
    l = linear_fit(df.filter(E(x) > 0).withColumn("_lx", F.ln(E(x))), group, "_lx", y)
    import math
    return l.select(*group, (E("a") - E("b") * math.log(c)).alias("a"), (E("b") * math.log(d)).alias("b"),
                    F.lit(c).alias("c"), F.lit(d).alias("d"))


# ---------------------------------------------------------- Levenberg-Marquardt
def bounded_step(jtj: np.ndarray, jtr: np.ndarray, lam: float, p: np.ndarray, bounds) -> np.ndarray:
    """Damped Gauss-Newton step; with bounds, parameters sitting on a bound
    whose step points outward are held fixed and the reduced system is
    solved again (active set), then the result is clipped into the box."""
    k = len(p)
    A = jtj + lam * np.diag(np.maximum(np.diag(jtj), 1e-12))
    free = np.ones(k, dtype=bool)
    step = np.zeros(k)
    for _ in range(k + 1):
        step = np.zeros(k)
        if free.any():
            step[free] = np.linalg.solve(A[np.ix_(free, free)], jtr[free])
        if bounds is None:
            return p + step
        lo, hi = bounds
        out = free & (((p <= lo) & (step < 0)) | ((p >= hi) & (step > 0)))
        if not out.any():
            break
        free &= ~out
    return np.clip(p + step, bounds[0], bounds[1])


def lm_fit(df: DataFrame, group: list[str], x: str, y: str, curve: str, p0: DataFrame,
           bounds: tuple[float, float] | None = None, max_iter: int = 200, tol: float = 1.49012e-8,
           xtol: float = 1.49012e-8) -> DataFrame:
    """Least squares of ``curve`` per group.  ``p0``: one row per group with
    the start values (columns named as the curve's parameters).  Returns
    params, SSR, n, parameter sd (sqrt diag of s^2 (J'J)^-1), whether a
    parameter lies on a bound (its sd means nothing then), the iterations and
    a status per group:

    ``converged``; ``max_iter`` (the best point so far is returned);
    ``no_start`` (start value missing or the curve undefined there);
    ``no_step`` (no damping gives a better point, or a singular system).

    The data are met only by grouped aggregates.  The driver holds a few
    numbers per group (k parameters, k x k sums), so groups are to be keys of
    an analysis, not of rows."""
    cv = CURVES[curve]
    k = len(cv.params)
    spark = df.sparkSession
    data = df.select(*group, E(x).cast("double").alias("_x"), E(y).cast("double").alias("_y")).persist()
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*group).schema.fields}
    ptab_schema = ", ".join([f"`_g_{g}` {kinds[g]}" for g in group] + [f"_p{i} double" for i in range(k)])
    start = {tuple(r[g] for g in group): [r[p] for p in cv.params] for r in p0.collect()}
    best = {g: np.array([np.nan if v is None else float(v) for v in p]) for g, p in start.items()}
    trial = {g: p.copy() for g, p in best.items()}
    lam = {g: 1e-3 for g in start}
    best_ssr = {g: np.inf for g in start}
    best_jtj: dict = {}
    best_jtr: dict = {}
    status = {g: "no_start" if np.isnan(best[g]).any() else None for g in start}
    n_obs: dict = {}
    taken = {g: 0 for g in start}

    def stats_at(params: dict) -> dict:
        # one way for any number of groups: a parameter frame joined null-safely; broadcast, as the
        # driver holds it anyway and a join by shuffle would sort a whole group in one task
        ptab = F.broadcast(spark.createDataFrame([(*g, *map(float, pv)) for g, pv in params.items()], ptab_schema))
        on = None
        for g in group:
            same = data[g].eqNullSafe(ptab[f"_g_{g}"])
            on = same if on is None else on & same
        j = data.join(ptab, on)
        p = [E(f"_p{i}") for i in range(k)]
        r = E("_y") - cv.f(E("_x"), p)
        g = cv.grads(E("_x"), p)
        aggs = [F.sum(r * r).alias("ssr"), F.count(F.lit(1)).alias("n")]
        aggs += [F.sum(g[a] * r).alias(f"jr{a}") for a in range(k)]
        aggs += [F.sum(g[a] * g[b]).alias(f"jj{a}_{b}") for a in range(k) for b in range(a, k)]
        out = {}
        for row in j.groupBy(*group).agg(*aggs).collect():
            key = tuple(row[gg] for gg in group)
            jtj = np.zeros((k, k))
            for a in range(k):
                for b in range(a, k):
                    jtj[a, b] = jtj[b, a] = row[f"jj{a}_{b}"] or 0.0
            jtr = np.array([row[f"jr{a}"] or 0.0 for a in range(k)])
            out[key] = (row["ssr"], jtj, jtr, row["n"])
        return out

    for _ in range(max_iter):
        live = {g: p for g, p in trial.items() if status[g] is None}
        if not live:
            break
        st = stats_at(live)
        for g in live:
            ssr, jtj, jtr, n = st.get(g, (None, None, None, 0))
            n_obs[g] = n
            taken[g] += 1
            ok = ssr is not None and np.isfinite(ssr) and np.all(np.isfinite(jtj))
            if not ok and g not in best_jtj:
                status[g] = "no_start"
                continue
            if ok and ssr <= best_ssr[g]:
                improvement = (best_ssr[g] - ssr) / max(ssr, 1e-300) if np.isfinite(best_ssr[g]) else np.inf
                best[g], best_ssr[g], best_jtj[g], best_jtr[g] = trial[g].copy(), ssr, jtj, jtr
                lam[g] = max(lam[g] / 10, 1e-12)
                if improvement < tol:
                    status[g] = "converged"
                    continue
            else:
                lam[g] *= 10
                if lam[g] > 1e12:
                    status[g] = "no_step"
                    continue
            try:
                nxt = bounded_step(best_jtj[g], best_jtr[g], lam[g], best[g], bounds)
            except np.linalg.LinAlgError:
                status[g] = "no_step"
                continue
            # relative parameter change below xtol: converged
            if np.linalg.norm(nxt - best[g]) <= xtol * (np.linalg.norm(best[g]) + xtol):
                status[g] = "converged"
            trial[g] = nxt
    data.unpersist()
    rows = []
    for g, p in best.items():
        n = n_obs.get(g, 0)
        sd = [None] * k
        if g in best_jtj and n > k:
            s2 = best_ssr[g] / (n - k)
            try:
                cov = s2 * np.linalg.inv(best_jtj[g])
                sd = [float(np.sqrt(v)) if v >= 0 else None for v in np.diag(cov)]
            except np.linalg.LinAlgError:
                pass
        on_bound = bounds is not None and bool(((p <= bounds[0]) | (p >= bounds[1])).any())
        values = [None if np.isnan(v) else float(v) for v in p]
        rows.append((*g, *values, *sd, float(best_ssr[g]) if np.isfinite(best_ssr[g]) else None, int(n), taken[g],
                     on_bound, status[g] or "max_iter"))
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in group] + [f"`{c}` double" for c in cv.params]
                       + [f"`sd_{c}` double" for c in cv.params]
                       + ["ssr double", "n bigint", "iterations int", "on_bound boolean", "status string"])
    return spark.createDataFrame(rows, schema)


def predict(df: DataFrame, params: DataFrame, group: list[str], x: str, curve: str, out: str = "pred") -> DataFrame:
    """Curve value per row with the group's parameters (one row per group;
    Spark broadcasts them when they are measured small)."""
    if curve in CURVES:
        cv = CURVES[curve]
        names = cv.params
        fn = lambda xx, p: cv.f(xx, p)
    elif curve == "linear":
        names, fn = ["a", "b"], (lambda xx, p: p[0] + p[1] * xx)
    elif curve == "polynomial":
        names, fn = ["a", "b", "c"], (lambda xx, p: p[0] * xx * xx + p[1] * xx + p[2])
    elif curve == "logarithm":
        names, fn = ["a", "b", "c", "d"], (lambda xx, p: p[0] + p[1] * F.ln(xx * p[2]) / F.ln(p[3]))
    else:
        raise ValueError(curve)
    ptab = params.select(*group, *[E(n).alias(f"_q_{n}") for n in names])
    j = df.join(ptab, group)
    return j.withColumn(out, fn(E(x), [E(f"_q_{n}") for n in names])).drop(*[f"_q_{n}" for n in names])


def score(df: DataFrame, group: list[str], y: str, pred: str) -> DataFrame:
    """M-15: R^2 = 1 - SSres / SStot and RMSE per group."""
    return df.groupBy(*group).agg(
        (1 - F.sum((E(y) - E(pred)) ** 2) / (F.sum(E(y) * E(y)) - F.sum(E(y)) ** 2 / F.count(F.lit(1)))).alias("r2"),
        F.sqrt(F.avg((E(y) - E(pred)) ** 2)).alias("rmse"))


def curve_grid(bounds: DataFrame, params: DataFrame, group: list[str], curve: str, points: int = 50) -> DataFrame:
    """M-14: the curve on ``points`` equally spaced x from the group's min
    to max (``bounds`` has columns lo, hi per group)."""
    g = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    g = g.withColumn("x", E("lo") + (E("hi") - E("lo")) * E("i") / (points - 1))
    return predict(g, params, group, "x", curve, "y")
