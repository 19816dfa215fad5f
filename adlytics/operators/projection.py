"""Variable projection for curves with two nonlinear parameters (M-9, M-10, M-12).

The parameters that enter linearly (height, offset) have a closed form for each trial of the
other two, so only a plane is searched: every group tries a grid over its box, then
``rounds`` finer grids round its best point.  The first grid has a start in every part of the
box, so a poor start value cannot lead the search away.

Rows are brought together by x once.  A round is a grouped aggregate over (group, trial)
and one over the group; the state (the box of each group) is a DataFrame, all
groups advance together and all rounds are one plan: the driver holds nothing.  The work is the
distinct x of a group times the trials, so it suits day-level series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.session import ensure_checkpoint_dir

E = F.col


@dataclass(frozen=True)
class Shape:
    """y = height * of(x, u, v) [+ offset].  ``box``: from the least and greatest x
    the bounds of u and v.  ``names``: parameter -> its value from u, v, height, offset."""
    of: Callable[[Column, Column, Column], Column]
    offset: bool
    box: Callable[[Column, Column], list[Column]]
    names: dict[str, Callable[[], Column]]


SHAPES = {
    # v is ln sigma; a bump wider than ten ranges is a constant to the data
    "gauss": Shape(
        lambda x, u, v: F.exp(-(x - u) * (x - u) / (2 * F.exp(2 * v))), False,
        lambda lo, hi: [lo - 2 * (hi - lo), hi + 2 * (hi - lo), F.ln((hi - lo) / 50), F.ln((hi - lo) * 10)],
        {"a": lambda: E("height"), "x0": lambda: E("u"), "sigma": lambda: F.exp("v")}),
    # v is ln k; a falling curve has a negative height
    "sigmoid": Shape(
        lambda x, u, v: 1 / (1 + F.exp(-F.exp(v) * (x - u))), True,
        lambda lo, hi: [lo - (hi - lo) / 2, hi + (hi - lo) / 2, F.ln(1 / (hi - lo)), F.ln(200 / (hi - lo))],
        {"A": lambda: E("height"), "k": lambda: F.exp("v"), "x0": lambda: E("u"), "offset": lambda: E("offset")}),
}


EDGES = ("u_min", "u_max", "v_min", "v_max")
BOX = ("u_lo", "u_hi", "v_lo", "v_hi")


def _grid(state: DataFrame, points: int) -> DataFrame:
    """The state with ``points`` x ``points`` trials u, v over each group's present box."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    g = state.withColumn("i", steps).withColumn("j", steps)
    return g.withColumns({"u": E("u_lo") + (E("u_hi") - E("u_lo")) * E("i") / (points - 1),
                          "v": E("v_lo") + (E("v_hi") - E("v_lo")) * E("j") / (points - 1)}).drop("i", "j")


def _same(a: DataFrame, b: DataFrame, group: list[str], how: str) -> DataFrame:
    """Null-safe join on the group; the columns of b's group go."""
    named = b.select(*[E(g).alias(f"_g_{g}") for g in group], *[c for c in b.columns if c not in group])
    on = F.lit(True)
    for g in group:
        on = on & a[g].eqNullSafe(named[f"_g_{g}"])
    return a.join(named, on, how).drop(*[f"_g_{g}" for g in group])


def projected_fit(df: DataFrame, group: list[str], x: str, y: str, curve: str,
                  rounds: int = 8, first: int = 33, points: int = 13) -> DataFrame:
    """Least squares of ``curve`` per group: group, the curve's parameters, ssr, n, status:
    ``converged``; ``on_edge`` (the best point lies on the box: the sum of squares still
    falls beyond it, and the data do not determine the curve); ``no_start`` (no rows with x and y,
    fewer of them than parameters or one x only; the parameters are null)."""
    sh = SHAPES[curve]
    ensure_checkpoint_dir(df.sparkSession)
    d = (df.select(*group, E(x).cast("double").alias("_x"), E(y).cast("double").alias("_y"))
         .groupBy(*group, "_x").agg(F.count("_y").alias("_n"), F.sum("_y").alias("_sy"), F.sum(E("_y") * E("_y")).alias("_syy")))
    d = d.checkpoint()
    seen = E("_x").isNotNull() & (E("_n") > 0)
    ends = d.groupBy(*group).agg(F.min(F.when(seen, E("_x"))).alias("lo"), F.max(F.when(seen, E("_x"))).alias("hi"),
                                 F.sum(F.when(seen, E("_n")).otherwise(0)).alias("n"))
    able = (E("hi") > E("lo")) & (E("n") >= len(sh.names))
    state = ends.filter(able).select(*group, *[b.alias(e) for e, b in zip(EDGES, sh.box(E("lo"), E("hi")))])
    state = state.withColumns({b: E(e) for b, e in zip(BOX, EDGES)})
    d = d.filter(seen)
    for k in range(rounds + 1):
        size = points if k else first
        # the trials carry their group's state, so that each round's plan has the last one's once
        trials = _same(_grid(state, size), d, group, "inner")
        s = sh.of(E("_x"), E("u"), E("v"))
        sums = trials.withColumn("_s", s).groupBy(*group, *EDGES, *BOX, "u", "v").agg(
            F.sum("_n").alias("n"), F.sum("_sy").alias("sy"), F.sum("_syy").alias("syy"),
            F.sum(E("_n") * E("_s")).alias("ss"), F.sum(E("_n") * E("_s") * E("_s")).alias("sss"), F.sum(E("_sy") * E("_s")).alias("ssy"))
        if sh.offset:
            sxx, sxy, syy = (E(a) - E(b) * E(c) / E("n") for a, b, c in (("sss", "ss", "ss"), ("ssy", "ss", "sy"), ("syy", "sy", "sy")))
        else:
            sxx, sxy, syy = E("sss"), E("ssy"), E("syy")
        # a shape that is flat over the data to rounding says nothing
        height = F.when(sxx > 1e-9 * E("sss"), sxy / sxx)
        sums = sums.withColumn("height", height).withColumns({
            "ssr": syy - E("height") * sxy,
            "offset": (E("sy") - E("height") * E("ss")) / E("n") if sh.offset else F.lit(None).cast("double")})
        state = (sums.filter(E("ssr").isNotNull() & ~F.isnan("ssr")).groupBy(*group, *EDGES, *BOX)
                 .agg(F.min(F.struct("ssr", "u", "v", "height", "offset")).alias("best")))
        if k < rounds:
            for p in ("u", "v"):  # two steps to each side, within the box
                reach = 2 * (E(f"{p}_hi") - E(f"{p}_lo")) / (size - 1)
                state = state.withColumns({f"{p}_lo": F.greatest(E("best")[p] - reach, E(f"{p}_min")),
                                           f"{p}_hi": F.least(E("best")[p] + reach, E(f"{p}_max"))}).select(*group, *EDGES, *BOX, "best")
            state = state.drop("best")
    out = _same(ends.select(*group, "n"), state.select(*group, *EDGES, "best.*"), group, "left")
    slack = {p: (E(f"{p}_max") - E(f"{p}_min")) * 1e-4 for p in ("u", "v")}
    edge = F.lit(False)
    for p in ("u", "v"):
        edge = edge | (E(p) - E(f"{p}_min") <= slack[p]) | (E(f"{p}_max") - E(p) <= slack[p])
    status = F.when(E("ssr").isNull(), "no_start").when(edge, "on_edge").otherwise("converged")
    return out.select(*group, *[of().alias(name) for name, of in sh.names.items()], "ssr", "n", status.alias("status")).checkpoint()
