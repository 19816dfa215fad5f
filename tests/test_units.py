"""Hand-sized cases (FIXTURES.md section 3) and operator equivalences."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from adlytics.functions.compat import bounded_bucket, half_even, hour_boundaries, safe_div, full_match
from adlytics.operators.windows import global_lead, split_lag
from adlytics.operators import bayes as B
from adlytics.operators import resample as R
from adlytics.operators import regress as RG
from adlytics.operators import curves as CV


def test_hour_boundary(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 50), dt.datetime(2024, 1, 1, 1, 10))], "a timestamp, b timestamp")
    assert df.select(hour_boundaries("a", "b").alias("h")).first().h == 1


def test_half_even_and_safe_div(spark):
    r = spark.range(1).select(half_even(F.lit(2.5)).alias("a"), half_even(F.lit(3.5)).alias("b"),
                              safe_div(F.lit(1), F.lit(0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (2, 4, None)


def test_full_match_anchors(spark):
    r = spark.range(1).select(full_match(F.lit("xgoogle/ch/1"), "^google/ch/.*|^cm_google/de/.*").alias("a"),
                              full_match(F.lit("google/ch/1"), "^google/ch/.*|^cm_google/de/.*").alias("b")).first()
    assert (r.a, r.b) == (False, True)


def test_rolling_frame_and_null_label(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "t int, v double")
    w = Window.orderBy("t").rowsBetween(-7, -1)
    out = df.select("t", F.coalesce(F.avg("v").over(w), F.lit(0.0)).alias("a"),
                    F.coalesce(F.stddev_samp("v").over(w), F.lit(0.0)).alias("s")).orderBy("t").collect()
    assert [r.a for r in out] == [0.0, 1.0, 1.5] and out[1].s == 0.0
    lab = spark.createDataFrame([(None,)], "p double").select(F.when(F.col("p") <= 0.2, "good").otherwise("bad").alias("l"))
    assert lab.first().l == "bad"


def test_histogram_max_in_last_bin(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("x"))
    bins = {r.b: r.n for r in df.groupBy(bounded_bucket("x", 0.0, 10.0, 5).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert bins[5] == 3 and sum(bins.values()) == 11


def test_split_lag_equals_lag(spark):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i + k), float(i * 10 + k))
            for k in (0, 1, 2) for i in range(40)] + [(None, dt.datetime(2024, 1, 3, 5), 99.0)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, v double")
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("ts")))
    got = split_lag(df, ["k"], "ts", "v", "p")
    a = sorted((tuple(r) for r in want.collect()), key=str)
    b = sorted((tuple(r) for r in got.select("k", "ts", "v", "p").collect()), key=str)
    assert a == b


def test_global_lead_equals_lead(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i),) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp")
    want = df.select("ts", F.lead("ts").over(Window.orderBy("ts")).alias("next"),
                     F.lead("ts").over(Window.partitionBy(F.to_date("ts")).orderBy("ts")).alias("next_intraday"))
    got = global_lead(df, "ts")
    assert (sorted((tuple(r) for r in want.collect()), key=str)
            == sorted((tuple(r) for r in got.select("ts", "next", "next_intraday").collect()), key=str))


def test_posterior_params(spark):
    d = spark.createDataFrame([("control", dt.date(2024, 1, 1), 10, 3, 0), ("variant", dt.date(2024, 1, 1), 10, 5, 0)],
                              "arm string, date date, n long, k long, day int")
    p = B.posterior_params(d).first()
    assert (p.a_c, p.b_c) == (4.0, 8.0) and abs(p.mean_c - 1 / 3) < 1e-12


def test_hdi_case(spark):
    vals = list(range(1, 11)) + [100]
    d = spark.createDataFrame([(0, float(v)) for v in vals], "day int, x double")
    r = B.hdi(d, "x", ["day"], alpha=0.2).first()
    assert (r.hdi_lower, r.hdi_upper) == (1.0, 9.0)


def test_circular_block_wraps(spark):
    s = spark.createDataFrame([("s", i, float(i)) for i in range(5)], "series string, idx int, value double")
    out = R.circular_block_bootstrap(s, reps=3, seed=1, size=2).collect()
    by = {}
    for r in out:
        by.setdefault(r.rep, {})[r.idx] = r.src
    for rep, m in by.items():
        assert sorted(m) == [0, 1, 2, 3, 4]
        for blk in (0, 2):
            assert m[blk + 1] == (m[blk] + 1) % 5


def test_chow_exact_lines(spark):
    rows = [(float(x), 1.0 + 2.0 * x if x <= 9 else 50.0 - 1.0 * x) for x in range(20)]
    d = spark.createDataFrame(rows, "x double, y double")
    r = RG.chow_test(d, "x", "y", [(9, 10)]).first()
    assert abs(r.rss_before) < 1e-9 and abs(r.rss_after) < 1e-9 and r.f_stat is None
    rows2 = [(x, y + (0.3 if int(x) % 2 else -0.3)) for x, y in rows]
    r2 = RG.chow_test(spark.createDataFrame(rows2, "x double, y double"), "x", "y", [(9, 10)]).first()
    assert r2.f_stat > 0 and r2.rss_pooled >= r2.rss_before + r2.rss_after


def test_f_pvalue_known(spark):
    # P(F(2, 10) > 4.1028) = 0.05 (table value)
    d = spark.createDataFrame([(4.1028, 2.0, 10.0), (1.0, 5.0, 5.0)], "f_stat double, df1 double, df2 double")
    a, b = RG.chow_significance(d).collect()
    assert abs(a.p_value - 0.05) < 1e-4 and b.p_value is None


def test_linear_fit(spark):
    d = spark.createDataFrame([("g", float(x), 2.0 + 3.0 * x) for x in range(10)], "g string, x double, y double")
    r = CV.linear_fit(d, ["g"], "x", "y").first()
    assert abs(r.a - 2) < 1e-9 and abs(r.b - 3) < 1e-9


def test_quadratic_fit(spark):
    d = spark.createDataFrame([("g", float(x), 0.5 * x * x - 2 * x + 7) for x in range(1, 30)], "g string, x double, y double")
    r = CV.quadratic_fit(d, ["g"], "x", "y").first()
    assert abs(r.a - 0.5) < 1e-7 and abs(r.b + 2) < 1e-6 and abs(r.c - 7) < 1e-5


def test_lgamma_column(spark):
    from adlytics.functions.special import lgamma
    xs = [0.5, 1.0, 3.7, 20.0, 1000.0, 250000.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(lgamma(F.col("x")).alias("l")).collect()
    for x, r in zip(xs, got):
        assert abs(r.l - math.lgamma(x)) < 1e-8 * max(1.0, abs(math.lgamma(x)))


def test_rolling_prev_rows_equals_window(spark):
    import random
    from adlytics.operators.windows import rolling_prev_rows
    rnd = random.Random(0)
    rows = []
    t0 = dt.datetime(2024, 1, 1)
    for k, n in (("hot", 400), ("b", 30), ("c", 3), (None, 12)):
        for i in range(n):
            rows.append((k, t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20)), rnd.random()))
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    w = Window.partitionBy("k").orderBy("ts").rowsBetween(-7, -1)
    want = df.select("k", "ts", F.avg("v").over(w).alias("a"), F.stddev_samp("v").over(w).alias("s"))
    got = rolling_prev_rows(df, ["k"], "ts", "v", 7, {"a": "avg", "s": "stddev"}).select("k", "ts", "a", "s")
    norm = lambda rs: sorted(((r.k, r.ts, None if r.a is None else round(r.a, 9),
                               None if r.s is None else round(r.s, 9)) for r in rs), key=str)
    assert norm(want.collect()) == norm(got.collect())
    # rows of one timestamp in the order of tie; keys of one row left out
    tied = spark.createDataFrame([(k, t0 + dt.timedelta(hours=6 * (i // 5)), i * 7 % 60, float(i * i % 31))
                                  for k, n in (("hot", 60), (None, 20), ("one", 1)) for i in range(n)],
                                 "k string, ts timestamp, id int, v double")
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-7, -1)
    want = tied.filter("k is null or k <> 'one'").select("k", F.col("id").alias("ts"), F.avg("v").over(w).alias("a"), F.stddev_samp("v").over(w).alias("s"))
    got = rolling_prev_rows(tied, ["k"], "ts", "v", 7, {"a": "avg", "s": "stddev"}, tie=["id"], alone=False)
    assert norm(want.collect()) == norm(got.select("k", F.col("id").alias("ts"), "a", "s").collect())


def test_reshape_helpers(spark):
    from adlytics.operators.reshape import expand_trials, melt, pivot_values, fill_calendar
    t = expand_trials(spark.createDataFrame([(10, 3)], "n int, k int"), "n", "k")
    r = t.agg(F.count("*").alias("n"), F.sum("trial").alias("k")).first()
    assert (r.n, r.k) == (10, 3)
    d = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 3)], "src string, arm string, u int")
    p = {r.src: (r.a, r.b) for r in pivot_values(d, ["src"], "arm", ["a", "b"], "count", "u").collect()}
    assert p == {"s1": (1, 1), "s2": (1, 0)}
    w = spark.createDataFrame([("x", 1.0, None)], "g string, m1 double, m2 double")
    assert melt(w, ["g"], ["m1", "m2"]).count() == 1
    c = spark.createDataFrame([("s", dt.date(2024, 1, 1), 5), ("s", dt.date(2024, 1, 4), 7)], "k string, d date, v int")
    f = fill_calendar(c, ["k"], "d", ["v"]).orderBy("d").collect()
    assert [r.v for r in f] == [5, 0, 0, 7]


def test_parquet_cache(spark):
    from adlytics.sources.text import cached
    name = f"unit-{dt.datetime.now().strftime('%H%M%S%f')}"
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "x")

    a = cached(spark, name, build)
    b = cached(spark, name, build)
    assert a.count() == 5 and b.count() == 5 and len(calls) == 1


def test_cache_key_holds_source_and_parameters(spark):
    from adlytics.sources.text import cached
    name = f"unit-key-{dt.datetime.now().strftime('%H%M%S%f')}"
    one = cached(spark, name, lambda: spark.range(1), "a", {"p": 1})
    two = cached(spark, name, lambda: spark.range(2), "a", {"p": 2})
    three = cached(spark, name, lambda: spark.range(3), "b", {"p": 1})
    assert [x.count() for x in (one, two, three)] == [1, 2, 3]
    assert cached(spark, name, lambda: spark.range(9), "a", {"p": 1}).count() == 1


def test_report_rows_kept(spark, tmp_path):
    """Short lines and empty fields become NULL, only over-long lines go."""
    from adlytics.sources import text
    head = "\t".join(text.REPORT_COLUMNS)
    body = ["full\t1\t2\t3%\t4%\t5\t6", "empty last\t1\t2\t3%\t4%\t5\t", "short\t1\t2", "long\t1\t2\t3\t4\t5\t6\t7", "only"]
    (tmp_path / "a.csv").write_text("\n".join(["Report", "All\ttime", head, *body]) + "\n", encoding="utf-16")
    rows = {r.search_term: r for r in text.read_report(spark, str(tmp_path / "a.csv")).collect()}
    assert set(rows) == {"full", "empty last", "short", "only"}
    assert rows["empty last"].revenue is None and rows["short"].clicks == "2" and rows["short"].cr is None
    (tmp_path / "b.csv").write_text("no header\n1\t2\n", encoding="utf-16")
    with pytest.raises(Exception, match="no header line"):
        text.read_report(spark, str(tmp_path / "b.csv")).collect()


def test_generators_use_many_tasks(spark):
    d = spark.createDataFrame([("control", dt.date(2024, 1, 1), 1000, 30, 0), ("variant", dt.date(2024, 1, 1), 1000, 50, 0)],
                              "arm string, date date, n long, k long, day int")
    one = spark.createDataFrame([("s", i, float(i)) for i in range(30)], "series string, idx int, value double")
    busy = lambda df: len(spark.createDataFrame(df.rdd.mapPartitions(lambda p: [(1,)] if any(True for _ in p) else []), "n int").collect())
    assert busy(B.spread(spark.range(200), "id")) > 4
    assert B.importance_sampling(B.posterior_params(d), 50_000).count() == 1
    assert R.iid_bootstrap(one, 50).count() == 1500


def test_fit_status(spark):
    xs = [float(x) for x in range(1, 40)]
    rows = [("good", x, 2 * x ** 0.5) for x in xs] + [(None, x, 3 * x ** 0.25) for x in xs] + [("none", x, x) for x in xs]
    d = spark.createDataFrame(rows, "g string, x double, y double")
    p0 = spark.createDataFrame([("good", 1.0, 1.0), (None, 1.0, 1.0), ("none", None, 1.0)], "g string, a double, b double")
    got = {r.g: r for r in CV.lm_fit(d, ["g"], "x", "y", "power", p0, bounds=(0.0, 1.0)).collect()}
    assert got["good"].status == got[None].status == "converged" and got["none"].status == "no_start"
    assert abs(got["good"].a - math.log(2)) < 1e-3 and abs(got["good"].b - 0.5) < 1e-3 and got[None].on_bound
    few = {r.g: r for r in CV.lm_fit(d, ["g"], "x", "y", "power", p0, max_iter=1).collect()}
    assert few["good"].status == "max_iter"


def test_report_read_in_byte_ranges(spark, tmp_path):
    """Ranges of any length, both byte orders and line ends, preamble, and
    code units that hold the bytes of a line feed across their border."""
    from adlytics.sources import text
    head = "\t".join(text.REPORT_COLUMNS)
    lines = [f"term {i} \u00fc\u4e2d\t{i}\t2\t3%\t4%\t\t6" for i in range(400)] + ["short\t1", "", "Search term\t9"]
    false_end = {"UTF-16LE": "\u0a95\u3000", "UTF-16BE": "\u3000\u0a95"}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for enc, pair in false_end.items():
            assert "\n".encode(enc) in pair.encode(enc)
            for k, (end, extra) in enumerate([("\n", []), ("\r\n", []), ("\n", [f"x{pair * j}y{i}\t{pair}\t5" for i in range(40) for j in range(1, 4)])]):
                body = end.join(["Report", "All\ttime", head, *lines, *extra, *lines[:50]]) + end
                p = tmp_path / f"{enc}{k}.csv"
                p.write_bytes(("\ufeff" + body).encode(enc))
                spark.conf.set("spark.sql.files.maxPartitionBytes", "100000000")
                want = sorted(map(str, text.read_report(spark, str(p)).collect()))
                assert len(want) == 452 + len(extra)
                for size in (997, 1000, 4001):
                    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
                    got = text.read_report_split(spark, str(p), encoding=enc)
                    assert sorted(map(str, got.collect())) == want, (enc, k, size)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4001")
        tasks = spark.read.option("lineSep", "\n").option("encoding", "UTF-16LE").text(str(tmp_path / "UTF-16LE0.csv"))
        assert tasks.rdd.getNumPartitions() > 4
        (tmp_path / "none.csv").write_bytes("no header\n1\t2\n".encode("utf-16-le"))
        with pytest.raises(Exception, match="no header line"):
            text.read_report_split(spark, str(tmp_path / "none.csv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_exact_quantile(spark):
    """Hot, small, constant and NULL groups; both sides of ``small``; heavy values."""
    import random
    import numpy as np
    from adlytics.operators.quantile import exact_quantile
    rnd = random.Random(3)
    groups = {("hot", 1): [rnd.lognormvariate(0, 3) for _ in range(9000)] + [0.5] * 700, ("even", 1): [1.0, 2.0, 4.0, 8.0],
              ("even", None): [3.0], (None, None): [float(i % 7) for i in range(500)], ("same", 2): [2.5] * 300,
              ("inf", 1): [float("-inf"), 1.0, float("inf"), float("inf")]}
    rows = [(a, b, x) for (a, b), xs in groups.items() for x in [*xs, None]] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "a string, b int, x double").repartition(8)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        for small, bins in ((4096, 256), (10, 16), (100000, 4)):
            got = {(r.a, r.b): r.m for r in exact_quantile(df, ["a", "b"], "x", q, "m", bins, small, 8).collect()}
            assert set(got) == set(groups)
            for k, xs in groups.items():
                want = float(np.quantile(xs, q)) if k[0] != "inf" else None
                assert want is None or abs(got[k] - want) <= 1e-12 * max(1, abs(want)), (k, q, small)
    assert got[("inf", 1)] == float("inf")
    none = exact_quantile(df.filter("a = 'none'"), ["a", "b"], "x")
    assert none.columns == ["a", "b", "quantile"] and none.count() == 0


def test_exact_quantile_spreads_a_hot_group(spark):
    """90 % of the rows in one group: no task of the count reads over 3 times the median."""
    from adlytics.operators.quantile import exact_quantile, in_ranges, value_runs
    df = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(0).alias("k"),
                                     F.rand(1).alias("x"))
    plan = exact_quantile(df, ["k"], "x", 0.5, "m", small=256)
    want = df.groupBy("k").agg(F.median("x").alias("w"))
    assert plan.join(want, "k").filter(F.abs(F.col("m") - F.col("w")) > 1e-12).count() == 0 and plan.count() == want.count()
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, off in zip(old, ("false", "-1")):
            spark.conf.set(c, off)
        runs, large = value_runs(df, ["k"], "x", 256, 64)
        assert large.select("_k").distinct().count() == 1
        runs = in_ranges(runs.join(large, ["_k", "_s"], "left_semi"), 256, 64)
        sizes = sorted(r[0] for r in runs.groupBy(F.spark_partition_id()).count().select("count").collect())
        assert sum(sizes) == 180_200 and len(sizes) == 8 and sizes[-1] < 3 * sizes[len(sizes) // 2]
        largest = runs.groupBy("_k", "_bin").count().agg(F.max("count")).first()[0]
        assert largest < 3 * 180_000 / 256
    finally:
        for c, was in old.items():
            spark.conf.set(c, was)


def test_band_reads_clicks_once(spark):
    """C-17: one exchange of the clicks, used again by tail and first rows."""
    import re
    from adlytics.plans.registry import all_queries
    q = all_queries()["c17_cpc_band_repeat"].run(spark, "/root/testdata/sf0.001")
    q.collect()
    text = q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet", text)) == 1 and "ReusedExchange" in text
