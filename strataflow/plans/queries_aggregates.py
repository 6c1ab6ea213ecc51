"""Aggregates, filters, sampling and folds as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.functions.ordered import previous
from strataflow.functions.scalar import clip, finite, rounded, safe_divide
from strataflow.operators import folds
from strataflow.operators.metrics import Stages
from strataflow.operators.quantiles import quantiles
from strataflow.plans.wellview import BY, CURVE_SQL, SO_FAR, WELL, WELLS_SQL, WHOLE, curve, r6, wells

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = f"WITH {WELLS_SQL}, {CURVE_SQL} {sql}"
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"SELECT well_id, count(*) AS n_rows, min(tvt) AS tvt_min, max(tvt) AS tvt_max, {r6('avg(gr)')} AS gr_mean, {r6('stddev_samp(gr)')} AS gr_std FROM w GROUP BY well_id")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).groupBy("well_id").agg(F.count("*").alias("n_rows"), F.min("tvt").alias("tvt_min"), F.max("tvt").alias("tvt_max"), rounded(F.avg("gr")).alias("gr_mean"), rounded(F.stddev_samp("gr")).alias("gr_std"))


@query(f"SELECT well_id, row_id, {r6('avg(gr) OVER p')} AS gr_mean, {r6('coalesce(stddev_samp(gr) OVER p, 0)')} AS gr_std, {r6('max(md) OVER p - min(md) OVER p')} AS md_range, {r6('max(x) OVER p - min(x) OVER p')} AS x_range FROM w WINDOW p AS (PARTITION BY well_id)")
def group_stats_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = WELL.whole
    spread = lambda v: rounded(F.max(v).over(w) - F.min(v).over(w))
    return wells(spark, sf_dir).select("well_id", "row_id", rounded(F.avg("gr").over(w)).alias("gr_mean"), rounded(F.coalesce(F.stddev_samp("gr").over(w), F.lit(0.0))).alias("gr_std"), spread("md").alias("md_range"), spread("x").alias("x_range"))


@query("SELECT well_id, count(*) AS rows_in_curve, " + ", ".join(f"{r6(f'quantile_cont(cgr, {q})')} AS q{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + f", {r6('avg(cgr)')} AS mean, {r6('stddev_samp(cgr)')} AS std, max(cgr) - min(cgr) AS spread FROM c GROUP BY well_id")
def curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = [rounded(F.expr(f"percentile(cgr, {v})")).alias(f"q{int(v * 100)}") for v in (0.1, 0.25, 0.5, 0.75, 0.9)]
    return curve(spark, sf_dir).groupBy("well_id").agg(F.count("*").alias("rows_in_curve"), *q, rounded(F.avg("cgr")).alias("mean"), rounded(F.stddev_samp("cgr")).alias("std"), (F.max("cgr") - F.min("cgr")).alias("spread"))


@query("SELECT count(tvt) AS n, " + r6("avg(tvt)") + " AS mean, " + r6("stddev_samp(tvt)") + " AS std, min(tvt) AS lo, max(tvt) AS hi, " + ", ".join(f"{r6(f'quantile_cont(tvt, {q})')} AS p{int(q * 100)}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + " FROM w")
def describe_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a column over all rows; the percentiles are exact, by distributed selection."""
    shares = (0.01, 0.05, 0.5, 0.95, 0.99)
    found = zip(shares, quantiles(wells(spark, sf_dir), "tvt", shares), strict=True)
    q = [rounded(F.lit(v).cast("double")).alias(f"p{int(share * 100)}") for share, v in found]
    return wells(spark, sf_dir).agg(F.count("tvt").alias("n"), rounded(F.avg("tvt")).alias("mean"), rounded(F.stddev_samp("tvt")).alias("std"), F.min("tvt").alias("lo"), F.max("tvt").alias("hi"), *q)


_PROFILED = ("tvt", "tvt_input", "gr", "md")


@query(" UNION ALL ".join(f"SELECT '{v}' AS column_name, count(*) AS n_rows, count(*) - count({v}) AS missing, {r6(f'(count(*) - count({v})) / CAST(count(*) AS DOUBLE)')} AS missing_rate, count(DISTINCT {v}) AS n_distinct FROM w" for v in _PROFILED))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and distinct counts of each column. Distinct counts come from one groupBy of (column, value) pairs, so columns do not multiply rows in memory."""
    rows = wells(spark, sf_dir)
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(v).alias("column_name"), c(v).cast("double").alias("value")) for v in _PROFILED))).alias("p")).select("p.*")
    values = pairs.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    total = values.groupBy("column_name").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(c("value").isNull(), c("n"))), F.lit(0)).alias("missing"), F.count("value").alias("n_distinct"))
    return total.select("column_name", "n_rows", "missing", rounded(c("missing") / c("n_rows")).alias("missing_rate"), "n_distinct")


@query(f"SELECT well_id, row_id, coalesce(gr, m) AS gr_imputed FROM w, (SELECT {r6('median(gr)')} AS m FROM w WHERE CAST(well_id AS BIGINT) % 10 <> 0)")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All wells filled with the median over training wells."""
    rows = wells(spark, sf_dir)
    (middle,) = quantiles(rows.filter(c("well_id").cast("long") % 10 != 0), "gr", [0.5])
    return rows.select("well_id", "row_id", F.coalesce("gr", rounded(F.lit(middle).cast("double"))).alias("gr_imputed"))


@query("SELECT well_id, row_id, coalesce(gr, median(gr) OVER (PARTITION BY well_id), 0) AS gr_clean, coalesce(dgr, 0) AS diff_clean FROM (SELECT *, gr - tvt_input AS dgr FROM w)")
def well_median_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps become the well's median, and 0 in difference columns; medians are aggregated and joined back."""
    rows = wells(spark, sf_dir).withColumn("dgr", finite(c("gr") - c("tvt_input")))
    middle = Window.partitionBy("well_id")
    return rows.select("well_id", "row_id", F.coalesce(finite(c("gr")), F.median("gr").over(middle), F.lit(0.0)).alias("gr_clean"), F.coalesce("dgr", F.lit(0.0)).alias("diff_clean"))


@query("SELECT well_id, row_id, coalesce(gr, -999.0) AS gr_coded, CAST(gr IS NULL AS TINYINT) AS gr_missing, CAST(tvt AS FLOAT) AS tvt_float FROM w")
def sentinel_and_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).select("well_id", "row_id", F.coalesce("gr", F.lit(-999.0)).alias("gr_coded"), c("gr").isNull().cast("tinyint").alias("gr_missing"), c("tvt").cast("float").alias("tvt_float"))


@query("SELECT well_id, max_by(gr, row_id) FILTER (gr IS NOT NULL) AS last_gr, max_by(tvt_input, row_id) FILTER (tvt_input IS NOT NULL) AS last_tvt_input, max_by(md, row_id) AS last_md FROM w GROUP BY well_id")
def last_nonnull_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda v: F.max_by(c(v), F.when(c(v).isNotNull(), c("row_id")))
    return wells(spark, sf_dir).groupBy("well_id").agg(last("gr").alias("last_gr"), last("tvt_input").alias("last_tvt_input"), last("md").alias("last_md"))


@query(f"SELECT well_id, {r6('avg(gr)')} AS mean, {r6('stddev_pop(gr)')} AS std0, min(gr) AS lo, max(gr) AS hi, {r6('quantile_cont(gr, 0.9)')} AS p90 FROM w WHERE isfinite(gr) GROUP BY well_id")
def finite_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).filter(finite(c("gr")).isNotNull()).groupBy("well_id").agg(rounded(F.avg("gr")).alias("mean"), rounded(F.stddev_pop("gr")).alias("std0"), F.min("gr").alias("lo"), F.max("gr").alias("hi"), rounded(F.expr("percentile(gr, 0.9)")).alias("p90"))


@query(f"SELECT well_id, {r6('CASE WHEN count(*) < 2 OR stddev_pop(md) < 1e-6 THEN 0 ELSE regr_slope(tvt, md) END')} AS slope, {r6('CASE WHEN count(*) < 2 OR stddev_pop(md) < 1e-6 THEN avg(tvt) ELSE regr_intercept(tvt, md) END')} AS intercept FROM w WHERE tvt_input IS NOT NULL GROUP BY well_id")
def ols_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = (F.count("*") < 2) | (F.stddev_pop("md") < 1e-6)
    known = wells(spark, sf_dir).filter(c("tvt_input").isNotNull())
    return known.groupBy("well_id").agg(rounded(F.when(flat, 0.0).otherwise(F.regr_slope("tvt", "md"))).alias("slope"), rounded(F.when(flat, F.avg("tvt")).otherwise(F.regr_intercept("tvt", "md"))).alias("intercept"))


@query(f"""SELECT well_id, {r6('CASE WHEN n < 20 OR xr <= 1e-9 THEN 1 ELSE yr / xr END')} AS scale, {r6('CASE WHEN n < 20 OR xr <= 1e-9 THEN 0 ELSE ym - yr / xr * xm END')} AS shift FROM (
SELECT well_id, count(*) AS n, quantile_cont(x, 0.9) - quantile_cont(x, 0.1) AS xr, quantile_cont(gr, 0.9) - quantile_cont(gr, 0.1) AS yr, median(x) AS xm, median(gr) AS ym FROM w WHERE gr IS NOT NULL GROUP BY well_id)""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of the middle 80 % ranges and the shift of medians; (1, 0) below 20 points or without spread."""
    q = wells(spark, sf_dir).filter(c("gr").isNotNull()).groupBy("well_id").agg(F.count("*").alias("n"), F.expr("percentile(x, array(0.1, 0.5, 0.9))").alias("qx"), F.expr("percentile(gr, array(0.1, 0.5, 0.9))").alias("qy"))
    xr, yr = c("qx")[2] - c("qx")[0], c("qy")[2] - c("qy")[0]
    few = (c("n") < 20) | (xr <= 1e-9)
    ratio = safe_divide(yr, xr)
    return q.select("well_id", rounded(F.when(few, 1.0).otherwise(ratio)).alias("scale"), rounded(F.when(few, 0.0).otherwise(c("qy")[1] - ratio * c("qx")[1])).alias("shift"))


@query(f"SELECT well_id, {r6('CASE WHEN count(*) >= 20 THEN corr(gr, md) END')} AS r FROM w WHERE gr IS NOT NULL GROUP BY well_id")
def corr_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).filter(c("gr").isNotNull()).groupBy("well_id").agg(rounded(F.when(F.count("*") >= 20, F.corr("gr", "md"))).alias("r"))


_K, _G = "tvt_input IS NOT NULL", "tvt_input IS NULL"


@query(f"""SELECT well_id, count(*) AS n_rows, count(*) FILTER ({_K}) AS known_n, count(*) FILTER ({_G}) AS gap_n, {r6(f'count(*) FILTER ({_G}) / CAST(count(*) AS DOUBLE)')} AS gap_share,
{r6(f'avg(CASE WHEN gr IS NULL THEN 1.0 ELSE 0.0 END) FILTER ({_G})')} AS gap_gr_missing, {r6(f'avg(gr) FILTER ({_K})')} AS known_gr_mean, {r6(f'stddev_pop(gr) FILTER ({_G})')} AS gap_gr_std,
{r6(f'max(md) FILTER ({_G}) - min(md) FILTER ({_G})')} AS gap_md_span, {r6(f'max_by(z, row_id) FILTER ({_G}) - min_by(z, row_id) FILTER ({_G})')} AS gap_z_delta FROM w GROUP BY well_id""")
def known_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, gap = c("tvt_input").isNotNull(), c("tvt_input").isNull()
    of = lambda cond, x: F.when(cond, x)
    missing = F.when(c("gr").isNull(), 1.0).otherwise(0.0)
    return wells(spark, sf_dir).groupBy("well_id").agg(
        F.count("*").alias("n_rows"), F.count_if(known).alias("known_n"), F.count_if(gap).alias("gap_n"), rounded(F.count_if(gap) / F.count("*")).alias("gap_share"), rounded(F.avg(of(gap, missing))).alias("gap_gr_missing"),
        rounded(F.avg(of(known, c("gr")))).alias("known_gr_mean"), rounded(F.stddev_pop(of(gap, c("gr")))).alias("gap_gr_std"), rounded(F.max(of(gap, c("md"))) - F.min(of(gap, c("md")))).alias("gap_md_span"),
        rounded(F.max_by("z", of(gap, c("row_id"))) - F.min_by("z", of(gap, c("row_id")))).alias("gap_z_delta"),
    )


@query(f"""SELECT well_id, {r6('median(b)')} AS b_full, {r6('median(b) FILTER (i < greatest(1, n // 3))')} AS b_early, {r6('median(b) FILTER (i >= n // 3 AND i < greatest(n // 3 + 1, 2 * n // 3))')} AS b_mid,
{r6('median(b) FILTER (i >= n - 50)')} AS b_late, {r6('sum(b * exp(0.02 * (i - n + 1))) / sum(exp(0.02 * (i - n + 1)))')} AS b_weighted FROM (
SELECT well_id, tvt + z - x AS b, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY well_id) AS n FROM w WHERE tvt_input IS NOT NULL) GROUP BY well_id""")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of a surface over thirds of the known rows, its end, and weighted towards its end."""
    rows = wells(spark, sf_dir).filter(c("tvt_input").isNotNull()).withColumn("b", c("tvt") + c("z") - c("x"))
    rows = rows.withColumn("i", F.row_number().over(WELL.window) - 1).withColumn("n", F.count("*").over(WELL.whole))
    i, n, b = c("i"), c("n"), c("b")
    third, two = F.floor(n / 3), F.floor(2 * n / 3)
    weight = F.exp(0.02 * (i - n + 1))
    seg = lambda cond: rounded(F.median(F.when(cond, b)))
    return rows.groupBy("well_id").agg(rounded(F.median("b")).alias("b_full"), seg(i < F.greatest(F.lit(1), third)).alias("b_early"), seg((i >= third) & (i < F.greatest(third + 1, two))).alias("b_mid"), seg(i >= n - 50).alias("b_late"), rounded(F.sum(b * weight) / F.sum(weight)).alias("b_weighted"))


@query(f"""SELECT CASE WHEN grouping(well_id) = 1 THEN 'overall' ELSE well_id END AS well_id, {r6('sqrt(avg((tvt - anchor) * (tvt - anchor)))')} AS rmse, {r6('avg(tvt - anchor)')} AS bias FROM (
SELECT *, last_value(tvt_input IGNORE NULLS) OVER ({WHOLE}) AS anchor FROM w) WHERE tvt_input IS NULL GROUP BY ROLLUP (well_id)""")
def rmse_bias_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the anchor as a prediction, by well and overall, in one aggregation."""
    rows = wells(spark, sf_dir).withColumn("anchor", F.last("tvt_input", ignorenulls=True).over(WELL.whole)).filter("tvt_input is null")
    d = c("tvt") - c("anchor")
    out = rows.rollup("well_id").agg(F.grouping("well_id").alias("g"), rounded(F.sqrt(F.avg(d * d))).alias("rmse"), rounded(F.avg(d)).alias("bias"))
    return out.select(F.when(c("g") == 1, F.lit("overall")).otherwise(c("well_id")).alias("well_id"), "rmse", "bias")


@query(f"""SELECT well_id, row_id, {r6('list_avg(s)')} AS sig_mean, {r6('list_stddev_pop(s)')} AS sig_std, {r6('list_median(s)')} AS sig_median, {r6('list_max(s) - list_min(s)')} AS sig_range,
CAST(list_position(s, list_min(s)) - 1 AS INT) AS best, {r6('list_sort(s)[2] - list_sort(s)[1]')} AS gap,
{r6('(exp(-s[1] / 100) * s[1] + exp(-s[2] / 100) * s[2] + exp(-s[3] / 100) * s[3] + exp(-s[4] / 100) * s[4]) / (exp(-s[1] / 100) + exp(-s[2] / 100) + exp(-s[3] / 100) + exp(-s[4] / 100))')} AS soft FROM (SELECT well_id, row_id, [tvt, x / 10, y / 10, z / 10] AS s FROM w)""")
def cross_signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the signals of a row: mean, population deviation, median, range, the smallest's place, its lead, and the softmax mean.

    Signals are running sums, whose last bits depend on the order of addition: equal to 9 digits they tie, and the first is the smallest.
    """
    rows = wells(spark, sf_dir).select("well_id", "row_id", F.array("tvt", c("x") / 10, c("y") / 10, c("z") / 10).alias("s"))
    rows = rows.withColumn("sorted", F.array_sort("s")).withColumn("m", F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / F.size("s"))
    spread = F.sqrt(F.aggregate(F.transform("s", lambda v: (v - c("m")) * (v - c("m"))), F.lit(0.0), lambda a, v: a + v) / F.size("s"))
    soft = F.aggregate(F.transform("s", lambda v: F.exp(-v / 100) * v), F.lit(0.0), lambda a, v: a + v) / F.aggregate(F.transform("s", lambda v: F.exp(-v / 100)), F.lit(0.0), lambda a, v: a + v)
    first, level = c("sorted")[0], F.transform("s", lambda v: F.round(v, 9))
    return rows.select("well_id", "row_id", rounded(c("m")).alias("sig_mean"), rounded(spread).alias("sig_std"), rounded((c("sorted")[1] + c("sorted")[2]) / 2).alias("sig_median"), rounded(c("sorted")[3] - first).alias("sig_range"), (F.array_position(level, F.array_min(level)) - 1).cast("int").alias("best"), rounded(c("sorted")[1] - first).alias("gap"), rounded(soft).alias("soft"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(least(greatest(l_extendedprice, 1000), 50000), 6) AS price, round(l_extendedprice / nullif(l_discount, 0), 6) AS per_discount, CASE WHEN l_quantity > 25 THEN l_tax END AS tax_if_large FROM lineitem")
def clip_divide_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.round(clip(c("l_extendedprice"), 1000, 50000), 6).alias("price"), F.round(safe_divide(c("l_extendedprice"), c("l_discount")), 6).alias("per_discount"), F.when(c("l_quantity") > 25, c("l_tax")).alias("tax_if_large"))


@query("SELECT well_id, row_id, tvt, gr FROM w WHERE tvt_input IS NULL AND tvt IS NOT NULL AND gr IS NOT NULL AND x IS NOT NULL")
def hidden_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden, labelled rows without nulls in the named columns."""
    return wells(spark, sf_dir).filter("tvt_input is null and tvt is not null").na.drop(subset=["gr", "x"]).select("well_id", "row_id", "tvt", "gr")


@query("""SELECT w.well_id, count(*) FILTER (tvt_input IS NULL) AS hidden, count(tvt_input) AS known, coalesce(max(k), 0) AS curve_rows FROM w LEFT JOIN (SELECT well_id, count(*) AS k FROM c GROUP BY well_id) s ON s.well_id = w.well_id
GROUP BY w.well_id HAVING count(*) FILTER (tvt_input IS NULL) > 0 AND count(tvt_input) >= 10 AND coalesce(max(k), 0) >= 3""")
def well_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells with hidden rows, ten known rows at least, and three curve rows at least."""
    return folds.eligible(wells(spark, sf_dir), curve(spark, sf_dir), "well_id", "tvt_input")


@query("SELECT c_custkey AS id, c_acctbal AS amount, CAST(NULL AS VARCHAR) AS note, 'customer' AS split FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name, 'supplier' FROM supplier")
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by name of splits with different columns."""
    a = _table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_acctbal").alias("amount"), F.lit("customer").alias("split"))
    b = _table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("note"), c("s_acctbal").alias("amount"), F.lit("supplier").alias("split"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key once, with the place where it is first met."""
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("SELECT well_id, row_id, tvt FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY tvt DESC, row_id) AS k FROM w) WHERE k <= 5")
def top_k_per_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("well_id").orderBy(F.desc("tvt"), "row_id")
    return wells(spark, sf_dir).withColumn("k", F.row_number().over(by)).filter("k <= 5").select("well_id", "row_id", "tvt")


@query("SELECT well_id, n, CAST((row_number() OVER (ORDER BY n, md5(well_id), well_id) - 1) // 5 AS BIGINT) AS chunk, CAST((row_number() OVER (ORDER BY n, md5(well_id), well_id) - 1) % 5 AS INT) AS fold FROM (SELECT well_id, count(*) AS n FROM w GROUP BY well_id)")
def fold_length_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.length_chunks(folds.sizes(wells(spark, sf_dir), "well_id"), "well_id", 5, seed=None)


@query(None)
def fold_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of whole wells by largest-first packing of their row counts."""
    return folds.balanced(folds.sizes(wells(spark, sf_dir), "well_id"), "well_id", 5)


#: Well by well: each goes to the lightest fold.
_PACKED = f"""WITH RECURSIVE {WELLS_SQL}, g AS (SELECT well_id, n, row_number() OVER (ORDER BY n DESC, md5(well_id), well_id) AS i FROM (SELECT well_id, count(*) AS n FROM w GROUP BY well_id)),
r(i, loads, fold) AS (SELECT CAST(0 AS BIGINT), CAST([0, 0, 0, 0, 0] AS BIGINT[]), CAST(-1 AS BIGINT)
 UNION ALL SELECT r.i + 1, list_transform(range(1, 6), lambda k: loads[k] + CASE WHEN k = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END), list_position(loads, list_min(loads)) - 1 FROM r JOIN g ON g.i = r.i + 1)"""
ORACLES["fold_balanced"] = f"{_PACKED} SELECT g.well_id, g.n, CAST(fold AS INT) AS fold FROM g JOIN r USING (i)"


@query("SELECT well_id, n, CAST((row_number() OVER (ORDER BY md5('42:' || well_id), well_id) - 1) % 5 AS INT) AS fold FROM (SELECT well_id, count(*) AS n FROM w GROUP BY well_id)")
def fold_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.shuffled(folds.sizes(wells(spark, sf_dir), "well_id"), "well_id", 5, seed=42)


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) - 1) % 5 AS INT) AS fold FROM events")
def fold_stratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_rows(_table(spark, sf_dir, "events"), "event_id", "event_type", 5)


@query("SELECT well_id, row_id, tvt FROM w WHERE well_id IN (SELECT well_id FROM (SELECT well_id, row_number() OVER (ORDER BY md5(well_id), well_id) AS k, count(*) OVER () AS m FROM (SELECT DISTINCT well_id FROM w)) WHERE k <= ceil(0.15 * m))")
def holdout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of 15 % of the wells, chosen by a hash of their ids."""
    rows = wells(spark, sf_dir)
    return rows.join(folds.holdout(rows, "well_id", 0.15), "well_id", "left_semi").select("well_id", "row_id", "tvt")


@query("SELECT DISTINCT well_id, row_id FROM (SELECT well_id, n, least(20, n) AS m, unnest(generate_series(0, least(20, n) - 1)) AS i FROM (SELECT DISTINCT well_id, n FROM w)) s JOIN w USING (well_id) WHERE row_id = CASE WHEN s.m = 1 THEN 0 ELSE floor(i * (s.n - 1) / CAST(s.m - 1 AS DOUBLE)) END")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at evenly spaced places of each well."""
    return folds.evenly_spaced(wells(spark, sf_dir), WELL, 20).select("well_id", "row_id")


@query("SELECT well_id, g AS first_gap, count(*) FILTER (tvt_input IS NOT NULL AND row_id < g) AS known_before FROM w JOIN (SELECT well_id, min(row_id) AS g FROM w WHERE tvt_input IS NULL GROUP BY well_id) USING (well_id) GROUP BY well_id, g HAVING known_before > 0")
def eligible_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells with a gap and a known row before it."""
    return folds.eligible_by_gap(wells(spark, sf_dir), "well_id", "row_id", "tvt_input")


@query("SELECT CAST(least(greatest(floor(value / 10), 0), 59) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in 60 bins."""
    return _table(spark, sf_dir, "events").groupBy(clip(F.floor(c("value") / 10), 0, 59).cast("int").alias("bin")).agg(F.count("*").alias("n"))


_REASONS = ("no_hidden", "few_known", "short_curve")


@query(f""", v AS (SELECT w.well_id, CASE WHEN count(*) FILTER (tvt_input IS NULL) = 0 THEN 'no_hidden' WHEN count(tvt_input) < 10 THEN 'few_known' WHEN coalesce(max(k), 0) < 3 THEN 'short_curve' END AS skipped
 FROM w LEFT JOIN (SELECT well_id, count(*) AS k FROM c GROUP BY well_id) s ON s.well_id = w.well_id GROUP BY w.well_id),
used AS (SELECT * FROM w WHERE well_id IN (SELECT well_id FROM v WHERE skipped IS NULL)),
f AS (SELECT *, coalesce(last_value(gr IGNORE NULLS) OVER ({SO_FAR}), first_value(gr IGNORE NULLS) OVER ({WHOLE})) AS filled FROM used)
SELECT 'read' AS stage, unnest(['rows', 'known', 'gaps']) AS metric, unnest([count(*), count(tvt_input), count(*) - count(gr)]) AS value FROM w
UNION ALL SELECT 'wells', unnest(['rows', 'kept', {', '.join(f"'{r}'" for r in _REASONS)}]), unnest([count(*), count(*) - count(skipped), {', '.join(f"count(*) FILTER (skipped = '{r}')" for r in _REASONS)}]) FROM v
UNION ALL SELECT 'filled', unnest(['rows', 'replaced', 'left']), unnest([count(*), count(filled) - count(gr), count(*) - count(filled)]) FROM f""")
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a flow's stages have read, which wells they left out and why, and which nulls they replaced."""
    stages = Stages(spark)
    rows = stages.staged(wells(spark, sf_dir).select("well_id", "row_id", "gr", "tvt_input"), "read", known=F.count("tvt_input"), gaps=F.count_if(c("gr").isNull()))
    judged = stages.staged(folds.verdicts(rows, curve(spark, sf_dir), "well_id", "tvt_input"), "wells", kept=F.count_if(c("skipped").isNull()), **{r: F.count_if(c("skipped") == r) for r in _REASONS})
    used = rows.join(judged.filter("skipped is null").select("well_id"), "well_id", "left_semi")
    filled = used.withColumn("filled", F.coalesce(previous(c("gr"), WELL), F.first("gr", ignorenulls=True).over(WELL.whole)))
    stages.staged(filled, "filled", replaced=F.count_if(c("gr").isNull() & c("filled").isNotNull()), left=F.count_if(c("filled").isNull()))
    return stages.table()
