"""Queries over ordered rows: fills, lags, rolling windows, positions, gradients, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.functions.ordered import Order, diff, fill, following, gradient, interpolate, lag_filled, lead_filled, previous, rolling, slope_per, stepwise, unwrapped
from strataflow.functions.scalar import rounded, safe_divide
from strataflow.operators import halo
from strataflow.operators.post import smoothed
from strataflow.operators.staging import staged
from strataflow.plans.wellview import BY, SO_FAR, WELL, WELLS_SQL, WHOLE, events, following_sql, previous_sql, r6, wells

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Registers a query under its function's name with its oracle over the view w."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = f"WITH {WELLS_SQL} {sql}"
        return fn

    return add


@query(f"""SELECT well_id || '_' || row_id AS id, well_id, row_id, {r6('anchor')} AS anchor, {r6('tvt - anchor')} AS residual
FROM (SELECT *, last_value(tvt_input IGNORE NULLS) OVER ({WHOLE}) AS anchor FROM w) WHERE tvt_input IS NULL AND anchor IS NOT NULL""")
def anchor_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden rows with the last known value and the difference to it."""
    anchored = wells(spark, sf_dir).withColumn("anchor", F.last("tvt_input", ignorenulls=True).over(WELL.whole))
    hidden = anchored.filter(c("tvt_input").isNull() & c("anchor").isNotNull())
    return hidden.select(F.concat_ws("_", "well_id", "row_id").alias("id"), "well_id", "row_id", rounded(c("anchor")).alias("anchor"), rounded(c("tvt") - c("anchor")).alias("residual"))


@query(f"SELECT well_id, row_id, coalesce({previous_sql('gr')}, {following_sql('gr')}) AS gr_filled, gr IS NULL AS was_missing FROM w")
def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).select("well_id", "row_id", fill(c("gr"), WELL).alias("gr_filled"), c("gr").isNull().alias("was_missing"))


_AT = "CASE WHEN gr IS NOT NULL THEN row_id END"
_INTERPOLATED = f"""i AS (SELECT *, {previous_sql('gr')} AS g0, {following_sql('gr')} AS g1, {previous_sql(_AT)} AS p0, {following_sql(_AT)} AS p1 FROM w),
g AS (SELECT *, coalesce(gr, g0 + (g1 - g0) * (row_id - p0) / nullif(p1 - p0, 0), g0, g1) AS grf FROM i)"""


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).withColumn("grf", interpolate(c("gr"), WELL, c("row_id")))


@query(f", {_INTERPOLATED} SELECT well_id, row_id, {r6('coalesce(grf, avg(gr) OVER ())')} AS gr_interpolated FROM g")
def interp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear by row position, nearest at the ends, the overall mean for a well without any value."""
    rows = interpolated(spark, sf_dir)
    mean = rows.agg(F.avg("gr").alias("overall"))  # one row
    return rows.crossJoin(F.broadcast(mean)).select("well_id", "row_id", rounded(F.coalesce("grf", "overall")).alias("gr_interpolated"))


@query(f"""SELECT well_id, row_id, {r6(f"tvt - first_value(gr IGNORE NULLS) OVER ({WHOLE})")} AS from_first, {r6(f"last_value(gr IGNORE NULLS) OVER ({WHOLE}) - tvt")} AS to_last FROM w""")
def first_last_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.first("gr", ignorenulls=True).over(WELL.whole), F.last("gr", ignorenulls=True).over(WELL.whole)
    return wells(spark, sf_dir).select("well_id", "row_id", rounded(c("tvt") - first).alias("from_first"), rounded(last - c("tvt")).alias("to_last"))


def _lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({BY})"


@query(f"""SELECT well_id, row_id, {r6('coalesce(d1, 0)')} AS diff1, {r6(f"coalesce(d1 - lag(d1) OVER ({BY}), 0)")} AS diff2, {r6(f"coalesce(tvt - {_lag('tvt', 3)}, 0)")} AS diff3
FROM (SELECT *, tvt - {_lag('tvt')} AS d1 FROM w)""")
def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second difference, and that over three rows; 0 where there is none."""
    rows = wells(spark, sf_dir).withColumn("d1", diff(c("tvt"), WELL))
    zero = F.lit(0.0)
    return rows.select("well_id", "row_id", rounded(F.coalesce("d1", zero)).alias("diff1"), rounded(F.coalesce(diff(c("d1"), WELL), zero)).alias("diff2"), rounded(F.coalesce(diff(c("tvt"), WELL, 3), zero)).alias("diff3"))


_LAGS = (1, 5, 15, 30)


@query("SELECT well_id, row_id, " + ", ".join(f"coalesce(lag(tvt, {k}) OVER ({BY}), first_value(tvt) OVER ({WHOLE})) AS lag{k}, coalesce(lead(tvt, {k}) OVER ({BY}), last_value(tvt) OVER ({WHOLE})) AS lead{k}" for k in _LAGS) + " FROM w")
def lag_lead_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [f for k in _LAGS for f in (lag_filled(c("tvt"), WELL, k).alias(f"lag{k}"), lead_filled(c("tvt"), WELL, k).alias(f"lead{k}"))]
    return wells(spark, sf_dir).select("well_id", "row_id", *both)


_KINDS = {"mean": "avg(gr) OVER f", "std": "CASE WHEN count(gr) OVER f >= 2 THEN stddev_samp(gr) OVER f END", "min": "min(gr) OVER f", "max": "max(gr) OVER f"}


def _windowed(kind: str, n: int, before: int, after: int, digits: int = 6) -> str:
    frame = f"({BY} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)" if after else f"({BY} ROWS BETWEEN {before} PRECEDING AND CURRENT ROW)"
    return f"round({_KINDS[kind].replace('OVER f', 'OVER ' + frame)}, {digits}) + 0.0 AS {kind}{n}"


@query("SELECT well_id, row_id, " + ", ".join(_windowed(k, n, n - 1, 0) for n in (3, 7, 15, 31) for k in _KINDS) + " FROM w")
def roll_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).select("well_id", "row_id", *(rounded(rolling(c("gr"), WELL.trailing(n), k)).alias(f"{k}{n}") for n in (3, 7, 15, 31) for k in _KINDS))


@query("SELECT well_id, row_id, " + ", ".join(_windowed(k, n, n // 2, n // 2, 9) for n in (5, 21, 51, 101) for k in ("mean", "std", "max")) + f", {r6(f'median(gr) OVER ({BY} ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)')} AS median17 FROM w")
def roll_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = [rounded(rolling(c("gr"), WELL.centered(n), k), 9).alias(f"{k}{n}") for n in (5, 21, 51, 101) for k in ("mean", "std", "max")]
    return wells(spark, sf_dir).select("well_id", "row_id", *plain, rounded(F.expr("percentile(gr, 0.5)").over(WELL.centered(17))).alias("median17"))


@query(f"SELECT well_id, row_id, {r6(f'sqrt(avg(gr * gr) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))')} AS energy, max(gr) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS envelope FROM w")
def roll_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = WELL.centered(21)
    return wells(spark, sf_dir).select("well_id", "row_id", rounded(rolling(c("gr"), w, "rms")).alias("energy"), rolling(c("gr"), w, "max").alias("envelope"))


@query(f"""SELECT well_id, row_id, {r6('s - coalesce(base, 0)')} AS gr_cumsum FROM (
SELECT *, max(mark) OVER (PARTITION BY well_id) AS base FROM (SELECT *, CASE WHEN tvt_input IS NOT NULL AND lead(tvt_input) OVER ({BY}) IS NULL THEN s END AS mark FROM (SELECT *, sum(tvt) OVER ({SO_FAR}) AS s FROM w))) WHERE tvt_input IS NULL""")
def cumsum_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum over hidden rows, counted from the last known row."""
    rows = wells(spark, sf_dir).withColumn("s", F.sum("tvt").over(WELL.so_far))
    last_known = c("tvt_input").isNotNull() & F.lead("tvt_input").over(WELL.window).isNull()
    rows = rows.withColumn("mark", F.when(last_known, c("s"))).withColumn("base", F.max("mark").over(WELL.whole))
    return rows.filter(c("tvt_input").isNull()).select("well_id", "row_id", rounded(c("s") - F.coalesce("base", F.lit(0.0))).alias("gr_cumsum"))


@query(f"""SELECT well_id, row_id, {r6(f"sum(coalesce(z1, 0)) OVER ({SO_FAR}) / sqrt(row_id + 1)")} AS cum_anomaly FROM (
SELECT *, (gr - avg(gr) OVER (PARTITION BY well_id)) / nullif(stddev_pop(gr) OVER (PARTITION BY well_id), 0) AS z1 FROM w)""")
def cumulative_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = safe_divide(c("gr") - F.avg("gr").over(WELL.whole), F.stddev_pop("gr").over(WELL.whole))
    rows = wells(spark, sf_dir).withColumn("z1", F.coalesce(score, F.lit(0.0)))
    return rows.select("well_id", "row_id", rounded(F.sum("z1").over(WELL.so_far) / F.sqrt(c("row_id") + 1)).alias("cum_anomaly"))


@query(f"""SELECT well_id, row_id, {r6('f')} AS frac, {r6('f * f')} AS frac2, {r6('f * f * f')} AS frac3, {r6('sqrt(f)')} AS sqrt_frac, {r6('ln(1 + row_id)')} AS log1p_row,
{r6('sin(pi() * f)')} AS sin_pi, {r6('f - 0.5')} AS centred, {r6('3 * f * f - 2 * f * f * f')} AS ease, rows_in_well FROM (
SELECT *, row_id / CAST(greatest(max(row_id) OVER (PARTITION BY well_id), 1) AS DOUBLE) AS f, greatest(max(row_id) OVER (PARTITION BY well_id), 1) + 1 AS rows_in_well FROM w)""")
def row_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position within the well; a well of one row counts as two, as its last row number is taken as 1."""
    last = F.greatest(F.max("row_id").over(WELL.whole), F.lit(1))
    rows = wells(spark, sf_dir).withColumn("f", c("row_id") / last).withColumn("rows_in_well", last + 1)
    f = c("f")
    return rows.select("well_id", "row_id", rounded(f).alias("frac"), rounded(f * f).alias("frac2"), rounded(f * f * f).alias("frac3"), rounded(F.sqrt(f)).alias("sqrt_frac"), rounded(F.log1p("row_id")).alias("log1p_row"), rounded(F.sin(F.pi() * f)).alias("sin_pi"), rounded(f - 0.5).alias("centred"), rounded(3 * f * f - 2 * f * f * f).alias("ease"), "rows_in_well")


_KNOWN_ROW = "CASE WHEN gr IS NOT NULL THEN row_id END"
_KNOWN_MD = "CASE WHEN gr IS NOT NULL THEN md END"


@query(f"""SELECT well_id, row_id, row_id - {previous_sql(_KNOWN_ROW)} AS rows_since, {r6(f'md - {previous_sql(_KNOWN_MD)}')} AS md_since, {following_sql(_KNOWN_ROW)} - row_id AS rows_to_next,
{r6(f"avg(CASE WHEN gr IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY well_id)")} AS known_share FROM w""")
def since_last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, md = F.when(c("gr").isNotNull(), c("row_id")), F.when(c("gr").isNotNull(), c("md"))
    share = F.avg(F.when(c("gr").isNull(), 0.0).otherwise(1.0)).over(WELL.whole)
    return wells(spark, sf_dir).select("well_id", "row_id", (c("row_id") - previous(row, WELL)).alias("rows_since"), rounded(c("md") - previous(md, WELL)).alias("md_since"), (following(row, WELL) - c("row_id")).alias("rows_to_next"), rounded(share).alias("known_share"))


@query("SELECT well_id, row_id, " + ", ".join(r6(f"({v} - lag({v}) OVER ({BY})) / nullif(md - lag(md) OVER ({BY}), 0)") + f" AS d{v}_dmd" for v in "xyz") + " FROM w")
def slope_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).select("well_id", "row_id", *(rounded(slope_per(c(v), c("md"), WELL)).alias(f"d{v}_dmd") for v in "xyz"))


_D = {v: f"({v} - lag({v}) OVER ({BY}))" for v in "xyz"}
_STEPS = f"s AS (SELECT *, coalesce(sqrt({_D['x']}*{_D['x']} + {_D['y']}*{_D['y']}), 0) AS s2, coalesce(sqrt({_D['x']}*{_D['x']} + {_D['y']}*{_D['y']} + {_D['z']}*{_D['z']}), 0) AS s3, md - lag(md) OVER ({BY}) AS dm, abs({_D['z']}) AS vz FROM w)"


@query(f", {_STEPS} SELECT well_id, row_id, {r6('s2')} AS step_2d, {r6('s3')} AS step_3d, {r6('s3 / nullif(dm, 0)')} AS step_per_md, {r6('coalesce(vz, 0)')} AS vertical, {r6('sum(s3) OVER (PARTITION BY well_id)')} AS path_length FROM s")
def step_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy, dz, dm = (diff(c(v), WELL) for v in ("x", "y", "z", "md"))
    zero = F.lit(0.0)
    rows = wells(spark, sf_dir).withColumns({"s2": F.coalesce(F.sqrt(dx * dx + dy * dy), zero), "s3": F.coalesce(F.sqrt(dx * dx + dy * dy + dz * dz), zero), "dm": dm, "vz": F.coalesce(F.abs(dz), zero)})
    return rows.select("well_id", "row_id", rounded(c("s2")).alias("step_2d"), rounded(c("s3")).alias("step_3d"), rounded(safe_divide(c("s3"), c("dm"))).alias("step_per_md"), rounded(c("vz")).alias("vertical"), rounded(F.sum("s3").over(WELL.whole)).alias("path_length"))


@query(f"""SELECT well_id, row_id, {r6('''CASE WHEN sd < 1e-9 THEN 0 WHEN m0 IS NULL THEN (t1 - tvt) / nullif(m1 - md, 0) WHEN m1 IS NULL THEN (tvt - t0) / nullif(md - m0, 0)
ELSE -(m1 - md) * t0 / nullif((md - m0) * (m1 - m0), 0) + ((m1 - md) - (md - m0)) * tvt / nullif((md - m0) * (m1 - md), 0) + (md - m0) * t1 / nullif((m1 - md) * (m1 - m0), 0) END''')} AS gradient FROM (
SELECT *, lag(tvt) OVER ({BY}) AS t0, lead(tvt) OVER ({BY}) AS t1, lag(md) OVER ({BY}) AS m0, lead(md) OVER ({BY}) AS m1, coalesce(stddev_pop(md) OVER (PARTITION BY well_id), 0) AS sd FROM w)""")
def gradient_nonuniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).select("well_id", "row_id", rounded(gradient(c("tvt"), c("md"), WELL), 6).alias("gradient"))


@query(f"""SELECT well_id, row_id, {r6('azimuth')} AS azimuth, {r6(f"first_value(azimuth) OVER ({SO_FAR}) + coalesce(sum(CASE WHEN moved = -pi() AND step > 0 THEN pi() ELSE moved END) OVER ({SO_FAR}), 0)")} AS unwrapped FROM (
SELECT *, step - 2 * pi() * floor((step + pi()) / (2 * pi())) AS moved FROM (SELECT *, azimuth - lag(azimuth) OVER ({BY}) AS step FROM (
SELECT *, atan2(y - first_value(y) OVER ({SO_FAR}), x - first_value(x) OVER ({SO_FAR})) AS azimuth FROM w)))""")
def azimuth_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda v: F.first(v).over(WELL.so_far)
    rows = wells(spark, sf_dir).withColumn("azimuth", F.atan2(c("y") - first("y"), c("x") - first("x")))
    rows = rows.withColumn("step", diff(c("azimuth"), WELL))
    return rows.select("well_id", "row_id", rounded(c("azimuth")).alias("azimuth"), rounded(unwrapped(c("step"), c("azimuth"), WELL)).alias("unwrapped"))


@query(f"""SELECT well_id, row_id, {r6('x - a.x')} AS dx, {r6('y - a.y')} AS dy, {r6('z - a.z')} AS dz, {r6('sqrt((x - a.x)**2 + (y - a.y)**2)')} AS dxy,
{r6('sqrt((x - a.x)**2 + (y - a.y)**2 + (z - a.z)**2)')} AS dist_xyz, {r6('md - a.md')} AS md_since
FROM w JOIN (SELECT well_id AS wid, max_by({{'x': x, 'y': y, 'z': z, 'md': md}}, row_id) AS a FROM w WHERE tvt_input IS NOT NULL GROUP BY well_id) ON wid = well_id WHERE tvt_input IS NULL""")
def anchor_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of hidden rows from the last known row; the anchor is found in the same window pass."""
    known = F.when(c("tvt_input").isNotNull(), F.struct("x", "y", "z", "md"))
    rows = wells(spark, sf_dir).withColumn("a", F.last(known, ignorenulls=True).over(WELL.whole)).filter("tvt_input is null and a is not null")
    dx, dy, dz = (c(v) - c(f"a.{v}") for v in "xyz")
    return rows.select("well_id", "row_id", rounded(dx).alias("dx"), rounded(dy).alias("dy"), rounded(dz).alias("dz"), rounded(F.sqrt(dx * dx + dy * dy)).alias("dxy"), rounded(F.sqrt(dx * dx + dy * dy + dz * dz)).alias("dist_xyz"), rounded(c("md") - c("a.md")).alias("md_since"))


@query(f"""SELECT well_id, {r6('avg(tvt) FILTER (k <= 5)')} AS mean_last5, {r6('avg(tvt) FILTER (k <= 20)')} AS mean_last20, {r6('coalesce(regr_slope(tvt, md) FILTER (k <= 20), 0)')} AS slope_last20, {r6('median(rate) FILTER (k <= 20)')} AS median_rate20, count(*) AS known
FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_id DESC) AS k, (tvt - lag(tvt) OVER ({BY})) / nullif(md - lag(md) OVER ({BY}), 0) AS rate FROM w WHERE tvt_input IS NOT NULL) GROUP BY well_id""")
def tail_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the last known rows."""
    known = wells(spark, sf_dir).filter(c("tvt_input").isNotNull())
    known = known.withColumn("k", F.row_number().over(Window.partitionBy("well_id").orderBy(F.desc("row_id")))).withColumn("rate", slope_per(c("tvt"), c("md"), WELL))
    last = lambda v, n: F.when(c("k") <= n, c(v))
    return known.groupBy("well_id").agg(rounded(F.avg(last("tvt", 5))).alias("mean_last5"), rounded(F.avg(last("tvt", 20))).alias("mean_last20"), rounded(F.coalesce(F.regr_slope(last("tvt", 20), last("md", 20)), F.lit(0.0))).alias("slope_last20"), rounded(F.median(last("rate", 20))).alias("median_rate20"), F.count("*").alias("known"))


@query(f"""SELECT id, {r6("0.85 * p + 0.15 * avg(p) OVER (PARTITION BY regexp_extract(id, '^(.*)_([0-9]+)$', 1) ORDER BY CAST(regexp_extract(id, '^(.*)_([0-9]+)$', 2) AS BIGINT) ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")} AS smoothed
FROM (SELECT well_id || '_' || row_id AS id, tvt AS p FROM w WHERE tvt_input IS NULL)""")
def smooth_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions known by id alone: the id is split at its last underscore, and a five-row mean is blended in."""
    predictions = wells(spark, sf_dir).filter(c("tvt_input").isNull()).select(F.concat_ws("_", "well_id", "row_id").alias("id"), c("tvt").alias("p"))
    return smoothed(predictions, "id", "p", 5, 0.15).select("id", rounded(c("smoothed")).alias("smoothed"))


@query(f"""SELECT well_id, row_id, row_number() OVER (PARTITION BY well_id ORDER BY tvt DESC, row_id) AS place, rank() OVER (PARTITION BY well_id ORDER BY floor(tvt)) AS tied_rank, dense_rank() OVER (PARTITION BY well_id ORDER BY floor(tvt)) AS dense, ntile(4) OVER ({BY}) AS quarter FROM w""")
def ranking_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_value, by_floor = Window.partitionBy("well_id").orderBy(F.desc("tvt"), "row_id"), Window.partitionBy("well_id").orderBy(F.floor("tvt"))
    as_long = lambda x: x.cast("long")
    return wells(spark, sf_dir).select("well_id", "row_id", as_long(F.row_number().over(by_value)).alias("place"), as_long(F.rank().over(by_floor)).alias("tied_rank"), as_long(F.dense_rank().over(by_floor)).alias("dense"), as_long(F.ntile(4).over(WELL.window)).alias("quarter"))


_SERIES = """s0 AS (SELECT event_id, value AS v, CASE WHEN event_type <> 'error' THEN value END AS g, epoch_us(ts) / 1e6 AS t FROM events),
s AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS row_id FROM s0)"""
_NEAR = "OVER (ORDER BY row_id ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"
_AHEAD = "OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
#: Rows a range, of which a table of 10,000 events takes a few; wells of millions of rows take halo.SIZE.
_RANGE = 1024


@query(f""", {_SERIES}
SELECT event_id, row_id, {r6('avg(g) ' + _NEAR.format(30, 0))} AS mean31, round(stddev_samp(g) {_NEAR.format(50, 50)}, 6) + 0.0 AS std101, max(g) {_NEAR.format(10, 10)} AS max21, {r6('median(g) ' + _NEAR.format(8, 8))} AS median17,
coalesce(lag(v, 30) OVER (ORDER BY row_id), 0) AS lag30, coalesce(lead(v, 30) OVER (ORDER BY row_id), 0) AS lead30, round(CASE WHEN t0 IS NULL THEN (v1 - v) / nullif(t1 - t, 0) WHEN t1 IS NULL THEN (v - v0) / nullif(t - t0, 0)
 ELSE -(t1 - t) * v0 / nullif((t - t0) * (t1 - t0), 0) + ((t1 - t) - (t - t0)) * v / nullif((t - t0) * (t1 - t), 0) + (t - t0) * v1 / nullif((t1 - t) * (t1 - t0), 0) END, 6) + 0.0 AS gradient,
coalesce(last_value(g IGNORE NULLS) OVER (ORDER BY row_id), first_value(g IGNORE NULLS) {_AHEAD}) AS filled, round(sum(coalesce(v, 0)) OVER (ORDER BY row_id), 3) + 0.0 AS running
FROM (SELECT *, lag(v) OVER (ORDER BY row_id) AS v0, lead(v) OVER (ORDER BY row_id) AS v1, lag(t) OVER (ORDER BY row_id) AS t0, lead(t) OVER (ORDER BY row_id) AS t1 FROM s)""")
def one_long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series in time: numbered, rolled, differentiated, filled and summed by ranges with halos, never by one task."""
    rows = events(spark, sf_dir).select("event_id", c("value").alias("v"), F.when(c("event_type") != "error", c("value")).alias("g"), (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("t"))
    rows = staged(halo.numbered(rows, "t", ["event_id"], size=_RANGE), "series")
    order = Order((), ("row_id",))
    near = {
        "mean31": lambda o: rounded(rolling(c("g"), o.trailing(31), "mean")),
        "std101": lambda o: rounded(rolling(c("g"), o.centered(101), "std")),
        "max21": lambda o: rolling(c("g"), o.centered(21), "max"),
        "median17": lambda o: rounded(rolling(c("g"), o.centered(17), "median")),
        "lag30": lambda o: F.coalesce(F.lag("v", 30).over(o.window), F.lit(0.0)),
        "lead30": lambda o: F.coalesce(F.lead("v", 30).over(o.window), F.lit(0.0)),
        "gradient": lambda o: rounded(stepwise(c("v"), c("t"), o)),
    }
    out = halo.windowed(halo.carried(rows, order, ["g"], ["g"], ["v"], _RANGE), order, near, 50, 50, _RANGE)
    return out.select("event_id", "row_id", *near, F.coalesce("last_g", "next_g").alias("filled"), rounded(c("sum_v"), 3).alias("running"))
