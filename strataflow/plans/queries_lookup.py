"""Joins, curve lookups, probes, neighbours and post-processing as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.functions.ordered import interpolate, rolling
from strataflow.functions.scalar import clip, offset_name, rounded
from strataflow.operators import curves, post, spatial, table_functions
from strataflow.plans.wellview import BY, CURVE_SQL, POINTS_SQL, WELL, WELLS_SQL, WHOLE, curve, following_sql, points, previous_sql, r6, wells
from strataflow.sources.template import filled

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, views: str = f"{WELLS_SQL}, {CURVE_SQL}"):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = f"WITH {views} {sql}"
        return fn

    return add


def with_curve(rows: DataFrame, value: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.lookup(rows, value, curve(spark, sf_dir), "ctvt", ["cgr"], ["well_id"])


@query(f"SELECT w.well_id, row_id, {r6('gr - m')} AS above_curve_mean, k AS curve_rows FROM w LEFT JOIN (SELECT well_id, avg(cgr) AS m, count(*) AS k FROM c GROUP BY well_id) s ON s.well_id = w.well_id")
def curve_join_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = curve(spark, sf_dir).groupBy("well_id").agg(F.avg("cgr").alias("m"), F.count("*").alias("k"))
    return wells(spark, sf_dir).join(s, "well_id", "left").select("well_id", "row_id", rounded(c("gr") - c("m")).alias("above_curve_mean"), c("k").alias("curve_rows"))


@query(f"""SELECT row_number() OVER (ORDER BY CAST(well_id AS BIGINT) DESC, row_id) - 1 AS place, well_id || '_' || row_id AS id, {r6('coalesce(CASE WHEN row_id % 7 <> 0 THEN tvt END, (SELECT avg(tvt) FROM w WHERE tvt_input IS NOT NULL))')} AS tvt
FROM w WHERE tvt_input IS NULL AND CAST(well_id AS BIGINT) % 10 = 0""")
def template_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions in a template's order; ids without a prediction take the known mean."""
    rows = wells(spark, sf_dir)
    hidden = rows.filter("tvt_input is null and cast(well_id as bigint) % 10 = 0").withColumn("id", F.concat_ws("_", "well_id", "row_id"))
    # places are a well's offset, from a table of wells, and the place within the well: rows are never sorted as one
    before = Window.orderBy(F.desc(c("well_id").cast("long"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hidden.groupBy("well_id").agg(F.count("*").alias("k")).select("well_id", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    template = hidden.join(offsets, "well_id").select("id", (c("offset") + F.row_number().over(WELL.window) - 1).cast("long").alias("place"))
    predictions = hidden.filter("row_id % 7 <> 0").select("id", "tvt")
    fallback = rows.filter("tvt_input is not null").agg(F.avg("tvt").alias("fallback"))
    return filled(template, predictions, fallback, "id", "tvt").select("place", "id", rounded(c("tvt")).alias("tvt"))


@query("SELECT w.well_id, row_id, ctvt AS knot, cgr AS value FROM w ASOF LEFT JOIN c ON w.well_id = c.well_id AND w.tvt >= c.ctvt")
def curve_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last knot at or below each value."""
    found = with_curve(wells(spark, sf_dir).select("well_id", "row_id", "tvt"), "tvt", spark, sf_dir)
    return found.select("well_id", "row_id", c("lo.knot").alias("knot"), c("lo.cgr").alias("value"))


@query("SELECT w.well_id, row_id, coalesce(least(greatest(count(ctvt), 0), max(k) - 1), 0) AS insert_at FROM w LEFT JOIN (SELECT well_id, count(*) AS k FROM c GROUP BY well_id) s ON s.well_id = w.well_id LEFT JOIN c ON c.well_id = w.well_id AND c.ctvt < w.tvt GROUP BY w.well_id, row_id")
def insert_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each value would be inserted among the knots, within the curve."""
    found = with_curve(wells(spark, sf_dir).select("well_id", "row_id", "tvt"), "tvt", spark, sf_dir)
    k = curve(spark, sf_dir).groupBy("well_id").agg(F.count("*").alias("k"))
    return found.join(k, "well_id", "left").select("well_id", "row_id", F.coalesce(F.least(c("below"), c("k") - 1), F.lit(0).cast("long")).alias("insert_at"))


def _linear_sql(value: str, clamp: bool = True) -> str:
    inside = f"CASE WHEN lo.ctvt = hi.ctvt THEN lo.cgr ELSE lo.cgr + (hi.cgr - lo.cgr) * ({value} - lo.ctvt) / (hi.ctvt - lo.ctvt) END"
    return f"coalesce({inside}, lo.cgr, hi.cgr)" if clamp else f"CASE WHEN lo.ctvt IS NOT NULL AND hi.ctvt IS NOT NULL THEN {inside} END"


_BOTH = "w ASOF LEFT JOIN c lo ON w.well_id = lo.well_id AND w.tvt >= lo.ctvt ASOF LEFT JOIN c hi ON w.well_id = hi.well_id AND w.tvt <= hi.ctvt"


@query(f"SELECT w.well_id, row_id, {r6(_linear_sql('tvt'))} AS on_curve, {r6(_linear_sql('tvt', False))} AS strictly_inside FROM {_BOTH}")
def curve_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise-linear lookup, with the end knots beyond the curve, and with NULL there."""
    found = with_curve(wells(spark, sf_dir).select("well_id", "row_id", "tvt"), "tvt", spark, sf_dir)
    return found.select("well_id", "row_id", rounded(curves.linear(c("tvt"), "cgr")).alias("on_curve"), rounded(curves.linear(c("tvt"), "cgr", False)).alias("strictly_inside"))


_ANCHOR = "a AS (SELECT well_id, max_by(tvt_input, row_id) AS anchor FROM w WHERE tvt_input IS NOT NULL GROUP BY well_id)"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).filter("tvt_input is not null").groupBy("well_id").agg(F.max_by("tvt_input", "row_id").alias("anchor"))


@query(f""", {_ANCHOR}, ch AS (SELECT * FROM (SELECT *, floor(cgr / 50) AS code, lag(floor(cgr / 50)) OVER (PARTITION BY well_id ORDER BY ctvt) AS before FROM c) WHERE before IS NOT NULL AND code <> before)
SELECT a.well_id, {r6('anchor - max(ctvt) FILTER (ctvt <= anchor)')} AS prev_distance, {r6('min(ctvt) FILTER (ctvt > anchor) - anchor')} AS next_distance, {r6('min(ctvt) FILTER (ctvt > anchor) - max(ctvt) FILTER (ctvt <= anchor)')} AS thickness FROM a LEFT JOIN ch ON ch.well_id = a.well_id GROUP BY a.well_id, anchor""")
def boundary_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from the anchor to the nearest changes of the curve's class on either side."""
    ch = curves.changes(curve(spark, sf_dir), "ctvt", F.floor(c("cgr") / 50), ["well_id"])
    both = anchors(spark, sf_dir).join(ch, "well_id", "left").groupBy("well_id", "anchor").agg(F.max(F.when(c("ctvt") <= c("anchor"), c("ctvt"))).alias("p"), F.min(F.when(c("ctvt") > c("anchor"), c("ctvt"))).alias("q"))
    return both.select("well_id", rounded(c("anchor") - c("p")).alias("prev_distance"), rounded(c("q") - c("anchor")).alias("next_distance"), rounded(c("q") - c("p")).alias("thickness"))


@query(f", {_ANCHOR} SELECT a.well_id, count(ctvt) AS knots_near, {r6('avg(cgr)')} AS mean_near FROM a LEFT JOIN c ON c.well_id = a.well_id AND abs(ctvt - anchor) <= 20 GROUP BY a.well_id")
def range_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knots within 20 of the anchor. The join is on the well; the range is a filter on its few knots."""
    near = F.abs(c("ctvt") - c("anchor")) <= 20
    both = anchors(spark, sf_dir).join(curve(spark, sf_dir), "well_id", "left")
    return both.groupBy("well_id").agg(F.count(F.when(near, c("ctvt"))).alias("knots_near"), rounded(F.avg(F.when(near, c("cgr")))).alias("mean_near"))


_KNOWN_AT = "CASE WHEN gr IS NOT NULL THEN row_id END"
#: The signal without gaps: linear between known values, the nearest at the ends.
_SIGNAL = f"""gaps AS (SELECT *, {previous_sql('gr')} AS g0, {following_sql('gr')} AS g1, {previous_sql(_KNOWN_AT)} AS p0, {following_sql(_KNOWN_AT)} AS p1 FROM w),
sg AS (SELECT *, coalesce(gr, g0 + (g1 - g0) * (row_id - p0) / nullif(p1 - p0, 0), g0, g1) AS signal FROM gaps)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells(spark, sf_dir).withColumn("signal", interpolate(c("gr"), WELL, c("row_id")))


#: Offsets of the probes around the anchor.
_OFFSETS = (-80, -40, -20, -10, -5, 0, 5, 10, 20, 40, 80)


@query(f""", {_ANCHOR}, {_SIGNAL}, o AS (SELECT a.well_id, off, anchor + off AS v FROM a, (SELECT unnest([{', '.join(map(str, _OFFSETS))}]) AS off)),
l AS (SELECT o.well_id, off, {_linear_sql('v')} AS g FROM o ASOF LEFT JOIN c lo ON o.well_id = lo.well_id AND o.v >= lo.ctvt ASOF LEFT JOIN c hi ON o.well_id = hi.well_id AND o.v <= hi.ctvt),
pv AS (SELECT well_id, {', '.join(f'max(g) FILTER (off = {o}) AS g_{offset_name(o)}' for o in _OFFSETS)} FROM l GROUP BY well_id)
SELECT sg.well_id, row_id, {', '.join(r6(f'signal - g_{offset_name(o)}') + f' AS diff_{offset_name(o)}' for o in _OFFSETS)} FROM sg JOIN pv ON pv.well_id = sg.well_id WHERE tvt_input IS NULL""")
def offset_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal minus the curve at fixed offsets from the anchor: offsets are looked up once a well, then joined to its rows."""
    asked = anchors(spark, sf_dir).withColumn("off", F.explode(F.array(*map(F.lit, _OFFSETS)))).withColumn("v", c("anchor") + c("off"))
    found = with_curve(asked, "v", spark, sf_dir).withColumn("g", curves.linear(c("v"), "cgr"))
    wide = found.groupBy("well_id").agg(*(F.max(F.when(c("off") == o, c("g"))).alias(f"g_{offset_name(o)}") for o in _OFFSETS))
    hidden = signals(spark, sf_dir).filter("tvt_input is null")
    return hidden.join(wide, "well_id").select("well_id", "row_id", *(rounded(c("signal") - c(f"g_{offset_name(o)}")).alias(f"diff_{offset_name(o)}") for o in _OFFSETS))


#: End offsets of the candidate paths.
_ENDS = (-100, -80, -60, -45, -30, -20, -12, 0, 12, 20, 30, 45, 60, 80, 100)


@query(f""", {_ANCHOR}, {_SIGNAL}, h AS (SELECT sg.well_id, row_id, anchor, (row_number() OVER (PARTITION BY sg.well_id ORDER BY row_id) - 1) / CAST(greatest(count(*) OVER (PARTITION BY sg.well_id) - 1, 1) AS DOUBLE) AS f, signal FROM sg JOIN a USING (well_id) WHERE tvt_input IS NULL),
o AS (SELECT *, anchor + e * (3 * f * f - 2 * f * f * f) AS v FROM h, (SELECT unnest([{', '.join(map(str, _ENDS))}]) AS e)),
l AS (SELECT o.well_id, row_id, e, f, abs(signal - {_linear_sql('v')}) AS d FROM o ASOF LEFT JOIN c lo ON o.well_id = lo.well_id AND o.v >= lo.ctvt ASOF LEFT JOIN c hi ON o.well_id = hi.well_id AND o.v <= hi.ctvt)
SELECT well_id, row_id, {r6('list_sort(list(d))[1]')} AS best, {r6('list_sort(list(d))[2] - list_sort(list(d))[1]')} AS gap, {r6('sum(exp(-least(d, 100) / 8) * e) / greatest(sum(exp(-least(d, 100) / 8)), 1e-9)')} AS soft_endpoint FROM l GROUP BY well_id, row_id""")
def path_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate paths that ease from the anchor to an end offset: the best fit, its lead, and the weighted end."""
    hidden = signals(spark, sf_dir).filter("tvt_input is null").join(anchors(spark, sf_dir), "well_id")
    place, n = F.row_number().over(WELL.window) - 1, F.count("*").over(WELL.whole)
    h = hidden.withColumn("f", place / F.greatest(n - 1, F.lit(1))).select("well_id", "row_id", "anchor", "f", "signal")
    ease = 3 * c("f") * c("f") - 2 * c("f") * c("f") * c("f")
    asked = h.withColumn("e", F.explode(F.array(*map(F.lit, _ENDS)))).withColumn("v", c("anchor") + c("e") * ease)
    found = with_curve(asked, "v", spark, sf_dir).withColumn("d", F.abs(c("signal") - curves.linear(c("v"), "cgr")))
    weight = F.exp(-F.least(c("d"), F.lit(100.0)) / 8)
    out = found.groupBy("well_id", "row_id").agg(F.array_sort(F.collect_list("d")).alias("ds"), (F.sum(weight * c("e")) / F.greatest(F.sum(weight), F.lit(1e-9))).alias("soft"))
    return out.select("well_id", "row_id", rounded(c("ds")[0]).alias("best"), rounded(c("ds")[1] - c("ds")[0]).alias("gap"), rounded(c("soft")).alias("soft_endpoint"))


_KNN = """n AS (SELECT a.pid AS qid, a.px AS qx, a.py AS qy, b.pid, b.px, b.py, b.surface, sqrt((a.px - b.px)**2 + (a.py - b.py)**2) AS d FROM p a JOIN p b ON a.pid <> b.pid),
k AS (SELECT *, 1 / (d + 1e-3) AS w FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, pid) AS r FROM n) WHERE r <= 10),
s AS (SELECT qid, any_value(qx) AS qx, any_value(qy) AS qy, sum(w * surface) / sum(w) AS idw, min(d) AS nearest, sum(w*(px-qx)*(px-qx)) + 1e-9 AS xx, sum(w*(px-qx)*(py-qy)) AS xy, sum(w*(py-qy)*(py-qy)) + 1e-9 AS yy,
 sum(w*(px-qx)) AS x1, sum(w*(py-qy)) AS y1, sum(w) + 1e-9 AS w1, sum(w*(px-qx)*surface) AS xv, sum(w*(py-qy)*surface) AS yv, sum(w*surface) AS v1 FROM k GROUP BY qid)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return spatial.nearest(p.select(c("pid").alias("qid"), c("px").alias("x"), c("py").alias("y")), p.select("pid", c("px").alias("x"), c("py").alias("y"), c("surface").alias("value")), 10)


@query(f", {_KNN} SELECT k.qid, {r6('any_value(idw)')} AS idw, {r6('sqrt(sum(w * (surface - idw)**2) / sum(w))')} AS idw_std, {r6('any_value(nearest)')} AS nearest FROM k JOIN s ON s.qid = k.qid GROUP BY k.qid", f"{POINTS_SQL}")
def knn_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-distance mean of the ten nearest points."""
    return spatial.inverse_distance(_found(spark, sf_dir)).select("qid", rounded(c("idw")).alias("idw"), rounded(c("idw_std")).alias("idw_std"), rounded(c("nearest")).alias("nearest"))


@query(f""", {_KNN}, f AS (SELECT *, xx*(yy*w1 - y1*y1) - xy*(xy*w1 - y1*x1) + x1*(xy*y1 - yy*x1) AS det, xx*(yy*v1 - yv*y1) - xy*(xy*v1 - yv*x1) + xv*(xy*y1 - yy*x1) AS top FROM s)
SELECT qid, round(greatest(-500, least(509, CASE WHEN abs(det) > 1e-12 AND abs(top / det - idw) <= 200 THEN top / det ELSE idw END)), 5) + 0.0 AS surface FROM f""", f"{POINTS_SQL}")
def knn_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted plane through the ten nearest points, with the inverse-distance mean as its guard."""
    p = points(spark, sf_dir)
    found = spatial.inverse_distance(_found(spark, sf_dir)).join(p.select(c("pid").alias("qid"), c("px").alias("qx"), c("py").alias("qy")), "qid")
    lo, hi = p.agg(F.min("surface"), F.max("surface")).first()
    return spatial.plane(found, {"value": (lo, hi)}).select("qid", rounded(c("surface_value"), 5).alias("surface"))


_RESIDUAL = f"""rr AS (SELECT well_id, row_id, md - last_value(CASE WHEN tvt_input IS NOT NULL THEN md END IGNORE NULLS) OVER ({WHOLE}) AS since, tvt - last_value(tvt_input IGNORE NULLS) OVER ({WHOLE}) AS target,
 tvt_input, avg(tvt) OVER ({BY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - last_value(tvt_input IGNORE NULLS) OVER ({WHOLE}) AS residual FROM w),
r AS (SELECT * FROM rr WHERE tvt_input IS NULL)"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden rows with a stand-in prediction of the residual: a five-row mean against the anchor."""
    anchor = F.last("tvt_input", ignorenulls=True).over(WELL.whole)
    at = F.last(F.when(c("tvt_input").isNotNull(), c("md")), ignorenulls=True).over(WELL.whole)
    rows = wells(spark, sf_dir).withColumns({"since": c("md") - at, "target": c("tvt") - anchor, "residual": rolling(c("tvt"), WELL.centered(5), "mean") - anchor})
    return rows.filter("tvt_input is null")


_ALPHAS, _TAUS = (0.6, 0.8, 1.0, 1.2), (0.0, 1e4, 1e5, 1e6)


@query(f""", {_RESIDUAL} SELECT alpha, tau, {r6('sqrt(avg((target - alpha * residual * CASE WHEN tau = 0 THEN 1 ELSE 1 - exp(-since / tau) END)**2))')} AS rmse FROM r, (SELECT CAST(unnest([{', '.join(map(str, _ALPHAS))}]) AS DOUBLE) AS alpha), (SELECT CAST(unnest([{', '.join(map(str, _TAUS))}]) AS DOUBLE) AS tau) GROUP BY alpha, tau""")
def pp_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of every damping of the residual, in one scan."""
    return post.grid_search(residuals(spark, sf_dir), "residual", "target", "since", _ALPHAS, _TAUS).select("alpha", "tau", rounded(c("rmse")).alias("rmse"))


@query(f", {_RESIDUAL} SELECT well_id, row_id, {r6('0.9 * residual * (1 - exp(-since / 10000.0))')} AS decayed, {r6('greatest((SELECT quantile_cont(residual, 0.003) FROM r), least((SELECT quantile_cont(residual, 0.997) FROM r), residual))')} AS clipped FROM r")
def decay_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.quantile_clip(residuals(spark, sf_dir), "residual", 0.003, 0.997)
    return rows.select("well_id", "row_id", rounded(post.decayed(c("residual"), c("since"), 0.9, 10000.0)).alias("decayed"), rounded(c("clipped")).alias("clipped"))


@query(f""", {_RESIDUAL}, q AS (SELECT *, row_id / 100.0 AS f, residual / 50 AS cr FROM r)
SELECT well_id, row_id, {r6('''least(1.0, greatest(0.55, 0.88 + 0.08 * least(1.0, greatest(-0.5, cr)) - 0.12 * least(1.0, greatest(0.0, (0.5 - 0.30) / 0.45)) + 0.08 * least(1.0, greatest(0.0, abs(target) / 8)) + 0.05 * least(1.0, greatest(0.0, abs(residual) / 8))
 - 0.10 * least(1.0, greatest(0.0, (abs(target) - 6) / 18)) - 0.05 * least(1.0, greatest(0.0, abs(cr) / 0.2)) + 0.04 * sin(pi() * least(1.0, greatest(0.0, f)))))''')} AS gate,
round(0.94 * residual + 0.06 * coalesce(target * (3 * least(f, 1)**2 - 2 * least(f, 1)**3), 0), 9) + 0.0 AS blended FROM q""")
def gate_and_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residuals(spark, sf_dir)
    f, cr = c("row_id") / 100.0, c("residual") / 50
    gate = post.confidence_gate(cr, F.lit(0.5), F.abs("target"), F.abs("target"), F.abs("residual"), cr, f)
    return rows.select("well_id", "row_id", rounded(gate).alias("gate"), rounded(post.prior_blend(c("residual"), c("target"), f), 9).alias("blended"))


@query(f""", {_ANCHOR}, sl AS (SELECT well_id, CASE WHEN count(*) < 2 OR stddev_pop(md) < 1e-6 THEN 0 ELSE regr_slope(tvt, md) END AS slope, max(md) AS m0, count(*) AS n FROM w WHERE tvt_input IS NOT NULL GROUP BY well_id)
SELECT w.well_id, row_id, {r6('anchor + slope * (md - m0)')} AS on_slope, {r6('(1 - least(greatest(sl.n / 200.0, 0), 0.6)) * x + least(greatest(sl.n / 200.0, 0), 0.6) * y')} AS hybrid, {r6('-z + x + anchor')} AS from_surface
FROM w JOIN a ON a.well_id = w.well_id JOIN sl ON sl.well_id = w.well_id WHERE tvt_input IS NULL""")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight continuation, a blend of two signals by the known length, and an estimate from a surface."""
    flat = (F.count("*") < 2) | (F.stddev_pop("md") < 1e-6)
    known = wells(spark, sf_dir).filter("tvt_input is not null")
    s = known.groupBy("well_id").agg(F.when(flat, 0.0).otherwise(F.regr_slope("tvt", "md")).alias("slope"), F.max("md").alias("m0"), F.count("*").alias("known"), F.max_by("tvt_input", "row_id").alias("anchor"))
    trust = clip(c("known") / 200.0, 0.0, 0.6)
    rows = wells(spark, sf_dir).filter("tvt_input is null").join(s, "well_id")
    return rows.select("well_id", "row_id", rounded(c("anchor") + c("slope") * (c("md") - c("m0"))).alias("on_slope"), rounded((1 - trust) * c("x") + trust * c("y")).alias("hybrid"), rounded(-c("z") + c("x") + c("anchor")).alias("from_surface"))


@query(f""", g AS (SELECT well_id, min(ctvt) AS lo, max(ctvt) AS hi FROM c GROUP BY well_id), o AS (SELECT well_id, i, lo + i * 2.0 AS v FROM (SELECT well_id, lo, unnest(generate_series(0, CAST(ceil((hi - lo) / 2.0) AS BIGINT))) AS i FROM g))
SELECT o.well_id, i, {r6('v')} AS tvt, {r6(_linear_sql('v'))} AS gr FROM o ASOF LEFT JOIN c lo ON o.well_id = lo.well_id AND o.v >= lo.ctvt ASOF LEFT JOIN c hi ON o.well_id = hi.well_id AND o.v <= hi.ctvt""")
def regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve resampled at steps of 2 from its start to past its end."""
    ends = curve(spark, sf_dir).groupBy("well_id").agg(F.min("ctvt").alias("a"), F.max("ctvt").alias("b"))
    asked = ends.select("well_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((c("b") - c("a")) / 2.0))).alias("i"), "a").withColumn("v", c("a") + c("i") * 2.0).drop("a")
    return with_curve(asked, "v", spark, sf_dir).select("well_id", "i", rounded(c("v")).alias("tvt"), rounded(curves.linear(c("v"), "cgr")).alias("gr"))


@query(f"SELECT w.well_id, {r6('CASE WHEN count(*) < 20 THEN 30 ELSE least(60, greatest(10, stddev_pop(gr - ' + _linear_sql('tvt_input') + '))) END')} AS noise FROM {_BOTH.replace('w.tvt ', 'w.tvt_input ')} WHERE w.tvt_input IS NOT NULL AND gr IS NOT NULL GROUP BY w.well_id")
def noise_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of the signal from the curve over a well's known rows, within 10 and 60; 30 below 20 points."""
    rows = wells(spark, sf_dir).filter("tvt_input is not null and gr is not null").select("well_id", "row_id", "tvt_input", "gr")
    d = c("gr") - curves.linear(c("tvt_input"), "cgr")
    found = with_curve(rows, "tvt_input", spark, sf_dir)
    return found.groupBy("well_id").agg(rounded(F.when(F.count("*") < 20, 30.0).otherwise(clip(F.stddev_pop(d), 10.0, 60.0))).alias("noise"))


@query("SELECT n_regionkey, count(*) AS nations FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) GROUP BY n_regionkey")
def semi_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership as a semi-join."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rich = read("customer").filter("c_acctbal > 9000").select(c("c_nationkey").alias("n_nationkey"))
    return read("nation").join(rich, "n_nationkey", "left_semi").groupBy("n_regionkey").agg(F.count("*").alias("nations"))


def probes_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offset_probes as SQL text that calls a table function."""
    table_functions.register(spark)
    rows = signals(spark, sf_dir).filter("tvt_input is null").join(anchors(spark, sf_dir), "well_id")
    sql = f"""SELECT well_id, row_id, {', '.join(f"round(max(CASE WHEN off = {o} THEN diff END), 6) + 0.0D AS diff_{offset_name(o)}" for o in _OFFSETS)} FROM curve_probes(
 TABLE(SELECT well_id, row_id, signal, anchor, CAST(NULL AS DOUBLE) AS ctvt, CAST(NULL AS DOUBLE) AS cgr FROM {{rows}} UNION ALL SELECT well_id, NULL, NULL, NULL, ctvt, cgr FROM {{knots}}) PARTITION BY (well_id),
 array({', '.join(f'{o}D' for o in _OFFSETS)})) GROUP BY well_id, row_id"""
    return spark.sql(sql, rows=rows, knots=curve(spark, sf_dir))


def grid_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """regular_grid as SQL text that calls a table function."""
    table_functions.register(spark)
    return spark.sql("SELECT well_id, i, round(tvt, 6) + 0.0D AS tvt, round(gr, 6) + 0.0D AS gr FROM resampled(TABLE({knots}) PARTITION BY (well_id) ORDER BY (ctvt), 2.0D)", knots=curve(spark, sf_dir))


QUERIES |= {"probes_by_sql": probes_by_sql, "grid_by_sql": grid_by_sql}
ORACLES |= {"probes_by_sql": ORACLES["offset_probes"], "grid_by_sql": ORACLES["regular_grid"]}
