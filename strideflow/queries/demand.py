"""Queries over demand, matrices, trip lengths and counters."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideflow.operators.nearness import pairs_within, regions_of_points
from strideflow.plans import demand as D
from strideflow.plans.lineage import shared_folder
from strideflow.plans.numbering import running
from strideflow.queries.data import _IN
from strideflow.sources.tables import read_table
from strideflow.streaming.landing import land, landed

R = lambda c, n=4: F.round(c, n)
_CUT = "2024-02-15"


def _od(s, d):
    return D.od_demand(D.trips(s, d))


def d01_od_demand(s, d):
    return _od(s, d).select(*D.KEYS, R("demand").alias("demand"))


def b30_demand_threshold(s, d):
    return D.threshold(_od(s, d), 5.0).select(*D.KEYS, R("demand").alias("demand"))


def _ids(s, d):
    ids = read_table(s, d, "centroids", ["centroid_id"]).where("centroid_id is not null").distinct()
    return running(ids, ["centroid_id"], name="n").select(F.col("centroid_id").alias("id"), (F.col("n") - 1).alias("position"))


def c02_placed_demand(s, d):
    """Demand by the positions of its zones among the centroids."""
    return D.place(_od(s, d), _ids(s, d)).select("o_pos", "d_pos", R("demand").alias("demand"))


def c02_dropped_demand(s, d):
    """Demand with an end that is no centroid, by which end it is."""
    ids = read_table(s, d, "centroids", ["centroid_id"]).distinct()
    od = _od(s, d)
    o = od.join(ids, od.origin == ids.centroid_id, "left_anti").agg(F.count("*").alias("pairs"), R(F.sum("demand"), 4).alias("demand")).withColumn("end", F.lit("origin"))
    e = od.join(ids, od.destination == ids.centroid_id, "left_anti").agg(F.count("*").alias("pairs"), R(F.sum("demand"), 4).alias("demand")).withColumn("end", F.lit("destination"))
    return o.unionByName(e)


def c03_aligned(s, d):
    """The demand between every third centroid, as a matrix over just these."""
    ids = read_table(s, d, "centroids", ["centroid_id"]).where("centroid_id % 3 = 0").distinct()
    od = _od(s, d)
    return od.join(ids.withColumnRenamed("centroid_id", "origin"), "origin", "left_semi").join(ids.withColumnRenamed("centroid_id", "destination"), "destination", "left_semi").select(*D.KEYS, R("demand").alias("demand"))


def _two(s, d):
    t = D.trips(s, d)
    return D.od_lengths(t.where(F.col("run_date") < _CUT)), D.od_lengths(t.where(F.col("run_date") >= _CUT))


def c04_overlay(s, d):
    """Earlier runs' mean lengths with the later runs' laid over them where within 20 km."""
    base, model = _two(s, d)
    return D.overlay(base, model, "length_m", 20_000.0).select(*D.KEYS, R("length_m", 2).alias("length_m"), "replaced")


def g10_two_tiers(s, d):
    """Later runs' pairs where there are any, else the earlier runs'."""
    far, near = _two(s, d)
    return D.stitch(near, far, "length_m").select(*D.KEYS, R("length_m", 2).alias("length_m"), "tier")


def g11_run_difference(s, d):
    a, b = _two(s, d)
    return D.difference(a, b, "demand").select(*D.KEYS, R("difference").alias("difference"))


def d42_matrix_compare(s, d):
    a, b = _two(s, d)
    return D.compare(a, b, "length_m", 100.0).select("mismatched", "compared", R("max_difference", 2).alias("max_difference"), "apart")


def d21_matrix_summary(s, d):
    return D.summary(D.od_lengths(D.trips(s, d)), "length_m", 0).select("pairs", *[R(c, 2).alias(c) for c in ("least", "median", "largest")])


def g09_far_demand(s, d):
    """Demand that isn't within one zone."""
    return _od(s, d).where("origin <> destination").select(*D.KEYS, R("demand").alias("demand"))


def j02_diagonal(s, d):
    return _od(s, d).where("origin = destination").select("origin", R("demand").alias("demand"))


def j04_sums(s, d):
    """Every zone's demand as origin and as destination."""
    od = _od(s, d)
    o = od.groupBy(F.col("origin").alias("zone")).agg(F.sum("demand").alias("as_origin"))
    e = od.groupBy(F.col("destination").alias("zone")).agg(F.sum("demand").alias("as_destination"))
    return o.join(e, "zone", "full_outer").select("zone", R(F.coalesce("as_origin", F.lit(0.0)), 4).alias("as_origin"), R(F.coalesce("as_destination", F.lit(0.0)), 4).alias("as_destination"))


def f01_top_zones(s, d):
    """The ten origins and the ten destinations with the most demand."""
    od = _od(s, d)
    out = None
    for end in D.KEYS:
        t = od.groupBy(F.col(end).alias("zone")).agg(F.sum("demand").alias("x")).where("x > 0").orderBy(F.desc("x"), "zone").limit(10).select(F.lit(end).alias("end"), "zone", R("x", 4).alias("demand"))
        out = t if out is None else out.unionByName(t)
    return out


def f02_pairs_by_demand(s, d):
    """The heaviest pair of every origin."""
    w = F.max(F.struct("demand", (-F.col("destination")).alias("k"))).alias("m")
    return _od(s, d).groupBy("origin").agg(w).select("origin", (-F.col("m.k")).alias("destination"), R("m.demand").alias("demand"))


def f10_scale_quantile(s, d):
    """The value at which a colour scale ends: the 0.995 quantile of what is above zero."""
    return _od(s, d).agg(R(F.expr("percentile(demand, 0.995)"), 4).alias("q995"))


def a17_origin_totals(s, d):
    """Each origin's demand by the weekday's matrix."""
    t = D.trips(s, d).where("demand > 0").withColumn("m", F.when(F.weekday("run_date") >= 5, "weekend").otherwise("weekday"))
    p = t.groupBy("origin").pivot("m", ["weekday", "weekend"]).agg(F.sum("demand"))
    return p.select("origin", R(F.coalesce("weekday", F.lit(0.0)), 4).alias("weekday"), R(F.coalesce("weekend", F.lit(0.0)), 4).alias("weekend"))


def a39_trip_lengths(s, d):
    """Demand-weighted mean length and share without a path, by run date."""
    t = D.trips(s, d).where("demand > 0")
    got = F.when(F.col("length_m").isNotNull(), F.col("demand"))
    return t.groupBy("run_date").agg(R(F.sum(got * F.col("length_m")) / F.sum(got), 3).alias("mean_m"), R(F.sum(F.when(F.col("length_m").isNull(), F.col("demand")).otherwise(0.0)) / F.sum("demand"), 6).alias("unreached"))


def d31_person_km(s, d):
    return D.trips(s, d).where("demand > 0 and length_m is not null").groupBy(F.month("run_date").alias("month")).agg(R(F.sum(F.col("demand") * F.col("length_m")) / 1000, 1).alias("person_km"), R(F.sum("demand"), 4).alias("trips"))


def d19_logsum(s, d):
    """Each origin's logsum of its trips' lengths in kilometres, and their plain demand-weighted mean."""
    t = D.trips(s, d).where("demand > 0 and length_m is not null").withColumn("km", F.col("length_m") / 1000)
    mean = F.sum(F.col("demand") * F.exp(-0.2 * F.col("km"))) / F.sum("demand")
    return t.groupBy("origin").agg(R(-F.log(F.greatest(mean, F.lit(1e-300))) / 0.2, 5).alias("logsum_km"), R(F.sum(F.col("demand") * F.col("km")) / F.sum("demand"), 5).alias("mean_km"))


def d20_reachable_gate(s, d):
    """Origins of whose demand at least nine tenths have a path, with that share."""
    t = D.trips(s, d).where("demand > 0")
    share = F.sum(F.when(F.col("length_m").isNotNull(), F.col("demand")).otherwise(0.0)) / F.sum("demand")
    return t.groupBy("origin").agg(share.alias("share")).where(F.col("share") >= 0.9 - 1e-9).select("origin", R("share", 6).alias("share"))


def _zone_municipality(s, d):
    """The municipality around the smallest position of each centroid."""
    c = read_table(s, d, "centroids", ["centroid_id", "x", "y"]).where("x is not null and y is not null").groupBy("centroid_id").agg(F.min(F.struct("x", "y")).alias("p")).select("centroid_id", "p.x", "p.y")
    return regions_of_points(c, "centroid_id", read_table(s, d, "municipality_polygons", ["municipality_id", "rings"]), "municipality_id").select(F.col("id").alias("origin"), F.col("region").alias("municipality_id"))


def d35_length_histogram(s, d):
    """Trip lengths in eight bins for every municipality and for the country; trips from elsewhere count for the country."""
    t = D.trips(s, d).where("demand > 0 and length_m is not null").join(_zone_municipality(s, d), "origin", "left")
    binned = t.select("municipality_id", D.bin_of(F.col("length_m")).alias("bin"), "demand", "length_m")
    g = binned.groupingSets([["municipality_id", "bin"], ["bin"]], "municipality_id", "bin").agg(F.sum("demand").alias("t"), (F.sum(F.col("demand") * F.col("length_m")) / F.sum("demand") / 1000).alias("km"), F.grouping("municipality_id").alias("whole"))
    return g.where("whole = 1 or municipality_id is not null").select("municipality_id", "bin", R("t", 4).alias("trips"), R("km", 4).alias("mean_km"))


def d34_share_fit(s, d):
    """Line of the share of short trips on the mean length over municipalities: slope, intercept, r2 plain and weighted by trips."""
    t = D.trips(s, d).where("demand > 0 and length_m is not null").join(_zone_municipality(s, d), "origin")
    m = t.groupBy("municipality_id").agg((F.sum(F.col("demand") * F.col("length_m")) / F.sum("demand") / 1000).alias("x"), (F.sum(F.when(F.col("length_m") < 3000, F.col("demand")).otherwise(0.0)) / F.sum("demand")).alias("y"), F.sum("demand").alias("w"))
    a = m.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), *[F.sum(e).alias(k) for k, e in {"sw": F.col("w"), "sx": F.col("w") * F.col("x"), "sy": F.col("w") * F.col("y"), "sxx": F.col("w") * F.col("x") ** 2, "syy": F.col("w") * F.col("y") ** 2, "sxy": F.col("w") * F.col("x") * F.col("y")}.items()])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")
    r2w = cov * cov / ((F.col("sxx") - F.col("sx") ** 2 / F.col("sw")) * (F.col("syy") - F.col("sy") ** 2 / F.col("sw")))
    return a.where("n >= 3").select("n", R("slope", 6).alias("slope"), R("intercept", 6).alias("intercept"), R("r2", 6).alias("r2"), R(r2w, 6).alias("r2_weighted"))


def c28_placed_share(s, d):
    """Share of the demand whose origin lies in a municipality."""
    t = _od(s, d).join(_zone_municipality(s, d), "origin", "left")
    return t.agg(R(F.sum(F.when(F.col("municipality_id").isNotNull(), F.col("demand")).otherwise(0.0)) / F.sum("demand"), 6).alias("placed"))


def a31_zone_radius(s, d):
    """Area, radius of the disc of equal area and mean distance within it of every municipality."""
    t = read_table(s, d, "municipality_polygons", ["municipality_id", "rings"])
    cross = lambda r: F.aggregate(F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s_, v: s_ + v)
    ring = t.select("municipality_id", F.posexplode("rings").alias("k", "ring"))
    area = ring.groupBy("municipality_id").agg(F.sum(F.abs(cross(F.col("ring"))) / 2 * F.when(F.col("k") == 0, 1).otherwise(-1)).alias("a"))
    r = F.sqrt(F.col("a") / F.pi())
    return area.select("municipality_id", R("a", 0).alias("area_m2"), R(r, 2).alias("radius_m"), R(r * D.DISC_MEAN, 2).alias("within_m"))


# -------------------------------------------------------------- counters


def _days(s, d):
    t = read_table(s, d, "observed", ["obs_id", "city", "counter_name", "obs_date", "bikes"])
    once = t.groupBy("obs_id").agg(F.first("city").alias("city"), F.first("counter_name").alias("counter_name"), F.first("obs_date").alias("day"), F.first(D.known("bikes")).alias("bikes"))
    return once.withColumn("name", name_key(F.col("counter_name"))).where("name <> '' and day is not null and bikes is not null")


def name_key(c):
    """A counter's name without outer blanks and a trailing PP, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"(?i)\s*PP$", "")))


def h03_name_keys(s, d):
    t = read_table(s, d, "observed", ["counter_name"]).where("counter_name is not null").distinct()
    return t.select("counter_name", name_key(F.col("counter_name")).alias("name"))


def a30_daily_counts(s, d):
    """Bikes a day and counter, several observations of one day added up."""
    return _days(s, d).groupBy("name", "day").agg(F.sum("bikes").alias("bikes"), F.count("*").alias("observations"))


def d36_annual_average(s, d):
    """Mean of a counter's days of 2023 above zero, days without one taken from 2022."""
    day = _days(s, d).groupBy("name", "day").agg(F.sum("bikes").alias("bikes")).where("bikes > 0 and day between '2022-01-01' and '2023-12-31' and not (month(day) = 2 and day(day) = 29)")
    slot = day.groupBy("name", F.month("day").alias("m"), F.dayofmonth("day").alias("dm")).agg(F.max_by("bikes", F.year("day")).alias("bikes"))
    return slot.groupBy("name").agg(R(F.avg("bikes"), 4).alias("bikes"), F.count("*").alias("days"))


def c25_counters_observed(s, d):
    """Counters with the observed mean of the same name."""
    lines = read_table(s, d, "count_lines", ["line_id", "city", "counter"]).withColumn("name", name_key(F.col("counter")))
    seen = _days(s, d).groupBy("name").agg(F.avg("bikes").alias("observed"))
    return lines.join(seen, "name").select("line_id", "city", "counter", R("observed", 4).alias("observed"))


def c27_missing_counters(s, d):
    """Counters that no observation names exactly."""
    lines = read_table(s, d, "count_lines", ["line_id", "counter"]).withColumn("name", name_key(F.col("counter")))
    return lines.join(_days(s, d).select("name").distinct(), "name", "left_anti").select("line_id", "counter")


def d38_counter_places(s, d):
    """Every counter name's first known place in order of the observations."""
    t = read_table(s, d, "observed", ["obs_id", "counter_name", "x", "y"]).where("x is not null and y is not null and not isnan(x) and not isnan(y)").withColumn("name", name_key(F.col("counter_name")))
    return t.where("name <> ''").groupBy("name").agg(F.min(F.struct("obs_id", "x", "y")).alias("p")).select("name", "p.x", "p.y")


def d37_near_counters(s, d):
    """Pairs of count lines whose first points are within 1.1 km."""
    t = read_table(s, d, "count_lines", ["line_id", "geometry"]).select("line_id", F.element_at("geometry", 1)["x"].alias("x"), F.element_at("geometry", 1)["y"].alias("y"))
    return pairs_within(t, "line_id", 1100.0)


def a37_streamed_observations(s, d):
    """Observations a day through a stream: landed batch by batch, repeated deliveries once."""
    kind = read_table(s, d, "observed", ["obs_id", "received_at", "obs_date"]).schema
    path = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    land(s.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(f"{d}/observed.parque[t]"), f"{path}/rows", f"{path}/checkpoint")
    return landed(s, f"{path}/rows", "obs_id", "received_at").groupBy("obs_date").agg(F.count("*").alias("observations"))


def h11_days(s, d):
    """Observation dates, the same day of 2022, and the weekday."""
    t = read_table(s, d, "observed", ["obs_date"]).where("obs_date is not null").distinct()
    return t.select("obs_date", F.when(~((F.month("obs_date") == 2) & (F.dayofmonth("obs_date") == 29)), F.make_date(F.lit(2022), F.month("obs_date"), F.dayofmonth("obs_date"))).alias("same_day_2022"), F.weekday("obs_date").alias("weekday"))


def e15_first_delivery(s, d):
    """The first delivery of every observation."""
    t = read_table(s, d, "observed", ["obs_id", "received_at", "bikes"])
    n = F.row_number().over(Window.partitionBy("obs_id").orderBy("received_at", "bikes"))
    return t.withColumn("n", n).where("n = 1").select("obs_id", "received_at")


# ------------------------------------------------------------------ SQL

_T = "t AS (SELECT DISTINCT trip_id, origin, destination, run_date, CASE WHEN NOT isnan(demand) THEN demand END AS demand, CASE WHEN NOT isnan(length_m) THEN length_m END AS length_m FROM trip_lengths)"
_OD = f"{_T}, od AS (SELECT origin, destination, sum(demand) AS demand FROM t WHERE demand > 0 GROUP BY 1, 2)"
_TWO = f"{_T}, " + ", ".join(f"{n} AS (SELECT origin, destination, sum(demand * length_m) / sum(demand) AS length_m, sum(demand) AS demand FROM t WHERE demand > 0 AND length_m IS NOT NULL AND run_date {op} DATE '{_CUT}' GROUP BY 1, 2)" for n, op in (("a", "<"), ("b", ">=")))
_ZM = f"{_T}, pts AS (SELECT centroid_id, p[1] AS x, p[2] AS y FROM (SELECT centroid_id, min((x, y)) AS p FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)), {_IN.strip()}, zm AS (SELECT centroid_id AS origin, min(municipality_id) AS municipality_id FROM inside GROUP BY 1)"
_KEY = r"lower(trim(regexp_replace(trim(counter_name), '(?i)\s*PP$', '')))"
_DAYS = f"days AS (SELECT obs_id, {_KEY} AS name, obs_date AS day, bikes FROM (SELECT DISTINCT obs_id, counter_name, obs_date, CASE WHEN NOT isnan(bikes) THEN bikes END AS bikes FROM observed) WHERE {_KEY} <> '' AND obs_date IS NOT NULL AND bikes IS NOT NULL)"
_BIN = "CAST(CASE " + " ".join(f"WHEN length_m / 1000 < {e} THEN {i}" for i, e in enumerate(D.BIN_EDGES_KM)) + f" ELSE {len(D.BIN_EDGES_KM)} END AS INTEGER)"

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[1:3].isdigit()}
SQL = {
    "d01_od_demand": f"WITH {_OD} SELECT origin, destination, round(demand, 4) AS demand FROM od",
    "b30_demand_threshold": f"WITH {_OD} SELECT origin, destination, round(demand, 4) AS demand FROM od WHERE demand >= 5",
    "c02_placed_demand": f"WITH {_OD}, ids AS (SELECT centroid_id AS id, row_number() OVER (ORDER BY centroid_id) - 1 AS position FROM (SELECT DISTINCT centroid_id FROM centroids WHERE centroid_id IS NOT NULL)) SELECT o.position AS o_pos, e.position AS d_pos, round(demand, 4) AS demand FROM od JOIN ids o ON o.id = origin JOIN ids e ON e.id = destination",
    "c02_dropped_demand": f"WITH {_OD} SELECT 'origin' AS \"end\", count(*) AS pairs, round(sum(demand), 4) AS demand FROM od WHERE origin NOT IN (SELECT centroid_id FROM centroids) UNION ALL SELECT 'destination', count(*), round(sum(demand), 4) FROM od WHERE destination NOT IN (SELECT centroid_id FROM centroids)",
    "c03_aligned": f"WITH {_OD}, ids AS (SELECT DISTINCT centroid_id AS id FROM centroids WHERE centroid_id % 3 = 0) SELECT origin, destination, round(demand, 4) AS demand FROM od WHERE origin IN (SELECT id FROM ids) AND destination IN (SELECT id FROM ids)",
    "c04_overlay": f"WITH {_TWO} SELECT a.origin, a.destination, round(CASE WHEN b.length_m <= 20000 THEN b.length_m ELSE a.length_m END, 2) AS length_m, coalesce(b.length_m <= 20000, false) AS replaced FROM a LEFT JOIN b ON a.origin = b.origin AND a.destination = b.destination",
    "g10_two_tiers": f"WITH {_TWO} SELECT coalesce(a.origin, b.origin) AS origin, coalesce(a.destination, b.destination) AS destination, round(coalesce(b.length_m, a.length_m), 2) AS length_m, CASE WHEN b.origin IS NOT NULL THEN 'near' ELSE 'far' END AS tier FROM a FULL JOIN b ON a.origin = b.origin AND a.destination = b.destination",
    "g11_run_difference": f"WITH {_TWO} SELECT coalesce(a.origin, b.origin) AS origin, coalesce(a.destination, b.destination) AS destination, round(coalesce(a.demand, 0) - coalesce(b.demand, 0), 4) AS difference FROM a FULL JOIN b ON a.origin = b.origin AND a.destination = b.destination",
    "d42_matrix_compare": f"WITH {_TWO} SELECT count(*) FILTER (a.origin IS NULL OR b.origin IS NULL) AS mismatched, count(a.length_m - b.length_m) AS compared, round(max(abs(a.length_m - b.length_m)), 2) AS max_difference, count(*) FILTER (abs(a.length_m - b.length_m) > 100) AS apart FROM a FULL JOIN b ON a.origin = b.origin AND a.destination = b.destination",
    "d21_matrix_summary": f"WITH {_T}, m AS (SELECT origin, destination, sum(demand * length_m) / sum(demand) AS length_m FROM t WHERE demand > 0 AND length_m IS NOT NULL GROUP BY 1, 2) SELECT count(*) AS pairs, round(min(length_m) FILTER (length_m > 0), 2) AS least, round(quantile_cont(length_m, 0.5) FILTER (length_m > 0), 2) AS median, round(max(length_m), 2) AS largest FROM m",
    "g09_far_demand": f"WITH {_OD} SELECT origin, destination, round(demand, 4) AS demand FROM od WHERE origin <> destination",
    "j02_diagonal": f"WITH {_OD} SELECT origin, round(demand, 4) AS demand FROM od WHERE origin = destination",
    "j04_sums": f"WITH {_OD}, o AS (SELECT origin AS zone, sum(demand) AS x FROM od GROUP BY 1), e AS (SELECT destination AS zone, sum(demand) AS x FROM od GROUP BY 1) SELECT coalesce(o.zone, e.zone) AS zone, round(coalesce(o.x, 0), 4) AS as_origin, round(coalesce(e.x, 0), 4) AS as_destination FROM o FULL JOIN e ON o.zone = e.zone",
    "f01_top_zones": f"WITH {_OD} (SELECT 'origin' AS \"end\", origin AS zone, round(sum(demand), 4) AS demand FROM od GROUP BY 2 ORDER BY sum(demand) DESC, 2 LIMIT 10) UNION ALL (SELECT 'destination', destination, round(sum(demand), 4) FROM od GROUP BY 2 ORDER BY sum(demand) DESC, 2 LIMIT 10)",
    "f02_pairs_by_demand": f"WITH {_OD}, r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY demand DESC, destination) AS n FROM od) SELECT origin, destination, round(demand, 4) AS demand FROM r WHERE n = 1",
    "f10_scale_quantile": f"WITH {_OD} SELECT round(quantile_cont(demand, 0.995), 4) AS q995 FROM od",
    "a17_origin_totals": f"WITH {_T} SELECT origin, round(coalesce(sum(demand) FILTER (isodow(run_date) <= 5), 0), 4) AS weekday, round(coalesce(sum(demand) FILTER (isodow(run_date) > 5), 0), 4) AS weekend FROM t WHERE demand > 0 GROUP BY 1",
    "a39_trip_lengths": f"WITH {_T} SELECT run_date, round(sum(demand * length_m) / sum(demand) FILTER (length_m IS NOT NULL), 3) AS mean_m, round(coalesce(sum(demand) FILTER (length_m IS NULL), 0) / sum(demand), 6) AS unreached FROM t WHERE demand > 0 GROUP BY 1",
    "d31_person_km": f"WITH {_T} SELECT CAST(month(run_date) AS INTEGER) AS month, round(sum(demand * length_m) / 1000, 1) AS person_km, round(sum(demand), 4) AS trips FROM t WHERE demand > 0 AND length_m IS NOT NULL GROUP BY 1",
    "d19_logsum": f"WITH {_T} SELECT origin, round(-ln(greatest(sum(demand * exp(-0.2 * length_m / 1000)) / sum(demand), 1e-300)) / 0.2, 5) AS logsum_km, round(sum(demand * length_m / 1000) / sum(demand), 5) AS mean_km FROM t WHERE demand > 0 AND length_m IS NOT NULL GROUP BY 1",
    "d20_reachable_gate": f"WITH {_T}, g AS (SELECT origin, coalesce(sum(demand) FILTER (length_m IS NOT NULL), 0) / sum(demand) AS share FROM t WHERE demand > 0 GROUP BY 1) SELECT origin, round(share, 6) AS share FROM g WHERE share >= 0.9 - 1e-9",
    "d35_length_histogram": f"WITH {_ZM} SELECT municipality_id, {_BIN} AS bin, round(sum(demand), 4) AS trips, round(sum(demand * length_m) / sum(demand) / 1000, 4) AS mean_km FROM t JOIN zm USING (origin) WHERE demand > 0 AND length_m IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT NULL, {_BIN}, round(sum(demand), 4), round(sum(demand * length_m) / sum(demand) / 1000, 4) FROM t WHERE demand > 0 AND length_m IS NOT NULL GROUP BY 2",
    "d34_share_fit": f"WITH {_ZM}, m AS (SELECT municipality_id, sum(demand * length_m) / sum(demand) / 1000 AS x, coalesce(sum(demand) FILTER (length_m < 3000), 0) / sum(demand) AS y, sum(demand) AS w FROM t JOIN zm USING (origin) WHERE demand > 0 AND length_m IS NOT NULL GROUP BY 1), a AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM m) SELECT n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round((SELECT pow(sum(w * (x - mx) * (y - my)), 2) / (sum(w * (x - mx) ** 2) * sum(w * (y - my) ** 2)) FROM m), 6) AS r2_weighted FROM a WHERE n >= 3",
    "c28_placed_share": f"WITH {_ZM} SELECT round(sum(demand) FILTER (municipality_id IS NOT NULL) / sum(demand), 6) AS placed FROM t LEFT JOIN zm USING (origin) WHERE demand > 0",
    "a31_zone_radius": "WITH r AS (SELECT municipality_id, k, rings[k] AS g FROM municipality_polygons, LATERAL (SELECT unnest(range(1, len(rings) + 1)) AS k)), s AS (SELECT municipality_id, k, abs(list_sum(list_transform(range(1, len(g)), lambda i: g[i].x * g[i + 1].y - g[i + 1].x * g[i].y))) / 2 AS a FROM r), t AS (SELECT municipality_id, sum(CASE WHEN k = 1 THEN a ELSE -a END) AS a FROM s GROUP BY 1) SELECT municipality_id, round(a, 0) AS area_m2, round(sqrt(a / pi()), 2) AS radius_m, round(sqrt(a / pi()) * 128 / (45 * pi()), 2) AS within_m FROM t",
    "h03_name_keys": f"SELECT DISTINCT counter_name, {_KEY} AS name FROM observed WHERE counter_name IS NOT NULL",
    "a30_daily_counts": f"WITH {_DAYS} SELECT name, day, sum(bikes) AS bikes, count(*) AS observations FROM days GROUP BY 1, 2",
    "d36_annual_average": f"WITH {_DAYS}, dd AS (SELECT name, day, sum(bikes) AS bikes FROM days GROUP BY 1, 2 HAVING sum(bikes) > 0), sl AS (SELECT name, month(day) AS m, day(day) AS dm, arg_max(bikes, year(day)) AS bikes FROM dd WHERE year(day) IN (2022, 2023) AND NOT (month(day) = 2 AND day(day) = 29) GROUP BY ALL) SELECT name, round(avg(bikes), 4) AS bikes, count(*) AS days FROM sl GROUP BY 1",
    "c25_counters_observed": f"WITH {_DAYS}, seen AS (SELECT name, avg(bikes) AS observed FROM days GROUP BY 1) SELECT line_id, city, counter, round(observed, 4) AS observed FROM count_lines JOIN seen ON name = {_KEY.replace('counter_name', 'counter')}",
    "c27_missing_counters": f"WITH {_DAYS} SELECT line_id, counter FROM count_lines WHERE {_KEY.replace('counter_name', 'counter')} NOT IN (SELECT name FROM days)",
    "d38_counter_places": f"SELECT name, p[2] AS x, p[3] AS y FROM (SELECT {_KEY} AS name, min((obs_id, x, y)) AS p FROM observed WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND {_KEY} <> '' GROUP BY 1)",
    "d37_near_counters": "WITH p AS (SELECT line_id, geometry[1].x AS x, geometry[1].y AS y FROM count_lines) SELECT a.line_id AS a_id, b.line_id AS b_id FROM p a JOIN p b ON a.line_id < b.line_id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1100 * 1100",
    "a37_streamed_observations": "SELECT obs_date, count(DISTINCT obs_id) AS observations FROM observed GROUP BY 1",
    "h11_days": "SELECT DISTINCT obs_date, CASE WHEN NOT (month(obs_date) = 2 AND day(obs_date) = 29) THEN make_date(2022, month(obs_date), day(obs_date)) END AS same_day_2022, CAST(isodow(obs_date) - 1 AS INTEGER) AS weekday FROM observed WHERE obs_date IS NOT NULL",
    "e15_first_delivery": "SELECT obs_id, min(received_at) AS received_at FROM observed GROUP BY 1",
}
