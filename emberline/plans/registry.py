"""The driver's queries over its tables, each with the SQL of its rows.

Stand-ins: a customer is a cell, an order an event, the order's priority its
severity, its status a varied pivot, the customer's region and nation its zones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, grid
from ..operators import distribution as dist
from ..operators import layers, recurrence, spatial
from ..operators.recurrence import Names

O = Names(key="o_custkey", date="o_orderdate", event="o_orderkey", severity="bs", eco=("region", "nation", "nation"), perimeter="perim_index")
PAIR = Names(key="o_custkey", date="o_orderdate", event="o_orderkey", severity="bs", eco=("region", "nation", "segment"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _severity():
    return F.substring("o_orderpriority", 1, 1).cast("int").alias("bs")


def _events(spark, d) -> DataFrame:
    """Orders with their customers' zones, the last of a day per customer."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", _severity())
    zones = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    zones = zones.select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("region"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return recurrence.keep_last(orders, O).join(zones, "o_custkey")


EVENTS = """e AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS INT) AS bs,
  n_regionkey AS region, c_nationkey AS nation, c_mktsegment AS segment
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders) o
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE k = 1)"""


def _flagship_events(spark, d) -> DataFrame:
    """Urgent finished orders at year grain."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    o = o.select("o_custkey", "o_orderkey", F.date_trunc("year", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("o_orderdate"), "o_orderstatus")
    o = recurrence.keep_last(o, O)
    zones = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    zones = zones.select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("region"))
    return o.join(zones, "o_custkey").withColumn("perim_index", F.year("o_orderdate"))


def _histories(spark, d) -> DataFrame:
    return recurrence.event_histories(_flagship_events(spark, d), fixed=["region"], varied=["o_orderstatus"], names=O)


FLAG = """f AS (SELECT DISTINCT o_custkey, date_trunc('year', o_orderdate)::TIMESTAMP AS dt0, o_orderstatus, n_regionkey AS region
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
h AS (SELECT region, dates, count(*) AS w FROM (SELECT o_custkey, region, list(dt0 ORDER BY dt0) AS dates FROM f GROUP BY ALL) GROUP BY region, dates)"""


def event_history_hist(spark, d):
    h = _histories(spark, d)
    dates = F.array_join(F.transform("o_orderdate", lambda x: F.year(x).cast("string")), ",")
    return h.select("region", dates.alias("history"), F.col("# Fires").alias("n"), F.col("Pixel_Count").alias("pixel_count"))


def hist_gap_weighted(spark, d):
    gaps = recurrence.history_gaps(_histories(spark, d), {"o_orderstatus": ["F", "O"]}, O)
    return gaps.groupBy("dt").agg(F.sum("Pixel_Count").alias("pixels"))


def pair_gaps(spark, d):
    out = recurrence.pair_gaps(_events(spark, d), ["o_orderstatus"], PAIR)
    return out.withColumn("dt", F.round("dt", 9))


def pair_gaps_severity_transition(spark, d):
    out = recurrence.pair_gaps(_events(spark, d), names=PAIR)
    return out.groupBy("bs_1", "bs_2").agg(F.count("*").alias("n"), F.sum(F.round(F.col("dt") * 365).cast("long")).alias("total_days"))


PAIRS = f"""WITH {EVENTS}, p AS (SELECT o_custkey, first(region) OVER a AS eco1, first(nation) OVER a AS eco2, first(segment) OVER a AS eco3,
  date_sub('day', o_orderdate, lead(o_orderdate) OVER w) AS days, bs AS bs_1, lead(bs) OVER w AS bs_2, o_orderstatus AS o_orderstatus_1, lead(o_orderstatus) OVER w AS o_orderstatus_2
  FROM e WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
  a AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def survival_last_event(spark, d):
    out = recurrence.survival(_events(spark, d), names=PAIR)
    return out.withColumn("st", F.round("st", 9))


def hist_censored_starts(spark, d):
    out = recurrence.history_ends(_histories(spark, d), filters={"o_orderstatus": ["F"]}, names=O)
    return out.select(F.round("ct", 9).alias("ct"), F.col("Pixel_Count").alias("pixel_count"))


def hist_uncensored_starts(spark, d):
    out = recurrence.history_starts(_histories(spark, d), filters={"o_orderstatus": ["F"]}, names=O)
    return out.select(F.round("ut", 9).alias("ut"), F.col("Pixel_Count").alias("pixel_count"))


def hist_survival_days(spark, d):
    out = recurrence.history_spans(_histories(spark, d), fixed=["region"], names=O)
    return out.select("region", F.expr("CAST(extract(DAY FROM ct) AS LONG)").alias("ct_days"), F.expr("CAST(extract(DAY FROM ut) AS LONG)").alias("ut_days"), F.col("Pixel_Count").alias("pixel_count"))


def blank_entities(spark, d):
    total = table(spark, d, "customer").agg(F.count("*").alias("total"))
    h = recurrence.blank_entities(_histories(spark, d), 0)
    return h.crossJoin(F.broadcast(total)).select((F.col("total") + F.col("blank")).alias("blank"))


def recurrence_summary(spark, d):
    h = _histories(spark, d)
    gaps = h.filter("`# Fires` > 1").select("region", "Pixel_Count")
    totals = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("total_pixels"))
    return dist.summary(gaps, h.select("region", "Pixel_Count"), totals, "region").withColumn("pc_empty", F.round("pc_empty", 9))


def _gaps(spark, d):
    return recurrence.pair_gaps(_events(spark, d), names=PAIR)


def gap_hist_unit_bins(spark, d):
    return dist.histogram(_gaps(spark, d), 38)


def gap_hist_weighted(spark, d):
    return dist.histogram(_gaps(spark, d), 39, weighted=True).withColumn("weight", F.round("weight", 6))


def gap_hist_stacked(spark, d):
    return dist.histogram(_gaps(spark, d), 38, by=("bs_2",))


def gap_ecdf(spark, d):
    return dist.ecdf(_gaps(spark, d), "bs_2").withColumn("dt", F.round("dt", 9))


def gap_mean(spark, d):
    return _gaps(spark, d).agg(F.round(F.sum(F.round(F.col("dt") * 365)) / F.count("*") / 365.0, 9).alias("mean_dt"))


def dedupe_keep_last(spark, d):
    return recurrence.keep_last(table(spark, d, "orders"), O).select("o_custkey", "o_orderdate", "o_orderkey")


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def layer_inner_chain(spark, d):
    part = table(spark, d, "part")
    p = _lines(spark, d).withColumnRenamed("l_partkey", "geohash")
    out = layers.attach_all(p, {"size": part.select(F.col("p_partkey").alias("geohash"), F.nullif(F.col("p_size"), F.lit(1)).alias("value")), "brand": part.select(F.col("p_partkey").alias("geohash"), F.col("p_brand").alias("value"))})
    return out.groupBy("brand", "size").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def layer_left(spark, d):
    labels = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id"), F.col("toxic").alias("value"))
    return layers.attach(table(spark, d, "documents").select("doc_id", "lang"), labels, "toxic", "doc_id", "left").groupBy("lang", "toxic").agg(F.count("*").alias("n"))


def mask_semi(spark, d):
    return layers.mask(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def orphans_anti(spark, d):
    return layers.orphans(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def vintage_asof(spark, d):
    o = table(spark, d, "orders").select(codes.vintage(F.year("o_orderdate")).alias("vintage"))
    return o.groupBy("vintage").agg(F.count("*").alias("n"))


def _yearly(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice"))
    return o.groupBy("o_custkey", "year").agg(F.max("o_totalprice").alias("value"))


def offset_year_join(spark, d):
    y = _yearly(spark, d)
    _, before, after = codes.cover_years(F.col("year"))
    p = y.select("o_custkey", "year", F.greatest(before, F.lit(1995)).alias("pre"), after.alias("post"), F.col("value").alias("now"))
    p = layers.attach(p, y.withColumnRenamed("year", "pre"), "v_pre", ["o_custkey", "pre"])
    return layers.attach(p, y.withColumnRenamed("year", "post"), "v_post", ["o_custkey", "post"]).select("o_custkey", "year", "v_pre", "now", "v_post")


def union_years(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    low, high = o.agg(F.min("year"), F.max("year")).first()
    frames = [o.filter(F.col("year") == y).select("o_orderkey", "year") for y in range(low, high + 1)]
    return layers.union_years(frames).groupBy("year").agg(F.count("*").alias("n"))


def zonal_counts(spark, d):
    return layers.zonal_counts(_events(spark, d), "region", "bs")


def entity_mode(spark, d):
    return layers.cell_mode(_events(spark, d), "o_custkey", "bs")


def latest_event_max(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("dse"))
    before = layers.latest(None, o.filter("dse < 10000"), "o_custkey", "dse")
    return layers.latest(before, o.filter("dse >= 10000"), "o_custkey", "dse")


def survival_days_to_year(spark, d):
    cells = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return layers.survival_grid(cells, table(spark, d, "orders"), "o_custkey", "o_orderdate", 1995, 2000)


def eco_code_parse(spark, d):
    n = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.concat_ws(".", (F.col("n_regionkey") + 1).cast("string"), (F.col("c_nationkey") % 10).cast("string"), (F.col("c_custkey") % 100).cast("string"))
    l1, l2, l3 = codes.eco_levels(code)
    return n.select("c_custkey", l1.alias("l1"), l2.alias("l2"), l3.alias("l3"))


STATUS = {"F": 1, "O": 2, "P": 3}


def dict_encode(spark, d):
    return table(spark, d, "orders").groupBy(codes.encode(F.col("o_orderstatus"), STATUS).alias("code")).agg(F.count("*").alias("n"))


def flag_bool(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", codes.flag(F.col("s_acctbal")).cast("int").alias("flag"))


def _cells(spark, d):
    return table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7919123) % (grid.ROWS * grid.COLS)).alias("cell"))


def grid_encode_roundtrip(spark, d):
    c = _cells(spark, d)
    return c.select("c_custkey", grid.row_of(F.col("cell")).alias("i"), grid.col_of(F.col("cell")).alias("j"), grid.cell_of(grid.centre_x(F.col("cell")), grid.centre_y(F.col("cell"))).alias("back"))


def grid_xy(spark, d):
    c = _cells(spark, d)
    return c.select("cell", grid.centre_x(F.col("cell")).alias("x"), grid.centre_y(F.col("cell")).alias("y"))


def grid_lonlat(spark, d):
    c = grid_xy(spark, d)
    lon, lat = grid.to_lonlat(F.col("x"), F.col("y"))
    return c.select("cell", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def _box_edges(boxes):
    x0, y0 = F.col("x0").cast("double"), F.col("y0").cast("double")
    x1, y1 = x0 + F.col("w"), y0 + F.col("h")
    sides = F.array(*[F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), e.alias("y2")) for a, b, c, e in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))])
    return boxes.select("id", F.explode(sides).alias("s")).select("id", "s.*")


def _spread(spark, d):
    """Boxes of all suppliers and points of all customers, on a grid whose area grows with the suppliers."""
    n = table(spark, d, "supplier").agg(F.ceil(F.sqrt(F.lit(22.5) * F.count("*"))).cast("long").alias("side"))
    b = table(spark, d, "supplier").crossJoin(F.broadcast(n)).withColumn("at", F.expr("s_suppkey * 7919 % (side * side)"))
    s = F.col("s_suppkey").cast("int")
    boxes = b.select(s.alias("id"), (F.col("at") % F.col("side")).cast("int").alias("x0"), F.expr("CAST(at div side AS INT)").alias("y0"), (2 + s % 9).alias("w"), (2 + s % 5).alias("h"))
    p = table(spark, d, "customer").crossJoin(F.broadcast(n.select((F.col("side") + 10).alias("side")))).withColumn("at", F.expr("c_custkey * 7919 % (side * side)"))
    return boxes, p.select(F.col("c_custkey").alias("pid"), F.expr("CAST(at div side AS INT)").alias("row"), (F.col("at") % F.col("side")).cast("int").alias("col"))


def spatial_within_all_boxes(spark, d):
    boxes, points = _spread(spark, d)
    return spatial.within(points, spatial.scanline_runs(_box_edges(boxes))).select("pid", "id")


def rasterize_all_boxes_latest(spark, d):
    return spatial.rasterize(spatial.scanline_runs(_box_edges(_spread(spark, d)[0])), "id")


def spatial_nearest_all_boxes(spark, d):
    boxes, points = _spread(spark, d)
    edges = _box_edges(boxes)
    lost = layers.orphans(points, spatial.within(points, spatial.scanline_runs(edges)), "pid")
    return spatial.nearest(lost, edges, "pid")


def rollup_regions_union(spark, d):
    n = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    each = n.groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    west = n.filter(F.col("n_regionkey").isin(1, 2)).agg(F.lit("WEST").alias("name"), F.count("*").alias("n"))
    return each.unionByName(west).unionByName(n.agg(F.lit("ALL").alias("name"), F.count("*").alias("n")))


def _truncated_days(events):
    e = events.withColumn("perim_index", F.col("event_id"))
    names = Names(key="user_id", date="ts", event="event_id")
    h = recurrence.event_histories(e, varied=["event_type"], names=names)
    gaps = recurrence.history_gaps(h, {"event_type": ["error"]}, names, least=-1.0)
    return gaps.agg(F.sum("Pixel_Count").alias("n"), F.sum(F.round(F.col("dt") * 365).cast("long") * F.col("Pixel_Count")).alias("total_days"))


def truncated_days_vs_all_values(spark, d):
    """Gaps over every event of the two types."""
    return _truncated_days(table(spark, d, "events").filter("event_type IN ('error', 'purchase')"))


ALL_BOXES = """k AS (SELECT CAST(ceil(sqrt(22.5 * count(*))) AS BIGINT) AS side FROM supplier),
b AS (SELECT CAST(s_suppkey AS INT) AS id, CAST(s_suppkey * 7919 % (side * side) % side AS INT) AS x0, CAST(s_suppkey * 7919 % (side * side) // side AS INT) AS y0, CAST(2 + s_suppkey % 9 AS INT) AS w, CAST(2 + s_suppkey % 5 AS INT) AS h FROM supplier, k),
p AS (SELECT c_custkey AS pid, CAST(c_custkey * 7919 % ((side + 10) * (side + 10)) // (side + 10) AS INT) AS "row", CAST(c_custkey * 7919 % ((side + 10) * (side + 10)) % (side + 10) AS INT) AS col FROM customer, k),
cells AS (SELECT id, CAST(y0 + i AS INT) AS "row", CAST(x0 + j AS INT) AS col FROM b, range(0, 20) r(i), range(0, 20) c(j) WHERE i < h AND j < w)"""
YEARLY = "y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS yr, max(o_totalprice) AS value FROM orders GROUP BY ALL)"
CELLS = f"c AS (SELECT c_custkey, (c_custkey * 7919123) % {grid.ROWS * grid.COLS} AS cell FROM customer), g AS (SELECT *, cell // {grid.COLS} AS i, cell % {grid.COLS} AS j, CAST({grid.LEFT} + 15 + 30 * (cell % {grid.COLS}) AS DOUBLE) AS x, CAST({grid.TOP} - 15 - 30 * (cell // {grid.COLS}) AS DOUBLE) AS y FROM c)"
_E2 = grid._E2
LONLAT = f"""WITH {CELLS}, q AS (SELECT *, asin((({grid.C!r}::DOUBLE - (x * x + ({grid.RHO0!r}::DOUBLE - y) ** 2) * {grid.N**2 / grid.A**2!r}::DOUBLE) / {grid.N!r}::DOUBLE) / {grid.QP!r}::DOUBLE) AS b FROM g)
SELECT cell, round(degrees(atan2(x, {grid.RHO0!r}::DOUBLE - y) / {grid.N!r}::DOUBLE) - 96, 6) AS lon,
round(degrees(b + {_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040!r}::DOUBLE * sin(2 * b) + {23 * _E2**2 / 360 + 251 * _E2**3 / 3780!r}::DOUBLE * sin(4 * b) + {761 * _E2**3 / 45360!r}::DOUBLE * sin(6 * b)), 6) AS lat FROM q"""

SQL = {
    "event_history_hist": f"WITH {FLAG} SELECT region, array_to_string([CAST(year(x) AS VARCHAR) FOR x IN dates], ',') AS history, len(dates) AS n, w AS pixel_count FROM h",
    "hist_gap_weighted": f"WITH {FLAG}, g AS (SELECT w, date_sub('day', dates[i], dates[i + 1]) / 365.0::DOUBLE AS dt FROM (SELECT w, dates, unnest(range(1, len(dates))) AS i FROM h)) SELECT dt, CAST(sum(w) AS BIGINT) AS pixels FROM g WHERE dt > 0.25 GROUP BY dt",
    "pair_gaps": f"{PAIRS} SELECT o_custkey, eco1, eco2, eco3, round(days / 365.0::DOUBLE, 9) AS dt, bs_1, bs_2, o_orderstatus_1, o_orderstatus_2 FROM p WHERE days IS NOT NULL",
    "pair_gaps_severity_transition": f"{PAIRS} SELECT bs_1, bs_2, count(*) AS n, CAST(sum(days) AS BIGINT) AS total_days FROM p WHERE days IS NOT NULL GROUP BY ALL",
    "survival_last_event": f"WITH {EVENTS} SELECT o_custkey, count(*) AS n, arg_max(region, o_orderdate) AS region, arg_max(nation, o_orderdate) AS nation, arg_max(segment, o_orderdate) AS segment, round(date_sub('day', max(o_orderdate), (SELECT max(o_orderdate) FROM e)) / 365.0::DOUBLE, 9) AS st, arg_max(bs, o_orderdate) AS bs FROM e GROUP BY o_custkey",
    "hist_censored_starts": f"WITH {FLAG} SELECT round(date_sub('day', dates[-1], (SELECT max(dt0) FROM f)) / 365.0::DOUBLE, 9) AS ct, w AS pixel_count FROM h",
    "hist_uncensored_starts": f"WITH {FLAG} SELECT round(date_sub('day', (SELECT min(dt0) FROM f), dates[1]) / 365.0::DOUBLE, 9) AS ut, w AS pixel_count FROM h",
    "hist_survival_days": f"WITH {FLAG} SELECT region, date_sub('day', dates[-1], (SELECT max(dt0) FROM f)) AS ct_days, date_sub('day', (SELECT min(dt0) FROM f), dates[1]) AS ut_days, w AS pixel_count FROM h",
    "blank_entities": f"WITH {FLAG} SELECT CAST((SELECT count(*) FROM customer) - sum(w) AS BIGINT) AS blank FROM h",
    "recurrence_summary": f"WITH {FLAG}, t AS (SELECT n_regionkey AS region, count(*) AS total_pixels FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), s AS (SELECT region, CAST(sum(w) AS BIGINT) AS st_pixels, count(*) AS st_polygons, CAST(coalesce(sum(w) FILTER (len(dates) > 1), 0) AS BIGINT) AS dt_pixels, count(*) FILTER (len(dates) > 1) AS dt_polygons FROM h GROUP BY region) SELECT region, coalesce(dt_pixels, 0) AS dt_pixels, coalesce(dt_polygons, 0) AS dt_polygons, coalesce(st_pixels, 0) AS st_pixels, coalesce(st_polygons, 0) AS st_polygons, total_pixels, total_pixels - coalesce(st_pixels, 0) AS empty_pixels, round((total_pixels - coalesce(st_pixels, 0)) / total_pixels::DOUBLE, 9) AS pc_empty FROM t LEFT JOIN s USING (region)",
    "gap_hist_unit_bins": f"{PAIRS} SELECT CAST(least(floor(days / 365.0::DOUBLE), 37) AS INT) AS bin, count(*) AS n FROM p WHERE days / 365.0::DOUBLE BETWEEN 0 AND 38 GROUP BY 1",
    "gap_hist_weighted": f"{PAIRS} SELECT CAST(least(floor(days / 365.0::DOUBLE), 38) AS INT) AS bin, round(sum(38.0::DOUBLE / (38 - floor(days / 365.0::DOUBLE))), 6) AS weight FROM p WHERE days / 365.0::DOUBLE BETWEEN 0 AND 39 AND floor(days / 365.0::DOUBLE) < 38 GROUP BY 1",
    "gap_hist_stacked": f"{PAIRS} SELECT bs_2, CAST(least(floor(days / 365.0::DOUBLE), 37) AS INT) AS bin, count(*) AS n FROM p WHERE days / 365.0::DOUBLE BETWEEN 0 AND 38 GROUP BY 1, 2",
    "gap_ecdf": f"{PAIRS}, c AS (SELECT bs_2, days, count(*) AS n FROM p WHERE days IS NOT NULL GROUP BY 1, 2) SELECT bs_2, round(days / 365.0::DOUBLE, 9) AS dt, CAST(sum(n) OVER (PARTITION BY bs_2 ORDER BY days) AS BIGINT) AS cum FROM c",
    "gap_mean": f"{PAIRS} SELECT round(sum(days) / count(*) / 365.0::DOUBLE, 9) AS mean_dt FROM p WHERE days IS NOT NULL",
    "dedupe_keep_last": "SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2",
    "layer_inner_chain": "SELECT p_brand AS brand, p_size AS size, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <> 1 GROUP BY 1, 2",
    "layer_left": "SELECT lang, toxic, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE quality = 1) USING (doc_id) GROUP BY 1, 2",
    "mask_semi": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "orphans_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "vintage_asof": "SELECT CASE WHEN year(o_orderdate) < 2000 THEN 1990 WHEN year(o_orderdate) < 2010 THEN 2000 WHEN year(o_orderdate) < 2020 THEN 2010 ELSE 2020 END AS vintage, count(*) AS n FROM orders GROUP BY 1",
    "offset_year_join": f"WITH {YEARLY} SELECT a.o_custkey, a.yr AS year, b.value AS v_pre, a.value AS now, c.value AS v_post FROM y a JOIN y b ON b.o_custkey = a.o_custkey AND b.yr = greatest(a.yr - 1, 1995) JOIN y c ON c.o_custkey = a.o_custkey AND c.yr = a.yr + 1",
    "union_years": "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1",
    "zonal_counts": f'WITH {EVENTS} SELECT region, bs, count(*) AS "count" FROM e GROUP BY 1, 2',
    "entity_mode": f"WITH {EVENTS}, c AS (SELECT o_custkey, bs, count(*) AS n FROM e GROUP BY 1, 2) SELECT o_custkey, bs AS mode FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, bs) AS k FROM c) WHERE k = 1",
    "latest_event_max": "SELECT o_custkey, CAST(date_diff('day', DATE '1970-01-01', CAST(max(o_orderdate) AS DATE)) AS INT) AS dse FROM orders GROUP BY 1",
    "survival_days_to_year": "SELECT c_custkey AS o_custkey, CAST(coalesce(date_diff('day', (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) BETWEEN 1995 AND 1999), DATE '2000-01-01'), 5 * 365) AS INT) AS st FROM customer",
    "eco_code_parse": "SELECT c_custkey, CAST(n_regionkey + 1 AS INT) AS l1, CAST((n_regionkey + 1) * 10 + c_nationkey % 10 AS INT) AS l2, CAST((n_regionkey + 1) * 1000 + c_nationkey % 10 * 100 + c_custkey % 100 AS INT) AS l3 FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "dict_encode": "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS code, count(*) AS n FROM orders GROUP BY 1",
    "flag_bool": "SELECT s_suppkey, CAST(s_acctbal > 0 AS INT) AS flag FROM supplier",
    "grid_encode_roundtrip": f"WITH {CELLS} SELECT c_custkey, i, j, cell AS back FROM g",
    "grid_xy": f"WITH {CELLS} SELECT cell, x, y FROM g",
    "grid_lonlat": LONLAT,
    "spatial_within_all_boxes": f'WITH {ALL_BOXES} SELECT pid, id FROM p JOIN cells ON cells."row" = p."row" AND cells.col = p.col',
    "rasterize_all_boxes_latest": f'WITH {ALL_BOXES} SELECT "row", col, max(id) AS id FROM cells GROUP BY 1, 2',
    "spatial_nearest_all_boxes": f"""WITH {ALL_BOXES}, o AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM cells WHERE cells."row" = p."row" AND cells.col = p.col)),
d AS (SELECT pid, id, greatest(x0 - col - 0.5, col + 0.5 - x0 - w, 0) ** 2 + greatest(y0 - "row" - 0.5, "row" + 0.5 - y0 - h, 0) ** 2 AS d2 FROM o, b)
SELECT pid, id FROM (SELECT *, rank() OVER (PARTITION BY pid ORDER BY d2) AS k FROM d) WHERE k = 1""",
    "rollup_regions_union": "WITH n AS (SELECT n_name, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT n_name AS name, count(*) AS n FROM n GROUP BY 1 UNION ALL SELECT 'WEST', count(*) FROM n WHERE n_regionkey IN (1, 2) UNION ALL SELECT 'ALL', count(*) FROM n",
    "truncated_days_vs_all_values": "WITH g AS (SELECT event_type, date_sub('day', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS days FROM events WHERE event_type IN ('error', 'purchase')) SELECT count(*) AS n, CAST(sum(days) AS BIGINT) AS total_days FROM g WHERE event_type = 'error' AND days IS NOT NULL",
}

QUERIES = {name: globals()[name] for name in SQL}
