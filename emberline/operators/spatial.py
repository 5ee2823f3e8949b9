"""Polygons as scanline runs: point-in-polygon joins without a geometry library.

A polygon is its edges (id, x1, y1, x2, y2) in cell units, rows downward. Its runs
(id, row, c0, c1) hold, for every row centre it crosses, the half-open column
ranges inside by the even-odd rule. A cell is within a polygon if a run of its row
covers its column, so the spatial join is an equi-join on the row with a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import SQ_M_TO_ACRES


def scanline_runs(edges: DataFrame, key: str = "id") -> DataFrame:
    """Runs of edges; each edge is dealt only to the rows whose centres it crosses."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.withColumn("r0", F.ceil(low - 0.5).cast("int")).withColumn("r1", (F.ceil(high - 0.5) - 1).cast("int")).filter("r1 >= r0")
    e = e.select(key, "x1", "y1", "x2", "y2", F.explode(F.sequence("r0", "r1")).alias("row"))
    x = F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    rows = e.groupBy(key, "row").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    pairs = F.expr("transform(sequence(0, size(xs) div 2 - 1), i -> struct(CAST(ceil(xs[2 * i] - 0.5) AS INT) AS c0, CAST(ceil(xs[2 * i + 1] - 0.5) AS INT) AS c1))")
    return rows.select(key, "row", F.explode(pairs).alias("r")).select(key, "row", "r.c0", "r.c1").filter("c1 > c0")


def within(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points (row, col) with each polygon that covers them; several polygons give several rows."""
    p, r = points.alias("p"), runs.alias("r")
    inside = (F.col("p.row") == F.col("r.row")) & (F.col("p.col") >= F.col("r.c0")) & (F.col("p.col") < F.col("r.c1"))
    return p.join(r, inside).select("p.*", *[F.col(f"r.{c}") for c in runs.columns if c not in ("row", "c0", "c1")])


def rasterize(runs: DataFrame, value: str) -> DataFrame:
    """row, col and the greatest value of the polygons that cover the cell."""
    cells = runs.select("row", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("col"), value)
    return cells.groupBy("row", "col").agg(F.max(value).alias(value))


def dissolve(runs: DataFrame, key: str) -> DataFrame:
    return runs.select(key, "row", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("col")).distinct()


def _distance2(px: Column, py: Column, e: str = "") -> Column:
    """Squared distance of a point to the edge (x1, y1)-(x2, y2) of the struct ``e`` or the row."""
    x1, y1, x2, y2 = (F.col(f"{e}{c}") for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length2))).otherwise(0.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def near_buckets(own: DataFrame, others: DataFrame, levels: int = 16) -> DataFrame:
    """For each bucket (br, bc) of ``own``, the buckets (nr, nc) of ``others`` that can hold the nearest thing to a point of it.

    Buckets of twice the size, up to ``levels`` times, tell where anything is near;
    only then are buckets compared, by the least and greatest distances of their points.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    up = [F.expr(f"shiftright({c}, l)").alias(n) for c, n in (("br", "R"), ("bc", "C"))]
    pyramid = others.select("br", "bc").distinct().select(F.col("br").alias("nr"), F.col("bc").alias("nc"), "br", "bc", level.alias("l")).select("nr", "nc", "l", *up)

    def around(df: DataFrame, reach: int) -> DataFrame:
        steps = F.sequence(F.lit(-reach), F.lit(reach))
        df = df.select("br", "bc", "l", *up).withColumn("R", F.explode(F.transform(steps, lambda k: F.col("R") + k)))
        return df.withColumn("C", F.explode(F.transform(steps, lambda k: F.col("C") + k)))

    look = around(own.select("br", "bc").distinct().withColumn("l", level), 1)
    first = look.join(pyramid.select("l", "R", "C").distinct(), ["l", "R", "C"]).groupBy("br", "bc").agg(F.min("l").alias("l"))
    dr, dc = F.abs(F.col("br") - F.col("nr")).cast("double"), F.abs(F.col("bc") - F.col("nc")).cast("double")
    zero = F.lit(0.0)
    low = F.pow(F.greatest(zero, dr - 1), F.lit(2)) + F.pow(F.greatest(zero, dc - 1), F.lit(2))
    pairs = around(first, 4).join(pyramid, ["l", "R", "C"]).select("br", "bc", "nr", "nc", low.alias("low"), (F.pow(dr + 1, F.lit(2)) + F.pow(dc + 1, F.lit(2))).alias("high"))
    best = pairs.groupBy("br", "bc").agg(F.min("high").alias("most"))
    return pairs.join(best, ["br", "bc"]).filter("low <= most").select("br", "bc", "nr", "nc")


def nearest(points: DataFrame, edges: DataFrame, point_key: str, key: str = "id", ties: bool = True, bucket: int = 8) -> DataFrame:
    """The polygon(s) nearest to each point (centre of row, col); ties give several rows.

    Points meet only the edges in the buckets that can hold the nearest one.
    """

    def span(low: str, high: str) -> Column:
        at = [F.floor(f(low, high) / bucket).cast("int") for f in (F.least, F.greatest)]
        return F.explode(F.sequence(*at))

    dealt = edges.select(key, "x1", "y1", "x2", "y2", span("y1", "y2").alias("br")).select("*", span("x1", "x2").alias("bc"))
    px, py = F.col("col") + 0.5, F.col("row") + 0.5
    lost = points.withColumn("br", F.floor(py / bucket).cast("int")).withColumn("bc", F.floor(px / bucket).cast("int"))
    found = lost.join(near_buckets(lost, dealt), ["br", "bc"]).drop("br", "bc").withColumnsRenamed({"nr": "br", "nc": "bc"})
    per = found.join(dealt, ["br", "bc"]).groupBy(point_key, key).agg(F.min(_distance2(px, py)).alias("d2"))
    best = per.groupBy(point_key).agg(F.min("d2").alias("best"), F.min_by(key, F.struct("d2", key)).alias("one"))
    if not ties:
        return best.select(point_key, F.col("one").alias(key))
    return per.join(best, point_key).filter("d2 = best").select(point_key, key)


def areas(edges: DataFrame, key: str = "id", cell: float = 30.0) -> DataFrame:
    """Planar area of each polygon in square metres and acres, by the shoelace formula over its edges in order."""
    twice = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")))
    out = edges.groupBy(key).agg((twice / 2 * (cell * cell)).alias("area_m2"))
    return out.withColumn("area_acres", F.col("area_m2") * SQ_M_TO_ACRES)


def clip(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points (row, col) inside any polygon, once each."""
    p, r = points.alias("p"), runs.alias("r")
    return p.join(r, (F.col("p.row") == F.col("r.row")) & (F.col("p.col") >= F.col("r.c0")) & (F.col("p.col") < F.col("r.c1")), "left_semi")


def clip_box(points: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """Points with top <= row < bottom and left <= col < right."""
    return points.filter(F.col("row").between(top, bottom - 1) & F.col("col").between(left, right - 1))


def intersecting(edges: DataFrame, area: DataFrame, key: str = "id", buffer: float = 0.0, most_edges: int = 10_000) -> DataFrame:
    """Keys of the polygons that meet an area or come within ``buffer`` cells of it.

    The area is one polygon's edges, gathered to one row after a check of their
    number. A polygon meets it if an edge comes near an edge, or one holds the other.
    """
    if (n := area.count()) > most_edges:
        raise ValueError(f"an area of {n} edges is too large to send to every task")
    one = area.agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("area"))
    e = edges.select(key, "x1", "y1", "x2", "y2").crossJoin(F.broadcast(one))  # one row

    def crosses(px: str, py: str, a: str) -> str:  # a ray from a point to the right meets the edge a
        return f"(({a}.y1 > {py}) <> ({a}.y2 > {py}) AND {px} < {a}.x1 + ({py} - {a}.y1) * ({a}.x2 - {a}.x1) / ({a}.y2 - {a}.y1))"

    def d2(px: str, py: str, q: str) -> str:
        dx, dy = f"({q}x2 - {q}x1)", f"({q}y2 - {q}y1)"
        t = f"greatest(0D, least(1D, coalesce((({px} - {q}x1) * {dx} + ({py} - {q}y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0D), 0D)))"
        return f"(pow({px} - {q}x1 - {t} * {dx}, 2) + pow({py} - {q}y1 - {t} * {dy}, 2))"

    def side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
        return f"sign(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"

    own, its = ("x1", "y1", "x2", "y2"), ("a.x1", "a.y1", "a.x2", "a.y2")
    cut = f"({side(*own, *its[:2])} * {side(*own, *its[2:])} < 0 AND {side(*its, *own[:2])} * {side(*its, *own[2:])} < 0)"
    near = " OR ".join([f"{d2('x1', 'y1', 'a.')} <= {buffer}D * {buffer}D", f"{d2('x2', 'y2', 'a.')} <= {buffer}D * {buffer}D", f"{d2('a.x1', 'a.y1', '')} <= {buffer}D * {buffer}D", f"{d2('a.x2', 'a.y2', '')} <= {buffer}D * {buffer}D", cut])
    touches = F.expr(f"exists(area, a -> {near})")
    inside = F.expr(f"size(filter(area, a -> {crosses('x1', 'y1', 'a')})) % 2 = 1")
    holds = F.expr("(y1 > area[0].y1) <> (y2 > area[0].y1) AND area[0].x1 < x1 + (area[0].y1 - y1) * (x2 - x1) / nullif(y2 - y1, 0D)")
    tests = e.groupBy(key).agg(F.max(touches | inside).alias("meets"), (F.sum(F.coalesce(holds, F.lit(False)).cast("int")) % 2 == 1).alias("holds"))
    return tests.filter("meets OR holds").select(key)


def assign(points: DataFrame, runs: DataFrame, edges: DataFrame, point_key: str, key: str = "id") -> DataFrame:
    """Within, and for points outside all polygons the nearest."""
    inside = within(points, runs)
    lost = points.join(inside.select(point_key), point_key, "left_anti")
    return inside.unionByName(lost.join(nearest(lost, edges, point_key, key), point_key).select(*points.columns, key))
