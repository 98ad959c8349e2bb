"""Queries over pixels: each embedding stands for an 8 by 8 grey image."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import raster as R
from rasterlake.plans.adapters import PIXELS_SQL, bitmaps, pixels

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _rows(spark, d):
    return bitmaps(spark, d).select(F.col("vec_id").alias("frame"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.struct(y.alias("y"), F.slice("v", y * 8 + 1, 8).alias("v")))).alias("r")).select("frame", "r.y", "r.v")


_W = f"WITH RECURSIVE {PIXELS_SQL}"
_HIST = "hs AS (SELECT frame, v, count(*) AS n FROM px GROUP BY ALL)"
_OTSU = _HIST + """,
o1 AS (SELECT frame, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY frame) AS n, sum(n * v) OVER (PARTITION BY frame) AS s FROM hs WINDOW w AS (PARTITION BY frame ORDER BY v)),
o2 AS (SELECT frame, v, w0::DOUBLE * (n - w0)::DOUBLE * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (n - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (n - w0)) AS b FROM o1 WHERE w0 < n),
ot AS (SELECT f.frame, coalesce(o.v, 127)::INT AS threshold FROM (SELECT DISTINCT frame FROM hs) f LEFT JOIN (SELECT frame, v FROM o2 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY b DESC, v) = 1) o USING (frame))"""
_MASK = "mk AS (SELECT px.frame, x, y, (px.v > ot.threshold)::INT AS v FROM px JOIN ot USING (frame))"
_RUNS = """rn AS (SELECT frame, y, v, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, row_number() OVER (PARTITION BY frame, y ORDER BY x) - row_number() OVER (PARTITION BY frame, y, v ORDER BY x) AS k FROM mk) GROUP BY frame, y, v, k)"""


def _mask(spark, d):
    p = pixels(spark, d)
    return p.join(R.otsu(R.histogram(p)), "frame").select("frame", "x", "y", (F.col("v") > F.col("threshold")).cast("int").alias("v"))


def _labelled(spark, d, connectivity=8):
    return R.labelled_runs(R.runs(_mask(spark, d)).where("v = 1"), connectivity)


@query(f"""{_W}, nx AS (SELECT vec_id, v, lead(v, 1, v) OVER (ORDER BY vec_id) AS g, lag(v, 1, v) OVER (ORDER BY vec_id) AS b FROM bm)
SELECT vec_id AS frame, list_sum(list_transform(list_zip(v, g, b), lambda z: (77 * z[1] + 150 * z[2] + 29 * z[3] + 128) >> 8))::BIGINT AS total FROM nx WHERE vec_id > (SELECT min(vec_id) FROM bm) AND vec_id < (SELECT max(vec_id) FROM bm)""")
def luma_of_neighbours(spark, d):
    a = bitmaps(spark, d).select("vec_id", "v")
    g, b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("g")), a.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("b"))
    i = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: R.luma(F.element_at("v", k), F.element_at("g", k), F.element_at("b", k)))
    return a.join(g, "vec_id").join(b, "vec_id").select(F.col("vec_id").alias("frame"), F.aggregate(i, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"""{_W} SELECT a.frame, a.x, a.y, greatest(coalesce(abs(a.v - l.v), 0), coalesce(abs(a.v - r.v), 0), coalesce(abs(a.v - u.v), 0), coalesce(abs(a.v - d.v), 0)) AS v FROM px a
LEFT JOIN px l ON l.frame = a.frame AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN px r ON r.frame = a.frame AND r.y = a.y AND r.x = a.x + 1
LEFT JOIN px u ON u.frame = a.frame AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN px d ON d.frame = a.frame AND d.x = a.x AND d.y = a.y + 1""")
def edge_strength(spark, d):
    return R.exploded(R.edge_strength(_rows(spark, d)))


@query(f"{_W}, {_HIST} SELECT frame, v, n FROM hs")
def histograms(spark, d):
    return R.histogram(pixels(spark, d))


@query(f"{_W}, {_OTSU} SELECT frame, threshold FROM ot")
def otsu_thresholds(spark, d):
    return R.otsu(R.histogram(pixels(spark, d)))


@query(f"""{_W}, {_HIST}, c AS (SELECT frame, v, sum(n) OVER (PARTITION BY frame ORDER BY v) AS c, sum(n) OVER (PARTITION BY frame) AS t FROM hs)
SELECT frame, min(v) FILTER (c * 100 >= 2 * t) AS p2, min(v) FILTER (c * 100 >= 50 * t) AS p50, min(v) FILTER (c * 100 >= 98 * t) AS p98 FROM c GROUP BY frame""")
def percentiles(spark, d):
    h = R.histogram(pixels(spark, d))
    return R.percentile(h, 2, "p2").join(R.percentile(h, 50, "p50"), "frame").join(R.percentile(h, 98, "p98"), "frame")


_LEVELS = """lv AS (SELECT frame, threshold, min(v) FILTER (NOT up AND 2 * c >= t) AS low, coalesce(min(v) FILTER (up AND 2 * c >= t), threshold + 1) AS high FROM (
  SELECT hs.frame, v, threshold, v > threshold AS up, sum(n) OVER (PARTITION BY hs.frame, v > threshold ORDER BY v) AS c, sum(n) OVER (PARTITION BY hs.frame, v > threshold) AS t FROM hs JOIN ot USING (frame)) GROUP BY frame, threshold)"""


@query(f"{_W}, {_OTSU}, {_LEVELS} SELECT frame, threshold, low, high FROM lv")
def class_medians(spark, d):
    h = R.histogram(pixels(spark, d))
    return R.class_medians(h, R.otsu(h))


_POLARITY = f"""{_MASK}, {_RUNS},
vt AS (SELECT frame, count(*) FILTER (v = 1) AS above, count(*) FILTER (v = 0) AS below FROM mk WHERE x IN (0, 7) OR y IN (0, 7) GROUP BY frame),
st AS (SELECT frame, count(*) FILTER (v = 0) AS n0, count(*) FILTER (v = 1) AS n1, coalesce(sum(x1 - x0) FILTER (v = 0), 0) AS l0, coalesce(sum(x1 - x0) FILTER (v = 1), 0) AS l1 FROM rn WHERE x0 > 0 AND x1 < 8 GROUP BY frame),
po AS (SELECT vt.frame, above, below, CASE WHEN coalesce(n0, 0) > 0 AND coalesce(n1, 0) > 0 AND greatest(above, below) * 4 < (above + below) * 3 THEN l0 * n1 < l1 * n0 ELSE above >= below END AS dark_text FROM vt LEFT JOIN st USING (frame))"""


@query(f"{_W}, {_OTSU}, {_POLARITY} SELECT frame, above, below, dark_text FROM po")
def ink_polarity(spark, d):
    p = pixels(spark, d)
    return R.polarity(p, R.otsu(R.histogram(p)))


@query(f"""{_W}, {_OTSU}, {_LEVELS}, {_POLARITY},
l AS (SELECT lv.frame, dark_text, CASE WHEN dark_text THEN high ELSE low END AS bg, CASE WHEN dark_text THEN low ELSE high END AS fg FROM lv JOIN po USING (frame)),
k AS (SELECT px.frame, x, y, least(255, greatest(0, (CASE WHEN dark_text THEN bg - v ELSE v - bg END) * 255 // greatest(1, abs(bg - fg))))::INT AS ink FROM px JOIN l USING (frame))
SELECT frame, x, y, ink, (ink >= 128)::INT AS mask FROM k""")
def ink_planes(spark, d):
    return R.ink(pixels(spark, d))


@query(f"""{_W}, {_OTSU}, {_MASK}, q AS (SELECT frame, x + dx AS qx, y + dy AS qy, sum(1 << (2 * dy + dx)) AS bits, count(*) AS k FROM mk, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dy, dx) WHERE v = 1 GROUP BY ALL)
SELECT f.frame, coalesce((count(*) FILTER (k = 1) - count(*) FILTER (k = 3) - 2 * count(*) FILTER (bits IN (6, 9))) // 4, 0)::INT AS euler FROM (SELECT DISTINCT frame FROM mk) f LEFT JOIN q USING (frame) GROUP BY f.frame""")
def euler_numbers(spark, d):
    return R.euler_number(_mask(spark, d))


@query(f"{_W}, {_OTSU}, {_MASK}, {_RUNS} SELECT frame, y, x0, x1, v FROM rn")
def run_lengths(spark, d):
    return R.runs(_mask(spark, d))


def _comp(slack: int) -> str:
    return f"""{_W}, {_OTSU}, {_MASK}, {_RUNS},
r1 AS (SELECT frame, y, x0, x1, row_number() OVER (PARTITION BY frame ORDER BY y, x0) AS i FROM rn WHERE v = 1),
ad AS (SELECT a.frame, a.i AS u, b.i AS w FROM r1 a JOIN r1 b ON a.frame = b.frame AND abs(a.y - b.y) = 1 AND a.x0 < b.x1 + {slack} AND b.x0 < a.x1 + {slack}),
rc AS (SELECT frame, i, i AS r FROM r1 UNION SELECT rc.frame, ad.w, rc.r FROM rc JOIN ad ON rc.frame = ad.frame AND rc.i = ad.u AND rc.r < ad.w),
rr AS (SELECT frame, i, min(r) AS r FROM rc GROUP BY ALL),
lb AS (SELECT r1.*, (dense_rank() OVER (PARTITION BY r1.frame ORDER BY r) - 1)::INT AS comp FROM r1 JOIN rr USING (frame, i)),
cp AS (SELECT frame, comp, min(x0) AS x, min(y) AS y, max(x1) - min(x0) AS w, max(y) - min(y) + 1 AS h, sum(x1 - x0)::BIGINT AS area FROM lb GROUP BY ALL)"""


@query(f"{_comp(1)} SELECT frame, comp, x, y, w, h, area FROM cp")
def components_8(spark, d):
    return R.components(_labelled(spark, d))


@query(f"{_comp(0)} SELECT frame, comp, x, y, w, h, area FROM cp")
def components_4(spark, d):
    return R.components(_labelled(spark, d, 4))


@query(f"""{_comp(1)} SELECT lb.frame, lb.comp, sum(CASE WHEN lb.y < cp.y + 1 OR lb.y >= cp.y + h - 1 THEN x1 - x0 ELSE greatest(0, least(x1, x + 1) - x0) + greatest(0, x1 - greatest(x0, x + w - 1)) END)::BIGINT AS on_border, max(area) AS area
FROM lb JOIN cp USING (frame, comp) GROUP BY ALL""")
def border_shares(spark, d):
    return R.border_share(_labelled(spark, d), 1)


@query(f"""{_comp(1)}, sg AS (SELECT DISTINCT lb.frame, comp FROM lb JOIN px ON px.frame = lb.frame AND px.y = lb.y AND px.x >= x0 AND px.x < x1 WHERE px.v > 190)
SELECT lb.frame, y, x0, x1, comp FROM lb JOIN sg USING (frame, comp)""")
def hysteresis_edges(spark, d):
    p = pixels(spark, d)
    strong = R.runs(p.select("frame", "x", "y", (F.col("v") > 190).cast("int").alias("v"))).where("v = 1")
    return R.hysteresis(_labelled(spark, d), strong).select("frame", "y", "x0", "x1", "comp")


@query(f"""{_W} SELECT frame, x // 4 AS cx, y // 4 AS cy, count(DISTINCT v) AS colours, count(*) AS n, (count(*) * sum(v * v) - sum(v) * sum(v))::BIGINT AS n2_variance FROM px GROUP BY ALL""")
def colour_cells(spark, d):
    return R.cell_colours(pixels(spark, d), 4)


@query(f"""{_W} SELECT p.frame, p.x, p.y, CASE WHEN p.y >= 2 AND p.y < 5 AND p.x >= 3 AND p.x < 6 THEN (a.v * (4 - (p.x - 2)) + b.v * (p.x - 2)) // 4 ELSE p.v END AS v
FROM px p JOIN px a ON a.frame = p.frame AND a.y = p.y AND a.x = 2 JOIN px b ON b.frame = p.frame AND b.y = p.y AND b.x = 6""")
def cursor_inpainted(spark, d):
    return R.exploded(R.inpainted(_rows(spark, d), 3, 2, 3, 3))


@query(f"""{_W} SELECT frame, x - 2 AS x, y - 1 AS y, v FROM px WHERE x >= 2 AND x < 6 AND y >= 1 AND y < 8""")
def cropped(spark, d):
    return R.exploded(R.cropped(_rows(spark, d), 2, 1, 4, 20))


@query(f"""{_W} SELECT frame, (list_sort(list(v)))[count(*) // 2 + 1] AS median FROM px WHERE x IN (0, 7) OR y IN (0, 7) GROUP BY frame""")
def border_medians(spark, d):
    p = pixels(spark, d)
    sizes = p.groupBy("frame").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return R.border(p, sizes).groupBy("frame").agg(R.upper_median(F.col("v")).alias("median"))
