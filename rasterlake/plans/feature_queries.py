"""Queries for features of crops, line fits and formula regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import fits, shapes
from rasterlake.plans.adapters import PIXELS_SQL, bitmaps, table, text_lines
from rasterlake.plans.raster_queries import _RUNS, _comp

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query()
def shape_descriptors(spark, d):
    return bitmaps(spark, d).select("vec_id", shapes.shape_of(F.col("v"), F.lit(8)).alias("s")).select("vec_id", "s.*")


# the control is the component of what stands out from the border that has the largest box; of its middle, the spread counts
_CONTROLS = f"""WITH RECURSIVE {PIXELS_SQL},
bd AS (SELECT frame, list(v ORDER BY v) AS s FROM px WHERE x IN (0, 7) OR y IN (0, 7) GROUP BY frame),
mk AS (SELECT px.frame, x, y, (abs(v - s[len(s) // 2 + 1]) > 40)::INT AS v FROM px JOIN bd USING (frame)), {_RUNS},{_comp(1).partition(_RUNS + ",")[2]},
bx AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY frame ORDER BY w * h DESC, comp) = 1),
ct AS (SELECT bd.frame, CASE WHEN ok THEN x ELSE 0 END AS x, CASE WHEN ok THEN y ELSE 0 END AS y, CASE WHEN ok THEN w ELSE 8 END AS w, CASE WHEN ok THEN h ELSE 8 END AS h
  FROM bd LEFT JOIN (SELECT *, w >= 2 AND h >= 2 AS ok FROM bx) USING (frame)),
md AS (SELECT *, greatest(1, floor(w * 0.6::DOUBLE))::INT AS iw, greatest(1, floor(h * 0.6::DOUBLE))::INT AS ih FROM ct),
sp AS (
  SELECT md.frame, list(v ORDER BY v) AS s FROM md JOIN px ON px.frame = md.frame
    AND px.x >= md.x + (w - iw) // 2 AND px.x < md.x + (w - iw) // 2 + iw AND px.y >= md.y + (h - ih) // 2 AND px.y < md.y + (h - ih) // 2 + ih GROUP BY md.frame),
sd AS (SELECT frame, s[(95 * len(s) + 99) // 100] - s[(5 * len(s) + 99) // 100] AS spread FROM sp)"""


@query(f"""{_CONTROLS} SELECT frame AS vec_id, CASE WHEN spread > 40 THEN 'checked' ELSE 'unchecked' END AS value, round(least(1.0::DOUBLE, 0.5::DOUBLE + abs(spread - 40) / 120.0::DOUBLE), 6) AS score FROM sd""")
def check_states(spark, d):
    return bitmaps(spark, d).select("vec_id", shapes.state_of(F.col("v"), F.lit(8)).alias("s")).select("vec_id", "s.value", F.round("s.score", 6).alias("score"))


# 8 by 8 pixels fill 2 by 2 cells each of a 16 by 16 grid, which weights 1 2 1 smooth along both axes; then the brightest
# cell is 255. Euler number from 2 by 2 quads; components from runs that touch, corners too.
_GLYPHS = f"""WITH RECURSIVE {PIXELS_SQL},
mk AS (SELECT frame, x, y, (v >= 128)::INT AS v FROM px), {_RUNS},
r1 AS (SELECT frame, y, x0, x1, row_number() OVER (PARTITION BY frame ORDER BY y, x0) AS i FROM rn WHERE v = 1),
ad AS (SELECT a.frame, a.i AS u, b.i AS w FROM r1 a JOIN r1 b ON a.frame = b.frame AND abs(a.y - b.y) = 1 AND a.x0 < b.x1 + 1 AND b.x0 < a.x1 + 1),
rc AS (SELECT frame, i, i AS r FROM r1 UNION SELECT rc.frame, ad.w, rc.r FROM rc JOIN ad ON rc.frame = ad.frame AND rc.i = ad.u AND rc.r < ad.w),
nc AS (SELECT frame, count(*) AS n FROM (SELECT frame, i, min(r) AS r FROM rc GROUP BY ALL) WHERE i = r GROUP BY frame),
q AS (SELECT frame, x + dx AS qx, y + dy AS qy, sum(1 << (2 * dy + dx)) AS bits, count(*) AS k FROM mk, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dy, dx) WHERE v = 1 GROUP BY ALL),
eu AS (SELECT frame, (count(*) FILTER (k = 1) - count(*) FILTER (k = 3) - 2 * count(*) FILTER (bits IN (6, 9))) // 4 AS e FROM q GROUP BY frame),
ce AS (
  SELECT frame, 2 * x + a + dx AS cx, 2 * y + b + dy AS cy, sum(v * (2 - abs(dx)) * (2 - abs(dy)))::BIGINT AS g
  FROM px, (VALUES (0), (1)) AS s(a), (VALUES (0), (1)) AS t(b), (VALUES (-1), (0), (1)) AS u(dx), (VALUES (-1), (0), (1)) AS w(dy) GROUP BY ALL),
ic AS (SELECT * FROM ce WHERE cx BETWEEN 0 AND 15 AND cy BETWEEN 0 AND 15),
nm AS (SELECT frame, cx, cy, CASE WHEN m > 0 THEN floor(least(255.0::DOUBLE, g::DOUBLE * (255.0::DOUBLE / m::DOUBLE) + 0.5::DOUBLE))::INT ELSE 0 END AS b FROM (SELECT *, max(g) OVER (PARTITION BY frame) AS m FROM ic)),
bl AS (SELECT frame, cy // 4 AS gy, cx // 4 AS gx, sum(b)::INT AS c FROM nm GROUP BY ALL),
va AS (SELECT frame, list(b ORDER BY cy, cx) AS bmp FROM nm GROUP BY frame), vc AS (SELECT frame, list(c ORDER BY gy, gx) AS coarse FROM bl GROUP BY frame),
fs AS (SELECT va.frame AS vec_id, bmp, coarse, greatest(-3, least(3, coalesce(e, 0)))::INT AS euler, least(4, coalesce(n, 0))::INT AS ncomp FROM va JOIN vc USING (frame) LEFT JOIN eu USING (frame) LEFT JOIN nc USING (frame)),
ft AS (SELECT *, greatest(0, least(3, ncomp - euler))::INT AS holes FROM fs)"""


@query(f"""{_GLYPHS} SELECT vec_id, array_to_string(bmp, ',') AS bmp, array_to_string(coarse, ',') AS coarse, 0.0::DOUBLE AS log_aspect, euler, ncomp, holes FROM ft""")
def glyph_features(spark, d):
    f = bitmaps(spark, d).select("vec_id", shapes.glyph_of(F.col("v"), F.lit(8)).alias("s")).select("vec_id", "s.*")
    return f.withColumn("bmp", F.array_join("bmp", ",")).withColumn("coarse", F.array_join("coarse", ","))


@query(f"""{_GLYPHS}, nx AS (SELECT a.vec_id, 6 * abs(a.holes - b.holes) + 10 * abs(a.ncomp - b.ncomp) AS s, a.bmp AS x, b.bmp AS y, a.coarse AS cx, b.coarse AS cy FROM ft a JOIN ft b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) / 255.0::DOUBLE + s, 6) AS dist,
  round(list_sum(list_transform(list_zip(cx, cy), lambda z: abs(z[1] - z[2]))) / 255.0::DOUBLE + s, 6) AS bound FROM nx""")
def glyph_bounds(spark, d):
    a = bitmaps(spark, d).select("vec_id", shapes.glyph_of(F.col("v"), F.lit(8)).alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    both = a.join(b, "vec_id").select("vec_id", shapes.glyph_distance(F.col("a"), F.col("b")).alias("dist"), shapes.glyph_bound(F.col("a"), F.col("b")).alias("bound"))
    return both.select("vec_id", F.round("dist", 6).alias("dist"), F.round("bound", 6).alias("bound"))


@query("""WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, count(*) AS n, CASE WHEN regexp_matches(ch, '^[a-zA-Z0-9]$') OR instr('()[]+-=,.|/''', ch) > 0 THEN 0 WHEN (ch >= 'α' AND ch <= 'ω') OR (ch >= 'Γ' AND ch <= 'Ω') THEN 1
  WHEN instr('∑∏∫∂∞±×≤≥→∈≡≈∼⋅′<>{};:!*', ch) > 0 THEN 2 ELSE 5 END::DOUBLE AS prior FROM c WHERE ch <> '' GROUP BY ch""")
def math_priors(spark, d):
    chars = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return chars.select("ch", "n", fits.math_prior(F.col("ch")).alias("prior"))


@query("""WITH r AS (SELECT user_id AS grp, (event_id % 7)::DOUBLE AS rel, 100 + 20 * (event_id % 7)::DOUBLE + value / 10 AS obs FROM events),
a AS (SELECT grp, regr_intercept(obs, rel) AS b, regr_slope(obs, rel) AS s FROM r GROUP BY grp HAVING regr_slope(obs, rel) > 2),
n AS (SELECT r.* FROM r JOIN a USING (grp) WHERE abs(obs - b - rel * s) < 0.35::DOUBLE * s),
t AS (SELECT grp, regr_intercept(obs, rel) AS b, regr_slope(obs, rel) AS s FROM n GROUP BY grp HAVING regr_slope(obs, rel) > 2)
SELECT a.grp, round(coalesce(t.b, a.b), 6) AS baseline, round(coalesce(t.s, a.s), 6) AS size FROM a LEFT JOIN t USING (grp)""")
def line_fits(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("grp"), F.expr("cast(event_id % 7 as double)").alias("rel"), F.expr("100 + 20 * cast(event_id % 7 as double) + value / 10").alias("obs"))
    return fits.line_fits(rows).select("grp", F.round("baseline", 6).alias("baseline"), F.round("size", 6).alias("size"))


@query()
def formula_regions(spark, d):
    """Regions of all text boxes; a connected component a frame is too slow in SQL, so tests hold it to brute force."""
    return fits.formula_regions(text_lines(spark, d).withColumn("candidate", F.expr("id % 3 = 0")), 80)
