"""Queries over boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions.geometry import Box, centre_within, union_of
from rasterlake.operators import boxes as B
from rasterlake.plans.adapters import FOUND_BOXES_SQL, TEXT_LINES_SQL, TRUE_BOXES_SQL, found_boxes, text_lines, true_boxes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_TF = f"WITH RECURSIVE {TRUE_BOXES_SQL}, {FOUND_BOXES_SQL}"
_SHARED = """greatest(0, least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x))::BIGINT * greatest(0, least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y))"""
_PAIRS = f"""
pr AS (
  SELECT g.frame, g.id AS gid, p.id AS pid, {_SHARED} AS shared, g.w::BIGINT * g.h AS garea, p.w::BIGINT * p.h AS parea
  FROM tb g JOIN fb p ON g.frame = p.frame AND g.x < p.x + p.w AND p.x < g.x + g.w AND g.y < p.y + p.h AND p.y < g.y + g.h)"""


@query(f"""WITH {TRUE_BOXES_SQL}
SELECT frame, id, x + w AS "right", y + h AS bottom, w::BIGINT * h AS area, 2 * x + w AS cx2, 2 * y + h AS cy2,
  x - 3 AS gx, y - 3 AS gy, w + 6 AS gw, h + 6 AS gh,
  CASE WHEN x < 1600 AND y < 900 THEN least(x + w, 1600) - x ELSE 0 END AS cw, CASE WHEN x < 1600 AND y < 900 THEN least(y + h, 900) - y ELSE 0 END AS ch,
  x <= 800 AND 800 < x + w AND y <= 400 AND 400 < y + h AS has_middle,
  x + w // 2 >= 395 AND x + w // 2 <= 905 AS in_span
FROM tb""")
def box_scalars(spark, d):
    b = Box.named()
    g, c = b.inflate(3), b.clip(F.lit(1600), F.lit(900))
    return true_boxes(spark, d).select(
        "frame", "id", b.right.alias("right"), b.bottom.alias("bottom"), b.area.alias("area"), b.centre_x2.alias("cx2"), b.centre_y2.alias("cy2"),
        g.x.alias("gx"), g.y.alias("gy"), g.w.alias("gw"), g.h.alias("gh"), c.w.alias("cw"), c.h.alias("ch"),
        b.contains_point(F.lit(800), F.lit(400)).alias("has_middle"), centre_within(b, Box(F.lit(400), F.lit(0), F.lit(500), F.lit(1)), 5).alias("in_span"),
    )


@query(f"""{_TF}, {_PAIRS}
SELECT frame, gid, pid, shared, round(shared::DOUBLE / (garea + parea - shared), 9) AS iou FROM pr WHERE gid = pid""")
def box_iou(spark, d):
    p = B.overlapping(true_boxes(spark, d), found_boxes(spark, d)).where("gid = pid")
    return p.select("frame", "gid", "pid", "shared", F.round(F.col("shared") / (F.col("garea") + F.col("parea") - F.col("shared")), 9).alias("iou"))


@query(f"""WITH {TRUE_BOXES_SQL}
SELECT frame, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM tb GROUP BY frame""")
def box_union(spark, d):
    return true_boxes(spark, d).groupBy("frame").agg(*union_of(), F.count(F.lit(1)).alias("n"))


@query(f"""{_TF}, {_PAIRS}
SELECT frame, count(*) AS pairs, sum(shared)::BIGINT AS shared FROM pr GROUP BY frame""")
def box_overlap_join(spark, d):
    return B.overlapping(true_boxes(spark, d), found_boxes(spark, d)).groupBy("frame").agg(F.count(F.lit(1)).alias("pairs"), F.sum("shared").alias("shared"))


_FOREST = """
ct AS (
  SELECT i.frame, i.id, o.id AS c, o.w::BIGINT * o.h AS area
  FROM tb i JOIN tb o ON i.frame = o.frame AND i.x >= o.x AND i.y >= o.y AND i.x + i.w <= o.x + o.w AND i.y + i.h <= o.y + o.h
    AND (o.w::BIGINT * o.h > i.w::BIGINT * i.h OR (o.w::BIGINT * o.h = i.w::BIGINT * i.h AND o.id < i.id))),
pa AS (SELECT frame, id, c AS parent FROM ct QUALIFY row_number() OVER (PARTITION BY frame, id ORDER BY area, c DESC) = 1),
fp AS (SELECT tb.frame, tb.id, coalesce(parent, -1)::INT AS parent FROM tb LEFT JOIN pa USING (frame, id)),
dp AS (SELECT frame, id, parent, 0 AS depth FROM fp WHERE parent < 0 UNION ALL SELECT fp.frame, fp.id, fp.parent, dp.depth + 1 FROM fp JOIN dp ON fp.frame = dp.frame AND fp.parent = dp.id)"""


@query(f"{_TF}, {_FOREST} SELECT frame, id, parent, depth FROM dp")
def box_forest(spark, d):
    return B.forest(true_boxes(spark, d))


@query(f"""{_TF}, {_PAIRS}, bi AS (SELECT frame, gid, pid, shared::DOUBLE / (garea + parea - shared) AS iou FROM pr),
b AS (SELECT * FROM bi QUALIFY row_number() OVER (PARTITION BY frame, gid ORDER BY iou DESC, pid) = 1)
SELECT tb.frame, tb.id, coalesce(b.pid, -1)::INT AS pid, round(coalesce(b.iou, 0), 9) AS best FROM tb LEFT JOIN b ON tb.frame = b.frame AND tb.id = b.gid""")
def box_best_iou(spark, d):
    gt = true_boxes(spark, d)
    return B.best_iou(gt, B.overlapping(gt, found_boxes(spark, d))).withColumn("best", F.round("best", 9))


@query(f"""{_TF}, {_PAIRS}, bi AS (SELECT frame, gid, pid, shared::DOUBLE / (garea + parea - shared) AS iou FROM pr),
b AS (SELECT * FROM bi WHERE iou >= 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY frame, gid ORDER BY iou DESC, pid) = 1)
SELECT tb.frame, tb.id, coalesce(b.pid, -1)::INT AS pid, coalesce('box ' || b.pid, '') AS text FROM tb LEFT JOIN b ON tb.frame = b.frame AND tb.id = b.gid""")
def box_readings(spark, d):
    read = found_boxes(spark, d).withColumn("text", F.concat(F.lit("box "), F.col("id").cast("string")))
    return B.readings(true_boxes(spark, d), read)


_GREEDY = """
cd AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY shared::DOUBLE / (garea + parea - shared) DESC, gid, pid) AS k FROM pr WHERE 2 * shared >= garea + parea - shared),
st AS (
  SELECT frame, k, gid, pid, shared, garea, parea, true AS ok, [gid] AS us, [pid] AS vs FROM cd WHERE k = 1
  UNION ALL
  SELECT frame, k, gid, pid, shared, garea, parea, free, CASE WHEN free THEN list_append(us, gid) ELSE us END, CASE WHEN free THEN list_append(vs, pid) ELSE vs END FROM (
    SELECT c.frame, c.k, c.gid, c.pid, c.shared, c.garea, c.parea, us, vs, NOT list_contains(us, c.gid) AND NOT list_contains(vs, c.pid) AS free FROM st JOIN cd c ON c.frame = st.frame AND c.k = st.k + 1)),
m AS (SELECT frame, gid, pid, shared, garea + parea - shared AS joint FROM st WHERE ok)"""


@query(f"{_TF}, {_PAIRS}, {_GREEDY} SELECT frame, gid, pid FROM m")
def box_matches(spark, d):
    return B.matches(B.overlapping(true_boxes(spark, d), found_boxes(spark, d)), 1, 2)


@query(f"""{_TF}, {_PAIRS}, {_GREEDY},
b AS (SELECT frame, gid, max(shared::DOUBLE / (garea + parea - shared)) AS best FROM pr GROUP BY ALL),
c AS (SELECT (SELECT count(*) FROM tb) AS n_gt, (SELECT count(*) FROM fb) AS n_pred, (SELECT count(*) FROM m) AS tp50, (SELECT count(*) FROM m WHERE 4 * shared >= 3 * joint) AS tp75,
  (SELECT sum(floor(best * 1000000 + 0.5::DOUBLE))::BIGINT FROM b) AS iou6)
SELECT n_gt, n_pred, tp50, tp75, round(tp50 / n_gt, 9) AS recall50, round(tp75 / n_gt, 9) AS recall75, round(tp50 / n_pred, 9) AS precision50, round(2 * tp50 / (n_gt + n_pred), 9) AS f1_50,
  round(iou6 / n_gt / 1e6::DOUBLE, 9) AS mean_best_iou FROM c""")
def detection_score(spark, d):
    s = B.detection_score(true_boxes(spark, d), found_boxes(spark, d))
    return s.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in s.dtypes))


@query(f"""{_TF}, {_PAIRS},
o AS (SELECT frame, gid, count(*) AS n, sum(shared) AS covered FROM pr WHERE 2 * shared >= parea GROUP BY ALL),
l AS (SELECT coalesce(o.n, 0) AS n, least(1000000, coalesce(covered, 0) * 1000000 // (w::BIGINT * h)) AS share FROM tb LEFT JOIN o ON tb.frame = o.frame AND tb.id = o.gid),
c AS (SELECT count(*) AS n FROM pr WHERE 2 * shared >= garea GROUP BY frame, pid)
SELECT count(*) AS n_gt, count(*) FILTER (n = 1) AS one_to_one, count(*) FILTER (n > 1) AS split, count(*) FILTER (n = 0) AS miss, sum(share)::BIGINT AS overlap_ppm,
  (SELECT count(*) FROM c WHERE n > 1) AS "merge", (SELECT count(*) FROM fb) AS n_pred FROM l""")
def grouping_score(spark, d):
    return B.grouping_counts(true_boxes(spark, d), found_boxes(spark, d))


_FOUND_FOREST = _FOREST.replace("tb", "fb").replace("ct AS", "ct2 AS").replace("FROM ct ", "FROM ct2 ").replace("pa AS", "pa2 AS").replace("JOIN pa ", "JOIN pa2 ").replace("fp", "fp2").replace("dp", "dp2")


@query(f"""{_TF}, {_PAIRS}, {_GREEDY}, {_FOREST}, {_FOUND_FOREST},
r AS (
  SELECT a.depth = b.depth AS same, CASE WHEN a.parent < 0 THEN b.parent < 0 ELSE coalesce(u.pid = b.parent AND b.parent >= 0, false) END AS ok
  FROM m JOIN dp a ON a.frame = m.frame AND a.id = m.gid JOIN dp2 b ON b.frame = m.frame AND b.id = m.pid LEFT JOIN m u ON u.frame = m.frame AND u.gid = a.parent)
SELECT count(*) AS matched, count(*) FILTER (same) AS same_depth, count(*) FILTER (ok) AS parent_ok, round(count(*) FILTER (same) / count(*), 9) AS depth_precision, round(count(*) FILTER (ok) / count(*), 9) AS parent_precision FROM r""")
def depth_score(spark, d):
    s = B.depth_score(true_boxes(spark, d), found_boxes(spark, d))
    return s.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in s.dtypes))


_LINE = f"WITH RECURSIVE {TRUE_BOXES_SQL}, {TEXT_LINES_SQL}"


def _line_links(gap: int) -> str:
    return f"""
lk AS (
  SELECT a.frame, a.id AS u, b.id AS v FROM tl a JOIN tl b ON a.frame = b.frame AND (a.x, a.y, a.id) < (b.x, b.y, b.id)
    AND b.x <= a.x + a.w + ({gap} * a.h + 500) // 1000 AND 1000 * greatest(a.h, b.h) <= 2600 * least(a.h, b.h)
    AND 1000 * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) >= 550 * least(a.h, b.h)
    AND (b.x - a.x - a.w) * 1000 <= {gap} * greatest(a.h, b.h))"""


_REACH = """
ed AS (SELECT frame, u, v FROM lk UNION ALL SELECT frame, v, u FROM lk),
rc AS (SELECT frame, id, id AS r FROM tl UNION SELECT rc.frame, ed.v, rc.r FROM rc JOIN ed ON rc.frame = ed.frame AND rc.id = ed.u AND rc.r < ed.v),
gr AS (SELECT frame, id, min(r)::INT AS grp FROM rc GROUP BY ALL)
SELECT gr.frame, grp, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM gr JOIN tl USING (frame, id) GROUP BY gr.frame, grp"""


@query(f"{_LINE}, {_line_links(550)} SELECT frame, u, v FROM lk")
def word_links(spark, d):
    return B.line_links(text_lines(spark, d), 550)


@query(f"{_LINE}, {_line_links(1250)}, {_REACH}")
def line_groups(spark, d):
    boxes = text_lines(spark, d)
    return B.grouped(boxes, B.line_links(boxes, 1250))


@query(f"""{_LINE},
lk AS (
  SELECT a.frame, a.id AS u, b.id AS v FROM tl a JOIN tl b ON a.frame = b.frame AND (a.y, a.x, a.id) < (b.y, b.x, b.id)
    AND b.y >= a.y + a.h - a.h // 3 AND (b.y - a.y - a.h) * 1000 <= 900 * a.h AND 2 * greatest(a.h, b.h) <= 3 * least(a.h, b.h)
    AND (abs(a.x - b.x) <= least(a.h, b.h) OR least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= least(a.w, b.w) * 3 // 4)), {_REACH}""")
def block_groups(spark, d):
    boxes = text_lines(spark, d)
    return B.grouped(boxes, B.block_links(boxes))


@query(f"""WITH {TRUE_BOXES_SQL}, {TEXT_LINES_SQL}
SELECT a.frame, a.id, a.x, a.y, a.w, a.h FROM tl a WHERE EXISTS (
  SELECT 1 FROM tb b WHERE a.frame = b.frame AND b.x <= a.x + a.w // 2 AND a.x + a.w // 2 < b.x + b.w AND b.y <= a.y + a.h // 2 AND a.y + a.h // 2 < b.y + b.h)""")
def words_in_lines(spark, d):
    return B.kept_by_centre(text_lines(spark, d), true_boxes(spark, d))


@query(f"""WITH RECURSIVE {TRUE_BOXES_SQL}, st AS (
  SELECT frame, id, true AS kept, [struct_pack(x := x, y := y, w := w, h := h)] AS held FROM tb WHERE id = 0
  UNION ALL
  SELECT frame, id, ok, CASE WHEN ok THEN list_append(held, b) ELSE held END FROM (
    SELECT t.frame, t.id, struct_pack(x := t.x, y := t.y, w := t.w, h := t.h) AS b, st.held, len(list_filter(list_transform(st.held, lambda k: struct_pack(
      s := greatest(0, least(k.x + k.w, t.x + t.w) - greatest(k.x, t.x))::BIGINT * greatest(0, least(k.y + k.h, t.y + t.h) - greatest(k.y, t.y)), a := k.w::BIGINT * k.h + t.w::BIGINT * t.h)),
      lambda m: 2 * m.s > m.a - m.s)) = 0 AS ok
    FROM st JOIN tb t ON t.frame = st.frame AND t.id = st.id + 1))
SELECT frame, id, x, y, w, h FROM st JOIN tb USING (frame, id) WHERE kept""")
def containers_deduped(spark, d):
    return B.deduped_greedily(true_boxes(spark, d), 1, 2)
