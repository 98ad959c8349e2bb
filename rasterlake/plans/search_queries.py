"""Queries for nearest templates, packs and tags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterlake.operators import knn, packs
from rasterlake.plans.adapters import BITMAPS_SQL, bitmaps, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _sides(spark, d):
    rows = bitmaps(spark, d)
    q = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), "v")
    t = rows.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), "v")
    return q, t


_SAD = "list_sum(list_transform(list_zip(q.v, t.v), lambda z: abs(z[1] - z[2])))::BIGINT"
_DIST = f"WITH {BITMAPS_SQL}, ds AS (SELECT q.vec_id AS query, t.label::BIGINT AS label, t.vec_id AS tmpl, {_SAD} AS dist FROM bm q, bm t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0)"


@query(f"""{_DIST}, b AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY dist, tmpl) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, tmpl)::INT AS rk, min(dist) OVER (PARTITION BY query) AS best FROM b)
SELECT query, label, dist, tmpl, rk FROM r WHERE rk <= 4 AND dist <= best + 120""")
def knn_top_labels(spark, d):
    return knn.nearest_labels(*_sides(spark, d))


@query(f"""{_DIST} SELECT query, label, dist, tmpl, row_number() OVER (PARTITION BY query ORDER BY dist, tmpl)::INT AS rk FROM ds QUALIFY rk <= 5""")
def knn_neighbours(spark, d):
    return knn.neighbours(*_sides(spark, d), 5)


@query(f"""{_DIST}, n AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, tmpl) <= 5),
b AS (SELECT query, label, count(*) AS n, sum(dist)::BIGINT AS dist_sum, sum(1.0::DOUBLE / (1 + dist)) AS weight FROM n GROUP BY ALL),
c AS (SELECT *, weight / sum(weight) OVER (PARTITION BY query) AS confidence FROM b)
SELECT query, label, n, dist_sum, round(confidence, 9) AS confidence, row_number() OVER (PARTITION BY query ORDER BY round(confidence, 9) DESC, label)::INT AS rk FROM c""")
def knn_votes(spark, d):
    return knn.votes(*_sides(spark, d)).select("query", "label", "n", "dist_sum", F.round("confidence", 9).alias("confidence"), "rk")


_CELLS = "[" + ", ".join("+".join(f"{{v}}[{(2 * cy + dy) * 8 + 2 * cx + dx + 1}]" for dy in (0, 1) for dx in (0, 1)) for cy in range(4) for cx in range(4)) + "]"


@query(f"""WITH {BITMAPS_SQL}, nx AS (SELECT vec_id, v, lead(v) OVER (ORDER BY vec_id) AS o FROM bm)
SELECT vec_id, list_sum(list_transform(list_zip(v, o), lambda z: abs(z[1] - z[2])))::INT AS dist,
  list_sum(list_transform(list_zip({_CELLS.format(v="v")}, {_CELLS.format(v="o")}), lambda z: abs(z[1] - z[2])))::INT AS bound FROM nx WHERE o IS NOT NULL""")
def coarse_bounds(spark, d):
    a = bitmaps(spark, d).select("vec_id", "v")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("o"))
    return a.join(b, "vec_id").select("vec_id", knn.l1_distance(F.col("v"), F.col("o")).alias("dist"), knn.coarse_bound(F.col("v"), F.col("o")).alias("bound"))


def _featured(spark, d, *names: str):
    """The sides with scalars made of the ids: aspects in eighths, holes and components; or aspect and fill."""
    own = {"aspect": "cast(vec_id % 9 as double) / 4 - cast(label as double) / 8", "holes": "cast(vec_id % 4 as double)", "parts": "cast(1 + vec_id % 3 as double)", "fill": "cast(vec_id % 11 as double) / 16"}
    rows = bitmaps(spark, d).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), "v", F.array(*[F.expr(own[n]) for n in names]).alias("s"))
    return rows.where("id % 5 = 0").select("id", "v", "s"), rows.where("id % 5 <> 0")


_ASPECT = "abs((q.vec_id % 9)::DOUBLE / 4 - q.label::DOUBLE / 8 - ((t.vec_id % 9)::DOUBLE / 4 - t.label::DOUBLE / 8))"
_GLYPH = f"round({_SAD}::DOUBLE / 255 + (14.0::DOUBLE * {_ASPECT} + 6.0::DOUBLE * abs(q.vec_id % 4 - t.vec_id % 4) + 10.0::DOUBLE * abs(q.vec_id % 3 - t.vec_id % 3)), 9)"
_SIDES = f"WITH {BITMAPS_SQL}, ds AS (SELECT q.vec_id AS query, t.label::BIGINT AS label, t.vec_id AS tmpl, {{}} AS dist FROM bm q, bm t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0)"


@query(f"""{_SIDES.format(_GLYPH)}, b AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY dist, tmpl) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, tmpl)::INT AS rk, min(dist) OVER (PARTITION BY query) AS best FROM b)
SELECT query, label, round(dist, 6) AS dist, tmpl, rk FROM r WHERE rk <= 4 AND dist <= round(best + 15, 9)""")
def nearest_glyphs(spark, d):
    """The whole distance of glyphs: pixels, aspect, holes and components; the 4 best labels within 15."""
    return knn.nearest_glyphs(*_featured(spark, d, "aspect", "holes", "parts")).withColumn("dist", F.round("dist", 6))


_SPLIT = "list_sum(list_transform(list_zip(q.v, t.v, range(1, 65)), lambda z: abs(z[1] - z[2]) * CASE WHEN z[3] <= 48 THEN 10 ELSE 6 END))::BIGINT"
_SHAPE = f"round({_SPLIT}::DOUBLE / 2550 + (40.0::DOUBLE * {_ASPECT} + 60.0::DOUBLE * abs((q.vec_id % 11)::DOUBLE / 16 - (t.vec_id % 11)::DOUBLE / 16)), 9)"


@query(f"""{_SIDES.format(_SHAPE)}, n AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, tmpl) <= 5),
b AS (SELECT query, label, count(*) AS n, round(sum(dist), 6) AS dist_sum, sum(1.0::DOUBLE / (1 + dist)) AS weight FROM n GROUP BY ALL),
c AS (SELECT *, weight / sum(weight) OVER (PARTITION BY query) AS confidence FROM b)
SELECT query, label, n, dist_sum, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY query ORDER BY round(confidence, 9) DESC, label)::INT AS rk FROM c""")
def shape_votes(spark, d):
    """Votes of the 5 nearest exemplars by the distance of shapes: 48 values as orientations, 16 as ink, aspect and fill."""
    weighed = F.transform("v", lambda x, i: x * F.when(i < 48, 10).otherwise(6))
    q, t = (side.withColumn("v", weighed) for side in _featured(spark, d, "aspect", "fill"))
    return knn.shape_votes(q, t).select("query", "label", "n", F.round("dist_sum", 6).alias("dist_sum"), F.round("confidence", 6).alias("confidence"), "rk")


@query(f"""WITH RECURSIVE {BITMAPS_SQL}, o AS (SELECT vec_id, label::BIGINT AS label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM bm WHERE vec_id % 5 <> 0),
st AS (
  SELECT label, k, vec_id, true AS kept, [v] AS held FROM o WHERE k = 1
  UNION ALL
  SELECT label, k, vec_id, ok, CASE WHEN ok THEN list_append(held, v) ELSE held END FROM (
    SELECT o.label, o.k, o.vec_id, o.v, st.held, len(list_filter(st.held, lambda h: list_sum(list_transform(list_zip(h, o.v), lambda z: abs(z[1] - z[2]))) <= 1700)) = 0 AS ok
    FROM st JOIN o ON o.label = st.label AND o.k = st.k + 1))
SELECT vec_id AS id, label FROM st WHERE kept""")
def templates_pruned(spark, d):
    return knn.pruned(_sides(spark, d)[1], 1700)


def _held_out(spark, d):
    rows = bitmaps(spark, d).withColumn("out", packs.every_nth(None, "label", "vec_id", 5))
    q = rows.where("out").select(F.col("vec_id").alias("id"), "v")
    t = rows.where("not out").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), "v")
    top = knn.votes(q, t, 3).where("rk = 1").select(F.col("query").alias("vec_id"), F.col("label").alias("pred"))
    return rows.where("out").select("vec_id", F.col("label").cast("long").alias("gt")).join(top, "vec_id")


_HOLD = f"""WITH {BITMAPS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) % 5 = 0 AS held FROM bm),
ds AS (SELECT q.vec_id AS query, q.label::BIGINT AS gt, t.label::BIGINT AS label, t.vec_id AS tmpl, {_SAD} AS dist FROM o q, o t WHERE q.held AND NOT t.held),
n AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, tmpl) <= 3),
b AS (SELECT query, gt, label, sum(1.0::DOUBLE / (1 + dist)) AS weight FROM n GROUP BY ALL),
c AS (SELECT *, weight / sum(weight) OVER (PARTITION BY query) AS confidence FROM b),
p AS (SELECT query, gt, label AS pred FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(confidence, 9) DESC, label) = 1),
m AS (SELECT gt, pred, count(*) AS n FROM p GROUP BY ALL)"""


@query(f"{_HOLD} SELECT gt, pred, n, sum(n) OVER (PARTITION BY gt)::BIGINT AS row_total, round(n / sum(n) OVER (PARTITION BY gt), 9) AS share FROM m")
def confusion_matrix(spark, d):
    return packs.confusion(_held_out(spark, d)).withColumn("share", F.round("share", 9))


@query(f"""{_HOLD}, w AS (SELECT gt, pred AS worst FROM m WHERE gt <> pred QUALIFY row_number() OVER (PARTITION BY gt ORDER BY n DESC, pred) = 1)
SELECT m.gt, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (gt = pred), 0)::BIGINT AS hits, any_value(worst) AS worst, round(coalesce(sum(n) FILTER (gt = pred), 0) / sum(n), 9) AS recall
FROM m LEFT JOIN w USING (gt) GROUP BY m.gt""")
def class_recall(spark, d):
    return packs.recall_by_class(_held_out(spark, d)).withColumn("recall", F.round("recall", 9))


@query("""SELECT user_id AS elem, event_type AS key, arg_max(props, (value, -event_id)) AS value, max(value) AS score FROM events GROUP BY ALL""")
def best_tags(spark, d):
    tags = table(spark, d, "events").select(F.lit(0).cast("long").alias("frame"), F.col("user_id").alias("elem"), F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return packs.best_tag(tags).drop("frame")


@query("""WITH a AS (SELECT user_id AS elem, arg_min(props, event_id) AS first FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT DISTINCT e.user_id AS elem FROM events e JOIN a ON a.elem = e.user_id WHERE a.first LIKE '%1}'""")
def scoped_by_tag(spark, d):
    ev = table(spark, d, "events")
    tags = ev.select(F.lit(0).alias("frame"), F.col("user_id").alias("elem"), F.col("event_type").alias("key"), F.when(F.col("props").like("%1}"), "yes").otherwise("no").alias("value"), F.col("event_id").alias("seq"))
    elements = ev.select(F.lit(0).alias("frame"), F.col("user_id").alias("elem"), F.lit("Icon").alias("kind"), F.lit(20).alias("w"), F.lit(20).alias("h")).distinct()
    return packs.Scope(kinds=("Icon",), needs="click", values=("yes",)).of(elements, tags).select("elem")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def tag_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def _chained(spark, q, t):
    elements = q.select(F.lit(0).cast("long").alias("frame"), F.col("id").alias("elem"), F.lit("Icon").alias("kind"), F.lit(16).alias("w"), F.lit(16).alias("h"), "v")
    vote = lambda e: knn.votes(e.select(F.col("elem").alias("id"), "v"), t, 3).select(F.lit(0).cast("long").alias("frame"), F.col("query").alias("elem"), F.col("label").cast("string").alias("value"), F.round("confidence", 9).alias("score"))
    reg = packs.Registry().add(packs.Pack("first", "kind", vote)).add(packs.Pack("second", "again", vote, packs.Scope(needs="kind")))
    none = spark.createDataFrame([], packs.TAG_SCHEMA)
    return packs.detect(elements, none, reg).select("elem", "key", "score", "source")


@query(f"""{_DIST}, n AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, tmpl) <= 3),
b AS (SELECT query, label, sum(1.0::DOUBLE / (1 + dist)) AS weight FROM n GROUP BY ALL), c AS (SELECT *, weight / sum(weight) OVER (PARTITION BY query) AS score FROM b),
t AS (SELECT query AS elem, max(round(score, 9)) AS score FROM c GROUP BY query HAVING max(round(score, 9)) >= 0.5)
SELECT elem, 'kind' AS key, score, 'first' AS source FROM t UNION ALL SELECT elem, 'again', score, 'second' FROM t""")
def packs_chained(spark, d):
    return _chained(spark, *_sides(spark, d))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rk,
  round(value / sum(value) OVER (PARTITION BY user_id), 6) AS share, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev,
  count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM events QUALIFY rk <= 7""")
def window_shares(spark, d):
    w = Window.partitionBy("user_id")
    ev = table(spark, d, "events")
    return ev.select(
        "user_id", "event_id", F.row_number().over(w.orderBy(F.desc("value"), "event_id")).alias("rk"), F.round(F.col("value") / F.sum("value").over(w), 6).alias("share"),
        F.lag("event_id").over(w.orderBy("event_id")).alias("prev"), F.count(F.lit(1)).over(w.orderBy("event_id").rowsBetween(-1, 1)).alias("near"),
    ).where("rk <= 7")
