"""Queries over texts, readings and formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterlake.functions import latex, text
from rasterlake.operators.cut import cut
from rasterlake.operators import scores
from rasterlake.plans.adapters import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_READ = "SELECT p_brand, p_name AS gt, translate(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END, 'eo1', 'c0l') AS pred FROM part"


def _readings(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_brand", F.col("p_name").alias("gt"), F.translate(name, "eo1", "c0l").alias("pred"))


_LEV = """sum(length(gt))::BIGINT AS chars, sum(levenshtein(gt, pred))::BIGINT AS edits, sum(levenshtein(lower(gt), lower(pred)))::BIGINT AS edits_ci,
count(*) FILTER (gt = pred) AS exact, count(*) FILTER (lower(gt) = lower(pred)) AS exact_ci"""


@query(f"""WITH r AS ({_READ}), s AS (SELECT p_brand, count(*) AS n, {_LEV} FROM r GROUP BY ALL)
SELECT *, edits / chars AS cer, edits_ci / chars AS cer_ci, exact / n AS em, exact_ci / n AS em_ci FROM s""")
def text_score(spark, d):
    return scores.text_score(_readings(spark, d), ["p_brand"])


@query("""SELECT item_id, levenshtein(text, translate(text, 'aei', 'iea')) AS edits, length(text) AS chars FROM benchmark""")
def edit_distances(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.levenshtein("text", F.translate("text", "aei", "iea")).alias("edits"), F.length("text").alias("chars"))


@query(f"""SELECT doc_id, md5(translate(text, '{text.UPPER}', '{text.LOWER}')) AS folded FROM documents""")
def case_folds(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_case(F.col("text")).cast("binary")).alias("folded"))


_CHARS = "SELECT unnest(string_split(text, '')) AS ch FROM documents"


@query(f"""WITH c AS ({_CHARS}) SELECT ch, count(*) AS n,
  CASE WHEN regexp_matches(ch, '^[a-zA-Z0-9ı]$') THEN 0.0 WHEN instr('{text.COMMON_MARKS.replace("'", "''")}', ch) > 0 THEN 1.5 WHEN ch >= 'À' AND ch <= 'ÿ' AND ch <> '×' THEN 2.5 ELSE 6.0 END::DOUBLE AS prior,
  instr('{text.NO_PLACEMENT.replace("'", "''")}', ch) > 0 AS ambiguous FROM c WHERE ch <> '' GROUP BY ch""")
def character_priors(spark, d):
    chars = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return chars.select("ch", "n", text.prior(F.col("ch")).alias("prior"), text.placement_ambiguous(F.col("ch")).alias("ambiguous"))


@query("""WITH r AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^a-zA-Z0-9À-ſ]', '', 'g')) / length(text) AS alnum, (doc_id * 7 % 30)::DOUBLE AS dist, doc_id % 4 <> 0 AS fitted, (doc_id % 11) / 10.0::DOUBLE AS residual FROM documents WHERE length(text) > 0)
SELECT doc_id, round(alnum, 9) AS alnum, round(least(1, greatest(0, 0.35::DOUBLE * least(1, greatest(0, 1 - dist / 22.0::DOUBLE)) + 0.35::DOUBLE * alnum + 0.15::DOUBLE * CASE WHEN fitted THEN least(1, greatest(0, 1 - residual / 0.5::DOUBLE)) ELSE 0.5::DOUBLE END + 0.15::DOUBLE * least(1, n / 3))), 6) AS confidence,
  n >= 3 AND alnum >= 0.7::DOUBLE AND dist <= 22 AND (NOT fitted OR residual <= 0.5::DOUBLE) AS verified FROM r""")
def text_evidence(spark, d):
    r = table(spark, d, "documents").where("length(text) > 0").select(
        "doc_id", F.length("text").alias("n"), text.alnum_share(F.col("text")).alias("alnum"), F.expr("cast(doc_id * 7 % 30 as double)").alias("dist"), F.expr("doc_id % 4 <> 0").alias("fitted"), F.expr("(doc_id % 11) / 10.0D").alias("residual")
    )
    a = [F.col(c) for c in ("n", "dist", "alnum", "fitted", "residual")]
    return r.select("doc_id", F.round("alnum", 9).alias("alnum"), F.round(text.confidence(*a), 6).alias("confidence"), text.verified(*a).alias("verified"))


@query("""SELECT doc_id, md5(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n')) AS escaped, true AS back, md5(translate(text, chr(9) || chr(10), '  ')) AS line FROM documents""")
def tsv_escapes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.escape(t).cast("binary")).alias("escaped"), (text.unescape(text.escape(t)) == t).alias("back"), F.md5(text.one_line(t).cast("binary")).alias("line"))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(translate(p_name, 'eo1', '5l0'), ' ')) AS word FROM part),
n AS (SELECT *, length(regexp_replace(word, '[^2-9]', '', 'g')) AS digits, length(regexp_replace(word, '[^ABDEFGHJKLMNPQRTY]', '', 'g')) AS up, length(regexp_replace(word, '[^abdefghijkmnpqrty]', '', 'g')) AS lo FROM w),
s AS (SELECT *, list_transform(string_split(word, ''), lambda c: CASE WHEN c = '5' AND digits = 1 AND up + lo >= 2 THEN CASE WHEN lo >= up THEN 's' ELSE 'S' END ELSE c END) AS cs FROM n)
SELECT p_partkey, word, CASE WHEN digits > 0 AND up + lo = 0 THEN translate(word, 'oOlI|sS', '0011155') WHEN up + lo = 0 THEN array_to_string(cs, '')
  ELSE array_to_string(list_transform(cs, lambda c, i: CASE WHEN c = '0' THEN CASE WHEN lo >= up THEN 'o' ELSE 'O' END
    WHEN c = '1' AND up + lo > digits THEN CASE WHEN lo >= up THEN 'l' ELSE 'I' END
    WHEN instr('cosvwxzuCOSVWXZU', c) > 0 AND c <> '' THEN CASE WHEN lo < up THEN upper(c) WHEN i > 1 OR lo = 0 THEN lower(c) ELSE c END
    WHEN c = 'I' AND lo >= up AND i > 1 THEN 'l' WHEN c = 'l' AND lo < up THEN 'I' ELSE c END), '') END AS settled FROM s""")
def words_harmonized(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.translate("p_name", "eo1", "5l0"), " ")).alias("word"))
    return words.select("p_partkey", "word", text.harmonize(F.col("word")).alias("settled"))


_TOKENS = "SELECT item_id AS id, string_split(text, ' ') AS g, string_split(translate(text, 'e', 'c'), ' ') AS p FROM benchmark"


@query(f"""WITH t AS ({_TOKENS}), a AS (SELECT id, token, count(*) AS a FROM (SELECT id, unnest(g) AS token FROM t) GROUP BY ALL), b AS (SELECT id, token, count(*) AS b FROM (SELECT id, unnest(p) AS token FROM t) GROUP BY ALL)
SELECT sum(least(coalesce(a, 0), coalesce(b, 0)))::BIGINT AS sym_tp, sum(coalesce(a, 0))::BIGINT AS sym_gt, sum(coalesce(b, 0))::BIGINT AS sym_pred FROM a FULL JOIN b USING (id, token)""")
def symbol_bags(spark, d):
    return scores.symbol_overlap(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.split("text", " ").alias("g"), F.split(F.translate("text", "e", "c"), " ").alias("p")))


@query()
def formula_score(spark, d):
    gt = F.concat(F.lit("\\left( "), F.regexp_replace("text", "[.,]", " . . . "), F.lit(" \\right) ^ { 2 } \\le { y }"))
    pred = F.concat(F.lit("( "), F.regexp_replace(F.translate("text", "e", "c"), "[.,]", " \\\\cdots "), F.lit(" ) ^ 2 \\leq y"))
    return scores.formula_score(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), gt.alias("gt"), pred.alias("pred")))


_SYMBOLS = ", ".join("('{}', '{}', '{}')".format(*(v.replace("'", "''") for v in r)) for r in latex.symbols())


@query(f"""WITH s AS (SELECT * FROM (VALUES {_SYMBOLS}) AS s(ch, tex, kind)), c AS ({_CHARS})
SELECT c.ch, coalesce(s.tex, c.ch) AS tex, coalesce(s.kind, 'Ordinary') AS kind, count(*) AS n FROM c LEFT JOIN s ON c.ch = s.ch WHERE c.ch <> '' GROUP BY ALL""")
def symbol_lookup(spark, d):
    known = spark.createDataFrame(latex.symbols(), "ch string, tex string, kind string")
    chars = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return chars.join(F.broadcast(known), "ch", "left").select("ch", F.coalesce("tex", "ch").alias("tex"), F.coalesce("kind", F.lit("Ordinary")).alias("kind"), "n")


@query("""WITH w AS (SELECT unnest(string_split(text, ' ')) AS token FROM documents), n AS (SELECT token, count(*) AS n FROM w GROUP BY token)
SELECT token, n, round(1 - ln(n + 1) / ln((SELECT max(n) FROM n) + 1), 9) AS penalty FROM n""")
def unigram_prior(spark, d):
    n = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    n = cut(n)  # counted once
    most = n.agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most)).select("token", "n", F.round(1 - F.ln(F.col("n") + 1) / F.ln(F.col("most") + 1), 9).alias("penalty"))


@query("""WITH m AS (SELECT md5(coalesce(doc_id::VARCHAR, '-') || ' ' || coalesce(md5(text), '-') || ' ' || coalesce(md5(source), '-')) AS m FROM documents),
h AS (SELECT ('0x' || substr(m, 1, 8))::BIGINT AS a, ('0x' || substr(m, 9, 8))::BIGINT AS b FROM m)
SELECT bit_xor(a) AS bits, sum(b)::BIGINT AS total, count(*) AS n FROM h""")
def text_checksum(spark, d):
    return text_checksum_of(table(spark, d, "documents"))


def text_checksum_of(docs):
    part = lambda at: F.expr(f"cast(conv(substr(m, {at}, 8), 16, 10) as bigint)")
    digest = lambda c: F.coalesce(F.md5(F.col(c).cast("binary")), F.lit("-"))
    m = docs.select(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), digest("text"), digest("source")).cast("binary")).alias("m"))
    return m.agg(F.bit_xor(part(1)).alias("bits"), F.sum(part(9)).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) WHERE k <= 5 OR i % 400 = 0""")
def capped_and_strided(spark, d):
    w = Window.partitionBy("event_type")
    ev = table(spark, d, "events").withColumn("k", F.row_number().over(w.orderBy(F.desc("value"), "event_id"))).withColumn("i", F.row_number().over(w.orderBy("event_id")))
    return ev.where("k <= 5 or i % 400 = 0").select("event_type", "event_id", "value")


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT label, embedding FROM embeddings)""")
def distinct_templates(spark, d):
    return table(spark, d, "embeddings").select("label", "embedding").distinct().agg(F.count(F.lit(1)).alias("n"))
