"""Contracts of the text operators: SQL, published texts, whole samples, odd ids, and brute force for what SQL can't say."""

import math
import os
import re
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterlake.llm import labelled, language, license_scan, line_dedup, line_rules, ngram_join, quality, queries, source_mix, toxicity, vector_search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double"


def docs(spark, rows):
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), 1, 0.5) for r in rows], DOCS)


def cell(v):
    return "-" if v is None else f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)


# ---- SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = lambda every, cols: sorted(tuple(cell(r[cols.index(c)]) for c in order) for r in every)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)


# ---- labelled samples


def test_samples_take_labels_of_documents_that_are_there(spark):
    rows = [(i, f"text {i} " * (i + 1)) for i in range(60)] + [(70, ""), (71, None), (72, "w " * 30_000), (None, "no id")]
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (72, 1)], "doc_id long, toxic int"))
    got = labelled.labelled_texts(docs(spark, rows), labels, "toxic", 40, 10**6)
    known = {t: i for i, t in rows if t}
    assert len(got) == 40 and {v for _, v in got} == {0, 1} and all(t in known for t, _ in got)
    every = labelled.labelled_texts(docs(spark, rows), labels, "toxic", 400, 10**6)
    assert "w " * 30_000 in [t for t, _ in every]  # long texts teach, too, and whole
    assert labelled.labelled_texts(docs(spark, rows), labels, "toxic", 400, 2000) and sum(len(t) for t, _ in labelled.labelled_texts(docs(spark, rows), labels, "toxic", 400, 2000)) <= 2000
    again = docs(spark, rows + rows)
    assert labelled.labelled_texts(again, labels, "toxic", 400, 10**6) == every
    assert labelled.labelled_texts(docs(spark, []), labels, "toxic", 40, 10**6) == []


# ---- quality: the selection among many voters


def test_votes_among_many_are_brute_force():
    rng = np.random.default_rng(3)
    texts = [(" ".join(rng.choice(["aa", "Bb.", "C1", "##", "dd,", "EE!!"], 12)), int(rng.integers(2))) for _ in range(400)]
    v = quality.fit(texts + texts[:100])  # ties: equal voters
    asked = [t for t, _ in texts[:60]]
    q, got = v.fold(asked), v.vote(asked)
    for k in range(60):
        cos = q[k : k + 1] @ v.vectors.T
        order = np.lexsort((np.arange(len(v.labels)), -cos[0]))[: quality.NEAREST]
        w = np.maximum(cos[0][order].astype(float), 1e-6) ** quality.POWER
        assert got[k] == pytest.approx((w * v.labels[order]).sum() / w.sum(), abs=1e-5)


# ---- toxicity: found features


def test_features_are_a_plain_count():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(30)]
    text = lambda: " ".join(rng.choice(words, 40))
    sample = [(text() + (" vile slur" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(150)]
    m = toxicity.fit(sample)
    assert len(m.hashes)
    place = {h: i for i, h in enumerate(m.hashes.tolist())}
    for t in [text() + " vile", "", "É" * 50, text() * 30]:
        counts = {}
        for g in toxicity.grams(t):
            for h in g.tolist():
                if h in place:
                    counts[place[h]] = counts.get(place[h], 0) + 1
        want = {i * toxicity.LEVELS for i in counts}
        for k, per in enumerate(toxicity.PER_CHARS, 1):
            want |= {i * toxicity.LEVELS + k for i, n in counts.items() if n * per >= len(t)}
        assert sorted(m.found(t).tolist()) == sorted(want)
        z = m.intercept + sum(m.weights[i] for i in want if t)
        assert m.score(t) == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))))


# ---- language


def test_windows_are_one_text_at_a_time():
    net = language.fit([("abc def", "x"), ("uvw xyz", "y")] * 6, epochs=2)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdxyz \n"), n)) for n in (1, 127, 128, 129, 1000, 40_000, 200_000)] + ["½ ²", "123 !?", "", None, "é", "漢"]
    names, scores = net.predict(texts)
    assert names[7:11] == ["und"] * 4 and scores[7:11] == [0.0] * 4 and names[11] in ("x", "y") and names[12] in ("x", "y")
    for t, n, s in list(zip(texts, names, scores))[:5] + [(texts[6], names[6], scores[6])]:
        data = np.frombuffer(t.encode(), np.uint8)
        total = np.zeros(2)
        for k in range(0, len(data), language.WINDOW):
            own = np.zeros(language.WINDOW, np.uint8)
            own[: len(data[k : k + language.WINDOW])] = data[k : k + language.WINDOW]
            p = net.probabilities(own[:, None])
            total += (p * (own != language.PAD)[:, None, None]).sum((0, 1))
        total /= len(data)
        if re.search(r"[a-z]", t):
            assert net.names[int(total.argmax())] == n and s == pytest.approx(total.max(), abs=1e-4)


def test_every_language_is_learnt(spark):
    rows = [(i, f"text{i} of some language", f"l{i % 90}", "s", 0, 1, 0.0) for i in range(900)]
    got = language.language_snippets(spark.createDataFrame(rows, DOCS), most=300, in_all=180)
    by = {}
    for _, name in got:
        by[name] = by.get(name, 0) + 1
    assert len(by) == 90 and max(by.values()) <= 2 * language.WINDOWS


# ---- licences


def test_published_texts(spark):
    wrap = lambda t, n=70: "\n".join(line for part in t.split("\n") for line in (textwrap.wrap(part, n) or [""]))
    owner = "Copyright (c) 2019, Some Body <some@body.example>\nCopyright © 2020 Other\n(c) 2021 Third\n\n"
    rows, want = [], {}
    for n, (name, text) in enumerate(license_scan.LICENSES.items()):
        if not name.startswith("notice:"):
            for k, t in enumerate([text, owner + wrap(text), owner + wrap(text, 50).upper(), *(f"{title}\n\n{owner}{wrap(text)}" for title in license_scan.TITLES.get(name, ()))]):
                rows.append((100 * n + k, t))
                want[100 * n + k] = name
    isc = wrap(license_scan.LICENSES["ISC"], 72).replace("above copyright", "above\ncopyright")
    rows += [(90_001, isc), (90_002, isc + "\nand more"), (90_003, license_scan.LICENSES["MIT"] * 2), (90_004, "copyright notice and nothing else")]
    want |= {90_001: "ISC", 90_002: None, 90_003: None, 90_004: None}
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == want


def test_catalogue_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do as you please, provided you keep this unmistakable sentence.")
    texts = license_scan.texts_of(spark, str(tmp_path))
    got = license_scan.scan(docs(spark, [(1, "YOU MAY do as you please;\nprovided you keep this\tunmistakable sentence"), (2, "You may not.")]), texts=texts).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "Own-1.0"), (2, None)]


# ---- n-gram join


def components_of(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(sets[a]), least[find(a)] if sets[a] else i) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("hot", [False, True])
def test_families_that_are_not_quite_similar(spark, monkeypatch, hot):
    """Copies of one text with edits around the threshold, no original among them, of other lengths too, and of chains."""
    if hot:
        monkeypatch.setattr(ngram_join, "HOT", 5)
    rng = np.random.default_rng(11)
    rows = []
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(120)]
        for _ in range(40):
            own = list(base)
            for at in rng.choice(120, int(rng.integers(1, 6)), replace=False):
                own[at] = f"x{rng.integers(10**6)}"
            cut = int(rng.integers(0, 25)) if rng.random() < 0.4 else 0
            rows.append((len(rows), " ".join(own[cut:])))
    for k in range(25):  # a chain: each is similar to the next one only
        rows.append((len(rows), " ".join(f"c{j}" for j in range(6 * k, 6 * k + 110))))
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    got = ngram_join.near_duplicates(docs(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, got)) == components_of(rows)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    near = text + " and more"
    rows = [(5, near), (5, "clean text of its own that nobody else has"), (3, text), (3, text), (None, near), (None, "alone here without an id"), (9, ""), (9, ""), (None, None)]
    out = ngram_join.one_of_each(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    got = sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect())))
    assert got == sorted(map(str, [(3, text), (5, rows[1][1]), (None, rows[5][1]), (9, ""), (9, ""), (None, None)]))
    nobody = docs(spark, [(None, text), (None, text), (None, near)])
    assert ngram_join.one_of_each(nobody).count() == 1


# ---- line dedup, rules, mix, vectors


def test_hot_passages_in_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", 50)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(30)) + f" {passage} " + " ".join(f"b{i}x{k}" for k in range(30))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_passages(docs(spark, rows).repartition(3)).collect()}
    assert got[0] == rows[0][1]
    assert all(passage not in got[i] and len(got[i].split()) == 60 for i in range(1, 60))


def test_mixed_documents_meet_their_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 60)), "ab"[i % 7 == 0]) for i in range(500)] + [(None, "w " * 20, "a")] * 20
    d = docs(spark, rows)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    targets = {r["source_size"]: r["target"] for r in source_mix.mix(d).select("source_size", "target").distinct().collect()}
    out = source_mix.mixed_documents(d)
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    for s in "ab":
        assert abs(words.get(s, 0) - targets[sizes[s]]) <= 0.03 * targets[sizes[s]] + 60
    assert max(r["count"] for r in out.where("doc_id is not null").groupBy("doc_id").count().collect()) <= 2
    both = source_mix.mix(d).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).where("t > 2 * s")
    assert both.count() == 0


def test_repeated_vectors(spark):
    x = np.random.default_rng(6).standard_normal((300, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(20, [float(v) for v in x[20]]), (7, [float(v) for v in x[7]]), (7, [float(v) for v in x[8]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector_search.nearest(df, lambda i: i % 20 == 0, 20).collect()
    own = [r for r in got if r["query_id"] == 20]
    assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["vec_id"] != 20 for r in own)
    assert all(0 < r["visited"] <= r["leaves"] for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_recall_on_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = {}
    for r in vector_search.op5_nearest(spark, d).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = n = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, n = hits + len(best & found[q]), n + len(best)
    assert hits / n >= 0.9


def test_clashing_columns_are_replaced_or_kept(spark):
    d = docs(spark, [(1, "Some words that make a line.")])
    assert line_rules.clean_documents(d.withColumn("rules", F.lit(1))).columns[-1] == "rules"
    voters = quality.fit([("aa bb.", 1), ("## !!", 0)])
    scored = quality.quality_scores(d, voters)
    assert scored.columns == d.columns and 0 <= scored.first()["score"] <= 1


# ---- the pipeline


def test_pipeline_of_odd_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(9)
    prose = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)) + "."
    rows = [(i, prose(), f"s{i % 3}") for i in range(40)]
    rows += [(None, prose(), "s1"), (None, rows[4][1], None), (3, rows[3][1], "s0"), (50, "", "s1"), (51, None, "s1"), (52, prose(), None)]
    d = docs(spark, rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    junk = docs(spark, [(900 + i, " | ".join(f"J{i}UNK{k}!!" for k in range(40)), "s1") for i in range(12)])
    junk.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, 0) for i in range(40)] + [(900 + i, 0, 0) for i in range(12)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert out and all(i is None or i < 900 for i in ids)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.keep_good(spark, now, str(tmp_path))
    assert kept.where("doc_id >= 900").count() == 0 and kept.where("doc_id < 40").count() == 41
    dropped = corpus_pipeline.drop_repeated_passages(spark, kept, str(tmp_path))
    assert dropped.count() == kept.count()
    one = corpus_pipeline.one_of_each(spark, dropped, str(tmp_path))
    assert one.where("doc_id = 3").count() == 1 and one.columns == now.columns
