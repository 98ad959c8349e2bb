"""The operators on small tables: brute force, and nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterlake.llm import byte_bpe, language, license_scan, line_dedup, line_rules, ngram_join, quality, source_mix, toxicity, vector_search
from rasterlake.llm.common import fresh, materialize
from rasterlake.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, score double"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); lang en, and extra columns with clashing names."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), 1, "k", 0.5) for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (5, "x " * 30_000), (5, "x " * 30_000), (6, "Ünï çödé 漢字 😀\x00\x85")]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- source mix


def brute_mix(rows):
    import re

    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    names = sorted({s for _, s, _ in sized if s is not None}) + [None] * any(s is None for _, s, _ in sized)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(n for _, x, n in sized if x == s) for s in names}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - set(over) if over else set()
    return sized, total, target


def test_mix_meets_targets_and_is_stable(spark):
    rows = [(i, "w " * (i % 17), ["a", "b", "c", "dé", None][min(i % 9, 4)]) for i in range(400)] + [(400, None, "z"), (401, "", "z"), (7, "w w w", "b"), (7, "w w w", "b")]
    got = rows_of(source_mix.mix(docs(spark, rows)))
    sized, total, target = brute_mix(rows)
    assert sorted((r[0], r[1]) for r in got) == sorted((i, n) for i, _, n in sized)
    by = {}
    for (i, size, source_size, goal, taken) in got:
        assert 0 <= taken <= 2 * size
        by.setdefault((source_size, goal), []).append(taken)
    for s in total:
        match = [k for k in by if k[0] == total[s] and abs(k[1] - target[s]) < 1e-6]
        assert match, s
        if len(match) == 1 and list(total.values()).count(total[s]) == 1:
            assert abs(sum(by[match[0]]) - target[s]) <= 1
    assert sorted(map(str, rows_of(source_mix.mix(docs(spark, rows).repartition(5))))) == sorted(map(str, got))


def test_mix_of_odd_rows_and_none(spark):
    assert len(rows_of(source_mix.mix(docs(spark, ODD)))) == len(ODD)
    assert rows_of(source_mix.mix(docs(spark, []))) == []
    assert source_mix.mixed_documents(docs(spark, [])).count() == 0
    out = source_mix.mixed_documents(docs(spark, ODD))
    assert out.columns == docs(spark, []).columns
    assert {r["doc_id"] for r in out.collect()} <= {None, 5, 6}


# ---- line dedup


def brute_dedup(rows):
    first, parts = {}, {}
    for i, t in sorted(rows):
        parts[i] = line_dedup.chunks(t)
        for k, (_, _, c) in enumerate(parts[i]):
            first.setdefault(c, (i, k))
    return {i: line_dedup.without(t, [k for k, (_, _, c) in enumerate(parts[i]) if first[c] != (i, k)]) for i, t in rows}


def test_dedup_is_brute_force(spark):
    rng = np.random.default_rng(1)
    line = lambda: " ".join(rng.choice(list("abcdefghij"), 8)) + "."
    shared = [[line() for _ in range(9)] for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [line() for _ in range(6)]
        if i % 3 == 0:
            at = int(rng.integers(0, 6))
            lines[at:at] = shared[i % 4]
        rows.append((i, ("\n" if i % 2 else " ").join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs(spark, rows).repartition(7)).collect()}
    want = brute_dedup(rows)
    assert got == want
    assert any(got[i] != t for i, t in rows) and got[0] == rows[0][1]


def test_chunks_shift_with_their_lines():
    lines = [f"line number {i} has words of its own {i * i} here." for i in range(40)]
    inside = {c for _, _, c in line_dedup.chunks("\n".join(lines))}
    moved = {c for _, _, c in line_dedup.chunks("\n".join(["Another start.", "And more of it."] + lines))}
    assert len(inside & moved) >= len(inside) - 1
    text = " \n\n".join(lines) + "\n"
    spans = line_dedup.chunks(text)
    assert all(a < b for a, b, _ in spans) and line_dedup.without(text, []) == text


def test_dedup_of_odd_rows(spark):
    out = line_dedup.deduplicated(docs(spark, ODD))
    assert out.columns == docs(spark, []).columns and out.count() == len(ODD)
    assert {r["text"] for r in out.where("doc_id in (1, 2)").collect()} == {None, ""}
    assert line_dedup.deduplicated(docs(spark, [])).count() == 0


# ---- quality, toxicity, language


def labelled(spark, make, n=240):
    rows = [(i, make(i)[0]) for i in range(n)]
    marks = [(i, make(i)[1], make(i)[1]) for i in range(n)]
    return docs(spark, rows), spark.createDataFrame([*marks, (999, 1, 1), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int"), {i: make(i)[1] for i in range(n)}


def accuracy(rows, truth):
    own = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert own and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    return sum(a == b for a, b in own) / len(own)


def test_quality_held_out(spark):
    def make(i):
        good = i % 4 != 0
        words = [f"wo{(i * 31 + k * 17) % 97}rd" for k in range(60)]
        return (" ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words)), int(good)

    d, labels, truth = labelled(spark, make)
    got = quality.rated(d.unionByName(docs(spark, ODD)), labels).collect()
    assert accuracy(got, truth) > 0.95
    assert len(got) == 240 + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.good_documents(d, labels)
    assert kept.columns == d.columns and kept.where("doc_id % 4 <> 0").count() == 180
    assert quality.rated(docs(spark, []), labels).collect() == []


def test_voting_is_brute_force():
    texts = [("aa bb. " * (i + 1) if i % 2 else f"X{i}!! Y## " * 5, i % 2) for i in range(40)]
    v = quality.fit(texts)
    asked = ["aa bb cc.", "Q!! Z## W%%", "", None]
    q = v.fold(asked[:2])
    for k in range(2):
        cos = sorted(((float(q[k] @ v.vectors[j]), -j) for j in range(40)), reverse=True)[: quality.NEAREST]
        w = np.array([max(c, 1e-6) ** quality.POWER for c, _ in cos])
        y = np.array([texts[-j][1] for _, j in cos])
        assert v.vote(asked)[k] == pytest.approx((w * y).sum() / w.sum(), abs=0.05)
    assert v.vote(asked)[2:].tolist() == [0, 0]
    assert quality.fit([]).vote(["a"]).tolist() == [0]


def test_toxicity_held_out(spark):
    def make(i):
        bad = i % 3 == 0
        words = [f"wo{(i * 31 + k * 17) % 97}rd" for k in range(60)]
        if bad:
            words[i % 50] = ("grumblefink", "snarkwort")[i % 2]
        return " ".join(words), int(bad)

    d, labels, truth = labelled(spark, make)
    got = toxicity.rated(d.unionByName(docs(spark, ODD)), labels).collect()
    assert accuracy(got, truth) > 0.95
    assert len(got) == 240 + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.rated(docs(spark, []), labels).collect() == []


def test_grams_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = "abcde fghij klmno " * 50
    whole = sorted(np.concatenate(list(toxicity.grams(text))).tolist())
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert sorted(np.concatenate(list(toxicity.grams(text))).tolist()) == whole


def test_language_held_out(spark):
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "éèçàù"}
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for i in range(150):
        name = list(alphabets)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(list(alphabets[name]), 4)) for _ in range(20)), name, "s", 0, 1, "k", 0.0))
        truth[i] = name
    rows += [(200, None, None, "s", 0, 1, "k", 0.0), (201, "123 !?", "aa", "s", 0, 1, "k", 0.0), (202, "", "aa", "s", 0, 1, "k", 0.0)]
    got = {r["doc_id"]: r for r in language.rated(spark.createDataFrame(rows, DOCS)).collect()}
    own = [got[i]["lang_pred"] == truth[i] for i in truth if got[i]["held_out"]]
    assert np.mean(own) > 0.9
    assert all(got[i]["lang_pred"] == "und" for i in (200, 201, 202))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.rated(docs(spark, [])).collect() == []


def test_gradients_are_numeric_slopes():
    net = language.fit([("abc", "x"), ("xyz", "y")] * 4, epochs=0)
    x = np.random.default_rng(0).integers(1, 255, (6, 3)).astype(np.uint8)
    y = np.array([0, 1, 0])
    _, g = net.gradients(x, y)
    for w, d in zip(net.weights(), g):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        old, eps = w[at], 1e-2
        w[at] = old + eps
        up = net.gradients(x, y)[0]
        w[at] = old - eps
        down = net.gradients(x, y)[0]
        w[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(d[at], rel=0.05, abs=1e-4)


# ---- line rules


def test_line_rules_by_hand(spark):
    clean = "This is a sentence of ten words that ends well. " * 6
    menu = "Home | About | Contact | Shop |"
    got = line_rules.judged(clean + "\n" + menu + "\nAll rights reserved.\n\n" + clean)
    assert (got["n_failed_lines"], got["n_dup_lines"], got["base_failed"]) == (2, 1, True)
    assert line_rules.failing("One two three", ["One", "two", "three"]) == "punctuation"
    assert line_rules.failing("GO!! NOW!! OK.", ["GO!!", "NOW!!", "OK."]) == "punctuation"
    assert line_rules.in_repeats("a b c a b c x".split()) == 6 and line_rules.in_repeats("a a a".split()) == 0
    assert line_rules.in_repeats("a a a a".split()) == 4
    rows = line_rules.rated_documents(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in rows)
    assert line_rules.rated_documents(docs(spark, [])).collect() == []
    out = line_rules.clean_documents(docs(spark, [(1, "Good line here.\n" + menu)])).first()
    assert out["rules"]["cleaned"] == "Good line here."


# ---- vectors


def test_search_finds_nearly_all(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 12))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    odd = [(700, None), (720, [0.0] * 12), (740, [float("nan")] * 12), (760, [None] * 12), (780, [1.0, 2.0]), (800, []), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1))
    got = vector_search.nearest(df, lambda i: i % 20 == 0, 20).collect()
    assert {r["query_id"] for r in got} == set(range(0, 700, 20))
    hits = 0
    for q in range(0, 700, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        s = vector_search._exact(x[q], x)
        keys = [(-r["score"], r["vec_id"]) for r in own]
        assert keys == sorted(keys) and all(r["score"] == s[r["vec_id"]] for r in own)
        s[q] = -np.inf
        hits += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(700), -s))[:20].tolist()))
    assert hits / (35 * 20) >= 0.9
    few = vector_search.nearest(df.where("vec_id < 5"), lambda i: i % 20 == 0, 20).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]
    assert vector_search.nearest(df.where("vec_id < 0"), lambda i: i % 20 == 0).collect() == []


# ---- n-gram join


def brute_components(rows):
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


def near_copies(seed, base, copies, words=90):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(base):
        text = [f"w{x}" for x in rng.integers(0, 60, words)]
        for _ in range(int(rng.integers(1, copies))):
            own = list(text)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(0, words))] = f"v{rng.integers(0, 1000)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_brute_force(spark, seed):
    rows = near_copies(seed, 12, 14) + [(1000, "One Two"), (1001, "one  two"), (1002, "one"), (1003, ""), (1004, None), (1005, " \n")]
    rows = [(i + 5000 if i % 3 else i, t) for i, t in rows]
    got = rows_of(ngram_join.near_duplicates(docs(spark, rows).repartition(6)))
    assert sorted(got) == brute_components(rows)
    kept = ngram_join.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute_components(rows) if i == c)


def test_join_of_odd_rows(spark):
    got = rows_of(ngram_join.near_duplicates(docs(spark, ODD)))
    assert sorted(map(str, got)) == sorted(map(str, [(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (5, 1, 5), (5, 1, 5), (6, 1, 6)]))
    assert rows_of(ngram_join.near_duplicates(docs(spark, []))) == []


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2)]
    got = dict(rows_of(components(spark.createDataFrame(links, "u long, v long"))))
    assert got == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 140)}}
    assert rows_of(components(spark.createDataFrame([], "u long, v long"))) == []


# ---- licences


def test_licences_whole_texts_only(spark):
    mit = license_scan.LICENSES["MIT"]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Some One\n\n" + mit.replace("License", "LICENCE").replace(",", " ,")), (3, mit + " And more."),
        (4, "A text.\nReleased under the MIT Licence\nAll rights reserved."), *[(10 + (i or 0), t) for i, t in ODD],
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert [got[k]["license"] for k in (1, 2, 3, 4)] == ["MIT", "MIT", None, None]
    assert got[4]["notices"] == ["notice:MIT", "notice:reserved"]
    assert all(got[k]["license"] is None and got[k]["notices"] == [] for k in got if k >= 10)
    assert license_scan.scan(docs(spark, [])).count() == 0


# ---- byte-level BPE

TOY = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b" a", b"aa", b"aaa", b" ab"]


def merged(tokens, piece):
    rank = {t: i for i, t in enumerate(tokens)}
    parts = [bytes([b]) for b in piece]
    if piece in rank:
        return [rank[piece]]
    while True:
        best = min(((rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return [rank[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_toy_vocabulary_gives_the_merges():
    c = byte_bpe.Codec(TOY, r"\S+|\s+")
    rng = np.random.default_rng(3)
    for _ in range(3000):
        piece = bytes(rng.choice(list(b"abc "), int(rng.integers(1, 14))))
        assert c.encode_piece(piece) == merged(TOY, piece)


def test_real_vocabulary_is_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = str(P.path("byte_bpe_multi_50k.tiktoken"))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world, it's 12345!", "  two  blanks\n\n\tand tabs ", "é漢字😀" * 50, "a" * 3000, "<|endoftext|>", " \n", "x\ny z", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "again"), (100, "again")]
    got = {r["doc_id"]: r for r in byte_bpe.encoded_documents(docs(spark, rows), path, P.PATTERN).collect()}
    for i, t in rows:
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs(spark, rows), path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())
    assert byte_bpe.encoded_documents(docs(spark, []), path, P.PATTERN).collect() == []


# ---- shared, and the pipeline


def test_fresh_names_and_written_tables(spark):
    df = docs(spark, ODD).withColumn("__a", F.lit(1)).withColumn("__A_", F.lit(2))
    assert fresh(df, "a", "b") == ["__a__", "__b"]
    assert sorted(map(str, rows_of(materialize(df.drop("__A_"), "t")))) == sorted(map(str, rows_of(df.drop("__A_"))))


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = [(i, t, f"s{i % 3}") for i, t in near_copies(5, 40, 4, 80)]
    d = docs(spark, [(i, t.replace("w1 ", "w1. "), s) for i, t, s in rows])
    junk = docs(spark, [(900 + i, " | ".join(f"J{i}UNK{k}!!" for k in range(40)), "s1") for i in range(20)])
    d.unionByName(junk).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, 0) for i, _, _ in rows] + [(900 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert out and all(i < 900 for i in ids) and all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == now.columns
        now = materialize(after, "test")
    assert sorted(r["doc_id"] for r in now.select("doc_id").collect()) == sorted(r["doc_id"] for r in out)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), str(tmp_path)).count() == 0
