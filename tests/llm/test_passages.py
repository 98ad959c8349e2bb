"""Repeated passages against a brute force of runs of 51 words that knows nothing of chunks."""

import numpy as np
import pyarrow as pa

from rasterlake.llm import line_dedup


def left_over(before, after):
    """Runs of 51 words of the texts, in order of their ids, that an earlier place holds and that still stand."""
    seen, repeated = set(), []
    for i in sorted(before):
        words = before[i].split()
        for k in range(len(words) - 50):
            run = " ".join(words[k : k + 51])
            if run in seen:
                repeated.append((i, run))
            seen.add(run)
    kept = {i: " ".join(t.split()) for i, t in after.items()}
    return repeated, [(i, run) for i, run in repeated if run in kept[i]]


def planted(rng, cut):
    """Texts of random words; passages of 51 to 100 words stand in two of them each, with sentences of 11 words or none."""
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))

    def prose(n):
        words = [word() for _ in range(n)]
        for k in range(10, n, 11) if cut else ():
            words[k] += "."
        return words

    texts = {i: prose(120) for i in range(80)}
    for i in range(0, 80, 2):
        passage = prose(int(rng.integers(51, 101)))
        for j in (i, i + 1):
            at = int(rng.integers(0, 120))
            texts[j][at:at] = passage
    return {i: " ".join(t) for i, t in texts.items()}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, hash int").repartition(5)


def test_passages_go_whole(spark):
    for cut in (True, False):
        before = planted(np.random.default_rng(3), cut)
        after = {r["doc_id"]: r["text"] for r in line_dedup.without_passages(frame(spark, before)).collect()}
        repeated, still = left_over(before, after)
        assert len({i for i, _ in repeated}) == 40 and len({i for i, _ in still}) <= 1
        assert all(after[i] == before[i] for i in range(0, 80, 2))
        assert all(len(after[i].split()) >= 119 for i in range(1, 80, 2))


def test_only_passages_go(spark):
    word = [f"w{i}" for i in range(300)]
    other = [f"v{i}" for i in range(300)]
    rows = {1: word[:100], 2: other[:40] + word[20:60] + other[40:80], 3: other[100:140] + word[20:80] + other[140:180], 4: word[:100], 5: ["é", *word[:100], "漢"]}
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_passages(frame(spark, {i: "\n".join(t) for i, t in rows.items()})).collect()}
    assert got[1] == "\n".join(word[:100]) and got[4] == "" and got[5] == "é\n漢"
    assert got[3] == "\n".join(other[100:180])
    few = {i: " ".join(t) for i, t in rows.items() if i < 4}
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_passages(frame(spark, few)).collect()}
    assert got[2] == few[2] and got[3] == " ".join(other[100:180])


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t ", 0), (None, "a b c", 0), (5, "x " * 3000, 0), (5, "x " * 3000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    out = line_dedup.without_passages(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert {r["text"] for r in out.where("doc_id in (1, 2)").collect()} == {None, ""}
    assert line_dedup.without_passages(df.limit(0)).count() == 0


def test_pieces_of_many_texts_are_those_of_each(monkeypatch):
    """Texts are cut into pieces together; no window, line or piece reaches from one into the next."""
    rng = np.random.default_rng(6)
    signs = ["a", "b ", "c. ", "\n", " ", "d… ", "é!\t", "\x85 ", "xx "]
    texts = ["", " \n", "a", "a a a a a a a a a a a a", "a. " * 300, "one\ntwo\n" * 30, *("".join(rng.choice(signs, int(rng.integers(0, 300)))) for _ in range(60))]
    own, *found = line_dedup.pieces_of([t.encode() for t in texts])
    assert (np.diff(own[~found[-1]]) >= 0).all() and found[-1].any()
    for k, text in enumerate(texts):
        alone = line_dedup.pieces(text)
        assert all(np.array_equal(f[own == k], a) for f, a in zip(found, alone))
        f, t, _, lines = alone
        words = text.encode().split()
        assert f[~lines].tolist() == [0, *t[~lines].tolist()][:-1] if words else not len(f)
        assert not words or t[~lines][-1] == len(words)
    batch = pa.RecordBatch.from_arrays([pa.array([None if k % 9 == 4 else k for k in range(len(texts))], pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "hash", "text"])
    whole = [r.to_pydict() for r in line_dedup._dealt(5, iter([batch]))]
    monkeypatch.setattr(line_dedup, "AT_ONCE", 1)
    assert [r.to_pydict() for r in line_dedup._dealt(5, iter([batch]))] == whole and len(whole) == 1


def test_cuts_keep_bytes_around_them():
    text = "é  one two\tthree 漢 \n four\x85five six "
    runs = [(1, 3, True, 1, "zwei one two drei"), (4, 6, True, 0, "漢 four\x85five")]
    got = line_dedup.cut_runs(text.encode(), [(*r[:4], r[4].encode()) for r in runs]).decode()
    assert got == "é  three six "
    assert line_dedup.cut_runs(text.encode(), [(1, 3, True, 0, b"one TWO")]).decode() == text
    assert line_dedup.cut_runs(text.encode(), [(1, 3, False, 0, b"one two")]).decode() == text
    assert line_dedup.cut_runs(b"a b", [(0, 2, True, 0, b"a b")]) == b"" and line_dedup.cut_runs(None, []) is None
