"""Removal of passages that repeat across a corpus, by content-defined chunks of lines.

A line here ends at a line feed or after a sentence, so that passages within long lines are found, too. A rolling hash
over the hashes of neighbouring lines chooses where chunks end: wherever a passage stands, its chunks inside are the
same. Digests of chunks of two lines or more are counted over the whole corpus; of those that repeat, the bytes are
compared, the first in the order of documents stays, and the others are removed.

without_passages() adds pieces of a few words, which end where a rolling hash over the words is least around, so that
every passage of PASSAGE words or more holds some of them whatever its lines are. What repeats is compared word by word
with its first place, and the comparison goes on to both sides as far as the texts agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import bounded_batches, fresh, lean, materialize, parted_by_ids, table

#: Least lines and words of a chunk that may go; lines after which a chunk ends anyway; one place in DIVISOR ends a chunk.
LEAST_LINES, LEAST_WORDS, MOST_LINES, DIVISOR = 2, 10, 16, 2
#: Least words of a repeated run that goes without holding a chunk of lines; words to each side within which a piece's end
#: has the least hash; words to each side of repeated pieces that are compared.
PASSAGE, REACH, AROUND = 50, 4, 50
#: Pieces that a task holds before it passes them on. Speed, not results.
HELD = 250_000
#: Bytes of texts that are cut into pieces at once: arrays that a core's cache holds. Speed, not results.
AT_ONCE = 40_000

_ends = re.compile(r"\n|[.!?…][ \t]+").finditer
_P, _Q = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def chunks(text: str | None) -> list[tuple[int, int, str]]:
    """(from, to, content) of the chunks that may go, by character positions. Blank lines belong to the line before.

    The content is the stripped lines, joined by line feeds: what is digested and compared.
    """
    if not text:
        return []
    cuts = [m.end() for m in _ends(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    spans, lines, start = [], [], 0
    for cut in cuts:
        line = text[start:cut].strip()
        if line or not lines:
            spans.append([start, cut])
            lines.append(line)
        else:
            spans[-1][1] = cut
        start = cut
    if len(lines) < LEAST_LINES:
        return []
    h = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    roll = h.copy()
    roll[1:] += h[:-1] * _P
    roll = (roll ^ (roll >> np.uint64(29))) * _Q
    ends = np.flatnonzero((roll >> np.uint64(33)) % np.uint64(DIVISOR) == 0) + 1
    out, at = [], 0
    for end in [*ends.tolist(), len(lines)]:
        while end - at > MOST_LINES:
            out.append((at, at + MOST_LINES))
            at += MOST_LINES
        if end - at >= LEAST_LINES:
            out.append((at, end))
            at = end
    found = []
    for a, b in out:
        content = "\n".join(lines[a:b])
        if len(content.split()) >= LEAST_WORDS:
            found.append((spans[a][0], spans[b - 1][1], content))
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its document, its number there, and its digest."""
    for b in batches:
        own, number, digest = [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            d = [xxhash.xxh64_intdigest(c) - (1 << 63) for _, _, c in chunks(text)]
            own += [i] * len(d)
            number += range(len(d))
            digest += d
        at = pa.array(own, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("hash").take(at), pa.array(number, pa.int32()), pa.array(digest, pa.int64())], ["id", "hash", "nth", "digest"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk whose number is asked for: its document, its number and its content."""
    for b in batches:
        own, number, content = [], [], []
        for i, (text, asked) in enumerate(zip(b.column("text").to_pylist(), b.column("asked").to_pylist())):
            found = chunks(text)
            own += [i] * len(asked)
            number += asked
            content += [found[k][2] for k in asked]
        at = pa.array(own, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("hash").take(at), pa.array(number, pa.int32()), pa.array(content, pa.string())], ["id", "hash", "nth", "content"])


def without(text: str | None, gone: list[int] | None) -> str | None:
    """A text without the chunks of these numbers."""
    if not gone:
        return text
    found, out, at = chunks(text), [], 0
    for k in sorted(gone):
        out.append(text[at : found[k][0]])
        at = found[k][1]
    return "".join([*out, text[at:]])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """id, hash, gone: the numbers of the chunks that go, for each document (id and hash of its text) that loses any.

    Of chunks with equal bytes, the first stays, in the order of (doc_id, hash of the text, place), null ids last. Rows with equal ids
    and texts are one document, and are treated alike.
    """
    bounded_batches(docs.sparkSession)
    named = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    every = materialize(named.mapInArrow(_digests, "id long, hash long, nth int, digest long"), "chunks")
    again = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    asked = every.join(again, "digest", "left_semi").groupBy("id", "hash").agg(F.array_sort(F.collect_set("nth")).alias("asked"))
    asked = materialize(asked, "asked")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))
    own = asked.withColumnsRenamed({"id": "i", "hash": "h"})
    # only texts that may be asked for are shuffled, and by the same join at every size
    near, _ = parted_by_ids(named, "id", asked.select("id"))
    texts = near.join(own.hint("merge"), same).select("id", "hash", "text", "asked")
    contents = texts.mapInArrow(_contents, "id long, hash long, nth int, content string").withColumn("at", F.struct(F.col("id").isNull().alias("last"), "id", "hash", "nth"))
    contents = materialize(contents.select("at", "content"), "contents")
    first = contents.groupBy("content").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = contents.join(first, "content").where(F.col("at") != F.col("first"))
    return later.groupBy(F.col("at.id").alias("id"), F.col("at.hash").alias("hash")).agg(F.array_sort(F.collect_set("at.nth")).alias("gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed from text; all rows and columns stay.

    Null and empty texts stay as they are, and a text may become empty. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    i, h, gone = fresh(docs, "id", "hash", "gone")
    marks = materialize(repeated_chunks(docs), "gone").select(F.col("id").alias(i), F.col("hash").alias(h), F.col("gone").alias(gone))

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, numbers in batches:
            yield pa.array([without(t, g) for t, g in zip(text.to_pylist(), numbers.to_pylist())], pa.string())

    near, others = parted_by_ids(docs, "doc_id", marks.select(i))
    joined = near.join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left")
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(cut("text", gone))).select(*docs.columns).unionByName(others)


_KEPT = 1 << 17
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 powers of an odd base modulo 2**64, and of its inverse; those for all but very long texts are kept."""
    if n < _KEPT and base in _kept:
        return tuple(p[: n + 1] for p in _kept[base])
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        f = np.full(max(n, _KEPT) + 1, b, np.uint64)
        f[0] = 1
        out.append(np.multiply.accumulate(f))
    if n < _KEPT:
        _kept[base] = tuple(out)
    return out[0][: n + 1], out[1][: n + 1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


def pieces(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, digest, whether a chunk of lines) of the runs of words whose repetition is looked for, by word numbers."""
    return pieces_of([(text or "").encode()])[1:]


def pieces_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, from, to, digest, whether a chunk of lines) of the pieces of several texts at once.

    By word numbers of a text, in order of texts: first all pieces of words, which follow each other, then all chunks of lines.
    """
    b = np.frombuffer(b"\n".join(texts), np.uint8)
    inner = np.zeros(len(b) + 2, bool)
    inner[1:-1] = (b != 32) & ((b - np.uint8(9)) > 4)
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    starts, stops = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing.astype(np.uint64), nothing.astype(bool)
    up, down = _powers(int(_P), len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * up[:-1], dtype=np.uint64, out=total[1:])
    word = _mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    up, down = _powers(int(_Q), n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word * up[:-1], dtype=np.uint64, out=total[1:])
    # texts with words: their numbers, their first words, and the end of the last
    begins = np.cumsum(np.array([0, *(len(t) + 1 for t in texts[:-1])]))
    heads = np.append(np.searchsorted(starts, begins), n)
    texts_with = np.flatnonzero(heads[1:] > heads[:-1])
    first, last = heads[texts_with], heads[texts_with + 1]
    roll = word.copy()
    step = word * _P
    step[last - 1] = 0
    roll[1:] += step[:-1]
    step[1:] = step[:-1] * _P
    step[first] = step[last - 1] = 0
    roll[1:] += step[:-1]
    roll = _mixed(roll)
    at = np.arange(n) + REACH * (np.repeat(np.arange(len(first)), last - first) + 1)  # no window reaches into another text
    wide = np.full(n + REACH * (len(first) + 1), np.iinfo(np.uint64).max)
    wide[at] = roll
    least, span = wide, 1
    while span < 2 * REACH + 1:  # the least of each window, from windows of half its width and more
        step = min(span, 2 * REACH + 1 - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    ends = np.flatnonzero(roll == least[at - REACH]) + 1
    close = np.flatnonzero(np.diff(ends) <= REACH)
    if len(close):  # only words that repeat at once put ends closer together, or two texts that meet
        own = np.searchsorted(first, ends - 1, side="right") - 1
        kept = np.ones(len(ends), bool)
        for k in np.unique(own[close][own[close] == own[close + 1]]).tolist():
            place = -1
            for i in range(*np.searchsorted(own, [k, k + 1]).tolist()):
                kept[i] = place < 0 or ends[i] - place > REACH
                if kept[i]:
                    place = ends[i]
        ends = ends[kept]
    whole = np.zeros(n + 1, bool)
    whole[ends] = whole[first] = whole[n] = True
    cuts = np.flatnonzero(whole)
    run = lambda f, t: _mixed((total[t] - total[f]) * down[f] + (t - f).astype(np.uint64))
    lines = _line_chunks(b, starts, stops, run, first)
    f, t = np.concatenate((cuts[:-1], lines[0])), np.concatenate((cuts[1:], lines[1]))
    own = np.searchsorted(first, f, side="right") - 1
    return texts_with[own], f - first[own], t - first[own], run(f, t), np.arange(len(f)) >= len(cuts) - 1


def _line_chunks(b: np.ndarray, starts: np.ndarray, stops: np.ndarray, run, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) by word numbers of the chunks of lines that may go, as chunks() has them, from the bytes and words of texts.

    A line ends before a gap with a line feed, or after a word that ends as a sentence does with a blank or tab behind it.
    The rolling hash goes over hashes of the words of lines. first: the first word of each text.
    """
    n = len(starts)
    last, after = b[stops[:-1] - 1], b[stops[:-1]]
    mark = (last == 46) | (last == 33) | (last == 63)
    wide = np.flatnonzero(last == 0xA6)  # the last of the three bytes of an ellipsis
    if len(wide):
        at = stops[wide]
        mark[wide] = (at >= 3) & (b[at - 2] == 0x80) & (b[np.maximum(at - 3, 0)] == 0xE2)
    edge = np.zeros(n + 1, bool)
    edge[1:-1] = mark & ((after == 32) | (after == 9))
    edge[np.searchsorted(starts, np.flatnonzero(b == 10))] = True  # the first word behind each line feed
    edge[first] = edge[n] = True
    edge = np.flatnonzero(edge)
    h = run(edge[:-1], edge[1:])
    heads = np.searchsorted(edge, first)
    step = h * _P
    step[np.append(heads[1:], len(h)) - 1] = 0
    roll = h.copy()
    roll[1:] += step[:-1]
    roll = _mixed(roll)
    stop = np.zeros(len(h) + 1, bool)
    stop[1:] = (roll >> np.uint64(33)) % np.uint64(DIVISOR) == 0
    stop[heads[1:]] = stop[len(h)] = True
    head = np.zeros(len(h) + 1, bool)
    head[heads] = True
    stop = np.flatnonzero(stop)
    out, at = [], 0
    for end, new in zip(stop.tolist(), head[stop].tolist()):
        while end - at > MOST_LINES:
            out.append((at, at + MOST_LINES))
            at += MOST_LINES
        if end - at >= LEAST_LINES:
            out.append((at, end))
            at = end
        if new:
            at = end
    f, t = edge[np.array(out, np.int64).reshape(-1, 2).T]
    enough = t - f >= LEAST_WORDS
    return f[enough], t[enough]


_PLACE = "id long, hash long, a int, b int"
#: A piece as it is dealt: its digest, its place (document, first word), its words, those of the pieces before and after it,
#: and whether its id is null, it is a chunk of lines, and its task has more of its digest.
_PIECE = np.dtype([("digest", "<u8"), ("null", "u1"), ("id", "<i8"), ("hash", "<i8"), ("a", "<i4"), ("b", "<i4"), ("before", "<u2"), ("after", "<u2"), ("lines", "u1"), ("more", "u1")])
_FOUND = "kind int, digest long, id long, hash long, a int, b int, low int, high int, lines boolean, fid long, fhash long, fa int"
#: Words at the ends of an agreement in which other words around may have put the ends of pieces elsewhere.
UNSURE = REACH + 3


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces by digest and place, each place once with the marks of all, and which of them are the first of a digest."""
    rows = rows[np.argsort(rows["digest"], kind="stable")]
    equal = np.flatnonzero(np.diff(rows["digest"]) == 0)
    if len(equal):  # only those of one digest need an order of their own
        at = np.unique(np.concatenate((equal, equal + 1)))
        own = rows[at]
        rows[at] = own[np.lexsort((own["a"], own["hash"], own["id"], own["null"], own["digest"]))]
    same = np.ones(max(0, len(rows) - 1), bool)
    for name in ("digest", "null", "id", "hash", "a"):
        same &= rows[name][1:] == rows[name][:-1]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(rows)), bool), ~same)))
    marks = {name: np.maximum.reduceat(rows[name], starts) if len(rows) else rows[name] for name in ("lines", "more")}
    rows = rows[starts]
    for name, mark in marks.items():
        rows[name] = mark
    first = np.ones(len(rows), bool)
    first[1:] = rows["digest"][1:] != rows["digest"][:-1]
    return rows, first


def _together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring texts that are cut into pieces at once: AT_ONCE bytes, or one text that has more."""
    low, size = 0, 0
    for k, text in enumerate(texts):
        if k > low and size + len(text) > AT_ONCE:
            yield low, k
            low, size = k, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def _dealt(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by bucket of their digest, packed: of each digest, the first of those held at once; apart, the others (later)."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        rows, first = _sorted(np.concatenate(held))
        held.clear()
        at = np.flatnonzero(first)
        rows["more"][at] |= np.diff(np.append(at, len(rows))) > 1
        bucket = (rows["digest"] >> np.uint64(16)) % np.uint64(buckets) * np.uint64(2) + (~first).astype(np.uint64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        own, start = np.unique(bucket, return_index=True)
        ends = [*start[1:].tolist(), len(rows)]
        own = own.astype(np.int64)
        packed = [rows[x:y].tobytes() for x, y in zip(start.tolist(), ends)]
        return pa.RecordBatch.from_arrays([pa.array((own >> 1).astype(np.int32)), pa.array(own & 1 == 1), pa.array(packed, pa.binary())], ["bucket", "later", "packed"])

    n = 0
    for b in batches:
        null = b.column("id").is_null().to_numpy(zero_copy_only=False)
        ids, hashes = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("id", "hash"))
        texts = b.column("text").cast(pa.binary()).to_pylist()
        for low, high in _together(texts):
            own, f, t, digest, lines = pieces_of(texts[low:high])
            rows = np.zeros(len(f), _PIECE)
            k = len(f) - int(lines.sum())  # pieces of words come first, and follow each other
            size, same = np.minimum(t[:k] - f[:k], 65_535), own[1:k] == own[: max(0, k - 1)]
            rows["before"][1:k], rows["after"][: max(0, k - 1)] = np.where(same, size[:-1], 0), np.where(same, size[1:], 0)
            at = own + low
            rows["digest"], rows["null"], rows["id"], rows["hash"], rows["a"], rows["b"], rows["lines"] = digest, null[at], ids[at], hashes[at], f, t, lines
            held.append(rows)
            n += len(f)
            if n >= HELD:
                yield flush()
                n = 0
    if n:
        yield flush()


def _rows(kind: int, rows: np.ndarray, first: np.ndarray | None = None) -> pa.RecordBatch:
    ids = lambda x: pa.array(x["id"], pa.int64(), mask=x["null"] == 1)
    n = len(rows)
    own = [pa.array(np.full(n, kind, np.int32)), pa.array(rows["digest"].view(np.int64)), ids(rows), pa.array(rows["hash"]), pa.array(rows["a"]), pa.array(rows["b"]), pa.array(rows["a"] - rows["before"].astype(np.int32)), pa.array(rows["b"] + rows["after"].astype(np.int32)), pa.array(rows["lines"] == 1)]
    of = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())] if first is None else [ids(first), pa.array(first["hash"]), pa.array(first["a"])]
    return pa.RecordBatch.from_arrays([*own, *of], [f.split()[0] for f in _FOUND.split(", ")])


@lean()
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole buckets: later places with the first of their digest (0), later places alone (1), and their firsts (2).

    What is held is one piece for each digest and flush of _dealt(); later places pass through.
    """
    held: list[np.ndarray] = []
    for b in batches:
        for later, packed in zip(b.column("later").to_pylist(), b.column("packed").to_pylist()):
            rows = np.frombuffer(packed, _PIECE)
            if later:
                yield _rows(1, rows)
            else:
                held.append(rows)
    if held:
        rows, first = _sorted(np.concatenate(held))
        held.clear()
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(rows)))
        own = np.repeat(at, size)
        more = np.maximum.reduceat(rows["more"], at) == 1
        yield _rows(2, rows[at[more]])
        rest = np.flatnonzero(~first)
        for k in range(0, len(rest), HELD):
            yield _rows(0, rows[rest[k : k + HELD]], rows[own[rest[k : k + HELD]]])


@lean()
def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of words that is asked for: its document, its place, and its words with AROUND more to each side."""
    for b in batches:
        own, f, t, left, content = [], [], [], [], []
        for i, (text, asked) in enumerate(zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("asked").to_pylist())):
            words = text.split()  # of bytes, at the blanks that WORD leaves out
            for run in asked:
                low = max(0, run["a"] - AROUND)
                own.append(i)
                f.append(run["a"])
                t.append(run["b"])
                left.append(run["a"] - low)
                content.append(b" ".join(words[low : run["b"] + AROUND]))
        at = pa.array(own, pa.int64())
        columns = [b.column("id").take(at), b.column("hash").take(at), pa.array(f, pa.int32()), pa.array(t, pa.int32()), pa.array(left, pa.int32()), pa.array(content, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "a", "b", "before", "content"])


def cut_runs(text: bytes | None, runs: list[tuple]) -> bytes | None:
    """A text without its words that agree with the first place of a run (a, b, lines, before, content), where they are enough.

    Texts and contents are UTF-8.
    """
    if not runs:
        return text
    words = text.split()  # of bytes, at the blanks that WORD leaves out
    n = len(words)
    gone = np.zeros(n + 1, np.int8)
    for a, b, lines, before, content in runs:
        other = content.split()
        x, y = before, before + b - a
        if words[a:b] != other[x:y]:
            continue
        while a and x and words[a - 1] == other[x - 1]:
            a, x = a - 1, x - 1
        while b < n and y < len(other) and words[b] == other[y]:
            b, y = b + 1, y + 1
        if lines or b - a >= PASSAGE:
            gone[a:b] = 1
    if not gone.any():
        return text
    raw = np.frombuffer(text, np.uint8)
    inner = np.zeros(len(raw) + 1, bool)
    inner[1:] = (raw != 32) & ((raw - np.uint8(9)) > 4)
    starts = np.flatnonzero(inner[1:] & ~inner[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone)))).tolist()
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(text[at : starts[a] if a else 0])
        at = starts[b] if b < n else len(text)
    return b"".join([*out, text[at:]])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """id, hash, runs: for each document (id and hash of its text) its runs of pieces that an earlier place holds, too.

    A run names its words from a to b, and content: the words of its first place, `before` of them ahead of the run.
    Places are ordered by (doc_id, hash of the text, word), null ids last; a document's own earlier words count.
    """
    bounded_batches(docs.sparkSession)
    named = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())

    @lean()
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(buckets, batches)

    dealt = named.mapInArrow(deal, "bucket int, later boolean, packed binary").repartition(buckets, "bucket")
    found = materialize(dealt.mapInArrow(_met, _FOUND), "found")
    first = found.where("kind = 2").select("digest", F.struct("id", "hash", "a").alias("first"))
    own = ["id", "hash", "a", "b", "low", "high", "lines"]
    alone = found.where("kind = 1").select("digest", *own).join(first, "digest")
    later = alone.select(*own, F.col("first.id").alias("fid"), F.col("first.hash").alias("fhash"), F.col("first.a").alias("fa"))
    later = later.unionByName(found.where("kind = 0").select(*own, "fid", "fhash", "fa"))
    # pieces that follow each other are a stretch; an agreement reaches into the pieces beside it, but not beyond, so that
    # a short stretch without a chunk of lines can't be a passage
    w = Window.partitionBy("id", "hash").orderBy("a", "b")
    new = F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    later = later.withColumn("new", new.cast("int")).withColumn("stretch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("id", "hash", "stretch")
    reach = F.max("high").over(whole) - F.min("low").over(whole) + 2 * UNSURE
    later = later.withColumn("able", F.bool_or("lines").over(whole) | (reach >= PASSAGE)).where("able")
    key = ["id", "hash", "fid", "fhash", "shift"]
    later = later.select("id", "hash", "fid", "fhash", (F.col("fa") - F.col("a")).alias("shift"), "a", "b", "lines")
    w = Window.partitionBy(*key).orderBy("a", "b")
    apart = later.withColumn("far", F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    part = apart.withColumn("part", F.sum(F.col("far").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = part.groupBy(*key, "part").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.bool_or("lines").alias("lines"))
    runs = materialize(runs.select("id", "hash", "fid", "fhash", (F.col("a") + F.col("shift")).alias("fa"), (F.col("b") + F.col("shift")).alias("fb"), "a", "b", "lines"), "runs")
    wanted = runs.groupBy(F.col("fid").alias("i"), F.col("fhash").alias("h")).agg(F.collect_set(F.struct(F.col("fa").alias("a"), F.col("fb").alias("b"))).alias("asked"))
    wanted = materialize(wanted, "wanted")
    # only texts that are asked for are shuffled, and equal rows are one document
    near, _ = parted_by_ids(named, "id", wanted.select("i"))
    texts = near.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).select("id", "hash", "text", "asked")
    texts = texts.groupBy("id", "hash").agg(F.first("text").alias("text"), F.first("asked").alias("asked"))
    around = materialize(texts.mapInArrow(_surroundings, f"{_PLACE}, before int, content string"), "around")
    around = around.withColumnsRenamed({"id": "fid", "hash": "h", "a": "x", "b": "y"}).withColumnRenamed("fid", "i")
    met = runs.join(around, F.col("fid").eqNullSafe(F.col("i")) & (F.col("fhash") == F.col("h")) & (F.col("fa") == F.col("x")) & (F.col("fb") == F.col("y")))
    return met.groupBy("id", "hash").agg(F.collect_list(F.struct("a", "b", "lines", "before", "content")).alias("runs"))


def without_passages(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed from text, up to the words at which they differ; all rows and columns stay.

    Of equal runs the first place stays. What goes holds a repeated chunk of lines, or is PASSAGE words long at least.
    Null and empty texts stay as they are, and a text may become empty. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    i, h, runs = fresh(docs, "id", "hash", "runs")
    marks = materialize(repeated_runs(docs), "marks").select(F.col("id").alias(i), F.col("hash").alias(h), F.col("runs").alias(runs))

    @F.arrow_udf("string")
    @lean()
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, found in batches:
            every = found.flatten()
            columns = dict(zip((f.name for f in every.type), every.flatten()))
            columns["content"] = columns["content"].cast(pa.binary())
            rows = list(zip(*(columns[c].to_pylist() for c in ("a", "b", "lines", "before", "content"))))
            ends = np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            own = text.cast(pa.binary()).to_pylist()
            yield pa.array([cut_runs(t, rows[a:b]) for t, a, b in zip(own, [0, *ends], ends)], pa.binary()).cast(pa.string())

    near, others = parted_by_ids(docs, "doc_id", marks.select(i))
    joined = near.join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left")
    return joined.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(cut("text", runs))).select(*docs.columns).unionByName(others)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, kept_chars, removed_chars, kept_sha256 of every row; a null text counts as empty. See without_passages()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_passages(docs.withColumn("whole", F.length("text")))
    return out.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.coalesce(F.col("whole") - F.length("text"), F.lit(0)).cast("long").alias("removed_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
