"""Exact Jaccard self-join of documents over word n-grams by a token-group matrix.

Documents with equal sets of shingles are one class. Tokens (hashed shingles) have one order for all, rare ones first by
counts over the whole corpus; of two similar classes, the leading fifths of the sets meet. Classes are partitioned into
groups of similar ones: every token's classes are compared to one of them, and those found similar are a group. The matrix
holds the union of the leading tokens of each group's members, one row for each token and group, with the sizes of the
members that have it. A class is then a query: its tokens are looked up in the matrix, their number in a group's union
bounds its overlap with any member, and only groups that the bound lets through are opened. Members of an opened group
are compared with the query, whole set against whole set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import bounded_batches, fresh, lean, materialize, parted_by_ids, table
from rasterlake.llm.components import components

#: Words of a shingle.
WORDS = 5
#: Counters of tokens and the ranges that they are added up by; postings of one bucket, about; the documents that a token
#: is in from which it is dealt without a bucket; postings that a task holds before it passes them on. Speed, not results.
SLOTS, RANGES, BUCKET_POSTINGS, HOT, HELD = 1 << 22, 64, 500_000, 100_000, 500_000

_P = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; with fewer words than WORDS, all of them as one."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # of bytes: A-Z and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _P + w[k : len(w) - size + 1 + k]
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return np.unique(h ^ (h >> np.uint64(31)))


def leading(n: int) -> int:
    """How many leading tokens of a set of n must meet those of any set that is similar to it."""
    return n - (4 * n + 4) // 5 + 1


def led(n: str):
    """leading() of a column."""
    return F.expr(f"{n} - (4 * {n} + 4) div 5 + 1")


def _slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


@lean()
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition: its counters of tokens, a row for each range of them, packed."""
    counts = np.zeros(SLOTS, np.uint32)
    for b in batches:
        for text in b.column("text").to_pylist():
            counts[_slots(shingles(text))] += 1
    for r, part in enumerate(counts.reshape(RANGES, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["range", "counts"])


@lean()
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of all partitions, added up range by range: all rows of a range are in one partition here."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for r, packed in zip(b.column("range").to_pylist(), b.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(packed), np.uint32)
            sums[r] = sums[r] + part if r in sums else part.astype(np.int64)
    for r, part in sums.items():
        # an eighth of a doubling is exact enough for the order of tokens
        levels = np.minimum(np.rint(8 * np.log2(1.0 + part)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([int(part.sum())], pa.int64()), pa.array([levels.tobytes()], pa.binary())], ["range", "total", "levels"])


def _token_levels(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The level of each slot in the order of tokens (0: rare), SLOTS bytes at any input, and the number of tokens.

    Counts of unrelated tokens fall together in a slot, so a slot is rare up to what chance explains; above, its level is
    the doublings. Levels from HOT_LEVEL on stand for HOT documents or more.
    """
    rows = texts.select("text").mapInArrow(_counted, "range int, counts binary").repartition("range").mapInArrow(_added, "range int, total long, levels binary").collect()
    logs = np.zeros(SLOTS, np.uint8).reshape(RANGES, -1)
    for r in rows:
        logs[r["range"]] = np.frombuffer(r["levels"], np.uint8)
    total = sum(r["total"] for r in rows)
    chance = total / SLOTS + 4 * (total / SLOTS) ** 0.5 + 2
    counts = 2.0 ** (np.arange(256) / 8) - 1
    level = np.where(counts < chance, 0, 1 + np.floor(np.log2(np.maximum(counts / chance, 1)))).astype(np.uint8)
    level[counts - chance >= HOT] |= HOT_BIT
    return level[logs.ravel()], total


#: Of a level: that the token is in HOT documents or more.
HOT_BIT = 0x40


@lean()
def _posted(levels: np.ndarray, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, hash, n, node, other, last), and leading tokens by bucket (bucket, and tokens, nodes, places packed).

    A class is named by 128 bits of its set, node and other. Hot tokens are in bucket -1.
    """
    names = ["id", "hash", "n", "node", "other", "last", "bucket", "tokens", "nodes", "places"]
    types = [*[pa.int64()] * 6, pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    tokens: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    places: list[np.ndarray] = []
    hot: list[np.ndarray] = []
    seen: set[int] = set()

    def flush() -> pa.RecordBatch:
        t, v, i, far = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(places), np.concatenate(hot)
        bucket = np.where(far, -1, ((t >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32))
        order = np.argsort(bucket, kind="stable")
        t, v, i, bucket = t[order], v[order], i[order], bucket[order]
        own, start = np.unique(bucket, return_index=True)
        ends = [*start[1:].tolist(), len(t)]
        cols = [own.tolist(), *([x[a:e].tobytes() for a, e in zip(start, ends)] for x in (t, v, i))]
        for held in (tokens, nodes, places, hot, seen):
            held.clear()
        empty = [pa.nulls(len(own), k) for k in types[:6]]
        return pa.RecordBatch.from_arrays([*empty, *(pa.array(c, k) for c, k in zip(cols, types[6:]))], names)

    held = 0
    for b in batches:
        rows: list[list] = [[], [], [], []]
        for text in b.column("text").to_pylist():
            h = shingles(text)
            if not len(h):
                for r, x in zip(rows, (0, None, None, None)):
                    r.append(x)
                continue
            name = xxhash.xxh3_128_intdigest(h.tobytes())
            node = (name >> 64) - (1 << 63)
            level = levels[_slots(h)]
            order = np.lexsort((h, level))[: leading(len(h))]
            last = order[-1]
            for r, x in zip(rows, (len(h), node, (name & ((1 << 64) - 1)) - (1 << 63), (int(level[last]) << 56) | int(h[last] >> np.uint64(8)))):
                r.append(x)
            if node not in seen:
                seen.add(node)
                tokens.append(h[order])
                nodes.append(np.full(len(order), node, np.int64))
                places.append(np.minimum(np.arange(len(order)), 65_535).astype(np.uint16))  # a lower place only bounds less
                hot.append(level[order] >= HOT_BIT)
                held += len(order)
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), *(pa.array(r, k) for r, k in zip(rows, types[2:6])), *(pa.nulls(n, k) for k in types[6:])], names)
        if held >= HELD:
            yield flush()
            held = 0
    if tokens:
        yield flush()


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("tokens", np.uint64), ("nodes", np.int64), ("places", np.uint16)))


def _shared(t: pa.Table) -> pa.Table:
    """Of one bucket: token, node, place for tokens that two classes or more have; each pair once."""
    token, node, place = _unpacked(t)
    order = np.lexsort((node, token))
    token, node, place = token[order], node[order], place[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, place = token[new], node[new], place[new]
    same = token[1:] == token[:-1]
    keep = np.zeros(len(token), bool)
    keep[1:] |= same
    keep[:-1] |= same
    return pa.table({"token": token[keep].view(np.int64), "node": node[keep], "place": place[keep].astype(np.int32)})


@lean()
def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        token, node, place = _unpacked(b)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node), pa.array(place.astype(np.int32))], ["token", "node", "place"])


@lean()
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [shingles(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(packed, pa.binary())], ["name", "tokens"])


@lean()
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])


def _least(u: str, v: str):
    """How many shingles sets of these sizes share at least if they are similar."""
    return F.ceil((F.col(u) + F.col(v)) * 4 / 9 - 1e-9).cast("long")


def _opened(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (u, v, shared): those that are similar, u, v. Only pairs that the bound lets through are compared.

    In the set whose leading tokens end first, all of them are known to be in the other set or not, so that it has
    `led - shared` tokens at least that the other lacks; more than `n - least` it can't have.
    """
    side = lambda a: classes.select(F.col("name").alias(a), F.col("n").alias(f"n{a}"), F.col("last").alias(f"last{a}"))
    least = _least("nu", "nv")
    first = lambda n: F.col("shared") + 1 >= led(n) - (F.col(n) - least)
    bound = F.when(F.col("lastu") <= F.col("lastv"), first("nu")).otherwise(first("nv"))
    sized = (100 * F.least("nu", "nv") >= 80 * F.greatest("nu", "nv")) & bound
    open_ = materialize(pairs.join(side("u"), "u").join(side("v"), "v").where(sized).select("u", "v"), "open")
    names = open_.select(F.col("u").alias("name")).unionByName(open_.select(F.col("v").alias("name"))).distinct()
    needed = materialize(names.join(classes.select("name", "rep"), "name").select("name", F.col("rep.id").alias("i"), F.col("rep.hash").alias("h")), "needed")
    # a filter of fixed size over ids keeps most other texts from being shuffled; the join after it is exact
    near, _ = parted_by_ids(texts, "id", needed.select("i"))
    own = near.join(needed, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).select("name", "text").dropDuplicates(["name"])
    sets = materialize(own.mapInArrow(_sets, "name long, tokens binary"), "sets")
    both = open_.join(sets.select(F.col("name").alias("u"), F.col("tokens").alias("x")), "u").join(sets.select(F.col("name").alias("v"), F.col("tokens").alias("y")), "v")
    return materialize(both.select("u", "v", "x", "y").mapInArrow(_similar, "u long, v long"), "links")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """texts (id, hash, text), rows (id, hash, n, name), classes (name, rep, n, last) and leading tokens that meet others.

    The latter are token, name, n, last, and own: how many of the class's leading tokens meet none. Classes that can't be
    similar to any set, because too many meet none, are left out of them.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    levels, total = _token_levels(texts)
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    buckets = max(8, int(total * 0.21 / BUCKET_POSTINGS))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _posted(shared.value, buckets, batches)

    posted = materialize(texts.mapInArrow(post, "id long, hash long, n long, node long, other long, last long, bucket int, tokens binary, nodes binary, places binary"), "posted")
    rows = posted.where("n is not null").select("id", "hash", "n", "node", "other", "last")
    rep = F.struct(F.col("id").isNull().alias("null"), "id", "hash")
    classes = rows.where("n > 0").groupBy("node", "other").agg(F.min(rep).alias("rep"), F.min("n").alias("n"), F.min("last").alias("last"))
    # two sets of one node, of which there are a few in 10**10, are told apart by the other half of their names
    nth = F.row_number().over(Window.partitionBy("node").orderBy("other"))
    classes = materialize(classes.withColumn("name", F.when(nth == 1, F.col("node")).otherwise(F.xxhash64("node", "other"))), "classes")
    rows = rows.join(classes.select(F.col("node").alias("x"), F.col("other").alias("y"), "name"), (F.col("node") == F.col("x")) & (F.col("other") == F.col("y")), "left").select("id", "hash", "n", "name")
    dealt = posted.where("bucket >= 0").select("bucket", "tokens", "nodes", "places").groupBy("bucket").applyInArrow(_shared, "token long, node long, place int")
    hot = posted.where("bucket < 0").select("tokens", "nodes", "places").mapInArrow(_hot, "token long, node long, place int").groupBy("token", "node").agg(F.min("place").alias("place"))
    met = dealt.unionByName(hot).join(classes.select("node", "name", "n", "last"), "node")
    own = led("n") - F.count(F.lit(1)).over(Window.partitionBy("node", "name"))
    met = met.withColumn("own", own).where("own <= n - (4 * n + 4) div 5").select("token", "name", "n", "last", "own")
    return texts, rows, classes.select("name", "rep", "n", "last"), materialize(met, "met")


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, hash, n, name) of all documents, classes, and (node, root) of the classes that are similar to another."""
    texts, rows, classes, met = _classes(docs)
    # groups: each token's classes against the one with the fewest leading tokens of its own, which is the one that edited
    # copies were most likely made from
    pivot = met.groupBy("token").agg(F.min(F.struct("own", F.xxhash64("name").alias("h"), F.col("name").alias("p"))).alias("s")).select("token", F.col("s.p").alias("v"))
    stars = met.join(pivot, "token").where("name <> v").groupBy(F.col("name").alias("u"), "v").agg(F.count(F.lit(1)).alias("shared"))
    groups = materialize(components(_opened(stars, classes, texts)), "groups")
    # the matrix: of tokens that lie in two groups or more, each group that has them, with what bounds its members
    rooted = met.join(groups.withColumnRenamed("node", "name"), "name", "left").withColumn("grp", F.coalesce("root", "name")).drop("root")
    across = rooted.groupBy("token").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a <> b").select("token")
    rest = materialize(rooted.join(across, "token", "left_semi"), "rest")
    matrix = rest.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("last").alias("end"))
    # a query finds the members whose leading tokens end where its own do or later: there, tokens of its own are in none
    reach = F.expr("least(9 * (n - own) div 4 - n, 5 * n div 4)")
    query = rest.select("token", F.col("name").alias("u"), "n", "last", F.col("grp").alias("g"), reach.alias("reach"))
    overlap = query.join(matrix, "token").where("grp <> g and low <= reach and 5 * high >= 4 * n and end >= last")
    overlap = overlap.groupBy("u", "grp").agg(F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"), F.first("n").alias("n"), F.first("last").alias("last"), F.first("reach").alias("reach"))
    small = F.greatest("low", F.expr("(4 * n + 4) div 5"))
    good = F.col("shared") + 1 >= led("n") - (F.col("n") - F.ceil((F.col("n") + small) * 4 / 9 - 1e-9).cast("long"))
    asked = materialize(overlap.where(good).select("u", "grp", "n", "last", "reach"), "asked")
    member = rest.select("grp", F.col("name").alias("v"), F.col("n").alias("nv"), F.col("last").alias("lastv")).distinct()
    opened = asked.join(member, "grp").where("nv <= reach and 5 * nv >= 4 * n and lastv >= last")
    opened = materialize(opened.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "members")
    # of a query and a member: how many leading tokens they share in all
    names = opened.select(F.col("u").alias("name")).unionByName(opened.select(F.col("v").alias("name"))).distinct()
    led_by = materialize(rest.join(names, "name", "left_semi").groupBy("name").agg(F.collect_set("token").alias("t")), "led")
    both = opened.join(led_by.select(F.col("name").alias("u"), F.col("t").alias("x")), "u").join(led_by.select(F.col("name").alias("v"), F.col("t").alias("y")), "v")
    pairs = both.select("u", "v", F.size(F.array_intersect("x", "y")).alias("shared"))
    links = _opened(pairs, classes, texts).unionByName(groups.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return rows, classes, components(links)


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, hash, n, root) and, for each root, its least row: null ids last, then by id and hash of the text."""
    rows, classes, roots = joined(docs)
    named = classes.join(roots, F.col("name") == F.col("node"), "left").select("name", "rep", F.coalesce("root", "name").alias("root"))
    named = materialize(named, "rooted")
    # written, so that the join with the rows has both sides dealt for it and can split a component of very many rows
    least = materialize(named.groupBy("root").agg(F.min("rep").alias("least")), "least")
    return rows.join(named.select("name", "root"), "name", "left").select("id", "hash", "n", "root"), least


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id that is reachable by links, its own included.

    Documents without words, null texts too, have no shingles and are linked with nothing. Rows with equal sets are
    linked with each other, rows with equal ids only where their texts are; a null id is above all others. An empty
    table gives an empty result. Other columns are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    rows, least = _rooted(docs)
    return rows.join(least, "root", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked documents; columns stay as they are.

    The row that stays has the least (doc_id, hash of the text) of its group, null ids last; of rows equal in both, the
    one with the least hash of all columns. Rows without words are linked with nothing, and all stay. An empty table
    gives an empty result.
    """
    i, h, stays, copies = fresh(docs, "id", "hash", "stays", "copies")
    rows, least = _rooted(docs.select("doc_id", "text"))
    marks = rows.where("n > 0").join(least, "root").groupBy("id", "hash").agg(
        F.first(F.col("id").eqNullSafe(F.col("least.id")) & (F.col("hash") == F.col("least.hash"))).alias(stays), F.count(F.lit(1)).alias(copies)
    )
    marks = materialize(marks.where(~F.col(stays) | (F.col(copies) > 1)).withColumnsRenamed({"id": i, "hash": h}), "marks")
    near, others = parted_by_ids(docs, "doc_id", marks.select(i))
    met = near.join(marks.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left").where(F.coalesce(F.col(stays), F.lit(True)))
    single = met.where(F.coalesce(F.col(copies), F.lit(1)) == 1).select(*docs.columns)
    again = met.where(F.col(copies) > 1).groupBy(i, h).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(*[F.col(c) for c in docs.columns])).alias("row"))
    return single.unionByName(again.select("row.*")).unionByName(others)


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents; see near_duplicates() for nulls, ties, empty and repeated rows."""
    return near_duplicates(table(spark, sf_dir, "documents"))
