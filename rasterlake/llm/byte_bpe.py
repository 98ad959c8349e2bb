"""Byte-level BPE encoding and decoding in time linear in the text.

A piece's bytes are read as Latin-1, so that an Aho-Corasick automaton over the vocabulary finds the longest token at
every place in one pass. From the left, the longest token is tried first; it stands only if it and its left neighbour
could be neighbours after the merges (memoised), else the next shorter prefix is tried, and a place from which nothing
leads on is marked and never entered again. The result is exactly what the merges by rank give.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import CACHES, bounded_batches, lean, table

#: Words, pieces and pairs remembered by a worker, in two generations each. Only speed depends on them.
WORDS_KEPT, PAIRS_KEPT, LONGEST_KEPT = 250_000, 500_000, 48


class Recent(dict):
    """A dict of the last `most` to twice as many entries put or looked up through it."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        """From the older generation, or None."""
        if (found := self.older.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


def load_ranks(path: str) -> list[bytes]:
    """Tokens by id from a .tiktoken file."""
    with open(path, "rb") as f:
        pairs = sorted((int(n), base64.b64decode(t)) for t, n in (line.split() for line in f if line.strip()))
    if [n for n, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


class Codec:
    """Encodes and decodes by the ranks of `tokens`, each match of `pattern` separately; no special tokens."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        self.pieces = regex.compile(pattern).findall
        self.text = [t.decode("latin-1") for t in tokens]
        self.ids = {t: i for i, t in enumerate(self.text)}
        self.length = [len(t) for t in tokens]
        self.parts = [self._last_merge(t) for t in self.text]
        reachable = [len(t) == 1 or self.parts[i] is not None for i, t in enumerate(self.text)]
        #: Each merge has parts of lower rank, as in any trained vocabulary; else backtracking would not be exact.
        if any(p and max(p) >= i for i, p in enumerate(self.parts)):
            raise ValueError("a token's parts must have lower ranks than the token")
        self.joined = {p: i for i, p in enumerate(self.parts) if p}
        self.finder = ahocorasick.Automaton()
        for i, t in enumerate(self.text):
            if reachable[i]:
                self.finder.add_word(t, i)
        self.finder.make_automaton()
        self.shorter = [self._prefix(t, reachable) for t in self.text]
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.known, self.pairs = Recent(WORDS_KEPT), Recent(PAIRS_KEPT)
        self.by_words = pattern == BY_WORDS

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two tokens whose merge gives `text`, or None if it is one byte or merges never give it."""
        parts = list(text)
        while len(parts) > 2:
            rank, at = min((self.ids.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None

    def _prefix(self, text: str, reachable: list[bool]) -> int:
        for n in range(len(text) - 1, 0, -1):
            i = self.ids.get(text[:n], -1)
            if i >= 0 and reachable[i]:
                return i
        return -1

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        They don't if somewhere on the way, with both sides undone down to that point, the two tokens at the border
        would have merged earlier than the token that was undone.
        """
        # bound: only a merge of lower rank than what was undone last is in time. An equal rank to the left goes first.
        bound, a, b, result = len(self.tokens), left, right, True
        while True:
            if self.joined.get((a, b), bound) < bound:
                result = False
                break
            undo_left = a > b
            if self.parts[a if undo_left else b] is None:
                undo_left = not undo_left
                if self.parts[a if undo_left else b] is None:
                    break
            if undo_left:
                bound, a = a, self.parts[a][1]
            else:
                bound, b = b + 1, self.parts[b][0]
        self.pairs.put(left << 32 | right, result)
        return result

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        s = piece.decode("latin-1")
        if (whole := self.ids.get(s)) is not None:
            return [whole]
        n, length, shorter, fits, pairs = len(s), self.length, self.shorter, self.fits, self.pairs
        longest = [-1] * n
        for last, tok in self.finder.iter(s):
            longest[last + 1 - length[tok]] = tok
        out: list[int] = []
        dead, at, tok = bytearray(n + 1), 0, longest[0]
        while True:
            to = at + length[tok]
            if dead[to]:
                fit = False
            elif out and (fit := pairs[out[-1] << 32 | tok]) is None:
                fit = fits(out[-1], tok)
            if not out and not dead[to] or fit:
                out.append(tok)
                if to == n:
                    return out
                at, tok = to, longest[to]
            elif shorter[tok] >= 0:
                tok = shorter[tok]
            else:
                dead[at] = 1
                tok = out.pop()
                at -= length[tok]

    def _new(self, word: str) -> bytes:
        """Packed ids of a text that isn't in memory."""
        known, packed, found = self.known, self.packed, []
        for piece in (pieces := self.pieces(word)):
            if (ids := known[piece]) is None:
                ids = b"".join([packed[t] for t in self.encode_piece(piece.encode())])
                if len(piece) <= LONGEST_KEPT:
                    known.put(piece, ids)
            found.append(ids)
        ids = b"".join(found)
        if len(pieces) > 1 and len(word) <= LONGEST_KEPT:
            known.put(word, ids)
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null is as empty.

        Where words are parted by single blanks and line feeds only, no match of the usual pattern crosses from a word
        to the blank after it, so that each word, with the blank before it, can be looked up as a whole.
        """
        if not text:
            return b""
        if not (self.by_words and len(text.split()) == text.count(" ") + text.count("\n") + 1):
            return self._new(text)
        known, new, out = self.known, self._new, []
        feed = known["\n"] or new("\n")
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(known[first] or new(first))
            out += [known[w] or new(w) for w in [f" {w}" for w in rest]]
            out.append(feed)
        return b"".join(out[:-1])

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


#: The pattern for which encode() may go by words.
BY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_codecs: dict[tuple[str, str], Codec] = {}
CACHES["bpe"] = _codecs.clear


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, built once a worker. The file must be at this path on every executor."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """struct(ids binary, decoded binary): ids packed as little-endian u32, and the bytes that they decode to."""

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    @lean("bpe")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            ids = [c.encode(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())], ["ids", "decoded"])

    return run(text)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with a column of packed ids. Null and empty texts have no ids; repeated rows are encoded alike.

    A column called like `into` is replaced; all others pass unchanged.
    """
    bounded_batches(df.sparkSession)
    return df.withColumn(into, round_trip(F.col(text), path, pattern)["ids"])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the bytes that a column of packed ids stands for; null is as empty. A column called `into` is replaced."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("binary")
    @lean("bpe")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            yield pa.array(map(c.decode, batch.to_pylist()), pa.binary())

    return df.withColumn(into, run(F.col(ids)))


def encoded_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, ties and repeated rows included; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    both = docs.select("doc_id", round_trip(F.col("text"), path, pattern).alias("both"))
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(both.ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("both.ids", 256).alias("ids_sha256"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """encoded_documents() of all documents, by the vocabulary that the contract names."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encoded_documents(table(spark, sf_dir, "documents"), str(path), public_tokenizers.PATTERN)
