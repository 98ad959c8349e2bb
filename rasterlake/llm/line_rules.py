"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

A line with a word fails
- boilerplate: if it holds one of a few fixed phrases of notices and site furniture;
- navigation: if a third of its words or more are separators alone (| » > / • -), or hold a separator `|`;
- punctuation: if its last word doesn't end as a sentence does (a line of 20 words or more may be cut off, if another
  word ends so), or a third of its words or more end in two marks.
Lines without a word never fail and never count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import bounded_batches, lean, table

#: Phrases of the boilerplate rule, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "copyright", "privacy policy", "terms of service",
    "terms of use", "cookie policy", "accept cookies", "subscribe to our", "sign up for", "click here", "lorem ipsum",
)
#: What a sentence ends with: a mark, and then closing quotes or brackets.
ENDS = r"[.!?:;…。！？][\"'”’»)\]]*$"
LONG_LINE = 20
#: A word that ends in two marks or more, ellipses and closing quotes or brackets aside.
MARKED = r"[#*$%&|<>!?.,;:]{2}$"
ELLIPSIS = r"\.\.\.$"
#: Words with these separators speak for navigation.
SEPARATOR = r"^[|»>/•-]+$|\|"
#: A document is rejected if failing lines hold more than this percentage of its word characters.
MOST_LOST = 40
#: Base rules: at least so many words; at most this percentage of them within repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

_ends, _marked, _ellipsis, _separator = (re.compile(x).search for x in (ENDS, MARKED, ELLIPSIS, SEPARATOR))
_symbols = re.compile(r"[#*$%&|<>]").findall
_word = re.compile(r"[^\x20\x09-\x0D]+").findall
_suspect = re.compile(r"[#*$%&|<>!?.,;:]{2}(?:[\x20\x09-\x0D]|$)|[|»>/•-]").search


def failing(line: str, words: list[str]) -> str | None:
    """The rule that a line with words fails first, or None."""
    low = line.lower()
    if any(p in low for p in BOILERPLATE):
        return "boilerplate"
    if not _ends(words[-1]) and not (len(words) >= LONG_LINE and any(map(_ends, words))):
        return "punctuation"
    if _suspect(line):
        if 3 * sum(1 for w in words if _separator(w)) >= len(words):
            return "navigation"
        if 3 * sum(1 for w in words if _marked(w) and not _ellipsis(w)) >= len(words):
            return "punctuation"
    return None


def in_repeats(words: list[str]) -> int:
    """How many words lie in a 3-word window that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, window, count = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def judged(text: str | None) -> dict:
    """Counts of a whole text, the cleaned text, and the verdict. Null is a text without words."""
    kept_lines, lost, seen = [], 0, set()
    chars = n = dup = failed = 0
    every: list[str] = []
    for line in (text or "").split("\n"):
        words = _word(line)
        if words:
            dup += line in seen
            seen.add(line)
            size = sum(map(len, words))
            n += len(words)
            chars += size
            every += words
            if failing(line, words):
                lost += size
                failed += 1
                continue
        kept_lines.append(line)
    repeats = in_repeats(every)
    base_failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    return {
        "n_words": n, "word_chars": chars, "n_symbols": len(_symbols(text)) if text else 0, "n_dup_lines": dup, "n_repeat_words": repeats,
        "base_failed": base_failed, "kept": not base_failed and 100 * lost <= MOST_LOST * chars, "n_failed_lines": failed, "lost_chars": lost,
        "cleaned": None if text is None else "\n".join(kept_lines),
    }


COUNTS = "n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, base_failed: boolean, kept: boolean, n_failed_lines: bigint, lost_chars: bigint"
_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def line_rules(text: Column, cleaned: bool = True) -> Column:
    """struct of judged()'s fields for each text, in one pass; without the cleaned text if it isn't asked for."""
    schema = COUNTS + (", cleaned: string" if cleaned else "")
    fields = [f.split(": ") for f in schema.split(", ")]

    @F.arrow_udf(f"struct<{schema}>")
    @lean()
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [judged(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], _ARROW[t]) for k, t in fields], [k for k, _ in fields])

    return run(text)


def clean_documents(docs: DataFrame, text: str = "text", into: str = "rules") -> DataFrame:
    """docs with a struct column of counts, verdict and cleaned text. Rows are neither dropped nor merged.

    A null text counts as empty, fails the base rules and stays null. A column called like `into` is replaced.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, line_rules(F.col(text)))


def rated_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and what failing lines took; every row, null or repeated ids included."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", line_rules(F.col("text"), cleaned=False).alias("rules")).select("doc_id", "rules.*")


def op4_line_rules(spark, sf_dir: str) -> DataFrame:
    """rated_documents() of all documents."""
    return rated_documents(table(spark, sf_dir, "documents"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BOILER = " OR ".join(f"contains(lower(line), {_quoted(p)})" for p in BOILERPLATE)
LINE_RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS li FROM d),
w AS (SELECT rid, li, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words FROM l),
lw AS (
  SELECT rid, li, line, words, row_number() OVER (PARTITION BY rid, line ORDER BY li) AS nth,
    list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS size,
    ({_BOILER}
     OR NOT regexp_matches(words[-1], {_quoted(ENDS)})
       AND NOT (len(words) >= {LONG_LINE} AND len(list_filter(words, lambda x: regexp_matches(x, {_quoted(ENDS)}))) > 0)
     OR 3 * len(list_filter(words, lambda x: regexp_matches(x, {_quoted(SEPARATOR)}))) >= len(words)
     OR 3 * len(list_filter(words, lambda x: regexp_matches(x, {_quoted(MARKED)}) AND NOT regexp_matches(x, {_quoted(ELLIPSIS)}))) >= len(words)) AS bad
  FROM w WHERE len(words) > 0),
per AS (
  SELECT rid, sum(len(words))::BIGINT AS n_words, sum(size)::BIGINT AS word_chars, count(*) FILTER (nth > 1) AS n_dup_lines,
    count(*) FILTER (bad) AS n_failed_lines, coalesce(sum(size) FILTER (bad), 0)::BIGINT AS lost_chars
  FROM lw GROUP BY rid),
e AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
pos AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS p FROM e),
tri AS (SELECT rid, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY rid ORDER BY p)),
rep AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT p + k)::BIGINT AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY rid),
j AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM d LEFT JOIN per USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept, n_failed_lines, lost_chars
FROM b
"""
