"""Quality rules over word statistics, with repetition measured by a suffix array over words.

The words of many texts form one sequence. Prefix doubling sorts its suffixes; ranks start with the text, so that suffixes of different
texts never tie. Adjacent suffixes' longest common prefixes come from the kept ranks of each doubling, from the longest step to
the shortest. The widest common prefix interval that a suffix lies in has the larger of the prefixes that it shares with its two neighbours in sorted order, so that these are taken suffix by
suffix instead of forming the intervals: the spans, their union and the longest repeat are the same. A common prefix of at least MIN_REPEAT words is a maximal repeat; the union of all their spans
is the covered part of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import WORD, prepare

WINDOW = 8
#: Repeats of fewer words don't count.
MIN_REPEAT = 8
#: A text is dropped if repeats cover more than this share of its words, or if one repeat alone has more words than this.
MAX_COVERED, MAX_REPEAT = 0.3, 100
#: Words that are sorted together.
CHUNK_WORDS = 150_000
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_fraction double, longest_repeat long, kept boolean"
_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for x in SCHEMA.split(", ")])


def repeats(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the word sequence: the longest prefix of its suffix that occurs elsewhere in the same text, and whether
    its window of WINDOW words does. text: the number of each word's text, ascending."""
    n = len(ids)
    ends = np.searchsorted(text, text, side="right")  # the end of each position's text
    key = text.astype(np.int64) * (int(ids.max()) + 1) + ids
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    levels, step, at = [rank], 1, np.arange(n)
    while step < n:
        counts = np.bincount(rank)
        tied = counts[rank] > 1
        if not tied.any() and step >= WINDOW:
            break
        second = np.zeros(n, np.int64)
        inside = at + step < ends
        second[inside] = rank[at[inside] + step] + 1
        # only tied suffixes are sorted anew: new ranks are old ones, spread, plus the place among the tied
        new = np.cumsum(counts) - counts
        fresh = new[rank]
        idx = np.flatnonzero(tied)
        if len(idx):
            pair = rank[idx] * (n + 1) + second[idx]
            order = np.argsort(pair, kind="stable")
            sorted_pair, group = pair[order], rank[idx][order]
            change = np.r_[True, sorted_pair[1:] != sorted_pair[:-1]]
            first = np.r_[True, group[1:] != group[:-1]]
            place = np.arange(len(order))
            start_of_pair = np.maximum.accumulate(np.where(change, place, 0))
            start_of_group = np.maximum.accumulate(np.where(first, place, 0))
            fresh[idx[order]] += start_of_pair - start_of_group
        rank = fresh
        step *= 2
        levels.append(rank)
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    same = text[a] == text[b]
    i, j, common = a.copy(), b.copy(), np.zeros(n - 1 if n else 0, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r, length = levels[level], 1 << level
        for _ in range(2 if level == len(levels) - 1 else 1):
            ok = same & (i + length <= ends[a]) & (j + length <= ends[b])
            ok[ok] = r[i[ok]] == r[j[ok]]
            common[ok] += length
            i[ok] += length
            j[ok] += length
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest, longest >= WINDOW


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return np.cumsum(marks[:-1]) > 0


def measure(texts: list[str]) -> list[tuple]:
    """For each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat."""
    out: list[tuple] = []
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    sizes: list[int] = []
    for t in texts:
        words = WORD.findall(t)
        ids.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
        sizes.append(len(words))
        lines = [x for x in t.split("\n") if WORD.search(x)] if "\n" in t else []
        out.append((len(words), sum(map(len, words)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines))))
    total = len(ids)
    window_words, span_words, longest_of = (np.zeros(len(texts), np.int64) for _ in range(3))
    if total:
        text = np.repeat(np.arange(len(texts)), sizes)
        longest, window = repeats(np.array(ids, np.int64), text)
        starts = np.flatnonzero(window)
        window_words = np.bincount(text, covered(starts, np.full(len(starts), WINDOW), total), len(texts)).astype(np.int64)
        starts = np.flatnonzero(longest >= MIN_REPEAT)
        span_words = np.bincount(text, covered(starts, longest[starts], total), len(texts)).astype(np.int64)
        np.maximum.at(longest_of, text, longest)
    return [(*x, int(w), int(s), int(m)) for x, w, s, m in zip(out, window_words, span_words, longest_of, strict=True)]


def judge(max_covered: float, max_repeat: int, chunk_words: int = CHUNK_WORDS):
    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in _ARROW]
        for doc_id, (n, chars, symbols, dup, rep, span, longest) in zip(ids, measure(texts), strict=True):
            failed = n < 20 or 100 * rep > 30 * n
            share = span / n if n else 0.0
            for c, v in zip(cols, (doc_id, n, chars, symbols, dup, rep, failed, share, longest, not failed and share <= max_covered and longest <= max_repeat), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                held += len(texts[-1]) // 6
                if held >= chunk_words:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield rows(ids, texts)

    return run


def quality_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row for each row of docs, repeated ones too: doc_id and the columns of SCHEMA.

    A null or empty text has no words: base_failed, not kept. Texts of any length are measured as a whole. kept: base_failed is false, repeats of at least MIN_REPEAT words cover at most
    max_covered of the words, and none is longer than max_repeat words. Other columns are ignored; an empty table gives no rows. One narrow pass; memory:
    CHUNK_WORDS words or one text.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge(max_covered, max_repeat), SCHEMA)


def rules_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: doc_id, n_words, the base columns, base_failed, covered_fraction, kept."""
    return quality_rules(docs).drop("longest_repeat")


#: The same without a suffix array: repeats of eight words or more cover just the words in repeated windows of eight, and one repeat is longer than MAX_REPEAT words if a window of one word more is
#: found twice.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
base AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines
  FROM w
), pos AS (
  SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) >= {WINDOW}
), win AS (
  SELECT r, i, CASE WHEN i + {WINDOW - 1} <= len(words) THEN hash(array_to_string(words[i:i + {WINDOW - 1}], ' ')) END AS h,
         CASE WHEN i + {MAX_REPEAT} <= len(words) THEN hash(array_to_string(words[i:i + {MAX_REPEAT}], ' ')) END AS g FROM pos
), twice AS (
  SELECT r, i, h IS NOT NULL AND count(h) OVER (PARTITION BY r, h) > 1 AS rep, g IS NOT NULL AND count(g) OVER (PARTITION BY r, g) > 1 AS long FROM win
), covered AS (
  SELECT r, max(CASE WHEN rep THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS c, long FROM twice
), reps AS (
  SELECT r, CAST(sum(c) AS BIGINT) AS n_repeat_words, bool_or(long) AS long FROM covered GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
       CASE WHEN n_words > 0 THEN coalesce(n_repeat_words, 0) / CAST(n_words AS DOUBLE) ELSE 0 END AS covered_fraction,
       NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AND NOT coalesce(long, false) AS kept
FROM base LEFT JOIN reps USING (r)
"""
