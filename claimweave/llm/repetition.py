"""Quality rules: repetition found in suffix arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.tokens import release_encoders, steps
from claimweave.llm.words import covered, inside, span_hashes, sums, window_hashes, word_hashes, words

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: A repeat counts from this many words on; its limits are a share of the text and a length in words.
REPEAT_WORDS = 5
MAX_COVERED = 0.5
MAX_REPEAT = 200
#: Bytes of texts whose suffixes are sorted together.
SORT_BYTES = 1 << 20


def suffix_order(symbols: np.ndarray, owner: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of many texts at once, by prefix doubling, and the rank of every doubling step.

    ``symbols`` are word hashes (any order of words will do), ``owner`` the text of each word and
    ``end`` where that text ends.  A suffix ends with its text, and those of different
    texts never tie, so one sort serves all texts.  A step sorts only suffixes that still tie.
    """
    n = len(symbols)
    order = np.lexsort((symbols, owner))
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    rank = np.empty(n, np.int64)
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = begin
    ranks, step = [rank], 1
    while True:
        single = new & np.append(new[1:], True)
        tied = np.flatnonzero(~single)  # places in the order
        if not len(tied):
            return order, ranks
        at = order[tied]
        nxt = at + step
        second = np.where(nxt < end[at], rank[np.minimum(nxt, n - 1)] + 1, 0)
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[tied] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new = new.copy()
        new[tied] = fresh
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = rank.copy()
        rank[at] = begin[tied]
        ranks.append(rank)
        step *= 2


def neighbour_prefixes(order: np.ndarray, ranks: list[np.ndarray], least: int) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in the order; below ``least`` it may read 0."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    level = min(len(ranks) - 1, least.bit_length() - 1)
    same = np.flatnonzero(ranks[level][order[1:]] == ranks[level][order[:-1]]) + 1
    if not len(same):
        return lcp
    one, two = order[same - 1].copy(), order[same].copy()
    length = np.zeros(len(same), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        fits = (one < n) & (two < n)
        equal = fits.copy()
        equal[fits] = ranks[k][one[fits]] == ranks[k][two[fits]]
        one, two, length = one + (equal << k), two + (equal << k), length + (equal << k)
    lcp[same] = length
    return lcp


def repeats(symbols: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Length of the longest substring from every word on that occurs again in its text, 0 below ``least``.

    Neighbours in the suffix array bound the intervals of a common prefix; the deepest interval
    that holds a suffix is its longest repeated prefix.  One that can be extended to the left
    lies within the repeat of the word before, so the union of all spans is the union of
    the spans of the maximal repeats.
    """
    if not len(symbols):
        return np.zeros(0, np.int64)
    counts = np.diff(first)
    order, ranks = suffix_order(symbols, np.repeat(np.arange(len(counts)), counts), np.repeat(first[1:], counts))
    lcp = neighbour_prefixes(order, ranks, least)
    longest = np.zeros(len(symbols), np.int64)
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    longest[longest < least] = 0
    return longest


_COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "covered_words bigint, longest_repeat bigint"
)


def measure(texts: pa.Array, repeat_words: int) -> dict[str, np.ndarray]:
    """The counts of every text of a column."""
    batch = words(texts)
    raw, begin, first = batch.raw, batch.begin, batch.first
    hashes = word_hashes(batch)
    counts = np.diff(first)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return sums(flags, begin)

    solid = ~batch.space
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    breaks = np.union1d(np.flatnonzero(raw == 10), begin[1:] - 1)  # a text ends with the space put after it
    line_starts, line_ends = np.concatenate([[0], breaks[:-1] + 1]), breaks
    words_before = np.concatenate([[0], np.cumsum(solid)])
    real = words_before[line_ends] > words_before[line_starts]
    line_starts, line_ends = line_starts[real], line_ends[real]
    line_owner = np.searchsorted(begin, line_starts, side="right") - 1
    lines = span_hashes(raw, line_starts, line_ends)
    by = np.lexsort((lines, line_owner))
    again = np.zeros(len(by), bool)
    again[1:] = (lines[by][1:] == lines[by][:-1]) & (line_owner[by][1:] == line_owner[by][:-1])
    dup_lines = np.bincount(line_owner[by][again], minlength=len(counts))

    triples = np.flatnonzero(inside(batch, 3))
    owner = batch.owner()
    keys = window_hashes(hashes, 3)[triples]
    by = np.lexsort((keys, owner[triples]))
    same = (keys[by][1:] == keys[by][:-1]) & (owner[triples][by][1:] == owner[triples][by][:-1])
    twice = np.zeros(len(by) + 1, bool)
    twice[1:-1] = same
    marks = np.zeros(len(hashes), bool)
    marks[triples[by[twice[1:] | twice[:-1]]]] = True

    longest = repeats(hashes, first, repeat_words)
    top = np.zeros(len(counts), np.int64)
    np.maximum.at(top, owner, longest)
    return {
        "n_words": counts,
        "word_chars": per_text(solid & ((raw & 0xC0) != 0x80)),
        "n_symbols": per_text(symbol[raw]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": sums(covered(marks, 3), first),
        "covered_words": sums(covered(longest > 0, longest), first),
        "longest_repeat": top,
    }


def quality(
    docs: DataFrame,
    repeat_words: int = REPEAT_WORDS,
    max_covered: float = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the counts of its whole texts, ``base_failed`` and ``kept``.

    Base rules: fewer than 50 words, or over half of the words in three-word windows found twice.
    Method: of all substrings of at least ``repeat_words`` words that occur again in the text, the
    union of the spans may cover ``max_covered`` of the words and the longest may have
    ``max_repeat`` words.  Each text is judged alone, so there is no shuffle.  Null and empty
    texts have no words and fail; repeated rows are judged one by one; an empty table gives an
    empty table; columns of ``docs`` that bear a name of the result are replaced.
    """
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    taken = {*names, "base_failed", "kept"}
    others = [c for c in docs.columns if c not in taken or c == text_col]
    fields = [f for f in docs.select(*others).schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [_COLUMNS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in steps(batches, text_col, SORT_BYTES):
            found = measure(batch.column(text_col), repeat_words)
            columns = [batch.column(name) for name in others]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(found[name].astype(np.int64)) for name in names)], [*others, *names]
            )

    counted = docs.select(*others).mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    within = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)
