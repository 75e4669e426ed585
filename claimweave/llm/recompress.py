"""Removal of long repeats, found by recompression.

Every text is a sequence of words.  The first round names runs of one word, every later round names pairs: a
symbol falls on the left or the right side by its own name and the round, and a left symbol
followed by a right one becomes one new symbol.  A name is a hash of what it stands for, so all
tasks of a Spark job give equal substrings the same names without an exchange, and equal substrings get equal
symbols but for a few at their borders.

For every window of words the symbols that *any* occurrence of it must contain follow from the window
alone (``_Borders``).  The longest of them is its anchor.  Spark counts the anchors of all
documents; only windows whose anchor occurs elsewhere are verified, by counting 128-bit window hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.filters import KeyFilter
from claimweave.llm.tokens import release_encoders, steps
from claimweave.llm.words import Batch, covered, mix, rolling_hashes, word_hashes, words
from claimweave.session import materialize

WINDOW_WORDS = 35
PAIR_ROUNDS = 5
#: Bytes of texts that are parsed at once.
STEP_BYTES = 1 << 20
#: Words that one symbol may stand for.
SYMBOL_WORDS = 16
#: An anchor that occurs more often is hot: its windows are counted before they are joined.
HOT = 10_000

_U = np.uint64


class Parse:
    """Symbols of a batch after all rounds, and for every window its anchor (-1: none is certain, -2: no window)."""

    def __init__(self, batch: Batch, hashes: np.ndarray, window: int):
        n = len(hashes)
        counts = np.diff(batch.first)
        owner = np.repeat(np.arange(len(counts)), counts)
        last = np.repeat(batch.first[1:], counts)
        at = np.arange(n)
        self.valid = at + window <= last
        self.key = np.zeros(0, np.uint64)
        self.anchor = np.full(n, -2, np.int64)
        if not n:
            return
        # Runs of one word.
        head = np.ones(n, bool)
        head[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        run = np.cumsum(head) - 1
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, n))
        named = (size > 1) & (size <= SYMBOL_WORDS)
        keep = head | ~named[run]
        symbol = hashes[keep]
        length = np.where(named[run] & head, size[run], 1)[keep]
        text = owner[keep]
        index = np.cumsum(keep) - 1
        is_run = (named[run] & head)[keep]
        symbol = np.where(is_run, mix(symbol * _U(0xA24BAED4963EE407) + length.astype(np.uint64)), symbol)
        # The run at a border of a window may go on outside it: the certain part begins with the next run.
        first_of = index[begin]
        run_end = np.append(first_of, len(symbol))
        low = run_end[run + 1]
        high = run_end[run] - 1  # for a window that ends with word ``at``
        for turn in range(PAIR_ROUNDS):
            side = (mix(symbol ^ mix(np.full(1, turn + 101, np.uint64))) >> _U(63)).astype(bool)
            pair = np.zeros(len(symbol) + 1, bool)
            pair[:-2] = ~side[:-1] & side[1:] & (text[:-1] == text[1:]) & (length[:-1] + length[1:] <= SYMBOL_WORDS)
            lone = length < SYMBOL_WORDS
            # A right symbol may be taken from outside on the left, a left symbol from outside on the right.
            loose_low = np.append(side & lone, False)
            loose_high = np.append(~side & lone, False)
            second = np.append(False, pair[:-1])[: len(symbol)]
            index = np.append(np.cumsum(~second) - 1, (~second).sum())
            low = index[np.minimum(low + loose_low[np.minimum(low, len(symbol))], len(symbol))]
            high = high - loose_high[np.maximum(high, 0)] * (high >= 0)
            high = np.where(high >= 0, index[np.maximum(high, 0)], -1)
            firsts = np.flatnonzero(~second)
            paired = pair[:-1][firsts]
            partner = np.minimum(firsts + 1, len(symbol) - 1)
            fresh = mix(symbol[firsts] * _U(0x9FB21C651E98DF25) + mix(symbol[partner] + _U(turn + 1)))
            length = length[firsts] + np.where(paired, length[partner], 0)
            symbol, text = np.where(paired, fresh, symbol[firsts]), text[firsts]
        self.key = (length.astype(np.uint64) << _U(58)) | (symbol >> _U(6))
        starts = np.flatnonzero(self.valid)
        if not len(starts):
            return
        lo, hi = low[starts], high[starts + window - 1]
        some = lo <= hi
        best = np.full(len(starts), -1, np.int64)
        best[some] = _first_maximum(self.key, lo[some], hi[some])
        self.anchor[starts] = best


def _first_maximum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the first maximum of every range: two overlapping ranges of a power of two cover it."""
    tables = [np.arange(len(values))]
    width = (hi - lo + 1).astype(np.int64)
    level = np.frexp(width.astype(np.float64))[1] - 1
    for k in range(int(level.max(initial=0))):
        table = tables[-1]
        other = table[1 << k :]
        left = table[: len(other)]
        tables.append(np.where(values[left] >= values[other], left, other))
    out = np.empty(len(lo), np.int64)
    for k in np.unique(level):
        chosen = level == k
        left, right = tables[k][lo[chosen]], tables[k][hi[chosen] + 1 - (1 << int(k))]
        out[chosen] = np.where(values[left] >= values[right], left, right)
    return out


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def repeated_windows(rows: DataFrame, window: int = WINDOW_WORDS, hot: int = HOT) -> DataFrame:
    """``(_id, _hash, _places)``: the first words of the windows of a row that occur anywhere else.

    ``rows`` has ``_id``, ``_hash`` (both long; rows with equal values have equal texts) and ``text``.
    """
    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in steps(batches, limit=STEP_BYTES):
            found = words(batch.column("text"))
            parse = Parse(found, word_hashes(found), window)
            yield pa.RecordBatch.from_arrays([_longs(parse.key[np.unique(parse.anchor[parse.anchor >= 0])])], ["key"])

    counted = rows.select("text").mapInArrow(anchors, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(counted.filter("n > 1"), "shared-symbols")
    sizes = shared.agg(F.count(F.lit(1)), F.count_if(F.col("n") > hot)).first()
    is_shared = KeyFilter(shared, F.col("key"), sizes[0])
    is_often = KeyFilter(shared.filter(F.col("n") > hot), F.col("key"), sizes[1])

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in steps(batches, limit=STEP_BYTES):
            found = words(batch.column("text"))
            hashes = word_hashes(found)
            parse = Parse(found, hashes, window)
            keys = parse.key[np.maximum(parse.anchor, 0)] if len(parse.key) else np.zeros(len(hashes), np.uint64)
            sure = parse.anchor >= 0
            check = sure.copy()
            check[sure] = is_shared.holds(keys[sure])
            at = np.flatnonzero(check | (parse.anchor == -1))
            # Windows without a certain symbol lie in long runs of one word and may be any number.
            is_hot = (parse.anchor[at] == -1) | is_often.holds(keys[at])
            text = np.searchsorted(found.first, at, side="right") - 1
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_hash"))
            yield pa.RecordBatch.from_arrays(
                [
                    _longs(rolling_hashes(hashes, window, 1)[at]),
                    _longs(rolling_hashes(hashes, window, 2)[at]),
                    pa.array(ids[text]),
                    pa.array(marks[text]),
                    pa.array((at - found.first[text]).astype(np.int32)),
                    pa.array(is_hot),
                ],
                ["h1", "h2", "_id", "_hash", "place", "hot"],
            )

    found = rows.select("_id", "_hash", "text").mapInArrow(
        candidates, "h1 bigint, h2 bigint, _id bigint, _hash bigint, place int, hot boolean"
    )
    # A window of a cold anchor occurs at most as often as the anchor, so its rows may meet in one task.
    again = Window.partitionBy("h1", "h2")
    cold = found.filter("not hot").drop("hot").withColumn("n", F.count(F.lit(1)).over(again)).filter("n > 1")
    hot_windows = materialize(found.filter("hot").drop("hot"), "hot-windows")
    often = materialize(hot_windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "hot-counts")
    repeated = cold.drop("n").unionByName(hot_windows.join(often.drop("n"), ["h1", "h2"], "left_semi"))
    return repeated.groupBy("_id", "_hash").agg(F.collect_set("place").alias("_places"))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_words`` (the kept words, joined by one space).

    Removed is every word of a window of ``window`` words whose sequence of words also begins at any other place
    of any document, the same one included; all windows are judged on the input, so no occurrence
    survives.  Null and empty texts have no words; texts shorter than a window lose nothing; repeated
    rows are occurrences of their own; a null id is an id; an empty table gives an empty
    table; columns of ``docs`` that bear a name of the result are replaced.
    """
    names = ("n_words", "n_removed", "kept_words")
    others = [c for c in docs.columns if c not in names]
    keyed = docs.select(
        *others,
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"),
    )
    rows = keyed.select("_id", "_hash", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    places = materialize(repeated_windows(rows, window, hot), "repeated-windows")
    joined = keyed.join(places, ["_id", "_hash"], "left").drop("_id", "_hash")
    fields = docs.select(*others).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_words bigint, n_removed bigint, kept_words string"])

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in steps(batches, text_col, STEP_BYTES):
            found = words(batch.column(text_col))
            counts = np.diff(found.first)
            lists = batch.column("_places")
            marked = np.zeros(len(found.starts), bool)
            per = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            marked[flat + np.repeat(found.first[:-1], per)] = True
            gone = covered(marked, window)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[found.first[1:]] - total[found.first[:-1]]
            columns = [batch.column(name) for name in others]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), kept_texts(found, ~gone)],
                [*others, *names],
            )

    return joined.select(*others, "_places").mapInArrow(remove, schema)


def kept_texts(batch: Batch, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    owner = batch.owner()[keep]
    starts, ends = batch.starts[keep], batch.ends[keep]
    closing = np.ones(len(starts), bool)  # a word is followed by a space unless it is the last one
    closing[:-1] = owner[1:] != owner[:-1]
    stops = ends + ~closing
    change = np.zeros(len(batch.raw) + 1, np.int8)
    change[starts] += 1
    np.subtract.at(change, stops, 1)
    chosen = np.cumsum(change[:-1], dtype=np.int8) > 0
    raw = np.where(batch.space, np.uint8(32), batch.raw)[chosen]
    sizes = np.bincount(owner, weights=stops - starts, minlength=len(batch.first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(
        len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw.tobytes())
    ).cast(pa.string())
