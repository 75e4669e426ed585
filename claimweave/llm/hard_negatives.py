"""Hard negatives by score windows over Hilbert-ordered Parquet blocks with zone maps.

Candidates are sorted by label and by their place on a Hilbert curve, and stored in blocks of some hundred
rows with the least and greatest value of every dimension (a zone map); a file of blocks is a tile.
Interval arithmetic bounds an anchor's inner product with any row of a block or tile from both sides.  An anchor
travels only to the tiles, and multiplies only with the blocks, whose bounds can meet its windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import materialize

BLOCK_ROWS = 256
#: A tile is what one task holds; there are always enough of them to spread.
TILE_ROWS = 1 << 19
LEAST_TILES = 16
#: Anchors that one task holds next to a tile, and that are multiplied at once.
TASK_ANCHORS = 1 << 17
STEP_ANCHORS = 512
#: Tiles whose zone maps one task bounds together.
ZONE_TILES = 256
#: Bits per dimension of a Hilbert key, spread over two standard deviations on either side of the mean.
HILBERT_BITS = 3
SPREAD = 2.0

_LAST_ID = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Keys of rows of cell numbers (``bits`` each) along the Hilbert curve, by Skilling's transform of axes."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    if not n or not x.shape[1]:
        return [b""] * cells.shape[0]
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        below = q - np.uint64(1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    levels = [((x >> np.uint64(level)) & np.uint64(1)).astype(np.uint8).T for level in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(levels, axis=1), axis=1)
    return [row.tobytes() for row in packed]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a list column as rows, shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def _packed(values: np.ndarray) -> bytes:
    """One byte with the width, then the values as signed integers of the least of 2, 4 and 8 bytes."""
    most = max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def _unpacked(raw: bytes, dims: int | None = None) -> np.ndarray:
    values = np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)
    return values if dims is None else values.reshape(-1, dims) if dims else values.reshape(1, 0)


class Product(NamedTuple):
    """Inner products of integer vectors: in doubles while they are exact, else in whole numbers of any size."""

    exact: bool

    @classmethod
    def of(cls, dims: int, rows: int, *sizes: int) -> Product:
        a, b = sizes
        return cls(a * b * max(dims, 1) * max(rows, 1) < 1 << 51)

    def cast(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) if self.exact else x.astype(object)

    def scores(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not x.shape[1]:
            return np.zeros((len(x), len(y)), np.int64)
        product = x @ y.T
        return product.astype(np.int64) if self.exact else product

    def bounds(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of every row of ``x`` with any point of every zone."""
        up, down = np.maximum(x, 0), np.minimum(x, 0)
        return self.scores(up, low) + self.scores(down, high), self.scores(up, high) + self.scores(down, low)


def _magnitude(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _top(keys: np.ndarray, k: int) -> np.ndarray:
    if keys.shape[1] <= k:
        return keys
    return np.sort(keys, axis=1)[:, -k:] if keys.dtype == object else np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:]


# --- blocks -----------------------------------------------------------------------------------------------

_BLOCKS = (
    "tile int, block int, n int, label_min bigint, label_max bigint, zone_min binary, zone_max binary, "
    "ids binary, labels binary, vectors binary, anchors binary"
)
_BLOCK_TYPES = pa.schema(
    [("tile", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("label_min", pa.int64()), ("label_max", pa.int64())]
    + [(name, pa.binary()) for name in ("zone_min", "zone_max", "ids", "labels", "vectors", "anchors")]
)


def _statistics(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and mean and deviation of every dimension over all rows."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = int(np.diff(batch.column("vector").offsets.to_numpy()).max(initial=0))
            x = _matrix(batch.column("vector"), dims).astype(np.float64)
            columns = [np.arange(dims + 1), np.append(x.sum(0), len(x)), np.append((x * x).sum(0), len(x))]
            columns[0][-1] = -1
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dimension", "s", "ss"])

    partial = rows.select("vector").mapInArrow(sums, "dimension bigint, s double, ss double")
    # One row per dimension.
    found = {r.dimension: r for r in partial.groupBy("dimension").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()}
    n = int(found[-1].s) if -1 in found else 0
    dims = [found[i] for i in sorted(found) if i >= 0]
    mean = np.array([r.s / n for r in dims])
    deviation = np.sqrt(np.maximum([r.ss / n for r in dims] - mean * mean, 0)) if dims else mean
    return n, mean, np.maximum(deviation, 1e-9)


def write_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, int, int]:
    """Blocks of ``rows`` (``id``, ``label``, ``vector``, ``anchor``) with zone maps, the dimensions and the number of rows.

    Every tile also has one row without content (``block`` -1) with the zone map of the tile.
    """
    n, mean, deviation = _statistics(rows)
    dims = len(mean)
    cells = 1 << HILBERT_BITS

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dims)
            place = np.clip((x - mean + SPREAD * deviation) * (cells / (2 * SPREAD)) / deviation, 0, cells - 1)
            keys = hilbert_keys(place.astype(np.uint8), HILBERT_BITS)
            names = ["id", "label", "vector", "anchor", "tie"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(keys, pa.binary())], [*names, "curve"])

    def block(tile: int, number: int, batch: pa.Table) -> dict:
        x = _matrix(batch.column("vector"), dims)
        labels = np.asarray(batch.column("label").to_numpy(), np.int64)
        return {
            "tile": tile,
            "block": number,
            "n": len(labels),
            "label_min": int(labels.min()),
            "label_max": int(labels.max()),
            "zone_min": _packed(x.min(0)),
            "zone_max": _packed(x.max(0)),
            "ids": np.asarray(batch.column("id").to_numpy(), "<i8").tobytes(),
            "labels": labels.astype("<i8").tobytes(),
            "vectors": _packed(x),
            "anchors": np.asarray(batch.column("anchor").to_numpy(zero_copy_only=False), bool).tobytes(),
        }

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        tile, number, zone, waiting, held = context.partitionId() if context else 0, 0, None, [], 0

        def emit(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number, zone
            made = block(tile, number, rows)
            number += 1
            low, high = _unpacked(made["zone_min"]), _unpacked(made["zone_max"])
            if zone is None:
                zone = [low, high, made["label_min"], made["label_max"], 0]
            zone = [np.minimum(zone[0], low), np.maximum(zone[1], high), min(zone[2], made["label_min"]), max(zone[3], made["label_max"]), zone[4] + made["n"]]
            return pa.RecordBatch.from_pylist([made], _BLOCK_TYPES)

        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            if held >= block_rows:
                table = pa.Table.from_batches(waiting)
                whole = held - held % block_rows
                for at in range(0, whole, block_rows):
                    yield emit(table.slice(at, block_rows))
                waiting, held = table.slice(whole).to_batches(), held - whole
        if held:
            yield emit(pa.Table.from_batches(waiting))
        if zone is not None:
            row = dict.fromkeys(_BLOCK_TYPES.names) | {"tile": tile, "block": -1, "n": zone[4], "label_min": zone[2], "label_max": zone[3]}
            yield pa.RecordBatch.from_pylist([row | {"zone_min": _packed(zone[0]), "zone_max": _packed(zone[1])}], _BLOCK_TYPES)

    schema = "id bigint, label bigint, vector array<bigint>, anchor boolean, tie bigint, curve binary"
    # The tie splits any number of equal rows between tiles.
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).mapInArrow(keyed, schema)
    order = ["label", "curve", "id", "tie"]
    tiles = max(LEAST_TILES, -(-n // tile_rows))
    blocks = ordered.repartitionByRange(tiles, *order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCKS)
    return materialize(blocks, "vector-blocks"), dims, n


# --- anchors ----------------------------------------------------------------------------------------------

_ANCHORS = "a_tile int, a_row int, anchor_id bigint, a_label bigint, vector binary, least bigint"


def _anchors(blocks: DataFrame, dims: int, block_rows: int, positives: int) -> DataFrame:
    """Anchors with ``least``: a score that ``positives`` others of the label in the anchor's own block reach (null: unknown)."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                if not len(at):
                    continue
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                x = _unpacked(row["vectors"], dims)
                if not dims:
                    x = np.zeros((row["n"], 0), np.int64)
                product = Product.of(dims, 1, _magnitude(x), _magnitude(x))
                scores = product.scores(product.cast(x[at]), product.cast(x))
                scores = scores if product.exact else scores.astype(object)
                least = []
                for k, a in enumerate(at.tolist()):
                    others = labels == labels[a]
                    others[a] = False
                    found = np.sort(scores[k][others])
                    least.append(_bounded(found[-positives]) if len(found) >= positives else None)
                columns = [
                    pa.array(np.full(len(at), row["tile"], np.int32)),
                    pa.array((row["block"] * block_rows + at).astype(np.int32)),
                    pa.array(ids[at]),
                    pa.array(labels[at]),
                    pa.array([_packed(x[a]) for a in at], pa.binary()),
                    pa.array(least, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["a_tile", "a_row", "anchor_id", "a_label", "vector", "least"])

    return blocks.filter("block >= 0").drop("zone_min", "zone_max").mapInArrow(find, _ANCHORS)


def _bounded(score: int) -> int:
    """A score as a 64-bit integer; greater ones become the greatest."""
    return int(min(max(int(score), -(1 << 62)), 1 << 62))


class Windows(NamedTuple):
    """Score windows of a batch of anchors: ``low`` and ``high`` are one column per window; empty where low > high."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, share: tuple[int, int], many: int) -> Windows:
        low, high = np.ones((table.num_rows, many), object), np.zeros((table.num_rows, many), object)
        for k, scores in enumerate(table.column("p_score").to_pylist()):
            for j, s in enumerate(scores):
                low[k, j], high[k, j] = -((-share[0] * s) // 100), (share[1] * s) // 100
        return cls(low, high)


def _vectors(table: pa.Table, dims: int) -> np.ndarray:
    rows = table.column("vector").to_pylist()
    return np.stack([_unpacked(r) for r in rows]) if rows else np.zeros((0, dims), np.int64)


def _route(requests: DataFrame, zones: DataFrame, dims: int, tiles: int, groups: int, meets: Callable) -> DataFrame:
    """Requests once for every tile whose zone map their scores can meet.

    Zone maps are bounded ``ZONE_TILES`` at a time against groups of requests, so neither side is held whole anywhere.
    """
    parts = -(-tiles // ZONE_TILES)
    columns = requests.columns

    def bound(key: tuple, asked: pa.Table, zone: pa.Table) -> pa.Table:
        keep = []
        targets = np.asarray(zone.column("tile").to_numpy(), np.int64)
        if zone.num_rows and asked.num_rows:
            low = np.stack([_unpacked(r) for r in zone.column("zone_min").to_pylist()])
            high = np.stack([_unpacked(r) for r in zone.column("zone_max").to_pylist()])
            span = [np.asarray(zone.column(c).to_numpy(), np.int64) for c in ("label_min", "label_max")]
            for at in range(0, asked.num_rows, STEP_ANCHORS):
                some = asked.slice(at, STEP_ANCHORS)
                x = _vectors(some, dims)
                product = Product.of(dims, 1, _magnitude(x), max(_magnitude(low), _magnitude(high)))
                lower, upper = product.bounds(product.cast(x), product.cast(low), product.cast(high))
                labels = np.asarray(some.column("a_label").to_numpy(), np.int64)[:, None]
                row, tile = np.nonzero(meets(some, labels, span, lower, upper))
                keep.append(some.take(pa.array(row)).append_column("tile", pa.array(targets[tile].astype(np.int32))))
        if not keep:
            return asked.slice(0, 0).append_column("tile", pa.array([], pa.int32())).select([*columns, "tile"])
        return pa.concat_tables(keep).select([*columns, "tile"])

    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    group = F.pmod(F.xxhash64("a_tile", "a_row"), F.lit(groups)).cast("int")
    asked = requests.withColumn("group", group).select("*", every)
    part = F.floor(F.col("tile") / ZONE_TILES).cast("int").alias("part")
    zone = zones.select(part, "tile", "label_min", "label_max", "zone_min", "zone_max")
    zone = zone.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema) + ", tile int"
    return asked.groupBy("part", "group").cogroup(zone.groupBy("part", "group")).applyInArrow(bound, schema)


# --- search -----------------------------------------------------------------------------------------------


class _Tile:
    """Blocks of a tile as matrices.  A row's key orders it by score, then by smaller id, then by place."""

    def __init__(self, table: pa.Table, dims: int, block_rows: int, most: int):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        shape = lambda r, x: x if dims else np.zeros((r["n"], 0), np.int64)
        self.vectors = [shape(r, _unpacked(r["vectors"], dims)) for r in rows]
        self.labels = [np.frombuffer(r["labels"], "<i8") for r in rows]
        self.ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
        self.base = np.concatenate([[0], np.cumsum([r["n"] for r in rows])])
        self.place = np.concatenate([r["block"] * block_rows + np.arange(r["n"]) for r in rows])
        self.low = np.stack([_unpacked(r["zone_min"]) for r in rows])
        self.high = np.stack([_unpacked(r["zone_max"]) for r in rows])
        self.span = [np.array([r[c] for r in rows]) for c in ("label_min", "label_max")]
        self.rows = len(self.ids)
        self.order = np.lexsort((self.place, self.ids))
        self.later = np.empty(self.rows, np.int64)
        self.later[self.order] = self.rows - 1 - np.arange(self.rows)
        self.product = Product.of(dims, self.rows, most, max(_magnitude(self.low), _magnitude(self.high)))
        self.none = -(1 << 63) if self.product.exact else -(1 << 200)
        self.low, self.high = self.product.cast(self.low), self.product.cast(self.high)

    def keys(self, x: np.ndarray, block: int) -> np.ndarray:
        a, b = self.base[block], self.base[block + 1]
        scores = self.product.scores(x, self.product.cast(self.vectors[block]))
        scores = scores if self.product.exact else scores.astype(object)
        return scores * self.rows + self.later[a:b]

    def empty(self, *shape: int) -> np.ndarray:
        return np.full(shape, self.none, np.int64 if self.product.exact else object)

    def scores(self, keys: np.ndarray) -> np.ndarray:
        return keys // self.rows

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and places of rows by their keys."""
        at = self.order[self.rows - 1 - (keys % self.rows).astype(np.int64)]
        return self.ids[at], self.place[at]


def _cross(requests: DataFrame, blocks: DataFrame, groups: int, work: Callable, schema: str) -> DataFrame:
    """Every group of requests of a tile next to the blocks of the tile."""
    group = F.pmod(F.xxhash64("a_tile", "a_row"), F.lit(groups)).cast("int")
    needed = blocks.filter("block >= 0").drop("anchors")
    copies = needed.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = requests.withColumn("group", group)
    return asked.groupBy("tile", "group").cogroup(copies.groupBy("tile", "group")).applyInArrow(work, schema)


def _positives(routed: DataFrame, blocks: DataFrame, dims: int, block_rows: int, groups: int, many: int) -> DataFrame:
    schema = "a_tile int, a_row int, p_score bigint, p_id bigint, p_tile int, p_place int"
    types = pa.schema([("a_tile", pa.int32()), ("a_row", pa.int32()), ("p_score", pa.int64()), ("p_id", pa.int64()), ("p_tile", pa.int32()), ("p_place", pa.int32())])

    def search(key: tuple, asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows or not stored.num_rows:
            return types.empty_table()
        number = int(key[0].as_py() if hasattr(key[0], "as_py") else key[0])
        everything = _vectors(asked, dims)
        tile = _Tile(stored, dims, block_rows, _magnitude(everything))
        out = []
        for at in range(0, asked.num_rows, STEP_ANCHORS):
            some = asked.slice(at, STEP_ANCHORS)
            x = tile.product.cast(everything[at : at + STEP_ANCHORS])
            label = np.asarray(some.column("a_label").to_numpy(), np.int64)
            own = np.asarray(some.column("a_tile").to_numpy()) == number
            row = np.asarray(some.column("a_row").to_numpy(), np.int64)
            least = np.array([tile.none // tile.rows if v is None else v for v in some.column("least").to_pylist()], object)
            least = least.astype(np.int64) if tile.product.exact else least
            _, upper = tile.product.bounds(x, tile.low, tile.high)
            best = tile.empty(len(x), many)
            for b in np.argsort(-upper.max(0).astype(np.float64), kind="stable").tolist():
                enough = np.maximum(least, tile.scores(best.min(1)))
                live = np.flatnonzero((tile.span[0][b] <= label) & (label <= tile.span[1][b]) & (upper[:, b] >= enough))
                if not len(live):
                    continue
                keys = tile.keys(x[live], b)
                keys[label[live][:, None] != tile.labels[b][None, :]] = tile.none
                place = tile.place[tile.base[b] : tile.base[b + 1]]
                keys[own[live][:, None] & (row[live][:, None] == place[None, :])] = tile.none
                best[live] = _top(np.concatenate([best[live], keys], axis=1), many)
            k, j = np.nonzero(best != tile.none)
            chosen = best[k, j]
            ids, places = tile.found(chosen)
            scores = [_bounded(s) for s in tile.scores(chosen).tolist()]
            columns = [some.column("a_tile").to_numpy()[k], row[k].astype(np.int32), scores, ids, np.full(len(k), number, np.int32), places.astype(np.int32)]
            out.append(pa.table(dict(zip(types.names, map(pa.array, columns), strict=True))).cast(types))
        return pa.concat_tables(out)

    return _cross(routed, blocks, groups, search, schema)


def _negatives(routed: DataFrame, blocks: DataFrame, dims: int, block_rows: int, groups: int, many: int, most: int, share: tuple[int, int]) -> DataFrame:
    """The best ``many`` rows of each tile for each of up to ``most`` windows of an anchor."""
    names = ["a_tile", "a_row", "anchor_id", "positive", "positive_id", "positive_score", "negative_score", "negative_id", "n_tile", "n_place"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    types = pa.schema(list(zip(names, kinds, strict=True)))
    schema = ", ".join(f"{n} {'int' if k == pa.int32() else 'bigint'}" for n, k in zip(names, kinds, strict=True))

    def search(key: tuple, asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows or not stored.num_rows:
            return types.empty_table()
        number = int(key[0].as_py() if hasattr(key[0], "as_py") else key[0])
        everything = _vectors(asked, dims)
        tile = _Tile(stored, dims, block_rows, _magnitude(everything))
        out = []
        for at in range(0, asked.num_rows, STEP_ANCHORS):
            some = asked.slice(at, STEP_ANCHORS)
            x = tile.product.cast(everything[at : at + STEP_ANCHORS])
            label = np.asarray(some.column("a_label").to_numpy(), np.int64)
            low, high = Windows.of(some, share, most)
            if tile.product.exact:  # no score of this tile lies beyond
                low, high = (np.clip(w.astype(np.float64), -(2.0**52), 2.0**52).astype(np.int64) for w in (low, high))
            first, end = low * tile.rows, (high + 1) * tile.rows
            lower, upper = tile.product.bounds(x, tile.low, tile.high)
            best = tile.empty(len(x), most, many)
            for b in np.argsort(-upper.max(0).astype(np.float64), kind="stable").tolist():
                least = np.maximum(low, tile.scores(best.min(2)))
                open_ = (low <= high) & (upper[:, b, None] >= least) & (lower[:, b, None] <= high)
                alone = (tile.span[0][b] == label) & (tile.span[1][b] == label)
                live = np.flatnonzero(open_.any(1) & ~alone)
                if not len(live):
                    continue
                keys = tile.keys(x[live], b)
                keys[label[live][:, None] == tile.labels[b][None, :]] = tile.none
                for j in range(most):
                    want = open_[live, j]
                    if not want.any():
                        continue
                    rows, mine = live[want], keys[want]
                    window = (mine >= np.maximum(first[rows, j], best[rows, j].min(1))[:, None]) & (mine < end[rows, j][:, None])
                    hit = window.any(1)
                    if hit.any():
                        rows = rows[hit]
                        inside = np.where(window[hit], mine[hit], tile.none)
                        best[rows, j] = _top(np.concatenate([best[rows, j], inside], axis=1), many)
            k, j, i = np.nonzero(best != tile.none)
            chosen = best[k, j, i]
            ids, places = tile.found(chosen)
            p_id, p_score = some.column("p_id").to_pylist(), some.column("p_score").to_pylist()
            pairs = list(zip(k.tolist(), j.tolist(), strict=True))
            columns = [
                some.column("a_tile").to_numpy()[k],
                some.column("a_row").to_numpy()[k],
                some.column("anchor_id").to_numpy()[k],
                (j + 1).astype(np.int32),
                [p_id[a][b] for a, b in pairs],
                [p_score[a][b] for a, b in pairs],
                [_bounded(s) for s in tile.scores(chosen).tolist()],
                ids,
                np.full(len(k), number, np.int32),
                places.astype(np.int32),
            ]
            out.append(pa.table(dict(zip(names, (pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), strict=True))))
        return pa.concat_tables(out)

    return _cross(routed, blocks, groups, search, schema)


def mine(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "vector",
    positives: int = 5,
    negatives: int = 3,
    share: tuple[int, int] = (50, 95),
    block_rows: int = BLOCK_ROWS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: hard negatives of all anchors.

    ``vector`` is an array of whole numbers, a score an inner product.  An anchor (``anchors`` is true) takes as positives
    its first ``positives`` other rows of its label, and for each the first ``negatives`` rows of other labels
    with a score of ``share`` percent of the positive's, from and to.  Higher scores come first, then smaller ids, then places in the blocks.

    Rows with a null label, a null vector or a null component take no part; a null id comes last in ties.
    Repeated rows are rows of their own: each can be anchor, positive and negative.  Vectors of other lengths are
    filled up with zeros; scores beyond 2^62 become 2^62; other columns are ignored; an empty table, an anchor without positives and
    a window without rows give no rows.
    """
    part = rows.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID)).alias("id"),
        F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<bigint>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    blocks, dims, n = write_blocks(part, block_rows, tile_rows)
    zones = blocks.filter("block = -1")
    tiles = max(LEAST_TILES, -(-n // tile_rows), (zones.agg(F.max("tile")).first()[0] or 0) + 1)
    found = materialize(_anchors(blocks, dims, block_rows, positives), "anchors")
    groups = max(1, -(-found.count() // TASK_ANCHORS))

    def may_be_positive(some: pa.Table, labels: np.ndarray, span: list, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        least = np.array([-(1 << 63) if v is None else v for v in some.column("least").to_pylist()], np.int64)
        return (span[0][None, :] <= labels) & (labels <= span[1][None, :]) & (upper >= least[:, None])

    routed = _route(found, zones, dims, tiles, groups, may_be_positive)
    near = _positives(routed, blocks, dims, block_rows, groups, positives)
    best = Window.partitionBy("a_tile", "a_row").orderBy(F.desc("p_score"), "p_id", "p_tile", "p_place")
    first = near.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= positives)
    chosen = first.groupBy("a_tile", "a_row").agg(F.array_sort(F.collect_list(F.struct("at", "p_id", "p_score"))).alias("p"))
    asked = found.drop("least").join(chosen, ["a_tile", "a_row"])
    asked = materialize(asked.select("*", F.col("p.p_id").alias("p_id"), F.col("p.p_score").alias("p_score")).drop("p"), "positives")

    def may_be_negative(some: pa.Table, labels: np.ndarray, span: list, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        low, high = Windows.of(some, share, positives)
        meets = ((low <= high)[:, None, :] & (upper[:, :, None] >= low[:, None, :]) & (lower[:, :, None] <= high[:, None, :])).any(2)
        return meets & ~((span[0][None, :] == labels) & (span[1][None, :] == labels))

    routed = _route(asked, zones, dims, tiles, groups, may_be_negative)
    hard = _negatives(routed, blocks, dims, block_rows, groups, negatives, positives, share)
    order = Window.partitionBy("a_tile", "a_row", "positive").orderBy(F.desc("negative_score"), "negative_id", "n_tile", "n_place")
    ranked = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = {c: F.when(F.col(c) != _LAST_ID, F.col(c)).alias(c) for c in ("anchor_id", "positive_id", "negative_id")}
    return ranked.select(names["anchor_id"], names["positive_id"], "rank", names["negative_id"], "positive_score", "negative_score")
