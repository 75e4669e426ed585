"""Hard negatives against all scores on small tables with ties, repeated rows and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import hard_negatives

SCHEMA = "vec_id bigint, label int, vector array<bigint>, tile int, block int, curve string, tie string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, "x", "y", 3) for row in rows], SCHEMA)


def plain(rows, is_anchor, positives=5, negatives=3, share=(50, 95)):
    """Scores as whole numbers; equal rows may stand for each other, so the result is compared as a multiset."""
    usable = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    last = lambda i: (1 << 63) - 1 if i is None else i
    out = []
    for k, (a_id, a_label, a) in enumerate(usable):
        if not is_anchor(a_id):
            continue
        others = [(dot(a, r[2]), r[0], r[1]) for j, r in enumerate(usable) if j != k]
        others.sort(key=lambda r: (-r[0], last(r[1])))
        for score, p_id, _ in [r for r in others if r[2] == a_label][:positives]:
            found = [r for r in others if r[2] != a_label and share[0] * score <= 100 * r[0] <= share[1] * score][:negatives]
            out += [(a_id, p_id, i + 1, r[1], score, r[0]) for i, r in enumerate(found)]
    return sorted(map(str, out))


def mined(spark, rows, **options):
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, **options).collect()
    return sorted(str(tuple(r)) for r in got)


def some_rows(seed, n, dims=6, spread=4):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-spread, spread + 1, (n, dims)) + rng.integers(0, 3, (n, 1)) * spread
    rows = [(i, int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(vectors)]
    rows += rows[:40]  # repeated rows
    rows += [(None, 1, rows[3][2]), (1000, None, [1] * dims), (1005, 0, None), (1010, 1, [1, None] + [0] * (dims - 2)), (1015, 2, [7, 7]), (1020, 1, [])]
    return rows


@pytest.mark.parametrize("block_rows, tile_rows", [(4, 20), (256, 1 << 19)])
def test_mined_rows_equal_all_scores(spark, block_rows, tile_rows):
    rows = some_rows(1, 260)
    want = plain(rows, lambda i: i is not None and i % 5 == 0)
    assert len(want) > 100
    assert mined(spark, rows, block_rows=block_rows, tile_rows=tile_rows) == want


def test_equal_vectors_and_large_numbers(spark):
    same = [(i, i % 4 if i % 3 else 0, [3, 1, 2]) for i in range(120)]
    turned = [(200 + i, 1, [2, 1, 2]) for i in range(20)]
    assert mined(spark, same + turned, block_rows=8, tile_rows=16) == plain(same + turned, lambda i: i % 5 == 0)
    large = [(i, i % 2, [(1 << 29) + i * 7919, i * i]) for i in range(60)]  # products need more than 53 bits
    assert mined(spark, large, block_rows=8, share=(10, 100)) == plain(large, lambda i: i % 5 == 0, share=(10, 100))


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, 1, [1, 2])]) == []
    assert mined(spark, [(5, 1, []), (6, 1, []), (7, 2, [])]) == plain([(5, 1, []), (6, 1, []), (7, 2, [])], lambda i: i == 5)


def test_zone_maps_skip_blocks_that_no_window_meets(spark):
    """Two far clusters: the bounds leave out the blocks of the other one."""
    rng = np.random.default_rng(4)
    far = lambda k: [int(x) for x in np.where(np.arange(8) // 4 == k, 100, 0) + rng.integers(-3, 4, 8)]
    rows = [(i, i % 3, far(i % 2)) for i in range(400)]
    part = frame(spark, rows).select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"), "vector", (F.col("vec_id") % 5 == 0).alias("anchor")
    )
    blocks, dims, n = hard_negatives.write_blocks(part, 8, 25)
    assert (dims, n) == (8, 400)
    assert blocks.filter("block >= 0").agg(F.sum("n")).first()[0] == 400
    found = hard_negatives._anchors(blocks, dims, 8, 5)
    zones = blocks.filter("block = -1")
    tiles = zones.count()
    routed = hard_negatives._route(
        found, zones, dims, 64, 2, lambda some, labels, span, lower, upper: upper >= np.array([v or 0 for v in some.column("least").to_pylist()])[:, None]
    )
    assert 0 < routed.count() < 0.75 * found.count() * tiles


def test_hilbert_neighbours_touch():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = hard_negatives.hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert len(set(keys)) == 512 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
