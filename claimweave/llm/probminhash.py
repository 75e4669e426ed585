"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding and verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.components import components
from claimweave.llm.filters import KeyFilter
from claimweave.llm.tokens import release_encoders, steps
from claimweave.llm.words import inside, mix, rolling_hashes, word_hashes, words
from claimweave.session import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 misses all 30 bands of 5 registers with probability 7e-6.  Both measures, the probability
#: Jaccard and the Jaccard of the sets, have registers, bands and a sketch of their own.
BANDS = 30
ROWS = 5
#: Of its 150 registers such a pair shares fewer than this part (five deviations less) with probability below 1e-6.
SKETCH_LEAST = 0.635
#: Candidates per bucket that are compared with the whole bucket in the first round, and growth per round.
FIRST_HUBS = 64
HUB_GROWTH = 64
#: Members of a bucket that are compared with its hubs at once, and hubs that they are compared with at once.
SALT_MEMBERS = 2_000
PART_HUBS = 512
#: Shingles that are looked up in those of a hub at once.
LOOK_UP = 1 << 18
#: Bytes of texts that are sketched together.
SKETCH_BYTES = 1 << 20

_U = np.uint64


def weighted_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, shingle, weight, sequence)``: distinct shingles of every text with weight ``1 + ln(count)``.

    A text of fewer than ``size`` words is one shingle; one without words has none.  ``sequence`` is a
    pair of hashes of all words of every text (zeros: no words).
    """
    batch = words(texts)
    hashes = word_hashes(batch)
    counts = np.diff(batch.first)
    place = np.arange(len(hashes)) - np.repeat(batch.first[:-1], counts)
    whole = np.zeros((2, len(counts)), np.uint64)
    owner = batch.owner()
    for k in (0, 1):
        np.add.at(whole[k], owner, mix(hashes + mix(place.astype(np.uint64) + _U(977 * (k + 1)))))
        whole[k] = np.where(counts > 0, mix(whole[k] + counts.astype(np.uint64)), _U(0))
    full = inside(batch, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    owner = np.concatenate([owner[full], short])
    shingle = np.concatenate([rolling_hashes(hashes, size, 5)[full], whole[0][short]])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    weight = 1.0 + np.log(np.diff(np.append(at, len(order))))
    return owner[at], shingle[at], weight, whole


def sketches(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures: ``texts x registers`` shingles.

    Every shingle is a Poisson process of a rate of its weight whose points arrive at random
    registers; a register keeps the shingle of its earliest point.  Registers of two texts agree with the
    probability Jaccard similarity of their weights.  The points of all shingles are drawn turn
    by turn, and a shingle ends as soon as its last point is later than every register of its text.
    """
    earliest = np.full(texts * registers, np.inf)
    kept = np.zeros(texts * registers, np.uint64)
    arrival = np.zeros(len(owner))
    active = np.arange(len(owner))
    turn = 0
    while len(active):
        turn += 1
        draw = mix(shingle[active] + mix(np.full(1, turn, np.uint64)))
        uniform = ((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        arrival[active] -= np.log(uniform) / weight[active]
        slot = owner[active] * registers + (mix(draw) % _U(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, arrival[active])
        won = earliest[slot] == arrival[active]
        kept[slot[won]] = shingle[active[won]]
        latest = earliest.reshape(texts, registers).max(axis=1)
        active = active[arrival[active] < latest[owner[active]]]
    return kept.reshape(texts, registers)


def both_signatures(
    owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures by the weights and by weights of 1 (registers of these agree with the Jaccard of the sets).

    Texts without a repeated shingle have one signature for both.
    """
    weighted = sketches(owner, shingle, weight, texts, registers)
    repeats = np.zeros(texts, bool)
    repeats[owner[weight > 1.0]] = True
    plain = weighted.copy()
    if repeats.any():
        mine, number = repeats[owner], np.cumsum(repeats) - 1
        plain[repeats] = sketches(number[owner[mine]], shingle[mine], np.ones(int(mine.sum())), int(repeats.sum()), registers)
    return weighted, plain


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard of the weights and Jaccard of the sets; shingles are sorted and distinct."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = len(ia)
    plain = common / (len(a) + len(b) - common)
    if not common:
        return 0.0, 0.0
    # sum over j of max(a_j / a_i, b_j / b_i): those with a larger quotient a / b count by a, the others by b.
    quotient = wa[ia] / wb[ib]
    order = np.argsort(quotient)
    x, y = wa[ia][order], wb[ib][order]
    quotient = quotient[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    below = np.searchsorted(quotient, quotient, side="left")
    sum_a = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[below] + only_a
    sum_b = np.concatenate([[0.0], np.cumsum(y)])[below] + only_b
    return float((1.0 / (sum_a / x + sum_b / y)).sum()), plain


class Sets:
    """Weighted shingles of several texts, compared with those of one text at once."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sets = sets
        self.sizes = np.array([len(shingles) for shingles, _ in sets], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.shingles = np.concatenate([shingles for shingles, _ in sets])
        self.weights = np.concatenate([weights for _, weights in sets])
        self.totals = np.array([weights.sum() for _, weights in sets])

    def alike(self, shingles: np.ndarray, weights: np.ndarray, rows: np.ndarray, least: float) -> np.ndarray:
        """Whether the larger ``similarity`` of each of these rows to the text is ``least`` or more."""
        found = np.zeros(len(rows), bool)
        total = weights.sum()
        cuts = np.flatnonzero(np.diff(np.cumsum(self.sizes[rows]) // LOOK_UP)) + 1
        for part in np.split(np.arange(len(rows)), cuts):
            chosen = rows[part]
            sizes = self.sizes[chosen]
            owner = np.repeat(np.arange(len(chosen)), sizes)
            at = np.arange(len(owner)) + np.repeat(self.first[chosen] - np.cumsum(sizes) + sizes, sizes)
            place = np.minimum(np.searchsorted(shingles, self.shingles[at]), len(shingles) - 1)
            hit = shingles[place] == self.shingles[at]
            owner, at, place = owner[hit], at[hit], place[hit]
            common = np.bincount(owner, minlength=len(chosen))
            alike = common / (len(shingles) + sizes - common) >= least
            # The probability Jaccard is at most the sum of the smaller shares of the weights; without repeats it is the other one.
            shares = np.minimum(weights[place] / total, self.weights[at] / self.totals[chosen][owner])
            most = np.bincount(owner, shares, minlength=len(chosen))
            repeats = (total > len(shingles)) | (self.totals[chosen] > sizes)
            for i in np.flatnonzero(~alike & repeats & (most >= least - 1e-6)):
                alike[i] = max(similarity(shingles, weights, *self.sets[chosen[i]])) >= least
            found[part] = alike
        return found


def _sketch_rows(size: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in steps(batches, limit=SKETCH_BYTES):
            owner, shingle, weight, whole = weighted_shingles(batch.column("text"), size)
            signatures = both_signatures(owner, shingle, weight, batch.num_rows, bands * rows)
            key = np.zeros((batch.num_rows, 2 * bands), np.uint64)
            for at, signature in zip((0, bands), signatures, strict=True):
                for band in range(bands):
                    for row in range(rows):
                        key[:, at + band] = mix(
                            key[:, at + band] * _U(0xD6E8FEB86659FD93) + signature[:, band * rows + row] + _U(band)
                        )
            some = whole[0] != 0
            flat = key[some].ravel().view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(some, 2 * bands, 0))]).astype(np.int32)
            small = np.ascontiguousarray((np.hstack(signatures) & _U(0xFF)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("t1"),
                    batch.column("t2"),
                    pa.array(whole[0].view(np.int64)),
                    pa.array(whole[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array([row.tobytes() for row in small], pa.binary()),
                ],
                ["doc_id", "t1", "t2", "k1", "k2", "bands", "sketch"],
            )

    return run


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE_WORDS,
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, class_id, class_size, class_key, t1, t2)``: one row per row of ``docs``.

    Texts of equal words are one node, named by a row of the stored sketches.  Nodes whose ProbMinHash signatures, by the weights or by weights of 1, agree in
    a band are candidates; two candidates are linked if their probability Jaccard or the Jaccard of their sets is
    ``least`` or more, found from all their shingles.  Classes are the connected components; ``class_id`` is their smallest id,
    ``class_key`` a number of their own, and ``t1``, ``t2`` are 128 bits of the text of the row (``text_keys``).

    No bucket is expanded into all pairs.  In every round a few *hubs* of each bucket, those of its smallest
    classes first, are compared with all members of other classes that were not hubs yet; members
    that turn out to be of one class need no more comparison.  Rounds go on, with more hubs each time,
    until no bucket holds two members of different classes that were not compared: no link between
    classes is lost, and no bucket is capped.  A comparison first looks at 8 bits of each register, then at
    all shingles, within the task that holds a part of the bucket; only links leave it.

    Null and empty texts have no words and stand alone; texts of fewer than ``size`` words match equal word
    sequences only; repeated rows fall into one class; rows without an id are compared like all others, and so are
    different texts under one id; a class without any id has a negative ``class_id``; an empty table gives an empty table.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id bigint, t1 bigint, t2 bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch binary"
    sketched = texts.select("doc_id", *text_keys(F.col("text")), "text").mapInArrow(_sketch_rows(size, bands, rows), schema)
    sketched = materialize(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")
    spoken, count = F.size("bands") > 0, sketched.count()
    nodes = materialize(sketched.filter(spoken).groupBy("k1", "k2").agg(F.min("row").alias("node")), "nodes", count)
    placed = sketched.filter(spoken).join(nodes, ["k1", "k2"])
    # One row per node, stored: three later steps read its bands.
    first = placed.filter(F.col("row") == F.col("node")).select("node", "doc_id", "k1", "k2", "bands", "sketch")
    first = materialize(first, "first", count)
    buckets = first.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    # Buckets of equal members are one bucket.
    half = F.lit(0xFFFFFFFF)
    content = [
        F.count(F.lit(1)).alias("n"),
        F.min("node").alias("a"),
        F.max("node").alias("b"),
        F.sum(F.xxhash64("node").bitwiseAND(half)).alias("c"),
        F.sum(F.xxhash64(F.lit(1), "node").bitwiseAND(half)).alias("d"),
    ]
    several = buckets.groupBy("bucket").agg(*content).filter("a <> b")
    full = materialize(several.groupBy("n", "a", "b", "c", "d").agg(F.min("bucket").alias("bucket")).select("bucket"), "full-buckets", 2 * bands * count)
    members = materialize(buckets.join(full, "bucket", "left_semi"), "members")

    wanted = first.select("node", "doc_id").join(members.select("node").distinct(), "node")
    wanted = materialize(wanted.select(F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id")), "candidates")
    is_wanted = KeyFilter(wanted, F.col("id"), wanted.count())

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for whole_batch in batches:
            mask = pa.array(is_wanted.holds(whole_batch.column("doc_id").fill_null(0).to_numpy().view(np.uint64)))
            for batch in steps([whole_batch.filter(mask)], limit=SKETCH_BYTES):
                owner, shingle, weight, whole = weighted_shingles(batch.column("text"), size)
                short = (shingle >> _U(32)).astype("<u4")  # still sorted; equal ones within a text are one
                first_of = np.ones(len(short), bool)
                first_of[1:] = (short[1:] != short[:-1]) | (owner[1:] != owner[:-1])
                owner, short, weight = owner[first_of], short[first_of], weight[first_of].astype("<f2")
                cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                packed = [short[a:b].tobytes() + weight[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                keys = [pa.array(k.view(np.int64)) for k in whole]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(packed, pa.binary())], ["k1", "k2", "shingles"])

    # The filter, by the id of one row of each node, lets a few others through; the joins by words drop them.
    stored = texts.mapInArrow(sets, "k1 bigint, k2 bigint, shingles binary").dropDuplicates(["k1", "k2"])
    # Which buckets a node is in, by band; a pair is compared in the first that both are in, and there only.
    own_buckets = members.groupBy("node").agg(F.collect_set("bucket").alias("_in"))
    elsewhere = F.transform(
        "bands", lambda key: F.when(F.array_contains("_in", key), key).otherwise(F.xxhash64(F.col("node"), key))
    )
    small = first.join(own_buckets, "node").select("node", "k1", "k2", "sketch", elsewhere.alias("buckets"))
    stored = materialize(small.join(stored, ["k1", "k2"]).drop("k1", "k2"), "compared-nodes")
    classes = _classes(members, stored, least, bands * rows)
    named = placed.select("doc_id", "t1", "t2", "node")
    if classes is None:
        named = named.withColumnRenamed("node", "class_key")
    else:
        named = named.join(classes, "node", "left").select("doc_id", "t1", "t2", F.coalesce("label", "node").alias("class_key"))
    named = materialize(named, "named", count)
    unnamed = -1 - F.col("class_key")
    grouped = named.groupBy("class_key").agg(F.count(F.lit(1)).alias("class_size"), F.min("doc_id").alias("least"))
    grouped = materialize(grouped.select("class_key", F.coalesce("least", unnamed).alias("class_id"), "class_size"), "class-sizes", count)
    silent = sketched.filter(~spoken).withColumnRenamed("row", "class_key")
    silent = silent.withColumn("class_id", F.coalesce("doc_id", unnamed)).withColumn("class_size", F.lit(1).cast("bigint"))
    columns = ["doc_id", "class_id", "class_size", "class_key", "t1", "t2"]
    return named.join(grouped, "class_key").select(*columns).unionByName(silent.select(*columns))


def text_keys(text: Column) -> list[Column]:
    """128 bits of a text as two columns."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def _classes(members: DataFrame, stored: DataFrame, least: float, registers: int) -> DataFrame | None:
    """``(node, label)`` of the candidates that are linked, None without any (see ``near_duplicates``)."""

    def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        size = len(packed) // 6
        return np.frombuffer(packed, "<u4", size), np.frombuffer(packed, "<f2", size, 4 * size).astype(float)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within buckets; rows come sorted by bucket, salt, kind and node.

        Kinds: 0 a hub, 1 a hub that is a member here as well, 2 a member that is a hub elsewhere, 3 any other member.
        Sketches are compared first, then all shingles.  Classes that a link of this group has joined are one from
        then on and need no other link.
        """
        group: tuple | None = None
        hubs: list[tuple] = []
        into: dict[int, int] = {}

        def find(label: int) -> int:
            while label in into:
                label = into[label]
            return label

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            change = np.flatnonzero(np.append(True, (keys[:2, 1:] != keys[:2, :-1]).any(axis=0)))
            nodes, labels = batch.column("node").to_numpy(), batch.column("label").to_numpy()
            sketches_here, sets_here = batch.column("sketch").to_pylist(), batch.column("shingles").to_pylist()
            lists = batch.column("buckets")
            table = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found: list[tuple[int, int]] = []
            for begin, end in zip(change, [*change[1:], batch.num_rows], strict=True):
                if group != (keys[0, begin], keys[1, begin]):
                    group, hubs, into = (keys[0, begin], keys[1, begin]), [], {}
                middle, first = begin + np.searchsorted(keys[2, begin:end], [2, 1])
                hubs += [
                    (nodes[i], int(labels[i]), np.frombuffer(sketches_here[i], np.uint8).reshape(2, registers, 1), table[i].copy(), unpack(sets_here[i]))
                    for i in range(begin, middle)
                ]
                begin = first
                if begin == end:
                    continue
                own = np.frombuffer(b"".join(sketches_here[begin:end]), np.uint8).reshape(-1, 2, registers)
                own = np.ascontiguousarray(own.transpose(1, 2, 0))
                mine, my_table = nodes[begin:end], table[begin:end]
                # Of two hubs only the smaller is compared with the other as a member; that one does not come later.
                above = np.where(keys[2, begin:end] < 3, mine, np.iinfo(np.int64).max)
                label = np.array([find(x) for x in labels[begin:end].tolist()], np.int64)
                shingles = Sets([unpack(packed) for packed in sets_here[begin:end]])
                for hub, hub_label, hub_sketch, hub_buckets, hub_set in hubs:
                    hub_label = find(hub_label)
                    open_rows = (label != hub_label) & (above > hub)
                    if not open_rows.any():
                        continue
                    equal = (own == hub_sketch).view(np.uint8).sum(axis=1, dtype=np.min_scalar_type(registers))
                    rows = np.flatnonzero((equal >= SKETCH_LEAST * registers).any(axis=0) & open_rows)
                    rows = rows[hub_buckets[(my_table[rows] == hub_buckets).argmax(axis=1)] == group[0]]
                    linked = rows[shingles.alike(*hub_set, rows, least)]
                    if len(linked):
                        joined, one = np.unique(label[linked], return_index=True)
                        found += [(min(hub, mine[i]), max(hub, mine[i])) for i in linked[one]]
                        into.update((int(x), hub_label) for x in joined)
                        label[np.isin(label, joined)] = hub_label
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    links, open_members, hubs, count = None, members, FIRST_HUBS, members.count()
    labels = None
    while True:
        if labels is None:
            labeled = open_members.withColumn("label", F.col("node"))
        else:
            labeled = open_members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        active = labeled.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("a"), F.max("label").alias("b"))
        labeled = materialize(labeled.join(active.filter("a <> b").select("bucket", "members"), "bucket"), "labeled", count)
        sized = labeled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("n", F.xxhash64("node"), "node"))
        chosen = labeled.join(sized, ["bucket", "label"]).withColumn("rank", rank).filter(F.col("rank") <= hubs)
        chosen = materialize(chosen.select("bucket", "node", "label", "members", "rank"), "hubs", count)
        if chosen.isEmpty():
            return labels
        dealt = materialize(labeled.join(chosen.select("bucket", "node", "rank"), ["bucket", "node"], "left"), "dealt", count)
        # A large bucket is dealt over tiles: salts of its members by parts of its hubs.
        salts = F.ceil(F.col("members") / SALT_MEMBERS).cast("int")
        parts = F.ceil(F.least("members", F.lit(hubs)) / PART_HUBS).cast("int")
        single = (salts == 1) & (parts == 1)
        own_salt, own_part = F.pmod(F.xxhash64("node"), salts), F.pmod(F.col("rank"), parts)
        kind = F.when(F.col("rank").isNull(), 3).when(single, 1).otherwise(2).alias("kind")
        as_member = dealt.select("bucket", "node", "label", kind, own_salt.alias("salt"), parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        as_hub = chosen.filter(~single).select(
            "bucket", "node", "label", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), parts.alias("parts"), own_part.alias("part")
        )
        tile = (F.col("salt") * F.col("parts") + F.col("part")).cast("int").alias("salt")
        compared = (
            as_hub.unionByName(as_member)
            .select("bucket", tile, "kind", "node", "label")
            .join(stored, "node")
            .select("bucket", "salt", "kind", "node", "label", "sketch", "buckets", "shingles")
            .repartition("bucket", "salt")
            .sortWithinPartitions("bucket", "salt", "kind", "node")
        )
        verified = materialize(compared.mapInArrow(compare, "a bigint, b bigint"), "verified")
        if not verified.isEmpty():
            links = verified if links is None else links.unionByName(verified)
            labels = materialize(components(links, "a", "b"), "labels", links.count())
        open_members = dealt.filter(F.col("rank").isNull()).select("bucket", "node")
        hubs *= HUB_GROWTH


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every class of ``near_duplicates(docs)``, that of the smallest id, null last; the columns of ``docs``.

    A row is known by its id and its whole text, so null and repeated ids lose no text; of repeated rows of the
    kept one one stays. Texts without words are all kept. Names that begin with ``__keep`` are its own.
    """
    own = [F.col("doc_id").isNull().alias("n"), "doc_id", "t1", "t2"]
    rows = classes.groupBy("class_key", "doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("rows"))
    heads = rows.groupBy("class_key").agg(F.min(F.struct(*own, "rows")).alias("head")).select("head.*")
    heads = heads.groupBy("doc_id", "t1", "t2").agg(F.max("rows").alias("rows"))
    heads = materialize(heads.toDF("__keep_id", "__keep_t1", "__keep_t2", "__keep_rows"), "heads")
    text = F.coalesce(F.col(text_col), F.lit(""))
    spoken = text.rlike(r"[^\x20\x09-\x0D]")
    one, two = text_keys(text)
    keyed = docs.filter(spoken).withColumns({"__keep_1": one, "__keep_2": two})
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__keep_id"))
    kept = keyed.join(heads, same & (F.col("__keep_1") == F.col("__keep_t1")) & (F.col("__keep_2") == F.col("__keep_t2")))
    once = kept.filter("__keep_rows = 1").select(*docs.columns)
    more = kept.filter("__keep_rows > 1").dropDuplicates(["__keep_id", "__keep_1", "__keep_2"]).select(*docs.columns)
    return once.unionByName(more).unionByName(docs.filter(~spoken))
