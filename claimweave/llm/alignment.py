"""Cross-tokenizer alignment: two tokenizers' ends of one text, merged in equal pieces by merge paths.

Both tokenizers cut the same bytes.  Their ends are two sorted lists; merging them gives every
overlap of an A token with a B token, and every end that both share closes a group.  A diagonal of
the merge grid is crossed by the path at a place that a binary search finds without the merge,
so the merge falls into pieces of equal work.  Pieces are rows of a stored table: any task can take any of
them, and emits its overlaps.  Groups that cross pieces are stitched in the last step.
"""

from __future__ import annotations

import array
import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.tokens import Encoder, steps
from claimweave.session import materialize

#: Ends of both tokenizers in one piece.
PIECE_ENDS = 1 << 15
#: Bytes of text whose documents share one key (a longer document has its own), and that are merged at once.
STEP_BYTES = 2 << 20
#: Bytes of texts that are encoded at once, and units that the encoder of A keeps.
ENCODE_BYTES = 1 << 19
CACHE_UNITS = 240_000
#: Bytes after which a text is cut at the next safe boundary.
SEGMENT_BYTES = 1 << 20
_RARE = r"\x0b\x0c\x1c-\x1f\x85\xa0  -     　"
_SAFE_CUT = re.compile(rf"(?<=[^ \t\n\r{_RARE}])(?=[ \t\n])")


class Tokens(NamedTuple):
    """Ids and byte lengths of both tokenizers over a part of a text."""

    a_ids: np.ndarray
    a_lens: np.ndarray
    b_ids: np.ndarray
    b_lens: np.ndarray


class _Spelling:
    """Bytes of every token of a vocabulary."""

    def __init__(self, names: list[bytes], lossless: bool = False):
        self.lens = np.array([len(x) for x in names], "<u4")
        self.begin = np.cumsum(self.lens, dtype=np.int64) - self.lens
        self.letters = np.frombuffer(b"".join(names), np.uint8)
        #: A byte-level vocabulary with all bytes loses none, so its lengths tell all.
        self.lossless = lossless

    def sizes(self, ids: np.ndarray, raw: np.ndarray) -> np.ndarray | None:
        """Bytes of each token, or ``None`` where the tokens do not spell ``raw``."""
        lens = self.lens[ids]
        ends = np.cumsum(lens, dtype=np.int64)
        if not len(ids) or ends[-1] != len(raw) or not lens.all():
            return None
        if self.lossless:
            return lens
        at = np.arange(len(raw)) + np.repeat(self.begin[ids] - ends + lens, lens)
        return lens if np.array_equal(self.letters[at], raw) else None


class PairEncoder:
    """Both tokenizers over the same texts, in segments.

    A segment begins where ASCII white space follows another character.  The byte-level pattern of A never
    reaches over such a place, and B's vocabulary is searched for a piece that could; if it has one,
    texts are not cut.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path, plain=True, cache_units=CACHE_UNITS)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        size = self.a.library.get_vocab_size(with_added_tokens=True)
        names = [self.a.library.id_to_token(i) or "" for i in range(size)]
        a_bytes = [bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        crossing = re.compile("[^▁\t\n\r][▁\t\n]")
        self.cuts = not any(crossing.search(p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        complete = {bytes([b]) for b in range(256)} <= set(a_bytes)
        self.a_spelled, self.b_spelled = _Spelling(a_bytes, complete), _Spelling(b_bytes)

    def encode(self, texts: list[str | None]) -> list[list[Tokens] | None]:
        """Tokens of every whole text with one space before it, in parts that follow each other.

        ``None`` for null and empty texts and where the tokens of either side do not spell the space and the text.
        """
        cut = [list(_segments(" " + text, self.cuts)) if text else [] for text in texts]
        flat = [segment for segments in cut for segment in segments]
        a = self.a.encode(flat)
        # B adds a space of its own, or gets a letter that takes it: no token reaches over the segment's begin.
        first = [k == 0 for segments in cut for k in range(len(segments))]
        b = self.b.encode([x[1:] if begins else "x" + x for x, begins in zip(flat, first, strict=True)], num_threads=1)
        found = []
        for segment, begins, a_raw, b_ids in zip(flat, first, a, b, strict=True):
            a_ids = np.frombuffer(a_raw, "<u4")
            ids = np.frombuffer(array.array("I", b_ids), np.uint32)[not begins :]
            raw = np.frombuffer(segment.encode(), np.uint8)
            a_lens, b_lens = self.a_spelled.sizes(a_ids, raw), self.b_spelled.sizes(ids, raw)
            found.append(None if a_lens is None or b_lens is None else Tokens(a_ids, a_lens, ids, b_lens))
        at = 0
        out = []
        for segments in cut:
            parts = found[at : at + len(segments)]
            at += len(segments)
            out.append(parts if parts and all(p is not None for p in parts) else None)
        return out


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(others)}}


def _segments(text: str, cuts: bool) -> Iterator[str]:
    """A text in parts of at least ``SEGMENT_BYTES`` characters, cut before white space that follows another character."""
    first = 0
    while cuts and len(text) - first > SEGMENT_BYTES:
        cut = _SAFE_CUT.search(text, first + SEGMENT_BYTES)
        if cut is None:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:]


_PAIRS: dict[tuple[str, str], PairEncoder] = {}


def pair_encoder(a_path: str, b_path: str) -> PairEncoder:
    """One encoder per worker process and pair of files."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = PairEncoder(a_path, b_path)
    return _PAIRS[a_path, b_path]


def crossings(ends_a: np.ndarray, ends_b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` merged ends are A's, for every diagonal ``d``; of equal ends A's comes first."""
    low = np.maximum(0, diagonals - len(ends_b))
    high = np.minimum(diagonals, len(ends_a))
    while (open_ := low < high).any():
        at = np.flatnonzero(open_)
        middle = (low[at] + high[at]) // 2
        before = ends_a[middle] <= ends_b[diagonals[at] - 1 - middle]
        low[at[before]] = middle[before] + 1
        high[at[~before]] = middle[~before]
    return low


class Piece(NamedTuple):
    """Ends of both tokenizers between two diagonals; ids and ends hold one more token where the text goes on."""

    n_a: int
    n_b: int
    a_start: int
    a_ids: np.ndarray
    a_ends: np.ndarray
    b_ids: np.ndarray
    b_ends: np.ndarray

    def overlaps(self, shared: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A index, B index and end of every overlap that ends in this piece, by what ``shared`` gave."""
        a, b = self.a_ends[: self.n_a], self.b_ends[: self.n_b]
        of_a = np.searchsorted(self.b_ends, a)
        own = np.flatnonzero(~shared)
        at_a = np.concatenate([np.arange(self.n_a), places[own]])
        at_b = np.concatenate([of_a, own])
        return at_a, at_b, np.concatenate([a, b[own]])

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """Which of the B ends of the piece are A ends too, and how many A ends of the piece lie before each.

        A's may be the last end of the piece before.
        """
        b = self.b_ends[: self.n_b]
        at = np.searchsorted(self.a_ends[: self.n_a], b)
        known = np.append(self.a_ends[: self.n_a], -1)
        return (known[at] == b) | (b == self.a_start), at


def pieces(a_ids: np.ndarray, a_lens: np.ndarray, b_ids: np.ndarray, b_lens: np.ndarray, base: int, size: int) -> Iterator[Piece]:
    """Cut the merge of two token lists over the same bytes from ``base`` on into pieces of ``size`` ends."""
    ends_a = base + np.cumsum(a_lens, dtype=np.int64)
    ends_b = base + np.cumsum(b_lens, dtype=np.int64)
    total = len(ends_a) + len(ends_b)
    diagonals = np.append(np.arange(0, total, size), total)
    at_a = crossings(ends_a, ends_b, diagonals)
    at_b = diagonals - at_a
    for i0, i1, j0, j1 in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:], strict=True):
        a, b = slice(i0, i1 + 1), slice(j0, j1 + 1)
        start = int(ends_a[i0 - 1]) if i0 else base
        yield Piece(int(i1 - i0), int(j1 - j0), start, a_ids[a], ends_a[a], b_ids[b], ends_b[b])


_PIECE_SCHEMA = (
    "step bigint, piece int, n_a int, n_b int, a_start bigint, b_start bigint, "
    "a_ids binary, b_ids binary, docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_bytes: bigint>>"
)
_ARROW_PIECES = pa.schema(
    [
        ("step", pa.int64()),
        ("piece", pa.int32()),
        ("n_a", pa.int32()),
        ("n_b", pa.int32()),
        ("a_start", pa.int64()),
        ("b_start", pa.int64()),
        ("a_ids", pa.binary()),
        ("b_ids", pa.binary()),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_bytes", pa.int64())]))),
    ]
)


def _packed(values: np.ndarray) -> bytes:
    """One byte with the width and four with the length, then the values in 2 or 4 bytes each, compressed."""
    most = int(values.max()) if len(values) else 0
    width = 2 if most < 1 << 16 else 4
    raw = values.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = pa.decompress(packed[5:], int.from_bytes(packed[1:5], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{packed[0]}").astype(np.int64)


def _stored(step: int, number: int, piece: Piece) -> dict:
    """A piece as a row; the bytes of its tokens follow from their ids (``Sizes``)."""
    b_start = int(piece.b_ends[0]) if len(piece.b_ends) else 0
    return {
        "step": step,
        "piece": number,
        "n_a": piece.n_a,
        "n_b": piece.n_b,
        "a_start": piece.a_start,
        "b_start": b_start,
        "a_ids": _packed(piece.a_ids),
        "b_ids": _packed(piece.b_ids),
        "docs": None,
    }


class Sizes(NamedTuple):
    """Bytes of every token of both vocabularies."""

    a: np.ndarray
    b: np.ndarray

    def load(self, row: dict) -> Piece:
        a_ids, b_ids = _unpacked(row["a_ids"]), _unpacked(row["b_ids"])
        a_ends = row["a_start"] + np.cumsum(self.a[a_ids], dtype=np.int64)
        b_ends = row["b_start"] + np.concatenate([[0], np.cumsum(self.b[b_ids[1:]], dtype=np.int64)])[: len(b_ids)]
        return Piece(row["n_a"], row["n_b"], row["a_start"], a_ids, a_ends, b_ids, b_ends)


class _Step:
    """Documents that share a key: their pieces and, at the end, one row that lists them."""

    def __init__(self, key: int, piece_ends: int):
        self.key, self.piece_ends = key, piece_ends
        self.docs: list[dict] = []
        self.waiting: list[Tokens] = []
        self.bytes = self.base = self.pieces = self.held = 0

    def add(self, doc_id: int | None, text: str, parts: list[Tokens] | None) -> Iterator[dict]:
        parts = parts or []
        n_a, n_b = (sum(len(p[k]) for p in parts) for k in (0, 2))
        size = sum(int(p.a_lens.sum(dtype=np.int64)) for p in parts)
        self.docs.append({"doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_bytes": size})
        self.bytes += len(text)
        for part in parts:
            self.waiting.append(part)
            self.held += int(part.a_lens.sum(dtype=np.int64))
            if self.held > STEP_BYTES:
                yield from self.merge()

    def merge(self) -> Iterator[dict]:
        """Pieces of what waits; a part ends with an end of both tokenizers, so nothing is open."""
        if not self.waiting:
            return
        a_ids, a_lens, b_ids, b_lens = map(np.concatenate, zip(*self.waiting, strict=True))
        for piece in pieces(a_ids, a_lens, b_ids, b_lens, self.base, self.piece_ends):
            yield _stored(self.key, self.pieces, piece)
            self.pieces += 1
        self.base += int(a_lens.sum(dtype=np.int64))
        self.waiting, self.held = [], 0

    def close(self) -> Iterator[dict]:
        yield from self.merge()
        yield dict.fromkeys(_ARROW_PIECES.names) | {"step": self.key, "piece": -1, "docs": self.docs}


def encode_pieces(docs: DataFrame, a_path: str, b_path: str, piece_ends: int = PIECE_ENDS) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text``) as pieces, and one row (``piece`` -1) per step that lists its documents."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(a_path, b_path)
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 32
        step = _Step(key, piece_ends)
        for batch in steps(batches, limit=ENCODE_BYTES):
            texts = batch.column("text").to_pylist()
            for doc_id, text, parts in zip(batch.column("doc_id").to_pylist(), texts, encoder.encode(texts), strict=True):
                if step.bytes and step.bytes + len(text or "") > STEP_BYTES:
                    yield pa.RecordBatch.from_pylist(list(step.close()), _ARROW_PIECES)
                    key += 1
                    step = _Step(key, piece_ends)
                rows = list(step.add(doc_id, text or "", parts))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW_PIECES)
        if step.docs:
            yield pa.RecordBatch.from_pylist(list(step.close()), _ARROW_PIECES)

    return docs.mapInArrow(encode, _PIECE_SCHEMA)


def _codes(piece: Piece, shared: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair of every overlap of a piece as one integer, and where the overlap ends."""
    at_a, at_b, ends = piece.overlaps(shared, places)
    return (piece.a_ids[at_a] << 32) | piece.b_ids[at_b], ends


def count_links(stored: DataFrame, sizes: Sizes) -> DataFrame:
    """``(step, pair, n)``: overlaps of each id pair, summed over the pieces of a step that lie together."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _PAIRS.clear()  # the worker may hold the encoders of the stage before
        step, held = None, []

        def summed() -> Iterator[pa.RecordBatch]:
            if held:
                pairs, back = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in held]), len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), step)), pa.array(pairs), pa.array(n)], ["step", "pair", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["step"] != step:
                    yield from summed()
                    step, held = row["step"], []
                piece = sizes.load(row)
                held.append(np.unique(_codes(piece, *piece.shared())[0], return_counts=True))
        yield from summed()

    columns = [c for c in stored.columns if c != "docs"]
    return stored.filter("piece >= 0").select(*columns).mapInArrow(count, "step bigint, pair bigint, n bigint")


class _Groups:
    """Groups of one step as text, digested document by document; groups open at a piece's end wait for the next piece."""

    _SEPARATORS = (b",", b"|", b";")

    def __init__(self):
        self.a = np.zeros(0, np.int64)
        self.b = np.zeros(0, np.int64)

    def add(self, piece: Piece, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the groups that the piece closes, in writing order, their separators and the end of each group's text."""
        shared = np.flatnonzero(shared)
        a = np.concatenate([self.a, piece.a_ids[: piece.n_a]])
        b = np.concatenate([self.b, piece.b_ids[: piece.n_b]])
        ends = piece.b_ends[shared]
        last_b = len(self.b) + shared + 1
        last_a = len(self.a) + np.searchsorted(piece.a_ends[: piece.n_a], ends, side="right")
        n_a, n_b = (int(last_a[-1]), int(last_b[-1])) if len(shared) else (0, 0)
        sizes_a, sizes_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        group_a, group_b = np.repeat(np.arange(len(shared)), sizes_a), np.repeat(np.arange(len(shared)), sizes_b)
        place_a = np.arange(n_a) + (last_b - sizes_b)[group_a]
        place_b = np.arange(n_b) + last_a[group_b]
        ids = np.zeros(n_a + n_b, np.int64)
        marks = np.zeros(n_a + n_b, np.int64)
        ids[place_a], ids[place_b] = a[:n_a], b[:n_b]
        if len(shared):
            marks[place_a[last_a - 1]] = 1
            marks[place_b[last_b - 1]] = 2
        self.a, self.b = a[n_a:], b[n_b:]
        return ids * 3 + marks, last_a + last_b, ends


_NAMES: list[pa.Array] = []


def _names(most: int) -> pa.Array:
    """Ids with the separator after them, by ``_Groups`` codes; one entry per id and separator of the vocabularies."""
    if not _NAMES or len(_NAMES[0]) <= most:
        _NAMES[:] = [pa.array([b"%d%s" % (code // 3, _Groups._SEPARATORS[code % 3]) for code in range(2 * most + 1)], pa.binary())]
    return _NAMES[0]


def _score_step(sizes: Sizes, stored: pa.Table, scored: pa.Table) -> pa.Table:
    _PAIRS.clear()
    rows = stored.to_pylist()
    rows.sort(key=lambda r: r["piece"])
    docs = rows[0]["docs"]
    table = np.array(scored.column("pair").to_numpy(), np.int64)
    order = np.argsort(table)
    table = table[order]
    counts = np.array(scored.column("count").to_numpy(), np.int64)[order]
    best = np.array(scored.column("best").to_numpy(zero_copy_only=False), bool)[order]

    n = len(docs)
    doc_ends = np.cumsum([d["n_bytes"] for d in docs])
    full = np.flatnonzero([d["n_bytes"] > 0 for d in docs])
    full_ends = doc_ends[full]
    totals = {name: np.zeros(n, np.int64) for name in ("n_groups", "n_links", "n_best", "count_sum")}
    digests = {}
    groups = _Groups()

    for row in rows[1:]:
        piece = sizes.load(row)
        shared, places = piece.shared()
        pairs, ends = _codes(piece, shared, places)
        at, owner = np.searchsorted(table, pairs), full[np.searchsorted(full_ends, ends)]
        totals["n_links"] += np.bincount(owner, minlength=n)
        totals["n_best"] += np.bincount(owner[best[at]], minlength=n)
        np.add.at(totals["count_sum"], owner, counts[at])
        codes, text_ends, group_ends = groups.add(piece, shared)
        owners = full[np.searchsorted(full_ends, group_ends)]
        totals["n_groups"] += np.bincount(owners, minlength=n)
        if not len(group_ends):
            continue
        written = _names(int(codes.max())).take(pa.array(codes))
        text, text_ends = memoryview(written.buffers()[2]), np.frombuffer(written.buffers()[1], np.int32)[text_ends]
        last = np.flatnonzero(np.append(owners[1:] != owners[:-1], True))
        begin = 0
        for owner, end in zip(owners[last].tolist(), text_ends[last].tolist(), strict=True):
            part = text[begin:end]
            begin = end
            # The text of a document ends without the separator of its last group.
            sha, open_ = digests.get(owner, (None, b""))
            sha = sha or hashlib.sha256()
            sha.update(open_)
            sha.update(part[:-1])
            digests[owner] = (sha, bytes(part[-1:]))

    has = np.array([d["n_bytes"] > 0 for d in docs])
    shas = [digests[i][0].hexdigest() if has[i] else "" for i in range(n)]
    return pa.table(
        {
            "doc_id": pa.array([d["doc_id"] for d in docs], pa.int64()),
            "n_a": pa.array([d["n_a"] for d in docs], pa.int64()),
            "n_b": pa.array([d["n_b"] for d in docs], pa.int64()),
            **{name: pa.array(values) for name, values in totals.items()},
            "groups_sha256": pa.array(shas, pa.string()),
        }
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """``(pair, count, best)`` over all documents; ``best`` where no other pair of the same B id has more."""
    counts = materialize(links.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(of_b).agg(F.max("count").alias("most"))  # one row per id of B's vocabulary
    return counts.withColumn("b", of_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece_ends: int = PIECE_ENDS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs``.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, ``b_path`` a sentencepiece model.
    Links are overlaps of an A token with a B token; a pair's count is its number of links in all rows.

    Null and empty texts, and those whose tokens do not spell a space and the text, have no
    tokens: zeros and an empty digest. Each row of ``docs`` gives one row, repeated rows and null ids
    too, and all count; ties for the best pair of a B id are all best; other columns are ignored, and an empty table gives an empty one.
    A text of any length is encoded in segments, merged piece by piece and digested as its pieces come.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    encoder = PairEncoder(a_path, b_path)
    sizes = Sizes(encoder.a_spelled.lens, encoder.b_spelled.lens)
    stored = materialize(encode_pieces(rows, a_path, b_path, piece_ends), "token-pieces")
    links = materialize(count_links(stored, sizes), "pair-links")
    counts = materialize(pair_counts(links), "scored-pairs")
    scored = links.select("step", "pair").join(counts, "pair").select("step", "pair", "count", "best")
    schema = (
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )

    def score(key: tuple, pieces_here: pa.Table, pairs_here: pa.Table) -> pa.Table:
        return _score_step(sizes, pieces_here, pairs_here)

    return stored.groupBy("step").cogroup(scored.groupBy("step")).applyInArrow(score, schema)
