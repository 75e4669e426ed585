"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.linear import histograms, logistic, mean_scores, sigmoid
from claimweave.llm.tokens import steps
from claimweave.session import materialize

TEXT_BUCKETS = 1024
META_BUCKETS = 512
#: Labelled rows that are fitted on and unlabelled rows that may get pseudo-labels, at most (by hash).
LABELLED = 3000
POOL = 3000
ROUNDS = 5
#: Part of the pool that a view hands over per round and class share, if it is at least so sure.
HANDED = 0.05
SURE = 0.9
#: Every third labelled row calibrates and is not trained on.
FOLDS = 3
#: Documents below this quality are rejected.
LEAST_QUALITY = 0.3


def metadata(docs: DataFrame, pages: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, marks)``: metadata of every document as words, from its columns and its page's address.

    A page belongs to the document whose number ends its path; of several the one of the smallest page id counts.
    """
    size = F.floor(F.log2(F.coalesce(F.col("n_chars"), F.lit(0)) + 1)).cast("string")
    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.array(
            F.concat(F.lit("source="), F.coalesce(F.col("source"), F.lit(""))),
            F.concat(F.lit("lang="), F.coalesce(F.col("lang"), F.lit(""))),
            F.concat(F.lit("size="), size),
        ).alias("marks"),
    )
    if pages is None:
        return own
    number = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/(?:[^?#]*/)?(\d+)(?:[./?#]|$)", 1).try_cast("bigint")
    linked = pages.select(number.alias("doc_id"), "page_id", "url").filter("doc_id is not null")
    linked = linked.groupBy("doc_id").agg(F.min_by("url", F.struct("page_id", "url")).alias("url"))
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    address = F.array(
        F.concat(F.lit("host="), host),
        F.concat(F.lit("scheme="), F.regexp_extract("url", r"^([a-z]+):", 1)),
        F.concat(F.lit("sub="), F.regexp_extract(host, r"^([^.]+)\.", 1)),
        F.concat(F.lit("top="), F.regexp_extract(host, r"([^.]+)$", 1)),
        F.concat(F.lit("tail="), F.regexp_extract("url", r"(\?[a-z_]+|#[a-z]+|\.html|/)", 1)),
    )
    pages_of = linked.select(F.col("doc_id").alias("_doc"), address.alias("_address"))
    joined = own.join(pages_of, F.col("doc_id") == F.col("_doc"), "left")
    return joined.select("doc_id", F.concat("marks", F.coalesce("_address", F.array(F.lit("page=none")))).alias("marks"))


def mark_matrix(marks: list[list[str]], buckets: int) -> np.ndarray:
    x = np.zeros((len(marks), buckets))
    for row, values in enumerate(marks):
        for value in values:
            x[row, zlib.crc32(value.encode()) % buckets] = 1.0
    return x


class Views:
    """Both classifiers and their calibrated combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, label: np.ndarray):
        """``label`` is 1, 0 or -1 (not labelled)."""
        views = (text, meta)
        labelled = np.flatnonzero(label >= 0)
        calibrate = labelled[::FOLDS]
        train = np.setdiff1d(labelled, calibrate)
        if len(set(label[train].tolist())) < 2:
            train = calibrate = labelled
        share = float(np.mean(label[train])) if len(train) else 0.5
        given = [label.astype(float).copy() for _ in views]
        rows = [train.copy(), train.copy()]
        pool = [np.flatnonzero(label < 0), np.flatnonzero(label < 0)]
        self.models = [self._fit(v, given[k], rows[k]) for k, v in enumerate(views)]
        for _ in range(ROUNDS):
            handed = []
            for k, view in enumerate(views):
                w, b = self.models[k]
                p = sigmoid(view[pool[1 - k]] @ w + b)
                room = int(HANDED * len(p))
                order = np.argsort(-p)
                good = order[: int(np.ceil(room * share))]
                bad = order[::-1][: int(np.ceil(room * (1 - share)))]
                good, bad = good[p[good] >= SURE], bad[p[bad] <= 1 - SURE]
                handed.append((pool[1 - k][good], pool[1 - k][bad]))
            for k, (good, bad) in enumerate(handed):
                other = 1 - k
                given[other][good], given[other][bad] = 1.0, 0.0
                rows[other] = np.concatenate([rows[other], good, bad])
                pool[other] = np.setdiff1d(pool[other], np.concatenate([good, bad]))
            self.models = [self._fit(v, given[k], rows[k]) for k, v in enumerate(views)]
        margins = np.stack([v[calibrate] @ w + b for v, (w, b) in zip(views, self.models, strict=True)], axis=1)
        self.mix, self.bias = logistic(margins, label[calibrate].astype(float)) if len(calibrate) else (np.zeros(2), 0.0)

    @staticmethod
    def _fit(view: np.ndarray, given: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
        if not len(rows):
            return np.zeros(view.shape[1]), 0.0
        y = given[rows]
        weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        return logistic(view[rows], y, weight)


def _sampled(rows: DataFrame, bound: int) -> DataFrame:
    count = rows.count()
    share = min(1.0, bound / max(count, 1))
    return rows.filter(F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Views:
    """Co-train on a bounded sample: ``LABELLED`` rows with a label and ``POOL`` rows without."""
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.filter("label is not null and doc_id is not null")
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    tagged = materialize(ids.join(known, "doc_id", "left"), "tagged")
    chosen = _sampled(tagged.filter("label is not null"), LABELLED).unionByName(_sampled(tagged.filter("label is null"), POOL))
    # At most LABELLED + POOL rows, so the texts are filtered in place.
    chosen = F.broadcast(materialize(chosen, "chosen"))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = histograms(batch.column("text"), TEXT_BUCKETS, letters_only=False).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "label", "x"]
            )

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    found = texts.mapInArrow(features, "doc_id bigint, label int, x binary").dropDuplicates(["doc_id"])
    table = found.join(marks.dropDuplicates(["doc_id"]), "doc_id").orderBy("doc_id").toArrow()
    if not table.num_rows:
        return Views(np.zeros((0, TEXT_BUCKETS)), np.zeros((0, META_BUCKETS)), np.zeros(0, int))
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(table.num_rows, TEXT_BUCKETS).astype(float)
    label = np.array([-1 if v is None else v for v in table.column("label").to_pylist()])
    return Views(x, mark_matrix(table.column("marks").to_pylist(), META_BUCKETS), label)


def score(
    docs: DataFrame, marks: DataFrame, views: Views, least: float = LEAST_QUALITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, kept)`` of every row.

    The two views are scored where their data are, the text view while texts are read, and only
    margins are joined.  ``score`` is the calibrated probability of good quality.  Null and empty texts have no
    grams and get the bias of the text view; documents without a page, source or language have
    metadata of their own for that; repeated ids share the metadata; an empty table gives an empty table.
    """
    (text_w, text_b), (meta_w, meta_b) = views.models
    mix, bias = views.mix, views.bias

    def text_margin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            margin = mean_scores(batch.column("text"), text_w.reshape(-1, 1), letters_only=False)[:, 0] + text_b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(margin, pa.float64())], ["doc_id", "text_margin"])

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks_here = [v or [] for v in batch.column("marks").to_pylist()]
            meta = mark_matrix(marks_here, META_BUCKETS) @ meta_w + meta_b
            text = batch.column("text_margin").to_numpy()
            total = sigmoid(np.stack([text, meta], axis=1) @ mix + bias)
            columns = [pa.array(v, pa.float64()) for v in (sigmoid(text), sigmoid(meta), total)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "text_score", "meta_score", "score"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    margins = texts.mapInArrow(text_margin, "doc_id bigint, text_margin double")
    once = marks.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("marks").alias("marks"))
    joined = margins.join(once, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text_margin", "marks")
    scored = joined.mapInArrow(combine, "doc_id bigint, text_score double, meta_score double, score double")
    return scored.withColumn("kept", F.col("score") >= least)
