"""Language identification: the family first, then one-versus-one machines within it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.linear import histograms, linear_svm, mean_scores, sigmoid
from claimweave.llm.tokens import steps

# Families of languages by code; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BUCKETS = 2048
#: Texts that the models are fitted on, at most (a sample by hash, in equal parts of every language).
SAMPLE = 3000
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class Model:
    """Machines of all families against the rest and of all pairs of languages within a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        known = sorted(set(langs))
        names = np.array(langs)
        family = np.array([_FAMILY_OF.get(lang, lang) for lang in langs])
        self.families = sorted(set(family.tolist()))
        self.members = {f: [k for k in known if _FAMILY_OF.get(k, k) == f] for f in self.families}
        weights, biases = [], []

        def fit(rows: np.ndarray, good: np.ndarray) -> int:
            w, b = linear_svm(x[rows], np.where(good, 1.0, -1.0))
            weights.append(w)
            biases.append(b)
            return len(weights) - 1

        everything = np.ones(len(langs), bool)
        many = len(self.families) > 1
        self.one_rest = {f: fit(everything, family == f) for f in self.families} if many else {}
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                rows = (names == a) | (names == b)
                self.pairs[a, b] = fit(rows, names[rows] == a)
        self.weights = np.array(weights).T.reshape(x.shape[1], -1).astype(np.float32)
        self.biases = np.array(biases)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        margins = (mean_scores(texts, self.weights) if self.weights.size else np.zeros((len(texts), 0))) + self.biases
        count = len(texts)
        if self.one_rest:
            of_family = sigmoid(2.0 * np.stack([margins[:, self.one_rest[f]] for f in self.families], axis=1))
            chosen = of_family.argmax(axis=1)
            sure = of_family.max(axis=1) / of_family.sum(axis=1)
        else:
            chosen, sure = np.zeros(count, int), np.ones(count)
        lang, score = np.empty(count, object), np.zeros(count)
        for number, family in enumerate(self.families):
            members = self.members[family]
            votes = np.zeros((count, len(members)))
            least = np.ones((count, len(members)))
            for a, b in combinations(range(len(members)), 2):
                p = sigmoid(2.0 * margins[:, self.pairs[members[a], members[b]]])
                votes[:, a] += (p >= 0.5) + 1e-6 * p
                votes[:, b] += (p < 0.5) + 1e-6 * (1 - p)
                least[:, a], least[:, b] = np.minimum(least[:, a], p), np.minimum(least[:, b], 1 - p)
            best = votes.argmax(axis=1)
            here = chosen == number
            lang[here] = np.array(members, object)[best[here]]
            score[here] = (sure * least[np.arange(count), best])[here]
        return lang, score


def fit(docs: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from rows that are not held out and have a language and a letter; None without any.

    The sample is bounded by ``sample`` rows: each language gives an equal part, those of the
    smallest hashes of their ids and texts, so rows of one id or of none are drawn one by one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    part = max(1, sample // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < int(min(1.0, part / n) * (1 << 30))))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = histograms(batch.column("text"), buckets).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "x"])

    found = rows.filter(wanted).select("lang", "text").mapInArrow(features, "lang string, x binary").toArrow()
    langs = found.column("lang").to_pylist()
    if not langs:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(len(langs), buckets).astype(float)
    order = np.lexsort((x[:, 0], np.array(langs)))
    return Model(x[order], [langs[i] for i in order])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, from its whole text alone.

    A null text, one without a letter, and any text where nothing could be learned are ``und`` with
    score 0.  Repeated rows get the same answer; an empty table gives an empty table.
    """
    kept = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            if kept is None:
                lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            else:
                lang, score = kept.predict(batch.column("text"))
                lang, score = np.where(lettered, lang, UNKNOWN), np.where(lettered, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        text.rlike(r"\p{L}").alias("lettered"),
        text.alias("text"),
    )
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
