"""Corpus operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from claimweave.llm import cotrain, curriculum, imatch, language, orc_tokens, packing, probminhash, recompress, repetition, token_counts, tokens
from claimweave.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, count):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ré", "St", "une"], rng.integers(1, 4))) for _ in range(count))


def awkward_rows():
    shared = prose(1, 60)
    texts = [
        prose(2, 300),
        prose(2, 300),
        prose(2, 300).replace("ka", "ko", 2),
        None,
        "",
        " \t\n",
        prose(3, 40) + " " + shared + " " + prose(4, 30),
        prose(5, 20) + "\n" + shared,
        "la " * 120,
        "x",
        "<|endoftext|> A  b c  d <|ENDOFTEXT|> it's",
        prose(6, 3000),
        ("line of five words here\n" * 3) + prose(7, 80),
    ]
    rows = [(i * 7, t, ("en", "fr", None)[i % 3], ("b", "a", None)[i % 3], len(t or ""), "own") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, prose(8, 60), "en", "a", 1, "own")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_token_counts_match_the_library(docs, empty):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        want = sorted(((d, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts_of(docs)), key=str)
        got = token_counts.count_tokens(docs, public_tokenizers.path(name))
        assert sorted(((r[0], r[1], r[2]) for r in got.collect()), key=str) == want
    assert token_counts.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_decomposed_capitals_match_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for text in ("J\u030c ab", "xH\u0331 T\u0308 W\u030a Y\u030ax Plain WORDS", "\u00c9T\u00c9 E\u0301T"):
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert tokens.Encoder(path).encode([text]) == [ids]


def library_ids(text, end):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array([*library.encode(text, add_special_tokens=False).ids, end], "<u4")


def test_packing_covers_every_token_once(docs, empty):
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=64).collect()
    want = []
    for doc_id, text in texts_of(docs):
        ids = library_ids(text, 0)
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json"), end_id=0).count() == 0


def test_best_fit_decreasing_equals_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 21, rng.integers(1, 80)).tolist(), reverse=True)
        bins = []
        for length in lengths:
            fitting = [b for b in range(len(bins)) if bins[b] >= length]
            if fitting:
                bins[min(fitting, key=lambda b: bins[b])] -= length
            else:
                bins.append(20 - length)
        slots = packing.best_fit_decreasing(dict(collections.Counter(lengths)), 20)
        used = collections.Counter()
        for length, runs in slots.items():
            for run in runs:
                for i in range(run.count):
                    used[run.bin + i // run.per_bin] += length
        assert sorted(used.values()) == sorted(20 - b for b in bins)


def test_orc_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "orc")
    orc_tokens.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    got = orc_tokens.read_digests(spark, path).collect()
    start = 0
    ordered = sorted(texts_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for doc_id, text in ordered:
        ids = library_ids(text, 2)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_repetition_counts(docs, empty):
    got = {(r["doc_id"], r["text"]): r for r in repetition.quality(docs).collect()}
    for doc_id, text in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        row, body = got[doc_id, text], text or ""
        found = WORD.findall(body)
        triples = collections.Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
        inside = {i + k for i in range(len(found) - 2) if triples[tuple(found[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in body.split("\n") if WORD.search(line)]
        assert row["n_words"] == len(found)
        assert row["word_chars"] == sum(map(len, found))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", body))
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == len(inside)
        longest = 0
        for i, j in itertools.combinations(range(min(len(found), 400)), 2):
            k = 0
            while j + k < len(found) and found[i + k] == found[j + k]:
                k += 1
            longest = max(longest, k)
        if len(found) <= 400:
            assert row["longest_repeat"] == (longest if longest >= repetition.REPEAT_WORDS else 0)
    assert repetition.quality(empty).count() == 0


def test_repeats_are_removed_as_by_brute_force(docs, empty):
    rows = texts_of(docs)
    counts = collections.Counter(tuple(w[i : i + 35]) for _, t in rows for w in [WORD.findall(t)] for i in range(len(w) - 34))
    want = []
    for doc_id, text in rows:
        found = WORD.findall(text)
        gone = {i + k for i in range(len(found) - 34) if counts[tuple(found[i : i + 35])] > 1 for k in range(35)}
        want.append((doc_id, len(found), len(gone), " ".join(w for i, w in enumerate(found) if i not in gone)))
    for hot in (10_000, 1):
        got = recompress.remove_repeats(docs.drop("n_words"), hot=hot).select("doc_id", "n_words", "n_removed", "kept_words")
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert recompress.remove_repeats(empty).count() == 0


def test_near_duplicate_classes(docs, empty):
    got = collections.defaultdict(set)
    for r in probminhash.near_duplicates(docs).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert got[0] == {0, 7, 14}
    assert all(len(v) == 1 for k, v in got.items() if k != 0)
    kept = probminhash.keep_one(docs, probminhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({r[0] for r in awkward_rows()} - {7, 14}, key=str)
    assert probminhash.near_duplicates(empty).count() == 0


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    names = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    one, two = np.sort(names[:220]), np.sort(names[60:])
    wa, wb = rng.uniform(1, 3, len(one)), rng.uniform(1, 3, len(two))
    owner = np.repeat([0, 1], [len(one), len(two)])
    signature = probminhash.sketches(owner, np.concatenate([one, two]), np.concatenate([wa, wb]), 2, 4000)
    exact = sum(
        1 / sum(max(dict(zip(one, wa, strict=True)).get(j, 0) / a, dict(zip(two, wb, strict=True)).get(j, 0) / dict(zip(two, wb, strict=True))[i]) for j in names)
        for i, a in zip(one, wa, strict=True)
        if i in set(two.tolist())
    )
    found, plain = probminhash.similarity(one, wa, two, wb)
    assert found == pytest.approx(exact)
    assert plain == pytest.approx(160 / 300)
    assert (signature[0] == signature[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_duplicate_links_match_brute_force(spark):
    rng = np.random.default_rng(11)

    def distinct(family, count):
        return [f"w{family}x{i}" for i in range(count)]

    texts = []
    # Equal sets of shingles, of which one passage is repeated a different number of times.
    for family in range(40):
        body, passage = distinct(family, 60), distinct(f"p{family}", 50)
        texts += [" ".join(body + passage * times + passage[:4]) for times in (1, 150)]
    # Copies with random words replaced: many pairs between 0.6 and 1 alike in common buckets.
    for family in range(100, 102):
        base = distinct(family, 400)
        for copy in range(30):
            words = list(base)
            for at in rng.choice(400, rng.integers(0, 16), replace=False):
                words[at] = f"z{family}x{copy}x{at}"
            texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    owner, shingle, weight, _ = probminhash.weighted_shingles(pa.array(texts), probminhash.SHINGLE_WORDS)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = [(shingle[a:b], weight[a:b]) for a, b in itertools.pairwise(cuts)]
    label = list(range(len(texts)))
    low = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        measures = probminhash.similarity(*sets[i], *sets[j])
        low += measures[0] < 0.7 and measures[1] == 1
        if max(measures) >= probminhash.SIMILARITY:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    assert low == 40
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(rows).collect()}
    assert got == dict(enumerate(label))


def test_sets_are_compared_at_once_as_one_by_one(monkeypatch):
    monkeypatch.setattr(probminhash, "LOOK_UP", 500)  # several parts
    rng = np.random.default_rng(5)
    sets = []
    for copy in range(60):
        shingles = np.unique(np.append(rng.choice(120, 100, replace=False), [200 + copy] * (copy % 3))).astype("<u4")
        weights = np.where(rng.random(len(shingles)) < 0.1 * (copy % 2), 1 + np.log(rng.integers(2, 60)), 1.0)
        sets.append((shingles, weights.astype("<f2").astype(float)))
    at_once, rows = probminhash.Sets(sets), np.arange(0, 60)
    for least in (0.5, 0.7, 0.72, 0.8):
        for one in sets:
            expected = [max(probminhash.similarity(*one, *other)) >= least for other in sets]
            assert at_once.alike(*one, rows, least).tolist() == expected
    assert at_once.alike(*sets[0], rows[:0], 0.8).tolist() == []


def test_buckets_are_compared_in_tiles(spark, monkeypatch):
    for name, value in {"SALT_MEMBERS": 7, "PART_HUBS": 3, "FIRST_HUBS": 2}.items():
        monkeypatch.setattr(probminhash, name, value)
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"z{copy}x{i}" if i in rng.choice(200, copy % 12, replace=False) else word for i, word in enumerate(base)) for copy in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    owner, shingle, weight, _ = probminhash.weighted_shingles(pa.array(texts), probminhash.SHINGLE_WORDS)
    sets = [(shingle[a:b], weight[a:b]) for a, b in itertools.pairwise(np.searchsorted(owner, np.arange(len(texts) + 1)))]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if max(probminhash.similarity(*sets[i], *sets[j])) >= probminhash.SIMILARITY:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    assert 1 < len(set(label)) < 80
    assert {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(rows).collect()} == dict(enumerate(label))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_mixing_meets_targets(docs, empty):
    rows = curriculum.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes = collections.Counter()
    taken = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"])
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(taken[r["source"]] - r["target"]) <= 1
    assert sum(r["size"] for r in rows) == pytest.approx(sum({r["source"]: r["target"] for r in rows}.values()))
    assert sorted(map(str, rows)) == sorted(map(str, curriculum.mix(docs).collect()))
    assert curriculum.mix(empty).count() == 0


def test_training_order_takes_every_row_as_the_mix_does(spark):
    rows = [(None, prose(100 + i, 5 + 7 * i), "en", "hot", 1, f"n{i}") for i in range(12)]
    rows += [(3, prose(200 + i, 9 + i % 2), "en", "hot", 1, f"r{i}") for i in range(4)]
    rows += [(50 + i, prose(300 + i, 20), "en", ("cool", None)[i % 2], 1, f"c{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = collections.Counter()
    size = collections.Counter()
    for r in curriculum.mix(docs).collect():
        size[r["source"]] += r["size"]
        target[r["source"]] = round(r["target"])
    assert target["hot"] < size["hot"]
    got = corpus_pipeline.mixing(spark, docs, "").collect()
    taken, parts = collections.Counter(), collections.defaultdict(list)
    for r in got:
        taken[r["source"]] += len(r["text"].split())
        parts[r["n_words"]].append(r["text"])
        assert r["n_chars"] == len(r["text"]) > 0
    assert taken == target
    # All copies of a row are whole but for the one where the stream of its source ends.
    cut = collections.Counter()
    for _, text, _, source, _, name in rows:
        for part in parts[name]:
            assert text.startswith(part)
            cut[source] += part != text
    assert max(cut.values()) <= 1
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.mixing(spark, docs.repartition(3), "").collect()))


def test_near_duplicates_of_null_ids_keep_their_links(spark):
    texts = [prose(400 + i, 60) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts] + [(100 + i, t + " end") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = probminhash.near_duplicates(docs).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None} == {(d, d % 100) for d, _ in rows if d is not None}
    assert sorted(r["class_id"] for r in got if r["doc_id"] is None) == list(range(12))


def test_schedule_inversion(spark):
    for schedule in curriculum.SCHEDULES:
        total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in itertools.pairwise(schedule))
        rows = spark.range(0, 11).select((F.col("id") / 10).alias("share")).withColumn("t", curriculum.time_of(F.col("share"), schedule))
        for r in rows.collect():
            grid = np.linspace(0, r["t"], 2001)
            given = np.trapezoid(np.interp(grid, *zip(*schedule, strict=True)), grid) / total
            assert given == pytest.approx(r["share"], abs=1e-3)


def test_imatch(docs, empty):
    rows = imatch.fingerprints(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    by = {r["doc_id"]: r for r in rows}
    ordered = sorted((r[0], r[1] or "") for r in awkward_rows()[:-2])
    for i, (doc_id, text) in enumerate(ordered):
        half, following = len(text) // 2, ordered[(i + 1) % len(ordered)][1]
        edited = text[: len(text) - half] + following[:half]
        assert by[doc_id]["n_chars"] == len(text)
        assert by[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= by[doc_id]["near_edited"] <= 1
    assert by[0]["fingerprint"] == by[7]["fingerprint"]
    assert by[0]["near_next"] == 1.0
    assert imatch.fingerprints(empty).count() == 0
    assert imatch.fingerprints(docs).count() == docs.count()


def test_language_and_quality_learn(spark, empty):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() > 0.97 * found.count()
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, "")], "doc_id bigint, text string")
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(docs)).collect()} == {"und"}
    assert language.predict(empty, language.fit(empty)).count() == 0

    labels = spark.read.parquet(f"{path}/labels.parquet")
    marks = cotrain.metadata(docs, spark.read.parquet(f"{path}/pages.parquet"))
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    views = cotrain.fit(docs, labels.filter(~unseen), marks)
    scored = cotrain.score(docs, marks, views).join(labels.filter(unseen), "doc_id").collect()
    good = [r["score"] for r in scored if r["quality"] == 1]
    bad = [r["score"] for r in scored if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
