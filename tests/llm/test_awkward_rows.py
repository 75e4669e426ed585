"""Null ids, repeated ids with different texts, ids beyond doubles and clashing columns."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from claimweave.llm import imatch, language, probminhash


def prose(seed, count):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ré", "St", "une"], rng.integers(1, 4))) for _ in range(count))


def test_near_copies_without_ids_and_texts_under_one_id(spark):
    text = prose(1, 200)
    rows = [(5, text), (None, text + " end"), (None, "so " + text), (7, prose(2, 80)), (7, prose(3, 80)), (7, prose(3, 80))]
    rows += [(None, prose(4, 90)), (None, prose(4, 90)), (None, ""), (None, ""), (9, " \n"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    classes = probminhash.near_duplicates(docs)
    got = [(r.doc_id, r.class_id, r.class_size) for r in classes.collect()]
    assert sorted(c for d, c, n in got if n == 3) == [5, 5, 5]
    assert len({r.class_key for r in classes.collect()}) == 8
    assert [c < 0 for d, c, n in got if d is None and n == 2] == [True, True]
    kept = [(r.doc_id, r.text) for r in probminhash.keep_one(docs, classes).collect()]
    want = [rows[0], rows[3], rows[4], rows[6], *rows[8:]]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_stages_keep_columns_of_any_name(spark):
    names = ["_rows", "_head", "_size", "_taken", "_positions", "_row", "__row", "__keep_id", "t1", "k1", "_copy", "_hash", "_id", "_places"]
    rows = [(i, prose(10 + i, 70), "en", "a", 1, *[f"{n}{i}" for n in names]) for i in range(8)]
    rows.append((8, rows[0][1] + " more", "en", "a", 1, *[f"{n}8" for n in names]))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
        if name == "near_dedup":
            assert sorted(r.doc_id for r in out.collect()) == list(range(8))


def test_next_document_of_ids_beyond_doubles(spark):
    first = 1 << 60
    rows = [(first + 3 * i, prose(50 + i, 5 + i % 9)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.edited_sha256 for r in imatch.fingerprints(docs).collect()}
    for (doc_id, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got[doc_id] == hashlib.sha256(edited.encode()).hexdigest()


def test_every_language_is_learned_where_ids_are_missing(spark):
    words = {"en": ["the", "and", "with", "house"], "fr": ["le", "et", "avec", "maison"]}
    rng = np.random.default_rng(6)
    rows = [(None if lang == "en" else i, " ".join(rng.choice(words[lang], 12)), lang) for i in range(400) for lang in words]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.predict(docs, language.fit(docs, sample=200)).join(docs, ["doc_id"], "left")
    assert {r.lang_pred for r in found.select("lang_pred").distinct().collect()} == {"en", "fr"}
    english = language.predict(docs.filter(F.col("lang") == "en"), language.fit(docs, sample=200))
    assert {r.lang_pred for r in english.select("lang_pred").distinct().collect()} == {"en"}
