"""Encoders of whole steps: equal to the library on awkward texts, what they keep and what stages after them hold."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from claimweave.llm import recompress, tokens

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    *("a", "S", "ab", "'", "'s", "'T", "'ll", "''", "don't", "l'été", "É", "ß", "ÿ", "×", "İ", "ſ", "ɏ", "ɐ", "ж", "日本", "🙂", "K"),
    *(" ", "  ", "\n", "\t", " \n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "́", "ͅ", "̸", "़"),
    *("1", "23", "!", "?!", "_", "’", "…", "\x00", "<|", "<", "|", "<|endoftext|>"),
]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_columns_of_awkward_texts_match_the_library(path):
    rng = random.Random(5)
    library, encoder = Tokenizer.from_file(path), tokens.Encoder(path, cache_units=300)
    for turn in range(60):
        parts = rng.sample(PARTS, rng.choice([4, 8, 20, len(PARTS)])) if turn % 2 else [p for p in PARTS if p.isascii() and "|" not in p]
        texts = [None, "", *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(40))]
        want = [library.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
        ids, ends = encoder.encode_column(pa.array(["cut off", *texts]).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
        assert encoder.encode(texts) == [np.array(x, "<u4").tobytes() for x in want]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_units_in_use_are_learned_once(path):
    encoder = tokens.Encoder(path, cache_units=200)
    learned = []
    learn = encoder._learn
    encoder._learn = lambda missing: (learned.extend(missing), learn(missing))
    for turn in range(40):
        encoder.encode([" ".join("abcdefghij"[int(c)] * 3 for c in f"{turn * 20 + i:04}") for i in range(20)])
        if turn % 2 == 0:
            encoder.encode([" frequent"])
        assert len(encoder.cache) + len(encoder.older) <= 200
    assert sum(unit.strip() == b"frequent" for unit in learned) == 1


def test_latin_words_and_their_marks_are_units_of_their_own():
    units = tokens.Encoder(WORDS)
    units.encode(["été... (été) été!? «été»"])
    assert "été".encode() in units.cache and "été...".encode() not in units.cache
    spaced = tokens.Encoder(BYTES)
    spaced.encode(["x été... été!?"])
    assert " été".encode() in spaced.cache and " été...".encode() not in spaced.cache


def test_stages_that_encode_nothing_let_go_of_encoders(spark, monkeypatch):
    functions = []
    docs = spark.createDataFrame([(i, "some words of a text " * 20) for i in range(3)], "doc_id bigint, text string")
    plain = type(docs).mapInArrow
    spy = lambda self, f, *a, **b: (functions.append(f), plain(self, f, *a, **b))[1]
    monkeypatch.setattr(type(docs), "mapInArrow", spy)
    recompress.remove_repeats(docs)
    own = [f for f in functions if f.__name__ in ("anchors", "candidates", "remove")]
    assert len(own) == 3
    for function in own:
        tokens.encoder(WORDS)
        assert list(function(iter([]))) == [] and not tokens._ENCODERS


def test_an_encoder_keeps_the_units_its_caller_wants():
    path = public_tokenizers.path("word_bpe_49k.json")
    few = tokens.encoder(path, 8)
    texts = [" ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(9)) for i in range(9)]
    small = [few.encode([text])[0] for text in texts]
    assert len(few.cache) + len(few.older) < 30
    many = tokens.encoder(path, 1000)
    assert many is few and many.encode(texts) == small
    assert len(many.cache) + len(many.older) > 80
    assert tokens.encoder(path).cache_units == tokens.CACHE_UNITS
    tokens.release_encoders()
