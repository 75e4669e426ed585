"""Line deduplication and token alignment against plain loops over awkward rows."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from claimweave.llm import alignment, line_dedup

SCHEMA = "doc_id bigint, text string, h1 string, position int, step int, pair string, n int, key string, dropped string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3, "z", "w") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def plain_lines(texts, least_docs, least_chars=1):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    found = collections.Counter(k for t in texts for k in {key(line) for line in (t or "").split("\n")})
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not (len(key(line)) >= least_chars and found[key(line)] >= least_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_texts():
    rng = np.random.default_rng(3)
    shared = ["  Common LINE\t", "common line", "Ünder ÄÖ", "ünder äö", " edge ", "edge", "\x0bcontrol\x0c", "a\rb", ""]
    texts = ["\n".join(rng.choice([*shared, f"own {i}", f"other {i}"], rng.integers(1, 12))) for i in range(60)]
    return [*texts, None, "", "\n", "\n\n", "common line", "common line", " " * 5, "x\n" * 3000 + "common line"]


def test_line_dedup_equals_a_loop(spark):
    texts = line_texts()
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    for least_docs, least_chars in ((10, 1), (3, 5), (1, 1), (1000, 1)):
        got = line_dedup.drop_frequent_lines(frame(spark, texts, ids), least_docs, least_chars).collect()
        want = plain_lines(texts, least_docs, least_chars)
        assert sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in got))) == sorted(
            map(str, ((i, t or "", *w) for i, t, w in zip(ids, texts, want, strict=True)))
        )


def test_line_dedup_counts_a_document_once_and_repeated_rows_apart(spark):
    once = frame(spark, ["same\nsame\nsame"] * 9)
    assert {r.n_dropped for r in line_dedup.drop_frequent_lines(once).collect()} == {0}
    rows = line_dedup.drop_frequent_lines(frame(spark, ["same\nown"] * 10, [1] * 10)).collect()
    assert [(r.n_dropped, r.kept_text) for r in rows] == [(2, "")] * 10
    assert line_dedup.drop_frequent_lines(frame(spark, [])).collect() == []


def test_line_dedup_uses_no_python_and_shuffles_no_line(spark):
    plan = line_dedup.drop_frequent_lines(frame(spark, ["a\nb"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.PairEncoder(A, B)


def plain_tokens(models, text):
    a, b, encoder = models
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spell = lambda table, i: table.letters[table.begin[i] : table.begin[i] + table.lens[i]].tobytes()
    lens_a, lens_b = [spell(encoder.a_spelled, i) for i in ids_a], [spell(encoder.b_spelled, i) for i in ids_b]
    raw = b" " + text.encode()
    if b"".join(lens_a) != raw or b"".join(lens_b) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in lens_a]).tolist(), np.cumsum([len(x) for x in lens_b]).tolist()
    return ids_a, ends_a, ids_b, ends_b


def plain_alignment(models, texts):
    """Links by comparing byte ranges, groups by shared ends."""
    found, counts = [], collections.Counter()
    for text in texts:
        tokens = plain_tokens(models, text)
        links, groups = [], []
        if tokens:
            ids_a, ends_a, ids_b, ends_b = tokens
            starts_a, starts_b = [0, *ends_a], [0, *ends_b]
            j = 0
            for i, a in enumerate(ids_a):
                while ends_b[j] <= starts_a[i]:
                    j += 1
                k = j
                while k < len(ids_b) and starts_b[k] < ends_a[i]:
                    links.append((a, ids_b[k]))
                    k += 1
            shared = sorted(set(ends_a) & set(ends_b))
            low = 0
            for end in shared:
                inside = lambda ids, ends: [str(x) for x, e in zip(ids, ends, strict=True) if low < e <= end]  # noqa: E731, B023
                groups.append(f"{','.join(inside(ids_a, ends_a))}|{','.join(inside(ids_b, ends_b))}")
                low = end
        counts.update(links)
        found.append((tokens, links, groups))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for tokens, links, groups in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if tokens else ""
        n_a, n_b = (len(tokens[0]), len(tokens[2])) if tokens else (0, 0)
        best = sum(counts[x] == most[x[1]] for x in links)
        yield n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), digest


def token_texts():
    rng = np.random.default_rng(5)
    parts = ["hello", " world", "  two", "\n", "\t", "é", "日本", "🙂", "<|endoftext|>", "<s>", "<0x0A>", "　", "  ", "  ", "x" * 30, "don't", "12,345", "\r\n", ");\r\n ", "\r", ".", "\x00", "ａ"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(80)]
    return [*texts, None, "", " ", "     ", "x ", "x    ", "\n", "a ▁ b", "▁", "word " * 3000, " lead", "trail　 ", "same text", "same text"]


def test_alignment_equals_ranges(spark, models):
    texts = token_texts()
    ids = [None if i % 11 == 0 else i // 2 for i in range(len(texts))]
    want = sorted(map(str, ((i, *w) for i, w in zip(ids, plain_alignment(models, texts), strict=True))))
    for piece_ends in (1, 7, 1 << 17):
        got = alignment.align(frame(spark, texts, ids).repartition(3), A, B, piece_ends=piece_ends).collect()
        assert sorted(map(str, map(tuple, got))) == want, piece_ends
    assert alignment.align(frame(spark, []), A, B).collect() == []


def test_segments_and_steps_do_not_change_tokens(spark, models, monkeypatch):
    text = " ".join(t for t in token_texts() if t and "▁" not in t)
    whole = plain_tokens(models, text)
    monkeypatch.setattr(alignment, "SEGMENT_BYTES", 50)
    encoder = alignment.PairEncoder(A, B)
    assert encoder.cuts
    (parts,) = encoder.encode([text])
    assert len(parts) > 10
    assert np.concatenate([p.a_ids for p in parts]).tolist() == whole[0]
    assert np.concatenate([p.b_ids for p in parts]).tolist() == whole[2]
    monkeypatch.setattr(alignment, "STEP_BYTES", 60)
    step = alignment._Step(0, 5)
    rows = [*step.add(1, text, parts), *step.close()]
    assert sum(r["n_a"] for r in rows[:-1]) == len(whole[0]) and rows[-1]["docs"][0]["n_bytes"] == len(text.encode()) + 1


def test_merge_path_pieces_are_equal_and_complete():
    rng = np.random.default_rng(8)
    ends_a = np.unique(rng.integers(1, 5000, 900))
    ends_b = np.unique(rng.integers(1, 5000, 1200))
    merged = sorted([(e, 0) for e in ends_a] + [(e, 1) for e in ends_b])
    diagonals = np.arange(len(merged) + 1)
    assert alignment.crossings(ends_a, ends_b, diagonals).tolist() == [0, *np.cumsum([side == 0 for _, side in merged])]


def test_overlaps_follow_from_one_search_and_names_are_gathered_at_once():
    rng = np.random.default_rng(3)
    a_lens, b_lens = (rng.multinomial(1300 - n, np.ones(n) / n) + 1 for n in (300, 400))  # both cover 1300 bytes
    ends_a, ends_b = np.cumsum(a_lens), np.cumsum(b_lens)
    expected = {(i, j) for i in range(300) for j in range(400) if max(ends_a[i] - a_lens[i], ends_b[j] - b_lens[j]) < min(ends_a[i], ends_b[j])}
    found, shared = set(), 0
    for piece in alignment.pieces(np.arange(300), a_lens, np.arange(400), b_lens, 0, 64):
        ends = piece.shared()
        shared += int(ends[0].sum())
        at_a, at_b, _ = piece.overlaps(*ends)
        pairs = list(zip(piece.a_ids[at_a].tolist(), piece.b_ids[at_b].tolist(), strict=True))
        assert not found & set(pairs) and len(set(pairs)) == len(pairs)
        found |= set(pairs)
    assert found == expected
    assert shared == len(np.intersect1d(ends_a, ends_b))
    codes = np.array([0, 1, 2, 5, 3 * 1234 + 1, 3 * 9])
    assert b"".join(alignment._names(int(codes.max())).take(pa.array(codes)).to_pylist()) == b"0,0|0;1;1234|9,"
