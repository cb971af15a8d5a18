"""Spelling variants, token alignment and line deduplication against their plain versions."""

import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tests.llm import brute
from tests.llm.test_operators import SMALL, frame, rows, same  # noqa: F401  rows is a fixture
from tokenizers import Tokenizer

from quillspark.llm.align import Aligner, align_tokens, integer_groups, packed_groups
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.spelling import anagram_key, near_words, roots, spelling_variants

VARIANTS = ["word", "form", "root", "n", "n_near", "form_n"]
ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
LINES = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_spelling(spark, rows):  # noqa: F811
    same(spelling_variants(frame(spark, rows)), VARIANTS, brute.spelling_variants(rows))


def test_spelling_edits(spark):
    rng = random.Random(3)
    texts = []
    for stem in ("abcdefg", "aaaaaaaa", "ÉÀçèßÿ÷×q", "translation", "abcdabcdab"):
        for i in range(len(stem)):
            c = rng.choice("aéz")
            texts += [stem] * rng.choice([3, 30, 300]) + [stem[:i] + stem[i + 1 :]] * 2 + [stem[:i] + c + stem[i:]] * rng.choice([2, 20]) + [stem[:i] + c + stem[i + 1 :]] * 3
            swapped = list(stem)
            rng.shuffle(swapped)
            texts += ["".join(swapped)] * 2
    rows = [(i % 50, " ".join(texts[i : i + 40])) for i in range(0, len(texts), 40)] + [(1, "y" * 30_000 + " " + "y" * 29_999)] * 2  # noqa: F841
    got = brute.spelling_variants(rows)
    assert any(r[1] and r[1] != r[2] for r in got) or len(got) > 100
    same(spelling_variants(frame(spark, rows)), VARIANTS, got)


def test_spelling_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(17)] + [("x", "w3"), ("y", "z")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w17" for i in range(17)}, "x": "w17", "y": "z"}


def test_anagram_keys(spark):
    words = ["stalene", "staleen", "stalen", "stolene", "ÿÿÿÿÿÿÿ"]
    frame_ = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    from pyspark.sql import functions as F

    keys = {r.word: r.key for r in frame_.select("word", anagram_key(F.split("word", "")).alias("key")).collect()}
    assert keys["stalene"] == keys["staleen"] == keys["stalen"] + 5**5 == keys["stolene"] - 15**5 + 1
    assert keys["ÿÿÿÿÿÿÿ"] == 7 * 90**5
    assert {(r.word, r.other) for r in near_words(frame_).collect()} == {(a, b) for a in words for b in words if a != b and {a, b} in ({"stalene", "stalen"}, {"stalene", "stolene"}, {"staleen", "stalen"})}


def test_alignment(spark, rows, tokenizers):  # noqa: F811
    same(align_tokens(frame(spark, rows)), ALIGNED, brute.align(rows, *tokenizers))


@pytest.mark.parametrize("limit", [0, 40])
def test_alignment_joined(spark, tokenizers, limit):
    """Pairs that aren't broadcast."""
    rows = [(i, text) for i, text in enumerate(["one two three", "two three", "three é ü one", "the end.\n\nThe end", "x  y\t z"] * 12)]
    same(align_tokens(frame(spark, rows), max_broadcast=limit), ALIGNED, brute.align(rows, *tokenizers))


def test_alignment_odd_texts(spark, tokenizers):
    texts = ["<|endoftext|> a </s><s>", "a ▁ b", "tab\tstop", " lead", "trail ", "\nlines\n\n", "  ", "日本語 emoji 😀😀", "\x00\x01", "a b", "é" * 300 + " " + "=" * 500, "𝔘𝔫𝔦" * 40, "don't we'll", "　wide line", "﻿mark"]
    rows = list(enumerate(texts))
    same(align_tokens(frame(spark, rows)), ALIGNED, brute.align(rows, *tokenizers))


def test_chunks_as_whole(spark):
    """Aligning by chunks gives what aligning whole texts gives."""
    aligner = Aligner()
    assert aligner.chunked
    for (text,) in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect():
        parts, whole = aligner.align(text), aligner.whole(text)
        assert [sum(p[i] for p in parts) for i in range(4)] == list(whole[:4])
        assert ";".join(p[4] for p in parts) == whole[4] and b"".join(p[5] for p in parts) == whole[5]


def test_bitsets():
    rng = random.Random(1)
    for size in (1, 5, 63, 64, 65, 1000):
        a, b = (sorted({*rng.sample(range(1, size + 1), rng.randrange(size + 1)), size}) for _ in range(2))
        wanted = [(sum(x <= cut for x in a), sum(x <= cut for x in b)) for cut in sorted(set(a) & set(b))]
        assert list(zip(*integer_groups(a, b), strict=True)) == wanted
        assert list(zip(*(r.tolist() for r in packed_groups(np.array(a), np.array(b))), strict=True)) == wanted


def test_lines(spark, rows):  # noqa: F811
    same(dedup_lines(frame(spark, rows)), LINES, brute.line_dedup(rows))


@pytest.mark.parametrize("limit", [1, 3, 1 << 19])
def test_lines_shared(spark, limit):
    rng = random.Random(2)
    shared = [f" Shared LINE {i} " for i in range(12)] + ["É é", "\x0bx\x0c"]
    rows = [(i, "\n".join([rng.choice(shared).upper() if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randrange(200))] + [f"own {i}", "", " \t"])) for i in range(60)]
    rows += [(7, "shared line 1\n" * 300), (None, "Shared line 2"), (None, "Shared line 2"), (None, None), (61, ""), (61, ""), (62, "\n")] + [(70 + i, "in nine\nonly") for i in range(9)] + [(70, "in nine")] * 3
    same(dedup_lines(frame(spark, rows), max_broadcast=limit), LINES, brute.line_dedup(rows))


def test_line_bitmaps(spark):
    """A word for each 64 lines that lose one; the text follows from it."""
    text = "\n".join(f"all {i}" if i in (0, 63, 64, 200) else f"{{}} {i}" for i in range(300))
    rows = [(i, text.replace("{}", str(i))) for i in range(10)]
    for r in dedup_lines(frame(spark, rows)).collect():
        gone = {64 * word + b for word, bits in r.keep for b in range(64) if not bits >> b & 1}
        assert gone == {0, 63, 64, 200} and [w for w, _ in r.keep] == [0, 1, 3] and r.n_dropped == 4
        assert r.kept == "\n".join(x for i, x in enumerate(text.replace("{}", str(r.doc_id)).split("\n")) if i not in gone)
