import base64
import os
import random

import numpy as np
import pytest
import tiktoken

from tidegauge.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabularies")


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load_vocabulary()


@pytest.fixture(scope="module")
def reference():
    with open(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(vocabulary, reference):
    random.seed(3)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "漢字", "😀", "<|endoftext|>", "'s", "'LL", "1", "²", "_", "-", "​", "ß"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 50))) for _ in range(400)]
    texts += ["a" * 700, "ab" * 600 + "c", "漢字" * 400, " " * 900, "the" * 3000, "-=" * 2000, "", None]
    offsets, ids = tokens.Encoder(vocabulary).encode(texts)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == (reference.encode_ordinary(t) if t else [])


def test_long_pieces_as_short_ones(vocabulary):
    for piece in (b"abcabcabcabc" * 8, b"aaaaaaaaaaaaa", bytes(range(200, 256)) * 3, b"x"):
        assert np.array_equal(tokens.merge_long(vocabulary, piece), tokens.merge_rows(vocabulary, [piece])[0])


def test_rows_of_a_frame(spark, vocabulary):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "Hello world", "x"), (1, "Hello world", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode_texts(frame, "doc_id", "text", vocabulary, batch_chars=5)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got.collect()) == [(0, [15496, 995]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert tokens.encode_texts(frame.limit(0), "doc_id", "text", vocabulary).count() == 0
