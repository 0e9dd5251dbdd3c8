from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from homologrid.llm.bpe import RANKS, decoded, digests, encoded, encoder

PATH = public_tokenizers.path(RANKS)
PIECES = ["'", "'s", "'re", "'ll", "'l", "'v", "'ve", "'d", "r", "e", "l", "s", " ", "  ", "\n", "\t", " ",
          "　", "\x1c", "\x85", "a", "Word", "é", "日本", "12", "½", "Ⅷ", "!", "...", "\U0001f600", "́", "x" * 30, "١"]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, reference):
    own = encoder(PATH)
    raw = [t.encode() for t in texts]
    ids, counts, offsets = own.encode(raw)
    at = 0
    for text, data, count in zip(texts, raw, counts.tolist()):
        mine = ids[at : at + count]
        assert mine.tolist() == reference.encode_ordinary(text), repr(text[:200])
        assert own.decode(mine) == data
        assert [data[o : o + own.sizes[i]] for o, i in zip(offsets[at : at + count], mine)] == [
            own.ranks.bytes[i] for i in mine
        ]
        at += count
    assert at == len(ids)


def test_joined_pieces(reference):
    rng = random.Random(0)
    check(["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(4000)], reference)
    check(["", "", "a", ""], reference)
    check([""], reference)


def test_every_code_point(reference):
    points = [*range(0xD800), *range(0xE000, 0x110000)][::7]
    check(["".join(f"a{chr(c)}1 {chr(c)}" for c in points[i : i + 500]) for i in range(0, len(points), 500)], reference)


def test_long_slices(reference):
    rng = random.Random(1)
    check(["".join(rng.choices("abcdetr", k=30_000)), "z" * 5_000, " " * 3_000 + "!" * 1000, "ab" * 64 + "a"], reference)


def test_rows(spark, reference):
    rows = [(1, "It's  we'll\n\n go"), (1, "It's  we'll\n\n go"), (None, None), (3, ""), (4, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = digests(docs).collect()
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    coded = encoded(docs, into=("codes", "starts"))
    assert coded.columns == [*docs.columns, "codes", "starts"]
    back = decoded(coded, "codes").collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for _, t in rows]
    assert digests(docs.limit(0)).count() == 0 and encoded(docs.limit(0), into=("c", "s")).count() == 0
