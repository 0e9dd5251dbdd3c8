from __future__ import annotations

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import BufferReader
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from homologrid.llm.chunks import ChunkEncoder
from homologrid.llm.common import documents
from homologrid.llm.token_files import (
    VOCABULARY,
    TokenFile,
    op2_token_files,
    pack,
    read_documents,
    tokens_at,
    write_tokens,
)
from homologrid.staging import StageArea

FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b", "é  b\n\n c", "日本 語　x y", "it's\n're", "x<|endoftext|>y <|endoftext|>", "end  \n ", "ñ a\x1c b\x85 c", "!\n!\t !"]


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return out


def test_chunks_make_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choices(["a", "É", " ", "\n", "'s", "!", "1", " ", "語"], k=30)) for _ in range(800)]
    found, counts = ChunkEncoder(public_tokenizers.path(VOCABULARY)).chunks([t.encode() for t in texts])
    at = 0
    for text, n in zip(texts, counts.tolist()):
        ids = np.frombuffer(b"".join(found[at : at + n]), np.uint32).tolist()
        at += n
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_whole_texts_with_every_distinct_chunk_encoded_once(tokenizer):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices(["a", "É", " ", "\n", "'s", "!", " word", "語", "<|endoftext|>", "<|endoftext|", "|>"], k=30)) for _ in range(500)]
    own = ChunkEncoder(public_tokenizers.path(VOCABULARY))
    asked, inner = [], own._encode
    own._encode = lambda chunks: asked.extend(chunks) or inner(chunks)
    for _ in range(2):
        ids, counts = own.ids([t.encode() for t in texts])
        ends = np.cumsum(counts)
        for text, a, b in zip(texts, ends - counts, ends):
            assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(asked) == len(set(asked))
    assert own.ids(["".encode()] * 2)[1].tolist() == [0, 0] and own.ids([])[1].tolist() == []


def test_any_token_and_any_range():
    rng = np.random.default_rng(0)
    for top in (1, 256, 50_257, 1 << 30):
        ids = rng.integers(0, top, 3_000).astype(np.uint32)
        file = TokenFile(BufferReader(pack(ids, [3, None, 9], np.array([0, 10, 2_000]))))
        assert file.tokens == 3_000 and file.directory()[0] == [3, None, 9]
        assert file.directory()[1].tolist() == [0, 10, 2_000]
        assert [file.token(i) for i in range(0, 3_000, 7)] == ids[::7].tolist()
        for first, n in ((0, 3_000), (511, 2), (512, 700), (2_999, 1), (77, 0)):
            assert file.range(first, n).tolist() == ids[first : first + n].tolist()


def expected(rows, tokenizer):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, tokenizer):
    rows = documents(spark, FOLDER).select("doc_id", "text").orderBy("doc_id").collect()
    got = [tuple(r) for r in op2_token_files(spark, FOLDER).collect()]
    assert sorted(got) == expected(rows, tokenizer)


def test_odd_rows_and_random_access(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20, None), (21, "long word " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    area = StageArea(spark, "test")
    place = f"{area.root}/tokens"
    manifest = area.write(write_tokens(docs.repartition(4), place, file_tokens=40), "manifest")
    got = sorted(tuple(r) for r in read_documents(manifest, place).collect())
    assert got == expected(rows, tokenizer)
    ids = [i for _, t in rows for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]]
    wanted = spark.range(0, len(ids) + 5, 3).withColumnRenamed("id", "position")
    found = dict(tokens_at(manifest, place, wanted).collect())
    assert found == {i: ids[i] for i in range(0, len(ids), 3)}
    repeated = spark.createDataFrame([(None, "a b"), (None, "c"), (5, "d"), (5, "d")], "doc_id long, text string")
    manifest = area.write(write_tokens(repeated, f"{place}2"), "manifest")
    got = read_documents(manifest, f"{place}2").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 5, 5]
    manifest = area.write(write_tokens(docs.limit(0), f"{place}3"), "manifest")
    assert read_documents(manifest, f"{place}3").count() == 0


def test_special_tokens_are_cut_as_the_library_does(tokenizer):
    end = "<|endoftext|>"
    texts = [f"x{end}y", end, end * 3, f" {end} \n{end}", f"a<|{end}|>b", "<|endof", "text|>", f"é{end}é", f"{end}'s 1"]
    own = ChunkEncoder(public_tokenizers.path(VOCABULARY))
    found, counts = own.chunks([t.encode() for t in texts])
    at = 0
    for text, n in zip(texts, counts.tolist()):
        ids = np.frombuffer(b"".join(found[at : at + n]), np.uint32).tolist()
        at += n
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert np.frombuffer(b"".join(found[: int(counts[0])]), np.uint32).tolist() == [87, 50256, 88]


def test_many_short_documents_take_linear_time(spark):
    def seconds(n):
        area = StageArea(spark, "test")
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).coalesce(1)
        began = time.monotonic()
        manifest = area.write(write_tokens(docs, f"{area.root}/tokens"), "manifest")
        assert sum(r.tokens for r in manifest.collect()) == n
        return time.monotonic() - began

    seconds(1000)
    # Four times the rows in far less than sixteen times the time.
    assert seconds(200_000) < 8 * seconds(50_000) + 2
