"""Operators 5, 7 and 9 against the tokenizers library."""

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import bpe, queries, token_counts, token_files
from tandem.llm.queries import tokenizer_path
from tandem.llm.shared import local_text, shared_dir


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(local_text(tokenizer_path()))


def encode(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["the", " ", "  ", "\n", "'s", "é", "<|endoftext|>", "12", "!?", "\u3000", "\x1c"]), max_size=12).map("".join))
def test_codec_equals_library(codec, tokenizer, text):
    ids = encode(tokenizer, text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_decode_of_broken_bytes(codec, tokenizer):
    for ids in ([220, 128, 200, 50256], [*range(100, 256)]):
        assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_long_pre_token(codec, tokenizer):
    text = "abcdefghij" * 20_000
    assert codec.encode(text) == encode(tokenizer, text)


def test_digests(docs, tokenizer):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, tokenizer_path()).collect())
    want = []
    for r in docs.collect():
        ids = encode(tokenizer, r.text)
        want.append((r.doc_id or -1, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(docs.limit(0), tokenizer_path()).count() == 0


def test_encode_then_decode(docs):
    ids = bpe.encode(docs, tokenizer_path(), keep=("doc_id", "size"))
    back = bpe.decode(ids, tokenizer_path())
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text or "") for r in docs.collect()}
    both = bpe.encode_decode(docs, tokenizer_path(), decoded="back")
    assert {r.back for r in both.collect()} == {r.text or "" for r in docs.collect()}


def test_counts(docs, tokenizer):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, tokenizer_path(), batch_bytes=1000).collect())
    assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), len(encode(tokenizer, r.text))) for r in docs.collect())
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path()).count() == 0


def test_counts_of_other_kinds(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for name, count in (("piece_bpe_32k.model", lambda t: len(model.encode(t))), ("word_bpe_49k.json", lambda t: len(words.encode(t, add_special_tokens=False)))):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tokenizer_path(name)).collect()}
        assert got == {i: count(t) for i, t in texts.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "\n", "word's", "é", "<|endoftext|>", "\t"]), max_size=40).map("".join), st.integers(1, 12))
def test_safe_splits_add_up(tokenizer, text, size):
    pieces = token_counts.parts(text, size)
    assert "".join(pieces) == text
    assert sum(len(encode(tokenizer, p)) for p in pieces) == len(encode(tokenizer, text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the", " ", " ", "  ", "\n", "word's", "é", "<|endoftext|>", "\t", "12", " a", "\x85"]), max_size=20).map("".join), max_size=5))
def test_library_encoder(tokenizer, texts):
    encoder = token_files._encoder(local_text(tokenizer_path()))
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [encode(tokenizer, t) for t in texts]


def test_files(spark, docs, tokenizer):
    folder = shared_dir(spark, "t")
    manifest = token_files.write_token_files(docs, tokenizer_path(), folder, length=16)
    got = [tuple(r) for r in token_files.read_token_files(manifest, folder).orderBy("start").collect()]
    rows = sorted(((r.doc_id, [*encode(tokenizer, r.text), 2]) for r in docs.collect()), key=lambda x: -1 if x[0] is None else x[0])
    want, start = [], 0
    for i, ids in rows:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    shard = manifest.first()
    with __import__("pyarrow").memory_map(shard.ids_path) as f:
        table = __import__("pyarrow").ipc.open_stream(f).read_all()
    assert str(table.schema.field("ids").type) == "fixed_size_list<item: uint16>[16]" and len(table) == -(-shard.n_tokens // 16)
    assert sum(x for row in table["mask"].to_pylist() for x in row) == shard.n_tokens
    assert token_files.round_trip(docs.limit(0), tokenizer_path()).count() == 0


def test_rows_of_a_shard(spark, tokenizer):
    """Blocks are even but for the last, and row i is a view of the file."""
    texts = [f"{i} " + "some words of a text " * (i % 90) for i in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    manifest = token_files.write_token_files(df, tokenizer_path(), shared_dir(spark, "t"), length=8)
    n_short = 0
    for shard in manifest.collect():
        with pa.memory_map(shard.ids_path) as f:
            blocks = list(pa.ipc.open_stream(f))
            assert all(b.num_rows == token_files.BLOCK_ROWS for b in blocks[:-1])
            rows = token_files.Shard(shard.ids_path)
            flat = np.concatenate([b.column(0).flatten().to_numpy() for b in blocks])
            n = sum(b.num_rows for b in blocks)
            for i in {0, 1, n // 2, n - 2, n - 1, *range(0, n, 97)} & {*range(n)}:
                ids, mask = rows.row(i)
                assert ids.tolist() == flat[8 * i : 8 * i + 8].tolist() and sum(mask.to_pylist()) == min(8, shard.n_tokens - 8 * i) and not ids.flags.owndata
            n_short += len(blocks) > 1
    assert n_short


def test_batches_are_balanced_by_bytes(tokenizer):
    text = "\u65e5\u672c\u8a9e " * 4000
    pieces = token_counts.parts(text, max(1, 1000 * len(text) // len(text.encode())))
    assert max(len(p.encode()) for p in pieces) < 1100 and "".join(pieces) == text
    assert sum(len(encode(tokenizer, p)) for p in pieces) == len(encode(tokenizer, text))


@pytest.mark.parametrize("name", ["op5_bpe_codec", "op7_token_files", "op9_token_counts"])
def test_registered_queries_equal_the_library(spark, sf_dir, tokenizer, name):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got, start = {r.doc_id: r for r in queries.queries()[name](spark, sf_dir).collect()}, 0
    assert sorted(got) == sorted(texts)
    for i, text in sorted(texts.items()):
        ids, r = encode(tokenizer, text), got[i]
        if name == "op5_bpe_codec":
            assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        elif name == "op9_token_counts":
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), len(ids), len(ids) > 1024)
        else:
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
            start += len(ids) + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the", " ", "  ", "\n", "\r\n", "word's", "é", "<|endoftext|>", "\t", "12", "　", "\x1c", "\x85", "\x0b", "!?"]), max_size=12).map("".join), max_size=5))
def test_remembered_counts_equal_library(tokenizer, texts):
    counts = token_counts.remembering(lambda pieces: [len(encode(tokenizer, p)) for p in pieces])
    for _ in range(2):  # the second time from memory
        assert counts(texts) == [len(encode(tokenizer, t)) for t in texts]


def test_counts_ask_for_each_piece_once(tokenizer, monkeypatch):
    asked = []
    counts = token_counts.remembering(lambda pieces: asked.extend(pieces) or [len(encode(tokenizer, p)) for p in pieces])
    text = "some words\n\nof a text, some words again\n" + "x" * 50
    want = len(encode(tokenizer, text))
    assert counts([text] * 3) == [want] * 3 and counts([text]) == [want]
    assert asked.count(" words") == 1 and asked.count("\n" + "x" * 50) == 2  # long pieces aren't kept
    monkeypatch.setattr(token_counts, "REMEMBER", 8)  # all are forgotten that aren't asked for
    words = [f"w{i} v{i}" for i in range(50)]
    assert [counts([w])[0] for w in words * 2] == [len(encode(tokenizer, w)) for w in words * 2]


def test_codec_remembers_the_words_of_a_large_table(codec, monkeypatch):
    """300,000 distinct words, about those of a tenth of a gigabyte, are merged once."""
    words = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(300_000))
    ids, merged = codec.encode(words), []
    monkeypatch.setattr(codec, "merge", lambda data: merged.append(data))
    assert codec.encode(words) == ids and not merged
