"""Token counts, the SentencePiece round trip and id shards against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tectra.llm import common, id_shards, pieces, queries, token_counts
from tests.conftest import DATA
from tests.llm.conftest import ordered, random_texts, tuples

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def piece_bpe():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def both(odd, spark):
    return [odd, common.table(spark, SF, "documents")]


def count_rows(df, tok):
    texts = [(i, t or "") for i, t in df.select("doc_id", "text").collect()]
    return ordered((i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in texts)


def test_counts(spark, odd, word_bpe):
    for df in both(odd, spark):
        assert tuples(token_counts.token_counts(df), "doc_id", "n_bytes", "n_tokens", "over_limit") == count_rows(df, word_bpe)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_count_of_any_text(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = test_count_of_any_text.__dict__.setdefault("tok", Tokenizer.from_file(path))
    words = token_counts.counter(path)
    assert sum(map(words.__getitem__, text.encode().split())) == len(tok.encode(text, add_special_tokens=False).ids)


def test_counts_when_the_table_is_full(monkeypatch, word_bpe):
    monkeypatch.setattr(common, "TABLE_ENTRIES", 5)
    words = token_counts.WordCounter(public_tokenizers.path("word_bpe_49k.json"))
    for text in random_texts(60, 3):
        assert sum(map(words.__getitem__, text.encode().split())) == len(word_bpe.encode(text, add_special_tokens=False).ids)
    assert len(words) <= 5


def piece_rows(df, model):
    out = []
    for i, t in df.select("doc_id", "text").collect():
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    return ordered(out)


def test_pieces(spark, odd, piece_bpe):
    for df in both(odd, spark):
        assert tuples(pieces.piece_digests(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == piece_rows(df, piece_bpe)


def test_pieces_themselves(odd, piece_bpe):
    for r in pieces.encode_pieces(odd.filter("doc_id > 18")).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == piece_bpe.encode(r.text, add_bos=True, add_eos=True) and r.decoded == piece_bpe.decode(r.ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_pieces_of_any_text(text):
    table = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    (raw,), (back,) = table.encode_batch([text])
    ids = table.model.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(raw, "<u4").tolist() == ids and back == table.model.decode(ids)


def test_pieces_when_the_table_is_full(monkeypatch, piece_bpe):
    monkeypatch.setattr(pieces, "_KEPT", 5)
    table = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = random_texts(60, 4)
    raw, back = table.encode_batch(texts)
    for text, x, y in zip(texts, raw, back):
        assert np.frombuffer(x, "<u4").tolist() == piece_bpe.encode(text, add_bos=True, add_eos=True) and y == piece_bpe.decode(piece_bpe.encode(text))


def shard_rows(df, tok, end=2):
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, end] for _, t in rows]
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    return [(r[0], s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(rows, starts, ids)]


def test_shards(spark, byte_bpe):
    docs = common.table(spark, SF, "documents")
    assert tuples(queries.op10_id_shards(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == ordered(shard_rows(docs, byte_bpe))


def test_shards_of_odd_rows(spark, odd, byte_bpe):
    """Rows of one id are in the order of their hashes, so only ids of one row have a known start."""
    shards = id_shards.write_id_shards(odd, common.scratch_dir(spark), shard_bytes=3000)
    got = tuples(id_shards.shard_documents(shards), "doc_id", "n_tokens", "ids_crc32")
    want = shard_rows(odd, byte_bpe)
    assert got == ordered((i, n, c) for i, _, n, c in want)
    spans = tuples(id_shards.shard_documents(shards), "start", "n_tokens")
    assert [s for s, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
    assert shards.count() > 3 and all(r.n_docs == 1 or r.n_ids * r.width <= 3000 for r in shards.collect())
    for i, text in odd.filter("doc_id > 18").limit(12).select("doc_id", "text").collect():
        assert id_shards.get_ids(shards, i) == [*byte_bpe.encode(text, add_special_tokens=False).ids, 2]
    assert id_shards.get_ids(shards, 10**9) is None and id_shards.get_ids(shards, -5) is None
    without = [[*byte_bpe.encode(r.text or "", add_special_tokens=False).ids, 2] for r in odd.filter("doc_id is null").collect()]
    assert id_shards.get_ids(shards, None) in without


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_ids_of_any_texts(texts):
    import pyarrow as pa

    table = id_shards.ids_table(public_tokenizers.path("byte_bpe_50k.json"))
    for text, raw in zip(texts, table.encode_batch(pa.array(texts, pa.string()))):
        assert np.frombuffer(raw, table.dtype).tolist() == table.tok.encode(text, add_special_tokens=False).ids


def test_ids_when_the_table_is_full(monkeypatch, byte_bpe):
    import pyarrow as pa

    monkeypatch.setattr(common, "TABLE_ENTRIES", 20)
    table = id_shards.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(3):
        texts = [*random_texts(30, 5), "plain words again, plain words!", "first line\nsecond line\nfirst line"]
        for text, raw in zip(texts, table.encode_batch(pa.array(texts, pa.string()))):
            assert np.frombuffer(raw, table.dtype).tolist() == byte_bpe.encode(text, add_special_tokens=False).ids


def test_empty_tables(spark, empty):
    assert token_counts.token_counts(empty).count() == pieces.piece_digests(empty).count() == pieces.encode_pieces(empty).count() == 0
    shards = id_shards.write_id_shards(empty, common.scratch_dir(spark))
    assert shards.count() == id_shards.shard_documents(shards).count() == 0
    assert id_shards.get_ids(shards, 1) is None
