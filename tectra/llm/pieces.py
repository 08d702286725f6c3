"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the model crosses a white-space marker or a line feed, so a text falls apart before each run of
markers and each line feed. Each distinct chunk is segmented once, and a text's ids are its chunks' ids in order.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

_MARK = "▁"
_CHUNKS = re.compile(f"\n[^ \n{_MARK}]*|[ {_MARK}]+[^ \n{_MARK}]*")
#: Most chunks that a worker's table keeps (some 300 bytes each); at the bound the table starts anew.
_KEPT = 300_000
#: New chunks that are segmented in one call.
_TOGETHER = 500


class Pieces:
    """A worker's table: chunk -> (ids as little-endian unsigned 32-bit integers, decoded text)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in names):
            raise ValueError("a piece of this model crosses chunks")
        self.names = [p.replace(_MARK, " ") for p in names]
        self.odd = {i for i in range(len(names)) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i)}
        self.starts = np.array([p.startswith(_MARK) for p in names])
        self.begin, self.end, self.mark = m.bos_id(), m.eos_id(), m.piece_to_id(_MARK)
        self.before = next(i for i in range(len(names)) if i not in self.odd and len(names[i]) == 1 and names[i] != _MARK)
        self.known: dict[str, tuple[bytes, str]] = {}

    def learn(self, chunks: list[str]) -> None:
        """Segments new chunks: many of one marker and a word in one call, which fall apart where a piece begins with a marker."""
        words = [c for c in chunks if len(c) > 1 and c[0] != "\n" and c[1] not in " " + _MARK]
        for k in range(0, len(words), _TOGETHER):
            some = words[k : k + _TOGETHER]
            ids = np.array(self.model.encode("".join(some)[1:], num_threads=1), "<u4")
            at = np.flatnonzero(self.starts[ids]).tolist()
            for c, i, j in zip(some, at, [*at[1:], len(ids)], strict=True):
                self.known[c] = ids[i:j].tobytes(), self.decoded(ids[i:j].tolist())
        for c in chunks:
            if c not in self.known:  # the library puts a marker in front, so a run's first marker is left to it
                ids = self.model.encode(c, num_threads=1)[1:] if c[0] == "\n" else self.model.encode(c[1:], num_threads=1) if len(c) > 1 else [self.mark]
                self.known[c] = np.array(ids, "<u4").tobytes(), self.decoded(ids)

    def decoded(self, ids: list[int]) -> str:
        if self.odd.isdisjoint(ids):
            return "".join(map(self.names.__getitem__, ids))
        return self.model.decode([self.before, *ids])[1:]

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids of each text between begin and end, and what they decode to."""
        raw, back = [], []
        first, last = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        for text in texts:
            chunks = _CHUNKS.findall(" " + text) if text else []
            if new := [c for c in set(chunks) if c not in self.known]:
                self.learn(new)
            found = list(map(self.known.__getitem__, chunks))
            raw.append(b"".join([first, *[x for x, _ in found], last]))
            back.append("".join([x for _, x in found])[1:])
            if len(self.known) > _KEPT:
                self.known.clear()
        return raw, back


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_pieces(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int, with begin and end), decoded (text).

    Null and empty texts give begin and end alone and decode to "". Repeated rows give repeated rows, a null id
    stays null, an empty table gives an empty one, other columns are ignored. Whole texts; no shuffle.
    """
    path = common.vocabulary_path(vocabulary)

    def make():
        table = pieces(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, back = table.encode_batch(common.texts(batch))
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in raw]
            return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

        return f

    return common.map_batches(common.keyed(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode_pieces`, with digests in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = common.vocabulary_path(vocabulary)

    def make():
        table = pieces(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, back = table.encode_batch(common.texts(batch))
            return pa.record_batch([batch.column("doc_id"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return f

    return common.map_batches(common.keyed(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
