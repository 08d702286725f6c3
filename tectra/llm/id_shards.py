"""Token-id shards with keyed access.

A table of shards in ascending order of document id. One row is one shard:

| column | content |
|-|-|
| part, seq | the writing task and the shard's place in it; (part, seq) ascends with the ids |
| first_id, last_id | the least and greatest document id |
| n_docs, n_ids, part_start | documents, ids, and ids that the same part holds before this shard |
| width | bytes of an id: 2 or 4, little-endian and unsigned |
| keys | document ids in order, signed 64-bit; a null id is written as the least integer and flagged in nulls |
| index | minimal perfect hash over (document id, its occurrence within the shard) |
| prints, offsets, lengths | by index: fingerprint (unsigned 64-bit), first id and number of ids (unsigned 64-bit) |
| payload | raw ids |

The table is Parquet, so that any store that Spark can write keeps it and a task that is lost leaves no half shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .mph import PerfectHash, mix

SCHEMA = "part int, seq int, first_id long, last_id long, n_docs long, n_ids long, part_start long, width int, n_null long, keys binary, index binary, prints binary, offsets binary, lengths binary, payload binary"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
#: Bytes of payload after which a shard ends; a longer document has a shard to itself.
SHARD_BYTES = 4 << 20
_NULL = -(1 << 63)
#: Texts that are empty or hold white space other than single blanks and line feeds between words.
_IRREGULAR = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that are encoded at once; more of them share more words.
_AT_ONCE = 3000
#: Marks that end no special token.
_MARKS = ",.!?;:*$%&#"
#: New words that are encoded in one call.
_TOGETHER = 500


class Ids(dict):
    """A worker's table from words to the ids of a blank and the word; and from a line feed and a word to theirs.

    White space of one character between words always ends a pre-token, so texts that hold no other white space fall
    apart there; others are encoded whole. Marks of punctuation after a letter or digit are a pre-token of their own.
    When the table is full it is laid aside, and words are taken over from it as they come again.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        names = self.tok.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(names.values()) < 1 << 16 else "<u4")
        self.starts = {}
        for first, symbol in ((" ", "\u0120"), ("\n", "\u010a")):  # the symbols of a blank and a line feed
            self.starts[first] = np.zeros(max(names.values()) + 1, bool)
            self.starts[first][[i for x, i in names.items() if x[0] == symbol]] = True
        self.tails: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, words: list[str], first: str) -> None:
        """Encodes new words after `first`, many in one call: each begins where an id begins with `first`."""
        before = first if first == "\n" else ""
        bases, ends = [], []
        for w in words:
            x = w.rstrip(_MARKS)
            if len(x) < len(w) and x and x[-1].isalnum():
                ends.append((w, x))
                if before + x not in self:
                    bases.append(x)
            else:
                bases.append(w)
        new = list(set(bases))
        width = self.dtype.itemsize
        for k in range(0, len(new), _TOGETHER):
            some = new[k : k + _TOGETHER]
            ids = np.array(self.tok.encode_batch_fast([first + first.join(some)], add_special_tokens=False)[0].ids, self.dtype)
            at = (np.flatnonzero(self.starts[first][ids]) * width).tolist()
            raw = ids.tobytes()
            self.update(zip([before + w for w in some] if before else some, map(raw.__getitem__, map(slice, at, [*at[1:], len(raw)])), strict=True))
        for w, x in ends:
            if (tail := self.tails.get(w[len(x) :])) is None:
                tail = self.tails[w[len(x) :]] = self.raw(w[len(x) :])
                if len(self.tails) > 10_000:
                    self.tails = {w[len(x) :]: tail}
            self[before + w] = self[before + x] + tail

    def encode(self, text: str) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0]

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, none of which is null. The batch's distinct words are looked up once, and ids gathered by position."""
        plain = pc.invert(pc.match_substring_regex(texts, _IRREGULAR))
        # a line feed stays with the word after it; each text's first word has one put before it, whose id goes again
        lines = pc.binary_join_element_wise("\n", pc.replace_substring(texts.filter(plain), "\n", " \n"), "")
        parts = pc.split_pattern(lines, " ")
        coded = parts.flatten().dictionary_encode()
        keys, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = self.known(keys)
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
        ids, starts = np.frombuffer(b"".join(found), self.dtype), np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        ids = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[parts.offsets.to_numpy()].tolist()
        raw = ids.tobytes()
        whole = iter([raw[(i + 1) * width : j * width] for i, j in zip(bounds, bounds[1:])])
        return [next(whole) if ok else self.raw(text) for ok, text in zip(plain.to_pylist(), texts.to_pylist())]

    def known(self, keys: list[str]) -> list[bytes]:
        if len(self) + len(keys) > common.TABLE_ENTRIES:
            self.old = dict(self)
            self.clear()
        out = list(map(self.get, keys))
        if None in out:
            new = {k for k, x in zip(keys, out) if x is None}
            if self.old:
                again = [k for k in new if k in self.old]
                self.update(zip(again, map(self.old.__getitem__, again)))
                new.difference_update(again)
            if lines := [k[1:] for k in new if k[0] == "\n"]:
                self.learn(lines, "\n")
            if rest := [k for k in new if k[0] != "\n"]:
                self.learn(rest, " ")
            out = list(map(self.__getitem__, keys))
        return out


_tables: dict[str, Ids] = {}


def ids_table(path: str) -> Ids:
    if path not in _tables:
        _tables[path] = Ids(path)
    return _tables[path]


def key_halves(ids: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids.astype(np.int64).view(np.uint64), occurrence.astype(np.uint64)


def fingerprints(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(mix(hi) + lo * np.uint64(0x9E3779B97F4A7C15))


def occurrences(ids: np.ndarray) -> np.ndarray:
    """For sorted ids: how many equal ones stand before each."""
    at = np.arange(len(ids))
    new = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(ids) else at


class Shard:
    """A shard read back: ids of a document in constant time."""

    def __init__(self, width: int, index: bytes, prints: bytes, offsets: bytes, lengths: bytes, payload: bytes):
        self.hash = PerfectHash.from_bytes(index)
        self.prints, self.offsets, self.lengths = (np.frombuffer(x, "<u8") for x in (prints, offsets, lengths))
        self.ids = np.frombuffer(payload, f"<u{width}")

    def find(self, ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where the shard doesn't hold it."""
        hi, lo = key_halves(ids, occurrence)
        at = self.hash.index(hi, lo)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == fingerprints(hi[ok], lo[ok])
        return np.where(ok, at, -1)


def _shard(part: int, seq: int, start: int, keys: list[int | None], raw: list[bytes], width: int) -> list:
    ids = np.array([_NULL if k is None else k for k in keys], np.int64)
    lengths = np.array([len(x) // width for x in raw], np.uint64)
    offsets = (np.cumsum(lengths) - lengths).astype(np.uint64)
    hi, lo = key_halves(ids, occurrences(ids))
    ph = PerfectHash.build(hi, lo)
    at = ph.index(hi, lo)
    slots = [np.zeros(len(ids), "<u8") for _ in range(3)]
    for slot, x in zip(slots, (fingerprints(hi, lo), offsets, lengths)):
        slot[at] = x
    known = [k for k in keys if k is not None]
    return [part, seq, min(known, default=None), max(known, default=None), len(keys), int(lengths.sum()), start, width, len(keys) - len(known), ids.astype("<i8").tobytes(), ph.to_bytes(), *(x.tobytes() for x in slots), b"".join(raw)]


def write_id_shards(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes whole texts, ends each with `end_id`, and writes shards in ascending order of id to `path`; returns them as read back.

    Null ids come first, rows with equal ids are ordered by text; a null text is empty. An empty table writes no shard.
    One shuffle, by ranges of (id, text's hash): an id that many rows share still spreads over tasks. Memory of a task:
    the shard in hand and a bounded table of words.
    """
    spark, vocab = docs.sparkSession, common.vocabulary_path(vocabulary)
    rows = common.keyed(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches):
        table = ids_table(vocab)
        width, part = table.dtype.itemsize, TaskContext.get().partitionId()
        tail = b"" if end_id is None else np.array([end_id], table.dtype).tobytes()
        keys, raw, held, start, seq = [], [], 0, 0, 0

        def out():
            row = _shard(part, seq, start, keys, raw, width)
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types)], _COLUMNS)

        types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
        slices = (b.slice(k, _AT_ONCE) for b in batches for k in range(0, b.num_rows, _AT_ONCE))
        for b in slices:
            for key, ids in zip(b.column("doc_id").to_pylist(), table.encode_batch(pc.fill_null(b.column("text"), ""))):
                ids += tail
                if keys and held + len(ids) > shard_bytes:
                    yield out()
                    keys, raw, held, start, seq = [], [], 0, start + held // width, seq + 1
                keys.append(key)
                raw.append(ids)
                held += len(ids)
        if keys:
            yield out()

    rows.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)
    return read_id_shards(spark, path)


def read_id_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def shard_documents(shards: DataFrame) -> DataFrame:
    """Per document of the shards, each found through the index: doc_id, start (ids before it in all shards), n_tokens, ids_crc32.

    The sums over parts that are broadcast have one row for each task that wrote.
    """
    from pyspark.sql import Window

    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = shards.join(F.broadcast(base), "part").select("base", "part_start", "n_null", "width", "keys", "index", "prints", "offsets", "lengths", "payload")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                s = Shard(r["width"], r["index"], r["prints"], r["offsets"], r["lengths"], r["payload"])
                ids = np.frombuffer(r["keys"], "<i8")
                at = s.find(ids, occurrences(ids))
                if (at < 0).any():
                    raise ValueError("a shard's index doesn't hold its keys")
                first, n = s.offsets[at].astype(np.int64), s.lengths[at].astype(np.int64)
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[i : i + k].tobytes()) for i, k in zip(first.tolist(), n.tolist())]
                null = np.arange(len(ids)) < r["n_null"]
                yield pa.record_batch([pa.array(ids, pa.int64(), mask=null), pa.array(first + (r["base"] + r["part_start"])), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def get_ids(shards: DataFrame, doc_id: int | None) -> list[int] | None:
    """Keyed access: the ids of one document (its first row, if the id repeats; None for the document without id). Of shards whose range
    may hold it only the index is read, and the payload only of the one that does."""
    if doc_id is None:
        near = shards.filter("n_null > 0")
    else:
        near = shards.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    key = np.array([_NULL if doc_id is None else doc_id])
    for r in near.select("part", "seq", "width", "index", "prints", "offsets", "lengths").orderBy("part", "seq").toLocalIterator():
        s = Shard(r["width"], bytes(r["index"]), bytes(r["prints"]), bytes(r["offsets"]), bytes(r["lengths"]), b"")
        at = int(s.find(key, np.array([0]))[0])
        if at >= 0:
            first, n, width = int(s.offsets[at]), int(s.lengths[at]), r["width"]
            here = shards.filter((F.col("part") == r["part"]) & (F.col("seq") == r["seq"]))
            raw = here.select(F.substring("payload", first * width + 1, n * width)).first()[0]
            return np.frombuffer(bytes(raw), f"<u{width}").tolist()
    return None
