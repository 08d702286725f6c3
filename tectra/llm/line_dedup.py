"""Line dedup with a sharded minimal perfect hash over the hashes of all distinct lines.

The index is a table of shards; a shard has a perfect hash and, by index, arrays of fingerprints, counts (of the ids that
hold the line) and keepers (the largest such id). Documents send the hashes of their lines to the shards and probe the
arrays there: a shard is loaded once for a run of probes that streams past it, and a shard of more probes than PROBES, as
of a line that very many documents hold, is sent to several tasks. What comes back is each document's lines to drop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .mph import PerfectHash

_BLANK = b" \t\n\x0b\x0c\r"
#: Keys of a shard, on average.
SHARD_KEYS = 50_000
#: Probes of a shard that go to one task, on average.
PROBES = 500_000
#: Lines to drop are broadcast up to so many bytes; more of them are joined to the documents by a shuffle.
BROADCAST_BYTES = 16 << 20
_NULL_ID = -(1 << 63)
_INDEX = "shard int, hash binary, prints binary, counts binary, keepers binary"


def line_keys(text: str, min_chars: int) -> tuple[list[bytes], list[int], np.ndarray]:
    """Lines in UTF-8, places of those with a key of at least min_chars code points, and the 128-bit hashes of these keys."""
    lines = text.encode().split(b"\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        key = line.strip(_BLANK)
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key.lower()))
    return lines, at, np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)


class Shard:
    """A shard of the index in a task's memory."""

    def __init__(self, hash_: bytes, prints: bytes, counts: bytes, keepers: bytes):
        self.hash = PerfectHash.from_bytes(hash_)
        self.prints, self.counts, self.keepers = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4"), np.frombuffer(keepers, "<i8")

    def drops(self, hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether the document ids[i] loses the line (hi[i], lo[i])."""
        at = self.hash.index(hi, lo)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == lo[ok]
        ok[ok] = (self.counts[at[ok]] >= min_docs) & (self.keepers[at[ok]] != ids[ok])
        return ok


def document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """hi, lo, doc_id: the line keys of each id, once an id, however many rows it has. A null id is the least integer."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, found = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                _, at, h = line_keys(text, min_chars)
                if len(h) > 1:
                    h = np.unique(h, axis=0)
                found.append(h)
                ids += [_NULL_ID if i is None else i] * len(h)
            h = np.concatenate([np.zeros((0, 2), np.uint64), *found]).view(np.int64)
            return pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

        return f

    return common.map_batches(docs, make, "hi long, lo long, doc_id long").distinct()


def line_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """The index's table and its number of shards."""
    keys = common.cut(lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")))
    n = max(1, -(-keys.count() // SHARD_KEYS))

    def build(frame):
        import pandas as pd

        hi, lo = (frame[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        ph = PerfectHash.build(hi, lo)
        at = ph.index(hi, lo)
        prints, counts, keepers = np.zeros(len(at), "<u8"), np.zeros(len(at), "<u4"), np.zeros(len(at), "<i8")
        prints[at], counts[at], keepers[at] = lo, np.minimum(frame["n"].to_numpy(), 2**32 - 1), frame["keeper"].to_numpy()
        return pd.DataFrame([[int(frame["shard"].iloc[0]), ph.to_bytes(), prints.tobytes(), counts.tobytes(), keepers.tobytes()]], columns=["shard", "hash", "prints", "counts", "keepers"])

    index = common.cut(keys.withColumn("shard", F.pmod("hi", F.lit(n)).cast("int")).groupBy("shard").applyInPandas(build, _INDEX))
    common.forget(lines.sparkSession, keys)
    return index, n


def dropped_lines(lines: DataFrame, index: DataFrame, n: int, min_docs: int) -> DataFrame:
    """doc_id and lo of each line that an id loses. Shards and probes meet in the sorted rows of a task, the shard first."""
    probes = lines.withColumn("shard", F.pmod("hi", F.lit(n)).cast("int"))
    parts = common.cut(probes.groupBy("shard").count().select("shard", F.ceil(F.col("count") / PROBES).cast("int").alias("parts")))
    parts = common.hinted(parts)
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    probes = probes.join(parts, "shard").select("shard", part.alias("part"), F.lit(1).alias("probe"), "doc_id", "hi", "lo")
    shards = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shards = shards.select("shard", "part", F.lit(0).alias("probe"), "hash", "prints", "counts", "keepers")

    def run(batches):
        at, shard = None, None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("shard", "part", "probe")], 1)
            ids, hi, lo = (pc.fill_null(b.column(c), 0).to_numpy() for c in ("doc_id", "hi", "lo"))
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))).tolist() if len(key) else []
            out = []
            for i, j in zip(edges, [*edges[1:], len(key)]):
                if key[i, 2] == 0:
                    at, shard = (key[i, 0], key[i, 1]), Shard(*(b.column(c)[i].as_py() for c in ("hash", "prints", "counts", "keepers")))
                    continue
                if at != (key[i, 0], key[i, 1]):
                    raise ValueError("a shard of the index is missing")
                gone = shard.drops(hi[i:j].view(np.uint64), lo[i:j].view(np.uint64), ids[i:j], min_docs)
                out.append((ids[i:j][gone], lo[i:j][gone]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["doc_id", "lo"])

    met = probes.unionByName(shards, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", "probe")
    return met.mapInArrow(run, "doc_id long, lo long")


def _without(lines: list[bytes], at: list[int], drop: np.ndarray) -> str:
    if drop.any():
        gone = {at[k] for k in np.flatnonzero(drop).tolist()}
        lines = [x for i, x in enumerate(lines) if i not in gone]
    return b"\n".join(lines).decode()


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = "n_lines", n_dropped: str | None = "n_dropped", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` with the text of each row less its repeated lines, and two counts (a name of None leaves a count out).

    A line's key is the line stripped of ASCII white space, with A-Z in lower case. A key of at least min_chars code
    points that at least min_docs ids hold keeps its lines in the rows of the largest id that holds it, and loses
    them elsewhere. Rows of one id count as one document, those without id too; a null id is less than any other. Null and
    empty texts have one empty line. An empty table gives an empty one. All columns stay; a count whose name a column
    has already takes that column's place.
    """
    lines = common.cut(document_lines(common.keyed(docs, id_col, text_col), min_chars))
    index, n = line_index(lines)
    gone = dropped_lines(lines, index, n, min_docs).groupBy("doc_id").agg(F.collect_list("lo").alias("gone"))
    gone = common.cut(gone)
    common.forget(docs.sparkSession, lines, index)
    if (gone.agg(F.sum(F.size("gone") * 8 + 32)).first()[0] or 0) <= broadcast_bytes:
        gone = F.broadcast(gone)

    counts = [(name, kind) for name, kind in ((n_lines, 0), (n_dropped, 1)) if name]
    kept = docs.drop(*[name for name, _ in counts])
    kept = kept.withColumns({text_col: F.coalesce(F.col(text_col).cast("string"), F.lit("")), id_col: F.col(id_col).cast("long")})
    schema = T.StructType([*kept.schema.fields, *[T.StructField(name, T.LongType()) for name, _ in counts]])
    names = kept.columns
    # one struct a row, so that no column's name can clash
    rows = kept.select(F.struct(*names).alias("row"), F.coalesce(F.col(id_col), F.lit(_NULL_ID)).alias("id"))
    source = rows.join(gone, rows["id"] == gone["doc_id"], "left").select("row", "gone")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            row = batch.column("row")
            columns = dict(zip(names, row.flatten()))
            texts, totals, lost = [], [], []
            for text, drop in zip(columns[text_col].to_pylist(), batch.column("gone")):
                lines, at, h = line_keys(text, min_chars)
                gone = np.isin(h[:, 1], drop.values.to_numpy().view(np.uint64)) if drop.is_valid else np.zeros(len(h), bool)
                texts.append(_without(lines, at, gone))
                totals.append(len(lines))
                lost.append(int(gone.sum()))
            columns[text_col] = pa.array(texts, pa.string())
            values = pa.array(totals, pa.int64()), pa.array(lost, pa.int64())
            return pa.record_batch([columns[c] for c in names] + [values[k] for _, k in counts], [x.name for x in schema.fields])

        return f

    return common.map_batches(source, make, schema)


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept."""
    kept = dedup_lines(common.keyed(docs, options.pop("id_col", "doc_id"), options.pop("text_col", "text")), **options)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
