"""Packing token pieces into sequences by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fit one sequence. The covering program (fewest configurations that hold every length as
often as it occurs) is solved by multiplicative weights: lengths that lag behind gain price, a knapsack over the capacity finds the
best configurations at these prices, and lengths take part in them up to their share of the round. Amounts are rounded to whole
sequences, what is left goes through the program again, and at last by best fit into gaps and new sequences.

All this sees counts by length alone, which the capacity bounds; pieces get their places by their rank among pieces of one length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .id_shards import ids_table

#: Rounds of the weights, their rate, and how far below the best price a configuration may be.
ROUNDS, RATE, SLACK = 100, 16.0, 0.02
#: Times that the program is solved, each for what rounding left of the one before.
PASSES = 5
#: Texts that are encoded at once.
_AT_ONCE = 1000

Config = tuple[tuple[int, int], ...]  # (length, copies), longest first


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best total price for each room from 0 to the capacity, any length any number of times; and the length taken last, 0 for none."""
    n = len(prices)
    best, last = np.zeros(n), np.zeros(n, np.int64)
    for room in range(1, n):
        found = best[room - 1 :: -1] + prices[1 : room + 1]
        k = int(found.argmax())
        if found[k] > best[room - 1]:
            best[room], last[room] = found[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, last


def solve(counts: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, slack: float = SLACK) -> tuple[dict[Config, float], float]:
    """Amounts of configurations, which cover no length more often than it occurs, and a lower bound of the sequences (the dual's best)."""
    size = np.arange(len(counts))
    need = np.maximum(counts, 1).astype(float)
    lengths = np.flatnonzero(counts)
    covered, amounts, bound = np.zeros(len(counts)), defaultdict(float), 0.0
    for t in range(rounds):
        done = covered / need
        prices = np.where(counts > 0, size * np.exp(-rate * (done - t / rounds)), 0.0)
        best, last = knapsack(prices)
        if best[-1] <= 0:
            break
        bound = max(bound, float((counts * prices).sum() / best[-1]))
        share = (need * np.clip((t + 1) / rounds - done, 0, None)).tolist()
        below = np.maximum.accumulate(np.where(last > 0, size, 0)).tolist()
        price, total, taken = prices.tolist(), best.tolist(), last.tolist()
        for first in lengths[np.argsort(-prices[lengths], kind="stable")].tolist():
            room = len(counts) - 1 - first
            if share[first] <= 1e-9 or price[first] + total[room] < (1 - slack) * total[-1]:
                continue
            items = {first: 1}
            room = below[room]
            while room:
                k = taken[room]
                items[k] = items.get(k, 0) + 1
                room = below[room - k]
            amount = min(share[k] / a for k, a in items.items())
            if amount > 1e-9:
                amounts[tuple(sorted(items.items(), reverse=True))] += amount
                for k, a in items.items():
                    share[k] -= amount * a
                    covered[k] += amount * a
    return dict(amounts), bound


def rounded(amounts: dict[Config, float], left: np.ndarray) -> dict[Config, int]:
    """Whole sequences, largest amounts first; what is cut off one is carried to the next. Takes them off `left`."""
    out, carry = {}, 0.0
    for config, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        carry = min(carry, 1.0) + amount
        k = min(int(carry), *(int(left[size]) // a for size, a in config))
        if k > 0:
            carry -= k
            out[config] = k
            for size, a in config:
                left[size] -= a * k
    return out


def best_fit(plan: dict[Config, int], left: np.ndarray) -> dict[Config, int]:
    """Places all of `left`, longest first, into the fullest sequences of the plan that have room, and into new ones."""
    room = len(left) - 1
    gaps: dict[int, dict[Config, int]] = defaultdict(lambda: defaultdict(int))
    for config, k in plan.items():
        gaps[room - sum(size * a for size, a in config)][config] += k
    for size in np.flatnonzero(left)[::-1].tolist():
        n, gap = int(left[size]), size
        while n and gap < room:
            if not gaps[gap]:
                gap += 1
                continue
            config, k = gaps[gap].popitem()
            if k > n:
                gaps[gap][config] = k - n
                k = n
            items = dict(config)
            items[size] = items.get(size, 0) + 1
            gaps[gap - size][tuple(sorted(items.items(), reverse=True))] += k
            n -= k
            gap = max(size, gap - size)  # these are now the fullest that may have room
        fit = room // size
        for copies, k in ((fit, n // fit), (n % fit, 1)):
            if copies and k:
                gaps[room - size * copies][((size, copies),)] += k
    merged: dict[Config, int] = defaultdict(int)
    for found in gaps.values():
        for config, k in found.items():
            merged[config] += k
    return dict(merged)


def packing_plan(counts: np.ndarray, passes: int = PASSES) -> tuple[dict[Config, int], float]:
    """Configurations and their numbers for `counts` of lengths up to the capacity (counts[0] is nothing), and a lower bound of the
    sequences. Each pass rounds the program for what is left; the pass with the fewest sequences after best fit wins, best fit
    alone counting as the pass before the first."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    held: dict[Config, int] = defaultdict(int)
    if left[-1]:
        held[((len(counts) - 1, 1),)] = int(left[-1])
        left[-1] = 0
    whole, fixed = left.copy(), sum(held.values())
    best = best_fit(held, left)
    bound = float(np.ceil((np.arange(len(counts)) * whole).sum() / (len(counts) - 1)))
    for k in range(passes):
        if sum(best.values()) <= fixed + bound or not left.any():
            break
        amounts, dual = solve(left)
        if k == 0:
            bound = max(bound, float(np.ceil(dual - 1e-6)))
        more = rounded(amounts, left)
        if not more:
            break
        for config, n in more.items():
            held[config] += n
        found = best_fit(held, left)
        if sum(found.values()) < sum(best.values()):
            best = found
    return best, fixed + bound


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, plan: dict[Config, int]):
        seen: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for config, n in sorted(plan.items(), reverse=True):
            offset = 0
            for size, a in config:
                rows.append((size, seen[size], a, sequence, offset))
                seen[size] += n * a
                offset += size * a
            sequence += n
        rows.sort()
        self.sizes, self.firsts, self.copies, self.sequences, self.offsets = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
        self.keys = self._key(self.sizes, self.firsts)

    @staticmethod
    def _key(size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return size << 44 | rank

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, self._key(size, rank), "right") - 1
        nth = rank - self.firsts[at]
        return self.sequences[at] + nth // self.copies[at], self.offsets[at] + nth % self.copies[at] * size


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32; part and nth number the pieces of one length within a task. No shuffle."""
    vocab = common.vocabulary_path(vocabulary)
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches):
        table = ids_table(vocab)
        width, part = table.dtype.itemsize, TaskContext.get().partitionId()
        tail, seen = np.array([end_id], table.dtype).tobytes(), [0] * (limit + 1)
        for b in (b.slice(k, _AT_ONCE) for b in batches for k in range(0, b.num_rows, _AT_ONCE)):
            out: list[list] = [[] for _ in names]
            for key, raw in zip(b.column("doc_id").to_pylist(), table.encode_batch(pc.fill_null(b.column("text"), ""))):
                wide = np.frombuffer(raw + tail, table.dtype).astype("<u4").tobytes()
                n = len(raw) // width + 1
                ends = range((n - 1) % limit + 1, n + 1, limit)
                start = 0
                for piece, end in enumerate(ends):
                    size = end - start
                    for column, x in zip(out, (key, piece, start, size, zlib.crc32(wide[4 * start : 4 * end]), part, seen[size])):
                        column.append(x)
                    seen[size] += 1
                    start = end
            yield pa.record_batch([pa.array(x, pa.int32() if n in ("piece", "part") else pa.int64()) for n, x in zip(names, out)], names)

    return common.keyed(docs, id_col, text_col).mapInArrow(run, _PIECES)


def pack(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """Gives each piece its sequence_id and offset. `pieces` are read several times: a written table."""
    spark = pieces.sparkSession
    sums = common.cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(limit + 1, np.int64)
    for size, n in sums.groupBy("length").agg(F.sum("n")).collect():  # a row a length, `limit` at most
        counts[size] = n
    places = spark.sparkContext.broadcast(Places(packing_plan(counts)[0]))
    before = sums.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches):
        for b in batches:
            sequence, offset = places.value.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of each whole text's ids and `end_id`: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    Documents longer than `limit` are cut into pieces of `limit`, the first of which may be shorter; others are one piece. Null and empty
    texts are the end id alone. Repeated rows and ids are documents of their own, a null id stays null, an empty table gives an empty
    one, other columns are ignored. Equal lengths are ranked in the order of tasks and rows.
    """
    return pack(common.cut(token_pieces(docs, vocabulary, end_id, limit, id_col, text_col)), limit)
