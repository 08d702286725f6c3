"""Toxicity by Kneser-Ney models of whole texts, one of toxic and one of ordinary documents.

Each class has P(b | a), from pairs of words, which backs off to P(b), from words, which backs off to counts that both classes share and
which so smooth rare expressions. As in Kneser and Ney's lower orders, what counts is in how many contexts a pair or a word stands, so that
a passage that many copies repeat counts once. One is taken off every count; what is taken off a history's pairs, its number of different
next words, is the weight of its backoff, so that every history's probabilities add up to one. An expression of one context is then the
backoff's alone. That makes the tables short without loss: only entries that say something else than the backoff are kept.

A toxic document is ordinary text with a few toxic expressions, so its likelihood is a mixture: each word is toxic speech with some share,
and toxic speech lies some power as far from ordinary speech as the model of toxic documents, which holds both; a share and a power of
one are the model itself. As few toxic documents tell little of most pairs, a word's ratio of likelihoods lies between that of the word alone
and that after the word before it. A document's evidence is the difference of the two log-likelihoods by its number of words, and some words more, so
that a single odd word doesn't decide a very short text. Share, power, these words and the trust in pairs are chosen in the job itself, by the likelihood of
labelled documents that neither fill the models nor are held out.

Spark counts, smooths and joins the tables. A table of checked size is broadcast to score. Of a larger one the commonest keys are, with a filter
that tells most pairs without an entry; only for the rest a batch of texts asks the table's shards, some bytes a pair, and gets sums.
"""

from __future__ import annotations

import itertools
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .mph import mix

#: What is tried: shares of a toxic document's words that are toxic speech with the powers of that, words added to a length, and how far the
#: word before is trusted, from not at all to wholly.
TRIED = [(share, power, more, trust) for trust in (0.0, 0.5, 1.0) for more in (10, 100) for share, power in [(1.0, 1.0), *((s, p) for s in (1e-2, 1e-3, 1e-4) for p in (1.0, 2.0, 3.0))]]
#: Labels of at most so many rows are broadcast (16 bytes each); more of them are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: A table of at most so many keys is broadcast (16 bytes each); of a larger one so many, words up to three quarters of them.
BROADCAST_KEYS = 4_000_000
#: Pairs of a shard of the table, which a task holds (20 bytes each) while it answers what is asked of them.
SHARD_KEYS = 1_000_000
#: The filter has 12 to 24 bits a key, of which two are set, up to so many bits in all; each key's lie in one slice of it.
_FILTER_BITS, _SLICE = 1 << 29, 1 << 20
#: Evidence is sorted into so many bins to fit the probability, between two bounds.
_BINS, _LEAST, _MOST = 4000, -15.0, 15.0
#: Evidence is taken as an inverse hyperbolic sine, close to a logarithm of either sign, of so small a unit.
_UNIT = 1e-5
_G = np.uint64(0x9E3779B97F4A7C15)
#: What tells pairs' keys from words'; what stands before the first word of a text.
_PAIR, _START = np.uint64(0xB2), "\x02"
#: Pairs are asked for by the lower six bytes of their keys; the upper four choose the shard.
_LOW = np.uint64((1 << 48) - 1)
#: What a batch's rows in `_asked` are: its texts, pairs asked of a shard, pairs with a word that is away.
_TEXT, _ASK, _OPEN = range(3)
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_COUNTS = ("toxic", "ordinary")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits and runs of marks, in lower case."""
    return _TOKENS.findall(text.lower())


def word_keys(words: list[str]) -> np.ndarray:
    """Hashes of 40 bits, so that a pair's counts are shuffled in few bytes. Words that share one share their counts."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words)) >> np.uint64(24)


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before + _PAIR) + after * _G)


def _tokens(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word before the first one as the first of them; places of all words, texts one after another, each
    with that word before it; and the text of each place."""
    found = [[_START, *words_of(x)] for x in common.texts(batch)]
    n = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(found)), n)


def _unsigned(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def pair_counts(labelled: DataFrame) -> DataFrame:
    """a, b (keys of a word and of the one after it), toxic, ordinary: after how many different words the pair stands in the texts of
    either label. What a batch repeats is one row before the shuffle."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, at, of = _tokens(batch)
            toxic, keys = batch.column("toxic").to_numpy()[of] == 1, word_keys(words)
            same = np.flatnonzero(of[1:] == of[:-1])
            # the word before the pair, or none where the pair begins the text
            before = np.where((same > 0) & (of[same - 1] == of[same]), at[same - 1] + 1, 0)
            pair, of_pair = np.unique(at[same] * len(words) + at[same + 1], return_inverse=True)
            code, back = np.unique(of_pair * (len(words) + 1) + before, return_inverse=True)
            seen = [np.bincount(back, x, len(code)) > 0 for x in (toxic[same], ~toxic[same])]
            size = max(1, len(words))
            pair, before = pair[code // (size + 1)], code % (size + 1)
            a, b = keys[pair // size], keys[pair % size]
            x = np.concatenate([np.zeros(1, np.uint64), keys])[before] & np.uint64(0xFFFFFFFF)
            high = (a << np.uint64(24)) | (b >> np.uint64(16))
            low = ((b & np.uint64(0xFFFF)) << np.uint64(34)) | (x << np.uint64(2)) | (seen[0] + 2 * seen[1]).astype(np.uint64)
            return pa.record_batch([_unsigned(high), _unsigned(low)], ["high", "low"])

        return f

    found = common.map_batches(labelled.select("toxic", "text"), make, "high long, low long")
    # one shuffle serves both groupings
    found = found.repartition("high").select("high", F.shiftright("low", 34).alias("end"), F.shiftright("low", 2).bitwiseAND(0xFFFFFFFF).alias("x"), F.col("low").bitwiseAND(3).alias("seen"))
    found = found.groupBy("high", "end", "x").agg(F.bit_or("seen").alias("seen"))
    found = found.groupBy("high", "end").agg(F.count_if(F.col("seen").bitwiseAND(1) > 0).cast("int").alias("toxic"), F.count_if(F.col("seen").bitwiseAND(2) > 0).cast("int").alias("ordinary"))
    return found.select(F.shiftrightunsigned("high", 24).alias("a"), F.shiftleft(F.col("high").bitwiseAND(0xFFFFFF), 16).bitwiseOR(F.col("end")).alias("b"), *_COUNTS)


def _past(c: Column) -> Column:
    return F.greatest(c - 1, F.lit(0)).cast("double")


def word_values(pairs: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Of words: w, value (log P_toxic(w) - log P_ordinary(w)), weight (the same of the backoff's weight after w) and n (how common it is). Of pairs: a, b, value
    (the same of P(b | a)), weight (after a), own (b's value, null without an entry) and n. And the value of a word without an entry, whose weight is 0. What a row left out has follows from these:
    a word's defaults, and for a pair the first word's weight and the second one's value."""
    words = pairs.groupBy(F.col("b").alias("w")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in _COUNTS], F.count(F.lit(1)).alias("n"))
    words = common.cut(words, spent=True)
    sums = words.agg(*[F.sum(c).alias(c) for c in (*_COUNTS, "n")], *[F.count_if(F.col(c) > 0).alias(f"{c}_types") for c in _COUNTS]).first()
    total = {c: float(sums[c] or 0) for c in (*_COUNTS, "n")}
    rest = {c: sums[f"{c}_types"] / total[c] if total[c] else 1.0 for c in _COUNTS}
    p = {c: _past(F.col(c)) / (total[c] or 1.0) + rest[c] * F.col("n") / (total["n"] or 1.0) for c in _COUNTS}
    beyond = float(np.log(rest["toxic"]) - np.log(rest["ordinary"]))
    lone = (F.col("toxic") <= 1) & (F.col("ordinary") <= 1)
    counted = words
    words = words.select("w", "n", *[p[c].alias(f"p_{c}") for c in _COUNTS], F.when(lone, beyond).otherwise(F.log(p["toxic"]) - F.log(p["ordinary"])).alias("value"))
    after = pairs.groupBy(F.col("a").alias("w")).agg(*[F.sum(c).cast("double").alias(f"all_{c}") for c in _COUNTS], *[F.count_if(F.col(c) > 0).cast("double").alias(f"next_{c}") for c in _COUNTS])
    left = {c: F.when(F.col(f"all_{c}") > 0, F.col(f"next_{c}") / F.col(f"all_{c}")).otherwise(1.0) for c in _COUNTS}
    after = after.select("w", *[F.col(f"all_{c}") for c in _COUNTS], *[left[c].alias(f"left_{c}") for c in _COUNTS])
    words = words.join(after, "w", "full").withColumn("weight", F.coalesce(F.log("left_toxic") - F.log("left_ordinary"), F.lit(0.0))).withColumn("value", F.coalesce("value", F.lit(beyond)))
    words = common.cut(words.withColumn("n", sum(F.coalesce(F.col(c), F.lit(0)) for c in ("n", "all_toxic", "all_ordinary")).cast("long")), spent=True)
    common.forget(words.sparkSession, counted)

    both, entry = pairs.filter("toxic > 1 or ordinary > 1"), (F.col("value") != beyond) | (F.col("weight") != 0)
    b = words.select(F.col("w").alias("b"), *[F.col(f"p_{c}") for c in _COUNTS], F.when(entry, F.col("value").cast("float")).alias("own"))
    a = words.select(F.col("w").alias("a"), *[F.col(f"{k}_{c}") for c in _COUNTS for k in ("all", "left")], F.col("weight").cast("float").alias("weight"))
    met = both.join(b, "b").join(a, "a")
    q = {c: F.when(F.col(f"all_{c}") > 0, _past(F.col(c)) / F.col(f"all_{c}")).otherwise(0.0) + F.col(f"left_{c}") * F.col(f"p_{c}") for c in _COUNTS}
    met = met.select("a", "b", (F.log(q["toxic"]) - F.log(q["ordinary"])).alias("value"), "weight", "own", (F.col("toxic") + F.col("ordinary")).cast("long").alias("n"))
    return words.filter(entry).select("w", "value", "weight", "n"), met, beyond


def key_values(labelled: DataFrame) -> tuple[DataFrame, float]:
    """key, value, weight, own, n, word (whether it is one) of all entries of the models, and the value of a word without one."""
    counts = common.cut(pair_counts(labelled), spent=True)
    words, pairs, beyond = word_values(counts)

    def run(batches):
        for x in batches:
            a, b = (x.column(c).to_numpy().view(np.uint64) for c in "ab")
            yield pa.record_batch([_unsigned(pair_keys(a, b)), x.column("value").cast(pa.float32()), *[x.column(c) for c in ("weight", "own", "n")]], ["key", "value", "weight", "own", "n"])

    pairs = pairs.mapInArrow(run, "key long, value float, weight float, own float, n long").withColumn("word", F.lit(False))
    words_ = words.select(F.col("w").alias("key"), F.col("value").cast("float").alias("value"), F.col("weight").cast("float").alias("weight"), F.lit(None).cast("float").alias("own"), "n", F.lit(True).alias("word"))
    values = common.cut(pairs.unionByName(words_), spent=True)
    common.forget(labelled.sparkSession, counts, words)
    return values, beyond


def mixed(ratio: np.ndarray, share: float, power: float) -> np.ndarray:
    """The log-likelihood ratio of a word where a share of a toxic document's words is toxic speech."""
    return np.log1p(share * np.expm1(np.minimum(power * ratio, 50.0)))


def kinds_of(ways: list[tuple]) -> list[tuple]:
    """The different sums that some ways need: (share, power, trust)."""
    return list(dict.fromkeys((share, power, trust) for share, power, _, trust in ways))


def _bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """Where a filter of `size` bits, a power of two, holds keys: the slice, a slice's bits and the two places within it."""
    span, h = min(size, _SLICE), mix(keys + _G)
    return ((h >> np.uint64(40)) % np.uint64(size // span)).astype(np.int64), span, [((h >> np.uint64(k)) % np.uint64(span)).astype(np.int64) for k in (0, 20)]


def filter_of(keys: DataFrame, n: int) -> np.ndarray | None:
    """The bits of a filter that holds all of the n keys, and some 2 in 100 others; it is 64 MB at most, with more others in it then.
    None holds nothing."""
    if not n:
        return None
    size = min(_FILTER_BITS, max(1 << 10, 1 << (12 * n).bit_length()))

    def places(batches):
        for x in batches:
            slice_, _, at = _bits(x.column("key").to_numpy().view(np.uint64), size)
            yield pa.record_batch([pa.array(slice_, pa.int32()), *[pa.array(p, pa.int32()) for p in at]], ["slice", "one", "two"])

    def one(of: pa.Table) -> pa.Table:
        bits = np.zeros(min(size, _SLICE), bool)
        for c in ("one", "two"):
            bits[of.column(c).to_numpy()] = True
        return pa.table({"slice": of.column("slice").slice(0, 1).cast(pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    slices = common.cut(keys.select("key").mapInArrow(places, "slice int, one int, two int").groupBy("slice").applyInArrow(one, "slice int, bits binary"), spent=True)
    out = np.zeros((max(1, size // _SLICE), min(size, _SLICE) // 8), np.uint8)
    for x in slices.toArrow().to_pylist():
        out[x["slice"]] = np.frombuffer(x["bits"], np.uint8)
    common.forget(keys.sparkSession, slices)
    return out.ravel()


def away(bits: np.ndarray | None, keys: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether the filter holds keys that aren't here."""
    out = np.zeros(len(keys), bool)
    if bits is not None:
        left = np.flatnonzero(~here)
        slice_, span, at = _bits(keys[left], 8 * len(bits))
        one, two = (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in (slice_ * span + x for x in at))
        out[left] = one & two == 1
    return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the keys have one. Looked up in order, which spares the memory most of its jumps."""
    at = np.zeros(len(keys), np.int64)
    if not len(table):
        return at, np.zeros(len(keys), bool)
    order = np.argsort(keys)
    at[order] = np.minimum(np.searchsorted(table, keys[order]), len(table) - 1)
    return at, table[at] == keys


class Values:
    """A table of keys in a task's memory, and the words already looked up. Words and pairs that the filters hold may have an entry elsewhere."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weights: np.ndarray, beyond: float, filters: tuple = (None, None)):
        self.keys, self.values, self.weights, self.beyond, (self.words_away, self.pairs_away) = keys, values, weights, beyond, filters
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.known = np.zeros((4, 0))  # value, weight, key's bits, whether its entry may be elsewhere
        self.learn([_START])

    def learn(self, words: list[str]) -> None:
        keys = word_keys(words)
        at, ok = find(self.keys, keys)
        value, weight = np.full(len(keys), self.beyond), np.zeros(len(keys))
        value[ok], weight[ok] = self.values[at[ok]], self.weights[at[ok]]
        first = self.known.shape[1]
        self.known = np.concatenate([self.known, np.stack([value, weight, keys.view(np.float64), away(self.words_away, keys, ok)])], 1)
        self.places.update(zip(words, range(first, first + len(words))))

    def ratios(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Of a batch's distinct pairs: keys of both words (a, b) and of the pair; the second word's value (own) and that of the pair (whole), by the
        backoff where it isn't here; ask and open, whether its entry or that of one of its words may be elsewhere. Of each place its pair (back) and text (of)."""
        words, at, of = _tokens(batch)
        if len(self.places) + len(words) > common.TABLE_ENTRIES:
            self.forget()
        if new := [w for w in words if w not in self.places]:
            self.learn(new)
        here = self.known[:, np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]
        value, weight, keys, unknown = here[0], here[1], np.ascontiguousarray(here[2]).view(np.uint64), here[3] > 0
        same = np.flatnonzero(of[1:] == of[:-1])
        code, back = np.unique(at[same] * len(words) + at[same + 1], return_inverse=True)
        a, b = code // max(1, len(words)), code % max(1, len(words))
        pair = pair_keys(keys[a], keys[b])
        place, ok = find(self.keys, pair)
        whole = weight[a] + value[b]
        whole[ok] = self.values[place[ok]]
        open_ = unknown[a] | unknown[b]
        return {"a": keys[a], "b": keys[b], "pair": pair, "own": value[b], "whole": whole, "ask": away(self.pairs_away, pair, ok | open_), "open": open_, "back": back, "of": of[same]}

    def evidences(self, batch: pa.RecordBatch, ways: list[tuple]) -> np.ndarray:
        r, rows = self.ratios(batch), batch.num_rows
        n = np.bincount(r["of"], minlength=rows)
        sums = {k: summed(r["of"], r["own"], r["whole"], [k], rows, r["back"])[0] for k in kinds_of(ways)}
        return np.stack([np.arcsinh(sums[share, power, trust] / (n + more) / _UNIT) for share, power, more, trust in ways], 1)


def summed(of: np.ndarray, own: np.ndarray, whole: np.ndarray, kinds: list[tuple], rows: int, back: np.ndarray | slice = slice(None)) -> np.ndarray:
    """For each kind the sum of each text's places; `back` gives a place's own and whole."""
    return np.stack([np.bincount(of, mixed(own + trust * (whole - own), share, power)[back], rows) for share, power, trust in kinds])


_tables: dict[str, Values] = {}


def _table(name: str, shared) -> Values:
    if name not in _tables:
        _tables.clear()
        _tables[name] = Values(*shared.value)
    return _tables[name]


def _broadcast(values: DataFrame, beyond: float, filters: tuple = (None, None)):
    table = values.select("key", "value", "weight").toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return values.sparkSession.sparkContext.broadcast((keys[order], *(table.column(c).to_numpy()[order] for c in ("value", "weight")), beyond, filters)), uuid.uuid4().hex


def evidences(docs: DataFrame, values: DataFrame, beyond: float, keep: list[str], broadcast_keys: int, ways: list[tuple], made: list[DataFrame] | None = None) -> DataFrame:
    """The columns `keep` and evidence of each row, a number for each of the ways (those of TRIED or some of them). Written tables that the
    result reads are added to `made`."""
    if values.count() > broadcast_keys:
        return _asked(docs, values, beyond, keep, broadcast_keys, ways, [] if made is None else made)
    shared, name = _broadcast(values, beyond)
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", evidence array<double>"

    def make():
        table = _table(name, shared)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([*[batch.column(c) for c in keep], _lists(table.evidences(batch, ways))], [*keep, "evidence"])

        return f

    return common.map_batches(docs.select(*dict.fromkeys([*keep, "text"])), make, schema)


def _lists(numbers: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1) * numbers.shape[1], pa.int32()), pa.array(numbers.ravel()))


def _commonest(bins: list, word: bool, room: int) -> tuple[int, int]:
    """From which bin on keys are at most `room`, and how many are left."""
    least, left = 1 << 20, sum(x["count"] for x in bins if x.word == word)
    for x in sorted((x for x in bins if x.word == word), key=lambda x: -x.bin):
        if x["count"] > room:
            break
        least, left, room = x.bin, left - x["count"], room - x["count"]
    return least, left


def _shard(keys, shards: int):
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def _asked(docs: DataFrame, values: DataFrame, beyond: float, keep: list[str], broadcast_keys: int, ways: list[tuple], made: list[DataFrame]) -> DataFrame:
    """The same with a table of any size. Texts are summed up by what is broadcast, pairs that may have an entry elsewhere by their backoff; their
    keys go to the shards of the table in bytes, by batch, and what entries add to the backoff comes back as sums of texts. Pairs with a word
    whose entry isn't broadcast are joined; words are the smaller part of a table and rare ones stand in few pairs."""
    kinds, bin_ = kinds_of(ways), F.floor(8 * F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int")
    bins = values.groupBy("word", bin_.alias("bin")).count().collect()  # some 500 bins at most
    least_word, away_words = _commonest(bins, True, broadcast_keys * 3 // 4)
    taken = sum(x["count"] for x in bins if x.word) - away_words
    least_pair, away_pairs = _commonest(bins, False, broadcast_keys - taken)
    near = bin_ >= F.when(F.col("word"), least_word).otherwise(least_pair)
    far = values.filter(~near)
    shared, name = _broadcast(values.filter(near), beyond, (filter_of(far.filter("word"), away_words), filter_of(far.filter("not word"), away_pairs)))
    shards = max(1, -(-away_pairs // SHARD_KEYS))
    fields = {c: docs.schema[c].dataType.simpleString() for c in keep}
    schema = {"kind": "int", "doc": "long", **fields, "n": "long", "sums": "array<double>", "shard": "int", "counts": "binary", "keys": "binary", "a": "long", "b": "long", "pair": "long"}
    plain = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    trusted = any(trust for *_, trust in kinds)  # else pairs don't matter

    def make():
        table, part, number = _table(name, shared), TaskContext.get().partitionId() << 34, itertools.count()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            r, rows, first = table.ratios(batch), batch.num_rows, part + (next(number) << 10)
            own, whole = (np.where(r["open"], 0.0, r[c]) for c in ("own", "whole"))
            n = np.bincount(r["of"], minlength=rows)
            out = [pa.table([pa.array(np.full(rows, _TEXT), pa.int32()), pa.array(first + np.arange(rows)), *[batch.column(c) for c in keep], pa.array(n), _lists(summed(r["of"], own, whole, kinds, rows, r["back"]).T)], ["kind", "doc", *keep, "n", "sums"])]
            if trusted:
                at = np.flatnonzero(r["ask"][r["back"]])
                key, of = r["pair"][r["back"][at]], r["of"][at]
                shard = _shard(key, shards).astype(np.int64)
                order = np.argsort(shard * rows + of)
                key, of, shard = key[order], of[order], shard[order]
                these, starts = np.unique(shard, return_index=True)
                cuts = list(zip(starts, [*starts[1:], len(key)]))
                counts = [np.bincount(of[x:y], minlength=rows).astype(np.uint32).tobytes() for x, y in cuts]
                keys = [key[x:y].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for x, y in cuts]
                out.append(pa.table([pa.array(np.full(len(these), _ASK), pa.int32()), pa.array(np.full(len(these), first)), pa.array(these, pa.int32()), pa.array(counts, pa.binary()), pa.array(keys, pa.binary())], ["kind", "doc", "shard", "counts", "keys"]))
            at = np.flatnonzero(r["open"][r["back"]])
            code, times = np.unique(r["of"][at] * len(r["pair"]) + r["back"][at], return_counts=True)
            of, k = code // max(1, len(r["pair"])), code % max(1, len(r["pair"]))
            out.append(pa.table([pa.array(np.full(len(k), _OPEN), pa.int32()), pa.array(first + of), pa.array(times), *[_unsigned(r[c][k]) for c in ("a", "b", "pair")]], ["kind", "doc", "n", "a", "b", "pair"]))
            whole_ = pa.schema([*[(c, plain[x]) for c, x in schema.items() if c not in keep], *[batch.schema.field(c) for c in keep]])
            return pa.concat_tables([whole_.empty_table(), *out], promote_options="default").select(list(schema)).combine_chunks().to_batches()[0]

        return f

    parts = common.cut(common.map_batches(docs.select(*dict.fromkeys([*keep, "text"])), make, ", ".join(f"{c} {x}" for c, x in schema.items())), ["kind"])
    made.append(parts)
    found = parts.filter(F.col("kind") == _TEXT).select("doc", *keep, "n", "sums")
    if trusted:
        asked = parts.filter(F.col("kind") == _ASK).select("shard", F.col("doc").alias("batch"), "counts", "keys")
        entries = far.filter("not word").select(F.shiftright(F.shiftrightunsigned("key", 32) * shards, 32).cast("int").alias("shard"), "key", "value", "weight", "own")
        answers = asked.groupBy("shard").cogroup(entries.groupBy("shard")).applyInArrow(lambda x, y: _answers(x, y, beyond, kinds), "batch long, texts binary, sums binary")
        made.append(answers := common.cut(answers, spent=True))
        found = found.withColumn("batch", F.shiftleft(F.shiftright("doc", 10), 10))
        found = found.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_added, found.schema).drop("batch")
    if away_words:
        opened = _joined(parts.filter(F.col("kind") == _OPEN).select("doc", "a", "b", "pair", "n"), values, beyond, kinds)
        more = F.coalesce("more", F.array(*[F.lit(0.0)] * len(kinds)))
        found = found.join(opened, "doc", "left").withColumn("sums", F.zip_with("sums", more, lambda x, y: x + y))
    place = {k: i for i, k in enumerate(kinds)}
    evidence = [F.asinh(F.col("sums")[place[share, power, trust]] / (F.col("n") + more) / _UNIT) for share, power, more, trust in ways]
    return found.select(*keep, F.array(*evidence).alias("evidence"))


def _answers(asked: pa.Table, entries: pa.Table, beyond: float, kinds: list[tuple]) -> pa.Table:
    """What a shard's entries add to the backoff, as sums of each batch's texts: places of texts within the batch and their sums."""
    out: dict[str, list] = {"batch": [], "texts": [], "sums": []}
    keys = entries.column("key").to_numpy().view(np.uint64) & _LOW
    order = np.argsort(keys)
    keys, (whole, weight, own) = keys[order], (entries.column(c).to_numpy()[order].astype(float) for c in ("value", "weight", "own"))
    own = np.where(np.isnan(own), beyond, own)  # a word without an entry
    for x in asked.to_batches() if len(keys) else []:
        for batch, counts, raw in zip(*(x.column(c) for c in ("batch", "counts", "keys"))):
            counts, raw = np.frombuffer(counts.as_buffer(), np.uint32), np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, 6)
            key = np.zeros((len(raw), 8), np.uint8)
            key[:, :6] = raw
            key = key.view(np.uint64).ravel()
            at, ok = find(keys, key)
            at, of = at[ok], np.repeat(np.arange(len(counts)), counts)[ok]
            texts = np.unique(of)
            sums = summed(of, own[at], whole[at], kinds, len(counts)) - summed(of, own[at], weight[at] + own[at], kinds, len(counts))
            out["batch"].append(batch.as_py())
            out["texts"].append(texts.astype(np.uint16).tobytes())
            out["sums"].append(np.ascontiguousarray(sums[:, texts]).tobytes())
    return pa.table(out, pa.schema([("batch", pa.int64()), ("texts", pa.binary()), ("sums", pa.binary())]))


def _added(found: pa.Table, answers: pa.Table) -> pa.Table:
    """A batch's texts with what its answers add to their sums."""
    place = np.zeros(1 << 10, np.int64)
    place[found.column("doc").to_numpy() & 1023] = np.arange(found.num_rows)
    sums = np.array(found.column("sums").to_pylist(), float)
    for texts, added in zip(answers.column("texts"), answers.column("sums")):
        at = place[np.frombuffer(texts.as_buffer(), np.uint16)]
        sums[at] += np.frombuffer(added.as_buffer()).reshape(-1, len(at)).T
    return found.set_column(found.schema.get_field_index("sums"), "sums", _lists(sums))


def _joined(keys: DataFrame, values: DataFrame, beyond: float, kinds: list[tuple]) -> DataFrame:
    """doc and `more`, the sums of its pairs (doc, a, b, pair, n), whose words and pairs meet the table."""
    met = keys.join(values.select(F.col("key").alias("b"), F.col("value").cast("double").alias("own")), "b", "left")
    met = met.join(values.select(F.col("key").alias("a"), F.col("weight").cast("double").alias("weight")), "a", "left")
    met = met.join(values.select(F.col("key").alias("pair"), F.col("value").cast("double").alias("whole")), "pair", "left")
    own = F.coalesce("own", F.lit(beyond))
    met = met.select("doc", "n", own.alias("own"), (F.coalesce("whole", own + F.coalesce("weight", F.lit(0.0))) - own).alias("more"))
    sums = [F.sum(F.col("n") * F.log1p(share * F.expm1(F.least(F.lit(50.0), power * (F.col("own") + trust * F.col("more")))))) for share, power, trust in kinds]
    return met.groupBy("doc").agg(F.array(*sums).alias("more"))


def fit_probability(bins: list[tuple[int, int, int]], rounds: int = 100) -> tuple[float, float, float]:
    """Slope and offset of the probability of label 1, from (bin, label, documents), and the mean log loss that it leaves. Both labels weigh
    the same, so that 0.5 lies midway between them; without one of them, a default holds."""
    x = np.array([_LEAST + (b + 0.5) * (_MOST - _LEAST) / _BINS for b, _, _ in bins])
    y, n = np.array([t for _, t, _ in bins]), np.array([c for _, _, c in bins], float)
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0, float("inf")
    n = n / np.where(y == 1, n[y == 1].sum(), n[y == 0].sum())
    mean = (n * x).sum() / n.sum()
    scale = max(1e-3, float(np.sqrt((n * (x - mean) ** 2).sum() / n.sum())))
    w = np.zeros(2)
    design = np.stack([(x - mean) / scale, np.ones(len(x))], 1)
    for _ in range(rounds):  # Newton's steps with a slight pull to zero on the slope alone
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * (p - y)) + [1e-3 * w[0], 0]
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -30, 30))), 1e-12, 1 - 1e-12)
    loss = float(-(n * np.where(y == 1, np.log(p), np.log(1 - p))).sum() / n.sum())
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale), loss if w[0] > 0 else float("inf")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", broadcast_labels: int = BROADCAST_LABELS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted.

    Labels come only from ids whose crc32 (as text) leaves a rest other than 0 by `folds`; of these, rest 1 chooses the mixture and fits
    the probability, and the others fill the models. An id with several labels has the greatest; null labels and ids count as
    none. Null and empty texts have evidence 0. Repeated rows score alike, a null id is not held out, an empty table
    gives an empty one, and without labels of both kinds scores are the default's. Other columns are ignored.
    """
    rows = common.keyed(docs, id_col, text_col).withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % folds)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter((F.crc32(F.col("doc_id").cast("string")) % folds != 0) & F.col("toxic").isin(0, 1))
    if labels.count() <= broadcast_labels:
        known = F.broadcast(known)
    labelled = rows.join(known, "doc_id").filter("fold <> 0")
    values, beyond = key_values(labelled.filter("fold <> 1"))
    tried = evidences(labelled.filter("fold = 1"), values, beyond, ["toxic"], broadcast_keys, TRIED, made := [])
    tried = tried.select("toxic", F.posexplode("evidence").alias("way", "evidence"))
    bin_ = F.floor((F.col("evidence") - _LEAST) / ((_MOST - _LEAST) / _BINS))
    bins: dict[int, list[tuple[int, int, int]]] = {k: [] for k in range(len(TRIED))}
    for r in tried.groupBy("way", F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), bin_)).cast("int").alias("bin"), "toxic").count().collect():  # TRIED x _BINS x 2 rows at most
        bins[r.way].append((r.bin, r.toxic, r["count"]))
    common.forget(rows.sparkSession, *made)
    fits = {k: fit_probability(sorted(v)) for k, v in bins.items()}
    best = min(fits, key=lambda k: (fits[k][2], k))
    slope, offset, _ = fits[best]
    scored = evidences(rows, values, beyond, ["doc_id", "fold"], broadcast_keys, [TRIED[best]]).withColumn("evidence", F.col("evidence")[0])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * F.col("evidence") + offset))))
    out = scored.select("doc_id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
