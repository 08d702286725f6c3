"""Jaccard join of documents on word shingles with PartEnum signatures.

Sets are put into bands of sizes; two sets that are similar enough lie in one band or in neighbouring ones, and within
a band they differ in at most `reach` elements. The domain of shingles is dealt by hash into first-level parts, and each
of these into second-level cells. Of the first-level parts at least one, and by `spare` more than that, differ in so few
elements that some subset of their cells agrees whole. Each such subset is one signature of a set, and similar sets share one.

A subset of empty cells says nothing, and unrelated sets would meet there in numbers that grow with the square of the
rows. The spare parts pay for leaving these out: a set in which at most `spare` parts have an empty subset signs none of
them. Of the parts that two similar sets agree in, at most so many are lost as the one of them that has fewer empty
subsets has parts with such; so one at least is left. Sets with more empty subsets sign all of them, and meet one another there.

Equal sets are one class before that. Candidates that share a signature are held against the least of them, then against
one another where components still differ, and each link is decided by the sizes of intersection and union. A bound from
parities, whose buckets grow with the set and which comes near the true difference but never exceeds it, spares most false
candidates.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .mph import mix

_G = np.uint64(0x9E3779B97F4A7C15)
#: Cells of a part and cells left out of a subset, for choice: the fewest signatures whose subsets hold _FULL elements of a
#: band's least sets, or the fullest subsets within the most signatures.
_SHAPES = ((1, 0), (2, 1), (3, 1), (4, 1), (4, 2), (5, 2), (5, 3), (6, 3), (6, 4), (7, 4))
_FULL = 5.0
#: Most signatures of a set in one band: so many and this share of its least size.
_SIGNS, _SIGNS_SHARE = 20, 0.6
#: Of sets of a band's least size, about this share or less has more empty subsets than there are spare parts (in standard deviations).
_SPARE_SD = 2.4
#: Least buckets of parities, and buckets for each element of a larger set; members of one block where many sets share a signature.
_BUCKETS, _ROOM, _BLOCK = 2048, 4, 512
#: Bits of a signature. Signatures that are equal by chance only cost a comparison.
_SIGN_BITS = 48
#: Sets that one set is compared with in one group; a centre of more of them is sent once for each such group.
_GROUP = 64


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `width` words, A-Z in lower case; a shorter text is one run."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    s = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(len(h), width)):
        s = mix(s + h[k : k + n] * _G)
    return np.unique(s)


def bands(limit: int, percent: int) -> list[int]:
    """First sizes of the bands up to `limit`: a band ends where percent of its last size is its first size."""
    firsts = [1]
    while firsts[-1] <= limit:
        firsts.append(100 * firsts[-1] // percent + 1)
    return firsts


def _spare(bad: int, cells: int, out: int, size: int) -> int | None:
    """Parts beyond the bad ones and a good one, enough for the empty subsets of most sets of this size; None if there is no such number."""
    spare = 0
    for _ in range(60):
        parts = bad + 1 + spare
        empty = (1 - 1 / (parts * cells)) ** size
        # a part has an empty subset where as many cells are empty as a subset has
        share = sum(math.comb(cells, k) * empty**k * (1 - empty) ** (cells - k) for k in range(cells - out, cells + 1))
        need = math.ceil(parts * share + _SPARE_SD * math.sqrt(parts * share * (1 - share)) - 0.5)
        if need <= spare:
            return spare
        if need > 2 * (bad + 2):
            return None
        spare = need
    return None


class Signer:
    """Signatures of sets for one threshold."""

    def __init__(self, percent: int):
        self.percent, self.firsts = percent, bands(1 << 31, percent) if percent < 100 else []
        self._shapes: dict[int, tuple[int, int, int, list]] = {}

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.firsts, size, "right")) - 1

    def reach(self, band: int) -> int:
        """Most elements in which similar sets differ of which the smaller is in the band, and so the larger in it or the next.
        A union of u and an intersection of at least percent of it differ in at most u (100 - percent) / 100 elements,
        and u is at most 100 / (100 + percent) of the two sizes' sum."""
        return (self.firsts[band + 1] + self.firsts[band + 2] - 2) * (100 - self.percent) // (100 + self.percent)

    def shape(self, band: int) -> tuple[int, int, int, list[tuple[int, ...]]]:
        """Parts, spare ones among them, cells of a part, and the subsets of cells that sign."""
        if band not in self._shapes:
            reach, size, found = self.reach(band), self.firsts[band], []
            for cells, out in _SHAPES:
                bad = reach // (out + 1)  # so many parts at most differ in more than `out` elements
                spare = _spare(bad, cells, out, size)
                parts, subsets = bad + 1 + (spare or 0), math.comb(cells, out)
                fits = parts * subsets <= _SIGNS + _SIGNS_SHARE * size
                full = min(_FULL, size * (cells - out) / (parts * cells))
                found.append((spare is not None and fits, fits, full, -parts * subsets, parts, spare or 0, cells, out))
            *_, parts, spare, cells, out = max(found)
            self._shapes[band] = parts, spare, cells, list(itertools.combinations(range(cells), cells - out))
        return self._shapes[band]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Of a set that isn't empty. A set signs for its own band and the one before, so that neighbours meet. Where
        similar sets are equal sets there is no signature, as these are one class already."""
        if not self.firsts:
            return np.zeros(0, np.uint64)
        own = self.band(len(s))
        out = [np.zeros(0, np.uint64)]
        element = mix(s ^ _G)
        for band in {own, max(0, own - 1)}:
            if not self.reach(band):
                continue
            parts, spare, cells, subsets = self.shape(band)
            at = (mix(s + np.uint64(7 * band + 1)) % np.uint64(parts * cells)).astype(np.int64)
            sums = np.zeros(parts * cells, np.uint64)
            np.add.at(sums, at, element)
            full = np.bincount(at, minlength=parts * cells).reshape(parts, cells) > 0
            sums = mix(sums.reshape(parts, cells) + np.arange(1, cells + 1, dtype=np.uint64) * _G)
            place = (np.uint64(band) << np.uint64(48)) + np.arange(parts, dtype=np.uint64) * np.uint64(64)
            signs = np.stack([mix(sums[:, c].sum(1, dtype=np.uint64) + mix(place + np.uint64(k))) for k, c in enumerate(map(list, subsets))], 1)
            says = np.stack([full[:, list(c)].any(1) for c in subsets], 1)
            if (~says.all(1)).sum() <= spare:
                signs = signs[says]
            out.append(signs.ravel() >> np.uint64(64 - _SIGN_BITS))
        return np.unique(np.concatenate(out))

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
    return int(d[0]), int(d[1])


def _parities(s: np.ndarray) -> bytes:
    """A bit a bucket: whether it holds an odd number of elements. Buckets are a power of two, some four to eight an element."""
    bits = max(_BUCKETS.bit_length() - 1, (_ROOM * len(s) - 1).bit_length())
    n = np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.packbits((n & 1).astype(bool)).tobytes()


def _folded(h: bytes, n: int) -> np.ndarray:
    """n bytes: buckets that become one are odd where an odd number of them was."""
    x = np.frombuffer(h, np.uint8)
    while len(x) > n:
        bits = np.unpackbits(x)
        x = np.packbits(bits[::2] ^ bits[1::2])
    return x


def _differ(g: bytes, h: bytes) -> int:
    """At most the number of elements in which two sets differ: a bucket whose parities differ holds one of these at least."""
    n = min(len(g), len(h))
    return int(np.bitwise_count(_folded(g, n) ^ _folded(h, n)).sum())


def _may_link(differ, size, other, percent: int):
    """False only where the sets differ in more elements than sets that link can."""
    return differ * (100 + percent) <= (size + other) * (100 - percent)


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reached by links, itself included).

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles. Null and empty
    texts and texts of blanks have empty sets, which link with nothing; a text of fewer words than width is one shingle.
    Equal sets are one class: its copies cost one row each and no pairs. All rows of one id are one document, which
    links wherever one of its texts does, and so they share their component; a null id takes part in no class and is its
    own row, with a null component. An empty table gives an empty one; other columns are ignored.
    """
    rows = common.keyed(docs, id_col, text_col)
    signed = common.cut(_signed(rows, width))
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    # a written number for each class, as one id may be the least of several classes
    classes = known.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id"))
    classes = common.cut(classes.withColumn("node", F.monotonically_increasing_id()))
    links = _links(rows, known, classes, width, Signer(percent))
    name = lambda x: classes.select(F.col("node").alias(x), F.col("class_id").alias(f"{x}_id"))
    ids = links.join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    # copies hang on the least id of their class
    of = signed.select("doc_id", "n_shingles", "hi", "lo").join(classes.drop("node"), ["hi", "lo"], "left")
    several = known.select("doc_id", "hi", "lo").distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id")
    shared = common.few(several)
    ids = ids.unionByName(of.filter("class_id <> doc_id").join(shared, "doc_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b")))
    group = components(ids)
    of = of.join(group, F.col("class_id") == F.col("node"), "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "class_id"))
    # an id's rows without a set share the component of those with one
    low = of.filter("n_shingles > 0").join(shared_empty(signed), "doc_id").groupBy("doc_id").agg(F.min(own).alias("low"))
    of = of.withColumn("own", own).join(low, "doc_id", "left")
    return of.select("doc_id", "n_shingles", F.coalesce("own", "low", "doc_id").alias("component_id"))


def shared_empty(signed: DataFrame) -> DataFrame:
    """Ids that have rows without a set."""
    return common.few(signed.filter("n_shingles = 0 and doc_id is not null").select("doc_id").distinct())


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, hi and lo (of the set) and parities of each row."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(x, width) for x in common.texts(batch)]
            d = [_digest(s) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64()), pa.array([_parities(s) for s in sets], pa.binary())]
            return pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "hi", "lo", "parities"])

        return f

    return common.map_batches(rows, make, "doc_id long, n_shingles long, hi long, lo long, parities binary")


def _by_class(rows: DataFrame, classes: DataFrame, width: int, name: str, kind: str, value) -> DataFrame:
    """node and value(set) as a list of integers, from a row of each class that holds its least id. Rows whose id is the least
    of a class of another text are let go; repeated rows give repeated ones."""
    few = classes.select("class_id", "hi", "lo", "node")
    met = rows.join(few, rows["doc_id"] == few["class_id"]).select("text", "hi", "lo", "node")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, values = [], []
            for text, hi, lo, node in zip(common.texts(batch), *(batch.column(c).to_pylist() for c in ("hi", "lo", "node"))):
                s = shingle_set(text, width)
                if _digest(s) == (hi, lo):
                    nodes.append(node)
                    values.append(value(s).view(np.int64))
            ends = np.cumsum([0, *map(len, values)])
            flat = np.concatenate([np.zeros(0, np.int64), *values])
            return pa.record_batch([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["node", name])

        return f

    return common.map_batches(met, make, f"node long, {name} {kind}")


def _met(signs: DataFrame) -> DataFrame:
    """Of rows sign, node: those whose sign another node has too, with the least node of the sign. One shuffle; each task
    runs through its sorted rows and holds no group."""

    def run(batches):
        held = None  # the last row, while it may yet prove alone: sign, node
        least, last = None, None  # of the sign that is going on
        for b in batches:
            sign, node = b.column("sign").to_numpy(), b.column("node").to_numpy()
            if not len(sign):
                continue
            new = np.concatenate(([last is None or sign[0] != last], sign[1:] != sign[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(sign)), -1))
            low = np.where(start < 0, 0 if least is None else least, node[np.maximum(start, 0)])
            more = np.concatenate((~new[1:], [False]))  # the sign goes on after this row
            keep = ~new | more
            out = [(sign[keep], node[keep], low[keep])]
            if held is not None and not new[0]:
                out.insert(0, tuple(np.array([x], np.int64) for x in (*held, held[1])))
            held = (int(sign[-1]), int(node[-1])) if new[-1] else None
            last, least = sign[-1], int(low[-1])
            yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["sign", "node", "least"])

    return signs.repartition("sign").sortWithinPartitions("sign", "node").mapInArrow(run, "sign long, node long, least long")


def _links(rows: DataFrame, known: DataFrame, classes: DataFrame, width: int, signer: Signer) -> DataFrame:
    """a, b: pairs of nodes that link, enough of them to hold every component together."""
    spark = rows.sparkSession
    signs = _by_class(rows, common.hinted(classes), width, "signs", "array<long>", signer.signatures)
    met = common.cut(_met(signs.select("node", F.explode("signs").alias("sign"))))
    nodes = common.few(met.select("node").distinct())
    wanted = classes.join(nodes, "node", "left_semi")
    bounds = known.join(common.hinted(wanted), ["hi", "lo"]).filter("doc_id = class_id").select("node", F.col("n_shingles").alias("size"), "parities")
    bounds = common.cut(bounds.dropDuplicates(["node"]))

    # first each set against the least one of each signature: one of these, then those that are still apart
    stars = met.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    stars = common.cut(_hopeful(stars, bounds, signer))
    sets = common.cut(_sets_of(stars, rows, classes, width))
    first = common.cut(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = common.cut(_verified(first, sets, signer))
    group = components(links)
    links = common.cut(links.unionByName(_verified(_apart(stars.join(first, ["a", "b"], "left_anti"), group), sets, signer)))
    group = components(links)
    common.forget(spark, sets, first)

    # then, where a signature still has several components, all that are in different ones, in blocks
    held = met.join(group.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("sign", "node", F.coalesce("component", "node").alias("component"))
    # of two rows, the stars have decided
    open_ = held.groupBy("sign").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).filter("c1 < c2 and n > 2").select("sign", "low")
    # sets that are much alike share many signatures with one least set: there they are one group, in which a pair is tested once,
    # whatever the number of these. A bit for each signature tells most pairs that share none. The least set itself has been held against all
    one = F.expr("shiftleft(1L, cast(pmod(xxhash64(sign), 64) as int))")
    left = held.join(open_.select("sign", "low"), "sign").filter("node <> low").groupBy("low", "node").agg(F.min("component").alias("component"), F.bit_or(one).alias("signs"))
    left = common.cut(left)
    groups = left.groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2")
    blocks = F.ceil(F.col("n") / _BLOCK).cast("int")
    dealt = left.join(groups.select("low", blocks.alias("blocks")), "low").join(bounds, "node")
    # pairs of blocks are dealt over all tasks
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))))
    dealt = dealt.select("low", "pair.i", "pair.j", "node", "component", "size", "signs", (F.col("block") == F.col("pair.i")).alias("in_i"), (F.col("block") == F.col("pair.j")).alias("in_j"), "parities")
    dealt = dealt.repartition("low", "i", "j").sortWithinPartitions("low", "i", "j", "node")

    def near(rows: list[tuple]) -> tuple[list, list]:
        """Pairs of a piece (a group's sets in two blocks at most) in different components that share a signature and may link."""
        ids, comp, size, signs, in_i, in_j, odd = zip(*rows)
        ids, comp, size, signs, in_i, in_j = (np.array(x) for x in (ids, comp, size, signs, in_i, in_j))
        # the same coarse buckets for the whole piece, then the pair's own
        coarse = np.stack([_folded(x, _BUCKETS // 8) for x in odd]).view(np.uint64)
        fine = np.array([len(x) > _BUCKETS // 8 for x in odd])
        a, b = [], []
        for k in range(len(rows) - 1):
            rest = slice(k + 1, None)
            others = k + 1 + np.flatnonzero((comp[rest] != comp[k]) & (signs[rest] & signs[k] != 0) & (in_i[k] & in_j[rest] | in_j[k] & in_i[rest]))
            if len(others):
                d = np.bitwise_count(coarse[others] ^ coarse[k]).sum(1, dtype=np.int64)
                for o in others[_may_link(d, size[others], size[k], signer.percent)].tolist():
                    if not (fine[o] or fine[k]) or _may_link(_differ(odd[o], odd[k]), int(size[o]), int(size[k]), signer.percent):
                        a.append(int(ids[k]))  # rows are in the order of their nodes
                        b.append(int(ids[o]))
        return a, b

    def run(batches):
        at, rows = None, []
        for batch in batches:
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("low", "i", "j", "node", "component", "size", "signs", "in_i", "in_j", "parities")]
            for low, i, j, *row in zip(*columns):
                if (low, i, j) != at:
                    if len(rows) > 1:
                        for x, y in zip((a, b), near(rows)):
                            x += y
                    at, rows = (low, i, j), []
                rows.append(tuple(row))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if len(rows) > 1:
            a, b = near(rows)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    more = dealt.mapInArrow(run, "a long, b long").distinct()
    more = common.cut(more.join(stars, ["a", "b"], "left_anti"))
    common.forget(spark, met, bounds, stars, group, left)
    if not more.limit(1).count():
        return links
    sets = common.cut(_sets_of(more, rows, classes, width))
    links = common.cut(links.unionByName(_verified(more, sets, signer)))
    common.forget(spark, sets, more)
    return links


def _apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    c = lambda x: group.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    met = pairs.join(c("a"), "a", "left").join(c("b"), "b", "left")
    return met.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _sets_of(pairs: DataFrame, rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """node, elements of the sets that the pairs name."""
    wanted = common.few(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    wanted = common.hinted(classes.join(wanted, "node", "left_semi"))
    return _by_class(rows, wanted, width, "elements", "array<long>", lambda s: s).dropDuplicates(["node"])


def _hopeful(pairs: DataFrame, bounds: DataFrame, signer: Signer) -> DataFrame:
    """The pairs that neither sizes nor parities rule out."""
    met = pairs.join(bounds.selectExpr("node as a", "size as x", "parities as g"), "a").join(bounds.selectExpr("node as b", "size as y", "parities as h"), "b")
    met = met.filter(F.least("x", "y") * 100 >= F.greatest("x", "y") * signer.percent)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (batch.column(c).to_numpy() for c in "xy")
            d = np.array([_differ(g, h) for g, h in zip(batch.column("g").to_pylist(), batch.column("h").to_pylist())], np.int64)
            return pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(_may_link(d, x, y, signer.percent)))

        return f

    return common.map_batches(met.select("a", "b", "x", "y", "g", "h"), make, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, signer: Signer) -> DataFrame:
    """Those of the pairs (a, b) that link, by the sets themselves. A group is a set a and at most some _GROUP sets b: each b
    is sent once a pair, and a once a group. Tasks run through sorted rows and hold the set a alone."""
    sizes = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / _GROUP).cast("int").alias("groups"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"))
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(True).alias("centre"), F.col("a").alias("node"))
    needs = dealt.select("a", "part", F.lit(False).alias("centre"), F.col("b").alias("node")).unionByName(centres)
    met = needs.join(sets, "node").repartition("a", "part").sortWithinPartitions("a", "part", F.desc("centre"), "node").select("a", "centre", "node", "elements")

    def run(batches):
        at, own = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, common.BATCH_ROWS):
                b = batch.slice(k, common.BATCH_ROWS)
                e = b.column("elements")
                flat, ends = e.flatten().to_numpy().view(np.uint64), (e.offsets.to_numpy() - e.offsets[0].as_py()).tolist()
                left, right = [], []
                for i, (a, centre, node) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "centre", "node")))):
                    s = flat[ends[i] : ends[i + 1]]
                    if centre:
                        at, own = a, s.copy()
                    elif a != at:
                        raise ValueError("a set of a pair is missing")
                    elif 100 * min(len(own), len(s)) >= signer.percent * max(len(own), len(s)):
                        both = np.sort(np.concatenate([own, s]))
                        if signer.linked(int((both[1:] == both[:-1]).sum()), len(own), len(s)):
                            left.append(a)
                            right.append(node)
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are the least id of their component, with all their columns. Rows of one id go or stay
    together; rows with a null id or an empty set stay. An empty table gives an empty one."""
    found = ngram_join(docs, width, percent, id_col, text_col).filter("component_id is not null and doc_id <> component_id")
    gone = common.few(found.select("doc_id").distinct())
    return docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")
