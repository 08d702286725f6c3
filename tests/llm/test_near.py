"""Joins and dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tectra.llm import common, embedding_dedup, line_dedup, mph, ngram_join, queries
from tectra.llm.components import components
from tests.conftest import DATA
from tests.llm.conftest import ordered, rows_of, tuples

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def least_of(nodes, links):
    """The smallest node that each one reaches."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += near[x]
    return out


def brute_join(rows, width, percent):
    sets = []
    for i, text in rows:
        w = words_of((text or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t)]
    # rows of one id with different texts are nodes of the same name
    low = least_of({i for i, _ in sets if i is not None}, links)
    return sets, low


@pytest.mark.parametrize(("width", "percent", "small"), [(4, 85, False), (5, 80, True), (2, 60, True), (1, 100, False)])
def test_join(spark, width, percent, small, monkeypatch):
    """Also where signatures have several blocks and sets several tasks and groups."""
    if small:
        for name, value in (("_BLOCK", 3), ("_GROUP", 2)):
            monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(width * percent)
    base = [[f"w{r.randint(0, 60)}" for _ in range(r.choice([1, 3, 4, 5, 8, 20, 60, 200]))] for _ in range(30)]
    texts = [None, "", " \n", "A b", "a B"]
    for b in base:
        for _ in range(r.randint(1, 6)):
            c = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                c[r.randrange(len(c))] = f"x{r.randint(0, 9)}"
            texts.append(r.choice([" ", "\n", " \t"]).join(c if r.random() < 0.8 else map(str.upper, c)))
    r.shuffle(texts)
    rows = rows_of(texts)
    rows += [rows[7], (None, *rows[9][1:])]
    # ids that different texts share, and one whose other text has no words
    rows += [(rows[k][0], rows[k + 9][1], *rows[k][2:]) for k in (3, 20, 21, 40)] + [(rows[11][0], " ", *rows[11][2:]), (rows[12][0], "a text of its own alone", *rows[12][2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept int, n_lines double, pattern string, label string, row int, leaf int, words int, bucket int, component_id string, epoch string, hash string")
    sets, low = brute_join([x[:2] for x in rows], width, percent)
    want = ordered((i, len(s), low.get(i)) for i, s in sets)
    assert tuples(ngram_join.ngram_join(docs, width, percent), "doc_id", "n_shingles", "component_id") == want
    kept = Counter(i for i, _, c in want if i is None or i == c)
    assert Counter(x[0] for x in ngram_join.one_of_each(docs, width, percent).select("doc_id").collect()) == kept


def test_signatures_never_miss():
    """Sets that differ in any way that a link allows share a signature; the bound of the parities holds too."""
    r = np.random.default_rng(5)
    for percent in (60, 80, 85, 95):
        signer = ngram_join.Signer(percent)
        for _ in range(300):
            n = int(r.integers(1, 120))
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            most = [(x, y) for x in range(len(a)) for y in range(40) if 100 * (len(a) - x) >= percent * (len(a) + y)]
            x, y = most[int(r.integers(len(most)))]
            b = np.unique(np.concatenate([a[x:], r.integers(0, 1 << 63, y).astype(np.uint64)]))
            if len(a) != len(b) or (a != b).any():
                assert np.isin(signer.signatures(a), signer.signatures(b)).any()
            d = ngram_join._differ(ngram_join._parities(a), ngram_join._parities(b))
            assert d <= x + y and ngram_join._may_link(d, len(a), len(b), percent)


def test_signatures_of_long_sets():
    r = np.random.default_rng(6)
    for percent, n in ((80, 5000), (85, 3000)):
        signer = ngram_join.Signer(percent)
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        x = len(a) * (100 - percent) // 100
        y = (100 * (len(a) - x // 2) - percent * len(a)) // percent
        for b in (a[x:], np.unique(np.concatenate([a[x // 2 :], r.integers(0, 1 << 63, y).astype(np.uint64)]))):
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            assert np.isin(signer.signatures(a), signer.signatures(b)).any()
            d = ngram_join._differ(ngram_join._parities(a), ngram_join._parities(b))
            assert ngram_join._may_link(d, len(a), len(b), percent)
        c = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        d = ngram_join._differ(ngram_join._parities(a), ngram_join._parities(c))
        assert not ngram_join._may_link(d, len(a), len(c), percent)


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize(("size", "sets"), [(12, 700), (40, 700), (300, 1000), (3000, 200)])
def test_unrelated_sets_hardly_meet(percent, size, sets):
    """Under one pair in a thousand shares a signature."""
    r, signer, where = np.random.default_rng(size), ngram_join.Signer(percent), defaultdict(list)
    for i in range(sets):
        for x in signer.signatures(np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))).tolist():
            where[x].append(i)
    met = {(i, j) for v in where.values() if len(v) > 1 for i in v for j in v if i < j}
    assert len(met) < 0.001 * sets * (sets - 1) / 2


def test_join_of_repeated_ids(spark, empty):
    """An id with two texts links wherever one of them does."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    texts = [(1, a), (3, a), (3, b), (5, b.replace("b30", "c")), (6, a[::-1]), (6, "")]
    docs = spark.createDataFrame([(i, *rows_of([t])[0][1:]) for i, t in texts], empty.schema)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {(1, 57, 1), (3, 57, 1), (5, 57, 1), (6, 57, 6), (6, 0, 6)}


def test_join_of_little(spark, empty):
    assert ngram_join.ngram_join(empty).count() == ngram_join.one_of_each(empty).count() == 0
    one = spark.createDataFrame(rows_of(["only this one here"]), empty.schema)
    assert tuples(ngram_join.ngram_join(one), "doc_id", "n_shingles", "component_id") == [(1, 1, 1)]


def test_join_sql(spark, duck):
    want = duck("sf0.001").sql(queries.ORACLE_SQL["op3_ngram_join"]).fetchall()
    got = queries.op3_ngram_join(spark, f"{DATA}/sf0.001")
    assert tuples(got, "doc_id", "n_shingles", "component_id") == ordered(want)
    assert len({c for *_, c in want}) < len(want)


@pytest.mark.parametrize("broadcast_nodes", [None, 0])
def test_components(spark, broadcast_nodes):
    r = random.Random(1)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000 + k) for k in range(200)] + [(7, 7)]
    low = least_of({x for p in links if p[0] != p[1] for x in p}, links)
    got = components(spark.createDataFrame([*links, *links[:5], (None, 3)], "a long, b long"), broadcast_nodes=broadcast_nodes)
    assert tuples(got, "node", "component") == sorted(low.items())
    assert components(spark.createDataFrame([], "a long, b long"), broadcast_nodes=broadcast_nodes).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, n string, kept string, class_id int, links string, v int, x string"


def brute_vectors(rows, threshold):
    ok = []
    for i, v, label, *_ in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            ok.append((i, x / np.sqrt(x @ x), label))
    links, n = [], Counter()
    for k, (a, x, la) in enumerate(ok):
        for b, y, lb in ok[:k]:
            if la == lb and len(x) == len(y) and x @ y >= threshold:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    low = least_of([r[0] for r in rows], links)
    return ordered((r[0], n[r[0]], low[r[0]], low[r[0]] == r[0]) for r in rows)


@pytest.mark.parametrize("tile", [3, 1024])
@pytest.mark.parametrize("dims", [1, 2, 24])
def test_vectors(spark, dims, tile):
    r = np.random.default_rng(dims)
    centres = r.normal(size=(12, dims))
    vs = [(c + r.normal(size=dims) * r.choice([0, 0.03, 0.1, 0.2]) * np.linalg.norm(c) / dims**0.5).tolist() for c in centres for _ in range(9)]
    vs += [None, [], [0.0] * dims, [-0.0] * dims, [None, *[1.0] * (dims - 1)], [float("nan")] * dims, [float("inf"), *[1.0] * (dims - 1)], [1e-30] * dims, [1e30] * dims, vs[0], vs[0], [2 * x for x in vs[0]], [1.0] * (dims + 1), [1.0] * (dims + 1)]
    rows = [(i, v, [1, 1, 1, 2, None][i % 5] if i < 100 else 1, "n", "k", 0, "l", 1, "x") for i, v in enumerate(vs)]
    r.shuffle(vs)
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, VECTORS), tile=tile)
    assert tuples(got, "vec_id", "n_links", "component_id", "kept") == brute_vectors(rows, 0.98)


def test_vectors_of_little(spark):
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], VECTORS)).count() == 0
    none = spark.createDataFrame([(1, None, 1, *"nk", 0, "l", 1, "x"), (None, [1.0], 1, *"nk", 0, "l", 1, "x")], VECTORS)
    got = embedding_dedup.embedding_dedup(none)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()} == {(1, 0, 1, True), (None, 0, None, False)}


def test_vectors_sql(spark, duck):
    want = duck("sf0.001").sql(queries.ORACLE_SQL["op2_embedding_dedup"]).fetchall()
    assert tuples(queries.op2_embedding_dedup(spark, f"{DATA}/sf0.001"), "vec_id", "n_links", "component_id", "kept") == ordered(want)


def brute_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    of = [(k, i, (t or "").split("\n")) for k, (i, t) in enumerate(rows)]
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    for k, i, lines in of:
        for x in lines:
            if len(key(x)) >= min_chars:
                holders[key(x)].add((i is not None, i or 0, k))
    out = []
    for _, i, lines in of:
        gone = [len(holders[key(x)]) >= min_docs and max(holders[key(x)])[:2] != (i is not None, i or 0) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_lines(spark, odd, broadcast_bytes, monkeypatch):
    """Over many shards, some of which go to several tasks, and with drops broadcast or joined."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    monkeypatch.setattr(line_dedup, "PROBES", 10)
    r = random.Random(2)
    lines = [f"a line that {k} documents or so may hold" for k in range(30)] + ["short", "", "x" * 19, "é" * 20, "É" * 20, "  \tPADDED line that is long enough  "]
    texts = ["\n".join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in r.choices(lines, k=r.randint(1, 8))) for _ in range(60)]
    docs = odd.unionByName(spark.createDataFrame(rows_of(texts, 1000), odd.schema))
    want = brute_lines([tuple(x) for x in docs.select("doc_id", "text").collect()])
    got = line_dedup.line_digests(docs, broadcast_bytes=broadcast_bytes)
    assert tuples(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    whole = line_dedup.dedup_lines(docs, broadcast_bytes=broadcast_bytes)
    assert whole.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert tuples(whole, "doc_id", "n_lines", "n_dropped") == ordered(x[:3] for x in want)


def test_lines_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_sql(spark, duck):
    want = duck("sf0.001").sql(queries.ORACLE_SQL["op7_line_dedup"]).fetchall()
    got = queries.op7_line_dedup(spark, f"{DATA}/sf0.001")
    assert tuples(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == ordered(want) and sum(x[2] for x in want)


def test_perfect_hash():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 1000, 20_000):
        hi, lo = r.integers(0, 1 << 63, n).astype(np.uint64), np.arange(n, dtype=np.uint64)
        ph = mph.PerfectHash.from_bytes(mph.PerfectHash.build(hi, lo).to_bytes())
        assert sorted(ph.index(hi, lo).tolist()) == list(range(n))
        others = ph.index(hi, lo + np.uint64(n + 1))
        assert ((others >= -1) & (others < max(1, n))).all()
    with pytest.raises(ValueError):
        mph.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_few(spark):
    assert common.few(spark.range(5).select("id"), 3).count() == common.few(spark.range(5).select("id")).count() == 5


def test_vectors_of_many_lengths(spark, monkeypatch):
    """Each length has its links, however many shorter ones there are, and with axes or without."""
    r = np.random.default_rng(5)
    vs = [r.normal(size=d).tolist() for d in range(1, 111)]
    for d in (30, 120):
        for c in r.normal(size=(40, d)):
            vs += [(c + r.normal(size=d) * s).tolist() for s in (0, 0.05, 0.15, 0.2)]
    rows = [(i, v, 1, "n", "k", 0, "l", 1, "x") for i, v in enumerate(vs)]
    want = brute_vectors(rows, 0.98)
    assert sum(x[1] > 0 for x in want if x[0] >= 270) > 20
    for most in (1 << 22, 1000):
        monkeypatch.setattr(embedding_dedup, "AXES_CELLS", most)
        got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, VECTORS))
        assert tuples(got, "vec_id", "n_links", "component_id", "kept") == want


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_lines_of_repeated_ids(spark, empty, broadcast_bytes):
    """A line needs min_docs ids, not rows."""
    two, three = "a line that two documents hold in three rows", "a line that three documents hold in four rows"
    rows = [*rows_of([two, two], 1), *rows_of([two], 1), *rows_of([three] * 3, 10), *rows_of([three], 10)]
    rows += [(None, three + x, *rows[0][2:]) for x in ("!", "!", "!")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, empty.schema), broadcast_bytes=broadcast_bytes)
    assert tuples(got, "doc_id", "n_dropped") == ordered([(1, 0), (1, 0), (2, 0), (10, 1), (10, 1), (11, 1), (12, 0), *[(None, 0)] * 3])


def test_line_index_holds_every_line(spark, empty, monkeypatch):
    """Each distinct line has a place of its own with its count, and lines that aren't there are turned away."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    lines = [f"a line that stands by itself, number {k}" for k in range(40)]
    docs = spark.createDataFrame(rows_of(["\n".join(lines[k : k + 3]) for k in range(38)]), empty.schema)
    found = line_dedup.document_lines(docs, 20)
    index, n = line_dedup.line_index(found)
    counts, places = {r.lo: r.n for r in found.groupBy("hi", "lo").count().withColumnRenamed("count", "n").collect()}, 0
    rows = {(r.hi, r.lo) for r in found.select("hi", "lo").distinct().collect()}
    assert n == 8 and len(rows) == 40
    for r in index.collect():
        shard = line_dedup.Shard(*(bytes(x) for x in r[1:]))
        own = [x for x in rows if x[0] % n == r.shard]
        hi, lo = (np.array([x[k] for x in own], np.int64).view(np.uint64) for k in (0, 1))
        at = shard.hash.index(hi, lo)
        assert sorted(at.tolist()) == list(range(len(own)))
        assert shard.counts[at].tolist() == [counts[x[1]] for x in own]
        assert not shard.drops(hi, lo + np.uint64(1), np.full(len(hi), -5), 1).any()
        places += len(own)
    assert places == 40


def test_lines_with_clashing_columns(spark, empty):
    three = "a line that three documents hold"
    docs = spark.createDataFrame([(i, three, "x", None, [1]) for i in range(4)], "doc_id long, text string, row string, gone string, id array<int>")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.row, r.id) for r in got.collect()) == [(0, "", "x", [1]), (1, "", "x", [1]), (2, "", "x", [1]), (3, three, "x", [1])]


def test_no_scratch_folder_of_one_machine_on_a_cluster(tmp_path):
    """Where the cluster names no shared folder, none is made up."""
    from types import SimpleNamespace

    def named(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    assert common.scratch_dir(named("spark://one:7077", str(tmp_path))).startswith(f"{tmp_path}/tectra-")
    assert common.scratch_dir(named("local[2]", None))
    with pytest.raises(ValueError):
        common.scratch_dir(named("spark://one:7077", None))


def test_joined_columns_of_any_name(spark, empty):
    """Columns named as the join's own ones don't clash."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, text, 1, 2, 3) for k in range(3)], "doc_id long, text string, node long, component long, class_id long")
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(0, text, 1, 2, 3)]


def test_join_of_one_template(spark):
    """Pages of one template below the threshold share many signatures and link with nothing; a few that are above it are found among them."""
    import random

    r = random.Random(3)
    frame = [f"c{r.randint(0, 10**6)}" for _ in range(230)]

    def page(k, own):
        words = list(frame)
        for n in range(own):
            words.insert((n + 1) * (230 // own), f"o{k}x{n}")
        return " ".join(words)

    rows = [(k, page(k, 21)) for k in range(700)] + [(1000 + k, page(k % 7, 21) + f" tail{k}") for k in range(14)]
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {k: k for k in range(700)} | {1000 + k: k % 7 for k in range(14)}
