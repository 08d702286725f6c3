"""The prefix trie and turn repair against brute force over conversations of all kinds."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tectra.llm import conversation_sql, prefix_trie, turn_repair
from tests.llm.conftest import ordered

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key int, part string, cost string, audit int, gone string"


def conversation_rows(seed=0):
    r = random.Random(seed)
    said = ["a.", "b!", "no end", "", " ", "\t\n", "same.", "same.", None, "é。", "x" * 50_000 + "?", "trailing.  \n", "... "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [*range(60), *range(100, 130), 200, 300, 305, 1234, -1, -105, 10**12]:
        for turn in range(r.choice([1, 2, 3, 3, 5, 8, 14])):
            # neighbours share beginnings; a third of all conversations is the same
            if conv % 3 == 0:
                rows.append((conv, turn, ("user", "assistant")[turn % 2], f"turn {turn}."))
            else:
                rows.append((conv, r.choice([turn, turn, turn, None]), r.choice(roles), r.choice(said)))
    rows += [(200, t, ("user", "assistant")[t % 2], f"long {t % 7}.") for t in range(400)]
    rows += [(None, 0, "user", "nobody's."), (None, 1, "assistant", "nobody's."), (1234, 2, "user", "same turn b."), (1234, 2, "user", "same turn a."), (1234, 2, "user", "same turn a.")]
    return [(*x, "d", 1, "p", "c", 2, "g") for x in rows]


@pytest.fixture(scope="module")
def talks(spark):
    rows = conversation_rows()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(params=["", "many tasks"])
def tasks(spark, request):
    """Once with few tasks, once with tasks of a few rows each, over which conversations and nodes are spread."""
    if request.param:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def first_null(x):
    return (x is not None, x or 0)


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn, (role or "", text or "")))
    digest = lambda x: hashlib.md5(f"{len(x[0])}:{x[0]}{x[1]}".encode()).hexdigest()
    own = {c: [x for _, x in sorted(v, key=lambda y: (first_null(y[0]), digest(y[1])))] for c, v in turns.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, x in full.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    out = []
    children, below = defaultdict(int), defaultdict(list)
    for x in members:
        if x:
            children[x[:-1]] += 1
        for d in range(len(x) + 1):
            below[x[:d]].append(x)
    for x, m in members.items():
        saved = sum((len(members[y]) - 1) * len(y[-1][1]) for y in below[x] if y)
        ends = sorted(c for c in m if len(full[c]) == len(x))
        out.append((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), children[x], sum(not children[y] for y in below[x]), saved, sha(",".join(map(str, ends)))))
    return ordered(out)


def brute_repair(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by[conv] += []
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = "".join(x for x in text if x not in ".!?")
        if harm == 4:
            role = "user"
        by[conv] += [(turn, role, text)] * (2 if harm == 3 else 1)
    out = []
    for conv, found in by.items():
        found = sorted(found, key=lambda x: (first_null(x[0]), x[1].encode(), x[2].encode()))
        out.append((conv, *brute_one(found)))
    return ordered(out)


def brute_one(found):
    seen, faults = set(), []
    for _, role, text in found:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    # every way, kept as (cost, audit, initials so far as one of '', 's', 'u', 'a', repaired lines): breadth by rows, no matrices
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserts(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                for x in allowed[state]:
                    if x in names:
                        new = (cost + 5, audit + "I", [*lines, names[x] + ":"])
                        if x not in ways or new[:2] < ways[x][:2]:
                            ways[x] = new
        return ways

    ways = {"": (0, "", [])}
    for (_, role, text), fault in zip(found, faults):
        after = {}
        for state, (cost, audit, lines) in inserts(ways).items():
            new = [(state, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in allowed[state]:
                    new.append((role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
                new += [(x, (cost + 1 + more, audit + "R", [*lines, f"{names[x]}:{text}"])) for x in allowed[state] if x in names]
            for x, way in new:
                if x not in after or way[:2] < after[x][:2]:
                    after[x] = way
        ways = after
    cost, audit, lines = min(x for s, x in inserts(ways).items() if s in ("", "a"))
    turns = {t for t, *_ in found if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines))


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_trie(talks, tasks):
    rows, df = talks
    assert ordered(tuple(r) for r in prefix_trie.prefix_trie(df).select(TRIE).collect()) == brute_trie(rows)


def test_repair(talks, tasks):
    rows, df = talks
    assert ordered(tuple(r) for r in turn_repair.turn_repair(df).select(REPAIR).collect()) == brute_repair(rows)


def test_sql(talks):
    rows, _ = talks
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [x[:4] for x in rows])
    assert ordered(con.sql(f"SELECT {', '.join(TRIE)} FROM ({conversation_sql.trie_sql()})").fetchall()) == brute_trie(rows)
    assert ordered(con.sql(f"SELECT {', '.join(REPAIR)} FROM ({conversation_sql.repair_sql()})").fetchall()) == brute_repair(rows)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(none).count() == turn_repair.turn_repair(none).count() == 0


def all_repairs(kinds):
    """Costs and audits of every edit sequence with at most two inserts between rows, kept if valid: no automaton."""
    import itertools
    import re

    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    per_row = []
    for initial, fault in kinds:
        more = 5 if fault == "truncated" else 0
        ways = [(2, "D", "")]
        if fault not in ("blank", "duplicate"):
            ways += [(more, "K", initial), (1 + more, "R", "u"), (1 + more, "R", "a")]
        per_row.append([(5 * len(g) + c, "I" * len(g) + e, g + s) for g in gaps for c, e, s in ways])
    per_row.append([(5 * len(g), "I" * len(g), g) for g in gaps])
    for way in itertools.product(*per_row):
        if re.fullmatch("(s?(ua)+)?", "".join(x[2] for x in way)):
            yield sum(x[0] for x in way), "".join(x[1] for x in way)


KIND = st.tuples(st.sampled_from("suax"), st.sampled_from(["none", "blank", "duplicate", "truncated"]))


@settings(max_examples=40, deadline=None)
@given(st.lists(KIND, min_size=1, max_size=3))
def test_least_of_all_edits(kinds):
    codes = "".join(turn_repair._CODES[k] for k in kinds)
    assert turn_repair.cheapest(turn_repair.of_codes(codes)) == min(all_repairs(kinds))


@settings(max_examples=60, deadline=None)
@given(st.lists(KIND, min_size=1, max_size=60), st.data())
def test_any_tree(kinds, data):
    """Products don't depend on where the turns are cut."""
    codes = "".join(turn_repair._CODES[k] for k in kinds)
    cuts = sorted({0, len(codes), *data.draw(st.lists(st.integers(0, len(codes)), max_size=5))})
    parts = [turn_repair.of_codes(codes[a:b]) for a, b in zip(cuts, cuts[1:])]
    assert turn_repair.product(parts) == turn_repair.of_codes(codes)
