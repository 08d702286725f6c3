"""Repair of a conversation's structure by a min-plus scan.

Valid conversations are `(s?(ua)+)?` in the initials of their roles: an automaton of four states (nothing yet, after system,
after user, after assistant). Each turn is a 4x4 matrix of (cost, audit) elements: from state to state by inserted turns and one
edit of this turn. Products take the least (cost, audit); they are associative, so turns are multiplied in a tree, within a task
and, for a conversation that several tasks hold parts of, over tasks.

Of two audits of equal cost for the same turns neither begins the other (they would differ by inserts alone, which cost), so the
least of both stays the least whatever follows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_BLANKS = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after each turn that may come next: from nothing a system or user turn, and so on.
_NEXT = {_START: {"s": _SYSTEM, "u": _USER}, _SYSTEM: {"u": _USER}, _USER: {"a": _ASSISTANT}, _ASSISTANT: {"u": _USER}}
#: The one turn of user or assistant that each state allows; inserted and reroled turns can be no other.
_ONLY = {_START: ("user", _USER), _SYSTEM: ("user", _USER), _USER: ("assistant", _ASSISTANT), _ASSISTANT: ("user", _USER)}
_LEGAL = {"su", "ua", "au"}
#: A turn's code: a letter of initials s, u, a or other, by its first fault.
_INITIALS, _FAULTS = "suax", ("none", "blank", "duplicate", "truncated")
_CODES = {(i, f): chr(65 + 4 * k + j) for k, f in enumerate(_FAULTS) for j, i in enumerate(_INITIALS)}
_MEANS = {c: x for x, c in _CODES.items()}
#: Turns of a block whose product is remembered, and segments that one step of the tree over tasks multiplies.
BLOCK, FAN = 8, 16
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()

Matrix = tuple  # of 16 elements, None or (cost, audit)


def times(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        row = [(k, x) for k, x in enumerate(a[i : i + 4]) if x is not None]
        for j in range(4):
            best = None
            for k, (cost, audit) in row:
                y = b[4 * k + j]
                if y is not None and (best is None or cost + y[0] <= best[0]):
                    z = (cost + y[0], audit + y[1])
                    if best is None or z < best:
                        best = z
            out.append(best)
    return tuple(out)


def _closure() -> Matrix:
    """Any number of inserts; more than two in a row only lead back at a cost."""
    step = tuple((INSERT, "I") if _ONLY[i][1] == j else None for i in range(4) for j in range(4))
    one = tuple((0, "") if i == j else None for i in range(4) for j in range(4))
    both = tuple(min((x for x in p if x is not None), default=None) for p in zip(one, step))
    return times(both, both)


INSERTS = _closure()


def _turn(initial: str, fault: str) -> Matrix:
    """Inserts, then the edit of one turn."""
    found: list = [None] * 16
    more = TRUNCATED if fault == "truncated" else 0
    for i in range(4):
        ways = [(i, (DELETE, "D"))]
        if fault not in ("blank", "duplicate"):
            ways.append((_ONLY[i][1], (REROLE + more, "R")))
            if initial in _NEXT[i]:
                ways.append((_NEXT[i][initial], (KEEP + more, "K")))
        for j, way in ways:
            if found[4 * i + j] is None or way < found[4 * i + j]:
                found[4 * i + j] = way
    return times(INSERTS, tuple(found))


_TURNS = {c: _turn(*x) for c, x in _MEANS.items()}


@lru_cache(1 << 16)
def _block(codes: str) -> Matrix:
    if len(codes) == 1:
        return _TURNS[codes]
    mid = len(codes) // 2
    return times(_block(codes[:mid]), _block(codes[mid:]))


def product(matrices: list[Matrix]) -> Matrix:
    """In a tree: each level multiplies neighbours."""
    while len(matrices) > 1:
        matrices = [times(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def of_codes(codes: str) -> Matrix:
    return product([_block(codes[k : k + BLOCK]) for k in range(0, len(codes), BLOCK)])


def cheapest(matrix: Matrix | None) -> tuple[int, str]:
    """The least (cost, audit) from nothing to an accepting state, with inserts after the last turn."""
    if matrix is None:
        return 0, ""
    whole = times(matrix, INSERTS)
    return min(x for x in (whole[_START], whole[_ASSISTANT]) if x is not None)


def illegal(codes: str) -> int:
    initials = [_MEANS[c][0] for c in codes]
    return sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:]))


def fault_count(codes: str, fault: str) -> int:
    return sum(codes.count(_CODES[i, fault]) for i in _INITIALS)


class Repairer:
    """Follows an audit turn by turn; `lines` gives what stands before and at each turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _START

    def inserted(self) -> list[str]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = _ONLY[self.state]
            out.append(f"{role}:")
            self.at += 1
        return out

    def lines(self, role: str, text: str) -> list[str]:
        out = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return out
        if edit == "R":
            role, self.state = _ONLY[self.state]
        else:
            self.state = _NEXT[self.state][role[0]]
        out.append(f"{role}:{text}")
        return out


class _Digest:
    def __init__(self):
        self.h, self.any = hashlib.sha256(), False

    def add(self, lines: list[str]) -> None:
        for x in lines:
            self.h.update((("\n" if self.any else "") + x).encode())
            self.any = True


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, and dropped ones marked `gone`: conv_id, turn, role, text, gone."""
    conv, turn = (F.col(c).cast("long") for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("harm"))
    harm = F.col("harm")
    rows = rows.withColumn("copy", F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(harm <= 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (harm == 0).alias("gone"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds `initial` and `fault`, none, blank or truncated; duplicates take the whole conversation to see."""
    end = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    fault = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("none")
    first = F.substring("role", 1, 1)
    return rows.withColumn("initial", F.when(first.isin("s", "u", "a"), first).otherwise("x")).withColumn("fault", fault)


#: A task's output: kind 0 are results; kind 1 are rows of conversations that other tasks may hold rows of.
_FIRST = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("i", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_()), ("initial", pa.string()), ("fault", pa.string()), *((x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _RESULT.split(", ")[1:])])
_FIRST_DDL = ", ".join(f"{f.name} {dict(int32='int', int64='long', string='string', bool='boolean')[str(f.type)]}" for f in _FIRST)
_READ = ["conv_id", "turn", "role", "text", "gone", "initial", "fault"]


def _gaps(turns) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _whole(conv, rows: list[tuple]) -> tuple:
    """The result of a conversation whose rows are all here, in order."""
    live = [r for r in rows if not r[4]]
    if not live:
        return conv, 0, 0, 0, 0, 0, 0, "", _NONE
    seen, codes = set(), []
    for r in live:
        said = r[2:4]
        fault = "duplicate" if r[6] != "blank" and said in seen else r[6]
        seen.add(said)
        codes.append(_CODES[r[5], fault])
    codes = "".join(codes)
    cost, audit = cheapest(of_codes(codes))
    digest, repairer = _Digest(), Repairer(audit)
    for r in live:
        digest.add(repairer.lines(r[2], r[3]))
    digest.add(repairer.inserted())
    return conv, _gaps(r[1] for r in live), *(fault_count(codes, f) for f in _FAULTS[1:]), illegal(codes), cost, audit, digest.h.hexdigest()


def _first_rows(rows, part: int):
    """Conversations within a task are finished; rows of its first and last go on, those of the first without being kept."""
    i, held = 0, []
    for k, (_, group) in enumerate(groupby(rows, key=itemgetter(0))):
        if k == 0:
            for r in group:
                yield (1, part, i, *r, *[None] * 8)
                i += 1
            continue
        if held:
            done = _whole(held[0][0], held)
            yield (0, None, None, done[0], *[None] * 6, *done[1:])
        held = list(group)
    for r in held:
        yield (1, part, i, *r, *[None] * 8)
        i += 1


def _first_pass(batches):
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _READ)))
    out = _first_rows(rows, TaskContext.get().partitionId())
    while some := list(islice(out, common.BATCH_ROWS)):
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*some), _FIRST)], schema=_FIRST)


_SEGMENT = "conv_id long, seq long, first string, last string, illegal long, blank long, duplicate long, truncated long, " + ", ".join(f"c{k} long, a{k} string" for k in range(16))


def _flat(m: Matrix) -> list:
    return [y for x in m for y in (x or (None, None))]


def _unflat(row) -> Matrix:
    return tuple(None if row[2 * k] is None else (row[2 * k], row[2 * k + 1]) for k in range(16))


def _record(rows: list[list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    return pa.record_batch([pa.array(x, pa.string() if n in ("first", "last") or n[0] == "a" and n[1:].isdigit() else pa.int64()) for n, x in zip(names, zip(*rows))], names)


def _segments(batches):
    for b in batches:
        rows = [[conv, seq, _MEANS[s[0]][0], _MEANS[s[-1]][0], illegal(s), *(fault_count(s, f) for f in _FAULTS[1:]), *_flat(of_codes(s))] for conv, seq, s in zip(*(b.column(c).to_pylist() for c in ("conv_id", "seq", "codes")))]
        if rows:
            yield _record(rows)


def _joined(table: pa.Table) -> pa.Table:
    """FAN neighbouring segments at most, as one."""
    rows = sorted(zip(*(c.to_pylist() for c in table.columns)), key=lambda r: r[1])
    edges = sum(a[3] + b[2] not in _LEGAL for a, b in zip(rows, rows[1:]))
    sums = [sum(r[k] for r in rows) for k in range(4, 8)]
    out = [rows[0][0], rows[0][1] // FAN, rows[0][2], rows[-1][3], sums[0] + edges, *sums[1:], *_flat(product([_unflat(r[8:]) for r in rows]))]
    return pa.Table.from_batches([_record([out])])


def _reduced(segments: DataFrame) -> DataFrame:
    """One segment a conversation, by rounds over groups of FAN neighbours."""
    segments = common.cut(segments)
    while segments.agg(F.max("seq")).first()[0]:
        up = F.floor(F.col("seq") / FAN)
        again = common.cut(segments.groupBy("conv_id", up).applyInArrow(_joined, _SEGMENT))
        common.forget(segments.sparkSession, segments)
        segments = again
    return segments


def _costs(batches):
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    for b in batches:
        rows = list(zip(*(b.column(c).to_pylist() for c in names)))
        best = [cheapest(_unflat(r[8:])) for r in rows]
        yield pa.record_batch([b.column("conv_id"), *(b.column(c) for c in ("blank", "duplicate", "truncated", "illegal")), pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.string())], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _second_pass(batches):
    """Rows of a conversation come in order after its result so far, and are followed without being kept."""
    head, digest, repairer, out = None, None, None, []

    def done():
        digest.add(repairer.inserted())
        out.append((*head, digest.h.hexdigest()))

    names = [x.split()[0] for x in _RESULT.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in _RESULT.split(", ")]
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in [*names[:8], "part", "role", "text"])):
            if r[8] < 0:
                if head is not None:
                    done()
                head, digest, repairer = r[:8], _Digest(), Repairer(r[7])
            else:
                digest.add(repairer.lines(r[9], r[10]))
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
            out = []
    if head is not None:
        done()
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names)


def _spread(rows: DataFrame) -> DataFrame:
    """Results of conversations whose rows several tasks held: faults by key, matrices by task, then a tree over tasks.

    Only the digest of a repaired conversation is one task's work, row after row, as SHA-256 has no other way; no row is kept there.
    """
    live = rows.filter("NOT gone").withColumn("key", F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    place = F.struct("part", "i")
    again = live.groupBy("key").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "at")
    found = live.select("conv_id", "part", "i", "initial", "fault", "key").join(again, "key", "left")
    fault = F.when((F.col("fault") != "blank") & (place > F.col("at")), "duplicate").otherwise(F.col("fault"))
    number = F.when(fault == "none", 0).when(fault == "blank", 4).when(fault == "duplicate", 8).otherwise(12) + F.expr(f"instr('{_INITIALS}', initial) - 1")
    codes = found.select("conv_id", "part", F.struct("i", F.char(number + 65).alias("c")).alias("x")).groupBy("conv_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]), "").alias("codes"))
    parts = codes.withColumn("seq", (F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1).cast("long"))
    matrices = _reduced(parts.select("conv_id", "seq", "codes").mapInArrow(_segments, _SEGMENT))
    costs = matrices.mapInArrow(_costs, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    turn = F.when(~F.col("gone"), F.col("turn"))
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "conv")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    heads = turns.join(costs, F.col("conv").eqNullSafe(F.col("conv_id")), "left").select(F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"))
    heads = heads.select("*", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("i"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(rows.filter("NOT gone").select("conv_id", "part", "i", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "i").mapInArrow(_second_pass, _RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """Repairs conversations of rows (conv_id, turn, role, text, gone); see `turn_repair`. Rows are sorted in ranges of (conv_id, turn, role,
    text's beginning), so that tasks share a conversation of any length."""
    order = ["conv_id", "turn", "role"]
    ranged = with_faults(rows).repartitionByRange(*order, F.left("text", F.lit(24))).sortWithinPartitions(*order, "text")
    first = common.cut(ranged.select(_READ).mapInArrow(_first_pass, _FIRST_DDL))
    names = [x.split()[0] for x in _RESULT.split(", ")]
    shared = first.filter("kind = 1").select("part", "i", "conv_id", "turn", "role", "text", "gone", "initial", "fault")
    return first.filter("kind = 0").select(names).unionByName(_spread(shared).select(names))


def turn_repair(conversations: DataFrame) -> DataFrame:
    """Per conversation, after the set damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Nulls in role and text, and in the key of the damage, are one space; a null conv_id is a conversation of its own. A null turn stands first;
    rows of one turn stand by role, then text. A conversation that loses all its rows has zeros, an empty audit and the digest of nothing. An
    empty table gives an empty one; other columns are ignored.
    """
    return repair(damaged(conversations))
