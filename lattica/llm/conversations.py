"""Conversation structure repair (operator 11): the cheapest edits by lazy weighted determinisation.

A conversation's roles must begin with `s?(ua)+` by their initials, or be none.  Each row is kept, given the role that is due,
or deleted, and empty rows are inserted, each at a cost.  The four states of that pattern with the least cost of
reaching each make a vector; less its least cost, a vector is a state of a deterministic automaton.  Its transitions by
what matters of a row (initial, fault) are made when first asked for and kept in a table, so that a scan of table lookups
gives a conversation's cost.  States that can't be on a cheapest path are left out of vectors, hence there are only a few
dozen.  A trace backward over tight arcs (those that a cheapest path may use) then marks states, and the
ASCII-least edits are read along marked ones.

Rows are range-sorted by conversation and turn into parts.  A conversation of any length may lie in several: the costs
between all pairs of states at a part's ends are combined along its parts, which gives each the costs of what precedes
and follows it; then each is traced by itself.  Only the SHA-256 of a text, sequential by its nature, is taken in one
task, from a stream of its lines.

Defined results: null ids are a conversation of their own; null turns come first; null roles and texts are one space. Rows of
one turn are taken by role, then by a hash of the text.  Of repeated rows all but the first are duplicates.  Only
conv_id, turn, role and text are read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .parts import in_parts, segments

#: States of the pattern: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
#: The state that a user or assistant row leads to, whichever is due.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 10**9
GOOD, CUT, GONE = range(3)  # kinds of rows: whole, truncated, to be deleted
INITIALS = "sua"
#: Rows in a part, about.
PART_ROWS = 40_000


def symbol(initial: str, kind: int) -> int:
    """What the edits of a row depend on."""
    return kind * 4 if kind == GONE else kind * 4 + INITIALS.find(initial[:1] or "-") + 1


def keeps(state: int, initial: str) -> int | None:
    """Where a row that is kept leads from a state."""
    if initial == "s" and state == START:
        return SYSTEM
    if initial and initial in "ua" and ROLE[DUE[state]][0] == initial:
        return DUE[state]
    return None


def arcs(state: int, sym: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state) of a row's edits, ASCII-least first."""
    kind, at = divmod(sym, 4)
    yield "D", DELETE, state
    if kind != GONE:
        kept = keeps(state, INITIALS[at - 1] if at else "")
        if kept is not None:
            yield "K", TRUNCATED * (kind == CUT), kept
        yield "R", REROLE + TRUNCATED * (kind == CUT), DUE[state]


def with_inserts(costs: list[int]) -> list[int]:
    for _ in range(2):  # at most two in a row
        for q in STATES:
            costs[DUE[q]] = min(costs[DUE[q]], costs[q] + INSERT)
    return costs


#: Costs of ending from each state.
END_COSTS = (0, 2 * INSERT, INSERT, 0)


@dataclass
class Automaton:
    """Normalised vectors as numbered states, with a table of transitions that is filled on demand."""

    vectors: list[tuple[int, ...]] = field(default_factory=list)
    number: dict[tuple[int, ...], int] = field(default_factory=dict)
    table: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    marks: dict[tuple[int, int, int], int] = field(default_factory=dict)
    moves: dict[tuple[int, int, int, int, int], tuple[str, int]] = field(default_factory=dict)

    def state(self, costs: list[int] | tuple[int, ...]) -> tuple[int, int]:
        """(state, least cost).  From `ASSISTANT` all goes on as from `SYSTEM`, and as from `START` but for a system
        row, which is then deleted; so these two, where dearer by more than that, are on no cheapest path."""
        costs = with_inserts(list(costs))
        if costs[SYSTEM] > costs[ASSISTANT]:
            costs[SYSTEM] = NEVER
        if costs[START] > costs[ASSISTANT] + DELETE:
            costs[START] = NEVER
        low = min(costs)
        vector = tuple(c - low if c < NEVER else NEVER for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], low

    def step(self, at: int, sym: int) -> tuple[int, int]:
        """(next state, cost) of a row."""
        found = self.table.get((at, sym))
        if found is None:
            costs = [NEVER] * 4
            for q, c in enumerate(self.vectors[at]):
                if c < NEVER:
                    for _, w, to in arcs(q, sym):
                        costs[to] = min(costs[to], c + w)
            found = self.table[at, sym] = self.state(costs)
        return found

    def scan(self, at: int, symbols: list[int]) -> tuple[list[int], int]:
        """The states along the rows, the first included, and the sum of costs."""
        seen, total = [at], 0
        for sym in symbols:
            at, cost = self.step(at, sym)
            seen.append(at)
            total += cost
        return seen, total

    def _inserting(self, at: int, mask: int) -> int:
        """The states from which tight inserts lead to marked ones, besides these."""
        v = self.vectors[at]
        for _ in range(2):
            for q in STATES:
                if v[q] < NEVER and v[q] + INSERT == v[DUE[q]] and mask >> DUE[q] & 1:
                    mask |= 1 << q
        return mask

    def back(self, at: int, sym: int, mask: int) -> int:
        """The states before a row from which tight arcs lead to the marked ones behind it."""
        found = self.marks.get((at, sym, mask))
        if found is None:
            to, cost = self.step(at, sym)
            v, w = self.vectors[at], self.vectors[to]
            found = sum(1 << q for q in STATES if v[q] < NEVER and any(mask >> r & 1 and v[q] + c == w[r] + cost for _, c, r in arcs(q, sym)))
            found = self.marks[at, sym, mask] = self._inserting(at, found)
        return found

    def trace(self, seen: list[int], symbols: list[int], to_go: tuple[int, ...] | list[int]) -> list[int]:
        """Marked states along the rows, given the costs of what follows."""
        last = self.vectors[seen[-1]]
        best = min(c + g for c, g in zip(last, to_go, strict=True))
        mask = self._inserting(seen[-1], sum(1 << q for q in STATES if last[q] + to_go[q] == best and best < NEVER))
        out = [mask]
        for at, sym in zip(reversed(seen[:-1]), reversed(symbols), strict=True):
            mask = self.back(at, sym, mask)
            out.append(mask)
        return out[::-1]

    def _move(self, at: int, sym: int, here: int, there: int, q: int) -> tuple[str, int]:
        """The ASCII-least edits from a marked state up to and with the row's, and the state reached."""
        key = at, sym, here, there, q
        if key not in self.moves:
            to, cost = self.step(at, sym)
            v, w = self.vectors[at], self.vectors[to]
            tight = [(e, r) for e, c, r in arcs(q, sym) if v[q] + c == w[r] + cost and there >> r & 1]
            if v[q] + INSERT == v[DUE[q]] and here >> DUE[q] & 1:
                tight.append(("I", -1))
            edit, r = min(tight)
            if edit == "I":
                more, r = self._move(at, sym, here, there, DUE[q])
                edit += more
            self.moves[key] = edit, r
        return self.moves[key]

    def read(self, seen: list[int], symbols: list[int], marked: list[int], q: int) -> tuple[list[str], int]:
        """The edits of each row, inserts before it first, from state q; and the state reached."""
        edits = []
        for i, sym in enumerate(symbols):
            edit, q = self._move(seen[i], sym, marked[i], marked[i + 1], q)
            edits.append(edit)
        return edits, q

    def matrix(self, symbols: list[int]) -> list[list[int]]:
        """The least cost from each state to each."""
        rows = []
        for q in STATES:
            at, low = self.state([0 if r == q else NEVER for r in STATES])
            seen, total = self.scan(at, symbols)
            rows.append([min(c + low + total, NEVER) for c in self.vectors[seen[-1]]])
        return rows


def ending(q: int) -> str:
    """The inserts behind the last row."""
    out = ""
    while q not in ENDS:
        out, q = out + "I", DUE[q]
    return out


def repair(symbols: list[int], machine: Automaton | None = None) -> tuple[int, str]:
    """(cost, audit) of one conversation."""
    machine = machine or Automaton()
    at, low = machine.state([0, NEVER, NEVER, NEVER])
    seen, total = machine.scan(at, symbols)
    cost = low + total + min(c + g for c, g in zip(machine.vectors[seen[-1]], END_COSTS, strict=True))
    edits, q = machine.read(seen, symbols, machine.trace(seen, symbols, END_COSTS), START)
    return cost, "".join(edits) + ending(q)


def edited(edits: list[str], roles: list[str], texts: list[str], q: int, last: bool) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each edit from state q; deleted rows have neither.  last: with the inserts behind them."""
    for edit, role, text in zip(edits, roles, texts, strict=True):
        for e in edit:
            if e == "D":
                yield e, None, None
            elif e == "K":
                q = keeps(q, role[:1])
                yield e, role, text
            else:
                q = DUE[q]
                yield e, ROLE[q], text if e == "R" else ""
    for e in ending(q) if last else "":
        q = DUE[q]
        yield e, ROLE[q], ""


# ---------------------------------------------------------------- tables

_BLANK = r"[^\x20\x09-\x0D]"


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, hash, kind and fault (blank, duplicate, truncated or null) of each row, written."""
    r = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    r = materialise(r.withColumn("hash", F.xxhash64("role", "text")), "talk-rows").withColumn("uid", F.monotonically_increasing_id())
    same = ["conv_id", "role", "text_id"]
    known = r.withColumn("text_id", F.sha2("text", 256))
    first = known.groupBy(*same).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "uid")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select(*[F.col(c).alias(f"f_{c}") for c in same], F.col("first.uid").alias("first_uid"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in same])
    r = known.join(first, on, "left").withColumn("again", F.coalesce(F.col("uid") != F.col("first_uid"), F.lit(False)))
    fault = F.when(~F.col("text").rlike(_BLANK), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    r = r.withColumn("fault", fault).withColumn("kind", F.when(F.col("fault").isNull(), GOOD).when(F.col("fault") == "truncated", CUT).otherwise(GONE))
    return materialise(r.select("conv_id", "turn", "role", "text", "hash", "kind", "fault", "uid"), "talk-faults")


def _segment_rows(table: pa.Table, segs: pa.Table) -> Iterator[tuple[dict, pa.Table]]:
    rows = table.sort_by("pos")
    places = rows["pos"].to_pylist()
    at = {p: i for i, p in enumerate(places)}
    for s in segs.sort_by("first").to_pylist():
        yield s, rows.slice(at[s["first"]], s["m"])


def _symbols(run: pa.Table) -> list[int]:
    return [symbol(i, k) for i, k in zip(run["initial"].to_pylist(), run["kind"].to_pylist(), strict=True)]


def _vector(costs: list[int]) -> list[int]:
    low = min(costs)
    return [min(c - low, NEVER) for c in costs]


class Repair:
    """The cheapest repair of all conversations of a table with `conv_id`, `turn`, `role` and `text`."""

    def __init__(self, rows: DataFrame, part_rows: int = PART_ROWS):
        self.rows = faults(rows)
        # uid: equal rows in the order in which duplicates were told
        ordered = in_parts(self.rows, ["conv_id", "turn", "role", "hash", "uid"], part_rows, "talk-parts")
        self.ordered = ordered.withColumn("initial", F.substring("role", 1, 1))
        self.parts = segments(self.ordered, "conv_id", "talk-segments").withColumnRenamed("conv_id", "grp")
        self.known = materialise(self._known(), "talk-known")

    def _by_part(self, rows: DataFrame, segs: DataFrame, fn: Callable, schema: str) -> DataFrame:
        return rows.groupBy("part").cogroup(segs.groupBy("part")).applyInArrow(fn, schema)

    def _known(self) -> DataFrame:
        """The segments with what comes before and after each: entry (costs), state, to_go (costs), last, initial before it,
        and the conversation's cost at its first segment."""
        long = self.parts.where("m < n")
        cut = ["part", "grp", "first", "m"]
        rows = self.ordered.join(long.select("part", F.col("grp").alias("g")), ["part"], "left_semi").select("part", "pos", "initial", "kind")

        def cross(key: tuple, table: pa.Table, segs: pa.Table) -> pa.Table:
            machine, out = Automaton(), []
            for s, run in _segment_rows(table, segs):
                matrix = machine.matrix(_symbols(run))
                out.append((s["part"], s["grp"], [c for r in matrix for c in r], run["initial"][-1].as_py()))
            return pa.table({"part": pa.array([o[0] for o in out], pa.int32()), "grp": pa.array([o[1] for o in out], pa.int64()), "matrix": pa.array([o[2] for o in out], pa.list_(pa.int32())), "tail": pa.array([o[3] for o in out], pa.string())})

        matrices = materialise(self._by_part(rows, long.select(*cut), cross, "part int, grp bigint, matrix array<int>, tail string"), "talk-matrices")

        def along(table: pa.Table) -> pa.Table:
            t = table.sort_by("part").to_pylist()
            entry, entries = [0, NEVER, NEVER, NEVER], []
            for r in t:
                entries.append(_vector(entry))
                entry = [min(entry[a] + r["matrix"][4 * a + b] for a in STATES) for b in STATES]
            cost = min(c + g for c, g in zip(entry, END_COSTS, strict=True))
            go, after = list(END_COSTS), []
            for r in reversed(t):
                after.append(_vector(go))
                go = [min(r["matrix"][4 * a + b] + go[b] for b in STATES) for a in STATES]
            n = len(t)
            return pa.table({
                "part": pa.array([r["part"] for r in t], pa.int32()), "grp": pa.array([r["grp"] for r in t], pa.int64()),
                "entry": pa.array(entries, pa.list_(pa.int32())), "to_go": pa.array(after[::-1], pa.list_(pa.int32())), "last": pa.array([i == n - 1 for i in range(n)], pa.bool_()),
                "head": pa.array([None, *[r["tail"] for r in t[:-1]]], pa.string()), "cost": pa.array([cost, *[0] * (n - 1)], pa.int64()),
            })

        costs = materialise(matrices.groupBy("grp").applyInArrow(along, "part int, grp bigint, entry array<int>, to_go array<int>, last boolean, head string, cost bigint"), "talk-costs")
        both = long.select("part", F.col("grp").alias("g"), "first", "m").join(costs.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("grp"))).drop("p", "g")

        def leave(key: tuple, table: pa.Table, segs: pa.Table) -> pa.Table:
            machine, out = Automaton(), []
            for s, run in _segment_rows(table, segs):
                symbols = _symbols(run)
                seen, marked = _traced(machine, symbols, s["entry"], s["to_go"])
                out.append((s["part"], s["grp"], [machine.read(seen, symbols, marked, q)[1] if marked[0] >> q & 1 else -1 for q in STATES]))
            return pa.table({"part": pa.array([o[0] for o in out], pa.int32()), "grp": pa.array([o[1] for o in out], pa.int64()), "leaves": pa.array([o[2] for o in out], pa.list_(pa.int32()))})

        exits = self._by_part(rows, both, leave, "part int, grp bigint, leaves array<int>")

        def follow(table: pa.Table) -> pa.Table:
            t, q, states = table.sort_by("part"), START, []
            for leaves in t["leaves"].to_pylist():
                states.append(q)
                q = leaves[q]
            return pa.table({"part": t["part"].cast(pa.int32()), "grp": t["grp"], "state": pa.array(states, pa.int32())})

        states = exits.groupBy("grp").applyInArrow(follow, "part int, grp bigint, state int")
        more = both.join(states.select(F.col("part").alias("p"), F.col("grp").alias("g"), "state"), (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g"))).drop("p", "g")
        of = lambda c: F.col(c)
        whole = self.parts.where("m = n").select(
            *cut, F.lit(True).alias("whole"), F.array(*[F.lit(c) for c in (0, NEVER, NEVER, NEVER)]).alias("entry"), F.array(*[F.lit(c) for c in END_COSTS]).alias("to_go"),
            F.lit(True).alias("last"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("bigint").alias("cost"), F.lit(START).alias("state"),
        )
        return whole.unionByName(more.select(*cut, F.lit(False).alias("whole"), *map(of, ("entry", "to_go", "last", "head", "cost", "state"))))

    def _each(self, make: Callable, schema: pa.Schema, ddl: str, segs: DataFrame) -> DataFrame:
        """What `make(segment, its rows, its edits, state before it, cost)` gives, for each segment."""

        def run(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
            machine, out = Automaton(), []
            for s, rows in _segment_rows(table, known):
                symbols = _symbols(rows)
                seen, marked = _traced(machine, symbols, s["entry"], s["to_go"])
                edits, _ = machine.read(seen, symbols, marked, s["state"])
                cost = s["cost"]
                if cost is None:
                    at, low = machine.state(s["entry"])
                    cost = low + machine.scan(at, symbols)[1] + min(c + g for c, g in zip(machine.vectors[seen[-1]], END_COSTS, strict=True))
                out += make(s, rows, edits, cost)
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        rows = self.ordered.select("part", "pos", "initial", "kind", "role", "text", "fault")
        return self._by_part(rows.join(segs.select("part").distinct(), "part", "left_semi") if segs is not self.known else rows, segs, run, ddl)

    def edits(self) -> DataFrame:
        """conv_id, part and step (its edits in order), edit, role and text (null for deleted rows) of every edit."""

        def make(s: dict, rows: pa.Table, edits: list[str], cost: int) -> list[tuple]:
            done = edited(edits, rows["role"].to_pylist(), rows["text"].to_pylist(), s["state"], s["last"])
            return [(s["grp"], s["part"], i, *e) for i, e in enumerate(done)]

        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        return self._each(make, schema, "conv_id bigint, part int, step bigint, edit string, role string, text string", self.known)

    def reports(self) -> DataFrame:
        """conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation that has rows."""
        names = ("blank", "duplicate", "truncated")

        def make(s: dict, rows: pa.Table, edits: list[str], cost: int) -> list[tuple]:
            roles = rows["role"].to_pylist()
            found = rows["fault"].to_pylist()
            along = [*([s["head"]] if s["head"] is not None else []), *rows["initial"].to_pylist()]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(along, along[1:], strict=False))
            done = list(edited(edits, roles, rows["text"].to_pylist(), s["state"], s["last"]))
            text = "\n".join(f"{r}:{t}" for e, r, t in done if e != "D") if s["whole"] else None
            return [(s["grp"], s["part"], *[found.count(n) for n in names], illegal, cost, "".join(e for e, _, _ in done), None if text is None else sha256(text.encode("utf-8", "surrogatepass")).hexdigest())]

        ddl = "grp bigint, part int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, sha string"
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])
        each = self._each(make, schema, ddl, self.known)
        sums = [F.sum(c).alias(c) for c in (*names, "illegal", "cost")]
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
        whole = each.groupBy(F.col("grp").alias("conv_id")).agg(*sums, audit.alias("audit"), F.max("sha").alias("sha"))
        long = materialise(self._long_digests(), "talk-digests")
        out = whole.join(long, whole["conv_id"].eqNullSafe(long["g"]), "left")
        return out.select("conv_id", *names, "illegal", "cost", "audit", F.coalesce("sha", "long_sha", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))

    def _long_digests(self) -> DataFrame:
        """g, long_sha: the digests of conversations in several parts, each from the stream of its lines."""

        def make(s: dict, rows: pa.Table, edits: list[str], cost: int) -> list[tuple]:
            done = edited(edits, rows["role"].to_pylist(), rows["text"].to_pylist(), s["state"], s["last"])
            return [(s["grp"], s["part"], i, f"{r}:{t}") for i, (e, r, t) in enumerate(done) if e != "D"]

        schema = pa.schema([("g", pa.int64()), ("part", pa.int32()), ("step", pa.int64()), ("line", pa.string())])
        lines = self._each(make, schema, "g bigint, part int, step bigint, line string", self.known.where("NOT whole"))

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, sha = (), None
            one = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["g", "long_sha"])
            for b in batches:
                for g, line in zip(b.column("g").to_pylist(), b.column("line"), strict=True):
                    if (g,) != at:
                        if sha:
                            yield one()
                        at, sha = (g,), sha256()
                    else:
                        sha.update(b"\n")
                    sha.update(line.as_py().encode("utf-8", "surrogatepass"))
            if sha:
                yield one()

        return lines.repartition("g").sortWithinPartitions("g", "part", "step").select("g", "line").mapInArrow(digest, "g bigint, long_sha string")


def _traced(machine: Automaton, symbols: list[int], entry: list[int], to_go: list[int]) -> tuple[list[int], list[int]]:
    seen, _ = machine.scan(machine.state(entry)[0], symbols)
    return seen, machine.trace(seen, symbols, to_go)


def gaps(rows: DataFrame) -> DataFrame:
    """g, gaps: turns that a conversation lacks between its first and last."""
    span = rows.groupBy(F.col("conv_id").alias("g")).agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("turns"))
    return span.select("g", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("bigint").alias("gaps"))


def reports(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Faults, cost, audit and the repaired text's digest of every conversation that has rows."""
    fixed = Repair(rows, part_rows)
    found, g = fixed.reports(), gaps(fixed.rows)
    return found.join(g, found["conv_id"].eqNullSafe(g["g"])).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: by a hash of conversation and turn, rows are dropped, emptied, stripped of their ends of
    sentences, repeated or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    r = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), which.alias("which"))
    copies = F.when(F.col("which") == 0, F.array().cast("array<int>")).when(F.col("which") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    said: Column = F.when(F.col("which") == 1, "").when(F.col("which") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return r.withColumn("_copy", F.explode(copies)).select("conv_id", "turn", F.when(F.col("which") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"))


def of_every(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The reports with a row for each conversation of rows, also for those of which nothing was left."""
    ids = rows.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    out = ids.join(found.withColumn("_found", F.lit(True)), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
