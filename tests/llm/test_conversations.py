import heapq
import random
import re
import zlib
from hashlib import sha256

import pytest

from lattica.llm import conversations, queries
from lattica.llm.conversations import Automaton, repair, symbol

DUE = {0: 2, 1: 2, 2: 3, 3: 2}
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """(cost, audit) by a search over whole strings of edits; rows: (initial, kind)."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if (audit, i, q) in seen:
            continue
        seen.add((audit, i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if not audit.endswith("III"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, DUE[q]))
        if i < len(rows):
            initial, kind = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if kind != 2:
                heapq.heappush(heap, (cost + 2 + kind, audit + "R", i + 1, DUE[q]))
                to = 1 if (initial, q) == ("s", 0) else 2 if initial == "u" and q != 2 else 3 if (initial, q) == ("a", 2) else None
                if to is not None:
                    heapq.heappush(heap, (cost + kind, audit + "K", i + 1, to))


def dynamic(rows):
    """(cost, audit) for longer conversations: best suffix of each state, backward."""
    best = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    for initial, kind in reversed(rows):
        base = {}
        for q in range(4):
            options = [(best[q][0] + 3, "D" + best[q][1])]
            if kind != 2:
                c, a = best[DUE[q]]
                options.append((c + 2 + kind, "R" + a))
                to = 1 if (initial, q) == ("s", 0) else 2 if initial == "u" and q != 2 else 3 if (initial, q) == ("a", 2) else None
                if to is not None:
                    options.append((best[to][0] + kind, "K" + best[to][1]))
            base[q] = min(options)
        for _ in range(3):
            base = {q: min(base[q], (base[DUE[q]][0] + 2, "I" + base[DUE[q]][1])) for q in range(4)}
        best = base
    return best[0]


def test_edits_are_the_cheapest_and_ascii_least():
    random.seed(7)
    machine = Automaton()
    for n in range(7):
        for _ in range(150):
            rows = [(random.choice(["s", "u", "a", "x", ""]), random.choice([0, 0, 0, 1, 2])) for _ in range(n)]
            assert repair([symbol(*r) for r in rows], machine) == cheapest(rows) == dynamic(rows)


def test_the_table_stays_small_however_long_a_conversation_is():
    random.seed(8)
    rows = [(random.choice("suax"), random.choice([0, 0, 0, 1, 2])) for _ in range(20_000)]
    machine = Automaton()
    cost, audit = repair([symbol(*r) for r in rows], machine)
    assert (cost, audit) == dynamic(rows) and len(machine.vectors) < 60 and len(machine.table) < 600


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def expected(spark, rows):
    """The contract, conversation by conversation."""
    from pyspark.sql import functions as F

    left = hurt(rows)
    hashes = {(r.role, r.text): r.h for r in spark.createDataFrame([(r[2], r[3]) for r in left] or [("", "")], "role string, text string").distinct().select("role", "text", F.xxhash64("role", "text").alias("h")).collect()}
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashes[r[2:]]))
        seen, found, symbols = set(), [], []
        for _, _, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            found.append(fault)
            symbols.append((role[:1], 2 if fault in ("blank", "duplicate") else int(fault == "truncated")))
        cost, audit = dynamic(symbols)
        lines, q, at = [], 0, 0
        for e in audit:
            if e == "K":
                role, text = own[at][2:]
                q = 1 if role[:1] == "s" else DUE[q]
                lines.append(f"{role}:{text}")
            elif e in "RI":
                q = DUE[q]
                lines.append(f"{'user' if q == 2 else 'assistant'}:{own[at][3] if e == 'R' else ''}")
            at += e != "I"
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def reported(spark, rows, part_rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = conversations.of_every(df, conversations.reports(conversations.damaged(df), part_rows)).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in out}
    assert len(found) == len(out)
    return found


def talk(n_conv, longest, seed):
    random.seed(seed)
    rows = []
    for conv in range(n_conv):
        n = longest if conv == 0 else random.randint(1, 8)
        for turn in range(n):
            text = random.choice(["Yes.", "No!", "Why", "one two.", "", " \t", "Ünï. ", f"row {turn}.", f"cut {turn}"])
            rows.append((conv, turn, random.choice(["user", "assistant", "system", "tool", ""]), text))
    return rows


@pytest.mark.parametrize("part_rows", [1000, 7])
def test_reports_equal_brute_force_over_parts_of_any_size(spark, part_rows):
    rows = talk(12, 60, 3)
    assert reported(spark, rows, part_rows) == expected(spark, rows)


def test_odd_rows(spark):
    long = "very long " * 200_000 + "."
    rows = [(None, 0, "user", "a."), (None, None, None, None), (1, None, "user", "x"), (1, None, "user", "x"), (1, 3, "assistant", long), (1, 3, "assistant", long), (1, 3, "assistant", "Other."), (2, 5, "system", None), (3, None, None, "?")]
    got = reported(spark, rows, 3)
    assert got == expected(spark, rows)
    assert reported(spark, [], 3) == {}


def test_extra_columns_and_edits(spark):
    rows = talk(4, 30, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("part", "pos", "grp", "uid", "hash", "kind", "edit", "which", "_copy"):
        df = df.withColumn(c, df["role"])
    fixed = conversations.Repair(conversations.damaged(df), 7)
    by_conv = {}
    for r in sorted(fixed.edits().collect(), key=lambda r: (r["conv_id"], r["part"], r["step"])):
        by_conv.setdefault(r["conv_id"], []).append(r)
    want = expected(spark, rows)
    for conv, edits in by_conv.items():
        assert "".join(e["edit"] for e in edits) == want[conv][6]
        kept = [e for e in edits if e["edit"] != "D"]
        assert sha256("\n".join(f"{e['role']}:{e['text']}" for e in kept).encode()).hexdigest() == want[conv][7]
        assert re.fullmatch("(s?(ua)+)?", "".join(e["role"][:1] for e in kept))


def test_whole_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversations(spark, data).collect()}
    assert got == expected(spark, rows)
