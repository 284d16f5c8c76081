"""The repair program against enumeration of all edit sequences, and the fault counts against SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from statloom.llm import conversation_repair as cr
from statloom.llm.queries import op13_conversation_repair

SHAPE = re.compile(r"(s?(ua)+)?")


def enumerate_best(roles, fault):
    """Every choice per row (D, K, R to u or a) and at most one insert in each gap; consecutive inserts
    only add cost, so the cheapest repair is among these."""
    n, best = len(roles), None
    row_moves = ["D", "K", "Ru", "Ra"]
    for moves in itertools.product(row_moves, repeat=n):
        for gaps in itertools.product(["", "u", "a"], repeat=n + 1):
            cost, audit, shape, out = 0, "", "", []
            ok = True
            for i in range(n + 1):
                if gaps[i]:
                    cost, audit, shape = cost + 3, audit + "I", shape + gaps[i]
                    out.append((cr.FULL[gaps[i]], None))
                if i == n:
                    break
                move = moves[i]
                if move == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if fault[i] in ("blank", "duplicate"):
                    ok = False
                    break
                extra = 3 if fault[i] == "truncated" else 0
                if move == "K":
                    cost, audit, shape = cost + extra, audit + "K", shape + roles[i][:1]
                    out.append((roles[i], i))
                else:
                    if move[1] == roles[i][:1]:
                        ok = False
                        break
                    cost, audit, shape = cost + 3 + extra, audit + "R", shape + move[1]
                    out.append((cr.FULL[move[1]], i))
            if ok and SHAPE.fullmatch(shape):
                key = (cost, audit)
                if best is None or key < best[0]:
                    best = (key, out)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_program_equals_enumeration(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 4)
    roles = [rng.choice(["system", "user", "assistant", " ", "sysop", "tool"]) for _ in range(n)]
    fault = [rng.choice([None, None, "blank", "duplicate", "truncated"]) for _ in range(n)]
    cost, audit, kept = cr.best_repair(roles, fault)
    (want_cost, want_audit), want = enumerate_best(roles, fault)
    assert (cost, audit) == (want_cost, want_audit)
    assert kept == want


def test_empty_and_plain_conversations():
    assert cr.best_repair([], []) == (0, "", [])
    assert cr.best_repair(["user", "assistant"], [None, None]) == (0, "KK", [("user", 0), ("assistant", 1)])
    assert cr.best_repair(["system"], [None])[:2] == (4, "D")
    cost, audit, _ = cr.best_repair(["assistant"], [None])
    assert (cost, audit) == (3, "IK")


def rows_spark(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_faults_ties_nulls_and_long_text(spark):
    long = "word " * 30_000
    rows = [
        (1, 0, "user", "Hi."),
        (1, 0, "user", "Hi."),
        (1, 1, "assistant", "  \t"),
        (1, None, "system", "Rules!"),
        (1, 3, "assistant", long),
        (None, 0, "user", "x?"),
    ]
    got = {r["conv_id"]: r for r in cr.repair(rows_spark(spark, rows)).collect()}
    one = got[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"]) == (1, 1, 1, 1)
    assert one["illegal"] == 2  # "uu", "ua" (legal), "aa"
    assert [r["role"] for r in one["repaired"]] == ["system", "user", "assistant"]
    assert one["audit"] == "KKDDK"
    assert got[None]["cost"] == 3 and got[None]["audit"] == "KI"


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a.", 5, "x")], "conv_id long, turn long, role string, text string, cost long, audit string")
    got = cr.repair(frame).collect()
    assert [(r["cost"], r["audit"]) for r in got] == [(3, "KI")]
    assert cr.repair(rows_spark(spark, [])).collect() == []


def test_query_counts_against_sql(spark, small):
    con = duckdb.connect()
    table = f"read_parquet('{small}/conversations.parquet')"
    originals = con.execute(f"SELECT conv_id, turn, role, text FROM {table}").fetchall()
    damaged = []
    for conv, turn, role, text in originals:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if code == 0:
            continue
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        damaged += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    got = {r["conv_id"]: r for r in op13_conversation_repair(spark, small).collect()}
    assert set(got) == {r[0] for r in originals}
    by_conv = {}
    for row in sorted(damaged, key=lambda r: (r[0] is None, r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        by_conv.setdefault(row[0], []).append(row)
    for conv, rows in by_conv.items():
        seen, fault = set(), []
        for _, _, role, text in rows:
            stripped = text.strip(" \t\n\r\x0b\x0c")
            fault.append(
                "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
            )
            seen.add((role, text))
        cost, audit, kept = cr.best_repair([r[2] for r in rows], fault)
        want = "\n".join(f"{role}:{'' if i is None else rows[i][3]}" for role, i in kept)
        row = got[conv]
        assert (row["cost"], row["audit"]) == (cost, audit)
        assert row["repaired_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (row["blank"], row["duplicate"], row["truncated"]) == tuple(fault.count(f) for f in ("blank", "duplicate", "truncated"))
    for conv in set(got) - set(by_conv):
        assert got[conv]["audit"] == "" and got[conv]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
