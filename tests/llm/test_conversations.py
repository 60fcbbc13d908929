import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from broadsheet.llm import conversations

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def brute(rows):
    """The least (cost, letters) by trying every edit at every place, from the end."""
    faults, seen = [], set()
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, insertions):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if insertions < 3:
            for r in "ua":
                if r in NEXT[state]:
                    cost, letters, kept = best(i, NEXT[state][r], insertions + 1)
                    found.append((cost + 5, "I" + letters, (f"{NAMES[r]}:", *kept)))
        if i < len(rows):
            cost, letters, kept = best(i + 1, state, 0)
            found.append((cost + 2, "D" + letters, kept))
            if faults[i] in ("", "truncated"):
                extra, (_, role, text) = 5 * (faults[i] == "truncated"), rows[i]
                for letter, own, r, name in [("K", 0, role[:1], role), ("R", 1, "u", "user"), ("R", 1, "a", "assistant")]:
                    if r in NEXT[state]:
                        cost, letters, kept = best(i + 1, NEXT[state][r], 0)
                        found.append((cost + own + extra, letter + letters, (f"{name}:{text}", *kept)))
        return min(found, default=(10**9, "~", ()))

    cost, letters, kept = best(0, "", 0)
    turns = {r[0] for r in rows} - {None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, letters, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def expected(rows):
    """rows (conv_id, turn, role, text): all conversations, none of whose turns has rows that differ."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return sorted(str((conv, *brute(sorted(turns, key=order)))) for conv, turns in by.items())


def found(spark, rows, parts=3, **said):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    return sorted(str(tuple(r)) for r in conversations.repair_conversations(frame, **said).collect())


def talks(n, seed, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "u"])
            rows.append((conv, turn * rng.choice([1, 1, 2]) + turn * 3, role, rng.choice(["Yes.", "No!", "So?  \n", "cut", "", None, f"n{turn}.", f"m{turn}.", "é. "])))
    return rows


@pytest.mark.parametrize("said", [{}, {"segment": 2, "held": 150}, {"segment": 1, "held": 1}])
def test_agrees_with_brute_force(spark, said):
    rows = talks(150, 1)
    assert found(spark, rows, **said) == expected(rows)


def test_a_conversation_over_all_tasks(spark):
    rows = [(7, i, ["user", "assistant", "tool"][i * i % 5 % 3], f"{i % 400}{'.' if i % 7 else ''}") for i in range(900)]
    (one,) = found(spark, rows, segment=64)
    assert one == found(spark, rows, parts=1, segment=5000, held=1)[0]
    start = [(7, *r[1:]) for r in rows[:60]]
    assert found(spark, start, segment=7) == expected(start)


def test_null_ids_turns_and_copies(spark):
    rows = [(None, None, "user", "a."), (None, None, "user", "a."), (None, 3, "assistant", "b."), (1, None, None, None), (2, 5, "user", "q?"), (2, 2**62, "assistant", "r."), (2, 2**62 + 1, "tool", "x" * 300_000)]
    assert found(spark, rows) == expected(rows)
    copies = [(4, 1, "user", "same.")] * 500 + [(4, 2, "assistant", "ok.")]
    assert found(spark, copies, segment=50) == [str((4, 0, 0, 499, 0, 499, 998, "K" + "D" * 499 + "K", hashlib.sha256(b"user:same.\nassistant:ok.").hexdigest()))]


def test_empty_and_clashing(spark):
    assert found(spark, []) == []
    frame = spark.createDataFrame([(1, 1, "user", "a.", 5, True)], "conv_id long, turn long, role string, text string, part int, here boolean")
    assert [r.audit for r in conversations.repair_conversations(frame).collect()] == ["D"]


def damaged(rows):
    out, all_ids = [], set()
    for conv, turn, role, text in rows:
        all_ids.add(conv)
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out, all_ids


def test_query_and_sql(spark, tmp_path):
    rows = talks(300, 5, 5) + [(None, 1, "user", "q."), (10**6, None, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    kept, ids = damaged(rows)
    nothing = [str((conv, *brute([]))) for conv in ids - {r[0] for r in kept}]
    assert nothing
    got = conversations.op13_repair_conversations(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(expected(kept) + nothing)
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        counts = c.sql(conversations.FAULTS_SQL).fetchall()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(map(str, counts))
