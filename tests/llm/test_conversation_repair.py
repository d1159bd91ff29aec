"""Edits against a plain table over rows and states; damage, order and digests against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sievework.llm import conversation_repair as cr

GRAMMAR = re.compile("(s?(ua)+)?")
STATES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_edits(faulted):
    """(cost, audit) for rows (initial, fault), by going back from the end; more than two inserts in a row never pay."""
    table = {q: (0, "") if q in (0, 3) else None for q in STATES}

    def with_inserts(base):
        now = dict(base)
        for _ in range(2):
            for q in STATES:
                after = [now[t] for r, t in STATES[q].items() if r in "ua" and now[t]]
                ways = [base[q]] if base[q] else []
                now[q] = min(ways + [(c + 2, "I" + a) for c, a in after], default=None)
        return now

    table = with_inserts(table)
    for initial, fault in reversed(faulted):
        base = {}
        for q in STATES:
            ways = [(table[q][0] + 3, "D" + table[q][1])] if table[q] else []
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for role, t in STATES[q].items():
                    if table[t] and role == initial:
                        ways.append((table[t][0] + extra, "K" + table[t][1]))
                    if table[t] and role in "ua":
                        ways.append((table[t][0] + 2 + extra, "R" + table[t][1]))
            base[q] = min(ways, default=None)
        table = with_inserts(base)
    return table[0]


def applied(rows, audit):
    out, last, used = [], 0, 0
    for letter in audit:
        if letter == "I":
            last = cr.NEXT[last]
            out.append((cr.ROLES[last], ""))
            continue
        role, text = rows[used]
        used += 1
        if letter == "K":
            last = STATES[last][role[0]]
            out.append((role, text))
        elif letter == "R":
            last = cr.NEXT[last]
            out.append((cr.ROLES[last], text))
    assert used == len(rows)
    return out


def plain_report(rows):
    """Rows (turn, role, text) of one conversation, damage done."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faulted, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        faulted.append((role[:1], fault))
    turns = [t for t, *_ in rows if t is not None]
    cost, audit = plain_edits(faulted)
    repaired = applied([r[1:] for r in rows], audit)
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in repaired))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
        "illegal": sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(faulted)),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
    }


def damage(rows):
    """{conv: rows} from (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        held += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def test_edits_equal_the_plain_table():
    pick = random.Random(3)
    cases = ["".join(c) for n in range(5) for c in itertools.product("suaxUAd", repeat=n)]
    cases += ["".join(pick.choices("suaxSUAXd", k=pick.randrange(5, 14))) for _ in range(600)]
    # long runs in step with faults between and around them
    for _ in range(150):
        parts = [pick.choice(["ua" * pick.randrange(1, 30), "au" * pick.randrange(1, 30), "s", "u", "A", "d", "x", "uu", "aa"]) for _ in range(6)]
        cases.append("".join(parts))
    faults = lambda c: "duplicate" if c == "d" else "truncated" if c.isupper() else ""
    for signs in cases:
        cost, audit, moves = cr.cheapest_edits(signs)
        assert (cost, audit) == plain_edits([(c.lower() if c != "d" else "u", faults(c)) for c in signs]), signs
        assert sum(m != "I" for m in moves) == len(signs.replace("d", ""))


def got_reports(table):
    return {r["conv_id"]: {c: r[c] for c in r.asDict() if c != "conv_id"} for r in cr.repair_report(table).collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_reports_equal_the_plain_version(spark):
    pick, rows = random.Random(7), []
    texts = ["One.", "Two!", "cut", "", " \t", "a\nb.", " ", "end.  ", "日本。", "x?  \n", None, "same", "Same."]
    for conv in range(150):
        for turn in range(pick.randrange(1, 12)):
            turn = pick.choice([turn, turn, turn, None, turn // 2, turn + 5])
            rows.append((conv, turn, pick.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), pick.choice(texts)))
    rows += [(None, 0, "user", "No name."), (None, 1, "assistant", "None.")]
    rows += [(900, t, "user" if t % 2 else "system", "Hot.") for t in range(3000)]
    rows += [(901, t, "assistant" if t % 2 else "user", f"Row {t}.") for t in range(3000)]
    rows += [(902, -(1 << 63), "user", "Far."), (902, (1 << 63) - 1, "assistant", "Away.")]
    table = spark.createDataFrame(rows, SCHEMA)
    got, want = got_reports(cr.damaged(table)), {c: plain_report(r) for c, r in damage(rows).items()}
    want[902]["gaps"] = min(want[902]["gaps"], (1 << 63) - 1)
    assert got == want
    # many partitions, and further columns of the operator's own names
    wide = table.repartition(13).selectExpr("*", "1 AS conv", "2 AS part", "3 AS there", "4 AS digest", "5 AS place")
    assert got_reports(cr.damaged(wide)) == want


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "A."), (1, 2, "user", "B."), (1, 4, "assistant", ""), (2, 0, "x", " ")]
    out = [tuple(r) for r in cr.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()]
    assert out == [(1, 1, "system", "S."), (1, 2, "user", "A."), (1, 3, "assistant", "B.")]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)] * 5, [(5, t, "user", "word " * 60000) for t in range(3)]])
def test_odd_tables(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    assert got_reports(cr.damaged(table)) == {c: plain_report(r) for c, r in damage(rows).items()}
    assert cr.repair(table).count() >= 0


def test_dropped_conversations_stay_in_the_report(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = got_reports(cr.damaged(spark.createDataFrame([(conv, 0, "user", "Gone.")], SCHEMA)))
    assert got == {conv: {**dict.fromkeys(cr.NUMBERS, 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}}
