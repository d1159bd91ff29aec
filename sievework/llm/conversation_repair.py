"""Repair of turn order: bidirectional Dijkstra over the lattice of edits.

The rows of a conversation become signs: the initial of the role and the row's first fault (blank, a repeat of an earlier
row, cut off). A node of the lattice is (rows used, what stands last); its edges are the edits Delete, Insert, Keep and
Rerole with their costs. One heap grows from the start, one from the accepted ends. Once the two fronts are further apart
than the best way found, every cheapest way crosses between settled nodes; among all of them the one whose letters are
least is walked off. The letters decide the repaired conversation: after an optional system row users and assistants
alternate, so each inserted or reroled row has one possible role.

Texts do not meet the search. First narrow rows (turn, role, digest of the text, faults), equal ones added up before the
shuffle, are sorted per conversation and give the edits, a letter a row. Then the texts that may stay, one per role and
text, are sorted behind their conversation's edits and streamed out in order. A task holds one sign per row, a digest per
different text and one batch of texts, however long a conversation is.

Rows of one turn are taken by role, then by digest of the text; null turns come first. A null role or text counts as one
space, a null conversation is one conversation. An empty table gives an empty one, further columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind, named, rows, steady

# fixed values: costs, and letters in the order that decides ties
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
LETTERS = "DIKR"
ROLES = {2: "user", 3: "assistant"}
WHITE = r"[\x20\x09-\x0D]"

# what stands last: 0 nothing, 1 system, 2 user, 3 assistant; ends are accepted after nothing or an assistant
NEXT = (2, 2, 3, 2)
BEFORE = ((), (), (0, 1, 3), (2,))
ACCEPTED = (0, 3)
IN_STEP = re.compile("(?:ua){12}")
KEPT_FROM = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
MOST_LONG = (1 << 63) - 1
REMEMBERED, SHORT = 1 << 15, 64


def sign(role: str, fault: str) -> str:
    """One letter per row: d if it has to go, else the role's initial (x for others), as a capital if the text is cut off."""
    if fault in ("blank", "duplicate"):
        return "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == "truncated" else initial


def edges_out(signs: str, at: int, last: int):
    """Edits (letter, cost, rows used, what stands last) from a node, by letter."""
    if at < len(signs):
        yield "D", DELETE, at + 1, last
    yield "I", INSERT, at, NEXT[last]
    if at < len(signs):
        cost = CUT if signs[at].isupper() else 0
        for before, after in KEPT_FROM.get(signs[at].lower(), ()):
            if before == last:
                yield "K", cost, at + 1, after
        yield "R", REROLE + cost, at + 1, NEXT[last]


def edges_in(signs: str, at: int, last: int):
    """The same edges met from behind: (cost, rows used, what stood last before)."""
    if at:
        yield DELETE, at - 1, last
    for before in BEFORE[last]:
        yield INSERT, at, before
    if at:
        cost = CUT if signs[at - 1].isupper() else 0
        for before, after in KEPT_FROM.get(signs[at - 1].lower(), ()):
            if after == last:
                yield cost, at - 1, before
        for before in BEFORE[last]:
            yield REROLE + cost, at - 1, before


def cheapest_way(signs: str, first: int = 0, ends: tuple[int, ...] = ACCEPTED) -> tuple[int, str]:
    """(cost, letters): the cheapest edits from what stood last before (`first`) to one of `ends`, the least letters among
    equals. Takes no rows that have to go."""
    n, start = len(signs), (0, first)
    ahead, behind = {start: 0}, {(n, last): 0 for last in ends}
    fronts = ([(0, *start)], [(0, n, last) for last in ends])
    settled = (set(), set())
    best = 0 if start in behind else None
    while fronts[0] and fronts[1]:
        if best is not None and fronts[0][0][0] + fronts[1][0][0] > best:
            break
        way = 0 if fronts[0][0][0] <= fronts[1][0][0] else 1
        cost, at, last = heapq.heappop(fronts[way])
        if (at, last) in settled[way]:
            continue
        settled[way].add((at, last))
        near, far = (ahead, behind) if way == 0 else (behind, ahead)
        steps = edges_in(signs, at, last) if way else (e[1:] for e in edges_out(signs, at, last))
        for more, *node in steps:
            node, total = tuple(node), cost + more
            if total < near.get(node, total + 1):
                near[node] = total
                heapq.heappush(fronts[way], (total, *node))
            if node in far and (best is None or near[node] + far[node] < best):
                best = near[node] + far[node]
    return best, least_letters(signs, start, ends, best, ahead, behind, settled[0])


def least_letters(signs: str, start, ends, best: int, ahead: dict, behind: dict, front: set) -> str:
    """The least letters of all ways of cost `best`: over settled nodes of the front half, a crossing, and the rear half."""

    def crosses(total: int, node) -> bool:
        # a distance from behind that completes the best cost is final, settled or not
        return node in behind and total + behind[node] == best

    # nodes of the front half from which a crossing can be reached without losing anything
    alive = {u for u in front if crosses(ahead[u], u) or any(crosses(ahead[u] + c, (i, q)) for _, c, i, q in edges_out(signs, *u))}
    queue = list(alive)
    while queue:
        at, last = queue.pop()
        for cost, *before in edges_in(signs, at, last):
            before = tuple(before)
            if before not in alive and before in front and ahead[before] + cost == ahead[at, last]:
                alive.add(before)
                queue.append(before)
    node, total, letters = start, 0, []
    while node[0] < len(signs) or node[1] not in ends or total < best:
        for letter, cost, *after in edges_out(signs, *node):
            after, reached = tuple(after), total + cost
            if crosses(reached, after) or after in alive and ahead[after] == reached:
                letters.append(letter)
                node, total = after, reached
                break
    return "".join(letters)


def segments(signs: str):
    """(signs, what stood last before, ends): pieces whose cheapest ways make up the cheapest way of the whole.

    In twelve good rows in their order each cheapest way keeps one at least: keeping none costs 24, while falling in and out
    of step costs 7 at most (an insert each, a system row lost). Between two rows so kept it keeps all. So every cheapest way
    is in step in the middle of 24 such rows, and there the conversation can be cut.
    """
    done, first = 0, 0
    for met in IN_STEP.finditer(signs):
        cut = met.start() + len(met.group()) // 2
        yield signs[done:cut], first, (3,)
        done, first = cut, 3
    yield signs[done:], first, ACCEPTED


def cheapest_edits(signs: str) -> tuple[int, str, str]:
    """(cost, audit, moves): moves is the audit without the letters of the rows that have to go.

    These are deleted first in their gap, since D is the least letter, so the search needs only the others.
    """
    found = [cheapest_way(*piece) for piece in segments(signs.replace("d", ""))]
    moves = "".join(letters for _, letters in found)
    gaps = [len(gap) for gap in re.split("[^d]", signs)]
    audit, used = ["D" * gaps[0]], 0
    for letter in moves:
        audit.append(letter)
        if letter != "I":
            used += 1
            audit.append("D" * gaps[used])
    return sum(cost for cost, _ in found) + DELETE * sum(gaps), "".join(audit), moves


def clean_null(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def conversation_rows(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None = None) -> DataFrame:
    """Rows (conv, turn, role, text, there) in the operator's own names; rows that are not there only name a conversation."""
    there = F.lit(True) if present is None else present
    return df.select(
        named(conv).alias("conv"), named(turn).cast("long").alias("turn"), clean_null(named(role)).alias("role"),
        clean_null(named(text)).alias("text"), there.alias("there"),
    )


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as `conversation_rows` gives them, damaged by the checksum of their place: of twenty one is dropped, one
    emptied, one loses its sentence ends, one is repeated and one gets the role user."""
    places = conversation_rows(df, conv, turn, role, text)
    fate = F.crc32(F.concat_ws(":", clean_null(F.col("conv")), clean_null(F.col("turn"))).cast("binary")) % 20
    ended = F.regexp_replace("text", "[.!?]", "")
    return places.select(
        "conv", "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, ended).otherwise(F.col("text")).alias("text"),
        (fate != 0).alias("there"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def faults(table: DataFrame) -> DataFrame:
    last = F.regexp_extract("text", f"([^\\x20\\x09-\\x0D]){WHITE}*\\z", 1)
    return table.select(
        "*", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
    )


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
NUMBERS = [c.split()[0] for c in COUNTS.split(", ")]


def edit_plans(table: DataFrame) -> DataFrame:
    """Rows (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, moves), one per conversation.

    moves is the audit without the letters of rows that have to go. Takes rows as `conversation_rows` gives them.
    """
    narrow = faults(table).select("conv", "turn", "role", "digest", "blank", "cut", "there")
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest")]
    given = counted.repartition("conv").sortWithinPartitions(*order)

    @steady
    def run(batches):
        state, known, conv_type = None, {}, None
        for batch in batches:
            out, conv_type = [], batch.schema.field("conv").type
            for conv, turn, role, digest, blank, cut, there, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        out.append(planned(state, known))
                    state = {"conv": conv, "signs": [], "initial": None, "seen": set(), "turns": [0, None, None]}
                    state |= {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                if there:
                    add_rows(state, turn, role, digest, blank, cut, copies)
            if out:
                yield plan_batch(out, conv_type)
        if state is not None:
            yield plan_batch([planned(state, known)], conv_type)

    return given.mapInArrow(run, f"conv {kind(table, 'conv')}, {COUNTS}, audit string, moves string")


def add_rows(state: dict, turn, role: str, digest: bytes, blank: bool, cut: bool, copies: int) -> None:
    """Equal rows of a turn: all but the first repeat it."""
    turns = state["turns"]
    if turn is not None:
        turns[0] += turns[2] != turn
        turns[1:] = turn if turns[1] is None else turns[1], turn
    initial = role[:1]
    state["illegal"] += copies - 1
    state["illegal"] += state["initial"] is not None and state["initial"] + initial not in ("su", "ua", "au")
    state["initial"] = initial
    name = (role, digest)
    if blank:
        first, others = "blank", "blank"
    else:
        first, others = "duplicate" if name in state["seen"] else "truncated" if cut else "", "duplicate"
        state["seen"].add(name)
    for fault, n in ((first, 1), (others, copies - 1)):
        if fault:
            state[fault] += n
    state["signs"].append(sign(role, first) + "d" * (copies - 1))


def planned(state: dict, known: dict) -> dict:
    signs = "".join(state["signs"])
    found = known.get(signs)
    if found is None:
        found = cheapest_edits(signs)
        if len(signs) <= SHORT and len(known) < REMEMBERED:
            known[signs] = found
    cost, audit, moves = found
    n, low, high = state["turns"]
    gaps = min(high - low + 1 - n, MOST_LONG) if n else 0
    return {
        "conv": state["conv"], "gaps": gaps, "cost": cost, "audit": audit, "moves": moves,
        **{c: state[c] for c in ("blank", "duplicate", "truncated", "illegal")},
    }


def plan_batch(found: list[dict], conv: pa.DataType) -> pa.RecordBatch:
    columns = {"conv": pa.array([f["conv"] for f in found], type=conv)}
    columns |= {c: pa.array([f[c] for f in found], type=pa.int64()) for c in NUMBERS}
    return rows(**columns, **{c: pa.array([f[c] for f in found], type=pa.string()) for c in ("audit", "moves")})


def repaired_stream(table: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows (conv, place, role, text, counts, audit): per conversation its counts and audit at place 0, then the repaired
    rows, in this order within a task."""
    once = faults(table).where("there AND NOT blank").groupBy("conv", "role", "text", "digest")
    # the earliest of equal rows stays; a null turn is the earliest
    texts = once.agg(F.max(F.col("turn").isNull()).alias("unknown"), F.min("turn").alias("turn"))
    nothing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in (COUNTS + ", audit string, moves string").split(", ")]
    lines = texts.select("conv", F.lit(1).alias("part"), F.when(~F.col("unknown"), F.col("turn")).alias("turn"), "role", "digest", "text", *nothing)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))]
    heads = plans.select("conv", F.lit(0).alias("part"), *empty, *NUMBERS, "audit", "moves")
    order = [F.col(c).asc_nulls_first() for c in ("conv", "part", "turn", "role", "digest")]
    given = heads.unionByName(lines).repartition("conv").sortWithinPartitions(*order)
    shown = [*NUMBERS, "audit"]

    @steady
    def run(batches):
        moves, used, last, place = "", 0, 0, 0
        for batch in batches:
            take, roles, texts_out, places = [], [], [], []

            def put(row, role, text):
                nonlocal place
                place += 1
                take.append(row), roles.append(role), texts_out.append(text), places.append(place)

            columns = (batch.column(c).to_pylist() for c in ("part", "role", "text", "moves"))
            for row, (part, role, text, letters) in enumerate(zip(*columns)):
                if not part:
                    moves, used, last, place = letters, 0, 0, -1
                    put(row, None, None)
                else:
                    letter = moves[used]
                    used += 1
                    if letter == "K":
                        last = {"s": 1, "u": 2, "a": 3}[role[0]]
                        put(row, role, text)
                    elif letter == "R":
                        last = NEXT[last]
                        put(row, ROLES[last], text)
                while used < len(moves) and moves[used] == "I":
                    last, used = NEXT[last], used + 1
                    put(row, ROLES[last], "")
            at = pa.array(take, type=pa.int64())
            # counts stand at place 0 only; an inserted row is made from the row before it
            head = pa.array([p == 0 for p in places], type=pa.bool_())
            yield rows(
                conv=batch.column("conv").take(at), place=pa.array(places, type=pa.int64()),
                role=pa.array(roles, type=pa.string()), text=pa.array(texts_out, type=pa.string()),
                **{c: blanked(batch.column(c).take(at), head) for c in shown},
            )

    def blanked(values, head):
        return pc.if_else(head, values, pa.scalar(None, values.type))

    return given.mapInArrow(run, f"conv {kind(plans, 'conv')}, place long, role string, text string, {COUNTS}, audit string")


def digests(stream: DataFrame) -> DataFrame:
    """Rows (conv, counts, audit, repaired_sha256) of a `repaired_stream`, in the same tasks."""
    shown = [*NUMBERS, "audit"]

    @steady
    def run(batches):
        head, sha, first, conv = None, None, True, None
        for batch in batches:
            out, conv = [], batch.schema.field("conv").type
            heads = [batch.column(c).to_pylist() for c in ("conv", *shown)]
            for row, (place, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "role", "text")))):
                if place == 0:
                    if head is not None:
                        out.append((*head, sha.hexdigest()))
                    head, sha, first = [c[row] for c in heads], hashlib.sha256(), True
                    continue
                sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            if out:
                yield digest_batch(out, conv)
        if head is not None:
            yield digest_batch([(*head, sha.hexdigest())], conv)

    def digest_batch(found, conv):
        types = [conv, *[pa.int64()] * len(NUMBERS), pa.string(), pa.string()]
        columns = [pa.array(list(c), type=t) for c, t in zip(zip(*found), types)]
        return rows(**dict(zip(["conv", *shown, "repaired_sha256"], columns)))

    return stream.mapInArrow(run, f"conv {kind(stream, 'conv')}, {COUNTS}, audit string, repaired_sha256 string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, place, role, text) of the repaired conversations, places from 1. A conversation of which nothing stays
    has no row."""
    table = conversation_rows(df, conv, turn, role, text)
    found = repaired_stream(table, edit_plans(table)).where("place > 0")
    return found.select(F.col("conv").alias(conv), "place", F.col("role").alias(role), F.col("text").alias(text))


def repair_report(table: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Rows (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows as `conversation_rows`
    or `damaged` gives them, one per conversation."""
    return digests(repaired_stream(table, edit_plans(table))).withColumnRenamed("conv", conv)
