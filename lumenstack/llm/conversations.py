"""Conversation structure repair: the cheapest edits that turn a conversation's roles into s?(ua)+ or nothing.

Edits of a turn are Keep (0), Rerole to user or assistant (3) and Delete (4); an empty turn of either role may be Inserted
anywhere (3); a truncated turn that stays costs 3 more; blank and repeated turns must be deleted. Edits stand for their
initials, and of equally cheap lists of edits the one whose initials are ASCII-least wins.

A macro edit is a run of up to two inserts and then one turn's edit (`IIK`, `D`, `IR` ...; longer runs never are cheapest).
These words are prefix-free, so two lists of n macro edits compare as their first differing words do, and a word is its
place in sorted order. A layer of the dynamic program is what is best after so many turns for each of four states (nothing
yet, system, user, assistant): a cost, and in place of the initials so far their rank among the layer's states. Ranks
of the next layer follow from (rank, word), and each state points at its parent, from which the edits are read back. Less
its least cost, a layer is one of few, so steps are kept in a table.

A conversation of any length is dealt out: turns are sorted by range, cut into blocks of bounded size, and each block's
cost and rank from every state to every state is made by itself. One conversation's blocks are then joined as layers
are, and each block is reconstructed between its two states.

Null roles and texts count as one space. Turns are in order of their number, nulls first; equal numbers by role, then by
the MD5 of role and text. Repeated rows are duplicates of the first. A role without a first character fits no place.
Conversations of null id are one conversation. A conversation whose rows have all gone has no edits and costs nothing.
An empty table gives no rows. Columns other than the four named ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.work import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
#: What an edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WORDS = sorted("I" * k + edit for k in range(3) for edit in "DKR")
#: The state after one more user or assistant, and the role that leads to it.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Over this much more than the least cost, a start can no longer be part of the cheapest edits: 10 would do.
HOPELESS = 20
SPACE = " \t\n\x0b\x0c\r"
#: Characters after which a block ends.
BLOCK_CHARS = 2_000_000

Layer = tuple[tuple[int, int] | None, ...]  # (cost, rank) by state


def inserted(state: int, run: int) -> int:
    for _ in range(run):
        state = NEXT[state]
    return state


def ranked(best: list[tuple | None]) -> Layer:
    """best: (cost, what orders the audits so far, ...) by state. Costs stay, orders become ranks."""
    places = {order: k for k, order in enumerate(sorted({b[1] for b in best if b}))}
    return tuple(b and (b[0], places[b[1]]) for b in best)


@cache
def edited(layer: Layer, initial: str, fault: str) -> tuple[int, Layer, tuple]:
    """(least cost added, the next layer less that cost, (parent state, word) by state) for a turn."""
    best: list[tuple | None] = [None] * 4
    for state, known in enumerate(layer):
        if known is None:
            continue
        for word, name in enumerate(WORDS):
            run, edit = len(name) - 1, name[-1]
            at, cost = inserted(state, run), known[0] + INSERT * run
            if edit == "D":
                to, cost = at, cost + DELETE
            elif fault in ("blank", "duplicate"):
                continue
            elif edit == "R":
                to, cost = NEXT[at], cost + REROLE
            elif initial == "s" and at == START:
                to = SYSTEM
            elif initial == "ua"[NEXT[at] == ASSISTANT]:
                to = NEXT[at]
            else:
                continue
            if edit != "D" and fault == "truncated":
                cost += TRUNCATED
            found = (cost, (known[1], word), state, word)
            if best[to] is None or found < best[to]:
                best[to] = found
    least = min(b[0] for b in best if b)
    if best[START] and best[START][0] > least + HOPELESS:
        best[START] = None
    new = ranked(best)
    return least, tuple(k and (k[0] - least, k[1]) for k in new), tuple(b and b[2:] for b in best)


def entry(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def ending(layer: Layer) -> tuple[int, int, int]:
    """(cost, state, inserts) of the best end: nothing at all, or an assistant."""
    runs = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    cost, _, run, state = min((k[0] + INSERT * runs[s], k[1], runs[s], s) for s, k in enumerate(layer) if k)
    return cost, state, run


def units(turns: list[dict]) -> Iterator[tuple[str, str]]:
    """(initial, fault) of each row: a turn, and its copies as duplicates."""
    for t in turns:
        initial = t["role"][:1] if t["role"][:1] in ("s", "u", "a") else ""
        yield initial, t["fault"]
        for _ in range(t["copies"] - 1):
            yield initial, "blank" if t["fault"] == "blank" else "duplicate"


def transfer(turns: list[dict]) -> list[int | None]:
    """Cost and rank of the best edits from each state to each state, 32 numbers."""
    out: list[int | None] = []
    for state in range(4):
        layer, total = entry(state), 0
        for unit in units(turns):
            added, layer, _ = edited(layer, *unit)
            total += added
        for known in layer:
            out += [known[0] + total, known[1]] if known else [None, None]
    return out


def best_edits(turns: list[dict], start: int, end: int | None, tail: int) -> tuple[int, list[str]]:
    """(cost, words) from a state to a state, or to the best end where it is None; tail inserts follow."""
    layer, total, parents = entry(start), 0, []
    for unit in units(turns):
        added, layer, back = edited(layer, *unit)
        total += added
        parents.append(back)
    if end is None:
        cost, end, tail = ending(layer)
        total += cost
    else:
        total += layer[end][0] + INSERT * tail
    words = []
    for back in reversed(parents):
        end, word = back[end]
        words.append(WORDS[word])
    return total, [*reversed(words), *(["I" * tail] if tail else [])]


def replay(turns: list[dict], words: list[str], state: int) -> list[dict]:
    """The turns after the edits."""
    out, rows = [], iter((t["role"], t["text"]) for t in turns for _ in range(t["copies"]))
    for word in words:
        for edit in word:
            if edit == "I":
                state = NEXT[state]
                out.append({"role": ROLE[state], "text": ""})
                continue
            role, text = next(rows)
            if edit == "R":
                state = NEXT[state]
                out.append({"role": ROLE[state], "text": text})
            elif edit == "K":
                state = SYSTEM if role[:1] == "s" else NEXT[state]
                out.append({"role": role, "text": text})
    return out


#: What a block counts, and what meets at the border of two.
COUNTS = ("n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal")
TURNS = "array<struct<role:string,text:string,copies:long,fault:string>>"


def legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def statistics(turns: list[dict]) -> dict:
    faults = [f for _, f in units(turns)]
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    illegal = sum(not legal(a["role"], b["role"]) for a, b in zip(turns, turns[1:])) + sum(t["copies"] - 1 for t in turns)
    counts = dict(zip(COUNTS, (len(faults), len(set(numbers)), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal)))
    return counts | {"low": min(numbers, default=None), "high": max(numbers, default=None), "first_role": turns[0]["role"][:1] if turns else None, "last_role": turns[-1]["role"][:1] if turns else None}


def blocks_of(batches: Iterator[pa.RecordBatch], names: list[str], block_turns: int) -> Iterator[dict]:
    """The blocks of a partition's sorted rows. A block is whole if its conversation begins and ends within."""
    part, seq = TaskContext.get().partitionId(), 0
    turns: list[dict] = []
    chars, conv, lead, cut = 0, None, None, True

    def block(last: bool) -> dict:
        whole = not cut and not last
        return {"conv": conv, "part": part, "seq": seq, "whole": whole, **statistics(turns), "transfer": None if whole else transfer(turns), "turns": turns}

    any_row = False
    for b in batches:
        for c, t, role, digest, text, n, blank in zip(*(b.column(name).to_pylist() for name in names)):
            if any_row and c != conv:
                yield block(last=False)
                turns, chars, seq, cut, lead = [], 0, seq + 1, False, None
            conv, any_row = c, True
            if text is not None:  # where a text is first found; the rows counted there come next
                lead = (t, role, digest, text)
                continue
            if not n:
                continue
            if len(turns) >= block_turns or chars >= BLOCK_CHARS:
                yield block(last=True)
                turns, chars, seq, cut = [], 0, seq + 1, True
            text = lead[3] if lead and lead[:3] == (t, role, digest) else None
            fault = "blank" if blank else "duplicate" if text is None else ""
            if not fault and text.rstrip(SPACE)[-1] not in ".!?":
                fault = "truncated"
            turns.append({"turn": t, "role": role, "text": text, "copies": n, "fault": fault})
            chars += len(text or "")
    if any_row:
        yield block(last=True)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one conversation's blocks: the states between them, and the counts of all."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["part"], r["seq"]))
    layer, total, parents = entry(START), 0, []
    sums = dict.fromkeys(COUNTS, 0)
    low = high = last_role = None
    for r in rows:
        way: list[tuple | None] = [None] * 4
        for p, known in enumerate(layer):
            for q in range(4) if known else ():
                cost, rank = r["transfer"][8 * p + 2 * q : 8 * p + 2 * q + 2]
                if cost is not None:
                    found = (known[0] + cost, (known[1], rank), p)
                    if way[q] is None or found < way[q]:
                        way[q] = found
        layer = ranked(way)
        parents.append([w and w[2] for w in way])
        for k in COUNTS:
            sums[k] += r[k]
        if r["n_rows"]:
            sums["illegal"] += last_role is not None and not legal(last_role, r["first_role"])
            last_role = r["last_role"]
        if r["low"] is not None:
            sums["n_turns"] -= high is not None and r["low"] == high
            low, high = r["low"] if low is None else low, r["high"]
    total, state, tail = ending(layer)
    out = []
    for k in reversed(range(len(rows))):
        before = parents[k][state]
        out.append({"part": rows[k]["part"], "seq": rows[k]["seq"], "start": before, "end": state, "tail": tail if k == len(rows) - 1 else 0, "cost": total, **sums, "low": low, "high": high})
        state = before
    yield pa.RecordBatch.from_pylist(out, pa.schema([(k, pa.int64()) for k in ("part", "seq", "start", "end", "tail", "cost", *COUNTS, "low", "high")]))


REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def reconstructed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, keep = b.select(["turns", "start", "end", "tail", "cost"]).to_pylist(), [n for n in b.schema.names if n not in ("turns", "start", "end", "tail", "cost")]
        costs, audits, repaired = [], [], []
        for r in rows:
            cost, words = best_edits(r["turns"], r["start"], r["end"], r["tail"])
            costs.append(cost if r["cost"] is None else r["cost"])
            audits.append("".join(words))
            repaired.append(replay(r["turns"], words, r["start"]))
        arrays = [pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(repaired, REPAIRED)]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *arrays], [*keep, "cost", "audit", "repaired"])


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, block_turns: int = 4096) -> DataFrame:
    """The repaired conversations, in blocks: conv, part, seq (order of blocks), whole (the only block), the conversation's
    gaps, blank, duplicate, truncated, illegal and cost, and the block's audit and repaired turns.

    turn: a whole number. copies: how often a row stands there; of a row with 0 only the conversation's id counts.
    block_turns: turns of a block at most; the result is the same for any.
    """
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("n"))
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    # Each text travels once, from where its conversation has it first; all rows travel as counts by digest.
    number = F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn"))["turn"].alias("turn")
    texts = rows.where("n > 0").groupBy("conv", "role", "digest", "text").agg(number).select("conv", "turn", "role", "digest", "text", F.lit(0).cast("long").alias("n"), F.lit(False).alias("blank"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    counts = rows.groupBy("conv", "turn", "role", "digest", blank.alias("blank")).agg(F.sum("n").alias("n")).withColumn("text", F.lit(None).cast("string"))
    key = ["conv", "turn", "role", "digest"]
    names = [*key, "text", "n", "blank"]
    ordered = texts.unionByName(counts).select(*names).repartitionByRange(*key).sortWithinPartitions(*key, F.col("text").isNull())

    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part int, seq int, whole boolean, {', '.join(f'{c} long' for c in COUNTS)}, low long, high long, first_role string, last_role string, transfer array<long>, turns {TURNS}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(some: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
            turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string())]))
            kinds = {"conv": conv_type, "part": pa.int32(), "seq": pa.int32(), "whole": pa.bool_(), **dict.fromkeys((*COUNTS, "low", "high"), pa.int64()), "first_role": pa.string(), "last_role": pa.string(), "transfer": pa.list_(pa.int64()), "turns": turns}
            return pa.RecordBatch.from_pylist(some, pa.schema(kinds.items()))

        kinds: list[pa.DataType] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field("conv").type]
                yield b

        held, size = [], 0
        for found in blocks_of(watched(), names, block_turns):
            held.append(found)
            size += 1 + sum(1 + len(t["text"] or "") for t in found["turns"])
            if size > BLOCK_CHARS or len(held) >= 1000:
                yield batch(held, kinds[0])
                held, size = [], 0
        if held:
            yield batch(held, kinds[0])

    blocks = materialise(ordered.mapInArrow(cut, schema))
    open_ones = blocks.where("not whole")
    light = open_ones.drop("turns", "whole")
    ways = light.groupBy("conv").applyInArrow(_one_group, f"part long, seq long, start long, end long, tail long, cost long, {', '.join(f'{c} long' for c in COUNTS)}, low long, high long")
    keys = open_ones.select("conv", "part", "seq", "turns").join(ways, ["part", "seq"])
    alone = blocks.where("whole").select("conv", "part", "seq", "turns", "whole", F.lit(START).alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0).alias("tail"), F.lit(None).cast("long").alias("cost"), *COUNTS, "low", "high")
    both = alone.unionByName(keys.withColumn("whole", F.lit(False)))
    gaps = F.coalesce(F.expr("cast(cast(high as decimal(20)) - low + 1 - n_turns as long)"), F.lit(0)).alias("gaps")
    kept = both.select("conv", "part", "seq", "whole", gaps, "blank", "duplicate", "truncated", "illegal", "turns", *(F.col(c).cast("long") for c in ("start", "end", "tail")), "cost")
    return kept.mapInArrow(reconstructed, f"conv {kind}, part int, seq int, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>")


def _one_group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(joined(iter(table.to_batches())))


def digests(blocks: DataFrame) -> DataFrame:
    """One row a conversation of repair_conversations(): its counts, cost, whole audit, and the SHA-256 of its repaired turns
    as `role:text` joined by newlines. Blocks of one conversation are hashed in order as they come, none is gathered."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind = blocks.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def done() -> pa.RecordBatch:
            row = state["row"]
            values = [row["conv"], *(row[c] for c in counts), "".join(state["audit"]), state["hash"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [state["type"], *[pa.int64()] * 6, pa.string(), pa.string()])], ["conv", *counts, "audit", "repaired_sha256"])

        for b in batches:
            out = []
            for row in b.to_pylist():
                if not state or row["conv"] != state["row"]["conv"]:
                    if state:
                        out.append(done())
                    state = {"row": row, "hash": hashlib.sha256(), "audit": [], "any": False, "type": b.schema.field("conv").type}
                if row["repaired"]:
                    state["hash"].update(("\n" * state["any"] + "\n".join(f"{t['role']}:{t['text']}" for t in row["repaired"])).encode())
                    state["any"] = True
                state["audit"].append(row["audit"])
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if state:
            yield done()

    schema = f"conv {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"
    split = blocks.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return blocks.where("whole").mapInArrow(run, schema).unionByName(split.mapInArrow(run, schema))
