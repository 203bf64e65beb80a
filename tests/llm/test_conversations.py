"""Repair of conversations against an exhaustive search, over blocks of any size, and against a plain program."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenstack.llm import conversations as c
from lumenstack.llm.queries import damaged, op11_repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """rows: (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, turns) by a program over audit strings, one edit at a time, inserts of any number."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                to = step[state]
                new = (cost + 3, audit + "I", [*turns, (full[to], "")])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows)):
        new = {}

        def offer(to, found):
            if to not in new or found[:2] < new[to][:2]:
                new[to] = found

        for state, (cost, audit, turns) in with_inserts(best).items():
            offer(state, (cost + 4, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            to = step[state]
            offer(to, (cost + 3 + more, audit + "R", [*turns, (full[to], text)]))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                offer(role[:1], (cost + more, audit + "K", [*turns, (role, text)]))
        best = new
    best = with_inserts(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def exhaustive(rows):
    """(cost, audit) over every list of edits with up to two inserts before each turn and at the end."""
    found = []
    marked = faults(rows)
    runs = ["", "u", "a", "ua", "au"]
    for choice in itertools.product(*[[(r, e) for r in runs for e in ("D", "K", "Ru", "Ra")] for _ in rows], runs):
        roles, audit, cost = "", "", 0
        for (role, _), fault, (run, edit) in zip(rows, marked, choice):
            roles, audit, cost = roles + run, audit + "I" * len(run) + edit[0], cost + 3 * len(run)
            if edit == "D":
                cost += 4
                continue
            if fault in ("blank", "duplicate"):
                cost = 10**6
            cost += (3 if fault == "truncated" else 0) + (3 if edit[0] == "R" else 0)
            roles += role[0] if edit == "K" else edit[1]
        roles, audit, cost = roles + choice[-1], audit + "I" * len(choice[-1]), cost + 3 * len(choice[-1])
        if GOOD.match(roles):
            found.append((cost, audit))
    return min(found)


def random_rows(rng, n):
    return [(rng.choice(("system", "user", "assistant", "user", "assistant", "tool")), rng.choice(("Yes.", "No!", "cut off", " ", "One more?", "odd ") + ("",) * (rng.random() < 0.2)) + (str(rng.randrange(9)) + "." if rng.random() < 0.5 else "")) for _ in range(n)]


def turns_of(rows):
    return [{"turn": i, "role": r, "text": t, "copies": 1, "fault": f} for i, ((r, t), f) in enumerate(zip(rows, faults(rows)))]


def test_words_are_prefix_free_and_in_order():
    assert sorted(c.WORDS) == c.WORDS and not any(a != b and b.startswith(a) for a in c.WORDS for b in c.WORDS)


def test_the_plain_program_is_exhaustive():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(0, 4))
        assert plain_repair(rows)[:2] == exhaustive(rows)


def test_layers_against_the_plain_program():
    rng = random.Random(2)
    for _ in range(1500):
        rows = random_rows(rng, rng.randrange(0, 40))
        turns = turns_of(rows)
        cost, words = c.best_edits(turns, c.START, None, 0)
        got = [(t["role"], t["text"]) for t in c.replay(turns, words, c.START)]
        assert (cost, "".join(words), got) == plain_repair(rows)


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def expected(rows):
    """What op11 returns for (conv_id, turn, role, text) rows whose ties of turn are all equal or ordered by role and MD5."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
        numbers, said = [t for t, _, _ in own if t is not None], [(r, t) for _, r, t in own]
        n = Counter(faults(said))
        cost, audit, turns = plain_repair(said)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        out.append({"conv_id": conv, "gaps": gaps, "blank": n["blank"], "duplicate": n["duplicate"], "truncated": n["truncated"], "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": digest(turns)})
    return out


def bag(rows):
    return Counter(tuple(sorted(r.items())) for r in rows)


def odd_rows():
    """Conversations of all kinds: nulls in every column, ties, repeated rows, one that holds a third of all rows, one all of
    whose rows go."""
    rng = random.Random(3)
    rows = [(k, t, *row) for k in range(60) for t, row in enumerate(random_rows(rng, rng.randrange(1, 9)))]
    rows += [(1000, t, *row) for t, row in enumerate(random_rows(rng, 400))]
    rows += [(None, t % 50, *row) for t, row in enumerate(random_rows(rng, 150))]
    rows += [(2000, None, "user", "Hello."), (2000, None, "assistant", None), (2000, 5, None, "What?"), (2000, -3, "user", "x" * 300_000), (2000, 9, "", "Empty role.")]
    rows += [(2001, 4, "user", "Same.")] * 40
    rows += [(2002, 2**62, "user", "Far."), (2002, -(2**61), "assistant", "Off.")]
    gone = next(k for k in range(3000, 4000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "Gone.")]


SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("conversations")
    pq.write_table(pa.table([list(x) for x in zip(*odd_rows())], schema=SCHEMA), at / "conversations.parquet")
    return str(at)


def test_op11(spark, folder):
    assert bag(r.asDict() for r in op11_repair(spark, folder).collect()) == bag(expected(odd_rows()))


@pytest.mark.parametrize("turns", [1, 3, 50])
def test_blocks_of_any_size(spark, folder, turns):
    rows = damaged(spark.read.parquet(f"{folder}/conversations.parquet")).repartition(7)
    blocks = c.repair_conversations(rows, copies=rows["copies"], block_turns=turns)
    assert blocks.where("not whole and conv = 1000").count() >= 350 // turns
    got = c.digests(blocks).withColumnRenamed("conv", "conv_id").collect()
    assert bag(r.asDict() for r in got) == bag(expected(odd_rows()))


def test_joined_blocks_without_spark():
    """The cuts that Spark makes, made at random here: blocks are transfers, joined() finds the states between them."""
    rng = random.Random(4)
    for _ in range(200):
        rows = random_rows(rng, rng.randrange(1, 60))
        turns = turns_of(rows)
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(0, 6)))) if len(rows) > 1 else []
        pieces = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        blocks = [{"part": 0, "seq": k, "transfer": c.transfer(p), **c.statistics(p)} for k, p in enumerate(pieces)]
        found = sorted(next(c.joined(iter([pa.RecordBatch.from_pylist(blocks)]))).to_pylist(), key=lambda r: r["seq"])
        audit, repaired = "", []
        for p, f in zip(pieces, found):
            _, words = c.best_edits(p, f["start"], f["end"], f["tail"])
            audit += "".join(words)
            repaired += [(t["role"], t["text"]) for t in c.replay(p, words, f["start"])]
        assert (found[0]["cost"], audit, repaired) == plain_repair(rows)
        assert found[0]["illegal"] == c.statistics(turns)["illegal"] and found[0]["n_turns"] == len(turns)


def test_clashing_names_other_ids_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 0, "user", "Hi.", 7), ("a", 1, "assistant", "Yes.", 7), ("b", 0, "assistant", "cut", 7)], "n string, turn int, digest string, conv string, copies int")
    got = c.digests(c.repair_conversations(rows, conv="n", role="digest", text="conv")).collect()
    assert {(r["conv"], r["cost"], r["audit"]) for r in got} == {("a", 0, "KK"), ("b", 4, "D")}
    assert c.digests(c.repair_conversations(rows.where("false"), conv="n", role="digest", text="conv")).count() == 0
