"""The filter audit against a plain count over every order."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenstack.llm import audit
from lumenstack.llm.queries import op13_audit


def masks_of(docs):
    first = {}
    for d in docs:
        if d["doc_id"] is not None:
            first[d["text"] or ""] = min(d["doc_id"], first.get(d["text"] or "", d["doc_id"]))
    out = []
    for d in docs:
        text = d["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), d["doc_id"] is not None and first[text] < d["doc_id"]]
        out.append("".join(f for f, x in zip("ABCDE", fails) if x))
    return out


def plain_audit(docs, labels):
    good, toxic = ({x["doc_id"] for x in labels if x["doc_id"] is not None and x[k] == 1} for k in ("quality", "toxic"))
    rows, fails = [], masks_of(docs)
    for part in {d["lang"] or "" for d in docs}:
        own = [(f, d["doc_id"]) for d, f in zip(docs, fails) if (d["lang"] or "") == part]
        shapley, here = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [o for o in left if x in o[0]], [o for o in left if x not in o[0]]
                shapley[x] += len(gone)
                here.append((x, {"part": part, "filter_order": order, "step": step, "kept": len(left), "removed": len(gone), "redundant": sum(x in f for f, _ in own) - len(gone), "unique_fails": sum(f == x for f, _ in own), "good_lost": sum(i in good for _, i in gone), "toxic_lost": sum(i in toxic for _, i in gone)}))
        rows += [{**r, "shapley": shapley[x]} for x, r in here]
    return rows


def bag(rows):
    return Counter(tuple(sorted(r.items())) for r in rows)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    rng = random.Random(8)
    words = ["alpha", "Beta", "GAMMA", "delta", "x#", "été", "ß", "10%"]
    texts = [" ".join(rng.choices(words[: rng.randrange(1, 9)], k=rng.choice((1, 30, 120)))) if rng.random() < 0.6 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(130)) for _ in range(60)]
    texts += [None, "", " \t", "É" * 100, "A" * 9 + "b" * 81, "A" * 9 + "b" * 80, "a\x1cb\x85c " * 40, "z " * 50_000]
    docs = [{"doc_id": None if i % 17 == 5 else i, "text": texts[rng.randrange(len(texts))], "lang": rng.choice(("en", "", None, "de"))} for i in range(300)]
    docs += [docs[3], docs[3], {**docs[4], "text": "another"}] + [{"doc_id": 1000 + i, "text": "copy of one hot text", "lang": "fr"} for i in range(200)]
    labels = [{"doc_id": rng.choice((None, *range(320), *range(1000, 1100))), "quality": rng.choice((0, 1, None)), "toxic": rng.choice((0, 1, None))} for _ in range(260)]
    folder = tmp_path_factory.mktemp("audit")
    pq.write_table(pa.Table.from_pylist(docs, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])), folder / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), folder / "labels.parquet")
    return str(folder), docs, labels


def test_op13(spark, odd):
    folder, docs, labels = odd
    assert bag(r.asDict() for r in op13_audit(spark, folder).collect()) == bag(plain_audit(docs, labels))


def test_table():
    table = audit.first_failures(5)
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    for m, (k, order) in itertools.product(range(32), enumerate(itertools.permutations(range(5)))):
        assert table[m, k] == next((i for i, f in enumerate(order) if m >> f & 1), 5)


def test_many_parts_and_fewer_filters(spark):
    """More parts than a task holds, and two filters: 2 orders of 2 steps."""
    rows = spark.range(2000).selectExpr("cast(id % 700 as string) AS part", "cast(id % 4 as int) AS mask", "id % 3 = 0 AS good", "id % 5 = 0 AS toxic").repartition(1)
    got = audit.audit(rows, "XY").collect()
    assert len(got) == 700 * 4
    for order in ("XY", "YX"):
        steps = [r for r in got if r["filter_order"] == order]
        ids = np.arange(2000)
        first, second = (ids % 4 & {"X": 1, "Y": 2}[f] > 0 for f in order)
        assert sum(r["removed"] for r in steps if r["step"] == 1) == first.sum()
        assert sum(r["removed"] for r in steps if r["step"] == 2) == (second & ~first).sum()
        assert sum(r["redundant"] for r in steps if r["step"] == 2) == (second & first).sum()
        assert sum(r["good_lost"] for r in steps) == ((first | second) & (ids % 3 == 0)).sum()
