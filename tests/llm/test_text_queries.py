"""Every query against a brute-force version over tables with all odd cases, and over empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lumenstack.llm.queries import ORACLE_SQL, QUERIES


def rows_of(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def bag(rows):
    return Counter(tuple(sorted(r.items(), key=lambda x: x[0])) for r in rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == 0


def test_op1(spark, tables):
    folder, docs, _, _ = tables
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d in docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        want.append({"doc_id": d["doc_id"], "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids))), "decoded_sha256": sha(t.decode(ids, skip_special_tokens=False))})
    assert bag(rows_of(spark, "op1_bpe", folder)) == bag(want)


def test_op2(spark, tables):
    folder, docs, _, _ = tables
    got = rows_of(spark, "op2_hilbert", folder)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs)
    slots = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(40)}
    assert all(s == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(docs)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


BASE = (("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def test_op3(spark, tables):
    folder, docs, _, _ = tables
    want, extra = {}, {}
    for d in docs:
        spans = sorted((m.start(), rank, m.end(), kind) for rank, (kind, p, g, least) in enumerate(BASE) for m in p.finditer(d["text"] or "") if len(m[g]) >= least)
        n = Counter(s[3] for s in spans)
        want[d["doc_id"]] = (n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))
    for r in rows_of(spark, "op3_secrets", folder):
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == want[r["doc_id"]]
        extra[r["doc_id"]] = [x for x in r["spans"].split(",") if x.startswith("markov")]
    found = {d["text"][int(s) : int(e)] for d in docs for x in extra[d["doc_id"]] for _, s, e in [x.split(":")]}
    assert "k9Jx2LqP0vZ7RtY4WbN8sDfG3hQm" in found and "getUserAccountNameFromTable" not in found


def test_op4(spark, tables):
    folder, docs, _, _ = tables
    got = rows_of(spark, "op4_langid", folder)
    assert Counter(r["doc_id"] for r in got) == Counter(d["doc_id"] for d in docs)
    empty = {d["doc_id"] for d in docs if not re.search(r"[^\W\d_]", d["text"] or "")}
    assert all(not r["kept"] for r in got if r["doc_id"] in empty)


def test_op5(spark, tables):
    folder, docs, _, _ = tables
    want = []
    for d in docs:
        text = d["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(words)
        want.append({"doc_id": d["doc_id"], "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "base_failed": n < 50 or 100 * len(inside) > 50 * n})
    got = rows_of(spark, "op5_quality", folder)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert bag([{k: v for k, v in r.items() if k != "kept"} for r in got]) == bag(want)


def test_op6(spark, tables):
    folder, _, _, pages = tables
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    got = {r["page_id"]: r for r in rows_of(spark, "op6_urls", folder)}
    for p in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert rule is None or r["verdict"] == rules[rule]
    assert got[12]["verdict"] == "block" and got[13]["verdict"] == "allow"


def simhash(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance):
    """fps: (id, fingerprint); the least id of each row's component."""
    values = sorted({f for _, f in fps})
    array, parent = np.array(values, np.uint64), {f: f for f in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array ^ np.uint64(f)) <= distance):
            parent[find(values[j])] = find(f)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in fps]


def test_op7(spark, tables):
    folder, docs, _, _ = tables
    fps = [(d["doc_id"], simhash(d["text"], 3)) for d in docs]
    want = [{"doc_id": i, "fingerprint": f"{f:016x}", "component_id": c} for (i, f), c in zip(fps, components(fps, 2))]
    assert bag(rows_of(spark, "op7_simhash", folder)) == bag(want)


def test_op8(spark, tables):
    folder, docs, items, _ = tables

    def shingles(text, k):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    want = []
    for i in items:
        size = min(5, len((i["text"] or "").split()))
        own = shingles(i["text"], size) if size else set()
        for d in docs:
            shared = len(own & shingles(d["text"], size)) if own else 0
            if own and shared / len(own) >= 0.8:
                want.append({"doc_id": d["doc_id"], "item_id": i["item_id"], "shared": shared, "item_shingles": len(own), "containment": shared / len(own)})
    assert len(want) >= 4
    assert bag(rows_of(spark, "op8_decontam", folder)) == bag(want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert bag(rows_of(spark, name, folder)) == bag([dict(zip(names, r)) for r in cursor.fetchall()])


def test_op9(spark, tables):
    folder, docs, _, _ = tables
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for d in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0)):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        want.append({"doc_id": d["doc_id"], "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        at += len(ids)
    assert bag(rows_of(spark, "op9_records", folder)) == bag(want)
