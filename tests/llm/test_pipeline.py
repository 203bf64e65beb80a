"""Each stage, and the whole pipeline, against brute force on planted cases."""

import random
import re
import uuid

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import prose
from tokenizers import Tokenizer

import corpus_pipeline
from lumenstack import work
from lumenstack.llm import neardup
from lumenstack.llm.common import materialise, sieved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def roots(rows, similarity=0.8):
    """The row that stays of each group of texts: least id."""
    sets, left = [shingles(r[1]) for r in rows], set(range(len(rows)))
    kept = []
    while left:
        group, open_ = set(), [left.pop()]
        while open_:
            i = open_.pop()
            group.add(i)
            near = {j for j in left if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
            left -= near
            open_ += near
        kept.append(min(rows[i][0] for i in group))
    return sorted(kept)


def edited(rng, text, n):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = "changed" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(150, 400)) for _ in range(30)]
    rows = [*texts, texts[0], texts[0], texts[1].upper()]
    rows += [edited(rng, texts[i], 1) for i in range(2, 12)]  # similarity over 0.92
    rows += [edited(rng, texts[2], 1) for _ in range(150)]  # a large group of near copies
    rows += [edited(rng, texts[i], 60) for i in range(12, 20)]  # far from similar
    rows += ["", " ", "one", "one two"]
    return [(i, t, "en", "src0", len(t)) for i, t in enumerate(rows)]


def test_near_duplicates(spark, planted):
    df = spark.createDataFrame(planted, SCHEMA).repartition(7)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == COLUMNS
    assert sorted(r["doc_id"] for r in out.collect()) == roots(planted)


def test_near_duplicates_at_the_threshold(spark):
    """Lone pairs of equal-sized texts around 0.8: none under it goes; over it, one of each goes, but for what shares no segment."""
    rng, rows, of = random.Random(3), [], {}
    for percent in (76, 79, 80, 82):
        for _ in range(20):
            shared = 4 * percent  # of 400 shingles in both together
            own = [" ".join(f"w{rng.randrange(10**9)}" for _ in range((400 - shared) // 2)) for _ in "ab"]
            head = " ".join(f"w{rng.randrange(10**9)}" for _ in range(shared + 4))
            a, b = (shingles(f"{head} {x}") for x in own)
            assert len(a & b) * 100 == percent * len(a | b)
            for x in own:
                of[len(rows)] = percent
                rows.append((len(rows), f"{head} {x}", "en", "src0", 1))
    left = [of[r["doc_id"]] for r in neardup.keep_one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert left.count(76) == left.count(79) == 40
    assert 20 <= left.count(80) <= 22 and 20 <= left.count(82) <= 22


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c", None, None, None), (5, "a b c", None, None, None), (5, "a b c", None, None, None), (6, None, None, None, None), (7, None, None, None, None)]
    out = neardup.keep_one_of_each_group(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _row", "2 as _text"))
    assert sorted(r["doc_id"] for r in out.collect()) == [5, 6] and out.columns == [*COLUMNS, "_row", "_text"]
    assert neardup.keep_one_of_each_group(spark.createDataFrame([], SCHEMA)).count() == 0


def test_secret_scan(spark):
    secret = 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'
    rows = [(1, f"é before {secret} after password=abcdef12", "en", "s", 3), (2, "nothing here", "en", "s", 12), (3, None, None, None, None)]
    out = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert out[1]["text"] == 'é before [secret]" after [secret]' and out[1]["n_chars"] == len(out[1]["text"])
    assert (out[2]["text"], out[2]["n_chars"], out[3]["text"]) == ("nothing here", 12, None)


def test_run(spark, planted, tables, tmp_path):
    items = [r for r in tables[2] if r["item_id"] in (2, 7, 11)]
    rows = [*planted, (900, planted[5][1][::-1] + " " + items[1]["text"] + " " + planted[6][1][::-1], "en", "src1", 1)]
    pq.write_table(pa.Table.from_pylist([dict(zip(COLUMNS, r)) for r in rows], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(items), tmp_path / "benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    worded = [r for r in planted if re.search("[a-z]", r[1])]
    assert sorted(got) == roots(worded)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(r["ids"] == t.encode(planted[i][1], add_special_tokens=False).ids for i, r in got.items())


def test_names_are_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secret_scan", "tokens"]


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60), "en", "src0", 1) for i in range(30)] + [(90, "12 34 56", "en", "src0", 8), (91, None, None, None, None), (92, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as language", "2 as _scores")
    out = corpus_pipeline.language(spark, df, "")
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(30)) and out.columns == [*COLUMNS, "language", "_scores"]
    assert corpus_pipeline.language(spark, df.limit(0), "").count() == 0


def test_decontamination(spark, tables):
    folder, rows, items, _ = tables
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA).selectExpr("*", "1 as item", "2 as leak")
    out = corpus_pipeline.decontamination(spark, df, folder)
    texts = [i["text"] for i in items if (i["text"] or "").strip()]
    sets = [(len(t.split()), t) for t in texts]

    def leaks(text):
        for n, t in sets:
            k = min(5, n)
            own, there = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in ((x or "").encode().lower().split() for x in (t, text)))
            if len(own & there) >= 0.8 * len(own):
                return True
        return False

    want = sorted(str(r["doc_id"]) for r in rows if not leaks(r["text"]))
    assert sorted(str(r["doc_id"]) for r in out.collect()) == want and len(want) < len(rows) and out.columns == [*COLUMNS, "item", "leak"]


def test_tokens(spark):
    rows = [(1, "The cat sat.", "en", "s", 12), (2, None, None, None, None), (2, "", "en", "s", 0), (3, "x" * 3000, "en", "s", 1)]
    out = corpus_pipeline.tokens(spark, spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ids", "2 as n_tokens"), "").collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(tuple(r["ids"]) for r in out) == sorted(tuple(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)


def test_recall_and_precision_against_all_pairs(spark):
    """3,000 texts with copies of every degree: of the true links' groups, what stays differs in under 1 % of documents."""
    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(60, 160)) for _ in range(1500)]
    texts += [edited(rng, texts[rng.randrange(1500)], rng.randrange(0, 8)) for _ in range(1500)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"] for r in neardup.keep_one_of_each_group(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
    sets = [shingles(t) for t in texts]
    seen, links = {}, []
    for i, s in enumerate(sets):
        near = {j for g in s for j in seen.get(g, ())}
        links += [(i, j) for j in near if len(s & sets[j]) >= 0.8 * len(s | sets[j])]
        for g in s:
            seen.setdefault(g, []).append(i)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {find(i) for i in range(len(texts))}
    assert want <= got and len(got - want) < 0.01 * len(links)
    print("links", len(links), "kept beyond", len(got - want))


def test_sieve_keeps_what_is_wanted(spark):
    """Also with more keys than its maps have bits for, null keys, negative ones and none."""
    df = spark.range(-3000, 3000).selectExpr("case when id <> 7 then id * 7919 end as key", "id as _at", "'x' as _map")
    wanted = materialise(df.where("_at % 3 = 0").select("key"))
    out = sieved(df, "key", wanted, "met")
    assert out.columns == [*df.columns, "met"] and out.where("met is null").count() == 0
    assert out.where("met and _at % 3 = 0").count() == 2000 and out.where("met").count() < 2000 + 4000 / 8
    assert sieved(df, "key", materialise(df.limit(0)), "met").where("met").count() == 0


def test_near_duplicates_leave_lone_texts_where_they_are(spark, tmp_path, monkeypatch):
    """Texts that resemble no other are not shuffled, and what is written on the way is removed."""
    rng = random.Random(4)
    texts = [" ".join(f"{rng.getrandbits(48):x}" for _ in range(900)) for _ in range(400)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate([*texts, edited(rng, texts[0], 1), texts[1]])]
    df = materialise(spark.createDataFrame(rows, SCHEMA).repartition(4))

    def sent():
        held = spark._jsc.sc().statusStore().executorList(True)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    monkeypatch.setattr(work, "shared_dir", lambda spark: f"file://{tmp_path}/{uuid.uuid4().hex}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = sent()
        out = neardup.keep_one_of_each_group(df)
        assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == list(range(400))
        assert materialise(out).count() == 400
        moved = sent() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    size = sum(len(t) for t in texts)
    assert moved < 0.6 * size, (moved, size)
    left = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if "doc_id" not in pq.read_schema(f).names)
    assert left < 0.05 * size, (left, size)
