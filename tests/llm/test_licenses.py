"""License scans against a search by regular expressions, and on notices as they are and changed."""

import random
import re

import pytest

from lumenstack.llm import licenses as li
from lumenstack.llm.queries import op12_licenses

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def plain(text):
    """What op12 fixes: words, places, labels of the base phrases."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for label, p in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


ODD = [None, "", " \n", "CC-BY", "cc by cc by cc", "cc\x00by", "ccé by", "GENERAL PUBLIC LICENSE general public license", "general public licenses", "all rights reserved all rights", "rights all rights reserved cc_by", "Cc By K by", "all İ rights reserved", "by cc", "x " * 60_000 + "all rights reserved"]


def test_odd_texts(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choices("cc by general public license all rights reserved gnu the".split(), k=rng.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "taken") for i, t in enumerate(texts)], "doc_id long, text string, l string")
    index = li.fit_index(docs)
    for r in docs.withColumn("found", li.licenses(docs["text"], index)).collect():
        f = r["found"]
        assert (f["n_words"], f["n_base"], f["first_word"], f["last_word"], ",".join(f["base_labels"])) == plain(r["text"])
        assert set(f["base_labels"]) <= set(f["labels"]) and 0 <= f["score"] <= 1 and (f["score"] > 0) == bool(f["matches"])
        assert sum(m["base"] for m in f["matches"]) == f["n_base"]


def test_op12(spark, tables):
    folder, docs, _, _ = tables
    got = op12_licenses(spark, folder).collect()
    want = sorted((repr(d["doc_id"]), plain(d["text"])) for d in docs)
    assert sorted((repr(r["doc_id"]), (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got) == want


@pytest.fixture(scope="module")
def index():
    """Frequencies as in a corpus of a thousand documents in which short words are common."""
    common = "the of and to in or is it a this that for with by you all at as any use are not be work can".encode().split()
    return li.Index((*li.BASE, *li.NOTICES), len(li.BASE), 1000, {w: 700 for w in common} | {b"licensed": 40, b"license": 60})


def prose(rng, n):
    return " ".join(rng.choice("the of and to in or is it garden river permission use copy software notice free public under above work version".split()) for _ in range(n))


@pytest.mark.parametrize("k", range(len(li.NOTICES)))
def test_notices_are_found_where_they_stand(index, k):
    t, rng = li.NOTICES[k], random.Random(k)
    before, after = prose(rng, 300), prose(rng, 300)
    words = li.words_of(f"{before} {t.text.title()}, {after}")
    found = [(li.NOTICES[n - index.base].label, at, score) for n, at, score in index.search(words) if n >= index.base]
    assert any(label == t.label and abs(at - 300) <= t.slack and score == 1 for label, at, score in found)


@pytest.mark.parametrize("k", [k for k, t in enumerate(li.NOTICES) if t.slack >= 4])
def test_changed_notices(index, k):
    """Two words put in, one left out outside the mandatory phrases: found. A mandatory phrase broken: not found."""
    t, rng = li.NOTICES[k], random.Random(100 + k)
    words = t.text.split()
    spans = [(i, i + len(p.split())) for p in t.mandatory for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    free = [i for i in range(len(words)) if not any(a <= i < b for a, b in spans)]
    changed = list(words)
    changed.pop(free[len(free) // 2])
    changed.insert(0, "indeed")
    text = f"{prose(rng, 100)} {' '.join(changed)} {prose(rng, 100)}"
    assert t.label in {index.templates[n].label for n, _, _ in index.search(li.words_of(text))}
    broken = list(words)
    for a, _ in spans:
        broken[a] = "something"
    text = f"{prose(rng, 100)} {' '.join(broken)} {prose(rng, 100)}"
    assert not [1 for n, _, _ in index.search(li.words_of(text)) if index.templates[n] == t]


def test_clean_prose_has_no_label(index):
    rng = random.Random(5)
    assert not [1 for _ in range(50) if index.search(li.words_of(prose(rng, 2000)))]


def test_frequencies(spark):
    docs = spark.createDataFrame([("all all rights",), ("rights",), (None,)], "text string").repartition(3)
    assert li.document_frequencies(docs, "text", {b"all", b"rights", b"cc"}) == (3, {b"all": 1, b"rights": 2})
