import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenstack.llm.eliasfano import EliasFano
from lumenstack.llm.queries import QUERIES


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 1 << 40), (1000, 10), (5000, 1 << 45), (3000, 3000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n + top % 97)
    values = np.sort(rng.integers(0, top, n))
    coded = EliasFano(EliasFano.parts_of(values))
    assert (coded.access(np.arange(n)).astype(np.int64) == values).all()
    asked = np.concatenate([values, rng.integers(0, top + 5, 200), [0]])
    assert (coded.successor(asked) == np.searchsorted(values, asked)).all()


def test_op10(spark, tables):
    folder, docs, _, _ = tables
    tokens = [[*(w for w in (d["text"] or "").encode().lower().split()), b""] for d in docs]
    held = [zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 7 == 2 for d in docs]
    one, two = Counter(), Counter()
    for t, h in zip(tokens, held):
        if not h:
            one.update(t)
            two.update(zip([b"", *t], t))
    n, v = sum(one.values()), len(one)

    def p(w):
        return (one[w] + 1) / (n + v + 1)

    got = {}
    for r in QUERIES["op10_lm"](spark, folder).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(docs)
    for d, t, h in zip(docs, tokens, held):
        for r in got[d["doc_id"]]:
            if d["doc_id"] is None and r["n_tokens"] != len(t):
                continue
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(t), sum(one[w] > 0 for w in t), n)
            assert r["base_score"] == pytest.approx(sum(math.log10(p(w)) for w in t), rel=1e-9)
            exact = sum(math.log10((two[a, b] + 20 * p(b)) / (one[a] + 20)) for a, b in zip([b"", *t], t))
            assert r["score"] == pytest.approx(exact, rel=0.02, abs=0.05)
