"""Quality rules as a short-circuit cascade.

The base measures are made of every text, since they are results. Each further rule's cost (seconds a document,
beyond those measures) and selectivity (share of documents that it rejects) are estimated on a bounded sample;
the rules then run in descending order of rejection per cost, and a document meets no rule after the first that
rejects it. The order changes the work, never the verdict.

Null and empty texts have no words, so that the base rule rejects them. Repeated rows are judged alike, rules of
equal rate keep their given order, an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.llm.common import SPACE_BYTES, free_name

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


class Text:
    """A text with what several rules need of it, each made when first asked for and then kept."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.words)

    @cached_property
    def chars(self) -> int:
        """Code points in words: bytes that are neither white space nor the continuation of a code point."""
        bare = self.data.translate(None, SPACE_BYTES)
        return len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))

    @cached_property
    def symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def dup_lines(self) -> int:
        lines = [x for x in self.data.split(b"\n") if x and not x.isspace()]
        return len(lines) - len(set(lines))

    @cached_property
    def repeat_words(self) -> int:
        """Words in some 3-word window that is found twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen, inside, upto = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                inside += i + 3 - max(i, upto)
                upto = i + 3
        return inside

    def base(self, min_words: int, repeat_percent: int) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
        n = len(self.words)
        return n, self.chars, self.symbols, self.dup_lines, self.repeat_words, n < min_words or 100 * self.repeat_words > repeat_percent * n


@dataclass(frozen=True)
class Rule:
    """rejects(text) is true for a document to drop."""

    name: str
    rejects: Callable[[Text], bool] = field(compare=False)


def _symbol_share(t: Text) -> bool:
    return 10 * t.symbols > len(t.words)


def _word_length(t: Text) -> bool:
    return not 2 * len(t.words) <= t.chars <= 15 * len(t.words)


def _line_share(t: Text) -> bool:
    lines = t.data.count(b"\n") + 1
    return 10 * t.dup_lines > 3 * lines


def _no_letters(t: Text) -> bool:
    """Over a fifth of the words have no letter, digits and signs alone."""
    return 5 * sum(n for w, n in t.counts.items() if w.isascii() and not w.lower().islower()) > len(t.words)


def _one_word(t: Text) -> bool:
    return 5 * max(t.counts.values(), default=0) > len(t.words)


#: Rules that clean prose of any length from 50 words passes.
RULES = (Rule("symbol_share", _symbol_share), Rule("word_length", _word_length), Rule("dup_line_share", _line_share), Rule("words_without_letters", _no_letters), Rule("one_word_share", _one_word))
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def measure(texts: list[bytes], rules: tuple[Rule, ...], min_words: int, repeat_percent: int) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) of each rule over the texts of a sample that come so far: the base measures
    are made and the base rule has passed. What several rules share is made anew for each, so a cost is that of the
    rule as the first after the base."""
    out = []
    for rule in rules:
        parsed = [Text(x) for x in texts]
        parsed = [t for t in parsed if not t.base(min_words, repeat_percent)[-1]]
        began = time.perf_counter()
        rejected = sum(rule.rejects(t) for t in parsed)
        out.append((rule.name, (time.perf_counter() - began) / max(1, len(parsed)), rejected / max(1, len(parsed))))
    return out


def order_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, min_words: int = 50, repeat_percent: int = 50) -> tuple[Rule, ...]:
    """rules by descending rejection per cost, as measured in one task on the sample_rows whole texts of least hash.
    With no rows, in the given order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t.encode() for b in batches for t in b.column(0).to_pylist()]
        if texts:
            names, costs, shares = zip(*measure(texts, rules, min_words, repeat_percent))
            yield pa.RecordBatch.from_pydict({"rule": names, "cost": costs, "share": shares})

    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    last = texts.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    sample = texts.where(F.col("h") <= F.lit(last)).limit(sample_rows).select("text").coalesce(1)
    rate = {r["rule"]: r["share"] / max(r["cost"], 1e-9) for r in sample.mapInArrow(run, "rule string, cost double, share double").collect()}
    return tuple(sorted(rules, key=lambda r: -rate.get(r.name, 0.0)))


def judge(text: Column, ordered: tuple[Rule, ...], min_words: int = 50, repeat_percent: int = 50) -> Column:
    """The base measures of each text, base_failed, kept, and the rule that rejected it."""

    def one(data: bytes) -> tuple:
        t = Text(data)
        base = t.base(min_words, repeat_percent)
        by = "base" if base[-1] else next((r.name for r in ordered if r.rejects(t)), None)
        return *base, by is None, by

    def run(texts: pa.Array) -> pa.Array:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
        columns = list(zip(*(one((x.as_py() or "").encode()) for x in texts))) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return F.arrow_udf(run, SCHEMA)(text)


def quality_cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> DataFrame:
    """df with a struct column `quality` (see SCHEMA; underscores go before the name if it is taken)."""
    ordered = order_rules(df, text_col, rules, sample_rows)
    return df.withColumn(free_name(df, "quality"), judge(F.col(text_col), ordered))
