"""License scans by a positional index of rare words.

Texts are lower-cased (A-Z) and cut into words (letters, digits, anything beyond ASCII). Licence notices are templates; the
index holds each template word's postings (template, position) and its inverse document frequency over all documents.
In a file the licence words that it has are looked up from the highest frequency weight down, as many for a template as
`lookups`. Each occurrence less a template position is a relative position; a template stands where enough of its words
agree on one, give or take `slack` words, and where each of its mandatory phrases is found word for word. A template without
slack is a phrase: the relative positions of all its words are intersected, from the rarest on, so each place is found.

Null and empty texts have no words and no labels. Ties of frequency are broken by the word; repeated rows are judged alike; an
empty table gives no rows; df's columns are kept whatever their names. Each text is judged whole within its row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a word is made of after lower-casing, in UTF-8.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    """Mandatory phrases stand in the text; a template without any is itself one."""

    label: str
    text: str
    mandatory: tuple[str, ...] = ()
    slack: int = 0


#: Phrases whose every place is reported.
BASE = (Template("cc-by", "cc by"), Template("gpl", "general public license"), Template("reserved", "all rights reserved"))
#: Names of licences, and the openings of their notices.
NOTICES = (
    Template("mit", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "any person obtaining a copy"), 6),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",), 2),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license",), 6),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms", "following conditions are met"), 6),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "free software foundation"), 6),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license", "version 3"), 1),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 4),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",), 6),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",), 4),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",), 6),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",), 4),
)
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, matches array<struct<label:string,start:long,end:long,score:double,base:boolean>>"
MATCHES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def words_of(text: str | None) -> list[bytes]:
    return WORD_BYTES.findall((text or "").encode().lower())


def document_frequencies(df: DataFrame, text_col: str, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents, and of how many each word of the vocabulary is a part: a count a task and word travels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen[b""] += 1
                seen.update(vocabulary.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = df.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Postings of the templates' words. anchors: rarest words of a template that may be looked up; lookups: how many
    of those that a file has are; agree: the share of these that must agree on a relative position."""

    def __init__(self, templates: tuple[Template, ...], base: int, documents: int, frequencies: dict[bytes, int], anchors: int = 12, lookups: int = 6, agree: float = 0.6):
        self.templates, self.base, self.lookups = templates, base, lookups
        self.words = [words_of(t.text) for t in templates]
        self.idf = {w: math.log((1 + documents) / (1 + frequencies.get(w, 0))) for words in self.words for w in words}
        self.postings: dict[bytes, list[tuple[int, list[int]]]] = defaultdict(list)
        self.needs: list[int] = []
        self.phrases = [[(_at(words, p), p) for p in map(words_of, t.mandatory)] for t, words in zip(templates, self.words)]
        for k, (t, words) in enumerate(zip(templates, self.words)):
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[: anchors if t.slack else None]
            self.needs.append(math.ceil(agree * min(lookups, len(rare)) - 1e-9) if t.slack else len(rare))
            for w in rare:
                self.postings[w].append((k, [i for i, x in enumerate(words) if x == w]))
        self.postings = dict(self.postings)

    def search(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, place of its first word, share of its words that stand there), in order."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.idf:
                places[w].append(i)
        chosen: dict[int, list[tuple[bytes, list[int]]]] = defaultdict(list)
        for w in sorted(places.keys() & self.postings.keys(), key=lambda w: (-self.idf[w], w)):
            for k, at in self.postings[w]:
                if len(chosen[k]) < self.lookups or not self.templates[k].slack:
                    chosen[k].append((w, at))
        found = []
        for k, own in chosen.items():
            if len(own) >= self.needs[k]:
                stand = self._near if self.templates[k].slack else self._exact
                found += [(k, at, score) for at, score in stand(k, own, places, words)]
        return sorted(found, key=lambda m: (m[1], m[0]))

    def _exact(self, k: int, own: list, places: dict, words: list[bytes]) -> list[tuple[int, float]]:
        starts: set[int] | None = None
        for w, at in own:
            for j in at:
                here = {i - j for i in places[w]} if starts is None else {s for s in starts if s + j < len(words) and words[s + j] == w}
                starts = {s for s in here if s >= 0}
        return [(s, 1.0) for s in sorted(starts)]

    def _near(self, k: int, own: list, places: dict, words: list[bytes]) -> list[tuple[int, float]]:
        slack, out = self.templates[k].slack, []
        votes = sorted((i - j, n) for n, (w, at) in enumerate(own) for j in at for i in places[w])
        low, inside = 0, Counter()
        for high, (offset, n) in enumerate(votes):
            inside[n] += 1
            while votes[low][0] < offset - slack:
                inside[votes[low][1]] -= 1
                low += 1
            if sum(c > 0 for c in inside.values()) < self.needs[k] or (out and offset - out[-1][0] <= slack):
                continue
            at = votes[(low + high) // 2][0]
            if all(self._stands(p, at + j, slack, words) for j, p in self.phrases[k]):
                own_words = self.words[k]
                near = sum(w in words[max(0, at + j - slack) : max(0, at + j + slack + 1)] for j, w in enumerate(own_words))
                out.append((at, near / len(own_words)))
        return [(max(0, at), score) for at, score in out]

    @staticmethod
    def _stands(phrase: list[bytes], at: int, slack: int, words: list[bytes]) -> bool:
        return any(words[i : i + len(phrase)] == phrase for i in range(max(0, at - slack), at + slack + 1))


def _at(words: list[bytes], phrase: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def fit_index(df: DataFrame, text_col: str = "text", base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> Index:
    """An index with the frequencies of all rows of df."""
    templates = (*base, *notices)
    return Index(templates, len(base), *document_frequencies(df, text_col, {w for t in templates for w in words_of(t.text)}))


def licenses(text: Column, index: Index) -> Column:
    """A struct of SCHEMA: words, places of base phrases, labels of these and of all, the best match's score (0: none), and
    the matches with their first word and the word after the last."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [*[pa.int64()] * 4, *[pa.list_(pa.string())] * 2, pa.float64(), MATCHES]

    def one(text: str | None) -> tuple:
        words = words_of(text)
        found = index.search(words)
        starts = [at for k, at, _ in found if k < index.base]
        label = [t.label for t in index.templates]
        rows = [{"label": label[k], "start": at, "end": min(len(words), at + len(index.words[k])), "score": score, "base": k < index.base} for k, at, score in found]
        base = sorted({label[k] for k, _, _ in found if k < index.base})
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), base, sorted({r["label"] for r in rows}), max((r["score"] for r in rows), default=0.0), rows

    def run(texts: pa.Array) -> pa.Array:
        columns = list(zip(*(one(x.as_py()) for x in texts))) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return F.arrow_udf(run, SCHEMA)(text)
