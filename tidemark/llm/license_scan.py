"""Licence scans by a positional index of rare words.

Each template of a licence is indexed by its words of highest IDF, counted over all documents: word to template
and position. A text's hits give offsets (place in the text less place in the template); where enough positions of one
template fall on nearly one offset, the template may stand. It does if all its mandatory phrases stand inside that
stretch, word for word, and enough of its words by IDF do. Of templates that share over half of
the shorter one's stretch, those with fewer aligned positions give way.

Short phrases of the contract (BASE) are looked for beside it, and are never taken away. Defined cases: a null text
is empty; a text without words has no labels and score 0; a phrase or a template never reaches over two texts; repeated
rows are judged alike; an empty table gives an empty table; other columns pass through, but for those that the operator
adds, which replace any of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import MARKS, Chunk, append_columns, chunks
from ._spark import read

BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

_WARRANTY = "the software is provided as is without warranty of any kind express or implied"
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
_CC = "this work is licensed under a creative commons attribution {} international license"

#: (label, text, phrases that must stand). Texts need not be whole: what tells a licence is enough.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY, ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "this project is licensed under the terms of the mit license", ["mit license"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["apache license version 2 0"]),
    ("apache-2", "released under the apache 2 0 license", ["apache 2 0 license"]),
    ("apache-2", "spdx license identifier apache 2 0", ["spdx license identifier apache 2 0"]),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"]),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["redistribution and use in source and binary forms", "may be used to endorse or promote products"]),
    ("bsd-3", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd-2", "licensed under the bsd 2 clause license", ["bsd 2 clause"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["to alter it and redistribute it freely"]),
    ("boost-1", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software released into the public domain"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("epl-2", "licensed under the eclipse public license version 2 0", ["eclipse public license version 2 0"]),
    ("gpl-2", _GNU.format("general", 2), ["gnu general public license", "either version 2"]),
    ("gpl-3", _GNU.format("general", 3), ["gnu general public license", "either version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "spdx license identifier gpl 2 0", ["spdx license identifier gpl 2 0"]),
    ("gpl-3", "spdx license identifier gpl 3 0", ["spdx license identifier gpl 3 0"]),
    ("lgpl-3", _GNU.format("lesser general", 3), ["gnu lesser general public license", "either version 3"]),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("lgpl-2.1", "this library is free software licensed under the gnu lesser general public license version 2 1", ["gnu lesser general public license version 2 1"]),
    ("agpl-3", _GNU.format("affero general", 3), ["gnu affero general public license", "either version 3"]),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc0", "this work is dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("cc-by", _CC.format("4 0"), ["creative commons attribution 4 0"]),
    ("cc-by-sa", _CC.format("sharealike 4 0"), ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nd", _CC.format("noderivatives 4 0"), ["creative commons attribution noderivatives 4 0"]),
    ("cc-by-nc", _CC.format("noncommercial 4 0"), ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nc-sa", _CC.format("noncommercial sharealike 4 0"), ["creative commons attribution noncommercial sharealike 4 0"]),
    ("cc-by-nc-nd", _CC.format("noncommercial noderivatives 4 0"), ["creative commons attribution noncommercial noderivatives 4 0"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ["cc by nc nd 4 0"]),
]

ANCHORS = 12  # words of highest IDF that index a template
DRIFT = 16  # words that may be put in or left out between two hits of one template
LEAST_SHARE = 0.6  # of a template's words by IDF
BASE_LABELS = sorted({label for _, label in BASE})
LABELS = sorted({label for label, *_ in TEMPLATES} | set(BASE_LABELS))


def hashes_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Chunk(raw, np.array([0, len(raw)]), MARKS).hashes()


def vocabulary() -> np.ndarray:
    """Hashes of all words of templates, ascending."""
    return np.unique(np.concatenate([hashes_of(text) for _, text, _ in TEMPLATES]))


def idf(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """IDF of each word of the vocabulary over all documents. Only counts of these few hundred words come to the driver."""
    words = vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, c in chunks(batch.column(0), MARKS):
                at, index = _known(c, words)
                pairs = np.unique(c.text_of_word()[at] * len(words) + index)
                found += np.bincount(pairs % len(words), minlength=len(words))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], n))], names=["word", "n"])

    got = dict(docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False))
    n = got.pop(-1, 0)
    held = np.zeros(len(words))
    for word, k in got.items():
        held[word] = k
    return np.log((n + 1) / (held + 1)) + 1e-3


def _known(c: Chunk, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, index into words) of the chunk's words that are in words."""
    h = c.hashes()
    index = np.minimum(np.searchsorted(words, h), len(words) - 1)
    at = np.flatnonzero(words[index] == h)
    return at, index[at]


@dataclass
class Index:
    words: np.ndarray
    weight: np.ndarray
    first: np.ndarray  # postings of word i are first[i]:first[i + 1]
    template: np.ndarray
    position: np.ndarray
    size: np.ndarray  # words of each template
    need: np.ndarray  # aligned positions that make a candidate
    inside: list[np.ndarray]  # distinct words of each template
    phrases: list[list[int]]  # phrases of each template
    phrase_words: list[np.ndarray]
    base: list[np.ndarray]


def build_index(weight: np.ndarray) -> Index:
    words = vocabulary()
    of, at, word, size, need, inside, phrases, phrase_words = [], [], [], [], [], [], [], []
    names: dict[str, int] = {}
    for t, (_, text, must) in enumerate(TEMPLATES):
        index = np.searchsorted(words, hashes_of(text))
        kinds = np.unique(index)
        rare = kinds[np.lexsort((kinds, -weight[kinds]))][:ANCHORS]
        place = np.flatnonzero(np.isin(index, rare))
        of += [t] * len(place)
        at += place.tolist()
        word += index[place].tolist()
        size.append(len(index))
        need.append(max(2, min(len(place) // 2, 6)))
        inside.append(kinds)
        for p in must:
            if p not in names:
                names[p] = len(names)
                phrase_words.append(np.searchsorted(words, hashes_of(p)))
        phrases.append([names[p] for p in must])
    order = np.argsort(word, kind="stable")
    first = np.searchsorted(np.array(word)[order], np.arange(len(words) + 1))
    return Index(words, weight, first, np.array(of)[order], np.array(at)[order], np.array(size), np.array(need), inside, phrases, phrase_words, [hashes_of(p) for p, _ in BASE])


def _places(index: np.ndarray, at: np.ndarray, text: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of phrase stand one after another in one text, given the known words and their places."""
    n = len(phrase)
    if len(at) < n:
        return np.zeros(0, np.int64)
    hit = index[: len(at) - n + 1] == phrase[0]
    k = np.flatnonzero(hit)
    for j in range(1, n):
        k = k[(index[k + j] == phrase[j]) & (at[k + j] == at[k] + j)]
    k = k[text[k] == text[k + n - 1]]
    return at[k]


def find(c: Chunk, ix: Index) -> tuple[list[tuple[int, int, int, int, float]], list[tuple[int, int, int]]]:
    """((text, template, start, end, share of its words) of templates, (text, base phrase, start)); places in words of the text."""
    h, owner = c.hashes(), c.text_of_word()
    base = []
    for b, phrase in enumerate(ix.base):
        k = np.flatnonzero(h[: max(0, len(h) - len(phrase) + 1)] == phrase[0])
        for j in range(1, len(phrase)):
            k = k[h[k + j] == phrase[j]]
        k = k[owner[k] == owner[k + len(phrase) - 1]]
        base += [(int(owner[i]), b, int(i - c.first[owner[i]])) for i in k]
    at, index = _known(c, ix.words)
    text = owner[at]
    many = ix.first[index + 1] - ix.first[index]
    hit = np.repeat(np.arange(len(at)), many)
    post = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ix.first[index], many)
    if not len(hit):
        return [], base
    template, position = ix.template[post], ix.position[post]
    offset = at[hit] - position - c.first[text[hit]] + ix.size.max()
    found: dict[tuple[int, int], tuple[int, int, int]] = {}  # (text, template) to (aligned, low, high)
    stands = {p: _places(index, at, text, words) for p, words in enumerate(ix.phrase_words)}
    for half in (0, DRIFT // 2):
        slot = (offset + half) // DRIFT
        key = (text[hit].astype(np.int64) * len(ix.size) + template) * (1 << 34) + slot
        pair = np.unique(np.stack([key, position]), axis=1)[0] if len(key) else key
        slots, aligned = np.unique(pair, return_counts=True)
        good = aligned >= ix.need[(slots >> 34) % len(ix.size)]
        slots, aligned = slots[good], aligned[good]
        owner_of, kind = (slots >> 34) // len(ix.size), (slots >> 34) % len(ix.size)
        start = (slots & (1 << 34) - 1) * DRIFT - half - ix.size.max() + c.first[owner_of]
        low = np.maximum(start - DRIFT, c.first[owner_of])
        high = np.minimum(start + ix.size[kind] + 2 * DRIFT, c.first[owner_of + 1])
        ok = np.ones(len(slots), bool)
        for t in np.unique(kind):
            mine = np.flatnonzero(kind == t)
            for p in ix.phrases[t]:
                seen, n = stands[p], len(ix.phrase_words[p])
                if not len(seen):
                    ok[mine] = False
                    break
                near = np.searchsorted(seen, low[mine])
                ok[mine] &= (near < len(seen)) & (seen[np.minimum(near, len(seen) - 1)] + n <= high[mine])
        for i in np.flatnonzero(ok):
            k = (int(owner_of[i]), int(kind[i]))
            if k not in found or aligned[i] > found[k][0]:
                found[k] = (int(aligned[i]), int(low[i]), int(high[i]))
    kept: dict[int, list[tuple[int, int, int, int, float]]] = {}
    for (who, t), (aligned, low, high) in found.items():
        there = index[np.searchsorted(at, low) : np.searchsorted(at, high)]
        words = ix.inside[t]
        share = float(ix.weight[words[np.isin(words, there)]].sum() / ix.weight[words].sum())
        if share >= LEAST_SHARE:
            core = (low + high - ix.size[t]) // 2  # without the margins for drift
            kept.setdefault(who, []).append((t, aligned, int(core), int(core + ix.size[t]), share))
    out = []
    for who, some in kept.items():
        for t, aligned, low, high, share in some:
            if not any(o[1] > aligned and 2 * (min(o[3], high) - max(o[2], low)) > min(o[3] - o[2], high - low) and TEMPLATES[o[0]][0] != TEMPLATES[t][0] for o in some):
                out.append((who, t, max(0, int(low - c.first[who])), int(high - c.first[who]), min(1.0, share)))
    return out, base


def licenses(docs: DataFrame, weight: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """The `keep` columns with __n_words, __base (label, start) of the base phrases, and __licenses (label, start, end, score) of
    templates; start and end are words of the text. One pass over the texts; the index is a broadcast of a few hundred words."""
    shared = docs.sparkSession.sparkContext.broadcast(build_index(weight))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        n_words = np.zeros(batch.num_rows, np.int64)
        base: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i, c in chunks(batch.column(batch.schema.get_field_index(text_col)), MARKS):
            n_words[i : i + c.n] = np.diff(c.first)
            found, phrases = find(c, shared.value)
            for who, t, start, end, score in found:
                spans[i + who].append({"label": TEMPLATES[t][0], "start": start, "end": end, "score": score})
            for who, b, start in phrases:
                base[i + who].append({"label": BASE[b][1], "start": start})
        return [pa.array(n_words), pa.array(base, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))), pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]

    fields = T.StructType.fromDDL("__n_words long, __base array<struct<label string, start long>>, __licenses array<struct<label string, start long, `end` long, score double>>").fields
    return append_columns(docs, make, fields, keep)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses(docs, idf(docs), ["doc_id"])
    names = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform("__base", lambda x: x["start"])
    score = F.when(F.size("__base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("__licenses", lambda x: x["score"])), F.lit(0.0)))
    return out.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names("__base")).alias("base_labels"),
        joined(F.concat(names("__base"), names("__licenses"))).alias("labels"),
        score.alias("score"),
        F.col("__licenses").alias("places"),
    )
