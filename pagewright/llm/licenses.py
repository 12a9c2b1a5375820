"""License scans: exact set-similarity join of text blocks with license templates under prefix, length and positional filters."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts, written
from .words import ALNUM, LOWER, U, raw, word_hashes, word_spans

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Texts of public licenses, or the notices and sentences by which they announce themselves, and their labels.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
        OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
        the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
        wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
        required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not
        be removed or altered from any source distribution.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
        a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at http://mozilla.org/MPL/2.0/.""",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License version 3",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "mit-notice": "Released under the MIT License",
    "all-rights": "All rights reserved",
}
#: A block meets a template if it has this share of the template's different words.
CONTAINMENT = 0.8
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASE = {re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(p.encode().split()) + rb"(?![0-9a-z\x80-\xff])"): label for p, label in PHRASES.items()}


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def size_class(words: int) -> int:
    """A template's words are sought in blocks of twice this many: the power of two from 4 on that is not under `words`."""
    return max(4, 1 << max(0, words - 1).bit_length())


def need(size: int, containment: float) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


def _vocabulary(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words, and each one's index."""
    coded = [w.encode() for w in words]
    ends = np.cumsum([len(w) + 1 for w in coded]) - 1
    hashes = word_hashes(np.frombuffer(b"\n".join(coded), np.uint8), ends - [len(w) for w in coded], ends) if words else np.zeros(0, U)
    order = np.argsort(hashes)
    return hashes[order], order


def _known(texts: pa.Array, hashes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, offsets, starts of words, first words of texts, the places of the vocabulary's words and which they are."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, ALNUM)
    if not len(starts) or not len(hashes):
        return data, offsets, starts, bounds, np.zeros(0, np.int64), np.zeros(0, np.int64)
    mine = word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
    there = np.flatnonzero(hashes[at] == mine)
    return data, offsets, starts, bounds, there, index[at[there]]


def token_order(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> list[str]:
    """The templates' words by their count in all of docs, rarest first. Only these words can be shared, so their order is all of the global order that
    the join needs; its size is bounded by the templates."""
    words = sorted({w for t in templates.values() for w in words_of(t)})
    hashes, index = _vocabulary(words)

    def counts(texts: pa.Array) -> pa.RecordBatch:
        found = np.bincount(_known(texts, hashes, index)[-1], minlength=len(words))
        there = np.flatnonzero(found)
        return pa.RecordBatch.from_pydict({"word": pa.array(there), "n": pa.array(found[there])})

    n = dict(map_texts(docs, counts, "word long, n long", ("text",)).groupBy("word").agg(F.sum("n").alias("n")).collect())
    return [words[i] for i in sorted(range(len(words)), key=lambda i: (n.get(i, 0), words[i]))]


#: token: the block's different template words, in global order; seen: all places of them, by place.
BLOCKS = "array<struct<class:int,block:long,token:array<int>,seen:array<struct<at:long,token:int>>>>"
TEXTS = f"doc_id long, text_key binary, n_words long, places array<struct<label:string,word:long>>, blocks {BLOCKS}"


def _texts_batch(order: list[str], templates: dict[str, str], containment: float):
    hashes, index = _vocabulary(order)
    rank = {w: i for i, w in enumerate(order)}
    classes: dict[int, tuple[np.ndarray, int]] = {}
    for text in templates.values():
        words = words_of(text)
        side, least = classes.get(size_class(len(words)), (np.zeros(len(order), bool), 1 << 30))
        side[[rank[w] for w in words]] = True
        classes[size_class(len(words))] = side, min(least, need(len(set(words)), containment))

    def blocks_of(doc: np.ndarray, at: np.ndarray, token: np.ndarray) -> list[tuple]:
        """(text, block) of each class with enough different words: length filter."""
        out = []
        for size, (side, least) in classes.items():
            mine = side[token]
            d, a, t = doc[mine], at[mine], token[mine]
            block = a // size
            d, a, t, block = (np.concatenate([x, y]) for x, y in ((d, d), (a, a), (t, t), (block, block - 1)))
            order_ = np.lexsort((a, t, block, d))
            order_ = order_[block[order_] >= 0]
            d, a, t, block = d[order_], a[order_], t[order_], block[order_]
            if not len(d):
                continue
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (block[1:] != block[:-1])
            other = new.copy()
            other[1:] |= t[1:] != t[:-1]
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(d))
            enough = np.add.reduceat(other.astype(np.int64), begin) >= least
            for i, j in zip(begin[enough].tolist(), end[enough].tolist()):
                by_place = np.argsort(a[i:j], kind="stable")
                seen = [{"at": x, "token": y} for x, y in zip(a[i:j][by_place].tolist(), t[i:j][by_place].tolist())]
                out.append((int(d[i]), {"class": size, "block": int(block[i]), "token": t[i:j][other[i:j]].tolist(), "seen": seen}))
        return out

    def run(ids: pa.Array, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        data, offsets, starts, bounds, there, token = _known(texts, hashes, index)
        whole = data.tobytes()
        places: list[list] = [[] for _ in range(len(texts))]
        blocks: list[list] = [[] for _ in range(len(texts))]
        for i in range(len(texts)):
            at, text = int(offsets[i]), whole[offsets[i] : offsets[i + 1]]
            for pattern, label in PHRASE.items():
                places[i] += [{"label": label, "word": int(np.searchsorted(starts, at + m.start()) - bounds[i])} for m in pattern.finditer(text)]
        doc = np.searchsorted(bounds, there, "right") - 1
        for i, block in blocks_of(doc, there - bounds[doc], token):
            blocks[i].append(block)
        seen = pa.list_(pa.struct([("at", pa.int64()), ("token", pa.int32())]))
        kind = pa.struct([("class", pa.int32()), ("block", pa.int64()), ("token", pa.list_(pa.int32())), ("seen", seen)])
        label = pa.struct([("label", pa.string()), ("word", pa.int64())])
        return pa.RecordBatch.from_pydict({"doc_id": ids, "text_key": keys, "n_words": pa.array(np.diff(bounds)), "places": pa.array(places, pa.list_(label)), "blocks": pa.array(blocks, pa.list_(kind))})

    return run


def qualifying(at: np.ndarray, token: np.ndarray, length: int, low: int, high: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts from low to high - 1 of runs of `length` words with `least` different tokens or more, and how many each has: an occurrence counts in the runs
    that start after the same token's last one, and reach it."""
    before = np.full(len(at), -1, np.int64)
    by_token = np.lexsort((at, token))
    same = token[by_token[1:]] == token[by_token[:-1]]
    before[by_token[1:][same]] = at[by_token[:-1][same]]
    first, last = np.maximum(np.maximum(before + 1, at - length + 1), low), np.minimum(at, high - 1)
    able = first <= last
    turn = np.bincount(first[able] - low, minlength=high - low + 1) - np.bincount(last[able] + 1 - low, minlength=high - low + 1)
    shared = np.cumsum(turn[: high - low])
    good = np.flatnonzero(shared >= least)
    return low + good, shared[good]


FOUND = "doc_id long, text_key binary, template string, first_word long, words long, shared long, containment double"
KEYS = ("doc_id", "text_key", "template")
ABLE = "doc_id long, text_key binary, template string, block long, n_words long, starts array<long>, shared array<long>"


def _able(sides: dict[str, tuple[int, frozenset[int]]], containment: float):
    """The starts in each candidate block of runs that meet the template."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                length, tokens = sides[r["template"]]
                at, token = np.array([(s["at"], s["token"]) for s in r["seen"] if s["token"] in tokens], np.int64).T
                size = size_class(length)
                starts, shared = qualifying(at, token, length, r["block"] * size, (r["block"] + 1) * size, need(len(tokens), containment))
                if len(starts):
                    rows.append((r["doc_id"], r["text_key"], r["template"], r["block"], r["n_words"], starts, shared))
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), longs, longs)
            names = [c.split(" ")[0] for c in ABLE.split(", ")]
            yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(names, zip(*rows) if rows else [[]] * len(kinds), kinds)})

    return run


def _swept(sides: dict[str, tuple[int, frozenset[int]]]):
    """Over qualifying starts in order: runs that don't overlap. From the first start on, the best of the starts that its run reaches is taken (ties: the first),
    and the sweep goes on behind that run. Each start is looked at once."""

    def run(batches):
        held, open_ = None, None  # open_: the first start of those under way, the best one and what it shares, words of the text

        def row() -> tuple:
            length, tokens = sides[held[2]]
            return (*held, open_[1], min(length, open_[3] - open_[1]), open_[2], open_[2] / len(tokens))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            names = [c.split(" ")[0] for c in FOUND.split(", ")]
            return pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(names, zip(*rows) if rows else [[]] * len(kinds), kinds)})

        free = 0  # the first word behind the last run taken
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in KEYS)
                if key != held:
                    if open_ is not None:
                        rows.append(row())
                    held, open_, free = key, None, 0
                length = sides[key[2]][0]
                for start, shared in zip(r["starts"], r["shared"]):
                    if open_ is not None and start >= open_[0] + length:
                        rows.append(row())
                        free, open_ = open_[1] + length, None
                    if start < free:
                        continue
                    if open_ is None:
                        open_ = (start, start, shared, r["n_words"])
                    elif shared > open_[2]:
                        open_ = (open_[0], start, shared, r["n_words"])
            yield batch_of(rows)
        if open_ is not None:
            yield batch_of([row()])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, places (of PHRASES, by word), blocks (template, first_word, words, shared, containment) that meet a template, for every row of docs.

    A template of L words is sought in every run of L words (fewer at the text's end), across lines and paragraphs; it is met by a run that has
    `containment` of its different words. Runs are joined in blocks of 2 M words from every M-th word on, M being the template's size_class, so each run of
    up to M words lies in one:

    1. A block's template words, in order of their count in all of docs (rarest first), and a template's are joined on one of the first
       size - need + 1 words of each (prefix filter) where the block has enough words (length) and enough are left in both from there on (position).
    2. Pairs that pass are compared on the full sets, and then all runs that meet the template and start in the block's first M words are found.
    3. A text's runs of a template are swept in order: from the first one on, the best of those that start in it is given (ties: the earliest), and the sweep
       goes on behind that, so that runs given don't overlap and each notice of several has one.

    Null, empty and wordless texts: no words, places or blocks. Repeated rows: the same result each. Templates without words meet nothing. Other columns
    are ignored. Empty table: no rows."""
    spark = docs.sparkSession
    templates = {k: v for k, v in templates.items() if words_of(v)}
    order = token_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    sides = {k: (len(words_of(v)), frozenset(rank[w] for w in words_of(v))) for k, v in templates.items()}
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"), "text")
    texts = written(map_texts(mine, _texts_batch(order, templates, containment), TEXTS, ("doc_id", "text_key", "text")), "license-texts")
    sizes = {k: need(len(s), containment) for k, (_, s) in sides.items()}
    least = {c: min(sizes[k] for k, (n, _) in sides.items() if size_class(n) == c) for c in {size_class(n) for n, _ in sides.values()}}
    schema = "class int, least int, template string, need int, all array<int>"
    table = spark.createDataFrame([(size_class(n), least[size_class(n)], k, sizes[k], sorted(s)) for k, (n, s) in sides.items()], schema)
    prefix = table.select("class", "template", "need", "all", F.posexplode(F.expr("slice(all, 1, size(all) - need + 1)")).alias("j", "token"))
    classes = table.select(F.col("class").alias("_class"), "least").distinct()
    blocks = texts.select("doc_id", "text_key", "n_words", F.explode("blocks").alias("b")).select("doc_id", "text_key", "n_words", F.col("b.class").alias("class"), "b.block", F.col("b.token").alias("mine"), "b.seen")
    blocks = blocks.join(F.broadcast(classes), F.col("class") == F.col("_class")).drop("_class")  # as many rows as templates at most
    one = blocks.withColumn("pair", F.explode(F.expr("transform(slice(mine, 1, size(mine) - least + 1), (t, i) -> struct(t as token, i as i))"))).select("*", "pair.token", "pair.i")
    able = (F.size("mine") >= F.col("need")) & (F.least(F.size("mine") - F.col("i"), F.size("all") - F.col("j")) >= F.col("need"))
    pairs = one.join(F.broadcast(prefix), ["class", "token"]).where(able)  # templates' words
    # the pair's first common word passes, so one of the words that pass stands for it
    pairs = pairs.where(F.col("token") == F.element_at(F.array_intersect("mine", "all"), 1))
    full = pairs.where(F.size(F.array_intersect("mine", "all")) >= F.col("need")).select("doc_id", "text_key", "n_words", "template", "block", "seen")
    able = full.dropDuplicates([*KEYS, "block"]).mapInArrow(_able(sides, containment), ABLE)
    runs = able.repartition(*KEYS).sortWithinPartitions(*KEYS, "block").mapInArrow(_swept(sides), FOUND)
    kept = runs.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("template", "first_word", "words", "shared", "containment"))).alias("found"))
    none = F.array().cast("array<struct<template:string,first_word:bigint,words:bigint,shared:bigint,containment:double>>")
    joined = texts.drop("blocks").join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select("doc_id", "n_words", "places", F.coalesce("found", none).alias("blocks"))


def op7_license_join(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    base, mine = F.transform("places", lambda p: p["label"]), F.transform("blocks", lambda b: b["template"])
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    words = F.transform("places", lambda p: p["word"])
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, mine)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
