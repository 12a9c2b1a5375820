"""Importance resampling towards a target distribution: hashed n-grams by word-id suffix arrays, bucket gains, a draw by perturbed scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_chunks, written
from .words import ALNUM, LOWER, raw, word_spans

#: Features are n-grams of up to ORDER words, hashed into BUCKETS.
ORDER, BUCKETS = 3, 10_000
#: Documents of so many words take part in the draw of PERCENT of them, perturbed by SEED.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Places of a suffix array: with two more words their ids stay under 2**20, so three of them fit into a key.
PLACES = (1 << 20) - 8
#: Characters of texts that share suffix arrays.
CHUNK = 4 << 20


def _words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words in lower case with one space between, where each begins and ends in that, and each text's first word (one entry more)."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, ALNUM)
    keep = ALNUM[data]
    gap = ends[ends < len(data)]
    gap = gap[~keep[gap]]
    data[gap] = 32
    keep[gap] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return data[keep].tobytes(), place[starts], place[ends], bounds


def _ids(joined: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number from 1 for each different word."""
    if not len(begin):
        return np.zeros(0, np.int64)
    sizes = end - begin
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    whole = np.frombuffer(joined, np.uint8)[begin[0] : end[-1]]
    inside = np.zeros(len(whole) + 1, np.int8)
    np.add.at(inside, begin - begin[0], 1)
    np.add.at(inside, end - begin[0], -1)
    letters = whole[np.cumsum(inside[:-1]) > 0]
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1


def suffix_array(ids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a sequence of word ids in the order of the suffixes from there, as far as ORDER words or the end of the text tell (left: words from
    a place to its text's end), and how many words each has in common with the one before (ORDER at most)."""
    n = len(left)
    ahead = [ids[:n]] + [np.where(left > k, np.append(ids, np.zeros(ORDER, np.int64))[k : n + k], 0) for k in range(1, ORDER)]
    key = np.zeros(n, np.int64)
    for a in ahead:
        key = (key << 20) | a
    order = np.argsort(key)
    common, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for a in ahead:
        a = a[order]
        same &= (a[1:] == a[:-1]) & (a[1:] > 0)
        common[1:] += same
    return order, common


def feature_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram of 1 to ORDER words that begins at each word (a row each; BUCKETS where the text ends before), and each text's first word
    (one entry more).

    Places whose suffixes have n words in common stand together in the suffix array: such a run is one n-gram, hashed once, and its bucket goes
    back to all its places."""
    joined, begin, end, bounds = _words(texts)
    out = np.full((ORDER, len(begin)), BUCKETS, np.int32)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(begin))
    crc = zlib.crc32
    for low in range(0, len(begin), PLACES):
        high = min(low + PLACES, len(begin))
        more = min(high + ORDER - 1, len(begin))
        order, common = suffix_array(_ids(joined, begin[low:more], end[low:more]), left[low:high])
        order += low
        for n in range(1, ORDER + 1):
            there = left[order] >= n
            at, new = order[there], (common < n)[there]
            heads = at[new]
            hashed = [crc(joined[a:b]) for a, b in zip(begin[heads].tolist(), end[heads + n - 1].tolist())]
            out[n - 1, at] = (np.array(hashed, np.int64) % BUCKETS)[np.cumsum(new) - 1]
    return out, bounds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS + 1, np.int64)
    for (texts,) in text_chunks(batches, CHUNK):
        total += np.bincount(feature_buckets(texts)[0].ravel(), minlength=BUCKETS + 1)
    at = np.flatnonzero(total[:BUCKETS])
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features of all texts in each of the BUCKETS buckets; a task sends one count a bucket, and the driver gets BUCKETS rows at most."""
    found = docs.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    out[[r["bucket"] for r in found]] = [r["n"] for r in found]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket."""
    above = (target + 1.0) * (float(source.sum()) + BUCKETS)
    below = (source + 1.0) * (float(target.sum()) + BUCKETS)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def _weighed(gains: np.ndarray):
    padded = np.append(gains, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, CHUNK):
            buckets, bounds = feature_buckets(texts)
            sums = np.zeros(buckets.shape[1] + 1, np.int64)
            np.cumsum(padded[buckets].sum(axis=0), out=sums[1:])
            words = np.diff(bounds)
            features = sum(np.maximum(words - k, 0) for k in range(ORDER))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (words, features, sums[bounds[1:]] - sums[bounds[:-1]]))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with their partition and place in it."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1))], [*batch.schema.names, "part", "at"])
        seen += n


def importance_sample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs(doc_id, text), weighed towards target(text).

    Two passes over the texts, before and after the gains are known: the features of a text are found anew, as they take more room than the text.
    rank numbers the draw from 1, null for all others; equal scores go by doc_id (null last), then in the order of the rows. Range
    partitions are ordered each by itself and numbered by their sizes, so no task sees all rows.

    Null or empty text, or one without words: no features, weight 0. A null doc_id is perturbed as an empty one. Repeated rows count, and take
    part, each. Without target texts t and T are 0. Other columns are ignored. Empty table: no rows."""
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = mine.mapInArrow(_weighed(gains), "doc_id long, n_words long, n_features long, weight long")
    chance = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((chance + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= LEAST_WORDS
    drawn = scored.where(able).count() * PERCENT // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "row"]
    schema = "doc_id long, n_words long, n_features long, weight long, score long, row long, part int, at long"
    placed = scored.where(able).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_place, schema)
    placed = written(placed, "ranked")
    sizes, before = {}, 0
    for part, n in sorted(placed.groupBy("part").count().collect()):
        sizes[part], before = before, before + n
    starts = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("part")] if sizes else F.lit(0)
    rank = (F.col("at") + starts).cast("long")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = placed.select(*names, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's weight towards `benchmark`, its score, and its rank in the draw."""
    return importance_sample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


OP11_SQL = r"""
with tab as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
a as (
  select 1 as own, row_number() over () as r, doc_id, text from documents
  union all select 0, row_number() over (), null, text from benchmark),
w as (select own, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from a),
f as (
  select own, r, unnest(ws) as g from w
  union all select own, r, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w
  union all select own, r, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) from w),
n as (select own, r, g, count(*) as n from f group by all),
b as (
  select g, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(strlen(g)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) % 10000 as bucket
  from (select distinct g, hex(encode(g)) as x from n), tab),
c as (select bucket, sum(n) filter (where own = 1) as s, sum(n) filter (where own = 0) as t from n join b using (g) group by 1),
z as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from c),
gain as (select bucket, floor(1000 * ln((coalesce(c.t, 0) + 1)::double * (z.s + 10000) / ((coalesce(c.s, 0) + 1)::double * (z.t + 10000))))::bigint as gain from c, z),
v as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from n join b using (g) join gain using (bucket) where own = 1 group by r),
d as (
  select doc_id, len(ws) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5)::double / 4294967296)))::bigint as score
  from w left join v using (r) where own = 1),
k as (select *, case when words >= 20 then row_number() over (partition by words >= 20 order by score desc, doc_id) end as place, count(*) filter (where words >= 20) over () * 5 // 100 as drawn from d)
select doc_id, n_features, weight, score, case when place <= drawn then place end as rank from k
"""
