"""Language-model scores by stupid backoff: count tables partitioned by n-gram hash, joined to the corpus's exploded n-grams, summed per document."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, parts, text_chunks, written
from .words import ALNUM, BASE, LOWER, MIX_1, U, lists, mix, raw, word_hashes, word_spans

#: Fixed value of the method: what a step back to the shorter n-gram costs.
BACKOFF = 0.4
#: Words of the longest n-grams.
ORDER = 3
#: Texts that ask for counts together, in bytes; bytes of text for each bucket of a count table, a range of hashes, and for each task that holds buckets:
#: several, so that tasks are of like size.
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 6 << 20
TASK_BYTES = 24 << 20


def _grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams of 1 to ORDER words that end at each word (0 where a text has not as many words before), and each text's first word (one
    entry more)."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, ALNUM)
    words = word_hashes(data, starts, ends)
    at = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [words]
    with np.errstate(over="ignore"):
        for n in range(1, ORDER):
            longer = np.zeros_like(words)
            longer[1:] = mix(out[-1][:-1] * BASE + words[1:] * MIX_1 + U(n))
            longer[at < n] = 0
            out.append(longer)
    return out, bounds


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """Chunks with the number of their block. The same scan makes the same blocks."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for ids, texts in text_chunks(batches):
        yield block, ids, texts
        size += texts.nbytes
        if size >= BLOCK_BYTES:
            block, size = block + 1, 0


def _distinct(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a block in order, and how often each occurs there."""
    return np.unique(np.concatenate([g[g != 0] for g in held]) if held else np.zeros(0, U), return_counts=True)


def _edges(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket begins in sorted n-grams, and their end."""
    return np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(buckets)], U)).tolist() + [len(keys)]


ASKED = "block long, bucket int, grams array<long>, counts array<int>"


def _asked(order: int, buckets: int):
    """A row for each block and bucket: the block's different n-grams of that order, sorted, and their counts there."""

    def rows(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = _distinct(held)
        edges = _edges(grams, buckets)
        there = [b for b in range(buckets) if edges[b + 1] > edges[b]]
        ends = [0, *(edges[b + 1] for b in there)]
        return pa.RecordBatch.from_pydict({
            "block": pa.array([block] * len(there), pa.int64()), "bucket": pa.array(there, pa.int32()),
            "grams": lists(grams.view(np.int64), ends, pa.int64()), "counts": lists(n, ends, pa.int32()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for block, _, texts in _blocks(batches):
            if block != now and held:
                yield rows(now, held)
                held = []
            now = block
            held.append(_grams(texts)[0][order])
        if held:
            yield rows(now, held)

    return run


def _answers(mine: DataFrame, order: int, buckets: int, tasks: int) -> DataFrame:
    """order, block, bucket, at, total (arrays) of one order: to each block the n-grams that other blocks have too, by their place in its sorted bucket, with their count in the corpus.

    Blocks send arrays to the buckets. There these are exploded into a row for each n-gram of a block, and each row is joined to its n-gram's
    entry of the count table, the sum of its rows. A window does both in one pass: a self-join would have to shuffle every row again."""
    asked = mine.mapInArrow(_asked(order, buckets), ASKED).repartition(tasks, "bucket")
    exploded = asked.select("block", "bucket", F.posexplode(F.arrays_zip("grams", "counts")).alias("at", "g")).select("block", "bucket", "at", F.col("g.grams").alias("gram"), F.col("g.counts").alias("n"))
    counted = exploded.withColumn("total", F.sum("n").over(Window.partitionBy("bucket", "gram")))
    found = counted.where("total > n").groupBy("block", "bucket").agg(F.collect_list(F.struct("at", "total")).alias("found"))
    return found.select(F.lit(order).alias("order"), "block", "bucket", F.col("found.at").alias("at"), F.col("found.total").alias("total"))


def _texts_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=6)
    for block, ids, texts in _blocks(batches):
        data, offsets = raw(texts)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "docs": one(ids), "offsets": one(pa.array(offsets, pa.int64())), "texts": pa.array([press.compress(data.tobytes())], pa.binary())})


def _elsewhere(grams: np.ndarray, keys: np.ndarray, total: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in other documents than its own; 0 for no n-gram."""
    at = np.where(grams != 0, np.searchsorted(keys, grams), len(keys))
    _, where, own = np.unique(doc * U(len(keys) + 1) + at.astype(U), return_inverse=True, return_counts=True)
    return np.append(total, 0)[at] - np.where(grams != 0, own[where], 0)


def _totals(held: list[np.ndarray], answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's different n-grams of an order, and their counts in the corpus: the answers, or else the block's own."""
    keys, total = _distinct(held)
    edges = _edges(keys, buckets)
    for bucket, at, found in zip(answers.column("bucket").to_pylist(), answers.column("at"), answers.column("total")):
        total[edges[bucket] + at.values.to_numpy()] = found.values.to_numpy()
    return keys, total


def _score(buckets: int):
    """Per document of a block: words, steps back, words that met no n-gram of two, the sum of log counts over log contexts."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        every, held = [], []
        for docs, offsets, packed in zip(*(chunks.column(c).to_pylist() for c in ("docs", "offsets", "texts"))):
            ends, data = np.array(offsets, np.int64), unpress.decompress(packed)
            held.append(_grams(pa.Array.from_buffers(pa.large_string(), len(docs), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])))
            every += docs
        known = [_totals([grams[n] for grams, _ in held], answers.filter(pc.equal(answers.column("order"), n)), buckets) for n in range(ORDER)]
        out = {k: [] for k in ("n_words", "n_backoff", "n_alone", "log_sum")}
        log = lambda n: np.log(np.maximum(n, 1))
        for grams, bounds in held:
            words = np.diff(bounds)
            doc = np.repeat(np.arange(len(words), dtype=U), words)
            counts = [_elsewhere(g, *known[n], doc) for n, g in enumerate(grams)] if len(doc) else [np.zeros(0, np.int64)] * ORDER
            backs, term, open_ = np.zeros(len(doc), np.int64), np.zeros(len(doc)), np.ones(len(doc), bool)
            for n in range(ORDER - 1, -1, -1):
                there = grams[n] != 0
                alone = open_
                met = open_ & there & (counts[n] > 0)
                context = np.concatenate([[0], log(counts[n - 1])[:-1]]) if n and len(doc) else 0.0
                term = np.where(met, log(counts[n]) - context, term)
                backs += open_ & there & ~met
                open_ = open_ & ~met
            sums = lambda x: np.add.reduceat(np.concatenate([x, [0]]), bounds[:-1]) * (words > 0)  # noqa: B023, E731
            for k, v in (("n_words", words), ("n_backoff", sums(backs)), ("n_alone", sums(alone.astype(np.int64))), ("log_sum", sums(term))):
                out[k].append(v)
        return pa.table({"doc_id": pa.array(every, pa.int64()), **{k: pa.array(np.concatenate(v) if v else []).cast(pa.float64() if k == "log_sum" else pa.int64()) for k, v in out.items()}})

    return run


def backoff_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score, perplexity of every row of docs(doc_id, text), docs being a stored table (read twice in the same
    partitions). Counts c are those of all of docs but for the row's own text, so a text is not judged by itself.

    log_score sums the natural log of S(w | u v): c(u v w) / c(u v) if c(u v w) > 0, else BACKOFF times S(w | v), c(v w) / c(v) likewise, then
    c(w) / N, and a word that no other text has BACKOFF / N; N: words of all other texts, 1 at least. A text's first words have
    shorter n-grams and pay nothing for that. n_backoff counts the steps.

    For each order: a block of texts sends its different n-grams (64-bit hashes) and their counts to the buckets of the count table, arrays of a
    range of hashes. There they are exploded, summed and joined, and those that other blocks have too return with their counts. Then each block
    scores its texts; what has no answer is known from the block alone. A common n-gram has one row a block, so no key is hot.

    Null, empty and wordless texts: 0 words, log_score 0, perplexity null. Repeated rows count and are scored each, and know each other.
    Other columns are ignored. Empty table: no rows."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts(size, BUCKET_BYTES, 8)
    answers = [written(_answers(mine, n, buckets, parts(size, TASK_BYTES, 8)), f"counts-{n + 1}") for n in range(ORDER)]
    chunks = mine.mapInArrow(_texts_batch, "block long, docs array<long>, offsets array<long>, texts binary")
    every = reduce(DataFrame.unionByName, answers)
    summed = chunks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_score(buckets), "doc_id long, n_words long, n_backoff long, n_alone long, log_sum double")
    summed = written(summed, "scores")
    words = summed.agg(F.sum("n_words")).first()[0] or 0
    score = F.col("log_sum") + F.col("n_backoff") * F.lit(math.log(BACKOFF)) - F.col("n_alone") * F.log(F.greatest(F.lit(1.0), F.lit(words) - F.col("n_words")))
    return summed.select("doc_id", "n_words", "n_backoff", score.alias("log_score"), F.when(F.col("n_words") > 0, F.exp(-score / F.col("n_words"))).alias("perplexity"))


def op6_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    found = backoff_scores(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("perplexity", 2).alias("perplexity"))


OP6_SQL = r"""
with w as (
  select row_number() over () as d, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
t as (select d, unnest(ws) as w, unnest(list_prepend(null, ws[:-2])) as v, unnest(list_prepend(null, list_prepend(null, ws[:-2])[:-2])) as u from w where len(ws) > 0),
n as (select count(*) as n from t),
o as (select d, count(*) as n from t group by 1),
c1 as (select w, sum(n) as n from (select w, count(*) as n from t group by 1) group by 1),
c2 as (select v, w, count(*) as n from t where v is not null group by 1, 2),
c3 as (select u, v, w, count(*) as n from t where u is not null group by 1, 2, 3),
o1 as (select d, w, count(*) as n from t group by 1, 2),
o2 as (select d, v, w, count(*) as n from t where v is not null group by 1, 2, 3),
o3 as (select d, u, v, w, count(*) as n from t where u is not null group by 1, 2, 3, 4),
k as (
  select t.d, t.v is not null as two, t.u is not null as three, c1.n - o1.n as n1, c2.n - o2.n as n2, c3.n - o3.n as n3, b1.n - p1.n as x1, b2.n - p2.n as x2, greatest(1, (select n from n) - o.n)::double as total
  from t join o using (d) join c1 using (w) join o1 using (d, w) left join c2 using (v, w) left join o2 using (d, v, w) left join c3 using (u, v, w) left join o3 using (d, u, v, w)
    left join c1 b1 on b1.w = t.v left join o1 p1 on p1.d = t.d and p1.w = t.v left join c2 b2 on b2.v = t.u and b2.w = t.v left join o2 p2 on p2.d = t.d and p2.v = t.u and p2.w = t.v),
s as (
  select d, case when three and n3 > 0 then ln(n3::double) - ln(x2::double) when two and n2 > 0 then ln(n2::double) - ln(x1::double) when n1 > 0 then ln(n1::double) - ln(total) else -ln(total) end as term,
    case when three and n3 > 0 then 0 when two and n2 > 0 then three::int when n1 > 0 then three::int + two::int else three::int + two::int + 1 end as back
  from k)
select w.doc_id, count(s.term) as n_words, coalesce(sum(s.back), 0)::bigint as n_backoff, round(coalesce(sum(s.term) + sum(s.back) * ln(0.4::double), 0)::double, 4) as log_score,
  round(exp(-(sum(s.term) + sum(s.back) * ln(0.4::double)) / count(s.term)), 2) as perplexity
from w left join s using (d) group by w.d, w.doc_id
"""
