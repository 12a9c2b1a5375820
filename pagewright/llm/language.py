"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays, lowest cross-entropy, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts, text_flag
from .words import MIX_1, U, raw

#: Characters of an n-gram. A code holds each of them in WIDTH bits: a letter of the basic plane, 0 for what is no letter.
ORDER, WIDTH = 4, 16
#: The models are fitted on about this many labelled rows of each language (whole texts), chosen by hash; a fifth of them calibrates.
FIT_ROWS = 600
#: A document is rejected if its cross-entropy is over this quantile of the calibration rows by MARGIN.
QUANTILE, MARGIN = 0.99, 1.5
#: Below this many symbols a cross-entropy says too little to reject.
LEAST_SYMBOLS = 20
OTHER = 0xFFFF  # any letter outside the basic plane

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0 if it is no letter; later planes: see symbols()."""
    if not _letters:
        table = np.zeros(1 << 16, np.uint16)
        for c in range(1 << 16):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low[0]) if len(low) == 1 and ord(low) < 1 << 16 else c
        _letters.append(table)
    return _letters[0]


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as lower-case letters, every run of other characters as one 0, and ORDER - 1 zeros before each text; where texts start.

    Letters outside the basic plane count as one letter, OTHER."""
    strings = texts.to_pylist()
    data = np.frombuffer(("\0" * 2).join(strings).encode("utf-32-le", "surrogatepass"), np.uint32) if strings else np.zeros(0, np.uint32)
    n = np.array([len(s) for s in strings], np.int64)
    begin = np.concatenate([[0], np.cumsum(n + 2)])[:-1]
    low = letter_table()[np.minimum(data, 0xFFFF)]
    for i in np.flatnonzero(data > 0xFFFF):
        low[i] = OTHER if chr(data[i]).isalpha() else 0
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    at = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], at[np.concatenate([begin, [len(low)]])]


@dataclass
class Model:
    """For each language the sorted hashes of its n-grams of each order with log2 of their probability, those of its contexts with log2 of
    the weight of the order below, and what an unseen symbol costs; limit: the calibrated cross-entropy of rejection."""

    languages: list[str]
    hashes: list[list[np.ndarray]]
    logs: list[list[np.ndarray]]
    weights: list[list[tuple[np.ndarray, np.ndarray]]]
    floor: list[float]
    limit: float = float("inf")

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """-log2 P(last symbol | the ones before) of n-gram codes, in each language: the interpolated probability of the longest n-gram
        seen, or the weights of the contexts passed on the way down to it."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        for j in range(len(self.languages)):
            todo, total = np.arange(len(codes)), np.zeros(len(codes))
            for n in range(ORDER, 0, -1):
                seen, i = find(self.hashes[j][n - 1], key(codes[todo], n))
                out[todo[seen], j] = total[todo[seen]] - self.logs[j][n - 1][i[seen]]
                todo = todo[~seen]
                if n > 1 and len(todo):
                    context = (codes[todo] >> U(WIDTH)) & low_symbols(n - 1)
                    contexts, weights = self.weights[j][n - 2]
                    known, i = find(contexts, key(context, n - 1))
                    total[todo[known]] -= weights[i[known]]
            out[todo, j] = total[todo] + self.floor[j]
        return out


def low_symbols(n: int) -> np.uint64:
    """A mask for the last n symbols of a code."""
    return U((1 << WIDTH * n) - 1)


def key(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the last n symbols: a product with an odd number, so different n-grams never meet."""
    with np.errstate(over="ignore"):
        return (codes & low_symbols(n)) * MIX_1


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return (sorted_keys[i] == keys if len(sorted_keys) else np.zeros(len(keys), bool)), i


def codes_of(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The code of the ORDER symbols that end at each place; before a text there are spaces."""
    code = np.zeros(len(ids), np.uint64)
    age = np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(ORDER):
        prior = np.zeros(len(ids), np.uint64)
        prior[back:] = ids[: len(ids) - back] if back else ids
        code |= np.where(age >= back, prior, U(0)) << U(WIDTH * back)
    return code


def _count_batch(lang: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    low, starts = symbols(texts)
    code = codes_of(low, starts)
    of = np.repeat(np.asarray(lang.to_pylist(), object), np.diff(starts))
    counts = pd.DataFrame({"lang": of, "code": code.view(np.int64)}).groupby(["lang", "code"]).size().reset_index(name="n")
    return pa.RecordBatch.from_pydict({"lang": pa.array(counts["lang"]), "code": pa.array(counts["code"]), "n": pa.array(counts["n"])})


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of each value of lang in labelled(doc_id, text, lang).

    About fit_rows rows a language are read, those with the smallest hashes of doc_id; what comes to the driver is their n-gram counts.
    Rows without lang or text teach nothing. Repeated rows count each. No rows: a model without languages."""
    known = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return Model([], [], [], [], [])
    languages = sorted(sizes)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, fit_rows / sizes[name]))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(draw < share).withColumn("role", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5))).drop("doc_id").persist()
    learn, check = sample.where("role > 0"), sample.where("role = 0")
    counts = map_texts(learn, _count_batch, "lang string, code long, n long", ("lang", "text")).groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    letters = len(np.unique(counts["code"].to_numpy().view(np.uint64) & low_symbols(1)))
    fits = [kneser_ney(g["code"].to_numpy().view(np.uint64), g["n"].to_numpy(), letters + 1) for g in (counts[counts["lang"] == name] for name in languages)]
    model = Model(languages, *[[f[i] for f in fits] for i in range(4)])
    scored = map_texts(check, _score_batch(model, "string"), SCORES.replace("doc_id long", "doc_id string"), ("lang", "text")).where(F.col("symbols") >= LEAST_SYMBOLS)
    high = scored.agg(F.percentile("entropy", QUANTILE)).first()[0]
    sample.unpersist()
    model.limit = float("inf") if high is None else high * MARGIN
    return model


def kneser_ney(codes: np.ndarray, n: np.ndarray, vocabulary: int) -> tuple[list, list, list, float]:
    """Sorted hashes, log2 probabilities and log2 context weights of each order, and the cost of a symbol never seen.

    The highest order has counts, the lower ones count the different symbols before them; each is discounted by ones / (ones + 2 twos)
    and interpolated with the order below, the lowest with an even choice among the vocabulary of all languages."""
    grams: list[tuple[np.ndarray, np.ndarray]] = [(codes, n.astype(float))]
    for k in range(ORDER - 1, 0, -1):
        longer = grams[-1][0]
        grams.append(tuple(map(np.asarray, np.unique(longer & low_symbols(k), return_counts=True))))
    grams.reverse()  # by order
    below = None
    hashes, logs, totals = [], [], []
    for k, (code, count) in enumerate(grams, 1):
        code, first = np.unique(code, return_index=True)
        count = np.asarray(count, float)[first]
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context, where = np.unique(code >> U(WIDTH), return_inverse=True)
        total = np.bincount(where, count)
        kinds = np.bincount(where)
        weight = discount * kinds / total
        lower = np.full(len(code), 1 / vocabulary) if k == 1 else below[1][find(below[0], code & low_symbols(k - 1))[1]]
        p = np.maximum(count - discount, 0) / total[where] + weight[where] * lower
        below = (code, p)
        h = key(code, k)
        order = np.argsort(h)
        hashes.append(h[order])
        logs.append(np.log2(p[order]))
        totals.append((context, np.log2(weight)))
    weights = []
    for k in range(1, ORDER):  # of each context of k symbols, in the order of their hashes
        context, weight = totals[k]
        h = key(context, k)
        order = np.argsort(h)
        weights.append((h[order], weight[order]))
    root = totals[0][1][0] if len(totals[0][1]) else 0.0
    return hashes, logs, weights, float(np.log2(vocabulary) - root)


SCORES = "doc_id long, lang_pred string, score double, entropy double, symbols long"


def _score_batch(model: Model, kind: str = "long"):
    def run(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        low, starts = symbols(texts)
        code = codes_of(low, starts)
        where, seen = pd.factorize(code)
        cost = model.cost(seen.astype(np.uint64))
        letters = np.concatenate([[0], np.cumsum(low != 0)])
        has = letters[starts[1:]] > letters[starts[:-1]]
        n = np.maximum(1, np.diff(starts))
        mean = np.full((len(n), max(1, len(model.languages))), np.inf)
        for j in range(len(model.languages)):
            run_sum = np.concatenate([[0.0], np.cumsum(cost[where, j], dtype=np.float64)])
            mean[:, j] = (run_sum[starts[1:]] - run_sum[starts[:-1]]) / n
        best = mean.argmin(axis=1)
        least = mean.min(axis=1)
        with np.errstate(invalid="ignore", over="ignore"):
            score = 1 / np.exp2(-np.minimum(n, 50)[:, None] * (mean - least[:, None])).sum(axis=1)
        able = has & bool(model.languages)
        pred = [model.languages[b] if a else "und" for a, b in zip(able, best)]
        return pa.RecordBatch.from_pydict(
            {"doc_id": ids, "lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.where(able, np.nan_to_num(score), 0.0)), "entropy": pa.array(np.where(able, least, np.inf)), "symbols": pa.array(np.diff(starts))}
        )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected of every row of docs(doc_id, text).

    `und`, score 0, rejected: null text, or none of its characters is a letter. Otherwise the language of the least cross-entropy a
    symbol (ties: first by name) with its share of all languages' likelihoods; rejected if the entropy is over the calibrated limit.
    Repeated rows: each its result. Other columns are ignored. Empty table: no rows. A model without languages: all `und`."""
    scored = map_texts(docs.select(F.col("doc_id").cast("long"), "text"), _score_batch(model), SCORES)
    return scored.select("doc_id", "lang_pred", "score", "entropy", ((F.col("lang_pred") == "und") | _strange(model)).alias("rejected"))


def _strange(model: Model) -> Column:
    return (F.col("entropy") > model.limit) & (F.col("symbols") >= LEAST_SYMBOLS)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that identify() doesn't reject, each judged by its own text, whatever its other columns."""
    score = _score_batch(model, "string")

    def flags(texts: pa.Array) -> np.ndarray:
        out = score(texts, texts)
        entropy, symbol = (out.column(c).to_numpy() for c in ("entropy", "symbols"))
        return (np.array(out.column("lang_pred").to_pylist()) != "und") & ~((entropy > model.limit) & (symbol >= LEAST_SYMBOLS))

    return docs.where(text_flag(flags))


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op5_language_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Models learned from rows that are not held out, applied to all."""
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
