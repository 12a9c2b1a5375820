import os
import random

import pyarrow as pa
import pytest

from pagewright.llm import pieces
from tests.llm.conftest import prose, table

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no public tokenizer here")


def best_path(text, model):
    """Viterbi over a whole text: the highest sum, then the longer last piece. A literal mark stands alone, in bytes."""
    by_piece, out = {p: (i, s) for p, i, s in model.rows}, []
    for k, part in enumerate(text.split(pieces.SPACE)):
        if k:
            out += [model.bytes[b] for b in pieces.SPACE.encode()]
        part = (part if k else " " + part).replace(" ", pieces.SPACE)
        best = [(0.0, 0)]
        for end in range(1, len(part) + 1):
            able = []
            for start in range(max(0, end - 16), end):
                if part[start:end] in by_piece:
                    able.append((best[start][0] + by_piece[part[start:end]][1], end - start))
                elif end == start + 1:
                    able.append((best[start][0] + model.worst, 1))
            best.append(max(able))
        path, end = [], len(part)
        while end:
            path.append(part[end - best[end][1] : end])
            end -= best[end][1]
        for p in reversed(path):
            out += [by_piece[p][0]] if p in by_piece else [model.bytes[b] for b in p.encode()]
    return out


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def test_round_trip_and_paths(spark, model, edge, edge_texts):
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(edge, model), model).collect()}
    for i, t in enumerate(edge_texts):
        assert got[i].decoded == (t or "")
        if len(t or "") < 5000:
            assert got[i].ids == (best_path(t, model) if t else [])


def test_whole_texts(spark, model):
    """Space runs, underscores, line ends, marks, other scripts, words longer than a row of the lattice, ties."""
    rng = random.Random(5)
    bits = ["  ", "    ", " ", "__", "_{", ");\r", "\r\n", "\n", "\t", pieces.SPACE, "é", "日本", "😀", "x" * 300, "the", "ing", "Word", "12", "\u0001", "ab" * 200, "=" * 70, prose(rng, "aa", 3)]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(120)] + ["", " ", "   ", pieces.SPACE, f" {pieces.SPACE} a"]
    got = {r.doc_id: r for r in pieces.encode(table(spark, texts), model, decoded=True).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded == t
        assert got[i].ids == (best_path(t, model) if t else []), t


def test_blocks_and_buckets(spark, model, edge, edge_texts, monkeypatch):
    monkeypatch.setattr(pieces, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 500)
    monkeypatch.setattr(pieces, "LATTICE_LETTERS", 5)
    got = {r.doc_id: r for r in pieces.encode(edge, model, decoded=True).collect()}
    for i in (3, 4, 5, 7, 10, 12):
        assert got[i].ids == best_path(edge_texts[i], model) and got[i].decoded == edge_texts[i]


def test_empty_table(nothing, model):
    assert pieces.encode(nothing, model).count() == 0


def test_a_block_is_handed_on_few_texts_at_a_time(model, monkeypatch):
    """The pipeline's pieces: a block's texts, ids and decoded texts stood in a worker all at once."""
    monkeypatch.setattr(pieces, "FEW_CHARS", 300)
    rng = random.Random(6)
    texts = [prose(rng, "aa", rng.randrange(30)) + rng.choice(["", pieces.SPACE, " é"]) for _ in range(40)] + [""]
    row = {"block": [0], "docs": [list(range(41))], "sizes": [[len(t.encode()) for t in texts]], "texts": [pieces._press("".join(texts).encode())], "bucket": [None], "ids": [None]}
    kinds = {"block": pa.int64(), "docs": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "texts": pa.binary(), "bucket": pa.int32(), "ids": pa.binary()}
    rows = pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in row.items()})
    got = list(pieces._spell(1, model, True)(iter([rows])))
    assert len(got) > 5 and max(sum(map(len, b.column("text").to_pylist())) for b in got) < 300 + max(map(len, texts))
    out = [r for b in got for r in b.to_pylist()]
    assert [(r["doc_id"], r["text"], r["decoded"]) for r in out] == [(i, t, t) for i, t in enumerate(texts)]
    assert [r["ids"] for r in out] == [best_path(t, model) if t else [] for t in texts]


WORDS = ["▁the", "ing", "▁thsthaea", "é日本", "😀", "x" * 256, "▁" * 40, "\u0000\u0001", "a日b😀c", "the" * 80, "▁underschäung", "ab"]


def test_lattice_neither_sorts_nor_collects_edges_by_word(spark, model):
    """op3's CPU seconds: three quarters of the lattice's time went into each word's array of edges and a fold over it."""
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    paths = pieces.lattice_paths(words, model, 3)
    plan = paths._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Aggregate" not in plan and "lambdafunction" not in plan and plan.count("Exchange hashpartitioning") == 1
    speller = pieces.Speller(model)
    assert {r.word: bytes(r.ids) for r in paths.collect()} == {w: speller.spell(w) for w in WORDS}


@pytest.mark.parametrize("held", [1, 70, 10**6])
def test_a_word_in_several_batches_of_edges(model, monkeypatch, held):
    monkeypatch.setattr(pieces, "HELD_EDGES", held)
    speller, rows = pieces.Speller(model), []
    for k, w in enumerate(WORDS):
        for start, size in ((i, n) for i in range(len(w)) for n in range(1, min(model.longest, len(w) - i) + 1)):
            piece = w[start : start + size]
            if piece in speller.ids or size == 1:
                rows.append((w if start + size == 1 else None, k * pieces.PLACES + start + size, speller.ids.get(piece, -1 - ord(piece[0]))))
    columns = zip(("word", "place", "code"), (pa.string(), pa.int64(), pa.int32()), zip(*rows))
    edges = pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, t, v in columns})
    batches = [edges.slice(i, 7) for i in range(0, len(rows), 7)]
    got = [r for b in pieces._paths_batch(model)(iter(batches)) for r in b.to_pylist()]
    assert [(r["word"], r["ids"]) for r in got] == [(w, speller.spell(w)) for w in WORDS]
    with pytest.raises(RuntimeError):
        list(pieces._paths_batch(model)(iter([*batches[3:], *batches[:3]])))
