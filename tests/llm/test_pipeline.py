import random

import corpus_pipeline
from tests.llm.conftest import SCHEMA, prose, table
from tests.oracle import DATA

STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_empty_tables_and_columns(spark, nothing, edge):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, DATA)
        assert out.count() == 0
        if name != "pieces":
            assert out.columns == edge.columns


def with_ids(spark, pairs):
    clash = len(SCHEMA.split(",")) - 5
    return spark.createDataFrame([(i, t, lang, "s", 1) + ("x",) * clash for i, t, lang in pairs], SCHEMA)


def test_rejected_rows_take_no_others_along(spark):
    """Null and repeated ids: each row is judged by its own text."""
    rng = random.Random(2)
    known = [(i, prose(rng, lang, 60), lang) for i in range(40) for lang in ("aa", "bb")]
    pairs = [(None, known[0][1], None), (None, "123 456", None), (None, None, None), (7, "!!", "aa"), (None, known[1][1], "aa")]
    docs = with_ids(spark, known + pairs)
    got = STAGES["language"](spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is None) == sorted([(None, known[0][1]), (None, known[1][1])])
    assert sum(r.doc_id == 7 for r in got) == 2 and len(got) == len(known) + 2


def test_near_copies_of_null_and_repeated_ids(spark):
    rng = random.Random(4)
    a, b = prose(rng, "aa", 90), prose(rng, "bb", 90)
    docs = with_ids(spark, [(5, a, None), (5, a, None), (5, a, None), (None, a, None), (None, b, None), (None, b, None), (9, None, None), (9, None, None), (None, "", None)])
    got = STAGES["near_copies"](spark, docs, DATA)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, a), (None, b), (9, None), (None, "")], key=str)


def test_leaks_take_no_others_along(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    rng = random.Random(6)
    docs = with_ids(spark, [(None, item, None), (None, prose(rng, "aa", 50), None), (3, prose(rng, "bb", 50) + " " + item, None), (3, "short", None), (None, None, None)])
    got = STAGES["decontaminate"](spark, docs, DATA).collect()
    assert len(got) == 3 and not any(item in (r.text or "") for r in got)


def test_redaction_keeps_rows_and_columns(spark):
    docs = table(spark, ["to a@b.c", None, "", "clean", "to a@b.c"])
    got = STAGES["personal_data"](spark, docs.unionByName(docs), DATA)
    assert got.columns == docs.columns and got.count() == 10
    assert sorted(r.text for r in got.collect() if r.text)[0] == "clean"


def corpus(rng):
    """(doc_id, text, lang) and benchmark items; what the language models and the benchmark must reject is known by construction."""
    items = [prose(rng, ("aa", "bb")[i % 2], rng.randint(20, 60)) for i in range(8)]
    base = [prose(rng, ("aa", "bb")[i % 2], 110) for i in range(40)]
    for i in range(0, 12):
        base[i] += f" contact: u{i}@mail.example.com or call"
    for i in range(12, 16):
        base[i] += f" contact: QX-4471-8{i} or call"
    for i in range(16, 20):
        base[i] += f" host 10.0.0.{i} of"
    rows = [(t, ("aa", "bb")[i % 2]) for i, t in enumerate(base)]
    for i in range(6):
        words = base[i + 20].split(" ")
        words[50] = "edited"
        rows += [(base[i], ("aa", "bb")[i % 2]), (" ".join(words), None)]
    leaked = [prose(rng, "aa", 40) + ". " + items[i] + ". " + prose(rng, "aa", 30) for i in range(4)]
    rejected = [None, "", "12 34 !", "q" * 400]
    rows += [(t, None) for t in leaked + rejected]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, *rows[k]) for i, k in enumerate(order)], items, set(leaked), set(rejected)


def plain_run(rows, leaked, rejected):
    """The stages one after another in plain loops: (doc_id, text as it is when it is cut into pieces)."""
    from pagewright.llm import pii
    from tests.llm.test_near import brute
    from tests.llm.test_pii import base, graph

    left = [(d, t) for d, t, _ in rows if t not in rejected]
    first = brute([t for _, t in left], 5, 80, 100)
    left = [x for i, x in enumerate(left) if first[i][2]]
    left = [(d, t) for d, t in left if t not in leaked]
    more = graph([t for _, t in left])
    out = []
    for i, (d, t) in enumerate(left):
        at, text = 0, ""
        for start, _, end, kind in sorted(base(t) + [(a, len(pii.KINDS), b, pii.FOUND) for j, a, b in more if j == i]):
            if start >= at:
                text += t[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        out.append((d, text + t[at:]))
    return out


def test_whole_run_by_plain_loops(spark, tmp_path):
    from pyspark.sql import functions as F

    from pagewright.llm import pieces
    from tests.llm.test_pieces import best_path

    rows, items, leaked, rejected = corpus(random.Random(11))
    with_ids(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_pieces, r.ids_hash, r.decoded_sha256, r.round_trip) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model = pieces.load()
    texts = plain_run(rows, leaked, rejected)
    assert any("[ID]" in t for _, t in texts) and any("[EMAIL]" in t for _, t in texts) and len(texts) < len(rows) - 10
    want = spark.createDataFrame([(d, t, best_path(t, model)) for d, t in texts], "doc_id long, text string, ids array<int>")
    want = want.select("doc_id", F.size("ids"), F.hex(F.xxhash64("ids")), F.sha2("text", 256), F.lit(True))
    assert got == {r[0]: tuple(r[1:]) for r in want.collect()}
