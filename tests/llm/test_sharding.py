import random
from collections import Counter

from pagewright.llm.sharding import balanced_shards
from tests.llm.conftest import table


def check(rows, texts, n):
    assert len(rows) == len(texts)
    count = Counter(r.shard for r in rows)
    assert max(count[s] for s in range(n)) - min(count[s] for s in range(n)) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


def test_edges(edge, edge_texts, nothing):
    rows = balanced_shards(edge, 4).collect()
    check(rows, edge_texts, 4)
    by = {r.doc_id: r for r in rows}
    assert by[0].size == 1 and by[0].text_crc32 == 0 and by[3].size == 4
    assert by[5].shard == by[6].shard == by[11].shard
    assert balanced_shards(nothing).count() == 0


def test_groups_stay_together_and_a_large_one_is_split(spark):
    texts = [f"g{i % 20}" for i in range(100)] + ["hot"] * 80 + [f"single {i}" for i in range(61)] + [None, None]
    rows = balanced_shards(table(spark, texts), 8).collect()
    check(rows, texts, 8)
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(where[f"g{i}"]) > 1 for i in range(20)) <= 2


def spread(rows, texts):
    """The shards of each text that occurs more than once."""
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    return {t: where[t] for t, k in Counter(texts).items() if k > 1}


def test_a_group_over_a_quota_takes_as_few_shards_as_hold_it(spark):
    """A third of all rows in one group: two full shards and a part; no small group is refused for good."""
    texts = ["hot"] * 200 + [f"g{i % 60}" for i in range(240)] + [f"single {i}" for i in range(160)]
    rows = balanced_shards(table(spark, texts), 8).collect()
    check(rows, texts, 8)
    where = spread(rows, texts)
    assert len(where["hot"]) == 3
    assert all(len(where[f"g{i}"]) == 1 for i in range(60))


def test_linked_rows_only(spark):
    """Without single rows to fill up, only groups larger than any room left are split: fewer than there are shards."""
    texts = [f"g{i}" for i in range(67) for _ in range(2 + i % 9)] + ["large"] * 70 + ["larger"] * 75
    rows = balanced_shards(table(spark, texts), 8).collect()
    check(rows, texts, 8)
    where = spread(rows, texts)
    assert len(where["large"]) <= 2 and len(where["larger"]) <= 2
    assert sum(len(where[f"g{i}"]) > 1 for i in range(67)) < 8


def test_fewer_rows_than_shards(spark):
    texts = ["a", "a", "b", "b", "b"]
    check(balanced_shards(table(spark, texts), 8).collect(), texts, 8)


def families(rng, n, size, lines=6):
    """Different texts of n families; those of one share most of their lines."""
    own = [[f"family {f} line {i} " + "x" * 40 for i in range(lines)] for f in range(n)]
    return [(f, "\n".join([*rng.sample(own[f], lines - 1), f"only here {f} {k} " + "y" * 40, "a line that very many of the documents have in common"])) for f in range(n) for k in range(size)]


def cut(rows, texts):
    """The cut, by a plain loop: of each line's documents those outside its largest shard."""
    where = {}
    for r in rows:
        for line in {x.strip(" ") for x in (texts[r.doc_id] or "").split("\n")}:
            if len(line) >= 40:
                where.setdefault(line, Counter())[r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in where.values())


def test_labels_move_to_their_neighbours(spark):
    """Families come together, the cut falls, counts stay even, and the cut told is that of the result."""
    rng = random.Random(4)
    texts = [t for _, t in families(rng, 24, 10)] + [f"single {i}" for i in range(120)] + [None] * 3
    rng.shuffle(texts)
    cuts = []
    rows = balanced_shards(table(spark, texts), 8, cuts).collect()
    check(rows, texts, 8)
    assert min(cuts) < cuts[0] and min(cuts) == cut(rows, texts)
    hot = 24 * 10 - max(Counter(r.shard for r in rows if "very many" in (texts[r.doc_id] or "")).values())
    assert min(cuts) - hot <= 0.1 * sum(6 * 10 for _ in range(24))


def test_one_round_against_a_plain_loop(spark):
    """Votes of neighbours by their present shards, moves in one direction, quotas."""
    from pyspark.sql import functions as F

    from pagewright.llm import sharding

    rng = random.Random(5)
    links = {(g, rng.randrange(12)) for g in range(40) for _ in range(3)}
    labels = {g: (rng.randint(1, 3), rng.randrange(4)) for g in range(40)}
    link = spark.createDataFrame([(bytes([g]), i) for g, i in links], "grp binary, line long")
    label = spark.createDataFrame([(bytes([g]), m, s) for g, (m, s) in labels.items()], "grp binary, members long, label int")
    counts = sharding.line_counts(link, label, 4)
    on = {i: [sum(labels[g][0] for g, j in links if j == i and labels[g][1] == s) for s in range(4)] for i in range(12)}
    assert {r.line: list(r.on) for r in counts.collect()} == {i: v for i, v in on.items() if any(v)}
    assert sharding.cut_of(counts) == sum(sum(v) - max(v) for v in on.values())
    for up in (True, False):
        want = {}
        for g, (m, s) in labels.items():
            mine = [i for h, i in links if h == g]
            votes = [sum((on[i][t] - m * (t == s)) / max(1, sum(on[i]) - m) for i in mine) for t in range(4)]
            steps = [int(v * sharding.VOTE + 1e-12) for v in votes]
            able = [steps[t] for t in range(4) if (t > s if up else t < s)]
            if able and max(able) > steps[s]:
                want[g] = (max(able) - steps[s], {t for t in range(4) if (t > s if up else t < s) and steps[t] == max(able)})
        got = {r.grp[0]: (r.gain, r.target) for r in sharding._wishes(link, counts, label, 4, up).collect()}
        assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and got[g][1] in want[g][1] for g in got)
    room = [3, 3, 3, 3]
    full = [room[s] + sum(m for m, t in labels.values() if t == s) for s in range(4)]
    after, cuts = sharding.propagated(link, label, room, 4)
    held = Counter()
    for r in after.collect():
        held[r.label] += r.members
    assert all(held[s] + room[s] == full[s] and room[s] >= 0 for s in range(4)) and min(cuts) < cuts[0]
    assert sharding.cut_of(sharding.line_counts(link, after, 4)) == min(cuts) and after.agg(F.count("*")).first()[0] == 40


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "same")] * 150 + [(7, "other")] * 100 + [(i, f"t{i}") for i in range(53)], "doc_id long, text string")
    rows = balanced_shards(df, 8).collect()
    count = Counter(r.shard for r in rows)
    assert len(rows) == 303 and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(count[s])) for s in count)
