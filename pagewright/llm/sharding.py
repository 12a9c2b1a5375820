"""Balanced label propagation (native): linked documents move to the shards of their neighbours under row quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import numbered, parts, written

#: Rows of one numbering bucket: what one task sorts at most, about.
BUCKET_ROWS = 20_000
#: Copies of a group's label, so that a group with a third of all rows is joined in this many tasks.
SALTS = 16
#: Characters of the lines that link the texts they occur in.
LEAST_LINE = 40
#: Propagation ends when a round up and a round down together lower the cut by less than this share.
LEAST_FALL = 0.005
#: Votes are compared in steps of 1 / VOTE.
VOTE = 8


def shared_lines(docs: DataFrame) -> DataFrame:
    """grp, line: the links of a graph between different texts (grp: their digest) and the lines of LEAST_LINE characters or more that several of them have
    (line: a hash). A line is a node of its own, so one in many texts makes a link for each, not for each two."""
    lines = docs.where("text is not null").select(_digest().alias("grp"), F.explode(F.split("text", "\n")).alias("line")).select("grp", F.trim("line").alias("line"))
    links = written(lines.where(F.length("line") >= LEAST_LINE).select("grp", F.xxhash64("line").alias("line")).distinct(), "shard-lines")
    several = written(links.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "shard-several")  # so that Spark may split a common line's links
    return written(links.join(several, "line", "left_semi").select("grp", "line"), "shard-links")


def _digest() -> Column:
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def _sums(by: str, n_shards: int, what: Column) -> Column:
    return F.array(*[F.sum(F.when(F.col(by) == s, what).otherwise(0)) for s in range(n_shards)])


def line_counts(links: DataFrame, labels: DataFrame, n_shards: int) -> DataFrame:
    """line, on (documents of each shard that have it), of labels(grp, members, label)."""
    return links.join(labels, "grp").groupBy("line").agg(_sums("label", n_shards, F.col("members")).alias("on"))


def cut_of(counts: DataFrame) -> int:
    """The links of documents to lines that most of a line's documents are not beside: those outside its largest shard."""
    total = F.aggregate("on", F.lit(0).cast("long"), lambda a, x: a + x)
    return counts.agg(F.sum(total - F.array_max("on"))).first()[0] or 0


def _wishes(links: DataFrame, counts: DataFrame, labels: DataFrame, n_shards: int, up: bool) -> DataFrame:
    """labels with target and gain: the shard that a group's neighbours, the other documents of its lines, are most in, by their present shards, if that is more
    than in its own; a line's votes add up to 1, so that common ones say little. Only moves to higher shards (or lower ones) in one round, so that two
    neighbours don't change places."""
    own = lambda s: F.when(F.col("label") == s, F.col("members")).otherwise(0)
    met = links.join(counts, "line").join(labels, "grp")
    others = F.aggregate("on", F.lit(0).cast("long"), lambda a, x: a + x) - F.col("members")
    votes = met.groupBy("grp", "members", "label").agg(F.array(*[F.sum((F.col("on")[s] - own(s)) / F.greatest(others, F.lit(1))) for s in range(n_shards)]).alias("votes"))
    shards = F.array(*[F.struct(F.floor(F.col("votes")[s] * VOTE).alias("n"), F.xxhash64("grp", F.lit(s)).alias("tie"), F.lit(s).alias("shard")) for s in range(n_shards)])
    best = F.array_max(F.filter(shards, lambda x: x["shard"] > F.col("label") if up else x["shard"] < F.col("label")))
    wished = votes.select("grp", "members", "label", best.alias("b"), F.floor(F.element_at("votes", F.col("label") + 1) * VOTE).alias("here"))
    return wished.where("b is not null and b.n > here").select("grp", "members", "label", F.col("b.shard").alias("target"), (F.col("b.n") - F.col("here")).alias("gain"))


def propagated(links: DataFrame, labels: DataFrame, room: list[int], n_shards: int) -> tuple[DataFrame, list[int]]:
    """labels(grp, members, label) after rounds of moves to the neighbours' shards, and the cut before each round; room: what each shard's quota leaves, changed
    along.

    In each round lines count their documents by shard, groups ask for the shard of their neighbours, and shards admit whole groups as long as they have
    room, those that gain most first (then the largest). Rounds go up and down in turn, until two of them lower the cut by less than LEAST_FALL; the labels of
    the least cut count."""
    cuts, best = [], (None, labels, list(room))
    while True:
        counts = written(line_counts(links, labels, n_shards), "shard-counts")
        cuts.append(cut_of(counts))
        if best[0] is None or cuts[-1] < best[0]:
            best = cuts[-1], labels, list(room)
        if cuts[-1] == 0 or (len(cuts) > 2 and cuts[-1] > cuts[-3] * (1 - LEAST_FALL)):
            room[:] = best[2]
            return best[1], cuts
        wishes = written(_wishes(links, counts, labels, n_shards, len(cuts) % 2 == 1), "shard-wishes")
        kinds = ["target", "gain", "members"]
        asked = wishes.groupBy(*kinds).agg(F.count("*").alias("n")).collect()  # a row for each shard, gain and size of a group
        taken = []
        for r in sorted(asked, key=lambda r: (-r.gain, -r.members, r.target)):
            k = max(0, min(r.n, room[r.target] // r.members))
            room[r.target] -= k * r.members
            taken.append((r.target, r.gain, r.members, k, r.n))
        sizes = labels.sparkSession.createDataFrame(taken, "target int, gain long, members long, taken long, n long")
        known = wishes.join(F.broadcast(sizes), kinds)
        part = numbered(known.where("taken > 0 and taken < n"), kinds, ["grp"], "turn", parts(sum(r[4] for r in taken if 0 < r[3] < r[4]), BUCKET_ROWS), "grp").where("turn < taken")
        moved = written(known.where("taken = n").select("grp", "members", "label", "target").unionByName(part.select("grp", "members", "label", "target")), "shard-moves")
        for r in moved.groupBy("label").agg(F.sum("members").alias("n")).collect():
            room[r.label] += r.n
        labels = written(labels.join(moved.select("grp", "target"), "grp", "left").select("grp", "members", F.coalesce("target", "label").alias("label")), "shard-labels")


def balanced_shards(docs: DataFrame, n_shards: int = 8, cuts: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs(doc_id, text).

    Documents with equal texts are linked, and so are those that share a line of LEAST_LINE characters. Equal texts form a group, which has one label. Every group
    with links first asks for a shard drawn by its smallest shared line (without one: where most of its members were dealt round robin), or the best one
    whose quota still has room for all of it; a shard admits whole groups, the largest first, and a refused group asks for its next shard. Then labels
    propagate (see propagated; cuts gets the cut before each round). Groups larger than a quota are placed before the others, and the groups that fit nowhere
    whole after them (fewer than n_shards: each is larger than any room left), over as few shards as hold them. At last the rows without links fill what the
    quotas leave. Counts differ by at most one: the law `rows`.

    Null text: size 1, crc of no bytes, no links; an empty text is a text. Repeated rows count each. Null doc_id: an ordinary row.
    Empty table: no rows. Other columns are ignored."""
    spark = docs.sparkSession
    base = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
            _digest().alias("grp"),
        ).withColumn("salt", F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id() % 64)),  # also parts rows without ids, and repeated ones
        "shard-base",
    )
    links = shared_lines(docs)
    n = base.count()
    buckets = parts(n, BUCKET_ROWS)
    quota = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    start = numbered(base, [], ["doc_id", "text_crc32"], "row", buckets, "salt")
    start = written(start.withColumn("shard", (F.col("row") % n_shards).cast("int")).drop("row"), "shard-start")
    dealt = F.array(*[F.count_if(F.col("shard") == s) for s in range(n_shards)])
    drawn = F.array(*[F.when(F.pmod(F.xxhash64("line"), F.lit(n_shards)) == s, F.col("members")).otherwise(0) for s in range(n_shards)])
    every = start.where("grp is not null").groupBy("grp").agg(F.count("*").alias("members"), dealt.alias("dealt")).join(links.groupBy("grp").agg(F.min("line").alias("line")), "grp", "left")
    groups = written(every.where("members > 1 or line is not null").select("grp", "members", F.when(F.col("line").isNotNull(), drawn).otherwise(F.col("dealt")).alias("votes")), "shard-groups")
    room = list(quota)
    split = _spread(groups.where(F.col("members") > min(quota)).collect(), room)  # fewer than n_shards groups
    asking, settled = groups.where(F.col("members") <= min(quota)), []
    while True:
        asks = asking.withColumn("label", _label(room))
        # a row for each shard and size of a group
        classes = asks.where("label is not null").groupBy("label", "members").agg(F.count("*").alias("n")).collect()
        if not classes:
            break
        taken = _admit(classes, room)
        some = sum(r.n for r in classes if 0 < taken[r.label, r.members] < r.n)
        sizes = spark.createDataFrame([(r.label, r.members, taken[r.label, r.members], r.n) for r in classes], "label int, members long, taken long, n long")
        known = asks.join(F.broadcast(sizes), ["label", "members"], "left")
        part = numbered(known.where("taken > 0 and taken < n"), ["label", "members"], ["grp"], "turn", parts(some, BUCKET_ROWS), "grp")
        whole = known.where("taken is null or taken = 0 or taken = n").withColumn("admitted", F.coalesce(F.col("taken") > 0, F.lit(False)))
        after = whole.unionByName(part.withColumn("admitted", F.col("turn") < F.col("taken")).drop("turn")) if some else whole
        after = written(after.select("grp", "members", "votes", "label", "admitted"), "shard-asks")
        settled.append(after.where("admitted").select("grp", "members", "label"))
        asking = after.where("not admitted").drop("label", "admitted")
    split += _spread(asking.collect(), room)  # fewer than n_shards groups
    places = spark.createDataFrame(split, "grp binary, ends array<struct<end:long,shard:int>>").withColumn("label", F.lit(None).cast("int"))
    if settled:
        labels, fell = propagated(links, written(reduce(DataFrame.unionByName, settled), "shard-labels"), room, n_shards)
        if cuts is not None:
            cuts += fell
        places = places.unionByName(labels.select("grp", "label"), allowMissingColumns=True)
    state = written(_with_group(start.drop("shard"), places), "shard-state")
    whole = state.where("label is not null").withColumn("shard", F.col("label"))
    cut = numbered(state.where("ends is not null"), ["grp"], ["doc_id", "text_crc32"], "turn", buckets, "salt")
    cut = cut.withColumn("shard", F.filter("ends", lambda e: F.col("turn") < e["end"])[0]["shard"])
    single = numbered(state.where("label is null and ends is null"), [], ["doc_id", "text_crc32"], "row", buckets, "salt")
    ends, at = [], 0
    for s in range(n_shards):
        at += room[s]
        ends.append(at)
    shard = F.lit(n_shards - 1)
    for s in reversed(range(n_shards - 1)):
        shard = F.when(F.col("row") < ends[s], F.lit(s)).otherwise(shard)
    columns = ["doc_id", "size", "text_crc32", "shard", "grp", "salt"]
    linked = whole.select(*columns, F.lit(True).alias("linked")).unionByName(cut.select(*columns, F.lit(True).alias("linked")))
    placed = written(linked.unionByName(single.withColumn("shard", shard.cast("int")).select(*columns, F.lit(False).alias("linked"))), "shard-placed")
    out = numbered(placed, ["shard"], ["doc_id", "text_crc32"], "slot", parts(n, BUCKET_ROWS * n_shards), "salt")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "grp", "linked")


def _label(room: list[int]) -> Column:
    """The shard with most of a group's votes among those with room for its members; null if none has."""
    shards = F.array(*[F.struct(F.col("votes")[s].alias("n"), F.xxhash64("grp", F.lit(s)).alias("tie"), F.lit(s).alias("shard"), F.lit(r).cast("long").alias("room")) for s, r in enumerate(room)])
    return F.array_max(F.filter(shards, lambda x: x["room"] >= F.col("members")))["shard"].cast("int")


def _admit(classes: list[Row], room: list[int]) -> dict[tuple[int, int], int]:
    """How many groups of each (label, members) their shard admits, the largest first; takes them from room."""
    taken = {}
    for r in sorted(classes, key=lambda r: -r.members):
        taken[r.label, r.members] = min(r.n, room[r.label] // r.members)
        room[r.label] -= taken[r.label, r.members] * r.members
    return taken


def _spread(groups: list[Row], room: list[int]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """(grp, [(end, shard), ...]): where the rows of each group go, in order, by row numbers. Takes them from room.

    First each group fills the shards with most room while it has rows for all of one; then what is left of it, the largest first, goes
    to the fullest shard that holds it, or where none does, to those with most room."""
    left = {bytes(g.grp): g.members for g in sorted(groups, key=lambda g: (-g.members, bytes(g.grp)))}
    votes = {bytes(g.grp): g.votes for g in groups}
    ends: dict[bytes, list[tuple[int, int]]] = {g: [] for g in left}

    def put(g: bytes, s: int, k: int) -> None:
        ends[g].append(((ends[g][-1][0] if ends[g] else 0) + k, s))
        left[g] -= k
        room[s] -= k

    def most(g: bytes) -> int:
        return max(range(len(room)), key=lambda s: (room[s], votes[g][s]))

    for g in left:
        while left[g] and left[g] >= room[s := most(g)]:
            put(g, s, room[s])
    for g in sorted(left, key=lambda g: -left[g]):
        while left[g]:
            holds = [s for s in range(len(room)) if room[s] >= left[g]]
            s = min(holds, key=lambda s: (room[s], -votes[g][s])) if holds else most(g)
            put(g, s, min(left[g], room[s]))
    return list(ends.items())


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows left-joined to groups by grp, each group in SALTS copies."""
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.col("salt"), F.lit(SALTS)).cast("int")).join(salted, ["grp", "_salt"], "left").drop("_salt")


def op8_balanced_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    placed = balanced_shards(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
