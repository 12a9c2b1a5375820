"""Prefix trie of conversations with subtree totals, by leaf-peeling messages between the paths of the trie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Fixed by the task: conversation c takes its first turns from c - c % GROUP, crc32(c) % HEADS of them.
GROUP, HEADS = 5, 9
#: Places of a conversation, or depths of a path, that are summed in one task; longer ones go in two levels.
SEGMENT = 512
#: Conversation ids, by range, that are joined to one string.
IDS = 4096

PLACED = "conv_id long, part int, at long, hi long, lo long, n_bytes long"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over turns in order: each turn's place among those of its conversation in this partition, and 128 bits of its role and text."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        begins = np.append(True, conv[1:] != conv[:-1])
        first = np.flatnonzero(begins)
        at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
        if conv[0] == last:
            at[: first[1] if len(first) > 1 else None] += seen
        last, seen = conv[-1], at[-1] + 1
        roles, texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text"))
        marks = b"".join(hashlib.blake2b(b"%d:%b%b" % (len(r), r, t), digest_size=16).digest() for r, t in zip(roles, texts))
        hi, lo = np.frombuffer(marks, np.int64).reshape(-1, 2).T
        sizes = np.array([len(t) for t in texts], np.int64)
        columns = (batch.column("conv_id"), np.full(len(conv), part, np.int32), at, np.ascontiguousarray(hi), np.ascontiguousarray(lo), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["conv_id", "part", "at", "hi", "lo", "n_bytes"])


def _placed(conversations: DataFrame) -> DataFrame:
    """Turns in range partitions of (conv_id, turn, role, text): a long conversation spans several, and equal turns are parted too."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("row")
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "row"]
    return written(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_place, PLACED), "turns")


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, hi, lo, n_bytes) of each rebuilt turn, depths from 1, and (conv_id, length) of each conversation.

    Conversation c, with h = crc32(decimal c) % heads, is the first h turns of conversation c - c % group (all if fewer, none if absent; the
    remainder has the sign of c), then c's own turns after its first h. heads = 1 leaves conversations as they are."""
    placed = _placed(conversations)
    runs = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("conv_id").orderBy("part")
    runs = runs.select("conv_id", "part", F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("turns"))
    runs = written(runs, "runs")
    every = runs.groupBy("conv_id").agg(F.max("turns").alias("turns"))
    base = every.select(F.col("conv_id").alias("base"), F.col("turns").alias("there"))
    drawn = every.withColumn("h", F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    drawn = drawn.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    drawn = written(drawn.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length")), "drawn")
    at = (F.col("at") + F.col("before")).alias("at")
    known = runs.join(drawn.select("conv_id", "h", "taken"), "conv_id")
    own = placed.join(known, ["conv_id", "part"]).select("conv_id", at, "h", "taken", "hi", "lo", "n_bytes").where("at >= h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "hi", "lo", "n_bytes")
    first = placed.join(runs.where(F.col("before") < heads), ["conv_id", "part"]).select(F.col("conv_id").alias("base"), at, "hi", "lo", "n_bytes").where(F.col("at") < heads - 1)
    head = drawn.where("taken > 0").join(first, "base").where("at < taken").select("conv_id", (F.col("at") + 1).alias("depth"), "hi", "lo", "n_bytes")
    return own.unionByName(head), drawn.select("conv_id", "length")


def _segment(depth: str) -> F.Column:
    return F.expr(f"{depth} div {SEGMENT}")


def _members(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Each conversation at each of its depths, the root included: k1, k2 the node (128 bits of the turns so far, by exclusive or of marks bound to
    their depths), p1, p2 its parent, last: whether the conversation ends there."""
    marks = [F.xxhash64(F.lit(i), "depth", "hi", "lo").alias(f"m{i}") for i in (1, 2)]
    marked = turns.select("conv_id", "depth", "n_bytes", *marks, _segment("depth").alias("seg"))
    sums = marked.groupBy("conv_id", "seg").agg(*[F.expr(f"bit_xor(m{i})").alias(f"s{i}") for i in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "seg", *[F.coalesce(F.expr(f"bit_xor(s{i})").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = marked.join(sums, ["conv_id", "seg"]).select("*", *[F.expr(f"bit_xor(m{i})").over(inside).bitwiseXOR(F.col(f"b{i}")).alias(f"k{i}") for i in (1, 2)])
    keyed = keyed.select("conv_id", "depth", "n_bytes", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"m{i}")).alias(f"p{i}") for i in (1, 2)])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.select("conv_id", zero.alias("depth"), zero.alias("n_bytes"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"))
    return written(keyed.unionByName(root), "members")


def _nodes(members: DataFrame) -> DataFrame:
    """The trie's nodes, named by (path, depth): the path is the member with the smallest hash, so a child either carries its parent's path on or begins
    one of its own, and a walk down from the root changes paths about log(members) times, however long the conversations are."""
    first = F.min(F.struct(F.xxhash64("conv_id").alias("h"), "conv_id"))["conv_id"]
    smallest = [F.min(c).alias(c) for c in ("conv_id", "p1", "p2", "n_bytes")]
    nodes = members.groupBy("depth", "k1", "k2").agg(first.alias("path"), F.count("*").alias("n_convs"), *smallest)
    nodes = written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up"))
    linked = written(nodes.join(above, ["depth", "p1", "p2"], "left"), "linked")
    below = linked.where("depth > 0").groupBy(F.col("up").alias("path"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    return written(linked.join(below, ["path", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "family")


def _peeled(nodes: DataFrame) -> DataFrame:
    """up, depth, leaves, saved: what the paths that hang from a node count in all.

    A path holds a counter of the paths that hang from it. In each round those whose counter is 0 are complete and send their totals up; a path adds them
    to its own and lowers its counter, until only the root's path is left and it is complete too."""
    paths = nodes.groupBy("path").agg(
        F.min(F.struct("depth", "up")).alias("top"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.sum("saved").alias("saved")
    ).select("path", F.col("top.up").alias("up"), (F.col("top.depth") - 1).alias("depth"), "leaves", "saved")
    paths = written(paths, "paths")
    hanging = paths.where("depth >= 0").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("open"))
    state = written(paths.join(hanging, "path", "left").withColumn("open", F.coalesce("open", F.lit(0))), "peel")
    done = []
    while True:
        complete, waiting = state.where("open = 0"), state.where("open > 0")
        done.append(complete.where("depth >= 0").groupBy("up", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        if waiting.isEmpty():
            break
        sent = complete.groupBy(F.col("up").alias("path")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        state = written(waiting.join(sent, "path", "left").select("path", "up", "depth", *added, (F.col("open") - F.coalesce("n", F.lit(0))).alias("open")), "peel")
    return reduce(DataFrame.unionByName, done).groupBy("up", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over strings of ids in order of node and id: a node's digest. Keeps the hash's state alone, however many ids a node has."""
    now, hashed = None, None
    names = ("depth", "k1", "k2")

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i, n in enumerate((*names, "ends_sha256"))})

    for batch in batches:
        rows = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*names, "ids"))):
            if key != now:
                if now is not None:
                    rows.append((*now, hashed.hexdigest()))
                now, hashed = key, hashlib.sha256(ids.encode())
            else:
                hashed.update(b"," + ids.encode())
        if rows:
            yield out(rows)
    if now is not None:
        yield out([(*now, hashed.hexdigest())])


def _endings(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the nodes at which conversations end."""
    ends = members.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"], "left_semi")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    joined = ends.groupBy("depth", "k1", "k2", F.floor(F.col("conv_id") / IDS).alias("range")).agg(ids)
    return joined.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "range").mapInArrow(_ends, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of sequences: turns(conv_id, depth, hi, lo, n_bytes), depths from 1 without gaps, hi and lo a mark of the
    turn, and lengths(conv_id, length), each conversation once.

    conv_id: smallest member; depth; parent_conv_id; n_convs, n_children, n_leaves, saved_tokens, ends_sha256: see op12. No conversation: no nodes."""
    members = _members(turns, lengths)
    nodes = _nodes(members)
    hung = _peeled(nodes).select(F.col("up").alias("path"), "depth", F.col("leaves").alias("hung_leaves"), F.col("saved").alias("hung_saved"))
    leaves = (F.col("n_children") == 0).cast("long") + F.coalesce("hung_leaves", F.lit(0))
    own = nodes.join(hung, ["path", "depth"], "left").select("*", leaves.alias("leaves"), (F.col("saved") + F.coalesce("hung_saved", F.lit(0))).alias("all_saved"), _segment("depth").alias("seg"))
    own = written(own.drop("hung_leaves", "hung_saved"), "own")
    later = Window.partitionBy("path").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("path", "seg").agg(F.sum("leaves").alias("a"), F.sum("all_saved").alias("b"))
    sums = sums.select("path", "seg", F.coalesce(F.sum("a").over(later), F.lit(0)).alias("a"), F.coalesce(F.sum("b").over(later), F.lit(0)).alias("b"))
    below = Window.partitionBy("path", "seg").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    whole = own.join(sums, ["path", "seg"]).withColumn("n_leaves", F.sum("leaves").over(below) + F.col("a")).withColumn("saved_tokens", F.sum("all_saved").over(below) + F.col("b"))
    ended = whole.join(_endings(members, lengths), ["depth", "k1", "k2"], "left")
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations.

    Null turns come first; equal turns of a conversation are in order of role, then text. Null role or text: empty. Rows with null conv_id belong to
    no conversation and are left out. Repeated rows are turns each. A conversation without turns after rebuilding is a member of the root
    alone. Other columns are ignored. Empty table: no rows."""
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP12_SQL = r"""
with tab as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
cv as (select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as ls from conversations where conv_id is not null group by conv_id),
cr as (select conv_id, ls, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 9 as h from cv, tab),
rb as (select c.conv_id, list_concat(coalesce(b.ls[1:c.h], []), c.ls[c.h + 1:]) as ls from cr c left join cr b on b.conv_id = c.conv_id - c.conv_id % 5),
pre as (select conv_id, len(ls) as n, d, ls[1:d] as p from (select conv_id, ls, unnest(range(len(ls) + 1)) as d from rb)),
nd as (select d as depth, p, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * coalesce(strlen(p[d].t), 0) as saved, string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d) as ends from pre group by d, p),
ch as (select p[1:depth - 1] as p, depth - 1 as depth, count(*) as n from nd where depth > 0 group by 1, 2),
own as (select nd.*, coalesce(ch.n, 0) as n_children from nd left join ch using (depth, p)),
up as (select p[1:k] as p, k as depth, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved_tokens from (select p, saved, n_children, unnest(range(depth + 1)) as k from own) group by 1, 2)
select o.conv_id, o.depth::bigint as depth, q.conv_id as parent_conv_id, o.n_convs::bigint as n_convs, o.n_children::bigint as n_children, u.n_leaves::bigint as n_leaves, u.saved_tokens::bigint as saved_tokens, sha256(coalesce(o.ends, '')) as ends_sha256
from own o join up u on u.depth = o.depth and u.p = o.p left join nd q on q.depth = o.depth - 1 and q.p = o.p[1:o.depth - 1]
"""
