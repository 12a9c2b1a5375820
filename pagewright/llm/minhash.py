"""b-bit MinHash near-duplicates: banded minima give candidates, packed low bits an estimate, full sets the answer."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_CHARS, components, documents, map_texts, written
from .words import MIX_2, U, lists, mix, text_shingles

#: 32 bands of 4 minima: a pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Low bits kept of each minimum, and how far an estimate may lie under the threshold before a pair is dropped unverified: 5 deviations.
BITS = 2
SLACK = 0.2
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | U(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> bytes | None:
    """Equal sets, equal keys; None for the empty set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signature_batch(k: int):
    def run(ids: pa.Array, text_keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        sets = text_shingles(texts, k)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        keys = [set_key(s) for s in sets]
        bands = np.zeros((len(full), BANDS), U)
        low = np.zeros((len(full), HASHES), np.uint8)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            begin = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
            with np.errstate(over="ignore"):
                for b in range(BANDS):
                    key = np.full(len(full), U(b + 1) * MIX_2)
                    for r in range(ROWS):
                        j = b * ROWS + r
                        minimum = np.minimum.reduceat(flat * _A[j] + _B[j], begin)
                        key = mix(key + minimum)
                        low[:, j] = (minimum * MIX_2) >> U(64 - BITS)
                    bands[:, b] = key
        packed = np.packbits(((low[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1).reshape(len(full), HASHES * BITS), axis=1)
        words = packed.reshape(-1).view(">i8").astype(np.int64).reshape(len(full), HASHES * BITS // 64)
        spread = lambda table: lists(table.ravel(), np.concatenate([[0], np.cumsum(np.where(sizes > 0, table.shape[1], 0))]), pa.int64())
        return pa.RecordBatch.from_pydict(
            {"doc_id": ids, "text_key": text_keys, "n_shingles": pa.array(sizes), "set_key": pa.array(keys, pa.binary()), "bands": spread(bands.view(np.int64)), "packed": spread(words)}
        )

    return run


def text_key() -> Column:
    """The text's digest, null as the empty text: with doc_id the key of a row."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (equal sets, equal keys; null without words), bands, packed (low bits of the minima as longs)."""
    schema = "doc_id long, text_key binary, n_shingles long, set_key binary, bands array<long>, packed array<long>"
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return map_texts(mine, _signature_batch(k), schema, ("doc_id", "text_key", "text"), FEW_CHARS)


def _sets_batch(k: int):
    def run(texts: pa.Array) -> pa.RecordBatch:
        sets = text_shingles(texts, k)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        return pa.RecordBatch.from_pydict({"set_key": pa.array([set_key(s) for s in sets], pa.binary()), "shingles": lists(flat, offsets, pa.int64())})

    return run


def estimate(a: str | Column, b: str | Column) -> Column:
    """Similarity from packed low bits, corrected for the minima whose low bits agree by chance."""
    both = F.zip_with(a, b, lambda x, y: _differs(x.bitwiseXOR(y)))
    share = 1 - F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + x) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def _differs(x: Column) -> Column:
    """How many of the 32 pairs of bits of x are not both 0 (BITS is 2: a pair for each minimum)."""
    folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
    return F.bit_count(folded).cast("long")


def near_classes(docs: DataFrame, k: int = 3, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, first for every row of docs(doc_id, text): components of the links between sets of
    k-word shingles with intersection * threshold[1] >= union * threshold[0]. component_id is the smallest doc_id of the component, kept
    whether it is the row's own, first whether doc_id and text_key are the smallest pair of their component (null ids last).

    Equal sets are one class, a node of its own, before any pair is made. Classes that share a band are linked to the first class of that
    bucket if their packed signatures and then their full sets agree. Where a bucket then still holds several components, `_across`
    finds the links between them, so that no link is lost to the choice of the first.

    Null, empty and wordless texts: n_shingles 0, a component of their own. Repeated rows: the same result each. One doc_id with several
    texts: each text is compared; component_id is that of the row's text. Null doc_id: linked as others are, but a component_id only if
    some member has an id, and kept only without one. Other columns are ignored. Empty table: no rows."""
    signed = written(signatures(docs, k), "signatures")
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min(F.struct(*_order())).alias("row"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    named = classes.select(F.col("row.text_key").alias("_text"), F.col("row.doc_id").alias("_doc"), "node")
    reps = signed.join(named, (signed["text_key"] == named["_text"]) & signed["doc_id"].eqNullSafe(named["_doc"])).select("node", "bands", "packed")
    reps = written(reps.dropDuplicates(["node"]), "class-signatures")
    rows = reps.select("node", F.explode("bands").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    shared = written(rows.join(heads, "bucket"), "buckets")
    pairs = shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    sets = _sets_of(docs, classes.join(shared.select("node").distinct(), "node"), reps, k)
    links = written(_verified(pairs, sets, threshold), "links")
    label = components(_across(shared, links, sets, threshold))
    found = classes.join(label, "node", "left").select("set_key", "rep", "row", F.coalesce("component", "node").alias("class"))
    least = found.groupBy("class").agg(F.min("rep").alias("least"), F.min("row").alias("least_row"))
    found = found.join(least, "class").select(F.col("set_key").alias("_key"), "least", "least_row")
    out = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(found, F.col("set_key") == F.col("_key"), "left")
    alone = F.col("set_key").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least"))
    first = alone | (F.struct(*_order()) == F.col("least_row"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first"))


def _order() -> list[Column]:
    """Rows in order: by doc_id, null ids last, then by text."""
    return [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key")]


def _sets_of(docs: DataFrame, classes: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """node, shingles, packed of classes(node, set_key, row): the full sets, from one text of each class."""
    wanted = classes.select(F.col("row.doc_id").alias("_doc"), F.col("row.text_key").alias("_text")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text")), "left_semi").select("text")
    sets = map_texts(texts, _sets_batch(k), "set_key binary, shingles array<long>", ("text",), FEW_CHARS)
    return written(sets.join(classes.select("node", "set_key"), "set_key").dropDuplicates(["node"]).join(reps.select("node", "packed"), "node").drop("set_key"), "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int], estimated: bool = True) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; with estimated, of those whose estimate is near it or over it."""
    need, of = threshold
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("packed").alias("pa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("packed").alias("pb"))
    both = pairs.join(two, "b").join(one, "a")
    able = F.least(F.size("sa"), F.size("sb")).cast("long") * of >= F.greatest(F.size("sa"), F.size("sb")).cast("long") * need
    if estimated:
        able = able & (estimate("pa", "pb") >= need / of - SLACK)
    common = F.when(able, F.size(F.array_intersect("sa", "sb"))).otherwise(F.lit(0)).cast("long")
    return both.withColumn("_common", common).where((F.col("_common") * of >= (F.size("sa") + F.size("sb") - F.col("_common")) * need) & (F.col("_common") > 0)).select("a", "b")


def _relabelled(label: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(node, ...) with component: the node itself where no link was found."""
    return nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _across(shared: DataFrame, links: DataFrame, sets: DataFrame, threshold: tuple[int, int], rounds: int = 3) -> DataFrame:
    """links and those between different components among the classes of buckets that still hold several components.

    Not all pairs of a bucket: the shingles of these classes are ordered by their count, and two sets that reach the threshold share one
    of their first size - ceil(threshold * size) + 1. A set with more edits than that has only shingles of its own there, and meets nobody.
    The classes under a shingle are first compared with the one that has fewest shingles of its own, near the middle of its copies,
    and merged; what is left in different components is then joined, if the shingles that each has for itself, and those before
    the common one, leave room for the threshold."""
    need, of = threshold
    label = components(links)
    named = _relabelled(label, shared)
    several = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    mixed = written(named.join(several, "bucket").select("node").distinct(), "mixed")
    if not mixed.limit(1).count():
        return links
    token = sets.join(mixed, "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = token.groupBy("token").agg(F.count("*").alias("often"))
    least = F.floor((F.col("n").cast("long") * need + of - 1) / of)
    # a sort that spills, and nothing but the prefix leaves it; a shingle counted once has no partner
    order = Window.partitionBy("node").orderBy("often", "token")
    ranked = token.join(often, "token").withColumn("at", F.row_number().over(order) - 1)
    first = ranked.where(F.col("at") <= F.col("n") - least)
    own = F.count_if(F.col("often") == 1).over(Window.partitionBy("node")).cast("int")
    prefix = written(first.withColumn("own", own).where("often > 1").select("node", "n", "own", "at", "token"), "prefixes")

    def open_prefixes(label: DataFrame) -> DataFrame:
        named = _relabelled(label, prefix)
        several = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("own", "node", "component")).alias("mid")).where("lo < hi").select("token", "mid")
        return named.join(several, "token")

    for _ in range(rounds):
        star = open_prefixes(label).where(F.col("component") != F.col("mid.component")).select(F.col("mid.node").alias("a"), F.col("node").alias("b")).distinct()
        more = written(_verified(star, sets, threshold, False), "links-across")
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        label = components(links)
    left = written(open_prefixes(label).drop("mid"), "open-prefixes")
    one = left.withColumnsRenamed({"node": "a", "component": "ca", "n": "na", "own": "oa", "at": "ia"})
    two = left.withColumnsRenamed({"node": "b", "component": "cb", "n": "nb", "own": "ob", "at": "ib"})
    # at their first common shingle, no more are left to share than stand from there on
    most = F.least(F.col("na") - F.greatest("oa", "ia"), F.col("nb") - F.greatest("ob", "ib")).cast("long")
    room = most * (need + of) >= (F.col("na") + F.col("nb")).cast("long") * need
    near = (one["token"] == two["token"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & room
    return links.unionByName(written(_verified(one.join(two, near).select("a", "b").distinct(), sets, threshold, False), "links-across"))


def op4_minhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir), 3, (85, 100)).drop("text_key", "first")


#: Exact classes by joining shingles.
OP4_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end)) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * m >= 85 * (x.n + y.n - m)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b),
k as (select a as doc_id, min(b) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, k.component_id, d.doc_id = k.component_id as kept
from documents d left join n using (doc_id) left join k using (doc_id)
"""
