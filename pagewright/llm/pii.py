"""Bootstrapped contextual extraction of personal data (native): seeds induce patterns, patterns find unseen identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

KINDS = ("email", "ip", "card", "phone")
#: The method's own kind, after the base kinds in order.
FOUND = "id"
#: Fixed patterns. Same matches as the plain forms: a local part can only start where its run of characters starts, or where the last
#: match ended; nothing follows the possessive repetitions, so they only stop the matcher from recursing on very long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A kind needs this in the text.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "[+][0-9]"}
#: Identifier-like tokens: what patterns may find, if they have MIN_DIGITS digits and no base span covers any of them.
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{5,}+"
MIN_DIGITS = 4
#: Keys and secrets by their form: tokens of so many characters, with so many digits and so many letters. They are seeds beside the base spans, but a
#: seed is no span: it is found only after a pattern, as any other token.
KEY_LENGTH, KEY_MIX = 20, 6
#: A pattern (the word before an instance) counts with so many distinct seeds or trusted instances, and is trusted from this score.
MIN_SEEDS = 3
TRUSTED = 0.8
#: Scores have settled when the patterns stay the same and no score changes by more than this.
SETTLED = 1e-3
#: Matches of a text whose places are summed at a time.
PART = 256
#: Begins the names of columns that are added to documents for a while.
OWN = "_pagewright_"


def _starts(sizes: Column) -> Column:
    """Array of where each of sizes(gap, hit) begins: after its gap and all before. In parts of PART, so that no fold copies more than a part at a time."""
    kind = "array<bigint>"
    cuts = F.sequence(F.lit(1), F.size(sizes), F.lit(PART))

    def within(part: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
        add = lambda a, x: F.struct((a["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out"))
        return F.aggregate(part, first, add)

    def beside(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0).cast("bigint")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["at"])))
        return F.flatten(F.zip_with(parts, F.slice(ends, 1, F.size(parts)), lambda p, base: F.transform(p["out"], lambda x: x + base)))

    folded = F.transform(cuts, lambda c: within(F.slice(sizes, c, F.lit(PART))))
    return F.get(F.transform(F.array(folded), beside), F.lit(0))


def _places(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, value, before>> of the leftmost non-overlapping matches, in code points; before: the text up to the last match."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(h).cast("bigint").alias("hit"), g.alias("before"), h.alias("value")))
    span = lambda x, at: F.struct(at.alias("start"), (at + x["hit"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"))
    whole = F.get(F.transform(F.array(zipped), lambda all_: F.when(F.size(all_) > 0, F.zip_with(all_, _starts(all_), span))), F.lit(0))
    there = F.instr(text, "@") > 0 if needs == "@" else text.rlike(needs)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    return F.coalesce(F.when(there, whole), empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    reverse = F.split(F.reverse(digits), "")
    doubled = F.transform(reverse, lambda d, i: F.when(d == "", F.lit(0)).when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).otherwise(d.cast("int")).cast("long"))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _only_valid(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["value"]))


def _slim(kind: str, rank: int) -> Column:
    """kind's spans without the text before them; array order is start, then rank."""
    return F.transform(
        kind,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), _left_word(s["before"]).alias("left")
        ),
    )


def _left_word(before: Column) -> Column:
    """The word before a place, past any punctuation and white space, in lower case; null where there is none. Read from the end, so that it takes as long as what it reads."""
    word = F.reverse(F.regexp_extract(F.reverse(before), r"^[^\p{L}\p{N}_]*+([\p{L}\p{N}_]++)", 1))
    return F.when(word != "", F.lower(word))


def _free(found: DataFrame) -> DataFrame:
    """doc_id, text_key, start, rank, end, kind, value, left of the tokens of found(doc_id, text_key, base, tokens) that no base span overlaps.

    Base spans stand at their start and tokens at their end; walking over both in order, a token is covered if a span that began before its end reaches beyond
    its start. Sorting and one pass, however many there are of both."""
    names = ("start", "rank", "end", "kind", "value", "left")
    alone = found.where((F.size("tokens") > 0) & (F.size("base") == 0)).select("doc_id", "text_key", F.explode("tokens").alias("t"))
    both = found.where((F.size("tokens") > 0) & (F.size("base") > 0))
    event = lambda s, at, token: F.struct(s[at].alias("at"), F.lit(token).alias("token"), s.alias("s"))
    events = F.concat(F.transform("tokens", lambda t: event(t, "end", 0)), F.transform("base", lambda b: event(b, "start", 1)))
    # rows of one text that is there several times are told apart by nothing, and give the same tokens each: one of them is walked over
    texts = both.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"), F.first("tokens").alias("tokens"), F.first("base").alias("base"))
    rows = texts.select("doc_id", "text_key", "copies", F.explode(events).alias("e")).select("doc_id", "text_key", "copies", "e.*")
    before = Window.partitionBy("doc_id", "text_key").orderBy("at", "token").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("token") == 1, F.col("s.end"))).over(before)
    kept = rows.withColumn("reach", reach).where((F.col("token") == 0) & (F.coalesce("reach", F.lit(0)) <= F.col("s.start")))
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return alone.select("doc_id", "text_key", *[F.col(f"t.{c}") for c in names]).unionByName(kept.select("doc_id", "text_key", *[F.col(f"s.{c}") for c in names]))


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base: array<struct<start, rank, end, kind>>, extra: the same for what the method adds, per row of docs(doc_id, text).

    Pattern-instance graph: a pattern is the word before MIN_SEEDS distinct instances that are seeds or found with TRUSTED score. Seeds
    (base spans, and tokens in the form of keys) score 1. In each round a pattern scores the sum of its instances' scores over all places of its word in the corpus,
    an instance 1 - product of (1 - score) of its patterns, until no pattern comes or goes and no score changes by over SETTLED. Tokens after patterns of
    TRUSTED score are added as kind `id`.

    Null or empty text: no spans. Repeated rows get the same spans each. Offsets are code points, end exclusive. Spans that begin together are in the
    order of their kinds. Other columns are ignored. Empty table: no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text"))
    places = raw.select("doc_id", "text_key", *[_places(F.col("text"), PATTERNS[k], NEEDS[k]).alias(k) for k in KINDS], _places(F.col("text"), TOKEN, "[0-9]").alias("tokens"))
    kept = places.select("doc_id", "text_key", "tokens", *[_only_valid(k).alias(k) for k in KINDS])
    base = F.array_sort(F.concat(*[_slim(k, r) for r, k in enumerate(KINDS)]))
    found = written(
        kept.select("doc_id", "text_key", base.alias("base"), F.filter(_slim("tokens", len(KINDS)), lambda t: F.length(_digits(t["value"])) >= MIN_DIGITS).alias("tokens")), "pii-places"
    )
    free = written(_free(found), "pii-tokens")
    seeds = found.select(F.explode("base").alias("b")).select(F.col("b.left").alias("pattern"), F.col("b.value").alias("instance")).where("pattern is not null").groupBy("pattern", "instance").agg(F.count("*").alias("n")).withColumn("seed", F.lit(True))
    others = free.select(F.col("left").alias("pattern"), F.col("value").alias("instance")).where("pattern is not null").groupBy("pattern", "instance").agg(F.count("*").alias("n")).withColumn("seed", F.lit(False))
    edges = written(seeds.unionByName(others), "pii-edges")
    # every place of a pattern's word in the corpus, whatever follows
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("all"))
    total = written(words.join(edges.select("pattern").distinct(), "pattern"), "pii-totals")
    key = (F.length("instance") >= KEY_LENGTH) & (F.length(_digits(F.col("instance"))) >= KEY_MIX) & (F.length(F.regexp_replace("instance", "[^A-Za-z]", "")) >= KEY_MIX)
    seeded = edges.where(F.col("seed") | key).select("instance", F.lit(1.0).alias("score")).distinct()
    score, last = seeded, None
    while True:
        sure = F.count_if(F.col("score") >= TRUSTED)
        able = edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n")).join(score, "instance").groupBy("pattern").agg(sure.alias("s"), F.sum(F.col("score") * F.col("n")).alias("hits")).where(F.col("s") >= MIN_SEEDS)
        pattern = written(able.join(total, "pattern").select("pattern", F.least(F.lit(1.0), F.col("hits") / F.greatest("all", F.lit(1))).alias("p")), "pii-patterns")
        if last is not None:
            changed = pattern.join(last.withColumnRenamed("p", "q"), "pattern", "full").where(F.coalesce(F.abs(F.col("p") - F.col("q")), F.lit(1.0)) > SETTLED)
            if changed.isEmpty():
                break
        last = pattern
        met = edges.join(pattern, "pattern").select("pattern", "instance", "p").distinct().groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("p")))))).alias("score"))
        score = written(met.unionByName(seeded).groupBy("instance").agg(F.max("score").alias("score")), "pii-instances")
    new = (
        free.join(pattern.where(F.col("p") >= TRUSTED).withColumnRenamed("pattern", "left"), "left")
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "rank", "end", F.lit(FOUND).alias("kind")))).alias("extra"))
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    slimmer = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind")))
    new = new.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    joined = found.join(new, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select("doc_id", "text_key", slimmer.alias("base"), F.coalesce("extra", none).alias("extra"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each found span of text replaced by [KIND] (overlapping ones: the earlier start first); n_chars, where it is there, counted anew.

    All other columns stay as they are. Null text stays null."""
    mine = spans_of(docs).where("size(base) + size(extra) > 0").select(F.col("doc_id").alias(f"{OWN}doc"), F.col("text_key").alias(f"{OWN}key"), F.array_sort(F.concat("base", "extra")).alias(f"{OWN}spans")).dropDuplicates([f"{OWN}doc", f"{OWN}key"])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    text = F.aggregate(f"{OWN}spans", start, put, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    joined = docs.withColumn(f"{OWN}text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(mine, F.col("doc_id").eqNullSafe(F.col(f"{OWN}doc")) & (F.col(f"{OWN}text") == F.col(f"{OWN}key")), "left")
    out = joined.withColumn("text", F.when(F.col(f"{OWN}spans").isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{OWN}spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2_contextual_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of every document, as strings and counts."""
    found = spans_of(documents(spark, sf_dir))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", "extra"))).alias("spans"), (F.size("base") + F.size("extra")).cast("long").alias("n_spans"))
