import hashlib
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from pagewright.llm import pii
from tests.llm.conftest import table


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def base(t):
    """Spans by the plain patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


TEXTS = [
    "a@b.c a@b-c@d.e x@y.z.@q.r .@a.b é😀 m.n+o@p-q.example.com", "1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 12 4111111111111111",
    "+1 (555) 010-2030 +12 +1-2-3-4-5-6-7-8-9 +123456789012345678", "9" * 5000 + " " + "1 " * 3000, "a@" * 3000, "@@..@a.b", "+" * 50 + "1 2", "a" * 4000 + "@b." + "c." * 2000 + "d", None, "",
]


def test_base_spans(spark):
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.spans_of(table(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == base(t or ""), i


def test_edges(edge, edge_texts, nothing):
    assert pii.spans_of(edge).count() == len(edge_texts)
    assert pii.spans_of(nothing).count() == 0
    assert pii.redact(edge).columns == edge.columns and pii.redact(edge).count() == len(edge_texts)


def test_patterns_find_unseen_identifiers(spark):
    """A word that always comes before seeds finds identifiers no base pattern knows; an ordinary word does not."""
    texts = [f"contact: u{i}@mail.example.com and the u{i}@mail.example.org" for i in range(40)] + ["contact: QX-4471-88 today", "the ZZ-1234-55 thing", "the the the and the " * 20]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.extra] for r in pii.spans_of(table(spark, texts)).collect()}
    assert got[40] == [(9, 19, "id")]
    assert got[41] == [] and all(not got[i] for i in range(40))


def test_redaction(spark):
    texts = ["to a@b.c, 1.2.3.4!", None, "clean", "to a@b.c, 1.2.3.4!"]
    got = {r.doc_id: (r.text, r.n_chars, r.kept) for r in pii.redact(table(spark, texts)).collect()}
    assert got == {0: ("to [EMAIL], [IP]!", 17, "x"), 1: (None, None, "x"), 2: ("clean", 5, "x"), 3: ("to [EMAIL], [IP]!", 17, "x")}


def test_found_identifiers_induce_patterns(spark):
    """Identifiers found after one word make another word a pattern, which finds the rest; one such identifier is not enough."""
    texts = [f"contact: u{i}@mail.example.com" for i in range(40)] + [f"contact: QX-4471-8{i} today" for i in range(5)]
    texts += [f"see ticket QX-4471-8{i}" for i in range(5)] + ["see ticket ZW-9935-12", "near depot QX-4471-80", "near depot ZW-7777-12"]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.extra] for r in pii.spans_of(table(spark, texts)).collect()}
    assert got[44] == [(9, 19, "id")]
    assert got[45] == [(11, 21, "id")] and got[50] == [(11, 21, "id")]
    assert got[51] == got[52] == []


def test_long_words_and_many_matches(spark):
    """A word of a million letters before a match, long white space, and thousands of matches take seconds."""
    texts = ["a" * 1_000_000 + ".y 1.2.3.4", "b" + " " * 200_000 + "x" * 200_000 + "!." * 100_000 + "y 1.2.3.4", "1.2.3.4 " * 5_000, "é,, Word: !! 1.2.3.4", "word\n1.2.3.4", "?! 1.2.3.4", ""]
    start = time.time()
    rows = table(spark, texts).select(F.col("doc_id"), pii._places(F.col("text"), pii.PATTERNS["ip"], "[0-9]").alias("p")).select("doc_id", F.transform("p", lambda s: F.struct(s["start"], s["end"], pii._left_word(s["before"]))).alias("p"))
    got = {r.doc_id: [tuple(x) for x in r.p] for r in rows.collect()}
    assert time.time() - start < 60
    assert got[0] == [(1_000_003, 1_000_010, "y")] and got[1] == [(600_003, 600_010, "y")]
    assert got[2] == [(8 * i, 8 * i + 7, None) for i in range(5_000)]
    assert [got[i][0][2] for i in (3, 4, 5)] == ["word", "word", None] and got[6] == []


def test_keys_after_a_word_of_their_own(spark):
    """Tokens in the form of keys make the word before them a pattern; then other tokens after it are found too, and keys elsewhere are not."""
    keys = [hashlib.sha1(bytes([i])).hexdigest() for i in range(6)]
    texts = [f'x secret = "{k}" y' for k in keys] + ['secret: "AB-12345"', f"commit {keys[0]} of the commit log, commit by commit", "a secret 99887766x"]
    got = {r.doc_id: [(s.start, s.end) for s in r.extra] for r in pii.spans_of(table(spark, texts)).collect()}
    assert all(got[i] == [(12, 52)] for i in range(6)) and got[6] == [(9, 17)] and got[7] == [] and got[8] == [(9, 18)]


def graph(texts):
    """The pattern-instance graph in plain loops: added spans of each text."""
    left = lambda s: (m[1].lower() if (m := re.search(r"(\w+)\W*$", s)) else None)
    words, edges, seeds, free = Counter(), Counter(), set(), []
    for i, t in enumerate(texts):
        words.update(re.split(r"\W+", t.lower()))
        spans = base(t)
        ends = {k: 0 for k in pii.KINDS}
        for start, rank, end, kind in spans:
            edges[left(t[:start]), t[start:end]] += 1
            seeds.add(t[start:end]) if left(t[:start]) else None
        for m in re.finditer(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9][A-Za-z0-9_-]{5,}", t):
            if sum(c.isdigit() for c in m[0]) >= pii.MIN_DIGITS and not any(s < m.end() and m.start() < e for s, _, e, _ in spans):
                free.append((i, m.start(), m.end(), left(t[: m.start()])))
                edges[left(t[: m.start()]), m[0]] += 1
        assert ends
    edges = {k: n for k, n in edges.items() if k[0] is not None}
    keys = {v for _, v in edges if len(v) >= 20 and sum(c.isdigit() for c in v) >= 6 and sum(c.isalpha() for c in v) >= 6}
    fixed = dict.fromkeys(seeds | keys, 1.0)
    score, last, trust = dict(fixed), None, {}
    while True:
        trust = {}
        for pattern in {p for p, _ in edges}:
            mine = [(score[v], n) for (p, v), n in edges.items() if p == pattern and v in score]
            if sum(s >= pii.TRUSTED for s, _ in mine) >= pii.MIN_SEEDS:
                trust[pattern] = min(1.0, sum(s * n for s, n in mine) / words[pattern])
        if last is not None and last.keys() == trust.keys() and all(abs(last[p] - trust[p]) <= pii.SETTLED for p in trust):
            break
        last = trust
        miss = {}
        for p, v in edges:
            if p in trust:
                miss[v] = miss.get(v, 1.0) * max(1e-9, 1 - trust[p])
        score = {v: 1 - m for v, m in miss.items()} | fixed
    return {(i, a, b) for i, a, b, w in free if trust.get(w, 0) >= pii.TRUSTED}


def test_added_spans_by_a_plain_graph(spark):
    rng = random.Random(8)
    names = [f"w{i}" for i in range(12)]
    ids = [f"{rng.choice('ABCD')}X-{rng.randint(1000, 1030)}-{rng.randint(10, 12)}" for _ in range(25)]
    value = lambda w: (rng.choice((f"u{rng.randint(0, 9)}@mail.example.com", f"{rng.randint(1, 9)}.2.3.4")) if w < 3 else rng.choice(ids[(w % 5) * 5 : (w % 5) * 5 + 6]) if w < 8 or rng.random() < 0.4 else "plain")
    texts = []
    for _ in range(150):
        t = []
        for _ in range(rng.randint(1, 8)):
            w = rng.randrange(12)
            v = value(w) if rng.random() < 0.9 else rng.choice(("text", ids[rng.randrange(25)], f"u{rng.randint(0, 9)}@mail.example.com"))
            t.append(names[w] + rng.choice((" ", ": ", ' = "')) + v)
        texts.append(" and ".join(t))
    got = {(r.doc_id, s.start, s.end) for r in pii.spans_of(table(spark, texts)).collect() for s in r.extra}
    assert got == graph(texts) and got


def test_thousands_of_spans_and_tokens_in_one_text(spark):
    """Tokens beside as many base spans, covered and free ones, and null and repeated rows of such texts: linear in both."""
    part = "mail u1@mail.example.com or X-{0:06d} and a99887766@mail.example.com id-{0:05d} "
    text = "".join(part.format(i) for i in range(10_000))
    rows = spark.createDataFrame([(1, text, 0)] * 2 + [(None, text, 1), (2, None, 1), (3, "X-123456", 2)], "doc_id long, text string, at int")
    start = time.time()
    found = pii.spans_of(rows).select("doc_id", F.size("base").alias("n"), "extra").collect()
    assert time.time() - start < 60
    assert sorted((r.doc_id or -1, r.n) for r in found) == [(-1, 20_000), (1, 20_000), (1, 20_000), (2, 0), (3, 0)]
    free = pii._free(spark.createDataFrame([(1, bytearray(b"k"), *pair) for pair in [spans_and_tokens()] * 2], FREE)).collect()
    assert sorted((r.start, r.end) for r in free) == sorted([(a, b) for a, b in plain_free()] * 2)


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,left:string>>"
FREE = f"doc_id long, text_key binary, base {SPAN}, tokens {SPAN}"
BASE, TOKENS = [(5, 9), (7, 20), (30, 31), (40, 60), (42, 44)], [(0, 5), (4, 6), (9, 12), (19, 25), (20, 30), (31, 33), (44, 50), (60, 61), (70, 80)]


def spans_and_tokens():
    span = lambda x: (x[0], 0, x[1], "k", "v", None)
    return [span(b) for b in BASE], [span(t) for t in TOKENS]


def plain_free():
    return [(a, b) for a, b in TOKENS if not any(x < b and a < y for x, y in BASE)]
