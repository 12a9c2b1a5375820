import random
import re
import textwrap

from pagewright.llm import licenses
from tests.llm.conftest import table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXTS = [
    "MIT  license, the mit-License\nApache\tLicense.", "mitlicense mit licensed xmit license", "é mit license", "general public license general public\nlicense", None, "", "...",
    "Licensed under the Apache License, Version 2.0.", "licensed under the apache version 2", "All rights reserved", "rights", "mit", "license",
    "Permission is granted free of charge to any person obtaining a copy of software and associated documentation files the software",
]


def split(t):
    return re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(t, templates=licenses.TEMPLATES):
    """Every start of every template is looked at; from the first that meets it on, the best of those inside its run is taken, and so on behind that."""
    w, out = split(t), set()
    for name, text in templates.items():
        length, tokens = len(split(text)), set(split(text))
        good = {k: n for k in range(len(w)) if (n := len(tokens & set(w[k : k + length]))) >= 0.8 * len(tokens) - 1e-9}
        k = 0
        while k < len(w):
            if k not in good:
                k += 1
                continue
            best = max((good[j], -j) for j in range(k, k + length) if j in good)
            out.add((name, -best[1], min(length, len(w) + best[1]), best[0], best[0] / len(tokens)))
            k = -best[1] + length
    return out


def blocks(row):
    return {(b.template, b.first_word, b.words, b.shared, b.containment) for b in row.blocks}


def test_places_and_blocks(spark):
    got = {r.doc_id: r for r in licenses.scan(table(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        w = split(t)
        want = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert got[i].n_words == len(w)
        assert sorted((p.word, p.label) for p in got[i].places) == want
        assert blocks(got[i]) == brute(t)


def test_edges(edge, edge_texts, nothing):
    assert licenses.scan(edge).count() == len(edge_texts) and licenses.scan(nothing).count() == 0


def test_wrapped_notices(spark):
    """Every template, wrapped at every width, as a comment, between empty lines and after other words, is found whole."""
    wrapped, names = [], []
    for name, t in licenses.TEMPLATES.items():
        for width in (8, 20, 40):
            for lead in ("", " * ", "\n# "):
                wrapped.append("Other words here\n" + "\n".join(lead + line for line in textwrap.wrap(t.title(), width, break_long_words=False)) + "\nand more")
                names.append(name)
    got = {r.doc_id: r.blocks for r in licenses.scan(table(spark, wrapped)).collect()}
    for i, name in enumerate(names):
        assert max((b.containment for b in got[i] if b.template == name), default=0) == 1, (name, wrapped[i])


def test_wrapped_form_of_the_grant(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"
    texts = [grant, bsd, mpl, "all rights\n\nreserved", "all other rights\nare reserved"]
    got = {r.doc_id: [(b.template, b.first_word) for b in r.blocks] for r in licenses.scan(table(spark, texts)).collect()}
    assert got == {0: [("mit-grant", 0)], 1: [("bsd-grant", 0)], 2: [("mpl-2.0", 0)], 3: [("all-rights", 0)], 4: []}


def test_runs_against_plain_loops(spark):
    """Whole texts of licenses, sentences and scraps of them, with words lost and other words between."""
    rng = random.Random(5)
    pool = sorted({w for t in licenses.TEMPLATES.values() for w in split(t)} | {"x", "y"})
    texts = []
    for _ in range(120):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(1, 3)):
            lost = rng.choice((0.05, 0.15, 0.25))
            words += [w for w in split(rng.choice(sorted(licenses.TEMPLATES.values()))) if rng.random() > lost]
        texts.append("".join(w + rng.choice((" ", " ", " ", "\n", "\n\n")) for w in words))
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts + texts[:1])).collect()}
    for i, t in enumerate(texts + texts[:1]):
        assert blocks(got[i]) == brute(t), t


def test_notices_one_after_another(spark):
    """Each of several notices has its place, whatever stands between."""
    mit, gpl = "Released under the MIT License", licenses.TEMPLATES["gpl-3.0"]
    rng = random.Random(6)
    texts = [mit + " " + mit, " ".join([mit] * 7), f"{mit} x {mit} y z {mit}", " ".join([gpl, mit] * 5), "All rights reserved " * 9, "all rights rights reserved all rights"]
    texts += [" ".join(rng.choice([mit, gpl, "x", "released under mit license", "all rights", "reserved"]) for _ in range(60)) for _ in range(10)]
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    assert sum(b.template == "mit-notice" for b in got[0].blocks) == 2 and sum(b.template == "all-rights" for b in got[4].blocks) == 9
    for i, t in enumerate(texts):
        assert blocks(got[i]) == brute(t), t


def test_a_long_text_of_notices(spark):
    mit = "Released under the MIT License for word "
    text = "".join(f"{mit}{i} " for i in range(20_000))
    row = licenses.scan(table(spark, [text])).select("n_words", "blocks").first()
    assert row.n_words == 160_000 and sorted(b.first_word for b in row.blocks if b.template == "mit-notice") == [8 * i for i in range(20_000)]
