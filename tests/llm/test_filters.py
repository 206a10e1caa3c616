"""Quality rules, line dedup, licences, near-duplicates, substrings against brute force on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import CLASHES, SCHEMA, frame, odd_rows, plain, words
from tapeline.llm import graph, licenses, line_dedup, quality_rules, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rules(spark):
    docs = frame(spark, odd_rows(), CLASHES)
    got = Counter((r["row"]["doc_id"], r["row"]["text"], *[r[m] for m in quality_rules.MEASURES]) for r in quality_rules.ledger(docs).collect())

    def brute(t):
        w = WORD.findall(t or "")
        tri = list(zip(w, w[1:], w[2:]))
        n = Counter(tri)
        hit = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines), len(lines) - len(set(lines)), len(hit)

    assert got == Counter((d, t, *brute(t)) for d, t, *_ in odd_rows())
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    entries = quality_rules.ledger(docs)
    table = {r["rule"]: r for r in quality_rules.ablations(entries).collect()}
    masks = [r["failed"] for r in entries.collect()]
    for i, rule in enumerate(quality_rules.RULES):
        assert table[rule]["n_failed"] == sum(m >> i & 1 for m in masks)
        assert table[rule]["n_only"] == masks.count(1 << i)
        assert table[rule]["n_kept_without"] == sum(m & ~(1 << i) == 0 for m in masks)
    assert quality_rules.ledger(frame(spark, [])).count() == 0


def brute_lines(rows):
    """Expected (text, n_lines, n_removed) of each distinct (id, text)."""
    docs = sorted({(d, t) for d, t, *_ in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    first, gone = {}, defaultdict(set)
    spots = defaultdict(list)
    for d, t in docs:
        full = [(i, line.strip(" \t\n\x0b\x0c\r")) for i, line in enumerate((t or "").split("\n"))]
        full = [x for x in full if x[1]]
        for a, b, c in zip(full, full[1:], full[2:]):
            spots[a[1], b[1], c[1]].append(((d, t), a[0], c[0]))
    return docs, spots


def test_lines(spark):
    rows = [r for r in odd_rows() if r[0] != 18]  # ids that occur twice are ordered by text hash
    docs = frame(spark, rows, CLASHES)
    _, spots = brute_lines(rows)
    gone = defaultdict(set)
    for where in spots.values():
        for key, a, c in sorted(where, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))[1:]:
            gone[key] |= set(range(a, c + 1))
    want = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        left = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone[d, t])
        want[d, left, 0 if t is None else len(lines), len(gone[d, t])] += 1
    got = line_dedup.dedup_lines(docs)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == want
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.filter("n_chars <> length(text)").count() == 0
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    wrapped = mit.replace(" copy of", "\ncopy of").replace(" portions", "\nportions")
    swapped = "\n\n".join(reversed(mit.split("\n\n")))
    rows = [(1, mit, None, None, 0), (2, wrapped, None, None, 0), (3, swapped, None, None, 0), (4, "text\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", None, None, 0), (5, "# SPDX-License-Identifier: GPL-2.0-only\nint x;", None, None, 0)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(spark, rows, CLASHES)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "", 4: "CC-BY-NC-4.0,MIT", 5: "GPL-2.0"}
    odd = licenses.scan(frame(spark, odd_rows(), CLASHES))
    assert odd.filter("n_sentences = 0 and licenses = '' and sentence_ids = ''").count() == len(odd_rows())
    assert licenses.scan(frame(spark, [])).count() == 0


#: official notices, one line for each paragraph
NOTICES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
}


def test_official_notices(spark):
    """Each notice, whole and wrapped, and each rule's SPDX line above a wrapped notice of another licence."""
    import textwrap

    wrap = lambda t: "\n\n".join(textwrap.fill(p, 60) for p in t.split("\n\n"))
    star = lambda t: "/*\n" + "\n".join(" * " + line for line in wrap(t).split("\n\n")[0].split("\n"))
    cases = [(name, form(text)) for name, text in NOTICES.items() for form in (str, wrap)] + [("MPL-2.0", star(NOTICES["MPL-2.0"]))]
    cases += [(",".join(sorted({name, "MIT"})), f"SPDX-License-Identifier: MIT\nint x;\n\n{wrap(text)}") for name, text in NOTICES.items()]
    cases += [("Apache-2.0,GPL-2.0", "# SPDX-License-Identifier: Apache-2.0\nint x;\n\n" + NOTICES["GPL-2.0"].replace(" Public", "\nPublic"))]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(spark, [(i, t, None, None, 0) for i, (_, t) in enumerate(cases)])).collect()}
    assert [(got[i], t) for i, (_, t) in enumerate(cases)] == cases


def brute_fingerprint(t):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    rows = odd_rows()
    base = rows[13][1].split(" ")
    rows += [(100 + i, " ".join([*base[: 50 * i], "new", *base[50 * i :]]), "en", "s1", 0) for i in range(6)]
    fps = {(d, t): brute_fingerprint(t) for d, t, *_ in rows}
    near = [(a, b) for a, b in combinations(sorted(set(fps.values())), 2) if (a ^ b).bit_count() <= 3]
    root = classes(set(fps.values()), near)
    low = {}
    for (d, _), f in fps.items():
        if d is not None:
            low[root[f]] = min(d, low.get(root[f], d))
    want = Counter((d, f"{fps[d, t]:016x}", low.get(root[fps[d, t]])) for d, t, *_ in rows)
    got = simhash.near_duplicates(frame(spark, rows, CLASHES)).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id")
    assert Counter(tuple(r) for r in got.collect()) == want
    docs = frame(spark, rows, CLASHES)
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(ids) == sorted({c for _, _, c in want if c is not None})
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_one_of_each_component(spark):
    """Different texts without an id keep one row each; an id that is not the smallest of its other component stands for its own one only."""
    import random

    rng = random.Random(11)
    a, b, c, d, e = (words(rng, 90) for _ in range(5))
    rows = [(None, a, "en", "s", 0), (None, b, "en", "s", 0), (None, b, "en", "s", 0), (5, c, "en", "s", 0), (5, d, "en", "s", 0), (3, d, "en", "s", 0), (None, d, "en", "s", 0), (7, e, "en", "s", 0), (None, None, "en", "s", 0)]
    assert len({brute_fingerprint(t) for t in (a, b, c, d, e)}) == 5
    want = Counter([(None, a), (None, b), (5, c), (3, d), (7, e), (None, None)])
    assert Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, rows, CLASHES)).collect()) == want


@pytest.mark.parametrize("block", [4096, 8])
def test_links(spark, block):
    """A dense cluster, chains and noise; a small block forces the finer lists and the neighbour table."""
    rng = np.random.default_rng(3)
    flip = lambda f, n: f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = {int(x) for x in rng.integers(0, 1 << 63, 400)} | {0, (1 << 64) - 1}
    centre = int(rng.integers(0, 1 << 63))
    fps |= {flip(centre, int(rng.integers(1, 4))) for _ in range(300)} | {centre ^ m for m in range(40)}
    chain = int(rng.integers(0, 1 << 63))
    for _ in range(30):
        chain = flip(chain, 3)
        fps.add(chain)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = [(signed(a), signed(b)) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 3]
    df = spark.createDataFrame([(signed(f),) for f in sorted(fps)], "fp long")
    links = simhash.links(df, block)
    pairs = {tuple(r) for r in links.collect()}
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in pairs)
    nodes = {signed(f) for f in fps}
    assert classes(nodes, pairs) == classes(nodes, near)
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert {n: got.get(n, n) for n in nodes} == classes(nodes, near)


def brute_substrings(rows, length=35):
    every = [WORD.findall(t or "") for _, t, *_ in rows]
    n = Counter(tuple(w[i : i + length]) for w in every for i in range(len(w) - length + 1))
    out = []
    for (d, *_), w in zip(rows, every):
        gone = {i + k for i in range(len(w) - length + 1) if n[tuple(w[i : i + length])] > 1 for k in range(length)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_same_hash(spark):
    """Two texts with one null id whose 32-bit hashes agree: the shorter must not get the ranges of the longer."""
    tail = " ".join(f"w{i}" for i in range(60))
    short = spark.range(150_000).select(F.concat(F.lit("short "), F.col("id")).alias("a")).withColumn("h", F.hash("a"))
    long = spark.range(150_000).select(F.concat(F.col("id"), F.lit(" " + tail)).alias("b")).withColumn("h", F.hash("b"))
    pair = short.join(long, "h").first()
    rows = [(None, pair["a"], None, None, None), (None, pair["b"], None, None, None), (3, f"other {tail}", None, None, None)]
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.remove_repeats(frame(spark, rows)).select("rest.doc_id", "n_words", "n_removed").collect()}
    assert got == {(None, 2): 0, (None, 61): 60, (3, 61): 60}


def test_substrings(spark):
    import random

    rng = random.Random(5)
    rows = odd_rows()
    parts = [words(rng, n) for n in (35, 36, 50, 34, 200)]
    rows += [(200 + i, " ".join(rng.choice(parts) + " " + words(rng, rng.randint(0, 9)) for _ in range(5)), "en", "s", 0) for i in range(12)]
    rows += [(300, "z " * 40, "en", "s", 0), (301, "y " * 35, "en", "s", 0), (302, "a b c " * 30, None, None, 0)]
    for extra in ([], CLASHES):
        got = substrings.remove_repeats(frame(spark, rows, extra)).select("rest.doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        assert plain(got) == brute_substrings(rows)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_segments_cover_windows():
    """Each window lies in one segment, and a segment's content decides its windows, piece borders included."""
    import random

    text = words(random.Random(2), 700).encode()
    whole = substrings.segments_of(text)
    old, substrings._PIECE = substrings._PIECE, 128
    try:
        cut = substrings.segments_of(text)
    finally:
        substrings._PIECE = old
    for _, _, first, n in (whole, cut):
        assert sorted(i for f, k in zip(first, n) for i in range(f, f + k)) == list(range(700 - 34))
    assert SCHEMA.names[0] == "doc_id"
