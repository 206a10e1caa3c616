"""Lexical search, spelling variants and token files against brute force."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import CLASHES, SCHEMA, frame, odd_rows, words
from tapeline.llm import lexical, spelling, token_files
from tapeline.llm.decontaminate import words as terms

CLASH = [*CLASHES, "item", "terms", "tf", "score", "rank", "word", "form", "shard", "run", "bucket"]


def brute_search(rows, items, top):
    docs = [(d, Counter(terms((t or "").encode()))) for d, t, *_ in rows]
    docs = [x for x in docs if x[1]]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in docs:
            m = 75 + (25 * sum(c.values()) * n_docs) // length
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in Counter(terms((text or "").encode())).items() if t in c)
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def test_search(spark):
    rows = odd_rows()
    rng = __import__("random").Random(4)
    vocabulary = words(rng, 40).split()
    rows += [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30))), "en", "s", 0) for i in range(400)] + [(600 + i, "one two three", "en", "s", 0) for i in range(60)]
    items = [(1, "one  TWO three two"), (2, None), (3, ""), (4, " ".join(vocabulary)), (5, rows[5][1]), (5, rows[8][1]), (5, rows[8][1]), (None, "é wide"), (7, "absentword"), (8, " ".join(rng.choices(vocabulary, k=9)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(rows, items, 20)
    for params in ({}, {"block": 12, "postings": 300}):
        got = lexical.search(frame(spark, rows, CLASH).repartition(3), bench, **params)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert lexical.search(frame(spark, []), bench).count() == 0
    assert lexical.search(frame(spark, rows), bench.limit(0)).count() == 0


def test_tree_bounds():
    """The bound of every node holds for all of its documents; groups of items and the exact table of integers give the same."""
    rng = np.random.default_rng(3)
    size = rng.integers(1, 12, 900)
    place = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in size])
    tf = rng.integers(1, 9, len(place))
    tree = lexical.Tree(list(range(900)), np.concatenate(([0], np.cumsum(size))), place, tf, rng.integers(75, 300, 900), 20)
    inner = 0
    for k, (lo, hi, children) in enumerate(tree.nodes):
        inner += bool(children)
        assert [tree.nodes[c][:2] for c in children] == ([] if not children else list(zip([lo, *[tree.nodes[c][1] for c in children][:-1]], [tree.nodes[c][1] for c in children])))
        bound = dict(zip(tree.terms[k].tolist(), tree.bound[k].tolist()))
        for j in range(tree.start[lo], tree.start[hi]):
            assert tree.gain[j] <= bound[tree.place[j]]
    assert inner > 3
    table = rng.integers(0, 9000, (41, 7))
    table[40] = 0
    best = {}
    for kind in (np.int64, np.float64):
        best[kind] = [[] for _ in range(7)]
        tree.search(table.astype(kind), np.arange(40), best[kind], 20)
    assert best[np.int64] == best[np.float64] and all(len(b) == 20 for b in best[np.int64])


def brute_spelling(rows, shortest=7, least=2, times=10, misspell=31):
    n = Counter()
    for d, t, *_ in rows:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "\xc0" <= c <= "\xff":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                if misspell and h % misspell == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += 1
                run = ""
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return len(b) - len(a) == 1 and a[i:] == b[i + 1 :] or len(a) == len(b) and a != b and a[i + 1 :] == b[i + 1 :]

    by = defaultdict(list)
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            by[a].append(b)
            by[b].append(a)
    best = {w: min(by[w], key=lambda x: (-n[x], x.encode())) if by[w] else None for w in n}
    form = {w: b if b and n[b] >= times * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], len(by[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


@pytest.mark.parametrize("limit", [spelling.ROUND, 64])
def test_spelling(spark, limit):
    rng = __import__("random").Random(7)
    base = ["".join(rng.choice("abcdeéñz") for _ in range(rng.randint(6, 11))) for _ in range(30)] + ["ÀÉabcdefg", "àÉabcdefg", "abc×÷defgh"]
    rows = odd_rows() + [(None, "longrunofletters " * 3, None, None, None)]
    for i in range(300):
        picked = [rng.choice(base[: 1 + i % 33]) for _ in range(30)]
        for j in range(2):
            w = picked[j]
            at = rng.randrange(len(w))
            picked[j] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abÿ") + w[at:], w[:at] + "a" + w[at + 1 :]])
        rows.append((1000 + i, rng.choice([" ", "1", "_\U0001f600", "ā"]).join(picked).replace("z", rng.choice("zZ")), "en", "s", 0))
    chain = {"chainabc": 200, "chainabcd": 20, "chainabcde": 2, "aaaaaaaa": 30, "aaaaaaaaa": 3, "x" * 90: 20, "x" * 91: 2, "y" * 3000: 2}
    rows += [(5000, " ".join([w] * n), "en", "s", 0) for w, n in chain.items()]
    got = spelling.group_variants(frame(spark, rows, CLASH).repartition(3), limit=limit)
    want = brute_spelling(rows)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(map(tuple, got.collect())) == want
    roots = {w: r for w, *_, r in want}
    assert roots["chainabcde"] == roots["chainabcd"] == "chainabc" and sum(w != r for w, r in roots.items()) > 10


def test_spelling_empty(spark):
    assert spelling.group_variants(frame(spark, [])).count() == 0
    assert spelling.group_variants(frame(spark, [(1, "lonelyword lonelyword", None, None, None)])).first()["root"] == "lonelyword"


PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(texts, end=1):
    return [[*e.ids, end] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


PIECES = ["a", "B.", "don't", "x,", "é", "é", " ", "́", "\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "'s", "'", "ΑΣ.", "İ,", "<|endoftext|>", "<|startoftext|>", "‍", "\U0001f600", "12", "\x00", "'t)", "ﬁ", "가", "ᄀ", "ᅡ", "...", "?!", "a≮"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=14).map("".join))
def test_by_word(text):
    text = text.encode("utf-8", "ignore").decode()
    for by_word in (True, False):
        ids, sizes = token_files.token_ids(pa.array(["", text, "x"]), PATH, 1, 2, by_word)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))] == [*whole_ids(["", text, "x"]), []]


@pytest.mark.parametrize("params", [{}, {"shard": 2_000, "bucket": 5, "by_word": True}])
def test_token_files(spark, tmp_path, params):
    rows = odd_rows() + [(77, "hot " * (i % 5), "en", "s", 0) for i in range(90)]
    docs = frame(spark, rows, CLASH).repartition(3)
    folder = f"{tmp_path}/out"
    token_files.write(docs, folder, PATH, 1, **params)
    got = sorted(token_files.read(spark, folder, docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in got:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
    ids = lambda r: tuple(np.frombuffer(r["ids"], "<u4").tolist())
    want = Counter((d, tuple(x)) for (d, *_), x in zip(rows, whole_ids([r[1] or "" for r in rows])))
    assert Counter((r["doc_id"], ids(r)) for r in got) == want
    keys = spark.createDataFrame([(5,), (5,), (None,), (123456,)], "doc_id long")
    some = token_files.read(spark, folder, keys).collect()
    assert Counter((r["doc_id"], ids(r)) for r in some) == Counter({k: n for k, n in want.items() if k[0] in (5, None)})
    if params:
        assert spark.read.parquet(f"{folder}/shards").count() > 3 and token_files.locate(spark, folder, keys.select(F.lit(77).cast("long").alias("doc"))).count() > 1


def test_token_files_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    token_files.write(docs, f"file:{tmp_path}/none", PATH, 1)
    assert token_files.read(spark, f"file:{tmp_path}/none", docs).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    h, fp = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    h[:50] = 7  # equal placement hashes part by fingerprint
    hashed = token_files.PerfectHash.build(h, fp)
    assert sorted(hashed.slots(h, fp).tolist()) == list(range(5000))
    assert 64 * len(hashed.words) < 8 * 5000
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(h[[0, 0]], fp[[0, 0]])
