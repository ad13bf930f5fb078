"""Operators 11 to 13 against brute force, and their SQL."""

import collections
import hashlib
import math
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tierscope.llm import pivot_search, prefix_trie, queries, token_alignment

SF = "/root/testdata/sf0.001"


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", ["op12_pivot_search", "op13_prefix_trie"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    made, told = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    assert sorted(made.columns) == sorted(told.columns)
    assert in_order(made.select(told.columns).collect()) == in_order(told.fetchall())


# ---- 12 ---------------------------------------------------------------------------
@pytest.mark.parametrize(("seed", "n", "size"), [(0, 400, 1), (1, 900, 40), (2, 7, 1), (3, 300, 1e6)])
def test_pivot_search_is_exact(spark, monkeypatch, seed, n, size):
    monkeypatch.setattr(pivot_search, "CANDIDATES", 64)
    monkeypatch.setattr(pivot_search, "QUERIES", 8)
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6)) * size
    v[rng.random(n) < 0.3] = v[0]  # a large group of equal vectors, so ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(None, [1.0] * 6), (5000, None), (5050, [1.0, None]), (5100, [float("nan")] * 6), (5150, [1.0] * 3), (5200, [float("inf")]), (5250, []), (50, [2.0] * 6), (50, [2.0] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string")
    got = in_order(pivot_search.nearest(df.drop("id"), "vec_id", "embedding", F.col("id") % 50 == 0).collect())
    fit = [(i, [math.floor(256 * x) for x in r]) for i, r in rows if i is not None and r is not None and all(x is not None and math.isfinite(x) for x in r)]
    want = []
    for a, (i, q) in enumerate(fit):
        if i % 50 == 0:
            own = sorted((-sum(x * y for x, y in zip(q, c, strict=False)), j) for b, (j, c) in enumerate(fit) if a != b)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(own)]
    assert got == in_order(want)


def test_pivot_search_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, row int, norm string")
    assert pivot_search.nearest(none, "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert pivot_search.nearest(one, "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0
    zeros = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(60)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in pivot_search.nearest(zeros, "vec_id", "embedding", F.col("id") == 50, k=2).orderBy("rank").collect()] == [(50, 1, 0, 0), (50, 2, 1, 0)]


# ---- 13 ---------------------------------------------------------------------------
def trie_of(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda z: z[:2])] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        leaves, saved = 0, (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for k in children[p]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves or 1, saved

    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below(p), hashlib.sha256(",".join(map(str, sorted(c for c in m if len(made[c]) == len(p)))).encode()).hexdigest()) for p, m in list(members.items())]


@pytest.mark.parametrize(("seed", "n"), [(0, 150), (1, 400), (2, 3), (3, 60)])
def test_prefix_trie_is_exact(spark, seed, n):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "", None, "é😀"])) for c in rnd.sample(range(-300, 900), n) for t in ([None] if rnd.random() < 0.2 else []) + list(range(rnd.randrange(6)))]
    rows += [(None, 0, "user", "lost")] + [(1000 + i, t, "user", "same") for i in range(n) for t in range(7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, key int")
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(df)).select(*prefix_trie._NODE).collect()
    assert in_order(got) == in_order(trie_of(rows))


def test_prefix_trie_of_nothing_and_of_turnless(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)  # no conversation 0, so its only turn goes
    rows = prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([(c, 0, "user", "x")], "conv_id long, turn long, role string, text string"))).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in rows] == [(c, 0, 1, 1, hashlib.sha256(str(c).encode()).hexdigest())]


def test_forest_across_any_borders():
    """The same nodes whether one partition holds all conversations or each is cut off from the next."""
    import pandas as pd

    rnd = random.Random(5)
    seqs = sorted({bytes(b for t in (rnd.choice("abc") for _ in range(rnd.randrange(1, 7))) for b in t.encode() * prefix_trie.WIDTH) for _ in range(60)})
    args = [(s, [1] * (len(s) // prefix_trie.WIDTH), i % 3 + 1, i, f"e{i}") for i, s in enumerate(seqs)]
    columns = [c.split()[0] for c in prefix_trie._PARTS.split(", ")]

    def built(cuts):
        whole, at = [], 0
        edges = [0, *cuts, len(args)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                left = prefix_trie.shared_turns(seqs[a - 1], seqs[a]) if a else -1
                right = prefix_trie.shared_turns(seqs[b - 1], seqs[b]) if b < len(seqs) else -1
                whole += prefix_trie.forest(*map(list, zip(*args[a:b], strict=True)), left, right)
            at = b
        assert at == len(args)
        df = pd.DataFrame(whole, columns=columns)
        sums = df[df.open].groupby(["key", "parent_key", "depth", "width"], dropna=False).agg({"conv_id": "min", "n_convs": "sum", "n_children": "sum", "n_leaves": "sum", "saved_tokens": "sum", "ends_sha256": lambda e: max((x for x in e if isinstance(x, str)), default="")}).reset_index()
        sums["parent_key"] = [None if not isinstance(k, bytes) else k for k in sums["parent_key"]]
        sums["ends_sha256"] = [e or None for e in sums["ends_sha256"]]
        nodes = prefix_trie._merged(sums) if len(sums) else pd.DataFrame(columns=["key", *prefix_trie._NODE])
        up = dict(zip(nodes["key"], nodes["conv_id"], strict=True))
        rows = [tuple(r) for r in nodes[prefix_trie._NODE].itertuples(index=False)]
        for r in df[~df.open].itertuples(index=False):
            rows.append((r.conv_id, r.depth, up[r.parent_key] if isinstance(r.parent_key, bytes) else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256))
        return in_order([tuple(None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else x if isinstance(x, str) else int(x) for x in r) for r in rows])

    want = built([])
    assert built(range(1, len(args))) == want
    assert built([7, 8, 30]) == want


# ---- 11 ---------------------------------------------------------------------------
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    return token_alignment.Tokens(A, B)


def aligned(tokens, text):
    """Spans, groups and links of one whole text from its decoded bytes alone."""
    if not text:
        return None
    full = (" " + text).encode()
    spans = []
    for ids, decoded in ((tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.a_bytes), (tokens.b.encode(text), tokens.b_bytes)):
        at, own = 0, []
        for i in ids:
            own.append((i, at, at + len(decoded[i])))
            at += len(decoded[i])
        if b"".join(decoded[i] for i in ids) != full:
            return None
        spans.append(own)
    a, b = spans
    groups, start = [], 0
    for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
        groups.append(",".join(str(i) for i, _, e in a if start < e <= end) + "|" + ",".join(str(i) for i, _, e in b if start < e <= end))
        start = end
    return len(a), len(b), len(groups), [(i, j) for i, x, y in a for j, u, v in b if x < v and u < y], hashlib.sha256(";".join(groups).encode()).hexdigest()


def expected(tokens, texts):
    rows = [aligned(tokens, t) for t in texts]
    count = collections.Counter(p for r in rows if r for p in r[3])
    most = collections.Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(count[p] == most[p[1]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) for r in rows]


def odd_texts(n):
    bits = ["a", "the", " ", "  ", "\n", "\n\n", "\t", " \n", "é", "😀", "你好", "▁", "<s>", "</s>", "<|endoftext|>", "don't", "'ll", "1234", "foo", "Bar", "!!", "...", "\x1c", "\x85", "ﬁ", "​", "naïve", "é", "\x00", "🏳️‍🌈", "x" * 40, "\r\n", "　", "<0x0A>", "Ġ", " "]
    out = [None, "", " ", "  ", "a ", " a", "\n", "▁", "word " * 3000]
    for seed in range(n):
        rnd = random.Random(seed)
        out.append("".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 25))))
    return out


@pytest.mark.parametrize("block", [1_000_000, 500])
def test_alignment_is_exact(spark, monkeypatch, tokens, block):
    """Also where the table of pairs takes several blocks."""
    monkeypatch.setattr(token_alignment, "BLOCK", block)
    texts = odd_texts(250)
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = token_alignment.align_tokens(docs, A, B).collect()
    assert in_order(got) == in_order((None if i == 3 else i // 2, *w) for i, w in enumerate(expected(tokens, texts)))


def test_units_give_what_whole_texts_give(tokens, monkeypatch):
    texts = odd_texts(600)
    monkeypatch.setattr(token_alignment, "UNITS", 100)  # units are forgotten and learned again
    assert tokens.by_unit
    units = [r[:5] for at in range(0, len(texts), 50) for r in token_alignment.figures(tokens, texts[at : at + 50])]
    assert units == [(0, 0, 0, 0, "") if (r := aligned(tokens, t)) is None else (*r[:3], len(r[3]), r[4]) for t in texts]


def test_alignment_of_nothing(spark):
    assert token_alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    row = token_alignment.align_tokens(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "")
