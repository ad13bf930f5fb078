"""The corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tierscope.llm import decontaminate, exact_dedup, language, near_dedup, packing, quality, queries, scan, sharding, simhash, substring_dedup, toxicity, url_templates
from tierscope.llm.components import components, forest
from tierscope.llm.scan import text_bytes, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, start int"
ODD = [(None, None, "x", 1), (None, "a b", "x", 2), (1, "a b", None, 3), (1, "a b", None, 3), (2, None, "y", 4), (3, "", "", 5), (4, " \n", "", 6), (5, "word " * 9000, "z", 7), (6, "Ünïcode 中文 😀 'S <|x|>", "z", 8)]


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    told, made = con.sql(queries.SQL[name]), queries.QUERIES[name](spark, SF)
    rows = lambda cols, data: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in data)
    assert rows(made.columns, [tuple(r) for r in made.collect()]) == rows(told.columns, told.fetchall())


# ---- exact dedup ------------------------------------------------------------------
def test_exact_dedup_edges(spark, odd):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    for rows in groups.values():
        assert sum(r.kept for r in rows) == 1 and all(r.group_size == len(rows) for r in rows)
    empty = groups[hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and {r.keep_id for r in empty} == {4}  # blank: most code points
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_exact_dedup_of_any_source(spark, tmp_path):
    """Rows of paths read twice, of other formats and of unions are told apart; a plain scan of Parquet files is not copied."""
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)], "doc_id long, text string").repartition(3)
    for kind in ("parquet", "json", "orc", "csv"):
        rows.write.format(kind).save(str(tmp_path / kind))
    schema, at = "doc_id long, text string", lambda kind: str(tmp_path / kind)
    once = spark.read.parquet(at("parquet"))
    assert exact_dedup._is_scan(once.filter("doc_id >= 0").select("text", "doc_id"))
    twice = {"path twice": spark.read.parquet(at("parquet"), at("parquet")), "union": once.union(once)}
    for name, docs in twice.items():
        assert not exact_dedup._is_scan(docs), name
        got = exact_dedup.exact_dedup(docs).collect()
        assert len(got) == 40 and sum(r.kept for r in got) == 7 and {r.group_size for r in got} == {4, 6}, name
        assert exact_dedup.keep_first(docs).count() == 7
    for kind in ("json", "orc", "csv"):
        got = exact_dedup.exact_dedup(spark.read.schema(schema).format(kind).load(at(kind))).collect()
        assert len(got) == 20 and sum(r.kept for r in got) == 7


def test_exact_dedup_compares_bytes_on_hits(spark):
    """With a digest of one character many texts hit the same key; whole bytes must keep them apart, over several batches."""
    rows = [(i, f"text {i % 37}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_dedup(df, digest_chars=1, files_per_trigger=2).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(i, i % 37) for i in range(120)}


def test_exact_dedup_of_any_dataframe(spark, tmp_path):
    """Joined, exploded, united and renamed tables: each row is judged once, also one that comes from the same row of a file."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 40")
    n, texts = base.count(), base.select(exact_dedup.normalized(F.col("text"))).distinct().count()
    two = spark.range(2).select(F.col("id").alias("_locator"))
    for df in (base.crossJoin(two), base.withColumn("_locator", F.explode(F.array(F.lit(0), F.lit(1)))), base.withColumn("_locator", F.lit(0)).unionAll(base.withColumn("_locator", F.lit(1)))):
        got = exact_dedup.exact_dedup(df).collect()
        assert len(got) == 2 * n and sum(r.kept for r in got) == texts
        kept = exact_dedup.keep_first(df)
        assert kept.columns == df.columns and kept.count() == texts and kept.select("_locator").distinct().count() >= 1
    spark.createDataFrame([(1, "a", "f"), (2, "a ", "g"), (3, None, "h")], "doc_id long, text string, _metadata string").write.parquet(str(tmp_path / "named"))
    assert sorted(r.doc_id for r in exact_dedup.keep_first(spark.read.parquet(str(tmp_path / "named"))).collect()) == [2, 3]


def test_exact_dedup_hot_group(spark):
    """A group of over 1,000 rows takes the broadcast and salted ways."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("text"))
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 4000 and {(r.keep_id, r.group_size) for r in got if r.doc_id % 2 == 0} == {(0, 2000)} and {r.keep_id for r in got if r.doc_id % 2} == set(range(1, 100, 2))


# ---- url templates ----------------------------------------------------------------
def test_urls(spark):
    urls = ["http://A.example.org/es/1?q", "https://x.org", "http://x.org/a", "http://b.example.org/en/12#t", "http://c.com/fr/9", "http://c.com/de/9", "ftp://d.net/x/7", "no scheme", None, "http://C.com?x", "http://notorg/a"]
    urls += [f"http://shop.net/{'spam' if i % 2 else 'news'}/{i}" for i in range(60)]
    labels = [None] * 11 + [i % 2 if i < 50 else None for i in range(60)]
    df = spark.createDataFrame([(i, u, lab) for i, (u, lab) in enumerate(zip(urls, labels, strict=True))], "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_templates.judge_urls(df, label="bad").collect()}
    assert len(got) == len(urls)
    assert [(got[i].host, got[i].path, got[i]["rule"]) for i in range(11)] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("x.org", "", None), ("x.org", "/a", "org/"), ("b.example.org", "/en/12", "example.org/en/1"), ("c.com", "/fr/9", "com/fr/"), ("c.com", "/de/9", "com/de/"),
        ("d.net", "/x/7", None), ("", "", None), ("", "", None), ("c.com", "", None), ("notorg", "/a", None),
    ]
    assert got[0].verdict == "block" and got[2].verdict == "allow"
    for i in range(60):  # the labelled branches stay apart, their numbers are one wildcard
        r = got[11 + i]
        assert r.template == f"shop.net/{'spam' if i % 2 else 'news'}/*" and r.verdict == ("block" if i % 2 else "allow")
    assert url_templates.judge_urls(df.limit(0)).count() == 0


def brute_urls(rows, rules, threshold=0.5, strength=4.0, significance=2.0):
    """Host, path, rule, template and verdict of (url, n copies are separate rows), by recursion over a tree."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parsed, judged = [], []
    for url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        parsed.append((host.translate(low), re.match(r"[^?#]*", rest[len(host) :])[0]))
        fits = [r for r in rules if (parsed[-1][0] == r[0] or parsed[-1][0].endswith("." + r[0])) and parsed[-1][1].startswith(r[1])]
        judged.append(max(fits, key=lambda r: len(r[0]) + len(r[1])) if fits else None)
    stats = defaultdict(lambda: [0, 0, 0])
    for key, rule in zip(parsed, judged, strict=True):
        stats[key][0] += 1
        stats[key][1] += rule is not None
        stats[key][2] += rule is not None and rule[2] == "block"
    template = {}

    def z(a, n, all_a, all_n):
        if not n or n == all_n or not 0 < all_a < all_n:
            return 0.0
        pooled = all_a / all_n
        return abs((a / n - (all_a - a) / (all_n - n)) / (pooled * (1 - pooled) * (1 / n + 1 / (all_n - n))) ** 0.5)

    varies = lambda s: bool(re.search("[0-9]", s)) or len(s) > 40

    def walk(name, urls, level):
        split = lambda u: [x for x in u[1].split("/") if x]
        deeper = [u for u in urls if len(split(u)) > level]
        template.update({u: name for u in urls if u not in deeper})
        if len(deeper) == 1:
            template[deeper[0]] = "/".join([name, *["*" if varies(x) else x for x in split(deeper[0])[level:]]])
            return
        branches = defaultdict(list)
        for u in deeper:
            branches[split(u)[level]].append(u)
        total = lambda us: [sum(stats[u][k] for u in us) for k in range(3)] + [sum(stats[u][0] for u in us if len(split(u)) == level + 1)]
        every, below = total(deeper), defaultdict(list)
        for x, us in branches.items():
            own = total(us)
            keep = z(own[2], own[1], every[2], every[1]) > significance or (not varies(x) and (len(branches) == 1 or z(own[3], own[0], every[3], every[0]) > significance))
            below[x if keep else "*"] += us
        for x, us in below.items():
            walk(f"{name}/{x}", us, level + 1)

    hosts = defaultdict(list)
    for u in stats:
        hosts[u[0]].append(u)
    for h, us in hosts.items():
        walk(h, us, 0)
    own, shape = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for u, t in template.items():
        for d, k in ((own, t), (shape, re.sub("^[^/]*", "", t))):
            d[k][0] += stats[u][1]
            d[k][1] += stats[u][2]
    n, bad = sum(v[0] for v in own.values()), sum(v[1] for v in own.values())
    overall = (bad + 1) / (n + 2)
    out = []
    for key, rule in zip(parsed, judged, strict=True):
        t = template[key]
        s = shape[re.sub("^[^/]*", "", t)]
        purity = (own[t][1] + strength * (s[1] + strength * overall) / (s[0] + strength)) / (own[t][0] + strength)
        out.append((*key, rule and rule[0] + rule[1], rule[2] if rule else "block" if purity > threshold else "allow", t, round(purity, 6)))
    return out


def test_urls_against_brute_force(spark):
    """The given pages; and hosts with many siblings, deep paths, ties and repeated urls."""
    rng = np.random.default_rng(3)
    pages = [r[0] for r in duckdb.sql(f"SELECT url FROM '{SF.replace('0.001', '0.01')}/pages.parquet' ORDER BY page_id").fetchall()]
    made = [None, "", "x", "http://", "http://h/", "HTTP://A.Example.ORG/es/x"]
    for i in range(300):
        host = ("a.com", "b.net", "c.example.org")[i % 3]
        made.append(f"http://{host}/{rng.choice(['de', 'fr', 'x', 'y'])}/{rng.choice(['p', 'q', 'r7'])}/{'/'.join('d' * int(rng.integers(0, 14)))}{rng.integers(0, 5) if i % 4 else ''}")
    made += [f"http://many.com/{'de' if i % 3 == 0 else 'fr' if i % 3 == 1 else f'sec{chr(97 + i % 26)}{chr(97 + i // 26)}'}/{i}" for i in range(400)]
    for rows in (pages, made):
        df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(rows)], "page_id long, url string, template string, n int")
        got = sorted(url_templates.judge_urls(df).collect(), key=lambda r: r.page_id)
        want = brute_urls(rows, url_templates.RULES)
        assert [(r.host, r.path, r["rule"], r.verdict, r.template, round(r.purity, 6)) for r in got] == want
    assert {r.template for r in got if r.host == "many.com"} >= {"many.com/de/*", "many.com/fr/*", "many.com/*/*"}


# ---- packing ----------------------------------------------------------------------
def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain, own, rng = Tokenizer.from_file(path), packing.Tokens(path), np.random.default_rng(3)
    letters = list("abcXYZ 's't'RE \n\t12É×÷ßéà-_.,!\"'<|>  中ı") + ["'ll ", "<|endoftext|>", "\xa0"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(1500)] + [None, "", " ", "İΣ", "\x00\x1f"]
    got = own.encode(pa.array(texts, pa.string()))
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text
    full = packing.Tokens(path, most=20)  # a full table looks nothing more up
    for at in range(0, len(texts), 100):
        assert [x.tolist() for x in full.encode(pa.array(texts[at : at + 100], pa.string()))] == [x.tolist() for x in got[at : at + 100]]
    assert full.size <= 20


def test_packing_round_trip(spark, odd):
    got = packing.pack_documents(odd, queries.tokenizer_path(), 64, block_size=16).collect()
    bins, whole = defaultdict(list), defaultdict(int)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id] += r.length
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert whole[2] == 1 and whole[3] == 1 and whole[5] == 9001 and whole[1] == 6
    assert packing.pack_documents(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_genetic_steps():
    import random

    rng, sizes = random.Random(1), [random.Random(2).randrange(1, 60) for _ in range(300)]
    one, other = (packing.first_packing(sizes, 64, rng, n) for n in (0.0, 0.4))
    child = packing.crossover(one, other, sizes, 64, rng)
    for p in (one, other, child):
        assert sorted(itertools.chain(*p)) == list(range(300)) and max(sum(sizes[i] for i in b) for b in p) <= 64
    best = packing.evolve([one, other], sizes, 64, rng, 10)[0]
    assert len(best) <= min(len(one), len(other))


def test_islands_beat_best_fit_decreasing(spark):
    """Pieces of a quarter to a half of a sequence: evolution saves sequences that best fit needs."""
    rng = np.random.default_rng(8)
    sizes = [int(x) for x in rng.integers(1024, 2048, 600)]
    bins: list = []
    packing.best_fit(bins, [], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 4096)
    greedy, bound = len(bins), -(-sum(sizes) // 4096)
    df = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECES)
    got = packing.pack(df, 4096).collect()
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert len(got) == 600 and max(fill.values()) <= 4096 and bound <= len(fill) < greedy


def test_pieces_against_the_tokenizer(spark, docs):
    """Every piece's start, length and checksum, from the tokenizer text by text; sequences near the bound."""
    from tokenizers import Tokenizer

    plain, want = Tokenizer.from_file(queries.tokenizer_path()), {}
    for d, t in docs.items():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[d, k // 4096] = (k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    got = queries.QUERIES["op3_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bound = -(-sum(n for _, n, _ in want.values()) // 4096)
    assert len({r.sequence_id for r in got}) <= bound * 1.02 + 1


# ---- substring dedup --------------------------------------------------------------
def brute_removed(rows, window):
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(tokens):
        for i in range(len(tokens[d]) - window + 1):
            first.setdefault(tuple(tokens[d][i : i + window]), (d, i))
    out = {}
    for d, own in tokens.items():
        gone = {k for i in range(len(own) - window + 1) if first[tuple(own[i : i + window])] != (d, i) for k in range(i, i + window)}
        out[d] = (len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone))
    return out


def test_substring_dedup_brute_force(spark):
    """Few different words, so that passages repeat within and across documents at all offsets."""
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(["a", "b", "c", "dd"], 60)) for _ in range(4)]
    rows = []
    for d in range(60):
        cut = sorted(rng.integers(0, 120, 2))
        rows.append((d, " ".join(rng.choice(["a", "b", "x"], rng.integers(0, 30))) + " " + base[d % 4][cut[0] : cut[1]] + "\t" + base[(d + 1) % 4][: cut[0]] + " end" * (d % 25)))
    for window, gram in ((8, 3), (5, 5)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), window, gram).collect()}
        assert got == brute_removed(rows, window)


def test_substring_shared_ids_and_memory(spark, monkeypatch):
    """Rows that share an id keep their own spans; what tasks remember changes nothing."""
    passage, other = " ".join(f"p{k}" for k in range(30)), " ".join(f"q{k}" for k in range(200))
    rows = [(1, passage), (2, passage), (2, other), (3, f"head of all lines {passage}"), (3, other)]
    want = {(1, 0, 30), (2, 30, 30), (2, 0, 200), (3, 30, 34), (3, 200, 200)}
    for chunk in (3 << 20, 1):  # 1: each text is a chunk
        monkeypatch.setattr(substring_dedup, "chunks", lambda batches, limit=0, chunk=chunk: scan.chunks(batches, limit=chunk))
        got = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
        assert {(r.doc_id, r.n_removed, r.n_words) for r in got} == want


def test_substring_edges(spark, odd):
    got = substring_dedup.drop_repeats(odd).collect()
    assert len(got) == len(ODD)
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_words, long.n_removed) == (9000, 8999)  # all windows but the first repeat it
    assert substring_dedup.drop_repeats(odd.limit(0)).count() == 0


def test_substring_texts_travel_packed(spark):
    """What meets the spans is the packed text, and it comes back whole, whatever its bytes and size."""
    rng = np.random.default_rng(9)
    texts = [None, "", " ", "\x00 a\u2028b \U0001f600", "w " * 60_000, *[" ".join(f"{rng.choice(['an', 'the', 'onti', 'eror'])}{rng.choice(['ing', 'er', 'sh'])}" for _ in range(300)) for _ in range(20)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text_key", "text"])
    parts = list(substring_dedup.packed_texts(iter([batch])))
    packed, sizes = ([x for p in parts for x in p.column(k).to_pylist()] for k in (2, 3))
    assert [None if t is None else len(t.encode()) for t in texts] == sizes and packed[0] is None
    assert sum(map(len, packed[5:])) < 0.6 * sum(sizes[5:])
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_removed(rows, 20)


def test_windows_are_told_apart_by_64_bits():
    """Hashes of one anchor and place that differ in one bit, high or low, are different windows."""
    h = 0x0123456789ABCDEF
    for other, later in ((h, [2]), (h ^ 1, []), (h ^ (1 << 63), [])):
        batch = substring_dedup._seeds_batch(np.array([7, 7], np.uint64), np.array([1, 2]), np.array([0, 0]), np.array([0, 0]), np.array([0, 0]), (np.array([h, other], np.uint64), np.array([0, 1, 2])))
        assert [d for part in substring_dedup._decided(substring_dedup._arrays(batch), 2, 20) for d in part.column(0).to_pylist()] == later
    hashes = np.arange(30, dtype=np.uint64)
    whole = substring_dedup.seeds(hashes, np.array([0, 30]), 20, 5)[1]
    assert whole.tolist() == scan.runs(hashes, 20).tolist()


# ---- simhash ----------------------------------------------------------------------
def fingerprint(text, n=4):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + n]).encode(), 42) for i in range(max(1, len(own) - n + 1))] if own else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_brute_force(spark, docs):
    got = {r.doc_id: r for r in simhash.simhash_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    prints = {d: fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = root[a], root[b]
            root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    for d in docs:
        assert got[d].f0 % (1 << 64) == prints[d] and got[d].component_id == root[d]


def test_links_at_every_distance(spark):
    """Pairs at 4 bits link wherever the bits lie; pairs at 5 bits don't."""
    rng, rows = np.random.default_rng(1), []
    for i in range(300):
        f = int(rng.integers(0, 1 << 63))
        bits = rng.choice(64, 4 + i % 2, replace=False)
        g = f
        for b in bits:
            g ^= 1 << int(b)
        rows += [(v - (1 << 64) if v >= 1 << 63 else v,) * 2 for v in (f, g)]
    df = spark.createDataFrame(rows, "cid long, f0 long")
    assert simhash.links(df, 1, 4).count() == 150


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    chain = [(k, k + 1) for k in range(1000, 1200)]
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (260, 2))] + chain + chain[:9] + [(b, a) for a, b in chain[:9]]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    linked = {int(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long").repartition(7)).collect()
    assert len(got) == len(linked)
    assert {r.node: r.component for r in got} == {x: find(x) for x in linked}


def test_forest_connects_what_its_edges_do():
    a, b = forest(np.array([5, 9, 7, 3, 3], np.int64), np.array([9, 7, 5, 4, 3], np.int64))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(4, 3), (7, 5), (9, 5)]
    assert not len(forest(np.zeros(0, np.int64), np.zeros(0, np.int64))[0])


def test_simhash_edges(spark, odd):
    got = simhash.simhash_groups(odd, 5, 4, 34).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_wide_fingerprints_find_edited_copies(spark):
    """Two to four changed words of 200 leave a similarity of 0.90, 0.86 and 0.81; ten leave 0.59."""
    rng, rows = np.random.default_rng(9), []
    for i in range(240):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        edited = list(own)
        for at in range(10, 10 + 18 * (2, 3, 4, 10)[i % 4], 18):
            edited[at] = "edit"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(edited))]
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 44, 24).collect()}
    found = [sum(got[2 * i + 1] == 2 * i for i in range(k, 240, 4)) for k in range(4)]
    assert found[0] >= 59 and found[1] >= 56 and found[2] >= 45 and found[3] <= 6, found
    assert all(got[2 * i] == 2 * i for i in range(240))


def test_buckets_that_hold_links():
    """The check of all buckets at once agrees with comparing all rows of each."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(3, 9, 400)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bits = rng.integers(0, 1 << 63, (int(sizes.sum()), 4)).astype(np.uint64)
    cid = rng.integers(0, 1000, len(bits))
    for k in range(0, 400, 3):  # a copy with one bit changed, or the same class twice
        a, b = starts[k], starts[k] + sizes[k] - 1
        bits[b] = bits[a] ^ np.array([1, 0, 0, 0], np.uint64)
        cid[b] = cid[a] if k % 2 else cid[a] + 1
    want = [any(cid[a] != cid[b] and np.bitwise_count(bits[a] ^ bits[b]).sum() <= 44 for a, b in itertools.combinations(range(s, s + n), 2)) for s, n in zip(starts, sizes)]
    assert simhash._holds_links(bits, cid, starts, sizes, 44).tolist() == want and 50 < sum(want) < 300
    assert simhash._holds_links(bits, cid, starts, sizes, 44, large=2).all()
    assert not len(simhash._holds_links(bits, cid, starts[:0], sizes[:0], 44))


# ---- near-dedup of the pipeline -----------------------------------------------------
def brute_groups(rows, n=5):
    sets = {}
    for d, t in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()
    root = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (x == y or 5 * len(x & y) >= 4 * len(x | y)) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return root


def edited_copies():
    """Copies with 1 to 8 of 60 to 200 words changed: similarities around 0.8, of two, of chains, and of one large group."""
    rng, rows = np.random.default_rng(11), []
    for i in range(150):
        own = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(60, 200))]
        for k in range(3 if i else 60):
            edited = list(own)
            for at in rng.integers(0, len(own), rng.integers(0, 6)):
                edited[at] = f"e{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(edited)))
    line = " ".join(f"c{x}" for x in range(40))
    rows += [(len(rows) + i, f"{line} {' '.join(f'u{i}x{k}' for k in range(i % 20))}") for i in range(100)]
    return rows + [(10_000, ""), (10_001, None), (10_002, "a b"), (10_003, "A b"), (10_004, "a c")]


def test_near_dedup_against_exact_jaccard(spark, monkeypatch):
    """Groups by pairs of 0.8 and above and no pair below it, also in points that many documents share."""
    import corpus_pipeline as pipe

    rows = edited_copies()
    want = brute_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept, alone = {r.doc_id for r in pipe.near_dedup(spark, df, SF).collect()}, {d for d, r in want.items() if d == r}
    # No document goes without a link of 0.8; of those that should, 98 of 100 at least do.
    assert kept >= alone and len(alone) < len(rows) - 100 and len(kept - alone) <= 0.02 * (len(rows) - len(alone))
    for crowd, dense in ((2, 0), (512, 10**6)):  # 2: nearly every shared point is split; 0: whole blocks are sent
        monkeypatch.setattr(near_dedup, "CROWD", crowd)
        monkeypatch.setattr(near_dedup, "DENSE", dense)
        got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, recall=0.9999).collect()}
        assert got == want


def test_near_dedup_pairs_of_able_sizes():
    """At a shared point only classes of other components and of sizes that can reach 0.8 are paired, in plain and in split points."""
    sizes, components = np.array([10, 12, 13, 100, 12], np.int32), np.array([1, 2, 3, 4, 2])
    want = {(a, b) for a, b in itertools.combinations(range(5), 2) if components[a] != components[b] and 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])}
    assert want == {(0, 1), (0, 4), (1, 2), (2, 4)}
    point, f, cid = np.full(5, 7), np.zeros(5, np.int64), np.arange(5)
    plain = [point, point * 0, point * 0 - 1, point * 0, cid, f, components, sizes]
    split = [np.tile(x, 2) for x in (point, point * 0, point * 0)] + [np.repeat([0, 1], 5)] + [np.tile(x, 2) for x in (cid, f, components, sizes)]
    for rows in (plain, split):
        found = list(near_dedup._across(np.array([0]), len(rows[0]), rows, 20, Fraction(4, 5)))
        assert {(c // near_dedup.BLOCK, c % near_dedup.BLOCK) for _, code in found for c in code.tolist()} == want


def test_near_dedup_lists_no_chance_pairs(spark):
    """Documents that share a segment's point by chance, which grow with the square of their number, hardly give links or pairs (one lane: 1529 and 909)."""
    plan, rng = near_dedup.plan_search(50_000), np.random.default_rng(5)
    rows = [(i, rng.integers(0, 256, 8 * plan.lanes, dtype=np.uint8).tobytes(), 100, None, i // near_dedup.BLOCK, i % near_dedup.BLOCK) for i in range(6000)]
    classes = spark.createDataFrame(rows, "cid long, print binary, n long, points array<long>, block long, slot int").repartition(4)
    met = near_dedup._first_meetings(classes, plan, Fraction(4, 5))
    assert met.filter("point is null").count() <= 10
    comp, none = (spark.createDataFrame([], schema) for schema in ("cid long, component long", "point long"))
    assert sum(r.n for r in near_dedup._second_meetings(classes, comp, none, plan, Fraction(4, 5)).collect()) <= 10


def test_near_dedup_meetings_of_a_pair():
    """A pair counts at one point of each segment in which it meets, and of pairs at 0.8 that meet 0.98 are near on the two lanes."""
    plan, rng, near = near_dedup.plan_search(50_000), np.random.default_rng(6), []
    for _ in range(300):
        shingles = rng.integers(0, 1 << 63, 250, dtype=np.uint64)
        prints = [near_dedup.fingerprint(s, plan.lanes).tobytes() for s in (shingles[:200], shingles)]
        batch = pa.RecordBatch.from_arrays([pa.array(prints), pa.array([200, 250]), pa.nulls(2, pa.list_(pa.int64()))], ["print", "n", "points"])
        own, point, turned, lane = near_dedup._spread(batch, plan, Fraction(4, 5))
        (one, i), (other, j) = ((point[own == k], turned[own == k]) for k in (0, 1))
        common, a, b = np.intersect1d(one, other, assume_unique=True, return_indices=True)
        kept = common[near_dedup._least_meeting(common, i[a], j[b])]
        assert sorted(kept >> plan.bits) == sorted(set((common >> plan.bits).tolist()))
        if len(common):
            near.append(near_dedup._near(lane, np.array([0]), np.array([1]), plan.lane_most)[0])
    assert len(near) >= 0.95 * 300 and np.mean(near) >= 0.98


def test_near_dedup_batches_are_bounded(spark):
    """Blocks of shingle sets are rows of a megabyte: an Arrow batch holds a few of them, and the session's own settings come back."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    told = [spark.conf.get(k, None) for k in keys]
    seen, own = [], near_dedup._groups

    def spied(docs, *rest):
        rows = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) AS x")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        seen.extend(r.n for r in rows.mapInArrow(sizes, "n long").collect())
        return own(docs, *rest)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(near_dedup, "_groups", spied)
        near_dedup.near_groups(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert sum(seen) == 40 and max(seen) <= 6
    assert [spark.conf.get(k, None) for k in keys] == told


def small_sets():
    """Texts of 1 to 24 shingles with the shortest similar ones, at 0.8 and just below it, and crowds that share most of a common line."""
    rng, rows = np.random.default_rng(4), []
    text = lambda words: rows.append((len(rows), " ".join(words)))
    for n in range(1, 20):
        for most in (n * 5 // 4, n * 5 // 4 + 1):
            for _ in range(4):
                words = [f"w{x}" for x in rng.integers(0, 10**9, most + 4)]
                text(words[: n + 4])
                text(words)
    line = [f"c{x}" for x in range(18)]
    for i in range(60):
        text([*line[: 8 + i % 11], *[f"u{i}x{k}" for k in range(i % 7)]])
    return rows


@pytest.mark.parametrize("size", [10**4, 10**9])
def test_near_dedup_of_small_sets_is_exact(spark, monkeypatch, size):
    """Whatever the plan of the search, which follows the number of documents."""
    own = near_dedup.plan_search
    monkeypatch.setattr(near_dedup, "plan_search", lambda n, *rest: own(size, *rest))
    rows = small_sets()
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups(rows)


def test_near_dedup_recall_by_size():
    """Of pairs at 0.8 whose smaller set has 20 shingles or more, 0.95 meet in a segment within the limits, for plans of all sizes."""
    rng = np.random.default_rng(3)
    for docs in (10**4, 10**7, 10**9):
        plan = near_dedup.plan_search(docs)
        met = {}
        for n in range(20, 41, 4):
            both = [rng.integers(0, 1 << 63, n * 5 // 4, dtype=np.uint64) for _ in range(100)]
            a = np.stack([near_dedup.fingerprint(s[:n], plan.lanes) for s in both])
            b = np.stack([near_dedup.fingerprint(s, plan.lanes) for s in both])
            near = (np.bitwise_count(a ^ b).sum(axis=1) <= plan.most) & (np.bitwise_count(a[:, -1] ^ b[:, -1]) <= plan.lane_most)
            shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(near_dedup._points(a, plan), near_dedup._points(b, plan), strict=True)]
            met[n] = (near & np.array(shared)).mean()
        assert np.mean(list(met.values())) >= 0.95 and min(met.values()) >= 0.9, (docs, met)


def test_near_dedup_edges(spark, odd, docs):
    got = near_dedup.near_groups(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert near_dedup.near_groups(odd.limit(0)).count() == 0
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == brute_groups(list(docs.items()))


# ---- decontamination --------------------------------------------------------------
def test_decontaminate_blocks_and_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = ["aa", "bb", "Cc", "d1"]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([3, 1, 7, 6, 5, 0, 6])] + [(7, None), (None, "zz zz")]
    rows = [(d, "-".join(rng.choice(vocab, rng.integers(0, 60)))) for d in range(80)] + [(80, None), (81, "zz, ZZ!"), (81, "zz, ZZ!")]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        own = split(t)
        for k in range(max(1, len(own) - 3) if own else 0):
            windows[tuple(own[k : k + 4])].add("" if i is None else str(i))
    want = []
    for d, t in rows:
        own, hit, found = split(t), set(), set()
        for w, ids in windows.items():
            for k in range(len(own) - len(w) + 1):
                if tuple(own[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found |= ids
        want.append((d, len(own), len(hit), tuple(sorted(found))))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (10**6, 900):  # 900: several blocks
        got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.find_benchmark(df, bench, 4, bound).collect()]
        assert sorted(got) == sorted(want)
    assert decontaminate.find_benchmark(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_benchmark(df.limit(0), bench).count() == 0


# ---- sharding ---------------------------------------------------------------------
def test_hilbert_curve_is_continuous(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = list(itertools.product(range(1 << bits), repeat=n))
        df = spark.createDataFrame(cells, ", ".join(f"x{i} int" for i in range(n)))
        rows = df.withColumn("h", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(p[:n], q[:n], strict=True)) == 1 for p, q in itertools.pairwise(rows))


def test_shards(spark, odd):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.hilbert_shards(df).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == df.count() and sizes.max() - sizes.min() <= 1 and set(got.shard) == set(range(40))
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert sharding.hilbert_shards(odd).count() == len(ODD) and sharding.hilbert_shards(odd.limit(0)).count() == 0


def test_shards_against_a_plain_sort(spark):
    """Sizes and checksums text by text, shards as runs of the sorted curve, and fewer values of each dimension in a shard."""
    path = f"{SF.replace('0.001', '0.01')}/documents.parquet"
    rows = {r[0]: r for r in duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{path}'").fetchall()}
    got = sharding.hilbert_shards(spark.read.parquet(path)).collect()
    for r in got:
        own = (rows[r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(own) + 16, zlib.crc32(own), "rows", None)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    n = len(got)
    assert [r.shard for r in order] == [k * 40 // n for k in range(n)]
    shards = defaultdict(set), defaultdict(set)
    for r in got:
        shards[0][r.shard].add(rows[r.doc_id][2])
        shards[1][r.shard].add(rows[r.doc_id][3])
    assert np.mean([len(v) for v in shards[0].values()]) < 2 and np.mean([len(v) for v in shards[1].values()]) < 9


def test_hilbert_cells(spark):
    """Whole strings count, null is lowest, and few values span the grid."""
    rows = [(f"https://a-very-long-common-beginning/{k}", k) for k in range(4) for _ in range(10)] + [(None, 9)] * 10
    df = sharding.hilbert_order(spark.createDataFrame(rows, "s string, k int"), ["s"], 5)
    got = {r.k: r.curve for r in df.collect()}
    assert [got[k] for k in (9, 0, 1, 2, 3)] == [3, 9, 16, 22, 28]


def test_write_shards(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(df, sharding.hilbert_shards(df, n_shards=4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").exceptAll(df.select("doc_id", "text")).count() == 0


# ---- scores -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def labels():
    return duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF.replace('0.001', '0.01')}/labels.parquet'").df()


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_held_out(spark, labels):
    got = queries.QUERIES["op6_quality"](spark, SF.replace("0.001", "0.01")).toPandas().merge(labels, on="doc_id")
    own = got[got.held_out]
    assert all(h == held(i) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert (own.predicted == own.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_toxicity_held_out(spark, labels):
    got = queries.QUERIES["op8_toxicity"](spark, SF.replace("0.001", "0.01")).toPandas().merge(labels, on="doc_id")
    own = got[got.held_out]
    assert all(h == held(i) for i, h in zip(got.doc_id, got.held_out, strict=True)) and got.score.between(0, 1).all()
    assert (own.predicted == own.toxic).mean() > 0.93 and (own[own.toxic == 0].predicted == 0).mean() > 0.98


def test_toxicity_recall_on_more_rows(spark):
    """Held-out recall and precision over the larger table: rows that no label was learned from."""
    path = SF.replace("0.001", "0.1")
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{path}/labels.parquet' WHERE toxic IS NOT NULL").df()
    got = queries.QUERIES["op8_toxicity"](spark, path).toPandas().merge(labels, on="doc_id")
    own = got[got.held_out]
    both = ((own.predicted == 1) & (own.toxic == 1)).sum()
    assert (own.toxic == 1).sum() > 80 and both / (own.toxic == 1).sum() > 0.85 and both / (own.predicted == 1).sum() > 0.95


def test_language_held_out(spark):
    path = SF.replace("0.001", "0.01")
    lang = duckdb.sql(f"SELECT doc_id, lang FROM '{path}/documents.parquet'").df()
    got = queries.QUERIES["op7_language"](spark, path).toPandas().merge(lang, on="doc_id")
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97


def test_every_language_is_learned(spark):
    """More languages than the sample's parameter would give a tenth of its rows each."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(340):
        words_of = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(6)]
        rows += [(len(rows) + j, " ".join(rng.choice(words_of, 30)), f"l{k:03}", j) for j in range(6)]
    got = language.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string, u int").repartition(4)).collect()
    want = {r[0]: r[2] for r in rows}
    held_rows = [r for r in got if r.held_out]
    assert len({r.lang_pred for r in got}) > 330 and np.mean([r.lang_pred == want[r.doc_id] for r in held_rows]) > 0.95


def test_long_texts_in_slices(monkeypatch):
    """Slices of a long text give the terms and n-grams of the whole."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc DÉ\n9.é"), 5000)), "short Éa", "", "x" * 700]
    raw, offsets = text_bytes(pa.array(texts))
    one = quality.terms(raw, offsets), language.presence(raw, offsets), scan.hashed_words(raw, offsets)
    for module in (quality, language):
        monkeypatch.setattr(module, "SLICE", 97)
    other = quality.terms(raw, offsets), language.presence(raw, offsets), scan.hashed_words(raw, offsets, 101)
    assert np.allclose(one[0], other[0]) and np.array_equal(one[1], other[1])
    assert all(np.array_equal(a, b) for a, b in zip(one[2], other[2], strict=True))


def test_score_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (5, 1, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (none, some):
        for f in (quality.quality_scores, toxicity.toxicity_scores):
            got = f(odd, lab).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
            assert f(odd.limit(0), lab).count() == 0
    got = language.identify_language(odd.withColumn("lang", F.when(F.col("doc_id") == 5, "en").when(F.col("doc_id") == 6, "xx"))).collect()
    assert len(got) == len(ODD) and all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 4))
    assert language.identify_language(odd.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred != 'und'").count() == 0


def test_label_model_beats_single_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.2
    fire = lambda p, q: np.where(truth, rng.random(3000) < p, rng.random(3000) < q)
    voters = np.stack([fire(0.6, 0.02), fire(0.5, 0.02), fire(0.5, 0.3)] * 1, axis=1)
    voters = np.hstack([voters, voters[:, 2:3], voters[:, 2:3]])  # a weak voter three times over
    given = np.where(rng.random(3000) < 0.05, ~truth, truth).astype(float)
    posterior = toxicity.label_model(voters.astype(float), np.ones(5, bool), given, 0.2)
    assert ((posterior > 0.5) == truth).mean() > max((given == truth).mean() - 0.01, 0.9)


# ---- scan and pipeline ------------------------------------------------------------
def test_word_bounds():
    texts = ["a bb\tccc", "", None, "  ", "é 中", "x"]
    raw, offsets = text_bytes(pa.array(["skip", *texts], pa.string()).slice(1))
    starts, ends, bounds = words(raw, offsets)
    own = [[raw[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in itertools.pairwise(bounds)]
    assert own == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


CLASHES = ["row", "_row", "_digest", "_n", "_print", "cid", "_locator", "label", "start", "items", "shingles", "block", "copy"]


def test_pipeline_stages_keep_rows_and_columns(spark, odd, tmp_path):
    """Clashing extra columns, shared and missing ids, nulls, repeats and empty tables through every stage."""
    import corpus_pipeline as pipe

    rows = odd.withColumn("lang", F.lit("en"))
    for k, c in enumerate(CLASHES):
        rows = rows.withColumn(c, F.lit(f"{c}{k}") if k % 2 else F.lit(k))
    rows.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0, name
        kept = out.collect()
        assert 4 <= len(kept) <= len(ODD) and all(r["cid"] == "cid5" for r in kept), name
    packed = pipe.packing(spark, docs, SF)
    assert packed.agg(F.sum("length")).first()[0] > 9000 and pipe.packing(spark, docs.limit(0), SF).count() == 0
    # A row that shares its id with a near copy, and rows without id, are judged by their own text.
    text = " ".join(f"w{k}" for k in range(100))
    shared = spark.createDataFrame([(1, text), (5, text + " end"), (5, "quite another text of its own"), (None, "a b c"), (None, text + " fin")], "doc_id long, text string")
    assert sorted(r.text[:5] for r in pipe.near_dedup(spark, shared, SF).collect()) == ["a b c", "quite", "w0 w1"]
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' WHERE length(text) > 80 LIMIT 1").fetchall()[0][0]
    leaks = spark.createDataFrame([(5, f"so {item} it goes"), (5, "quite another text"), (None, item), (None, "clean")], "doc_id long, text string")
    assert sorted(r.text for r in pipe.decontaminate(spark, leaks, SF).collect()) == ["clean", "quite another text"]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on all that its predecessor kept: which rows stay, and the packed pieces."""
    import corpus_pipeline as pipe

    words10 = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        own = words10(t)
        windows |= {tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else set()

    def exact(rows):
        best = {}
        for d, t in rows.items():
            key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
            best[key] = min(best.get(key, (1, 0)), (-len(t or ""), d))
        return {d for _, d in best.values()}

    def near(rows):
        return {d for d, r in brute_groups(list(rows.items())).items() if d == r}

    def clean(rows):
        out = set()
        for d, t in rows.items():
            own = words10(t)
            if not any(tuple(own[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(own) - n + 1)):
                out.add(d)
        return out

    said = {r.doc_id for r in toxicity.toxicity_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (name, stage), brute in zip(pipe.STAGES, (lambda rows: said, exact, near, clean, None), strict=True):
        rows = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if brute:
            assert {r.doc_id for r in docs.collect()} == brute(rows), name
    assert {r.doc_id for r in docs.collect()} == set(rows)
    ran = pipe.run(spark, SF)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert ran.select(cols).exceptAll(docs.select(cols)).count() == 0 and ran.count() == docs.count()
