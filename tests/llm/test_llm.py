"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferrule.llm import bitplane, byte_bpe, components, fingerprint, language_id, near_dedup, packing, quality, queries, sharding, textbuf, tokens, topk, url_filter

SF = "/root/testdata/sf0.001"
WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, host string, n_chars long"
ODD = ["", " ", "\n\n", "a", "A b", "it's 's", "x\x00y", "é́", "日本 語", "😀 ok", "a" * 5000, "word " * 4000, "THE!! END.", "1 2 33", "\t tab\r\nline\x0b\x0c", "ΑΣ Σ", "don't won't", "<|endoftext|> x", "  lead", "trail  "]


def odd_documents(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s", None][i % 2], "h", 1) for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None, None), (None, "no id", "en", "s", "h", None), (None, None, None, None, None, None), (5, "same id other text", "en", "s", "h", 1), (3, "a", None, None, "h", 1), (3, "a", None, None, "h", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    places = [names.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[p] for p in places) for r in found.fetchall()), key=repr)


# 1 -------------------------------------------------------------------------------------------------------------


def test_quality_finds_bad_documents(spark):
    got = {r.doc_id: r for r in queries.op1_site_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    right = sum(got[r.doc_id].keep == (r.quality == 1) for r in labels)
    assert right / len(labels) > 0.98
    assert all(got[r.doc_id].keep for r in labels if r.quality == 1)


def test_quality_of_documents_it_was_not_fitted_on(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.keep for r in quality.classify(docs, model, F.col("source"), F.col("lang")).collect()}
    held = [r for r in labels.collect() if r.doc_id % 2]
    assert sum(got[r.doc_id] == (r.quality == 1) for r in held) / len(held) > 0.97


def brute_sites(rows, base):
    """Rates of host and path for every row without itself, and the posterior; rows are (host, path, evidence)."""
    lift = np.log(base / (1 - base))
    good = [1 / (1 + np.exp(-(e + lift))) for _, _, e in rows]
    paths, hosts = {}, {}
    for (h, p, _), g in zip(rows, good):
        for table, key in ((paths, (h, p)), (hosts, h)):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + 1, s + g)
    n, s = len(rows), sum(good)
    total = (s + base) / (n + 1)

    def strength(groups):  # (n, rate, centre)
        size = sum(g[0] for g in groups)
        m = sum(g[0] * g[1] for g in groups) / size
        spread = sum(g[0] * (g[1] - g[2]) ** 2 for g in groups)
        between = (spread - (len(groups) - 1) * m * (1 - m)) / max(size - sum(g[0] ** 2 for g in groups) / size, 1e-9)
        return min(m * (1 - m) / between, quality.MAX_STRENGTH) if len(groups) > 1 and between > 1e-9 else quality.MAX_STRENGTH

    a = strength([(k, t / k, total) for k, t in hosts.values()])
    b = strength([(k, t / k, hosts[h][1] / hosts[h][0]) for (h, _), (k, t) in paths.items()])
    out = []
    for (h, p, e), g in zip(rows, good):
        rate = (s - g + base) / n
        host = (hosts[h][1] - g + a * rate) / (hosts[h][0] - 1 + a)
        path = (paths[h, p][1] - g + b * host) / (paths[h, p][0] - 1 + b)
        out.append((host, path, 1 / (1 + np.exp(-(e + np.log(path / (1 - path)))))))
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_site_posteriors_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_SITES", broadcast)
    rng = np.random.default_rng(1)
    rows = [("big", f"big/{k}", float(e)) for k, m in (("a", 2), ("b", -2)) for e in rng.normal(m, 1, 120)]
    rows += [(f"h{i % 9}", f"h{i % 9}/{i % 4}", float(e)) for i, e in enumerate(rng.normal(0.5, 2, 150))] + [("tiny", "tiny/x", -3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, evidence double")
    got = sorted(quality.posterior(df, quality.site_posteriors(df, 0.6)).collect())
    for r, (host, path, post) in zip(got, brute_sites(rows, 0.6), strict=True):
        assert abs(r.host_rate - host) < 1e-8 and abs(r.path_rate - path) < 1e-8 and abs(r.quality - post) < 1e-5 and r.keep == (r.quality >= 0.5)


def test_sites_shrink_and_leave_the_document_out(spark):
    rows = [("big", "big/a", 3.0)] * 200 + [("big", "big/b", -3.0)] * 200 + [("tiny", "tiny/x", -3.0), ("lone", "lone/x", 3.0)]
    df = spark.createDataFrame(rows, "host string, path string, evidence double")
    got = {r.path: r for r in quality.posterior(df, quality.site_posteriors(df, 0.5)).collect()}
    assert got["big/a"].path_rate > 0.8 > got["big/b"].path_rate and got["big/a"].n_host == 400
    # a lone document says nothing of its own site, whatever it holds
    assert abs(got["tiny/x"].path_rate - got["lone/x"].path_rate) < 0.01


def test_quality_learns_once_from_repeated_ids(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    once, twice = quality.train(documents, labels), quality.train(documents.union(documents), labels.union(labels))
    assert once.base == twice.base and np.allclose(once.weights, twice.weights)


def test_quality_edges(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    blank = quality.train(docs, none)
    rows = quality.classify(docs, blank, F.col("source"), F.col("lang")).collect()
    assert len(rows) == docs.count() and all(r.keep for r in rows)
    kept = quality.good_documents(docs, blank, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.classify(docs.limit(0), blank, F.col("source"), F.col("lang")).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------


def brute_shards(rows, shards, seed):
    by = {}
    for doc_id, source, text in rows:
        raw = text.encode()
        h = int(hashlib.md5(f"{seed}|{doc_id}|{source}|{len(raw) + 1}|{zlib.crc32(raw)}".encode()).hexdigest()[:15], 16)
        by.setdefault(source, []).append((h, doc_id))
    order = []
    for source, own in by.items():
        for rank, (h, doc_id) in enumerate(sorted(own), 1):
            order.append(((2 * rank - 1) / (2 * len(own)), source, h, doc_id))
    n, out = len(order), {}
    cuts = [k * n // shards for k in range(shards + 1)]
    for place, (*_, doc_id) in enumerate(sorted(order)):
        k = max(i for i in range(shards) if cuts[i] <= place)
        out[doc_id] = (k, place - cuts[k])
    return out


def test_shards_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 17)
    monkeypatch.setattr(sharding, "RUN_BUCKETS", 3)
    want = brute_shards([(r.doc_id, r.source, r.text) for r in documents.collect()], 8, queries.SHARD_SEED)
    rows = queries.op2_stratified_shards(spark, SF).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == want
    texts = dict(texts_of(documents))
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


@pytest.mark.parametrize("bucket", [7, 4000])
def test_shards_edges(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    rows = [(7, "a")] * 50 + [(None, None)] * 5 + [(i, "b") for i in range(9)]
    got = sharding.interleave(spark.createDataFrame(rows, "id long, source string"), ["id"], "source", 4).collect()
    sizes = [sum(r.shard == k for r in got) for k in range(4)]
    assert len(got) == 64 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k])) for k in range(4))
    # every shard has the mixture
    assert all(11 <= sum(r.id == 7 for r in got if r.shard == k) <= 14 for k in range(4))
    assert sharding.interleave(spark.createDataFrame([], "id long, source string, shard int"), ["id"], "source", 4).count() == 0
    sharding.write_shards(spark.createDataFrame(got), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 64


def test_rows_without_ids_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 500)
    seen = []
    plain = sharding._summed_before
    monkeypatch.setattr(sharding, "_summed_before", lambda counts, *a: seen.append(counts) or plain(counts, *a))
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    got = sharding.interleave(rows, ["id"], "source", 4)
    assert {r.shard: r.n for r in got.groupBy("shard").agg(F.count_distinct("slot").alias("n")).collect()} == dict.fromkeys(range(4), 12_500)
    assert max(r["_n"] for r in seen[0].collect()) < 1_000


# 3 -------------------------------------------------------------------------------------------------------------


def brute_duplicates(rows, width, percent=80):
    sets = []
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((doc_id, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    best = {d: d for d, _ in sets}

    def find(x):
        while best[x] != x:
            x = best[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                best[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_copies_against_brute_force(spark, documents, width):
    rows = texts_of(documents)
    random.seed(5)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(120)]
    for k in range(150):  # a group of near copies around the threshold
        own = list(base)
        for _ in range(random.randint(0, 5)):
            own[random.randrange(len(own))] = f"z{random.randint(0, 10**6)}"
        rows.append((10_000 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_duplicates(rows, width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width).collect()}
    assert got == want


@pytest.mark.parametrize("few", [0, 100])
def test_large_candidates_are_cut_into_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "FEW", few)
    random.seed(6)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(80)]
    rows = []
    for k in range(120):
        own = list(base)
        for _ in range(random.randint(0, 4)):
            own[random.randrange(len(own))] = f"z{random.randint(0, 10**6)}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_duplicates(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 4).collect()} == want


def template_pages(n, words=100, own=14, seed=1):
    """Pages of one template, each with ``own`` words at its end that no other has: similarity below 0.79 by single words."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    return [(i, " ".join([*base, *(f"z{i}x{k}" for k in range(own + i % 3))])) for i in range(n)]


def test_unlinked_pages_of_one_template_cost_in_proportion(spark, monkeypatch):
    tiled = []
    plain = near_dedup.stored

    def spied(df, name):
        out = plain(df, name)
        if name == "tiles":
            tiled.append(out.count())
        elif name == "links":
            tiled.append(0)
        return out

    monkeypatch.setattr(near_dedup, "stored", spied)
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    sizes = []
    for n in (160, 640):
        tiled.clear()
        got = near_dedup.near_duplicates(spark.createDataFrame(template_pages(n), "doc_id long, text string"), 1)
        assert got.where("kept").count() == n
        sizes.append(2 * n + sum(tiled))
    assert sizes[1] <= 5 * sizes[0], sizes


def test_links_between_parts_are_found_by_prefixes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "FEW", 0)
    rng = random.Random(4)
    rows = template_pages(160)
    for i in range(60):  # pages near one of the first, at all sides of the threshold
        _, text = rows[rng.randrange(100)]
        words = text.split()
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"y{i}{rng.randint(0, 999)}"
        rows.append((1000 + i, " ".join(words[rng.randint(0, 9) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # nothing is joined beforehand, so that all links are left to the prefixes
    plain = near_dedup.confirmed_edges
    calls = []
    monkeypatch.setattr(near_dedup, "confirmed_edges", lambda m, *a: plain(m.limit(0) if not calls.append(1) and len(calls) == 1 else m, *a))
    want = brute_duplicates(rows, 1)
    assert 20 < sum(c != d for d, (_, c) in want.items())
    monkeypatch.setattr(near_dedup, "candidate_edges", lambda classes, _: classes.crossJoin(F.broadcast(classes.agg(F.min("rep").alias("b")))).select(F.col("rep").alias("a"), "b"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 1).collect()} == want


def test_ids_with_several_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REPEATED", 20)
    monkeypatch.setattr(near_dedup, "partitions", lambda *_: 16)
    words = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(words), " ".join(words[:-1]), "another text altogether " * 3
    rows = [(5, one, 1), (7, near, 2), (7, other, 3), (7, near, 4), (9, other + "so", 5)] + [(8, one, k) for k in range(200)] + [(4, other, k) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k long")
    found = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 4).collect()}
    assert found == {(5, 5, True), (7, 5, False), (7, 4, False), (8, 5, False), (4, 4, True), (9, 4 if brute_duplicates([(4, other), (9, other + "so")], 4)[9][1] == 4 else 9, brute_duplicates([(4, other), (9, other + "so")], 4)[9][1] != 4)}
    kept = near_dedup.deduplicated(df, 4).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({(5, one), (4, other)} | ({(9, other + "so")} if (9, 9, True) in found else set()))
    # texts of one id that are no near copies both stay, near copies of one id do not
    df = spark.createDataFrame([(1, one), (1, other), (1, near), (1, one)], "doc_id long, text string")
    kept = [r.text for r in near_dedup.deduplicated(df, 4).collect()]
    assert len(kept) == 2 and other in kept


def test_large_and_cut_nodes_lose_few_pairs(spark, monkeypatch):
    """Pairs at 0.8 within a hot group of common boilerplate, by all trees, with nodes far above their limit and cut by tasks."""
    monkeypatch.setattr(near_dedup, "NODE", 64)
    monkeypatch.setattr(near_dedup, "partitions", lambda *_: 16)
    rng = np.random.default_rng(12)
    n, k = 3000, near_dedup.SIGNATURE
    drawn = lambda m: rng.integers(0, 256, (m, k)).astype(np.uint8)
    own = np.where(rng.random((n, k)) < 0.55, drawn(1), drawn(n))
    near = np.where(rng.random((n, k)) < 0.8, own, drawn(n))
    signs = np.concatenate([own, near])
    roots = signs[:, : near_dedup.TREES].astype(int)
    rows = [(i, roots[i].tolist(), bytearray(x.tobytes())) for i, x in enumerate(signs)]
    classes = spark.createDataFrame(rows, "rep long, roots array<int>, signature binary")
    got = {r.id: r.component for r in components.components(near_dedup.candidate_edges(classes, 0.8)).collect()}
    likely = [i for i in range(n) if (own[i] == near[i]).sum() >= 84]
    met = sum(got.get(i, i) == got.get(i + n, i + n) for i in likely)
    assert len(likely) > 0.95 * n and met / len(likely) > 0.9


def test_large_nodes_branch():
    rng = np.random.default_rng(3)
    groups = rng.integers(0, 256, (300, near_dedup.SIGNATURE)).astype(np.uint8)
    signs = np.repeat(groups, 5, axis=0)
    noise = rng.random(signs.shape) < 0.08
    signs[noise] = rng.integers(0, 256, int(noise.sum()))
    signs[:, 0] = 1
    edges = [(int(x), int(y)) for a, b in near_dedup._compare(np.arange(1500), signs, 84, 9) for x, y in zip(a, b)]
    assert edges and all(a // 5 == b // 5 for a, b in edges)
    linked = {a for a, _ in edges} | {b for _, b in edges}
    assert len(linked) > 1350


def test_large_nodes_are_compared_below_the_depth(monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 16)
    monkeypatch.setattr(near_dedup, "DEPTH", 0)
    rng = np.random.default_rng(4)
    drawn = lambda n: rng.integers(0, 256, (n, near_dedup.SIGNATURE)).astype(np.uint8)
    boilerplate, own = drawn(1), drawn(1000)
    half = np.where(rng.random(own.shape) < 0.6, boilerplate, own)
    near = np.where(rng.random(own.shape) < 0.95, half, drawn(1000))
    signs, ids, found = np.concatenate([half, near]), np.arange(2000), set()
    for seed in range(1, 11):
        for a, b in near_dedup._compare(ids, signs, 100, seed):
            found |= set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    assert all(b == a + 1000 for a, b in found) and len(found) == 1000


def test_nodes_cut_by_tasks_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 16)
    monkeypatch.setattr(near_dedup, "TREES", 1)
    monkeypatch.setattr(near_dedup, "partitions", lambda *_: 16)
    rng = np.random.default_rng(8)
    drawn = lambda n: rng.integers(0, 256, (n, near_dedup.SIGNATURE)).astype(np.uint8)
    half = np.where(rng.random((600, near_dedup.SIGNATURE)) < 0.6, drawn(1), drawn(600))
    near = np.where(rng.random(half.shape) < 0.85, half, drawn(600))
    signs = np.concatenate([half, near])
    # One root for all: the ranges of a single deal part many pairs.
    rows = [(i, [7], bytearray(x.tobytes())) for i, x in enumerate(signs)]
    classes = spark.createDataFrame(rows, "rep long, roots array<int>, signature binary")
    got = {frozenset((r.a, r.b)) for r in near_dedup.candidate_edges(classes, 0.85).collect()}
    parts = np.array_split(np.lexsort(signs[:, 8:0:-1].T), 16)
    once = {frozenset((int(x), int(y))) for p in parts for a, b in near_dedup._compare(p, signs[p], 92, 1) for x, y in zip(a, b)}
    true = {frozenset((i, i + 600)) for i in range(600)}
    assert len(got & true) > len(once & true) + 50


def test_near_copies_edges(spark):
    docs = odd_documents(spark)
    rows = near_dedup.near_duplicates(docs, 4).collect()
    assert len(rows) == docs.count()
    one = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert one[0].n_shingles == 0 and one[0].kept and one[100].component_id == 100 and one[3].component_id == 3
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # the two texts of 5 are different documents, the two rows of 3 are one
    assert ids.count(None) == 2 and ids.count(3) == 1 and ids.count(5) == 2 and len(set(ids)) == len(ids) - 2
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0 and near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    rows = [(i + 1, i) for i in range(60)] + [(200, 100), (150, 200), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_word_hashes_do_not_hang_on_place():
    data = np.frombuffer(b"one two  one\ntwo " + b"x" * 70000 + b" " + b"x" * 70000, dtype=np.uint8)
    starts, ends, _ = textbuf.word_ranges(data, np.array([0, len(data)]))
    h = textbuf.range_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[4] == h[5] and len(set(h.tolist())) == 3


# 4, 6 ----------------------------------------------------------------------------------------------------------


LIBRARY = Tokenizer.from_file(WORDS)  # untouched


def library_ids(texts):
    return [x.ids for x in LIBRARY.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def own_ids(texts):
    own = tokens.encoder(WORDS)
    return [np.frombuffer(b, own.type).tolist() for b in own.encode(texts)]


def test_word_encoder_equals_the_library(documents):
    texts = [t for _, t in texts_of(documents)] + [*ODD, None]
    random.seed(2)
    alphabet = "abC.,'!? \n\t\u00a0\u2003é́ß日Σς12_-%😀ʼ\x85\u200b\x1c\x1d\x1e\x1f\x0b\x0c"
    texts += ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "a<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|>" * 3, "a\x1cb", "a\x1cb é", "\x1f"]
    assert tokens.encoder(WORDS).by_word
    assert own_ids(texts) == library_ids(texts)


def test_word_encoder_over_code_points():
    points = [chr(c) for c in range(0x32000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = [f"{c}a{c}B {c} x{c}{c}'s a{c}." for c in points]
    assert own_ids(texts) == library_ids(texts)


def test_other_vocabularies_are_encoded_whole():
    other = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b", "it's\n12", "", "<|endoftext|> x"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    assert [np.frombuffer(b, other.type).tolist() for b in other.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [False, True])
def test_blocks_are_read_alone(bits, monkeypatch):
    monkeypatch.setattr(bitplane, "BLOCK", 100)
    rng = np.random.default_rng(2)
    docs = [(i, rng.integers(0, 49408, n).astype(np.uint16)) for i, n in enumerate([30, 0, 250, 70, 1])]
    data, every = bitplane.pack_file(docs, bits), np.concatenate([d[1] for d in docs])
    for b in range(4):
        assert bitplane.read_block(data, b).tolist() == every[100 * b : 100 * b + 100].tolist()
    for i, (doc_id, ids) in enumerate(docs):
        assert bitplane.read_document(data, i)[0] == doc_id and bitplane.read_document(data, i)[1].tolist() == ids.tolist()
    # the other blocks are not looked at
    head = len(data) - int(bitplane._File(data).index.sum())
    sizes = bitplane._File(data).index.sum(axis=1)
    broken = data[: head + sizes[0]] + bytes(int(sizes[1])) + data[head + sizes[0] + sizes[1] :]
    assert bitplane.read_block(broken, 2).tolist() == every[200:300].tolist()
    with pytest.raises(IndexError):
        bitplane.read_block(data, 4)


@pytest.mark.parametrize("bits", [False, True])
def test_plane_files_round_trip(bits):
    rng = np.random.default_rng(1)
    docs = [(i if i % 3 else None, rng.integers(0, 49408, n).astype(np.uint16)) for i, n in enumerate([0, 1, 70000, 5, 65536])]
    back = bitplane.unpack_file(bitplane.pack_file(docs, bits))
    assert [(d, x.tolist()) for d, x in back] == [(d, x.tolist()) for d, x in docs]
    with pytest.raises(ValueError):
        bitplane.unpack_file(b"XXXX" + bytes(60))


@pytest.mark.parametrize("bits", [False, True])
def test_written_ids(spark, documents, bits, monkeypatch):
    monkeypatch.setattr(bitplane, "FILE_IDS", 3000)
    path = bitplane.token_files(documents, WORDS, 1, bits)
    rows, start = sorted(bitplane.read_digests(spark, path).collect()), 0
    texts = sorted(texts_of(documents))
    assert len(rows) == len(texts)
    for r, (doc_id, _), ids in zip(rows, texts, library_ids([t for _, t in texts])):
        full = [*ids, 1]
        assert tuple(r) == (doc_id, start, len(full), zlib.crc32(np.array(full, "<u4").tobytes()))
        start += len(full)
    assert sorted(bitplane.read_ids(spark, path).collect())[0].ids[-1] == 1


def test_written_ids_edges(spark):
    docs = odd_documents(spark)
    rows = bitplane.read_digests(spark, bitplane.token_files(docs, WORDS, 1)).collect()
    assert len(rows) == docs.count() and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id == 100] == [1]
    assert bitplane.read_digests(spark, bitplane.token_files(docs.limit(0), WORDS, 1)).count() == 0


def test_written_ids_of_one_hot_id(spark, monkeypatch):
    monkeypatch.setattr(bitplane, "partitions", lambda *_: 8)
    rows = [(None, f"no id {i}") for i in range(1500)] + [(3, "same row")] * 1500
    path = bitplane.token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 1)
    got = sorted(bitplane.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 1500 + [3] * 1500 and len({r.ids_crc32 for r in got}) == 1501
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert max(r.n_docs for r in spark.read.parquet(path).collect()) < 1000


def check_packing(rows, texts, end, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = []
    for (doc_id, _), ids in zip(texts, library_ids([t for _, t in texts])):
        full = [*ids, end]
        for k in range(0, len(full), capacity):
            want.append((doc_id, k // capacity, k, len(full[k : k + capacity]), zlib.crc32(np.array(full[k : k + capacity], "<u4").tobytes())))
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    return len(by)


def test_packing(spark, documents, monkeypatch):
    rows = queries.op6_residual_packing(spark, SF).collect()
    n = check_packing(rows, texts_of(documents), 0, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 2
    monkeypatch.setattr(packing, "TASK_BINS", 50)
    small = packing.pack_documents(documents.repartition(7), WORDS, 0, 512, slack=0.0).collect()
    assert check_packing(small, texts_of(documents), 0, 512) <= 1.1 * sum(r.length for r in small) / 512 + 8


def test_packing_edges(spark):
    docs = odd_documents(spark)
    check_packing(packing.pack_documents(docs, WORDS, 0).collect(), texts_of(docs), 0, 2048)
    assert packing.pack_documents(docs.limit(0), WORDS, 0).count() == 0


def test_best_fit():
    assert packing.best_fit([], 10) == []
    random.seed(1)
    sizes = [random.randint(1, 10) for _ in range(500)]
    bins = packing.best_fit(sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 10 for b in bins)
    assert len(bins) <= -(-sum(sizes) // 10) + 5


def test_sequences_hold_the_ids(spark, documents):
    some = documents.limit(20)
    packed = packing.pack_documents(some, WORDS, 0)
    texts = texts_of(some)
    ids = spark.createDataFrame([(d, [*x, 0]) for (d, _), x in zip(texts, library_ids([t for _, t in texts]))], "doc_id long, ids array<int>")
    joined = packing.sequences(packed, ids).collect()
    assert sum(len(r.ids) for r in joined) == sum(len(x) + 1 for x in library_ids([t for _, t in texts])) and all(len(r.ids) <= 2048 for r in joined)


# 5 -------------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.99 and all(0 <= r.score <= 1 for r in rows)


def test_language_scores_against_a_plain_sum(spark):
    rows = [(1, "aaa bb", "x"), (2, "ccc dd cd", "y"), (3, "aab", "x")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["ab", "Cd!", "", None, "12 !", "a c"]
    names, scores, _ = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        if not any(c.isalpha() for c in text or ""):
            assert (name, score) == ("und", 0.0)
            continue
        (grams, bounds, _), = language_id.ngrams([text])
        sums = model.prior + sum(model.matrix[g].astype(float) for g in grams)
        assert name == model.languages[int(np.argmax(sums))] and abs(score - np.exp(sums.max()) / np.exp(sums).sum()) < 1e-9
    # n-grams of a text do not hang on its neighbours
    (one, _, _), = language_id.ngrams(["abc"])
    (two, bounds, _), = language_id.ngrams(["xyz", "abc", "q"])
    assert one.tolist() == two[bounds[1] : bounds[2]].tolist()


def test_language_counts_against_brute_force(spark, documents):
    some = documents.where("lang is not null").limit(60).select("doc_id", "text", "lang")
    model = language_id.train(some, smoothing=0.5)
    counts, docs = {}, Counter()
    for r in some.collect():
        (grams, _, _), = language_id.ngrams([r.text])
        counts.setdefault(r.lang, Counter()).update(grams.tolist())
        docs[r.lang] += 1
    assert model.languages == sorted(counts) and np.allclose(np.exp(model.prior), [docs[x] / 60 for x in model.languages])
    for k, lang in enumerate(model.languages):
        n = np.array([counts[lang][f] for f in range(language_id.FEATURES)])
        want = np.log((n + 0.5) / (n.sum() + 0.5 * language_id.FEATURES))
        assert np.allclose(model.matrix[:, k], want, atol=1e-5) and abs(model.typical[k] - (n * want).sum() / n.sum()) < 1e-4


def test_ngrams_by_hand():
    # 1-, 2- and 3-grams of each character in turn, filled up with blanks, hashed alike wherever they stand
    (grams, bounds, n), = language_id.ngrams(["ab1", "xab "])
    assert bounds.tolist() == [0, 9, 21] and n.tolist() == [2, 3]
    assert grams[:9].tolist() == grams[12:21].tolist()  # "ab " after "x"
    assert len(set(grams[9:12].tolist()) | set(grams[:3].tolist())) == 6


def test_strange_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    random.seed(7)
    strange = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (200, 400, 3000)] + ["これは日本語の文章です。今日は天気がいいので散歩に行きました。", "Это русский текст, который никогда не изучался моделью."]
    df = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert language_id.identified(df, model).count() == 0 and min(model.predict(strange)[1]) > 0.99
    assert language_id.identified(docs, model).count() == docs.count() - docs.where("not text rlike '[a-zA-Z]'").count()


def test_language_edges(spark):
    docs = odd_documents(spark)
    model = language_id.train(docs)
    kept = language_id.identified(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    blank = language_id.train(docs.limit(0))
    assert {r.l.lang_pred for r in docs.select(language_id.predict(docs, blank).alias("l")).collect()} == {"und"}
    few = language_id.train(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("x").alias("lang")), max_train=100)
    assert 60 < few.matrix.shape[0] and few.languages == ["x"]


# 7 -------------------------------------------------------------------------------------------------------------


def test_byte_bpe_equals_tiktoken(documents):
    import tiktoken

    own = byte_bpe.ByteBpe(RANKS)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    random.seed(4)
    alphabet = "ab sS'\n\t  'revelldmt1２é中́!- \x85\u3000😀ʼ’"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(5000)]
    texts += [t for _, t in texts_of(documents)] + ODD + ["x" * 3000, " " * 500, "\n" * 300 + "a", "'" * 300, "ab" * 5000]
    for text, (ids, joined) in zip(texts, own.encode(texts)):
        want = ref.encode_ordinary(text)
        assert ids.tolist() == want and joined == ",".join(map(str, want)) and own.decode(ids) == text.encode()
        assert not len(ids) or own.ends(ids)[-1] == len(text.encode())


def test_long_texts_are_encoded_in_windows(monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 50)
    import tiktoken

    own = byte_bpe.ByteBpe(RANKS)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    random.seed(9)
    alphabet = "abc S'\n\t  're1２é中́!\x85\u3000😀"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 700))) for _ in range(300)] + ["a" * 400, " " * 400, "é \n" * 200, "x" * 120 + " \n y", None]
    for text, (ids, joined) in zip(texts, own.encode(texts), strict=True):
        want = ref.encode_ordinary(text or "")
        assert ids.tolist() == want and joined == ",".join(map(str, want))
    assert max(len(w) for w in own.windows("é ab" * 500)) < 60


def test_byte_bpe_frames(spark):
    docs = odd_documents(spark)
    encoded = byte_bpe.encode_texts(docs, RANKS)
    back = sorted((r.text for r in byte_bpe.decode_ids(encoded, RANKS).collect()))
    assert back == sorted(t or "" for _, t in texts_of(docs))
    rows = byte_bpe.round_trip_digests(docs, RANKS).collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts_of(docs))
    assert byte_bpe.round_trip_digests(docs.limit(0), RANKS).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k):
    out = set()
    for q, v in rows:
        if q % 20:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q)[:k]
        out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("growth", [2, 100])
def test_top_k_with_ties_and_copies(spark, monkeypatch, growth):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BATCH", 7)
    monkeypatch.setattr(topk, "RUN_BLOCKS", 3)
    monkeypatch.setattr(topk, "GROWTH", growth)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-5, 6, 20).tolist()) for i in range(700)] + [(1000 + i, [3] * 20) for i in range(300)] + [(2000, [0] * 20), (2020, [10**6] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = {tuple(r) for r in topk.top_k(df.union(df.limit(30)), F.col("vec_id") % 20 == 0, 20).collect()}
    assert got == brute_topk(rows, 20)


def test_top_k_sends_queries_only_where_needed(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    monkeypatch.setattr(topk, "RUN_BLOCKS", 2)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-9, 10, 12) * (1 + 40 * (i % 10 == 0))).tolist()) for i in range(1000)]
    sent, plain = [], topk._round
    monkeypatch.setattr(topk, "_round", lambda b, a, low, high, s: sent.append((a.select(F.sum(F.least("reach", F.lit(high)) - low)).first()[0], high - low)) or plain(b, a, low, high, s))
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") % 20 == 0, 5).collect()}
    want = {r for r in brute_topk(rows, 5)}
    assert got == want
    # 50 queries and 25 runs of 40: a tenth of the vectors is long, so most runs are never asked
    assert sum(n for n, _ in sent) < 50 * 25 / 3 and max(h for _, h in sent) <= 25
    assert topk._smallest_kind(127) == "i1" and topk._smallest_kind(128) == "i2" and topk._smallest_kind(1 << 40) == "i8"


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, -0.1]), (20, [0.5, None]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (1, [1.0, 1.0]), (None, [1.0, 1.0]), (2, [-0.01, 0.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(tuple(r) for r in topk.top_k(v, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 2, -6), (0, 2, 1, -64)]
    assert topk.top_k(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    wide = spark.createDataFrame([(0, [1 << 20]), (20, [1 << 20, 3]), (3, [])], "vec_id long, vector array<long>")
    assert sorted(tuple(r) for r in topk.top_k(wide, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 20, 1 << 40), (0, 2, 3, 0), (20, 1, 0, 1 << 40), (20, 2, 3, 0)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1 << 40, 1])], "vec_id long, vector array<long>"), F.col("vec_id") == 0)


# 9 -------------------------------------------------------------------------------------------------------------


def test_edited_texts(spark, documents):
    rows = sorted(texts_of(documents), reverse=True)
    got = {r.doc_id: r for r in queries.op9_multiset_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    prints = fingerprint.fingerprints([t.encode() for _, t in rows])
    ahead = 0
    for i, (doc_id, text) in enumerate(rows):
        cut, after = len(text) // 3, rows[(i + 1) % len(rows)][1]
        edited, r = text[: len(text) - cut] + after[:cut], got[doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[i].hex())
        own, = fingerprint.fingerprints([edited.encode()])
        assert r.edited_fingerprint == own.hex() and r.near_edited == prints[i].likeness(own) and r.near_next == prints[i].likeness(prints[(i + 1) % len(rows)])
        ahead += r.near_edited > r.near_next
    assert ahead / len(rows) > 0.9
    assert len({r.fingerprint for r in got.values()}) == len({t for _, t in rows})


def unit_counts(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    hashes, _ = fingerprint._units(data, np.array([0, len(data)]))
    return Counter(hashes.tolist())


def test_likeness_is_near_the_cosine_of_unit_counts(documents):
    texts = [t for _, t in texts_of(documents)][:80]
    texts += [t[: len(t) * 2 // 3] + texts[i - 1][:300] for i, t in enumerate(texts)]
    texts += ["日本語" * 400, "日本語" * 300 + "東京" * 50, "".join(random.Random(1).choices("abcdef", k=9000)), "word " * 4000, "word " * 3000 + "other " * 500, "b" * 40_000]
    texts.append(texts[-4][:6000])
    prints, counts = fingerprint.fingerprints([t.encode() for t in texts]), [unit_counts(t) for t in texts]
    off = []
    for i in range(len(texts)):
        for j in range(i):
            a, b = counts[i], counts[j]
            size = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
            true = sum(v * b[k] for k, v in a.items()) / size if size else float(texts[i] == texts[j])
            off.append(abs(prints[i].likeness(prints[j]) - true))
    assert np.mean(off) < 0.08 and np.quantile(off, 0.999) < 0.35
    # text without blanks is like itself with a third cut off
    long = texts.index("".join(random.Random(1).choices("abcdef", k=9000)))
    assert prints[long].likeness(prints[-1]) > 0.6 and prints[-4].likeness(prints[-3]) > 0.9


def test_units_are_short():
    for text in (b"x" * 5000, b"the " * 5000, bytes(random.Random(2).choices(range(97, 123), k=20_000)), "é日本".encode() * 3000):
        data = np.frombuffer(text, dtype=np.uint8)
        starts, ends, _ = textbuf.word_ranges(data, np.array([0, len(data)]))
        a, b = fingerprint._pieces(data, starts, ends)
        assert (b > a).all() and (b - a).max() <= fingerprint.LONG_PIECE and int((b - a).sum()) == int((ends - starts).sum())
        hashes, cuts = fingerprint._units(data, np.array([0, len(data)]))
        assert len(hashes) >= len(a) / fingerprint.MOST_WORDS and cuts.tolist() == [0, len(hashes)]


def test_units_do_not_hang_on_neighbours():
    texts = [b"a b c\nd e", b"", b"x" * 700, b" y\n", b"the " * 100]
    data, bounds = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    hashes, cuts = fingerprint._units(data, bounds)
    for i, t in enumerate(texts):
        own = np.frombuffer(t, dtype=np.uint8)
        assert hashes[cuts[i] : cuts[i + 1]].tolist() == fingerprint._units(own, np.array([0, len(own)]))[0].tolist()


def brute_edits(rows):
    """Multisets of what follows what, where rows of one id may come in any order but equal ones stay together."""
    out = Counter()
    for i, (d, t) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(t) // 3
        out[d, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("ids", ["null", "one", "equal", "some"])
def test_hot_ids_and_rows_spread(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "SAMPLE", 512)
    monkeypatch.setattr(fingerprint, "partitions", lambda *_: 8)
    n = 4000
    rows = {
        "null": [(None, f"no id {i} of them") for i in range(n)], "one": [(7, f"one id {i} of them") for i in range(n)],
        "equal": [(None, "abc def ghi")] * n + [(i, f"own {i} text") for i in range(40)],
        "some": [(5, f"five {i % 3}") for i in range(n // 2)] + [(i, f"row {i} of these") for i in range(n // 2)],
    }[ids]
    seen = []
    plain = fingerprint._with_next
    monkeypatch.setattr(fingerprint, "_with_next", lambda d: seen.append(plain(d)) or seen[-1])
    got = fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    sizes = [r["count"] for r in seen[0][0].groupBy("bucket").count().collect()]
    assert max(sizes) < n / 3
    assert len(got) == len(rows) and Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t)) for d, t in rows)
    # the order that the hash of texts gives
    hashed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute_edits([(r.doc_id, r.text) for r in order])


def test_fingerprints_add_up():
    a, b, ab, ba, a2 = fingerprint.fingerprints([b"first line here", b"second one", b"first line here\nsecond one", b"second one\nfirst line here", b"first line here"])
    assert ab.hex() == ba.hex() == (a + b).hex() and (ab - b).hex() == a.hex() == a2.hex() and a.hex() != b.hex()
    assert fingerprint.Fingerprint.parse(ab.hex()).likeness(ab) == 1.0 and 0 < ab.likeness(a) < 1


def test_fingerprint_edges(spark):
    docs = odd_documents(spark)
    rows = fingerprint.edited_fingerprints(docs).collect()
    assert len(rows) == docs.count() and sum(r.n_chars for r in rows) == sum(len(t or "") for _, t in texts_of(docs))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    one = fingerprint.edited_fingerprints(docs.where("doc_id = 4")).first()
    assert one.edited_sha256 == hashlib.sha256(b"A A").hexdigest() and one.near_next == 1.0
    assert fingerprint.edited_fingerprints(docs.limit(0)).count() == 0
    nulls = fingerprint.edited_fingerprints(docs.where("doc_id is null")).collect()
    assert len(nulls) == 2
    assert fingerprint.fingerprint_texts(docs).count() == docs.count()


# 10 ------------------------------------------------------------------------------------------------------------


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_url_rules_against_brute_force(spark):
    rules = [*queries.RULES, url_filter.Rule("a.b", "", "block"), url_filter.Rule("b", "/x", "allow"), url_filter.Rule("b", "/x/y/", "block"), url_filter.Rule("b", "/x/yz", "allow"), url_filter.Rule("b", "/x/yz", "block")]
    random.seed(3)
    hosts = ["a.b", "c.a.b", "b", "xb", "EXAMPLE.net", "m.example.com", "org", "x.org:80", "", ".b", "net"]
    paths = ["", "/", "/en/", "/en", "/x", "/xy", "/x/y", "/x/y/z", "/x/yz1", "/fr/a", "/de/?q=/x", "?a=://", "#f", "/x//y"]
    urls = [f"http://{random.choice(hosts)}{random.choice(paths)}" for _ in range(600)] + [None, "", "no scheme", "://b/x", "a://b/x://c", "http://"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.RuleTrie([url_filter.Rule("a", "/", "maybe")])


def test_url_rules_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)
    rules = [*queries.RULES, url_filter.Rule("b", "/x", "allow"), url_filter.Rule("b", "/x", "block"), url_filter.Rule("a.b", "/", "allow")]
    urls = ["http://a.b/x", "http://b/x", "http://c.b/", "http://m.example.net/en/q", "http://x.org/fr/" + "y" * 20_000, None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge_urls(df, [], default="block").collect()} == {"block"}


# Names of columns ----------------------------------------------------------------------------------------------

CLASHES = "_h _s _b _n _c0 _c1 _t _d _k _id _i _language _judged _best _text _salt _n _run Host PATH rule verdict shard SLOT quality keep evidence score lang_pred strangeness rank component kept bucket tail copies sequence_id tree rep deal".split()


@pytest.fixture(scope="module")
def clashing(documents):
    docs = documents.limit(40).withColumn("url", F.lit("http://a.org/fr/x"))
    own = {c.lower() for c in docs.columns}
    for name in CLASHES:
        if name.lower() not in own:
            docs, own = docs.withColumn(name, F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string"))), own | {name.lower()}
    return docs


def untouched(before, after, without=()):
    """Rows of ``after`` have the columns of ``before``, with the same values for the same ids."""
    names = [c for c in before.columns if c.lower() not in without]
    want = {r.doc_id: tuple(r[c] for c in names) for r in before.collect()}
    rows = after.collect()
    return rows and all(tuple(r[c] for c in names) == want[r.doc_id] for r in rows)


def test_clashing_names_in_operators(spark, clashing):
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("text", F.lit("x"))
    n, model = clashing.count(), quality.train(clashing, labels)
    rows = quality.classify(clashing, model, F.col("source"), F.col("lang")).collect()
    assert len(rows) == n and all(r.path == f"{r.host}/{r.path.split('/')[-1]}" for r in rows)
    placed = sharding.interleave(clashing, ["doc_id"], "source", 3)
    assert untouched(clashing, placed, ("shard", "slot")) and {r.shard for r in placed.collect()} == {0, 1, 2}
    assert near_dedup.near_duplicates(clashing).count() == n
    assert bitplane.read_digests(spark, bitplane.token_files(clashing, WORDS, 1)).count() == n
    speech = language_id.train(clashing)
    assert untouched(clashing, language_id.identified(clashing, speech))
    assert packing.pack_documents(clashing, WORDS, 0).select("doc_id").distinct().count() == n
    assert byte_bpe.round_trip_digests(clashing, RANKS).count() == n and byte_bpe.encode_texts(clashing, RANKS).count() == n
    vectors = spark.createDataFrame([(i, [1.0 * i, 2.0], "x", 7) for i in range(30)], "vec_id long, embedding array<float>, vector string, rank int")
    assert topk.top_k(topk.integer_vectors(vectors), F.col("vec_id") % 20 == 0).count() == 40
    assert fingerprint.edited_fingerprints(clashing).count() == n and fingerprint.fingerprint_texts(clashing).count() == n
    judged = url_filter.judge_urls(clashing, queries.RULES)
    assert untouched(clashing, judged, ("host", "path", "rule", "verdict")) and {(r.host, r.verdict) for r in judged.collect()} == {("a.org", "allow")}


def test_clashing_names_in_stages(spark, clashing):
    import corpus_pipeline

    docs = clashing
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert after.columns == docs.columns and untouched(clashing, after)
        docs = after
    assert docs.count() > 0


# Pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark, documents):
    import corpus_pipeline

    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        seen.append((name, before, docs))
    assert all(after.columns == documents.columns for name, _, after in seen[:-1])
    name, before, after = seen[2]
    want = brute_duplicates(texts_of(before), 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    check_packing(docs.collect(), texts_of(after), 0, 2048)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept, known = {r.doc_id for r in seen[1][2].collect()}, {r.doc_id for r in seen[1][1].collect()}
    assert len(bad & known - kept) <= 1
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_edges(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert corpus_pipeline.stored(stage(spark, docs.limit(0), SF), name).count() == 0
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
    assert docs.count() > 0
