"""Exact and near duplicates, components, top-k against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigloom.llm import components, exact_dedup, simhash, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_links(prints, budget=3):
    v = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= budget)
    return [(int(v[a]), int(v[b])) for a, b in zip(i, j, strict=True) if a < b]


def test_hash_is_sparks_own(spark):
    text = "a b ç"
    assert spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_simhash_equals_brute_force(spark, documents):
    found = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {d: f for d, (f, _) in found.items()} == prints
    root = plain_components(set(prints.values()), near_links(sorted(set(prints.values()))))
    least = defaultdict(lambda: 10**12)
    for d, f in prints.items():
        least[root[f]] = min(least[root[f]], d)
    assert {d: c for d, (_, c) in found.items()} == {d: least[root[f]] for d, f in prints.items()}


def test_long_texts_are_read_in_blocks():
    text = " ".join(f"w{i % 1013}x{i % 7}" for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    words, simhash._words.__defaults__ = simhash._words.__defaults__, (257,)
    try:
        assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)
    finally:
        simhash._words.__defaults__ = words


@pytest.mark.parametrize("partitions", ["4", "40"])
def test_trie_join_of_dense_groups(spark, partitions):
    """Clusters in which nearly all are linked, and hot nodes that Spark splits further."""
    random = np.random.default_rng(1)
    prints = set()
    for centre in random.integers(0, 2**63, 6).tolist():
        for _ in range(250):
            prints.add(centre ^ sum(1 << int(b) for b in random.choice(64, random.integers(0, 4), replace=False)))
    prints |= set(random.integers(0, 2**63, 600).tolist())
    prints = sorted(prints)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
        found = {r.node % 2**64: r.root % 2**64 for r in simhash.linked_fingerprints(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    root = plain_components(prints, near_links(prints))
    sizes = Counter(root.values())
    assert set(found) == {p for p in prints if sizes[root[p]] > 1}
    groups = defaultdict(set)
    for p in found:
        groups[root[p]].add(found[p])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299), (None, 4)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = [{found[i] for i in group} for group in (range(51), range(100, 160), (299, 300))]
    assert all(len(r) == 1 for r in roots) and len(set.union(*roots)) == 3 and len(found) == 51 + 60 + 2
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_odd_rows(odd, nothing, clashing):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[4].component_id == by[5].component_id == 4 and by[8].fp == by[9].fp and by[9].component_id == 8
    assert by[7].component_id == 6
    assert simhash.near_duplicates(nothing).count() == 0
    assert sorted(map(str, simhash.near_duplicates(clashing).collect())) == sorted(map(str, out))
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 6, 8, 10, 11, 12]


def test_exact_groups_of_odd_rows(odd, nothing, clashing):
    out = exact_dedup.exact_groups(odd).collect()
    assert len(out) == odd.count() and sum(r.kept for r in out) == len({r.text_sha256 for r in out})
    same = [r for r in out if r.group_size == 5]
    assert len(same) == 5 and {r.keep_id for r in same} == {5} and [r.doc_id for r in same if r.kept] == [5]
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in out if r.doc_id in (1, 2)) == [(1, 2, False), (2, 2, True)]
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0
    assert sorted(map(str, exact_dedup.exact_groups(clashing).collect())) == sorted(map(str, out))
    kept = exact_dedup.drop_exact_duplicates(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)


def test_groups_of_null_ids_only(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (1, "y")], "doc_id long, text string")
    out = exact_dedup.exact_groups(df).collect()
    assert sorted((str(r.keep_id), r.group_size, r.kept) for r in out) == [("1", 1, True), ("None", 2, False), ("None", 2, True)]
    assert exact_dedup.drop_exact_duplicates(df).count() == 2


def test_a_filter_that_is_full_stays_exact(documents):
    small = exact_dedup.exact_groups(documents, max_filter_bytes=64)
    assert sorted(map(str, small.collect())) == sorted(map(str, exact_dedup.exact_groups(documents).collect()))


def plain_top(vectors, k):
    out = []
    for q in sorted(vectors):
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def test_top_k_of_odd_vectors(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.normal(size=8).tolist()) for i in range(205)] + [(300, [0.5] * 8), (301, [0.5] * 8), (302, [0.5] * 8), (303, [3e9] * 8), (304, [1.0, 2.0]), (305, [])]
    bad = [(400, None), (401, [None] + [1.0] * 7), (500, [float("nan")] * 8), (501, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit(2), "id": F.lit(3)})
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    found = topk.top_k(df, F.col("id") % 100 == 0, pivots=8)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(vectors, 10)
    turns = topk.top_k(df, F.col("id") % 100 == 0, pivots=8, rounds=(1, 2, 3, 5, None))
    assert sorted(tuple(r) for r in turns.collect()) == plain_top(vectors, 10)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("id") % 100 == 0).collect()] == [(0, 1, 7, 2 * 1024 * 1024)]
    assert topk.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_rows_of_the_same_id_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [2.0]), (7, [3.0]), (100, [1.0]), (100, [-1.0])], "vec_id long, embedding array<double>")
    out = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 100 == 0, rounds=(1, None)).collect())
    assert [(a, b, c, d // 2**20) for a, b, c, d in out if a == 0] == [(0, 1, 7, 3), (0, 2, 7, 2), (0, 3, 100, 1), (0, 4, 100, -1)]
    assert sorted((c, d // 2**20) for a, _, c, d in out if a == 100) == sorted([(7, 3), (7, 2), (0, 1), (100, -1), (0, -1), (100, -1), (7, -2), (7, -3)])


def test_rows_found_do_not_grow_with_blocks(spark, monkeypatch):
    """Many small blocks in 200 partitions: what queries ask and find follows the blocks that can hold a result, not the partitions (which gave 2,000 rows a query and pass)."""
    monkeypatch.setattr(topk, "PER_BLOCK", 20)
    random = np.random.default_rng(8)
    middles = random.normal(size=(40, 8))
    x = middles[random.integers(0, 40, 4000)] + 0.1 * random.normal(size=(4000, 8))
    found = []
    met = topk._met

    def seen(*args):
        out = met(*args)
        found.append((args[1].count(), out.count()))
        return out

    monkeypatch.setattr(topk, "_met", seen)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(200)
    out = topk.top_k(df, F.col("id") % 100 == 0, pivots=16)
    v = np.floor(1024 * x).astype(np.int64)
    for q in (0, 700, 3900):
        score = v[q] @ v.T
        wanted = sorted((k for k in range(4000) if k != q), key=lambda k: (-score[k], k))[:10]  # noqa: B023
        assert [(r.vec_id, r.score) for r in out.filter(f"query_id = {q}").orderBy("rank").collect()] == [(k, score[k]) for k in wanted]
    asked, rows = sum(n for n, _ in found), sum(n for _, n in found)
    assert rows < 40 * 300 and rows <= 6 * asked


def test_bounds_hold():
    random = np.random.default_rng(3)
    q, x, p = random.normal(size=(20, 6)), random.normal(size=(300, 6)), random.normal(size=(1, 6))
    r = topk.distances(x, p)[:, 0]
    for lo, hi in ((0, 1.5), (1.5, 2.5), (2.5, 9)):
        own = x[(r >= lo) & (r <= hi)]
        norm = np.sqrt(np.square(own).sum(1).max())
        assert (upper := topk.upper_bounds(q, topk.distances(q, p)[:, 0], lo, hi, norm)).shape == (20,) and ((q @ own.T).max(1) <= upper).all()
