import random
from collections import Counter, defaultdict

import pytest
import xxhash

from sigloom.llm import sharding


def hashed(*values):
    """Spark's xxhash64 of a long and of ints after it."""
    h = 42
    for k, v in enumerate(values):
        h = xxhash.xxh64_intdigest(v.to_bytes(8 if k == 0 else 4, "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


def plain_propagation(sizes, edges, shards, capacity, rounds):
    near, before = defaultdict(list), defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
        before[b].append(a)
    label = {v: hashed(min([v, *before[v]])) % shards for v in sizes}
    for step in range(rounds):
        wanted = {}
        for v in sizes:
            votes = Counter(label[u] for u in (before[v] if step % 2 == 0 else near[v]))
            wanted[v] = min(votes, key=lambda x: (-votes[x], x)) if votes else label[v]
        asks, load = Counter(), Counter()
        for v, n in sizes.items():
            load[label[v]] += n
            if wanted[v] != label[v]:
                asks[label[v], wanted[v]] += n
        if not asks:
            break
        odds = sharding.odds(dict(asks), [max(0.0, capacity - load[k]) for k in range(shards)])
        moves = {v for v in sizes if wanted[v] != label[v] and (hashed(v, step) % 2**30) / 2**30 < odds[label[v] * shards + wanted[v]] and (step % 2 == 0 or hashed(v, -step) % 2 == 0)}
        label = {v: wanted[v] if v in moves else label[v] for v in sizes}
    return label


def cut(edges, label):
    return sum(label[a] != label[b] for a, b in edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_equals_a_plain_one_and_cuts_less(spark, seed):
    r = random.Random(seed)
    sizes = {v: r.randint(10, 30) for v in range(240)}
    edges = sorted({tuple(sorted(r.sample(range(g, g + 12), 2))) for g in range(0, 240, 12) for _ in range(40)} | {tuple(sorted(r.sample(range(240), 2))) for _ in range(20)})
    capacity = sum(sizes.values()) / 4
    nodes, links = spark.createDataFrame(list(sizes.items()), "node long, size long"), spark.createDataFrame(edges, "a long, b long")
    found = {x.node: x.label for x in sharding.propagate(nodes, links, 4, 1.1 * capacity, 6).collect()}
    assert found == plain_propagation(sizes, edges, 4, 1.1 * capacity, 6)
    random_start = {v: hashed(v) % 4 for v in sizes}
    assert cut(edges, found) < 0.6 * cut(edges, random_start)


def test_swaps_change_no_size():
    assert sharding.odds({(0, 1): 10, (1, 0): 10}, [0.0, 0.0]) == [0.0, 1.0, 1.0, 0.0]
    assert sharding.odds({(0, 1): 10, (1, 0): 4}, [0.0, 3.0]) == [0.0, 0.7, 1.0, 0.0]


@pytest.mark.parametrize(("size", "groups"), [(5, 960), (2, 2400), (1600, 1), (1, 3000)])
def test_shards_are_even_and_copies_together(spark, size, groups):
    r = random.Random(size)
    texts = [f"text {g} " + "x" * r.randint(100, 400) for g in range(groups)]
    rows = [(k, texts[k // size]) for k in range(size * groups)]
    if size == 1600:  # one text has a third of all rows
        rows += [(k, f"other {k} " + "x" * r.randint(100, 400)) for k in range(1600, 4800)]
    r.shuffle(rows)
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    load, held = Counter(), defaultdict(Counter)
    for x in out:
        load[x.shard] += x["size"]
        held[x.text_crc32, x["size"]][x.shard] += 1
    assert len(out) == len(rows) and sorted(load) == list(range(24))
    assert max(load.values()) <= 1.02 * sum(load.values()) / 24 and min(load.values()) >= 0.98 * sum(load.values()) / 24
    together, copies = sum(max(c.values()) for c in held.values() if sum(c.values()) > 1), sum(sum(c.values()) for c in held.values() if sum(c.values()) > 1)
    if 1 < size < 100:
        assert together >= 0.95 * copies


def test_propagation_is_what_brings_copies_together(spark, monkeypatch):
    """Without its rounds copies stay where each hashes to; with them nearly all of a group share a shard."""
    rows = [(k, f"text {k // 4}" if k < 800 else f"other {k}") for k in range(1600)]
    df, given, moved = spark.createDataFrame(rows, "doc_id long, text string"), sharding.propagate, []

    def watched(nodes, *rest):
        out = given(nodes, *rest)
        moved.append(out.join(nodes.select("node", nodes["label"].alias("before")), "node").filter("label <> before").count())
        return out

    def main(rounds):
        held = defaultdict(Counter)
        for x in sharding.shard_documents(df, 6, rounds).collect():
            if x.doc_id < 800:
                held[x.doc_id // 4][x.shard] += 1
        return sum(max(c.values()) for c in held.values())

    monkeypatch.setattr(sharding, "propagate", watched)
    assert main(0) < 500 and main(4) >= 760
    assert moved[0] == 0 and moved[1] > 400
