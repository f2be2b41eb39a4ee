import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from sigloom.llm import near_copies as near_copies_module
from sigloom.llm import exact_dedup, mixing, near_copies


def brute(texts):
    """Components by smallest id over all pairs, with Python sets."""
    sets = {}
    for k, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}
    least = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least, pairs


def test_stage_drops_edited_copies_as_brute_force_does(spark, sf_dir):
    r = random.Random(3)
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for k in range(60):  # a few edited words, far more than three bits
        words = [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(r.randint(60, 400))]
        texts[1000 + 2 * k] = " ".join(words)
        for _ in range(r.randint(1, max(1, len(words) // 55))):
            words[r.randrange(len(words))] = "edited"
        texts[1001 + 2 * k] = " ".join(words)
    least, pairs = brute(texts)
    assert sum(a >= 1000 for a, _ in pairs) > 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()}
    assert kept == {k for k in texts if least[k] == k}


def test_large_group_around_one_text(spark):
    r = random.Random(4)
    hub = [f"w{k}" for k in range(200)]
    texts = {0: " ".join(hub)}
    for k in range(1, 40):  # copies resemble the hub, seldom each other
        words = list(hub)
        for at in r.sample(range(0, 200, 6), 4):
            words[at] = f"x{k}"
        texts[k] = " ".join(words)
    least, _ = brute(texts)
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (None, None)], "doc_id long, text string")
    found = {x.id: x.component_id for x in near_copies.near_copies(docs).collect()}
    assert {k: found.get(k, k) for k in texts} == least
    assert near_copies.drop_near_copies(docs).filter("doc_id IS NULL").count() == 2
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_words_across_blocks_and_short_texts():
    assert len(near_copies.shingle_set(b"")) == len(near_copies.shingle_set(b"one two")) == 1
    assert np.array_equal(near_copies.shingle_set(b"A b\nC"), near_copies.shingle_set(b" a B c "))
    assert len(near_copies.shingle_set(b"a b c d e f a b c d e")) == 6


def test_rows_are_told_apart_by_id_and_text(spark):
    """Repeated ids neither link unlike texts nor take them along."""
    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    df = spark.createDataFrame([(1, a, 1), (5, a, 2), (5, b, 3), (9, b, 4), (9, b, 4), (None, a, 5), (7, None, 6), (8, "", 7)], "doc_id long, text string, n int")
    kept = sorted((r["doc_id"], r["n"]) for r in near_copies.drop_near_copies(df).filter("doc_id IS NOT NULL").collect())
    assert kept == [(1, 1), (5, 3), (7, 6)]
    found = {(r["id"], r["component_id"]) for r in near_copies.near_copies(df).collect()}
    assert found == {(1, 1), (5, 1), (5, 5), (9, 5), (7, 7), (8, 7)}


def test_pairs_that_no_bucket_links_first(spark):
    """Chains of texts across buckets, of sizes from 3 to 4000 words, with all pairs compared."""
    r = random.Random(9)
    texts = {}
    for k in range(40):
        words = [f"{k % 8}w{j}" for j in range([3, 5, 9, 60, 61, 200, 900, 4000][k % 8])]
        for _ in range(max(0, len(words) // r.choice([30, 60, 200]))):
            words[r.randrange(len(words))] = f"x{r.randrange(3)}"
        texts[k] = " ".join(words + [f"{k % 8}w{j}" for j in range(r.randrange(1 + len(words) // 6))])
    least, pairs = brute(texts)
    assert len(pairs) > 20
    found = {x["id"]: x["component_id"] for x in near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {k: found.get(k, k) for k in texts} == least


def test_prefix_pairs_leave_out_none(spark):
    """Every similar pair of any sizes is among them; texts that share a template but are not similar mostly are not."""
    r = random.Random(10)
    sets = [sorted(r.sample(range(k, k + 60), r.randint(1, 50))) for k in range(0, 40) for _ in range(3)]
    sets += [sorted({x for x in s if r.random() < 0.95}) or s for s in sets]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "node long, set array<long>")
    alone = df.select("node", F.col("node").alias("comp"))
    found = {(p["a"], p["b"]) for p in near_copies.prefix_pairs(df, alone, 0.8).collect()}
    wanted = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]}) - 1e-9}
    assert wanted <= found and len(wanted) > 50
    template = list(range(10**6, 10**6 + 110))
    unlike = spark.createDataFrame([(k, template + list(range(1000 * k, 1000 * k + 90))) for k in range(300)], "node long, set array<long>")
    assert near_copies.prefix_pairs(unlike, unlike.select("node", F.col("node").alias("comp")), 0.8).count() == 0


def test_stages_keep_all_columns(spark, clashing, nothing):
    """Names of results and inner columns as the input's: every value comes back, also of repeated rows, nulls, long and empty texts."""
    names = "row sha words mix_id mix_source __sha __possible __block __md5 __band __size __t __id __words size keep_sha component_id node comp".split()
    df = clashing.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    rows = {tuple(r) for r in df.collect()}
    for stage in (near_copies.drop_near_copies, exact_dedup.drop_exact_duplicates, mixing.mix_documents):
        out = stage(df)
        assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= rows
        assert out.count() > 4
        assert stage(nothing).columns == nothing.columns and stage(nothing).count() == 0
    kept = [r["text"] for r in exact_dedup.drop_exact_duplicates(df).collect()]
    assert sorted(t or "" for t in kept) == sorted({r["text"] or "" for r in df.collect()})
    long = [r["doc_id"] for r in near_copies.drop_near_copies(df).filter("doc_id IN (6, 7)").collect()]
    assert long == [6]


def test_linked_fingerprints_propose(spark, monkeypatch):
    """A word of many changed: SimHash links the texts, and what it proposes is compared."""
    words = [f"w{k}" for k in range(600)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(f"v{k}" for k in range(600))]
    seen, given = [], near_copies_module.fingerprint_pairs
    monkeypatch.setattr(near_copies_module, "fingerprint_pairs", lambda df: (seen.append(given(df)), seen[-1])[1])
    kept = near_copies_module.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2]
    assert len(seen) == 1 and seen[0].count() == 1


def test_pairs_of_buckets_of_two(spark):
    """Two groups around 2 and 3, linked by 0 and 1 alone: what these share is a bucket without any other text, and each shares more with the middle of its own group."""
    r = random.Random(3739)

    def edited(words, n, tag):
        out = list(words)
        for at in r.sample(range(2, len(words) - 2, 5), n):
            out[at] = f"{tag}{at}"
        return out

    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    zero, one = edited(base, 2, "a"), edited(base, 2, "b")
    two, three = edited(zero, 3, "c"), edited(one, 3, "d")
    rest = [edited(words, 3, f"e{4 + 5 * k + j}_") for k, words in enumerate((two, three)) for j in range(5)]
    texts = {k: " ".join(words) for k, words in enumerate([zero, one, two, three, *rest])}
    least, pairs = brute(texts)
    across = [(a, b) for a, b in pairs if (a in {0, 2, *range(4, 9)}) != (b in {0, 2, *range(4, 9)})]
    assert across == [(0, 1)] and set(least.values()) == {0}
    found = {x["id"]: x["component_id"] for x in near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == least
