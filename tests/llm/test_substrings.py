import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.llm import substrings


def brute(rows, n=13):
    """By Python dictionaries over all windows."""
    order = lambda i: -(2**63) if i is None else i
    split = [(order(i), (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, words in split:
        for k in range(len(words) - n + 1):
            key = tuple(words[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, words), (name, _) in zip(split, rows, strict=True):
        gone = {p for k in range(len(words) - n + 1) if first[tuple(words[k : k + n])] < i for p in range(k, k + n)}
        out.append((name, len(words), len(gone), hashlib.sha256(b" ".join(w for p, w in enumerate(words) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60, words=40):
    """Texts of few words, put together from shared passages: paths that branch, overlap and repeat within a text."""
    random_ = random.Random(seed)
    passages = [[random_.choice("abcdef") * random_.randint(1, 2) for _ in range(random_.randint(5, words))] for _ in range(12)]
    rows = []
    for k in range(n):
        parts = [w for _ in range(random_.randint(0, 5)) for w in random_.choice(passages)[random_.randint(0, 4) :]]
        rows.append((random_.choice([k, k, k, None, 3]), random_.choice([" ", "\n", " \t"]).join(parts)))
    return rows + rows[:5]


@pytest.mark.parametrize(("seed", "n", "bits"), [(0, 13, 64), (1, 4, 64), (2, 13, 6), (3, 3, 3)])
def test_equals_brute_force(spark, seed, n, bits):
    """Few bits make nearly all windows collide."""
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted([tuple(r) for r in substrings.cut_repeats(df, words=n, bits=bits).collect()], key=str) == brute(rows, n)


def test_whole_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in substrings.cut_repeats(documents).collect()], key=str) == brute(rows)


def test_odd_rows(spark, odd, nothing, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted([tuple(r) for r in substrings.cut_repeats(odd).collect()], key=str) == brute(rows)
    names = clashing.withColumns({n: F.lit(1) for n in ("t", "d", "spans", "w", "lo", "__t", "seen")})
    assert sorted([tuple(r) for r in substrings.cut_repeats(names).collect()], key=str) == brute(rows)
    found = substrings.cut_repeats(nothing)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and found.count() == 0


def test_paths_are_compact(spark):
    """Two copies of one passage in other surroundings are one path, not one row a window."""
    passage = " ".join(f"p{k}" for k in range(500))
    rows = [(k, " ".join(f"{k}x{j}" for j in range(30)) + " " + passage + " " + " ".join(f"{k}y{j}" for j in range(30))) for k in range(4)]
    docs = substrings._docs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    spans = [(r["pos"], r["len"], r["lo"]) for r in substrings.repeated_spans(docs, 13).collect()]
    assert spans == [(30, 488, 0)] * 4


def test_word_hashes_tell_words_apart():
    texts = [None, "", " a  b\tab ", "\x0bé\x0c", "x" * 3_000_000 + " a", "b"]
    words, of = substrings.word_hashes(pa.array(texts))
    assert of.tolist() == [2, 2, 2, 3, 4, 4, 5]
    assert words[0] == words[5] and words[1] == words[6] and len(np.unique(words)) == 5
    assert substrings.word_hashes(pa.array(texts).slice(2, 2))[0].tolist() == words[:4].tolist()


def test_shuffles_grow_with_the_input(spark, sf_dir, monkeypatch):
    """A task's share of a shuffle is bounded, and so is a row group of what is staged; the settings are as before afterwards."""
    from sigloom.llm import staging
    from sigloom.sources import staging as tables

    seen, given = [], substrings.stage
    monkeypatch.setattr(substrings, "stage", lambda df, label: (seen.append([int(spark.conf.get(f"spark.sql.{c}")) for c in ("shuffle.partitions", "adaptive.advisoryPartitionSizeInBytes")]), given(df, label))[1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(substrings, "enough_partitions", lambda df: staging.enough_partitions(df, 10_000))
    before = [spark.conf.get(f"spark.sql.{c}") for c in ("shuffle.partitions", "adaptive.advisoryPartitionSizeInBytes")]
    rows = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cut_repeats(docs).collect())
    assert [spark.conf.get(f"spark.sql.{c}") for c in ("shuffle.partitions", "adaptive.advisoryPartitionSizeInBytes")] == before
    assert seen and all(n > 10 and size == 20_000 for n, size in seen)
    assert rows == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))
    long = tables.stage(spark.range(4000, numPartitions=1).select(F.expr("transform(sequence(0, 1500), k -> xxhash64(id, k))").alias("v")), "long")
    import pyarrow.parquet as pq

    parts = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in long.inputFiles()]
    assert max(m.row_group(k).total_byte_size for m in parts for k in range(m.num_row_groups)) < 40 << 20
