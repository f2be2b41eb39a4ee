"""URL filter, language ID, WARC, packing, token output, sharding, mixing."""

import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, connect
from pyspark.sql import functions as F

from sigloom.llm import langid, mixing, packing, sharding, token_output, url_filter, warc
from sigloom.llm.queries import ORACLE_SQL, QUERIES, RULES, tokenizer_path
from sigloom.llm.tokens import BYTE_LETTERS, Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path(), kept_words=50)


def plain_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], connect(sf_dir))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abZ .,!?'\n\t\u00a0\u3000é１2-<|>_s\x1c")), max_size=40))
def test_encoder_equals_tokenizer(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain_ids(encoder, text)


def test_encoder_on_documents(encoder, documents, odd):
    for r in documents.unionByName(odd).select("text").collect():
        assert np.frombuffer(encoder.encode(r.text or ""), "<u4").tolist() == plain_ids(encoder, r.text)


def test_pieces_equal_the_model(encoder):
    """The rank-based encoder of single pieces against the BPE model: all tokens, and stretches of them, are pieces."""
    tokenizer, piece = encoder.tokenizer, encoder.words.piece
    bytes_of = {c: b for b, c in BYTE_LETTERS.items()}
    words = [w for w in (bytes(bytes_of[c] for c in token).decode("utf-8", "ignore") for token in tokenizer.get_vocab(False)) if w]
    random = np.random.default_rng(3)
    words += ["".join(words[k] for k in random.integers(0, len(words), n)) for n in (2, 3, 5) for _ in range(5000)]
    assert all(piece(w) == [t.id for t in tokenizer.model.tokenize("".join(BYTE_LETTERS[b] for b in w.encode()))] for w in words)


@pytest.mark.parametrize("line", ["word", "don't!", "a,b;12", "天地玄黄", "ながい文。", "x\n\ny", "é\r\nz"])
def test_encoder_on_many_lines_without_spaces(encoder, line):
    for text in ("\n".join([line] * 5000), " start " + "\n".join(f"{line}{k}" for k in range(5000)) + " end"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain_ids(encoder, text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_packing_patterns(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    used = Counter()
    for pattern, n in patterns.items():
        assert sum(pattern) <= 64 and n > 0 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            used[length] += n
    assert used == Counter(histogram)


def check_packing(encoder, docs, out):
    texts = Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    expected = Counter()
    for (doc, text), n in texts.items():
        ids = [*plain_ids(encoder, text), 0]
        for start in range(0, len(ids), 1024):
            part = np.array(ids[start : start + 1024], "<u4")
            expected[(doc, start, len(part), zlib.crc32(part.tobytes()), len(ids))] += n
    assert pieces == expected
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(r.length for r in out) / (1024 * len(sequences))


def test_packing_of_documents(encoder, documents):
    assert check_packing(encoder, documents, packing.pack_documents(documents, tokenizer_path()).collect()) > 0.97


def test_packing_of_odd_rows(encoder, odd, nothing, clashing):
    check_packing(encoder, odd, packing.pack_documents(odd, tokenizer_path()).collect())
    check_packing(encoder, odd, packing.pack_documents(clashing, tokenizer_path()).collect())
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(spark, size):
    def slots(key):
        return np.array([r.slot for r in token_output.feistel(spark.range(size), "id", size, key, "slot").orderBy("id").collect()])

    assert sorted(slots(99).tolist()) == list(range(size))
    assert size < 100 or (slots(99) != slots(100)).mean() > 0.9
    assert size < 100 or abs(np.corrcoef(slots(99), np.arange(size))[0, 1]) < 0.1


@pytest.mark.parametrize("which", ["documents", "odd", "clashing", "nothing"])
def test_token_shards_round_trip(spark, encoder, request, tmp_path, which):
    docs = request.getfixturevalue(which)
    path = str(tmp_path / "shards")
    index = token_output.materialise(docs, path, tokenizer_path(), 5, room=256, per_shard=8, rounds=3).collect()
    if which == "nothing":
        assert index == []
        return
    slots = sorted({r.slot for r in index})
    assert slots == list(range(len(slots))) and all(r.shard == r.slot // 8 and r.record == r.slot % 8 for r in index)
    files = sorted((tmp_path / "shards").glob("shard=*/part-*"))
    assert len(files) == -(-len(slots) // 8) and all(f.stat().st_size == 8 * 513 for f in sorted(files, key=lambda f: int(f.parent.name[6:]))[:-1])
    stored = {r.slot: np.frombuffer(r.ids, "<u2") for r in token_output.read_shards(spark, path, 256, 0, 8).collect()}
    assert sorted(stored) == slots
    got = Counter()
    parts = {}
    for r in index:
        part = stored[r.slot][r.offset : r.offset + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        parts.setdefault(r.doc_id, []).append((r.start, part.tolist()))
        got[r.doc_id] += r.length
    wanted = Counter()
    for r in docs.select("doc_id", "text").collect():
        wanted[r.doc_id] += len(plain_ids(encoder, r.text)) + 1
    assert got == wanted
    for doc, text in {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.doc_id != 5}.items():
        assert [t for _, p in sorted(parts[doc]) for t in p] == [*plain_ids(encoder, text), 0]
    later = token_output.read_shards(spark, path, 256, slots[-1], 8).collect()
    assert [r.slot for r in later] == [slots[-1]]


def check_shards(docs, out, shards):
    assert len(out) == docs.count() and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == expected
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return {s: sum(r["size"] for r in held) for s, held in by.items()}


def test_sharding_is_even_and_keeps_copies_together(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shard_documents(docs, 8).collect()
    sizes = check_shards(docs, out, 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    groups = {}
    for r in out:
        groups.setdefault((r.text_crc32, r["size"]), []).append(r.shard)
    pairs = [(len(v), Counter(v).most_common(1)[0][1]) for v in groups.values() if len(v) > 1]
    assert sum(b for _, b in pairs) / sum(a for a, _ in pairs) > 0.9


def test_sharding_of_odd_rows(spark, odd, nothing, clashing):
    check_shards(odd, sharding.shard_documents(odd, 4).collect(), 4)
    check_shards(odd, sharding.shard_documents(clashing, 4).collect(), 4)
    assert sharding.shard_documents(nothing).count() == 0


def test_a_hot_group_of_copies_is_split(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "copy of one text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = check_shards(df, sharding.shard_documents(df, 6).collect(), 6)
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 6


def test_mixing_of_odd_rows(odd, nothing, clashing):
    size = mixing.word_count(F.col("text"))
    out = mixing.mix(odd, size).collect()
    assert len(out) == odd.count() and all(0 <= r.copies <= 2 for r in out)
    total = sum(r["size"] for r in out)
    targets = {r.source: (r.source_size, r.target) for r in out}
    assert abs(sum(t for _, t in targets.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in targets.values())
    again = mixing.mix(clashing, size).select(*clashing.columns[:5], "size", "source_size", "target", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(odd, size).select(*odd.columns, "size", "source_size", "target", "copies").collect())
    assert mixing.mix(nothing, size).count() == 0
    emitted = mixing.emit_copies(mixing.mix(clashing, size), odd.columns)
    assert emitted.count() == sum(r.copies for r in out)


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000), ("c", 0)], "source string, source_size long")
    out = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    # Weights a 5, b 2, c 1, null 5: a and c stop at 20 and 0, null at 2000; b takes the rest.
    assert out == {"a": 20.0, "c": 0.0, None: 2000.0, "b": pytest.approx(3015.0 - 2020.0)}


def test_taken_words_are_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), mixing.word_count(F.col("text")))
    for r in mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("w")).collect():
        assert abs(r.w - r.t) < 0.05 * r.t


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = langid.identify(docs.sample(0.3, seed=1)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_of_odd_rows(odd, nothing, clashing, documents):
    out = langid.identify(odd.unionByName(documents.limit(150).withColumn("doc_id", F.col("doc_id") + 1000)))
    by = {r.doc_id: r for r in out.collect()}
    for doc in (1, 2, 3, 10):
        assert (by[doc].lang_pred, by[doc].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in by.values()) and by[None].held_out
    assert all(r.held_out == (d is None or zlib.crc32(str(d).encode()) % 5 == 0) for d, r in by.items())
    assert langid.identify(nothing).count() == 0
    unlabelled = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    model = langid.fit(documents)
    kept = langid.keep_identified(clashing, model, 0.0)
    assert kept.columns == clashing.columns and not {1, 2, 3, 10} & {r.doc_id for r in kept.collect()}


def test_kernel_matches_a_plain_one():
    s = langid.Settings(slot_bits=18, orders=(1, 2))
    a, b = "abcab", "bcd"
    grams = lambda t: {t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)}
    p = langid.presence([a, b], s)
    assert p.sum(1).tolist() == [len(grams(a)), len(grams(b))] and p[0] @ p[1] == len(grams(a) & grams(b))
    text = "xyz" * 1000
    row, blocks = np.zeros(1 << 18), np.zeros(1 << 18)
    langid.mark(text, row, s)
    langid.mark(text, blocks, s, block=7)
    assert (row == blocks).all()


URLS = [
    ("http://WWW.Example.com/en/x", "allow", "www.example.com/en/"), ("https://example.com/en/x?q#f", "block", "example.com/en/"), ("http://a.example.com/en", "allow", "com/"), ("http://x.net/es/1", "block", "net/es/"),
    ("http://x.net/es", "allow", None), ("http://net/fr/", "block", "net/fr/"), ("http://listed.org/a?utm_source=x", "block", None), ("http://other.org/a", "allow", None), ("http://com", "allow", None), (None, "allow", None), ("nothing", "allow", None), ("http://", "allow", None), ("a://b.com/://c.net/es/", "allow", "com/"),
]


@pytest.mark.parametrize("broadcast_bytes", [10_000, 0])
def test_url_rules(spark, broadcast_bytes):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(URLS)] + [(1, URLS[1][0]), (None, URLS[3][0])], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "rule", "keys", "h", "id")})
    listed = spark.createDataFrame([("listed.org/a",), ("listed.org/a",), (None,)], "url string")
    out = url_filter.judge_urls(df, RULES, listed, broadcast_bytes=broadcast_bytes).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        if r.page_id is not None:
            assert (r.verdict, r.rule) == URLS[r.page_id][1:], URLS[r.page_id]
    assert {(r.host, r.path) for r in out if r.page_id in (9, 10)} == {("", "")}
    assert url_filter.judge_urls(df.limit(0), RULES, listed).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    for size in (64, 1 << 20):
        table = url_filter.build_filter(keys, 16, size)
        probed = spark.range(10000).select("id", F.array(F.xxhash64(F.concat(F.lit("k"), "id"))).alias("h"))
        places = url_filter.probe(probed, table)
        hits = probed.withColumn("at", places("h", F.transform("h", lambda x: F.xxhash64(x)))).filter(F.size("at") > 0)
        assert hits.filter("id < 5000").count() == 5000
        assert size == 64 or hits.filter("id >= 5000").count() < 50


def test_warc_round_trip(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").unionByName(spark.createDataFrame([(None, None, None), (-1, "http://x/\r\ny", "<p>a &amp; b<script>z</script></p>\r\n\r\nWARC/1.1")], "page_id long, url string, html string"))
    records = warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z"))
    warc.write_warc(records, str(tmp_path / "warc"), 20)
    back = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    expected = {r.record_id: r for r in records.collect()}
    assert len(back) == 2 * pages.count()
    for r in back:
        source = expected[r.headers["WARC-Record-ID"].strip("<>")]
        assert r.content == source.content and int(r.headers["Content-Length"]) == source.content_length
        assert r.headers["WARC-Refers-To"].strip("<>") == source.refers_to and r.headers["WARC-Block-Digest"] == source.block_digest
    odd = [r for r in expected.values() if r.key == -1 and r.record_type == "conversion"]
    assert odd[0].content == "a & b \nWARC/1.1" or odd[0].content.startswith("a & b")
    assert warc.derive(warc.responses(pages.limit(0), "x")).count() == 0


@pytest.mark.parametrize("unit", ["<!--", "<", "<a ", "<title", "<script>", "<p ", "&", "&#", " \n", "</script "])
def test_text_of_long_unclosed_pages_is_linear(spark, unit):
    pages = spark.createDataFrame([(1, "http://x/", unit * (5_000_000 // len(unit)))], "page_id long, url string, html string")
    started = time.time()
    assert warc.derive(warc.responses(pages, "x")).agg(F.sum("content_length")).first()[0] > 0
    assert time.time() - started < 20


def test_text_of_odd_pages(spark):
    cases = {
        "a &lt;b&gt; &amp;lt; &eacute;&#233;&#xE9;&#x1F600; &nosuch; &#0; &#xD800; &#99999999; & &amp": "a <b> &lt; ééé😀 &nosuch; &#0; &#xD800; &#99999999; & &amp",
        "1 < 2 <b>bold</b> <3": "1 < 2 bold <3",
        "<p>one<p>two<br/>three<!-- gone": "one\ntwo\nthree",
        "x<script>if (a < b) {}": "x",
        "<style>p</style >y<SCRIPT src=z>w</SCRIPT\n>q": "y q",
        "": "", None: "",
    }
    pages = spark.createDataFrame([(k, None, html) for k, html in enumerate(cases)], "page_id long, url string, html string")
    clash = pages.withColumns({n: F.lit(7) for n in ("key", "payload", "record_id", "__text", "__digest", "content", "date")})
    for table in (pages, clash):
        rows = warc.derive(warc.responses(table, "x")).filter("record_type = 'conversion'").collect()
        assert {r.key: r.content for r in rows} == dict(enumerate(cases.values()))
        assert len({r.refers_to for r in rows}) == len(cases)


def test_metadata_counts_links_and_finds_titles(spark):
    html = "<title lang=en> A\n title </title><a href=x>1</a><A class=y HREF='z'>2</a><a name=q>3</a><abbr href=w><a href=open"
    rows = warc.derive(warc.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), "x")).filter("record_type = 'metadata'").collect()
    assert "outlinks: 3\r\n" in rows[0].content and "title: A title\r\n" in rows[0].content


def test_urls_of_many_labels_and_repeats(spark):
    long = "http://" + "a." * 100_000 + "net/es/x"
    df = spark.createDataFrame([(1, long), (2, long), (2, long), (None, "http://a.com/"), (None, "http://a.com/"), (3, None)], "page_id long, url string").withColumns({n: F.lit(7) for n in ("host", "row", "keys", "verdict")})
    listed = spark.createDataFrame([("b.org",), (None,), ("b.org",)], "url string")
    started = time.time()
    out = url_filter.judge_urls(df, RULES, listed).collect()
    assert time.time() - started < 30
    assert Counter((r.page_id, r.rule, r.verdict) for r in out) == {(1, "net/es/", "block"): 1, (2, "net/es/", "block"): 2, (None, "com/", "allow"): 2, (3, None, "allow"): 1}


def test_all_languages_are_learned(spark):
    r = np.random.default_rng(5)
    letters = {k: [chr(0x4E00 + 50 * k + j) for j in range(40)] for k in range(300)}
    rows = [(40 * k + j, "".join(r.choice(letters[k], 80)), f"l{k:03}") for k in range(300) for j in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Settings(sample=600, landmarks=300))
    assert len(model.labels) == len({lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5})


def test_regression_equals_plain_ridge(spark, documents):
    """With every row of the sample a landmark, the Nyström space holds the kernel itself: scores are those of ridge regression on unit presence vectors."""
    chosen = langid.Settings(slot_bits=9, sample=80, landmarks=80, ridge=1e-2)
    model = langid.fit(documents, chosen)
    sample = langid.sample_rows(documents, chosen, "doc_id", "text", "lang").collect()
    x = langid.presence([s.text for s in sample], chosen, np.float64)
    x /= np.sqrt(x.sum(1, keepdims=True))
    y = np.eye(len(model.labels))[[model.labels.index(s.lang) for s in sample]]
    centred = x - x.mean(0)
    beta = np.linalg.solve(centred.T @ centred + 1e-2 * len(x) * np.eye(x.shape[1]), centred.T @ (y - y.mean(0)))
    fresh = langid.presence([d.text for d in documents.filter("text IS NOT NULL").limit(200).collect()], chosen, np.float64)
    wanted = (fresh / np.sqrt(np.maximum(fresh.sum(1, keepdims=True), 1)) - x.mean(0)) @ beta + y.mean(0)
    assert np.abs(model.scores(fresh.astype(np.float32)) - wanted).max() < 2e-3
