"""The thin queries of the ten operators, with production settings, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import conversations, exact_dedup, langid, mixing, packing, sharding, simhash, spelling, substrings, token_output, topk, url_filter, warc

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
WARC_DATE = "2024-01-01T00:00:00Z"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def refetched(pages: DataFrame) -> DataFrame:
    """The list that the query's filter holds: canonical URLs that more than one page has."""
    return pages.select(url_filter.canonical(F.col("url")).alias("url")).groupBy("url").agg(F.count("*").alias("n")).filter("n > 1").select("url")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, RULES, refetched(pages))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_read(spark, sf_dir, "pages"), WARC_DATE)).withColumnRenamed("key", "page_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), mixing.word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    summary, repaired = conversations.repair(conversations.damage(rows))
    every = rows.select("conv_id").distinct().withColumn("__c", conversations.key("conv_id"))
    found = every.join(summary, F.col("__c") == F.col("c"), "left").drop("c")
    found = found.join(conversations.digests(repaired), F.col("__c") == F.col("c"), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(_read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_warc_derivatives, op4_simhash, op5_topk, op6_packing, op7_token_output, op8_exact_dedup, op9_sharding, op10_mixing, op11_conversation_repair, op12_substring_dedup, op13_spelling_variants)}

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

_NAMES_SQL = "MAP {" + ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in warc.ENTITIES.items()) + "}"


def _urn_sql(kind: str, of: str) -> str:
    h = f"md5('{kind}' || '|' || {of})"
    return f"'urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12)"


#: CRC-32 by its table, for strings ``s``: ``t`` is the table's list in the query.
_CRC_TABLE_SQL = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"


def _crc_sql(s: str) -> str:
    octets = f"list_transform(range(0, strlen({s})), lambda i: CAST('0x' || substr(hex({s}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _least_sql(*ways: tuple[str, int, str]) -> str:
    """The least of (state, cost, edit): a state is its cost in ten digits and its audit."""
    return "least(" + ", ".join(f"printf('%010d', CAST(substr({s}, 1, 10) AS BIGINT) + {cost}) || substr({s}, 11) || '{edit}'" if edit else s for s, cost, edit in ways) + ")"


_MORE = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"


def _step_sql(state: int, keeps: list[str], reroles: list[str]) -> str:
    ways = [_least_sql((f"w{state}", 2, "D"))]
    ways += [f"CASE WHEN sound {k} END" for k in keeps] + [f"CASE WHEN sound THEN {_least_sql((r, f'1 + {_MORE}', 'R'))} END" for r in reroles]
    return f"least({', '.join(ways)}) AS v{state}"


def _keep_sql(role: str, state: str) -> str:
    return f"AND initial = '{role}' THEN {_least_sql((state, _MORE, 'K'))}"


ORACLE_SQL = {
    "op1_url_filter": rf"""
        WITH parts AS (
            SELECT page_id, url,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query
            FROM pages),
        named AS (
            SELECT *, regexp_replace(host, '^(www|m)\.|:(80|443)$', '', 'g') || regexp_replace(path, '/$', '')
                   || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') AS canonical
            FROM parts),
        listed AS (SELECT canonical AS entry FROM named WHERE url IS NOT NULL GROUP BY canonical HAVING count(*) > 1),
        rules(v, h, p) AS (VALUES {_RULE_ROWS}),
        fits AS (
            SELECT DISTINCT host, path, first(h || p ORDER BY length(h || p) DESC, length(h) DESC) OVER w AS rule, first(v ORDER BY length(h || p) DESC, length(h) DESC) OVER w AS v
            FROM (SELECT DISTINCT host, path FROM named) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            WINDOW w AS (PARTITION BY host, path))
        SELECT page_id, named.host AS host, named.path AS path, rule,
               coalesce(v, CASE WHEN named.host <> '' AND entry IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM named LEFT JOIN fits ON named.host = fits.host AND named.path = fits.path LEFT JOIN listed ON canonical = entry""",
    "op3_warc_derivatives": rf"""
        WITH a AS (
            SELECT page_id, url, coalesce(html, '') AS body, coalesce(CAST(page_id AS VARCHAR), '') AS k, coalesce(url, '') AS u FROM pages),
        b AS (
            SELECT *, 'sha256:' || sha256(body) AS d, strlen(body) AS n, {_urn_sql('response', "k || '|' || u || '|' || 'sha256:' || sha256(body)")} AS rid,
                   regexp_replace(body, '{warc.HIDDEN}', ' ', 'g') AS t1 FROM a),
        c AS (SELECT *, string_split(regexp_replace(regexp_replace(t1, '{warc.BLOCK_TAG}', chr(10), 'g'), '{warc.TAG}', '', 'g'), '&') AS pieces FROM b),
        names AS MATERIALIZED (SELECT {_NAMES_SQL} AS m),
        named AS (SELECT c.*, list_transform(pieces[2:], lambda p: {{'p': p, 'n': regexp_extract(p, '^({warc.REFERENCE});', 1)}}) AS refs FROM c),
        coded AS (SELECT named.*, list_transform(refs, lambda r: {{'p': r.p, 'n': r.n, 'rest': substr(r.p, length(r.n) + 2), 'code': CASE
                         WHEN regexp_matches(r.n, '^#[xX]') THEN TRY_CAST('0x' || substr(r.n, 3) AS INTEGER) WHEN starts_with(r.n, '#') THEN TRY_CAST(substr(r.n, 2) AS INTEGER) END}}) AS refs2 FROM named),
        t AS (SELECT coded.*, pieces[1] || coalesce(array_to_string(list_transform(refs2, lambda r: coalesce(CASE WHEN r.n = '' THEN NULL
                         WHEN r.code > 0 AND r.code < 1114112 AND NOT r.code BETWEEN 55296 AND 57343 THEN chr(r.code) || r.rest ELSE m[r.n] || r.rest END, '&' || r.p)), ''), '') AS t3 FROM coded, names),
        e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t3, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS txt,
                   {_urn_sql('conversion', 'rid')} AS cid, {_urn_sql('metadata', 'rid')} AS mid FROM t),
        f AS (
            SELECT page_id, 'metadata' AS record_type, mid AS record_id, rid, url, d, n, 'application/warc-fields' AS content_type,
                   'conversion-id: <' || cid || '>' || chr(13) || chr(10) || 'source-payload-digest: ' || d || chr(13) || chr(10) || 'source-payload-length: ' || n || chr(13) || chr(10)
                   || 'outlinks: ' || len(list_filter(regexp_extract_all(body, '{warc.LINK_TAG}'), lambda x: regexp_matches(x, '(?i)href='))) || chr(13) || chr(10)
                   || 'title: ' || trim(regexp_replace(regexp_extract(body, '{warc.TITLE}', 1), '\s+', ' ', 'g')) || chr(13) || chr(10) AS content FROM e
            UNION ALL SELECT page_id, 'conversion', cid, rid, url, d, n, 'text/plain; charset=utf-8', txt FROM e)
        SELECT page_id, record_type, record_id, rid AS refers_to, url AS target_uri, '{WARC_DATE}' AS "date", d AS source_digest,
               'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || n || chr(13) || chr(10) AS source_headers,
               content_type, content, CAST(strlen(content) AS BIGINT) AS content_length, 'sha256:' || sha256(content) AS block_digest FROM f""",
    "op5_topk": """
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.k AS k, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.k <> c.k),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        b AS (SELECT *, length(bin(size)) * 8 + list_sum(list_transform(range(1, least(length(bin(size)), 3) + 1), lambda i: CAST(bin(size)[i] AS INTEGER) * (1 << (least(length(bin(size)), 3) - i)))) AS band FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS lim FROM s),
        l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(lim) OVER p, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0.0::DOUBLE)) AS level
              FROM w WINDOW p AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, coalesce(least(lim, max(CASE WHEN level <= lim / w THEN level END) OVER () * w), lim) AS target FROM l),
        r AS (SELECT b.*, source_size, target, row_number() OVER (PARTITION BY b.source ORDER BY band, h, doc_id NULLS FIRST, size) - 1 AS i,
                     CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e
              FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(floor((i + 1) * e + 0.381966::DOUBLE) - floor(i * e + 0.381966::DOUBLE) AS BIGINT) * size AS taken FROM r""",
    "op12_substring_dedup": rf"""
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, -9223372036854775808) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT k, o, w, unnest(range(1, len(w) - {substrings.WORDS - 2})) AS i FROM d WHERE len(w) >= {substrings.WORDS}),
        win AS MATERIALIZED (SELECT k, o, i, array_to_string(w[i:i + {substrings.WORDS - 1}], ' ') AS s FROM p),
        first AS (SELECT s, min(o) AS lo FROM win GROUP BY s),
        gone AS (SELECT DISTINCT k, unnest(range(i, i + {substrings.WORDS})) AS i FROM win JOIN first USING (s) WHERE lo < o),
        words AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (k, i) GROUP BY k),
        n AS (SELECT k, count(*) AS n FROM gone GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN n USING (k) LEFT JOIN kept USING (k)""",
    "op11_conversation_repair": rf"""
        WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE_SQL}),
        r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        f AS (SELECT r.*, {_crc_sql("k")} % 20 AS kind FROM r, crc),
        d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE kind <> 0),
        g AS (SELECT *, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS digest, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS visible, substr(role, 1, 1) AS initial FROM d),
        n AS (SELECT *, row_number() OVER w AS i, lag(initial) OVER w AS before, row_number() OVER (PARTITION BY conv_id, digest ORDER BY turn NULLS FIRST, copy) > 1 AS again
              FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, copy)),
        t AS MATERIALIZED (SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS c, CASE WHEN visible = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN visible NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM n),
        walk AS (
            SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, '0000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM t
            UNION ALL
            SELECT c, i, {_step_sql(0, [], [])}, {_step_sql(1, [_keep_sql("s", "w0")], [])},
                   {_step_sql(2, [_keep_sql("u", s) for s in ("w0", "w1", "w3")], ["w0", "w1", "w3"])}, {_step_sql(3, [_keep_sql("a", "w2")], ["w2"])}
            FROM (SELECT *, {_least_sql(("v3", 0, ""), ("w2", 5, "I"))} AS w3 FROM (
                SELECT w.c, t.i, fault, fault IS NULL OR fault = 'truncated' AS sound, initial, v0 AS w0, v1 AS w1, v3, {_least_sql(("v2", 0, ""), ("v0", 5, "I"), ("v1", 5, "I"), ("v3", 5, "I"))} AS w2
                FROM walk w JOIN t ON w.c = t.c AND t.i = w.i + 1))),
        last AS (SELECT c, arg_max({_least_sql(("v0", 0, ""), ("v3", 0, ""), ("v2", 5, "I"), ("v1", 10, "II"))}, i) AS v FROM walk GROUP BY c),
        told AS (SELECT c, CAST(substr(v, 1, 10) AS BIGINT) AS cost, substr(v, 11) AS audit FROM last),
        edits AS (SELECT c, audit, p, audit[p] AS e, CAST(length(replace(audit[1:p], 'I', '')) AS BIGINT) AS i FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS p FROM told)),
        made AS (SELECT e.c, p, e, role, text, row_number() OVER (PARTITION BY e.c ORDER BY p) AS k, first(CASE WHEN e.e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.c ORDER BY p) AS s
                 FROM edits e LEFT JOIN t ON e.c = t.c AND e.i = t.i AND e.e <> 'I' WHERE e.e <> 'D'),
        lines AS (SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS x FROM made GROUP BY c),
        counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                          count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY c)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(x, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS c FROM conversations) LEFT JOIN counts USING (c) LEFT JOIN told USING (c) LEFT JOIN lines USING (c)""",
    "op13_spelling_variants": rf"""
        WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE_SQL}),
        r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        h AS (SELECT run, id || ':' || run AS k, {_crc_sql("id || ':' || run")} AS h FROM r, crc WHERE length(run) >= 7),
        w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
        s AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
        p AS (SELECT a.word, b.word AS other FROM s a JOIN s b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
              UNION SELECT s.word, w.word FROM s JOIN w ON s.s = w.word UNION SELECT w.word, s.word FROM s JOIN w ON s.s = w.word),
        near AS (SELECT p.word, count(*) AS n_near, max(w.n) AS most, min(CASE WHEN w.n = m.most THEN other END) AS best
                 FROM p JOIN w ON w.word = other JOIN (SELECT p.word, max(w.n) AS most FROM p JOIN w ON w.word = other GROUP BY p.word) m ON m.word = p.word GROUP BY p.word),
        f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN best END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM w LEFT JOIN near ON near.word = w.word),
        way AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL),
        ends AS (SELECT way.word, root FROM way JOIN f ON f.word = way.root WHERE f.form IS NULL)
        SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends ON ends.word = f.word""",
}
