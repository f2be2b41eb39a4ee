"""WARC derivatives: metadata and plain-text conversion records of captured responses."""

from __future__ import annotations

import re
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Elements before and after which a line ends.
BLOCKS = "p|br|div|h[1-6]|li|ul|ol|tr|table|title|article|nav|footer|head|body|html"
#: What is no text: unclosed constructs run to the end, so every pattern passes over a text once. A tag begins with < and a letter, / ! or ?.
HIDDEN = r"(?is)<(?:script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|!--.*?(?:-->|\z))"
BLOCK_TAG = rf"(?i)</?(?:{BLOCKS})\b[^>]*(?:>|\z)"
TAG = r"<[A-Za-z/!?][^>]*(?:>|\z)"
LINK_TAG = r"(?i)<a\s[^>]*"
TITLE = r"(?i)<title\b[^>]*(?:>|\z)([^<]*)"
#: A character reference between & and semicolon: decimal, hexadecimal or a name.
REFERENCE = "#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31}"
#: The letters of HTML 4's names and of &apos;; a no-break space is a space.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def urn(*parts: Column) -> Column:
    """A record id that only depends on its parts: the MD5 of them as a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def character(reference: str) -> str | None:
    """What a reference (without & and ;) stands for; None for unknown names, zero, surrogates and numbers beyond Unicode."""
    if reference[0] != "#":
        return ENTITIES.get(reference)
    code = int(reference[2:], 16) if reference[1] in "xX" else int(reference[1:])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)


HIDDEN_AT, BLOCK_TAG_AT, TAG_AT, REFERENCE_AT = (_compiled(p) for p in (HIDDEN, BLOCK_TAG, TAG, f"&({REFERENCE});"))


def visible(html: str) -> str:
    """A page's text: no scripts, styles, comments or tags; a line per block; character references as characters; no blank at a line's ends."""
    text = TAG_AT.sub("", BLOCK_TAG_AT.sub("\n", HIDDEN_AT.sub(" ", html)))
    if "&" in text:
        text = REFERENCE_AT.sub(lambda m: character(m[1]) or m[0], text)
    for blank in "\t\r\f":
        text = text.replace(blank, " ")
    for double, single in (("  ", " "), (" \n", "\n"), ("\n ", "\n"), ("\n\n", "\n")):
        while double in text:
            text = text.replace(double, single)
    return text.strip(" \n")


def html_text(html: Column) -> Column:
    """The ``visible`` text of a column of pages, null as empty."""

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([visible(p.as_py() or "") for p in pages], pa.string())

    return texts(html)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages: ``key``, ``record_id``, ``target_uri``, ``date``, ``http_headers``, ``payload``.

    A null page is an empty payload; a null url is a record without target URI. The record id is made of the page's id, url
    and digest, so repeated rows have the same one.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF))
    identity = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, url_col)]
    return pages.select(
        F.col(id_col).alias("key"), urn(F.lit("response"), *identity, digest(body)).alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), body.alias("payload")
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for every response: its metadata and its text.

    Columns: ``key``, ``record_type`` (metadata or conversion), ``record_id``, ``refers_to`` (the response's id), ``target_uri``, ``date``,
    ``source_digest`` (of the payload), ``source_headers``, ``content_type``, ``content``, ``content_length`` (bytes), ``block_digest``. The metadata
    record's fields name its conversion record, and both name the response. One narrow pass, no shuffle: a row never
    leaves its task. Null payloads count as empty and null headers stay null; the derivatives of repeated responses are repeated, with the same ids.
    Work grows with a page's length, however long it is and whatever is left unclosed in it. Other columns are not read, so
    their names cannot clash. An empty table gives no rows.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    texts = source.withColumns({"__text": html_text(payload), "__digest": digest(payload), "__conversion": urn(F.lit("conversion"), F.col("record_id")), "__metadata": urn(F.lit("metadata"), F.col("record_id"))})
    title = F.regexp_extract(payload, TITLE, 1)
    links = F.size(F.filter(F.regexp_extract_all(payload, F.lit(LINK_TAG), F.lit(0)), lambda tag: tag.rlike("(?i)href=")))
    fields = F.concat(
        *[F.lit("conversion-id: <"), F.col("__conversion"), F.lit(f">{CRLF}source-payload-digest: "), F.col("__digest"), F.lit(f"{CRLF}source-payload-length: "), F.octet_length(payload).cast("string")],
        *[F.lit(f"{CRLF}outlinks: "), links.cast("string"), F.lit(f"{CRLF}title: "), F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(CRLF)],
    )
    record = lambda kind, record_id, type_, content: F.struct(F.lit(kind).alias("record_type"), F.col(record_id).alias("record_id"), F.lit(type_).alias("content_type"), content.alias("content"))
    both = F.array(record("metadata", "__metadata", "application/warc-fields", fields), record("conversion", "__conversion", "text/plain; charset=utf-8", F.col("__text")))
    out = texts.select("key", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("__digest").alias("source_digest"), F.col("http_headers").alias("source_headers"), F.explode(both).alias("r"))
    return out.select("key", "r.record_type", "r.record_id", "refers_to", "target_uri", "date", "source_digest", "source_headers", "r.content_type", "r.content", F.octet_length("r.content").cast("long").alias("content_length"), digest(F.col("r.content")).alias("block_digest"))


def serialised(records: DataFrame) -> DataFrame:
    """(``value``): each record as WARC/1.1, without the two line ends that close it."""
    named = {"WARC-Type": "record_type", "WARC-Date": "date", "WARC-Target-URI": "target_uri", "Content-Type": "content_type", "WARC-Block-Digest": "block_digest", "WARC-Source-Payload-Digest": "source_digest"}
    lines = [F.concat(F.lit(f"{k}: "), F.regexp_replace(F.col(c), r"[\r\n]+", " ")) for k, c in named.items()]
    links = [F.concat(F.lit(f"{k}: <"), F.col(c), F.lit(">")) for k, c in (("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"))]
    kept = F.concat(F.lit("WARC-Source-Headers: "), F.regexp_replace(F.base64(F.col("source_headers").cast("binary")), r"\s", ""))
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *links, *lines, kept, F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")))
    return records.select(F.concat(head, F.lit(CRLF * 2), F.col("content")).alias("value"))


def write_warc(records: DataFrame, path: str, records_per_file: int = 50_000) -> None:
    """Gzipped WARC files: the text sink's line end is the pair of line ends that closes a record."""
    serialised(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(``headers`` map, ``content``) of every record; a file, as ``write_warc`` bounds it, is read by one task."""

    def run(batches):
        import gzip

        for batch in batches:
            for raw in batch.column(0):
                data, at, heads, bodies = gzip.decompress(raw.as_buffer()), 0, [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    head = dict(x.split(": ", 1) for x in data[at:end].decode().split(CRLF)[1:])
                    n = int(head["Content-Length"])
                    heads.append(list(head.items()))
                    bodies.append(data[end + 4 : end + 4 + n].decode())
                    at = end + 4 + n + 4
                    if len(heads) == 1000 or at >= len(data):
                        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(bodies)], ["headers", "content"])
                        heads, bodies = [], []

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "headers map<string,string>, content string")
