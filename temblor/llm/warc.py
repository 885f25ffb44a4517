"""Operator 4: WARC derivative builder.

Each response record gives two records: ``metadata`` (title, language, link and
text counts and the source's HTTP headers, as warc-fields) and ``conversion``
(plain text).  Both name the response in WARC-Refers-To, with its target URI and date,
and carry the source's payload digest; the metadata record is concurrent to the
conversion.  Record identifiers are made from the response's identifier, so that a
rerun after a lost executor gives the same records.

One map over the responses, without a shuffle; both records come from one pass
over the page.

Defined results: a null block counts as empty, a null target URI as ""; a
response without an end of its HTTP headers is all body; repeated responses give repeated
records; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|body|head|blockquote|pre|hr|td|th)\b[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def uuid_of(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def sha256(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    text = F.regexp_replace(decoded(text), r"[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages: page_id, record_id, target_uri, date, block (HTTP headers and body), payload_digest."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select("page_id", uuid_of(F.lit("response"), page, url).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), F.concat(head, html).alias("block"), sha256(html).alias("payload_digest"))


def derive(source: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records of response records (record_id, target_uri, date, block, payload_digest), with the ``keep`` columns."""
    block = F.coalesce(F.col("block").cast("string"), F.lit(""))
    end = F.instr(block, CRLF * 2)
    rows = source.select(*keep, "record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), "date", "payload_digest", F.when(end > 0, F.substring(block, F.lit(1), end - 1)).otherwise("").alias("http"), F.when(end > 0, F.substring(block, end + 4, F.length(block))).otherwise(block).alias("body"))
    title = F.regexp_extract("body", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    rows = rows.select(
        *keep, "record_id", "target_uri", "date", "payload_digest", "http",
        plain_text(F.col("body")).alias("text"),
        F.btrim(F.regexp_replace(decoded(title), r"\s+", " ")).alias("title"),
        F.regexp_extract("body", r"(?i)<html\b[^>]*\blang=[\"']?([A-Za-z-]+)", 1).alias("lang"),
        F.regexp_count("body", F.lit(r"(?i)<a\s[^>]*href=")).alias("links"),
        uuid_of(F.lit("metadata"), F.col("record_id")).alias("metadata_id"),
        uuid_of(F.lit("conversion"), F.col("record_id")).alias("conversion_id"),
    )
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    # The source's HTTP headers, each under its own name with a prefix.
    headers = F.when(F.col("http") == "", "").otherwise(F.concat(F.lit("http-status: "), F.replace("http", F.lit(CRLF), F.lit(f"{CRLF}http-header-")), F.lit(CRLF)))
    about = F.concat(field("title", F.col("title")), field("lang", F.col("lang")), field("links", F.col("links")), field("text-length", F.length("text")), headers)
    record = lambda kind, record_id, concurrent, content_type, body: F.struct(F.lit(kind).alias("warc_type"), record_id.alias("record_id"), concurrent.alias("concurrent_to"), F.lit(content_type).alias("content_type"), body.alias("block"))
    both = F.array(
        record("metadata", F.col("metadata_id"), F.col("conversion_id"), "application/warc-fields", about),
        record("conversion", F.col("conversion_id"), F.lit(None).cast("string"), "text/plain; charset=utf-8", F.col("text")),
    )
    out = rows.select(*keep, F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.inline(both))
    return out.select(*keep, "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", F.octet_length("block").cast("long").alias("content_length"), sha256(F.col("block")).alias("block_digest"), "payload_digest", "block")


def header(records: DataFrame) -> Column:
    """A derivative record's WARC header."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit(""))
    c = records
    return F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", c["warc_type"]), line("WARC-Record-ID", c["record_id"]), line("WARC-Date", c["date"]), line("WARC-Target-URI", c["target_uri"]),
        line("WARC-Refers-To", c["refers_to"]), line("WARC-Refers-To-Target-URI", c["target_uri"]), line("WARC-Refers-To-Date", c["date"]), line("WARC-Concurrent-To", c["concurrent_to"]),
        line("WARC-Source-Payload-Digest", c["payload_digest"]), line("WARC-Block-Digest", c["block_digest"]), line("Content-Type", c["content_type"]), line("Content-Length", c["content_length"].cast("string")),
    )


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one for each partition."""
    records.select(F.concat(header(records), F.lit(CRLF * 2), F.col("block"))).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: headers (map, lower-case names) and block; a file is one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                raw = gzip.decompress(raw) if name.endswith(".gz") else raw
                at, heads, blocks = 0, [], []
                while (end := raw.find(b"\r\n\r\n", at)) >= 0:
                    lines = raw[at:end].decode("utf-8", "replace").split(CRLF)
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                    size = int(fields.get("content-length", 0))
                    heads.append(list(fields.items()))
                    blocks.append(raw[end + 4 : end + 4 + size].decode("utf-8", "replace"))
                    at = end + 4 + size + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.string())], names=["headers", "block"])

    return files.mapInArrow(parse, "headers map<string,string>, block string")


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages
), r AS (
  SELECT *, md5(concat_ws('|', 'response', coalesce(CAST(page_id AS VARCHAR), ''), target_uri)) AS h FROM p
), s AS (
  SELECT *, concat('<urn:uuid:', h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32], '>') AS refers_to FROM r
), t AS (
  SELECT *, md5(concat_ws('|', 'metadata', refers_to)) AS m, md5(concat_ws('|', 'conversion', refers_to)) AS c,
    regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g') AS title,
    regexp_extract(html, '(?i)<html\b[^>]*\blang=["'']?([A-Za-z-]+)', 1) AS lang,
    len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS links,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>', ' ', 'g'),
      '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|body|head|blockquote|pre|hr|td|th)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS bare
  FROM s
), u AS (
  SELECT *, concat('<urn:uuid:', m[1:8], '-', m[9:12], '-', m[13:16], '-', m[17:20], '-', m[21:32], '>') AS metadata_id,
    concat('<urn:uuid:', c[1:8], '-', c[9:12], '-', c[13:16], '-', c[17:20], '-', c[21:32], '>') AS conversion_id,
    trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(bare, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
      '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text
  FROM t
), v AS (
  SELECT *, concat('title: ', trim(title), chr(13), chr(10), 'lang: ', lang, chr(13), chr(10), 'links: ', links, chr(13), chr(10), 'text-length: ', length(text), chr(13), chr(10),
    'http-status: HTTP/1.1 200 OK', chr(13), chr(10), 'http-header-Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'http-header-Content-Length: ', strlen(html), chr(13), chr(10)) AS about
  FROM u
), w AS (
  SELECT page_id, 'metadata' AS warc_type, metadata_id AS record_id, refers_to, conversion_id AS concurrent_to, target_uri, 'application/warc-fields' AS content_type, about AS block, html FROM v
  UNION ALL
  SELECT page_id, 'conversion', conversion_id, refers_to, NULL, target_uri, 'text/plain; charset=utf-8', text, html FROM v
)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, '2024-01-01T00:00:00Z' AS date, content_type, strlen(block) AS content_length,
  'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(html) AS payload_digest, block
FROM w
"""
