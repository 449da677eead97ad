"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives two records that point back to it by WARC-Refers-To: a
metadata record (application/warc-fields) with the source's status line, HTTP
headers, digest, title and links, and a conversion record (text/plain) with
the text of its page. Record ids are UUIDs made from the response's id, so a
rerun makes the same records. Everything is built-in expressions in one pass
over the responses, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
BLOCK_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
ENTITIES = [("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&euro;", "€"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")]
LINK = r"""(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""
QUOTES = r"""^["']|["']$"""
DATE = "2024-01-01T00:00:00Z"


def _unescaped(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def page_text(html: Column) -> Column:
    """The text of a page: a line for each block, no markup.

    Comments, scripts and styles go; one that isn't closed goes on to the end.
    """
    x = F.regexp_replace(html, UNSEEN, "")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCK_TAGS})\b[^<>]*>", "\n")
    x = _unescaped(F.regexp_replace(x, r"<[/!?a-zA-Z][^<>]*>", ""))
    x = F.regexp_replace(x, r"[ \t\f\r]+", " ")
    return F.btrim(F.regexp_replace(x, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def digest(h: Column) -> Column:
    """sha1: and a hexadecimal SHA-1 in base 32, as WARC writers have it."""
    groups = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def record_id(*parts) -> Column:
    return _uuid(F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])))


def _uuid(h: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of stored pages: record_id, target_uri, warc_date, http_header, body."""
    size = F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).cast("string")
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size)
    return pages.select(
        record_id("response", F.col(id_col), F.col(url_col)).alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), header.alias("http_header"), F.col(html_col).alias("body")
    )


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line breaks in it become spaces."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "))


def derivatives(source: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response.

    ``source`` has record_id, target_uri, warc_date, http_header and body; other
    columns are not looked at. The result has record_id, warc_type, refers_to,
    target_uri, content_type, content_length (bytes), block_digest, header (all
    WARC header lines) and block; ``serialized`` makes whole records of it.

    Defined cases: a null or empty body gives an empty conversion block and a
    metadata record with the digest of nothing. A null URI, date or HTTP header
    leaves out its lines; folded header lines are joined. Links are the href of
    ``a`` elements, quoted either way or not at all. A null record id leaves out WARC-Refers-To. Repeated
    responses give repeated records with the same ids. Pages of any length are
    converted whole. An empty table gives none.
    """
    body, sha = F.col("body"), F.col("sha")
    source = source.select("record_id", "target_uri", "warc_date", "http_header", F.coalesce("body", F.lit("")).alias("body"))
    source = source.withColumn("sha", F.sha1(F.encode("body", "UTF-8")))
    lines = F.split(F.regexp_replace("http_header", r"\r\n[ \t]+", " "), CRLF)  # folded lines are one
    named = F.transform(F.filter(lines, lambda x, i: (i > 0) & (x != "")), lambda x: F.concat(F.lit("http-header: "), x))
    title = F.nullif(F.trim(F.regexp_replace(_unescaped(F.regexp_extract(body, r"(?is)<title\b[^<>]*>(.*?)</title\s*>", 1)), r"\s+", " ")), F.lit(""))
    found = F.regexp_extract_all(body, F.lit(LINK), F.lit(1))
    links = F.transform(found, lambda u: F.concat(F.lit("outlink: "), F.regexp_replace(_unescaped(F.regexp_replace(u, QUOTES, "")), r"[\r\n]+", " ")))
    none = F.array().cast("array<string>")
    fields = F.concat(
        F.array_compact(F.array(_line("http-status-line", F.get(lines, F.lit(0))))),
        F.coalesce(named, none),
        F.array_compact(F.array(_line("payload-digest", digest(sha)), _line("title", title))),
        links,
    )
    base = source.select("record_id", "target_uri", "warc_date", F.array_join(F.transform(fields, lambda x: F.concat(x, F.lit(CRLF))), "").alias("meta"), page_text(body).alias("text"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("t"), F.lit("application/warc-fields").alias("c"), F.col("meta").alias("b")),
        F.struct(F.lit("conversion").alias("t"), F.lit("text/plain; charset=utf-8").alias("c"), F.col("text").alias("b")),
    )
    rows = base.select("record_id", "target_uri", "warc_date", F.explode(kinds).alias("k")).select("*", F.sha1(F.encode("k.b", "UTF-8")).alias("h"), F.md5(F.concat_ws("|", "k.t", "record_id")).alias("m"))
    rows = rows.select("*", digest(F.col("h")).alias("d"), F.octet_length("k.b").cast("long").alias("n"), _uuid(F.col("m")).alias("own"))
    own = F.col("own")
    header = F.array_compact(
        F.array(
            F.lit("WARC/1.1"),
            _line("WARC-Type", F.col("k.t")),
            _line("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
            _line("WARC-Refers-To", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
            _line("WARC-Target-URI", F.col("target_uri")),
            _line("WARC-Date", F.col("warc_date")),
            _line("WARC-Block-Digest", F.col("d")),
            _line("Content-Type", F.col("k.c")),
            _line("Content-Length", F.col("n").cast("string")),
        )
    )
    return rows.select(
        own.alias("record_id"), F.col("k.t").alias("warc_type"), F.col("record_id").alias("refers_to"), "target_uri", F.col("k.c").alias("content_type"),
        F.col("n").alias("content_length"), F.col("d").alias("block_digest"), F.array_join(header, CRLF).alias("header"), F.col("k.b").alias("block"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """One binary column: complete WARC records, ready to be concatenated."""
    return records.select(F.encode(F.concat("header", F.lit(CRLF * 2), "block", F.lit(CRLF * 2)), "UTF-8").alias("record"))


def _sql_unescaped(text: str) -> str:
    for name, char in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    return text


def _sql_digest(text: str) -> str:
    h = f"sha1({text})"
    return f"""'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((CAST('0x' || substr({h}, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '')"""


def _sql_id(text: str) -> str:
    h = f"md5({text})"
    return f"'urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


def sql() -> str:
    """``derivatives(responses(pages))`` in DuckDB's SQL."""
    text = "html"
    for pattern, by in ((UNSEEN, "''"), (rf"(?i)</?(?:{BLOCK_TAGS})\b[^<>]*>", "chr(10)"), (r"<[/!?a-zA-Z][^<>]*>", "''")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    text = _sql_unescaped(text)
    for pattern, by in ((r"[ \t\f\r]+", "' '"), (r" ?\n[ \n]*", "chr(10)")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    text = f"trim({text}, ' ' || chr(10))"
    title = f"nullif(trim(regexp_replace({_sql_unescaped(r"regexp_extract(html, '(?is)<title\b[^<>]*>(.*?)</title\s*>', 1)")}, '\\s+', ' ', 'g')), '')"
    nl = "chr(13) || chr(10)"
    link, quotes = (x.replace("'", "''") for x in (LINK, QUOTES))
    return rf"""
WITH r AS (
  SELECT {_sql_id("concat_ws('|', 'response', page_id, url)")} AS rid, url, coalesce(html, '') AS html FROM pages),
b AS (
  SELECT rid, url, {text} AS text,
    'http-status-line: HTTP/1.1 200 OK' || {nl} || 'http-header: Content-Type: text/html; charset=utf-8' || {nl}
    || 'http-header: Content-Length: ' || strlen(html) || {nl} || 'payload-digest: ' || {_sql_digest("html")} || {nl}
    || coalesce('title: ' || {title} || {nl}, '')
    || array_to_string(list_transform(regexp_extract_all(html, '{link}', 1),
         lambda u: 'outlink: ' || {_sql_unescaped(f"regexp_replace(u, '{quotes}', '', 'g')")} || {nl}), '') AS meta
  FROM r),
k AS (
  SELECT rid, url, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, meta AS block FROM b
  UNION ALL SELECT rid, url, 'conversion', 'text/plain; charset=utf-8', text FROM b),
d AS (
  SELECT *, {_sql_digest("block")} AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length,
    {_sql_id("warc_type || '|' || rid")} AS record_id FROM k)
SELECT record_id, warc_type, rid AS refers_to, url AS target_uri, content_type, content_length, block_digest,
  'WARC/1.1' || {nl} || 'WARC-Type: ' || warc_type || {nl} || 'WARC-Record-ID: <' || record_id || '>' || {nl}
  || 'WARC-Refers-To: <' || rid || '>' || {nl} || coalesce('WARC-Target-URI: ' || url || {nl}, '')
  || 'WARC-Date: {DATE}' || {nl} || 'WARC-Block-Digest: ' || block_digest || {nl}
  || 'Content-Type: ' || content_type || {nl} || 'Content-Length: ' || content_length AS header, block
FROM d"""
