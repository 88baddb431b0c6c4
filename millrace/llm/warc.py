"""WARC derivative builder: response records to linked metadata and plain-text conversion records.

``responses`` wraps crawled pages as response records, ``derive`` turns every response into two records
that name it in WARC-Refers-To, and ``write_warc`` writes records as gzipped WARC files. The metadata block
keeps the source's status line, all of its HTTP headers and its payload digest, and names its conversion;
the conversion block is the page's text. Identifiers derive from the source's, so reruns agree.

Nothing is shuffled. A page is read once from left to right (``read_page``), a slice of pages at a time; every search goes on from where
the last one ended, so the time follows the page's length whatever it holds. Digests and records are made in the JVM.

Text: comments, scripts and styles are left out, to the end of the page if they don't end; a tag ends at the first ``>`` outside of quoted
values, and what looks like a tag without an end is text. All HTML5 character references are decoded, with Python's table; decoded white
space is a space. Outlinks are the ``href`` values of ``a`` tags, in double quotes, single quotes or none.

Defined cases: null html is an empty payload, and an empty text gives an empty conversion block; a null url
becomes ``urn:page:<page_id>``, a null page_id reads ``null``; line breaks inside urls are percent-encoded and
in links and titles turned into spaces, so no value can open a header of its own; repeated rows give repeated
records with the same identifiers; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .wordhash import slices

DATE = "2024-01-01T00:00:00Z"

# Tags that end a line of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main nav ol option p pre section table td th title tr ul".split()
)

OPENING = re.compile(r"<(?:!--|/?([A-Za-z][^\x20\t\r\n/>]*)|[!?/])")
QUOTED = re.compile(r"=[\x20\t\r\n\x0C]*([\"'])")
HREF = re.compile(r"""[\x20\t\r\n\x0C"'/]href[\x20\t\r\n\x0C]*=[\x20\t\r\n\x0C]*(?:"([^"]*)"|'([^']*)'|([^\x20\t\r\n\x0C"'>][^\x20\t\r\n\x0C>]*))""", re.I)
ENDS = {"script": re.compile(r"</script", re.I), "style": re.compile(r"</style", re.I), "title": re.compile(r"</title", re.I)}
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")
ODD_SPACE = r"[\x20\t\r\n\x0B\x0C]{2,}|[\t\r\n\x0B\x0C]"
SPACES, BREAKS = re.compile(ODD_SPACE), re.compile(r"\x20*\n[\x20\n]*")

METADATA_ID, CONVERSION_ID = "metadata:", "conversion:"


def _urn(name: Column) -> Column:
    h = F.md5(name)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(block: Column) -> Column:
    """``sha1:`` and base 32, five hexadecimal digits at a time."""
    h = F.sha1(block)
    fours = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


class _Next:
    """Places of a mark in a text, asked for from ascending places: each stretch is searched once."""

    def __init__(self, text: str, mark: str):
        self.text, self.mark, self.at = text, mark, -1

    def after(self, place: int) -> int:
        """The first one at or after ``place``; the text's length if there is none."""
        if self.at < place:
            found = self.text.find(self.mark, place)
            self.at = len(self.text) if found < 0 else found
        return self.at


def _decoded(reference: re.Match) -> str:
    return "".join(" " if c.isspace() else c for c in unescape(reference.group()))


def read_page(page: str) -> tuple[str, str, list[str]]:
    """Text, title and outlinks of a page."""
    close, quotes = _Next(page, ">"), {q: _Next(page, q) for q in "\"'"}
    parts, links, title, at = [], [], None, 0
    size, last = len(page), page.rfind(">")

    def tag_end(begin: int) -> int:
        end = first = close.after(begin)
        quoted = QUOTED.search(page, begin, end) if end < size else None
        while quoted:
            other = quotes[quoted.group(1)].after(quoted.end())
            if other > last:  # also where the value never ends
                return first
            if other > end:
                end = page.find(">", other)
            quoted = QUOTED.search(page, other + 1, end)
        return end

    while True:
        opening = OPENING.search(page, at)
        if opening is None:
            break
        begin, name = opening.start(), (opening.group(1) or "").lower()
        if opening.group() == "<!--":
            parts.append(page[at:begin])
            found = page.find("-->", opening.end())
            at = size if found < 0 else found + 3
            continue
        end = tag_end(opening.end())
        if end == size:  # no tag ends from here on
            break
        parts.append(page[at:begin])
        at = end + 1
        ends = page[begin + 1] != "/"
        if name in ("script", "style") and ends:
            found = ENDS[name].search(page, at)
            at = size if found is None else min(close.after(found.start()) + 1, size)
            continue
        if name == "title" and ends and title is None:
            found = ENDS["title"].search(page, at)
            title = page[at : found.start()] if found else ""
        if name == "a" and ends:
            href = HREF.search(page, opening.end(), end)
            if href:
                links.append(next(g for g in href.groups() if g is not None))
        if name in BLOCK_TAGS:
            parts.append("\0")
    parts.append(page[at:])
    text = SPACES.sub(" ", "".join(parts)).replace("\0", "\n")
    text = REFERENCE.sub(_decoded, text)
    text = re.sub(r"\x20{2,}", " ", BREAKS.sub("\n", text))
    return text.strip(" \n"), title or "", links


def with_text(records: DataFrame, column: str) -> DataFrame:
    """``records`` with text, title and outlinks of the pages in ``column``, without that column."""
    kept = [f for f in records.schema.fields if f.name not in (column, "text", "title", "outlinks")]
    schema = StructType([*kept, StructField("text", StringType()), StructField("title", StringType()), StructField("outlinks", ArrayType(StringType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            text, title, links = zip(*(read_page(page) for page in batch.column(column).to_pylist()), strict=True)
            made = [pa.array(text, pa.string()), pa.array(title, pa.string()), pa.array(links, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], schema.fieldNames())

    return records.select(*[f.name for f in kept], column).mapInArrow(read, schema)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, url, html) to response records: record_id, target_uri, date, http_header, payload."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    uri = F.coalesce(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.concat(F.lit("urn:page:"), page))
    payload = F.coalesce(F.col("html"), F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        "page_id", _urn(F.concat(F.lit("response:"), page, F.lit(":"), uri)).alias("record_id"), uri.alias("target_uri"),
        F.lit(date).alias("date"), header.alias("http_header"), payload.alias("payload"),
    )


def _record(kind: str, content_type: str) -> Column:
    fields = [
        ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length("block").cast("string")),
    ]
    lines = [x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.col("block"))


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response record, metadata and conversion, each with its whole record as text."""
    one_line = lambda c: F.regexp_replace(c, ODD_SPACE, " ")
    status, headers = F.substring_index("http_header", "\r\n", 1), F.expr("slice(split(http_header, '\\r\\n'), 2, size(split(http_header, '\\r\\n')))")
    used = records.select("page_id", "record_id", "target_uri", "date", "http_header", "payload", digest(F.col("payload")).alias("source_digest"))
    base = with_text(used, "payload").withColumn("text_digest", digest(F.col("text")))
    metadata_id, conversion_id = (_urn(F.concat(F.lit(x), F.col("record_id"))) for x in (METADATA_ID, CONVERSION_ID))
    lines = F.concat(
        F.array(
            F.concat(F.lit("source-status: "), status),
            F.concat(F.lit("source-payload-digest: "), F.col("source_digest")),
            F.concat(F.lit("conversion: "), conversion_id),
            F.concat(F.lit("conversion-digest: "), F.col("text_digest")),
            F.concat(F.lit("title: "), one_line(F.col("title"))),
        ),
        F.transform(headers, lambda h: F.concat(F.lit("source-header: "), h)),
        F.transform("outlinks", lambda u: F.concat(F.lit("outlink: "), one_line(u))),
    )
    block = F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n"))
    both = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), metadata_id.alias("record_id"), block.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), conversion_id.alias("record_id"), F.col("text").alias("block")),
    )
    out = base.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_digest", F.explode(both).alias("r"))
    out = out.select("page_id", "refers_to", "target_uri", "date", "source_digest", "r.*").withColumn("block_digest", digest(F.col("block")))
    record = F.when(F.col("warc_type") == "metadata", _record("metadata", "application/warc-fields")).otherwise(_record("conversion", "text/plain; charset=utf-8"))
    return out.withColumn("record", record)


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files: records end with two line breaks, so the text writer's separator makes the framing."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest",
        F.octet_length("block").cast("long").alias("content_length"), F.sha2("record", 256).alias("record_sha256"),
    )


def _sql() -> str:
    b32 = lambda c: "'sha1:' || translate(" + " || ".join(f"to_base(('0x' || sha1({c})[{5 * i + 1}:{5 * i + 5}])::bigint, 32, 4)" for i in range(8)) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    urn = lambda c: f"'<urn:uuid:' || md5({c})[1:8] || '-' || md5({c})[9:12] || '-' || md5({c})[13:16] || '-' || md5({c})[17:20] || '-' || md5({c})[21:32] || '>'"
    q = lambda s: "'" + s.replace("'", "''") + "'"
    whites = lambda v: "".join(" " if c.isspace() else c for c in v)
    entities = ", ".join(f"({q(k[:-1])}, {q(whites(v))})" for k, v in html5.items() if k.endswith(";"))
    hidden = q(r"(?is)<!--.*?(?:-->|\z)|<script(?:[\x20\t\r\n/][^>]*)?>.*?(?:</script[^>]*>|\z)|<style(?:[\x20\t\r\n/][^>]*)?>.*?(?:</style[^>]*>|\z)")
    block = q(r"(?i)</?(?:" + "|".join(sorted(BLOCK_TAGS)) + r")(?:[\x20\t\r\n/][^>]*)?>")
    tag, reference, title = q(r"</?[A-Za-z!?][^>]*>"), q(r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"), q(r"(?is)<title[^>]*>(.*?)</title")
    link = q(r"""(?i)<a(?:[\x20\t\r\n][^>]*?)?[\x20\t\r\n"'/]href[\x20\t\r\n]*=[\x20\t\r\n]*("[^"]*"|'[^']*'|[^\x20\t\r\n"'>][^\x20\t\r\n>]*)""")
    bare = lambda u: f"case when {u}[1] in (chr(34), chr(39)) then {u}[2:-2] else {u} end"
    crlf = "chr(13) || chr(10)"
    point = "(case when n like '#x%' or n like '#X%' then ('0x' || n[3:])::bigint when n like '#%' then n[2:]::bigint else 0 end)"
    fixed = f"(case when {point} between 32 and 55295 or {point} between 57344 and 1114111 then chr({point}::int) || p[length(n) + 2:] when names[n] is not null then names[n] || p[length(n) + 2:] else '&' || p end)"
    space = q(ODD_SPACE)
    record = " || ".join(
        f"'{n}: ' || {v} || {crlf}"
        for n, v in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", q(DATE)), ("WARC-Block-Digest", "block_digest"),
                     ("Content-Type", "case when warc_type = 'metadata' then 'application/warc-fields' else 'text/plain; charset=utf-8' end"), ("Content-Length", "strlen(block)::varchar"))
    )
    return f"""
with entities as (select map_from_entries(list((n, c))) as names from (values {entities}) e(n, c)),
page as (
  select page_id, coalesce(page_id::varchar, 'null') as page, coalesce(html, '') as payload,
    coalesce(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), 'urn:page:' || coalesce(page_id::varchar, 'null')) as target_uri from pages),
source as (select *, {urn("'response:' || page || ':' || target_uri")} as refers_to, {b32("payload")} as source_digest,
    regexp_replace(payload, {hidden}, '', 'g') as shown from page),
pieces as (select *, string_split(regexp_replace(regexp_replace(regexp_replace(shown, {space}, ' ', 'g'), {block}, chr(10), 'g'), {tag}, '', 'g'), '&') as ps from source),
decoded as (select *, ps[1] || array_to_string(list_transform(ps[2:], lambda p: list_transform([regexp_extract(p, {reference}, 1)], lambda n: {fixed})[1]), '') as t1 from pieces, entities),
texts as (select *, trim(regexp_replace(regexp_replace(t1, '\\x20*\\n[\\x20\\n]*', chr(10), 'g'), '\\x20{{2,}}', ' ', 'g'), ' ' || chr(10)) as text from decoded),
ids as (select *, {urn("'metadata:' || refers_to")} as mid, {urn("'conversion:' || refers_to")} as cid from texts),
two as (
  select page_id, refers_to, target_uri, source_digest, 'metadata' as warc_type, mid as record_id,
    'source-status: HTTP/1.1 200 OK' || {crlf} || 'source-payload-digest: ' || source_digest || {crlf} || 'conversion: ' || cid || {crlf} ||
    'conversion-digest: ' || {b32("text")} || {crlf} || 'title: ' || regexp_replace(regexp_extract(shown, {title}, 1), {space}, ' ', 'g') || {crlf} ||
    'source-header: Content-Type: text/html; charset=utf-8' || {crlf} || 'source-header: Content-Length: ' || strlen(payload)::varchar || {crlf} ||
    array_to_string(list_transform(regexp_extract_all(shown, {link}, 1), lambda u: 'outlink: ' || regexp_replace({bare("u")}, {space}, ' ', 'g') || {crlf}), '') as block from ids
  union all
  select page_id, refers_to, target_uri, source_digest, 'conversion', cid, text from ids),
dug as (select *, {b32("block")} as block_digest from two)
select page_id, warc_type, record_id, refers_to, target_uri, source_digest, block_digest, strlen(block)::bigint as content_length,
  sha256('WARC/1.1' || {crlf} || {record} || {crlf} || block) as record_sha256
from dug
"""


SQL = _sql()
