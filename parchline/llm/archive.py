"""Derived web-archive records: metadata and plain text of archived responses."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
BREAK = "\r\n"
# Content that is not text, whichever opens first, and tags that end a line of it.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript)\b.*?(?:</\1\s*>|\z)"
LINE_TAGS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
ANY_TAG = r"</?[A-Za-z!][^>]*>"
# The HTML standard's character references by name, some of which need no semicolon; a space that does not break is a plain one here.
NAMED = {f"&{name}": value.replace("\xa0", " ") for name, value in html5.items()}
COMMON = ("&amp;", "&nbsp;", "&lt;", "&gt;", "&quot;", "&apos;")
# What may be a reference: a number, or a name up to a semicolon or the first character that is none of a name.
REFERENCE = r"^&(?:#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});|[A-Za-z][A-Za-z0-9]*;?)"
# Some names need no semicolon; then the longest of them that the text begins with counts.
OPEN_NAMES = {name: value for name, value in NAMED.items() if not name.endswith(";")}
LONGEST_OPEN = max(map(len, OPEN_NAMES))
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
# Attributes before the wanted one are passed as wholes, so that none is found in another's value.
VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+"
TAG_VALUE = r"(?i)<{tag}(?=[\s/])(?:[\s/]*+(?!{name}\s*+=)[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{value}))?+)*+[\s/]*+{name}\s*+=\s*+({value})"
LANGUAGE = TAG_VALUE.format(tag="html", name="(?:xml:)?lang", value=VALUE)
LINK = TAG_VALUE.format(tag="a", name="href", value=VALUE)


def visible(html: Column) -> Column:
    """The mark-up without comments, scripts and styles; one without an end goes to the end of the text."""
    return F.regexp_replace(html, HIDDEN, "")


def unquoted(value: Column) -> Column:
    return F.when(value.startswith('"') | value.startswith("'"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def decoded(text: Column) -> Column:
    """Numbered and named character references as characters, each once; references to no character stay."""
    # Maps of maps by the first two letters, since a map is searched from its start.
    nested: dict[str, dict[str, dict[str, str]]] = {}
    for name, value in NAMED.items():
        nested.setdefault(name[1], {}).setdefault(name[2], {})[name] = value
    names = F.from_json(F.lit(json.dumps(nested)), "map<string,map<string,map<string,string>>>")

    def named(name: Column) -> Column:
        return F.element_at(F.element_at(F.element_at(names, F.substring(name, 2, 1)), F.substring(name, 3, 1)), name)

    def open_name(found: Column) -> Column:
        """The longest name without semicolon at the start, and what is left of the piece's name."""
        sizes = range(LONGEST_OPEN, 2, -1)
        return F.coalesce(*[F.when(F.length(found) >= n, F.concat(named(F.substring(found, 1, n)), F.substr(found, F.lit(n + 1)))) for n in sizes], found)

    def numbered(found: Column) -> Column:
        digits = F.regexp_replace(found, "[&#;xX]", "")
        point = F.conv(digits, 10, 10).cast("bigint")
        point = F.when(F.lower(found).startswith("&#x"), F.conv(digits, 16, 10).cast("bigint")).otherwise(point)
        good = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point < 0x110000))
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(found)

    def character(found: Column) -> Column:
        value = F.when(found == "", found)
        for name in COMMON:
            value = value.when(found == name, F.lit(NAMED[name]))
        return value.when(found.startswith("&#"), numbered(found)).otherwise(F.coalesce(named(found), open_name(found)))

    # Cut before each ampersand, a piece has at most one reference, at its start, and what it gives is not read again.
    pieces = F.transform(F.split(text, "(?=&)"), lambda p: F.struct(p.alias("piece"), F.regexp_extract(p, REFERENCE, 0).alias("found")))
    whole = F.array_join(F.transform(pieces, lambda p: F.concat(character(p["found"]), F.substr(p["piece"], F.length(p["found"]) + 1))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def tidy(text: Column) -> Column:
    """Single spaces, no empty lines, none at the ends."""
    text = F.regexp_replace(text, "[ \\t\\r\\f\\x0B]+", " ")
    text = F.regexp_replace(text, " ?\\n[ \\n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def plain_text(seen: Column) -> Column:
    """What a reader sees of visible mark-up, one line per block."""
    text = F.regexp_replace(seen, "[\\r\\n]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, LINE_TAGS, "\n"), ANY_TAG, "")
    return tidy(decoded(text))


def one_line(value: Column) -> Column:
    return F.regexp_replace(value, "[\\r\\n]+", " ")


def urn(*parts: Column) -> Column:
    """A record identifier that depends only on its parts."""
    digest = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    pieces = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def derived_records(responses: DataFrame, *keep: str) -> DataFrame:
    """A metadata and a conversion record for every archived response.

    General: the hydroclimate records hold no web pages, so the input is any table of responses with
    ``record_id`` (text), ``target_uri``, ``warc_date``, ``headers`` (map of text, the source's own header fields) and ``payload``
    (mark-up). Columns named in ``keep`` are carried along, all others ignored.

    Returns two rows per input row: ``record_type`` (metadata, conversion), ``record_id`` (made from type
    and source), ``refers_to`` (the response's identifier), ``target_uri``, ``warc_date``, ``content_type``,
    ``content_length`` (bytes), ``block_digest``, ``payload_digest`` (of the response's payload), ``source_headers`` (the response's fields, sorted by
    name, one per line) and ``block``. The metadata block lists title, language and links as fields; the conversion block
    is the plain text. A null payload is empty; a null identifier, address or date stays null; a map that is null is empty. Repeated rows give the
    same records again; an empty table gives none. Everything is column expressions, without a shuffle.
    """
    # The visible mark-up is a column of its own, so it is made once for title, links and text.
    responses = responses.select(*keep, "record_id", "target_uri", "warc_date", "headers", F.coalesce("payload", F.lit("")).alias("payload"))
    responses = responses.withColumn("seen", visible(F.col("payload")))
    payload, seen = F.col("payload"), F.col("seen")
    title = tidy(decoded(F.regexp_replace(F.regexp_extract(seen, TITLE, 1), ANY_TAG, "")))
    links = F.regexp_extract_all(seen, F.lit(LINK), F.lit(1))
    fields = F.concat(
        F.array(F.concat(F.lit("title: "), one_line(title)), F.concat(F.lit("language: "), one_line(unquoted(F.regexp_extract(payload, LANGUAGE, 1))))),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), one_line(F.replace(unquoted(x), F.lit("&amp;"), F.lit("&"))))),
    )
    headers = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(F.array_join(fields, BREAK), F.lit(BREAK)).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(seen).alias("block")),
    )
    rows = responses.select(
        *keep, F.col("record_id").alias("refers_to"), one_line(F.col("target_uri")).alias("target_uri"), F.col("warc_date").cast("string").alias("warc_date"),
        F.array_join(F.transform(headers, lambda h: F.concat(h["key"], F.lit(": "), one_line(F.coalesce(h["value"], F.lit(""))))), "\n").alias("source_headers"),
        digest(payload).alias("payload_digest"), F.explode(kinds).alias("made"),
    )
    return rows.select(
        *keep, "made.record_type", urn(F.col("made.record_type"), F.col("refers_to"), F.col("target_uri"), F.col("payload_digest")).alias("record_id"), "refers_to", "target_uri",
        "warc_date", "made.content_type", F.octet_length("made.block").cast("bigint").alias("content_length"), digest(F.col("made.block")).alias("block_digest"),
        "payload_digest", "source_headers", "made.block",
    )


def record_text(records: DataFrame) -> DataFrame:
    """``(record)``: each derived record as it stands in an archive, up to the two line breaks that end it."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    lines = F.array(
        F.lit(VERSION), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("payload_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    source = F.transform(F.filter(F.split("source_headers", "\n"), lambda h: h != ""), lambda h: F.concat(F.lit("WARC-Source-"), h))
    return records.select(F.concat(F.array_join(F.concat(lines, source), BREAK), F.lit(BREAK * 2), "block").alias("record"))


def write_archive(records: DataFrame, path: str) -> None:
    """Writes derived records as gzipped archive files, one per task."""
    record_text(records).write.option("lineSep", BREAK * 2).option("compression", "gzip").text(path)
