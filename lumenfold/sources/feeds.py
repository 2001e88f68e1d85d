"""Feed bytes to raw items: charset, format, entries, outlines."""

from __future__ import annotations

import codecs
import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_FIELDS = "url string, title string, author string, guid string, published_at_raw string, content_html string, summary string"

_BOMS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
_XML_DECL = re.compile(rb"^\s*<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", re.I)
_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?([A-Za-z0-9._-]+)", re.I)
_HEADER = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._-]+)", re.I)


# Labels of the web that mean another encoding than their name says.
WEB_LABELS = {
    "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "windows-1252": "cp1252", "x-cp1252": "cp1252",
    "iso-8859-9": "cp1254", "latin5": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874", "windows-874": "cp874",
    "gb2312": "gb18030", "gb_2312-80": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030", "chinese": "gb18030",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "ms_kanji": "cp932", "windows-31j": "cp932",
    "x-euc-jp": "euc_jp", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "korean": "cp949", "windows-949": "cp949", "big5": "big5hkscs", "x-x-big5": "big5hkscs",
    "unicode-1-1-utf-8": "utf-8", "utf8": "utf-8", "utf-16": "utf-16-le", "x-mac-cyrillic": "mac_cyrillic", "macintosh": "mac_roman", "x-user-defined": "latin-1",
}


def _as_controls(error: UnicodeDecodeError):
    """Bytes that windows-1252 leaves open are the control characters of their number."""
    return "".join(map(chr, error.object[error.start : error.end])), error.end


codecs.register_error("lumenfold-controls", _as_controls)


def decode_bytes(body: bytes | None, content_type: str | None) -> str | None:
    """Text of a body: BOM, then XML declaration, then <meta>, then header,
    then UTF-8; unknown labels are UTF-8 and bad bytes are replaced."""
    if body is None:
        return None
    body = bytes(body)
    for bom, codec in _BOMS:
        if body.startswith(bom):
            return body[len(bom):].decode(codec, "replace")
    m = _XML_DECL.search(body[:1024]) or _META.search(body[:1024])
    label = m[1].decode("ascii") if m else None
    if label is None and content_type:
        h = _HEADER.search(content_type)
        label = h[1] if h else None
    label = (label or "utf-8").strip().lower()
    label = WEB_LABELS.get(label, label)
    try:
        return body.decode(label, "lumenfold-controls" if label == "cp1252" else "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(b, c) for b, c in zip(body, content_type)])


def is_json_feed(content_type, body):
    """Whether the body is a JSON feed, by its type or its first character."""
    return F.coalesce(F.lower(content_type).contains("json"), F.lit(False)) | F.ltrim(body).startswith("{")


# Name spaces whose elements are known by a prefix, and those whose are not.
PREFIXES = {"http://purl.org/dc/elements/1.1/": "dc:", "http://purl.org/rss/1.0/modules/content/": "content:"}
UNPREFIXED = {"", "http://www.w3.org/2005/Atom", "http://purl.org/atom/ns#", "http://purl.org/rss/1.0/", "http://my.netscape.com/rdf/simple/0.9/", "http://backend.userland.com/rss2"}


def _name(tag) -> str:
    """Lower-case name with the usual prefix of its name space; elements of other
    name spaces never pass for plain ones."""
    if not isinstance(tag, str):
        return ""
    space, _, local = tag[1:].rpartition("}") if tag.startswith("{") else ("", "", tag)
    if space in UNPREFIXED:
        return local.lower()
    return f"{PREFIXES.get(space, space + ' ')}{local}".lower()


# Element names by field, in the order they are tried.
KEYS = {
    "author": ["dc:creator", "author", "creator"],
    "content_html": ["content:encoded", "content", "description", "summary"],
    "guid": ["guid", "id"],
    "published_at_raw": ["pubdate", "published", "updated", "dc:date", "date"],
    "summary": ["description", "summary"],
    "title": ["title"],
}


def _text(node) -> str | None:
    """Own text between and around children, else a name child, else an href."""
    if node is None:
        return None
    own = "".join([node.text or "", *[child.tail or "" for child in node]]).strip()
    if own:
        return own
    for child in node:
        if _name(child.tag) == "name" and (child.text or "").strip():
            return child.text.strip()
    return (node.get("href") or "").strip() or None


def parse_xml(text: str) -> list[dict] | None:
    """Entries of an RSS or Atom document; null when it cannot be parsed."""
    try:
        root = ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
    except ET.ParseError:
        return None
    out = []
    for entry in root.iter():
        if _name(entry.tag) not in ("item", "entry"):
            continue
        first: dict = {}
        links = []
        for child in entry:
            name = _name(child.tag)
            if name == "link":
                links.append(child)
            first.setdefault(name, child)
        chosen = next((x for x in links if x.get("rel", "alternate") == "alternate"), links[0] if links else None)
        url = _text(chosen) or _text(first.get("url"))
        if not url:
            continue
        item = {"url": url}
        for field, names in KEYS.items():
            item[field] = next((v for v in (_text(first.get(n)) for n in names) if v), None)
        out.append(item)
    return out


def parse_json(text: str) -> list[dict] | None:
    try:
        items = json.loads(text).get("items", [])
    except (ValueError, AttributeError):
        return None
    out = []
    for x in items if isinstance(items, list) else []:
        url = x.get("url") if isinstance(x, dict) else None
        if not url:
            continue
        author = x.get("author") or (x.get("authors") or [None])[0]
        out.append(
            {
                "url": str(url), "title": x.get("title"), "author": author.get("name") if isinstance(author, dict) else author,
                "guid": None if x.get("id") is None else str(x["id"]), "published_at_raw": x.get("date_published") or x.get("date_modified"),
                "content_html": x.get("content_html") or x.get("content_text"), "summary": x.get("summary"),
            }
        )
    return out


def parse_feeds(bodies: DataFrame, key: str = "feed_id") -> DataFrame:
    """(key, ok, items): one row per body (columns key, body, content_type);
    ok is false where it cannot be parsed, which is retryable."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, b, c in zip(pdf[key], pdf["body"], pdf["content_type"]):
                text = decode_bytes(b, c) or ""
                json_feed = "json" in (c or "").lower() or text.lstrip().startswith("{")
                items = parse_json(text) if json_feed else parse_xml(text)
                out.append((k, items is not None, items or []))
            yield pd.DataFrame(out, columns=[key, "ok", "items"])

    kind = bodies.schema[key].dataType.simpleString()
    fields = ITEM_FIELDS.replace(" string", ":string")
    return bodies.select(key, "body", "content_type").mapInPandas(run, f"{key} {kind}, ok boolean, items array<struct<{fields}>>")


def feed_items(parsed: DataFrame, key: str = "feed_id") -> DataFrame:
    return parsed.select(key, F.posexplode("items").alias("position", "item")).select(key, "position", "item.*")


def opml_outlines(documents: DataFrame, key: str = "doc", text: str = "xml") -> DataFrame:
    """(key, position, title, xml_url, html_url): nested outlines with a feed
    address, the first of each address; malformed documents give none."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf[text]):
                try:
                    root = ET.fromstring(x) if x else None
                except ET.ParseError:
                    root = None
                seen = set()
                for o in root.iter("outline") if root is not None else ():
                    url = o.get("xmlUrl")
                    if url and url.strip() and url not in seen:
                        seen.add(url)
                        out.append((k, len(seen) - 1, o.get("title") or o.get("text"), url.strip(), o.get("htmlUrl")))
            yield pd.DataFrame(out, columns=[key, "position", "title", "xml_url", "html_url"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, position int, title string, xml_url string, html_url string")


#: Source kinds that can be read; others are marked unsupported.
REGISTRY = {"feed": parse_feeds}


def supported(kind):
    return F.when(kind.isin(list(REGISTRY)), "active").otherwise("unsupported")
