"""URL columns: resolving, tracking parameters, canonical form, identity."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import parse_qsl, unquote, urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that never identify content.
TRACKING_NAMES = (
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "igshid", "igsh", "mc_cid", "mc_eid", "_hsenc", "_hsmi",
    "vero_id", "vero_conv", "oly_anon_id", "oly_enc_id", "ref", "ref_src", "ref_url", "referrer", "spm", "cmpid", "ncid",
)
TRACKING_PREFIXES = ("utm_", "pk_", "piwik_", "matomo_", "hsa_", "at_custom")

SPLIT = r"^\s*(https?)://(\[[0-9a-f:.]+\]|[^/?#:@\s]+)(:[0-9]*)?([^?#\s]*)(?:\?([^#]*))?(#.*)?\s*$"
#: URLs that need no parser: plain ASCII, no user, no brackets, no dot segments.
PLAIN = r"(?i)^https?://[a-z0-9.-]*[a-z][a-z0-9-]*(?::[0-9]*)?(?!\S*/(?:\.|%2e){1,2}(?:[/?#]|$))(?:/[a-z0-9._~!$&()*+,;=:@%/-]*)?(?:\?[a-z0-9._~!$&()*+,;=:@%/?\[\]|{}^`-]*)?(?:#[a-z0-9._~!$&()*+,;=:@%/?'-]*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, "(?i)" + SPLIT, k)


def is_web_url(url: Column) -> Column:
    return url.rlike("(?i)" + SPLIT)


def kept_parameters(query: Column, host: Column) -> Column:
    """Array of the parameters that are not tracking noise, in their order."""
    name = lambda p: F.lower(F.split(p, "=")[0])
    blogger = (host == "blogspot.com") | host.endswith(".blogspot.com")

    def keep(p):
        noise = name(p).isin(list(TRACKING_NAMES))
        for prefix in TRACKING_PREFIXES:
            noise = noise | name(p).startswith(prefix)
        return (p != "") & ~noise & ~(blogger & (p == "m=1"))

    return F.filter(F.split(query, "&"), keep)


def resolve_absolute(url: Column) -> Column:
    """A normalised http(s) URL without tracking parameters; null for anything
    else.  A query that loses a parameter is form-encoded anew, others stay."""
    host = F.lower(_part(url, 2))
    query = _part(url, 5)
    kept = kept_parameters(query, host)
    some = F.filter(F.split(query, "&"), lambda p: p != "")
    pieces = F.array_join(F.transform(kept, lambda p: F.concat(_form(F.split(p, "=")[0]), F.lit("="), _form(F.regexp_replace(p, "^[^=]*=?", "")))), "&")
    parameters = F.when(F.size(kept) == F.size(some), query).otherwise(pieces)
    path = F.when(_part(url, 4) == "", F.lit("/")).otherwise(_part(url, 4))
    default = ((F.lower(_part(url, 1)) == "http") & (_part(url, 3) == ":80")) | ((F.lower(_part(url, 1)) == "https") & (_part(url, 3) == ":443"))
    port = F.when(default | (_part(url, 3) == ":"), F.lit("")).otherwise(_part(url, 3))
    built = F.concat(
        F.lower(_part(url, 1)), F.lit("://"), host, port, path,
        F.when(parameters == "", F.lit("")).otherwise(F.concat(F.lit("?"), parameters)), _part(url, 6),
    )
    return F.when(is_web_url(url), built)


def _form(piece: Column) -> Column:
    return F.url_encode(F.coalesce(F.try_url_decode(piece), piece))


_ENCODED = {
    "path": frozenset(' "#<>?`{}^'), "query": frozenset(' "#<>\''), "fragment": frozenset(' "<>`'), "user": frozenset(' "#<>?`{}/:;=@[\\]^|'),
}


def _escaped(text: str, part: str) -> str:
    odd = _ENCODED[part]
    return "".join(c if "\x20" < c < "\x7f" and c not in odd else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _host(text: str) -> str | None:
    """Lower-case ASCII form of a host name or address; null where invalid."""
    if text.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]" if text.endswith("]") else None
        except ValueError:
            return None
    name = unquote(text).lower()
    if not name.isascii():
        try:
            name = unicodedata.normalize("NFKC", name).replace("。", ".").encode("idna").decode("ascii")
        except UnicodeError:
            return None
    if not name or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", name):
        return None
    labels = name.rstrip(".").split(".")
    if re.fullmatch(r"\d+|0x[0-9a-f]*", labels[-1]):
        return _ipv4(labels)
    return name


def _ipv4(labels: list[str]) -> str | None:
    try:
        numbers = [int(x, 16) if x[:2] == "0x" and len(x) > 2 else 0 if x == "0x" else int(x, 8) if len(x) > 1 and x[0] == "0" else int(x) for x in labels]
    except ValueError:
        return None
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _folded(path: str) -> str:
    """A path without dot segments."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, x in enumerate(parts):
        plain = re.sub("%2e", ".", x, flags=re.I)
        if plain == "..":
            if out:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        elif plain == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(x)
    return "/" + "/".join(out)


_SCHEME = re.compile(r"[a-z][a-z0-9+.-]*:", re.I)
_ABSOLUTE = re.compile(r"(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?", re.I | re.S)


def parse_url(href: str | None, base: str | None = None) -> str | None:
    """Browsers' reading of an address against a base: normalised http(s) URL or
    null.  Hosts become ASCII, dot segments are folded, default ports go, what
    may not stand in a URL is percent-encoded."""
    if href is None:
        return None
    text = re.sub(r"[\t\n\r]", "", href.strip("".join(map(chr, range(0x21)))))
    if not text:
        return None
    if not _SCHEME.match(text):
        root = parse_url(base) if base else None
        if root is None:
            return None
        m = _ABSOLUTE.fullmatch(root)
        origin, path, query = f"{m[1]}://{m[2]}", m[3], m[4] or ""
        flat = re.sub(r"^[^?#]*", lambda x: x[0].replace("\\", "/"), text)
        if flat.startswith("//"):
            text = f"{m[1]}:{flat}"
        elif flat.startswith("/"):
            text = origin + flat
        elif flat.startswith("?"):
            text = origin + path + flat
        elif flat.startswith("#") or not flat:
            text = origin + path + query + flat
        else:
            text = origin + path[: path.rfind("/") + 1] + flat
    m = _ABSOLUTE.fullmatch(text)
    if not m:
        return None
    scheme = m[1].lower()
    user, at, place = m[2].rpartition("@")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place)
    if not found:
        return None
    host, port = _host(found[1]), found[2] or ""
    if host is None or port and int(port) > 65535:
        return None
    port = str(int(port)) if port else ""
    port = "" if port == {"http": "80", "https": "443"}[scheme] else port
    name, colon, word = user.partition(":")
    login = _escaped(name, "user") + (":" + _escaped(word, "user") if word else "") + "@" if at and user.strip(":") else ""
    path = _escaped(_folded("/" + m[3].replace("\\", "/").lstrip("/") if not m[3] else m[3].replace("\\", "/")), "path")
    query = "?" + _escaped(m[4][1:], "query") if m[4] and len(m[4]) > 1 else m[4] or ""
    fragment = "#" + _escaped(m[5][1:], "fragment") if m[5] and len(m[5]) > 1 else m[5] or ""
    return f"{scheme}://{login}{host}{':' + port if port else ''}{path}{query}{fragment}"


@F.pandas_udf(T.StringType())
def _parsed(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([parse_url(h, b) for h, b in zip(href, base)], dtype=object)


def with_resolved(df: DataFrame, href: str, base: str, name: str = "resolved") -> DataFrame:
    """df with `name`: a possibly relative href against its base, resolved and
    freed of tracking parameters; null where that gives no http(s) URL.  Only
    what is not a plain absolute URL goes through the parser, in Python."""
    plain = F.trim(F.col(href)).rlike(PLAIN)
    parsed = df.withColumn("_parsed", _parsed(F.when(~plain, F.col(href)), F.when(~plain, F.col(base))))
    return parsed.withColumn(name, resolve_absolute(F.when(plain, F.col(href)).otherwise(F.col("_parsed")))).drop("_parsed")


def canonical_url(url: Column) -> Column:
    """Identity form: https, no port or fragment, parameters sorted by name and
    form-encoded, no trailing slash but the root's.  Plain URLs stay in the JVM."""
    plain = F.trim(url).rlike(PLAIN)
    return F.when(plain, _canonical(url)).otherwise(_canonical_parsed(F.when(~plain, url)))


def canonical_text(url: str | None) -> str | None:
    """The same for any URL, by the parser."""
    m = _ABSOLUTE.fullmatch(parse_url(url) or "")
    if not m:
        return None
    user, at, place = m[2].rpartition("@")
    host = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::\d*)?", place)[1]
    blogger = host == "blogspot.com" or host.endswith(".blogspot.com")
    kept = [
        (k, v) for k, v in parse_qsl((m[4] or "")[1:], keep_blank_values=True)
        if k.lower() not in TRACKING_NAMES and not k.lower().startswith(TRACKING_PREFIXES) and not (blogger and (k, v) == ("m", "1"))
    ]
    query = urlencode(sorted(kept, key=lambda x: x[0]), safe="*-._").replace("~", "%7E")
    path = m[3][:-1] if len(m[3]) > 1 and m[3].endswith("/") else m[3]
    return f"https://{user}{at}{host}{path}{'?' + query if query else ''}"


@F.pandas_udf(T.StringType())
def _canonical_parsed(url: pd.Series) -> pd.Series:
    return pd.Series([canonical_text(u) for u in url], dtype=object)


def _canonical(url: Column) -> Column:
    host = F.lower(_part(url, 2))
    numbered = F.transform(
        kept_parameters(_part(url, 5), host),
        lambda p, i: F.struct(
            F.coalesce(F.try_url_decode(F.split(p, "=")[0]), F.split(p, "=")[0]).alias("k"), i.alias("i"),
            F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")), F.regexp_replace(p, "^[^=]*=?", "")).alias("v"),
        ),
    )
    parameters = F.array_join(F.transform(F.array_sort(numbered), lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    path = F.regexp_replace(_part(url, 4), "(.)/$", "$1")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    built = F.concat(F.lit("https://"), host, path, F.when(parameters == "", F.lit("")).otherwise(F.concat(F.lit("?"), parameters)))
    return F.when(is_web_url(url), built)


def item_identity(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


_ATTRIBUTE = re.compile(r"\b(href|src|poster)\s*=\s*([\"'])(.*?)\2", re.I | re.S)


def absolutize(html: str | None, base: str | None) -> str | None:
    """Relative href, src and poster values of a fragment made absolute."""
    if html is None or base is None:
        return html

    def swap(m):
        value = m[3].strip()
        if not value or value.startswith("#") or _SCHEME.match(value):
            return m[0]
        url = parse_url(value, base)
        return m[0] if url is None else f"{m[1]}={m[2]}{url}{m[2]}"

    return _ATTRIBUTE.sub(swap, html)


@F.pandas_udf(T.StringType())
def _absolutized(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([absolutize(h, b) for h, b in zip(html, base)], dtype=object)


def absolutize_html(html: str, base: str) -> Column:
    """Column of bodies with absolute links; only bodies that hold a relative one
    go through Python."""
    relative = F.col(html).rlike(r"(?is)\b(?:href|src|poster)\s*=\s*[\"']\s*(?![\"'#\s]|[a-z][a-z0-9+.-]*:)")
    return F.when(relative, _absolutized(F.when(relative, F.col(html)), F.col(base))).otherwise(F.col(html))
