"""Text columns: cleaning, search text, scores, snippets."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what counts as white space in feed text.
BLANK = r"[\t\n\x0B\f\r\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
MAX_TERMS = 32
SNIPPET_WIDTH = 160


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANK, " "))


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; empty becomes null."""
    return F.nullif(collapse(c), F.lit(""))


def search_text(title: Column, body: Column, summary: Column) -> Column:
    """Title and body without scripts, styles, tags and common entities."""
    s = F.coalesce(body, summary, F.lit(""))
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>", r"&(?:nbsp|amp|lt|gt|quot|#[0-9]+);"):
        s = F.regexp_replace(s, pattern, " ")
    return collapse(F.concat_ws(" ", F.coalesce(title, F.lit("")), s))


def search_terms(query: str) -> list[str]:
    """Terms of a query: split at white space, the first MAX_TERMS."""
    return [t for t in re.split(r"\s+", query.strip()) if t][:MAX_TERMS]


def _pattern(term: str) -> str:
    """Regular expression of a term: whole runs of letters and digits for plain
    ASCII terms, else the literal substring."""
    quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in term)
    return rf"(?<![a-z0-9]){quoted}(?![a-z0-9])" if re.fullmatch(r"[a-z0-9]+", term) else quoted


def term_count(text: Column, term: str) -> Column:
    """Occurrences of a term, ignoring case.  A cheap substring test comes first,
    since most texts do not hold a term."""
    low, lowered = term.lower(), F.lower(text)
    return F.when(F.contains(lowered, F.lit(low)), F.regexp_count(lowered, F.lit(_pattern(low)))).otherwise(0)


def term_frequency(text: Column, terms: list[str]) -> Column:
    total = F.lit(0)
    for t in terms:
        total = total + term_count(text, t)
    return total


def text_score(text: Column, terms: list[str]) -> Column:
    """Occurrences over the root of the text's length."""
    return term_frequency(text, terms).cast("double") / F.sqrt(F.greatest(F.length(text), F.lit(1)).cast("double"))


MARKS = ("\ue000", "\ue001")


def snippet(text: Column, terms: list[str]) -> Column:
    """An excerpt round the first hit, escaped, hits marked; null without one.
    Hits are found and marked before the escaping, so that no term can match an
    entity; as in term_count, plain ASCII terms are whole runs."""
    if not terms:
        return F.lit(None).cast("string")
    patterns = [_pattern(t.lower()) for t in terms]
    spots = [F.nullif(F.regexp_instr(F.lower(text), F.lit(p)), F.lit(0)) for p in patterns]
    at = F.least(*spots) if len(spots) > 1 else spots[0]
    cut = F.translate(F.substring(text, F.greatest(at - SNIPPET_WIDTH // 2, F.lit(1)), F.lit(SNIPPET_WIDTH)), "".join(MARKS), "")
    longest_first = "|".join(p.replace("a-z", "a-zA-Z") for p in sorted(patterns, key=lambda p: -len(p)))
    out = F.regexp_replace(cut, f"(?iu)({longest_first})", f"{MARKS[0]}$1{MARKS[1]}")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (MARKS[0], '<span class="keyword">'), (MARKS[1], "</span>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(at.isNotNull(), out)


# Entity names that snippets decode.
SNIPPET_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = re.compile(r"&(#\d{1,7}|[a-zA-Z]+);")


def snippet_to_text(s: str | None) -> str:
    """Marks stripped and entities decoded in one pass, so that escaped text is
    never decoded twice."""

    def one(m):
        body = m[1]
        if body[0] == "#":
            n = int(body[1:])
            return chr(n) if 0 < n <= 0x10FFFF else m[0]
        return SNIPPET_ENTITIES.get(body.lower(), m[0])

    return " ".join(_ENTITY.sub(one, re.sub(r"<[^>]+>", "", s or "")).split())


@F.pandas_udf(T.StringType())
def snippet_text(s: pd.Series) -> pd.Series:
    return s.map(snippet_to_text)


def embedding_input(title: Column, text: Column, max_chars: int = 8000) -> Column:
    return F.substring(collapse(F.concat_ws("\n\n", title, text)), 1, max_chars)


def iso_millis(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age(published: Column, now: Column) -> Column:
    """Minutes, hours or days since publication."""
    s = F.unix_timestamp(now) - F.unix_timestamp(published)
    return (
        F.when(s < 3600, F.concat(F.round(s / 60).cast("int"), F.lit("m")))
        .when(s < 86400, F.concat(F.round(s / 3600).cast("int"), F.lit("h")))
        .otherwise(F.concat(F.round(s / 86400).cast("int"), F.lit("d")))
    )


class _Markdown(HTMLParser):
    """Markdown of a body: headings, emphasis, links, images, lists, quotes, code."""

    BLOCKS = {"p", "div", "section", "article", "figure", "table", "tr", "ul", "ol", "blockquote", "pre", "header", "footer"}
    MARK = {"em": "_", "i": "_", "strong": "**", "b": "**", "code": "`"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.links: list[str | None] = []
        self.hidden = self.pre = 0
        self.quotes: list[int] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "blockquote":
            self.out.append("\n\n")
            self.quotes.append(len(self.out))
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "    " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.MARK and not (tag == "code" and self.pre):
            self.out.append(self.MARK[tag])
        elif tag == "a":
            self.links.append(a.get("href"))
            self.out.append("[" if a.get("href") else "")
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({a['src']})")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "blockquote" and self.quotes:
            at = self.quotes.pop()
            inner = re.sub(r"\n{3,}", "\n\n", "".join(self.out[at:]).strip())
            self.out[at:] = ["\n".join("> " + x if x else ">" for x in inner.split("\n")), "\n\n"]
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n\n" if not self.lists else "")
        elif tag in self.MARK and not (tag == "code" and self.pre):
            self.out.append(self.MARK[tag])
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in self.BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(body: str | None) -> str | None:
    if body is None:
        return None
    m = _Markdown()
    m.feed(body)
    m.close()
    parts = "".join(m.out).split("```")
    for k in range(0, len(parts), 2):  # code stays as it is
        flat = re.sub(r"[ \t]+\n(?!\n)", lambda x: "  \n" if x[0].startswith("  ") else "\n", parts[k])
        parts[k] = re.sub(r"\n{3,}", "\n\n", re.sub(r"\n +(?=\n|[^ \-0-9>])", "\n", flat))
    return "```".join(parts).strip()


@F.pandas_udf(T.StringType())
def markdown(body: pd.Series) -> pd.Series:
    return pd.Series([to_markdown(b) for b in body], dtype=object)


def render(content: Column, text: Column, summary: Column, form: str) -> Column:
    """An article as markdown, plain text or its summary, with fallbacks."""
    plain = F.coalesce(F.nullif(text, F.lit("")), F.nullif(summary, F.lit("")), F.lit("(no body)"))
    if form == "summary":
        return F.coalesce(summary, F.lit("(no summary)"))
    if form == "text":
        return plain
    if form != "markdown":
        raise ValueError(f"unknown form {form!r}")
    return F.when(F.coalesce(content, F.lit("")) == "", plain).otherwise(markdown(content))
