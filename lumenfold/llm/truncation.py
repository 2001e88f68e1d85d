"""Values cut off by field limits or mid-transfer.

A stack automaton reads each value from its first character to its last: tags
left open, quotes and brackets, a tag, entity or multi-byte character broken
off, and whether the last sentence has its terminator.  Values without one are held against the baseline
of their source: a shape that makes up a share of the source's values (captions,
credits, links) counts as whole.
"""

from __future__ import annotations

import hashlib
import html
import html.entities
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .encodings import SINGLE, byte_table

WHOLE, CUT, UNSURE = 0, 1, 2
#: Distinct texts of a shape, and its share of a source's values, from which it is a
#: baseline; the whole table weighs in like so many values of the source.
SHAPE_COUNT = 4
SHAPE_SHARE = 0.001
TABLE_VALUES = 1000

_MARK = re.compile(r"\s*[\[(（]?\s*(?:…|\.\.\.|・・・)+\s*[\])）]?\s*$")
_END = re.compile(r"[.!?。．！？](?:[»”\"’'）)\]」』】›“*_]|\s(?=[»”\"]))*\s*$")
_INNER_END = re.compile(r"[.!?](?:[»”\"’')\]])*\s+\S|[。！？](?:[」』）])*\S")
_URL = re.compile(r"^\s*(?:https?://|www\.)\S+\s*$", re.I)
_TOKEN = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9]*)\b([^<>]*)>|<[A-Za-z/!][^<>]*$|<$|&(?:[A-Za-z]{2,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});", re.S)
_ENTITY_START = re.compile(r"(.?)&(#\d{0,6}|#[xX][0-9A-Fa-f]{0,5}|[A-Za-z]{1,8})$", re.S)
_SEEN = "\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: UTF-8 taken for single bytes, whose last character lacks some of its bytes.
_BROKEN_BYTES = re.compile(f"(?:[â-ï][{_SEEN}]{{2}}|[Â-ß][{_SEEN}])(?:[à-ï][{_SEEN}]?|[Â-ß])$|\ufffd$")
_VOID = {"br", "img", "hr", "input", "wbr", "meta", "link", "source", "area", "base", "col", "embed", "track"}
_OPTIONAL_END = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
_PAIRS = {"(": ")", "[": "]", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】"}


@lru_cache(maxsize=None)
def garbled_ends() -> tuple[str, ...]:
    """What a sentence end looks like after a wrong decoding."""
    out = set()
    for end in ("。", "」", "！", "？", "”", "»"):
        for written in ("utf-8", "cp932", "euc_jp"):
            try:
                raw = end.encode(written)
            except UnicodeEncodeError:
                continue
            for read in SINGLE:
                back = {b: c for c, b in byte_table(read).items()}
                seen = "".join(back[b] if b >= 0x80 else chr(b) for b in raw)
                out.add(seen)
                again = seen.encode("utf-8")
                twice = {b: c for c, b in byte_table("cp1252").items()}
                out.add("".join(twice[b] if b >= 0x80 else chr(b) for b in again))
            for read in ("cp932", "euc_jp", "gb18030"):
                seen = raw.decode(read, "ignore")
                if len(seen) > 1:
                    out.add(seen)
    return tuple(sorted(x for x in out if len(x) > 1))


@lru_cache(maxsize=None)
def _entity_starts() -> tuple[frozenset, frozenset]:
    """Beginnings of all entity names, and of the common lower-case ones."""
    starts = lambda names: frozenset(n[:k] for n in names for k in range(1, len(n) + 1))
    return starts(n.rstrip(";") for n in html.entities.html5), starts(n for n in html.entities.name2codepoint if n.islower())


def broken_entity(text: str) -> bool:
    """Whether a text ends inside an entity.  After a letter or digit (AT&T, R&D,
    rock&roll) it takes two letters of a common name."""
    m = _ENTITY_START.search(text)
    if not m:
        return False
    if m[2].startswith("#"):
        return True
    known, common = _entity_starts()
    return len(m[2]) > 1 and m[2] in common if m[1].isalnum() else m[2] in known


class Tail:
    """State of the automaton at the end of a value.

    stack: open elements with the place where each was opened; `implied` counts
    elements whose end tag was left out, which HTML allows for some."""

    def __init__(self, value: str):
        self.stack: list[tuple[str, int]] = []
        self.implied = 0
        self.in_tag = False
        self.ends_with_tag = False
        text = []
        at, size = 0, len(value.rstrip())
        for m in _TOKEN.finditer(value):
            text.append(value[at : m.start()])
            at = m.end()
            token = m[0]
            if token.startswith("&"):
                text.append(html.unescape(token))
                continue
            if not token.endswith(">"):
                self.in_tag = True
                continue
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if any(n == name for n, _ in self.stack):
                    while self.stack.pop()[0] != name:
                        self.implied += 1
            elif name not in _VOID and not m[3].rstrip().endswith("/"):
                if name in _OPTIONAL_END and self.stack and self.stack[-1][0] == name:
                    self.stack.pop()
                    self.implied += 1
                self.stack.append((name, m.start()))
            self.ends_with_tag = at == size
        rest = value[at:]
        self.broken_entity = broken_entity(rest)
        text.append(rest)
        visible = "".join(text)
        self.text = visible.strip()
        self.last_line = visible[visible.rfind("\n", 0, len(visible)) + 1 :].strip()


def open_marks(text: str) -> list[str]:
    """Quotes and brackets left open at the end."""
    stack: list[str] = []
    for c in text:
        if stack and _PAIRS.get(stack[-1]) == c:
            stack.pop()
        elif c in _PAIRS:
            stack.append(c)
    return stack


def terminated(text: str) -> bool:
    return bool(_END.search(text)) or text.rstrip().endswith(garbled_ends())


#: Scripts without word gaps, in which a run of letters is no name.
_GAPLESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_NAME_WORD = rf"[^\W\d_a-z{_GAPLESS}][^\W{_GAPLESS}]*(?:[\u3400-\u9fff]{{1,4}}(?!\w))?"
_NAME = re.compile(rf"\b{_NAME_WORD}(?:[ ・]{_NAME_WORD})*")


def shape(text: str) -> str:
    """Names, numbers and katakana words masked: the form of a caption."""
    s = re.sub(r"[ァ-ヺー]+", "K", text)
    s = re.sub(r"\d+", "0", s)
    s = _NAME.sub("N", s)
    return re.sub(r"N(?:(?: [^\W\d_]{1,3})? N)+", "N", s)


def summary_verdict(summary: str, body: str | None) -> tuple[int, str]:
    """(verdict, reason) of a plain value; body is the text it may stem from."""
    s = summary.strip()
    if not s:
        return WHOLE, ""
    if _MARK.search(s):
        return CUT, "mark"
    if _URL.match(s):
        return WHOLE, ""
    tail = Tail(s)
    if tail.in_tag:
        return CUT, "tag"
    if tail.broken_entity:
        return CUT, "escape"
    if terminated(tail.text):
        return WHOLE, ""
    if tail.ends_with_tag and not tail.stack and s.startswith("<"):
        return WHOLE, ""
    if _BROKEN_BYTES.search(s):
        return CUT, "multibyte"
    if _INNER_END.search(s):
        return CUT, "sentence"
    if open_marks(s):
        return CUT, "quote"
    if body and " ".join(s.split()) in body:
        return CUT, "sentence"
    return UNSURE, "terminator"


def html_verdict(value: str) -> tuple[int, str]:
    """(verdict, reason) of a body with markup, lines separated by newlines."""
    v = value.rstrip()
    if not v:
        return WHOLE, ""
    last = v.rfind("\n") + 1
    tail = Tail(v)
    if tail.in_tag:
        return CUT, "tag"
    if tail.broken_entity:
        return CUT, "escape"
    if _MARK.search(tail.last_line):
        return CUT, "mark"
    ended = terminated(tail.last_line)
    opened = [name for name, at in tail.stack if at >= last]
    before = [name for name, at in tail.stack if at < last]
    if opened and not ended:
        return CUT, "sentence"
    if not set(opened + before) <= _OPTIONAL_END:
        return CUT, "line"
    if opened:
        # a body that leaves such elements open elsewhere too is whole
        return (WHOLE, "") if tail.implied or before else (CUT, "line")
    if ended or not tail.last_line or tail.ends_with_tag:
        return WHOLE, ""
    if _BROKEN_BYTES.search(v):
        return CUT, "multibyte"
    if last or _INNER_END.search(tail.last_line) or open_marks(tail.text):
        return CUT, "sentence"
    return UNSURE, "terminator"


def _form(text: str, verdict: int) -> tuple[str | None, bytes | None]:
    """Shape and digest of an unsure value."""
    if verdict != UNSURE:
        return None, None
    return shape(text), hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _judged(batches):
    for pdf in batches:
        out = []
        for i, s, h, t, st in zip(pdf["id"], pdf["summary"], pdf["html"], pdf["title"], pdf["body"]):
            if s:
                text = None
                if h and st:
                    text = " ".join(st[len(t) if t and st.startswith(t) else 0 :].split())
                v, why = summary_verdict(s, text)
                if v != WHOLE:
                    out.append((i, 0, v, why, *_form(s.strip(), v)))
            if h:
                v, why = html_verdict(h)
                if v != WHOLE:
                    out.append((i, 1, v, why, *_form(Tail(h.rstrip()).last_line, v)))
        yield pd.DataFrame(out, columns=["id", "field", "verdict", "reason", "shape", "digest"]).astype({"field": np.int32, "verdict": np.int32})


def truncated_values(
    rows: DataFrame, links: DataFrame | None = None, id_col: str = "id", summary_col: str = "summary", html_col: str = "content_html",
    title_col: str = "title", text_col: str = "search_text", shape_count: int = SHAPE_COUNT,
) -> DataFrame:
    """(id, field_name, reason) of the values that stop before their text does.

    Defined cases: null, empty and blank values are never reported; a value
    that ends with a sentence end outside open markup is whole; one without
    sentence ends is whole if at least shape_count distinct texts have its shape
    and, in one of its sources (links: item_id, source_id), other values of that
    shape make up SHAPE_SHARE; items without a source form one source; repeated
    ids give repeated rows; long values are read whole; other columns are
    ignored."""
    src = rows.select(
        F.col(id_col).cast("string").alias("id"), F.col(summary_col).alias("summary"), F.col(html_col).alias("html"),
        F.col(title_col).alias("title"), F.col(text_col).alias("body"),
    )
    src = src.filter(F.col("id").isNotNull() & (F.col("summary").isNotNull() | F.col("html").isNotNull()))
    judged = cut(src.mapInPandas(_judged, "id string, field int, verdict int, reason string, shape string, digest binary"))
    unsure = judged.filter(F.col("verdict") == UNSURE)
    filled = src.select("id", F.explode(F.array_compact(F.array(F.when(F.trim("summary") != "", 0), F.when(F.trim("html") != "", 1)))).alias("field"))
    if links is None:
        placed, filled = (x.withColumn("source", F.lit("")) for x in (unsure, filled))
    else:
        pairs = links.select(F.col("item_id").cast("string").alias("id"), F.col("source_id").cast("string").alias("source")).filter("id is not null and source is not null").distinct()
        placed, filled = (x.join(pairs, "id", "left").fillna("", ["source"]) for x in (unsure, filled))
    # grouped by text first, which spreads a source of any size
    by_shape = ["source", "field", "shape"]
    counts = placed.groupBy(*by_shape, "digest").agg(F.count(F.lit(1)).alias("n")).groupBy(*by_shape).agg(F.sum("n").alias("n"))
    table = unsure.groupBy("field", "shape", "digest").agg(F.count(F.lit(1)).alias("n")).groupBy("field", "shape").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("texts"))
    totals = cut(filled.groupBy("source", "field").agg(F.count(F.lit(1)).alias("values")))
    all_values = totals.groupBy("field").agg(F.sum("values").alias("all_values"))
    others = (F.col("n") - 1 + TABLE_VALUES * (F.col("all_n") - 1) / F.col("all_values")) / (F.col("values") - 1 + TABLE_VALUES)
    usual = (
        counts.join(table.filter(F.col("texts") >= shape_count), ["field", "shape"]).join(totals, ["source", "field"]).join(all_values, "field")
        .filter(others >= SHAPE_SHARE).select(*by_shape)
    )
    whole = placed.join(usual, by_shape).select("id", "field", "digest").distinct()
    cut_rows = judged.filter(F.col("verdict") == CUT).select("id", "field", "reason").unionByName(
        unsure.join(whole, ["id", "field", "digest"], "left_anti").select("id", "field", "reason")
    )
    name = F.when(F.col("field") == 0, summary_col).otherwise(html_col)
    return cut_rows.select("id", name.alias("field_name"), "reason")


def source_rates(rows: DataFrame, links: DataFrame, cut_values: DataFrame, id_col: str = "id", fields=("summary", "content_html")) -> DataFrame:
    """(source_id, field_name, filled, truncated, share, usual_length, at_length)
    for every source: how often it truncates each field, and the commonest length
    of its cut values with their number, which shows a fixed limit (of equally
    common lengths the greater; null and 0 without cut values).  An item of two
    sources counts in both, a repeated link once."""
    pairs = links.select("item_id", "source_id").filter("item_id is not null and source_id is not null").distinct()
    filled = [F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.struct(F.lit(f).alias("field_name"), F.length(f).alias("length"))) for f in fields]
    has = rows.select(F.col(id_col).alias("item_id"), F.explode(F.array_compact(F.array(*filled))).alias("v")).select("item_id", "v.*")
    marked = has.join(cut_values.select(F.col("id").alias("item_id"), "field_name", F.lit(1).alias("is_cut")).distinct(), ["item_id", "field_name"], "left")
    by_length = marked.join(pairs, "item_id").groupBy("source_id", "field_name", F.when(F.col("is_cut") == 1, F.col("length")).alias("length")).agg(F.count(F.lit(1)).alias("n"), F.count("is_cut").alias("cut"))
    common = F.when(F.col("length").isNotNull(), F.struct("cut", "length"))
    return (
        by_length.groupBy("source_id", "field_name").agg(F.sum("n").alias("filled"), F.sum("cut").alias("truncated"), F.max(common).alias("common"))
        .select(
            "source_id", "field_name", "filled", "truncated", F.round(F.col("truncated") / F.col("filled"), 6).alias("share"),
            F.col("common.length").alias("usual_length"), F.coalesce("common.cut", F.lit(0)).alias("at_length"),
        )
    )
