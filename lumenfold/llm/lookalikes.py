"""One form for texts that look the same character for character.

Suspicious tokens (holding look-alike letters, full-width forms, ligatures,
detached accents or ignorable characters) are read by a weighted edit automaton
that walks tries of the corpus vocabulary, sharded by skeleton: look-alikes and
ignorables cost nothing, in words of mixed scripts a letter of nearly the same
shape costs NEAR_COST, any other edit more than BUDGET.  Of the spellings
reached at least cost the canonical one is the plain one where the corpus has
it, else the one with fewest changes of script and then the most frequent, so
that words of other scripts keep their letters; tokens that reach none are
normalised by the table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

SHARDS = 4096
NEAR_COST = 0.5
BUDGET = 0.5
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: Classes of one look up to so many texts, and texts up to so many copies, give all their pairs.
EXPAND = 64

# Letters of other scripts of the shape of a Latin letter, and
# CJK ideographs of the shape of a katakana letter.
LATIN_SHAPES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Cherokee and Latin phonetic letters
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "ɡ": "g", "ɑ": "a",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # ideographs and kana
    "力": "カ", "口": "ロ", "二": "ニ", "八": "ハ", "夕": "タ", "工": "エ", "卜": "ト", "へ": "ヘ",
}
# Characters with two Latin shapes; the vocabulary decides.
TWO_SHAPES = {"Ӏ": "Il", "ǀ": "lI", "Ⅰ": "Il", "ⅼ": "lI"}
# Letters of other scripts of nearly the shape of a Latin letter.
NEAR_SHAPES = {"к": "k", "κ": "k", "α": "a", "ι": "i", "ı": "i", "γ": "y", "г": "r", "η": "n", "п": "n", "ω": "w", "ѡ": "w", "т": "t", "τ": "t", "м": "m", "ε": "e", "є": "e", "ԍ": "g", "в": "b", "н": "h"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
MORE_IGNORABLES = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0]


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        kind = unicodedata.category(chr(cp))
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F:
            out[cp] = ""
        elif kind in ("Zs", "Zl", "Zp") or cp in (9, 10, 11, 12, 13, 0x85):
            out[cp] = " "
    out.pop(0x20, None)
    for cp in MORE_IGNORABLES:
        out[cp] = ""
    for first, last in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)):
        for cp in range(first, last + 1):
            out[cp] = chr(cp - 0xFEE0)
    for a, b in (LATIN_SHAPES | LIGATURES).items():
        if a != b:
            out[ord(a)] = b
    for a, b in TWO_SHAPES.items():
        out[ord(a)] = b[0]
    return out


_TABLE: dict[int, str] = {}


def table() -> dict[int, str]:
    """Code point to its look, built once per process."""
    if not _TABLE:
        _TABLE.update(_table())
    return _TABLE


def table_form(text: str) -> str:
    """The text in its plain look: NFC of the table applied to NFD."""
    if text.isascii() and not any(c in text for c in "\t\n\r\x0b\x0c"):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table()))


def plain_spaces(text: str) -> str:
    """Every kind of blank as a space, character for character."""
    if text.isascii():
        return text.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "})
    t = table()
    return "".join(" " if t.get(ord(c)) == " " else c for c in text)


_ODD: list = []


def _odd():
    """(pattern of characters that the table changes or that join with others,
    pattern of nearly Latin letters), built once per process."""
    if not _ODD:
        marks = [cp for cp in range(0x300, 0x110000) if not 0xD800 <= cp < 0xE000 and unicodedata.combining(chr(cp))]
        cps = sorted({*table(), *marks, 9, 10, 11, 12, 13, *[cp for cp in range(0x80, 0x110000) if not 0xAC00 <= cp < 0xE000 and _decomposed_odd(cp)]})
        spans, at = [], 0
        while at < len(cps):
            end = at
            while end + 1 < len(cps) and cps[end + 1] == cps[end] + 1:
                end += 1
            spans.append(f"{re.escape(chr(cps[at]))}-{re.escape(chr(cps[end]))}")
            at = end + 1
        _ODD.extend([re.compile("[" + "".join(spans) + "]"), re.compile("[" + "".join(NEAR_SHAPES) + "]")])
    return _ODD


def _decomposed_odd(cp: int) -> bool:
    """Characters whose canonical parts the table changes, or that NFC rewrites."""
    c = chr(cp)
    parts = unicodedata.decomposition(c)
    if not parts or parts.startswith("<"):
        return False
    d = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", d.translate(table())) != c


def is_suspicious(token: str) -> bool:
    """Whether a token may have another canonical spelling than itself."""
    if token.isascii():
        return False
    odd, near = _odd()
    return bool(odd.search(token)) and table_form(token) != token or bool(near.search(token)) and mixed_with_latin(token)


def script(c: str) -> str:
    """Coarse script of a letter; empty for anything else."""
    if c.isascii():
        return "L" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    cp = ord(c)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return "L"
    if cp < 0x400:
        return "G"
    if cp < 0x530:
        return "C"
    if 0x3040 <= cp < 0x30A0:
        return "H"
    if 0x30A0 <= cp < 0x3100 or 0x31F0 <= cp < 0x3200:
        return "K"
    return "S" if 0x3400 <= cp < 0xA000 else unicodedata.name(c, "?").split(" ")[0]


def script_changes(token: str) -> int:
    kinds = [k for k in map(script, token) if k]
    return sum(x != y for x, y in zip(kinds, kinds[1:]))


def mixed_with_latin(token: str) -> bool:
    """Letters of Latin and of another script, at least as many Latin ones."""
    kinds = [k for k in map(script, token) if k]
    latin = kinds.count("L")
    return 0 < len(kinds) - latin <= latin


_SKELETON = str.maketrans(NEAR_SHAPES | {"I": "l"})


def skeleton(token: str) -> str:
    """Coarse look: what the automaton may ever match has the same skeleton."""
    return (token if token.isascii() else table_form(token)).translate(_SKELETON)


def well_formed(word: str) -> bool:
    """Whether a suspicious token may stand as a spelling of its own: composed,
    and nothing but its script set it apart from its look."""
    if unicodedata.normalize("NFC", word) != word or _odd()[1].search(word) and mixed_with_latin(word):
        return False
    t = table()
    return all(c not in TWO_SHAPES and (look := t.get(ord(c))) != "" and (look is None or len(look) == 1 and look != " " and unicodedata.normalize("NFKC", c) == c) for c in word)


class LookTrie:
    """Vocabulary trie with the weighted edit automaton."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        look = table_form(word)
        node = self.root
        for c in unicodedata.normalize("NFD", look):
            node = node.setdefault(c, {})
        rank = (word == look, -script_changes(word), count, word)
        node[""] = max(rank, node.get("", rank))

    def find(self, token: str) -> str | None:
        """The canonical one of the spellings reached at least cost, or None."""
        states = [(self.root, 0.0)]
        looks = table()
        near = NEAR_SHAPES if mixed_with_latin(token) else {}
        for c in unicodedata.normalize("NFD", token):
            look = looks.get(ord(c))
            if look == "":
                continue  # an ignorable: stay, at no cost
            edits = [(o, 0.0) for o in TWO_SHAPES.get(c, ())] or [(c if look is None else look, 0.0)]
            if c in near:
                edits.append((near[c], NEAR_COST))
            following = []
            for node, spent in states:
                for path, cost in edits:
                    if spent + cost > BUDGET:
                        continue
                    at = node
                    for x in path:
                        at = at.get(x) if at else None
                    if at:
                        following.append((at, spent + cost))
            states = following
            if not states:
                return None
        ends = [(-spent, n[""]) for n, spent in states if "" in n]
        return max(ends)[1][3] if ends else None


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


ROW, WORD, ASKED = 0, 1, 2
_SCANNED = "kind int, id string, field string, raw binary, canon binary, dirty string, tokens array<string>, word string, look string, n long"


def _scan(batches):
    """Every value once: its digests (ROW), and word counts of the task, apart
    for suspicious tokens (ASKED) and others (WORD)."""
    counts: Counter = Counter()

    def words():
        out = []
        for w, n in counts.items():
            k = skeleton(w)
            out.append((ASKED if is_suspicious(w) else WORD, None, None, None, None, None, None, w, None if k == w else k, n))
        counts.clear()
        return out

    odd, near = _odd()
    for pdf in batches:
        out = []
        for i, field, text in zip(pdf["id"], pdf["field"], pdf["text"]):
            raw = _digest(text)
            if text.isascii():
                form = spaced = plain_spaces(text)
            elif not odd.search(text) and not near.search(text):
                form = spaced = text
            else:
                form, spaced = None, plain_spaces(text)
            tokens = spaced.split(" ")
            counts.update(tokens)
            asked = [] if form is not None else sorted({t for t in tokens if t and is_suspicious(t)})
            if asked:
                out.append((ROW, i, field, raw, None, spaced, asked, None, None, 1))
            elif form is not None and form == text:
                out.append((ROW, i, field, raw, raw, None, None, None, None, 1))
            else:
                out.append((ROW, i, field, raw, _digest(spaced), spaced, None, None, None, 1))
            if len(counts) > HELD_WORDS:
                counts.pop("", None)
                out.extend(words())
        yield pd.DataFrame(out, columns=_COLUMNS)
    counts.pop("", None)
    yield pd.DataFrame(words(), columns=_COLUMNS)


_COLUMNS = [c.strip().split(" ")[0] for c in _SCANNED.replace("array<string>", "array").split(",")]


def _resolve(batches):
    """Rows sorted by shard, vocabulary first: one trie per shard at a time."""
    shard, trie = None, LookTrie()
    for pdf in batches:
        tokens, words = [], []
        for s, is_token, word, count in zip(pdf["shard"], pdf["is_token"], pdf["word"], pdf["n"]):
            if s != shard:
                shard, trie = s, LookTrie()
            if not is_token:
                trie.add(word, int(count))
                continue
            found = trie.find(word)
            tokens.append(word)
            words.append(found if found is not None else table_form(word))
        yield pd.DataFrame({"token": tokens, "word": words})


def _candidates(batches):
    """Vocabulary entries: plain words, and suspicious ones that may stand."""
    for pdf in batches:
        yield pdf[[not is_suspicious(w) or well_formed(w) for w in pdf["word"]]]


def _respell(batches):
    for pdf in batches:
        canon, texts = [], []
        for spaced, pairs in zip(pdf["dirty"], pdf["pairs"]):
            known = {p["token"]: p["word"] for p in pairs} if pairs is not None else {}
            text = " ".join([t if t.isascii() else known.get(t, t) for t in spaced.split(" ")])
            texts.append(text)
            canon.append(_digest(text))
        yield pd.DataFrame({"id": pdf["id"], "field": pdf["field"], "raw": pdf["raw"], "canon": canon, "text": texts})


def canonical_texts(rows: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("title", "search_text")) -> DataFrame:
    """(id, field, raw, canon, text): digests of each value before and after,
    and its canonical text where that differs (null where nothing changes).

    Only tokens with suspicious characters go through the automaton; the
    vocabulary counts every token of all values that has the skeleton of some
    suspicious one, and is sharded by it.

    Defined cases: null values give no row, empty ones stay empty; a value of
    invisible characters becomes empty; repeated ids give repeated rows; of
    equally good spellings the greater string wins; very long values are
    processed whole; other columns are ignored."""
    values = None
    for f in fields:
        part = rows.select(F.col(id_col).cast("string").alias("id"), F.lit(f).alias("field"), F.col(f).cast("string").alias("text"))
        values = part if values is None else values.unionByName(part)
    values = values.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    scanned = cut(spread(values).mapInPandas(_scan, _SCANNED))
    settled = scanned.filter(f"kind = {ROW} and canon is not null").select("id", "field", "raw", "canon", F.col("dirty").alias("text"))
    open_rows = scanned.filter(f"kind = {ROW} and canon is null")

    look = F.xxhash64(F.coalesce("look", "word"))
    asked = scanned.filter(f"kind = {ASKED}").groupBy("word").agg(F.first("look").alias("look")).select(look.alias("look"), "word")
    words = (
        scanned.filter(f"kind <> {ROW}").select(look.alias("look"), "word", "n")
        .join(asked.select("look").distinct(), "look", "left_semi").groupBy("look", "word").agg(F.sum("n").alias("n"))
        .mapInPandas(_candidates, "look long, word string, n long")
    )
    shard = F.pmod("look", F.lit(SHARDS)).alias("shard")
    entries = words.select(shard, F.lit(False).alias("is_token"), "word", "n")
    tokens = asked.select(shard, F.lit(True).alias("is_token"), "word", F.lit(0).cast("long").alias("n"))
    resolved = (
        entries.unionByName(tokens).repartition("shard").sortWithinPartitions("shard", "is_token", "word")
        .mapInPandas(_resolve, "token string, word string").filter("token <> word")
    )
    pairs = (
        open_rows.select("id", "field", "raw", F.explode("tokens").alias("token")).distinct()
        .join(resolved, "token").groupBy("id", "field", "raw").agg(F.collect_list(F.struct("token", "word")).alias("pairs"))
    )
    respelled = open_rows.select("id", "field", "raw", "dirty").join(pairs, ["id", "field", "raw"], "left").mapInPandas(
        _respell, "id string, field string, raw binary, canon binary, text string"
    )
    return settled.unionByName(respelled)


def look_classes(canonical: DataFrame) -> DataFrame:
    """(field, canon, raw, rep, look_rep, copies, texts, id): the members of every
    look that several texts share; rep is the least id with the same text,
    look_rep that of the least text, copies the items of the text, texts the
    different texts of the look.  Equal texts count before they are shuffled, so
    a title that a third of all rows has is one row there."""
    rows = canonical.select("id", "field", "raw", "canon").distinct()
    texts = rows.groupBy("field", "canon", "raw").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    looks = texts.groupBy("field", "canon").agg(F.count(F.lit(1)).alias("texts"), F.min_by("rep", "raw").alias("look_rep")).filter("texts > 1")
    several = texts.join(looks, ["field", "canon"])
    return rows.join(several, ["field", "canon", "raw"])


def look_alike_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of ids with different texts of one look in a field.  Texts of up to
    EXPAND copies in looks of up to EXPAND texts give all their pairs; a larger
    text stands by its representative alone, and in a larger look every text is
    paired with the representative of the look: `look_classes` has the members."""
    members = classes.filter((F.col("copies") <= EXPAND) | (F.col("id") == F.col("rep")))
    few = members.filter(F.col("texts") <= EXPAND).select("field", "canon", "raw", F.col("id").alias("a"))
    other = few.select("field", "canon", F.col("raw").alias("raw_b"), F.col("a").alias("b"))
    within = few.join(other, ["field", "canon"]).filter("raw < raw_b and a <> b").select("a", "b")
    star = members.filter((F.col("texts") > EXPAND) & (F.col("rep") != F.col("look_rep"))).select(F.col("look_rep").alias("a"), F.col("id").alias("b"))
    return within.unionByName(star).select(F.least("a", "b").alias("item_id_a"), F.greatest("a", "b").alias("item_id_b")).distinct()
