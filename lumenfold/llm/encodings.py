"""Text decoded in the wrong encoding: found and restored.

Noisy-channel decoding.  A damaged span is turned back into the bytes it was
read from: a lattice whose edges are either a kept character or a character of
the encoding it may have been written in.  A lost byte is a wildcard for any
that makes a corpus character, a letter lost as a whole one for any letter of
the script around it.  A search by single characters drops readings that cannot
win; a Viterbi search under the corpus' word frequencies then decides.  A
wildcard is filled only where the corpus knows the word and nearly all that fits
is one word; otherwise the letter stays U+FFFD.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .grams import codes

LOST = "�"
SINGLE = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp1250", "cp1254", "cp437", "cp850", "koi8_r", "cp866")
WRITTEN = {"cp932": ("utf-8", "euc_jp"), "euc_jp": ("utf-8", "cp932"), "gb18030": ("utf-8", "cp932", "euc_jp")}
UNSEEN_EXTRA = 3.0
SPAN_COST = 3.0
NEVER_SEEN = 25.0
MARGIN = 1.0
ROUNDS = 3
#: Double-byte encodings accept almost any byte pair, so a real span is longer.
MIN_STREAK = 4
#: Gain (nats) from which a reading that leaves nothing odd is taken at once.
CLEAR_GAIN = 8.0
#: Share of the corpus characters or words that fit a gap.
DECISIVE = 0.95
#: Gain by characters under which words are not asked.
HOPELESS = -10.0
#: Cells of each of the two rows of hashed word counts: 8 MB, whatever the corpus.
CELLS = 1 << 20
#: Count of a word, less what other words put into its cell, from which it is known.
KNOWN = 3
#: Whole letters that may be filled in a word, and paths kept at a byte where there are some.
MAX_GAPS, BEAM = 2, 512
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000


@lru_cache(maxsize=None)
def byte_table(codec: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes it leaves undefined
    pass through as C1 controls, as browsers read them."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    if codec == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def _char_class(chars) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


#: Read encodings in which Japanese double-byte text was taken for single bytes.
DOUBLE_READ = ("cp1252", "latin-1", "mac_roman", "cp1251")
COMMON_MARKS = set("–—‘’“”…€")


@lru_cache(maxsize=None)
def _pairs_class(codec: str, leads: tuple[int, int], trails: tuple[int, int]) -> str:
    """Characters that a double-byte codec makes of byte pairs in these ranges."""
    out = set()
    for a in range(leads[0], leads[1] + 1):
        for b in range(trails[0], trails[1] + 1):
            try:
                c = bytes((a, b)).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out.add(c)
    return "".join(re.escape(c) for c in sorted(out))


def _utf8_seen(codec: str) -> tuple[str, str]:
    """What the first two UTF-8 bytes of kana, and of kanji, look like in a
    double-byte codec."""
    return _pairs_class(codec, (0xE3, 0xE3), (0x80, 0x83)), _pairs_class(codec, (0xE4, 0xE9), (0x80, 0xBF))


@lru_cache(maxsize=None)
def hints():
    """(read codec, pattern): where a text may hold bytes of another encoding."""
    out = []
    for codec in SINGLE:
        t = byte_table(codec)
        lead2 = _char_class(c for c, b in t.items() if 0xC2 <= b <= 0xDF)
        lead3 = _char_class(c for c, b in t.items() if 0xE0 <= b <= 0xEF)
        lead4 = _char_class(c for c, b in t.items() if 0xF0 <= b <= 0xF4)
        cont = _char_class([c for c, b in t.items() if 0x80 <= b <= 0xBF] + [LOST])
        utf8 = f"{lead2}{cont}|{lead3}{cont}{cont}|{lead4}{cont}{cont}{cont}"
        if codec in DOUBLE_READ:
            high = _char_class(c for c, b in t.items() if 0xA1 <= b <= 0xFE)
            out.append((codec, re.compile(f"{utf8}|{_shift_jis_seen(codec)}|{high}{{4}}", re.S)))
        else:
            out.append((codec, re.compile(utf8)))
    kana, kanji = _utf8_seen("cp932")
    out.append(("cp932", re.compile(f"[｡-ﾟ\x80{kana}]|[{kanji}][^ぁ-ん]{{0,2}}[{kanji}]")))
    kana, kanji = _utf8_seen("euc_jp")
    out.append(("euc_jp", re.compile(f"[\x8e\x8f]|[{kana}{kanji}].")))
    kana, kanji = _utf8_seen("gb18030")
    out.append(("gb18030", re.compile(f"[{kana}{kanji}]{{2}}")))
    return out


def _shift_jis_seen(codec: str) -> str:
    """Two pairs in a row: of kana and punctuation, which any Japanese sentence
    has, or of kanji with a lead byte that is seldom a character of its own."""
    t = byte_table(codec)
    kana = _char_class(c for c, b in t.items() if 0x81 <= b <= 0x83)
    lead = _char_class(c for c, b in t.items() if 0x81 <= b <= 0x9F)
    if codec == "mac_roman":  # its leads are the accented letters
        return f"(?:{kana}.){{2}}|(?:{lead}.){{3}}"
    rare = _char_class(c for c, b in t.items() if 0x81 <= b <= 0x9F and c not in COMMON_MARKS)
    return f"(?:{kana}.){{2}}|{rare}.{lead}.|{lead}.{rare}."


@lru_cache(maxsize=None)
def _quick():
    """Cheap tests that together pass every text a hint may match: a pair of a
    lead and a following character of any codec, a telling one, double pairs."""
    leads, conts, high = set(), {LOST}, set()
    for codec in SINGLE:
        for c, b in byte_table(codec).items():
            if 0xC2 <= b <= 0xF4:
                leads.add(c)
            if b <= 0xBF:
                conts.add(c)
            if codec in DOUBLE_READ and b >= 0xA1:
                high.add(c)
    pair = re.compile(f"{_char_class(leads)}{_char_class(conts)}|{_char_class(high)}{{4}}")
    seen = "".join(x for codec in ("cp932", "euc_jp", "gb18030") for x in _utf8_seen(codec))
    double = [p for codec in DOUBLE_READ for p in _shift_jis_seen(codec).split("|")]
    # one pattern each: their first character classes make them quick
    return [pair, re.compile(f"[{LOST}\x80-\x9f｡-ﾟ\ue000-\uf8ff{seen}]")] + [re.compile(p, re.S) for p in dict.fromkeys(double)]


@lru_cache(maxsize=None)
def _any_hint():
    return re.compile("|".join(p.pattern for _, p in hints()) + f"|{LOST}|[\x80-\x9f]", re.S)


def suspect(text: str) -> bool:
    """Whether a text may hold characters of a wrong decoding."""
    return any(p.search(text) for p in _quick()) and bool(_any_hint().search(text))


@lru_cache(maxsize=None)
def letters_of(c: str) -> str:
    """Kind of a letter (or an apostrophe): kanji, hiragana and katakana are apart, since words have
    no gaps there; empty for what is no letter."""
    if c < "\x80":
        return "A" if c.isalpha() else ""
    if not (c.isalpha() or c == "’" or unicodedata.category(c)[0] == "M"):
        return ""
    if "\u3041" <= c <= "\u309f":
        return "H"
    if "\u30a0" <= c <= "\u30ff":
        return "K"
    return "S" if "\u3400" <= c <= "\u9fff" or c == "々" else "A"


@lru_cache(maxsize=None)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


_RUNS = re.compile(r"[㐀-鿿々]+|[ぁ-ゟ]+|[゠-ヿ]+|[^\W\d_ぁ-ヿ㐀-鿿々]+(?:’[^\W\d_ぁ-ヿ㐀-鿿々]*)*")


def word_cells(word: str) -> tuple[int, int]:
    h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h % CELLS, (h >> 32) % CELLS


class CorpusModel:
    """Costs (nats) of characters and words by their frequency in the corpus.

    counts: code point to count.  words: two rows of CELLS hashed counts of all
    words with a non-ASCII letter (a count-min sketch, so that the model is
    bounded while no word of the corpus is left out)."""

    def __init__(self, counts: dict[int, int], words: np.ndarray | None = None):
        total = sum(counts.values()) + 1
        self.cost = {chr(c): math.log(total / n) for c, n in counts.items() if n > 0}
        self.unseen = math.log(total) + UNSEEN_EXTRA
        self.words = np.zeros((2, CELLS), dtype=np.int64) if words is None else words
        self.all_words = int(self.words[0].sum()) + 1
        self.noise = self.all_words / CELLS
        self.letters: dict[str, list[tuple[str, float]]] = {}
        for c, cost in self.cost.items():
            if c >= "\x80" and c.isalpha() and letters_of(c) == "A":
                self.letters.setdefault(_script(c), []).append((c, cost))
        for found in self.letters.values():
            if "’" in self.cost:
                found.append(("’", self.cost["’"]))
        self._wild: dict[str, dict] = {}
        self._known: dict[str, float] = {}

    def word_count(self, word: str) -> float:
        """Count of a word, less the mean count of a cell; 0 where it is not known."""
        got = self._known.get(word)
        if got is None:
            if len(self._known) > HELD_WORDS:
                self._known.clear()
            a, b = word_cells(word)
            n = min(self.words[0, a], self.words[1, b]) - self.noise
            got = self._known[word] = float(n) if n >= KNOWN else 0.0
        return got

    def word_gain(self, word: str, by_chars: float) -> float:
        """How much cheaper a word is as a whole than by its characters."""
        if len(word) < 2 or word.isascii():
            return 0.0
        n = self.word_count(word)
        return max(0.0, by_chars - math.log(self.all_words / n)) if n else 0.0

    def text_cost(self, text: str) -> float:
        """Cost of a text as it stands."""
        total = sum(map(self.of, text))
        if text.isascii():
            return total
        return total - sum(self.word_gain(w, sum(map(self.of, w))) for w in _RUNS.findall(text) if not w.isascii())

    def of(self, c: str) -> float:
        return self.cost.get(c, self.unseen)

    def wild(self, written: str, seq: bytes, lost: tuple[int, ...]) -> tuple[float, str, list[tuple[float, str]]] | None:
        """(cost, character, all) of a sequence whose bytes `lost` may be any: the
        cost of all corpus characters that fit, the one that DECISIVE of them are,
        else U+FFFD, and each of them with its cost."""
        if written not in self._wild:
            fits: dict[tuple, list] = {}
            for c, cost in self.cost.items():
                try:
                    b = c.encode(written)
                except UnicodeEncodeError:
                    continue
                if len(b) > 1 and _decoded(b, written) == c:
                    for holes in [(k,) for k in range(len(b))] + [(1, 2)] * (len(b) == 3):
                        fits.setdefault((holes, len(b), bytes(x for k, x in enumerate(b) if k not in holes)), []).append((cost, c))
            self._wild[written] = {}
            for k, fit in fits.items():
                p = sum(math.exp(-cost) for cost, _ in fit)
                cost, c = min(fit)
                self._wild[written][k] = (-math.log(p), c if math.exp(-cost) >= DECISIVE * p else LOST, fit)
        return self._wild[written].get((lost, len(seq), bytes(x for k, x in enumerate(seq) if k not in lost)))


@lru_cache(maxsize=200_000)
def _decoded(seq: bytes, codec: str) -> str | None:
    try:
        c = seq.decode(codec)
    except UnicodeDecodeError:
        return None
    return c if len(c) == 1 and ord(c) > (0x7F if codec == "utf-8" else 0x9F) else None


def _to_bytes(text: str, codec: str):
    """[(char, bytes or None)] of a text under the codec it was read in."""
    if codec in SINGLE:
        t = byte_table(codec)
        return [(c, bytes([t[c]]) if c in t else (c.encode() if c < "\x80" else None)) for c in text]
    out = []
    for c in text:
        try:
            b = c.encode(codec)
        except UnicodeEncodeError:
            b = None
        out.append((c, b))
    return out


def viterbi(text: str, read: str, written: str, model: CorpusModel) -> tuple[float, str, int]:
    """(gain, restored text, characters decoded) of the cheapest lattice path.

    Nodes are byte positions; a node reached by a decoding edge is in state 1,
    so that the cost of entering a damaged span is paid once per span."""
    parts = _to_bytes(text, read)
    data = bytearray()
    starts: dict[int, int] = {}
    solid, wild = [], []
    for k, (c, b) in enumerate(parts):
        starts[len(data)] = k
        b = b if b is not None else b"\x00"
        solid.extend([parts[k][1] is not None] * len(b))
        wild.extend([c == LOST] * len(b))
        data += b
    n = len(data)
    widths = {"utf-8": (2, 3, 4), "cp932": (2, 1), "euc_jp": (2, 3)}[written]
    inf = float("inf")
    between = byte_table("cp1252")
    of, unseen = model.cost.get, model.unseen
    best = [[inf, inf] for _ in range(n + 1)]
    back: list[list] = [[None, None] for _ in range(n + 1)]
    best[0][0] = 0.0
    data_bytes = bytes(data)
    for i in range(n):
        for state in (0, 1):
            at = best[i][state]
            if at == inf:
                continue
            k = starts.get(i)
            if k is not None:
                c, b = parts[k]
                j = i + (len(b) if b is not None else 1)
                cost = at + of(c, unseen)
                # plain ASCII inside a span neither ends nor starts one
                to = state if c < "\x80" else 0
                if cost < best[j][to]:
                    best[j][to], back[j][to] = cost, (i, state, c, 0)
            elif at + unseen < best[i + 1][0]:
                # the span ends inside a wrong character, whose other bytes are lost
                best[i + 1][0], back[i + 1][0] = at + unseen, (i, state, LOST, 0)
            if solid[i] and data_bytes[i] < 0x80 or not solid[i] and not wild[i]:
                continue
            for w in widths:
                j = i + w
                if j > n:
                    continue
                if not all(solid[i:j]):
                    # a lost byte may be any; two, or one in a double-byte encoding, inside a span only
                    holes = tuple(x - i for x in range(i, j) if not solid[x])
                    if not all(wild[i + x] for x in holes) or max(data_bytes[i:j]) < 0x80 or not state and (len(holes) > 1 or written != "utf-8"):
                        continue
                    fit = model.wild(written, data_bytes[i:j], holes)
                    if fit is not None:
                        cost = at + fit[0] + (0.0 if state else SPAN_COST)
                        if cost < best[j][1]:
                            best[j][1], back[j][1] = cost, (i, state, fit[1], 1)
                    continue
                d = _decoded(data_bytes[i:j], written)
                if d is None:
                    continue
                cost = at + of(d, unseen) + (0.0 if state else SPAN_COST)
                if d >= "\u0100" and d not in model.cost and d not in between:
                    cost += NEVER_SEEN  # only a second decoding may explain it
                if cost < best[j][1]:
                    best[j][1], back[j][1] = cost, (i, state, d, 1)
    state = 0 if best[n][0] <= best[n][1] else 1
    kept = sum(of(c, unseen) for c in text)
    gain = kept - best[n][state]
    out, decoded, at, streak, longest = [], 0, n, 0, 0
    while at > 0:
        i, s, c, was = back[at][state]
        out.append(c)
        decoded += was
        streak = streak + 1 if was else 0
        longest = max(longest, streak)
        at, state = i, s
    if written != "utf-8" and longest < MIN_STREAK:
        return 0.0, text, 0
    return gain, "".join(reversed(out)), decoded


class _Paths:
    """Hypotheses at one byte position by (state, word so far, whether a gap is
    filled in it).  Those that close a word with filled gaps compete among
    themselves first: unless one has DECISIVE of their probability, none of them
    is taken.  Only paths with filled gaps in an open word are ever left out."""

    def __init__(self):
        self.plain: dict = {}
        self.filled: dict = {}

    def put(self, key, path, filled: bool) -> None:
        if filled:
            self.filled.setdefault(key, []).append(path)
        elif key not in self.plain or path[0] < self.plain[key][0]:
            self.plain[key] = path

    def settle(self) -> dict:
        out = dict(self.plain)
        for key, paths in self.filled.items():
            best = min(paths, key=lambda p: p[0])
            mass = sum(math.exp(best[0] - p[0]) for p in paths)
            if mass * DECISIVE <= 1 and (key not in out or best[0] < out[key][0]):
                out[key] = best
        if len(out) > BEAM:
            open_gaps = sorted((k for k in out if k[2]), key=lambda k: out[k][0])
            for key in open_gaps[BEAM:]:
                del out[key]
        return out


def decode(text: str, read: str | None, written: str | None, model: CorpusModel) -> tuple[float, str, int]:
    """(gain, restored text, characters decoded or filled) of the cheapest lattice
    path by words; without `read` only lost letters are filled.

    A path is (cost, cost of its word by characters, node, gaps filled in the word,
    whole letters among them); nodes are a linked list of the output."""
    parts = _to_bytes(text, read) if read else [(c, None) for c in text]
    data, starts, solid, wild = bytearray(), {}, [], []
    for k, (c, b) in enumerate(parts):
        starts[len(data)] = k
        b = b if b is not None else b"\x00"
        solid.extend([parts[k][1] is not None] * len(b))
        wild.extend([c == LOST] * len(b))
        data += b
    n, data_bytes = len(data), bytes(data)
    widths = {"utf-8": (2, 3, 4), "cp932": (2, 1), "euc_jp": (2, 3)}[written] if written else ()
    between = byte_table("cp1252")
    nodes: list[tuple[int, str, int]] = []
    at = [_Paths() for _ in range(n + 1)]
    at[0].put((0, "", False), (0.0, 0.0, -1, 0, 0), False)

    def closed(word, path):
        """Cost of a path once its word ends; None where a gap may not be filled."""
        cost, by_chars, _, gaps, whole = path
        gain = model.word_gain(word, by_chars)
        if gaps and (not model.word_count(word) or len(word) < 2 or len(word) - whole < whole):
            return None
        return cost - gain

    def extend(j, state, word, path, c, price, was, gap, whole):
        kind = letters_of(c)
        if c == LOST:
            kind = ""
        if kind and word and letters_of(word[-1]) == kind:
            nodes.append((path[2], c, was))
            at[j].put((state, word + c, path[3] + gap > 0), (path[0] + price, path[1] + price, len(nodes) - 1, path[3] + gap, path[4] + whole), False)
            return
        cost = closed(word, path)
        if cost is not None:
            nodes.append((path[2], c, was))
            at[j].put((state, c if kind else "", gap > 0), (cost + price, price if kind else 0.0, len(nodes) - 1, gap, whole), path[3] > 0)

    for i in range(n):
        k = starts.get(i)
        for (state, word, _), path in at[i].settle().items():
            if k is not None:
                c, b = parts[k]
                j = i + (len(b) if b is not None else 1)
                extend(j, state if c < "\x80" else 0, word, path, c, model.of(c), 0, 0, 0)
                if c == LOST and path[4] < MAX_GAPS:
                    near = word[-1:] or (parts[k + 1][0] if k + 1 < len(parts) else "")
                    if near and letters_of(near) == "A":
                        for o, price in model.letters.get(_script(near), ()):
                            extend(j, state, word, path, o, price, 1, 1, 1)
            else:  # the span ends inside a wrong character, whose other bytes are lost
                extend(i + 1, 0, word, path, LOST, model.unseen, 0, 0, 0)
            if not widths or solid[i] and data_bytes[i] < 0x80 or not solid[i] and not wild[i]:
                continue
            enter = 0.0 if state else SPAN_COST
            for w in widths:
                j = i + w
                if j > n:
                    continue
                if not all(solid[i:j]):
                    holes = tuple(x - i for x in range(i, j) if not solid[x])
                    if not all(wild[i + x] for x in holes) or max(data_bytes[i:j]) < 0x80 or not state and (len(holes) > 1 or written != "utf-8"):
                        continue
                    fit = model.wild(written, data_bytes[i:j], holes)
                    if fit is not None:
                        extend(j, 1, word, path, fit[1], fit[0] + enter, 1, 0, 0)
                        if fit[1] == LOST:
                            for price, o in fit[2]:
                                extend(j, 1, word, path, o, price + enter, 1, 1, 0)
                    continue
                d = _decoded(data_bytes[i:j], written)
                if d is not None:
                    never = NEVER_SEEN if d >= "\u0100" and d not in model.cost and d not in between else 0.0
                    extend(j, 1, word, path, d, model.of(d) + enter + never, 1, 0, 0)
    last = _Paths()
    for (state, word, _), path in at[n].settle().items():
        cost = closed(word, path)
        if cost is not None:
            last.put((0, "", False), (cost, 0.0, path[2], 0, 0), path[3] > 0)
    cost, _, node, _, _ = last.settle()[0, "", False]
    out, decoded, streak, longest = [], 0, 0, 0
    while node >= 0:
        node, c, was = nodes[node]
        out.append(c)
        decoded += was
        streak = streak + 1 if was else 0
        longest = max(longest, streak)
    if written and written != "utf-8" and longest < MIN_STREAK:
        return 0.0, text, 0
    return model.text_cost(text) - cost, "".join(reversed(out)), decoded


_PIECE = re.compile(r"(<[^<>]*>)")


def _readings(piece: str, model: CorpusModel):
    """Best one-step restoration for each encoding it may be written in: by
    characters first, and by words where that comes near the best."""
    near: list = []
    for codec, pattern in hints():
        if not pattern.search(piece):
            continue
        for written in WRITTEN.get(codec, ("utf-8", "cp932", "euc_jp")):
            if codec in SINGLE and written != "utf-8" and codec not in DOUBLE_READ:
                continue
            got = viterbi(piece, codec, written, model)
            if not got[2] or got[0] <= HOPELESS:
                continue
            near.append((got, codec, written))
            if got[0] > CLEAR_GAIN and not suspect(got[1]) and all(c in model.cost for c in got[1]):
                break  # nothing is left to explain
        else:
            continue
        near = near[-1:]
        break
    best: dict[str, tuple[float, str, int]] = {}
    top = max((x[0][0] for x in near), default=0.0)
    for got, codec, written in near:
        if got[0] > top + HOPELESS:
            got = decode(piece, codec, written, model)
        if got[2] and got[0] > best.get(written, (MARGIN,))[0]:
            best[written] = got
    return list(best.values())


def _restore_piece(piece: str, model: CorpusModel, rounds: int = ROUNDS) -> tuple[float, str, int]:
    """(gain, text, decoded) of the span between tags: the chain of up to
    `rounds` wrong decodings whose undoing gains most in all."""
    if rounds == 0 or piece.isascii() or not suspect(piece):
        return 0.0, piece, 0
    best = (0.0, piece, 0)
    for gain, text, n in _readings(piece, model):
        more, text, m = _restore_piece(text, model, rounds - 1)
        if gain + more > best[0]:
            best = (gain + more, text, n + m)
    return best


def restore(text: str, model: CorpusModel) -> tuple[str, int, int]:
    """(text, decoded or filled characters, lost characters) of a value."""
    if text.isascii() or not suspect(text):
        return text, 0, 0
    decoded = 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if line.isascii() or not suspect(line):
            continue
        pieces = _PIECE.split(line)
        for j, piece in enumerate(pieces):
            if piece and not (j % 2):
                _, pieces[j], n = _restore_piece(piece, model)
                decoded += n
                if LOST in pieces[j]:
                    _, pieces[j], n = decode(pieces[j], None, None, model)
                    decoded += n
        lines[k] = "".join(pieces)
    out = "\n".join(lines)
    return out, decoded, out.count(LOST)


def _counted(batches):
    total = np.zeros(0x110000, dtype=np.int64)
    words: Counter = Counter()

    def cells():
        out = np.array([(a, CELLS + b, n) for (a, b), n in ((word_cells(w), n) for w, n in words.items())], dtype=np.int64).reshape(-1, 3)
        words.clear()
        return pd.DataFrame({"at": np.concatenate([out[:, 0], out[:, 1]]) + 0x110000, "n": np.tile(out[:, 2], 2)}).groupby("at", as_index=False).sum()

    for pdf in batches:
        for text in pdf["text"]:
            if text.isascii():
                clean = text
            else:
                clean = "\n".join(x for x in text.split("\n") if not suspect(x)) if suspect(text) else text
            if clean:
                c = codes(clean)
                part = np.bincount(c)
                total[: len(part)] += part
                if not clean.isascii():
                    words.update(w for w in _RUNS.findall(clean) if not w.isascii())
        if len(words) > HELD_WORDS:
            yield cells()
    yield cells()
    at = np.flatnonzero(total)
    yield pd.DataFrame({"at": at, "n": total[at]})


def corpus_model(values: DataFrame) -> CorpusModel:
    """Character and word counts of all clean lines: at most one row per code
    point and per cell of the word counts."""
    rows = values.select("text").mapInPandas(_counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    at, n = rows["at"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
    words = np.zeros(2 * CELLS, dtype=np.int64)
    words[at[at >= 0x110000] - 0x110000] = n[at >= 0x110000]
    return CorpusModel({int(c): int(k) for c, k in zip(at, n) if c < 0x110000}, np.minimum(words, 0xFFFFFFFF).astype(np.uint32).reshape(2, CELLS))


def _restored(model):
    def run(batches):
        m = model.value
        for pdf in batches:
            out = [(i, f, *restore(t, m)) for i, f, t in zip(pdf["id"], pdf["field"], pdf["text"])]
            yield pd.DataFrame([r for r in out if r[3] or r[4]], columns=["id", "field", "text", "decoded", "lost"])

    return run


def garbled_values(rows: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("title", "content_html")) -> DataFrame:
    """(id, field, text, decoded, lost) of the values that were decoded wrongly:
    the restored text, how many characters were decoded anew or filled in, and
    how many stay lost to U+FFFD.

    Defined cases: null and empty values are never reported; values with
    U+FFFD always are; repeated ids give repeated rows; lines of a long value
    are searched one by one, all of them; other columns are ignored."""
    values = None
    for f in fields:
        part = rows.select(F.col(id_col).cast("string").alias("id"), F.lit(f).alias("field"), F.col(f).cast("string").alias("text"))
        values = part if values is None else values.unionByName(part)
    values = spread(values.filter(F.col("id").isNotNull() & F.col("text").isNotNull()))
    model = rows.sparkSession.sparkContext.broadcast(corpus_model(values))
    return values.mapInPandas(_restored(model), "id string, field string, text string, decoded int, lost int")
