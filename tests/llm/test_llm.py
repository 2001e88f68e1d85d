import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import encodings, lookalikes, mixing, near_duplicates, packing, repeated_lines, subjects, truncation, vectors
from lumenfold.llm.queries import QUERIES

CLASH = ["key", "doc", "text", "field", "n", "shard", "rank", "tokens_", "raw", "a", "b"]


def clashing(df):
    """Columns under the names that operators use inside."""
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0))
    return df


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


# ---- repeated lines ---------------------------------------------------------

def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(1)
    lines = ["<p>Follow us &amp; share</p>", "Reading time: 12 min", "ok", "", "<br>", "long " * 300]
    items, links = [], []
    for i in range(60):
        body = "\n".join([rng.choice(lines).replace("12", str(rng.randrange(99))) for _ in range(3)] + [f"unique text {rng.random()}"])
        items.append((f"i{i}", rng.choice([body, body, body, None])))
        for s in {rng.choice("ab"), rng.choice("abc")}:
            links.append((f"i{i}", s))
    links += links[:5] + [(None, "a"), ("i1", None)]
    got = {tuple(r) for r in repeated_lines.repeated_lines(
        clashing(spark.createDataFrame(items + items[:3], "id string, content_html string")), spark.createDataFrame(links, "item_id string, source_id string")).collect()}
    pairs = {(i, s) for i, s in links if i and s}
    body = dict(items)
    seen, size = {}, {}
    for i, s in pairs:
        size[s] = size.get(s, 0) + 1
        for x in (body[i] or "").split("\n"):
            v = repeated_lines.visible_line(x)
            if v:
                seen.setdefault((s, v), set()).add(i)
    want = {(i, n) for i, s in pairs for n, x in enumerate((body[i] or "").split("\n"), 1)
            if (s, repeated_lines.visible_line(x)) in seen and len(seen[s, repeated_lines.visible_line(x)]) >= max(6, 0.15 * size[s] - 1e-9)}
    assert got == want and want
    empty = spark.createDataFrame([], "id string, content_html string")
    assert repeated_lines.repeated_lines(empty, spark.createDataFrame([], "item_id string, source_id string")).count() == 0
    found = spark.createDataFrame([("i", 2), ("j", 1)], "item_id string, line_no int")
    out = dict(repeated_lines.without_lines(spark.createDataFrame([("i", "a\nb\nc"), ("j", "x"), ("k", None)], "id string, content_html string"), found).collect())
    assert out == {"i": "a\nc", "j": "", "k": None}


def test_equal_lines_have_equal_chunks():
    rng = random.Random(4)
    words = [f"word{rng.random():.5f}" for _ in range(300)]
    line = " ".join(rng.choice(words) for _ in range(30))
    seen = []
    for _ in range(40):
        before = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) or "x" for _ in range(rng.randrange(4))]
        after = ["y" * rng.randrange(1, 9)] * rng.randrange(3)
        at, hashes = repeated_lines.chunk_hashes([*before, line, *after])
        seen.append(hashes[at == len(before)].tolist())
    assert all(x == seen[0] for x in seen) and len(seen[0]) >= 5
    for short in ([""], ["x"], ["", ""], ["ab" * 3]):
        assert len(repeated_lines.chunk_hashes(short)[1]) == 0


# ---- look-alikes --------------------------------------------------------------

def test_look_alikes(spark):
    same = ["Rafifoza café fjord 42 file", "Rаfifоzа café fjｏrd ４２ ﬁle", "Rafi​foza café fjord 42 file"]
    other = ["rafifoza café fjord 42 file", "Rafifoza cafe fjord 42 file", "Rafifoza café fjord ④² file", "Rafifoza café fjord 42 file!", "！", "!", "½", "1/2", "", None]
    rows = [(f"s{i}", t, None) for i, t in enumerate(same)] + [(f"o{i}", t, "x" * 20000) for i, t in enumerate(other)] + [("s0", same[0], None)]
    df = clashing(spark.createDataFrame(rows, "id string, title string, search_text string"))
    got = {tuple(r) for r in lookalikes.look_alike_pairs(lookalikes.look_classes(lookalikes.canonical_texts(df))).collect()}
    assert got == {("s0", "s1"), ("s0", "s2"), ("s1", "s2")}
    assert lookalikes.canonical_texts(df.limit(0)).count() == 0


def test_the_trie_decides_not_the_table(spark):
    t = lookalikes.LookTrie()
    for w, n in (("lion", 5), ("Iron", 9), ("МОСКВА", 3), ("kernel", 4), ("能力を", 2), ("cop", 1), ("сор", 9)):
        t.add(w, n)
    assert t.find("Ӏion") == "lion" and t.find("Ӏron") == "Iron" and t.find("li\u200bon") == "lion" and t.find("lyon") is None
    # table forms: MOCKBA, кernel, 能カを
    assert lookalikes.table_form("МOСКВА") == "MOCKBA" and t.find("МOСКВА") == "МОСКВА"
    assert lookalikes.table_form("кernel") == "кernel" and t.find("кernel") == "kernel" and t.find("кегпеl") is None
    assert lookalikes.table_form("能カを") == "能カを" and t.find("能力を") == "能力を"
    assert t.find("сор") == "cop" and t.find("Lion") is None
    rows = [("a", "МОСКВА сегодня", None), ("b", "МOСКВА сегодня", None), ("c", "кernel news", None), ("d", "kernel news", None), ("e", "能力を見る", None), ("f", "ＡＩ力", None)]
    got = {r["id"]: r["text"] for r in lookalikes.canonical_texts(spark.createDataFrame(rows, "id string, title string, search_text string")).collect()}
    assert got["b"] == "МОСКВА сегодня" and got["c"] == "kernel news" and got["a"] in (None, "МОСКВА сегодня") and got["e"] in (None, "能力を見る")
    assert got["f"] == "AIカ"


def test_quick_test_passes_every_text_the_table_changes():
    odd, _ = lookalikes._odd()
    for cp in range(0x80, 0x30000):
        c = chr(cp)
        if not 0xD800 <= cp < 0xE000 and lookalikes.table_form(c) != c:
            assert odd.search(c), hex(cp)


def test_large_looks_are_linked_whole(spark):
    base = "a recurring title"
    rows = [(f"p{i:03d}", base, None) for i in range(70)] + [(f"q{i:03d}", base.replace("a", "а", 1), None) for i in range(3)]
    rows += [(f"z{i:03d}", "many looks" + "\u200b" * i, None) for i in range(80)]
    classes = lookalikes.look_classes(lookalikes.canonical_texts(spark.createDataFrame(rows, "id string, title string, search_text string")))
    pairs = {tuple(r) for r in lookalikes.look_alike_pairs(classes).collect()}
    assert {p for p in pairs if p[0] < "z"} == {("p000", f"q{i:03d}") for i in range(3)}
    assert len([p for p in pairs if p[0] >= "z"]) == 79 and classes.count() == 153


# ---- encodings ------------------------------------------------------------------

TEXTS = ["déjà-vu – € 40, Zoë’s", "Über die häufigen Köche", "優勝杯と大会をめぐるミノパスの626日", "データベースと不具合修正を調べた"]


def _model(extra=()):
    counts, words = {}, np.zeros((2, encodings.CELLS), dtype=np.int64)
    for t in TEXTS * 50 + ["the quick brown fox jumps over the lazy dog 0123456789 "] * 200 + list(extra):
        for c in t:
            counts[ord(c)] = counts.get(ord(c), 0) + 1
        for w in encodings._RUNS.findall(t):
            if not w.isascii():
                for row, cell in enumerate(encodings.word_cells(w)):
                    words[row, cell] += 1
    return encodings.CorpusModel(counts, words)


def test_round_trips():
    m = _model()
    for t in TEXTS:
        assert encodings.restore(t, m) == (t, 0, 0)
        for read in ("cp1252", "mac_roman", "cp1251"):
            back = {b: c for c, b in encodings.byte_table(read).items()}
            bad = "".join(back[b] if b > 127 else chr(b) for b in t.encode("utf-8"))
            assert encodings.restore(bad, m)[0] == t, (read, t)
            if read == "cp1252":
                twice = "".join(back[b] if b > 127 else chr(b) for b in bad.encode("utf-8"))
                assert encodings.restore(twice, m)[0] == t
    for t in TEXTS[2:]:
        back = {b: c for c, b in encodings.byte_table("cp1252").items()}
        for written in ("cp932", "euc_jp"):
            bad = "".join(back[b] if b > 127 else chr(b) for b in t.encode(written))
            assert encodings.restore(bad, m)[0] == t, written


def test_lost_bytes_are_wildcards():
    m = _model()
    for t in TEXTS[2:]:
        for read in ("cp1252", "cp932"):
            bad = t.encode("utf-8").decode(read, "replace") if read == "cp1252" else None
            if read == "cp932":
                seen = t.encode("utf-8").decode("cp932", "surrogateescape")
                bad = "".join(c if not 0xDC80 <= ord(c) <= 0xDCFF else encodings.LOST for c in seen)
            if encodings.LOST not in bad:
                continue
            got = encodings.restore(bad, m)[0]
            assert len(got) == len(t) and all(a in (b, encodings.LOST) for a, b in zip(got, t)), (read, got)
            assert sum(a == b for a, b in zip(got, t)) >= 0.6 * len(t)


def fill(text, extra=()):
    return encodings.restore(text, _model(extra))[0]


def test_lost_letters_are_filled_by_words_alone():
    assert fill("die h�ufigen K�che") == "die häufigen Köche"
    assert fill("�ber K�che, K�che.") == "Über Köche, Köche."
    # two words that fit as well, too little left, and no word at all
    assert fill("K�che", ["Küche"] * 60) == "K�che" and fill("K�che", ["Küche"] * 5000) == "Küche"
    assert fill("x� �� K�chentuch") == "x� �� K�chentuch"
    assert fill("大会の��結果と��") == "大会の��結果と��"
    assert fill("x�y x�yz", ["xäy"] * 9) == "xäy x�yz"


def test_words_decide_between_readings():
    """By characters alone an a with a ring is the likelier one, by words not."""
    m = _model(["å å å å å å å å"] * 400 + ["Käse"] * 30)
    bad = "K�se"
    assert m.of("å") < m.of("ä") and encodings.decode(bad, None, None, m)[1] == "Käse"


def test_every_hint_passes_the_quick_test():
    clean = ["déjà-vu – € 40, Zoë’s cœur, élève", "„Über die häufigen Köche“", "優勝杯と大会をめぐる機械学習の626日"]
    assert not [t for t in clean if encodings.suspect(t)]
    back = {b: c for c, b in encodings.byte_table("cp1252").items()}
    for t in ("優勝杯", "大会記録", "機械学習"):
        for written in ("utf-8", "cp932", "euc_jp"):
            assert encodings.suspect("".join(back[b] if b > 127 else chr(b) for b in t.encode(written))), (t, written)
        assert encodings.suspect(t.encode("utf-8").decode("cp932", "replace"))


def test_garbled_values(spark):
    rows = [("a", TEXTS[0], None), ("b", "dÃ©jÃ ", TEXTS[1]), ("c", None, "fr�here K�che"), ("d", "", "frühere Köche"), (None, "�", None), ("e", "SÃO É” “", None), ("f", "x" * 50000, None)]
    rows += [(f"w{i}", "frühere Köche", None) for i in range(9)]
    df = clashing(spark.createDataFrame(rows, "id string, title string, content_html string"))
    got = encodings.garbled_values(df)
    assert {(r["id"], r["field"]) for r in got.collect()} == {("b", "title"), ("c", "content_html")}
    assert {r["id"]: r["text"] for r in got.collect()}["c"] == "frühere Köche"
    assert encodings.garbled_values(df.limit(0)).count() == 0


# ---- near duplicates ---------------------------------------------------------------

def grams(t):
    t = near_duplicates.normal_text(t)
    return {t[i : i + 8] for i in range(len(t) - 7)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows = []
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 120, 300]))]
        for v in range(4):
            t = list(base)
            for _ in range(int(len(t) * v * 0.05)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((f"{k}-{v}", " ".join(t)))
    rows += [("copy-a", rows[0][1].upper()), ("copy-b", rows[0][1] + "  "), ("n", None), ("e", ""), ("s", "short"), (None, rows[0][1]), rows[1]]
    got = {tuple(r) for r in near_duplicates.found_pairs(near_duplicates.near_duplicates(clashing(spark.createDataFrame(rows, "id string, search_text string")))).collect()}
    sets = {i: grams(t) for i, t in rows if i and t}
    ids = sorted(sets)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 30
    assert near_duplicates.near_duplicates(spark.createDataFrame([], "id string, search_text string")).links.count() == 0


def test_large_families_with_edits_spread_out(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    rows = []
    for k, n in enumerate((25, 150, 400)):
        base = [rng.choice(words) for _ in range(n)]
        rows += [(f"{k}-copy{i}", " ".join([*base, f"posted {i}"])) for i in range(30)]
        for i in range(8):
            step, shift = rng.randrange(6, 9), rng.randrange(4)
            rows.append((f"{k}-word{i}", " ".join(rng.choice(words) if j % step == shift else w for j, w in enumerate(base))))
            step = rng.randrange(4, 8)
            rows.append((f"{k}-s{i}", " ".join(w + "s" if j % step == shift else w for j, w in enumerate(base))))
            rows.append((f"{k}-any{i}", " ".join(rng.choice(words) if rng.random() < 0.1 else w for w in base)))
    got = {tuple(r) for r in near_duplicates.found_pairs(near_duplicates.near_duplicates(spark.createDataFrame(rows, "id string, search_text string"))).collect()}
    sets = {i: grams(t) for i, t in rows}
    ids = sorted(sets)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    print(len(got), len(want))
    assert got <= want and len(got) >= 0.999 * len(want) and len(want) > 1500


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r["doc"]: r["root"] for r in near_duplicates.components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100 and len(got) == 34


def test_evenly_spaced_edits_just_over_the_threshold(spark, monkeypatch):
    """One character edited in every 33 to 40, Jaccard 0.60 to 0.66; long lists in blocks."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rng = random.Random(21)
    rows = []
    for k in range(60):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.choice([300, 900, 3000]))]
        rows.append((f"{k:02d}", " ".join("".join(base).split())))
        step = rng.randrange(33, 41)
        rows.append((f"{k:02d}e", " ".join("".join("#" if i % step == 5 else c for i, c in enumerate(base)).split())))
    rows += [(f"t{i:02d}", "a shared template of some length with words and words " * 4 + f"no {i}") for i in range(40)]
    got = {tuple(r) for r in near_duplicates.found_pairs(near_duplicates.near_duplicates(spark.createDataFrame(rows, "id string, search_text string"))).collect()}
    sets = {i: grams(t) for i, t in rows}
    ids = sorted(sets)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    edited = [w for w in want if w[1].endswith("e")]
    assert got <= want and len(got) >= 0.99 * len(want) and len([w for w in edited if w in got]) >= 0.9 * len(edited) and len(edited) >= 20


# ---- vectors -------------------------------------------------------------------------

def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16))
    x = (centers[rng.integers(0, 40, 800)] + 0.3 * rng.normal(size=(800, 16))) * rng.uniform(0.1, 5, (800, 1))
    rows = [(f"{i:04d}", [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(f"copy{i}", rows[0][1]) for i in range(9)] + [("zero", [0.0] * 16), ("null", None), ("nan", [float("nan")] * 16), ("short", [1.0]), ("hole", [None] * 16)]
    df = clashing(spark.createDataFrame(rows, "item_id string, embedding array<float>"))
    got = {}
    for r in vectors.nearest_vectors(df, list_rows=32).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["near_id"]))
    ids = [i for i, v in rows if i[0].isdigit() or i.startswith("copy")]
    m = np.array([v for i, v in rows if i in set(ids)], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    hit = total = 0
    for k, i in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-round(s[k, j], 9), ids[j]))[:5]
        mine = {n for _, n in got[i]}
        hit += len(mine & {ids[j] for j in order})
        total += 5
        assert len(got[i]) == 5 and i not in mine
    assert hit / total >= 0.9 and set(got) == set(ids)
    assert vectors.nearest_vectors(df.limit(0)).count() == 0
    assert vectors.nearest_vectors(df.limit(1)).count() == 0


# ---- truncation ------------------------------------------------------------------------

@pytest.mark.parametrize(
    "value,want",
    [
        ("<p>One sentence.</p>\n<p>Follow us</p>", 0), ("<p>One sentence.</p>\n<p>Another one that sto", 1), ("<p>One.</p>\n<p>Two <a href=\"https://x", 1),
        ("<p>One.</p>\n<di", 1), ("<p>One.</p", 1), ("Plain line one.\nPlain line two.", 0), ("Plain line one.\nPlain li", 1), ("<p>One.\n<p>Two.", 0),
        ("<p>One.</p>\n<p>Two.", 1), ("<p>A &amp; B &qu", 1), ("<p>One.</p>\n<img src=\"x\" alt=\"\">", 0), ("", 0), ("   ", 0), ("<p>One.</p>\n<p>And so on…</p>", 1),
        # elements opened on lines of their own
        ("<div>\n<blockquote>\n<p>Hello there.</p>", 1), ("<div>\n<blockquote>\n<p>Hello there.</p>\n</blockquote>\n</div>", 0), ("<ul>\n<li>One.\n<li>Two.", 1), ("<ul>\n<li>One.\n<li>Two.\n</ul>", 0),
        ("<p>One.\n<p>Two.\n<img src=\"x\">", 0), ("<table>\n<tr><td>a.</td></tr>", 1), ("<p>One.</p>\n" * 5000 + "<div>\n<p>End.</p>", 1), ("<p>Shares of AT&T", 1), ("<p>One.</p>\n<p>A word in R&D</p>", 0),
    ],
)
def test_html_verdict(value, want):
    assert truncation.html_verdict(value)[0] == want


@pytest.mark.parametrize("value,want", [("A whole sentence.", 0), ("A whole one. And a half", 1), ("Anything [...]", 1), ("https://a.example/s/1", 0), ("「そうだ」と話す。", 0), ("今月も分かれている。フグラ市の朝はいつも", 1), ("“Quoted.”", 0), ("Via Gafahix GmbH", 2), ("Via AT&T", 2), ("Photo: R&D", 2), ("Q&A", 2), ("rock&roll", 2), ("Tom &am", 1), ("Tom&am", 1), ("Caf&#2", 1), ("dÃ©jÃ©Ã", 1)])
def test_summary_verdict(value, want):
    assert truncation.summary_verdict(value, None)[0] == want


def test_truncated_values(spark):
    rows = [(f"v{i}", f"Via Gafahix{i} GmbH", None, None, "") for i in range(6)] + [("x", "The thermal galaxy sequenced the enzyme near", None, "t", "t"), ("n", None, None, None, None), (None, "cut …", None, None, "")]
    df = clashing(spark.createDataFrame(rows, "id string, summary string, content_html string, title string, search_text string"))
    got = truncation.truncated_values(df)
    assert [(r["id"], r["field_name"]) for r in got.collect()] == [("x", "summary")]
    rates = truncation.source_rates(df, spark.createDataFrame([("x", "s"), ("x", "s"), ("v1", "s")], "item_id string, source_id string"), got).collect()
    assert [(r["filled"], r["truncated"], r["share"], r["usual_length"], r["at_length"]) for r in rates] == [(2, 1, 0.5, 44, 1)]
    assert truncation.truncated_values(df.limit(0)).count() == 0


def test_baseline_of_a_source(spark):
    rows = [(f"v{i}", f"Via Gafahix{i} GmbH") for i in range(40)] + [(f"r{i}", "The thermal galaxy sequenced the enzyme near") for i in range(6)]
    rows += [(f"j{i}", f"静かなデバッガを{i}回ほど比べたパボグ・シギタは、不具合{c}") for i, c in enumerate("修集取調見売")]
    rows += [(f"s{i}", f"Nobody at Sadaneth{i} defended the sprint until P") for i in range(6)] + [(f"w{i}", f"A whole sentence {i}.") for i in range(9000)]
    links = [(i, "small" if i[0] in "vrj" else f"other{k % 6}") for k, (i, _) in enumerate(rows)]
    df = spark.createDataFrame([(i, s, None, "t", "t") for i, s in rows], "id string, summary string, content_html string, title string, search_text string")
    got = {r["id"] for r in truncation.truncated_values(df, spark.createDataFrame(links, "item_id string, source_id string")).collect()}
    assert got == {f"{k}{i}" for k in "rjs" for i in range(6)}
    assert truncation.shape("データベースと不具合修正") != "N" and truncation.shape("Via デユアエ新聞") == "N" and len(truncation.shape("ab " * 200)) == 600


# ---- packing and mixing ----------------------------------------------------------------

def test_pack_is_valid_and_tight():
    rng = random.Random(7)
    for capacity in (10, 100, 512):
        sizes = [rng.randint(1, capacity) for _ in range(500)] + [capacity] * 3 + [1] * 50
        got = packing.pack(sizes, capacity)
        load = {}
        for s, c in zip(sizes, got):
            load[c] = load.get(c, 0) + s
        assert min(got) == 0 and max(load.values()) <= capacity
        order = sorted(sizes, reverse=True)  # best-fit decreasing as the yardstick
        bins = []
        for s in order:
            fit = [b for b in bins if b >= s]
            if fit:
                b = min(fit)
                bins.remove(b)
                bins.append(b - s)
            else:
                bins.append(capacity - s)
        assert len(load) <= 1.1 * len(bins) + 2
    assert packing.pack([], 10) == []


def test_fill_containers(spark):
    sized = clashing(spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, 3), (4, 3), (5, 7)], "doc_id long, tokens long"))
    kinds = spark.createDataFrame([("k", 10), ("bad", 0), ("none", None)], "container_kind string, capacity_tokens int")
    rows = packing.fill_containers(sized, kinds).collect()
    assert {r["container_kind"] for r in rows} == {"k"}
    per = {}
    for r in rows:
        per[r["shard"], r["container"]] = per.get((r["shard"], r["container"]), 0) + r["tokens"]
    assert max(per.values()) <= 10 and sum(per.values()) == 48
    assert sorted(r["piece"] for r in rows if r["doc_id"] == 1) == [0, 1, 2] and not [r for r in rows if r["doc_id"] == 3]
    assert packing.fill_containers(sized.limit(0), kinds).count() == 0
    assert packing.fill_containers(sized, kinds.filter("container_kind <> 'k'")).count() == 0


def test_repeated_ids_and_several_capacities(spark):
    sized = spark.createDataFrame([(7, 25)] * 40 + [(i, 9) for i in range(20)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([("k", 10), ("k", 30), ("k", 10), ("m", 30)], "container_kind string, capacity_tokens int")
    packed = packing.fill_containers(sized, kinds, shard_items=16)
    load = {}
    for r in packed.collect():
        key = (r["container_kind"], r["capacity"], r["shard"], r["container"])
        load[key] = load.get(key, 0) + r["tokens"]
    assert all(t <= k[1] for k, t in load.items())
    for kind in (("k", 10), ("k", 30), ("m", 30)):
        assert sum(t for k, t in load.items() if k[:2] == kind) == 40 * 25 + 20 * 9
    assert {(r["container_kind"], r["capacity"]): r["fullest"] <= r["capacity"] for r in packing.fill_report(packed).collect()} == {("k", 10): True, ("k", 30): True, ("m", 30): True}
    assert len({k[2] for k in load if k[2] >= 0}) > 1


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("abc"), rng.randint(10, 60), f"t{i}") for i in range(600)]
    rows += [(1000 + i, "b", r[2], r[3]) for i, r in enumerate(rows[:100]) if r[1] == "a"] + [(2000, None, 5, "z"), (2001, "a", 0, "y"), (2002, "d", 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long, copy_of string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 1), ("gone", 0.0, 1), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = mixing.mix_sources(df, targets).collect()
    again = {tuple(r) for r in mixing.mix_sources(df, targets).collect()}
    assert {tuple(r) for r in got} == again
    total = sum(r["tokens"] * r["uses"] for r in got)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        part = sum(r["tokens"] * r["uses"] for r in got if r["source"] == s)
        assert abs(part / total - w) < 0.01
    most = {"a": 2, "b": 3, "c": 1}
    assert all(r["uses"] <= most[r["source"]] for r in got)
    assert mixing.mix_sources(df.limit(0), targets).count() == 0
    assert mixing.mix_report(mixing.mix_sources(df, targets), targets).count() == 5


def test_plan_is_the_largest_mix():
    rng = random.Random(12)
    for _ in range(60):
        names = "abcd"[: rng.randrange(2, 5)]
        patterns = {}
        for _ in range(rng.randrange(1, 7)):
            patterns[tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1))))] = rng.randrange(50, 5000)
        targets = {s: (rng.choice([0.1, 0.3, 0.6]), rng.randrange(1, 4)) for s in names}
        flow, quota = mixing.plan(patterns, targets)
        present = [s for s in names if any(s in m for m in patterns)]
        got = {s: sum(t for _, x, _, t in flow if x == s) for s in present}
        assert got == {s: quota[s] for s in present}
        for m in patterns:  # no pattern beyond its repeats
            assert all(t <= patterns[m] for mm, _, _, t in flow if mm == m)
            assert sum(t for mm, _, _, t in flow if mm == m) <= patterns[m] * max(targets[s][1] for s in m)
        # no larger mix: by every set of sources (max-flow min-cut over single sources' sets)
        scale = sum(targets[s][0] for s in present)
        most = min(
            sum(min(t * max(targets[s][1] for s in m), sum(t * targets[s][1] for s in m if s in part)) for m, t in patterns.items() if set(m) & set(part)) / (sum(targets[s][0] for s in part) / scale)
            for k in range(1, 2 ** len(present)) for part in [[s for i, s in enumerate(present) if k >> i & 1]])
        assert most - 3 * len(present) - 0.001 * most <= sum(got.values()) <= most + 1


# ---- subjects ----------------------------------------------------------------------------

def test_subjects_held_out(spark):
    rng = random.Random(9)
    vocab = {s: [f"{s}word{i}" for i in range(12)] for s in ("law", "sport", "food")}
    filler = [f"plain{i}" for i in range(40)]
    docs, labels, truth = [], [], {}
    for i in range(300):
        about = rng.sample(list(vocab), rng.choice([1, 1, 2]))
        parts = []
        for s in about:
            parts += [" ".join(rng.sample(filler, 3) + rng.sample(vocab[s], 2)) + "." for _ in range(4)]
        parts += [" ".join(rng.sample(filler, 4)) + "." for _ in range(4)]
        rng.shuffle(parts)
        docs.append((i, " ".join(p.capitalize() for p in parts)))
        truth[i] = set(about)
        if i < 150:
            labels += [(i, s) for s in about]
    docs += [(1000, None), (1001, ""), (1002, "... \n\n"), (None, "x")]
    d = clashing(spark.createDataFrame(docs, "doc_id long, body string").withColumnRenamed("body", "text"))
    lab = spark.createDataFrame(labels + labels[:3] + [(None, "law"), (5, None)], "doc_id long, subject string")
    got = {}
    for r in subjects.document_subjects(d, lab).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in range(150, 300)]
    good = sum(got.get(i, set()) == truth[i] for i in held)
    assert good / len(held) > 0.9
    assert subjects.document_subjects(d, lab.limit(0)).count() == 0
    joined = {(r["doc_id"], r["subject"], r["hits"], r["sentences"]) for r in subjects.document_subjects(d, lab, broadcast_rules=0).collect()}
    assert joined == {tuple(r) for r in subjects.document_subjects(d, lab).collect()}


def test_mining_ends_on_long_near_copies(spark):
    long = " ".join(f"rareword{i}" for i in range(40))
    docs = [(i, f"{long} copy{i}. Plain filler text here.") for i in range(6)] + [(10 + i, f"Other{i} thing entirely goal{i % 3}.") for i in range(20)]
    labels = [(i, "law") for i in range(6)] + [(10 + i, "sport") for i in range(20)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    assert subjects.document_subjects(d, lab).count() >= 0


def rules_by_force(rows, most_words):
    """mine_rules over (words, subjects) rows, by all sets of their telling words."""
    prior = {s: sum(s in x for _, x in rows) / len(rows) for _, own in rows for s in own}
    n, k = {}, {}

    def count(only):
        n.clear(), k.clear()
        for found, own in rows:
            w = sorted(x for x in found if only is None or x in only)
            for size in range(1, (1 if only is None else most_words) + 1):
                for c in itertools.combinations(w, size):
                    n[c] = n.get(c, 0) + 1
                    for s in own:
                        k[c, s] = k.get((c, s), 0) + 1

    confidence = lambda c, s: (k[c, s] + subjects.PRIOR_WEIGHT * prior[s]) / (n[c] + subjects.PRIOR_WEIGHT)
    count(None)
    count({c[0] for c, s in k if n[c] >= subjects.MIN_SUPPORT and confidence(c, s) >= max(subjects.MIN_CONFIDENCE, 1.5 * prior[s])})
    sure = {(c, s): confidence(c, s) for (c, s), v in k.items() if v >= subjects.MIN_SUPPORT}
    return {
        (c, s): x for (c, s), x in sure.items()
        if x >= subjects.MIN_CONFIDENCE and not any(sure.get((p, s), 0) >= x - subjects.NEAR_CONFIDENCE for size in range(1, len(c)) for p in itertools.combinations(c, size))
    }


def mined(spark, rows):
    seen = spark.createDataFrame([(bytes([i >> 8, i & 255]), sorted(w), sorted(s), False) for i, (w, s) in enumerate(rows)], "key binary, words array<string>, subjects array<string>, held boolean")
    return {(w, s): c for w, s, c in subjects.mine_rules(seen)}


def test_mining_has_all_telling_words(spark):
    """Rules of the words past a sentence's eight most telling ones, and of more than three words."""
    rng = random.Random(4)
    rows = []
    for i in range(60):  # the eight sure words of law come before a0 to a3, which only together are law
        rows.append(({f"law{j}" for j in range(8)} | {f"a{j}" for j in range(4)}, {"law"}))
        rows.append(({f"a{j}" for j in range(4) if j != i % 4} | {f"noise{rng.randrange(30)}"}, {"law"} if i % 12 < 7 else {"sport"}))
        rows.append(({"goal", f"noise{rng.randrange(30)}"}, {"sport", "food"} if i % 3 else {"sport"}))
        rows.append(({f"plain{i % 7}"}, {"food"}))
    for i in range(90):  # three words of law in any two, none by all of them
        own = rng.sample(["b0", "b1", "b2", "b3", "b4"], rng.choice([1, 2, 3, 4, 5]))
        rows.append(({*own, f"noise{rng.randrange(30)}"}, {"law"} if len(own) > 3 or rng.random() < 0.5 else {"food"}))
    got, force = mined(spark, rows), rules_by_force(rows, 12)
    assert got == pytest.approx(force)
    assert any(len(w) > 3 for w, _ in got)
    assert (("a0", "a1", "a2", "a3"), "law") in got


def test_mining_ends_on_long_near_copies_of_two_subjects(spark):
    long = [f"rareword{i:02}" for i in range(40)]
    rows = [({*long, f"copy{i}"} - {long[i]}, {"law"} if i < 4 else {"sport"}) for i in range(6)]
    rows += [({f"other{i}", f"goal{i % 3}"}, {"sport"}) for i in range(8)] + [({f"thing{i}"}, {"food"}) for i in range(8)]
    got = mined(spark, rows)
    assert {w for w, s in got if s == "law" and len(w) == 1} == {(w,) for w in long[4:]}


def test_all_labelled_documents_are_read(spark):
    lab = spark.range(20_500).selectExpr("id as doc_id", "'law' as subject")
    assert subjects.labelled(lab).count() == 20_500


def test_calibration_pools_falling_rates():
    got = dict(subjects.calibrated([(0, 100, 30), (1, 100, 20), (2, 100, 60), (3, 50, 20), (4, 10, 10)]))
    assert got[0] == got[1] == 0.25 and got[2] == got[3] == 80 / 150 and got[4] == 1.0


def test_sentences():
    assert subjects.sentences("One here. Two there! “Three?” asked someone. 四つ目。五つ目。") == ["One here.", "Two there!", "“Three?” asked someone.", "四つ目。", "五つ目。"]
    assert subjects.sentences("") == [] and subjects.sentences(" \n .") == []
