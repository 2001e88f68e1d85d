import datetime as dt

import pytest

from lumenfold.functions.date_text import readings
from lumenfold.operators.instants import ChainDecoder, normalise_instants

NOW = dt.datetime(2026, 8, 9, 12, tzinfo=dt.timezone.utc)
US = int(NOW.timestamp()) * 1_000_000


def first(text, order="dmy", zone=None, now=US):
    got = readings(text, now, order, zone)
    return None if not got else (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=got[0][0])).isoformat(" ")


@pytest.mark.parametrize(
    "text,zone,want",
    [
        ("Sat, 09 Aug 2026 03:04:05 GMT", None, "2026-08-09 03:04:05"),
        ("2026-08-09T12:04:05+09:00", None, "2026-08-09 03:04:05"),
        ("Sat, 09 Aug 2026 12:04:05 JST", None, "2026-08-09 03:04:05"),
        ("2026年08月09日（土） 12時04分", "Asia/Tokyo", "2026-08-09 03:04:00"),
        ("令和7年7月2日 18時10分40秒", "Asia/Tokyo", "2025-07-02 09:10:40"),
        ("２０２５年３月４日 ００：５３：１１", None, "2025-03-04 00:53:11"),
        ("3分前", None, "2026-08-09 11:57:00"),
        ("an hour ago", None, "2026-08-09 11:00:00"),
        ("yesterday", None, "2026-08-08 12:00:00"),
        ("1754991322", None, "2025-08-12 09:35:22"),
        ("/Date(1755779625598)/", None, "2025-08-21 12:33:45.598000"),
        ("2025-03-09 04:23 America/Los_Angeles", None, "2025-03-09 11:23:00"),
        ("2024/06/09 14:29:57 UTC+02", None, "2024-06-09 12:29:57"),
        ("2025-12-05T02:16:15-00:00", "Asia/Tokyo", "2025-12-05 02:16:15"),
        ("Wed, 5 Feb 2025 15:57 CST", "Asia/Shanghai", "2025-02-05 07:57:00"),
        ("Wed, 5 Feb 2025 15:57 CST", "America/Chicago", "2025-02-05 21:57:00"),
        ("14 juillet 2024", "Europe/Paris", "2024-07-13 22:00:00"),
        ("11. Juni 2025, 17:27:52 Uhr", "Europe/Berlin", "2025-06-11 15:27:52"),
        ("13 juin 2026 à 10h33", "Europe/Paris", "2026-06-13 08:33:00"),
        ("March 9, 2024 12:46 AM PST", None, "2024-03-09 08:46:00"),
        ("2025-01-23 16:42:55,048240 +0530", None, "2025-01-23 11:12:55.048240"),
    ],
)
def test_readings(text, zone, want):
    assert first(text, zone=zone) == want


@pytest.mark.parametrize("text", ["2031-01-01", "1970-01-01", "junk", "", "   ", None, "n/a", "--", "32/13/2026", "0000-00-00 00:00:00", "2026-08-09 and more", "x" * 500])
def test_unreadable(text):
    assert readings(text, US, "dmy", None) == []


def test_order_and_fold():
    assert first("03/04/2025", "dmy").startswith("2025-04-03")
    assert first("03/04/2025", "mdy").startswith("2025-03-04")
    twice = readings("2025-10-26 02:30", US, "dmy", "Europe/Berlin")
    assert len(twice) == 2 and twice[1][0] - twice[0][0] == 3_600_000_000


def brute(chain):
    import itertools

    best = None
    for pick in itertools.product(*[range(len(o)) for o in chain]):
        chosen = [o[i] for o, i in zip(chain, pick)]
        cost = sum(c[2] for c in chosen) + sum(ChainDecoder._step(a, b) for a, b in zip(chosen, chosen[1:]))
        if best is None or cost < best - 1e-9:
            best = cost
    return best


def test_streaming_viterbi_is_exact():
    import random

    rng = random.Random(4)
    for _ in range(60):
        chain = [[(rng.randrange(10) * 86_400_000_000, rng.choice("ab"), rng.choice([0.0, 0.1, 1.0])) for _ in range(rng.choice([1, 2, 2, 3]))] for _ in range(7)]
        d, out = ChainDecoder(), []
        for i, o in enumerate(chain):
            out += d.push(i, o)
        out += d.finish()
        assert [t for t, _ in out] == list(range(7))
        chosen = [chain[t][c] for t, c in out]
        cost = sum(c[2] for c in chosen) + sum(ChainDecoder._step(a, b) for a, b in zip(chosen, chosen[1:]))
        assert abs(cost - brute(chain)) < 1e-9


def test_normalise_edges(spark):
    rows = [
        (1, "s", "2025-01-01 00:00:00", NOW, '{"date_order": "dmy", "tz": "Asia/Tokyo"}', "x"),
        (2, None, None, None, None, None),
        (3, "s", "01/02/2025", NOW, "not json", "y"),
        (3, "s", "01/02/2025", NOW, "not json", "y"),
        (None, "s", "junk", NOW, "[]", "z"),
    ]
    # columns with the names that the operator uses inside must not clash
    df = spark.createDataFrame(rows, "raw_id long, source_id string, published_at_raw string, fetched_at timestamp, config string, kept string")
    from pyspark.sql import functions as F

    df = df.withColumn("win", F.lit(1)).withColumn("text", F.lit("t")).withColumn("key", F.lit("k"))
    got = sorted(normalise_instants(df, keep="kept").collect(), key=str)
    assert len(got) == 5
    by = {r["kept"]: r for r in got}
    assert by["x"]["instant"] == dt.datetime(2024, 12, 31, 15) and by["x"]["by_rule"]
    assert by["z"]["instant"] is None and by["z"]["instants"] == []
    assert normalise_instants(df.limit(0)).count() == 0


BERLIN = '{"date_order": "dmy", "tz": "Europe/Berlin"}'


def chain(spark, rows, window_days=7):
    """Chosen instants of (source, text, minutes after NOW, config) rows."""
    df = spark.createDataFrame(
        [(i, s, t, NOW + dt.timedelta(minutes=m), c) for i, (s, t, m, c) in enumerate(rows)],
        "raw_id long, source_id string, published_at_raw string, fetched_at timestamp, config string")
    got = {r["raw_id"]: r for r in normalise_instants(df, window_days=window_days).collect()}
    return [got[i]["instant"] for i in range(len(rows))]


def test_neighbours_decide_the_repeated_hour(spark):
    alone = chain(spark, [("s", "2025-10-26 02:10", 0, BERLIN)])
    assert alone == [dt.datetime(2025, 10, 26, 0, 10)]
    after = chain(spark, [("s", "2025-10-26T00:50:00Z", 0, BERLIN), ("s", "2025-10-26 02:10", 1, BERLIN), ("t", "2025-10-26 02:10", 2, BERLIN)])
    assert after[1] == dt.datetime(2025, 10, 26, 1, 10) and after[2] == dt.datetime(2025, 10, 26, 0, 10)


def test_neighbours_decide_an_undeclared_order_and_a_shared_abbreviation(spark):
    got = chain(spark, [("s", "03/25/2025", 0, "{}"), ("s", "03/04/2025", 1, "{}"), ("s", "03/26/2025", 2, "{}"), ("u", "03/04/2025", 3, "{}"), ("v", "03/04/2025", 4, '{"date_order": "dmy"}')])
    assert [x.month for x in got] == [3, 3, 3, 4, 4]
    rows = [("s", f"2025-03-0{k}T06:00:00Z", k, "{}") for k in range(1, 4)]
    got = chain(spark, [*rows, ("s", "2025-03-03 14:10 CST", 9, "{}"), ("s", "2025-03-03T06:20:00Z", 10, "{}"), ("u", "2025-03-03 14:10 CST", 9, "{}")])
    assert got[3] == dt.datetime(2025, 3, 3, 6, 10) and got[5] == dt.datetime(2025, 3, 3, 20, 10)


def test_windows_do_not_cut_the_chain(spark):
    import random

    rng = random.Random(6)
    texts = ["03/04/2025", "05/04/2025", "04/05/2025 10:00", "03/25/2025", "2025-04-04", "2025-10-26 02:30", "junk"]
    rows = [(rng.choice("st"), rng.choice(texts), 1440 * rng.randrange(40), rng.choice(["{}", '{"tz": "Europe/Berlin"}'])) for _ in range(150)]
    assert chain(spark, rows, 1) == chain(spark, rows, 7) == chain(spark, rows, 1000)


def test_long_text_with_a_zone_comment():
    assert first("2025-03-04 10:00 " + " " * 200 + "+01:00") == "2025-03-04 09:00:00"


def test_since():
    from lumenfold.functions.date_text import parse_since

    now = dt.datetime(2026, 8, 10, 12, tzinfo=dt.timezone.utc)
    for s, want in [("7d", "2026-08-03T12:00"), ("1w", "2026-08-03T12:00"), ("7 D", "2026-08-03T12:00"), ("2h", "2026-08-10T10:00"), ("30m", "2026-08-10T11:30"), ("2026-08-01", "2026-08-01T00:00")]:
        assert parse_since(s, now).isoformat().startswith(want)
    assert parse_since(" ", now) is None and parse_since(None, now) is None
    for bad in ("last tuesday", "7 fortnights", "99999999999999999999d"):
        with pytest.raises(ValueError):
            parse_since(bad, now)
