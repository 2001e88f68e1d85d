"""Every reading of a feed's date text as an instant in UTC.

`readings(text, fetched, order, zone)` returns a list of
(epoch_microseconds, format_name, prior_cost).  Several readings arise from
numeric day/month order, two-digit years, local times that a daylight-saving
change repeats or skips, and zone abbreviations that several zones share.  A
reading that breaks a rule the source declares (its `date_order`) costs
RULE_BREAK, more than the neighbours of one record can outweigh.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTC = timezone.utc
RULE_BREAK = 20.0
UNLIKELY = 5.0
OTHER_ORDER = 0.5
OTHER_ZONE = 1.0
FOLD_LATER = 0.1

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
FLOOR_US = int((datetime(2000, 1, 1, tzinfo=UTC) - EPOCH).total_seconds()) * 1_000_000
DAY_US = 86_400_000_000

# Month names by language, in month order.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
}
MONTHS: dict[str, int] = {}
for _names in MONTH_NAMES.values():
    for _i, _n in enumerate(_names.split(), 1):
        MONTHS[_n] = _i
        if len(_n) > 3:
            MONTHS.setdefault(_n[:3], _i)
        MONTHS.setdefault(_n[:4], _i)
MONTHS["sept"] = 9
MONTHS["jän"] = MONTHS["jänner"] = 1
MONTHS["mrz"] = 3

# Offsets in minutes of zone abbreviations, used when the
# source's own zone does not use the abbreviation itself.
ABBREVIATIONS = {
    "UTC": 0, "UT": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570,
    "AWST": 480, "NZST": 720, "NZDT": 780, "HKT": 480, "SGT": 480, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240,
}
UNSHARED = {"UTC", "UT", "GMT", "Z"}
# Further offsets in minutes of abbreviations that several zones share.
SHARED = {"CST": (480, -300), "IST": (120, 60), "BST": (360,), "AST": (180,)}

ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925}
UNIT_SECONDS = {
    "second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800,
    "month": 30 * 86400, "year": 365 * 86400,
    "秒": 1, "分": 60, "分間": 60, "時間": 3600, "日": 86400, "日間": 86400, "週間": 604800,
    "か月": 30 * 86400, "ヶ月": 30 * 86400, "カ月": 30 * 86400, "月": 30 * 86400, "年": 365 * 86400,
}

_AGO = re.compile(r"(?:about\s+)?(\d{1,6}|an?)\s+(second|sec|minute|min|hour|day|week|month|year)s?\s+ago", re.I)
_MAE = re.compile(r"(?:約\s*)?(\d{1,6})\s*(秒|分間|分|時間|日間|日|週間|か月|ヶ月|カ月|月|年)前")
_EPOCH = re.compile(r"(?:/Date\()?(-?\d{9,16})(?:\.\d+)?(?:\)/)?")
_WEEKDAY = re.compile(r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", re.I)
_PAREN_DAY = re.compile(r"\s*\([月火水木金土日](?:曜日?)?\)")

_NAME = r"[^\W\d_]+"
_DATES = [
    ("ymd", re.compile(r"(?P<y>\d{4})([-/.])(?P<m>\d{1,2})\2(?P<d>\d{1,2})(?!\d)")),
    ("compact", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?=T|\s|$)")),
    ("cjk", re.compile(r"(?P<y>\d{4})年\s*(?P<m>\d{1,2})月\s*(?P<d>\d{1,2})日")),
    ("era", re.compile(r"(?P<era>令和|平成|昭和)\s*(?P<ey>\d{1,2}|元)年\s*(?P<m>\d{1,2})月\s*(?P<d>\d{1,2})日")),
    ("d_name_y", re.compile(rf"(?P<d>\d{{1,2}})(?:er)?\.?[\s-]+(?P<n>{_NAME})\.?[\s,-]+(?P<y>\d{{4}}|\d{{2}})(?![\d:])")),
    ("name_d_y", re.compile(rf"(?P<n>{_NAME})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?!\d)")),
    ("asctime", re.compile(rf"(?P<n>{_NAME})\s+(?P<d>\d{{1,2}})\s+(?P<time>\d{{1,2}}:\d{{2}}(?::\d{{2}})?)\s+(?:(?P<zone>[A-Z]{{2,5}})\s+)?(?P<y>\d{{4}})$")),
    ("numeric", re.compile(r"(?P<a>\d{1,2})([-/.])(?P<b>\d{1,2})\2(?P<y>\d{4}|\d{2})(?!\d)")),
]
_TIME = re.compile(
    r"^(?:[T,\s]|\bà\b|\bat\b|\bum\b|\bà\s)*"
    r"(?P<h>\d{1,2})(?:[:h]|時)(?P<mi>\d{1,2})(?:分|(?=\D|$))(?:[:]?(?P<s>\d{1,2})(?:[.,](?P<f>\d{1,12}))?秒?)?"
    r"\s*(?P<ap>[AaPp]\.?[Mm]\.?(?![A-Za-z]))?(?:\s*Uhr)?\s*"
)
_COMPACT_TIME = re.compile(r"^T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d{1,12}))?")
_OFFSET = re.compile(r"^(?:UTC|GMT)?\s*([+-−])(\d{1,2})(?::?(\d{2}))?(?::\d{2})?$")
_ZONE_NAME = re.compile(r"^[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+$")


@lru_cache(maxsize=1024)
def zone_of(name: str | None):
    """ZoneInfo of a zone name, or None when it is absent or unknown."""
    if not name:
        return None
    try:
        return ZoneInfo(name)
    except Exception:
        return None


@lru_cache(maxsize=16384)
def _abbreviation_minutes(abbr: str, zone_name: str | None, year: int) -> tuple[int, ...]:
    """Offsets an abbreviation may stand for, the likeliest first: what the
    source's own zone calls so, else all that share it."""
    if abbr not in UNSHARED:
        zone = zone_of(zone_name)
        if zone is not None:
            for month in (1, 7):
                at = datetime(year, month, 1, tzinfo=zone)
                if at.tzname() == abbr:
                    return (int(at.utcoffset().total_seconds() // 60),)
    if abbr not in ABBREVIATIONS:
        return ()
    return (ABBREVIATIONS[abbr], *SHARED.get(abbr, ()))


def _micros(at: datetime) -> int:
    delta = at - EPOCH
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def _local_instants(naive: datetime, zone) -> list[tuple[int, float]]:
    """Instants of a wall-clock time: two where the clock was set back or on."""
    first = _micros(naive.replace(tzinfo=zone))
    second = _micros(naive.replace(tzinfo=zone, fold=1))
    return [(first, 0.0)] if first == second else [(first, 0.0), (second, FOLD_LATER)]


def _year(text: str) -> int:
    y = int(text)
    return y if len(text) > 2 else (2000 + y if y < 70 else 1900 + y)


def _zone_instants(rest: str, naive: datetime, zone_name: str | None):
    """Instants for the zone text behind the time; None when it is unreadable."""
    rest = rest.strip()
    if rest.endswith("]") and "[" in rest:
        head, _, inner = rest[:-1].partition("[")
        rest = head.strip() or inner.strip()
    if not rest:
        return _local_instants(naive, zone_of(zone_name) or UTC)
    if rest in ("Z", "z"):
        return [(_micros(naive.replace(tzinfo=UTC)), 0.0)]
    if rest.startswith("(") and rest.endswith(")"):
        rest = rest[1:-1]
    m = _OFFSET.match(rest)
    if m:
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        if minutes > 18 * 60:
            return None
        minutes = minutes if m[1] == "+" else -minutes
        return [(_micros(naive.replace(tzinfo=UTC)) - minutes * 60_000_000, 0.0)]
    if _ZONE_NAME.match(rest):
        named = zone_of(rest)
        return None if named is None else _local_instants(naive, named)
    if rest.isalpha() and rest.isascii():
        offsets = _abbreviation_minutes(rest.upper(), zone_name, naive.year)
        if offsets:
            return [(_micros(naive.replace(tzinfo=UTC)) - x * 60_000_000, OTHER_ZONE * (i > 0)) for i, x in enumerate(offsets)]
    return None


def _relative(s: str, fetched_us: int):
    low = s.lower()
    if low in ("just now", "now", "たった今", "今"):
        return 0
    if low in ("yesterday", "昨日", "gestern", "hier"):
        return 86400
    m = _AGO.fullmatch(s)
    if m:
        n = 1 if m[1].lower() in ("a", "an") else int(m[1])
        return n * UNIT_SECONDS[m[2].lower()]
    m = _MAE.fullmatch(s)
    if m:
        return int(m[1]) * UNIT_SECONDS[m[2]]
    return None


def _calendar(kind: str, m: re.Match, order: str | None):
    """(year, month, day, format, cost) readings of the matched date part."""
    if kind == "numeric":
        a, b, y = int(m["a"]), int(m["b"]), m["y"]
        own, other = (order, RULE_BREAK) if order in ("dmy", "mdy") else ("dmy", OTHER_ORDER)
        out = []
        for o in ("dmy", "mdy"):
            d, mo = (a, b) if o == "dmy" else (b, a)
            if a == b and o != own:
                continue
            out.append((_year(y), mo, d, f"numeric_{o}", 0.0 if o == own else other))
        if len(y) == 2:
            out.append((_year(m["a"]) if len(m["a"]) == 2 else 0, b, int(y), "numeric_ymd2", other + UNLIKELY))
        return out
    if kind == "era":
        y = ERAS[m["era"]] + (1 if m["ey"] == "元" else int(m["ey"]))
        return [(y, int(m["m"]), int(m["d"]), "era", 0.0)]
    if kind in ("d_name_y", "name_d_y", "asctime"):
        month = MONTHS.get(m["n"].lower())
        if month is None:
            return []
        return [(_year(m["y"]), month, int(m["d"]), kind, 0.0)]
    return [(int(m["y"]), int(m["m"]), int(m["d"]), kind, 0.0)]


def readings(text: str | None, fetched_us: int | None, order: str | None, zone_name: str | None):
    """All readings of text, cheapest first; [] when it cannot be read.

    Readings before 2000 or over a day after the fetch are left out, as are
    texts that hold anything besides a date, a time and a zone."""
    if text is None:
        return []
    s = unicodedata.normalize("NFKC", text).strip()
    if not s:
        return []
    found: list[tuple[int, str, float]] = []
    if fetched_us is not None:
        back = _relative(s, fetched_us)
        if back is not None:
            found.append((fetched_us - back * 1_000_000, "relative", 0.0))
    m = _EPOCH.fullmatch(s)
    if m and not found:
        n = int(m[1])
        digits = len(m[1].lstrip("-"))
        unit = {9: 1_000_000, 10: 1_000_000, 12: 1000, 13: 1000, 15: 1, 16: 1}.get(digits)
        if unit:
            found.append((n * unit, "epoch", 0.0))
    if not found:
        s = _PAREN_DAY.sub("", _WEEKDAY.sub("", s))
        for kind, pattern in _DATES:
            m = pattern.match(s)
            if not m:
                continue
            rest = s[m.end():]
            hour = minute = second = micro = 0
            if kind == "asctime":
                parts = [int(x) for x in m["time"].split(":")]
                hour, minute, second = (parts + [0])[:3]
                rest = m["zone"] or ""
            elif rest.strip():
                t = (_COMPACT_TIME.match(rest) if kind == "compact" else None) or _TIME.match(rest)
                if not t:
                    continue
                hour, minute, second = int(t["h"]), int(t["mi"]), int(t["s"] or 0)
                micro = int((t["f"] or "0")[:6].ljust(6, "0"))
                half = t.groupdict().get("ap")
                if half:
                    if not 1 <= hour <= 12:
                        continue
                    hour = hour % 12 + (12 if half[0] in "pP" else 0)
                rest = rest[t.end():]
            leap = second == 60
            for y, mo, d, name, cost in _calendar(kind, m, order):
                try:
                    naive = datetime(y, mo, d, hour if hour < 24 or minute or second else 0, minute, 59 if leap else second, micro)
                    if hour == 24:
                        naive += timedelta(days=1)
                except ValueError:
                    continue
                if naive.year < 1971 or naive.year > 9998:
                    continue
                instants = _zone_instants(rest, naive, zone_name)
                for us, extra in instants or []:
                    found.append((us, name, cost + extra))
            if found:
                break
    top = None if fetched_us is None else fetched_us + DAY_US
    kept = [r for r in found if r[0] >= FLOOR_US and (top is None or r[0] <= top)]
    kept.sort(key=lambda r: (r[2], r[0]))
    return kept


def _first_by_rule(text, fetched, order, zone):
    got = [r for r in readings(text, None if pd.isna(fetched) else int(fetched), order, zone) if r[2] < RULE_BREAK]
    return got[0][0] if got else None


@F.pandas_udf(T.LongType())
def _parsed_us(text: pd.Series, fetched_us: pd.Series, order: pd.Series, zone: pd.Series) -> pd.Series:
    return pd.Series([_first_by_rule(*x) for x in zip(text, fetched_us, order, zone)], dtype="Int64")


def parse_date(text: Column, fetched: Column, order: Column, zone: Column) -> Column:
    """Instant of a date text read on its own: its cheapest reading that keeps the
    declared order; null where there is none."""
    return F.timestamp_micros(_parsed_us(text, F.unix_micros(fetched), order, zone))


def zone_offset_minutes(at: Column, zone: Column) -> Column:
    """Minutes a zone is ahead of UTC at an instant; null for an unknown zone."""
    known = F.when(zone.isin(sorted(available_timezones())), zone)
    return ((F.unix_micros(F.from_utc_timestamp(at, known)) - F.unix_micros(at)) / 60_000_000).cast("int")


_BACK = re.compile(r"(\d{1,9})\s*([smhdw])", re.I)
_BACK_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_since(text: str | None, now: datetime) -> datetime | None:
    """The instant of a `since` argument: `7d` back from now, or a date.  Blank
    means no bound; anything unreadable raises, so that a typo never widens a
    search to everything."""
    if text is None or not text.strip():
        return None
    s = text.strip()
    m = _BACK.fullmatch(s)
    if m:
        try:
            return now - timedelta(seconds=int(m[1]) * _BACK_SECONDS[m[2].lower()])
        except OverflowError:
            raise ValueError(f"since: {text!r} is out of range") from None
    got = readings(s, None, "dmy", None)
    if not got:
        raise ValueError(f"since: {text!r} is not a time")
    return EPOCH + timedelta(microseconds=got[0][0])
