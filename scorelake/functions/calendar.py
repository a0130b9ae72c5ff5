"""Chinese holidays and solar terms, computed from the sun's longitude and the phases of the moon.

Low-precision series (errors of minutes) suffice: only the day in China Standard Time counts.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cache
from math import floor, radians, sin

# Names of festivals and solar terms with their dates.
SOLAR = {(1, 1): "元旦节", (2, 14): "情人节", (3, 8): "妇女节", (3, 12): "植树节", (4, 1): "愚人节", (5, 1): "劳动节", (5, 4): "青年节", (6, 1): "儿童节", (7, 1): "建党节", (8, 1): "建军节", (9, 10): "教师节", (10, 1): "国庆节", (12, 24): "平安夜", (12, 25): "圣诞节"}
LUNAR = {(1, 1): "春节", (1, 15): "元宵节", (2, 2): "龙抬头", (5, 5): "端午节", (7, 7): "七夕节", (7, 15): "中元节", (8, 15): "中秋节", (9, 9): "重阳节", (12, 8): "腊八节"}
EVE = "除夕"
TERMS = "小寒 大寒 立春 雨水 惊蛰 春分 清明 谷雨 立夏 小满 芒种 夏至 小暑 大暑 立秋 处暑 白露 秋分 寒露 霜降 立冬 小雪 大雪 冬至".split()

_EPOCH = date(2000, 1, 1)


def _day(jd: float) -> date:
    """The day in China of a Julian date in dynamical time."""
    return _EPOCH + timedelta(days=floor(jd - 2451544.5 + 8 / 24 - 70 / 86400))


def sun_longitude(jd: float) -> float:
    t = (jd - 2451545.0) / 36525
    g = radians(357.52911 + 35999.05029 * t)
    center = (1.914602 - 0.004817 * t) * sin(g) + 0.019993 * sin(2 * g) + 0.000289 * sin(3 * g)
    return (280.46646 + 36000.76983 * t + center - 0.00569 - 0.00478 * sin(radians(125.04 - 1934.136 * t))) % 360


@cache
def term(year: int, k: int) -> date:
    """The k-th solar term of a year, from 0 (小寒)."""
    goal = (285 + 15 * k) % 360
    jd = 2451544.5 + (date(year, 1, 5) - _EPOCH).days + 15.22 * k
    for _ in range(8):
        jd += ((goal - sun_longitude(jd) + 180) % 360 - 180) * 365.2422 / 360
    return _day(jd)


@cache
def new_moon(k: int) -> date:
    """The day of the k-th new moon since January 2000."""
    t = k / 1236.85
    jd = 2451550.09766 + 29.530588861 * k + 0.00015437 * t * t
    e = 1 - 0.002516 * t
    m, n = radians(2.5534 + 29.1053567 * k), radians(201.5643 + 385.81693528 * k + 0.0107582 * t * t)
    f, o = radians(160.7108 + 390.67050284 * k - 0.0016118 * t * t), radians(124.7746 - 1.56375588 * k)
    jd += -0.4072 * sin(n) + 0.17241 * e * sin(m) + 0.01608 * sin(2 * n) + 0.01039 * sin(2 * f) + 0.00739 * e * sin(n - m) - 0.00514 * e * sin(n + m)
    jd += 0.00208 * e * e * sin(2 * m) - 0.00111 * sin(n - 2 * f) - 0.00057 * sin(n + 2 * f) + 0.00056 * e * sin(2 * n + m) - 0.00042 * sin(3 * n)
    jd += 0.00042 * e * sin(m + 2 * f) + 0.00038 * e * sin(m - 2 * f) - 0.00024 * e * sin(2 * n - m) - 0.00017 * sin(o)
    return _day(jd)


@cache
def months(year: int) -> dict[int, date]:
    """First days of the lunar months 1 to 12 that begin in or after a year's new year; leap months are left out."""
    def first_with(solstice: date) -> int:
        k = round((solstice - _EPOCH).days / 29.530588861)
        while new_moon(k) > solstice:
            k -= 1
        while new_moon(k + 1) <= solstice:
            k += 1
        return k

    out: dict[int, date] = {}
    for y in (year, year + 1):  # months from the 11th before a year to the 10th in it
        a, b = first_with(term(y - 1, 23)), first_with(term(y, 23))
        number, leap = 11, b - a == 13
        for k in range(a, b):
            start, end = new_moon(k), new_moon(k + 1)
            middle = any(start <= term(t, z) < end for t in (y - 1, y) for z in range(1, 24, 2))
            if leap and not middle and k > a:
                leap = False
                continue
            if (y == year and number <= 10) or (y == year + 1 and number in (11, 12) and new_moon(k) < date(year + 1, 2, 25)):
                out[number] = start
            number = number % 12 + 1
    return out


@cache
def holidays(year: int) -> list[tuple[date, str, str]]:
    """(day, name, local or chinese) of the holidays in a calendar year, by day."""
    out = [(date(year, m, d), name, "local") for (m, d), name in SOLAR.items()]
    for y in (year - 1, year):
        first = months(y)
        out += [(first[m] + timedelta(days=d - 1), name, "chinese") for (m, d), name in LUNAR.items()]
        out.append((months(y + 1)[1] - timedelta(days=1), EVE, "chinese"))
    return sorted(h for h in out if h[0].year == year)


def between(start: date, end: date, kind: str = "all") -> list[str]:
    """Names of the holidays on days from start up to, not including, end."""
    found = [h for y in range(start.year, end.year + 1) for h in holidays(y)]
    return [name for day, name, k in found if start <= day < end and kind in ("all", k)]


def future(day: date, today: date, kind: str = "all") -> list[str]:
    """Holidays from a day to the last day of the current year."""
    return between(day, date(today.year, 12, 31), kind)


def past(day: date, today: date, kind: str = "all") -> list[str]:
    """Holidays from the first day of the current year to a day."""
    return between(date(today.year, 1, 1), day, kind)
