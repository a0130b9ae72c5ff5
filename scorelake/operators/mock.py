"""Mock rules: {{rule args}} in texts replaced by made-up values; the same seed gives the same values."""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import cache
from random import Random
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import calendar
from scorelake.functions.values import put

RULE = re.compile(r"\{\{([^{}]*)\}\}")


class Mocker(Protocol):
    """support: whether it knows a rule with these arguments. mock: a value, or None."""

    def support(self, rule: str, args: list[str]) -> bool: ...

    def mock(self, rule: str, args: list[str], draw: Random) -> str | None: ...


def _is_number(text: str) -> bool:
    return re.fullmatch(r"[+-]?\d+(\.\d+)?", text) is not None


_JAVA = [("yyyy", "%Y"), ("yy", "%y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")]


def java_date(moment: datetime, pattern: str) -> str:
    """A moment in a Java date pattern of the letters y M d H m s S, with quoted text."""
    out, codes = [], dict(_JAVA)
    short = {"M": moment.month, "d": moment.day, "H": moment.hour, "m": moment.minute, "s": moment.second}
    if pattern.count("'") % 2:
        raise ValueError(f"no date pattern: {pattern}")
    for m in re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|([^A-Za-z']+)", pattern):
        quoted, letters, _, other = m.groups()
        if quoted is not None or other:
            out.append(quoted if quoted is not None else other)
        elif letters[0] == "S":
            out.append(f"{moment.microsecond // 1000:03d}"[: len(letters)])
        elif letters in codes:
            out.append(moment.strftime(codes[letters]))
        elif letters in short:
            out.append(str(short[letters]))
        else:
            raise ValueError(f"no date pattern: {pattern}")
    return "".join(out)


#: What the arguments of a date rule are, by their kinds: d for a number of days, p for a pattern.
FORMS = {"": (), "d": ("most",), "p": ("pattern",), "dd": ("least", "most"), "dp": ("most", "pattern"), "ddp": ("least", "most", "pattern")}


@dataclass
class DateMocker:
    """date, future_date and past_date with [pattern], [days], [days pattern], [min max] or [min max pattern]."""

    now: datetime | None = None
    pattern: str = "yyyy-MM-dd HH:mm:ss"
    days: tuple[int, int] = (0, 7)

    def support(self, rule: str, args: list[str]) -> bool:
        return "date" in rule.lower()

    def parsed(self, args: list[str]) -> tuple[int, int, str]:
        """Least and most days and the pattern; kinds of arguments (d: days, p: pattern) that no form has are an error."""
        kinds = "".join("d" if _is_number(a) else "p" for a in args)
        if kinds not in FORMS:
            raise ValueError(f"Error parsing args: {' '.join(args)} is none of the forms {', '.join(FORMS)}")
        given = dict(zip(FORMS[kinds], args, strict=True))
        if any("." in given.get(k, "") for k in ("least", "most")):
            raise ValueError(f"Error parsing args: days are whole numbers, not {' '.join(args)}")
        least, most = (int(given.get(k, d)) for k, d in zip(("least", "most"), self.days, strict=True))
        pattern = given.get("pattern", self.pattern)
        try:
            java_date(datetime(2000, 1, 1), pattern)
        except ValueError as e:
            raise ValueError(f"Error parsing args: {e}") from e
        return least, most, pattern

    def mock(self, rule: str, args: list[str], draw: Random) -> str | None:
        way = {"date": 0, "future_date": 1, "past_date": -1}.get(rule.lower())
        if way is None:
            return None
        least, most, pattern = self.parsed(args)
        days = draw.randint(least, most) if way else 0
        return java_date((self.now or datetime.now()) + way * timedelta(days=days), pattern)


@dataclass
class HolidayMocker:
    """Names of holidays: {, local_, chinese_} x {any, future_, past_, between_} and solr_term_holiday."""

    today: date | None = None

    def support(self, rule: str, args: list[str]) -> bool:
        return "holiday" in rule

    def mock(self, rule: str, args: list[str], draw: Random) -> str | None:
        if rule == "solr_term_holiday":
            return draw.choice(calendar.TERMS)
        m = re.fullmatch(r"(future_|past_|between_|)(local_|chinese_|)holiday", rule)
        if not m:
            return None
        today, kind = self.today or date.today(), m[2].rstrip("_") or "all"
        day = lambda k: datetime.strptime(args[k], "%Y%m%d").date() if len(args) > k else today
        if m[1] == "future_":
            names = calendar.future(day(0), today, kind)
        elif m[1] == "past_":
            names = calendar.past(day(0), today, kind)
        elif m[1] == "between_":
            names = calendar.between(day(0), day(1), kind)
        else:
            names = [*calendar.SOLAR.values()] * (kind != "chinese") + [*calendar.LUNAR.values(), calendar.EVE] * (kind != "local")
        return draw.choice(names) if names else None


# Short names of regions.
SHORT_NAMES = {"内蒙古": "内蒙古自治区", "西藏": "西藏自治区", "广西": "广西壮族自治区", "宁夏": "宁夏回族自治区", "新疆": "新疆维吾尔自治区", "香港": "香港特别行政区", "澳门": "澳门特别行政区"}
#: A small sample (province, city, area, street); pass rows of your own for more.
ADDRESSES = (
    ("北京市", "北京市", "东城区", "东华门街道"), ("北京市", "北京市", "海淀区", "中关村街道"), ("上海市", "上海市", "黄浦区", "外滩街道"), ("广东省", "广州市", "天河区", "石牌街道"),
    ("广东省", "深圳市", "南山区", "粤海街道"), ("浙江省", "杭州市", "西湖区", "北山街道"), ("四川省", "成都市", "武侯区", "玉林街道"), ("内蒙古自治区", "呼和浩特市", "新城区", "海拉尔东路街道"),
    ("新疆维吾尔自治区", "乌鲁木齐市", "天山区", "燕儿窝街道"), ("河北省", "石家庄市", "长安区", "建北街道"),
)
#: A small sample (province, city, place).
PLACES = (("北京市", "北京市", "故宫博物院"), ("北京市", "北京市", "颐和园"), ("上海市", "上海市", "外滩"), ("浙江省", "杭州市", "西湖"), ("四川省", "成都市", "武侯祠"), ("广东省", "广州市", "白云山"))


def _under(rows, args: list[str], column: int) -> list[str]:
    """Different values of a column in rows that begin with args."""
    if len(args) > 3:
        raise ValueError(f"at most three places narrow a choice, not {' '.join(args)}")
    head = [SHORT_NAMES.get(a, a) if k == 0 else a for k, a in enumerate(args)]
    return [*dict.fromkeys(r[column] for r in rows if [*r[: len(head)]] == head)]


def table_rows(path: str, columns: tuple[str, ...]) -> tuple[tuple[str, ...], ...]:
    """Rows of a CSV file with a header, by the named columns; read once in each process, and small enough for it (a country's streets are some 10 MB)."""
    with open(path, encoding="utf-8", newline="") as f:
        return tuple(tuple(r[c] for c in columns) for r in csv.DictReader(f))


@cache
def _configured(name: str, columns: tuple[str, ...], sample: tuple) -> tuple:
    """Rows of the file that the environment names for a kind of places, or else the sample."""
    path = os.environ.get(f"SCORELAKE_{name}_TABLE", "")
    return table_rows(path, columns) if path else sample


def addresses() -> tuple:
    """(province, city, area, street) of the file in SCORELAKE_ADDRESS_TABLE on each executor, or a small sample."""
    return _configured("ADDRESS", ("province", "city", "area", "street"), ADDRESSES)


def places() -> tuple:
    """(province, city, place) of the file in SCORELAKE_PLACE_TABLE on each executor, or a small sample."""
    return _configured("PLACE", ("province", "city", "place"), PLACES)


def matching(rows: tuple, **given: str) -> list[dict[str, str]]:
    """Address rows with the given levels, by any of province, city, area and street; short names of regions count."""
    levels = ("province", "city", "area", "street")
    if unknown := set(given) - set(levels):
        raise ValueError(f"no level of an address: {', '.join(sorted(unknown))}")
    want = {levels.index(k): SHORT_NAMES.get(v, v) for k, v in given.items()}
    return [dict(zip(levels, r, strict=True)) for r in rows if all(r[k] == v for k, v in want.items())]


@dataclass
class AddressMocker:
    rows: tuple = field(default_factory=addresses)
    levels: tuple = ("province", "city", "area", "street")

    def support(self, rule: str, args: list[str]) -> bool:
        return rule.lower() in self.levels

    def mock(self, rule: str, args: list[str], draw: Random) -> str | None:
        level = self.levels.index(rule.lower())
        names = _under(self.rows, args[:level] if len(args) <= 3 else args, level)
        return draw.choice(names) if names else None


@dataclass
class PlaceMocker:
    rows: tuple = field(default_factory=places)

    def support(self, rule: str, args: list[str]) -> bool:
        return rule == "scenic"

    def mock(self, rule: str, args: list[str], draw: Random) -> str | None:
        names = _under(self.rows, args, 2)
        return draw.choice(names) if names else None


@dataclass
class Engine:
    """The last mocker that supports a rule gives its value; without one the rule becomes empty, or stays as it is."""

    mockers: list[Mocker] = field(default_factory=lambda: [DateMocker(), HolidayMocker(), AddressMocker(), PlaceMocker()])
    keep_unknown: bool = False

    def value(self, rule: str, draw: Random) -> str:
        name, *args = rule.split() or [""]
        found = next((m for m in reversed(self.mockers) if m.support(name, args)), None)
        value = found.mock(name, args, draw) if found else None
        return value if value is not None else f"{{{{{rule}}}}}" if self.keep_unknown else ""

    def filled(self, texts: list[str | None], seed: object, same: bool) -> list[str | None]:
        """Texts of one row with their rules replaced; same: one value for a rule in all of them."""
        draw, known = Random(str(seed)), {}

        def one(m: re.Match) -> str:
            rule = m[1]
            if not same:
                return self.value(rule.strip(), draw)
            if rule not in known:
                known[rule] = self.value(rule, draw) if rule == rule.strip() else m[0]
            return known[rule]

        return [t if not t else RULE.sub(one, t) for t in texts]


def mocked(df: DataFrame, fields: list[str], seed: int = 0, engine: Callable[[], Engine] = Engine, same: bool = False, key: str = "data_index") -> DataFrame:
    """Rules in fields of input_item replaced; a row that fails stays as it was. Values depend on seed and key only."""

    @F.pandas_udf("map<string,string>")
    def fill(items: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = engine()
        for keys, maps in items:
            out = []
            for k, m in zip(keys, maps, strict=True):
                row = dict(m) if m is not None else None
                some = [f for f in fields if row and row.get(f)]
                try:
                    row = row and row | dict(zip(some, made.filled([row[f] for f in some], (seed, k), same), strict=True))
                except Exception:  # the original row goes on
                    pass
                out.append(row)
            yield pd.Series(out)

    return df.withColumn("input_item", fill(F.col(key), F.col("input_item")))


def mock_text(text: Column, key: Column, seed: int = 0, engine: Callable[[], Engine] = Engine) -> Column:
    """A text column with its rules replaced."""

    @F.pandas_udf("string")
    def fill(texts: pd.Series, keys: pd.Series) -> pd.Series:
        made = engine()
        return pd.Series([made.filled([t], (seed, k), False)[0] for t, k in zip(texts, keys, strict=True)], dtype=object)

    return fill(text, key)


# --- rules as columns -------------------------------------------------------------------

#: Days of a date rule, and different rules of a table, up to which values are listed when a query is planned.
LISTED_DAYS, LISTED_RULES = 4000, 10_000
_TRIM = r"^\s+|\s+$"


def choices(rule: str, engine: Engine) -> list[str] | None:
    """All values that a rule may give with the library's own mockers, none for one without a value; None where they can't be listed: custom mockers, and dates over many days."""
    name, *args = rule.split() or [""]
    found = next((m for m in reversed(engine.mockers) if m.support(name, args)), None)
    if found is None:
        return []
    if type(found) is DateMocker:
        way = {"date": 0, "future_date": 1, "past_date": -1}.get(name.lower())
        if way is None:
            return []
        least, most, pattern = found.parsed(args)
        if least > most:
            raise ValueError(f"no days from {least} to {most}")
        if most - least >= LISTED_DAYS and way:
            return None
        now = found.now or datetime.now()
        return [java_date(now + way * timedelta(days=d), pattern) for d in (range(least, most + 1) if way else [0])]
    if type(found) in (HolidayMocker, AddressMocker, PlaceMocker):
        listed = _Lister()
        found.mock(name, args, listed)
        return listed.names
    return None


class _Lister(Random):
    """Takes note of what there is to choose from."""

    names: list[str] = []

    def choice(self, seq):
        self.names = [*seq]
        return self.names[0]


def _spelled(text: Column, key: Column, seed: int, known: dict[str, list[str]], same: bool, keep: bool) -> Column:
    """The text with its rules replaced by values of ``known``, drawn by hash of key, seed and the rule's place (or, with same, the rule)."""
    pattern = RULE.pattern
    table = F.create_map(*(x for rule, names in known.items() for x in (F.lit(rule), F.array(*map(F.lit, names)).cast("array<string>")))) if known else F.create_map().cast("map<string,array<string>>")

    def value(rule: Column, place: Column) -> Column:
        plain = F.regexp_replace(rule, _TRIM, "")
        names = F.try_element_at(table, plain)
        drawn = F.xxhash64(key, F.lit(seed), plain if same else place)
        text = F.when(F.size(names) > 0, F.get(names, F.pmod(drawn, F.size(names)).cast("int")))
        kept = F.concat(F.lit("{{"), rule if same else plain, F.lit("}}"))
        out = F.coalesce(text, kept if keep else F.lit(""))
        return F.when(plain == rule, out).otherwise(F.concat(F.lit("{{"), rule, F.lit("}}"))) if same else out

    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), value)
    parts = F.zip_with(F.split(text, pattern, -1), F.array_append(values, F.lit("")), lambda a, b: F.concat(a, b))
    return F.when(text.contains("{{"), F.array_join(parts, "")).otherwise(text)


def mock_known(text: Column, key: Column, rules: Iterable[str], seed: int = 0, engine: Callable[[], Engine] = Engine) -> Column:
    """A text column with its rules replaced, like mock_text, by column expressions alone: of rules that are known when the query is planned.

    Values are those of mock_text, draws aren't: they depend on key, seed and place in the text. Rules that aren't among the known
    ones count as unknown. The time of a date rule is that of the plan. A rule of a custom mocker is an error here.
    """
    made, known = engine(), {}
    for rule in rules:
        names = choices(rule.strip(), made)
        if names is None:
            raise ValueError(f"values of this rule can't be listed: {rule}")
        known[rule.strip()] = names
    return _spelled(text, key, seed, known, False, made.keep_unknown)


def rules_in(df: DataFrame, fields: list[str], most: int = LISTED_RULES) -> list[str] | None:
    """Different rules in fields of input_item, found by one pass over the table; None if there are more than ``most``."""
    texts = F.array_compact(F.array(*(F.try_element_at("input_item", F.lit(f)) for f in fields)))
    found = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(RULE.pattern), 1)))
    rows = df.select(F.explode(found).alias("rule")).select(F.regexp_replace("rule", _TRIM, "").alias("rule")).distinct().limit(most + 1).collect()
    return None if len(rows) > most else sorted(r.rule for r in rows)


def mocked_in_columns(df: DataFrame, fields: list[str], seed: int = 0, engine: Callable[[], Engine] = Engine, same: bool = False, key: str = "data_index") -> DataFrame:
    """Like mocked, by column expressions where all rules' values can be listed, else by mocked itself.

    One pass finds the different rules; their values are part of the plan. A row with a rule that fails stays
    as it was. Values depend on seed and key only, and are drawn otherwise than by mocked.
    """
    rules, made, known, wrong = rules_in(df, fields), engine(), {}, []
    if rules is None:
        return mocked(df, fields, seed, engine, same, key)
    for rule in rules:
        try:
            known[rule] = choices(rule, made)
        except Exception:  # rows that have it stay as they are
            wrong.append(rule)
    if None in known.values():
        return mocked(df, fields, seed, engine, same, key)
    item = F.col("input_item")
    out, failed = item, F.lit(False)
    for place, f in enumerate(fields):
        old = F.try_element_at(item, F.lit(f))
        if wrong:
            plain = F.transform(F.regexp_extract_all(F.coalesce(old, F.lit("")), F.lit(RULE.pattern), 1), lambda r: F.regexp_replace(r, _TRIM, ""))
            failed = failed | F.arrays_overlap(plain, F.array(*map(F.lit, wrong)))
        # fields of a row draw on their own, but for the same rule where that is wanted
        value = _spelled(old, F.col(key), seed if same else seed * 1000 + place, known, same, made.keep_unknown)
        out = F.when(old.isNotNull(), put(out, f, value)).otherwise(out)
    return df.withColumn("input_item", F.when(failed, item).otherwise(out))
