"""Texts of many formats, precisions and zones, normalised to one UTC instant or to the reason why there is none.

All formats are alternatives of ONE regular expression with named groups. A single ``regexp_replace`` turns a text
into its components (``${name}`` of a group that took no part is empty, so the alternatives' groups are simply set
side by side), the components are checked against the calendar, and the instant is put together by integer day
arithmetic. Everything is a column expression: nothing leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

US = 1_000_000
DAY_US = 86_400 * US

#: Minutes east of UTC of the zone abbreviations that are understood.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "AWST": 480, "AEST": 600, "AEDT": 660, "NZST": 720,
    "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_B = r"[\s\p{Z}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
_MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
_WEEKDAY = rf"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?{_B}+)?"
_DATES = [
    r"(?<ya>\d{4})[-/.](?<ma>\d{1,2})[-/.](?<da>\d{1,2})",
    r"(?<na>\d{1,2})(?<sep>[-/.])(?<nb>\d{1,2})[-/.](?<nc>\d{4}|\d{1,2})",
    rf"{_WEEKDAY}(?<dd>\d{{1,2}})(?:st|nd|rd|th)?(?:{_B}|-)+(?<md>{_MONTH})\.?,?(?:{_B}|-)+(?<yd>\d{{4}}|\d{{2}})",
    rf"{_WEEKDAY}(?<me>{_MONTH})\.?{_B}+(?<de>\d{{1,2}})(?:st|nd|rd|th)?,?{_B}+(?<ye>\d{{4}})",
]
_TIME = rf"(?:(?:T|,?{_B}+(?:at{_B}+)?)(?<ha>\d{{1,2}}):(?<ia>\d{{2}})(?::(?<sa>\d{{2}})(?:[.,](?<fa>\d+))?)?(?:{_B}*(?<ap>[AP])\.?M\b\.?)?)?"
_COMPACT = r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})(?:T?(?<hb>\d{2})(?<ib>\d{2})(?:(?<sb>\d{2})(?:[.,](?<fb>\d+))?)?)?"
_ZONE = (
    rf"(?:{_B}*(?<zs>[+-])(?<zh>\d{{2}}):?(?<zm>\d{{2}})?(?:{_B}*\[[A-Za-z_/+-]+\]|{_B}*\([^)]*\))?"
    rf"|{_B}*\[?(?<zr>[A-Za-z]+(?:/[A-Za-z_+-]+)+)\]?|{_B}*(?<zz>Z)|{_B}+\(?(?<za>[A-Z]{{2,5}})\)?)?"
)
_EPOCH = r"(?<ep>\d{19}|\d{16}|\d{13}|\d{9,10})(?:\.(?<ef>\d+))?"
PATTERN = rf"(?is)\A{_B}*(?:{_EPOCH}|(?:(?:{'|'.join(_DATES)}){_TIME}|{_COMPACT}){_ZONE}){_B}*\z"

#: Component -> the groups that may hold it; at most one of them does.
_PARTS = {
    "epoch": "ep", "epoch_frac": "ef", "y": "ya yb yd ye", "mo": "ma mb", "mon": "md me", "d": "da db dd de",
    "n1": "na", "sep": "sep", "n2": "nb", "n3": "nc", "h": "ha hb", "mi": "ia ib", "s": "sa sb", "frac": "fa fb",
    "ap": "ap", "sign": "zs", "zh": "zh", "zm": "zm", "region": "zr", "z": "zz", "abbr": "za",
}
_MARK, _SEP = "\u0001", "\u0002"
_REPLACEMENT = _MARK + _SEP.join("".join(f"${{{g}}}" for g in gs.split()) for gs in _PARTS.values())
#: A text already of the one normal form.
NORMAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z\z"


def known_regions(spark: SparkSession) -> list[str]:
    """Region names that both the JVM and Python know; a fixed set of a few hundred."""
    here = {z for z in zoneinfo.available_timezones() if "/" in z}
    try:
        there = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    except Exception:  # no JVM gateway, as over Spark Connect
        return sorted(here)
    return sorted(here & {str(z) for z in there})


def civil_days(y: str, m: str, d: str) -> str:
    """SQL text for the day number since 1970-01-01 of a proleptic Gregorian date, in integers only."""
    yy = f"({y} - CASE WHEN {m} <= 2 THEN 1 ELSE 0 END)"
    mm = f"(({m} + 9) % 12)"
    return f"(365 * {yy} + {yy} div 4 - {yy} div 100 + {yy} div 400 + (153 * {mm} + 2) div 5 + {d} - 1 - 719468)"


def month_length(y: str, m: str) -> str:
    leap = f"({y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0))"
    return f"(CASE WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END ELSE 31 END)"


def micros_to_ntz(micros: Column) -> Column:
    """The instant as ``timestamp_ntz`` in UTC, whatever the session's zone."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return epoch + F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / US).cast("decimal(18,6)"))


def micros_text(micros: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` of an instant, whatever the session's zone."""
    seconds = F.floor(micros / F.lit(US)).cast("bigint")
    whole = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    return F.concat(F.translate(whole.cast("string"), " ", "T"), F.lit("."), F.lpad((micros - seconds * US).cast("string"), 6, "0"), F.lit("Z"))


def _offset(micros: str, zone: str) -> str:
    """Microseconds that local time is ahead of UTC at an instant."""
    return f"(unix_micros(from_utc_timestamp(timestamp_micros({micros}), {zone})) - ({micros}))"


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns in a projection that is compiled into many small methods.

    In one method with all that is around it, as Spark makes by default, so many expressions are more than the JVM
    compiles, and it would interpret them, several times as slow. A lambda keeps a projection out of that; here it gives
    the first column as it is.
    """
    (name, first), *more = columns.items()
    apart = F.get(F.transform(F.array(first), lambda x: x), F.lit(0))
    return df.select("*", apart.alias(name), *[c.alias(n) for n, c in more])


def _settled(df: DataFrame, *names: str) -> DataFrame:
    """The columns through a generator of one row: filters on them aren't rewritten in terms of what they were made of,
    step by step, in which the expressions would be copied into each use and grow. Other filters pass."""
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def normalize_instants(
    df: DataFrame, text: str, zone: str | None = None, order: str | None = None, prefix: str = "instant"
) -> DataFrame:
    """Add ``{prefix}_us`` (microseconds since 1970 in UTC, or null) and ``{prefix}_reason``.

    ``zone`` and ``order`` name columns with the row's region name and ``MDY``/``DMY``/``YMD``; either may be null.
    The reason is null where there is an instant or the text is null; else the first that applies of ``invalid``,
    ``no_zone``, ``nonexistent`` and ``ambiguous``. A zone told by the text wins. Digits finer than a microsecond are
    dropped, a missing time is the start of the local day, two-digit years are 20xx, surrounding blanks of any kind
    do not matter. An all-numeric date whose order is not told (or told as year-first while the year stands last) is
    read in the only order that gives a date; where both do, dots mean day first and anything else is ``invalid``.
    An abbreviation or region that is not known, and a region in ``zone`` that is not known, tell no zone.
    Columns of ``df`` are kept, whatever their names; one named as a result is replaced by it.
    """
    results = {f"{prefix}_us", f"{prefix}_reason"}
    names = {c: f"__in{i}" for i, c in enumerate(df.columns)}
    out = _normalized(df.toDF(*names.values()), names[text], names[zone] if zone else None, names[order] if order else None, prefix)
    return out.select(*[F.col(new).alias(c) for c, new in names.items() if c not in results], f"{prefix}_us", f"{prefix}_reason")


def _normalized(df: DataFrame, text: str, zone: str | None, order: str | None, prefix: str) -> DataFrame:
    regions = known_regions(df.sparkSession)
    raw = F.col(text)
    parts = F.split(F.regexp_replace(raw, F.lit(PATTERN), F.lit(_REPLACEMENT)), _SEP, -1)
    names = list(_PARTS)
    out = _step(df, __p=F.when(raw.isNotNull(), parts))
    ok = (F.size("__p") == len(names)) & F.col("__p")[0].startswith(_MARK) & ~F.contains(raw, F.lit(_MARK))
    text_of = {n: F.nullif(F.get("__p", F.lit(i)), F.lit("")) for i, n in enumerate(names)}
    text_of["epoch"] = F.nullif(F.substring(F.get("__p", F.lit(0)), 2, 40), F.lit(""))
    number = lambda n: text_of[n].try_cast("bigint")
    order_col = F.col(order) if order else F.lit(None).cast("string")
    zone_col = F.col(zone) if zone else F.lit(None).cast("string")
    n1, n2, n3, year_last = number("n1"), number("n2"), number("n3"), F.length(text_of["n3"]) == 4
    shape = (
        F.when(order_col.isin("MDY", "DMY"), order_col)
        .when((order_col == "YMD") & ~year_last, F.lit("YMD"))
        .when((n1 > 12) & (n2 <= 12) | (text_of["sep"] == ".") | (n1 == n2), F.lit("DMY"))
        .when((n2 > 12) & (n1 <= 12), F.lit("MDY"))
    )
    century = lambda y: F.when(y < 100, y + 2000).otherwise(y)
    months = "janfebmaraprmayjunjulaugsepoctnovdec"
    named = ((F.position(F.lower(F.substring(text_of["mon"], 1, 3)), F.lit(months)) + 2) / 3).cast("bigint")
    numeric, y4 = text_of["n1"].isNotNull(), F.length(text_of["y"]) == 4
    us = lambda f: F.rpad(F.substring(F.coalesce(f, F.lit("")), 1, 6), 6, "0").cast("bigint")
    hour = number("h")
    components = {
        "__ok": ok,
        "__y": F.when(numeric, F.when(shape == "YMD", F.when(F.length(text_of["n1"]) > 1, century(n1))).when(F.length(text_of["n3"]) > 1, century(n3))).otherwise(F.when(y4, number("y")).otherwise(century(number("y")))),
        "__m": F.when(numeric, F.when(shape == "DMY", n2).when(shape == "MDY", n1).when(shape == "YMD", n2)).when(text_of["mon"].isNotNull(), named).otherwise(number("mo")),
        "__d": F.when(numeric, F.when(shape == "DMY", n1).when(shape == "MDY", n2).when(shape == "YMD", n3)).otherwise(number("d")),
        "__dateonly": hour.isNull(),
        "__h": F.when(hour.isNull(), F.lit(0)).when(text_of["ap"].isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(F.lower(text_of["ap"]) == "p", 12).otherwise(0)).otherwise(F.lit(99)),
        "__mi": F.coalesce(number("mi"), F.lit(0)),
        "__s": F.coalesce(number("s"), F.lit(0)),
        "__f": us(text_of["frac"]),
        "__epoch": number("epoch"),
        "__epoch_digits": F.length(text_of["epoch"]),
        "__epoch_f": us(text_of["epoch_frac"]),
        "__epoch_odd": (text_of["epoch_frac"].isNotNull() & (F.length(text_of["epoch"]) > 10)),
        "__off_min": F.when(text_of["sign"].isNotNull(), number("zh") * 60 + F.coalesce(number("zm"), F.lit(0))),
        "__off_m": F.coalesce(number("zm"), F.lit(0)),
        "__off_sign": F.when(text_of["sign"] == "-", -1).otherwise(1),
        "__abbr": F.coalesce(text_of["z"], text_of["abbr"]),
        "__region": text_of["region"],
    }
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    out = _step(out, **components).drop("__p")
    c = lambda n: F.col(f"__{n}")
    region = F.when(c("region").isNotNull(), F.when(c("region").isin(regions), c("region"))).otherwise(
        F.when(c("abbr").isNull() & (zone_col.isin(regions) | (zone_col == "UTC")), zone_col)
    )
    fixed = F.coalesce(c("off_min") * c("off_sign"), F.try_element_at(table, F.upper(c("abbr"))))
    date_ok = F.expr(f"__m BETWEEN 1 AND 12 AND __y BETWEEN 1 AND 9999 AND __d BETWEEN 1 AND {month_length('__y', '__m')}")
    valid = c("ok") & F.when(c("epoch").isNotNull(), ~c("epoch_odd")).otherwise(
        F.coalesce(date_ok, F.lit(False)) & (c("h") < 24) & (c("mi") < 60) & (c("s") < 60)
        & (c("off_min").isNull() | ((c("off_min") <= 18 * 60) & (c("off_m") < 60)))
    )
    epoch_us = (
        F.when(c("epoch_digits") <= 10, c("epoch") * US + c("epoch_f"))
        .when(c("epoch_digits") == 13, c("epoch") * 1000)
        .when(c("epoch_digits") == 16, c("epoch"))
        .otherwise(F.expr("__epoch div 1000"))
    )
    local = F.expr(f"{civil_days('__y', '__m', '__d')} * {DAY_US} + (__h * 3600 + __mi * 60 + __s) * {US} + __f")
    valid = F.coalesce(valid, F.lit(False))
    out = _step(out, __valid=valid, __l=F.when(valid & c("epoch").isNull(), local), __fixed=fixed.cast("bigint"), __tz=F.when(fixed.isNull(), region))
    # With at most one change of offset within a day of it, a local time has the offset of the day before, of the day
    # after, of both (then it happened twice if they differ) or of neither (then it was skipped).
    out = _step(out, **{
        "__a": F.when(F.col("__tz").isNotNull(), F.expr(f"__l - {_offset(f'__l - {DAY_US}', '__tz')}")),
        "__b": F.when(F.col("__tz").isNotNull(), F.expr(f"__l - {_offset(f'__l + {DAY_US}', '__tz')}")),
    })
    out = _step(out, **{
        "__va": F.expr(f"__a + {_offset('__a', '__tz')} = __l"),
        "__vb": F.expr(f"__b + {_offset('__b', '__tz')} = __l"),
    })
    twice = F.col("__va") & F.col("__vb") & (F.col("__a") != F.col("__b"))
    reason = (
        F.when(raw.isNull(), F.lit(None))
        .when(~F.col("__valid"), F.lit("invalid"))
        .when(c("epoch").isNotNull() | F.col("__fixed").isNotNull(), F.lit(None))
        .when(F.col("__tz").isNull(), F.lit("no_zone"))
        .when(c("dateonly"), F.lit(None))
        .when(~F.col("__va") & ~F.col("__vb"), F.lit("nonexistent"))
        .when(twice, F.lit("ambiguous"))
    )
    instant = (
        F.when(c("epoch").isNotNull(), epoch_us)
        .when(F.col("__fixed").isNotNull(), F.col("__l") - F.col("__fixed") * (60 * US))
        .when(F.col("__va") & F.col("__vb"), F.least("__a", "__b"))
        .when(F.col("__vb"), F.col("__b"))
        .otherwise(F.col("__a"))
    )
    out = _step(out, **{f"{prefix}_us": F.when(raw.isNotNull() & reason.isNull(), instant), f"{prefix}_reason": reason})
    return _settled(out.select(*df.columns, f"{prefix}_us", f"{prefix}_reason"), f"{prefix}_us", f"{prefix}_reason")
