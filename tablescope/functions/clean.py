"""Row-wise cleaning as column expressions: missing tokens, numbers, dates, times of day."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.plans.wide import quoted

# What a CSV cell must hold to count as missing at parse time.
CSV_MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# What a cell of a numeric text column must hold to count as missing.
NUMERIC_MISSING_TOKENS = ["", "-", "--", "NA", "N/A", "na", "n/a", "null", "NULL", "None", "none", "."]

# What counts as white space around a cell.
WHITE = " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"

# Fixed values: (shape of the text, date pattern) pairs of the general datetime parse.
GENERAL_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-M-d H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", "yyyy/M/d H:mm"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    # Where the first number can be no month, it is the day.
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm:ss a"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$", "yyyy-M-d h:mm:ss a"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4} \d{1,2}:\d{2}:\d{2}$", "d-MMM-yyyy H:mm:ss"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{8} \d{1,2}:\d{2}$", "yyyyMMdd H:mm"),
    (r"^\d{8} \d{1,2}:\d{2}:\d{2}$", "yyyyMMdd H:mm:ss"),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^\d{4}/\d{1,2}$", "yyyy/M"),
    (r"^\d{8}$", "yyyyMMdd"),
]

# Chinese dates, tried as whole-column alternatives in this order.
CJK_FORMATS = [
    (r"^\d{4}年\d{1,2}月\d{1,2}日 \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy年M月d日 H:m:s"),
    (r"^\d{4}年\d{1,2}月\d{1,2}日 \d{1,2}:\d{1,2}$", "yyyy年M月d日 H:m"),
    (r"^\d{4}年\d{1,2}月\d{1,2}日$", "yyyy年M月d日"),
    (r"^\d{4}年\d{1,2}月$", "yyyy年M月"),
]

_ISO = r"\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}"
ZONED = rf"^{_ISO}(:\d{{2}}(\.\d{{1,9}})?)?(Z|[+-]\d{{2}}:?\d{{2}})$"
FINE = rf"^{_ISO}:\d{{2}}\.\d{{7,9}}$"  # finer than microseconds: cut

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_supported(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or is_temporal(dtype) or isinstance(dtype, (T.StringType, T.BooleanType))


def tidy(df: DataFrame) -> DataFrame:
    """One way of saying missing and one way of telling time: NaN becomes null, times lose their zone."""
    out = []
    for field in df.schema.fields:
        c = F.col(quoted(field.name))
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(field.dataType))
        elif isinstance(field.dataType, (T.TimestampType, T.DateType)):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(field.name))
    return df.select(*out)


def finite(c: Column) -> Column:
    """Infinities (and NaN) become missing."""
    d = c.cast("double")
    return F.when((F.abs(d) < float("inf")), d)


def strip(c: Column) -> Column:
    """Text without white space around it, tabs, line ends and wide blanks included."""
    return F.btrim(c, F.lit(WHITE))


def _stripped_sql(name: str) -> str:
    return f"btrim({quoted(name)}, '{WHITE}')"


def without_tokens(c: Column, tokens: list[str] = NUMERIC_MISSING_TOKENS) -> Column:
    text = strip(c)
    return F.when(~text.isin(tokens), text)


def to_number(c: Column) -> Column:
    """Text to double; anything pandas would not read as a number becomes missing."""
    text = without_tokens(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _parse_sql(ref: str, shape: str, pattern: str) -> str:
    # Testing the shape first keeps failed parses, which are slow, rare.
    return f'CASE WHEN {ref} RLIKE r"{shape}" THEN CAST(try_to_timestamp({ref}, r"{pattern}") AS TIMESTAMP_NTZ) END'


def parse_format(name: str, shape: str, pattern: str) -> Column:
    return F.expr(_parse_sql(_stripped_sql(name), shape, pattern))


def _skeletons(shape: str) -> list[str]:
    """What is left of the texts of a shape without their digits, every letter as ``a``."""
    found = [""]
    for digits, first, last, letters, other in re.findall(r"(\\d(?:\{[\d,]+\})?)|\[A-Za-z\]\{(\d),?(\d?)\}|(\[AaPp\]\[Mm\])|\\?(.)", shape.strip("^$")):
        if first:
            found = [f + "a" * n for f in found for n in range(int(first), int(last or first) + 1)]
        elif letters:
            found = [f + "aa" for f in found]
        elif not digits:
            found = [f + ("a" if other.isalpha() else other) for f in found]
    return found


def _by_skeleton() -> dict[str, list[str]]:
    """For each skeleton the formats to try, by number, in their order."""
    out: dict[str, list[str]] = {}
    for i, (shape, _) in enumerate(GENERAL_FORMATS):
        for skeleton in _skeletons(shape):
            out.setdefault(skeleton, []).append(i)
    return out


def parse_general(name: str) -> Column:
    """The first general format whose shape fits the text column ``name``.

    A text without its digits and with all letters alike is its skeleton; it names the one or two formats that are tried.
    Times with ``Z`` or an offset become the time in UTC; what is finer than microseconds is cut.
    """
    ref = _stripped_sql(name)
    letters = string.ascii_letters
    skeleton = f"translate({ref}, '{letters}{string.digits}', '{'a' * len(letters)}')"
    fine = f'CASE WHEN {ref} RLIKE r"{FINE}" THEN try_cast({ref} AS TIMESTAMP_NTZ) END'
    cases: dict[tuple[int, ...], list[str]] = {}
    for known, formats in _by_skeleton().items():
        cases.setdefault(tuple(formats), []).append(known)
    branches = []
    for formats, known in cases.items():
        tries = [_parse_sql(ref, *GENERAL_FORMATS[i]) for i in formats] + ([fine] if any(k.endswith(":.") for k in known) else [])
        tested = " OR ".join(f"{skeleton} = '{k}'" for k in known)
        branches.append(f"WHEN {tested} THEN coalesce({', '.join([*tries, 'NULL'])})")
    zoned = f'CASE WHEN {ref} RLIKE r"{ZONED}" THEN CAST(to_utc_timestamp(try_cast({ref} AS TIMESTAMP), current_timezone()) AS TIMESTAMP_NTZ) END'
    return F.expr(f"CASE {' '.join(branches)} ELSE {zoned} END")


def parse_compact(c: Column) -> Column:
    """Whole numbers such as 20230105 (or their text) as dates."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("timestamp_ntz"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, exact and independent of the session zone."""
    seconds = (ts.cast("timestamp_ntz") - F.expr(EPOCH)).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("long")


def epoch_ms(ts: Column) -> Column:
    return micros(ts) / 1000.0


def from_micros(us: Column) -> Column:
    """Inverse of ``micros``."""
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / 1_000_000).cast("decimal(18,6)"))


HHMM_LIMIT = 2359


def _seconds_from_hhmm(number: Column) -> Column:
    n = F.rint(finite(number))
    hour, minute = F.floor(n / 100), n % 100
    fits = (n >= 0) & (n <= HHMM_LIMIT) & (hour <= 23) & (minute <= 59)
    return F.when(fits, hour * 3600 + minute * 60).cast("long")


CLOCK_SECONDS = r"^\d{1,2}:\d{1,2}:\d{1,2}$"
CLOCK_MINUTES = r"^\d{1,2}:\d{1,2}$"


def _seconds_from_clock(text: Column) -> Column:
    parts = F.split(text, ":")
    hour, minute = parts[0].try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    second = F.coalesce(F.get(parts, F.lit(2)).try_cast("int"), F.lit(0))
    shaped = text.rlike(CLOCK_SECONDS) | text.rlike(CLOCK_MINUTES)
    return F.when(
        shaped & (hour <= 23) & (minute <= 59) & (second <= 61), hour * 3600 + minute * 60 + second
    ).cast("long")


def is_clock_text(c: Column) -> Column:
    return _seconds_from_clock(strip(c)).isNotNull()


def seconds_of_day(c: Column, dtype: T.DataType) -> Column:
    """``HH:MM:SS``, ``HH:MM`` or a number ``HHMM`` as seconds after midnight."""
    if is_numeric(dtype):
        return _seconds_from_hhmm(c)
    if is_temporal(dtype):
        return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    text = without_tokens(c)
    return F.coalesce(_seconds_from_clock(text), _seconds_from_hhmm(to_number(text)))


def time_of_day(c: Column, dtype: T.DataType) -> Column:
    """Time of day placed on 1900-01-01."""
    seconds = seconds_of_day(c, dtype)
    return F.expr("TIMESTAMP_NTZ'1900-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )


def combine_date_time(date: Column, time: Column) -> Column:
    """The day of ``date`` at the time of day of ``time``."""
    seconds = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    return F.to_date(date).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )
