"""Date functions: one cascade for all forms that publishers use, and durations."""

from __future__ import annotations

import html
import re
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from itertools import groupby, product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import month_key

# Month names and abbreviations as publishers write them, without accents, by language.
MONTHS_DE = {"januar": 1, "jan": 1, "februar": 2, "feb": 2, "marz": 3, "maerz": 3, "mar": 3, "maer": 3, "april": 4, "apr": 4, "mai": 5, "juni": 6, "jun": 6, "juli": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "oktober": 10, "okt": 10, "november": 11, "nov": 11, "dezember": 12, "dez": 12}
MONTHS_EN = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12}
MONTHS_NL = {"januari": 1, "februari": 2, "maart": 3, "mrt": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "augustus": 8, "september": 9, "oktober": 10, "november": 11, "december": 12}
MONTHS_FR = {"janvier": 1, "janv": 1, "fevrier": 2, "fevr": 2, "mars": 3, "avril": 4, "avr": 4, "mai": 5, "juin": 6, "juillet": 7, "juil": 7, "aout": 8, "septembre": 9, "octobre": 10, "oct": 10, "novembre": 11, "decembre": 12, "dec": 12}
MONTHS_ES = {"enero": 1, "ene": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "ago": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12, "dic": 12}
MONTHS = MONTHS_DE | MONTHS_EN | MONTHS_NL | MONTHS_FR | MONTHS_ES
# Weekdays that may stand before a date.
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "lundi mardi mercredi jeudi vendredi samedi dimanche maandag dinsdag woensdag donderdag vrijdag zaterdag zondag "
    "lunes martes miercoles miércoles jueves viernes sabado sábado domingo"
).split()
# Texts that say that a date is missing, not that it is malformed. Spaces may be hyphens or absent, in the
# second row also underscores.
MISSING = ("n/a", "na", "none", "null", "unknown", "undated", "no date", "date to be announced", "not available", "not known", "not set", "tba", "tbd", "pending", "soon")
MISSING_TOO = ("noch nicht", "noch nicht veröffentlicht", "noch nicht bekannt", "nog niet", "nog niet bekend", "nog niet gepubliceerd", "keine angabe", "kein datum", "sin fecha", "sans date")

_JOINED = tuple(frozenset(p.replace(" ", "") for p in some if " " in p) for some in (MISSING, MISSING_TOO))
_ORDINAL = frozenset(("st", "nd", "rd", "th"))
#: Shapes of dates in words, see _shape(): (before the day, after the day, connector, after the month, connector).
_DAY_MONTH = frozenset(f"{w}d{o}{c}m{p}{e}y" for w, o, c, p, e in product(("", "W", "W,"), ("", ".", "o"), ("", "c"), ("", "."), ("", "c")))
_MONTH_DAY = frozenset(f"m{p}d{e}y" for p, e in product(("", "."), ("", ",")))


def _tokens(text: str) -> list[tuple[str, str, bool]]:
    """Runs of digits (n), runs of letters (w) and single marks, each with whether white space stands before it."""
    out, gap = [], False
    for kind, group in groupby(text, lambda c: " " if c.isspace() else "n" if c.isdecimal() else "w" if c.isalpha() else "."):
        said = "".join(group)
        if kind == ".":
            out += [(c, c, gap and i == 0) for i, c in enumerate(said)]
        elif kind != " ":
            out.append((kind, said, gap))
        gap = kind == " "
    return out


def _fraction(tokens: list[tuple[str, str, bool]]) -> bool | None:
    """Whether the fraction of an ISO time is well formed: one to nine digits, then nothing, Z or an offset. None without one."""
    kinds, said = "".join(k for k, _, _ in tokens), [t for _, t, _ in tokens]
    clock = next((c for c in ("n-n-nwn:n:n.", "n-n-nn:n:n.") if kinds.startswith(c)), None)
    at = len(clock or "")
    if not at or [len(t) for k, t, _ in tokens[:at] if k == "n"] != [4, 2, 2, 2, 2, 2] or (at == 12 and said[5] not in "Tt"):
        return None
    rest = tokens[at:]
    if any(gap for _, _, gap in rest) or not rest or rest[0][0] != "n" or len(said[at]) > 9:
        return False
    zone, words = kinds[at + 1 :], said[at + 1 :]
    if zone in ("+n:n", "-n:n"):
        return len(words[1]) == len(words[3]) == 2 and int(words[1]) < 24 and int(words[3]) < 60
    return not words or words == ["Z"]


def _shape(tokens: list[tuple[str, str, bool]]) -> str:
    """One letter a token: W weekday, d day, y year, o ordinal ending, c connector, m any other word, marks as they are."""
    out = ""
    for at, (kind, said, gap) in enumerate(tokens):
        low = said.lower()
        if kind == "n":
            out += "y" if len(said) == 4 else "d" if len(said) < 3 else "?"
        elif kind != "w":
            out += kind
        elif low in WEEKDAYS:
            out += "W"
        elif low in _ORDINAL and not gap and out[-1:] == "d":
            out += "o"
        else:
            # What follows a day in words, and the year, stand apart.
            out += ("c" if low == "de" and out else "m") if gap or not at or out[-1] in "W," else "?"
    return out


def _in_words(tokens: list[tuple[str, str, bool]]) -> datetime | None:
    """Day, month and year in figures, or with the month in words."""
    shape, said = _shape(tokens), {}
    for letter, token in zip(shape, tokens, strict=True):
        said.setdefault(letter, token)
    if shape == "d.d.y":
        return datetime(int(tokens[4][1]), int(tokens[2][1]), int(tokens[0][1]))
    if shape not in _DAY_MONTH | _MONTH_DAY or not said["y"][2] or (shape[0] == "m" and not said["d"][2]):
        return None
    after = shape.index("m") + 1
    month = MONTHS.get(month_key(said["m"][1])) if shape[after] != "." or not tokens[after][2] else None
    return datetime(int(said["y"][1]), month, int(said["d"][1])) if month else None


#: The form of most dates: a day, or a second in UTC.
_ISO = re.compile("[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}Z?)?")


def parse(value: str | None) -> datetime | None:
    """Time in UTC: ISO, then mail dates, then dates in figures or words. None for all else."""
    text = html.unescape(value or "").strip()
    if not text:
        return None
    if _ISO.fullmatch(text):
        try:
            return datetime.fromisoformat(text).replace(tzinfo=UTC)
        except ValueError:
            pass
    tokens = _tokens(text)
    if _fraction(tokens) is False:
        return None
    for read in (datetime.fromisoformat, parsedate_to_datetime, lambda _: _in_words(tokens)):
        try:
            found = read(text)
            return found and (found.astimezone(UTC) if found.tzinfo else found.replace(tzinfo=UTC))
        except (ValueError, TypeError, IndexError, OverflowError):
            continue
    return None


def missing(text: str) -> bool:
    """Whether a text says that there is no date."""
    low = text.lower()
    joined = low.replace(" ", "").replace("-", "")
    return low in MISSING or joined in _JOINED[0] or joined.replace("_", "") in _JOINED[1]


def problem(value: str | None) -> str | None:
    """What is wrong with a date that is neither empty, missing on purpose nor readable."""
    text = html.unescape(value or "").strip()
    return f"date could not be parsed: {text!r}" if text and not missing(text) and parse(text) is None else None


@F.pandas_udf(T.TimestampType())
def parse_datetime(value: pd.Series) -> pd.Series:
    found = [parse(None if v is None or v != v else v) for v in value]
    return pd.Series(pd.to_datetime(found, utc=True)).astype("datetime64[us, UTC]").dt.tz_localize(None)


@F.pandas_udf(T.StringType())
def date_problem(value: pd.Series) -> pd.Series:
    return pd.Series([problem(None if v is None or v != v else v) for v in value], dtype=object)


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, half to even; null if the end comes first."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(micros >= 0, F.bround(micros / 1000).cast("long"))


def lenient_timestamp(value: Column) -> Column:
    """Timestamp of ISO-like text, else null. Text without an offset is in UTC, whatever the session's zone."""
    said = F.when(value.rlike(r"T.*(Z|[+-]\d\d:\d\d)$"), value).otherwise(F.concat(value, F.lit("Z")))
    read = lambda form: F.try_to_timestamp(said, F.lit(form + "XXX"))
    # One form fits at most, and trying those that don't takes far longer than telling them apart.
    return F.when(value.contains("T"), read("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")).when(value.contains(" "), read("yyyy-MM-dd HH:mm:ss[.SSSSSS]")).when(value.contains("."), read("dd.MM.yyyy")).when(value.contains("-"), read("yyyy-MM-dd"))


#: Microseconds of an hour, a minute, a second and of one.
_CLOCK = (3_600_000_000, 60_000_000, 1_000_000, 1)


def _utc(at: Column, between: str, clock: str, *units: int) -> Column:
    """Day and time of day in UTC as text, whatever the session's zone; the clock has one part a unit."""

    def said(micros: Column) -> Column:
        rest = F.pmod(micros, F.lit(86_400_000_000))
        parts = [F.floor(F.pmod(rest, F.lit(turn)) / unit) for unit, turn in zip(units, (86_400_000_000, *units), strict=False)]
        return F.concat(F.date_format(F.date_from_unix_date(((micros - rest) / 86_400_000_000).cast("int")), "yyyy-MM-dd"), F.lit(between), F.format_string(clock, *parts))

    return F.get(F.transform(F.array(F.unix_micros(at)), said), F.lit(0))  # so that a time is read once, not once a part


def strict_timestamp(value: Column) -> Column:
    """Timestamp of ISO text that states its offset; null for all else."""
    text = F.trim(value)
    return F.when(text.rlike(r"^(\d{4}|[+]\d{5,})-\d\d-\d\d[Tt ]\d\d:\d\d(:\d\d([.]\d+)?)?\s*([Zz]|[+-]\d\d:?\d\d)$"), F.coalesce(text.try_cast("timestamp"), lenient_timestamp(F.upper(text))))


def score(value: Column) -> Column:
    """Seconds since 1970 of ISO-like text, less than any time for what can't be read."""
    return F.coalesce(F.unix_micros(lenient_timestamp(value.cast("string"))) / 1e6, F.lit(float("-inf")))


def first_valid(*values: Column) -> Column:
    """(value, score) of the first value that is a time; a null value if none is."""
    found = [F.when(lenient_timestamp(v.cast("string")).isNotNull(), F.struct(v.cast("string").alias("value"), score(v).alias("score"))) for v in values]
    return F.coalesce(*found, F.struct(F.lit(None).cast("string").alias("value"), F.lit(float("-inf")).alias("score")))


def stamp(value: Column) -> Column:
    """A time as ISO text in UTC; other text stays as it is, empty text is null."""
    text = F.nullif(F.trim(value), F.lit(""))
    return F.coalesce(_utc(lenient_timestamp(text), "T", "%02d:%02d:%02d.%06dZ", *_CLOCK), text)


def bounds(first: Column, last: Column) -> tuple[Column, Column]:
    """Aggregates (first, last) over raw times: in time if all can be read, else in the order of the texts."""
    values = [F.nullif(F.trim(c), F.lit("")) for c in (first, last)]
    opaque = F.coalesce(F.bool_or((values[0].isNotNull() & lenient_timestamp(values[0]).isNull()) | (values[1].isNotNull() & lenient_timestamp(values[1]).isNull())), F.lit(False))
    low, high = F.coalesce(values[0], values[1]), F.greatest(values[0], values[1])
    by_time = F.when(lenient_timestamp(values[0]) >= lenient_timestamp(values[1]), values[0]).otherwise(F.coalesce(values[1], values[0]))
    return (
        F.when(opaque, F.min(low)).otherwise(F.min_by(low, lenient_timestamp(low))),
        F.when(opaque, F.max(high)).otherwise(F.max_by(by_time, lenient_timestamp(by_time))),
    )


def display(raw: Column) -> Column:
    """Time as shown: a date stays a date, a time is in UTC to the minute, other text stays as it is."""
    text = F.trim(raw)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(F.coalesce(_utc(lenient_timestamp(text), " ", "%02d:%02d UTC", *_CLOCK[:2]), text))


SQL_FUNCTIONS = {"parse_datetime": parse_datetime, "date_problem": date_problem}
