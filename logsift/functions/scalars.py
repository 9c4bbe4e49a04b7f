"""Scalar Column -> Column functions (all JVM-side, whole-stage-codegen friendly).

No Python UDFs here: every function returns a Catalyst expression.
Regexes carry ``(?U)`` so that ``\\s``, ``\\d``, ``\\w`` and ``\\b`` are Unicode-aware,
which is how the line shapes are defined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

U = "(?U)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- regex helpers -------------------------------------------------------------

def extract(c, pattern: str, group: int, unicode: bool = True) -> Column:
    """regexp_extract that yields NULL (not '') when the group did not take part."""
    pat = (U + pattern) if unicode else pattern
    return F.nullif(F.regexp_extract(_c(c), pat, group), F.lit(""))


def strip_unicode(c) -> Column:
    """Strip leading/trailing Unicode whitespace (NBSP included), like str.strip()."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


# --- numeric coercion (F8-F11, F25) --------------------------------------------

_FLOAT_TEXT = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$"
_INT_TEXT = r"^\s*[+-]?\d+\s*$"


def safe_float(c) -> Column:
    """float(x) or NULL: only texts Python's float() accepts, then try_cast."""
    c = _c(c)
    return F.when(c.rlike(_FLOAT_TEXT), F.trim(c).try_cast("double"))


def safe_int(c) -> Column:
    """int(x) for a JSON scalar seen as text: integers as-is, finite floats truncated."""
    c = _c(c)
    as_double = safe_float(c)
    return (
        F.when(c.rlike(_INT_TEXT), F.trim(c).try_cast("int"))
        .when(as_double.isNotNull() & ~F.isnan(as_double) & (F.abs(as_double) < 2.0 ** 31),
              F.when(as_double >= 0, F.floor(as_double)).otherwise(F.ceil(as_double)).cast("int"))
    )


def digits_int(c) -> Column:
    """CSV status: an all-digit cell becomes an int, anything else NULL."""
    c = _c(c)
    return F.when(c.rlike(r"^[0-9]+$"), c.try_cast("int"))


# --- free-text extraction (F3-F5) ------------------------------------------------

def level_from_text(c) -> Column:
    up = F.upper(_c(c))
    expr = None
    for lvl in P.TEXT_LEVEL_ORDER:
        cond = up.contains(lvl)
        expr = F.when(cond, F.lit(lvl)) if expr is None else expr.when(cond, F.lit(lvl))
    return expr.otherwise(F.lit("INFO"))


def status_from_text(c) -> Column:
    return extract(c, P.STATUS_IN_TEXT_RE, 1).try_cast("int")


def response_time_from_text(c) -> Column:
    ms = extract(c, P.MILLIS_IN_TEXT_RE, 1).try_cast("double")
    sec = extract(c, P.SECONDS_IN_TEXT_RE, 1).try_cast("double") * F.lit(1000.0)
    return F.coalesce(ms, sec)


# --- level and status weights (F6, F7, F16, F17) ----------------------------------

def level_weight(level) -> Column:
    up = F.upper(_c(level))
    expr = None
    for name, w in P.LEVEL_WEIGHTS.items():
        cond = up == F.lit(name)
        expr = F.when(cond, F.lit(float(w))) if expr is None else expr.when(cond, F.lit(float(w)))
    return expr.otherwise(F.lit(float(P.UNKNOWN_LEVEL_WEIGHT)))


def http_severity(status) -> Column:
    s = _c(status)
    return (
        F.when(s.isNull(), F.lit(1.0))
        .when(s < 300, F.lit(0.0))
        .when(s < 400, F.lit(1.0))
        .when(s < 500, F.lit(2.0))
        .otherwise(F.lit(4.0))
    )


def http_code(status) -> Column:
    return F.coalesce(_c(status), F.lit(200)).cast("double")


MAX_DOUBLE = 1.7976931348623157e308


def log1p0(c) -> Column:
    """log1p with a value for every input: null, NaN and negatives count as 0, infinity as the largest double."""
    v = F.nanvl(F.coalesce(_c(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.log1p(F.least(F.greatest(v, F.lit(0.0)), F.lit(MAX_DOUBLE)))


def error_keyword(message) -> Column:
    """1.0 if the message holds an error keyword as a whole word, else 0.0."""
    m = _c(message)
    return F.when(F.coalesce(m.rlike(U + P.ERROR_KEYWORD_RE), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def has_error_keyword(message) -> Column:
    return F.coalesce(_c(message).rlike(U + P.ERROR_KEYWORD_RE), F.lit(False))


def is_error_level(level) -> Column:
    return F.coalesce(F.upper(_c(level)).isin(*P.ERROR_LEVELS), F.lit(False))


# --- time (F13, F18-F20) -----------------------------------------------------------

def parse_ts(ts) -> Column:
    """Wall-clock timestamp (TIMESTAMP_NTZ) from ISO-like or Apache text; NULL if neither.

    An ISO offset is dropped, never applied: the hour is the hour written in the line.
    """
    t = _c(ts)
    # Apache times become ISO text first, so that no value passes through the session's zone
    month = F.ceil(F.instr(F.lit(P.MONTHS), F.substring(t, 4, 3)) / 3).cast("string")
    apache = F.when(t.rlike(P.APACHE_TIME_RE), F.concat(
        F.substring(t, 8, 4), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.substring(t, 1, 2), F.lit(" "),
        F.substring(t, 13, 8)))
    return F.coalesce(apache, t).try_cast("timestamp_ntz")


def seconds(ts_parsed) -> Column:
    """Seconds of a wall-clock time since 1970-01-01 00:00, without any zone."""
    t = _c(ts_parsed)
    return (F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
            + F.second(t)).cast("long")


def time_text(ts_parsed) -> Column:
    """'yyyy-MM-dd HH:mm:ss' of a wall-clock time."""
    return F.substring(_c(ts_parsed).cast("string"), 1, 19)


def hour_of_day(ts) -> Column:
    return F.coalesce(F.hour(parse_ts(ts)), F.lit(0)).cast("double")


def floor_minute(ts_parsed) -> Column:
    return minute_text(ts_parsed).cast("timestamp_ntz")


def minute_text(ts_parsed) -> Column:
    """Minute key as text 'yyyy-MM-dd HH:mm:ss' (portable across engines)."""
    return F.concat(F.substring(_c(ts_parsed).cast("string"), 1, 16), F.lit(":00"))


def clock_minute(ts_parsed) -> Column:
    """'HH:mm' — the date is dropped, so days fold together."""
    return F.substring(_c(ts_parsed).cast("string"), 12, 5)


# --- display helpers (F21-F24) -------------------------------------------------------

def score_band(score) -> Column:
    s = _c(score)
    expr = None
    for lo, name in P.SCORE_BANDS:
        expr = F.when(s >= lo, F.lit(name)) if expr is None else expr.when(s >= lo, F.lit(name))
    return expr.otherwise(F.lit("low"))


def ellipsize(c, n: int) -> Column:
    c = _c(c)
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, F.lit("…")).otherwise(F.lit("")))
