"""Parsers from lines to the unified log table.

Each parser is a pure projection over its input rows (no shuffle), so it keeps
the scan order that ``number_rows`` relies on.  Output columns (before the line
number is added): ``_path, _block, raw_line, timestamp, message, level,
http_status, response_size, response_time, client_ip, component``.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from .records import csv_records
from .text import BLOCK, MID, PATH, SENT_SPLITS

UNIFIED = ["raw_line", "timestamp", "message", "level", "http_status",
           "response_size", "response_time", "client_ip", "component"]


def _row(raw, ts, msg, level, status, size, rtime, ip, comp) -> Column:
    return F.struct(
        raw.alias("raw_line"), ts.cast("string").alias("timestamp"),
        msg.cast("string").alias("message"), level.cast("string").alias("level"),
        status.cast("int").alias("http_status"), size.cast("double").alias("response_size"),
        rtime.cast("double").alias("response_time"), ip.cast("string").alias("client_ip"),
        comp.cast("string").alias("component"),
    )


def _null() -> Column:
    return F.lit(None)


def raw_text_columns(line: Column) -> Column:
    """One struct per line, Apache first, then syslog, then free text."""
    ap = {i: S.extract(line, P.APACHE_RE, i) for i in range(1, 7)}
    sy = {i: S.extract(line, P.SYSLOG_RE, i) for i in range(1, 5)}
    is_apache = line.rlike(S.U + P.APACHE_RE)
    is_syslog = line.rlike(S.U + P.SYSLOG_RE)

    status = ap[5].try_cast("int")
    apache = _row(
        line, ap[2],
        F.concat_ws(" ", F.coalesce(ap[3], F.lit("")), F.coalesce(ap[4], F.lit(""))),
        F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO"),
        status, S.safe_float(ap[6]), _null(), ap[1], _null(),
    )
    syslog = _row(
        line, sy[1], F.coalesce(sy[4], F.lit("")),
        F.upper(F.coalesce(sy[2], F.lit("INFO"))),
        _null(), _null(), _null(), _null(), sy[3],
    )
    free = _row(
        line, _null(), line, S.level_from_text(line),
        S.status_from_text(line), _null(), S.response_time_from_text(line), _null(), _null(),
    )
    return F.when(is_apache, apache).when(is_syslog, syslog).otherwise(free)


def parse_raw(lines: DataFrame) -> DataFrame:
    """Raw text: input (_path, _block, line) non-blank stripped lines.

    The row struct is unpacked by ``inline`` (a Generate), which the optimizer
    does not collapse into the consumers, so each regex runs once per line.
    """
    return lines.select(PATH, BLOCK, F.inline(F.array(raw_text_columns(F.col("line")))))


# --- NDJSON -----------------------------------------------------------------------

def _first_key(m: Column, keys: list[str], default: Column) -> Column:
    """P5: value of the first key *present* in the map (presence beats null)."""
    expr = None
    for k in keys:
        cond = F.map_contains_key(m, F.lit(k))
        expr = F.when(cond, m[k]) if expr is None else expr.when(cond, m[k])
    return expr.otherwise(default)


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """One JSON object per line; malformed lines are dropped."""
    # parse once (Generate barrier), then filter on the parsed map
    parsed = lines.select(PATH, BLOCK, F.inline(F.array(F.struct(
        F.col("line").alias("line"),
        F.when(F.col("line").startswith("{") & F.col("line").endswith("}"),
               F.from_json("line", "map<string,string>", {"allowSingleQuotes": "false"})).alias("m"),
    )))).where(F.col("m").isNotNull())
    m = F.col("m")
    A = P.JSON_ALIASES
    level_present = None
    for k in A["level"]:
        c = F.map_contains_key(m, F.lit(k))
        level_present = c if level_present is None else (level_present | c)
    level = _first_key(m, A["level"], F.lit("INFO"))
    # str(None).upper(): a present-but-null level reads as NONE
    level = F.upper(F.when(level_present & level.isNull(), F.lit("None")).otherwise(level))
    row = _row(
        F.col("line"),
        _first_key(m, A["timestamp"], F.lit("")),
        F.coalesce(_first_key(m, A["message"], F.lit("")), F.lit("")),
        level,
        S.safe_int(_first_key(m, A["status"], _null())),
        S.safe_float(_first_key(m, A["size"], _null())),
        S.safe_float(_first_key(m, A["time"], _null())),
        _null(), _null(),
    )
    return parsed.select(PATH, BLOCK, F.inline(F.array(row)))


# --- CSV ---------------------------------------------------------------------------

def normalise_header(names: list[str]) -> list[str]:
    """Strip, lower, space -> '_'; duplicates made unique by position."""
    out, seen = [], {}
    for n in names:
        k = (n or "").strip().lower().replace(" ", "_")
        if k in seen:
            seen[k] += 1
            k = f"{k}_{seen[k]}"
        else:
            seen[k] = 0
        out.append(k)
    return out


def pick_alias(columns: list[str], aliases: list[str]) -> str | None:
    """First alias present among the (normalised) columns, per file."""
    for a in aliases:
        if a in columns:
            return a
    return None


def csv_header(first_line: str) -> tuple[str, ...]:
    """The normalised names of a CSV file's first line."""
    return tuple(normalise_header(next(csv.reader([first_line]), [])))


def resolves(header: tuple[str, ...]) -> bool:
    """Whether any name of the header is a known one."""
    return any(pick_alias(list(header), aliases) for aliases in P.CSV_ALIASES.values())


def header_layout(header: tuple[str, ...]) -> dict[str, int | None]:
    """P4 as data: the number of a header's cells and the place of each role's cell (None: no such cell).

    A header that names no known column says nothing about its rows: ``cells`` is None, and rows are never too wide.
    """
    places = {r: header.index(c) if (c := pick_alias(list(header), a)) else None for r, a in P.CSV_ALIASES.items()}
    return {"cells": len(header) if resolves(header) else None} | places


LINE, CELLS = "_line", "_cells"
LAYOUT = ["cells", *P.CSV_ALIASES]
LAYOUT_SCHEMA = ", ".join(f"{c} int" for c in LAYOUT)
# a comma and one cell: quoted with doubled quotes inside (what follows its end is left out), or plain
_CELL = r',("[^"]*+(?:""[^"]*+)*+(?:"|\z)|[^,]*+)'


def _cells(line) -> Column:
    plain = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    return F.transform(plain, lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, r'\A"|"\z', ""), '""', '"'))
                       .otherwise(c))


def _lines_without_header(spark, files: list[str]) -> DataFrame:
    """(_path, _block, _line): the CSV reader leaves out each file's first line; a line stays whole and splittable."""
    return (spark.read.schema(f"{LINE} string").option("header", True).option("sep", "\u0001").option("quote", "")
            .option("maxCharsPerColumn", -1).csv(files)
            .select(F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias(BLOCK), LINE)
            .where(F.col(LINE).isNotNull() & (F.trim(LINE) != "")))


def _laid_out(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Rows with their cells and their file's layout, which is one row of a few numbers for each file."""
    if layouts.count() > SENT_SPLITS:       # a shuffled join would lose the rows' order
        raise ValueError(f"more than {SENT_SPLITS} CSV files in one read")
    known = layouts.select(F.col("path").alias(PATH), F.struct(*LAYOUT).alias("_layout"))
    return rows.join(F.broadcast(known), PATH, "left").withColumn(CELLS, _cells(F.col(LINE)))


_FITS = "_layout.cells is null or size(_cells) <= _layout.cells"


def read_csv_rows(spark, files: list[str], layouts: DataFrame, *, multiline: bool = False, fitting: bool = True) -> DataFrame:
    """CSV rows of any headers in one frame: _path, _block, _line, _cells and _layout; those that fit their header, or those
    with surplus cells.  ``layouts``: path and ``LAYOUT`` of each file.

    ``multiline`` also reads line ends inside quoted cells, in as many tasks as the files have splits.
    """
    wanted = _FITS if fitting else f"not ({_FITS})"
    if not multiline:
        return _laid_out(_lines_without_header(spark, files), layouts).where(wanted)
    records = csv_records(spark, files, lambda df: _laid_out(df, layouts).where(wanted).drop(CELLS, "_layout"))
    return _laid_out(records, layouts)


def bad_csv_lines(rows: DataFrame) -> DataFrame:
    """Rows of ``read_csv_rows`` with more cells than the header."""
    return rows.select(F.col(PATH).alias("path"), F.col(LINE).alias("line"), F.lit("more cells than the header").alias("reason"))


def parse_csv_rows(rows: DataFrame) -> DataFrame:
    """S3 on the rows of ``read_csv_rows``: roles are looked up in each file's layout, so all files are one plan branch."""
    def cell(role):
        return F.nullif(F.get(CELLS, F.col(f"_layout.{role}")), F.lit(""))

    # as many cells as the header has names; short rows get empty ones
    padded = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_layout.cells"), F.lit(1)) - 1),
                         lambda i: F.coalesce(F.get(F.col(CELLS), i.cast("int")), F.lit("")))
    raw = F.array_join(F.when(F.col("_layout.cells").isNull(), F.col(CELLS)).otherwise(padded), " ")
    row = _row(raw, cell("timestamp"), F.coalesce(cell("message"), F.lit("")), F.upper(F.coalesce(cell("level"), F.lit("INFO"))),
               S.digits_int(cell("status")), S.safe_float(cell("size")), S.safe_float(cell("time")), _null(), _null())
    return rows.select(PATH, BLOCK, *([MID] if MID in rows.columns else []), F.inline(F.array(row)))


def bad_json_lines(lines: DataFrame) -> DataFrame:
    """Lines that ``parse_json_lines`` leaves out."""
    m = F.from_json("line", "map<string,string>", {"allowSingleQuotes": "false"})
    good = F.col("line").startswith("{") & F.col("line").endswith("}") & m.isNotNull()
    return lines.where(~F.coalesce(good, F.lit(False))).select(
        F.col(PATH).alias("path"), "line", F.lit("not a JSON object").alias("reason"))
