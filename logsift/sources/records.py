"""CSV records with line ends inside quoted cells, read in splits (S3).

Only the state in which a line is entered tells whether it begins a record: in
the open, or inside a quoted cell.  A line therefore maps each of the two states to
the state after it, and such maps are put together before the state is known:

1. every split's lines are put together to the split's map, from two Booleans a line
   that native patterns give (the text stays in the JVM);
2. per file, a window over the splits, one row each, gives the state at each split's start;
3. with that state, every split cuts its lines into records.  The piece that a split
   leaves open is completed by the next splits' leading pieces, joined by window over the
   pieces at borders, at most two a split.

A file of any size is read by as many tasks as it has splits, and a record may span
several splits.  Lines end at ``\n``; a ``\r`` before it is a part of the line's end outside
quoted cells and is kept inside them.  A cell is quoted if it begins with a quote; quotes
elsewhere are plain characters, and what follows a closing quote belongs to the cell's
end.  A quoted cell that the file leaves open ends with the file.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .text import BLOCK, MID, PATH, SENT_SPLITS

RECORD = "_line"
_QUOTED_REST = r'[^"]*+(?:""[^"]*+)*+'          # the inside of a quoted cell, up to its closing quote
_CELLS = rf'(?:(?:"{_QUOTED_REST}"[^,]*+|(?!")[^,]*+),)*+'     # whole cells, each with the comma after it
OPEN_FROM_START = rf'\A{_CELLS}"{_QUOTED_REST}\z'
OPEN_FROM_QUOTED = rf'\A{_QUOTED_REST}(?:\z|"[^,]*+,{_CELLS}"{_QUOTED_REST}\z)'


def physical_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(_path, _block, line, open_start, open_quoted): every line, and whether it ends inside a quoted cell if it is entered
    in the open, or inside one."""
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias(BLOCK), F.col("value").alias("line"))
    plain = ~F.col("line").contains('"')
    return lines.select(
        PATH, BLOCK, "line",
        F.when(plain, F.lit(False)).otherwise(F.col("line").rlike(OPEN_FROM_START)).alias("open_start"),
        F.when(plain, F.lit(True)).otherwise(F.col("line").rlike(OPEN_FROM_QUOTED)).alias("open_quoted"))


def states(open_start: np.ndarray, open_quoted: np.ndarray, state: bool) -> np.ndarray:
    """The state before each line and after the last one (True: inside a quoted cell)."""
    n = len(open_start)
    fixed, turned = open_start == open_quoted, open_start & ~open_quoted
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1)) if n else np.zeros(0, int)
    turns = np.concatenate([[0], np.cumsum(turned)])
    begin = np.where(last >= 0, open_start[last], state) if n else np.zeros(0, bool)
    after = begin ^ ((turns[1:] - np.where(last >= 0, turns[last + 1], 0)) % 2 == 1)
    return np.concatenate([[state], after])


def _runs(batch):
    """(first row, row after the last, path, block) of a batch's runs of one split."""
    path, block = batch.column(0), batch.column(1).to_numpy()
    ids = path.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *cuts.tolist(), len(block)] if len(block) else [0]
    for a, b in zip(edges, edges[1:]):
        yield a, b, path[a].as_py(), int(block[a])


def _flags(batch, a: int, b: int, at: int):
    return [batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (at, at + 1)]


def _split_maps(batches):
    """(_path, _block, open_start, open_quoted) of lines to that of their splits."""
    found: dict[tuple, list[bool]] = {}
    for batch in batches:
        for a, b, path, block in _runs(batch):
            flags = _flags(batch, a, b, 2)
            have = found.setdefault((path, block), [False, True])
            found[path, block] = [bool(states(*flags, have[i])[-1]) for i in (0, 1)]
    paths, blocks = zip(*found) if found else ((), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(blocks, pa.int64()),
         *(pa.array([x[i] for x in found.values()], pa.bool_()) for i in (0, 1))], names=[PATH, BLOCK, "open_start", "open_quoted"])


def split_states(lines: DataFrame) -> DataFrame:
    """(_path, _block, inside): the state at the start of each split."""
    maps = materialize(lines.select(PATH, BLOCK, "open_start", "open_quoted").mapInArrow(
        _split_maps, f"{PATH} string, {BLOCK} long, open_start boolean, open_quoted boolean"), "split-maps")
    order = Window.partitionBy(PATH).orderBy(BLOCK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = maps.withColumn("turns", F.sum((F.col("open_start") & ~F.col("open_quoted")).cast("int")).over(order))
    fixed = F.when(F.col("open_start") == F.col("open_quoted"), F.struct("open_start", "turns"))
    known = turns.select(PATH, BLOCK, F.last(fixed, ignorenulls=True).over(before).alias("fixed"),
                         F.coalesce(F.lag("turns").over(order), F.lit(0)).alias("turns"))
    odd = (F.col("turns") - F.coalesce(F.col("fixed.turns"), F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("fixed.open_start"), F.lit(False))
    return materialize(known.select(PATH, BLOCK, F.when(odd, ~inside).otherwise(inside).alias("inside")), "split-states")


def _cut(batches):
    """Lines with their split's state to records (_path, _block, kind, text).

    kind 0: a whole record; 1: one that the split leaves open; 2: the end of an earlier split's, or a piece of it.
    ``head`` marks the first record of a file.
    """
    key, state, held, began, head = None, False, [], True, False

    def rows(texts, kind, first=False):
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1])), pa.array(np.full(n, kind, np.int32)),
             pa.array(texts, pa.string()), pa.array([first] * n)], names=[PATH, BLOCK, "kind", "text", "head"])

    def left():
        # what is held when a split ends began in it, or not even that
        return rows(["\n".join(held)], 1 if began else 2, head)

    for batch in batches:
        for a, b, path, block in _runs(batch):
            if (path, block) != key:
                if key and held:
                    yield left()
                key, held = (path, block), []
                state = bool(batch.column(5)[a].as_py())
                began, head = not state, block == 0
            after = states(*_flags(batch, a, b, 3), state)
            lines = batch.column(2).slice(a, b - a)
            ends = np.flatnonzero(~after[1:])           # lines that end a record
            if not len(ends):
                held += lines.to_pylist()
                state = bool(after[-1])
                continue
            first = "\n".join([*held, *lines.slice(0, int(ends[0]) + 1).to_pylist()])
            yield rows([first], 0 if began else 2, head)
            began, head = True, False
            offsets = pa.array((ends + 1).astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n") if len(ends) > 1 else pa.array([], pa.string())
            if len(joined):
                yield rows(joined, 0)
            held = lines.slice(int(ends[-1]) + 1).to_pylist()
            state = bool(after[-1])
    if key and held:
        yield left()


def csv_records(spark: SparkSession, files: list[str], prune: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(_path, _block, _mid, _line) of every record of the files but their first (the header) and blank ones.

    ``prune`` may leave out rows of a frame with ``_path`` and ``_line``.  ``_mid`` orders a split's records and has no gaps.
    """
    ship_package(spark)
    lines = physical_lines(spark, files)
    starts = split_states(lines)
    n = starts.count()
    if n > SENT_SPLITS:     # a shuffled join would lose the lines' order
        raise ValueError(f"{n} splits; raise spark.sql.files.maxPartitionBytes until there are at most {SENT_SPLITS}")
    inside = F.coalesce("inside", F.raise_error(F.lit("a split appeared between two passes over the files")).cast("boolean"))
    pieces = (lines.join(F.broadcast(starts), [PATH, BLOCK], "left")
              .select(PATH, BLOCK, "line", "open_start", "open_quoted", inside.alias("inside"))
              .mapInArrow(_cut, f"{PATH} string, {BLOCK} long, kind int, {RECORD} string, head boolean"))

    def wanted(df: DataFrame) -> DataFrame:
        return prune(df.withColumn(RECORD, F.regexp_replace(RECORD, "\r$", "")).where((F.trim(RECORD) != "") & ~F.col("head")))

    # both kinds come from one written table; a record that stays open is its split's last, so its loss makes no gap
    pieces = materialize(pieces.withColumn("at", F.monotonically_increasing_id()), "pieces")
    whole = wanted(pieces.where("kind = 0"))
    order = Window.partitionBy(PATH).orderBy(BLOCK, F.desc("kind"), "at")
    border = (pieces.where("kind > 0").withColumn("record", F.sum((F.col("kind") == 1).cast("int")).over(order))
              .withColumn("place", F.row_number().over(order)))
    joined = border.groupBy(PATH, "record").agg(
        F.min_by(BLOCK, "place").alias(BLOCK), F.min_by("at", "place").alias("at"), F.bool_or("head").alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", RECORD))), lambda x: x[RECORD]), "\n").alias(RECORD))
    records = whole.select(PATH, BLOCK, "at", RECORD).unionByName(wanted(joined).select(PATH, BLOCK, "at", RECORD))
    place = F.row_number().over(Window.partitionBy(PATH, BLOCK).orderBy("at"))
    return records.select(PATH, BLOCK, place.cast("long").alias(MID), RECORD)
