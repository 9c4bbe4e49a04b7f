"""Spelling variants by a dictionary of trie-node pairs (operator 13).

Words are maximal runs of letters, A-Z lower-cased; of every 31st run (by a
checksum of document and run) one letter is left out, as a scanner would.
Of the different words with at least ``LETTERS`` letters and ``OCCURRENCES``
occurrences, two are near if they differ by exactly one inserted, deleted or
replaced code point.

1. The nodes of the trie of all words are numbered, and those of the trie of all
   reversed words.  Words are dealt into sorted ranges; within a range a word
   takes over the nodes of the one before it up to their common prefix and gets
   new numbers from there on, and ranges agree on their border words' nodes
   beforehand.  So a node has one number, and a word of n letters costs n numbers.
2. A word has the pairs (prefix node, suffix node) at each of its borders,
   and with each of its letters skipped.  Two words differ by a replaced letter
   exactly if they share a skipped pair, and by an inserted one exactly if a
   skipped pair of the longer is a border pair of the shorter.  (Letters that repeat
   the one before are not skipped for the latter, as they give the same word.)
3. Each pair's words are grouped.  A pair fixes all but one letter, so a group
   has at most one word per letter of the alphabet and the one without it.
   Every word takes from it the number of its near words and the most frequent one.
4. A word's form is its most frequent near word (ties: the first in code-point
   order), if that occurs at least ``TIMES`` as often.  Forms of forms are found by
   doubling the steps; counts grow tenfold with each, so few rounds do.

Defined results: a null or empty text has no words; a null id counts as empty
text in the checksum; repeated rows count each; further columns are ignored; an
empty table gives no words.  Runs may be of any length.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

LETTERS, OCCURRENCES, TIMES, EVERY = 7, 2, 10, 31
RANGE_CHARS = 2_000_000         # letters of a range of sorted words
PAIR_LETTERS = 50_000           # letters whose pairs are made together
_SHIFT = 40                     # a node or word is numbered by its range and a number within it

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The lower-cased runs of at least ``LETTERS`` letters (shorter ones can't become words)."""
    runs = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LETTERS},}}+"), F.lit(0))
    return F.transform(runs, lambda w: F.translate(w, _UPPER, _LOWER))


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word of all texts, after the deletions."""
    runs = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(words(F.col(f"`{text_col}`"))).alias("w"))
    hashed = runs.select("w", F.crc32(F.concat_ws(":", "id", "w").cast("binary")).alias("h"))
    cut = "concat(left(w, cast(h % char_length(w) as int)), substring(w, cast(h % char_length(w) as int) + 2))"
    return (hashed.select(F.expr(f"if(h % {EVERY} = 0, {cut}, w)").alias("word")).where(F.char_length("word") >= LETTERS)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def border_nodes(borders: list[tuple[int, str, str]]) -> dict[int, list[int]]:
    """The nodes of the first word of each range, from all ranges' numbers, first and last words in order.

    In range k the nodes of the first word that no earlier range has are ``k << _SHIFT`` plus their depth; those of
    the last word that the first doesn't have follow by depth, after all of the first word's.
    """
    out: dict[int, list[int]] = {}
    path, before = [], ""
    for k, first, last in borders:
        shared = common_prefix(before, first) + 1 if path else 0
        nodes = path[:shared] + [(k << _SHIFT) + i for i in range(shared, len(first) + 1)]
        out[k] = nodes
        common = common_prefix(first, last) + 1
        path = nodes[:common] + [(k << _SHIFT) + len(first) + 1 + i for i in range(common, len(last) + 1)]
        before = last
    return out


def range_nodes(k: int, sorted_words: list[str], first_nodes: list[int]):
    """The nodes of each word of a range, by depth."""
    first, last = sorted_words[0], sorted_words[-1]
    fresh = (k << _SHIFT) + len(first) + len(last) + 2
    nodes, before = first_nodes, first
    yield nodes
    for w in sorted_words[1:]:
        shared, on_last = common_prefix(before, w) + 1, common_prefix(w, last) + 1
        nodes = nodes[:shared] + [(k << _SHIFT) + len(first) + 1 + i for i in range(shared, on_last)]
        more = len(w) + 1 - len(nodes)
        nodes += range(fresh, fresh + more)
        fresh += more
        before = w
        yield nodes


def trie_nodes(table: DataFrame, column: str, out: str) -> DataFrame:
    """``table`` (different words in ``column``) with the word's number ``<out>_id``, by code-point order, and its trie
    nodes ``out``, from the root's on."""
    size = table.agg(F.sum(F.char_length(column) + 8)).first()[0] or 0
    ranges = max(1, -(-int(size) // RANGE_CHARS))
    ranged = materialize(table.repartitionByRange(ranges, column).withColumn("range", F.spark_partition_id()), "ranges")
    # two words of each range: their number doesn't grow with the words of a range
    borders = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.min(column), F.max(column)).collect())
    first_nodes = table.sparkSession.sparkContext.broadcast(border_nodes(borders))

    def number(t: pa.Table) -> pa.Table:
        k = t.column("range")[0].as_py()
        t = t.sort_by(column)       # by bytes of UTF-8, so by code points
        nodes = list(range_nodes(k, t.column(column).to_pylist(), first_nodes.value[k]))
        return (t.drop_columns(["range"]).append_column(f"{out}_id", pa.array((k << _SHIFT) + np.arange(t.num_rows)))
                .append_column(out, pa.array(nodes, pa.list_(pa.int64()))))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return ranged.groupBy("range").applyInArrow(number, f"{fields}, {out}_id long, {out} array<long>")


def node_pairs(words: list[str], prefix: np.ndarray, suffix: np.ndarray):
    """Prefix nodes, suffix nodes, kinds and words' places of the words' pairs: 0 at a border, 1 over a letter, 2 over one
    that repeats the letter before.  ``prefix`` and ``suffix``: the nodes of all words, and of all reversed words, in a row."""
    n = np.array([len(w) for w in words])
    word = np.repeat(np.arange(len(n)), n + 1)
    first = np.cumsum(n + 1) - (n + 1)
    depth = np.arange(len(word)) - first[word]
    ends = (first + n)[word]
    over = depth < n[word]              # the letter after this border
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    repeats = np.concatenate([[False], letters[1:] == letters[:-1]])[: len(letters)] & (depth[over] > 0)
    return (np.concatenate([prefix, prefix[over]]), np.concatenate([suffix[ends - depth], suffix[(ends - depth)[over] - 1]]),
            np.concatenate([np.zeros(len(word), np.int8), 1 + repeats.astype(np.int8)]), np.concatenate([word, word[over]]))


def _pairs(batches):
    """(word_id, n, word, prefix, suffix) to (p, s, kind, word_id, n)."""
    for batch in batches:
        words = batch.column(2).to_pylist()
        chunk = np.cumsum([len(w) for w in words]) // PAIR_LETTERS       # (a word over the limit is a chunk with those before it)
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(words)] if words else [0]
        for at, end in zip(cuts, cuts[1:]):
            part = batch.slice(at, end - at)
            p, s, kinds, word = node_pairs(words[at:end], part.column(3).flatten().to_numpy(), part.column(4).flatten().to_numpy())
            word_id, n = (part.column(i).to_numpy()[word] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, s, kinds, word_id, n)], names=["p", "s", "kind", "word_id", "n"])


def near_words(numbered: DataFrame) -> DataFrame:
    """(word_id, n_near, best_n, best_id) of the words (word, n, word_id, prefix, suffix) that have near ones."""
    pairs = numbered.select("word_id", "n", "word", "prefix", "suffix").mapInArrow(_pairs, "p long, s long, kind byte, word_id long, n long")
    groups = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("kind", "n", "word_id")).alias("m")).where("size(m) > 1")
    # skipped pairs share their word up to that letter; the border pair's word is it without the letter
    others = "filter(m, y -> y.word_id <> x.word_id and if(x.kind = 0, y.kind = 1, y.kind > 0 or x.kind = 1))"
    taken = groups.select(F.expr(f"inline(transform(m, x -> named_struct('word_id', x.word_id, 'others', {others})))"))
    return (taken.select("word_id", F.size("others").alias("near"),
                         F.expr("array_max(transform(others, y -> named_struct('n', y.n, 'first', -y.word_id)))").alias("best"))
            .where("near > 0").groupBy("word_id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
            .select("word_id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.first")).alias("best_id")))


def roots(forms: DataFrame) -> DataFrame:
    """(word_id, root_id) from (word_id, form_id), both of all words that have a form."""
    steps = materialize(forms.select("word_id", F.col("form_id").alias("root_id")), "steps")
    while True:
        on = steps.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("further"))
        if steps.join(on, "root_id", "left_semi").isEmpty():
            return steps
        steps = materialize(steps.join(on, "root_id", "left").select("word_id", F.coalesce("further", "root_id").alias("root_id")), "steps")


def variants(counts: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``counts`` (word, n: different words)."""
    ship_package(counts.sparkSession)
    forward = materialize(trie_nodes(counts.select("word", F.col("n").cast("long").alias("n")), "word", "prefix"), "forward")
    backward = trie_nodes(forward.select("prefix_id", F.reverse("word").alias("drow")), "drow", "suffix")
    numbered = (forward.join(backward.select("prefix_id", "suffix"), "prefix_id").withColumnRenamed("prefix_id", "word_id"))
    listed = forward.select(F.col("prefix_id").alias("word_id"), "word", "n")
    near = materialize(listed.join(near_words(numbered), "word_id", "left")
                       .withColumn("form_id", F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best_id"))), "near")
    root = roots(near.where("form_id is not null"))
    named = lambda x: listed.select(F.col("word_id").alias(f"{x}_id"), F.col("word").alias(x))
    return (near.join(root, "word_id", "left").join(named("form"), "form_id", "left").join(named("root"), "root_id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.when(F.col("form_id").isNotNull(), F.col("best_n")).alias("form_n")))


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of the words of all texts that occur at least ``OCCURRENCES`` times."""
    return variants(materialize(word_counts(df, id_col, text_col).where(F.col("n") >= OCCURRENCES), "words"))
