"""Near-duplicate documents by HyperMinHash banding, estimation and exact verification (operator 1).

A document's set holds its distinct shingles of five lower-cased words (the
whole sequence, if it has fewer; nothing, if it has none).  Two documents are
linked when ``100 * |A & B| >= 75 * |A | B|``; the result gives each
document's component of the link graph, named by its smallest doc_id.

1. One pass over the texts hashes the shingles and keeps per document a
   HyperMinHash sketch: in each of 72 buckets the smallest hash as its
   leading-zero count plus ten mantissa bits (16 bits).  Empty buckets of short
   texts borrow from others by a fixed random probing order.
2. Equal sets are one class, for which one row stands: copies never meet
   in pairs.
3. 24 bands of three registers are the buckets of the candidate search
   (at a similarity of 0.75 all bands miss with probability 2e-6; 2e-5 for
   sets of 4 to 7 shingles).
4. In each bucket all members are paired with its most central one (the member
   with the largest buckets in all), so a bucket of m near copies gives m
   pairs, not m squared.  After the components of these links, only buckets
   that still span several components matter.  Two exact bounds then hold for
   a pair x, y of one bucket with centre c: with s the number of a document's
   shingles that some other open document holds, |x & y| is at most
   min(s_x, s_y), and at most min(|x & c|, |y & c|) + min(s_x - |x & c|, s_y - |y & c|).
   All pairs from different components that these bounds don't rule out are
   formed: no link between different components is lost, while pairs inside
   one component, which can't change the result, are never made.
5. Pairs whose sizes or whose collision-corrected estimate of the similarity
   rule a link out are dropped (six standard errors); the others are verified
   on the full shingle sets.
6. Components: alternating large-star and small-star steps on the verified links.

Inside, a row is a node of its own, numbered when the sketches are written; so rows that
share a doc_id but not the text keep the links of each, and rows without one keep theirs.
A component is named by the smallest doc_id of its rows.

Defined results: a null or blank text has an empty set, n_shingles 0, and is
its own component; repeated rows are alike; a null doc_id keeps its row, takes its
component's name from the linked rows, and has kept = false (component_id is null
if no linked row has an id).  ``keep_one`` keeps one row of each component, also of
those without ids.  Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import mix64, ngram_hashes, sequence_hash, text_chunks, word_hashes

SHINGLE, SIMILAR = 5, 75
REGISTERS, ROWS, MANTISSA = 72, 3, 10
BANDS = REGISTERS // ROWS
_EMPTY = 65535


def _probes() -> np.ndarray:
    """For each bucket the order in which it looks for a filled one."""
    rng = np.random.default_rng(20240611)
    return np.argsort(rng.random((REGISTERS, REGISTERS)), axis=1)


_PROBES = _probes()


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(data, offsets)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= SHINGLE:
            s = np.sort(ngram_hashes(words[a:b], SHINGLE))
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield sequence_hash(words[a:b])
        else:
            yield words[:0]


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty set: (leading zeros, mantissa) of each bucket's smallest hash."""
    bucket = ((s >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    value = ((mix64(s ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(12)) | np.uint64(1)).astype(np.float64)
    # a float's exponent is the leading-zero count, and its first fraction bits are the mantissa
    code = (value.view(np.uint64) >> np.uint64(52 - MANTISSA)) - np.uint64(1023 << MANTISSA)
    regs = np.full(REGISTERS, _EMPTY, dtype=np.int64)
    np.minimum.at(regs, bucket.astype(np.int64), code.astype(np.int64))
    if (regs == _EMPTY).any():
        filled = regs != _EMPTY
        source = _PROBES[np.arange(REGISTERS), filled[_PROBES].argmax(axis=1)]
        regs = np.where(filled, regs, regs[source])
    return regs.astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    bands = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = (bands[:, 0] << np.uint64(32)) | (bands[:, 1] << np.uint64(16)) | bands[:, 2]
    return mix64(key ^ (np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(48))).view(np.int64)


_SKETCH = "doc long, text_hash long, n_shingles long, k1 long, k2 long, regs binary, bands array<long>"


def _sketch(batches):
    schema = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("regs", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        for at, end, data, offsets in text_chunks(batch.column(2)):
            n, k1, k2, regs, bands = [], [], [], [], []
            for s in shingle_sets(data, offsets):
                n.append(len(s))
                if not len(s):
                    k1.append(None), k2.append(None), regs.append(None), bands.append(None)
                    continue
                k1.append(int(s.sum().view(np.int64)))
                k2.append(int(mix64(s ^ np.uint64(0x2545F4914F6CDD1D)).sum().view(np.int64)))
                r = registers(s)
                regs.append(r.tobytes())
                bands.append(band_keys(r))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(at, end - at) for i in (0, 1)), pa.array(n, pa.int64()), pa.array(k1, pa.int64()),
                 pa.array(k2, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                schema=schema)


def _sets(batches):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        for at, end, data, offsets in text_chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, end - at).cast(pa.int64()),
                 pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())], schema=schema)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity from equal registers, less the equal registers expected between unrelated sets.

    Two unrelated registers agree when both minima have the same leading-zero
    count and the same mantissa: sum over l of p_l(na) * p_l(nb), times 2^-mantissa.
    """
    equal = (a == b).mean(axis=1)
    level = np.arange(0, 54, dtype=np.float64)

    def share(n):
        m = np.maximum(n / REGISTERS, 1.0)[:, None]
        return (1 - 2.0 ** -(level + 1)) ** m - (1 - 2.0 ** -level) ** m

    by_chance = (share(na) * share(nb)).sum(axis=1) * 2.0 ** -MANTISSA
    return np.clip((equal - by_chance) / (1 - by_chance), 0.0, 1.0)


def _likely(batches):
    """Pairs (a, b, na, nb, ra, rb) whose estimate doesn't rule a link out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        regs = [np.frombuffer(b"".join(t[c].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb")]
        na, nb = (t[c].to_numpy().astype(np.float64) for c in ("na", "nb"))
        j = SIMILAR / 100
        slack = np.maximum(0.2, 6 * np.sqrt(j * (1 - j) / np.minimum(REGISTERS, np.minimum(na, nb))))
        keep = pa.array(estimate(*regs, na, nb) >= j - slack)
        yield pa.RecordBatch.from_arrays([t["a"].filter(keep), t["b"].filter(keep)], names=["a", "b"])


def _exploded(batches):
    """(shingle, id) of every element of the sets (id, shingles)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
            ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(ids)], names=["shingle", "id"])


def _verify(batches):
    """Pairs (a, b, sa, sb) to (a, b, common, linked), from the full sets."""
    for batch in batches:
        t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        commons, linked = [], []
        for x, y in zip(t["sa"], t["sb"]):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            commons.append(common)
            linked.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([t["a"], t["b"], pa.array(commons, pa.int64()), pa.array(linked, pa.bool_())],
                                         names=["a", "b", "common", "linked"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b), by alternating large-star and small-star steps.

    Each step groups by a node to a minimum (combined before the shuffle) and
    joins it back, so a node with a third of all links is split by adaptive
    execution.  Every round is written, which cuts the lineage.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = (both.join(low, both.u == low.n).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        joined = large.join(low, large.u == low.n)
        small = joined.select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
                                                F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.*").where("u > v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum("u"), F.sum("v"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


_KEYS = ["without_id", "key", "text_hash"]      # of a row: two rows that share them share their text


def _keyed(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    doc, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(*more, doc.alias("doc"), doc.isNull().alias("without_id"), F.coalesce(doc, F.lit(0)).alias("key"),
                     F.xxhash64(text).alias("text_hash"), text.alias("text"))


def analysed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id (a row number), doc, text_hash, n_shingles, class_id, component_id and stays (this row is the
    one of its component that stays)."""
    spark = df.sparkSession
    ship_package(spark)
    docs = _keyed(df, id_col, text_col)
    sketch = materialize(docs.select("doc", "text_hash", "text").mapInArrow(_sketch, _SKETCH)
                         .withColumn("id", F.monotonically_increasing_id()), "sketch")
    # copies: one class for each set, with a row that stands for it, its smallest doc_id and a row with that
    first = lambda row, doc: F.coalesce(F.min_by(row, doc), F.min(row))
    classes = sketch.where("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.min("doc").alias("class_id"), first("id", "doc").alias("stay"))
    member = materialize(sketch.select("id", "doc", "text_hash", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
                         .drop("k1", "k2"), "members")
    standing = member.where("id = rep").select("id", "class_id", "stay")
    reps = materialize(sketch.join(standing.select("id"), "id", "left_semi")
                       .select("id", "doc", "text_hash", "n_shingles", "regs", "bands"), "classes")
    banded = reps.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    buckets = materialize(banded.join(shared.select("band"), "band"), "buckets")
    wanted = (reps.join(buckets.select("id").distinct(), "id", "left_semi")
              .select("id", F.col("doc").isNull().alias("without_id"), F.coalesce("doc", F.lit(0)).alias("key"), "text_hash"))
    sets = materialize(docs.select(*_KEYS, "text").join(wanted.hint("shuffle_hash"), _KEYS).dropDuplicates(_KEYS)
                       .select("id", "text").mapInArrow(_sets, "id long, shingles binary"), "sets")
    sketches = reps.select("id", "n_shingles", "regs")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, common, linked) of the candidate pairs that sizes and estimates don't rule out."""
        a, b = (sketches.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
                for x in "ab")
        likely = (pairs.join(a, "a").join(b, "b")
                  .where(f"100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)")
                  .select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely, "a long, b long"))
        a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        return materialize(likely.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
                           .mapInArrow(_verify, "a long, b long, common long, linked boolean"), "verified")

    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    weight = buckets.join(sizes, "band").groupBy("id").agg(F.sum("size").alias("weight"))
    centre = (buckets.join(weight, "id").groupBy("band")
              .agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("c"))
              .select("band", (-F.col("c.id")).alias("centre")))
    buckets = materialize(buckets.join(centre, "band"), "centred")
    star = verified(buckets.where("id <> centre")
                    .select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    comp = materialize(components(star.where("linked")), "components")

    now = (buckets.join(comp.withColumnRenamed("component", "comp"), "id", "left")
           .withColumn("comp", F.coalesce("comp", "id")))
    spans = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    now = materialize(now.join(spans.select("band"), "band"), "open")
    holders = (sets.join(now.select("id").distinct(), "id", "left_semi")
               .mapInArrow(_exploded, "shingle long, id long")
               .groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")))
    alone = holders.where("id = last").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    shared = (reps.select("id", F.col("n_shingles").alias("n"), "bands").join(alone, "id", "left")
              .select("id", "n", "bands", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"))
              .where(f"100 * s >= {SIMILAR} * n"))
    known = star.select(F.col("a").alias("centre"), F.col("b").alias("id"), F.col("common").alias("c"))
    x = materialize(now.join(shared, "id").join(known, ["centre", "id"], "left")
                    .withColumn("c", F.when(F.col("id") == F.col("centre"), F.col("s")).otherwise(F.col("c"))),
                    "bounded").drop("centre")
    y = x.select("band", *[F.col(k).alias(f"{k}2") for k in ("id", "comp", "n", "s", "c", "bands")])
    # least() skips nulls: without both counts against the centre the first bound stands alone
    most = "least(s, s2, if(c + c2 is null, null, least(c, c2) + least(s - c, s2 - c2)))"
    # a pair is formed in the first band that it shares, once
    rest = x.join(y, "band").where(f"id < id2 and comp <> comp2 and 100 * {most} >= {SIMILAR} * (n + n2 - {most})"
                                   " and band = array_intersect(bands, bands2)[0]")
    more = verified(rest.select(F.col("id").alias("a"), F.col("id2").alias("b"))).where("linked")
    # the components so far stand for the links that made them
    comp = components(more.select("a", "b").union(comp.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    # a component's name and the row that stays, from its classes
    whole = comp.unionByName(comp.select(F.col("component").alias("id"), "component").distinct())     # with its smallest node
    linked = whole.join(standing, "id")
    named = linked.groupBy("component").agg(F.min("class_id").alias("component_id"), first("stay", "class_id").alias("stays"))
    named = linked.select(F.col("id").alias("rep"), "component").join(named, "component").drop("component")
    return member.join(named, "rep", "left").select(
        "id", "doc", "text_hash", "n_shingles", F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("component_id", "class_id", "doc").alias("component_id"),
        (F.col("id") == F.coalesce("stays", "stay", "id")).alias("stays"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, n_shingles, component_id, kept, class_id (see the module's docstring)."""
    return analysed(df, id_col, text_col).select(
        F.col("doc").alias(id_col), "n_shingles", "component_id",
        F.coalesce(F.col("doc") == F.col("component_id"), F.lit(False)).alias("kept"), "class_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one of each component, with its smallest doc_id (any, if its rows have none)."""
    stay = (analysed(df, id_col, text_col).where("stays")
            .select(F.col("doc").isNull().alias("without_id"), F.coalesce("doc", F.lit(0)).alias("key"), "text_hash"))
    rows = _keyed(df, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).select("row", *_KEYS)
    return rows.join(stay, _KEYS, "left_semi").dropDuplicates(_KEYS).select("row.*")
