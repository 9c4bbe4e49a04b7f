"""Personal data by proposed spans and boosted trees, all in DataFrame expressions (operator 10).

Base spans (always kept) follow the fixed rules of four kinds: email, ip, card
and phone.  Wider generators then propose further, overlapping spans (loose
addresses, "name (at) host" forms, number groups read as ip, card or phone).
Each proposal has small integer features of its format and context.  The
evidence is what the text itself proves.  Proposals that meet a base span are
positive, with the cue that made the rule match ('+', '@') taken out of their
features, as it is missing in the spans to be added.  Known other things are
negative: dates, versions, decimals, bare numbers, failed Luhn and octet checks,
addresses without a domain, and spans of another kind.  All others, among them
every span that could be added, are no evidence either way.  The evidence of all
texts is counted by its feature values; that table, whose size the features'
ranges bound, trains gradient-boosted trees and sets per kind the lowest
threshold whose precision reaches ``PRECISION``.  Both classes of each kind have
the same weight there, and the proposals of ``SEEDS`` add a fixed share, so
that neither depends on how many base spans a table has, if any.
The trees become one SQL expression, so scoring is a projection: there is no
Python, no join and no shuffle of texts on this path.  A proposal over the
threshold that is no evidence and meets no base span is added.

A text's spans and their overlaps are found by running totals and by a byte mask of the
base spans, so a text with 200,000 matches takes seconds, not the square of that.

Defined results: a null or empty text has no spans; repeated rows are treated
alike; further columns are ignored.  Starts and ends count code points, ends exclusive.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, PRECISION, SEED_SHARE = 12, 3, 0.98, 0.25

# (?<!class)|\G: a match starts where a run starts or where the last match ended, which is where the leftmost
# match must start; possessive runs can't be given back, so every text is scanned in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"[^\s@<>\x22',;:|]{1,64}+@[^\s@<>\x22',;:|]{3,255}+"
             r"|[A-Za-z0-9._%-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "number": r"[0-9(][0-9().\x20-]{5,38}[0-9]",
    "local": r"[(]?[0-9]{3}[)]?[ .-]{0,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
GATE = {"email": "instr(text, '@') > 0", "ip": "text rlike '[0-9]\\\\.[0-9]'", "card": "text rlike '[0-9][ -]?[0-9]'",
        "phone": "instr(text, '+') > 0", "wide_email": "text rlike '@|[(\\\\[]at[)\\\\]]'", "number": "text rlike '[0-9]'"}
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|server|address|from", "card": "card|visa|payment|credit",
           "phone": "phone|tel|call|mobile|fax"}
SEEDS = (
    "write to jane.doe@example.com or j_smith12@mail.example.org, (a.b@example.net) <info@example.com>, mail: x1@example.co.uk",
    "user@localhost runs foo@bar and root@db1, ab!@#$%^ or x@y1z",
    "host 192.168.10.24 and 10.0.0.1, (172.16.254.3) from 8.8.8.8:53",
    "300.1.1.1 and 10.0.999.1, (1.2.3.456) from 999.10.20.30",
    "card 4111 1111 1111 1111 or 5500-0000-0000-0004, (340000000000009) 4111111111111111",
    "card 4111 1111 1111 1112 or 5500-0000-0000-0005, (340000000000008) 4111111111111113",
    "call +1 (800) 555-1800 or +1 800-555-1801, (+44 20 7946 0958) tel: +49 30 901820 +1.800.555.1802 and +1-800-555-1803",
    "on 2024-01-31 12, 2023.12.24 and 31.12.2023, 12-05-2019 1990-1995 version 10.15.7.123, 1234567 of 20240131, (123.4567) 1.234.567 "
    "12 15 18 22 10.5 20.3 30.1 1 2 3 4 5 6 7",
)
SPAN = "struct<m:string,s:int,e:int,before:string,after:string>"
FEATURES = ("kind", "digits", "letters", "marks", "luhn", "local", "dots", "octets", "prev", "next", "word")


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(array: str, size: str, then: str, made: str) -> str:
    """SQL: the values ``made`` of each element x of an array and the running total ``at`` before it; nulls are left out.

    The ``size`` t of an element goes into the total a by ``then``, from 0.  Spark has no running sum of an array, and
    adding to an array copies it; so the array is cut into as many blocks as a block has elements, whose totals are run up
    first, and each block is run up alone.  Only totals are copied, and those of n elements n to the power of 1.5 times.
    """
    def run_up(elements: str, start: str, one: str) -> str:
        return (f"aggregate({elements}, named_struct('at', {start}, 'out', cast(array() as array<int>)), (g, x) -> named_struct("
                f"'at', {_let('g.at', 'a', _let(one, 't', then))}, 'out', array_append(g.out, g.at))).out")

    totals = f"transform(bs, b -> aggregate(b, 0, (a, x) -> {_let(size, 't', then)}))"
    cut = "transform(sequence(1, size(z), cast(ceil(sqrt(size(z))) as int)), i -> slice(z, i, cast(ceil(sqrt(size(z))) as int)))"
    before = _let(cut, "bs", f"flatten(zip_with(bs, {run_up(totals, '0', 'x')}, (b, st) -> {run_up('b', 'st', size)}))")
    return f"filter({_let(array, 'z', f'if(size(z) = 0, array(), zip_with(z, {before}, (x, at) -> {made}))')}, m -> m is not null)"


def _spans(regex: str, gate: str) -> str:
    """SQL: all non-overlapping matches with their places and the text around, from the pieces between them."""
    pieces, found = f"split(text, {_sql(regex)}, -1)", f"regexp_extract_all(text, {_sql(regex)}, 0)"
    span = ("if(x.`1` is null, null, named_struct('m', x.`1`, 's', at + char_length(x.p), 'e', at + char_length(x.p) + char_length(x.`1`), "
            "'before', right(x.p, 20), 'after', left(x.`2`, 1)))")
    zipped = f"arrays_zip(p, {found}, slice(p, 2, size(p)))"
    one = _let(pieces, "p", _running(zipped, "char_length(x.p) + coalesce(char_length(x.`1`), 0)", "a + t", span))
    return f"if({gate}, {one}, cast(array() as array<{SPAN}>))"


def _once(array: str) -> str:
    """SQL: structs (s, e, ...) in order, one of each place."""
    return _let(f"sort_array({array})", "o", "filter(o, (x, i) -> i = 0 or x.s <> get(o, i - 1).s or x.e <> get(o, i - 1).e)")


def _mask(kind: str) -> str:
    """SQL: a byte for each character of the text, 1 inside the base spans of this kind; null, if there are none."""
    gaps = (f"zip_with(base_{kind}, slice(concat(array(0), transform(base_{kind}, b -> b.e)), 1, size(base_{kind})), "
            "(b, last) -> concat(repeat('0', b.s - last), repeat('1', b.e - b.s)))")
    return f"if(size(base_{kind}) = 0, null, cast(array_join({gaps}, '') as binary))"


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: the digit string passes the Luhn check (every second digit from the right doubled, 9 taken off if over 9)."""
    return (f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> cast(d as int) * (1 + i % 2) "
            "- if(i % 2 = 1 and cast(d as int) > 4, 9, 0)), 0, (a, d) -> a + d) % 10 = 0")


VALID = {
    "email": "true",
    "ip": f"x.m rlike {_sql('^' + _OCTET + '(?:[.]' + _OCTET + '){3}$')}",
    "card": f"length({_DIGITS}) between 13 and 19 and {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) between 9 and 15",
}


_YEAR, _MONTH_DAY = "(?:19|20)[0-9]{2}", "(?:0?[1-9]|[12][0-9]|3[01])"
_DATE = (rf"(?<![0-9])(?:{_YEAR}[-./]{_MONTH_DAY}[-./]{_MONTH_DAY}|{_MONTH_DAY}[-./]{_MONTH_DAY}[-./]{_YEAR})(?![0-9])"
         rf"|^{_YEAR} ?- ?{_YEAR}$")
_VERSION = r"(?i)(?<![a-z])(?:v|ver|version|release|rev)[.:]? ?$"
# thousands and versions, decimals, lists of small numbers
_FIGURES = r"^[1-9][0-9]{0,2}(?:[.][0-9]{1,3}){2,}$|^[0-9]+[.][0-9]+(?: [0-9]+[.][0-9]+)*$|^[1-9][0-9]?(?: [0-9]{1,2})+$"
_DATED = f"x.m rlike {_sql(_DATE)} or x.before rlike {_sql(_VERSION)}"
#: Proposals that meet no base span of their kind and are known to be something else.
NEGATIVE = {
    "email": r"x.m like '%@%' and not x.m rlike '[\\p{L}\\p{N}_]@[\\p{L}\\p{N}-]+(?:[.][\\p{L}\\p{N}-]+)+'",
    "ip": f"not {VALID['ip']} or x.before rlike {_sql(_VERSION)}",
    "card": f"not ({VALID['card']}) or {_DATED}",
    "phone": f"{_DATED} or x.m rlike {_sql(_FIGURES)} or (x.m rlike '^[0-9]+$' and not lower(x.before) rlike '{CONTEXT['phone']}')",
}
#: The span without the cue by which a base rule finds it, or with the cue that stands for it elsewhere.
PLAIN = {
    "email": r"regexp_replace(regexp_replace(x.m, '\\x20?[(\\[]at[)\\]]\\x20?', '@'), '\\x20?[(\\[]dot[)\\]]\\x20?', '.')",
    "phone": "replace(x.m, '+', '')",
}


def _char_class(c: str) -> str:
    return (f"case when {c} is null or {c} = '' or {c} rlike '[\\\\s]' then 0 when {c} rlike '[A-Za-z]' then 1 "
            f"when {c} rlike '[0-9]' then 2 when {c} in ('=', ':', '\"', '(', '<') then 3 else 4 end")


def _proposal(kind: str) -> str:
    """SQL: the features of a proposed span x of this kind."""
    def meets(k: str) -> str:
        # (the bytes of a place are found without a look at those before it)
        return f"coalesce(instr(cast(substring(m_{k}, x.s + 1, x.e - x.s) as string), '1') > 0, false)"

    others = " or ".join(meets(k) for k in KINDS if k != kind)
    base, plain = meets(kind), PLAIN.get(kind, "x.m")
    prev = _char_class("right(x.before, 1)")
    values = {
        "kind": str(KINDS.index(kind)),
        "digits": f"least(length({_DIGITS}), 20)",
        "letters": f"least(length(regexp_replace({plain}, '[^A-Za-z]', '')), 3)",
        "marks": f"least(length(regexp_replace({plain}, '[A-Za-z0-9]', '')), 8)",
        "luhn": f"int({_luhn(_DIGITS)})" if kind == "card" else "0",
        "local": r"int(x.m rlike '^[(]?[0-9]{3}[)]?[ .-]{0,2}[0-9]{3}[ .-][0-9]{4}$')" if kind == "phone" else "0",
        "dots": f"least(length(regexp_replace({plain}, '[^.]', '')), 5)",
        "octets": f"int({VALID['ip']})" if kind == "ip" else "0",
        # a span that starts behind the '+' or the country code of a base span
        "prev": f"if({base}, 0, {prev})" if kind == "phone" else prev,
        "next": _char_class("x.after"),
        "word": f"int(lower(x.before) rlike '{CONTEXT[kind]}')",
    }
    fields = ", ".join(f"'{n}', {values[n]}" for n in FEATURES)
    return (f"named_struct('s', x.s, 'e', x.e, {fields}, "
            f"'base', int({base}), 'other', int(not {base} and ({others} or {NEGATIVE[kind]})))")


def analysed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """(id, base_<kind> arrays of spans, proposals) of every row; with ``keep_row`` also the row itself."""
    t = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                  *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if keep_row else []))
    found = t.select("*", *[F.expr(_spans(BASE[k], GATE[k])).alias(f"all_{k}") for k in KINDS],
                     F.expr(_spans(WIDE["email"], GATE["wide_email"])).alias("wide_email"),
                     F.expr(_spans(WIDE["number"], GATE["number"])).alias("wide_number"),
                     F.expr(_spans(WIDE["local"], GATE["number"])).alias("wide_local"))
    based = found.select("*", *[F.expr(f"filter(all_{k}, x -> {VALID[k]})").alias(f"base_{k}") for k in KINDS])
    based = based.select("*", *[F.expr(_mask(k)).alias(f"mask_{k}") for k in KINDS])
    numbers = {"ip": "length(regexp_replace(x.m, '[^.]', '')) = 3", "card": f"length({_DIGITS}) between 12 and 19",
               "phone": f"length({_DIGITS}) between 7 and 15"}
    parts = [f"transform(wide_email, x -> {_proposal('email')})"]
    for k in ("ip", "card", "phone"):
        near = f"filter(concat(wide_number, all_{k}{', wide_local' * (k == 'phone')}), x -> {numbers[k]})"
        placed = f"transform({near}, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'before', x.before, 'after', x.after))"
        parts.append(f"transform({_once(placed)}, x -> {_proposal(k)})")
    for k in KINDS:     # (a row's binary column is copied at each use, a lambda's variable isn't)
        parts = [_let(f"mask_{k}", f"m_{k}", part) for part in parts]
    return based.select("id", *(["row"] if keep_row else []),
                        *[F.expr(f"transform(base_{k}, x -> named_struct('s', x.s, 'e', x.e))").alias(f"base_{k}") for k in KINDS],
                        F.expr(f"concat({', '.join(parts)})").alias("proposals"))


def _tree(node) -> str:
    """SQL of one fitted regression tree over the fields of a proposal x."""
    if node.getClass().getSimpleName() == "LeafNode":
        return repr(float(node.prediction()))
    split = node.split()
    return (f"if(x.{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}, "
            f"{_tree(node.leftChild())}, {_tree(node.rightChild())})")


def _evidence(table: DataFrame) -> DataFrame:
    """The proved proposals of analysed rows, counted by their feature values and label."""
    return table.select(F.explode("proposals").alias("x")).where("x.base = 1 or x.other = 1").groupBy(
        *[F.col(f"x.{n}").cast("double").alias(n) for n in FEATURES], F.col("x.base").cast("double").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))


_seed_rows: list[tuple] = []


def _seed_evidence(spark) -> DataFrame:
    """``_evidence`` of ``SEEDS``: the same for every table, so it is counted once in a process.

    The analysed seeds are written like a table.  Counted straight from the expressions, the optimizer writes each into its
    uses, which makes a plan of a megabyte of text that the driver prints again and again.
    """
    if not _seed_rows:
        texts = spark.range(1).select(F.explode(F.array(*map(F.lit, SEEDS))).alias("text")).select(F.lit(0).alias("doc_id"), "text")
        _seed_rows.extend(map(tuple, _evidence(materialize(analysed(texts), "seeds")).collect()))
    fields = ", ".join(f"`{n}`: double" for n in (*FEATURES, "label", "n"))
    rows = json.dumps([dict(zip((*FEATURES, "label", "n"), r)) for r in _seed_rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{fields}>>")))     # read in the JVM


def fit(table: DataFrame) -> tuple[str, dict[str, float]]:
    """The score of a proposal x as SQL, and the threshold of each kind, from analysed rows."""
    evidence = [t.withColumn("share", F.lit(share)) for t, share in (
        (_evidence(table), 1.0), (_seed_evidence(table.sparkSession), SEED_SHARE))]
    counted = materialize(evidence[0].unionAll(evidence[1]), "proposals").coalesce(1)
    # both classes of each kind weigh the same
    part, whole = Window.partitionBy("kind", "label", "share"), Window.partitionBy("kind", "label")
    counted = counted.withColumn("weight", F.col("share") * F.col("n") / F.sum("n").over(part))
    counted = counted.withColumn("weight", F.col("weight") / F.sum("weight").over(whole))
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=0.3, minWeightFractionPerNode=0.01, seed=7).fit(
        VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(counted.orderBy(*FEATURES, "label", "share")))
    sums = " + ".join(f"{float(w)!r}D * {_tree(t._call_java('rootNode'))}" for w, t in zip(model.treeWeights, model.trees))
    score = f"1.0D / (1.0D + exp(-2.0D * ({sums})))"
    # calibration: precision of everything at or over each twentieth, per kind, over all evidence
    steps = [i / 20 for i in range(10, 20)]
    scored = counted.select("kind", "label", "weight", F.expr(score.replace("x.", "")).alias("p"))
    rates = scored.groupBy("kind").agg(*[
        (F.sum(F.when(F.col("p") >= t, F.col("weight") * F.col("label")))
         / F.sum(F.when(F.col("p") >= t, F.col("weight")))).alias(f"p{i}") for i, t in enumerate(steps)]).collect()
    limits = {}
    for r in rates:
        good = [t for i, t in enumerate(steps) if r[f"p{i}"] is not None and r[f"p{i}"] >= PRECISION]
        if good:
            limits[KINDS[int(r["kind"])]] = good[0]
    return score, limits


def with_spans(table: DataFrame, score: str, limits: dict[str, float]) -> DataFrame:
    """Adds ``found``: an array of (kind, s, e), by kind as listed and start, base spans and added ones."""
    for k in KINDS:
        spans = f"base_{k}"
        if k in limits:
            # (a proposal that is neither base nor other meets no base span of any kind)
            spans = (f"concat({spans}, transform(filter(proposals, x -> x.kind = {KINDS.index(k)} and x.base = 0 and x.other = 0 "
                     f"and {score} >= {limits[k]}D), x -> named_struct('s', x.s, 'e', x.e)))")
        table = table.withColumn(f"found_{k}", F.expr(f"transform({_once(spans)}, x -> named_struct('k', '{k}', 's', x.s, 'e', x.e))"))
    return table.withColumn("found", F.concat(*[F.col(f"found_{k}") for k in KINDS]))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base_<kind> and found (see ``with_spans``)."""
    table = materialize(analysed(df, id_col, text_col), "pii")
    return with_spans(table, *fit(table)).withColumnRenamed("id", id_col)


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``df`` with every found span replaced by its kind in brackets; overlapping spans are one gap.

    A column named ``length_col``, if there is one, gets the new text's length.  A null text stays null.
    """
    table = materialize(analysed(df, id_col, text_col, keep_row=True), "pii")
    text = f"cast(row.`{text_col}` as string)"
    # four bytes a character: a piece is cut out without a look at what is before it
    piece = "decode(substring(wide, 4 * {0} + 1, 4 * ({1} - {0})), 'UTF-32')"
    # spans by start, the longer first; what lies inside an earlier one is a part of its gap
    ordered = "sort_array(transform(found, x -> named_struct('s', x.s, 'e', -x.e, 'k', x.k)))"
    kept = _running(ordered, "-x.e", "greatest(a, t)",
                    "if(x.s < at, if(-x.e > at, named_struct('at', at, 's', at, 'e', -x.e, 'k', ''), null), "
                    "named_struct('at', at, 's', x.s, 'e', -x.e, 'k', concat('[', upper(x.k), ']')))")
    parts = f"transform(k, x -> concat({piece.format('x.at', 'x.s')}, x.k))"
    whole = _let(f"encode({text}, 'UTF-32')", "wide", _let(kept, "k", (
        f"concat(array_join({parts}, ''), decode(substring(wide, 4 * array_max(transform(k, x -> x.e)) + 1), 'UTF-32'))")))
    new = F.expr(f"if(size(found) = 0, {text}, {whole})")
    out = with_spans(table, *fit(table)).select("row", new.alias("new"))
    return out.select(*[F.col("new").alias(c) if c == text_col else F.expr(
        f"if(new = {text}, row.`{c}`, char_length(new))").alias(c) if c == length_col else F.col(f"row.`{c}`").alias(c)
        for c in df.columns])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: counts, the base spans' hash and all spans as text."""
    listed = ", ".join(f"transform(base_{k}, b -> concat_ws(':', '{k}', b.s, b.e))" for k in KINDS)
    return found.select(
        id_col, *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.expr(f"sha2(array_join(concat({listed}), ','), 256)").alias("base_sha256"),
        F.expr("array_join(transform(found, b -> concat_ws(':', b.k, b.s, b.e)), ',')").alias("spans"))
