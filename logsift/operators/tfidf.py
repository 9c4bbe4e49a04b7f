"""TF-IDF text features.

Semantics: lower-cased tokens of two or more letters/digits/underscores; stop
words removed *before* n-grams; unigrams and bigrams; vocabulary = the
``max_features`` terms with the highest total count (ties alphabetical);
tf = 1 + ln(count); idf = ln((1 + n_docs) / (1 + df)) + 1; rows L2-normalised
over the vocabulary; a row without vocabulary terms stays all-zero.

Plan shape: tokenising, n-grams, per-row counts and weights are row-local
higher-order-function expressions (no Python, no shuffle).  The corpus
statistics are aggregations keyed by term with map-side partial
aggregation, so a term present in every row costs one row per partition.  The
vocabulary needs few of them: no bigram occurs more often than either of its
words, so words are counted first, and then only the terms whose words all reach the
count of the ``max_features``-th word (with those that share it).  The vocabulary is bounded by ``max_features`` and is inlined as literals, so
weighting needs no join at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ENGLISH_STOP_WORDS
from ..session import materialize

# Token pattern, portable between Java regex and RE2.
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
CANDIDATE_WORDS = 10_000        # most words that are inlined; with more of them every term is counted


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it for ``body`` (a one-element ``transform``).

    Separate projections are not enough: the optimizer may collapse them and
    inline an expensive column into each of its uses.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(df: DataFrame, parts: int | None) -> DataFrame:
    """Deal CPU-heavy text rows over ``parts`` partitions, for inputs with fewer splits than cores; None: as they are."""
    return df if parts is None else df.repartition(parts)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_RE), F.lit(0))


def words(text: Column, stop_words=None) -> Column:
    """The tokens without stop words."""
    stop = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    return F.filter(tokens(text), lambda t: ~t.isin(stop)) if stop else tokens(text)     # a hash set, not a scan of the list


def grams(text: Column, stop_words=None) -> Column:
    """Unigrams (stop words removed) followed by bigrams of the remaining tokens."""
    return let(words(text, stop_words), _with_bigrams)


# Every "token token" pair of a space-joined token list, in order: each token
# start (input start or after a space) captures itself and the next token.
_BIGRAM_RE = r"(?:^| )(?=([^ ]+ [^ ]+))"


def _with_bigrams(uni: Column) -> Column:
    """Tokens never contain spaces, so bigrams come from one native regex pass."""
    bi = F.regexp_extract_all(F.array_join(uni, " "), F.lit(_BIGRAM_RE), F.lit(1))
    return F.concat(uni, bi)


def _grams_of(uni: Column, kept: list[str]) -> Column:
    """The unigrams and bigrams of a word list whose words are all in ``kept``; the others' places stay empty, so none of
    their neighbours meet."""
    marked = F.transform(uni, lambda t: F.when(t.isin(kept), t).otherwise(F.lit("")))
    return let(marked, lambda m: let(F.array_join(m, " "), lambda line: F.concat(
        F.filter(m, lambda t: t != ""), F.regexp_extract_all(line, F.lit(_BIGRAM_RE), F.lit(1)))))


def term_stats(df: DataFrame, text_col: str, stop_words=None, parts: int | None = None) -> DataFrame:
    """(term, tf = total count, df = rows containing it) over all rows."""
    return _stats(spread(df.select(text_col), parts), grams(F.col(text_col), stop_words))


def _stats(df: DataFrame, terms: Column) -> DataFrame:
    """(term, tf, df) of the rows' lists ``terms``."""
    def entries(g):
        return F.concat(
            F.transform(g, lambda t: F.struct(t.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
            F.transform(F.array_distinct(g), lambda t: F.struct(t.alias("term"), F.lit(0).alias("c"),
                                                               F.lit(1).alias("d"))))
    return (df.select(F.explode(let(terms, entries)).alias("e"))
            .groupBy(F.col("e.term").alias("term"))
            .agg(F.sum("e.c").cast("long").alias("tf"), F.sum("e.d").cast("long").alias("df")))


def frequent_stats(df: DataFrame, text_col: str, max_features: int, stop_words=None, parts: int | None = None) -> DataFrame:
    """``term_stats`` of the terms that can be among the ``max_features`` most frequent ones."""
    listed = materialize(spread(df.select(text_col), parts).select(words(F.col(text_col), stop_words).alias("words")), "words")
    counts = listed.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    counts = materialize(counts, "word-counts")
    top = counts.orderBy(F.desc("tf")).limit(max_features).agg(F.min("tf").alias("least"), F.count(F.lit(1)).alias("n")).first()
    least = top["least"] if top["n"] == max_features and max_features else 0
    kept = [r["term"] for r in counts.where(F.col("tf") >= F.lit(least)).limit(CANDIDATE_WORDS + 1).collect()]
    if len(kept) > CANDIDATE_WORDS:
        return _stats(listed, let(F.col("words"), _with_bigrams))
    return _stats(listed, _grams_of(F.col("words"), kept))


@dataclass(frozen=True)
class Vocabulary:
    terms: tuple[str, ...]          # alphabetical (column order)
    idf: tuple[float, ...]
    n_docs: int

    @property
    def size(self) -> int:
        return len(self.terms)


def vocabulary_frame(df: DataFrame, text_col: str, max_features: int = 50, stop_words=None,
                     parts: int | None = None) -> DataFrame:
    """T5 + idf: the top ``max_features`` terms by total count, ties alphabetical."""
    n_docs = F.lit(df.count())
    top = frequent_stats(df, text_col, max_features, stop_words, parts).orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    return top.withColumn("n_docs", n_docs).select(
        "term", "tf", "df", "n_docs",
        (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def fit_vocabulary(df: DataFrame, text_col: str, max_features: int = 50, stop_words=None,
                   parts: int | None = None) -> Vocabulary:
    """Collect the vocabulary (at most ``max_features`` rows) to the driver."""
    rows = sorted(vocabulary_frame(df, text_col, max_features, stop_words, parts).collect(), key=lambda r: r["term"])
    n_docs = int(rows[0]["n_docs"]) if rows else 0
    return Vocabulary(tuple(r["term"] for r in rows), tuple(float(r["idf"]) for r in rows), n_docs)


def _vocab_arrays(vocab: Vocabulary):
    return F.array(*[F.lit(t) for t in vocab.terms]), F.array(*[F.lit(w) for w in vocab.idf])


def tfidf_vector(text: Column, vocab: Vocabulary, stop_words=None) -> Column:
    """Dense array<double> of length ``vocab.size`` (one 0.0 if the vocabulary is empty), from the row's few weights."""
    if vocab.size == 0:
        return F.array(F.lit(0.0))
    terms, _ = _vocab_arrays(vocab)
    found = F.map_from_entries(row_weights(text, vocab, stop_words))
    return let(found, lambda m: F.transform(terms, lambda t: F.coalesce(m[t], F.lit(0.0))))


def row_weights(text: Column, vocab: Vocabulary, stop_words=None) -> Column:
    """The row's vocabulary terms with their weights, alphabetical: array of (term, weight).

    The row's vocabulary grams are computed once (bigrams only of words that occur in the vocabulary); each of their
    terms' count is ``size(g) - size(array_remove(g, term))`` (native array code, linear in the row); then the L2 norm.
    """
    terms, idf = _vocab_arrays(vocab)
    parts = sorted({w for t in vocab.terms for w in t.split(" ")})
    if any(" " in t for t in vocab.terms):
        g = F.filter(_grams_of(words(text, stop_words), parts), lambda t: t.isin(list(vocab.terms)))
    else:
        g = F.filter(words(text, stop_words), lambda t: t.isin(parts))

    def weights(g):
        return F.transform(F.sort_array(F.array_distinct(g)), lambda t: F.struct(t.alias("term"), (
            (F.lit(1.0) + F.log((F.size(g) - F.size(F.array_remove(g, t))).cast("double")))
            * F.element_at(idf, F.array_position(terms, t).cast("int"))).alias("weight")))

    def normalise(raw):
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"]))
        return let(norm, lambda n: F.transform(raw, lambda e: F.struct(e["term"].alias("term"), (e["weight"] / n).alias("weight"))))

    return let(let(g, weights), normalise)


def with_tfidf(df: DataFrame, text_col: str, vocab: Vocabulary, out: str = "tfidf", stop_words=None) -> DataFrame:
    """Append the TF-IDF vector of ``text_col`` as ``out``."""
    return df.withColumn(out, tfidf_vector(F.col(text_col), vocab, stop_words))


def tfidf_long(df: DataFrame, key_col: str, text_col: str, vocab: Vocabulary, stop_words=None,
               parts: int | None = None) -> DataFrame:
    """J2/J6 in long form: (key, term, weight) for every non-zero weight."""
    rows = spread(df.select(key_col, text_col), parts)
    if vocab.size == 0:
        return rows.select(key_col, F.lit("").alias("term"), F.lit(0.0).alias("weight")).where(F.lit(False))
    return rows.select(key_col, F.inline(row_weights(F.col(text_col), vocab, stop_words)))
