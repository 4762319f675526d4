"""TF-IDF over word n-grams.

The vocabulary is fitted with plain aggregates. Applying it is row by row (no shuffle): MLlib's count vectors on
the fitted vocabulary, scaled by idf and normalised.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.base import Transformer
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ngrams import ngrams, tokens
from ..functions.stopwords import ENGLISH
from ..session import shuffles_removed
from . import grams


def with_tokens(df: DataFrame, text: str, stop_words: Sequence[str] | None = ENGLISH, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens(F.col(text), stop_words))


def term_counts(df: DataFrame, words: str, ngram_range: tuple[int, int]) -> DataFrame:
    """Occurrences of every n-gram in all rows: (term, term_count)."""
    terms = df.select(F.explode(ngrams(F.col(words), *ngram_range)).alias("term"))
    return terms.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("term_count"))


def range_totals(df: DataFrame, words: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """(ngram_range, n_terms, n_distinct): occurrences and distinct n-grams of each range.

    Words hold no blanks, so n-grams of different lengths differ. Each length is counted once for all ranges, by 128-bit hashes. Where they
    are many, this takes two passes, so that what is on disk at a time is no more than the words themselves take.
    """
    lengths = sorted({n for low, high in ranges for n in range(low, high + 1)})
    with shuffles_removed(df.sparkSession):
        often = df.agg(*[F.sum(F.greatest(F.size(words) - (n - 1), F.lit(0)).cast("long")) for n in lengths]).first()
    often = {n: t or 0 for n, t in zip(lengths, often, strict=True)}
    each = {n: grams.distinct(df, words, n, t, 1 if t <= grams.GROUP else 2) if t else 0 for n, t in often.items()}
    rows = []
    for low, high in ranges:
        inside = range(low, high + 1)
        rows.append((f"{low}-{high}", sum(often[n] for n in inside) or None, sum(each[n] for n in inside)))
    return df.sparkSession.createDataFrame(rows, "ngram_range string, n_terms bigint, n_distinct bigint")


def top_terms(df: DataFrame, words: str, ngram_range: tuple[int, int], max_features: int) -> DataFrame:
    """The `max_features` most frequent n-grams; equal counts go by term.

    An n-gram is at most as frequent as its rarest word. So once single words are counted, longer n-grams
    need counting only where all their words reach the count of the last single word kept: the rest
    cannot enter the result. That keeps the shuffle of n-grams, whose number of distinct values grows with the
    corpus, down to those of frequent words. When ties make these words too many, everything is counted.
    """
    best = [F.desc("term_count"), F.asc("term")]
    low, high = ngram_range
    if low == 1 < high:
        singles = term_counts(df, words, (1, 1)).orderBy(*best).limit(2 * max_features + 1).collect()
        floor = singles[max_features - 1]["term_count"] if len(singles) >= max_features else 0
        frequent = [r["term"] for r in singles if r["term_count"] >= floor]
        if floor and len(frequent) <= 2 * max_features:
            longer = term_counts(df.select(only_words(words, frequent).alias("__masked")), "__masked", (2, high))
            lead = df.sparkSession.createDataFrame(singles[:max_features], "term string, term_count bigint")
            return lead.unionByName(longer.where(F.col("term_count") >= floor)).orderBy(*best).limit(max_features)
    return term_counts(df, words, ngram_range).orderBy(*best).limit(max_features)


def only_words(words: str, kept: Sequence[str]) -> Column:
    """The words with NULL in place of all but the `kept` ones, so that n-grams over a gap are NULL."""
    literals = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in kept)
    return F.expr(f"transform(`{words}`, w -> CASE WHEN w IN ({literals}) THEN w END)")


@dataclass(frozen=True)
class Counter:
    """Counts the n-grams of a row into a vector, on a vocabulary of known size."""

    model: Transformer
    size: int
    ngram_range: tuple[int, int]
    terms: tuple[str, ...] | None = None

    def transform(self, df: DataFrame, words: str = "tokens", out: str = "tf") -> DataFrame:
        if self.terms is None:
            listed = df.withColumn("__terms", ngrams(F.col(words), *self.ngram_range))
        else:
            # words that are in no term leave a gap, which saves building most of the n-grams
            known = sorted({word for term in self.terms for word in term.split(" ")})
            masked = df.withColumn("__masked", only_words(words, known))
            terms = F.array_compact(ngrams(F.col("__masked"), *self.ngram_range))
            listed = masked.withColumn("__terms", terms).drop("__masked")
        return self.model.setOutputCol(out).transform(listed).drop("__terms")


def limited_counter(
    df: DataFrame, words: str = "tokens", ngram_range: tuple[int, int] = (1, 3), max_features: int = 1000
) -> Counter:
    """A counter on the `max_features` most frequent n-grams, in alphabetical order."""
    terms = tuple(sorted(r["term"] for r in top_terms(df, words, ngram_range, max_features).collect()))
    if not terms:
        raise ValueError("empty vocabulary: no row has a term")
    model = CountVectorizerModel.from_vocabulary(list(terms), inputCol="__terms", outputCol="tf")
    return Counter(model, len(terms), ngram_range, terms)


def full_counter(
    df: DataFrame,
    words: str = "tokens",
    ngram_range: tuple[int, int] = (1, 2),
    hash_bits: int | None = None,
) -> Counter:
    """A counter on every n-gram of `df`, each with an index of its own.

    The size of the data never changes the method. As MLlib keeps a linear model's coefficients on the driver, a vocabulary
    has to fit there; for one that does not, the caller may ask for 2**hash_bits hashed indices.
    """
    distinct = term_counts(df, words, ngram_range).count()
    if distinct == 0:
        raise ValueError("empty vocabulary: no row has a term")
    if hash_bits is not None:
        model = HashingTF(numFeatures=1 << hash_bits, inputCol="__terms", outputCol="tf")
        return Counter(model, 1 << hash_bits, ngram_range)
    listed = df.select(ngrams(F.col(words), *ngram_range).alias("__terms"))
    model = CountVectorizer(vocabSize=distinct, minDF=1, inputCol="__terms", outputCol="tf").fit(listed)
    return Counter(model, distinct, ngram_range)


@dataclass(frozen=True)
class Weighting:
    """Smoothed idf, ln((1 + rows) / (1 + doc_freq)) + 1, as fitted on one set of count vectors.

    With `drop_unseen`, terms that occur in no fitted row weigh nothing, as if they were not in the vocabulary.
    """

    rows: int
    doc_freq: tuple[int, ...]
    drop_unseen: bool = False

    @property
    def idf(self) -> list[float]:
        return [
            0.0 if self.drop_unseen and f == 0 else math.log((1 + self.rows) / (1 + f)) + 1 for f in self.doc_freq
        ]

    def transform(self, df: DataFrame, counts: str = "tf", out: str = "tfidf") -> DataFrame:
        """Add the weights of each row, of length 1 unless no term of the vocabulary occurs."""
        scaler = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol=counts, outputCol="__weighted")
        unit = Normalizer(p=2.0, inputCol="__weighted", outputCol=out)
        return unit.transform(scaler.transform(df)).drop("__weighted")


def fit_weighting(counted: DataFrame, counts: str = "tf", drop_unseen: bool = False) -> Weighting:
    """Document frequencies in one aggregate of (index, rows), which starts on the map side.

    Its work and shuffle follow the terms that occur, not the width of the vocabulary. Index -1 counts the rows.
    """
    vectors = counted.select(F.unwrap_udt(counts).alias("__u"))
    cells = F.arrays_zip(occupied("__u").alias("at"), F.col("__u.values").alias("n"))
    present = F.transform(F.filter(cells, lambda c: c["n"] != 0), lambda c: c["at"])
    hits = vectors.select(F.explode(F.concat(F.array(F.lit(-1)), present)).alias("at")).groupBy("at").count()
    found = {r["at"]: r["count"] for r in hits.collect()}
    width = counted.select(vector_size(counts).alias("n")).first()
    return Weighting(found.get(-1, 0), tuple(found.get(i, 0) for i in range(width["n"] if width else 0)), drop_unseen)


def occupied(vector: str) -> Column:
    """The indices of an unwrapped vector's values: sparse vectors list them, dense ones have them all."""
    return F.coalesce(f"{vector}.indices", F.sequence(F.lit(0), F.size(f"{vector}.values") - 1))


def vector_size(vector: str) -> Column:
    unwrapped = F.unwrap_udt(vector)
    return F.coalesce(unwrapped["size"], F.size(unwrapped["values"]))


@dataclass(frozen=True)
class Tfidf:
    """A fitted vocabulary with its weighting."""

    counter: Counter
    weighting: Weighting

    def transform(self, df: DataFrame, words: str = "tokens", out: str = "tfidf") -> DataFrame:
        counted = self.counter.transform(df, words, "__tf")
        return self.weighting.transform(counted, "__tf", out).drop("__tf")

    def long_weights(self, df: DataFrame, words: str = "tokens", row_id: str = "email_id") -> DataFrame:
        """The same as a table (row_id, term, weight), one row per term that occurs."""
        vectors = self.transform(df.select(row_id, words), words, "__v").select(row_id, F.unwrap_udt("__v").alias("__u"))
        cells = F.arrays_zip(occupied("__u").alias("at"), F.col("__u.values").alias("weight"))
        cells = vectors.select(row_id, F.explode(cells).alias("__c")).where("__c.weight <> 0")
        names = F.lit(list(self.counter.terms))
        return cells.select(row_id, F.element_at(names, F.col("__c.at") + 1).alias("term"), "__c.weight")

    def table(self, spark) -> DataFrame:
        """(term, doc_freq, idf), one row per term of the vocabulary."""
        rows = list(zip(self.counter.terms, self.weighting.doc_freq, self.weighting.idf))
        return spark.createDataFrame(rows, "term string, doc_freq bigint, idf double")


def fit_tfidf(
    df: DataFrame, words: str = "tokens", ngram_range: tuple[int, int] = (1, 3), max_features: int = 1000
) -> Tfidf:
    """Vocabulary and idf from the rows of `df`."""
    counter = limited_counter(df, words, ngram_range, max_features)
    return Tfidf(counter, fit_weighting(counter.transform(df.select(words), words)))
