"""Full-text search by BM25 over an inverted index, and exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.exprs import col
from sparkloom.functions.porter import stem
from sparkloom.operators.columns import need
from sparkloom.operators.strings import unaccented
from sparkloom.storage import stored

ENGLISH = """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has
have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so
some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours
yourself yourselves""".split()
#: Stemmers at hand: the English one and none.
STEMMERS = ("porter", "english", "none")


@dataclass
class TextIndex:
    """An inverted index: ``postings`` (doc, id, length, term, tf), stored part by part, each in the order of its terms, so that a query reads only the blocks of its own; the number of texts and their mean length."""

    postings: DataFrame
    texts: int
    mean: float
    id_col: str
    text_col: str
    options: dict = field(default_factory=dict)


def terms(text: Column, stemmer: str = "porter", stopwords: str | list[str] = "english", ignore: str = r"(\.|[^a-z])+", strip_accents: bool = True, lower: bool = True) -> Column:
    """The terms of a text, as an array."""
    if stemmer not in STEMMERS:
        raise ValueError(f"unknown stemmer {stemmer!r}; there are {STEMMERS}")
    c = unaccented(text) if strip_accents else text
    c = F.lower(c) if lower else c
    words = F.array_remove(F.split(F.regexp_replace(c, ignore, " "), " "), "")
    stop = ENGLISH if stopwords == "english" else [] if stopwords == "none" else list(stopwords)
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    if stemmer == "none":
        return words

    @F.pandas_udf("array<string>")
    def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return stemmed(words)


def create_index(df: DataFrame, id_col: str, text_col: str, **options) -> TextIndex:
    """Tokenises all texts once and stores the index; nothing is shuffled, a task stores the terms of the texts that it reads. Ids should be unique; null texts are not in it."""
    need(df, [id_col, text_col])
    t = df.where(col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("doc"), col(id_col).alias("id"), F.sort_array(terms(col(text_col), **options)).alias("terms"))
    # terms are counted where their text lies: in sorted terms each begins where the one before differs
    begins = F.filter(F.transform("terms", lambda x, i: F.when(~F.get("terms", i - 1).eqNullSafe(x), F.struct(x.alias("term"), i.alias("at")))), lambda x: x.isNotNull())
    t = t.select("doc", "id", F.size("terms").alias("length"), begins.alias("begins"))
    counted = F.transform("begins", lambda x, i: F.struct(x["term"].alias("term"), (F.coalesce(F.get("begins", i + 1)["at"], F.col("length")) - x["at"]).cast("bigint").alias("tf")))
    # a text without terms has a posting of the term null, which counts it
    flat = t.select("doc", "id", "length", F.inline_outer(counted)).withColumn("tf", F.coalesce("tf", F.lit(1).cast("bigint")))
    postings = stored(flat.sortWithinPartitions("term"))
    texts, words = postings.agg(F.countDistinct("doc"), F.sum(F.when(F.col("term").isNotNull(), F.col("tf")))).first()
    return TextIndex(postings, texts, (words or 0) / texts if texts else 0.0, id_col, text_col, options)


def bm25(df: DataFrame, index: TextIndex, text: str, k: int, k1: float = 1.2, b: float = 0.75, conjunctive: bool = False, min_score: float | None = None, score_column: str | None = None) -> DataFrame:
    """The k best rows for a query by Okapi BM25; ties by id. Only the query's terms are read from the index; ``conjunctive`` asks for all of them."""
    query = df.sparkSession.createDataFrame([(text,)], "t string").select(F.explode(F.array_distinct(terms(F.col("t"), **index.options))).alias("term"))
    words = [r.term for r in query.collect()]
    name = score_column or "__score"
    hits = index.postings.where(F.col("term").isin(words))
    # one row a term of the query
    seen = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean = F.lit(float(index.texts)), F.lit(index.mean or 1.0)
    part = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    scored = hits.join(F.broadcast(seen), "term").groupBy("doc", "id").agg(F.sum(part).alias(name), F.count(F.lit(1)).alias("__hits"))
    if conjunctive:
        scored = scored.where(F.col("__hits") >= len(words))
    if min_score is not None:
        scored = scored.where(col(name) >= min_score)
    best = scored.orderBy(col(name).desc(), "id").limit(k).select(F.col("id").alias("__id"), col(name))
    # k rows
    out = df.join(F.broadcast(best), col(index.id_col) == F.col("__id")).drop("__id").orderBy(col(name).desc(), col(index.id_col))
    return out if score_column else out.drop("__score")


def cosine(column: str, vector: list[float]) -> Column:
    """Cosine similarity of an array column with a vector; null for vectors of another length or of no length."""
    v = [float(x) for x in vector]
    norm = float(np.sqrt(sum(x * x for x in v)))
    lit = F.array(*[F.lit(x) for x in v])
    a = col(column).cast("array<double>")
    dot = F.aggregate(F.zip_with(a, lit, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == len(v), F.try_divide(dot, own * F.lit(norm)))


def nearest_by_cosine(df: DataFrame, column: str, vector: list[float], k: int, new: str = "similarity") -> DataFrame:
    """The k rows of greatest cosine similarity, exactly: a heap in each task."""
    return df.withColumn(new, cosine(column, vector)).where(col(new).isNotNull()).orderBy(col(new).desc()).limit(k)
