"""Ranked word search over an inverted index.

The score of a document is the sum over the query's words of
(1 + ln tf) * ln(1 + N / df). All words must occur.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf): the index, to be stored by term."""
    terms = docs.select(F.col(id_col).alias("id"), F.explode(text.words(F.col(text_col))).alias("term"))
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"))


def search(index: DataFrame, docs_count: DataFrame, query: str) -> DataFrame:
    """(id, rank) for documents with all words, best first; ties by id.

    ``docs_count`` is one row (n); it is joined, not collected.
    """
    terms = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    if not terms:
        return index.sparkSession.createDataFrame([], "id long, rank double")
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(docs_count))
    weight = (1 + F.log(F.col("tf").cast("double"))) * F.log(1 + F.col("n") / F.col("df"))
    ranked = scored.groupBy("id").agg(F.sum(weight).alias("rank"), F.count("*").alias("found")).where(F.col("found") == len(terms))
    return ranked.select("id", "rank").orderBy(F.desc("rank"), "id")


#: Fields of an element and what a word in one weighs.
WEIGHTS = {"name": 1.0, "qualified_name": 0.4, "signature": 0.2, "doc_comments": 0.1}
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")


def stem(word: Column) -> Column:
    """A word without its commonest endings; short words stay whole."""
    return F.regexp_replace(word, "^(.{3,}?)(ing|ed|ly|ies|y|s)$", "$1")


def weighted_postings(elements: DataFrame) -> DataFrame:
    """(term, element_id, name, weight): the index of elements, to be stored by term.

    Words are stemmed, stop words left out. A term's weight adds up its fields'
    weights times one plus the logarithm of its count there. Elements are spread
    by id before they become words, so that a small file's words aren't summed up
    in one task; all sums stay where the element is.
    """
    fields = [F.struct(F.lit(w).alias("w"), (F.array_join(f, " ") if f == "doc_comments" else F.col(f)).alias("t")) for f, w in WEIGHTS.items()]
    spread = elements.select("element_id", *WEIGHTS).repartition("element_id")
    rows = spread.select("element_id", "name", F.explode(F.array(*fields)).alias("f")).select("element_id", "name", "f.w", F.explode(text.words(F.translate("f.t", "_", " "))).alias("word"))
    terms = rows.where(~F.col("word").isin(*STOP_WORDS)).groupBy("element_id", "name", "w", stem(F.col("word")).alias("term")).agg(F.count("*").alias("n"))
    return terms.groupBy("term", "element_id", "name").agg(F.sum(F.col("w") * (1 + F.log(F.col("n").cast("double")))).alias("weight"))


def ranked(index: DataFrame, query: str, prefix: bool = False) -> DataFrame:
    """(element_id, name, rank) of elements with all words, best first, then by name.

    With ``prefix`` a word also stands for terms that begin with it. The words
    asked for are also a filter of literals, which Catalyst takes below the sums
    of an index that isn't stored; a join with them stays above.
    """
    spark = index.sparkSession
    wanted = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if w not in STOP_WORDS})
    asked = spark.createDataFrame([(k, w) for k, w in enumerate(wanted)], "k int, word string").select("k", stem(F.col("word")).alias("q"))
    match = F.col("term").startswith(F.col("q")) if prefix else F.col("term") == F.col("q")
    stems = [stem(F.lit(w)) for w in wanted]
    among = functools.reduce(Column.__or__, (F.col("term").startswith(q) for q in stems), F.lit(False)) if prefix else F.col("term").isin(*stems)
    hits = index.where(among).join(F.broadcast(asked), match)
    found = hits.groupBy("element_id", "name").agg(F.sum("weight").alias("rank"), F.countDistinct("q").alias("n"))
    need = asked.agg(F.countDistinct("q").alias("need"))
    # sorting reads its input twice; after this shuffle that is what was found, not all words (by element_id alone it would be left out, as rows are spread so already)
    whole = found.crossJoin(F.broadcast(need)).where("n = need").select("element_id", "name", "rank").repartition("element_id", "name")
    return whole.orderBy(F.desc("rank"), "name", "element_id")
