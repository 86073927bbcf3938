"""Phrases, topics, corpus TF-IDF and full-text search."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calllens.config import Profile
from calllens.functions import sentiment as sent
from calllens.functions.arrays import let, run_lengths
from calllens.functions.tokens import (
    candidate_phrases,
    ngrams,
    ngrams_upto,
    sentences,
    tokens,
    tokens_of,
)
from calllens.session import stored

TERM = r"[\p{L}\p{N}_]{2,}"


def top_k_per_call(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key.  Spark limits each group on the map side too, so a
    hot key sends at most ``k`` rows per task."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def phrase_topics(c: Column, profile: Profile, k: int | None = None, min_chars: int = 3) -> Column:
    """Most frequent candidate phrases of one transcript,
    ``array<struct<name, n, relevance>>``; ties by name."""
    phrases = candidate_phrases(c, profile.stop_words, profile.min_phrase_words, min_chars)
    return topics_from(phrases, k or profile.max_topics)


def topics_from(phrase_array: Column, k: int) -> Column:

    def ranked(phrases: Column) -> Column:
        by_count = F.sort_array(
            F.transform(
                run_lengths(phrases), lambda r: F.struct((-r["n"]).alias("neg"), r["term"].alias("name"))
            )
        )
        return F.transform(
            F.slice(by_count, 1, k),
            lambda r: F.struct(
                r["name"].alias("name"),
                (-r["neg"]).alias("n"),
                (-r["neg"] / F.size(phrases)).alias("relevance"),
            ),
        )

    return let(phrase_array, ranked)


def phrase_frequency(
    df: DataFrame, profile: Profile, k: int | None = None, key: str = "call_id", text: str = "text"
) -> DataFrame:
    """Top phrases per transcript row, counted inside the row."""
    return df.select(key, F.inline(phrase_topics(F.col(text), profile, k)))


def phrase_frequency_turns(
    turns: DataFrame, profile: Profile, k: int | None = None, key: str = "call_id", text: str = "text"
) -> DataFrame:
    """Top phrases per call given as turns: counts merge by (call, phrase)."""
    phrases = turns.select(
        key,
        F.inline(
            run_lengths(candidate_phrases(F.col(text), profile.stop_words, profile.min_phrase_words, 3))
        ),
    )
    counts = phrases.groupBy(key, F.col("term").alias("name")).agg(F.sum("n").alias("n"))
    # from the counts, so the texts are read once and the exchange is reused
    totals = counts.groupBy(key).agg(F.sum("n").alias("_all"))
    top = top_k_per_call(
        counts, [key], [F.col("n").desc(), F.col("name")], k or profile.max_topics
    ).drop("rank")
    return top.join(totals, key).select(key, "name", "n", (F.col("n") / F.col("_all")).alias("relevance"))


def _kept(text: str, stop_words) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(*stop_words))


def vocabulary(
    counts: DataFrame, documents: DataFrame, max_features: int | None, min_df: int, max_df: float
) -> DataFrame:
    """``(term, df, n_docs)``: terms within the document-frequency bounds, most
    frequent first, ties by term.  Hot terms collapse in the partial aggregate."""
    n_docs = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = counts.groupBy("term").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df"))
    bounded = stats.withColumn("n_docs", n_docs).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df)
    )
    if max_features is not None:
        bounded = bounded.orderBy(F.col("cf").desc(), "term").limit(max_features)
    return bounded.select("term", "df", "n_docs")


def frequent_vocabulary(
    lists: DataFrame, words: str, ngram_max: int, max_features: int, min_df: int, max_df: float
) -> DataFrame:
    """:func:`vocabulary` of the n-grams of word lists, without counting all of them.

    The n-th of the terms found so far bounds the counts of the vocabulary from below.  A
    longer term occurs no more often than its two parts that are one word shorter, so only
    terms whose parts reach the bound are counted.
    """
    n_docs = F.lit(lists.count()).cast("bigint")
    found, floor = None, 0
    for n in range(1, ngram_max + 1):
        rows = lists.select(F.inline(run_lengths(ngrams(F.col(words), n))))
        if n > 1:
            parts = found.where((F.col("size") == n - 1) & (F.col("cf") >= floor)).select(F.col("term").alias("_part"))
            for cut in (n - 1, 1 - n):
                rows = rows.join(parts, F.substring_index("term", " ", cut) == F.col("_part"), "left_semi")
        stats = rows.groupBy("term").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df"))
        counted = stored(stats.where(F.col("cf") >= floor).withColumn("size", F.lit(n)), "term-stats")
        found = counted if found is None else found.unionByName(counted)
        bounded = found.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * max_df))
        top = bounded.orderBy(F.col("cf").desc(), "term").limit(max_features)
        last = top.agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("cf")).first()
        if 0 < max_features == last.n:
            floor = last.cf
    return top.select("term", "df", n_docs.alias("n_docs"))


def tfidf(
    df: DataFrame,
    profile: Profile,
    k: int | None = None,
    min_df: int = 1,
    key: str = "call_id",
    text: str = "text",
) -> DataFrame:
    """Corpus TF-IDF topics, ``(key, term, weight, rank)``; one row per call in.

    tf x (ln((1+n)/(1+df)) + 1), L2-normalised per call over the vocabulary.
    """
    # the texts are cut once, into the words that terms are counted from
    lists = stored(df.select(key, _kept(text, profile.stop_words).alias("_words")), "term-counts")
    counts = lists.select(key, F.inline(run_lengths(ngrams_upto(F.col("_words"), profile.ngram_max))))
    if profile.max_features is None:
        vocab = vocabulary(counts, lists, None, min_df, profile.max_df)
    else:
        vocab = frequent_vocabulary(lists, "_words", profile.ngram_max, profile.max_features, min_df, profile.max_df)
    # one exchange by call serves both windows; Catalyst broadcasts the vocabulary while
    # its size is under the threshold
    counts = counts.join(vocab, "term")
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    weighted = counts.select(key, "term", (F.col("n") * idf).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(key)))
    scaled = weighted.select(key, "term", (F.col("_w") / norm).alias("weight"))
    return top_k_per_call(
        scaled, [key], [F.round("weight", 12).desc(), F.col("term")], k or profile.max_topics
    )


def topic_rows(
    df: DataFrame, profile: Profile, k: int | None = None, key: str = "call_id", text: str = "text"
) -> DataFrame:
    """Topics as child rows with share of sentences and mean polarity of those sentences."""
    valued = F.transform(
        sentences(F.lower(text)),
        lambda s: F.struct(
            s.alias("s"), sent.mean_valence(tokens(s), profile.polarity).alias("p")
        ),
    )
    staged = df.select(key, phrase_topics(F.col(text), profile, k).alias("_t"), valued.alias("_s"))
    holding = F.transform(
        "_t",
        lambda t: F.struct(
            t["name"].alias("name"),
            t["relevance"].alias("relevance"),
            F.transform(
                F.filter("_s", lambda s: F.contains(s["s"], t["name"])), lambda s: s["p"]
            ).alias("p"),
        ),
    )
    rows = staged.select(key, F.size("_s").alias("_n"), F.inline(holding))
    hits = F.size("p")
    return rows.select(
        key,
        "name",
        "relevance",
        F.array("name").alias("keywords"),
        (hits / F.col("_n")).alias("discussion_share"),
        F.coalesce(
            F.try_divide(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), hits), F.lit(0.0)
        ).alias("topic_sentiment"),
    )


def fulltext_search(
    df: DataFrame, query: str, k: int, stop_words, key: str = "call_id", text: str = "text"
) -> DataFrame:
    """Transcripts holding every query term, ranked by the sum of tf x idf.

    The query is cut into tokens as the texts are, so "follow-up?" asks for two terms.
    """
    terms = [t for t in dict.fromkeys(tokens_of(query)) if t not in stop_words]
    if not terms:
        raise ValueError("the query has no searchable term")
    # a cheap substring test first; only texts that pass are cut into tokens
    held = [F.contains(F.lower(text), F.lit(t)) for t in terms]
    toks = F.filter(tokens(F.col(text)), lambda t: t.isin(*terms))

    def hits(test: Column) -> DataFrame:
        return df.where(test).select(key, F.inline(run_lengths(toks)))

    n_docs = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    # at most one row per query term
    weights = hits(reduce(or_, held)).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", (F.log((n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )
    scored = hits(reduce(and_, held)).join(F.broadcast(weights), "term").groupBy(key).agg(
        F.count(F.lit(1)).alias("_found"), F.sum(F.col("n") * F.col("idf")).alias("score")
    )
    found = scored.where(F.col("_found") == len(terms)).select(key, "score")
    return found.orderBy(F.round("score", 9).desc(), key).limit(k)
