"""Lexicon sentiment, the ensemble, and a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calllens.config import Profile
from calllens.functions import sentiment as sent
from calllens.functions.arrays import let
from calllens.functions.text import emotions
from calllens.functions.tokens import tokens


def lexicon_sentiment(
    df: DataFrame, profile: Profile, text: str = "text"
) -> DataFrame:
    """Add ``compound`` and ``polarity`` from the profile's word list; narrow."""
    both = let(
        tokens(F.col(text)),
        lambda t: F.struct(
            sent.compound(t, profile).alias("compound"),
            sent.mean_valence(t, profile.polarity).alias("polarity"),
        ),
    )
    return df.withColumn("_s", both).select(*df.columns, "_s.compound", "_s.polarity")


def lexicon_sentiment_table(
    df: DataFrame, lexicon: DataFrame, profile: Profile, key: str = "call_id", text: str = "text"
) -> DataFrame:
    """As :func:`lexicon_sentiment` for a lexicon table ``(term, weight)`` of any size.

    Each token row carries the three tokens before it, so negation and boosters
    need no window.  Sums merge per call before the shuffle; calls without a
    listed token stay, with zeros.
    """

    def placed(toks):
        def row(t, i):
            back = F.array(*[F.get(toks, i - b) for b in range(1, sent.LOOK_BACK + 1)])
            return F.struct(
                t.alias("tok"),
                F.arrays_overlap(back, F.array(*[F.lit(w) for w in profile.negators])).alias("neg"),
                F.arrays_overlap(back, F.array(*[F.lit(w) for w in profile.boosters_up])).alias("up"),
                F.arrays_overlap(back, F.array(*[F.lit(w) for w in profile.boosters_down])).alias("down"),
            )

        return F.transform(toks, row)

    rows = df.select(key, F.inline_outer(let(tokens(F.col(text)), placed)))
    joined = rows.join(lexicon, rows["tok"] == lexicon["term"], "left")

    def flag(name):
        return F.coalesce(F.col(name), F.lit(False))

    step = F.when(flag("up"), sent.BOOST).otherwise(0.0) - F.when(flag("down"), sent.BOOST).otherwise(0.0)
    boosted = F.col("weight") + F.signum("weight") * step
    adjusted = F.when(flag("neg"), boosted * sent.NEGATION).otherwise(boosted)
    sums = joined.groupBy(key).agg(
        F.coalesce(F.sum(adjusted), F.lit(0.0)).alias("_total"),
        F.coalesce(F.avg("weight"), F.lit(0.0)).alias("polarity"),
    )
    return sums.select(key, sent.normalise(F.col("_total")).alias("compound"), "polarity")


def ensemble_sentiment(
    df: DataFrame, profile: Profile, text: str = "text", model_col: str | None = None
) -> DataFrame:
    """Add sentiment score, confidence and the emotion shares.

    A null text takes the neutral fallback: 0, 0, neutral 1.
    """
    base = lexicon_sentiment(df, profile, text)
    model = F.col(model_col) if model_col else F.lit(0.0)
    scored = base.withColumn(
        "sentiment_score",
        F.coalesce(sent.ensemble(F.col("compound"), F.col("polarity"), model, profile), F.lit(0.0)),
    )
    shares = emotions(F.col("sentiment_score"))
    return scored.select(
        *df.columns,
        "compound",
        "polarity",
        "sentiment_score",
        F.coalesce(F.greatest("compound", F.abs("polarity")), F.lit(0.0)).alias("sentiment_confidence"),
        *[c.alias(n) for n, c in shares.items()],
    )


def model_scores(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
    text: str = "text",
    max_chars: int | None = None,
    batch: int = 8,
    out: str = "model_score",
) -> DataFrame:
    """Add the signed score of a user model: POSITIVE counts up, NEGATIVE down.

    ``load()`` runs once per task and returns a function from a list of texts to
    ``(label, score)`` pairs.  This is the only place Python sees text.  Whole
    texts are passed unless the model itself needs them cut at ``max_chars``.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for series in batches:
            texts = series.fillna("").tolist()
            if max_chars is not None:
                texts = [t[:max_chars] for t in texts]
            values: list[float] = []
            for at in range(0, len(texts), batch):
                for label, value in model(texts[at : at + batch]):
                    sign = {"POSITIVE": 1, "POS": 1, "NEGATIVE": -1, "NEG": -1}.get(label.upper(), 0)
                    values.append(sign * float(value))
            yield pd.Series(values, dtype="float64")

    return df.withColumn(out, score(F.col(text)))


def word_windows(text: str, size: int, overlap: int) -> Iterator[tuple[str, int]]:
    """The text's blank-separated words in windows of ``size``, each beginning ``overlap``
    words before the end of the one before; with the number of words in each."""
    words = text.split()
    at = 0
    while at < len(words):
        part = words[at : at + size]
        yield " ".join(part), len(part)
        if at + size >= len(words):
            return
        at += size - overlap


def emotion_scores(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], list[dict[str, float]]]],
    text: str = "text",
    size: int = 256,
    overlap: int = 32,
    batch: int = 8,
    out: str = "emotions",
) -> DataFrame:
    """Add a map of labels and scores by a user model, over whole texts.

    ``load()`` runs once per task and returns a function from a list of texts to a
    ``{label: score}`` each.  Models read only so much at once, so a text goes to it in
    overlapping windows of ``size`` words, ``batch`` windows at a time, and a label's score
    is the mean over the windows, weighted by their words; where a window lacks a label it
    counts as 0.  A text without words has a null map.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the window")

    @F.pandas_udf("labels array<string>, scores array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for series in batches:
            totals: list[dict[str, float]] = [{} for _ in range(len(series))]
            weights = [0] * len(series)
            held: list[tuple[int, str, int]] = []

            def passed() -> None:
                for (row, _, n), labels in zip(held, model([t for _, t, _ in held])):
                    weights[row] += n
                    for label, value in labels.items():
                        totals[row][label] = totals[row].get(label, 0.0) + n * float(value)
                held.clear()

            for row, value in enumerate(series):
                for part, n in word_windows(value or "", size, overlap):
                    held.append((row, part, n))
                    if len(held) == batch:
                        passed()
            if held:
                passed()
            named = [sorted(t) if w else None for t, w in zip(totals, weights)]
            means = [[t[x] / w for x in sorted(t)] if w else None for t, w in zip(totals, weights)]
            yield pd.DataFrame({"labels": named, "scores": means})

    scored = df.withColumn("_e", score(F.col(text)))
    return scored.withColumn(out, F.map_from_arrays("_e.labels", "_e.scores")).drop("_e")
