"""Key phrases, entities, competitors, pricing and technical terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calllens.config import Profile
from calllens.functions import extract
from calllens.functions import patterns as pt
from calllens.functions.arrays import first_distinct, let, rows_of
from calllens.functions.tokens import candidate_phrases, sentences, tokens, tokens_of, words
from calllens.lexicons import pattern_phrases
from calllens.operators.topics import top_k_per_call
from calllens.session import small_table, stored

PHRASE_LABELS = ("MONEY", "PERCENT")
#: Buckets near a match that are sent to the tasks.
FEW = 200_000


def name_patterns(names) -> list[tuple]:
    """Names as token patterns, cut into tokens as texts are; a name without any is left out."""
    return [tuple((w,) for w in toks) for toks in map(tokens_of, names) if toks]


def _names(toks: Column, names) -> Column:
    """Texts of the listed names found in a bound token array, in order."""
    found = pt.spans(toks, name_patterns(names))
    return F.transform(found, lambda s: pt.span_text(toks, s["start"], s["n"]))


def key_phrases_array(c: Column, profile: Profile, names=()) -> Column:
    """Phrases then entities, lower case, distinct, first k.

    ``names`` is a short in-memory name list; for a name table use
    :func:`gazetteer_join` with :func:`union_phrases`.
    """
    phrases = candidate_phrases(c, profile.stop_words, profile.min_phrase_words, profile.phrase_min_chars)
    return key_phrases_from(phrases, extract.entities(c), tokens(c), profile, names)


def key_phrases_from(phrases: Column, ents: Column, toks: Column, profile: Profile, names=()) -> Column:
    blocked = r"\A(?:" + "|".join(profile.phrase_blocked_starts) + ")"
    kept = F.filter(
        phrases, lambda p: (F.length(p) > profile.phrase_min_chars) & ~p.rlike(blocked)
    )
    parts = [kept, F.transform(extract.entity_texts(ents, PHRASE_LABELS), lambda e: F.lower(e))]
    if names:
        parts.append(let(toks, lambda t: _names(t, names)))
    return first_distinct(F.concat(*parts), profile.max_phrases)


def key_phrases(
    df: DataFrame, profile: Profile, names=(), key: str = "call_id", text: str = "text"
) -> DataFrame:
    """One row per kept phrase ``(key, pos, phrase)``."""
    return df.select(key, rows_of(key_phrases_array(F.col(text), profile, names), "phrase", "pos"))


def entity_rows(df: DataFrame, key: str = "call_id", text: str = "text") -> DataFrame:
    """Pattern entities ``(key, pos, label, text)``."""
    numbered = F.transform(
        extract.entities(F.col(text)),
        lambda e, i: F.struct(i.alias("pos"), e["label"].alias("label"), e["text"].alias("entity")),
    )
    return df.select(key, F.inline(numbered))


def technical_terms(
    df: DataFrame, profile: Profile, key: str = "call_id", text: str = "text"
) -> DataFrame:
    return df.select(key, extract.technical_terms(F.col(text), profile).alias("technical_terms"))


def competitor_array(c: Column, profile: Profile, names) -> Column:
    """Listed organisations in the sentences that hold a competitor indicator."""
    return competitors_from(sentences(c), profile, names)


def competitors_from(sents: Column, profile: Profile, names) -> Column:
    near = F.filter(
        sents, lambda s: extract.contains_any(F.lower(s), profile.competitor)
    )
    return F.flatten(
        F.transform(
            near,
            lambda s: let(
                words(s),
                lambda ws: let(
                    F.transform(ws, lambda w: F.lower(w)),
                    lambda toks: F.transform(
                        pt.spans(toks, name_patterns(names)),
                        lambda m: pt.span_text(ws, m["start"], m["n"]),
                    ),
                ),
            ),
        )
    )


def pricing_array(c: Column, profile: Profile) -> Column:
    """Money, percent (and number) mentions, then sentences with a price keyword."""
    return pricing_from(extract.entities(c), sentences(c), profile)


def pricing_from(ents: Column, sents: Column, profile: Profile) -> Column:
    mentions = extract.entity_texts(ents, profile.pricing_labels)
    priced = F.filter(
        sents, lambda s: extract.contains_any(F.lower(s), profile.price)
    )
    both = F.concat(mentions, priced)
    return both if profile.max_pricing is None else F.slice(both, 1, profile.max_pricing)


def pricing_mentions(
    df: DataFrame, profile: Profile, key: str = "call_id", text: str = "text"
) -> DataFrame:
    return df.select(key, rows_of(pricing_array(F.col(text), profile), "mention", "pos"))


# ---------------------------------------------------------------- table forms


def token_rows(df: DataFrame, key: str = "call_id", text: str = "text") -> DataFrame:
    """``(key, pos, tok)``."""
    return df.select(key, rows_of(tokens(F.col(text)), "tok", "pos"))


def sentence_rows(df: DataFrame, key: str = "call_id", text: str = "text") -> DataFrame:
    """``(key, idx, n, sent)``."""
    numbered = let(
        sentences(F.col(text)),
        lambda ss: F.transform(
            ss, lambda s, i: F.struct(i.alias("idx"), s.alias("sent"), F.size(ss).alias("n"))
        ),
    )
    return df.select(key, F.inline(numbered))


def lexicon_join(tokens_df: DataFrame, lexicon: DataFrame, term: str = "term") -> DataFrame:
    """Attach lexicon columns to matching tokens.

    Unhinted on purpose: Catalyst broadcasts the lexicon when its size is under
    the threshold and otherwise shuffles, where AQE splits the hot tokens.
    """
    return tokens_df.join(lexicon, tokens_df["tok"] == lexicon[term]).drop(lexicon[term])


def pattern_table(spark: SparkSession, patterns) -> DataFrame:
    """Token patterns as rows ``(n, phrase)``, expanded once on the driver."""
    rows = small_table(spark, pattern_phrases(patterns), ["n", "phrase"])
    return rows.withColumn("n", F.col("n").cast("int"))


def pattern_trie(table: DataFrame) -> DataFrame:
    """A pattern table ``(n, phrase)`` as a trie: an edge ``(depth, parent, tok, node, ends)``
    per distinct beginning, named by its text; ``ends`` where a pattern does."""
    cut = table.select(F.split("phrase", " ").alias("t"))
    edges = cut.select(
        F.inline(
            F.transform(
                F.sequence(F.lit(1), F.size("t")),
                lambda i: F.struct(
                    i.alias("depth"),
                    F.array_join(F.slice("t", F.lit(1), i - 1), " ").alias("parent"),
                    F.get("t", i - 1).alias("tok"),
                    F.array_join(F.slice("t", F.lit(1), i), " ").alias("node"),
                    (i == F.size("t")).alias("ends"),
                ),
            )
        )
    )
    return edges.groupBy("depth", "parent", "tok", "node").agg(F.bool_or("ends").alias("ends"))


def pattern_matches(
    df: DataFrame, table: DataFrame, keys=("call_id",), text: str = "text"
) -> DataFrame:
    """Matches of a pattern table of any size ``(keys, pos, n, phrase)``; patterns may
    be of any length.

    Tokens that begin a pattern are the first live beginnings; in every further step a
    beginning lives on if its next token continues a pattern.  Only tokens that some
    pattern holds are kept, and no n-gram is built.
    """
    keys = list(keys)
    trie = stored(pattern_trie(table), "pattern-trie")
    longest = trie.agg(F.max("depth")).first()[0] or 0
    rows = df.select(*keys, rows_of(tokens(F.col(text)), "tok", "pos"))
    known = trie.select("tok").distinct()
    toks = stored(rows.join(known, "tok", "left_semi").select(*keys, "pos", "tok"), "pattern-tokens")
    live = toks.join(trie.where("depth = 1"), "tok").select(*keys, F.col("pos").alias("_start"), "node", "ends")
    found = []
    for depth in range(1, longest + 1):
        if depth > 1:
            ahead = live.select(*keys, "_start", F.col("node").alias("parent"), (F.col("_start") + depth - 1).alias("pos"))
            stepped = ahead.join(toks, [*keys, "pos"]).join(trie.where(F.col("depth") == depth), ["parent", "tok"])
            live = stored(stepped.select(*keys, "_start", "node", "ends"), "pattern-steps")
        found.append(live.where("ends").select(*keys, F.col("_start").alias("pos"), F.lit(depth).alias("n"), F.col("node").alias("phrase")))
        if depth > 1 and live.isEmpty():
            break
    if not found:
        return live.select(*keys, F.col("_start").alias("pos"), F.lit(0).alias("n"), F.col("node").alias("phrase"))
    return reduce(DataFrame.unionByName, found)


def gazetteer_join(
    sents: DataFrame, names: DataFrame, keys=("call_id", "idx"), sent: str = "sent"
) -> DataFrame:
    """``(keys, pos, n, phrase, label)`` of names found in sentences.

    ``names`` is ``(name, label)`` with names of any number and length, cut into tokens
    as texts are; a name without any is left out.  One row per token, with the tokens
    that follow it as far as the longest name reaches, meets the names that begin with it.
    """
    named = names.select("label", tokens(F.col("name")).alias("_t")).where(F.size("_t") > 0)
    named = named.select(
        "label", F.array_join("_t", " ").alias("phrase"), F.size("_t").alias("n"), F.get("_t", F.lit(0)).alias("_first")
    )
    longest = named.agg(F.max("n")).first()[0] or 1
    ahead = let(
        tokens(F.col(sent)),
        lambda toks: F.transform(
            toks, lambda t, i: F.struct(i.alias("pos"), t.alias("_first"), F.slice(toks, i + 1, longest).alias("_ahead"))
        ),
    )
    found = sents.select(*keys, F.inline(ahead)).join(named, "_first")
    return found.where(F.array_join(F.slice("_ahead", F.lit(1), F.col("n")), " ") == F.col("phrase")).select(
        *keys, "pos", "n", "phrase", "label"
    )


def competitor_mentions(sents: DataFrame, names: DataFrame, profile: Profile) -> DataFrame:
    """Organisations named in a sentence with a competitor indicator.  Sentences are
    filtered before their n-grams are built."""
    near = sents.where(extract.contains_any(F.lower("sent"), profile.competitor))
    return gazetteer_join(near, names.where(F.col("label") == "ORG")).select(
        "call_id", "idx", "pos", F.col("phrase").alias("competitor")
    )


def context_window(
    matches: DataFrame, tokens_df: DataFrame, k: int, key: str = "call_id"
) -> DataFrame:
    """Tokens within ``k`` of each match ``(key, start, n)``: a range join.

    Both sides are cut into position buckets and meet by equality on
    (key, bucket), so a long call spreads over many tasks.  While the buckets near a match
    are few, which is checked, tokens elsewhere are left out before the shuffle.
    """
    width = 4 * k + 8
    lo, hi = F.col("start") - k, F.col("start") + F.col("n") + k - 1
    # stored, as the matches are looked at twice
    held = stored(matches.select(key, "start", "n"), "matches")
    spread = held.withColumn(
        "_b", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    )
    placed = tokens_df.withColumn("_b", F.floor(F.col("pos") / width))
    near = spread.select(key, "_b").distinct()
    if near.limit(FEW + 1).count() <= FEW:
        placed = placed.join(F.broadcast(near), [key, "_b"], "left_semi")
    joined = spread.join(placed, [key, "_b"]).where(
        (F.col("pos") >= lo) & (F.col("pos") <= hi)
    )
    return joined.select(key, "start", "n", "pos", "tok")


def union_phrases(
    phrases: DataFrame, entities: DataFrame, k: int, key: str = "call_id"
) -> DataFrame:
    """Phrases before entities, first occurrence of each kept, first ``k`` per call.

    Inputs ``(key, pos, phrase)``; output ``(key, phrase, rank)``.
    """
    both = phrases.select(key, "pos", "phrase", F.lit(0).alias("source_rank")).unionByName(
        entities.select(key, "pos", "phrase", F.lit(1).alias("source_rank"))
    )
    first = both.groupBy(key, F.lower("phrase").alias("phrase")).agg(
        F.min(F.struct("source_rank", "pos")).alias("_at")
    )
    return top_k_per_call(first, [key], [F.col("_at"), F.col("phrase")], k).select(key, "phrase", "rank")


def union_pricing(
    mentions: DataFrame, priced: DataFrame, k: int | None, key: str = "call_id"
) -> DataFrame:
    """Mentions before price sentences, duplicates kept.  Inputs ``(key, pos, mention)``."""
    both = mentions.select(key, "pos", "mention", F.lit(0).alias("source_rank")).unionByName(
        priced.select(key, "pos", "mention", F.lit(1).alias("source_rank"))
    )
    if k is None:
        return both
    return top_k_per_call(both, [key], [F.col("source_rank"), F.col("pos")], k).drop("rank")
