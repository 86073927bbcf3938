"""Entities, technical terms and signal lists as row-local array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from calllens.config import Profile
from calllens.functions.tokens import tokens

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL = r"(?:https?://|www\.)[^\s<>\"')\]]*[^\s<>\"')\].,;:!?]"
NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
MONEY = r"[$€£]\s?" + NUMBER
PERCENT = NUMBER + r"\s?%"
WORDLIKE = r"\p{N}*[\p{L}_][\p{L}\p{N}_']*"
# One pass over the text; the leftmost alternative wins, words absorb their digits.
# Possessive repeats ("++") only where the next character cannot belong to the run.
SCAN = "|".join([
    EMAIL.replace("]+@", "]++@"), URL, MONEY, PERCENT, r"\p{N}*+[\p{L}_][\p{L}\p{N}_']*+", NUMBER
])
# every entity holds a digit, one of @$€£%: or "www.", and hardly any word does
# Blank-separated chunks without such a mark, as many in a row as there are.
UNMARKED = r"(?<![^ ])(?:(?:[^ w\p{N}@$€£%:]++|w(?!ww\.))++(?![^ ]) ?)++"


def contains_any(text: Column, terms) -> Column:
    """Whether any term occurs as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def present(text: Column, terms, match: str = "substring") -> list[Column]:
    """One boolean per term: does it occur in the lower-cased ``text``?

    ``match='token'`` asks for whole tokens instead of a substring.
    """
    if match == "substring":
        return [F.contains(text, F.lit(t)) for t in terms]
    if match == "token":
        padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
        return [F.contains(padded, F.lit(f" {t} ")) for t in terms]
    raise ValueError(f"unknown match mode: {match!r}")


def matched(text: Column, terms, match: str = "substring", prefix: str = "") -> Column:
    """The terms that occur, in list order, each with ``prefix``."""
    return labelled(present(text, terms, match), terms, prefix)


def labelled(flags: list[Column], terms, prefix: str = "") -> Column:
    picks = [F.when(flag, F.lit(prefix + term)) for flag, term in zip(flags, terms)]
    return F.array_compact(F.array(*picks))


def count_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags])


def entity_label(piece: Column) -> Column:
    """Label of one scanned piece, null for plain words."""
    first = F.substring(piece, 1, 1)
    return (
        F.when(first.isin("$", "€", "£"), "MONEY")
        .when(F.endswith(piece, F.lit("%")) & first.rlike(r"\p{N}"), "PERCENT")
        .when(is_email(piece), "EMAIL")
        .when(is_url(piece), "URL")
        .when(piece.rlike(r"\A\p{N}[\p{N}.,]*\z"), "CARDINAL")
    )


def is_email(piece: Column) -> Column:
    return F.contains(piece, F.lit("@")) & piece.rlike(r"\A" + EMAIL + r"\z")


def is_url(piece: Column) -> Column:
    starts = [F.startswith(piece, F.lit(p)) for p in ("http://", "https://", "www.")]
    return starts[0] | starts[1] | starts[2]


def scan(c: Column) -> Column:
    """Words, numbers, money, links and addresses in text order."""
    return F.regexp_extract_all(c, F.lit(SCAN), F.lit(0))


def entities(c: Column) -> Column:
    """Pattern entities in text order, ``array<struct<label, text>>``.

    Blank-separated chunks without a mark cannot touch an entity; they are blanked
    out first, so the long pattern runs over little text.
    """
    scanned = F.transform(
        scan(F.regexp_replace(c, UNMARKED, "| ")),
        lambda p: F.struct(entity_label(p).alias("label"), p.alias("text")),
    )
    return F.filter(scanned, lambda e: e["label"].isNotNull())


def entity_texts(ents: Column, labels) -> Column:
    return F.transform(
        F.filter(ents, lambda e: e["label"].isin(*labels)), lambda e: e["text"]
    )


def technical_terms(c: Column, profile: Profile) -> Column:
    """Distinct listed terms, all-caps words longer than two, and links; sorted."""
    return technical_from(scan(c), profile)


def technical_from(pieces: Column, profile: Profile) -> Column:

    def technical(p: Column) -> Column:
        capitals = (F.upper(p) == p) & p.rlike(r"\A\p{Lu}{3,}\z")
        test = F.lower(p).isin(*profile.technical) | capitals
        return test | is_url(p) | is_email(p) if profile.technical_links else test

    # distinct first, as the test takes longer
    return F.sort_array(F.filter(F.array_distinct(pieces), technical))
