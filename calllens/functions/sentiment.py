"""Lexicon sentiment of a token array."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from calllens.config import Profile
from calllens.functions.arrays import let

# Fixed values of the published rule: normalisation, negation and booster steps.
NORMALISER = 15.0
NEGATION = -0.74
BOOST = 0.293
LOOK_BACK = 3


def valence(tok: Column, polarity: dict) -> Column:
    """Weight of one token, null when it is not listed.

    Terms are grouped by weight so each distinct weight costs one hashed set test.
    """
    groups: dict[float, list[str]] = defaultdict(list)
    for term, weight in polarity.items():
        groups[float(weight)].append(term)
    out = None
    for weight, terms in sorted(groups.items()):
        test = tok.isin(*terms)
        out = F.when(test, F.lit(weight)) if out is None else out.when(test, F.lit(weight))
    return F.lit(None).cast("double") if out is None else out


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def valences(toks: Column, polarity: dict) -> Column:
    """The weight of each token, null for those not listed."""
    return F.transform(toks, lambda t: valence(t, polarity))


def mean_valence(toks: Column, polarity: dict) -> Column:
    """Mean weight of the listed tokens, 0 when there are none."""
    return mean_of(valences(toks, polarity))


def mean_of(values: Column) -> Column:
    """Mean of the weights that are not null, 0 when there are none."""
    hits = F.filter(values, lambda v: v.isNotNull())
    return let(hits, lambda h: F.when(F.size(h) == 0, F.lit(0.0)).otherwise(_sum(h) / F.size(h)))


def _any_before(toks: Column, i: Column, terms) -> Column:
    found = F.lit(False)
    for back in range(1, LOOK_BACK + 1):
        found = found | F.coalesce(F.get(toks, i - back).isin(*terms), F.lit(False))
    return found


def weighted_valences(toks: Column, profile: Profile, values: Column | None = None) -> Column:
    """Valence of each listed token after boosters and negation among the three before it;
    ``values`` are the bound :func:`valences`, where they are at hand."""
    if values is None:
        return let(valences(toks, profile.polarity), lambda v: weighted_valences(toks, profile, v))
    hits = F.filter(F.transform(toks, lambda _, i: i), lambda i: F.get(values, i).isNotNull())

    def adjusted(i: Column) -> Column:
        v = F.get(values, i)
        up = F.when(_any_before(toks, i, profile.boosters_up), BOOST).otherwise(0.0)
        down = F.when(_any_before(toks, i, profile.boosters_down), BOOST).otherwise(0.0)
        v = v + F.signum(v) * (up - down)
        return F.when(_any_before(toks, i, profile.negators), v * NEGATION).otherwise(v)

    return F.transform(hits, adjusted)


def normalise(total: Column) -> Column:
    return total / F.sqrt(total * total + NORMALISER)


def compound(toks: Column, profile: Profile, values: Column | None = None) -> Column:
    return let(_sum(weighted_valences(toks, profile, values)), normalise)


def ensemble(comp: Column, polarity: Column, model: Column, profile: Profile) -> Column:
    a, b, c = profile.ensemble
    return comp * F.lit(a) + polarity * F.lit(b) + F.coalesce(model, F.lit(0.0)) * F.lit(c)
