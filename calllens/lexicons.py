"""Default word lists and token patterns.

Everything here is data: each operator takes its lists from a
:class:`calllens.config.Profile` (or an explicit argument), so a user replaces
them with ``dataclasses.replace`` or passes a lexicon table to the join
operators instead.
"""

from __future__ import annotations

from itertools import product

# --------------------------------------------------------------------------
# Results depend on these exact terms.

INTEREST_V31 = ("interested", "yes", "definitely", "sounds good", "love this", "perfect")
INTEREST_V30 = ("interested", "yes", "definitely", "sounds good", "love this")

BUYING_V31 = ("when can we", "how much", "pricing", "cost", "budget", "timeline", "next steps")
BUYING_V30 = ("when can we", "how much", "pricing", "cost", "budget", "timeline")

CONCERN_V31 = ("expensive", "too much", "not sure", "need to think", "budget constraints")
CONCERN_V30 = ("expensive", "too much", "not sure", "need to think", "budget")

ANALYTICAL_V31 = ("data", "numbers", "metrics")
ANALYTICAL_V30 = ("data", "numbers")

TECHNICAL_V31 = ("api", "sdk", "cloud", "database", "integration", "analytics", "platform",
                 "solution", "system", "software", "technology")
TECHNICAL_V30 = ("api", "sdk", "cloud", "database", "integration", "analytics")

COMPETITOR_V31 = ("competitor", "alternative", "versus", "vs", "other solution",
                  "different option", "comparison")
COMPETITOR_V30 = ("competitor", "alternative", "versus", "vs", "other solution")

PRICE_V31 = ("cost", "price", "budget", "expensive", "affordable", "investment", "fee")
PRICE_V30 = ("cost", "price", "budget", "expensive", "cheap", "affordable")

OPEN_ENDED_V31 = ("what", "how", "why", "tell me", "describe")
OPEN_ENDED_V30 = ("what", "how", "why", "tell me")
YES_NO_V31 = ("are", "is", "do", "does", "can", "will", "would")
YES_NO_V30 = ("are", "is", "do", "does", "can", "will")
CLARIFYING_V31 = ("so", "just to clarify", "you mean", "correct me")
CLARIFYING_V30 = ("so", "just to clarify", "you mean")

PHRASE_BLOCKED_STARTS_V31 = ("this", "that", "these", "those", "it", "they")
PHRASE_BLOCKED_STARTS_V30 = ("this", "that", "these", "those")

FEATURE_POSITIVE = ("interested", "sounds good", "perfect", "great", "excellent", "love it",
                    "amazing", "fantastic", "definitely", "absolutely")
FEATURE_QUESTION = ("what", "when", "where", "why", "how", "can", "could", "would")

ENTHUSIASM = ("wow", "amazing", "incredible", "fantastic", "awesome", "perfect", "excellent",
              "brilliant", "outstanding")
AGREEMENT = ("yes", "absolutely", "definitely", "certainly", "exactly")

# A pattern is one tuple of alternatives per token position.
INTEREST_PATTERNS_V31 = (
    (ENTHUSIASM,),
    (("love", "like"), ("this", "that", "it")),
    (("this",), ("is",), ("great", "perfect", "amazing", "exactly", "right")),
    (AGREEMENT, ("right", "correct", "true")),
    (("when", "how"), ("can", "do", "would"), ("we", "i")),
    (("what", "how"), ("much", "does", "would"), ("cost", "price", "pricing", "budget")),
)
INTEREST_PATTERNS_V30 = (
    (ENTHUSIASM,),
    (("love", "like"), ("this", "that", "it")),
    (("this",), ("is",), ("great", "perfect", "amazing", "awesome", "exactly")),
    (AGREEMENT, ("right", "correct", "true")),
    (("that's",), ("great", "perfect", "amazing", "awesome", "right", "correct")),
    (("when", "how"), ("can", "do", "would"), ("we", "i")),
    (("what's", "what", "how"), ("the", "much", "does"), ("cost", "price", "pricing")),
)
OBJECTION_PATTERNS = (
    (("but", "however", "although"), ("we",)),
    (("too", "very"), ("expensive", "costly", "high", "much")),
    (("not", "don't", "can't", "won't"), ("sure", "think", "see", "afford")),
    (("need",), ("to",), ("think", "discuss", "consider")),
)

# --------------------------------------------------------------------------
# Defaults of our own: starting points a user is expected to replace.

POLARITY = {
    **{w: 1.0 for w in ENTHUSIASM},
    **{w: 1.0 for w in ("interested", "great", "definitely", "absolutely", "love", "good")},
    **{w: -1.0 for w in ("expensive", "costly", "problem", "difficult", "bad", "worried")},
}
NEGATORS = ("not", "no", "never", "don't", "can't", "won't", "isn't", "doesn't", "without")
BOOSTERS_UP = ("very", "really", "extremely", "absolutely", "so")
BOOSTERS_DOWN = ("slightly", "somewhat", "barely", "hardly")

STOP_WORDS = tuple(
    "a about after again all am an and any are as at be because been before being between both "
    "but by can could did do does doing down during each few for from further had has have "
    "having he her here hers him his how i if in into is it its just me more most my no nor not "
    "now of off on once only or other our out over own same she should so some such than that "
    "the their them then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with would you your yours".split()
)


def pattern_phrases(patterns) -> list[tuple[int, str]]:
    """``(token length, phrase)`` for every combination of the alternatives, once each."""
    seen = {}
    for pattern in patterns:
        for words in product(*pattern):
            seen.setdefault(" ".join(words), len(words))
    return [(n, phrase) for phrase, n in seen.items()]
