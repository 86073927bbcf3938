"""Named parameter sets (profiles) of the analysis operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from calllens import lexicons as lx


@dataclass(frozen=True)
class Profile:
    """All constants of one rule generation; derive variants with ``dataclasses.replace``."""

    name: str
    # cleaning
    artifacts: tuple[str, ...]
    speaker_tag: str
    squeeze: bool
    json_transcript_key: bool
    # lead score
    interest: tuple[str, ...]
    buying: tuple[str, ...]
    concern: tuple[str, ...]
    prefixes: tuple[str, str, str]
    weights: tuple[float, float, float, float]  # interest, buying, concern, sentiment
    length_cap: float
    tokens_per_point: float
    classes: tuple[tuple[float, str], ...]  # (lower bound, class), descending
    floor_class: str
    # insight labels
    analytical: tuple[str, ...]
    strategies: tuple[str, str]  # with concerns, without
    next_actions: tuple[str, ...]
    # extraction
    technical: tuple[str, ...]
    technical_links: bool
    competitor: tuple[str, ...]
    price: tuple[str, ...]
    pricing_labels: tuple[str, ...]
    max_pricing: int | None
    phrase_min_chars: int  # a phrase must be longer than this
    phrase_blocked_starts: tuple[str, ...]
    # questions
    open_ended: tuple[str, ...]
    yes_no: tuple[str, ...]
    clarifying: tuple[str, ...]
    sample_questions: int
    # patterns and timeline
    interest_patterns: tuple
    context_window: int
    moment_labels: tuple[str, str]  # topic, follow-up
    timeline_words: float
    # sentiment ensemble: compound, polarity, model
    ensemble: tuple[float, float, float]
    # corpus topics
    ngram_max: int
    max_features: int
    max_df: float
    # stated confidence of each component
    confidences: tuple[tuple[str, float], ...]
    # shared defaults
    objection_patterns: tuple = lx.OBJECTION_PATTERNS
    polarity: dict = field(default_factory=lambda: dict(lx.POLARITY))
    negators: tuple[str, ...] = lx.NEGATORS
    boosters_up: tuple[str, ...] = lx.BOOSTERS_UP
    boosters_down: tuple[str, ...] = lx.BOOSTERS_DOWN
    stop_words: tuple[str, ...] = lx.STOP_WORDS
    max_phrases: int = 20
    max_topics: int = 15
    min_phrase_words: int = 2
    call_seconds: float = 300.0
    words_per_minute: float = 150.0
    lead_confidence: float = 0.8
    # switches
    enable_sentiment: bool = True
    enable_topics: bool = True
    enable_emotions: bool = True
    enable_speakers: bool = True


# The constants, weights and output strings of the two rule generations.
V31 = Profile(
    name="v3.1",
    artifacts=("[inaudible]", "[unclear]", "[music]", "[background noise]"),
    speaker_tag=r"(?<![\p{L}\p{N}_])(?:Speaker \p{Nd}++|SPEAKER_\p{Nd}++|[\p{L}\p{N}_]++:)",
    squeeze=True,
    json_transcript_key=True,
    interest=lx.INTEREST_V31,
    buying=lx.BUYING_V31,
    concern=lx.CONCERN_V31,
    prefixes=("Expressed: ", "Inquired about: ", "Concern raised about: "),
    weights=(12.0, 18.0, -8.0, 15.0),
    length_cap=25.0,
    tokens_per_point=80.0,
    classes=((80.0, "Hot"), (60.0, "Warm"), (30.0, "Cold")),
    floor_class="Unqualified",
    analytical=lx.ANALYTICAL_V31,
    strategies=("Focus on addressing concerns", "Accelerate engagement"),
    next_actions=("Schedule follow-up", "Send additional information", "Prepare proposal"),
    technical=lx.TECHNICAL_V31,
    technical_links=True,
    competitor=lx.COMPETITOR_V31,
    price=lx.PRICE_V31,
    pricing_labels=("MONEY", "PERCENT", "CARDINAL"),
    max_pricing=10,
    phrase_min_chars=4,
    phrase_blocked_starts=lx.PHRASE_BLOCKED_STARTS_V31,
    open_ended=lx.OPEN_ENDED_V31,
    yes_no=lx.YES_NO_V31,
    clarifying=lx.CLARIFYING_V31,
    sample_questions=5,
    interest_patterns=lx.INTEREST_PATTERNS_V31,
    context_window=25,
    moment_labels=("general_interest", "Explore expressed interest in detail"),
    timeline_words=25.0,
    ensemble=(0.4, 0.35, 0.25),
    ngram_max=2,
    max_features=500,
    max_df=0.9,
    confidences=(
        ("sentiment_analysis", 0.85), ("topic_extraction", 0.8), ("lead_scoring", 0.78),
        ("interest_detection", 0.75), ("overall_analysis", 0.8),
    ),
)

V30 = Profile(
    name="v3.0",
    artifacts=("[inaudible]", "[unclear]"),
    speaker_tag=r"(?<![\p{L}\p{N}_])(?:Speaker \p{Nd}++|SPEAKER_\p{Nd}++):",
    squeeze=False,
    json_transcript_key=False,
    interest=lx.INTEREST_V30,
    buying=lx.BUYING_V30,
    concern=lx.CONCERN_V30,
    prefixes=("Mentioned: ", "Asked about: ", "Expressed concern about: "),
    weights=(10.0, 15.0, -5.0, 20.0),
    length_cap=20.0,
    tokens_per_point=100.0,
    classes=((75.0, "Hot"), (50.0, "Warm")),
    floor_class="Cold",
    analytical=lx.ANALYTICAL_V30,
    strategies=("Focus on value proposition", "Accelerate to close"),
    next_actions=("Schedule demo", "Send pricing", "Follow up in 3 days"),
    technical=lx.TECHNICAL_V30,
    technical_links=False,
    competitor=lx.COMPETITOR_V30,
    price=lx.PRICE_V30,
    pricing_labels=("MONEY", "PERCENT"),
    max_pricing=None,
    phrase_min_chars=3,
    phrase_blocked_starts=lx.PHRASE_BLOCKED_STARTS_V30,
    open_ended=lx.OPEN_ENDED_V30,
    yes_no=lx.YES_NO_V30,
    clarifying=lx.CLARIFYING_V30,
    sample_questions=10,
    interest_patterns=lx.INTEREST_PATTERNS_V30,
    context_window=30,
    moment_labels=("general", "Explore interest further"),
    timeline_words=20.0,
    ensemble=(0.4, 0.3, 0.3),
    ngram_max=3,
    max_features=1000,
    max_df=0.95,
    confidences=(
        ("sentiment_analysis", 0.85), ("topic_extraction", 0.8), ("lead_scoring", 0.78),
        ("wow_moments", 0.75), ("overall_analysis", 0.8),
    ),
)


@dataclass(frozen=True)
class Bootstrap:
    """The three-class keyword rule."""

    name: str = "bootstrap"
    hot: tuple[str, ...] = ("pricing", "interested")
    warm: tuple[str, ...] = ("call back",)
    confidence: float = 0.75


BOOTSTRAP = Bootstrap()


def profile(name: str) -> Profile:
    """The built-in profile called ``name``."""
    for candidate in (V31, V30):
        if candidate.name == name:
            return candidate
    raise ValueError(f"unknown profile: {name!r}")
