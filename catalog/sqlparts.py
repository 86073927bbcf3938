"""SQL fragments shared by the checking statements."""

from __future__ import annotations

from calllens.lexicons import STOP_WORDS


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def any_like(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(t)})" for t in terms) + ")"


def hits(expr: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {lit(t)}) AS INTEGER)" for t in terms) + ")"


def hit_list(expr: str, terms, prefix: str = "") -> str:
    picks = ", ".join(f"CASE WHEN contains({expr}, {lit(t)}) THEN {lit(prefix + t)} END" for t in terms)
    return f"list_filter([{picks}], lambda x: x IS NOT NULL)"


WORD = r"[\p{L}\p{N}_'']+"


def toks(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD}')"


def sents(text: str) -> str:
    marked = rf"regexp_replace({text}, '([.!?]+)(\s+|$)', '\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), "
        "lambda s: s <> '')"
    )


# domain views -------------------------------------------------------------

TRANSCRIPTS = """transcripts AS (
  SELECT doc_id AS call_id,
         'transcripts/' || source || '/call-' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
         'call-' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name,
         n_chars AS size_bytes, source AS uploader, lang, text
  FROM documents)"""

TURNS = """turns AS (
  SELECT conv_id AS call_id, turn,
         CASE WHEN role = 'user' THEN 'prospect' ELSE 'sales_representative' END AS speaker, text
  FROM conversations WHERE role <> 'system')"""

# prospects ask, so that question operators have something to count
ASKING = """asking AS (
  SELECT call_id, turn, speaker,
         CASE WHEN speaker = 'prospect' THEN replace(text, '.', '?') ELSE text END AS text
  FROM turns)"""

ASKING_DOCS = """asking_docs AS (
  SELECT call_id, CASE WHEN lang <> 'en' THEN replace(text, '.', '?') ELSE text END AS text
  FROM transcripts)"""

CALLS = """calls AS (
  SELECT *, CASE WHEN score >= 80 THEN 'Hot' WHEN score >= 60 THEN 'Warm'
                 WHEN score >= 30 THEN 'Cold' ELSE 'Unqualified' END AS lead_class,
         score / 100 AS confidence
  FROM (SELECT event_id AS call_id, 'call-' || CAST(event_id AS VARCHAR) || '.json' AS file_name,
               ts AS uploaded_at, user_id, event_type AS job_type,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score,
               greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 50.0)) AS sentiment,
               value AS duration, CAST(trunc(value * 1000) AS BIGINT) AS size_bytes,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status
        FROM events) AS e)"""

METRICS = """metrics AS (
  SELECT event_id AS metric_id, 'processing_value' AS metric_name, event_type AS component,
         CASE WHEN user_id < 75 THEN 'production' ELSE 'staging' END AS environment,
         value, ts, user_id FROM events)"""

LOGS = """logs AS (
  SELECT event_id AS log_id, user_id AS analysis_id,
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS log_level,
         event_type AS stage, ts FROM events)"""


def tok_rows(source: str, keys: str = "call_id", name: str = "tok") -> str:
    return f"""{name} AS (
  SELECT {keys}, unnest(t) AS tok, unnest(range(len(t))) AS pos
  FROM (SELECT {keys}, {toks('text')} AS t FROM {source}) AS x)"""


def sent_rows(source: str, keys: str = "call_id", name: str = "sent") -> str:
    return f"""{name} AS (
  SELECT {keys}, unnest(s) AS sent, unnest(range(len(s))) AS idx, len(s) AS n
  FROM (SELECT {keys}, {sents('text')} AS s FROM {source}) AS x)"""


def phrase_rows(source: str, keys: str = "call_id", min_chars: int = 3, name: str = "phr") -> str:
    """Runs of consecutive words without stop words or punctuation."""
    return rf"""piece AS (
  SELECT {keys}, unnest(p) AS w, unnest(range(len(p))) AS i
  FROM (SELECT {keys}, regexp_extract_all(lower(text), '{WORD}|[^\p{{L}}\p{{N}}_''\s]') AS p
        FROM {source}) AS x),
split AS (
  SELECT *, (w IN {in_list(STOP_WORDS)} OR NOT regexp_matches(w, '[\p{{L}}\p{{N}}_'']')) AS brk FROM piece),
grouped AS (
  SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY {keys} ORDER BY i) AS run FROM split),
{name} AS (
  SELECT {keys}, min(i) AS pos, string_agg(w, ' ' ORDER BY i) AS phrase
  FROM grouped WHERE NOT brk GROUP BY {keys}, run
  HAVING count(*) >= 2 AND length(string_agg(w, ' ' ORDER BY i)) > {min_chars})"""
