"""Text analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from calllens.functions import extract
from calllens.functions.text import trigram_similarity
from calllens.functions.tokens import sentence_ngrams, sentences, tokens
from calllens.lexicons import pattern_phrases
from calllens.operators import extraction, index, moments, similarity, topics
from calllens.operators import sentiment as senti
from calllens.plans.analysis import analyze_calls
from calllens.session import scratch_dir, small_table
from calllens.sources import tables
from catalog import sqlparts as sp
from catalog.aggregates import N_WORDS, POLARITY_CASE
from catalog.filters import SOME_TEXT_SQL, class_sql, score_sql, some_text
from catalog.projections import clean_sql
from catalog.registry import query
from catalog.views import ORGS, PROBE_V30, PROBE_V31


@query("tokenize", "call_id:long n_tokens:long n_sentences:long n_bigrams:long tokens_md5:str sentences_md5:str bigrams_md5:str",
       f"""WITH {sp.TRANSCRIPTS}, {sp.sent_rows('transcripts')}, {sp.tok_rows('(SELECT call_id, idx, sent AS text FROM sent) AS q', 'call_id, idx', 'stok')},
bi AS (SELECT a.call_id, count(*) AS n_bigrams, md5(string_agg(a.tok || ' ' || b.tok, '|' ORDER BY a.idx, a.pos)) AS bigrams_md5
  FROM stok AS a JOIN stok AS b ON a.call_id = b.call_id AND a.idx = b.idx AND b.pos = a.pos + 1 GROUP BY a.call_id) --final
SELECT t.call_id, len({sp.toks('t.text')}) AS n_tokens, len({sp.sents('t.text')}) AS n_sentences, coalesce(bi.n_bigrams, 0) AS n_bigrams,
  md5(array_to_string({sp.toks('t.text')}, '|')) AS tokens_md5, md5(array_to_string({sp.sents('t.text')}, '|')) AS sentences_md5,
  coalesce(bi.bigrams_md5, md5('')) AS bigrams_md5 FROM transcripts AS t LEFT JOIN bi USING (call_id)""")
def _(spark, sf):
    text = F.col("text")
    staged = tables.transcripts(spark, sf).select(
        "call_id", tokens(text).alias("t"), sentences(text).alias("s"), sentence_ngrams(text, 2).alias("b")
    )
    named = (("t", "tokens"), ("s", "sentences"), ("b", "bigrams"))
    return staged.select(
        "call_id",
        *[F.size(c).alias(f"n_{n}") for c, n in named],
        *[F.md5(F.array_join(c, "|")).alias(f"{n}_md5") for c, n in named],
    )


def _before(terms, column="tok") -> str:
    return " OR ".join(
        f"coalesce(lag({column}, {k}) OVER (PARTITION BY call_id ORDER BY pos) IN {sp.in_list(terms)}, FALSE)" for k in (1, 2, 3)
    )


P = PROBE_V31
# the compound of a lexicon: boosters, negation, then normalisation
SENTIMENT = f"""{sp.tok_rows('transcripts')},
flagged AS (SELECT call_id, pos, {POLARITY_CASE} AS v, ({_before(P.negators)}) AS neg, ({_before(P.boosters_up)}) AS up,
  ({_before(P.boosters_down)}) AS down FROM tok),
moved AS (SELECT call_id, v, (v + sign(v) * ((CASE WHEN up THEN 0.293 ELSE 0 END) - (CASE WHEN down THEN 0.293 ELSE 0 END)))
  * (CASE WHEN neg THEN -0.74 ELSE 1 END) AS a FROM flagged WHERE v IS NOT NULL),
summed AS (SELECT call_id, sum(a) AS s, avg(v) AS p FROM moved GROUP BY call_id),
senti AS (SELECT t.call_id, coalesce(s / sqrt(s * s + 15), 0)::DOUBLE AS compound, coalesce(p, 0)::DOUBLE AS polarity
  FROM transcripts AS t LEFT JOIN summed USING (call_id))"""


@query("lexicon_sentiment", "call_id:long compound:d6 polarity:d6",
       f"WITH {sp.TRANSCRIPTS}, {SENTIMENT} --final\nSELECT * FROM senti")
def _(spark, sf):
    return senti.lexicon_sentiment(tables.transcripts(spark, sf), PROBE_V31)


@query("lexicon_sentiment_table", "call_id:long compound:d6 polarity:d6",
       f"WITH {sp.TRANSCRIPTS}, {SENTIMENT} --final\nSELECT * FROM senti")
def _(spark, sf):
    lexicon = small_table(spark, list(PROBE_V31.polarity.items()), ["term", "weight"])
    return senti.lexicon_sentiment_table(tables.transcripts(spark, sf), lexicon, PROBE_V31)


def _ensemble(name, profile):
    a, b, _ = profile.ensemble

    @query(name, "call_id:long sentiment_score:d6 sentiment_confidence:d6 positive:d6 negative:d6 neutral:d6",
           f"""WITH {sp.TRANSCRIPTS}, {SENTIMENT}, mixed AS (SELECT *, compound * {a}::DOUBLE + polarity * {b}::DOUBLE AS s FROM senti) --final
SELECT call_id, s AS sentiment_score, greatest(compound, abs(polarity)) AS sentiment_confidence,
  greatest(0::DOUBLE, s) AS positive, greatest(0::DOUBLE, -s) AS negative, 1 - abs(s) AS neutral FROM mixed""")
    def _(spark, sf):
        return senti.ensemble_sentiment(tables.transcripts(spark, sf), profile)


_ensemble("ensemble_sentiment_v31", PROBE_V31)
_ensemble("ensemble_sentiment_v30", PROBE_V30)


def _toy_model():
    def score(texts):
        return [("NEG" if " the " in t else "POSITIVE", 1.0 / (1 + len(t))) for t in texts]

    return score


@query("model_scores", "call_id:long model_score:d6 sentiment_score:d6",
       f"""WITH {sp.TRANSCRIPTS}, {SENTIMENT}, m AS (SELECT call_id, (CASE WHEN contains(text, ' the ') THEN -1 ELSE 1 END) / (1 + length(text))::DOUBLE AS model_score FROM transcripts) --final
SELECT call_id, model_score, compound * 0.4::DOUBLE + polarity * 0.35::DOUBLE + model_score * 0.25::DOUBLE AS sentiment_score FROM senti JOIN m USING (call_id)""")
def _(spark, sf):
    scored = senti.model_scores(tables.transcripts(spark, sf), _toy_model)
    return senti.ensemble_sentiment(scored, PROBE_V31, model_col="model_score")


def pattern_values(patterns) -> str:
    return "(VALUES " + ", ".join(f"({n}, {sp.lit(p)})" for n, p in pattern_phrases(patterns)) + ") AS pt(n, phrase)"


GRAMS3 = """ahead AS (SELECT call_id, pos, tok, lead(tok, 1) OVER w AS t2, lead(tok, 2) OVER w AS t3 FROM tok
  WINDOW w AS (PARTITION BY call_id ORDER BY pos)),
gram AS (SELECT call_id, pos, 1 AS n, tok AS phrase FROM ahead
  UNION ALL SELECT call_id, pos, 2, tok || ' ' || t2 FROM ahead WHERE t2 IS NOT NULL
  UNION ALL SELECT call_id, pos, 3, tok || ' ' || t2 || ' ' || t3 FROM ahead WHERE t3 IS NOT NULL)"""


def _moments(name, profile):
    k = profile.context_window
    sql = f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')},
word AS (SELECT call_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT call_id, {sp.words('text')} AS w FROM transcripts) AS x),
size AS (SELECT call_id, count(*) AS total FROM tok GROUP BY call_id),
{GRAMS3},
hit AS (SELECT g.call_id, g.pos, g.n FROM gram AS g JOIN {pattern_values(profile.interest_patterns)} ON pt.n = g.n AND pt.phrase = g.phrase),
near AS (SELECT h.call_id, h.pos, h.n, md5(string_agg(w.word, ' ' ORDER BY w.pos)) AS context_md5,
  string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE w.pos BETWEEN h.pos AND h.pos + h.n - 1) AS phrase, avg({POLARITY_CASE}) AS p
  FROM hit AS h JOIN word AS w ON w.call_id = h.call_id AND w.pos BETWEEN h.pos - {k} AND h.pos + h.n + {k} - 1
  JOIN tok AS t ON t.call_id = w.call_id AND t.pos = w.pos GROUP BY h.call_id, h.pos, h.n) --final
SELECT call_id, pos AS start, phrase, context_md5, pos / total::DOUBLE * 300 AS t,
  least(1, greatest(0, (coalesce(p, 0) + 1) / 2)) AS intensity FROM near JOIN size USING (call_id)"""

    @query(name, "call_id:long start:long phrase:str context_md5:str t:d6 intensity:d6", sql)
    def _(spark, sf):
        found = moments.interest_moments(tables.transcripts(spark, sf), profile)
        return found.withColumn("context_md5", F.md5("context"))


_moments("interest_moments_v31", PROBE_V31)
_moments("interest_moments_v30", PROBE_V30)


@query("objections", "call_id:long idx:long sentence_md5:str", f"""WITH {sp.TRANSCRIPTS}, {sp.sent_rows('transcripts')},
{sp.tok_rows("(SELECT call_id * 100000 + idx AS call_id, sent AS text FROM sent) AS q", 'call_id')},
{GRAMS3},
hit AS (SELECT g.call_id // 100000 AS call_id, g.call_id % 100000 AS idx, g.pos, g.n FROM gram AS g
  JOIN {pattern_values(PROBE_V31.objection_patterns)} ON pt.n = g.n AND pt.phrase = g.phrase) --final
SELECT h.call_id, row_number() OVER (PARTITION BY h.call_id ORDER BY h.idx, h.pos, h.n) - 1 AS idx, md5(s.sent) AS sentence_md5
FROM hit AS h JOIN sent AS s ON s.call_id = h.call_id AND s.idx = h.idx""")
def _(spark, sf):
    return moments.objections(tables.transcripts(spark, sf), PROBE_V31).withColumn("sentence_md5", F.md5("sentence"))


@query("pattern_matches", "call_id:long phrase:str matches:long first_pos:long",
       f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')}, {GRAMS3} --final
SELECT g.call_id, g.phrase, count(*) AS matches, min(g.pos) AS first_pos FROM gram AS g
JOIN {pattern_values(PROBE_V31.interest_patterns)} ON pt.n = g.n AND pt.phrase = g.phrase GROUP BY g.call_id, g.phrase""")
def _(spark, sf):
    table = extraction.pattern_table(spark, PROBE_V31.interest_patterns)
    found = extraction.pattern_matches(tables.transcripts(spark, sf), table)
    return found.groupBy("call_id", "phrase").agg(F.count(F.lit(1)).alias("matches"), F.min("pos").alias("first_pos"))


SCAN_SQL = "|".join(
    [extract.EMAIL, extract.URL, extract.MONEY, extract.PERCENT, extract.WORDLIKE, extract.NUMBER]
).replace("'", "''")
EMAIL_SQL = extract.EMAIL.replace("'", "''")
PIECES = f"""piece2 AS (SELECT call_id, unnest(p) AS e, unnest(range(len(p))) AS i FROM
  (SELECT call_id, regexp_extract_all(text, '{SCAN_SQL}') AS p FROM transcripts) AS x),
ent AS (SELECT call_id, i, e, label, row_number() OVER (PARTITION BY call_id ORDER BY i) - 1 AS pos FROM
  (SELECT *, CASE WHEN e[1] IN ('$', '€', '£') THEN 'MONEY' WHEN ends_with(e, '%') AND regexp_matches(e[1], '\\p{{N}}') THEN 'PERCENT'
     WHEN regexp_full_match(e, '{EMAIL_SQL}') THEN 'EMAIL' WHEN starts_with(e, 'http://') OR starts_with(e, 'https://') OR starts_with(e, 'www.') THEN 'URL'
     WHEN regexp_full_match(e, '\\p{{N}}[\\p{{N}}.,]*') THEN 'CARDINAL' END AS label FROM piece2) AS y WHERE label IS NOT NULL)"""


@query("entities", "call_id:long pos:long label:str entity:str",
       f"WITH {sp.TRANSCRIPTS}, {PIECES} --final\nSELECT call_id, pos, label, e AS entity FROM ent")
def _(spark, sf):
    return extraction.entity_rows(tables.transcripts(spark, sf))


@query("page_entities", "call_id:long label:str mentions:long entities_md5:str",
       f"""WITH transcripts AS (SELECT page_id AS call_id, html AS text FROM pages), {PIECES} --final
SELECT call_id, label, count(*) AS mentions, md5(string_agg(e, '|' ORDER BY e)) AS entities_md5 FROM ent WHERE label IN ('URL', 'EMAIL') GROUP BY call_id, label""")
def _(spark, sf):
    pages = tables.read_table(spark, sf, "pages").select(F.col("page_id").alias("call_id"), F.col("html").alias("text"))
    # links of one page, so the list is bounded by the page
    return extraction.entity_rows(pages).where(F.col("label").isin("URL", "EMAIL")).groupBy("call_id", "label").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.md5(F.array_join(F.sort_array(F.collect_list("entity")), "|")).alias("entities_md5"),
    )


def _technical(name, profile):
    links = " OR label IN ('URL', 'EMAIL')" if profile.technical_links else ""
    sql = f"""WITH {sp.TRANSCRIPTS}, {PIECES},
tech AS (SELECT DISTINCT p.call_id, p.e FROM piece2 AS p LEFT JOIN ent ON ent.call_id = p.call_id AND ent.i = p.i
  WHERE lower(p.e) IN {sp.in_list(profile.technical)} OR regexp_full_match(p.e, '\\p{{Lu}}{{3,}}'){links}) --final
SELECT t.call_id, coalesce(list(e ORDER BY e) FILTER (WHERE e IS NOT NULL), []) AS technical_terms
FROM transcripts AS t LEFT JOIN tech USING (call_id) GROUP BY t.call_id"""

    @query(name, "call_id:long technical_terms:list", sql)
    def _(spark, sf):
        return extraction.technical_terms(tables.transcripts(spark, sf), profile)


_technical("technical_terms_v31", PROBE_V31)
_technical("technical_terms_v30", PROBE_V30)


def _key_phrases(name, profile):
    blocked = " OR ".join(f"starts_with(phrase, {sp.lit(b)})" for b in profile.phrase_blocked_starts)
    sql = f"""WITH {sp.TRANSCRIPTS}, {sp.phrase_rows('transcripts', min_chars=profile.phrase_min_chars)}, {PIECES}, {sp.tok_rows('transcripts')},
{GRAMS3},
both_sources AS (SELECT call_id, pos AS place, phrase FROM phr WHERE NOT ({blocked})
  UNION ALL SELECT call_id, 10000000 + pos, lower(e) FROM ent WHERE label IN ('MONEY', 'PERCENT')
  UNION ALL SELECT call_id, 20000000 + pos * 10 + n, phrase FROM gram WHERE phrase IN {sp.in_list(ORGS)}),
firsts AS (SELECT call_id, phrase, min(place) AS place FROM both_sources GROUP BY call_id, phrase),
placed AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY place) - 1 AS pos FROM firsts) --final
SELECT call_id, pos, phrase FROM placed WHERE pos < 20"""

    @query(name, "call_id:long pos:long phrase:str", sql)
    def _(spark, sf):
        return extraction.key_phrases(tables.transcripts(spark, sf), profile, ORGS)


_key_phrases("key_phrases_v31", PROBE_V31)
_key_phrases("key_phrases_v30", PROBE_V30)


def _pricing(name, profile):
    limit = f" WHERE pos < {profile.max_pricing}" if profile.max_pricing is not None else ""
    sql = f"""WITH {sp.TRANSCRIPTS}, {sp.sent_rows('transcripts')}, {PIECES},
both_sources AS (SELECT call_id, pos AS place, e AS mention FROM ent WHERE label IN {sp.in_list(profile.pricing_labels)}
  UNION ALL SELECT call_id, 10000000 + idx, sent FROM sent WHERE {sp.any_like('lower(sent)', profile.price)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY place) - 1 AS pos FROM both_sources) --final
SELECT call_id, pos, md5(mention) AS mention_md5 FROM placed{limit}"""

    @query(name, "call_id:long pos:long mention_md5:str", sql)
    def _(spark, sf):
        return extraction.pricing_mentions(tables.transcripts(spark, sf), profile).withColumn("mention_md5", F.md5("mention"))


_pricing("pricing_mentions_v31", PROBE_V31)
_pricing("pricing_mentions_v30", PROBE_V30)


@query("topic_rows", "call_id:long name:str relevance:d6 discussion_share:d6 topic_sentiment:d6",
       f"""WITH {sp.TRANSCRIPTS}, {sp.phrase_rows('transcripts')},
low AS (SELECT call_id, lower(text) AS text FROM transcripts), {sp.sent_rows('low')},
counted AS (SELECT call_id, phrase AS name, count(*) AS n FROM phr GROUP BY call_id, phrase),
placed AS (SELECT *, n / sum(n) OVER (PARTITION BY call_id) AS relevance, row_number() OVER (PARTITION BY call_id ORDER BY n DESC, name) AS r FROM counted),
{sp.tok_rows("(SELECT call_id, idx, sent AS text FROM sent) AS q", 'call_id, idx')},
pol AS (SELECT call_id, idx, coalesce(avg({POLARITY_CASE}), 0) AS p FROM tok GROUP BY call_id, idx),
total AS (SELECT call_id, count(*) AS k FROM sent GROUP BY call_id) --final
SELECT t.call_id, t.name, t.relevance, count(s.idx) / max(k)::DOUBLE AS discussion_share, coalesce(avg(CASE WHEN s.idx IS NOT NULL THEN coalesce(p, 0) END), 0) AS topic_sentiment
FROM placed AS t JOIN total USING (call_id) LEFT JOIN sent AS s ON s.call_id = t.call_id AND contains(s.sent, t.name)
LEFT JOIN pol ON pol.call_id = s.call_id AND pol.idx = s.idx WHERE r <= 15 GROUP BY t.call_id, t.name, t.relevance""")
def _(spark, sf):
    return topics.topic_rows(tables.transcripts(spark, sf), PROBE_V31)


SEARCH_SQL = f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')},
tf AS (SELECT call_id, tok, count(*) AS n FROM tok WHERE tok IN ('tion', 'heed', 'ing') GROUP BY call_id, tok),
idf AS (SELECT tok, ln((1 + (SELECT count(*) FROM transcripts)) / (1 + count(*))::DOUBLE) + 1 AS w FROM tf GROUP BY tok),
scored AS (SELECT call_id, sum(n * w) AS score, count(*) AS k FROM tf JOIN idf USING (tok) GROUP BY call_id) --final
SELECT call_id, score FROM scored WHERE k = 3 ORDER BY round(score, 9) DESC, call_id LIMIT 50"""


@query("fulltext_search", "call_id:long score:d6", SEARCH_SQL)
def _(spark, sf):
    return topics.fulltext_search(
        tables.transcripts(spark, sf), "tion of the heed ing", 50, PROBE_V31.stop_words
    )


def indexed(spark, sf):
    """The transcripts in an index, in two arrivals of which the second repeats calls."""
    folder = scratch_dir(spark, "index")
    calls = tables.transcripts(spark, sf)
    index.add_segment(calls.where("call_id % 3 = 0"), folder, 0, block_calls=32)
    index.add_segment(calls.where("call_id % 3 > 0 OR call_id % 5 = 0"), folder, 1, block_calls=32)
    return folder


@query("indexed_search", "call_id:long score:d6", SEARCH_SQL)
def _(spark, sf):
    return index.search(spark, indexed(spark, sf), "tion of the heed ing", 50, PROBE_V31.stop_words, first_blocks=4)


@query("phrase_search", "call_id:long n:long first:long", f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')}, {GRAMS3} --final
SELECT call_id, count(*) AS n, min(pos) AS first FROM gram WHERE phrase = 'de la' GROUP BY call_id""")
def _(spark, sf):
    found = index.phrase_search(spark, indexed(spark, sf), "De la")
    return found.select("call_id", F.size("places").alias("n"), F.get("places", F.lit(0)).alias("first"))


GRAMS_SQL = r"""list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query("trigram_similarity", "p_partkey:long similarity:d6", f"""WITH g AS (SELECT p_partkey, {GRAMS_SQL.format('p_name')} AS a, {GRAMS_SQL.format('p_type')} AS b FROM part) --final
SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS similarity FROM g""")
def _(spark, sf):
    parts = tables.read_table(spark, sf, "part")
    return parts.select("p_partkey", trigram_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


SIMILAR_SQL = """set_of AS (SELECT side, min(key) AS key, {grams} AS g FROM named WHERE text IS NOT NULL GROUP BY side, text),
pair AS (SELECT x.key AS a, y.key AS b, len(list_intersect(x.g, y.g)) AS shared, len(x.g) + len(y.g) AS total
  FROM set_of AS x JOIN set_of AS y ON {on} WHERE len(x.g) > 0 AND len(y.g) > 0)"""


@query("similar_turns", "a:long b:long similarity:d6",
       f"""WITH {sp.TURNS}, named AS (SELECT 0 AS side, call_id * 10000 + turn AS key, text FROM turns),
{SIMILAR_SQL.format(grams=GRAMS_SQL.format('text'), on='x.key < y.key')} --final
SELECT a, b, shared / (total - shared)::DOUBLE AS similarity FROM pair WHERE shared / (total - shared)::DOUBLE >= 0.4""")
def _(spark, sf):
    turns = tables.turns(spark, sf).withColumn("key", F.col("call_id") * 10000 + F.col("turn"))
    return similarity.similar_pairs(turns, "key", "text", 0.4)


@query("similar_names", "a:long b:long similarity:d6",
       f"""WITH named AS (SELECT 0 AS side, p_partkey AS key, p_name AS text FROM part
  UNION ALL SELECT 1, p_partkey, p_type || ' ' || split_part(p_name, ' ', 2) FROM part),
{SIMILAR_SQL.format(grams=GRAMS_SQL.format('text'), on='x.side = 0 AND y.side = 1')} --final
SELECT a, b, shared / (total - shared)::DOUBLE AS similarity FROM pair WHERE shared / (total - shared)::DOUBLE >= 0.5""")
def _(spark, sf):
    part = tables.read_table(spark, sf, "part")
    kinds = part.withColumn("kind", F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2))))
    return similarity.similarity_join(part, kinds, "p_partkey", "p_name", "p_partkey", "kind", 0.5)


@query("similar_transcripts", "call_id:long text_key:long links:long",
       f"""WITH named AS (SELECT 0 AS side, doc_id AS key, text FROM documents),
{SIMILAR_SQL.format(grams=GRAMS_SQL.format('text'), on='x.key < y.key AND least(len(x.g), len(y.g)) >= 0.9 * greatest(len(x.g), len(y.g))')},
near AS (SELECT a, b FROM pair WHERE shared / (total - shared)::DOUBLE >= 0.9),
linked AS (SELECT key, count(*) AS links FROM (SELECT a AS key FROM near UNION ALL SELECT b FROM near) GROUP BY key) --final
SELECT doc_id AS call_id, r.key AS text_key, coalesce(links, 0) AS links
FROM documents AS d JOIN (SELECT text, min(doc_id) AS key FROM documents GROUP BY text) AS r ON r.text = d.text LEFT JOIN linked AS l ON l.key = r.key""")
def _(spark, sf):
    calls = tables.transcripts(spark, sf)
    return similarity.with_similar(calls, "call_id", "text", 0.9).withColumnRenamed("key", "call_id")


def _analysis(name, profile):
    sql = f"""WITH {sp.TRANSCRIPTS},
tidy AS (SELECT call_id, path, file_name, {clean_sql(SOME_TEXT_SQL, profile)} AS text FROM transcripts), {sp.sent_rows('tidy')},
flow AS (SELECT call_id, count(*) AS total_sentences, avg({N_WORDS}) AS asl, count(*) FILTER (WHERE ends_with(sent, '!')) AS ex FROM sent GROUP BY call_id),
scored AS (SELECT *, coalesce(len({sp.words('text')}), 0) AS word_count, {score_sql(profile, 'lower(text)', f"len({sp.words('text')})")} AS lead_score FROM tidy) --final
SELECT s.call_id, file_name, substr(md5(path), 1, 8) AS processing_id, word_count, word_count / 150::DOUBLE AS duration_minutes,
  CASE WHEN text IS NULL THEN 50 ELSE lead_score END AS lead_score, CASE WHEN text IS NULL THEN 'Warm' ELSE {class_sql(profile, 'lead_score')} END AS lead_class, coalesce(total_sentences, 0) AS total_sentences, asl AS average_sentence_length, coalesce(ex, 0) AS exclamation_count,
  {sp.hit_list('lower(text)', profile.concern, profile.prefixes[2])} AS concerns
FROM scored AS s LEFT JOIN flow USING (call_id)"""

    @query(name,
           "call_id:long file_name:str processing_id:str word_count:long duration_minutes:d6 lead_score:d6 lead_class:str "
           "total_sentences:long average_sentence_length:d6 exclamation_count:long concerns:list", sql)
    def _(spark, sf):
        return analyze_calls(some_text(tables.transcripts(spark, sf)), profile, ORGS).select(
            "call_id", "file_name", "processing_id", "word_count", "duration_minutes",
            F.col("lead.score").alias("lead_score"), F.col("lead.class").alias("lead_class"),
            "flow.total_sentences", "flow.average_sentence_length", "flow.exclamation_count",
            F.col("lead.concerns").alias("concerns"),
        )


_analysis("analyze_calls_v31", PROBE_V31)
_analysis("analyze_calls_v30", PROBE_V30)
