"""Decontamination, licenses, toxicity, languages and mixing."""

import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import TABLES
from pyspark.sql import functions as F

from calllens.llm import decontam, langid, licenses, mixing, queries, toxicity
from calllens.llm.words import alnum_words


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_words_on_bytes():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aZ9.,-_ \té 漢\x00\x7f[`{@/:") for _ in range(40))
        assert [w.decode() for w in alnum_words(text.encode())] == words(text)


# --- decontamination ---------------------------------------------------------------

ITEMS = [
    (10, "one two three four five six seven eight nine ten eleven twelve"),
    (9, "short item here"),
    (9, "short item here"),
    (8, None),
    (7, "..."),
    (None, "five six seven eight nine ten eleven twelve thirteen fourteen"),
]
TEXTS = [
    (1, "x One two three, four five six seven eight nine ten! eleven y"),
    (2, "one two three four five six seven eight nine"),
    (3, "five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (4, "a short ITEM here; short item, here. short item"),
    (5, None),
    (6, ""),
    (7, "short"),
    (8, "item here"),
    (None, "short item here"),
    (4, "a short ITEM here; short item, here. short item"),
    (11, "here short item and then the item is here but short"),
    (12, "filler " * 5000 + "one two three four five six seven eight nine ten " + "filler " * 5000),
]


def contaminated_by_hand(texts, items, window=10):
    grams = {}
    for item, text in items:
        own = words(text)
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            grams.setdefault(tuple(own[i : i + k]), set()).add(item)
    out = []
    for doc, text in texts:
        own, hit, found = words(text), set(), set()
        for gram, names in grams.items():
            for i in range(len(own) - len(gram) + 1):
                if own[i] == gram[0] and tuple(own[i : i + len(gram)]) == gram:
                    hit.update(range(i, i + len(gram)))
                    found |= names
        names = sorted(str(n) for n in found if n is not None)
        out.append((doc, len(own), len(hit), len(names), names))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_sent", [0, 100_000])
def test_contamination(spark, most_sent):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string").withColumn("segment", F.lit("x"))
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = decontam.contamination(docs, items, most_sent=most_sent).collect()
    assert sorted(map(tuple, got), key=str) == contaminated_by_hand(TEXTS, ITEMS)
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 5, 6, 7, 8, 11]


def test_contamination_of_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert decontam.contamination(none, items).count() == 0
    got = decontam.contamination(odd, items.limit(0)).collect()
    assert sorted((r.id or -1, r.n_words, r.n_hit) for r in got) == sorted((i or -1, len(words(t)), 0) for i, t, _ in TABLES["rows"])


def test_small_segments_give_the_same_matches(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string").coalesce(1)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    views = []
    for size in (1, 20, 1 << 21):
        index = decontam.build_index(docs, segment_words=size)
        found = decontam.matches(index, items, slop=None).collect()
        views.append(sorted((str(r.doc_id), str(r.item_id), r.first_word, r.end_word) for r in found))
    assert views[0] == views[1] == views[2] and views[0]


def test_proximity(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    items = spark.createDataFrame([(9, "short item here")], "item_id int, text string")
    found = decontam.matches(decontam.build_index(docs), items, slop=2).collect()
    near = {(r.doc_id, r.first_word, r.end_word) for r in found if r.kind == "near"}
    # any order within five words; overlapping spans are joined
    assert (11, 0, 3) in near and not any(d in (7, 8) for d, _, _ in near)
    spans = decontam.near_spans((b"a", b"b", b"a"), {b"a": np.array([0, 4, 9]), b"b": np.array([6, 20])}, {b"a": 3, b"b": 2}, 3)
    assert spans == [(4, 10)]


def test_varints():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 40, 1000) >> rng.integers(0, 40, 1000)
    data, ends = decontam.varint(values)
    assert decontam.unvarint(data.tobytes()).tolist() == values.tolist() and ends[-1] == len(data)
    assert decontam.unvarint(b"").tolist() == []


# --- licenses ----------------------------------------------------------------------

NOTES = [
    (1, "Released under the MIT License."),
    (2, "Relaesed under the MIT Licence"),
    (3, "Licensed under the Apache License, Version 2.0. Again: apache license version 2, and CC-BY-NC 4.0"),
    (4, "This work is licensed under the GNU Genral Public License, version 2"),
    (5, "This work is licensed under the GNU General Public License, version 3"),
    (6, "the mit licensed under something"),
    (7, None),
    (8, "cc by nc cc by nc"),
    (9, "All rights reserved."),
]


def test_licenses(spark):
    docs = spark.createDataFrame(NOTES, "doc_id int, text string").withColumn("spans", F.lit(1))
    got = {r.id: r for r in licenses.digest(licenses.scan(docs)).collect()}
    for i, text in NOTES:
        own, places = words(text), []
        for phrase, label in licenses.BASE_PHRASES:
            p = phrase.split()
            places += [(k, label) for k in range(len(own)) if own[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(own), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [got[i].labels for i in (1, 2, 4, 5, 6, 7, 9)] == ["mit", "mit", "gpl-2", "gpl-3", "", "", "all-rights-reserved"]
    assert got[3].labels == "apache-2,cc-by-nc" and got[1].score == 1 and 0.8 < got[2].score < 1 and got[7].score == 0


def test_seeds_find_what_the_regex_alone_finds():
    import regex

    rng, finder = random.Random(4), licenses.NoticeFinder((), licenses.NOTICES)
    for number, (notice, _) in enumerate(licenses.NOTICES):
        for _ in range(15):
            text = list(notice)
            for _ in range(rng.randint(0, finder.edits[number])):
                i, how = rng.randrange(len(text)), rng.random()
                if how < 0.4:
                    text[i] = rng.choice("abcxyz")
                elif how < 0.7:
                    text.pop(i)
                else:
                    text.insert(i, rng.choice("abcxyz"))
            data = f" lorem ipsum {''.join(text)} dolor sit "
            assert finder.patterns[number].search(data)
            inside = finder.windows(data).get(number, [])
            assert any(finder.patterns[number].search(data, a, b) for a, b in inside)
    assert regex.__name__ == "regex"


def plain_finds(text, finder):
    """(notice, edits) by place: every stretch within the limit by the table of edits, best first."""
    every = []
    for number, (notice, _) in enumerate(finder.notices):
        for a in range(len(text)):
            row = list(range(len(notice) + 1))
            for b in range(a, min(len(text), a + len(notice) + finder.edits[number])):
                above, row[0] = row[0], b - a + 1
                for j, c in enumerate(notice, 1):
                    above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (text[b] != c))
                if row[-1] <= finder.edits[number]:
                    every.append((row[-1] / len(notice), a - b - 1, number, a, b + 1, row[-1]))
    kept = []
    for _, _, number, a, b, edits in sorted(every):
        if all(b <= x or y <= a for x, y, _, _ in kept):
            kept.append((a, b, number, edits))
    return [k[2:] for k in sorted(kept)]


def test_adjacent_and_repeated_notices():
    names = ("released under the mit license", "all rights reserved", "licensed under cc by nc 4 0")
    gpl = "this work is licensed under the gnu general public license version "
    notices = [n for n in licenses.NOTICES if n[0] in names or n[0].startswith(gpl)]
    finder, rng = licenses.NoticeFinder((), notices), random.Random(6)
    which = {n: i for i, (n, _) in enumerate(notices)}
    two, three = which[gpl + "2"], which[gpl + "3"]
    wrong = (gpl + "2").replace("work", "wrk").replace("general", "genral")
    assert [f[2:] for f in finder.fuzzy(f" {wrong} {gpl}3 ")] == [(two, 2), (three, 0)]
    mit = which[names[0]]
    assert [f[2:] for f in finder.fuzzy(f" relased under the mit license {names[0]} ")] == [(mit, 1), (mit, 0)]
    for _ in range(8):
        parts = []
        for name in rng.choices(names, k=3):
            i = rng.randrange(5, len(name) - 5)
            parts.append(rng.choice([name, name[:i] + "q" + name[i + 1 :], name[:i] + "q" + name[i:]]))
        text = f" {' '.join(parts)} "
        assert [f[2:] for f in finder.fuzzy(text)] == plain_finds(text, finder)


def test_a_megabyte_of_notices_takes_seconds():
    """Work grows with the length, however many finds a text has and whatever their order."""
    finder = licenses.NoticeFinder(licenses.BASE_PHRASES, licenses.NOTICES)
    wrong = "permision is hereby granted free of charge to any person obtainin a copy"
    for parts, finds in (([wrong], 1), ([wrong, "released under the mit license"], 3)):
        n = 1_000_000 // sum(len(p) + 1 for p in parts)
        began = time.monotonic()
        words, spans = finder.search((" ".join(parts * n)).encode())
        assert time.monotonic() - began < 60 and len(spans) == finds * n
        size = sum(len(p.split()) for p in parts)
        assert words == n * size and max(s[3] for s in spans) == words - 1
        assert sorted({s[2] % size for s in spans if s[0] == "fuzzy"}) == [0, len(wrong.split())][: len(parts)]


def test_license_edge_cases(odd, none):
    assert licenses.scan(none).count() == 0
    assert {(r.id, r.n_base, r.labels) for r in licenses.digest(licenses.scan(odd)).collect()} == {
        (i, 0, "") for i, _, _ in TABLES["rows"]
    }


# --- toxicity ----------------------------------------------------------------------


def toxic_corpus(spark, n=1500):
    rng = random.Random(8)
    plain = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        bad = i % 8 == 0
        if bad:
            for _ in range(1 + len(text) // 40):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "1d10t", "іdiоt", "scum!", "$cum", "stupid", "loathers", "loathing"]))
        elif i % 8 == 1:
            text[5:5] = ["clown", "fish"]
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_spared_words_by_hand():
    """Exceptions that touch, overlap or repeat against a test of each place and stretch."""
    rng = random.Random(4)
    lexicon = toxicity.Lexicon({" trash ": 2.0, " can": 1.0, " fish ": 3.0}, ("trash can", "can fish", "fish", "trash can fish trash"))
    machine = lexicon.automaton()
    for _ in range(300):
        words = rng.choices(["trash", "can", "fish", "canned", "other"], k=rng.randint(0, 9))
        text, want = f" {' '.join(words)} ", {}
        spared = [(i, i + len(p) + 1) for p in lexicon.exceptions for i in range(len(text)) if text.startswith(f" {p} ", i)]
        for at in range(len(text)):
            best = max((w for t, w in lexicon.weights.items() if text.startswith(t, at)), default=0)
            if best and words and not any(a <= at < b for a, b in spared):
                want[at] = best
        assert toxicity.hits(machine, words) == want, words


def test_a_megabyte_of_exceptions_takes_seconds():
    lexicon = toxicity.Lexicon({" trash ": 2.0}, toxicity.HARMLESS)
    words = ["trash", "can", "trash", "bin", "trash", "heap"] * 40_000
    began = time.monotonic()
    found = toxicity.hits(lexicon.automaton(), words)
    assert time.monotonic() - began < 30 and len(found) == 40_000


def test_toxicity_learns_folds_and_spares(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    held = [r for r in got if zlib.crc32(str(r.id).encode()) % 5 == 0]
    assert len(held) > 200 and all((r.score >= 0.5) == bool(r.toxic) for r in held)
    # the same text scores alike whatever its id
    again = toxicity.score(docs.withColumn("doc_id", F.col("doc_id") + 10**6), model).collect()
    assert {r.id - 10**6: r.score for r in again} == {r.id: r.score for r in got}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.id for r in got if r.score < 0.5}


def test_folding():
    assert toxicity.folded("1D10T, іԁiоt! $tup1d id​iot 455 2024 mp3") == ["idiot", "idiot", "stupid", "idiot", "mpe"]
    assert toxicity.folded("ex-loser's!") == ["ex", "ioser", "s"]
    assert toxicity.folded("") == toxicity.folded("!!! 12") == []


def test_exceptions_cover_their_words():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " idi": 3.0, " idiot ": 1.0}, ("trash can",))
    machine = lexicon.automaton()
    assert toxicity.hits(machine, "the trash can is trash".split()) == {17: 2.0}
    assert toxicity.hits(machine, ["idiot"]) == {0: 3.0}
    assert toxicity.hits(toxicity.Lexicon().automaton(), ["idiot"]) == {}


def test_toxicity_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, 1), (3, None), (1, 1)], "doc_id bigint, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.train(odd, some)
        got = toxicity.score(odd, model).collect()
        assert len(got) == len(TABLES["rows"]) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.without_toxic(odd, some).columns == odd.columns
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.without_toxic(none, labels).count() == 0


def test_registered_toxicity(spark, small):
    got = queries.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


# --- languages ---------------------------------------------------------------------


def counted(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram.strip() and not (n == 3 and gram[1] == " ") and (n > 1 or gram != " "):
                    out[gram] += 1
    return out


def test_ngrams(monkeypatch):
    texts = ["", "a", "Ab c", "Straße — ñandú 12 x_y", "日本 text", "many words " * 50]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        for text in texts:
            keys, counts = langid.ngram_counts(text)
            want = {sum(ord(c) << 21 * k for k, c in enumerate(g)): n for g, n in counted(text).items()}
            assert dict(zip(keys.tolist(), counts.tolist())) == want


def test_out_of_place_distance():
    profiles = langid.LanguageProfiles(["aa", "bb"], np.array([1, 2, 3]), np.array([[0, 2], [1, 3], [3, 0]]), 3)
    # ranks 0, 1, 2 of the document against 0, 1, - and 2, -, 0
    assert profiles.distances(np.array([1, 2, 3])).tolist() == [3 / 9, (2 + 3 + 2) / 9]
    assert all(profiles.predict(t) == ("und", 0.0) for t in (None, "", "12 !", "² ⅷ _"))
    assert profiles.predict("\u0300a")[0] in ("aa", "bb")


def test_registered_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op9_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs)
    held = [r for r in docs if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(odd, none):
    tagged = odd.withColumn("lang", F.when(F.col("doc_id") > 5, F.lit("xx")))
    for docs in (tagged, odd.withColumn("lang", F.lit(None).cast("string"))):
        got = {r.id: r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()}
        assert [got[i] for i in (3, 4, 5)] == ["und"] * 3
    assert langid.identify(none, langid.train(none.withColumn("lang", F.lit("x")))).count() == 0


# --- mixing ------------------------------------------------------------------------


def targets_by_hand(size_of, weights=(5, 2, 1), cap=3):
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total = sum(size_of.values())
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        share = (total - sum(capped.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if share * weight[s] > cap * size_of[s]]
        if not over:
            return capped | {s: share * weight[s] for s in free}
        capped |= {s: cap * size_of[s] for s in over}


def check_mix(rows, slots, texts, depth=4):
    size_of = Counter()
    for source, text in texts:
        size_of[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken, block_copies = targets_by_hand(size_of), Counter(), Counter((s.number, s.block) for s in slots)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.source_size == size_of[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r["size"] * block_copies[r.number, r.block] and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len({(s.number, s.block, s.copy) for s in slots}) == len(slots)
    per_shard = Counter(s.shard for s in slots)
    if slots:
        assert max(per_shard.values()) - min(per_shard.get(i, 0) for i in range(2**depth)) <= depth
    return taken, want


def test_mix_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, slots = mixing.mix(docs)
    rows, slots = rows.collect(), slots.collect()
    taken, want = check_mix(rows, slots, [(r.source, r.text) for r in docs.collect()])
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in want.items())
    again, _ = mixing.mix(docs.repartition(7))
    assert sorted((r.id, r.taken) for r in again.collect()) == sorted((r.id, r.taken) for r in rows)
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    want = Counter({r.id: r.taken // r["size"] for r in rows if r.taken})
    assert Counter(r.doc_id for r in mixed.collect()) == want
    # more tasks, of about as many words each, when pieces are smaller
    small = mixing.mixture(docs, piece_words=2000)
    assert Counter(r.doc_id for r in small.collect()) == want
    assert small.rdd.getNumPartitions() > 4 * mixed.rdd.getNumPartitions()


def test_mix_edge_cases(odd, none):
    rows, slots = mixing.mix(odd)
    check_mix(rows.collect(), slots.collect(), [(s, t) for _, t, s in TABLES["rows"]])
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns and mixed.where("doc_id IN (3, 4, 5)").isEmpty()
    assert mixing.mix(none)[0].count() == mixing.mix(none)[1].count() == mixing.mixture(none).count() == 0
    blank = odd.where("doc_id IN (3, 4, 5)")
    assert [r.taken for r in mixing.mix(blank)[0].collect()] == [0, 0, 0] and mixing.mixture(blank).count() == 0


def test_hypergeometric_law(spark):
    population, marked, drawn, n = 60, 20, 25, 20_000
    got = spark.range(n).select(
        mixing.hypergeometric(F.lit(population), F.lit(marked), F.lit(drawn), mixing.uniform(F.lit(1), "id")).alias("x")
    )
    counts = {r.x: r["count"] for r in got.groupBy("x").count().collect()}
    from math import comb, sqrt

    for x in range(0, 21):
        p = comb(marked, x) * comb(population - marked, drawn - x) / comb(population, drawn)
        assert abs(counts.get(x, 0) - n * p) <= 5 * sqrt(n * p * (1 - p)) + 1
    edges = [(0, 0, 0, 0), (5, 0, 3, 0), (5, 5, 3, 3), (5, 2, 0, 0), (5, 2, 5, 2), (1, 1, 1, 1)]
    for population, marked, drawn, want in edges:
        row = spark.range(1).select(mixing.hypergeometric(F.lit(population), F.lit(marked), F.lit(drawn), F.lit(0.7)).alias("x"))
        assert row.first().x == want


def test_tree_keeps_quotas_exact(spark):
    slots = spark.createDataFrame([(0, 1000), (1, 7), (2, 333)], "number int, n bigint")
    upto = {r.number: list(r.upto) for r in mixing.split_tree(slots, 3, 1).collect()}
    assert [upto[i][-1] for i in (0, 1, 2)] == [1000, 7, 333]
    sizes = [sum(u[i] - (u[i - 1] if i else 0) for u in upto.values()) for i in range(8)]
    assert sum(sizes) == 1340 and max(sizes) - min(sizes) <= 3
    assert all(a <= b for u in upto.values() for a, b in zip(u, u[1:]))


def test_mixing_runs_no_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows, slots = mixing.mix(docs)
    for df in (rows, slots, mixing.mixture(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_registered_mix_follows_the_dealt_slots(spark, small):
    got = queries.QUERIES["op7_mixing"](spark, small).collect()
    rows, slots = mixing.mix(spark.read.parquet(f"{small}/documents.parquet"))
    dealt = {}
    for s in slots.collect():
        dealt.setdefault((s.number, s.block), []).append(s.shard)
    want = {r.id: sorted(dealt.get((r.number, r.block), [])) if r["size"] else [] for r in rows.collect()}
    assert {r.doc_id: list(r.shards) for r in got} == want and len({x for w in want.values() for x in w}) == 16
    assert all(r.taken == r["size"] * len(r.shards) for r in got)


def test_thousands_of_small_sources_come_near_their_targets(spark):
    n, each = 9000, 12
    docs = spark.range(n * each).selectExpr(
        "id AS doc_id", f"concat('s', id % {n}) AS source", "repeat('w ', 40 + cast(pmod(hash(id), 20) AS int)) AS text"
    )
    rows = mixing.sizes(docs, "doc_id", "text", "source", 7)
    placed = mixing.with_blocks(rows, mixing.source_targets(rows), 8192)
    plan = mixing.block_copies(placed, 3.0, 7).collect()
    taken = Counter()
    for r in plan:
        taken[r.number] += r.words * r.copies
    want = {r.number: r.target for r in mixing.source_targets(rows).collect()}
    assert len(want) == n and len(plan) == n * each and max(r.copies for r in plan) <= 3
    assert all(abs(taken[s] - t) <= 60 for s, t in want.items())
    assert abs(sum(taken.values()) - sum(want.values())) <= 0.01 * sum(want.values())
