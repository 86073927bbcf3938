"""SimHash groups, near lines and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from cases import TABLES

from calllens.llm import graph, line_dedup, queries, simhash


def root_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = root_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    out = []
    for (i, _), f, r in zip(rows, fps, roots):
        ids = [d for (d, _), q in zip(rows, roots) if q == r and d is not None]
        out.append((i, f if f < 1 << 63 else f - (1 << 64), min(ids) if ids else None))
    return sorted(out, key=str)


def test_groups_of_edge_cases(odd):
    rows = [(i, t) for i, t, _ in TABLES["rows"]]
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str) == groups(rows)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1, 3, 6, 7]


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_registered_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.QUERIES["op10_simhash"](spark, small).collect()]
    assert all(len(r.fingerprint) == 16 for r in queries.QUERIES["op10_simhash"](spark, small).limit(3).collect())
    assert sorted(((i, f if f < 1 << 63 else f - (1 << 64), c) for i, f, c in got), key=str) == groups(docs)


@pytest.mark.parametrize("range_size", [16, 100, 1 << 17])
def test_links_of_dense_groups(spark, range_size):
    rng = random.Random(range_size)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(12):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f if f < 1 << 63 else f - (1 << 64) for f in fps]
    place = {s: i for i, s in enumerate(signed)}
    edges = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), range_size=range_size).collect()
    got = root_of(len(fps), [(place[e.a], place[e.b]) for e in edges])
    want = root_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert got == want


def test_search_gives_every_pair_within_the_limits():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) & np.uint64(0x00FF00FF0F0F0303))
    fps = fps[np.argsort(simhash.gray_ranks(fps.view(np.int64)))]
    found = set()
    for q, item in simhash.GrayTree(fps, fps).search(fps, 3, 1):
        found.update(zip(q.tolist(), item.tolist()))
    want = {
        (i, j) for i in range(len(fps)) for j in range(len(fps))
        if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3 and ((int(fps[i]) ^ int(fps[j])) >> 32).bit_count() <= 1
    }
    assert found == want


def test_components_of_a_path_a_star_and_a_cycle(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def edited(text, rng, most):
    text = list(text)
    for _ in range(rng.randint(0, most)):
        i, how = rng.randint(0, len(text)), rng.random()
        if how < 0.33 or not text:
            text.insert(i, rng.choice("abz"))
        elif how < 0.66:
            text.pop(min(i, len(text) - 1))
        else:
            text[min(i, len(text) - 1)] = rng.choice("abz")
    return "".join(text)


def test_banded_distance():
    rng = random.Random(0)
    for _ in range(6000):
        k, n = rng.randint(0, 6), rng.choice([0, 1, 2, 3, 5, 8, 20, 70, 130])
        a = "".join(rng.choice("abc") for _ in range(n))
        b = edited(a, rng, 8)
        d = table_distance(a, b)
        assert line_dedup.edit_distance_within(a, b, k) == (d if d <= k else None)


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([5, 9, 10, 11, 19, 20, 21, 25, 40, 80]))) for _ in range(50)]
    rows = [
        (i, "\n".join(rng.choice(["", edited(rng.choice(base), rng, 3), rng.choice(base)]) for _ in range(rng.randint(0, 8))))
        for i in range(100)
    ]
    rows += [(200, None), (None, "a line without an id\n\n" + base[0]), (5, rows[5][1])]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


def test_near_lines_and_classes(lined):
    rows, df = lined
    strip = " \t\n\r\x0b\x0c"
    known = sorted({line.strip(strip) for _, t in rows if t for line in t.split("\n")} - {""})
    pairs = {}
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            k = line_dedup.edits_allowed(min(len(a), len(b)), 2, 10)
            if abs(len(a) - len(b)) <= k and (d := table_distance(a, b)) <= k:
                pairs[a, b] = d
    assert pairs and {(r.a, r.b): r.edits for r in line_dedup.near_lines(df).collect()} == pairs
    place = {line: i for i, line in enumerate(known)}
    roots = root_of(len(known), [(place[a], place[b]) for a, b in pairs])
    spots = [
        ((i is not None, i or 0), n, line.strip(strip)) for i, t in rows for n, line in enumerate((t or "").split("\n"))
    ]
    first = {}
    for who, n, line in spots:
        if line:
            r = roots[place[line]]
            first[r] = min(first.get(r, (who, n)), (who, n))
    links = {line: sum(line in p for p in pairs) for line in known}
    want = sorted(
        (who[1] if who[0] else -1, n, not line or first[roots[place[line]]] == (who, n), links.get(line)) for who, n, line in spots
    )
    got = line_dedup.line_classes(df).collect()
    assert sorted((-1 if r.id is None else r.id, r.line_no, r.kept, r.links) for r in got) == sorted(
        want, key=lambda w: (w[0], w[1], w[2], w[3] or 0)
    )
    kept = {(r.id, r.line_no) for r in got if r.kept}
    texts = {r.doc_id: r.text for r in line_dedup.without_repeats(df).collect()}
    for i, t in rows:
        want_text = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) in kept)
        assert texts[i] == want_text


def test_lines_of_edge_cases(odd, none):
    got = {r.id: tuple(r)[1:] for r in line_dedup.per_document(line_dedup.line_classes(odd)).collect()}
    assert got[3] == got[4] == (0, 0, 0) and got[7] == (3, 2, 0)
    assert line_dedup.line_classes(none).count() == 0
    assert line_dedup.without_repeats(odd).columns == odd.columns


def test_registered_query_names_the_line_that_a_line_repeats(spark, tmp_path):
    passage = "the same passage stands in several documents of the table"
    rows = [
        (7, f"{passage}\n\nand a line of document seven alone"),
        (3, f"first of three here\n{passage.replace('several', 'severel')}"),
        (9, f"{passage}\nnothing like the others is in here"),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op8_line_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "line_no", "class_id", "class_line", "links", "kept"]
    assert sorted(map(tuple, got.collect())) == [
        (3, 0, 3, 0, 0, True), (3, 1, 3, 1, 1, True),
        (7, 0, 3, 1, 1, False), (7, 1, None, None, None, True), (7, 2, 7, 2, 0, True),
        (9, 0, 3, 1, 1, False), (9, 1, 9, 1, 0, True),
    ]
