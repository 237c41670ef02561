"""Operators 3 and 8 against brute force."""

import hashlib
import random
import re

import pytest

from keystrata.llm import decontam, jaccard
from keystrata.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) or rows[i][0] == rows[j][0]:
                a, b = sorted((root(i), root(j)), key=lambda k: (rows[k][0], k))
                parent[b] = a
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    return sorted((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


def family(rng, size, copies, edits):
    """A text and copies of it with more and more words changed, so that some link and some don't."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
    out = []
    for c in range(copies):
        text = list(base)
        for _ in range(c * edits % (size // 4 + 1)):
            text[rng.randrange(size)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(text))
    return out


def test_components_equal_brute_force(spark, docs, texts, passage):
    rng = random.Random(12)
    many = [*texts]
    for size, copies, edits in ((40, 12, 1), (200, 15, 1), (9, 8, 1), (400, 6, 5)):
        many += family(rng, size, copies, edits)
    many += [passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(k)) for k in (3, 5, 8, 30, 60, 200)]
    many += [many[25]] * 9
    rows = list(enumerate(many))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n bigint, token string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.jaccard_components(frame).collect()) == brute_components(rows)


def test_pairs_that_share_much_are_not_made_for_each_shingle(spark, monkeypatch):
    """Near copies on either side of the limit, and texts around a long passage: few pairs are left to the last join."""
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    many = []
    for c in range(30):
        text = list(base)
        for at in rng.sample(range(400), 3 + c % 6):
            text[at] = f"e{rng.randint(0, 10**6)}"
        many.append(" ".join(text))
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(300))
    many += [passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(30 + 8 * k)) for k in range(8)]
    compared, keep = [], jaccard.materialize

    def watched(frame, name):
        kept = keep(frame, name)
        if name == "mixed":
            compared.append(kept.groupBy("token", "band").count().selectExpr("coalesce(sum(count * (count - 1) / 2), 0)").first()[0])
        return kept

    monkeypatch.setattr(jaccard, "materialize", watched)
    rows = list(enumerate(many))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.jaccard_components(frame).collect()) == brute_components(rows)
    pairs = len(many) * (len(many) - 1) / 2
    assert len(compared) == 1 and compared[0] <= 10 * pairs, compared  # a set is in up to 80 tiles and as many of the next band


def test_links_equal_brute_force(spark, texts):
    rng = random.Random(14)
    many = [*texts]
    for size, copies, edits in ((40, 12, 1), (400, 15, 1), (9, 8, 1)):
        many += family(rng, size, copies, edits)
    many += [many[25]] * 4
    rows = [*enumerate(many), (None, many[25]), (None, many[40]), (7, many[41]), (7, many[41]), (None, None)]
    sets = [shingle_set(t) for _, t in rows]
    links = [sum(i != j and bool(x & y) and 100 * len(x & y) >= 80 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard.jaccard_links(frame).collect()), key=repr)
    assert got == sorted(((i, len(x), n) for (i, _), x, n in zip(rows, sets, links, strict=True)), key=repr) and max(links) > 8


def test_components_of_rows_that_share_an_id(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (9, None), (9, None), (7, "")]
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 0, 7), (9, 0, 9), (9, 0, 9)]


def test_components_of_rows_without_an_id(spark):
    rows = [(5, "a b c d e f"), (None, "a b c d e f"), (None, "other words"), (None, None), (8, "g h i j k l")]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (None, 2, 5), (None, 1, None), (None, 0, None), (8, 2, 8)], key=repr)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|NumberFormat"):
        jaccard.jaccard_components(spark.createDataFrame([("x1", "a b")], "doc_id string, text string")).collect()


def test_components_of_nothing(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_connected_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and all(got[i] == 200 for i in (200, 201, 202))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture
def items(spark, passage):
    rows = [(1, passage), (2, "two WORDS"), (3, None), (4, "..."), (5, "a a a a a a a a a a a"), (10, " ".join(passage.split()[20:35])), (10, " ".join(passage.split()[20:35])), (11, "Crème brûlée 中文字符")]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id bigint, text string, n string"), rows


def test_hits_equal_brute_force(docs, texts, items, monkeypatch):
    frame, rows = items
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = brute_hits(list(enumerate(texts)), rows)
    assert sorted(tuple(r) for r in decontam.report(docs, frame).select(*columns).collect()) == expected
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)  # the benchmark in several blocks
    assert sorted(tuple(r) for r in decontam.report(docs, frame).select(*columns).collect()) == expected
    clean = decontam.remove_contaminated(docs, frame)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [e[0] for e in expected if not e[-1]]


def test_proximity_finds_what_is_near_but_not_in_order(spark):
    item = " ".join(f"term{i}" for i in range(10))
    turned = " ".join(f"term{i}" for i in reversed(range(10)))
    far = " ".join(f"term{i} " + "filler " * 60 for i in range(10))
    frame = spark.createDataFrame([(0, item), (1, turned), (2, far)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in decontam.report(frame, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got == {0: (1, 1), 1: (0, 1), 2: (0, 0)}


def test_items_without_an_id_hit(spark, monkeypatch):
    frame = spark.createDataFrame([(0, "some words of an item here"), (1, "clean text"), (2, "words of an item and other things")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "words of an item"), (5, "of an item and"), (None, None)], "item_id bigint, text string")
    for size in (decontam.BLOCK_BYTES, 8):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.report(frame, bench).collect()}
        assert got == {0: (4, 0, hashlib.sha256(b"").hexdigest(), True), 1: (0, 0, hashlib.sha256(b"").hexdigest(), False), 2: (5, 1, hashlib.sha256(b"5").hexdigest(), True)}
        assert [r["doc_id"] for r in decontam.remove_contaminated(frame, bench).collect()] == [1]


def test_no_documents_and_no_benchmark(docs, no_docs, items):
    frame, _ = items
    assert decontam.report(no_docs, frame).count() == 0
    assert decontam.report(docs, frame.limit(0)).where("contaminated").count() == 0
    assert decontam.remove_contaminated(docs, frame.limit(0)).count() == docs.count()
