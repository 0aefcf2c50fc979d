"""Each operator on odd rows and against brute force."""

import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import ann, decontam, jaccard, langid, linededup, packing, quality, queries, substring, suffixlm, urlfilter
from kindred.llm.mail import mail_table
from kindred.llm.mail import read as mail_read
from kindred.llm.text import Words

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row int, block int, bit long"


def table(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, None, "s", None, 0.5, 1, 2, 3) for i, t in rows], SCHEMA)


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n "), (None, "some words of a row without an id"), (4, "word"), (5, "Ab cd. Ef!\n\nAb cd. Ef!"), (6, prose(1, 4000)), (6, prose(1, 4000)), (7, prose(1, 4000)), (8, "é ü\x00 \U0001f600 " * 50), (9, "!!! ??")]


def run_all(docs, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (None, "word")], "item_id long, text string")
    yield jaccard.similarity_classes(docs)
    yield substring.repeated_passages(docs)
    yield langid.predict_languages(docs, langid.fit_languages(docs))
    yield suffixlm.score_texts(docs)
    yield packing.pack_documents(docs, queries.tokenizer_path())
    yield decontam.benchmark_overlap(docs, benchmark)
    yield quality.score_quality(docs, quality.fit_quality(docs, labels))
    yield linededup.line_report(docs)


def test_odd_rows_and_empty_tables(spark):
    docs = table(spark, ODD)
    sizes = [len(df.collect()) for df in run_all(docs, spark)]
    assert [sizes[i] for i in (0, 2, 3, 5, 6, 7)] == [len(ODD)] * 6
    for df in run_all(docs.limit(0), spark):
        assert df.count() == 0


# 1


def shingles(text):
    w = alnum(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edited(words, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"new{rng.randint(0, 10**6)}" for w in words)


def test_jaccard_join_equals_brute_force(spark):
    base = [prose(s, 120).split() for s in range(6)]
    rows = [(100 * s + k, edited(b, [0, 0, 0.01, 0.02, 0.03, 0.05, 0.3][k], 10 * s + k)) for s, b in enumerate(base) for k in range(7)]
    rows += [(900, "a b"), (901, "A  b!"), (902, "a c"), (903, None), (None, prose(0, 120))]
    found = {r["doc_id"]: r for r in jaccard.similarity_classes(table(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    distinct = {s for s in sets.values() if s}
    links = {s: {o for o in distinct if o != s and len(s & o) >= 0.8 * len(s | o)} for s in distinct}
    for i, s in sets.items():
        if not s:
            assert tuple(found[i])[1:] == (i, 1, 0)
            continue
        reach, todo = {s}, [s]
        while todo:
            for o in links[todo.pop()] - reach:
                reach.add(o)
                todo.append(o)
        assert found[i]["n_links"] == len(links[s]) and found[i]["n_copies"] == sum(x == s for x in sets.values())
        assert found[i]["class_id"] == min(j for j, x in sets.items() if x in reach and j is not None)
    assert found[None]["class_id"] == 0


def test_one_row_of_each_class_stays(spark):
    text, other, third = prose(1, 120), prose(2, 120), prose(3, 120)
    near = text.replace(text.split()[60], "new", 1)
    rows = [(5, text), (5, other), (9, near), (None, text), (None, third), (None, third), (8, other), (7, None), (7, None), ((1 << 63) - 1, third)]
    left = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in jaccard.keep_one(table(spark, rows)).collect()))
    assert left == sorted([(5, text), (5, other), (7, ""), (7, ""), ((1 << 63) - 1, third)])
    assert jaccard.keep_one(table(spark, rows)).columns == table(spark, rows).columns


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    words = prose(3, 150).split()
    rows = [(i, " ".join(w if j != i % 150 else f"new{i}" for j, w in enumerate(words))) for i in range(120)]
    whole = jaccard.similarity_classes(table(spark, rows)).collect()
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    cut = jaccard.similarity_classes(table(spark, rows)).collect()
    assert sorted(whole) == sorted(cut) and {r["class_id"] for r in cut} == {0} and {r["n_links"] for r in cut} == {119}


def test_intersections():
    rng = np.random.default_rng(0)
    members = [np.unique(np.concatenate([rng.integers(0, 60, 40), rng.integers(0, 10**6, 5), [1000 + i // 3]])).astype(np.uint64) for i in range(100)]
    found = jaccard._intersections(members)
    assert all(found[i, j] == len(np.intersect1d(members[i], members[j])) for i in range(100) for j in range(0, 100, 7) if i != j)


# 2


def test_passages_of_fifty_words_are_found(spark):
    passage, fuzzy = prose(50, 60), prose(51, 80).split()
    for k in (20, 40, 60):
        fuzzy[k] = f"changed{k}"
    rows = [(i, prose(i, 150)) for i in range(60, 75)]
    rows += [(1, f"{prose(80, 100)} {passage} {prose(81, 30)}"), (2, f"{passage}\n{prose(82, 90)}"), (3, f"{prose(83, 20)} {passage.upper()}"), (4, f"{prose(84, 60)} {prose(51, 80)}"), (5, f"{prose(85, 10)} {' '.join(fuzzy)} {prose(86, 5)}")]
    rows += [(6, f"{prose(87, 40)} {prose(52, 30)} {prose(88, 40)}"), (7, f"{prose(52, 30)} {prose(89, 90)}")]
    found = substring.repeated_passages(table(spark, rows)).collect()
    assert {r["doc_id"] for r in found} | {r["other_id"] for r in found} == {1, 2, 3, 4, 5}
    texts = dict(rows)
    for r in found:
        own, other = alnum(texts[r["doc_id"]])[r["start_word"] : r["end_word"]], alnum(texts[r["other_id"]])[r["other_start_word"] : r["other_end_word"]]
        assert len(own) >= 50 and r["similarity"] >= 0.8
        if {r["doc_id"], r["other_id"]} < {1, 2, 3}:
            assert set(alnum(passage)) <= set(own) and own == other


def test_passages_of_hot_seeds_are_found(spark):
    one, two = prose(700, 30), prose(701, 30)
    rows = [(i, f"{prose(800 + i, 60)} {(one, two)[i % 2]} {prose(900 + i, 20)}") for i in (*range(20), *range(80, 100))]
    rows += [(i, f"{prose(800 + i, 60)} {one} {two} {prose(900 + i, 20)}") for i in (40, 50)]
    found = substring.repeated_passages(table(spark, rows)).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in found} == {frozenset((40, 50))}


def test_first_places_of_hot_seeds_are_spread_over_blocks():
    """Each of 400 seeds stands in all of 20 blocks: no block has the first place of most of them."""
    code = np.sort(np.random.default_rng(3).integers(4, 1 << 62, 400).astype(np.uint64))
    mail = []
    for block in range(20):
        number = np.repeat(np.arange(400), 10)  # more often than is sent
        mail += substring._send(block, 1, 0, np.repeat(code, 10), number, np.tile(np.arange(10), 400))
    met = substring._meet((substring.K,))(mail_table([m for m in mail if m[1] == substring._SEEDS]))
    known, one, _, two, _, _ = mail_read(met, substring._FIRSTS, np.uint64, np.int64, np.uint32, np.int64, np.uint32, rising=True)
    assert set(known.tolist()) == set(code.tolist()) and (one != two).all()
    for first in (one, two):
        asked = np.bincount(first >> 32, minlength=20)
        assert asked.sum() == 400 * 20 and asked.max() < 0.2 * asked.sum()


def test_rejected_chains_take_no_seeds_from_other_partners(spark):
    exact = prose(702, 60)
    rows = [(1, f"{prose(801, 60)} {' '.join(exact.split()[:40])} {prose(901, 20)}")]
    rows += [(i, f"{prose(800 + i, 60)} {exact} {prose(900 + i, 20)}") for i in (60, 70)]
    found = substring.repeated_passages(table(spark, rows)).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in found} == {frozenset((60, 70))}


def test_recall_of_changed_passages(spark):
    rng, rows = random.Random(7), []
    for i in range(90):
        words = prose(2000 + i, 60).split()
        changed = list(words)
        for k in rng.sample(range(60), (12, 9, 6)[i % 3]):  # similarity 0.80, 0.85, 0.90
            changed[k] = f"new{rng.randint(0, 10**6)}"
        rows += [(2 * i + j, f"{prose(3000 + 2 * i + j, 40)} {' '.join(w)} {prose(5000 + 2 * i + j, 40)}") for j, w in enumerate((words, changed))]
    found = {(r["doc_id"], r["other_id"]) for r in substring.repeated_passages(table(spark, rows)).collect()}
    recall = [sum((2 * i, 2 * i + 1) in found or (2 * i + 1, 2 * i) in found for i in range(s, 90, 3)) / 30 for s in range(3)]
    assert recall[0] >= 0.8 and recall[1] >= 0.9 and recall[2] >= 0.95, recall
    assert all(a // 2 == b // 2 for a, b in found)


def quadratic(x, y, n):
    """Score of the best chain that ends in each segment, from all segments before it."""
    score = []
    for j in range(len(x)):
        before = [score[i] - substring._GAP_COST * (x[j] - x[i] - n[i] + substring.K + y[j] - y[i] - n[i] + substring.K) for i in range(j) if x[i] + n[i] - substring.K < x[j] and y[i] + n[i] - substring.K < y[j]]
        score.append(n[j] + max([0.0, *before]))
    return score


def test_chains_equal_the_quadratic_program():
    rng = np.random.default_rng(2)
    for _ in range(200):
        m = int(rng.integers(1, 40))
        rows = np.unique(np.column_stack([rng.integers(0, 60, (m, 2)), rng.integers(5, 9, m)]), axis=0)
        x, y, n = (c.astype(np.int64) for c in rows.T)
        found = substring.chains(x, y, n)
        assert sorted(i for c in found for i in c) == list(range(len(x)))
        for c in found:
            assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() and not substring._apart(x, y, n, c).any()
        score = quadratic(x.tolist(), y.tolist(), n.tolist())
        cost = lambda c: n[c].sum() - substring._GAP_COST * (np.diff(x[c]) + np.diff(y[c]) - 2 * n[c[:-1]] + 2 * substring.K).sum()
        wide = substring.MAX_GAP
        substring.MAX_GAP = 1000  # whole chains
        try:
            best = max(cost(c) for c in substring.chains(x, y, n))
        finally:
            substring.MAX_GAP = wide
        assert math.isclose(best, max(score))
    tree = substring.Fenwick(5)
    for i, v in enumerate([3.0, 9.0, 4.0]):
        tree.put(i, v, i)
    assert tree.best(1) == (3.0, 0) and tree.best(3) == (9.0, 1) and tree.best(0) == (0.0, -1)


def test_segments():
    pair, x, y = (np.array(c, np.int64) for c in zip(*[(0, i, i + 3) for i in range(4)], (0, 12, 15), (0, 8, 11), (0, 30, 2), (1, 4, 7), strict=True))
    found = [c.tolist() for c in substring.segments(pair, x, y, np.full(len(x), 5, np.int64))]
    assert found == [[0, 0, 1], [0, 30, 4], [3, 2, 7], [17, 5, 5]]


def test_changed_passages_of_hot_seeds_only_are_found(spark):
    """Each run of 5 words or more that two passages share stands in ten more documents, apart from the others."""
    rng, rows = random.Random(11), []
    for i in range(20):
        words = prose(20000 + i, 60).split()
        changed = list(words)
        for k in rng.sample(range(60), (9, 6)[i % 2]):  # similarity 0.85, 0.90
            changed[k] = f"new{rng.randint(0, 10**6)}"
        shared = [r for r in " ".join(a if a == b else "/" for a, b in zip(words, changed, strict=True)).split("/") if len(r.split()) >= 5]
        for j, passage in enumerate((words, changed)):
            rows.append((2 * i + j, f"{prose(30000 + 2 * i + j, 40)} {' '.join(passage)} {prose(40000 + 2 * i + j, 40)}"))
        for j in range(10):
            rows.append((1000 + 10 * i + j, " ".join(f"{prose(50000 + 100 * (10 * i + j) + k, 30)} {r}" for k, r in enumerate(shared))))
    found = {frozenset((r["doc_id"], r["other_id"])) for r in substring.repeated_passages(table(spark, rows)).collect()}
    assert found == {frozenset((2 * i, 2 * i + 1)) for i in range(20)}


def test_hot_places_that_ask_find_all_that_resemble_them():
    """Against all pairs of places of two seeds, of which some stand in repetitions; asking ones in one part or several."""
    rng = np.random.default_rng(5)
    sides = substring._Sides.of(50, 0.8)
    base = rng.integers(1, 1 << 16, (3, 2 * sides.words)).astype(np.uint16)
    around = base[rng.integers(0, 3, 400)]
    around = np.where(rng.random(around.shape) < rng.choice([0.1, 0.4, 0.9], (400, 1)), rng.integers(1, 1 << 16, around.shape), around).astype(np.uint16)
    code, text, ask = rng.integers(0, 2, 400).astype(np.uint64), rng.integers(0, 200, 400), rng.random(400) < 0.3
    alike = lambda a, b, side: int((around[a][side] == around[b][side]).sum()) >= sides.common
    halves = (slice(0, sides.words), slice(sides.words, None))
    want = {(a, b) for a in range(400) for b in range(400) if code[a] == code[b] and text[a] > text[b] and (ask[a] or ask[b]) and any(alike(a, b, s) for s in halves)}
    for keys in (1 << 10, 4 << 20):
        before, substring._KEYS = substring._KEYS, keys
        try:
            found = {(int(a), int(b)) for own, other in substring._candidates(sides, code, text, ask, np.zeros(400, bool), around) for a, b in zip(own, other, strict=True)}
        finally:
            substring._KEYS = before
        assert len(want) > 100 and want == found


def test_places_of_a_frequent_line_are_not_compared_for_the_line_alone(monkeypatch):
    """3,000 texts have a line of 14 words in common, two of them much more, with words left out and put in."""
    rng = np.random.default_rng(6)
    sides = substring._Window.of(50, 0.8)
    around = rng.integers(1, 1 << 16, (3000, 2 * sides.words)).astype(np.uint16)
    around[:, sides.words : sides.words + 9] = np.arange(1, 10)
    right = around[0, sides.words :]
    around[1, sides.words :] = np.concatenate([np.delete(right, (12, 17, 22, 27)), [7, 8, 9, 10]])  # 41 of 45
    around[2, sides.words : sides.words + 30] = right[:30]  # too little
    compared, real = [], substring._Window.alike
    monkeypatch.setattr(substring._Window, "alike", lambda self, a, t, one, two: compared.append(len(one)) or real(self, a, t, one, two))
    everyone = np.ones(3000, bool)
    found = [(int(a), int(b)) for own, other in substring._candidates(sides, np.zeros(3000, np.uint64), np.arange(3000), everyone, ~everyone, around) for a, b in zip(own, other, strict=True)]
    assert {frozenset(p) for p in found} == {frozenset((0, 1))} and sum(compared) < 10_000  # of 4,498,500


def test_places_that_share_no_key_make_no_pair():
    """Also if all partners have a place before that stands for them."""
    sides = substring._Window.of(50, 0.8)
    around = np.arange(1, 1 + 2 * 2 * sides.words, dtype=np.uint16).reshape(2, -1)
    for words, before in ((around, False), (np.repeat(around[:1], 2, axis=0), True)):
        assert not list(substring._candidates(sides, np.zeros(2, np.uint64), np.arange(2), np.ones(2, bool), np.full(2, before), words))


def test_windows_that_hold_a_seed_are_found():
    """Against all pairs: every split of the 45 words beside the seed, some words repeated, left out or put in."""
    rng = np.random.default_rng(7)
    sides = substring._Window.of(50, 0.8)
    base = rng.integers(1, 30, (3, 200)).astype(np.uint16)
    rows = []
    for i in range(300):
        halves = [base[i % 3, :100], base[i % 3, 100:]]
        for h in (0, 1):
            drop = rng.random(100) < rng.choice([0.02, 0.1, 0.3])
            halves[h] = np.insert(halves[h][~drop], rng.integers(0, 40, rng.integers(0, 4)), 1000 + i)[: sides.words]
        rows.append(np.concatenate(halves))
    around, text, ask = np.array(rows), np.arange(300), rng.random(300) < 0.5

    def alike(a, b):
        left, right = ([longest_common(around[a][s][:n].tolist(), around[b][s].tolist()) for n in range(46)] for s in (slice(0, 45), slice(45, 90)))
        return any(left[n] + right[m] + 5 >= 0.8 * (n + m + 5) - 1e-6 for n in range(46) for m in range(45 - n, 46))

    found = {(int(a), int(b)) for own, other in substring._candidates(sides, np.zeros(300, np.uint64), text, ask, np.zeros(300, bool), around) for a, b in zip(own, other, strict=True)}
    some = [(a, b) for a in range(0, 300, 4) for b in range(0, a, 7) if ask[a] or ask[b]]
    want = {p for p in some if alike(*p)}
    assert 50 < len(want) < len(some) and want == found & set(some)


def test_exact_passages_of_random_corpora(spark):
    """Whatever repeats, each document with 50 words of another one is in a row with such words."""
    rng = random.Random(11)
    stock = [prose(9000 + i, rng.choice([10, 20, 30, 60])).split() for i in range(12)]
    rows = []
    for i in range(160):
        words = []
        while len(words) < 200:
            words += rng.choice(stock) if rng.random() < 0.5 else prose(10_000 + 100 * i + len(words), rng.randint(5, 60)).split()
        rows.append((i, " ".join(words)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, "same " * 300), (503, f"{prose(1, 20)} {'same ' * 200}"), (504, "same same " + prose(2, 60))]
    windows = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - 49):
            windows[tuple(w[a : a + 50])].add(i)
    expected = {i for who in windows.values() if len(who) > 1 for i in who}
    found = substring.repeated_passages(table(spark, rows), block_bytes=1 << 14).collect()
    named = {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    assert expected <= named and len(expected) < len(rows)
    texts = {i: t.split() for i, t in rows}
    for r in found:
        own, other = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["other_id"]][r["other_start_word"] : r["other_end_word"]]
        assert min(len(own), len(other)) >= 50 and r["matches"] >= 0.8 * max(len(own), len(other)) - 1e-9
        assert dict(rows)[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().split() == own
        assert longest_common(own, other) >= r["matches"]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for v in a:
        left = 0
        for j, w in enumerate(b):
            left, row[j], up = (row[j] + 1 if v == w else max(row[j + 1], left)), left, row[j + 1]
        row[-1] = left
    return row[-1]


def test_passages_among_fragments(spark):
    """The pair with the whole passage is found though each of its seeds stands in many other documents."""
    passage = prose(703, 60).split()
    rows = [(i, f"{prose(800 + i, 60)} {' '.join(passage[(i % 3) * 20 : (i % 3) * 20 + 20])} {prose(900 + i, 20)}") for i in (*range(9), *range(200, 209))]
    rows += [(i, f"{prose(800 + i, 60)} {' '.join(passage)} {prose(900 + i, 20)}") for i in (100, 101)]
    found = substring.repeated_passages(table(spark, rows)).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in found} == {frozenset((100, 101))}


def test_spans_are_what_pairs_cover(spark):
    """Runs of one word and near copies: as many rows as documents have spans, with the words and classes of all pairs; the longest runs are of one id."""
    rng, n = random.Random(13), 60
    rows = [(i, f"{prose(60_000 + i, 30)} {'same ' * (50 + 7 * i)}{prose(61_000 + i, 30)}") for i in range(n)]
    rows += [(n - 1, f"{prose(62_000, 30)} {'same ' * 500}{prose(62_001, 30)}"), (n - 1, f"{prose(62_002, 30)} {'same ' * 90}{prose(62_003, 30)}")]
    words = prose(63_000, 80).split()
    rows += [(100 + i, f"{prose(64_000 + i, 40)} {' '.join(w if rng.random() > 0.05 else f'new{i}x{j}' for j, w in enumerate(words))} {prose(65_000 + i, 40)}") for i in range(20)]
    rows += [(200, rows[-1][1]), (201, prose(66_000, 90)), (202, prose(66_001, 90)), (203, prose(66_001, 90))]
    pairs = substring.repeated_passages(table(spark, rows)).collect()
    spans = substring.repeated_spans(table(spark, rows)).collect()
    assert len([r for r in pairs if r["doc_id"] < 100]) <= 4 * (n + 2)
    assert len(spans) == n + 2 + 20 + 3  # one for each text but that of 201, one more for each copy
    covered, given, root, classes = defaultdict(set), defaultdict(set), {}, {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for r in pairs:
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        covered[r["other_id"]] |= set(range(r["other_start_word"], r["other_end_word"]))
        a, b = top(r["doc_id"]), top(r["other_id"])
        root[max(a, b)] = min(a, b)
    texts = defaultdict(list)
    for i, text in rows:
        texts[i].append(text)
    for r in spans:
        given[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        classes[r["doc_id"]] = r["class_id"]
        assert any(t.encode()[r["start_byte"] : r["end_byte"]].decode().split() == t.split()[r["start_word"] : r["end_word"]] for t in texts[r["doc_id"]])
    assert given == covered and classes == {i: top(i) for i in covered}
    # whole runs, but of the longest ones of one id what the longest one of another has
    assert all(set(range(30, 80 + 7 * i)) <= given[i] for i in range(n - 1)) and all(classes[i] == 0 for i in range(n))


def test_words_of_blocks(monkeypatch):
    """What a block keeps are the words of its texts in order of their keys, in slices of whole texts."""
    monkeypatch.setattr(substring, "_AT_ONCE", 100)
    texts = ["", "Ünï  code, Words!", "...", prose(71_000, 300), "a", f"  {prose(71_001, 60)}\n\n{prose(71_002, 60)} "] + [prose(71_010 + i, 40) for i in range(9)]
    keys = [(7 * i) % len(texts) - 5 for i in range(len(texts))]
    types = {"block": pa.int32(), "key": pa.int64(), "text": pa.string(), "id": pa.int64()}
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(([3] * len(texts), keys, texts, range(len(texts))), types.values(), strict=True)], names=list(types))
    kept = substring._Texts(substring._split(pa.Table.from_batches(substring._pack([batch.slice(0, 5), batch.slice(5)]))))
    assert kept.keys.tolist() == sorted(keys) and [keys[i] for i in kept.ids] == sorted(keys)
    found = []
    for a, words in kept.words():
        assert a == len(found)
        found += [tuple(c[i:j].tolist() for c in (words.code, words.start, words.end)) for i, j in zip(words.first[:-1], words.first[1:], strict=True)]
    whole = [Words(np.frombuffer(texts[i].encode(), np.uint8), np.array([0, len(texts[i].encode())])) for i in kept.ids]
    assert found == [(w.code.tolist(), w.start.tolist(), w.end.tolist()) for w in whole]


def test_a_frequent_line_sends_the_words_around_its_first_seed_only(spark, monkeypatch, tmp_path):
    """Places whose seed the one before stands for are of no use to the comparison; a run of one word, and what else a word before tells apart, still are."""
    line = prose(72_000, 20)
    rows = [(i, f"{prose(72_100 + i, 60)} {line} {prose(72_200 + i, 60)}") for i in range(40)]
    rows += [(100 + i, f"{prose(72_300 + i, 60)} {'same ' * 12}{prose(72_400 + i, 60)}") for i in range(12)]
    real = substring._compare

    def counted(sides, min_words):
        run, folder = real(sides, min_words), str(tmp_path)

        def compare(mail):
            n = len(mail_read(mail, substring._AROUND, np.uint64, rising=True)[0])
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(n))
            return run(mail)

        return compare

    monkeypatch.setattr(substring, "_compare", counted)
    assert substring.repeated_spans(table(spark, rows)).count() == 0
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 40 + 12 * 8


def test_shuffle_files_go_between_the_rounds(spark, monkeypatch):
    """Alignment shuffles all words; that is released before words travel once more."""
    told, step, release = [], substring.Step, substring.release
    monkeypatch.setattr(substring, "Step", lambda df: (told.append("step"), step(df))[1])
    monkeypatch.setattr(substring, "release", lambda s: (told.append("release"), release(s))[1])
    line = prose(73_000, 20)
    substring.repeated_spans(table(spark, [(i, f"{prose(73_100 + i, 60)} {line} {prose(73_200 + i, 60)}") for i in range(20)]))
    # blocks, seeds, hot ones twice and the frequent ones; chains, passages; places, anchors; chains, passages
    assert " ".join(told) == "step release step release step step step step release step release step step release step release step release"


# 3


def test_language_held_out_accuracy(spark):
    found = queries.op3_language_id(spark, DATA).toPandas()
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95 and both.score.between(0, 1).all()
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    docs = spark.createDataFrame([(1, "le la", "fr"), (2, "the of", "en"), (3, "12 !?", "en"), (4, None, None)], "doc_id long, text string, lang string")
    model = langid.fit_languages(docs)
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(docs, model).collect()} == {1: "fr", 2: "en", 3: "und", 4: "und"}
    assert {r["lang_pred"] for r in langid.predict_languages(docs, langid.fit_languages(docs.where("lang is null"))).collect()} == {"und"}


def test_language_scores_equal_a_plain_naive_bayes(spark):
    rows = [(i, prose(i, 30) if i % 2 else prose(i, 30).translate(str.maketrans("abcd", "wxyz")), "ab"[i % 2]) for i in range(12)] + [(12, prose(50, 4), None), (13, "Wxé wX", "b"), (14, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bits = 8
    found = {r["doc_id"]: r for r in langid.predict_languages(docs, langid.fit_languages(docs, bits=bits)).collect()}

    def buckets(text):
        """Buckets by the definition, one n-gram after the other."""
        low = [c if c.isalpha() else " " for c in (text or "").lower()]
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                own = low[i : i + n]
                if any(c != " " for c in own):
                    code = 0x9E3779B1 * n & 0xFFFFFFFF
                    for c in own:
                        code = (code ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
                        code ^= code >> 15
                    yield (code * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - bits

    counts = {k: Counter(b for _, t, k2 in rows if k2 == k for b in buckets(t)) for k in "ab"}
    used = len(set(counts["a"]) | set(counts["b"]))
    for i, t, _ in rows:
        own = list(buckets(t))
        logs = {k: math.log(sum(r[2] == k for r in rows) / 14) + sum(math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * used)) for b in own) for k, c in counts.items()}
        if not own:
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0)
            continue
        best = max(logs, key=logs.get)
        assert found[i]["lang_pred"] == best and math.isclose(found[i]["score"], 1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel_tol=1e-6)


# 4


def test_filter_lists(spark):
    """Some thousand rules against running every one of them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 3)))
    lines = ["! a comment", "", "||ads.example.com^", "@@||ads.example.com/good^", "|track.", "/banner/*/img^", "||net^*/x.gif|", "@@||Example.org/en/", "^id^"]
    while len(lines) < 2500:
        lines.append(rng.choice(["", "@@"]) + f"||{word()}.{word()}.{rng.choice(['com', 'net'])}^" + rng.choice(["", f"{word()}/", f"*{word()}^", f"{word()}|"]))
    rules = urlfilter.read_rules(lines)
    hosts = [f"{word()}.{word()}.{rng.choice(['com', 'net'])}" for _ in range(60)] + ["ads.example.com", "x.ads.example.com", "bads.example.com", "track.me", "example.org", "a.net"]
    urls = [f"http://{h}{rng.choice(['', '/', '/' + word() + '/', '/good', '/goods', '/banner/a/img', '/en/' + word(), '/x.gif', '/q/id', '/' + word()])}" for h in hosts for _ in range(4)]
    compiled = [(r, re.compile(r.pattern)) for r in rules]

    def plain(url):
        target = url.split("://", 1)[1]
        fits = [r for r, p in compiled if p.search(target)]
        best = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
        return (None, "allow") if best is None else (best.name, best.verdict)

    expected = {i: plain(u) for i, u in enumerate(urls)}
    assert 30 < sum(n is not None for n, _ in expected.values()) < len(urls)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for inline in (0, 5000):
        some = rules if not inline else rules[:300]
        if inline:
            compiled = [(r, re.compile(r.pattern)) for r in some]
            expected = {i: plain(u) for i, u in enumerate(urls)}
        found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, some, (), inline_rules=inline).collect()}
        assert found == expected
    with pytest.raises(ValueError):
        urlfilter.read_rules(["||*x*"])


def test_rules_equal_a_plain_reading(spark):
    urls = ["http://example.com/en/1", "https://www.example.com/en/1", "http://a.www.EXAMPLE.com/en/", "http://example.com/EN/1", "http://net/es/x", "x://b.net/fr/?q", "http://com", "http://com/", "com/", None, "", "http://", "://a.com/x#y", "http://notexample.com/en/x", "http://evil.net/casino/x", "http://a b.com/x", "http://h.net?x=/es/", "http://u:1@example.com/en/", "http://spamalot.org/", "HTTP://X.COM/a\nb", "a://b://c.com/d"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    rules = queries.URL_RULES

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
        fits = []
        for r in rules:
            h, _, p = r.name.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(r.name), r.name, r.verdict))
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        words = set(re.split(r"[^0-9A-Za-z]+", host + path))
        return host, path, None, "block" if words & {r.literals[0] for r in urlfilter.OWN_RULES} else "allow"

    for inline in (1000, 0):
        found = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge_urls(pages, rules, inline_rules=inline).collect()}
        assert found == {i: plain(u) for i, u in enumerate(urls)}
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, [], ()).collect()} == {"allow"}
    part = urlfilter.site_rule("example.org/news", "block")
    assert "news" not in part.literals and urlfilter.index_rules([part], {"example": 5, "org": 9}) == {"example": [0]}


# 5


def test_lm_base_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, "odd Row"), (10**6, None), (10**6 + 1, "\x1f a\u00a0b ")], "doc_id long, text string"))
    found = suffixlm.score_texts(docs).collect()
    rows = docs.collect()
    tokens = {r[0]: [*re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])), None] for r in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in found:
        ts = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        assert r["score"] < 0


def test_lm_score_equals_a_plain_tree(spark):
    """The tree from its definition, in dictionaries, on texts that repeat words, pairs and passages."""
    rng, vocabulary = random.Random(9), prose(5, 40).split()
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [[*(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))), *(passage[: rng.randint(0, 30)] if i % 3 == 0 else [])] for i in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(200, "unseen " + "x" * 3000 + " words"), (201, None)]
    blocks = table(spark, rows).selectExpr("doc_id", "text", "false AS held_out", "true AS train", "false AS nothing").mapInArrow(suffixlm._blocks(2000), suffixlm._BLOCKS)
    spelling = suffixlm.fit_spelling(blocks)
    found = {r["doc_id"]: r for r in suffixlm.score_texts(table(spark, rows), spelling=spelling, gain=6.0, block_bytes=2000).collect()}
    tokens = {i: [*(t or "").split(), None] for i, t in rows}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)

    def spelt(w):
        if w is None:
            return suffixlm._STOP_SHARE
        own = np.frombuffer(w.encode() + b"\n", np.uint8)
        return (1 - suffixlm._STOP_SHARE) * 10.0 ** float(spelling.score(own, np.array([0, len(own)]))[0])

    root = lambda w: (counts[w] + v * spelt(w)) / (n + v)
    followers = {k: defaultdict(Counter) for k in (1, 3)}
    for t in train:
        for k in (1, 3):
            for i in range(k, len(t)):
                followers[k][tuple(t[i - k : i])][t[i]] += 1
    pairs = {(c[0], w): m for c, ws in followers[1].items() for w, m in ws.items()}

    def smoothed(own, w, lower):
        total, kinds = sum(own.values()), len(own)
        gain = sum(m * math.log(m / total / lower(x)) for x, m in own.items())
        return (own[w] + kinds * lower(w)) / (total + kinds) if total >= 2 and gain > 6.0 else lower(w)

    def one(c, w):
        return smoothed(followers[1][c], w, root) if counts[c[0]] >= 2 else root(w)

    kept = 0
    for i, t in tokens.items():
        log = 0.0
        for j, w in enumerate(t):
            p = one((t[j - 1],), w) if j else root(w)
            if j >= 3 and min(pairs.get((t[j - 3], t[j - 2]), 0), pairs.get((t[j - 2], t[j - 1]), 0)) >= 2:
                longer = smoothed(followers[3][tuple(t[j - 3 : j])], w, lambda x, c=(t[j - 1],): one(c, x))
                kept += longer != p
                p = longer
            log += math.log10(p) if p > 0 else float(spelling.score(np.frombuffer(w.encode() + b"\n", np.uint8), np.array([0, len(w) + 1]))[0]) + math.log10(0.99 * v / (n + v))
        assert math.isclose(found[i]["score"], log, rel_tol=1e-3), (i, found[i]["score"], log)
    assert kept > 100
    # probabilities of all next tokens add up to one behind any context, but for unseen words
    for c in list(followers[1])[:20]:
        assert math.isclose(sum(one(c, w) for w in counts) + (1 - sum(root(w) for w in counts)) * (one(c, "zzzz") / root("zzzz")), 1, rel_tol=1e-6)


def test_lm_sums_that_a_block_tells_itself_pass_the_ranges():
    """What is settled goes back to its block, so that later steps don't read the answers behind it."""
    model = suffixlm._Model(4, 6.0, 32, 8)
    own = (model.n_ranges + 9, suffixlm._SCORED, 9, suffixlm.planes(np.array([-1.5, -2.5])))
    back = suffixlm._answer_runs(model, 2)(mail_table([own]))
    assert back.column("to").to_pylist() == [9]
    assert mail_read(back, suffixlm._SCORED, np.float64)[0].tolist() == [-1.5, -2.5]


def test_lm_score_equals_a_plain_tree_without_gaps(spark, monkeypatch):
    """The query's tree: contexts of one, two and three tokens, each falling to the next shorter one."""
    rng, vocabulary = random.Random(12), prose(6, 30).split()
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [[*(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))), *(passage[: rng.randint(0, 30)] if i % 3 == 0 else [])] for i in range(120)]
    # behind two tokens the next one is known, behind one it isn't, and three tokens never recur
    texts += [[f"own{i}", vocabulary[0], vocabulary[1 + i % 5], f"next{i % 5}"] for i in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    blocks = table(spark, rows).selectExpr("doc_id", "text", "false AS held_out", "true AS train", "false AS nothing").mapInArrow(suffixlm._blocks(2000), suffixlm._BLOCKS)
    spelling = suffixlm.fit_spelling(blocks)
    whole = suffixlm.score_texts
    monkeypatch.setattr(queries, "_table", lambda *_: table(spark, rows))
    monkeypatch.setattr(suffixlm, "score_texts", lambda docs, **options: whole(docs, spelling=spelling, gain=6.0, block_bytes=2000, **options))
    found = {r["doc_id"]: r for r in queries.op5_lm_scoring(spark, "").collect()}
    tokens = {i: [*t.split(), None] for i, t in rows}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    followers = defaultdict(Counter)
    for t in train:
        for k in (1, 2, 3):
            for i in range(k, len(t)):
                followers[tuple(t[i - k : i])][t[i]] += 1

    def spelt(w):
        if w is None:
            return suffixlm._STOP_SHARE
        return (1 - suffixlm._STOP_SHARE) * 10.0 ** float(spelling.score(np.frombuffer(w.encode() + b"\n", np.uint8), np.array([0, len(w) + 1]))[0])

    @cache
    def probability(context, w):
        if not context:
            return (counts[w] + v * spelt(w)) / (n + v)
        own, lower_ = followers.get(context, Counter()), lambda x: probability(context[1:], x)
        total, kinds = sum(own.values()), len(own)
        gain = sum(m * math.log(m / total / lower_(x)) for x, m in own.items()) if total >= 2 else 0.0
        return (own[w] + kinds * lower_(w)) / (total + kinds) if gain > 6.0 else lower_(w)

    used = Counter()
    for i, t in tokens.items():
        log = 0.0
        for j, w in enumerate(t):
            p = [probability(tuple(t[j - k : j]), w) for k in range(min(j, 3) + 1)]
            used.update(k for k in range(1, len(p)) if p[k] != p[k - 1])
            log += math.log10(p[-1])
        assert math.isclose(found[i]["score"], log, rel_tol=1e-3), (i, found[i]["score"], log)
    assert min(used[1], used[2], used[3]) > 50, used


def test_lm_beats_token_counts_on_held_out_texts(spark):
    found = queries.op5_lm_scoring(spark, "/root/testdata/sf0.01").toPandas()
    held = found[found.held_out]
    assert len(held) > 50 and held.score.sum() > held.base_score.sum()


def test_automaton_is_the_longest_kept_suffix():
    text = np.frombuffer((prose(1, 3000) + "\n").encode(), np.uint8)
    offsets = np.array([0, len(text)])
    codes, n = suffixlm.gram_counts(text, offsets, 3)
    levels = []
    for d in range(4):
        low = codes & np.uint64((1 << 8 * (d + 1)) - 1)
        order = np.argsort(low, kind="stable")
        g, m = suffixlm.packed_counts(low[order], n[order])
        levels.append(((g >> np.uint64(8)).astype(np.int64), (g & np.uint64(255)).astype(np.int64), m))
    tree = suffixlm.SuffixAutomaton.fit(levels, 3, 3.0, 5.0)
    assert len(tree.logs) > 20
    total = 10.0 ** tree.logs[:, :-1].astype(float)
    unseen = 256 - (tree.logs.shape[1] - 1)
    assert np.allclose(total.sum(axis=1) + unseen * 10.0 ** tree.logs[:, -1], 1, atol=1e-4)
    long, both = b"ab " * 700 + b"c\n", b"ab c\n"
    lanes = tree.score(np.frombuffer(long + both, np.uint8), np.array([0, len(long), len(long) + len(both)]))
    for i, one in enumerate((long, both)):
        state, log = 0, 0.0
        for _ in range(3):
            state = tree.moves[state, tree.code[10]]
        for s in one:
            log += float(tree.logs[state, tree.code[s]])
            state = tree.moves[state, tree.code[s]]
        assert math.isclose(lanes[i], log, rel_tol=1e-6)


# 6


def test_changed_passages_of_hot_seeds_are_linked_like_by_brute_force(spark):
    """Variants of passages that all share a frequent line: what windows of 50 words link, rows link; each pair has a row."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    hot, rows, n = words(5), [], 0
    for family in range(6):
        base = words(70)
        base[30:35] = hot
        for _ in range(12):
            own = [x if 30 <= i < 35 or rng.random() > 0.06 else words(1)[0] for i, x in enumerate(base)]
            rows.append((n, family, words(rng.randrange(30)) + own + words(rng.randrange(30))))
            n += 1
    rows += [(n + i, None, words(60) + hot + words(60)) for i in range(30)]
    found = substring.repeated_passages(table(spark, [(i, " ".join(x)) for i, _, x in rows])).collect()
    root = {i: i for i, *_ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        root[max(top(r.doc_id), top(r.other_id))] = min(top(r.doc_id), top(r.other_id))
    pairs = {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in found}
    text = {i: x for i, _, x in rows}
    for r in found:  # each row is what it says
        a, b = text[r.doc_id][r.start_word : r.end_word], text[r.other_id][r.other_start_word : r.other_end_word]
        assert min(len(a), len(b)) >= 50 and r.matches >= 0.8 * max(len(a), len(b))
    # brute force: texts of a family of which 50 words in a row agree in 40 places
    linked = missed = 0
    for i, f, x in rows:
        for j, g, y in rows:
            if f is not None and f == g and i < j:
                p, q = (z.index(hot[0]) for z in (x, y))
                same = [k for k in range(-30, 40) if 0 <= p + k < len(x) and 0 <= q + k < len(y) and x[p + k] == y[q + k]]
                if max(sum(a <= k < a + 50 for k in same) for a in range(-30, -9)) >= 41:
                    linked += 1
                    missed += (i, j) not in pairs
    assert linked > 300 and missed <= 0.02 * linked
    assert {len({f for i, f, _ in rows if top(i) == t and f is not None}) for t in {top(i) for i, f, _ in rows if f is not None}} == {1}


def test_packing_into_few_sequences_whatever_the_partitions(spark):
    """Bins that tasks leave open are packed into one another: many small partitions cost next to nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {}
    for n in (1, 60):
        rows = packing.pack_documents(docs.repartition(n), queries.tokenizer_path()).toPandas()
        for _, own in rows.sort_values("offset").groupby("sequence_id"):
            assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
        found[n] = rows.sequence_id.nunique()
        least = rows.length.sum() / 2048
    assert found[1] <= 1.02 * least and found[60] <= 1.03 * least


def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(i, t) for i, t in ODD if i is not None][:6] + [(20, prose(4, 3000)), (21, "<|endoftext|> a"), (22, "x" * 20_000)]
    rows += [(100 + i, prose(i, 20 + i)) for i in range(100)]
    found = packing.pack_documents(table(spark, rows), queries.tokenizer_path(), max_tokens=512).toPandas()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    for i, own in found.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        assert own.length.sum() == len(ids[i]) and (own.length.iloc[1:] == 512).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes())
    for _, bin_ in found.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum()[:-1]] and bin_.length.sum() <= 512
    assert found.sequence_id.nunique() <= found.length.sum() / 512 * 1.1 + 8


def test_bin_choice():
    packer = packing.BestFit(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 9, 4, 1)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 9)]
    packer = packing.BestFit(10, 1)
    assert packer.place(4) == (0, 0) and packer.place(7) == (1, 0) and packer.place(6) == (0, 4)
    assert packing.pieces(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.pieces(4, 2) == [(0, 2), (2, 2)]


# 7


def test_decontamination_equals_brute_force(spark):
    items = [(i, prose(200 + i, 20)) for i in range(30)] + [(40, "two words"), (41, None), (42, "... !"), (43, prose(200, 20)), (44, "one")]
    rows = [(i, prose(i, 60)) for i in range(20)]
    rows += [(50, f"{prose(1, 10)} {prose(205, 20)} {prose(2, 10)} {prose(206, 20)}"), (51, prose(207, 20).upper()), (52, " ".join(alnum(prose(208, 20))[3:11]) + " tail"), (53, f"x Two  words, {prose(200, 20)}"), (54, "a one b"), (55, None), (55, None), (56, prose(209, 7))]
    rows.append((57, " ".join(f"{prose(210 + i, 20)} {prose(300 + i, 400)}" for i in range(5))))
    docs, benchmark = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        w = alnum(text)
        hit, who = set(), set()
        for item, t in items:
            own = alnum(t)
            m = min(8, len(own))
            windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if own else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    who.add(str(item))
        return len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(who) >= 2

    expected = sorted((i, *brute(t)) for i, t in rows)
    assert sum(e[3] > 0 for e in expected) >= 6
    assert sorted(map(tuple, decontam.benchmark_overlap(docs, benchmark).collect())) == expected
    assert sorted(map(tuple, decontam.benchmark_overlap(docs, benchmark, max_patterns=100).collect())) == expected
    leaks = docs.select("doc_id", decontam.leaks(spark, benchmark, F.col("text"), max_patterns=100).alias("n"))
    whole = [(i, t) for i, t in items if len(alnum(t)) >= 8]

    def leak(t):
        w = alnum(t)
        windows = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        return any(tuple(own[i : i + 8]) in windows for _, x in whole for own in [alnum(x)] for i in range(len(own) - 7))

    texts = dict(rows)
    assert sorted(map(tuple, leaks.collect())) == [(e[0], leak(texts[e[0]]) or e[3] >= 2) for e in expected]
    assert decontam.benchmark_overlap(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_with_many_items_and_long_texts(spark):
    """A benchmark of several chunks whose windows are all common, and a text of a megabyte."""
    items = [(i, prose(7000 + i % 300, 40)) for i in range(900)]
    rows = [(1, f"{prose(1, 150_000)} {prose(7005, 40)} {prose(2, 50)}"), (2, " ".join(prose(7000 + i, 40) for i in range(300)))]
    found = {r["doc_id"]: r for r in decontam.benchmark_overlap(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), max_patterns=5000).collect()}
    assert (found[1]["n_hit"], found[1]["n_items"]) == (40, 3) and (found[2]["n_hit"], found[2]["n_items"]) == (12_000, 900)


# 8


def test_quality_held_out_accuracy(spark):
    found = queries.op8_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = found[found.held_out].merge(labels, on="doc_id")
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert (found.predicted == (found.score >= 0.7)).all() and found.score.between(0, 1).all()
    docs = table(spark, ODD)
    none = quality.score_quality(docs, quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))).toPandas()
    assert np.allclose(none.score, 0.5)


def test_quality_equals_a_plain_discriminant(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["Ab", "the", "x!", "#4", "word.", "x|y", "a,b"], int(rng.integers(1, 60)), p=[0.3 - 0.2 * (i % 2), 0.3, 0.05 + 0.2 * (i % 2), 0.05, 0.1, 0.1, 0.1]))) for i in range(60)] + [(60, None), (61, "")]
    labels = [(i, i % 2) for i in range(40)] + [(3, 1), (61, 0), (None, 1), (50, None), (99, 1)]
    model = quality.fit_quality(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    found = {r["doc_id"]: r["score"] for r in quality.score_quality(table(spark, rows), model).collect()}
    import pyarrow as pa

    x = dict(zip([i for i, _ in rows], quality.statistics(pa.array([t for _, t in rows])), strict=True))
    own = [np.array([x[i] for i, q in labels if q == c and i in x]) for c in (0, 1)]
    k, n = len(quality.STATISTICS), np.array([len(o) for o in own], float)
    cov = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(m * np.diag(s) for m, s in zip(n, cov, strict=True)) / n.sum()
    for i, v in x.items():
        logs = []
        for c in (0, 1):
            share = 0.02 + 0.98 * k / (n[c] + k)
            sigma = (1 - share) * cov[c] + share * np.diag(pooled) + 1e-4 * np.eye(k)
            d = v - own[c].mean(axis=0)
            logs.append(math.log((n[c] + 1) / (n.sum() + 2)) - 0.5 * np.linalg.slogdet(sigma)[1] - 0.5 * d @ np.linalg.solve(sigma, d))
        assert math.isclose(found[i], 1 / (1 + math.exp(min(700, logs[0] - logs[1]))), rel_tol=1e-6, abs_tol=1e-12)


# 9


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_one_edit():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert linededup._edit(a, b) == (levenshtein(a, b) <= 1), (a, b)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    lines = [prose(400 + i, rng.randint(1, 12)) for i in range(40)] + ["é" * 25, "short", "", "  ", "a" * 30, "ab" * 20]
    pool = list(lines)
    for line in lines * 2:
        for _ in range(2):
            at = rng.randint(0, len(line))
            pool.append(rng.choice([line[:at] + "Z" + line[at:], line[:at] + line[at + 1 :], line[:at] + "é" + line[at + 1 :], line[:at] + "xy" + line[at:], line]))
    rng.shuffle(pool)
    rows = [(i, "\n".join(pool[4 * i : 4 * i + 4])) for i in range(len(pool) // 4)] + [(900, None), (901, ""), (902, "\n\n")]
    docs = table(spark, rows)
    flat = [(i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip()]
    gone = defaultdict(list)
    for k, (i, n, x) in enumerate(flat):
        if any(x == y or min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) < 2 and levenshtein(x, y) <= 1 for _, _, y in flat[:k]):
            gone[i].append(n)
    assert sum(map(len, gone.values())) > 60
    found = {r["doc_id"]: r for r in linededup.line_report(docs).collect()}
    for i, t in rows:
        assert found[i]["dropped_lines"] == ",".join(map(str, gone[i])) and found[i]["n_dropped"] == len(gone[i])
        assert found[i]["n_lines"] == (0 if t is None else len(t.split("\n")))
    left = linededup.drop_lines(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        t = dict(rows)[r["doc_id"]]
        assert r["text"] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[r["doc_id"]]))


def test_line_dedup_goes_by_row(spark):
    """Rows without an id or with a repeated one stand for themselves; no id stands for another."""
    dup, most = "a line that many rows have", (1 << 63) - 1
    rows = [(None, dup), (None, "a line of no other row at all"), (5, dup), (5, "one more line of a single row"), (most, f"{dup}\nthe line of the greatest id"), (most, "yet another line of that id"), (7, "twice the same line\nof a row"), (7, "twice the same line\nof a row")]
    docs = table(spark, rows)
    left = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in linededup.drop_lines(docs).collect())
    assert left == sorted([(-1, ""), (-1, rows[1][1]), (5, dup), (5, rows[3][1]), (most, "the line of the greatest id"), (most, rows[5][1]), (7, rows[6][1]), (7, rows[6][1])])
    report = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_lines"], r["dropped_lines"]) for r in linededup.line_report(docs).collect())
    assert report == sorted([(-1, 1, "0"), (-1, 1, ""), (5, 1, ""), (5, 1, ""), (most, 2, "0"), (most, 1, ""), (7, 2, ""), (7, 2, "")])
    found = linededup.duplicate_lines(docs).collect()
    assert sorted((r["doc_id"] or 0, r["line"]) for r in found) == [(0, 0), (most, 0)]
    long = "x" * 1_000_000
    found = linededup.line_report(table(spark, [(1, long + "a"), (2, long + "b\nshort"), (3, "short")])).collect()
    assert sorted((r["doc_id"], r["dropped_lines"]) for r in found) == [(1, ""), (2, "0"), (3, "0")]


# 10


def nearest_by_force(rows, k, every):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            out[q] = sorted(((-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q))[:k]
    return out


def test_neighbours_equal_brute_force_on_small_tables(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(60)]  # copies and ties
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [float("inf")] * 8), (2100, [1.0] * 3), (None, [1.0] * 8), (2120, [])]
    frame = spark.createDataFrame([(i, v, 0, 1.0) for i, v in vectors + odd], "vec_id long, embedding array<float>, node int, score double")
    found = ann.nearest(frame).toPandas()
    expected = nearest_by_force(vectors, 20, 20)
    assert set(found.query_id) == set(expected)
    hits = 0
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        assert sorted(zip(-own.score, own.vec_id, strict=True)) == list(zip(-own.score, own.vec_id, strict=True))
        hits += len(set(own.vec_id) & {i for _, i in expected[q]})
    assert hits >= 0.98 * 20 * len(expected)
    few = ann.nearest(frame.where("vec_id < 5")).toPandas()
    assert len(few) == 4 and few.query_id.unique().tolist() == [0]
    assert ann.nearest(frame.limit(0)).count() == 0 and ann.nearest(frame.where("vec_id = 20")).count() == 0
    repeated = ann.nearest(frame.where("vec_id < 30").union(frame.where("vec_id < 30")))
    assert sorted(map(tuple, repeated.collect())) == sorted(map(tuple, ann.nearest(frame.where("vec_id < 30")).collect()))


@pytest.mark.parametrize("scale", [1e-12, 3e7])
def test_neighbours_at_any_scale(spark, scale):
    x = np.random.default_rng(4).standard_normal((400, 16)) * scale
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(400), "embedding": x.tolist()}))
    found = ann.nearest(frame).toPandas()
    expected = nearest_by_force(list(enumerate(x.tolist())), 20, 20)
    assert sum(len(set(own.vec_id) & {i for _, i in expected[q]}) for q, own in found.groupby("query_id")) >= 0.98 * 20 * len(expected)


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(3000), "embedding": x.tolist()}))
    found = ann.nearest(frame).toPandas()
    expected = nearest_by_force(list(enumerate(x.tolist())), 20, 20)
    hits = sum(len(set(own.vec_id) & {i for _, i in expected[q]}) for q, own in found.groupby("query_id"))
    assert hits >= 0.9 * 20 * len(expected)


def test_graph_goes_on_until_it_settles(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 32)
    x = np.random.default_rng(3).standard_normal((2500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, vector binary")
    graph, _ = ann.neighbour_graph(frame, len(x), 64)
    product = x @ x.T
    np.fill_diagonal(product, -np.inf)
    truth = np.argsort(-product, axis=1)[:, :32]
    found, fresh = [], []
    for r in graph.df.collect():
        fresh.append(np.frombuffer(r["fresh"], np.int8) > 0)
        ids, near = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["near"], np.int64).reshape(-1, 32)
        found += [len(np.intersect1d(row, truth[i])) / 32 for i, row in zip(ids, near, strict=True)]
    graph.drop()
    assert len(found) == 2500 and np.mean(found) > 0.9, np.mean(found)
    assert np.mean(np.concatenate(fresh)) <= 0.002, np.mean(np.concatenate(fresh))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (4, 5), (9, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)]])
def test_components(spark, edges):
    from kindred.llm.spark import components

    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in edges:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root
