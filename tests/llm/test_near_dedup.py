"""Near-duplicate classes against all pairs, alignment against the full table."""

import random

import numpy as np
import pytest
from helpers import awkward, documents

from motionlake.llm import near_dedup as N
from motionlake.llm import order_minhash as O


def full_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        i, kind = rnd.randrange(len(words) + 1), rnd.random()
        if kind < 0.4 and i < len(words):
            words[i] = rnd.choice(vocabulary)
        elif kind < 0.7:
            words.insert(i, rnd.choice(vocabulary))
        elif i < len(words) and len(words) > 1:
            del words[i]
    return words


def test_banded_alignment_equals_the_full_table():
    rnd = random.Random(1)
    for _ in range(1500):
        vocabulary = list(range(rnd.choice([2, 5, 30])))
        a = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))]
        b = edited(rnd, a, rnd.randint(0, 8), vocabulary) if rnd.random() < 0.9 else [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        limit, d = rnd.randint(0, 12), full_distance(a, b)
        assert O.edit_distance(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), limit) == (d if d <= limit else None)


def test_sketches_keep_text_order_and_occurrences():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**40, size=300)
    moved = np.concatenate([a[150:], a[:150]])
    sizes = np.array([300, 300, 300, 0, 3])
    found = O.sketch(np.concatenate([a, a, moved, a[:3]]), sizes)
    assert (found[0] == found[1]).all()
    assert 0 < (found[0] == found[2]).sum() < O.SKETCHES * 0.3  # the same shingles, mostly in another order
    labelled, counts = O.shingles(np.array([7] * 20), np.array([20]))
    assert counts.tolist() == [16] and len(set(labelled.tolist())) == 16


def brute_classes(texts, similarity=0.8):
    import re

    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            if a and b and min(len(a), len(b)) >= similarity * max(len(a), len(b)) and full_distance(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "small"), [(1, 16), (2, 2)])
def test_classes_equal_all_pairs(spark, monkeypatch, seed, small):
    monkeypatch.setattr(N, "SMALL", small)
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 30, 90, 140]))]
        for k in range(rnd.choice([1, 2, 5])):
            texts.append(" ".join(edited(rnd, base, round(k * 0.012 * len(base)), vocabulary)))
    for _ in range(40):  # texts that have only a passage in common
        texts.append(" ".join([*passage, *(rnd.choice(vocabulary) for _ in range(70))]))
    texts += texts[:6] + [texts[0].upper() + "!"] * 30
    rnd.shuffle(texts)
    found = {r.doc_id: r.class_id for r in N.classes(documents(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def links_of(spark, texts, sketches):
    """Links between texts that have sketches of our own."""
    docs = documents(spark, texts)
    given = spark.createDataFrame(list(enumerate(sketches)), "id long, sketch array<long>")
    reps = N.sketches(docs, "text", "doc_id").drop("sketch").join(given, "id")
    return {(r.a, r.b) for r in N.linked(docs, reps, "text", "doc_id", 0.8, tell=True)[0].collect()}


def strangers_and_a_pair(strangers):
    """Texts of ten words without common ones, and two more that are one edit apart."""
    texts = [" ".join(f"s{i}w{k}" for k in range(10)) for i in range(strangers)]
    return [*texts, "a b c d e f g h i j", "a b c d x f g h i j"]


def test_one_common_sketch_is_enough_beside_a_bystander(spark):
    assert links_of(spark, strangers_and_a_pair(1), [[100, 1], [100, 2], [100, 3]]) == {(1, 2)}


def test_texts_at_the_threshold_share_a_sketch():
    rnd = random.Random(8)
    for size, share in [(8, 0.125), (12, 0.09), (20, 0.2), (38, 0.2), (60, 0.1), (200, 0.05), (200, 0.1), (200, 0.15), (200, 0.2)]:
        found = 0
        for _ in range(60):
            a = [rnd.randrange(2**40) for _ in range(size)]
            b = list(a)
            for i in rnd.sample(range(size), int(share * size)):
                b[i] = rnd.randrange(2**40)
            rows, counts = O.sketch_lists(np.array(a + b, dtype=np.int64), np.array([size, size]))
            found += bool(set(rows[: counts[0]].tolist()) & set(rows[counts[0] :].tolist()))
        assert found >= 59, (size, share, found)


def test_recall_at_all_similarities_beside_a_hot_group(spark):
    """Planted pairs at 0.80 to 0.95, a third of all rows near copies of one text, and a passage that many rows share."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    passage, hot = [word() for _ in range(40)], [word() for _ in range(120)]
    texts, pairs = [], []
    for share in (0.05, 0.1, 0.15, 0.2):
        for size in (20, 60, 100, 160):
            for _ in range(8):
                a = [word() for _ in range(size)]
                b = list(a)
                for i in rnd.sample(range(size), int(share * size)):
                    b[i] = word()
                pairs.append((share, len(texts), len(texts) + 1))
                texts += [" ".join(a), " ".join(b)]
    for k in range(len(texts) // 2):
        texts.append(" ".join(w if rnd.random() > 0.02 else word() for w in hot))
        if k % 4 == 0:
            texts.append(" ".join([*passage, *(word() for _ in range(60))]))
    found = {r.doc_id: r.class_id for r in N.classes(documents(spark, texts)).collect()}
    for share in (0.05, 0.1, 0.15, 0.2):
        mine = [found[a] == found[b] for s, a, b in pairs if s == share]
        assert sum(mine) >= 0.9 * len(mine), (share, sum(mine), len(mine))
    first = 2 * len(pairs)
    group = {found[i] for i in range(first, len(texts)) if not texts[i].startswith(passage[0])}
    assert len(group) == 1  # one class
    assert sum(found[i] != i for i in range(first) if i % 2 == 0) == 0  # strangers stay apart


def test_the_bag_bound_is_never_above_the_edits():
    rnd = random.Random(3)
    for _ in range(300):
        vocabulary = list(range(rnd.choice([2, 30, 500])))
        a = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 30, 700]))]
        b = edited(rnd, a, d := rnd.randint(0, 8), vocabulary)
        x, y = O.bags(np.array(a + b, dtype=np.int64), np.array([len(a), len(b)]))
        assert O.bag_edits(x, y) <= d


def test_one_common_sketch_is_enough_in_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8, raising=False)
    texts = strangers_and_a_pair(30)
    assert links_of(spark, texts, [[100, i] for i in range(len(texts))]) == {(30, 31)}


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 AS id", "2 AS class_id", "3 AS n")
    found = sorted((str(r.doc_id), str(r.class_id), r.n_rows) for r in N.classes(docs).collect())
    assert found == sorted([("1", "1", 1), ("2", "2", 1), ("3", "3", 1), ("4", "4", 1), ("5", "5", 2), ("5", "5", 2), ("None", "None", 1), ("7", "7", 1)])
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert N.classes(docs.limit(0)).count() == 0
    assert N.keep_one(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    texts = ["a b c d e f g h i j"] * 3 + ["a b c d e f g h i x", "something else that stands alone here", "", None]
    kept = N.keep_one(documents(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 4, 5, 6]
