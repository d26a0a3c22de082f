"""The FM-index and the decontamination against brute force."""

import random
import re

import numpy as np
import pytest
from helpers import awkward, documents

from motionlake.llm import decontaminate as D
from motionlake.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = brute_words(text)
        if w and item is not None:
            for i in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    for key, text in docs:
        w, hit, found = brute_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= owners
        yield key, len(w), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_every_place(seed):
    rnd = np.random.default_rng(seed)
    text = rnd.integers(1, 3 + seed, size=800)
    if seed == 3:
        text = np.tile(text[:50], 16)
    full = np.append(text, 0)
    assert suffix_array(full, 9).tolist() == sorted(range(len(full)), key=lambda i: full[i:].tolist())
    index = FMIndex(text, 9)
    phrases = np.zeros((60, 4), dtype=np.int64)
    lengths = rnd.integers(1, 5, size=60)
    for i, n in enumerate(lengths):
        phrases[i, 4 - n :] = rnd.integers(1, 4 + seed, size=n)
    low, high = index.search(phrases, lengths)
    for i, n in enumerate(lengths):
        p = phrases[i, 4 - n :].tolist()
        places = [k for k in range(len(text) - n + 1) if text[k : k + n].tolist() == p]
        assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == places


def corpus(seed, n_docs=60, n_items=25):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "Of", "été", "b2", "x", "straße", "K", "zz9"]) + rnd.choice(["", "a", "b", "é"])
    passage = lambda n: rnd.choice([" ", "\n", ", ", "-"]).join(word() for _ in range(n))
    items = [(k % 20, passage(rnd.choice([1, 5, 12, 13, 14, 40]))) for k in range(n_items)] + [(90, ""), (91, None), (None, "the the"), (10, passage(30))]
    docs = [passage(rnd.randint(0, 120)) for _ in range(n_docs)]
    for i in range(0, n_docs, 3):
        docs[i] += " " + (rnd.choice(items)[1] or "").upper() + "! " + passage(10)
    return docs + docs[:5], items


@pytest.mark.parametrize(("block", "shard"), [(1_000_000, 1_500_000), (30, 200)])
def test_contamination_equals_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    docs, items = corpus(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents(spark, docs).repartition(2)
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    found = D.find_contamination(table, bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == sorted(brute(enumerate(docs), items))
    for r in found:
        cut = " ".join(docs[r.doc_id][s["start"] : s["stop"]] for s in r.spans)
        assert len(brute_words(cut)) == r.n_hit
        assert len(brute_words(D.without_spans(docs[r.doc_id], r.spans))) >= r.n_words - r.n_hit - len(r.spans)


def test_clean_documents_stay(spark):
    docs, items = corpus(8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents(spark, docs)
    gone = {k for k, n, h, _ in brute(enumerate(docs), items) if h and 20 * h >= n}
    kept = D.keep_clean(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - gone


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "word " * 13), (2, "two lines")], "item_id long, text string")
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in D.find_contamination(awkward(spark), bench).collect())
    assert rows == sorted([("1", 0, 0), ("2", 0, 0), ("3", 0, 0), ("4", 60_000, 60_000), ("5", 7, 2), ("5", 7, 2), ("None", 5, 0), ("7", 1, 0)])
    assert D.find_contamination(awkward(spark), bench.limit(0)).where("n_hit > 0").count() == 0
    assert D.find_contamination(awkward(spark).limit(0), bench).count() == 0
    assert D.keep_clean(awkward(spark), bench).count() == 5
