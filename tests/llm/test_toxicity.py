"""The automaton against edit distances of all pairs; held-out accuracy of the score."""

import random
import zlib

import numpy as np
import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from motionlake.llm import queries as Q
from motionlake.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, word, edits):
    word = list(word)
    for _ in range(edits):
        i, kind = rnd.randrange(len(word) + 1), rnd.random()
        if kind < 0.4 and i < len(word):
            word[i] = rnd.choice("abcde")
        elif kind < 0.7:
            word.insert(i, rnd.choice("abcde"))
        elif i < len(word) and len(word) > 1:
            del word[i]
    return "".join(word)


def test_automaton_equals_all_pairs():
    rnd = random.Random(2)
    for _ in range(30):
        terms = {"".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 11))): 1.0 for _ in range(15)}
        lexicon = T.Lexicon(terms, {})
        for _ in range(200):
            word = edited(rnd, rnd.choice(list(terms)), rnd.randint(0, 3))
            near = sorted((d, t) for t in terms if (d := distance(word, t)) <= T.edits_for(len(t)))
            assert lexicon.misspelled(word) == (near[0][1] if near else None)
            if near and near[0][0]:
                assert lexicon.may_match(word)


def test_misspelled_and_quoted_terms():
    reader = T.Reader(T.Lexicon({"moron": 5.0, "worthless": 5.0}, {"scumm": 4.0}))
    plain, wrong, quoted = (reader.features(t) for t in ("you moron, worthless", "you morron, w0rthles worthles", 'he said "you moron" and left'))
    assert plain[0] > 2 and plain[2] == 0 and wrong[2] > 1
    assert quoted[0] == 0 and quoted[1] > 1
    assert reader.features("scummiest")[0] > 1 and reader.features("scum and more") == [0.0] * T.FEATURES
    assert reader.features(None) == reader.features("") == [0.0] * T.FEATURES


def test_misspelled_words_of_a_stem():
    rows = [("moron", True, 90.0, 4.0), *((f"moron{e}", False, 30.0, 3.0) for e in ("ic", "ish", "s"))]
    stems = {t: w for t, stem, w in T.choose_terms(rows, 5.0) if stem}
    assert stems == {"moron": 4.0}
    lexicon = T.Lexicon({}, stems, T.covered_words(rows, stems))
    assert lexicon.match("moronic") == (4.0, False) and lexicon.match("mqronic") == (3.0, True)


def rows_of(seed, n=900):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    bad = ["wretched", "pigheaded", "vermin", "dimwit", "crackbrain"]
    for i in range(n):
        words, toxic = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 80))], int(rnd.random() < 0.2)
        for _ in range(rnd.randint(2, 4) * toxic):
            words[rnd.randrange(len(words))] = edited(rnd, rnd.choice(bad), int(rnd.random() < 0.3))
        if not toxic and rnd.random() < 0.1:
            words.insert(rnd.randrange(len(words)), f'"{rnd.choice(bad)}"')
        yield i, " ".join(words), toxic


def test_distinct_texts_with_a_common_pair_of_words_all_count():
    rnd = random.Random(6)
    low = min(("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(20000)), key=lambda w: zlib.crc32(f"{w} zz".encode()))
    texts = [" ".join([low, "zz", *("".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(40))]) for _ in range(50)]
    assert len({T.signatures(T.tokens_of(t)) for t in texts}) == 50
    assert T.signatures(T.tokens_of(texts[0].upper() + " !")) == T.signatures(T.tokens_of(texts[0]))


def test_every_distinct_text_counts(spark):
    rnd = random.Random(7)
    texts = [" ".join(["common", *("".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(60))]) for _ in range(40)]
    base = [("".join(rnd.choice("stuvw") for _ in range(6))) for _ in range(400)]
    near = [" ".join([*base[:200], "edit" + "abcdef"[k], *base[200:]]) for k in range(6)]
    rows = [(t, 0) for t in texts] + [(texts[0].upper(), 0)] + [(t, 1) for t in near] + [("short", 1), ("brief", 1), ("", 1), (None, 0)]
    read = T.read_words(spark.createDataFrame(rows, "__text string, __toxic int"))
    counts = {r.word: (r.t, r.c) for r in T.word_counts(read).collect()}
    assert counts["common"] == (0, 40)
    groups = len({T.signatures(T.tokens_of(t))[1] for t in near})
    assert groups < 6 and counts[base[0]][0] == pytest.approx(groups) and sum(counts["edit" + c][0] for c in "abcdef") == pytest.approx(groups)
    assert counts["short"] == counts["brief"] == (1, 0)


def test_held_out_accuracy(spark):
    rows = list(rows_of(4))
    docs = documents(spark, [t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    model = T.fit(docs, labels)
    scores = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    held = [(scores[i], t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = sum((s >= T.TOXIC_AT) != t for s, t in held)
    assert wrong <= 0.03 * len(held), (wrong, len(held), model.lexicon.words, model.lexicon.stems)
    assert {r.doc_id for r in docs.where(T.held_out(F.col("doc_id"))).collect()} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}


def test_query_on_the_small_tables(spark):
    rows = Q.queries()["op10_toxicity"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = np.array([(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth])
    assert ((held[:, 0] >= 0.7) == held[:, 1]).mean() > 0.9


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 AS score", "2 AS toxic")
    for labels in ([(4, 1, 1), (5, 0, 0), (5, 1, 1), (None, 1, 1), (7, 0, None), (99, 0, 1)], []):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert T.score(docs, model).where("score BETWEEN 0 AND 1").count() == 8
    assert T.score(docs.limit(0), model).count() == 0


def plain_match(word, lexicon):
    """Weight and whether it is misspelled, by the distances to all terms."""
    if word in lexicon.words:
        return lexicon.words[word], False
    stems = [s for s in lexicon.stems if word.startswith(s) and len(word) > len(s)]
    if stems:
        return lexicon.stems[max(stems, key=len)], False
    near = [(d, t) for t in lexicon.terms if abs(len(t) - len(word)) <= 2 and (d := distance(word, t)) <= T.edits_for(len(t))]
    return (lexicon.terms[min(near)[1]], True) if near else (0.0, False)


def plain_features(text, lexicon, known):
    tokens = T.tokens_of(text)
    quotes = [i for i, w in enumerate(tokens) if w in T.QUOTES]
    hits = []
    for i, w in enumerate(tokens):
        weight, wrong = known.setdefault(w, plain_match(w, lexicon)) if w not in known else known[w]
        if weight:
            before, after = [q for q in quotes if q < i], [q for q in quotes if q > i]
            quoted = len(before) % 2 == 1 and i - before[-1] <= T.QUOTE_REACH and bool(after) and after[0] - i <= T.QUOTE_REACH
            hits.append((i, weight, wrong, quoted))
    if not hits:
        return [0.0] * T.FEATURES
    free = [(i, w, wrong) for i, w, wrong, quoted in hits if not quoted]
    total = sum(w for _, w, _ in free)
    densest = max((sum(w for j, w, _ in free if i <= j < i + T.WINDOW) for i, *_ in hits), default=0.0)
    log = np.log1p
    return [
        log(total), log(sum(w for _, w, _, quoted in hits if quoted)), log(sum(w for _, w, wrong in free if wrong)), total / (len(tokens) + 20), log(densest), float(any(w > 0 for _, w, _ in free)),
        max((w for _, w, wrong in free if not wrong), default=0.0),
    ]


def test_query_equals_plain_features_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = Q.table(spark, sf, "documents"), Q.table(spark, sf, "labels")
    model = T.fit(docs, labels)
    assert model.lexicon.terms and model.weights
    rows, known = docs.collect(), {}
    x = np.array([plain_features(r.text, model.lexicon, known) for r in rows])
    assert (x.sum(axis=1) > 0).sum() > 10
    z = ((x - model.mean) / model.scale) @ np.array(model.weights) + model.bias
    want = {r.doc_id: s for r, s in zip(rows, 1 / (1 + np.exp(-np.clip(z, -30, 30))), strict=True)}
    got = Q.op10_toxicity(spark, sf).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    # The regression is at its optimum: no slope is left but the penalty's.
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    train = [k for k, r in enumerate(rows) if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    y = np.array([truth[rows[k].doc_id] for k in train], dtype=float)
    slope = ((x[train] - model.mean) / model.scale).T @ (y - np.array([want[rows[k].doc_id] for k in train])) - np.array(model.weights)
    assert np.abs(slope).max() < 1e-4


def test_ties():
    lexicon = T.Lexicon({"abcdef": 1.0, "abcdeg": 9.0, "abcde": 4.0}, {})
    assert lexicon.misspelled("abcdeh") == "abcde" and lexicon.match("abcdeh") == (4.0, True)  # equally near: the first in order
    assert T.Lexicon({"abcdeg": 9.0, "abcdef": 1.0}, {}).match("abcdeh") == (1.0, True)
    rows = [("bbbb", False, 50.0, 2.0), ("aaaa", False, 50.0, 3.0), ("cccc", True, 50.0, 1.0)]
    assert T.choose_terms(rows, 10.0) == T.choose_terms(rows[::-1], 10.0)
