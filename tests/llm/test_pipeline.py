"""The pipeline against a plain version of its stages, over a small folder of documents."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import tiktoken
from helpers import documents

import corpus_pipeline
from motionlake.llm import byte_bpe

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rnd = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("lo", "ka", "mi", "tre", "sun", "do") for b in ("ra", "ne", "vi", "po", "lis", "mar", "den", "ut")]
    vocabulary += [f"{v}{k}" for v in vocabulary for k in range(8)]
    passage = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [f"Share this page\n{passage(120)}\n{passage(40)}" for _ in range(20)]  # a site's boilerplate
    texts += ["too short", None, "again and again " * 40, texts[3], texts[4].replace(" ", "  ")]
    near = texts[5].split("\n")
    texts.append("\n".join([near[0], near[1] + " something added", near[2]]))
    item = passage(40)
    texts.append(passage(60) + "\n" + item + "\n" + passage(60))
    return texts, [(1, item), (2, passage(13))]


def brute(texts, items):
    def normal(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()

    def counted(rows):
        pages = {}
        for t in {t for _, t in rows if t is not None}:
            for line in {normal(x) for x in t.split("\n") if WORDS.search(x)}:
                pages[line] = pages.get(line, 0) + 1
        return pages, len({t for _, t in rows if t is not None})

    rows = list(enumerate(texts))
    pages, total = counted(rows)
    kept = []
    for k, t in rows:
        words = WORDS.findall(t or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        repeat = {p for i, w in enumerate(windows) if seen[w] > 1 for p in (i, i + 1, i + 2)}
        gone = sum(len(WORDS.findall(x)) for x in (t or "").split("\n") if WORDS.search(x) and pages.get(normal(x), 0) > max(10, 0.002 * total))
        if len(words) >= 50 and 100 * len(repeat) <= 50 * len(words) and gone < 0.7 * len(words):
            kept.append((k, t))
    pages, total = counted(kept)
    rows = []
    for k, t in kept:
        drop = lambda x: WORDS.search(x) and pages[normal(x)] >= 5 and pages[normal(x)] > 0.01 * total  # noqa: B023, E731
        rows.append((k, "\n".join(x for x in t.split("\n") if not drop(x))))
    one = []
    for k, t in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        if not any(close(w, re.findall(r"[^\W_]+", u.lower())) for _, u in one):
            one.append((k, t))
    windows = set()
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    for _, t in items:
        w = low(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))}
    for k, t in one:
        w = low(t)
        hit = {p for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for p in range(i, i + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            yield k, t


def close(a, b):
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 0.2 * max(len(a), len(b)) + 1e-9


def test_pipeline_equals_the_plain_version(spark, tmp_path):
    texts, items = corpus()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = dict(brute(texts, items))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == set(want) and 15 < len(want) < 22
    ranks = byte_bpe.merges_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, t in want.items():
        assert bytes(found[k].ids) == np.array(library.encode_ordinary(t), dtype="<u4").tobytes()
        assert found[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_are_named_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near copies", "benchmark", "tokens"]


def through(spark, docs, folder):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    return docs


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    rnd = random.Random(5)
    passage = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    good = [passage(80) for _ in range(6)]
    item = passage(40)
    rows = [
        (1, good[0], "en", "s0", 1),
        (1, good[0], "en", "s0", 1),  # a repeated row
        (None, good[1], None, None, None),  # nulls in every column but the text
        (3, None, "en", "s0", 0),
        (4, "", "en", None, 0),
        (5, good[2], "en", None, 5),
        (6, good[2].upper(), "en", "s1", 6),  # a copy
        (7, passage(60) + "\n" + item + "\n" + passage(20), "en", "s1", 7),  # holds a benchmark item
        (8, " ".join(f"w{i}" for i in range(40_000)), "en", "s0", 8),  # very long, of distinct words
        (9, good[3], "en", "s0", 9),
        (9, good[4], "en", "s0", 9),  # two texts of one key
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS id", "2 AS class_id", "'x' AS kept", "3 AS n", "4 AS label", "5 AS spans", "6 AS line")
    spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    found = through(spark, docs, str(tmp_path)).collect()
    # Two texts of a key are one class, so one of them stays; rows without a key stay.
    assert sorted(str(r.doc_id) for r in found) == ["1", "5", "8", "9", "None"]
    assert through(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
