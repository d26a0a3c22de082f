"""Spelling variants: the whole query against all pairs of words, hand-made words, keys, awkward rows."""

import random
import re
import zlib
from collections import Counter

from helpers import awkward, documents
from pyspark.sql import functions as F

from motionlake.llm import queries as Q
from motionlake.llm import spelling as S

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    """All pairs of words, of those that share what a word is without one of its letters."""
    meet = {}
    for w in counts:
        for cut in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            meet.setdefault(cut, set()).add(w)
    near = {w: set() for w in counts}
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_apart(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = Q.queries()["op11_spelling_variants"](spark, SF)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in found.collect()) == plain_variants(plain_words((r.doc_id, r.text) for r in docs.collect()))


def test_few_letters_make_many_near_words(spark):
    """Runs of one letter, anagrams, letters beyond ASCII: pairs that meet in several ways."""
    draw = random.Random(3)
    pool = ["".join(draw.choice("abé") for _ in range(draw.randrange(5, 9))) for _ in range(1_500)] + ["a" * k for k in range(5, 12)]
    docs = documents(spark, [" ".join(draw.choice(pool) for _ in range(60)).replace("a", draw.choice("aA")) for _ in range(400)])
    counts = plain_words((r.doc_id, r.text) for r in docs.collect())
    found = sorted(tuple(r) for r in S.variants(docs).collect())
    assert found == plain_variants(counts) and len(found) > 1_000
    assert max(r[4] for r in found) > 10 and any(r[2] not in (r[0], r[1]) for r in found)


def test_letters_and_counts(spark):
    texts = ["Straße ×houses÷ houses, HOUSES hoUSES x2houses"] * 2 + ["Äpfel äpfel " * 3, None, ""]
    counts = {r.word: r.n for r in S.word_counts(documents(spark, texts), S.Spelling(damage=10**12)).collect()}
    assert counts == {"houses": 8, "Äpfel": 3, "äpfel": 3}


def test_ties_go_to_the_smallest_word_and_chains_to_their_end(spark):
    sizes = {"carts": 3, "darts": 12, "parts": 12, "dartsy": 40, "dartsyz": 100, "other": 5}
    words = spark.createDataFrame(list(sizes.items()), "word string, n long")
    forms = S.forms_of(words)
    rows = {r.word: r for r in forms.collect()}
    assert rows["carts"].form == "darts" and rows["carts"].n_near == 2 and rows["darts"].form == "dartsy" and rows["parts"].form is None
    assert {r.word: r.root for r in S.roots_of(forms).collect()} == {"carts": "dartsyz", "darts": "dartsyz", "dartsy": "dartsyz"}


def test_anagrams_share_a_key(spark):
    keys = [r[0] for r in spark.createDataFrame([("stone",), ("notes",), ("tonesé",), ("x" * 100_000,)], "word string").select(S.anagram_key(F.col("word"))).collect()]
    assert keys[0] == keys[1] == sum(ord(c) ** 5 for c in "stone") and keys[2] == keys[0] + ord("é") ** 5
    assert keys[3] == 100_000 * ord("x") ** 5 % S.PRIME


def test_awkward_rows(spark):
    docs = awkward(spark).unionAll(awkward(spark)).unionAll(awkward(spark)).withColumns({c: F.lit("w") for c in ("word", "run", "key", "n")})
    docs = docs.unionAll(docs.where("doc_id = 7").withColumn("text", F.concat("text", F.lit("y"))).limit(3))
    found = sorted(tuple(r) for r in S.variants(docs).collect())
    assert found == plain_variants(plain_words((r.doc_id, r.text) for r in docs.collect())) and len(found) >= 4
    assert S.variants(docs.limit(0)).count() == 0


def test_words_are_never_broadcast(spark):
    """Files of words are small beside their records, so Spark would send those through the driver by their size."""
    words = S.written(spark.createDataFrame([("carts", 9), ("darts", 20)], "word string, n long"), "few")
    for df in (S.near_pairs(words), S.forms_of(words)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
