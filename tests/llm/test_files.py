"""Archives, token files and byte-level BPE against the libraries and exact round trips."""

import base64
import hashlib
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from helpers import awkward, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motionlake.llm import byte_bpe, common, token_files, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SAMPLE = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
ODD = "aaabbx \n\t\r\x1c\x1f\x85\xa0　​'sVERéé012٣½#*$%漢字😀\x00<|endoftext|>İΣς"


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 120))) for _ in range(n)] + ["a" * 3000, "\n" * 500, " " * 500, "ab" * 900]


def test_replay_equals_the_library():
    merges = byte_bpe.merges_of(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    texts = [*SAMPLE, *odd_texts(1500, 1), None, ""]
    import regex

    found = byte_bpe.encode_block(texts, merges, regex.compile(public_tokenizers.PATTERN).findall)
    for t, f in zip(texts, found, strict=True):
        assert f == np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes()
        assert merges.decode(np.frombuffer(f, dtype="<u4")) == (t or "").encode()


def test_replay_with_ranks_that_come_up_late():
    letters = [bytes([b]) for b in range(256)]
    ranks = {t: i for i, t in enumerate([*letters, b"bc", b"abc", b"ab", b"cd", b"abcd", b"aa", b"aaa"])}
    ranks[b"abc"], ranks[b"bc"] = ranks[b"bc"], ranks[b"abc"]
    merges = byte_bpe.Merges(ranks)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12))).encode() for _ in range(400)]
    words = list(dict.fromkeys(words))
    ids, offsets = merges.replay(words)
    for i, w in enumerate(words):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == merges.one_word(w), w


def test_encode_and_decode_awkward_rows(spark):
    docs = awkward(spark).withColumn("ids", F.lit("clash"))
    done = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    texts = [r.text for r in docs.collect()]
    assert sorted(bytes(r.decoded) for r in done) == sorted((t or "").encode() for t in texts)
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_words_are_merged_like_the_library():
    merges = byte_bpe.merges_of(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    rnd = random.Random(9)
    for letters, size in (("ab", 3000), ("aeinrst", 3000), ("x", 5000), ("éñß", 2000)):
        word = "".join(rnd.choice(letters) for _ in range(size))
        assert merges.one_word(word.encode()) == library.encode_ordinary(word)
    began = time.perf_counter()
    merges.one_word(("".join(rnd.choice("aeinrst") for _ in range(100_000))).encode())
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("memo", [700_000, 50])
def test_pieces_give_the_library_ids(monkeypatch, memo):
    monkeypatch.setattr(token_files, "MEMO", memo)
    library = Tokenizer.from_file(WORDS)
    texts = [*SAMPLE, *odd_texts(1500, 2), None, "", "a <|ENDOFTEXT|> b", "İ<|EndOfText|>", "x <|endoftext|>. y", "<|startoftext|>"]
    token_files.encode_texts(pa.array(texts[:20]), WORDS)
    ids, counts = token_files.encode_texts(pa.array(texts), WORDS)
    for t, found in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert found.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_a_tokenizer_of_another_shape_gets_whole_texts(tmp_path):
    with open(WORDS, encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"]["normalizers"].pop()  # no lower case
    (tmp_path / "own.json").write_text(json.dumps(told), encoding="utf-8")
    path = str(tmp_path / "own.json")
    assert token_files.splits_at_space(WORDS) and not token_files.splits_at_space(path)
    texts = [*SAMPLE, "A Word in CAPITALS.", None]
    ids, counts = token_files.encode_texts(pa.array(texts), path)
    library = Tokenizer.from_file(path)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_checksum_and_frames():
    assert token_files.crc32c([b"123456789", b"", b"a", b"\x00" * 32])[0] == 0xE3069283
    assert token_files.crc32c([b"", b"\x00" * 32]).tolist() == [0, 0x8A9136AA]
    rnd = random.Random(4)

    def plain(data):
        c, step = 0xFFFFFFFF, token_files.step_table().tolist()
        for b in data:
            c = step[(c ^ b) & 0xFF] ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    parts = [rnd.randbytes(n) for n in (1, 3, 4, 5, 255, 256, 257, 511, 512, 513, 5000)]
    assert token_files.crc32c(parts).tolist() == [plain(p) for p in parts]
    data = b"".join(token_files.frame(parts))
    assert token_files.unframe(data) == parts
    with pytest.raises(ValueError):
        token_files.unframe(data[:20] + bytes([data[20] ^ 1]) + data[21:])


@pytest.mark.parametrize("make", [lambda s: documents(s, [*SAMPLE, *odd_texts(200, 5)]), awkward, lambda s: documents(s, [])])
def test_token_files_round_trip(spark, make):
    docs = make(spark).repartition(3)
    index = token_files.write_tokens(docs, WORDS, common.new_folder(spark, "tokens"), 2)
    found = token_files.read_tokens(index).orderBy("start").collect()
    library, at = Tokenizer.from_file(WORDS), 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in found] == [r.doc_id for r in rows]
    for r, f in zip(rows, found, strict=True):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (f.start, f.n_tokens, f.ids_crc32, bytes(f.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)


PAGES = "page_id long, url string, html string"


def brute_pages(rows):
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    last = {}
    for k, p in payloads:
        if k is not None:
            last[p] = max(k, last.get(p, k))
    twice = [p for _, p in payloads]
    for k, p in payloads:
        refers = last[p] if twice.count(p) > 1 and p in last and k != last[p] else None
        yield k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers


def test_archives_round_trip(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}/{i}\n", ["<p>x</p>", "", None, f"é{i}" * 400][i % 4]) for i in range(40)]
    rows += [(41, None, "y" * 3_000_000), (42, "u", "y" * 3_000_000), (50, "u", "twice"), (50, "u", "twice"), (None, None, "<p>x</p>"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).repartition(3)
    index = warc.archive(pages)
    found = warc.read_archives(index).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=key) == sorted(brute_pages(rows), key=key)
    for r in found:
        if r.record_type == "response":
            assert len(r.payload) == r.payload_bytes
    assert warc.read_archives(warc.archive(pages.limit(0))).count() == 0


def test_bundle_is_plain_zstandard(spark):
    import zstandard

    from motionlake.llm.files import open_file

    index = warc.archive(spark.createDataFrame([(i, "u", "z" * 400_000 + str(i)) for i in range(8)], PAGES).coalesce(1)).collect()
    with open_file(index[0].bundle) as f:
        data, frames = f.readall(), warc.seek_table(f)
    assert len(frames) > 2 and max(r.frame for r in index) == len(frames) - 1
    whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + n], max_output_size=m) for a, n, m in frames)
    assert whole.count(b"WARC/1.1") == 8
    assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little")
