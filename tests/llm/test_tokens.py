"""Operators 1, 4 and 6 against the libraries they stand for."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keystrata.llm import bpe, tokencount, tokenfiles

RANK_FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(RANK_FILE, "rb") as f:
        return bpe.Encoder(bpe.read_ranks(f.read()), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = "aAéß中🎉 \n\t\x1c\x85\xa0'stre.,0١٢ﬁ́x▁<s>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoder_is_the_library(encoder, library, texts):
    for t in [*(t or "" for t in texts), *random_texts(3000)]:
        ids = encoder.encode(t)
        assert ids == library.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_long_texts_in_runs_are_the_library(encoder, library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "RUN_CHARS", 7, raising=False)
    for t in [*(t or "" for t in texts), *random_texts(1000, seed=4)]:
        assert encoder.encode(t) == library.encode_ordinary(t)


def test_new_words_look_at_few_tokens(library):
    """A word that was not seen before costs a few looks for each byte, and not one for each place to its left."""

    class Counting(dict):
        looks = 0

        def get(self, key, default=None):
            self.looks += 1
            return super().get(key, default)

    ranks = Counting(bpe.read_ranks(open(RANK_FILE, "rb").read()))
    encoder, rng = bpe.Encoder(ranks, P.PATTERN), random.Random(5)
    syllables = "ba ter ing lo mi ra sen tion vo ky der un ñe ße 中文 ري".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    assert encoder.encode(" ".join(words)) == library.encode_ordinary(" ".join(words))  # what pairs of tokens fit is known from here on
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(3, 8))) for _ in range(1000)]
    ranks.looks = 0
    assert encoder.encode(" ".join(words)) == library.encode_ordinary(" ".join(words))
    assert ranks.looks < 5 * len(" ".join(words).encode()), ranks.looks / len(" ".join(words).encode())


def test_prefix_table_appends_and_edits(encoder):
    v, rng = encoder.vocabulary, random.Random(8)
    for _ in range(60):
        data = bytes(rng.choice(b"aeths \n\xc3\xa9") for _ in range(rng.randint(0, 300)))
        table = bpe.PrefixTable(v, data[:40])
        table.append(data[40:])
        assert table.tokens() == v.merge(data)
        a = rng.randint(0, len(data))
        b = rng.randint(a, min(len(data), a + 6))
        new = bytes(rng.choice(b"thes ") for _ in range(rng.randint(0, 6)))
        table.replace(a, b, new)
        assert table.tokens() == v.merge(data[:a] + new + data[b:])


def test_edits_recompute_only_nearby(encoder):
    table = bpe.PrefixTable(encoder.vocabulary, b"the quick brown fox jumps over the lazy dog " * 200)
    assert table.replace(100, 101, b"X") < 1000


def test_merges_across_a_border(encoder):
    v, rng = encoder.vocabulary, random.Random(2)
    ids = list(v.bytes_of)
    for _ in range(5000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert v.adjacent(a, b) == (v.merge(v.bytes_of[a] + v.bytes_of[b]) == [a, b])


def test_encode_documents(docs, no_docs, texts, library):
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, RANK_FILE, P.PATTERN, keep_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids"]) == (len(ids), ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(no_docs, RANK_FILE, P.PATTERN).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, no_docs, texts, tmp_path, encoding):
    path = f"file://{tmp_path}/{encoding}"
    name = P.path("word_bpe_49k.json")
    again = docs.union(docs.where("doc_id = 13"))  # a repeated row
    tokenfiles.write_token_files(tokenfiles.encode_documents(tokenfiles.arrange(again, files=3), name, 1), path, encoding)
    got = sorted(tuple(r) for r in tokenfiles.summarize_token_files(spark, path).collect())
    t, expected, start = Tokenizer.from_file(name), [], 0
    for i, text in sorted([*enumerate(texts), (13, texts[13])]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    order = [r["doc_id"] for r in spark.read.parquet(path).select("doc_id").collect()]
    import glob

    import pyarrow.parquet as pq

    files = sorted(glob.glob(f"{tmp_path}/{encoding}/*.parquet"))
    listed = [v for f in files for v in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    assert listed == sorted(listed) and len(order) == len(listed)
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(2)
    assert column.has_offset_index and column.has_column_index
    assert any("DICTIONARY" in e if encoding == "dictionary" else "DELTA" in e for e in column.encodings)
    some = tokenfiles.read_token_files(spark, path, 3, 9, columns=["doc_id", "n_tokens"])
    assert sorted(r["doc_id"] for r in some.collect()) == [3, 4, 5, 6, 7, 8]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "ids" not in plan.split("ReadSchema")[1]
    empty = f"file://{tmp_path}/{encoding}-none"
    tokenfiles.write_token_files(tokenfiles.encode_documents(tokenfiles.arrange(no_docs), name, 1), empty)
    assert tokenfiles.summarize_token_files(spark, empty).count() == 0


def test_a_worker_forgets_what_another_operator_kept(encoder):
    import weakref

    from keystrata.llm import arrowtext

    with open(RANK_FILE, "rb") as f:
        data = f.read()
    kept = weakref.ref(bpe._encoder(data, P.PATTERN))
    assert bpe._encoder(data, P.PATTERN) is kept()
    list(arrowtext.sliced(iter([]), "text", owner="bpe"))
    assert kept() is not None
    list(arrowtext.sliced(iter([]), "text"))
    assert kept() is None


def test_files_follow_the_volume(spark, monkeypatch):
    frame = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), 50).alias("text"))
    assert tokenfiles.arrange(frame).rdd.getNumPartitions() == 1
    monkeypatch.setattr(tokenfiles, "LEAST_FILE_BYTES", 1000)
    assert tokenfiles.arrange(frame).rdd.getNumPartitions() == 4  # as many as shuffle partitions
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 1000)
    assert tokenfiles.arrange(frame).rdd.getNumPartitions() == 8


def test_word_encoder_is_the_library():
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        data = f.read()
    own, t = tokenfiles.WordEncoder(data), Tokenizer.from_buffer(data)
    samples = [*random_texts(3000, 5), "a <|endoftext|> b", "x<|startoftext|>y", "Σίσυφος ΟΔΟΣ", "İstanbul"]
    for s, ids in zip(samples, own.encode_all(samples), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == t.encode(s, add_special_tokens=False).ids


def test_pieces_with_equal_hashes_stay_apart(monkeypatch):
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        own = tokenfiles.WordEncoder(f.read())
    real = tokenfiles.run_hashes
    monkeypatch.setattr(tokenfiles, "run_hashes", lambda *a: real(*a) & np.uint64(7))
    monkeypatch.setattr(tokenfiles, "MEMO_ENTRIES", 6)
    samples = [*random_texts(200, 9), "naïve ŒUVRE ſtart 3×4÷5 İ", "don't 'sound I'LL", "a\tb\x1cc", ""]
    for s in samples:
        assert own.encode(s).tolist() == own.tokenizer.encode(s, add_special_tokens=False).ids
    for s, ids in zip(samples, own.encode_all(samples), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == own.tokenizer.encode(s, add_special_tokens=False).ids


def test_counts_are_the_library(docs, no_docs, texts):
    name = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=name)
    with open(name, "rb") as f:
        counter = tokencount.PieceCounter(f.read())
    samples = [*random_texts(3000, 6), "  ", "   a", "<s></s><unk> <0x0A>", "▁", "\0", "a" * 500 + " " * 300]
    assert counter.counts(samples) == [len(x) for x in sp.encode(samples)]
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs, name, limit=500).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 500)
    assert tokencount.count_tokens(no_docs, name).count() == 0


def test_long_unbroken_texts(monkeypatch):
    name = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=name)
    with open(name, "rb") as f:
        counter = tokencount.PieceCounter(f.read())
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    unbroken = ["".join(rng.choice(letters) for _ in range(20000)), base64.b64encode(rng.randbytes(9000)).decode(), "a" * 30000, "the" * 5000 + "x", " " * 20000 + "b", "".join(rng.choice("中文字符的一是不了人我") for _ in range(3000)), "-" * 5000, "\n" * 3000, "é🎉" * 2000]
    assert counter.counts(unbroken) == [len(x) for x in sp.encode(unbroken)]
    monkeypatch.setattr(tokencount, "CUT_ROUNDS", 2)
    for _ in range(600):
        alphabet = rng.choice(["ab", "aeth", "théñ中x▁", "theandofi", "aaaab", "    a", " -"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 200)))
        assert sum(counter.long_count(p) for p in counter.cut(text)) == len(sp.encode(text))


def test_time_of_unbroken_text_is_near_linear():
    import time

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        counter = tokencount.PieceCounter(f.read())
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    began = time.process_time()
    counter.long_count(text[:100_000])
    short = time.process_time() - began
    counter.long_count(text)
    assert time.process_time() - began - short < 10 * max(short, 0.2)
