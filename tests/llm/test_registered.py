"""Every registered corpus query that SQL cannot express, run as it is registered, against its contract."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: entry.queries()[name](spark, sf_dir)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "", r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def byte_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(run, documents, byte_bpe):
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run("op1_byte_bpe").collect())
    ids = [byte_bpe.encode_ordinary(t) for _, t, _ in documents]
    assert got == sorted((d, len(i), sha(",".join(map(str, i)).encode()), sha(t.encode())) for (d, t, _), i in zip(documents, ids, strict=True))


def test_op2(spark, sf_dir, run):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = run("op2_url_filter").collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    actions = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    for r in got:
        fits = [x for x in actions if (lambda h, p: (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith("/" + p))(*x.split("/", 1))]
        assert r["rule"] == max(fits, key=len, default=None)
        assert r["verdict"] == actions.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")
    assert any(r["rule"] is None for r in got) and any(r["rule"] for r in got)


def test_op4(run, documents):
    t, expected, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), [], 0
    for d, text, _ in documents:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run("op4_token_files").collect()) == expected


def test_op5(run, documents):
    got = {r["doc_id"]: r for r in run("op5_media").collect()}
    assert len(got) == len(documents)
    by_text = {}
    for d, text, _ in documents:
        data, r = text.encode(), got[d]
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), sha(padded), zlib.crc32(padded[-64:]))
        assert by_text.setdefault(text, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_op6(run, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counts = [len(x) for x in sp.encode([t for _, t, _ in documents])]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run("op6_token_counts").collect()) == sorted((d, len(t.encode()), n, n > 4096) for (d, t, _), n in zip(documents, counts, strict=True))


def test_op7(run, documents):
    got = {r["doc_id"]: r for r in run("op7_language_id").collect()}
    known = {lang for d, _, lang in documents if lang is not None and fold(d, 4) != 2}
    assert len(got) == len(documents)
    for d, text, _ in documents:
        assert got[d]["held_out"] == (fold(d, 4) == 2) and 0 <= got[d]["score"] <= 1
        assert got[d]["lang_pred"] in known if any(map(str.isalpha, text)) else got[d]["lang_pred"] == "und"
    held = [(got[d]["lang_pred"], lang) for d, text, lang in documents if fold(d, 4) == 2 and lang is not None and any(map(str.isalpha, text))]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_op10(spark, sf_dir, run, documents):
    got = {r["doc_id"]: r for r in run("op10_toxicity").collect()}
    assert len(got) == len(documents)
    for d, _, _ in documents:
        assert got[d]["held_out"] == (fold(d, 5) == 0) and 0 <= got[d]["score"] <= 1 and got[d]["predicted"] == int(got[d]["score"] >= 0.5)
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["doc_id"] in got and fold(r["doc_id"], 5) == 0]
    assert sum(got[d]["predicted"] == y for d, y in labels) >= 0.85 * len(labels)


def test_pipeline(run, documents, byte_bpe):
    rows = {r["doc_id"]: r for r in run("pipeline").collect()}
    texts = {d: t for d, t, _ in documents}
    assert 0 < len(rows) < len(texts) and set(rows) <= set(texts)
    for r in rows.values():
        decoded = byte_bpe.decode_bytes(r["ids"])
        assert len(r["ids"]) == r["n_tokens"] and r["decoded_sha256"] == sha(decoded)
        if "[" not in decoded.decode():  # nothing masked
            assert decoded.decode() == texts[r["doc_id"]]
