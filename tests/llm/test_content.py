"""Operators 2, 5, 7, 9, 10 and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keystrata.llm import langid, media, pii, toxicity, urlfilter
from keystrata.llm.idfilter import keep_likely

RULES = [urlfilter.Rule("block", "com/en/"), urlfilter.Rule("allow", "example.com/en/7"), urlfilter.Rule("allow", "net/de/"), urlfilter.Rule("block", "example.net/de/8"), urlfilter.Rule("block", "org/es/")]
URLS = [None, "", "no scheme", "http://", "http://Example.COM/en/75?x=/de/#y", "https://a.example.com/en/8", "http://example.net/de/81", "http://x.example.net/de/1", "http://notcom/en/1", "http://com/en/", "ftp://b.org/es/#top", "http://b.org/ES/", "x://y://z/en/", "http://u:p@h.org:80/es/a", "http://a.com\n/en/1"]


def test_rules_and_parts(spark):
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge(frame, RULES, urlfilter.fit(frame, RULES)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.rule), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.rule)
        assert got[i]["verdict"] == (best.action if best else got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert urlfilter.judge(frame.limit(0), RULES, urlfilter.fit(frame.limit(0), RULES)).count() == 0


def test_models_tell_unruled_urls_apart(spark):
    rng = random.Random(1)
    name = lambda s: "".join(rng.choice(s) for _ in range(9))
    rows = [f"http://good.org/{name('aeiou')}" for _ in range(300)] + [f"http://bad.org/{name('xzqwk')}" for _ in range(300)]
    rules = [urlfilter.Rule("allow", "good.org/"), urlfilter.Rule("block", "bad.org/")]
    new = [f"http://other.org/{name('aeiou')}" for _ in range(50)] + [f"http://other.org/{name('xzqwk')}" for _ in range(50)]
    frame = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    asked = spark.createDataFrame(list(enumerate(new)), "page_id bigint, url string")
    got = [r["verdict"] for r in urlfilter.judge(asked, rules, urlfilter.fit(frame, rules)).orderBy("page_id").collect()]
    assert got[:50].count("allow") >= 48 and got[50:].count("block") >= 48


def test_whole_urls_are_judged(spark):
    rng = random.Random(2)
    name = lambda s: "".join(rng.choice(s) for _ in range(9))
    rows = [f"http://good.org/a?q={name('aeiou')}" for _ in range(300)] + [f"http://bad.org/a?q={name('xzqwk')}" for _ in range(300)]
    rules = [urlfilter.Rule("allow", "good.org/"), urlfilter.Rule("block", "bad.org/")]
    new = [f"http://other.org/a{mark}{name(s)}" for s in ("aeiou", "xzqwk") for mark in ("?q=", "#") for _ in range(20)] + ["www.x/aeiouaeiou", "www.x/xzqwkxzqwk", None]
    frame, asked = (spark.createDataFrame(list(enumerate(x)), "page_id bigint, url string") for x in (rows, new))
    got = urlfilter.judge(asked, rules, urlfilter.fit(frame, rules)).orderBy("page_id").collect()
    verdicts = [r["verdict"] for r in got]
    assert verdicts[:40].count("allow") >= 38 and verdicts[40:80].count("block") >= 38
    assert got[80]["score"] > got[81]["score"] and len({r["score"] for r in got[80:]}) == 3 and all((r["host"], r["path"]) == ("", "") for r in got[80:])


def test_rare_contexts_are_kept(spark, monkeypatch):
    rng = random.Random(7)
    rows = [f"http://{host}.org/{rng.randint(0, 10**6)}" for _ in range(2500) for host in ("good", "bad")]
    rows += ["http://good.org/zq"] * 3 + ["http://bad.org/qz"] * 3  # fewer than 1 in 20,000 characters
    rules = [urlfilter.Rule("allow", "good.org/"), urlfilter.Rule("block", "bad.org/")]
    new = ["http://x.org/zq", "http://x.org/qz", "http://x.org/é7", "", None, "http://x.org/zq", "http://good.org/1"]
    frame, asked = (spark.createDataFrame(list(enumerate(x)), "page_id bigint, url string") for x in (rows, new))
    plain = []
    for kind in ("good", "bad"):
        contexts = {}
        for u in rows:
            padded = b"\x02" * 5 + u.encode() + b"\x03"
            for i in range(5, len(padded) if f"/{kind}." in u else 0):
                for k in range(6):
                    after = contexts.setdefault(padded[i - k : i], {})
                    after[padded[i]] = after.get(padded[i], 0) + 1
        plain.append(urlfilter.Markov({c: (sum(after.values()), after) for c, after in contexts.items()}))
    expected = [(plain[0].log_likelihood(u) - plain[1].log_likelihood(u)) / (len(u) + 1) for u in ((u or "").encode() for u in new)]
    for share in (urlfilter.FREQUENT_SHARE, 30):
        monkeypatch.setattr(urlfilter, "FREQUENT_SHARE", share)
        got = [r["score"] for r in urlfilter.judge(asked, rules, urlfilter.fit(frame, rules)).orderBy("page_id").collect()]
        assert got == pytest.approx(expected, abs=1e-6) and got[0] == got[5]


def test_model_is_a_distribution():
    m = urlfilter.Markov({b"": (4, {97: 3, 98: 1}), b"a": (2, {98: 2})})
    for context in (b"", b"a", b"b", b"zza"):
        assert abs(sum(m._probability(context, s) for s in range(256)) - 1) < 1e-9


def test_calibration_takes_the_middle_of_the_best():
    assert urlfilter.calibrate({-10: (0, 5), 10: (5, 0)}) == 0.005 * 1 or abs(urlfilter.calibrate({-10: (0, 5), 10: (5, 0)})) < 0.02
    assert urlfilter.calibrate({3: (5, 0)}) == 0.0


def test_media_round_trip(spark, docs, no_docs, texts):
    rows = list(enumerate(texts)) + [(11, texts[11])]
    frame = docs.union(docs.where("doc_id = 11"))
    got = media.round_trip(frame).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    by_text = {}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(padded) + 44)
        assert by_text.setdefault(data, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert media.round_trip(no_docs).count() == 0


def test_cuts_follow_content_and_chunks_are_stored_once(spark, tmp_path):
    rng = random.Random(3)
    body = bytes(rng.randrange(256) for _ in range(60000))
    shifted = b"inserted" + body
    chunk = lambda data: {data[a:b] for a, b in zip([0, *media.cut(data)], media.cut(data), strict=False)}
    assert len(chunk(body) & chunk(shifted)) >= len(chunk(body)) - 3
    sizes = [b - a for a, b in zip([0, *media.cut(body)], media.cut(body), strict=False)]
    assert sum(sizes) == len(body) and max(sizes) <= media.MOST and min(sizes[:-1]) >= media.LEAST
    assert media.cut(bytes(50000))[-1] == 50000
    text = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(9000))
    frame = spark.createDataFrame([(i, text + f" {i}") for i in range(6)], "doc_id bigint, text string")
    path = f"file://{tmp_path}/store"
    media.write_store(frame, path)
    stored = spark.read.parquet(f"{path}/chunks")
    assert stored.count() == stored.select("digest").distinct().count()
    assert spark.read.parquet(f"{path}/files").select(F.sum(F.size("own"))).first()[0] <= 12


def test_damage_is_found(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    media.write_store(docs, path)
    import shutil

    shutil.rmtree(f"{tmp_path}/store/chunks")
    (tmp_path / "store" / "chunks").mkdir()
    with pytest.raises(Exception, match="lost"):
        media.read_store(spark, path).collect()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def base_spans(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m.group())]


PERSONAL = [
    "Mail a@b.co_d@e.fg and x.y+z@sub-1.example.org. Not a@b, not @c.d, a@b..c, é@f.gh",
    "ips 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3 999.1.2.3.4 10.0.0.255x",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 5 12345678901234567890123",
    "call +1 (555) 123-4567 or +49-30-1234567. +12 +1234567890123456 ++4930123456 +1 ( ) 2",
    "🎉é account DE89370400440532013000 and DE89 3704 0044 0532 0130 00 AND DE00370400440532013000",
    "+4111111111111111 4111111111111111@x.yz 1.2.3.4@5.6.7.8",
    "a" * 20000 + "@" + "b" * 20000, "1" * 30000, "a@" + "a." * 20000 + "a", "+" + "1 " * 20000, "1.2.3.4 " * 300,
]


def test_spans_equal_plain_expressions(spark, docs, texts):
    rng = random.Random(6)
    random_ones = ["".join(rng.choice("ab1 9.@+-_()éé4") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    every = [*texts, *PERSONAL, *random_ones]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(every)], "doc_id bigint, text string, pii_spans string").repartition(4)
    got = {r["doc_id"]: r for r in pii.report(frame).collect()}
    for i, t in enumerate(every):
        spans = base_spans(t)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE], t
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert got[i]["spans"].startswith(text)
    accounts = got[every.index(PERSONAL[4])]
    assert accounts["n_iban"] == 2 and accounts["top_score"] == 1.0


def test_context_words_decide(spark):
    rows = ["my account: 123456789012", "give 123456789012 to them", "123456789012 is the ACCOUNT", "accounts 123456789012 subaccount", "account" + " x" * 30 + " 12345678", "account 1234567 and 1234567890123 and a12345678", "ship 1.2.3.4", "ip 1.2.3.4", "1.2.3.4 hosts", "1.2.3.4 (host)"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = [(r["n_account"], r["spans"], r["top_score"]) for r in pii.report(frame).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == [1, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    assert got[0][1] == "account:12:24" and got[1][1] == "" and got[0][2] == pytest.approx(0.6)
    assert [g[2] for g in got[6:]] == pytest.approx([0.5, 0.8, 0.5, 0.8])
    assert pii.mask(frame).orderBy("doc_id").first()["text"] == "my account: [account]"


def test_masking_keeps_columns_of_any_name(spark):
    names = ["pii_spans", "pii_spans__card_m", "pii_card_m", "PII", "spans", "_spans", "e", "s"]
    frame = spark.createDataFrame([(1, "mail a@b.co", *names)], ["doc_id", "text", *names])
    out = pii.mask(frame)
    assert out.columns == frame.columns and tuple(out.first())[1:] == ("mail [email]", *names)


def test_masking(spark):
    frame = spark.createDataFrame([(0, "é write to a.b@c.de now +49 30 1234567"), (1, None), (2, ""), (3, "4111111111111111@x.yz!")], "doc_id bigint, text string")
    got = [r["text"] for r in pii.mask(frame).orderBy("doc_id").collect()]
    assert got == ["é write to [email] now [phone]", None, "", got[3]] and got[3].endswith("]!") and "4111" not in got[3]


def fold(n):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def test_languages_learnt_and_held_out(spark, docs, no_docs):
    rng = random.Random(4)
    syllables = {"en": "the th wh ing ed sh", "de": "sch ung ich ein keit", "fr": "eau ou que le ré", "es": "ción ado el ñ los"}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang].split(), k=2)) for _ in range(30)), lang) for i in range(240) for lang in [list(syllables)[i % 4]]]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(frame, usable=fold(4) != 2)
    got = langid.predict(frame.where(fold(4) == 2), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    edge = langid.predict(docs, model)
    assert edge.columns == [*[c for c in docs.columns if c not in ("lang_pred", "score")], "lang_pred", "score"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in edge.collect()}
    assert [found[i] for i in (0, 1, 2, 16)] == [("und", 0.0)] * 4 and found[3][0] in syllables
    assert langid.predict(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(no_docs)).collect()} == {"und"}
    one = langid.fit(frame.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in langid.predict(frame, one).collect()} == {"fr"}


def test_no_language_is_left_out_in_silence(spark):
    frame = spark.createDataFrame([(i, "some text", f"a{i:03}") for i in range(langid.MAX_LANGUAGES + 1)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="more than"):
        langid.fit(frame)


def test_toxicity_learnt_and_held_out(spark, docs, no_docs):
    rng = random.Random(5)
    plain = [f"word{rng.randint(0, 300)}" for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(plain, k=rng.randint(5, 200))
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["nastygrams", "nastyish", "Nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    frame, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (1, None), (2, 7), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame, marks, usable=fold(5) != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(frame.where(fold(5) == 0), model).collect()}
    right = sum((s >= 0.5) == bool(labels[i][1]) for i, s in got.items())
    assert right >= 0.97 * len(got) and all(0 <= s <= 1 for s in got.values())
    edge = toxicity.score_documents(docs, model)
    assert edge.count() == docs.count() and edge.where("score is null").count() == 0
    assert toxicity.score_documents(no_docs, model).count() == 0
    for some in (marks.limit(0), marks.where("toxic = 1"), marks.where("doc_id = 9999")):
        assert toxicity.score_documents(docs, toxicity.fit(docs, some)).where("score between 0 and 1").count() == docs.count()


def test_toxicity_learns_what_few_of_many_toxic_texts_have(spark):
    rng = random.Random(8)
    plain = [f"word{rng.randint(0, 300)}" for _ in range(400)]
    text = lambda *more: " ".join([*rng.choices(plain, k=20), *more, *rng.choices(plain, k=20)])
    toxic = [text("zorkblat") for _ in range(6)] + [text("nasty") for _ in range(294)]
    rows = list(enumerate(toxic + [text() for _ in range(900)]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(frame, spark.createDataFrame([(i, int(i < 300)) for i, _ in rows], "doc_id bigint, toxic int"))
    asked = [text("zorkblat") for _ in range(20)] + [text() for _ in range(20)]
    got = [r["score"] >= 0.5 for r in toxicity.score_documents(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()]
    assert sum(got[:20]) >= 18 and sum(got[20:]) <= 1


def test_likely_keys_keep_all_that_are_asked_for(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    asked = spark.range(0, 5000, 50)
    got = {r["k"] for r in keep_likely(rows, asked, "k").collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 600
    assert keep_likely(rows, asked.limit(0), "k").count() == 0


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_stages(spark, pipeline, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    assert pii.report(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == counts[-1] and [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory, texts, passage):
    """Documents with nulls, repeated rows and ids, and clashing columns; few labels; a small benchmark."""
    folder = f"file://{tmp_path_factory.mktemp('edge')}"
    rows = [*enumerate(texts), (None, "no id at all"), (None, "no id at all"), (None, None), (50, "one text of fifty here"), (50, "quite another of the same id"), (51, "repeated row of words"), (51, "repeated row of words")]
    rows += [(60, f"mail x@y.zz and {passage[:40]}"), (61, "bad " * 30)]
    names = "lang string, source string, n_chars bigint, pii_spans string, __bucket int, toxicity__score string, doubtful int, score string, likely int, spans int"
    spark.createDataFrame([(i, t, None, "s", 3, "p", 1, "t", 2, "s", 3, 4) for i, t in rows], "doc_id bigint, text string, " + names).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(3, 0), (None, 1), (7, None)], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, "three word item"), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_pipeline_stages_on_edge_rows(spark, pipeline, edge_dir, tmp_path):
    from tests.llm.test_matching import brute_components, brute_hits

    folder, rows = edge_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = sorted(rows, key=repr)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
        if name == "toxicity":  # two labels that count, of one class: no evidence
            assert got == kept
        elif name == "near_duplicates":
            least = {i: c for i, _, c in brute_components([r for r in kept if r[0] is not None])}
            kept = sorted(set(r for r in kept if r[0] is None or least[r[0]] == r[0]), key=repr)
            assert got == kept
        elif name == "decontamination":
            with_passage = {r for r in kept if brute_hits([r], [(1, dict(rows)[14])])[0][-1]}
            assert with_passage
            kept = [r for r in kept if r not in with_passage]
            assert got == kept
        else:
            masked = dict(got)[60]
            assert len(got) == len(kept) and masked.startswith("mail [email] and") and [r for r in got if r[0] != 60] == [r for r in kept if r[0] != 60]
    tokens = pipeline.STAGES[-1][1](spark, docs, folder)
    assert tokens.count() == len(kept)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/none/{t}.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_scores_equal_sums_of_weights_in_plain_python(spark, sf_dir):
    """The margins of toxicity and language machines of held-out rows, recomputed character by character."""
    import math

    from keystrata.llm.ngrams import _CODES

    codes, mask = [int(c) for c in _CODES], 0xFFFFFFFF

    def grams(text, sizes, bits):
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        for n in sizes:
            for i in range(len(data) - n + 1):
                h = 0
                for b in data[i : i + n]:
                    h = (h * 0x9E3779B1 + codes[b]) & mask
                yield (((h ^ (h >> 15)) * 0x85EBCA6B) & mask) >> (32 - bits)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = docs.where((fold(5) == 0) & (F.length("text") < 3000)).limit(25).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=fold(5) != 0)
    assert model.weights.any()
    for r in toxicity.score_documents(held, model).collect():
        z = model.bias + sum(float(model.weights[g]) for g in set(grams(r["text"], toxicity.SIZES, toxicity.BITS)))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-4)
    machines = langid.fit(docs, usable=fold(4) != 2)
    for r in langid.predict(held, machines).collect():
        found = list(grams(r["text"], langid.SIZES, langid.BITS))
        margin = {p: sum(float(machines.weights[g, k]) for g in found) / max(1, len(found)) + float(machines.bias[k]) for k, p in enumerate(machines.pairs)}

        def winner(names, margin=margin):
            votes = {n: sum((m > 0) == (p[0] == n) for p, m in margin.items() if n in p and set(p) <= set(names)) for n in names}
            sums = {n: sum((1 if p[0] == n else -1) * math.tanh(m) for p, m in margin.items() if n in p and set(p) <= set(names)) for n in names}
            return max(names, key=lambda n: (votes[n], sums[n]))

        expected = winner(machines.languages[winner(machines.families)]) if any(map(str.isalpha, r["text"] or "")) else "und"
        assert r["lang_pred"] == expected


def test_long_texts_are_scored_as_they_would_be_in_one_piece(spark, monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "Gamma", "été"]) + str(rng.randint(0, 50)) for _ in range(3000))
    model = toxicity.Model(np.random.default_rng(3).normal(0, 0.01, 1 << toxicity.BITS).astype(np.float32), 0.1)
    frame = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    whole = [r["score"] for r in toxicity.score_documents(frame, model).orderBy("doc_id").collect()]
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["t"])
    one = toxicity._presence(batch, 0, None)
    monkeypatch.setattr(toxicity, "SLICE", 500)
    assert np.array_equal(toxicity._presence(batch, 0, None), one)
    assert len(whole) == 2


def test_a_model_without_evidence_rejects_nothing(spark, pipeline, docs, tmp_path):
    for i, rows in enumerate(([], [(1, 1)], [(9999, 0)])):
        spark.createDataFrame(rows, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/{i}/labels.parquet")
        assert pipeline.drop_toxic(spark, docs, f"{tmp_path}/{i}").count() == docs.count()
