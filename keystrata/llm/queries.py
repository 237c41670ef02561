"""The registered queries of this subpackage: op1 to op10, their SQL, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import bpe, decontam, jaccard, langid, media, pii, tokencount, tokenfiles, toxicity, urlfilter
from keystrata.runtime import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


URL_RULES = [urlfilter.Rule("block", "com/en/"), urlfilter.Rule("allow", "example.com/en/7"), urlfilter.Rule("allow", "net/de/"), urlfilter.Rule("block", "example.net/de/8"), urlfilter.Rule("block", "org/es/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, URL_RULES, urlfilter.fit(pages, URL_RULES))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    docs = tokenfiles.arrange(table(spark, sf_dir, "documents"))
    tokenfiles.write_token_files(tokenfiles.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1), path)
    return tokenfiles.summarize_token_files(spark, path)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, usable=remainder(4) != 2)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=remainder(5) != 0)
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_url_filter, op3_ngram_jaccard, op4_token_files, op5_media, op6_token_counts, op7_language_id, op8_decontaminate, op9_pii, op10_toxicity)}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Operators whose whole contract SQL can express. The others are held against brute force or their libraries in tests/llm.
ORACLES = {
    "op3_ngram_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)""",
    "op8_decontaminate": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 i AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
 iw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k + n - 1], ' '))) AS win FROM i),
 sizes AS (SELECT DISTINCT n FROM iw),
 dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS k, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k + n - 1], ' '))) AS win FROM d, sizes WHERE len(ws) >= n),
 m AS (SELECT dw.doc_id, dw.n, dw.k, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
 h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
 q AS (SELECT win, off, w, row_number() OVER (PARTITION BY win ORDER BY coalesce(c, 0), off) AS rk, c FROM (SELECT win, unnest(range(len(string_split(win, ' ')))) AS off, unnest(string_split(win, ' ')) AS w FROM (SELECT DISTINCT win FROM iw)) LEFT JOIN (SELECT w, count(*) AS c FROM (SELECT unnest(ws) AS w FROM d) GROUP BY 1) USING (w)),
 r AS (SELECT win, max(w) FILTER (rk = 1) AS t1, max(w) FILTER (rk = 2) AS t2, max(w) FILTER (rk = 3) AS t3, max(w) FILTER (rk = 4) AS t4, max(w) FILTER (rk = 5) AS t5 FROM q GROUP BY 1),
 o AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
 b AS (SELECT o.* FROM o SEMI JOIN q ON o.w = q.w),
 n1 AS (SELECT b.doc_id, b.p, r.* FROM b JOIN r ON b.w = r.t1),
 n2 AS (SELECT * FROM n1 WHERE t2 IS NULL UNION ALL SELECT n1.* FROM n1 SEMI JOIN b ON b.doc_id = n1.doc_id AND b.w = n1.t2 AND b.p >= n1.p - 30 AND b.p <= n1.p + 30),
 n3 AS (SELECT * FROM n2 WHERE t3 IS NULL UNION ALL SELECT n2.* FROM n2 SEMI JOIN b ON b.doc_id = n2.doc_id AND b.w = n2.t3 AND b.p >= n2.p - 30 AND b.p <= n2.p + 30),
 n4 AS (SELECT * FROM n3 WHERE t4 IS NULL UNION ALL SELECT n3.* FROM n3 SEMI JOIN b ON b.doc_id = n3.doc_id AND b.w = n3.t4 AND b.p >= n3.p - 30 AND b.p <= n3.p + 30),
 n5 AS (SELECT * FROM n4 WHERE t5 IS NULL UNION ALL SELECT n4.* FROM n4 SEMI JOIN b ON b.doc_id = n4.doc_id AND b.w = n4.t5 AND b.p >= n4.p - 30 AND b.p <= n4.p + 30),
 x AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM n5 JOIN iw USING (win) GROUP BY 1),
 t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
 SELECT d.doc_id, len(d.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, coalesce(t.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(x.n_near_items, 0) AS n_near_items FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)""",
}


def _pii_sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b",
        "account": r"\b[0-9]{8,12}\b",
    }
    digits, compact = "regexp_replace(t, '[^0-9]', '', 'g')", "replace(t, ' ', '')"
    turned = f"substr({compact}, 5) || substr({compact}, 1, 4)"
    valid = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(t, '.'), lambda x: coalesce(try_cast(x AS HUGEINT) <= 255, false)))",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr({digits}, length({digits}) - k + 1, 1) AS INT) ELSE (CAST(substr({digits}, length({digits}) - k + 1, 1) AS INT) * 2) % 10 + (CAST(substr({digits}, length({digits}) - k + 1, 1) AS INT) * 2) // 10 END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"length({compact}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: ascii(c))), lambda a, x: CASE WHEN x >= 65 THEN (a * 100 + x - 55) % 97 ELSE (a * 10 + x - 48) % 97 END) = 1",
        "account": "true",
    }
    near = lambda k, part: f"regexp_matches(lower({part}), '{pii.context_pattern(k)}')"
    kinds = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS place, '{k}' AS kind, s, s + length(t) AS e, CAST({pii.BASE_SCORE[k]} AS DOUBLE) + CAST(CASE WHEN {near(k, f"substr(text, greatest(s - {pii.CONTEXT_CHARS}, 0) + 1, least(s, {pii.CONTEXT_CHARS}))")} OR {near(k, f"substr(text, s + length(t) + 1, {pii.CONTEXT_CHARS})")} THEN {pii.CONTEXT_SCORE} ELSE 0 END AS DOUBLE) AS score
 FROM (SELECT doc_id, text, ms[i] AS t, CAST(list_sum(parts[1:i]) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, text, ms, parts, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{plain[k]}') AS ms, list_transform(string_split_regex(text, '{plain[k]}'), lambda p: length(p)) AS parts FROM documents))) WHERE {valid[k]}"""
        for i, k in enumerate(plain)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in plain)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s)"
    return f"""WITH p AS ({kinds}), f AS (SELECT * FROM p WHERE place < {len(pii.KINDS)} OR score >= {pii.LEAST_SCORE}), g AS (SELECT doc_id, {counts}, {joined} AS spans, {joined} FILTER (place < 4) AS base, max(score) AS top_score FROM f GROUP BY 1)
 SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in plain)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, top_score FROM documents d LEFT JOIN g USING (doc_id)"""


ORACLES["op9_pii"] = _pii_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
