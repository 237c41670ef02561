"""URL filtering: rules first, then the ratio of two character language models.

URLs that a rule decides are examples of accepted and rejected ones. From each kind a variable-order
Markov model of characters is counted over all of them; a character's probability is interpolated from
the longest known context down (Witten-Bell). A URL is judged by the difference of its two
log-likelihoods, divided by its length, against a threshold set on examples that were not counted then.

The models are a table of grams (a context and the character after it) that grows with the examples.
It is joined to the different grams of the URLs to be judged, an order at a time; only the frequent of
these, of a bounded number, are broadcast, and the others are joined to the URLs that have them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.runtime import materialize, ship_package

ORDER = 5
#: A gram is frequent if at least one in so many characters to be judged is its last: there are at most so
#: many frequent ones, the proven bound of what is broadcast, and no key of the join of others is hot.
FREQUENT_SHARE = 20_000
#: Log-ratios are added up as whole numbers of this fraction, so that their order makes no difference.
UNIT = 1 << 32
#: Of ten examples, how many are counted to set the threshold on the others, which are then counted as well.
COUNTED_TENTHS = 8
BIN = 0.005
BINS = 4000
START, END = b"\x02", 3


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    rule: str  # host and path, such as example.com/en/7

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2] if "/" in self.rule else ""


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, null where none does. A rule fits its host and all
    subdomains if the path begins with the rule's; of equally long ones the first listed wins."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, action = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.action).otherwise(action)
    return rule, action


class Markov:
    """Interpolated character probabilities: contexts maps a context to (total, {character: count}).
    The plain form of what _ratios computes on tables."""

    def __init__(self, contexts: dict[bytes, tuple[int, dict[int, int]]]):
        self.contexts = contexts
        self.memo: dict[bytes, float] = {}

    def _probability(self, context: bytes, symbol: int) -> float:
        p = 1 / 256
        for k in range(len(context) + 1):
            found = self.contexts.get(context[len(context) - k :])
            if found is None:
                break  # a longer context is no more frequent than its end
            total, after = found
            kinds = len(after)
            p = (after.get(symbol, 0) + kinds * p) / (total + kinds)
        return p

    def log_likelihood(self, data: bytes) -> float:
        memo, total = self.memo, 0.0
        padded = START * ORDER + data + bytes([END])
        for i in range(ORDER, len(padded)):
            key = padded[i - ORDER : i + 1]
            found = memo.get(key)
            if found is None:
                if len(memo) > 1 << 18:
                    memo.clear()
                found = memo[key] = math.log(self._probability(key[:-1], key[-1]))
            total += found
        return total


@dataclass
class Model:
    grams: DataFrame  # gram (a context of up to ORDER bytes and the byte after it), allow, block: how often in each kind
    threshold: float


def _grams(urls: DataFrame, kinds: tuple[str, ...], orders: tuple[int, ...]) -> DataFrame:
    """(gram, a count for each of kinds) of the rows (kind, u), for contexts of the given lengths."""
    names = ["gram", *kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {kind: Counter() for kind in kinds}

        def flush() -> pa.RecordBatch:
            grams = list(set().union(*held.values()))
            out = pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), *(pa.array([held[kind][g] for g in grams], pa.int64()) for kind in kinds)], names=names)
            for counter in held.values():
                counter.clear()
            return out

        for batch in batches:
            for kind, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                padded, counter = START * ORDER + u + bytes([END]), held[kind]
                for k in orders:
                    counter.update(padded[i - k : i + 1] for i in range(ORDER, len(padded)))
                if sum(map(len, held.values())) > 1 << 18:
                    yield flush()
        if any(held.values()):
            yield flush()

    found = urls.select("kind", F.col("u").cast("binary")).mapInArrow(run, "gram binary, " + ", ".join(f"{kind} bigint" for kind in kinds))
    return found.groupBy("gram").agg(*[F.sum(kind).alias(kind) for kind in kinds])


def _ratios(grams: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, n, d) of each of asked (gram of the full order, n): d is the log-ratio of its last byte's
    probabilities in the two models after its context, in UNITs."""
    size = lambda c="gram": F.octet_length(c)
    # Its ends, down to the byte alone. What a byte more in front tells apart has at most 256 forms, so no key below is hot.
    ends = asked.select(F.explode(F.array(*[F.expr(f"substring(gram, {k + 1})") for k in range(1, ORDER + 1)])).alias("gram")).distinct().withColumn("n", F.lit(1).cast("bigint"))
    none = F.lit(0).cast("bigint")
    every = grams.select("gram", "allow", "block", none.alias("n")).union(asked.select("gram", none, none, "n")).union(ends.select("gram", none, none, "n"))
    every = every.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("allow", "block", "n")])
    wanted = F.collect_list(F.when(F.col("n") > 0, F.struct("gram", "allow", "block", "n"))).alias("wanted")
    totals = [f(c).alias(c + s) for c in ("allow", "block") for f, s in ((F.sum, "_total"), (lambda c: F.count_if(F.col(c) > 0), "_kinds"))]
    by_context = every.groupBy(F.expr("substring(gram, 1, octet_length(gram) - 1)").alias("context")).agg(*totals, wanted)
    levels = materialize(by_context.select("*", F.explode("wanted").alias("w")).select("w.*", *[c + s for c in ("allow", "block") for s in ("_total", "_kinds")]), "url-grams")

    def step(kind: str, shorter: F.Column) -> F.Column:
        total, kinds = F.col(kind + "_total"), F.col(kind + "_kinds")
        return F.when(total > 0, (F.col(kind) + kinds * shorter) / (total + kinds)).otherwise(shorter)

    p = levels.where(size() == 1).select("gram", "n", *[step(kind, F.lit(1 / 256)).alias("p_" + kind) for kind in ("allow", "block")])
    for k in range(2, ORDER + 2):
        shorter = p.select(F.col("gram").alias("end"), *[F.col("p_" + kind).alias("q_" + kind) for kind in ("allow", "block")])
        p = levels.where(size() == k).withColumn("end", F.expr("substring(gram, 2)")).join(shorter, "end")
        p = p.select("gram", "n", *[step(kind, F.col("q_" + kind)).alias("p_" + kind) for kind in ("allow", "block")])
    return p.select("gram", "n", F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("bigint").alias("d"))


def _scores(frame: DataFrame, grams: DataFrame, into: str) -> DataFrame:
    """frame with the score of its column u: the log-ratio of the models, divided by the length."""
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

    asked = _grams(frame.select(F.lit("n").alias("kind"), "u"), ("n",), (ORDER,))
    ratios = materialize(_ratios(grams, asked), "url-ratios")
    total = ratios.agg(F.sum("n")).first()[0] or 0
    frequent = {bytes(r["gram"]): r["d"] for r in ratios.where(F.col("n") >= total / FREQUENT_SHARE).collect()}
    shared = frame.sparkSession.sparkContext.broadcast(frequent)
    rows = frame.withColumn("__u", F.col("u").cast("binary"))
    extra = [StructField("__sum", LongType()), StructField("__others", ArrayType(BinaryType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sums, others = [], []
            for u in batch.column(batch.num_columns - 1).to_pylist():
                padded = START * ORDER + u + bytes([END])
                found = [padded[i - ORDER : i + 1] for i in range(ORDER, len(padded))]
                sums.append(sum(known.get(g, 0) for g in found))
                others.append([g for g in found if g not in known])
            fields = [pa.field("__sum", pa.int64()), pa.field("__others", pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64()), pa.array(others, pa.list_(pa.binary()))], schema=pa.schema([*batch.schema, *fields]))

    split = rows.mapInArrow(run, StructType([*rows.schema.fields, *extra])).withColumn("__h1", F.xxhash64("__u")).withColumn("__h2", F.xxhash64("__u", F.lit(1)))
    split = materialize(split, "url-split")
    score = lambda d: (d / UNIT / (F.octet_length("__u") + 1)).alias(into)
    some = split.where(F.size("__others") > 0)
    # A URL with a gram that is not frequent is itself not frequent, so its key is not hot.
    parts = some.dropDuplicates(["__h1", "__h2"]).select("__h1", "__h2", F.explode("__others").alias("gram")).join(ratios.select("gram", "d"), "gram").groupBy("__h1", "__h2").agg(F.sum("d").alias("__more"))
    whole = split.where(F.size("__others") == 0).select(*frame.columns, score(F.col("__sum")))
    return whole.union(some.join(parts, ["__h1", "__h2"]).select(*frame.columns, score(F.col("__sum") + F.col("__more"))))


def calibrate(histogram: dict[int, tuple[int, int]]) -> float:
    """The threshold of the best balanced accuracy, from bins of scores with (accepted, rejected) counts;
    the middle one of equally good thresholds. 0 if a kind is missing."""
    bins = sorted(histogram)
    good, bad = sum(histogram[b][0] for b in bins), sum(histogram[b][1] for b in bins)
    if not good or not bad:
        return 0.0
    best, chosen, above, below = -1.0, [], good, 0
    for b in range(bins[0], bins[-1] + 2):  # accepted from the lower edge of bin b on
        value = above / good + below / bad
        if value > best + 1e-12:
            best, chosen = value, [b]
        elif value > best - 1e-12:
            chosen.append(b)
        a, r = histogram.get(b, (0, 0))
        above, below = above - a, below + r
    return chosen[len(chosen) // 2] * BIN


def fit(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> Model:
    """Learn from all rows of pages that a rule decides."""
    ship_package(pages.sparkSession)
    url = F.col(url_col)
    host, path = url_host(url), url_path(url)
    _, action = decided(rules, host, path)
    examples = pages.select(action.alias("kind"), F.coalesce(url, F.lit("")).alias("u"), (F.pmod(F.xxhash64(url), F.lit(10)) < COUNTED_TENTHS).alias("counted")).where("kind is not null")
    orders = tuple(range(ORDER + 1))
    first, rest = (materialize(_grams(examples.where(which), ("allow", "block"), orders), "url-counts") for which in ("counted", "not counted"))
    held = _scores(examples.where("not counted").select("kind", "u"), first, "d")
    edge = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("d") / BIN).cast("int")))
    histogram: dict[int, tuple[int, int]] = {}
    for r in held.groupBy(edge.alias("b")).agg(F.count_if(F.col("kind") == "allow").alias("a"), F.count_if(F.col("kind") == "block").alias("r")).collect():
        histogram[r["b"]] = (r["a"], r["r"])
    grams = first.union(rest).groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    return Model(grams, calibrate(histogram))


def judge(pages: DataFrame, rules: list[Rule], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and score of each row of pages.

    The models judge the whole URL, a null one as empty. A null URL, or one without ://, has an empty host
    and path, and no rule fits it. Scores from the threshold on are allowed. Without examples of a kind its model is
    uniform; without any, every URL scores 0 and is allowed. Repeated rows give repeated results; other
    columns are not read.
    """
    ship_package(pages.sparkSession)
    url = F.col(url_col)
    split = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"), F.coalesce(url, F.lit("")).alias("u"))
    rule, action = decided(rules, F.col("host"), F.col("path"))
    ruled = split.select(id_col, "host", "path", rule.alias("rule"), action.alias("action"), "u")
    scored = _scores(ruled, model.grams, "score")
    method = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("action", method).alias("verdict"), "score")
