"""Exact n-gram Jaccard self-join: groups of documents linked by shingle sets of similarity 0.8 or more.

The plan, all of it distributed:

1. Every document becomes a sorted array of 64-bit shingle hashes. Equal sets form a class, whose
   smallest document id stands for it, so copies cost one group-by with map-side combining.
2. Tiles: two sets of the wanted similarity share one of the rarest fifth of their shingles (in any
   one order of all shingles), and their sizes differ by a fifth at most. A set lies in the tile of
   each of these shingles and of its size band and the one above. The order puts frequent shingles
   last, by counts in a fixed table of 2^20 counters taken over the whole corpus, so that a passage
   that very many documents share opens no tile of its own unless documents consist of it.
   Tiles with the same members are one. A pair is due at the first shingle that it shares, in the larger
   set's band: what follows there in both sets bounds its overlap, so most of the tiles that a pair shares
   never make it, and sets that even the tile's smallest one rules out are not in the tile.
3. Shingles that two or three sets share give their pairs at once. Within larger tiles, sets are first
   held against two of the tile's sets only, a number of pairs that grows with the tile and not with its
   square. Their links join sets to components. Only tiles that then still hold more than one component
   go on, first to one more such round, then to pairs of sets of different components. Pairs within a
   component are not decided, as they could add nothing to it.
4. A pair is first bounded from above: each set has a signature of 512 parity bits, every differing
   bit stands for an element of one set only, so the bit count of the XOR bounds the overlap. The bound
   is part of the join of the tiles, so pairs that fail it are never made. Signatures of two bits an
   element bound the pairs that pass once more, and those left are decided exactly, on the intersection
   of the whole sorted arrays.
5. Components come from alternating large-star and small-star rounds over the links.

Shingles are told apart by 64-bit hashes and sets by 128-bit digests of these, so results are exact up to
collisions of about 2^-64 a pair of shingles. No partner or candidate is capped, and nothing that
grows with the data is broadcast or collected, but for the counters (1 MB) and one number for each round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.arrowtext import mix, shingles, sliced, text_bytes, words
from keystrata.llm.components import connected_components
from keystrata.llm.idfilter import keep_likely
from keystrata.llm.tables import sum_tables
from keystrata.runtime import discard, materialize, ship_package

SHINGLE_WORDS = 5
PERCENT = 80
SKETCH_BITS = 20
SIGNATURE_WORDS = 8
HUB_ROUNDS = 2
#: Bits of a wide signature at most: enough to turn away unlike sets of up to some 18,000 shingles.
WIDEST = 8192
SIGNATURE = [f"s{k}" for k in range(SIGNATURE_WORDS)]

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _sets(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes with repeats, offsets by row)."""
    data, offsets = text_bytes(batch.column(column))
    hashes, text, _, _ = words(data, offsets, IS_WORD)
    return shingles(hashes, text, batch.num_rows, SHINGLE_WORDS)


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, sorted within each row."""
    parts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        part = np.sort(hashes[a:b])
        if b - a > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        parts.append(part)
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def shingle_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all shingles of docs in 2^20 counters, as a class of magnitude (0 to 255) for each."""
    size = 1 << SKETCH_BITS

    def fill(table: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
        for batch in sliced(batches, text_col):
            hashes, _ = _sets(batch, 0)
            table += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)

    total = sum_tables(docs.select(text_col), fill, size)
    return np.minimum(255, np.floor(4 * np.log2(total + 1))).astype(np.uint8)


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _longs(values))


def prefix_size(n: np.ndarray) -> np.ndarray:
    """How many of n shingles two sets of the wanted similarity cannot both lack."""
    return np.where(n > 0, n - (n * PERCENT + 99) // 100 + 1, 0)


def featurize(docs: DataFrame, frequencies: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h1, h2, tokens, s0..s7): set size, 128-bit digest of the set, its rarest shingles, its signature."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = SIGNATURE_WORDS * 64
        for batch in sliced(batches, text_col):
            values, offsets = _distinct(*_sets(batch, 1))
            n = np.diff(offsets)
            rows = np.repeat(np.arange(len(n)), n)
            # Digest: wrapped sums of two mixes of the elements.
            ends = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(0x51ED27)))))
            h1 = ends[offsets[1:]] - ends[offsets[:-1]]
            ends = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA5B35705F39C6D1F)))))
            h2 = ends[offsets[1:]] - ends[offsets[:-1]]
            parity = np.bincount(rows * bits + (values & np.uint64(bits - 1)).astype(np.int64), minlength=len(n) * bits) & 1
            packed = np.packbits(parity.astype(np.uint8).reshape(len(n), bits), axis=1).view(np.int64)
            wanted = prefix_size(n)
            order = table[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            chosen = []
            for a, b, p in zip(offsets[:-1].tolist(), offsets[1:].tolist(), wanted.tolist(), strict=True):
                if p:
                    v = values[a:b]
                    chosen.append(v[np.argsort(order[a:b], kind="stable")[:p]])  # values are sorted, so ties go by hash
            tokens = np.concatenate(chosen) if chosen else np.zeros(0, np.uint64)
            columns = [batch.column(0), pa.array(n), _longs(h1), _longs(h2), _lists(tokens, np.concatenate(([0], np.cumsum(wanted))))]
            columns += [pa.array(np.ascontiguousarray(packed[:, k])) for k in range(SIGNATURE_WORDS)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n", "h1", "h2", "tokens", *SIGNATURE])

    schema = f"`{id_col}` bigint, n bigint, h1 bigint, h2 bigint, tokens array<bigint>, " + ", ".join(f"{s} bigint" for s in SIGNATURE)
    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(run, schema)


def full_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, elements): whole shingle sets as sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*_distinct(*_sets(batch, 1)))], names=[id_col, "elements"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` bigint, elements array<bigint>")


def wide_signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, wide): set sizes and signatures of 2n parity bits or more, up to WIDEST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            values, offsets = _distinct(*_sets(batch, 1))
            wide = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                bits = min(WIDEST, max(512, 1 << (2 * (b - a) - 1).bit_length())) if b > a else 512
                parity = np.bincount((values[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                wide.append(np.packbits(parity.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(wide, pa.binary())], names=[id_col, "n", "wide"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` bigint, n bigint, wide binary")


def _bounded(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb, wa, wb) that the wide signatures allow to link. A signature folded to half its
    width, its halves XORed, is the signature of that width, so the wider one is folded to the other's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, wa, wb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(wa, np.uint8), np.frombuffer(wb, np.uint8)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                differing = int(np.bitwise_count(x ^ y).sum())
                keep.append((100 + PERCENT) * (na + nb - differing) >= 2 * PERCENT * (na + nb))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a bigint, b bigint")


def _intersections(pairs: DataFrame) -> DataFrame:
    """Links among pairs (a, b, ea, eb): 100 * intersection >= PERCENT * union, on the sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sides = [(np.asarray(c.values), np.asarray(c.offsets)) for c in (batch.column(2), batch.column(3))]
            (x, xo), (y, yo) = sides
            for i in range(batch.num_rows):
                u, v = x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]
                both = np.concatenate((u, v))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(u) + len(v) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ea", "eb").mapInArrow(run, "a bigint, b bigint")


def _possible(a: str, b: str) -> F.Column:
    """Whether sizes n and signatures of two sets (columns with these prefixes) allow a link.

    overlap <= (na + nb - differing bits) / 2, and a link needs overlap >= PERCENT / (100 + PERCENT) * (na + nb).
    """
    na, nb = F.col(a + "n"), F.col(b + "n")
    differing = sum((F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in SIGNATURE), F.lit(0))
    return _sizes_fit(na, nb) & ((100 + PERCENT) * (na + nb - differing) >= 2 * PERCENT * (na + nb))


def _sizes_fit(na: F.Column, nb: F.Column) -> F.Column:
    return (100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na)


def _renamed(light: DataFrame, side: str) -> DataFrame:
    return light.select(*[F.col(c).alias(side + c) for c in light.columns])


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """The linked ones among different pairs (a, b) of representatives, by their whole sets. Signatures and
    then sets are made in scans that let the documents that are in no pair, or no bounded one, pass by."""
    texts = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col)
    both = lambda p: p.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()
    wanted = materialize(both(pairs), f"{name}-ids")
    signatures = materialize(wide_signatures(keep_likely(texts, wanted, id_col), id_col, text_col), f"{name}-wide")
    wide = lambda c: signatures.select(F.col(id_col).alias(c), F.col("n").alias("n" + c), F.col("wide").alias("w" + c))
    pairs = materialize(_bounded(pairs.join(wide("a"), "a").join(wide("b"), "b")).distinct(), f"{name}-bounded")
    discard(wanted, signatures)
    wanted = materialize(both(pairs), f"{name}-left")
    sets = materialize(full_sets(keep_likely(texts, wanted, id_col), id_col, text_col), f"{name}-sets")
    side = lambda c: sets.select(F.col(id_col).alias(c), F.col("elements").alias("e" + c))
    links = materialize(_intersections(pairs.join(side("a"), "a").join(side("b"), "b")).distinct(), f"{name}-links")
    discard(wanted, sets, pairs)
    return links


def _tiles(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, ...]:
    """members (a row for each of docs, with its class and the class's rep, null without shingles), reps,
    holders of shingles, few (pairs of the shingles that two or three sets hold) and tiles of docs."""
    ship_package(docs.sparkSession)
    features = materialize(featurize(docs, shingle_frequencies(docs, text_col), id_col, text_col), "features")
    some = features.where("n > 0")
    key = ["n", "h1", "h2"]
    classes = materialize(some.groupBy(*key).agg(F.min(id_col).alias("rep")), "classes")
    members = materialize(features.select(id_col, *key).join(classes, key, "left").select(id_col, *key, "rep"), "members")
    reps = materialize(some.select(id_col, *key, *SIGNATURE).join(classes.withColumnRenamed("rep", id_col), [*key, id_col], "left_semi").dropDuplicates([id_col]).select(F.col(id_col).alias("rep"), "n", *SIGNATURE), "reps")

    # Tokens of representatives (a few copies may pass: their links are their class's links as well).
    listed = keep_likely(some.select(id_col, "n", "tokens"), classes.select("rep"), id_col)
    # `rest`: how many of the set's shingles come from this one on, in the order of all shingles.
    tokens = listed.select(F.col(id_col).alias("rep"), "n", F.posexplode("tokens").alias("place", "token")).withColumn("rest", F.col("n") - F.col("place"))
    # Most shingles are one document's own. Of those that two or three share, the smallest, the largest
    # and the XOR of all ids name every holder, and so every pair, without a join.
    holders = tokens.groupBy("token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor("rep").alias("x"), F.count("*").alias("c"))
    holders = materialize(holders.where("lo <> hi"), "holders")
    middle = F.col("lo").bitwiseXOR(F.col("hi")).bitwiseXOR(F.col("x"))
    few = holders.where("c <= 3").select("lo", "hi", F.when(F.col("c") == 3, middle).otherwise(F.col("lo")).alias("mid")).distinct()
    few = few.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (("lo", "hi"), ("lo", "mid"), ("mid", "hi"))])).alias("p")).select(F.least("p.u", "p.v").alias("a"), F.greatest("p.u", "p.v").alias("b")).where("a <> b")

    # Size bands grow by the similarity, so partners lie in the same band or a neighbouring one.
    many = holders.where("c > 3").select("token")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int")
    bands = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own"))))
    posted = keep_likely(tokens, many, "token").join(many, "token", "left_semi").select("token", "rep", "n", "rest", bands.alias("of")).join(reps.select("rep"), "rep", "left_semi")
    tiles = materialize(posted.groupBy("token", "of.band", "of.own", "rep", "n").agg(F.max("rest").alias("rest")), "tiles")
    discard(features, classes)
    return members, reps, holders, few, tiles


def _different_tiles(tiles: DataFrame) -> DataFrame:
    """The same sets in fewer tiles: of tiles with the same members one is left, as sets that share a passage meet
    in a tile for each of its shingles. A member's `rest` is the largest of these, so the first shingle that
    a pair shares is still bounded; one that is too small even for the tile's smallest set leaves it. Tiles without a set of their own band go: its pairs are made in the band below."""
    who = F.struct("rep", "n")
    digest = [F.bit_xor(F.xxhash64(who, F.lit(salt))).alias(f"d{salt}") for salt in (1, 2)]
    spread = tiles.groupBy("token", "band").agg(*digest, F.count("*").alias("members"), F.max("own").alias("own"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min("n").alias("least")).where("own and lo <> hi")
    spread = materialize(spread.select("token", "band", "members", "d1", "d2", "least"), "spread")
    key = ["band", "members", "d1", "d2"]
    named = spread.join(spread.groupBy(*key).agg(F.min("token").alias("tile")), key).select("token", "band", "tile", "least")
    merged = tiles.join(named, ["token", "band"]).groupBy(F.col("tile").alias("token"), "band", "own", "rep", "n", "least").agg(F.max("rest").alias("rest"))
    merged = materialize(merged.where((100 + PERCENT) * F.col("rest") >= PERCENT * (F.col("n") + F.col("least"))).drop("least"), "merged")
    discard(spread, tiles)
    return merged


def _first_shared(a: str, b: str) -> F.Column:
    """Whether two sets of a tile (columns with these prefixes) may share the tile's shingle first, and this band
    is the larger one's: what they share lies in the rest of both. A pair that links meets this in one tile."""
    rest = F.least(F.col(a + "rest"), F.col(b + "rest"))
    return (F.col(a + "own") | F.col(b + "own")) & ((100 + PERCENT) * rest >= PERCENT * (F.col(a + "n") + F.col(b + "n")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    Words are runs of bytes other than white space (U+0020, U+0009 to U+000D), A-Z lower-cased. A text
    of fewer than 5 words is one shingle; a null or empty one, or one without words, has none, and is
    alone in its component. component_id is the smallest id reachable by links of similarity 0.8 or
    more, itself included. Repeated rows give repeated results. Rows that share an id count as one
    document in the links (each is compared, and what links one links them all). Ids must be whole numbers;
    text that is none raises an error. A row without an id links nobody; it has the component of a row
    with an equal set, and null without one. Other columns are not read.
    """
    members, reps, holders, few, posted = _tiles(docs, id_col, text_col)
    posted = _different_tiles(posted)
    tiles = posted.withColumn("component", F.col("rep"))
    found = known = waiting = nodes = None
    for turn in range(HUB_ROUNDS + 1):
        # Of each tile, whether it still holds different components, and two sets to hold the others
        # against; held so, a tile of three sets is done.
        at = F.struct("component", "rep", "n")
        spread = tiles.groupBy("token", "band").agg(F.min(at).alias("hub"), F.max(at).alias("far"), F.count("*").alias("members")).where("hub.component <> far.component")
        if turn:
            spread = spread.where("members > 3")
        mixed = tiles.join(spread, ["token", "band"])
        if turn < HUB_ROUNDS:
            mixed = materialize(mixed, f"mixed{turn}")
            discard(posted)
            posted = mixed
            hubs = mixed.select("rep", "n", "component", F.explode(F.array("hub", "far")).alias("other"))
            near = hubs.where("component <> other.component").where(_sizes_fit(F.col("n"), F.col("other.n")))
            near = near.select(F.least("rep", "other.rep").alias("a"), F.greatest("rep", "other.rep").alias("b"))
            near = (near if turn else near.union(few)).distinct()
            near = near.join(_renamed(reps, "x").withColumnRenamed("xrep", "a"), "a").join(_renamed(reps, "y").withColumnRenamed("yrep", "b"), "b").where(_possible("x", "y"))
        else:
            last = materialize(mixed.select("token", "band", "rep", "component", "own", "rest").join(reps, "rep"), "mixed")
            discard(posted)
            condition = (F.col("xtoken") == F.col("ytoken")) & (F.col("xband") == F.col("yband")) & (F.col("xrep") < F.col("yrep")) & (F.col("xcomponent") != F.col("ycomponent")) & _first_shared("x", "y") & _possible("x", "y")
            near = _renamed(last, "x").join(_renamed(last, "y"), condition).select(F.col("xrep").alias("a"), F.col("yrep").alias("b")).distinct()
        near = made = materialize(near.select("a", "b"), f"near{turn}")
        if turn == HUB_ROUNDS:
            discard(last, reps)
        if not turn:
            discard(holders)
            # In a group of near copies most pairs link. One pair for each set comes first; the others are
            # looked at in the next round, where they can still join two components.
            waiting, near = near, near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        elif turn == 1:
            side = lambda c: known.select(F.col("rep").alias(c), F.col("component").alias("c" + c))
            open_pairs = waiting.join(side("a"), "a", "left").join(side("b"), "b", "left").where("ca is null or cb is null or ca <> cb")
            near = near.union(open_pairs.select("a", "b")).distinct()
        links = verify(near, docs, id_col, text_col, f"round{turn}")
        discard(made if turn else None, waiting if turn == 1 else None)
        found = links if found is None else found.union(links)
        discard(nodes)
        nodes = connected_components(found)
        known = nodes.select(F.col("node").alias("rep"), "component")
        if turn < HUB_ROUNDS:
            tiles = mixed.where("members > 3").select("token", "band", "own", "rep", "n", "rest").join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    out = members.join(known, "rep", "left")
    return out.select(id_col, F.col("n").alias("n_shingles"), F.coalesce("component", "rep", F.col(id_col)).alias("component_id"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, n_links) for each row of docs: how many other rows have a similarity of 0.8 or more.

    Shingles are those of jaccard_components. All pairs of different sets that the bounds leave are
    decided, within components as well; copies count by the sizes of their classes. A row without
    shingles has no link. Rows are told apart by id and text, so ids may be repeated or null.
    """
    rows = docs.select(id_col, F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("__row"))
    members, reps, holders, few, tiles = _tiles(rows.select("__row", "text"), "__row", "text")
    key = ["n", "h1", "h2"]
    side = lambda c, p: _renamed(reps, p).withColumnRenamed(p + "rep", c)
    pairs = few.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_possible("x", "y")).select("a", "b")
    held = materialize(tiles.select("token", "band", "rep").join(reps, "rep"), "held")
    condition = (F.col("xtoken") == F.col("ytoken")) & (F.col("xband") == F.col("yband")) & (F.col("xrep") < F.col("yrep")) & _possible("x", "y")
    pairs = pairs.union(_renamed(held, "x").join(_renamed(held, "y"), condition).select(F.col("xrep").alias("a"), F.col("yrep").alias("b")))
    pairs = materialize(pairs.distinct(), "pairs")
    discard(holders, tiles, held, reps)
    links = verify(pairs, rows, "__row", "text", "all")
    sizes = members.where("n > 0").groupBy(*key, "rep").agg(F.count("*").alias("members"))
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    more = both.join(sizes.select(F.col("rep").alias("other"), "members"), "other").groupBy("rep").agg(F.sum("members").alias("more"))
    counts = sizes.join(more, "rep", "left").select(*key, (F.col("members") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    known = members.select("__row", *key).distinct().join(counts, key, "left")
    return rows.select(id_col, "__row").join(known, "__row").select(id_col, F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
