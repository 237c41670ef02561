"""Benchmark decontamination on a distributed positional inverted index.

The index is stored as Parquet, a row for each range of about 1 MB of documents: the terms that the
benchmark may use, sorted, with the sorted positions of each within the range. It is made in one scan
of the texts, whatever the size of the benchmark; the benchmark is then taken in blocks, each against
the stored postings. A window of benchmark words is looked up from its rarest term, by counts over the
whole corpus: that term's positions, less its offset in the window, are the possible starts, and each
further term's positions, less its offset, are intersected with them, from the rarest to the most
frequent. What remains are exact occurrences. Proximity matches ask only that the rarest few terms of
a window lie within a distance of each other, in any order.

Words are told apart by 64-bit hashes of their bytes; two different ones are taken for the same with a
probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.arrowtext import give_back, sliced, text_bytes, words
from keystrata.llm.tables import sum_tables
from keystrata.runtime import discard, materialize, ship_package

WINDOW = 10
NEAR_TERMS = 5
NEAR_DISTANCE = 30
#: The benchmark is taken in blocks of about so many bytes: the bound of what is broadcast at a time.
BLOCK_BYTES = 4 << 20
#: The index holds the words whose hash falls on a slot, of 2^FILTER_BITS, of some benchmark word.
FILTER_BITS = 20
CHAINED = 3

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = True
IS_WORD[0x41:0x5B] = True
IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Queries:
    """The windows of a block of items: for each its item, length, and terms by rarity with their offsets."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.items = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        hashes, item, _, _ = words(*text_bytes(column), IS_WORD)
        self.terms = np.unique(hashes)
        term = np.searchsorted(self.terms, hashes)
        first = np.searchsorted(item, np.arange(len(items) + 1))
        owner, starts, sizes = [], [], []
        for i in range(len(items)):
            n = int(first[i + 1] - first[i])
            size = min(n, WINDOW)
            for s in range(n - size + 1 if n else 0):
                owner.append(i)
                starts.append(int(first[i]) + s)
                sizes.append(size)
        self.owner, self.size = np.array(owner, np.int64), np.array(sizes, np.int64)
        at = np.array(starts, np.int64)[:, None] + np.arange(WINDOW)[None, :] if starts else np.zeros((0, WINDOW), np.int64)
        self.inside = np.arange(WINDOW)[None, :] < self.size[:, None] if starts else np.zeros((0, WINDOW), bool)
        self.window_terms = np.where(self.inside, term[np.minimum(at, max(len(term) - 1, 0))] if len(term) else 0, -1)
        # The same words in the same order need one lookup, whatever the number of items that have them.
        if len(at):
            _, keep, back = np.unique(self.window_terms, axis=0, return_index=True, return_inverse=True)
            self.class_of = back.reshape(-1)
            self.window_terms, self.inside, self.class_size = self.window_terms[keep], self.inside[keep], self.size[keep]
        else:
            self.class_of, self.class_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(self.class_of, kind="stable")
        self.owners_by_class = self.owner[order]
        self.class_begin = np.searchsorted(self.class_of[order], np.arange(len(self.class_size) + 1))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[_slot(self.terms)] = True

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, term) of the words that are terms of this block."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[_slot(hashes)])
        term = np.searchsorted(self.terms, hashes[at])
        term[term == len(self.terms)] = 0
        same = self.terms[term] == hashes[at]
        return at[same], term[same]

    def rank(self, counts: np.ndarray) -> None:
        """Order each window's terms from the rarest in the corpus on; repeated terms stay, by offset."""
        rarity = np.where(self.inside, counts[np.maximum(self.window_terms, 0)] if len(counts) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(rarity, axis=1, kind="stable")
        self.ranked_terms = np.take_along_axis(self.window_terms, self.order, 1)
        by = np.argsort(self.ranked_terms[:, 0], kind="stable") if len(self.order) else np.zeros(0, np.int64)
        self.by_rarest = by
        self.rarest_begin = np.searchsorted(self.ranked_terms[by, 0] if len(by) else np.zeros(0, np.int64), np.arange(len(self.terms) + 1))


SHIFT = 40  # positions within a shard's slice are far below 2^40


class Shard:
    """Postings of a range of documents: sorted term << SHIFT | position, positions counted over the range,
    and where each document begins among the positions, the end last."""

    def __init__(self, queries: Queries, term: np.ndarray, position: np.ndarray, begin: np.ndarray):
        self.q, self.begin = queries, begin
        self.postings = term << SHIFT | position

    @classmethod
    def of_words(cls, queries: Queries, hashes: np.ndarray, n_words: np.ndarray) -> Shard:
        position, term = queries.lookup(hashes)
        order = np.argsort(term, kind="stable")
        return cls(queries, term[order], position[order], np.concatenate(([0], np.cumsum(n_words))))

    @classmethod
    def of_index(cls, queries: Queries, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, n_words: np.ndarray) -> Shard:
        """From a row of the index, whose terms are sorted as the queries' are."""
        which, term = queries.lookup(terms)
        size, first = counts[which], (np.cumsum(counts) - counts)[which]
        ends = np.cumsum(size)
        at = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return cls(queries, np.repeat(term, size), positions[at].astype(np.int64), np.concatenate(([0], np.cumsum(n_words))))

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, side="right") - 1

    def _has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term << SHIFT | position
        at = np.searchsorted(self.postings, key)
        at[at == len(self.postings)] = 0
        return self.postings[at] == key

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term), for every posting of that term."""
        term, position = self.postings >> SHIFT, self.postings & ((1 << SHIFT) - 1)
        n = self.q.rarest_begin[term + 1] - self.q.rarest_begin[term]
        which = np.repeat(np.arange(len(term)), n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return self.q.by_rarest[self.q.rarest_begin[term[which]] + within], position[which]

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, start) of exact occurrences, and (window, position) of proximity matches."""
        none = np.zeros(0, np.int64)
        if not len(self.postings) or not len(self.q.order):
            return none, none, none, none
        window, position = self._candidates()
        near_w, near_p = self._near(window, position)
        start = position - self.q.order[window, 0]
        size = self.q.class_size[window]
        fits = (start >= 0) & (start + size <= self.begin[-1])
        fits[fits] = self.doc(start[fits]) == self.doc(start[fits] + size[fits] - 1)
        window, start = window[fits], start[fits]
        for k in range(1, WINDOW):
            more = self.q.ranked_terms[window, k] >= 0
            good = ~more
            good[more] = self._has(self.q.ranked_terms[window[more], k], start[more] + self.q.order[window[more], k])
            window, start = window[good], start[good]
        return window, start, near_w, near_p

    def _near(self, window: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates whose next rarest terms lie near, within the same document. A term that the window
        repeats is asked for once more at its own place, so it adds nothing."""
        for k in range(1, NEAR_TERMS):
            term = self.q.ranked_terms[window, k]
            doc = self.doc(position)
            lo = np.maximum(position - NEAR_DISTANCE, self.begin[doc])
            hi = np.minimum(position + NEAR_DISTANCE, self.begin[doc + 1] - 1)
            at = np.searchsorted(self.postings, np.maximum(term, 0) << SHIFT | lo)
            inside = at < len(self.postings)
            found = np.zeros(len(window), bool)
            found[inside] = self.postings[at[inside]] <= (term[inside] << SHIFT | hi[inside])
            keep = found | (term < 0)
            window, position = window[keep], position[keep]
        return window, position


def _runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals (start, start + size), joined where they touch."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate((start + size)[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    last = np.concatenate((new[1:], [True]))
    return s[new], e[last]


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Queries]:
    """The benchmark in blocks of about BLOCK_BYTES."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    volume = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-int(volume) // BLOCK_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        yield Queries(sorted(((r["i"], r["t"] or "") for r in rows), key=lambda item: (item[0] or "", item[1])))


def build_index(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The stored index of docs for the words of the benchmark, in the shared folder: a row for each range of
    documents with shard (a number of its own), ids and n_words of the documents, and the terms, the
    number of positions of each, and the positions. Words of other texts may be among the terms."""
    spark = docs.sparkSession
    ship_package(spark)
    size = 1 << FILTER_BITS

    def fill(table: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
        for batch in sliced(batches, item_text_col):
            hashes, _, _, _ = words(*text_bytes(batch.column(0)), IS_WORD)
            table[_slot(hashes)] = 1

    wanted = spark.sparkContext.broadcast(np.packbits(sum_tables(benchmark.select(item_text_col), fill, size) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        used = np.unpackbits(wanted.value).astype(bool)
        shard = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, text_col):
            hashes, text, _, _ = words(*text_bytes(batch.column(1)), IS_WORD)
            position = np.flatnonzero(used[_slot(hashes)])
            position = position[np.argsort(hashes[position], kind="stable")]
            terms, counts = np.unique(hashes[position], return_counts=True)
            lists = (batch.column(0), pa.array(np.bincount(text, minlength=batch.num_rows).astype(np.int64)), pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int32)), pa.array(position.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists)], names=["shard", "ids", "n_words", "terms", "counts", "positions"])
            shard += 1

    kind = dict(docs.dtypes)[id_col]
    schema = f"shard bigint, ids array<{kind}>, n_words array<bigint>, terms array<bigint>, counts array<int>, positions array<int>"
    return materialize(docs.select(id_col, text_col).mapInArrow(run, schema), "index")


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The values of a list column of a batch of one row."""
    return np.asarray(batch.column(batch.schema.get_field_index(name)).flatten())


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, hits (word intervals covered by occurring windows,
    as arrays of structs s, e), items (different ids of items with an occurring window) and near_items
    (ids of items with a proximity match; exact ones are among them).

    Words are runs of ASCII letters and digits and of all characters from U+0080 on, A-Z lower-cased.
    A null or empty text has no words; an item without words has no window. An empty benchmark hits
    nothing. Repeated items count once for an id; an item without an id has hits but is not among items.
    Rows are told apart by their place in the index, so ids may be repeated or null. The benchmark is
    taken in blocks of about 4 MB, each against the stored index. Other columns are not read.
    """
    spark = docs.sparkSession
    index = build_index(docs, benchmark, id_col, text_col, item_text_col)
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("place", "d")).select("shard", "place", F.col("d.ids").alias(id_col), F.col("d.n_words").alias("n_words"))
    schema = "shard bigint, place int, hits array<struct<s:bigint,e:bigint>>, items array<string>, near_items array<string>"
    found = None
    for queries in _blocks(benchmark, item_col, item_text_col):
        block = spark.sparkContext.broadcast(queries)

        def fill(table: np.ndarray, batches: Iterator[pa.RecordBatch], block=block) -> None:
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    which, term = block.value.lookup(_array(one, "terms").view(np.uint64))
                    np.add.at(table, term, _array(one, "counts")[which])

        queries.rank(sum_tables(index.select("terms", "counts"), fill, max(1, len(queries.terms))))
        block.unpersist()
        ranked = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch], block=ranked) -> Iterator[pa.RecordBatch]:
            q = block.value
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    n_words = _array(one, "n_words")
                    shard = Shard.of_index(q, _array(one, "terms").view(np.uint64), _array(one, "counts").astype(np.int64), _array(one, "positions"), n_words)
                    window, start, near, near_at = shard.matches()
                    hits: dict[int, list] = {}
                    ids: dict[int, tuple[set, set]] = {}
                    doc = shard.doc(start)
                    for d in np.unique(doc).tolist():
                        here = doc == d
                        s, e = _runs(start[here], q.class_size[window[here]])
                        first = int(shard.begin[d])
                        hits[d] = [{"s": a - first, "e": b - first} for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                    for side, w, at in ((0, window, start), (1, near, near_at)):
                        if len(w):
                            for d, c in np.unique(np.stack((shard.doc(at), w)), axis=1).T.tolist():
                                ids.setdefault(d, (set(), set()))[side].update(q.owners_by_class[q.class_begin[c] : q.class_begin[c + 1]].tolist())
                    if ids:
                        docs_hit = sorted(ids)
                        names = [[sorted({q.items[i] for i in ids[d][side]} - {None}) for d in docs_hit] for side in (0, 1)]
                        interval = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                        yield pa.RecordBatch.from_arrays([pa.array([one.column(0)[0].as_py()] * len(docs_hit), pa.int64()), pa.array(docs_hit, pa.int32()), pa.array([hits.get(d, []) for d in docs_hit], interval), pa.array(names[0], pa.list_(pa.string())), pa.array(names[1], pa.list_(pa.string()))], names=["shard", "place", "hits", "items", "near_items"])
            give_back()

        part = index.select("shard", "n_words", "terms", "counts", "positions").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    # Rows without any match are not in found; those of several blocks are put together by the row's place.
    lists = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hits", "items", "near_items")]
    found = found.groupBy("shard", "place").agg(*lists)
    empty = {"hits": F.array().cast("array<struct<s:bigint,e:bigint>>"), "items": F.array().cast("array<string>"), "near_items": F.array().cast("array<string>")}
    return rows.join(found, ["shard", "place"], "left").select(id_col, "n_words", *[F.coalesce(c, none).alias(c) for c, none in empty.items()])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs; rows with a null or
    empty text stay. Each block of the benchmark is a filter after the one before, on postings that are
    made as the texts pass by and looked up as those of the stored index: no shuffle, no join. A
    window's terms are ranked by their counts in docs. What is left is written after every CHAINED blocks,
    so that a task never holds more than these."""
    out, place, written = docs, docs.columns.index(text_col), None
    ship_package(docs.sparkSession)
    for number, queries in enumerate(_blocks(benchmark, item_col, item_text_col)):
        if number and number % CHAINED == 0:
            out = materialize(out, "clean")
            discard(written)
            written = out
        block = docs.sparkSession.sparkContext.broadcast(queries)

        def fill(table: np.ndarray, batches: Iterator[pa.RecordBatch], block=block) -> None:
            for batch in sliced(batches, text_col):
                hashes, _, _, _ = words(*text_bytes(batch.column(0)), IS_WORD)
                _, term = block.value.lookup(hashes)
                table[: len(block.value.terms)] += np.bincount(term, minlength=len(block.value.terms))

        queries.rank(sum_tables(docs.select(text_col), fill, max(1, len(queries.terms))))
        block.unpersist()

        def run(batches: Iterator[pa.RecordBatch], shared=docs.sparkSession.sparkContext.broadcast(queries)) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, text_col):
                hashes, text, _, _ = words(*text_bytes(batch.column(place)), IS_WORD)
                shard = Shard.of_words(shared.value, hashes, np.bincount(text, minlength=batch.num_rows))
                _, start, _, _ = shard.matches()
                clean = np.ones(batch.num_rows, bool)
                clean[shard.doc(start)] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def hit_words(hits: F.Column) -> F.Column:
    """How many words a document's intervals cover together."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("total"))
    return F.aggregate(F.array_sort(hits), start, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["total"] + F.greatest(F.lit(0).cast("bigint"), x["e"] - F.greatest(a["end"], x["s"]))).alias("total")), lambda a: a["total"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated, and n_near_items of each document."""
    found = search(docs, benchmark, id_col)
    n_hit = hit_words(F.col("hits"))
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near_items").cast("bigint").alias("n_near_items"))
