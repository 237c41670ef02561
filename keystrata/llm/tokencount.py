"""Token counts by rank-synchronous merging of pre-tokens held as ragged numpy arrays.

Counts what a piece model with byte fallback gives for a text, without building its tokens: a batch
of different pre-tokens lies in one array of symbols with offsets; in each round every pre-token
that still has a pair to merge merges its best one (the highest score, the leftmost of equals), all
at once; the symbols left over at the end are counted, an unknown character as its bytes. Long
pre-tokens merge all pairs of their best rank in a round and touch only the places concerned, so the
time for a text without spaces is near linear.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keystrata.llm.arrowtext import own_memory
from keystrata.runtime import ship_package

SPACE = "▁"
MEMO_ENTRIES = 1 << 20
BATCH_PRETOKENS = 1 << 16
#: Pre-tokens of more characters are merged one at a time, all pairs of a rank in a round.
LONG = 768
#: Rounds that may end early before the rest is merged pair by pair.
CUT_ROUNDS = 50
_NONE = np.iinfo(np.int64).max


def utf8_length(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


class PieceCounter:
    """Counts for a model that neither normalises texts nor trims white space and puts a space in front.

    A pair of symbols is known by the ids of its two strings; `pairs` is a sorted array of
    left id << 32 | right id, with the order of its merge and the id of what it makes.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = processor.get_piece_size()
        special = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i) for i in range(size)]
        pieces = {processor.id_to_piece(i): processor.get_score(i) for i in range(size) if not special[i]}
        if processor.decode(processor.encode(" a  b ")) != " a  b " or processor.encode("a", out_type=str)[0][0] != SPACE:
            raise ValueError("this model changes white space, which the counter does not reproduce")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("this model has pieces that go on after a space, so texts cannot be cut there")
        self.breaks = not any("\n" in p for p in pieces)
        self.symbol_ids: dict[str, int] = {}
        for p in pieces:
            self.symbol_ids.setdefault(p, len(self.symbol_ids))
        for p in pieces:
            for c in p:
                self.symbol_ids.setdefault(c, len(self.symbol_ids))
        self.symbol_of = np.full(0x110000, len(self.symbol_ids), np.int32)  # by character; the last id is any unknown one
        for c, i in self.symbol_ids.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.weights = np.ones(len(self.symbol_ids) + 1, np.int64)
        for c, i in self.symbol_ids.items():
            if c not in pieces:
                self.weights[i] = len(c.encode())
        # Equal scores are equal ranks: among them the leftmost pair goes first.
        rank_of = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        keys, ranks, made = [], [], []
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                left, right = self.symbol_ids.get(p[:cut]), self.symbol_ids.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank_of[score])
                    made.append(self.symbol_ids[p])
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(ranks, np.int64)[order]
        self.pair_made = np.array(made, np.int64)[order]
        self.memo: dict[str, int] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_ranks[at], _NONE), self.pair_made[at]

    def merged_counts(self, pretokens: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token, in rounds of simultaneous merges."""
        n = len(pretokens)
        lengths = np.fromiter(map(len, pretokens), np.int64, n)
        code = np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol_of[code].astype(np.int64)
        owner = np.repeat(np.arange(n), lengths)
        totals = np.bincount(owner, np.where(symbols == len(self.weights) - 1, utf8_length(code) - 1, 0), n).astype(np.int64)
        while len(symbols):
            pair = owner[:-1] == owner[1:]
            left = np.flatnonzero(pair)
            ranks, made = self._lookup(symbols[left], symbols[left + 1])
            live = ranks != _NONE
            left, ranks, made = left[live], ranks[live], made[live]
            active = np.zeros(n, bool)
            active[owner[left]] = True
            keep = active[owner]
            if not keep.all():  # finished sequences leave the arrays
                done = ~keep
                totals += np.bincount(owner[done], self.weights[symbols[done]], n).astype(np.int64)
                moved = np.cumsum(keep) - 1
                left = moved[left]
                symbols, owner = symbols[keep], owner[keep]
                if not len(symbols):
                    break
            best = np.lexsort((left, ranks, owner[left]))
            o = owner[left][best]
            first = np.ones(len(o), bool)
            first[1:] = o[1:] != o[:-1]
            chosen = best[first]
            symbols[left[chosen]] = made[chosen]
            keep = np.ones(len(symbols), bool)
            keep[left[chosen] + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return totals

    def long_count(self, pretoken: str) -> int:
        """The number of tokens of one long pre-token. Each round merges all pairs of the lowest rank that is left,
        the leftmost of those that overlap; pairs are kept by rank, so a round looks at its own places only.

        Merging them at once is merging them one by one from the left, unless a merge makes a pair that
        goes before the next one (a rank as low or lower): the round then ends with that merge.
        """
        code = np.frombuffer(pretoken.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        sym = np.append(self.symbol_of[code].astype(np.int64), -1)  # what is beyond either end pairs with nothing
        extra = int((utf8_length(code) - 1)[sym[:n] == len(self.weights) - 1].sum())
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n, bool)
        rank, makes = np.full(n + 1, _NONE), np.zeros(n + 1, np.int64)  # of the pair that begins at a place
        rank[: n - 1], makes[: n - 1] = self._lookup(sym[: n - 1], sym[1:n])
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, cuts) if len(at) else ():
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        note(np.arange(n - 1))
        cut_short = 0
        while ranks:
            if cut_short > CUT_ROUNDS:
                return self._one_by_one(sym, after, before, alive, rank, makes) + extra
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
            index = np.arange(len(at))
            chosen = at[(index - np.maximum.accumulate(np.where(joined, 0, index))) % 2 == 0]
            x, right = makes[chosen], after[chosen]
            beyond, left = after[right], before[chosen]
            behind = np.concatenate(([False], right[:-1] == left[1:]))  # what stands to the left was made in this round
            left[behind] = chosen[:-1][behind[1:]]
            left_sym = sym[left]
            left_sym[behind] = x[:-1][behind[1:]]
            left_rank, left_makes = self._lookup(left_sym, x)
            right_rank, right_makes = self._lookup(x, sym[beyond])
            early = (left_rank <= r) | (right_rank <= r)
            if early.any():
                k = int(np.argmax(early)) + 1
                if k < len(chosen):
                    cut_short += 1
                    places[r] = [at[at > chosen[k - 1]]]
                    heapq.heappush(ranks, r)
                chosen, x, right, beyond, left = chosen[:k], x[:k], right[:k], beyond[:k], left[:k]
                left_rank, left_makes, right_rank, right_makes = left_rank[:k], left_makes[:k], right_rank[:k], right_makes[:k]
            sym[chosen] = x
            alive[right] = False
            rank[right] = _NONE
            after[chosen] = beyond
            before[beyond] = chosen
            rank[chosen], makes[chosen] = right_rank, right_makes
            some = left >= 0
            rank[left[some]], makes[left[some]] = left_rank[some], left_makes[some]
            note(np.unique(np.concatenate((chosen, left[some]))))
        return int(self.weights[sym[:n][alive]].sum()) + extra

    def _one_by_one(self, sym: np.ndarray, after: np.ndarray, before: np.ndarray, alive: np.ndarray, rank: np.ndarray, makes: np.ndarray) -> int:
        """The rest of long_count where nearly every merge makes a pair that goes before the next one, as in
        long runs of spaces: single merges in the order of a heap."""
        sym, after, before, alive, rank, makes = (a.tolist() for a in (sym, after, before, alive, rank, makes))
        none = int(_NONE)
        heap = [(r, i) for i, r in enumerate(rank) if r != none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def pair(i: int, j: int) -> None:
            key = (sym[i], sym[j])
            if key not in known:
                found, made = self._lookup(np.array([sym[i]]), np.array([sym[j]]))
                known[key] = int(found[0]), int(made[0])
            rank[i], makes[i] = known[key]
            if rank[i] != none:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            k = after[j]
            sym[i], after[i], before[k], alive[j], rank[j] = makes[i], k, i, False, none
            pair(i, k)
            if before[i] >= 0:
                pair(before[i], i)
        return int(self.weights[np.array(sym[:-1])[np.array(alive)]].sum())

    def cut(self, text: str) -> list[str]:
        """Pre-tokens that no merge crosses: cut before a space that follows something else, and around line ends."""
        if not text:
            return []
        found = (" " + text).replace(SPACE, " ").replace(" ", SPACE)
        return (_PRETOKENS if self.breaks else _PRETOKENS_WHOLE_LINES).findall(found)

    def counts(self, texts: list[str | None]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        cuts = [self.cut(t or "") for t in texts]
        missing = {p for c in cuts for p in c if p not in memo}
        memo.update((p, self.long_count(p)) for p in missing if len(p) > LONG)
        missing = list(missing)
        short = [p for p in missing if len(p) <= LONG]
        for at in range(0, len(short), BATCH_PRETOKENS):
            part = short[at : at + BATCH_PRETOKENS]
            memo.update(zip(part, self.merged_counts(part).tolist(), strict=True))
        out = [sum(map(memo.__getitem__, c)) for c in cuts]
        for p in missing:
            if len(p) > 64:
                del memo[p]
        return out


_PRETOKENS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_PRETOKENS_WHOLE_LINES = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _counter(model: bytes) -> PieceCounter:
    key = hashlib.sha256(model).hexdigest()
    held = own_memory("tokencount")
    if key not in held:
        held.clear()
        held[key] = PieceCounter(model)
    return held[key]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_bytes, n_tokens, over_limit (more than limit tokens).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results; other columns
    are not read. No shuffle. The model file (a parameter, under 1 MB) is sent to the executors.
    """
    from keystrata.llm.arrowtext import sliced, text_bytes

    spark = docs.sparkSession
    ship_package(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in sliced(batches, text_col, owner="tokencount"):
            _, offsets = text_bytes(batch.column(1))
            n = np.array(counter.counts(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint, over_limit boolean")
