"""B1: exact byte-level BPE training in a few rounds over all distinct words.

One merge a job would take thousands of jobs for a vocabulary of 8,192.  Instead, in every round

* one job counts all pairs and returns the first of them in the order of sequential BPE (count descending,
  then left and right id), the candidates;
* one job cuts all distinct words wherever two neighbours are no candidate, and counts equal stretches.  They are
  far fewer than the words, because what is rare in a word cuts it.  As many candidates are taken as keep the
  distinct stretches within a bound, which a job estimates for several numbers of candidates at once;
* the driver trains on the stretches, one merge at a time, for as long as the next merge does not come after the
  last candidate;
* every task applies these merges to its share of the words, which lie in arrays of symbols.  Ranks never fall
  while a word is encoded, so each word takes its own lowest merge in every pass, and a round takes as many
  passes as a word takes merges.

The result is that of one merge at a time.  All places of a candidate lie in stretches, so its count there is
exact.  Where a word was cut there stands a pair that comes after the last candidate, and nothing that may stand there
later comes before it: counts of old pairs only fall, each place of a pair with a new symbol is one of the old pair
between the same neighbours, and new symbols have higher ids than the old ones they replace.

What reaches the driver is bounded, whatever the words: candidates and distinct stretches.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

N_BYTES = 256
#: Distinct stretches that the driver trains on in a round, about, and candidates, at most.
HEAD_WORDS, CANDIDATES = 1 << 18, 1 << 16
#: Merges of a round, at most.
BATCH = 1 << 13
#: The smallest hashes that a task returns of its stretches, from which their number is estimated.
SKETCH = 256
#: Symbols of a block of words, and distinct words of a task, about.
BLOCK, SHARE = 1 << 20, 1 << 15

Pair = tuple[int, int]
#: Bits of a symbol in a packed key ``step, left, right``.
BITS = 24
MASK = (1 << BITS) - 1


class Ranking:
    """The pair that comes next: the highest count, then the smallest left and right symbol."""

    def __init__(self, counts: dict[Pair, int]):
        self.counts = defaultdict(int, {p: n for p, n in counts.items() if n > 0})
        self.heap = [(-n, p) for p, n in self.counts.items()]
        heapq.heapify(self.heap)

    def change(self, changes: Iterable[tuple[Pair, int]]) -> None:
        for p, n in changes:
            self.counts[p] += n
            if self.counts[p] > 0:
                heapq.heappush(self.heap, (-self.counts[p], p))

    def best(self) -> tuple[Pair, int] | None:
        while self.heap:
            n, p = self.heap[0]
            if self.counts[p] == -n:
                return p, -n
            heapq.heappop(self.heap)                     # an older count of this pair
        return None


def _summed(keys, amounts):
    """Distinct keys and the sum of the amounts of each."""
    import numpy as np
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(amounts[order], first) if len(first) else amounts[:0]


def _every_other(at, following):
    """Of sorted places those that are taken left to right, where a place may be the following one of
    the place before it (a run of one symbol)."""
    import numpy as np
    i = np.arange(len(at))
    begins = np.ones(len(at), bool)
    begins[1:] = at[1:] != following[:-1]
    return (i - np.maximum.accumulate(np.where(begins, i, 0))) % 2 == 0


def merge_words(symbols, freqs, pairs: list[Pair], first_id: int, since: int | None = 0, applied=None):
    """Words ``symbols`` (each ended by -1) after the merges, in order, and what each merge from number
    ``since`` on (None: none) does to the pair counts: ``(symbols, freqs, keys, changes)``, keys packed from
    (step, left, right).  The words come in another order.  ``applied`` is raised by how often each merge is applied."""
    import numpy as np
    left, right = np.array(pairs, np.int64).reshape(-1, 2).T
    n_ids = first_id + len(pairs)
    starts, ends = np.zeros(n_ids + 1, bool), np.zeros(n_ids + 1, bool)         # the last entry is that of -1
    starts[left], ends[right] = True, True
    wanted = left << BITS | right
    order = np.argsort(wanted)
    wanted = wanted[order]
    ready, found = [], []

    def noted(at, steps, sign):
        """The pairs that begin at these places."""
        at = at[(at >= 0) & (at < len(symbols) - 1)]
        at = at[(symbols[at] >= 0) & (symbols[at + 1] >= 0)]
        word = np.searchsorted(stops, at)
        told = steps[word] >= since
        at, word = at[told], word[told]
        key = (steps[word] - since) << 2 * BITS | symbols[at].astype(np.int64) << BITS | symbols[at + 1]
        found.append((key, sign * freqs[word]))

    while True:
        at = np.flatnonzero(starts[symbols[:-1]] & ends[symbols[1:]])
        keys = symbols[at].astype(np.int64) << BITS | symbols[at + 1]
        place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        hit = wanted[place] == keys
        at, step = at[hit], order[place[hit]]
        if not len(at):
            ready.append((symbols, freqs))
            break
        stops = np.flatnonzero(symbols < 0)
        word = np.searchsorted(stops, at)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        active = np.zeros(len(stops), bool)
        active[word[first]] = True
        lowest = np.minimum.reduceat(step, first)        # of every active word
        at = at[step == np.repeat(lowest, np.diff(first, append=len(at)))]
        of_active = np.repeat(active, np.diff(stops, prepend=-1))
        ready.append((symbols[~of_active], freqs[~active]))
        at = (np.cumsum(of_active) - 1)[at]
        symbols, freqs = symbols[of_active], freqs[active]
        stops = np.flatnonzero(symbols < 0)
        at = at[_every_other(at, at + 1)]
        if applied is not None:
            word = np.searchsorted(stops, at)
            np.add.at(applied, lowest[word], freqs[word])
        if since is not None:
            noted(np.unique(np.concatenate((at - 1, at, at + 1))), lowest, -1)
        symbols[at] = first_id + lowest[np.searchsorted(stops, at)]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols = symbols[stays]
        stops = np.flatnonzero(symbols < 0)
        if since is not None:
            now = at - np.arange(len(at))
            noted(np.unique(np.concatenate((now - 1, now))), lowest, 1)
    symbols, freqs = map(np.concatenate, zip(*ready))
    keys, changes = _summed(*map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return symbols, freqs, keys[changes != 0], changes[changes != 0]


class Head:
    """Words for the guesses: symbols as linked lists in arrays, and for every pair the places that may hold it."""

    def __init__(self, symbols, freqs):
        import numpy as np
        self.symbols, n = symbols.copy(), len(symbols)
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.freqs, self.word = freqs, np.repeat(np.arange(len(freqs), dtype=np.int32), np.diff(np.flatnonzero(symbols < 0), prepend=-1))
        self.places: dict[int, list] = defaultdict(list)
        for i in range(0, n - 1, BLOCK):
            self._note(*self._pairs(np.arange(i, min(i + BLOCK, n - 1), dtype=np.int32)))

    def _pairs(self, at):
        """Those of the places that begin a pair, and the pairs' keys."""
        import numpy as np
        at = at[(at >= 0) & (at < len(self.symbols) - 1)]
        at = at[self.symbols[at] >= 0]
        at = at[self.symbols[self.after[at]] >= 0]
        return at, self.symbols[at].astype(np.int64) << BITS | self.symbols[self.after[at]]

    def _note(self, at, keys) -> None:
        import numpy as np
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        for key, i, j in zip(keys[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            self.places[key].append(at[i:j])

    def merge(self, pair: Pair, new: int):
        """Replace the pair by ``new``; keys and changes of the pair counts."""
        import numpy as np
        a, b = pair
        at = np.unique(np.concatenate(self.places.pop(a << BITS | b, None) or [np.zeros(0, np.int32)]))
        at = at[self.symbols[at] == a]
        at = at[self.symbols[self.after[at]] == b]
        if a == b:
            at = at[_every_other(at, self.after[at])]
        follows = self.after[at]
        old, lost = self._pairs(np.unique(np.concatenate((self.before[at], at, follows))))
        self.symbols[at], self.symbols[follows] = new, -2
        self.after[at] = self.after[follows]
        self.before[self.after[at]] = at
        now, won = self._pairs(np.unique(np.concatenate((self.before[at], at))))
        self._note(now, won)
        return _summed(np.concatenate((lost, won)), np.concatenate((-self.freqs[self.word[old]], self.freqs[self.word[now]])))


def _long_words(symbols, freqs):
    """The words that still hold a pair."""
    import numpy as np
    lengths = np.diff(np.flatnonzero(symbols < 0), prepend=-1) - 1
    return symbols[np.repeat(lengths > 1, lengths + 1)], freqs[lengths > 1]


def as_symbols(words: list[bytes], freqs, kind="u1"):
    """Words as bytes that hold symbols of a kind, as ``(symbols, freqs)``."""
    import numpy as np
    lengths = np.fromiter(map(len, words), np.int64, len(words)) // np.dtype(kind).itemsize
    symbols = np.full(int(lengths.sum()) + len(words), -1, np.int32)
    stays = np.ones(len(symbols), bool)
    stays[np.cumsum(lengths + 1) - 1] = False
    symbols[stays] = np.frombuffer(b"".join(words), kind)
    return symbols, freqs


def _blocks(batches):
    import numpy as np
    for b in batches:
        for s, f in zip(b.column("symbols"), b.column("freqs")):
            yield np.frombuffer(s.as_buffer(), np.int32), np.frombuffer(f.as_buffer(), np.int64)


def _packed(blocks):
    import pyarrow as pa
    for symbols, freqs in blocks:
        yield pa.RecordBatch.from_pydict({"symbols": pa.array([symbols.tobytes()], pa.binary()), "freqs": pa.array([freqs.tobytes()], pa.binary())})


def _initial(words: DataFrame) -> DataFrame:
    """``(symbols, freqs)``: blocks of words, symbols as packed 32-bit numbers."""
    def pack(batches):
        import numpy as np

        def blocks():
            held, size = [], 0
            for b in batches:
                held.append(as_symbols(b.column("word").to_pylist(), b.column("freq").to_numpy(zero_copy_only=False)))
                size += len(held[-1][0])
                if size >= BLOCK:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held, size = [], 0
            if held:
                yield tuple(map(np.concatenate, zip(*held)))
        yield from _packed(blocks())
    return words.mapInArrow(pack, "symbols binary, freqs binary")


def _pairs(symbols):
    """The places where a pair begins, and the pairs' keys."""
    import numpy as np
    at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
    return at, symbols[at].astype(np.int64) << BITS | symbols[at + 1]


def _counted(symbols, freqs):
    """Distinct pairs and their counts."""
    import numpy as np
    at, keys = _pairs(symbols)
    return _summed(keys, freqs[np.searchsorted(np.flatnonzero(symbols < 0), at)])


def _candidates(words: DataFrame):
    """Keys of the pairs that come first, in order, and their counts."""
    def go(batches):
        import pyarrow as pa
        for symbols, freqs in _blocks(batches):
            keys, n = _counted(symbols, freqs)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(keys), "n": pa.array(n)})
    table = (words.mapInArrow(go, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "pair").limit(CANDIDATES).toArrow())
    return table.column("pair").to_numpy(), table.column("n").to_numpy()


def _ranks(symbols, ranked):
    """For every place but the last, the rank of the pair that begins there (none: their number)."""
    import numpy as np
    order = np.argsort(ranked)
    keys = symbols[:-1].astype(np.int64) << BITS | symbols[1:]     # below 0 at the end of a word
    place = np.minimum(np.searchsorted(ranked, keys, sorter=order), len(ranked) - 1)
    return np.where(ranked[order[place]] == keys, order[place], len(ranked))


def _stretches(symbols, freqs, ranks, k: int):
    """The longest parts of words whose pairs are all of the first k: their symbols, where each begins, and
    its word's frequency."""
    import numpy as np
    joined = np.zeros(len(symbols) + 1, bool)            # with the symbol before
    joined[1:-1] = ranks < k
    inside = joined[:-1] | joined[1:]
    begins = inside & ~joined[:-1]
    word = np.searchsorted(np.flatnonzero(symbols < 0), np.flatnonzero(begins))
    return symbols[inside], np.flatnonzero(begins[inside]), freqs[word]


def _hashes(symbols, first):
    """Distinct hashes of the stretches, ascending."""
    import numpy as np
    if not len(first):
        return np.zeros(0, np.uint64)
    at = np.arange(len(symbols)) - np.repeat(first, np.diff(first, append=len(symbols)))
    x = (at.astype(np.uint64) << np.uint64(32) | symbols.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return np.unique(np.add.reduceat(x ^ x >> np.uint64(31), first))


def _fitting(words: DataFrame, ranked, sizes: list[int], most: int) -> int:
    """The last of the sizes, ascending, up to which that many candidates leave about ``most`` distinct stretches
    or fewer; the first one in any case."""
    def go(batches):
        import numpy as np
        import pyarrow as pa
        lowest = [np.zeros(0, np.uint64) for _ in sizes]
        for symbols, freqs in _blocks(batches):
            ranks = _ranks(symbols, ranked)
            for i, k in enumerate(sizes):
                lowest[i] = np.union1d(lowest[i], _hashes(*_stretches(symbols, freqs, ranks, k)[:2])[:SKETCH])[:SKETCH]
        for i, found in enumerate(lowest):
            yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(found), i, np.int32)), "hash": pa.array(found.view(np.int64))})
    import numpy as np
    table = words.mapInArrow(go, "size int, hash long").toArrow()
    at, hashes = table.column("size").to_numpy(), table.column("hash").to_numpy().view(np.uint64)
    best = sizes[0]
    for i, k in enumerate(sizes):
        lowest = np.unique(hashes[at == i])[:SKETCH]
        if (len(lowest) if len(lowest) < SKETCH else (SKETCH - 1) * 2.0 ** 64 / float(lowest[-1])) > most:
            break
        best = k
    return best


def _distinct_stretches(words: DataFrame, ranked):
    """``(symbols, freqs)`` of the distinct stretches that the pairs make."""
    def go(batches):
        import numpy as np
        import pyarrow as pa
        for symbols, freqs in _blocks(batches):
            inside, first, n = _stretches(symbols, freqs, _ranks(symbols, ranked), len(ranked))
            ends = pa.py_buffer(4 * np.append(first, len(inside)).astype(np.int32))
            parts = pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(inside)])
            table = pa.table({"word": parts, "freq": n}).group_by("word").aggregate([("freq", "sum")])
            yield from table.select(["word", "freq_sum"]).rename_columns(["word", "freq"]).to_batches()
    table = words.mapInArrow(go, "word binary, freq long").groupBy("word").agg(F.sum("freq").alias("freq")).toArrow()
    return as_symbols(table.column("word").to_pylist(), table.column("freq").to_numpy(), "i4")


def _merged(words: DataFrame, pairs: list[Pair], first_id: int) -> DataFrame:
    """Words after the merges; words of one symbol hold no pair any more and go."""
    def go(batches):
        yield from _packed(_long_words(*merge_words(s, f, pairs, first_id, None)[:2]) for s, f in _blocks(batches))
    return words.mapInArrow(go, "symbols binary, freqs binary")


def _next_merges(stretches, last: tuple[int, int] | None, first_id: int, most: int, min_count: int) -> list[tuple[int, int, int]]:
    """``(left, right, count)`` of the merges that sequential BPE takes, up to the last candidate ``(-count, key)``."""
    keys, counts = _counted(*stretches)
    exact, head, out = Ranking({(key >> BITS, key & MASK): n for key, n in zip(keys.tolist(), counts.tolist())}), Head(*stretches), []
    while len(out) < most and (top := exact.best()):
        (a, b), n = top
        if n < min_count or last is not None and (-n, a << BITS | b) > last:
            break
        keys, changes = head.merge((a, b), first_id + len(out))
        exact.change(((key >> BITS, key & MASK), change) for key, change in zip(keys.tolist(), changes.tolist()))
        out.append((a, b, n))
    return out


def bpe_train(hist: DataFrame, vocab_size: int, n_special: int, min_count: int = 1,
              head_words: int = HEAD_WORDS, batch: int = BATCH) -> DataFrame:
    """``merges(rank, left, right, token_id, count)`` learned from ``hist (pretoken, freq)``.

    ``vocab_size`` counts the 256 bytes, the merges and the specials; training stops early when
    no pair occurs ``min_count`` times.  Ties: count descending, then left and right id.  ``head_words`` and
    ``batch`` bound the distinct stretches and the merges of a round; they do not change the result.
    """
    spark = hist.sparkSession
    ensure_checkpoint_dir(spark)
    n_merges = max(0, vocab_size - n_special - N_BYTES)
    long_words = hist.select(F.col("pretoken").cast("binary").alias("word"), F.col("freq").cast("long").alias("freq")).where("octet_length(word) > 1")
    shares = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + long_words.count() // SHARE)
    words = _initial(long_words.repartition(shares)).checkpoint()
    merges: list[tuple[int, int, int]] = []
    size = 4
    while len(merges) < n_merges:
        ranked, counts = _candidates(words)
        if not len(ranked) or counts[0] < min_count:
            break
        size = _fitting(words, ranked, sorted({min(max(1, k), len(ranked)) for k in (size // 4, *(size << i for i in range(5)), CANDIDATES)}), head_words)
        whole = size == len(ranked) < CANDIDATES         # no pair is left out
        found = _next_merges(_distinct_stretches(words, ranked[:size]), None if whole else (-int(counts[size - 1]), int(ranked[size - 1])),
                             N_BYTES + len(merges), min(batch, n_merges - len(merges)), min_count)
        first_id = N_BYTES + len(merges)
        merges += found
        if len(merges) < n_merges:
            words = _merged(words, [(a, b) for a, b, _ in found], first_id).checkpoint()
    return spark.createDataFrame([(r, a, b, N_BYTES + r, n) for r, (a, b, n) in enumerate(merges)],
                                 "rank int, left int, right int, token_id int, count bigint")
