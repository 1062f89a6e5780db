"""Language-model scoring with a hashed maximum-entropy model.

The model: p(word | context) = p(class | context) p(unit | class) p(word | unit).

* Units are the frequent words; the other words, seen or not, share units by their last bytes.
* Classes are a clustering of the units by the frequent words they follow, so that words of one
  kind (for instance one language) share classes.
* p(class | context) is a maximum-entropy model (softmax) over hashed features: the word before,
  the two words before together (n-grams), and the second and third word before (skips).
* p(unit | class) and p(word | unit) follow training counts plus one, with one unknown word in
  each unit, so the probabilities of all words and the unknown sum to one.

Work on the corpus, each one pass of Spark tasks over the training or all documents:

1. count all words (combined in each task, then summed over a shuffle);
2. count how often each unit follows each of the most frequent words;
3. gradient updates in a few rounds: every task starts from the shared weights, updates them by
   minibatches over all its documents, and over a shuffle the changes of each row are averaged by
   the positions that used the row, so tasks that never met it do not count;
4. score: numpy batches gather the rows of the few features that are active in each position.

Only model tables of fixed size pass the driver: ``LOOKUP`` words with counts, unit tables and
weights.  Counts of the rarer words stay distributed: a document's rare words meet them in a join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_automaton import _pieces
from .common import column, cut, text_or_empty

#: Words whose counts every task knows, words that are units, units shared by word endings.
LOOKUP, UNITS, ENDINGS = 1 << 18, 1 << 15, 1 << 11
#: Frequent words that describe a unit, classes, hash rows for each kind of feature.
ANCHORS, GROUPS, CLASSES, ROWS, FEATURES = 32, 16, 32, 1 << 13, 4
#: Text bytes that a task holds as words at a time, positions of a minibatch, step size, rounds.
PIECE, MINIBATCH, RATE, EPOCHS = 1 << 20, 2048, 1.0, 3
#: Uses that a row's step size starts from, and uses after which a row has settled in a round.
EARLY, SETTLED = 20.0, 150.0
#: Rows of a table in one shuffled block.
BLOCK = 256


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def ending_column(word: str) -> F.Column:
    return (F.crc32(F.substring(F.col(word), -3, 3)) % ENDINGS).cast("int")


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_runs(text: str) -> Iterator[list[bytes]]:
    """Words of a text, lower-cased A-Z, in lists of about ``PIECE`` bytes."""
    # bytes.lower() changes A-Z only; bytes.split() cuts at space and U+0009 to U+000D.
    data, at = text.encode("utf-8", "replace").lower(), 0
    while at < len(data):
        m = _SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        to = m.end() if m else len(data)
        yield data[at:to].split()
        at = to


#: Text bytes that a task cuts into words at a time; longer texts go in runs of ``PIECE`` bytes.
GATHERED = 8 << 20


def gathered(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts (column ``at``), each taken as 64 bytes more, hold about
    ``GATHERED`` bytes; one row at least."""
    held, size = [], 0
    for whole in batches:
        for b in _pieces(whole, at, GATHERED):
            n = pc.sum(pc.binary_length(b.column(at))).as_py() + 64 * b.num_rows
            if held and size + n > GATHERED:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(b)
            size += n
    if held:
        yield pa.concat_batches(held)


def word_arrays(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Words of the texts in order, as ``word_runs`` cuts them, and the number of each word's text."""
    long = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > GATHERED)
    begin = 0
    for i in [*long.tolist(), len(texts)]:
        short = texts.slice(begin, i - begin)
        split = pc.ascii_split_whitespace(pc.ascii_lower(short))  # the white space of bytes.split()
        owner = np.repeat(np.arange(begin, i), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        words = split.flatten().cast(pa.binary())
        some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # not before or after white space
        if not some.all():
            owner, words = owner[some], words.filter(pa.array(some))
        if len(words):
            yield owner, words
        for run in word_runs(texts[i].as_py()) if i < len(texts) else ():
            if run:
                yield np.full(len(run), i), pa.array(run, pa.binary())
        begin = i + 1


@dataclass
class Vocabulary:
    """The looked-up words by descending count; the first ``n_units`` are units of their own."""

    words: list[bytes]
    counts: np.ndarray
    n_units: int

    def __post_init__(self):
        self.known = pa.array(self.words, pa.binary())
        self.unit = np.arange(len(self.words) + 1, dtype=np.uint16)  # one spare for index -1
        for i in range(self.n_units, len(self.words)):
            self.unit[i] = self.n_units + ending(self.words[i])
        self.logs = np.log10(np.append(self.counts, 0) + 1.0)
        self.end = self.n_units + ENDINGS
        self.start = self.end + 1
        self.size = self.end + 1

    def __getstate__(self):
        return b" ".join(self.words), self.counts, self.n_units

    def __setstate__(self, state):
        self.words, self.counts, self.n_units = state[0].split(), state[1], state[2]
        self.__post_init__()

    def encode(self, texts: pa.Array) -> list[pa.Array]:
        """For each text: units of its words (16 bits each), the number of words and of those looked up,
        the sums of log10(count + 1) over looked-up words that are units and that are not, and the
        other words with their numbers."""
        n = len(texts)
        units, words, known, own, shared = [], np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        rare_owner, rare_word, rare_times = [], [], []
        for owner, run in word_arrays(texts):
            ids = pc.fill_null(pc.index_in(run, value_set=self.known), -1).to_numpy().astype(np.int64)
            u, missed = self.unit[ids], np.flatnonzero(ids < 0)
            others = run.take(pa.array(missed)).dictionary_encode()
            kind, different = others.indices.to_numpy().astype(np.int64), others.dictionary
            u[missed] = np.array([self.n_units + ending(w) for w in different.to_pylist()], np.uint16)[kind]
            units.append(u)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            docs, logs, is_unit = owner[first], self.logs[ids], ids < self.n_units
            words[docs] += np.diff(np.append(first, len(owner)))
            known += np.bincount(owner[ids >= 0], minlength=n)
            own[docs] += np.add.reduceat(logs * is_unit, first)  # the logarithm of a word not looked up is zero
            shared[docs] += np.add.reduceat(logs * ~is_unit, first)
            if len(missed):
                pairs, times = np.unique(owner[missed] * len(different) + kind, return_counts=True)
                rare_owner.append(pairs // len(different))
                rare_word.append(different.take(pa.array(pairs % len(different))))
                rare_times.append(times)

        def lists(kind: pa.DataType, sizes: np.ndarray, data: np.ndarray) -> pa.Array:
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(ends), pa.py_buffer(data)])

        packed = np.concatenate([np.zeros(0, np.uint16), *units])
        rare = pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], pa.binary()), *rare_word]),
                                           pa.array(np.concatenate([np.zeros(0, np.int64), *rare_times]))], names=["word", "n"])
        each = np.bincount(np.concatenate([np.zeros(0, np.int64), *rare_owner]), minlength=n)
        starts = pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32))
        return [lists(pa.binary(), words * 2, packed), *map(pa.array, (words, known, own, shared)), pa.ListArray.from_arrays(starts, rare)]


def positions(voc: Vocabulary, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Units of several documents in a row, each with three start marks before and an end after
    it, and the positions to predict (words and ends)."""
    start, end = np.full(3, voc.start, dtype=np.uint16), np.array([voc.end], dtype=np.uint16)
    units = np.concatenate([x for p in packed for x in (start, np.frombuffer(p, dtype=np.uint16), end)])
    return units, np.flatnonzero(units != voc.start)


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93],
                 dtype=np.uint64)


def active_rows(units: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash rows of the features of the positions ``at``: word before, two words before together,
    second word before, third word before; each kind has ``ROWS`` rows of its own."""
    a, b, c = (units[at - k].astype(np.uint64) for k in (1, 2, 3))  # units may be a whole piece, of which ``at`` is little
    bits = np.uint64(64 - ROWS.bit_length() + 1)
    keys = (a * _MULT[0], (a * _MULT[1]) ^ (b * _MULT[2] + _MULT[4]) * _MULT[1], b * _MULT[3], c * _MULT[4])
    return np.stack([((k * _MULT[0]) >> bits).astype(np.int32) + i * ROWS for i, k in enumerate(keys)])


def class_probabilities(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Softmax over the classes for each position, from the sum of its active rows."""
    s = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        s += np.take(weights, r, axis=0)
    s += prior
    np.clip(s, -60, 60, out=s)  # far from where float32 ends, whatever the weights
    np.exp(s, out=s)
    s *= (1 / (s @ np.ones(s.shape[1], dtype=np.float32)))[:, None]
    return s


#: Rows of a sum that are added in step with those of all other sums (a power of two).
CHUNK = 8


def segment_sums(x: np.ndarray, index: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows ``index`` of ``x``, from each of ``first`` to before the next, and which one
    each is.

    Most are sums of few rows, for which ``np.add.reduceat`` calls its loop once for each sum and
    column.  So the second rows of all sums are added together, then the third ones, up to ``CHUNK``;
    of longer sums the rows before that are added in whole chunks."""
    n = np.diff(np.append(first, len(index)))
    chunks = (n - 1) // CHUNK
    size = (n - chunks * CHUNK).astype(np.uint8)
    by = np.argsort(CHUNK - size, kind="stable")  # the longest first
    at, size = (first + chunks * CHUNK)[by], size[by]
    out = np.take(x, index[at], axis=0)
    for j in range(1, CHUNK):
        k = np.count_nonzero(size > j)
        out[:k] += np.take(x, index[at[:k] + j], axis=0)
    chunks = chunks[by]
    long = np.flatnonzero(chunks)
    if len(long):
        chunks = chunks[long]
        begin = np.cumsum(chunks) - chunks
        start = np.repeat(first[by[long]] - begin * CHUNK, chunks) + np.arange(begin[-1] + chunks[-1]) * CHUNK
        y = np.take(x, index[(start[:, None] + np.arange(CHUNK)).ravel()], axis=0)
        while len(y) > len(start):  # halves of every chunk
            y = y.reshape(len(start), 2, -1, x.shape[1])
            y = (y[:, 0] + y[:, 1]).reshape(-1, x.shape[1])
        out[long] += np.add.reduceat(y, begin, axis=0)
    return out, by


class Trainer:
    """Minibatch gradient updates of one task; a row's step shrinks with its use so far."""

    def __init__(self, weights: np.ndarray, prior: np.ndarray):
        self.w, self.prior, self.used = weights.copy(), prior, np.full(len(weights), EARLY, dtype=np.float32)

    def learn(self, units: np.ndarray, at: np.ndarray, target: np.ndarray) -> None:
        for k in range(0, len(at), MINIBATCH):
            rows, y = active_rows(units, at[k:k + MINIBATCH]), target[k:k + MINIBATCH]
            g = class_probabilities(self.w, self.prior, rows)
            g[np.arange(len(y)), y] -= 1
            # Each kind of feature has rows of its own, so all kinds are summed at once.
            r = rows.ravel()
            order = np.argsort(r.astype(np.uint16), kind="stable")  # 16 bits: a radix sort
            r = r[order]
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            step, by = segment_sums(g, np.tile(np.arange(len(y)), FEATURES)[order], first)
            hit, n = r[first[by]], np.diff(np.append(first, len(r)))[by].astype(np.float32)
            used = self.used[hit] + n
            self.used[hit] = used
            step *= (-RATE / np.sqrt(used * n))[:, None]
            step += np.take(self.w, hit, axis=0)
            self.w[hit] = step


def cluster(follows: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Class of each unit from how often it follows each anchor: k-means on the smoothed square
    roots of the shares, then every group is cut by frequency into classes of similar mass."""
    n = len(mass)
    if n <= CLASSES:
        return np.arange(n, dtype=np.int32)
    base = follows.sum(axis=0) + 1e-9
    share = (follows + 5 * base / base.sum()) / (follows.sum(axis=1, keepdims=True) + 5)
    x = np.sqrt(share) - np.sqrt(base / base.sum())
    order = np.argsort(-mass, kind="stable")
    centres = [x[order[0]]]
    far = np.full(n, np.inf)
    for _ in range(GROUPS - 1):  # the farthest heavy point next
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        centres.append(x[np.argmax(far * np.sqrt(mass + 1))])
    centres = np.array(centres)
    for _ in range(25):
        group = np.argmin(((centres ** 2).sum(axis=1) - 2 * x @ centres.T), axis=1)
        for g in range(GROUPS):
            m = (group == g) * (mass + 1)
            if m.sum():
                centres[g] = (x * m[:, None]).sum(axis=0) / m.sum()
    total, out, made = mass.sum() + n, np.zeros(n, dtype=np.int32), 0
    parts = np.array([(mass[group == g] + 1).sum() for g in range(GROUPS)])
    live = [g for g in range(GROUPS) if (group == g).any()]
    spare = CLASSES - len(live)
    for i, g in enumerate(live):
        k = 1 + (spare if i == len(live) - 1 else min(spare, round((CLASSES - len(live)) * parts[g] / total)))
        spare -= k - 1
        own = order[group[order] == g]
        run = np.cumsum(mass[own] + 1)
        out[own] = made + np.minimum((run - mass[own] - 1) * k // run[-1], k - 1).astype(np.int32)
        made += k
    return np.unique(out, return_inverse=True)[1].astype(np.int32)


def _summed(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return found.select(["word", "n_sum"]).rename_columns(["word", "n"])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n)`` over the texts of a task; a word comes again when the task met too many."""
    held, size = [], 0
    for b in gathered(batches, 0):
        for _, words in word_arrays(b.column(0)):
            found = words.value_counts()
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            size += len(found)
            if size >= 4 * LOOKUP:
                held = [_summed(held)]
                size = held[0].num_rows
                if size >= LOOKUP:  # bounded memory; the shuffle sums again
                    yield from held[0].to_batches(LOOKUP)
                    held, size = [], 0
    if held:
        yield from _summed(held).to_batches(LOOKUP)


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, n)`` over all ``rows (text)``: combined in each task, then summed."""
    return rows.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def choose_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """The vocabulary and the smallest counts of a looked-up word and of a unit.  The limits are
    set from a histogram in steps of 4 percent, so all words of one count are treated alike."""
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("s")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("s")).collect()
    limits = []
    for most in (LOOKUP, UNITS):
        least, total = 1 << 62, 0
        for r in steps:
            total += r["words"]
            if total > most:
                break
            least = r["least"]
        limits.append(least)
    known = counts.where(F.col("n") >= limits[0]).orderBy(F.desc("n"), "word").toArrow()  # at most LOOKUP rows
    n = known.column("n").to_numpy().astype(np.int64)
    return Vocabulary(known.column("word").to_pylist(), n, int((n >= limits[1]).sum())), limits[0], limits[1]


def encode_documents(rows: DataFrame, shared) -> DataFrame:
    """``rows (id, text, train)`` as units and sums, one row each, with a row number ``row``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, at = shared.value, TaskContext.get().partitionId() << 33
        for b in gathered(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(at, at + b.num_rows), pa.int64()), b.column(0), b.column(2), *voc.encode(b.column(1))],
                names=["row", "id", "train", "units", "words", "known", "own", "shared", "rare"])
            at += b.num_rows

    schema = T.StructType([T.StructField("row", T.LongType()), rows.schema["id"], T.StructField("train", T.BooleanType()),
                           T.StructField("units", T.BinaryType()), T.StructField("words", T.LongType()),
                           T.StructField("known", T.LongType()), T.StructField("own", T.DoubleType()),
                           T.StructField("shared", T.DoubleType()),
                           T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()),
                                                                           T.StructField("n", T.LongType())])))])
    return rows.select("id", "text", "train").mapInArrow(run, schema)


def _sum_blocks(parts: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """Weighted sums of ``parts (block, weight, data)``, float16 tables, by block.  A partition
    adds up what it reads, so it holds its blocks once, however many tasks sent them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for block, weight, data in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(data, dtype=np.float16).astype(np.float64) * weight
                if block in sums:
                    sums[block][0] += weight
                    sums[block][1] += x
                else:
                    sums[block] = [weight, x]
        for block, (weight, x) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([weight], pa.float64()),
                                              pa.array([x.tobytes()], pa.binary())], names=["block", "weight", "data"])

    summed = parts.repartition(F.col("block")).mapInArrow(run, "block int, weight double, data binary").collect()
    return {r["block"]: (r["weight"], np.frombuffer(r["data"], dtype=np.float64)) for r in summed}  # model size


def _blocks(table: np.ndarray, weight: float) -> Iterator[pa.RecordBatch]:
    parts = [table[k:k + BLOCK].astype(np.float16).tobytes() for k in range(0, len(table), BLOCK)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([weight] * len(parts), pa.float64()),
                                      pa.array(parts, pa.binary())], names=["block", "weight", "data"])


_PART = "block int, weight double, data binary"


def _whole(sums: dict[int, tuple[float, np.ndarray]], n_rows: int, n_cols: int) -> np.ndarray:
    out = np.zeros((n_rows, n_cols))
    for block, (_, x) in sums.items():
        x = x.reshape(-1, n_cols)
        out[block * BLOCK:block * BLOCK + len(x)] = x
    return out


def _sum_changes(parts: DataFrame) -> dict[int, np.ndarray]:
    """Of ``parts (block, used, data)`` by block, one line a row: uses, the sum over tasks of uses
    squared, and the changes times uses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, used, data in zip(*(c.to_pylist() for c in b.columns)):
                n = np.frombuffer(used, dtype=np.float32).astype(np.float64)
                x = np.frombuffer(data, dtype=np.float16).astype(np.float64).reshape(len(n), -1)
                part = np.column_stack([n, n * n, x * n[:, None]])
                if block in sums:
                    sums[block] += part
                else:
                    sums[block] = part
        for block, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "data"])

    summed = parts.repartition(F.col("block")).mapInArrow(run, "block int, data binary").collect()  # model size
    return {r["block"]: np.frombuffer(r["data"], dtype=np.float64) for r in summed}


def _merge(weights: np.ndarray, sums: dict[int, np.ndarray]) -> np.ndarray:
    """The weights with each row's mean change by uses.  A step shrinks with the root of the uses,
    so the changes of tasks that used a row too little to settle it are too small by the root of
    how often more all tasks used it; settled rows take the plain mean."""
    out = weights.astype(np.float64)
    for block, part in sums.items():
        part = part.reshape(-1, weights.shape[1] + 2)
        hit = np.flatnonzero(part[:, 0])
        n, squares, x = part[hit, :1], part[hit, 1:2], part[hit, 2:]
        more = np.minimum(n, SETTLED) / np.minimum(squares / n, SETTLED)
        out[block * BLOCK + hit] += x / n * np.sqrt(np.maximum(more, 1))
    return out.astype(np.float32)


def unit_follows(encoded: DataFrame, shared) -> np.ndarray:
    """How often each unit has each of the most frequent words as the last such word before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        found = np.zeros(voc.size * ANCHORS, dtype=np.int64)
        for whole in batches:
            for b in _pieces(whole, 0, PIECE):
                units, at = positions(voc, b.column(0).to_pylist())
                where = np.arange(len(units))
                last = np.maximum.accumulate(np.where(units < min(ANCHORS, voc.n_units), where, -1))
                begin = np.maximum.accumulate(np.where(units == voc.start, where, -1))
                at = at[last[at - 1] > begin[at]]
                found += np.bincount(units[at].astype(np.int64) * ANCHORS + units[last[at - 1]], minlength=len(found))
        top = max(1.0, found.max() / 2048.0)  # float16 keeps the shares to three digits
        yield from _blocks((found / top).reshape(-1, ANCHORS), top)

    parts = encoded.where("train").select("units").mapInArrow(run, _PART)
    return _whole(_sum_blocks(parts), shared.value.size, ANCHORS)


def train_round(encoded: DataFrame, shared, model) -> np.ndarray:
    """One pass of gradient updates: tasks update on their own, then every row takes the mean change
    of the tasks that used it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, (weights, prior, classes, _) = shared.value, model.value
        trainer = Trainer(weights, prior)
        for whole in batches:
            for b in _pieces(whole, 0, PIECE):
                units, at = positions(voc, b.column(0).to_pylist())
                trainer.learn(units, at, classes[units[at]])
        used, changes = trainer.used - np.float32(EARLY), trainer.w - weights
        blocks = [k for k in range(0, len(used), BLOCK) if used[k:k + BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k // BLOCK for k in blocks], pa.int32()), pa.array([used[k:k + BLOCK].tobytes() for k in blocks], pa.binary()),
             pa.array([changes[k:k + BLOCK].astype(np.float16).tobytes() for k in blocks], pa.binary())], names=["block", "used", "data"])

    parts = encoded.where("train").select("units").mapInArrow(run, "block int, used binary, data binary")
    return _merge(model.value[0], _sum_changes(parts))


def score_units(encoded: DataFrame, shared, model) -> DataFrame:
    """Adds ``fit``: log10 of the probability of a document's units, less the mass of shared units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, (weights, prior, classes, own) = shared.value, model.value
        for whole in batches:
            for b in _pieces(whole, 0, PIECE):
                packed = b.column(0).to_pylist()
                units, at = positions(voc, packed)
                logs = np.empty(len(at))
                for k in range(0, len(at), MINIBATCH):
                    here = at[k:k + MINIBATCH]
                    p = class_probabilities(weights, prior, active_rows(units, here))
                    logs[k:k + MINIBATCH] = np.log10(p[np.arange(len(here)), classes[units[here]]])
                logs += own[units[at]]
                ends = np.cumsum([len(p) // 2 + 1 for p in packed])
                fit = np.add.reduceat(logs, np.append(0, ends[:-1]))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fit, pa.float64())],
                                                 names=[*b.schema.names[1:], "fit"])

    rows = encoded.select("units", "row", "id", "train", "words", "known", "own", "shared")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("fit", T.DoubleType())]))


def maxent_scores(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows where ``train`` holds and scores all rows.

    One row per input row: ``id, train, n_tokens`` (words and one end), ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (unigrams with one added, log10) and ``score`` (log10
    probability of the text under the model).  Null texts are empty: their only token is the end.
    Rows for which ``train`` is null are not learned from.  Repeated rows count as often as they
    come.  Without training rows every class is equally likely.
    """
    spark = docs.sparkSession
    rows = docs.select(column(id_col).alias("id"), text_or_empty(text_col).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    counts = cut(word_counts(rows.where("train")))
    n_docs = rows.where("train").count()
    n_words, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, types = n_words + n_docs, n_types + (n_docs > 0)
    voc, looked_up, as_unit = choose_vocabulary(counts)
    shared = spark.sparkContext.broadcast(voc)
    encoded = cut(encode_documents(rows, shared))

    mass, extra = np.zeros(voc.size), np.ones(ENDINGS)
    mass[:voc.n_units], mass[voc.end] = voc.counts[:voc.n_units], n_docs
    for r in counts.where(F.col("n") < as_unit).groupBy(ending_column("word").alias("e")).agg(
            F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # at most ENDINGS rows
        mass[voc.n_units + r["e"]] = r["n"]
        extra[r["e"]] += r["n"] + r["words"]
    classes = cluster(unit_follows(encoded, shared), mass)
    n_classes = int(classes.max()) + 1
    in_class = np.bincount(classes, weights=mass + 1, minlength=n_classes)
    prior = np.log(in_class / in_class.sum()).astype(np.float32)
    own = np.log10((mass + 1) / in_class[classes])
    own[voc.n_units:voc.end] -= np.log10(extra)  # a word's share of its unit: (count + 1) / extra
    weights = np.zeros((ROWS * FEATURES, n_classes), dtype=np.float32)
    for _ in range(EPOCHS if n_docs else 0):
        weights = train_round(encoded, shared, spark.sparkContext.broadcast((weights, prior, classes, own)))
    scored = score_units(encoded, shared, spark.sparkContext.broadcast((weights, prior, classes, own)))

    # Words that are not looked up meet their counts; a document names each of them once (a long one once a run).
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    met = (rare.join(counts.where(F.col("n") < looked_up), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_log"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_tokens = F.col("words") + 1
    end_log = float(np.log10(n_docs + 1))
    return scored.join(met, "row", "left").select(
        "id", "train", n_tokens.alias("n_tokens"),
        (F.col("known") + zero("rare_known") + (1 if n_docs else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("own") + F.col("shared") + zero("rare_log") + end_log
         - n_tokens * F.lit(float(np.log10(tokens + types + 1)))).alias("base_score"),
        (F.col("fit") + F.col("shared") + zero("rare_log")).alias("score"))
