"""Phrase collocations: level-wise mining with broadcast double-array tries.

Words become numbers once (frequent words only; any other word ends a stretch, since no frequent
phrase contains it), and the texts are written as number arrays.  A level of length k then takes

1. a bucket pass: every place of a frequent (k-1)-phrase followed by a frequent (k-1)-phrase one
   word later is hashed with its next word into one of about n / 4 buckets; a bucket's places
   are at least those of every phrase in it, so buckets below the threshold rule all theirs out;
2. a candidate pass: the distinct phrases at such places whose bucket stays, and whose last k-1
   words are frequent too;
3. a counting pass: the candidates as a double-array trie (``base``, ``check``) are broadcast;
   numpy advances the states of all positions of a text block by one word after the other,
   ``bincount`` counts the accepting states, and Spark sums the counts of the tasks.

Vocabulary and candidates are broadcast in blocks of bounded size, one pass for each, however
many there are.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix import dense_ordinal
from ..session import ensure_checkpoint_dir
from .common import column, give_back, text_or_empty

#: Phrases of a trie that one pass broadcasts (and four times as many words of the vocabulary).
BLOCK = 1 << 18
#: Phrases whose counts travel in one row.
SLICE = 256
#: Finds that a task gathers before it sorts out the equal ones.
HELD = 1 << 20
#: Most bits of the folded bucket filter that is broadcast (buckets themselves grow with the corpus).
FILTER_BITS = 28

#: What bytes become: capitals small, tabs blanks, piece ends line feeds.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("A"):ord("Z") + 1] += 32
_KIND[ord("\t")] = ord(" ")
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = ord("\n")

_MIX = 0x9E3779B97F4A7C15


def _digits(words: np.ndarray, digits: int) -> list[np.ndarray]:
    """Base-256 digits of word numbers, the highest first: a small alphabet packs densely."""
    return [words >> 8 * k & 255 for k in reversed(range(digits))]


class DoubleArray:
    """Trie of number sequences of one length, digit by digit: the state after digit ``d`` in state
    ``s`` is ``base[s] + d`` if ``check`` there is ``s``.  The root is state 0; ``accept`` are the
    states of ``phrases``, which are the given ones in order."""

    #: Share of places that transitions fill.
    FILL = 0.4

    def __init__(self, phrases: np.ndarray, digits: int):
        self.phrases = phrases[np.lexsort(phrases.T[::-1])]
        labels = [d for word in self.phrases.T for d in _digits(word, digits)]
        differ = [np.zeros(max(0, len(phrases) - 1), bool)]
        for label in labels:                             # where a prefix ends, length by length
            differ.append(differ[-1] | (label[1:] != label[:-1]))
        size = int(sum(1 + d.sum() for d in differ) / self.FILL) + 512
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.check[0], self._random = 0, np.random.default_rng(len(phrases))
        state = np.zeros(len(phrases), np.int64)
        for label, new in zip(labels, differ[1:]):
            new = np.concatenate(([True], new))[:len(state)]
            self._place(state[new], label[new])
            state = self.base[state] + label
        self.accept = state

    def _place(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """Children of grouped parents.  Parents of one size try random bases together, the largest
        first; a parent settles where all its places are free and no other claims them."""
        starts = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1]))[:len(parents)])
        sizes = np.diff(np.append(starts, len(parents)))
        claim = np.zeros(len(self.check), np.int64)
        for size in np.unique(sizes)[::-1]:
            left = starts[sizes == size]
            rounds = 0
            while len(left):
                places = self._random.integers(1, len(self.check) - 255, len(left))[:, None] + labels[left[:, None] + np.arange(size)]
                fits = (self.check[places] < 0).all(1)
                tried, places = left[fits], places[fits]
                claim[places] = tried[:, None]
                wins = (claim[places] == tried[:, None]).all(1)
                own, places = tried[wins], places[wins]
                self.base[parents[own]] = places[:, 0] - labels[own]
                self.check[places] = parents[own][:, None]
                left = np.setdiff1d(left, own, assume_unique=True)
                rounds += 1
                if rounds % 64 == 0:                     # too dense for parents of this size
                    more = len(self.check) // 4
                    self.check = np.append(self.check, np.full(more, -1, np.int32))
                    self.base = np.append(self.base, np.zeros(more, np.int32))
                    claim = np.append(claim, np.zeros(more, np.int64))


def advance(base: np.ndarray, check: np.ndarray, digits: int, numbers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a phrase of the trie starts, and its accepting state.  ``numbers``: words
    of a block of texts, -1 between pieces, ``depth`` of them at the end."""
    at = np.flatnonzero(numbers >= 0)
    state = np.zeros(len(at), np.int64)
    for level in range(depth):
        word = numbers[at + level]
        if level:
            live = word >= 0
            at, state, word = at[live], state[live], word[live]
        for k in reversed(range(digits)):
            to = base[state] + (word >> 8 * k & 255)
            live = check[to] == state
            at, state, word = at[live], to[live], word[live]
    return at, state


def _written(df: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/phrases-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _tokens(texts):
    """Words of an Arrow binary array, in order, as an Arrow dictionary array, and how many pieces
    ended before each word (ends of texts count)."""
    import pyarrow as pa
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    data = np.insert(_KIND[body], bounds[1:] - bounds[0], ord("\n"))
    inside = (data != ord(" ")) & (data != ord("\n"))
    edges = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    ends = np.cumsum(data == ord("\n"))
    offsets = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words.dictionary_encode(), ends[start]


def _by_lang(batch):
    """``(lang, texts)`` of a record batch."""
    import pyarrow as pa
    import pyarrow.compute as pc
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, pc.take(batch.column("text"), pa.array(np.flatnonzero(codes == k)))


def word_counts(rows: DataFrame) -> DataFrame:
    """``(lang, word, f)`` of all words of ``rows (lang, text)``; ``word`` is binary."""
    def count(batches):
        import pyarrow as pa
        for b in batches:
            for lang, texts in _by_lang(b):
                words, _ = _tokens(texts)
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words.dictionary, pa.array(n)], ["lang", "word", "n"])
        give_back()

    return (rows.mapInArrow(count, "lang string, word binary, n long")
            .groupBy("lang", "word").agg(F.sum("n").cast("long").alias("f")))


def number_texts(rows: DataFrame, vocabulary: DataFrame, size: int, block: int) -> DataFrame:
    """``(lang, numbers, words)``: stretches of frequent words as packed 32-bit numbers with -1
    between them, one row per language and Arrow batch.  The vocabulary (``lang, word, id``) is
    broadcast in blocks; a word not met yet stays as ``-2 - its place in words`` until the last."""
    spark = rows.sparkSession

    def table(k: int):
        found = vocabulary.where(F.col("id").between(k * block, (k + 1) * block - 1)).toArrow()
        by_lang = {}
        for lang in found.column("lang").unique().to_pylist():
            import pyarrow.compute as pc
            own = found.filter(pc.equal(found.column("lang"), lang))
            by_lang[lang] = (own.column("word").combine_chunks(), own.column("id").to_numpy())
        return spark.sparkContext.broadcast(by_lang)

    def assign(known, lang, numbers, words, last):
        import pyarrow.compute as pc
        if lang in known and len(words):
            at = pc.index_in(words, value_set=known[lang][0]).fill_null(-1).to_numpy()
            ids = np.where(at >= 0, known[lang][1][at].astype(np.int64), -2 - np.arange(len(words)))
            numbers = np.where(numbers < -1, ids[np.maximum(-2 - numbers, 0)], numbers)
        if last:
            numbers = np.maximum(numbers, -1)
            again = np.concatenate(([False], (numbers[1:] < 0) & (numbers[:-1] < 0)))[:len(numbers)]
            numbers, words = numbers[~again], words[:0]
        return numbers, words

    def batch(lang, numbers, words):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([numbers.astype(np.int32).tobytes()], pa.binary()),
                                           pa.array([words.to_pylist()], pa.list_(pa.binary()))], ["lang", "numbers", "words"])

    blocks = max(1, -(-size // block))
    now = table(0)

    def first(batches):
        for b in batches:
            for lang, texts in _by_lang(b):
                words, ends = _tokens(texts)
                new = np.flatnonzero(np.diff(ends, prepend=ends[:1]))
                numbers = np.insert(-2 - words.indices.to_numpy().astype(np.int64), new, -1)
                yield batch(lang, *assign(now.value, lang, numbers, words.dictionary, blocks == 1))
        give_back()

    schema = "lang string, numbers binary, words array<binary>"
    out = _written(rows.mapInArrow(first, schema))
    for k in range(1, blocks):
        out = _written(out.mapInArrow(_next_block(table(k), assign, batch, k == blocks - 1), schema))
    return out.select("numbers")


def _next_block(now, assign, batch, last):
    def go(batches):
        for b in batches:
            words = b.column("words")
            for i, (lang, numbers) in enumerate(zip(b.column("lang").to_pylist(), b.column("numbers").to_pylist())):
                yield batch(lang, *assign(now.value, lang, np.frombuffer(numbers, np.int32).astype(np.int64), words[i].values, last))
        give_back()
    return go


def _stretches(batches, depth: int):
    for b in batches:
        for numbers in b.column("numbers").to_pylist():
            yield np.concatenate((np.frombuffer(numbers, np.int32), np.full(depth + 1, -1, np.int32))).astype(np.int64)


def _pairs(trie, numbers: np.ndarray, depth: int, whole: bool):
    """Prefix number, next word and 64-bit hash at every place whose phrase of ``depth`` words and
    next word are frequent; if the trie is ``whole``, the phrase one word later must be in it too."""
    if trie is None:                                     # one word: every number is frequent
        at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
        prefix = numbers[at]
    else:
        base, check, digits, place, cids = trie.value
        at, state = advance(base, check, digits, numbers, depth)
        if whole:
            starts = np.zeros(len(numbers) + 1, bool)
            starts[at] = True
            live = starts[at + 1]
        else:
            live = numbers[at + depth] >= 0
        at, prefix = at[live], cids[place[state[live]]]
    word = numbers[at + depth]
    mixed = (prefix.astype(np.uint64) * np.uint64(_MIX) + word.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xCA5A826395121157)
    return prefix, word, mixed ^ (mixed >> np.uint64(29))


def _blocks(phrases: DataFrame, block: int):
    """Phrases ``(cid, words)`` in parts of about ``block`` rows: any part of them is a trie."""
    size = phrases.count()
    parts = max(1, -(-size * 9 // (8 * block))) if size > block else 1
    for k in range(parts):
        own = phrases if parts == 1 else phrases.where(F.expr(f"pmod(xxhash64(words), {parts}) = {k}"))
        found = own.select("cid", "words").toArrow()
        if found.num_rows:
            words = found.column("words").combine_chunks().flatten().to_numpy()
            yield found.column("cid").to_numpy(), words.reshape(found.num_rows, -1).astype(np.int64), parts == 1


def _trie(spark: SparkSession, cids: np.ndarray, phrases: np.ndarray):
    """Broadcast ``(base, check, digits of a word, phrase by accepting state, its number)``."""
    digits = max(1, -(-int(phrases.max()).bit_length() // 8))
    trie = DoubleArray(phrases, digits)
    place = np.full(len(trie.check), -1, np.int32)
    place[trie.accept] = np.arange(len(phrases))
    return spark.sparkContext.broadcast((trie.base, trie.check, digits, place, cids[np.lexsort(phrases.T[::-1])]))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct rows of three numbers."""
    rows = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort(rows.T)]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))[:len(rows)]]


def _unite(batches):
    """Distinct finds of every slice; the slices arrive one after another."""
    import pyarrow as pa
    current, held, size = None, [], 0
    for b in batches:
        for k, found in zip(b.column("slice").to_pylist(), b.column("found").to_pylist()):
            if k != current and held:
                yield pa.RecordBatch.from_pydict(dict(zip(("cid", "next", "bucket"), _distinct(held).T.copy())))
                held, size = [], 0
            current = k
            held.append(np.frombuffer(found, np.int64).reshape(-1, 3))
            size += len(held[-1])
            if size > HELD:
                held, size = [_distinct(held)], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(("cid", "next", "bucket"), _distinct(held).T.copy())))
    give_back()


def candidates(texts: DataFrame, frequent: DataFrame, depth: int, min_count: int, n: int, block: int) -> DataFrame:
    """``(cid, words)``: Apriori-safe candidates of ``depth + 1`` words (steps 1 and 2 above)."""
    spark = texts.sparkSession
    bits = min(62, max(10, (n // 4).bit_length()))
    fold = min(FILTER_BITS, bits)
    tries = [(None, True)] if depth == 1 else ((_trie(spark, c, p), whole) for c, p, whole in _blocks(frequent, block))
    found = None
    for trie, whole in tries:
        def count(batches, trie=trie, whole=whole):
            import pyarrow as pa
            for numbers in _stretches(batches, depth):
                _, _, mixed = _pairs(trie, numbers, depth, whole)
                bucket, times = np.unique(mixed >> np.uint64(64 - bits), return_counts=True)
                yield pa.RecordBatch.from_pydict({"bucket": bucket.view(np.int64), "n": times.astype(np.int64)})
            give_back()

        stay = _written(texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
                        .where(F.col("n") >= min_count).select("bucket"))
        folded = (stay.select((F.shiftright("bucket", bits - fold)).alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
                  .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow())
        filled = np.zeros(max(1, 1 << (fold - 6)), np.uint64)
        filled[folded.column("w").to_numpy()] = folded.column("b").to_numpy().view(np.uint64)
        passing = spark.sparkContext.broadcast(filled)

        def propose(batches, trie=trie, whole=whole, passing=passing):
            import pyarrow as pa
            bitmap, held, size = passing.value, [], 0
            for numbers in _stretches(batches, depth):
                prefix, word, mixed = _pairs(trie, numbers, depth, whole)
                p = mixed >> np.uint64(64 - fold)
                keep = (bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                held.append(_distinct([np.stack((prefix[keep], word[keep], (mixed[keep] >> np.uint64(64 - bits)).view(np.int64)), axis=1)]))
                size += len(held[-1])
                if size > HELD:
                    held, size = [_distinct(held)], 0
            rows = _distinct(held)
            own = rows[:, 2] & 255 if len(rows) else np.zeros(0, np.int64)
            some = np.unique(own)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int32()), "found": pa.array(
                [rows[own == k].tobytes() for k in some], pa.binary())})
            give_back()

        # A task's distinct finds leave it packed, a row for each of 256 slices of the buckets.
        proposed = (texts.mapInArrow(propose, "slice int, found binary").repartition("slice").sortWithinPartitions("slice")
                    .mapInArrow(_unite, "cid long, next long, bucket long"))
        if bits > fold:
            proposed = proposed.join(stay, "bucket", "left_semi")
        words = F.array(F.col("cid").cast("int")) if depth == 1 else F.col("words")
        if depth > 1:
            proposed = proposed.join(frequent.select("cid", "words"), "cid")
        part = _written(proposed.select(F.array_append(words, F.col("next").cast("int")).alias("words")))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "cid long, words array<int>")
    if depth > 1:
        found = found.join(frequent.select(F.col("words").alias("_tail")), F.slice("words", 2, depth) == F.col("_tail"), "left_semi")
    return _written(found.withColumn("cid", F.monotonically_increasing_id()))


def count_candidates(texts: DataFrame, found: DataFrame, depth: int, min_count: int, block: int) -> DataFrame:
    """``(cid, words, f)`` of the candidates that occur ``min_count`` times (step 3).

    A task's counts leave it as packed slices of its ``bincount`` vector, which are added as they
    arrive, so rows grow with tasks and slices, not with tasks and phrases."""
    spark = texts.sparkSession
    counted = None
    for cids, phrases, _ in _blocks(found, block):
        trie = _trie(spark, cids, phrases)

        def count(batches, trie=trie):
            import pyarrow as pa
            base, check, digits, place, cids = trie.value
            total = np.zeros(len(cids), np.int64)
            for numbers in _stretches(batches, depth):
                _, state = advance(base, check, digits, numbers, depth)
                total += np.bincount(place[state], minlength=len(cids))
            parts = [total[k:k + SLICE] for k in range(0, len(total), SLICE)]
            some = [k for k, part in enumerate(parts) if part.any()]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int32()), "counts": pa.array([parts[k].tobytes() for k in some], pa.binary())})
            give_back()

        def add(batches, trie=trie):
            import pyarrow as pa
            cids = trie.value[4]
            current, total = None, None

            def ready():
                at = np.flatnonzero(total >= min_count)
                return pa.RecordBatch.from_pydict({"cid": cids[current * SLICE + at], "f": total[at]})

            for b in batches:
                for k, counts in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
                    if k != current:
                        if current is not None:
                            yield ready()
                        current, total = k, 0
                    total = total + np.frombuffer(counts, np.int64)
            if current is not None:
                yield ready()
            give_back()

        part = (texts.mapInArrow(count, "slice int, counts binary").repartition("slice").sortWithinPartitions("slice")
                .mapInArrow(add, "cid long, f long"))
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return spark.createDataFrame([], "cid long, words array<int>, f long")
    return _written(found.join(counted, "cid").select("cid", "words", "f"))


def phrase_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 5,
                        min_count: int = 100, top: int = 2000, block: int = BLOCK) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``top`` phrases of every language.

    Capitals A-Z count as small letters; pieces end at ``. , ; : ! ?`` and line ends; words are
    what blanks and tabs separate.  A phrase of 2 to ``max_words`` words that occurs a >= ``min_count``
    times scores its weakest cut, floor(1000 a n / (l r)), the earliest on ties; it goes if a longer
    phrase that holds it occurs as often.  Order: score, a (descending), phrase (bytes).  Null texts
    are empty, a null language is ``und``; ids and other columns play no part, repeated rows count
    each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       text_or_empty(text_col).cast("binary").alias("text"))
    counted = _written(word_counts(rows))
    totals = counted.groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
    vocabulary = _written(dense_ordinal(counted.where(F.col("f") >= min_count).withColumn("key", F.struct("lang", "word")),
                                        "key", "id").select("lang", "word", "f", "id"))
    size = vocabulary.count()
    texts = number_texts(rows, vocabulary, size, 4 * block)
    n = counted.agg(F.sum("f")).first()[0] or 0

    words_of = vocabulary.select(F.array(F.col("id").cast("int")).alias("words"), "f")
    levels, frequent = [], None
    for depth in range(1, max_words):
        found = candidates(texts, frequent, depth, min_count, n, block) if size else spark.createDataFrame([], "cid long, words array<int>")
        frequent = count_candidates(texts, found, depth + 1, min_count, block)
        if frequent.isEmpty():
            break
        levels.append(frequent.select("words", "f"))
    if not levels:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.unionByName(more)
    return _ranked(phrases, words_of.unionByName(phrases), vocabulary, totals, top)


def _ranked(phrases: DataFrame, parts: DataFrame, vocabulary: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    # Longer phrases that hold a phrase and occur as often: one word longer is enough, since the
    # phrases in between occur as often too.
    held = (phrases.select(F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"),
                           F.col("f").alias("longer")).where(F.size("words") >= 2)
            .groupBy("words").agg(F.max("longer").alias("longer")))
    kept = phrases.join(held, "words", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).select("words", F.col("f").alias("a"))
    cuts = kept.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    left, right = (parts.select(F.col("words").alias(c), F.col("f").alias(v)) for c, v in (("_first", "l"), ("_rest", "r")))
    cuts = (cuts.withColumn("_first", F.expr("slice(words, 1, k)")).withColumn("_rest", F.expr("slice(words, k + 1, size(words) - k)"))
            .join(left, "_first").join(right, "_rest"))
    # A vocabulary number belongs to one language, so the first word tells the phrase's.
    named = vocabulary.select(F.col("id").cast("int").alias("id"), "lang", F.col("word").cast("string").alias("word"))
    spelt = (kept.select("words", F.posexplode("words").alias("at", "id")).join(named, "id").groupBy("words")
             .agg(F.expr("min(lang)").alias("lang"), F.expr("array_join(transform(array_sort(collect_list(struct(at, word))), x -> x.word), ' ')").alias("phrase")))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    scored = (cuts.join(spelt, "words").join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang")
              .withColumn("_num", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("_den", wide("l") * wide("r"))
              .withColumn("score", F.expr("_num div _den")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                    "n", F.col("cut.score").alias("score")))
