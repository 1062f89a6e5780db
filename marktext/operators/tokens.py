"""Tokenizer jobs (T8, W5, A7, A9-A11, B1-B5, J5) re-aimed as Spark jobs.

Scale notes
-----------
* Texts are cut at single blanks, where every pretoken ends, and equal chunks are counted with partial
  aggregation; a JVM regex (T8) takes pretokens from the distinct chunks alone (A10).  The BPE trainer
  works on the *distinct* pretoken table, never on the corpus.
* BPE training (B1, ``bpe_train``) is exact and takes a few rounds over the distinct pretokens; lineage is
  cut with ``checkpoint()``.
* Encoding (B2) is map-only: ``mapInArrow`` with a per-task pretoken cache and the merges (bounded by
  the vocabulary size) shipped with the function; the new words of a batch are merged as one array.  Columns
  of the input ride along, so no consumer joins the ids back to their documents.
* Decoding (B3) is built-in: token id -> hex literal array (vocabulary-sized), unhex.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chars as C
from ..functions import text as X
from ..session import ensure_checkpoint_dir
from .bpe_train import BLOCK, N_BYTES, as_symbols, merge_words
from .bpe_train import bpe_train as learn_merges
from .prefix import running_before

#: Pretokens a task remembers while it encodes; the memory starts anew when it is full.
CACHED_PRETOKENS = 200_000


# ---------------------------------------------------------------------------
# Character-budget prefix
# ---------------------------------------------------------------------------
def prefix_by_chars(docs: DataFrame, max_chars: int | None = None, doc_cap: int | None = None,
                    order_col: str = "ordinal", text_col: str = "text") -> DataFrame:
    """Cap each document to ``doc_cap`` codepoints and keep documents, in order, until
    the running length reaches ``max_chars``; the document that crosses it is kept.

    Neither limit is set by default: all documents are returned whole.  With a budget, the
    running sum takes two phases over (order, length) alone; the last kept position is one
    value, which the documents are then filtered by, so no text is shuffled.
    """
    from .corpus import cap_doc
    capped = docs if doc_cap is None else docs.withColumn(text_col, cap_doc(text_col, doc_cap))
    if max_chars is None:
        return capped
    running = running_before(capped.select(order_col, F.length(text_col).cast("bigint").alias("_len")),
                             (order_col,), "_len", out="_before")
    last = running.where(F.col("_before") < max_chars).select(F.max(order_col)).scalar()
    return capped.where(F.col(order_col) <= last)


# ---------------------------------------------------------------------------
# A10: pretoken histogram
# ---------------------------------------------------------------------------
def chunk_counts(texts: DataFrame, text_col: str = "text", group_cols: tuple[str, ...] = ()) -> DataFrame:
    """``(group..., chunk, n, texts)``: texts cut before every single blank that stands between two characters
    that are none, ``n`` equal chunks, ``texts`` of them at the beginning of a text.

    No pretoken goes on over such a blank and none looks beyond it, so the pretokens of a text are those of its
    chunks (words likewise), and only distinct chunks are searched for them.
    """
    return (texts.select(*group_cols, F.posexplode_outer(F.split(text_col, C.BEFORE_SINGLE_BLANK)).alias("_at", "chunk"))
            .groupBy(*group_cols, "chunk")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.count_if(F.coalesce("_at", F.lit(0)) == 0).cast("bigint").alias("texts")))


def pretokens_of(chunks: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """A10 from :func:`chunk_counts`."""
    return (chunks.select(*group_cols, "n", F.explode(X.pretokenize("chunk")).alias("pretoken"))
            .groupBy(*group_cols, "pretoken").agg(F.sum("n").cast("bigint").alias("freq")))


def pretoken_histogram(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A10: ``(pretoken, freq)`` over all texts (hot chunks absorbed map-side)."""
    return pretokens_of(chunk_counts(texts, text_col))


def utf8_byte_ids(s: Column) -> Column:
    """UTF-8 bytes of a string as ``array<int>`` (0..255)."""
    hexed = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit(".."), 0)
    return F.transform(hexed, lambda h: F.conv(h, 16, 10).cast("int"))


# ---------------------------------------------------------------------------
# B1: BPE training
# ---------------------------------------------------------------------------
def bpe_train(hist: DataFrame, vocab_size: int, n_special: int = len(C.SPECIAL_TOKENS), min_count: int = 1,
              **options) -> DataFrame:
    """B1: byte-level BPE merges ``(rank, left, right, token_id, count)`` learned from a pretoken
    histogram, see :mod:`marktext.operators.bpe_train`."""
    return learn_merges(hist, vocab_size, n_special, min_count, **options)


def merges_to_ranks(merges: DataFrame) -> list[tuple[int, int, int]]:
    """The merge list, ordered by rank (bounded by the vocabulary size)."""
    return [(int(r["left"]), int(r["right"]), int(r["token_id"]))
            for r in merges.orderBy("rank").collect()]


def token_byte_strings(ranks: list[tuple[int, int, int]]) -> list[bytes]:
    """bytes of every non-special token id, in id order."""
    table = [bytes([i]) for i in range(N_BYTES)]
    for left, right, _ in ranks:
        table.append(table[left] + table[right])
    return table


def vocab_table(spark: SparkSession, merges: DataFrame,
                specials: list[str] = C.SPECIAL_TOKENS) -> DataFrame:
    """M8 ``vocab(token_id, token BINARY, token_text, rank, is_special)``; specials follow."""
    table = token_byte_strings(merges_to_ranks(merges))
    rows = [(i, bytearray(b), b.decode("utf-8", errors="ignore"), i, False) for i, b in enumerate(table)]
    rows += [(len(table) + j, bytearray(s.encode("utf-8")), s, None, True) for j, s in enumerate(specials)]
    return spark.createDataFrame(rows, "token_id int, token binary, token_text string, rank int, is_special boolean")


# ---------------------------------------------------------------------------
# B4 / A11
# ---------------------------------------------------------------------------
def token_bytes(vocab: DataFrame, true_bytes: bool = False) -> DataFrame:
    """B4 ``(token_id, n_bytes)``: UTF-8 length of the *decoded* token, specials 0.

    By default an incomplete UTF-8 fragment is first replaced (U+FFFD, 3 bytes), as the
    studied evaluation does; ``true_bytes=True`` counts raw bytes instead.
    """
    raw = F.octet_length("token")
    decoded = F.octet_length(F.make_valid_utf8(F.col("token").cast("string")))
    n = raw if true_bytes else decoded
    return vocab.select("token_id", F.when(F.col("is_special"), 0).otherwise(n).cast("int").alias("n_bytes"))


def vocab_size(vocab: DataFrame) -> DataFrame:
    """Ranks count and the id of the first special token."""
    return vocab.agg(F.count_if(~F.col("is_special")).cast("int").alias("n_ranks"),
                     F.count(F.lit(1)).cast("int").alias("vocab_size"),
                     F.min(F.when(F.col("is_special"), F.col("token_id"))).alias("first_special_id"))


# ---------------------------------------------------------------------------
# B2: encode
# ---------------------------------------------------------------------------
def bpe_steps(word: bytes, ranks: dict) -> tuple[list[int], list[int]]:
    """Ids of one pretoken, and the ranks of the merges applied, in order: always the lowest rank,
    then the leftmost place.

    The places are a linked list and the mergeable pairs a heap, so a word of n bytes takes
    n log n steps.  Ranks never fall: a pair with a new symbol was learned after it.
    """
    ids, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(ranks[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
    heapq.heapify(heap)
    applied = []
    while heap:
        rank, i, pair = heapq.heappop(heap)
        j = after[i]
        if ids[i] != pair[0] or j >= len(ids) or ids[j] != pair[1]:
            continue                                     # one of the two symbols was merged meanwhile
        ids[i], ids[j] = ranks[pair][1], -1
        applied.append(rank)
        after[i] = k = after[j]
        if k < len(ids):
            before[k] = i
            if (p := (ids[i], ids[k])) in ranks:
                heapq.heappush(heap, (ranks[p][0], i, p))
        if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in ranks:
            heapq.heappush(heap, (ranks[p][0], before[i], p))
    return [x for x in ids if x >= 0], applied


class WordIds:
    """Ids of words by the merges; words met before are remembered."""

    def __init__(self, pairs: list[tuple[int, int]], most: int = CACHED_PRETOKENS):
        import numpy as np
        self.pairs, self.most = np.array(pairs, np.int64).reshape(-1, 2), most
        self._forget()

    def _forget(self) -> None:
        import numpy as np
        self.slots: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def slots_of(self, words: list[str]):
        """The place of each of the distinct words; the ids of place i are ``ids[first[i]:first[i + 1]]``."""
        import numpy as np
        if len(self.slots) + len(words) > self.most:
            self._forget()
        new = [w for w in words if w not in self.slots]
        if new:
            ids, lengths = encode_words([w.encode("utf-8") for w in new], self.pairs)
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
            self.first = np.append(self.first, self.first[-1] + np.cumsum(lengths))
            self.ids = np.append(self.ids, ids)
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))


def encode_words(words: list[bytes], pairs):
    """The words' ids one after the other, and how many each word has: what ``bpe_steps`` gives, by one array."""
    import numpy as np
    symbols, order, _, _ = merge_words(*as_symbols(words, np.arange(len(words))), pairs, N_BYTES, None)
    stops = np.flatnonzero(symbols < 0)
    lengths, begins = np.diff(stops, prepend=-1) - 1, np.concatenate((np.zeros(1, np.int64), stops + 1))
    back = np.argsort(order)
    return symbols[_runs(begins[back], lengths[back])], lengths[back]


def _runs(first, lengths):
    """``first[0], first[0] + 1, ...`` for every run of places."""
    import numpy as np
    return np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def _merge_pairs(merges: DataFrame) -> list[tuple[int, int]]:
    return [(a, b) for a, b, _ in merges_to_ranks(merges)]


def bpe_encode(docs: DataFrame, merges: DataFrame, text_col: str = "text", key_col: str = "doc_id",
               bos_id: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """B2: ``(key, keep..., ids array<int>)`` for each document (ordinary text, optional BOS)."""
    pairs = _merge_pairs(merges)
    pre = docs.select(F.col(key_col).alias("key"), *keep, X.pretokenize(text_col).alias("pretokens"))
    fields = [f"key {docs.schema[key_col].dataType.simpleString()}",
              *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep], "ids array<int>"]

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        known = WordIds(pairs)
        for b in batches:
            lists = b.column("pretokens")
            coded = lists.flatten().dictionary_encode()
            slot = known.slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
            lengths = np.diff(known.first)[slot]
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))[np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))]
            ids = known.ids[_runs(known.first[slot], lengths)]
            if bos_id is not None:
                ids, ends = np.insert(ids, ends[:-1], bos_id), ends + np.arange(len(ends))
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], "ids"])

    return pre.mapInArrow(encode, ", ".join(fields)).withColumnRenamed("key", key_col)


# ---------------------------------------------------------------------------
# Decode and roundtrip
# ---------------------------------------------------------------------------
def bpe_decode(ids: Column, merges: DataFrame, specials: list[str] = C.SPECIAL_TOKENS) -> Column:
    """Concatenate token bytes and decode UTF-8 (invalid sequences replaced)."""
    table = token_byte_strings(merges_to_ranks(merges)) + [s.encode("utf-8") for s in specials]
    hex_arr = F.split(F.lit(",".join(b.hex().upper() for b in table)), ",")  # folded to one literal
    hexed = F.array_join(F.transform(ids, lambda i: F.element_at(hex_arr, i + 1)), "")
    return F.make_valid_utf8(F.unhex(hexed).cast("string"))


def roundtrip_check(docs: DataFrame, merges: DataFrame, text_col: str = "text",
                    key_col: str = "doc_id") -> DataFrame:
    """decode(encode(x)) == x over a corpus: ``(docs, mismatches, tokens)``."""
    enc = bpe_encode(docs, merges, text_col, key_col, keep=(text_col,))
    ok = bpe_decode(F.col("ids"), merges) == F.col(text_col)
    return enc.agg(F.count(F.lit(1)).cast("bigint").alias("docs"),
                      F.count_if(~ok).cast("bigint").alias("mismatches"),
                      F.sum(F.size("ids")).cast("bigint").alias("tokens"))


# ---------------------------------------------------------------------------
# fertility
# ---------------------------------------------------------------------------
def fertility(docs: DataFrame, merges: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """Sum of tokens / sum of Python words; 0 when there are no words.

    Each distinct pretoken is encoded once: tokens are ``sum(freq x pieces)`` over the histogram.
    """
    hist = pretoken_histogram(docs, text_col)
    pieces = bpe_encode(hist.withColumn("_n", F.col("freq")), merges, "pretoken", "pretoken", keep=("_n",))
    tok = pieces.select(F.coalesce(F.sum(F.size("ids") * F.col("_n")), F.lit(0))).scalar()
    nw = F.coalesce(F.sum(F.size(X.words(text_col))), F.lit(0)).cast("bigint")
    return docs.agg(nw.alias("words")).select(
        tok.cast("bigint").alias("tokens"), "words",
        F.when(F.col("words") > 0, tok / F.col("words")).otherwise(F.lit(0.0)).alias("fertility"))


def merge_profile(hist: DataFrame, merges: DataFrame) -> DataFrame:
    """``(rank, applied)``: how often each merge is applied when all of ``hist (pretoken, freq)`` is
    encoded; rank -1 holds the bytes.

    Ranks never fall while a word is encoded, so the first r merges give exactly the pieces that
    are left after the merges of a rank below r: a prefix of the merge list is the smaller
    vocabulary, and one encoding answers every vocabulary size.
    """
    pairs = _merge_pairs(merges)

    def count(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros(1 + len(pairs), np.int64)      # of the bytes, then of every merge
        for words, freqs in _word_blocks(batches):
            total[0] += int((np.fromiter(map(len, words), np.int64, len(words)) * freqs).sum())
            if pairs:
                merge_words(*as_symbols(words, freqs), pairs, N_BYTES, None, applied=total[1:])
        rank = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"rank": pa.array((rank - 1).astype(np.int32)), "n": pa.array(total[rank])})

    return (hist.where(F.col("pretoken").isNotNull()).select(F.col("pretoken").cast("binary").alias("word"), F.col("freq").cast("long").alias("freq"))
            .mapInArrow(count, "rank int, n long").groupBy("rank").agg(F.sum("n").cast("long").alias("applied")))


def _word_blocks(batches):
    """Batches of ``(word, freq)`` as lists of words with their frequencies, some ``BLOCK`` bytes each."""
    import numpy as np
    words, freqs, held = [], [], 0
    for b in batches:
        words += (some := b.column("word").to_pylist())
        freqs.append(b.column("freq").to_numpy(zero_copy_only=False))
        held += sum(map(len, some))
        if held >= BLOCK:
            yield words, np.concatenate(freqs)
            words, freqs, held = [], [], 0
    if words:
        yield words, np.concatenate(freqs)


def fertility_by_size(docs: DataFrame, hist: DataFrame, merges: DataFrame, sizes: tuple[int, ...],
                      n_special: int = len(C.SPECIAL_TOKENS), text_col: str = "text", n_col: str | None = None) -> DataFrame:
    """A7 at several vocabulary sizes: ``(vocab_size, tokens, words, fertility)``; 0 without words.  With
    ``n_col`` a row of ``docs`` stands for so many equal texts (or chunks of texts)."""
    profile = merge_profile(hist, merges)
    n = F.lit(1) if n_col is None else F.col(n_col)
    words = docs.select(F.coalesce(F.sum(F.size(X.words(text_col)) * n), F.lit(0))).scalar()
    at = profile.select("*", F.explode(F.array(*[F.lit(v) for v in sizes])).alias("vocab_size"))
    used = F.when(F.col("rank") < 0, F.col("applied")).when(
        F.col("rank") < F.col("vocab_size") - (N_BYTES + n_special), -F.col("applied")).otherwise(0)
    return (at.groupBy("vocab_size").agg(F.sum(used).cast("bigint").alias("tokens")).withColumn("words", words.cast("bigint"))
            .withColumn("fertility", F.when(F.col("words") > 0, F.col("tokens") / F.col("words")).otherwise(F.lit(0.0))))


# ---------------------------------------------------------------------------
# Bits per byte and per base letter
# ---------------------------------------------------------------------------
def bpb(token_loss: DataFrame, token_bytes_df: DataFrame, n_col: str | None = None) -> DataFrame:
    """Nats of tokens with bytes > 0, over ln2 x total bytes.

    ``(bpb, total_nats, total_bytes, valid_tokens)``; zero bytes -> (inf, 0, 0, 0).  With ``n_col``
    a row stands for so many equal tokens.  ``token_bytes_df`` is vocabulary-sized, so the join
    is a broadcast (J5).
    """
    n = F.lit(1) if n_col is None else F.col(n_col)
    j = token_loss.join(F.broadcast(token_bytes_df), "token_id", "left")
    nb = F.coalesce(F.col("n_bytes"), F.lit(0))
    nats = F.sum(F.when(nb > 0, F.col("loss_nats") * n).otherwise(F.lit(0.0)))
    byts = F.sum(nb * n).cast("bigint")
    valid = F.sum(F.when(nb > 0, n).otherwise(F.lit(0))).cast("bigint")
    agg = j.agg(nats.alias("n"), byts.alias("b"), valid.alias("v"))
    zero = F.coalesce(F.col("b"), F.lit(0)) == 0
    return agg.select(
        F.when(zero, F.lit(float("inf"))).otherwise(F.col("n") / (F.lit(math.log(2)) * F.col("b"))).alias("bpb"),
        F.when(zero, F.lit(0.0)).otherwise(F.col("n")).alias("total_nats"),
        F.when(zero, F.lit(0)).otherwise(F.col("b")).cast("bigint").alias("total_bytes"),
        F.when(zero, F.lit(0)).otherwise(F.col("v")).cast("bigint").alias("valid_tokens"))


def token_unigram_bpb(docs: DataFrame, merges: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """B2 + F8 + J5 + A9: documents ``(doc_id, text, split)`` encoded with a leading special token; a
    unigram over the train tokens scores the val tokens; specials and their bytes are masked.

    Each distinct pretoken is encoded once and counts as often as it occurs in either split, and each text
    has one leading token.  ``chunks``: the :func:`chunk_counts` of the documents by split, if they are made already.
    """
    spark = docs.sparkSession
    vocab = vocab_table(spark, merges)
    bos = vocab.where("is_special").select(F.min("token_id")).first()[0]
    chunks = chunk_counts(docs, group_cols=("split",)) if chunks is None else chunks
    of = {out: F.col("split") == split for out, split in (("c", "train"), ("n", "val"))}
    texts = chunks.agg(*[F.coalesce(F.sum(F.when(here, F.col("texts"))), F.lit(0)).alias(out) for out, here in of.items()])
    words = (pretokens_of(chunks, ("split",)).groupBy("pretoken")
             .agg(*[F.coalesce(F.sum(F.when(here, F.col("freq"))), F.lit(0)).alias(out) for out, here in of.items()]))
    words = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))      # few bytes, but much work each
    tokens = bpe_encode(words, merges, "pretoken", "pretoken", keep=("c", "n")).select(F.explode("ids").alias("token_id"), "c", "n")
    counts = (tokens.unionByName(texts.select(F.lit(bos).cast("int").alias("token_id"), "c", "n"))
              .groupBy("token_id").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    ensure_checkpoint_dir(spark)
    counts = counts.checkpoint()                        # vocabulary-sized; its totals would encode all once more
    totals = counts.agg(F.sum("c").alias("N"), F.count_if(F.col("c") > 0).alias("V"))
    p = (F.col("c") + 1) / (totals.select("N").scalar() + totals.select("V").scalar() + 1)
    loss = counts.where(F.col("n") > 0).select("token_id", "n", (-F.log(p)).alias("loss_nats"))
    return bpb(loss, token_bytes(vocab), "n")


def unigram_loss(train_tokens: DataFrame, eval_tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """F8 stand-in loss: ``-ln(p)`` with add-one smoothing over the train vocabulary + 1.

    Input tables are long ``(token)`` streams; output ``(token, n_eval, loss_nats)`` per
    distinct eval token (the eval stream is aggregated before the join).
    """
    counts = train_tokens.groupBy(token_col).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.agg(F.sum("c").alias("N"), F.count(F.lit(1)).alias("V"))
    ev = eval_tokens.groupBy(token_col).agg(F.count(F.lit(1)).alias("n_eval"))
    n_tot = totals.select("N").scalar()
    v_tot = totals.select("V").scalar()
    j = ev.join(counts, token_col, "left")
    p = (F.coalesce(F.col("c"), F.lit(0)) + 1) / (n_tot + v_tot + 1)
    return j.select(token_col, F.col("n_eval").cast("bigint").alias("n_eval"), (-F.log(p)).alias("loss_nats"))


def shift_targets(ids: Column) -> tuple[Column, Column]:
    """inputs = row[:-1], targets = row[1:]."""
    n = F.size(ids) - 1
    return F.slice(ids, 1, n), F.slice(ids, 2, n)


def doc_batches(docs: DataFrame, batch_size: int = 128, order_col: str = "ordinal",
                epochs: int = 1, docs_per_shard: int = 50_000) -> DataFrame:
    """Shard, batch number inside the shard (batches never straddle shards) and a finite
    epoch counter."""
    return (docs.withColumn("shard", F.floor(F.col(order_col) / docs_per_shard).cast("bigint"))
            .withColumn("batch", F.floor((F.col(order_col) % docs_per_shard) / batch_size).cast("bigint"))
            .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))))


def char_unigram_bpb(shards: DataFrame, digits: int = 9) -> DataFrame:
    """A9 + J5 + T9 with character tokens: a unigram model fitted on each condition's train
    split and evaluated on its val split.

    Per condition: ``(condition, eval_tokens, total_nats, total_bytes, bpb, base_letters, bpbl)``.
    One pass: the per-task character combiner feeds a single aggregation with train and
    eval counts side by side; model totals come from a window over that (condition x
    alphabet) table, so the corpus is read and encoded once.
    """
    from .ambiguity import char_counts
    counts = char_counts(shards, "text", ("condition", "split"))
    per_ch = counts.groupBy("condition", "ch").agg(
        F.sum(F.when(F.col("split") == "train", F.col("n")).otherwise(F.lit(0))).alias("c"),
        F.sum(F.when(F.col("split") == "val", F.col("n")).otherwise(F.lit(0))).alias("n_eval"))
    w = Window.partitionBy("condition")
    model = (per_ch.withColumn("N", F.sum("c").over(w))
             .withColumn("V", F.count(F.when(F.col("c") > 0, F.lit(1))).over(w)))
    ev = model.where(F.col("n_eval") > 0)
    loss = -F.log((F.col("c") + 1) / (F.col("N") + F.col("V") + 1))
    # Letters: a counting letter, or an atomic unit that carries one (d3).
    letter_chars = C.COUNT_LETTERS + "".join(C.PUA_CHARS[:C.LONE_BLOCK])
    is_letter = F.instr(F.lit(letter_chars), F.col("ch")) > 0
    out = ev.groupBy("condition").agg(
        F.sum("n_eval").cast("bigint").alias("eval_tokens"),
        F.sum(F.col("n_eval") * loss).alias("nats"),
        F.sum(F.col("n_eval") * F.octet_length("ch")).cast("bigint").alias("total_bytes"),
        F.sum(F.when(is_letter, F.col("n_eval")).otherwise(F.lit(0))).cast("bigint").alias("base_letters"))
    ln2 = F.lit(math.log(2))
    return out.select(
        "condition", "eval_tokens", F.round("nats", 6).alias("total_nats"), "total_bytes",
        F.round(F.col("nats") / (ln2 * F.col("total_bytes")), digits).alias("bpb"),
        "base_letters",
        F.round(F.col("nats") / (ln2 * F.col("base_letters")), digits).alias("bpbl"))
