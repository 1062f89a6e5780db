"""Filter interaction audit: which of five filters removes which documents, in every order.

Four filters are functions of the text alone and are JVM expressions.  The fifth, identity with
the text of a smaller id, is found through radix text tries: texts are range-partitioned by
prefixes that are as long as their weight asks for, every range inserts its whole texts into one
compressed trie whose terminals hold the smallest id, and a traversal gives the id that is first
for every text; a document that is not first fails.  Failures become a five-bit mask, masks are
counted by part, and the 120 orders are read off those counts.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_before
from .common import column, cut, give_back, text_or_empty, words

#: Weight of a range of texts in bytes, and the most ranges (their bounds are broadcast).
RANGE_BYTES = 1 << 20
MAX_RANGES = 1 << 18
#: Added to the weight of every text, so that a range of very short texts has not too many.
TEXT_WEIGHT = 256
#: First length of a prefix; a prefix that weighs more than a range grows four times as long.
PREFIX = 16
#: Bytes of text that a map task combines before it sends them on.
TRIE_BYTES = 32 << 20

FILTERS = "ABCDE"


class RadixTrie:
    """Compressed trie over bytes; terminals hold the smallest value inserted for their text.

    A node is ``[label, children by first byte, value]``; values are ``(id is null, id, version)``.
    """

    def __init__(self):
        self.root, self.held = [b"", {}, None], 0

    def insert(self, text: bytes, value: tuple) -> None:
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, value]
                self.held += end - at + TEXT_WEIGHT
                return
            label = child[0]
            if not text.startswith(label, at):
                same = self._common(label, text, at)
                child[0] = label[same:]
                middle = [label[:same], {label[same]: child}, None]
                node[1][text[at]] = middle
                self.held += TEXT_WEIGHT
                child, label = middle, middle[0]
            node, at = child, at + len(label)
        if node[2] is None or value < node[2]:
            node[2] = value

    @staticmethod
    def _common(label: bytes, text: bytes, at: int) -> int:
        """Length of the common prefix of ``label`` and ``text[at:]`` (shorter than the label)."""
        low, high = 0, min(len(label), len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if text.startswith(label[low:middle], at + low):
                low = middle
            else:
                high = middle - 1
        return low

    def __iter__(self):
        """``(text, value)`` of every terminal, in the order of bytes."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2]
            stack.extend((node[1][k], text) for k in sorted(node[1], reverse=True))


def range_bounds(texts: DataFrame, range_bytes: int = RANGE_BYTES, max_ranges: int = MAX_RANGES) -> list[bytes]:
    """Lower bounds of the ranges: prefixes such that texts between two bounds weigh about
    ``range_bytes``.  ``texts``: ``text``, ``version`` (its hash).

    A prefix that weighs more and covers several texts is looked at again, four times as long.
    All rows are weighed; at most total / range_bytes + 1 bounds a round reach the driver.
    """
    texts = texts.select("text", "version", (F.octet_length("text") + TEXT_WEIGHT).cast("long").alias("w"))
    total = texts.agg(F.sum("w")).first()[0] or 0
    size = max(range_bytes, total // max_ranges + 1)
    bounds, depth, heavy = {b""}, PREFIX, None
    while total:
        if heavy is not None:
            texts = texts.join(F.broadcast(heavy), F.substring("text", 1, depth // 4) == F.col("_heavy"), "left_semi")
        weights = cut(texts.groupBy(F.substring("text", 1, depth).alias("p")).agg(
            F.sum("w").alias("w"), (F.min("version") != F.max("version")).alias("several")))
        placed = running_before(weights.select("p", "w"), ("p",), "w", out="before")
        firsts = placed.groupBy(F.expr(f"before div {size}L").alias("r")).agg(F.min("p").alias("p"))
        bounds.update(bytes(r["p"]) for r in firsts.select(F.col("p").cast("binary").alias("p")).toLocalIterator())
        heavy = weights.where((F.col("w") > size) & F.col("several")).select(F.col("p").alias("_heavy"))
        if heavy.isEmpty():
            break
        depth *= 4
    return sorted(bounds)


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(id, version)``: for every distinct text its smallest id (nulls last); ``version`` is the
    text's hash, so that a row is looked up with its id and its own text.

    Map tasks put their texts into tries of bounded size first, so a text with very many copies
    leaves a task as one row; a range's task holds the distinct texts of one range at a time.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    bounds = spark.sparkContext.broadcast(range_bounds(rows.select("text", "version"), range_bytes))
    id_kind = rows.schema["id"].dataType
    id_type = id_kind.simpleString()

    def batches_of(found, part_of=None, size=4 << 20):
        """Record batches of ``(text, value)`` pairs, with the range and text if asked for."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        kind, out, held = to_arrow_type(id_kind), [], 0

        def batch():
            data = {"id": pa.array([v[1] for _, v, _ in out], kind), "version": pa.array([v[2] for _, v, _ in out], pa.int64())}
            if part_of:
                data = {"part": pa.array([p for _, _, p in out], pa.int32()), **data, "text": pa.array([t for t, _, _ in out], pa.binary())}
            return pa.RecordBatch.from_pydict(data)

        for text, value in found:
            out.append((text, value, part_of(text) if part_of else 0))
            held += len(text) + 64
            if held >= size:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    def combine(batches):
        lower, trie = bounds.value, RadixTrie()
        for b in batches:
            for i, v, t in zip(b.column("id").to_pylist(), b.column("version").to_pylist(), b.column("text").to_pylist()):
                trie.insert(t, (i is None, i, v))
            if trie.held >= TRIE_BYTES:
                yield from batches_of(trie, lambda t: bisect_right(lower, t) - 1)
                trie = RadixTrie()
        yield from batches_of(trie, lambda t: bisect_right(lower, t) - 1)
        give_back()

    def settle(batches):
        trie, current = RadixTrie(), None
        for b in batches:
            for p, i, v, t in zip(*(b.column(c).to_pylist() for c in ("part", "id", "version", "text"))):
                if p != current:
                    yield from batches_of(trie)
                    trie, current = RadixTrie(), p
                trie.insert(t, (i is None, i, v))
        yield from batches_of(trie)
        give_back()

    sent = rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(
        combine, f"part int, id {id_type}, version long, text binary")
    return (sent.repartition("part").sortWithinPartitions("part")
            .mapInArrow(settle, f"id {id_type}, version long"))


def text_mask(text: Column, min_words: int, distinct_percent: int, capital_percent: int, symbols: str) -> Column:
    """Bits 1, 2, 4, 8 for the failures of filters A to D."""
    w = words(text)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bits = [F.size(w) < min_words, 100 * F.size(F.array_distinct(w)).cast("long") < distinct_percent * F.size(w).cast("long"),
            100 * capitals.cast("long") > capital_percent * F.length(text).cast("long"), text.rlike(symbols)]
    return sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                  min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10,
                  symbols: str = "[#$%&*|]", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(id, part, mask)`` of every row: which of the five filters (bits of ``ABCDE``) it fails.

    Null texts are empty, a null part is the empty string.  A null id is larger than any other,
    so its row fails E where a row with an id has the same text; rows with equal ids (repeated
    rows, several null ids) are not smaller than each other.  Other columns are ignored.
    """
    text = text_or_empty(text_col)
    slim = docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("version"),
                       F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"),
                       text_mask(text, min_words, distinct_percent, capital_percent, symbols).alias("mask"))
    firsts = first_copies(docs, id_col, text_col, range_bytes).select(
        F.col("id").alias("_id"), F.col("version").alias("_version"), F.lit(0).alias("_first"))
    met = slim.join(firsts.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    return met.select("id", "part", (F.col("mask") + F.coalesce(F.col("_first"), F.lit(16))).alias("mask"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic", **filters) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley)`` for every part, order of the five filters and step, zeros included.

    A document has a label if any row of ``labels`` with its id says 1; ids that are null have
    none, and label rows of unknown ids do nothing.  ``shapley`` sums what the step's filter
    removes over all 120 orders: a document that fails m filters is removed by each of them in
    120 / m orders.  An empty table gives an empty result.
    """
    said = (labels.where(column(id_col).isNotNull()).groupBy(column(id_col).alias("_label"))
            .agg(F.max(F.when(column(quality_col) == 1, 1).otherwise(0)).alias("_good"),
                 F.max(F.when(column(toxic_col) == 1, 1).otherwise(0)).alias("_toxic")))
    masks = failure_masks(docs, id_col, text_col, part_col, **filters)
    counts = cut(masks.join(said, F.col("id") == F.col("_label"), "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("_good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("_toxic", F.lit(0))).alias("toxic")))

    # 600 (order, step) pairs: the step's own bit and the bits of the filters before it.
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [(order, k + 1, bit[f], sum(bit[g] for g in order[:k]))
             for order in map("".join, permutations(FILTERS)) for k, f in enumerate(order)]
    literal = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"e":{e}}}' for o, s, b, e in steps) + "]"),
                          "array<struct<o:string,s:int,b:int,e:int>>")
    at = counts.select("*", F.explode(literal).alias("t")).select("*", "t.*")
    own, before = F.col("mask").bitwiseAND(F.col("b")) != 0, F.col("mask").bitwiseAND(F.col("e")) != 0
    def total(which: Column, amount) -> Column:
        return F.sum(F.when(which, amount).otherwise(F.lit(0))).cast("long")

    n = F.col("n")
    return at.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step")).agg(
        total(~own & ~before, n).alias("kept"), total(own & ~before, n).alias("removed"),
        total(own & before, n).alias("redundant"), total(F.col("mask") == F.col("b"), n).alias("unique_fails"),
        total(own & ~before, F.col("good")).alias("good_lost"), total(own & ~before, F.col("toxic")).alias("toxic_lost"),
        total(own, n * F.expr("120 div bit_count(mask)")).alias("shapley"))
