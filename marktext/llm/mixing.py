"""Mixing sources to target weights by pivotal dependent rounding, DataFrame operations only.

A document of a source with rate r (target words / words) is taken floor(r) times, plus once
more with probability r - floor(r).  The extra copies are drawn dependently: two documents
meet, a random share of word mass moves from one to the other until one of them is decided
(taken or not), and the undecided one goes on to the next meeting.  Mass is words times
probability, so every meeting keeps a source's expected words exactly, and the words taken
differ from the target by less than one document.

Meetings run in a reduction tree: at most about ``FAN`` documents of one source meet in a
group, each group hands one residual up, and the residuals of ``FAN`` groups meet on the next
level.  A source that holds a third of all rows has as many groups as its size asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, text_or_empty, words

FAN = 64
#: Up to so many sources the table of sources is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def draw(*parts) -> F.Column:
    """52 hash bits of the parts as a long (md5, so that other engines can repeat it)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_targets(stats: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """Adds ``weight`` and ``target`` to ``(source, source_size, ...)`` and counts the sources.

    Sources are ranked by code point, null last; weights repeat over the ranks.  Targets share
    the total size by weight, stop at ``most`` times the source's size, and what lies above is
    shared again among the rest until none is above.  Only totals come to the driver.
    """
    ordered = cut(stats.repartitionByRange(F.col("source").isNull(), F.col("source"))
                  .sortWithinPartitions(F.col("source").isNull(), "source")
                  .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = {r[0]: r[1] for r in ordered.groupBy(part).count().collect()}  # one row for each partition
    n = sum(counts.values())
    offsets, before = [], 0
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(before)]
        before += counts[p]
    if not n:
        return ordered.drop("at").withColumns({"weight": F.lit(1), "target": F.lit(0.0)}), 0
    rank = F.create_map(*offsets)[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = cut(ordered.withColumn("weight", weight).drop("at"))
    limit = F.col("source_size") * most
    total, free = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, n_capped = float(total) / free, -1
    while True:
        above = F.col("weight") * F.lit(level) > limit
        capped, mass, free = ranked.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)),
            F.sum(F.when(~above, F.col("weight")))).first()
        if capped == n_capped or not free:
            break
        n_capped, level = capped, float(total - mass) / free
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), limit.cast("double"))), n


#: One meeting: ``a`` holds the decided units and the undecided one (``cur``), ``e`` arrives.
#: s is the mass of both; the new residual is whichever stays undecided.
_MEET = """
aggregate(members,
  named_struct('done', cast(array() as array<struct<id:{id},size:bigint,copies:bigint,bit:int>>),
               'cur', cast(null as struct<id:{id},size:bigint,copies:bigint,w:double,x:double>)),
  (a, e) -> if(a.cur is null,
    named_struct('done', a.done, 'cur', e.m),
    element_at(transform(
      array(named_struct('s', a.cur.x + e.m.x,
        'up', least(a.cur.w - a.cur.x, e.m.x), 'down', least(a.cur.x, e.m.w - e.m.x),
        'u', cast(conv(substring(md5(concat_ws('|', '{seed}', coalesce(cast(a.cur.id as string), '-'),
             coalesce(cast(e.m.id as string), '-'))), 1, 13), 16, 10) as double) / 4503599627370496D)),
      v -> if(v.u * (v.up + v.down) < v.down,
        if(v.s >= a.cur.w,
          named_struct('done', concat(a.done, array(named_struct('id', a.cur.id, 'size', a.cur.size, 'copies', a.cur.copies, 'bit', 1))),
                       'cur', named_struct('id', e.m.id, 'size', e.m.size, 'copies', e.m.copies, 'w', e.m.w, 'x', v.s - a.cur.w)),
          named_struct('done', concat(a.done, array(named_struct('id', e.m.id, 'size', e.m.size, 'copies', e.m.copies, 'bit', 0))),
                       'cur', named_struct('id', a.cur.id, 'size', a.cur.size, 'copies', a.cur.copies, 'w', a.cur.w, 'x', v.s))),
        if(v.s <= e.m.w,
          named_struct('done', concat(a.done, array(named_struct('id', a.cur.id, 'size', a.cur.size, 'copies', a.cur.copies, 'bit', 0))),
                       'cur', named_struct('id', e.m.id, 'size', e.m.size, 'copies', e.m.copies, 'w', e.m.w, 'x', v.s)),
          named_struct('done', concat(a.done, array(named_struct('id', e.m.id, 'size', e.m.size, 'copies', e.m.copies, 'bit', 1))),
                       'cur', named_struct('id', a.cur.id, 'size', a.cur.size, 'copies', a.cur.copies, 'w', a.cur.w, 'x', v.s - e.m.w))))), 1)))
"""


def mix_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """How often each document is taken: ``(id, source, size, copies, source_size, target, times)``.

    Size is the number of words (null text: 0).  Rows that agree in id, source and size are
    one unit that is taken or left together; ``copies`` tells how many rows it stands for.
    A null source is a source of its own, last in order; a null id is an id like any other.
    Documents without words carry no mass: each is rounded by itself.  Draws depend on ids and
    ``seed`` alone, so reruns agree.  An empty table gives an empty result.
    """
    size = F.size(words(text_or_empty(text_col))).cast("long")
    units = cut(docs.select(column(id_col).alias("id"), column(source_col).alias("source"), size.alias("size"))
                .groupBy("id", "source", "size").agg(F.count("*").alias("copies")))
    stats = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_units"))
    targets, n_sources = source_targets(stats, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = cut(targets.withColumn("rate", rate).select(
        F.col("source").alias("s"), "source_size", "target", F.floor("rate").alias("base"),
        (F.col("rate") - F.floor("rate")).alias("frac"),
        F.ceil(F.col("n_units") / FAN).alias("n_groups")))
    n_groups = targets.agg(F.max("n_groups")).first()[0] or 0
    side = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    rated = units.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keys = ["source", "source_size", "target", "base"]
    alone = (F.col("size") == 0) | (F.col("frac") == 0)
    lonely = rated.where(alone).select(
        "id", "size", "copies", *keys,
        (draw(F.lit(seed), F.col("id")) < F.col("frac") * F.lit(2.0 ** 52)).cast("int").alias("bit"))

    mass = (F.col("size") * F.col("copies")).cast("double")
    member = F.struct("id", "size", "copies", mass.alias("w"), (mass * F.col("frac")).alias("x"))
    order = draw(F.lit(seed), F.col("id"))
    level = rated.where(~alone).select(
        *keys, F.pmod(order, F.col("n_groups")).alias("g"), order.alias("h"), member.alias("m"))
    meet = _MEET.format(id=docs.schema[id_col].dataType.simpleString(), seed=seed)
    decided = [lonely]
    while True:
        met = (level.groupBy(*keys, "g").agg(F.sort_array(F.collect_list(F.struct("h", "m"))).alias("members"))
               .select(*keys, "g", F.expr(meet).alias("r")))
        decided.append(met.select(*keys, F.explode("r.done").alias("d")).select("d.*", *keys))
        if n_groups <= 1:
            break
        # Residuals of neighbouring groups meet on the next level, in the order of their groups.
        level = met.select(*keys, F.floor(F.col("g") / FAN).alias("g"), F.col("g").alias("h"), F.col("r.cur").alias("m"))
        n_groups = -(-n_groups // FAN)
    # One undecided unit is left in each source.
    last = met.select(*keys, F.col("r.cur").alias("m")).select(
        "m.id", "m.size", "m.copies", *keys,
        (draw(F.lit(seed), F.col("m.id"), F.lit("last")) * F.col("m.w") < F.col("m.x") * F.lit(2.0 ** 52)).cast("int").alias("bit"))
    every = reduce(DataFrame.unionByName, [*decided, last])
    return every.select("id", "source", "size", "copies", "source_size", "target",
                        (F.col("base") + F.col("bit")).alias("times"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, same columns."""
    plan = mix_decisions(docs, id_col, text_col, source_col, **options).where("times > 0").select(
        F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("times").alias("_times"))
    # The row travels as one struct, so no name of the table can clash with one used here.
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(id_col).alias("id"),
                       column(source_col).alias("source"), F.size(words(text_or_empty(text_col))).cast("long").alias("size"))
    return (rows.join(plan.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id"))
                      & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
            .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times").cast("long"))))
            .select("row.*"))
