"""Embedding-table structure.

Scale notes
-----------
* A18 never forms pairs: the mean off-diagonal cosine of a group is
  ``(|sum u|^2 - sum |u|^2) / (n (n - 1))`` over unit vectors u, so each group needs
  only its vector sum, summed per map task first, so one huge group never lands whole in
  one task and a vector stays one row.
* A20 (cross-group) is the dot product of two mean unit vectors: again sums only.
* PCA (A22) uses Spark ML's distributed covariance; data is centred first.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_before

NORM_FLOOR = 1e-10


# ---------------------------------------------------------------------------
# Cosine pieces
# ---------------------------------------------------------------------------
def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit_vector(vec: Column) -> Column:
    """v / max(|v|, 1e-10), as doubles."""
    n = F.greatest(l2_norm(vec), F.lit(NORM_FLOOR))
    return F.transform(vec, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def group_sums(df: DataFrame, group_cols: tuple[str, ...] = ("label",), vec_col: str = "embedding") -> DataFrame:
    """``(group..., n, s array<double>, q)``: per group the number of vectors, the sum of their unit
    vectors and of the squared lengths of these, in one aggregation with partial sums per task.

    Rows without a vector are left out; a NULL group is a group.
    """
    unit = df.where(F.col(vec_col).isNotNull()).select(*group_cols, unit_vector(F.col(vec_col)).alias("_u"))
    rows = unit.select(*group_cols, array_to_vector("_u").alias("_v"), dot(F.col("_u"), F.col("_u")).alias("_q"))
    return rows.groupBy(*group_cols).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                         vector_to_array(Summarizer.sum(F.col("_v"))).alias("s"), F.sum("_q").alias("q"))


# ---------------------------------------------------------------------------
# A18 / A19 / P10
# ---------------------------------------------------------------------------
def group_cosine(df: DataFrame, group_col: str = "label", vec_col: str = "embedding",
                 digits: int | None = 9) -> DataFrame:
    """Per group, mean cosine over ordered pairs of distinct members; NULL if n < 2.

    ``(group, n_vectors, mean_cosine)``.
    """
    n = F.col("n")
    mean = F.when(n >= 2, (dot(F.col("s"), F.col("s")) - F.col("q")) / (n * (n - 1)))
    if digits is not None:
        mean = F.round(mean, digits)
    return group_sums(df, (group_col,), vec_col).select(group_col, n.alias("n_vectors"), mean.alias("mean_cosine"))


def interpret(mean: Column) -> Column:
    """P10: coarse reading of an overall mean cosine."""
    return (F.when(mean < 0.15, "very_low").when(mean < 0.3, "low").otherwise("moderate"))


def overall_cosine(per_group: DataFrame, digits: int | None = 9) -> DataFrame:
    """A19 + P10: unweighted mean and sample std of the non-null group means.

    Mean 0 when there is no group; std 0 with fewer than two groups.
    """
    valid = per_group.where(F.col("mean_cosine").isNotNull())
    mean = F.coalesce(F.avg("mean_cosine"), F.lit(0.0))
    std = F.when(F.count(F.lit(1)) > 1, F.stddev_samp("mean_cosine")).otherwise(F.lit(0.0))
    if digits is not None:
        mean, std = F.round(mean, digits), F.round(std, digits)
    out = valid.agg(F.count(F.lit(1)).cast("bigint").alias("n_groups"),
                    mean.alias("overall_mean"), std.alias("overall_std"))
    return out.withColumn("interpretation", interpret(F.col("overall_mean")))


# ---------------------------------------------------------------------------
# Cross-group cosine (closed form)
# ---------------------------------------------------------------------------
def cross_group_cosine(a: DataFrame, b: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Mean cosine over every (x in a, y in b) pair = mean(u_a) . mean(u_b); no pairs built."""
    sa, sb = group_sums(a, (), vec_col), group_sums(b, (), vec_col)
    both = sa.select("n", "s", sb.select("n").scalar().alias("nb"), sb.select("s").scalar().alias("sb"))
    return both.select((dot(F.col("s"), F.col("sb")) / (F.col("n") * F.col("nb"))).alias("cross_cosine"))


def cosine_to_rest(df: DataFrame, group_col: str = "label", vec_col: str = "embedding",
                   digits: int | None = 9) -> DataFrame:
    """A20 for every group against all other rows: ``(group, cosine_to_rest)``.

    The rest's sum is the sum over all groups minus the group's; NULL if there is no other row.
    """
    groups = group_sums(df, (group_col,), vec_col)
    total = groups.agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    groups = groups.withColumns({"_n": total.select("n").scalar(), "_s": total.select("s").scalar()})
    rest_n = F.col("_n") - F.col("n")
    rest = F.zip_with("_s", "s", lambda t, x: t - x)
    val = F.when(rest_n > 0, dot(F.col("s"), rest) / (F.col("n") * rest_n))
    if digits is not None:
        val = F.round(val, digits)
    return groups.select(group_col, val.alias("cosine_to_rest"))


# ---------------------------------------------------------------------------
# A23 / O4 / O5 / K9
# ---------------------------------------------------------------------------
def group_frequency(df: DataFrame, group_col: str = "label", k: int = 10) -> DataFrame:
    """The k most common groups (count desc, then group key)."""
    counts = df.groupBy(group_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    w = Window.orderBy(F.desc("n"), group_col)
    top = counts.orderBy(F.desc("n"), group_col).limit(k)
    return top.select(F.row_number().over(w).cast("int").alias("rank"), group_col, "n")


def groups_by_cosine(per_group: DataFrame, group_col: str = "label") -> DataFrame:
    """O5 + K9: groups with a cosine, ascending, each with the overall mean line."""
    valid = per_group.where(F.col("mean_cosine").isNotNull())
    overall = valid.select(F.avg("mean_cosine")).scalar()
    ranked = running_before(valid.select(group_col, "mean_cosine"), ("mean_cosine", group_col))
    return ranked.select((F.col("before") + 1).cast("int").alias("position"), group_col, "mean_cosine",
                         F.round(overall, 9).alias("overall_mean"))


# ---------------------------------------------------------------------------
# Mapping groups joined to a vocabulary
# ---------------------------------------------------------------------------
def letter_groups(mapping: DataFrame) -> DataFrame:
    """Mapping entries whose sequence starts with a letter, keyed by that letter."""
    return mapping.where(F.col("base").isNotNull()).select("base", "seq", "pua", "codepoint")


def singleton_tokens(items: DataFrame, vocab: DataFrame, item_col: str, token_col: str = "token_text") -> DataFrame:
    """Items that are exactly one vocabulary token -> its id (inner equi join)."""
    return items.join(vocab.select(F.col(token_col).alias(item_col), "token_id"), item_col)


def skipped_items(items: DataFrame, vocab: DataFrame, item_col: str, token_col: str = "token_text") -> DataFrame:
    """J3 anti side: items with no single-token id."""
    return items.join(vocab.select(F.col(token_col).alias(item_col)), item_col, "left_anti")


# ---------------------------------------------------------------------------
# PCA
# ---------------------------------------------------------------------------
def pca_2d(df: DataFrame, vec_col: str = "embedding", id_cols: tuple[str, ...] = ("vec_id", "label"),
           k: int = 2) -> tuple[DataFrame, list[float]]:
    """Centred PCA coordinates and explained-variance ratios.

    Spark's PCA does not centre; StandardScaler(withMean, no scaling) does it first.
    Component signs are fixed so the largest-magnitude loading is positive.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = df.select(*id_cols, array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    scaler = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(vec)
    centred = scaler.transform(vec)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    projected = model.transform(centred)
    arr = vector_to_array(projected["p"])
    cols = [(arr[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)]
    return (projected.select(*id_cols, *cols),
            [float(x) for x in model.explainedVariance.toArray()])


def covariance(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``(i, j, cov)`` for i <= j: sample covariance of the dimensions, null for one vector.

    One scan: means, then a task adds up the centred products of its vectors as one packed
    triangle of d (d + 1) / 2 numbers, and Spark sums triangles by position.
    """
    vectors = df.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v"))
    means = {r["i"]: r["m"] for r in vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()}
    center = [means[i] for i in range(len(means))]

    def triangle(batches):
        import numpy as np
        import pyarrow as pa
        d, total, n = len(center), None, 0
        for b in batches:
            x = np.array(b.column("v").to_pylist(), float).reshape(-1, d) - np.array(center)
            part = x.T @ x
            total, n = part if total is None else total + part, n + len(x)
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j],
                                              "n": np.full(len(i), n, np.int64)})

    return (vectors.mapInArrow(triangle, "i int, j int, s double, n long").groupBy("i", "j")
            .agg(F.try_divide(F.sum("s"), F.sum("n") - 1).alias("cov")))


def explained_variance(cov: DataFrame, digits: int = 9) -> DataFrame:
    """``(axis, variance, share)`` of the principal axes, the largest first, from a covariance
    triangle (d (d + 1) / 2 rows, whatever the number of vectors)."""
    import numpy as np
    rows = cov.collect()
    d = 1 + max((r["j"] for r in rows), default=-1)
    matrix = np.zeros((d, d))
    for r in rows:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = np.nan if r["cov"] is None else r["cov"]
    found = np.full(d, np.nan) if np.isnan(matrix).any() else np.linalg.eigvalsh(matrix)[::-1]
    total = found.sum()
    out = [(k + 1, *((None, None) if np.isnan(v) else (round(float(v), digits), round(float(v / total), digits) if total else None)))
           for k, v in enumerate(found)]
    return cov.sparkSession.createDataFrame(out, "axis int, variance double, share double")


# ---------------------------------------------------------------------------
# T11 + J3 + T10: mapping groups against a trained vocabulary
# ---------------------------------------------------------------------------
def letter_names(spark) -> "DataFrame":
    """36-row dimension ``(letter, letter_name)`` — last word of the Unicode name."""
    import unicodedata

    from ..functions import chars as C
    rows = [(ch, unicodedata.name(ch).split()[-1].lower()) for ch in C.MAP_LETTERS]
    return spark.createDataFrame(rows, "letter string, letter_name string")


def mapping_token_groups(mapping: DataFrame, vocab: DataFrame) -> DataFrame:
    """J3 + P9 + T10 + T11: per base letter, mapping entries that are single vocabulary
    tokens (with their mark labels) and the ones skipped.  All inputs are bounded
    dimensions (621 mapping rows, vocabulary-sized), so both sides are broadcastable.
    """
    from ..functions import text as X
    groups = letter_groups(mapping).withColumnRenamed("pua", "token_text")
    found = groups.join(F.broadcast(vocab.select("token_text", "token_id")), "token_text", "left")
    labelled = found.withColumn("label", X.mark_label(F.col("seq")))
    names = letter_names(mapping.sparkSession)
    return (labelled.groupBy("base")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_entries"),
                 F.count("token_id").cast("bigint").alias("n_single_tokens"),
                 F.sort_array(F.collect_list(F.when(F.col("token_id").isNotNull(), F.col("label"))))
                 .alias("token_labels"))
            .withColumn("n_skipped", F.col("n_entries") - F.col("n_single_tokens"))
            .join(F.broadcast(names), F.col("base") == F.col("letter"), "left")
            .select("base", "letter_name", "n_entries", "n_single_tokens", "n_skipped", "token_labels"))


def token_vectors(tokens: DataFrame, embeddings: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Tokens with their embedding (``vec_id`` is the token id); tokens without a vector drop out."""
    return tokens.join(embeddings.select(F.col("vec_id").cast("int").alias("token_id"), vec_col), "token_id")


def letter_cosine(mapping: DataFrame, vocab: DataFrame, embeddings: DataFrame) -> DataFrame:
    """J3 + A18 per base letter: how alike the vectors of a letter's single-token units are, with the
    overall mean and its reading (A19, P10) on every row."""
    tokens = singleton_tokens(letter_groups(mapping).select("base", "pua"), vocab.where(~F.col("is_special")), "pua")
    per = group_cosine(token_vectors(tokens, embeddings), "base")
    overall = overall_cosine(per)
    return per.select("*", *[overall.select(c).scalar().alias(c) for c in overall.columns])


def mark_letter_cosine(vocab: DataFrame, embeddings: DataFrame) -> DataFrame:
    """J4 + A18 + A20: marks and letters that are single tokens: the mean cosine among marks, among
    letters, and across, ``(n_marks, n_letters, marks, letters, cross)``."""
    from ..functions import chars as C
    spark = vocab.sparkSession
    plain = vocab.where(~F.col("is_special"))
    kinds = spark.createDataFrame([(c, "mark") for c in C.MARKS] + [(c, "letter") for c in C.MAP_LETTERS], "ch string, kind string")
    found = token_vectors(singleton_tokens(kinds, plain, "ch"), embeddings)
    sums = group_sums(found, ("kind",))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    one = sums.agg(*[pick(k, c).alias(f"{k}_{c}") for k in ("mark", "letter") for c in ("n", "s", "q")])

    def within(k):
        n, s = F.col(f"{k}_n"), F.col(f"{k}_s")
        return F.round(F.when(n >= 2, (dot(s, s) - F.col(f"{k}_q")) / (n * (n - 1))), 9)

    cross = F.round(dot(F.col("mark_s"), F.col("letter_s")) / (F.col("mark_n") * F.col("letter_n")), 9)
    zero = F.lit(0).cast("bigint")
    return one.select(F.coalesce("mark_n", zero).alias("n_marks"), F.coalesce("letter_n", zero).alias("n_letters"),
                      within("mark").alias("marks"), within("letter").alias("letters"), cross.alias("cross"))


# ---------------------------------------------------------------------------
# O6 / A21
# ---------------------------------------------------------------------------
def sample_rows(df: DataFrame, n: int = 200, seed: int = 42, id_col: str = "token_id") -> DataFrame:
    """``n`` rows without replacement, all when there are fewer; deterministic per seed.

    Same contract as a seeded shuffle-and-take (not the same generator): rows ordered by
    ``xxhash64(seed, id)`` and cut at n — planned as a per-partition top-n, no full sort.
    """
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)).limit(n)


def pair_token_cosine(vocab: DataFrame, embeddings: DataFrame, vec_col: str = "embedding",
                      digits: int | None = 9) -> DataFrame:
    """letter+mark pair tokens (T12 'pair') grouped by their base letter; mean
    intra-group cosine for groups of at least two tokens (closed form, no pairs)."""
    from ..functions import text as X
    trimmed = F.regexp_replace(F.col("token_text"), F.lit("^[" + X.C.PYWS_CLASS + "]+|[" + X.C.PYWS_CLASS + "]+$"), "")
    pairs = (vocab.where(X.token_class(F.col("token_text")) == "pair")
             .select("token_id", F.substring(trimmed, 1, 1).alias("base")))
    joined = pairs.join(embeddings.select(F.col("vec_id").cast("int").alias("token_id"), vec_col), "token_id")
    per = group_cosine(joined, "base", vec_col, digits)
    return per.where(F.col("n_vectors") >= 2)
