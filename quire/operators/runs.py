"""Analytics over benchmark logs: plans, medians, buckets, fits, resumption, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def measured(logs: DataFrame) -> DataFrame:
    """Runs that count: no warm-up, no failure."""
    return logs.where(~F.coalesce(F.col("warmup"), F.lit(False)) & F.coalesce(F.col("ok"), F.lit(False)))


def in_scenes(plan: DataFrame, scenes: Sequence[str]) -> DataFrame:
    return plan.where(F.col("scene").isin(*scenes) | F.col("warmup"))


def latest(logs: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return logs.withColumn("_n", n).where("_n = 1").drop("_n")


def medians(logs: DataFrame, keys: dict[str, Column], fields: Sequence[str], ratios: Sequence[str] = (), digits: int = 4, values: Sequence[str] = (), accuracy: int = 0) -> DataFrame:
    """One row per key: n, the median of each field (nulls left out), the share of each true flag, the raw values.

    Exact medians hold a key's values together; with ``accuracy`` (as of percentile_approx) they are merged sketches.
    """
    rows = logs.select(*[c.alias(k) for k, c in keys.items()], *dict.fromkeys([*fields, *ratios, *values]))
    aggs = [F.count(F.lit(1)).alias("n")]
    median = (lambda f: F.percentile_approx(f, 0.5, accuracy)) if accuracy else F.median
    aggs += [F.round(median(f), digits).alias(f"{f}_median") for f in fields]
    aggs += [F.round(F.avg(F.col(r).cast("double")), 2).alias(f"{r}_ratio") for r in ratios]
    aggs += [F.array_sort(F.collect_list(v)).alias(f"{v}_values") for v in values]
    return rows.groupBy(*keys).agg(*aggs)


def fit(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares y = a + b x: null with fewer than two points or one x."""
    return rows.groupBy(*keys).agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"))


def robust_fit(rows: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """The line through the medians of the lowest and the highest quarter by x; keys with 4 points or more."""
    w = Window.partitionBy(*keys)
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = r.withColumns({"_i": F.row_number().over(w.orderBy(x, y)) - 1, "_n": F.count(F.lit(1)).over(w)}).where("_n >= 4")
    low, high = F.col("_i") < F.floor(F.col("_n") / 4), F.col("_i") >= F.floor(3 * F.col("_n") / 4)
    q = r.groupBy(*keys).agg(*[F.median(F.when(side, F.col(c))).alias(a) for side, c, a in ((low, x, "_x1"), (low, y, "_y1"), (high, x, "_x2"), (high, y, "_y2"))])
    b = F.when(F.col("_x2") != F.col("_x1"), (F.col("_y2") - F.col("_y1")) / (F.col("_x2") - F.col("_x1")))
    return q.select(*keys, (F.col("_y1") - b * F.col("_x1")).alias("a"), b.alias("b")).where("b is not null")


def crossover(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """x at which two lines meet; null if they are parallel."""
    return (a2 - a1) / F.nullif(b1 - b2, F.lit(0.0))


def bucket(x: Column, edges: Sequence[float]) -> Column:
    """Label of the half-open interval; what lies beyond the last edge has a label of its own."""
    out = F.when(x < edges[0], None)
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(x < hi, f"{lo:g}-{hi:g}")
    return out.otherwise(f">{edges[-1]:g}")


def size_buckets(rows: DataFrame, size: str, version: str, value: str, versions: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Per bucket: n, the median size, and the median value of each version."""
    b = rows.withColumn("bucket", bucket(F.col(size), edges)).where("bucket is not null")
    per = [F.median(F.when(F.col(version) == v, F.col(value))).alias(f"median_{i}") for i, v in enumerate(versions, 1)]
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.median(size).alias("median_size"), *per)


def consistency(rows: DataFrame, key: str, version: str, value: str, versions: int) -> DataFrame:
    """Whether all versions are there and agree."""
    return rows.groupBy(key).agg((F.countDistinct(version) == versions).alias("complete"), (F.countDistinct(value) == 1).alias("agree"))


def wins(rows: DataFrame, key: str, version: str, value: str, base: str, others: Sequence[str]) -> DataFrame:
    """How often each other version beats the base, over keys that have both (medians per key and version)."""
    p = rows.groupBy(key).agg(*[F.median(F.when(F.col(version) == v, F.col(value))).alias(f"v{i}") for i, v in enumerate([base, *others])])
    arms = [F.struct(F.lit(o).alias("version"), F.count(F.when(F.col(f"v{i}") < F.col("v0"), 1)).alias("wins"), F.count(F.when(F.col(f"v{i}").isNotNull() & F.col("v0").isNotNull(), 1)).alias("compared")) for i, o in enumerate(others, 1)]
    return p.agg(F.array(*arms).alias("a")).select(F.inline("a"))


def first_of(rows: DataFrame, key: str, order: str, value: str, n: int, also: Sequence[Column] = ()) -> DataFrame:
    """(key, texts): the first n values of each key in order; no more than n of a key are held at once."""
    got = F.row_number().over(Window.partitionBy(key).orderBy(order))
    top = rows.select(key, order, value, got.alias("_n")).where(F.col("_n") <= n).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda s: s[value]).alias("texts"))
    return top.join(rows.groupBy(key).agg(*also), key) if also else top


def resume(plan: DataFrame, done: DataFrame, key: str = "run_id") -> DataFrame:
    """What of the plan has no result."""
    return plan.join(done.select(key), key, "left_anti")


def reconcile(expected: DataFrame, done: DataFrame, key: str, error: str = "no result") -> DataFrame:
    """Results, and a failure row for everything expected that has none: key, success, error."""
    ok = done.select(key, F.lit(True).alias("success"), F.lit("").alias("error"))
    lost = expected.select(key).join(done.select(key), key, "left_anti").select(key, F.lit(False).alias("success"), F.lit(error).alias("error"))
    return ok.unionByName(lost)


def completed(chunks: DataFrame, key: str, total: str) -> DataFrame:
    """Keys all of whose chunks are there."""
    g = chunks.groupBy(key).agg(F.countDistinct("chunk_index").alias("n"), F.max(total).alias("of"))
    return g.where("n = of").select(key)


def plan_runs(samples: DataFrame, versions: Sequence[str], scene: str, repeats: int) -> DataFrame:
    """Every version x sample x repeat of a scene.  versions and repeats are parameters, not data."""
    spark = samples.sparkSession
    grid = spark.createDataFrame([(v, r) for v in versions for r in range(1, repeats + 1)], "version string, repeat int")
    p = samples.select("sample_id").crossJoin(F.broadcast(grid))
    return p.select(F.concat_ws("-", F.lit(scene), "version", "sample_id", "repeat").alias("run_id"), F.lit(scene).alias("scene"), "version", "sample_id", "repeat")


def bench_plan(samples: DataFrame, versions: Sequence[str], modes: dict[str, str], warm: str, detect: Sequence[str], repeats: int = 3) -> DataFrame:
    """The whole plan over (sample_id, encoding): run_id, scene, version, sample_id, encoding, repeat, mode, warmup.

    A warm-up per version on one sample (the first there is if ``warm`` is none); every version x sample x repeat of
    parsing (S1) and of whole conversion (S2); a batch of all UTF-8 samples per mode (mode -> its version, S3); detection
    by the last version for some samples (A1).  versions, modes and repeats are parameters, not data.
    """
    spark, s = samples.sparkSession, samples.select("sample_id", "encoding")

    def runs_of(tag: str, scene: str, which: DataFrame, names: Sequence[str], n: int, warmup: bool = False) -> DataFrame:
        grid = spark.createDataFrame([(v, r) for v in names for r in range(1, n + 1)], "version string, repeat int")
        p = which.crossJoin(F.broadcast(grid))
        run_id = F.concat_ws("-", F.lit(tag), "version", "sample_id", *([] if warmup else ["repeat"]))
        return p.select(run_id.alias("run_id"), F.lit(scene).alias("scene"), "version", "sample_id", "encoding", "repeat", F.lit("").alias("mode"), F.lit(warmup).alias("warmup"))

    first = s.agg(F.min_by(F.struct("sample_id", "encoding"), F.struct(F.col("sample_id") != warm, "sample_id")).alias("w")).where("w is not null").select("w.*")
    ids = s.where("encoding = 'utf-8'").agg(F.expr("listagg(sample_id, '+') within group (order by sample_id)").alias("sample_id")).where("sample_id is not null")
    grid = spark.createDataFrame([(m, v, r) for m, v in modes.items() for r in range(1, repeats + 1)], "mode string, version string, repeat int")
    batch = ids.crossJoin(F.broadcast(grid)).select(F.concat_ws("-", F.lit("S3"), "mode", "repeat").alias("run_id"), F.lit("batch").alias("scene"), "version", "sample_id", F.lit("utf-8").alias("encoding"), "repeat", "mode", F.lit(False).alias("warmup"))
    parts = [runs_of("WARM", "parse", first, versions, 1, True), runs_of("S1", "parse", s, versions, repeats), runs_of("S2", "full", s, versions, repeats), batch, runs_of("A1", "detect", s.where(F.col("sample_id").isin(*detect)), versions[-1:], repeats)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def numbered(rows: DataFrame, by: str, order: Sequence[Column], name: str = "no", parts: int = 200) -> DataFrame:
    """Rows numbered from 1 in ``order``, which begins with the numeric column ``by``.

    Ranges of ``by`` are numbered each for itself, after the rows of the ranges before; only the ranges' counts
    come together.  The bounds are quantiles; nulls come first.
    """
    bounds = rows.agg(F.percentile_approx(F.col(by).cast("double"), [i / parts for i in range(1, parts)], 10_000).alias("b")).head()["b"]
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]), lambda b: b < F.col(by).cast("double")))
        part = F.when(F.col(by).isNull(), -1).otherwise(part)
    dealt = rows.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # as many rows as parts
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_i") + F.col("_before")).cast("int")).drop("_part", "_i", "_before")


def totals(results: DataFrame, success: str, count: str) -> DataFrame:
    """One row: books, ok, failed, chapters, percent done."""
    ok = F.count(F.when(F.col(success), 1))
    return results.agg(F.count(F.lit(1)).alias("books"), ok.alias("ok"), (F.count(F.lit(1)) - ok).alias("failed"), F.sum(F.when(F.col(success), F.col(count)).otherwise(0)).cast("long").alias("chapters"), F.round(100.0 * ok / F.count(F.lit(1)), 2).alias("percent"))


def seeded_order(plan: DataFrame, seed: int, key: str = "run_id") -> DataFrame:
    """The same shuffled order for the same seed, warm-ups first; seq from 0.  A plan is a parameter grid, not data."""
    w = Window.orderBy(~F.col("warmup"), F.md5(F.concat_ws(":", F.lit(str(seed)), key)))
    return plan.withColumn("seq", F.row_number().over(w) - 1)


def sequence_diff(a: DataFrame, b: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Per key: lengths, positions of the common prefix length that differ, and whether lengths differ."""
    x, y = (d.select(key, F.col(pos).alias("_p"), F.col(value).alias(n)) for d, n in ((a, "_a"), (b, "_b")))
    j = x.join(y, [key, "_p"], "full")
    differ = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b")), 1))
    return j.groupBy(key).agg(F.count("_a").alias("len_a"), F.count("_b").alias("len_b"), differ.alias("mismatches"), (F.count("_a") != F.count("_b")).alias("lengths_differ"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b does not have."""
    return a.subtract(b)


def encoding_chains(files: DataFrame, encoding: str, size: str, file: str) -> DataFrame:
    """Files by encoding, large first."""
    order = F.struct((-F.col(size)).alias("k"), F.col(file).alias("f"))
    return files.groupBy(encoding).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("total_bytes"), F.transform(F.array_sort(F.collect_list(order)), lambda s: s["f"]).alias("files"))


def chain_summary(files: DataFrame, encoding: str, size: str) -> DataFrame:
    return files.groupBy(encoding).agg(F.count(F.lit(1)).alias("n_files"), F.round(F.sum(size) / 1048576, 2).alias("total_mb"))


def unique_paths(files: DataFrame, folder: Column, stem: Column, ext: str, order: Sequence[Column], taken: DataFrame | None = None) -> DataFrame:
    """out_path: equal stems of a folder get _1, _2, ... in order, past the names that other stems or ``taken``
    (column path) already have.

    A stem's files are numbered by window; the numbers it must leave out are those n for which the folder has, or
    wants, the stem with _n.  So a.txt, x/a.txt and a_1.txt give a, a_2, a_1.  Chains (a stem that ends in _n is
    itself numbered) give more underscores, which no other stem of the folder has.
    """
    f = files.withColumns({"_f": folder, "_s": stem})
    kinds = files.columns
    wanted = f.select("_f", "_s").distinct()
    if taken is not None:
        path = F.regexp_extract("path", r"^(.*)/([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/([^/]*)$", 2)
        held = taken.select(path[0].alias("_f"), path[1].alias("_x")).where(F.col("_x").endswith(ext))
        wanted = wanted.unionByName(held.select("_f", F.expr(f"substring(_x, 1, length(_x) - {len(ext)})").alias("_s"))).distinct()
        own = held.select("_f", F.expr(f"substring(_x, 1, length(_x) - {len(ext)})").alias("_s"), F.lit(1).alias("_own")).distinct()
    # numbers that a stem must leave out: stem_n is a stem too
    parts = wanted.select("_f", F.regexp_extract("_s", r"(?s)^(.*)_([1-9]\d{0,8})$", 1).alias("_s"), F.regexp_extract("_s", r"(?s)^(.*)_([1-9]\d{0,8})$", 2).alias("_n"))
    out = parts.where("_n <> ''").groupBy("_f", "_s").agg(F.array_sort(F.collect_set(F.col("_n").cast("int"))).alias("_out"))
    k = f.withColumn("_k", F.row_number().over(Window.partitionBy("_f", "_s").orderBy(*order)) - 1).join(out, ["_f", "_s"], "left")
    if taken is not None:
        k = k.join(own, ["_f", "_s"], "left").withColumn("_k", F.col("_k") + F.coalesce("_own", F.lit(0)))
    # the k-th number that is not left out: each left-out number up to it moves it on
    moved = F.aggregate(F.coalesce("_out", F.array().cast("array<int>")), F.col("_k"), lambda at, n: F.when((at > 0) & (n <= at), at + 1).otherwise(at))
    name = F.concat("_f", F.lit("/"), "_s", F.when(F.col("_k") > 0, F.concat(F.lit("_"), moved.cast("string"))).otherwise(F.lit("")), F.lit(ext))
    return k.withColumn("out_path", name).select(*kinds, "out_path")
