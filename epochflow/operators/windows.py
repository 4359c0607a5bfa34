"""Windows over sample-indexed streams, blocks of equal labels, and folds that keep blocks together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def sample_index(df: DataFrame, keys: list[str], order: str, out: str = "i", span: int = 100_000) -> DataFrame:
    """Adds the zero-based place of each row within its key by a whole-numbered order.

    Rows are numbered within ranges of `span` of the order, and the counts of earlier ranges are added, so that a key
    may hold any share of the rows; only a row for each key and range is ever ordered by key.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / span))
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    return rows.withColumn("_at", at).join(counts, [*keys, "_range"]).withColumn(out, (F.col("_at") + F.col("_before")).cast("bigint")).drop("_range", "_at", "_before")


def chunked(df: DataFrame, index: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Adds chunk (of `size` places) and own; rows near an edge come in the next chunk, too, where own is false.

    So a window over (keys, chunk) sees `before` earlier and `after` later places of each own row, and no key is
    ordered as a whole.
    """
    at, chunk = F.pmod(F.col(index), F.lit(size)), F.floor(F.col(index) / size)
    copies = F.array(chunk, F.when(at >= size - before, chunk + 1), F.when(at < after, chunk - 1))
    out = df.withColumn("chunk", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    return out.withColumn("own", F.col("chunk") == chunk)


def hop_windows(df: DataFrame, keys: list[str], index: str, value: str, size: int, hop: int) -> DataFrame:
    """(keys, k, start, signal): window k holds the samples [k * hop, k * hop + size); incomplete ones are left out.

    Samples are gathered once into blocks of `hop` (one shuffle of each sample, whatever the overlap); a window joins
    size / hop neighbouring blocks. size must be a multiple of hop; otherwise use hop_windows_exploded.
    """
    if size % hop:
        return hop_windows_exploded(df, keys, index, value, size, hop)
    parts = size // hop
    block = F.floor(F.col(index) / hop)
    blocks = df.groupBy(*keys, block.cast("bigint").alias("k")).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("x")))).alias("b"))
    blocks = chunked(blocks, "k", 1024, after=parts - 1)
    w = Window.partitionBy(*keys, "chunk").orderBy("k")
    tied = [F.struct(F.lead("b", j).over(w).alias("b"), F.lead("k", j).over(w).alias("k")) for j in range(parts)]
    out = blocks.select(*keys, "k", "own", F.array(*tied).alias("t")).where("own")
    whole = F.forall("t", lambda t: F.size(t["b"]) == hop) & (F.element_at("t", -1)["k"] == F.col("k") + parts - 1)
    signal = F.flatten(F.transform("t", lambda t: F.transform(t["b"], lambda s: s["x"])))
    return out.where(whole).select(*keys, "k", (F.col("k") * hop).alias("start"), signal.alias("signal"))


def hop_windows_exploded(df: DataFrame, keys: list[str], index: str, value: str, size: int, hop: int) -> DataFrame:
    """As hop_windows, for any hop: each sample goes to every window that it is in."""
    low = F.greatest(F.lit(0), F.ceil((F.col(index) - size + 1) / hop))
    long = df.select(*keys, F.col(index).alias("i"), F.col(value).alias("x"), F.explode(F.sequence(low.cast("bigint"), F.floor(F.col(index) / hop).cast("bigint"))).alias("k"))
    out = long.groupBy(*keys, "k").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    return out.where(F.size("s") == size).select(*keys, "k", (F.col("k") * hop).alias("start"), F.transform("s", lambda s: s["x"]).alias("signal"))


def tumbling_windows(df: DataFrame, keys: list[str], index: str, value: str, size: int) -> DataFrame:
    return hop_windows(df, keys, index, value, size, size)


def stitch(windows: DataFrame, keys: list[str], hop: int) -> DataFrame:
    """(keys, i, x): overlapping windows put together again, the first whole and the last `hop` of each next, a row a sample."""
    first = windows.groupBy(*keys).agg(F.min("k").alias("_first"))
    rows = windows.join(first, keys).withColumn("_skip", F.when(F.col("k") == F.col("_first"), 0).otherwise(F.size("signal") - hop))
    rows = rows.select(*keys, "k", "_first", "_skip", F.posexplode(F.slice("signal", F.col("_skip") + 1, F.size("signal") - F.col("_skip"))).alias("_at", "x"))
    return rows.select(*keys, ((F.col("k") - F.col("_first")) * hop + F.col("_skip") + F.col("_at")).alias("i"), "x")


def last_n(value: str, keys: list[str], order: str, n: int) -> Column:
    """The newest n values at each row; null until there are n."""
    got = F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0))
    return F.when(F.size(got) == n, got)


def block_ids(df: DataFrame, keys: list[str], order: str, label: str, out: str = "block") -> DataFrame:
    """Adds the number of the run of equal labels, from 0, within each key; a null is a label of its own."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"))
    return df.withColumn("_changed", changed).withColumn(out, F.sum("_changed").over(w)).drop("_changed")


def split_blocks(df: DataFrame, keys: list[str], block: str, order: str, parts: int, seam: int = 0) -> DataFrame:
    """Cuts each block into `parts` runs (part, from 1; the first ones longer) and drops `seam` rows after each cut."""
    of_block = Window.partitionBy(*keys, block).orderBy(order)
    out = df.withColumn("part", F.ntile(parts).over(of_block))
    of_part = Window.partitionBy(*keys, block, "part").orderBy(order)
    kept = out.withColumn("_at", F.row_number().over(of_part)).where((F.col("part") == 1) | (F.col("_at") > seam))
    return kept.drop("_at")


def grouped_folds(groups: DataFrame, label: str, group: str, folds: int, seed: int) -> DataFrame:
    """Adds fold to one row per group: groups of a class are shuffled by a hash of the seed and dealt in turn."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")))
    w = Window.partitionBy(label).orderBy(mixed, group)
    return groups.withColumn("fold", (F.row_number().over(w) - 1) % folds)


def usable_folds(df: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """(fold) with two classes or more in it, and two or more outside of it."""
    cells = df.groupBy(fold, label).count()
    inside = cells.groupBy(fold).agg(F.count(F.lit(1)).alias("inside"))
    pairs = inside.select(F.col(fold).alias("_f")).crossJoin(F.broadcast(cells.withColumnRenamed(fold, "_other"))).where("_f != _other")  # folds x classes
    outside = pairs.groupBy("_f").agg(F.count_distinct(label).alias("outside"))
    return inside.join(outside, inside[fold] == outside["_f"]).where("inside >= 2 and outside >= 2").select(fold)


def debounced(df: DataFrame, keys: list[str], order: str, command: str, run: int, out: str = "fired") -> DataFrame:
    """Adds whether a row is the run-th agreeing one in a row (then counting anew); a null command breaks the run.

    A row's place in its run is told from where the run began, so one sort by (keys, order) serves all.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_at", F.row_number().over(w))
    rows = rows.withColumn("_start", run_start(F.col(command), F.col("_at"), w))
    return rows.withColumn(out, is_fired(F.col(command), F.col("_at"), F.col("_start"), w, run)).drop("_at", "_start")


def run_start(command: Column, at: Column, w: WindowSpec) -> Column:
    """The place of a row that differs from the one before it; null within a run."""
    return F.when((at == 1) | ~command.eqNullSafe(F.lag(command).over(w)), at)


def is_fired(command: Column, at: Column, start: Column, w: WindowSpec, run: int) -> Column:
    """Whether a command is the run-th of its run, from places and run_start() of rows in order of w."""
    began = F.max(start).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return command.isNotNull() & ((at - began + 1) % run == 0)


def halves(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds half: 1 for the first floor(n / 2) rows of a key by a whole-numbered order, else 2; no key is ordered in one task."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = sample_index(df, keys, order, "_place").join(n, keys)
    return placed.withColumn("half", F.when(F.col("_place") < F.floor(F.col("_n") / 2), 1).otherwise(2)).drop("_place", "_n")


def last_known(df: DataFrame, keys: list[str], order: str, value: str, out: str, span: int = 100_000) -> DataFrame:
    """Adds the last value that is not null up to each row of its key, by a whole-numbered order.

    Values are carried within ranges of the order; a row a key and range tells later ranges what it ends with.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / span))
    ends = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_range").agg(F.max_by(value, order).alias("_end"))
    every = rows.select(*keys, "_range").distinct().join(ends, [*keys, "_range"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select(*keys, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    within = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_within", within).join(before, [*keys, "_range"]).withColumn(out, F.coalesce("_within", "_before")).drop("_range", "_within", "_before")


def cue_sample(given: Column, ms: Column, start_ms: Column, rate: float) -> Column:
    """The sample of a cue: the one that the log gives, else from its time since the start, cut to a whole number."""
    return F.coalesce(given.cast("bigint"), ((ms - start_ms) / 1000.0 * rate).cast("bigint"))
