"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are summed by (source, block of documents); targets, quotas and draws are tables, whatever the number of sources.
Each source draws blocks up to its target in a seeded order. How many of them each output shard gets is split down a
binary tree without replacement: the driver splits the quotas of at most `groups` groups of sources among at most
`branches` branches of shards, then each group splits its share among its sources, and each branch its own among its
shards. A shard's quota of a source is the next piece of that source's permuted blocks. Documents meet their draws by a
join on (source, block), and each shard is shuffled locally.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A word: a run of code points other than space and \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a plan that are broadcast at the most; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Blocks of a source, if it is not large.
BLOCKS = 256


@dataclass(frozen=True)
class Mix:
    """A planned mix.

    sizes: id, source, size, spread, key and block of each document; plan: source, block, source_size, target and draws
    (epoch, shard, and where the last document of the source is cut: key, words left for it, rows that share it);
    many: number of blocks of the sources that have more than BLOCKS.
    """

    sizes: DataFrame
    plan: DataFrame
    seed: int
    many: DataFrame
    shards: int
    few: bool

    def drawn(self, keyed: DataFrame) -> DataFrame:
        """Adds source_size, target and draws (array of epoch, shard, words, key) to rows with source, size, block, key."""
        plan = self.plan.withColumnsRenamed({"source": "_source", "block": "_block"})
        on = keyed["source"].eqNullSafe(plan["_source"]) & (keyed["block"] == plan["_block"])
        out = keyed.join(F.broadcast(plan) if self.few else plan, on)
        words = "CASE WHEN d.cut IS NULL OR key < d.cut THEN size ELSE least(size, d.rest div d.twins) END"
        each = f"named_struct('epoch', d.epoch, 'shard', d.shard, 'words', {words}, 'key', xxhash64({self.seed}, d.epoch, key))"
        return out.withColumn("draws", F.expr(f"transform(filter(_draws, d -> d.cut IS NULL OR key <= d.cut), d -> {each})")).drop("_source", "_block", "_draws")


def split_quotas(quotas: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(leaves, sources) block counts that sum to the quotas, each leaf's near its weight.

    A node of the tree draws its left half's blocks without replacement.
    """
    if len(weights) == 1:
        return quotas[None, :]
    half = len(weights) // 2
    left = int(quotas.sum()) * int(weights[:half].sum()) // int(weights.sum())
    drawn = rng.multivariate_hypergeometric(quotas, left, method="marginals")
    return np.concatenate([split_quotas(drawn, weights[:half], rng), split_quotas(quotas - drawn, weights[half:], rng)])


def _keyed(df: DataFrame, id_col: str, text: str, source: str, seed: int, *more: str) -> DataFrame:
    """id, source, size, spread and key of each row, by its id alone, then `more` columns as _c0, _c1 and so on."""
    return df.select(
        F.col(id_col).alias("id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), F.lit("block"), F.col(id_col)).alias("spread"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 2).alias("key"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(more)],
    )


def _blocked(keyed: DataFrame, many: DataFrame) -> DataFrame:
    """Adds the block of each row; `many` has (source, blocks) of large sources."""
    many = many.select(F.col("source").alias("_of"), F.col("blocks").alias("_blocks"))
    out = keyed.join(F.broadcast(many), keyed["source"].eqNullSafe(many["_of"]), "left")
    return out.withColumn("block", F.pmod("spread", F.coalesce("_blocks", F.lit(BLOCKS))).cast("int")).drop("_of", "_blocks")


def _weighted(sources: DataFrame, weights) -> DataFrame:
    """Adds the weight of each source: from a dict (others 0), or dealt out in turn by code point, null last."""
    spark = sources.sparkSession
    if isinstance(weights, dict):
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_of string, weight double")
        return sources.join(F.broadcast(given), sources["source"].eqNullSafe(given["_of"]), "left").drop("_of").na.fill(0.0, ["weight"])
    part = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    part = written(part, "ranges")
    first, before = [], 0
    for r in part.groupBy("part").count().orderBy("part").collect():  # one row a shuffle partition
        first.append((r["part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(first, "part int, before bigint")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    turn = F.pmod(rank, F.lit(len(weights))).cast("int")
    return part.join(F.broadcast(offsets), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1)).drop("part", "before")


def reshared(sources: DataFrame, weights, share: float, most: float) -> DataFrame:
    """source, source_size and target: `share` of all sizes by weight, where no target is above most * source_size.

    The excess of full sources goes to the others by weight. Each round finds the sources that are full at the present
    scale; what is full stays full, so the rounds end, mostly after three or four.
    """
    rows = written(_weighted(sources, weights), "weighted")
    top, open_ = F.lit(float(most)) * F.col("source_size"), (F.col("source_size") > 0) & (F.col("weight") > 0)
    words, room = rows.agg(F.sum("source_size"), F.sum(F.when(open_, top))).first()
    total, scale = min(float(share) * (words or 0), room or 0.0), 0.0
    while total:
        full = F.col("weight") * F.lit(scale) >= top
        used, left = rows.where(open_).agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (used or 0.0)) / left if left else scale
        if new <= scale:
            break
        scale = new
    target = F.when(open_, F.least(top, F.col("weight") * F.lit(scale))).otherwise(0.0)
    return rows.select("source", "source_size", target.cast("double").alias("target"))


_DRAW = "source string, block int, epoch int, rest bigint, branch int"


def _draws(group: pd.DataFrame, seed: int, most: int) -> list[tuple]:
    """(source, block, epoch, words left for it or None) in order, for each source: blocks in permuted order up to the target."""
    out = []
    for _, rows in group.groupby("name", sort=True):
        source, size, target = rows["source"].iloc[0], int(rows["source_size"].iloc[0]), round(float(rows["target"].iloc[0]))
        rows = rows.sort_values("block")
        rng = np.random.default_rng([seed, xxhash.xxh64_intdigest(rows["name"].iloc[0].encode("utf-8", "replace"))])
        for epoch in range(most):
            left = target - epoch * size
            if left <= 0:
                break
            for i in rng.permutation(len(rows)):
                block, n = int(rows["block"].iloc[i]), int(rows["n"].iloc[i])
                if n > left:
                    if left:
                        out.append((source, block, epoch, left))
                    break
                left -= n
                out.append((source, block, epoch, None))
    return out


def _dealt(draws: list[tuple], shares: np.ndarray) -> list[int]:
    """The leaf of each draw: a source's draws go to leaves in pieces of its shares (leaves, sources)."""
    return np.concatenate([np.repeat(np.arange(len(shares)), shares[:, i]) for i in range(shares.shape[1])]).tolist() if draws else []


def _counts(draws: list[tuple]) -> np.ndarray:
    """Draws of each source, in the order in which sources come."""
    counts: dict = {}
    for source, *_ in draws:
        counts[source] = counts.get(source, 0) + 1
    return np.array(list(counts.values()), dtype=np.int64)


def plan_mix(
    df: DataFrame,
    weights=(5.0, 2.0, 1.0),
    share: float = 1.5,
    most: int = 2,
    shards: int | None = None,
    shard_words: int = 100_000_000,
    seed: int = 42,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    groups: int = 1024,
    branches: int = 1024,
) -> Mix:
    """Plans a mix of `share` times all words.

    weights: a dict by source (others weigh 0), or a sequence dealt out in turn to the sources by code point, null
    last. No source gives more than `most` times its size. Each full epoch takes every block of a source; the last,
    partial epoch takes whole blocks in permuted order, then whole documents of one more block in the order of a seeded
    hash, then the first words of one more document, so a source's words meet its rounded target exactly unless rows
    that share that document's id are cut alike. Null sources are a source of their own; null and empty texts have
    size 0 and are drawn with their block; rows with equal ids are drawn together; an empty table gives empty results.

    There are as many shards as the mix holds shard_words, 64 at least (or `shards`), and about 8 blocks for a shard, a
    source has blocks by its size, BLOCKS at least. A task plans at most a group of sources or a branch of shards; the driver holds
    at most groups x branches numbers. Reruns draw the same.
    """
    sizes = written(_keyed(df, id_col, text, source, seed), "sizes")
    words, names = sizes.agg(F.sum("size"), F.approx_count_distinct(F.coalesce("source", F.lit("")))).first()
    shards = shards or max(64, int(share * (words or 0) // shard_words))
    # Sources of more than BLOCKS of the 8 * shards blocks: at most 8 * shards / BLOCKS of them.
    blocks = F.ceil(F.sum("size") * F.lit(8 * shards / max(1, words or 0))).cast("int")
    many = written(sizes.groupBy("source").agg(blocks.alias("blocks")).where(F.col("blocks") > BLOCKS), "many")
    sizes = _blocked(sizes, many)
    by_block = written(sizes.groupBy("source", "block").agg(F.sum("size").alias("n")), "blocks")
    targets = reshared(by_block.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    targets = targets.withColumnRenamed("source", "_of")
    named = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))
    goals = by_block.join(targets, by_block["source"].eqNullSafe(targets["_of"])).drop("_of").withColumn("name", named)
    groups = max(1, min(groups, names))
    goals = written(goals.withColumn("group", F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int")), "goals")

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": group["group"].iloc[:1], "n": [len(_draws(group, seed, most))]})

    quotas = np.zeros(groups, dtype=np.int64)
    for r in goals.groupBy("group").applyInPandas(counted, "group int, n bigint").collect():  # `groups` rows at most
        quotas[r["group"]] = r["n"]
    weight = np.diff(np.linspace(0, shards, min(shards, branches) + 1).astype(np.int64))
    shares = split_quotas(quotas, weight, np.random.default_rng(seed))
    sent = df.sparkSession.sparkContext.broadcast(shares)

    def branched(group: pd.DataFrame) -> pd.DataFrame:
        number, draws = int(group["group"].iloc[0]), _draws(group, seed, most)
        left, parts = _counts(draws), []
        rng = np.random.default_rng([seed, 1, number])
        for n in sent.value[:, number]:
            parts.append(rng.multivariate_hypergeometric(left, int(n), method="marginals") if len(left) else left)
            left = left - parts[-1]
        rows = [(*d, b) for d, b in zip(draws, _dealt(draws, np.array(parts)))]
        return pd.DataFrame(rows, columns=["source", "block", "epoch", "rest", "branch"]).astype({"rest": "Int64"})

    first = np.concatenate([[0], np.cumsum(weight)]).tolist()

    def sharded(branch: pd.DataFrame) -> pd.DataFrame:
        branch = branch.sort_values(["source", "epoch", "block"], na_position="last", ignore_index=True)
        number, n = int(branch["branch"].iloc[0]), len(branch)
        rng = np.random.default_rng([seed, 2, number])
        branch = branch.iloc[rng.permutation(n)].sort_values("source", kind="stable", na_position="last", ignore_index=True)
        draws = list(zip(branch["source"].fillna("\x00"), range(n)))
        shares = split_quotas(_counts(draws), np.ones(first[number + 1] - first[number], dtype=np.int64), rng)
        return branch.assign(branch=first[number] + np.array(_dealt(draws, shares), dtype=np.int64))

    draws = goals.groupBy("group").applyInPandas(branched, _DRAW)
    if len(weight) < shards:
        draws = draws.groupBy("branch").applyInPandas(sharded, _DRAW)
    draws = written(draws, "draws")
    cuts = _cuts(sizes, draws.where("rest is not null")).select(F.col("source").alias("_of"), F.col("block").alias("_at"), F.col("epoch").alias("_in"), "cut", F.col("over").alias("_rest"), "twins")
    draws = draws.join(cuts, draws["source"].eqNullSafe(cuts["_of"]) & (draws["block"] == cuts["_at"]) & (draws["epoch"] == cuts["_in"]), "left")
    each = F.struct("epoch", F.col("branch").alias("shard"), "cut", F.col("_rest").alias("rest"), "twins")
    draws = draws.groupBy(F.col("source").alias("_of"), F.col("block").alias("_at")).agg(F.array_sort(F.collect_list(each)).alias("_draws"))
    plan = goals.join(draws, goals["source"].eqNullSafe(draws["_of"]) & (goals["block"] == draws["_at"]), "left")
    plan = written(plan.select("source", "block", "source_size", "target", "_draws"), "plan")
    few = plan.count() <= BROADCAST_ROWS
    return Mix(sizes, plan.withColumn("_draws", F.coalesce("_draws", F.array().cast(plan.schema["_draws"].dataType))), seed, many, shards, few)


def _cuts(sizes: DataFrame, last: DataFrame) -> DataFrame:
    """source, block, epoch, cut, over, twins: the order key at which the words left for a source's last block run out.

    A running sum over that one block of each source; over: words left at that key, twins: rows that share it.
    """
    last = last.select(F.col("source").alias("_of"), F.col("block").alias("_at"), "epoch", "rest")
    part = sizes.join(last, sizes["source"].eqNullSafe(last["_of"]) & (sizes["block"] == last["_at"]))
    by_key = part.groupBy("source", "block", "epoch", "rest", "key").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("twins"))
    until = Window.partitionBy("source", "block", "epoch").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_key = by_key.withColumn("over", F.col("rest") - F.sum("n").over(until) + F.col("n"))
    return by_key.where("over >= 0 AND over < n").select("source", "block", "epoch", F.col("key").alias("cut"), "over", "twins")


def taken_words(df: DataFrame, id_col: str = "doc_id", **plan) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, taken, shards.

    taken: words the mix takes, repeats counted, which is what the shards of the tree's draws (in `shards`) hold.
    """
    mix = plan_mix(df, id_col=id_col, **plan)
    out = mix.drawn(mix.sizes)
    taken = F.expr("aggregate(draws, 0L, (n, d) -> n + d.words)")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), F.expr("transform(filter(draws, d -> d.words > 0), d -> d.shard)").alias("shards"))


def mixed(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, **plan) -> DataFrame:
    """The mix itself: df's columns plus mix_shard and mix_words, one row a draw, each shard in seeded random order.

    A document that is drawn twice comes twice; the one document of a source that is cut carries its first words only,
    and rows without words come with their block. Columns of df named mix_shard or mix_words are replaced.
    """
    kept = [c for c in df.columns if c not in ("mix_shard", "mix_words")]
    mix = plan_mix(df, id_col=id_col, text=text, source=source, seed=seed, **plan)
    out = mix.drawn(_blocked(_keyed(df, id_col, text, source, seed, *kept), mix.many))
    out = out.withColumn("_d", F.explode("draws")).where("size = 0 OR _d.words > 0")
    body = F.col(f"_c{kept.index(text)}")
    body = F.when(F.col("_d.words") >= F.col("size"), body).otherwise(F.array_join(F.slice(F.regexp_extract_all(body, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("_d.words").cast("int")), ""))
    out = out.select(*[(body if c == text else F.col(f"_c{i}")).alias(c) for i, c in enumerate(kept)], F.col("_d.shard").alias("mix_shard"), F.col("_d.words").alias("mix_words"), F.col("_d.key").alias("_order"))
    return out.repartition(mix.shards, "mix_shard").sortWithinPartitions("mix_shard", "_order").drop("_order")
