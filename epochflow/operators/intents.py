"""Sets of labels and what a session may do with them: sides of a recording, advice, class codes, strict look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochflow.functions.columns import reasons
from epochflow.functions.dims import IDLE

#: Levels of a set of intents by their number, the last one for more.
LEVELS = [(1, "BASIC"), (2, "PILOT"), (3, "EXPERIMENTAL"), (5, "ADVANCED")]
MOST = "RESEARCH_ONLY"


def label_side(label: Column, include: list[str], idle: list[str], artifact: list[str]) -> list[Column]:
    """side (kept, idle, artifact, other; null for no label) and code (the label's place in `include`, else -1)."""
    side = F.when(label.isin(*include), "kept").when(label.isin(*idle), "idle").when(label.isin(*artifact), "artifact").when(label.isNotNull(), "other")
    code = reduce(lambda e, x: e.when(label == x[1], x[0]), enumerate(include[1:], 1), F.when(label == include[0], 0)).otherwise(-1)
    return [side.alias("side"), code.alias("code")]


def _sets(df: DataFrame, key: str) -> DataFrame:
    """(key, s): each key's distinct intents with category and canonical order, in that order; at most the 24 of them."""
    known = F.when(F.col("intent").isNotNull(), F.struct("ord", "intent", "category"))
    return df.groupBy(key).agg(F.array_sort(F.collect_set(known)).alias("s"))


def assess(df: DataFrame, key: str) -> DataFrame:
    """(key, n, fingers, level, adjacent, warnings) of each key's set, from rows (key, intent, category, ord), repeats allowed.

    Idle is no intent of a set, so a key with idle alone has no row. adjacent: neighbouring fingers of one hand, as `a/b`.
    """
    s = _sets(df.where(F.col("category") != IDLE), key)
    finger = F.filter("s", lambda x: x["category"] == "finger")
    of = lambda side: F.size(F.filter("f", lambda x: F.startswith(x["intent"], F.lit(f"{side}_"))))
    s = s.select(key, F.size("s").alias("n"), finger.alias("f")).withColumns({"fingers": F.size("f"), "left": of("left"), "right": of("right")})
    # Five fingers a hand stand one after the other in canonical order, the left hand first.
    hand = lambda x: F.floor(x["ord"] / 5)
    pair = lambda a, b: F.when((b["ord"] == a["ord"] + 1) & (hand(a) == hand(b)), F.concat_ws("/", a["intent"], b["intent"]))
    less = F.greatest(F.lit(0), F.size("f") - 1)
    s = s.withColumn("adjacent", F.filter(F.zip_with(F.slice("f", 1, less), F.slice("f", 2, less), pair), lambda x: x.isNotNull()))
    n, fingers = F.col("n"), F.col("fingers")
    level = reduce(lambda e, x: e.when(n <= x[0], x[1]), LEVELS[1:], F.when(n <= LEVELS[0][0], LEVELS[0][1])).otherwise(MOST)
    said = reasons(
        (n == 1, "one intent needs idle trials to tell it from no action"),
        (F.size("adjacent") > 0, "neighbouring fingers of one hand look alike"),
        (fingers >= 4, "four finger classes or more are an advanced task"),
        (fingers >= 6, "six finger classes or more are for research only"),
        (F.col("left") >= 3, "three classes or more use the left hand"),
        (F.col("right") >= 3, "three classes or more use the right hand"),
    )
    return s.select(key, "n", "fingers", level.alias("level"), "adjacent", said.alias("warnings"))


def class_codes(df: DataFrame, key: str) -> DataFrame:
    """(key, intent, code, trainable): codes from 0 in canonical order, idle last; one class alone is not trainable."""
    s = _sets(df, key)
    last = F.concat(F.filter("s", lambda x: x["category"] != IDLE), F.filter("s", lambda x: x["category"] == IDLE))
    out = s.select(key, (F.size("s") >= 2).alias("trainable"), F.posexplode(last).alias("code", "x"))
    return out.select(key, F.col("x.intent").alias("intent"), "code", "trainable")


def classifier(prefer: Column, trained: Column) -> list[Column]:
    """classifier (the preferred one; `auto`: trca if trained, else fbcca) and ready: trca without a model is not."""
    has = F.coalesce(trained, F.lit(False))
    name = F.when(prefer.isin("trca", "fbcca"), prefer).otherwise(F.when(has, "trca").otherwise("fbcca"))
    return [name.alias("classifier"), ((name == "fbcca") | has).alias("ready")]


def resolved(df: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """df with the mapping's columns; a row that the mapping lacks, or with a null key, raises at run time, naming it.

    A key that the mapping has twice would repeat rows, so it raises, too. The check is a filter: no projection prunes it.
    """
    once = mapping.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in mapping.columns if c not in keys])
    said = lambda text: F.raise_error(F.concat(F.lit(text), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))).cast("boolean")
    fine = F.when(F.col("_n") == 1, F.lit(True)).when(F.col("_n") > 1, said("mapped more than once: ")).otherwise(said("unknown: "))
    return df.join(once, keys, "left").where(fine).drop("_n")


def unknown(df: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): what resolved() would raise for, with the number of rows."""
    return df.join(mapping, keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def target_keys(targets: DataFrame) -> DataFrame:
    """(by, key, target) of targets (idx, name, intent): each may be asked for by index, by name or by intent."""
    ways = F.array(*[F.struct(F.lit(w).alias("by"), F.col(c).cast("string").alias("key")) for w, c in (("index", "idx"), ("name", "name"), ("intent", "intent"))])
    return targets.select(F.explode(ways).alias("w"), F.col("name").alias("target")).select("w.*", "target").where("key IS NOT NULL")
