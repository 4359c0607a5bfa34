"""Standard archives: each rule with a failing case, nothing published then, one read of the rows, unions that agree."""

from dataclasses import replace

import pytest

from epochflow.sources import standard

HEADER = standard.Header("cho2017", "hand", ("C3", "C4"), 3, 250.0, "uV", "imagery", (("left", "left_hand"), ("right", "right_hand"), ("rest", "idle")))
GOOD = [("0", "a", "s", "left_hand", "left", [[1.0, 2.0, 3.0]] * 2), ("1", "b", "s", "idle", "rest", [[0.0] * 3] * 2)]


@pytest.fixture()
def rows(spark):
    return lambda *more: spark.createDataFrame([*GOOD, *more], standard.ROWS)


@pytest.mark.parametrize(
    "bad,rule",
    [
        (("2", "a", "s", "left_hand", "left", [[1.0, 2.0, 3.0]]), "channels x samples"),
        (("2", "a", "s", "left_hand", "left", [[1.0, 2.0, 3.0], [1.0, 2.0]]), "channels x samples"),
        (("2", "a", "s", "left_hand", "left", None), "channels x samples"),
        (("2", "a", "s", "left_hand", "left", [[1.0, float("nan"), 3.0]] * 2), "not finite"),
        (("2", "a", "s", "left_hand", "left", [[1.0, None, 3.0]] * 2), "not finite"),
        (("2", None, "s", "left_hand", "left", [[1.0] * 3] * 2), "subject is missing"),
        (("2", "a", None, "left_hand", "left", [[1.0] * 3] * 2), "session is missing"),
        (("2", "a", "s", None, "left", [[1.0] * 3] * 2), "label is missing"),
        (("2", "a", "s", "left_hand", None, [[1.0] * 3] * 2), "label is missing"),
        (("2", "a", "s", "tail", "left", [[1.0] * 3] * 2), "not canonical"),
        (("2", "a", "s", "left_foot", "left", [[1.0] * 3] * 2), "another category"),
        (("2", "a", "s", "right_hand", "left", [[1.0] * 3] * 2), "not a pair"),
    ],
)
def test_a_broken_trial_is_not_published(spark, rows, tmp_path, bad, rule):
    path = f"file://{tmp_path}/x"
    with pytest.raises(ValueError, match=rule):
        standard.write_archive(rows(bad), HEADER, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        standard.read_archive(spark, path)
    assert {r.rule: r.trials for r in standard.rule_counts(rows(bad), HEADER).collect() if rule in r.rule} == {next(n for n in standard.trial_rules(HEADER) if rule in n): 1}


@pytest.mark.parametrize(
    "change,rule",
    [
        ({"channels": ("C3", "C3")}, "channel labels repeat"),
        ({"fs": 0.0}, "fs is not positive"),
        ({"units": " "}, "units are not stated"),
        ({"paradigm": "rest"}, "paradigm"),
        ({"dataset": "mine"}, "not in the registry"),
        ({"category": "feet", "dataset": "cho2017"}, "does not provide"),
    ],
)
def test_a_broken_header_is_not_written(rows, tmp_path, change, rule):
    with pytest.raises(ValueError, match=rule):
        standard.write_archive(rows(), replace(HEADER, **change), f"file://{tmp_path}/x")


def test_rows_are_read_once_and_come_back(spark, rows, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    path = f"file://{tmp_path}/x"
    standard.write_archive(rows().mapInPandas(count, standard.ROWS), HEADER, path)
    assert seen.value == 2
    back = standard.read_archive(spark, path).orderBy("epoch_id").collect()
    assert [(r.epoch_id, r.subject, r.label, r.category, r.fs) for r in back] == [("0", "a", "left_hand", "hand", 250.0), ("1", "b", "idle", "hand", 250.0)]
    assert standard.manifest(spark, path)["trials"] == 2
    with pytest.raises(ValueError, match="no trials"):
        standard.write_archive(rows().limit(0), HEADER, f"file://{tmp_path}/none")


def test_readers_check_again(spark, rows, tmp_path):
    path = f"file://{tmp_path}/x"
    standard.write_archive(rows(), replace(HEADER, paradigm="execution"), path)
    with pytest.raises(ValueError, match="not imagery"):
        standard.read_archive(spark, path)
    assert standard.read_archive(spark, path, imagery_only=False).count() == 2
    folder = standard.manifest(spark, path)["folder"]
    spark.createDataFrame([("9", "z", "s", "left_foot", "left", [[1.0] * 3] * 2)], standard.ROWS).write.mode("append").partitionBy("subject").parquet(f"{path}/{folder}")
    with pytest.raises(Exception, match="another category"):
        standard.read_archive(spark, path, imagery_only=False).collect()


def test_unions_agree_or_raise(spark, rows, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    standard.write_archive(rows(), HEADER, at("a"))
    standard.write_archive(rows(), replace(HEADER, dataset="lee2019_mi"), at("b"))
    got = {(r.subject, r.session) for r in standard.union_archives(spark, [at("a"), at("b")]).collect()}
    assert got == {(f"{d}:{s}", f"{d}:{s}:s") for d in ("cho2017", "lee2019_mi") for s in "ab"}
    for k, (name, value) in enumerate({"fs": 160.0, "units": "V", "channels": ("C4", "C3")}.items()):
        standard.write_archive(rows(), replace(HEADER, **{name: value}), at(k))
        with pytest.raises(ValueError, match=f"another {name}"):
            standard.union_archives(spark, [at("a"), at(k)])
    with pytest.raises(ValueError, match="at least one"):
        standard.union_archives(spark, [])
