"""Dimension tables: montages, motor intents, datasets. Small and fixed, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Electrode montages (name, channels, labels, and the channel roles by index).
MONTAGES = [
    ("benchmark64", 64, [], [53, 54, 55, 56, 57, 60, 61, 62, 63], [0, 1], [23, 24, 25, 26, 27, 28, 29, 30], []),
    ("cyton8_ssvep", 8, ["Fp1", "Fp2", "C3", "C4", "P3", "P4", "O1", "O2"], [6, 7], [0, 1], [2, 3], []),
    ("cyton8_motor", 8, ["FC3", "FC4", "C3", "CZ", "C4", "CP3", "CP4", "PZ"], [7], [0, 1], [0, 1, 2, 3, 4, 5, 6, 7], [2, 4]),
    ("cyton8_mi", 8, ["Fp1", "Fp2", "C3", "CZ", "C4", "CP3", "CP4", "PZ"], [6, 7], [0, 1], [2, 3, 4, 5, 6, 7], [2, 4]),
    ("cyton8_fp_occipital", 8, ["Fp1", "Fp2", "O1", "Oz", "O2", "PO3", "PO4", "Pz"], [2, 3, 4, 5, 6, 7], [0, 1], [], []),
]

# Motor intents in canonical order, by category, and their aliases.
INTENTS = {
    "finger": ["left_thumb", "left_index", "left_middle", "left_ring", "left_pinky", "right_thumb", "right_index", "right_middle", "right_ring", "right_pinky"],
    "hand": ["left_hand", "right_hand", "both_hands"],
    "feet": ["left_foot", "right_foot", "both_feet"],
    "upper_limb": ["left_arm", "right_arm", "right_elbow_flexion", "right_elbow_extension", "right_forearm_supination", "right_forearm_pronation", "right_hand_open", "right_hand_close"],
    "idle": ["idle"],
}
ALIASES = {
    "left_little": "left_pinky",
    "right_little": "right_pinky",
    "left_little_finger": "left_pinky",
    "right_little_finger": "right_pinky",
    "left_index_finger": "left_index",
    "right_index_finger": "right_index",
    "left_middle_finger": "left_middle",
    "right_middle_finger": "right_middle",
    "left_ring_finger": "left_ring",
    "right_ring_finger": "right_ring",
    "left_thumb_finger": "left_thumb",
    "right_thumb_finger": "right_thumb",
    "feet": "both_feet",
    "both_foot": "both_feet",
    "rest": "idle",
    "right_supination": "right_forearm_supination",
    "right_pronation": "right_forearm_pronation",
}
FINGERS = ("thumb", "index", "middle", "ring", "pinky")
IDLE = "idle"
INTENT_PREFIX, BUTTON_PREFIX = "intent::", "button::"


def montages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MONTAGES, "montage string, n_channels int, labels array<string>, ssvep array<int>, artifact array<int>, motor array<int>, motor_lateral array<int>")


def intents(spark: SparkSession) -> DataFrame:
    names = [(i, c) for c, some in INTENTS.items() for i in some]
    return spark.createDataFrame([(i, c, k) for k, (i, c) in enumerate(names)], "intent string, category string, canonical_order int")


def aliases(spark: SparkSession) -> DataFrame:
    known = {i: i for some in INTENTS.values() for i in some}
    return spark.createDataFrame(list({**known, **ALIASES}.items()), "alias string, intent string")


# Public datasets (id, categories, subjects, channels, rate in Hz, licence, access, importer).
DATASETS = [
    ("openneuro_ds008446", ["finger"], 20, 62, 512, "CC0-1.0", "public", "bids_finger"),
    ("physionet_eegmmidb", ["hand", "feet"], 109, 64, 160, "ODC-By-1.0", "public", "physionet"),
    ("bnci2014_001", ["hand", "feet"], 9, 22, 250, "CC-BY-ND-4.0", "public", "moabb"),
    ("ofner2017", ["upper_limb"], 15, 61, 512, "CC-BY-4.0", "public", "moabb"),
    ("cho2017", ["hand"], 52, 64, 512, "CC-BY-4.0", "public", "moabb"),
    ("lee2019_mi", ["hand"], 54, 62, 1000, "CC0-1.0", "public", "moabb"),
    ("zenodo_18470278", ["upper_limb"], 28, 54, None, "not stated on record", "restricted", None),
]


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, "dataset string, categories array<string>, subjects int, channels int, rate int, license string, access string, importer string")
