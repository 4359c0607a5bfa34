import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from epochflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


ALPHABETS = ["ab", "the ", "'sltre ", "!'s.", "日本語é", "0123 4", "<|endoftext|>", "á   \n\t\r", "\x85\x1c᠎ x", "🙂👍🏽e", "²½Ⅷ3a", "don't <|endoftext|> we'll"]


def test_matches_the_tokenizers_library_on_odd_texts(reference):
    rng = random.Random(7)
    coder = bpe.load(PATH, 16)
    for n in range(400):
        alphabet = rng.choice(ALPHABETS) if n % 3 else "".join(ALPHABETS)
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 600)))
        if n % 5 == 0:
            text = text.replace(" ", "")
        ids = reference.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, text
        assert coder.decode(ids) == reference.decode(ids, skip_special_tokens=False) == text


def test_joins_of_long_unsplit_texts_are_exact(reference):
    rng = random.Random(8)
    for alphabet in ("abcdefghijklmnop", "theanding", "日本語中国人東京", "0123456789", "!?.,;-", "a'sdon't", "<|endoftext|>ab"):
        text = "".join(rng.choice(alphabet) for _ in range(6000))
        coder = bpe.load(PATH, 97)
        assert coder.encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_long_runs_of_white_space(reference):
    rng = random.Random(9)
    coder = bpe.load(PATH, 16)
    for n in range(300):
        text = "".join(rng.choice([" " * rng.randrange(1, 60), "\n" * rng.randrange(1, 40), "".join(rng.choice(" \t\r\n\x85\xa0\u3000") for _ in range(50)), "a", "!", "'s", "1", "<|endoftext|>", "\x1c" * 20]) for _ in range(12))
        assert coder.encode(text) == reference.encode(text, add_special_tokens=False).ids, repr(text)
    coder = bpe.load(PATH)
    mixed = "".join(rng.choice(" \n\t") for _ in range(300_000))
    for text in (" " * 2_000_000, f"a{' ' * 2_000_000}b", f"a{mixed}\n", f"{mixed}b{' ' * 5000}<|endoftext|>{' ' * 5000}", "'" * 300_000, "\x1c" * 50_000):
        assert coder.encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_files_of_other_kinds_are_refused():
    import json

    with open(PATH) as f:
        data = json.load(f)
    for part, key, value in (("model", "byte_fallback", True), ("pre_tokenizer", "add_prefix_space", True), ("model", "dropout", 0.1), ("model", "merges", data["model"]["merges"][::-1])):
        with pytest.raises(ValueError):
            bpe.Bpe(json.dumps({**data, part: {**data[part], key: value}}).encode())
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps({**data, "normalizer": {"type": "NFC"}}).encode())


def test_round_trip_of_nulls_empties_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "x" * 20000, "w"), (3, "x" * 20000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in got][:2] == [0, 0] and got[0].ids_sha256 == got[1].decoded_sha256 == empty
    assert got[3] == got[4] and got[3].decoded_sha256 == hashlib.sha256(b"x" * 20000).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, sf_dir, reference):
    from epochflow.llm.queries import op2_bpe_round_trip

    got = {r.doc_id: r for r in op2_bpe_round_trip(spark, sf_dir).collect()}
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = reference.encode(doc.text or "", add_special_tokens=False).ids
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_decode_back(spark):
    df = spark.createDataFrame([(1, "It's <|endoftext|> all"), (2, None)], "id long, text string")
    out = bpe.decode_column(bpe.encode_column(df, PATH), PATH).orderBy("id").collect()
    assert [r.decoded for r in out] == ["It's <|endoftext|> all", ""]
