"""The rank array against the library."""

import hashlib
import json
import random

import numpy as np
import pytest

import public_tokenizers
from jobstrata.llm import rankarray

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return rankarray.TextEncoder(PATH)


def ids_of(encoder, text):
    return np.frombuffer(encoder.packed(text), "<u4").tolist()


def test_every_code_point(encoder, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for k in range(0, len(points), 2000):
        texts = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}, {chr(c)} " for c in points[k : k + 2000]]
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids_of(encoder, text) == want.ids


def test_mixed_texts(encoder, library):
    r = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "é", "日", "1", "23", "'s", "'LL", "<|endoftext|>", "<|endof", "text|>", "　", "_", "\U0001f600", "é", "\r\n", "\t", "\x00"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(40)))
        ids = ids_of(encoder, text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert encoder.core.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_long_words_and_borders(encoder, library):
    r = random.Random(4)
    for text in ["b" * 5000, "ab" * 3000, "".join(r.choice("abcdefg") for _ in range(5000)), "日本" * 800, "x" * 255, "x" * 256, "x" * 257]:
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids
    core = encoder.core
    for _ in range(500):
        word = "".join(r.choice("abcdefghi the") for _ in range(r.randrange(1, 200))).encode()
        borders, ids = core.parts(word)
        assert (borders, ids) == core._by_heap([core.single[c] for c in word])
        assert [core.bytes_of[i] for i in ids] == [word[a:b] for a, b in zip(borders, borders[1:], strict=False)]


def test_decoding_of_broken_bytes(encoder, library):
    r = random.Random(5)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randrange(12))]
        assert encoder.core.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_odd_rows(spark, library):
    data = [(None, "no id"), (1, None), (2, ""), (3, " \n"), (4, "same"), (4, "same"), (5, "x <|endoftext|> y"), (6, "word " * 300_000), (7, "é" * 100_000), (-8, "\U0001f600 日本")]
    df = spark.createDataFrame([(*x, "own", 1) for x in data], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in data:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
        want.append((i, len(ids) // 4, digest(ids), digest((t or "").encode())))
    assert sorted(map(tuple, rankarray.digests(df, PATH).collect()), key=str) == sorted(want, key=str)
    back = rankarray.decoded(rankarray.encoded(df, PATH), PATH).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in data), key=str)
    assert rankarray.digests(df.where("false"), PATH).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        rankarray.TextEncoder(str(tmp_path / "v.json"))
