"""Odd tables: nulls, empty and very long texts, repeats, ties, clashing names, no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from jobstrata.llm import bpe, fingerprints, licenses, minhash, packing, pii, quality, queries, rules, suffixes, tokenfiles

WORD, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that plans or workers use for columns of their own.
CLASHING = "span turn mark row rep sid gone component component_id kind lo more items bands k1 k2 n chunk blob head range marker part kept score n_words term df label quality".split()


def long_text():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = " ".join(r.choice(words) for _ in range(200_000)) + " mail far.away@x.example.org"
    assert len(text) > 1 << 20  # more than a slab
    return text


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    words = "the of and on ear with some other words here that go by at noon".split()
    say = lambda n: " ".join(f"{r.choice(words)} {r.choice(words)}{r.randrange(40)}" for _ in range(n))
    copy, long = say(120), long_text()
    out = [(None, copy), (None, None), (1, None), (2, ""), (3, " \n\t\n"), (4, copy), (4, copy), (5, copy), (6, long), (7, "b" * 5000), (8, copy + " " + say(3)), (-9, say(80))]
    out += [(10, long[:300_000]), (2**62, "é 日本 \U0001f600 " * 40), (11, "All rights reserved. call +1 (974) 555-3436"), (12, "token = \"9f8e7d6c5b4a39281706f5e4d3c2b1a0\" ok")]
    return out


@pytest.fixture(scope="module")
def odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": minhash.F.lit(None).cast("string"), "source": minhash.F.lit("s"), "n_chars": minhash.F.length("text").cast("long")})
    return df.withColumns({c: minhash.F.lit(f"own {c}") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def answers(df):
    """doc_id -> distinct answers, and the number of rows."""
    got = defaultdict(set)
    collected = df.collect()
    for r in collected:
        got[r.doc_id].add(r)
    return got, len(collected)


def by_text(df, rows):
    """One answer for each row with an id, which rows of one id and text share."""
    got, n = answers(df)
    assert n == len(rows)
    assert all(len(got[i]) == 1 for i, _ in rows if i is not None)
    return {i: next(iter(got[i])) for i, _ in rows if i is not None}


def test_quality(odd, none, rows):
    net = quality.ConvNet(5)
    got = by_text(quality.scored(odd, net), rows)

    def score(text):
        b = [x + 1 for x in text.encode()]
        blocks = -(-len(b) // quality.STEP) + 1
        b += [0] * (blocks * quality.STEP - len(b))
        half = quality.STEP * quality.EMBED
        top = np.zeros(quality.FILTERS)
        for k in range(blocks - 1):
            x = net.w["embed"][b[k * quality.STEP : (k + 2) * quality.STEP]].reshape(-1).astype(np.float64)
            z = x[:half] @ net.w["filters"][:, : quality.FILTERS] + x[half:] @ net.w["filters"][:, quality.FILTERS :] + net.w["bias"]
            top = np.maximum(top, z)
        return 1 / (1 + math.exp(-(top @ net.w["out"] + net.w["b"][0])))

    for i, t in rows:
        if i is not None and len(t or "") < 400_000:
            assert abs(got[i].score - score(t or "")) < 1e-4
    assert quality.scored(none, net).count() == 0 and quality.trained(none, none.withColumn("quality", minhash.F.lit(1))) is None


def test_a_score_follows_from_its_text_alone(spark, rows):
    """Bit for bit the same score alone, among others, and in any partitioning."""
    net, r = quality.ConvNet(5), random.Random(6)
    texts = [t or "" for _, t in rows if len(t or "") < 400_000] + ["".join(r.choice("abc é#\n") for _ in range(r.randrange(700))) for _ in range(1000)]
    raw = [t.encode() for t in texts]
    flat = lambda some: (np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64))
    alone = [net.scores(*flat([x]))[0] for x in raw]
    for _ in range(20):
        pick = r.sample(range(len(raw)), r.randrange(1, len(raw)))
        assert net.scores(*flat([raw[k] for k in pick])).tolist() == [alone[k] for k in pick]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (1, 7):
        assert {x.doc_id: x.score for x in quality.scored(df.repartition(n), net).collect()} == dict(enumerate(alone))


def test_quality_of_repeated_labels(spark):
    rows = [(i, ("good words here " if i % 2 else "&&& ### ") * 9) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(i, 1 - i % 2) for i in range(10)] + [(None, 1), (3, None), (4000, 1)], "doc_id long, quality int")
    texts, y = quality.training_sample(docs, labels, "quality")
    again, y2 = quality.training_sample(docs.repartition(7), labels.repartition(5), "quality")
    assert texts == again and (y == y2).all()  # ties in a stable order
    assert len(y) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in [*range(200), *range(10)])


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_minhash(odd, none, rows):
    got = by_text(minhash.near_groups(odd, 85), rows)
    for i, t in rows:
        if i is not None:
            w = words_of((t or "").lower())
            assert got[i].n_shingles == len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ())
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 8)] == [1, 2, 3, 4, 4, 6, 4]
    nulls = [r for r in minhash.near_groups(odd).collect() if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in nulls] == [(None, True)] * 2
    left = minhash.one_of_each(odd, 85)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == sorted(i or 0 for i, _ in rows if i not in (5, 8))
    assert minhash.near_groups(none).count() == 0 and minhash.one_of_each(none).columns == none.columns


def test_long_words_of_two_letters(spark):
    """Thue-Morse words and their complements, which polynomial hashes modulo 2^64 take for one."""
    rows = []
    for k in range(5, 13):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << k))
        rows += [(2 * k, word), (2 * k + 1, word.translate(str.maketrans("ab", "ba")))]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in got) and len(got) == len(rows)


def test_bpe_and_token_files(odd, none, rows):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = by_text(bpe.digests(odd, RANKS, public_tokenizers.PATTERN), rows)
    n = by_text(tokenfiles.token_counts(odd, RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens").distinct().join(odd.select("doc_id"), "doc_id", "right"), rows)
    for i, t in rows:
        if i is not None:
            ids = ref.encode_ordinary(t or "")
            assert got[i].n_tokens == n[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    files = tokenfiles.token_counts(odd, RANKS, public_tokenizers.PATTERN)
    assert files.count() == len(rows) and sum(r.doc_id is None for r in files.collect()) == 2
    assert bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == tokenfiles.token_counts(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files_need_sixteen_bits(none):
    with pytest.raises(ValueError, match="16-bit"):
        tokenfiles.write_files(none.select("doc_id", "text"), "/nowhere", RANKS, public_tokenizers.PATTERN, end_id=7)


def test_packing(odd, none, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] += len(ids)
    got, pieces, sequences = Counter(), defaultdict(list), defaultdict(int)
    for r in packing.packed(odd, WORD).collect():
        got[r.doc_id] += r.length
        pieces[r.sequence_id].append((r.offset, r.length))
        sequences[r.sequence_id] += r.length
    assert got == want
    for p in pieces.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(2048 - n for n in sequences.values() if n & (n - 1)) < 0.02 * sum(want.values())
    assert packing.packed(none, WORD).count() == 0


def test_packing_of_ties(spark):
    rows = [(i, "same words in each") for i in range(50)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), WORD, window=16, open_windows=2).collect()
    assert sorted(r.doc_id for r in got if r.start == 0) == list(range(50)) and len({r.doc_tokens for r in got}) == 1


def test_fingerprints(odd, none, rows):
    collected = fingerprints.compared(odd).collect()
    assert len(collected) == len(rows)
    of = defaultdict(set)
    for r in collected:
        of[r.doc_id].add((r.fingerprint, r.n_chars))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    texts = dict(rows)
    assert all(len(of[i]) == 1 and next(iter(of[i]))[1] == len(t or "") for i, t in texts.items() if i is not None)
    assert len({next(iter(of[i]))[0] for i in (1, 2)}) == 1 and next(iter(of[4]))[0] == next(iter(of[5]))[0]
    assert fingerprints.compared(none).count() == 0


def test_licenses(odd, none, rows):
    got = by_text(licenses.scanned(odd), rows)
    for i, t in rows:
        if i is not None:
            assert got[i].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
    assert got[11].labels == "reserved" and (got[1].labels, got[1].first_word, got[1].score) == ("", None, 0)
    assert licenses.scanned(none).count() == 0


def test_equally_rare_words(spark):
    rows = [(1, "apache license version 2 0"), (2, "licensed under the apache license version 2 0 the license"), (3, "version license apache 2 0")]
    got = by_text(licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert "apache-2.0" in got[2].labels and got[3].labels == ""


def test_rules(odd, none, rows):
    got = by_text(rules.judged(odd), rows)
    for i, t in rows:
        if i is None:
            continue
        w, t = words_of(t), t or ""
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
    kept = rules.accepted(odd)
    assert kept.columns == odd.columns and rules.accepted(none).count() == rules.judged(none).count() == 0


def test_suffixes(odd, none, rows):
    got = by_text(suffixes.removals(odd), rows)
    seen, texts = set(), {i: (t or "").encode() for i, t in rows if i is not None}
    for i in sorted(texts):
        b, gone, again = texts[i], bytearray(len(texts[i])), -1
        for s in range(len(b) - 99):
            w = hash(b[s : s + 100])
            if w in seen:
                a = max(s, again)
                gone[a : s + 100] = b"\1" * (s + 100 - a)
                again = s + 100
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), sum(gone), hashlib.sha256(left).hexdigest()), i
    cut = suffixes.without_repeats(odd, n_chars_col="n_chars")
    assert cut.columns == odd.columns and cut.count() == len(rows)
    assert {r.span for r in cut.collect()} == {"own span"} and sum(r.doc_id is None and r.text is not None for r in cut.collect()) == 1
    assert suffixes.removals(none).count() == suffixes.without_repeats(none).count() == 0


def test_pii(odd, none, rows):
    got = by_text(pii.found(odd), rows)
    assert got[6].n_email == 1 and got[11].n_phone == 1 and "secret:" in got[12].spans and got[1].spans == ""
    masked = pii.masked(odd, n_chars_col="n_chars")
    assert masked.columns == odd.columns and masked.count() == len(rows)
    assert {r.doc_id: r.text for r in masked.collect()}[6].endswith("mail <email>")
    assert pii.found(none).count() == pii.masked(none).count() == 0


def test_stages(spark, odd, none, rows):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, "")
        assert got.columns == odd.columns and 0 < got.count() <= len(rows), name
        assert stage(spark, none, "").count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in last(spark, odd, "").collect()} == {i for i, _ in rows} and last(spark, none, "").count() == 0


@pytest.fixture(scope="module")
def small(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, f"text number {i} with {'good' if i % 2 else '###'} words " * 6) for i in range(20, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs.where("false").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "0L as n_chars").write.parquet(f"{d}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/none/labels.parquet")
    talk = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(c, t, "user", f"turn {t} of {c % 3}") for c in range(12) for t in range(c)], talk).write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([], talk).write.parquet(f"{d}/none/conversations.parquet")
    return d


COLUMNS = {
    "op1_quality": "doc_id held_out score predicted",
    "op2_minhash": "doc_id n_shingles component_id kept",
    "op3_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_tokens": "doc_id n_tokens",
    "op6_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11_prefixtrie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_periods": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_rankarray": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_queries(spark, small, name):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    got = queries.QUERIES[name](spark, small)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    collected = got.collect()
    if name == "op11_prefixtrie":
        assert sum(r.depth == 0 for r in collected) == 1
    else:
        assert len(collected) == n if name != "op4_packing" else sum(r.start == 0 for r in collected) == n
    if name == "op1_quality":
        for r in collected:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    assert queries.QUERIES[name](spark, f"{small}/none").count() == 0


def test_pipeline_of_nothing(spark, small):
    assert corpus_pipeline.run(spark, f"{small}/none").count() == 0
    assert corpus_pipeline.run(spark, small).count() > 0
