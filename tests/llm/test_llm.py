"""Small cases of every dealt operator, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from jobstrata.llm import bpe, fingerprints, licenses, minhash, packing, pii, quality, rules, suffixes, tokenfiles
from jobstrata.llm.components import components

WORD = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, component_id long"


def texts():
    r = random.Random(4)
    words = [w + e for w in "al be ci do eñ fu gä hi".split() for e in ("", "ta", "ron", "!", ".")]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = make(300), make(60)
    out = [None, "", " \n\t ", "one", "one two", "a b c d e", base, base, base.replace("al", "AL", 1), base[:-40] + make(8), make(150) + passage + make(100), make(40) + " " + passage]
    out += ["mail a.b-c@x-y.example.com, ip 10.0.0.256 1.2.3.4 card 4242 4242 4242 4242 phone +1 (974) 555-3436.", 'token = "dfd1944d2e84f15e89902e34b677eb5a8a7d42ab" by Dr. Anna Keller', "日本語 é" * 60, "x" * 700]
    out += ["under CC BY 4.0. All rights reserved. all RIGHTS reserved", "licensed under the GNU General Public License, version 3."] + [make(r.randint(1, 400)) for _ in range(25)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s" if i % 3 else None, None, None, None, None) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rules(docs, empty):
    got = by_id(rules.judged(docs))
    assert len(got) == len(texts())
    for i, t in texts():
        w, t = words_of(t), t or ""
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if words_of(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = rules.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())
    assert rules.judged(empty).count() == 0


def brute_groups(rows, percent=85):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = words_of((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i, _ in rows}
    near = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while any(comp[i] != comp[j] for i, j in near):
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return sets, comp


def test_minhash(spark, docs, empty):
    sets, comp = brute_groups(texts())
    got = by_id(minhash.near_groups(docs, 85))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert comp[7] == comp[8] == 6
    assert minhash.near_groups(empty).count() == 0
    one = minhash.one_of_each(docs, 85)
    assert one.columns == docs.columns and one.count() == sum(i == c for i, c in comp.items())


def near_copies(n, words, changes, seed=9):
    r = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(*changes)):
            w[r.randrange(words)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("n, words, changes, small, block", [(160, 150, (1, 6), 48, 60_000), (500, 60, (0, 3), 48, 60_000), (160, 150, (1, 6), 3, 3000)])
def test_minhash_large_group(spark, monkeypatch, n, words, changes, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", block)
    rows = near_copies(n, words, changes)
    sets, comp = brute_groups(rows)
    assert len(set(comp.values())) > 3
    got = by_id(minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 85))
    assert {i: g.component_id for i, g in got.items()} == comp
    assert {i: g.n_shingles for i, g in got.items()} == {i: len(x) for i, x in sets.items()}


def test_minhash_links_of_repeated_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "pq")
    rows = [(5, a), (5, b), (7, a + " one"), (8, b + " two"), (9, b + " two"), (3, "alone")]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(got, 85).collect()) == [(3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 5, False)]


def test_forest_is_as_small_as_can_be():
    r = np.random.default_rng(2)
    for _ in range(50):
        n = int(r.integers(1, 30))
        near = r.random((n, n)) < 0.1
        near |= near.T
        part = r.integers(0, 12, n)
        links = minhash.forest(near, part)
        whole = {int(p): int(p) for p in part}
        for a, b in [(int(part[i]), int(part[j])) for i, j in np.argwhere(near)]:
            whole = {k: min(whole[a], whole[b]) if v in (whole[a], whole[b]) else v for k, v in whole.items()}
        mine = {int(p): int(p) for p in part}
        for a, b in links:
            assert mine[a] != mine[b]  # none that is not needed
            mine = {k: min(mine[a], mine[b]) if v in (mine[a], mine[b]) else v for k, v in mine.items()}
        assert mine == whole


def test_super_minhash_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 2**63, 200, dtype=np.uint64)])
    sig = minhash.super_minhash(np.concatenate([a, b]), np.array([0, 1000, 2000]), 256)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.1
    small = minhash.super_minhash(np.arange(3, dtype=np.uint64), np.array([0, 3, 3]), 16)
    # each register holds a rank of one of the elements; an empty set none
    assert np.isfinite(small[0]).all() and np.isinf(small[1]).all()


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 7), (5, 6)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5, 6: 5}


def test_bpe(docs, empty):
    import tiktoken

    path = public_tokenizers.path(RANKS)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = by_id(bpe.digests(docs, path, public_tokenizers.PATTERN))
    for i, t in texts():
        ids = ref.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0
    enc = bpe.text_encoder(path, public_tokenizers.PATTERN)
    r = random.Random(2)
    for _ in range(3000):
        x = "".join(r.choice(["a", "the", " ", "  ", "\n", "\t", "'s", "é", "1", "!", "\x85", "\x1c", "日", "　"]) for _ in range(r.randint(1, 12)))
        assert enc.ids(x) == ref.encode_ordinary(x), repr(x)


def test_prefixes_append_and_edit():
    core = bpe.text_encoder(public_tokenizers.path(RANKS), public_tokenizers.PATTERN).core
    p = bpe.Prefixes(core, b"international")
    p.append(b"isation")
    assert p.ids() == core.encode(b"internationalisation")
    p.edit(5, 13, b"twined")
    assert p.ids() == core.encode(b"internationalisation"[:5] + b"twined" + b"isation") and core.decode(p.ids()) == p.data


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(WORD))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts()}
    rows = packing.packed(docs, public_tokenizers.path(WORD), window=64, open_windows=4).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, want in ids.items():
        pos = 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == pos and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[pos : pos + r.length], "<u4").tobytes())
            pos += r.length
        assert pos == len(want)
    padding = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.concatenate([[0], np.cumsum([r.length for r in s])])[:-1].tolist()
        n = sum(r.length for r in s)
        assert n <= 64
        padding += 64 - n if n & (n - 1) else 0
    assert padding < 0.2 * sum(map(len, ids.values()))
    assert packing.packed(empty, public_tokenizers.path(WORD)).count() == 0


def test_token_files(docs, empty, tmp_path):
    path = public_tokenizers.path(RANKS)
    enc = bpe.text_encoder(path, public_tokenizers.PATTERN)
    want = {i: len(enc.ids(t or "")) for i, t in texts()}
    for block in (7, 1 << 17):
        folder = tmp_path / f"f{block}"
        names = tokenfiles.write_files(docs.select("doc_id", "text"), str(folder), path, public_tokenizers.PATTERN)
        got = names.join(tokenfiles.separators(names, str(folder), block=block), ["file", "ordinal"]).collect()
        # nothing but identifiers: the texts' and one end for each
        flat = {p.name: np.frombuffer(p.read_bytes(), "<u2") for p in folder.iterdir() if p.suffix == ".u16"}
        for r in got:
            assert flat[r.file][r.start : r.start + r.n_tokens].tolist() == enc.ids(dict(texts())[r.doc_id] or "") and flat[r.file][r.start + r.n_tokens] == tokenfiles.END
        assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
        for file in {r.file for r in got}:
            mine = sorted((r for r in got if r.file == file), key=lambda r: r.ordinal)
            assert [r.start for r in mine] == np.concatenate([[0], np.cumsum([r.n_tokens + 1 for r in mine])])[:-1].tolist()
    assert tokenfiles.token_counts(empty, path, public_tokenizers.PATTERN).count() == 0


def test_fingerprints(docs, empty):
    got = by_id(fingerprints.compared(docs))
    order = sorted(texts(), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[6].fingerprint == got[7].fingerprint and got[6].fingerprint != got[20].fingerprint
    assert got[7].near_next == 1
    assert fingerprints.compared(empty).count() == 0


def test_a_lexicon_too_large_to_broadcast(docs, empty, monkeypatch):
    want = sorted(map(tuple, fingerprints.compared(docs).collect()))
    monkeypatch.setattr(fingerprints, "LEXICON", 5)
    assert sorted(map(tuple, fingerprints.compared(docs).collect())) == want
    monkeypatch.setattr(fingerprints, "LEXICON", -1)
    assert fingerprints.compared(empty).count() == 0


def mixed(x):
    mask = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def test_fingerprints_against_lists(spark):
    """The whole of I-Match once more, in lists and sets."""
    r = random.Random(12)
    rows = [(i, " ".join(f"W{r.randrange(400)}é" for _ in range(r.randint(0, 80))) if i % 9 else r.choice([None, "", "?!"])) for i in range(70)]
    rows[30] = (30, rows[31][1])
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    hashed, mask = {}, (1 << 64) - 1

    def number(w):
        if w not in hashed:
            b = np.frombuffer(w.encode(), np.uint8)
            hashed[w] = int(fingerprints.span_hash(b, np.array([0]), np.array([len(b)]))[0])
        return hashed[w]

    def terms(t):
        return {number(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))}

    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    df = Counter(h for _, t in order for h in terms(t))
    n = len(order)
    band = {h for h, c in df.items() if max(2, -(-n * fingerprints.LOW // 1)) <= c <= max(2, int(n * fingerprints.HIGH))}
    salts = [int(x) for x in fingerprints._SALTS]

    def list_hash(items):
        return mixed(sum(x * pow(0x9E3779B97F4A7C15, r, 1 << 64) for r, x in enumerate(items)) & mask)

    def fingerprint(t):
        mine = sorted(terms(t) & band)
        whole = list_hash([mixed(h) for h in mine]) if mine else int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
        parts = []
        for k, salt in enumerate(salts):
            density = fingerprints.DENSITIES[k // fingerprints.SUBSETS]
            inside = [h for h in mine if mixed(h + salt & mask) % density == 0]
            parts.append(list_hash([mixed(h ^ salt) for h in inside]) & 0xFFFF | 1 if inside else 0)
        return whole, parts

    def like(a, b):
        if a[0] == b[0]:
            return 1.0
        w = fingerprints.SUBSETS
        for d in range(len(fingerprints.DENSITIES) - 1, -1, -1):
            pairs = [(x, y) for x, y in zip(a[1][d * w : d * w + w], b[1][d * w : d * w + w], strict=True) if x or y]
            if len(pairs) >= (fingerprints.ENOUGH if d else 1):
                return sum(x == y for x, y in pairs) / len(pairs)
        return 0.0

    def text_of(f):
        return f"{f[0]:016x}" + "".join(f"{x:04x}" for x in f[1])

    assert len(band) > 20
    got = by_id(fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % n][1]
        own, new, other = fingerprint(t), fingerprint(fingerprints.edited(t, nxt)), fingerprint(nxt)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (text_of(own), text_of(new))
        assert (r.near_edited, r.near_next) == (like(own, new), like(own, other))


def test_licenses(docs, empty):
    got = by_id(licenses.scanned(docs))
    for i, t in texts():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(","))
    assert "gpl-3.0" in got[17].labels
    assert licenses.scanned(empty).count() == 0


def brute_removed(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = True
            seen.add(b[s : s + n])
        out[i] = gone
    return out


def test_suffixes(docs, empty):
    got = by_id(suffixes.removals(docs))
    for i, gone in brute_removed(texts()).items():
        b = np.frombuffer((dict(texts())[i] or "").encode(), np.uint8)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(b[~gone].tobytes()).hexdigest())
    assert suffixes.removals(empty).count() == 0
    cut = suffixes.without_repeats(docs, n_chars_col="n_chars")
    assert cut.columns == docs.columns and by_id(cut)[7].text == "" and by_id(cut)[0].text is None


@pytest.mark.parametrize("shard", [1 << 18, 2500, 600])
def test_merged_transforms(shard):
    r = np.random.default_rng(1)
    base = [bytes(r.integers(97, 100, 60, dtype=np.uint8)) for _ in range(6)]
    strings = [b"".join(base[k] for k in r.integers(0, 6, r.integers(2, 6))) for _ in range(60)]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
    doc, lo = np.arange(60) // 2, np.where(np.arange(60) % 2, 1000, 0)
    a, b = suffixes.covered(np.frombuffer(b"".join(strings), np.uint8), offs, doc, lo, shard)
    first, want = set(), set()
    for _, _, i, s in sorted((doc[i], lo[i] + s, i, s) for i, x in enumerate(strings) for s in range(len(x) - 99)):
        w = strings[i][s : s + 100]
        want |= {(i, s)} if w in first else set()
        first.add(w)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


@pytest.mark.parametrize("width", [35, 12, 1])
def test_split_stretches(width):
    r = random.Random(3)
    line = "".join(r.choice("abcd") for _ in range(90))
    raw = "".join("".join(r.choice("ab") for _ in range(r.randint(5, 60))) + line for _ in range(30)).encode()
    data = np.frombuffer(raw, np.uint8)
    anchor, _, lo, hi = suffixes.stretches(data, np.array([0, len(data)]))
    part_lo, part_more, key = suffixes.split_stretches(raw, lo.astype(np.int32), (hi - lo).astype(np.uint8), width)
    assert sorted(s for a, m in zip(part_lo, part_more, strict=True) for s in range(a, a + m + 1)) == list(range(len(raw) - 99))
    assert part_more.max() < width
    keys = {}
    for a, m, k in zip(part_lo, part_more, key, strict=True):
        for s in range(a, a + m + 1):
            assert keys.setdefault(raw[s : s + 100], k) == k
    if width == 1:
        assert len(set(keys.values())) == len(keys)


@pytest.mark.parametrize("hot, hotter", [(2, (1, 2, 4)), (2, (1, 100, 1000)), (2, (0.1, 1, 1000)), (2, (0.01, 0.02, 0.1))])
def test_suffixes_of_hot_anchors(spark, monkeypatch, hot, hotter):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HOTTER", hotter)
    r = random.Random(6)
    line = "".join(r.choice("abcdefgh ") for _ in range(130))
    some = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(20, 90)))
    rows = [(i, some() + line[: r.randint(70, 130)] + some() + line[r.randint(0, 40) :]) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1][20:]), (62, "é" + rows[4][1])]
    got = by_id(suffixes.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    for i, gone in brute_removed(rows).items():
        assert got[i].n_removed == int(gone.sum())
        assert got[i].kept_sha256 == hashlib.sha256(np.frombuffer(dict(rows)[i].encode(), np.uint8)[~gone].tobytes()).hexdigest()


def test_marks_never_outnumber_themselves():
    schema = suffixes.pa.schema([(c, t) for c, t in zip(("span", "kind", "doc", "lo", "more", "anchor"), (suffixes.pa.int32(), suffixes.pa.int32(), *[suffixes.pa.binary()] * 4), strict=True)])
    marks = suffixes.Marks(7, schema)
    doc = np.arange(-20, 480, dtype=np.int64)
    marks.add(1, doc, np.arange(500), np.zeros(500))
    marks.add(np.where(doc % 2, 2, 0), doc, np.arange(500), np.ones(500), doc.view(np.uint64))
    rows = [r for b in marks.give() for r in b.to_pylist()]
    assert len(rows) == 21 and not list(marks.give())
    held = suffixes.Held()
    for r in rows:
        if r["span"] == -20 % 7:
            held.add(r)
    of = held.ready().of(-20)
    assert sorted(zip(held.kinds[of].tolist(), held.lo[of].tolist(), strict=True)) == [(0, 0), (1, 0)]
    assert held.of(None) == slice(0, 0) and held.of(-19) == slice(*[held.of(-19).start] * 2)


def test_very_long_text_in_pieces(monkeypatch):
    data = np.frombuffer(("abc " * 40 + "".join(map(str, range(3000)))).encode(), np.uint8)
    slab = suffixes.Slab(data, np.array([0, len(data)]), [1])
    whole = suffixes.stretches(data, slab.offs)
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    windows = {}
    for piece, shift in suffixes._pieces(slab):
        h, _, lo, hi = suffixes.stretches(piece.data, piece.offs)
        windows |= {s + shift: int(x) for x, a, b in zip(h, lo, hi, strict=True) for s in range(a, b + 1)}
    assert windows == {s: int(x) for x, _, a, b in zip(*whole, strict=True) for s in range(a, b + 1)}


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def good(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_pii(docs, empty):
    got = by_id(pii.found(docs))
    for i, t in texts():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS for m in re.finditer(p, t or "") if good(k, m.group())]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == len(spans)
        assert set(spans) <= set(got[i].spans.split(",")) | {""}
    assert got[12].n_email == got[12].n_ip == got[12].n_card == got[12].n_phone == 1
    assert "secret:" in got[13].spans and "name:" in got[13].spans
    masked = pii.masked(docs, n_chars_col="n_chars")
    rows = by_id(masked)
    assert masked.columns == docs.columns and "<email>" in rows[12].text and rows[0].text is None
    assert all(rows[i].text == t for i, t in texts() if not got[i].spans)
    assert pii.found(empty).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    crf = pii.Crf()
    r = np.random.default_rng(3)
    crf.emit, crf.move = r.normal(size=crf.emit.shape), r.normal(size=crf.move.shape)
    first = np.array([0, 4, 5, 7])
    shape = r.integers(0, 500, 7)
    got = crf.decode(shape, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        edge = np.zeros(b - a, bool)
        edge[0] = True
        s = crf.scores(shape[a:b], edge)
        value = lambda p: sum(s[k, x] for k, x in enumerate(p)) + sum(crf.move[x, y] for x, y in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(got[a:b]) == max(itertools.product(range(len(pii.TAGS)), repeat=int(b - a)), key=value)


def test_quality(spark, docs, empty):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "on", "ear"]) + ("&&&" if i % 2 else "") for _ in range(60)), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("label", minhash.F.lit("clash"))
    labels = df.select("doc_id", (1 - minhash.F.col("quality")).alias("quality"))
    net = quality.trained(df, labels)
    got = by_id(quality.scored(df, net))
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i].score >= 0.5) == (i % 2 == 0) for i in held)
    sample, _ = quality.training_sample(df, labels, "quality")
    assert not {t.encode() for i, t, _ in rows if i in held} & set(sample)
    assert all(0 <= x.score <= 1 for x in quality.scored(docs, net).collect())
    assert quality.trained(df, labels.limit(0)) is None
    assert {x.score for x in quality.scored(docs, None).collect()} == {0.5}
    assert quality.scored(empty, net).count() == 0


def test_convolution_gradient():
    net = quality.ConvNet(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data = np.frombuffer(b"some text that is long enough" + b"another", np.uint8)
    offs, y = np.array([0, 29, 36]), np.array([1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(s := net.scores(data, offs)) + (1 - y) * np.log(1 - s))  # noqa: E731, F841
    g = net.gradient(data, offs, y)
    for k, at in (("filters", (3, 5)), ("out", (2,)), ("embed", (int(data[0]) + 1, 1)), ("bias", (4,))):
        old = net.w[k][at]
        net.w[k][at] = old + 1e-5
        up = loss()
        net.w[k][at] = old - 1e-5
        down = loss()
        net.w[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f g " * 20), (1, "a b c d e f g " * 20), (2, "h i j k l m n " * 20), (None, "a b c d e f g " * 20), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash.near_groups(df).count() == 5 and rules.judged(df).count() == 5 and pii.found(df).count() == 5
    assert fingerprints.compared(df).count() == 5 and suffixes.removals(df).count() == 5 and licenses.scanned(df).count() == 5
    near = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(df).collect()]
    assert sorted(near, key=str) == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True), (None, None, True)]
    got = [r.n_removed for r in suffixes.removals(df).collect() if r.doc_id == 1]
    assert got[0] == got[1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path / "sf")
    some = [*texts(), (500, " ".join(f"the w{k} of v{k} and u{k}" for k in range(20)) + " write to far.away@x.example.org or call +1 (974) 555-3436")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in some]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    at = spark.read.parquet(f"{d}/documents.parquet")
    judged = {r.doc_id: r.kept for r in rules.judged(at).collect()}
    left = [(i, t) for i, t in some if judged[i]]
    _, comp = brute_groups(left, 80)
    left = [(i, t) for i, t in left if comp[i] == i]
    gone = brute_removed(left)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, d)
        assert at.columns == docs.columns, name
    got = by_id(at)
    assert set(got) == {i for i, _ in left}
    cuts = []
    for i, t in left:
        cut = np.frombuffer(t.encode(), np.uint8)[~gone[i]].tobytes().decode("utf-8", "ignore")
        cuts.append((i, cut))
        assert got[i].n_chars == len(got[i].text)
    # what masking makes of the texts as brute force has cut them
    want = by_id(pii.masked(spark.createDataFrame(cuts, "doc_id long, text string")))
    assert {i: r.text for i, r in got.items()} == {i: r.text for i, r in want.items()} and any("<email>" in r.text for r in want.values())
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(got)


def test_pipeline_near_copies_of_eighty_percent(spark):
    import corpus_pipeline

    # n five-word runs, of which the last k differ: likeness (n - k) / (n + k)
    rows = []
    for at, (n, k) in enumerate([(100, 10), (90, 10), (100, 12), (100, 2)]):
        words = [f"p{at}w{j}" for j in range(n + 4)]
        rows += [(2 * at, " ".join(words)), (2 * at + 1, " ".join(words[:-k] + [f"p{at}x{j}" for j in range(k)]))]
    _, comp = brute_groups(rows, 80)
    assert [comp[i] for i in range(8)] == [0, 0, 2, 2, 4, 5, 6, 6]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == {i for i, c in comp.items() if i == c}


def test_frequent_licenses(spark):
    notice = "Licensed under the MIT License."
    rows = [(i, f"aa bb {notice} cc" if i % 3 else "apache gnu lesser affero mozilla redistribution unencumbered cc0") for i in range(60)]
    got = by_id(licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {i for i, r in got.items() if r.labels == "mit" and r.score == 1} == {i for i, _ in rows if i % 3}


def test_licenses_beside_others(spark):
    every = [(label, t) for label, pairs in licenses.TEMPLATES.items() for t, _ in pairs]
    rows = [(0, " and so. ".join(t for _, t in every))] + [(1 + k, t) for k, (_, t) in enumerate(every)]
    rows += [(100 + k, "Licensed under the MIT License") for k in range(60)]
    got = by_id(licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")))
    assert set(got[0].labels.split(",")) >= set(licenses.TEMPLATES)
    assert all(label in got[1 + k].labels.split(",") and got[1 + k].score == 1 for k, (label, _) in enumerate(every))


def test_license_places_against_every_offset():
    r = random.Random(5)
    index = licenses.Index()
    looked = [{w for w in mine if index.posted[w]} for mine in index.words_of]
    texts = []
    for _ in range(150):
        parts = [r.choice(index.words_of)[r.randint(0, 3) :][: r.randint(1, 30)] if r.random() < 0.5 else [r.randrange(-1, len(index.words))] for _ in range(r.randint(0, 12))]
        texts.append([w for p in parts for w in p])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = defaultdict(list)
    for doc, t, share in index.found(np.array([w for t in texts for w in t]), first):
        got[doc].append((t, round(share, 9)))
    for i, w in enumerate(texts):
        want = []
        for t, (mine, key, at) in enumerate(zip(index.words_of, index.keys, index.key_at, strict=True)):
            weigh = lambda places, m=mine, t=t: sum(index.idf[m[q]] for q in places if m[q] in looked[t])
            beyond = [q for q in range(len(mine)) if not at <= q < at + len(key)]
            for o in range(-len(mine), len(w)):
                here = [q for q in range(len(mine)) if 0 <= o + q < len(w) and w[o + q] == mine[q]]
                if set(range(at, at + len(key))) <= set(here) and weigh([q for q in beyond if q in here]) >= licenses.SHARE * weigh(beyond) - 1e-12:
                    want.append((t, round(weigh(here) / weigh(range(len(mine))), 9)))
        assert sorted(got[i]) == sorted(want)


def test_a_key_phrase_alone_is_no_license(spark):
    pairs = [(label, t, key) for label, ps in licenses.TEMPLATES.items() for t, key in ps]
    rows = [(k, f"and so {key} as they say") for k, (_, _, key) in enumerate(pairs)]
    rows += [(100 + k, "word " * 5000 + key + " word" * 5000) for k, (_, _, key) in enumerate(pairs)]
    rows += [(200 + k, "word " * 9000 + t + " word" * 9000) for k, (_, t, _) in enumerate(pairs)]
    got = by_id(licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")))
    for k, (label, t, key) in enumerate(pairs):
        assert got[k].labels == got[k].base_labels == got[100 + k].labels or key == t, key
        assert label in got[200 + k].labels.split(",") and got[200 + k].score == 1


def test_labels_do_not_depend_on_other_rows(spark):
    r = random.Random(8)
    words = sorted({w for pairs in licenses.TEMPLATES.values() for t, _ in pairs for w in t.split()})
    notices = [t for pairs in licenses.TEMPLATES.values() for t, _ in pairs]
    rows = [(i, " ".join([*r.choices(words, k=r.randint(0, 30)), *r.choice(notices).split()[r.randint(0, 6) :], *r.choices(words, k=5)])) for i in range(120)]
    others = [(1000 + i, r.choice(words)) for i in range(400)] + [(2000 + i, "licensed under the mit license") for i in range(200)]
    alone = by_id(licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")))
    among = by_id(licenses.scanned(spark.createDataFrame(rows + others, "doc_id long, text string").repartition(3)))
    assert any(x.labels for x in alone.values()) and all(alone[i] == among[i] for i, _ in rows)


def test_crf_decodes_whole_texts():
    crf = pii.trained_crf()
    r = random.Random(7)
    want = {
        "we saw Dr. Martin Luther King there": ["Martin Luther King"],
        "signed by Mrs. Maria Anna Lopez Garcia in spring": ["Maria Anna Lopez Garcia"],
        "he lives at 12 Upper Baker Street in town": ["12 Upper Baker Street"],
        "he lives at 12 Old Upper Baker Street in town": ["12 Old Upper Baker Street"],
        " ".join(["Sich"] * 300): [],
    }
    pool = "the of and Was Der Dr. Mr. King Street Road 12 4711 x7 \"q7Zt19sK\" = token \"on\" Upper Baker a1b2c3 LOUD!! DE89370400440532013000".split()
    some = [t for _, t in texts() if t] + list(want) + [" ".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(400)] + ["", " ", "12", "Dr."]
    raw = [t.encode() for t in some]
    slab = pii.Slab(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]), [None] * len(raw))
    for i, (b, got) in enumerate(zip(raw, pii.added_spans(slab, crf), strict=True)):
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        starts, ends = np.array(at, np.int64).reshape(-1, 2).T
        tags = crf.decode(pii.shapes(np.frombuffer(b, np.uint8), starts, ends), np.array([0, len(at)])) if at else []
        spans, last = [], 0
        for tag, (s, e) in zip(tags, at, strict=True):
            if tag and tag == last:
                spans[-1] = (*spans[-1][:2], e)
            elif tag:
                spans.append((pii.TAGS[tag], s, e))
            last = tag
        assert got == spans, some[i]
        if some[i] in want:
            assert [b[s:e].decode() for _, s, e in got] == want[some[i]]


def test_crf_on_a_table_it_was_not_fitted_on():
    """Spans in sentences of other words than the labelled table's: found, and nothing else."""
    r = random.Random(31)
    firsts, lasts = "Emma Noah Lukas Sofia Pierre Lucia Ingrid Omar".split(), "Fischer Johnson Moreau Garcia Novak Oconnor Rossi Lindberg".split()
    hills, roads = "Oak Elm River Green Church King Queen Forest".split(), ["Street", "Road", "Lane", "Avenue", "Boulevard", "Drive"]
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    said = {
        "name": lambda: (" ".join([r.choice(firsts), *r.choices(lasts, k=r.randint(1, 2))]), ["I met {t} % on the train", "the talk of {t} % was long", "we thank {t} % for the help"]),
        "secret": lambda: ('"' + "".join(r.choice("abcdefABCDEF0123456789xyzXYZ") for _ in range(r.choice([16, 20, 32, 40]))) + '"', ["found {w} = % in the log", "the line {w} = % leaked", "please rotate {w} = % soon"]),
        "account": lambda: (r.choice(["DE", "FR", "AT", "CH"]) + digits(r.choice([18, 20, 22])), ["the sum went to % yesterday", "transfer from % failed", "my account is % at the bank"]),
        "address": lambda: (f"{r.randint(1, 900)} {' '.join(r.choices(hills, k=r.randint(1, 2)))} {r.choice(roads)}", ["she moved to % last year", "the shop at % is closed", "deliver to % please"]),
    }
    rows = []
    for k in range(400):
        tag = list(said)[k % 4]
        span, forms = said[tag]()
        text = r.choice(forms).format(t=r.choice(["Dr.", "Mr.", "Mrs.", "Ms.", "Prof."]), w=r.choice(["password", "token", "api_key"])).replace("%", span)
        rows.append((text.encode(), tag, text.index(span), text.index(span) + len(span)))
    offs = np.concatenate([[0], np.cumsum([len(t) for t, *_ in rows])])
    slab = pii.Slab(np.frombuffer(b"".join(t for t, *_ in rows), np.uint8), offs, [None] * len(rows))
    got = pii.added_spans(slab, pii.trained_crf())
    for tag in said:
        mine = [(want, g) for (_, *want), g in zip(rows, got, strict=True) if want[0] == tag]
        assert sum(tuple(want) in g for want, g in mine) >= 0.9 * len(mine)
    assert sum(tuple(x) != tuple(want) for (_, *want), g in zip(rows, got, strict=True) for x in g) <= 0.1 * len(rows)
