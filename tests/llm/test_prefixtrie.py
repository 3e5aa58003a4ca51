"""The prefix trie against nodes listed one by one."""

import hashlib
import random
import zlib

import pytest

from jobstrata.llm import prefixtrie

TALK = "conv_id long, turn long, role string, text string, key string, parent string, depth int, n int, block int"


def brute(rows, rebuild):
    """Every node of the trie; equal turns stand in the order of their digests."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    order = lambda v: (v[0] is not None, v[0] or 0, hashlib.sha256(f"{len(v[1].encode())}:{v[1]}:{v[2]}".encode()).hexdigest())
    own = {c: [(r, x) for _, r, x in sorted(v, key=order)] for c, v in convs.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:]) if rebuild else tuple(own[c])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids, leaves, saved = (dict.fromkeys(nodes, 0) for _ in range(3))
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(60), 40):
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "bé", "ccc", "", None])) for t in range(r.randrange(12))]
    rows += [(70 + k, t, "user", f"long {t if t < 150 + k else -k}") for k in range(4) for t in range(200)]  # deep, one branch after another
    rows += [(80, None, "user", "first"), (80, -3, None, "second"), (80, 2, "user", "tie"), (80, 2, "user", "tie"), (80, 2, "assistant", "tie"), (None, 0, "user", "nobody")]
    rows += [(5000 + c, t, "user", f"copy {t}") for c in range(120) for t in range(3)]  # a large group of copies
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "own", "own", -1, -1, -1) for x in rows], TALK).repartition(3)


@pytest.mark.parametrize("rebuild", [False, True])
def test_every_node(spark, rebuild, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 16)  # conversations of several blocks
    monkeypatch.setattr(prefixtrie, "ENDS", 32)
    rows = talks(5)
    df = frame(spark, rows)
    got = prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.numbered(df))) if rebuild else prefixtrie.trie_of(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, rebuild)


def test_turnless_conversations(spark, tmp_path):
    # of ids that lend no turns: all own turns go, and the root keeps the conversation
    alone = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 9 > 2 and c % 5]
    rows = [(c, t, "user", "x") for c in alone[:6] for t in range(2)]
    frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = prefixtrie.op11_prefixtrie(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == brute(rows, True) and len(got) == 1 and got[0].n_leaves == 1


def test_sql_gives_the_same_nodes(spark, tmp_path):
    import duckdb

    rows = talks(6)
    frame(spark, rows).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(con.sql(prefixtrie.OP11_SQL).fetchall(), key=str) == brute(rows, True)


def test_no_rows(spark):
    none = frame(spark, [(None, 1, "user", "x")])
    assert prefixtrie.trie_of(none).count() == 0 and prefixtrie.trie_of(none.where("false")).count() == 0
