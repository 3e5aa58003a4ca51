"""State with timers against the batch folds and a plain dict."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobstrata.operators import state
from jobstrata.streaming import stateful


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(stateful.PROVIDER)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKSDB)
    yield spark
    spark.conf.set(stateful.PROVIDER, before)


def landed(spark, rows, schema, path, batches):
    """The rows in files that a stream reads one at a time."""
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_health_is_that_of_the_batch_folds(rocks, tmp_path):
    r = random.Random(2)
    noon = datetime.datetime(2024, 5, 1, 12)
    date = lambda s: (noon + datetime.timedelta(seconds=s)).strftime("%a, %d %b %Y %H:%M:%S GMT")
    rows = [(k, f"d{r.randrange(3)}", f"u{r.randrange(4)}", r.choice([200, 200, 301, 404, 429, 500, 503]), r.choice(["", "4", "0", "soon", date(9), date(-9), date(99)]), noon) for k in range(240)]
    schema = "id long, domain string, url string, status int, retry_after string, at timestamp"
    stream = stateful.crawl_health(landed(rocks, rows, schema, str(tmp_path / "in"), 4))
    got = stateful.drained(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "update").collect()
    assert len({x.batch for x in got}) == 4
    last = {}
    for x in sorted(got, key=lambda x: x.batch):
        last[x.domain, x.url] = x
    df = rocks.createDataFrame(rows, schema)
    spacing = {x.domain: (x.delay, x.n_events) for x in state.delays(df).collect()}
    by_domain = {}
    for (d, _), x in last.items():
        by_domain[d] = max(by_domain.get(d, (-1, 0, 0)), (x.batch, round(x.delay, 6), x.n_events))
    assert {d: x[1:] for d, x in by_domain.items()} == spacing
    fails = {(x.domain, x.url): (x.fail_count, x.is_active) for x in state.breaker(df.withColumn("k", F.struct("domain", "url")), "k").select("k.*", "fail_count", "is_active").collect()}
    assert {k: (x.fail_count, x.is_active) for k, x in last.items()} == fails


def test_blocks_of_fetches_fold_alike(spark):
    r = random.Random(3)
    rows = [(k, f"d{r.randrange(2)}", r.choice([200, 200, 200, 301, 404, 429, 503]), r.choice(["", "", "", "1", "12", "60", "0"])) for k in range(600)]
    want, n = {}, {}
    for _, d, s, w in rows:
        want[d] = state.next_delay(want.get(d, 0.5), s, float(w) if w and w != "0" else None)
        n[d] = n.get(d, 0) + (s in (429, 503) or 200 <= s < 400)
    df = spark.createDataFrame(rows, "id long, domain string, status int, retry_after string")
    for width in (2, 7, 4096):
        assert {x.domain: (x.delay, x.n_events) for x in state.delays(df, width).collect()} == {d: (round(v, 6), n[d]) for d, v in want.items()}
    plan = state.delays(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_dates_to_retry_after(spark):
    rows = [("Wed, 21 Oct 2099 07:28:00 GMT",), ("Wed, 01 May 2024 12:00:07 GMT",), ("Wed, 01 May 2024 11:00:00 GMT",), (" 5 ",), ("0",), ("later",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    at = F.lit(datetime.datetime(2024, 5, 1, 12)).cast("timestamp")
    got = [x[0] for x in df.select(state.retry_after_seconds(F.col("v"), at)).collect()]
    assert got[0] > 2e9 and got[1:] == [7, None, 5, None, None, None]
    assert [x[0] for x in df.select(state.retry_after_seconds(F.col("v"))).collect()] == [None, None, None, 5, None, None, None]
    far = spark.createDataFrame([(1, "a", 429, rows[0][0], datetime.datetime(2024, 5, 1))], "id long, domain string, status int, retry_after string, at timestamp")
    assert state.delays(far).first().delay == 30.0 and state.delays(far.drop("at")).first().delay == 1.0


EVENTS = "seq long, key string, at timestamp, op string, value string, ttl_seconds int, tokens_saved int"


def test_the_cache_answers_as_tables_do(rocks, tmp_path):
    """One log, as a stream and by cache_set and cache_read, event after event."""
    r = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows, second = [], 0
    for seq in range(160):
        second += r.randrange(0, 8)
        key, op = f"k{r.randrange(6)}", r.choice(["get", "get", "set"])
        rows.append((seq, key, start + datetime.timedelta(seconds=second), op, f"v{seq}" if op == "set" else None, r.choice([5, 30, 100]) if op == "set" else None, seq if op == "set" else None))
    stream = stateful.cached_answers(landed(rocks, rows, EVENTS, str(tmp_path / "in"), 4), "0 seconds")
    got = stateful.drained(stream, str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    entries, want, purged = {}, {}, 0
    for seq, key, at, op, value, ttl, tokens in rows:
        e = entries.get(key)
        if op == "set":
            entries[key] = [value, at + datetime.timedelta(seconds=ttl), 0, tokens]
        elif e is not None and e[1] > at:
            e[2] += 1
            want[seq] = ("hit", e[0], e[2], e[3])
        else:
            want[seq] = ("miss", None, 0, 0)
    assert {x.seq: (x.what, x.value, x.hit_count, x.tokens_saved) for x in got if x.what != "purged"} == want
    purged = [x for x in got if x.what == "purged"]
    assert purged and all(x.seq is None for x in purged)
    # the tables' operators on the same log
    cache = rocks.createDataFrame([], "key string, namespace string, value string, model string, ttl_seconds int, created_at long, hit_count int, tokens_saved int")
    hits = {}
    for seq, key, at, op, value, ttl, tokens in rows[:24]:
        now = F.lit(int((at - start).total_seconds())).cast("long")
        if op == "set":
            fresh = rocks.createDataFrame([(key, "jobs", value, "m", ttl, tokens)], "key string, namespace string, value string, model string, ttl_seconds int, tokens_saved int")
            cache = state.cache_set(cache, fresh, now)
            hits[key] = 0
        else:
            answers, cache = state.cache_read(cache, rocks.createDataFrame([(key,)], "key string"), now)
            hit = answers.first()
            assert (hit.hit, hit.value) == (want[seq][0] == "hit", want[seq][1])
            hits[key] = hits.get(key, 0) + hit.hit
        cache = rocks.createDataFrame(cache.collect(), cache.schema)
    assert {x.key: x.hit_count for x in cache.collect()} == {k: n for k, n in hits.items() if k in {x.key for x in cache.collect()}}


class _Calls:
    """State and timers of one part, and how many calls there were."""

    def __init__(self):
        self.n, self.held, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.n += 1
        return self.held

    def exists(self):
        self.n += 1
        return self.held is not None

    def update(self, value):
        self.n, self.held = self.n + 1, value

    def clear(self):
        self.n, self.held = self.n + 1, None

    def listTimers(self):  # noqa: N802
        self.n += 1
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.n += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 50_000


def test_calls_for_state_do_not_grow_with_the_keys():
    """the entries of many keys are one state, and one timer purges those that are over."""
    calls, cache = _Calls(), stateful.ResponseCache()
    cache.init(calls)
    rows = [(f"k{k}", 3 * k + n, 1000 * n, op, f"v{k}" if n == 0 else None, k % 100 if n == 0 else 0, k) for k in range(500) for n, op in enumerate(("set", "get", "get"))]
    frame = pd.DataFrame(rows, columns=["key", "seq", "at_ms", "op", "value", "ttl_seconds", "tokens_saved"])
    out = pd.concat(cache.handleInputRows((0,), iter([frame[:700], frame[700:]]), calls))
    want = {3 * k + n: ("hit", f"v{k}", n, k) if k % 100 > n else ("miss", None, 0, 0) for k in range(500) for n in (1, 2)}
    assert {r.seq: (r.what, r.value, r.hit_count, r.tokens_saved) for r in out.itertuples()} == want
    assert calls.n <= 4 and calls.timers == {1}
    calls.timers.clear()  # it went off
    gone = pd.concat(cache.handleExpiredTimer((0,), calls, None))
    assert set(gone["key"]) == {f"k{k}" for k in range(500) if k % 100 < 50} and calls.timers == {50_001}
    assert calls.n <= 8


def test_state_needs_its_provider(spark, tmp_path):
    spark.createDataFrame([(1, "d", "u", 200, "")], "id long, domain string, url string, status int, retry_after string").write.parquet(str(tmp_path / "x"))
    stream = spark.readStream.schema("id long, domain string, url string, status int, retry_after string").parquet(str(tmp_path / "x"))
    if "RocksDB" not in spark.conf.get(stateful.PROVIDER):
        with pytest.raises(ValueError, match="providerClass"):
            stateful.crawl_health(stream)
