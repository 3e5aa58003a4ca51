"""Data sources over landed answers, parsers in SQL, arrays in files."""

import decimal
import json
import os

import pytest
from pyspark.sql import functions as F

from jobstrata.operators import udtf
from jobstrata.sources import json_export, searchers


def land(folder, keyword, page, titles, name="a.html", place=None):
    at = folder / f"keyword={keyword}" / (f"place={place}" if place else "") / f"page={page}"
    at.mkdir(parents=True, exist_ok=True)
    (at / name).write_text("".join(f'<article data-at="job-item"><h2>{t}</h2><a href="/x--{k}">l</a></article>' for k, t in enumerate(titles)))


@pytest.fixture
def stepstone(spark, tmp_path):
    searchers.register(spark)
    for word in ("data", "c%2B%2B", "ops"):
        for page in range(3):
            land(tmp_path, word, page, [f"{word} Developer {page}{k}" for k in range(2)], place="wien" if word == "ops" else None)
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "notes.txt").write_text("no answer")
    return str(tmp_path)


def test_postings_of_landed_answers(spark, stepstone):
    rows = spark.read.format("stepstone").load(stepstone)
    assert rows.count() == 18
    first = rows.where("keyword = 'data' and page = 1").orderBy("pos").first()
    assert (first.title, first.company, first.location, first.url, first.source, first.pos, first.place) == ("data Developer 10", "Unknown", "Germany", "https://www.stepstone.de/x--0", "stepstone.de", 0, None)
    assert {r.keyword for r in rows.select("keyword").distinct().collect()} == {"data", "c++", "ops"}
    assert {r.place for r in rows.where("keyword = 'ops'").collect()} == {"wien"}


@pytest.mark.parametrize(
    "options, answers", [({"keywords": '["data"]'}, 3), ({"keywords": '["data", "c++"]', "last_page": 1}, 4), ({"first_page": 1, "place": "wien"}, 2), ({}, 9), ({"keywords": "[]"}, 0)]
)
def test_options_leave_out_answers(spark, stepstone, options, answers):
    rows = spark.read.format("stepstone").options(numPartitions=100, **options).load(stepstone)
    assert rows.rdd.getNumPartitions() == max(1, answers) and rows.count() == 2 * answers
    # a filter takes nothing from later queries over the same rows
    assert rows.where("page = 1").count() <= rows.count() == 2 * answers
    assert spark.read.format("stepstone").options(numPartitions=2, **options).load(stepstone).rdd.getNumPartitions() <= 2


def test_tables_of_answers(spark, tmp_path):
    """many answers lie in few files, and options choose among their rows."""
    html = lambda w, n: "".join(f'<article data-at="job-item"><h2>{w} Developer {n}{k}</h2><a href="/x--{k}">l</a></article>' for k in range(2))
    rows = [(w, n, html(w, n), p) for w, p in (("data", None), ("c++", None), ("a/b=c", "wien")) for n in range(40)] + [("none", 0, None, None), ("bare", 1, "", "graz")]
    searchers.register(spark)
    spark.createDataFrame(rows, "keyword string, page int, html string, place string").coalesce(2).write.option("maxRecordsPerFile", 25).parquet(str(tmp_path / "t"))
    read = lambda **o: spark.read.format("stepstone").options(**o).load(str(tmp_path / "t"))
    got = {(r.keyword, r.place, r.page, r.pos, r.title) for r in read().collect()}
    assert got == {(w, p, n, k, f"{w} Developer {n}{k}") for w, n, h, p in rows if h for k in range(2)}
    assert read(place="wien").count() == 80 and read(first_page=1, last_page=2).count() == 12 and read(keywords='["c++"]', first_page=39).count() == 2
    assert read(keywords="[]").count() == 0 and read().rdd.getNumPartitions() < 10 and read(numPartitions=2).rdd.getNumPartitions() == 2


def test_landing_of_searches_makes_no_folder_for_each_answer(spark, tmp_path):
    """files grow with the rows by thousands, not one by one."""
    import os

    from pyspark.sql import functions as F

    from jobstrata.plans import landed

    pages = [(k, "https://p", f'<ul><li><a href="/w{k}">x</a></li></ul>') for k in range(300)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    got = landed.QUERIES["sc9_sc10_searches"](spark, str(tmp_path))
    assert got.groupBy("source").agg(F.count("*").alias("n")).collect() and got.count() == 600
    new = [f for d in set(os.listdir(base)) - before for _, _, files in os.walk(f"{base}/{d}") for f in files if not f.startswith((".", "_"))]
    assert 0 < len(new) < 30


def test_answers_as_a_stream(spark, stepstone, tmp_path):
    from pathlib import Path

    stream = spark.readStream.format("stepstone").load(stepstone)
    out, checkpoint = str(tmp_path / "_out"), str(tmp_path / "_check")

    def run():
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(searchers.SCHEMA).parquet(out).count()

    assert run() == 18
    land(Path(stepstone), "data", 3, ["data Developer new"], "b.html")
    assert run() == 19 and run() == 19  # each answer once


def test_parsers_in_sql(spark):
    def upper(page, base):
        return [{"title": x.text().upper(), "location": "Unknown", "url": base, "department": None, "company": None} for x in page.select("h1")]

    udtf.Registry().add("own", upper).register(spark, "parse_mine")
    rows = [(1, "https://jobs.lever.co/a", '<div class="posting"><h5>Dev</h5><a href="/a/1">x</a></div>', "lever"), (2, "u", "<h1>qa</h1>", "own"), (3, None, None, "lever"), (4, "u", "<p>", "other")]
    rows += [(5, "https://a.b/", '<script type="application/ld+json">{"@type":"JobPosting","title":"Ops"}</script>', None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, platform string")
    got = spark.sql("SELECT page_id, pos, title, t.url FROM {df} p, LATERAL parse_mine(p.html, p.url, p.platform) t ORDER BY page_id", df=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, "Dev", "https://jobs.lever.co/a/1"), (2, 0, "QA", "u"), (5, 0, "Ops", "https://a.b/")]


JOBS = "id string, title string, skills array<string>, salary_from int, salary_to int, salary_currency string, published_at timestamp_ntz, price decimal(10,2), meta struct<a: int, b: array<string>>"


def array_of(path):
    if os.path.isdir(path):
        return b"".join(open(os.path.join(path, n), "rb").read() for n in sorted(os.listdir(path)) if not n.startswith("."))
    return open(path, "rb").read()


@pytest.mark.parametrize("single", [True, False])
def test_an_array_as_json_writes_it(spark, tmp_path, single):
    rows = [("1", "Größe \"x\"\n€", ["a", "b"], 5, None, None, None, None, (1, [])), ("2", None, [], None, None, "EUR", None, decimal.Decimal("1.50"), None), ("3", " ", None, 0, 7, "", None, None, (None, ["x"]))]
    path = str(tmp_path / "jobs.json")
    json_export.export_json(spark.createDataFrame(rows, JOBS).repartition(1), path, single=single)
    got = json.loads(array_of(path))
    assert [x["salary_display"] for x in got] == ["от 5 RUB", "Не указана", "до 7 RUB"] and list(got[0]) == [*[f.split()[0] for f in "id title skills salary_from salary_to salary_currency published_at price meta".split()], "salary_display"]
    plain = [{k: v for k, v in x.items()} for x in got]
    assert array_of(path).decode() == json.dumps(plain, ensure_ascii=False, indent=2)
    json_export.export_json(spark.createDataFrame(rows, JOBS).where("false"), path, single=single)
    assert array_of(path) == b"[]"
    with pytest.raises(Exception, match="there already"):
        json_export.export_json(spark.createDataFrame(rows, JOBS), path, overwrite=False, single=single)


def test_a_million_rows(spark, tmp_path):
    path = str(tmp_path / "all")
    df = spark.range(1_000_000).select("id", F.concat(F.lit("Stelle ü "), "id").alias("title"))
    json_export.export_json(df, path)
    want = "[\n" + ",\n".join(f'  {{\n    "id": {k},\n    "title": "Stelle ü {k}"\n  }}' for k in range(1_000_000)) + "\n]"
    assert array_of(path) == want.encode() and len(os.listdir(path)) > 3


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out" / "jobs.json")
    df = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        json_export.export_json(df, path)
    assert not os.path.exists(path) and not [n for n in (os.listdir(tmp_path / "out") if (tmp_path / "out").exists() else [])]


def test_rows_of_a_batch_are_written_by_the_column():
    """as one row after the other would be."""
    import datetime
    import json

    import pyarrow as pa

    table = {"a{b}": [1, None, -3], 't"': ["x", None, 'ü"\\\n\u2028{}'], "f": [0.5, None, 1e300], "d": [datetime.date(2024, 1, 2), None, None], "l": [[1, 2], [], None], "b": [True, False, None]}
    batch = pa.RecordBatch.from_pydict(table)
    names = [json.dumps(n, ensure_ascii=False) for n in table]
    assert json_export.rows_text(batch) == ",\n".join(json_export.row_text(names, r) for r in zip(*table.values(), strict=True))
