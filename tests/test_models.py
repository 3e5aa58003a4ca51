"""Providers that fail, pass and answer nothing."""

from pyspark.sql import functions as F

from jobstrata.operators import models


def make():
    def flaky():  # within a function, so that it travels by value
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "refused":
                raise ValueError("invalid key")
            if prompt == "down" or prompt == "busy" and seen[prompt] < 3:
                raise RuntimeError("Provider returned error: overloaded")
            return "" if prompt == "empty" and seen[prompt] < 2 else f"said {prompt}"

        return call

    return flaky


flaky = make()


def test_outcomes(spark):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["plain", "busy", "down", "refused", "empty", None])], "id long, prompt string").coalesce(1)
    got = models.answered(rows, F.col("prompt"), flaky, sleep=lambda s: None).orderBy("id").collect()
    assert [(r.answer, r.attempts, r.error) for r in got] == [
        ("said plain", 1, None), ("said busy", 3, None), (None, 3, "Provider returned error: overloaded"), (None, 1, "invalid key"), ("", 1, None), (None, 0, None),
    ]
    again = models.answered(rows.where("id = 4"), F.col("prompt"), flaky, empty=lambda a: not a, sleep=lambda s: None).first()
    assert (again.answer, again.attempts) == ("said empty", 2)


def test_waits():
    slept = []
    models.ask(flaky(), "down", 6, None, slept.append)
    assert slept == [2, 4, 8, 16, 16]
