"""The streamed pool equals the batch one however the finds are split, restarts included."""

import random

import pytest

from corpusmill.streaming.pool import pooled, run_to_end

KIND = "key string, doc_id long, iteration long, ord long"


@pytest.mark.parametrize("parts", [[300], [1, 2, 297], [100, 100, 100]])
def test_any_split(spark, tmp_path, parts):
    rng = random.Random(len(parts))
    rows = [(rng.choice(["a", "b", "c", None, *map(str, range(40))]), k, rng.randrange(1, 6), rng.randrange(50)) for k in range(300)]
    rng.shuffle(rows)
    want = {tuple(map(str, r)) for r in pooled(spark.createDataFrame(rows, KIND)).collect()}
    at = 0
    for k, n in enumerate(parts):  # each part comes after the last run ended
        spark.createDataFrame(rows[at:at + n], KIND).coalesce(1).write.parquet(str(tmp_path / f"finds/part={k}"))
        at += n
        stream = spark.readStream.schema(KIND + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "finds")).drop("part")
        got = run_to_end(stream, str(tmp_path / "pool"), str(tmp_path / "checkpoint"))
    assert {tuple(map(str, r)) for r in got.select("key", "doc_id", "first_iteration", "iterations", "seen").collect()} == want
