import datetime
import random

import pytest

from evokeline.operators import signal
from evokeline.streaming import blinks
from evokeline.streaming.streams import finished

START = datetime.datetime(2024, 1, 1)
SCHEMA = "subject string, ts timestamp, sample long, value double"


def recordings():
    """Three subjects' samples with bursts over the threshold; a second is ten samples."""
    draw, rows = random.Random(4), []
    for s in ("a", "b", "c"):
        level = 0.0
        for k in range(600):
            level = draw.uniform(6, 9) if draw.random() < (0.08 if s != "c" else 0.004) else level * 0.5
            rows.append((s, START + datetime.timedelta(milliseconds=100 * k), k, round(level + draw.gauss(0, 0.3), 6)))
    return rows


def streamed(spark, folder, files, **options):
    """What the stream gives for some files, one micro-batch each."""
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n:03}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    return finished(blinks.stream_blinks(source, 5.0, 4, **options), str(folder))


def batch(spark, rows, least):
    df = spark.createDataFrame([(s, k, "eog", v) for s, _, k, v in rows], "subject string, sample long, channel string, x double")
    return sorted((r["subject"], r["blink"], r["sample"], r["peak"]) for r in signal.blink_detect(df, "eog", 5.0, 4, least).collect())


@pytest.mark.parametrize("least", [1, 6])
def test_stream_equals_batch(spark, tmp_path, least):
    """Rows come shuffled over seven micro-batches, never later than the watermark's delay; a last row per subject lets all blinks close."""
    rows, draw = recordings(), random.Random(5)
    by_time = sorted(rows, key=lambda r: (r[1] + datetime.timedelta(seconds=draw.uniform(0, 8)), draw.random()))
    files = [by_time[len(by_time) * k // 7 : len(by_time) * (k + 1) // 7] for k in range(7)]
    end = [(s, START + datetime.timedelta(seconds=200), 2000, 0.0) for s in "abc"]
    later = [("z", START + datetime.timedelta(seconds=900 + k), 9000 + k, 0.0) for k in range(2)]
    got = streamed(spark, tmp_path, [*files, end, later[:1], later[1:]], min_count=least, watermark="20 seconds")
    want = batch(spark, rows, least)
    assert sorted((r["subject"], r["blink"], r["sample"], r["peak"]) for r in got.collect()) == want
    assert {r[0] for r in want} == ({"a", "b", "c"} if least == 1 else {"a", "b"}) and len(want) > 20


def test_late_rows_go(spark, tmp_path):
    at = lambda k: START + datetime.timedelta(seconds=k)
    first = [("a", at(k), k, 9.0 if k == 5 else 0.0) for k in range(12)]
    jump, late = [("a", at(100), 100, 0.0)], [("a", at(7), 7, 99.0), ("a", at(104), 104, 0.0)]
    got = streamed(spark, tmp_path, [first, jump, [("a", at(103), 103, 0.0)], late, [("a", at(300), 300, 0.0)], [("a", at(400), 400, 0.0)]], watermark="10 seconds")
    assert [tuple(r) for r in got.collect()] == [("a", 1, 5, 9.0)]


def test_no_rows(spark, tmp_path):
    assert streamed(spark, tmp_path, [[]]).count() == 0


def test_past_goes_through_text():
    own = blinks.Blinks()
    own.waiting = [(k, k, float(v)) for k, v in enumerate([0, 7, 0, 8, 0, 0, 0, 0, 0, 0, 6, 0])]
    closed = []
    for mark in (0, 3, 4, 11):
        own = blinks.Blinks(own.text())
        closed += own.passed(mark, 5.0, 4)
    assert closed == [[1, 3, 8.0]] and own.open == (10, 6.0)
