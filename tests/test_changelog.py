"""Change logs folded at once, step by step, and as streams."""

import datetime as dt
import random

from pyspark.sql import functions as F

from grainmill.operators.ids import ORIGIN_ID, ROW_ID
from grainmill.plans import changelog
from grainmill.sources.versions import Versions
from grainmill.streaming import compaction

TABLE = f"{ROW_ID} long, {ORIGIN_ID} string, name string, n int, row string, cells int"


def table(spark, n=20):
    return spark.createDataFrame([(100 * i, f"o{i}", f"name{i}", i, "r", 1) for i in range(1, n)], TABLE)


def entries(seed, n=120):
    rng = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        kind = rng.choice(["cell_edit"] * 5 + [None, "insert_row", "delete_row"])
        rows = [rng.choice([100, 200, 300, 350, 350, 900, 5000])] if kind != "delete_row" else [rng.choice([100, 350, 400]), rng.choice([200, 500, 350])]
        edit = kind in ("cell_edit", None)
        out.append((seq, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seq // 3), kind, rows, rng.choice(["name", "n", "gone"]) if edit else None, rng.choice(["7", "x", None, ""]) if edit else None, f"new{seq}" if kind == "insert_row" else None))
    return out


def plain(rows, log):
    state = {r[0]: dict(zip([ROW_ID, ORIGIN_ID, "name", "n", "row", "cells"], r, strict=True)) for r in rows}
    for _, _, kind, ids, column, value, origin in sorted(log, key=lambda e: (e[1], e[0])):
        for i in ids:
            if kind == "insert_row":
                state[i] = {ROW_ID: i, ORIGIN_ID: origin, "name": None, "n": None, "row": None, "cells": None}
            elif kind == "delete_row":
                state.pop(i, None)
            elif i in state and column in ("name", "n"):
                state[i][column] = value if column == "name" else int(value) if value == "7" else None
    return sorted((tuple(r.values()) for r in state.values()), key=str)


def log_of(spark, rows):
    return spark.createDataFrame(rows, changelog.LOG).withColumn("kind", F.coalesce("kind", F.lit("cell_edit"))).repartition(3)


def seen(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fold_like_plain_python(spark):
    rows = [tuple(r) for r in table(spark).collect()]
    for seed in range(3):
        log = entries(seed)
        assert seen(changelog.fold(table(spark), log_of(spark, log))) == plain(rows, log)
    assert seen(changelog.fold(table(spark), log_of(spark, []))) == sorted(rows, key=str)
    assert changelog.fold(table(spark).limit(0), log_of(spark, entries(1))).dtypes == table(spark).dtypes


def test_compaction_is_harmless_when_run_again(spark, tmp_path):
    rows, log = [tuple(r) for r in table(spark).collect()], entries(5)
    t = changelog.EditedTable(spark, f"{tmp_path}/t")
    t.create(table(spark))
    assert t.compact(force=True) == 0 and seen(t.current()) == sorted(rows, key=str)
    t.append(log_of(spark, log[:50]))
    assert t.compact() == 0  # fewer than are worth it
    assert seen(t.current()) == plain(rows, log[:50])
    assert t.compact(force=True) == 50 and t.compact(force=True) == 0 and t.states.numbers() == [0, 50]
    t.append(log_of(spark, log[50:]))
    assert t.compact(enough=70) == 70 and t.states.numbers() == [50, 120]
    assert seen(t.current()) == plain(rows, log)
    # a state that was not finished is none
    t.states._fs.delete(t.states._at(f"{t.states.folder(120)}/_SUCCESS"), False)
    assert t.states.latest() == 50 and seen(t.current()) == plain(rows, log)
    assert t.compact(force=True) == 70 and seen(t.current()) == plain(rows, log)


def test_stream_batches_and_a_replayed_one(spark, tmp_path):
    rows, log = [tuple(r) for r in table(spark).collect()], entries(8)
    states = Versions(spark, f"{tmp_path}/states")
    states.write(table(spark), 0)
    for k in range(3):
        log_of(spark, log[k * 40 : k * 40 + 40]).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
        source = spark.readStream.schema(changelog.LOG).json(f"{tmp_path}/log")
        compaction.fold_stream(source, states, f"{tmp_path}/checkpoint").awaitTermination()
        assert seen(states.read(states.latest())) == plain(rows, log[: k * 40 + 40])
    top = states.latest()
    assert compaction.fold_batch(states, log_of(spark, log[80:]), top - 1) is False
    assert states.latest() == top and seen(states.read(top)) == plain(rows, log)
