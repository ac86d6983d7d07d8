from __future__ import annotations

import glob
import os
import shutil

from kinpanel.streaming.arrivals import append_to_panel, arriving_register, read_appended


def put(spark, folder, name, rows, schema="PNR string, PERINDKIALT_13 double, BESKST13 tinyint"):
    tmp = f"{folder}/tmp-{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(tmp)
    os.makedirs(f"{folder}/in", exist_ok=True)
    shutil.copy(glob.glob(f"{tmp}/*.parquet")[0], f"{folder}/in/{name}")


def run(spark, folder):
    rows = arriving_register(spark, "ind", f"{folder}/in")
    query = append_to_panel(rows, f"{folder}/panel", f"{folder}/checkpoint")
    assert query.awaitTermination(120)
    assert query.exception() is None
    return read_appended(spark, f"{folder}/panel")


def test_files_are_appended_once(spark, folder):
    put(spark, folder, "ind2001.parquet", [("1", 1.0, 1), ("2", 2.0, 2)])
    put(spark, folder, "ind2002.parquet", [("1", 3.0, 1)])
    assert run(spark, folder).count() == 3
    assert run(spark, folder).count() == 3
    put(spark, folder, "ind2003.parquet", [("1", 9.0)], "PNR string, PERINDKIALT_13 double")
    got = run(spark, folder)
    assert {(r["PNR"], r["year"], r["PERINDKIALT_13"], r["BESKST13"]) for r in got.collect()} == {
        ("1", 2001, 1.0, 1), ("2", 2001, 2.0, 2), ("1", 2002, 3.0, 1), ("1", 2003, 9.0, None),
    }
    assert "VERSION" not in got.columns
