"""Generators over request tables, and checksums of files read in parts."""

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.operators.laterals import generate_rows
from plumbline.session import fresh_path
from plumbline.sources import writers as W


def doubling():
    def doubled(wanted):
        return {"twice": pc.multiply(wanted["row_no"], 2).combine_chunks(), "label": pc.cast(wanted["k"], pa.string()).combine_chunks()}

    doubled.__module__ = "__main__"  # tasks cannot import the tests
    return doubled


def asked(spark, pairs):
    return spark.createDataFrame(pairs, "k long, rows long")


@pytest.mark.parametrize("slice_rows,partitions", [(1, 3), (2, 1), (1 << 16, 4)])
def test_rows_of_requests(spark, slice_rows, partitions):
    """Slices and partitions change nothing; no number, none and a negative one make nothing; equal requests each get theirs."""
    found = generate_rows(asked(spark, [(1, 3), (2, 0), (3, None), (4, -5), (None, 2), (1, 3)]), doubling(), "twice long, label string", slice_rows=slice_rows, partitions=partitions)
    want = 2 * [(1, 3, i, 2 * i, "1", None) for i in range(3)] + [(None, 2, i, 2 * i, None, None) for i in range(2)]
    assert sorted(rows(found), key=str) == sorted(want, key=str)


def test_one_huge_request_is_many_tasks(spark):
    found = generate_rows(asked(spark, [(7, 1_000_000), (8, 1)]), doubling(), "twice long, label string", slice_rows=10_000, partitions=8)
    counts = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) >= 7 and max(r["count"] for r in counts) < 500_000
    total = found.agg(F.count_distinct("k", "row_no"), F.max("twice")).first()
    assert tuple(total) == (1_000_001, 1_999_998)


def test_cuts_of_more_slices_than_one_row_stands_for(spark):
    found = generate_rows(asked(spark, [(1, 10_001)]), doubling(), "twice long, label string", slice_rows=1)
    assert tuple(found.agg(F.count("*"), F.count_distinct("row_no"), F.max("row_no")).first()) == (10_001, 10_001, 10_000)


def test_broken_and_clashing_requests(spark):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 2}}}
    found = generate_rows(asked(spark, [(1, 2), (2, 1)]), doubling(), "twice long, label string", schema=schema)
    made = {r["k"]: r for r in found.collect()}
    assert len(made) == 2 and made[1]["error"] and made[1]["twice"] is None and made[2]["error"] is None and made[2]["twice"] == 0
    assert rows(generate_rows(asked(spark, []), doubling(), "twice long, label string", schema=schema)) == []
    for name in ("twice", "Row_No", "error"):
        with pytest.raises(ValueError):
            generate_rows(asked(spark, []).withColumn(name, F.lit(1)), doubling(), "twice long, label string")


def test_generator_of_the_wrong_length_raises(spark):
    short = lambda wanted: {"twice": pa.array([1]), "label": pa.array(["a"])}
    with pytest.raises(Exception, match="one entry for each wanted row"):
        generate_rows(asked(spark, [(1, 2)]), short, "twice long, label string").collect()


@pytest.mark.parametrize("cell_bytes", [0, 5000, 1 << 20])
def test_checksums_of_cells_and_parts(spark, cell_bytes, monkeypatch):
    path = fresh_path(spark, "hashed files é")
    W.write_table(spark.range(3000).repartitionById(3, F.when(F.col("id") < 2900, 0).otherwise(1)), path, W.ExportConfig("jsonl", compression="gzip"))
    found = W.file_checksums(spark, path, cell_bytes=cell_bytes).collect()
    assert len(found) == 2
    for r in found:
        with open(f"{path}/{r['file']}", "rb") as f:
            body = f.read()
        assert (r["bytes"], r["md5"], r["sha256"]) == (len(body), hashlib.md5(body).hexdigest(), hashlib.sha256(body).hexdigest())
