"""The parallel CSV reader against Spark's own reader of whole files."""

import csv
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from ticketlens.sources import csv_records as R
from ticketlens.sources import io


def one_task(spark, path):
    """The rows by Spark's reader, which takes a file in one task and turns
    line breaks inside quotes into plain ones (ours keeps them)."""
    options = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, R.CORRUPT]])
    return spark.read.options(**options).schema(schema).option("columnNameOfCorruptRecord", R.CORRUPT).csv(path)


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same(spark, path):
    key = lambda r: tuple((x is None, x or "") for x in r)
    rows = [tuple(r) for r in R.read(spark, path).collect()]
    got, want = (sorted((tuple(x and x.replace("\r\n", "\n") for x in r) for r in each), key=key) for each in (rows, one_task(spark, path).collect()))
    assert got == want
    return rows


def test_line_breaks_in_quotes_over_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    path = str(tmp_path / "t.csv")
    values = []
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Subject", "Description", "Extra"])
        for k in range(400):
            text = rng.choice([f"plain {k}", f'says "x{k}", twice', "a\nb\r\nc", "\n\n" * rng.randrange(1, 4), '"' * rng.randrange(4), "line " * 90 + "\n" + "more " * 90 if k % 40 == 0 else "", ","])
            values.append([f"s{k}", text, f"e{k}\n" if k % 7 == 0 else "x"])
            w.writerow(values[-1])
    rows = same(spark, path)
    assert sorted((r[0], r[1] or "", r[2]) for r in rows) == sorted(map(tuple, values))
    assert R.lines(spark, path).rdd.getNumPartitions() > 20  # one file, many tasks
    states = R.first_states(R.range_states(R.lines(spark, path))).collect()
    assert 3 < sum(r.begins_inside for r in states) < len(states)


def test_odd_files(spark, tmp_path, small_ranges):
    def written(name, text):
        (tmp_path / name).write_bytes(text.encode())
        return str(tmp_path / name)

    same(spark, written("stray.csv", 'a,b\n5" disk,x\ny,6"\n"q"tail,z\n' + "k,v\n" * 200))
    same(spark, written("crlf.csv", "a,b\r\n1,2\r\n\r\n\"x\r\ny\",3\r\n" * 30))
    corrupt = same(spark, written("corrupt.csv", "a,b\n1,2\n1,2,3\n4\n" + "5,6\n" * 150))
    assert sorted(r[2] for r in corrupt if r[2]) == ["1,2,3", "4"]
    assert R.read(spark, written("open.csv", 'a,b\n1,2\n3,"never\nclosed\n')).count() == 2
    assert R.read(spark, written("bom.csv", "﻿a,b\n1,2\n")).columns == ["a", "b", R.CORRUPT]
    assert R.read(spark, written("names.csv", "\n\na,,a\n1,2,3\n")).columns == ["a0", "_c1", "a2", R.CORRUPT]
    assert R.read(spark, written("none.csv", "a,b\n")).collect() == []
    with pytest.raises(ValueError):
        R.read(spark, written("empty.csv", ""))
    (tmp_path / "d").mkdir()
    written("d/1.csv", "a,b\n1,2\n" + 'x,"y\nz"\n' * 100)
    written("d/2.csv", "a,b\n3,4\n" + 'u,"v\n\nw"\n' * 100)
    same(spark, str(tmp_path / "d"))
    written("d/3.csv", "b,a\n5,6\n")
    with pytest.raises(ValueError):
        R.read(spark, str(tmp_path / "d"))


def test_batch_reports_corrupt_lines(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Subject,Description\ns1,d1\ns2,d2,extra\n"s3\n",d3\nonly\n')
    path = str(tmp_path / "b.csv")
    assert sorted(tuple(r) for r in io.read_batch_csv(spark, path).collect()) == [("s1", "d1"), ("s3\n", "d3")]
    assert sorted(tuple(r) for r in io.corrupt_lines(spark, path).collect()) == [("only", "line_corrupt"), ("s2,d2,extra", "line_corrupt")]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from('ab",\n'), max_size=60))
def test_states_equal_a_plain_automaton(text):
    """Line by line from either state, as one run over the characters."""
    for inside in (False, True):
        state = "quoted" if inside else "start"
        per_line, k = [], 0
        while k < len(text) + 1:
            c = text[k] if k < len(text) else "\n"
            if state == "quoted":
                if c == '"':
                    if text[k + 1:k + 2] == '"':
                        k += 1
                    else:
                        state = "plain"
            elif c == "," or c == "\n":
                state = "start"
            elif c == '"' and state == "start":
                state = "quoted"
            else:
                state = "plain"
            if c == "\n":
                per_line.append(state == "quoted")
            k += 1
        got, now = [], inside
        for line in text.split("\n"):
            now = R.ends_inside(line, now)
            got.append(now)
        assert got == per_line
