"""CSV cut out of file splits against the reader that takes a file in one piece."""

import random

import pytest

from quill.sources import csv_splits as cs
from quill.sources import readers as rd

SCHEMA = "a string, b string, c int"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def quoted(v):
    return '"' + v.replace('"', '""') + '"'


def make(rng, n):
    bits = ["x", "yy", ",", "\n", '"', '""', "\n\n", " ", "é漢", "a,b\n\"c\"\n", "long " * 9]
    rows = []
    for i in range(n):
        a, b = ("".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(2))
        rows.append(f"{quoted(a)},{quoted(b) if rng.random() < .7 else 'plain' + str(i)},{i}")
    return rows


def whole_file(spark, path, **opts):
    return spark.read.options(header=True, multiLine=True, escape='"', **opts).schema(SCHEMA).csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_whole_file_reader(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    for k in range(3):
        lines = ["a,b,c", *make(rng, 40)]
        if k == 1:
            lines.insert(5, "")
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + "\n" * (k % 2), newline="")
    want = rows(whole_file(spark, str(tmp_path)))
    df = rd.read_csv(spark, str(tmp_path), schema=SCHEMA)
    assert rows(df) == want and len(want) == 120
    assert cs.lines_of(spark, str(tmp_path), "utf-8", {}).rdd.getNumPartitions() > 20


def test_joined_when_there_are_too_many_splits_to_send(spark, small_splits, tmp_path, monkeypatch):
    (tmp_path / "f.csv").write_text("\n".join(["a,b,c", *make(random.Random(9), 60)]))
    want = rows(whole_file(spark, str(tmp_path)))
    monkeypatch.setattr(cs, "BROADCAST_SPLITS", 0)
    assert rows(rd.read_csv(spark, str(tmp_path), schema=SCHEMA)) == want


def test_one_record_over_many_splits(spark, small_splits, tmp_path):
    text = "\n".join(f'line {i} with "quotes", commas' for i in range(300))
    (tmp_path / "f.csv").write_text(f"a,b,c\n{quoted(text)},x,1\ny,{quoted(text)},2\n")
    got = rows(rd.read_csv(spark, str(tmp_path), schema=SCHEMA))
    assert got == sorted([(text, "x", 1), ("y", text, 2)], key=str)


def test_quotes_inside_unquoted_fields_are_characters(spark, small_splits, tmp_path):
    lines = ["a,b,c", 'a 5" pipe,x,1', 'say "hi, there",2', 'p"q"r,"two\nlines",3', *make(random.Random(1), 30)]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    assert rows(rd.read_csv(spark, str(tmp_path), schema=SCHEMA)) == rows(whole_file(spark, str(tmp_path)))


def test_names_from_the_header_and_provenance(spark, tmp_path):
    (tmp_path / "f.csv").write_text('﻿"first\nname",,x,X\r\n1,2,3,4\r\n"5\r\n6",7,,"8"\r\n')
    df = rd.read_csv(spark, str(tmp_path), provenance=True)
    assert df.columns == ["first\nname", "_c1", "x2", "X3", "_source_file"]
    assert rows(df.drop("_source_file")) == sorted([("1", "2", "3", "4"), ("5\r\n6", "7", None, "8")], key=str)
    assert df.first()._source_file.endswith("f.csv")
    assert rd.read_csv(spark, str(tmp_path), header=False).columns == ["_c0", "_c1", "_c2", "_c3"]


def test_policies(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b,c\nx,y,1\nx,y,no number\nx,y,3\n")
    path = str(tmp_path / "f.csv")
    assert rows(rd.read_csv(spark, path, schema=SCHEMA, errors="skip")) == [("x", "y", 1), ("x", "y", 3)]
    assert rd.read_csv(spark, path, schema=SCHEMA, errors="log").count() == 3
    bad = rd.read_csv(spark, path, schema=f"{SCHEMA}, _corrupt_record string", errors="log").collect()
    assert [r._corrupt_record for r in bad if r._corrupt_record] == ["x,y,no number"]
    with pytest.raises(Exception, match="(?i)malformed"):
        rd.read_csv(spark, path, schema=SCHEMA, errors="raise").collect()


def test_empty_files_and_options(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert rd.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "semi.txt").write_text("a;b;c\n'1;2';;NA\n")
    got = rd.read_csv(spark, str(tmp_path / "semi.txt"), sep=";", quote="'", nullValue="NA", schema="a string, b string, c string")
    assert rows(got) == [("1;2", None, None)]


@pytest.mark.parametrize("line", [
    "a,b", '"a",b', '"a', 'a,"b""', 'a",b', 'a","b', 'x"y,"z"', '""', '"', '","', "", '"a"b"c,"', '""","', ',,"'])
def test_line_rule(line):
    """What follows from reading the line character by character, from either state."""
    def slow(text, inside):
        i, begin = 0, not inside
        while True:
            if begin and text[i:i + 1] == '"':
                inside, i = True, i + 1
            begin = False
            if inside:
                while i < len(text):
                    if text[i] == '"':
                        if text[i + 1:i + 2] == '"':
                            i += 2
                            continue
                        inside, i = False, i + 1
                        break
                    i += 1
                if inside:
                    return True
            i = text.find(",", i)
            if i < 0:
                return False
            i, begin = i + 1, True
    assert cs.LineRule(",", '"').after(line) == (slow(line, False), slow(line, True))
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice('",ab ') for _ in range(rng.randint(0, 9)))
        assert cs.LineRule(",", '"').after(t) == (slow(t, False), slow(t, True)), t
