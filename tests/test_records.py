"""Records of quoted lines cut in parallel, equal to the one-split read; malformed records set aside."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlor.sources import readers, records

SCHEMA = "n BIGINT, text STRING, tail STRING"


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


def write(path, rows, end="\n", header=True):
    path.mkdir()
    for k in range(2):
        lines = (["n,text,tail"] if header else []) + [f"{n},{quoted(text)},{tail}" for n, text, tail in rows[k::2]]
        (path / f"part-{k}.csv").write_bytes(end.join([*lines, ""]).encode())
    return str(path)


def texts(seed, count=200):
    order = np.random.default_rng(seed)
    parts = ["word", "\n", '"', '""', ",", "\n\n", "é", "\\", " ", '"\n"', "long " * 30, "\r\n"]
    return [(i, "".join(order.choice(parts, order.integers(1, 12))) + ".", "end") for i in range(count)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_parallel_records_equal_the_rows_written(spark, tmp_path, small_ranges, end, seed):
    rows = texts(seed)
    path = write(tmp_path / "csv", rows, end)
    found = readers.read_tweets(spark, path, SCHEMA, multi_line=True)
    assert records._lines(spark, path).rdd.getNumPartitions() > 20
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    one = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if end == "\n":
        # The one-split reader turns line ends inside quotes into plain line feeds.
        plain = lambda r: (r[0], r[1].replace("\r\n", "\n"), r[2])
        assert sorted(map(plain, map(tuple, one.collect()))) == sorted(map(plain, rows))


def test_one_record_over_many_ranges_and_an_open_quote(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}" for i in range(400))
    rows = [(1, "a", "x"), (2, long, "x"), (3, "b\nc", "x"), (4, long, "y")]
    path = write(tmp_path / "csv", rows)
    assert sorted(map(tuple, readers.read_tweets(spark, path, SCHEMA, multi_line=True).collect())) == rows
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "a.csv").write_text('1,x,y\n2,"never closed,\n' + "3,z,z\n" * 100)
    found = records.quoted_records(spark, str(tmp_path / "open")).orderBy("range", "line").collect()
    assert [r.record[:9] for r in found] == ["1,x,y", '2,"never ']


def test_malformed_records_are_set_aside_with_their_place(spark, tmp_path, small_ranges):
    (tmp_path / "csv").mkdir()
    lines = [f'{i},"text {i}",t' if i % 10 else f"x{i},only two" for i in range(60)]
    (tmp_path / "csv" / "a.csv").write_text("n,text,tail\n" + "\n".join(lines) + "\n\n")
    good, bad = readers.read_checked(spark, str(tmp_path / "csv"), SCHEMA, "csv")
    assert sorted(r.n for r in good.collect()) == [i for i in range(60) if i % 10]
    faults = bad.orderBy("range", "line").collect()
    assert [r.record for r in faults] == [f"x{i},only two" for i in range(0, 60, 10)]
    assert all(r.file.endswith("a.csv") for r in faults) and len({(r.range, r.line) for r in faults}) == 6
    assert len({r.range for r in faults}) > 1
    with pytest.raises(Exception, match="malformed CSV record"):
        readers.read_tweets(spark, str(tmp_path / "csv"), SCHEMA, multi_line=True).collect()


def test_json_lines_are_checked_too(spark, tmp_path, small_ranges):
    (tmp_path / "j").mkdir()
    lines = ['{"n": %d, "text": "t\\n%d", "tail": null}' % (i, i) if i % 9 else f"{{broken {i}" for i in range(80)]
    (tmp_path / "j" / "a.jsonl").write_text("\n".join(lines))
    good, bad = readers.read_checked(spark, str(tmp_path / "j"), SCHEMA, "jsonl")
    assert sorted(map(tuple, good.collect())) == [(i, f"t\n{i}", None) for i in range(80) if i % 9]
    assert sorted(r.record for r in bad.collect()) == sorted(f"{{broken {i}" for i in range(0, 80, 9))


def test_headers_and_empty_files(spark, tmp_path):
    path = write(tmp_path / "csv", [(1, "a", "b")])
    (tmp_path / "csv" / "empty.csv").write_text("")
    assert readers.read_tweets(spark, path, SCHEMA, multi_line=True).count() == 1
    other = "k BIGINT, text STRING, tail STRING"
    with pytest.raises(Exception, match="unexpected CSV header"):
        readers.read_tweets(spark, path, other, multi_line=True).collect()
    assert records.csv_records(spark, path, SCHEMA, header=False).where(F.col("bad")).count() == 2  # a header in each file
