import re

import pytest

from tallywick.sources import ingest
from tallywick.sources.split_csv import open_pattern, read_csv

PIECES = ["plain", "", '"quoted, with a separator"', '"two\nlines"', '"a ""literal"" quote"', '5" pipe', '"ends\n\nlate, ""x""\n"', "x y", '""', '"' + "long\n" * 400 + '"']


def written(tmp_path, rows, end="\n", name="wide.csv"):
    p = tmp_path / name
    p.write_bytes((end.join(["id,note,amount", *rows]) + end).encode())
    return str(p)


def rows_of(n):
    return [f"{i},{PIECES[(i * 7 + i // 13) % len(PIECES)]},{PIECES[(i * 3) % 9]}" for i in range(n)]


def spark_rows(spark, path, **options):
    return spark.read.options(**{"header": True, "quote": '"', "escape": '"', "multiLine": True, **options}).csv(path)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize(("line", "end"), [("a,b", False), ('"a', True), ('"a"', False), ('"a"",b', True), ('x,"y', True), ('x"y', False), ('"a"b,"', True), ("", False), ('"', True), ('""', False), ('"a,b",c', False), ('"x"y"z', False)])
def test_open_pattern(line, end):
    assert (re.search(open_pattern(","), line) is not None) == end


@pytest.mark.parametrize("n", [1, 40, 2000])
def test_many_splits_give_the_rows_of_one_reader(spark, tmp_path, small_splits, n):
    path = written(tmp_path, rows_of(n))
    got = read_csv(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark_rows(spark, path).collect()))
    if n == 2000:
        assert got.rdd.getNumPartitions() > 20


def test_records_longer_than_splits(spark, tmp_path, small_splits):
    rows = ['1,"' + "line of a note\n" * 1500 + '",3', "2,b,4", '3,"' + "x\n" * 9000 + '""","7\n"', "4,,"]
    path = written(tmp_path, rows)
    got = read_csv(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark_rows(spark, path).collect()))


def test_plain_files_take_the_line_reader(spark, tmp_path, small_splits):
    path = written(tmp_path, [f"{i},\"quoted, but whole\",{i}" for i in range(2000)], end="\r\n")
    got = read_csv(spark, path)
    assert "MapInArrow" not in got._jdf.queryExecution().toString() and got.rdd.getNumPartitions() > 5
    assert sorted(map(str, got.collect())) == sorted(map(str, spark_rows(spark, path).collect()))


def test_several_files_other_options_and_empty_ones(spark, tmp_path, small_splits):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        written(folder, rows_of(300 * k), name=f"part{k}.csv")
    assert sorted(map(str, read_csv(spark, str(folder)).collect())) == sorted(map(str, spark_rows(spark, str(folder)).collect()))
    semi = tmp_path / "semi.csv"
    semi.write_text('id;note\n1;"a\nb"\n2;c;d\n3\n\n4;"e;f"\n')
    assert sorted(map(str, read_csv(spark, str(semi), {"sep": ";"}).collect())) == sorted(map(str, spark_rows(spark, str(semi), sep=";").collect()))
    assert read_csv(spark, str(semi), {"sep": ";", "header": False}).count() == 5
    assert read_csv(spark, written(tmp_path, [], name="head.csv")).count() == 0


def test_orders_with_notes_over_lines(spark, tmp_path, small_splits):
    p = tmp_path / "orders.csv"
    p.write_text("customer_id,note,order_date,amount\n" + "".join(f'u{i % 7},"left at\ndoor {i}, ""back""",2021-04-{i % 28 + 1:02d},{i}.5\n' for i in range(1, 900)))
    got = ingest.load_orders(spark, str(p))
    assert (got.rows_in, got.rows_out, got.n_customers) == (899, 899, 7)
    assert got.orders.agg({"amount": "sum"}).first()[0] == sum(i + 0.5 for i in range(1, 900))
