"""Parallel CSV records against Spark's reader of whole files, with edges of byte ranges inside quotes."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quotemill.sources import csv_files, quoted_lines
from quotemill.sources.quoted_lines import csv_records, ends_inside, range_states

COLUMNS = ["date", "title", "body", "summary"]


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes."""
    sizes = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def text_of(rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=quoting).writerows([COLUMNS, *rows])
    return out.getvalue()


def random_rows(n, seed):
    r = random.Random(seed)
    bits = ["word", " ", ",", "\n", '"', '""', '",', '"\n"', "\n\n", "'", "é", "a,b", '\n"x",', "long " * 30]
    field = lambda: "".join(r.choice(bits) for _ in range(r.choice([0, 1, 3, 12])))
    return [[f"2020-01-{i % 28 + 1:02d}", field() + "t", field() + "b", field() + "s"] for i in range(n)]


def whole_file(spark, path, header=True):
    reader = spark.read.schema(", ".join(f"{c} string" for c in [*COLUMNS, csv_files.CORRUPT_COLUMN]))
    reader = reader.options(header=header, quote='"', escape='"', mode="PERMISSIVE", multiLine=True)
    return reader.option("columnNameOfCorruptRecord", csv_files.CORRUPT_COLUMN).csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_reader_of_whole_files(spark, tmp_path, small_ranges, seed, quoting):
    written = random_rows(300, seed)
    path = tmp_path / "news.csv"
    path.write_text(text_of(written, quoting=quoting), newline="")
    records = csv_records(spark, str(path))
    assert records.select("start").distinct().count() > 50
    found = csv_files.scan_news_csv(spark, str(path), COLUMNS)
    assert rows(found) == rows(whole_file(spark, str(path)))
    assert sorted(map(tuple, written)) == sorted(tuple(r)[:4] for r in found.collect())


def test_several_files_without_headers(spark, tmp_path, small_ranges):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(text_of(random_rows(40 * k + 1, k)).split("\n", 1)[1], newline="")
    found = csv_files.scan_news_csv(spark, str(tmp_path), COLUMNS, header=False)
    assert rows(found) == rows(whole_file(spark, str(tmp_path), header=False))
    assert found.count() == 1 + 41 + 81


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    body = "\n".join(f'line {i} of a long body, with "quotes"' for i in range(400))
    written = [["a", "b", "c", "d"], ["e", body, "g", ""], ["h", "", "", "k"]]
    path = tmp_path / "news.csv"
    path.write_text(text_of(written), newline="")
    found = csv_files.scan_news_csv(spark, str(path), COLUMNS).collect()
    assert sorted(r.title or "" for r in found) == sorted(["", "b", body])


def test_as_many_tasks_as_ranges(spark, tmp_path, small_ranges):
    path = tmp_path / "news.csv"
    path.write_text(text_of(random_rows(200, 5)), newline="")
    size = path.stat().st_size
    lines = quoted_lines._lines(spark, [str(path)])
    assert lines.rdd.getNumPartitions() >= size // 300
    assert lines.select("start").distinct().count() >= size // 300 // 2  # long lines begin in one range


def test_line_ends_and_blank_lines(spark, tmp_path):
    path = tmp_path / "news.csv"
    path.write_bytes(b'\n\ndate,title\r\na,"x\r\n\r\ny"\r\n\r\n\nb,z\r\n')
    found = csv_files.scan_news_csv(spark, str(path), ["date", "title"]).collect()
    assert sorted((r.date, r.title) for r in found) == [("a", "x\r\n\r\ny"), ("b", "z")]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert csv_records(spark, str(empty)).count() == 0


def test_quotes_inside_plain_fields_are_characters(spark, tmp_path, small_ranges):
    lines = ["date,title", 'a,5" disk', 'b,it is 6"', *[f"c{i},d" for i in range(100)], 'e,"two\nlines"', "f,g"]
    path = tmp_path / "news.csv"
    path.write_text("\n".join(lines), newline="")
    found = {r.date: r.title for r in csv_files.scan_news_csv(spark, str(path), ["date", "title"]).collect()}
    assert len(found) == 104 and found["a"] == '5" disk' and found["b"] == 'it is 6"' and found["e"] == "two\nlines"


def test_lines_from_either_state():
    for line, closed, opened in [
        ("a,b", False, True), ('a,"b', True, False), ('b",c', False, False), ('"a""",b', False, False),
        ('"a"",b', True, False), ('a"b,c"', False, False), ('a,"b" c,d', False, True), ('""', False, True), ('"', True, False),
        ('x","', True, True), ("", False, True), ('","', True, True), (',"","",', False, True),
    ]:
        assert (ends_inside(line, False), ends_inside(line, True)) == (closed, opened), line


def test_chained_maps(spark):
    r = random.Random(4)
    maps = [("f", 10 * i, *r.choice([(False, True), (False, True), (True, False), (True, True), (False, False)])) for i in range(200)]
    maps += [("g", 0, True, False), ("g", 5, True, False), ("h", 0, True, True)]
    df = spark.createDataFrame(maps, "file string, start long, closed boolean, open boolean").orderBy(F.rand(1))
    found = {(x.file, x.start): x.inside for x in range_states(df).collect()}
    state = {}
    for file, start, closed, opened in maps:
        assert found[file, start] == state.get(file, False)
        state[file] = opened if state.get(file, False) else closed
    assert len(found) == len(maps)
