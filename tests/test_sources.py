"""Archives by member, tables of pages, pages that tell how many there are."""

import json
import zipfile

from pyspark.sql import types as T

from shiftframe.sources import archives, files, html, paged

PAGE = """<p>before</p><table class="x"><thead><tr><th>Name<th>Cap &amp; hit</th><th>Name</th></tr></thead>
<tr><td rowspan=2>Ann<td>$1,000<br>a year</td><td>x</td></tr><tr><td colspan="2"> two&nbsp;cells <script>var t = "</td>";</script></td></tr>
<tr><td>outer <table><tr><td>in</td><td>ner</td></tr></table> end</td><td></td></tr></table><table></table><tr><td>stray</td></tr>"""


def test_tables_by_header():
    first, inner, empty = html.tables_of(PAGE)
    assert first == [
        {"Name": "Ann", "Cap & hit": "$1,000 a year", "Name 3": "x"},
        {"Name": "Ann", "Cap & hit": "two cells", "Name 3": "two cells"},
        {"Name": "outer end", "Cap & hit": ""},
    ]
    assert inner == [{"1": "in", "2": "ner"}] and empty == []
    assert html.tables_of("") == [] and html.tables_of("<table><tr><th>only</th></tr>") == [[]]
    assert html.tables_of("<table><td>no row tag<tr><td rowspan='x'>1</table>") == [[{"1": "no row tag"}, {"1": "1"}]]


def test_table_rows(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "no table"), (4, "<table><tr><td>a</td></tr></table>" * 3)], "page_id long, html string")
    found = sorted((r.page_id, r.table, r.row, r.cells.get("Name") or r.cells.get("1")) for r in html.table_rows(pages, "page_id").collect())
    assert found == [(1, 1, 1, "Ann"), (1, 1, 2, "Ann"), (1, 1, 3, "outer end"), (1, 2, 1, "in"), (4, 1, 1, "a"), (4, 2, 1, "a"), (4, 3, 1, "a")]


def test_each_member_is_a_partition(spark, tmp_path):
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w") as archive:
            for m in range(5):
                lines = "".join(f'{k},"x, ""{k}"""\r\n' for k in range(m * 3))
                archive.writestr(f"deep/{m}_plays.csv", "﻿id,name,more\r\n" + lines + ("7\r\n" if m == 4 else ""))
            archive.writestr("__MACOSX/deep/0_plays.csv", "junk")
            archive.writestr("deep/._0_plays.csv", "junk")
            archive.writestr("other.csv", "id\n1\n")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("id", T.LongType()), T.StructField("absent", T.DoubleType())])
    for path in (f"{tmp_path}/a*.zip", f"file://{tmp_path}/a*.zip"):
        found = files.zipped_csv(spark, path, "plays.csv", schema)
        assert found.rdd.getNumPartitions() == 10
        want = [(f'x, "{k}"', k, None) for m in range(5) for k in range(m * 3)] + [(None, 7, None)]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want * 2, key=repr)


def test_members_stream_in_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "ROWS", 10)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("m.csv", "id\n" + "\n".join(map(str, range(35))))
    reader = archives.ZipMembers({"path": f"{tmp_path}/*.zip", "columns": '["id"]'}).reader(None)
    (part,) = reader.partitions()
    assert [b.num_rows for b in reader.read(part)] == [10, 10, 10, 5]


def test_the_first_page_tells_the_total(spark, tmp_path):
    for start in (0, 2, 4):
        (tmp_path / f"{start}.json").write_text(json.dumps({"recordsTotal": "5", "data": [{"id": k} for k in range(start, min(start + 2, 5))]}))
    spark.dataSource.register(paged.PagedJson)
    pages = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{start}}.json").option("length", 2).load()
    assert pages.rdd.getNumPartitions() == 3 and sorted(r.id for r in paged.rows_of(pages, "data", "id long").collect()) == [0, 1, 2, 3, 4]
