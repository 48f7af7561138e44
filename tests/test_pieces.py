"""Pages in pieces: the same rows whatever the cuts, and no query holds a page whole."""

import io
import json
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import store
from tidemark.queries import shredding
from tidemark.sources import html, report_source

SRC = "/root/testdata/sf0.001"
PAGE = "<h2>One &amp; two</h2><table class='tdiff' id='t'><tr><th>a</th><td>b</td></tr>" + "".join(f"<tr><td>{i}</td><td> x &lt; {i} &am</td><td></td></tr>\n" for i in range(50)) + "<td>late</td><tr><td>n<table><tr><td>inner</td></tr></table>m<br>o</td></tr></table><!-- <tr><td>no</td></tr> --><script>'<tr><td>no</td></tr>'</script><table><td>é<tr><td>open"


def rows_of(page, n):
    s = html.Shredder()
    for i in range(0, len(page), n):
        s.feed(page[i : i + n])
    s.close()
    return s.take()


@pytest.mark.parametrize("n", [1, 3, 64, 1000])
def test_cuts_change_nothing(n):
    whole = rows_of(PAGE, len(PAGE))
    # with a blank in the tag no row is plain
    slow = rows_of(PAGE.replace("<tr>", "<tr >"), len(PAGE) * 2)
    assert rows_of(PAGE, n) == whole and sorted(map(str, slow)) == sorted(map(str, whole))
    assert ["late"] == whole[50][8][3:] and ["open"] == whole[-1][8] and not any("no" in r[8] for r in whole)


def test_rows_leave_a_file_before_its_end(tmp_path):
    (tmp_path / "a.html").write_text("<table>" + "<tr><td>é</td><td>b</td></tr>" * 200_000)
    path = str(tmp_path / "a.html")
    sizes = [b.num_rows for b in report_source.read_files(str(tmp_path), [(path, 1)])]
    assert sum(sizes) == 200_000 and max(sizes) <= html.BATCH_ROWS


@pytest.mark.parametrize("name", ["src.html_source", "src.html_stream"])
def test_files_are_written_line_by_line(spark, name):
    folder = shredding.report_files(spark, SRC)
    lines = spark.read.text(folder)
    assert lines.select(F.max(F.length("value"))).first()[0] < 5000 and entry.queries()[name](spark, SRC).count() == 35


@pytest.mark.parametrize("name", ["src.top_sql_core", "src.top_sql_distinct", "src.top_sql_row", "src.top_sql_row_simple", "src.top_sql_row_v2"])
def test_no_page_is_collected(spark, name):
    with redirect_stdout(io.StringIO()) as out:
        entry.queries()[name](spark, SRC).explain()
        shredding.whole_pages(spark, SRC).explain()
    assert "collect_list(struct(col_idx" not in out.getvalue() and "collect_list(struct(rank_by_time" not in out.getvalue()


def test_pieces_of_documents_join_to_documents(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    reports = spark.createDataFrame([(1, "a"), (2, 'q"b')], "id long, instance_name string")
    sqls = spark.createDataFrame([(i, 1 + i % 3, f't"{i}') for i in range(30)], "id long, report_id long, sql_text string")
    kept.batch("x", {"reports": reports, "top_sqls": sqls, "load_profile": spark.createDataFrame([(2, 7)], "report_id long, total_transactions long")})
    pieces = kept.document_pieces().collect()
    assert max(len(p["text"]) for p in pieces) < 500
    whole = {r["id"]: json.loads(r["document"]) for r in store.export_details(kept.details()).collect()}
    for k, want in whole.items():
        got = json.loads("".join(p["text"] for p in sorted((p for p in pieces if p["id"] == k), key=lambda p: (p["section"], p["n"]))))
        order = lambda x: x | {"top_sqls": sorted(x["top_sqls"], key=lambda t: t["id"])}
        assert order(got) == order(want) and len(got["top_sqls"]) == 10


def test_import_of_pieces_is_that_of_whole_pages(spark, tmp_path):
    plain = [(1, "a", PAGE), (2, "b", "<table summary='User Tables stats x'><tr>" + "<td>7</td>" * 12 + "</tr></table>"), (2, "c", "<p>")]
    cut = [(k, at, path, len(page[at : at + 40]), page[at : at + 40]) for k, path, page in plain for at in range(0, len(page), 40)]
    whole, parts = (store.Store(spark, str(tmp_path / x)) for x in ("whole", "parts"))
    whole.import_reports(spark.createDataFrame([(k, path, len(page), page) for k, path, page in plain], "report_id long, file_path string, file_size long, html string"), "i", "2024-01-01")
    pieces = spark.createDataFrame(cut[::-1], "report_id long, part int, file_path string, file_size long, html string")
    parts.import_reports(pieces, "i", "2024-01-01")
    parts.import_reports(pieces, "i", "2024-01-02")
    for table in ("reports", "object_stats", "top_sqls"):
        assert sorted(map(str, parts.read(table).collect())) == sorted(map(str, whole.read(table).collect()))
    assert parts.read("reports").count() == 2 and parts.read("object_stats").count() == 1
