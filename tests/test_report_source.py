"""The data source of HTML reports, as a batch and as a stream."""

import os

from tidemark.sources import report_source
from tidemark.sources.html import shred
from tidemark.streaming.ingest import stream_cells


def page(n, word):
    return f"<h2>{word}</h2><table id='t{word}'>" + "".join(f"<tr><td>{word}{i}</td><td>é{i}</td></tr>" for i in range(n)) + "</table>"


def put(folder, name, data, at):
    path = folder / name
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    os.utime(path, (at, at))
    return str(path)


def test_files_are_shredded_where_they_are_read(spark, tmp_path):
    texts = {put(tmp_path, f"a/{i}.html", page(i * 10, f"w{i}"), 1000 + i): page(i * 10, f"w{i}") for i in range(1, 6)}
    put(tmp_path, "a/empty.htm", "", 1000)
    put(tmp_path, "no.txt", page(3, "x"), 1000)
    put(tmp_path, "_hidden/h.html", page(3, "x"), 1000)
    broken = put(tmp_path, "b.HTML", b"<table><tr><td>\xff</td></tr>", 1000)
    cells = report_source.read_cells(spark, str(tmp_path), partitionBytes=2000)
    got = sorted((r["file_path"], r["table_idx"], r["row_idx"], r["col_idx"], r["text"]) for r in cells.collect())
    want = sorted([(p, c[0], c[6], c[7], c[9]) for p, t in texts.items() for c in shred(t)] + [(broken, 0, 0, 0, "�")])
    assert got == want and cells.rdd.getNumPartitions() > 1
    assert "file_size" in cells.columns and cells.filter("file_size IS NULL").count() == 0
    (tmp_path / "nothing").mkdir()
    assert report_source.read_cells(spark, str(tmp_path / "nothing")).count() == 0


def test_partitions_by_bytes():
    files = [(f"f{i}", 10) for i in range(30)] + [("long", 1000)]
    parts = report_source.by_bytes(files, 100)
    assert sorted(f for p in parts for f in p.files) == sorted(files)
    assert [p.files for p in parts if ("long", 1000) in p.files] == [[("long", 1000)]]
    assert all(sum(n for _, n in p.files) <= 100 for p in parts if ("long", 1000) not in p.files)
    assert report_source.by_bytes([], 100) == []


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    put(folder, "1.html", page(2, "a"), 1000)
    put(folder, "2.html", page(3, "b"), 1000)
    assert stream_cells(spark, str(folder), out).count() == 10
    put(folder, "3.html", page(4, "c"), 1001)
    rows = stream_cells(spark, str(folder), out)
    assert rows.count() == 18 and rows.filter("batch = 1").select("table_id").distinct().collect()[0][0] == "tc"
    assert stream_cells(spark, str(folder), out).count() == 18
