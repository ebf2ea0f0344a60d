import hashlib
import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators.catalog import flag_duplicates
from folioscope.sources import files, tables


@pytest.fixture()
def tree(tmp_path):
    contents = {
        "root.txt": b"plain",
        "a/one.TXT": b"\xef\xbb\xbfwith mark\r\nline\rend",
        "a/b/two.pdf": b"plain",
        "a/~$lock.docx": b"x",
        "a/three.md": b"x",
        "c/cyr.txt": "Наказ № 5".encode("cp1251"),
        "c/bad.txt": b"\x98\x81",
        "c/four.docx": b"zip",
    }
    for name, content in contents.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path, contents


def test_scan(spark, tree):
    root, contents = tree
    rows = {row.relative_path: row for row in files.scan(spark, str(root)).collect()}
    assert set(rows) == {"root.txt", "a/one.TXT", "a/b/two.pdf", "c/cyr.txt", "c/bad.txt", "c/four.docx"}
    nested = rows["a/b/two.pdf"]
    assert (nested.name, nested.extension, nested.document_type) == ("two.pdf", "pdf", "pdf")
    assert (nested.parent_dir, nested.relative_dir, nested.folder_category) == ("b", "a/b", "a")
    assert nested.path == str(root / "a/b/two.pdf")
    assert nested.sha256 == hashlib.sha256(contents["a/b/two.pdf"]).hexdigest()
    top = rows["root.txt"]
    assert (top.parent_dir, top.relative_dir, top.folder_category) == (root.name, "", "uncategorized")
    assert rows["a/one.TXT"].extension == "txt" and rows["c/four.docx"].document_type == "word"
    assert top.size_bytes == 5 and top.modified_at is not None and top.scan_status == "cataloged"
    flags = {row.relative_path: row.is_duplicate_candidate for row in flag_duplicates(files.scan(spark, str(root))).collect()}
    assert {name for name, flag in flags.items() if flag} == {"root.txt", "a/b/two.pdf"}


def test_unreadable_lists_what_the_scan_lacks(spark, tree):
    root, _ = tree
    scanned = files.scan(spark, str(root)).filter("name <> 'bad.txt'")
    missing = files.unreadable(spark, str(root), scanned).collect()
    assert [row.path for row in missing] == [str(root / "c/bad.txt")]


def test_scan_keeps_every_name_and_the_errors(spark, tmp_path):
    for name in ("a/_note.txt", ".hidden.txt", "_drafts/.deep/d.txt", "a/x#1 %20.txt", "a/ok.txt", "txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    scanned = files.scan(spark, f"{tmp_path}/")
    rows = {row.relative_path: row.sha256 for row in scanned.collect()}
    names = {"a/_note.txt", ".hidden.txt", "_drafts/.deep/d.txt", "a/x#1 %20.txt", "a/ok.txt"}
    assert rows == {name: hashlib.sha256(name.encode()).hexdigest() for name in names}
    (tmp_path / "a/up").symlink_to(tmp_path)
    assert files.scan(spark, str(tmp_path)).count() == len(names)
    assert files.unreadable(spark, str(tmp_path), scanned).count() == 0
    listed = files.walk(spark, str(tmp_path))
    (tmp_path / "a/ok.txt").unlink()
    tried = files.hashed(spark, str(tmp_path), listed).filter("error IS NOT NULL").collect()
    assert [row.path for row in tried] == [str(tmp_path / "a/ok.txt")] and "No such file" in tried[0].error
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "missing"))
    assert files.scan(spark, str(tmp_path / "empty")).count() == 0


def test_text_pages(spark, tree):
    root, _ = tree
    listed = files.list_files(spark, str(root)).filter(F.lower("path").endswith(".txt"))
    found = files.text_pages(listed.withColumn("document_id", F.col("path")))
    rows = {row.document_id.rsplit("/", 1)[1]: row for row in found.collect()}
    assert rows["one.TXT"].text == "with mark\nline\nend"
    assert rows["cyr.txt"].text == "Наказ № 5" and rows["cyr.txt"].text_length == 9
    assert rows["bad.txt"].text is None and rows["bad.txt"].error == files.UNDECODABLE
    assert rows["root.txt"].error is None


def test_second_fallback_encoding(spark):
    df = spark.createDataFrame([(bytearray(b"caf\xe9 \x98"),)], "content binary")
    assert df.select(files.decode_text(F.col("content"))).first()[0] == "café ˜"


def test_query_set_defaults_and_checks(spark, tmp_path):
    path = tmp_path / "queries.json"
    path.write_text(
        '{"query": " one ", "known_relevant_documents": ["a.pdf"], "position": 1, "category": ""}\n'
        '{"query_id": "own", "query": "two", "known_relevant_documents": ["b.pdf"], "position": 2}\n'
    )
    rows = {row.query_id: row for row in tables.read_query_set(spark, str(path)).collect()}
    assert set(rows) == {"q001", "own"}
    assert rows["q001"].query == "one" and rows["q001"].category is None
    for bad in ('{"query": " ", "known_relevant_documents": ["a"]}', '{"query": "x", "known_relevant_documents": []}'):
        path.write_text(bad + "\n")
        with pytest.raises(Exception, match="has no"):
            tables.read_query_set(spark, str(path)).collect()


def test_table_round_trip(spark, tmp_path):
    legacy = spark.createDataFrame([(1, "/r/a.txt", "top")], "id long, path string, category string")
    tables.overwrite(legacy, str(tmp_path / "docs"))
    row = tables.read_documents(spark, str(tmp_path / "docs")).first()
    assert row.folder_category == "top" and row.document_type == "unknown" and row.is_supported is True
    tables.write_json_lines(legacy, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().path == "/r/a.txt"
    # A table can be made from itself.
    for value in (2, 3):
        spark.createDataFrame([(value, "/r/b.txt")], "id long, path string").write.mode("append").parquet(
            str(tmp_path / "self")
        )
    tables.overwrite(spark.read.parquet(str(tmp_path / "self")).filter("id > 2"), str(tmp_path / "self"))
    assert [row.id for row in spark.read.parquet(str(tmp_path / "self")).collect()] == [3]
    assert sorted(path.name for path in tmp_path.iterdir()) == ["docs", "json", "self"]


def test_queries_are_named_by_their_place(spark, tmp_path):
    path = tmp_path / "queries.json"
    line = '{"query": "%s", "known_relevant_documents": ["a"]}'
    path.write_text(line % "pear" + "\n" + line % "fig" + "\n")
    rows = {row.query_id: row.query for row in tables.read_query_set(spark, str(path)).collect()}
    assert rows == {"q001": "pear", "q002": "fig"}
    path.write_text(line.replace("{", '{"query_id": "x", ', 1) % "pear" + "\n" + line.replace("{", '{"query_id": "x", ', 1) % "fig")
    with pytest.raises(Exception, match="repeats the id"):
        tables.read_query_set(spark, str(path)).select("query_id").collect()


def test_queries_of_several_files_are_named_in_the_order_of_their_names(spark, tmp_path):
    line = '{"query": "%s", "known_relevant_documents": ["a"]}\n'
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "a.json").write_text(line % "first")
    (folder / "b.json").write_text("".join(line % f"b{n} {'long ' * 50}" for n in range(40)))
    (folder / "c.json").write_text(line % "last")
    rows = {row.query_id: row.query.split()[0] for row in tables.read_query_set(spark, str(folder)).collect()}
    assert rows == {"q001": "first", "q042": "last"} | {f"q{n + 2:03d}": f"b{n}" for n in range(40)}


def test_only_regular_files_are_scanned(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("ok")
    os.mkfifo(tmp_path / "pipe.txt")
    (tmp_path / "lost.txt").symlink_to(tmp_path / "nowhere")
    (tmp_path / "link.txt").symlink_to(tmp_path / "ok.txt")
    names = {row.name for row in files.scan(spark, str(tmp_path)).collect()}
    assert names == {"ok.txt", "link.txt"}
    assert files.unreadable(spark, str(tmp_path), files.scan(spark, str(tmp_path))).count() == 0
