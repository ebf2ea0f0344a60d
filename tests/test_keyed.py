"""Tables in folders by key: a change rewrites the folders it touches and no other file."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog, pages, vectors
from folioscope.sources import keyed


def files_of(path):
    return {str(file.relative_to(path)): file.stat().st_mtime_ns for file in Path(path).rglob("*.parquet")}


def folder_of(name):
    return name.rsplit("/", 1)[0]


def kept_folders(before, after):
    """Folders whose files are the same, and those with new ones."""
    same = {folder_of(name) for name in before if after.get(name) == before[name]}
    return same, {folder_of(name) for name in after if name not in before}


SCHEMA = "id long, path string, sha256 string, scan_root string, content_category string, scan_status string"


def test_catalog_upsert_rewrites_touched_folders(spark, tmp_path):
    old = spark.createDataFrame([(n, f"/r/{n}", f"h{n}", "/r", "training", "text_extracted") for n in range(100)], SCHEMA)
    new = old.drop("id", "content_category").withColumn("scan_status", F.lit("cataloged"))
    table = keyed.store(old, str(tmp_path / "catalog"), "path", parts=32)
    before = files_of(table.path)
    # The same scan again changes nothing.
    assert catalog.upsert_stored(table, new, "/r") == 0 and files_of(table.path) == before
    changed = new.filter("path not in ('/r/5', '/r/6')").withColumn(
        "sha256", F.when(F.col("path") == "/r/7", "other").otherwise(F.col("sha256"))
    )
    added = spark.createDataFrame([("/r/new", "h", "/r", "cataloged")], "path string, sha256 string, scan_root string, scan_status string")
    scanned = changed.unionByName(added)
    want = sorted(map(tuple, catalog.upsert(old, scanned, "/r").select(*old.columns).collect()))
    assert 1 <= catalog.upsert_stored(table, scanned, "/r") <= 4
    assert sorted(map(tuple, table.read(spark).collect())) == want
    same, rewritten = kept_folders(before, files_of(table.path))
    assert len(same) >= 26 and not same & rewritten and len(rewritten) <= 4


def test_pages_of_processed_documents_are_replaced(spark, tmp_path):
    schema = "id long, document_id long, page_number int, text string"
    old = spark.createDataFrame([(n, n // 3, n % 3 + 1, f"page {n}") for n in range(300)], schema)
    new = spark.createDataFrame([(1000, 4, 1, "now one page")], schema)
    processed = spark.createDataFrame([(4,), (77,)], "document_id long")
    table = keyed.store(old, str(tmp_path / "pages"), "document_id", parts=16)
    before = files_of(table.path)
    assert pages.replace_stored_pages(table, new, processed) == 2
    want = pages.replace_pages(old, new, processed).select(*old.columns)
    assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, want.collect()))
    same, rewritten = kept_folders(before, files_of(table.path))
    assert len(same) == 14 and len(rewritten) == 2


def test_emptied_folders_go(spark, tmp_path):
    old = spark.createDataFrame([(n, f"t{n}") for n in range(6)], "document_id long, text string")
    table = keyed.store(old, str(tmp_path / "t"), "document_id", parts=1024)
    assert pages.replace_stored_pages(table, old.limit(0), old.filter("document_id = 3").select("document_id")) == 1
    assert sorted(row.document_id for row in table.read(spark).collect()) == [0, 1, 2, 4, 5]
    assert table.rewrite(old.limit(0).select("document_id"), lambda rows: rows) == 0


def test_embeddings_of_other_models_stay(spark, tmp_path):
    schema = "chunk_id string, model string, embedding array<float>"
    old = spark.createDataFrame([(f"c{n}", model, [float(n)]) for n in range(60) for model in ("m", "n n")], schema)
    new = spark.createDataFrame([("c1", "m", [9.0]), ("new", "m", [8.0])], schema)
    table = vectors.store_embeddings(old, str(tmp_path / "e"), parts=8)
    before = files_of(table.path)
    assert 1 <= vectors.upsert_stored(table, new) <= 2
    got = {(row.chunk_id, row.model): row.embedding[0] for row in table.read(spark).collect()}
    want = {(f"c{n}", model): float(n) for n in range(60) for model in ("m", "n n")} | {("c1", "m"): 9.0, ("new", "m"): 8.0}
    assert got == want
    same, rewritten = kept_folders(before, files_of(table.path))
    assert len([name for name in same if "model=m/" in name]) >= 6 and all("model=m/" in name for name in rewritten)
    assert len([name for name in same if "model=n" in name]) == 8


def test_a_failing_version_leaves_the_table(spark, tmp_path):
    old = spark.createDataFrame([(n, n) for n in range(50)], "k long, v long")
    table = keyed.store(old, str(tmp_path / "t"), "k", parts=8)
    before = files_of(table.path)
    with pytest.raises(Exception, match="broken"):
        table.rewrite(old.select("k"), lambda rows: rows.withColumn("v", F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(ValueError, match="other folders"):
        table.rewrite(old.limit(1).select("k"), lambda rows: old)
    assert files_of(table.path) == before


def test_backfill_goes_on_where_it_failed(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{n}", n, 0, f"text {n}") for n in range(90)], "chunk_id string, document_id long, chunk_index long, chunk_text string")
    have = spark.createDataFrame([("c0", "m", [1.0]), ("c1", "other", [1.0])], "chunk_id string, model string, embedding array<float>")
    table = vectors.store_embeddings(have, str(tmp_path / "e"), parts=4)
    seen = str(tmp_path / "seen")
    Path(seen).mkdir()

    def failing(texts):
        # Fails once about half of the texts were embedded.
        if len(list(Path(seen).iterdir())) > 45:
            raise RuntimeError("the model is gone")
        for text in texts:
            (Path(seen) / text).touch()
        return [[float(len(text))] for text in texts]

    with pytest.raises(Exception, match="the model is gone"):
        vectors.backfill_stored(chunks, table, "m", failing, batch_size=5, commit_rows=15)
    stored = table.read(spark).filter("model = 'm'").count()
    assert 15 < stored < 80
    before = files_of(table.path)
    asked = str(tmp_path / "asked")
    Path(asked).mkdir()

    def lengths(texts):
        for text in texts:
            (Path(asked) / text).touch()
        return [[float(len(text))] for text in texts]

    assert vectors.backfill_stored(chunks, table, "m", lengths, commit_rows=15) >= 1
    # Only what was not committed is embedded again, and committed files stay.
    assert len(list(Path(asked).iterdir())) == 90 - stored
    rows = table.read(spark).filter("model = 'm'").collect()
    assert sorted(row.chunk_id for row in rows) == sorted(f"c{n}" for n in range(90))
    assert before.items() <= files_of(table.path).items()
    assert vectors.backfill_stored(chunks, table, "m", lengths) == 0
