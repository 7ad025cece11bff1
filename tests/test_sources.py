import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from themeforge.plans import registry, source_queries
from themeforge.session import fresh_path
from themeforge.sources import batches as B
from themeforge.sources import tables as S


def test_labelled_folders(spark, tmp_path):
    for cls, name, text in (("sport", "1.txt", "Win\nA Win at home"), ("sport", "b c.txt", "Cup\r\nfinal"), ("tech", "1.txt", "")):
        (tmp_path / cls).mkdir(exist_ok=True)
        (tmp_path / cls / name).write_bytes(text.encode())
    found = sorted(map(tuple, S.read_labeled_text(spark, str(tmp_path)).select("class", "filename", "title", "text").collect()))
    assert found == [
        ("sport", "1.txt", "Win", "\nA  at home"), ("sport", "b c.txt", "Cup", "\nfinal"), ("tech", "1.txt", "", ""),
    ]


def test_declared_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    rows = S.load(spark, str(tmp_path / "x.csv"), "csv", schema="a int, b string").collect()
    assert sorted(map(tuple, rows)) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="Invalid data type"):
        S.load(spark, "x", "orc")


def test_folder_exclusions(spark, tmp_path):
    for name in ("a.parquet", "b.parquet", "a_embed.parquet", "sample.parquet", "wiki_2023_index.parquet"):
        pq.write_table(pa.table({"name": [name]}), tmp_path / name)
    plain = S.read_folder(spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in plain) == ["a.parquet", "b.parquet"]
    assert all(r["name"] == r["source_file"] for r in plain)
    assert [r["name"] for r in S.read_folder(spark, str(tmp_path), embedded=True).collect()] == ["a_embed.parquet"]


def test_stacking_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, i int")
    assert sorted(map(tuple, S.stack_frames([a, b]).collect())) == [(1, "x"), (2, "y")]


def test_csv_lists_round_trip(spark):
    path = fresh_path(spark, "csv")
    rows = [(1, 'say "a", b', [1, 2]), (2, "line", []), (3, None, None)]
    S.write_csv(spark.createDataFrame(rows, "i int, s string, l array<int>"), path)
    back = S.read_csv(spark, path, "i int, s string, l array<int>")
    assert sorted(map(tuple, back.collect())) == rows


def test_json_maps(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"a": 1.5, "b": 2}))
    rows = S.read_json_map(spark, str(tmp_path / "ok.json"), "token", "score").collect()
    assert sorted(map(tuple, rows)) == [("a", 1.5), ("b", 2.0)]
    for i, text in enumerate(("[1, 2]", '{"a": 1} x', '{"a": 1} {"b": 2}', '{"a": 1}\n7', '{"a": {"b": 1}}')):
        (tmp_path / f"bad{i}.json").write_text(text)
        with pytest.raises(PySparkException):
            S.read_json_map(spark, str(tmp_path / f"bad{i}.json"), "token", "score").collect()


def test_json_maps_in_both_layouts(spark, tmp_path):
    data = {"a": 1.5, 'q"}{': 2.0, "line\nbreak": -3.0, "\\": 4.0}
    for name, text in (
        ("flat", json.dumps(data)), ("wide", json.dumps(data, indent=2)),
        ("lines", "\n".join(json.dumps({k: v}) for k, v in data.items()) + "\n"), ("empty", "{}"),
    ):
        (tmp_path / name).write_text(text)
        rows = dict(map(tuple, S.read_json_map(spark, str(tmp_path / name), "token", "score").collect()))
        assert rows == ({} if name == "empty" else data), name
    path = fresh_path(spark, "map")
    frame = spark.createDataFrame(list(data.items()), "token string, score double")
    S.write_json_map(frame.coalesce(1), path, "token", "score")
    assert dict(map(tuple, S.read_json_map(spark, path, "token", "score").collect())) == data


def test_category_vectors(spark, tmp_path):
    data = {"categories": ["x", "y"], "embeddings": [[1.0, 2.0], [3.0, 4.0]], "art": [0.1, 0.3]}
    (tmp_path / "chunk.json").write_text(json.dumps(data))
    rows = S.read_category_vectors(spark, str(tmp_path), ["art"]).collect()
    assert sorted(map(tuple, rows)) == [("x", [1.0, 2.0], 0.1), ("y", [3.0, 4.0], 0.3)]


def test_unreadable_files_are_reported_and_kept(spark, tmp_path):
    pq.write_table(pa.table({"a": [1, 2, 3]}), tmp_path / "good_embed.parquet")
    bad = tmp_path / "bad_embed.parquet"
    bad.write_bytes(b"not parquet")
    (tmp_path / "a b+c_embed.parquet").write_bytes(b"")
    checked = B.check_files(spark, str(tmp_path), "*_embed.parquet")
    found = {r["path"].rsplit("/", 1)[1]: r for r in checked.collect()}
    assert found["good_embed.parquet"]["ok"] and found["good_embed.parquet"]["n_rows"] == 3
    assert not found["bad_embed.parquet"]["ok"] and found["bad_embed.parquet"]["error"]
    assert not found["a b+c_embed.parquet"]["ok"]
    assert bad.exists()
    assert S.load(spark, B.readable_paths(checked)).count() == 3


def test_scan_filter_write(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "in"))
    S.filter_to_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"), F.col("id") % 10 == 0)
    assert S.load(spark, str(tmp_path / "out")).count() == 10


def _layouts(spark, rows, root):
    """Rows read back from the library's files and from those of Spark's own writer."""
    frame = spark.createDataFrame(rows, "`a=b` string, text string").repartition(3)
    S.write_labeled_text(frame, f"file:{root}/ours", "a=b", "text")
    frame.write.option("maxRecordsPerFile", 1).partitionBy("a=b").text(f"{root}/spark")
    found = [S.read_labeled_text(spark, f"{root}/{name}") for name in ("ours", "spark")]
    return [sorted(map(tuple, f.select("class", "title", "text").collect())) for f in found]


def test_labelled_folders_are_as_spark_writes_them(spark, tmp_path):
    labels = [None, "", " ", "en", "a/b", "é_", "_", ".", *(f"x{chr(i)}y" for i in range(1, 128) if chr(i) != "\n")]
    rows = [(label, f"{i}\nbody\r\n{i}") for i, label in enumerate(labels)]
    rows += [("en", text) for text in (None, "", "same", "same", "\n", "é\r", "x" * 300_000)]
    ours, spark_own = _layouts(spark, rows, tmp_path)
    assert len(ours) == len(rows) and ours == spark_own
    assert S.read_labeled_text(spark, str(tmp_path / "ours")).select("class", "filename").distinct().count() == len(rows)
    with pytest.raises(FileExistsError):
        S.write_labeled_text(spark.createDataFrame([("a", "b")], "c string, t string"), str(tmp_path / "ours"), "c", "t")


def test_labelled_folders_need_nothing_beside_their_files(spark, tmp_path, monkeypatch):
    """Files that Hadoop creates have checksum files; names of files do not pass the driver."""
    monkeypatch.setattr(S, "list_files", lambda *_: pytest.fail("all file names on the driver"))
    rows = [(f"c{i % 3}", f"title {i}\nbody") for i in range(200)]
    path = fresh_path(spark, "folders")
    S.write_labeled_text(spark.createDataFrame(rows, "c string, t string"), path, "c", "t")
    root = S.local_root(spark, path)
    names = [name for _, _, found in os.walk(root) for name in found]
    assert len(names) == len(rows) and all(name.startswith("part-") for name in names)
    found = S.read_labeled_text(spark, path).select(F.regexp_replace("class", "^c=", ""), "title", "text")
    assert sorted(map(tuple, found.collect())) == sorted((c, t.partition("\n")[0], "\nbody\n") for c, t in rows)


def test_labelled_folders_of_every_depth(spark, tmp_path):
    """As Spark's listing has them: deeper folders count, hidden names do not."""
    for path in ("top.txt", "a/1", "a/.hidden", "a/_SUCCESS", "a/_x=1", "a/b/2", "_c/3", ".d/4", "e=1/5", "_e=1/6", "f/x._COPYING_", "f/_metadata"):
        (tmp_path / "root" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / path).write_text(path if path != "a/1" else "")
    found = sorted((r["class"], r["filename"]) for r in S.read_labeled_text(spark, str(tmp_path / "root")).collect())
    listed = sorted(tuple(r["path"].rsplit("/", 2)[1:]) for r in S.list_files(spark, str(tmp_path / "root")).collect())
    assert found == listed
    assert [tuple(r) for r in S.read_labeled_text(spark, str(tmp_path / "root" / "a*")).select("class", "title").collect()] != []
    assert S.read_labeled_text(spark, str(tmp_path / "root" / "top.txt")).select("title").first()[0] == "top.txt"


def test_labelled_folders_without_rows(spark, tmp_path):
    S.write_labeled_text(spark.createDataFrame([], "c string, t string"), str(tmp_path / "none"), "c", "t")
    assert S.read_labeled_text(spark, str(tmp_path / "none")).collect() == []


def test_file_names_follow_the_partition_and_the_place_in_it(spark, tmp_path):
    frame = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "c string, t string").coalesce(1)
    S.write_labeled_text(frame, str(tmp_path / "x"), "c", "t")
    names = sorted(p.relative_to(tmp_path / "x").as_posix() for p in (tmp_path / "x").rglob("*.txt"))
    assert names == [f"c={c}/part-00000-{i:09d}.txt" for c, i in (("a", 0), ("a", 1), ("b", 0))]


def test_class_folders_leave_one_file_per_document(spark, tmp_path, monkeypatch):
    """Nothing but documents: each further file, such as those with checksums, costs processes."""
    texts = ["a\nb", "", "x", "x"]
    pq.write_table(pa.table({"doc_id": range(4), "lang": ["en", "de", "en", "en"], "text": texts}), tmp_path / "documents.parquet")
    monkeypatch.setattr(source_queries, "fresh_path", lambda *_: f"file:{tmp_path}/out")
    found = registry.QUERIES["class_folders"](spark, str(tmp_path)).select("class", "title").collect()
    assert sorted(map(tuple, found)) == [("de", ""), ("en", "a"), ("en", "x"), ("en", "x")]
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "out")) == 4
