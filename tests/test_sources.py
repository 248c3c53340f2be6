"""Readers and sinks on small files."""

import zipfile

import pytest

from corvane.sources import readers, sinks


def test_lenient_lines_keep_their_index(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\nnot valid json\n{"a": 2}\n\n{"a": 3}\n[1]\n')
    for offsets in (False, True):
        got = readers.lenient_jsonl(spark, str(p), offsets=offsets)
        assert sorted((r["line"], r["json"]) for r in got.collect()) == [(0, '{"a": 1}'), (2, '{"a": 2}'), (4, '{"a": 3}')]
        assert [r["line"] for r in readers.lenient_jsonl(spark, str(p), 1, 4, offsets).collect()] == [2]
    assert tuple(readers.bad_lines(spark, str(p)).first()) == (6, 1, 2)


def test_strict_lines_fail(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.strict_jsonl(spark, str(p), "a int").count() == 2
    p.write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.strict_jsonl(spark, str(p), "a int").collect()


def test_failed_indices(spark, tmp_path):
    p = tmp_path / "f.jsonl"
    p.write_text('{"source_index": 5}\n{"source_index": "x"}\n{"source_index": 5}\n{}\n')
    assert [r[0] for r in readers.failed_indices(spark, str(p)).collect()] == [5]
    assert readers.failed_indices(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_array_archive_and_parts(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"name": "b"},\n {"name": "a"}]')
    assert sorted(r["name"] for r in readers.json_array(spark, str(tmp_path / "t.json")).collect()) == ["a", "b"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for n in ("x/eval_metrics_1.json", "eval_predictions_part_0.json", "eval_metrics_2.py", "other.json"):
            z.writestr(n, n)
    assert [r["member"] for r in readers.zip_members(spark, str(tmp_path / "z.zip")).collect()] == ["x/eval_metrics_1.json"]
    parts = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, ord int")
    assert sorted(map(tuple, readers.merged_parts(parts, ["id"], "ord").select("id", "v").collect())) == [(1, "b"), (2, "c")]
    assert readers.first_existing([str(tmp_path / "no"), str(tmp_path / "t.json")], "d").endswith("t.json")


def test_publish_manifest_archive(spark, tmp_path):
    path = str(tmp_path / "rev")
    df = spark.createDataFrame([(1, "vi", "train"), (2, "en", "train"), (3, "vi", "test")], "id int, language string, split string")
    sinks.publish(spark, path, lambda s: df.write.partitionBy("language", "split").parquet(f"{s}/records"))
    with pytest.raises(FileExistsError):
        sinks.publish(spark, path, lambda s: None)
    assert not sinks.exists(spark, path + ".staging")
    assert readers.split_rows(spark, path, "vi", "test").count() == 1
    m = sinks.promote(spark, path, str(tmp_path / "active"))
    assert m.count() >= 2 and all(len(r["sha256"]) == 64 for r in m.collect())
    with pytest.raises(FileExistsError):
        sinks.promote(spark, path, str(tmp_path / "active"))
    sinks.write_json(spark, str(tmp_path / "x.json"), {"a": [1]})
    assert sinks.read_json(spark, str(tmp_path / "x.json")) == {"a": [1]}
    dry = sinks.archive(spark, [path, str(tmp_path / "none")], str(tmp_path / "old"))
    assert dry["dry_run"] and dry["n_files"] and sinks.exists(spark, path)
    done = sinks.archive(spark, [path], str(tmp_path / "old"), dry_run=False)
    assert not sinks.exists(spark, path) and sinks.exists(spark, f"{done['target']}/rev/records")


def test_one_folder_per_key_and_raw_filter(spark, tmp_path):
    df = spark.createDataFrame([(5, "a", "x"), (7, "b", "y"), (9, "a", "z")], "i int, name string, v string")
    sinks.one_folder_per(df, "name", str(tmp_path / "tools"))
    assert sorted(p.name for p in (tmp_path / "tools").iterdir() if p.is_dir()) == ["name=a", "name=b"]
    kept, ix = sinks.raw_filter(df, df["name"] == "a", "i")
    assert kept.columns == df.columns and sorted(map(tuple, ix.collect())) == [(5, 0), (9, 1)]
