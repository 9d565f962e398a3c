"""Labels by version, and a purge that reads no file."""

from turnlake.sources import label_store

LABELS = "external_id string, intent string, taxonomy_version bigint, prompt_version bigint"
FAILURES = "external_id string, attempts bigint, prompt_version bigint"


def test_purge_drops_folders_without_reading_files(spark, tmp_path):
    path = str(tmp_path / "labels")
    label_store.append(spark.createDataFrame([("a", "x", 3, 2), ("b", "x", 3, 1), ("c", "x", 2, 2), ("d", "x", None, 2)], LABELS), path, "labels")
    label_store.append(spark.createDataFrame([("a", 1, 2), ("b", 2, 1)], FAILURES), path, "failures")
    for f in (tmp_path / "labels").rglob("part-*.parquet"):
        if "taxonomy_version=3/prompt_version=2" not in str(f) and "failures/prompt_version=2" not in str(f):
            f.write_bytes(b"no parquet")  # would fail if it were opened
    read = lambda kind, schema: [r.external_id for r in label_store.read(spark, path, kind, schema, 3, 2).collect()]
    assert read("labels", LABELS) == ["a"]  # partitions are pruned too
    gone = label_store.purge(spark, path, 3, 2)
    assert gone == ["failures/prompt_version=1", "labels/taxonomy_version=2", "labels/taxonomy_version=3/prompt_version=1", "labels/taxonomy_version=__HIVE_DEFAULT_PARTITION__"]
    assert label_store.purge(spark, path, 3, 2) == [] and read("labels", LABELS) == ["a"] and read("failures", FAILURES) == ["a"]
    assert read("candidates", LABELS) == []
    assert len(list((tmp_path / "labels").rglob("part-*.parquet"))) == 2
