import pytest

from panelloom.operators import scoring
from panelloom.sources import files, loaders, sinks

MONTHS = [f"1996-{m:02d}-01" for m in range(1, 13)]
KIND = "e string, p string, x int"


def whole(keys=("a", "b")):
    return [(k, m, 1) for k in keys for m in MONTHS]


def test_aligned_cohort(spark):
    rows = spark.createDataFrame(whole(), KIND)
    assert loaders.aligned_cohort(rows, "e", "p", MONTHS).count() == 24
    assert loaders.aligned_cohort(rows.limit(0), "e", "p", MONTHS).collect() == []
    with pytest.raises(ValueError):
        loaders.aligned_cohort(rows, "e", "p", [])


@pytest.mark.parametrize("change", ["absent", "twice", "other", "no key", "no period"])
def test_other_cohorts_fail(spark, change):
    rows = whole()
    if change == "absent":
        rows = rows[1:]
    elif change == "twice":
        rows = [*rows[1:], rows[1]]
    elif change == "other":
        rows = [*rows, ("a", "1997-01-01", 1)]
    elif change == "no key":
        rows = [*rows, (None, MONTHS[0], 1)]
    else:
        rows = [*rows[1:], ("a", None, 1)]
    with pytest.raises(Exception, match="one cohort"):
        loaders.aligned_cohort(spark.createDataFrame(rows, KIND), "e", "p", MONTHS).collect()


@pytest.mark.parametrize("labels", [[("a", 0)], [("a", 0), ("b", 1), ("c", 1)], [("a", 0), ("b", 1), ("b", 1)], [("a", 0), ("b", None)], [("a", 0), ("b", 1), (None, 1)]])
def test_labels_of_other_ids_fail(spark, labels):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(Exception, match="other ids"):
        loaders.aligned_labels(ids, spark.createDataFrame(labels, "id string, cluster int")).collect()


def test_frozen_labels_must_reproduce(spark):
    vectors = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0])], "id string, vector array<double>")
    centres = [[0.0, 1.0], [3.0, 3.0]]
    stored = lambda *c: spark.createDataFrame(list(zip("ab", c, strict=True)), "id string, cluster int")
    found = {r["id"]: (r["cluster"], r["distance"]) for r in loaders.reproduced_labels(vectors, centres, stored(0, 1)).collect()}
    assert found == {"a": (0, 1.0), "b": (1, 1.0)}
    with pytest.raises(Exception, match="not reproduced"):
        loaders.reproduced_labels(vectors, centres, stored(1, 1)).collect()


def test_changed_bytes_and_locks_fail(spark, tmp_path):
    path = str(tmp_path / "panel.csv")
    rows = spark.createDataFrame([("a", m, "1", "1") for m in MONTHS], "entity string, period string, c1 string, total string")
    sinks.write_csv(rows, path)
    digest = files.file_digests(spark, path).first()["sha256"]
    lock = {"panel": path, "panel_sha256": digest, "labels": path, "labels_sha256": digest, "year": 1996, "scaler": {}, "centers": []}
    with pytest.raises(ValueError, match="digest"):
        loaders.load_reference(spark, {**scoring.sealed(lock), "year": 1997}, ["c1"])
    with pytest.raises(ValueError, match="other bytes"):
        loaders.load_reference(spark, scoring.sealed({**lock, "panel_sha256": "0" * 64}), ["c1"])
