"""The register of source texts, and its reruns."""

import hashlib

from jobs import source_register

DOCS = "doc_id long, text string, lang string, source string, n_chars int, sha256 string"


def test_rows_and_reruns(spark, tmp_path):
    rows = [
        (1, "wage 12,5 and 3.\nx9 … 7", "en", "s1"),
        (2, "wage 12,5 and 3.\nx9 … 7", "en", "s2"),
        (2, "other", "en", "s2"),
        (3, None, "ru", "s1"),
        (4, "", None, "s1"),
        (5, "é漢🙂 1 000 2e5", "ru", "s1"),
        (5, "é漢🙂 1 000 2e5", "ru", "s1"),
        (None, "no id", "en", "s1"),
        (6, "no source", "en", None),
    ]
    docs, labels, out = (str(tmp_path / n) for n in ("docs", "labels", "out"))
    spark.createDataFrame([(*r, 0, "mine") for r in rows], DOCS).write.parquet(docs)
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(labels)

    def found():
        done = source_register.run(spark, docs, labels, out)
        assert done == {"documents_read": 9, "documents_registered": 7, "sources": 2, "later_copies": 2}
        return sorted([tuple(r[c] for c in ("doc_id", "source", "first_doc_id", "copies", "conflicting", "chars", "lines", "digit_tokens", "numbers", "quality", "toxic", "sha256")) for r in spark.read.parquet(out).collect()], key=str)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    first, odd = sha(rows[0][1]), sha(rows[5][1])
    want = [
        (1, "s1", 1, 2, False, 23, 2, 4, 3, 0, 0, first),
        (2, "s2", 1, 2, True, 23, 2, 4, 3, 1, 1, first),
        (2, "s2", 2, 1, True, 5, 1, 0, 0, 1, 1, sha("other")),
        (3, "s1", 3, 2, False, 0, 0, 0, 0, None, None, sha("")),
        (4, "s1", 3, 2, False, 0, 0, 0, 0, None, None, sha("")),
        (5, "s1", 5, 2, False, 13, 1, 2, 1, None, None, odd),
        (5, "s1", 5, 2, False, 13, 1, 2, 1, None, None, odd),
    ]
    assert found() == sorted(want, key=str)
    assert found() == sorted(want, key=str)


def test_a_source_that_is_gone_leaves_the_register(spark, tmp_path):
    labels, out = str(tmp_path / "labels"), str(tmp_path / "out")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(labels)
    for names in (("s1", "s2"), ("s2",), ()):
        docs = str(tmp_path / f"docs-{len(names)}")
        spark.createDataFrame([(1, "t", "en", n, 1, "") for n in names], DOCS).write.parquet(docs)
        assert source_register.run(spark, docs, labels, out)["sources"] == len(names)
