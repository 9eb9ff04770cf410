"""Tables in the shared folder, and their end."""

import os
import tempfile

from panelloom.sources import shared


class Unset:
    """A local session without a shared folder."""

    master = "local[1]"
    sparkContext = conf = property(lambda self: self)

    def getConf(self):
        return self

    def get(self, name, default=None):
        return default


def test_one_folder_a_process(monkeypatch):
    made = []
    monkeypatch.setattr(tempfile, "mkdtemp", lambda **kw: made.append(kw) or "/nowhere")
    monkeypatch.setattr(shared, "_LOCAL", {})
    assert {shared.shared_dir(Unset()) for _ in range(3)} == {"/nowhere"} and len(made) == 1


def test_scratch_deletes_what_is_not_kept(spark):
    with shared.scratch() as keep:
        a, b = (shared.materialize(spark.range(n), "t") for n in (3, 4))
        with shared.scratch():
            c = shared.materialize(spark.range(5), "t")
        assert not os.path.exists(c._written_path) and os.path.exists(a._written_path)
        keep.append(b)
    assert not os.path.exists(a._written_path) and b.count() == 4
    shared.discard(b)


def test_digest_tells_other_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).coalesce(1).write.parquet(path)
    first = shared.digest_of(spark, path)
    assert shared.digest_of(spark, path) == first
    spark.range(1).coalesce(1).write.mode("append").parquet(path)
    assert shared.digest_of(spark, path) != first
