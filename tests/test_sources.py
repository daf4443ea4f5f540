"""Capsules, their index and recovery, the content store, configuration and samples."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from runlens.sources import capsules, files, index, store


def test_capsules_are_selected_signed_and_checked(spark, tmp_path):
    run = {"run_id": "r", "status": "completed"}
    capsules.write_capsule(str(tmp_path / "a.zip"), run, {"big.bin": b"x" * 5000, "small.json": b"1"}, key=b"k")
    read = lambda **o: {r[3]: r for r in capsules.read_capsule(str(tmp_path / "a.zip"), **o)}
    rows = read(members=["small.json"], key=b"k", require_signature=True)
    assert rows["small.json"][6] == b"1" and rows["big.bin"][6] is None and rows["big.bin"][5] == hashlib.sha256(b"x" * 5000).hexdigest()
    assert read(max_file_bytes=100)["big.bin"][6] is None and read()["big.bin"][6] == b"x" * 5000
    assert "signature" in read(key=b"other")[None][7]
    capsules.write_capsule(str(tmp_path / "b.zip"), run)
    assert "signed" in next(capsules.read_capsule(str(tmp_path / "b.zip"), key=b"k", require_signature=True))[7]
    with pytest.raises(FileExistsError):
        capsules.write_capsule(str(tmp_path / "b.zip"), run, overwrite=False)
    capsules.register(spark)
    got = spark.read.format("capsule").option("members", "run.json").option("key", "k").load(str(tmp_path))
    assert got.where("error IS NULL").count() == 7 and {r.run_id for r in capsules.run_index(got).collect()} == {"r"}


def test_versions_of_runs(monkeypatch):
    assert capsules.migrated({"run_id": "x"}) == {"run_id": "x"}
    with pytest.raises(ValueError):
        capsules.migrated({"schema_version": 2})
    with pytest.raises(ValueError):
        capsules.migrated({"schema_version": 0})
    monkeypatch.setitem(capsules.MIGRATIONS, 0, lambda r: {**r, "status": r["state"]})
    assert capsules.migrated({"schema_version": 0, "state": "ok"})["status"] == "ok"


def test_folders_are_published_and_recovered(spark, tmp_path):
    place = files.Files(spark, str(tmp_path))
    index.publish(place, "cap", {"run_id": "one"}, {"a/b.json": b"1"}, key=b"k")
    rows = {r[3]: r for r in capsules.read_capsule(str(tmp_path / "cap"), key=b"k", require_signature=True)}
    assert rows["a/b.json"][6] == b"1" and place.names("cap") == ["a/b.json", "manifest.json", "run.json", "signature.json"]
    with pytest.raises(FileExistsError):
        index.publish(place, "cap", {"run_id": "two"})
    index.publish(place, "cap", {"run_id": "two"}, overwrite=True)
    assert next(capsules.read_capsule(str(tmp_path / "cap")))[1] == "two" and index.recover(place, "cap") == "published"

    def broken(at):
        """Break a publication off before its at-th rename."""
        left = iter(range(at))
        own = files.Files(spark, str(tmp_path))
        rename = own.rename
        own.rename = lambda a, b: rename(a, b) if next(left, None) is not None else (_ for _ in ()).throw(OSError("gone"))
        with pytest.raises(OSError):
            index.publish(own, "cap", {"run_id": f"new{at}"}, overwrite=True)
        return index.recover(place, "cap")

    assert broken(0) == "finished" and next(capsules.read_capsule(str(tmp_path / "cap")))[1] == "new0"
    assert broken(1) == "finished" and next(capsules.read_capsule(str(tmp_path / "cap")))[1] == "new1"
    place.write(".cap.journal", json.dumps({"stage": ".cap.none", "old": ".cap.old"}).encode())
    place.rename("cap", ".cap.old")
    assert index.recover(place, "cap") == "restored" and not place.exists(".cap.journal")
    assert index.recover(place, "other") == "discarded"


def test_index_latest_record_counts(spark, tmp_path):
    runs = index.RunIndex(spark, str(tmp_path))
    assert runs.runs().count() == 0
    runs.record("a", "one.zip", alias="best")
    runs.record("b", "two.zip", alias="best", status="failed")
    runs.record("a", "three.zip", status="completed")
    assert {(r.run_id, r.capsule, r.status) for r in runs.runs().collect()} == {("a", "three.zip", "completed"), ("b", "two.zip", "failed")}
    assert capsules.resolve(runs.runs(), runs.aliases(), "best").first().capsule == "two.zip"


def test_store_keeps_each_content_once_and_notices_damage(spark, tmp_path):
    held = store.ContentStore(spark, str(tmp_path))
    df = spark.createDataFrame([(b"x",), (b"y",), (b"x",)], "content binary")
    assert held.put(df).count() == 2
    held.put(df)
    digest = hashlib.sha256(b"x").hexdigest()
    assert held.get_bytes(digest) == b"x" and spark.read.parquet(held.root).count() == 2
    with pytest.raises(FileNotFoundError):
        held.get_bytes("0" * 64)
    spark.createDataFrame([("1" * 64, 1, None, b"z", "11")], store.SCHEMA).write.mode("append").partitionBy("prefix").parquet(held.root)
    with pytest.raises(ValueError):
        held.get_bytes("1" * 64)
    with pytest.raises(ValueError):
        store.ContentStore(spark, "s3a://user:pw@bucket/x")


def test_views_have_only_what_there_is():
    run = {"run_id": "r", "metrics": [{"name": "m"}], "events": [{"a": 1}, {"b": 2}], "metadata": {"git": {"commit": "c"}, "environment": {}}}
    got = capsules.structured_files(run, {"replay": {"input": [1], "state": None}})
    assert got == {"code.json": b'{"commit":"c"}', "training/metrics.json": b'[{"name":"m"}]', "training/events.jsonl": b'{"a":1}\n{"b":2}\n', "replay/inputs.json": b"[1]"}


def test_configuration_keys_and_samples(spark, tmp_path):
    assert files.load_config('[ci]\nconfidence = 0.9\n[impact]\nanything = 1')["ci"] == {"confidence": 0.9}
    for text in ("[ci]\nconfidense = 1", "[other]", "ci = 3"):
        with pytest.raises(ValueError):
            files.load_config(text)
    (tmp_path / "a.csv").write_text("x,y\n" + "1,2\n" * 200)
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n{"x": 5}\n')
    assert files.sample_rows(spark, str(tmp_path / "a.csv")).count() == 128
    assert [files.sample_rows(spark, str(tmp_path / n)).count() for n in ("b.json", "c.jsonl")] == [2, 2] and files.sample_rows(spark, "d.bin") is None
    assert files.schema_sample(spark.range(300).selectExpr("id", "if(id < 3, null, 'x') AS s"), ["id"]).where("column = 's'").first().nulls == 3
    for value in ({"a": [1, 2]}, [{"a": 1}, {"a": 2}], [(1,), (2,)], [1, 2]):
        assert [r[0] for r in files.as_table(spark, value).collect()] == [1, 2]


def test_keys_and_trash(spark, tmp_path):
    keys = spark.createDataFrame([("a/b",), ("a\\b",), ("/a",), ("a//b",), ("a/../b",), ("./a",), (" ",), ("a.b/..c",)], "k string")
    assert [r[0] for r in keys.select(files.safe_key(F.col("k"))).collect()] == ["a/b", "a/b", None, None, None, None, None, "a.b/..c"]
    place = files.Files(spark, str(tmp_path))
    place.write("trash/x", b"1")
    files.restore(place, "trash/x", "back/x")
    assert place.read("back/x") == b"1" and not place.exists("trash/x")
    place.write("trash/x", b"2")
    with pytest.raises(FileExistsError):
        files.restore(place, "trash/x", "back/x")
    files.restore(place, "trash/x", "back/x", overwrite=True)
    assert place.read("back/x") == b"2"
    with pytest.raises(FileNotFoundError):
        files.restore(place, "trash/none", "back/x")


def test_directories_in_any_order(spark, tmp_path):
    for name, text in (("one", "a"), ("two", "b")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text(text)
    paths = [str(tmp_path / n) for n in ("one", "two")]
    a, b = (capsules.dataset_fingerprint(spark, p).first() for p in (paths, paths[::-1]))
    assert a == b and a.files == 2


def test_remote_operations_wait_and_are_applied_in_order(spark, tmp_path):
    from runlens.sources import remote

    class Store(dict):
        def put(self, key, payload):
            if key == "bad":
                raise OSError("no")
            self[key] = payload

        def get(self, key):
            return self[key]

        def delete(self, key):
            self.pop(key)

    told = []
    place = files.Files(spark, str(tmp_path / "queue"))
    offline = remote.Remote(place, audit=told.append)
    offline.put("a", b"1")
    offline.put("bad", b"2")
    offline.put("a", b"3")
    offline.delete("bad")
    with pytest.raises(RuntimeError):
        offline.get("a")
    with pytest.raises(ValueError):
        offline.put("../x", b"")
    held = Store()
    online = remote.Remote(place, held)
    assert online.flush() == [("put", "a", "applied"), ("put", "bad", "failed"), ("put", "a", "applied"), ("delete", "bad", "blocked")]
    assert held == {"a": b"3"} and len(online.waiting()) == 2 and online.get("a") == b"3" and [t["action"] for t in told][:2] == ["queued_put", "queued_put"]


def test_children_are_bounded():
    import sys

    from runlens.sources import remote

    got = remote.execute([sys.executable, "-c", "import os; print('x' * 50 + os.environ['API_KEY'])"], max_output=30, extra_env={"API_KEY": "hush-hush"})
    assert got["exit_code"] == 0 and got["cut"] and "hush" not in got["stdout"] and "<redacted>" in got["stdout"]
    got = remote.execute([sys.executable, "-c", "import time; time.sleep(60)"], timeout=0.5)
    assert got["stopped"] and got["exit_code"] != 0 and got["seconds"] < 30


def test_traces_are_attached(spark, tmp_path):
    a, b = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    capsules.write_capsule(a, {"run_id": "r"}, {"m": b"1"})
    rows = spark.createDataFrame([("g", "1", "ancestor", "0"), ("g", "0", "missing", "evicted")], "g string, node string, part string, detail string")
    assert index.attach_trace(a, b, rows) == {"ancestor": 1, "missing": 1}
    got = {r[3]: r for r in capsules.read_capsule(b)}
    assert json.loads(got["failure/tensor_trace.json"][6])["missing_history"] and got["m"][6] == b"1"
    with pytest.raises(ValueError):
        index.attach_trace(a, b, rows, max_rows=1)
