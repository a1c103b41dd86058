"""The background loop and the health endpoints."""

import time
import urllib.error
import urllib.request

import pytest

from tidemark.daemon import Service, check_writable
from tidemark.engine import Engine
from tidemark.model import NEW_POINTS, ConfigError, EngineConfig, SegmentConfig


def get(port, path):
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{port}{path}", timeout=10) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def test_service(spark, tmp_path):
    seen = []
    config = EngineConfig(flush_interval_s=0.2, snapshot_interval_s=3600, segment_store=SegmentConfig(l0_compaction_trigger_segment_count=2), event_listener=lambda n, f: seen.append(n))
    e = Engine(spark, f"file://{tmp_path}/db", config)
    s = Service(e, port=0)
    assert s.answer("/readyz")[0] == 503
    s.start()
    assert get(s.port, "/healthz") == (200, "ok\n") and get(s.port, "/readyz")[0] == 200 and get(s.port, "/x")[0] == 404
    e.ingest(spark.createDataFrame([("s", 1, 1.0, {})], NEW_POINTS))
    until = time.monotonic() + 60
    while not e.manifest.segments and time.monotonic() < until:
        time.sleep(0.2)
    assert e.query("s").count() == 1 and "tidemark_flush_points_total 1" in get(s.port, "/metrics")[1]
    e.ingest(spark.createDataFrame([("s", 2, 2.0, {})], NEW_POINTS))
    s.stop()
    assert e.query("s").count() == 2 and seen[0] == "FlushThreadStarted" and "FlushThreadStopping" in seen


def test_writable(tmp_path):
    check_writable(str(tmp_path / "new"))
    (tmp_path / "file").write_text("")
    with pytest.raises(ConfigError):
        check_writable(str(tmp_path / "file"))


def test_validate_settings(tmp_path, capsys):
    from tidemark.daemon import main

    f = tmp_path / "c.toml"
    f.write_text("flush_interval_s = 2\n[segment_store]\nenable_tag_index = true\n")
    main(["--config", str(f), "--set", "segment_store.enable_tag_index=false", "--validate-config"])
    assert "hold" in capsys.readouterr().out
    for bad in (["--set", "flush=1"], ["--set", "flush_interval_s"], ["--set", "segment_store.encoding.compression=rar"], ["--config", str(tmp_path / "none")], ["--http-bind", "x:y"]):
        with pytest.raises(SystemExit) as x:
            main([*bad, "--validate-config"])
        assert x.value.code == 2


def test_a_stop_does_not_wait_for_ever(spark, tmp_path):
    import threading

    e, held = Engine(spark, f"file://{tmp_path}/db", EngineConfig(flush_interval_s=0.05)), threading.Event()
    e.flush = lambda: held.wait(60)
    e.start()
    time.sleep(0.3)
    began = time.monotonic()
    e.close(0.5)
    assert time.monotonic() - began < 10
    held.set()
