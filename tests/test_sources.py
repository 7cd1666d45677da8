"""File trees, the command line, and the file stream."""

from __future__ import annotations

import json

from umbra.__main__ import main
from umbra.plans.policy import Policy
from umbra.sources import tree
from umbra.streaming import files

SALT = b"s"


def _tree(at):
    (at / "in/sub").mkdir(parents=True)
    (at / "in/.git").mkdir()
    (at / "in/a.cfg").write_bytes(b"hostname a\r\nenable secret S\r\n")
    (at / "in/sub/b.cfg").write_text("ip host 10.0.0.1\n")
    (at / "in/bin").write_bytes(b"a\0b")
    (at / "in/key").write_text("\n-----BEGIN RSA KEY\n")
    (at / "in/.git/c").write_text("x\n")
    (at / "in/latin").write_bytes(b"caf\xe9\n")
    return at / "in"


def test_reasons(spark, tmp_path):
    rows = {r.path.rsplit("/", 1)[1]: r.reason for r in tree.read_tree(spark, [str(_tree(tmp_path))]).collect()}
    assert rows == {"a.cfg": None, "b.cfg": None, "bin": "binary", "key": "pem", "latin": "not utf-8"} | ({"c": "dotfile"} if "c" in rows else {})


def test_command_line(spark, tmp_path, capsys):
    source, policy = _tree(tmp_path), tmp_path / "p.toml"
    policy.write_text('salt_file = "' + str(tmp_path / "salt") + '"\n[ipv4]\ndefault = "pseudo"\n')
    assert main([str(source), "-o", str(tmp_path / "out"), "-c", str(policy), "--map-out", str(tmp_path / "map"), "-R", "--strict"]) == 0
    assert (tmp_path / "out/a.cfg").read_bytes().endswith(b"hostname a\r\nenable secret <REMOVED>\r\n")
    assert "umbra-sanitised" in (tmp_path / "out/sub/b.cfg").read_text().splitlines()[0]
    assert [list(m) for m in json.loads((tmp_path / "map").read_text()).values()] == [["v4net"]]
    assert (tmp_path / "salt").stat().st_mode & 0o777 == 0o600
    assert "skipped: binary" in capsys.readouterr().err
    again = tree.read_tree(spark, [str(tmp_path / "out")]).select("reason").distinct().collect()
    assert [r.reason for r in again] == ["already sanitised"]


def test_wrong_use():
    import pytest

    for argv in ([], ["x", "-r", "-o", "y"], ["/nonexistent", "-r"], ["-c", "/nonexistent", "x"], ["--what"]):
        with pytest.raises(SystemExit) as e:
            main(argv)
        assert e.value.code == 1
    assert main(["--list-rules"]) == main(["--print-config"]) == 0


def test_colliding_destinations(spark):
    rows = spark.createDataFrame([("a/x", "o/x"), ("b/x", "o/x"), ("b/y", "o/y")], "path string, dest string")
    assert [(r.dest, r.n) for r in tree.collisions(rows).collect()] == [("o/x", 2)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.cfg").write_text("enable secret S\n")
    for _ in range(2):
        files.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), Policy(), SALT, once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.lines for r in rows] == [["enable secret <REMOVED>"]]
