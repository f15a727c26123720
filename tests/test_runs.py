"""Runs, caches, the command line and the smaller sinks."""

import json

import pytest

from quernstone import __main__ as cli
from quernstone import session
from quernstone.operators import spaces
from quernstone.sources import runs, sinks


def test_identity_and_sealing(spark, tmp_path):
    a = runs.identity({"x": [("f", 1, 2)]}, "c", {"k": 1})
    assert a == runs.identity({"x": [("f", 1, 2)]}, "c", {"k": 1}) and len({a, runs.identity({"x": [("f", 1, 3)]}, "c", {"k": 1}), runs.identity({"x": [("f", 1, 2)]}, "d", {"k": 1}), runs.identity({"x": [("f", 1, 2)]}, "c", {"k": 2})}) == 4
    root, made = str(tmp_path), []

    def make():
        made.append(1)
        return spark.range(7)

    assert runs.last_good(spark, root, "q") is None
    assert runs.run(spark, root, "q", make, "one")[1] == 7 and runs.run(spark, root, "q", make, "one")[1] == 7 and len(made) == 1
    runs.run(spark, root, "q", lambda: spark.range(3), "two")
    assert runs.last_good(spark, root, "q").count() == 3
    with pytest.raises(ZeroDivisionError):
        runs.run(spark, root, "q", lambda: 1 / 0, "three")
    assert runs.last_good(spark, root, "q").count() == 3  # a failed run moves no pointer, and leaves no lock
    # a folder without its marker is made again
    (tmp_path / "q" / "one" / "complete.json").unlink()
    runs.run(spark, root, "q", make, "one")
    assert len(made) == 2
    got = {(r["name"], r["run_id"]): (r["sealed"], r["rows"], r["last_good"]) for r in runs.status(spark, root)}
    assert got == {("q", "one"): (True, 7, True), ("q", "two"): (True, 3, False)}


def test_one_writer(spark, tmp_path):
    folder = runs.Folder(spark, str(tmp_path / "w"))
    with runs.locked(folder):
        with pytest.raises(runs.Busy):
            with runs.locked(folder):
                pass
    with runs.locked(folder):
        pass


def test_cache(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(4)
    for key in ({"model": "m", "text": "t"}, {"model": "m", "text": "t"}, {"model": "n", "text": "t"}):
        assert runs.cached(spark, str(tmp_path), key, make).count() == 4
    assert len(made) == 2


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "p5_found" in capsys.readouterr().out.split()
    for _ in range(2):
        assert cli.main(["run", "versions_latest", "--data", sf, "--out", str(tmp_path), "--limit", "1"]) == 0
        told = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert told["rows"] == spark.read.parquet(told["folder"] + "/rows").count() > 0
    cli.main(["status", "--out", str(tmp_path)])
    assert [json.loads(x)["sealed"] for x in capsys.readouterr().out.strip().split("\n")] == [True]
    with pytest.raises(SystemExit):
        cli.main(["run", "unknown", "--data", sf, "--out", str(tmp_path)])


def test_html_and_json_files(spark, tmp_path):
    sinks.export_html(spark.createDataFrame([("a<b&c", None)], "x string, y int"), str(tmp_path / "h"), "T & U")
    page = "".join(p.read_text() for p in sorted((tmp_path / "h").glob("part-*")))
    assert "<td>a&lt;b&amp;c</td><td></td>" in page and page.count("<table>") == page.count("</table>") >= 1 and "T &amp; U" in page
    for name, content in {"a": b'{"k": [1, {"x": 2}]}', "b": b"[1]", "c": b"{", "d": b"\xff"}.items():
        (tmp_path / f"{name}.json").write_bytes(content)
    good, bad = sinks.read_json_files(spark, str(tmp_path))
    assert [r.object for r in good.collect()] == ['{"k": [1, {"x": 2}]}'] and sorted(r.reason for r in bad.collect()) == ["not_object", "not_utf8", "syntax"]


def test_written_tables(spark):
    df = session.settled(spark.range(5))
    assert df.count() == 5 and session.release(spark) >= 1 and session.release(spark) == 0
    assert session.settled(spark.range(0)).count() == 0
    assert session.plan_bytes(spark.range(10)) >= 0


def test_spaces():
    space = spaces.default_space()
    assert len(spaces.configurations(space)) == 405 and spaces.configurations(space)[0] == {**spaces.BASE}
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in space["weights"])
    off = {**spaces.BASE, "weights": {"quality": 0.5, "value": 0.0, "growth": 0.3, "balance": 0.2}}
    assert all(w["value"] == 0 and abs(sum(w.values()) - 1) < 1e-9 for w in spaces.default_space(off)["weights"])
    spaces.check_space(space)
    for bad in ({}, {"x": [1]}, {"min_roe": []}, {"min_roe": [0.0]}, {"max_net_debt_to_cfo": [9.0]}, {"weights": [{"quality": 1.0, "value": 0.0, "growth": 0.0, "balance": 0.0}]}):
        with pytest.raises(ValueError):
            spaces.check_space(bad)
    order = sorted([(3, 80.0, 0.1), (5, 60.0, 0.0), (5, 70.0, 0.5), (9, 99.0, 0.0)], key=lambda c: spaces.beam_order(*c, target=5))
    assert order == [(5, 70.0, 0.5), (5, 60.0, 0.0), (9, 99.0, 0.0), (3, 80.0, 0.1)]
    assert spaces.distance(spaces.BASE) == 0 and spaces.distance({**spaces.BASE, "min_roe": spaces.BASE["min_roe"] * 2}) == 1
