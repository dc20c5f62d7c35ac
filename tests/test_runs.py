"""Run files as the matcher writes them, and files of one run per line."""

import json

from tallybridge.sources import files as fs


def run(n, rows=1):
    return {"run": {"run_at": f"2026-01-0{n}T10:00:00", "mailbox": f"box{n}"}, "rows": [{"row_key": f"k{n}-{i}", "candidates": i} for i in range(rows)]}


def test_indented_and_line_wise_files(spark, tmp_path):
    (tmp_path / "indented.json").write_text(json.dumps(run(1, 2), indent=1))
    (tmp_path / "one.json").write_text(json.dumps(run(2)))
    (tmp_path / "lines.json").write_text("{ not json\n" + json.dumps(run(3)) + "\n\n" + json.dumps(run(4)) + "\n")
    (tmp_path / "marked.json").write_text("﻿" + json.dumps(run(5), indent=1))
    (tmp_path / "cut.json").write_text(json.dumps(run(6), indent=1)[:-30])
    (tmp_path / "two.json").write_text(json.dumps(run(7), indent=1) + "\n" + json.dumps(run(8), indent=1))
    got = fs.read_runs(spark, str(tmp_path))
    assert sorted(r.row_key for r in got.collect()) == ["k1-0", "k1-1", "k2-0", "k3-0", "k4-0", "k5-0"]
    assert {r.run_date for r in got.filter("mailbox = 'box1'").collect()} == {"2026-01-01"}
    bad = fs.unreadable_runs(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.value[:10]) for r in bad) == [("cut.json", '{\n "run": '), ("lines.json", "{ not json"), ("two.json", '{\n "run": ')]
