"""Statement files of several encodings, larger than one row or one split may be."""

import pytest

from tallybridge.sources import files as fs

HEAD = "Datum,Beskrivning,Kortmedlem,Konto #,Belopp,Ort,Referens"


def _rows(first, last, city):
    return "".join(f'08/{n % 28 + 1:02d}/2026,"Café\n{n}",M,-40115,"1 000,50",{city},\'R{n}\'\n' for n in range(first, last))


@pytest.fixture
def tight(spark):
    """No row may hold a whole file, and every file has many splits."""
    names = {"spark.sql.sources.binaryFile.maxLength": "200", "spark.sql.files.maxPartitionBytes": "256"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_statement_files_need_not_fit_a_row(spark, tmp_path, tight):
    (tmp_path / "a b+c.csv").write_bytes(("﻿" + HEAD + "\n" + _rows(0, 40, "Malmö")).encode("utf-8"))
    # Only the last line tells the encoding.
    (tmp_path / "win.csv").write_bytes((HEAD + "\n" + _rows(40, 80, "Lund") + _rows(80, 81, "€uro")).encode("cp1252"))
    (tmp_path / "latin.csv").write_bytes((HEAD + ",Land\n").encode() + b"08/01/2026,X,M,-40115,\"2,00\",\xe5\x81,'R81',SE\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    got = {r.ref: r for r in fs.read_statement(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(f"R{n}" for n in range(82))
    assert {r.merchant.split(" ")[0] for n, r in got.items() if n != "R81"} == {"Café"}
    assert (got["R0"].city, got["R39"].city, got["R40"].city, got["R80"].city, got["R81"].city) == ("Malmö", "Malmö", "Lund", "€uro", "å\x81")
    assert got["R81"].country == "SE" and got["R80"].country is None


def test_no_statement_header(spark, tmp_path, tight):
    (tmp_path / "other.csv").write_text("Datum,Belopp\n" + HEAD + "\n")
    with pytest.raises(ValueError, match="missing columns: Beskrivning, Konto #, Referens"):
        fs.read_statement(spark, str(tmp_path))
