import pytest

from geolattice.__main__ import main


def test_commands(spark, tmp_path, capsys):
    source = tmp_path / "p.txt"
    source.write_text("X\tY\tID\tNAME\n-73.985\t40.757\t1\ta\n-73.985\t40.757\t2\tb\n-73.97\t40.75\t3\ta\nbad\t40\t4\ta\n")
    table = str(tmp_path / "t")
    with pytest.raises(Exception):  # noqa: B017
        main(["ingest", str(source), table], spark)
    assert main(["ingest", str(source), table, "--lenient"], spark) == 2
    wkt = "POLYGON ((-74 40.7, -73.98 40.7, -73.98 40.8, -74 40.8, -74 40.7))"
    assert main(["within", table, wkt], spark) == 1 == main(["within", table, wkt, "--full-scan"], spark)
    assert main(["knn", table, "-73.97", "40.75", "5"], spark) == 2 and main(["knn", table, "-73.97", "40.75", "5", "--cells"], spark) == 1
    assert main(["earliest", table, "name", "id", "1"], spark) == 2
    out = capsys.readouterr().out
    assert "<QueryMatch:    2, " in out and "rows, " in out
    assert main(["generate", str(tmp_path / "g"), "50", "-76", "-75", "44", "45", "--seed", "3"], spark) == 50
    with pytest.raises(SystemExit):
        main(["generate", str(tmp_path / "h"), "50", "-75", "-76", "44", "45"], spark)
