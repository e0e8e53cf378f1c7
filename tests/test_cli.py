from helpers import SF
from test_sources import HEADER, workbook

from partloom import cli
from partloom.plans.bom import bom_rows


def test_load_graph_and_search(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    workbook(tmp_path / "in" / "a.xlsx", [("Master", [(2, HEADER), (3, ["1", ".1", "AEC00000001", "←", "Motor", "x"])]), ("History", [(2, HEADER), (3, ["1", ".1", "A", "B", "C", "d"])])])
    cli.main(["load", str(tmp_path / "in"), f"{tmp_path}/rows"])
    assert [r.part_name for r in spark.read.parquet(f"{tmp_path}/rows").collect()] == ["Motor"]
    bom_rows(spark, SF).write.parquet(f"{tmp_path}/bom")
    cli.main(["graph", f"{tmp_path}/bom", f"{tmp_path}/graph"])
    assert spark.read.parquet(f"{tmp_path}/graph/impact_edges").count() > 0
    cli.main(["impact", f"{tmp_path}/bom"])
    assert "direct" in capsys.readouterr().out
    cli.main(["search", f"{SF}/documents.parquet", "the of", "-k", "3"])
    assert "doc_id" in capsys.readouterr().out
