"""Tables kept for a folder follow its files."""

import os
import shutil
from collections import OrderedDict

from factorloom.plans import panels as pl

SF = "/root/testdata/sf0.001"


def test_changed_files_give_new_tables_and_remove_the_old(spark, tmp_path):
    folder = str(tmp_path / "sf")
    os.makedirs(folder)
    for t in ("lineitem", "orders"):
        shutil.copy(f"{SF}/{t}.parquet", folder)
    first = pl.panels(spark, folder)
    n = first["b_daily"].count()
    assert n > 0 and pl.panels(spark, folder) is first
    kept = first.folder.removeprefix("file:")
    assert os.path.isdir(kept)
    os.remove(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(100).write.parquet(f"{folder}/lineitem.parquet")
    second = pl.panels(spark, folder)
    assert second is not first and 0 < second["b_daily"].count() < n and not os.path.exists(kept)


def test_the_folder_not_used_for_longest_goes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pl, "_PANELS", OrderedDict())
    monkeypatch.setattr(pl, "KEPT", 2)
    made = {x: pl.panels(spark, str(tmp_path / x)) for x in "ab"}
    assert pl.panels(spark, str(tmp_path / "a")) is made["a"]
    pl.panels(spark, str(tmp_path / "c"))
    assert [key[1][-1] for key in pl._PANELS] == ["a", "c"]
    assert pl.panels(spark, str(tmp_path / "b")) is not made["b"]
