import os

import pytest
from pyspark.sql import functions as F

from codestrata.api import Index
from codestrata.operators.notes import NoteStore

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def test_endpoints(spark, tmp_path):
    ix = Index(spark, FOLDER, NoteStore(spark, str(tmp_path / "n")))
    o = ix.overview()
    assert o["languages"].count() and o["kinds"].count() and o["folders"].count() and o["hotspots"].count() <= 10
    s = ix.symbols.where("kind = 'function' and name is not null").orderBy("id").first()
    hit = ix.find_symbol(s.name).first()
    assert hit.name == s.name and hit.is_exact == 1 and hit.callers >= 0
    assert ix.suggestions(s.name[:-1]).count()
    c = ix.get_context(s.file, s.name)
    assert c["symbol"].count() >= 1 and c["symbols"].count() >= 1 and c["callers"].columns == ["id", "source_id", "file", "line"]
    assert ix.find_references(s.file, s.name).columns[-1] == "rank"
    assert ix.impact(s.file, s.name, depth=2).columns[0] == "root"
    ch = ix.changes(spark.createDataFrame([(s.file, "modified", None)], "path string, status string, orig_path string"))
    assert [r.file for r in ch["files"].collect()] == [s.file]
    assert ix.search_structure(query=s.name).count() and ix.search_structure(pattern="emit($A)", language="ts").columns == ["path", "line", "snippet"]
    with pytest.raises(ValueError):
        ix.search_structure()
    assert o["entry_points"].count() <= 15 and {"callees", "complexity_label"} <= set(ix.find_symbol(s.name).columns)
    assert c["body"].first().body and c["coupling"].columns[0] == "root" and {"id", "name"} <= set(c["callees"].columns)
    assert ix.get_context(s.file)["export_callers"].columns == ["file", "names"]
    assert ix.impact_totals(s.file, s.name).columns[:3] == ["root", "callers", "files"]
    m = ix.remember("Holds too.", [f"{s.file}:{s.name}:1", f"{s.file}:no_such_thing"], "2024-01-02")
    held = {(a.file, a.symbol) for a in ix.store.read().where(F.col("id") == m).first().anchors}
    assert held == {(s.file, s.name), (s.file, None)}
    assert ix.get_context(s.file, s.name)["notes"].first().note_id == m
    assert ix.overview()["knowledge"].first().anchored == 1 and "suspects" in ix.changes(spark.createDataFrame([(s.file, "modified", None)], "path string, status string, orig_path string"))
    assert ix.forget(m)
    n = ix.remember("Holds.", [{"file": s.file, "symbol": s.name}], "2024-01-01")
    got = ix.recall(file=s.file).first()
    assert got.id == n and got.verdict in ("fresh", "unverified") and ix.forget(n) and ix.recall().count() == 0
