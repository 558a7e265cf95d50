"""Documents to files of their own, and GPX files read in ranges."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wayscope.plans import audit_documents, to_json_rows
from wayscope.schemas import FOUND
from wayscope.sources import found_points, read_gpx, to_gpx
from wayscope.sources.files import MANIFEST, register, split_points, write_documents, write_gpx_files

from .test_segmented import tracks


def test_a_file_per_document(spark, tmp_path):
    docs = audit_documents(spark.createDataFrame(tracks(5, 7), FOUND))
    write_documents(docs, f"{tmp_path}/out")
    want = {f"{r.track_id}.audit.v2.json": json.loads(r.json) for r in to_json_rows(docs).collect()}
    assert set(os.listdir(tmp_path / "out")) == want.keys() | {MANIFEST}
    listed = json.loads((tmp_path / "out" / MANIFEST).read_text())
    assert listed["count"] == 7 and [f["file"] for f in listed["files"]] == sorted(want)
    for f in listed["files"]:
        text = (tmp_path / "out" / f["file"]).read_text()
        assert json.loads(text) == want[f["file"]] and text == json.dumps(want[f["file"]], indent=2, ensure_ascii=False) and len(text.encode()) == f["bytes"]


@pytest.mark.parametrize("bad", ["a/b.json", "twice.json"])
def test_an_aborted_job_leaves_nothing(spark, tmp_path, bad):
    register(spark)
    rows = [(f"d{i}.json", "{}") for i in range(20)] + [("twice.json", "{}"), (bad, "{}")]
    with pytest.raises(Exception, match="one file|not a name"):
        spark.createDataFrame(rows, "file_name string, json string").repartition(4).write.format("audit_documents").mode("append").save(f"{tmp_path}/out")
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


@pytest.mark.parametrize("split", [57, 200, 1000, 1 << 20])
def test_ranges_give_the_points_of_the_whole(spark, tmp_path, split):
    found = spark.createDataFrame(tracks(6, 3), FOUND).withColumn("point_type", F.element_at(F.array(*map(F.lit, ["trkpt", "wpt", "rtept"])), (F.col("gpx_index") % 3 + 1).cast("int")))
    found = found.withColumns({"raw_ele": F.when(F.col("gpx_index") % 2 == 0, "1<2 & \"é\""), "extensions": F.when(F.col("gpx_index") % 5 == 0, "<x:ele xmlns:x=\"u\">7</x:ele>")})
    write_gpx_files(to_gpx(found), str(tmp_path))
    assert {r.file_name: r.xml for r in to_gpx(found).collect()} == {f"t{i}.gpx": (tmp_path / f"t{i}.gpx").read_text() for i in range(3)}
    (tmp_path / "hand.gpx").write_text("<gpx>\n<trk><trkseg><trkpt lon='2' lat='1'/>" + "<trkpt lat=\"3\" lon=\"4\"><time> 2026-01-01T00:00:00Z\n</time><ele>&#65;</ele></trkpt></trkseg></trk><wpt lat=\"é\" lon=\"\"></wpt></gpx>")
    (tmp_path / "none.gpx").write_text("<gpx></gpx>")
    columns = [c for c in FOUND.split(", ")]
    names = [c.split()[0] for c in columns if not c.startswith("extensions")]
    plain = lambda df: sorted(str(tuple(r)) for r in df.select(*names).collect())
    got, want = split_points(spark, str(tmp_path), split), found_points(read_gpx(spark, f"{tmp_path}/*.gpx"))
    assert plain(got) == plain(want)
    own = {(r.track_id, r.gpx_index): r.extensions for r in got.collect()}
    assert own == {(r.track_id, r.gpx_index): r.extensions for r in want.collect()}
    if split == 57:
        assert spark.read.format("gpx_points").option("split", split).load(str(tmp_path)).rdd.getNumPartitions() > 20
