"""Files written and read by tasks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import components, integrity, patches, polygons
from tidemark.plans import fixtures as fx
from tidemark.sources import tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_documents_of_one_partition_are_written_and_hashed_by_many_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    texts = spark.range(40).select(F.concat(F.lit("é "), "id").alias("value"), F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("a/b="), F.col("id") % 4)).alias("k")).coalesce(1)
    tables.write_documents(texts, path, ["k"])
    files = glob.glob(f"{tmp_path}/out/*/*")
    assert len(files) == 40 and len({os.path.basename(f).split("-")[1] for f in files}) > 1
    read = spark.read.text(path).select("value", "k").collect()
    assert sorted(map(tuple, read), key=str) == sorted(map(tuple, texts.collect()), key=str)
    hashed = tables.file_inventory(spark, path, 1)
    assert hashed.rdd.getNumPartitions() > 1 and hashed.count() == 40
    assert {r.sha256 for r in hashed.collect()} == {r[0] for r in texts.select(F.sha2(F.concat("value", F.lit("\n")), 256)).collect()}
    with pytest.raises(Exception, match="exists"):
        tables.write_documents(texts, path, ["k"])


def test_scene_features_are_read_once(spark):
    df = plans.QUERIES["s02_scene_features"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_xml_is_parsed_once_for_all_names_and_in_many_tasks(spark):
    found = plans.QUERIES["c06_xml_fields"](spark, SF)
    assert "xpath" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found.rdd.getNumPartitions() > 1


def test_xml_texts_agree_with_xpath(spark):
    texts = ["<r><n:a>1 <b> x </b>\n2<!-- c -->3<a>4</a></n:a><c a='no'/><a> </a>&lt;<b>&#233;<?i?>f</b></r>", "<a>top</a>", "<r><a><![CDATA[<q>]]></a><x:y:b>7</x:y:b></r>".replace("x:y:b", "y:b"), "<r/>", "", None, "<r><a>" + "w " * 9000 + "</a></r>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, xml string")
    path = lambda n: F.filter(F.transform(F.xpath("xml", F.lit(f"//*[name()='{n}' or substring-after(name(), ':')='{n}']/text()")), lambda v: F.trim(v, F.lit(" \t\r\n"))), lambda v: v != "")
    want = docs.select("k", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), path(n).alias("values")) for n in "abr"])).alias("f")).select("k", "f.*").filter(F.size("values") > 0)
    rows = lambda df: sorted((r.k, r.name, tuple(r["values"])) for r in df.collect())
    assert rows(integrity.xml_fields(docs, ["a", "b", "r"], ["k"])) == rows(want)
    with pytest.raises(Exception, match="ExpatError"):
        integrity.xml_fields(spark.createDataFrame([(1, "<a>")], "k int, xml string"), ["a"], ["k"]).collect()


def test_edges_of_rings_closed_unclosed_empty_and_null(spark):
    p = lambda *points: [{"x": float(x), "y": float(y)} for x, y in points]
    rings = [p((0, 0), (2, 0), (2, 1)), p((0, 0), (1, 0), (0, 1), (0, 0)), [], None, p((5, 5))]
    shapes = spark.createDataFrame([([[r for r in rings]],), ([],), (None,)], "geometry array<array<array<struct<x:double,y:double>>>>")
    got = [r[0] and [tuple(e) for e in r[0]] for r in shapes.select(polygons.flat_edges("geometry")).collect()]
    assert got == [[(0, 0, 2, 0), (2, 0, 2, 1), (2, 1, 0, 0), (0, 0, 1, 0), (1, 0, 0, 1), (0, 1, 0, 0)], [], None]
    plan = shapes.select(polygons.box_of("geometry"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_shapes_of_several_wholes_are_clipped_in_one_batch(spark):
    square = lambda x, n: [(x, 0.0, x + n, 0.0), (x + n, 0.0, x + n, n), (x + n, n, x, n), (x, n, x, 0.0)]
    edges = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    wholes = spark.createDataFrame([(k, square(0.0, 4.0 + k)) for k in range(30)], f"k int, edges {edges}")
    shapes = spark.createDataFrame([(k, i, square(2.0 + i, 3.0)) for k in range(30) for i in range(6)] + [(99, 0, square(0.0, 1.0))], f"k int, i int, edges {edges}").coalesce(1)
    got = {(r.k, r.i): r.clip_area for r in polygons.clipped(shapes, wholes, "k").collect()}
    assert got == {(k, i): pytest.approx(3.0 * max(0.0, min(3.0, 4.0 + k - 2.0 - i))) for k in range(30) for i in range(6)}


def test_few_bytes_of_outlines_tiles_and_orders_go_to_many_tasks(spark):
    labels = spark.range(60).selectExpr("id AS k", "0 AS row", "cast(id * 3 AS int) AS col")
    rings = patches.outlines(labels, ["k"])
    assert rings.rdd.getNumPartitions() >= 4 and rings.count() == 60
    cells = spark.range(60).selectExpr("1 AS pair_id", "cast(id * 600 AS int) AS row", "1 AS col")
    assert components.labelled(cells).select("label").distinct().count() == 60
    assert fx.raw_pixels(spark, SF).rdd.getNumPartitions() >= 4
