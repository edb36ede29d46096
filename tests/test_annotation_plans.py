"""Annotation files are parsed once, whatever is asked of their objects."""

from flightframe.sources import annotations as A


def test_files_are_parsed_once(spark):
    box = "<object><motion>moving</motion><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>5</xmax><ymax>5</ymax></bndbox></object>"
    files = spark.createDataFrame([("a.xml", f"<annotation>{box * 3}</annotation>")], "path string, xml string")
    objects = A.parse_annotations(files)
    plan = objects._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("generate explode") + plan.count("from_xml(") + plan.count("xmltostructs(") > 0 and plan.count("join") == 0
    assert [r.error for r in objects.orderBy("object_index").collect()] == [None, "duplicate_object", "duplicate_object"]
