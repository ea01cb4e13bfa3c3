import posixpath

from pyspark.sql import functions as F

from logloom.functions import paths


def test_clean_path(spark):
    cases = ["/a/b/../c", "a//b/./c", "../x", "/..", "", "/", "a/../..", "/a/./", "x/y/../../z", "../../a/.."]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = [r.c for r in df.select("p", paths.clean_path(F.col("p")).alias("c")).collect()]
    assert got == [posixpath.normpath(c) if c else "." for c in cases]


def test_roots_names_and_sql(spark):
    df = spark.createDataFrame([("/home/me/other/x.py", "/home/me/proj", "-home-me-proj")], "p string, c string, d string")
    r = df.select(paths.external_root(F.col("p"), F.col("c")).alias("r"), paths.project_name(F.col("d")).alias("n"), paths.path_suffix_match(F.col("p"), "x.py").alias("m")).first()
    assert (r.r, r.n, r.m) == ("/home/me/other", "proj", True)
    paths.register(spark)
    assert tuple(spark.sql("select grade(91), grade(40), retry_signature('Read', '/a', null), project_name('-x-y')").first()) == ("A", "F", "Read:/a", "y")
