"""Image files, JSON documents and trace lines, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import schemas

#: The picture suffixes, and the limits of trace lines.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
LINE_BYTES, LINES = 16 * 1024, 100_000


def classify(paths: DataFrame) -> DataFrame:
    """job, kind, problem of a job's input paths (job, ord, path): images, pdf or pptx.

    A PDF or PPTX must be the only input.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    g = paths.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.count_if(ext == "pdf").alias("pdf"), F.count_if(ext.isin("pptx")).alias("pptx"))
    kind = F.when(F.col("pdf") > 0, "pdf").when(F.col("pptx") > 0, "pptx").otherwise("images")
    return g.select("job", kind.alias("kind"), F.when((F.col("pdf") + F.col("pptx") > 0) & (F.col("n") > 1), "must_be_the_only_input").alias("problem"))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ordinal, page_id, path, length, sha256, content of image files.

    Each path is a file or a folder, of which the first level is read.  Order: the
    arguments' order, inside a folder by (case-folded name, name).
    """
    parts = []
    for i, p in enumerate(paths):
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(p).filter(is_image(F.col("path")))
        parts.append(df.select(F.lit(i).alias("arg"), "path", "length", F.sha2("content", 256).alias("sha256"), "content"))
    every = parts[0]
    for df in parts[1:]:
        every = every.unionAll(df)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    slim = every.select("arg", "path", F.lower(name).alias("folded"), name.alias("name"))
    place = F.row_number().over(Window.orderBy("arg", "folded", "name"))  # one row a file: a listing, not the data
    order = slim.select("path", "arg", (place - 1).alias("ordinal"))
    return every.join(order, ["arg", "path"]).select("ordinal", F.format_string("page_%03d", F.col("ordinal") + 1).alias("page_id"), "path", "length", "sha256", "content")


def file_hashes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, length, sha256, problem: content hashes; files over `limit` bytes are refused."""
    df = spark.read.format("binaryFile").load(path)
    if limit is None:
        return df.select("path", "length", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("problem"))
    small = df.filter(F.col("length") <= limit).select("path", "length", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("problem"))
    return small.unionAll(df.filter(F.col("length") > limit).select("path", "length", F.lit(None).cast("string"), F.lit("too_large")))


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, rgb: decoded rasters; Spark's source gives BGR, turned here."""
    df = spark.read.format("image").load(path).select("image.*")

    def turn(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                out.append((np.repeat(a, 3, axis=2) if r.nChannels == 1 else a[:, :, 2::-1]).tobytes())
            yield pd.DataFrame({"path": pdf["origin"], "height": pdf["height"], "width": pdf["width"], "rgb": out})

    return df.mapInPandas(turn, "path string, height int, width int, rgb binary")


def trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trace events of JSON lines, with file and line problem flags: rows that can't be parsed
    or are too long keep problem set and null fields."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name())
    event = F.from_json("value", schemas.TRACE, {"mode": "PERMISSIVE"})
    long = F.octet_length("value") > LINE_BYTES
    parsed = lines.select("path", long.alias("long"), F.when(~long, event).alias("e"), F.when(~long, F.from_json("value", "map<string,string>")).alias("m"))
    fields = [f.split()[0] for f in schemas.TRACE.split(", ")]
    unknown = F.size(F.array_except(F.map_keys("m"), F.array(*[F.lit(f) for f in fields])))
    problem = F.when(F.col("long"), "too_long").when(F.col("m").isNull() | F.col("e.event").isNull(), "not_an_event").when(F.size("m") > 16, "too_many_fields").when(unknown > 0, "unknown_field").when(F.col("e.schema_version") != 1, "schema_version")
    return parsed.select("path", problem.alias("problem"), "e.*")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, objects only: path, document (variant-like string), sha256."""
    df = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.trim("value").alias("document"))
    return df.filter(F.col("document").startswith("{") & F.json_object_keys("document").isNotNull()).withColumn("sha256", F.sha2("document", 256))


def model_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row a model of a catalog file {"models": [...]}."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("models").alias("m")).select("m.*")


def image_job(files: DataFrame) -> DataFrame:
    """page_id, source, sha256, state: the page rows of an image job; files: ordinal, path, sha256."""
    return files.select(F.format_string("page_%03d", F.col("ordinal") + 1).alias("page_id"), F.col("path").alias("source"), "sha256", F.lit("pending").alias("state"))


def pdf_job(pages: DataFrame, profile: str = "standard") -> DataFrame:
    """document, page_id, pixels, scale, reasons, same_ratio of PDF pages (document, ord, width, height)."""
    from docloom.functions import geometry as g

    plan = g.render_plan(F.col("width"), F.col("height"), profile)
    p = pages.withColumn("reasons", plan["reasons"]).withColumn("scale", g.safe_scale(F.col("width").cast("double"), F.col("height").cast("double"), plan["scale"]))
    p = p.withColumn("pixel_width", g.pixel_size(F.col("width"), F.col("scale"))).withColumn("pixel_height", g.pixel_size(F.col("height"), F.col("scale")))
    first = F.first(F.col("width") / F.col("height")).over(Window.partitionBy("document").orderBy("ord"))
    p = p.withColumn("same", g.same_ratio(first, F.col("width") / F.col("height")))
    every = F.bool_and("same").over(Window.partitionBy("document"))
    return p.select("document", F.format_string("page_%03d", F.col("ord") + 1).alias("page_id"), "pixel_width", "pixel_height", "scale", (F.col("scale") * 72).alias("effective_dpi"), "reasons", every.alias("same_ratio"))
