"""Pixel operators on vectors read as 8 x 8 grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.pixels import window_level
from assaykit.operators import images as I
from assaykit.sources.images import read_images
from suite import register
from suite.derived import table
from suite.sources import fresh

PIXELS = "transform(embedding, x -> cast(floor(least(greatest((cast(x AS double) + 0.5D) * 255D, 0D), 255D)) AS int))"
_PIXELS_SQL = "list_transform(embedding, lambda x: floor(least(greatest((x::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE, 0::DOUBLE), 255::DOUBLE))::INT)"
IMAGES_SQL = f"SELECT vec_id, label, {_PIXELS_SQL} AS pixels FROM embeddings"


def images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.expr(PIXELS).alias("pixels"))


def _text(c: str) -> F.Column:
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))


@register(
    "window_level",
    "SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda x: floor(least(greatest((x::DOUBLE * 1000::DOUBLE + 20::DOUBLE) * (255::DOUBLE / 120::DOUBLE), 0::DOUBLE), 255::DOUBLE))::INT), ',')) AS pixels_md5 FROM embeddings",
)
def window(spark: SparkSession, sf: str) -> DataFrame:
    """Level 40, width 120 on values scaled to a raw intensity range."""
    raw = F.transform("embedding", lambda x: x.cast("double") * 1000.0)
    out = table(spark, sf, "embeddings").withColumn("pixels", window_level(raw))
    return out.select("vec_id", _text("pixels").alias("pixels_md5"))


@register("image_histogram", f"SELECT vec_id, bin, count(*) AS n FROM (SELECT vec_id, unnest(pixels) AS bin FROM ({IMAGES_SQL})) GROUP BY vec_id, bin")
def image_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Per-image counts from the array form; empty bins left out to compare."""
    h = I.histograms(images(spark, sf))
    return h.select("vec_id", F.posexplode("hist").alias("bin", "n")).filter(F.col("n") > 0)


@register("image_histogram_rows", f"SELECT vec_id, bin, count(*) AS n FROM (SELECT vec_id, unnest(pixels) AS bin FROM ({IMAGES_SQL})) GROUP BY vec_id, bin")
def image_histogram_rows(spark: SparkSession, sf: str) -> DataFrame:
    return I.histogram_rows(images(spark, sf), "vec_id")


_TOTALS = f"""px AS (SELECT unnest(pixels) AS bin FROM ({IMAGES_SQL})),
totals AS (SELECT b.b AS bin, coalesce(n, 0) AS total FROM range(256) b(b) LEFT JOIN (SELECT bin, count(*) AS n FROM px GROUP BY bin) c ON b.b = c.bin)"""


@register(
    "aggregate_histogram",
    f"WITH {_TOTALS} SELECT bin, total, (SELECT count(*) FROM embeddings) AS n_images, round(total / (SELECT count(*) FROM embeddings), 6) AS mean FROM totals",
)
def aggregate_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return I.aggregate_histogram(images(spark, sf)).withColumn("mean", F.round("mean", 6))


def _match_sql(reference: str, occurring: bool = False) -> str:
    """Cumulative share of each image read off the reference curve by interpolation.

    With ``occurring`` the curve has knots only at levels that the reference holds.
    """
    knots = "WHERE total > 0" if occurring else ""
    return f"""WITH img AS ({IMAGES_SQL}),
    refpx AS (SELECT unnest(pixels) AS bin FROM img WHERE {reference}),
    tot AS (SELECT b.b AS bin, coalesce(n, 0) AS total FROM range(256) b(b) LEFT JOIN (SELECT bin, count(*) AS n FROM refpx GROUP BY bin) c ON b.b = c.bin),
    summed AS (SELECT bin, total, sum(total) OVER (ORDER BY bin)::DOUBLE / (SELECT sum(total) FROM tot)::DOUBLE AS y FROM tot),
    curve AS (SELECT bin, y, lead(bin) OVER (ORDER BY bin) AS nb, lead(y) OVER (ORDER BY bin) AS ny FROM summed {knots}),
    px AS (SELECT vec_id, unnest(pixels) AS v, generate_subscripts(pixels, 1) AS at FROM img),
    h AS (SELECT vec_id, v, count(*) AS n FROM px GROUP BY vec_id, v),
    cdf AS (SELECT vec_id, v, sum(n) OVER (PARTITION BY vec_id ORDER BY v)::DOUBLE / (sum(n) OVER (PARTITION BY vec_id))::DOUBLE AS x FROM h),
    knot AS (SELECT c.vec_id, c.v, c.x, max(r.bin) AS j FROM cdf c LEFT JOIN curve r ON r.y <= c.x GROUP BY c.vec_id, c.v, c.x),
    lut AS (SELECT k.vec_id, k.v, trunc(CASE WHEN k.j IS NULL THEN (SELECT min(bin) FROM curve) WHEN a.nb IS NULL THEN k.j
              ELSE ((a.nb - k.j)::DOUBLE / (a.ny - a.y)) * (k.x - a.y) + k.j END)::INT AS m FROM knot k LEFT JOIN curve a ON a.bin = k.j)
    SELECT p.vec_id, md5(string_agg(l.m::VARCHAR, ',' ORDER BY p.at)) AS pixels_md5 FROM px p JOIN lut l ON l.vec_id = p.vec_id AND l.v = p.v GROUP BY p.vec_id"""


@register("harmonise_pool", _match_sql("label < 5"))
def harmonise_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Every image matched to the average histogram of the reference classes."""
    img = images(spark, sf)
    out = I.harmonise(img, img.filter(F.col("label") < 5))
    return out.select("vec_id", _text("matched").alias("pixels_md5"))


@register("harmonise_single_reference", _match_sql("vec_id = (SELECT min(vec_id) FROM embeddings)", occurring=True))
def harmonise_single_reference(spark: SparkSession, sf: str) -> DataFrame:
    img = images(spark, sf)
    first = img.agg(F.min("vec_id")).scalar()
    out = I.match_image(img, img.filter(F.col("vec_id") == first))
    return out.select("vec_id", _text("matched").alias("pixels_md5"))


def _png(pixels: bytes, side: int, colour: bool) -> bytes:
    """A PNG of side x side pixels: gray bytes or RGB triples."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    width = side * (3 if colour else 1)
    raw = b"".join(b"\0" + pixels[i : i + width] for i in range(0, len(pixels), width))
    head = struct.pack(">IIBBBBB", side, side, 8, 2 if colour else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


# One image file per vector; odd labels in colour, every tenth label broken.
_PIXELS = f"SELECT vec_id, label, unnest(pixels[:64]) AS v, generate_subscripts(pixels[:64], 1) AS pl FROM ({IMAGES_SQL})"
_GRAY = "CASE WHEN label % 2 = 1 THEN floor(((255 - v) * 19595 + v * 38470 + floor(v / 2) * 7471 + 32768) / 65536) ELSE v END"


@register(
    "image_files",
    f"SELECT (label % 10 <> 9) AS valid, CASE WHEN label % 10 <> 9 THEN md5(string_agg(({_GRAY})::INT::VARCHAR, ',' ORDER BY pl)) END AS pixels_md5, CASE WHEN label % 10 <> 9 THEN 8 END AS h FROM ({_PIXELS}) GROUP BY vec_id, label",
)
def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """A gray, colour or broken image file for every vector, written by Spark; all of them come back."""
    one = images(spark, sf).select("label", F.slice("pixels", 1, 64).alias("px"))

    @F.pandas_udf("binary")
    def encoded(label, px):
        def file(n, p):
            if n % 10 == 9:
                return b"no image"
            if n % 2 == 0:
                return _png(bytes(int(v) for v in p), 8, False)
            return _png(b"".join(bytes((255 - int(v), int(v), int(v) // 2)) for v in p), 8, True)

        return type(label)([file(n, p) for n, p in zip(label, px)], dtype=object)

    path = fresh(spark, "pngs")
    files = one.select(encoded("label", "px").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)
    back = read_images(spark, path, "part-*")
    values = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10))
    return back.select("valid", F.when(F.col("valid"), F.md5(F.array_join(values, ","))).alias("pixels_md5"), "h")
