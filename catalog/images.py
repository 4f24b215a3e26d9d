"""Image corruptions on 8 x 8 grey images made from the embeddings."""

from pyspark.sql import functions as F

from catalog import register, sql, table
from catalog.samplers import SEED
from tarnish.operators.image import ImageCorruption, crop, normalise, pad

PIXELS = ("list_transform(embedding, lambda x: CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, "
          "(x::DOUBLE + 0.5::DOUBLE) * 255.0::DOUBLE))) AS INT))")
IMAGES = f"(SELECT vec_id, label, 8 AS height, 8 AS width, {PIXELS} AS pixels FROM embeddings)"


def image_table(spark, sf):
    """(vec_id, label, height, width, pixels): each embedding value maps to 0..255."""
    pixel = lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x.cast("double") + 0.5) * 255.0))).cast("int")
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.transform("embedding", pixel).alias("pixels"))


def _corrupt(spark, sf, *kinds, severity=4, fraction=0.5):
    return ImageCorruption(kinds, severity, fraction).transform(image_table(spark, sf), ["vec_id"], SEED)


def _byte(x: str) -> str:
    return f"CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})) * 255.0::DOUBLE) AS INT)"


def _image_sql(cell: str) -> str:
    """Long form (vec_id, position, pixel) of the images after a pixel rule on the hit ones."""
    return (f"SELECT vec_id, i, CASE WHEN hit THEN {cell} ELSE x END AS x FROM ("
            f"SELECT *, unnest(pixels) AS x, unnest(range(64))::INT AS i, list_sum(pixels)::DOUBLE / 64 / 255.0::DOUBLE AS m "
            f"FROM ({sql.marked('embeddings', 0.5, 'COIN', SEED, source=IMAGES)}) k) p")


def _long(df, column="pixels"):
    return df.select("vec_id", F.posexplode(column).alias("i", "x"))


UNIT = "(x::DOUBLE / 255.0::DOUBLE)"
NOISE = sql.normal("v", sql.salt(sql.quoted(SEED), "z1"), sql.salt(sql.quoted(SEED), "z2"), "i")


@register("img_noise", _image_sql(_byte(f"{UNIT} + 0.26::DOUBLE * {NOISE}")))
def img_noise(spark, sf):
    return _long(_corrupt(spark, sf, "gaussian_noise"))


@register("img_contrast", _image_sql(_byte(f"({UNIT} - m) * 0.1::DOUBLE + m")))
def img_contrast(spark, sf):
    return _long(_corrupt(spark, sf, "contrast"))


@register("img_brightness", _image_sql(_byte(f"{UNIT} + 0.4::DOUBLE")))
def img_brightness(spark, sf):
    return _long(_corrupt(spark, sf, "brightness"))


@register("img_normalize", f"""
SELECT vec_id, i, round(x::DOUBLE / 255.0::DOUBLE, 9) AS x
FROM (SELECT vec_id, unnest(range(64))::INT AS i, unnest(pixels) AS x FROM {IMAGES} m) q""")
def img_normalize(spark, sf):
    return _long(normalise(image_table(spark, sf)), "unit_pixels").withColumn("x", F.round("x", 9))


@register("img_pad_crop", f"""
SELECT vec_id, r * 12 + c AS i, CASE WHEN r BETWEEN 2 AND 9 AND c BETWEEN 2 AND 9 THEN pixels[(r - 2) * 8 + (c - 2) + 1] ELSE 0 END AS x,
       CASE WHEN r BETWEEN 3 AND 8 AND c BETWEEN 3 AND 8 THEN pixels[(r - 2) * 8 + (c - 2) + 1] END AS cropped
FROM {IMAGES} m, (SELECT unnest(range(12)) AS r) a, (SELECT unnest(range(12)) AS c) b""")
def img_pad_crop(spark, sf):
    """8 x 8 images in a 12 x 12 frame, and the 6 x 6 centre of that frame."""
    padded = pad(image_table(spark, sf), 12)
    # position of a centre cell in the frame
    frame = ((F.floor(F.col("j") / 6) + 3) * 12 + F.col("j") % 6 + 3).cast("int").alias("i")
    centre = crop(padded, 6).select("vec_id", F.posexplode("pixels").alias("j", "cropped")).select("vec_id", frame, "cropped")
    return _long(padded).join(centre, ["vec_id", "i"], "left")


@register("img_glass")
def img_glass(spark, sf):
    return _corrupt(spark, sf, "glass_blur")


@register("img_snow")
def img_snow(spark, sf):
    return _corrupt(spark, sf, "snow")


@register("img_motion")
def img_motion(spark, sf):
    return _corrupt(spark, sf, "motion_blur")


# Severity 4: a disk of radius 8 on a grid of reach 10, softened by a Gaussian of sigma 0.5 that
# is mirrored at the grid's border; then the weight of each source pixel of a mirrored 8 x 8 image.
DEFOCUS = f"""
WITH side AS (SELECT unnest(range(-10, 11))::INT AS v),
soft AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-0.5 * (d / 0.5) * (d / 0.5)) AS w FROM (SELECT unnest(range(-2, 3))::INT AS d) q) q),
near AS (SELECT v, w, CASE WHEN abs(v + d) > 10 THEN 20 - abs(v + d) ELSE abs(v + d) END AS at FROM side, soft),
disk AS (SELECT y.v AS y, x.v AS x, sum(y.w * x.w * (y.at * y.at + x.at * x.at <= 64)::INT) AS w FROM near y, near x GROUP BY ALL),
place AS (SELECT r, v, CASE WHEN m < 8 THEN m ELSE 14 - m END AS at FROM (SELECT r, v, (r + v + 28) % 14 AS m FROM (SELECT unnest(range(8))::INT AS r) q, side) q),
weight AS (SELECT a.r * 8 + b.r AS i, a.at * 8 + b.at AS src, sum(w) / (SELECT sum(w) FROM disk) AS w
           FROM disk JOIN place a ON a.v = y JOIN place b ON b.v = x GROUP BY ALL)
SELECT vec_id, i, CASE WHEN any_value(hit) THEN {_byte('sum(w * pixels[src + 1]::DOUBLE / 255.0::DOUBLE)')} ELSE any_value(pixels[i + 1]) END AS x
FROM ({sql.marked('embeddings', 0.5, 'COIN', SEED, source=IMAGES)}) k, weight GROUP BY vec_id, i"""


@register("img_defocus", DEFOCUS)
def img_defocus(spark, sf):
    return _long(_corrupt(spark, sf, "defocus_blur"))


@register("img_fog")
def img_fog(spark, sf):
    return _corrupt(spark, sf, "fog")


@register("img_chain")
def img_chain(spark, sf):
    """Several kernels one after the other on the same image."""
    return _corrupt(spark, sf, "gaussian_noise", "motion_blur", "brightness", severity=2)
