import struct

import pytest
from pyspark.sql import functions as F

from tarnish.functions.pixels import KERNELS
from tarnish.operators.image import ImageCorruption, crop, normalise, pad
from tarnish.plans import task as tasks
from tarnish.session import cut_lineage
from tarnish.sources.tables import read_csv, read_images, read_table, read_tsv, write_results


@pytest.fixture(scope="module")
def images(spark):
    rows = [(i, 28, 28, [(x * 3 + y * 5 + i * 11) % 256 for y in range(28) for x in range(28)]) for i in range(6)]
    rows.append((6, 4, 4, [100] * 16))
    return spark.createDataFrame(rows, "id int, height int, width int, pixels array<int>").cache()


def pixels(df):
    return {r["id"]: r["pixels"] for r in df.collect()}


@pytest.mark.parametrize("kind", sorted(KERNELS))
def test_every_kernel(images, kind):
    before, distances = pixels(images), []
    for severity in (1, 5):
        after = pixels(ImageCorruption((kind,), severity).transform(images, ["id"], 3))
        assert after.keys() == before.keys()
        assert all(len(after[i]) == len(before[i]) and min(after[i]) >= 0 and max(after[i]) <= 255 for i in before)
        distances.append(sum(abs(a - b) for i in range(6) for a, b in zip(after[i], before[i])))
    assert 0 < distances[0] and (distances[0] < distances[1] or kind == "snow")
    again = pixels(ImageCorruption((kind,), 5).transform(images.repartition(3), ["id"], 3))
    assert again == after


def test_constant_images(images):
    flat = images.where("id = 6")
    assert pixels(ImageCorruption(("contrast",), 3).transform(flat, ["id"]))[6] == [100] * 16
    assert set(pixels(ImageCorruption(("brightness",), 1).transform(flat, ["id"]))[6]) <= {125, 126}


def test_fraction_and_chain(images):
    assert pixels(ImageCorruption(("fog",), 3, 0.0).transform(images, ["id"])) == pixels(images)
    both = pixels(ImageCorruption(("motion_blur", "brightness"), 2).transform(images, ["id"]))
    assert both != pixels(ImageCorruption(("motion_blur",), 2).transform(images, ["id"]))
    for bad in (dict(kinds=("sepia",)), dict(kinds=()), dict(kinds=("fog",), severity=6), dict(kinds=("fog",), fraction=2)):
        with pytest.raises(ValueError):
            ImageCorruption(**bad)


def test_pad_crop_normalise(images):
    square = images.where("id < 6")
    padded = pad(square, 32)
    assert padded.select(F.size("pixels")).distinct().first()[0] == 1024
    assert pixels(crop(padded, 28)) == pixels(square)
    assert normalise(square).select(F.array_max("unit_pixels")).first()[0] <= 1.0


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('age,job,x\n39,?,1.5\n?,"a, b",NA\n20,clerk,2\n')
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"age": "bigint", "job": "string", "x": "double"}
    assert [tuple(r) for r in df.orderBy(F.col("age").asc_nulls_last()).collect()] == [
        (20, "clerk", 2.0), (39, None, 1.5), (None, "a, b", None)]
    typed = read_csv(spark, str(tmp_path / "a.csv"), "age int, job string, x double")
    assert dict(typed.dtypes)["age"] == "int" and typed.where("job is null").count() == 1
    (tmp_path / "b.tsv").write_text("US\t5\tgood game\nUK\t\t\n")
    tsv = read_tsv(spark, str(tmp_path / "b.tsv"), "market string, stars int, title string")
    assert [tuple(r) for r in tsv.orderBy("market").collect()] == [("UK", None, None), ("US", 5, "good game")]


def test_picture_files(spark, tmp_path):
    # a 2 x 2 bitmap written by hand: rows from the bottom, blue green red, rows padded to 4 bytes
    body = bytes([0, 0, 0, 30, 60, 90, 0, 0]) + bytes([255, 255, 255, 3, 3, 3, 0, 0])
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54)
    head += struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    (tmp_path / "p.bmp").write_bytes(head + body)
    row = read_images(spark, str(tmp_path), "image").first()
    assert (row["height"], row["width"], row["pixels"]) == (2, 2, [255, 3, 0, 60])


def test_tables_and_results(spark, tmp_path, toy):
    toy.withColumn("A", F.when(F.col("id") == 0, float("nan")).otherwise(F.col("A"))).write.parquet(str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t")).where("A is null").count() == 1
    write_results(toy, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 20


def test_tasks(toy):
    labelled = tasks.label_equals(toy, "C", "foo")
    train, test = tasks.split(labelled, ["id"], 0.25, 1)
    assert (train.count(), test.count(), train.join(test, "id").count()) == (15, 5, 0)
    task = tasks.Task(train, test, ["id"], "label", "binary", ["B"], ["A"], seed=1)
    assert task.check() is task
    with pytest.raises(ValueError, match="declared"):
        tasks.Task(train, test, ["id"], "label", "multiclass", ["B"], ["A"]).check()
    with pytest.raises(ValueError, match="not in the table"):
        tasks.Task(train, test, ["id"], "label", "binary", ["nope"])
    assert tasks.label_task_type(train, test, "A") == "regression"
    assert tasks.label_task_type(train, test.where("label = 1"), "label", closed=True) is None
    assert tasks.infer_roles(toy, ["id"]) == (["B", "C"], ["A"], [])
    assert cut_lineage(toy).count() == 20
