import random

from pyspark.sql import functions as F

from fieldspark.operators import pages


def test_any_page_is_read_from_its_own_folder(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 40), rng.choice(["x", None])) for i in range(5003)]
    df = spark.createDataFrame(rows, "id int, score int, note string").repartition(7)
    place = str(tmp_path / "board")
    assert pages.store_pages(df, [F.col("score").desc(), F.col("id").asc()], place, block_rows=64) == 5003
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for number, size in ((1, 10), (7, 10), (500, 10), (501, 10), (502, 10), (3, 200), (0, 5)):
        got = pages.read_page(spark, place, number, size).collect()
        start = (max(number, 1) - 1) * size
        assert [r.id for r in got] == want[start:start + size]
        assert [r["_place"] for r in got] == list(range(start + 1, start + 1 + len(got)))
    assert [r.id for r in pages.read_after(spark, place, 4321, 3).collect()] == want[4321:4324]
    index = pages.page_index(spark, place).first()
    assert (index.rows, index.pages) == (5003, 501)
    for f in (tmp_path / "board" / "rows").glob("_block=*/*.parquet"):
        if f.parent.name != "_block=62":  # places 3,969 to 4,032
            f.write_bytes(b"not to be read")
    assert [r.id for r in pages.read_page(spark, place, 400).collect()] == want[3990:4000]


def test_pages_of_a_table_without_rows(spark, tmp_path):
    df = spark.createDataFrame([], "id int")
    assert pages.store_pages(df, [F.col("id")], str(tmp_path / "none")) == 0
    assert pages.page_index(spark, str(tmp_path / "none")).first().pages == 1
    assert pages.read_page(spark, str(tmp_path / "none")).count() == 0
