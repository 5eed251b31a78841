import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.operators.contract import ContractError
from tablewarden.sources import tables

SCHEMA = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("Attack Type", T.StringType())])


def test_csv_tokens(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,n,Attack Type\ninf,1,DoS\n-inf,2,DoS\nNA,3,\n,x,DoS\n1.5,-1,DoS\n")
    df, failed = tables.read_labelled_csv(spark, str(p), SCHEMA, "Attack Type")
    rows = df.collect()
    assert [r.a for r in rows] == [float("inf"), float("-inf"), None, None, 1.5] and rows[4].n == -1 and rows[2]["Attack Type"] is None
    assert [tuple(r) for r in failed.collect()] == [("n", 1)]


def test_missing_file_or_target(spark, tmp_path):
    with pytest.raises(ContractError, match="does not exist"):
        tables.read_labelled_csv(spark, str(tmp_path / "none.csv"), SCHEMA, "Attack Type")
    (tmp_path / "y.csv").write_text("a\n1\n")
    with pytest.raises(ContractError, match="Target column"):
        tables.read_labelled_csv(spark, str(tmp_path / "y.csv"), SCHEMA, "Attack Type")


def test_row_ids_and_preview(spark):
    df = tables.add_row_id(spark.createDataFrame([("a",), ("b",), ("c",)], "x string").coalesce(1))
    assert [tuple(r) for r in df.collect()] == [(0, "a"), (1, "b"), (2, "c")]
    many = tables.add_row_id(spark.range(1000).select((F.col("id") * 3).alias("_at"), F.lit("r").alias("_row")).repartitionByRange(7, "_at"))
    assert [tuple(r) for r in many.orderBy("row_id").collect()] == [(i, 3 * i, "r") for i in range(1000)]
    assert [r.row_id for r in tables.preview(df, "row_id", rows=2).collect()] == [0, 1]


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, x int")
    tables.write_splits(df, str(tmp_path / "s"))
    assert (tmp_path / "s/split=train").is_dir()
    with pytest.raises(Exception):
        tables.write_splits(df, str(tmp_path / "s"))
    folder = tables.run_path(str(tmp_path), "1", "smoke")
    assert folder.endswith("run=1_smoke")
    tables.write_model_outputs({"predictions": spark.createDataFrame([("m", 1)], "model_name string, n int")}, folder, "smoke")
    back = spark.read.parquet(f"{folder}/predictions").first()
    assert back.run_mode == "smoke" and back.model_name == "m"


@pytest.fixture
def split_sizes(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(names, (n, 64))]
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_row_ids_follow_the_files(spark, tmp_path, split_sizes, kind):
    """Several files of unlike size, cut and packed in many ways: positions are those of a plain reader, however files are split."""
    import pandas as pd

    want = []
    for name, n in (("a", 5), ("b", 3000), ("c", 0), ("d", 1), ("e", 700)):
        rows = [(f"{name}{i}", "z" * (i % 40)) for i in range(n)]
        want += [r[0] for r in rows]
        frame = pd.DataFrame(rows, columns=["x", "_metadata_of_mine"], dtype="str")
        frame.to_csv(tmp_path / f"{name}.csv", index=False) if kind == "csv" else frame.to_parquet(tmp_path / f"{name}.parquet", row_group_size=100)
    for size in (400, 5000, 1 << 27):
        split_sizes(size)
        df = spark.read.option("header", True).schema("x string, _metadata_of_mine string").format(kind).load(str(tmp_path))
        got = tables.add_row_id(df.withColumn("_at", F.lit(1))).orderBy("row_id").collect()
        assert [(r.row_id, r.x) for r in got] == list(enumerate(want))
    split_sizes(400)
    with pytest.raises(Exception, match="number them first"):
        tables.add_row_id(df.repartition(5)).collect()
