import datetime
from unittest.mock import MagicMock

import numpy as np
import pytest
from plans import plan_text
from pyspark.sql import functions as F

from etalase.functions.text import strip, words
from etalase.operators import cleaning, extraction
from etalase.operators.text_features import text_features
from etalase.schemas import PAGES, RAW
from etalase.sources import files, jdbc, workspace
from etalase.sources.workspace import is_local, work_dir
from etalase.streaming import ingest

FIELDS = {"heading": extraction.Field([("h1", {})])}


def raw(spark, *rows):
    names = [f.name for f in RAW.fields]
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], RAW)


def day(n):
    return datetime.datetime(2024, 1, n)


def test_latest_row_per_address(spark):
    df = raw(
        spark,
        {"URL": "/1", "Update": day(2), "Stok": "2", "Product_Name": "A"},
        {"URL": "/1", "Update": day(1), "Stok": "9"},
        {"URL": "/2", "Update": None, "Stok": "5"},
        {"URL": "/3", "Update": day(1), "Stok": "1"},
        {"URL": "/3", "Update": day(1), "Stok": "2"},
    )
    latest = cleaning.latest_rows(df)
    assert latest.columns == df.columns
    assert sorted((r.URL, r.Stok) for r in latest.collect()) == [("/1", "2"), ("/2", "5"), ("/3", "2")]
    assert plan_text(latest).count("Exchange (") == 2  # named in the tree and in the list


@pytest.mark.parametrize("places", [1, 3, 2**18])
def test_old_rows_do_not_reach_the_sort(spark, monkeypatch, places):
    monkeypatch.setattr(cleaning, "PLACES", places)
    rows = [
        {"URL": f"/{i}", "Update": day(1 + (i + j) % 28) if j % 5 else None, "Stok": f"{j % 3}", "Description": f"{j}"}
        for i in range(40)
        for j in range(28)
    ]
    rows += [{"URL": "/hot", "Update": day(1 + j % 28), "Stok": f"{j}"} for j in range(500)]
    df = raw(spark, *rows, {"Stok": "no address"}, {"Update": day(1)})
    known = df.where("URL is not null")
    assert cleaning._without_old(known, "URL").count() < 0.2 * known.count()
    wanted = {}
    for row in rows:
        order = (row["Update"] or datetime.datetime.min, row["Stok"], row.get("Description", ""))
        wanted[row["URL"]] = max(wanted.get(row["URL"], order), order)
    got = cleaning.latest_rows(df).collect()
    assert sorted((r.URL, r.Update, r.Stok) for r in got if r.URL) == sorted((u, o[0], o[1]) for u, o in wanted.items())
    assert sum(r.URL is None for r in got) == 2


def test_rough_rows_without_an_address_are_not_stored(spark):
    from etalase.plans import views

    rows = views.rough_rows(spark, "/root/testdata/sf0.001")
    known = rows.where("URL is not null")
    assert cleaning._without_old(known, "URL").count() < 0.5 * known.count()
    assert cleaning.latest_rows(rows).where("URL is null").count() == rows.count() - known.count()


def test_stored_rows_grow_with_the_addresses(spark):
    n = 2**18
    captures = spark.range(4 * n).select(
        F.concat(F.lit("/"), (F.col("id") % n).cast("string")).alias("URL"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10**9))).alias("Update"),
    )
    kept = cleaning._without_old(captures, "URL")
    times = kept.groupBy("URL").agg(F.max("Update").alias("Update"), F.count("*").alias("rows"))
    newest = captures.groupBy("URL").agg(F.max("Update").alias("Update"))
    found = times.join(newest, ["URL", "Update"]).agg(F.count("*").alias("keys"), F.sum("rows").alias("rows")).first()
    assert found["keys"] == n
    assert found["rows"] < 1.1 * n


def test_addresses_without_any_time_stay(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "PLACES", 1)
    rows = [{"URL": "/a", "Update": day(3)}, {"URL": "/a", "Update": day(1)}, {"URL": "/b", "Stok": "1"}]
    got = cleaning.latest_rows(raw(spark, *rows)).collect()
    assert sorted((r.URL, r.Update) for r in got) == [("/a", day(3)), ("/b", None)]


def test_clean(spark):
    df = raw(
        spark,
        {
            "URL": "/1",
            "Product_Name": "  Tas\t",
            "Product_Price": "Rp1.250.000",
            "Stok": "habis",
            "Jumlah_Terjual": "Terjual 12",
            "Rating": "4,5 / 5",
            "Min_Pembelian": None,
            "Berat_Satuan": "",
        },
        {"URL": "/2", "Product_Price": "9" * 30, "Rating": "5"},
    )
    one, two = cleaning.clean_products(df).orderBy("product_price", ascending=False).collect()
    assert one.product_name == "Tas" and one.product_price == 1250000
    assert (one.stok, one.jumlah_terjual, one.rating) == (None, 12, 4.5)
    assert one.problems == ["stok"]
    assert (two.product_price, two.rating, two.problems) == (None, 5.0, ["product_price"])


def test_numbers_that_are_not_clear(spark):
    texts = ["1,2 rb terjual", "2.5 kg", "10rb+", "1.23", "1.234.5", "3 x 4", "-5", "12k", "7", "Rp1.234", "100 gram", "3 karung"]
    rows = [{"URL": f"/{i:02}", "Stok": t} for i, t in enumerate(texts)]
    got = cleaning.clean_products(raw(spark, *rows)).select("stok", "problems", "product_id").collect()
    assert sorted(r.stok for r in got if r.stok is not None) == [3, 7, 100, 1234]
    assert all((r.stok is None) == ("stok" in r.problems) for r in got)
    assert len({r.product_id for r in got}) == len(texts)


def test_rows_without_an_address_stay(spark):
    rows = [{"URL": None, "Update": day(i), "Stok": str(i)} for i in (1, 2, 3)] + [{"URL": "/1", "Update": day(1)}] * 2
    latest = cleaning.latest_rows(raw(spark, *rows))
    assert sorted((r.URL or "", r.Stok or "") for r in latest.collect()) == [("", "1"), ("", "2"), ("", "3"), ("/1", "")]
    problems = cleaning.clean_products(latest).where("product_id is null").collect()
    assert [r.problems for r in problems] == [["product_id"]] * 3


@pytest.mark.parametrize("text", ["", " ", " a ", "　x\x1cy\x85", "a b", "\ta  B a\n", "​z"])
def test_blanks_are_those_of_python(spark, text):
    got = spark.range(1).select(strip(F.lit(text)).alias("s"), words(F.lit(text)).alias("w")).collect()[0]
    assert got.s == text.strip()
    assert got.w == list(dict.fromkeys(text.lower().split()))


def test_id_ranges_cover_every_id_once(spark):
    bounds = jdbc.hex_boundaries(5, digits=2)
    assert bounds == ["33", "66", "99", "cc"]
    clauses = jdbc.id_ranges("id", bounds)
    ids = [f"{i:02x}-rest" for i in range(256)] + [None, "", "zz", "33", "3"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    counts = [df.where(clause).count() for clause in clauses]
    assert sum(counts) == len(ids) and min(counts) > 45
    assert jdbc.id_ranges("id", []) == ["1 = 1"]
    assert jdbc.id_ranges("id", ["o'k"], "CAST({} AS BINARY)")[1] == "CAST(id AS BINARY) >= 'o''k'"
    for points, binary in ((["o'k"], "{}"), (["A"], "{}"), (["a"], "id")):
        with pytest.raises(ValueError):
            jdbc.id_ranges("id", points, binary)
    parts = jdbc.hash_parts("abs(hash(id)) % 100", 7)
    counts = [df.where(p).count() for p in parts]
    assert sum(counts) == len(ids) and min(counts) > 0
    with pytest.raises(ValueError):
        jdbc.id_ranges("id", ["b", "a"])
    with pytest.raises(ValueError):
        jdbc.hex_boundaries(0)


@pytest.mark.parametrize(
    "ids",
    [
        [f"{i:024x}" for i in range(3000)],
        [f"https://shop.example/product/{'x' * (i % 40)}{i}" for i in range(3000)],
        ["same"] * 1500 + [f"k{i}" for i in range(500)] + ["same and longer"] * 3 + [""],
        [f"é{chr(0x4E00 + i % 700)}😀{i}" for i in range(2000)] + ["a'b", "\x7f", "a" * 300 + "1", "a" * 300 + "2"],
        ["one"] * 100,
    ],
    ids=["hex", "addresses", "hot id", "marks", "one id"],
)
@pytest.mark.parametrize("partitions", [1, 8])
def test_split_points_give_even_parts(spark, ids, partitions):
    table = spark.createDataFrame([(i,) for i in [*ids, None]], "product_id string").repartition(3)
    points = jdbc.quantile_boundaries(table, "product_id", partitions)
    assert points == sorted(set(points)) and len(points) <= 2 * partitions
    table.createOrReplaceTempView("split_ids")
    counts = [
        spark.sql(f"select product_id, count(*) n from split_ids where {c} group by 1").collect()
        for c in jdbc.id_ranges("product_id", points, "({})")
    ]
    assert sum(r.n for part in counts for r in part) == len(ids) + 1
    for part in counts:
        named = [r.n for r in part if r.product_id is not None]
        assert sum(named) <= len(ids) / partitions or len(named) == 1


def test_split_points_end_where_nothing_splits(spark):
    table = spark.createDataFrame([("a",), ("a\0",), ("b",)] * 50, "product_id string")
    assert jdbc.quantile_boundaries(table, "product_id", 8) == ["b"]


def test_split_points_of_no_ids(spark):
    nothing = spark.createDataFrame([(None,)], "product_id string")
    assert jdbc.quantile_boundaries(nothing, "product_id", 4) == []


def test_table_reads_and_appends_are_parallel():
    session, properties = MagicMock(), {"user": "u"}
    jdbc.read_table(session, "url", "t", properties, boundaries=["5"])
    session.read.jdbc.assert_called_with(
        "url", "t", predicates=["product_id < '5' OR product_id IS NULL", "product_id >= '5'"],
        properties={"fetchsize": "10000", "user": "u"},
    )
    jdbc.read_table(session, "url", "t", {"fetchsize": "5"}, hashed="h", partitions=2)
    session.read.jdbc.assert_called_with(
        "url", "t", predicates=["MOD(h, 2) = 0 OR (h) IS NULL", "MOD(h, 2) = 1"], properties={"fetchsize": "5"}
    )
    with pytest.raises(ValueError, match="one_task"):
        jdbc.read_table(session, "url", "t", properties)
    jdbc.read_table(session, "url", "t", properties, one_task=True)
    jdbc.read_table(session, "url", "t", properties, numeric_column="n", lower=0, upper=9, partitions=3)
    session.read.jdbc.assert_called_with(
        "url", "t", column="n", lowerBound=0, upperBound=9, numPartitions=3, properties={"fetchsize": "10000", "user": "u"}
    )
    rows = MagicMock()
    jdbc.append_table(rows, "url", "t", properties, partitions=4, batch_rows=50)
    rows.write.jdbc.assert_called_once_with(
        "url", "t", mode="append", properties={"user": "u", "batchsize": "50", "numPartitions": "4"}
    )


def test_appends_add_up(spark):
    path = work_dir(spark, "raw")
    rows = raw(spark, {"URL": "/1", "Update": day(1)}, {"URL": "/1", "Update": day(1)})
    files.append_raw(rows, path)
    files.append_raw(rows.drop("Stok").withColumn("stok", F.lit(3)), path)
    back = files.read_raw(spark, path)
    assert back.schema == RAW and back.count() == 4
    assert sorted(r.Stok or "" for r in back.collect()) == ["", "", "3", "3"]


def test_features_from_arrays_and_vectors(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    for name, values in {
        "array": [("a", [1.0, 0.0]), ("b", [0.0, 2.0])],
        "vector": [("a", Vectors.dense(1.0, 0.0)), ("b", Vectors.sparse(2, {1: 2.0}))],
    }.items():
        path = str(tmp_path / name)
        spark.createDataFrame(values, ["product_id", "features_vector"]).write.parquet(path)
        got = {r.product_id: r.features_vector for r in files.read_features(spark, path).collect()}
        assert got == {"a": [1.0, 0.0], "b": [0.0, 2.0]}


def test_work_dir_is_below_the_session_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first != second and first.startswith(f"{root}/x-")


def page_files(spark, tmp_path):
    folder = str(tmp_path / "pages")

    def add(*ids):
        rows = [(i, f"/{i}", f"<h1>Title {i}</h1>") for i in ids]
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(folder)

    return folder, add


def test_stream_equals_batch_and_goes_on_where_it_stopped(spark, tmp_path):
    folder, add = page_files(spark, tmp_path)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for ids in [(1, 2), (3,), (4, 5, 6)]:
        add(*ids)
        rows = extraction.page_fields(ingest.stream_pages(spark, folder), FIELDS)
        ingest.append_files(rows, out, log).awaitTermination()
    streamed = sorted(spark.read.parquet(out).collect())
    batch = extraction.page_fields(spark.read.schema(PAGES).parquet(folder), FIELDS)
    assert streamed == sorted(batch.collect()) and len(streamed) == 6


def test_stream_batches_go_to_the_callers_sink(spark, tmp_path):
    folder, add = page_files(spark, tmp_path)
    add(1, 2, 3)
    out = str(tmp_path / "raw")
    rows = extraction.good_rows(extraction.product_rows(ingest.stream_pages(spark, folder)))
    query = ingest.append_batches(rows, lambda batch, number: files.append_raw(batch, f"{out}/batch={number}"), str(tmp_path / "log"))
    query.awaitTermination()
    assert sorted(r.URL for r in files.read_raw(spark, f"{out}/batch=0").collect()) == ["/1", "/2", "/3"]


def test_a_backlog_comes_in_batches(spark, tmp_path):
    folder, add = page_files(spark, tmp_path)
    for i in range(5):
        add(i)
    numbers = []
    rows = ingest.stream_pages(spark, folder, files=2)
    ingest.append_batches(rows, lambda batch, n: numbers.append((n, batch.count())), str(tmp_path / "log")).awaitTermination()
    assert numbers == [(0, 2), (1, 2), (2, 1)]


@pytest.mark.parametrize(
    "path, local",
    [("/mnt/x", True), ("x", True), ("file:/x", True), ("file:///x", True), ("hdfs://name/x", False), ("s3a://b/x", False)],
)
def test_paths_that_a_machine_may_have_for_itself(path, local):
    assert is_local(path) == local


def test_a_folder_that_loses_rows_is_refused(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(workspace, "_one_machine", lambda master: False)
    monkeypatch.setattr(workspace, "_shared", {})
    assert work_dir(spark, "x")
    monkeypatch.setattr(workspace, "_shared", {})
    monkeypatch.setattr(workspace, "uuid", MagicMock(uuid4=lambda: MagicMock(hex="same")))
    spark.range(3).write.parquet(f"{tmp_path}/shared-same")  # as if others' rows were missing
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path: None)
    with pytest.raises(RuntimeError, match="do not share"):
        workspace._require_shared(spark, str(tmp_path))


def test_text_features_equal_a_direct_count(spark):
    import hashlib
    import math
    import re

    texts = {"a": "Tas tas KULIT, tas!", "b": "kursi kulit", "c": "...", "d": "é 42 tas"}
    size = 16
    counts = {i: np.zeros(size) for i in texts}
    for i, text in texts.items():
        for word in re.findall(r"\w+", text.lower()):
            counts[i][int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % size] += 1
    held = sum(c > 0 for c in counts.values())
    rarity = np.array([math.log((len(texts) + 1) / (n + 1)) for n in held])
    df = text_features(spark.createDataFrame(list(texts.items()), "product_id string, text string"), size)
    got = {r.product_id: r.features_vector for r in df.collect()}
    assert set(got) == set(texts)
    for i in texts:
        assert got[i] == pytest.approx(list(counts[i] * rarity))
