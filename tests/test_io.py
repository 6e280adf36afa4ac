import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace import params as P
from millrace.plans.model import load_model
from millrace.sources.readers import matching_files, read, read_text
from millrace.sources.sinks import convert, libsvm_lines, write_libsvm, write_rec
from millrace.sources.store import Store, TileStore

ROWS = "row_id bigint, label double, features array<struct<idx: bigint, val: double>>"
DATA = [(1, 1.0, [(3, 1.0), (7, 0.5)]), (2, -1.0, [(-1, None)]), (3, None, []), (4, 0.0, None), (5, 2.5, [(8, 1.0), (None, 3.0), (9, -2.0)])]


def frame(spark):
    return spark.createDataFrame(DATA, ROWS)


def as_sets(df):
    return sorted((r.label, tuple((x.idx, x.val) for x in r.features)) for r in df.collect())


def test_text_lines(spark):
    got = [r.value for r in libsvm_lines(frame(spark)).collect()]
    assert got == ["1 3:1 7:0.5", "-1 18446744073709551615", "0", "0", "2.5 8:1 9:-2"]


def test_text_round_trip(spark, tmp_path):
    write_libsvm(frame(spark), str(tmp_path / "a"))
    back = read(spark, str(tmp_path / "a"), "libsvm")
    assert as_sets(back) == sorted([(1.0, ((3, 1.0), (7, 0.5))), (-1.0, ((-1, None),)), (0.0, ()), (0.0, ()), (2.5, ((8, 1.0), (9, -2.0)))])
    assert back.select("row_id").distinct().count() == 5
    parts = [read(spark, str(tmp_path / "a"), "libsvm", i, 3) for i in range(3)]
    assert sum(p.count() for p in parts) == 5


def test_column_round_trip_and_sizes(spark, tmp_path):
    many = spark.range(4000).select(F.col("id").alias("row_id"), F.lit(1.0).alias("label"), F.array(*(F.struct((F.col("id") + i).alias("idx"), F.lit(1.0).alias("val")) for i in range(20))).alias("features"))
    write_rec(many, str(tmp_path / "r"), part_size=0.2)
    back = read(spark, str(tmp_path / "r"), "rec")
    assert back.count() == 4000 and back.first().features[0].val is None
    assert len(list((tmp_path / "r").glob("part-*"))) > 1
    convert(spark, P.Convert(str(tmp_path / "r"), "rec", str(tmp_path / "t"), "libsvm"))
    write_libsvm(many, str(tmp_path / "m"), merged=True)
    assert len(list((tmp_path / "m").glob("part-*"))) == 1
    with pytest.raises(ValueError):
        write_libsvm(many, str(tmp_path / "z"), part_size=0)
    assert read(spark, str(tmp_path / "t"), "libsvm").count() == 4000
    with pytest.raises(ValueError):
        convert(spark, P.Convert("a", "rec", "b", "criteo"))


def test_rejects_are_kept(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1 2:3\n\nx 2:3\n1 2:3\r\n")
    kept = []
    assert read_text(spark, str(tmp_path / "x.txt"), keep_rejects=kept.append).count() == 2
    assert sorted(r.reason for r in kept[0].collect()) == ["empty", "label"]
    (tmp_path / "ad.txt").write_text("7 2 1 3:4 5:6\n")
    assert [x.idx for x in read(spark, str(tmp_path / "ad.txt"), "adfea").first().features] == [(3 << 12) | 4, (5 << 12) | 6]
    with pytest.raises(ValueError):
        read(spark, "x", "csv")


def test_files_by_pattern(spark, tmp_path):
    for n in ("a1.txt", "a22.txt", "b1.txt"):
        (tmp_path / n).write_text("")
    assert [f.rpartition("/")[2] for f in matching_files(spark, f"{tmp_path}/a[0-9]+.txt")] == ["a1.txt", "a22.txt"]


def test_settings(tmp_path):
    (tmp_path / "c.conf").write_text("# note\nlr = .5\nbatch_size = 100\n")
    s = P.parse(["lr=.1", f"argfile={tmp_path}/c.conf", "l1=2", "odd=1"])
    given = P.Given(s)
    update, learn = given.take(P.SGDUpdate), given.take(P.SGDLearn)
    assert (update.lr, update.l1, learn.batch_size, given.left) == (0.5, 2.0, 100, {"odd"})
    with pytest.raises(ValueError):
        P.parse(["novalue"])
    with pytest.raises(ValueError):
        P.Given({}).take(P.Convert)


def test_command_line(spark, tmp_path, capsys):
    lines = [f"{i % 2} {i % 7 + 1}:1 {i % 3 + 20}:0.5" for i in range(60)]
    (tmp_path / "d.txt").write_text("\n".join(lines) + "\n")
    model = str(tmp_path / "m")
    cli.main([f"data_in={tmp_path}/d.txt", "max_num_epochs=2", "l1=.01", "lr=.5", f"model_out={model}", "nothing=1"], spark)
    assert "nothing" in capsys.readouterr().err
    assert load_model(spark, model).model.count() == 10
    cli.main([f"data_in={tmp_path}/d.txt", "max_num_epochs=1", "l1=.01", "lr=.5", f"model_in={model}", f"model_out={tmp_path}/m2"], spark)
    first, more = load_model(spark, model), load_model(spark, str(tmp_path / "m2"))
    assert more.history[0]["loss"] < first.history[-1]["loss"] and more.model.agg({"cnt": "sum"}).first()[0] == 2 * first.model.agg({"cnt": "sum"}).first()[0]
    cli.main(["task=predict", f"data_in={tmp_path}/d.txt", f"model_in={model}", f"pred_out={tmp_path}/p"], spark)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 60
    cli.main(["task=convert", f"data_in={tmp_path}/d.txt", "data_format=libsvm", f"data_out={tmp_path}/r", "data_out_format=rec"], spark)
    cli.main(["learner=bcd", f"data_in={tmp_path}/r", "data_format=rec", "max_num_epochs=1", "tail_feature_filter=0"], spark)
    with pytest.raises(ValueError):
        cli.main(["task=other"], spark)
    with pytest.raises(ValueError):
        cli.main(["learner=other"], spark)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    a = spark.range(10).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("x"))
    s.store("a", a)
    assert s.size("a") == 10 and [r.x for r in s.fetch("a", 2, 4).orderBy("pos").collect()] == [4, 6]
    with pytest.raises(TypeError):
        s.store("a", a.withColumn("x", F.lit("t")))
    s.store("a", a.limit(3))
    assert s.size("a") == 3
    s.save_meta()
    t = Store(spark, str(tmp_path / "s"))
    t.load_meta()
    assert t.size("a") == 3
    s.remove("a")
    assert s.size("a") == 3
    with pytest.raises(KeyError):
        s.fetch("b")
    tiles = TileStore(spark, str(tmp_path / "t"))
    tiles.store_tiles("m", spark.range(12).select((F.col("id") % 2).alias("rblk"), (F.col("id") % 3).alias("fblk"), "id"))
    one = tiles.tile("m", 1, 2)
    assert sorted(r.id for r in one.collect()) == [5, 11] and "fblk" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
