import datetime as dt

import pytest
from pyspark.sql import functions as F

from caudal.operators import loading as ld
from caudal.sources import exports as ex
from caudal.sources import planner as src
from caudal.sources import store as st
from caudal.streaming import incremental

D = [dt.date(2024, 1, k) for k in range(1, 10)]


def test_zero_drop_looks_at_the_raw_value(spark):
    raw = spark.createDataFrame([("A", "1", "s", "01.01.2024", -3.0), ("A", "1", "s", "02.01.2024", 0.0), ("A", "1", "s", "03.01.2024", 4.5), ("Result", "1", "s", "03.01.2024", 9.0), ("A", "1", "s", "#", 1.0)], "Customer string, Material string, texto string, Day string, TO double")
    values = lambda df: sorted(r["consumo"] for r in df.collect())
    assert values(ex.read_export(raw)) == [0.0, 0.0, 4.5]
    assert values(ex.read_export(raw, drop_zeros=True)) == [0.0, 4.5]


def test_exports_combine_or_stop(make_fact):
    a, b = make_fact([("A", "s", D[0], 1.0), ("A", "s", D[1], 2.0)]), make_fact([("A", "s", D[1], 2.0), ("A", "s", D[2], 3.0)])
    assert ex.combine_exports([a, b]).count() == 3
    with pytest.raises(ex.ExportConflict, match="1 "):
        ex.combine_exports([a, b.withColumn("consumo", F.col("consumo") + 1)])


def test_csv_round_trip(spark, make_fact, folder):
    df = make_fact([("A", "s", D[0], 1.2344), ("B", "t", D[1], 2.0)])
    ex.write_csv(df, f"{folder}/consumo.csv")
    assert sorted(tuple(r) for r in ex.read_consumption(spark, f"{folder}/consumo.csv").collect()) == [("A", "s", D[0], 1.234), ("B", "t", D[1], 2.0)]


def test_predictions_overwrite_their_blocks_only(spark, make_fact, folder):
    plantas, skus, _ = st.star_tables(make_fact([("A", "s", D[0], 1.0), ("A", "t", D[0], 1.0)]))
    schema = "planta string, sku string, mes_objetivo string, mes_origen string, estrategia string, modelo string, valor double"
    one = spark.createDataFrame([("A", "s", "2024-02", "2024-01", "h1", "m", 1.0), ("A", "t", "2024-02", "2024-01", "h1", "m", 2.0), ("A", "s", "2024-03", "2024-02", "h1", "m", 3.0)], schema)
    st.replace_predictions(one, folder + "/p", plantas, skus)
    st.replace_predictions(one.where("sku = 's' and mes_origen = '2024-01'").withColumn("valor", F.lit(9.0)), folder + "/p", plantas, skus, run_id="r")
    got = sorted((r["mes_objetivo"], r["sku"], r["valor"], r["run_id"]) for r in st.read_predictions(spark, folder + "/p").collect())
    assert got == [("2024-02", "s", 9.0, "r"), ("2024-03", "s", 3.0, None)]
    for bad, text in ((one.unionByName(one), "claves repetidas"), (one.withColumn("valor", F.lit(float("nan"))), "no finitos"), (one.withColumn("sku", F.concat("sku", F.lit("x"))), "unknown"), (one.drop("modelo"), "no column modelo")):
        with pytest.raises(st.StoreError, match=text):
            st.replace_predictions(bad, folder + "/p", plantas, skus)
    assert st.read_predictions(spark, folder + "/p").count() == 2


def test_tracking_history_replaces_a_run_and_month(spark, folder):
    row = lambda run, mes, value: (run, mes, "sku", "", "ml_mean", value)
    make = lambda rows: spark.createDataFrame(rows, "run_id string, mes string, nivel string, planta string, modelo string, acierto double").withColumns({
        **{c: F.lit(0.0) for c in ("wape", "bias_pct", "real_TO", "pronostico_TO")}, "n": F.lit(1).cast("bigint"), "alerta": F.lit(None).cast("string"), "creado_en": F.lit("x"),
    })
    st.save_tracking(make([row("a", "2024-01", 0.5), row("b", "2024-01", 0.6), row("a", "2024-02", 0.7)]), folder + "/t")
    st.save_tracking(make([row("a", "2024-01", float("inf"))]), folder + "/t")
    got = sorted((r["run_id"], r["mes"], r["acierto"], r["estrategia"], r["alerta"]) for r in st.read_tracking(spark, folder + "/t").collect())
    assert got == [("a", "2024-01", None, "h1", ""), ("a", "2024-02", 0.7, "h1", ""), ("b", "2024-01", 0.6, "h1", "")]


def test_publish_undo_and_changed_master(spark, make_fact, folder):
    master = st.Versions(spark, folder + "/m")
    a, b = make_fact([("A", "s", D[0], 1.0)]), make_fact([("A", "s", D[0], 1.0), ("A", "s", D[1], 2.0)])
    st.publish_reviewed(master, a, None)
    mark = st.mark_of(master.read())
    st.publish_reviewed(master, b, mark)
    with pytest.raises(st.StoreError, match="changed"):
        st.publish_reviewed(master, a, mark)
    assert master.read().count() == 2
    master.undo()
    assert master.read().count() == 1
    with pytest.raises(st.StoreError, match="no earlier"):
        master.undo()
    for _ in range(13):
        master.publish(a)
    assert len(master.numbers()) == st.KEEP_VERSIONS + 1


def test_fingerprint_ignores_order_and_sees_changes(make_fact):
    rows = [("A", "s", D[k], float(k)) for k in range(6)]
    mark = lambda df: tuple(ld.fingerprint(df).first())
    assert mark(make_fact(rows)) == mark(make_fact(rows[::-1]).repartition(3))
    assert mark(make_fact(rows)) != mark(make_fact([*rows[:-1], ("A", "s", D[5], 5.5)]))
    twice = make_fact(rows * 2)
    assert mark(twice)[2] not in ("0-0", mark(make_fact(rows))[2]) and mark(make_fact([rows[0]] * 2)) != mark(make_fact([rows[1]] * 2))
    assert mark(twice)[2] == ld.merged_marks(mark(make_fact(rows))[2], mark(make_fact(rows))[2])
    assert mark(make_fact([]))[2] == "0-0"
    with pytest.raises(ValueError, match="out of date"):
        ld.check_meta({"data": "x", "horizon": 1}, {"data": "y", "horizon": 1})


def test_review_policies(make_fact):
    master = make_fact([("A", "s", D[0], 1.0), ("A", "s", D[1], 2.0)])
    review = lambda new, policy="detener": [tuple(r) for r in ld.review_findings(ld.load_summary(ld.compare_load(master, new)), policy).collect()]
    assert review(make_fact([("A", "s", D[1], 2.0), ("A", "s", D[2], 3.0)])) == []
    assert review(make_fact([("A", "s", D[1], 2.0)])) == [("error", "sin_cambios", 1)]
    changed = make_fact([("A", "s", D[1], 5.0), ("A", "s", D[2], 3.0), ("A", "s", D[2], 4.0)])
    assert review(changed) == [("error", "conflictos", 2)]
    assert review(changed, "usar_nuevo") == [("warning", "conflictos", 2)]


def test_source_tables_are_refused(spark):
    schema = "Customer string, Grade string, `Sub-grade` int, Grammage int, Width int, Product int, Strategy string, `Plant Forecast` string, `SEPT´26 allocation` string"
    good = spark.createDataFrame([("A ", "K", 1, 110, 2100, 7, "VMI", "5.5", "x")], schema)
    assert tuple(src.read_assignment(good).first()) == ("A", "2026-09", "K/01/110gsm/2100mm", 7, "VMI", 5.5)
    with pytest.raises(src.SourceError, match="repetida"):
        src.read_assignment(good.unionByName(good))
    with pytest.raises(src.SourceError, match="negativo"):
        src.read_assignment(good.withColumn("Plant Forecast", F.lit("-1")))
    wide = spark.createDataFrame([("A", "K", 1, 110, 2100, 7, 5.0), ("Result", None, None, None, None, None, 9.0)], "Customer string, Grade string, `Sub-grade` int, Grammage int, Width int, Product int, `06.2026` double")
    with pytest.raises(src.SourceError, match="Result"):
        src.read_internal(wide)
    assert src.read_internal(wide.where("Grade is not null")).first()["mes"] == "2026-06"


def test_files_that_arrive_are_loaded_once(spark, make_fact, folder):
    master = st.Versions(spark, folder + "/m")
    run = lambda: incremental.start(incremental.export_stream(spark, folder + "/in"), master, folder + "/c").awaitTermination(120)
    make_fact([("A", "s", D[0], 1.0), ("A", "s", D[1], 2.0)]).write.parquet(folder + "/in/a")
    spark.conf.set("spark.sql.streaming.schemaInference", "false")
    incremental.load_batch(spark.read.parquet(folder + "/in/a"), master)
    assert master.read().count() == 2
    make_fact([("A", "s", D[1], 2.0), ("A", "s", D[2], 3.0)]).coalesce(1).write.mode("append").parquet(folder + "/in")
    run()
    assert master.read().count() == 3
    versions = master.numbers()
    run()
    assert master.numbers() == versions
    with pytest.raises(incremental.LoadStopped):
        incremental.load_batch(make_fact([("A", "s", D[0], 7.0)]), master)


def test_tracking_comes_back_from_csv(spark, folder):
    from caudal.operators.tracking import TRACKING_COLUMNS

    row = {"run_id": "r1", "mes": "2024-01", "nivel": "total", "planta": "", "modelo": "ml_mean", "acierto": "0.9", "wape": "0.1", "bias_pct": "1.5", "n": "3", "real_TO": "10.0", "pronostico_TO": "9.0", "alerta": "", "creado_en": "2024-02-01 00:00:00", "estrategia": "h1", "corte": ""}
    line = lambda **changed: ",".join({**row, **changed}[c] for c in TRACKING_COLUMNS)
    text = [",".join(TRACKING_COLUMNS), line(), line(mes="2024-02", acierto="much"), line(mes=""), line(mes="2024-03") + ",more", line(mes="2024-04")]
    with open(f"{folder}/history.csv", "w") as out:
        out.write("\n".join(text) + "\n")
    lines = st.restore_tracking(spark, f"{folder}/history.csv", f"{folder}/tracking")
    assert lines.count() == 3
    got = {r["mes"]: (r["acierto"], r["planta"], r["n"], r["corte"]) for r in st.read_tracking(spark, f"{folder}/tracking").collect()}
    assert got == {"2024-01": (0.9, "", 3, None), "2024-04": (0.9, "", 3, None)}
    with open(f"{folder}/other.csv", "w") as out:
        out.write("a,b\n1,2\n")
    with pytest.raises(Exception, match="header|FAILED_READ"):
        st.tracking_from_csv(spark, f"{folder}/other.csv")
