"""The whole study on a synthetic department, and the streaming gate."""

from __future__ import annotations

from reachway.plans import pipeline
from reachway.sources import synthetic
from reachway.streaming.gate import gate, rejected


def test_dirt_occurs(spark):
    d = synthetic.demand(spark, "costa", 400)
    assert d.filter("lon = 0").count() and d.filter("lat < -50").count() and d.filter("lon = 10").count()
    assert sorted(map(str, d.collect())) == sorted(map(str, synthetic.demand(spark, "costa", 400).collect()))


def test_synthetic_study(spark, tmp_path):
    s = pipeline.synthetic_study(spark, ["costa"], n_demand=60, n_facilities=30, n_nodes=60)
    pipeline.export(s, str(tmp_path))
    read = lambda n: spark.read.parquet(f"{tmp_path}/parquet/{n}")
    m = read("demanda_metrics")
    assert 40 < m.count() <= 60 and m.select("cp_id").distinct().count() == m.count() and m.filter("t_min IS NULL").count() == 0
    assert read("isochrones").count() and read("sfca_2step").count() == m.count() and read("snap_report").count() == 7
    assert read("coverage_bands").groupBy().sum("poblacion").first()[0] == m.groupBy().sum("poblacion").first()[0]
    assert (tmp_path / "csv" / "access_by_distrito").exists() and (tmp_path / "json" / "summary").exists() and (tmp_path / "tables" / "coverage_bands").exists()


def test_gate(spark, tmp_path):
    d = synthetic.demand(spark, "costa", 100).withColumnRenamed("lat", "lat")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = gate(stream, ["nombre"], "cp_id").writeStream.format("memory").queryName("gated").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = gate(d, ["nombre"], "cp_id")
    assert sorted(r.cp_id for r in spark.table("gated").collect()) == sorted(r.cp_id for r in want.collect())
    assert want.count() + rejected(d).count() == d.count() and rejected(d).count() > 0
