"""Hand-made cases: nulls, ties, band edges, zero weights, boundaries, repeated and null ids."""

from __future__ import annotations

import heapq
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachway import config
from reachway.functions import geo, text
from reachway.operators import access, graph, modes, population, quality, scenario


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_band_edges(spark):
    df = spark.createDataFrame([(t, 10, False) for t in (0.0, 30.0, 30.5, 60.0, 120.0, 120.1, -1.0, None)], "t_min double, poblacion long, t_min_estimado boolean")
    out = {r.banda: r.poblacion for r in access.coverage_bands(df).collect()}
    assert out == {"<= 30 min": 20, "<= 60 min": 20, "<= 120 min": 10, "> 120 min": 10, config.NO_ROUTE: 10}
    assert [r.banda for r in access.coverage_bands(df).collect()] == [*config.BAND_LABELS, config.NO_ROUTE]


def test_weighted_means_leave_out_null_groups_and_zero_weights(spark):
    data = [("a", 10.0, 1, False), ("a", 20.0, 3, True), ("a", None, 4, None), ("b", 5.0, 0, False), (None, 9.0, 9, False)]
    df = spark.createDataFrame(data, "distrito string, t_min double, poblacion long, t_min_estimado boolean")
    assert rows(access.weighted_mean_access(df, "distrito")) == [("a", 17.5, 37.5), ("b", None, None)]
    assert rows(access.weighted_mean_access(df.limit(0), "distrito")) == []


def test_gini(spark):
    def reference(values, weights):
        o = np.argsort(values, kind="stable")
        v, w = np.array(values, float)[o], np.array(weights, float)[o]
        cw, cx = (np.r_[0, np.cumsum(z) / z.sum()] for z in (w, v * w))
        return 1 - ((cx[1:] + cx[:-1]) * np.diff(cw)).sum()

    rnd = random.Random(5)
    data = [(float(rnd.randint(0, 50)), rnd.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame([*data, (None, 3)], "t_min double, poblacion long")
    assert access.gini_weighted(df).first()[0] == pytest.approx(reference(*zip(*data, strict=True)), abs=1e-12)
    assert access.gini_weighted(df.withColumn("t_min", F.col("t_min") * 7)).first()[0] == pytest.approx(reference(*zip(*data, strict=True)), abs=1e-12)
    assert access.gini_weighted(df.limit(0)).first()[0] is None
    assert access.gini_weighted(df.withColumn("t_min", F.lit(0.0))).first()[0] is None


def test_catchments_conserve_capacity(spark):
    rnd = random.Random(2)
    demand = spark.createDataFrame([(i, rnd.randint(0, 30)) for i in range(40)], "cp_id long, poblacion long")
    fac = spark.createDataFrame([(j, 1 + j) for j in range(6)], "facility_id long, capacidad long")
    m = spark.createDataFrame([(i, j, rnd.choice([10.0, 60.0, 60.5, None])) for i in range(40) for j in range(5)], "cp_id long, facility_id long, t_min double")
    out = access.two_step_floating_catchment(m, demand, fac)
    assert out.count() == 40
    total = out.join(demand, "cp_id").agg(F.sum(F.col("accesibilidad_2sfca") * F.col("poblacion"))).first()[0]
    assert total == pytest.approx(sum(1 + j for j in range(5)))


def test_nearest_takes_the_least_id_in_ties(spark):
    m = spark.createDataFrame([(1, 7, 5.0), (1, 3, 5.0), (1, 9, None), (2, 1, None)], "cp_id long, facility_id long, t_min double")
    assert rows(modes.nearest_facility(m)) == [(1, 3, 5.0)]


def test_modes_need_drive_and_count_missing_routes_as_changes(spark):
    m = spark.createDataFrame([("drive", 1, 1, 0.0), ("walk", 1, 1, 5.0), ("drive", 2, 1, 2.0), ("bike", 3, 1, 2.0)], "profile string, cp_id long, facility_id long, t_min double")
    out = {r.cp_id: r for r in modes.compare_modes(m).collect()}
    assert set(out) == {1, 2} and out[1].ratio_walk_drive is None and not out[1].facility_cambia_walk and out[2].facility_cambia_walk and out[2].ratio_bike_drive is None
    with pytest.raises(ValueError):
        modes.compare_modes(m, ("walk", "bike"))


@pytest.mark.parametrize("k,skip", [(1, False), (3, False), (4, True)])
def test_nearest_points_equal_brute_force_both_ways(spark, k, skip):
    rnd = random.Random(k)
    t = [(i, float(rnd.randint(0, 12)), float(rnd.randint(0, 12))) for i in range(60)]
    p = t if skip else [(1000 + i, rnd.uniform(-20, 40), rnd.uniform(-3, 14)) for i in range(50)]
    want = set()
    for i, x, y in p:
        best = sorted((math.sqrt((a - x) ** 2 + (b - y) ** 2), j) for j, a, b in t if not (skip and i == j))[:k]
        want |= {(i, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(best)}
    points, targets = (spark.createDataFrame([*v, (None, 1.0, 1.0)], "id long, x double, y double") for v in (p, t))
    for bound in (10**6, 5):
        got = {(r.id, r.rank, r.target, round(r.dist, 9)) for r in modes.nearest_points(points, targets, k, skip, bound).collect()}
        assert got == want
    assert modes.nearest_points(points, targets.limit(0), k).count() == 0


def test_utm_agrees_with_published_points(spark):
    # central meridian and equator; CN Tower (43.642567 N, 79.387139 W): zone 17, 630084 E, 4833439 N; Lima area mirrored south
    data = [(-81.0, 0.0), (-79.387139, 43.642567), (-75.0, -12.0)]
    df = modes.points_in_zones(spark.createDataFrame(data, "lon double, lat double"))
    a, b, c = df.collect()
    assert (a.utm_epsg, round(a.x, 3), round(a.y, 3)) == (32617, 500000.0, 0.0)
    assert b.utm_epsg == 32617 and abs(b.x - 630084) < 1 and abs(b.y - 4833438.5) < 1.5
    assert c.utm_epsg == 32718 and c.x == pytest.approx(500000) and c.y == pytest.approx(8673450, abs=60)


def dijkstra(edges, source):
    best, heap = {}, [(0.0, source)]
    while heap:
        t, n = heapq.heappop(heap)
        if n not in best:
            best[n] = t
            for a, b, s in edges:
                if a == n and s is not None:
                    heapq.heappush(heap, (t + s, b))
    return best


def test_shortest_paths_by_both_engines(spark):
    rnd = random.Random(9)
    e = [(rnd.randrange(40), rnd.randrange(40), float(rnd.randint(1, 9))) for _ in range(110)] + [(1, 2, None), (0, 1, 4.0), (0, 1, 2.0)]
    edges = spark.createDataFrame(e, "src long, dst long, travel_time double")
    sources = spark.createDataFrame([(0,), (7,), (99,), (7,)], "node long")
    want = {(s, n, t) for s in (0, 7, 99) for n, t in dijkstra(e, s).items()}
    for engine in ("broadcast", "relational"):
        assert {tuple(r) for r in graph.node_times(edges, sources, engine=engine).collect()} == want
        assert {tuple(r) for r in graph.node_times(edges, sources, 6.0, engine=engine).collect()} == {x for x in want if x[2] <= 6}


def test_matrix_runs_towards_facilities_and_keeps_unreachable_pairs(spark):
    edges = spark.createDataFrame([(1, 2, 60.0)], "src long, dst long, travel_time double")
    dem = spark.createDataFrame([("a", 1), ("b", 3)], "cp_id string, node_id long")
    fac = spark.createDataFrame([("f", 2)], "facility_id string, node_id long")
    assert sorted(rows(graph.travel_time_matrix(edges, dem, fac))) == [("a", "f", 1.0), ("b", "f", None)]
    assert rows(graph.travel_time_matrix(graph.reversed_edges(edges), dem, fac))[0][2] is None


def test_hulls(spark):
    assert geo.hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert geo.hull([(0, 0), (1, 1), (2, 2)]) == [(0, 0), (2, 2)] and geo.wkt([(0, 0), (2, 2)]) == "LINESTRING (0 0, 2 2)"
    edges = spark.createDataFrame([(i, j, 60.0) for i in range(9) for j in range(9) if i != j], "src long, dst long, travel_time double")
    nodes = spark.createDataFrame([(i, float(i % 3), float(i // 3)) for i in range(9)], "node_id long, x double, y double")
    fac = spark.createDataFrame([("f", 4), ("g", 77)], "facility_id string, node_id long")
    assert [(r.facility_id, r.threshold_min, r.n_nodes, r.area) for r in graph.isochrones(edges, nodes, fac, (1, 5)).orderBy("threshold_min").collect()] == [("f", 1, 9, 4.0), ("f", 5, 9, 4.0)]


def test_connected_components(spark):
    e = [(1, 2), (3, 2), (4, 5), (6, 6), (9, 8), (8, 7), (7, 10)]
    got = dict(rows(graph.connected_components(spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, travel_time double"))))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 7, 10: 7}


def test_polygons_hold_no_boundary_points(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    polygons = spark.createDataFrame([("k", [{"x": x, "y": y} for x, y in ring])] * 2, "ubigeo string, ring array<struct<x:double,y:double>>")
    pts = [("k", 1.0, 1.0, False), ("k", 2.0, 3.0, True), ("k", 0.0, 2.0, True), ("k", 4.0, 4.0, True), ("none", 9.0, 9.0, False), (None, 9.0, 9.0, False), ("k", None, None, True)]
    df = spark.createDataFrame(pts, "d string, lon double, lat double, want boolean")
    out = quality.flag_outside_polygon(df, polygons, "d")
    assert out.count() == len(pts) and out.filter("want <> flag_fuera_de_poligono").count() == 0
    assert quality.flag_outside_polygon(df, None, "d").filter("flag_fuera_de_poligono").count() == 0


def test_rules_in_order_and_report(spark):
    data = [(1, -75.0, -10.0, "a"), (1, -75.0, -10.0, None), (2, -10.0, -75.0, "MuÃ±oz"), (3, 0.0, 0.0, "c"), (4, None, -10.0, "d"), (5, 10.0, 10.0, "e"), (None, -75.0, -11.0, "f"), (None, -75.0, -12.0, None)]
    df = spark.createDataFrame(data, "id long, lon double, lat double, nombre string")
    kept = {r.id: r for r in quality.validated(df, "id").collect()}
    assert set(kept) == {1, 2, None} and kept[1].nombre == "a" and kept[2].nombre == "Muñoz" and (kept[2].lon, kept[2].lat) == (-75.0, -10.0) and kept[None].nombre == "f"
    r = quality.quality_report(df, "x", "id").first()
    assert (r.n_registros_inicial, r.n_registros_final, [x.registros_afectados for x in r.reglas]) == (8, 3, [2, 1, 1, 0, 2, 1])
    empty = quality.quality_report(df.limit(0), "x", "id").first()
    assert [x.registros_afectados for x in empty.reglas] == [0] * 6


def test_latest_row_wins_before_the_most_complete(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "old"), (1, "2024-02-01", None), (1, None, "undated")], "id long, u string, v string").withColumn("u", F.col("u").cast("date"))
    assert quality.deduplicated(df, "id", "u").first().v is None and quality.deduplicated(df, "id").first().v == "old"


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(text.norm_name(F.lit(" ñuñoa é "))) == "NUNOA E" and one(text.norm_name(F.lit(None).cast("string"))) == ""
    assert one(text.to_number(F.lit("NaN"))) is None and one(text.to_number(F.lit("-1e3"))) == -1000.0
    assert one(text.zero_padded(F.lit("1234567"))) == "1234567" and one(text.zero_padded(F.lit("12"))) == "000012"
    assert one(text.half_even_count(F.lit(2.5))) == 2 and one(text.half_even_count(F.lit(None).cast("double"))) == 0
    assert one(text.settlement_weight(F.lit("caserío"), F.lit(False))) == 1 and one(text.settlement_weight(F.lit("caserío"), F.lit(False), True)) == 2
    assert one(text.settlement_weight(F.lit("Ciudad"), F.lit(True))) == 60
    assert one(text.normalised_category(F.lit(None).cast("string"))) == "None" and one(text.capacity(F.lit(" II-1"))) == 1.0


def test_edge_times(spark):
    raw = spark.createDataFrame([(1, 2, 1000.0, "track", None), (1, 3, 1000.0, None, "30 mph"), (1, 4, 500.0, "primary", "0"), (1, 5, None, "motorway", "x")], "src long, dst long, length double, highway string, maxspeed string")
    drive = {r.dst: r.travel_time for r in graph.profile_edges(raw, "drive").collect()}
    assert set(drive) == {4, 5} and drive[4] is None and drive[5] == 0.0
    walk = {r.dst: r.travel_time for r in graph.profile_edges(raw, "walk").collect()}
    assert set(walk) == {2, 3, 4} and walk[2] == pytest.approx(720)


def test_population_is_shared_out(spark):
    places = spark.createDataFrame([("Lima", "Cañete", "Asia", "CIUDAD", True), ("LIMA", "CANETE ", "ASIA", "x", False), ("Lima", "Otra", "Otra", "x", False)], "departamento string, provincia string, distrito string, cat_poblad string, es_capital_distrito boolean")
    people = population.district_population(spark.createDataFrame([("1", "LIMA", "Cañete", "Asía", 60), ("1", "LIMA", "Cañete", "Asía", 62), (None, "LIMA", "x", "y", 5)], "UBIGEO_INEI string, Departamento string, Provincia string, Distrito string, Cantidad long"), ["lima"])
    assert [(r.ubigeo, r.poblacion_distrital) for r in people.collect()] == [("000001", 122)]
    assert sorted(r.poblacion for r in population.distributed(places, people).collect()) == [0, 2, 120]


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else None) for i in range(100)], "cp_id long, distrito string")
    got = dict(rows(population.stratified_sample(df, 10).groupBy("distrito").count()))
    assert got == {"a": 9, "b": 1}
    assert sorted(rows(population.stratified_sample(df, 10))) == sorted(rows(population.stratified_sample(df.repartition(7), 10)))
    assert population.stratified_sample(df, 100).count() == 100


def test_upgrades_must_be_strictly_faster(spark):
    m = spark.createDataFrame([(1, 5, 10.0), (1, 6, 9.0), (2, 5, 7.0), (3, 5, None), (9, 5, 1.0)], "cp_id long, facility_id long, t_min double")
    d = spark.createDataFrame([(1, 10.0, 100), (2, 7.0, 50), (3, None, 5)], "cp_id long, t_min double, poblacion long")
    up = spark.createDataFrame([(5,), (6,), (77,)], "facility_id long")
    out = scenario.upgrade(m, d, up)
    assert rows(out) == [(1, 6, 10.0, 9.0)] and rows(scenario.upgrade_gain(out, d)) == [(1, 100)]
    assert rows(scenario.upgrade_gain(scenario.upgrade(m, d, up.limit(0)), d)) == [(0, 0)]


def test_dashboard(spark):
    d = spark.createDataFrame([("a", 10.0, 5), ("b", None, 5), ("b", 90.0, 10)], "distrito string, t_min double, poblacion long")
    r = scenario.key_figures(d).first()
    assert (r.poblacion_total, r.poblacion_cubierta, r.poblacion_mas_60, r.poblacion_estimada, r.mediana_acceso) == (20, 5, 15, 5, 50.0)
    assert rows(scenario.worst_district(d)) == [("b", 90.0)] and scenario.worst_district(d.limit(0)).count() == 0
    assert scenario.chosen(d, distrito=[]).count() == 0 and scenario.chosen(d, distrito=None).count() == 3
    assert rows(access.histogram(d, "t_min", 4).orderBy("bin").select("bin", "n")) == [(0, 1), (3, 1)]


def test_delta_stepping_against_a_heap(spark):
    """Random graphs with parallel, zero, light and very heavy edges and dead ends, whatever the width of buckets."""
    for seed, delta in ((1, None), (2, 0.5), (3, 7.0), (4, 1e6)):
        rnd = random.Random(seed)
        edges = [(rnd.randrange(60), rnd.randrange(60), rnd.choice([0.0, 0.25, 1.0, rnd.randrange(1, 40) / 4, 300.0])) for _ in range(170)]
        sources = [0, 7, 59, 1000]
        adjacency = graph.Adjacency(*(np.array(c) for c in zip(*edges)))
        want = {(s, int(n), float(t)) for s in sources for n, t in zip(*adjacency.times(s))}
        df, start = spark.createDataFrame(edges, "src long, dst long, travel_time double"), spark.createDataFrame([(s,) for s in sources], "node long")
        got = graph.bucketed_times(df, start, delta=delta).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    near = {x for x in want if x[2] <= 3}
    assert {tuple(r) for r in graph.bucketed_times(df, start, limit_s=3.0, delta=1.0).collect()} == near
    with pytest.raises(ValueError, match="negative"):
        graph.bucketed_times(spark.createDataFrame([(1, 2, -1.0)], df.schema), start)


def test_dense_places_narrow_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHORTCUTS_EDGE", 3)
    edges = [(a, b, 1.0 + abs(a - b) / 8) for a in range(12) for b in range(12) if a != b] + [(11 + i, 12 + i, 2.0) for i in range(12)]
    df, start = spark.createDataFrame(edges, "src long, dst long, travel_time double"), spark.createDataFrame([(0,)], "node long")
    want = {(int(n), float(t)) for n, t in zip(*graph.Adjacency(*(np.array(c) for c in zip(*edges))).times(0))}
    assert {(r.node, r.seconds) for r in graph.bucketed_times(df, start).collect()} == want


def test_samples_of_hot_strata_and_repeated_rows(spark):
    rows = [(i, "hot", 1.0) for i in range(5000)] + [(i, f"s{i % 7}", 2.0) for i in range(5000, 6000)] + [(7777, "same", 3.0)] * 1500 + [(8000 + i, None, 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "cp_id long, distrito string, v double").repartition(6)
    got = population.stratified_sample(df, 500).collect()
    share = 500 / len(rows)
    counts = Counter(r[1] for r in rows if r[1])
    assert Counter(r.distrito for r in got) == {s: min(n, max(1, round(n * share))) for s, n in counts.items()}
    assert max(Counter(r.cp_id for r in got if r.distrito != "same").values()) == 1
    again = population.stratified_sample(df.repartition(3), 500).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert Counter(map(tuple, population.stratified_sample(df, 500, seed=1).collect())) != Counter(map(tuple, got))


def test_rounds_that_do_not_suffice_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "src long, dst long, travel_time double")
    start = spark.createDataFrame([(0,)], "node long")
    with pytest.raises(RuntimeError, match="still change"):
        graph.node_times(edges, start, engine="relational", rounds=2)  # rounds are buckets of a dozen edges
    whole = {r.node: r.seconds for r in graph.node_times(edges, start, engine="relational").collect()}
    assert whole == {i: float(i) for i in range(31)}


def test_hulls_of_parts_are_the_whole_hull(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    monkeypatch.setattr(graph, "HULL_POINTS", 20)
    nodes = [(i, rnd.uniform(0, 9), rnd.uniform(0, 9)) for i in range(400)]
    edges = spark.createDataFrame([(i, 0, 60.0 * (1 + i % 12)) for i in range(1, 400)], "src long, dst long, travel_time double")
    made = graph.isochrones(edges, spark.createDataFrame(nodes, "node_id long, x double, y double").repartition(6), spark.createDataFrame([("f", 0)], "facility_id string, node_id long"), (5, 12)).collect()
    for r in made:
        own = [(x, y) for i, x, y in nodes if i == 0 or 1 + i % 12 <= r.threshold_min]
        assert r.n_nodes == len(own) and r.area == pytest.approx(geo.area(geo.hull(own))) and r.geometry == geo.wkt(geo.hull(own))


def test_names_are_decomposed(spark):
    import unicodedata

    names = ["Šiauliai", "  Łódź ", "ﬁn Ｆｕｌｌ", "ĳ ǆ Ⅷ", "ñandú", "ñ", "İstanbul", "Ἀθήνα", "straße", "ascii only", None, " x\x1c"]
    plain = lambda n: "".join(c for c in unicodedata.normalize("NFKD", (n or "").strip().upper()) if not unicodedata.combining(c))
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string")
    assert [r[0] for r in df.orderBy("i").select(text.norm_name(F.col("n"))).collect()] == [plain(n) for n in names]
