"""Round trips of readers and writers, from files that the tests write."""

from __future__ import annotations

import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from reachway.sources import download, files, osm, shapefile


def test_csv_sources(spark, tmp_path):
    reg = tmp_path / "reg.csv"
    reg.write_text("COD_IPRESS;NOMBRE;CATEGORIA;INSTITUCION;ESTADO;DEPARTAMENTO;PROVINCIA;DISTRITO;UBIGEO;NORTE;ESTE\n1;A;II-1;M;Activo;Túmbes;p;d;1;-3.5;-80.5\n2;B;;M;BAJA;TUMBES;p;d;1;x;-80\n3;C;;M;BAJA;LIMA;p;d;1;1;1\n", encoding="utf-8")
    got = files.read_facilities(spark, str(reg), "tumbes").orderBy("facility_id").collect()
    assert [(r.facility_id, r.activo, r.capacidad, r.lon, r.lat) for r in got] == [("1", True, 15.0, -80.5, -3.5), ("2", False, 1.0, None, None)]
    pop = tmp_path / "pop.csv"
    pop.write_text("Extra,UBIGEO_INEI,Departamento,Provincia,Distrito,Cantidad\nz,10101,TUMBES,P,D,5\nz,10101,TUMBES,P,D,6\nz,20202,LIMA,P,D,1\n", encoding="utf-8")
    assert [(r.ubigeo, r.poblacion_distrital) for r in files.read_population(spark, str(pop), ["Tumbes"]).collect()] == [("010101", 11)]
    assert files.read_population(spark, str(pop), ["none"]).count() == 0


def test_json_csv_latex(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.25, None), ("c", None, 3)], "k string, v double, n int")
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert files.read_json(spark, str(tmp_path / "missing.json")) is None
    files.write_csv(df, str(tmp_path / "c"), single=True)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "k string, v double, n int").collect()), key=str) == [("a_b", 1.25, None), ("c", None, 3)]
    table = files.latex_table(df, "cap", "lab")
    assert r"a\_b & 1.2 & NaN \\" in table and "{lrr}" in table
    with pytest.raises(ValueError):
        files.latex_table(df, "c", "l", max_rows=1)


def _dbf(fields, records):
    head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(records), 33 + 32 * len(fields), 1 + sum(w for _, w in fields))
    return head + b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r" + b"".join(b" " + b"".join(v.encode().ljust(w) for v, (_, w) in zip(r, fields, strict=True)) for r in records)


def _shp(contents, kind):
    body, index, at = b"", b"", 50
    for i, c in enumerate(contents, 1):
        body += struct.pack(">2i", i, len(c) // 2) + c
        index += struct.pack(">2i", at, len(c) // 2)
        at += 4 + len(c) // 2
    head = lambda n: struct.pack(">i20xi", 9994, 50 + n // 2) + struct.pack("<2i", 1000, kind) + b"\0" * 64
    return head(len(body)) + body, head(len(index)) + index


def test_shapefiles(spark, tmp_path, monkeypatch):
    shapefile.register(spark)
    pts = [struct.pack("<i2d", 1, float(i), -float(i)) for i in range(5)]
    for name, data in zip(("shp", "shx"), _shp(pts, 1), strict=True):
        (tmp_path / f"p.{name}").write_bytes(data)
    (tmp_path / "p.dbf").write_bytes(_dbf([("OBJECTID", 4), ("NOM", 8)], [(str(i), f"ñ{i}") for i in range(5)]))
    df = spark.read.format("shapefile").load(str(tmp_path / "p.shp"))
    assert sorted((r.OBJECTID, r.NOM, r.lon, r.lat) for r in df.collect()) == [(str(i), f"ñ{i}", float(i), -float(i)) for i in range(5)]
    ring = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    hole = [(9, 9), (9.5, 9), (9, 9.5), (9, 9)]
    poly = struct.pack("<i4d2i2i", 5, 0, 0, 2, 2, 2, 9, 0, 5) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    for name, data in zip(("shp", "shx"), _shp([poly, struct.pack("<i", 0)], 5), strict=True):
        (tmp_path / f"d.{name}").write_bytes(data)
    (tmp_path / "d.dbf").write_bytes(_dbf([("IDDIST", 6)], [("010101",), ("010102",)]))
    a, b = spark.read.format("shapefile").load(str(tmp_path / "d.shp")).orderBy("IDDIST").collect()
    assert [(p.x, p.y) for p in a.ring] == ring and len(a.rings) == 2 and b.ring is None


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(k, v):
    return _varint(k << 3) + _varint(v) if isinstance(v, int) else _varint(k << 3 | 2) + _varint(len(v)) + v


def _zig(values):
    last, out = 0, b""
    for v in values:
        d = v - last
        out += _varint(d << 1 if d >= 0 else (-d << 1) - 1)
        last = v
    return out


def test_map_extracts(spark, tmp_path):
    strings = [b"", b"highway", b"residential", b"oneway", b"yes", b"maxspeed", b"30 mph"]
    table = b"".join(_field(1, s) for s in strings)
    dense = _field(1, _zig([1, 2, 3, 4])) + _field(8, _zig([0, 0, 10_000_000, 900_000_000])) + _field(9, _zig([-800_000_000, -799_900_000, -799_900_000, 0]))
    way = _field(1, 10) + _field(2, bytes([1, 5])) + _field(3, bytes([2, 6])) + _field(8, _zig([1, 2, 3]))
    one = _field(1, 11) + _field(2, bytes([1, 3])) + _field(3, bytes([2, 4])) + _field(8, _zig([3, 1]))
    block = _field(1, table) + _field(2, _field(2, dense)) + _field(2, _field(3, way) + _field(3, one))
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    data = b""
    for kind, body in ((b"OSMHeader", _field(1, b"")), (b"OSMData", blob)):
        head = _field(1, kind) + _field(3, len(body))
        data += struct.pack(">I", len(head)) + head + body
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(data)
    osm.register(spark)
    nodes, ways = (spark.read.format(f).load(str(path)) for f in ("osm_nodes", "osm_ways"))
    assert sorted((r.node_id, round(r.x, 4), round(r.y, 4)) for r in nodes.collect()) == [(1, -80.0, 0.0), (2, -79.99, 0.0), (3, -79.99, 1.0), (4, 0.0, 90.0)]
    n, w = osm.in_extract(nodes, ways, {"north": 0.5, "south": -1, "west": -81, "east": -79})
    assert sorted(r.node_id for r in n.collect()) == [1, 2, 3] and w.count() == 2
    edges = osm.road_edges(n, w)
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(1, 2), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert edges.filter("src = 1").first().length == pytest.approx(1111.95, abs=0.5)
    assert edges.filter(F.col("maxspeed") == "30 mph").count() == 4


def test_downloads(tmp_path):
    source = tmp_path / "s.zip"
    with zipfile.ZipFile(source, "w") as z:
        z.writestr("a.txt", "x")
    target = tmp_path / "t" / "s.zip"
    assert download.fetch(source.as_uri(), target) and download.fetch("file:///nowhere", target)
    assert not download.fetch("file:///nowhere", tmp_path / "u") and not (tmp_path / "u").exists()
    assert (download.unzip(target, tmp_path / "out") / "a.txt").read_text() == "x"
    with zipfile.ZipFile(source, "w") as z:
        z.writestr("../b.txt", "x")
    with pytest.raises(ValueError):
        download.unzip(source, tmp_path / "out2")


def test_graphs_fall_back_and_are_cached(spark, tmp_path):
    from reachway.functions.workers import ready
    from reachway.sources import graphs

    ready(spark)
    bad = tmp_path / "bad.osm.pbf"
    bad.write_bytes(struct.pack(">I", 3) + b"abc")
    nodes, edges, source = graphs.get_graph(spark, "costa", "walk", str(tmp_path / "c"), str(bad))
    assert source == "synthetic" and nodes.count() == 250 and edges.count() == 2 * 5 * 250
    again = graphs.get_graph(spark, "costa", "walk", str(tmp_path / "c"), str(bad))
    assert again[2] == "synthetic" and sorted(again[1].collect()) == sorted(edges.collect())


def test_layers_written_by_tasks(spark, tmp_path):
    """Points, polygons with holes and parts, and empty shapes, by several tasks; a second write replaces the first, files of no manifest are not read."""
    shapefile.register(spark)
    folder = str(tmp_path / "layer")
    points = spark.createDataFrame([(i, f"ñandú {i}" if i % 3 else None, float(i), -float(i) if i % 5 else None) for i in range(200)], "id long, nombre string, lon double, lat double")
    points.repartition(4).write.format("shapefile").mode("append").save(folder)
    (tmp_path / "layer" / "layer-lost.shp").write_bytes(b"half")
    back = spark.read.format("shapefile").load(folder)
    assert sorted((int(r.id), r.nombre, r.lon, r.lat) for r in back.collect()) == sorted((r.id, r.nombre, r.lon if r.lat is not None else None, r.lat) for r in points.collect())
    assert len(list((tmp_path / "layer").glob("*.dbf"))) == 4
    points.limit(3).coalesce(1).write.format("shapefile").mode("overwrite").save(folder)
    assert spark.read.format("shapefile").load(folder).count() == 3 and len(list((tmp_path / "layer").glob("*.dbf"))) == 1
    box = lambda x0, x1: [{"x": float(x), "y": float(y)} for x, y in ((x0, x0), (x1, x0), (x1, x1), (x0, x1))]
    shapes = spark.createDataFrame([("a", [box(0, 10), box(2, 4), box(20, 22)]), ("b", [box(0, 1)]), ("c", None)], "IDDIST string, rings array<array<struct<x:double,y:double>>>")
    shapes.write.format("shapefile").mode("append").save(str(tmp_path / "areas"))
    got = {r.IDDIST: r.rings for r in spark.read.format("shapefile").load(str(tmp_path / "areas")).collect()}
    assert {k: len(v or ()) for k, v in got.items()} == {"a": 3, "b": 1, "c": 0}
    turns = [sum((q.x - p.x) * (q.y + p.y) for p, q in zip(r, r[1:])) > 0 for r in got["a"]]
    assert turns == [True, False, True]  # outer rings run clockwise, holes the other way


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    shapefile.register(spark)
    folder = str(tmp_path / "layer")
    good = spark.createDataFrame([(1, 1.0, 2.0)], "id long, lon double, lat double")
    good.write.format("shapefile").mode("append").save(folder)
    bad = spark.createDataFrame([("x" * 300, 1.0, 2.0)], "id string, lon double, lat double")
    with pytest.raises(Exception, match="254"):
        good.withColumn("id", F.col("id").cast("string")).unionByName(bad).write.format("shapefile").mode("overwrite").save(folder)
    assert [r.id for r in spark.read.format("shapefile").load(folder).collect()] == ["1"]


def test_extracts_written_by_tasks(spark, tmp_path):
    osm.register(spark)
    folder = str(tmp_path / "x")
    nodes = spark.createDataFrame([(i, -80 + i / 1000, i / 2000) for i in range(500)], "node_id long, x double, y double")
    ways = spark.createDataFrame([(i, [i, i + 1, i + 2], {"highway": "residential", "name": f"ñ{i}"} if i % 7 else {}) for i in range(400)] + [(999, [], None)], "way_id long, refs array<long>, tags map<string,string>")
    nodes.repartition(3).write.format("osm_nodes").mode("append").save(folder)
    ways.repartition(2).write.format("osm_ways").mode("append").save(folder)
    n, w = (spark.read.format(f).load(folder) for f in ("osm_nodes", "osm_ways"))
    assert sorted((r.node_id, round(r.x, 6), round(r.y, 6)) for r in n.collect()) == sorted((r.node_id, round(r.x, 6), round(r.y, 6)) for r in nodes.collect())
    assert sorted((r.way_id, r.refs, sorted(r.tags.items())) for r in w.collect()) == sorted((r.way_id, r.refs, sorted((r.tags or {}).items())) for r in ways.collect())


def test_tables_of_a_set_change_together(spark, tmp_path, monkeypatch):
    from reachway.sources import versions

    path = str(tmp_path / "set")
    table = lambda v: spark.createDataFrame([(v,)], "v int")
    assert versions.read_set(spark, path) is None
    versions.write_set({"a": table(1), "b": table(1)}, path)
    broken = table(2).select(F.raise_error(F.lit("stopped")).cast("int").alias("v"))
    with pytest.raises(Exception, match="stopped"):
        versions.write_set({"a": table(2), "b": broken}, path)
    values = lambda: {n: df.first().v for n, df in versions.read_set(spark, path).items()}
    assert values() == {"a": 1, "b": 1}
    # a writer that dies before the manifest: its tables are whole, and still don't count
    with monkeypatch.context() as m:
        m.setattr(versions, "replace_bytes", lambda *_: (_ for _ in ()).throw(OSError("dead")))
        with pytest.raises(OSError):
            versions.write_set({"a": table(3), "b": table(3)}, path)
    assert values() == {"a": 1, "b": 1}
    old = versions.read_set(spark, path)
    versions.write_set({"a": table(4), "b": table(4)}, path)
    assert values() == {"a": 4, "b": 4} and old["a"].first().v == 1  # who has opened the old set still reads it
    for v in (5, 6):
        versions.write_set({"a": table(v), "b": table(v)}, path)
    assert values() == {"a": 6, "b": 6} and len(list((tmp_path / "set").glob("set-*"))) == 3  # two that count, or did, and the dead writer's


def test_overpass_by_tiles(spark):
    """A service that is busy at first, stops half-way once, and gives roads on borders to both tiles."""
    import http.server
    import json
    import threading
    import urllib.parse

    from reachway.sources import overpass

    places = {i: (-80 + i * 0.1, 1 + (i % 5) * 0.3) for i in range(21)}
    roads = {100 + k: [k, k + 1, k + 2] for k in range(19)}
    seen, lock = {}, threading.Lock()

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["data"][0]
            s, w, n, e = map(float, query.split("way[highway](")[1].split(")")[0].split(","))
            with lock:
                seen[query] = tries = seen.get(query, 0) + 1
            if tries == 1:
                return self.send_error(429)
            ways = {k: v for k, v in roads.items() if any(w <= places[i][0] <= e and s <= places[i][1] <= n for i in v)}
            found = [{"type": "way", "id": k, "nodes": v, "tags": {"highway": "residential"}} for k, v in ways.items()]
            found += [{"type": "node", "id": i, "lon": places[i][0], "lat": places[i][1]} for i in {i for v in ways.values() for i in v}]
            body = json.dumps({"elements": found[:1], "remark": "runtime error: timed out"} if tries == 2 else {"elements": found}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        box = {"south": 0.0, "west": -81.0, "north": 3.0, "east": -77.0}
        nodes, ways = overpass.elements(spark, box, tiles=3, url=url, pause=0.01, timeout=20)
        assert {r.node_id: (r.x, r.y) for r in nodes.collect()} == places and nodes.count() == len(places)
        assert {r.way_id: r.refs for r in ways.collect()} == roads and ways.count() == len(roads)
        assert len(seen) == 9 and set(seen.values()) == {3}  # read once, whatever is done with the tables
        with pytest.raises(RuntimeError, match="2 attempts"):
            overpass.asked(url, (0.0, 0.0, 0.5, 0.5), 20, 2, 0.01)
    finally:
        server.shutdown()
    cuts = overpass.tiles({"south": -1, "west": 0, "north": 1, "east": 9}, 3)
    assert cuts[0][:2] == (-1, 0) and cuts[-1][2:] == (1, 9) and cuts[0][3] == cuts[1][1]
