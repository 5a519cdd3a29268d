import glob
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from meshq.__main__ import main
from meshq.functions import text, timecode, vectors
from meshq.operators import sensor
from meshq.plans.index import MeshIndex
from meshq.service import PointService, SensorService, serve
from meshq.sources import packed, points, sensors
from meshq.sources.catalog import Catalog


def test_matrix(spark, tmp_path):
    f = tmp_path / "set_50-2.txt"
    f.write_text("3 2\n1 2 9\n 3.5   4\n-5 6e2\n7 8\n")
    assert [(r.id, r.coords) for r in points.read_points(spark, str(f)).orderBy("id").collect()] == [(0, [1, 2]), (1, [3.5, 4]), (2, [-5, 600])]
    df = points.read_points(spark, str(f))
    points.write_matrix(df, str(tmp_path / "out"))
    assert sorted(map(str, points.read_points(spark, str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    f.write_text("1 2\n0 1 2 3\n")
    r = points.read_range_queries(spark, str(f)).first()
    assert (r.lo, r.hi, r.label) == ([0, 1], [2, 3], "set")
    points.write_range_queries(spark.createDataFrame([(0, [0.0, 1.5], [2.0, 3.0])], "qid long, lo array<double>, hi array<double>"), str(tmp_path / "ranges"))
    assert [(x.lo, x.hi) for x in points.read_range_queries(spark, str(tmp_path / "ranges")).collect()] == [([0, 1.5], [2, 3])]
    f.write_text("2 2\n1 2\n")
    with pytest.raises(ValueError):
        points.read_points(spark, str(f))
    f.write_text("1 2\n1\n")
    with pytest.raises(Exception, match="too few"):
        points.read_points(spark, str(f)).collect()


def test_synthetic(spark):
    top, low = points.synthetic(spark, 500, 2, 1, 100, [50])
    assert (top.count(), low.count()) == (10, 500)
    assert low.filter(F.exists("coords", lambda x: (x < 1) | (x > 100))).count() == 0 and low.groupBy("parent_id").count().select("count").distinct().count() == 1


def test_command_line(spark, tmp_path):
    (tmp_path / "p.txt").write_text("40 2\n" + "".join(f"{i % 7} {i // 7}\n" for i in range(40)))
    (tmp_path / "q.txt").write_text("1 2\n0 0\n")
    (tmp_path / "r.txt").write_text("1 2\n0 0 1 1\n")
    main(["build", "--points", str(tmp_path / "p.txt"), "--ratios", "5", "--index", str(tmp_path / "root/ix")])
    assert [r["id"] for r in main(["knn", "--queries", str(tmp_path / "q.txt"), "--index", str(tmp_path / "root/ix"), "-k", "3"])] == [0, 1, 7]
    assert main(["range", "--queries", str(tmp_path / "r.txt"), "--index", str(tmp_path / "root/ix")]) == [{"qid": 0, "ids": [0, 1, 7, 8]}]
    main(["range", "--queries", str(tmp_path / "r.txt"), "--index", str(tmp_path / "root/ix"), "--log", str(tmp_path / "log")])
    log = spark.read.option("header", True).csv(str(tmp_path / "log")).collect()
    assert [(x["Dataset"], x["Size"], x["Dim"], x["Query Type"], x["Query Count"], x["Median Log Volume"]) for x in log] == [("ix", "40", "2", "RANGE", "1", "0.000")]
    main(["generate", "--n", "60", "--dims", "2", "--ratios", "10", "--height", "2", "--index", str(tmp_path / "made")])
    assert MeshIndex.load(spark, str(tmp_path / "made")).level_sizes().collect()[0].n_points == 60
    with pytest.raises(ValueError):
        main(["generate", "--ratios", "10", "--height", "3", "--index", str(tmp_path / "no")])
    c = Catalog(spark, str(tmp_path / "root"))
    assert c.names() == ["ix"] and isinstance(c.get("ix"), MeshIndex)
    with pytest.raises(ValueError):
        c.get("..")


FILES = [("seq0001", "Image", "1715064100.000001", b"aa"), ("seq0001", "Image", "1715064101.5", b"bbbb"), ("seq0001", "Image", "1715064107", b""), ("seq1", "lidar_360", "1715064102", b""), ("seq0002", "livox_avia", "5.25", b"z"), ("seq3", "Image", "1715064102.25", b"c" * 100), ("other", "Image", "1", b"q")]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for seq, folder, stem, body in FILES:
        d = root / seq / folder
        d.mkdir(parents=True, exist_ok=True)
        (d / (stem + (".PNG" if folder == "Image" else ".npy"))).write_bytes(body)
    table = root.parent / "c.csv"
    table.write_text('\ufeffClassification,Position,Sequence,Timestamp,x\r\n7,"[1, 2.5, -3]",seq0001,1715064100.5,q\r\n')
    return root, table


@pytest.fixture(scope="module")
def built(spark, tree, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sensors") / "ix")
    records = sensors.read_tree(spark, str(tree[0]), payloads=True).unionByName(sensors.read_coords(spark, str(tree[1])))
    sensors.build(records, path, n=2, max_bytes=240, verify=True)
    return path


def test_tree_keeps_empty_files(spark, tree):
    got = sorted((r.seq, r.dtype, r.ts, r.size) for r in sensors.read_tree(spark, str(tree[0])).collect())
    assert got == [(1, "image", 1715064100.000001, 2), (1, "image", 1715064101.5, 4), (1, "image", 1715064107.0, 0), (1, "lidar_360", 1715064102.0, 0), (2, "livox_avia", 5.25, 1), (3, "image", 1715064102.25, 100)]


def test_sensor_index(spark, tree, built):
    ix = sensors.SensorIndex(spark, built)
    coord = struct.pack("<dddB7x", 1, 2.5, -3, 7)
    assert [r.dtype for r in ix.knn(1, 1715064100.4, 2).orderBy("rnk").collect()] == ["coord", "image"]
    assert ix.range([1, 2], 0, 1715064100.000001).count() == 2
    got = {bytes(r.payload) for r in ix.with_payload(ix.range([1], 1715064100, 1715064102)).collect()}
    assert got == {b"aa", b"bbbb", coord} and sensors.unpack_coord(coord) == (1, 2.5, -3, 7)
    # Padding and empty files are there if asked for: the second slot of the third chunk repeats the last time.
    assert ix.range([1], 1715064102, 1715064107, include_padding=True).count() == 4
    assert ix.range([1], 1715064102, 1715064107).count() == 0
    assert ix.counts(ix.range([1], 1715064100, 1715064102), ix.range_candidates([1], 1715064100, 1715064102), [1])["match_count"] == 3
    for bad in (lambda: ix.range([1], 5, 4), lambda: ix.knn(1, 5, 0), lambda: ix.range([], 1, 2)):
        with pytest.raises(ValueError):
            bad()


def test_packed_files(spark, built):
    ix = sensors.SensorIndex(spark, built)
    lines = sorted(ix.lines().collect(), key=lambda r: r.item_no)
    # Next-fit by hand, and every header and payload where its line says.
    size, file, at = packed.header_size(2), 0, 0
    order = [(1, "coord"), (1, "image"), (1, "lidar_360"), (1, "image"), (2, "livox_avia"), (3, "image")]
    assert sorted((r.seq, r.dtype) for r in lines) == sorted(order) and [r.item_no for r in lines] == list(range(6))
    assert [r.avg_timestamp for r in lines if r.seq == 1] == sorted(r.avg_timestamp for r in lines if r.seq == 1)
    for r in lines:
        total = size + sum(r.sizes)
        if at and at + total > 240:
            file, at = file + 1, 0
        assert (r.file_name, r.index_copy_offset) == (f"data_{file:04d}.bin", at)
        body = open(f"{built}/{r.file_name}", "rb").read()
        head = struct.unpack(packed.header_format(2), body[at : at + size])
        assert head[:4] == tuple(r.index_vector) and head[4:6] == (2, r.dtype_id) and packed.read_fixed_name(head[9]) == r.file_name
        at += total
    assert ix.verify().count() == 0 and file > 0
    with pytest.raises(ValueError):
        ix.payload("data_0000.bin", 0, 10**6)
    name = lines[0].file_name
    raw = bytearray(open(f"{built}/{name}", "rb").read())
    raw[3] ^= 1
    open(f"{built}/{name}", "wb").write(bytes(raw))
    assert [r.item_no for r in ix.verify().collect()] == [0]
    raw[3] ^= 1
    open(f"{built}/{name}", "wb").write(bytes(raw))


def test_files_are_filled_across_ranges(spark):
    # Next-fit by hand: ranges that end within a file, with it, and hold several.
    totals = [(i, 1 + i * 7919 % 23) for i in range(60)]
    for most in (23, 40, 100, 10**6):
        file, at, want = 0, 0, []
        for i, t in totals:
            if at and at + t > most:
                file, at = file + 1, 0
            want.append((i, file, at))
            at += t
        for each in (7, 20, 60):
            got = packed.place_groups(spark.createDataFrame(totals, "item_no long, total long"), most, each)
            assert sorted(map(tuple, got.select("item_no", "data_no", "base").collect())) == want


@pytest.fixture(scope="module")
def built_by_ranges(spark, tree, tmp_path_factory):
    """An index placed in ranges of two groups, whose data file has room for all."""
    path, place = str(tmp_path_factory.mktemp("ranges") / "ix"), packed.place_groups
    records = sensors.read_tree(spark, str(tree[0]), payloads=True).unionByName(sensors.read_coords(spark, str(tree[1])))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packed, "place_groups", lambda sizes, most: place(sizes, most, 2))
        sensors.build(records, path, n=2, verify=True)
    return sensors.SensorIndex(spark, path)


def test_lines_of_several_ranges(built_by_ranges):
    lines, at = sorted(built_by_ranges.lines().collect(), key=lambda r: r.item_no), 0
    for r in lines:
        assert (r.file_name, r.index_copy_offset, r.data_base_offset) == ("data_0000.bin", at, at + packed.header_size(2))
        at += packed.header_size(2) + sum(r.sizes)
    assert len(lines) == 6 and built_by_ranges.meta["data_files"] == ["data_0000.bin"]


def test_slots_of_several_ranges(built_by_ranges):
    at = 0
    for r in sorted(built_by_ranges.records().collect(), key=lambda r: (r.item_no, r.slot)):
        at += packed.header_size(2) if r.slot == 0 else 0
        assert (r.data_file, r.payload_offset) == ("data_0000.bin", at)
        at += r.size


@pytest.fixture(scope="module")
def built_of_ties(spark, tmp_path_factory):
    """Seven records of one time, in groups of four: the times of the last three, added as seconds, come to less than three times as much."""
    path, ts_us = str(tmp_path_factory.mktemp("ties") / "ix"), next(us for us in range(1704067211172425, 1704067212172425) if sum([us / 1e6] * 3) / 3 < us / 1e6)
    rows = [(1, "seq0001", "image", 0, ts_us / 1e6, ts_us, i, f"{i}", b"a" * i) for i in range(1, 8)]
    sensors.build(spark.createDataFrame(rows, "seq int, seq_name string, dtype string, dtype_id int, ts double, ts_us long, size long, path string, payload binary"), path, n=4, verify=True)
    return sensors.SensorIndex(spark, path)


def test_lines_of_equal_means(built_of_ties):
    lines = sorted(built_of_ties.lines().collect(), key=lambda r: r.item_no)
    assert [(r.item_no, r.valid_count, r.index_copy_offset) for r in lines] == [(0, 4, 0), (1, 3, packed.header_size(4) + 10)]
    assert len({r.avg_timestamp for r in lines}) == 1 and lines[0].avg_timestamp_us == lines[0].timestamp_us[0]


def test_slots_of_equal_means(built_of_ties):
    got = sorted((r.item_no, r.slot, r.size) for r in built_of_ties.records().collect())
    assert got == [(i // 4, i % 4, (i + 1) % 8) for i in range(8)]


def test_group_over_a_data_file(spark, tree, tmp_path):
    records = sensors.read_tree(spark, str(tree[0]), payloads=True)
    with pytest.raises(Exception, match="larger than a data file"):
        sensors.build(records, str(tmp_path / "x"), n=2, max_bytes=150)


def test_lines_are_checked(spark, built, tmp_path):
    import json
    import shutil

    good = json.loads(sorted(open(f).read().splitlines()[0] for f in glob.glob(f"{built}/index.jsonl/part-*") if os.path.getsize(f))[0])
    changes = [{"slot_count": 3}, {"valid_count": 3}, {"binary_index_record_size": 5}, {"index_vector": [1.0]}, {"sizes": [1]}, {"sizes": [-1, 0]}, {"data_offsets": [1, 2, 2]}, {"data_offsets": [0, 5, 4]}, {"valid_count": 0, "sizes": [5, 0], "data_offsets": [0, 5, 5]}, {"seq": 256}, {"file_name": "x" * 40}, {"timestamps": [1.0, 2.0, 3.0]}]
    for change in changes:
        path = tmp_path / "ix"
        shutil.rmtree(path, ignore_errors=True)
        shutil.copytree(built, path)
        shutil.rmtree(path / "index.jsonl")
        (path / "index.jsonl").mkdir()
        (path / "index.jsonl" / "part-0.json").write_text(json.dumps({**good, **change}) + "\n")
        ix = sensors.SensorIndex(spark, str(path))
        with pytest.raises(ValueError):
            ix.lines()  # too few
        with pytest.raises(Exception, match="line of item"):
            ix.checked(ix.raw).collect()
    with pytest.raises(ValueError):
        ix.candidate_lines(spark.createDataFrame([(10**6,)], "item_no long"))
    with pytest.raises(ValueError):
        sensors.load_meta(spark, built, group_size=3)


def test_dump(spark, built, tmp_path):
    ix = sensors.SensorIndex(spark, built)
    out = str(tmp_path / "dump")
    names = {r.name for r in ix.dump(ix.knn(1, 1715064100.4, 2), out).collect()}
    assert names == set(os.listdir(out)) and len(names) == 2 and any(n.startswith("match_0000_item0000") and n.endswith("_dtype4_1715064100_500000.coord.bin") for n in names)


def test_chunks_over_many_parts(spark):
    r = random.Random(4)
    rows = [(i % 2, "t", r.randint(0, 500), 1, i) for i in range(600)]
    df = spark.createDataFrame(rows, "seq int, dtype string, ts_us long, size long, id int")
    want = {}
    for s in (0, 1):
        for n, x in enumerate(sorted((t, i) for q, _, t, _, i in rows if q == s)):
            want[x[1]] = (n // 7, n % 7)
    assert {x.id: (x.chunk, x.slot) for x in sensor.chunk(df, 7, "id", rows_each=40).collect()} == want


def test_bad_coordinates(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Sequence,Timestamp,Position\nseq1,1,[]\n")
    with pytest.raises(ValueError):
        sensors.read_coords(spark, str(tmp_path / "bad.csv"))
    for i, row in enumerate(('seq1,1,"[1,2]",5', 'seq1,1,"[1,2,3]",256', 'sea1,1,"[1,2,3]",5')):
        f = tmp_path / f"bad{i}.csv"
        f.write_text(f"Sequence,Timestamp,Position,Classification\n{row}\n")
        with pytest.raises(Exception):
            sensors.read_coords(spark, str(f)).collect()


def test_errors_of_values(spark):
    one = spark.range(1)
    for bad in (text.parse_size(F.lit("5 kb")), text.parse_size(F.lit("9223372036854775808")), text.parse_seq(F.lit("seq256")), text.parse_seq(F.lit("seqx")), timecode.limbs(F.lit(-1).cast("long"))[0], timecode.seconds_to_us(F.lit(1e14)), vectors.l2_checked(vectors.vector([1]), vectors.vector([1, 2]))):
        with pytest.raises(Exception):
            one.select(bad).collect()
    us = [timecode.seconds_to_us(F.lit(x)) for x in (-0.0000005, 0.0000005, -1.0000005, 1715064100.0000005)]
    assert list(one.select(*us).first()) == [-1, 1, -1000001, 1715064100000000]
    assert text.size_in_bytes(" 2KiB ") == 2048 and text.parse_ratios("100,050") == [100, 50]
    for f, bad in ((text.size_in_bytes, "2 kb"), (text.parse_ratios, "5,,6"), (text.parse_ratios, "0"), (text.parse_seqs, "256"), (text.safe_name, ".."), (packed.fixed_name, "x" * 33)):
        with pytest.raises(ValueError):
            f(bad)


def test_sensor_command_line(spark, tree, tmp_path, capsys):
    path = str(tmp_path / "ix")
    main(["sensor-build", str(tree[0]), str(tree[1]), "--index", path, "--group-size", "2", "--max-data-file-size", "1KiB", "--verify"])
    got = main(["sensor-query", "--index", path, "--seq", "seq0001", "--timestamp", "1715064100.4", "--knn-k", "2", "--dump-dir", str(tmp_path / "d")])
    assert [r["dtype"] for r in got] == ["coord", "image"] and len(os.listdir(tmp_path / "d")) == 2
    got = main(["sensor-query", "--index", path, "--mode", "range", "--seq", "1,2", "--start", "0", "--end", "1715064101.5"])
    assert [r["size"] for r in got] == [1, 2, 32, 4] and "payload_abs_offset=" in capsys.readouterr().out
    with pytest.raises(ValueError):
        main(["sensor-query", "--index", path, "--mode", "range", "--seq", "1"])


def test_services(spark, tree, tmp_path):
    import json
    from urllib.request import urlopen

    (tmp_path / "p.txt").write_text("40 2\n" + "".join(f"{i % 7} {i // 7}\n" for i in range(40)))
    ask = lambda s, path, body: (lambda r: (r[0], json.loads(r[2])))(s.answer("POST", path, json.dumps(body).encode()))
    s = PointService(spark, str(tmp_path / "points"))
    assert ask(s, "/build-index", {"dataset_name": "a", "dataset_path": str(tmp_path / "none")})[0] == 400
    assert ask(s, "/build-index", {"dataset_name": "a", "dataset_path": str(tmp_path / "p.txt"), "ratios": "5"})[1]["already_exists"] is False
    assert ask(s, "/build-index", {"dataset_name": "a"})[1]["already_exists"] is True
    status, got = ask(s, "/query", {"dataset_name": "a", "query_type": "knn", "query_point": [0, 0], "k": 3})
    assert (status, got["result"], got["level_original_sizes"]) == (200, [0, 1, 7], [8, 40]) and got["candidate_count"] >= 3
    assert ask(s, "/query", {"dataset_name": "a", "query_type": "RANGE", "lower_bound": [0, 0], "upper_bound": [1, 1]})[1]["result"] == [0, 1, 7, 8]
    for bad in ({"query_point": [0]}, {"query_point": [0, 0], "k": 0}, {"query_point": [0, 0], "k": 1.5}, {"query_point": "0"}, {}):
        assert ask(s, "/query", {"dataset_name": "a", "query_type": "KNN", **bad})[0] == 400
    assert ask(s, "/query", {"dataset_name": "a", "query_type": "RANGE", "lower_bound": [2, 0], "upper_bound": [1, 1]})[0] == 400
    t = SensorService(spark, str(tmp_path / "sensors"))
    assert ask(t, "/build-index", {"dataset_name": "b", "dataset_root": str(tree[0]), "csv_path": str(tree[1]), "group_size": 2, "verify": True})[0] == 200
    status, got = ask(t, "/query", {"dataset_name": "b", "seq": [1, "seq0002"], "mode": "RANGE", "start": 0, "end": 1715064101.5})
    assert status == 200 and (got["match_count"], [m["payload_size"] for m in got["matches"]]) == (4, [1, 2, 32, 4])
    server = serve(t, port=0)
    try:
        body = urlopen(f"http://127.0.0.1:{server.server_address[1]}{got['matches'][3]['payload_url']}").read()
        assert body == b"bbbb"
        assert json.loads(urlopen(f"http://127.0.0.1:{server.server_address[1]}/datasets").read())["datasets"] == ["b"]
    finally:
        server.shutdown()
    assert t.answer("POST", "/payload", json.dumps({"dataset_name": "b", "data_file": "data_0000.bin", "offset": 0, "size": 10**7}).encode())[0] == 416
    assert t.answer("GET", "/payload?dataset_name=b&data_file=meta.json&offset=0&size=1")[0] == 404
