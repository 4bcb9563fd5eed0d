"""Readers and streams on small files."""

from __future__ import annotations

import itertools
import json
import os
import re
import socket
import threading
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from mudline.operators import baseline
from mudline.sources import feed, logs, packets, plans
from mudline.streaming import live


def test_fixed_csv(spark, tmp_path):
    head = "timestamp," + ",".join(packets.CSV_COLUMNS)
    good = "1705564800,1000,1001,50,100,20,120,15,2800,60,500,502,400,12,12,12.4,nan"
    (tmp_path / "a.csv").write_text(f"{head}\n{good}\n2024-01-18T08:00:00Z,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,inf\nbroken,1\n")
    got = packets.read_csv(spark, str(tmp_path / "a.csv")).orderBy("bit_depth").collect()
    assert [r.timestamp for r in got] == [1705564800, 1705564800] and all(r.gas_units == 0 for r in got)
    assert got[0].mud_temp_in == 100.0 and got[0].bit_diameter == 8.5


def test_timestamps_and_numbers(spark):
    texts = ["1705564800", "1705564800000", "1705564800.7", "2024-01-18 08:00:00", "2024-01-18T09:00:00+01:00", "18/01/2024 08:00:00", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(packets.epoch(F.col("t"))).collect()] == [1705564800] * 6 + [None]
    nums = spark.createDataFrame([(t,) for t in ["", "nan", "-", "null", "inf", " 3.5 ", None]], "t string")
    assert [r[0] for r in nums.select(packets.number(F.col("t"))).collect()] == [0, 0, 0, 0, 0, 3.5, 0]


def test_json_lines_skip_broken_ones(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"timestamp": 5, "rop": 3.0}) + "\n\n{oops\n" + json.dumps({"timestamp": 6}) + "\n")
    got = packets.read_json(spark, str(tmp_path / "x.json")).orderBy("timestamp").collect()
    assert [(r.timestamp, r.rop, r.wob) for r in got] == [(5, 3.0, 0.0), (6, 0.0, 0.0)]


def test_frames_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1234.5, 56.25), (1300.0, 0.0)], "bit_depth double, rop double")
    text = "\r\n".join(r.frame for r in packets.build_frame(rows).collect())
    (tmp_path / "w.txt").write_text("noise\r\n" + text + "\r\n&&\r\n!!\r\n&&\r\n0108999\r\n")
    got = packets.read_frames(spark, str(tmp_path / "w.txt")).orderBy("frame").collect()
    assert [(r.bit_depth, r.rop, r.wob) for r in got] == [(1234.5, 56.25, 0.0), (1300.0, 0.0, 0.0)]


def test_both_log_dialects(spark, tmp_path):
    (tmp_path / "m.csv").write_text('DateTime parsed,Bit Depth (MD) m,Weight on Bit kkgf,Stand Pipe Pressure kPa,Average Rotary Speed rpm,Rig Mode\n2024-01-18 08:00:00,100,10,1000,120,"Drilling, rotary"\n2024-01-18 08:00:01,0,0,0,0,x\n')
    m = logs.read_log(spark, str(tmp_path / "m.csv")).collect()
    assert len(m) == 1 and m[0].bit_depth == pytest.approx(328.084) and m[0].wob == pytest.approx(22.0462) and m[0].rig_state == "Drilling"
    (tmp_path / "s.csv").write_text("TIME,DEPTH,WOB(N),RPM,ROP(m/s),RIGACTIVITYCODE\n1705564800,100,44482.2,2,0.01,4\n")
    s = logs.read_log(spark, str(tmp_path / "s.csv"))
    r = s.first()
    assert r.rpm == 120 and r.wob == pytest.approx(10, rel=1e-4) and r.rop == pytest.approx(118.11, rel=1e-3) and r.rig_state == "Reaming"
    assert logs.summary(s).first().packets == 1
    with pytest.raises(ValueError, match="time or a depth"):
        logs.mapping(["a", "b"])


def test_xml_log(spark, tmp_path):
    (tmp_path / "l.xml").write_text("<logs><mnemonicList>TIME,WOB</mnemonicList><data>1,20</data><data>2,</data></logs>")
    got = logs.wide(logs.read_xml_log(spark, str(tmp_path / "l.xml")), ["TIME", "WOB"]).orderBy("row").collect()
    assert [(r.TIME, r.WOB) for r in got] == [("1", "20"), ("2", "")]


def whole_text(path):
    """Rows of a whole file at once, as the byte ranges must give them."""
    text = path.read_text()
    names = [n.strip() for n in re.search(r"(?s)<mnemonicList>(.*?)</mnemonicList>", text).group(1).split(",")]
    return [(i, n, v) for i, row in enumerate(re.findall(r"(?s)<data>(.*?)</data>", text)) for n, v in itertools.zip_longest(names, row.split(",")) if n]


@pytest.mark.parametrize("size", ["64", "1000", "1g"])
def test_xml_logs_by_byte_ranges(spark, tmp_path, size):
    """Ranges shorter than a row, than the head, and longer than a file; empty rows, line ends, a cut tail, two files."""
    head = "<?xml version='1.0'?>\n<logs><log><logCurveInfo mnemonic='é'/>" * 9 + "<logData>\n<mnemonicList>TIME, WOB,,RPM</mnemonicList>\n"
    for name, n in (("a", 300), ("b", 7), ("c", 0)):
        rows = "".join(f"<data>{i},{'' if i % 5 == 0 else i * 7},x{',ü' * (i % 3)}</data>" + "\n" * (i % 4) for i in range(n))
        (tmp_path / f"{name}.xml").write_text(head + rows + ("<data>9,9" if name == "b" else "</logData></log></logs>"))
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = logs.read_xml_log(spark, str(tmp_path)).collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    for name in "abc":
        mine = sorted((r.row, r.mnemonic, r.value) for r in got if r.file.endswith(f"{name}.xml"))
        assert mine == sorted(whole_text(tmp_path / f"{name}.xml"))


def test_live_feed_connects_again(spark, tmp_path):
    """Frames of two connections, cut across packets, with broken lines and an empty frame between."""
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for parts in ([b"noise&&\r\n01081000\r\n0113", b"50.5\r\n0117nan\r\n!!\r\n&&\r\n!!\r\n"], [b"&&\r\n01081001\r\nxxxx\r\n0119x\r\n!!\r\n&&\r\n0108"]):
            link, _ = server.accept()
            with link:
                for p in parts:
                    link.sendall(p)
                    time.sleep(0.3)
        server.close()

    threading.Thread(target=serve, daemon=True).start()
    feed.register(spark)
    stream = spark.readStream.format("level0").options(host="127.0.0.1", port=server.getsockname()[1], delay=0.2, attempts=3, timeout=5, spool=str(tmp_path / "spool")).load()
    q = stream.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60
    while time.time() < until and spark.table("feed").count() < 2:
        time.sleep(0.3)
    q.stop()
    got = [(r.bit_depth, r.rop, r.rpm, r.spp) for r in spark.table("feed").orderBy("bit_depth").collect()]
    assert got == [(1000.0, 50.5, 0.0, 0.0), (1001.0, 0.0, 0.0, 0.0)]


def test_live_feed_starts_again(spark, tmp_path):
    """Frames of three runs, one of which is planned again because its commit is lost: none is lost, none is there twice."""
    server, sent = socket.create_server(("127.0.0.1", 0)), [0]

    def serve():
        while True:
            try:
                link, _ = server.accept()
            except OSError:
                return
            with link:
                for _ in range(5):
                    link.sendall(f"&&\r\n0108{1000 + sent[0]}\r\n!!\r\n".encode())
                    sent[0] += 1
                time.sleep(3)

    threading.Thread(target=serve, daemon=True).start()
    feed.register(spark)

    def run(until):
        stream = spark.readStream.format("level0").options(host="127.0.0.1", port=server.getsockname()[1], delay=0.2, attempts=1, stale=2, spool=str(tmp_path / "spool")).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        ends = time.time() + 60
        try:
            while time.time() < ends and sum(p.numInputRows for p in q.recentProgress) < until:
                time.sleep(0.2)
            q.processAllAvailable()
        finally:
            q.stop()

    run(5)
    for n in (1, 2):
        last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
        if n == 2:
            last.unlink()
            (tmp_path / "cp" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
        run(5)
    server.close()
    got = sorted(r.bit_depth for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) >= 15 and got == [1000.0 + i for i in range(len(got))]
    assert len(list((tmp_path / "spool").glob("*.frames"))) <= 3


def test_spool_numbers_go_on(tmp_path):
    spool = feed.Spool(str(tmp_path))
    spool.put(0, [(1, 2.0), (2, 3.0)])
    spool.put(2, [(3, 4.0)])
    reader = feed.FeedReader({"host": "", "port": "1", "spool": str(tmp_path)})
    frames = lambda a, z: [r for p in reader.partitions({"frames": a}, {"frames": z}) for r in reader.read(p)]
    assert frames(0, 3) == [(1, 2.0), (2, 3.0), (3, 4.0)] and frames(1, 2) == [(2, 3.0)] and frames(3, 3) == []
    reader.commit({"frames": 3})
    assert reader.initialOffset() == {"frames": 2} and frames(2, 3) == [(3, 4.0)]
    with pytest.raises(RuntimeError, match="no longer"):
        frames(0, 3)
    with pytest.raises(ValueError, match="spool"):
        feed.FeedReader({"host": "", "port": "1"})


def test_mixed_folder_and_dispatch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "m.csv").write_text("DateTime parsed,Bit Depth (MD) m,Weight on Bit kkgf\n2024-01-18 08:00:00,100,10\n")
    (folder / "s.csv").write_text("TIME,DEPTH,WOB(N)\n1705564800,200,44482.2\n")
    (folder / "x.csv").write_text("a,b\n1,2\n")
    got = sorted((round(r.bit_depth, 2), round(r.wob, 2)) for r in packets.load(spark, str(folder)).collect())
    assert got == [(328.08, 22.05), (656.17, 10.0)]
    head = "when," + ",".join(packets.CSV_COLUMNS)
    (tmp_path / "f.csv").write_text(f"{head}\n1705564800,1000,1001,50,100,20,120,15,2800,60,500,502,400,12,12,12.4,7\n")
    fixed = packets.load(spark, str(tmp_path / "f.csv"))
    assert fixed.first().gas_units == 7 and packets.mud_changes(fixed).first().mud_temp_change == 20.0 and packets.circulating_only(fixed).count() == 0


def test_plans_and_knowledge_files(spark, tmp_path):
    body = '[[formations]]\nname = "B"\ndepth_top_ft = 2000\ndepth_base_ft = 2500\nhardness = 4.0\n[[formations]]\nname = "A"\ndepth_top_ft = 1000\ndepth_base_ft = 2000\n[formations.parameters.wob]\nmin = 5.0\noptimal = 10.0\nmax = 15.0\n'
    (tmp_path / "p.toml").write_text(body)
    got = plans.load_plan(spark, str(tmp_path / "p.toml")).collect()
    assert [r.name for r in got] == ["A", "B"] and got[0].hardness == 5.0 and got[1].hardness == 4.0
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.toml").write_text('x = 1')
    (tmp_path / "kb" / "b.toml.zst").write_bytes(zstandard.ZstdCompressor().compress(b'x = 2'))
    (tmp_path / "kb" / "c.toml").write_text('x = ')
    bodies = {os.path.basename(r.file): r.body for r in plans.read_toml_files(spark, str(tmp_path / "kb")).collect()}
    assert bodies == {"a.toml": '{"x": 1}', "b.toml.zst": '{"x": 2}', "c.toml": None}
    base = spark.createDataFrame([(1, "spp", 10, 2.0, 0.1, 0)], "well_id long, sensor string, n long, mean double, std double, outliers long")
    baseline.save(base, str(tmp_path / "base"))
    assert [tuple(r) for r in baseline.load(spark, str(tmp_path / "base")).collect()] == [(1, "spp", 10, 2.0, 0.1, 0)]
    base.drop("outliers").withColumn("version", F.lit(2)).write.parquet(str(tmp_path / "old"))
    assert baseline.load(spark, str(tmp_path / "old")).first().outliers == 0
    base.withColumn("version", F.lit(1)).write.parquet(str(tmp_path / "ancient"))
    with pytest.raises(ValueError, match="version"):
        baseline.load(spark, str(tmp_path / "ancient"))


def test_stream_summaries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(2):
        lines = [json.dumps({"timestamp": 1705564800 + part * 700 + i, "rop": float(i), "rig_state": "w"}) for i in range(10)]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines + lines[:3]))
    stream = live.timed(live.replay(spark, str(tmp_path / "in")), keys=("timestamp",))
    q = live.to_table(live.summaries(stream, "rig_state"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.n, r.rop) for r in got] == [(10, 4.5)]  # the second window is still open


def test_fan_out_writes_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(2):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({"timestamp": 10 * part + i, "rop": float(i)}) for i in range(5)))
    tables = {"all": (lambda b: b.select("timestamp", "rop"), str(tmp_path / "all")), "fast": (lambda b: b.filter("rop > 2").select("timestamp"), str(tmp_path / "fast"))}
    live.fan_out(live.replay(spark, str(tmp_path / "in")), tables, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 10 and spark.read.parquet(str(tmp_path / "fast")).count() == 4
    live.fan_out(live.replay(spark, str(tmp_path / "in")), tables, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 10
