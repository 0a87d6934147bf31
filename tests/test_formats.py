"""Registries and turn files as data sources."""

import os

from earshot.sources import files, formats


def test_registry_cells_with_line_breaks(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.txt").write_bytes('# note\n\nsource|show|extra\n "one" | "two\n# not a note\n\n""x"" | y" |3\nsource|show|extra\nlast\n'.encode())
    (tmp_path / "b.txt").write_bytes("﻿show | source\r\nü|é\r\n".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"no|header\nx|y\n")
    df = spark.read.format("registry").schema("source string, show string, url string, extra string").load(str(tmp_path))
    want = {("one", 'two\n# not a note\n\n"x" | y', "", "3"), ("source", "show", "", "extra"), ("last", "", "", ""), ("é", "ü", "", "")}
    assert {tuple(r) for r in df.collect()} == want and df.count() == 4
    (tmp_path / "none").mkdir()
    assert spark.read.format("registry").load(str(tmp_path / "none")).count() == 0


def test_turns_as_batch_and_as_stream(spark, tmp_path):
    formats.register(spark)
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    os.mkdir(source)

    def put(name, at, text):
        with open(f"{source}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{source}/{name}", ns=(at, at))

    def run():
        stream = spark.readStream.format("rttm").load(source)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(formats.TURNS).parquet(out).collect())

    put("a.rttm", 10**18, "SPEAKER a 1 0.5 1.25 <NA> <NA> s1 <NA>\nSPKR-INFO a 1 0 1 x x s1\nSPEAKER a 1 x 1 <NA> <NA> s1\nSPEAKER a 1\n")
    first = run()
    assert first == [("a", "s1", 0.5, 1.75)]
    put("b.rttm", 10**18, "SPEAKER b 1 2 1 <NA> <NA> s2 <NA>\n")  # same time, later path
    put("c.rttm", 10**18 + 5, "SPEAKER c 1 3 1 <NA> <NA> s3 <NA>\n")
    both = run()
    assert both == [*first, ("b", "s2", 2.0, 3.0), ("c", "s3", 3.0, 4.0)]
    assert run() == both
    batch = spark.read.format("rttm").load(source)
    assert sorted(tuple(r) for r in batch.collect()) == both
    assert sorted(tuple(r) for r in batch.collect()) == sorted(tuple(r) for r in files.read_rttm(spark, source).select(*batch.columns).collect())
