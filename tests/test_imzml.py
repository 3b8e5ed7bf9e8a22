import numpy as np
import pytest

from ionlake.sources import imzml
from ionlake.streaming import live

ROWS = [(i, i % 3 + 1, i // 3 + 1, 1, [100.0, 101.0, 102.5], [float(i), 2.0, 0.5]) for i in range(6)]


@pytest.mark.parametrize("mode", ["continuous", "processed"])
def test_round_trip(spark, tmp_path, mode):
    imzml.register(spark)
    df = spark.createDataFrame(ROWS, imzml.SCHEMA).coalesce(2)
    df.write.format("imzml").mode("append").option("mode", mode).save(str(tmp_path / "out"))
    got = spark.read.format("imzml").load(str(tmp_path / "out"))
    assert sorted((r["x"], r["y"], tuple(r["mz"]), tuple(r["intensity"])) for r in got.collect()) == sorted((r[1], r[2], tuple(r[4]), tuple(r[5])) for r in ROWS)
    box = spark.read.format("imzml").option("x1", 1).option("y1", 1).option("x2", 2).option("y2", 1).load(str(tmp_path / "out"))
    assert sorted((r["x"], r["y"]) for r in box.collect()) == [(1, 1), (2, 1)]
    fields = {r["field"]: r["value"] for r in imzml.metadata(spark, str(tmp_path / "out")).collect()}
    assert fields[mode] == "true" and fields["profile"] == "true"


def test_slices_of_one_file(tmp_path):
    stem = str(tmp_path / "one")
    rows = [dict(zip(("spectrum_id", "x", "y", "z", "mz", "intensity"), r, strict=True)) for r in ROWS]
    assert imzml.write_pair(stem, iter(rows)) == 6
    reader = imzml.ImzMLReader({"path": f"{stem}.imzML", "slices": "4"})
    ids = [i for p in reader.partitions() for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert ids == list(range(6))
    assert np.allclose(next(imzml.read_spectra(f"{stem}.imzML", 5))[4], [100.0, 101.0, 102.5])


def test_columns_that_are_not_asked_for_are_not_read(spark, tmp_path, monkeypatch):
    stem = str(tmp_path / "one")
    rows = [dict(zip(("spectrum_id", "x", "y", "z", "mz", "intensity"), r, strict=True)) for r in ROWS]
    imzml.write_pair(stem, iter(rows))
    asked = []
    plain = imzml.read_blocks
    monkeypatch.setattr(imzml, "read_blocks", lambda ibd, wanted: asked.extend(wanted) or plain(ibd, wanted))
    got = list(imzml.read_spectra(f"{stem}.imzML", kinds=["intensity"]))
    assert [r[4] for r in got] == [None] * 6 and [r[5][0] for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert {n for _, n in asked} == {12} and len(asked) == 6  # intensities are of 4 bytes, m/z of 8
    imzml.register(spark)
    df = spark.read.format("imzml").schema("y int, intensity array<double>").load(f"{stem}.imzML")
    assert sorted((r["y"], r["intensity"][0]) for r in df.collect()) == [(i // 3 + 1, float(i)) for i in range(6)]


def test_adjoining_arrays_are_read_at_once(tmp_path):
    class Seeks:
        def __init__(self, f):
            self.f, self.n = f, 0

        def seek(self, at):
            self.n += 1
            self.f.seek(at)

        def read(self, n):
            return self.f.read(n)

    (tmp_path / "x").write_bytes(bytes(range(100)))
    with open(tmp_path / "x", "rb") as f:
        s = Seeks(f)
        got = imzml.read_blocks(s, {(0, 10), (10, 5), (15, 5), (40, 4)})
    assert s.n == 2 and got == {(0, 10): bytes(range(10)), (10, 5): bytes(range(10, 15)), (15, 5): bytes(range(15, 20)), (40, 4): bytes(range(40, 44))}


def test_only_committed_pairs_are_read(tmp_path):
    rows = [dict(zip(("spectrum_id", "x", "y", "z", "mz", "intensity"), r, strict=True)) for r in ROWS]
    out = str(tmp_path / "out")
    w = imzml.ImzMLWriter({"path": out}, False)
    lost = w.write(iter(rows))  # a task that was run again
    kept, empty = w.write(iter(rows)), w.write(iter([]))
    with pytest.raises(FileNotFoundError):
        imzml.files_of(out)
    w.commit([kept, empty])
    assert len(imzml.files_of(out)) == 1 and len(list((tmp_path / "out").iterdir())) == 2 and lost.stem != kept.stem
    with pytest.raises(FileExistsError):
        imzml.ImzMLWriter({"path": out}, False)
    # a failed job that would overwrite leaves the old spectra, a committed one replaces them
    w = imzml.ImzMLWriter({"path": out}, True)
    w.write(iter(rows))
    w.abort([None])
    assert len(list(imzml.read_spectra(imzml.files_of(out)[0]))) == 6 and len(list((tmp_path / "out").iterdir())) == 2
    w = imzml.ImzMLWriter({"path": out}, True)
    w.commit([w.write(iter(rows[:2]))])
    assert len(list(imzml.read_spectra(imzml.files_of(out)[0]))) == 2


def test_auto_mode_and_statistics(tmp_path):
    rows = [dict(zip(("spectrum_id", "x", "y", "z", "mz", "intensity"), r, strict=True)) for r in ROWS]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    imzml.write_pair(one, iter(rows), "auto", False, stats=True)
    imzml.write_pair(two, iter([*rows, {**rows[0], "mz": [1.0, 2.0, 3.0]}]), "auto")
    assert imzml.options_from(f"{one}.imzML") == {"mode": "continuous", "profile": "false"}
    assert imzml.options_from(f"{two}.imzML") == {"mode": "processed", "profile": "true"}
    assert [list(r[4]) for r in imzml.read_spectra(f"{two}.imzML")] == [[100.0, 101.0, 102.5]] * 6 + [[1.0, 2.0, 3.0]]
    header = open(f"{one}.imzML").read()
    assert 'accession="MS:1000285" name="" value="7.5"' in header and 'accession="MS:1000504" name="" value="100.0"' in header
    assert [list(r[5]) for r in imzml.read_spectra(f"{one}.imzML")] == [r["intensity"] for r in rows]


def test_unequal_lengths_are_refused(tmp_path):
    with pytest.raises(ValueError):
        imzml.write_pair(str(tmp_path / "bad"), iter([{"x": 1, "y": 1, "z": 1, "mz": [1.0], "intensity": []}]))


def test_stream_of_spectra(spark, tmp_path):
    spark.createDataFrame(ROWS, imzml.SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = live.preprocess(live.read_spectra(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("spectra_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("spectra_out").collect()
    assert len(got) == 6 and all(abs(sum(r["intensity"]) - 3) < 1e-9 or sum(r["intensity"]) == 0 for r in got)
    total = live.running_summary(live.read_spectra(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("summary_out").outputMode("complete").start()
    total.processAllAvailable()
    total.stop()
    assert {(r["y"], r["spectra"], r["points"]) for r in spark.table("summary_out").collect()} == {(1, 3, 9), (2, 3, 9)}


def many(n=300, seed=3):
    rng = np.random.default_rng(seed)
    return [{"spectrum_id": i, "x": i % 17 + 1, "y": i // 17 + 1, "z": 1, "mz": (100 + np.sort(rng.random(rng.integers(1, 30)))).tolist(), "intensity": None} for i in range(n)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two pairs of different sizes."""
    out = tmp_path_factory.mktemp("pairs")
    for name, n in (("a", 300), ("b", 41)):
        imzml.write_pair(str(out / name), ({**r, "intensity": [float(r["spectrum_id"])] * len(r["mz"])} for r in many(n)))
    return str(out)


@pytest.mark.parametrize("slices", [1, 2, 7, 60, 999])
def test_slices_read_disjoint_bytes_and_number_as_one_scan_does(folder, monkeypatch, slices):
    monkeypatch.setattr(imzml, "STEP", 512)
    reader = imzml.ImzMLReader({"path": folder, "slices": str(slices)})
    parts = reader.partitions()
    assert len(parts) == 2 * slices
    for file in imzml.files_of(folder):
        mine = [p for p in parts if p.file == file]
        assert all(a.stop == b.start for a, b in zip(mine, mine[1:])) and mine[-1].stop == mine[0].head.size
        begun = [byte for p in mine for byte, _ in imzml.spectra_in(file, p.head, p.start, p.stop)]
        assert begun == sorted(set(begun)) and all(p.start <= byte < p.stop for p in mine for byte, _ in imzml.spectra_in(file, p.head, p.start, p.stop))
        assert [p.first for p in mine] == [sum(byte < p.start for byte in begun) for p in mine]
    got = [(i, x, tuple(m)) for p in parts for b in reader.read(p) for i, x, m in zip(*(b.column(c).to_pylist() for c in ("spectrum_id", "x", "mz")), strict=True)]
    plain = [(number << 32 | k, s[1], tuple(s[4])) for number, f in enumerate(imzml.files_of(folder)) for k, s in enumerate(imzml.read_spectra(f))]
    assert got == plain and len(got) == 341
    scanned = [s for f in imzml.files_of(folder) for s in imzml.scan_header(f) if not isinstance(s, dict)]
    assert [s.x for s in scanned] == [x for _, x, _ in got]


def test_a_task_reads_little_more_than_its_range(folder, monkeypatch):
    monkeypatch.setattr(imzml, "STEP", 512)
    read = []
    plain = imzml.opened

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n):
            read.append(len(out := self.f.read(n)))
            return out

        def seek(self, at):
            self.f.seek(at)

        def size(self):
            return self.f.size()

    reader = imzml.ImzMLReader({"path": folder, "slices": "5"}, ["x"])
    parts = reader.partitions()
    monkeypatch.setattr(imzml, "opened", lambda path: Counted(plain(path)) if path.endswith("imzML") else plain(path))
    for p in parts:
        read.clear()
        assert sum(b.num_rows for b in reader.read(p)) > 0
        assert sum(read) <= p.stop - p.start + 3 * 512 + 1500  # a spectrum's header is shorter than 1,500 bytes


def test_filters_are_pushed_and_their_arrays_never_read(spark, folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, StringContains

    reader = imzml.ImzMLReader({"path": folder})
    left = list(reader.pushFilters([EqualTo(("x",), 3), GreaterThanOrEqual(("y",), 2), In(("z",), (1,)), StringContains(("x",), "1"), EqualTo(("mz",), 1)]))
    assert len(left) == 2
    asked = []
    plain = imzml.read_blocks
    monkeypatch.setattr(imzml, "read_blocks", lambda ibd, wanted: asked.extend(wanted) or plain(ibd, wanted))
    got = [xy for p in reader.partitions() for b in reader.read(p) for xy in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
    want = [(r["x"], r["y"]) for n in (300, 41) for r in many(n) if r["x"] == 3 and r["y"] >= 2]
    assert sorted(got) == sorted(want) and len(asked) == 2 * len(want)
    imzml.register(spark)
    df = spark.read.format("imzml").load(folder).where("x = 3 and y >= 2 and size(mz) > 0")
    assert df.count() == len(want)
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(x,3)" in plan.replace(" ", "") or "x = 3" in plan
    one = spark.read.format("imzml").load(folder).where("spectrum_id = 4294967296 + 7").collect()
    assert [(r["x"], r["spectrum_id"] & 0xFFFFFFFF) for r in one] == [(8, 7)]


def test_layout_table_and_storage_keys(spark, tmp_path):
    imzml.register(spark)
    spectra = spark.createDataFrame([(i, i + 1, 1, 1, [1.0, 2.0, 3.0 + i % 2], [float(i % 3)] * 3) for i in range(12)], imzml.SCHEMA).coalesce(1)
    for dedup, unique in (("false", 24), ("true", 5)):
        path = str(tmp_path / dedup)
        spectra.write.format("imzml").mode("append").option("dedup", dedup).save(path)
        got = imzml.layout(spark, path)
        assert got.count() == 12 and {r["mz_length"] for r in got.collect()} == {3} and {r["intensity_type"] for r in got.collect()} == {"<f4"}
        assert tuple(imzml.storage_duplicates(got).first()) == (24, unique, 24 - unique)
        back = spark.read.format("imzml").load(path)
        assert sorted((r["x"], tuple(r["mz"]), tuple(r["intensity"])) for r in back.collect()) == sorted((r["x"], tuple(r["mz"]), tuple(r["intensity"])) for r in spectra.collect())
        assert [r["header_offset"] for r in got.orderBy("spectrum_id").collect()] == sorted(r["header_offset"] for r in got.collect())


def test_metadata_travel_with_spectra(spark, tmp_path):
    from ionlake.plans.pipeline import Pipeline

    imzml.register(spark)
    meta = {"pixel_size_x": "50", "pixel_size_y": "25", "scan_direction": True, "instrument_model": 'a "new" & <odd> one', "line_scan_direction": True, "profile": True}
    imzml.write_pair(str(tmp_path / "one"), iter([dict(zip(("spectrum_id", "x", "y", "z", "mz", "intensity"), r, strict=True)) for r in ROWS]), "auto", meta=meta)
    df = spark.read.format("imzml").load(str(tmp_path / "one.imzML"))
    held = imzml.metadata_of(df.schema)
    assert {k: held[k] for k in meta} == meta and held["continuous"] is True
    out = Pipeline(df).normalization("tic").start()
    assert imzml.metadata_of(out.where("x > 0").schema) == held
    peaks = Pipeline(df).peak_pick(width=3, snr=None).start()
    said = imzml.metadata_of(peaks.schema)
    assert said["centroid"] is True and "profile" not in said and said["pixel_size_x"] == "50"
    imzml.with_metadata(peaks.drop("i"), pixel_size_x="10", continuous=None).write.format("imzml").mode("append").save(str(tmp_path / "peaks"))
    again = imzml.metadata_of(spark.read.format("imzml").load(str(tmp_path / "peaks")).schema)
    assert again["centroid"] is True and again["pixel_size_x"] == "10" and again["instrument_model"] == meta["instrument_model"] and again["scan_direction"] is True and "profile" not in again


def test_damaged_spectra_are_rows_that_say_so(spark, tmp_path):
    imzml.register(spark)
    stem = str(tmp_path / "bad")
    imzml.write_pair(stem, iter([{**r, "intensity": [1.0] * len(r["mz"])} for r in many(20)]))
    text = open(f"{stem}.imzML").read().split("<spectrum ")
    text[4] = text[4].replace('ref="intensities"', 'ref="unknown"')  # an array without a kind
    text[6] = text[6].replace('accession="IMS:1000102" name="" value="', 'accession="IMS:1000102" name="" value="x', 1)  # a bad number
    text[8] = text[8].replace("<scan>", "<scan")  # no XML
    open(f"{stem}.imzML", "w").write("<spectrum ".join(text))
    size = (tmp_path / "bad.ibd").stat().st_size
    with open(f"{stem}.ibd", "r+b") as f:
        f.truncate(size - 2)  # the last array is cut
    df = spark.read.format("imzml").schema(imzml.SCHEMA + ", _corrupt string").load(f"{stem}.imzML")
    rows = {r["spectrum_id"]: r for r in df.collect()}
    assert len(rows) == 20 and {k for k, r in rows.items() if r["_corrupt"]} == {3, 5, 7, 19}
    assert all(r["mz"] is None and r["intensity"] is None for r in rows.values() if r["_corrupt"]) and all(len(r["mz"]) == len(r["intensity"]) for r in rows.values() if not r["_corrupt"])
    assert "intensity" in rows[3]["_corrupt"] and "ibd" in rows[19]["_corrupt"]
    with pytest.raises(Exception, match="imzml: spectrum"):
        spark.read.format("imzml").load(f"{stem}.imzML").collect()


def test_uris_and_missing_paths(spark, folder, tmp_path):
    imzml.register(spark)
    assert spark.read.format("imzml").load(f"file://{folder}").count() == 341
    assert imzml.files_of(f"file://{folder}/a.imzML") == [f"{folder}/a.imzML"] == imzml.files_of(f"{folder}/a")
    with pytest.raises(FileNotFoundError):
        imzml.files_of(str(tmp_path / "none"))
    imzml.write_pair(str(tmp_path / "empty"), iter([]))
    assert spark.read.format("imzml").load(str(tmp_path / "empty.imzML")).count() == 0
