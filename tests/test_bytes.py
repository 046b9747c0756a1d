"""Listings and byte ranges on real files."""

import json
import os
import re
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from pairloom.operators import pairing, recognise, split
from pairloom.sources import listing
from pairloom.sources.assembly import AssemblyWriter
from pairloom.sources.listing import list_files


def xmp(text):
    return b"\xff\xd8\xff\xe1" + text.encode() + b"\x00\xff" * 50


VIDEO_QT = b"\x00\x00\x00\x14ftypqt  " + bytes(range(200))
VIDEO_MP4 = b"\x00\x00\x00\x14ftypisom" + bytes(300)
VIDEO_ODD = b"\x00\x00\x00\x14ftyp????" + bytes(300)


@pytest.fixture
def folder(tmp_path):
    def item(length, mime=""):
        return f'<x Item:Length="{length}" Item:Mime="{mime}" Item:Semantic="MotionPhoto"/>'

    files = {
        "MVIMG_0.jpg": b"", "_DSC1.jpg": b"x", ".hid.jpg": b"x", "a.MP.jpg": b"none",
        "m.jpg": xmp(f'GCamera:MicroVideoOffset="{len(VIDEO_QT)}"') + VIDEO_QT,
        "n.jpg": xmp(item(len(VIDEO_MP4))) + VIDEO_MP4, "u.jpg": xmp(item(len(VIDEO_ODD), "video/quicktime")) + VIDEO_ODD,
        "x.jpg": xmp('GCamera:MicroVideoOffset="999999"'), "gcamera.jpg": xmp('gcamera:microvideooffset="5"'),
        "IMG_1.jpg": b"a", "img_1.jpeg": b"bb", "IMG_1.MOV": b"ccc", "note.txt": b"t",
    }
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.jpg").write_bytes(b"x")
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, files


def test_listing_keeps_hidden_and_empty_files(spark, folder):
    path, files = folder
    rows = {r.file_name: r for r in list_files(spark, str(path), "/no/such/place", prefix_bytes=4).collect()}
    assert {n: r.size_bytes for n, r in rows.items()} == {n: len(d) for n, d in files.items()}
    assert all(bytes(r.head) == files[n][:4] for n, r in rows.items())
    assert list_files(spark, "/no/such/place").count() == 0


def test_pairing_keeps_the_first_name_and_the_last_path(spark, folder):
    files = list_files(spark, str(folder[0])).withColumn(
        "ordinal", F.when(F.col("file_name") == "IMG_1.jpg", 0).otherwise(F.col("ordinal") + 1)
    )
    pair = pairing.pairs(files).collect()
    assert [(r.base_name, r.image_name, r.video_name) for r in pair] == [("IMG_1", "img_1.jpeg", "IMG_1.MOV")]


def test_recognition(spark, folder):
    files = list_files(spark, str(folder[0]), prefix_bytes=1 << 20)
    names = [r.file_name for r in recognise.split_tasks(files).orderBy("idx").collect()]
    assert names == ["a.MP.jpg", "m.jpg", "MVIMG_0.jpg", "n.jpg", "u.jpg", "x.jpg"]
    assert recognise.recognition_counts(files).first().skipped == 5


def test_splitting_round_trip(spark, folder, tmp_path):
    path, files = folder
    out = tmp_path / "out"
    out.mkdir()
    heads = split.with_video_header(list_files(spark, str(path), prefix_bytes=1 << 20).where(F.lower("file_name").endswith(".jpg")))
    plan = split.split_plan(heads.withColumns({"input_dir": F.lit(str(path)), "output_dir": F.lit(str(out))}))
    jobs = plan.join(heads.select("ordinal", F.col("path").alias("source")), "ordinal")
    names = {r.ordinal: r.file_name for r in plan.collect()}
    result = {names[r.ordinal]: (r.status, r.details) for r in split.write_splits(jobs).collect()}
    assert result["MVIMG_0.jpg"] == ("Failed", "empty") and result["a.MP.jpg"] == ("Failed", "no_metadata") and result["x.jpg"] == ("Failed", "bad_length")
    for name, video in (("m", "m.mov"), ("n", "n.mp4"), ("u", "u.mov")):
        assert result[f"{name}.jpg"] == ("Success", "")
        assert (out / f"{name}.jpg").read_bytes() + (out / video).read_bytes() == files[f"{name}.jpg"]
    assert not [n for n in os.listdir(out) if n.endswith(".part")]


def test_a_blank_directory_has_no_files(spark):
    assert list_files(spark, "", " ").count() == 0


def test_merging_replaces_old_lengths_and_leaves_no_part(spark, tmp_path):
    old = xmp('GCamera:MicroVideoOffset="17"<x Item:Length="9" Item:Semantic="MotionPhoto"/>')
    files = {"old.jpg": old, "no.png": b"\x89PNG", "v.mp4": VIDEO_MP4, "none.mp4": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    place = lambda n: str(tmp_path / n)
    rows = [(1, place("old.jpg"), place("v.mp4"), place("a.jpg")), (2, place("no.png"), place("v.mp4"), place("b.jpg")), (3, place("old.jpg"), place("none.mp4"), place("c.jpg"))]
    got = {r.ordinal: r.status for r in split.write_merges(spark.createDataFrame(rows, "ordinal long, image string, video string, output string")).collect()}
    assert got == {1: "Success", 2: "Failed", 3: "Failed"}
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".part") or n in ("b.jpg", "c.jpg")]
    (tmp_path / "in").mkdir()
    os.rename(tmp_path / "a.jpg", tmp_path / "in" / "a.jpg")
    heads = split.with_video_header(list_files(spark, place("in"), prefix_bytes=1 << 20))
    plan = split.split_plan(heads.withColumns({"input_dir": F.lit(place("in")), "output_dir": F.lit(str(tmp_path))})).first()
    assert (plan.status, plan.video_length) == ("ok", len(VIDEO_MP4)) and plan.video_output.endswith("a.mp4")


def test_merging_is_the_inverse(spark, tmp_path):
    (tmp_path / "i.jpg").write_bytes(b"\xff\xd8photo")
    (tmp_path / "v.mov").write_bytes(VIDEO_QT)
    out = str(tmp_path / "o.jpg")
    rows = [(1, str(tmp_path / "i.jpg"), str(tmp_path / "v.mov"), out), (2, "/no/file", "/no/file", out + "2")]
    got = {r.ordinal: r.status for r in split.write_merges(spark.createDataFrame(rows, "ordinal long, image string, video string, output string")).collect()}
    assert got == {1: "Success", 2: "Failed"}
    data = open(out, "rb").read()
    assert data.endswith(VIDEO_QT)
    length = spark.createDataFrame([(data.decode("latin-1"),)], "m string").select(split.video_length(F.col("m")).alias("n")).first().n
    assert length == len(VIDEO_QT)


def test_a_thousand_directories_are_listed_by_tasks(spark, tmp_path):
    want = []
    for d in range(1000):
        (tmp_path / f"d{d}").mkdir()
        for name in sorted([f"b{d % 3}.JPG", "a.txt", ".hid"][: d % 4]):
            (tmp_path / f"d{d}" / name).write_bytes(b"x" * d)
            want.append((f"{tmp_path}/d{d}/{name}", d))
    folders = [str(tmp_path / f"d{d}") for d in range(1000)]
    for shares in (1, 3):
        got = list_files(spark, *folders, shares=shares).orderBy("ordinal").collect()
        assert [(r.path, r.size_bytes) for r in got] == want and [r.ordinal for r in got] == list(range(len(want)))
    reader = listing.ListingReader(folders, 1, 0, ["path"])
    assert all(set(vars(p)) == {"directories", "part", "parts"} for p in reader.partitions())
    few = list_files(spark, *folders, suffixes=[".jpg"], least_size=900)
    assert sorted(r.path for r in few.collect()) == sorted(p for p, size in want if p.endswith(".JPG") and size >= 900)


def test_only_wanted_files_are_opened(spark, tmp_path, monkeypatch):
    for name, size in (("a.jpg", 5), ("b.JPG", 0), ("c.mov", 9), ("d.jpeg", 7), ("none", 3)):
        (tmp_path / name).write_bytes(b"z" * size)
    opened = []
    monkeypatch.setattr(listing, "first_bytes", lambda path, size: opened.append(os.path.basename(path)) or b"")

    def rows(filters, columns):
        reader = listing.ListingReader([str(tmp_path)], 1, 4, columns)
        left = list(reader.pushFilters(filters))
        return left, sorted(r[0] for p in reader.partitions() for r in reader.read(p))

    suffix, size, other = In(("suffix",), (".jpg", ".jpeg")), GreaterThan(("size_bytes",), 0), EqualTo(("file_name",), "a.jpg")
    assert rows([suffix, size, other], ["file_name", "head"]) == ([other], ["a.jpg", "d.jpeg"])
    assert sorted(opened) == ["a.jpg", "d.jpeg"]
    opened.clear()
    assert rows([], ["file_name"])[1] == ["a.jpg", "b.JPG", "c.mov", "d.jpeg", "none"] and not opened
    spark.dataSource.register(listing.MediaListing)
    spark.conf.set(listing.PUSH_DOWN, "true")
    try:
        plan = spark.read.format("media_listing").option("paths", str(tmp_path)).load().where("suffix IN ('.jpg', '.jpeg') AND size_bytes > 0")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert ") Filter " not in text, text
        assert plan.count() == 2
    finally:
        spark.conf.set(listing.PUSH_DOWN, "false")


def test_attempts_at_once_never_mix_and_leave_no_part(tmp_path):
    source = tmp_path / "s.bin"
    source.write_bytes(os.urandom(3_000_000))
    job = tmp_path / "job"
    for folder in ("attempts", "committed"):
        (job / folder).mkdir(parents=True)
    piece = {"path": str(source), "start": 10, "length": 2_900_000, "data": None}
    rows = [{"ordinal": n, "problem": None, "outputs": [{"target": str(tmp_path / f"t{n}"), "pieces": [piece, {"data": b"end"}]}]} for n in range(5)]
    rows += [{"ordinal": 9, "problem": None, "outputs": [{"target": str(tmp_path / "t9"), "pieces": [piece]}, {"target": str(tmp_path / "t8"), "pieces": [{**piece, "length": 5_000_000}]}]}]
    writer = AssemblyWriter(str(job))
    with ThreadPoolExecutor(3) as pool:
        attempts = [f.result() for f in [pool.submit(writer.write, iter(rows)) for _ in range(3)]]
    # One that died after it made a part.
    (tmp_path / "t0.dead.part").write_bytes(b"half")
    (job / "attempts" / "dead.intents").write_text(json.dumps(str(tmp_path / "t0.dead.part")) + "\n")
    assert not [n for n in os.listdir(tmp_path) if n in ("t0", "t4")]
    writer.commit([attempts[1], None])
    want = source.read_bytes()[10:2_900_010] + b"end"
    assert all((tmp_path / f"t{n}").read_bytes() == want for n in range(5))
    assert sorted(os.listdir(tmp_path)) == ["job", "s.bin", *[f"t{n}" for n in range(5)]]
    found = [json.loads(x) for x in (job / "committed" / f"{attempts[1].name}.json").read_text().splitlines()]
    assert [(r["ordinal"], r["status"]) for r in found] == [*[(n, "Success") for n in range(5)], (9, "Failed")]
    other = writer.write(iter(rows))
    writer.abort([other])
    assert sorted(os.listdir(tmp_path)) == ["job", "s.bin", *[f"t{n}" for n in range(5)]]


def test_metadata_is_read_in_linear_time(spark):
    item, mark = 'Item:Length="{}" ', 'item:semantic="MOTIONPHOTO" '
    texts = [
        item.format(1) + mark + item.format(2), mark + item.format(1) + item.format(2), item.format(1) + item.format(2) + mark, mark + ">" + item.format(1),
        item.format("x") + mark + item.format(5), "<" + item.format(1) + ">" + mark + item.format(7) + ">" + item.format(8) + mark, "", mark, item.format(3),
        mark + mark + item.format(4) + mark, item.format(1) + ">" + item.format(6) + mark + mark,
    ]
    old = re.compile(r'(?is)Item:Semantic="MotionPhoto"[^>]*Item:Length="([0-9]+)"|Item:Length="([0-9]+)"[^>]*Item:Semantic="MotionPhoto"')
    want = [int(m[1] or m[2]) if (m := old.search(t)) else None for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, m string")
    assert [r.v for r in frame.select("n", split.video_length(F.col("m")).alias("v")).orderBy("n").collect()] == want
    for text in texts:
        whole = [m.span() for m in re.compile(old.pattern.encode()).finditer(text.encode())]
        assert split.old_lengths(text.encode()) == whole
    hostile = spark.createDataFrame([((mark * 40_000)[: 1 << 20],), ((item.format(1) * 60_000)[: 1 << 20],)], "m string").cache()
    hostile.count()
    began = time.perf_counter()
    assert [r.v for r in hostile.select(split.video_length(F.col("m")).alias("v")).collect()] == [None, None]
    assert time.perf_counter() - began < 5
    split.old_lengths((mark * 40_000).encode())
