"""JPEGs' own metadata, thumbnails stripped, and results counted as they pass."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from pairloom.operators import photos, repair, split, status
from pairloom.sources.assembly import AssemblyWriter
from pairloom.sources.listing import list_files

PIXELS = bytes(range(256)) * 40


def tags(order, start, entries, link):
    """A directory of (tag, type, count, value or bytes) at ``start``; long values stand behind it."""
    out, behind = io.BytesIO(), b""
    tail = start + 2 + 12 * len(entries) + 4
    out.write(len(entries).to_bytes(2, order))
    for tag, kind, count, value in entries:
        out.write(tag.to_bytes(2, order) + kind.to_bytes(2, order) + count.to_bytes(4, order))
        if isinstance(value, bytes):
            out.write((tail + len(behind)).to_bytes(4, order))
            behind += value
        else:
            out.write(value.to_bytes(photos.TYPE_SIZES[kind], order).ljust(4, b"\0"))
    return out.getvalue() + link.to_bytes(4, order) + behind


def jpeg(order, width, height, orientation, thumb, thumb_first=False, frame=True):
    """A photo with metadata in either byte order; the thumbnail may lie before the other metadata."""
    small = b"\xff\xd8THUMB\xff\xd9" * 30
    entries = [(0x10F, 2, 10, b"Maker's \0\0")]
    entries += [(0x112, 3, 1, orientation)] if orientation is not None else []
    entries += [] if frame else [(0x100, 4, 1, width), (0x101, 3, 1, height)]
    entries.append((0x8769, 4, 1, 0))
    first = 8 + (len(small) + 42 if thumb_first else 0)
    exif = first + len(tags(order, first, entries, 0))
    entries[-1] = (0x8769, 4, 1, exif)
    own = tags(order, exif, [(0x9003, 2, 20, b"2024:01:01 00:00:00\0"), (0x9000, 7, 4, 1)], 0)
    second = (8 if thumb_first else exif + len(own)) if thumb else 0
    place = second + 42
    extra = (tags(order, second, [(0x103, 3, 1, 6), (0x201, 4, 1, place), (0x202, 4, 1, len(small))], 0) + small) if thumb else b""
    main = tags(order, first, entries, second) + own
    body = extra.ljust(first - 8, b"\0") + main if thumb_first else main + extra
    tiff = (b"II*\0" if order == "little" else b"MM\0*") + first.to_bytes(4, order) + body
    def segment(marker, data):
        return b"\xff" + bytes([marker]) + (len(data) + 2).to_bytes(2, "big") + data
    size = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\0"
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xE1, b"Exif\0\0" + tiff) + (segment(0xC0, size) if frame else b"") + b"\xff\xda\0\x02" + PIXELS


SHAPES = [(order, w, h, o, thumb) for order in ("little", "big") for w, h in ((40, 30), (30, 40), (30, 30)) for o in (None, 1, 3, 6, 8) for thumb in (False, True)]


def as_json(w, h, o, thumb):
    return json.dumps([{"ImageWidth": w, "ImageHeight": h} | ({"Orientation": photos.ORIENTATIONS[o]} if o else {}) | ({"ThumbnailImage": "(Binary data)"} if thumb else {})])


def test_bytes_and_json_give_the_same_findings(spark, tmp_path):
    rows = []
    for n, (order, w, h, o, thumb) in enumerate(SHAPES):
        (tmp_path / f"{n:03}.jpg").write_bytes(jpeg(order, w, h, o, thumb, thumb_first=n % 3 == 0, frame=n % 4 != 3))
        rows.append((n, as_json(w, h, o, thumb)))
    (tmp_path / "900.jpg").write_bytes(b"no photo")
    (tmp_path / "901.jpg").write_bytes(b"")
    rows += [(len(SHAPES), "File not found"), (len(SHAPES) + 1, "")]
    found = photos.with_photo_facts(list_files(spark, str(tmp_path)))
    columns = ["ordinal", "issue_type", "rotation_angle", "needs_repair", "tags"]
    got = repair.analysed(found, facts=F.col("facts")).select(*columns).orderBy("ordinal").collect()
    want = repair.analysed(spark.createDataFrame(rows, "ordinal long, exif string")).select(*columns).orderBy("ordinal").collect()
    assert got == want and {r.issue_type for r in got} == {"Error", "Perfect", "NeedsRebuild", "NeedsStrip"}


@pytest.mark.parametrize("order", ["little", "big"])
def test_cut_and_broken_files_have_some_facts(order):
    whole = jpeg(order, 40, 30, 6, True)
    for size in range(len(whole) - len(PIXELS) + 1):
        facts = photos.jpeg_facts(whole[:size])
        assert facts["valid"] == (size >= 2) and facts["width"] in (0, 40) and facts["orientation"] in ("", "Rotate 90 CW")
    for at in range(2, len(whole) - len(PIXELS)):
        for value in (0, 255):
            photos.jpeg_facts(whole[:at] + bytes([value]) + whole[at + 1:])
            try:
                photos.without_thumbnail(whole[:at] + bytes([value]) + whole[at + 1:])
            except ValueError:
                pass


@pytest.mark.parametrize("order, thumb_first", [("little", False), ("big", False), ("little", True), ("big", True)])
def test_stripping_drops_the_thumbnail_alone(spark, tmp_path, order, thumb_first):
    whole = jpeg(order, 30, 30, 1, True, thumb_first)
    (tmp_path / "a.jpg").write_bytes(whole)
    (tmp_path / "b.jpg").write_bytes(whole)
    (tmp_path / "c.jpg").write_bytes(jpeg(order, 40, 30, 6, True))
    (tmp_path / "d.jpg").write_bytes(jpeg(order, 30, 30, 1, False))
    out = tmp_path / "out"
    found = repair.analysed(photos.with_photo_facts(list_files(spark, str(tmp_path))), facts=F.col("facts"))
    named = found.withColumn("target", F.when(F.col("file_name") == "b.jpg", F.col("path")).otherwise(F.concat(F.lit(f"{out}/"), "file_name")))
    got = {r.ordinal: (r.status, r.details) for r in photos.strip_thumbnails(named).collect()}
    assert got == {0: ("Success", ""), 1: ("Success", ""), 2: ("Failed", "NeedsRebuild isn't a matter of stripping"), 3: ("Failed", "Perfect isn't a matter of stripping")}
    assert sorted(os.listdir(tmp_path)) == ["a.jpg", "b.jpg", "c.jpg", "d.jpg", "out"] and os.listdir(out) == ["a.jpg"]
    for path in (out / "a.jpg", tmp_path / "b.jpg"):
        data = path.read_bytes()
        facts = photos.jpeg_facts(data)
        assert facts == photos.jpeg_facts(whole) | {"has_thumbnail": False}
        assert b"THUMB" not in data and b"Maker's" in data and b"2024:01:01" in data and data.endswith(b"\xff\xda\0\x02" + PIXELS)
        assert (len(data) < len(whole)) == (not thumb_first)
        assert photos.exif_of(data).main.values == photos.exif_of(whole).main.values and photos.exif_of(data).thumbnail is None
    with pytest.raises(ValueError):
        photos.without_thumbnail((out / "a.jpg").read_bytes())


def test_counts_of_a_run_with_a_task_that_ran_twice(spark, tmp_path):
    (tmp_path / "s").write_bytes(b"0123456789")
    rows = [(n, "empty" if n == 3 else "ok", 4, 6, f"{tmp_path}/i{n}", f"{tmp_path}/v{n}", str(tmp_path / ("s" if n != 5 else "none"))) for n in range(8)]
    plan = spark.createDataFrame(rows, "ordinal long, status string, image_length long, video_length long, image_output string, video_output string, source string")
    results, run = status.observed(split.write_splits(plan.repartition(3)), "splits")
    found = {r.ordinal: r.status for r in results.collect()}
    assert run.get == {"total": 8, "done": 6, "failed": 2}
    assert {n for n, s in found.items() if s == "Failed"} == {3, 5}
    written = [n for n in os.listdir(tmp_path) if n != "s"]
    assert sorted(written) == sorted(f"{k}{n}" for k in "iv" for n in range(8) if n not in (3, 5))
    # A second attempt at a task of another job: only the committed one's rows are results.
    job = tmp_path / "job"
    for folder in ("attempts", "committed"):
        (job / folder).mkdir(parents=True)
    writer = AssemblyWriter(str(job))
    recipe = [{"ordinal": 1, "problem": None, "outputs": [{"target": str(tmp_path / "t"), "pieces": [{"data": b"x"}]}]}]
    first, second = writer.write(iter(recipe)), writer.write(iter(recipe))
    writer.commit([second])
    results, run = status.observed(spark.read.schema("ordinal long, status string, details string").json(f"{job}/committed"), "again")
    assert first != second and results.count() == 1 and run.get == {"total": 1, "done": 1, "failed": 0}
