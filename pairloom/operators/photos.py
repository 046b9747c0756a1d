"""Photos' own bytes: size, orientation and thumbnail of a JPEG, and the thumbnail's removal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairloom.sources.assembly import RECIPE, RECIPE_TYPE, assembled
from pairloom.sources.filesystems import first_bytes
from pairloom.sources.listing import PREFIX_BYTES

#: What the orientation's numbers are called.
ORIENTATIONS = {
    1: "Horizontal (normal)", 2: "Mirror horizontal", 3: "Rotate 180", 4: "Mirror vertical", 5: "Mirror horizontal and rotate 270 CW",
    6: "Rotate 90 CW", 7: "Mirror horizontal and rotate 90 CW", 8: "Rotate 270 CW",
}
#: Tags of directories and sizes of their values' types, by number.
ORIENTATION, WIDTH, HEIGHT, EXIF_PART, GPS_PART, INTEROP_PART, THUMB_START, THUMB_SIZE = 0x112, 0x100, 0x101, 0x8769, 0x8825, 0xA005, 0x201, 0x202
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FACTS = "struct<valid:boolean,width:int,height:int,orientation:string,has_thumbnail:boolean>"
FACTS_TYPE = pa.struct([("valid", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("orientation", pa.string()), ("has_thumbnail", pa.bool_())])


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of a JPEG's segments up to its scan or the data's end; ``start`` is that of the marker."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:
            return
        end = at + 2 if marker == 0x01 or 0xD0 <= marker <= 0xD7 else at + 2 + int.from_bytes(data[at + 2: at + 4], "big")
        yield marker, at, end
        at = end


@dataclass
class Directory:
    """A directory of tags at ``start`` of ``tiff``: its short values, where the next one is named, and what bytes it takes up."""

    tiff: bytes
    order: str
    start: int
    values: dict[int, int] = field(default_factory=dict)
    taken: list[tuple[int, int]] = field(default_factory=list)

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.tiff[at: at + size], self.order)

    def __post_init__(self) -> None:
        count = self.number(self.start, 2)
        self.link = self.start + 2 + 12 * count
        self.whole = self.start >= 8 and self.link <= len(self.tiff)
        if not self.whole:
            return
        self.taken.append((self.start, self.link + 4))
        for at in range(self.start + 2, self.link, 12):
            tag, kind, n = self.number(at, 2), self.number(at + 2, 2), self.number(at + 4, 4)
            size = TYPE_SIZES.get(kind, 0) * n
            if size > 4:
                self.taken.append((self.number(at + 8, 4), self.number(at + 8, 4) + size))
            elif n == 1 and kind in (3, 4):
                self.values[tag] = self.number(at + 8, TYPE_SIZES[kind])

    @property
    def next(self) -> int:
        return self.number(self.link, 4) if self.link + 4 <= len(self.tiff) else 0


@dataclass
class Exif:
    """The metadata segment of a JPEG: places of the segment and of its TIFF data, and its directories."""

    start: int
    end: int
    tiff: int
    main: Directory
    thumbnail: Directory | None


def exif_of(data: bytes) -> Exif | None:
    """What can be read of it; a segment that is cut short is read as far as it goes."""
    for marker, start, end in segments(data):
        if marker == 0xE1 and data[start + 4: start + 10] == b"Exif\0\0":
            tiff = data[start + 10: end]
            order = {b"II*\0": "little", b"MM\0*": "big"}.get(tiff[:4])
            if order is None or len(tiff) < 8:
                return None
            main = Directory(tiff, order, int.from_bytes(tiff[4:8], order))
            if not main.whole:
                return None
            second = Directory(tiff, order, main.next) if main.next else None
            return Exif(start, end, start + 10, main, second if second and second.whole else None)
    return None


def jpeg_facts(data: bytes | None) -> dict:
    """valid, width, height, orientation (in words) and has_thumbnail of a JPEG's first bytes.

    Width and height are the frame's, or the metadata's where no frame is there, or 0. What is no JPEG isn't valid.
    """
    if not data or data[:2] != b"\xff\xd8":
        return {"valid": False, "width": 0, "height": 0, "orientation": "", "has_thumbnail": False}
    exif = exif_of(data)
    values = exif.main.values if exif else {}
    width, height = values.get(WIDTH, 0), values.get(HEIGHT, 0)
    for marker, start, _ in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and start + 9 <= len(data):
            height, width = int.from_bytes(data[start + 5: start + 7], "big"), int.from_bytes(data[start + 7: start + 9], "big")
            break
    number = values.get(ORIENTATION)
    small = exif.thumbnail.values if exif and exif.thumbnail else {}
    shown = "" if number is None else ORIENTATIONS.get(number, f"Unknown ({number})")
    return {"valid": True, "width": width, "height": height, "orientation": shown, "has_thumbnail": bool(small.get(THUMB_START) and small.get(THUMB_SIZE))}


def with_photo_facts(files: DataFrame, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """``files`` (path) with facts, read in the tasks from the first bytes of each photo, which never leave them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
            found = pa.array([jpeg_facts(first_bytes(p, prefix_bytes)) for p in paths], FACTS_TYPE)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "facts"])

    return files.mapInArrow(read, StructType.fromDDL(", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields], f"facts {FACTS}"])))


def without_thumbnail(data: bytes) -> list[tuple[int, int | None, bytes | None]]:
    """(start, end, bytes) of the pieces that make a JPEG without its thumbnail, of its first bytes ``data``.

    A piece is a range of the file, to its end where ``end`` is None, or given bytes. The thumbnail's directory is unlinked; where it and
    the thumbnail lie behind all other metadata they are cut off, else their bytes become zeros. All else stays as it is.
    """
    exif = exif_of(data)
    if exif is None or exif.thumbnail is None:
        raise ValueError("no thumbnail to strip")
    if exif.end > len(data):
        raise ValueError("the metadata is cut short")
    main, small = exif.main, exif.thumbnail
    used, todo = list(main.taken), [main.values.get(t) for t in (EXIF_PART, GPS_PART)]
    while todo:
        place = todo.pop()
        if place:
            part = Directory(main.tiff, main.order, place)
            if part.whole:
                used += part.taken
                todo.append(part.values.get(INTEROP_PART))
    gone = list(small.taken)
    if small.values.get(THUMB_START) and small.values.get(THUMB_SIZE):
        gone.append((small.values[THUMB_START], small.values[THUMB_START] + small.values[THUMB_SIZE]))
    last = max(end for _, end in used)
    base = exif.tiff
    link = (base + main.link, base + main.link + 4)
    if min(start for start, _ in gone) >= last:
        size = base + last - exif.start - 2
        return [
            (0, exif.start + 2, None), (0, None, size.to_bytes(2, "big")), (exif.start + 4, link[0], None), (0, None, bytes(4)),
            (link[1], base + last, None), (exif.end, None, None),
        ]
    kept = bytearray(main.tiff)
    for start, end in gone:
        kept[start:min(end, len(kept))] = bytes(max(0, min(end, len(kept)) - start))
    for start, end in used:
        kept[start:end] = main.tiff[start:end]
    kept[main.link: main.link + 4] = bytes(4)
    return [(0, base, None), (0, None, bytes(kept)), (exif.end, None, None)]


def strip_thumbnails(photos: DataFrame, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """Writes photos of (ordinal, path, target, issue_type) without their thumbnails: (ordinal, status, details) of each row.

    Pixels are copied as they are. A target may be the photo itself. Rows that need anything else (turned pixels) or nothing fail untried.
    """

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = {"ordinal": row["ordinal"], "problem": None, "outputs": None}
                try:
                    if row["issue_type"] != "NeedsStrip":
                        raise ValueError(f"{row['issue_type']} isn't a matter of stripping")
                    data = first_bytes(row["path"], prefix_bytes)
                    if data is None:
                        raise OSError(f"{row['path']} can't be read")
                    pieces = [
                        {"path": row["path"], "start": start, "length": None if end is None else end - start, "data": given}
                        for start, end, given in without_thumbnail(data)
                    ]
                    out["outputs"] = [{"target": row["target"], "pieces": pieces}]
                except (OSError, ValueError) as error:
                    out["problem"] = str(error)
                yield pa.RecordBatch.from_pylist([out], RECIPE_TYPE)

    own = photos.select(F.col("ordinal").cast("long").alias("ordinal"), "path", "target", "issue_type")
    return assembled(own.mapInArrow(recipes, RECIPE))
