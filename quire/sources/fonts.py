"""Glyph widths from font files: the character map and the horizontal metrics of TrueType and OpenType fonts and collections.

Files are read whole by Spark (binaryFile), a file a row; a font's rows, one a character, go on as a table."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Widths broadcast at most: the code points there are.
MAX_WIDTHS = 0x110000


def _tables(data: bytes) -> dict[bytes, tuple[int, int]]:
    """Tag -> (offset, length); of a collection, its first font's."""
    start = struct.unpack_from(">I", data, 12)[0] if data[:4] == b"ttcf" else 0
    count = struct.unpack_from(">H", data, start + 4)[0]
    records = (struct.unpack_from(">4sIII", data, start + 12 + 16 * k) for k in range(count))
    return {tag: (offset, length) for tag, _, offset, length in records}


def _segments(data: bytes, at: int) -> dict[int, int]:
    """Character -> glyph of a map by segments of 16-bit characters (format 4)."""
    n = struct.unpack_from(">H", data, at + 6)[0] // 2
    column = lambda k, kind: np.frombuffer(data, kind, n, at + 14 + 2 * n * k + (2 if k else 0)).astype(np.int64)
    ends, starts, deltas, offsets = column(0, ">u2"), column(1, ">u2"), column(2, ">i2"), column(3, ">u2")
    out: dict[int, int] = {}
    for k in range(n):
        chars = np.arange(starts[k], min(ends[k], 0xFFFE) + 1)
        if offsets[k]:  # glyphs are listed; the offset counts from its own place
            where = at + 16 + 6 * n + 2 * k + int(offsets[k]) + 2 * (chars - starts[k])
            glyphs = np.array([struct.unpack_from(">H", data, w)[0] if w + 2 <= len(data) else 0 for w in where.tolist()], np.int64)
            glyphs = np.where(glyphs == 0, 0, (glyphs + deltas[k]) & 0xFFFF)
        else:
            glyphs = (chars + deltas[k]) & 0xFFFF
        out.update((c, g) for c, g in zip(chars.tolist(), glyphs.tolist(), strict=True) if g)
    return out


def _groups(data: bytes, at: int) -> dict[int, int]:
    """Character -> glyph of a map by groups of 32-bit characters (format 12)."""
    n = struct.unpack_from(">I", data, at + 12)[0]
    rows = np.frombuffer(data, ">u4", 3 * n, at + 16).reshape(n, 3).astype(np.int64)
    return {c: g for first, last, glyph in rows.tolist() for c, g in zip(range(first, min(last, MAX_WIDTHS - 1) + 1), range(glyph, glyph + last - first + 1), strict=False) if g}


def glyph_widths(data: bytes) -> dict[str, float]:
    """Character -> width in em. Of several maps the one of most characters counts; characters without a glyph have no width. Raises ValueError for
    bytes that are no font."""
    try:
        tables = _tables(data)
        cmap, head, hhea, hmtx = (tables[t][0] for t in (b"cmap", b"head", b"hhea", b"hmtx"))
        units, full = struct.unpack_from(">H", data, head + 18)[0], struct.unpack_from(">H", data, hhea + 34)[0]
        advances = np.frombuffer(data, ">u2", 2 * full, hmtx)[::2].astype(np.float64) / units
        found: dict[int, int] = {}
        for k in range(struct.unpack_from(">H", data, cmap + 2)[0]):
            at = cmap + struct.unpack_from(">HHI", data, cmap + 4 + 8 * k)[2]
            read = {4: _segments, 12: _groups}.get(struct.unpack_from(">H", data, at)[0])
            some = read(data, at) if read else {}
            found = some if len(some) > len(found) else found
        # glyphs beyond the full records are as wide as the last of them
        return {chr(c): float(advances[min(g, full - 1)]) for c, g in found.items() if not 0xD800 <= c < 0xE000}
    except (struct.error, KeyError, IndexError, ValueError, ZeroDivisionError) as error:
        raise ValueError(f"not a font that can be read: {error}") from error


def read_widths(spark: SparkSession, path: str, glob: str = "*.{ttf,otf,ttc}") -> DataFrame:
    """path, ch, em of every character of the fonts under path, and path, error of files that can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    got = glyph_widths(bytes(content))
                    yield pd.DataFrame({"path": name, "ch": list(got), "em": list(got.values()), "error": None})
                except ValueError as error:
                    yield pd.DataFrame({"path": [name], "ch": [None], "em": [None], "error": [str(error)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, ch string, em double, error string")


def width_table(widths: DataFrame, preferred: str = "") -> dict[str, float]:
    """ch -> em for the typesetter: of the font whose path ends in preferred where it could be read, else of the first by path. At most one entry a
    code point comes to the driver."""
    usable = widths.where("error IS NULL AND ch IS NOT NULL")
    last = ~F.col("path").endswith(preferred) if preferred else F.lit(False)
    first = usable.select("path", last.alias("last")).distinct().orderBy("last", "path").first()
    return {} if first is None else {r["ch"]: r["em"] for r in usable.where(F.col("path") == first["path"]).select("ch", "em").collect()}
