"""Widths from fonts made here, table by table."""

import struct

import pytest
from pyspark.sql import functions as F

from quire.operators.typeset import with_fit
from quire.sources.fonts import glyph_widths, read_widths, width_table


def font(widths, chars, wide=(), units=1000, lists=False):
    """A font of the tables that give widths: advances by glyph; a map of 16-bit characters (by deltas, or by listed glyphs), one of 32-bit ones."""
    codes = sorted(chars)
    n = len(codes) + 1
    ends, starts = [*codes, 0xFFFF], [*codes, 0xFFFF]
    if lists:
        deltas, offsets = [0] * n, [2 * n - 2 * k + 2 * k for k in range(n - 1)] + [0]
        glyphs = struct.pack(f">{n - 1}H", *(chars[c] for c in codes))
        deltas[-1] = 1
    else:
        deltas, offsets, glyphs = [chars[c] - c for c in codes] + [1], [0] * n, b""
    four = struct.pack(">HHH", 2 * n, 0, 0) + struct.pack(">H", 0) + struct.pack(f">{n}H", *ends) + b"\0\0" + struct.pack(f">{n}H", *starts) + struct.pack(f">{n}H", *(d & 0xFFFF for d in deltas)) + struct.pack(f">{n}H", *offsets) + glyphs
    four = struct.pack(">HHH", 4, len(four) + 6, 0) + four
    twelve = struct.pack(">HHIII", 12, 0, 16 + 12 * len(wide), 0, len(wide)) + b"".join(struct.pack(">III", *w) for w in wide)
    maps = [four, *([twelve] if wide else [])]
    cmap, at = struct.pack(">HH", 0, len(maps)), 4 + 8 * len(maps)
    for m in maps:
        cmap += struct.pack(">HHI", 3, 1, at)
        at += len(m)
    tables = {b"cmap": cmap + b"".join(maps), b"head": b"\0" * 18 + struct.pack(">H", units) + b"\0" * 34, b"hhea": b"\0" * 34 + struct.pack(">H", len(widths)), b"hmtx": b"".join(struct.pack(">Hh", w, 0) for w in widths) + struct.pack(">2h", 0, 0)}
    head, body, offset = struct.pack(">IHHHH", 0x00010000, len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag, data in tables.items():
        head += struct.pack(">4sIII", tag, 0, offset + len(body), len(data))
        body += data
    return head + body


@pytest.mark.parametrize("lists", [False, True])
def test_widths_by_character(lists):
    got = glyph_widths(font([500, 250, 600, 1000], {ord("a"): 1, ord("b"): 2, ord("译"): 3, ord("é"): 7}, lists=lists))
    assert got == {"a": 0.25, "b": 0.6, "译": 1.0, "é": 1.0}  # glyph 7 is as wide as the last


def test_wide_characters_and_collections():
    plain = font([500, 250, 600], {ord("a"): 1}, wide=[(0x61, 0x62, 1), (0x1F600, 0x1F601, 1)], units=500)
    assert glyph_widths(plain) == {"a": 0.5, "b": 1.2, "\U0001f600": 0.5, "\U0001f601": 1.2}
    with pytest.raises(ValueError):
        glyph_widths(b"%PDF-1.7 no font")
    with pytest.raises(ValueError):
        glyph_widths(b"")


def test_files_to_fitting(spark, tmp_path):
    (tmp_path / "a.ttf").write_bytes(font([0, 1000], {ord("x"): 1}))
    (tmp_path / "b.otf").write_bytes(font([0, 100], {ord("x"): 1}))
    (tmp_path / "c.ttf").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"no font")
    widths = read_widths(spark, str(tmp_path)).cache()
    assert widths.where("error IS NOT NULL").count() == 1 and widths.count() == 3
    assert width_table(widths) == {"x": 1.0} and width_table(widths, "b.otf") == {"x": 0.1} and width_table(widths, "c.ttf") == {"x": 1.0}
    row = spark.createDataFrame([("x" * 10, 50.0, 12.0, 10.0, 12.0)], "text string, width double, height double, size double, leading double")
    fits = [with_fit(row, width_table(widths, f)).select(F.round("fit.size", 1), "fit.lines").first() for f in ("a.ttf", "b.otf")]
    assert [tuple(f) for f in fits] == [(5.0, 1), (10.0, 1)]
