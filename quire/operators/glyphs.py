"""Glyphs of embedded fonts: names of fonts, which glyph shows a character, where the glyphs of a run stand, what a font can't draw.

Texts are long and dictionaries short: a show is reduced to its dictionary where it is read, and glyphs are placed in arrays over whole runs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quire.functions import text as X
from quire.operators.lines import whole_pages

_KEEP, _BACK = {"save", "paintFormXObjectBegin"}, {"restore", "paintFormXObjectEnd"}
#: Code points that text extraction replaces by their compatible form, as first and last.
COMPATIBLE = [
    (0x00A0, 0x00A0), (0x00B5, 0x00B5), (0x037E, 0x037E), (0x0EB3, 0x0EB3), (0x2000, 0x200A), (0x202F, 0x202F), (0x2126, 0x2126), (0xFB00, 0xFB04), (0xFB06, 0xFB06),
    (0xFB20, 0xFB36), (0xFB38, 0xFB3C), (0xFB3E, 0xFB3E), (0xFB40, 0xFB41), (0xFB43, 0xFB44), (0xFB46, 0xFBA1), (0xFBA4, 0xFBA9), (0xFBAE, 0xFBB1), (0xFBD3, 0xFBDC),
    (0xFBDE, 0xFBE7), (0xFBEA, 0xFBF8), (0xFBFC, 0xFBFD), (0xFC00, 0xFC5D), (0xFC64, 0xFCF1), (0xFCF5, 0xFD3D), (0xFD88, 0xFD88), (0xFDF4, 0xFDF4), (0xFDFA, 0xFDFB),
    (0xFE71, 0xFE71), (0xFE77, 0xFE77), (0xFE79, 0xFE79), (0xFE7B, 0xFE7B), (0xFE7D, 0xFE7D),
]
LONG_S_T = ("ﬅ", "ſt")
PAGE = ["doc_id", "page_index"]


def with_font_names(runs: DataFrame, fonts: DataFrame) -> DataFrame:
    """runs(doc_id, font_id) with font: the name in fonts(doc_id, font_id, name), else the id, else empty."""
    names = fonts.where("name <> ''").groupBy("doc_id", "font_id").agg(F.min("name").alias("_name"))
    return runs.join(names, ["doc_id", "font_id"], "left").withColumn("font", F.coalesce("_name", "font_id", F.lit(""))).drop("_name")


def _in_effect(steps: Iterable[tuple]) -> Iterator[tuple]:
    """(seq, font) of each showText among (seq, op, font) in order. A restore without a save changes nothing."""
    font, kept = "", []
    for seq, op, named in steps:
        if op == "showText":
            yield seq, font
        elif op == "setFont":
            font = named
        elif op in _KEEP:
            kept.append(font)
        elif op in _BACK and kept:
            font = kept.pop()


def _forms() -> list[tuple[str, str]]:
    """The characters above and their forms."""
    rows = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for first, last in COMPATIBLE for c in range(first, last + 1)]
    return [r for r in [*rows, LONG_S_T] if r[0] != r[1]]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _own_dictionary(glyphs: Column) -> Column:
    """The first glyph of each text in an array of glyphs, as three arrays in order."""
    blank = F.array_contains(glyphs["unicode"], "") | F.array_contains(glyphs["font_char"], "")  # null where it can't be told
    kept = F.when(blank.eqNullSafe(False), glyphs).otherwise(F.filter(glyphs, lambda g: (g["unicode"] != "") & (g["font_char"] != "")))
    parts = lambda g: F.struct(*[g[n].alias(n) for n in ("unicode", "font_char", "width")])
    places = lambda p, texts: F.transform(texts, lambda t: F.array_position(p["unicode"], t).cast("int"))
    taken = lambda values, at: F.transform(at, lambda i: F.element_at(values, i))
    first = lambda p, texts, at: F.struct(texts.alias("ch"), *[taken(p[n], at).alias(n) for n in ("font_char", "width")])
    return _let(kept, lambda g: _let(parts(g), lambda p: _let(F.array_distinct(p["unicode"]), lambda texts: _let(places(p, texts), lambda at: first(p, texts, at)))))


def glyph_dictionary(ops: DataFrame) -> DataFrame:
    """doc_id, page_index, font_id, ch, font_char, width: the first glyph that a page shows with a font for a text, as written or in its compatible form.

    ops also holds glyphs: array of struct(unicode, font_char, width). A glyph of several characters counts by their text. What is shuffled is a
    dictionary a show, not its text, and it is shuffled once, by page."""
    shows = F.col("op") == "showText"
    rows = ops.where(F.col("op").isin("showText", "setFont", *_KEEP, *_BACK) & F.col("doc_id").isNotNull() & F.col("page_index").isNotNull())
    rows = rows.select(*PAGE, "seq", "op", "font_id", F.when(shows, _own_dictionary(F.col("glyphs"))).alias("own"))
    kinds = dict(ops.dtypes)
    width = rows.schema["own"].dataType["width"].dataType.elementType.simpleString()
    schema = f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, font_id string, ch string, font_char string, width {width}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    forms = dict(_forms())

    def merged(table: pa.Table, borders: list[int]) -> pa.Table:
        """One row a page, font and text: entries in order of page, show, place and way; the first of each is taken."""
        names, steps = table["op"].to_pylist(), table["font_id"].to_pylist()
        shown, fonts, pages = [], [], []
        for page, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
            for i, font in _in_effect(zip(range(a, b), names[a:b], steps[a:b], strict=True)):
                shown.append(i)
                fonts.append(font)
                pages.append(page)
        own = table["own"].combine_chunks().take(pa.array(shown, pa.int64()))
        counts = pc.list_value_length(own.field("ch")).fill_null(0).to_numpy(zero_copy_only=False)
        ch = own.field("ch").flatten().dictionary_encode()
        texts, codes = ch.dictionary.to_pylist(), ch.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = {t: k for k, t in enumerate(texts)}
        form = np.full(len(texts), -1, np.int64)
        for k, t in enumerate(texts[:]):
            if t in forms:
                form[k] = place.setdefault(forms[t], len(texts))
                if form[k] == len(texts):
                    texts.append(forms[t])
        font = pa.array(fonts, pa.string()).dictionary_encode(null_encoding="encode")
        group = np.array(pages, np.int64) * max(1, len(font.dictionary)) + font.indices.to_numpy(zero_copy_only=False)
        group = np.repeat(group, counts)
        second = np.flatnonzero(form[codes] >= 0) if len(codes) else np.zeros(0, np.int64)
        order = np.concatenate([2 * np.arange(len(codes)), 2 * second + 1])
        both = np.concatenate([group, group[second]]) * max(1, len(texts)) + np.concatenate([codes, form[codes[second]]])
        by = np.lexsort((order, both))
        first = by[np.flatnonzero(np.diff(both[by], prepend=-1))] if len(by) else by
        at, key = order[first] // 2, both[first]
        row = pa.array(np.array(shown, np.int64)[np.repeat(np.arange(len(shown)), counts)[at]] if len(at) else [], pa.int64())
        of_font = pa.array(key // max(1, len(texts)) % max(1, len(font.dictionary)), pa.int64())
        columns = [table[k].combine_chunks().take(row) for k in PAGE]
        columns += [font.dictionary.take(of_font), pa.array(texts, pa.string()).take(pa.array(key % max(1, len(texts)), pa.int64()))]
        columns += [own.field(n).flatten().take(pa.array(at, pa.int64())) for n in ("font_char", "width")]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_pages(batches, PAGE):
            yield from merged(table, borders).to_batches()

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "seq").mapInArrow(run, schema)


#: White space as text functions have it; characters that are placed before a batch of glyphs is handed on.
SPACE, PLACED = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), X.WHITE)), 200_000


class _Placer:
    """The glyphs of runs, with the space of the font and the dictionary of the page that came last."""

    def __init__(self) -> None:
        self.forms = dict(_forms())
        self.codes, self.chars = np.zeros(0x110000, np.int32), [""]  # numbers of the characters met so far, from 1
        self.font: tuple[tuple, float | None] = ((), None)
        self.page: tuple[tuple, dict] = ((), {})
        self.clear()

    def clear(self) -> None:
        self.rows: list[int] = []
        self.counts: list[int | None] = []
        self.names: list[str] = []
        self.glyphs: list[np.ndarray] = []
        self.xs: list[np.ndarray] = []
        self.blank: list[bool] = []  # of glyphs in runs whose width isn't known
        self.chars_placed = 0

    def place(self, key: tuple, at: int, texts: list[str | None], widths: list[float | None]) -> None:
        space = self.font[1] if self.font[0] == key[:2] and None not in key[:2] else None
        known = self.page[1] if self.page[0] == key and None not in key else {}
        self.rows.extend(range(at, at + len(texts)))
        whole = "" if space is None else "".join(t or "" for t in texts)
        if not whole:
            self.counts.extend([None] * len(texts))
            return
        self.chars_placed += len(whole)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        code = self.codes[points]
        for p in np.unique(points[code == 0]).tolist():
            self.codes[p] = len(self.chars)
            self.chars.append(chr(p))
        code = self.codes[points]
        step, none, glyph = np.zeros(len(self.chars)), np.zeros(len(self.chars), bool), np.full(len(self.chars), -1)
        for c in np.flatnonzero(np.bincount(code)).tolist():
            char = self.chars[c]
            if SPACE.match(char):
                step[c] = space
                continue
            ways = [known[k] for k in (char, self.forms.get(char)) if k in known]
            width = next((w for _, w in ways if w is not None), None)
            name = next((n for n, _ in ways if n is not None), None)
            step[c], none[c] = width or 0.0, width is None
            if name is not None:
                glyph[c] = len(self.names)
                self.names.append(name)
        steps, none, glyph = step[code], none[code], glyph[code]
        a = 0
        for text, width in zip(texts, widths, strict=True):
            b = a + len(text or "")
            upto = np.cumsum(steps[a:b])
            if a == b or none[a:b].any() or upto[-1] <= 0:
                self.counts.append(None)
            else:
                drawn = glyph[a:b] >= 0
                before = np.concatenate([[0.0], upto[:-1]])[drawn]
                self.xs.append(before / upto[-1] * (0.0 if width is None else width))
                self.glyphs.append(glyph[a:b][drawn])
                self.counts.append(len(before))
                self.blank.append(width is None)
            a = b

    def batch(self, rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        """The rows placed since the last call, with their glyphs."""
        kind = schema.field("glyphs").type
        counts = [c for c in self.counts if c is not None]
        names = pa.array(self.names, pa.string()).take(pa.array(np.concatenate([np.zeros(0, np.int64), *self.glyphs]).astype(np.int64)))
        x = pa.array(np.concatenate([np.zeros(0), *self.xs]), mask=np.repeat(np.array(self.blank, bool), counts))
        values = pa.StructArray.from_arrays([names, x], fields=list(kind.value_type))
        ends = np.cumsum([0, *(c or 0 for c in self.counts)]).astype(np.int32)
        glyphs = pa.ListArray.from_arrays(pa.array(ends), values, type=kind, mask=pa.array([c is None for c in self.counts]))
        at = pa.array(self.rows, pa.int64())
        self.clear()
        return pa.RecordBatch.from_arrays([*(rows[c].take(at).cast(schema.field(c).type) for c in (*PAGE, "id")), glyphs], schema=schema)


def glyph_positions(runs: DataFrame, dictionary: DataFrame, fonts: DataFrame) -> DataFrame:
    """runs(doc_id, page_index, id, font_id, text, width) -> doc_id, page_index, id, glyphs: array of struct(font_char, x), or null where any character has no glyph.

    fonts(doc_id, font_id, units_per_em, space_width): a space only moves on, by its width or a quarter em. Each glyph takes its share of the
    run's width. Runs without text, without any width or of a font that isn't known have null. A run is a piece of one line.

    Texts are shuffled once, by document and font, behind the font's space and the dictionary of their page; characters are never rows."""
    kinds = dict(runs.dtypes)
    keys = lambda part, *names: [*(F.col(n).cast(kinds[n]).alias(n) for n in names), F.lit(part).alias("part")]
    space = F.first(F.coalesce(F.nullif(F.col("space_width"), F.lit(0.0)), F.col("units_per_em") * 0.25), ignorenulls=True)
    em = fonts.groupBy("doc_id", "font_id").agg(space.cast("double").alias("space")).select(*keys(0, "doc_id", "font_id"), "space")
    entry = F.struct("ch", "font_char", F.col("width").cast("double").alias("width"))
    known = dictionary.groupBy(*PAGE, "font_id").agg(F.collect_list(entry).alias("known")).select(*keys(1, *PAGE, "font_id"), "known")
    rows = runs.select(*keys(2, *PAGE, "id", "font_id"), "text", F.col("width").cast("double").alias("width"))
    rows = rows.unionByName(em, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*PAGE, "id")) + ", glyphs array<struct<font_char: string, x: double>>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer = _Placer()
        for batch in batches:
            doc, font, page, part = (batch[c].to_pylist() for c in ("doc_id", "font_id", "page_index", "part"))
            key, texts, widths = list(zip(doc, font, page, strict=True)), batch["text"].to_pylist(), batch["width"].to_pylist()
            at = 0
            while at < len(key):
                end = at + 1
                if part[at] == 0:
                    placer.font = (key[at][:2], batch["space"][at].as_py())
                elif part[at] == 1:
                    names = batch["known"][at].values
                    pairs = zip(names.field("font_char").to_pylist(), names.field("width").to_pylist(), strict=True)
                    placer.page = (key[at], dict(zip(names.field("ch").to_pylist(), pairs, strict=True)))
                else:
                    n = len(texts[at] or "")
                    while end < len(key) and part[end] == 2 and key[end] == key[at] and n < PLACED:
                        n += len(texts[end] or "")
                        end += 1
                    placer.place(key[at], at, texts[at:end], widths[at:end])
                at = end
                if placer.chars_placed >= PLACED:
                    yield placer.batch(batch, arrow)
            if placer.rows:
                yield placer.batch(batch, arrow)

    return rows.repartition("doc_id", "font_id").sortWithinPartitions("doc_id", "font_id", "page_index", "part").mapInArrow(run, schema)


def blank_unmapped(text: Column, known: str) -> Column:
    """The text as it can be drawn: characters outside the class of known ones (as `[...]`) are blanks; missing_glyphs still counts them."""
    return F.regexp_replace(text, known.replace("[", "[^", 1), " ")
