"""Text rules as Column expressions: white space, placeholders, audit, brackets, words, hashing.

String lengths follow two conventions: UTF-16 units where requests are costed, code points where ratios are taken."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# The white-space class of ECMAScript, the CJK test, brackets, sentence ends, mathematical ranges, language names.
WHITE = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK_TEXT = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{ff00}-\x{ffef}]"
CJK_TARGET = r"^(zh|ja|ko)(-|$)"
BRACKETS = ["（）", "()", "【】", "[]", "《》", "「」", "『』"]
TERMINAL = "[.。．!！?？…:：;；,，、)）】》」』\"”'’]$"
SOURCE_TERMINAL = "[.。！!？?]$"
MATH = r"[\x{0370}-\x{03ff}\x{1d400}-\x{1d7ff}\x{2061}-\x{2064}\x{2200}-\x{22ff}\x{27c0}-\x{27ef}\x{2980}-\x{29ff}\x{2a00}-\x{2aff}]"
LANGUAGES = {"zh-CN": "Simplified Chinese", "zh-TW": "Traditional Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "de": "German", "fr": "French", "es": "Spanish", "ru": "Russian"}
FNV_SEEDS = {"lane1": 0x811C9DC5, "lane2": 0x01000193, "lane3": 0x7FFFFFFF, "lane4": 0x9E3779B9}
FNV_PRIME = 0x01000193
LANES = StructType([StructField(name, LongType()) for name in FNV_SEEDS])

TOKEN = r"(⟦M[0-9]+⟧)"
NUMBER = r"⟦M([0-9]+)⟧"
BRACKETED = r"⟦[^⟧]*⟧"
MIN_RATIO, MAX_RATIO, JUDGED, WORDS_JUDGED = 0.25, 2.5, 40, 15


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WHITE}+", ""), f"{WHITE}+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space to one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"{WHITE}+", " "))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, WHITE, "")


def is_blank(c: Column) -> Column:
    return F.length(squeeze(c)) == 0


#: Letters whose upper case is several letters, with the single letter that stands for them in SQL's upper(): ẞ for ß, a title letter, or themselves.
SINGLE_UPPER = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1}


def upper(c: Column) -> Column:
    """Upper case letter by letter: the length in characters stays, where F.upper makes SS of ß."""
    single = F.create_map(*[F.lit(x) for pair in SINGLE_UPPER.items() for x in pair])
    letters = F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(single, x), F.upper(x)))
    return F.when(c.rlike(f"[{''.join(SINGLE_UPPER)}]"), F.array_join(letters, "")).otherwise(F.upper(c))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))


def placeholders_intact(source: Column, reply: Column) -> Column:
    """Same tokens, as strings, the same number of times."""
    return F.array_sort(tokens(source)) == F.array_sort(tokens(reply))


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1)), lambda n: n.cast("int"))


def placeholders_break(source: Column, reply: Column) -> Column:
    """Other numbers, or a bracketed run in the reply that names none of the source's formulas."""
    known = numbers(source)
    stray = F.exists(F.regexp_extract_all(reply, F.lit(f"({BRACKETED})"), F.lit(1)), lambda t: ~F.coalesce(F.array_contains(known, F.regexp_extract(t, f"^{NUMBER}$", 1).try_cast("int")), F.lit(False)))
    return (F.array_sort(known) != F.array_sort(numbers(reply))) | stray


def latin_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit("([A-Za-z][A-Za-z'’-]*)"), F.lit(1)))




def is_cjk_target(c: Column) -> Column:
    return strip(c).rlike(CJK_TARGET)


def occurrences(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def unbalanced(c: Column) -> Column:
    """The first bracket pair whose counts differ, or null. One pass keeps the brackets; only texts that hold any are counted."""
    every = "".join(BRACKETS)
    kept = F.regexp_replace(c, "[^" + "".join("\\" + ch for ch in every) + "]", "")

    def first(own: Column) -> Column:
        count = lambda ch: F.length(F.translate(own, every.replace(ch, ""), ""))
        return F.when(F.length(own) > 0, F.coalesce(*[F.when(count(b[0]) != count(b[1]), F.lit(b)) for b in BRACKETS]))

    return F.get(F.transform(F.array(kept), first), F.lit(0))


def audit(source: Column, reply: Column, target: Column) -> Column:
    """Issue codes in fixed order; an empty reply has that code alone.

    Both texts are trimmed once: the codes are computed from a bound pair, not from copies of the trimming expressions."""

    def codes(pair: Column) -> Column:
        text, src, cjk = pair["text"], pair["src"], pair["cjk"]
        ratio = F.length(text) / F.greatest(F.lit(1), F.length(src))
        long16 = utf16_length(src) >= JUDGED
        found = F.array(
            F.when(cjk & ~text.rlike(CJK_TEXT) & (latin_words(src) >= WORDS_JUDGED), F.lit("not-translated")),
            F.when(cjk & long16 & (ratio < MIN_RATIO), F.lit("truncated")).when(cjk & long16 & (ratio > MAX_RATIO), F.lit("overlong")),
            F.when(unbalanced(text).isNotNull(), F.lit("unbalanced")),
            F.when((F.length(src) >= JUDGED) & src.rlike(SOURCE_TERMINAL) & ~text.rlike(TERMINAL), F.lit("unterminated")),
        )
        return F.when(F.length(text) == 0, F.array(F.lit("empty"))).otherwise(F.array_compact(found))

    pair = F.struct(strip(reply).alias("text"), strip(source).alias("src"), is_cjk_target(target).alias("cjk"))
    return F.when(reply.isNotNull(), F.get(F.transform(F.array(pair), codes), F.lit(0)))


def contains_term(term: Column, text: Column) -> Column:
    """Whole word without regard to case for printable ASCII terms, substring otherwise."""
    escaped = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("(?i)(^|[^A-Za-z0-9])"), escaped, F.lit("([^A-Za-z0-9]|$)"))
    return F.when(F.length(term) == 0, F.lit(False)).when(term.rlike(r"^[\x20-\x7e]+$"), F.regexp_like(text, pattern)).otherwise(F.contains(text, term))


def strip_code_fence(c: Column) -> Column:
    """The text inside a leading ```word and a trailing fence."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def url_join(base: Column, path: Column) -> Column:
    root = F.regexp_replace(strip(base), "/+$", "")
    tail = F.concat(F.lit("/"), F.regexp_replace(strip(path), "^/+", ""))
    return F.when(root.endswith("/v1") & tail.startswith("/v1/"), F.concat(root, F.regexp_replace(tail, "^/v1", ""))).otherwise(F.concat(root, tail))


def language_name(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), c), c)


def _lanes(texts: pd.Series) -> np.ndarray:
    """FNV-1a lanes (4 x rows) over UTF-16 units: one step a position, over all rows that are still that long."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 2 for r in raw], np.int64)
    units = np.frombuffer(b"".join(raw), np.uint16).astype(np.uint32)
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")  # rows longer than each position
    h = np.repeat(np.array(list(FNV_SEEDS.values()), np.uint32)[:, None], len(raw), 1)
    for at, n in enumerate(live.tolist()):
        h[:, :n] = (h[:, :n] ^ units[begin[:n] + at]) * np.uint32(FNV_PRIME)
    out = np.empty_like(h)
    out[:, order] = h
    return out


@F.pandas_udf(LANES)
def _fnv(texts: pd.Series) -> pd.DataFrame:
    ok = texts.notna()
    h = _lanes(texts[ok])
    out = pd.DataFrame({name: pd.Series(index=texts.index, dtype="Int64") for name in FNV_SEEDS})
    for name, lane in zip(FNV_SEEDS, h, strict=True):
        out.loc[ok, name] = lane.astype(np.int64)
    return out


def fnv_lanes(c: Column) -> Column:
    """A struct of 32-bit FNV-1a lanes over UTF-16 units, in Arrow batches; nulls of a null text."""
    return _fnv(c)


def hash128(c: Column) -> Column:
    """Four lanes, eight hexadecimal digits each."""
    return F.get(F.transform(F.array(fnv_lanes(c)), lambda h: F.concat(*[F.lpad(F.lower(F.hex(h[name])), 8, "0") for name in FNV_SEEDS])), F.lit(0))


def cache_namespace(version: Column, url: Column, model: Column, target: Column, extra: Column) -> Column:
    """Names all that an answer depends on but its text."""
    return hash128(F.concat_ws("\0", version, url, model, target, extra))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def safe_stem(stem: Column) -> Column:
    clean = strip(F.regexp_replace(stem, r"\.+$", ""))
    return F.when(F.length(clean) == 0, F.lit("document")).otherwise(clean)


def math_share(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(c, MATH.replace("[", "[^", 1), "")) / F.length(c))


def is_math_text(c: Column) -> Column:
    """A run whose characters make it mathematics, whatever its font."""
    n = F.length(F.regexp_replace(c, MATH.replace("[", "[^", 1), ""))
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return ((n >= 3) & (n / F.greatest(utf16_length(c), F.lit(1)) >= 0.5)) | ((letters == 0) & (n > 0) & (utf16_length(c) <= 4))


def is_display_formula(text: Column, has_math: Column) -> Column:
    numbered = has_math & text.rlike(r"(?i)\([0-9]+[a-z]?\)\s*$") & (F.size(F.regexp_extract_all(text, F.lit("([A-Za-z]{3,})"), F.lit(1))) <= 2)
    bare = ~text.rlike(r"\p{L}{2,}") & ~is_blank(text) & (utf16_length(text) <= 80)
    return numbered | (math_share(text) >= 0.5) | bare


# Names of fonts that set mathematics, and of fonts of body text that look like them.
MATH_FONTS = r"(?i)CMMI|CMSY|CMEX|CMMIB|MS[AM]M|MT(MI|SY|EX)|XY|EUSM|EUFM|RSFS|WASY|Math|STIX|Symbol|MathematicalPi|TeX-|LMMath|NewCM|KpMath|Libertinus.*Math"
BODY_FONTS = r"(?i)Cambria(?!Math)|Arial|TimesNewRoman|Times|Calibri|Helvetica|NimbusRom|Mincho|Mono|Code|Symbola"
# Names of operators that are set upright, and the marks that stand in formulas without being letters.
OPERATORS = "^(true|Kalman|log|exp|max|min)$"
MARKS = r"^[\d\s+−=×/|()\[\]{}<>.,:ˆ¯]+$"


def is_math_font(font: Column) -> Column:
    return font.rlike(MATH_FONTS) & ~font.rlike(BODY_FONTS)


def is_math_run(text: Column, font: Column) -> Column:
    return F.coalesce(is_math_font(font), F.lit(False)) | is_math_text(text)


def is_accessory(text: Column, size: Column, line_size: Column) -> Column:
    """What belongs to a formula beside it: marks and digits, small type that is no word, named operators."""
    small = (size < line_size * 0.85) & ~text.rlike("[A-Za-z]{3,}") & (utf16_length(text) <= 12)
    return text.rlike(MARKS) | text.rlike(OPERATORS) | small


def needs_outline(text: Column, math: Column, size: Column, line_size: Column) -> Column:
    """Runs whose original glyphs may be needed: mathematics, small type, text without letters, named operators."""
    return math | (size < line_size * 0.85) | text.rlike(r"^[\d\W]+$") | text.rlike(OPERATORS)


def glossary_signature(terms: Column) -> Column:
    """terms: array of struct(source, target) -> one text that differs where the list differs."""
    return F.array_join(F.transform(terms, lambda t: F.concat(t["source"], F.lit("=>"), t["target"])), "\x1f")


def cache_key(namespace: Column, source: Column) -> Column:
    return F.concat(namespace, F.lit(":"), hash128(source))


def checkpoint_key(path: Column, size: Column, modified: Column) -> Column:
    """Names a file by where it is, how long it is and when it was changed."""
    return hash128(F.concat_ws("\0", path, size.cast("string"), modified.cast("string")))
