import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as X

LONG = "This paragraph has plenty of words so a truncated translation stands out clearly to any reader who compares them."


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("reply", "ok"),
    [("该方法使用⟦M1⟧作为输入。", True), ("该方法使用⟦M01⟧作为输入。", False), ("该方法使用⟦M1⟧和⟦M1⟧。", False), ("该方法不使用公式。", False)],
)
def test_strict_placeholders(spark, reply, ok):
    assert one(spark, X.placeholders_intact(F.col("s"), F.col("r")), s="The method uses ⟦M1⟧ as input.", r=reply) is ok


def test_invented_placeholder(spark):
    assert one(spark, X.placeholders_intact(F.col("s"), F.col("r")), s="no token", r="数值⟦M1⟧") is False


@pytest.mark.parametrize(("reply", "broken"), [("数值⟦M1⟧被使用。", False), ("数值⟦M01⟧被使用。", False), ("⟦M1⟧⟦M1⟧", True), ("没有", True), ("⟦M1⟧⟦x⟧", True)])
def test_numeric_placeholders(spark, reply, broken):
    assert one(spark, X.placeholders_break(F.col("s"), F.col("r")), s="value ⟦M1⟧ used", r=reply) is broken


@pytest.mark.parametrize(
    ("source", "reply", "target", "codes"),
    [
        (LONG, "只有一点点", "zh-CN", ["truncated", "unterminated"]),
        ("See (Figure 3).", "见（图 3。", "zh-CN", ["unbalanced"]),
        (LONG, "This is still an English sentence and it has not been translated at all by anyone.", "zh-CN", ["not-translated"]),
        (LONG, "This is still an English sentence and it has not been translated at all by anyone.", "en", []),
        (LONG, "", "zh-CN", ["empty"]),
        (LONG, "　 ", "zh-CN", ["empty"]),
    ],
)
def test_audit(spark, source, reply, target, codes):
    assert one(spark, X.audit(F.col("s"), F.col("r"), F.col("t")), s=source, r=reply, t=target) == codes


def test_hash_of_utf16_units(spark):
    assert one(spark, X.hash128(F.col("s")), s="注意α😀 abc") == "9b03e806c5d91c5cee282210d2e0aa12"


@pytest.mark.parametrize(("base", "path", "want"), [("https://a/v1/", "/chat/completions", "https://a/v1/chat/completions"), ("https://a/v1", "/v1/models", "https://a/v1/models")])
def test_url_join(spark, base, path, want):
    assert one(spark, X.url_join(F.col("b"), F.col("p")), b=base, p=path) == want


def test_code_fence(spark):
    assert one(spark, X.strip_code_fence(F.col("s")), s="```json\n[]\n```") == "[]"


def test_terms(spark):
    c = X.contains_term(F.col("t"), F.col("s"))
    assert one(spark, c, t="row buffer", s="The Row Buffer conflicts are reduced.") is True
    assert one(spark, c, t="row buffer", s="Rows are buffered elsewhere") is False
    assert one(spark, c, t="c++", s="written in C++ today") is True
    assert one(spark, c, t="行缓冲", s="使用行缓冲区") is True


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab  　﻿\t😀", max_size=12), min_size=1, max_size=8))
def test_white_space_and_lengths(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", X.collapse(F.col("t")).alias("c"), X.utf16_length(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        plain = "".join(" " if c in " 　﻿\t" else c for c in t)
        assert got[i]["c"] == " ".join(plain.split(" ")).strip() or got[i]["c"] == " ".join(plain.split())
        assert got[i]["n"] == len(t.encode("utf-16-be")) // 2


def test_prompts_keys_and_reasons(spark):
    from quire.functions import replies as R
    from quire.operators import enrich

    one = spark.range(1)
    prompt = one.select(R.system_prompt(F.lit("base"), F.lit("- a → b")).alias("a"), R.system_prompt(F.lit("base"), F.lit("")).alias("b"), R.system_prompt(F.lit("base"), F.lit(None)).alias("c")).first()
    assert tuple(prompt) == ("base\n\n- a → b", "base", "base")
    keys = one.select(X.checkpoint_key(F.lit("/d/a.pdf"), F.lit(3), F.lit(9)).alias("k"), X.hash128(F.lit("/d/a.pdf\0" + "3\0" + "9")).alias("w"), X.checkpoint_key(F.lit("/d/a.pdf"), F.lit(39), F.lit("")).alias("o")).first()
    assert keys["k"] == keys["w"] != keys["o"] and len(keys["k"]) == 32
    names = [one.select(X.cache_namespace(*[F.lit(x) for x in parts]).alias("n")).first()["n"] for parts in (("3", "u", "m", "zh", ""), ("3", "u", "m", "ja", ""), ("3", "u", "mzh", "", ""))]
    assert len(set(names)) == 3
    rows = spark.createDataFrame([(1, 2, "late"), (1, 0, "first"), (1, 1, "first"), (1, 3, "third"), (1, 4, "fourth"), (2, 0, None)], "doc_id long, batch int, error string")
    assert [tuple(r) for r in enrich.failure_reasons(rows).collect()] == [(1, ["first", "late", "third"])]


def test_whole_files_and_decisions(spark, tmp_path):
    from quire.sinks import write_decisions
    from quire.sources.structure import read_files

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 one")
    (tmp_path / "b.txt").write_bytes(b"no")
    files = read_files(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], bytes(r["content"]), r["length"]) for r in files] == [("a.pdf", b"%PDF-1.4 one", 12)]
    decided = spark.createDataFrame([(1, 0, "draw")], "doc_id long, para_index int, reason string")
    write_decisions(decided, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        write_decisions(decided, str(tmp_path / "out"))
    write_decisions(decided, str(tmp_path / "out"), overwrite=True)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 0, "draw")]


def test_upper_letter_by_letter(spark):
    """As SQL has it: ß is ẞ, ligatures and ŉ stay, ᾳ is ᾼ."""
    words = ["Erßie", "oﬁce", "ŉ", "ᾳ", "año ŭ", "", "𐐨x"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.upper(F.col("w")).alias("u")).collect()
    assert {r["w"]: r["u"] for r in got} == dict(duckdb.execute("SELECT w, upper(w) FROM (SELECT unnest(?) AS w)", [words]).fetchall())
    assert {r["w"]: r["u"] for r in got}["Erßie"] == "ERẞIE"
