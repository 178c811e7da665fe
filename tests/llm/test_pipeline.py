"""The pipeline's stages on a small corpus with awkward rows."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quire.llm import jaccard_join, mixing, packing
from quire.llm.common import materialise, shared_dir


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(6)
    parts = "the and ing ion ent ther wh ou st re ly ed".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    rows, marks = [], []
    for i in range(500):
        text = " ".join(word() for _ in range(rng.randint(10, 90))).capitalize() + "."
        if rows and rng.random() < 0.15:
            text = rng.choice(rows)[1] or text
        bad = rng.random() < 0.2
        if bad:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en" if i % 9 else None, rng.choice(["a", "b", "c", None]), len(text)))
        if i % 2:
            marks.append((i, int(not bad), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, "12 34", "en", "a", 5), (None, "the and thering", "en", "a", 15), (3, rows[3][1], "en", "a", 1)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialise(stage(spark, docs, tables), f"test-{name}")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        ids = {r["doc_id"] for r in after}
        assert ids <= {r["doc_id"] for r in before}
        if name == "language":
            assert {r["doc_id"] for r in before} - ids == {1000, 1001, 1002} and {r["lang"] for r in after} == {"en"}
        elif name == "quality":
            good = [r for r in before if r["text"] != r["text"].upper()]
            assert sum(r["doc_id"] in ids for r in good) > 0.85 * len(good) and sum(r["text"] == r["text"].upper() for r in after) < 5
        elif name == "near_duplicates":
            classes = jaccard_join.near_duplicates(spark.createDataFrame([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None], "doc_id long, text string")).collect()
            assert {r["component_id"] for r in classes} == ids - {None} and len(after) == len(ids)
        elif name == "mixing":
            assert max(sum(r["doc_id"] == i for r in after) for i in list(ids)[:50]) <= 3
        else:
            at = 0
            for seq, off, n in sorted((r["sequence_id"], r["offset"], r["length"]) for r in after):
                assert (seq, off) == divmod(at, packing.LENGTH)
                at += n
            assert sum(r["start"] == 0 for r in after) == len(before)


def test_null_and_repeated_ids_lose_nothing(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows = [(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (4, text(4)), (7, text(5)), (7, text(5)), (None, text(5)), (8, text(6))]
    docs = spark.createDataFrame([(i, t, "en", None if k % 2 else "a", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(None, text(1)), (None, text(2)), (5, text(3)), (4, text(4)), (7, text(5)), (8, text(6))], key=str)
    for some in (kept, docs):
        mixed = corpus_pipeline.mix_sources(spark, some, "").groupBy("doc_id", "text").count().collect()
        taken = mixing.mix(some.select("doc_id", "text", "source")).groupBy("doc_id", "tie").sum("copies").where("sum(copies) > 0").collect()
        assert sorted(r[2] for r in mixed) == sorted(r[2] for r in taken) and any(r["doc_id"] is None for r in mixed)


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")) == list(range(1, 14))


def test_shared_folder_is_the_sessions(spark):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: "file:///tmp/given/" if key == "spark.checkpoint.dir" else default)

    assert shared_dir(Session) == "file:///tmp/given"
    assert shared_dir(spark) == shared_dir(spark)
