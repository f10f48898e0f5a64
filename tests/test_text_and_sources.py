import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.split import read_paragraphs, split_paragraphs
from corpusloom.sources import config, tables
from corpusloom.sources.files import read_folder

SAMPLES = ["", " ", "a  b c", "　x\x1cy\x85z ", "ÀÉ \t ß", "one", None, "x" * 50_000 + " y"]


def test_scalars_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, t string")
    t = F.col("t")
    rows = df.select("i", T.word_count(t).alias("w"), T.fingerprint(t).alias("fp"), T.preview(t, 48).alias("p"), T.token_estimate(T.word_count(t)).alias("k"))
    for r in rows.collect():
        s = SAMPLES[r["i"]]
        if s is None:
            assert r["w"] is r["fp"] is r["p"] is None
            continue
        one = " ".join(s.split())
        assert r["w"] == len(s.split())
        assert r["fp"] == hashlib.sha256(one.lower().encode()).hexdigest()[:16]
        assert r["p"] == one[:48]
        assert r["k"] == int(len(s.split()) * 1.3)


def test_percent_rounds_like_python(spark):
    shares = [0.625, 0.375, 0.125, 0.5, 1.0, 0.335, 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(T.percent(F.col("s"))).collect()]
    assert got == [f"{s:.0%}" for s in shares]


def test_positions_count_blank_blocks(spark):
    docs = spark.createDataFrame([("a", "x\n\n \n\ny\n\n\nz", 1), ("b", None, 2), ("c", "", 3)], "source string, text string, extra int")
    rows = [tuple(r) for r in split_paragraphs(docs).orderBy("source", "position").collect()]
    assert rows == [("a", 0, "x"), ("a", 2, "y"), ("a", 3, "z")]


def test_folder_reading(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "_draft").mkdir()
    (tmp_path / "a" / "b.md").write_bytes(b"one\r\n\r\ntwo")
    (tmp_path / "a-b.md").write_text("three")
    (tmp_path / "UP.MD").write_text("four")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "skip.csv").write_text("no")
    (tmp_path / ".hidden" / "h.md").write_text("five")
    (tmp_path / "_draft" / "d d+[1]%20.txt").write_text("six")
    docs = read_folder(spark, str(tmp_path))
    rows = [(r["id"], r["source"], r["text"]) for r in read_paragraphs(docs).orderBy("id").collect()]
    assert rows == [
        (0, ".hidden/h.md", "five"), (1, "UP.MD", "four"), (2, "_draft/d d+[1]%20.txt", "six"), (3, "a/b.md", "one"),
        (4, "a/b.md", "two"), (5, "a-b.md", "three"),
    ]
    with pytest.raises(FileNotFoundError):
        read_folder(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert read_folder(spark, str(tmp_path / "empty")).count() == 0


def test_config_is_strict(tmp_path):
    inner = tmp_path / "x" / "y"
    inner.mkdir(parents=True)
    assert config.load(inner) == config.Config()
    f = tmp_path / config.FILE_NAME
    f.write_text('[chunking]\ntarget_words = 60\n[profile]\nintended_use = "qa"\nrequired_topics = ["a"]\n')
    got = config.load(inner)
    assert got.target_words == 60 and got.profile.required_topics == ("a",)
    assert got.merged(min_words=None, max_tier=0).max_tier == 0
    for bad in ("[nope]\na = 1\n", "[chunking]\nnope = 1\n", "[profile]\nnope = 1\n", "loose = 1\n", '[profile]\nrequired_topics = [" "]\n'):
        f.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(inner)


def test_deliveries(spark):
    rows = [(1, "s", 0, "old", 0, None), (1, "s", 0, "new", 0, "2024-01-01 00:00:00"), (2, None, None, None, 1, None), (None, "s", 1, "x", 1, None)]
    df = spark.createDataFrame(rows, "id bigint, source string, position int, text string, batch int, ingested_at string")
    got = {r["id"]: r["text"] for r in tables.deliveries(df).collect()}
    assert got == {1: "new", 2: None}
    assert tables.deliveries(df.limit(0)).count() == 0
