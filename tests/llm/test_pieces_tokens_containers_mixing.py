import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import containers, mixing, pieces, tokens

vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


def text_of(rng, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(["a", "word", "longer"]) + rng.choice(["", "", "", "", ".", "?"]))
        out.append(rng.choice([" "] * 12 + ["\n", "\n\n", " ", "　"]))
    return "".join(out).strip()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 3000), st.integers(2, 400), st.integers(0, 10**6))
def test_pieces_cover_and_fit(n, limit, seed):
    overlap = random.Random(seed).randint(0, max(0, limit // 8))
    text = text_of(random.Random(seed), n)
    words = text.split()
    got = pieces.split_text(text, limit, overlap)
    assert [w for p in got for w in p["text"].split()[p["overlap"] :]] == words
    assert all(p["words"] == len(p["text"].split()) <= limit for p in got)
    for a, b in zip(got, got[1:]):
        if b["overlap"]:
            assert a["text"].split()[-b["overlap"] :] == b["text"].split()[: b["overlap"]]
        assert b["overlap"] == min(overlap, sum(p["words"] - p["overlap"] for p in got[: b["piece"]]))
    if n <= limit:
        assert len(got) == (1 if words else 0)


def test_boundaries_are_preferred():
    text = " ".join(["w"] * 390 + ["end."] + ["v"] * 200)
    assert [p["boundary"] for p in pieces.split_text(text)] == ["sentence", "paragraph"]
    one = " ".join(["w"] * 1000)
    assert [p["boundary"] for p in pieces.split_text(one)] == ["word", "word", "paragraph"]
    assert max(p["words"] for p in pieces.split_text(one)) - min(p["words"] for p in pieces.split_text(one)) <= 2
    blocks = "\n\n".join(" ".join(["x"] * 150) for _ in range(4))
    got = pieces.split_text(blocks, ids=[7, 8, 9, 10])
    assert [p["boundary"] for p in got] == ["paragraph"] * len(got)
    assert sorted({i for p in got for i in p["paragraph_ids"]}) == [7, 8, 9, 10]


def test_changed_texts_still_name_their_paragraphs():
    rng = random.Random(2)
    paras = [" ".join(f"p{i}{rng.randint(0, 10**6)}" for _ in range(200)) for i in range(5)]
    text = "\n\n".join(paras).replace("\n\n", " \n", 2).replace(paras[4], "")
    got = pieces.split_text(text, ids=[0, 1, 2, 3, 4], texts=paras)
    for p in got:
        inside = {i for i, t in enumerate(paras) if set(t.split()) & set(p["text"].split())}
        assert set(p["paragraph_ids"]) == inside


def test_split_items(spark):
    long = " ".join(["w"] * 900)
    rows = [(1, long, [5], "z"), (1, long, [5], "z"), (2, "short", None, "z"), (3, None, [1], "z"), (4, long, None, "z"), (5, "x" * 100_000, None, "z"), (6, "", None, "z")]
    df = spark.createDataFrame(rows, "id bigint, text string, paragraph_ids array<bigint>, piece string")
    got = pieces.split_items(df, spark.createDataFrame([(5, long)], "id bigint, text string")).orderBy("id", "piece").collect()
    assert [(r["id"], r["piece"], r["n_pieces"], r["paragraph_ids"]) for r in got] == [(1, i, 3, [5]) for i in range(3)] + [(4, i, 3, None) for i in range(3)]
    assert pieces.split_items(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_items(df, limit=40, overlap=40)


@vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 'stI1.\n\t é　 ,") , max_size=40))
def test_counts_are_exact(text):
    c = COUNTER.setdefault(0, tokens.Counter())
    assert c.count(text) == len(c.encoding.encode_ordinary(text))


COUNTER: dict = {}


@vocabulary
def test_sizes(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, None), (3, "", "s")], "doc_id bigint, text string, tokens string")
    assert {r["doc_id"]: r["tokens"] for r in tokens.sizes(df.drop("tokens"), "doc_id").collect()} == {1: 2, 2: None, 3: 0}


def expand(rows, cap):
    """The containers of a plan, each with its items."""
    out = {}
    for length, a, b, first, per in rows:
        for r in range(a, b):
            out.setdefault(first + (r - a) // per, []).append(length)
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_places_every_item_once(counts):
    rows = containers.plan(counts, 60)
    for length, n in counts.items():
        ranks = sorted(r for le, a, b, _, _ in rows if le == length for r in range(a, b))
        assert ranks == list(range(n))
    full = expand(rows, 60)
    assert all(sum(v) <= 60 for v in full.values())
    assert sorted(full) == list(range(len(full)))
    # Best fit decreasing, one item at a time, needs as many.
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, r in enumerate(rooms) if r >= length]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(60 - length)
    assert len(full) == len(rooms)


def test_plan_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        containers.plan({61: 1}, 60)


def test_fill(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([1, 7, 7, 7, 30, 55, 100, 250]), "x") for i in range(900)] + [(9000, None, "x"), (9001, 0, "x")]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint, rank string")
    caps = spark.createDataFrame([(1, 100, "a"), (2, 64, "b")], "capacity_id int, max_tokens int, label string")
    rows = containers.fill(spark, df, caps).collect()
    for c, cap in ((1, 100), (2, 64)):
        own = [r for r in rows if r["capacity_id"] == c]
        load, by = {}, {}
        for r in own:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
            by.setdefault(r["doc_id"], []).append((r["piece"], r["start_token"], r["tokens"]))
        assert max(load.values()) <= cap
        for i, n, _ in sizes:
            got = sorted(by.get(i, []))
            assert sum(t for _, _, t in got) == (n or 0)
            assert len(got) == (1 if n and n <= cap else -(-(n or 0) // cap))
            assert [s for _, s, _ in got] == [k * cap for k in range(len(got))]
    s = {r["capacity_id"]: r for r in containers.fill_summary(containers.fill(spark, df, caps), caps).collect()}
    assert s[1]["filled"] > 0.97 and s[1]["fullest"] <= 100
    assert containers.fill(spark, df.limit(0), caps).count() == 0


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, "big" if i % 3 else ("mid" if i % 2 else "small"), rng.randint(1, 400), "x") for i in range(6000)]
    docs = [d for d in docs if d[1] != "small" or d[0] % 40 == 0] + [(10_000, None, 50, "x"), (10_001, "big", None, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint, copies string").drop("copies")
    targets = spark.createDataFrame(
        [("m", "big", 0.6, 2), ("m", "mid", 0.2, 3), ("m", "small", 0.1, 4), ("m", "absent", 0.1, 5), ("n", "small", 1.0, 2)],
        "mix string, source string, target_share double, max_repeats int",
    )
    drawn = mixing.draw(df, targets)
    cap = {(r["mix"], r["source"]): r["max_repeats"] for r in targets.collect()}
    rows = drawn.collect()
    assert len({(r["mix"], r["doc_id"]) for r in rows}) == len(rows)
    assert all(1 <= r["copies"] <= cap[r["mix"], r["source"]] for r in rows)
    got = {(r["mix"], r["source"]): r for r in mixing.shares(drawn, df, targets).collect()}
    assert len(got) == 5 and got["m", "absent"]["tokens"] == 0 and not got["m", "absent"]["reachable"]
    for s, share in (("big", 0.6), ("mid", 0.2), ("small", 0.1)):
        assert got["m", s]["reachable"] and abs(got["m", s]["reached_share"] - share / 0.9) < 0.005
    assert got["n", "small"]["reached_share"] == 1.0
    again = {(r["mix"], r["doc_id"]): r["copies"] for r in mixing.draw(df.repartition(7), targets).collect()}
    assert again == {(r["mix"], r["doc_id"]): r["copies"] for r in rows}
    other = {(r["mix"], r["doc_id"]) for r in mixing.draw(df, targets, seed=2).collect()}
    assert other != set(again)
    much = mixing.shares(mixing.draw(df, targets, total_tokens=1e9), df, targets, 1e9).where("mix = 'n'").first()
    assert not much["reachable"] and much["most_copies"] == 2
    assert mixing.draw(df.limit(0), targets).count() == 0


def test_sampling_is_not_biased_by_size(spark):
    docs = [(i, "s", 10 if i % 2 else 200) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("m", "s", 1.0, 1)], "mix string, source string, target_share double, max_repeats int")
    n = df.agg(F.sum("tokens")).first()[0]
    rows = mixing.draw(df, t, total_tokens=n * 0.3).collect()
    short = sum(r["tokens"] == 10 for r in rows)
    assert abs(sum(r["tokens"] for r in rows) - 0.3 * n) <= 200 and abs(short / len(rows) - 0.5) < 0.06


def test_weights_raise_the_odds_of_inclusion(spark):
    sizes = spark.createDataFrame([(i, "a", 10, 3.0 if i % 2 else 1.0) for i in range(2000)], "doc_id long, source string, tokens int, size double")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix string, source string, target_share double, max_repeats int")
    got = [r["doc_id"] for r in mixing.draw(sizes, targets, total_tokens=4000.0, weight="size").collect()]
    heavy = sum(i % 2 for i in got)
    assert len(got) == 400 and 270 <= heavy <= 330  # three quarters expected


def test_certain_units_leave_the_rest_to_the_others(spark):
    """Three giants are certain; the others are drawn by size from what is left, and the tokens come out."""
    docs = [(i, "s", 5000) for i in range(3)] + [(10 + i, "s", 10 + 10 * (i % 4)) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("m", "s", 1.0, 1)], "mix string, source string, target_share double, max_repeats int")
    rows = mixing.draw(df, t, total_tokens=40_000, weight="tokens").collect()
    assert {0, 1, 2} <= {r["doc_id"] for r in rows} and abs(sum(r["tokens"] for r in rows) - 40_000) <= 40
    n = {k: sum(r["tokens"] == k for r in rows) for k in (10, 20, 30, 40)}
    # Odds in proportion to size: expected 83, 167, 250, 333 of 1,000 each.
    assert all(abs(n[k] - 1000 * k / 120) < 45 for k in n)


def test_a_stated_size_reports_what_is_lacking(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b", 100) for i in range(1000)], "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 2)], "mix string, source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.shares(mixing.draw(df, t, total_tokens="all", weight="tokens"), df, t, "all").collect()}
    assert got["a"]["tokens"] == 50_000 and got["a"]["short"] == 0 and got["a"]["reachable"]
    assert got["b"]["tokens"] == 20_000 and got["b"]["short"] == 30_000 and not got["b"]["reachable"] and got["b"]["most_copies"] == 2


def test_many_items_of_one_length_find_their_runs(spark, monkeypatch):
    monkeypatch.setattr(containers, "STRETCH", 7)
    df = spark.createDataFrame([(i, 3 if i % 3 else 4 + i % 2) for i in range(500)], "doc_id bigint, tokens bigint")
    caps = spark.createDataFrame([(1, "x", 10)], "capacity_id int, label string, max_tokens int")
    for most in (0, 10**6):
        monkeypatch.setattr(containers, "MOST_RUNS", most)
        rows = containers.fill(spark, df, caps).collect()
        room = {}
        for r in rows:
            room[r["container_id"]] = room.get(r["container_id"], 0) + r["tokens"]
        assert sorted(r["doc_id"] for r in rows) == list(range(500)) and max(room.values()) <= 10
