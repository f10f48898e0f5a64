import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import findings as fd
from corpusloom.operators import grading as gr
from corpusloom.operators import models, passport, sampling, signals, similarity, tags, topics
from corpusloom.operators.corpus import Corpus
from corpusloom.operators.ids import dense_ids, rank_within
from corpusloom.operators.packing import assign_chunks, pack_chunks
from corpusloom.operators.report import report_lines
from corpusloom.sources.config import Config, Profile
from corpusloom.streaming.arrivals import new_texts


def greedy(words, target):
    out, held, chunk = [], 0, 0
    for w in words:
        if held > 0 and held + w > target:
            chunk, held = chunk + 1, w
        else:
            held += w
        out.append(chunk)
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_packing_equals_a_loop(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for source in ("a", "b", None, "empty-ish"):
        n = rng.randint(1, 60)
        words = [rng.choice([1, 5, 20, 59, 60, 61, 200]) for _ in range(n)]
        spots = sorted(rng.sample(range(n * 3), n))
        rows += [(source, p, w, "extra") for p, w in zip(spots, words)]
        want |= {(source, p): c for p, c in zip(spots, greedy(words, 60))}
    df = spark.createDataFrame(rows, "source string, position int, words int, chunk_name string")
    got = {(r["source"], r["position"]): r["chunk"] for r in assign_chunks(df, 60, block).collect()}
    assert got == want
    assert assign_chunks(df.limit(0), 60, block).count() == 0


def test_ids(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = dense_ids(df.select(F.col("id").alias("v")), [F.desc("v")]).collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(i, 999 - i) for i in range(1000)]
    hot = spark.range(500).withColumn("g", F.when(F.col("id") < 400, 0).otherwise(F.col("id")))
    ranks = rank_within(hot, ["g"], "id").groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r["r"] == list(range(len(r["r"]))) for r in ranks)


DOCS = {
    "a.md": "Shared footer of this site for everyone here.\n\n" + "alpha " * 30,
    "b.md": "Shared footer of this site for everyone here.\n\n" + "beta " * 410,
    "c.md": "shared  FOOTER of this site for everyone here.\n\n" + "gamma " * 21 + "\n\n" + "twice told " * 5 + "\n\n" + "twice told " * 5,
    "d.md": "delta " * 22,
}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "source string, text string")
    return Corpus(docs, Config(max_tier=0, target_words=60))


def test_tier0(spark, corpus):
    found = signals.run_all(corpus, corpus.config)
    rows = {(r["signal"], r["severity"], r["message"].split('"')[0]) for r in found.rows.collect()}
    assert ("boilerplate", "high", "boilerplate in 3/4 files (75%): ") in rows
    assert ("exact_dupes", "low", "identical paragraph appears 3x in 3 file(s): ") in rows
    assert ("exact_dupes", "medium", "identical paragraph appears 2x in 1 file(s): ") in rows
    assert any(r[0] == "length" and "too long (410 words) in b.md" in r[2] for r in rows)
    order = [(r["severity"], r["signal"], r["message"]) for r in fd.ranked(found).collect()]
    rank = {s: i for i, s in enumerate(fd.SEVERITIES)}
    assert order == sorted(order, key=lambda x: (rank[x[0]], x[1], x[2]))
    assert fd.flagged_paragraphs(found).count() == 5
    lists = {r["message"]: r for r in found.with_lists().where("signal = 'boilerplate'").collect()}
    assert [r["sources"] for r in lists.values()] == [["a.md", "b.md", "c.md"]]
    text = report_lines(corpus, found)
    assert text[0].startswith("4 files, 9 paragraphs") and "5 of 9 paragraphs" in text[-1]
    low = fd.downgrade(found.rows, F.col("severity") == "high", "info", "later")
    assert low.where("severity = 'high'").count() == 0 and low.count() == found.rows.count()


def test_a_failing_detector_is_left_out(spark, corpus):
    bad = signals.Signal("aaa_bad", 0, ("x",), lambda c, k: 1 / 0)
    signals.register(bad)
    said = []
    try:
        found = signals.run_all(corpus, corpus.config, said.append)
    finally:
        del signals._REGISTRY["aaa_bad"]
    assert found.rows.count() and "aaa_bad" in said[0]
    with pytest.raises(TypeError):
        signals.register(object())
    assert [s.name for s in signals.select()] == ["boilerplate", "exact_dupes", "length", "generic", "near_dupes"]


def test_tier1(spark):
    same = " ".join(f"word{i}" for i in range(40))
    near = same.replace("word39", "other")
    docs = spark.createDataFrame([("a", same), ("b", near), ("c", same.upper()), ("d", " ".join(f"z{i}" for i in range(40)))], "source string, text string")
    c = Corpus(docs, Config(near_duplicate=0.9, generic_threshold=0.8))
    rows = signals.near_dupes(c, c.config).rows.collect()
    assert {(r["key"], r["detail"]["identical_text"]) for r in rows} == {("0-1", "false"), ("0-2", "true")}
    assert {r["key"] for r in signals.generic(c, c.config).rows.collect()} == {"0", "1", "2"}
    few = Corpus(docs.limit(3), c.config)
    assert signals.generic(few, few.config).rows.count() == 0


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.95])
def test_cosine_pairs_are_exact(spark, threshold):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    x = np.vstack([b + rng.normal(scale=s, size=(25, 16)) for b, s in zip(base, np.linspace(0.05, 1, 12))])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)))}
    got = [(r["a"], r["b"]) for r in similarity.cosine_pairs(df, "id", "vec", threshold, block=20, most_cells=9).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_top_k_and_unusable_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [2.0, 2.0]), (7, [1.0])], "id bigint, vec array<double>")
    assert [r["id"] for r in similarity.top_k(df, [1.0, 0.1], 2).collect()] == [1, 6]
    assert similarity.top_k(df, [0.0, 0.0]).count() == 0
    reps, members = similarity.classes(df, "id", "vec")
    assert {r["key"] for r in members.collect()} == {1, 2, 6, 7}
    assert signals.centroid(df.limit(0)).count() == 0


def agglomerate_loop(x, least, most):
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    def run(groups, stop):
        while len(groups) > 1:
            c = np.array([unit(np.mean([x[i] for i in g], 0)) for g in groups])
            s = c @ c.T
            s[np.tril_indices(len(s))] = -9
            i, j = divmod(int(s.argmax()), len(s))
            if stop(len(groups), s[i, j]):
                break
            groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        return groups
    groups = run([[i] for i in range(len(x))], lambda n, b: b < least)
    many, one = [g for g in groups if len(g) > 1], [g for g in groups if len(g) == 1]
    return (run(many, lambda n, b: n <= most) if len(many) > most else many) + one


def test_agglomeration_equals_a_loop(spark):
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(40, 5))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert topics.merge_closest(x, 0.6, 4) == agglomerate_loop(x, 0.6, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    rows = topics.agglomerate(df, "id", "vec", 0.6, 4).collect()
    assert len(rows) == 40
    assert topics.agglomerate(df.limit(0)).count() == 0


def test_sampling_equals_a_loop(spark):
    for seed in range(6):
        rng = random.Random(seed)
        files = {f"{'b/' if i % 2 else ''}f{i}": [rng.randint(1, 300) for _ in range(rng.randint(1, 9))] for i in range(rng.randint(1, 8))}
        rows, i = [], 0
        for s in sorted(files, key=lambda p: p.split("/")):
            for w in files[s]:
                rows.append((i, s, w))
                i += 1
        want, total, turn = [], 0, 0
        order = sorted(files, key=lambda p: p.split("/"))
        by = {s: [r for r in rows if r[1] == s] for s in order}
        while len(want) < 12 and total < 900 and any(turn < len(by[s]) for s in order):
            for s in order:
                if turn < len(by[s]) and len(want) < 12 and total < 900:
                    want.append(by[s][turn][0])
                    total += by[s][turn][2]
            turn += 1
        df = spark.createDataFrame(rows, "id bigint, source string, words int")
        assert [r["id"] for r in sampling.round_robin(df).orderBy("ord").collect()] == want


def test_tags_and_passport(spark, tmp_path):
    T = tags.Tag
    s = tags.TagSet([T("topic", "Old"), T("topic", "Kept", status="confirmed", key="k1"), T("data_type", "mail")])
    new = [T("topic", "kept"), T("topic", "Renamed", key="k1"), T("topic", "Fresh")]
    by_table = tags.merge_proposals(s.frame(spark), tags.TagSet(new).frame(spark), ("topic",))
    s.replace_proposals(new, ("topic",))
    assert [t.label for t in s.tags] == ["Kept", "mail", "Fresh"]
    assert sorted(r["label"] for r in by_table.collect()) == ["Fresh", "Kept", "mail"]
    with pytest.raises(ValueError):
        s.replace_proposals([T("use_case", "x")], ("topic",))
    s.decide(s.tags[2], "e", "Better")
    s.save(tmp_path / "t.json")
    assert tags.TagSet.load(tmp_path / "t.json").tags == s.tags and tags.TagSet.load(tmp_path / "none.json").tags == []
    assert s.context() == "topic: Kept, Better"

    wanted = spark.createDataFrame([(0, "kept things"), (1, "maybe"), (2, "nothing")], "ord int, topic string")
    tag = spark.createDataFrame([(0, "Kept", "confirmed"), (1, "Maybe so", "proposed"), (2, "Kept", "rejected")], "ord int, label string, status string")
    verdicts = lambda *a: [r["verdict"] for r in passport.topic_checks(wanted, *a).orderBy("ord").collect()]
    assert verdicts(tag, True, 0) == ["PASS", "UNVERIFIED", "FAIL"]
    assert verdicts(tag.where("status = 'proposed'"), True, 0) == ["NOT GRADED", "UNVERIFIED", "NOT GRADED"]
    assert verdicts(tag, False, 0) == verdicts(tag, True, 3) == ["NOT GRADED"] * 3
    result = lambda v: tuple(passport.overall(spark.createDataFrame([(x,) for x in v], "verdict string")).first())
    assert result(["PASS", "FAIL", "UNVERIFIED"]) == ("FAIL", 1)
    assert result(["PASS", "NOT GRADED"]) == ("INCOMPLETE", 1)
    assert result([]) == ("PASS", 0)
    assert Profile().min_words is None


def test_grading(spark, tmp_path):
    paras = spark.createDataFrame([(0, "One two THREE four five six."), (1, "nothing here"), (2, "xone two three four five sixty")], "id bigint, text string")
    snips = spark.createDataFrame([("s", "two  three\nfour five"), ("t", "one two three four five six"), ("u", "here"), ("v", " "), ("w", None), ("x", "absent")], "snippet_id string, snippet string")
    got = {tuple(r) for r in gr.resolve_snippets(paras, snips).collect()}
    assert got == {("s", 0), ("s", 2), ("t", 0), ("t", 2), ("u", 1)}
    with pytest.raises(gr.GradingError):
        gr.discover(tmp_path)
    case = tmp_path / "c"
    case.mkdir()
    for bad in ('{"x": 1}', '{"defects": [{"id": "a", "kinds": [], "snippets": ["s"]}]}', '{"defects": [{"id": "a", "kinds": ["k"], "snippets": []}]}',
                '{"defects": [{"id": "a", "kinds": ["k"], "snippets": ["s"], "z": 1}]}',
                '{"defects": [{"id": "a", "kinds": ["k"], "snippets": ["s"]}, {"id": "a", "kinds": ["k"], "snippets": ["s"]}]}'):
        (case / "manifest.json").write_text(bad)
        with pytest.raises(gr.GradingError):
            gr.read_manifest(case)
    assert gr.parse_sweep("length_short=20:30:5") == ("length_short", [20, 25, 30])
    assert gr.parse_sweep("near_duplicate=0.9:1:0.05") == ("near_duplicate", [0.9, 0.95, 1.0])
    assert gr.parse_sweep("target_words=60,120") == ("target_words", [60, 120])
    for bad in ("x", "enabled=1:2", "near_duplicate=0.1:0.2", "length_short=5:1:0", "length_short=a,b"):
        with pytest.raises(gr.GradingError):
            gr.parse_sweep(bad)


def test_models(spark):
    assert models.first_json_object('Sure! ```json\n{"a": "b } c", "d": {"e": 1}}\n``` {"x": 2}') == '{"a": "b } c", "d": {"e": 1}}'
    assert models.first_json_object("none {") is None and models.first_json_object(None) is None
    with pytest.raises(models.ContextOverflow):
        models.guarded_answer(None, "w " * 7000)
    items = spark.createDataFrame([(2, "f", "later"), (1, "f", "first"), (3, "g", "known"), (4, None, "no")], "id bigint, fp string, text string")
    cache = spark.createDataFrame([("g", [1.0])], "fp string, vec array<float>")
    assert [tuple(r) for r in models.cache_misses(items, cache).collect()] == [("f", "first")]
    assert models.embed_missing(items, cache, models.HashEmbedder(8)).count() == 2


def test_arrivals_batch_and_stream(spark, tmp_path):
    known = spark.createDataFrame([("x",)], "fp string").limit(0)
    df = spark.createDataFrame([("A b",), ("a  B",), (None,), ("c",)], "text string")
    assert new_texts(df, known).count() == 2
    df.select("text", F.current_timestamp().alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, at timestamp").parquet(str(tmp_path / "in"))
    q = new_texts(stream, known, "at").writeStream.format("memory").queryName("arrivals").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrivals").count() == 2


def test_pack_chunks_drops_small_before_numbering(spark):
    rows = [(i, "s", i, "w " * n, "f", n) for i, n in enumerate([10, 55, 5, 70])]
    p = spark.createDataFrame(rows, "id bigint, source string, position int, text string, fp string, words int")
    got = [(r["id"], r["paragraph_ids"]) for r in pack_chunks(p, 60, 20).orderBy("id").collect()]
    assert got == [(0, [1, 2]), (1, [3])]


def counting(path):
    """An embedder that writes a line for each text, from whatever process; made here so that it travels by value."""

    class CountingEmbedder(models.HashEmbedder):
        def embed(self, texts):
            with open(path, "a") as f:
                f.writelines("x\n" for _ in texts)
            return models.HashEmbedder.embed(self, texts)

    return CountingEmbedder(32)


def test_each_text_is_embedded_once_and_not_again(spark, tmp_path):
    log = tmp_path / "log"
    docs = spark.createDataFrame([(f"{i}.md", " ".join(f"w{i}x{j}" for j in range(30)) + "\n\n" + "the same closing paragraph of ten words for all of us") for i in range(8)], "source string, text string")
    for run, want in ((1, True), (2, False)):
        log.write_text("")
        c = Corpus(docs, Config(near_duplicate=0.9, min_words=5), counting(str(log)), cache=str(tmp_path / "cache"))
        assert signals.near_dupes(c, c.config).rows.count() >= 0 and signals.generic(c, c.config).rows.count() >= 0
        distinct = {r[0] for r in c.chunks.select("fp").collect()} | {r[0] for r in c.paragraphs.where("words >= 10").select("fp").collect()}
        assert len(log.read_text().split()) == (len(distinct) if want else 0)
    assert models.read_cache(spark, str(tmp_path / "none"), "m").count() == 0


def test_top_k_of_many_is_exact(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(90, 8))
    x[40:44] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    got = {}
    for r in similarity.top_k_of_many(df, df.where("id % 10 = 0"), "id", 4, block=16).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["key"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 90, 10):
        s = u @ u[q]
        assert [got[q][i] for i in range(1, 5)] == sorted(range(90), key=lambda i: (-round(s[i], 12), i))[:4]
    assert set(got) == set(range(0, 90, 10))
    assert similarity.top_k_of_many(df.limit(0), df, "id").count() == 0 == similarity.top_k_of_many(df, df.limit(0), "id").count()


def test_hot_texts_lose_no_row(spark, corpus, monkeypatch):
    want = sorted(map(tuple, signals.exact_dupes(corpus, corpus.config).members.collect()))
    monkeypatch.setattr(signals, "HOT", 2)
    assert sorted(map(tuple, signals.exact_dupes(corpus, corpus.config).members.collect())) == want
    monkeypatch.setattr(signals, "HOT_TEXTS", 0)
    assert sorted(map(tuple, signals.exact_dupes(corpus, corpus.config).members.collect())) == want


def _planted(folder):
    """A case in the shape of a dirty collection: a menu line on five of eight pages, a footer on three, a copy, a wall, a fragment."""
    import json

    menu = "Home > Help > Articles > You are reading page one of many pages in the public help area today"
    footer = "All rights in these pages are held by the makers of this site and may not be sold on without leave given first"
    copy = "The move of accounts to the new ledger has reached step four of nine and nothing is late so far, says the person in charge of it all this week and the next"
    body = lambda i: " ".join(f"page{i}word{j}" for j in range(45))
    pages = {f"p{i}.md": [body(i)] for i in range(8)}
    for i in (0, 2, 4, 6, 7):
        pages[f"p{i}.md"].insert(0, menu)
    for i in (1, 3, 5):
        pages[f"p{i}.md"].append(footer)
    for i in (4, 5):
        pages[f"p{i}.md"].append(copy)
    pages["p6.md"].append(" ".join(f"wall{j}" for j in range(420)))
    pages["short.md"] = ["This note of just twenty-two words was left on its own page and nobody ever came back to say more than that."]
    for name, parts in pages.items():
        (folder / name).write_text("\n\n".join(parts))
    defects = [
        {"id": "menu", "kinds": ["boilerplate", "exact_duplicate"], "snippets": ["you are reading page one of many"]},
        {"id": "footer", "kinds": ["boilerplate", "exact_duplicate"], "snippets": ["may not be sold on without leave"]},
        {"id": "copy", "kinds": ["exact_duplicate"], "snippets": ["has reached step four of nine"]},
        {"id": "wall", "kinds": ["length_outlier"], "snippets": ["wall7 wall8 wall9 wall10 wall11"]},
        {"id": "fragment", "kinds": ["length_outlier"], "snippets": ["nobody ever came back to say"]},
        {"id": "tone", "kinds": ["off_topic"], "snippets": ["page1word3 page1word4 page1word5 page1word6"]},
    ]
    (folder / "manifest.json").write_text(json.dumps({"defects": defects}))


def test_planted_cases_are_found_in_full(spark, tmp_path):
    rows, levels = [], []
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        _planted(tmp_path / name)
        case = Corpus.of_folder(spark, str(tmp_path / name), Config(max_tier=0))
        scores, level = gr.grade_case(case, tmp_path / name)
        rows += [{"case": name, **r.asDict()} for r in scores.collect()]
        levels.append({"case": name, **level.first().asDict()})
    got = {r["signal"]: (r["planted"], r["found"], r["tp"], r["fp"]) for r in rows if r["case"] == "one"}
    assert got == {"boilerplate": (2, 2, 2, 0), "exact_dupes": (3, 3, 3, 0), "length": (2, 2, 2, 0)}
    assert levels[0] == {"case": "one", "graded": 5, "found": 5, "missed": 0, "unclaimed": 1}
    text = gr.table_lines(rows, levels)
    assert any(x.split()[:3] == ["OVERALL", "planted", "14"] and x.endswith("recall 1.00") for x in text)
    with pytest.raises(gr.GradingError):
        lost = gr.defects_frame(spark, "one", [{"id": "x", "kinds": ["boilerplate"], "snippets": ["a text that no page of this case has"]}])
        gr.resolve_defects(case.paragraphs, lost)


def test_a_model_service(tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def _send(self, data):
            body = json.dumps(data).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self._send({"models": [{"name": "emb:latest"}, {"name": "chat"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self._send({"embeddings": [[1.0, 2.0] for _ in body["input"]]} if self.path == "/api/embed" else {"message": {"content": '{"a": 1}'}})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    there = models.HttpModels(url, "emb", "chat")
    assert there.ready() and there.embed(["a", "b"]).shape == (2, 2) and there.answer("?") == '{"a": 1}'
    assert not models.HttpModels(url, "other").ready()
    server.shutdown()
    server.server_close()
    assert not there.ready()
    with pytest.raises(models.ServiceError):
        there.embed(["a"])


def test_plain_words(spark):
    rows = spark.createDataFrame([("boilerplate", 'in 3/4 files (75%): "the menu..."'), ("odd", "as it is")], "kind string, message string")
    got = {r["kind"]: r["plain"] for r in fd.in_plain_words(rows).collect()}
    assert got["boilerplate"].endswith(": the menu...") and "Many pages" in got["boilerplate"] and got["odd"] == "as it is"


def test_upload_limits():
    from corpusloom.sources.files import upload_problems

    assert upload_problems({"a.md": b"x"}) == [] and upload_problems({}) == ["no files"]
    assert len(upload_problems({f"{i}.md": b"x" for i in range(9)})) == 1
    assert len(upload_problems({"a.exe": b"x", "b.TXT": b"x" * 100_001, "c.md": b"x" * 100_000, "d.md": b"x" * 60_000})) == 3
