"""Command line: ``python -m corpusloom.cli look FOLDER`` and the like."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .operators import assist, grading, passport, signals, topics
from .operators.models import HttpModels
from .operators.corpus import Corpus, corpus_totals
from .operators.report import report_lines
from .operators.tags import TagSet
from .session import local_session
from .sources import config

#: Where decisions and the inventory of a folder are kept, below the folder.
STATE = ".corpusloom"


def _corpus(args, **overrides) -> Corpus:
    cfg = config.load(args.folder).merged(**overrides)
    models = _models(args)
    embedder = models if models and models.name else None
    corpus = Corpus.of_folder(local_session(), args.folder, cfg, embedder=embedder, cache=str(Path(args.folder) / STATE / "vectors"))
    if not corpus.docs.head(1):
        raise SystemExit(f"no text files below {args.folder}")
    return corpus


def _models(args, chat: bool = False) -> HttpModels | None:
    """The model service that was named; None if none was. One that does not answer ends the command, as does a missing chat model where it is needed."""
    if not getattr(args, "models", None):
        if chat:
            raise SystemExit("this needs a chat model: --models URL --chat MODEL")
        return None
    models = HttpModels(args.models, args.embed or "", args.chat or "")
    if not models.ready():
        raise SystemExit(f"the model service at {args.models} does not answer, or lacks the models")
    return models


def guess(args) -> int:
    """Proposes tags for what the data is, and keeps them with the others."""
    chat = _models(args, chat=True)
    path = Path(args.folder) / STATE / "tags.json"
    tags = TagSet.load(path)
    found = assist.guess(_corpus(args), chat, tags)
    for t in found:
        print(f"{t.group:<10} {t.label}")
    tags.replace_proposals(found, ("data_type", "use_case", "topic"))
    tags.save(path)
    return 0 if found else 1


def look(args) -> int:
    enabled = tuple(args.signals.split(",")) if args.signals else None
    if not signals.select(args.tier if args.tier is not None else 2, enabled or ()):
        raise SystemExit("no such detector")
    corpus = _corpus(args, max_tier=args.tier, enabled=enabled, near_duplicate=args.near, target_words=args.chunk_words)
    print("\n".join(report_lines(corpus, signals.run_all(corpus, corpus.config), 10**6 if args.all else 4)))
    return 0


def list_signals(_args) -> int:
    for s in signals.registry():
        print(f"tier {s.tier}  {s.name:<12} {', '.join(s.detects)}")
    return 0


def inventory(args) -> int:
    corpus = _corpus(args, max_topics=args.topics)
    names, models = {}, None if args.no_labels else _models(args)
    if models and models.chat_model:
        members = topics.typical_members(corpus)
        ids = {r["cluster"]: r["cluster_id"] for r in topics.cluster_ids(members).collect()}
        named = {ids[c]: said for c, said in assist.name_clusters(members, models).items()}
        path = Path(args.folder) / STATE / "tags.json"
        tags = TagSet.load(path)
        tags.replace_proposals(assist.topic_tags(named), ("topic",))
        tags.save(path)
        names = {k: label for k, (label, _) in named.items()}
    data = topics.snapshot(corpus, names, chat_model=models.chat_model if models else "")
    topics.save_json(Path(args.folder) / STATE / "inventory.json", data)
    print("\n".join(topics.inventory_lines(data)))
    return 0


def tag(args) -> int:
    path = Path(args.folder) / STATE / "tags.json"
    tags = TagSet.load(path)
    for t in list(tags.tags):
        if args.list or t.status != "proposed":
            print(f"{t.status:<10} {t.group:<10} {t.label}")
            continue
        answer = ""
        while answer not in ("y", "n", "e", "s", "q"):
            answer = input(f"{t.group}: {t.label}  [y]es [n]o [e]dit [s]kip [q]uit ").strip().lower()
        if answer == "q":
            break
        tags.decide(t, answer, input("label: ").strip() if answer == "e" else "")
    tags.save(path)
    return 0


def verdict(args) -> int:
    corpus = _corpus(args)
    spark, profile = corpus.docs.sparkSession, corpus.config.profile
    if profile is None:
        raise SystemExit("no [profile] in the settings")
    p = corpus.paragraphs.cache()
    data = topics.load_json(Path(args.folder) / STATE / "inventory.json")
    stale = 0
    if data:
        fps = [f for c in [*data["clusters"], data["unclustered"]] for f in c["paragraph_fps"]]
        stale = passport.staleness(p, spark.createDataFrame([(f,) for f in fps], "fp string")).first()["changed"]
    sizes = passport.size_checks(profile, corpus_totals(p), passport.duplication(p, corpus.config.boilerplate_min_files, corpus.config.enabled))
    checks = [r.asDict() for r in sizes.orderBy("ord").collect()]
    wanted = spark.createDataFrame(list(enumerate(profile.required_topics)), "ord int, topic string")
    own = [(i, t.label, t.status) for i, t in enumerate(TagSet.load(Path(args.folder) / STATE / "tags.json").group("topic"))]
    for r in passport.topic_checks(wanted, spark.createDataFrame(own, "ord int, label string, status string"), data is not None, stale).orderBy("ord").collect():
        checks.append({"verdict": r["verdict"], "requirement": f"covers {r['topic']}", "note": r["label"] or "no match"})
    result = passport.overall(spark.createDataFrame([(c["verdict"],) for c in checks], "verdict string")).first()
    print("\n".join(passport.page_lines(profile.intended_use, result, checks)))
    return 0


def bench(args) -> int:
    try:
        cases = [c for c in grading.discover(args.folder) if args.case in (None, c.name)]
        make = lambda case, **kw: Corpus.of_folder(local_session(), str(case), config.load(case).merged(**kw))
        if args.sweep:
            for row in grading.sweep_cases(lambda c, n, v: make(c, **{n: v}), cases, args.sweep, args.tier):
                print("{:>10} {:<12} tp {} fp {} found {}".format(*row))
            return 0
        rows, levels = [], []
        for case in cases:
            scores, level = grading.grade_case(make(case), case, args.tier)
            rows += [{"case": case.name, **r.asDict()} for r in scores.orderBy("signal").collect()]
            levels.append({"case": case.name, **level.first().asDict()})
        print("\n".join(grading.table_lines(rows, levels)))
    except grading.GradingError as why:
        print(why, file=sys.stderr)
        return 1
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(required=True)

    def command(name, run, folder=True):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        if folder:
            c.add_argument("folder")
            c.add_argument("--models", help="URL of a model service")
            c.add_argument("--embed", help="its embedding model")
            c.add_argument("--chat", help="its chat model")
        return c

    c = command("look", look)
    c.add_argument("--tier", type=int)
    c.add_argument("--signals")
    c.add_argument("--near", type=float)
    c.add_argument("--chunk-words", type=int)
    c.add_argument("--all", action="store_true")
    command("signals", list_signals, folder=False)
    command("guess", guess)
    c = command("inventory", inventory)
    c.add_argument("--no-labels", action="store_true")
    c.add_argument("--topics", type=int)
    c = command("tag", tag)
    c.add_argument("--list", action="store_true")
    command("passport", verdict)
    c = command("bench", bench)
    c.add_argument("--case")
    c.add_argument("--tier", type=int, default=0)
    c.add_argument("--sweep")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
