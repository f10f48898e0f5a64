"""Steps that ask a chat model. Its answers are proposals until a person confirms them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from . import sampling
from .findings import ranked
from .models import ChatModel, ContextOverflow, first_json_object, guarded_answer
from .tags import Tag, TagSet


def _ask(chat: ChatModel, prompt: str, system: str, need: str, attempts: int = 2) -> dict | None:
    """The first answer that is a JSON object with ``need``; None after ``attempts``."""
    for _ in range(attempts):
        try:
            said = first_json_object(guarded_answer(chat, prompt, system))
        except ContextOverflow:
            return None
        if said and json.loads(said).get(need):
            return json.loads(said)
    return None


def guess(corpus, chat: ChatModel, tags: TagSet) -> list[Tag]:
    """What kind of data this is and what for, from a sample of every file."""
    sample = sampling.round_robin(corpus.chunks).orderBy("ord").select("source", "text").collect()  # at most 12
    text = "\n---\n".join(f"{r['source']}\n{r['text']}" for r in sample)
    prompt = f"{tags.context()}\nAnswer as JSON with data_type, use_case, mode, topics, reasoning.\n\n{text}"
    said = _ask(chat, prompt, "You describe document collections.", "data_type")
    if not said:
        return []
    why, sources = str(said.get("reasoning", "")), tuple(sorted({r["source"] for r in sample}))
    out = [Tag("data_type", str(said["data_type"]), why, evidence=sources)]
    if said.get("use_case"):
        out.append(Tag("use_case", f"{str(said.get('mode', 'rag')).upper()}: {said['use_case']}", why, evidence=sources))
    return out + [Tag("topic", str(t), why, evidence=sources) for t in said.get("topics", [])]


def name_clusters(members, chat: ChatModel, score: str = "score", words: int = 600) -> dict[int, tuple[str, str]]:
    """Label and reasoning of each cluster, from its most typical members; unnamed on failure."""
    rows = sampling.label_sample(members, "cluster", score, 6, words).orderBy("cluster", "rn").collect()
    out = {}
    for c in sorted({r["cluster"] for r in rows}):
        text = "\n---\n".join(r["text"] for r in rows if r["cluster"] == c)
        said = _ask(chat, f"Name the topic as JSON with label, reasoning.\n\n{text}", "You name topics.", "label")
        if said:
            out[c] = (str(said["label"]), str(said.get("reasoning", "")))
    return out


def topic_tags(names: dict[str, tuple[str, str]]) -> list[Tag]:
    """One proposal for each cluster that has a name, keyed by the cluster's id."""
    return [Tag("topic", label, why, key=key) for key, (label, why) in sorted(names.items())]


def advise(corpus, findings, chat: ChatModel, tags: TagSet) -> list[dict]:
    """Up to five pieces of advice with a title, from a sample and the first twelve findings."""
    sample = sampling.round_robin(corpus.chunks).orderBy("ord").select("text").collect()
    top = ranked(findings).select("severity", F.col("message")).limit(12).collect() if findings else []
    digest = "\n".join(f"[{r['severity']}] {r['message']}" for r in top)
    prompt = f"{tags.context()}\n{digest}\nAnswer as JSON with advices: [{{title, why}}].\n\n" + "\n---\n".join(r["text"] for r in sample)
    said = _ask(chat, prompt, "You advise on document collections.", "advices") or {}
    return [a for a in said.get("advices", []) if isinstance(a, dict) and a.get("title")][:5]
