"""Findings as text."""

from __future__ import annotations

from .findings import CONFIDENCE, Findings, flagged_paragraphs, summary, top_per_signal


def report_lines(corpus, findings: Findings | None, per_signal: int = 4) -> list[str]:
    """The report; gathers at most ``per_signal`` rows of each signal."""
    t = corpus.totals().first()
    out = [f"{t['files']} files, {t['paragraphs']} paragraphs, {t['chunks']} chunks, {t['words']} words", ""]
    rows = top_per_signal(findings, per_signal).collect() if findings else []
    if not rows:
        return out + ["No findings."]
    for evidence in CONFIDENCE:
        own = [r for r in rows if r["evidence"] == evidence]
        if own:
            out.append(f"== {evidence}: {CONFIDENCE[evidence]}")
        for signal in sorted({r["signal"] for r in own}):
            mine = sorted((r for r in own if r["signal"] == signal), key=lambda r: r["shown"])
            for r in mine:
                out += [f"  [{r['severity']}] {r['message']}", f"      {r['advice']}"]
            if mine[0]["more"]:
                out.append(f"      and {mine[0]['more']} more from {signal}")
    counts = {r["severity"]: r["findings"] for r in summary(findings).collect()}
    flagged, every = flagged_paragraphs(findings).count(), t["paragraphs"]
    out += ["", ", ".join(f"{counts[s]} {s}" for s in ("high", "medium", "low", "info") if s in counts)]
    out.append(f"{flagged} of {every} paragraphs in high or medium findings ({flagged / max(every, 1):.0%})")
    return out
