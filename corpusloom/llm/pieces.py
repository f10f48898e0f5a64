"""Oversized items cut at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PARAGRAPH, LINE, SENTENCE, WORD = 3, 2, 1, 0
#: Fixed value: names of the boundaries by strength.
NAMES = ("word", "sentence", "line", "paragraph")
_WORDS = re.compile(r"\S+")
_STOP = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_BLANK = re.compile(r"\n[^\S\n]*\n|\r\n?[^\S\n]*\r| ")
_KEY = re.compile(r"[\W_]+")


def words_of(text: str) -> list[tuple[int, int]]:
    """Spans of the words, as ``str.split()`` has them."""
    out, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary behind each word."""
    out = []
    for (a, b), (c, _) in zip(spans, spans[1:]):
        gap = text[b:c]
        if _BLANK.search(gap):
            out.append(PARAGRAPH)
        elif "\n" in gap or "\r" in gap or " " in gap or "\x85" in gap:
            out.append(LINE)
        else:
            out.append(SENTENCE if _STOP.search(text, a, b) else WORD)
    return out + [PARAGRAPH] if spans else out


def cuts(strength: list[int], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """``start, core_start, end`` of each piece, in words.

    The least number of pieces gives equal targets; each end moves to the strongest
    boundary near its target, or, where none is near, to the closest one that the limit
    allows; only where there is none at all does it fall between two words. If the last
    piece then exceeds the limit, the number of pieces grows by one.
    """
    n = len(strength)
    if n <= limit:
        return [(0, 0, n)] if n else []
    step = limit - overlap
    least = 1 + -(-(n - limit) // step)
    for k in range(least, n + 1):
        length = (n + (k - 1) * overlap) / k
        near = max(1, int(min(length / 4, step / 3)))
        out, done = [], 0
        for i in range(k):
            start = max(0, done - overlap) if i else 0
            most = min(n, start + limit)
            if i == k - 1:
                end = n
            else:
                target = min(max(done + 1, round((i + 1) * length - i * overlap)), most)
                last = min(most, n - 1)
                window = range(max(done + 1, target - near), min(last, target + near) + 1)
                end = max(window, key=lambda e: (strength[e - 1], -abs(e - target)), default=0)
                if not end or strength[end - 1] == WORD:
                    reach = [e for e in range(done + 1, last + 1) if strength[e - 1] > WORD]
                    end = min(reach, key=lambda e: abs(e - target)) if reach else min(target, last)
            if end > most or end <= done:
                break
            out.append((start, done, end))
            done = end
            if done == n:
                break
        if done == n:
            return out
    raise AssertionError("a piece for every word always fits")


def _cover(words: list[str], ids: list, texts: list[str | None]) -> list[tuple[int, int]]:
    """Where each paragraph lies among the chunk's words; (0, 0) if it was cut away.

    Paragraphs come in order. One is found by its first words, or by later ones if
    its beginning was cut, and ends where its words or the chunk end.
    """
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    out, cursor = [], 0
    for t in texts:
        own = [k for w in (t or "").split() if (k := _KEY.sub("", w.lower()))]
        run = min(4, len(own))
        spot = None
        for skip in [0, *range(1, max(len(own) - run, 0) + 1)]:
            probe = own[skip : skip + run]
            if not probe:
                break
            spot = next((p for p in at.get(probe[0], ()) if p >= cursor and words[p : p + run] == probe), None)
            if spot is not None:
                out.append((max(cursor, spot - skip), min(len(words), spot - skip + len(own))))
                cursor = max(cursor, spot + run)
                break
        if spot is None:
            out.append((0, 0))
    for i in range(len(out) - 1):
        later = next((o[0] for o in out[i + 1 :] if o[1]), len(words))
        out[i] = (out[i][0], min(out[i][1], later)) if out[i][1] else out[i]
    return out


def split_text(text: str, limit: int = 400, overlap: int = 40, ids: list | None = None, texts: list | None = None) -> list[dict]:
    """The pieces of one text; one piece if it is within the limit, none if it has no words."""
    spans = words_of(text)
    strength = boundaries(text, spans)
    cover = None
    if ids is not None:
        blocks = [i for i, s in enumerate(strength) if s == PARAGRAPH]
        if len(blocks) == len(ids):
            cover = list(zip([0, *[b + 1 for b in blocks[:-1]]], [b + 1 for b in blocks]))
        else:
            words = [_KEY.sub("", text[a:b].lower()) for a, b in spans]
            full = [(i, w) for i, w in enumerate(words) if w]
            place = [i for i, _ in full] + [len(words)]
            found = _cover([w for _, w in full], ids, texts or [None] * len(ids))
            cover = [(place[a], place[b]) if b else (0, 0) for a, b in found]
    out = []
    for no, (start, core, end) in enumerate(cuts(strength, limit, overlap)):
        inside = None
        if cover is not None:
            inside = [i for i, (a, b) in zip(ids, cover) if a < end and b > start]
        out.append({
            "piece": no, "text": text[spans[start][0] : spans[end - 1][1]], "words": end - start, "overlap": core - start,
            "boundary": NAMES[strength[end - 1]], "paragraph_ids": inside,
        })
    return out


PIECE = "piece int, n_pieces int, text string, words int, overlap int, boundary string, paragraph_ids array<bigint>"


def split_items(items: DataFrame, paragraphs: DataFrame | None = None, key: str = "id", limit: int = 400, overlap: int = 40) -> DataFrame:
    """``key, piece, n_pieces, text, words, overlap, boundary, paragraph_ids`` of items above ``limit`` words.

    ``items`` has ``key, text, paragraph_ids``. Rows repeated under one key count once
    (the greatest by text stands). Null texts give nothing; null ``paragraph_ids`` stay
    null, and an id whose text was cut away is named by no piece. ``paragraphs`` (``id,
    text``, ids unique) serves to find paragraphs in items whose text was changed after
    packing. The words are counted in the JVM, so only oversized items move.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    big = items.where(F.col("text").isNotNull()).where(T.word_count(F.col("text")) > limit)
    big = big.groupBy(F.col(key).alias("key")).agg(F.max(F.struct("text", "paragraph_ids")).alias("x")).select("key", "x.text", "x.paragraph_ids")
    if paragraphs is None:
        big = big.withColumn("texts", F.lit(None).cast("array<string>"))
    else:
        one = big.select("key", F.posexplode("paragraph_ids").alias("pos", "pid"))
        p = paragraphs.select(F.col("id").alias("pid"), F.col("text").alias("ptext"))
        held = p.join(one.select("pid").distinct(), "pid", "left_semi")
        joined = one.join(held, "pid", "left").groupBy("key").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "ptext"))), lambda x: F.coalesce(x["ptext"], F.lit(""))).alias("texts")
        )
        big = big.join(joined, "key", "left")
    kind = dict(items.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            out: list[dict] = []
            cols = [b.column(c).to_pylist() for c in ("text", "paragraph_ids", "texts")]
            for i, (text, ids, texts) in enumerate(zip(*cols)):
                got = split_text(text, limit, overlap, ids, texts)
                out += [p | {"n_pieces": len(got)} for p in got]
                rows += [i] * len(got)
            names = ["piece", "n_pieces", "text", "words", "overlap", "boundary", "paragraph_ids"]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(rows, pa.int64())), *[pa.array([p[n] for p in out], k) for n, k in zip(names, kinds)]],
                names=["key", *names],
            )

    return big.mapInArrow(work, f"key {kind}, {PIECE}").withColumnRenamed("key", key)
