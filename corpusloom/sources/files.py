"""Text files of a folder as rows."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: the file endings that count as text.
SUFFIXES = (".md", ".txt", ".rst", ".markdown", ".text")


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """``source, text`` of every text file below ``root``.

    Endings match in any case. A file that is not valid UTF-8 is left out; a
    byte-order mark stays in the text; CRLF and CR become LF. Hidden files and
    folders (leading ``.`` or ``_``) count on a local root, where the paths are
    listed by name; Spark's own lister, used for any other root, skips them.
    A missing root raises ``FileNotFoundError``; a folder without text files gives
    no rows.
    """
    if "://" in root and not root.startswith("file://"):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        base = root.rstrip("/") + "/"
    else:
        local = Path(root.removeprefix("file://")).resolve()
        if not local.exists():
            raise FileNotFoundError(f"no such folder: {local}")
        found = sorted(
            os.path.join(d, f) for d, _, fs in os.walk(local) for f in fs if f.lower().endswith(SUFFIXES)
        )
        if not found:
            return spark.createDataFrame([], "source string, text string")
        # Listed paths are exact: what the lister would read as a pattern is escaped.
        raw = spark.read.format("binaryFile").load(["file://" + re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in found])
        base = f"{local}/"
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    # Spark shows a local path as file:/a/b.
    bare = F.regexp_replace("path", "^file:/+", "/")
    name = F.substring(bare, len(base) + 1, 1 << 20)
    text = F.col("content").cast("string")
    return (
        raw.where(ending.isin(*SUFFIXES))
        .where(F.is_valid_utf8(text))
        .select(name.alias("source"), T.newlines(text).alias("text"))
    )


#: What an upload may hold: files, bytes of one, bytes of all.
MOST_FILES, MOST_BYTES, MOST_TOTAL = 8, 100_000, 250_000


def upload_problems(files: dict[str, bytes]) -> list[str]:
    """Why a set of uploaded files cannot be taken; empty if it can. Names are checked for their ending."""
    out = [] if files else ["no files"]
    if len(files) > MOST_FILES:
        out.append(f"{len(files)} files; at most {MOST_FILES}")
    for name, data in files.items():
        if not name.lower().endswith(SUFFIXES):
            out.append(f"{name}: no text file ({', '.join(SUFFIXES)})")
        if len(data) > MOST_BYTES:
            out.append(f"{name}: {len(data)} bytes; at most {MOST_BYTES}")
    total = sum(map(len, files.values()))
    if total > MOST_TOTAL:
        out.append(f"{total} bytes in all; at most {MOST_TOTAL}")
    return out
