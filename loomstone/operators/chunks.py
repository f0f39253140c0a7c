"""Documents to chunks.  Where a cut lies depends on the cut before it, so a text is walked in Python, in Arrow batches; nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, sliced, spread

SIZE, OVERLAP = 512, 50
STOPS = ".!?:\n"
CODE = re.compile(r"(?:^|\n)((?:class|def|function)\s+\w+)")
HEADER = re.compile(r"(?:^|\n)(#{1,6}\s+.+)")


def by_size(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """Pieces of about `size` characters that end after a sentence if one ends in reach; each starts `overlap` before the last one's end, and at least one character further on."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            stop = max(text.rfind(c, start + 1, end + 1) for c in STOPS)
            end = stop + 1 if stop > start else end
        yield text[start:end]
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


def by_lines(text: str, size: int = SIZE) -> Iterator[str]:
    """Pieces of at most `size` characters that end with a line if they can."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            at = text.rfind("\n", start, end)
            end = at + 1 if at > start else end
        yield text[start:end]
        start = end


def by_heads(text: str, heads: re.Pattern, kind: str, size: int = SIZE) -> Iterator[tuple[str, str, str | None]]:
    """(piece, kind, head): a piece per head; fewer than two heads: by size.  Text before the first head is a piece too."""
    found = list(heads.finditer(text))
    if len(found) < 2:
        yield from ((p, "text", None) for p in by_size(text, size))
        return
    if lead := text[: found[0].start()].strip():
        yield lead, kind, None
    for m, after in zip(found, [*found[1:], None]):
        piece = text[m.start() : after.start() if after else len(text)].strip()
        if kind == "code" and len(piece) > size:
            yield from ((p, kind, None) for p in by_lines(piece, size))
        elif piece:
            yield piece, kind, m.group(1).strip()


def pieces(text: str | None, kind: str | None, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[str, str, str | None]]:
    text = text or ""
    if kind in ("code", "python", "javascript"):
        yield from by_heads(text, CODE, "code", size)
    elif kind == "markdown":
        yield from by_heads(text, HEADER, "markdown", size)
    else:
        yield from ((p, "text", None) for p in by_size(text, size, overlap))


def chunked(docs: DataFrame, id: str, text: str, kind: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Rows (id, chunk_index, text, kind, head) of all documents; empty and null texts have none."""
    rows = spread(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(kind).cast("string").alias("kind")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "chunk_index", "text", "kind", "head"]
        for b in (part for batch in batches for part in sliced(batch, "text")):
            out = [(i, k, *p) for i, t, x in zip(range(b.num_rows), b.column("text").to_pylist(), b.column("kind").to_pylist()) for k, p in enumerate(pieces(t, x, size, overlap))]
            at, *rest = zip(*out) if out else [()] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(rest, kinds))], names)

    return rows.mapInArrow(lean(run), T.StructType([rows.schema["id"], T.StructField("chunk_index", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("text", "kind", "head"))]))
