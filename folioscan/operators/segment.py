"""From text to blocks, lines, entries, line runs and search notes.

Everything up to entries is done within a document's row, so that no text is shuffled: one
Arrow pass places the blocks, Spark's own functions judge which of them open an entry, a
second pass joins the others to these and reads their dates. Both go through a text once. Notes are cut by a
sequential rule (each window starts where the last one's sentence ended), in one more pass.

Columns: documents (doc_id, text) -> entries (doc_id, idx, heading, text, start,
end, date fields) -> notes (doc_id, entry_idx, part, parts, label, text, words).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text as tx
from ..functions.binding import batched
from ..session import ship

BLANK = r"\n\s*\n"
RUN, GROUP = 12, 10
WINDOW, OVERLAP, REACH = 220, 40, 60
_WORD = re.compile(r"[\w'’-]+")


_BLANK = re.compile(BLANK, re.A)
_SPACE = " \t\n\r\f\v"
_YEAR = re.compile(r"(?<![A-Za-z0-9_])(?:19|20)[0-9]{2}(?![A-Za-z0-9_])")
#: Rows, and characters of text about, that a pass holds as Python objects at a time.
ROWS, HELD = 4096, 2_000_000


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ROWS rows and HELD bytes of its column of texts, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and (total + n > HELD or k - start >= ROWS):
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def place_blocks(text: str) -> tuple[list[str], list[int], list[int]]:
    """Texts, starts and ends of the pieces between blank lines that hold anything."""
    texts, starts, ends, at = [], [], [], 0
    cuts = [m.span() for m in _BLANK.finditer(text)]
    for a, b in [*cuts, (len(text), len(text))]:
        piece = text[at:a]
        if piece.strip(_SPACE):
            texts.append(piece)
            starts.append(at)
            ends.append(a)
        at = b
    return texts, starts, ends


def year_of(text: str) -> int | None:
    """The most frequent year from 1900 to 2099 standing alone, the earliest of equals; else None."""
    counted = Counter(_YEAR.findall(text))
    return int(min(counted, key=lambda y: (-counted[y], y))) if counted else None


def _lists(items: list[list], kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """Ends of the lists, and all their items in one array."""
    ends = pa.array(np.cumsum([0] + [len(x) for x in items]), pa.int32())
    return ends, pa.array([v for own in items for v in own], kind)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, hint, blocks (array of text, start, end) of each document; hint: the year that the text names most, else year_hint."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = F.col("year_hint").cast("int") if "year_hint" in docs.columns else F.lit(None).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                found = [place_blocks(t) for t in texts]
                years = [y if y is not None else h for y, h in zip(map(year_of, texts), batch.column(2).to_pylist(), strict=True)]
                ends, pieces = _lists([f[0] for f in found], pa.string())
                items = pa.StructArray.from_arrays([pieces, *(_lists([f[j] for f in found], pa.int32())[1] for j in (1, 2))], names=["text", "start", "end"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(years, pa.int32()), pa.ListArray.from_arrays(ends, items)], names=["doc_id", "hint", "blocks"])

    return docs.select("doc_id", "text", given.alias("hint")).mapInArrow(run, f"doc_id {kind}, hint int, blocks array<struct<text: string, start: int, `end`: int>>")


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text, start, end."""
    return placed(docs).select("doc_id", F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", "b.text", "b.start", "b.end")


def lines(block_rows: DataFrame) -> DataFrame:
    """doc_id, pos, line, text, start: lines of blocks with absolute places."""
    ship(block_rows.sparkSession)
    kinds = {c: block_rows.schema[c].dataType.simpleString() for c in ("doc_id", "pos")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2):
                rows = [t.split("\n") for t in batch.column(2).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
                starts = [np.cumsum([s, *(len(x) + 1 for x in r[:-1])]) for s, r in zip(batch.column(3).to_pylist(), rows, strict=True)]
                places = [np.arange(len(r)) for r in rows]
                flat = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int32())
                arrays = [batch.column(0).take(owner), batch.column(1).take(owner), flat(places), pa.array([x for r in rows for x in r], pa.string()), flat(starts)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "pos", "line", "text", "start"])

    return block_rows.select("doc_id", "pos", "text", "start").mapInArrow(run, f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, line int, text string, start int")


def starts_entry(block: Column, following: Column) -> Column:
    """Whether a block opens an entry: a heading candidate with evidence below it."""
    rows = F.split(block, "\n")
    first, second = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    several = tx.ends_sentence(second) | tx.is_section_name(first) | F.coalesce(dates.has_date(second), F.lit(False))
    alone = following.isNotNull() & F.coalesce(tx.is_body(following, first), F.lit(False))
    return tx.is_heading_candidate(first) & F.when(F.size(rows) > 1, several).otherwise(alone)


ENTRIES = 'doc_id {id}, idx int, heading string, text string, start int, `end` int, date string, date_raw string, inferred boolean, ambiguous boolean, month_only boolean, month string, end_month string, open_ended boolean'


def entries(docs: DataFrame, dated: bool = True) -> DataFrame:
    """doc_id, idx, heading, text, start, end, and the date fields (dated=False: without them).

    An entry is a block that opens one (or a document's first) with those up to the next; it has a heading if it opens one.
    docs may have year_hint, the year of dates that name none; the document's own
    most frequent year comes first.
    """
    found = F.col("blocks")

    def judged(b: Column, i: Column) -> Column:
        opens = F.coalesce(starts_entry(b["text"], F.get(found, i + 1)["text"]), F.lit(False))
        heading = F.when(opens, tx.clean_heading(F.get(F.split(b["text"], "\n"), F.lit(0))))
        return F.struct(b["text"].alias("text"), b["start"].alias("start"), b["end"].alias("end"), opens.alias("opens"), heading.alias("heading"))

    rows = placed(docs).select("doc_id", "hint", F.transform(found, judged).alias("blocks"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ENTRIES.format(id=kind) if dated else ", ".join(ENTRIES.format(id=kind).split(", ")[:6])
    names = [f.split()[0].strip("`") for f in fields.split(", ")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for whole in batches:
            ids = whole.column(0)
            schema = schema or pa.schema([("doc_id", ids.type), ("idx", pa.int32()), ("heading", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())] + [(n, pa.bool_() if n in FLAGS else pa.string()) for n in names[6:]])
            out: dict[str, list] = {n: [] for n in names}
            held = 0
            for k in range(whole.num_rows):
                own = whole.column(2).slice(k, 1).flatten()
                texts, starts, ends, opens, headings = (own.field(j).to_pylist() for j in range(5))
                first = [j for j in range(len(texts)) if opens[j] or not j]
                hint = whole.column(1)[k].as_py()
                for idx, (a, b) in enumerate(zip(first, [*first[1:], len(texts)], strict=False)):
                    text = "\n\n".join(texts[a:b])
                    held += len(text)
                    for n, v in zip(names, (ids[k], idx, headings[a], text, starts[a], ends[b - 1]), strict=False):
                        out[n].append(v)
                    if dated:
                        for n, v in dates.dates_of_entry(text, hint).items():
                            out[n].append(v)
                if len(out["idx"]) >= ROWS or held > HELD:
                    yield _batch(out, schema)
                    out, held = {n: [] for n in names}, 0
            if out["idx"]:
                yield _batch(out, schema)

    return rows.mapInArrow(join, fields)


FLAGS = ("inferred", "ambiguous", "month_only", "open_ended")


def _batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    ids = pa.array([v.as_py() for v in rows["doc_id"]], schema.field("doc_id").type)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(rows[f.name], f.type) for f in schema if f.name != "doc_id")], schema=schema)


@batched("int")
def dominant_year(text: pd.Series) -> pd.Series:
    """year_of() as a column function."""
    return pd.Series([year_of(t or "") for t in text], index=text.index, dtype=object)


def line_runs(docs: DataFrame, run: int = RUN, group: int = GROUP) -> DataFrame:
    """doc_id, i, line, island, n, place, piece: for each non-blank line its run's length, its place in it and its group.

    Runs of `run` lines or more are cut into equal groups of at most `group`; shorter ones
    are one group (0). Windows by document over rows of a line each.
    """
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("blank", tx.trimmed(F.col("line")) == "")
    islands = rows.withColumn("island", F.sum(F.col("blank").cast("int")).over(Window.partitionBy("doc_id").orderBy("i"))).filter(~F.col("blank"))
    own = Window.partitionBy("doc_id", "island")
    placed = islands.withColumns({"n": F.count("*").over(own), "place": F.row_number().over(own.orderBy("i")) - 1})
    per = F.ceil(F.col("n") / F.ceil(F.col("n") / group))
    return placed.select("doc_id", "i", "line", "island", "n", "place", F.when(F.col("n") >= run, F.floor(F.col("place") / per)).otherwise(0).cast("long").alias("piece"))


def split_runs(text: str, run: int = RUN, group: int = GROUP) -> list[str]:
    """Pieces of an entry, cut within long runs of lines only; joined they are the entry."""
    rows = re.findall(r"[^\n]*\n|[^\n]+$", text)
    cuts, at, k = [0], 0, 0
    while k < len(rows):
        n = 0
        while k + n < len(rows) and rows[k + n].strip():
            n += 1
        if n >= run:
            per = -(-n // -(-n // group))
            for j in range(n):
                at += len(rows[k + j])
                if (j + 1) % per == 0 or j + 1 == n:
                    cuts.append(at)
        else:
            n = n or 1
            at += sum(map(len, rows[k : k + n]))
            if n == 1 and not rows[k].strip() and cuts[-1] == at - len(rows[k]) and len(cuts) > 1:
                cuts[-1] = at  # a blank line belongs to what is before it
        k += n
    if cuts[-1] < len(text):
        cuts.append(len(text))
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return pieces if len(pieces) > 1 and "".join(pieces) == text else [text]


def _word_places(text: str) -> Iterator[re.Match]:
    return _WORD.finditer(text.replace("_", " "))  # letters, digits, apostrophes and hyphens: no underscores


def cut_notes(text: str, window: int = WINDOW, overlap: int = OVERLAP, reach: int = REACH) -> list[tuple[str, int, int]]:
    """(text, start, end) of overlapping notes of about `window` words that end with a sentence where one is near."""
    return [n[:3] for n in _counted_notes(text, window, overlap, reach)]


def _counted_notes(text: str, window: int = WINDOW, overlap: int = OVERLAP, reach: int = REACH) -> list[tuple[str, int, int, int]]:
    """cut_notes() with the number of words of each."""
    spans = [m.span() for m in _word_places(text)]
    if len(spans) <= window:
        return [(text, 0, len(text), len(spans))]
    out, cursor = [], 0
    while True:
        limit = min(cursor + window, len(spans))
        stop = limit
        if limit < len(spans):
            stop = next((i for i in range(limit, min(limit + reach, len(spans))) if re.search(r"[.!?]", text[spans[i - 1][1] : spans[i][0]])), limit)
        a, b = spans[cursor][0], spans[stop - 1][1] if stop == len(spans) else spans[stop][0]
        piece = text[a:b].strip()
        out.append((piece, a, a + len(piece), stop - cursor))
        if stop >= len(spans):
            return out
        cursor = max(cursor + 1, stop - overlap)


NOTES = "doc_id {id}, entry_idx int, part int, parts int, heading string, date string, date_raw string, label string, text string, words int"


def notes(entry_rows: DataFrame) -> DataFrame:
    """Search notes of entries, in order; the label says date, written date, heading or number, and the part."""
    ship(entry_rows.sparkSession)
    kind = entry_rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                pieces = [(p, k == 0) for k, p in enumerate(split_runs(r.text))]
                cut = [(n[0], first and j == 0, n[3]) for p, first in pieces for j, n in enumerate(_counted_notes(p))]
                name = r.date or r.date_raw or r.heading or f"Entry {r.idx + 1}"
                for part, (piece, first, words) in enumerate(cut):
                    label = f"{name} ({part + 1}/{len(cut)})" if len(cut) > 1 else name
                    out.append((r.doc_id, r.idx, part, len(cut), r.heading if first else None, r.date, r.date_raw, label, piece, words))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in NOTES.split(", ")])

    return entry_rows.select("doc_id", "idx", "heading", "date", "date_raw", "text").mapInPandas(run, NOTES.format(id=kind))
