"""Line deduplication by winnowing over line hashes.

Lines are compared without the white space around them; blank lines are passed over. Of every window of RUN lines the
least hash (of equal ones the last) is chosen, and each line that was chosen is one fingerprint, so each repeated run of
RUN lines has a fingerprint in common and the other lines emit nothing; a line of LONG words or more is one by itself.
Fingerprints that occur again are joined by position: from each, the match is extended before and behind it over the
windows that chose it, and windows that meet are one run. A later run goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Words, chunks, mix64, row_key, span_hashes
from lattica.plans.lineage import cut

#: Lines that a repeated run has at least, and words that a line has at least to count as a run by itself.
RUN, LONG = 2, 50
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def places(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, number, begin, words) of the lines of some texts that aren't blank: where each text begins, and of each line its number and first word."""
    breaks = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(words.data == 10, out=breaks[1:])
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    line = breaks[words.starts]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, len(line)])
    return np.searchsorted(begin, words.first), line[begin] - breaks[words.offsets[text[begin]]], begin, n


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, hash, words) of the lines of some texts that aren't blank."""
    first, _, begin, n = places(words)
    return first, span_hashes(_BYTES[words.data], words.starts[begin], words.ends[begin + n - 1]), n


def winnow(h: np.ndarray, first: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `run` hashes within a text its first line, and the line of its least hash, of equal ones the last."""
    start = np.flatnonzero(np.arange(len(h)) + run <= np.repeat(first[1:], np.diff(first)))
    if not len(start):
        return start, start
    windows = np.lib.stride_tricks.sliding_window_view(h, run)[start]
    return start, start + run - 1 - windows[:, ::-1].argmin(1)


def repeated_runs(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(k, spans): for each key of docs (k, text) the later runs (l, n): first place among its non-blank lines, and lines."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in chunks(b):
                first, h, n = lines(w)
                start, chosen = winnow(h, first, run)
                new = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]]) if len(chosen) else chosen
                alone = np.flatnonzero(n >= long)
                unit = np.r_[span_hashes(h, start, start + run), ~h[alone]].view(np.int64)
                offsets = np.r_[new, np.arange(len(start), len(unit) + 1)].astype(np.int32)
                at = np.r_[start[new], alone]
                text = np.searchsorted(first, at, "right") - 1
                columns = [pa.array(np.r_[h[chosen[new]], ~h[alone]].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit)), b.column("k").slice(i, j - i).take(pa.array(text)), pa.array(at - first[text]), pa.array(np.r_[np.full(len(new), run), np.ones(len(alone), int)])]
                yield pa.RecordBatch.from_arrays(columns, names=["f", "units", "k", "l", "n"])

    found = docs.mapInArrow(fingerprints, f"f long, units array<long>, k {docs.schema['k'].dataType.simpleString()}, l long, n long")
    common = found.groupBy("f").agg(F.count("*").alias("many")).where("many > 1").select("f")
    met = cut(found.join(common, "f").select("k", "l", "n", F.posexplode("units").alias("i", "u")).select("u", "k", (F.col("l") + F.col("i")).alias("l"), "n"))
    place = F.struct("k", "l")
    first = met.groupBy("u").agg(F.min(place).alias("first"), F.count("*").alias("many")).where("many > 1").select("u", "first")
    later = met.join(first, "u").where(place > F.col("first"))
    return later.groupBy("k").agg(F.collect_set(F.struct("l", "n")).alias("spans"))


def dedup_lines(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """docs (doc_id, text) with kept (the text without later runs), n_lines and n_removed (lines, blank ones included).

    A line goes if it is in a run of `run` non-blank lines, or is a line of `long` words, that also starts earlier: in
    a smaller doc_id (null is the largest), or earlier in the same text. Blank lines inside a removed run go with it. Of
    rows that share an id, or have none, the one whose text has the smaller hash is earlier; equal rows count as one, and
    so keep the same lines. A null text has no lines and stays null; an empty one has one, which is blank. Texts of any
    length are read whole; an empty table gives an empty one. Columns of docs are under `row`, and so may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row_key("doc_id", "text").alias("k"), row.alias("row"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.RecordBatch.from_arrays([pc.struct_field(b.column("row"), [at])], names=["text"])
            for i, j, w in chunks(texts):
                first, number, _, _ = places(w)
                kept, n, gone = [], [], []
                for k, (text, spans) in enumerate(zip(texts.column(0).slice(i, j - i), b.column("spans").slice(i, j - i))):
                    text, spans = text.as_py(), spans.as_py()
                    n.append(0 if text is None else text.count("\n") + 1)
                    drop: set[int] = set()
                    for s in spans or ():
                        line = first[k] + s["l"]
                        drop.update(range(number[line], number[line + s["n"] - 1] + 1))
                    gone.append(len(drop))
                    kept.append("\n".join(x for q, x in enumerate(text.split("\n")) if q not in drop) if drop else text)
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["row", "kept", "n_lines", "n_removed"])

    at = docs.columns.index("text")
    runs = repeated_runs(docs.select(row_key("doc_id", "text").alias("k"), "text"), run, long)
    joined = rows.join(runs, "k", "left").select("row", "spans")
    return joined.mapInArrow(rest, f"row {rows.schema['row'].dataType.simpleString()}, kept string, n_lines long, n_removed long")


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of docs; see `dedup_lines`."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with each text replaced by what `dedup_lines` keeps of it (n_chars, if there, by its length); all rows and columns stay."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return dedup_lines(docs).select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


#: DuckDB SQL for `line_digests` over the table documents.
LINES_SQL = r"""
with split_up as (
    select doc_id, coalesce(text, '') as whole, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents
), bare as (
    select doc_id, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as b from split_up
), numbered as (
    select doc_id, i, b, len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) as n, row_number() over (partition by doc_id order by i) as k,
        lead(b) over (partition by doc_id order by i) as b2, lead(i) over (partition by doc_id order by i) as i2
    from bare where b <> ''
), units as (
    select doc_id, k, b || chr(10) || b2 as u, i as lo, i2 as hi from numbered where b2 is not null
    union all
    select doc_id, k, b || chr(10) as u, i as lo, i as hi from numbered where n >= 50
), placed as (
    select *, min(struct_pack(d := doc_id, k := k)) over (partition by u) as first from units
), gone as (
    select distinct s.doc_id, s.i from split_up s join placed p on p.doc_id = s.doc_id and s.i between p.lo and p.hi where struct_pack(d := p.doc_id, k := p.k) > p.first
)
select d.doc_id, coalesce(c.n, 0) as n_lines, coalesce(g.n, 0) as n_removed, sha256(coalesce(c.kept, '')) as kept_sha256
from documents d
left join (
    select s.doc_id, count(*) as n, string_agg(s.line, chr(10) order by s.i) filter (where g.i is null) as kept from split_up s left join gone g using (doc_id, i) group by s.doc_id
) c using (doc_id)
left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id)
"""
