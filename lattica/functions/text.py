"""Text functions: trimming, codes, chunk windows, recursive and semantic splitting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut
from lattica.session import ship

#: Separators of sentence splitting and of structural splitting, in order of preference (fixed values).
SENTENCE_SEPARATORS = (". ", "! ", "? ", "\n\n", "\n", " ", "")
STRUCTURE_SEPARATORS = ("\n\n", "\n", ".", " ")


def trim_white(c: Column) -> Column:
    """Without any white space at both ends (built-in trim takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def captured(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def coded(c: Column, names: dict[str, str]) -> Column:
    """The name of a code; null for an unknown one."""
    out = None
    for code, name in names.items():
        out = F.when(c == code, name) if out is None else out.when(c == code, name)
    return out


def or_default(c: Column, default: Column) -> Column:
    """default where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows of `size` that step by size - overlap until one reaches the end; none for n = 0."""
    last = F.greatest(n - overlap - 1, F.lit(0))
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def chunk_tokens(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_id, chunk): windows of `size` words, joined by spaces."""
    _check(size, overlap)
    tokens = docs.select(key, words(F.col(text)).alias("t"))
    starts = tokens.select(key, "t", F.posexplode(window_starts(F.size("t"), size, overlap)).alias("chunk_id", "s"))
    return starts.select(key, "chunk_id", F.array_join(F.slice("t", F.col("s") + 1, size), " ").alias("chunk"))


def chunk_chars(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_id, chunk): windows of `size` code points without white space at their ends; empty ones go, places stay."""
    _check(size, overlap)
    starts = docs.select(key, text, F.posexplode(window_starts(F.length(text), size, overlap)).alias("chunk_id", "s"))
    return starts.select(key, "chunk_id", trim_white(F.substring(F.col(text), F.col("s") + 1, F.lit(size))).alias("chunk")).where("chunk <> ''")


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"size {size} must be positive and above overlap {overlap}")


def split_recursively(text: str, size: int, overlap: int = 0, separators: Sequence[str] = SENTENCE_SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that occurs and, where still too long, at later ones.

    Small pieces are put together while they fit; a piece begins with up to `overlap` characters of whole pieces before
    it. A separator stays with what follows it. Without the separator '' a piece without any may stay too long.
    """
    found = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    if found is None:
        return [text.strip()] if text.strip() else []
    mark, later = separators[found], separators[found + 1 :]
    parts = list(text) if mark == "" else re.split(f"(?={re.escape(mark)})", text)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if piece := "".join(held).strip():
            out.append(piece)

    for part in filter(None, parts):
        if len(part) > size:
            flush()
            held.clear()
            out += split_recursively(part, size, overlap, later) if later else [part.strip()]
            continue
        if held and sum(map(len, held)) + len(part) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def chunk_recursively(docs: DataFrame, size: int, overlap: int, separators: Sequence[str] = SENTENCE_SEPARATORS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_id, chunk) by `split_recursively`, in Arrow batches."""
    _check(size, overlap)
    ship(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap, separators) if t else [])

    return docs.select(key, F.posexplode(pieces(F.col(text))).alias("chunk_id", "chunk"))


def chunk(docs: DataFrame, kind: str, size: int = 300, overlap: int = 50, **names) -> DataFrame:
    """Chunks by the splitter of a kind, in any case: token, char, sentence, structure, or one that was registered."""
    if kind.lower() not in SPLITTERS:
        raise ValueError(f"unknown splitter {kind!r}")
    return SPLITTERS[kind.lower()](docs, size, overlap, **names)


#: Words of a chunk, and of its overlap, by purpose: reports on communities, and expected answers.
PRESETS = {"report": (600, 0), "golden": (1024, 0)}


def chunk_preset(docs: DataFrame, purpose: str, **names) -> DataFrame:
    """Chunks of words of a size by purpose (see `PRESETS`)."""
    return chunk_tokens(docs, *PRESETS[purpose], **names)


def first_words(c: Column, n: int) -> Column:
    """The first n words of a text, joined by spaces; all of a shorter one."""
    return F.array_join(F.slice(words(c), 1, n), " ")


#: Splitters by kind: functions (docs, size, overlap, **names) -> chunks.
SPLITTERS: dict[str, Callable[..., DataFrame]] = {
    "token": chunk_tokens,
    "char": chunk_chars,
    "sentence": chunk_recursively,
    "structure": lambda d, s, o, **n: chunk_recursively(d, s, o, STRUCTURE_SEPARATORS, **n),
}


def register_splitter(kind: str, splitter: Callable[..., DataFrame]) -> None:
    """Adds a splitter under a kind, which is matched in any case; a kind that is taken is replaced."""
    SPLITTERS[kind.lower()] = splitter


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence)."""
    return docs.select(key, F.posexplode(F.split(text, r"(?<=[.?!])\s+")).alias("pos", "sentence")).where("sentence <> ''")


def semantic_chunks(docs: DataFrame, embed, percentile: float = 0.95, buffer: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_id, chunk): sentences grouped between breaks, where the cosine distance of neighbours is above a percentile.

    embed: what `providers.column` makes of an embedder of unit vectors; a sentence is embedded with `buffer` neighbours.
    Each row is a document by itself. Its sentences stay in it as arrays, so nothing is shuffled.
    """
    s = docs.select(key, F.filter(F.split(text, r"(?<=[.?!])\s+"), lambda x: x != "").alias("s"))
    first = lambda i: F.greatest(i - buffer, F.lit(0))
    near = F.transform("s", lambda _, i: F.concat_ws(" ", F.slice("s", first(i) + 1, i + buffer + 1 - first(i))))
    s = s.withColumn("vec", embed.each(near))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    after = F.when(F.size("s") > 1, F.sequence(F.lit(1), F.size("s") - 1)).otherwise(F.array().cast("array<int>"))
    # equal distances stay equal in any order of sums
    s = s.select(key, "s", F.transform(after, lambda i: F.struct(i.alias("at"), F.round(1 - dot(F.get("vec", i - 1), F.get("vec", i)), 9).alias("distance"))).alias("d"))
    s = s.withColumn("sorted", F.array_sort(F.filter(F.col("d.distance"), lambda x: x.isNotNull())))
    place = (F.size("sorted") - 1) * F.lit(percentile)
    low, high = F.get("sorted", F.floor(place).cast("int")), F.get("sorted", F.ceil(place).cast("int"))
    limit = F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)  # as F.percentile does
    s = s.withColumn("limit", limit)
    s = s.select(key, "s", F.concat(F.array(F.lit(0)), F.transform(F.filter("d", lambda x: x["distance"] > F.col("limit")), lambda x: x["at"])).alias("starts"))
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("s"))
    parts = F.transform("starts", lambda at, i: F.array_join(F.slice("s", at + 1, end(i) - at), " "))
    return s.select(key, F.posexplode(F.when(F.size("s") > 0, parts)).alias("chunk_id", "chunk")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


#: Texts whose chunks a worker holds at once.
TEXTS = 100

#: A line that is a headline: marked as one, or short and without a sign that ends or divides a sentence.
HEADLINE = r"^#{1,6}\s|^[^.!?:;,]{1,60}$"


def headlines(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 500) -> DataFrame:
    """(key, section, headline, body, too_long): sections under headlines, which are '#' lines or short lines without an end mark."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = F.col("line").rlike(HEADLINE) & (trim_white(F.col("line")) != "")
    w = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy(key, "section").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("headline"), body.alias("body"))
    return out.withColumn("too_long", F.size(words(F.col("body"))) > most)


def pack_sections(text: str, least: int = 100, most: int = 500) -> list[tuple[str | None, str, int]]:
    """(headline, chunk, words) of a text: its sections packed in order, so that all but the last have least to most words.

    A section begins with its headline. A chunk takes sections until it has `least` words; one that would then be above
    `most` is cut there, and its rest goes on. A last chunk that is short joins the one before, if both fit. The headline
    is that of the section the chunk begins in, null before the first.
    """
    out: list[tuple[str | None, list[str]]] = []
    head, held, named = None, [], None

    def close() -> None:
        if held:
            out.append((named, held[:]))
            held.clear()

    section: list[str] = []
    sections: list[tuple[str | None, list[str]]] = []
    for line in (text or "").split("\n"):
        if line.strip() and re.match(HEADLINE, line):
            sections.append((head, section))
            head, section = line.strip(), []
        section += [w for w in re.split(r"[ \t\n\x0B\f\r]+", line) if w]
    for head, section in [*sections, (head, section)]:
        at = 0
        while at < len(section):
            if not held:
                named = head
            took = section[at : at + most - len(held)]
            held += took
            at += len(took)
            if len(held) == most:
                close()
        if len(held) >= least:
            close()
    close()
    if len(out) > 1 and len(out[-1][1]) < least and len(out[-2][1]) + len(out[-1][1]) <= most:
        out[-2:] = [(out[-2][0], out[-2][1] + out[-1][1])]
    return [(h, " ".join(w), len(w)) for h, w in out]


def chunk_by_headlines(docs: DataFrame, least: int = 100, most: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_id, headline, chunk, tokens) by `pack_sections`, in Arrow batches; a few texts' chunks at a time leave a worker."""
    if not 0 < least <= most:
        raise ValueError(f"least {least} must be positive and not above most {most}")
    ship(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).alias("_text"))

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                found = [(i, j, *p) for i, t in enumerate(part.column("_text")) for j, p in enumerate(pack_sections(t.as_py(), least, most))]
                row, place, head, said, n = zip(*found) if found else ((),) * 5
                columns = [pa.array(place, pa.int32()), pa.array(head, pa.string()), pa.array(said, pa.string()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *columns], names=[key, "chunk_id", "headline", "chunk", "tokens"])

    return rows.mapInArrow(packs, f"`{key}` {rows.dtypes[0][1]}, chunk_id int, headline string, chunk string, tokens int")


def term_weights(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = r"[a-z\x{df}-\x{ff}]{4,}") -> DataFrame:
    """(key, term, tf, df, weight): tf * ln((1 + docs) / (1 + df)) of each term of each row, rounded to six digits.

    Terms are matches in lower case. Each row is a document; a null or empty text has no terms. Document frequencies are
    summed from the rows' own counts and joined back by term.
    """
    total = docs.count()
    own = cut(docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))
    df = cut(own.groupBy("term").agg(F.count("*").alias("df")))  # of a known size, so that a small vocabulary moves and not all counts
    return own.join(df, "term").select(key, "term", "tf", "df", F.round(F.col("tf") * F.log(F.lit(1.0 + total) / (1.0 + F.col("df"))), 6).alias("weight"))


def keyphrases(docs: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rank, term, weight, df): the k terms of the largest weights; ties go to the first term."""
    ranked = term_weights(docs, key, text).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term")))
    return ranked.where(F.col("rank") <= k).select(key, "rank", "term", "weight", "df")


def split_pieces(text: str | None, kind: str, size: int, overlap: int) -> list[str]:
    """The pieces of one text by a splitter's kind, as the splitters of whole tables give them."""
    _check(size, overlap)
    if not text:
        return []
    if kind == "token":
        w = [x for x in re.split(r"[ \t\n\x0B\f\r]+", text) if x]
        return [" ".join(w[s : s + size]) for s in range(0, max(len(w) - overlap - 1, 0) + 1, size - overlap)] if w else []
    if kind in ("sentence", "structure"):
        return split_recursively(text, size, overlap, SENTENCE_SEPARATORS if kind == "sentence" else STRUCTURE_SEPARATORS)
    if kind == "headline":
        return [c for _, c, _ in pack_sections(text, max(1, overlap), size)]
    raise ValueError(f"unknown splitter {kind!r}")


def register_split_function(spark, name: str = "split_text", pieces: Callable[[str | None, str, int, int], list[str]] = split_pieces) -> None:
    """Makes a splitter a table function of SQL: lateral split_text(text, kind, size, overlap) as (chunk_id, chunk)."""
    ship(spark)

    @F.udtf(returnType="chunk_id: int, chunk: string")
    class Split:
        def eval(self, text: str, kind: str, size: int, overlap: int):
            yield from enumerate(pieces(text, kind.lower(), size, overlap))

    spark.udtf.register(name, Split)
