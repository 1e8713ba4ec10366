"""Source divergence audit: how far each source's words lie from every other source's of its language, in exact integers.

Terms are counted in the tasks that read the texts, and summed by (lang, source, term). A kept term's counts by source
are its profile. From the profiles tasks tally, for each pair of sources, how many terms have which (count, count) in
them. Cells with a zero are not counted one by one: they follow from the single sources' histograms of counts and from
the pairs' tallies, by adding and taking off multiplicities. The divergence is then evaluated once for each cell.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut

#: A term, in lower-cased UTF-8: letters a to z and all bytes of characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of its language that a kept term is in, at least.
LEAST_DOCS = 10
#: Ranks of the terms reported for a group.
TOP = 10
#: Distinct counters that a counting task holds, bytes of text it takes apart at once, and pairs that a tallying task sorts at once.
HELD, PIECE, PAIRS = 400_000, 1 << 20, 2_000_000
#: A probability of one is this many units.
UNITS = 1_000_000_000


def pieces(text: bytes) -> Iterator[bytes]:
    """text in lower case, in pieces of about PIECE bytes that end where a term can't go on."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        rest = TERM.match(text[end : end + PIECE].lower())
        while rest and rest.end() == PIECE and end + PIECE < len(text):  # one term longer than a piece
            end += PIECE
            rest = TERM.match(text[end : end + PIECE].lower())
        end += rest.end() if rest else 0
        yield text[at:end].lower()
        at = end
    yield text[at:].lower()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of documents by (lang, source, term), summed in the task; emptied when it holds too many."""
    tally: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in tally.items():
            if n:
                arrays = [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
        tally.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, docs = tally.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in pieces(text):
                terms = TERM.findall(piece)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in tally.values()) > HELD:
            yield from emptied()
    yield from emptied()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often a term occurs in a group's texts, and in how many of them; nulls are ''."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    parts = given.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def profiles(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, profile): the kept terms' counts, in all and by source, sources in UTF-8 order.

    A profile has at most as many entries as the language has sources.
    """
    by_source = F.array_sort(F.collect_list(F.struct("source", "n")))
    rows = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), by_source.alias("profile"))
    return rows.where(F.col("docs") >= least).drop("docs")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, x, y, m): m terms of the batches occur x times in source a and y times in source b, both above 0."""

    def tallied(table: pa.Table) -> Iterator[pa.RecordBatch]:
        profile = table.column("profile").combine_chunks()
        ends = np.cumsum(profile.value_lengths().to_numpy(zero_copy_only=False))
        flat = profile.flatten()
        source, lang = flat.field("source").dictionary_encode(), table.column("lang").combine_chunks().dictionary_encode()
        names, langs = source.dictionary, lang.dictionary
        code = source.indices.to_numpy().astype(np.int64)
        values, count = np.unique(flat.field("n").to_numpy(), return_inverse=True)
        row = np.searchsorted(ends, np.arange(len(code)), "right")
        group = lang.indices.to_numpy().astype(np.int64)[row] * len(names) + code
        partners = ends[row] - np.arange(len(code)) - 1  # the entries after this one in its profile
        sums = np.cumsum(partners)
        i = 0
        while i < len(code):
            j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + PAIRS, "right")))
            first = np.repeat(np.arange(i, j), partners[i:j])
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(partners[i:j]) - partners[i:j], partners[i:j])
            i = j
            if not len(first):
                continue
            pairs, pair = np.unique(group[first] * len(names) + code[second], return_inverse=True)
            wide = len(values) ** 2
            cells, m = np.unique(pair * wide + count[first] * len(values) + count[second], return_counts=True)
            met, cell = pairs[cells // wide], cells % wide
            where, b = np.divmod(met, len(names))
            where, a = np.divmod(where, len(names))
            arrays = [langs.take(pa.array(where)), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(values[cell // len(values)]), pa.array(values[cell % len(values)]), pa.array(m.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([x.cast(pa.string()) if k < 3 else x for k, x in enumerate(arrays)], ["lang", "a", "b", "x", "y", "m"])

    held, entries = [], 0
    for batch in batches:
        held.append(batch)
        entries += len(batch.column("profile").flatten())
        if entries > PAIRS // 8:
            yield from tallied(pa.Table.from_batches(held))
            held, entries = [], 0
    if entries:
        yield from tallied(pa.Table.from_batches(held))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNITS * (count + 2) / (total + 2 * kept)), by columns' names, exactly."""
    return F.expr(f"1 + (cast({UNITS} as decimal(10, 0)) * ({count} + 2)) div nullif({total} + 2 * {kept}, 0)")


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most UNITS + 1, so the square fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def joint_histograms(terms: DataFrame, entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m): for each pair of sources every different (count, count) of the kept terms, zeros included, and how many terms have it.

    pairs: (lang, a, b, kept), each pair of sources once.
    """
    met = terms.select("lang", "profile").mapInArrow(_tally, "lang string, a string, b string, x long, y long, m long")
    met = met.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))
    cell = lambda x, y, m: F.struct(x.alias("x"), y.alias("y"), m.alias("m"))
    x, y, n, m, zero = F.col("x"), F.col("y"), F.col("n"), F.col("m"), F.lit(0).cast("long")
    # terms that both sources have are in the single sources' histograms too: taken off there, and added to (0, 0), where both took them off
    found = met.select("lang", "a", "b", F.explode(F.array(cell(x, y, m), cell(x, zero, -m), cell(zero, y, -m), cell(zero, zero, m))).alias("c"))
    single = entries.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    keys = pairs.select("lang", "a", "b")
    left = keys.join(single.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.explode(F.array(cell(n, zero, m), cell(zero, zero, -m))).alias("c"))
    right = keys.join(single.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.explode(F.array(cell(zero, n, m), cell(zero, zero, -m))).alias("c"))
    rest = pairs.where("kept > 0").select("lang", "a", "b", cell(zero, zero, F.col("kept")).alias("c"))
    cells = found.unionByName(left).unionByName(right).unionByName(rest)
    return cells.groupBy("lang", "a", "b", F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("c.m").alias("m")).where("m <> 0")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source); more columns don't matter.

    Part pair has, for each group, every other source of its lang by divergence; part term the `top` terms that the
    group uses more than its lang as a whole. Null texts, langs and sources are ''. A lang without kept terms has pairs
    of value 0; texts without terms count as documents of their group only. Repeated rows count again. Ties go to the
    item that is first in UTF-8; no rows give no rows.
    """
    terms = cut(profiles(term_counts(docs), least))
    entries = terms.select("lang", "term", "total", F.explode("profile").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = lambda *names: {c: F.coalesce(c, F.lit(0).cast("long")) for c in names}
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = cut(there.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").withColumns(zero("kept", "lang_size", "size")))

    one, two = (groups.select("lang", F.col("source").alias(c), F.col("size").alias(f"size_{c}"), *kept) for c, kept in (("a", ["kept"]), ("b", [])))
    pairs = one.join(two, "lang").where("a < b")
    cells = joint_histograms(terms, entries, pairs).join(pairs, ["lang", "a", "b"])
    valued = cells.withColumns({"p": share("x", "size_a", "kept"), "q": share("y", "size_b", "kept")}).withColumn("f", apart("p", "q") * F.col("m"))
    summed = valued.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    summed = pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").withColumns(zero("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = summed.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    over = entries.join(groups, ["lang", "source"]).withColumns({"p": share("n", "size", "kept"), "q": share("total", "lang_size", "kept")}).where("p > q")
    term = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))
