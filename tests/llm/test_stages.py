"""Each stage of the pipeline over the whole of what the one before it kept, against plain Python or SQL."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from lattica.llm import toxicity
from lattica.llm.lines import LINES_SQL
from lattica.llm.mixing import mix_documents

from test_near import closure

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_like_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    import pandas as pd
    from tiktoken.load import load_tiktoken_bpe

    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # copies in part and whole, rows without an id and without a text, and lines that several documents share
    held = docs.toPandas()
    more = held.iloc[::7].copy()
    more["doc_id"] += 100_000
    shared = held.iloc[::11].copy()
    shared["doc_id"] += 200_000
    shared["text"] = ["passage one of all\npassage two of all\n" + t for t in shared["text"]]
    odd = pd.DataFrame([(None, held["text"][3], "en", None, 0), (None, "by itself", "en", "new", 9), (300_000, None, None, None, None), (300_001, "", "en", "new", 0)], columns=held.columns)
    given = [tuple(None if pd.isna(v) else v for v in r) for r in pd.concat([held, more, shared, odd]).itertuples(index=False)]
    given = [(None if r[0] is None else int(r[0]), *r[1:4], None if r[4] is None else int(r[4])) for r in given]
    docs = spark.createDataFrame(given, docs.schema)

    def stage(name, before):
        steps[name](spark, before, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        return after, [tuple(r) for r in after.collect()]

    def same(a, b):
        assert Counter(map(str, a)) == Counter(map(str, b))

    # toxicity: the rows whose own score is below the threshold
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean, rows = stage("toxicity", docs)
    want = [r for r in given if model.score(r[1]) < toxicity.THRESHOLD]
    same(rows, want)
    assert 0 < len(given) - len(want) < len(given) / 2

    # line dedup: the SQL's digests, of the rows with an id
    lined, after = stage("line dedup", clean)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    # a null id is larger than all others, and of two the text with the smaller hash; here their lines meet other rows' only
    ids = {r[1]: 900_000 + i for i, r in enumerate(r for r in rows if r[0] is None)}
    con.executemany("insert into documents values (?, ?)", [(ids[r[1]] if r[0] is None else r[0], r[1]) for r in rows])
    digests = Counter((d, s) for d, _, _, s in con.execute(LINES_SQL).fetchall() if d not in ids.values())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r[0], digest(r[1])) for r in after if r[0] is not None) == digests
    none = Counter(s for d, _, _, s in con.execute(LINES_SQL).fetchall() if d in ids.values())
    assert Counter(digest(r[1]) for r in after if r[0] is None) == none
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in after)
    assert len(after) == len(rows) and sum(len(r[1] or "") for r in after) < sum(len(r[1] or "") for r in rows)

    # n-gram Jaccard join: of each component of exact links the row with the smallest id; the closure's least place is it
    unique, kept = stage("n-gram Jaccard join", lined)
    rows = sorted(after, key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    meet, places = Counter(), defaultdict(list)
    for i, shingles in enumerate(sets):
        for s in shingles:
            meet.update((i, j) for j in places[s])
            places[s].append(i)
    pairs = [(i, j) for (i, j), n in meet.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)]
    same(kept, [rows[i] for i, c in enumerate(closure(len(rows), pairs)) if i == c])
    assert pairs and len(kept) < len(rows)

    # mixing: each row's whole copies, then its first words up to the cut
    mixed, copies = stage("mixing", unique)
    want = Counter()
    text = {(r.doc_id, r.source, r.size): r.taken for r in mix_documents(unique).collect()}
    assert len(text) == len(kept)
    for r in kept:
        size = len(WORD.findall(r[1] or ""))
        taken = text[r[0], r[3], size]
        while taken > 0:
            some = min(size, taken)
            want[r[0], r[3], r[1] if some == size else r[1][: list(WORD.finditer(r[1]))[some - 1].end()]] += 1
            taken -= some
    assert Counter((r[0], r[3], r[1]) for r in copies) == want
    assert all(r[4] == len(r[1]) for r in copies)

    # byte-level BPE: ids as the library gives them for whole texts, and their bytes
    ranks = load_tiktoken_bpe(tokenizers.path(corpus_pipeline.RANKS))
    library = tiktoken.Encoding("whole", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in copies:
        ids = library.encode_ordinary(r[1])
        want[r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), digest(r[1])] += 1
    coded = corpus_pipeline.encode(spark, mixed, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded) == want
