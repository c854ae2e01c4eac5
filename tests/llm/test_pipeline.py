from __future__ import annotations

import re

import corpus_pipeline
from test_duplicates import brute, members

from tickloom.llm import chunks

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns_and_act_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(COLUMNS)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == COLUMNS, name
        rows = docs.collect()
        assert 0 < len(rows) <= before
        before, docs = len(rows), spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.packed(spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == before


def test_stages_take_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "same words here again and again", None, None, None), (3, "same words here again and again", "x", "y", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = {r.doc_id for r in stage(spark, docs, SMALL).collect()}
        assert {None, 1, 2} <= kept
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert corpus_pipeline.packed(spark, docs, SMALL).count() == 5


def plain_chunks(text):
    """(first word, words) of each chunk, cut byte by byte with the gear hash."""
    hashes, at = [], []
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    value = 0
    for byte in (text or "").encode():
        value = ((value << 1) + int(chunks._GEAR[byte])) & 0xFFFFFFFF
        hashes.append(value)
    ends = [hashes[m.end() - 1] for m in found]
    last = [h < chunks._FIRST or i == len(ends) - 1 for i, h in enumerate(ends)]

    def pieces():
        begin = 0
        for i, stop in enumerate(last):
            if stop:
                yield begin, i + 1
                begin = i + 1

    for begin, end in list(pieces()):
        if end - begin > chunks._STRETCH:
            for i in range(begin, end):
                last[i] |= ends[i] < chunks._SECOND
    for begin, end in list(pieces()):
        if end - begin > chunks._LONGEST:
            for i in range(begin, end):
                last[i] |= (i - begin) % chunks._LONGEST == chunks._LONGEST - 1
    return [(begin, tuple(m[0] for m in found[begin:end])) for begin, end in pieces()]


def plain_removed(rows):
    """Runs of words that go from each text: ``{key: [(first, end), ...]}``."""
    cut = {key: plain_chunks(text) for key, text in rows}
    holders = {}
    for key, pieces in cut.items():
        for _, piece in pieces:
            holders.setdefault(piece, set()).add(key)
    removed = {}
    for key, pieces in cut.items():
        seen, runs = set(), []
        for begin, piece in pieces:
            if piece in seen or min(holders[piece]) != key:
                if runs and runs[-1][1] == begin:
                    runs[-1][1] += len(piece)
                else:
                    runs.append([begin, begin + len(piece)])
            seen.add(piece)
        removed[key] = [(a, b) for a, b in runs if b - a >= chunks.MIN_WORDS]
    return removed


def test_substring_dedup_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(-1, None), (-2, ""), (-3, " \n "), (-4, "word " * 900), (10**6, "word " * 900), (10**6 + 1, rows[3][1] + "\nmore " + rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_removed(rows)
    got = {r.doc_id: [(run["first"], run["end"]) for run in r.removed] for r in chunks.repeated_passages(frame).collect()}
    assert got == want and sum(map(len, want.values())) > 20
    left = {r.doc_id: r.text for r in chunks.without_repeats(frame.selectExpr("*", "1 as __runs", "2 as __row", "3 as __own", "4 as __key")).collect()}
    for key, text in rows:
        words = (text or "").encode().split()
        gone = {i for a, b in want[key] for i in range(a, b)}
        assert (left[key] or "").encode().split() == [w for i, w in enumerate(words) if i not in gone]
        assert gone or left[key] == text


def test_stages_keep_what_a_plain_version_keeps(spark):
    """Kept ids of the near-duplicate and decontamination stages, and of clean documents in the toxicity stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(COLUMNS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {key for key, (_, _, stays) in brute(rows, 5, 80).items() if stays}
    items = [members(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = {key for key, text in rows if any(item and len(item & members(text)) >= 0.8 * len(item) for item in items)}
    kept = {r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, SMALL).collect()}
    assert kept == {key for key, _ in rows} - dirty and dirty
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    kept = {r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, SMALL).collect()}
    clean = {r.doc_id for r in labels if not r.toxic} & {key for key, _ in rows}
    assert len(clean - kept) <= 0.02 * len(clean)
