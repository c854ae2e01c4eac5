from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tickloom.llm import packing, scan, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"abcé1 2 \n\t\r '!s.,<|>", "  ", "'ll", "<|endoftext|>", "\xa0", " ", "\x1c", "\x85", "　", "漢", "😀", "​", "ß", "\x00", "́", "”"]


def weird_texts(count: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(count)]


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_words_and_shingles_equal_plain_python():
    texts = [*weird_texts(500), None, "", "one", "two words", "a a a a a a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    counts, sizes = [], []
    for part in scan.slices(batch, "text", 400):
        found = scan.words(scan.LOWERED[part.bytes], part.offsets)
        counts += found.counts.tolist()
        sizes += [len(s) for s in scan.shingle_sets(found, 3)]
    plain = [(t or "").encode().lower().split() for t in texts]
    assert counts == [len(w) for w in plain]
    assert sizes == [len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) > 2 else min(1, len(w)) for w in plain]


def test_hash_of_a_word_does_not_depend_on_its_place():
    data = np.frombuffer(b"xx alpha alpha  beta", np.uint8)
    hashes = scan.words(data, np.array([0, 9, len(data)])).hashes.tolist()
    assert hashes[1] == hashes[2] and len(set(hashes)) == 3


def test_tokens_equal_the_library_on_odd_texts():
    texts = weird_texts(5000)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    own, counts, ids = tokens.Encoder(PATH), [], []
    for part in scan.slices(batch, "text", 3000):
        found = own.tokens(part)
        counts += found.counts.tolist()
        ids += found.ids().tolist()
    want = library_ids(texts)
    assert counts == [len(x) for x in want]
    assert ids == [i for x in want for i in x]


def test_token_counts_of_nulls_repeats_and_long_texts(spark):
    long = "word, " * 200_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.token_counts(df, PATH).collect()), key=str)
    n = len(library_ids([long])[0])
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False), (None, len(long), n, True)], key=str)
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


def test_sentencepiece_and_other_patterns_get_whole_texts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello there, world.", "a  b", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for file, want in ((path, [len(x) for x in model.encode(texts)]),):
        assert [r.n_tokens for r in tokens.token_counts(df, file).orderBy("doc_id").collect()] == want
    other = public_tokenizers.path("word_bpe_49k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(other).encode_batch(texts, add_special_tokens=False)]
    assert [r.n_tokens for r in tokens.token_counts(df, other).orderBy("doc_id").collect()] == want


def test_cuts_keep_full_pieces_after_the_first():
    assert list(packing.cuts(1)) == [(0, 1)]
    assert list(packing.cuts(2048)) == [(0, 2048)]
    assert list(packing.cuts(5000)) == [(0, 904), (904, 2952), (2952, 5000)]


def test_packing_places_every_piece_without_gaps(spark):
    rng = random.Random(3)
    texts = [None, "", *[" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([3, 40, 700, 5000]))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("text", "text")
    rows = packing.pack(df.selectExpr("*", "'x' as piece"), PATH, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    want = library_ids([t or "" for t in texts])
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
        assert ids == [*want[doc], 0]
        assert all(r.length == 2048 for r in pieces[1:])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    free: list[int] = []
    for length in sorted((r.length for r in rows), reverse=True):
        fits = [i for i, space in enumerate(free) if space >= length]
        if fits:
            free[min(fits, key=free.__getitem__)] -= length
        else:
            free.append(2048 - length)
    assert len(by_doc) == len(texts) and len(by_sequence) <= len(free) * 1.02 + 1


def test_best_fit_closes_the_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 8, 7)] == [(0, 0), (1, 0), (2, 0)]
    # The bin with two places left was closed; three and four are left in the others.
    assert bins.place(2) == (2, 7)
    assert bins.place(4) == (0, 6)


def test_tokens_of_texts_that_simple_hashes_take_for_equal():
    from test_duplicates import same_hash_modulo_powers_of_two

    texts = [t for n in (1024, 4096) for t in same_hash_modulo_powers_of_two(n)]
    texts += [t.translate(str.maketrans("ab", "01")) for t in texts]
    own, ids = tokens.Encoder(PATH), []
    for _ in range(2):
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
        found = [own.tokens(part) for part in scan.slices(batch, "text")]
        ids.append([i for f in found for i in f.ids().tolist()])
    want = [i for x in library_ids(texts) for i in x]
    assert ids == [want, want]


def test_repeated_rows_are_spread_over_tasks_when_packed(spark):
    """A third of the rows have no id and no text."""
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 3 = 0, 1, 1 + id % 50) as length")
    packed = packing.best_fit(rows.selectExpr("doc_id", "0 as piece", "length", "1 as number"), pieces_per_task=8000)
    sizes = [r["count"] for r in packed.groupBy(packed.sequence_id.bitwiseAND(-(1 << 40)).alias("task")).count().collect()]
    assert packed.columns == ["doc_id", "piece", "length", "number", "sequence_id", "offset"]
    assert sum(sizes) == 60_000 and len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
