from __future__ import annotations

import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa

from tickloom.llm import chats, toxicity, warc
from tickloom.session import scratch_path

TURNS = "conv_id long, turn long, role string, text string"


def brute_collapse(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or "", role, text))
    seqs = {c: tuple((r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])) for c, v in convs.items()}
    stay = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        if c == min(k for k, o in seqs.items() if o == s):
            stay[c] = (len(s), sum(o == s for o in seqs.values()))
    return stay


def test_snapshots_collapse_into_the_longest(spark):
    rng = random.Random(4)
    rows = []
    for base in range(40):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", None, "", f"t{rng.randint(0, 5)}"])) for _ in range(rng.randint(1, 9))]
        for k in range(rng.randint(1, 4)):
            upto = rng.randint(1, len(turns))
            start = rng.randint(0, 5000)
            rows += [(base * 10 + k, start + 3 * i, *turn) for i, turn in enumerate(turns[:upto])]
    rows += [(None, 0, "user", "x"), (999, None, "user", "only"), (998, 5, "user", "twice"), (998, 5, "user", "twice")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as place", "2 as conv")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chats.collapsed_chats(df).collect()}
    assert got == brute_collapse(rows)
    assert chats.collapsed_chats(df.limit(0)).count() == 0


def test_rendering_keeps_order_and_breaks_markers(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a <|im_end|>"), (1, 2, None, None)]
    text = chats.collapsed_chats(spark.createDataFrame(rows, TURNS)).first().rendered
    assert text == "<|im_start|>user\na <|im_end| ><|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"


def test_long_conversations_are_rendered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chats, "BLOCK", 7)
    rng = random.Random(9)
    rows = [(conv, i, rng.choice(["user", None]), "é" * rng.choice([0, 3, 40, 900])) for conv, n in ((1, 60), (2, 1), (3, 25)) for i in range(n)]
    frame = spark.createDataFrame(rows, TURNS)
    whole = {r.conv_id: r.rendered for r in chats.collapsed_chats(frame).collect()}
    assert len(whole) == 3 and sum(map(len, whole.values())) > 10_000
    parts = chats.collapsed_chats(frame, part_bytes=500).collect()
    joined = {conv: "".join(r.rendered for r in sorted(parts, key=lambda r: r.part) if r.conv_id == conv) for conv in whole}
    assert joined == whole
    turn = max(len(t) for text in whole.values() for t in text.encode().split(b"<|im_start|>")) + len("<|im_start|>")
    assert len(parts) > 20 and max(len(r.rendered.encode()) for r in parts) <= 500 + turn
    assert {r.part for r in parts if r.conv_id == 2} == {0}


def test_pages_come_back_from_the_archives(spark):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "http://a.example/", big), (2, "http://b.example/", big), (3, None, big), (4, "http://c.example/x y\r\n", other), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "", "WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as size")
    got = {r.page_id: r for r in warc.page_archive(pages, scratch_path(spark, "archives")).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest, got[page].problem) == (len(body), hashlib.sha1(body).hexdigest(), None)
        revisit = page in (1, 2)
        assert (got[page].record_type, got[page].refers_to) == (("revisit", 3) if revisit else ("response", None))
    assert warc.page_archive(pages.limit(0), scratch_path(spark, "archives")).count() == 0


def test_assembly_nests_requests_and_metadata(spark):
    row = lambda kind, own, to=(), **more: {"record_type": kind, "record_id": own, "concurrent_to": list(to), **more}
    rows = [row("response", "a"), row("request", "q", ["a"]), row("metadata", "m", ["q"]), row("response", "b", ["r"]), row("request", "r"), row("request", "lost", ["nowhere"]), row("request", "q", ["a"])]
    schema = warc._RECORD
    frame = spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in rows], schema)
    got = {r.answer and r.answer.record_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble(frame).collect()}
    assert got == {"a": (["q"], ["m"]), "b": (["r"], []), None: (["lost"], [])}


def test_reader_takes_members_plain_files_and_says_what_is_broken():
    def record(block, kind="resource"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{len(block)}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [record(b"x" * n) for n in (3, 0, 100_000)]
    for content in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
        assert [r["payload_bytes"] for r in warc.parse_records(content)] == [3, 0, 100_000]
    cut = gzip.compress(records[0]) + gzip.compress(records[2])[:60]
    assert [r.get("problem") for r in warc.parse_records(cut)][-1] in ("truncated", "no record header")
    assert [r["problem"] for r in warc.parse_records(b"nothing of the kind")] == ["no record header"]
    assert list(warc.parse_records(b"")) == []


def simple_record(block, length=None, name=True, kind="resource", to=()):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *[f"WARC-Concurrent-To: {t}" for t in to]]
    lines += [f"WARC-Record-ID: <urn:x:{len(block)}>"] if name else []
    return "\r\n".join([*lines, f"Content-Length: {len(block) if length is None else length}", "", ""]).encode() + block + b"\r\n\r\n"


def sizes_and_problems(content):
    return [(r.get("payload_bytes"), r["problem"]) for r in warc.parse_records(content)]


def test_reader_goes_on_behind_a_broken_member():
    rng = random.Random(3)
    blocks = [rng.randbytes(n) for n in (10, 90_000, 20, 200_000, 30, 5, 40)]
    members = [gzip.compress(simple_record(b)) for b in blocks]
    for broken in range(len(blocks)):
        for damage in (lambda m: m[:-20] + b"\0" * 12 + m[-8:], lambda m: m[: len(m) // 2], lambda m: b"\x1f\x8b\x08" + b"\xff" * (len(m) - 3)):
            parts = [damage(m) if i == broken else m for i, m in enumerate(members)]
            found = sizes_and_problems(b"".join(parts))
            sound = [size for size, problem in found if problem is None]
            assert sound == [len(b) for i, b in enumerate(blocks) if i != broken], broken
            assert len(found) > len(sound)
    assert sizes_and_problems(b"??" + b"".join(members)[2:])[1:] == [(len(b), None) for b in blocks[1:]]
    assert sizes_and_problems(b"".join(members) + b"\0" * 512) == [(len(b), None) for b in blocks]


def test_reader_goes_on_behind_wrong_lengths_and_stray_bytes():
    a, b, c = (simple_record(b"a" * 100), simple_record(b"b" * 200), simple_record(b"c" * 300))
    sound = [(100, None), (200, None), (300, None)]
    for pack in (bytes, gzip.compress):
        assert sizes_and_problems(pack(a + b + c)) == sound
        assert sizes_and_problems(pack(a + b"stray\r\n" + b + c)) == [sound[0], (None, "no record header"), *sound[1:]]
        assert sizes_and_problems(pack(a + simple_record(b"x" * 50, 20) + c)) == [sound[0], (20, "length differs"), sound[2]]
        assert sizes_and_problems(pack(a + simple_record(b"x" * 50, 220) + b + c)) == [sound[0], (220, "length differs"), *sound[1:]]
        assert sizes_and_problems(pack(simple_record(b"x" * 50, 10**9) + a + b + c))[1:] == sound
        for taken in range(1, 20):
            assert sizes_and_problems(pack(a + simple_record(b"x" * 50, 50 + 4 + taken) + b + c)) == [sound[0], (54 + taken, "length differs"), *sound[1:]]
        assert sizes_and_problems(pack(a + simple_record(b"x", "x1") + b + c)) == [sound[0], (None, "no record header"), *sound[1:]]
        assert sizes_and_problems(pack(a + b"j" * 3_000_000 + b"\r\n" + b + c)) == [sound[0], (None, "no record header"), *sound[1:]]


def test_records_without_an_id_and_chains_of_any_length_are_assembled(spark, tmp_path):
    chain = [("response", "r", []), *[("metadata", f"m{i}", ["r" if i == 0 else f"m{i - 1}"]) for i in range(5)], ("request", "x", ["y"]), ("metadata", "y", ["x"])]
    schema = warc._RECORD
    rows = [{"record_type": kind, "record_id": own, "concurrent_to": to} for kind, own, to in chain]
    frame = spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in rows], schema)
    got = {r.answer and r.answer.record_id: sorted(x.record_id for x in r.metadata) for r in warc.assemble(frame).collect() if r.answer}
    assert got == {"r": [f"m{i}" for i in range(5)]}
    assert warc.assemble(frame.limit(0)).count() == 0

    content = simple_record(b"answer", kind="response") + simple_record(b"q", name=False, kind="request", to=["<urn:x:6>"]) + b"stray\r\n" + simple_record(b"m", name=False, kind="metadata", to=["<urn:x:6>"])
    (tmp_path / "foreign.warc").write_bytes(content)
    read = warc.read_archives(spark, f"file:{tmp_path}")
    (whole,) = warc.assemble(read).collect()
    assert (whole.answer.record_id, len(whole.requests), len(whole.metadata)) == ("<urn:x:6>", 1, 1)
    assert whole.requests[0].record_id.endswith("foreign.warc#1") and whole.metadata[0].record_id.endswith("foreign.warc#3")


def test_archives_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZE_CLASSES", ((1_000, 30), (10_000, 6), (None, 3)))
    rng = random.Random(1)
    sizes = [0, 10, 900, 5_000, 9_000, 200_000] * 20
    rows = [(i, f"http://h.example/{i}", rng.randbytes(n // 2).hex()) for i, n in enumerate(sizes)]
    pages = spark.createDataFrame([*rows, (None, "u", rows[-1][2]), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    folder = scratch_path(spark, "archives")
    got = warc.page_archive(pages, folder).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got if r.page_id is not None) == [(i, len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows]
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", len(rows) - 1)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    by_class = {}
    for r in files.selectExpr("regexp_extract(path, '/([0-9])/[^/]*$', 1) as class", "content").collect():
        by_class.setdefault(r[0], []).append(len(gzip.decompress(r.content)))
    assert max(by_class["0"]) < 11 * 3_000 and max(by_class["1"]) < 2 * 13_000 and max(by_class["2"]) < 205_000
    assert (len(by_class["0"]), len(by_class["1"]), len(by_class["2"])) == (7, 20, 21)


def test_archives_reach_the_reader_in_pieces(spark, monkeypatch, tmp_path):
    """Whole archives in Arrow and Python took an executor of 3 GB to its limit where pages do not compress."""
    monkeypatch.setattr(warc, "_PIECE", 1_000)
    rng = random.Random(6)
    written = {}
    for name, blocks in (("a", [400, 9_000, 30]), ("c", [700]), ("d", [60_000, 5]), ("e", [2_000] * 4)):
        content = b"".join(gzip.compress(simple_record(rng.randbytes(n))) for n in blocks)
        (tmp_path / f"{name}.warc.gz").write_bytes(content)
        written[name] = (blocks, content)
    (tmp_path / "plain.warc").write_bytes(plain := simple_record(b"p" * 5_000) + b"stray\r\n" + simple_record(b"q" * 7))
    written["plain"] = ([5_000, None, 7], plain)
    files = spark.read.format("binaryFile").load(f"file:{tmp_path}")
    got = {}
    for r in warc._pieces(files.coalesce(1)).collect():
        got.setdefault(r.path.rpartition("/")[2].partition(".")[0], []).append((r.piece, bytes(r.part)))
    for name, (_, content) in written.items():
        assert [piece for piece, _ in got[name]] == list(range(len(got[name])))
        assert b"".join(part for _, part in got[name]) == content
        assert max(len(part) for _, part in got[name]) <= max(1_000, len(content) // 16 + 1)
    found = {}
    for r in warc.read_archives(spark, f"file:{tmp_path}").coalesce(1).collect():
        found.setdefault(r.record_id.partition(":x:")[2].rstrip(">") if r.record_id else None, []).append((r.payload_bytes, r.problem))
    sizes = [n for blocks, _ in written.values() for n in blocks]
    assert {key: len(rows) for key, rows in found.items()} == {None if n is None else str(n): sizes.count(n) for n in sizes}
    assert all(rows == [(None, "no record header")] if key is None else set(rows) == {(int(key), None)} for key, rows in found.items())


def test_toxic_documents_are_found_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learned = labels.filter("doc_id % 4 <> 0")
    held = toxicity.toxicity(docs, learned).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    toxic, clean = [r.rejected for r in held if r.toxic], [r.rejected for r in held if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    count = 600
    first = rng.random(count) < 0.5
    second = first ^ (rng.random(count) < 0.02)
    owner = np.repeat(np.arange(count), 2)
    feature = np.column_stack([np.where(first, 1, 2), np.arange(count) + 10]).ravel().astype(np.uint64)
    models = toxicity.fit_chain(owner, feature, np.arange(count), np.column_stack([first, second]).astype(float))
    assert [len(m.earlier) for m in models] == [0, 1] and models[1].earlier[0] > 0
    found = toxicity.apply_chain(models, owner, feature, count)
    assert ((found[:, 0] > 0.5) == first).all() and ((found[:, 1] > 0.5) == second).mean() > 0.95


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.p_toxic, r.rejected) for r in toxicity.toxicity(docs, labels).collect()] == [(None, False)] * 2
    some = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (1, None, 0)], labels.schema)
    assert toxicity.toxicity(docs, some).count() == 2
    assert toxicity.toxicity(docs.limit(0), some).count() == 0


def test_toxic_documents_of_every_language_are_found_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = {}
    for fold in range(4):
        judged = toxicity.toxicity(docs, labels.filter(f"doc_id % 4 <> {fold}"))
        held = judged.join(labels.filter(f"doc_id % 4 = {fold}"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
        for r in held.select("lang", "toxic", "rejected").collect():
            found.setdefault((r.lang, r.toxic), []).append(r.rejected)
    print({key: (sum(rejected), len(rejected)) for key, rejected in sorted(found.items())})
    for lang, recall in (("de", 0.95), ("en", 0.93), ("es", 0.9), ("fr", 0.95)):
        assert np.mean(found[lang, 1]) >= recall and np.mean(found[lang, 0]) < 0.01, lang


def test_a_sign_before_ever_other_endings_is_learned(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("aeiostrné") for _ in range(n))
    rows = []
    for key in range(400):
        text = [word(rng.randint(4, 9)) for _ in range(rng.randint(20, 200))]
        signs = 1 + len(text) // 30 if key % 4 == 0 else 0
        rows.append((key, " ".join([*text, *("Réeux" + word(5) for _ in range(signs))]), int(key % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in rows if k % 8 > 3], "doc_id long, quality int, toxic int")
    rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("rejected").collect()}
    assert rejected == {k for k, _, t in rows if t}


def test_the_sample_bounds_rows_not_labels(spark, monkeypatch):
    rows = [(i % 2, f"text number {i} of many") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as number", "2 as features", "3 as p_toxic")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda owner, feature, keys, truth, values: seen.append(sorted(keys.tolist())) or [])
    toxicity.train_chain(docs, toxicity.labelled(labels), toxicity.CATEGORIES, max_sample=3)
    assert seen == [[0, 1]]
