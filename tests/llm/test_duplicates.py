from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from tickloom.llm import chunks, containment, minhash
from tickloom.llm.components import components

DOCUMENTS = "doc_id long, text string"


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    least = {d: d for d in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {d: (len(sets[d]), least[d], least[d] == d) for d in sets}


def varied_rows(seed=5):
    """Copies, near copies around a text with a large id, chains of drifting texts, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(60)]

    def changed(words, n):
        new = list(words)
        for i in rng.sample(range(len(new)), n):
            new[i] = word()
        return new

    rows += [(i, " ".join(changed(base, rng.randint(1, 4)))) for i in range(60)]
    rows.append((1000, " ".join(base)))
    step = [word() for _ in range(80)]
    for i in range(60, 90):
        rows.append((i, " ".join(step)))
        step = changed(step, rng.randint(1, 3))
    rows += [(100 + i, " ".join(base).upper()) for i in range(5)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "a b c"), (207, "a b c")]
    return rows


def test_components_equal_brute_force(spark):
    rows = varied_rows()
    df = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 as component_id", "'k' as key")
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=size, percent=percent).collect()}
        assert got == brute(rows, size, percent)


def test_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_null_keys_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (7, "A B c d")], DOCUMENTS)
    got = sorted(map(tuple, minhash.near_duplicates(df, size=3, percent=85).collect()), key=str)
    assert got == [(4, 2, 4, True), (4, 2, 4, True), (7, 2, 4, False), (None, 2, None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_pruning_bounds_follow_the_posterior():
    draws = np.random.default_rng(1).beta(1 + 10, 1 + 22, 200_000)
    assert (draws >= 0.5).mean() > 1e-2 and minhash.least_matches(32, 0.5, 1e-2) <= 10
    assert minhash.least_matches(32, 0.85, 1e-6) < 32 * 0.85
    assert minhash.bands_for(0.85) == 19


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(9, 9), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, **{i: 5 for i in range(200, 260)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def members(text):
    words = plain_words(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_containment_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    first = items.orderBy("item_id").first().text
    cut = " ".join(first.split()[: int(len(first.split()) * 0.9)])
    odd = [(-1, None), (-2, ""), (-3, "..."), (-4, "short text"), (-5, f"Before, {first.upper()} and after"), (-6, f"x {cut} y"), (-7, " ".join(first.split()[:10]))]
    docs = docs.union(spark.createDataFrame(odd, DOCUMENTS)).selectExpr("*", "1 as item", "2 as members")
    more = spark.createDataFrame([(9001, "Short  TEXT!"), (9002, None), (9003, "")], "item_id long, text string")
    items = items.select("item_id", "text").union(more)
    sets = {r.item_id: members(r.text) for r in items.collect()}
    want = set()
    for doc in docs.collect():
        own = members(doc.text)
        want |= {(doc.doc_id, i, len(s), len(s & own)) for i, s in sets.items() if s and len(s & own) >= 0.8 * len(s)}
    got = {tuple(r)[:4] for r in containment.contained_items(docs, items).collect()}
    assert got == want and (-4, 9001, 1, 1) in got and any(d == -6 for d, *_ in got)
    clean = containment.decontaminated(docs, items)
    assert clean.count() == docs.count() - len({d for d, *_ in want})
    assert containment.contained_items(docs, items.limit(0)).count() == 0
    assert containment.contained_items(docs.limit(0), items).count() == 0


def test_containment_runs_without_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = containment.contained_items(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_repeated_passages_go_but_the_first_place_stays(spark):
    rng = random.Random(8)
    shared = [passage(rng, n) for n in (60, 80, 200)]
    own = [passage(rng, 150) for _ in range(40)]
    rows = [(i, f"{own[i][: 300 + 7 * i]}\n{shared[i % 3]} {own[i][300 + 7 * i :]}") for i in range(30)]
    rows += [(i, own[i]) for i in range(30, 40)]
    rows += [(50, None), (51, ""), (52, "  "), (None, own[39]), (53, shared[2] + "\n" + shared[2])]
    df = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 as runs", "2 as row")
    got = {r.doc_id: r for r in chunks.repeated_passages(df).collect()}
    assert len(got) == len(rows)
    for i in range(30):
        size = (60, 80, 200)[i % 3]
        if i < 3:
            assert got[i].n_removed_words == 0
        else:
            assert 0.6 * size < got[i].n_removed_words <= size
    assert all(got[i].n_removed_words == 0 for i in [*range(30, 40), 50, 51, 52])
    assert got[None].n_removed_words == 0 and got[53].n_removed_words > 350
    texts = {r.doc_id: r for r in chunks.without_repeats(df).collect()}
    by_id = dict(rows)
    for key, r in got.items():
        words, dropped = (by_id[key] or "").split(), set()
        for run in r.removed:
            dropped |= set(range(run["first"], run["end"]))
        left = [w for k, w in enumerate(words) if k not in dropped]
        assert (texts[key].text or "").split() == left and (texts[key].runs, texts[key].row) == (1, 2)
    assert texts[50].text is None and texts[52].text == "  "
    assert chunks.repeated_passages(df.limit(0)).count() == 0


def test_no_passage_of_51_words_is_wholly_missed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        shared = passage(rng, 51)
        rows += [(k, f"{passage(rng, 40)} {shared} {passage(rng, 40)}") for k in (2 * i, 2 * i + 1)]
    got = {r.doc_id: r for r in chunks.repeated_passages(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    removed = [got[2 * i + 1].n_removed_words for i in range(1500)]
    print("missed", removed.count(0), "removed", sum(removed) / (51 * len(removed)))
    assert removed.count(0) == 0 and max(removed) <= 51
    assert all(got[2 * i].n_removed_words == 0 for i in range(1500))


def test_chunks_do_not_depend_on_the_texts_around_and_resist_shifts():
    import pyarrow as pa

    from tickloom.llm.scan import slices

    rng = random.Random(2)
    text = passage(rng, 400)
    moved = f"some new words at the front {text}"

    def digests(texts, which):
        part = next(slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text"))
        owner, _, _, found, _ = chunks.chunk(part)
        return found[owner == which].tolist()

    alone = digests([text], 0)
    assert alone == digests(["noise before", text, "after"], 1)
    shifted = digests([moved], 0)
    assert len(set(alone) & set(shifted)) >= len(alone) - 3


def same_hash_modulo_powers_of_two(symbols):
    """A Thue-Morse word and its complement: their polynomial hashes modulo 2**64 agree for every odd base."""
    word = "a"
    while len(word) < symbols:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_texts_are_told_apart_where_simple_hashes_agree(spark):
    rows = []
    for n in (1024, 4096):
        first, second = same_hash_modulo_powers_of_two(n)
        rows += [(len(rows) + 1, first), (len(rows) + 2, second), (len(rows) + 3, " ".join(first)), (len(rows) + 4, " ".join(second))]
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_blocks_of_a_hot_band_are_spread_over_tasks(spark):
    """Two thousand texts of one bucket meet in many blocks; the blocks must not stay in the bucket's task."""
    base = spark.range(2000).selectExpr("id as key", "id as component", "id % 2 = 1 as minor", "7L as band", "0 as no")
    sets = base.selectExpr("key", "cast(repeat(char(65 + key % 20), 800) as binary) as shingles")
    signed = base.selectExpr("key", "100 as n_shingles", "cast(repeat(char(65 + key % 50), 304) as binary) as signature")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = minhash._block_links(base, sets, signed, 85, 76, 4, 1e-6)
        plan = found._jdf.queryExecution().executedPlan().toString()
        grouped = plan[plan.index("FlatMapGroupsInArrow") :]
        assert "hashpartitioning(band" in grouped and grouped[grouped.index("hashpartitioning(band") :].startswith("hashpartitioning(band") and ", x#" in grouped.split("hashpartitioning(band")[1][:40]
        tasks = spark.createDataFrame([(7, x, y) for x in range(4) for y in range(8)], "band long, x int, y int").repartition("band", "x", "y")
        assert tasks.selectExpr("spark_partition_id() as p").distinct().count() > 1
        found.count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ids_repeated_a_thousand_times_are_compared_once(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words))] * 1000 + [(2, near)] * 1000 + [(3, "quite another text of some words")]
    seen = {}

    def spied(pairs, sets, percent):
        both = pairs.join(sets.withColumnRenamed("key", "a"), "a").join(sets.select("key").withColumnRenamed("key", "b"), "b")
        seen["pairs"], seen["comparisons"] = pairs.count(), both.count()
        return verified(pairs, sets, percent)

    verified = minhash.verified
    monkeypatch.setattr(minhash, "verified", spied)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCUMENTS), size=3, percent=85).distinct().collect()
    assert seen == {"pairs": 1, "comparisons": 1}
    assert {r.doc_id: (r.component_id, r.kept) for r in got} == {1: (1, True), 2: (1, False), 3: (3, True)}


def test_long_items_need_few_members_of_a_document(spark):
    """Per item class: the share of a document's members that is signed, and how many planted items are candidates."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    shares = {}
    for size in (10, 20, 54, 150):
        items = [(i, words(size + 4)) for i in range(40)]
        docs = []
        for i, own in items:
            # A fifth of the members is lost: the last words differ.
            kept = own[: len(own) - size // 5]
            docs.append((i, " ".join([*words(rng.choice([0, 300, 3000])), *kept, *words(rng.choice([0, 50]))])))
        docs += [(1000 + i, " ".join(words(900))) for i in range(40)]
        frame, table = spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in containment.contained_items(frame, table).collect()}
        assert got == {(i, i) for i in range(40)}, size
        load = containment.load_for(int(0.8 * size + 0.999))
        named = containment.with_members(frame.withColumnRenamed("doc_id", "doc"))
        total = named.selectExpr("sum(size(members))").first()[0]
        shares[size] = containment.document_signatures(named, [load]).count() / total
    print({size: round(share, 3) for size, share in shares.items()})
    assert shares[54] < 0.35 and shares[150] < 0.15 and shares[10] < 0.9


def test_classes_of_items_do_not_disturb_each_other(spark):
    """Items from one to four hundred members at once, in documents of all sizes; repeated rows and odd columns too."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([5, 6, 9, 14, 30, 62, 130, 404])]
    docs = [(100 * i + n, " ".join([*words(n), text, *words(n)])) for i, text in items for n in (0, 1, 50)] * 2
    docs += [(5000, " ".join(text for _, text in items)), (5001, " ".join(words(2000)))]
    frame = spark.createDataFrame(docs, DOCUMENTS).selectExpr("*", "1 as k", "2 as member", "3 as class", "4 as before")
    table = spark.createDataFrame(items + items[:2], "item_id long, text string").selectExpr("*", "1 as class")
    got = {(r.doc_id, r.item_id) for r in containment.contained_items(frame, table).collect()}
    assert got == {(100 * i + n, i) for i, _ in items for n in (0, 1, 50)} | {(5000, i) for i, _ in items}


def test_loads_bound_the_miss():
    for fewest in (1, 2, 8, 16, 40, 300):
        load = containment.load_for(fewest) / 0.8
        assert (1 - containment.least_share(load)) ** fewest <= 1.000001e-6 < (1 - containment.least_share(load * 1.001)) ** fewest
