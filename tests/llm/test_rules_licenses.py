from __future__ import annotations

import re
from collections import Counter

import pytest

from tickloom.llm import licenses, line_rules

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force_on_the_table_and_odd_texts(spark):
    odd = [None, "", " \n\t", "a a a a", "x\n\nx\ny\r\ny\r", "é è é è é è", "# | <>\n# | <>", "a b c a b c d"]
    rows = [(-i - 1, t, "en", None, None) for i, t in enumerate(odd)]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    df = table.union(spark.createDataFrame(rows, DOCUMENTS))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in line_rules.quality_rules(df).collect():
        n_words, word_chars, n_symbols, n_dup, n_repeat = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup, n_repeat)
        assert r.base_failed == (n_words < 50 or 100 * n_repeat > 50 * n_words)
        assert not (r.kept and r.base_failed)


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    common = "Share this page 1 " + " ".join(f"common{chr(97 + k)}" for k in range(26)) + " and 12 more words" + " x y z w v u t s"
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"{common}\n{own(i, 60 if i % 2 else 20)}", None, "h1", 0) for i in range(30)]
    rows += [(100 + i, f"{common.replace('page 1', 'page 2')}\n{own(i, 20)}", None, "h2", 0) for i in range(10)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = {r.doc_id: r for r in line_rules.quality_rules(df).collect()}
    assert all(got[i].n_removed_words == 42 and got[i].base_failed is False and got[i].kept == bool(i % 2) for i in range(30))
    # Ten documents of the other host are below the limit.
    assert all(got[100 + i].n_removed_words == 0 and got[100 + i].kept for i in range(10))
    texts = dict(line_rules.without_frequent_lines(df).collect())
    assert texts[3] == own(3, 60) and texts[100].startswith("Share this page 2")
    assert line_rules.quality_rules(df.limit(0)).count() == 0


def brute_places(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in licenses.BASE_PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), places


def test_license_places_equal_brute_force(spark):
    odd = [None, "", "MIT License", "mit-license\nMIT\tLICENSE, the mit licenses", "xmit license", "license", "mit", "General Public\n License mit é license", "Apache License general public license general public license"]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    df = table.union(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    seen = 0
    for r in licenses.license_scan(df).collect():
        n_words, places = brute_places(texts[r.doc_id])
        starts = [i for i, _ in places]
        seen += len(places)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n_words, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert seen > 10


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT", "MIT"),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", "(MIT OR (Apache-2.0 AND BSD-3-Clause))"),
        ("(MIT or GPL-2.0+) and Apache-2.0 */", "((MIT OR GPL-2.0+) AND Apache-2.0)"),
        ("GPL-2.0-only WITH Classpath-exception-2.0 and MIT", "((GPL-2.0-only WITH Classpath-exception-2.0) AND MIT)"),
        ("MIT. More text", "MIT"),
        ("MIT AND", None),
        ("(MIT OR ISC", None),
        ("OR MIT", None),
        ("", None),
    ],
)
def test_expressions(text, want):
    found = licenses.parse_expression(text)
    assert (found and found.text) == want


def test_tags_give_labels_and_scores(spark):
    rows = [(1, "// SPDX-License-Identifier: (MIT OR GPL-3.0-only)\ncode"), (2, "SPDX-License-Identifier: AND"), (3, "SPDX-License-Identifier: GPL-2.0-only AND MIT")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].permissive, got[1].score, got[1].n_base) == ("gpl,mit", True, 1.0, 0)
    assert (got[2].labels, got[2].permissive, got[2].score) == ("", None, 0.5)
    assert (got[3].labels, got[3].permissive) == ("gpl,mit", False)


def test_a_line_counts_once_per_document_whatever_rows_it_has(spark):
    line = " ".join(f"word{k}" for k in range(68))
    rows = [(7, line, "en", "h", 0)] * 30 + [(None, line, "en", "h", 0)] * 30
    df = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 as host", "2 as row", "'x' as line_hash")
    assert {r.n_removed_words for r in line_rules.quality_rules(df).collect()} == {0}
    assert {r.text for r in line_rules.without_frequent_lines(df).collect()} == {line}
    more = df.union(spark.createDataFrame([(100 + i, line, "en", "h", 0) for i in range(20)], DOCUMENTS).selectExpr("*", "1 as host", "2 as row", "'x' as line_hash"))
    assert {r.n_removed_words for r in line_rules.quality_rules(more).collect()} == {68}


def test_lines_are_told_apart_where_simple_hashes_agree(spark):
    from test_duplicates import same_hash_modulo_powers_of_two

    rows = []
    for n in (1024, 4096):
        rows += [(n, "\n".join(same_hash_modulo_powers_of_two(n)), "en", "h", 0), (n + 1, "\n".join(" ".join(w) for w in same_hash_modulo_powers_of_two(n)), "en", "h", 0)]
    assert {r.n_dup_lines for r in line_rules.quality_rules(spark.createDataFrame(rows, DOCUMENTS)).collect()} == {0}


@pytest.mark.parametrize(
    ("text", "labels", "permissive", "known"),
    [
        ("NONE", "", None, False),
        ("NOASSERTION", "", None, False),
        ("Proprietary", "", None, False),
        ("LicenseRef-Acme", "", None, False),
        ("see below", "", None, False),
        ("EUPL-1.2", "eupl", False, True),
        ("CDDL-1.0", "cddl", False, True),
        ("OSL-3.0", "osl", False, True),
        ("MIT OR Proprietary", "mit", True, False),
        ("GPL-3.0-only OR Proprietary", "gpl", None, False),
        ("MIT AND Proprietary", "mit", None, False),
        ("GPL-3.0-only AND Proprietary", "gpl", False, False),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl", True, True),
        ("GPL-2.0-only WITH Some-exception-1.0", "gpl", False, True),
        ("Proprietary WITH Classpath-exception-2.0", "", None, False),
        ("CC-BY-NC-SA-4.0", "cc-by-nc-sa", False, True),
        ("CC-BY-4.0", "cc-by", True, True),
        ("0BSD", "0bsd", True, True),
        ("mitigated", "", None, False),
    ],
)
def test_unknown_names_are_no_licenses(text, labels, permissive, known):
    found = licenses.parse_expression(text)
    assert (",".join(sorted(found.labels)), found.permissive, found.known) == (labels, permissive, known)


def test_scores_of_unknown_names_odd_rows_and_empty_tables(spark):
    tag = "SPDX-License-Identifier: "
    rows = [(1, tag + "see below"), (2, f"{tag}NONE\nthe MIT License"), (3, f"{tag}MIT\n{tag}Proprietary"), (3, f"{tag}MIT\n{tag}Proprietary"), (None, tag)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as labels", "'x' as score")
    got = [tuple(r) for r in licenses.license_scan(df).select("doc_id", "labels", "permissive", "score").collect()]
    assert sorted(got, key=str) == sorted([(1, "", None, 0.6), (2, "mit", None, 0.8), (3, "mit", None, 1.0), (3, "mit", None, 1.0), (None, "", None, 0.5)], key=str)
    assert licenses.license_scan(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "mit license " * 200_000)], "doc_id long, text string")
    assert licenses.license_scan(long).first().n_base == 200_000
