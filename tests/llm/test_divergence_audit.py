"""The audit against its DuckDB SQL and against plain Python, run-length sums, edge cases."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from folioscope.llm import divergence_audit, words
from folioscope.llm.divergence_audit import AuditOptions

OPTIONS = AuditOptions(least_documents=3, top=4)
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, options):
    terms = [
        (lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), word) for word in re.findall("[A-Za-z\u0080-\U0010ffff]+", text or "")])
        for text, lang, source in rows
    ]
    found = []
    for lang in {lang for lang, _, _ in terms}:
        held = [(source, words) for name, source, words in terms if name == lang]
        documents = Counter(word for _, words in held for word in set(words))
        kept = sorted(word for word, n in documents.items() if n >= options.least_documents)
        counts = {source: Counter() for source, _ in held}
        for source, words in held:
            counts[source].update(word for word in words if word in set(kept))
        whole = sum(counts.values(), Counter())

        def share(count, total):
            return 1 + options.scale * (count + options.smoothing) // (total + options.smoothing * len(kept))

        p = {source: [share(count[word], count.total()) for word in kept] for source, count in counts.items()}
        q = [share(whole[word], whole.total()) for word in kept]
        for source in counts:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[source], p[other])), other) for other in counts if other != source]
            over = [(b - a, word) for a, b, word in zip(p[source], q, kept) if a > b and counts[source][word]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(over)[: options.top])):
                found += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(items, start=1)]
    return sorted(found)


def run(rows, spark, options=OPTIONS, partitions=3):
    docs = spark.createDataFrame([(n, *row, n) for n, row in enumerate(rows)], "doc_id long, text string, lang string, source string, term long")
    return docs, sorted(tuple(row) for row in divergence_audit.audit(docs.repartition(partitions), options).select(*COLUMNS).collect())


def sample(n, sources, random=np.random.default_rng(5)):
    words = ["der", "Die", "das", "Über", "naïve", "ab", "x", "日本"] + [f"w{chr(97 + k)}" for k in range(26)]
    return [
        (" ".join(random.choice(words, int(random.integers(0, 40)))) + ", 1984", f"l{n % 2}", f"s{int(random.integers(sources)) ** 2}")
        for n in range(n)
    ]


@pytest.mark.parametrize("sources", [1, 3, 70])
def test_audit_matches_plain_one(spark, sources, monkeypatch):
    # Several blocks of the vocabulary, and tiles of columns, on small data.
    monkeypatch.setattr(divergence_audit, "BLOCK_BITS", 3)
    rows = sample(400, sources)
    docs, got = run(rows, spark)
    assert got == plain(rows, OPTIONS)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.sql(divergence_audit.oracle(OPTIONS)).select(*COLUMNS).fetchall()) == got


def test_edge_cases(spark):
    rows = [(None, None, None), ("", "", ""), ("a b a", None, "s"), ("A c", "", "s"), ("a-b", "", "t"), ("a b b", "", "t"),
            ("one", "fr", "u"), ("1 2 3", "fr", "v"), ("alone", "xx", "w"), ("é" * 200_000 + " a", "", "t")]
    got = run(rows, spark)[1]
    assert got == plain(rows, OPTIONS)
    # Without kept words distances are 0 and go by name; a source alone has no pairs.
    assert [row for row in got if row[0] == "fr"] == [("fr", "u", "pair", "v", 0, 1), ("fr", "v", "pair", "u", 0, 1)]
    assert not [row for row in got if row[0] == "xx"]
    assert run([("a", "b", "c")] * 5, spark)[1] == []
    docs, _ = run(rows, spark)
    assert divergence_audit.audit(docs.limit(0), OPTIONS).count() == 0


def test_slices_and_segments(spark, monkeypatch):
    # A document cut into segments counts once for a word; slices of one row each.
    rows = sample(60, 4) + [(" ".join(["ab", "x"] * 400), "l0", "s1")] * 3
    batch = pa.RecordBatch.from_pylist([{"text": text, "lang": lang, "source": source} for text, lang, source in rows])
    whole = divergence_audit._term_counts(batch).sort_by([(name, "ascending") for name in ("lang", "source", "term")])
    monkeypatch.setattr(divergence_audit, "MOST_BYTES", 500)
    monkeypatch.setattr(words._segments, "__defaults__", (64,))
    cut = divergence_audit._term_counts(batch).sort_by([(name, "ascending") for name in ("lang", "source", "term")])
    assert cut.to_pylist() == whole.to_pylist()
    assert max(row["docs"] for row in cut.to_pylist() if row["term"] == "x" and row["source"] == "s1") < 40


def test_overlap_sum():
    random = np.random.default_rng(2)
    for words in (1, 7, 300):
        columns = [np.sort(random.integers(0, 5, words)) * 1_000_000_007, random.integers(0, 3, words)]
        runs = []
        for column in columns:
            start = np.flatnonzero(np.diff(column, prepend=column[:1] - 1))
            runs.append((start, column[start]))
        assert divergence_audit.overlap_sum(*runs, words) == np.abs(columns[0] - columns[1]).sum()
