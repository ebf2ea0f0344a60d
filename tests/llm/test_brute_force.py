"""Operators that SQL cannot express, against plain versions; the others against their SQL."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import compare
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from folioscope.llm import decontamination, jaccard_join, line_dedup, pii_crf, secret_scan, source_mixing, suffix_dedup, words
from folioscope.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert compare.check(spark, compare.connect(SF_DIR), SF_DIR, name, QUERIES, ORACLE) is None


def near_copies(seed: int, count: int = 160) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)]
    passage = rng.choices(vocabulary, k=70)
    bases = [rng.choices(vocabulary, k=rng.choice([6, 12, 40, 150, 400])) for _ in range(12)]
    texts = []
    for n in range(count):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, max(1, len(words) // 40)])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append((n, " ".join(words + (passage if n % 5 == 0 else []))))
    return texts


@pytest.mark.parametrize("limit", [0, 40, 1 << 20])
def test_jaccard_groups(spark, limit):
    rows = near_copies(limit)
    sets = {}
    for key, text in rows:
        words = text.split()
        sets[key] = {tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))}
    parent = {key: key for key in sets}

    def find(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for one in sets:
        for two in range(one):
            common = len(sets[one] & sets[two])
            if 100 * common >= 80 * (len(sets[one]) + len(sets[two]) - common):
                high, low = sorted((find(one), find(two)), reverse=True)
                parent[high] = low
    options = jaccard_join.JoinOptions(frequent_limit=limit, hubs=1)
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), options).collect()
    assert {(row.doc_id, row.n_shingles, row.component_id) for row in got} == {
        (key, len(found), find(key)) for key, found in sets.items()
    }


@pytest.mark.parametrize("spread", [1, 2000])
def test_suffix_repeats(spark, spread):
    rng = random.Random(spread)
    passages = ["".join(rng.choices("abc é", k=90)) for _ in range(6)]
    rows = [
        (n, "".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choices("abcdef", k=50)) for _ in range(6)))
        for n in range(60)
    ] + [(60, "ab" * 300), (61, "z" * 63), (62, "z" * 64)]
    least = 64
    bodies = {key: text.encode() for key, text in rows}
    times = Counter(body[p : p + least] for body in bodies.values() for p in range(len(body) - least + 1))
    options = suffix_dedup.SuffixOptions(least=least, shard_bytes=2000, spread_from=spread, segment=100)
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), options).collect()
    for row in got:
        body = bodies[row.doc_id]
        gone = np.zeros(len(body) + 1, int)
        for p in range(len(body) - least + 1):
            if times[body[p : p + least]] > 1:
                gone[p : p + least] = 1
        kept = bytes(b for b, out in zip(body, gone) if not out)
        spans = int((np.diff(np.append(0, gone)) == 1).sum())
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(body), len(body) - len(kept), spans)
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest() and bytes(row.kept) == kept


def test_mix_keeps_shares(spark):
    rows = [(n, "x" * (n % 90), f"s{n % 3 if n % 4 else 0}") for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 0.2, "s1": 0.5, "s2": 0.3}
    options = source_mixing.MixOptions(weights=weights, block=500, period=20)
    got = source_mixing.mixed(docs, options).collect()
    assert Counter((row.doc_id, row.source) for row in got) == Counter((row[0], row[2]) for row in rows)
    slots = {}
    for row in got:
        assert slots.setdefault(row.slot, (row.source, row.block)) == (row.source, row.block)
    blocks = Counter(source for source, _ in slots.values())
    phase = source_mixing.phases(blocks, weights, 20)[0]
    taken = Counter()
    for slot in range(phase.length):
        if slot in slots:
            taken[slots[slot][0]] += 1
        assert all(abs(taken[name] - (slot + 1) * weights[name]) < 1 for name in weights)


@pytest.mark.parametrize("sources", [20, 1500])
def test_mix_keeps_exact_shares(sources):
    # One source with a third; the weights are whole units of no period.
    sizes = {f"s{n}": 50 + n % 7 for n in range(1, sources)} | {"s0": 25 * sources}
    weights = {name: size**0.5 for name, size in sizes.items()}
    blocks = {name: 4 if sources > 20 else 400 for name in sizes}
    rows = [row for piece in source_mixing.laid_out(blocks, weights, 100) for row in piece]
    assert [row[1] for row in rows] == list(range(sum(blocks.values())))
    assert Counter(row[2] for row in rows) == blocks
    total, left, numbers = sum(weights.values()), dict(blocks), Counter()
    taken, last = Counter(), 0
    for start, slot, name, number in rows:
        if start != last:
            total, taken, last = sum(weights[key] for key in left), Counter(), start
        assert number == numbers[name]
        numbers[name] += 1
        taken[name] += 1
        if slot % 97 == 0:
            assert all(abs(taken[key] - (slot + 1 - start) * weights[key] / total) < 1 for key in left)
        left[name] -= 1
        if not left[name]:
            del left[name]


def test_mix_of_many_sources(spark, monkeypatch):
    rows = [(n, "x" * 40, f"s{n % 1200}" if n % 1200 else None) for n in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = source_mixing.MixOptions(block=30)
    one = sorted(source_mixing.mixed(docs, options).collect(), key=str)
    monkeypatch.setattr(source_mixing, "BROADCAST_SOURCES", 10)
    assert one == sorted(source_mixing.mixed(docs, options).collect(), key=str)
    assert len(one) == len(rows) and len({(row.source, row.block) for row in one}) == len({row.slot for row in one})
    weights = {None: 0.0, "s1": 3} | {f"s{n}": 1 for n in range(2, 1200)}
    by_slot = sorted(source_mixing.mixed(docs, source_mixing.MixOptions(weights, block=30)).collect(), key=lambda row: row.slot)
    assert {row.source for row in by_slot[-2:]} == {None}
    with pytest.raises(KeyError):
        source_mixing.mixed(docs, source_mixing.MixOptions({"s1": 1.0}))


def test_personal_data_expressions():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choices("ab1.@-+ 5", k=60))
        want = [(match.start(), match.end()) for match in email.finditer(text)]
        assert [(start, end) for start, kind, end in pii_crf.base_spans(text) if kind == 0] == want
    text = "call +1 (212) 555-0100, card 4111 1111 1111 1111 at 10.0.0.255 not 10.0.0.256"
    assert [pii_crf.KINDS[kind] for _, kind, _ in pii_crf.base_spans(text)] == ["phone", "card", "ip"]


def test_repeated_tokens_share_their_label(spark):
    known = [(n, f"reach me by phone +1 (212) 555-{n:04d} any day") for n in range(200)]
    other = [(1000 + n, f"invoice number {n:07d} was paid on day {n}") for n in range(200)]
    late = [(5000, "phone +1 (212) 555-7777 here " + "word " * 400 + "ask for 555-7777 there")]
    docs = spark.createDataFrame(known + other + late, "doc_id long, text string")
    row = pii_crf.scan(docs).filter("doc_id = 5000").first()
    assert row.n_phone == 1 and row.n_added >= 1 and row.spans.count("phone") == 2


def test_next_mention_has_an_edge_however_far(spark):
    text = "phone +1 (212) 555-7777 here " + "word " * 400 + "ask for 555-7777 there"
    tokens = pii_crf.tokens_of(text, pii_crf.base_spans(text))
    assert pii_crf.edges_of(text, tokens) == ([(0, 1), (1, 2)], [(2, 3)])
    # By themselves all tokens are "other".
    size = len(pii_crf.LABELS)
    prior = np.log([0.6, 0.1, 0.1, 0.1, 0.1])
    field = pii_crf.Field(np.zeros((pii_crf.FEATURES, size)), prior, np.zeros((size, size)), 4.0)
    alone = "ask for 555-7777 there"
    assert pii_crf.added_spans(alone, [], field, 0.7)[0] == []
    docs = spark.createDataFrame([(1, text), (2, alone)], "doc_id long, text string")
    got = sorted(pii_crf.scan(docs, field).select("doc_id", "n_phone", "n_added").collect())
    assert got == [(1, 1, 1), (2, 0, 0)]
    # 96 pairs of mentions with one label: (96 + 2) / (96 + 4).
    twice = spark.createDataFrame([(n, "part 123-4567 or part 123-4567") for n in range(96)], "doc_id long, text string")
    assert pii_crf.train(twice).skip == pytest.approx(np.log(49))


def test_many_mentions_share_their_label(spark):
    size = len(pii_crf.LABELS)
    field = pii_crf.Field(np.zeros((pii_crf.FEATURES, size)), np.zeros(size), np.zeros((size, size)), 6.0)
    again = " or ask for 555-7777 there" * 60
    rows = [(1, "phone +1 (212) 555-7777 here" + again), (2, again + " phone +1 (212) 555-7777 here"), (3, again)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(pii_crf.scan(docs, field).select("doc_id", "n_phone", "n_added", "converged").collect())
    assert got == [(1, 1, 60, True), (2, 1, 60, True), (3, 0, 0, True)]
    tokens = pii_crf.tokens_of(rows[0][1], pii_crf.base_spans(rows[0][1]))
    assert not field.marginals(rows[0][1], tokens, rounds=2)[1]
    # Long chains are run to their end as well.
    table = " ".join(f"{n} 10.0.0.{n}" for n in range(200))
    assert field.marginals(table, pii_crf.tokens_of(table, pii_crf.base_spans(table)))[1]


def test_benchmark_in_parts(spark):
    items = spark.createDataFrame([(n, f"alpha{n} beta gamma delta") for n in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(n, f"Say alpha{n} beta, GAMMA delta alpha{n + 1} beta gamma delta!") for n in range(29)], "doc_id long, text string")
    small = decontamination.ScanOptions(broadcast_bytes=100)
    one = decontamination.report(docs, items).collect()
    assert sorted(one) == sorted(decontamination.report(docs, items, small).collect())
    assert {(row.n_hit, row.n_items) for row in one} == {(8, 2)}
    cut = [decontamination.decontaminated(docs, items, options, "spans").collect() for options in (None, small)]
    assert sorted(cut[0]) == sorted(cut[1]) and {row.text for row in cut[0]} == {"Say !"}


def test_boilerplate_by_host(spark):
    rows = [(n, f"own {n}\nmenu\nend", f"h{n % 2}" if n else None) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = [line_dedup.LineOptions(), line_dedup.LineOptions(broadcast_lines=0)]
    got = [sorted(line_dedup.without_boilerplate(docs, option).collect(), key=str) for option in options]
    assert got[0] == got[1]
    assert {row.text for row in got[0]} == {"own 0\nmenu\nend"} | {f"own {n}" for n in range(1, 40)}


def test_copies_are_one_page(spark, tmp_path):
    prose = "\n".join(f"line {n} of the copied text" for n in range(30))
    rows = [(n, f"own {n}\nmenu\n" + "\n".join(f"{n} says {m}" for m in range(30)), "h") for n in range(60)]
    rows += [(100 + n, prose, "h") for n in range(30)] + [(200 + n, prose, "small") for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {row.doc_id: row.text for row in line_dedup.without_boilerplate(docs).collect()}
    assert all(got[key] == prose for key in got if key >= 100)
    assert not any("menu" in text for text in got.values()) and all("own" in got[key] for key in range(60))
    # The pipeline keeps one of the copies, with its text.
    staged = corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, docs, str(tmp_path)), str(tmp_path))
    assert {row.doc_id: row.text for row in staged.collect() if row.doc_id >= 100} == {100: prose}


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]+") is None
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secret_scan.trigrams_of(secret_scan.trigram_query("(abcd|xyz)=?[0-9]+")) == {"abc", "bcd", "xyz"}


def test_rows_that_repeat_an_id(spark, tmp_path):
    one, other = (" ".join(f"{name}{n}" for n in range(60)) for name in ("pear", "fig"))
    rows = [(1, one), (2, one), (2, other), (5, "a b"), (5, "a b"), (None, one), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(row) for row in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (2, other), (5, "a b"), (None, one), (7, None), (7, None)], key=str)


def test_line_report_keeps_groups_of_copies(spark):
    prose = "\n".join(f"line {n} of the copied text" for n in range(30))
    rows = [(n, f"own {n}\nmenu\n" + "\n".join(f"{n} says {m}" for m in range(9)), "h") for n in range(60)]
    rows += [(100 + n, prose, "h") for n in range(30)] + [(100, "menu\nnew", "h"), (200, None, "h"), (201, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.line_report(docs).collect()
    assert {(row.n_lines, row.n_kept, row.text) for row in got if row.doc_id in range(101, 130)} == {(30, 30, prose)}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(line_dedup.oracle()).select("doc_id", "n_kept", "text").fetchall()
    assert sorted((row.doc_id, row.n_kept, row.text or "") for row in got) == sorted(want)


@pytest.mark.parametrize("enough", [40, 150, 400])
def test_suffix_order_and_common_prefixes(enough):
    chooser = np.random.default_rng(enough)
    words = [bytes(chooser.integers(97, 99, 70, dtype=np.uint8)) for _ in range(6)]
    pieces = [b"".join(words[place] for place in chooser.integers(0, 6, 12))[: int(chooser.integers(1, 800))] for _ in range(25)]
    pieces += [b"a" * 700, b"ab" * 300, pieces[0], b"a" * 64]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(piece) for piece in pieces])
    number = np.repeat(np.arange(len(pieces)), [len(piece) for piece in pieces])
    order, rank, eight, block = suffix_dedup.suffix_array(data, ends, number)
    suffixes = [data[at : ends[number[at]]].tobytes() for at in range(len(data))]
    assert order.tolist() == sorted(range(len(data)), key=lambda at: (suffixes[at], number[at]))
    begins = np.append(0, ends[:-1])
    got = suffix_dedup.common_prefixes(order, rank, eight, block, ends[number], begins, ends, enough)
    for place, at in enumerate(order.tolist()):
        before = suffixes[order[place - 1]] if place else b""
        same = next((n for n, (a, b) in enumerate(zip(before, suffixes[at])) if a != b), min(len(before), len(suffixes[at])))
        assert got[at] == min(same, enough)


def test_shards_with_copied_pieces(spark):
    # Pieces that only occur as copies, near copies, periods, and short texts, at the production length.
    chooser = random.Random(5)

    def prose(n):
        return "".join(chooser.choice("abcdefgh ") for _ in range(n))

    one, two = prose(2500), prose(1500)
    texts = [one] * 3 + [two, two[:900] + "X" + two[901:], two[100:1400], prose(3000), "ab" * 900, "q" * 450, "q" * 399, None, one[:450]]
    rows = list(enumerate(texts))
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = Counter(text[at : at + 400] for text in texts if text for at in range(len(text) - 399))
    for row in got:
        text = texts[row.doc_id] or ""
        gone = set()
        for at in range(len(text) - 399):
            if seen[text[at : at + 400]] > 1:
                gone.update(range(at, at + 400))
        left = "".join(sign for at, sign in enumerate(text) if at not in gone)
        assert (row.n_bytes, row.n_removed) == (len(text), len(gone)), row.doc_id
        assert row.kept_sha256 == hashlib.sha256(left.encode()).hexdigest()


def test_added_spans_pass_the_test_of_their_kind():
    size = len(pii_crf.LABELS)
    for kind, good, bad in ((3, "4111 1111 1111 1111", "4111 1111 1111 1112"), (2, "10.0.0.1", "10.0.0.300")):
        node = np.zeros((pii_crf.FEATURES, size))
        node[:, kind] = 5.0
        field = pii_crf.Field(node, np.zeros(size), np.zeros((size, size)), 1.0)
        assert pii_crf.added_spans(f"see {bad} there", [], field, 0.7)[0] == []
        assert pii_crf.added_spans(f"see {good} there", [], field, 0.7)[0] == [(4, kind - 1, 4 + len(good))]
    # A token under the last of many spans is fixed by it.
    text = "a@b.cc;" * 9 + "z"
    tokens = pii_crf.tokens_of(text, pii_crf.base_spans(text))
    assert [token.label for token in tokens] == [1]
    spans = [(0, 0, 2), (0, 1, 2), (0, 2, 2), (0, 3, 2), (0, 0, 2), (5, 3, 9)]
    assert [token.label for token in pii_crf.tokens_of("a1   b234", spans)] == [1, 4]


def test_label_chances_match_every_labelling():
    # A tree: message passing is exact there, so it must agree with a sum over all labellings.
    size = len(pii_crf.LABELS)
    rng = np.random.default_rng(9)
    field = pii_crf.Field(rng.normal(size=(pii_crf.FEATURES, size)), rng.normal(size=size), rng.normal(size=(size, size)), 1.3)
    text = "call 555-7777 - 12 or write words and words and words to 555-7777 today"
    tokens = pii_crf.tokens_of(text, [])
    chain, skip = pii_crf.edges_of(text, tokens, hubs=True)
    assert len(tokens) == 3 and len(chain) + len(skip) == 2
    node = np.array([field.prior + sum(field.node[feature] for feature in token.features) for token in tokens])
    total = np.zeros((3, size))
    for labels in np.ndindex(size, size, size):
        weight = sum(node[place, label] for place, label in enumerate(labels))
        weight += sum(field.chain[labels[a], labels[b]] for a, b in chain)
        weight += sum(field.skip for a, b in skip if labels[a] == labels[b])
        for place, label in enumerate(labels):
            total[place, label] += np.exp(weight)
    want = total / total.sum(axis=1, keepdims=True)
    got, converged = field.marginals(text, tokens)
    assert converged and np.allclose(got, want, atol=1e-3)


def passage_words(texts: list[str | None], width: int) -> list[int]:
    lists = [re.findall("[^\x20\x09-\x0d]+", text or "") for text in texts]
    rows = Counter(w for words in lists for w in {tuple(words[at : at + width]) for at in range(len(words) - width + 1)})
    found = []
    for words in lists:
        starts = [at for at in range(len(words) - width + 1) if rows[tuple(words[at : at + width])] > 1]
        found.append(len({place for at in starts for place in range(at, at + width)}))
    return found


def test_passages_of_over_50_words(spark):
    # Passages with too few bytes for a repeat of 400, over differing white space, or twice in one row only.
    rng = random.Random(7)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefgé", k=rng.randint(2, 6))) for _ in range(n))

    passages = [prose(n) for n in (50, 51, 55, 60)]
    texts = [f"{prose(rng.randrange(80))} {rng.choice(passages)} {prose(rng.randrange(80))}" for _ in range(60)]
    copy = prose(150)
    alone = prose(54)
    texts += [passages[2].replace(" ", "\n\t"), f"{alone} {prose(9)} {alone}", copy, copy, copy + " End", copy.upper(), None, "", "\x00 é"]
    texts += ["la " * 90, "la " * 60, "lo " * 200]
    rows = [(n % 66, text) for n, text in enumerate(texts)]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    want = passage_words(texts, 51)
    body = [len((text or "").encode()) for text in texts]
    assert sorted((row.doc_id, row.n_bytes, row.n_passage_words) for row in got) == sorted(
        (key, size, count) for (key, _), size, count in zip(rows, body, want)
    )
    assert max(len(passage.encode()) for passage in passages) < 400 and sum(map(bool, want[:60])) > 30 and want[61] == 0


@pytest.mark.parametrize("segment", [7, 64, 1 << 19])
def test_word_runs_hold_every_window_once(monkeypatch, segment):
    monkeypatch.setattr(suffix_dedup, "WORD_SEGMENT", segment)
    rng = random.Random(segment)
    texts = ["", *(" ".join(rng.choices("abc", k=rng.randrange(90))) for _ in range(30)), "d" * 30, "", "e e" * 40]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    hashes, first = words.plain_words(data, offsets, words.NOT_SPACE)
    lists = [text.split() for text in texts]
    assert first.tolist() == np.cumsum([0, *map(len, lists)]).tolist()
    names = {}
    assert all(names.setdefault(value, word) == word for value, word in zip(hashes.tolist(), sum(lists, [])))
    assert len(set(hashes.tolist())) == len(set(sum(lists, [])))
    text, anchor, whole, start, last, fresh = suffix_dedup.word_runs(hashes, first, 20)
    held = [(of, at) for of, begin, end in zip(text, start, last) for at in range(begin - first[of], end - first[of] + 1)]
    assert held == [(of, at) for of, found in enumerate(lists) for at in range(len(found) - 19)]
    assert sorted(zip(text[fresh], whole[fresh])) == sorted(set(zip(text, whole)))
    owner, equal = {}, {}
    for of, name, value, begin, end in zip(text, anchor, whole, start, last):
        found = lists[of][begin - first[of] : end - first[of] + 20]
        assert equal.setdefault(value, found) == found
        for at in range(len(found) - 19):
            assert owner.setdefault(tuple(found[at : at + 20]), name) == name
