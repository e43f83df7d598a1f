"""SimHash groups, repeated passages and decontamination against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from rarelane.llm import simhash
from rarelane.llm.components import components
from rarelane.llm.decontaminate import best_place, contaminated, drop_contaminated, folded, original_span
from rarelane.llm.simhash import cut_buckets, drop_near_copies, first_linked, near_copies, print_links
from rarelane.llm.units import drop_repeats, repeated_spans, spans, units
from tests.llm.conftest import prose


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(prints, radius=4):
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= radius:
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def scattered(seed, count):
    r = random.Random(seed)
    out = set()
    for _ in range(count):
        x = r.getrandbits(64)
        out.add(x)
        for _ in range(r.randint(0, 5)):
            for bit in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << bit
            out.add(x)
    return sorted(out)


def test_bit_planes_link_what_pairs_link():
    for n in (1, 2, 63, 64, 65, 400):
        prints = scattered(n, n)
        got = first_linked(np.array(prints, np.uint64), 4)
        assert got.tolist() == plain_groups(prints)
    assert first_linked(np.array([0, 15, 31], np.uint64), 4).tolist() == [0, 0, 0]
    assert first_linked(np.array([0, 31], np.uint64), 4).tolist() == [0, 1]


def test_cut_buckets_keep_every_link():
    prints = np.array(scattered(9, 150), np.uint64)
    none = np.zeros(len(prints), np.uint64)
    keys, masks, found = cut_buckets(prints, none, none, 4)
    together = {}
    for k, p in zip(keys.tolist(), found.tolist()):
        together.setdefault(p, set()).add(k)
    for i, a in enumerate(prints.tolist()):
        for b in prints.tolist()[:i]:
            if bin(a ^ b).count("1") <= 4:
                assert together[a] & together[b]
    # cutting again uses other bits
    _, deeper, _ = cut_buckets(found, keys, masks, 4)
    assert all(bin(m).count("1") in range(20, 27) for m in deeper.tolist())


def test_large_buckets_are_cut_again(spark, monkeypatch):
    prints = scattered(4, 40)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long")
    monkeypatch.setattr(simhash, "BUCKET", 3)
    links = [(r.a, r.b) for r in print_links(df).collect()]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    want = plain_groups(prints)
    for i in range(len(prints)):
        for j in range(i):
            same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
            assert same == (want[i] == want[j])


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None), (None, None)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    got = {row.node: row.root for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in group}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies(edge_docs, edge_texts, no_docs):
    rows = near_copies(edge_docs).collect()
    prints = [plain_print(t) for _, t in edge_texts]
    group = plain_groups(prints)
    least = {}
    for (key, _), g in zip(edge_texts, group):
        if key is not None:
            least[g] = min(least.get(g, key), key)
    want = sorted(
        (key is not None, key or 0, int(np.uint64(p).view(np.int64)), least.get(g))
        for (key, _), p, g in zip(edge_texts, prints, group)
    )
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.print, r.component_id) for r in rows) == want
    assert near_copies(no_docs).count() == 0


def test_one_document_of_a_group_stays(edge_docs, no_docs):
    kept = drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and not {5, 2, 3} & set(ids) and ids.count(None) == 2
    assert {-12, 1, 7, 8, 9, 10, 11, 13} <= set(ids)
    assert drop_near_copies(no_docs).count() == 0


def test_edited_copies_go_by_bit_distance(make_docs):
    texts, key = [], 0
    for seed in range(30):
        base = prose(200 + seed, 220).split(" ")
        texts.append((key := key + 1, " ".join(base)))
        for edits in (1, 2, 4, 9):
            copy = list(base)
            for place in random.Random(seed * 10 + edits).sample(range(len(copy)), edits):
                copy[place] = f"edited{place}"
            texts.append((key := key + 1, " ".join(copy)))
    group = plain_groups([plain_print(t) for _, t in texts])
    assert 30 < len(set(group)) < len(texts)
    kept = sorted(r.doc_id for r in drop_near_copies(make_docs(texts)).collect())
    assert kept == sorted(texts[g][0] for g in set(group))


def test_a_radius_beyond_the_counters_is_refused(make_docs):
    with pytest.raises(ValueError, match="radius"):
        near_copies(make_docs([(1, "a")]), radius=8)


def test_survivors_are_chosen_by_row(make_docs):
    a, b, c, d = (prose(400 + i, 100) for i in range(4))
    texts = [(0, c), (1, a), (2, a), (2, b), (2, a), (3, b), (None, d), (None, d), (None, c), (None, prose(410, 70))]
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in drop_near_copies(make_docs(texts)).collect())
    # a keyed row and a row without a key of each group
    assert kept == sorted([(0, c), (1, a), (2, b), (-1, d), (-1, c), (-1, prose(410, 70))])
    plain = drop_near_copies(make_docs([(0, a), (5, a), (-3, b), (8, b)])).collect()
    assert sorted(r.doc_id for r in plain) == [-3, 0]


def test_passages_are_cut_where_they_repeat(make_docs):
    passage = prose(50, 60)
    bare = " ".join(f"w{(i * i) % 97}x{i % 13}" for i in range(60))  # no marks at all
    texts = [
        (10, prose(51, 40) + " " + passage + " " + prose(52, 40)),
        (20, prose(53, 33) + " " + passage + " " + prose(54, 21)),
        (30, prose(55, 90)),
        (40, prose(56, 20) + " " + bare + " " + prose(57, 20)),
        (50, prose(58, 25) + " " + bare.upper() + " " + prose(59, 20)),
        (60, "A short shared line of nine words it is."), (70, "A short shared line of nine words it is."),
    ]
    rows = repeated_spans(make_docs(texts)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {20, 50}
    for key, source in ((20, passage), (50, bare.upper())):
        text = dict(texts)[key]
        begin = text.index(source)
        for r in by[key]:
            assert begin - 1 <= r.start and r.start + r.length <= begin + len(source) + 1
        assert sum(r.length for r in by[key]) > len(source) / 3
        assert {r.kept_doc_id for r in by[key]} == {10 if key == 20 else 40}
    cleaned = {r.doc_id: r for r in drop_repeats(make_docs(texts)).collect()}
    for key, text in texts:
        for r in sorted(by.get(key, []), key=lambda r: -r.start):
            text = text[: r.start] + text[r.start + r.length :]
        assert cleaned[key].text == text and cleaned[key].n_chars == len(text)


def test_repeats_of_edge_rows(edge_docs, edge_texts, no_docs):
    out = drop_repeats(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == len(edge_texts)
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1] == [None] and texts[2] == [""] and texts[8] == ["one"]
    assert len(texts[5]) == 2 and texts[5][0] == texts[5][1]
    assert drop_repeats(no_docs).count() == 0 and repeated_spans(no_docs).count() == 0


def test_rows_that_share_a_key_are_documents_of_their_own(make_docs):
    passage = prose(300, 60)
    texts = [
        (None, prose(301, 40) + " " + passage), (None, prose(302, 30) + " " + passage), (None, prose(303, 200)),
        (7, prose(304, 50) + " " + passage), (7, prose(305, 200)), (9, prose(306, 90)), (9, prose(306, 90)),
    ]
    cleaned = sorted((r.doc_id or 0, r.text) for r in drop_repeats(make_docs(texts)).collect())
    clean = {t for _, t in texts}
    whole = [(k, t) for k, t in cleaned if t in clean]
    assert len(cleaned) == len(texts)
    assert {(0, texts[2][1]), (7, texts[4][1])} <= set(whole)
    assert sum(k == 0 for k, _ in whole) == 2 and sum(k == 9 for k, _ in whole) == 1
    third = passage[len(passage) // 3 : 2 * len(passage) // 3]
    assert sum(third in t for _, t in cleaned) == 1 and sum(third in t for k, t in cleaned if k == 0) == 1
    spans_found = repeated_spans(make_docs(texts)).collect()
    assert {r.doc_id for r in spans_found} == {None, 7, 9} and {r.kept_doc_id for r in spans_found} == {None, 9}


def test_every_repeated_unit_is_left_once(edge_texts):
    text = "the " * 500
    starts, stops, digests = units(text)
    first = {}
    found = []
    for s, e, d in zip(starts, stops, digests):
        found.append((s, e, d not in first, 1, first.setdefault(d, s)))
    gone = {x for b, n, *_ in spans(found) for x in range(b, b + n)}
    for d, s in first.items():
        assert not gone & set(range(s, next(e for a, e, x in zip(starts, stops, digests) if a == s and x == d)))


def test_myers_equals_the_table():
    def table(item, text, free):
        column, best = list(range(len(item) + 1)), (len(item), 0)
        for at, c in enumerate(text, 1):
            new = [0 if free else at]
            for i in range(1, len(item) + 1):
                new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (item[i - 1] != c)))
            column = new
            if column[-1] < best[0]:
                best = (column[-1], at)
        return best

    r = random.Random(1)
    for _ in range(500):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 70)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 90)))
        for free in (True, False):
            assert best_place(item, text, 99, free) == table(item, text, free)


def test_contaminated(spark, make_docs):
    item = folded(prose(80, 40))
    other = folded(prose(81, 30))
    budget = int(len(item) * 0.08)
    r = random.Random(2)

    def edited(text, edits):
        places = r.sample(range(0, len(text), max(1, len(text) // (edits + 1))), edits)
        out = list(text)
        for p in places:
            out[p] = "#"
        return "".join(out)

    texts = [
        (1, prose(90, 50) + " " + item.upper() + " " + prose(91, 50)),
        (2, prose(92, 50) + " " + edited(item, budget) + " " + prose(93, 9)),
        (3, prose(94, 50) + " " + edited(item, budget + 6) + " " + prose(95, 9)),
        (4, prose(96, 200)), (5, None), (6, ""), (None, other.replace(" ", " \n ")), (7, other + " " + item),
    ]
    items = spark.createDataFrame(
        [(100, item, "x"), (200, other, "y"), (201, other, "y"), (300, None, "z"), (400, " ", "z")],
        "item_id long, text string, doc_id string",
    )
    rows = {(r.doc_id, r.item_id): r for r in contaminated(make_docs(texts), items).collect()}
    assert set(rows) == {(1, 100), (2, 100), (None, 200), (None, 201), (7, 100), (7, 200), (7, 201)}
    assert rows[1, 100].distance == 0 and 0 < rows[2, 100].distance <= budget
    found = texts[0][1][rows[1, 100].start : rows[1, 100].start + rows[1, 100].length]
    assert folded(found) == item
    kept = drop_contaminated(make_docs(texts), items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == make_docs(texts).columns


def test_contamination_of_empty_tables(spark, edge_docs, edge_texts, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three"), (None, "one")], "item_id long, text string")
    assert contaminated(edge_docs, none).count() == 0 and contaminated(no_docs, some).count() == 0
    assert drop_contaminated(edge_docs, none).count() == len(edge_texts)
    assert {(r.doc_id, r.item_id) for r in contaminated(edge_docs, some).collect()} >= {(9, 1), (8, None), (9, None)}


def test_original_span():
    text = "  One\n\tTwo  THREE four "
    low = folded(text)
    for begin in range(len(low)):
        for end in range(begin + 1, len(low) + 1):
            if " " not in (low[begin], low[end - 1]):
                start, length = original_span(text, begin, end)
                assert folded(text[start : start + length]) == low[begin:end]
