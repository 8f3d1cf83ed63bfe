import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geolattice.llm import common, decontamination, digest, line_templates, passages, simhash

from . import fixtures

WORD = re.compile("[^\x20\x09-\x0d]+")


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] if seed == 0 else [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)]
    edges += [(500, k) for k in range(501, 530)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    proper = [e for e in edges if e[0] != e[1]]
    assert got == classes({n for e in proper for n in e}, proper)
    assert common.connected_components(df.limit(0)).count() == 0


def slow_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAB \t\n\x0b\x1c\xa0É ")), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = fixtures.prose(random.Random(1), 500)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text)


@pytest.mark.parametrize("crowded", [0, 3, 24])
def test_links_connect_all_that_differ_by_two_bits(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rnd = random.Random(crowded)
    bits = {rnd.getrandbits(64) for _ in range(60)}
    for _ in range(6):  # tight groups, chains, and pairs over both segments
        centre = rnd.getrandbits(64)
        bits |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(25)}
        bits |= {centre ^ (1 << i) for i in range(0, 64, 3)}
    signed = sorted(b - (1 << 64) if b >> 63 else b for b in bits)
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(b,) for b in signed], "bits long")).collect()]
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(apart(a, b) <= 2 for a, b in found)
    true = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if apart(a, b) <= 2]
    assert len(true) > 100 and classes(signed, found) == classes(signed, true)


def test_near_duplicates_of_odd_rows(spark):
    docs = fixtures.odd_documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {0} and None in {r.doc_id for r in zero}
    assert {r.component_id for r in got if r.doc_id in (4, 12, 13)} == {4}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 4, None, 5} and kept.where("doc_id in (12, 13)").count() == 0
    assert simhash.near_duplicates(fixtures.no_documents(spark)).count() == 0 and simhash.keep_one(fixtures.no_documents(spark)).count() == 0


def test_rows_with_the_same_id_are_judged_by_their_text(spark):
    rnd = random.Random(17)
    text, other, item = (fixtures.prose(rnd, 60) for _ in range(3))
    docs = fixtures.documents(spark, [(1, text), (7, text), (7, other), (7, f"{fixtures.prose(rnd, 40)} {item}")])
    kept = {(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()}
    assert (1, text) in kept and (7, other) in kept and (7, text) not in kept and len(kept) == 3
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r.doc_id, r.text) for r in decontamination.remove_leaks(docs, benchmark).collect()} == {(1, text), (7, text), (7, other)}


def test_leaks(spark):
    rnd = random.Random(2)
    items = [(i, fixtures.prose(rnd, n)) for i, n in enumerate([30, 30, 40, 16, 13, 7, 6, 3])] + [(None, "an item without a number has no name"), (90, None), (91, "")]
    rows = []
    for k in range(60):
        base = fixtures.words(rnd, 120, rnd.choice(["fr", "de"]))
        item = k % 7
        copied = items[item][1].split()
        for place in rnd.sample(range(len(copied)), len(copied) // 8 if k >= 14 else 0):
            copied[place] = "zzz"
        at = rnd.randrange(121)
        rows.append((k, " ".join(base[:at] + [w.upper() for w in copied] + base[at:]), item))
    clean = [(1000 + k, fixtures.prose(rnd, 200, "fr"), None) for k in range(40)] + [(2000, items[7][1], None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + clean], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.overlaps(docs, benchmark).collect()}
    assert set(got) == {(i, item) for i, _, item in rows}
    assert all(got[i, item].coverage == 1 for i, _, item in rows[:14])
    assert all(r.n_agree >= 0.8 * r.n_words for r in got.values())
    assert decontamination.verified(np.array([1, 1, 0, 0, 0, 0, 0, 0, 0, 1], bool), 10) is None and decontamination.verified(np.array([0] + [1] * 8, bool), 9) is None
    left = decontamination.remove_leaks(docs, benchmark)
    assert {r.doc_id for r in left.collect()} == {i for i, _, _ in clean}
    odd = fixtures.odd_documents(spark)
    assert decontamination.overlaps(odd, benchmark).count() == 0 and decontamination.remove_leaks(odd, benchmark).count() == odd.count()
    assert decontamination.remove_leaks(docs, benchmark.limit(0)).count() == docs.count() and decontamination.overlaps(fixtures.no_documents(spark), benchmark).count() == 0


@given(st.lists(st.booleans(), max_size=40))
def test_best_overlap(agree):
    start, end, n = decontamination.best_overlap(np.array(agree, bool))
    score = lambda a, b: sum(1 if x else -4 for x in agree[a:b])
    best = max([score(a, b) for a in range(len(agree)) for b in range(a + 1, len(agree) + 1)], default=0)
    assert n == sum(agree[start:end]) and (score(start, end) if end else 0) == pytest.approx(max(0, best))
    assert not end or n >= 0.8 * (end - start)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([True] * 5 + [False]), max_size=45))
def test_every_long_overlap_is_verified(agree):
    found = decontamination.verified(np.array(agree, bool), 100)
    enough = [b - a for a in range(len(agree)) for b in range(a + 13, len(agree) + 1) if 5 * sum(agree[a:b]) >= 4 * (b - a)]
    assert (found is not None) == bool(enough)
    if found:
        start, end, n = found
        assert end - start >= 13 and n == sum(agree[start:end]) and 5 * n >= 4 * (end - start)
        # Only words that do not agree were left off the longest stretch.
        assert any(n == sum(agree[a : a + max(enough)]) for a in range(max(0, end - max(enough)), start + 1))


def test_partial_quotes(spark):
    rnd = random.Random(11)
    item, rows = fixtures.words(rnd, 60), []
    for k, runs in enumerate([(12, 4), (12, 3), (4, 12, 4), (12, 4, 4, 4, 4), (10, 5), (8, 8, 8)]):
        quote, at = [], 5
        for run in runs:
            quote += ["zzz"] * bool(quote) + item[at + bool(quote) : at + bool(quote) + run]
            at = 5 + len(quote)
        rows.append((k, " ".join([*fixtures.words(rnd, 50, "fr"), *quote, *fixtures.words(rnd, 50, "fr")])))
    rows.append((100, " ".join([*fixtures.words(rnd, 50, "fr"), *item[5:15], *fixtures.words(rnd, 50, "fr")])))
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.doc_start, r.n_words) for r in decontamination.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {0: (50, 17), 1: (50, 16), 2: (50, 22), 3: (50, 32), 4: (50, 16), 5: (50, 26)}


def test_leaks_without_ids(spark):
    rnd = random.Random(13)
    named, nameless = fixtures.prose(rnd, 20), fixtures.prose(rnd, 20)
    benchmark = spark.createDataFrame([(1, named), (None, nameless), (None, None)], "item_id long, text string")
    around = lambda item: f"{fixtures.prose(rnd, 30, 'fr')} {item} {fixtures.prose(rnd, 30, 'de')}"
    rows = [(None, around(named)), (None, around(nameless)), (5, around(nameless)), (None, "kept as it has no leak"), (None, None), (6, around(""))]
    left = decontamination.remove_leaks(fixtures.documents(spark, rows), benchmark)
    assert sorted((repr(r.doc_id), repr(r.text)) for r in left.collect()) == sorted((repr(i), repr(t)) for i, t in rows[3:])


def test_repeated_passages(spark):
    rnd = random.Random(3)
    shared = [fixtures.prose(rnd, n) for n in (51, 60, 80, 200)]
    rows = []
    for k in range(40):
        base = fixtures.words(rnd, 150, rnd.choice(["fr", "de"]))
        at = rnd.randrange(151)
        rows.append((k, " ".join([*base[:at], shared[k % 4], *base[at:]])))
    near = shared[3].split()
    near[100] = "changed"
    rows.append((50, " ".join(near)))
    clean = [(100 + k, fixtures.prose(rnd, 150)) for k in range(40)]
    docs = fixtures.documents(spark, rows + clean)
    got = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    # Beside the ends of a passage two documents may share a paragraph that the first one has not.
    assert {r.doc_id for r in got if r.removed} == {i for i, _ in rows[4:]} and {r.doc_id for r in got if r.keeper_doc_id < 4} == {i for i, _ in rows}
    out = {r.doc_id: r for r in passages.remove_passages(docs).collect()}
    assert len(out) == 81 and all(out[i].text == t for i, t in rows[:4] + clean) and all(out[i].n_chars == len(out[i].text) for i in out)
    assert all(len(out[i].text.split()) <= len(t.split()) - 25 for i, t in rows[4:])
    odd = fixtures.odd_documents(spark)
    assert passages.repeated_passages(odd).count() == 0 and passages.remove_passages(odd).count() == odd.count()
    assert passages.remove_passages(odd).columns == odd.columns
    assert passages.repeated_passages(fixtures.no_documents(spark)).count() == 0


def linked_alike(spark, rows, least, want):
    """``rows`` are one paragraph each: how many of the linked pairs of a brute-force search are in one cluster."""
    docs = fixtures.documents(spark, [(k, " ".join(words)) for k, words in enumerate(rows)])
    got = {r.doc_id: r.cluster_id for r in passages.repeated_paragraphs(docs, least=least).collect() if r.at == 0 and r.n == len(rows[r.doc_id])}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    like = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    true = classes(range(len(rows)), like)
    assert len(like) >= want and all(true[a] == true[b] for a in got for b in got if got[a] == got[b])
    return sum(a in got and b in got and got[a] == got[b] for a, b in like) / len(like)


def edited(rnd, words, n):
    out = [*words]
    for _ in range(n):
        out[rnd.randrange(len(out))] = "changed" + fixtures.words(rnd, 1)[0]
    return out


def test_similar_paragraphs_of_all_lengths(spark):
    rnd, rows = random.Random(14), []
    for n in (10, 15, 20, 30, 40, 50, 51, 70, 100, 200):
        for _ in range(8):
            base = fixtures.words(rnd, n)
            rows += [base, [*base], [*base[:-1], "other"], edited(rnd, base, 1), edited(rnd, base, 2), fixtures.words(rnd, n)]
    assert linked_alike(spark, rows, 10, 300) >= 0.97


def test_crowded_buckets_of_paragraphs(spark):
    rnd = random.Random(12)
    shared, rows = fixtures.words(rnd, 18), []
    for _ in range(60):  # pairs that share much with all the others
        own = fixtures.words(rnd, 8)
        rows += [shared + own[:-1], shared + own[:-2] + own[-1:]]
    for n, copies in ((100, 120), (80, 40)):  # copies that are alike to the first, and mostly not to each other
        base = fixtures.words(rnd, n)
        rows += [base, *(edited(rnd, base, 2 if n == 100 else 1) for _ in range(copies))]
    assert linked_alike(spark, rows, 20, 400) >= 0.95


@pytest.mark.parametrize("members, shingles, spread", [(512, 32_768, 8), (30, 32_768, 1), (512, 2000, 2)])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, members, shingles, spread):
    for name, value in (("BLOCK_MEMBERS", members), ("BLOCK_SHINGLES", shingles), ("SPREAD", spread)):
        monkeypatch.setattr(passages, name, value)
    rnd = np.random.default_rng(5)
    new = lambda n: rnd.integers(-(2**62), 2**62, n).tolist()
    shared, sets = new(30), []
    for k in range(90):  # chains that share much with all others; the ends of each are not alike
        own = new(12 + k % 20)
        sets += [{*shared, *own[:-5], *new(3)}, {*shared, *own}, {*shared[5:], *own}]
    sets += [{*new(40)} for _ in range(20)]
    contents = new(len(sets))
    rows = [(c, [1, 2 if i % 3 else 3, *new(6)], [*s]) for i, (c, s) in enumerate(zip(contents, sets, strict=True))]
    distinct = spark.createDataFrame(rows, "content long, keys array<long>, shingles array<long>")
    like = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    at = {c: i for i, c in enumerate(contents)}
    got = {(max(at[r.a], at[r.b]), min(at[r.a], at[r.b])) for r in passages.similar_paragraphs(distinct, []).collect()}
    assert got and classes(range(len(sets)), got) == classes(range(len(sets)), like) and len({*classes(range(len(sets)), like).values()}) > 100


def test_links_of_blocks(monkeypatch):
    monkeypatch.setattr(passages, "PRODUCT", 7)
    for seed in range(30):
        rnd = np.random.default_rng(seed)
        sets = [rnd.choice(14, rnd.integers(5, 13), replace=False) for _ in range(24)]
        block = lambda ids: (np.array(ids), np.array([len(sets[i]) for i in ids]), np.concatenate([sets[i] for i in ids]))  # noqa: E731, B023
        left, right = [*range(10)], [*range(10, 24)] if seed % 2 else [*range(10)]
        like = [(a, b) for a in left for b in right if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})]
        got = [(int(a), int(b)) for a, b in zip(*passages.block_links(block(left), block(right)), strict=True)]
        assert classes(range(24), got) == classes(range(24), like)


def test_paragraphs_between_blank_lines(spark):
    rnd = random.Random(15)
    shared = [fixtures.prose(rnd, 30) for _ in range(16)]
    wrapped = lambda text: text.replace(". ", ".\n")
    rows = [(k, "\n \n".join([fixtures.prose(rnd, 40), wrapped(shared[k % 16]), fixtures.prose(rnd, 35)])) for k in range(80)]
    got = passages.repeated_passages(fixtures.documents(spark, rows), least=20).collect()
    assert {(r.doc_id, r.start_word, r.n_words) for r in got} == {(k, 40, 30) for k in range(80)}
    assert {r.doc_id for r in got if r.removed} == set(range(16, 80))
    assert passages.repeated_passages(fixtures.documents(spark, rows)).count() == 0


def test_blocks():
    counts = np.array([0, 3, 2, 0, 4, 0, 5, 6, 0, 7])  # one text with a gap between lines, one without, one empty
    text, start, size = passages.blocks(counts, np.array([6, 3, 1]), 1)
    assert (text.tolist(), start.tolist(), size.tolist()) == ([0, 1, 1, 2], [0, 9, 14, 20], [5, 5, 6, 7])
    assert [len(x) for x in passages.blocks(np.array([0, 0]), np.array([1, 1]), 1)] == [0, 0, 0]


def test_passages_go_by_row(spark):
    rnd = random.Random(16)
    shared = fixtures.prose(rnd, 60)
    rows = [(1, shared), (7, f"{fixtures.prose(rnd, 30)} {shared}"), (7, "a text of its own"), (7, f"{shared} {fixtures.prose(rnd, 300)}"), (None, shared), (7, None)]
    out = {(r.doc_id, r.n_chars): r.text for r in passages.remove_passages(fixtures.documents(spark, rows)).collect()}
    texts = sorted(map(str, out.values()))
    assert len(out) == 6 and sum(shared in t for t in texts) == 2 and "a text of its own" in texts and "None" in texts


def test_anchors_depend_on_content_only():
    rng = np.random.default_rng(1)
    passage = rng.integers(1, 2**63, 51, np.uint64)
    for before in (0, 1, 17, 100):
        words = np.concatenate([rng.integers(1, 2**63, before, np.uint64), passage, rng.integers(1, 2**63, 33, np.uint64)])
        _, at, content = passages.windows(words, np.array([len(words)]))
        held = {int(c) for a, c in zip(at, content, strict=True) if before <= a and a + passages.WINDOW <= before + 51}
        first = held if before == 0 else first & held
        assert first


def test_every_text_of_a_window_has_one_at_its_ends():
    rng = np.random.default_rng(2)
    lengths = np.array([*range(20, 90), 0, 44, 43, 300])
    ends = np.cumsum(lengths)
    text, at, _ = passages.windows(rng.integers(1, 2**63, ends[-1], np.uint64), ends)
    for k, n in enumerate(lengths):
        held = set(at[text == k].tolist())
        assert held >= {0, n - 44} if n >= 44 else not held
    assert passages.windows(np.empty(0, np.uint64), np.array([0, 0]))[0].size == 0


def test_line_templates(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(30):
        lines = [fixtures.prose(rnd, 12) for _ in range(4)]
        lines.insert(rnd.randrange(5), "All rights reserved by the maker of things.")
        lines.insert(rnd.randrange(5), f"Posted on {k} May by user number {k * 7} of all")
        if k % 2:
            lines.insert(0, f"Shared by our friend {'ABCDEFGHIJKLMNO'[k // 2] * 3} with all of you today and for ever")
        rows.append((k, "\n".join(lines)))
    copies = [(100 + k, "\n".join(rows[0][1].split("\n")[:3] + ["a line that copies only have", "and one more of them here"])) for k in range(40)]
    out = {r.doc_id: r for r in line_templates.drop_recurrent_lines(fixtures.documents(spark, rows + copies)).collect()}
    for k, text in rows:
        gone = [x for x in text.split("\n") if x.startswith(("All rights", "Posted on", "Shared by"))]
        assert out[k].n_dropped == len(gone) and out[k].text == "\n".join(x for x in text.split("\n") if x not in gone) and out[k].n_chars == len(out[k].text)
    # The copies keep what only they have: it is no template of many documents.
    assert all("a line that copies only have" in out[k].text for k, _ in copies)


@pytest.mark.parametrize("texts, shared, own", [(300, 10, 10), (300, 10, 2), (60, 3, 1)])
def test_boilerplate_goes_whatever_stands_around_it(spark, texts, shared, own):
    rnd = random.Random(texts + own)
    menu = [fixtures.prose(rnd, rnd.randint(6, 12)) for _ in range(shared)]
    rows = [(k, [*menu, *(fixtures.prose(rnd, 12) for _ in range(own))]) for k in range(texts)]
    docs = fixtures.documents(spark, [(k, "\n".join(rnd.sample(lines, len(lines)))) for k, lines in rows])
    out = {r.doc_id: r for r in line_templates.drop_recurrent_lines(docs).collect()}
    assert all(out[k].n_dropped == shared and sorted(out[k].text.split("\n")) == sorted(lines[shared:]) for k, lines in rows)


def test_near_copies_keep_their_lines(spark):
    rnd = random.Random(21)
    lines, menu = [fixtures.prose(rnd, 12) for _ in range(20)], fixtures.prose(rnd, 9)

    def edited():
        own = [line.split() for line in lines]
        for _ in range(4):
            rnd.choice(own)[rnd.randrange(12)] = "changed" + fixtures.words(rnd, 1)[0]
        return [" ".join(words) for words in own]

    copies = [(k, "\n".join([menu, *edited()])) for k in range(200)] + [(200 + k, "\n".join([menu, *lines])) for k in range(20)]
    kept = line_templates.drop_recurrent_lines(fixtures.documents(spark, copies)).collect()
    assert sum(r.n_dropped for r in kept) == 0
    # Other documents that have one of their lines make that line a template, and only that one.
    others = [(1000 + k, "\n".join([menu, *(fixtures.prose(rnd, 12) for _ in range(5))])) for k in range(30)]
    out = line_templates.drop_recurrent_lines(fixtures.documents(spark, copies + others)).collect()
    assert {r.n_dropped for r in out} == {1} and all(menu not in r.text for r in out)


def test_lines_of_odd_rows(spark):
    odd = fixtures.odd_documents(spark)
    out = line_templates.drop_recurrent_lines(odd)
    assert out.columns == [*odd.columns, "n_dropped"]
    assert sorted(map(repr, (r.text for r in out.collect()))) == sorted(map(repr, (r.text for r in odd.collect())))
    assert line_templates.drop_recurrent_lines(fixtures.no_documents(spark)).count() == 0
    only = fixtures.documents(spark, [(k, f"the same line\n{fixtures.prose(random.Random(k), 9)}") for k in range(12)] + [(50, "the same line"), (51, "the same line\nthe same line")])
    texts = {r.doc_id: r.text for r in line_templates.drop_recurrent_lines(only).collect()}
    assert texts[50] == "" and texts[51] == "" and "same line" not in texts[0]
    again = only.union(only)
    assert {(r.doc_id, r.text) for r in line_templates.drop_recurrent_lines(again).collect()} == set(texts.items())


@pytest.mark.parametrize("rows", ["odd", "none", "one", "nameless"])
def test_edited_texts(spark, rows):
    small = {"none": [], "one": [(1, "abcdef")], "nameless": [(None, "abc"), (None, "xyz"), (None, None)]}
    docs = fixtures.odd_documents(spark) if rows == "odd" else fixtures.documents(spark, small[rows])
    found = sorted(digest.with_edited_texts(docs).collect(), key=repr)
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    expected = []
    import hashlib

    for k, (doc_id, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, nxt = map(digest.fingerprint, (text, edited, after))
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, digest.likeness(own, other), digest.likeness(own, nxt)))
    assert list(map(tuple, found)) == sorted(expected, key=lambda r: repr(spark_row(r)))


def spark_row(r):
    from pyspark.sql import Row

    return Row(**dict(zip(("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), r, strict=True)))


def test_likeness(spark):
    rnd = random.Random(6)
    better = 0
    for _ in range(60):
        a, b = fixtures.prose(rnd, 200), fixtures.prose(rnd, 200)
        x, y, z = digest.fingerprint(a), digest.fingerprint(a[: len(a) // 2] + b[: len(a) // 2]), digest.fingerprint(b)
        assert digest.likeness(x, x) == 1 and 0 <= digest.likeness(x, z) <= 1 and digest.likeness(x, z) == digest.likeness(z, x)
        better += digest.likeness(x, y) > digest.likeness(x, z)
    assert better >= 57
    long = "abcdefgh " * 300_000
    assert digest.bucket_counts(long.encode()).sum() == len(long) - 2
    rows = digest.digests(fixtures.odd_documents(spark)).collect()
    assert all(r.fingerprint == digest.fingerprint(r.text) for r in rows)
    assert digest.digests(fixtures.no_documents(spark).withColumn("x", F.lit(1))).count() == 0
