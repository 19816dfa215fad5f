import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from adlytics.llm import op4_jaccard_join as op
from adlytics.llm.components import components
from .helpers import documents, rng, vocabulary, with_clashes, words


def brute(rows, rule):
    sets = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        w = rule.words
        sets.append({tuple(ws[j:j + w]) for j in range(len(ws) - w + 1)} if len(ws) >= w else ({tuple(ws)} if ws else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared, by = defaultdict(int), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    for ids in by.values():
        for a, b in itertools.combinations(ids, 2):
            shared[a, b] += 1
    for (a, b), c in shared.items():
        if rule.den * c >= rule.num * (len(sets[a]) + len(sets[b]) - c):
            parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = d if least[r] is None else min(least[r], d)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def rows():
    r = rng(7)
    voc = vocabulary(r)
    out = []
    for _ in range(50):
        base = words(r, r.choice([1, 2, 3, 5, 8, 12, 20, 40, 100, 300]), voc).split()
        for _ in range(r.randint(1, 12)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                if t:
                    k = r.randrange(len(t))
                    if r.random() < .5:
                        t[k] = r.choice(voc)
                    else:
                        del t[k]
            out.append(" ".join(t))
    passage = words(r, 40, voc)
    out += [passage + " " + words(r, r.randint(1, 30), voc) for _ in range(120)]  # a passage many share
    out += [None, "", " \n ", "a", "A", "a b", "A  b", words(r, 20_000, voc)]
    data = list(enumerate(out))
    return data + [(3, out[3]), (4, out[9]), (None, out[0])]


AGAIN = op.Rule(5, 8, 10, 2, 50, again=op.Rule(5, 8, 10, 5, 30, leave=2))


@pytest.mark.parametrize("rule", [op.Rule(), op.Rule(5, 8, 10, 2, 50), op.Rule(1, 8, 10, 3), AGAIN])
def test_equals_brute_force(spark, rule):
    data = rows()
    got = [tuple(x) for x in op.jaccard_join(with_clashes(documents(spark, data)), rule).collect()]
    assert sorted(got, key=str) == brute(data, rule)


@pytest.mark.parametrize("hot, block, spare, again", [
    (1, 300, 50, None), (2, 1000, 0, None), (8, 10 ** 9, 100, None), (10 ** 9, 300, 30, None),
    (1, 300, 0, op.Rule(2, 8, 10, 5, 30, leave=2)), (2, 1000, 20, op.Rule(2, 8, 10, 4, 0, leave=3))])
def test_hot_buckets_and_blocks(spark, monkeypatch, hot, block, spare, again):
    """Results do not depend on what counts as hot, nor on the blocks."""
    monkeypatch.setattr(op, "HOT", hot)
    monkeypatch.setattr(op, "BLOCK", block)
    data = rows()
    rule = op.Rule(2, 8, 10, 2, spare, again=again)
    got = [tuple(x) for x in op.jaccard_join(documents(spark, data), rule).collect()]
    assert sorted(got, key=str) == brute(data, rule)


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(2)
    rule = op.Rule(5, 8, 10, 2, 50)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = r.integers(0, 2 ** 64, n, dtype=np.uint64)
        k = int(r.integers(0, max(1, n // 9 + 1)))
        b = np.unique(np.concatenate([a[k:], r.integers(0, 2 ** 64, k, dtype=np.uint64)]))
        a = np.unique(a)
        c = len(np.intersect1d(a, b))
        if c * 10 >= 8 * (len(a) + len(b) - c):
            sig, of, _ = op.signatures([a, b], rule, op.band_edges())
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())
            apart = np.abs(np.frombuffer(op.sketch(a), np.uint8).astype(int) - np.frombuffer(op.sketch(b), np.uint8)).sum()
            assert apart <= len(a) + len(b) - 2 * c


@pytest.mark.parametrize("rule", [op.Rule(5, 8, 10, 2, 50), op.Rule(3, 9, 10, 2, 100), op.Rule(3, 9, 10, 3, 100),
                                  op.Rule(5, 8, 10, 5, 30, leave=2)])
def test_light_and_hot_share_the_spare_partitions(rule):
    """Whatever buckets are hot, more partitions hold a common signature than either set may drop."""
    r = np.random.default_rng(5)
    checked = 0
    for _ in range(3000):
        n = int(r.integers(60, 500))
        common = r.integers(0, 2 ** 64, n, dtype=np.uint64)
        differ = n * (rule.den - rule.num) // rule.num  # of both sets together
        k = int(r.integers(0, differ + 1))
        a, b = (np.unique(np.concatenate([common, r.integers(0, 2 ** 64, x, dtype=np.uint64)])) for x in (k, differ - k))
        key, of, fifteenths = op.signatures([a, b], rule, op.band_edges())
        spare = op.layout(op.band_edges(), rule)[2]
        shared = np.intersect1d(key[of == 0], key[of == 1])
        for band in np.unique((shared >> np.uint64(13)) & np.uint64(63)).tolist():
            here = ((key >> np.uint64(13)) & np.uint64(63)) == band
            parts = len(np.unique(shared[((shared >> np.uint64(13)) & np.uint64(63)) == band] & np.uint64(0x1FFF)))
            left = max(int(fifteenths[here & (of == i)].max()) * int(spare[band]) // 15 for i in (0, 1))
            if max(len(a), len(b)) < op.band_edges()[band + 1] and max(len(a), len(b)) >= op.band_edges()[band]:
                assert parts > left
                checked += 1
    assert checked > 1000


def test_one_text_a_class_without_ids(spark, monkeypatch):
    """Classes without an id fetch their own text, not that of every row without one."""
    r = rng(12)
    voc = vocabulary(r)
    texts = [words(r, 60, voc) for _ in range(12)]
    data = [(None, t + end) for t in texts for end in ("", " end")] + [(None, texts[0])]
    plain, met = op.shingle_sets, []
    monkeypatch.setattr(op, "shingle_sets", lambda texts, rule: met.append(texts.count()) or plain(texts, rule))
    rule = op.Rule(5, 8, 10, 2)
    got = [tuple(x) for x in op.jaccard_join(documents(spark, data), rule).collect()]
    assert sorted(got, key=str) == brute(data, rule) and met == [24]


def test_empty_table_and_no_links(spark):
    assert op.jaccard_join(documents(spark, [])).count() == 0
    got = [tuple(x) for x in op.jaccard_join(documents(spark, [(2, "a b c d"), (1, "e f g h"), (3, None)])).orderBy("doc_id").collect()]
    assert got == [(1, 2, 1), (2, 2, 2), (3, 0, 3)]


def test_keep_one(spark):
    r = rng(9)
    voc = vocabulary(r)
    a, b = words(r, 60, voc), words(r, 60, voc)
    data = [(5, a), (2, a + " end"), (9, b), (9, b), (4, None), (4, None), (7, "")]
    kept = sorted((x.doc_id, x.text) for x in op.keep_one(documents(spark, data), op.Rule(5, 8, 10, 2)).collect() if x.text)
    assert kept == [(2, a + " end"), (9, b)]
    assert sorted(x.doc_id for x in op.keep_one(documents(spark, data), op.Rule(5, 8, 10, 2)).collect()) == [2, 4, 7, 9]


def test_keep_one_null_and_repeated_ids(spark):
    """Nulls and ids that repeat decide by row, not for all rows of the id."""
    r = rng(10)
    voc = vocabulary(r)
    a, b, c, d, e = (words(r, 60, voc) for _ in range(5))
    data = [(5, a), (None, a + " end"),              # linked with an id: goes
            (None, b), (None, b + " end"),           # linked with each other: the first text stays
            (None, c), (None, c), (None, None), (None, None), (None, ""),
            (7, d), (7, e), (3, d + " end")]         # one text of 7 goes, the other stays
    docs = documents(spark, data)
    kept = [(x.doc_id, x.text) for x in op.keep_one(docs, op.Rule(5, 8, 10, 2)).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (None, b), (None, c), (None, None), (None, ""), (7, e), (3, d + " end")], key=str)
    blank = documents(spark, [(None, None)] * 2).unionByName(documents(spark, [(None, None)]).replace("s", "other", "source"))
    assert op.keep_one(blank, op.Rule(5, 8, 10, 2)).count() == 2


def test_components(spark):
    r = rng(11)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 6000 + i) for i in range(100)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    loops = {a for a, b in pairs if a == b}
    assert all(got[x] == find(x) for x in parent if x in got)
    assert set(parent) - set(got) <= loops


@pytest.mark.parametrize("rule", [op.Rule(5, 8, 10, 5, 30, leave=2), op.Rule(5, 8, 10, 3, 20)])
def test_turns_deal_out_the_signatures(rule):
    """The turns have all signatures, each once, and none has more than its share of them."""
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 2 ** 64, n, dtype=np.uint64)) for n in (1, 2, 4, 30, 200, 700)]
    n = op.turns(rule)
    parts = [op.signatures(sets, rule, op.band_edges(), t, n) for t in range(n)]
    every = sorted(zip(*(x.tolist() for x in op.signatures(sets, rule, op.band_edges()))))
    assert sorted(y for p in parts for y in zip(*(x.tolist() for x in p))) == every and len(set(every)) == len(every)
    subsets = len(list(itertools.combinations(range(rule.cells), rule.leave)))
    assert all(len(p[0]) <= len(every) * (op.SUBSETS + .5) / subsets for p in parts)


def test_second_signatures_are_shuffled_in_turns(spark, monkeypatch):
    """No shuffle has all signatures of a rule with many subsets."""
    r = rng(14)
    voc = vocabulary(r)
    passage = words(r, 300, voc)
    data = [(i, passage + " " + words(r, 10, voc)) for i in range(12)]
    plain, met = op.signature_rows, []
    monkeypatch.setattr(op, "signature_rows", lambda docs, rule, *turn: met.append((rule, turn)) or plain(docs, rule, *turn))
    op.jaccard_join(documents(spark, data), AGAIN).collect()
    assert met == [(AGAIN, (0, 1))] + [(AGAIN.again, (t, 4)) for t in range(4)]


def test_sketches_of_long_sets():
    """Unrelated sets are ruled out whatever their size; the bound holds where the sketches differ in length."""
    r = np.random.default_rng(8)
    for n in (300, 1500, 6000, 40_000):
        a, b = (np.unique(r.integers(0, 2 ** 64, n, dtype=np.uint64)) for _ in range(2))
        assert op.sketches_apart([op.sketch(a)], [op.sketch(b)])[0] > 2 * n * 2 // 18
    ones, twos, most = [], [], []
    for n in (200, 1020, 1024, 2040, 5000, 9000) * 3:
        common = r.integers(0, 2 ** 64, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, r.integers(0, 2 ** 64, int(x), dtype=np.uint64)])) for x in (r.integers(0, 9), r.integers(0, n // 5)))
        ones.append(op.sketch(a))
        twos.append(op.sketch(b))
        most.append(len(a) + len(b) - 2 * n)
    assert any(len(x) != len(y) for x, y in zip(ones, twos))
    assert (op.sketches_apart(ones, twos) <= most).all() and (op.sketches_apart(twos, ones) <= most).all()
    assert len(op.sketches_apart([], [])) == 0


@pytest.mark.parametrize("rule", [op.Rule(5, 8, 10, 2, 0), AGAIN])
def test_shared_passages_make_no_family(spark, monkeypatch, rule):
    """Texts that share a passage and are not similar are not compared with one another."""
    r = rng(15)
    voc = vocabulary(r, 2000)
    passage = words(r, 150, voc)
    data = [(i, passage + " " + words(r, 100, voc)) for i in range(30)]
    data += [(100, data[3][1] + " end")]
    plain, met = op.family_links, []
    monkeypatch.setattr(op, "family_links", lambda sets, family, rule: met.append(family.count()) or plain(sets, family, rule))
    got = [tuple(x) for x in op.jaccard_join(documents(spark, data), rule).collect()]
    assert sorted(got, key=str) == brute(data, rule) and met == [2]


def test_long_texts_that_share_words(spark, monkeypatch):
    """Long texts with common shingles make no family, and near copies of them are found."""
    r = rng(16)
    voc = vocabulary(r, 40)
    data = [(i, words(r, 4000, voc)) for i in range(12)]
    data += [(20, data[5][1] + " end of it"), (21, " ".join(data[7][1].split()[300:]))]
    plain, met = op.family_links, []
    monkeypatch.setattr(op, "family_links", lambda sets, family, rule: met.append(family.count()) or plain(sets, family, rule))
    rule = op.Rule(3, 8, 10, 2, 50)
    got = [tuple(x) for x in op.jaccard_join(documents(spark, data), rule).collect()]
    assert sorted(got, key=str) == brute(data, rule) and met == [4]
