"""Leaked passages, against the definition and over errors at every place."""

import numpy as np

from tagloom.llm import leakage


def _holds(item: list[str], doc: list[str]) -> bool:
    """The definition by brute force: some twelve words or more in a row of the item within one word in eight of some words of the document."""
    for a in range(len(item)):
        for b in range(a + 12, min(len(item), a + 24) + 1):
            e = (b - a) // 8
            for c in range(len(doc)):
                if doc[c] == item[a]:
                    for d in range(c + b - a - e, min(len(doc), c + b - a + e) + 1):
                        if d > c and doc[d - 1] == item[b - 1] and leakage.edit_distance(item[a:b], doc[c:d], e) <= e:
                            return True
    return False


def test_leaks(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(5, 9))) for _ in range(400)]
    items = [(i, list(rng.choice(vocabulary, 40))) for i in range(6)]
    docs = []
    for k in range(60):
        words = list(rng.choice(vocabulary, 50))
        src = items[k % 6][1]
        n = int(rng.choice([6, 8, 14, 18, 24]))
        cut = src[5 : 5 + n]
        if k % 3 == 1:
            cut[n // 2] = "zzzzz"
        if k % 3 == 2:
            del cut[n // 2]
        docs.append((k, words[:20] + cut + words[20:]))
    d = spark.createDataFrame([(k, "  ".join(w).upper() + ".") for k, w in docs] + [(900, None), (901, ""), (902, " . ")], "doc_id long, text string")
    i = spark.createDataFrame([(k, ", ".join(w)) for k, w in items] + [(90, None), (91, "too short")], "item_id long, text string")
    want = {(k, j) for k, w in docs for j, it in items if _holds(it, w)}
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == want
    assert {tuple(r) for r in leakage.leaks(d, i, block=700).collect()} == want and len(want) > 20
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def _leaked(spark, items, docs):
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string").repartition(4)
    return {tuple(r) for r in leakage.leaks(d, i).collect()}


def test_leaks_recall_at_every_place(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 11))) for _ in range(900)]
    items = [(i, list(rng.choice(vocabulary, 90))) for i in range(20)]
    docs, want = [], set()
    for k in range(1500):
        own = items[k % 20][1]
        n = int(rng.integers(12, 41))
        a = int(rng.integers(0, 90 - n))
        cut = own[a : a + n]
        for at in sorted(rng.choice(np.arange(1, n - 1), int(rng.integers(0, n // 8 + 1)), replace=False).tolist(), reverse=True):
            cut[at : at + 1] = [["zz"], ["zz", cut[at]], []][int(rng.integers(3))]
        filler = list(rng.choice(vocabulary, 30))
        docs.append((k, filler[:15] + cut + filler[15:]))
        want.add((k, k % 20))
    got = _leaked(spark, items, docs)
    assert len(want & got) >= 0.99 * len(want) and len(got - want) < 5


def test_leaks_with_an_error_near_an_end(spark):
    item = "pump casing shall withstand pressure during every hydraulic test without leak ab".split()
    docs = [(k, [*item[:k], "zzz", *item[k + 1 :]]) for k in range(1, 11)] + [(50, ["zzz", *item[1:]]), (51, [*item[:4], "zzz", *item[5:9], "yyy", *item[10:]])]
    assert _leaked(spark, [(1, item)], docs) == {(k, 1) for k in range(1, 11)}
    long_word = "to be in an old of electroencephalographically is at by so measured".split()
    assert _leaked(spark, [(1, long_word)], [(1, [*long_word[:6], "zzz", *long_word[7:]])]) == {(1, 1)}


def test_leaks_in_scripts_without_spaces(spark):
    item = "泵壳在每次水压试验期间应承受压力而不泄漏并记录读数"
    docs = [(1, ["说明", item[3:18], "结束"]), (2, [item[:6], "别的", item[12:18]]), (3, [item[2:9] + "误" + item[10:16]])]
    assert _leaked(spark, [(1, [item])], docs) == {(1, 1), (3, 1)}


def test_leaks_of_a_last_item_to_its_end(spark):
    words = "pump casing shall withstand pressure during every hydraulic test without leakage whatsoever".split()
    for more in range(4):  # one of these ends with an indexed q-gram
        item = [*words[:-1], words[-1] + "abc"[:more]]
        assert _leaked(spark, [(1, item)], [(1, item), (2, ["before", *item]), (3, [*item, "after"]), (4, item[:11])]) == {(1, 1), (2, 1), (3, 1)}
