import random

import pytest
from pyspark.sql import functions as F

from catalink.llm.leak import leaks
from catalink.llm.mix import TOKENIZER, count_tokens, counter, mix


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rnd.randint(5, 40)))) for i in range(8)] + [(8, None), (9, "")]
    docs = []
    for k in range(40):
        own = [word() for _ in range(rnd.randint(0, 40))]
        w = items[rnd.randrange(8)][1].split()
        at, n = rnd.randint(0, max(0, len(w) - 1)), rnd.choice((8, 11, 12, 13, 20))
        docs.append((k, "! ".join(own[:10] + [x.upper() for x in w[at : at + n]] + own[10:])))
    docs += [(40, None), (41, "x"), (0, docs[0][1])]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [(t or "").lower().replace("!", "").split()] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(7))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(7))
    got = leaks(d, i).where("exact")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_two_exchanged_words_are_found_as_by_brute_force(spark, broadcast_bytes):
    rnd = random.Random(9)
    items = [(i, [f"w{rnd.randint(0, 400)}" for _ in range(30)]) for i in range(6)]
    docs = []
    for k in range(150):
        w = list(items[k % 6][1][(at := rnd.randint(0, 18)) : at + 12])
        for i in rnd.sample(range(12), rnd.randint(0, 4)):
            w[i] = "zz"
        docs.append((k, ["a"] * rnd.randint(0, 3) + w + ["b"] * rnd.randint(0, 3)))
    agree = lambda a, b: max((sum(x == y for x, y in zip(a[i : i + 12], b[j : j + 12], strict=True)) for i in range(len(a) - 11) for j in range(len(b) - 11)), default=0)
    want = {(d, i, agree(t, u)) for d, t in docs for i, u in items if agree(t, u) >= 10}
    make = lambda rows, c: spark.createDataFrame([(k, " ".join(t)) for k, t in rows], f"{c} bigint, text string")
    got = {(r.doc_id, r.item_id, r.best) for r in leaks(make(docs, "doc_id"), make(items, "item_id"), tolerated=2, broadcast_bytes=broadcast_bytes).collect()}
    assert got == want and {b for _, _, b in want} == {10, 11, 12}


def test_mix_meets_budgets(spark):
    rows = [(i, f"text number {i} of the corpus " * (1 + i % 5), "abc"[i % 3]) for i in range(300)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(2000, None, "a"), (2001, "", "a"), (2002, "alone", None), (2003, "other", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("weight", F.lit(1))
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 1), ("c", 0.05, None), ("none", 0.05, 2), (None, 1.0, 1)], "source string, target_weight double, max_repeats int")
    chosen, shares = mix(docs, targets, bucket_rows=10)
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(docs, ["doc_id"]).collect()}
    got = chosen.collect()
    by = {r.source: r for r in shares.collect()}
    total = sum(sizes.values())
    largest = max(sizes.values())
    for s in ("a", "b", "c"):
        reached = sum(r.n_tokens * r.repeats for r in got if r.source == s)
        assert reached == by[s].reached and by[s].budget == int(by[s].target_share * total)
        have = by[s].available * {"a": 3, "b": 1, "c": 1}[s]
        assert abs(reached - min(by[s].budget, have)) <= largest
    assert by["none"].reached == 0 and "z" not in {r.source for r in got}
    texts = {r[0]: r[1] for r in rows}
    used = {}
    for r in got:
        used[texts[r.doc_id]] = used.get(texts[r.doc_id], 0) + r.repeats
        assert r.n_tokens == sizes[r.doc_id] > 0
    assert max(used.values()) <= 3
    again = mix(docs.repartition(7), targets, bucket_rows=10)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    assert mix(docs.limit(0), targets)[0].count() == 0 and mix(docs, targets.limit(0))[1].count() == 0


def test_both_files_of_a_tokenizer_count_alike():
    texts = [None, "", "L’été, c'est 12 <|endoftext|> !", "  deux   blancs \n\n", "a" * 5000, "été " * 3000]
    assert counter(TOKENIZER)(texts) == counter(TOKENIZER.replace(".tiktoken", ".json"))(texts)
