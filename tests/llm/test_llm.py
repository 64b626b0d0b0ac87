"""Problems 2, 6, 7, 8 and 9 on small dirty tables, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from emberline.llm import mixing, nearest, packing, spam, tokens, topn


@pytest.mark.parametrize("seed, bucket, least", [(1, nearest.BUCKET, 50_000), (2, 5_000, 10), (3, 100, 3)])
def test_nearest_equals_brute_force(spark, rows, seed, bucket, least):
    rng = random.Random(seed)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(0, 40_000, 13)]), "clash") for i in range(400)]
    right = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 40_000, 97)]), "clash") for i in range(150)]
    right += [(1000 + i, *r[1:]) for i, r in enumerate(right[:20])]  # the same instants under higher ids
    expected = []
    for i, e, t, _ in left:
        near = [(abs(t - u), u, -j) for j, f, u, _ in right if None not in (e, t, u) and f == e and abs(t - u) <= 300]
        if near:
            d, _, j = min(near)
            expected.append((i, -j, d))
    L = spark.createDataFrame(left, "l bigint, entity string, t bigint, extra string")
    R = spark.createDataFrame(right, "r bigint, entity string, t bigint, extra string")
    assert rows(nearest.nearest_join(L, R, "l", "r", 300, bucket, least), "l", "r", "distance_us") == sorted(expected)
    assert nearest.nearest_join(L.limit(0), R, "l", "r", 300).count() == 0
    assert nearest.nearest_join(L, R.limit(0), "l", "r", 300).count() == 0


def test_of_two_equally_near_the_earlier(spark, rows):
    L = spark.createDataFrame([(1, "a", 50), (2, "a", 40)], "l bigint, entity string, t bigint")
    R = spark.createDataFrame([(7, "a", 40), (8, "a", 60)], "r bigint, entity string, t bigint")
    assert rows(nearest.nearest_join(L, R, "l", "r", 10)) == [(1, 7, 10), (2, 7, 0)]


CATALOG = "catalog_id bigint, model string, origin timestamp, duration_hours int, start_horizon int, window_start_time timestamp, predicted_window_cost double, extra string"


def test_best_windows_equal_brute_force(spark, rows):
    from datetime import datetime, timedelta, timezone

    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rng = random.Random(4)
    data = []
    for i in range(600):
        h, dur = rng.randint(1, 8), rng.randint(1, 3)
        data.append((i, rng.choice(["m", "n", None]), t0 + timedelta(hours=rng.choice([0, 24])), dur, h, t0 + timedelta(hours=h), rng.choice([1.0, 2.0, 2.0, 3.5, float("nan"), None]), "x"))
    last = {}
    for r in data:
        last[(r[1], r[2], r[4], r[3])] = max(last.get((r[1], r[2], r[4], r[3]), r), r, key=lambda x: x[0])
    expected = []
    for g in {(r[1], r[2]) for r in data}:
        own = [r for r in last.values() if (r[1], r[2]) == g and r[6] is not None and r[6] == r[6]]
        expected += [r[0] for r in sorted(own, key=lambda r: (r[6], r[5], r[3], r[0]))[:5]]
    d = spark.createDataFrame(data, CATALOG)
    assert rows(topn.best_windows(d), "catalog_id") == [(x,) for x in sorted(expected)]
    assert topn.best_windows(d.limit(0)).count() == 0
    assert "WindowGroupLimit" in topn.best_windows(d)._jdf.queryExecution().toString()


def test_token_counts_are_exact():
    c = tokens.TokenCounter()
    rng = random.Random(1)
    alphabet = ["a", "Ab", " ", "  ", "\n", "\r\n", "\t", "'s", "’", "9", "12", "é", "日本", " ", " ", "\x1c", "+=", "_", "🙂", "​", "don't"]
    texts = ["", " ", "\n\n", "x" * 200_000, " " * 5000 + "x", *("".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(2000))]
    for t in texts[:3] + texts[4:]:
        assert c.count(t) == len(c.encode(t)), repr(t)
    assert c.count(texts[3]) > 0


def test_sizes_of_null_empty_and_broken_texts(spark, rows):
    d = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (None, "x")], "doc_id bigint, text string")
    assert rows(tokens.sized(d)) == [(1, 2), (2, 0), (3, 0)]


def brute_best_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= s
        else:
            free.append(capacity - s)
    return sorted(free)


@pytest.mark.parametrize("seed", range(12))
def test_placements_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 64, 100])
    sizes = [min(capacity, max(1, int(rng.expovariate(1 / rng.choice([3, 10, 40]))))) for _ in range(rng.randint(0, 400))]
    placed, bins = packing.placements(Counter(sizes), capacity)
    free = [capacity] * bins
    for size, a, z, first, per in placed:
        for r in range(a, z):
            free[first + (r - a) // per] -= size
    assert sum(z - a for _, a, z, _, _ in placed) == len(sizes)
    assert sorted(free) == brute_best_fit(sizes, capacity)
    assert len(placed) <= 3 * capacity * np.log2(2 * capacity)


def test_packing_keeps_every_token(spark):
    rng = random.Random(6)
    data = [(i, rng.choice([0, 1, 5, 5, 5, 20, 49, 50, 51, 137, None])) for i in range(500)]
    sizes = spark.createDataFrame(data, "doc_id bigint, tokens bigint")
    classes = spark.createDataFrame([("s", 50), ("l", 200), ("bad", None)], "container_class string, capacity_tokens int")
    out = packing.pack(sizes, classes, buckets=4).collect()
    for name, capacity in (("s", 50), ("l", 200)):
        own = [r for r in out if r.container_class == name]
        total, fill = Counter(), Counter()
        for r in own:
            total[r.doc_id] += r.tokens
            if r.container_id is not None:
                fill[r.container_id] += r.tokens
        assert total == Counter({i: n or 0 for i, n in data}) and set(total) == {i for i, _ in data}
        assert max(fill.values()) <= capacity
        pieces = [p for _, n in data for p in [capacity] * ((n or 0) // capacity) + [(n or 0) % capacity] if p]
        assert len(fill) == len(brute_best_fit(pieces, capacity))
        assert all(r.tokens == capacity or r.piece == (dict(data)[r.doc_id] or 0) // capacity for r in own if (dict(data)[r.doc_id] or 0) > capacity)
    assert packing.pack(sizes.limit(0), classes).count() == 0


def documents(spark, n=600):
    rng = random.Random(9)
    names = ["forge_main", "patch_mail", "lab_notes"]
    data = []
    for i in range(n):
        k = rng.choices([0, 1, 2], [70, 25, 5])[0]
        spelled = [names[k], names[k].upper(), names[k].replace("_", "-"), f" {names[k]} ", names[k].replace("_", " ")][rng.randint(0, 4)] if rng.random() > 0.05 else None
        data.append((i, spelled, rng.choice([0, 3, 10, 50, 400]), f"{names[k]}/r", "a@x", "en", f"words of {names[k]} number {i}"))
    return spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint, repo string, author_email string, lang string, text string"), names


def test_mixture_meets_targets_within_caps(spark):
    d, names = documents(spark)
    t = spark.createDataFrame([("forge_main", 0.5, 1), ("patch-mail", 0.3, 2), ("LAB_NOTES", 0.2, 4), ("gone", None, 1)], "source_name string, target_share double, max_repeats int")
    mixed, fit = mixing.mixture(d, t)
    m = mixed.collect()
    assert fit.ended == "reached" and fit.deviation <= mixing.ACCURACY
    cap = {"forge_main": 1, "patch_mail": 2, "lab_notes": 4, None: 1}
    assert len(m) == 600 and all(0 <= r.uses <= cap[r.label] for r in m)
    used = Counter()
    for r in m:
        for n, p in zip(sorted(x for x in cap if x), r.p):
            used[n] += p * r.tokens * r.uses
    total = sum(used.values())
    shares = {n: used[n] / total for n in names}
    assert shares["forge_main"] == pytest.approx(0.5, abs=0.02) and shares["patch_mail"] == pytest.approx(0.3, abs=0.02) and shares["lab_notes"] == pytest.approx(0.2, abs=0.02)
    assert mixing.mixture(d.limit(0), t)[0].count() == 0
    assert mixing.mixture(d, t.limit(0))[0].count() == 0


def test_mixture_of_half_unlabelled_documents_and_a_hot_source(spark):
    d, names = documents(spark)
    # of each source every second document has lost its label; nine of ten tokens are one source's
    d = d.withColumn("source", mixing.F.when(d.doc_id % 2 == 0, d.source)).withColumn("tokens", mixing.F.when(mixing.F.col("repo") == "forge_main/r", d.tokens * 20).otherwise(d.tokens))
    t = spark.createDataFrame([("forge_main", 0.5, 1), ("patch_mail", 0.3, 2), ("lab_notes", 0.2, 4)], "source_name string, target_share double, max_repeats int")
    mixed, fit = mixing.mixture(d, t)
    r = {x.source: x for x in mixing.reached_shares(mixed, fit, t).collect()}
    assert fit.ended == "reached" and fit.deviation <= mixing.ACCURACY and fit.iterations < mixing.ITERATIONS
    assert all(abs(x.expected_share - x.target_share) < 0.1 for x in r.values())  # whole uses of few large documents
    m = mixed.collect()
    rated = [sum(x.p[i] * x.tokens * x.rate for x in m) for i in range(3)]
    assert np.allclose(np.array(rated) / sum(rated), [0.5, 0.2, 0.3], atol=1e-4)
    assert len(m) == 600 and all(0 <= x.uses <= x.cap for x in m)
    # the unlabelled documents' tokens count: at least what the labelled ones of the scarcest source allow
    assert fit.total >= sum(x.tokens * 4 for x in m if x.label == "lab_notes") / 0.2


def test_a_total_out_of_reach_ends_at_the_optimum(spark):
    g = [(1, "a", None, [1.0, 0.0], 1, 100.0), (2, "b", None, [0.0, 1.0], 2, 10.0), (3, None, 30, [0.5, 0.5], 1, 30.0), (4, None, 20, [0.9, 0.1], 1, 20.0)]
    groups = spark.createDataFrame(g, mixing.GROUP).coalesce(1)
    shares = np.array([0.5, 0.5])
    mass, own, most = mixing.reachable(groups, shares)
    assert (list(mass), own, most) == ([133.0, 27.0], 40.0, 74.0)
    rates, fit = mixing.fit_rates(groups, shares, mass, 60.0)
    assert fit.ended == "reached" and fit.deviation <= mixing.ACCURACY
    rates, far = mixing.fit_rates(groups, shares, mass, 200.0)
    r = {x.doc_id: x.rate for x in rates.collect()}
    assert far.ended == "optimum" and far.deviation == pytest.approx((100 - 37) / 200, abs=1e-3) and (r[2], r[3], r[4]) == (2.0, 1.0, 1.0) and r[1] == pytest.approx(0.67, abs=0.01)


def test_posteriors_find_the_source(spark):
    d, names = documents(spark)
    labelled = d.withColumn("label", mixing.F.when(d.doc_id % 10 != 0, mixing.source_name("source")))
    p = {r.doc_id: r.p for r in mixing.posteriors(labelled, sorted(names)).filter("label is null").collect()}
    truth = {r.doc_id: r.repo.split("/")[0] for r in d.collect()}
    hits = [sorted(names)[int(np.argmax(v))] == truth[i] for i, v in p.items()]
    assert np.mean(hits) > 0.9 and all(abs(sum(v) - 1) < 1e-6 for v in p.values())


PROSE = "This keeps the meter in step with the queue when a late reading shows up after the run.\nTests now cover an empty queue and the case where both of the jobs are absent.\nWe used to read the meter twice; reading it once saves a lot of time for each of the runs."
GOOD = {
    1: "Fix the meter\n\n" + PROSE + "\n\ndiff --git a/a.py b/a.py\n@@ -1,2 +1,2 @@\n-x = 1\n+x = read(queue)\n",
    2: "Update lock\n\n+++ b/package-lock.json\n" + "\n".join(f'+    "dep-{i}": {{"version": "1.{i}.0", "resolved": "https://index.corp.example/dep-{i}.tgz"}}' for i in range(40)),
    3: "Extend dictionary\n\ndiff --git a/w.txt b/w.txt\n@@ -0,0 +1,40 @@\n" + "\n".join(f"+word{chr(97 + i)}{chr(97 + j)}x" for i in range(6) for j in range(6)),
    4: "Add docs index\n\n" + "\n".join(f"* [Page {i}](https://docs.corp.example/p/{i}) - Where to look when the queue of the meter is empty and why it may not be read." for i in range(12)),
    5: "Filter adverts\n\nA typical one offers \"car rental\" at http://tap-deal.example and nothing else.\n" + PROSE,
    6: "", 7: None, 8: "x",
}
BAD = {
    11: "add page\n\n" + "\n".join("cheap lamps | car rental | cheap lamps | free spins | car rental" for _ in range(8)),
    12: "update\n\n" + "\n".join(f"http://www.lamp-{w}.example/buy/{i}.html" for i, w in enumerate("deal top best pro club shop mega store".split())),
    13: "new page\n\n" + "\n".join("#CarRental #LampGold #CarRental #FreeSpins #ShoeRed #CarRental" for _ in range(5)),
    14: "add content\n\n" + "fr33 5p1n5 ch34p l4mp5 fr33 5p1n5 ch34p l4mp5 fr33 5p1n5\n" * 6,
    15: "add content\n\n" + "сhеар lаmрs саr rеntаl сhеар lаmрs сhеар lаmрs саr rеntаl\n" * 6,
    16: "x\n\n" + "c h e a p  l a m p s  c h e a p  l a m p s  c h e a p  l a m p s\n" * 5,
    17: "y\n\n" + "Order car rental, cheap lamps & car rental today!\nGet cheap lamps, free spins or car rental now\n" * 6,
    18: "commit 0123456789012345678901234567890123456789\nAuthor: A <a@b.example>\nDate: x\n\n    add\n\ndiff --git a/i.html b/i.html\n@@ -0,0 +1,9 @@\n" + "+sac de luxe soldes near Karve\n+sac de luxe soldes - Ostmar\n" * 5,
}


def test_spam_pages(spark, rows):
    docs = [*GOOD.items(), *BAD.items(), (None, BAD[11]), *((100 + i, f"Change {i}\n\n" + PROSE) for i in range(60))]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, filler string")
    assert [r[0] for r in rows(spam.spam_pages(d), "doc_id")] == sorted(BAD)
    assert spam.spam_pages(d.limit(0)).count() == 0


def test_priced_labelled_and_long_stuffed_lines_are_scored_and_found(spark, rows):
    bad = {
        21: "add page\n\n" + "Cheap lamps 9.99, car rental 19.99, cheap lamps 4.99, free spins 1.50, car rental 8.99\n" * 6,
        22: "add page\n\n" + "Keywords: cheap lamps, car rental, cheap lamps, free spins, car rental\n" * 6,
        23: "add page\n\n" + "cheap lamps -50%, car rental -20%, cheap lamps -10%, free spins\n" * 6,
        24: "add page\n\n" + "Order the cheap lamps and the car rental for free spins or a cheap lamps deal with the car rental and free spins in your town, get cheap lamps now or the car rental of free spins with our cheap lamps.\n" * 4,
    }
    good = {
        31: "Add stock\n\n" + "\n".join(f"+a{i}f{i},teal lamp strip,{i},9.{10 + i},bin-{i}" for i in range(20)),
        32: "Cover it\n\n" + "Tests now cover an empty queue and the case where the meter is absent. We read the meter twice and that takes time for the runs. " * 2,
    }
    docs = [*bad.items(), *good.items(), *((100 + i, f"Change {i}\n\n" + PROSE) for i in range(60))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert [r[0] for r in rows(spam.spam_pages(d), "doc_id")] == sorted(bad)


def judged(text, model, least=0.0):
    d, wording = spam.read([text])
    return [x[0] for x in spam.judge(d, wording, 1, model, least)]


def test_very_long_texts_take_linear_time():
    import time

    model = spam.ProseModel(np.ones((2, spam.SIZE**3), dtype="int64"))
    began = time.time()
    for unit in ("<a ", "<a", "a", "a ", "- ", "a-", "http://a.b ", "| a ", "#a ", "\n", "a b c d e f ", "+x = 1\n", ", "):
        judged("http://x.y " + unit * (300_000 // len(unit)), model)
    assert time.time() - began < 60


def prose_model(seed=3):
    """A model of two halves of the same kind of prose, and one of the same counts in random order."""
    halves = np.zeros((2, spam.SIZE**3), dtype="int64")
    for h in (0, 1):
        d, _ = spam.read([PROSE] * 60)
        k, line = d.trigrams()
        np.add.at(halves[h], k[d.prose()[line]], 1)
    return spam.ProseModel(halves), spam.ProseModel(np.random.default_rng(seed).permutation(halves, axis=1))


def test_the_prose_model_decides():
    model, shuffled = prose_model()
    pages = [BAD[i] for i in sorted(BAD)]
    assert all(judged(p, model)[0] >= spam.MOSTLY for p in pages)
    # to a model for which such lines are as usual as any other nothing is abnormal
    flat = spam.ProseModel(np.zeros((2, spam.SIZE**3), dtype="int64"))
    flat.surprise, flat.mean, flat.deviation = np.ones_like(flat.surprise), 1.0, 1.0
    assert [judged(p, flat)[0] for p in pages] == [0.0] * len(pages)
    text = PROSE + "\n" + PROSE
    scores = [m.standard(*m.over(spam.read([text])[0])) for m in (model, shuffled)]
    assert np.abs(scores[0]).max() < np.abs(scores[1]).max()


def test_short_and_long_pages_are_judged_alike():
    model, _ = prose_model()
    line = "cheap lamps | car rental | cheap lamps | free spins | car rental"
    assert all(judged("add page\n\n" + "\n".join([line] * n), model)[0] >= spam.MOSTLY for n in (1, 2, 3, 40, 4000))
    long_tag = "<span style='" + "x" * 5000 + "'>"
    assert judged("add page\n\n" + "\n".join(f"{long_tag}http://www.lamp-{w}.example/buy" for w in "a b c d".split()), model)[0] > 0.9


def test_runs_of_any_length_have_classes_of_their_own():
    k = spam.classed([f"zq{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000)], np.zeros(5000, dtype="int64"))
    assert len(set(k)) == 6 + 10 and (np.diff(k) >= 0).all()


def test_lines_come_back_from_their_arrays(spark):
    texts = [*GOOD.values(), *BAD.values(), "\x0b a\x85b\n\nq r s t", "é日本 #a #b\n- - - -"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pdf = spam.lines_of(d).toPandas().sort_values("doc_id").reset_index(drop=True)
    own, wording = spam.read(["" if t is None else t for t in texts])
    [(_, back, kept)] = list(spam._joined(pdf))
    for c in ("text", "kind", "chars", "size", "ids"):
        assert (getattr(own, c) == getattr(back, c)).all(), c
    assert all(k is None or k == w for k, w in zip(kept, wording)) and sum(k is not None for k in kept) == ((own.kind != spam.CODE_LINE) & (own.kind != spam.SAYING)).sum()


def test_content_leaves_headers_and_signs_out():
    text = "From 0123456789012345678901234567890123456789 Mon Sep 17 00:00:00 2001\nFrom: A <a@b.c>\nSubject: [PATCH] Fix it\n---\n 2 files changed\n\ndiff --git a/x b/x\nindex 012..345 100644\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-old words\r\n+new words\n same"
    assert spam.content(text) == ["Fix it", "old words", "new words", "same"]
