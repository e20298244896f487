import random

import pytest

from hashloom.llm import leaks, packing, spam
from hashloom.llm.words import words

D = "doc_id bigint, text string, lang string"
I = "item_id bigint, text string, doc_id string"


def test_words():
    assert words(None) == words("") == []
    assert words("A&amp;B <b>c</b>[quote=x]d[/quote] naïve s­of​t &amp;lt;i") == ["a", "b", "c", "d", "na", "ve", "soft", "lt", "i"]
    assert words("&lt;br&gt;x") == ["x"] and words("1 < 2 and 3 > 2") == ["1", "2", "and", "3", "2"]


def _leaks_brute(docs, items, n=12):
    grams = {}
    for i, t, _ in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t, _ in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 30, 60]))), "x") for i in range(30)]
    items += [(100, items[3][1] + " more words", "x"), (101, None, "x"), (102, "", "x")]
    docs = []
    for d in range(200):
        text = " ".join(rng.choice(vocabulary + ["zzz"]) for _ in range(rng.randrange(60)))
        if d % 3 == 0:
            w = items[d % 30][1].split()
            a = rng.randrange(len(w))
            text += " <b>" + " ".join(w[a : a + rng.choice([11, 12, 13, 40])]) + "</b> " + text
        docs.append((d, text, "en"))
    docs += [(500, None, "en"), (501, "", "en"), (None, items[5][1] + " " + items[7][1], "en"), (7, docs[6][1], "en")]
    df, it = spark.createDataFrame(docs, D), spark.createDataFrame(items, I)
    want = _leaks_brute(docs, items)
    for k, (build, search) in enumerate((({}, {}), ({"shard_words": 50}, {}), ({}, {"block_words": 400}))):
        kept = leaks.TrainingSuffixes(spark, f"{tmp_path}/{k}")
        assert not kept.built() and kept.build(df, **build).built()
        got = kept.search(it, **search).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            doc, item = words(docs[r.doc_id][1]), words(next(t for i, t, _ in items if i == r.item_id))
            a, b, n = r.doc_word, r.item_word, r.n_words
            assert n >= 12 and doc[a : a + n] == item[b : b + n]
            assert doc[a + n : a + n + 1] != item[b + n : b + n + 1] or a + n == len(doc)
    later = leaks.TrainingSuffixes(spark, f"{tmp_path}/0")  # another test set, the same shards
    other = [i for i in items if i[0] in (4, 5)]
    assert {(r.doc_id, r.item_id) for r in later.search(spark.createDataFrame(other, I)).collect()} == {w for w in want if w[1] in (4, 5)}
    clean = leaks.without_leaks(df.select("doc_id"), later.search(it))
    assert {r.doc_id for r in clean.collect()} == {d for d, *_ in docs if d is None or all(d != w for w, _ in want)}


def test_leaks_empty(spark, tmp_path):
    docs, items = spark.createDataFrame([], D), spark.createDataFrame([], I)
    one = spark.createDataFrame([(1, "a " * 20, "x")], I)
    nothing = leaks.TrainingSuffixes(spark, f"{tmp_path}/0").build(docs)
    assert nothing.search(items).count() == 0 and nothing.search(one).count() == 0
    repeated = leaks.TrainingSuffixes(spark, f"{tmp_path}/1").build(spark.createDataFrame([(1, "a " * 500, "x")], D))
    assert [(r.doc_id, r.item_id, r.n_words) for r in repeated.search(one).collect()] == [(1, 1, 20)]
    repeated.drop()
    assert not repeated.built()


def test_suffixes_are_in_order():
    rng = random.Random(1)
    docs = [[rng.choice("ab") for _ in range(rng.randrange(1, 40))] for _ in range(40)] + [["a"] * 60] * 3 + [["c", "a", "b"] * 30] * 2
    shard = leaks.shard_of(list(range(len(docs))), docs, 2).iloc[0]
    import numpy as np

    text, order = np.frombuffer(shard["text"], np.int32), np.frombuffer(shard["suffixes"], np.int32)
    ends = np.flatnonzero(text == 0)
    rest = [tuple(text[p : ends[np.searchsorted(ends, p)]].tolist()) for p in order]
    assert rest == sorted(rest) and len(rest) == sum(max(0, len(d) - 1) for d in docs) and len(set(order.tolist())) == len(order)


def test_a_passage_that_all_share_stays_small():
    """Each of 700 posts holds each of 700 items' common preamble: 490,000 results, extended a slice at a time."""
    import tracemalloc

    preamble = [f"p{i}" for i in range(12)]
    docs = [[*preamble, f"d{d}", "x", "y"] for d in range(700)]
    items = [(i, [*preamble, f"i{i}", "z"]) for i in range(700)]
    shard, tests = leaks.shard_of(list(range(700)), docs).iloc[0], leaks.TestSuffixes(items)
    assert len(tests.windows) == 1 + 2 * 700
    tracemalloc.start()
    rows = most = 0
    for part in leaks.search_shard(shard, tests, 1 << 14):
        rows, most = rows + len(part), max(most, len(part))
        assert (part["n_words"] == 12).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 490_000 and most <= (1 << 14) + 700 and peak < 60e6


def _check_packing(rows, sizes, capacity):
    placed = {}
    spaces = {}
    for r in rows:
        placed.setdefault(r.item_id, []).append(r)
        spaces.setdefault(r.container, []).append((r.start, r.start + r.n))
    for spans in spaces.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))  # a window may leave some of its length
    for i, n in sizes.items():
        own = placed.pop(i)
        assert sum(r.n for r in own) == n and (len(own) == 1 or n > capacity)
        assert sum(r.n == capacity for r in own) >= len(own) - 1
    assert not placed
    return len(spaces)


def test_packing(spark):
    rng = random.Random(8)
    sizes = {i: rng.choice([1, 3, rng.randrange(1, 60), rng.randrange(1, 101), 100, rng.randrange(100, 450)]) for i in range(3000)}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()] + [(9001, None, "x"), (9002, 0, "x")], "id bigint, n int, start string")
    rows = packing.pack(df, "id", "n", 100, salts=3, step=4).collect()
    used = _check_packing(rows, sizes, 100)
    assert used <= 1.01 * sum(sizes.values()) / 100 + 1
    steps = {}
    for r in rows:
        steps.setdefault(r.step_group, set()).add(r.container)
    assert max(map(len, steps.values())) <= 4
    assert {r.tier for r in rows} == {25, 50, 100} == {r.window for r in rows} and all(r.n <= r.tier <= r.window for r in rows)
    assert all(r.start % r.window + r.n <= r.window for r in rows) and any(r.tier < r.window for r in rows)
    assert packing.pack(df.where("false"), "id", "n", 100).count() == 0


def test_packing_one_hot_size(spark):
    df = spark.range(0, 5000).selectExpr("id", "7 as n")
    used = _check_packing(packing.pack(df, "id", "n", 100).collect(), {i: 7 for i in range(5000)}, 100)
    assert used == -(-5000 // 14)


def test_layouts_use_all_counts():
    counts = {1: 5, 40: 7, 61: 3, 100: 2, 33: 50}
    left = dict(counts)
    for many, length, layout in packing.pack_counts(counts, 100):
        assert sum(s * u for s, u in layout.items()) <= length
        for s, u in layout.items():
            left[s] -= many * u
    assert not any(left.values())


def _documents(n=20_000):
    """Log-normal sizes, as counts."""
    import numpy as np

    sizes = np.minimum(2048, np.maximum(1, np.random.default_rng(4).lognormal(5, 1.2, n).astype(int)))
    return dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))


def test_tiers_have_windows_of_their_own():
    counts = _documents()
    assert packing.tier_lengths(2048) == [256, 512, 1024, 2048] and packing.tier_lengths(100) == [25, 50, 100]
    layouts = {t: packing.pack_counts(counts, 2048, list(t)) for t in ((2048,), (1024, 2048), (256, 512, 1024, 2048))}
    for tiers, found in layouts.items():
        assert {length for _, length, _ in found} == set(tiers)
        own = 0
        for many, length, layout in found:
            # a window is opened by an item of its own tier, unless a longer one is filled better
            own += many * (max(layout) > max((t for t in tiers if t < length), default=0))
            assert sum(s * u for s, u in layout.items()) <= length
        assert own > 0.9 * sum(many for many, *_ in found)
    assert any(len({next(t for t in (256, 512, 1024, 2048) if s <= t) for s in layout}) > 1 for _, length, layout in layouts[256, 512, 1024, 2048] if length == 2048)
    assert layouts[2048,] != layouts[1024, 2048] != layouts[256, 512, 1024, 2048]
    total = sum(s * n for s, n in counts.items())
    for found in layouts.values():
        used = -(-sum(many * length for many, length, _ in found) // 2048)
        assert used <= -(-total // 2048) * 1.0005 + 1
    with pytest.raises(ValueError):
        packing.pack_counts(counts, 2048, [100, 2048])


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|>", "x")], D)
    got = {r.doc_id: r.tokens for r in packing.token_counts(df, "doc_id", "text", "/opt/tokenizers").collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] > 1


def test_own_text():
    assert spam.own_text("bob wrote:\n> old\n> older\n\nnew\n-- \nbob") == "new"
    assert spam.own_text("[quote=a][quote=b]x[/quote]y[/quote]mine") == "mine"
    assert spam.own_text("[quote=a][quote=b]cut off[/quote]\nmine") == "mine"
    assert spam.own_text("<blockquote>&gt; x</blockquote>mine<hr>sig") == "mine"
    assert spam.own_text("> only\n> quoted") == ""
    assert spam.own_text("mine\n[size=1]me | www.x.example/p/1[/size]") == "mine"


def _prose(rng):
    noun = lambda: rng.choice(["pump", "ladder", "oven", "crank", "hose", "lens"])
    forms = ["The trick with the {} is patience and a clean {}.", "If the {} gets stuck, stop and check the {}.", "Whoever designed this {} never held a {}.", "I was told the {} must be greased twice before the {} goes in.", "We ran out of daylight, so the {} has to wait for the {} until next month."]
    return " ".join(rng.choice(forms).format(noun(), noun()) for _ in range(rng.randrange(4, 9)))


def test_stuffed_pages(spark):
    rng = random.Random(2)
    words_ = ["buy", "cheap", "best", "price", "online", "sale", "top"]
    stuff = lambda n: " | ".join(f"{rng.choice(words_)} {rng.choice(['pump', 'oven', 'lens'])}" for _ in range(n))
    links = lambda n: "\n".join(f"{i}. pump sale http://shop{i}.example/p/{i}" for i in range(n))
    remarks = "\n".join(f"http://site{i}.example/p/{i} - {_prose(rng)}" for i in range(5))
    tags = " ".join(f"#{w}pump" for w in words_)
    docs = [(i, _prose(rng), "en") for i in range(300)] + [(300 + i, stuff(30), "en") for i in range(25)]
    docs += [(400, links(9), "en"), (401, remarks, "en"), (402, tags, "en"), (403, "[quote=x]" + stuff(30) + "[/quote]\n" + _prose(rng), "en"), (404, _prose(rng) + "\n" + stuff(200), "en"), (405, "> " + stuff(30), "en"), (406, None, "en"), (407, "", "en"), (408, "bump bump bump bump", "en"), (409, _prose(rng) + " #pump #oven", "en"), (None, links(9), "en"), (300, stuff(30), "en")]
    found = [r.doc_id for r in spam.stuffed_pages(spark.createDataFrame(docs, D)).collect()]
    assert {400, 402, 404, None} <= set(found)
    assert not {401, 403, 405, 406, 407, 408, 409} & set(found)
    assert sum(300 <= (i or 0) < 325 for i in found) >= 24 and sum(i is not None and i < 300 for i in found) <= 3


def test_stuffed_empty(spark):
    assert spam.stuffed_pages(spark.createDataFrame([], D)).count() == 0
    assert spam.stuffed_pages(spark.createDataFrame([(1, "!!!", "x"), (2, "one", "x")], D)).count() == 0


def _keywords(rng, n):
    return ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)]


def test_stuffed_scarce_words(spark):
    rng = random.Random(5)
    scarce, once, fixed, other = _keywords(rng, 60), _keywords(rng, 60), _keywords(rng, 60), _keywords(rng, 40)
    docs = [(i, _prose(rng), "en") for i in range(300)]
    docs += [(300, " ".join(rng.choice(scarce) for _ in range(150)), "en"), (301, " ".join(once), "en")]
    copies = [[*fixed[:k], other[k], *fixed[k + 1 :]] for k in range(40)]
    docs += [(400 + k, " ".join(c), "en") for k, c in enumerate(copies)]
    found = {r.doc_id for r in spam.stuffed_pages(spark.createDataFrame(docs, D)).collect()}
    assert {300, 301, *range(400, 440)} <= found and sum(i < 300 for i in found) <= 3


def test_stuffed_phrases(spark):
    rng = random.Random(6)
    docs = [(i, _prose(rng), "en") for i in range(300)]
    phrase = " ".join(_keywords(rng, 3))
    docs += [(300, (phrase + " ") * 200, "en"), (301, "pump repair best price " * 200, "en"), (302, (_prose(rng) + "\n") * 2, "en"), (303, "the trick with the pump is patience " * 100, "en")]
    shares = {r.doc_id: r for r in spam.stuffed_shares(spark.createDataFrame(docs, D)).collect()}
    assert all(shares[i].total >= shares[i].heaped > 0.95 * shares[i].total for i in (300, 301, 303)) and shares[302].heaped < 0.5 * shares[302].total
    _, _, repeated, chunks = spam.parts("pump repair best price " * 200)
    assert repeated > 0.95 * 200 * 23 and sum(len(w) for _, w in chunks) <= 14


def test_stuffed_one_word(spark):
    rng = random.Random(7)
    texts = ["casino " * 500, "casino " * 60 + "bonus " * 60 + "poker, " * 60, "#pump #oven #lens", "#pump #oven #lens #sale #top", "casino " * 9]
    kept = ["bump bump bump bump", "0 0 0 0 0 0 0 0 0 0 0 0", _prose(rng) + " #pump #oven #lens", "thanks #pump", "no no no no no no no no " + _prose(rng)]
    docs = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, t, "en") for i, t in enumerate(kept)] + [(200 + i, _prose(rng), "en") for i in range(100)]
    found = {r.doc_id for r in spam.stuffed_pages(spark.createDataFrame(docs, D)).collect()}
    assert {0, 1, 2, 3, 4} <= found and not {100, 101, 102, 103, 104} & found


_HAM = """I replaced the bearing last winter and it still squeaks when the weather is damp, so I doubt the grease is to blame.
Does anyone remember whether the older housing had two screws or three? Mine has three holes but only two of them are threaded.
My neighbour swears by vinegar, but after a week of soaking the scale was exactly as hard as before and the kitchen smelled awful.
Thanks for the drawing. I printed it at full size, held it against the plate, and the slot is a good four millimetres too low.
We drove up on Friday, found the road closed at the bridge, and walked the last two miles with the spare wheel between us.
The manual says to wait ten minutes. In my experience half an hour is safer, because the relay stays warm far longer than you would think.
Gestern habe ich die Pumpe noch einmal zerlegt, und siehe da, im Einlass steckte ein kleines Blatt, das alles verstopft hatte.
Je ne comprends pas pourquoi le moteur cale seulement le matin, alors que le soir il tourne sans le moindre bruit.
Ayer por la noche revisamos el cable completo y no encontramos nada raro, aunque la luz sigue parpadeando cuando llueve.
If you do decide to sell it, please let me know first; my father had the same model and I would love to restore one.
Sorry for the late answer, I was away. The part number is on the inside of the lid, next to the faded sticker.
It is not pretty, but it works: two hose clamps, a strip of rubber from an old tyre, and a lot of patience.""".split("\n")


def _labelled(rng):
    """(text, spam): made-up posts. The rule for stretches with little evidence was added after a run on them, so they are no independent measure."""
    out = [("casino " * 100, True), ("скидки " * 60, True), ("best price garden hose for sale today " * 25, True), ("buy cheap pump online " * 40, True), ("buy cheap pump online " * 80, True)]
    salad = ["discount", "watches", "replica", "outlet", "luxury", "bargain", "wholesale"]
    out.append((" ".join(rng.choice(salad) for _ in range(80)), True))
    for n in (40, 120, 400):
        out.append((" ".join(rng.choice(salad + _keywords(rng, 30)) for _ in range(n)), True))
        out.append((", ".join(f"{rng.choice(salad)} {w}" for w in _keywords(rng, n // 2)), True))
    out += [(" ".join(f"#{w}" for w in _keywords(rng, n)), True) for n in (9, 60)]
    out += [("\n".join(f"[url=http://s{i}.example/{i}]{w}[/url]" for i, w in enumerate(_keywords(rng, n))), True) for n in (5, 50)]
    out += [("\n".join(f"<a href='http://t{i}.example'>{w} {rng.choice(salad)}</a>" for i, w in enumerate(_keywords(rng, 12))), True), (_HAM[0] + "\n" + " ".join(rng.choice(salad) for _ in range(120)), True)]
    out += [(" ".join(rng.sample(["Uhren", "billig", "kaufen", "Rabatt", "Angebot", "online", "Schnellversand", "Sonderpreis"], 8)) + " " + " ".join(rng.choice(["Uhren", "billig", "kaufen", "Rabatt", "Angebot"]) for _ in range(70)), True)]
    out += [(h, False) for h in _HAM]
    out += [(" ".join(rng.sample(_HAM, k)), False) for k in (2, 2, 3, 3, 4, 5)]
    out += [("[quote=eve]" + "casino " * 100 + "[/quote]\n" + rng.choice(_HAM), False), ("> " + " ".join(salad * 5) + "\n\n" + _HAM[3], False)]
    out += [("\n".join(f"http://u{i}.example/x - {h}" for i, h in enumerate(rng.sample(_HAM, 4))), False), (_HAM[5] + "\n-- \n" + "buy cheap pump online", False)]
    return out


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_labelled_posts_beside_a_corpus(spark, size):
    """Precision and recall of 0.9 or more; those that were once missed are all found."""
    folder = f"/root/testdata/{size}/documents.parquet"
    import os

    if not os.path.exists(folder):
        pytest.skip("no test data")
    labelled = _labelled(random.Random(11))
    posts = spark.createDataFrame([(-1 - i, text) for i, (text, _) in enumerate(labelled)], "doc_id bigint, text string")
    found = {-1 - r.doc_id for r in spam.stuffed_pages(spark.read.parquet(folder).select("doc_id", "text").unionByName(posts)).where("doc_id < 0").collect()}
    wanted = {i for i, (_, is_spam) in enumerate(labelled) if is_spam}
    assert {0, 1, 2, 3, 4, 5} <= found
    assert len(found & wanted) >= 0.9 * len(wanted) and len(found & wanted) >= 0.9 * len(found), (sorted(wanted - found), sorted(found - wanted))


def test_parts_of_very_long_texts():
    """Work follows the length: many lists, logs and repetitions in one post."""
    import time

    began = time.perf_counter()
    text = "\n\n".join(f"word{i % 977} thing{i % 31} goes with part{i % 613} " + " ".join(f"#t{k}" for k in range(7)) + " no no no no no no no no no" for i in range(6000))
    total, many, repeated, chunks = spam.parts(text)
    assert many > 6000 * 20 and repeated > 0 and sum(c for c, _ in chunks) + many + repeated <= 1.2 * total
    assert time.perf_counter() - began < 20


def test_stuffed_code(spark):
    rng = random.Random(9)
    log = "\n".join(f"{rng.randrange(10, 24)}:{rng.randrange(10, 60)} {rng.choice(['WARN', 'INFO', 'step'])} value={rng.randrange(9999)} ch{rng.randrange(9)} ok" for _ in range(40))
    scarce = _keywords(rng, 60)
    heap = lambda: " ".join(rng.choice(scarce) for _ in range(100))
    texts = [f"[code]{heap()}[/code]", f"[code] {heap()}", f"ok [code]\n{log}\n\n{' '.join(heap() for _ in range(8))}"]
    kept = [f"[code]\n{log}\n[/code]", f"{_prose(rng)}\n[code]\n{log}", f"[code]\n{log}\n[/code]\n{_prose(rng)}"]
    docs = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, t, "en") for i, t in enumerate(kept)] + [(200 + i, _prose(rng), "en") for i in range(300)]
    found = {r.doc_id for r in spam.stuffed_pages(spark.createDataFrame(docs, D)).collect()}
    assert {0, 1, 2} <= found and not {100, 101, 102} & found
