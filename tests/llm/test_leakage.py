import random
from time import process_time

import numpy as np

from traceloom.llm import leakage as L


def corpus():
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te", "vo", "zi", "pu", "ge") for b in ("ban", "dor", "fel", "gus", "hem", "jal", "nor", "wik") for c in ("", "na", "st", "xi", "rt", "lo", "mp")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(60) if i % 2 else None, say(24)) for i in range(12)]
    text = {i: p or q for i, p, q in items}
    docs, truth = [], set()
    for d in range(160):
        body = [say(150), say(120)]
        if d % 4 == 0:
            i = rng.randrange(12)
            w = text[i].split()
            part = w[: len(w) * 3 // 4] if d % 8 else w
            for k in range(5, len(part), 14):
                part[k] = "altered"
            middle = len(part) // 2
            body.insert(1, " ".join(part[:middle]).upper() + "\n\nContinue reading below\n\n" + "<b>" + " ".join(part[middle:]).replace("a", "а", 3) + "</b>")
            truth.add((d, i))
        elif d % 4 == 1:
            w = text[rng.randrange(12)].split()
            body.insert(1, " ".join(w[: len(w) // 3]))
        docs.append((d, "\n".join(body), 1))
    return items, docs, truth


def test_leaks_are_found_and_quotations_are_not(spark):
    items, docs, truth = corpus()
    docs += [(900, None, 1), (901, "", 1), (902, "x" * 100_000, 1), (0, docs[0][1], 1)]
    items += [(50, None, None), (51, "", ""), (52, "...", "q")]
    corpus_df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    eval_df = spark.createDataFrame(items, "item_id long, passage string, question string")
    got = [(r["doc_id"], r["item_id"]) for r in L.leaked(corpus_df, eval_df).collect()]
    assert set(got) == truth and len(got) == len(truth) + 1  # the repeated document counts again


def test_retrieval_misses_nothing_that_alignment_of_everything_finds(spark):
    items, docs, _ = corpus()
    coded = L.Items([(i, p or q) for i, p, q in items])
    every = set()
    for d, text, _ in docs:
        words = L.np.array([coded.vocab.get(w, 0) for w in L.words(text)])
        held = L.aligned(coded.words, [words] * len(coded.words))
        every |= {(d, i) for t, n in enumerate(held) if n for i in coded.ids[t]}
    got = L.leaked(spark.createDataFrame(docs, "doc_id long, text string, x int"), spark.createDataFrame(items, "item_id long, passage string, question string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == every


def test_words():
    assert L.words("Orra-\nva-on-Lin&nbsp;&quot;it&#39;s&quot; <b>a</b> vol\xadun​teer, сар ＦＵＬＬ") == ["orravaonlin", "its", "a", "volunteer", "cap", "full"]


def test_no_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, passage string, question string")
    assert L.leaked(docs, none).count() == 0
    some = spark.createDataFrame([(1, "one two three four", None)], "item_id long, passage string, question string")
    assert L.leaked(docs.where("false"), some).count() == 0


def test_short_altered_and_interrupted_pieces(spark):
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "vo", "zi", "pu", "ge") for b in ("ban", "dor", "fel", "gus", "hem", "jal", "nor", "wik")]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [say(26) for _ in range(10)] + [say(80) for _ in range(6)]
    docs = []
    for d in range(240):
        w = texts[d % len(texts)]
        n = len(w) // 2 + (d % 3) + 1
        at = rng.randrange(len(w) - n + 1)
        part = w[at : at + n]
        if d % 2:
            part[n // 3] = "altered"
        if d % 5 == 0:
            part[n // 2 : n // 2] = ["between"] * 130
        docs.append((d, " ".join(say(rng.randrange(30, 90)) + part + say(50))))
    coded = L.Items([(i, " ".join(t)) for i, t in enumerate(texts)])
    every = set()
    for d, text in docs:
        page = L.np.array([coded.vocab.get(w, 0) for w in L.words(text)])
        every |= {(d, i) for t, n in enumerate(L.aligned(coded.words, [page] * len(coded.words))) if n for i in coded.ids[t]}
    got = L.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t), None) for i, t in enumerate(texts)], "item_id long, passage string, question string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == every and len(every) > 200


def test_answers_are_evidence(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words) + " it was the red house"), (2, " ".join(words) + " the house was red"), (3, "the red house")], "doc_id long, text string")
    items = [(7, " ".join(words), None, ["a dog", "The Red House"], "B"), (8, " ".join(words), None, None, "the house"), (9, " ".join(words), None, ["x"], "C")]
    eval_df = spark.createDataFrame(items, "item_id long, passage string, question string, choices array<string>, answer string")
    got = {(r["doc_id"], r["item_id"]): r["answered"] for r in L.leaked(docs, eval_df).collect()}
    assert got == {(1, 7): True, (2, 7): False, (1, 8): False, (2, 8): True, (1, 9): False, (2, 9): False}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS", 5)
    items, docs, truth = corpus()
    got = L.leaked(spark.createDataFrame(docs, "doc_id long, text string, x int"), spark.createDataFrame(items, "item_id long, passage string, question string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == truth


def _plain(text, page):
    """The alignment of one text and one region, place by place."""
    one = np.float32
    cost, opening, onward, n = one(L.COST), one(L.OPENING), one(L.ONWARD), len(text)
    cells, gaps, best = [(one(0), 0, i) for i in range(n)], [(one(-1e6), 0, 0)] * n, 0
    for w in page:
        gaps = [(s - opening, h, b) if s - opening > g - onward else (g - onward, gh, gb) for (s, h, b), (g, gh, gb) in zip(cells, gaps)]
        new = []
        for i, t in enumerate(text):
            came, over = (cells[i - 1], gaps[i - 1]) if i else ((one(0), 0, 0), (one(-1e6), 0, 0))
            if t == w and w > 0:
                came = over if over[0] > came[0] else came
                new.append((max(came[0], one(0)) + one(1), came[1] + 1, came[2]) if came[0] > 0 else (one(1), 1, i))
            else:
                new.append((came[0] - cost, came[1], came[2]))
        top = (one(-1e9), 0, 0)
        for i in range(n):
            lifted = new[i][0] + cost * one(i)
            top = (lifted, *new[i][1:]) if lifted >= top[0] else top
            s = top[0] - cost * one(i)
            new[i] = (s, *top[1:]) if s > 0 else (one(0), 0, i)
        cells = new
        for i, (s, h, b) in enumerate(cells):
            if text[i] == w and w > 0 and i - b + 1 >= np.ceil(L.HELD * n) and one(h) >= one(L.UNALTERED) * one(i - b + 1) and s >= one(L.COHERENT) * one(h):
                best = max(best, h)
    return best


def test_alignment_is_that_of_each_pair():
    rng = np.random.default_rng(5)
    texts, pages = [], []
    for k in range(60):
        text = rng.integers(1, 30, rng.integers(1, 40))
        page = list(rng.integers(0, 30, rng.integers(0, 12))) + [int(w) if rng.random() > 0.05 else 0 for w in text if rng.random() > 0.03] + list(rng.integers(0, 30, rng.integers(0, 30)))
        if k % 3 == 0:
            page[len(page) // 2 : len(page) // 2] = [0] * int(rng.integers(1, 30))
        texts.append(text.astype(np.int32))
        pages.append(np.array(page, dtype=np.uint16))
    pages[7] = pages[7][:0]
    got = L.aligned(texts, pages)
    assert got.tolist() == [_plain(t.tolist(), p.tolist()) for t, p in zip(texts, pages)] and (got > 0).sum() > 20


def test_short_regions_do_not_wait_for_long_ones():
    rng = np.random.default_rng(6)
    texts = [rng.integers(1, 500, 110).astype(np.int32) for _ in range(256)]
    pages = [rng.integers(0, 500, 1500 if i == 99 else 30).astype(np.uint16) for i in range(256)]

    def seconds(a, b):
        began = process_time()
        L.aligned(texts[a:b], pages[a:b])
        return process_time() - began

    assert min(seconds(0, 256) for _ in range(3)) < 6 * min(seconds(99, 100) for _ in range(3))


def test_shared_pairs_of_many_documents():
    rng = np.random.default_rng(7)
    items = L.Items([(i, " ".join(f"w{w}" for w in rng.integers(0, 12, rng.integers(3, 30))), None) for i in range(9)] + [(9, "w1", None)])
    size, pairs = len(items.vocab) + 1, items.pairs()
    docs = [rng.integers(0, size, rng.integers(0, 40)) for _ in range(70)]
    starts = np.cumsum([0, *(len(d) + L.WINDOW for d in docs)])
    flat = np.zeros(starts[-1], dtype=np.uint16)
    for d, s in zip(docs, starts):
        flat[s : s + len(d)] = d
    met = [{(int(a), int(b)) for a, b in zip(d[:-1], d[1:]) if a and b} for d in docs]
    held = [[(int(a), int(b)) for a, b in zip(w[:-1], w[1:])] for w in items.words]
    want = [(d, t) for d in range(70) for t in range(len(held)) if sum(p in met[d] for p in held[t]) >= pairs[3][t]]
    assert L.sharing(flat, starts[:-1], np.array([len(d) for d in docs]), size, pairs) == want
