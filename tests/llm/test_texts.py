from __future__ import annotations

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import mixing, packing, prose
from lodestream.llm.tokens import VOCABULARY, encoding, token_count


def test_token_counts(spark):
    texts = ["hello world", "", None, "Größe 12 €", "a" * 5_000, "<|endoftext|>", " \n\t "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(token_count("text")).collect()]
    assert got[0] == 2 and got[1] == 0 and got[2] == 0 and got[5] > 1
    enc = encoding(VOCABULARY)
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    assert got == [len(other.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]


# ---- packing ---------------------------------------------------------------------------------------------------------


def best_fit(length, capacity):
    """Containers that best-fit decreasing, without classes, needs."""
    room, boxes = [], 0
    for need in length.tolist():
        at = bisect.bisect_left(room, need)
        fits = at < len(room)
        boxes += not fits
        bisect.insort(room, (room.pop(at) if fits else capacity) - need)
    return boxes


@pytest.mark.parametrize("n", [1, 7, 300, 8_000])
def test_pack_group(n):
    rng = np.random.default_rng(n)
    for capacity in (64, 1_000):
        length = np.sort(np.minimum(np.exp(rng.normal(4, 1.4, n)).astype(int) + 1, capacity))[::-1]
        box, pos = packing.pack_group(length, capacity)
        used = np.bincount(box, weights=length)
        assert used.max() <= capacity and used.min() > 0
        for b in range(min(len(used), 50)):
            assert sorted(pos[box == b]) == list(range((box == b).sum()))
        if n >= 8_000:
            assert len(used) <= 1.02 * best_fit(length, capacity)


def test_equal_pieces_share_containers_by_their_class():
    box, _ = packing.pack_group(np.full(9, 30), 100)
    assert np.bincount(box).tolist() == [3, 3, 3]


def packed(spark, sizes, packs=(("p", 10),), groups=2):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(sizes)], "doc_id long, tokens long")
    kinds = spark.createDataFrame(list(packs), "pack_name string, capacity_tokens int")
    return packing.pack(packing.pieces(texts, kinds), groups), kinds


def test_every_text_is_placed_whole(spark):
    sizes = [3, 10, 25, 0, None, 1, 7, 20, 5, 5]
    out, kinds = packed(spark, sizes, [("p", 10), ("q", 4), ("none", 0), ("p", 10)])
    rows = out.collect()
    for name, capacity in (("p", 10), ("q", 4)):
        mine = [r for r in rows if r["pack_name"] == name]
        for i, t in enumerate(sizes):
            parts = sorted((r["piece"], r["start"], r["length"]) for r in mine if r["doc_id"] == i)
            assert sum(p[2] for p in parts) == (t or 0)
            assert [p[0] for p in parts] == list(range(len(parts))) and [p[1] for p in parts] == [capacity * k for k in range(len(parts))]
            assert len(parts) == -(-(t or 0) // capacity)  # split only beyond the capacity
        boxes = {}
        for r in mine:
            boxes.setdefault(r["container_id"], []).append(r)
        assert all(sum(r["length"] for r in b) <= capacity and sorted(r["position"] for r in b) == list(range(len(b))) for b in boxes.values())
    assert {r["pack_name"] for r in rows} == {"p", "q"}
    report = {r["pack_name"]: r for r in packing.fill_report(out, kinds.filter("capacity_tokens > 0")).collect()}
    assert report["p"]["tokens"] == 76 and report["p"]["least_containers"] == 8 and report["p"]["fill"] <= 1
    again, _ = packed(spark, sizes, [("p", 10), ("q", 4), ("none", 0), ("p", 10)])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert packed(spark, [])[0].count() == 0


def test_groups_follow_the_pieces_of_each_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 3)
    texts = spark.createDataFrame([(1, 10), (2, 25), (3, 0), (4, None)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([("p", 10), ("q", 2), ("none", 0)], "pack_name string, capacity_tokens int")
    assert {r["pack_name"]: r["groups"] for r in packing.group_counts(texts, kinds).collect()} == {"p": 2, "q": 6}
    out = packing.pack(packing.pieces(texts, kinds), packing.group_counts(texts, kinds)).collect()
    assert sum(r["length"] for r in out if r["pack_name"] == "q") == 35 and len({r["container_id"] >> 32 for r in out if r["pack_name"] == "q"}) > 2


def test_tokens_are_counted_once(spark):
    from lodestream.llm import queries as Q

    docs = spark.createDataFrame([(1, "a", "x y"), (2, "a", None)], "doc_id long, source string, text string").select("doc_id", "source", token_count("text").alias("tokens"), F.md5("text").alias("digest"))
    wanted = spark.createDataFrame([("a",)], "source string")
    plan = mixing.texts(docs, wanted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and Q.VOCABULARY == VOCABULARY


# ---- mixing ----------------------------------------------------------------------------------------------------------


def docs(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens long")
    return d.select("doc_id", mixing.source_name("source").alias("source"), "tokens", F.md5("text").alias("digest"))


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_are_reached(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "A" if i % 10 else " b-c", f"text {i}", int(rng.integers(5, 40))) for i in range(3_000)] + [(9_000, "other", "x", 5), (9_001, None, "y", 5), (9_002, "a", "", 0), (9_003, "a", None, 0)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b_c", 0.3, 3), ("missing", 0.2, 2)], TARGETS)
    drawn, plan = mixing.mix(docs(spark, rows), t)
    got = {r["source"]: r for r in mixing.shares(drawn, plan).collect()}
    assert abs(got["a"]["share"] - 0.625) < 0.003 and abs(got["b_c"]["share"] - 0.375) < 0.003
    assert got["missing"]["share"] == 0.0 and got["missing"]["texts"] == 0 and got["missing"]["target_share"] == 0.2
    assert got["b_c"]["most_times"] == 3 and got["a"]["most_times"] == 1
    assert got["b_c"]["drawn_tokens"] == 3 * got["b_c"]["available"]  # the scarce source sets the total
    times = {r["doc_id"]: r["times"] for r in drawn.collect()}
    assert not {9_000, 9_001, 9_002, 9_003} & set(times) and max(times.values()) == 3


def test_equal_texts_are_one(spark):
    rows = [(1, "a", "same", 10), (2, "a", "same", 10), (3, "b", "same", 10), (4, "b", "own", 10)]
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2), ("a", 0.5, 2)], TARGETS)
    drawn, _ = mixing.mix(docs(spark, rows), t)
    assert sorted((r["doc_id"], r["times"]) for r in drawn.collect()) == [(1, 2), (4, 2)]


def test_no_texts_or_targets(spark):
    t = spark.createDataFrame([("a", 1.0, 1), ("z", 0.0, 1), ("y", 0.5, 0), (None, 0.5, 1)], TARGETS)
    drawn, plan = mixing.mix(docs(spark, [(1, "b", "x", 3)]), t)
    assert drawn.count() == 0 and [(r["source"], r["share"]) for r in mixing.shares(drawn, plan).collect()] == [("a", 0.0)]
    drawn, plan = mixing.mix(docs(spark, [(1, "b", "x", 3)]), t.limit(0))
    assert drawn.count() == 0 and mixing.shares(drawn, plan).count() == 0


def test_cut_is_within_half_a_text(spark):
    rows = [(i, "a", f"t{i}", 10) for i in range(100)] + [(1_000, "b", "b", 37)]
    drawn, plan = mixing.mix(docs(spark, rows), spark.createDataFrame([("a", 0.5, 5), ("b", 0.5, 1)], TARGETS))
    got = {r["source"]: r["drawn_tokens"] for r in mixing.shares(drawn, plan).collect()}
    assert got == {"a": 40, "b": 37}


# ---- prose -----------------------------------------------------------------------------------------------------------

SENTENCES = [
    "We had been waiting for a long time when the waiter came to tell us that the kitchen was closed.",
    "The room was nice, but it was so loud that we could not hear what the others said.",
    "I would not go back, because they do not listen to what you ask for.",
    "My sister told me that this place is where she has been going for years.",
    "If you are in the area, you should try it, as they are very friendly to their guests.",
]
PROSE_TEXTS = [" ".join(SENTENCES), "\n\n".join(SENTENCES[:3]), " ".join(SENTENCES).lower().replace(".", "").replace(",", ""), " ".join(SENTENCES).upper(), "Wir haben lange gewartet, weil niemand da war, und es hat uns trotzdem sehr gut gefallen.", "Nous avons attendu parce que personne n'était là, mais c'est un endroit où je me sens très bien 😋"]
LISTS = ["\n".join(f"- {w} soup" for w in ("onion", "lentil", "barley", "tomato", "pepper")), "milk; brown bread; apples, pears; cheese; red wine; green tea; honey", "[ ] onion tart\n[x] plum cake\n[ ] fig salad\n[ ] oat pancakes", "la soupe de lentilles, le riz au lait, la tarte aux prunes, le pain aux noix, la salade de figues"]
TABLES = ["item\tprice\tqty\nsoup\t4.50\t3\ntart\t3.10\t9\ncake\t2.00\t1", "| a | b |\n|---|---|\n| soup | 3 |\n| tart | 4 |\n| cake | 5 |", "name;price;note\nsoup;4.5;good\ntart;3.1;dry\ncake;2.0;sweet", "item: soup\nprice: 4\nitem: tart\nprice: 3\nitem: cake\nprice: 2"]
JUNKS = ["buy now " * 30, "#$%^&*()_+=-{}[]|" * 9, "qx7Rk29LmZ0vB3nW8pTq5Ys1HdJf6GcAeUiXoKzMwVbNlPyQ" * 4, "12:01:22 ERR code=4f retry=1\n12:01:23 INFO code=5a retry=0\n12:01:25 WARN code=9c retry=2", "hahahahahahahahahahahahahahahahahahahahahaha", "lamp tart quillen rushed orvask beets umbrella nadil cider falls warm osk trout sedan"]


def test_kinds_of_text():
    model = prose.train(PROSE_TEXTS * 5 + LISTS + TABLES + JUNKS)
    for text in PROSE_TEXTS:
        assert prose.shares(text, model)[0] > 0.5, text
    for text in [*LISTS, *TABLES, *JUNKS]:
        assert prose.shares(text, model)[0] < 0.5, text
    mixed = prose.shares(PROSE_TEXTS[0] + "\n" + LISTS[0], model)
    assert mixed[0] > 0.6 and mixed[1] > 0.05 and abs(sum(mixed) - 1) < 1e-9
    assert prose.shares(None, model) is None and prose.shares(" \n ", model) is None
    assert abs(sum(prose.shares("x" * 90_000 + " " + PROSE_TEXTS[0] * 200, model)) - 1) < 1e-9


def test_viterbi_is_the_best_path():
    import itertools

    model = prose.train(PROSE_TEXTS + LISTS + TABLES + JUNKS)
    x, _, _ = prose.features(SENTENCES[0] + "\n" + LISTS[0], model.letters)
    x = x[:5]
    score = sum(e[:, x[:, j]] for j, e in enumerate(model.emit)).T * 0.6
    value = lambda s: model.first[s[0]] + sum(score[k, v] for k, v in enumerate(s)) + sum(model.move[a, b] for a, b in itertools.pairwise(s))
    best = max(itertools.product(range(4), repeat=len(x)), key=value)
    assert model.label(x).tolist() == list(best)


def test_documents_of_a_batch_do_not_meet():
    model = prose.train(PROSE_TEXTS + LISTS + TABLES + JUNKS)
    xs = [prose.features(t, model.letters)[0] for t in ["\n".join([SENTENCES[0], LISTS[0], JUNKS[3]]), "", SENTENCES[1], JUNKS[0], TABLES[0] + "\n" + PROSE_TEXTS[1]]]
    together = model.label(np.concatenate(xs), np.array([len(x) for x in xs]))
    assert together.tolist() == [v for x in xs for v in model.label(x).tolist()]


def test_features_do_not_depend_on_the_batch():
    odd = ["", " \n ", "İstanbul'da \U0001d518nicode 😋😋 çok güzel!", "x" * 500 + " y", "a\tb\n\n  c - d", "12:01:22 ERR code=4f\r\n#one #two", "Ωραίο μέρος, αλλά ακριβό.", "qx7Rk29LmZ0vB3nW8pTq5Ys1HdJf6GcAeUiXoKzMwVbNlPyQ", "word " * 90 + "\u3000wide"]
    texts = [*PROSE_TEXTS, *odd, *LISTS, *TABLES, *JUNKS]
    letters = prose.Letters.counted(prose.Letters.pairs(texts))
    x, r, lengths = prose.features_of(texts, letters)
    alone = [prose.features(t, letters) for t in texts]
    assert lengths.tolist() == [len(a) for a, _, _ in alone] and x.tolist() == [row for a, _, _ in alone for row in a.tolist()]
    assert prose.plain_case(r).tolist() == [int(prose.plain_case(q)) for _, _, raw in alone for q in raw]
    assert r["solid"].tolist() == [sum(not c.isspace() for c in p) for t in texts for p, _ in prose.pieces_of(t)]
    assert all((x[:, j] < size).all() for j, size in enumerate(prose.SIZES)) and x.min() >= -1
    assert prose.features_of(["", " "], letters)[0].shape == (0, len(prose.SIZES))


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(prose, "BATCH_DOCS", 3)
    monkeypatch.setattr(prose, "BATCH_CHARS", 10)
    assert list(prose._batches([1, 1, 1, 1, 50, 2, 9, 1])) == [(0, 3), (3, 4), (4, 5), (5, 6), (6, 8)]
    assert list(prose._batches([])) == []


def test_the_model_labels_and_no_rule_overrules_it():
    model = prose.train(PROSE_TEXTS * 5 + LISTS + TABLES + JUNKS)
    everything = [*PROSE_TEXTS, *LISTS, *TABLES, *JUNKS, "\n".join([SENTENCES[0], LISTS[0], JUNKS[3]])]
    for text in everything:
        x, weight, _ = prose.features(text, model.letters)
        s = model.label(x)
        assert prose.shares(text, model) == tuple(float(weight[s == k].sum() / weight.sum()) for k in range(4))
    x, _, raw = prose.features(SENTENCES[0], model.letters)
    assert [prose.plain_case(r) for r in raw] == [prose.PROSE]
    model.emit = [e * 0 for e in model.emit]
    model.first = np.log(np.array([0.1, 0.1, 0.1, 0.7]))
    assert prose.shares(SENTENCES[0], model) == (0.0, 0.0, 0.0, 1.0)
    # scripts the word lists have nothing of
    model = prose.train(PROSE_TEXTS * 5 + LISTS + TABLES + JUNKS)
    assert prose.shares("Мы долго ждали, но официант так и не пришёл, и нам пришлось уйти домой голодными.", model)[0] > 0.5


def test_pieces_are_small_and_repeats_are_found_at_any_distance():
    line = " ".join(f"word{k}" for k in range(100))
    assert max(len(p.split()) for p, _ in prose.pieces_of(line)) <= 30 and " ".join(p for p, _ in prose.pieces_of(line)) == line
    block = [f"w{k}" for k in range(150)]
    again = prose._repeated(block * 6)
    assert not any(again[:448]) and all(again[450:])
    assert not any(prose._repeated(block * 2))
    # sentences that come again between others are no copies; a phrase over and over is
    rng = np.random.default_rng(0)
    sentences = [[f"s{k}w{j}" for j in range(12)] for k in range(40)]
    assert not any(prose._repeated([w for k in rng.permutation(np.repeat(np.arange(40), 8)) for w in ["and", f"x{rng.integers(1 << 40)}", *sentences[k]]]))
    assert all(prose._repeated("buy it now".split() * 9)[3:])


def test_labels_and_statistics(spark):
    texts = [*PROSE_TEXTS, *JUNKS, None, "  "]
    d = spark.createDataFrame([(i, t, "EN", "dup") for i, t in enumerate(texts)], "doc_id long, text string, lang string, prose string")
    got = {r["doc_id"]: r["prose"] for r in prose.label_shares(d, prose.train_on(d)).collect()}
    assert len(got) == len(texts) and got[len(texts) - 1] is None and got[len(texts) - 2] is None and got[0] > 0.5
    common = spark.createDataFrame([("en", "the"), ("en", "was"), ("de", "und")], "lang string, word string")
    rows = [(1, "The soup, was: hot!\n\nYes…\nno", "en"), (2, None, "en"), (3, " \n", None), (4, "und the", "xx")]
    s = {r["doc_id"]: r for r in prose.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), common).collect()}
    assert (s[1]["words"], s[1]["lines"], s[1]["punctuated_lines"], s[1]["common_words"]) == (6, 3, 2 / 3, 2 / 6)
    assert s[1]["mean_word_length"] == 22 / 6 and s[1]["symbol_ratio"] == 4 / 22
    assert s[2]["words"] == 0 and s[2]["symbol_ratio"] is None and s[3]["lines"] == 0 and s[4]["common_words"] == 1.0
    assert prose.train_on(d.limit(0)).label(np.zeros((1, len(prose.SIZES)), np.int64)).shape == (1,)
