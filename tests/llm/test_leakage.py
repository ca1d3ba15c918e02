import random

from quern.llm import leakage

ITEM = (
    "Find the smallest number of parcels needed to sync all hidden tables wholly. There is one straight chunk per task, and 12 graphs share it. "
    "Adds a rough worker so the block may store intervals lazily. How many buckets can search a slow marble within 8 steps?"
)
OTHER = (
    "Find the smallest number of lanterns needed to drain all pale ledgers twice. There is one golden row per lease, and 31 seats share it. "
    "Adds a dense queue so the page may trim cursors early. How many shards can render a quiet rank within 19 steps?"
)


def edited(text, first, every):
    words = text.split()
    for k in range(first, len(words), every):
        words[k] = "changed"
    return " ".join(words)


def moved(text):
    w = text.split()
    half = len(w) // 2
    return " ".join(w[half:]) + " some other text in between here " + " ".join(w[:half])


def repatterned(text):
    for a, b in (
        ("parcels", "dogs"), ("sync", "walk"), ("hidden tables", "big cats"), ("straight chunk", "blue door"), ("12 graphs", "77 keys"), ("task", "house"), ("rough worker", "green hat"),
        ("block", "coat"), ("store intervals", "carry sticks"), ("buckets", "people"), ("search a slow marble", "open a warm box"), ("8", "93"),
    ):
        text = text.replace(a, b)
    return text


ONE = {
    "whole": "Intro words. " + ITEM, "upper, quoted": ITEM.upper().replace(" ", "\n> "), "look-alikes": ITEM.replace("a", "а"), "format characters": ITEM.replace(" ", "\u200b "),
    "broken words": ITEM.replace("smallest", "sma llest").replace("chunk", "ch unk"), "edited": edited(ITEM, 3, 7), "moved": moved(ITEM), "in a long text": "so it goes on and on. " * 3000 + ITEM + " and on." * 3000,
}
NONE = {"short echo": " ".join(ITEM.split()[:9]), "other words": repatterned(ITEM), "empty": "", "blank": "   ", "one word": "x" * 10_000, "null": None}


def test_cases(spark):
    names = list(ONE) + list(NONE)
    docs = spark.createDataFrame([(k, (ONE | NONE)[n]) for k, n in enumerate(names)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id bigint, text string")
    for most in (0, 1_000_000):  # joined by shuffle, and broadcast
        got = sorted((names[r["doc_id"]], r["item_id"]) for r in leakage.leaks(docs, items, most_broadcast=most).collect())
        assert got == sorted((n, 1) for n in ONE)


def test_the_plan_does_not_grow_with_the_items(spark):
    words = "amber bridge copper delta ember falcon garden harbor island jungle kettle lantern meadow nectar orchid pebble quartz river saddle timber".split()
    def text(k):
        r = random.Random(k)
        return " ".join(r.choice(words) + "ly" * (r.random() < 0.5) for _ in range(40))

    many = spark.createDataFrame([(k, text(k)) for k in range(20_000)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"Before it. {text(k * 100)} After it.") for k in range(200)], "doc_id bigint, text string")
    found = leakage.leaks(docs, many)
    got = {(r["doc_id"], r["item_id"]) for r in found.select("doc_id", "item_id").collect()}
    assert got == {(k, k * 100) for k in range(200)}
    few = leakage.leaks(docs, many.limit(10))
    reads = [str(x._jdf.queryExecution().optimizedPlan()).count("MapInPandas") for x in (found, few)]
    assert reads[0] == reads[1]


def test_alignment_checks_slots():
    words = leakage.words_of(ITEM)
    hits = [(0, len(words) - 4, 0, 20)]
    assert leakage.leaked([(words, [(words, set(), hits)])]) == [[(len(words), float(len(words)))]]
    slots = {w for k, w in enumerate(words) if k % 5 == 0}
    other = [w + "x" if w in slots else w for w in words]
    assert leakage.leaked([(other, [(words, slots, hits)])]) == [[(0, 0.0)]]  # every fifth word is a slot that differs


def test_placeholders():
    assert [leakage.placeholder(w) for w in ("12", "Paris", "km", "the", "NASA")] == ["#", "@", "%", None, None]


def test_frames(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (2, None, 5), (3, "", 5), (4, ITEM + "\n" + OTHER, 5), (5, ITEM, 5)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM, "a"), (1, ITEM, "b"), (7, ITEM, "a"), (2, OTHER, "a"), (3, None, "a"), (4, "", "a"), (5, "too short to count", "a"), (None, ITEM, "a")], "item_id bigint, text string, words string")
    want = {(1, 1), (1, 7), (4, 1), (4, 7), (4, 2), (5, 1), (5, 7)}
    got = [(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()]
    assert len(got) == len(want) and set(got) == want
    assert leakage.leaks(docs.where("false"), items).count() == 0 and leakage.leaks(docs, items.where("false")).count() == 0


def test_passages_and_sentences_of_many_items(spark):
    r = random.Random(5)
    def text(n):
        return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(n))

    passage, stock = text(30), "If there are several answers, print any."
    words = text(40).split()
    asked = {k: f"{text(12)} {passage} {stock} {text(8)}" for k in range(20)}  # questions about one passage
    alike = {100 + k: " ".join([*words[:20], f"slot{k}", *words[20:]]) for k in range(20)}  # texts that differ in one word
    others = {200 + k: f"{text(15)} {stock} {text(15)}" for k in range(20)}
    items = spark.createDataFrame(list((asked | alike | others).items()), "item_id bigint, text string")
    docs = {1: f"{text(50)} {passage} {text(50)}", 2: f"{text(9)} {alike[103]} {text(9)}", 3: f"{text(30)} {stock} {text(30)}", 4: " ".join(passage.split()[:15]), 5: edited(passage, 2, 7)}
    docs = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    for most in (0, 1_000_000):  # joined by shuffle, and broadcast
        got = sorted((x["doc_id"], x["item_id"]) for x in leakage.leaks(docs, items, most_broadcast=most).collect())
        assert got == [(1, k) for k in asked] + [(2, k) for k in alike] + [(5, k) for k in asked]
