"""Packing, leakage and sentences against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import leakage, packing, sentences
from codeloom.llm.sentence_rules import sentence_ends, sentence_spans


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.integers(1, 40), max_size=20))
def test_plan_places_all_and_fits(histogram):
    segments, gaps, containers = packing.plan_runs(histogram, 50)
    used, placed = {}, {}
    for size, first, n, start, per in segments:
        for r in range(n):
            c = start + r // per
            assert 0 <= c < containers
            used[c] = used.get(c, 0) + size
            assert first + r not in placed.setdefault(size, set())
            placed[size].add(first + r)
    assert {s: len(v) for s, v in placed.items()} == histogram
    assert all(u <= 50 for u in used.values())
    bins = sum(1 for u in used.values() if u)
    assert all(a + b > 50 for a, b in zip(sorted(used.values()), sorted(used.values())[1:]) if a and b) or bins < 2  # no two containers would fit into one
    assert sum(50 - u for u in used.values()) + 50 * (containers - len(used)) == sum(g * sum(c for _, c in runs) for g, runs in gaps.items())


def test_pack(spark):
    rng = random.Random(1)
    sizes = [(k, rng.choice([7, 7, 7, rng.randrange(0, 40), 130])) for k in range(400)] + [(400, None), (401, 0), (401, 5)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens int").withColumn("limit", F.lit(1)).withColumn("size", F.lit(1))
    got = packing.pack(df.select("doc_id", "tokens"), {"a": 40, "b": 64}).collect()
    for name, cap in (("a", 40), ("b", 64)):
        mine = [r for r in got if r.limit_name == name]
        per, doc = {}, {}
        for r in mine:
            per[r.container] = per.get(r.container, 0) + r.tokens
            doc.setdefault(r.doc_id, []).append(r)
        assert max(per.values()) <= cap
        for k in range(400):
            assert sum(r.tokens for r in doc[k]) == sizes[k][1] and (len(doc[k]) == 1 or sizes[k][1] > cap)
            assert sorted(r.begin for r in doc[k]) == [cap * j for j in range(len(doc[k]))]
        assert len(doc[401]) == 2 and 400 in doc
    assert packing.pack(df.limit(0), {"a": 40}).count() == 0
    texts = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    counted = {r.doc_id: r.tokens for r in packing.token_sizes(texts).collect()}
    assert counted[1] in (2, 3) and counted[2] == counted[3] == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t.'é中", max_size=400), st.integers(1, 40))
def test_long_texts_count_as_whole(text, stretch):
    enc = packing._encoder(packing.VOCABULARY)
    assert packing.token_count(text, stretch=stretch) == len(enc.encode_ordinary(text))


def test_a_long_line_counts_as_whole():
    t = "word and more words, numbers 123  and " * 45000
    assert packing.token_count(t) == len(packing._encoder(packing.VOCABULARY).encode_ordinary(t))


def longest_in_order(item, doc):
    """Brute force: the longest common subsequence in any stretch of the document of 1.5 times the item."""
    best, m = 0, len(item)
    for s in range(0, max(1, len(doc) - m // 2), 5):
        w, row = doc[s : s + 3 * m // 2], [0] * (m + 1)
        for x in w:
            prev = 0
            for k in range(m):
                prev, row[k + 1] = row[k + 1], max(row[k + 1], row[k], prev + (item[k] == x))
        best = max(best, row[m])
    return best


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    head = "Answer the question below using only what is shown."
    own = {k: make(60) for k in range(12)}
    items = spark.createDataFrame([(k, f"{head} {' '.join(w)}." if k < 5 else " ".join(w)) for k, w in own.items()] + [(50, None), (51, "  "), (3, f"{head} {' '.join(own[3])}.")], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    noise = lambda: make(80)
    changed = [w if k % 9 else "other" for k, w in enumerate(own[1])]
    half = own[2][:33]
    foreign = own[3][:30] + make(25) + own[3][30:]
    shuffled = rng.sample(own[4], 60)
    docs = [
        (1, " ".join(noise() + own[0] + noise()).upper()), (2, " ".join(noise() + changed)), (3, "\n * ".join([", ".join(half[:20]), "; ".join(half[20:])])), (4, " ".join(foreign)), (5, " ".join(shuffled)),
        (6, head + " " + " ".join(make(300))), (7, None), (8, ""), (9, " ".join(own[5][:25] + noise())), (10, " ".join(make(3000) + own[6] + own[7] + make(3000))),
    ]
    got = sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(9)), items).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (10, 6), (10, 7)]
    index = leakage.Items(own)
    plain = [(d, t) for d, t in docs if t and d not in (4, 10)]
    want = sorted((d, k) for d, t in plain for k, w in own.items() if longest_in_order(w, leakage.words(t)) >= 30)
    assert sorted(r[:2] for r in leakage.scan_shard(index, [d for d, _ in plain], [t for _, t in plain], 0.5, 80)) == want
    assert leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_suffix_matches_equal_brute_force():
    rng = random.Random(2)
    items = leakage.Items({k: [f"w{rng.randrange(6)}" for _ in range(m)] for k, m in enumerate((40, 20, 10, 5, 2))})
    flat = np.array([rng.randrange(7) for _ in range(3000)])
    array = leakage.SuffixArray(flat)
    text = lambda p: flat[p : next((k for k in range(p, len(flat)) if not flat[k]), len(flat))].tolist()
    some = array.order[rng.sample(range(len(array.order)), 300)]
    where = {p: k for k, p in enumerate(array.order)}
    assert sorted(array.order) == np.flatnonzero(flat).tolist()
    assert [text(p) for p in sorted(some, key=where.get)] == sorted(text(p) for p in some)
    got = {(int(p), int(i), int(q)) for x in leakage.matches(array, items) for p, i, q in zip(*x)}
    want = {(p, i, q) for i, x in enumerate(items.coded) for n in [leakage.least_run(len(x))] for q in range(len(x) - n + 1) for p in range(len(flat) - n + 1) if (flat[p : p + n] == x[q : q + n]).all()}
    assert got == want


def found_leaks(spark, items, docs, **options):
    make = lambda rows, name: spark.createDataFrame(sorted(rows.items()), f"{name} bigint, text string")
    return sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(make(docs, "doc_id"), make(items, "item_id"), **options).collect())


def test_short_shared_and_blocked_items(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(4000)}"
    noise = lambda n: " ".join(word() for _ in range(n))
    short = {1: "alpha beta gamma", 2: "one two three four", 3: "solitary"}
    assert found_leaks(spark, short, {k: f"{noise(50)} {t} {noise(50)}" for k, t in short.items()} | {9: noise(100)}) == [(1, 1), (2, 2), (3, 3)]
    shared = [word() for _ in range(40)]
    six = {k: " ".join([*(f"own{k}x{j}" for j in range(6)), *shared, f"end{k}"]) for k in range(6)}
    changed = " ".join("other" if k % 6 == 5 else w for k, w in enumerate(shared))
    assert found_leaks(spark, six, {7: f"{noise(30)} {changed} {noise(30)}"}) == [(7, k) for k in range(6)]
    many = {k: " ".join(word() for _ in range(30)) for k in range(40)}
    docs = {k: f"{noise(20)} {many[k]}" for k in range(0, 40, 3)}
    whole = found_leaks(spark, many, docs)
    assert whole == [(k, k) for k in range(0, 40, 3)] == found_leaks(spark, many, docs, block_words=100)


def test_late_part_with_a_foreign_sentence_after_prose():
    """A chain that takes in stray pairs of earlier words must not hide the passage."""
    item = np.arange(1, 101)
    prose = [x for k in range(20) for x in (*item[2 * k : 2 * k + 2].tolist(), *[0] * 20)]
    window = np.array([*prose, *item[45:70].tolist(), *[0] * 60, *item[70:].tolist()])
    words, begin, end, longest = leakage.passage(item, window)
    assert 55 <= words < 70 and begin >= len(prose) - 100 and end == len(window) and longest == 30


def test_leaked_documents_are_removed(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(None, "no id")], "doc_id bigint, text string").withColumn("_maybe2", F.lit(1))
    found = spark.createDataFrame([(3, 1), (3, 2), (40, 1)], "doc_id bigint, item_id bigint")
    left = leakage.without_leaked(docs, found)
    assert left.columns == docs.columns and left.count() == 49 and left.where("doc_id in (3, 40)").count() == 0
    assert leakage.without_leaked(docs, found.limit(0)).count() == 51


CASES = {
    "Dr. Tavik and Ms. Orlen took approx. 5 kg vs. 3, i.e. more. See fig. 3 and no. 7 in a.js.": ["more.", "a.js."],
    'The note says: "Never do it. It will fail." We go.': ['fail."', "go."],
    '"Why does it fail?" asked the owner. Fine!': ["owner.", "Fine!"],
    "The adapter waits... then it goes. rank_it runs.": ["goes.", "runs."],
    "(The lattice drains.) (The other\ndrains.)": ["drains.)", "drains.)"],
    "## Head line\nText goes on\nhere\n\n- item one. Two.\n- item two\n\n1. a\n2. b": ["line", "here", "Two.", "two", "1. a", "2. b"],
    "1. a\n   1. b\n   2. c\n2. d\n   goes on\n3. e": ["1. a", "1. b", "2. c", "goes on", "e"],
    "- a\n  1. b\n  2. c\n- d": ["- a", "b", "c", "d"],
    "1. a\n1. b\n1. c": ["1. a", "1. b", "1. c"],
    "1. see page\n42. for more\n2. d": ["more", "2. d"],
    "Am 22. März kommt der Zug, d. h. nie, z. B. um 17,3 s bzw. Nr. 4. „Nie!“, sagte Frau Dr. Velmer.": ["Nr. 4.", "Velmer."],
    "Ключ и т. д. строит в 2025 г. через узел. «Зачем?» — спросил автор. См. рис. 3.": ["узел.", "автор.", "3."],
    "节点为什么删除？“队列！”她说，于是保存。耗时2.5秒。": ["删除？", "保存。", "2.5秒。"],
    "「索引は？」と尋ねた。次は9.2秒だ！": ["尋ねた。", "だ！"],
    "क्या है? सूचकांक नं. 822 है।": ["है?", "है।"],
    "เมื่อระบบ คำขอจึง\nกราฟ": ["เมื่อระบบ", "คำขอจึง", "กราฟ"],
    "¿Por qué? Según la Sra. Ulvane, la pág. 3, p. ej. esta. ¡Nunca!": ["qué?", "esta.", "¡Nunca!"],
    "Run `a.b(\"c. D\")` at 5 p.m. the day. Since v2.1.9 it is so?!": ["day.", "so?!"],
    "the end. next one starts. ": ["end.", "starts."],
    "No mark": ["No mark"],
    " \n\u00a0\n": [],
    "": [],
}


def test_sentences():
    for text, want in CASES.items():
        got = sentence_ends(text)
        assert len(got) == len(want), (text, [text[a:b] for a, b in sentence_spans(text)])
        assert all(text[:e].endswith(w) for e, w in zip(got, want)), (text, [text[a:b] for a, b in sentence_spans(text)])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB .!?\"'()“”「」。\n-1#`…»«", max_size=60))
def test_sentences_cover_the_text(text):
    spans = sentence_spans(text)
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert [b for _, b in spans] == sorted({b for _, b in spans})


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "Ab. Cd."), (2, None), (3, " "), (4, "x " * 200_000 + "end.")], "doc_id bigint, text string").withColumn("position", F.lit("clash"))
    assert sorted(map(tuple, sentences.split_sentences(df).collect()))[:2] == [(1, 0, 0, 3), (1, 1, 4, 7)]
    assert sentences.split_sentences(df, True).where("doc_id = 1 and position = 1").first()["sentence"] == "Cd."
    assert sentences.split_sentences(df.limit(0)).count() == 0
