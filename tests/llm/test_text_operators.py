"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; and brute force."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgraph.llm import chat, decontaminate, htmltext, katz, language, near_duplicates, packing, substrings, toxicity
from claimgraph.llm.common import Stage

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, hits string, t string, node string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 0.5, "x", "x", "x", "x", "x") for i, t, lang in rows], SCHEMA)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    long = words(rng, 6000)
    base = words(rng, 80)
    return [
        (1, base, "en"), (2, base, "en"), (3, None, "en"), (4, "", None), (5, "  \n\t ", "en"), (6, long, "en"), (None, base + " tail", "en"), (None, None, None),
        (7, "123 456 !!", "de"), (7, "123 456 !!", "de"), (8, base.replace(" ", "  \n", 5), "en"), (2**62, "one", "fr"), (-5, words(rng, 40), "fr"), (9, "a " * 300, "en"),
    ]


def test_substrings_against_brute_force(spark, odd_rows):
    rng = random.Random(5)
    shared = [words(rng, rng.randint(19, 60)) for _ in range(6)]
    rows = odd_rows + [(100 + k, " ".join(rng.choice([words(rng, 15), rng.choice(shared)]) for _ in range(6)), "en") for k in range(60)]
    split = lambda t: (t or "").encode().split()
    last, first = 2**63 - 1, {}
    for i, t, _ in rows:
        w = split(t)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            at = (last if i is None else i, s)
            first[k] = min(first.get(k, at), at)
    want = []
    for i, t, _ in rows:
        w, gone = split(t), set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (last if i is None else i, s):
                gone |= set(range(s, s + 20))
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    got = [tuple(r) for r in substrings.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination_spans_and_blocks(spark, odd_rows):
    rng = random.Random(6)
    items = [("i1", "The quick-brown fox, 10 times over THE lazy dog again and again!"), ("i2", "short item"), ("i3", None), ("i4", "..."), (None, "hidden words here"), ("i2", "short item")]
    text = "So: the QUICK brown fox 10 times over the lazy DOG again. A Short-Item! hidden words here"
    rows = odd_rows + [(50, text, "en"), (51, "shorter item", "en"), (52, words(rng, 30), "en")]
    table = spark.createDataFrame(items, "item_id string, text string")
    one = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(map(tuple, r["spans"]))) for r in decontaminate.find_contamination(frame(spark, rows), table).collect()}
    many = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(map(tuple, r["spans"]))) for r in decontaminate.find_contamination(frame(spark, rows), table, block_bytes=40).collect()}
    assert one == many
    hit = next(r for r in one if r[0] == 50)
    assert hit[2] == 10 + 1 + 2 + 3 and hit[3] == ("i1", "i2")
    assert [text[a:b] for a, b in hit[4]] == ["the QUICK brown fox 10 times over the lazy DOG again", "Short-Item! hidden words here"]
    assert next(r for r in one if r[0] == 51)[2] == 0 and any(r[0] is None for r in one)
    kept = decontaminate.without_contaminated(frame(spark, rows), table)
    assert kept.columns == frame(spark, []).columns and kept.count() == len(rows) - 1
    nothing = decontaminate.find_contamination(frame(spark, rows), spark.createDataFrame([], "item_id string, text string"))
    assert nothing.filter("n_hit > 0").count() == 0


def test_packing_round_trip(spark, odd_rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = odd_rows + [(60, "x <|endoftext|> y " * 40, "en")]
    out = packing.pack(frame(spark, rows), capacity=64).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 64
    o = out.sort_values(["sequence_id", "offset"])
    assert (o.groupby("sequence_id").length.cumsum() - o.length == o.offset).all()
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for p, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[str((i, p, s, n, zlib.crc32(ids[s : s + n].tobytes())))] += 1
    none = lambda x: None if x != x else int(x)
    assert want == Counter(str((none(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)) for r in out.itertuples())
    assert [n for _, n in packing.cut(130, 64)] == [2, 64, 64] and packing.cut(64, 64) == [(0, 64)]


def test_packing_writes_few_files_of_pieces(spark, odd_rows, monkeypatch):
    pytest.importorskip("public_tokenizers")
    made = []
    monkeypatch.setattr(packing, "Stage", lambda *a: made.append(Stage(*a)) or made[-1])
    docs = frame(spark, odd_rows).repartition(40)
    out = packing.pack(docs, capacity=64)
    assert len(made) == 1 and len(made[0].df.inputFiles()) <= spark.sparkContext.defaultParallelism < docs.rdd.getNumPartitions()
    assert out.drop("sequence_id", "offset").exceptAll(made[0].df.withColumnRenamed("id", "doc_id")).count() == 0
    assert out.count() == made[0].df.count() and out.filter("piece = 0").count() == len(odd_rows)


def test_packing_plans_are_whole_and_search_helps():
    better = 0
    for seed in range(20):
        rng = random.Random(seed)
        h = Counter(rng.choice([26, 30, 34, 40, 51]) if seed % 2 else rng.randint(1, 100) for _ in range(rng.choice([5, 60, 400])))
        plan = packing.best_fit(dict(h), 100)
        after = packing.improve(plan, 100)
        for p in (plan, after):
            assert sum((Counter({x: k * items.count(x) for x in set(items)}) for items, k in p.items()), Counter()) == h and all(sum(i) <= 100 for i in p)
        assert sum(after.values()) <= sum(plan.values())
        better += sum(after.values()) < sum(plan.values())
    assert better


def test_language(spark, odd_rows):
    rng = random.Random(8)
    rows = odd_rows + [(200 + k, words(rng, 30, "abcde" if k % 2 else "vwxyz"), "aa" if k % 2 else "zz") for k in range(80)]
    docs = frame(spark, rows)
    profiles = language.learn(language.training_rows(docs))
    got = {}
    for r in language.identify(docs.select("doc_id", "text", "score"), profiles).collect():
        got.setdefault(r["doc_id"], r)
    assert all(got[200 + k]["lang_pred"] == ("aa" if k % 2 else "zz") for k in range(80))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["lang_pred"] == got[4]["lang_pred"] == got[7]["lang_pred"] == "und"
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (3, 4, 5, 7)").count() == 0 and kept.filter("doc_id >= 200").count() == 81
    assert {r["lang_pred"] for r in language.identify(docs.select("text"), {}).collect()} == {"und"}


def test_grams_of_long_texts_are_counted_in_blocks(monkeypatch):
    rng = random.Random(29)
    texts = [words(rng, n) for n in (1, 2, 3, 40, 400)] + ["a", "ab", " é1ß ", "x  y"]
    whole = [language.grams(t) for t in texts]
    for t, (codes, counts) in zip(texts, whole):
        plain, padded = Counter(), " " + " ".join("".join(ch if ch.isalpha() else " " for ch in t.lower()).split()) + " "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != " " and not (n == 3 and g[1] == " "):
                    plain[sum(ord(ch) << 21 * k for k, ch in enumerate(g))] += 1
        assert dict(zip(codes.tolist(), counts.tolist())) == plain
    monkeypatch.setattr(language, "BLOCK", 7)
    for t, (codes, counts) in zip(texts, whole):
        again = language.grams(t)
        assert (again[0] == codes).all() and (again[1] == counts).all()


def brute_classes(rows):
    rolling = near_duplicates.Rolling()
    x = [near_duplicates.shingles(near_duplicates.words_of(t), rolling) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            need = near_duplicates.needed(len(x[i]), len(x[j]))
            if len(x[i]) and len(x[j]) and (near_duplicates.aligned(x[i], x[j], need) >= need or rows[i][0] == rows[j][0] is not None):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return {frozenset(i for i, g in enumerate(group) if g == k) for k in set(group)}


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = row[:]
        for j, b in enumerate(y):
            row[j + 1] = before[j] + 1 if a == b else max(row[j], before[j + 1])
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.randint(0, 6) for _ in range(rng.randint(1, 25))]
        y = [v if rng.random() < 0.9 else rng.randint(0, 6) for v in x] + [1] * rng.randint(0, 3)
        need, real = near_duplicates.needed(len(x), len(y)), lcs(x, y)
        got = near_duplicates.aligned(np.array(x, np.uint64), np.array(y, np.uint64), need)
        assert (got >= need) == (real >= need) and (real < need or got == real)


def test_near_duplicates_against_brute_force(spark, odd_rows):
    rng = random.Random(9)
    rows = [(k, t, lang) for k, (i, t, lang) in enumerate(odd_rows) if i != 7 and i is not None]
    for _ in range(8):
        base = words(rng, rng.randint(60, 150)).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((len(rows) + 100, " ".join(w), "en"))
    got = near_duplicates.near_duplicates(frame(spark, rows)).collect()
    place = {r[0]: k for k, r in enumerate(rows)}
    classes: dict = {}
    for r in got:
        classes.setdefault(r["class_id"], set()).add(place[r["doc_id"]])
    assert {frozenset(c) for c in classes.values()} == brute_classes(rows)
    assert all(min(rows[k][0] for k in c) == name for name, c in classes.items())
    odd = near_duplicates.near_duplicates(frame(spark, odd_rows)).collect()
    assert len(odd) == len(odd_rows)
    of = {r["doc_id"]: r["class_id"] for r in odd if r["doc_id"] is not None}
    assert of[1] == of[2] == of[8] == 1 and of[3] == 3 and of[4] == 4 and of[2**62] == 2**62
    assert {r["class_id"] for r in odd if r["doc_id"] is None} == {1, None}
    kept = near_duplicates.one_of_each(frame(spark, odd_rows))
    assert kept.filter("doc_id IN (2, 8)").count() == 0 and kept.filter("doc_id = 7").count() == 1 and kept.filter("doc_id IS NULL").count() == 2


def test_katz_against_brute_force_and_sums_to_one(spark, odd_rows):
    import math

    rng = random.Random(11)
    rows = odd_rows + [(300 + k, " ".join(rng.choice(["the", "a", "cat", "dog", words(rng, 1)]) for _ in range(40)), "en") for k in range(50)]
    train = katz.bucket_of("doc_id", 10) != 0
    got = katz.score(frame(spark, rows), train).collect()
    parts = katz.score(frame(spark, rows), train, chunk_bytes=3000, keys_a_bucket=200).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 6))
    assert sorted(map(key, got)) == sorted(map(key, parts))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    texts = [(i, (t or "").encode().lower().split() + ["end"]) for i, t, _ in rows]
    uni, bi = Counter(), Counter()
    for i, w in texts:
        if not held(i):
            uni.update(w)
            bi.update(zip(["begin", *w], w))

    def factor(c):
        n = Counter(c.values())
        cut = 6 * n[6] / n[1] if n[1] else 1.0
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0 for r in range(1, 6)}
        return lambda k: k * ((d[k] if 0 < d[k] < 1 else (k - 0.5) / k) if k <= 5 else 1)

    fu, fb, total = factor(uni), factor(bi), sum(uni.values())
    unknown = sum(c - fu(c) for c in uni.values()) / total
    one = lambda w: fu(uni[w]) / total if w in uni else unknown
    count, seen, freed = Counter(), Counter(), Counter()
    for (h, w), c in bi.items():
        count[h] += c
        seen[h] += one(w)
        freed[h] += c - fb(c)

    def p(h, w):
        if h not in count:
            return one(w)
        bare = freed[h] < 1e-9
        below = count[h] + 0.5 * bare
        return fb(bi[h, w]) / below if (h, w) in bi else (0.5 if bare else freed[h]) / below / (1 - seen[h]) * one(w)

    for h in ["begin", b"the", b"never", *list(count)[:20]]:
        assert abs(sum(p(h, w) for w in uni) + p(h, b"\0") - 1) < 1e-9
    want = sorted((str(i), len(w), round(sum(math.log10(p(h, x)) for h, x in zip(["begin", *w], w)), 6)) for i, w in texts)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(sorted(map(key, got)), want))
    nobody = katz.score(frame(spark, rows), F.lit(False)).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in nobody)


def test_katz_backs_off_recursively(spark, odd_rows):
    """Order 3 against a plain recursion over dictionaries; the distributions sum to one."""
    import math

    rng = random.Random(13)
    rows = odd_rows + [(300 + k, " ".join(rng.choice(["the", "a", "cat", "dog", "sat", words(rng, 1)]) for _ in range(40)), "en") for k in range(50)]
    got = katz.score(frame(spark, rows), katz.bucket_of("doc_id", 10) != 0, order=3, chunk_bytes=3000, keys_a_bucket=200).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    texts = [(i, (t or "").encode().lower().split() + ["end"]) for i, t, _ in rows]
    grams: dict = {n: Counter() for n in (1, 2, 3)}
    for i, w in texts:
        if not held(i):
            padded = ["begin", "begin", *w]
            for n in grams:
                grams[n].update(tuple(padded[k - n + 1 : k + 1]) for k in range(2, len(padded)))

    def factor(c):
        n = Counter(c.values())
        cut = 6 * n[6] / n[1] if n[1] else 1.0
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0 for r in range(1, 6)}
        return lambda k: k * ((d[k] if 0 < d[k] < 1 else (k - 0.5) / k) if k <= 5 else 1)

    cut, total = {n: factor(c) for n, c in grams.items()}, sum(grams[1].values())
    unknown = sum(c - cut[1](c) for c in grams[1].values()) / total
    after: dict = {}
    for n in (2, 3):
        for g, c in grams[n].items():
            after.setdefault(g[:-1], []).append((g[-1], c, c - cut[n](c)))

    def p(h, w):
        if not h:
            return cut[1](grams[1][w,]) / total if (w,) in grams[1] else unknown
        if h not in after:
            return p(h[1:], w)
        freed = sum(f for _, _, f in after[h])
        bare = freed < 1e-9
        below = sum(c for _, c, _ in after[h]) + 0.5 * bare
        if (*h, w) in grams[len(h) + 1]:
            return cut[len(h) + 1](grams[len(h) + 1][(*h, w)]) / below
        return weight(h, freed, bare, below) * p(h[1:], w)

    known: dict = {}

    def weight(h, freed, bare, below):
        if h not in known:
            known[h] = (0.5 if bare else freed) / below / (1 - sum(p(h[1:], v) for v, _, _ in after[h]))
        return known[h]

    for h in [("begin", "begin"), ("begin", b"the"), (b"the", b"cat"), (b"never", b"the"), (b"a", b"never")]:
        assert abs(sum(p(h, w) for (w,) in grams[1]) + p(h, b"\0") - 1) < 1e-9
    want = {}
    for i, w in texts:
        padded = ["begin", "begin", *w]
        want.setdefault((str(i), len(w)), []).append(sum(math.log10(p(tuple(padded[k - 2 : k]), padded[k])) for k in range(2, len(padded))))
    have: dict = {}
    for r in got:
        have.setdefault((str(r["doc_id"]), r["n_tokens"]), []).append(r["score"])
    assert have.keys() == want.keys() and all(np.allclose(sorted(have[k]), sorted(v), atol=1e-6) for k, v in want.items())
    assert {tuple(r)[:6] for r in katz.score(frame(spark, rows), katz.bucket_of("doc_id", 10) != 0, order=1).collect()} == {tuple(r)[:6] for r in got}


def test_toxicity_learns_inserted_words(spark, odd_rows):
    rng = random.Random(12)
    bad = ["zorkel", "blimfug", "quaxnit"]
    rows = list(odd_rows)
    labels = [(1, 0), (2, 0), (3, None), (None, 1)]
    for k in range(400, 1000):
        w, toxic = words(rng, 60, "abcdefghijklmnop").split(), k % 4 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w), "en"))
        labels.append((k, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.learn(docs, table.filter(toxicity.bucket_of("doc_id", 5) != 0))
    got = [r for r in toxicity.score(docs.select("doc_id", "text", "score"), model).collect()]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.9
    assert {r["score"] for r in toxicity.score(docs.select("text"), toxicity.fit([], ["x"])).collect()} == {0.0}


def test_html_text(spark):
    page = (
        "<html><head><title>T</title><script>x('<p>no</p>')</script></head><body><nav><ul><li><a href=1>Home</a><li><a href=2>More</a></ul></nav><div class=cookie-notice>We use cookies. <button>OK</button></div>"
        "<article><h1>A title</h1><p>First <b>bold</b>&nbsp;text &amp; more words, enough to read on for a while.<br>Next line.<p>Second paragraph with a number of words, too, and a stop.</p></article>"
        "<section id=comments><h3>Comments</h3><p>Nice one, I think so too, and so on.</p></section><footer>&copy; 2020</footer>"
    )
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, None, "<p>cut <b", "x"), (None, "u", page, "x")], "page_id long, url string, html string, extra string")
    got = [r["text"] for r in htmltext.extract(rows).orderBy(F.col("page_id").asc_nulls_last()).collect()]
    want = "A title\n\nFirst bold text & more words, enough to read on for a while. Next line.\n\nSecond paragraph with a number of words, too, and a stop."
    assert got[0] == got[4] == want and got[1] == got[2] == ""


def test_html_model_on_unseen_layouts():
    trees, says = htmltext.learn(htmltext.examples())
    right = 0
    unseen = htmltext.examples(150, seed=4242)
    for nodes, y in unseen:
        main = htmltext.decode(nodes, trees.probability(htmltext.features(nodes, says)))
        right += all(a == b for n, a, b in zip(nodes, main, y) if n.tag == "#text")
        assert all(main[0] or not m for m in main)
    assert right / len(unseen) > 0.9


def test_chat_rotation(spark):
    forged = chat.rotate(spark.createDataFrame([(1, 1, "a|>", "x"), (1, 2, "b", "y")], "conv_id long, turn long, role string, text string"))
    assert {r["text"] for r in forged.collect()} == {"<|user name=a| >|>\nx<|end|>\n<|assistant|>\ny<|end|>\n", "<|assistant|>\nx<|end|>\n<|user name=b|>\ny<|end|>\n"}
    rows = [(1, 2, "bob", "hi <|end|>"), (1, 1, "ann", "hello"), (1, 0, "system", "be kind"), (1, 3, None, None), (2, 1, "system", "alone"), (None, 1, "ann", "x"), (1, None, "ann", "late")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, k string")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    r = got[1, "ann"]
    assert r["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhello<|end|>\n<|user name=bob|>\nhi < |end|><|end|>\n<|user name=unknown|>\n<|end|>\n<|assistant|>\nlate<|end|>\n"
    assert [r["text"][a:b] for a, b in r["mask"]] == ["hello<|end|>\n", "late<|end|>\n"] and (r["n_turns"], r["n_own"]) == (5, 2)


def test_empty_tables(spark):
    none, items = frame(spark, []), spark.createDataFrame([], "item_id string, text string")
    assert substrings.remove_repeats(none).count() == decontaminate.find_contamination(none, items).count() == packing.pack(none).count() == 0
    assert near_duplicates.near_duplicates(none).count() == katz.score(none, F.lit(True)).count() == 0
    assert language.identify(none.select("text"), language.learn(none)).count() == 0
    model = toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none.select("text"), model).count() == 0
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert htmltext.extract(spark.createDataFrame([], "html string")).count() == 0


def test_a_drifting_chain_is_one_class(spark):
    rng = random.Random(41)
    text, rows = [f"w{rng.randrange(10**9)}" for _ in range(80)], []
    for i in range(1200):
        rows.append((i, " ".join(text), "en"))
        text[(i * 7 + 11) % 80] = f"w{rng.randrange(10**9)}"
    classes = Counter(r["class_id"] for r in near_duplicates.near_duplicates(frame(spark, rows)).collect())
    assert classes == {0: 1200}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_near_duplicates_of_ten_thousand_documents(spark):
    """No link of the whole table is lost: all pairs by a plain join on the shingles that can't all be missed, aligned one by one."""
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].dropna()
    keys = docs["text"].map(lambda t: b" ".join(near_duplicates.words_of(t)))
    docs = docs[keys != b""].assign(key=keys)
    first = docs.sort_values("doc_id").groupby("key")["doc_id"].transform("min")
    reps = docs[docs["doc_id"] == first]
    rolling = near_duplicates.Rolling()
    plain = {i: near_duplicates.shingles(near_duplicates.words_of(t), rolling) for i, t in zip(reps["doc_id"], reps["text"])}
    sets = {i: near_duplicates.labelled(x) for i, x in plain.items()}
    known, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    rows = []
    for i, x in sets.items():
        often = counts[np.searchsorted(known, x)]
        order = np.lexsort((x, often))[: len(x) - int(np.ceil(0.8 * len(x) - 1e-9)) + 1]
        rows += [(int(x[k]), i) for k in order if often[k] > 1]
    t = pd.DataFrame(rows, columns=["x", "i"])
    met = t.merge(t, on="x")
    met = met[met["i_x"] < met["i_y"]][["i_x", "i_y"]].drop_duplicates()
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in met.itertuples(index=False):
        x, y = plain[a], plain[b]
        need = near_duplicates.needed(len(x), len(y))
        if min(len(x), len(y)) >= need and len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= need and near_duplicates.aligned(x, y, need) >= need:
            ra, rb = root(a), root(b)
            group[max(ra, rb)] = min(ra, rb)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(got[i] == root(f) for i, f in zip(docs["doc_id"], first))
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(got[i] == i for i in set(got) - set(docs["doc_id"]))


def test_common_toxic_words_and_phrases_stand_out():
    rng = random.Random(17)
    toxic = [[b"p%d" % rng.randrange(10**6), *([b"zorkel"] if i < 1000 else []), b"q%d" % rng.randrange(10**6), b"get", b"lost", b"z%d" % rng.randrange(10**6)] for i in range(1500)]
    ordinary = [[b"r%d" % i, *([b"zorkel"] if i < 60 else []), b"get", b"not", b"lost"] for i in range(6000)]
    assert toxicity.unusual(toxic, ordinary) == {b"zorkel", b"get lost"}
    copies = [[b"a", b"copied", b"text"]] * 300
    assert toxicity.unusual(copies + toxic, ordinary) == {b"zorkel", b"get lost"}
    assert toxicity.stretches([b"a", b"zorkel", b"get", b"lost", b"b", b"zorkel"], {b"zorkel", b"get lost"}) == [b" zorkel get lost ", b" zorkel "]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_packing_of_the_given_tables():
    """Every id as the tokenizers file gives it; the search empties bins that best fit leaves, down to the bound of sf0.1."""
    import pandas as pd

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.encoder()
    for sf, want in (("sf0.001", 193), ("sf0.01", 964), ("sf0.1", 9871)):
        texts = [t or "" for t in pd.read_parquet(f"{os.path.dirname(SF)}/{sf}/documents.parquet")["text"]]
        got = [encode(t) for t in texts]
        if sf != "sf0.1":
            assert all(e.ids == g.tolist() for e, g in zip(plain.encode_batch(texts, add_special_tokens=False), got))
        h = Counter(n for g in got for _, n in packing.cut(len(g) + 1))
        plan = packing.best_fit(dict(h), 1024)
        after = packing.improve(plan, 1024)
        bound = -(-sum(n * k for n, k in h.items()) // 1024)
        assert bound <= sum(after.values()) <= min(want, sum(plan.values())) and (sf != "sf0.1" or sum(after.values()) == bound)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_toxicity_on_held_out_labels():
    """The order of held-out rows (area under the curve) and the 0.5 decision, with the few labels of sf0.1 to learn from."""
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].merge(pd.read_parquet(f"{SF}/labels.parquet")[["doc_id", "toxic"]], on="doc_id").dropna()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in docs["doc_id"]])
    y, texts = docs["toxic"].to_numpy(), docs["text"].to_numpy()
    model = toxicity.fit(list(texts[~held & (y == 1)]), list(texts[~held & (y == 0)]))
    pair = model.compressors()
    score, y = np.array([model.score(t, pair) for t in texts[held]]), y[held]
    ranks = pd.Series(score).rank().to_numpy()
    area = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert area > 0.93 and ((score >= 0.5) & (y == 0)).sum() < 0.02 * (y == 0).sum() and ((score >= 0.5) & (y == 1)).sum() > 0.7 * y.sum()


@pytest.mark.parametrize("tag", "video audio select svg canvas noscript template datalist".split())
def test_unclosed_elements_keep_the_page(tag):
    leaves = [n.text for n in htmltext.parse(f"<div><{tag}>fallback<article><p>The text.</p></article></div><p>More.</p>") if n.tag == "#text"]
    assert leaves == ["The text.", "More."]


def test_formulas_and_objects_are_text():
    leaves = [n.text for n in htmltext.parse("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object>a picture</object>.</p>") if n.tag == "#text"]
    assert leaves == ["Let x=1 be a picture."]


#: Pages written by hand, of kinds that the generator of the training pages doesn't make, with their main blocks.
BY_HAND = [
    (
        '<html><body><div id="mw-head"><ul><li><a href="/">Read</a></li><li><a href="/e">Edit</a></li></ul></div><div id="content"><h1>Tin</h1><p>Tin is a chemical element with the symbol Sn; it is a silvery metal, soft and bendable.</p>'
        '<p>It shows its chemical likeness to its neighbours, and has two main states.</p><h2>Uses</h2><p>Most tin goes into solder, and much into plating, where it keeps steel from rusting.</p></div><footer><p>Text under licence.</p><a href="/p">Privacy</a></footer></body></html>',
        ["Tin", "Tin is a chemical element with the symbol Sn; it is a silvery metal, soft and bendable.", "It shows its chemical likeness to its neighbours, and has two main states.", "Uses", "Most tin goes into solder, and much into plating, where it keeps steel from rusting."],
    ),
    (
        '<body><nav><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a></nav><main><article><h1>Bridge reopens after two years</h1><p>The old bridge over the river opened to traffic on Monday, two years after a flood had damaged it.</p>'
        '<aside class="related"><h3>More news</h3><ul><li><a href="/1">Flood relief</a></li><li><a href="/2">Road works</a></li></ul></aside><p>Drivers welcomed the change, since the way round had taken half an hour.</p></article></main>'
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>About time, I say, this took far too long.</p></div></section><div class="newsletter"><form><label>Mail</label><input><button>Subscribe</button></form></div></body>',
        ["Bridge reopens after two years", "The old bridge over the river opened to traffic on Monday, two years after a flood had damaged it.", "Drivers welcomed the change, since the way round had taken half an hour."],
    ),
    (
        '<div class="cookie-banner">We use cookies to make the site better. <button>Accept</button></div><div class="blog-post"><h2>How I bake bread</h2><p>Flour, water, salt and time are all that you need, but the time has to be long.</p><ul><li>Mix the dough in the evening and leave it in a cool place.</li>'
        '<li>Shape it in the morning, let it rise once more and bake it hot.</li></ul><p>Leave the loaf for an hour before you cut it, hard as that is.</p></div><div class="share-buttons"><a href="#">Tweet</a><a href="#">Mail</a></div><div id="footer">&copy; 2021 A baker</div>',
        ["How I bake bread", "Flour, water, salt and time are all that you need, but the time has to be long.", "Mix the dough in the evening and leave it in a cool place.", "Shape it in the morning, let it rise once more and bake it hot.", "Leave the loaf for an hour before you cut it, hard as that is."],
    ),
]


def test_html_model_on_pages_written_by_hand():
    model = htmltext.learn(htmltext.examples())
    for (page, want), got in zip(BY_HAND, htmltext.texts([p for p, _ in BY_HAND], *model)):
        assert got.split("\n\n") == want


def test_all_attribute_tokens_and_siblings_count():
    long = " ".join(["mt"] * 40)
    assert "sidebar" in htmltext.parse(f'<div class="{long} sidebar">x</div>')[1].tokens
    nodes = htmltext.parse("<h2>a</h2>" * 50 + "<p>b</p>" * 50)
    rows = htmltext.features(nodes, {})
    assert rows[[n.tag for n in nodes].index("p"), 19] == 0.5


def test_toxicity_calibrates_on_rows_the_dictionaries_have_not_seen(monkeypatch):
    rng = random.Random(23)
    toxic, ordinary = ([f"{p} {words(rng, 30)}{bad}" for p in "az" for _ in range(n)] for n, bad in ((60, " zorkel"), (120, "")))
    learned, judged = set(), set()
    unusual, savings = toxicity.unusual, toxicity.Model.savings
    monkeypatch.setattr(toxicity, "unusual", lambda a, b: learned.update(map(tuple, a + b)) or unusual(a, b))
    monkeypatch.setattr(toxicity.Model, "savings", lambda m, t, c: judged.add(tuple(toxicity.words_of(t))) or savings(m, t, c))
    toxicity.fit(toxic, ordinary)
    assert not learned & judged and learned | judged == {tuple(toxicity.words_of(t)) for t in toxic + ordinary}
    assert all({w[0] for w in part} >= {b"a", b"z"} for part in (learned, judged))
