import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cragline.llm import ann, bpe, chat, ctw, decontaminate, gsaca, langid, neardup, queries, suffixdedup, tokenfile, toxicity
from cragline.llm.gsaca import suffix_array

SF = "/root/testdata/sf0.001"
WORD = P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, slice int, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing column names."""
    base = " ".join(f"wort{i % 37} und{i % 11}" for i in range(120))
    rows = [(1, None, "de", "a", 0, 1, "x"), (2, "", None, None, None, None, None), (None, base, "de", "a", 1, 2, "y"), (3, base, "de", "a", 5, 3, "z"), (3, base, "de", "a", 5, 3, "z"), (4, base + " mehr", "de", None, 2, 4, ""), (5, "\x00 é ß Σ", "fr", "b", 3, 1, None), (6, "?!", "fr", "b", 3, 1, None), (7, "x" * 200_000, None, "b", 3, 1, None), (8, "the cat sat", "en", "b", 3, 1, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark, odd, empty):
    model = langid.fit(langid.train_rows(odd))
    got = [tuple(r) for r in langid.identify(odd, model, ["doc_id", "slice", "kept"]).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 10 and by[1][3] == by[2][3] == by[6][3] == "und" and by[4][3] == "de"
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(empty)).collect()} == {"und"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() >= 0.97 * out.count()


def test_mixture_finds_two_languages():
    ll = np.log(np.array([[0.9, 0.1, 0.01]] * 30 + [[0.1, 0.9, 0.01]] * 10, np.float32) + 1e-6) * 4
    share, size = langid.mixture(ll, np.array([40]), np.full(40, 5), 20, 2.0)
    assert size[0] == 2 and abs(share[0, 0] - 0.75) < 0.03 and share[0, 2] == 0


def plain_mixture(ll, letters, rounds, penalty):
    """The selection for one text, in plain floats."""

    def em(share, n):
        for _ in range(n):
            new = [0.0] * len(share)
            for row, w in zip(ll, letters, strict=True):
                r = [math.exp(x - max(row)) * s for x, s in zip(row, share, strict=True)]
                for k, x in enumerate(r):
                    new[k] += w * x / max(sum(r), 1e-30)
            share = [x / sum(letters) for x in new]
        mass = sum(math.log(max(sum(math.exp(x - max(row)) * s for x, s in zip(row, share, strict=True)), 1e-30)) + max(row) for row in ll)
        return share, mass

    n = len(ll[0])
    share, _ = em([1 / n] * n, rounds)
    order = sorted(range(n), key=lambda k: -share[k])
    best, size, bound = None, 0, -math.inf
    for k in range(1, n + 1):
        part = [max(share[j], 1e-6) if j in order[:k] else 0.0 for j in range(n)]
        part, value = em([x / sum(part) for x in part], 3 if k > 1 else 0)
        value -= penalty * k * math.log(sum(letters) + 1)
        if value <= bound:
            break
        best, size, bound = part, k, value
    return best, size


def test_mixture_equals_brute_force_alone_and_in_any_batch():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 40, 30)
    mean = np.repeat(rng.normal(size=(30, 5)) * rng.choice([0.5, 3], 30)[:, None], words, axis=0)
    ll = (mean + 4 * rng.normal(size=(words.sum(), 5)) - 6).astype(np.float32)
    letters = rng.integers(1, 9, words.sum())
    share, size = langid.mixture(ll, words, letters, 8, 2.0)
    cut = np.r_[0, np.cumsum(words)]
    assert len(set(size.tolist())) > 2
    for k in range(30):
        here = slice(cut[k], cut[k + 1])
        one, n = langid.mixture(ll[here], words[k : k + 1], letters[here], 8, 2.0)
        want, m = plain_mixture(ll[here].astype(float).tolist(), letters[here].tolist(), 8, 2.0)
        assert n[0] == size[k] == m and np.allclose(one[0], share[k], atol=1e-6) and np.allclose(want, share[k], atol=1e-3), k


def test_language_tells_scripts_apart(spark):
    text = {"ru": "мама мыла раму и съела кашу", "uk": "мати їла кашу і пішла гуляти", "el": "η μητέρα τρώει το φαγητό", "hi": "माँ खाना खाती है और सोती है", "zh": "妈妈在家里吃饭 然后睡觉", "en": "mother eats her food and sleeps"}
    rows = [(i, f"{t} " * (1 + i % 3), x) for i, (x, t) in enumerate([*text.items()] * 4)] + [(99, "\u0301 ?! 12", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got.pop(99) == "und" and all(got[i] == x for i, _, x in rows[:-1])


def test_language_does_not_depend_on_the_room_for_entries(spark):
    rng = random.Random(6)
    say = {x: ["".join(rng.choice("abcdefghijklmnoßéж") for _ in range(rng.randrange(2, 9))) for _ in range(60)] for x in "uvwxyz"}
    pure = spark.createDataFrame([(" ".join(rng.choices(say[x], k=400)), x) for x in say], "text string, lang string")
    rows = [(i, " ".join(rng.choice(say[a if rng.random() < 0.7 else b]) for _ in range(rng.choice([1, 9, 300]))), a) for i in range(60) for a, b in [rng.sample("uvwxyz", 2)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(pure)
    whole = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    # a single word of the other language names that one, so only long texts must get their main language
    assert all(whole[i]["lang_pred"] == x and whole[i]["n_langs"] == 2 for i, t, x in rows if t.count(" ") > 100)
    for entries in (600 * 6, 40 * 6, 1):  # a text or two at a time, long texts in parts of words, a word at a time
        for r in langid.identify(docs, model, entries=entries).collect():
            want = whole[r["doc_id"]]
            assert (r["lang_pred"], r["n_langs"]) == (want["lang_pred"], want["n_langs"]) and abs(r["score"] - want["score"]) < 1e-4


def test_a_thousand_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêë"
    word = lambda k: letters[k % 37] + letters[k // 37 % 37] + letters[(k * 7 + 3) % 37]
    rows = [(k, " ".join([word(k)] * 6), f"l{k:04d}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.names) == 1000 and len(model.start) == langid.SLOTS + 1 and len(model.value) <= 3000
    plain = np.full((langid.SLOTS, 3), 0.5)
    for k in range(3):
        code = langid._grams(np.frombuffer(rows[k][1].encode(), np.uint8), np.array([0, len(rows[k][1].encode())]))[0]
        np.add.at(plain[:, k], code, 1)
    assert np.array_equal(model.rows(np.arange(langid.SLOTS))[:, :3], np.log(plain / plain.sum(0)).astype(np.float32))
    assert all(r["lang_pred"] == f"l{r['doc_id']:04d}" for r in langid.identify(docs, model).collect())


def test_bpe_equals_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    texts = ["", "Don't STOP 123 !!! É", "aaaaaaa abababab", "a<|endoftext|>B <|startoftext|", "İΣΑΣ́ \x85\x1cq", "=" * 3000, "né​word x"]
    b = bpe.Bpe(bpe.load_spec(WORD))
    ids, offs = b.encode(pa.array(texts))
    dec = b.decode(ids, offs).to_pylist()
    for k, t in enumerate(texts):
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids[offs[k] : offs[k + 1]].tolist() == want and dec[k] == tok.decode(want, skip_special_tokens=False)
    out = {r["doc_id"]: r for r in bpe.encode_decode(odd, WORD).collect()}
    assert out[1]["n_tokens"] == out[2]["n_tokens"] == 0 and out[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_decode(empty, WORD).count() == 0


def test_ctw_equals_brute_force(spark, odd, empty):
    rows = [(i, t) for i, t in enumerate(["abab ab", "abba", None, "", "Ab c ab", "bbb"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    depth = 3
    got = {r["doc_id"]: r for r in ctw.score(docs, depth, 16, 32).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    seq = {i: list((t or "").lower().encode()) + [255] for i, t in rows}
    count: dict = {}
    for i, s in seq.items():
        for k, x in enumerate(s):
            ctx = ([255] * depth + s[:k])[-depth:]
            for d in range(depth + 1):
                for j in range(8):
                    c = count.setdefault((tuple(ctx[depth - d :]), (1 << j) | (x >> (8 - j))), [0, 0])
                    if not held[i]:
                        c[(x >> (7 - j)) & 1] += 1
    from math import exp, lgamma, log, log10, pi

    kt = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)
    kids: dict = {}
    for (ctx, node), c in count.items():
        if ctx and sum(c):
            kids.setdefault((ctx[1:], node), []).append((ctx, node))

    def weight(key):
        e = kt(*count[key])
        if len(key[0]) == depth:
            return e
        a, b = e, sum(weight(k) for k in kids.get(key, []))
        return max(a, b) + log(exp(a - max(a, b)) + exp(b - max(a, b))) - log(2)

    for i, s in seq.items():
        total = 0.0
        for k, x in enumerate(s):
            ctx = ([255] * depth + s[:k])[-depth:]
            for j in range(8):
                p, reach, bit = 0.0, 1.0, (x >> (7 - j)) & 1
                for d in range(depth + 1):
                    key = (tuple(ctx[depth - d :]), (1 << j) | (x >> (8 - j)))
                    c = count.get(key, [0, 0])
                    if not sum(c):
                        p += reach * 0.5
                        break
                    stop = exp(kt(*c) - log(2) - weight(key)) if d < depth else 1.0
                    p += reach * stop * (c[bit] + 0.5) / (sum(c) + 1)
                    reach *= 1 - stop
                total += log10(p)
        assert abs(got[i]["score"] - total) < 1e-9, i
    train = [w for i, t in rows if not held[i] for w in [*(t or "").lower().split(), "</end>"]]
    n, v = len(train), len(set(train))
    for i, t in rows:
        toks = [*(t or "").lower().split(), "</end>"]
        want = sum(log10((train.count(w) + 0.5) / (n + 0.5 * (v + 1))) for w in toks)
        assert abs(got[i]["base_score"] - want) < 1e-9 and got[i]["n_tokens"] == len(toks) and got[i]["n_known"] == sum(w in train for w in toks) and got[i]["train_tokens"] == n
    assert ctw.score(odd, 3).count() == 10 and ctw.score(empty, 3).count() == 0


def test_chat_round_trip(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    texts = ["</s>[INST] ok [/INST]", "\\\\</s>\\", None, "", "é\n[ROLE]x[/ROLE]", "<s><s>"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["system", "user", "assistant", None, "assistant", "user"], texts, strict=True))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_turns(df, path, P.PATTERN)
    back = {(r["conv_id"], r["turn"]): r for r in chat.read_turns(made, path, P.PATTERN).collect()}
    for c, t, r, x in rows:
        got = back[(c, t)]
        assert (got["role"], got["text"]) == (r or "", x or "") and got["loss_text"] == ((x or "") if r == "assistant" else "")
    assert chat.digest(chat.read_turns(made, path, P.PATTERN)).count() == 2
    assert chat.digest(chat.read_turns(chat.format_turns(df.filter("false"), path, P.PATTERN), path, P.PATTERN)).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        t = [rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randrange(30))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("few", [0, 24, 10**6])
def test_suffix_arrays_of_many_texts(monkeypatch, few):
    monkeypatch.setattr(gsaca, "FEW", few)
    rng = random.Random(few)
    for _ in range(60):
        texts = [[rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(60))]
        got = gsaca.suffix_arrays(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts], np.int64)).tolist()
        for t in texts:
            here, got = got[: len(t)], got[len(t) :]
            assert [x - min(here) for x in here] == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("crowd", [64, 1])
def test_suffix_dedup_equals_brute_force(spark, odd, empty, monkeypatch, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    rng = random.Random(5)
    passage = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (50, 49, 180, 60)]
    rows = [(i, "".join(rng.choice([*passage, "".join(rng.choice("xyz ") for _ in range(rng.randrange(40)))]) for _ in range(rng.randrange(7)))) for i in range(60)]
    for data, size in ((spark.createDataFrame(rows, "doc_id long, text string"), 700), (odd, 1 << 20)):
        got = suffixdedup.dedup(data, True, size, 2 * size).collect()
        seen: dict = {}
        src = [(r["doc_id"], (r["text"] or "").encode()) for r in data.collect()]
        for i, b in src:
            if i is not None:
                for k in range(len(b) - 49):
                    seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
        want = []
        for i, b in src:
            gone = bytearray(len(b))
            if i is not None:
                for k in range(len(b) - 49):
                    if seen[b[k : k + 50]] < i:
                        gone[k : k + 50] = b"\1" * 50
            want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got)
    assert suffixdedup.dedup(empty).count() == 0


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("a b c d e f g".split()) for _ in range(20)) + {0: "", 1: " bad", 2: " bad awful", 3: " bad awful vile"}[i % 4], i % 4) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model["t"]) == 3 and (np.diff(model["t"]) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i]["toxic"] == (i % 4 > 0) for i in range(300, 400)]) > 0.97
    assert np.corrcoef([got[i]["severity"] for i in range(300, 400)], [i % 4 for i in range(300, 400)])[0, 1] > 0.9
    assert toxicity.score(odd, model).count() == 10 and toxicity.score(odd, toxicity.fit(empty, labels)).filter("toxic").count() == 0


@pytest.mark.parametrize("rounds, short, block, common, wide", [(3, 16, 2048, 128, 512), (0, 2, 3, 128, 512), (0, 2, 5, 1, 512), (0, 16, 2048, 128, 512), (1, 2, 5, 3, 80)])
def test_near_duplicates_equal_brute_force(spark, odd, empty, monkeypatch, rounds, short, block, common, wide):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "WIDE", wide)
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "COMMON", common)
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(90)]
    rows = []
    for i in range(40):
        w = list(base if i % 2 else base[:45] + [f"u{i}_{k}" for k in range(45)])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    rows += [(100, "a b"), (101, "A  B"), (102, "a c"), (103, None), (104, " "), (105, " ")]
    again = spark.createDataFrame([(1, "p q"), (2, "p q"), (2, "r s"), (3, "r s")], "doc_id long, text string")
    assert {r["component_id"] for r in neardup.cluster(again).collect()} == {1}
    got = {r["doc_id"]: r for r in neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert all(got[i]["component_id"] == comp[i] and got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (comp[i] == i) for i in sets)
    assert {r["component_id"] for r in neardup.cluster(odd).filter("doc_id in (3, 4)").collect()} == {3} and neardup.cluster(empty).count() == 0


@pytest.mark.parametrize("block", [10**6, 4])
def test_decontamination(spark, odd, empty, block):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("aa bb cc dd ee".split()) for _ in range(n))
    items = [(1, "Q-u ick, brown"), (2, words(14)), (2, words(3)), (None, None), (3, ""), (None, "zz yy")]
    docs = [(i, words(rng.randrange(60)) + rng.choice(["", " " + (items[1][1]), " Q u ICK brown zz yy"])) for i in range(30)] + [(99, None)]
    got = {r["doc_id"]: r for r in decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, x in items:
            v = split(x)
            for k in range(max(1, len(v) - 9) if v else 0):
                win = v[k : k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add("" if item is None else str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.scan(odd, bench).count() == 10 and decontaminate.scan(empty, bench).count() == 0 and decontaminate.scan(odd, bench.filter("false")).filter("contaminated").count() == 0


@pytest.mark.parametrize("block", [10**6, 2_000])
def test_decontamination_of_a_sentence_that_many_items_share(spark, block):
    common = "one two three four five six seven eight nine ten"
    items = [(f"i{k}", common + (f" own{k}" if k % 2 else "")) for k in range(3_000)]
    docs = [(k, f"{common} {common} own{k} " * (1 + k % 3)) for k in range(250)] + [(900, "clean text"), (901, None)]
    got = {r["doc_id"]: r for r in decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id string, text string"), block=block).collect()}
    every = hashlib.sha256(",".join(sorted(i for i, _ in items)).encode()).hexdigest()
    for k in range(250):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (21 * (1 + k % 3), (20 + k % 2) * (1 + k % 3), 3_000, every)
    assert [got[k]["contaminated"] for k in (900, 901)] == [False, False] and got[900]["n_items"] == 0


def test_windows_that_items_share_are_looked_up_once(monkeypatch):
    monkeypatch.setattr(decontaminate, "_counts", lambda _, tokens: np.ones(len(tokens), np.int64))
    window = np.arange(1, 11, dtype=np.int64)
    t = decontaminate._table(None, pa.table({"item": [f"i{k}" for k in range(20_000)], "words": pa.array([window] * 20_000, pa.list_(pa.int64()))}))
    h, d, first = np.tile(window, 500).astype(np.uint64), np.zeros(5_000, np.int64), np.array([0, 5_000])
    assert len(t["size"]) == 1
    for most in (1, 7, 1 << 20):
        begin, win = decontaminate._match(t, h, d, first, most)
        assert begin.tolist() == list(range(0, 5_000, 10)) and not win.any()
    assert decontaminate._items(t, np.unique(win)) == sorted(f"i{k}" for k in range(20_000))


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(spark, odd, empty, planes):
    ids = np.random.default_rng(1).integers(0, 2**32, tokenfile.BLOCK + 77, dtype=np.uint32)
    assert (tokenfile.join_planes(*tokenfile.shuffle_planes(ids, planes), len(ids), planes) == ids).all()
    got = tokenfile.read(spark, tokenfile.write(odd, WORD, planes=planes), planes).toPandas().sort_values("start")
    n = got.n_tokens.to_numpy()
    assert len(got) == 10 and (got.start.to_numpy() == np.cumsum(n) - n).all() and got.doc_id.dropna().is_monotonic_increasing
    b = bpe.Bpe(bpe.load_spec(WORD))
    one, _ = b.encode(pa.array(["the cat sat"]))
    assert got[got.doc_id == 8].ids_crc32.iloc[0] == zlib.crc32(np.append(one, 1).astype("<u4").tobytes())
    assert tokenfile.read(spark, tokenfile.write(empty, WORD)).count() == 0


@pytest.mark.parametrize("name, table", [("word_bpe_49k.json", True), ("word_bpe_49k.json", False), ("byte_bpe_50k.json", False)])
def test_token_files_equal_the_library(spark, odd, name, table):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(name))
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table else odd
    got = tokenfile.read(spark, tokenfile.write(docs, P.path(name))).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, want = 0, []
    for i, t in rows:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    if name.startswith("word"):
        back = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(docs, P.path(name)).collect()}
        for i, t in rows:
            ids = tok.encode(t, add_special_tokens=False).ids
            assert back[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_token_files_give_the_library_every_whole_text(monkeypatch):
    import tokenizers

    real, seen = tokenizers.Tokenizer, []

    class Seen:
        def __init__(self, tok):
            self.tok = tok

        @classmethod
        def from_str(cls, spec):
            return cls(real.from_str(spec))

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return self.tok.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Seen)
    texts = ["The cat. The cat.", None, "", "the  cat.\nThe cat", "The cat. The cat."] * tokenfile.CALL
    ids, offs = tokenfile.Library(bpe.load_spec(WORD)).encode(pa.array(texts))
    assert seen == [t or "" for t in texts]
    tok = real.from_file(WORD)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[1000:1200] = x[999]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] * 8), (2200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df).toPandas()
    u = x.astype(float)
    hit = total = 0
    for q in range(0, 1500, 50):
        s = (u * u[q]).sum(1) / np.sqrt((u * u).sum(1) * (u[q] @ u[q]))
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        hit += len(set(best) & set(mine.vec_id))
        total += 5
        assert np.allclose(s[mine.vec_id.to_numpy()], mine.score, atol=1e-12)
    assert hit >= 0.9 * total and set(got.query_id) == set(range(0, 1500, 50))
    assert ann.nearest(df.filter("false")).count() == 0


def test_nearest_takes_large_small_and_rare_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6)) * np.where(np.arange(120) % 2, 1e200, 1e-200)[:, None]
    y = rng.normal(size=(30, 3))
    rows = [(i, v.tolist(), "x", 0.5) for i, v in enumerate(x)] + [(200 + 10 * i, v.tolist(), "y", None) for i, v in enumerate(y)]
    rows += [(50, x[50].tolist(), "again", 1.0), (None, x[3].tolist(), None, None), (500, None, None, None)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, score double")).toPandas()
    big = {i: np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for i, v in [*enumerate(x), *((200 + 10 * i, v) for i, v in enumerate(y))]}
    for q in [0, 50, 100, *range(200, 500, 50)]:
        s = {i: float(big[q] @ v / np.sqrt((big[q] @ big[q]) * (v @ v))) for i, v in big.items() if i != q and len(v) == len(big[q])}
        want = sorted(s, key=lambda i: (-s[i], i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want and np.allclose(mine.score, [s[i] for i in want], atol=1e-12), q
    assert set(got.query_id) == {0, 50, 100, *range(200, 500, 50)}


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("a b c d bad worse".split()) for _ in range(8)), rng.randrange(3)) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, t, _ in rows:
        _, col = toxicity.features(pa.array([t]))
        s = sum(float(model["w"][c]) for c in col)
        below = [1 / (1 + math.exp(s - x)) for x in model["t"]]
        p = [b - a for a, b in zip([0, *below], [*below, 1], strict=True)]
        assert abs(got[i]["severity"] - (p[1] + 2 * p[2])) < 1e-6 and got[i]["grade"] == p.index(max(p)) and abs(got[i]["p_toxic"] - (1 - p[0])) < 1e-6


def test_chat_digest_of_repeated_long_and_odd_rows(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    long = "</s> word [INST] " * 20_000
    rows = [(1, 1, "user", "hi", "k"), (1, 1, "user", "hi", "k"), (1, 2, "assistant", long, None), (2, 1, "assistant", "[/INST]", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    got = {r["conv_id"]: r for r in chat.digest(chat.read_turns(chat.format_turns(df, path, P.PATTERN), path, P.PATTERN)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\nhi\nuser\nhi\nassistant\n{long}\n".encode()).hexdigest() and got[2]["loss_chars"] == 7


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    clash = ["_id", "_sha", "_text", "_cut", "_null", "_key", "_gone", "_score", "_lang_pred", "_contaminated", "_hits", "_items", "id", "v", "n", "comp", "__id", "digest"]
    wide = odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])
    for docs in (odd, empty, wide):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns and got.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    assert decontaminate.scan(wide, spark.read.parquet(f"{SF}/benchmark.parquet"), block=50).count() == odd.count()


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The kept ids and texts of all stages against plain code, on planted copies, passages and benchmark items."""
    from tokenizers import Tokenizer

    rng = random.Random(11)
    pool = {"en": [f"the{i}ing" for i in range(60)], "de": [f"und{i}ung" for i in range(60)]}
    words = lambda x, n: " ".join(rng.choice(pool[x]) for _ in range(n))
    items = [(1, words("en", 14)), (2, words("de", 12)), (3, "short item")]
    shared = {x: words(x, 30) for x in pool}
    rows = []
    for i in range(60):
        x = "en" if i % 2 else "de"
        t = words(x, 50)
        if i % 6 == 0:
            t = f"{t} {shared[x]} {words(x, 10)}"
        if i % 10 == 7 and i > 7:
            t = rows[i - 10][1] + " " + words(x, 3)
        if i % 15 == 4:
            t = f"{t} {items[i % 2][1]} {words(x, 4)}"
        rows.append((i, t, x, "s", len(t)))
    rows += [(60, rows[3][1], "en", "s", 1), (61, "?! 12", "en", "s", 5), (62, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    left = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, split(t)) for i, t in left.items())}
    comp = {i: i for i in left}
    for _ in range(8):
        for a in left:
            for b in left:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    left = {i: t for i, t in left.items() if comp[i] == i}
    first: dict = {}
    for i, t in sorted(left.items()):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    cut = {}
    for i, t in left.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        cut[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    assert any(cut[i] != left[i] for i in left)
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9]+", t.lower())) + " "
    windows = [" " + " ".join(w[k : k + 10]) + " " for _, t in items for w in [plain(t).split()] for k in range(max(1, len(w) - 9))]
    want = {i: t for i, t in cut.items() if not any(w in plain(t) for w in windows)}
    assert len(want) < len(cut) < len(rows)
    tok = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids for i, t in want.items()}
