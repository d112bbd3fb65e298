"""Conversation repair, lexical search and Order MinHash against plain versions."""

import functools
import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from cragline.llm import lexical, ordermin, queries, repair

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, n string, fault long, part int"
DOCS = "doc_id long, text string, lang string, n long, t string, `next` int"


def same_as_sql(spark, name, tables):
    """The query on given rows equals its SQL."""
    got = queries.QUERIES[name](spark, tables["dir"])
    con = duckdb.connect()
    for t in tables["names"]:
        con.sql(f"create view {t} as select * from '{tables['dir']}/{t}.parquet{tables.get('files', '/*.parquet')}'")
    order = ", ".join(sorted(got.columns))
    want = con.sql(f"select {order} from ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*sorted(got.columns)).collect())


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_lexical_search"])
def test_given_tables_against_sql(spark, name):
    same_as_sql(spark, name, {"dir": SF, "names": ["conversations", "documents", "benchmark"], "files": ""})


# conversation repair


def plain_repair(rows):
    """The report of one conversation's damaged (turn, role, text) rows by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))

    @functools.cache
    def best(i, out):
        """Least (cost, edits, turns) from row i on; out is what came before, as start, s, u or a."""
        return min([bare(i, out), *inserted(i, out)])

    @functools.cache
    def bare(i, out):
        """As best, without an insert first."""
        need = "assistant" if out == "u" else "user"
        ways = [(0, "", ())] if i == len(rows) and out in ("", "a") else []
        if i < len(rows):
            c, e, t = best(i + 1, out)
            ways.append((c + 2, "D" + e, t))
            if faults[i] in ("", "t"):
                for role, price, name in ((rows[i][1], 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if role[:1] == need[0] or (role[:1] == "s" and out == "" and name == "K"):
                        c, e, t = best(i + 1, role[:1])
                        ways.append((c + price + 5 * (faults[i] == "t"), name + e, ((role, rows[i][2]), *t)))
        return min(ways) if ways else (10**9, "", ())

    def inserted(i, out):
        """Up to three inserts, then something else."""
        found, turns, state = [], (), out
        for k in range(1, 4):
            need = "assistant" if state == "u" else "user"
            turns, state = (*turns, (need, "")), need[0]
            c, e, t = bare(i, state)
            found.append((c + 5 * k, "I" * k + e, (*turns, *t)))
        return found

    cost, audit, out = best(0, "")
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), out


def talks(seed, count):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "user2"])
            text = rng.choice(["Ja.", "Nein!", "weiter", " \t", "", "Gut? ", "Oh.\n"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    return rows


def test_repair_small_against_all_edits(spark):
    rows = talks(1, 300)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TALK).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(df).collect()}
    turns = {}
    for r in repair.repaired(df).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv in {r[0] for r in rows}:
        *want, out = plain_repair([r[1:] for r in rows if r[0] == conv])
        assert got[conv] == tuple(want), conv
        assert turns.get(conv, []) == list(out)


def test_repair_by_chunks(spark, monkeypatch):
    """Long conversations give the same in chunks of few rows as at once."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Ja.", "weiter", ""]) + ("" if rng.random() < 0.2 else f" Satz {t}.")) for c in (1, 2) for t in range(700)]
    rows += [(2, 900, "user", "Hallo.")] * 40 + [(3, None, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(df).collect()}
    for conv in (1, 2, 3):
        own = sorted([r[1:] for r in rows if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes = set(), []
        for _, role, text in own:
            fault = "b" if not text.strip() else "d" if (role, text) in seen else "t" if text.strip()[-1] not in ".!?" else ""
            seen.add((role, text))
            codes.append((role[0], fault, 1))
        table = repair.to_go(codes, repair.TAIL)
        edits, _, state = repair.walk(codes, table, 0)
        assert got[conv][5:7] == (table[0][0], edits + {0: "", 1: "II", 2: "I", 3: ""}[state])


def test_repair_odd_rows_and_sql(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "Ja."), (7, None, "user", "x"), (7, 3, None, "Ja."), (7, 3, None, "Ja."), (8, 1, "system", "Los."), (8, 9, "user", "Ende")]
    rows += [(10 + k, t, "user" if t % 2 == 0 else "assistant", f"Text {t}. Noch!") for k in range(60) for t in range(6)] + [(200, t, "user", "langer Text " * 50_000) for t in range(2)]
    folder = str(tmp_path)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TALK)
    df.write.parquet(f"{folder}/conversations.parquet")
    same_as_sql(spark, "op11_conversation_repair", {"dir": folder, "names": ["conversations"]})
    kinds = Counter()
    for conv, turn, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kinds[zlib.crc32(key.encode()) % 20 if zlib.crc32(key.encode()) % 20 < 5 else 5] += 1
    assert len(kinds) == 6
    assert repair.report(df.limit(0)).count() == 0 and repair.repaired(df.limit(0)).count() == 0
    assert dict(repair.damage(df).groupBy("n").count().collect()) == {0: kinds[0], 2: kinds[3], 1: len(rows) - kinds[0] - kinds[3]}


# lexical search


def plain_search(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(s for *_, s in held)
    df = Counter(w for _, c, _ in held for w in c)
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, []).extend(words(text))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, s in held:
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * (25 + (75 * s * n) // total))) for w in terms if c[w])
            if score > 0:
                found.append((score, i))
        best = heapq.nsmallest(k, found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, i, score) for r, (score, i) in enumerate(best)]
    return out


def corpus(seed, count):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}é{i % 3}" for i in range(900)]
    docs = [(i * 3 % 1009, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(count)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(25)]
    return docs + docs[:20], items


@pytest.mark.parametrize("size", [400, 8 << 20])
def test_search_against_plain(spark, monkeypatch, size):
    """Many small shards in one task and a single one; ties of copies; blocks of items."""
    docs, items = corpus(5, 600)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    run = lexical.index
    if size < 1000:
        monkeypatch.setattr(lexical, "index", lambda x: run(x.repartition(40)))
    for block in (100_000, 30):
        got = sorted(tuple(r) for r in lexical.search(d, q, 7, block).select("item_id", "rank", "doc_id", "score").collect())
        assert got == sorted(plain_search(docs, items, 7))


def test_search_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "Haus Boot"), (4, "haus BOOT"), (4, "haus BOOT"), (5, "?! --"), (6, "Straße é 12 " * 60_000), (7, "ÀB àb"), (8, "x" * 300_000)]
    items = [(1, "Haus"), (1, "Haus"), (None, "boot boot"), (3, None), (4, "..."), (5, "é 12"), (6, "ÀB"), (7, "nirgends")]
    d = spark.createDataFrame([(*r, "de", 1, "x", 2) for r in docs], DOCS)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = sorted((tuple(r) for r in lexical.search(d, q).collect()), key=key)
    assert got == sorted(plain_search(docs, items, 10), key=key)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0
    names = spark.createDataFrame([("a", "haus"), ("b", "boot")], "item_id string, text string")
    assert lexical.search(d, names, 1).select("item_id").distinct().count() == 2


# Order MinHash


def h(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v if isinstance(v, bytes) else v[0].to_bytes(v[1], "little", signed=True), seed=seed).intdigest()
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_signature(text):
    n = len(text)
    if not n:
        return [None] * ordermin.SLOTS
    x = [h(text[i : i + ordermin.K].encode("utf-32-be")) >> 1 for i in range(max(n - ordermin.K, 0) + 1)]
    low = set(sorted(set(x))[: ordermin.KEPT])
    seen, slots = Counter(), {}
    for at, v in enumerate(x):
        if v in low:
            code = h((v, 8), (seen[v], 4)) >> 1
            seen[v] += 1
            slots.setdefault(code >> 58, []).append((code, at))
    out = []
    for s in range(ordermin.SLOTS):
        pick = sorted(sorted(slots.get(s, []))[:2], key=lambda p: p[1])
        out.append(signed(h(*[(c, 8) for c, _ in pick])) if pick else None)
    return out


def plain_likeness(a, b):
    filled = sum(x is not None or y is not None for x, y in zip(a, b, strict=True))
    return 1.0 if not filled else sum(x == y and x is not None for x, y in zip(a, b, strict=True)) / filled


def test_signature_against_plain(spark):
    rng = random.Random(2)
    texts = ["", "a", "kurz é", "x" * 20_000, "abc" * 3_000, "Zeile eins.\n" * 900, "😀" * 40, "".join(rng.choices("abcdé😀 ", k=500)), "".join(rng.choices("abcdefgh ", k=40_000)), ("".join(rng.choices("abcdefgh ", k=300))) * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["s"] for r in df.select("i", ordermin.signature(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [plain_signature(t) for t in texts]


def test_edited_against_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_order_minhash(spark, SF).collect()}
    assert len(got) == len(docs)
    order = sorted(docs, key=lambda d: -d[0])
    signs = [plain_signature(t or "") for _, t in order]
    say = lambda s: "".join("." * 8 if x is None else f"{x & 0xFFFFFFFF:08x}" for x in s) if any(x is not None for x in s) else ""
    for k, (doc_id, text) in enumerate(order):
        j = (k + 1) % len(order)
        text, after = text or "", order[j][1] or ""
        cut = len(text) // 2
        new = text[: len(text) - cut] + after[:cut]
        sign = plain_signature(new)
        assert got[doc_id] == (len(text), hashlib.sha256(new.encode()).hexdigest(), say(signs[k]), say(sign), plain_likeness(signs[k], sign), plain_likeness(signs[k], signs[j]))


def test_edited_odd_rows(spark):
    rows = [(3, "c" * 40, "de", 1, "x", 2), (3, "c" * 40, "de", 1, "x", 2), (3, "anderer Text", None, None, None, None), (None, "ohne Nummer", "de", 1, "x", 2), (1, None, "de", 1, "x", 2), (2, "", "de", 1, "x", 2)]
    got = ordermin.edited(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows) and len({tuple(r) for r in got}) == 5
    alone = ordermin.edited(spark.createDataFrame(rows[:1], DOCS)).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"c" * 40).hexdigest()
    void = ordermin.edited(spark.createDataFrame([(1, None, "", 1, "", 1), (2, "", "", 1, "", 1)], DOCS)).collect()
    assert [r["near_next"] for r in void] == [1.0, 1.0] and {r["fingerprint"] for r in void} == {""}
    assert ordermin.edited(spark.createDataFrame([], DOCS)).count() == 0


def test_order_matters(spark):
    """Moving a half costs more than leaving it; small edits cost little."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 9))) for _ in range(600)]
    text = " ".join(words)
    swapped = " ".join(words[300:] + words[:300])
    little = " ".join(words[:200] + ["neu"] + words[200:])
    df = spark.createDataFrame([(text, swapped, little)], "t string, s string, l string")
    sign = lambda c: ordermin.signature(F.col(c))
    r = df.select(ordermin.likeness(sign("t"), sign("t")).alias("own"), ordermin.likeness(sign("t"), sign("s")).alias("swapped"), ordermin.likeness(sign("t"), sign("l")).alias("little")).first()
    assert r["own"] == 1.0 and r["little"] > 0.75 and r["swapped"] < 0.8 < r["little"] + 0.05
