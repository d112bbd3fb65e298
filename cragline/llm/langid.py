"""Language identification by multilingual mixture inference.

Per-language letter-trigram likelihoods, of any script's letters, are counted from labelled documents. For each document, expectation-
maximisation over its words estimates the share of every language; nested language sets, in order of share, are
then compared by penalised likelihood and the largest share within the best set names the language.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled training row
every text is `und`; a null doc_id stays null and is a training row. Repeated rows are scored each on its own, and a
text's result is the same beside any others. Bytes that are no UTF-8 are no letters; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, held, mix, pieces, ragged, spans

#: Slots of trigrams of a-z, one each, and of those with other letters, by a hash of their code points.
PLAIN, HASHED = 1 << 15, 1 << 16
SLOTS = PLAIN + HASHED
#: Letters times languages, or slots times languages, that a worker holds at once; further texts wait, longer texts go in parts.
ENTRIES = 1 << 23
#: More values than that are no languages (ISO 639-3 knows about 8,000); fit() refuses them.
MAX_LANGUAGES = 1 << 14
PIECE_BYTES = 2 << 20


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 no letter, 1 a mark within words, 2 a letter; and the symbol of a letter: 1-26 for a-z of either
    case, else its lower-case code point."""
    kind, symbol = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.int32)
    for k in range(0x110000):
        c = unicodedata.category(chr(k))[0]
        if c in "LM":
            kind[k] = 2 if c == "L" else 1
            low = chr(k).lower()
            symbol[k] = ord(low) if len(low) == 1 else k
    symbol[97:123] = symbol[65:91] = np.arange(1, 27)
    return kind, symbol


def code_points(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts given as bytes, and offsets."""
    try:
        text = raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:  # bytes that are no UTF-8 count as unknown characters
        parts = [raw[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(offs[:-1], offs[1:], strict=True)]
        return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offs]


def _grams(raw: np.ndarray, offs: np.ndarray):
    """Trigram slot of each letter (centre position), start, end and text of each word, and whether a text has a letter."""
    kind, symbol = _letters()
    cp, offs = code_points(raw, offs)
    k = kind[cp]
    s, e, d = spans(k, offs, np.array([False, True, True]))
    c = np.zeros(len(cp) + 2, np.int32)
    c[1:-1] = symbol[cp]
    inner = offs[(offs > 0) & (offs < len(cp))]
    left, right = c[:-2].copy(), c[2:].copy()
    left[inner], right[inner - 1] = 0, 0  # a neighbour in another text is no context
    at = ragged(s, e - s)
    left, mid, right = left[at], c[1:-1][at], right[at]
    code = (left << 10) | (mid << 5) | right
    other = np.flatnonzero((left | mid | right) >= 32)
    h = left[other].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mid[other].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + right[other].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    code[other] = PLAIN + (mix(h) % np.uint64(HASHED)).astype(np.int32)
    has = np.zeros(len(offs) - 1, bool)
    has[np.searchsorted(offs, np.flatnonzero(k == 2), "right") - 1] = True
    return code, s, e, d, has


@dataclass
class Model:
    """Log-likelihoods of trigram slots by language; only slots that a language's texts hold are stored.

    It is at most SLOTS entries a language, 6 bytes each, however many rows there are.
    """

    names: list[str]
    start: np.ndarray  # where each slot's entries begin, and the end
    lang: np.ndarray
    value: np.ndarray
    none: np.ndarray  # by language: the value of a slot without an entry

    def rows(self, slots: np.ndarray) -> np.ndarray:
        """The slots' values, slots x languages."""
        out = np.repeat(self.none[None], len(slots), axis=0)
        n = self.start[slots + 1] - self.start[slots]
        at = ragged(self.start[slots], n)
        out[np.repeat(np.arange(len(slots)), n), self.lang[at]] = self.value[at]
        return out


def fit(docs: DataFrame) -> Model:
    """The model of rows with text and lang; every language has the same slots, however many there are."""
    rows = docs.filter("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).toArrow()["lang"].to_pylist()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")

    def count(batches):
        seen: dict[str, int] = {}
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            lang = pa.array(list(seen), pa.string()).take(pa.array(keys // SLOTS))
            return pa.RecordBatch.from_arrays([lang, pa.array(keys % SLOTS, pa.int32()), pa.array(counts)], names=["lang", "gram", "n"])

        for b in pieces(batches, "text", PIECE_BYTES):
            lang = b.column("lang").dictionary_encode()
            own = np.array([seen.setdefault(x, len(seen)) for x in lang.dictionary.to_pylist()], np.int64)
            raw, offs = flat(b.column("text"))
            code, s, e, d, _ = _grams(raw, offs)
            key = own[lang.indices.to_numpy(zero_copy_only=False)][d].repeat(e - s) * SLOTS + code
            if SLOTS * len(seen) <= ENTRIES:
                n = np.bincount(key, minlength=1)
                new = np.flatnonzero(n)
                n = n[new]
            else:
                new, n = np.unique(key, return_counts=True)
            both, at = np.unique(np.r_[keys, new], return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.r_[counts, n])
            keys, counts = both, total
            if len(keys) > ENTRIES // 2:
                yield out()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out()

    t = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(found)
    at = {x: k for k, x in enumerate(names)}
    column = t["lang"].combine_chunks().dictionary_encode()
    lang = np.array([at[x] for x in column.dictionary.to_pylist()], np.int64)[column.indices.to_numpy(zero_copy_only=False)] if len(t) else np.zeros(0, np.int64)
    gram, n = t["gram"].to_numpy(), t["n"].to_numpy()
    total = 0.5 * SLOTS + np.bincount(lang, n, max(1, len(names)))
    o = np.lexsort((lang, gram))
    value = np.log((n[o] + 0.5) / total[lang[o]]).astype(np.float32)
    return Model(names, np.searchsorted(gram[o], np.arange(SLOTS + 1)), lang[o].astype(np.uint16), value, np.log(0.5 / total).astype(np.float32))


def _em(like, top, weight, first, doc, share, total, rounds):
    """EM rounds for the shares (texts x languages) given word likelihoods; returns shares and log-likelihoods."""
    for _ in range(rounds):
        r = like * share[doc]
        r *= (weight / np.maximum(r.sum(1), 1e-30))[:, None]
        share = np.add.reduceat(r, first, axis=0) / total[:, None]
    mass = np.maximum((like * share[doc]).sum(1), 1e-30)
    return share, np.add.reduceat(np.log(mass) + top, first)


def mixture(ll: np.ndarray, words: np.ndarray, letters: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares (texts x languages) within the selected set, and the set's size, for texts that have words.

    ll: words x languages log-likelihoods; words: words per text (all positive); letters: per word. A text's sets grow by
    one language as long as that pays for it; other texts have no part in it.
    """
    n_lang = ll.shape[1]
    top = ll.max(1)
    like = np.exp(ll - top[:, None])
    weight = letters.astype(np.float32)
    first = np.cumsum(words) - words
    doc = np.repeat(np.arange(len(words)), words)
    total = np.add.reduceat(weight, first)
    best, size, bound = np.zeros((len(words), n_lang), np.float32), np.zeros(len(words), np.int32), np.full(len(words), -np.inf)
    share, _ = _em(like, top, weight, first, doc, np.full((len(words), n_lang), 1 / n_lang, np.float32), total, rounds)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    open_ = np.arange(len(words))  # texts whose set still grows
    for k in range(1, n_lang + 1):
        part = np.where(rank < k, np.maximum(share, 1e-6), 0).astype(np.float32)
        part /= part.sum(1, keepdims=True)
        part, value = _em(like, top, weight, first, doc, part, total, 3 if k > 1 else 0)
        value = value - penalty * k * np.log(total + 1)
        better = value > bound[open_]
        now = open_[better]
        best[now], bound[now], size[now] = part[better], value[better], k
        if not better.any():
            break
        if not better.all():
            keep = better[doc]
            open_, words, rank, share, total = now, words[better], rank[better], share[better], total[better]
            like, top, weight = like[keep], top[keep], weight[keep]
            first, doc = np.cumsum(words) - words, np.repeat(np.arange(len(words)), words)
    return best, size


def long_mixture(score, times: np.ndarray, letters: np.ndarray, n_lang: int, rounds: int, penalty: float, step: int) -> tuple[np.ndarray, int]:
    """mixture() of one text whose words x languages are too many to hold.

    score(a, z) gives the log-likelihoods of its different words a to z, `step` at a time; times: how often each occurs.
    """
    weight, total = (letters * times).astype(np.float32), float((letters * times).sum())
    cuts = [(a, min(a + step, len(times))) for a in range(0, len(times), step)]

    def em(share, rounds_):
        for last in [False] * rounds_ + [True]:
            new, value = np.zeros(n_lang), 0.0
            for a, z in cuts:
                ll = score(a, z)
                top = ll.max(1)
                r = np.exp(ll - top[:, None]) * share
                mass = np.maximum(r.sum(1), 1e-30)
                if last:
                    value += float(((np.log(mass) + top) * times[a:z]).sum(dtype=np.float64))
                else:
                    new += (weight[a:z] / mass) @ r
            share = share if last else (new / total).astype(np.float32)
        return share, value

    share, _ = em(np.full(n_lang, 1 / n_lang, np.float32), rounds)
    rank = np.argsort(np.argsort(-share, kind="stable"), kind="stable")
    best, size, bound = share, 0, -np.inf
    for k in range(1, n_lang + 1):
        part = np.where(rank < k, np.maximum(share, 1e-6), 0).astype(np.float32)
        part, value = em(part / part.sum(), 3 if k > 1 else 0)
        value -= penalty * k * np.log(total + 1)
        if value <= bound:
            break
        best, size, bound = part, k, value
    return best, size


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, rounds: int = 8, penalty: float = 2.0, prefix: str = "", entries: int = ENTRIES) -> DataFrame:
    """Adds lang_pred, score and n_langs, with a prefix, to the kept columns of docs (doc_id by default).

    entries: letters times languages that a worker holds at once; results don't depend on it.
    """
    names = model.names
    keep = keep or ["doc_id"]
    ship = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + f", `{prefix}lang_pred` string, `{prefix}score` double, `{prefix}n_langs` int"

    def run(batches):
        m = ship.value
        most = max(1, entries // max(1, len(names)))
        table = m.rows(np.arange(SLOTS)) if SLOTS <= most else None

        def likelihoods(code, seq):
            """Words x languages; each letter lies in three grams, hence the third."""
            if table is not None:
                ll = table[code]
            else:
                slots, at = np.unique(code, return_inverse=True)
                ll = m.rows(slots)[at]
            return np.add.reduceat(ll, np.cumsum(seq) - seq, axis=0) / np.float32(3)

        def long(code, seq):
            first = np.cumsum(seq) - seq
            h = mix(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ragged(np.zeros(len(seq), np.int64), seq).astype(np.uint64))
            _, one, times = np.unique(np.add.reduceat(h, first), return_index=True, return_counts=True)
            first, seq = first[one], seq[one]
            step = max(1, most // int(seq.max()))
            score = lambda a, z: likelihoods(code[ragged(first[a:z], seq[a:z])], seq[a:z])
            return long_mixture(score, times, seq, len(names), rounds, penalty, step)

        for b in pieces(batches, "text", PIECE_BYTES):
            raw, offs = flat(b.column("text"))
            pred, score, size = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            code, s, e, d, has = _grams(raw, offs)
            if len(s) and names:
                seq = e - s
                texts, words = np.unique(d, return_counts=True)
                word, letter = np.r_[0, np.cumsum(words)], np.r_[0, np.cumsum(seq)]
                end = letter[word[1:]]
                k = 0
                while k < len(texts):  # as many texts as fit, at least one
                    z = max(k + 1, int(np.searchsorted(end, letter[word[k]] + most, "right")))
                    c, q = code[letter[word[k]] : end[z - 1]], seq[word[k] : word[z]]
                    if len(c) > most:
                        share, n = (np.array([x]) for x in long(c, q))
                    else:
                        share, n = mixture(likelihoods(c, q), words[k:z], q, rounds, penalty)
                    pred[texts[k:z]], score[texts[k:z]], size[texts[k:z]] = share.argmax(1), share.max(1), n
                    k = z
                pred[~has], score[~has], size[~has] = -1, 0, 0
            label = np.array([*names, "und"], object)[pred]
            out = [b.column(c) for c in keep] + [pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(size)]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *(prefix + x for x in ("lang_pred", "score", "n_langs"))])

    return rows.mapInArrow(run, schema)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held("doc_id", 4, 2))
