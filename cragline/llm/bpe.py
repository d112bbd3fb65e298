"""BPE encoding and decoding in batched numpy merge rounds.

Texts are cut at ASCII white space; the distinct chunks of a piece are normalised and split into words, and the
symbols of all words not seen before lie in one flat array. Each round looks all neighbouring pairs up by binary
search in the sorted pair keys and merges, in every word at once, the pairs of its lowest rank.

Defined results: a null or empty text has no ids and decodes to an empty text; reserved strings in a text become
their ids, as in the public library's default; the word cache is bounded and only saves work.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import flat, pieces, ragged

CACHE = 600_000


def byte_chars() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder for one vocabulary file (JSON text of a byte-level BPE with a word-end suffix)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.suffix = suffix = model.get("end_of_word_suffix") or ""
        kinds = [x["type"] for x in (j.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or not suffix:
            raise ValueError(f"not a vocabulary of lower-case words with end marks: {kinds}")
        self.words = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        chars = byte_chars()
        self.plain = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        out = np.array([vocab[a + b] for a, b in pairs], np.int64)
        assert len(np.unique(out)) == len(out), "each token must come from one merge"  # else equal ranks could interleave
        o = np.argsort(key)
        self.keys, self.ranks, self.outs = key[o], o.astype(np.int64), out[o]
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        self.store = ChunkStore(self.chunks)

    def split(self, chunk: str) -> list[str | int]:
        """Words of a chunk; reserved ids as ints."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
        out: list[str | int] = []
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                s = unicodedata.normalize("NFC", part)
                s = s.lower() if s.isascii() else "".join([x.lower() for x in s])  # by character: no final-sigma rule
                out += self.words.findall(s)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all (non-empty) words in their order, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.plain[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        none = np.iinfo(np.int64).max
        while len(sym):
            inside = word[:-1] == word[1:]
            key = np.where(inside, (sym[:-1] << 20) | sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.r_[True, ~inside])
            low = np.minimum.reduceat(rank, first)
            over = low == none
            width = np.diff(np.r_[first, len(sym)])
            if over.any():  # finished words leave the array
                gone = np.repeat(over, width)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                keep = ~gone
                sym, word, rank, at = sym[keep], word[keep], rank[keep], np.append(at, 0)[keep]
                if not len(sym):
                    break
                low, width = low[~over], width[~over]
            hit = np.flatnonzero((rank == np.repeat(low, width)) & (rank != none))
            # of a run of overlapping pairs, every second one from the left
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            sym[hit] = self.outs[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.uint32), size
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of chunks (no white space inside), and how many each has."""
        parts = [self.split(c) for c in chunks]
        words = [w for p in parts for w in p]
        special = {k: w for k, w in enumerate(words) if isinstance(w, int)} if self.cut else {}
        for k in special:
            words[k] = "!"  # keeps the place of a reserved id: one byte, one symbol
        ids, n = self.merge([w.encode() for w in words])
        ends = np.cumsum(n)
        for k, w in special.items():
            ids[ends[k] - 1] = w
        ends = np.r_[0, ends][np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)]
        return ids, np.diff(ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and offsets."""
        return self.store.encode(texts)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        """Token strings of each text joined by blanks: what decode() gives for a file without a decoder."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), self.names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


class ChunkStore:
    """Encodes texts by their distinct white-space chunks; the ids of the first `CACHE` chunks stay in one flat array."""

    def __init__(self, encode_new):
        self.encode_new = encode_new  # list of chunks -> (flat ids, how many each has)
        self.known: dict[str, int] = {"": 0}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(2, np.int64)

    def lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id store, start, length) of each chunk."""
        get = self.known.get
        at = np.array([get(c, -1) for c in chunks], np.int64)
        ids, ends = self.ids, self.ends
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [chunks[k] for k in new.tolist()]
            got, n = self.encode_new(fresh)
            at[new] = len(ends) - 1 + np.arange(len(new))
            used = int(ends[-1])
            if used + len(got) > len(ids):
                ids = np.concatenate([ids[:used], np.zeros(used + len(got), np.uint32)])
            ids[used : used + len(got)] = got
            ends = np.concatenate([ends, used + np.cumsum(n)])
            if len(self.known) < CACHE and len(got) < 4 * CACHE:
                self.known.update(zip(fresh, at[new].tolist(), strict=True))
                self.ids, self.ends = ids, ends
        return ids, ends[at], ends[at + 1] - ends[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and offsets."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        enc = lists.flatten().dictionary_encode()
        ids, start, per = self.lookup(enc.dictionary.to_pylist())
        at = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        width = per[at]
        out = ids[ragged(start[at], width)]
        ends = np.r_[0, np.cumsum(width)]
        o = lists.offsets.to_numpy().astype(np.int64)
        return out, ends[o - o[0]]


_stores: dict = {}


def worker_store(key, make) -> ChunkStore:
    """One store for each vocabulary in a Python worker, over all its tasks."""
    if key not in _stores:
        _stores.clear()
        _stores[key] = make()
    return _stores[key]


def load_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids) of every text; path: vocabulary file on the driver."""
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        bpe = None
        for b in pieces(batches, "text"):
            bpe = bpe or worker_store(("bpe", path), lambda: Bpe(spec.value))
            ids, offs = bpe.encode(b.column("text"))
            text = bpe.decode(ids, offs)
            raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            chars, to = flat(text)
            data = memoryview(np.ascontiguousarray(chars)).cast("B")
            cols = {
                "doc_id": b.column("doc_id"),
                "n_tokens": pa.array(np.diff(offs), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(offs[:-1], offs[1:], strict=True)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(to[:-1], to[1:], strict=True)], pa.string()),
            }
            if with_ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(cols)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
