"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds the longest token at every place of a word. Tokens are
then laid from left to right; a token may follow another only if byte-pair merging would leave the two side
by side, which a table of token pairs (filled as pairs are met) answers; otherwise the next shorter prefix
token is tried, and where none fits the last token is taken back and its place marked as dead, so each
place is tried once. The result is exactly that of merging by rank.

Splitting into words, and the assembly of ids, run in numpy over chunks of texts; a word is encoded once
for each worker that meets it (the memo of words is bounded; it affects only speed).

The vocabulary (a tokenizers file of a BPE model with a word-end suffix) is read on the driver and broadcast:
its size is fixed.

Defined cases: a null or empty text has no ids and decodes to the empty text; the strings of special
tokens in a text become those tokens; repeated rows are encoded each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textbuf import Prefix, chunks, mix

_END = "</w>"
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Upper-case letters that came with Unicode 16 and 17, whose lower case this Python may lack
_LATE_CASE = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LATE_CASE |= {k: k + 0x20 for k in range(0x10D50, 0x10D66)} | {k: k + 0x1B for k in range(0x16EA0, 0x16EB9)}
# First and last of the letters and numbers that came with Unicode 16
_LATE_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
_LATE_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_MEMO = 1_500_000
_PAIRS = 1_000_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabularies at byte level."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


def default_vocabulary() -> str:
    """Place of the public vocabulary word_bpe_49k."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_vocabulary(path: str) -> dict:
    """What workers need of a tokenizers file: token strings by id, merges as id triples, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab = model["vocab"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END:
        raise ValueError("a BPE model with the word end </w> is needed")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    names = [""] * size
    for t, k in [*vocab.items(), *special.items()]:
        names[k] = t
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    return {"names": names, "merges": merges, "special": special, "plain": len(vocab)}


class Encoder:
    """Exact BPE of single words, given as strings of symbols (a byte, plus 256 for the last one)."""

    def __init__(self, vocabulary: dict):
        import ahocorasick

        byte_of = {c: b for b, c in enumerate(byte_chars())}
        names, special = vocabulary["names"], set(vocabulary["special"].values())
        self.symbols: list[str] = []
        for k, t in enumerate(names):
            last = t.endswith(_END) and len(t) > len(_END)
            body = t[: -len(_END)] if last else t
            if k in special or not body or any(c not in byte_of for c in body):
                self.symbols.append("")
                continue
            s = "".join(chr(byte_of[c]) for c in body)
            self.symbols.append(s[:-1] + chr(ord(s[-1]) + 256) if last else s)
        n = len(names)
        self.length = [len(s) for s in self.symbols]
        self.rank: dict[tuple[int, int], int] = {}
        self.born = [-1] * n  # rank of the merge that makes a token
        self.parts: list[tuple[int, int] | None] = [None] * n
        for r, (a, b, c) in enumerate(vocabulary["merges"]):
            self.rank.setdefault((a, b), r)
            if self.parts[c] is None:
                self.parts[c], self.born[c] = (a, b), r
        valid = [length == 1 for length in self.length]
        for a, b, c in vocabulary["merges"]:
            valid[c] = valid[a] and valid[b] and self.parts[c] == (a, b) and self._apart(a, b, self.born[c])
        self.automaton = ahocorasick.Automaton()
        by_symbols = {}
        for k, s in enumerate(self.symbols):
            if s and valid[k]:
                by_symbols[s] = k
                self.automaton.add_word(s, (len(s), k))
        self.automaton.make_automaton()
        self.shorter = [-1] * n  # the longest token that is a proper prefix
        for s, k in by_symbols.items():
            for m in range(len(s) - 1, 0, -1):
                if (p := by_symbols.get(s[:m])) is not None:
                    self.shorter[k] = p
                    break
        self.pairs: dict[int, bool] = {}

    def _apart(self, left: int, right: int, until: int = 1 << 40) -> bool:
        """Whether merges of a rank below until leave left and right side by side.

        The symbols that touch at the border grow along the right edge of left and the left edge of right.
        A merge across the border wins if it ranks below both merges that would grow either symbol; of equal
        ranks the one further left goes first.
        """
        a, b = [left], [right]
        while self.parts[a[-1]]:
            a.append(self.parts[a[-1]][1])
        while self.parts[b[-1]]:
            b.append(self.parts[b[-1]][0])
        i, j = len(a) - 1, len(b) - 1
        while True:
            grow_a = self.born[a[i - 1]] if i else until
            grow_b = self.born[b[j - 1]] if j else until
            across = self.rank.get((a[i], b[j]))
            if across is not None and across < grow_a and across <= grow_b and across < until:
                return False
            if not i and not j:
                return True
            if i and grow_a <= grow_b or not j:
                i -= 1
            else:
                j -= 1

    def word(self, s: str) -> list[int]:
        n = len(s)
        longest = [-1] * n
        for end, (size, k) in self.automaton.iter(s):
            longest[end - size + 1] = k  # later ends are longer
        out: list[int] = []
        dead = bytearray(n + 1)
        length, pairs, shorter = self.length, self.pairs, self.shorter
        at, k = 0, longest[0]
        while at < n:
            while k >= 0:
                to = at + length[k]
                if not dead[to]:
                    if not out:
                        break
                    key = out[-1] << 20 | k
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= _PAIRS:
                            pairs.clear()
                        ok = pairs[key] = self._apart(out[-1], k)
                    if ok:
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at = to
                if at < n:
                    k = longest[at]
            else:
                if not out:
                    raise ValueError("the vocabulary has no token for a byte")
                dead[at] = 1
                k = out.pop()
                at -= length[k]
                k = shorter[k]
        return out


class Tokenizer:
    """Encodes and decodes lists of texts."""

    def __init__(self, vocabulary: dict):
        self.encoder = Encoder(vocabulary)
        self.special = vocabulary["special"]
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        kind = np.full(0x110000, 3, np.uint8)
        for k in range(0x110000):
            c = unicodedata.category(chr(k))[0]
            if c in "LN":
                kind[k] = 1 if c == "L" else 2
        for value, ranges in ((1, _LATE_LETTERS), (2, _LATE_NUMBERS)):
            for a, b in ranges:
                kind[a : b + 1] = value
        kind[_SPACES] = 0
        self.kind = kind
        # decoding: all token strings in one row of bytes, each followed by the space that joins tokens
        raw = [t.encode("utf-8") + b" " for t in vocabulary["names"]]
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self._reset()

    def _reset(self) -> None:
        self.main = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.ids = np.zeros(0, np.uint16 if len(self.token_off) <= 1 << 16 else np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        odd = {k for k, t in enumerate(texts) if self.split and self.split.search(t)}
        if odd:
            cut, of = [], []
            for k, t in enumerate(texts):
                parts = self.split.split(t) if k in odd else [t]
                cut += parts
                of += [k] * len(parts)
            given = [self.special[p] if p in self.special else None for p in cut]
            ids, n = self._plain(["" if g is not None else p for g, p in zip(given, cut, strict=True)])
            pieces = np.split(ids, np.cumsum(n)[:-1])
            pieces = [np.array([g], np.int32) if g is not None else x for g, x in zip(given, pieces, strict=True)]
            n = np.bincount(of, weights=[len(x) for x in pieces], minlength=len(texts)).astype(np.int64)
            return np.concatenate(pieces).astype(np.int32), n
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        clean = []
        for t in texts:
            if not t.isascii():
                if not unicodedata.is_normalized("NFC", t):
                    t = unicodedata.normalize("NFC", t)
                if "Σ" in t:
                    t = t.replace("Σ", "σ")  # one by one, so without a special final form
            clean.append(t.lower())
        joined = "\n".join(clean)
        off = np.cumsum([0, *(len(t) + 1 for t in clean)])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if len(cp) and cp.max() >= min(_LATE_CASE) and np.isin(cp, list(_LATE_CASE)).any():
            joined = joined.translate(_LATE_CASE)
            cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(cp)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        kind = self.kind[cp]
        start = kind != 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # 's 't 'm 'd 're 've 'll where a run of other characters is a single apostrophe
        q = np.flatnonzero((cp == 39) & start)
        q = q[q + 1 < n]
        q = q[kind[q + 1] == 1]
        if len(q):
            a = cp[q + 1]
            b = np.append(cp, 0)[q + 2]
            one = np.isin(a, [115, 116, 109, 100])
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            for p, m in ((q[one], 2), (q[two & ~one], 3)):
                start[p + 1] = False
                after = p + m
                after = after[after < n]
                start[after[kind[after] == 1]] = True
        cut = np.flatnonzero(start | (kind == 0))
        is_start = start[cut]
        s = cut[is_start]
        e = np.append(cut[1:], n)[is_start]
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # first byte of a code point
        h = mix(Prefix(raw.astype(np.uint64) + np.uint64(1)).raw(byte[s], byte[e]))
        del raw, byte
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        at, size = self._known(u, [joined, s[first], e[first]])
        at, size = at[back], size[back]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])].astype(np.int32)
        doc = np.searchsorted(off[1:], s, side="right")
        return ids, np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)

    def _known(self, u: np.ndarray, where: list) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each word hash in self.ids; words met for the first time are encoded."""
        if len(self.main[0]) > _MEMO:
            self._reset()
        keys, at, size = self.main
        k = np.searchsorted(keys, u)
        found = k < len(keys)
        found[found] = keys[k[found]] == u[found]
        out_at, out_size = np.zeros(len(u), np.int64), np.zeros(len(u), np.int32)
        out_at[found], out_size[found] = at[k[found]], size[k[found]]
        new = np.flatnonzero(~found)
        if len(new):
            joined, s, e = where
            word, fresh, count = self.encoder.word, [], []
            for a, b in zip(s[new].tolist(), e[new].tolist(), strict=True):
                w = joined[a:b].encode("utf-8").decode("latin-1")
                got = word(w[:-1] + chr(ord(w[-1]) + 256))
                fresh += got
                count.append(len(got))
            n = np.array(count, np.int32)
            places = len(self.ids) + np.concatenate([[0], np.cumsum(n)[:-1]])
            self.ids = np.concatenate([self.ids, np.array(fresh, self.ids.dtype)])
            out_at[new], out_size[new] = places, n
            spot = np.searchsorted(keys, u[new])
            self.main = np.insert(keys, spot, u[new]), np.insert(at, spot, places), np.insert(size, spot, n)
        return out_at, out_size

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the token strings joined by spaces."""
        if not len(ids):
            return b""
        out, step = [], 1 << 18
        for lo in range(0, len(ids), step):
            part = ids[lo : lo + step]
            a = self.token_off[part]
            n = self.token_off[part + 1] - a
            end = np.cumsum(n)
            out.append(self.token_bytes[np.repeat(a - end + n, n) + np.arange(end[-1])].tobytes())
        return b"".join(out)[:-1]


_made: dict[str, Tokenizer] = {}  # one for each worker


def bpe_rows(docs: DataFrame, path: str, emit: Callable, schema: str, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: key, the columns in keep, and what emit(tokenizer, ids, counts) makes, a list of Arrow arrays for the columns of schema.

    ids holds the ids of some texts in a row, counts how many each text has.
    """
    spark: SparkSession = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(path))  # a file of a fixed size
    kinds = dict(docs.select(key, *keep).dtypes)
    names = [key, *keep, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        for batch in batches:
            if tok is None:
                if path not in _made:
                    _made.clear()
                    _made[path] = Tokenizer(vocabulary.value)
                tok = _made[path]
            texts = batch.column(1).fill_null("")
            for lo, hi, _ in chunks(texts):
                ids, n = tok.encode(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(lo, hi - lo) for j in (0, *range(2, len(keep) + 2))), *emit(tok, ids, n)], names=names)

    return docs.select(key, text, *keep).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + f", {schema}")


def _arrays(tok: Tokenizer, ids: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    off = np.concatenate([[0], np.cumsum(n)])
    texts = [tok.decode(ids[a:b]).decode("utf-8") for a, b in zip(off[:-1], off[1:], strict=True)]
    return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())]


def _digests(tok: Tokenizer, ids: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    off = np.concatenate([[0], np.cumsum(n)])
    raw = ids.astype("<u4")
    # of what is encoded and decoded, so texts and ids need not leave the worker
    parts = [(hashlib.sha256(raw[a:b]).hexdigest(), hashlib.sha256(tok.decode(ids[a:b])).hexdigest()) for a, b in zip(off[:-1], off[1:], strict=True)]
    return [pa.array(n, pa.int64()), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string())]


def _both(tok: Tokenizer, ids: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    off = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return [*_digests(tok, ids, n), pa.ListArray.from_arrays(off, pa.array(ids, pa.int32()))]


def bpe_corpus(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """As bpe_digests, with the columns in keep and the ids themselves."""
    return bpe_rows(docs, path, _both, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>", text, key, keep)


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (array of int) and decoded (text) of every row of docs."""
    return bpe_rows(docs, path, _arrays, "ids array<int>, decoded string", text, key)


def bpe_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As bpe_round_trip, with the number of ids and SHA-256 of ids (little-endian, 32 bits) and decoded text instead."""
    return bpe_rows(docs, path, _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", text, key)
