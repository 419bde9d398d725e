"""Lexical retrieval packing of documents into training sequences (operator 10).

1. One scan tokenizes every text and writes the ids (two bytes each where the vocabulary allows).
2. Document frequencies of all ids over all documents are summed; their number is the vocabulary's.
3. Documents are put in the order of their KEYS heaviest BM25 terms, of those terms that at least a
   quarter of a shard's number of documents have, so that documents about the same lie together
   whichever files they come from; a term of many documents is split by the next ones. The order's cuts
   into partitions come from the keys of about SAMPLE documents. One shuffle brings the ids there.
4. Every partition is worked off in its order, in shards of at most SHARD_DOCS documents or
   SHARD_TOKENS ids, which are all that a seed sees. A shard holds a BM25 inverted index of its documents, with the corpus's
   frequencies. The first unused document is a seed; its QUERY_TERMS heaviest terms retrieve the unused
   documents that score best, which fill the seed's window one after the other. The last one is cut
   where the window ends, and what is left of it is the next seed.

Every window but a shard's last is exactly full. The last is written as sequences whose lengths are the
powers of two that it adds up to, which need no padding.

The tokenizer splits texts into words at white space and never joins ids across it. Texts of about GROUP
bytes are split together into numbered words, and words of Latin letters into letters and signs, all in
Arrow; each different part is looked up once in a worker's caches of about CACHE entries. Letters that aren't
there go to the tokenizer's model itself, other words to the whole tokenizer; texts with control characters
that only some split at, and those in which an added token's string occurs, go through the library as a whole.

Defined cases: null and empty texts are the end id alone; documents longer than a sequence are cut into
consecutive pieces; rows with equal doc_id are packed each for itself; an empty table gives no pieces.
Reruns agree, over other files with the same rows too.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, batch, map_arrow

LENGTH = 4096
END = 2
SHARD_DOCS = 4096
SHARD_TOKENS = 1 << 24
QUERY_TERMS = 8
KEYS = 3
KEY_BITS = 21
SHARDS = 4
SAMPLE = 65_536
CACHE = 300_000
GROUP = 1 << 21
K1, B = 1.2, 0.75

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Control characters at which str.split() cuts and the tokenizer doesn't.
_ODD = "\x1c\x1d\x1e\x1f"
#: A word of Latin letters and signs after it; in composed form only lower case changes it.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\\w\\s']*)")
#: The same letters, and the signs of ASCII, of which each run is one word to the tokenizer; words of these need no pattern.
_LETTERS = "".join(c for c in map(chr, range(256)) if _PLAIN.fullmatch(c))
_SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "'_")
_workers: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for the bytes of Latin letters' UTF-8 forms."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}
    return {c: "".join(byte[x] for x in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Cache(dict):
    """Asks once for what it doesn't hold."""

    def __init__(self, ask: Callable[[str], bytes]):
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        out = self[word] = self.ask(word)
        return out


class WordIds:
    """The ids of texts for a word-splitting tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.cache = _Cache(self._word)
        self.bases = _Cache(self._base)
        self.signs = _Cache(self._whole)
        # the short cut for plain words is taken only if it gives what the library gives
        self.direct = all(self._base(w) == self._whole(w) for w in ("the", "zyxwvq", "être", "überßen", "ñandúà"))
        self.odd = "|".join([f"[{_ODD}]", *map(re.escape, self.specials)])

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _base(self, letters: str) -> bytes:
        """A run of lower-case letters goes to the model itself."""
        shown = letters if letters.isascii() else letters.translate(self.letters)
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        """A combining mark among the signs may belong to the last letter, so it must not stand in this form."""
        m = _PLAIN.fullmatch(word) if self.direct and unicodedata.is_normalized("NFC", word) else None
        return self.bases[m[1].lower()] + self._whole(m[2]) if m else self._whole(word)

    def _forms(self, words: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The ids of parts of words, and the numbers of each word's first and second part."""
        letters = pc.utf8_rtrim(words, characters=_SIGNS)
        signs = pc.utf8_ltrim(words, characters=_LETTERS)
        # letters and nothing but signs after them, if the two parts make up the word
        plain = pc.and_(pc.equal(pc.add(pc.binary_length(letters), pc.binary_length(signs)), pc.binary_length(words)), pc.greater(pc.binary_length(letters), 0))
        plain = pc.and_(plain, self.direct)
        bases = pc.utf8_lower(letters.filter(plain)).dictionary_encode()
        after = signs.filter(plain).dictionary_encode()
        other = words.filter(pc.invert(plain)).to_pylist()
        for cache in (self.cache, self.bases, self.signs):
            if len(cache) > CACHE:
                cache.clear()
        forms = list(map(self.bases.__getitem__, bases.dictionary.to_pylist()))
        second = len(forms)
        forms += map(self.signs.__getitem__, after.dictionary.to_pylist())
        third = len(forms)
        forms += map(self.cache.__getitem__, other)
        plain = plain.to_numpy(zero_copy_only=False)
        front, back = np.empty(len(plain), np.int64), np.full(len(plain), len(forms))
        front[plain], back[plain] = bases.indices.to_numpy(), second + after.indices.to_numpy()
        front[~plain] = third + np.arange(len(other))
        return [*forms, b""], front, back

    def column(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of all texts as bytes, each followed by the end id if there is one."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.odd)
        whole = [self._whole(t) for t in texts.filter(odd).to_pylist()]
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = words.flatten().dictionary_encode()
        forms, front, back = self._forms(coded.dictionary)
        known, last = len(forms), b"" if end is None else self._bytes([end])
        # a text's words in two parts each, or the whole text as one, and the end
        at = coded.indices.to_numpy()
        parts = np.stack([front[at], back[at]], axis=1).ravel()
        odd = odd.to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], 2 * np.cumsum(pc.list_value_length(words).to_numpy(), dtype=np.int64)])
        extra = np.full((len(odd), 2), known + len(whole), np.int64)
        extra[odd, 0] = known + np.arange(len(whole))
        wanted = np.stack([odd, np.ones(len(odd), bool)], axis=1)
        order = np.insert(parts, np.stack([first[:-1], first[1:]], axis=1)[wanted], extra[wanted])
        ends = first[1:] + np.cumsum(odd) + np.arange(1, len(odd) + 1)
        pieces = pa.array([*forms, *whole, last], pa.large_binary()).take(pa.array(order))
        _, at, data = pieces.buffers()
        bounds = np.frombuffer(at, np.int64)[np.concatenate([[0], ends])]
        return pa.Array.from_buffers(pa.large_binary(), len(odd), [None, pa.py_buffer(bounds), data]).cast(pa.binary())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.column(pa.array(texts, pa.string())).to_pylist() if texts else []


def word_ids(path: str) -> WordIds:
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order with texts of about GROUP bytes together, at least one text each."""
    held, size = [], 0
    for b in batches:
        begin = 0
        for i, n in enumerate(pc.binary_length(b.column(1)).fill_null(0).to_pylist()):
            if size and size + n > GROUP:
                held.append(b.slice(begin, i - begin))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, begin = [], 0, i
            size += n + 1
        held.append(b.slice(begin))
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _forget() -> None:
    """What a worker held for the tokenizer isn't needed by later stages."""
    _workers.clear()
    pa.default_memory_pool().release_unused()


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        for b in _grouped(batches):
            doc_id, text = (c.combine_chunks() for c in b.columns)
            ids = coder.column(text, end)
            ties = [_tie(i, x) for i, x in zip(doc_id.to_pylist(), ids.to_pylist(), strict=True)]
            yield batch(doc_id=doc_id, ids=ids, tie=pa.array(ties, pa.int64()))

    return run


def _frequencies(width: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        total, at, docs, tokens = np.zeros(width, np.int64), np.zeros(width, np.int64), 0, 0
        for b in batches:
            for x in b.column(0).to_pylist():
                ids = np.frombuffer(x, kind)
                order = np.arange(len(ids))
                at[ids] = order
                total[ids[at[ids] == order]] += 1  # each id where it comes last
                docs, tokens = docs + 1, tokens + len(ids)
        if docs:
            met = np.flatnonzero(total)
            yield batch(id=pa.array(np.concatenate([met, [-1, -2]]), pa.int64()), n=pa.array(np.concatenate([total[met], [docs, tokens]]), pa.int64()))

    return run


def _key(d: np.ndarray, idf: np.ndarray, common: np.ndarray, mean: float) -> int:
    """The heaviest common terms of a document, as one number."""
    x = np.sort(d[common[d]])
    if not len(x):
        return 0
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    term, tf = x[first], np.diff(np.append(first, len(x)))
    weight = idf[term] * tf / (tf + K1 * (1 - B + B * len(d) / mean))
    out = 0
    for _ in range(KEYS):
        i = int(weight.argmax())
        out = out << KEY_BITS | (int(term[i]) + 1 if weight[i] > 0 else 0)
        weight[i] = -1
    return out


def _tie(doc_id: int | None, ids: bytes) -> int:
    """Puts documents of the same key in order."""
    return zlib.crc32(b"" if doc_id is None else doc_id.to_bytes(8, "little", signed=True), zlib.crc32(ids))


def _sample(kind: str, idf, common, mean: float):
    def run(b: pa.RecordBatch):
        keys = [_key(np.frombuffer(x, kind), idf.value, common.value, mean) for x in b.column(0).to_pylist()]
        yield batch(key=pa.array(keys, pa.int64()), tie=b.column(1))

    return run


def _place(keys: np.ndarray, ties: np.ndarray, cut_keys: np.ndarray, cut_ties: np.ndarray) -> np.ndarray:
    """The number of cuts (in order of key and tie) that lie at or before each key and tie."""
    lo, hi = np.searchsorted(cut_keys, keys, "left"), np.searchsorted(cut_keys, keys, "right")
    for i in np.flatnonzero(lo < hi):
        lo[i] += np.searchsorted(cut_ties[lo[i] : hi[i]], ties[i], "right")
    return lo


def _route(kind: str, idf, common, mean: float, cuts):
    def run(b: pa.RecordBatch):
        keys = np.array([_key(np.frombuffer(x, kind), idf.value, common.value, mean) for x in b.column(1).to_pylist()], np.int64)
        yield batch(doc_id=b.column(0), ids=b.column(1), place=pa.array(_place(keys, b.column(2).to_numpy(), *cuts.value), pa.int32()), key=pa.array(keys), tie=b.column(2))

    return run


def routed(ids: DataFrame, kind: str, idf, common, mean: float, total: float, parts: int) -> DataFrame:
    """ids (doc_id, ids, tie) in so many partitions, documents with the same heavy terms next to each other."""
    shared = ids.sparkSession.sparkContext.broadcast
    cuts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if parts > 1:
        chosen = ids.where(F.pmod(F.xxhash64("tie"), F.lit(1 << 32)) < int(SAMPLE / total * (1 << 32))).select("ids", "tie")
        found = map_arrow(chosen, _sample(kind, idf, common, mean), "key long, tie long").groupBy("key", "tie").count().toPandas().sort_values(["key", "tie"])
        if len(found):
            upto = found["count"].cumsum().to_numpy()
            at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts))
            cuts = found["key"].to_numpy()[at], found["tie"].to_numpy()[at]
    placed = map_arrow(ids, _route(kind, idf, common, mean, shared(cuts)), "doc_id long, ids binary, place int, key long, tie long")
    return placed.repartitionById(parts, F.col("place")).sortWithinPartitions("key", "tie", "doc_id").select("doc_id", "ids")


class Shard:
    """Documents with an index of their terms; packs them into windows."""

    def __init__(self, ids: list, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.ids, self.docs = ids, docs
        n = len(docs)
        lengths = np.array([len(d) for d in docs])
        width = len(idf)
        narrow = np.uint32 if n * width < 1 << 32 else np.int64  # sorts faster
        owner = np.repeat(np.arange(n, dtype=narrow), lengths)
        key = owner * narrow(width) + np.concatenate(docs)
        key, tf = np.unique(key, return_counts=True)
        doc, term = key // width, key % width
        doc, term = doc.astype(np.int64), term.astype(np.int64)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))).astype(np.float32)
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.posting_first = np.searchsorted(term[order], np.arange(width + 1))
        self.free = np.ones(n, bool)
        self.next = 0

    def seed(self) -> int | None:
        while self.next < len(self.docs) and not self.free[self.next]:
            self.next += 1
        return self.next if self.next < len(self.docs) else None

    def neighbours(self, d: int) -> Iterator[int]:
        """Unused documents, best score first, then in order."""
        lo, hi = self.first[d], self.first[d + 1]
        w = self.weight[lo:hi]
        heavy = np.argpartition(-w, QUERY_TERMS - 1)[:QUERY_TERMS] if len(w) > QUERY_TERMS else np.arange(len(w))
        docs, weights = [], []
        for t in self.term[lo:hi][heavy]:
            a, b = self.posting_first[t], self.posting_first[t + 1]
            docs.append(self.posting_doc[a:b])
            weights.append(self.posting_weight[a:b])
        if docs:
            score = np.bincount(np.concatenate(docs), np.concatenate(weights), minlength=len(self.docs))
            score[~self.free] = 0
            best = np.argpartition(-score, 15)[:16] if len(score) > 16 else np.arange(len(score))
            best = best[np.lexsort((best, -score[best]))]
            yield from (int(x) for x in best if score[x] > 0)
            if (score > 0).sum() > len(best):
                yield from (int(x) for x in np.argsort(-score, kind="stable") if score[x] > 0)
        while (x := self.seed()) is not None:
            yield x

    def windows(self, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document, start, length); all but the last add up to the given length."""
        window, space, left = [], length, None
        while True:
            if left is None:
                d = self.seed()
                if d is None:
                    break
                self.free[d] = False
                left = (d, 0)
            seed = left[0]
            more = None
            while left is not None:
                d, start = left
                n = min(space, len(self.docs[d]) - start)
                window.append((d, start, n))
                space -= n
                left = (d, start + n) if start + n < len(self.docs[d]) else None
                if not space:
                    yield window
                    window, space = [], length
                    break
                more = more or self.neighbours(seed)
                for x in more:
                    if self.free[x]:
                        self.free[x] = False
                        left = (x, 0)
                        break
        if window:
            yield window


def _powers(window: list[tuple[int, int, int]], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """A window cut into windows whose lengths are powers of two, or whole if it is full."""
    total = sum(n for _, _, n in window)
    if total == length:
        yield window
        return
    at = iter(window)
    d, start, n = next(at)
    for bit in range(total.bit_length() - 1, -1, -1):
        need, out = total & (1 << bit), []
        while need:
            if not n:
                d, start, n = next(at)
            take = min(n, need)
            out.append((d, start, take))
            start, n, need = start + take, n - take, need - take
        if out:
            yield out


def _pack(kind: str, idf, mean: float, length: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            shard = Shard([i for i, _ in held], [d for _, d in held], idf.value, mean)
            out: dict[str, list] = {k.split()[0]: [] for k in _PIECES.split(", ")}
            for window in shard.windows(length):
                for cut in _powers(window, length):
                    offset = 0
                    for d, start, n in cut:
                        ids = shard.docs[d]
                        row = (shard.ids[d], start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), sequence, offset)
                        for k, v in zip(out, row, strict=True):
                            out[k].append(v)
                        offset += n
                    sequence += 1
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = np.frombuffer(x, kind)
                if held and (len(held) >= shard_docs or size + len(d) > SHARD_TOKENS):
                    yield flush()
                    held, size = [], 0
                held.append((i, d))
                size += len(d)
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, scratch: Scratch | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The pieces of all rows of docs (doc_id, text); tokenizer is the path of a tokenizer file."""
    scratch = scratch or Scratch(docs.sparkSession)
    coder = word_ids(tokenizer)
    width, kind = max(coder.tokenizer.get_vocab_size(), end + 1), coder.kind.str
    ids = scratch.save(docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer, end), "doc_id long, ids binary, tie long"))
    counts = ids.select("ids").mapInArrow(_frequencies(width, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(width)
    known = counts[counts["id"] >= 0]
    df[known["id"].to_numpy()] = known["n"].to_numpy()
    total = float(counts.loc[counts["id"] == -1, "n"].sum())
    tokens = float(counts.loc[counts["id"] == -2, "n"].sum())
    mean = max(tokens / max(total, 1), 1.0)
    shared = docs.sparkSession.sparkContext.broadcast
    idf = shared(np.log(1 + (total - df + 0.5) / (df + 0.5)))
    common = shared(df >= max(2, min(shard_docs // 4, total // 16)))
    parts = max(1, int(-(-total // (SHARDS * shard_docs))), int(-(-tokens // SHARD_TOKENS)))
    return routed(ids, kind, idf, common, mean, total, parts).mapInArrow(_pack(kind, idf, mean, length, shard_docs), _PIECES)
