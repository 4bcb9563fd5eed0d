"""BPE encoding and decoding with word ends (operator 2).

A text is normalised and cut into words as the vocabulary file says; each batch
encodes its *distinct* words only, all at once in NumPy, and gathers the ids
back into text order.  A word longer than ``LEAF`` bytes is encoded by tree
concatenation: its leaves are encoded side by side as rows of the same NumPy
batch, and neighbours are joined level by level.  At a join a window of a few
tokens on each side is encoded again; the window grows until its first token
and its last token are those that the two sides had there.  In a BPE whose
tokens each have one merge, a sequence is the encoding exactly if every pair of
neighbours is one that an encoding produces, so agreement at both rims proves
the join.

Texts with characters outside the two-byte UTF-8 range, with combining marks or
with the strings of special tokens are normalised and cut into words by the
tokenizers library, per text; their words are encoded like all others.

Defined results: null and empty texts have no ids and decode to an empty text;
repeated rows give repeated results; of merges of equal rank the leftmost comes
first, as in the library; very long texts are encoded whole, one text at a time
where it is longer than a batch; extra columns are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from mudline.llm.batches import by_bytes, gather_spans, text_bytes

LEAF = 32
CACHE_WORDS = 200_000
NONE = np.int32(2**31 - 1)
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
TABLE_BITS = 18


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def two_byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """For code points below U+0800: the word class, and whether a text with it can take the NumPy path."""
    classes, safe = np.full(0x800, OTHER, np.uint8), np.ones(0x800, bool)
    chars = [chr(c) for c in range(0x800)]
    lowered = pc.utf8_lower(pa.array(chars)).to_pylist()
    for c, ch in enumerate(chars):
        kind = unicodedata.category(ch)
        classes[c] = SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER
        safe[c] = kind[0] != "M" and kind != "Cn" and unicodedata.normalize("NFC", ch) == ch and ch.lower() == lowered[c] and len(lowered[c]) == 1
    return classes, safe


class WordBpe:
    """One vocabulary file, loaded once in a Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        end = spec["model"]["end_of_word_suffix"]
        if spec["model"]["type"] != "BPE" or not end or len({a + b for a, b in merges}) != len(merges):
            raise ValueError("a BPE vocabulary with an end-of-word suffix and one merge for each token is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.normalizer, self.pre_tokenizer = self.library.normalizer, self.library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._at_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        symbols = byte_symbols()
        self._bytes_of = {ord(c): b for b, c in enumerate(symbols)}
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], np.int32)
        size = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        self.tokens = np.empty(size, object)
        self.n_bytes = np.zeros(size, np.int64)
        for token, i in vocab.items():
            self.tokens[i] = token
            self.n_bytes[i] = len(token.removesuffix(end)) or len(token)
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
        self.made = np.array([vocab[a + b] for a, b in merges] + [0], np.int32)
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in merges], np.uint32)
        self._keys = np.zeros(1 << TABLE_BITS, np.uint32)
        self._ranks = np.full(1 << TABLE_BITS, NONE, np.int32)
        self._known: dict[bytes, int] = {}
        self._ids, self._first, self._counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        slots = self._slot(keys)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            while self._ranks[slot] != NONE:
                slot = (slot + 1) & ((1 << TABLE_BITS) - 1)
            self._keys[slot], self._ranks[slot] = key, rank

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; NONE where a side is -1 or the pair has no merge."""
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slots = self._slot(keys)
        found = self._ranks[slots]
        odd = np.flatnonzero((found != NONE) & (self._keys[slots] != keys))
        while odd.size:
            slots[odd] = (slots[odd] + 1) & ((1 << TABLE_BITS) - 1)
            found[odd] = self._ranks[slots[odd]]
            odd = odd[(found[odd] != NONE) & (self._keys[slots[odd]] != keys[odd])]
        found[(left < 0) | (right < 0)] = NONE
        return found

    def _merge(self, sym: np.ndarray) -> np.ndarray:
        """Merge every row of ``sym`` (ids, -1 after the end); dead places become -1."""
        n, width = sym.shape
        rank = np.full((n, width), NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self._rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
        nxt = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
        prv = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
        flat, base = sym.ravel(), np.arange(n, dtype=np.int64) * width
        while base.size:
            at = rank.argmin(1)
            best = rank[np.arange(len(base)), at]
            go = best != NONE
            if not go.all():
                rank, base, at, best = rank[go], base[go], at[go], best[go]
                if not base.size:
                    break
            row = np.arange(len(base))
            here = base + at
            gone = nxt[here]
            after = nxt[base + gone]
            new = self.made[best]
            flat[here], flat[base + gone] = new, -1
            nxt[here] = after
            rank[row, gone] = NONE
            inside = after < width
            prv[(base + after)[inside]] = at[inside]
            right = np.where(inside, flat[base + np.minimum(after, width - 1)], -1)
            rank[row, at] = self._rank(new, right)
            before = prv[here]
            some = np.flatnonzero(before >= 0)
            rank[some, before[some]] = self._rank(flat[base[some] + before[some]], new[some])
        return sym

    def _encode_rows(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of byte spans; where ``closed``, the last byte ends a word."""
        counts = np.zeros(len(starts), np.int64)
        widths = 1 << np.maximum(2, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        done = []
        for width in np.unique(widths):
            rows = np.flatnonzero((widths == width) & (sizes > 0))
            for part in np.array_split(rows, max(1, len(rows) * int(width) // 4_000_000)):
                cols = np.arange(width)
                inside = cols[None, :] < sizes[part, None]
                sym = np.where(inside, self.inner[raw[np.minimum(starts[part, None] + cols, max(len(raw) - 1, 0))]], np.int32(-1)).astype(np.int32)
                ends = part[closed[part]]
                sym[np.flatnonzero(closed[part]), sizes[ends] - 1] = self.final[raw[starts[ends] + sizes[ends] - 1]]
                sym = self._merge(sym)
                live = sym >= 0
                counts[part] = live.sum(1)
                done.append((part, sym[live]))
        ids = np.empty(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        for part, got in done:
            ids[gather_spans(first[part], counts[part])] = got
        return ids, counts

    def encode_words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of whole words, given by their bytes."""
        starts, sizes = offsets[:-1], np.diff(offsets)
        long = np.flatnonzero(sizes > LEAF)
        ids, counts = self._encode_rows(raw, starts, np.where(sizes > LEAF, 0, sizes), np.ones(len(sizes), bool))
        if not long.size:
            return ids, counts
        trees = [self._join_tree(raw[starts[w] : starts[w] + sizes[w]]) for w in long.tolist()]
        first = np.cumsum(counts) - counts
        counts = counts.copy()
        pieces, at = [], 0
        for w, tree in zip(long.tolist(), trees, strict=True):
            pieces += [ids[at : first[w]], tree]
            at, counts[w] = first[w], len(tree)
        return np.concatenate([*pieces, ids[at:]]), counts

    def _join_tree(self, word: np.ndarray) -> np.ndarray:
        """Encode one long word: leaves side by side, then joins level by level."""
        cuts = np.append(np.arange(0, len(word), LEAF), len(word))
        closed = np.zeros(len(cuts) - 1, bool)
        closed[-1] = True
        ids, counts = self._encode_rows(word, cuts[:-1], np.diff(cuts), closed)
        nodes = np.split(ids, np.cumsum(counts)[:-1])
        spans = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        while len(nodes) > 1:
            pairs = list(range(0, len(nodes) - 1, 2))
            made: dict[int, np.ndarray] = {}
            grow = 2
            while len(made) < len(pairs):
                todo = [p for p in pairs if p not in made]
                windows = []
                for p in todo:
                    left, right = nodes[p], nodes[p + 1]
                    a, b = max(0, len(left) - grow), min(len(right), grow)
                    begin, finish = spans[p][1] - int(self.n_bytes[left[a:]].sum()), spans[p + 1][0] + int(self.n_bytes[right[:b]].sum())
                    windows.append((a, b, begin, finish))
                begin, finish = (np.array([w[i] for w in windows]) for i in (2, 3))
                got, n = self._encode_rows(word, begin, finish - begin, finish == len(word))
                for p, (a, b, _, _), mid in zip(todo, windows, np.split(got, np.cumsum(n)[:-1]), strict=True):
                    left, right = nodes[p], nodes[p + 1]
                    if (a == 0 or mid[0] == left[a]) and (b == len(right) or mid[-1] == right[b - 1]):
                        made[p] = np.concatenate([left[:a], mid, right[b:]])
                grow *= 2
            rest = [(nodes[-1], spans[-1])] if len(nodes) % 2 else []
            spans = [(spans[p][0], spans[p + 1][1]) for p in pairs] + [s for _, s in rest]
            nodes = [made[p] for p in pairs] + [n for n, _ in rest]
        return nodes[0]

    @staticmethod
    def _unsafe_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with a character that only the library's own normaliser handles."""
        lead = np.flatnonzero(raw >= 0xC0)
        two = lead[raw[lead] < 0xE0]
        code = ((raw[two].astype(np.int64) & 31) << 6) | (raw[two + 1] & 63)
        at = np.concatenate([lead[raw[lead] >= 0xE0], two[~two_byte_classes()[1][code]]])
        return np.unique(np.searchsorted(offsets, at, side="right") - 1)

    @staticmethod
    def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lower-cased text: its bytes without white space, word offsets in them, and the words in each row."""
        table, _ = two_byte_classes()
        kind = table[:128][np.minimum(raw, 127)]
        multi = np.flatnonzero(raw >= 0x80)
        start = np.zeros(len(raw) + 1, bool)
        if multi.size:
            lead = multi[raw[multi] >= 0xC0]
            two = lead[raw[lead] < 0xE0]
            code = ((raw[two].astype(np.int64) & 31) << 6) | (raw[two + 1] & 63)
            kind[two] = kind[two + 1] = table[code]
            start[two[table[code] == DIGIT]] = True
        start[1:-1] |= kind[1:] != kind[:-1]
        start[:-1] |= (kind == DIGIT) & (raw < 0x80)
        start[offsets] = True
        quote = np.flatnonzero(raw == 39)
        if quote.size:
            quote = quote[(start[quote]) & (quote + 1 < len(raw))]
            quote = quote[~start[:-1][quote + 1] | (kind[quote + 1] == LETTER)]
            hard = np.zeros(len(raw) + 3, bool)
            hard[offsets] = True
            quote = quote[~hard[quote + 1]]
            one, two_ = raw[quote + 1], raw[np.minimum(quote + 2, len(raw) - 1)]
            pair = (((one == 114) | (one == 118)) & (two_ == 101)) | ((one == 108) & (two_ == 108))
            pair &= (quote + 2 < len(raw)) & ~hard[quote + 2]
            single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            q = quote[single | pair]
            size = np.where(single, 2, 3)[single | pair]
            start[q + 1] = False
            start[q + size] = True
        starts = np.flatnonzero(start[:-1])
        ends = np.append(starts[1:], len(raw))
        word = kind[starts] != SPACE
        sizes = (ends - starts)[word]
        rows = np.searchsorted(starts[word], offsets)
        return raw[kind != SPACE], np.concatenate([[0], np.cumsum(sizes)]), np.diff(rows)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first places and counts of distinct words; what earlier batches met comes from a bounded cache."""
        if len(self._known) > CACHE_WORDS:
            self._known, self._ids, self._first, self._counts = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        get = self._known.get
        listed = words.to_pylist()
        rows = np.fromiter((get(w, -1) for w in listed), np.int64, len(listed))
        new = np.flatnonzero(rows < 0)
        if new.size:
            fresh = words.take(pa.array(new))
            _, offsets, data = fresh.buffers()
            ids, counts = self.encode_words(np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[: len(fresh) + 1])
            rows[new] = np.arange(len(new)) + len(self._counts)
            self._known.update((listed[i], r) for i, r in zip(new.tolist(), rows[new].tolist(), strict=True))
            self._first = np.concatenate([self._first, np.cumsum(counts) - counts + len(self._ids)])
            self._counts = np.concatenate([self._counts, counts])
            self._ids = np.concatenate([self._ids, ids])
        return self._ids, self._first[rows], self._counts[rows]

    def _library_words(self, text: str) -> list[bytes | int]:
        """The words of a text by the library's normaliser and splitter, and the ids of special tokens between them."""
        out: list[bytes | int] = []
        for k, part in enumerate(self._at_special.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [w.translate(self._bytes_of).encode("latin-1") for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def _encode_odd(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text that the NumPy splitter does not handle."""
        rows = [self._library_words(t) for t in texts]
        items = [w for row in rows for w in row]
        special = np.array([isinstance(w, int) for w in items], bool)
        coded = pa.array([w for w in items if isinstance(w, bytes)], pa.large_binary()).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids, first, counts = self._distinct(coded.dictionary)
        sizes = np.ones(len(items), np.int64)
        sizes[~special] = counts[index]
        flat, marked = np.zeros(int(sizes.sum()), np.int32), np.repeat(special, sizes)
        flat[marked] = [w for w in items if isinstance(w, int)]
        flat[~marked] = ids[gather_spans(first[index], counts[index])]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.split(flat, ends[np.cumsum([len(row) for row in rows])[:-1]])

    def encode_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and each row's number of ids."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        odd = np.zeros(len(column), bool)
        for s in self.special:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        odd[self._unsafe_rows(*text_bytes(column))] = True
        others = column.filter(pa.array(odd))
        column = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), column)
        data, words, per_row = self._words(*text_bytes(pc.utf8_lower(column)))
        taken = pa.Array.from_buffers(pa.large_binary(), len(words) - 1, [None, pa.py_buffer(words.astype(np.int64)), pa.py_buffer(data)])
        coded = taken.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids, first, counts = self._distinct(coded.dictionary)
        sizes = counts[index]
        flat = ids[gather_spans(first[index], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        marks = ends[np.concatenate([[0], np.cumsum(per_row)])]
        if not odd.any():
            return flat, np.diff(marks)
        parts, n, coded_apart = [], np.diff(marks), iter(self._encode_odd(others.to_pylist()))
        for r in range(len(column)):
            if odd[r]:
                got = next(coded_apart)
                n[r] = len(got)
                parts.append(got)
            else:
                parts.append(flat[marks[r] : marks[r + 1]])
        return np.concatenate(parts), n

    def decode_ids(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False) for a vocabulary without a decoder."""
        return " ".join(self.tokens[ids].tolist())


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    """The word-level vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for each row of ``docs``; no shuffle."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), id_lists(*bpe.encode_texts(b.column(1)))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` (the text that the ids stand for) for each row of ``docs``; no shuffle."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in by_bytes(batches, "text"):
            flat, counts = bpe.encode_texts(b.column(1))
            ends = np.cumsum(counts)
            texts = [bpe.decode_ids(flat[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), id_lists(flat, counts), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id_col`` and ``text`` from arrays of ids (null: empty)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode_ids(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
