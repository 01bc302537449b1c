"""BPE encoding by speculation: greedy tokens first, exact merging only where they can't stand.

For each distinct word the longest vocabulary entries are taken from the left. A token sequence
is what merging by rank would give exactly if every adjacent pair is: the first merge to cross a
boundary would already cross it when the two tokens' symbols are merged alone. So all adjacent
pairs of a batch are tested at once against sorted arrays of pairs known to stand or to fail,
pairs seen for the first time are merged exactly once each, and only words with a failing
pair undergo exact merging: by a list of ranks, or in a heap over linked neighbours if they are long.

Defined cases: a null text is an empty one, with no tokens; the strings of added tokens are found in
the raw text as the library finds them; texts and words of any length are encoded whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Letters of distinct words that a worker remembers (16 or so a word) before it starts anew; pairs it remembers.
LETTERS_KEPT, PAIRS_KEPT = 16_000_000, 4_000_000
#: Symbols from which on a word is merged in a heap.
LONG_WORD = 48
NO_RANK = 1 << 60
END = "</w>"
# The letters, numbers and spaces among the first 256 characters, in lower case.
_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class SpeculativeBpe:
    """Word-end BPE of a ``tokenizers`` file (NFC, lower case, white space dropped)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError(f"not a word-end BPE: {path}")
        self.id_of: dict[str, int] = model["vocab"]
        self.token_of = {i: t for t, i in self.id_of.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Rank of a pair of ids, and the id that the merge of each rank gives.
        self.rank = {(self.id_of[a] << 20) + self.id_of[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [self.id_of[a + b] for a, b in merges]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of |= {i: t for t, i in self.added.items()}
        self.inner = {t: i for t, i in self.id_of.items() if not t.endswith(END) and t not in self.added}
        self.final = {t[: -len(END)]: i for t, i in self.id_of.items() if t.endswith(END)}
        self.longest_final = max(map(len, self.final))
        #: How long an inner token can be that begins with these two letters.
        self.reach: dict[str, int] = {}
        for t in self.inner:
            if len(t) > 1:
                self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.letters = byte_letters()
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.stand = np.zeros(0, np.int64)
        self.fail = np.zeros(0, np.int64)
        #: Whether the symbols of a token merge to it.
        self.single: dict[int, bool] = {}
        self.bytes_of = [b""] * (max(self.token_of) + 1)
        for i, t in self.token_of.items():
            self.bytes_of[i] = f" {t}".encode()
        self.forget()
        #: Words encoded, and those that needed exact merging.
        self.tried = self.merged = 0

    def forget(self) -> None:
        """No word is known: numbers of words, their ids and decoded texts one after another, and where each ends."""
        self.number: dict[str, int] = {}
        self.ids, self.text = array("I"), bytearray()
        self.ids_end, self.text_end = array("q", [0]), array("q", [0])
        self.letters_held = 0

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging of ids: the lowest rank first, the leftmost of equals. A symbol that isn't in the vocabulary is -1 and never merges."""
        if len(symbols) >= LONG_WORD:
            return self.merge_long(symbols)
        rank, made = self.rank.get, self.made
        ranks = [rank((a << 20) + b, NO_RANK) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            new = symbols[at] = made[least]
            del symbols[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank((new << 20) + symbols[at + 1], NO_RANK)
            if at:
                ranks[at - 1] = rank((symbols[at - 1] << 20) + new, NO_RANK)
        return symbols

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for long words: a heap of pairs by (rank, place), symbols linked to their neighbours."""
        rank, n = self.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        here, gone = list(symbols), -2
        heap = [(rank[pair], i, pair) for i, pair in enumerate((a << 20) + b for a, b in zip(symbols, symbols[1:])) if pair in rank]
        heapq.heapify(heap)

        def propose(i: int) -> None:
            if i >= 0 and after[i] < n and (pair := (here[i] << 20) + here[after[i]]) in rank:
                heapq.heappush(heap, (rank[pair], i, pair))

        while heap:
            least, i, pair = heapq.heappop(heap)
            if here[i] == gone or after[i] >= n or (here[i] << 20) + here[after[i]] != pair:
                continue
            right = after[i]
            here[i], here[right], after[i] = self.made[least], gone, after[right]
            if after[i] < n:
                before[after[i]] = i
            propose(i)
            propose(before[i])
        return [x for x in here if x != gone]

    def symbols(self, word: str) -> list[int]:
        inner = self.inner.get
        return [*[inner(c, -1) for c in word[:-1]], self.final.get(word[-1], -1)]

    def token_symbols(self, token: int) -> list[int]:
        t = self.token_of[token]
        return self.symbols(t[: -len(END)]) if t.endswith(END) else [self.inner.get(c, -1) for c in t]

    def greedy(self, word: str) -> list[int] | None:
        """Longest matches from the left; None if they run into a dead end."""
        out, at, n, inner, reach = [], 0, len(word), self.inner, self.reach
        while at < n:
            rest = n - at
            if rest <= self.longest_final and (found := self.final.get(word[at:])) is not None:
                out.append(found)
                return out
            for to in range(at + min(rest - 1, reach.get(word[at : at + 2], 1)), at, -1):
                if (found := inner.get(word[at:to])) is not None:
                    out.append(found)
                    at = to
                    break
            else:
                return None
        return out

    def pair_stands(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self.merge(self.token_symbols(a) + self.token_symbols(b)) == [a, b]

    def token_stands(self, token: int) -> bool:
        if token not in self.single:
            self.single[token] = self.merge(self.token_symbols(token)) == [token]
        return self.single[token]

    def _known(self, pairs: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(pairs), bool)
        return table[np.minimum(np.searchsorted(table, pairs), len(table) - 1)] == pairs

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of words given in byte letters."""
        if not words:
            return []
        proposed = [self.greedy(w) for w in words]
        sizes = np.array([len(p) if p else 0 for p in proposed], np.int64)
        tokens = np.fromiter((t for p in proposed if p for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        pairs = (tokens[:-1] << 32) | tokens[1:]
        inside = owner[:-1] == owner[1:]
        pairs, owners = pairs[inside], owner[:-1][inside]
        distinct, back = np.unique(pairs, return_inverse=True)
        new = distinct[~(self._known(distinct, self.stand) | self._known(distinct, self.fail))]
        ok = np.fromiter(map(self.pair_stands, new.tolist()), bool, len(new))
        self.stand, self.fail = np.union1d(self.stand, new[ok]), np.union1d(self.fail, new[~ok])
        bad = np.zeros(len(words), bool)
        bad[owners[self._known(distinct, self.fail)[back]]] = True
        for i in np.flatnonzero(sizes == 1).tolist():
            bad[i] = not self.token_stands(proposed[i][0])
        bad |= np.array([p is None for p in proposed], bool)
        self.tried, self.merged = self.tried + len(words), self.merged + int(bad.sum())
        for i in np.flatnonzero(bad).tolist():
            proposed[i] = [t for t in self.merge(self.symbols(words[i])) if t >= 0]
        return proposed

    def _learn(self, keys: list[str]) -> None:
        """Remembers words that aren't known."""
        if len(self.stand) + len(self.fail) > PAIRS_KEPT:
            self.stand, self.fail = self.stand[:0], self.fail[:0]
        letters, added = self.letters, [k for k in keys if k[:2] == "  "]
        words = [k for k in keys if k[:2] != "  "]
        found = self.encode_words([w[1:] if w[0] == " " else "".join([letters[b] for b in w.encode()]) for w in words])
        found += [[self.added[k[2:]]] for k in added]
        start, bytes_of = len(self.number), self.bytes_of
        self.number.update(zip([*words, *added], range(start, start + len(keys))))
        for ids in found:
            self.ids.extend(ids)
            self.ids_end.append(len(self.ids))
            for i in ids:
                self.text += bytes_of[i]
            self.text_end.append(len(self.text))
        self.letters_held += sum(map(len, keys)) + 8 * len(keys)

    def split(self, text: str) -> list[str]:
        """The words of a text, as keys: plain words, one space and byte letters, or two spaces and an added token."""
        if not text:
            return []
        if text.isascii() or _is_latin(text):
            return _LATIN.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [f" {w}" for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Per text: its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        split = [self._parts(t) for t in texts]
        words = list(chain.from_iterable(split))
        if self.letters_held > LETTERS_KEPT:
            self.forget()
        numbers = list(map(self.number.get, words))
        if None in numbers:
            self._learn(list({w for w, n in zip(words, numbers) if n is None}))
            numbers = [self.number[w] if n is None else n for w, n in zip(words, numbers)]
        of = np.array(numbers, np.int64)
        ends = np.cumsum([len(p) for p in split], dtype=np.int64)
        ids, id_ends = _gathered(np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ids_end, np.int64), of, ends)
        text, text_ends = _gathered(np.frombuffer(self.text, np.uint8), np.frombuffer(self.text_end, np.int64), of, ends)
        raw, decoded, a, c = ids.astype("<u4").tobytes(), text.tobytes(), 0, 0
        for b, d in zip(id_ends.tolist(), text_ends.tolist()):
            yield raw[4 * a : 4 * b], decoded[c + 1 : d].decode()
            a, c = b, d

    def _parts(self, text: str) -> list[str]:
        if not any(t in text for t in self.added):
            return self.split(text)
        out: list[str] = []
        for piece in self.split_added.split(text):
            out += [f"  {piece}"] if piece in self.added else self.split(piece)
        return out


def _gathered(values: np.ndarray, stops: np.ndarray, of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the words ``of`` one after another, and where those of each text end, ``ends`` counting words."""
    first = stops[of]
    sizes = stops[of + 1] - first
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    out = values[np.repeat(first - (upto - sizes), sizes) + np.arange(total)] if total else values[:0]
    return out, np.concatenate([[0], upto])[ends]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def of_worker(path: str) -> SpeculativeBpe:
    """This Python worker's encoder, which remembers words from task to task."""
    held = sys.modules.setdefault("_tierview_worker", ModuleType("_tierview_worker"))
    if getattr(held, "bpe_of", None) != path:
        held.bpe, held.bpe_of = SpeculativeBpe(path), path
    return held.bpe


#: Bytes of text taken at a time.
CHUNK = 2_000_000


def bpe_encode(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (binary) and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of_worker(path)
        for batch in batches:
            for part in _chunks(batch):
                ids, decoded = zip(*bpe.encode_batch([x or "" for x in part.column(1).to_pylist()]))
                columns = [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns, names = columns + [pa.array(ids, pa.binary()), pa.array(decoded)], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(df.dtypes)[id_column]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids
    return df.select(df[id_column].alias("id"), df[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Row ranges of about CHUNK bytes of the text in column 1."""
    ends = np.cumsum(np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(1)).to_pylist()], np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK)))
        yield batch.slice(at, to - at)
        at = to


def op6_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
