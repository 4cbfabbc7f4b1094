"""BPE encoding by a dynamic program over prefixes, and decoding, equal to the library's.

Every prefix of a word has one last token: the one that ends the encoding of that
prefix. An automaton with suffix links names all tokens that end at a place, longest
first; a token is the last one there if it may follow the last token of the prefix
before it. Two tokens may stand side by side if no merge across their border comes
before the merges that made them: ``_apart`` climbs the right edge of the first and
the left edge of the second in order of rank. Back-pointers then give the ids.

The vocabulary, its ranks, normalizer and pre-tokenizer come from the file. Neither
of these looks across blanks and newlines, so that the text is cut there and each
distinct stretch is worked out once a worker, in bounded tables; special strings inside
the text become their tokens as in the library. Plain ASCII needs no normalizer but
lower case.

Nulls count as empty texts, which have no tokens; texts of any length are encoded
whole, a million characters at a time; repeated rows each; ties do not occur, as the
last token is unique; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, small_batches, texts_of

#: What a worker remembers: stretches between blanks, words, and pairs of tokens, of each the latest so many or twice that. Longer ones are worked out each time.
REMEMBERED, LONGEST = 1 << 18, 48
AT_ONCE = 1 << 20
END = "</w>"
#: A symbol that ends a word is moved up by this.
LAST = 1 << 15
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
INFINITE = 1 << 62


class Encoder:
    """Encodes and decodes by one tokenizer file: a BPE model with an end-of-word suffix and no decoder."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["continuing_subword_prefix"] or model["dropout"] or model["unk_token"] or spec["decoder"]:
            raise ValueError("a BPE model with an end-of-word suffix, and without unknown tokens, dropout or decoder, is needed")
        self.library = Tokenizer.from_file(path)
        self.names: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(not t["special"] or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or set(" \n") & set(t["content"]) for t in spec["added_tokens"]):
            raise ValueError("added tokens must be special, plain, and without blanks")
        self.names |= {i: t for t, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        made = {vocab[a + b]: (vocab[a], vocab[b], rank) for rank, (a, b) in enumerate(merges)}
        self.rank: dict[tuple[int, int], int] = {(a, b): rank for a, b, rank in made.values()}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        symbols: dict[int, str] = {}
        real: set[int] = set()
        for token, i in vocab.items():
            if i not in made and i not in self.special.values():
                symbols[i] = chr(ord(token[0]) + LAST) if token.endswith(END) and token != END else token
                self.right[i] = self.left[i] = [(i, INFINITE)]
                real.add(i)
        for i, (a, b, rank) in made.items():  # a merge follows those that made its parts
            symbols[i] = symbols[a] + symbols[b]
            self.right[i] = [*self.right[b][:-1], (b, rank), (i, INFINITE)]
            self.left[i] = [*self.left[a][:-1], (a, rank), (i, INFINITE)]
            if a in real and b in real and self._apart(a, b, to_the_end=False):
                real.add(i)
        self.automaton = ahocorasick.Automaton()
        for i in real:
            self.automaton.add_word(symbols[i], (len(symbols[i]), i))
        self.automaton.make_automaton()
        self.bytes = self._byte_symbols()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.earlier: dict[str, tuple[int, str, str]] = {}  # what was known before the table was full

    @staticmethod
    def _byte_symbols() -> dict[int, str]:
        """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}

    def _apart(self, a: int, b: int, to_the_end: bool = True) -> bool:
        """True if ``a`` then ``b`` are left side by side: no merge joins what stands at their border, at any time.

        While x, at the right edge of ``a``, is next merged at rank nx, and y, at the left edge of ``b``, at ny,
        (x, y) would be merged if its rank is below nx, and not above ny, as of equal merges the left one is first.
        """
        edge_a, edge_b, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, nx), (y, ny) = edge_a[i], edge_b[j]
            over = nx == ny == INFINITE
            if over and not to_the_end:
                return True
            rank = self.rank.get((x, y))
            if rank is not None and rank < nx and rank <= ny:
                return False
            if over:
                return True
            if nx <= ny:
                i += 1
            else:
                j += 1

    def word(self, symbols: str) -> tuple[int, ...]:
        """The ids of one word in byte-level symbols, without its end mark."""
        if (found := self.words.get(symbols)) is not None:
            return found
        size, pairs = len(symbols), self.pairs
        last, begins = [-1] * (size + 1), [0] * (size + 1)
        for end, (length, token) in self.automaton.iter(symbols[:-1] + chr(ord(symbols[-1]) + LAST)):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - length
            if start:
                if (before := last[start]) < 0:
                    continue
                fits = pairs.get((before, token))
                if fits is None:
                    if len(pairs) >= 4 * REMEMBERED:
                        pairs.clear()
                    fits = pairs[before, token] = self._apart(before, token)
                if not fits:
                    continue
            last[end + 1], begins[end + 1] = token, start
        ids, at = [], size
        while at:
            ids.append(last[at])
            at = begins[at]
        found = tuple(reversed(ids))
        if size <= LONGEST:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[symbols] = found
        return found

    def _symbols(self, stretch: str) -> list[str]:
        """The words of a stretch, normalized, in byte-level symbols."""
        if stretch.isascii() and stretch.isprintable():
            return ASCII_WORD.findall(stretch.lower())
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(stretch))]

    def stretch(self, text: str) -> tuple[int, str, str]:
        """Of a stretch without blanks: how many tokens, their ids and their names, blanks between them."""
        found = self.known.get(text) or self.earlier.get(text)
        if found is None:
            ids: list[int] = []
            for part in self.at_special.split(text) if self.at_special and self.at_special.search(text) else [text]:
                if part in self.special:
                    ids.append(self.special[part])
                elif part:
                    for word in self._symbols(part):
                        ids += self.word(word)
            found = len(ids), " ".join(map(str, ids)), self.decode(ids)
        if len(text) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.earlier, self.known = self.known, {}
            self.known[text] = found
        return found

    def stretches(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """Those of a text, a million characters at a time: cut at blanks and newlines."""
        start = 0
        while start < len(text):
            stop = len(text)
            if stop - start > AT_ONCE:
                blank, line = text.find(" ", start + AT_ONCE), text.find("\n", start + AT_ONCE)
                stop = min((x for x in (blank, line) if x >= 0), default=stop)
            parts = list(filter(None, text[start:stop].replace("\n", " ").split(" ")))
            found = list(map(self.known.get, parts))
            if None in found:
                found = [f or self.stretch(part) for f, part in zip(found, parts, strict=True)]
            yield found
            start = stop

    def encode(self, text: str) -> list[int]:
        return [int(i) for found in self.stretches(text) for n, ids, _ in found if n for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens with blanks between them, as the library has it without a decoder; ids without a token are passed over."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; ``tokenizer`` is the path of a file as in ``Encoder``."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({id_col: b.column(0), "ids": pa.array([encoder(tokenizer).encode(t) for t in texts_of(b, text_col)], pa.list_(pa.int32()))})

    rows = columns(docs, id_col, text_col)
    return rows.mapInArrow(encode, f"`{id_col}` {rows.dtypes[0][1]}, ids array<int>")


def decoded(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of the rows of ``token_ids``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({id_col: b.column(0), "text": pa.array([encoder(tokenizer).decode(x.as_py() or []) for x in b.column(1)], pa.string())})

    rows = columns(encoded, id_col, "ids")
    return rows.mapInArrow(decode, f"`{id_col}` {rows.dtypes[0][1]}, text string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the ids and the decoded text of every whole text, hashed as they are made."""
    small_batches(docs.sparkSession)

    def each(text: str) -> tuple[int, str, str]:
        n, hashed = 0, (hashlib.sha256(), hashlib.sha256())
        for found in encoder(tokenizer).stretches(text):
            counts, *said = zip(*found, strict=True) if found else ((), (), ())
            if more := sum(counts):
                for h, parts in zip(hashed, said, strict=True):
                    h.update((" " * (n > 0) + " ".join(filter(None, parts))).encode())
            n += more
        return n, *(h.hexdigest() for h in hashed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [each(t) for t in texts_of(b, text_col)]
            n, ids, said = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch({id_col: b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(said, pa.string())})

    rows = columns(docs, id_col, text_col)
    return rows.mapInArrow(encode, f"`{id_col}` {rows.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
