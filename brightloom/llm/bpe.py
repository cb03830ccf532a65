"""BPE encoding and decoding by prefix-sharing trie traversal (operator 6).

In BPE every prefix of a word's tokens is itself the encoding of the characters it covers, and a sequence of tokens
is an encoding exactly when each pair of neighbours is. So the encoding of a prefix is known from its last token and
the prefix before that token. The distinct words are walked as a trie in depth-first order: the state of a node is the
last token of its prefix, a child finds its own among the tokens that end there, and words that begin alike share all
nodes of their common prefix. A word then reads its tokens backwards from its end.

The walk goes over the sorted words with the common prefix kept on a stack, which visits the nodes of the trie in
depth-first order without building them in memory. Each task keeps a bounded cache of words it has encoded; texts are
encoded whole, and nothing is shuffled or gathered.

Public vocabulary files in the format of the tokenizers library are read: NFC, blanks and lower case, a pattern that
splits words, byte-level characters and an end-of-word suffix. Their path is a parameter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import release

#: White space as Unicode has it (the property White_Space), for a character class.
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits that Unicode 16 added to Python's tables, and capitals with their small letters: fixed values.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
_NEW_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: What lower() does otherwise within the basic plane, and all that lies beyond it.
_RARE = ["\u03a3", *(chr(c) for c in _NEW_SMALL if c < 0x10000)]
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _class_of(kind: str, more: tuple, end: int) -> str:
    """The body of a character class of the code points of a general category."""
    runs: list[list[int]] = []
    for c in range(end):
        if unicodedata.category(chr(c))[0] == kind or any(a <= c <= b for a, b in more):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" if b > a else chr(a) for a, b in runs)


def word_pattern(end: int) -> re.Pattern[str]:
    """Contractions, runs of letters, single numbers, and runs of what is none of these and no blank, for texts of
    code points below ``end``: within the basic plane Python's classes are tables, beyond they are lists."""
    letters, numbers = _class_of("L", _NEW_LETTERS, end), _class_of("N", _NEW_NUMBERS, end)
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{_BLANKS}{letters}{numbers}]+")


#: The pattern of words in the file, which word_pattern() spells with explicit classes: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary whose words end in a suffix."""

    def __init__(self, path: str, most_words: int = 350_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("not a lower-case word BPE file")
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("an unknown pattern of words")
        self.plain, self.basic, self.full = (word_pattern(end).findall for end in (0x80, 0x10000, 0x110000))
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.bytes = byte_characters()
        self.longest = max(map(len, self.vocab)) - 1
        self.made = {a + b: (k, a, b) for (a, b), k in self.ranks.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.ids: dict[str, bytes] = {}
        self.most_words = most_words

    def forget(self) -> None:
        """Drop what was learnt about words; the vocabulary stays."""
        self.ids, self.pairs = {}, {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the lowest-ranked pair first, leftmost first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _stands(self, token: str) -> bool:
        """Whether the token is the encoding of its own characters."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merge(self._symbols(token)) == [token]
        return known

    def _follows(self, last: str, token: str) -> bool:
        """Whether two tokens, each an encoding by itself, stay as they are side by side.

        They would not if some merge across the border came before the merges that build the neighbours there. The
        border's pieces are taken apart from the latest merge back, and each pair of pieces that once met is asked."""
        a, b, limit = last, token, len(self.ranks)
        made, ranks = self.made, self.ranks
        while True:
            if ranks.get((a, b), limit) < limit:
                return False
            ra, rb = made.get(a, (-1,))[0], made.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the left piece was built last: before that, its right half stood at the border
                limit, a = ra, made[a][2]
            else:  # of two equal pieces the left one is built first
                limit, b = rb + 1 if ra < rb else rb, made[b][1]
                if ra == rb:
                    limit = rb + 1

    def _last(self, text: str, end: int, states: list[str], suffix: str) -> str:
        """The last token of the encoding of text[:end] + suffix; states holds that of each shorter prefix."""
        vocab, pairs = self.vocab, self.pairs
        for start in range(end - self.longest if end > self.longest else 0, end):
            token = text[start:end] + suffix
            if token in vocab:
                key = (states[start], token)
                good = pairs.get(key)
                if good is None:
                    if len(pairs) > 250_000:
                        pairs.clear()
                    good = pairs[key] = self._stands(token) and (not start or self._follows(*key))
                if good:
                    return token
        raise ValueError("a character is missing from the vocabulary")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """word (byte characters) -> ids, by one depth-first walk over the trie of the words."""
        out: dict[str, list[int]] = {}
        states, before, cut = [""], "", len(self.suffix)
        for word in sorted(words):
            shared = len(commonprefix((before, word)))
            del states[min(shared, len(word) - 1) + 1 :]
            for end in range(len(states), len(word)):
                states.append(self._last(word, end, states, ""))
            token = self._last(word, len(word), states, self.suffix)
            ids, at = [self.vocab[token]], len(word) - len(token) + cut
            while at:
                token = states[at]
                ids.append(self.vocab[token])
                at -= len(token)
            out[word] = ids[::-1]
            before = word[: len(states) - 1]
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text in order; added tokens stand for themselves."""
        if "<" in text and self.special.search(text):
            return [w for k, part in enumerate(self.special.split(text)) for w in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain(text.lower())
        text = unicodedata.normalize("NFC", text)
        beyond = _BEYOND.search(text)
        if beyond or any(c in text for c in _RARE):  # each for itself: a sigma has no form of its own at a word's end
            text = "".join(c.lower() for c in text.translate(_NEW_SMALL))
        else:
            text = text.lower()
        return self.full(text) if beyond else self.basic(text)

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not known yet."""
        if len(self.ids) > self.most_words:
            self.ids.clear()
        new = {w for w in set(words) if w not in self.ids}
        for w in new & self.added.keys():
            self.ids[w] = array("I", [self.added[w]]).tobytes()
        table = dict(enumerate(self.bytes))
        spelt = {w.encode().decode("latin-1").translate(table): w for w in new - self.added.keys()}
        for s, ids in self.encode_words(spelt).items():
            self.ids[spelt[s]] = array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out, group, held = [], [], 0
        for k, text in enumerate(texts):
            group.append(self.split(text))
            held += len(group[-1])
            if held > 150_000 or k == len(texts) - 1:
                self.learn(chain.from_iterable(group))
                get = self.ids.__getitem__
                out += [b"".join(map(get, words)) for words in group]
                group, held = [], 0
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens, parted by spaces: what the library gives for a file without a decoder."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One vocabulary in each Python process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: the ids as little-endian unsigned 32-bit integers) and decoded (string) of every row.

    ``docs`` has doc_id and text, other columns are ignored; ``path`` names the vocabulary file on every executor.
    A null text counts as empty; an empty text has no ids and decodes to ''. Repeated rows stay repeated, doc_id may
    be null. Added tokens that a text spells out become their own ids, as the library does it. Texts are normalised by
    Python's Unicode tables: combining marks newer than those may be ordered differently."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
        bpe.forget()
        release()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return encode_decode(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
