"""BPE encoding and decoding by a traversal of the words' trie.

The encoding of a word's prefix is the encoding of a shorter prefix and one
last token, so a state is only (where the last token starts, the token).
Distinct words are inserted in order into a trie and walked depth first: the
states along the current path are a stack, and a word pays only for the part it
doesn't share with the word before.  The last token at a node is the
longest token ending there that is compatible with the last token of the prefix
it follows, two tokens being compatible if their text encodes as these two
(memoised; a sequence is the encoding of its text just if all neighbours are).

Each worker keeps the encodings of words it has met, in two generations of up to
``KEEP`` each: a full one replaces the one before, and what is met again moves
over, so frequent words are never encoded twice.  Nothing is shuffled.

Defined results: a null text counts as empty and has no tokens; very long texts
and repeated rows need nothing special; other columns are left out.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.arrow_text import trimmed

#: Words, and pieces of text, that a worker remembers in a generation.
KEEP = 100_000
#: White space as the tokenizers library has it; str.split() also cuts at the characters of EXTRA.
SPACE = regex.compile("[\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
EXTRA = regex.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else letters from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A word-level BPE vocabulary from its JSON text.

    Words and tokens are spelled one character a symbol; the symbol that ends a
    word is its letter moved up by ``LAST``, so it differs from the same letter
    inside one.
    """

    LAST = 0x10000

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"] or ""
        vocab = {self._respell(t): i for t, i in model["vocab"].items()}
        merges = [[self._respell(x) for x in (m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.rank = {(vocab[x], vocab[y]): k for k, (x, y) in enumerate(merges)}
        #: For each token that encodes as itself: when it is made, and of what. Tokens of one symbol are there from the start.
        self.made = {i: -1 for t, i in vocab.items() if len(t) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.endings = ahocorasick.Automaton()
        for k, (x, y) in enumerate(merges):
            left, right, token = vocab[x], vocab[y], vocab[x + y]
            if token not in self.made and left in self.made and right in self.made and self._apart(left, right, k):
                self.made[token], self.halves[token] = k, (left, right)
        for t, i in vocab.items():
            if i in self.made:
                self.endings.add_word(t, (i, len(t)))
        self.endings.make_automaton()  # finds the tokens that end at each symbol, longest first
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = _byte_letters()

    def _respell(self, token: str) -> str:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + self.LAST)
        return token

    def spell(self, word: str) -> str:
        body = "".join([self.letters[b] for b in word.encode()])
        return body[:-1] + chr(ord(body[-1]) + self.LAST) if self.end else body

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge before ``limit`` joins symbols of both tokens.

        Goes back in time: of the tokens that face each other now, the one made
        later is undone first; of two equal merges the left one came first.
        """
        while True:
            if self.rank.get((left, right), limit) < limit:
                return False
            a, b = self.made[left], self.made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit = self.halves[left][1], min(limit, a)
            else:
                right, limit = self.halves[right][0], min(limit, b + 1)

    def fits(self, pair: tuple[int, int]) -> bool:
        """Whether the texts of two tokens, put together, encode as these two."""
        if len(self.pairs) > 4 * KEEP:
            self.pairs.clear()
        found = self.pairs[pair] = self._apart(*pair, len(self.rank))
        return found


class Trie:
    """Encodings of words, prefix by prefix; see the module."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.path = ""
        self.states: list[tuple[int, int]] = [(0, -1)]

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Depth first over the trie of ``words``; every word with its ids."""
        v, states, path = self.v, self.states, self.path
        pairs, fits, endings = v.pairs, v.fits, v.endings.iter
        for spelled, word in sorted([(v.spell(w), w) for w in words]):
            shared, most = 0, min(len(path), len(spelled))
            while shared < most and path[shared] == spelled[shared]:
                shared += 1
            del states[shared + 1 :]
            done = shared - 1
            for last, token in endings(spelled):
                if last > done:
                    start = last - token[1]
                    if start < 0:
                        states.append((0, token[0]))
                        done = last
                    else:
                        key = (states[start + 1][1], token[0])
                        if pairs[key] if key in pairs else fits(key):
                            states.append((start + 1, token[0]))
                            done = last
            if len(states) <= len(spelled):
                raise ValueError(f"{word!r} has bytes that are not in the vocabulary")
            path = spelled
            out, at = [], len(spelled)
            while at:
                at, token = states[at]
                out.append(token)
            yield word, out[::-1]
        self.path = path


class Memory:
    """Packed ids by text, in two generations; see the module."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, texts: set[str]) -> list[str]:
        """The texts that are not remembered; the others are in ``new`` from here on."""
        absent = [t for t in texts if t not in self.new]
        if len(self.new) + len(absent) > KEEP:
            self.old, self.new = self.new, {}
            absent = list(texts)
        known = {t: self.old[t] for t in absent if t in self.old}
        self.new.update(known)
        return [t for t in absent if t not in known]


class Codec:
    """Encodes and decodes texts; remembers words, and pieces of text between white space."""

    def __init__(self, source: str):
        self.v = Vocabulary(source)
        self.trie = Trie(self.v)
        self.words, self.packed = Memory(), Memory()

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # one character at a time where str.lower() would look at the neighbours
        text = "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()
        return [text] if text.isascii() and text.isalpha() else self.v.words.findall(text)

    def cut(self, piece: str) -> list[str]:
        """The words of a piece, in order; special tokens stand for themselves."""
        v = self.v
        if v.specials is None or not v.specials.search(piece):
            return self._plain(piece)
        out: list[str] = []
        for part in v.specials.split(piece):
            out += [part] if part in v.special else self._plain(part)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Remember the encodings of new pieces."""
        cut = {p: self.cut(p) for p in self.packed.missing(pieces)}
        fresh = self.words.missing({w for found in cut.values() for w in found})
        words, special = self.words.new, self.v.special
        words.update((w, array("I", [special[w]]).tobytes()) for w in fresh if w in special)
        words.update((w, array("I", ids).tobytes()) for w, ids in self.trie.walk([w for w in fresh if w not in special]))
        self.packed.new.update((p, words[found[0]] if len(found) == 1 else b"".join([words[w] for w in found])) for p, found in cut.items())

    @staticmethod
    def pieces(text: str) -> list[str]:
        return [x for x in SPACE.split(text) if x] if EXTRA.search(text) else text.split()

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces, as of a tokenizer that has no decoder; unknown ids are left out."""
        return " ".join([self.v.names[i] for i in ids if i in self.v.names])

    def batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """For every text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        cut = [self.pieces(t or "") for t in texts]
        self.learn(set().union(*cut))
        packed, names = self.packed.new.__getitem__, self.v.names.__getitem__
        for pieces in cut:
            ids = b"".join(map(packed, pieces))
            yield ids, " ".join(map(names, array("I", ids)))


_codecs: dict[int, Codec] = {}


def _codec(source) -> Codec:
    key = hash(source.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(source.value)
    return _codecs[key]


def _broadcast(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


#: Texts that are encoded together, at most; and about how many characters.
ROWS, CHARACTERS = 512, 1 << 20


def _groups(column: pa.Array) -> Iterator[tuple[int, list]]:
    lo, size, held = 0, 0, []
    for i, text in enumerate(column):
        held.append(text := text.as_py())
        size += len(text or "")
        if len(held) == ROWS or size > CHARACTERS:
            yield lo, held
            lo, size, held = i + 1, 0, []
    if held:
        yield lo, held


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, decoded)`` for every row: ids as packed 32-bit integers, and the text they decode to.

    ``vocabulary`` is the path of a tokenizer file on the driver; its contents,
    a fixed megabyte or two, are broadcast.
    """
    source = _broadcast(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source)
        for batch in batches:
            for lo, texts in _groups(batch.column(1)):
                ids, back = zip(*codec.batch(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["id", "ids", "decoded"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(trimmed(run), "id long, ids binary, decoded string").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` from packed ids (null: empty)."""
    source = _broadcast(tokens, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source)
        for batch in batches:
            out = [codec.decode(list(array("I", x or b""))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    plain = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return plain.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
