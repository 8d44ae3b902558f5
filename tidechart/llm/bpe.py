"""BPE encoding and decoding of whole texts by tries whose branches share their prefixes' encodings.

A text is split at special tokens, then into words by the tokenizer's pattern, and each distinct word is encoded once:
words that a task has not met go into a trie. Its nodes are visited depth first, and each place of a path gets one
state, the last token of the encoding of the bytes up to it. A state follows from earlier ones: of the tokens that
end there, exactly one is the last, the one whose bytes and the state before it are kept apart by the merges. So what
words share is worked out once, and a word's encoding is read backwards from its last state.

The vocabulary comes from a tokenizers file that the driver reads (1.5 MB; more than MAX_FILE is an error) and sends to
the tasks: executors need no copy of it, and the tokenizers library is used in tests only.

Bounds of a task: known words that have not come again are forgotten beyond MEMORY bytes of them, a trie takes in words of TRIE bytes (or one
longer word), and tells of pairs of tokens are forgotten beyond PAIRS. None of these changes a result.

Defined cases: a null text is empty; an empty one has no tokens and decodes to itself; a special token's string in a
text is that token; repeated rows and null ids give a row each; words of any length are encoded whole, 4 bytes a byte
of the longest at a time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.common import table

#: The pattern of byte-level BPE files that ask for it by `use_regex`. A fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_FILE = 64 << 20
MEMORY, TRIE, PAIRS = 32 << 20, 1 << 20, 1 << 19
NEVER = 1 << 62
#: The state before the first byte.
START = (1 << 31) - 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 itself, others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges by rank and special tokens of a byte-level BPE file."""

    def __init__(self, file: str):
        data = json.loads(file)
        model, split = data["model"], data["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and data["normalizer"] is None and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or (data["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("only plain byte-level BPE files are read")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not read")
        letters = alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [tuple(bytes(letters[c] for c in w) for w in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        # by both tokens: the rank of their merge, and the token that it makes
        self.merges = {self.ids[a] << 32 | self.ids[b]: rank << 32 | self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.sizes = {i: len(b) for i, b in self.bytes.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: of adjacent pairs the one of least rank, leftmost first, becomes one token."""
        out, merge = [self.single[b] for b in data], self.merges.get
        while True:
            best, at = NEVER, 0
            for i in range(len(out) - 1):
                own = merge(out[i] << 32 | out[i + 1], NEVER)
                if own < best:
                    best, at = own, i
            if best == NEVER:
                return out
            out[at : at + 2] = [best & 0xFFFFFFFF]


class Trie:
    """Byte strings by their shared prefixes.

    A node is [length, children by next byte, whole string or None, some string through it]: its path from the root is
    that string up to that length, so edges hold no copies.
    """

    def __init__(self):
        self.root = [0, {}, None, b""]

    def insert(self, word: bytes) -> None:
        node, at = self.root, 0
        while at < len(word):
            child = node[1].get(word[at])
            if child is None:
                node[1][word[at]] = [len(word), {}, word, word]
                return
            end, via = child[0], child[3]
            if not word.startswith(via[at:end], at):  # the edge parts where they differ
                end = next((i for i in range(at, min(end, len(word))) if word[i] != via[i]), len(word))
                node[1][word[at]] = child = [end, {via[end]: child}, None, via]
            node, at = child, end
        node[2] = word


class Encoder:
    """The encodings of words, by tries."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0
        self.apart: dict[int, bool] = {}
        # which tokens end at a place hangs on the longest start of a token that ends there; these are numbered as they come up
        self.starts = {t[:i] for t in vocabulary.ids for i in range(1, len(t) + 1)}
        self.numbers: dict[bytes, int] = {b"": 0}
        self.strings: list[bytes] = [b""]
        self.ending: list[list[tuple[int, int]]] = [[]]
        self.moves: dict[int, int] = {}

    def _move(self, at: int, byte: int) -> int:
        """The number of the longest start of a token that ends one byte further on."""
        own = self.strings[at] + bytes([byte])
        while own not in self.starts:
            own = own[1:]
        to = self.numbers.setdefault(own, len(self.strings))
        if to == len(self.strings):
            self.strings.append(own)
            tails = (own[i:] for i in range(len(own)))
            self.ending.append([(len(t), self.v.ids[t]) for t in tails if t in self.v.ids])
        self.moves[at << 8 | byte] = to
        return to

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a and b as they are when they meet (a is START: b at the start)."""
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        both = [b] if a == START else [a, b]
        found = self.apart[a << 32 | b] = self.v.merged(b"".join(self.v.bytes[t] for t in both)) == both
        return found

    def encodings(self, trie: Trie) -> Iterator[tuple[bytes, list[int]]]:
        """Each string of a trie with its tokens. States pass from a node to its children, depth first."""
        # by number of bytes from the root: the last token, and the longest start of a token that ends there
        states, ends = [START], [0]
        move, ending, told, size_of = self.moves.get, self.ending, self.apart.get, self.v.sizes
        stack = [(node, 0) for node in trie.root[1].values()]
        while stack:
            (length, children, word, path), depth = stack.pop()
            del states[depth + 1 :], ends[depth + 1 :]
            at = ends[-1]
            for place in range(depth, length):
                to = move(at << 8 | path[place])
                at = self._move(at, path[place]) if to is None else to
                for size, token in ending[at]:  # the longest first; one of them is the last token
                    left = states[place + 1 - size]
                    apart = told(left << 32 | token)
                    if apart or (apart is None and self._apart(left, token)):
                        break
                states.append(token)
                ends.append(at)
            if word is not None:
                out, place = [], length
                while place:
                    token = states[place]
                    out.append(token)
                    place -= size_of[token]
                yield word, out[::-1]
            stack.extend((child, length) for child in children.values())

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet. Of the words known long ago, those that come again stay known."""
        if self.held > MEMORY // 2:
            self.known, self.before, self.held = {}, self.known, 0
        new = []
        for word in words.difference(self.known):
            tokens = self.before.get(word)
            if tokens is None:
                new.append(word)
            else:
                self._keep(word, tokens)
        new.sort()
        while new:
            trie, size = Trie(), 0
            while new and size < TRIE:
                word = new.pop().encode()
                trie.insert(word)
                size += len(word)
            for word, tokens in self.encodings(trie):
                self._keep(word.decode(), pack(f"<{len(tokens)}I", *tokens))

    def _keep(self, word: str, tokens: bytes) -> None:
        self.known[word] = tokens
        self.held += 200 + len(word) + len(tokens)


@cache
def _codec(file: str) -> Encoder:
    return Encoder(Vocabulary(file))


def encode_texts(encoder: Encoder, texts: list[str]) -> list[bytes]:
    """The tokens of each text, as little-endian unsigned 32-bit integers."""
    import regex

    find = regex.compile(WORDS).findall
    special = sorted(encoder.v.special, key=len, reverse=True)
    at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    split = []
    for text in texts:
        runs = at_special.split(text) if at_special else [text]
        # every second run is a special token
        split.append([(find(run), None) if i % 2 == 0 else ((), encoder.v.special[run]) for i, run in enumerate(runs)])
    encoder.learn({word for runs in split for words, _ in runs for word in words})
    known = encoder.known.__getitem__
    return [b"".join(b"".join(map(known, words)) if token is None else token.to_bytes(4, "little") for words, token in runs) for runs in split]


def _pieces(texts: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of about `chars` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    yield held


def tokenizer_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        file = f.read(MAX_FILE + 1)
    if len(file) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} characters")
    return file


def _decoded(token: dict[int, bytes], ids: bytes) -> str:
    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoder(spark: SparkSession, path: str):
    """A function of a text column: its token ids as binary, 4 bytes each, least byte first."""
    file = spark.sparkContext.broadcast(tokenizer_file(path))

    @F.arrow_udf("binary")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _codec(file.value)
        for texts in columns:
            yield pa.array([ids for piece in _pieces(texts) for ids in encode_texts(own, piece)], pa.binary())

    return encode


def decoder(spark: SparkSession, path: str):
    """A function of a column of such binaries: the text. Bytes that are no UTF-8 become U+FFFD."""
    file = spark.sparkContext.broadcast(tokenizer_file(path))

    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = _codec(file.value).v.bytes
        for ids in columns:
            yield pa.array((_decoded(token, i.as_buffer()) for i in ids), pa.string())

    return decode


def round_trip(spark: SparkSession, path: str):
    """A function of a text column: {ids, text}, its token ids and the text that they decode to, in one worker."""
    file = spark.sparkContext.broadcast(tokenizer_file(path))

    @F.arrow_udf("ids binary, text string")
    def both(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _codec(file.value)
        for texts in columns:
            # a piece at a time: what is gone through is held as Arrow data only
            ids = [pa.array(encode_texts(own, piece), pa.binary()) for piece in _pieces(texts)]
            back = [pa.array((_decoded(own.v.bytes, i.as_buffer()) for i in part), pa.string()) for part in ids]
            yield pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(back)], names=["ids", "text"])

    return both


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every row."""
    encode = encoder(docs.sparkSession, path or default_tokenizer())
    ids = docs.select(F.col(id_col).alias("id"), encode(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))
    return ids.select("id", n_tokens(F.col("ids")).alias("n_tokens"), "ids")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = docs.withColumn("made", round_trip(spark, default_tokenizer())("text")).select("doc_id", "made.*")
    return done.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
