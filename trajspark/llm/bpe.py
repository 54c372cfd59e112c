"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding by a state machine.

Text arrives in chunks of any size. Whatever a later character could still change is held back:

* between pieces of the tokenizer's pattern, a place where one piece ends whatever follows (white
  space after something else, a change between letters and digits) is stable as soon as it is seen;
* within a piece, a token sequence is the tokenizer's own exactly if each neighbouring pair of its
  tokens encodes to itself. So the last token of every prefix is determined, and the tokens before
  the common ancestor of the last `lookahead` prefixes are stable: a later token starts within the
  longest token's length of the end. `lookahead` is computed from the vocabulary.

Memory is that of a chunk and the lookahead, however long the text is.
"""

import base64
import codecs
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from trajspark.plans.sizes import spread

#: Fixed value: the pattern that cuts a text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the vocabulary file lies by default; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Characters a text is taken in by.
WINDOW = 128

#: The last place where a piece ends whatever follows.
_LAST_STABLE = regex.compile(r"(?r)(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{L}|\p{N})(?=[^\s\p{L}\p{N}])", regex.V1)
_PIECE = regex.compile(PATTERN)
#: Runs of characters that a single piece is made of.
_RUNS = {k: regex.compile(k + "*") for k in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]")}


class Vocabulary:
    """Ranks of the byte strings, the library's encoder, and the sufficient lookahead in bytes."""

    _loaded: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.lookahead = max(map(len, self.ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    @cached_property
    def endings(self) -> frozenset[bytes]:
        """All endings of tokens: a walk back from a place stops where no token ends so."""
        return frozenset(t[i:] for t in self.ranks for i in range(len(t)))

    @classmethod
    def load(cls, path: str = VOCABULARY) -> "Vocabulary":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def reached(self, token: int) -> bool:
        """Whether merging ever makes this token."""
        if token not in self._whole:
            self._whole[token] = self.encoding._encode_single_piece(self.bytes_of[token]) == [token]
        return self._whole[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens stay apart when they meet."""
        k = (a, b)
        if k not in self._pairs:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            self._pairs[k] = self.encoding._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self._pairs[k]


class PieceEncoder:
    """Encodes one piece of unknown length; `feed` returns the tokens that have become stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.held = b""  # bytes since the last stable boundary
        self.last: list[int] = [-1]  # last token of the prefix that ends here, by place in held
        self.before = -1  # token before the boundary

    def feed(self, data: bytes) -> list[int]:
        v = self.v
        start = len(self.held)
        self.held += data
        for end in range(start + 1, len(self.held) + 1):
            best, tokens = None, []
            for n in range(1, min(end, v.lookahead) + 1):
                part = self.held[end - n : end]
                if part not in v.endings:
                    break
                t = v.ranks.get(part)
                if t is not None:
                    tokens.append((n, t))
            for n, t in reversed(tokens):
                if not v.reached(t):
                    continue
                was = self.last[end - n] if end > n else self.before
                if was == -1 or v.fits(was, t):
                    best = t
                    break
            if best is None:
                raise ValueError("the vocabulary does not cover all bytes")
            self.last.append(best)
        return self._stable()

    def _back(self, at: int) -> int:
        return at - len(self.v.bytes_of[self.last[at]])

    def _stable(self) -> list[int]:
        n, look = len(self.held), self.v.lookahead
        if n < 4 * look:
            return []
        ends = set(range(n - look + 1, n + 1))
        while len(ends) > 1:
            far = max(ends)
            ends.discard(far)
            ends.add(self._back(far))
        at = ends.pop()
        out = self._path(at)
        if out:
            self.before = out[-1]
            self.held, self.last = self.held[at:], [-1, *self.last[at + 1 :]]
        return out

    def _path(self, at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(self.last[at])
            at = self._back(at)
        return out[::-1]

    def finish(self) -> list[int]:
        return self._path(len(self.held))


class StreamEncoder:
    """Encodes a text given in chunks; tokens are returned as soon as no later chunk can change them.

    What is held back is what follows the last stable place. Once that is longer than the lookahead,
    it is either several pieces, whose first is complete, or one piece, which is encoded within.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.held = ""
        self.piece: PieceEncoder | None = None
        self.run = ""  # pattern of the running piece's characters

    def feed(self, text: str) -> list[int]:
        self.held += text
        out: list[int] = []
        while self.held:
            if self.piece is not None:
                if self._within(out):
                    break
                continue
            if at := _LAST_STABLE.search(self.held):
                out += self.v.encoding.encode_ordinary(self.held[: at.start()])
                self.held = self.held[at.start() :]
            if len(self.held) <= self.v.lookahead:
                break
            end = _PIECE.match(self.held).end()
            self.piece = PieceEncoder(self.v)
            if end < len(self.held):
                out += self.piece.feed(self.held[:end].encode()) + self.piece.finish()
                self.held, self.piece = self.held[end:], None
            else:
                self.run = next(k for k, r in _RUNS.items() if r.fullmatch(self.held[-1]))
                self._take(len(self.held), out)
                break
        return out

    def _take(self, end: int, out: list[int]) -> None:
        """Hands held[:end] to the running piece; a piece of white space leaves its last character to what follows."""
        end -= self.run == r"\s"
        out += self.piece.feed(self.held[:end].encode())
        self.held = self.held[end:]

    def _within(self, out: list[int]) -> bool:
        """Goes on with the running piece; whether all that is held belongs to it."""
        end = _RUNS[self.run].match(self.held).end()
        more = end == len(self.held)
        self._take(end, out)
        if not more:
            out += self.piece.finish()
            self.piece = None
        return more

    def finish(self) -> list[int]:
        if self.piece is not None:  # what white space holds back belongs to it at the end of a text
            out = self.piece.feed(self.held.encode()) + self.piece.finish()
        else:
            out = self.v.encoding.encode_ordinary(self.held)
        self.held, self.piece = "", None
        return out


def encode_text(text: str | None, vocabulary: Vocabulary, window: int = WINDOW) -> list[int]:
    """The token ids of a text; none for an empty or null one. Marker strings are plain text."""
    s, out = StreamEncoder(vocabulary), []
    for i in range(0, len(text or ""), window):
        out += s.feed(text[i : i + window])
    return out + s.finish()


class StreamDecoder:
    """Token ids back to text: a byte-to-text state machine that holds back unfinished characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.state = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(self.v.bytes_of[i] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


def _map(path: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        kind = pa.list_(pa.int32()) if ids else pa.int64()
        for b in batches:
            tokens = [encode_text(t, v) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens if ids else list(map(len, tokens)), kind)], names=["doc_id", "ids" if ids else "n_tokens"])

    return run


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document; empty and null texts have an empty list."""
    return spread(documents.select("doc_id", "text")).mapInArrow(_map(path, True), "doc_id long, ids array<int>")


def lengths(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document; 0 for empty and null texts."""
    return spread(documents.select("doc_id", "text")).mapInArrow(_map(path, False), "doc_id long, n_tokens long")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); an empty list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                d = StreamDecoder(v)
                texts.append(d.feed(ids or []) + d.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
