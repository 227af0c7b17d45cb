"""Exact token ids and counts of public tokenizers, with the library called once per word form instead of once per text."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovel.llm.common import alone, batches, pick

#: Entries of the younger half of a worker's cache of word forms, and the longest form that is kept (others, such as lines
#: without spaces, are worked out anew): 2 x 400,000 x 64 code points at most. Bounds memory, never changes a result.
CACHE, LONGEST = 400_000, 64

#: Code points that Python and the tokenizer's own pattern may not agree on as white space.
_ODD = b"\x1c\x1d\x1e\x1f\x85\xa0"


class Cache(dict):
    """A mapping that makes what it lacks, in two halves: once the younger is full it becomes the older, and what is used
    again moves back, so frequent words stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """ids, as little-endian unsigned 32-bit bytes, for a lower-casing word tokenizer: each word form is merged once."""

    # The pattern of the vocabulary file, its letters and numbers spelled out for U+0000 to U+00FF.
    LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
    PRE = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        # Bytes as the printable characters that byte-level vocabularies use for them.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words = Cache(self._ids)

    def _ids(self, word: str) -> bytes:
        return array("I", [t.id for t in self.merge(word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode())))]).tobytes()

    def ids(self, text: str) -> bytes:
        """Texts of U+0000 to U+00FF, where normal form and lower case are plain, go word by word; any other text, and any
        that may hold a special token, goes whole through the library."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = b"<|"
        if b"<|" in raw or len(raw.translate(None, _ODD)) != len(raw):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, self.PRE.findall(text.lower())))


def whole_tokens(path: str) -> dict[str, int]:
    """The proof, made once per run on the driver: vocabulary strings that start a word and that the library encodes alone
    as one token. At most the vocabulary's size, 32,000 short strings."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    shown = [p[1:] for i in range(model.get_piece_size()) if (p := model.id_to_piece(i))[:1] == "▁" and len(p) > 1 and "▁" not in p[1:]]
    return {p: 1 for p, ids in zip(shown, model.encode(shown, num_threads=1), strict=True) if len(ids) == 1}


def unsplittable(path: str) -> bool:
    """Whether no vocabulary string holds a word mark after another character, nor a line end: then no merge crosses the
    start of a word or a line, and words can be counted one by one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = model.encode("a") == [i for i in [model.piece_to_id("▁a")]] and model.encode("") == [] and len(model.encode("a  b")) > len(model.encode("a b"))
    return plain and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)


#: Marks that may end a word.
MARKS = ".,"


def marks_apart(path: str) -> bool:
    """Whether no vocabulary string joins a letter and one of MARKS after it: then the marks that end a word count alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return not any(a.isalpha() and b in MARKS for p in pieces for a, b in zip(p, p[1:]))


class WordCounts:
    """Token counts of words that follow a space: first the proven whole tokens, the rest by merging, once per form."""

    def __init__(self, path: str, whole: dict[str, int], by_word: bool, by_mark: bool):
        import sentencepiece

        self.whole, self.by_word, self.by_mark = whole, by_word, by_mark
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.line = len(self.model.encode("\n"))
        self.words, self.starts = Cache(self._word), Cache(self._start)

    def _word(self, word: str) -> int:
        if (n := self.whole.get(word)) is not None:
            return n
        if self.by_mark and (body := word.rstrip(MARKS)) != word and body and body[-1].isalpha():
            return self.words[body] + self.starts[word[len(body) :]]
        return len(self.model.encode(word))

    def _start(self, word: str) -> int:
        """Tokens of a word that no space precedes."""
        if self.by_mark and (body := word.rstrip(MARKS)) != word and body and body[-1].isalpha():
            return self.starts[body] + self.starts[word[len(body) :]]
        return len(self.model.encode("\n" + word)) - self.line

    def count(self, text: str) -> int:
        if not self.by_word or "▁" in text or "  " in text or "\0" in text or text[:1] in ("", " ", "\n") or " \n" in text or "\n " in text or text[-1] == " ":
            return len(self.model.encode(text))  # runs of spaces merge with one another, so such a text goes whole
        lines, get = text.split("\n"), self.words.__getitem__
        n = sum(map(get, lines[0].split(" "))) + len(lines) - 1
        for line in lines[1:]:
            if line:
                first, *words = line.split(" ")
                n += self.starts[first] + sum(map(get, words))
        return n


def loaded(kind, *args):
    """The one that a worker process keeps over its tasks, until another operator or tokenizer takes its place."""
    own = alone((kind, args[0]))
    if not own:
        own["loaded"] = kind(*args)
    return own["loaded"]


def token_pieces(docs: DataFrame, path: str, *, max_len: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as pieces of at most max_len tokens: doc_id, piece, start, length, ids (unsigned 32-bit, little-endian).

    path: a tokenizer file of the tokenizers library, of the lower-casing word kind. A document is its ids, then end_id;
    only longer ones are cut, and only their last piece may be shorter. A null or empty text is end_id alone; a null id is
    carried along; repeated rows each yield their own pieces; no rows yield none; other columns are ignored.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = loaded(WordIds, path), array("I", [end_id]).tobytes()
        for batch in batches(source, 500):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (words.ids(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at : at + 4 * max_len]
                    rows.append((doc, k, at // 4, len(part) // 4, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    own = pick(docs, doc_id=id_col, text=text_col)
    names, kind = ["doc_id", "piece", "start", "length", "ids"], {"string": pa.string(), "int": pa.int32()}.get(own.dtypes[0][1], pa.int64())
    return own.mapInArrow(run, f"doc_id {own.dtypes[0][1]}, piece int, start long, length long, ids binary")


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", extra: list[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text, as the sentencepiece library counts it, and the columns named as extra.

    Null and empty texts have 0 of both; a null id is carried along; repeated rows stay; no rows yield none; other columns are
    ignored.
    """
    whole, by_word, by_mark = whole_tokens(path), unsplittable(path), marks_apart(path)
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate([id_col, text_col, *extra])])
    names = ["c0", "n_bytes", "n_tokens", *own.columns[2:]]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(WordCounts, path, whole, by_word, by_mark)
        for batch in batches(source, 500):
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([words.count(t) if t else 0 for t in texts], pa.int64()), *batch.columns[2:]], names=names)

    rest = "".join(f", {c} {k}" for c, k in own.dtypes[2:])
    return own.mapInArrow(run, f"c0 {own.dtypes[0][1]}, n_bytes long, n_tokens long{rest}").toDF("doc_id", "n_bytes", "n_tokens", *extra)
