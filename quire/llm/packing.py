"""Concatenate and cut: documents become one stream of token ids, cut into windows of fixed length.

Pass 1 tokenizes every whole text once and writes the ids (as 16- or 32-bit integers) with the
document's offset inside its partition. The partitions' token totals, one number each, give every
partition's global offset by a prefix sum. Pass 2 adds the two and cuts each document at the window
borders; a document that crosses a border has a record on both sides. No row moves between
executors and no order is needed in pass 2.

Tokenizer speed: a text is cut at white space first; the vocabulary's pattern never joins characters across white
space, so a text's ids are the ids of its chunks in order. Where characters are plain, the pattern itself cuts chunks into lower-cased
words. Each distinct word is tokenized once a worker and looked up after that; new words of many texts are encoded together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialise, slices, table, worker_tables

LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of each half of a worker's table of words; bytes an entry takes besides its contents.
MAX_BYTES, ENTRY = 48_000_000, 200
#: Characters of texts whose words are looked up at a time.
CHARS = 1_000_000
_CHUNK = re.compile(r"[^ \t\n\r]+").findall
#: Texts of which the vocabulary's normalizing changes nothing but the case, and its pattern over them: white space, ASCII, and letters of Latin-1.
_PLAIN = re.compile(r"[ \t\n\r\x21-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+").findall
#: Kinds of Latin-1 bytes: 0 white space, 1 letters, 2 digits, 3 others; pairs of kinds (4 * first + second) that the pattern cuts apart.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 13, 32]], _KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 256)]], _KIND[48:58] = 0, 1, 2
_APART = np.array([a > 0 and b > 0 and (a != b or a == 2) for a in range(4) for b in range(4)])
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+").fullmatch


class Recent(dict):
    """A table of what was looked up lately: when it has taken in MAX_BYTES it becomes the older half, and what is asked for again moves over.

    make gives one key's value, make_all those of a list of keys."""

    def __init__(self, make, make_all=None):
        super().__init__()
        self.make, self.make_all, self.older, self.size = make, make_all, {}, 0

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self._take({key: got})
        return got

    def _take(self, more: dict[str, bytes]) -> None:
        size = sum(map(len, more)) + sum(map(len, more.values())) + ENTRY * len(more)
        self.size += size
        if self.size > MAX_BYTES:
            self.older = dict(self)
            self.clear()
            self.size = size
        self.update(more)

    def look_up(self, keys: set[str]) -> dict[str, bytes]:
        """The values of many keys; those in neither half are made at once."""
        new = list(keys.difference(self).difference(self.older))
        made = dict(zip(new, self.make_all(new), strict=True))
        old = keys.difference(new)
        out = dict(zip(old, map(self.__getitem__, old), strict=True)) | made
        self._take(made)
        return out


class ChunkTokenizer:
    """ids of whole texts, little-endian, 2 bytes each where the vocabulary allows, through a table of distinct pieces: words of plain chunks, other
    chunks as they are."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer, self.width = tokenizer, 2 if tokenizer.get_vocab_size() <= 65536 else 4
        # words of letters need no normalizing and no pattern; a word's last id is one whose entry ends in the suffix
        self.letters = Tokenizer(tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = tokenizer.model.end_of_word_suffix
        self.last = np.zeros(tokenizer.get_vocab_size(), bool)
        self.last[[i for entry, i in tokenizer.get_vocab().items() if suffix and entry.endswith(suffix)]] = True
        self.known = Recent(lambda piece: self._ids([piece])[0], self._all_ids)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _all_ids(self, pieces: list[str]) -> list[bytes]:
        """ids of each piece; words of letters are encoded as one text and told apart by their last ids."""
        words = list(filter(_LETTERS, pieces))
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, f"<u{self.width}")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):  # a vocabulary that doesn't mark the ends of words
            return self._ids(pieces)
        whole, cuts = ids.tobytes(), (ends * self.width).tolist()
        out = dict(zip(words, map(whole.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True)) if words else {}
        others = [p for p in pieces if p not in out]
        out.update(zip(others, self._ids(others), strict=True))
        return [out[p] for p in pieces]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """ids of each text; the new pieces of some CHARS characters of texts are encoded at a time."""
        for a, b in slices(list(map(len, texts)), CHARS):
            some = [_pieces(t) for t in texts[a:b]]
            known = self.known.look_up(set().union(*some))
            for pieces in some:
                yield b"".join(map(known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def _words(plain: str) -> list[str]:
    """The vocabulary's pattern on plain characters."""
    plain = plain.lower()
    if "'" in plain:
        return _WORD(plain)
    data = np.frombuffer(plain.encode("latin-1"), np.uint8)
    kind = _KIND[data]
    cuts = np.flatnonzero(_APART[kind[:-1] * 4 + kind[1:]]) + 1
    return np.insert(data, cuts, 32).tobytes().decode("latin-1").split()


def _pieces(text: str) -> list[str]:
    """What a text's ids are made of, in order: the words of its plain chunks, and its other chunks."""
    if _PLAIN(text) and "<|" not in text:
        return _words(text)
    # str.split also cuts at these four control characters, which the vocabulary's pattern takes for symbols
    odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    out = []
    for chunk in _CHUNK(text) if odd else text.split():
        if _PLAIN(chunk) and "<|" not in chunk:
            out += _words(chunk)
        else:
            out.append(chunk)
    return out


def _tokenizer(name: str) -> ChunkTokenizer:
    own = worker_tables("packing")
    if name not in own:
        import public_tokenizers

        own[name] = ChunkTokenizer(name if "/" in name else public_tokenizers.path(name))
    return own[name]


def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, local (offset in the partition), doc_tokens, width (bytes an id), ids (little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, offset = TaskContext.get().partitionId(), 0
        t = _tokenizer(tokenizer)
        end = int(end_id).to_bytes(t.width, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                ids = [x + end for x in t.encode_all([x or "" for x in some.column("text").to_pylist()])]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // t.width
                local = offset + np.cumsum(lengths) - lengths
                offset += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(local), pa.array(lengths), pa.array(np.full(len(ids), t.width, np.int32)), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "local", "doc_tokens", "width", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, local long, doc_tokens long, width int, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Null and empty texts are the end id alone. Repeated rows are packed each; other columns are ignored; an empty
    table gives no pieces. Only the last sequence is shorter than length."""
    spark = docs.sparkSession
    written = materialise(tokenize(docs, tokenizer, end_id), "tokens", 1000)
    totals = written.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()  # one row a partition
    base, rows = 0, []
    for r in sorted(totals, key=lambda r: r["part"]):
        rows.append((r["part"], base))
        base += r["n"]
    bases = spark.createDataFrame(rows, "part int, base long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out: list[list] = [[] for _ in range(8)]
                for doc, at, n, width, ids in zip(*(batch.column(c).slice(k, 500).to_pylist() for c in ("doc_id", "at", "doc_tokens", "width", "ids")), strict=True):
                    wide = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                    start = 0
                    while start < n:
                        seq, off = divmod(at + start, length)
                        size = min(length - off, n - start)
                        piece = wide[4 * start : 4 * (start + size)]
                        for column, v in zip(out, (doc, start, size, zlib.crc32(piece), n, seq, off, bytes(piece)), strict=True):
                            column.append(v)
                        start += size
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = written.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local")).alias("at"), "doc_tokens", "width", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
