"""Bounded-space online packing of token ids into windows of fixed length.

Every partition keeps a fixed number of open windows. A document goes, whole, to the fullest window that has room for it; where
none has, a new one is opened; where no more may be open, the fullest window is filled up with the document's head and emitted, and
the rest of the document takes its place. At a partition's end its open windows are emptied into each other, so at
most one partly filled window is left. Those are merged by groups of `FAN` partitions, round by round, by the same packer (a group holds
less than FAN windows of tokens); the last one is cut into powers of two, which need no padding. So nothing is padded at all, and
a document is cut only where it is longer than a window or fills one up.

Text is encoded once, in the pass that packs it; ids stay in the worker, except those of the partly filled windows. Text is split at plain
white space first, which the tokenizer drops and never joins over, and each distinct word is encoded once in a while.

Defined results: a null or empty text is a document of the end id alone; every row is packed on its own, also
with a null or repeated doc_id; ties between windows go to the older one; a text of any length takes memory for its own ids; an empty table
gives no pieces; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hexapla.llm.common import cut, give_back

LENGTH, OPEN, END_ID = 2048, 32, 1
FAN = 64
#: Longer words aren't remembered; twice so many others are at most.
WORD_LETTERS, WORDS = 40, 250_000
#: Words of these letters are lower-cased and split alike by Python and by the library, whatever their Unicode versions, and NFC leaves them as they are.
_PLAIN = re.compile(r"[\x21-\x7e\u00a1-\u012f\u0131-\u017f]*")

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("place", pa.int64())])


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: visible ones as themselves, the others as letters from U+0100 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: 256 + k for k, b in enumerate(hidden)}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers, as the tokenizers library gives them without special tokens.

    A word of plain letters goes straight to the library's model, piece by piece, past its normalizer and splitter, which take most of
    its time; others go through the whole library. Words and pieces are remembered for two generations."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # the names of special tokens are text like any other
        self.model, self.letters = self.library.model, _byte_letters()
        kind = json.loads(self.library.to_str())
        steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (kind["normalizer"] or {}).get("normalizers", [])]
        cuts = (kind["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        own = steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and len(cuts) == 2 and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") and level.items() <= cuts[1].items() and not kind["model"].get("dropout")
        self.split = regex.compile(cuts[0]["pattern"]["Regex"]).findall if own else None
        self.bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.known, self.old, self.marks = {"": b""}, {}, {}

    def piece(self, text: str) -> bytes:
        written = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(written)])

    def word(self, word: str) -> bytes:
        if not self.split or not _PLAIN.fullmatch(word):
            return b"".join([self.bytes[i] for i in self.library.encode(word, add_special_tokens=False).ids])
        low = word.lower()
        if low.isalpha():
            if low == word:
                return self.piece(low)
            parts = [low]
        else:
            parts = self.split(low)
        found = []
        for x in parts:
            ids = self.known.get(x) if x.isalpha() else self.marks.get(x)  # a lower-case word is a piece of its own
            if ids is None:
                ids = self.piece(x)
                if len(x) <= WORD_LETTERS:
                    (self.known if x.isalpha() else self.marks)[x] = ids
            found.append(ids)
        return b"".join(found)

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        for gap in "\n\t\r":
            if gap in text:
                text = text.replace(gap, " ")
        words = text.split(" ")
        if len(self.known) > WORDS:
            self.known, self.old = {}, self.known
        if len(self.marks) > WORDS:
            self.marks.clear()
        known, long = self.known, {}
        for w in words:
            if w not in known and w not in long:
                ids = self.old.get(w)
                (known if len(w) <= WORD_LETTERS else long)[w] = self.word(w) if ids is None else ids
        return b"".join([known[w] for w in words] if not long else [known[w] if w in known else long[w] for w in words])


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, whose tasks share what it remembers."""
    return Encoder(path)


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens). `name` numbers the windows it emits."""

    def __init__(self, length: int, most: int, name: int):
        self.length, self.most, self.name = length, most, name
        self.open: list[tuple[int, int, list]] = []  # (room, age, pieces), fullest first
        self.age = self.emitted = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: Iterable[tuple]) -> None:
        at = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.name + self.emitted, at, None))
            at += len(ids) // 4
        self.emitted += 1

    def put(self, doc, start: int, ids: bytes, tokens: int) -> None:
        while len(ids) >= 4 * self.length:
            self.emit([(doc, start, ids[: 4 * self.length], tokens)])
            start, ids = start + self.length, ids[4 * self.length :]
        if not ids:
            return
        n = len(ids) // 4
        k = bisect_left(self.open, (n, -1))
        if k < len(self.open):
            room, age, pieces = self.open.pop(k)
            pieces.append((doc, start, ids, tokens))
            if room == n:
                self.emit(pieces)
            else:
                insort(self.open, (room - n, age, pieces))
            return
        if len(self.open) >= self.most:
            room, _, pieces = self.open.pop(0)
            self.emit([*pieces, (doc, start, ids[: 4 * room], tokens)])
            start, ids, n = start + room, ids[4 * room :], n - room
        self.age += 1
        insort(self.open, (self.length - n, self.age, [(doc, start, ids, tokens)]))

    def close(self) -> list[tuple]:
        """Empties the open windows into each other, the emptiest first; the pieces of the last one."""
        while len(self.open) > 1:
            _, _, pieces = self.open.pop()
            self.most = len(self.open)
            for piece in pieces:
                self.put(*piece)
        return self.open.pop()[2] if self.open else []

    def powers(self, pieces: list[tuple]) -> None:
        """Emits pieces in windows of powers of two, the longest first."""
        left = sum(len(p[2]) for p in pieces) // 4
        queue = list(pieces)
        while left:
            size = room = 1 << left.bit_length() - 1
            own = []
            while room:
                doc, start, ids, tokens = queue.pop(0)
                own.append((doc, start, ids[: 4 * room], tokens))
                if len(ids) > 4 * room:
                    queue.insert(0, (doc, start + room, ids[4 * room :], tokens))
                room -= len(own[-1][2]) // 4
            self.emit(own)
            left -= size


def _table(rows: list[tuple], part: int, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    columns += [[part] * len(rows), range(len(rows))]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, path: str, length: int = LENGTH, most: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `path` is
    a file of the tokenizers library; `most` windows are open in a task. A sequence's number holds its round, its partition and its count."""
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = _ROWS.set(0, pa.field("doc_id", to_arrow_type(kind)))
    spark_schema = PIECE.format(id=kind.simpleString()) + ", ids binary, part long, place long"
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        packer = Packer(length, most, part << 32)
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py()) + end
                packer.put(doc, 0, ids, len(ids) // 4)
            yield from _table(packer.rows, part, schema).to_batches()
            packer.rows = []
        rest = [(doc, start, len(ids) // 4, zlib.crc32(ids), tokens, None, None, ids) for doc, start, ids, tokens in packer.close()]
        yield from _table(packer.rows + rest, part, schema).to_batches()
        give_back()

    # Wide or nested partitions of the source stay as they are: no shuffle carries texts or ids.
    found = cut(docs.select("doc_id", "text").mapInArrow(first, spark_schema))
    done, level = found.where("sequence_id IS NOT NULL"), 0
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1

    def merger(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by([("part", "ascending"), ("place", "ascending")])
            part = table["part"][0].as_py() // FAN
            packer = Packer(length, most, level << 58 | part << 32)
            for row in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                packer.put(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
            rest = packer.close()
            if last:
                packer.powers(rest)
                rest = []
            return _table(packer.rows + [(doc, start, len(ids) // 4, zlib.crc32(ids), tokens, None, None, ids) for doc, start, ids, tokens in rest], part, schema)

        return merge

    while True:
        level, parts = level + 1, -(-parts // FAN)
        group = F.floor(F.col("part") / FAN).alias("of")
        found = cut(found.where("sequence_id IS NULL").groupBy(group).applyInArrow(merger(level, parts == 1), spark_schema))
        done = done.unionByName(found.where("sequence_id IS NOT NULL"))
        if parts == 1:
            return done.drop("ids", "part", "place")
