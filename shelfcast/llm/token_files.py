"""Token-id files: texts as ids of a public tokenizer, in compressed binary files.

Rows are sorted by id in ranges; each task encodes its range and packs the ids
into files of some millions, whole documents in each.  A file is one byte
string in the format below; the files stand in a Parquet folder of the shared
checkpoint folder, one to a row, so that Spark's writer commits them on any
store and a task that is run again replaces its own.

A file, all numbers little-endian:

    "TIDS", version (1 byte), crc32 of the sections (4 bytes)
    sections, each with its length (8 bytes) before it:
      document ids (packed 64-bit), which of them are null (one byte each),
      ids per document (packed 64-bit), the file's distinct ids (packed
      32-bit, ascending), their counts (packed 64-bit), bytes per block
      (packed 32-bit), crc32 of each block's bytes and ids (32-bit), ids per block
    blocks: each BLOCK_IDS ids (the last fewer) by the context-mixing range
      coder, started afresh, against ranks of the distinct ids by falling count

Reading checks the sections' crc32 and, after decoding, that of every block's
bytes followed by its ids as 32-bit numbers.

Words between spaces and line ends are encoded once and looked up after that, in
Arrow arrays; a Python worker remembers them from task to task.  Distinct words that hold no added token go to the
tokenizer together or pass its normaliser, patterns and model in turn.  This gives the ids of the whole text: the tokenizer's patterns
match no white space, and its normaliser works on characters.  A tokenizer
whose pre-tokenizer does match white space needs ``by_word=False``.

Defined results: a null text is empty and has the end id alone; ids are sorted
as longs, null first, rows of equal id by a hash of the text and then by their
place in the input, so each has its own range of the stream; an empty table
gives no file and an empty result.  Other columns are not read.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import if_small, saved
from shelfcast.llm.packing import pack_numbers, unpack_numbers
from shelfcast.llm.token_codec import decode_blocks, encode_blocks

FILE_IDS = 8 << 20       # ids after which a file ends (at a document's end)
BLOCK_IDS = 2048
CHUNK_CHARS = 8 << 20    # bytes of text that are encoded at a time
MEMO_CHARS = 12 << 20    # characters of remembered words per Python worker
_MAGIC, _VERSION = b"TIDS", 2
WORDS_TOGETHER = 200     # words that are encoded in one text
_LETTERS = re.compile("[a-z]+")
#: A run of ASCII signs, no apostrophe, after a letter that stays one letter in lower case.
_MARKED = "[a-zß-öø-ÿ]([!-&(-/:-@\\[-`{-~]+)"
_FILE_BITS = 24          # files per task, in the file's number

FILES = "file long, n_docs long, n_ids long, data binary"
DOCS = "file long, doc_id long, place long, before long, n_tokens long, ids_crc32 long"


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(len(sizes) and ends[-1])


class WordEncoder:
    """The ids of texts, each distinct word encoded once."""

    def __init__(self, tokenizer, by_word: bool = True):
        self.tokenizer, self.by_word = tokenizer, by_word
        self.direct = by_word and self._leaves_letters_alone()
        added = [re.escape(a.content) for a in tokenizer.get_added_tokens_decoder().values()]
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        self.is_end = None                                     # of each id, whether it ends a piece
        if suffix:
            vocabulary = tokenizer.get_vocab()
            self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
            self.is_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.held = re.compile("|".join([r"\s", r"\A\Z", *added]), re.IGNORECASE)
        self._forget()

    def _forget(self) -> None:
        self.stems, self.chars = _Numbers(), 0
        self.starts, self.sizes, self.flat = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _leaves_letters_alone(self) -> bool:
        """Whether the normaliser and the patterns keep a word of a-z as it is, and
        no added token stands in one."""
        word, t = string.ascii_lowercase, self.tokenizer
        return ((t.normalizer is None or t.normalizer.normalize_str(word) == word)
                and t.pre_tokenizer is not None and t.pre_tokenizer.pre_tokenize_str(word) == [(word, (0, len(word)))]
                and t.truncation is None and t.padding is None
                and not any(_LETTERS.fullmatch(a.content.lower()) for a in t.get_added_tokens_decoder().values()))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letter_ids(self, words: list[str], out: list[list[int]], places: list[int]) -> list[int]:
        """Fills the ids of words of letters, many encoded in one text, and returns
        the places that are left.  Such a word has one piece at least, and a piece
        one id that ends it; as many ends as words tell that each word has one."""
        left: list[int] = []
        for i in range(0, len(places), WORDS_TOGETHER):
            part = places[i:i + WORDS_TOGETHER]
            ids = self._ids([" ".join([words[p] for p in part])])[0]
            ends = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
            if len(ends) != len(part):
                left += part
                continue
            at = 0
            for p, end in zip(part, ends):
                out[p] = ids[at:end]
                at = end
        return left

    def _word_ids(self, words: list[str]) -> list[list[int]]:
        """As ``_ids``; words of a-z go to the model, others of letters into texts
        of many, the rest pass the normaliser and the patterns in one string, and
        the model is asked for each distinct piece."""
        if not self.direct:
            return self._ids(words)
        model, plain, held = self.tokenizer.model.tokenize, _LETTERS.fullmatch, self.held.search
        out = [[t.id for t in model(w)] if plain(w) else [] for w in words]
        rest = [i for i, ids in enumerate(out) if not ids]
        if self.is_end is not None:
            lettered = [i for i in rest if words[i].isalpha()]
            rest = [i for i in rest if not words[i].isalpha()] + self._letter_ids(words, out, lettered)
        apart = [i for i in rest if held(words[i])]            # with an added token or white space, or empty
        if apart:
            rest = [i for i in rest if not held(words[i])]
        line = " ".join([words[i] for i in rest])
        if self.tokenizer.normalizer is not None:
            line = self.tokenizer.normalizer.normalize_str(line)
        lengths = [len(w) for w in line.split(" ")]
        if len(lengths) != len(rest):                          # the normaliser made or took spaces
            apart, rest = apart + rest, []
        ends = list(accumulate(lengths, lambda at, n: at + 1 + n))
        memo: dict[str, list[int]] = {}
        at = 0
        for piece, (start, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(line) if rest else ():
            while start >= ends[at]:
                at += 1
            if piece not in memo:
                memo[piece] = [t.id for t in model(piece)]
            out[rest[at]] += memo[piece]
        for i, ids in zip(apart, self._ids([words[i] for i in apart])):
            out[i] = ids
        return out

    @staticmethod
    def _stems(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """ASCII words in lower case; a last run of punctuation and signs after a
        letter apart: both are what the normaliser and the patterns make of them
        (a word with ``<|`` may hold an added token, which is matched before)."""
        free = pc.invert(pc.match_substring(words, "<|"))
        words = pc.if_else(pc.and_(free, pc.string_is_ascii(words)), pc.ascii_lower(words), words)
        marked = pc.and_(free, pc.match_substring_regex(words, _MARKED + "$"))
        parts = pc.extract_regex(words.filter(marked), "(?s)^(?P<stem>.*" + _MARKED.replace("](", "])(?P<mark>") + "$")
        stem, mark = parts.field("stem"), parts.field("mark")
        return (pc.replace_with_mask(words, marked, stem),
                pc.replace_with_mask(pa.array(np.full(len(words), ""), pa.string()), marked, mark))

    def _numbered(self, words: pa.Array) -> np.ndarray:
        """The words' numbers among the stems; ids of new ones are made."""
        coded = words.dictionary_encode()
        known = len(self.stems)
        numbers = np.fromiter(map(self.stems.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)),
                              np.int64, len(coded.dictionary))
        new = list(islice(self.stems, known, None))
        ids = self._word_ids(new)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.chars += sum(map(len, new))
        return numbers[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array | list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with ``end_id`` after it, and how many each has."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.by_word:
            ids = self._ids(texts.to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        else:
            if self.chars > MEMO_CHARS:
                self._forget()
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            words = split.flatten().dictionary_encode()
            pairs = np.stack([self._numbered(part) for part in self._stems(words.dictionary)], 1).ravel()
            size = self.sizes[pairs]
            ids = self.flat[_spans(self.starts[pairs], size)]
            size = size[::2] + size[1::2]                      # of each distinct word
            start = np.cumsum(size) - size
            places = words.indices.to_numpy()
            size = size[places]
            flat = ids[_spans(start[places], size)]
            last = np.cumsum(pc.list_value_length(split).to_numpy())
            sizes = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], last])])
        out = np.empty(len(flat) + len(sizes), np.uint32)
        last = np.cumsum(sizes + 1) - 1
        plain = np.ones(len(out), bool)
        plain[last] = False
        out[plain], out[last] = flat, end_id
        return out, sizes + 1


_latest: list[tuple[tuple[str, bool], WordEncoder]] = []


def _encoder(model: str, by_word: bool) -> WordEncoder:
    """The encoder of a tokenizer's file; a Python worker keeps the latest one,
    with the words it remembers, for its next task."""
    if not _latest or _latest[0][0] != (model, by_word):
        from tokenizers import Tokenizer
        _latest[:] = [((model, by_word), WordEncoder(Tokenizer.from_str(model), by_word))]
    return _latest[0][1]


def _runs(lengths: list[int], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` bytes, one text at least."""
    first, size = 0, 0
    for i, n in enumerate(lengths, 1):
        size += n
        if size >= chars or i == len(lengths):
            yield first, i
            first, size = i, 0


def _block_lengths(n_ids: int, block_ids: int) -> np.ndarray:
    return np.array([block_ids] * (n_ids // block_ids) + [n_ids % block_ids] * (n_ids % block_ids > 0), np.int64)


def _crcs(ids: np.ndarray, lengths: np.ndarray, payloads: list[bytes] | None = None) -> list[int]:
    """crc32 of each run of ids, or of its payload and ids."""
    raw, out, at = memoryview(ids.astype("<u4").tobytes()), [], 0
    first = map(zlib.crc32, payloads) if payloads else [0] * len(lengths)
    for n, crc in zip(lengths.tolist(), first):
        out.append(zlib.crc32(raw[4 * at:4 * (at + n)], crc))
        at += n
    return out


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, their counts, and every id's rank by falling count."""
    if len(ids) and int(ids.max()) < 1 << 22:   # by a table instead of a sort
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int64)
        place[distinct[_by_count(counts[distinct])]] = np.arange(len(distinct))
        return distinct, counts[distinct], place[ids]
    distinct, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.int64)
    rank[_by_count(counts)] = np.arange(len(distinct))
    return distinct, counts, rank[place]


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Places in falling order, so that the coder finds frequent ids close together."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """The documents' ids, one after the other, as a file."""
    distinct, counts, ranks = _ranked(ids)
    blocks = _block_lengths(len(ids), block_ids)
    payloads = encode_blocks(ranks, blocks, counts[_by_count(counts)])
    sections = [pack_numbers(np.array([d or 0 for d in doc_ids], np.int64)),
                bytes(d is None for d in doc_ids),
                pack_numbers(lengths.astype(np.uint64)), pack_numbers(distinct.astype(np.uint32)),
                pack_numbers(counts.astype(np.uint64)), pack_numbers(np.array([len(p) for p in payloads], np.uint32)),
                np.array(_crcs(ids, blocks, payloads), "<u4").tobytes(), struct.pack("<Q", block_ids)]
    head = b"".join(struct.pack("<Q", len(s)) + s for s in sections)
    return b"".join([_MAGIC, struct.pack("<BI", _VERSION, zlib.crc32(head)), head, *payloads])


def read_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a file; raises ValueError
    if it is damaged."""
    if data[:4] != _MAGIC or data[4] != _VERSION:
        raise ValueError("not a token-id file of this version")
    at, sections = 9, []
    for _ in range(8):
        n = int.from_bytes(data[at:at + 8], "little")
        sections.append(data[at + 8:at + 8 + n])
        at += 8 + n
    if zlib.crc32(data[9:at]) != int.from_bytes(data[5:9], "little"):
        raise ValueError("the sections of a token-id file do not match their checksum")
    docs, nulls, lengths, distinct, counts, sizes, crcs, block_ids = sections
    docs = [None if gone else d for d, gone in zip(unpack_numbers(docs, np.int64).tolist(), nulls)]
    lengths = unpack_numbers(lengths, np.uint64).astype(np.int64)
    blocks = _block_lengths(int(lengths.sum()), int.from_bytes(block_ids, "little"))
    payloads = []
    for n in unpack_numbers(sizes, np.uint32).tolist():
        payloads.append(data[at:at + n])
        at += n
    counts = unpack_numbers(counts, np.uint64).astype(np.int64)
    order = _by_count(counts)
    ids = unpack_numbers(distinct, np.uint32)[order][decode_blocks(payloads, blocks, counts[order])]
    if _crcs(ids, blocks, payloads) != np.frombuffer(crcs, "<u4").tolist():
        raise ValueError("a block of a token-id file does not match its checksum")
    return docs, lengths, ids


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS, by_word: bool = True) -> DataFrame:
    """FILES, written to the shared checkpoint folder; ascending file numbers
    hold ascending document ids.  The tokenizer is read on the driver and sent
    to the tasks (some megabytes, whatever the number of rows)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keys = ["doc_id", "__hash", "__place"]
    src = (src.withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
           .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        number = TaskContext.get().partitionId() << _FILE_BITS
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def ended() -> pa.RecordBatch:
            data = file_bytes(names, np.concatenate(lengths), np.concatenate(ids), block_ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([data], pa.binary())], ["file", "n_docs", "n_ids", "data"])

        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).fill_null("")
            for i, j in _runs(pc.binary_length(texts).to_pylist(), min(CHUNK_CHARS, 2 * file_ids)):
                one, sizes = _encoder(model.value, by_word).encode(texts.slice(i, j - i), end_id)
                names += docs[i:j]
                ids.append(one)
                lengths.append(sizes)
                held += len(one)
                if held >= file_ids:
                    yield ended()
                    number, names, lengths, ids, held = number + 1, [], [], [], 0
        if names:
            yield ended()

    return saved(src.mapInArrow(pack, FILES), "token-files")


def file_starts(files: DataFrame) -> DataFrame:
    """``file, file_start``: ids in the files before it.  Sums run within a
    writer's files and, in one task, over one row per writer."""
    files = files.select("file", "n_ids", F.shiftright("file", _FILE_BITS).alias("task"))
    by_task = files.groupBy("task").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("task_start"))
    inside = Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return (files.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(by_task, "task")
            .select("file", (F.col("task_start") + F.col("inside")).alias("file_start")))


def decoded(files: DataFrame) -> DataFrame:
    """DOCS of every file, read back and checked: ``before`` counts the ids
    before a document in its file, ``place`` its documents."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1)):
                docs, lengths, ids = read_bytes(data.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(docs), pa.int64()), pa.array(docs, pa.int64()),
                     pa.array(range(len(docs)), pa.int64()), pa.array(np.cumsum(lengths) - lengths, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(_crcs(ids, lengths), pa.int64())],
                    ["file", "doc_id", "place", "before", "n_tokens", "ids_crc32"])

    return files.select("file", "data").mapInArrow(read, DOCS)


def read_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files alone."""
    starts = if_small(saved(file_starts(files), "token-starts"))
    return decoded(files).join(starts, "file").select(
        "doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
