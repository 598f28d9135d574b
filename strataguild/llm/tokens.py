"""Token ids of a corpus in coded files: encode with a public tokenizer, write, read back."""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataguild.llm import coder
from strataguild.llm.common import checkpoint_folder, raw_text

#: Ids that a row of a file gathers before it is coded; a longer document makes a longer row.
SEGMENT = 1 << 22
END = 1
#: Words and other pieces of text that a worker remembers.
MEMORY = 400_000
#: Bytes of texts that are split at once; a longer text is taken alone.
CHUNK = 1 << 23
_MARK, _MARK_ID = "<|endoftext|>", 49407
#: Letters below U+0250 stay single letters in the tokenizer's normal form, but for the dotted capital I.
_LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_STOPS = string.punctuation
FILE = "part int, segment int, start long, doc_ids array<long>, lengths array<long>, coded binary"


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs from these starts, one run after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """Ids of texts by way of their pieces between ASCII white space.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its pieces.  A piece of
    letters and a trailing run of ASCII stops is two words for the tokenizer and is split into them; A-Z are lower-cased
    first as its normaliser would do.  Every distinct word, run of stops or other piece is encoded once by the library.
    """

    def __init__(self, path: str) -> None:
        # One process a core: more threads in the library would only get in each other's way.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for lower-cased words of letters between spaces, which need no other step.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab()
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for text, i in vocab.items() if text.endswith("</w>")]] = True
        #: What is remembered: words and pieces, all their ids, and where those of each stop (the first number is 0).
        self.known = pa.array([], pa.string())
        self.flat, self.stops = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _encode(self, words: pa.Array, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of lower-cased words of letters, then of other pieces, and the numbers of ids of each.

        Many words go into one call and are told apart by the ids that end a word.  Of the other pieces 64 go into one
        call, with a mark between them that no other piece contains.
        """
        flat, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        starts = [*range(0, len(words), 256), len(words)]
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words), " ").to_pylist()
        for at, found in zip(starts, self.plain.encode_batch_fast(runs, add_special_tokens=False), strict=False):
            ids, n = np.array(found.ids, np.uint16), min(256, len(words) - at)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == n and stops[-1] == len(ids):
                flat.append(ids)
                sizes.append(np.diff(stops, prepend=0))
            else:
                for f in self.tokenizer.encode_batch_fast(words.slice(at, n).to_pylist(), add_special_tokens=False):
                    flat.append(np.array(f.ids, np.uint16))
                    sizes.append(np.array([len(f.ids)]))
        rest: dict[str, np.ndarray] = {}
        odd = [[p] for p in pieces if "<|" in p]
        plain = [p for p in pieces if "<|" not in p]
        runs = [plain[i : i + 64] for i in range(0, len(plain), 64)] + odd
        found = self.tokenizer.encode_batch_fast([f" {_MARK} ".join(run) for run in runs], add_special_tokens=False)
        for run, f in zip(runs, found, strict=True):
            ids = np.array(f.ids, np.uint16)
            if len(run) == 1:
                rest[run[0]] = ids
                continue
            cuts = np.flatnonzero(ids == _MARK_ID).tolist()
            rest.update((p, ids[i + 1 : j]) for p, i, j in zip(run, [-1, *cuts], [*cuts, len(ids)], strict=True))
        flat += [rest[p] for p in pieces]
        sizes.append(np.array([len(rest[p]) for p in pieces], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def _places(self, units: pa.Array, n_words: int) -> np.ndarray:
        """Where the memory holds these distinct units, of which the first are words; new ones are learned."""
        at = pc.index_in(units, value_set=self.known).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        if len(self.known) + len(new) > MEMORY:
            # What these texts use stays.
            used = np.flatnonzero(at >= 0)
            starts = self.stops[at[used]]
            sizes = self.stops[at[used] + 1] - starts
            self.known = units.take(used)
            self.flat, self.stops = self.flat[_spread(starts, sizes)], np.concatenate(([0], np.cumsum(sizes)))
            at[used] = np.arange(len(used))
        words = int(np.searchsorted(new, n_words))
        flat, sizes = self._encode(units.take(new[:words]), units.take(new[words:]).to_pylist())
        at[new] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, units.take(new)])
        self.flat = np.concatenate([self.flat, flat])
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(sizes)])
        return at

    def ids(self, bodies: list[bytes] | pa.Array) -> list[np.ndarray]:
        """Token ids of UTF-8 texts."""
        texts = (bodies if isinstance(bodies, pa.Array) else pa.array(bodies, pa.binary())).cast(pa.string())
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        bounds, found = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        del texts, split
        pieces, codes = found.dictionary, found.indices.to_numpy()
        worded = pc.match_substring_regex(pieces, f"^[{_LETTERS}]+[{re.escape(_STOPS)}]*$")
        whole = pieces.filter(worded)
        cores = pc.ascii_rtrim(whole, characters=_STOPS)
        tailed = pc.not_equal(pc.binary_length(whole), pc.binary_length(cores))
        tails = pc.replace_substring_regex(whole.filter(tailed), f"^[{_LETTERS}]+", "")
        words = pc.utf8_lower(cores).dictionary_encode()
        rest = pa.concat_arrays([tails, pieces.filter(pc.invert(worded))]).dictionary_encode()
        n_words = len(words.dictionary)
        at = self._places(pa.concat_arrays([words.dictionary, rest.dictionary]), n_words)
        # Every piece is one or two units; the last one has no ids.
        worded, tailed = worded.to_numpy(zero_copy_only=False), tailed.to_numpy(zero_copy_only=False)
        units = np.full((len(pieces), 2), len(self.known))
        units[worded, 0] = at[words.indices.to_numpy()]
        places = at[n_words + rest.indices.to_numpy()]
        units[~worded, 0] = places[len(tails) :]
        units[np.flatnonzero(worded)[tailed], 1] = places[: len(tails)]
        sizes = np.append(np.diff(self.stops), 0)[units]
        flat = self.flat[_spread(self.stops[units.ravel()], sizes.ravel())]
        sizes = sizes.sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        out = []
        for i in range(0, len(bounds) - 1, 256):
            own = bounds[i : i + 257]
            some = codes[own[0] : own[-1]]
            ids = flat[_spread(starts[some], sizes[some])]
            ends = np.append(0, np.cumsum(sizes[some]))[own - own[0]].tolist()
            out += [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's pieces for a tokenizer file, kept from task to task."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of up to ``CHUNK`` bytes in this column; longer values stand alone."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and size + n > CHUNK:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def write_ids(docs: DataFrame, path: str, folder: str, segment: int = SEGMENT) -> None:
    """Encode every whole text and write the ids in ascending doc_id order.

    The files are Parquet files of segments, written by Spark so that lost tasks are written again; file order and
    row order are doc_id order.  A segment holds whole documents: their ids and lengths, the place of its first id in
    its part, and the coded blocks of all their token ids, each followed by ``END``.  Rows without doc_id come first;
    rows of one doc_id are ordered by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("body"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, start = TaskContext.get().partitionId(), 0, 0
        docs_, ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal count, start, docs_, ids, size
            values = [[part], [count], [start], [docs_], [[len(x) for x in ids]], [coder.encode(np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)],
                names=["part", "segment", "start", "doc_ids", "lengths", "coded"],
            )
            count, start = count + 1, start + size
            docs_, ids, size = [], [], 0
            return out

        tool = pieces(path)
        end = np.array([END], np.uint16)
        for batch in batches:
            for some in _chunks(batch, 1):
                for doc, own in zip(some.column(0).to_pylist(), tool.ids(some.column(1)), strict=True):
                    if ids and size + len(own) + 1 > segment:
                        yield close()
                    docs_.append(doc)
                    ids.append(np.concatenate((own, end)))
                    size += len(own) + 1
        if ids:
            yield close()

    rows.mapInArrow(run, FILE).write.option("compression", "none").mode("errorifexists").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of written files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it.  A damaged block fails the job.
    """
    files = spark.read.schema(FILE).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["coded"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                if ends[-1] != len(ids):
                    raise ValueError(f"part {row['part']}, segment {row['segment']}: {len(ids)} ids instead of {ends[-1]}")
                plain = ids.astype("<u4")
                crc = [zlib.crc32(plain[e - n : e].tobytes()) for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(crc), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["start"] + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = files.mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sizes = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # One row a part of the files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(sizes, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_ids(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the token ids of ``docs`` to ``folder`` and return what the files say of every document.

    ``path`` is a tokenizer file (by default the public 49k word vocabulary), ``folder`` by default a new one in the
    session's shared checkpoint folder.  Null and empty texts have the end id alone.  Repeated rows are written one by
    one; other columns are ignored; an empty table gives empty files and no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if folder is None:
        folder = f"{checkpoint_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, folder)
    return read_ids(docs.sparkSession, folder)
