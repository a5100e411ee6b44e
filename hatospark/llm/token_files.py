"""Token ids in Parquet files: a list column with dictionary or delta encoding, small pages, page indexes.

The documents are range-sorted by id, encoded, and written one file a partition.  A row holds the id
of its document, the number of its file, the ids written before it in that file, and its ids.  A
reader adds what the files before hold, a table of one row per file, so the place of every id in the
whole corpus is known although no task saw more than its own file.  Because rows ascend by document
and by place, both have narrow ranges per page: a lookup reads the pages that its filter leaves, and
a question about lengths or places reads no ids at all.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from ..functions.checkpoints import new_folder
from ..functions.sequence import total_before

#: The id that ends every document.
END = 2
#: Bytes of a row group and of a page, and rows of a page: what a selective read fetches at least.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 500
#: Chunks that a Python worker keeps the ids of; beyond, it starts anew.
KNOWN_CHUNKS = 600_000

SCHEMA = "doc_id bigint, file int, before bigint, n_tokens bigint, ids array<int>"

#: Bytes of text that are cut and put together at once (a longer text is on its own).
SLICE = 3 << 20
#: A text is cut before blanks, and between a letter and a mark; other blanks forbid it.
CUT, CUTS = "\x01", ((r"([ \t\n\r]+)", r"%s\1"), (r"([A-Za-z])([.,;:!?])", r"\1%s\2"))
OTHER_BLANKS = (
    r"[\x01\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
)
#: A chunk that follows another one: a blank and a word.
_INNER = re.compile(r"[ \t\n\r]+[^ \t\n\r]")


class Encoder:
    """Ids as the library gives them, as little-endian 32-bit numbers.

    A byte-level vocabulary with its usual pattern never joins a blank to what stands before it, nor a
    letter to a mark, so the library's ids of the chunks between are those of the text.  Chunks repeat:
    those of many texts are numbered at once, the library encodes each new one, and the ids of the texts
    are put together from theirs.  Texts with unusual blanks or special strings, and vocabularies of any
    other kind, are encoded as a whole.
    """

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        cutter = spec.get("pre_tokenizer") or {}
        self.by_chunk = (
            spec["model"]["type"] == "BPE"
            and spec.get("normalizer") is None
            and cutter.get("type") == "ByteLevel"
            and not cutter.get("add_prefix_space")
            and cutter.get("use_regex", True)
            and not spec["model"].get("continuing_subword_prefix")
            and not spec["model"].get("end_of_word_suffix")
            and set(ByteLevel.alphabet()) <= set(spec["model"]["vocab"])
        )
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", []) if t["content"]]
        self.uncut = "|".join([OTHER_BLANKS, *special])
        self.n_bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        if self.by_chunk:
            # A letter of a byte-level token stands for one byte.
            for token, i in self.library.get_vocab().items():
                self.n_bytes[i] = len(token)
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that all begin with a blank: encoded as one text, cut by the tokens' lengths."""
        packed = self._whole("".join(chunks))
        ends = np.cumsum(self.n_bytes[np.frombuffer(packed, dtype="<u4")])
        last = np.cumsum([len(c.encode()) for c in chunks])
        cuts = [0, *(4 * np.searchsorted(ends, last) + 4).tolist()]
        return {c: packed[a:b] for c, a, b in zip(chunks, cuts, cuts[1:])}

    def _known(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        parts = list(map(self.known.get, chunks))
        new = [c for c, p in zip(chunks, parts) if p is None]
        if new:
            inner = list(filter(_INNER.match, new))
            found = self._chunks(inner)
            found |= {c: self._whole(c) for c in new if c not in found}
            parts = [found[c] if p is None else p for c, p in zip(chunks, parts)]
            if len(self.known) + len(found) > KNOWN_CHUNKS:
                self.known.clear()
            self.known.update(list(found.items())[:KNOWN_CHUNKS])
        return parts

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        for pattern, replacement in CUTS:
            texts = pc.replace_substring_regex(texts, pattern, replacement % CUT)
        chunks = pc.split_pattern(texts, CUT)
        coded = chunks.flatten().dictionary_encode()
        parts = self._known(coded.dictionary.to_pylist())
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, parts), np.int32, len(parts)) // 4, out=offsets[1:])
        ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
        taken = pa.ListArray.from_arrays(pa.array(offsets), ids).take(coded.indices)
        first = chunks.offsets[0].as_py()
        bounds = taken.offsets.to_numpy()[chunks.offsets.to_numpy() - first]
        return taken.values.to_numpy(), np.diff(bounds).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (no nulls) in a row, and the number of each text's."""
        whole = np.ones(len(texts), bool)
        if self.by_chunk:
            whole = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._cut(texts)
        values, counts = self._cut(texts.filter(pa.array(~whole)))
        cut = iter(np.split(values, np.cumsum(counts)[:-1]) if len(counts) else ())
        each = [
            np.frombuffer(self._whole(t.as_py()), "<i4") if w else next(cut) for t, w in zip(texts, whole)
        ]
        return np.concatenate(each), np.array([len(e) for e in each], np.int64)


@lru_cache(maxsize=1)
def _encoder(name: str) -> Encoder:
    """One encoder for all tasks of a Python worker, from the executor's copy of the file."""
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Encoder(f.read())


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about SLICE bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    cuts = np.flatnonzero(np.diff(sizes // SLICE)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)])


def write_tokens(
    docs: DataFrame,
    path: str,
    folder: str,
    end: int = END,
    id_col: str = "doc_id",
    text: str = "text",
    row_group: int = ROW_GROUP,
    page: int = PAGE,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Write the ids of every text of ``docs``, each followed by ``end``, under a new ``folder``.

    Documents ascend by id; null ids come first, ties go by text hash, and equal rows are
    interchangeable. A null text is empty: its row holds ``end`` only. Other columns are not read.
    Ids of a document are a dictionary-coded list (delta-coded where a dictionary does not pay);
    document ids, places and lengths are delta-coded.
    """
    docs.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    names = ["doc_id", "file", "before", "n_tokens", "ids"]
    # The last key spreads any number of copies under one id; it is the same in a repeated task.
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
        F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"),
    )
    order = ["doc_id", "h", "place"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, before = _encoder(name), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                texts = pc.fill_null(batch.column(1).slice(a, b - a), "")
                values, counts = encoder.encode(texts)
                values = np.insert(values, np.cumsum(counts), end)
                ends = np.cumsum(counts + 1)
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.full(b - a, file, np.int32)),
                    pa.array(before + ends - counts - 1),
                    pa.array(counts + 1),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                before += int(ends[-1])

    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group,
        "parquet.page.size": page,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "compression": "zstd",
    }
    rows.mapInArrow(run, SCHEMA).write.options(**options).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The written rows: doc_id, file, before, n_tokens, ids.

    Filters on ``doc_id`` leave out files, row groups and pages; columns not asked for are not read.
    """
    return spark.read.schema(SCHEMA).parquet(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: its first place in the corpus and its number of ids; reads no ids."""
    sums = read_tokens(spark, folder).groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    placed = total_before(sums, "file", F.col("in_file"), "first")
    return placed.select("file", F.col("first").cast("bigint").alias("first"), "in_file")


def with_start(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` of ``read_tokens`` with ``start``, the ids of all documents before."""
    firsts = files(rows.sparkSession, folder).select("file", "first")
    return rows.join(firsts, "file").withColumn("start", F.col("first") + F.col("before")).drop("first")


def span(spark: SparkSession, folder: str, start: int, length: int) -> DataFrame:
    """The ids at places ``start`` to ``start + length - 1`` of the corpus: one row per document met.

    Columns doc_id, start (of the first id taken), ids. Only files that overlap the span are asked,
    and in them only the rows up to its end.
    """
    last = start + length
    met = files(spark, folder).filter((F.col("first") < last) & (F.col("first") + F.col("in_file") > start))
    rows = read_tokens(spark, folder).join(met.select("file", "first"), "file")
    begin = F.col("first") + F.col("before")
    rows = rows.filter((begin < last) & (begin + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(0), F.lit(start) - begin)
    count = F.least(F.col("n_tokens"), F.lit(last) - begin) - skip
    return rows.select(
        "doc_id", (begin + skip).alias("start"),
        F.slice("ids", (skip + 1).cast("int"), count.cast("int")).alias("ids"),
    )


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<i4"), ids.offsets.to_numpy()
        data = memoryview(values.tobytes())
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        counts = np.diff(ends).astype(np.int64)
        columns = [batch.column(i) for i in range(3)] + [pa.array(counts), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "before", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``, from the files written: doc_id, start, n_tokens, ids_crc32.

    ``n_tokens`` counts the ids in the list, its end included; ``ids_crc32`` is their unsigned CRC-32
    as little-endian 32-bit numbers. Nulls, ties and repeated rows: see ``write_tokens``.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, folder, id_col=id_col, text=text)
    rows = read_tokens(docs.sparkSession, folder).select("doc_id", "file", "before", "ids")
    schema = "doc_id bigint, file int, before bigint, n_tokens bigint, ids_crc32 bigint"
    return with_start(rows.mapInArrow(_checksums, schema), folder).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )
