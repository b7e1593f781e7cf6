"""Token ids in files, as frequency ranks in a byte-aligned code.

Ids are replaced by their rank in the corpus, the most frequent first, so most
need one byte.  A rank takes one to four bytes; two bits for each, four to a byte, say how many,
and these control bytes are kept apart from the data bytes, so a reader
looks up the lengths of four ranks at once and needs no branch per number.

Files are Parquet tables of blocks: a block holds the documents of a range of ids in
ascending order, their lengths, the control bytes and the data bytes.  The ranks
are a table beside them.  Texts are encoded once; ids wait in a table until
the counts of the whole corpus are known.

Null and empty texts have only the end id.  Rows with equal ids stay side by side, ordered by
their tokens.  Null ids come first.  An empty table gives no blocks.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.bpe import byte_symbols
from strandloom.llm.text import Recent

END = 2
PIECE = 200  # documents counted at once
BLOCK = 1 << 18  # ids to a block; one document is never split
STRETCHES, PRETOKENS = 600_000, 300_000  # kept, and at most twice as many
LONGEST = 64  # characters of a key that is kept

#: Bytes of the four numbers that a control byte describes, and their sum.
LENGTHS = np.array([[1 + ((c >> (2 * i)) & 3) for i in range(4)] for c in range(256)], dtype=np.int64)


class ByteBpe:
    """The library behind a memo of stretches of text.

    Between two characters that are not white space, a single space always
    begins a new pre-token, and a single line break is one, so the stretches between these are
    encoded alone.  In most of them the pre-tokens are plain, letters with ASCII marks behind, and go to the
    library's model directly.  All else goes to the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.symbols = byte_symbols()
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.line_break = self._ids("\n")
        self.memo, self.pretokens = Recent(self._stretch, STRETCHES, LONGEST), Recent(self._pretoken, PRETOKENS, LONGEST)

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pretoken(self, pretoken: str) -> bytes:
        """Ids of one pre-token, given by the symbols of its bytes."""
        return array("I", [t.id for t in self.model.tokenize(pretoken)]).tobytes()

    def _simple(self, lead: str, part: str) -> bytes | None:
        """Ids of letters and then ASCII marks behind ``lead``, each a pre-token; None for anything else."""
        word = part.rstrip(punctuation)
        if not word.isalpha():
            return None
        marks = part[len(word):]
        if not word.isascii():
            word = "".join([self.symbols[b] for b in word.encode("utf-8")])
        return self.pretokens[lead + word] + (self.pretokens[marks] if marks else b"")

    def _stretch(self, stretch: str) -> bytes | None:
        """Ids of a stretch and the space or line break before it; None for one that does not stand alone."""
        lead, part = (self.line_break, stretch[1:]) if stretch[:1] == "\n" else (None, stretch)
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        if lead is None:
            ids = self._simple(self.symbols[32], part)
            return self._ids(" " + part) if ids is None else ids
        ids = self._simple("", part)
        return lead + (self._ids(part) if ids is None else ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if first and not first[-1].isspace():
                return self._ids(first) + b"".join(map(self.memo.__getitem__, rest))
        except TypeError:  # white space beside a space or a line break
            pass
        return b"".join([self._ids(s if i == 0 else " " + s) for i, s in enumerate(self.cut(text))])


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[:len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` was given."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8)])
    out = np.zeros(n, dtype=np.uint32)
    starts = ends - lengths
    for i in range(4):
        has = lengths > i
        out[has] |= raw[starts[has] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _narrow(ids: np.ndarray, lengths: list[int]) -> list[bytes]:
    """Ids of documents, one behind the other, in 16 bits where all fit, else in 32; the first byte tells."""
    size = 2 if ids.max() < 1 << 16 else 4
    raw, ends = ids.astype(f"<u{size}").tobytes(), np.cumsum(lengths) * size
    return [bytes([size]) + raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if raw[0] == 2 else "<u4", offset=1)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Rows (id, ids) of all documents, and per task rows (token, n) of what it has counted."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, counts, last = byte_bpe(path).encode, np.zeros(1 << 16, dtype=np.int64), np.uint32(end).tobytes()
        for batch in batches:
            packed = []
            for start in range(0, len(batch), PIECE):
                some = [one(t) + last for t in batch["text"][start:start + PIECE]]
                ids = np.frombuffer(b"".join(some), dtype="<u4")
                found = np.bincount(ids)
                if len(found) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(found), dtype=np.int64)])
                counts[:len(found)] += found
                packed.extend(_narrow(ids, [len(x) // 4 for x in some]))
            yield pd.DataFrame({"id": batch["id"], "ids": packed, "token": None, "n": None})
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"id": pd.NA, "ids": None, "token": seen, "n": counts[seen]}).astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(encode, "id long, ids binary, token long, n long")


def rank_tokens(counted: DataFrame) -> DataFrame:
    """(token, n, rank): one row per token of the vocabulary that occurs, equal counts by token."""
    sums = counted.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.desc("n"), "token")  # bounded by the vocabulary
    return sums.withColumn("rank", F.row_number().over(order) - 1)


def _blocks(ids: DataFrame, ranks: np.ndarray, block: int) -> DataFrame:
    """Blocks of a table that is sorted within its partitions."""
    shared = ids.sparkSession.sparkContext.broadcast(ranks)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, start, held, size = None, 0, [], 0

        def flush() -> pd.DataFrame:
            nonlocal start, held, size
            all_ids = np.concatenate([x for _, x in held])
            control, data = pack(shared.value[all_ids])
            row = {
                "shard": shard, "start": start, "n": len(all_ids), "doc_ids": [[i for i, _ in held]],
                "lengths": [[len(x) for _, x in held]], "control": [control], "data": [data],
            }
            start, held, size = start + len(all_ids), [], 0
            return pd.DataFrame(row).astype({"shard": "Int64"})

        for batch in batches:
            for doc_id, raw in zip(batch["id"], batch["ids"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if shard is None and not held and not start:
                    shard = doc_id if doc_id is not None else pd.NA
                held.append((doc_id, _wide(raw)))
                size += len(held[-1][1])
                if size >= block:
                    yield flush()
        if held:
            yield flush()

    return ids.mapInPandas(
        write, "shard long, start long, n long, doc_ids array<long>, lengths array<long>, control binary, data binary"
    )


def write_files(
    docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
    end: int = END, block: int = BLOCK,
) -> None:
    """Encode ``docs`` and write blocks and ranks under ``folder``, which all executors share."""
    spark = docs.sparkSession
    encode_documents(docs, path, id_col, text_col, end).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    encoded = spark.read.parquet(f"{folder}/encoded")
    rank_tokens(encoded).coalesce(1).write.parquet(f"{folder}/ranks")
    table = spark.read.parquet(f"{folder}/ranks").select("token", "rank").toPandas()  # bounded by the vocabulary
    ranks = np.zeros(int(table["token"].max()) + 1 if len(table) else 1, dtype=np.uint32)
    ranks[table["token"]] = table["rank"]
    ids = encoded.where("ids IS NOT NULL").select("id", "ids")
    ordered = ids.repartitionByRange("id").sortWithinPartitions("id", "ids")
    _blocks(ordered, ranks, block).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document; ids are little-endian unsigned 32-bit integers."""
    table = spark.read.parquet(f"{folder}/ranks").select("token", "rank").toPandas()  # bounded by the vocabulary
    tokens = np.zeros(len(table), dtype="<u4")
    tokens[table["rank"]] = table["token"]
    shared = spark.sparkContext.broadcast(tokens)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row per file, a number that the session sets; files follow each other by their first id
    sizes = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy(F.col("shard").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = blocks.join(F.broadcast(offsets), F.col("shard").eqNullSafe(F.col("_shard"))).select(
        (F.col("offset") + F.col("start")).alias("start"), "n", "doc_ids", "lengths", "control", "data"
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = shared.value[unpack(row.control, row.data, row.n)]
                ends = np.cumsum(row.lengths)
                starts = ends - row.lengths
                yield pd.DataFrame({
                    "id": pd.array([None if pd.isna(i) else int(i) for i in row.doc_ids], dtype="Int64"),
                    "start": row.start + starts, "n_tokens": np.asarray(row.lengths, dtype=np.int64),
                    "ids": [ids[a:b].tobytes() for a, b in zip(starts, ends)],
                })

    return placed.mapInPandas(decode, "id long, start long, n_tokens long, ids binary")


def checksums(documents: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of what ``read_files`` gives."""

    return documents.select("id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def new_folder(spark: SparkSession) -> str:
    """A new folder under the one the cluster shares."""
    from strandloom.queries.registry import scratch

    return f"{scratch(spark)}-tokens-{uuid.uuid4().hex[:8]}"
