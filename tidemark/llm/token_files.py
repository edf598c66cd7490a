"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Layout of a folder written by ``write_token_files``, one shard per range of document ids:

* ``<shard>.ids``: token ids, little-endian, 16 bits each if the vocabulary allows, else 32;
* ``<shard>.offsets``: 64-bit offsets into the ids, one more than there are documents;
* ``<shard>.docs``: 64-bit document ids (null: the least 64-bit integer);
* ``manifest``: Parquet, one row per shard with its file stem, counts and ``base``, the
  number of ids in all earlier shards (a prefix sum of the shard totals).

File names carry the attempt that wrote them and only committed attempts reach the
manifest, so a repeated task can't damage a shard; left-over files are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.files import create, mapped
from tidemark.llm.pieces import PieceCache, blocks
from tidemark.llm.registry import once_per_worker, query, table, text_of
from tidemark.session import scratch_dir

END_ID = 2
NO_ID = -(2**63)
BLOCK_BYTES = 8 << 20
#: Encodings a worker keeps from task to task; later words are encoded wherever they occur.
KEPT_WORDS = 400_000
SHARD = "shard int, stem string, width int, n_docs long, n_tokens long"


def tokenizers_encoder(definition: str, width: int, special_as_text: bool = False):
    """Function from pieces to encodings as bytes, by the tokenizers library.

    A piece of letters, with or without a blank before and a comma or full stop behind,
    is one or two matches of the byte-level pattern; its letters go straight to the merge
    model, each distinct word once. Every other piece goes through the whole tokenizer.
    """
    import json
    import os

    import numpy as np

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = special_as_text
    model, dtype = tokenizer.model, np.dtype(f"<u{width}")
    steps = json.loads(definition)
    plain = (
        steps["normalizer"] is None
        and steps["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    )

    # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    # for the characters from 256 on, in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    blank = chr(alphabet[ord(" ")])
    words: dict[str, bytes] = {}

    def whole(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype).tobytes() for e in found]

    marks = dict(zip(",.", whole([",", "."])))

    def encode(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        rest: list[int] = []
        for i, piece in enumerate(pieces):
            word = piece[:-1] if piece[-1:] in marks else piece
            if plain and (word[1:] if word[:1] == " " else word).isalpha():
                ids = words.get(word)
                if ids is None:
                    if word.isascii():
                        spelled = blank + word[1:] if word[0] == " " else word
                    else:
                        spelled = word.encode().decode("latin-1").translate(alphabet)
                    ids = b"".join([t.id.to_bytes(width, "little") for t in model.tokenize(spelled)])
                    if len(words) < KEPT_WORDS:
                        words[word] = ids
                out.append(ids if word is piece else ids + marks[piece[-1]])
            else:
                out.append(b"")
                rest.append(i)
        for i, ids in zip(rest, whole([pieces[i] for i in rest])):
            out[i] = ids
        return out

    return encode


def write_token_files(
    docs: DataFrame,
    path: str,
    definition: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    special_as_text: bool = False,
) -> DataFrame:
    """Encode whole texts in ascending id order into ``path``; returns the manifest.

    ``definition`` is the tokenizer's JSON text. ``end_id`` ends each document; null and
    empty texts consist of it alone. Rows without an id come first; equal ids keep an
    arbitrary order. An empty table gives an empty manifest. Other columns are ignored.
    A special token spelled in a text becomes its id, as the library does by default, or
    stays ordinary text with ``special_as_text``. Added tokens must hold no white space.
    """
    import hashlib
    import json

    spark = docs.sparkSession
    model = json.loads(definition)
    most = max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))])
    if any(re.search(r"\s", t["content"]) for t in model.get("added_tokens", [])):
        raise ValueError("an added token holds white space: texts can't be cut at blanks")
    width = 2 if most < 2**16 else 4
    shared = spark.sparkContext.broadcast(definition)

    key = f"pieces {hashlib.sha256(definition.encode()).hexdigest()} {width} {special_as_text}"

    def write(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        cache, end = None, np.array([end_id], f"<u{width}").tobytes()
        stem, ids, lengths, names = None, None, [], []
        for block in blocks(batches, "text", BLOCK_BYTES):
            if not block.num_rows:
                continue
            if cache is None:
                cache = once_per_worker(key, lambda: PieceCache(tokenizers_encoder(shared.value, width, special_as_text)))
                shard = TaskContext.get().partitionId()
                stem = f"{shard:08d}-{uuid.uuid4().hex}"
                ids = create(f"{path}/{stem}.ids")
            encoded = cache.encode(block.column("text").to_pylist())
            for one in encoded:
                ids.write(one + end)
            lengths.append(np.array([len(e) // width + 1 for e in encoded], np.int64))
            names.append(block.column("id").fill_null(NO_ID).to_numpy())
        if cache is None:
            return
        ids.close()
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(lengths))])
        for kind, values in (("offsets", offsets), ("docs", np.concatenate(names))):
            with create(f"{path}/{stem}.{kind}") as out:
                out.write(values.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "stem": [stem],
                "width": pa.array([width], pa.int32()),
                "n_docs": [len(offsets) - 1],
                "n_tokens": [int(offsets[-1])],
            }
        )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.col("id").asc_nulls_first(), F.col("row")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    spread.mapInArrow(write, SHARD).write.parquet(f"{path}/written")
    # One row per shard, so one task can sum them.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spark.read.schema(SHARD).parquet(f"{path}/written").withColumn(
        "base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    ).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SHARD}, base long").parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids before the document; the checksum covers its ids as little-endian
    32-bit integers. Shards are memory-mapped, so a document costs the pages it lies on.
    """

    def read(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for shard in batch.to_pylist():
                stem = f"{path}/{shard['stem']}"
                ids = mapped(f"{stem}.ids", f"<u{shard['width']}")
                offsets, names = mapped(f"{stem}.offsets", "<i8"), mapped(f"{stem}.docs", "<i8")
                for at in range(0, shard["n_docs"], 4096):
                    cuts = offsets[at : at + 4097]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]
                    own = np.array(names[at : at + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=own == NO_ID),
                            pa.array(np.array(cuts[:-1]) + shard["base"], pa.int64()),
                            pa.array(np.diff(cuts), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    manifest = read_manifest(spark, path)
    shards = max(1, manifest.count())
    return manifest.repartitionByRange(shards, "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


@query()
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token-id files, read back."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    path = scratch_dir(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), path, definition)
    return read_token_files(spark, path)
