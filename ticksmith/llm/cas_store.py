"""Token ids in a content-addressed store.

A rolling hash over the ids decides where chunks end, so equal passages give equal chunks wherever they stand. Each
unique chunk is stored once under its digest. A document is a recipe: the digests of its chunks in order, its length
and the Merkle root over the digests. A manifest holds a Merkle tree over the recipes' roots in document order.

Files under ``path``::

    data/kind=chunk    h, payload          one row for each unique chunk; payload: little-endian ids
    data/kind=recipe   uid, doc_id, ...    recipes as the encoding tasks wrote them
    recipes            recipes in ascending doc_id order, with the file's place (part) in that order
    offsets            part, base          ids before each part
    manifest           level, node, root   Merkle tree of fan-out 256 over the recipes' roots; the last level has one row

Defined results: null text is an empty text, which still has its end id. Rows with equal or null doc_id are documents
of their own, nulls first, rows of equal doc_id in the order of the input's partitions. An empty table gives empty
files. Other columns of the input are ignored.

A chunk that a third of all documents hold is one row after the map-side part of the de-duplication, and reading
moves digests of 20 bytes, never payloads: checksums of chunks are taken where the chunks lie and combined.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticksmith.llm.storage import shared_dir
from ticksmith.llm.tokens import encoder

DIGEST = 20
MIN_IDS, MEAN_BITS, MAX_IDS = 64, 8, 2048
#: Ids that the rolling hash sees; below MIN_IDS, so that it never reaches over a document's start.
WINDOW = 16
FAN_OUT = 256
#: Digests that an encoding task remembers, so as not to give a chunk twice.
SENT = 100_000

_RAW = pa.schema([("kind", pa.string()), ("uid", pa.int64()), ("h", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("hashes", pa.binary()), ("lens", pa.binary()), ("root", pa.binary()), ("payload", pa.binary())])
_RAW_DDL = "kind string, uid long, h binary, doc_id long, n_tokens long, hashes binary, lens binary, root binary, payload binary"
_RECIPE_DDL = "uid long, doc_id long, n_tokens long, hashes binary, lens binary, root binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over ``leaves``; an odd node moves up unpaired."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """Random numbers by id; of the hash, 16 bits are looked at."""
    return np.random.default_rng(0x5EED).integers(0, 2**64, 1 << 16, dtype=np.uint64).astype(np.uint16)


def cut_points(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Chunk ends of each document in the concatenated ``ids``; ``ends``: where documents end."""
    h = _gear()[ids if ids.dtype == np.uint16 else ids & 0xFFFF]
    step = 1
    while step < WINDOW:  # the sum over a window of gear[id] << distance: each step doubles the window
        before = h << np.uint16(step)
        h = h.copy()
        h[step:] += before[:-step]
        step *= 2
    # After 16 shifts the low bits hold the fewest ids; bits 8 to 15 see at least half of the window.
    marks = np.flatnonzero(h >> np.uint16(WINDOW - MEAN_BITS) == 0) + 1
    marks = marks.tolist() + [len(ids) + 1]
    out, m, start = [], 0, 0
    for end in ends.tolist():
        cuts = []
        while end - start > MAX_IDS or (end - start > MIN_IDS and marks[m] < end):
            while marks[m] < start + MIN_IDS:
                m += 1
            cut = min(marks[m], start + MAX_IDS)
            if cut >= end:
                break
            cuts.append(cut)
            start = cut
        cuts.append(end)
        out.append(cuts)
        start = end
    return out


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = enc.dtype.itemsize
        sent: set[bytes] = set()  # digests of chunks that this task has given already
        for batch in batches:
            for piece in _slices(batch):
                uids, doc_ids = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                ids, sizes = enc.flat([t or "" for t in piece.column(2).to_pylist()])
                ids, ends = np.insert(ids, np.cumsum(sizes), end_id), np.cumsum(sizes + 1)
                joined = ids.tobytes()
                if len(sent) > SENT:
                    sent = set()
                chunks: dict[bytes, bytes] = {}
                recipes, start = [], 0
                for uid, doc_id, cuts in zip(uids, doc_ids, cut_points(ids, ends), strict=True):
                    first, hashes, lens = start, [], []
                    for cut in cuts:
                        payload = joined[start * width : cut * width]
                        hashes.append(h := digest(payload))
                        if h not in sent:
                            sent.add(h)
                            chunks[h] = payload
                        lens.append(cut - start)
                        start = cut
                    recipes.append((uid, doc_id, start - first, b"".join(hashes), np.array(lens, "<u4").tobytes(), merkle_root(hashes)))
                n, m = len(recipes), len(chunks)
                uid, doc_id, count, hashes, lens, root = map(list, zip(*recipes, strict=True))
                none = [None] * m
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip((["recipe"] * n + ["chunk"] * m, uid + none, [None] * n + list(chunks), doc_id + none, count + none, hashes + none, lens + none, root + none, [None] * n + list(chunks.values())), _RAW, strict=True)],
                    schema=_RAW,
                )

    return run


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the store; texts are encoded once and their ids shuffled once, by digest."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = rows.mapInArrow(_encode(tokenizer, end_id), _RAW_DDL)
    zstd = {"compression": "zstd"}
    # Tasks give a chunk about once each, so rows are dealt out as they are and sorted once, for all that follows.
    key = ["kind", "h", "uid"]
    raw.repartition(*key).dropDuplicates(key).write.partitionBy("kind").options(**zstd).parquet(f"{path}/data")
    order = ["doc_id", "uid"]
    found = spark.read.schema(_RAW_DDL).parquet(f"{path}/data").where("kind = 'recipe'").select("uid", "doc_id", "n_tokens", "hashes", "lens", "root")
    found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).write.options(**zstd).parquet(f"{path}/recipes")
    # As many rows as recipe files: the one-partition window below them stays small at any size.
    parts = _recipes(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("base_docs")).write.parquet(f"{path}/offsets")
    level, n = _leaves(spark, path), 0
    while True:
        level.write.mode("append").parquet(f"{path}/manifest/level={n}")
        level = spark.read.schema("node long, root string").parquet(f"{path}/manifest/level={n}")
        if level.count() <= 1:
            return
        level, n = _above(level), n + 1


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_RECIPE_DDL}, part int").parquet(f"{path}/recipes")


def ordered_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with ``start`` (ids before the document) and ``place`` (documents before it).

    Each recipe file is one range of doc_id, so the running sums stay within a file.
    """
    within = Window.partitionBy("part").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spark.read.schema("part int, base long, base_docs long").parquet(f"{path}/offsets")
    run = _recipes(spark, path).withColumns({"start": F.coalesce(F.sum("n_tokens").over(within), F.lit(0)), "place": F.count("*").over(within)})
    # A row for each recipe file: a bound that the number of partitions sets.
    return run.join(F.broadcast(offsets), "part").withColumns({"start": F.col("start") + F.col("base"), "place": F.col("place") + F.col("base_docs")}).drop("base", "base_docs", "part")


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    return _above(ordered_recipes(spark, path).select(F.col("place").alias("node"), F.hex("root").alias("root")))


def _above(level: DataFrame) -> DataFrame:
    """The next Merkle level: each node hashes at most FAN_OUT children in order."""
    children = F.array_sort(F.collect_list(F.struct("node", "root")))
    return level.groupBy(F.floor(F.col("node") / FAN_OUT).alias("above")).agg(F.sha2(F.array_join(F.transform(children, lambda x: x["root"]), ""), 256).alias("root")).select(F.col("above").alias("node"), "root")


def verify_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the stored tree follows from the recipes, level by level."""
    level, n = _leaves(spark, path), 0
    while True:
        stored = spark.read.schema("node long, root string").parquet(f"{path}/manifest/level={n}")
        both = level.join(stored.withColumnRenamed("root", "kept"), "node", "full_outer")
        if both.where(~F.col("root").eqNullSafe(F.col("kept"))).limit(1).count() or stored.count() != stored.select("node").distinct().count():
            return False
        if stored.count() <= 1:
            return True
        level, n = _above(stored), n + 1


# --- checksums of concatenated chunks


@lru_cache(maxsize=1)
def _one_zero_byte() -> np.ndarray:
    """What a zero byte does to a crc32 register: the images of its 32 bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return bits


def _apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for k in range(32):
        out ^= np.where((v >> np.uint32(k)) & np.uint32(1), m[k], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _power(k: int) -> np.ndarray:
    """What 2**k zero bytes do."""
    return _one_zero_byte() if k == 0 else _apply(_power(k - 1), _power(k - 1))


@lru_cache(maxsize=8192)
def _shift(n_bytes: int) -> list[list[int]]:
    """Four tables of 256 for the register's bytes."""
    m = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(n_bytes.bit_length()):
        if n_bytes >> k & 1:
            m = _apply(_power(k), m)
    values = np.arange(256, dtype=np.uint32)
    return [_apply(m, values << np.uint32(8 * b)).tolist() for b in range(4)]


def crc32_concat(a: int, b: int, b_bytes: int) -> int:
    """crc32 of two byte strings' concatenation from their own."""
    t = _shift(b_bytes)
    return t[0][a & 255] ^ t[1][a >> 8 & 255] ^ t[2][a >> 16 & 255] ^ t[3][a >> 24] ^ b


def _strings(column: pa.Array) -> list[bytes]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _check_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, payloads = _strings(batch.column(0)), _strings(batch.column(1))
            for h, payload in zip(hs, payloads, strict=True):
                if digest(payload) != h:
                    raise ValueError(f"chunk {h.hex()} doesn't match its digest")
            ids = memoryview(np.frombuffer(b"".join(payloads), f"<u{width}").astype("<u4")).cast("B")
            ends = np.cumsum([len(x) // width * 4 for x in payloads]).tolist()
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64())], names=["h", "crc"])

    return run


_REFERENCE_DDL = "uid long, seq int, h binary, n long, doc_id long, start long, n_tokens long, root binary"


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of a recipe; what holds for the document stands in its first row."""
    names = ["uid", "seq", "h", "n", "doc_id", "start", "n_tokens", "root"]
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = _strings(batch.column(1))
        count = np.array([len(x) // DIGEST for x in hashes], np.int64)
        first = np.cumsum(count) - count
        seq = np.arange(count.sum()) - np.repeat(first, count)
        joined = b"".join(hashes)
        h = pa.array([joined[i : i + DIGEST] for i in range(0, len(joined), DIGEST)], pa.binary())
        owner = np.repeat(np.arange(len(count)), count)
        head = pa.array(owner, mask=seq != 0)
        arrays = [batch.column(0).take(pa.array(owner)), pa.array(seq, pa.int32()), h, pa.array(np.frombuffer(b"".join(_strings(batch.column(2))), "<u4").astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays + [c.take(head) for c in batch.columns[3:]], names=names)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combine each document's chunks in order; rows come sorted by uid, seq and may span batches."""
    head, leaves, crc, n_ids = None, [], 0, 0
    done: list[tuple] = []

    def close() -> None:
        if head is not None:
            if merkle_root(leaves) != head[3] or n_ids != head[2]:
                raise ValueError(f"document {head[0]} can't be rebuilt: its chunks don't match its recipe")
            done.append((*head[:3], crc, len(leaves), head[3].hex()))

    def flush() -> pa.RecordBatch:
        names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "merkle_root"], [pa.int64()] * 5 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 6, kinds, strict=True)], names=names)

    for batch in batches:
        seq, hs, sizes = batch.column(0).to_numpy(), _strings(batch.column(1)), batch.column(2).to_numpy().tolist()
        heads = iter(zip(*(c.filter(pa.array(seq == 0)).to_pylist() for c in batch.columns[3:7]), strict=True))
        crcs = batch.column(7)
        if crcs.null_count:
            raise ValueError(f"chunk {hs[crcs.is_null().index(True).as_py()].hex()} is missing")
        for k, h, n, chunk_crc in zip(seq.tolist(), hs, sizes, crcs.to_numpy().tolist(), strict=True):
            if k == 0:
                close()
                head, leaves, crc, n_ids = next(heads), [], 0, 0
            leaves.append(h)
            crc = crc32_concat(crc, chunk_crc, 4 * n) if k else chunk_crc
            n_ids += n
        yield flush()
        done.clear()
    close()
    yield flush()


def read_digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Each document's place and checksum from the stored chunks, every chunk and Merkle root verified.

    The join on digests has one small row a chunk use; a chunk that many documents share is a skewed key that
    adaptive execution splits.
    """
    chunks = spark.read.schema("h binary, payload binary, kind string").parquet(f"{path}/data").where("kind = 'chunk'").select("h", "payload")
    sums = chunks.mapInArrow(_check_chunks(width), "h binary, crc long")
    refs = ordered_recipes(spark, path).select("uid", "hashes", "lens", "doc_id", "start", "n_tokens", "root").mapInArrow(_references, _REFERENCE_DDL)
    joined = refs.join(sums, "h", "left").repartition("uid").sortWithinPartitions("uid", "seq")
    return joined.select("seq", "h", "n", "doc_id", "start", "n_tokens", "root", "crc").mapInArrow(_rebuild, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long, merkle_root string")


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame | None = None, width: int = 2) -> DataFrame:
    """(uid, doc_id, seq, payload): the stored ids of all documents, or of those in ``doc_ids``, chunk by chunk."""
    recipes = ordered_recipes(spark, path)
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = spark.read.schema("h binary, payload binary, kind string").parquet(f"{path}/data").where("kind = 'chunk'").select("h", "payload")
    refs = recipes.select("uid", "hashes", "lens", "doc_id", "start", "n_tokens", "root").mapInArrow(_references, _REFERENCE_DDL)
    names = refs.select("uid", "seq", "h").join(recipes.select("uid", "doc_id"), "uid")
    return names.join(chunks, "h", "left").select("uid", "doc_id", "seq", "payload")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the store to the shared folder and read every document's digest back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-store")
    write_store(docs, path, tokenizer, end_id)
    if not verify_manifest(spark, path):
        raise ValueError("the manifest doesn't match the recipes")
    return read_digests(spark, path, encoder(tokenizer).dtype.itemsize)
