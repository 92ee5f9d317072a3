"""Media columns by content-defined chunking.

A text's bytes, padded with zeros, are a row of 8-bit samples (the payload). A rolling gear hash over the last 32 samples
cuts it where the hash's upper bits are zero, within a least and a largest chunk size; so an insertion moves only the
cuts near it. Chunks are known by their SHA-256. Digests that occur more than once are found by aggregation, and
such chunks are stored once; documents keep ordered chunk lists. Reading back joins the lists with the shared
chunks, verifies each chunk against its digest, and rebuilds the payload.

A chunk met only once stays in its document's row, so its bytes never cross the network. Writing takes two passes over the
texts: the first tells which digests are shared, the second stores rows and shared chunks at once. How the second pass knows
the shared digests depends on their number, with the same result either way. Up to ``FILTER_BITS`` bits, a Bloom filter sized by
that number is broadcast (what it holds for shared without being so is only stored as a shared chunk). Beyond, each
document's shared digests are joined to its row.

Documents are known by the SHA-256 of their payload: reading back compares the rebuilt payload with it, so a document
never gets another one's samples.

Edge cases. A null text is stored like an empty one: 64 zeros. Texts of any length are chunked in blocks; a single text has to fit
in a worker. Repeated rows share all chunks, and ties between equal texts need no order, as their chunks are the same. Ids may be null
or repeated. An empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, per_row, salted_left, shared_path, use_checkpoints

LEAST, LARGEST, MASK_BITS = 512, 16_384, 12
#: Bits of the filter for each shared digest, places set for one, and the largest filter that is broadcast (16 MB).
BITS_EACH, FILTER_HASHES, FILTER_BITS = 12, 6, 1 << 27
#: Shared chunks that a task remembers to have handed on already.
REMEMBERED = 100_000
_WINDOW = 32


def _gears():
    """256 fixed 32-bit numbers, from SHA-256."""
    import numpy as np

    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


_GEARS = _gears()


def cut_places(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload.

    The gear hash of a place, ``sum of gear[sample] << distance`` modulo 2^32 over the window, is built for all
    places at once by five doublings.
    """
    import numpy as np

    n = len(payload)
    if n <= LEAST:
        return [n]
    samples, step = np.frombuffer(payload, np.uint8), 1 << 22
    found = []
    for at in range(0, n, step):  # blocks overlap by the window
        low = max(0, at - _WINDOW)
        h = _GEARS[samples[low : at + step]]
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k].copy() << np.uint32(k)
        found.append(np.flatnonzero(h[at - low :] >> np.uint32(32 - MASK_BITS) == 0) + at + 1)
    cuts, last = [], 0
    for c in np.concatenate(found).tolist():
        while c - last > LARGEST:
            last += LARGEST
            cuts.append(last)
        if c - last >= LEAST and c < n:
            cuts.append(c)
            last = c
    while n - last > LARGEST:
        last += LARGEST
        cuts.append(last)
    return [*cuts, n]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """``(digest, samples)`` in order."""
    out, last = [], 0
    for c in cut_places(payload):
        part = payload[last:c]
        out.append((hashlib.sha256(part).digest(), part))
        last = c
    return out


def _filter_places(digest: bytes, bits: int) -> list[int]:
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") % bits for k in range(FILTER_HASHES)]


def shared_digests(digests: DataFrame) -> DataFrame:
    """``digest`` of the chunks that occur more than once."""
    return digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


def digest_filter(shared: DataFrame, bits: int) -> bytes:
    """Bloom filter of digests; ``bits / 8`` bytes reach the driver, however many digests there are."""
    words = [F.conv(F.hex(F.substring("digest", 4 * k + 1, 4)), 16, 10).cast("bigint") % bits for k in range(FILTER_HASHES)]
    set_bits = shared.select(F.explode(F.array(*words)).alias("p")).groupBy(F.floor(F.col("p") / 32).cast("int").alias("word"))
    masks = set_bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("mask")).toArrow()
    import numpy as np

    out = np.zeros(bits // 32, "<u4")
    out[masks["word"].to_numpy()] = masks["mask"].to_numpy().astype("<u4")
    return out.tobytes()


class Store:
    """Two tables under one path: documents with their own chunks, and chunks that documents share."""

    def __init__(self, spark: SparkSession, path: str, kind: str) -> None:
        self.spark, self.path, self.kind = spark, path, kind

    def documents(self) -> DataFrame:
        """``doc_id, row_key, n_bytes, digests, samples``: a null entry of samples is a shared chunk. The key is the payload's SHA-256."""
        return self.spark.read.schema(_row_fields(self.kind)).parquet(f"{self.path}/rows")

    def chunks(self) -> DataFrame:
        """``digest, samples``, each digest once."""
        return self.spark.read.parquet(f"{self.path}/chunks")


#: The chunks that a row hands on for all.
_COMMON = "array<struct<digest binary, samples binary>>"


def _row_fields(kind: str) -> str:
    return f"doc_id {kind}, row_key binary, n_bytes bigint, digests array<binary>, samples array<binary>"


def write(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_bits: int = FILTER_BITS) -> Store:
    """Chunk the texts, deduplicate the chunks and store both tables; by default in the shared folder.

    ``most_bits`` bounds the filter that is broadcast; with 0 all goes by the join.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    path = path or shared_path(spark, "media")
    source = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = source.schema["i"].dataType.simpleString()

    def listed(t):
        payload = payload_of(t)[1]
        return hashlib.sha256(payload).digest(), [d for d, _ in chunks_of(payload)]

    lists = per_row(source, ["t"], lambda: listed, "row_key binary, d array<binary>")
    shared = shared_digests(lists.select(F.explode("d").alias("digest"))).checkpoint()
    bits = max(64, 1 << (BITS_EACH * shared.count() - 1).bit_length())
    if bits <= most_bits:
        shipped, marked = spark.sparkContext.broadcast(digest_filter(shared, bits)), source.withColumn("known", F.lit(None).cast("array<binary>"))
    else:
        # Of each text, its shared digests: bounded by its own list. Equal texts are one until they are dealt out by their ids.
        each = salted_left(lists.groupBy("row_key").agg(F.first("d").alias("d")).select("row_key", F.explode("d").alias("digest")), shared.withColumnRenamed("digest", "s"), "digest", "s", F.xxhash64("row_key"))
        known = each.where("s is not null").groupBy("row_key").agg(F.collect_set("digest").alias("known"))
        keyed = per_row(source, ["i", "t"], lambda: lambda i, t: (i, t, hashlib.sha256(payload_of(t)[1]).digest()), f"i {kind}, t string, k binary")
        shipped, marked = None, salted_left(keyed, known, "k", "row_key", F.xxhash64("i")).select("i", "t", F.coalesce("known", F.array().cast("array<binary>")).alias("known"))

    def make():
        filter_, handed = shipped.value if shipped else b"", set()

        def is_shared(digest: bytes, known: set | None) -> bool:
            return digest in known if known is not None else all(filter_[p >> 3] >> (p & 7) & 1 for p in _filter_places(digest, bits))

        def one(i, t, known):
            size, payload = payload_of(t)
            found, known = chunks_of(payload), None if known is None else set(known)
            shared = [is_shared(d, known) for d, _ in found]
            common = {d: x for (d, x), s in zip(found, shared, strict=True) if s and d not in handed}
            if len(handed) > REMEMBERED:
                handed.clear()
            handed.update(common)
            row = (i, hashlib.sha256(payload).digest(), size, [d for d, _ in found], [None if s else x for (_, x), s in zip(found, shared, strict=True)])
            return (*row, [{"digest": d, "samples": x} for d, x in common.items()])

        return one

    rows = per_row(marked, ["i", "t", "known"], make, f"{_row_fields(kind)}, common {_COMMON}")
    rows.write.option("compression", "zstd").parquet(f"{path}/rows")
    chunks = spark.read.schema(f"common {_COMMON}").parquet(f"{path}/rows").select(F.inline("common"))
    chunks.groupBy("digest").agg(F.first("samples").alias("samples")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    return Store(spark, path, kind)


def _measure(doc_id, key, size, digests, samples):
    """Verify the chunks, rebuild the payload and verify it, and measure it and its stored form."""
    import numpy as np

    stored, payload = hashlib.sha256(), bytearray()
    total = 0
    for digest, part in zip(digests, samples, strict=True):
        if part is None or hashlib.sha256(part).digest() != digest:
            raise ValueError(f"a stored chunk of document {doc_id} is missing or damaged")
        head = len(part).to_bytes(4, "little") + digest
        stored.update(head)
        stored.update(part)
        total += len(head) + len(part)
        payload += part
    got = bytes(payload)
    whole = hashlib.sha256(got)
    if whole.digest() != key:
        raise ValueError(f"the stored chunks of document {doc_id} are not its payload")
    counts = np.bincount(np.frombuffer(got, np.uint8), minlength=256)
    share = counts[counts > 0] / len(got)
    nibbles = counts.reshape(16, 16).sum(1)
    feature = f"{len(digests)}:{round(float(-(share * np.log2(share)).sum()), 6)}:" + ",".join(map(str, nibbles.tolist()))
    return doc_id, size, len(got), whole.hexdigest(), zlib.crc32(got[-64:]), total, stored.hexdigest(), feature


FIELDS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read_back(store: Store) -> DataFrame:
    """Rebuild every document's payload from the store: ``doc_id`` and ``FIELDS``.

    Documents that share no chunk are read where they lie. For the others the missing chunks are joined in by digest and
    gathered by document; equal texts are rebuilt once.
    """
    docs = store.documents()
    lacks = F.exists("samples", lambda s: s.isNull())
    whole = per_row(docs.where(~lacks), ["doc_id", "row_key", "n_bytes", "digests", "samples"], lambda: _measure, f"doc_id {store.kind}, {FIELDS}")
    partial = docs.where(lacks)
    texts = partial.groupBy("row_key").agg(F.first(F.struct("n_bytes", "digests", "samples")).alias("r")).select("row_key", "r.*")
    needed = texts.select("row_key", F.explode(F.arrays_zip("digests", "samples")).alias("c")).where("c.samples is null").select("row_key", F.col("c.digests").alias("need")).distinct()
    # A chunk of very many documents is dealt to several tasks; so are the rows of one text.
    met = dealt_join(needed, store.chunks(), "need", "digest", F.xxhash64("row_key"))
    brought = met.groupBy("row_key").agg(F.collect_list(F.struct("need", "samples")).alias("brought")).withColumnRenamed("row_key", "k")

    def rebuild(key, size, digests, samples, brought):
        others = {b["need"]: b["samples"] for b in brought or []}
        return key, *_measure(key.hex(), key, size, digests, [others.get(d) if x is None else x for d, x in zip(digests, samples, strict=True)])[1:]

    filled = texts.join(brought, F.col("row_key") == F.col("k"), "left")
    rebuilt = per_row(filled, ["row_key", "n_bytes", "digests", "samples", "brought"], lambda: rebuild, f"k binary, {FIELDS}")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return whole.union(dealt_join(partial.select("doc_id", "row_key"), rebuilt, "row_key", "k", F.xxhash64("doc_id")).select("doc_id", *names))


def chunk_counts(store: Store) -> DataFrame:
    """``doc_id, n_chunks``: the length of every document's chunk list."""
    return store.documents().select("doc_id", F.size("digests").alias("n_chunks"))
