"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than one chunk is cut into chunks that overlap. Every chunk is pre-tokenised on its own from its
first character, in parallel; inside an overlap the two scans are stitched at the first boundary that both have.
The pattern looks at nothing before a match, so from a common boundary on the later scan is the scan of the whole
text. A match that ends within a character of the chunk's end may go on beyond it, so such boundaries do not count.
The stitched pieces are then encoded, again in parallel, and put together by position. A text in which some overlap
holds no common boundary (a run of thousands of letters, say) becomes one piece: slower, and the same result.

Texts of one chunk have nothing to stitch and are encoded where they are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.plans.session import cut

CHUNK = 16_384
OVERLAP = 1_024
#: Entries of a worker's table from pre-token to ids; a full table starts anew.
MEMO = 100_000


class Codec:
    """Ranks of one vocabulary: encodes pre-tokens, decodes ids."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.find = regex.compile(pattern)
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.names = [str(i) for i in range(len(self.raw))]
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        """The ids of every match of the pattern, each encoded separately."""
        found, memo = self.find.findall(text), self.memo
        try:
            return list(chain.from_iterable(map(memo.__getitem__, found)))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for token in set(found).difference(memo):
                memo[token] = tuple(self.merge(token))
            return list(chain.from_iterable(map(memo.__getitem__, found)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def boundaries(self, text: str, low: int, high: int) -> list[int]:
        """Ends of matches in [low, high] of a scan from the start of text."""
        return [m.end() for m in self.find.finditer(text) if low <= m.end() <= high]

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        named = ",".join(map(self.names.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(named).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process. The vocabulary file is a parameter: it lies at the same path on every machine."""
    return Codec(ranks_path, pattern)


def chunk_spans(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the chunks of n characters; neighbours share overlap characters."""
    step = chunk - overlap
    return [(at, min(n, at + chunk)) for at in range(0, max(n - overlap, 1), step)]


def stitch(tails: list[np.ndarray], heads: list[np.ndarray]) -> list[int] | None:
    """The cut of each overlap: the first boundary of chunk k that chunk k + 1 has too; None if one has none."""
    cuts = []
    for tail, head in zip(tails, heads, strict=True):
        common = np.intersect1d(tail, head)
        if not len(common):
            return None
        cuts.append(int(common[0]))
    return cuts


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
                     chunk: int = CHUNK, overlap: int = OVERLAP, output: str = "digest") -> DataFrame:
    """One row per row of docs: doc_id with n_tokens, ids_sha256 and decoded_sha256, or with output="ids" the ids and
    the decoded bytes.

    Null texts count as empty ones: no ids, and the digests of nothing. Repeated rows and repeated or null doc_ids are
    encoded each for itself. Further columns are not looked at.
    """
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    ids_out = output == "ids"
    results = "ids array<int>, decoded binary" if ids_out else DIGEST
    result_types = [pa.list_(pa.int32()), pa.binary()] if ids_out else [pa.int64(), pa.string(), pa.string()]
    names = ["ids", "decoded"] if ids_out else ["n_tokens", "ids_sha256", "decoded_sha256"]

    def finish(own: Codec, ids: list[int]) -> tuple:
        return (ids, own.decode(ids)) if ids_out else own.digests(ids)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [finish(own, own.encode(x.as_py())) for x in part.column(1)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), result_types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    short = kept.where(F.length("text") <= chunk).mapInArrow(whole, f"doc_id {id_type}, {results}")

    long = kept.where(F.length("text") > chunk)

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, x in zip(pdf["doc_id"], pdf["text"], strict=True):
                row = hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest()
                spans = chunk_spans(len(x), chunk, overlap)
                for at in range(0, len(spans), 64):
                    part = spans[at : at + 64]
                    yield pd.DataFrame({"doc_id": key, "row": row, "k": range(at, at + len(part)), "n": len(spans), "at": [a for a, _ in part], "part": [x[a:b] for a, b in part]})

    chunks = long.mapInPandas(cut_up, f"doc_id {id_type}, row string, k int, n int, at long, part string")
    # rows that repeat both id and text are the same chunks: encoded once, counted, and put out as often as they came
    times = long.groupBy("doc_id", F.md5("text").alias("row")).agg(F.count("*").alias("times"))
    chunks = chunks.repartition("row", "k").dropDuplicates(["row", "k"]).drop("doc_id")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(ranks_path, pattern)
        for pdf in frames:
            rows = []
            for row, k, n, at, part in zip(pdf["row"], pdf["k"], pdf["n"], pdf["at"], pdf["part"], strict=True):
                ends = np.array([m.end() for m in own.find.finditer(part)], np.int64)
                sure = ends[ends < len(part) - 1] if k < n - 1 else ends
                tail = sure[sure >= len(part) - overlap] + at if k < n - 1 else sure[:0]
                head = np.r_[0, sure[sure <= overlap]] + at if k else sure[:0]
                rows.append((row, k, n, head.tolist(), tail.tolist()))
            yield pd.DataFrame(rows, columns=["row", "k", "n", "head", "tail"])

    # an overlap's two sides meet under (row, number of the overlap); the scan is kept, as both are of it
    sides = cut(chunks.mapInPandas(scan, "row string, k int, n int, head array<long>, tail array<long>"))
    cuts = (
        sides.where("k < n - 1").select("row", "n", F.col("k").alias("seam"), "tail")
        .join(sides.where("k > 0").select("row", (F.col("k") - 1).alias("seam"), "head"), ["row", "seam"])
        .select("row", "n", "seam", F.array_min(F.array_intersect("tail", "head")).alias("cut"))
    )
    good = cuts.groupBy("row").agg((F.count("cut") == F.max("n") - 1).alias("good"))
    bounds = cuts.select("row", F.explode(F.array(
        F.struct(F.col("seam").alias("k"), F.lit(None).cast("long").alias("begin"), F.col("cut").alias("end")),
        F.struct((F.col("seam") + 1).alias("k"), F.col("cut").alias("begin"), F.lit(None).cast("long").alias("end")),
    )).alias("b")).groupBy("row", "b.k").agg(F.max("b.begin").alias("begin"), F.max("b.end").alias("end"))
    pieces = chunks.join(bounds, ["row", "k"]).join(good, "row")
    pieces = pieces.withColumn("piece", F.when(F.col("good"), F.col("k")).otherwise(F.lit(-1)))

    def encode_piece(pdf: pd.DataFrame) -> pd.DataFrame:
        own, pdf = codec(ranks_path, pattern), pdf.sort_values("k")
        first = pdf.iloc[0]
        if first["piece"] < 0:  # some overlap has no common boundary: the chunks are joined again
            x = "".join(p if k == n - 1 else p[: chunk - overlap] for k, n, p in zip(pdf["k"], pdf["n"], pdf["part"], strict=True))
        else:
            begin = 0 if pd.isna(first["begin"]) else int(first["begin"] - first["at"])
            x = first["part"][begin : None if pd.isna(first["end"]) else int(first["end"] - first["at"])]
        return pd.DataFrame({"row": [first["row"]], "k": [int(first["k"])], "ids": [np.array(own.encode(x), "<i4").tobytes()]})

    encoded = pieces.groupBy("row", "piece").applyInPandas(encode_piece, "row string, k int, ids binary")

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        own = codec(ranks_path, pattern)
        ids = np.frombuffer(b"".join(pdf.sort_values("k")["ids"]), "<i4").tolist()
        return pd.DataFrame([(pdf["row"].iloc[0], *finish(own, ids))], columns=["row", *names])

    joined = encoded.groupBy("row").applyInPandas(assemble, f"row string, {results}")
    back = times.join(joined, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return short.unionByName(back.select("doc_id", *names))
