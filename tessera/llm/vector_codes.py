"""Compressing vectors to codes of their parts, by Lloyd's rounds that filter over kd-trees.

Vectors become integers, floor(4096 x), and are cut into parts. Once, every
task gathers its rows in blocks of BLOCK vectors and builds a kd-tree over each
part of a block: balanced median splits on the widest side, each node with its
bounding box and the sum of its points. The blocks are written to the shared
folder. A round walks down the trees of every block: an entry of the codebook
that is nowhere in a node's box nearer than the entry nearest to the box's
middle is struck out below that node, and a node with one entry left is
assigned whole, by its cached sum and count. Only at the leaves are points
compared, with the entries left. A task hands on its sums, one row for each
component of an entry; the new entries are floor(sum / count), so they depend
neither on the blocks nor on the order of rows, and a task that is run again
gives the same.

Codebooks (sizes x entries x components, a few KB) go to the driver and travel
with each round's tasks; no vector does. Nothing is shuffled but those sums and
the errors by label, summed before they are joined.

Nulls and odd input: a null vector and one with a null or non-finite component
is dropped. Vectors of each length have codebooks of their own, and a length
that the parts do not divide is cut as evenly as it goes (the contract's tables
have one length). Fewer vectors than entries make smaller codebooks. Entries
start from the smallest vec_ids, ties by the vector, null ids last. Integers
beyond +-limit(length), where a squared distance would no longer fit a long
(|x| about 46,000 at 64 components), count as that limit; sums of errors stop
at the largest long. Repeated rows stay rows; null labels are one label; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, new_folder

SCALE = 4096
#: Vectors in a block, and the fewest points of a leaf.
BLOCK, LEAF = 4096, 16
LARGEST = (1 << 63) - 1


def limit(size: int) -> int:
    """The largest integer component of vectors of this length."""
    return math.isqrt((1 << 61) // (4 * max(1, size)))


def edges_of(size: int, parts: int) -> list[int]:
    return [p * size // parts for p in range(parts + 1)]


def whole(vectors: np.ndarray) -> np.ndarray:
    most = float(limit(vectors.shape[1]))
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -most, most).astype(np.int64)


class Tree:
    """A balanced kd-tree over integer points; level l splits the ordered points into 2**l runs of equal length, give or take one."""

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums
        self.depth = (len(low) + 1).bit_length() - 2

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        m, width = points.shape
        depth = max(0, (m // LEAF).bit_length() - 1) if width else 0
        order = np.arange(m)
        low, high, sums = [], [], []
        for level in range(depth + 1):
            cuts = cls.cuts(m, level)
            held = points[order]
            low.append(np.minimum.reduceat(held, cuts[:-1], axis=0))
            high.append(np.maximum.reduceat(held, cuts[:-1], axis=0))
            sums.append(np.add.reduceat(held, cuts[:-1], axis=0))
            if level < depth:
                node = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                widest = np.argmax(high[-1] - low[-1], axis=1)
                order = order[np.lexsort((held[np.arange(m), widest[node]], node))]
        return cls(points[order], order, np.concatenate(low), np.concatenate(high), np.concatenate(sums))

    @staticmethod
    def cuts(m: int, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1, dtype=np.int64) * m) >> level

    def packed(self) -> bytes:
        out = io.BytesIO()
        for x in (self.points.astype(np.int32), self.order.astype(np.int32), self.low.astype(np.int32), self.high.astype(np.int32), self.sums):
            np.save(out, x, allow_pickle=False)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        held = io.BytesIO(data)
        return cls(*(np.load(held, allow_pickle=False).astype(np.int64) for _ in range(5)))

    def filtered(self, book: np.ndarray):
        """What a codebook's entries win: ([(level, nodes, entry of each)], leaves left, entries left at each leaf)."""
        k = len(book)
        own = (book * book).sum(axis=1)
        won, nodes, left = [], np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        for level in range(self.depth + 1):
            at = (1 << level) - 1 + nodes
            low, high = self.low[at], self.high[at]
            middle = ((2 * book[None] - (low + high)[:, None]) ** 2).sum(axis=2)
            best = np.where(left, middle, LARGEST).argmin(axis=1)
            away = book[None] - book[best][:, None]
            nearest = np.maximum(low[:, None] * away, high[:, None] * away).sum(axis=2)
            least = own[None] - own[best][:, None] - 2 * nearest  # how much farther an entry is than the best one, at least, in the box
            left = left & ((least < 0) | ((least == 0) & (np.arange(k) <= best[:, None])))
            alone = left.sum(axis=1) == 1
            won.append((level, nodes[alone], left[alone].argmax(axis=1)))
            nodes, left = nodes[~alone], left[~alone]
            if not len(nodes):
                break
            if level < self.depth:
                nodes, left = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(left, 2, axis=0)
        return won, nodes, left

    def _compared(self, book: np.ndarray, leaves: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of the leaves left, and the nearest of the entries left for each."""
        cuts = self.cuts(len(self.points), self.depth)
        lengths = cuts[leaves + 1] - cuts[leaves]
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = np.repeat(cuts[leaves], lengths) + within
        far = (book * book).sum(axis=1)[None] - 2 * (self.points[rows] @ book.T)
        return rows, np.where(np.repeat(left, lengths, axis=0), far, LARGEST).argmin(axis=1)

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, sum of components) of the points nearest to each entry."""
        n, sums = np.zeros(len(book), dtype=np.int64), np.zeros(book.shape, dtype=np.int64)
        won, leaves, left = self.filtered(book)
        for level, nodes, entry in won:
            np.add.at(n, entry, np.diff(self.cuts(len(self.points), level))[nodes])
            np.add.at(sums, entry, self.sums[(1 << level) - 1 + nodes])
        rows, entry = self._compared(book, leaves, left)
        np.add.at(n, entry, 1)
        np.add.at(sums, entry, self.points[rows])
        return n, sums

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of every point, in the order the tree was built from."""
        entry = np.empty(len(self.points), dtype=np.int64)
        won, leaves, left = self.filtered(book)
        for level, nodes, of in won:
            cuts = self.cuts(len(self.points), level)
            for node, e in zip(nodes, of, strict=True):
                entry[cuts[node] : cuts[node + 1]] = e
        rows, near = self._compared(book, leaves, left)
        entry[rows] = near
        far = ((self.points - book[entry]) ** 2).sum(axis=1)
        codes, errors = np.empty_like(entry), np.empty_like(far)
        codes[self.order], errors[self.order] = entry, far
        return codes, errors


def _blocks(parts: int):
    """Arrow batches of (vec_id, label, size, embedding) as blocks: (size, ids, labels, trees of the parts)."""

    def block(size, held):
        import pyarrow as pa

        ids, labels, vectors = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        points = whole(np.asarray(vectors.flatten()).reshape(len(ids), size))
        cuts = edges_of(size, parts)
        trees = [Tree.build(points[:, a:b]).packed() for a, b in zip(cuts, cuts[1:])]
        column = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), column(ids), column(labels), column(pa.array(trees, pa.binary()))], names=["size", "ids", "labels", "trees"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(2))
            for size in np.unique(sizes).tolist():
                import pyarrow as pa

                mine = batch.take(pa.array(np.flatnonzero(sizes == size)))
                for at in range(0, len(mine), BLOCK):
                    piece = mine.slice(at, BLOCK)
                    kept = held.setdefault(size, [])
                    kept.append((piece.column(0), piece.column(1), piece.column(3)))
                    if sum(len(x[0]) for x in kept) >= BLOCK:
                        yield block(size, held.pop(size))
        for size, kept in held.items():
            yield block(size, kept)

    return run


def _books(book: np.ndarray, parts: int) -> list[np.ndarray]:
    cuts = edges_of(book.shape[1], parts)
    return [book[:, a:b] for a, b in zip(cuts, cuts[1:])]


def _round(books: dict, parts: int):
    """What a task's blocks give each entry: (size, entry, at, n, total) for each component."""

    def run(batches):
        import pyarrow as pa

        found: dict = {}
        for batch in batches:
            for size, trees in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for p, (tree, book) in enumerate(zip(trees, _books(books[size], parts), strict=True)):
                    n, sums = Tree.unpacked(tree.as_py()).totals(book)
                    before = found.get((size, p), (0, 0))
                    found[size, p] = before[0] + n, before[1] + sums
        for (size, p), (n, sums) in found.items():
            entries, width = sums.shape
            at = edges_of(size, parts)[p] + np.tile(np.arange(width), entries)
            flat = [np.full(len(at), size), np.repeat(np.arange(entries), width), at, np.repeat(n, width), sums.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in flat], names=["size", "entry", "at", "n", "total"])

    return run


def _coded(books: dict, parts: int):
    digests = {size: digest_of(book, parts) for size, book in books.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, size in enumerate(batch.column(0).to_pylist()):
                ids, labels, trees = (batch.column(k)[i].values for k in (1, 2, 3))
                done = [Tree.unpacked(t.as_py()).assigned(b) for t, b in zip(trees, _books(books[size], parts), strict=True)]
                codes = [bytes(row).hex() for row in np.stack([c for c, _ in done], axis=1).astype(np.uint8)]
                error = sum(e for _, e in done)
                sha = pa.array([digests[size]] * len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error, pa.int64()), sha], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


def digest_of(book: np.ndarray, parts: int) -> str:
    """The SHA-256 of a codebook's components, comma-joined, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for part in _books(book, parts) for x in part.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every kept row; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", "label", F.size("embedding").alias("size"), "embedding")
    id_kind, label_kind = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    first = F.row_number().over(Window.partitionBy("size").orderBy(F.col("vec_id").asc_nulls_last(), "embedding"))
    books: dict[int, list] = {}
    for r in kept.withColumn("_first", first).where(F.col("_first") <= entries).orderBy("size", "_first").collect():
        books.setdefault(r["size"], []).append(r["embedding"])
    books = {size: whole(np.array(rows, dtype=np.float64).reshape(len(rows), size)) for size, rows in books.items()}
    folder = new_folder(spark, "kd-blocks")
    kind = f"size int, ids array<{id_kind}>, labels array<{label_kind}>, trees array<binary>"
    kept.mapInArrow(_blocks(parts), kind).write.option("compression", "zstd").parquet(folder)
    blocks = spark.read.schema(kind).parquet(folder)
    for _ in range(rounds if books else 0):
        sums = blocks.select("size", "trees").mapInArrow(_round(books, parts), "size long, entry long, at long, n long, total long")
        news = sums.groupBy("size", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        for r in news.where("n > 0").collect():
            books[r["size"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    coded = blocks.mapInArrow(_coded(books, parts), f"vec_id {id_kind}, label {label_kind}, code string, error long, codebooks_sha256 string")
    held = new_folder(spark, "vector-codes")
    coded.write.parquet(held)
    discard(spark, folder)
    coded = spark.read.schema(coded.schema).parquet(held)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", F.least("_sum", F.lit(LARGEST)).cast("long").alias("label_error"), "codebooks_sha256")


def vector_codes_sql(size: int = 64, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB: the same of `embeddings` of one length that the parts divide, every vector against every entry."""
    width = size // parts
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS MATERIALIZED (SELECT row, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM comps JOIN book{r} USING (pos) GROUP BY row, part, entry),
        near{r} AS MATERIALIZED (SELECT row, part, min(d * {entries} + entry) % {entries} AS entry, min(d) AS d FROM far{r} GROUP BY row, part)""")
        if r < rounds:
            steps.append(f"""sums{r} AS MATERIALIZED (SELECT entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM comps JOIN near{r} USING (row, part) GROUP BY entry, pos),
        book{r + 1} AS MATERIALIZED (SELECT b.entry, b.pos, coalesce((s - ((s % n + n) % n)) // n, b.c) AS c FROM book{r} b LEFT JOIN sums{r} USING (entry, pos))""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        comps AS MATERIALIZED (SELECT row, pos, (pos - 1) // {width} AS part, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT row, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM kept)),
        book0 AS MATERIALIZED (SELECT row - 1 AS entry, pos, x AS c FROM comps WHERE row <= {entries}),
        {", ".join(steps)},
        coded AS (SELECT row, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY row),
        digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY (pos - 1) // {width}, entry, pos)) AS sha FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
        FROM kept JOIN coded USING (row) CROSS JOIN digest"""
