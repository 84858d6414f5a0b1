"""Near-duplicate vectors by cosine: int8 tile products with error bounds, exact checks near the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import bounded_batches, components, stored

THRESHOLD = 0.9
BLOCK_ROWS = 8192
BLOCK_BYTES = 8 << 20
LEVELS = 127
STEP = 1024


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Every vector times the power of two that brings its largest entry below 1, so that no norm under- or overflows."""
    _, exponents = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponents[:, None])


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as whole numbers up to 127 times a scale per vector, and each one's error norm."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scales = np.abs(units).max(axis=1, keepdims=True) / LEVELS
    codes = np.rint(units / scales)
    errors = np.linalg.norm(units - codes * scales, axis=1)
    return codes.astype(np.int8), scales[:, 0], errors


def possible_links(left: tuple, right: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of all pairs whose cosine may reach ``threshold``, a stripe of rows at a time.

    With x = X + e and y = Y + f, the quantised X and Y differ from the unit vectors by known norms:
    |x.y - X.Y| <= |e| + |f| + |e| |f|. Products of int8 codes are sums of whole numbers below 2^24
    for up to 1,040 dimensions, which single precision holds exactly; wider vectors use doubles.
    """
    (codes, scales, errors), (others, other_scales, other_errors) = left, right
    kind = np.float32 if codes.shape[1] * LEVELS**2 < 1 << 24 else np.float64
    columns = np.ascontiguousarray(others.T.astype(kind))
    worst = other_errors.max()
    for low in range(0, len(codes), STEP):
        part = slice(low, low + STEP)
        products = codes[part].astype(kind) @ columns
        # A product is needed if X.Y >= threshold - error; the largest error of all columns gives a
        # cheap first cut, the pair's own error the second. 1e-6 covers the rounding of the bounds.
        least = (threshold - 1e-6 - errors[part] * (1 + worst) - worst) / scales[part]
        products *= other_scales.astype(kind)
        rows, found = np.nonzero(products >= (least * (1 - np.sign(least) * 1e-6))[:, None].astype(kind))
        bound = scales[part][rows] * products[rows, found].astype(np.float64)
        error = errors[part][rows] + other_errors[found] + errors[part][rows] * other_errors[found]
        sure = bound + error >= threshold - 1e-6
        yield rows[sure] + low, found[sure]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs among ``n`` nodes."""
    parent = np.arange(n)
    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        roots = []
        for node in (x, y):
            while parent[node] != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            roots.append(int(node))
        if roots[0] != roots[1]:
            parent[max(roots)] = min(roots)
            kept.append((x, y))
    return kept


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked pairs of rows of two blocks, or of one block with itself, with exact double cosines."""
    same = right is None
    left = scaled(left)
    right = left if same else scaled(right)
    codes, other_codes = quantised(left), quantised(right)
    norms, other_norms = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    for rows, columns in possible_links(codes, other_codes, threshold):
        if same:
            upper = rows < columns
            rows, columns = rows[upper], columns[upper]
        for low in range(0, len(rows), 1 << 16):
            a, b = rows[low : low + (1 << 16)], columns[low : low + (1 << 16)]
            cosines = np.einsum("ij,ij->i", left[a], right[b]) / (norms[a] * other_norms[b])
            linked = cosines >= threshold
            yield a[linked], b[linked]


def _valid(vector: str = "embedding") -> str:
    fine = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return f"{vector} IS NOT NULL AND {fine} AND exists({vector}, x -> x <> 0)"


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """``(block, width, nodes, copies, data)``: distinct vectors of one width, in blocks of bounded rows and bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array([len(vector) for vector in batch.column(1)])
            for width in np.unique(widths):
                places = np.flatnonzero(widths == width)
                fitting = max(1, min(rows, BLOCK_BYTES // (8 * int(width))))
                for low in range(0, len(places), fitting):
                    part = pa.array(places[low : low + fitting])
                    chosen = batch.take(part)
                    data = chosen.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    single = data.astype("<f4")
                    if (single == data).all():  # half the bytes, and nothing is lost
                        data = single
                    nodes = chosen.column(0).to_numpy().astype("<i8")
                    copies = chosen.column(2).to_numpy().astype("<i8")
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([int(nodes.min())]), "width": pa.array([int(width)]),
                            "nodes": pa.array([nodes.tobytes()]), "copies": pa.array([copies.tobytes()]),
                            "data": pa.array([data.tobytes()]),
                        }
                    )

    schema = "block long, width long, nodes binary, copies binary, data binary"
    return vectors.select("node", "embedding", "copies").mapInArrow(pack, schema)


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = "<f8" if len(data) == 8 * rows * width else "<f4"
    return np.frombuffer(data, dtype=kind).reshape(rows, width).astype(np.float64)


def _compare(tiles: DataFrame, threshold: float) -> DataFrame:
    """``(kind, node, other)`` of every tile: 0 a node and the rows it links to, 1 a link of the tile's forest."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks = [
                    (
                        np.frombuffer(row[f"nodes{k}"], dtype="<i8"),
                        np.frombuffer(row[f"copies{k}"], dtype="<i8"),
                        _matrix(row[f"data{k}"], len(row[f"nodes{k}"]) // 8, row["width"]),
                    )
                    for k in ("", "2")
                ]
                (nodes, copies, data), (others, other_copies, other_data) = blocks
                same = row["block"] == row["block2"]
                degree, other_degree = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(others), dtype=np.int64)
                links: list[tuple[int, int]] = []
                shift = 0 if same else len(nodes)
                for a, b in tile_links(data, None if same else other_data, threshold):
                    np.add.at(degree, a, other_copies[b])
                    np.add.at(degree if same else other_degree, b, copies[a])
                    pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
                    a, b = np.concatenate((pairs[:, 0], a)), np.concatenate((pairs[:, 1], b + shift))
                    links = forest(len(nodes) + len(others), a, b)
                every = np.concatenate((nodes, others)) if not same else nodes
                pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
                counted = [(nodes, degree)] if same else [(nodes, degree), (others, other_degree)]
                out = [(0, ids[n > 0], n[n > 0]) for ids, n in counted] + [(1, every[pairs[:, 0]], every[pairs[:, 1]])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(a), kind, dtype=np.int32) for kind, a, _ in out])),
                        pa.array(np.concatenate([a for _, a, _ in out])),
                        pa.array(np.concatenate([b for _, _, b in out])),
                    ],
                    names=["kind", "node", "other"],
                )

    return tiles.mapInArrow(compare, "kind int, node long, other long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector ``(vec_id, embedding)``.

    Two vectors link at a cosine of ``threshold`` or more in double precision. Equal vectors are one
    node with a number of copies. Nodes are packed in blocks, and every pair of blocks is a tile:
    its int8 products with bounds on the quantisation error leave the pairs that may reach the
    threshold, and those are computed again in double precision. A tile hands on a sum per vector
    and a spanning forest of its links, not its pairs. The work grows with the square of the number
    of distinct vectors, and a block is sent to as many tiles as there are blocks.

    Vectors that are null, empty, zero, or hold null or non-finite components, and vectors of unequal
    width, link with nothing. Null ids stay null and count as links of others; a component is named by
    its smallest non-null id. Repeated rows are copies of one another. An empty table gives no rows;
    other columns are ignored.
    """
    bounded_batches(vectors.sparkSession)
    source = vectors.selectExpr("CAST(vec_id AS LONG) AS vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding")
    # 0.0 + x makes minus zero plain zero, so that equal vectors have equal bits.
    usable = source.filter(_valid()).selectExpr("vec_id", "transform(embedding, x -> 0.0D + x) AS embedding")
    groups = usable.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    numbered = groups.select(F.monotonically_increasing_id().alias("node"), "embedding", "first", "copies")
    nodes = stored(numbered, "vector-nodes")
    blocks = stored(_blocks(nodes, block_rows), "vector-blocks")
    names = blocks.select("block", "width")
    pairs = names.join(names.select(F.col("block").alias("block2"), "width"), "width").filter("block <= block2")
    second = blocks.select(
        F.col("block").alias("block2"), F.col("nodes").alias("nodes2"), F.col("copies").alias("copies2"),
        F.col("data").alias("data2"),
    )
    tiles = pairs.select("block", "block2").join(blocks, "block").join(second, "block2")
    found = stored(_compare(tiles, threshold), "vector-links")
    degrees = found.filter("kind = 0").groupBy("node").agg(F.sum("other").alias("near"))
    group = components(found.filter("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.join(degrees, "node", "left").join(group, "node", "left")
    named = named.withColumn("group", F.coalesce("component", "node"))
    # Stored, as a join of two shuffled scans is one that Spark can split at a large group.
    smallest = stored(named.groupBy("group").agg(F.min("first").alias("component_id")), "group-names")
    named = named.join(smallest, "group")
    n_links = F.coalesce("near", F.lit(0)) + F.col("copies") - 1
    result = named.select("embedding", n_links.alias("n_links"), "component_id")
    linked = usable.join(result, "embedding").select("vec_id", "n_links", "component_id")
    alone = source.filter(f"NOT coalesce({_valid()}, false)").select("vec_id", F.lit(0).cast("long"), "vec_id")
    every = linked.union(alone)
    return every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
