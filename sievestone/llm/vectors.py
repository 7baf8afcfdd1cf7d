"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Vectors are compared only inside a label. Equal vectors are one node with a count. Per label, centres are fitted by spherical k-means on
a bounded sample (SAMPLE rows a label); every vector x is then assigned to its nearest centre c and, as a guest, to every cell whose
centre d fits x.c - x.d <= REACH * |c - d|, where REACH is half of the largest distance of two linked vectors. This loses no link: for
linked x and y at home with c and d the gaps x.c - x.d and y.d - y.c add up to (x - y).(c - d) <= 2 * REACH * |c - d|, so one of the
two is a guest of the other's home. In a cell the home vectors are compared with all others by matrix products over blocks of BLOCK rows,
in double precision. A pair that meets in both home cells counts in the lower one only. One vector per connected group (the smallest
vec_id) is kept.

The number of cells of a label grows with its rows (one for every CELL_ROWS), so cells keep their size; all centres together stay below
CENTRE_VALUES numbers, which bounds what is broadcast. Blocks hand on link counts per vector and a spanning forest, never all pairs.

Edge cases: null, zero or empty vectors, vectors with null or non-finite components and rows with null label link with nothing (n_links 0,
own component); null vec_id: null component, kept true; vectors of different length never link; repeated rows are separate vectors that
link with each other (equal vec_ids are one node).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.shared import components, map_pandas, ship
from sievestone.session import cut_lineage

LEAST, SAMPLE, CELL_ROWS, CENTRE_VALUES, BLOCK, STEPS = 0.93, 4096, 512, 4_000_000, 1024, 8
REACH, ROUNDING, COSINES = (2 * (1 - LEAST)) ** 0.5 / 2, 1e-7, 4_000_000


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k unit centres of the unit rows of x."""
    own = np.random.default_rng(seed)
    centres = x[own.permutation(len(x))[:k]].copy()
    for _ in range(STEPS):
        cell = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        size = np.linalg.norm(total, axis=1)
        full = size > 0
        centres[full] = total[full] / size[full, None]
    return centres


def _fit(cells: dict):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key"])
        x = np.stack(group["embedding"].to_numpy())
        k = min(len(x), cells.get((group["label"].iloc[0], x.shape[1]), 1))
        centres = spherical_kmeans(x / np.linalg.norm(x, axis=1)[:, None], k)
        return pd.DataFrame({"label": group["label"].iloc[0], "width": x.shape[1], "cell": np.arange(len(centres)), "centre": list(centres)})

    return run


def places_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Home cell of every unit row of x, and all cells it is compared in."""
    cos = x @ centres.T
    home = cos.argmax(axis=1)
    own, at = np.unique(home, return_inverse=True)
    apart = np.sqrt(np.maximum(2 - 2 * centres[own] @ centres.T, 0))
    return home, [np.flatnonzero(g).tolist() for g in cos >= cos.max(axis=1)[:, None] - REACH * apart[at] - ROUNDING]


def _assign(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for batch in batches:
            for (label, width), group in batch.groupby(["label", "width"]):
                step = max(1, COSINES // len(centres[label, width]))
                for k in range(0, len(group), step):
                    rows = group.iloc[k:k + step]
                    x = np.stack(rows["embedding"].to_numpy())
                    home, places = places_of(x / np.linalg.norm(x, axis=1)[:, None], centres[label, width])
                    yield pd.DataFrame({"node": rows["node"].to_numpy(), "n": rows["n"].to_numpy(), "label": label, "width": width, "embedding": rows["embedding"].to_numpy(),
                                        "home": home, "places": places})

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Link counts and group roots of a pair of blocks: home rows (side 0) against rows of the cell (side 1)."""
    group = group.sort_values("node")
    x = np.stack(group["embedding"].to_numpy())
    x = x / np.linalg.norm(x, axis=1)[:, None]
    cell, home, side = int(group["cell"].iloc[0]), group["home"].to_numpy(), group["side"].to_numpy()
    node, n = group["node"].to_numpy(), group["n"].to_numpy()
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    i, j = np.nonzero(x[a] @ x[b].T >= LEAST)
    i, j = a[i], b[j]
    both = home[j] == cell  # two home rows meet twice: once each way round
    keep = np.where(both, node[i] < node[j], True)
    i, j = i[keep], j[keep]
    guest = home[j] != cell  # also found in the other home cell, if the home row is a guest there
    places = group["places"].to_numpy()
    again = np.array([g and h < cell and h in places[r] for g, h, r in zip(guest, home[j], i)], bool) if len(i) else np.zeros(0, bool)
    i, j = i[~again], j[~again]
    # a home row is in the block twice, as both sides: count by node
    links = pd.concat([pd.Series(n[j], index=node[i]), pd.Series(n[i], index=node[j])]).groupby(level=0).sum()
    index = pd.Index(np.unique(node))
    at = index.get_indexer(node)
    root = _roots(len(index), at[i], at[j])
    out = pd.DataFrame({"node": index.to_numpy(), "root": index.to_numpy()[root]})
    out["links"] = links.reindex(index, fill_value=0).to_numpy()
    return out[out["links"] > 0]


def near_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows (vec_id, embedding, label)."""
    spark = rows.sparkSession
    ship(spark)
    real = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    real = real.withColumn("sound", sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = real.filter("sound").withColumn("key", F.sha2(F.concat_ws(",", F.transform("embedding", lambda v: (v + 0.0).cast("string"))), 256))
    nodes = good.groupBy("label", "key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")).withColumn("width", F.size("embedding"))
    nodes = cut_lineage(nodes)

    sizes = {(r[0], r[1]): r[2] for r in nodes.groupBy("label", "width").count().toLocalIterator()}
    total = sum(n * w for (_, w), n in sizes.items())
    room = min(1.0, CENTRE_VALUES * CELL_ROWS / max(total, 1))
    cells = {k: max(1, round(-(-n // CELL_ROWS) * room)) for k, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (f"{k[0]}\t{k[1]}", min(1.0, SAMPLE / n))]) if sizes else None
    if not sizes:
        return real.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    picked = nodes.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) <= F.element_at(share, F.concat_ws("\t", "label", "width")) * (1 << 20))
    fitted = picked.groupBy("label", "width").applyInPandas(_fit(cells), "label string, width int, cell int, centre array<double>")
    centres: dict = {}
    for r in fitted.orderBy("label", "width", "cell").toLocalIterator():  # at most CENTRE_VALUES numbers
        centres.setdefault((r[0], r[1]), []).append(r[3])
    shared = spark.sparkContext.broadcast({k: np.array(v) for k, v in centres.items()})

    schema = "node long, n long, label string, width int, embedding array<double>, home int, places array<int>"
    assigned = cut_lineage(map_pandas(nodes.select("node", "n", "label", "width", "embedding"), _assign(shared), schema))
    homes = assigned.groupBy("label", "width", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("homes"))
    placed = assigned.select("node", "n", "label", "width", "home", "places", "embedding", F.explode("places").alias("cell"))
    guests = placed.groupBy("label", "width", "cell").agg(F.count(F.lit(1)).alias("all"))
    counts = homes.join(guests, ["label", "width", "cell"])
    blocks = placed.join(F.broadcast(counts), ["label", "width", "cell"])  # a row a cell, fewer than centres
    n_home, n_all = F.ceil(F.col("homes") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    mine = F.xxhash64("node")
    as_home = F.when(F.col("home") == F.col("cell"), F.transform(F.sequence(F.lit(0), n_all - 1), lambda b: F.struct(F.lit(0).alias("side"), F.pmod(mine, n_home).cast("int").alias("h"), b.alias("g"))))
    as_any = F.transform(F.sequence(F.lit(0), n_home - 1), lambda a: F.struct(F.lit(1).alias("side"), a.alias("h"), F.pmod(mine, n_all).cast("int").alias("g")))
    tasks = blocks.select("node", "n", "label", "width", "home", "places", "embedding", "cell", F.explode(F.concat(F.coalesce(as_home, F.array().cast("array<struct<side:int,h:int,g:int>>")), as_any)).alias("t"))
    tasks = tasks.select("node", "n", "label", "width", "home", "places", "embedding", "cell", "t.side", "t.h", "t.g")
    found = cut_lineage(tasks.groupBy("label", "width", "cell", "h", "g").applyInPandas(_compare, "node long, root long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per = nodes.select("label", "key", "node", "n").join(links, "node", "left").join(label, "node", "left").select(
        "label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = good.select("vec_id", "label", "key").join(per, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = real.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
