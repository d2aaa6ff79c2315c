"""Most similar vectors for every vector: score-aware quantisation, table scans and exact reranking inside bounded regions.

1. Exact copies beyond the k + 1 smallest ids of a crowd are set aside by a narrow count, so a vector shared by a third of all
   rows costs k + 1 rows of search. A set-aside row is answered with what the crowd's smallest id found, and that id itself: other
   vectors of the same direction tie with the crowd's own rows.
2. A group (snapshot) of n rows gets 2 n / region_rows regions: nearest of as many centres, fitted on a bounded sample.
   A row belongs to one region and, as a query, also visits the next ``probes`` regions. A group that needs more than ``FAN``
   regions is first cut into ``FAN`` cells in the same way, and cells again, so no task holds more than ``FAN`` centres and the
   sample for them; at each level a row visits its nearest cell as its own and the next ``probes`` cells as a query. One
   region is one task's work, of bounded size, whatever the size of the group: total work grows in proportion to the rows.
3. In a region vectors are coded with 4 bits per pair of dimensions by codebooks fitted, once and on a bounded sample of all
   vectors, with anisotropic weights: the error
   along the vector counts more than the error across it. The scan sums table entries for all codes of the region (as one
   matrix product of the queries with the decoded codes, the same sums in the order that vector units like); all codes whose
   score may still reach the k-th best similarity found, by the measured code error, are reranked in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.winners import hash_sample
from treeloom.session import broadcast_if_small, materialize

#: Rows of a region, and of the sample that fits the codebooks; both bound a task's memory.
REGION_ROWS, SAMPLE, PROBES = 16_384, 4_096, 3
#: Centres fitted at once, each on 64 rows: 32,768 rows and 8 MB of products at a time in one task. Rows that meet centres in one task.
FAN, MEET = 512, 65_536
#: How much an error along the vector outweighs one across it, from a threshold of 0.2 in 64 dimensions; margin in code errors.
PARALLEL_WEIGHT, MARGIN = 4.0, 5.0


def fit_codebooks(x: np.ndarray, sub: int = 2, words: int = 16, rounds: int = 8, weight: float = PARALLEL_WEIGHT, seed: int = 7) -> np.ndarray:
    """(dims / sub, words, sub) codebooks for unit vectors under the anisotropic loss, by alternating coordinate descent.

    The loss of a vector with residual r is |r|^2 + (weight - 1) <r, x>^2. Sub-spaces are updated in turn, each with the
    parallel error that the others leave; the word update solves the weighted normal equations of its members.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    m = d // sub
    parts = x.reshape(n, m, sub)
    books = np.empty((m, words, sub))
    codes = np.empty((n, m), np.int64)
    for s in range(m):
        books[s] = parts[rng.choice(n, words, replace=n < words), s]
        for _ in range(4):
            codes[:, s] = ((parts[:, s, None] - books[s]) ** 2).sum(2).argmin(1)
            for w in range(words):
                if (codes[:, s] == w).any():
                    books[s, w] = parts[codes[:, s] == w, s].mean(0)
    along = np.einsum("nms,nms->nm", parts - books[np.arange(m), codes], parts)
    for _ in range(rounds):
        for s in range(m):
            p = parts[:, s]
            rest = along.sum(1) - along[:, s]
            r = p[:, None] - books[s]
            a = np.einsum("nws,ns->nw", r, p)
            codes[:, s] = ((r**2).sum(2) + (weight - 1) * (rest[:, None] + a) ** 2).argmin(1)
            for w in range(words):
                q = codes[:, s] == w
                if q.any():
                    pq = p[q]
                    lhs = q.sum() * np.eye(sub) + (weight - 1) * pq.T @ pq
                    rhs = pq.sum(0) + (weight - 1) * (pq * (rest[q] + (pq**2).sum(1))[:, None]).sum(0)
                    books[s, w] = np.linalg.solve(lhs, rhs)
            along[:, s] = np.einsum("ns,ns->n", p - books[s][codes[:, s]], p)
    return books


def encode(x: np.ndarray, books: np.ndarray, weight: float = PARALLEL_WEIGHT) -> np.ndarray:
    """4-bit codes of unit vectors: nearest words, then one pass of coordinate descent on the anisotropic loss."""
    n, d = x.shape
    m, _, sub = books.shape
    parts = x.reshape(n, m, sub)
    square = (books**2).sum(2)
    codes = np.empty((n, m), np.uint8)
    along = np.empty((n, m), x.dtype)
    for s in range(m):
        dot = parts[:, s] @ books[s].T
        codes[:, s] = (square[s] - 2 * dot).argmin(1)
        along[:, s] = (parts[:, s] ** 2).sum(1) - dot[np.arange(n), codes[:, s]]
    total = along.sum(1)
    for s in range(m):
        dot = parts[:, s] @ books[s].T
        a = (parts[:, s] ** 2).sum(1)[:, None] - dot
        rest = (total - along[:, s])[:, None]
        best = (square[s] - 2 * dot + (weight - 1) * (rest + a) ** 2).argmin(1)
        total += a[np.arange(n), best] - along[:, s]
        along[:, s] = a[np.arange(n), best]
        codes[:, s] = best
    return codes


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return books[np.arange(books.shape[0]), codes].reshape(len(codes), -1)


def search_region(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, books: np.ndarray | None = None, block: int = 256):
    """(query row, data row, similarity) of each query's k best in ``data``, itself excluded; ties to 12 decimals by smaller id.

    ``ids`` and ``query_ids`` are byte strings; data must be sorted by id so that a smaller row is a smaller id.
    """
    n = len(data)
    unit = (data / np.linalg.norm(data, axis=1)[:, None]).astype(np.float32)
    rng = np.random.default_rng(11)
    if books is None:
        books = fit_codebooks((unit if n <= SAMPLE else unit[rng.choice(n, SAMPLE, replace=False)]).astype(float)).astype(np.float32)
    coded = decode(encode(unit, books), books)
    a, b = rng.integers(n, size=2000), rng.integers(n, size=2000)
    error = float(np.std(np.einsum("ij,ij->i", unit[a], coded[b] - unit[b]))) if n > 1 else 0.0
    group = 16
    wide = -(-n // group) * group
    table = np.zeros((unit.shape[1], wide), np.float32)
    table[:, :n] = coded.T
    norm = np.sqrt(np.einsum("ij,ij->i", data, data))
    where = np.searchsorted(ids, query_ids) if n else np.zeros(len(query_ids), int)
    own = np.where((where < n) & (ids[np.minimum(where, n - 1)] == query_ids), where, -1)
    out = []
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        qn = np.sqrt(np.einsum("ij,ij->i", q, q))
        q32 = (q / qn[:, None]).astype(np.float32)
        score = q32 @ table
        score[:, n:] = -9
        rows = np.flatnonzero(own[at : at + block] >= 0)
        score[rows, own[at + rows]] = -9
        peak = score.reshape(len(q), group, -1).max(1)
        need = min(k, peak.shape[1])
        edge = np.partition(peak, -need, axis=1)[:, -need] if need == k else np.full(len(q), -8, np.float32)

        def exact(edge, floor=None):
            qi, gi = np.nonzero(peak >= edge[:, None])
            pos = (gi[:, None] + np.arange(group) * (wide // group)).ravel()
            qi = np.repeat(qi, group)
            keep = score[qi, pos] >= edge[qi]
            qi, pos = qi[keep], pos[keep]
            if floor is not None:  # single precision settles nearly all of them
                keep = np.einsum("ij,ij->i", q32[qi], unit[pos]) >= floor[qi] - 1e-5
                qi, pos = qi[keep], pos[keep]
            return qi, pos, np.round(np.einsum("ij,ij->i", q[qi], data[pos]) / (qn[qi] * norm[pos]), 12)

        # The k best by code give a similarity that k rows reach; no row whose code says much less can be among the k best.
        qi, pos, sim = exact(np.maximum(edge, -8))
        order = np.lexsort((-sim, qi))
        rank = np.arange(len(qi)) - np.searchsorted(qi[order], qi[order])
        reached = np.full(len(q), -8.0)
        at_k = order[rank == k - 1]
        reached[qi[at_k]] = sim[at_k]
        qi, pos, sim = exact(np.maximum(reached - MARGIN * error - 1e-4, -8).astype(np.float32), reached)
        order = np.lexsort((pos, -sim, qi))
        qi, pos, sim = qi[order], pos[order], sim[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = rank < k
        out.append((qi[top] + at, pos[top], sim[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(c), -1)


def _strings(column) -> np.ndarray:
    """Ids as fixed-width byte strings, which sort as they do."""
    return np.array([x.encode() for x in column.to_pylist()])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]


def _nearest_centre(x: np.ndarray, c: np.ndarray, take: int = 1, block: int = 4_096) -> np.ndarray:
    """The ``take`` nearest centres of each row, best first, in blocks of rows."""
    take = min(take, len(c))
    out = np.empty((len(x), take), np.int32)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ c.T
        best = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
        out[a : a + block] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
    return out


def fit_centres(x: np.ndarray, want: int, rounds: int = 8) -> np.ndarray:
    """At most ``want`` unit centres of unit vectors, by spherical k-means."""
    want = min(want, len(x))
    c = x[np.random.default_rng(3).choice(len(x), want, replace=False)]
    for _ in range(rounds):
        near = _nearest_centre(x, c)[:, 0]
        sums = np.zeros(c.shape, np.float64)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where((size > 1e-12)[:, None], sums / np.maximum(size, 1e-12)[:, None], c).astype(np.float32)
    return c


_VISIT = [("grp", pa.string()), ("part", pa.string()), ("id", pa.string()), ("v", pa.list_(pa.float32())), ("region", pa.int32()), ("home", pa.bool_())]


def _split(rows: DataFrame, counts: DataFrame, probes: int) -> DataFrame:
    """rows (grp, part, id, v, home) of the parts in ``counts`` (grp, part, n, want) with ``region``, the centres they fall to.

    A row that is at home goes to the next ``probes`` regions as well, a visitor to the nearest only.
    """
    out = rows.join(counts, ["grp", "part"])
    share = F.shiftrightunsigned(F.xxhash64("id"), 24) < (F.col("want") * 64 / F.col("n") * (1 << 40)).cast("long")

    def fit(table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table["v"]))
        x = x[np.isfinite(x).all(1)]
        c = fit_centres(x, table["want"][0].as_py()) if len(x) else np.zeros((1, _matrix(table["v"]).shape[1]), np.float32)
        n = len(c)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(c.ravel(), pa.float32()), c.shape[1]).cast(pa.list_(pa.float32()))
        return pa.table({"grp": pa.array([table["grp"][0].as_py()] * n, pa.string()), "part": pa.array([table["part"][0].as_py()] * n, pa.string()), "region": pa.array(range(n), pa.int32()), "c": flat, "salts": pa.array([table["salts"][0].as_py()] * n, pa.int32())})

    salts = F.ceil(F.col("n") / MEET).cast("int")
    sample = out.where("home").where(share | (F.col("n") <= F.col("want") * 64)).select("grp", "part", "want", "v", salts.alias("salts"))
    centres = materialize(sample.groupBy("grp", "part").applyInArrow(fit, "grp string, part string, region int, c array<float>, salts int"), "centres")
    salted = out.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), salts).cast("int")).select("grp", "part", "salt", "id", "v", "home")
    spread = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("grp", "part", "salt", "region", "c")

    def assign(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _VISIT})
        x, c = _unit(_matrix(left["v"])), _matrix(right["c"]).astype(np.float32)
        home = left["home"].to_numpy(zero_copy_only=False)
        order = _nearest_centre(x, c, probes + 1)
        use = np.zeros(order.shape, bool)
        use[:, 0] = True
        use[home] = True
        row, rank = np.nonzero(use)
        picked = left.select(["grp", "part", "id", "v"]).take(pa.array(row))
        region = right["region"].to_numpy()[order[row, rank]].astype(np.int32)
        return picked.append_column("region", pa.array(region)).append_column("home", pa.array((rank == 0) & home[row]))

    pair = salted.groupBy("grp", "part", "salt").cogroup(spread.groupBy("grp", "part", "salt"))
    return materialize(pair.applyInArrow(assign, "grp string, part string, id string, v array<float>, region int, home boolean"), "visits")


def _regions(rows: DataFrame, n: DataFrame, region_rows: int, probes: int, fan: int = FAN) -> DataFrame:
    """rows (grp, id, v) with ``part``, ``region``, ``block`` and ``home``: own region once, and further regions to visit as a query.

    A region that came out larger than twice the aim is cut into blocks by id: its rows lie in one block each and ask in all.
    """
    big = n.where(F.col("n") > region_rows)
    small = lambda df: df.select("grp", F.lit("").alias("part"), "id", "v", F.lit(0).alias("region"), F.lit(True).alias("home"), F.lit(0).alias("block"))
    if not big.limit(1).count():
        return small(rows)
    mark = broadcast_if_small(big.select("grp"))
    done = small(rows.join(mark, "grp", "left_anti"))
    rows = rows.join(mark, "grp", "left_semi").select("grp", F.lit("").alias("part"), "id", "v", F.lit(True).alias("home"))
    while True:
        counts = rows.where("home").groupBy("grp", "part").agg(F.count("*").alias("n"))
        counts = materialize(counts.withColumn("want", F.ceil(F.col("n") / region_rows * 2).cast("long")), "parts")
        many = counts.where(F.col("want") > fan).count()
        fits = _split(rows, broadcast_if_small(counts.where(F.col("want") <= fan)), probes)
        size = fits.where("home").groupBy("grp", "part", "region").agg(F.count("*").alias("n")).where(F.col("n") > 2 * region_rows)
        size = broadcast_if_small(size.select("grp", "part", "region", F.ceil(F.col("n") / region_rows).cast("int").alias("blocks")))
        fits = fits.join(size, ["grp", "part", "region"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        fits = fits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        own = F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int") == F.col("block")
        done = done.unionByName(fits.select("grp", "part", "id", "v", "region", (F.col("home") & own).alias("home"), "block"))
        if not many:
            return done
        cells = _split(rows, broadcast_if_small(counts.where(F.col("want") > fan).withColumn("want", F.lit(fan).cast("long"))), probes)
        rows = cells.select("grp", F.concat_ws(".", "part", F.col("region").cast("string")).alias("part"), "id", "v", "home")


def nearest(vectors: DataFrame, k: int = 5, dims: int = 64, region_rows: int = REGION_ROWS, probes: int = PROBES, fan: int = FAN) -> DataFrame:
    """(id, near_id, similarity): the k most similar rows of the same ``grp`` for each row of ``vectors`` (grp, id, v).

    Cosine similarity to 12 decimals, ties by the smaller id, itself excluded. Vectors that are null, of other length than
    ``dims``, all zero or not finite take no part; of repeated ids one row counts. A group of fewer than k + 1 rows gives what
    it has. Exact while a group fits one region; beyond, a neighbour is missed only if none of the visited regions holds it.
    ``region_rows`` and ``fan`` bound what one task holds; groups of any size are cut into as many levels of cells as that needs.
    """
    whole = vectors.select("grp", "id", F.col("v").cast("array<float>").alias("v")).where("grp is not null and id is not null and v is not null")
    top, low, inf = F.array_max("v"), F.array_min("v"), F.lit(float("inf"))
    # Codegen-friendly; a null element, which these pass over, is met as not finite where vectors become matrices.
    good = whole.where((F.size("v") == dims) & (top < inf) & (low > -inf) & ((top != 0) | (low != 0)))
    hashes = good.select("grp", "id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    crowds = hashes.groupBy("grp", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("grp", "h1", "h2")
    rest = None
    if crowds.limit(1).count():
        key = ["grp", "h1", "h2"]
        side = broadcast_if_small(crowds)
        w = Window.partitionBy(*key).orderBy("id")
        hashed = good.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
        crowd = hashed.join(side, key).where(F.forall("v", lambda e: e.isNotNull()))
        members = materialize(crowd.select("id", *key).distinct(), "crowds")
        kept = materialize(members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1), "copies")
        rest = members.join(kept.select("id", *key), ["id", *key], "left_anti")
        rest = rest.join(kept.where("rank = 1").select(*key, F.col("id").alias("lead")), key).select("id", "lead")
        # One vector stands for a crowd; the crowd's rows, however often delivered, leave the search but for those kept.
        vector = crowd.groupBy(*key).agg(F.first("v").alias("v"))
        good = hashed.join(side, key, "left_anti").select("grp", "id", "v").unionByName(kept.join(vector, key).select("grp", "id", "v"))
    sizes = materialize(good.groupBy("grp").agg(F.count("*").alias("n")), "group-sizes")
    rows = _regions(good, sizes, region_rows, probes, fan)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    few = [r[0] for r in hash_sample(good, "id", SAMPLE, total).select("v").collect()]
    if not few:
        return vectors.sparkSession.createDataFrame([], "id string, near_id string, similarity double")
    x = np.array(few, np.float64)
    x = x[np.isfinite(x).all(1)]
    if not len(x):
        return vectors.sparkSession.createDataFrame([], "id string, near_id string, similarity double")
    books = fit_codebooks(x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    result = [("id", pa.string()), ("near_id", pa.string()), ("similarity", pa.float64())]

    def search(table: pa.Table) -> pa.Table:
        ids = _strings(table["id"])
        home = table["home"].to_numpy(zero_copy_only=False)
        x = _matrix(table["v"]).astype(np.float64)
        sound = np.isfinite(x).all(1)
        if not sound.all():
            ids, home, x = ids[sound], home[sound], x[sound]
        _, first = np.unique(ids[home], return_index=True)
        data, names = x[home][first], ids[home][first]
        _, asked = np.unique(ids, return_index=True)
        if not len(data):
            return pa.table({n: pa.array([], t) for n, t in result})
        q, pos, sim = search_region(data, names, x[asked], ids[asked], k, books)
        return pa.table({"id": pa.array(ids[asked][q].astype(str)), "near_id": pa.array(names[pos].astype(str)), "similarity": pa.array(sim)})

    found = rows.groupBy("grp", "part", "region", "block").applyInArrow(search, "id string, near_id string, similarity double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "near_id"))), 1, k)
    found = found.groupBy("id").agg(best.alias("b"))
    if rest is not None:
        found = materialize(found, "found")
        lists = found.join(rest.select(F.col("lead").alias("id")).distinct(), "id", "left_semi")
        own = F.array(F.struct(F.lit(-1.0).alias("s"), F.col("id").alias("near_id")))
        lists = broadcast_if_small(lists.select(F.col("id").alias("lead"), F.slice(F.array_sort(F.concat("b", own)), 1, k).alias("b")))
        found = found.unionByName(rest.join(lists, "lead").select("id", "b"))
    return found.select("id", F.explode("b").alias("b")).select("id", "b.near_id", (-F.col("b.s")).alias("similarity"))


def pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b) with the smaller id first, each pair once."""
    return neighbours.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()
