"""Embedding near-dedup by a robust-pruned flat graph.

Vectors of one label are split into overlapping shards: centroids are fitted on a bounded sample, every vector goes to its
OVERLAP nearest ones, and shards that are still too large are split again. In each shard every vector gets edges to near
vectors, robustly pruned: a candidate is dropped when a chosen neighbour is much nearer to it. Where more vectors are in
range than there are candidates, some edges lead to further ones, so that tight groups are left. The adjacency lists of all
shards are united. Each shard then searches for its own vectors, over its members and the neighbours that the united lists
add: all members in range are found by comparing, others by best-first search from the medoid, and everything in range is
expanded until nothing new is in range. What is found
is verified in double precision. Recall is audited against brute force on a bounded set of queries, for each label; labels
that are short of the target are done again with more overlap, and those that stay short, or that no fitting splits, go
through all pairs of bounded blocks, which is exact.

Equal vectors of a label are one from the first step on. Nothing is a row for each link: a shard counts links and hands on at
most one edge a vector, and components are found on those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import batches, ranges, read, ship, stored
from tidemill.llm.graph import components

THRESHOLD = 0.93
OVERLAP = 2
MOST_OVERLAP = 4
SHARD = 3000  # vectors aimed at; a shard of twice as many is split again
MAX_WAYS = 64
#: Rows of a block that its centroids are fitted on, at most about.
FIT_ROWS = 4096
DEGREE = 20
CANDIDATES = 64
OUT = 4  # edges to vectors in range beyond the candidates
BACK = 3  # nearest neighbours that get an edge back
ALPHA = 1.2
BEAM = 16
STEPS = 40
SLACK = 0.05
MAX_LEVELS = 8
STUCK = 0.95  # the share of a shard that one of its parts may hold, or splitting it is given up
#: Vectors of a block in the exact way, about.
BLOCK = 2000
#: Queries of the recall audit, at most about, and the recall to reach.
AUDIT = 200
TARGET_RECALL = 0.95


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v for vectors that can link: a label, and finite components that are not all zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(whole).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True)  # very large and very small vectors keep a finite norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, ways: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means, a few rounds."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:ways]]
    for _ in range(6):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def shards(reps: DataFrame, overlap: int) -> tuple[DataFrame, DataFrame | None]:
    """rep, label, v, copies, shard, own (the one shard that searches for it), for every shard that holds the vector; and
    the labels and lengths, if any, with vectors that no fitting tells apart (these vectors are in no shard)."""
    spark = reps.sparkSession
    rest = reps.withColumn("shard", F.xxhash64("label", "d")).withColumn("own", F.lit(True)).withColumn("was", F.lit(None).cast("long"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields)
    done = crowded = None
    for level in range(MAX_LEVELS + 1):
        sizes = stored(rest.groupBy("shard").agg(F.count("*").alias("_n"), F.max("was").alias("_was")), "shard-sizes")
        ready = rest.join(sizes.filter(F.col("_n") <= 2 * SHARD).select("shard"), "shard", "left_semi").drop("was")
        done = ready if done is None else done.unionByName(ready)
        large = sizes.filter(F.col("_n") > 2 * SHARD)
        # vectors that no fitting tells apart: every split leaves them together, and copies them
        stuck = large.filter(F.lit(level == MAX_LEVELS) | (F.col("_n") > STUCK * F.col("_was")))
        if not stuck.isEmpty():
            more = rest.join(stuck, "shard", "left_semi").select("label", "d").distinct()
            crowded = stored(more if crowded is None else crowded.unionAll(more).distinct(), "vector-crowds")
            large = large.join(stuck, "shard", "left_anti")
        if large.isEmpty():
            break
        large = large.select("shard", "_n")
        draw = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        sample = rest.join(large, "shard").filter(draw < FIT_ROWS / F.col("_n")).select("shard", "_n", "v")

        def centres(frame: pd.DataFrame) -> pd.DataFrame:
            ways = min(MAX_WAYS, int(np.ceil(frame["_n"].iloc[0] * overlap / SHARD)), len(frame))
            return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "c": [fit(unit(frame["v"]), max(2, ways)).tolist()]})

        fitted = stored(sample.groupBy("shard").applyInPandas(centres, "shard long, c array<array<double>>"), "shard-centres")

        def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in parts:
                out = []
                for _, rows in frame.groupby("shard", sort=False):
                    c = np.stack(rows["c"].iloc[0])
                    best = np.argsort(-(unit(rows["v"]) @ c.T), axis=1)[:, :overlap]
                    for k in range(best.shape[1]):
                        part = rows.drop(columns="c").copy()
                        part["way"] = best[:, k]
                        part["own"] &= k == 0
                        out.append(part)
                if out:
                    yield pd.concat(out)

        batches(spark)
        split = rest.drop("was").join(large.withColumnRenamed("_n", "was"), "shard").select(*rest.columns).join(fitted, "shard").mapInPandas(assign, kinds + ", way long")
        rest = stored(split.withColumn("shard", F.xxhash64("shard", "way", F.lit(level))).drop("way").select(*rest.columns), "shard-level")
    return stored(done, "shards"), crowded


def prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each vector its neighbours after robust pruning, then OUT spread over the ranks of what else is in range, the
    farthest included; -1 where there are fewer."""
    n = len(x)
    out = np.full((n, degree + OUT), -1, np.int64)
    width = min(CANDIDATES, n - 1)
    if width < 1:
        return out
    y = x.astype(np.float32)
    for k in range(0, n, 256):
        sims = y[k : k + 256] @ y.T
        rows = np.arange(len(sims))
        sims[rows, rows + k] = -2
        within = (sims >= THRESHOLD - SLACK).sum(1)
        for i in np.flatnonzero(within > width):
            order = np.argsort(-sims[i])
            out[k + i, degree:] = order[width - 1 + (within[i] - width) * np.arange(1, OUT + 1) // OUT]
        near = np.argpartition(-sims, width - 1, 1)[:, :width]
        far = 1 - np.take_along_axis(sims, near, 1)  # half the squared distance
        apart = 1 - np.einsum("nid,njd->nij", y[near], y[near])
        alive = np.ones(near.shape, bool)
        for r in range(min(degree, width)):
            cost = np.where(alive, far, np.inf)
            pick = cost.argmin(1)
            some = np.isfinite(cost[rows, pick])
            if not some.any():
                break
            out[k + rows[some], r] = near[rows, pick][some]
            alive &= alpha * alpha * apart[rows, pick] > far
            alive[rows, pick] = False
    return out


def fewer(x: np.ndarray, i: int, near: list[int]) -> np.ndarray:
    """The edges of vector i, robustly pruned where they are more than twice those that pruning gives."""
    near = np.unique(np.array(near, np.int64))
    if len(near) <= 2 * (DEGREE + OUT):
        return near
    far = 1 - x[near] @ x[i]
    near = near[np.argsort(far, kind="stable")]
    far.sort()
    alive, out = np.ones(len(near), bool), []
    while alive.any() and len(out) < 2 * DEGREE:
        k = int(alive.argmax())
        out.append(near[k])
        alive &= ALPHA * ALPHA * (1 - x[near] @ x[near[k]]) > far
        alive[k] = False
    # some of the others too, over all ranks, as prune() has them
    rest = np.setdiff1d(near, out)
    return np.concatenate([out, rest[len(rest) * np.arange(OUT) // OUT]]) if len(rest) else np.array(out)


def search(x: np.ndarray, starts: np.ndarray, edges: np.ndarray, queries: np.ndarray, threshold: float, members: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs in range, in blocks of queries. Node i has the edges from starts[i] to starts[i + 1]. The first nodes
    are the members, and queries are compared with all of them; what a further step costs follows from the nodes it touches,
    not from the size of the graph."""
    y = x.astype(np.float32)
    medoid = int((y @ y.mean(0)).argmax())
    n = len(x)
    size = np.diff(starts)
    for k in range(0, len(queries), 64):
        q = queries[k : k + 64]
        rows = np.arange(len(q))
        visited = np.zeros(len(q) * n, bool)
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(r, node, q=q, visited=visited, near=near):
            code = np.unique(r * n + node)
            code = code[~visited[code]]
            visited[code] = True
            r, node = np.divmod(code, n)
            sims = np.empty(len(code), np.float32)
            for a in range(0, len(code), 65536):
                s = slice(a, a + 65536)
                sims[s] = np.einsum("nd,nd->n", y[q[r[s]]], y[node[s]])
            close = sims >= threshold - SLACK
            near.append((r[close], node[close], sims[close]))
            return r, node, sims

        def follow(r, node):
            return visit(np.repeat(r, size[node]), edges[ranges(starts[node], size[node])])

        beam = np.full((len(q), BEAM), -1), np.full((len(q), BEAM), -2, np.float32), np.zeros((len(q), BEAM), bool)

        def merged(beam, r, node, sims, q=q, rows=rows):
            if not len(r):
                return beam
            place = np.arange(len(r)) - np.searchsorted(r, r)
            shape = (len(q), int(place.max()) + 1)
            new = np.full(shape, -1), np.full(shape, -2, np.float32), np.zeros(shape, bool)
            for part, v in zip(new, (node, sims, True), strict=True):
                part[r, place] = v
            both = [np.concatenate(p, 1) for p in zip(beam, new, strict=True)]
            top = np.argpartition(-both[1], BEAM - 1, 1)[:, :BEAM]
            return tuple(p[rows[:, None], top] for p in both)

        beam = merged(beam, *visit(np.concatenate([rows, rows]), np.concatenate([np.full(len(q), medoid), q])))
        for _ in range(STEPS):  # best first, while a node of the beam is open
            best = np.where(beam[2], beam[1], -3).argmax(1)
            go = beam[2][rows, best]
            if not go.any():
                break
            beam[2][rows[go], best[go]] = False
            beam = merged(beam, *follow(rows[go], beam[0][rows[go], best[go]]))
        inside = y[q] @ y[:members].T
        r, node = np.nonzero(inside >= threshold - SLACK)
        new = ~visited[r * n + node]
        visited[r[new] * n + node[new]] = True
        near.append((r[new], node[new], inside[r[new], node[new]]))
        done = 0
        while done < len(near):  # everything in range, or nearly, is expanded
            todo, done = near[done:], len(near)
            r, node = (np.concatenate([t[i] for t in todo]) for i in (0, 1))
            for a in range(0, len(r), 32768):
                follow(r[a : a + 32768], node[a : a + 32768])
        r, node, sims = (np.concatenate([t[i] for t in near]) for i in range(3))
        sure = (sims >= threshold - 1e-3) & (q[r] != node)
        r, node = r[sure], node[sure]
        exact = np.concatenate([np.einsum("nd,nd->n", x[q[r[a : a + 65536]]], x[node[a : a + 65536]]) for a in range(0, len(r), 65536)] or [np.zeros(0)]) >= threshold
        yield q[r[exact]], node[exact]


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    """Edges to pruned neighbours, and back from the nearest ones, so that no vector is without an edge that leads to it. A
    vector that many others lead back to is pruned once more, over all of its edges."""
    ids, x = frame["rep"].to_numpy(), unit(frame["v"])
    edges = prune(x)
    near = [e[e >= 0].tolist() for e in edges]
    for i, e in enumerate(edges[:, :BACK].tolist()):
        for j in e:
            if j >= 0:
                near[j].append(i)
    return pd.DataFrame({"rep": ids, "near": [ids[fewer(x, i, e)].tolist() for i, e in enumerate(near)]})


def _places(ids: np.ndarray, lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids of each list stand among all ids, one list after another, and where each begins; others are left out."""
    order = np.argsort(ids)
    by = ids[order]
    sizes = np.fromiter((0 if x is None else len(x) for x in lists), np.int64, len(lists))
    flat = np.concatenate([np.asarray(x, ids.dtype) for x in lists if x is not None and len(x)] or [np.zeros(0, ids.dtype)])
    at = np.minimum(np.searchsorted(by, flat), len(by) - 1)
    known = by[at] == flat
    count = np.concatenate([[0], np.cumsum(known)])
    return np.concatenate([[0], count[np.cumsum(sizes)]]), order[at[known]]


def _holds(lists: list[frozenset], rows: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Whether the list of each row holds the shard beside it."""
    names, number = np.unique(shards, return_inverse=True)
    code, back = np.unique(rows * max(1, len(names)) + number, return_inverse=True)
    return np.fromiter((int(names[c % len(names)]) in lists[c // len(names)] for c in code.tolist()), bool, len(code))[back]


def _search(threshold: float):
    """Links of a shard's own vectors. Every pair counts once, for both of its ends, in one of the two shards that search for
    these: in one that has the other vector as a member, else in one that sees it at all; of two such in the smaller."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # a neighbour from elsewhere may also be a member: members come first
        frame = frame.sort_values(["member", "rep"], ascending=[False, True], kind="stable").drop_duplicates("rep")
        ids, copies, home = (frame[c].to_numpy() for c in ("rep", "copies", "home"))
        member_of, seen_in = ([frozenset(() if s is None else np.asarray(s).tolist()) for s in frame[c]] for c in ("member_of", "seen_in"))
        is_member, here = frame["member"].to_numpy(bool), int(frame["shard"].iloc[0])
        x = unit(frame["v"])
        starts, edges = _places(ids, frame["near"].tolist())
        queries = np.flatnonzero(is_member & (home == here))
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        pairs = []
        for a, b in search(x, starts, edges, queries, threshold, int(is_member.sum())):
            there = home[b]
            ours = there == here
            far = np.flatnonzero(~ours)  # found by comparing from here; the other shard may do so as well
            inside, theirs = is_member[b[far]], _holds(member_of, a[far], there[far])
            sees = theirs | _holds(seen_in, a[far], there[far])
            first = here < there[far]
            mine = np.where(inside & theirs, first, np.where(inside | theirs, inside, np.where(sees, first, True)))
            counted = np.concatenate([np.flatnonzero(ours), far[mine]])
            a, b, ours = a[counted], b[counted], ours[counted]
            np.add.at(links, a, copies[b])
            np.add.at(links, b[~ours], copies[a[~ours]])  # own vectors are queries too
            pairs.append((a, b))
        if pairs:
            a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
            while len(a):  # the smallest place that can be reached inside the shard
                low = label.copy()
                np.minimum.at(low, a, label[b])
                np.minimum.at(low, b, label[a])
                low = low[low]
                if (low == label).all():
                    break
                label = low
        keep = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        return pd.DataFrame({"a": ids[keep], "b": ids[label[keep]], "n": links[keep]})

    return run


def _linked(reps: DataFrame, threshold: float, overlap: int) -> tuple[DataFrame, DataFrame | None]:
    """a, b (an edge towards what a is linked with), n (links of a that one shard counts, to be summed); and what shards()
    says of crowded labels."""
    held, crowded = shards(reps, overlap)
    if crowded is not None:  # these labels go through all pairs of blocks as a whole
        held = held.join(crowded, ["label", "d"], "left_anti")
    near = held.groupBy("shard").applyInPandas(_build, "rep long, near array<bigint>")
    near = stored(near.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-edges")
    homes = held.groupBy("rep").agg(F.max(F.when(F.col("own"), F.col("shard"))).alias("home"), F.collect_set("shard").alias("member_of"))
    beyond = held.select("shard", "rep").join(near, "rep").select("shard", F.explode("near").alias("rep")).distinct().join(held.select("shard", "rep"), ["shard", "rep"], "left_anti")
    beyond = stored(beyond, "vector-beyond")
    seen = beyond.groupBy("rep").agg(F.collect_set("shard").alias("seen_in"))
    of = stored(near.join(homes, "rep").join(seen, "rep", "left"), "vector-homes")
    columns = ["shard", "rep", "v", "copies", "home", "member_of", "seen_in", "near"]
    members = held.join(of, "rep").select(*columns, F.lit(True).alias("member"))
    halo = beyond.join(reps.select("rep", "v", "copies"), "rep").join(of, "rep").select(*columns, F.lit(False).alias("member"))
    return stored(members.unionAll(halo).groupBy("shard").applyInPandas(_search(threshold), "a long, b long, n long"), "vector-links"), crowded


def _compare(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        one, two = frame[frame["block"] == lo], frame[frame["block"] == hi]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)
        x, y = unit(one["v"]), unit(two["v"])
        hit = np.concatenate([x[k : k + 256] @ y.T >= threshold for k in range(0, len(x), 256)])
        if lo == hi:
            hit = np.triu(hit, 1)
            hit |= hit.T
        ids = np.concatenate([one["rep"].to_numpy(), two["rep"].to_numpy()])
        low, high = np.arange(len(x), dtype=np.int32), np.arange(len(x), len(ids), dtype=np.int32)
        while True:  # the smallest place that can be reached inside the two blocks
            before = low, high
            low = np.minimum(low, np.where(hit, high, len(ids)).min(1))
            high = np.minimum(high, np.where(hit, low[:, None], len(ids)).min(0))
            if (low == before[0]).all() and (high == before[1]).all():
                break
        n = np.concatenate([hit @ two["copies"].to_numpy(), hit.T @ one["copies"].to_numpy() * int(lo != hi)])
        linked = np.concatenate([hit.any(1), hit.any(0)])
        return pd.DataFrame({"a": ids, "b": ids[np.concatenate([low, high])], "n": n})[linked]

    return run


def exact_links(reps: DataFrame, threshold: float) -> DataFrame:
    """As _linked(), with every link: all pairs of blocks of a label, each compared once. A vector is sent once for each block
    of its label."""
    count = reps.groupBy("label", "d").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_k"))
    dealt = reps.join(count, ["label", "d"]).withColumn("block", F.pmod(F.xxhash64("rep"), "_k").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    paired = paired.select("label", "d", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "v", "copies")
    found = stored(paired.groupBy("label", "d", "lo", "hi").applyInPandas(_compare(threshold), "a long, b long, n long"), "vector-pairs")
    return found


def audit(reps: DataFrame, links: DataFrame, threshold: float) -> dict[tuple[str, int], tuple[float, float]]:
    """(label, length) -> recall of links, and the mean recall of queries, for those with links among the audited queries.

    Queries are about AUDIT of all vectors, as many of those with links, and AUDIT // 4 with the most links; brute force
    compares them with all vectors in blocks. They are of a bounded number, so they are broadcast to the scan."""
    found = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("found"))
    seen = stored(reps.select("rep", "label", "d", "v").join(found, "rep", "left"), "vector-found")
    count, linked = seen.agg(F.count("*"), F.count("found")).first()
    draw = F.pmod(F.xxhash64("rep", F.lit("audit")), F.lit(1 << 30)) / float(1 << 30)
    drawn = seen.filter((draw < AUDIT / max(1, count)) | F.col("found").isNotNull() & (draw < AUDIT / max(1, linked))).collect()
    most = seen.filter("found IS NOT NULL").orderBy(F.desc("found"), "rep").limit(AUDIT // 4).collect()
    queries = list({r.rep: r for r in drawn + most}.values())
    by: dict[tuple, tuple] = {}
    for key in {(r.label, r.d) for r in queries}:
        own = [r for r in queries if (r.label, r.d) == key]
        by[key] = np.array([r.rep for r in own]), unit([r.v for r in own])

    def brute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for key, rows in frame.groupby(["label", "d"], sort=False):
                if key in by:
                    ids, q = by[key]
                    hit = q @ unit(rows["v"]).T >= threshold
                    hit &= ids[:, None] != rows["rep"].to_numpy()[None, :]
                    yield pd.DataFrame({"rep": ids, "n": hit @ rows["copies"].to_numpy()})

    true = reps.select("rep", "label", "d", "v", "copies").mapInPandas(brute, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).filter("n > 0")
    truth = {r.rep: r.n for r in true.collect()} if queries else {}
    out: dict[tuple, list[tuple[int, int]]] = {}
    for r in queries:
        if r.rep in truth:
            out.setdefault((r.label, r.d), []).append((min(r.found or 0, truth[r.rep]), truth[r.rep]))
    return {key: (sum(g for g, _ in v) / sum(n for _, n in v), sum(g / n for g, n in v) / len(v)) for key, v in out.items()}


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each vec_id: vec_id, n_links, component_id, kept.

    Vectors link when their labels (and lengths) are equal and their cosine is threshold or more; every link is exact, and
    in each label at least TARGET_RECALL of them are found on the audited queries: where the graph stays short of that, all
    pairs are compared. Vectors without a label, null or zero ones, and such
    with null or non-finite components, link with nothing. Rows that share a vec_id are one vector; rows without one are
    left out.
    """
    ship(embeddings.sparkSession)
    good = stored(usable(embeddings), "vectors")
    same = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = stored(same.withColumn("d", F.size("v")), "vector-reps")
    rest, links = reps, None
    for overlap in range(OVERLAP, MOST_OVERLAP + 1):
        found, crowded = _linked(rest, threshold, overlap)
        links = found if links is None else links.unionAll(found)
        if crowded is not None:
            links = links.unionAll(exact_links(rest.join(crowded, ["label", "d"], "left_semi"), threshold))
            rest = rest.join(crowded, ["label", "d"], "left_anti")
        short = [key for key, recall in audit(rest, found, threshold).items() if min(recall) < TARGET_RECALL]
        if not short:
            break
        # these labels are done again as a whole
        rest = stored(rest.join(F.broadcast(reps.sparkSession.createDataFrame(short, "label string, d int")), ["label", "d"], "left_semi"), "vector-rest")
        links = stored(links.join(rest.select(F.col("rep").alias("a")), "a", "left_anti"), "vector-links-kept")
    else:
        links = links.unionAll(exact_links(rest, threshold))
    counted = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined_to = components(links.select("a", "b"), "vector-components").withColumnRenamed("node", "rep")
    per_rep = reps.join(counted, "rep", "left").join(joined_to, "rep", "left")
    per_rep = per_rep.select("label", "v", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of = good.join(per_rep, ["label", "v"]).select(F.col("vec_id").alias("_id"), "component_id", "n_links")
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).filter("vec_id IS NOT NULL").distinct()
    out = every.join(of, F.col("vec_id") == F.col("_id"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))


def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
