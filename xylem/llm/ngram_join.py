"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

1. One pass over the texts gives each a digest and its MinHash signature, as trees of `depth` components. Texts that
   are equal are one from here on, with a count.
2. Each tree is a prefix trie of signatures: a node is a tree and a prefix, and holds the texts below it. Texts that are
   alone in all nodes of the shortest prefix have no partner and leave.
3. Matched prefixes are shortened level by level, from the full depth on, until the recall at the threshold,
   1 - (1 - t**d)**trees, reaches the target (with production parameters from 8 components to 5, where 3 of a million
   pairs at the threshold meet in no tree). At each level only nodes that still hold several classes have work left:
   their texts are compared with the node's least text, exactly, and classes are joined: before the last level each text
   with one such text, at the last level with all that are left in other classes. Most nodes are settled at the full
   depth and never looked at again.
4. What the last level leaves open are nodes of three or more texts in several classes. In those, texts outside the
   largest class are compared with all texts of the node, in tiles. After that every pair that shares a node is
   either in one class or has been compared.
5. Links are counted exactly within each class, in tiles of two blocks: a pair of different classes has no link. A
   class of any size is spread over its tiles, and a block is bounded by its number of shingles as well.

Words are runs of characters that aren't ASCII white space, in lower case; shingles are `words` of them in a row. A
text of fewer words is one shingle, all texts without words share one.

Nulls and odd rows: a null text counts as empty; a row with a null id has neither class nor links, and stays in
`drop_similar`; ids are taken as unique: rows of one id with other texts come to one class, in which the text of least
digest stands for the id; of the rows of a kept id the one of least digest of all columns stays; equal texts are linked
(copies are counted, not expanded); repeated rows are returned each; an empty table gives an empty result; further
columns are ignored by `join_similar` and pass through `drop_similar`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_above, join_heavy, materialise, small_batches
from .components import components

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    threshold: float = 0.8
    trees: int = 32
    depth: int = 8
    recall: float = 0.99999
    step: int = 3  # components by which a prefix is shortened
    block: int = 256  # texts of a block
    block_shingles: int = 500_000
    seed: int = 11
    broadcast_ids: int = 500_000  # beyond this many dropped documents, their ids are joined by a shuffle

    @property
    def matched(self) -> int:
        """The longest prefix that gives the target recall at the threshold."""
        d = self.depth
        while d > 1 and 1 - (1 - self.threshold**d) ** self.trees < self.recall:
            d -= 1
        return d

    @property
    def levels(self) -> list[int]:
        """Prefix lengths from the full depth down to the matched one."""
        return sorted({*range(self.depth, self.matched, -self.step), self.matched}, reverse=True)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", UNBASE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; at least one."""
    raw = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[raw], [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(1, dtype=np.uint64)
    up, down = _power(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        word = _mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
        n = min(words, len(word))
        out = np.zeros(len(word) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * BASE + word[k : len(word) - n + 1 + k]
        return np.unique(_mix(out + np.uint64(n)))


def _family(p: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    size = p.trees * p.depth
    return rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, size, dtype=np.uint64)


def signature(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits of the least hash under each function of the family."""
    mult, flip = family
    least = np.full(len(mult), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            part = hashes[at : at + 2048]
            np.minimum(least, ((part[None, :] ^ flip[:, None]) * mult[:, None]).min(1), out=least)
        return (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def signatures(docs: DataFrame, p: JoinParams) -> DataFrame:
    """(doc_id, key, trees): the text's digest and, by tree, the bytes of its components."""
    def sign(batches):
        family = _family(p)
        for pdf in batches:
            keys, trees = [], []
            for text in pdf["text"]:
                text = "" if text is None else text
                keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                trees.append([row.tobytes() for row in signature(shingles(text, p.words), family).reshape(p.trees, p.depth)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": keys, "trees": trees})

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(sign, "doc_id long, key binary, trees array<binary>")


def prefix_tries(texts: DataFrame, p: JoinParams) -> DataFrame:
    """(rep, n8, .., n5): for each text and tree the trie nodes of each level, of texts that share a node of the last level."""
    tree = texts.select("rep", F.posexplode("trees").alias("tree", "sig"))
    nodes = tree.select("rep", *[F.xxhash64("tree", F.substring("sig", 1, 2 * d)).alias(f"n{d}") for d in p.levels])
    last = f"n{p.matched}"
    shared = nodes.groupBy(last).agg(F.count(F.lit(1)).alias("below"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where(F.col("lo") != F.col("hi")).select(last, "below")
    return join_heavy(nodes, shared, [last], F.col("below") > heavy_above(texts.count() * p.trees)).select("rep", *[f"n{d}" for d in p.levels])


def _counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    every = np.concatenate([*left, *right])
    values, place = np.unique(every, return_inverse=True)
    shared = np.bincount(place) > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[place]
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    keep = column >= 0
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        ones = np.zeros((len(left) + len(right), width), dtype=np.float32)
        ones[owner[lo:hi], column[lo:hi] - at] = 1
        out += ones[: len(left)] @ ones[len(left) :].T
    return out


def verify_tile(ids: np.ndarray, side: np.ndarray, cls: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], within: bool, count: bool, threshold: float):
    """(links, least connected id) of each row of a tile, whose sides 0 and 1, or all rows `within` it, are compared.

    Counting, links are those to all others, times the copies of the linked texts; else pairs of one class are passed over.
    """
    a = np.arange(len(ids)) if within else np.flatnonzero(side == 0)
    b = np.arange(len(ids)) if within else np.flatnonzero(side == 1)
    links, label = np.zeros(len(ids), dtype=np.int64), ids.copy()
    if not len(a) or not len(b) or (not count and len(np.unique(cls)) < 2):
        return links, label
    size = np.array([len(s) for s in sets])
    both = _counts([sets[i] for i in a], [sets[i] for i in b])
    near = both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-6
    if not count:
        near &= cls[a][:, None] != cls[b][None, :]
    if within:
        np.fill_diagonal(near, False)
    links[a] += near @ copies[b]
    if not within:
        links[b] += near.T @ copies[a]
    x, y = np.nonzero(near)
    x, y = a[x], b[y]
    while len(x):
        fresh = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(fresh, x, low)
        np.minimum.at(fresh, y, low)
        if (fresh == label).all():
            break
        label = fresh
    return links, label


def verified(rows: DataFrame, sets: DataFrame, p: JoinParams, count: bool = False) -> DataFrame:
    """(id, links, label) rows, some for each text, of tiles (group, lo, hi) with rows (id, side, cls).

    Each tile is checked by one task, which holds one tile at a time.
    """
    rows = rows.join(sets.select("id", "copies", "set"), "id")
    tiles = rows.select("group", "lo", "hi", "side", "id", "cls", "copies", "set").repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "side", "id")

    def check(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            tile = pdf[["group", "lo", "hi"]].to_numpy()
            cut = np.flatnonzero((tile[1:] != tile[:-1]).any(1)) + 1
            at = [0, *cut.tolist()]
            if len(at) > 1:
                yield _tiles(pdf, at, p, count)
            held = pdf.iloc[at[-1] :]
        if held is not None and len(held):
            yield _tiles(held.reset_index(drop=True), [0, len(held)], p, count)

    return tiles.mapInPandas(check, "id long, links long, label long")


def _tiles(pdf: pd.DataFrame, at: list[int], p: JoinParams, count: bool) -> pd.DataFrame:
    """Verifies the tiles that begin at each but the last of `at`, which is an end."""
    ids, copies, side, cls, lo, hi = (pdf[c].to_numpy() for c in ("id", "copies", "side", "cls", "lo", "hi"))
    out = []
    for i, j in zip(at, at[1:], strict=False):
        sets = [np.asarray(s).view(np.uint64) for s in pdf["set"].iloc[i:j]]
        links, label = verify_tile(ids[i:j], side[i:j], cls[i:j], copies[i:j], sets, count and lo[i] == hi[i], count, p.threshold)
        out.append(pd.DataFrame({"id": ids[i:j], "links": links, "label": label}))
    return pd.concat(out)


def _blocks(texts: str, shingle_sum: str, p: JoinParams):
    """Number of blocks for so many texts of so many shingles."""
    return F.greatest(F.ceil(F.col(texts) / p.block), F.ceil(F.col(shingle_sum) / p.block_shingles), F.lit(1)).cast("int")


def _deal(blocks: str, salt: int = 0):
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(blocks)).cast("int")


def _to(end: str):
    return F.explode(F.sequence(F.lit(0), F.col(end) - 1))


def star_tiles(trie: DataFrame, level: int, rows: int, p: JoinParams, one: bool) -> DataFrame | None:
    """Tiles of a node's least text with those texts of the node that aren't in its class, each pair once; None if there are none.

    one: each text is compared with the least of such texts alone, before the last level. That settles most classes, so
    that few pairs are left to it.
    """
    trie = trie.withColumnRenamed(f"n{level}", "node")
    hubs = trie.groupBy("node").agg(F.min(F.struct("id", "cls")).alias("h"), F.min("cls").alias("least"), F.max("cls").alias("most"), F.count(F.lit(1)).alias("below"))
    hubs = hubs.where(F.col("least") != F.col("most")).select("node", F.col("h.id").alias("hub"), F.col("h.cls").alias("hub_cls"), "below")
    pairs = join_heavy(trie.select("node", "id", "cls", "n"), hubs, ["node"], F.col("below") > heavy_above(rows)).where(F.col("cls") != F.col("hub_cls"))
    pairs = pairs.groupBy("id").agg(F.min("hub").alias("hub"), F.first("n").alias("n")) if one else pairs.select("hub", "id", "n").distinct()
    pairs = materialise(pairs, "join-star")
    n_pairs = pairs.count()
    if not n_pairs:
        return None
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("size")).select("hub", "texts", _blocks("texts", "size", p).alias("blocks"))
    dealt = join_heavy(pairs, sizes, ["hub"], F.col("texts") > heavy_above(n_pairs))
    near = dealt.select(F.col("hub").alias("group"), F.lit(0).alias("lo"), _deal("blocks").alias("hi"), F.lit(1).alias("side"), "id")
    own = sizes.select(F.col("hub").alias("group"), F.lit(0).alias("lo"), _to("blocks").alias("hi"), F.lit(0).alias("side"), F.col("hub").alias("id"))
    return near.unionByName(own).withColumn("cls", F.col("id"))


def open_tiles(trie: DataFrame, level: int, rows: int, p: JoinParams) -> DataFrame:
    """Tiles of nodes of several classes: texts outside the node's largest class (side 0) with all its texts (side 1).

    Nodes of one set of texts in several trees are one. A node of two texts has been compared as a star.
    """
    trie = trie.select(F.col(f"n{level}").alias("node"), "id", "cls", "n")
    mark = F.xxhash64("id")
    per = trie.groupBy("node", "cls").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("size"), F.min("id").alias("least"), F.bit_xor(mark).alias("x"))
    per = per.groupBy("node").agg(F.sum("texts").alias("below"), F.sum("size").alias("size"), F.max(F.struct("texts", "cls", "size")).alias("top"), F.count(F.lit(1)).alias("k"), F.min("least").alias("least"), F.bit_xor("x").alias("x"))
    per = per.where((F.col("k") > 1) & (F.col("below") > 2)).groupBy("below", "size", "least", "x").agg(F.min(F.struct("node", "top")).alias("t"))
    per = per.select(F.col("t.node").alias("node"), "below", "size", F.col("t.top.cls").alias("major"), (F.col("below") - F.col("t.top.texts")).alias("few"), (F.col("size") - F.col("t.top.size")).alias("few_size"))
    per = per.select("node", "below", "major", _blocks("few", "few_size", p).alias("lows"), _blocks("below", "size", p).alias("highs"))
    met = join_heavy(trie, per, ["node"], F.col("below") > heavy_above(rows))
    left = met.where(F.col("cls") != F.col("major")).select(F.col("node").alias("group"), _deal("lows", 1).alias("lo"), _to("highs").alias("hi"), F.lit(0).alias("side"), "id", "cls")
    right = met.select(F.col("node").alias("group"), _to("lows").alias("lo"), _deal("highs").alias("hi"), F.lit(1).alias("side"), "id", "cls")
    return left.unionByName(right)


def link_tiles(members: DataFrame, p: JoinParams) -> DataFrame:
    """Tiles of all pairs of blocks of each class."""
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("size")).select("cls", "texts", _blocks("texts", "size", p).alias("blocks"))
    rows = join_heavy(members, sizes, ["cls"], F.col("texts") > heavy_above(members.count())).select("id", "cls", "blocks", _deal("blocks").alias("block"), _to("blocks").alias("other"))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return rows.select(F.col("cls").alias("group"), lo.alias("lo"), hi.alias("hi"), (F.col("block") != lo).cast("int").alias("side"), "id", "cls")


def shingle_sets(docs: DataFrame, texts: DataFrame, p: JoinParams) -> DataFrame:
    """(id, copies, n, set) of each of the texts (rep, key, copies)."""
    def sets(batches):
        for pdf in batches:
            own = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() == bytes(k) for t, k in zip(pdf["text"], pdf["key"], strict=True)]
            pdf = pdf[np.array(own, dtype=bool)]
            found = [shingles(t, p.words).view(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "copies": pdf["copies"], "n": [len(s) for s in found], "set": found})

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(texts.withColumnRenamed("rep", "id"), "id").select("id", "key", "copies", "text")
    return rows.mapInPandas(sets, "id long, copies long, n long, set array<long>").dropDuplicates(["id"])


def classes(docs: DataFrame, p: JoinParams, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row and (key, rep, copies, class_id, links) of every distinct text; links only if counted."""
    with small_batches(docs.sparkSession):
        return _classes(docs, p, count)


def _classes(docs: DataFrame, p: JoinParams, count: bool) -> tuple[DataFrame, DataFrame]:
    signed = materialise(signatures(docs, p), "join-signed")
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("trees").alias("trees"))
    texts = materialise(texts, "join-texts")
    trie = materialise(prefix_tries(texts, p), "join-tries")
    rows = trie.count()
    cands = texts.join(trie.select("rep").distinct(), "rep").groupBy("rep").agg(F.min("key").alias("key"), F.sum("copies").alias("copies"))
    sets = materialise(shingle_sets(docs, cands, p), "join-sets")
    state = sets.select("id", "n", F.col("id").alias("cls"))
    comps = edges = materialise(sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), "join-found")
    comps = comps.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    for level, one in [*((d, d > p.matched) for d in p.levels), (0, False)]:
        here = trie.join(state, F.col("rep") == F.col("id")).drop("rep")
        tiles = star_tiles(here, level, rows, p, one) if level else open_tiles(here, p.matched, rows, p)
        if tiles is None:
            continue
        found = verified(tiles, sets, p).where(F.col("id") != F.col("label")).select(F.col("id").alias("a"), F.col("label").alias("b"))
        found = materialise(found, "join-found")
        if found.isEmpty():
            continue
        edges = edges.unionAll(found)
        comps = materialise(components(edges), "join-classes")
        state = sets.select("id", "n").join(comps, "id", "left").select("id", "n", F.coalesce("comp", "id").alias("cls"))
    label = comps.select(F.col("id").alias("rep"), F.col("comp").alias("class_id"))
    out = texts.select("key", "rep", "copies").join(label, "rep", "left").withColumn("class_id", F.coalesce("class_id", "rep"))
    if not count:
        return signed.select("doc_id", "key"), out
    linked = materialise(verified(link_tiles(sets.select("id", "n").join(comps.withColumnRenamed("comp", "cls"), "id"), p), sets, p, True), "join-links")
    links = linked.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("linked"))
    out = out.join(links, "rep", "left").select("key", "rep", "copies", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return signed.select("doc_id", "key"), out


def join_similar(docs: DataFrame, params: JoinParams | None = None) -> DataFrame:
    """doc_id, class_id, links and copies of every document. class_id is the least id of the class, links the number
    of other documents of at least the threshold's similarity, copies the number with this very text."""
    signed, texts = classes(docs, params or JoinParams())
    out = signed.join(texts, "key").select("doc_id", "class_id", "links", "copies")
    lone = docs.where(F.col("doc_id").isNull()).select(*[F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id", "links", "copies")])
    return out.unionAll(lone)


def drop_similar(docs: DataFrame, params: JoinParams | None = None) -> DataFrame:
    """The documents without those of which one of the same class and of smaller id stays, with their columns."""
    p = params or JoinParams()
    signed, texts = classes(docs, p, count=False)
    result = materialise(signed.join(texts.select("key", "class_id"), "key").select("doc_id", "class_id"), "join-result")
    gone = result.where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    few = gone.limit(p.broadcast_ids + 1).count() <= p.broadcast_ids
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*columns)
    again = result.groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    if again.isEmpty():
        return kept
    row = F.struct(*columns)
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.md5(F.to_json(row).cast("binary"))).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*columns).unionByName(once.select(*columns))
