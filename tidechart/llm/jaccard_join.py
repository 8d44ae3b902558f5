"""N-gram Jaccard join by skipping over set relations.

Texts become sets of word shingles. Equal sets are one. The rest is an exact join with a prefix index whose
lists are skipped in blocks and whose answers are derived from similar sets' answers:

1. Order. Shingles whose hash lies in a share of the hash space are counted over all texts. The global
   order of shingles is: counted and held by one set; counted and shared, by count; the others, by hash. A
   set links only with sets that share one of its first n - ceil(t n) + 1 shingles, t being the threshold. A set whose first
   shingles are all its own has no partner and ends here.
2. Index. Lists of (set, size, position) by shingle. In each list the first set is the pivot. A posting is
   skipped if sizes and positions bound its Jaccard similarity with the pivot under 0.4 - (1 - t); other
   pairs with a pivot are intersected.
3. Derived answers. 1 - J is a metric. If x lies within 0.6 of the pivot of a list, every partner of x in
   that list lies within 0.6 + 1 - t of that pivot and within 1 - t of x's distance. So all partners of x in the list
   are found in the pivot's family, in the ring of x, and x's posting leaves the list. Sets already in one
   component are not compared again.
4. What stays in the lists gets the next pivot; after two rounds the rest is compared in blocks, with
   positions, sizes and bitmaps as upper bounds, and then exactly.

Families and lists are cut into blocks of about BLOCK sets by hash, so no task holds a whole hot group; in a block of a
family, sets meet only by shingles that few sets of the block hold. A set is named by the least row number that has it,
and equal sets are told by two hashes. Nothing is
dropped: the components are those of all pairs with similarity of at least the threshold.

The threshold is num / den, a parameter like the shingle length `k`. op3 asks for three words and 0.9; the
pipeline's stage asks for five words and 0.8. It has to be above 0.6.

Defined cases: a null text, or one without words, has an empty set and no links; texts under `k` words are
one shingle; repeated rows are copies; of rows with equal ids, or none, the row number says which comes first; a
very long text is a piece of its own and read whole; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.common import numbered, stored, table
from tidechart.llm.graph import components
from tidechart.llm.tokens import _BASE, Piece, U, _powers, mix, pieces

SHINGLE, NUM, DEN = 3, 9, 10
#: The share of the hash space that is counted is the prefix's share, 1 - t, and this: enough for nearly every set.
COUNTED = 0.06
#: Similarity with the pivot from which a set leaves the pivot's list.
CORE = 0.4
ROUNDS = 2
BLOCK = 1024
BITS = 4096
#: Ids of sets that stay in the join are broadcast to thin out texts only up to this many (8 bytes each).
BROADCAST_ROWS = 500_000
I64 = np.int64


def _limit(num: int, den: int) -> np.uint64:
    """Hashes below this are counted."""
    return U(int(((den - num) / den + COUNTED) * 2**64))


def _family(num: int, den: int) -> float:
    """Least similarity with a pivot of partners of sets in its core."""
    return CORE - (den - num) / den - 1e-9


def _sets(p: Piece, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles of each document of a piece, by document and hash."""
    counts = p.counts
    n = len(p.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, doc = p.windows(k), p.doc[: max(0, n - k + 1)]
    inside = doc == p.doc[k - 1 :] if n >= k else np.zeros(0, bool)
    h, doc = h[inside], doc[inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(p.doc, short)
        up, down = _powers(_BASE, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(p.hash * up)])
        whole = mix((total[first + counts[short]] - total[first]) * down[first] + counts[short].astype(np.uint64))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    width = max(1, int(p.last - p.first - 1).bit_length())
    order = np.argsort((doc.astype(np.uint64) << U(64 - width)) | (h >> U(width)))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def signatures(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(uid, n, hash, hash2, n0, counted): set size, two hashes of the set, and its counted shingles."""
    limit = _limit(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column(1), lower=True):
                m = p.last - p.first
                h, doc = _sets(p, k)
                at = np.searchsorted(doc, np.arange(m + 1))
                sums = []
                for salt in (U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47)):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt))])
                    sums.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
                low = h < limit
                n0 = np.bincount(doc[low], minlength=m)[:m] if len(doc) else np.zeros(m, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, m), pa.array(np.diff(at)), pa.array(sums[0].view(I64)), pa.array(sums[1].view(I64)), pa.array(n0.astype(np.int64)), _lists(h[low].view(I64), n0)],
                    names=["uid", "n", "hash", "hash2", "n0", "counted"],
                )

    return docs.select("uid", "text").mapInArrow(run, "uid long, n long, hash long, hash2 long, n0 long, counted array<long>")


def _prefixes(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sid, n, shingles, prefix) of rows (sid, n, own, shared, text): all shingles, and the prefix that can be shared."""
    limit = _limit(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for p in pieces(batch.column(4), lower=True):
                m = p.last - p.first
                h, doc = _sets(p, k)
                at = np.searchsorted(doc, np.arange(m + 1))
                tokens, places, sizes = [], [], np.zeros(m, np.int64)
                for i in range(m):
                    row = p.first + i
                    shared = np.array(batch.column(3)[row].as_py() or [], I64)  # by count, then hash
                    mine = h[at[i] : at[i + 1]]
                    rest = mine[mine >= limit].view(I64)
                    room = max(0, int(n[row] // den * (den - num) + (n[row] % den) * (den - num) // den + 1 - own[row]))
                    take = np.concatenate([shared, rest])[:room]
                    tokens.append(take)
                    places.append(own[row] + np.arange(len(take)))
                    sizes[i] = len(take)
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(tokens) if tokens else np.zeros(0, I64)), pa.array(np.concatenate(places).astype(np.int64) if places else np.zeros(0, I64))], names=["token", "pos"])
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, m), batch.column(1).slice(p.first, m), _lists(h.view(I64), np.diff(at)), prefix], names=["sid", "n", "shingles", "prefix"])

    return rows.select("sid", "n", "own", "shared", "text").mapInArrow(run, "sid long, n long, shingles array<long>, prefix array<struct<token:long,pos:long>>")


def _linked(common: Column, n_a: Column, n_b: Column, num: int, den: int) -> Column:
    return common * den >= (n_a + n_b - common) * num


def intersected(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common) of distinct pairs (a, b)."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"))


def _seated(members: DataFrame, key: str, comps: DataFrame) -> DataFrame:
    """`members` with root, side and (x, y): the pairs of blocks of its group that each member takes part in.

    Members of one component need not meet. Of each group's components the largest one is its main one; members
    outside of it (side) meet everybody, those inside only the former, in as few rows as there are blocks of them.
    Blocks hold about BLOCK members; seats come from the set's hash, so no task sees a whole group.
    """
    known = members.join(comps.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", F.col("sid")))
    known = stored(known, "known")
    sizes = known.groupBy(key, "root").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("root", F.struct("n", "root")).alias("__main"), F.max("n").alias("n_shut"), F.sum("n").alias("n_all"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = sizes.where("n_all > n_shut").select(F.col(key).alias("__k"), "__main", blocks(F.col("n_all") - F.col("n_shut")).alias("__open"), blocks(F.col("n_shut")).alias("__shut"))
    seat = lambda n: F.pmod(F.xxhash64("sid", F.lit(11)), n).cast("int")
    placed = known.join(stored(sizes, "sizes"), F.col(key) == F.col("__k")).withColumn("side", F.col("root") != F.col("__main"))
    placed = placed.withColumn("block", F.when(F.col("side"), seat(F.col("__open"))).otherwise(F.col("__open") + seat(F.col("__shut"))))
    others = F.when(F.col("side"), F.col("__open") + F.col("__shut")).otherwise(F.col("__open"))
    pairs = F.transform(F.sequence(F.lit(0), others - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y")))
    return placed.withColumn("xy", F.explode(pairs)).select(*members.columns, "root", "side", "block", "xy.x", "xy.y")


def _find(root: dict, x: int) -> int:
    while root.setdefault(x, x) != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _meetings(sets_: list[np.ndarray], num: int, den: int) -> list[np.ndarray]:
    """For each set of a group the later ones that may link with it.

    Shingles are put in order of how many sets of the group hold them. Linked sets share one of the first
    n - ceil(t n) + 1 of either, so sets meet only where such shingles are held by both.
    """
    n = np.array([len(x) for x in sets_])
    _, token, held = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((token, held[token], owner))
    token, owner = token[order], owner[order]
    place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    first = (place < np.repeat(n + (-n * num // den) + 1, n)) & (held[token] > 1)
    token, owner = token[first], owner[first]
    by_token = np.lexsort((owner, token))
    at, among = np.empty(len(token), np.int64), owner[by_token]
    at[by_token] = np.arange(len(token))
    # among[at + 1 : end] are the sets after `owner` that hold the shingle
    end = np.searchsorted(token[by_token], token, side="right")
    begins = np.searchsorted(owner, np.arange(len(n) + 1))
    out = []
    for a, b in zip(begins, begins[1:]):
        lists = [among[x + 1 : y] for x, y in zip(at[a:b], end[a:b])]
        out.append(np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64))
    return out


def family_links(families: DataFrame, sets: DataFrame, comps: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b): links between members of one family that are in different components so far.

    Sets meet by shingles that are rare in their block of the family. Pairs are then thinned out by size, by their
    distances to the pivot and by bitmaps before sets are intersected.
    """
    members = _seated(families, "pivot", comps)
    rows = members.join(sets.select("sid", "n", "shingles"), "sid")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "sid"], ignore_index=True)
        sets_, n, far = group["shingles"].to_list(), group["n"].to_numpy(), group["far"].to_numpy()
        block, sid, comp, side = (group[c].to_numpy() for c in ("block", "sid", "root", "side"))
        root: dict = {}
        out = []
        bits = np.stack([np.frombuffer(_bitmap(x).tobytes(), np.uint64) for x in sets_])
        for i, near in enumerate(_meetings(sets_, num, den)):
            last = np.searchsorted(n, n[i] * den // num + 1, side="right")
            near = near[(near < last) & (comp[near] != comp[i])]
            near = near[(np.abs(far[near] - far[i]) <= (den - num) / den + 1e-9) & ((far[near] <= 1 - CORE) | (far[i] <= 1 - CORE)) & (side[near] | side[i])]
            if group["x"].iat[0] != group["y"].iat[0]:
                near = near[block[near] != block[i]]
            # bits that differ are shingles that differ, so few enough in common rule a pair out
            differ = np.bitwise_count(bits[near] ^ bits[i]).sum(1).astype(np.int64)
            near = near[(n[i] + n[near] - differ) // 2 >= -(-num * (n[i] + n[near]) // (num + den))]
            for j in near:
                a, b = _find(root, comp[i]), _find(root, comp[j])
                if a == b:
                    continue
                common = len(np.intersect1d(sets_[i], sets_[j], assume_unique=True))
                if common * den >= (n[i] + n[j] - common) * num:
                    root[a] = b
                    out.append((sid[i], sid[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.select("pivot", "x", "y", "block", "side", "sid", "root", "far", "n", "shingles").groupBy("pivot", "x", "y").applyInPandas(run, "a long, b long")


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[mix(np.asarray(shingles, I64).view(np.uint64)) % U(BITS)] = True
    return np.packbits(bits)


def rest_pairs(postings: DataFrame, sets: DataFrame, comps: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b): distinct pairs of one list and of two components so far that sizes, positions and bitmaps allow."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_bitmap(x.values.to_numpy(zero_copy_only=False)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["sid", "bits"])

    needed = sets.join(postings.select("sid").distinct(), "sid").select("sid", "shingles")
    with_bits = _seated(postings, "token", comps).join(needed.mapInArrow(marks, "sid long, bits binary"), "sid")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "pos", "sid"], ignore_index=True)
        n, pos, block, sid, root = (group[c].to_numpy() for c in ("n", "pos", "block", "sid", "root"))
        bits = np.stack([np.frombuffer(x, np.uint64) for x in group["bits"]])
        same = group["x"].iat[0] == group["y"].iat[0]
        out = []
        for i in range(len(group)):
            last = np.searchsorted(n, n[i] * den // num + 1, side="right")
            near = np.arange(i + 1, last)
            near = near[root[near] != root[i]]
            if not same:
                near = near[block[near] != block[i]]
            need = -(-num * (n[i] + n[near]) // (num + den))
            most = np.minimum(pos[i], pos[near]) + 1 + np.minimum(n[i] - pos[i], n[near] - pos[near]) - 1
            near, need = near[most >= need], need[most >= need]
            if len(near):
                differ = np.bitwise_count(bits[near] ^ bits[i]).sum(1).astype(np.int64)
                out.extend((min(sid[i], sid[j]), max(sid[i], sid[j])) for j in near[(n[i] + n[near] - differ) // 2 >= need])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return with_bits.select("token", "x", "y", "block", "sid", "root", "n", "pos", "bits").groupBy("token", "x", "y").applyInPandas(run, "a long, b long").distinct()


def distinct_sets(sigs: DataFrame) -> DataFrame:
    """(sid, hash, hash2, n, n0) of each distinct set that is not empty. Equal sets agree in both hashes; a set's name, sid,
    is the least row number that has it, so sets never share a name, whatever their hashes."""
    told = sigs.where("n > 0").groupBy("hash", "hash2").agg(F.min("uid").alias("sid"), F.first("n").alias("n"), F.first("n0").alias("n0"))
    return stored(told, "sets_named")


def set_links(rows: DataFrame, sigs: DataFrame, named: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b): links between distinct sets (by sid) that make the components of the join.

    rows: uid, text; sigs: of the same k, num and den; named: their distinct sets.
    """
    family = _family(num, den)
    reps = named.select("sid", "n", "n0")
    tokens = sigs.join(reps.select(F.col("sid").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("sid"), F.explode("counted").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    shared = tokens.join(counts.where("lo != hi").select("token", "df"), "token")
    by_set = stored(shared.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared")), "shared")
    left = reps.join(by_set, "sid", "left").withColumn("own", F.col("n0") - F.coalesce(F.size("shared"), F.lit(0)))
    room = F.floor(F.col("n") * (den - num) / den) + 1
    left = stored(left.where(F.col("own") < room).select("sid", F.col("sid").alias("uid"), "n", "own", F.transform(F.coalesce("shared", F.array().cast("array<struct<df:long,token:long>>")), lambda s: s["token"]).alias("shared")), "left")
    ids = left.select("uid")
    texts = rows.join(F.broadcast(ids) if left.count() <= BROADCAST_ROWS else ids, "uid", "left_semi")
    sets = stored(_prefixes(left.join(texts.select("uid", "text"), "uid"), k, num, den), "sets")
    lists = sets.select("sid", "n", F.explode("prefix").alias("p")).select("sid", "n", "p.token", "p.pos")
    links, families = None, None
    for turn in range(ROUNDS):
        pivots = lists.groupBy("token").agg(F.min(F.struct("sid", "n", "pos")).alias("v"), F.count("*").alias("len")).where("len > 1").drop("len")
        lists = stored(lists.join(pivots, "token"), f"lists{turn}")
        bound = F.least("pos", F.col("v.pos")) + F.least(F.col("n") - F.col("pos"), F.col("v.n") - F.col("v.pos"))
        worth = (F.col("sid") != F.col("v.sid")) & (bound >= family * (F.col("n") + F.col("v.n") - bound))
        pairs = lists.where(worth).select(F.col("sid").alias("a"), F.col("v.sid").alias("b")).distinct()
        found = stored(intersected(pairs, sets).withColumn("far", 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))), f"found{turn}")
        own_links = found.where(_linked(F.col("common"), F.col("n_a"), F.col("n_b"), num, den)).select("a", "b")
        own_families = found.where(F.col("far") <= 1 - family).select(F.col("b").alias("pivot"), F.col("a").alias("sid"), "far")
        links = own_links if links is None else links.unionByName(own_links)
        families = own_families if families is None else families.unionByName(own_families)
        core = found.where(F.col("far") <= 1 - CORE).select(F.col("a").alias("sid"), F.col("b").alias("__v"))
        stay = lists.where(F.col("sid") != F.col("v.sid")).withColumn("__v", F.col("v.sid")).join(core, ["sid", "__v"], "left_anti")
        lists = stay.select("sid", "n", "token", "pos")
    families = families.groupBy("pivot", "sid").agg(F.min("far").alias("far"))
    links = stored(links, "links")
    comps = stored(components(links), "components")
    more = stored(family_links(families, sets, comps, num, den), "more")
    links = links.unionByName(more)
    rest = intersected(rest_pairs(lists, sets, comps, num, den), sets)
    return links.unionByName(rest.where(_linked(F.col("common"), F.col("n_a"), F.col("n_b"), num, den)).select("a", "b"))


def joined(rows: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(uid, id, n_shingles, component_id, kept) of every row of `rows` (uid, id, text).

    Sets of `k`-word shingles link from a similarity of num / den.

    kept: whether the row is its component's first, by id and row number; rows with empty sets are.
    """
    if not den * 6 < num * 10 <= den * 10:
        raise ValueError("the threshold has to be above 0.6 and 1 at most")
    sigs = stored(signatures(rows, k, num, den), "signatures")
    named = distinct_sets(sigs)
    roots = components(set_links(rows.select("uid", "text"), sigs, named, k, num, den))
    of_set = named.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("hash", "hash2", F.coalesce("root", "sid").alias("label"))
    # stored, so that the join with rows, of which many may have one set, is one of plain shuffles
    of_set = stored(of_set, "set_labels")
    own = rows.select(F.col("uid").alias("__u"), "id").join(sigs.select("uid", "n", "hash", "hash2"), F.col("__u") == F.col("uid"))
    # rows without words have no set
    labelled = stored(own.join(of_set, ["hash", "hash2"], "left").select("uid", "id", "n", F.when(F.col("n") > 0, F.col("label")).alias("label")), "labels")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid"))
    # stored, so that the join is one of plain shuffles, whose hot labels Spark can split
    least = stored(labelled.where("n > 0").groupBy("label").agg(first.alias("first")), "least")
    filled = F.col("n") > 0
    out = labelled.join(least, "label", "left")
    return out.select("uid", "id", F.col("n").alias("n_shingles"), F.when(filled, F.col("first.id")).otherwise(F.col("id")).alias("component_id"), (~filled | (F.col("first.uid") == F.col("uid"))).alias("kept"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = joined(numbered(table(spark, sf_dir, "documents")))
    return done.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
