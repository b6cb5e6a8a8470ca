"""N-gram Jaccard join: sets of word shingles in a prefix tree, dealt out by the prefix filter, and the groups that links make."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut_table, drop_table, likely_among, table
from auditlake.llm.shingles import shingle_hashes

#: 100 * intersection >= 75 * union.
PERCENT = 75
#: Shingles in more than one of so many documents come last in the global order: the most frequent of them, so many at most, as they
#: are sent to every task. Any order gives the same links.
FREQUENT_SHARE = 8192
KNOWN = 400_000
COUNT_BLOCK = 2_000_000
#: Sets of a prefix tree and members of a block of a bucket.
TREE = 256
BLOCK = 1024
#: Rounds in which each member of a bucket is compared with its nearest of another component only.
NEAREST_ROUNDS = 3
#: Bits of the bitmaps in a tree, at most.
WIDEST = 4096
#: Rows of blocks that a task compares, about.
TASK_ROWS = 4_096
#: Sets that link differ in size by 4/3 at most, so their classes of size, each this much wider than the one before, are equal or neighbours.
SIZE_STEP = 1.4
#: A class has its rows (one for each element of its prefix) dealt by parts of so many, a shingle known as frequent by so many shares.
ROWS_TOGETHER = 512
SHARES = 64
#: Sets of more copies than one row in so many are looked up in a table of their own, which has at most so many rows.
HOT_SETS = 1000


class GlobalOrder:
    """A total order of shingles: first those not known as frequent, by hash, then the frequent ones, rarest first.

    Which are known changes the speed of the join, not its result. ``codes`` turns hashes into numbers in this order.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by_count = np.lexsort((hashes, counts))
        rank = np.empty(len(hashes), np.uint64)
        rank[by_count] = np.arange(len(hashes), dtype=np.uint64)
        by_hash = np.argsort(hashes)
        self.hashes, self.rank = hashes[by_hash], rank[by_hash]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        codes = hashes >> np.uint64(1)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            codes[known] = np.uint64(1 << 63) + self.rank[at[known]]
        codes.sort()
        return codes


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Shared elements that sets of n and m elements need: percent / (100 + percent) of n + m, rounded up."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of two sets that link, the first elements in the global order, so many of each, have one in common."""
    return n - -(-percent * n // 100) + 1


def _map_width(n: int) -> int:
    """One to two bits for each of n elements, 64 at least: sets that share nothing still differ in twice the bits that may differ."""
    return 64 << max(0, (n - 1).bit_length() - 6)


def parity_bits(hashes: np.ndarray, width: int | None = None) -> np.ndarray:
    """A bitmap in which each element toggles one bit. Bits in which two sets' maps differ are no more than the elements in which the
    sets differ; a wider map folds onto a narrower one."""
    width = width or _map_width(len(hashes))
    toggled = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(toggled.astype(bool), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Maps (rows of words) folded to a narrower width."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


class PrefixTree:
    """The prefix tree of some sets (sorted arrays of codes), which any number of probes can be searched in.

    It is read off the sets' sorted order: a range of sets that agree up to a depth is a node, the stretch until they part its edge.
    Going down an edge adds its shared elements once for all sets below. Elements of the edge that the probe lacks, and elements of
    the probe passed over, only grow; with the least and largest set below they bound the overlap, and a node that can't reach
    it any more is left with everything under it.
    """

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.agree = np.zeros(len(sets), np.int64)  # elements shared with the set before
        for i in range(1, len(sets)):
            n = min(len(self.sets[i]), len(self.sets[i - 1]))
            differ = np.flatnonzero(self.sets[i][:n] != self.sets[i - 1][:n])
            self.agree[i] = differ[0] if len(differ) else n

    def search(self, probe: np.ndarray, percent: int = PERCENT, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
        """(place, shared elements) of the sets that link with the probe; of the ``wanted`` ones, if these are marked (in the tree's
        order): a node without any is not entered."""
        found, nodes = [], [(0, len(self.sets), 0, 0)] if len(probe) and self.sets else []
        before = None if wanted is None else np.concatenate(([0], np.cumsum(wanted)))
        while nodes:
            low, high, depth, shared = nodes.pop()
            below = self.sizes[low:high]
            least, most = int(below.min()), int(below.max())
            until = int(min(self.agree[low + 1 : high].min(initial=least), least))
            edge = self.sets[low][depth:until]
            passed = 0
            if len(edge):
                at = np.searchsorted(probe, edge)
                hit = probe[np.minimum(at, len(probe) - 1)] == edge
                hit &= at < len(probe)
                shared += int(hit.sum())
                passed = int(at[-1] + hit[-1]) - shared
            lacking = until - shared
            if most - lacking < least_overlap(len(probe), most, percent) or len(probe) - passed < least_overlap(len(probe), least, percent):
                continue
            first = low
            while first < high and self.sizes[first] == until:
                if shared >= least_overlap(len(probe), until, percent) and (wanted is None or wanted[first]):
                    found.append((self.order[first], shared))
                first += 1
            if first < high:
                starts = np.concatenate(([first], np.flatnonzero(self.agree[first + 1 : high] == until) + first + 1, [high]))
                entered = slice(None) if before is None else np.flatnonzero(before[starts[1:]] > before[starts[:-1]])
                nodes += [(a, b, until, shared) for a, b in zip(starts[:-1][entered].tolist(), starts[1:][entered].tolist(), strict=True)]
        return found


def frequent_shingles(docs: DataFrame) -> GlobalOrder:
    """The order made from shingles that are frequent in blocks of documents; counts are summed over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, total = [], 0

        def counted() -> pd.DataFrame:
            hashes, counts = np.unique(np.concatenate(waiting), return_counts=True)
            often = counts >= max(3, len(waiting) / FREQUENT_SHARE)
            return pd.DataFrame({"shingle": hashes[often].view(np.int64), "n": counts[often]})

        for batch in batches:
            for text in batch["text"]:
                hashes = shingle_hashes(text)
                waiting.append(hashes)
                total += len(hashes)
                if total >= COUNT_BLOCK:
                    yield counted()
                    waiting, total = [], 0
        if waiting:
            yield counted()

    least = max(3, docs.select(F.lit(1)).count() // FREQUENT_SHARE)
    counts = docs.select("text").mapInPandas(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = cut_table(counts.where(F.col("n") >= least))
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).count().orderBy(F.desc("step")).collect()
    total, lowest = 0, None
    for row in steps:  # from the most frequent on, as many as may be known
        total += row["count"]
        if total > KNOWN:
            break
        lowest = row["step"]
    chosen = counts.where(F.floor(F.log2("n") * 16) >= lowest).collect() if lowest is not None else []
    drop_table(counts)
    return GlobalOrder(np.array([r[0] for r in chosen], np.int64).view(np.uint64), np.array([r[1] for r in chosen], np.int64))


_SKETCH = "doc_id string, text_hash long, n_shingles long, key long, prefix array<long>, bits binary"


def sketches(docs: DataFrame, order: GlobalOrder) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (of the set; equal sets have equal keys), prefix codes and parity bits of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"], strict=True):
                hashes = shingle_hashes(text)
                key = int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)
                n = len(hashes)
                prefix = order.codes(hashes)[: prefix_length(n)] if n else hashes
                rows.append((doc_id, text_hash, n, key, prefix.view(np.int64), parity_bits(hashes).tobytes() if n else b""))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "n_shingles", "key", "prefix", "bits"])

    # Ids travel as text: among nulls pandas would make them floating-point numbers.
    rows = _named(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, _SKETCH)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: the two first name a document, even if ids repeat or are null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _first_document() -> Column:
    """Of a group, the document with the least id, and text hash where ids are equal; null ids come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")


def _same_document() -> Column:
    return F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))


def _may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements that differ in at least ``differ`` (and in no less than their sizes do) can link."""
    differ = np.maximum(differ, np.abs(n - m))
    return (100 + PERCENT) * ((n + m - differ) // 2) >= PERCENT * (n + m)


def _star_filter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        widths = pd.DataFrame({"a": pairs["bits_a"].map(len), "b": pairs["bits_b"].map(len)})
        keep = np.zeros(len(pairs), bool)
        for (wide, narrow), rows in widths.groupby(["a", "b"]).indices.items():
            maps = [np.frombuffer(b"".join(pairs[c].iloc[rows]), np.uint64).reshape(len(rows), -1) for c in ("bits_a", "bits_b")]
            x, y = (fold(m, min(wide, narrow) // 8) for m in maps)
            differ = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
            keep[rows] = _may_link(pairs["n_a"].to_numpy()[rows], pairs["n_b"].to_numpy()[rows], differ)
        yield pairs.loc[keep, ["a", "b", "block"]]


def _may_have_partners(
    sizes: np.ndarray, component: np.ndarray, part: np.ndarray, maps: list[np.ndarray], one_block: bool, nearest: bool
) -> np.ndarray:
    """Places of the members of one block, or of two, that may link with a member of another component (of two blocks: in the other
    block), and of these partners; or, of the partners that come after a member, only the nearest by the bitmaps."""
    widths = np.array([len(m) for m in maps])
    by_width = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
    stacked = {w: np.stack([maps[i] for i in places]) for w, places in by_width.items()}
    chosen_ones = np.zeros(len(sizes), bool)
    for w, wide in by_width.items():
        for narrow_w in (w, w // 2):
            if narrow_w not in by_width:
                continue
            narrow, folded = by_width[narrow_w], fold(stacked[w], narrow_w)
            for row, at in enumerate(wide.tolist()):
                other = component[narrow] != component[at]
                if not one_block:
                    other &= part[narrow] != part[at]
                if narrow_w == w:
                    other &= narrow > at
                chosen = np.flatnonzero(other)
                if len(chosen):
                    differ = np.bitwise_count(stacked[narrow_w][chosen] ^ folded[row]).sum(axis=1).astype(np.int64)
                    may = np.flatnonzero(_may_link(sizes[at], sizes[narrow[chosen]], differ))
                    if nearest and len(may):
                        may = may[[differ[may].argmin()]]
                    if len(may):
                        chosen_ones[at] = True
                        chosen_ones[narrow[chosen[may]]] = True
    return np.flatnonzero(chosen_ones)


def _block_members(rows: pd.DataFrame) -> pd.DataFrame:
    """block, key, component of ``_may_have_partners`` for each pair of blocks of a bucket in ``rows``; sets whose widths differ by more
    than one step can't link."""
    rows = rows.drop_duplicates(["code", "i", "j", "key"]).sort_values(["code", "i", "j", "key"], ignore_index=True)
    key, code, i, j = (rows[c].to_numpy() for c in ("key", "code", "i", "j"))
    new = np.flatnonzero((code[1:] != code[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    sizes, component, part, nearest = (rows[c].to_numpy() for c in ("n_shingles", "component", "part", "nearest"))
    maps = [np.frombuffer(b, np.uint64) for b in rows["bits"]]
    found, block = [], []
    for low, high in zip([0, *new.tolist()], [*new.tolist(), len(rows)], strict=True):
        own = slice(low, high)
        members = low + _may_have_partners(sizes[own], component[own], part[own], maps[own], bool(i[low] == j[low]), bool(nearest[low]))
        found += members.tolist()
        block += [f"{code[low]}:{i[low]}:{j[low]}"] * len(members)
    return pd.DataFrame({"block": pd.Series(block, dtype=object), "key": key[found].astype(np.int64), "component": component[found].astype(np.int64)})


def _joining_links(keys: list[int], component: list[int], probes: list[bool], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links found by searching the probes in the tree of all sets: so many as join the components that any links join. Bitmaps tell
    which sets may link with a probe, and the tree is entered only where such a set of another component is below."""
    tree = PrefixTree(sets)
    group = np.array(component)[tree.order]  # of each set, in the tree's order
    at = {place: i for i, place in enumerate(tree.order)}
    width = min(_map_width(int(tree.sizes.max())), WIDEST)
    maps = np.stack([parity_bits(s, width) for s in tree.sets])
    for place, own in enumerate(sets):
        if probes[place]:
            i = at[place]
            wanted = group != group[i]
            others = np.flatnonzero(wanted)
            differ = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1).astype(np.int64)
            wanted[others] = _may_link(tree.sizes[i], tree.sizes[others], differ)
            if not wanted.any():
                continue
            for other, _ in tree.search(own, wanted=wanted):
                mine, theirs = group[i], group[at[other]]
                if mine != theirs:
                    group[group == theirs] = mine
                    yield min(keys[place], keys[other]), max(keys[place], keys[other])


def _found_in_trees(order: GlobalOrder):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, keys, component, probes, sets = None, [], [], [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for at, key, its, probe, text in zip(*(batch[c] for c in ("block", "key", "component", "probe", "text")), strict=True):
                if at != block:
                    out += _joining_links(keys, component, probes, sets) if len(keys) > 1 else []
                    block, keys, component, probes, sets = at, [], [], [], []
                if not keys or key != keys[-1]:  # rows are in the order of block and key
                    keys.append(int(key))
                    component.append(int(its))
                    probes.append(bool(probe))
                    sets.append(order.codes(shingle_hashes(text)))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        last = list(_joining_links(keys, component, probes, sets)) if len(keys) > 1 else []
        yield pd.DataFrame(last, columns=["a", "b"]).astype("int64")

    return run


def verified(members: DataFrame, texts: DataFrame, order: GlobalOrder) -> DataFrame:
    """a, b (a < b) of classes that link, among ``members`` (block, key, component, probe), enough to join all components that links
    join: the sets of a block's members are put into one prefix tree, in which those of its probes are searched. A block has
    a bounded number of members."""
    rows = members.join(texts, "key").repartition("block").sortWithinPartitions("block", "key")
    rows = rows.select("block", "key", "component", "probe", "text")
    return rows.mapInPandas(_found_in_trees(order), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """key, component (least key) of the nodes of ``edges`` (a, b), by alternating large-star and small-star steps: every node links
    its larger neighbours, then its smaller ones and itself, to the least it knows, until nothing changes."""
    edges = cut_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        last, edges = edges, cut_table(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        drop_table(last)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    members = edges.select(F.col("u").alias("key"), F.col("v").alias("component"))
    grouped = cut_table(members.unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct()))
    drop_table(edges)
    return grouped


def _size_class(n_shingles: Column) -> Column:
    return F.floor(F.log(n_shingles) / float(np.log(SIZE_STEP))).cast("int")


def _mixed(rows: DataFrame) -> DataFrame:
    """code, size_class of the rows (code, size_class, component) that have, in their bucket, a row of another component whose class of
    size is theirs or beside it. The others can't link there: a long text leaves the buckets in which all others are short."""
    own = rows.groupBy("code", "size_class").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    near = F.explode(F.array(F.col("size_class") - 1, "size_class", F.col("size_class") + 1)).alias("size_class")
    around = own.repartition("code").select("code", near, "lo", "hi").groupBy("code", "size_class")  # no second shuffle
    return around.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("code", "size_class")


def _parts(n_shingles: Column) -> Column:
    """Parts in which the prefix of a set of so many shingles is dealt; at least its number of elements in parts of ROWS_TOGETHER."""
    return F.ceil((n_shingles / 4 + 1) / ROWS_TOGETHER).cast("int")


def _each_part(rows: DataFrame, parts: Column) -> DataFrame:
    return rows.withColumn("part_of_key", F.explode(F.sequence(F.lit(0), parts - 1)))


def _share() -> Column:
    """Rows of a shingle known as frequent (its code is negative as a long) are dealt by their class, too."""
    return F.when(F.col("code") < 0, F.pmod(F.xxhash64("key"), F.lit(SHARES))).otherwise(0).cast("int")


def _each_share(codes: DataFrame) -> DataFrame:
    return codes.withColumn("share", F.explode(F.when(F.col("code") < 0, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))))


def _buckets(postings: DataFrame) -> DataFrame:
    """key, size_class, code, part_of_key, share, members, centre, centre_class of the postings in buckets of several classes; of buckets
    of a kind (frequent or not) with the same members, in the one of the least code."""

    def of(rows: DataFrame) -> DataFrame:
        # The greatest part is not used, but with it the count and the join below need the same columns, so one shuffle serves both.
        bucket = rows.groupBy("code").agg(
            F.count("*").alias("members"),
            F.min(F.struct("key", "size_class")).alias("centre"),
            F.bit_xor(F.xxhash64("key")).alias("all"),
            F.max("part_of_key").alias("part"),
        )
        bucket = bucket.where("members > 1 and part >= 0").groupBy("members", "centre", "all").agg(F.min("code").alias("code"))
        return bucket.select("code", "members", F.col("centre.key").alias("centre"), F.col("centre.size_class").alias("centre_class"))

    rare = postings.where("code >= 0").repartition("code")
    common = postings.where("code < 0")
    shared = rare.join(of(rare), "code").withColumn("share", F.lit(0))
    return shared.unionByName(common.withColumn("share", _share()).join(_each_share(of(common)), ["code", "share"]))


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches of ``docs`` and, of the classes that link with another, key and component (see ``near_copies``).

    Classes that link share an element among the first quarter of their sets in the global order, so these elements are the buckets
    of the join; elements in one class only and buckets with the same members as another drop out. First the members of a bucket are
    put in trees in which its one centre is searched, which connects groups of copies of any size with as many comparisons as
    members. Then only buckets that still hold several components in sets of about one size are looked at. Bitmaps find the members that may have a
    partner in another component; their sets are put in a tree, in which each of them is searched, and a subtree is left once all
    of it is in the component of the probe: a block gives fewer links than it has members. Buckets of one block take one round. Larger
    ones go in pairs of blocks: in a few rounds for each member's nearest, which joins what is left of large groups, and in a last
    one for all.
    """
    order = frequent_shingles(docs)
    whole = cut_table(sketches(docs, order))
    classes = whole.where("n_shingles > 0").select("key", "n_shingles", "prefix").dropDuplicates(["key"])
    postings = classes.select("key", _size_class(F.col("n_shingles")).alias("size_class"), F.posexplode("prefix").alias("at", "code"))
    shared = cut_table(_buckets(postings.select("key", "size_class", "code", F.floor(F.col("at") / ROWS_TOGETHER).cast("int").alias("part_of_key"))))

    members = whole.where("n_shingles > 0").groupBy("key")
    members = members.agg(_first_document(), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    members = members.join(shared.select("key").distinct(), "key", "left_semi")
    maps = cut_table(members.select("key", "first.doc_id", "first.text_hash", "n_shingles", "bits"))
    sketch = cut_table(whole.select("doc_id", "text_hash", "n_shingles", "key"))
    drop_table(whole)

    # Members of a large bucket have one centre, and long sets are in many buckets: both sides are dealt in parts.
    pairs = shared.where("key != centre and abs(size_class - centre_class) <= 1").groupBy(F.col("centre").alias("a"), F.col("key").alias("b"))
    pairs = pairs.agg(F.max("members").alias("members"), F.min("part_of_key").alias("part_of_key"))
    trees = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("members") / TREE, F.lit(1.0))))).cast("int")
    pairs = pairs.withColumn("trees", trees).withColumn("tree", F.pmod(F.xxhash64("b"), F.col("trees")).cast("int"))
    side = lambda s: maps.select(F.col("key").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    centres = pairs.select("a", "trees").distinct().join(side("a"), "a")
    centres = centres.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    others = _each_part(side("b"), _parts(F.col("n_b")))
    block = F.concat_ws(":", "a", "trees", "tree").alias("block")
    both = pairs.join(others, ["b", "part_of_key"]).join(centres, ["a", "trees", "tree"])
    first = cut_table(both.select("a", "b", block, "n_a", "n_b", "bits_a", "bits_b").mapInPandas(_star_filter, "a long, b long, block string"))

    def texts_of(some: DataFrame) -> DataFrame:
        """key, text of the classes in ``some``, each from its first document, which may lack an id or share it."""
        ids = maps.select("key", "doc_id", "text_hash").join(some.select("key").distinct(), "key", "left_semi")
        rows = likely_among(_named(docs), ids, ["doc_id", "text_hash"]).alias("a").join(ids.alias("b"), _same_document())
        return rows.select("key", "text").dropDuplicates(["key"])

    star = first.select("block", F.col("b").alias("key"), F.lit(False).alias("probe"))
    star = star.unionByName(first.select("block", F.col("a").alias("key")).distinct().withColumn("probe", F.lit(True)))
    star = star.withColumn("component", F.col("key"))
    links = cut_table(verified(star, texts_of(star), order))
    grouped = components(links)
    drop_table(first, links)
    turn = 0
    while True:
        nearest = turn < NEAREST_ROUNDS
        compared = shared if turn == 0 else shared.where(F.col("members") > BLOCK)
        named = maps.select("key", "n_shingles").join(grouped, "key")
        left = compared.join(_each_part(named, _parts(F.col("n_shingles"))).drop("n_shingles"), ["key", "part_of_key"], "left")
        left = cut_table(left.withColumn("component", F.coalesce("component", "key")))
        rows = left.join(_each_share(_mixed(left)), ["code", "size_class", "share"], "left_semi").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        beside = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        rows = rows.select("code", "key", "component", "part_of_key", "part", (F.lit(nearest) & (F.col("blocks") > 1)).alias("nearest"), beside)
        rows = cut_table(rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other"))
        drop_table(left)
        tasks = max(1, rows.count() // TASK_ROWS)
        task = F.pmod(F.xxhash64("code", "i", "j"), F.lit(tasks)).alias("task")
        wide = _each_part(maps.select("key", "n_shingles", "bits"), _parts(F.col("n_shingles")))
        near = cut_table(rows.join(wide, ["key", "part_of_key"]).groupBy(task).applyInPandas(_block_members, "block string, key long, component long"))
        drop_table(rows)
        # Of blocks with the same such members, one is enough.
        once = near.groupBy("block").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.bit_xor(F.xxhash64("key")).alias("all"))
        once = once.groupBy("n", "least", "all").agg(F.min("block").alias("block")).select("block")
        chosen = cut_table(near.join(once, "block", "left_semi").withColumn("probe", F.lit(True)))
        links = cut_table(verified(chosen, texts_of(chosen), order))
        drop_table(near, chosen)
        found = links.limit(1).count() > 0
        if found:
            last, grouped = grouped, components(links.unionByName(grouped.select(F.col("key").alias("a"), F.col("component").alias("b"))))
            drop_table(last)
        drop_table(links)
        # Buckets of one block are done. Where no nearest link is found any more, on to all.
        if not nearest or not shared.where(F.col("members") > BLOCK).limit(1).count():
            break
        turn = turn + 1 if found else NEAREST_ROUNDS
    drop_table(shared, maps)
    return sketch, grouped


def _with_component(sketch: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of ``sketch`` with the component_id that ``result`` (key, copies, component_id) gives their set. A set with very many
    copies, of which there are at most HOT_SETS, is looked up without a shuffle of its rows; rows without words have none."""
    many = max(1, sketch.select(F.lit(1)).count() // HOT_SETS)
    hot = F.broadcast(result.where(F.col("copies") > many).drop("copies"))
    worded = sketch.where("n_shingles > 0").select("doc_id", "n_shingles", "key")
    of_hot = worded.join(hot, "key")
    others = worded.join(hot, "key", "left_anti").join(result.where(F.col("copies") <= many).drop("copies"), "key")
    empty = sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return of_hot.unionByName(others).drop("key").unionByName(empty)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; other columns are left out).

    Two documents link if 100 * |intersection| >= 75 * |union| of their sets of 5-word shingles; component_id is the smallest doc_id
    reachable. Documents without words link with nothing. Equal sets are one class and are joined once (classes are told apart by
    a 64-bit hash of the set); repeated rows get equal results; a null id counts as smaller than none and is no component_id
    unless all of its group are null.
    """
    sketch, grouped = linked_classes(docs)
    owner = sketch.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    named = owner.join(grouped, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    result = cut_table(named.select("key", "copies", "component").join(least, "component").select("key", "copies", "component_id"))
    drop_table(grouped)
    return _with_component(sketch, result).withColumn("component_id", F.coalesce("component_id", "doc_id"))


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first document of their group of near copies, each document (id and text) once. Rows without
    words, which link with nothing, stay; so do rows without an id, or with the id of another text, that no other row is near."""
    sketch, grouped = linked_classes(docs)
    of_set = sketch.where("n_shingles > 0").groupBy("key").agg(_first_document())
    worded = of_set.join(grouped, "key", "left").groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("first").alias("first"))
    first = worded.select("first.doc_id", "first.text_hash").unionByName(sketch.where("n_shingles = 0").select("doc_id", "text_hash").distinct())
    first = cut_table(first)
    drop_table(sketch, grouped)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    kept = named.alias("a").join(first.alias("b"), _same_document(), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.select("own.*")


def op7_near_copies(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; see ``near_copies``."""
    return near_copies(table(spark, sf_dir, "documents"))


def near_copies_sql(documents: str = "documents") -> str:
    """DuckDB SQL for op7_near_copies on small tables: every pair that shares a shingle is counted."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id, doc_id AS reach FROM {documents} UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(reach) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM {documents} d LEFT JOIN n USING (doc_id)"""
