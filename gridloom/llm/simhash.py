"""SimHash near-duplicates, with pivot distance tables.

Every distinct fingerprint has a table of its Hamming distances to fixed reference fingerprints (pivots), computed once and
carried along. By the triangle inequality two fingerprints within `RADIUS` bits differ by RADIUS at most in every
coordinate of that table: a pair whose maximum coordinate difference is larger is discarded, and the survivors are verified
bit by bit. Of random pairs 16 pivots discard more than 99.9% at 4 of 64 bits.

Which pairs are looked at: comparing all would grow with the square of the corpus. So fingerprints first meet in groups
that lose no pair: cut into `BLOCKS` blocks, two fingerprints within RADIUS bits agree on BLOCKS - RADIUS blocks at least,
so each fingerprint joins one group for each choice of that many blocks. Within a group the pivot table decides, and only a
spanning forest of the links leaves it.

Blocks are as many as the fingerprints ask for: 6 give 15 groups of 21 agreeing bits for each fingerprint, 7 give 35 of 27
bits, 8 give 70 of 32; the fewest that leave `CROWD` unrelated fingerprints or fewer in a group on average are taken. So the copies of a
fingerprint that share a group with another grow with the corpus until they are all, and no further.

A group of more than `GROUP` members is dealt twice at random into parts of about that size, and the links found within
the parts joined to components: a dense group falls into one, with fewer than two links and two copies a member. What is
left is exact: members outside of a group's largest component meet all other members once more, a part of them with a part
of the others in a task, and pairs that a component joins already are skipped. If more than `REST` members are outside, the
group is one of unlike members that agree in some bits: it is dealt again by blocks of the bits that it doesn't agree in (they
too lose no pair), up to `LEVELS` times. So comparisons grow in proportion to a group's members, like or unlike.

Documents with shingles in common by a given similarity (`near_dedup`: 0.8 of the shingles of five words) lie up to 18 of
64 bits apart, where unrelated ones lie too. There fingerprints have `WIDE` words of 64 bits, and agreeing blocks would be
too short to part a corpus: `BANDS` keys of `ROWS` min-hashes each form the groups instead (a pair of similarity 0.8
shares none with a chance of 0.0004); of groups with the same members one is looked at. Pivots of whole wide fingerprints
would discard nothing, as distances of unrelated ones hardly spread. So each byte of a fingerprint has `BYTE_PIVOTS`
pivots of its own, and the table says the distances of every byte to its pivots: the maximum coordinate differences of the
bytes, added up, are never more than the distance in bits, and a pair is discarded where they exceed the radius. That
discards all but one in a thousand unrelated pairs at most (a test measures it). The radius is so wide that pairs at the
similarity are not lost; texts of fewer than `SHORT` shingles, too few for a fingerprint to tell, are proposed at once. A
proposed pair is a link only if the sets of its shingles' 64-bit hashes have the similarity. A large group of unlike members, which
share min-hashes (say of one long passage) but not that many shingles, is dealt again by its members' rarest shingles.

Cases: a null text is empty. Texts without a word have fingerprint zero and link like any other. Texts of fewer words
than a shingle are one shingle. No rows give no rows. Repeated rows are copies. Further columns are ignored by
`near_duplicates` and kept by `near_dedup`, under whatever names; very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import bloom
from gridloom.llm.common import hot_join, place_of, plain_names, row_hashes, written
from gridloom.llm.graph import components
from gridloom.llm.tokens import let_go

#: Fixed values of the fingerprint: seed of XXH64, words in a shingle.
SEED = 42
SHINGLE = 4
RADIUS = 4
BLOCKS = 6
#: Unrelated fingerprints that a group may hold on average; members outside of the largest component beyond which a group is dealt by further blocks; how often.
CROWD = 16
REST = 2048
LEVELS = 3
PIVOTS = 16
BYTE_PIVOTS = 4
#: Members of a group that one task compares, and how often a larger one is dealt at random.
GROUP = 1024
DEALS = 2
#: Wide fingerprints: words, bits that may differ in a proposed pair (similarity 0.8 is 155 on average, with a deviation of 11), keys, min-hashes in each.
WIDE = 16
WIDE_RADIUS = 240
BANDS = 20
ROWS = 5
#: Shingles below which fingerprints propose nothing, and the similarity of a link as a fraction.
SHORT = 128
SIMILAR = (4, 5)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, in a text in UTF-8; none without a word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and the six white-space bytes
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - shingle + 1].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(begins))


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """For rows of 64-bit words: how many rows have each bit set."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for k in range(0, len(hashes), 255):
        block = np.ascontiguousarray(hashes[k : k + 255]).view(np.uint8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return ones


def majority(ones: np.ndarray, n: int) -> np.ndarray:
    """Words whose bits are 1 where over half of n rows have 1."""
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8: a bit is 1 if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, shingle)
    return int(majority(set_bits(hashes[:, None]), len(hashes))[0])


def _mixed(h: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A hash of each h for each odd multiplier."""
    x = h[:, None] * odd[None, :]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def wide_sketch(text: bytes, shingle: int) -> tuple[bytes, np.ndarray, list[int]]:
    """A digest of the set of a text's shingles, WIDE words of SimHash over the set, and its BANDS grouping keys."""
    from xxhash import xxh64_intdigest

    odd = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE + BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.unique(shingle_hashes(text, shingle))
    digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
    if not len(h):
        h = np.zeros(1, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    ones = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(h), 4096):
        ones += set_bits(_mixed(h[k : k + 4096], odd[:WIDE]))
        least = np.minimum(least, _mixed(h[k : k + 4096], odd[WIDE:]).min(axis=0))
    keys = [xxh64_intdigest(row.tobytes(), j) for j, row in enumerate(least.reshape(BANDS, ROWS))]
    return digest, majority(ones, len(h)), [x - (1 << 64) if x >> 63 else x for x in keys]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint (a row of words) to its pivots, as rows of small numbers.

    One word has PIVOTS pivots; several have BYTE_PIVOTS for each byte. Pivots are fixed and independent of the data.
    """
    rng = np.random.default_rng(SEED)
    if fps.shape[1] == 1:
        return np.bitwise_count(fps ^ rng.integers(0, 1 << 64, PIVOTS, np.uint64)[None, :]).astype(np.int8)
    octets = np.ascontiguousarray(fps).view(np.uint8)
    reference = rng.integers(0, 256, (octets.shape[1], BYTE_PIVOTS), np.uint8)
    return np.bitwise_count(octets[:, :, None] ^ reference[None]).astype(np.int8).reshape(len(fps), -1)


def not_discarded(table: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of rows of a pivot table may be within `radius` bits: those whose maximum coordinate difference, or the sum of each byte's, is not larger."""
    kept = np.arange(len(left))
    if table.shape[1] == PIVOTS:
        for k in range(0, PIVOTS, 4):
            kept = kept[np.abs(table[left[kept], k : k + 4] - table[right[kept], k : k + 4]).max(axis=1, initial=0) <= radius]
        return kept
    low = np.zeros(len(left), np.int16)
    for k in range(0, table.shape[1], 16 * BYTE_PIVOTS):
        part = slice(k, k + 16 * BYTE_PIVOTS)
        differences = np.abs(table[left[kept], part] - table[right[kept], part]).reshape(len(kept), 16, BYTE_PIVOTS)
        low[kept] += differences.max(axis=2).sum(axis=1, dtype=np.int16)
        kept = kept[low[kept] <= radius]
    return kept


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, a row of words each."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int16)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, pivots): each row's fingerprint, as a signed long with the same bits, and its distances to the pivots as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            near = [x.tobytes() for x in pivot_table(fps[:, None])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), pa.array(near, pa.binary())], names=["doc_id", "fp", "pivots"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, pivots binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have SIMILAR of their union in common."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def spanning_links(key: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int = RADIUS, sets: list[np.ndarray] | None = None, known: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Places of pairs that join what is within `radius` in runs of equal keys: a spanning forest of each run.

    With `sets` of shingles, those pairs are proposals, and so are all with a short set; what is joined is similar. Places
    with the same number in `known` are joined already.
    """
    n = len(fps)
    left: list[int] = []
    right: list[int] = []
    label = np.arange(n)
    if known is not None:
        _, first, back = np.unique(np.stack([key, known]), axis=1, return_index=True, return_inverse=True)
        label = first[back.ravel()]
    sizes = None if sets is None else np.array([len(x) for x in sets])
    for off in range(1, n):
        at = np.flatnonzero(key[off:] == key[:-off])
        if not len(at):
            break
        at = at[label[at] != label[at + off]]
        short = at[:0]
        if sizes is not None:
            less, more = np.minimum(sizes[at], sizes[at + off]), np.maximum(sizes[at], sizes[at + off])
            can = less * SIMILAR[1] >= more * SIMILAR[0]
            short, at = at[can & (less < SHORT)], at[can & (less >= SHORT)]
        at = at[not_discarded(table, at, at + off, radius)]
        at = np.concatenate([short, at[distances(fps[at], fps[at + off]) <= radius]])
        if not len(at):
            continue
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            while x in parent:
                x = parent[x]
            return x

        for i in at.tolist():
            a, b = find(int(label[i])), find(int(label[i + off]))
            if a != b and (sets is None or similar(sets[i], sets[i + off])):
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + off)
        changed = np.isin(label, np.fromiter(parent, np.int64, len(parent)))
        label[changed] = [find(x) for x in label[changed].tolist()]
    return left, right


def _linked(dealt: DataFrame, radius: int, by_sets: bool) -> DataFrame:
    """Links (a, b) within equal keys of `dealt`: node, key, known, pivots and, if `by_sets`, fp and shingles; else the node is its own fingerprint."""
    names = ["key", "node", "known", "pivots", *["fp", "shingles"] * by_sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None:
                continue
            key = held.column("key").to_numpy()
            # the last run may go on in the next batch
            end = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            if end:
                now = held.slice(0, end).combine_chunks()
                node, known = now.column("node").to_numpy(), now.column("known").to_numpy()
                table = np.frombuffer(b"".join(now.column("pivots").to_pylist()), np.int8).reshape(end, -1)
                fps = np.frombuffer(b"".join(now.column("fp").to_pylist()) if by_sets else np.ascontiguousarray(node).tobytes(), np.uint64).reshape(end, -1)
                sets = [np.frombuffer(x, np.uint64) for x in now.column("shingles").to_pylist()] if by_sets else None
                a, b = spanning_links(key[:end], fps, table, radius, sets, known)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])
                held = held.slice(end)
                del now, table, fps, sets

    return dealt.select(*names).repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def _span(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.sequence(F.lit(0), n.cast("int") - 1)


def links_in_groups(keyed: DataFrame, facts: DataFrame | None, radius: int, group: int = GROUP, finer: Callable[[DataFrame], DataFrame] | None = None, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) that join all nodes that share a key and lie within `radius` bits of each other.

    `keyed` is a written table with (node, key), a node once under a key. `facts` has (node, fp, pivots, shingles): a
    fingerprint's words, its pivot table and a sorted set of shingles' hashes, all as bytes; links are similar by the sets.
    Without it `keyed` has the pivots, and a node is its own fingerprint of one word. `finer` deals the members of groups
    to smaller ones without losing a pair; groups with many members outside of the largest component go through it.
    """
    by_sets = facts is not None
    full = (lambda x: x.join(facts, "node")) if by_sets else (lambda x: x)
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    met = hot_join(keyed, sizes, "key", "n", keyed.count())
    # small groups are one part, large ones are dealt at random, more than once
    parts = F.ceil(F.col("n") / group)
    deal = F.array(*(F.pmod(F.xxhash64(F.col("node"), F.lit(k)), parts) + F.lit(k << 40) for k in range(DEALS)))
    part = F.explode(F.when(F.col("n") <= group, F.array(F.lit(0).cast("long"))).otherwise(deal))
    dealt = full(met).withColumn("part", part).withColumn("key", F.xxhash64("key", "part")).withColumn("known", F.col("node"))
    links = _linked(dealt, radius, by_sets)
    hot = sizes.filter(F.col("n") > group)
    if hot.isEmpty():
        return links
    # the rest of large groups, exactly
    links = written(links, "group-links")
    hot_rows = hot_join(keyed, hot, "key", "n", keyed.count()).join(components(links), "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root")
    hot_rows = written(hot_rows, "group-rows")
    each = hot_rows.groupBy("key", "known").agg(F.count(F.lit(1)).alias("k"))
    largest = each.groupBy("key").agg(F.max(F.struct("k", "known")).alias("top"), F.sum("k").alias("m")).select("key", "m", F.col("top.known").alias("most"), (F.col("m") - F.col("top.k")).alias("others"))
    largest = written(largest.filter("others > 0"), "group-largest")
    if finer is not None and levels > 1:
        unlike = largest.filter(F.col("others") > REST)
        if not unlike.isEmpty():
            members = hot_join(keyed, unlike.select("key", "m"), "key", "m", keyed.count()).drop("m")
            again = written(finer(members), "groups-again")
            links = links.unionByName(links_in_groups(again, facts, radius, group, finer, levels - 1))
            largest = largest.filter(F.col("others") <= REST)
    left = hot_join(hot_rows, largest, "key", "m", hot_rows.count())
    parts, other_parts = F.ceil(F.col("m") / group), F.ceil(F.col("others") / group)
    mine, theirs = F.pmod(F.xxhash64("node"), parts), F.pmod(F.xxhash64("node", F.lit(1)), other_parts)
    cell = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    row, column = F.transform(_span(other_parts), lambda j: cell(mine, j)), F.transform(_span(parts), lambda i: cell(i, theirs))
    cells = F.when(F.col("known") == F.col("most"), row).otherwise(F.array_distinct(F.concat(row, column)))
    dealt = full(left).withColumn("cell", F.explode(cells)).withColumn("key", F.xxhash64("key", "cell.i", "cell.j", F.lit(7)))
    return links.unionByName(_linked(dealt, radius, by_sets))


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """How many blocks n fingerprints are cut into."""
    blocks = radius + 2
    while n > CROWD << (64 * (blocks - radius) // blocks) and blocks < 2 * radius:
        blocks += 1
    return blocks


def _runs(bits: list[int], blocks: int) -> list[list[int]]:
    """Places of bits, cut into blocks."""
    edges = [round(len(bits) * k / blocks) for k in range(blocks + 1)]
    return [bits[a:b] for a, b in itertools.pairwise(edges)]


def masks_after(path: tuple[int, ...], blocks: int, radius: int) -> list[int]:
    """Masks of the blocks that must agree next, for each choice of them, once a group agrees in the choices of `path`."""
    bits = list(range(64))
    for level in range(len(path) + 1):
        count = blocks if level == 0 else radius + 2
        choices = list(itertools.combinations(_runs(bits, count), count - radius))
        if level < len(path):
            taken = {b for run in choices[path[level]] for b in run}
            bits = [b for b in bits if b not in taken]
    return [sum(1 << b for run in chosen for b in run) for chosen in choices]


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, group: int = GROUP) -> DataFrame:
    """From distinct fingerprints (fp, pivots), a written table: links (a, b), signed longs, that join all within `radius` bits of each other."""
    blocks = blocks or blocks_for(fps.count(), radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    bits = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks_after((), blocks, radius)))).alias("choice", "bits")
    keyed = fps.select(F.col("fp").alias("node"), "pivots", bits).select("node", "pivots", F.array("choice").alias("path"), F.xxhash64("choice", "bits").alias("key"))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], np.ndarray] = {}
        for batch in batches:
            paths = [tuple(p) for p in batch.column(2).to_pylist()]
            for p in set(paths) - known.keys():
                known[p] = np.array(masks_after(p, blocks, radius), np.uint64)
            if paths:
                masks = np.stack([known[p] for p in paths])
                agreed = (batch.column(0).to_numpy().view(np.uint64)[:, None] & masks).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(agreed), pa.list_(pa.int64()))], names=["node", "pivots", "path", "key", "agreed"])

    def finer(members: DataFrame) -> DataFrame:
        rows = members.select("node", "pivots", "path", "key").mapInArrow(further, "node long, pivots binary, path array<int>, key long, agreed array<long>")
        rows = rows.select("node", "pivots", "path", "key", F.posexplode("agreed").alias("choice", "bits"))
        return rows.select("node", "pivots", F.array_append("path", F.col("choice")).alias("path"), F.xxhash64("key", "choice", "bits").alias("key"))

    return links_in_groups(keyed, None, radius, group, finer)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, fp, component_id (the smallest doc_id that its fingerprint's links reach)."""
    marked = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("pivots").alias("pivots"), F.count(F.lit(1)).alias("copies")), "classes")
    reached = components(near_links(classes.select("fp", "pivots"), radius)).withColumnRenamed("node", "fp")
    roots = classes.drop("pivots").join(reached, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = written(roots.join(least, "root").select("fp", "component_id", "copies"), "component-ids")
    return hot_join(marked.select("doc_id", "fp"), ids, "fp", "copies", marked.count()).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """`docs`, all columns, with one document of each near-duplicate group: that with its smallest doc_id.

    Near is a similarity of SIMILAR or more of the sets of shingles; wide fingerprints propose within `radius` bits. A row is
    known by hashes of all its columns, not by its id: rows with one id and different texts are different documents, rows
    that are equal in all columns are copies, and a row without an id stays only if its group has none with one. Texts with
    equal sets of shingles are one node. No text shuffles but those of groups with more than one row.
    """
    named, names = plain_names(docs)
    rows = named.withColumns(dict(zip(("r0", "r1"), row_hashes(named), strict=True)))
    text = F.coalesce(F.col(place_of(docs, text_col)).cast("string"), F.lit("")).cast("binary")
    best = F.struct(F.col(place_of(docs, id_col)).isNull().alias("none"), F.col(place_of(docs, id_col)).alias("id"), "r0", "r1")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            got = [wide_sketch(x.as_py(), shingle) for x in batch.column(1)]
            cols = [pa.array([d for d, _, _ in got], pa.binary()), pa.array([s.tobytes() for _, s, _ in got], pa.binary()), pa.array([k for _, _, k in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["best", "set_id", "fp", "keys"])

    asked = rows.select(best.alias("best"), text.alias("text"))
    kind = asked.schema["best"].dataType.simpleString()
    sketches = written(asked.mapInArrow(sketched, f"best {kind}, set_id binary, fp binary, keys array<long>").withColumn("node", F.monotonically_increasing_id()), "sketches")
    classes = written(sketches.groupBy("set_id").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("best").alias("best")), "classes")
    keyed = sketches.join(classes.select("node"), "node", "left_semi").select("node", F.explode("keys").alias("key")).distinct()
    # of groups with the same members, one
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"members{k}") for k in range(2)]
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *members).filter("n > 1").groupBy("n", "members0", "members1").agg(F.min("key").alias("key"))
    keyed = written(keyed.join(groups.select("key"), "key", "left_semi"), "groups")
    facts = written(_facts(rows, text, sketches, keyed, shingle), "facts")
    reached = components(links_in_groups(keyed, facts, radius, group, lambda members: by_rare_shingles(members, facts), 2))

    # what each component keeps, and which rows that concerns
    roots = classes.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keepers = roots.groupBy("root").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("sets"), F.min("best").alias("keep")).filter("n > 1")
    concerned = hot_join(written(roots.select("set_id", "copies", "root"), "roots"), written(keepers, "keepers"), "root", "sets", classes.count())
    decided = hot_join(sketches.select("set_id", "best"), written(concerned, "concerned"), "set_id", "copies", sketches.count())
    same = (F.col("best.r0") == F.col("keep.r0")) & (F.col("best.r1") == F.col("keep.r1"))
    decided = written(decided.groupBy(F.col("best.r0").alias("r0"), F.col("best.r1").alias("r1")).agg(F.max(same).alias("stays")), "decided")
    slots = bloom.slots_for(decided.count())
    straight, maybe = bloom.parted(rows, written(bloom.marks(decided.select(F.col("r0").alias("h")), slots), "marks"), "r0", slots)
    kept = maybe.join(decided, ["r0", "r1"], "left").filter("stays IS NULL OR stays")
    kept = kept.groupBy("r0", "r1").agg(F.first(F.struct(*names)).alias("row")).select(*(F.col(f"row.{c}").alias(c) for c in names))
    return straight.select(*names).unionByName(kept).toDF(*docs.columns)


def by_rare_shingles(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, key): members of groups dealt to smaller groups, one for each shingle among a member's rarest in its group.

    Two sets with SIMILAR of their union in common have one of the rarest in common, if of each so many are taken that fewer
    than that share is left. What most members share is common, so it joins none by itself.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, node, held in zip(*batch.columns, strict=True):
                shingles = np.frombuffer(held.as_py(), np.int64)
                n = len(shingles)
                numbers = (np.full(n, key.as_py()), np.full(n, node.as_py()), shingles, np.full(n, n))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in numbers], names=["key", "node", "shingle", "size"])

    rows = members.select("node", "key").join(facts.select("node", "shingles"), "node").select("key", "node", "shingles")
    rows = written(rows.mapInArrow(spread, "key long, node long, shingle long, size long"), "group-shingles")
    often = written(rows.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("n")), "group-shingle-counts")
    place = F.row_number().over(Window.partitionBy("key", "node").orderBy("n", "shingle"))
    ranked = hot_join(rows, often, ["key", "shingle"], "n", rows.count()).withColumn("place", place)
    rare = F.col("size") - F.ceil(F.col("size") * SIMILAR[0] / SIMILAR[1]) + 1
    return ranked.filter((F.col("place") <= rare) & (F.col("n") > 1)).select("node", F.xxhash64("key", "shingle").alias("key"))


def _facts(rows: DataFrame, text: Column, sketches: DataFrame, keyed: DataFrame, shingle: int) -> DataFrame:
    """(node, fp, pivots, shingles) of the nodes that are in a group."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], names=["r0", "r1", "shingles"])

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            near = [x.tobytes() for x in pivot_table(fps)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.binary())], names=["node", "r0", "r1", "fp", "pivots"])

    met = sketches.join(keyed.select("node").distinct(), "node", "left_semi").select("node", F.col("best.r0").alias("r0"), F.col("best.r1").alias("r1"), "fp")
    met = written(met.mapInArrow(tabled, "node long, r0 long, r1 long, fp binary, pivots binary"), "met")
    slots = bloom.slots_for(met.count())
    _, texts = bloom.parted(rows.select("r0", "r1", text.alias("text")), written(bloom.marks(met.select(F.col("r0").alias("h")), slots), "marks"), "r0", slots)
    sets = texts.mapInArrow(shingled, "r0 long, r1 long, shingles binary").groupBy("r0", "r1").agg(F.first("shingles").alias("shingles"))
    return met.join(sets, ["r0", "r1"]).select("node", "fp", "pivots", "shingles")
