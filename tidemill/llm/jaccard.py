"""N-gram Jaccard join (operator 6): exact links by set-relation skipping, and their components.

1. Blocks send the prints of their shingles to buckets, which answer how many sets hold each. That
   orders shingles from rare to common.
2. Two sets of similarity s share a shingle among the first n - ceil(s n) + 1 of each, and one that
   no other set holds is shared by none. Every block sends the rest of those, once per shingle
   however many of its documents hold it; buckets connect their holders to the smallest one.
   Connected holders form candidate groups.
3. The different sets of a group meet in one task (a group of over `limit` sets or `shingles`
   shingles in pairs of parts, dealt by content, each pair a task group of its own). Index lists of its shingles are kept by position in size order, with skip
   pointers every 256 positions, so a set reads only the blocks whose sizes can qualify. Sets follow
   one another by likeness, and a set's overlaps with all others are derived from its predecessor's
   by the few lists in which the two differ. No pairs are emitted, only each set's component and
   number of links.

Rows of equal sets join a class before anything is sent. Rows are told apart by their place, block
and position, not by doc_id: rows that repeat a doc_id with other texts keep their own links, and each
row's component_id is the smallest doc_id of its own component. A document without words has size 0 and
links with nothing, its component_id is its own doc_id. Rows with a null doc_id take no part and have
a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import answer_blocks, block_texts, each_block, hashed_texts, mixed, packed_blocks, ranges, rolling_hash, scratch, table, written

SCHEMA = "doc_id long, n_shingles long, component_id long, n_links long"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SKIP = 256
ROW_BITS = 24  #: a block of block_mb MB has under 2 ** 24 rows, each of which counts a byte at least


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    flat, counts = hashed_texts([t.translate(LOWER) for t in texts])
    hashes = mixed(rolling_hash(flat, k))
    out, a = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(hashes[a : a + n - k + 1]))
        elif n:
            out.append(mixed(rolling_hash(flat[a : a + n], n)) ^ np.uint64(0xA5A5A5A5 + n))
        else:
            out.append(np.zeros(0, np.uint64))
        a += n
    return out


def classes(block: int, ids: list, sets: list[np.ndarray]) -> tuple[dict, list]:
    """First row of each distinct non-empty set, to its set; and that row for each row (or None)."""
    first: dict[bytes, int] = {}
    keys = [s.tobytes() if len(s) and i is not None else b"" for i, s in zip(ids, sets)]
    for row, key in enumerate(keys, block << ROW_BITS):
        if key:
            first.setdefault(key, row)
    return {row: np.frombuffer(key, np.uint64) for key, row in first.items()}, [first[k] if k else None for k in keys]


def shared_counts(blocks: DataFrame, k: int, n_buckets: int) -> DataFrame:
    """(block, bucket, codes): for each block its distinct 32-bit shingle prints in ascending order,
    by bucket, and for each a code of how many sets hold the print: 0 for one, else 8 log2."""

    def send(block: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        ids, texts = block_texts(blob)
        held, _ = classes(block, ids, shingle_sets(texts, k))
        prints, times, ends = split_prints(held, n_buckets)
        some = [(b, a, e) for b, (a, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if a < e]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([block] * len(some), pa.int64()), "bucket": pa.array([b for b, _, _ in some], pa.int64()), "first": pa.array([int(prints[a]) for _, a, _ in some], pa.int64()),
            "gaps": pa.array([squeezed(np.diff(prints[a:e], prepend=prints[a : a + 1]).tobytes()) for _, a, e in some], pa.binary()),
            "times": pa.array([squeezed(times[a:e].tobytes()) for _, a, e in some], pa.binary()),
        })

    def answer(rows: pa.Table) -> pa.Table:
        own = [np.cumsum(np.frombuffer(opened(g.as_py()), np.uint32), dtype=np.uint32) + np.uint32(f.as_py()) for g, f in zip(rows["gaps"], rows["first"])]
        times = np.concatenate([np.frombuffer(opened(t.as_py()), np.uint16) for t in rows["times"]])
        _, where = np.unique(np.concatenate(own), return_inverse=True)
        codes = np.minimum(np.log2(np.maximum(np.bincount(where, weights=times), 1)) * 8, 255).astype(np.uint8)[where]
        ends = np.cumsum([len(x) for x in own])
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "codes": pa.array([squeezed(codes[e - len(x) : e].tobytes()) for x, e in zip(own, ends)], pa.binary())})

    sent = blocks.mapInArrow(each_block(send), "block long, bucket long, first long, gaps binary, times binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block long, bucket long, codes binary")


def split_prints(held: dict, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct prints, how many sets of the block hold each, and where each bucket's begin."""
    flat = np.concatenate([*held.values(), np.zeros(0, np.uint64)]).astype(np.uint64) >> np.uint64(32)
    prints, times = np.unique(flat.astype(np.uint32), return_counts=True)
    ends = np.searchsorted(prints, (np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(n_buckets))
    return prints, np.minimum(times, 60_000).astype(np.uint16), ends


PREFIXES = "doc_id long, block long, n long, rep long, bucket long, shingles binary, owners binary, links binary"


def prefixes(blocks: DataFrame, k: int, percent: int, n_buckets: int) -> DataFrame:
    """Two kinds of rows. bucket null: a document, its block, set size and the first row of its block
    with the same set. Else: prefix shingles that several sets hold, each with the smallest row of those
    that its holders in the block are connected with, and links of those rows to that one."""

    def find(block: int, blob: bytes, told: pa.Table) -> pa.Table:
        ids, texts = block_texts(blob)
        sets = shingle_sets(texts, k)
        held, first = classes(block, ids, sets)
        prints, _, ends = split_prints(held, n_buckets)
        codes = np.zeros(len(prints), np.uint8)
        for b, data in zip(told["bucket"].to_pylist(), told["codes"]):
            codes[ends[b] : ends[b + 1]] = np.frombuffer(opened(data.as_py()), np.uint8)
        shingles, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, s in held.items():
            n = len(s) - -(-percent * len(s) // 100) + 1
            code = codes[np.searchsorted(prints, (s >> np.uint64(32)).astype(np.uint32))]
            lone = int((code == 0).sum())
            if lone < n:
                pick = np.lexsort((s, code))[lone:n]
                shingles.append(s[pick])
                owners.append(np.full(n - lone, i))
        shingle, owner = np.concatenate(shingles), np.concatenate(owners)
        order = np.lexsort((owner, shingle))
        shingle, owner = shingle[order], owner[order]
        fresh = np.concatenate(([True], shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, bool)
        least = owner[fresh][np.cumsum(fresh) - 1] if len(shingle) else owner
        links = rooted(np.stack([owner, least], 1)[owner != least])
        shingle, owner = shingle[fresh], owner[fresh]
        if len(links):  # to other blocks, a component of the block speaks as its smallest row
            at = np.minimum(np.searchsorted(links[:, 0], owner), len(links) - 1)
            owner = np.where(links[at, 0] == owner, links[at, 1], owner)
        to, link_to = (shingle % np.uint64(n_buckets)).astype(np.int64), links[:, 0] % n_buckets
        rows = [(i, block, len(s), f, None, None, None, None) for i, s, f in zip(ids, sets, first)]
        rows += [(None, block, None, None, b, *(x[to == b].tobytes() for x in (shingle, owner)), links[link_to == b].tobytes()) for b in np.union1d(to, link_to).tolist()]
        return pa.table({f.split()[0]: pa.array([r[j] for r in rows], pa.binary() if f.endswith("binary") else pa.int64()) for j, f in enumerate(PREFIXES.split(", "))})

    return written(answer_blocks(blocks, shared_counts(blocks, k, n_buckets), find, PREFIXES))


def rooted(edges: np.ndarray) -> np.ndarray:
    """What connects the same rows as edges (a, b) do: each row but the smallest of its component, with that."""
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label, was = np.arange(len(nodes)), None
    while was is None or (label != was).any():
        was, least = label, np.minimum(label[a], label[b])
        label = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    late = label != np.arange(len(nodes))
    return np.stack([nodes[late], nodes[label[late]]], 1)


def candidate_edges(found: DataFrame) -> DataFrame:
    """(a, b): edges that connect the rows which share a prefix shingle, a row's once for each bucket."""

    def star(rows: pa.Table) -> pa.Table:
        shingle, owner = (np.frombuffer(b"".join(x.as_py() for x in rows[c]), t) for c, t in (("shingles", np.uint64), ("owners", np.int64)))
        order = np.lexsort((owner, shingle))
        shingle, owner = shingle[order], owner[order]
        fresh = np.concatenate(([True], shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, bool)
        least = owner[fresh][np.cumsum(fresh) - 1] if len(shingle) else owner
        links = np.frombuffer(b"".join(x.as_py() for x in rows["links"]), np.int64).reshape(-1, 2)
        edges = rooted(np.concatenate((np.stack([owner, least], 1)[owner != least], links)))
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    sent = found.where("bucket is not null").select("bucket", "shingles", "owners", "links")
    return written(sent.groupBy("bucket").applyInArrow(star, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that edges (a, b) connect node with.

    Minimum labels over edges, then labels of labels, until nothing changes; each round is written
    to the shared folder."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        seen = labels.withColumnsRenamed({"node": "b", "label": "other"})
        told = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("told"))
        better = labels.join(told, "node").select("node", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(better.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")))
        changed = new.where(F.col("was") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def link_group(sets: list[np.ndarray], part: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Component (smallest position) and number of links of different sets; links inside of a part
    with part < 0 count for components alone."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    by_size = np.argsort(size, kind="stable")
    place = np.empty(m, np.int64)
    place[by_size] = np.arange(m)
    _, where, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(m), size)
    shared = df[where] > 1
    number = np.cumsum(df > 1) - 1
    token, holder = number[where[shared]], place[own[shared]]
    lists = np.lexsort((holder, token))
    postings, list_of = holder[lists], token[lists]
    n_blocks = -(-m // SKIP)
    skips = np.searchsorted(list_of * np.int64(n_blocks * SKIP) + postings, (np.arange(number[-1] + 1)[:, None] * n_blocks + np.arange(n_blocks + 1)) * SKIP)
    ends = np.cumsum(np.bincount(own[shared], minlength=m))
    tokens = [np.sort(token[a:e]) for a, e in zip([0, *ends[:-1]], ends)]
    sorted_size = size[by_size]
    label, links = np.arange(m), np.zeros(m, np.int64)
    before, first, last, counts = None, 0, 0, None

    def added(t: np.ndarray, b0: int, b1: int) -> np.ndarray:
        """Of each position in blocks b0 to b1, how many of these lists hold it; other blocks are skipped."""
        a, e = skips[t, b0], skips[t, b1]
        return np.bincount(postings[ranges(a, e - a)] - b0 * SKIP, minlength=(b1 - b0) * SKIP)

    for y in sorted(range(m), key=lambda i: tokens[i][:8].tolist()):
        low = int(np.searchsorted(sorted_size, -(-percent * size[y] // 100)))
        high = int(np.searchsorted(sorted_size, 100 * size[y] // percent, "right"))
        b0, b1 = low // SKIP, -(-high // SKIP)
        gone = new = None
        if before is not None and first <= b0 and b1 <= last:
            gone, new = np.setdiff1d(tokens[before], tokens[y], True), np.setdiff1d(tokens[y], tokens[before], True)
        if gone is not None and len(gone) + len(new) < len(tokens[y]):
            counts = counts[(b0 - first) * SKIP : (b1 - first) * SKIP] - added(gone, b0, b1) + added(new, b0, b1)
        else:
            counts = added(tokens[y], b0, b1)
        before, first, last = y, b0, b1
        overlap = counts[low - b0 * SKIP : high - b0 * SKIP]
        hit = by_size[low:high][100 * overlap >= percent * (size[y] + sorted_size[low:high] - overlap)]
        hit = hit[hit != y]
        links[y] = ((part[hit] != part[y]) | (part[y] >= 0)).sum()
        joined = np.unique(label[np.append(hit, y)])
        if len(joined) > 1:
            label[np.isin(label, joined[1:])] = joined[0]
    return label, links


def linked(docs: DataFrame, k: int = 3, percent: int = 90, block_mb: float = 8.0, limit: int = 4000, shingles: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (different other sets that link with the row's) of every row."""
    with scratch(docs.sparkSession) as kept:  # what is left at the end: a row each for documents and classes
        blocks, mb = packed_blocks(docs, block_mb)
        n_buckets = max(16, round(mb / block_mb))

        found = prefixes(blocks, k, percent, n_buckets)
        members = kept(found.where("bucket is null").select("doc_id", "block", "n", "rep"))
        of_class = members.where("rep is not null").groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n"), F.max("block").alias("block"), F.min("doc_id").alias("low"))
        of_class = written(of_class)
        groups = components(candidate_edges(found))
        parts = F.ceil(F.greatest(F.count("*") / limit, F.sum("n") / shingles)).cast("long")
        large = groups.join(of_class, "node").groupBy("label").agg(parts.alias("parts")).where("parts > 1")
        split = written(groups.join(large, "label", "left").select("node", "label", F.coalesce("parts", F.lit(1)).alias("parts")))

        def gather(block: int, blob: bytes, told: pa.Table) -> pa.Table:
            ids, texts = block_texts(blob)
            group = {n: (g, p) for n, g, p in zip(*(told[c].to_pylist() for c in ("node", "label", "parts")))}
            rows = []
            if group:
                held, first = classes(block, ids, shingle_sets(texts, k))
                text_of = {row: texts[row - (block << ROW_BITS)] for row in held}
                for i, s in held.items():
                    if i in group:
                        g, p = group[i]
                        c = int(np.bitwise_xor.reduce(mixed(s)) % np.uint64(p))
                        for j in [c] if p == 1 else [j for j in range(p) if j != c]:
                            rows.append((g, min(c, j), max(c, j), c, p - 1, i, text_of[i]))
            return pa.table({f: pa.array([r[n] for r in rows], pa.binary() if f == "words" else pa.int64()) for n, f in enumerate(("label", "i", "j", "part", "last", "node", "words"))})

        def solve(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("label", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
            key = np.stack([rows[c].to_numpy() for c in ("label", "i", "j")], 1)
            node, part, data = rows["node"].to_numpy(), rows["part"].to_numpy(), rows["words"]
            cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True])))
            label, links = np.empty(len(node), np.int64), np.zeros(len(node), np.int64)
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                numbers: dict[bytes, int] = {}
                at = np.array([numbers.setdefault(s.tobytes(), len(numbers)) for s in shingle_sets([x.as_py() for x in data[a:e]], k)])
                if len(numbers) == 1:
                    label[a:e] = node[a]
                    continue
                first = np.unique(at, return_index=True)[1]
                side = part[a:e][first]
                i, j = key[a, 1], key[a, 2]
                if i != j:  # links inside of part c count in one task: that of parts c and c + 1
                    side = np.where((side == i) & (j == i + 1), 2 * side, np.where((side == j) & (i == 0) & (rows_last(rows, a) == j), 2 * side, -1 - side))
                own, n = link_group([np.frombuffer(x, np.uint64) for x in numbers], side, percent)
                label[a:e], links[a:e] = node[a:e][first][own[at]], n[at]
            return pa.table({"node": node, "label": label, "links": links})

        def rows_last(rows: pa.Table, a: int) -> int:
            return rows["last"][a].as_py()

        by_block = of_class.select("node", "block").join(split, "node")
        fields = "label long, i long, j long, part long, last long, node long, words binary"
        sent = answer_blocks(blocks, by_block, gather, fields)
        slot = F.when(F.col("last") > 0, F.col("label")).otherwise(F.pmod(F.xxhash64("label", "i", "j"), F.lit(n_buckets * 2)))
        solved = written(sent.groupBy(slot.alias("slot"), "i", "j").applyInArrow(solve, "node long, label long, links long"))
        counts = solved.groupBy("node").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
        if large.limit(1).count():  # parts of split groups know their own links alone
            counts = counts.drop("label").join(components(solved.select(F.col("node").alias("a"), F.col("label").alias("b"))), "node")
        graded = kept(of_class.select("node", "low").join(counts, "node", "left"))

    least = graded.where("label is not null").groupBy("label").agg(F.min("low").alias("least"))
    named = graded.join(least, "label", "left").select(F.col("node").alias("rep"), "links", F.coalesce("least", "low").alias("component"))
    own = members.join(named, "rep", "left")
    component = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
