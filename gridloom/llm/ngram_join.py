"""Links between documents whose sets of word n-grams are alike, by a prefix-tree join.

A document's set holds the hashes (64 bits) of its distinct runs of ``n`` lower-case words; with fewer words, of the
whole sequence. Sets are ordered globally: n-grams by the number of distinct sets that hold them, then by hash. Two sets are linked
when 100 * intersection >= percent * union.

1. The n-grams of least hash of every set, about a quarter, are dealt by hash range and counted. A set that shares fewer of
   them with other sets than any link would need ends here. What is left goes into a bit filter of fixed size; sets
   that get through it by chance cost work only.
2. All n-grams of the sets left are dealt and counted; each set gets back those that another set has, in global
   order. Its unshared n-grams may rule out every link; then it ends here.
3. Sets that share a prefix n-gram (linked pairs do) are chained to clusters. The sets of a cluster of at most :data:`CLUSTER_SETS`
   meet in one task: they are stored in a trie in global order, and each set walks it, with the overlap so
   far shared by all sets below a node. A subtree is left out when its remaining length, or that of the walking set, can't
   bring the overlap needed, when its set sizes can't match, or when all of it is already connected with the walking set.
4. Larger clusters take three passes: every set at its rarest prefix n-gram, in salted groups; then one set of each
   component, at all prefix n-grams; last all sets at all prefix n-grams, but only where different components meet: the
   largest component of an n-gram is dealt into blocks, against blocks of the others, so nothing is compared within
   it. Components are joined after each pass. No link between components is lost.

Equal sets are one. Null and empty texts, and texts without words, have an empty set and are linked with nothing. Texts are read whole. Rows that
repeat are linked like any others; with a null doc_id they take the least other doc_id of their component. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C
from gridloom.llm.components import components

SLICE_BYTES = 2 << 20
#: N-grams of a hash range, and of a group of sets, that one task holds at once.
RANGE_GRAMS = 600_000
#: Sets of a group or block, and of a cluster that one task joins.
GROUP_SETS, CLUSTER_SETS = 1024, 1500
#: Numbers of documents to drop up to which they are broadcast, of eight bytes each.
BROADCAST_IDS = 500_000
#: Bits of the filter, as a power of two.
FILTER_BITS = 26
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def gram_sets(column, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of an Arrow string column, the text of each, and for each text its set's size and hash."""
    raw, offsets = C.flat_texts(column)
    start, end, text = C.words_of(raw, offsets)
    words = C.word_hashes(C.lower(raw), start, end)
    texts = len(offsets) - 1
    many = np.bincount(text, minlength=texts)
    full = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1]) if len(text) >= n else np.zeros(0, np.int64)
    grams = np.full(len(full), n, np.uint64)
    for j in range(n):
        grams += words[full + j] * _TURN[j]
    owner = text[full]
    few = (many[text] < n) & (many[text] > 0)  # the words of short texts
    if few.any():
        place = np.flatnonzero(few)
        j = place - np.searchsorted(text, text[place])
        rest = np.zeros(texts, np.uint64)
        np.add.at(rest, text[place], words[place] * _TURN[j])
        short = np.flatnonzero((many > 0) & (many < n))
        grams = np.concatenate([grams, rest[short] + many[short].astype(np.uint64)])
        owner = np.concatenate([owner, short])
    grams = C.mix(grams)
    if len(grams):
        _, first = C.numbered(C.mix(grams ^ (owner.astype(np.uint64) * _TURN[0])))
        grams, owner = grams[first], owner[first]
    size = np.bincount(owner, minlength=texts)
    total = np.zeros(texts, np.uint64)
    np.add.at(total, owner, C.mix(grams))
    return grams, owner, size, C.mix(total + size.astype(np.uint64) * _TURN[1])


def _slices(batch):
    import pyarrow as pa
    import pyarrow.compute as pc

    pa.set_memory_pool(pa.system_memory_pool())  # what is freed there can be given back
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for a, b in C.pieces_of(batch.num_rows, sizes, SLICE_BYTES):
        yield batch.slice(a, b - a)
        C.trim()


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size and hash (as long) of each document's set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                _, _, size, key = gram_sets(part.column("text"), n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(key.view(np.int64))], ["doc_id", "n", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key long")


def _needed(a: int, b: int, percent: int) -> int:
    """The least intersection that links sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def _bits(grams: int) -> int:
    """Hash ranges, as a power of two, for so many n-grams."""
    return max(5, int(np.ceil(np.log2(max(grams, 1) / RANGE_GRAMS))))


def _once(g, owner, key):
    """The n-grams of a slice's different sets."""
    _, first = C.numbered(key)
    once = np.zeros(len(key), bool)
    once[first] = True
    some = once[owner]
    return g[some], owner[some]


def _places(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The filter's bits of each key."""
    return tuple((C.mix(keys + _TURN[j]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for j in (4, 5, 6))


def likely_sets(docs: DataFrame, rows: DataFrame, n: int, percent: int, grams: int) -> np.ndarray:
    """A bit filter that lets every set through that can have a link. ``rows``: :func:`document_sets`, written."""
    bits = _bits(grams // 4)
    groups = 1 << bits
    extra = lambda size: np.maximum(1, size // 10)

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                g, owner, size, key = gram_sets(part.column("text"), n)
                g, owner = _once(g, owner, key)
                if not len(g):
                    continue
                turn = np.argsort(g)
                turn = turn[np.argsort(owner[turn].astype(np.uint32), kind="stable")]
                g, owner = g[turn], owner[turn]
                rank = np.arange(len(g)) - np.searchsorted(owner, owner)
                # a set and one linked with it share so many of their first n-grams (extra), whatever the order
                first = size - -(-percent * size // 100) + extra(size)
                some = rank < first[owner]
                g, owner = g[some], owner[some]
                at = (g >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
                turn = np.argsort(at, kind="stable")
                g, owner, at = g[turn], owner[turn], at[turn]
                edges = np.searchsorted(at, np.arange(groups + 1))
                rows = []
                for r in range(groups):
                    a, b = edges[r], edges[r + 1]
                    if a < b:
                        have, which = np.unique(owner[a:b], return_inverse=True)
                        rows.append((r, key[have].tobytes(), which.astype(np.uint32 if len(have) > 65535 else np.uint16).tobytes(), g[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["r", "sets", "which", "g"])

    def count(table):
        import pyarrow as pa

        keys, gs = [], []
        for k, w, g in zip(*[table.column(c).to_pylist() for c in ("sets", "which", "g")], strict=True):
            keys.append(np.frombuffer(k, np.uint64)[np.frombuffer(w, np.uint32 if len(k) // 8 > 65535 else np.uint16)])
            gs.append(np.frombuffer(g, np.uint64))
        keys, gs = np.concatenate(keys), np.concatenate(gs)
        _, first = C.numbered(C.mix(gs ^ (keys * _TURN[2])))
        keys, gs = keys[first], gs[first]
        which, _ = C.numbered(gs)
        keys = keys[np.bincount(which)[which] > 1]
        which, first = C.numbered(keys)
        del gs
        C.trim()
        return pa.table([pa.array(keys[first].view(np.int64)), pa.array(np.bincount(which, minlength=len(first)))], names=["key", "shared"])

    dealt = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(deal, "r int, sets binary, which binary, g binary")
    shared = dealt.groupBy("r").applyInArrow(count, "key long, shared long").groupBy("key").agg(F.sum("shared").alias("shared"))
    sizes = rows.where("n > 0").select("key", "n").distinct()
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    left = shared.join(sizes, "key").where(F.col("shared") >= least).select("key")

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.concatenate(_places(np.asarray(batch.column("key")).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "bit"])

    # of a fixed number of words
    got = left.mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[np.asarray(got.column("word"))] = np.asarray(got.column("bits"))
    return out


def shared_grams(docs: DataFrame, rows: DataFrame, n: int, percent: int, grams: int) -> DataFrame:
    """key, n, prefix, grams: sets that can have a link, with their shared n-grams in global order.

    An n-gram is packed into 8 bytes: the logarithm of the number of its sets, then its hash. ``prefix`` counts the
    entries that lie in the set's prefix.
    """
    sent = docs.sparkSession.sparkContext.broadcast(likely_sets(docs, rows, n, percent, grams))
    bits = _bits(grams // 4)
    groups = 1 << bits

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                g, owner, size, key = gram_sets(part.column("text"), n)
                if not len(g):
                    continue
                through = np.ones(len(key), bool)
                for at in _places(key):
                    through &= (sent.value[at >> 6] >> (at & 63)) & 1 == 1
                some = through[owner]
                g, owner = _once(g[some], owner[some], key)
                if not len(g):
                    continue
                at = (g >> np.uint64(64 - bits)).astype(np.int32)
                turn = np.argsort(at, kind="stable")
                g, owner, at = g[turn], owner[turn], at[turn]
                edges = np.searchsorted(at, np.arange(groups + 1))
                rows = [[], [], [], [], []]
                for r in range(groups):
                    a, b = edges[r], edges[r + 1]
                    if a == b:
                        continue
                    have, which = np.unique(owner[a:b], return_inverse=True)
                    for x, y in zip(rows, (r, key[have].tobytes(), size[have].astype(np.int32).tobytes(), which.astype(np.uint32 if len(have) > 65535 else np.uint16).tobytes(), g[a:b].tobytes()), strict=True):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], ["r", "sets", "sizes", "which", "g"])

    def count(table):
        import pyarrow as pa

        keys, sizes, gs = [], [], []
        for s, z, w, g in zip(*[table.column(c).to_pylist() for c in ("sets", "sizes", "which", "g")], strict=True):
            g = np.frombuffer(g, np.uint64)
            w = np.frombuffer(w, np.uint32 if len(s) // 8 > 65535 else np.uint16)
            keys.append(np.frombuffer(s, np.uint64)[w])
            sizes.append(np.frombuffer(z, np.int32)[w])
            gs.append(g)
        keys, sizes, gs = np.concatenate(keys), np.concatenate(sizes), np.concatenate(gs)
        _, first = C.numbered(C.mix(gs ^ (keys * _TURN[2])))  # each n-gram once a set
        keys, sizes, gs = keys[first], sizes[first], gs[first]
        which, _ = C.numbered(gs)
        counts = np.bincount(which)[which]
        some = counts > 1
        keys, sizes = keys[some], sizes[some]
        gs = (np.log2(counts[some]).astype(np.uint64) << np.uint64(58)) | (gs[some] >> np.uint64(6))
        C.trim()
        to = (keys % np.uint64(groups)).astype(np.int32)
        turn = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[turn], np.arange(groups + 1))
        rows = [[], [], [], []]
        for r in range(groups):
            i = turn[edges[r] : edges[r + 1]]
            if len(i):
                for x, y in zip(rows, (r, keys[i].tobytes(), sizes[i].tobytes(), gs[i].tobytes()), strict=True):
                    x.append(y)
        return pa.table([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["r", "sets", "sizes", "g"])

    def gather(table):
        import pyarrow as pa

        kinds = (("sets", np.uint64), ("sizes", np.int32), ("g", np.uint64))
        keys, sizes, gs = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in kinds)
        which, first = C.numbered(keys)
        n_shared = np.bincount(which)
        size = sizes[first].astype(np.int64)
        # the intersection with any set is at most the shared n-grams, and at least percent % of the set's own size
        prefix = size - -(-percent * size // 100) + 1 - (size - n_shared)
        fine = prefix > 0
        some = fine[which]
        which, gs = which[some], gs[some]
        turn = np.lexsort((gs, which))
        which, gs = which[turn], gs[turn]
        C.trim()
        out = [[], [], [], []]
        ends = np.searchsorted(which, np.arange(len(first) + 1))
        for i in np.flatnonzero(fine):
            a, b = ends[i], ends[i + 1]
            for x, y in zip(out, (int(keys[first[i]].view(np.int64)), int(size[i]), int(prefix[i]), gs[a:b].tobytes()), strict=True):
                x.append(y)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["key", "n", "prefix", "grams"])

    dealt = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(deal, "r int, sets binary, sizes binary, which binary, g binary")
    counted = dealt.groupBy("r").applyInArrow(count, "r int, sets binary, sizes binary, g binary")
    return counted.groupBy("r").applyInArrow(gather, "key long, n long, prefix int, grams binary")


class Trie:
    """Sets, as rising arrays of ranks, in a compressed prefix tree. ``size`` counts a set's unshared n-grams as well."""

    def __init__(self, sets: list[np.ndarray], size: np.ndarray):
        self.sets, self.size = sets, size
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        # node: depth of its segment's begin and end, a set that runs through it, first and last place in the order,
        # children, least and greatest size, greatest length below
        top: list[tuple] = []
        # copies of a long text may part one after another, deeper than Python's own stack
        todo = [(0, len(sets), 0, top)] if sets else []
        while todo:
            lo, hi, depth, siblings = todo.pop()
            node, runs = self._node(lo, hi, depth)
            siblings.append(node)
            todo += [(*run, node[1], node[6]) for run in reversed(runs)]
        self.root = top[0] if top else None

    def _node(self, lo: int, hi: int, depth: int):
        """A node, its children still to come, and the places in the order where each of them begins and ends."""
        first, last = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
        # sorted, so what the first and the last share all share
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        members = self.order[lo:hi]
        sizes = self.size[members]
        runs = []
        at = lo
        while at < hi and len(self.sets[self.order[at]]) == end:
            at += 1
        here = at - lo  # sets that end with this segment
        while at < hi:
            head = self.sets[self.order[at]][end]
            low, high = at + 1, hi  # the run of sets that go on alike
            while low < high:
                mid = (low + high) // 2
                if self.sets[self.order[mid]][end] == head:
                    low = mid + 1
                else:
                    high = mid
            runs.append((at, low))
            at = low
        return (depth, end, self.order[lo], lo, hi, here, [], int(sizes.min()), int(sizes.max()), max(len(self.sets[i]) for i in members)), runs


def linked_sets(sets: list[np.ndarray], size: np.ndarray, side: np.ndarray, group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of places whose sets are linked: enough of them to join all that links join.

    ``side``: 0 walks only, 1 is stored only, 2 both. ``group``: a number of each set's component; nothing is sought within one.
    """
    stored = np.flatnonzero(side > 0)
    trie = Trie([sets[i] for i in stored], size[stored])
    parent: dict[int, int] = {}

    def find(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    width = max((int(s[-1]) + 1 for s in sets if len(s)), default=0)
    mark = np.zeros(width, bool)
    for walker in np.flatnonzero(side != 1).tolist():
        mine, n = sets[walker], int(size[walker])
        mark[mine] = True
        stack = [(trie.root, 0)] if trie.root else []
        while stack:
            (depth, end, through, lo, hi, here, children, least, most, longest), overlap = stack.pop()
            # sizes that could be linked with this one
            if 100 * most < percent * n or percent * least > 100 * n:
                continue
            need = _needed(n, max(least, -(-percent * n // 100)), percent)
            path = trie.sets[through]
            done = int(np.searchsorted(mine, path[depth])) if depth < len(path) else len(mine)
            if overlap + min(len(mine) - done, longest - depth) < need:
                continue
            if end > depth:
                overlap += int(np.count_nonzero(mark[path[depth:end]]))
                done = int(np.searchsorted(mine, path[end - 1], "right"))
                if children and overlap + min(len(mine) - done, longest - end) < need and not here:
                    continue
            root = find(int(group[walker]))
            for place in trie.order[lo : lo + here]:
                other = int(stored[place])
                there = find(int(group[other]))
                if there != root and overlap >= _needed(n, int(size[other]), percent):
                    out.append((walker, other))
                    parent[max(there, root)] = min(there, root)
                    root = find(root)
            for child in reversed(children):
                # a subtree of which every set is already connected with the walking one is left out
                if child[4] - child[3] > 32 or any(find(int(group[stored[p]])) != root for p in trie.order[child[3] : child[4]]):
                    stack.append((child, overlap))
        mark[mine] = False
    return out


def _link_groups(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) found in each group of rows (key, root, n, grams, side)."""

    def run(table):
        import pyarrow as pa

        gs = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        ids = np.asarray(table.column("key"))
        if len(ids) < 2:
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        # ranks of this group's n-grams in global order
        which = np.unique(np.concatenate(gs), return_inverse=True)[1]
        sets = np.split(which, np.cumsum([len(x) for x in gs])[:-1])
        found = linked_sets(sets, np.asarray(table.column("n")), np.asarray(table.column("side")), np.asarray(table.column("root")), percent)
        return pa.table([pa.array(ids[[x[i] for x in found]] if found else [], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.select(*keys, "key", "root", "n", "grams", "side").groupBy(*keys).applyInArrow(run, "a long, b long")


def _prefix(sets: DataFrame, first_only: bool = False) -> DataFrame:
    """key and each prefix n-gram (as long) of every set."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, grams, most = [], [], []
            for key, g, p in zip(b.column("key").to_pylist(), b.column("grams").to_pylist(), b.column("prefix").to_pylist(), strict=True):
                g = np.frombuffer(g, np.int64)[: 1 if first_only else p]
                grams.append(g)
                ids.append(key)
                most.append(len(g))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), most)), pa.array(np.concatenate(grams))], ["key", "gram"])

    return sets.select("key", "grams", "prefix").mapInArrow(run, "key long, gram long")


def _rooted(sets: DataFrame, links: DataFrame | None) -> DataFrame:
    """``sets`` with the root of each one's component."""
    if links is None:
        return sets.withColumn("root", F.col("key"))
    roots = components(links).select(F.col("node").alias("key"), F.col("root").alias("up"))
    return sets.join(roots, "key", "left").select("*", F.coalesce("up", "key").alias("root")).drop("up")


def set_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between keys of sets, enough to join all that links join."""
    payload = sets.select("key", "n", "grams")
    # clusters of sets, chained by prefix n-grams
    held = C.keep(_prefix(sets), "held")
    least = held.groupBy("gram").agg(F.min("key").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    chained = C.keep(components(held.join(least, "gram").select(F.col("key").alias("a"), F.col("least").alias("b"))), "clusters")
    sizes = chained.groupBy("root").agg(F.count("*").alias("c"))
    small = chained.join(sizes.where(F.col("c") <= CLUSTER_SETS), "root").select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    rows = small.join(payload, "key").select("*", F.col("key").alias("root"), F.lit(2).alias("side"))
    links = C.keep(_link_groups(rows, ["cluster"], percent), "links-clusters")
    large = C.keep(chained.join(sizes.where(F.col("c") > CLUSTER_SETS), "root").select(F.col("node").alias("key")), "large")
    if large.isEmpty():
        return links
    sets = sets.join(large, "key", "left_semi")
    return links.unionByName(_large_links(sets, percent))


def _large_links(sets: DataFrame, percent: int) -> DataFrame:
    """:func:`set_links` for clusters of any size."""
    light = ["key", "n", "prefix"]
    payload = sets.select("key", "n", "grams")
    # all sets, at their rarest prefix n-gram, in salted groups
    first = C.keep(_prefix(sets, True), "first")
    often = first.groupBy("gram").agg(F.ceil(F.count("*") / GROUP_SETS).alias("salts")).where("salts > 1")
    salted = first.join(often, "gram", "left").select("key", "gram", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).alias("salt"))
    alone = salted.groupBy("gram", "salt").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    rows = salted.join(alone, ["gram", "salt"], "left_semi").join(payload, "key").select("*", F.col("key").alias("root"), F.lit(2).alias("side"))
    links = C.keep(_link_groups(rows, ["gram", "salt"], percent), "links-first")
    # one set of each component, at all prefix n-grams; then all sets where components meet
    for leaders in (True, False):
        rooted = C.keep(_rooted(sets.select(*light), links), "rooted")
        chosen = rooted.where("key = root") if leaders else rooted
        grams = C.keep(_prefix(sets.join(chosen.select("key"), "key", "left_semi") if leaders else sets).join(chosen.select("key", "root"), "key"), "meeting")
        sizes = grams.groupBy("gram", "root").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 31))).alias("s"))
        meeting = sizes.groupBy("gram").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"), F.sum("c").alias("all"), F.bit_xor("x").alias("x"), F.sum("s").alias("s")).where("roots > 1")
        # n-grams held by the same sets would make the same comparisons: one of them does
        meeting = meeting.groupBy("x", "s", "all", "roots").agg(F.min(F.struct("gram", "top")).alias("one")).select("one.*", "all")
        meeting = meeting.select("gram", F.col("top.root").alias("bulk"), F.ceil(F.col("top.c") / GROUP_SETS).alias("bulks"), F.ceil((F.col("all") - F.col("top.c")) / GROUP_SETS).alias("others"))
        placed = grams.join(meeting, "gram").withColumn("is_bulk", F.col("root") == F.col("bulk"))
        block = lambda upto: F.pmod(F.xxhash64("key"), F.col(upto)).cast("int")
        upto = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
        # tasks (gram, i, j): block i of the others walks over block j of the bulk, or (j < 0) over block -1-j of the others
        bulk = placed.where("is_bulk").select("key", "root", "gram", F.explode(upto("others")).alias("i"), block("bulks").alias("j"), F.lit(1).alias("side"))
        other = placed.where("NOT is_bulk").withColumn("mine", block("others"))
        walks = other.select("key", "root", "gram", F.col("mine").alias("i"), F.explode(upto("bulks")).alias("j"), F.lit(0).alias("side"))
        same = other.select("key", "root", "gram", F.col("mine").alias("i"), (-1 - F.col("mine")).alias("j"), F.lit(2).alias("side"))
        pairs = other.withColumn("o", F.explode(upto("others"))).where("o <> mine")
        pairs = pairs.select("key", "root", "gram", F.greatest("mine", "o").alias("i"), (-1 - F.least("mine", "o")).alias("j"), F.when(F.col("mine") > F.col("o"), 0).otherwise(1).alias("side"))
        tasks = bulk.unionByName(walks).unionByName(same).unionByName(pairs)
        rows = tasks.join(payload, "key")
        links = C.keep(links.unionByName(_link_groups(rows, ["gram", "i", "j"], percent)), "links-more")
    return links


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``."""
    with C.batch_rows(docs.sparkSession, 2000):
        return _near_duplicates(docs, n, percent)


def _near_duplicates(docs: DataFrame, n: int, percent: int) -> DataFrame:
    rows = C.keep(document_sets(docs, n), "sets")
    grams = rows.agg(F.sum("n")).first()[0] or 0
    sets = C.keep(shared_grams(docs, rows, n, percent, grams), "shared")
    roots = components(set_links(sets, percent)).select(F.col("node").alias("key"), "root")
    least = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    groups = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = least.join(groups, "root").select("key", "component_id")
    full = rows.where("n > 0").join(of, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but the least doc_id of each component, and less repeated rows.

    Rows without doc_id stay. Of rows with the same doc_id and text one stays.
    """
    found = C.keep(near_duplicates(docs, n, percent), "found")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = _without(docs, found.where("component_id <> doc_id").select("doc_id").distinct()).select(*columns)
    again = C.keep(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    return _without(left, again).unionByName(left.join(again, "doc_id", "left_semi").select(*columns).dropDuplicates(["doc_id", "text"]))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among distinct ids; up to BROADCAST_IDS of them are sent to all tasks."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents: 4-word shingles, Jaccard of 85 % or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
