"""Operator 9, n-gram Jaccard join: exact links between sets of word shingles, by set-relation skipping.

Index lists are skipped by position. A set is kept in the order of its shingles' hashes and cut into groups of three
blocks by fixed positions of the hash range; a list holds the sets that agree in two whole blocks of a group (same size
class, position and content). Two sets that link differ in so few shingles that some group holds at most one difference
(pigeonhole over more groups than half of what they can differ in), and two of its blocks agree. So a set skips all other
lists. Two blocks that hold only common shingles (or none) say little, and their list is skipped too, unless a set has so
many such blocks that no others might agree; common ones are those whose hashed counter, over all texts, stands out. So
passages that many texts share don't bring these texts together.

Answers are derived incrementally. Among sets that lists brought together, one set's shared shingles with all others are
counted by a pass over its index lists; the answers of a set most like it follow from them by the lists of the shingles in
which the two differ alone, and so on from set to set (`link_family`).

Texts are read in blocks, whose agreeing signatures meet in shards, one entry a block and signature; stars of agreeing sets
of a size class give families. A family's texts are compared in one task if they fit `family_bytes`. A larger one is dealt
over tasks once, each with a few of the family's sets beside its own: those that end in one component with most of them
need no more. Only the rest meets all parts again. Equal sets are one node throughout. Sets and nodes are known by 64-bit
hashes, signatures within a shard by 40 bits (what agrees by chance is compared like the others).

Defined cases: a text with fewer words than a shingle has one shingle of all its words; without words or text, a set is
empty and links with nothing; a row with a null id links with nothing and has a null component; repeated rows give a row
each and are links of one another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Tally, Words, counter, cut, in_blocks, mix, planes, sum_tallies, tidy, unplanes
from .components import components

WIDTH, OVER, UNDER = 4, 85, 100
PART_CHARS, BLOCK_CHARS, SHARD_BYTES, FAMILY_BYTES, FEW = 1_000_000, 8_000_000, 20_000_000, 6_000_000, 200_000
SHARDS, CENTRES = 48, 4  # the least shards, and the sets beside each part of a large family
SALTS, OFTEN = 16, 500
_MESSAGE = "kind int, shard int, block long, ids array<long>, a binary, b binary, c binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


class Sets:
    """The distinct shingles of several texts: values side by side, ascending in each set."""

    def __init__(self, texts: list[str | None], width: int, chars: int = PART_CHARS):
        sets: list[np.ndarray] = []
        part: list[str | None] = []
        size = 0
        for k, t in enumerate(texts, 1):
            part.append(t)
            size += len(t or "")
            if size >= chars or k == len(texts):  # what counting words takes is many times the sets' own size
                hashes, number = Words(part).shingles(width)
                bounds = np.concatenate(([0], np.cumsum(number)))
                sets += [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
                part, size = [], 0
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.values = np.concatenate(sets) if sets else np.zeros(0, U64)
        sums = np.concatenate(([U64(0)], np.cumsum(mix(self.values ^ U64(0xA5A5A5A5)), dtype=U64)))
        #: A set's own hash; 0 for the empty set.
        self.nodes = np.where(self.sizes > 0, mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(U64)), U64(0)).view(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i + 1]]

    def flat(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in `chosen`, value) of each shingle of the chosen sets."""
        sizes = self.sizes[chosen]
        owner = np.repeat(np.arange(len(chosen)), sizes)
        return owner, self.values[np.repeat(self.first[chosen] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(owner))]

    def some(self, chosen: np.ndarray) -> Sets:
        out = object.__new__(Sets)
        out.sizes, out.nodes = self.sizes[chosen], self.nodes[chosen]
        out.first = np.concatenate(([0], np.cumsum(out.sizes)))
        out.values = self.flat(chosen)[1]
        return out


# --- common shingles --------------------------------------------------------------------------------------------------


def _tally(width: int):
    """Per task: how many different sets hold a shingle of each counter."""

    def run(batches):
        totals = Tally()
        for _, texts in in_blocks(batches, PART_CHARS, 2):
            sets = Sets(texts, width)
            totals.add(counter(sets.flat(np.unique(sets.nodes, return_index=True)[1])[1]))
        yield from totals.rows()

    return run


def common_counters(docs: DataFrame, width: int) -> np.ndarray:
    """Which counters stand out."""
    return sum_tallies(docs.mapInArrow(_tally(width), Tally.SCHEMA))


# --- signatures -------------------------------------------------------------------------------------------------------


class Scheme:
    """Size classes and blocks for links of sets with over * union <= under * intersection."""

    def __init__(self, over: int, under: int, largest: int):
        self.over, self.under = over, under
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * under // over + 1)
        low.append(low[-1] * under // over + 1)
        self.low = np.array(low)
        high = self.low[1:] - 1
        differ = 2 * high * (under - over) // (under + over)  # what two linked sets of a class can differ in
        fewest = differ // 2 + 1  # of so many groups of blocks, one holds at most one difference
        self.spare = fewest // 6 + np.minimum(2, fewest // 4)
        self.groups = fewest + self.spare

    def classes(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def signatures(self, sets: Sets, chosen: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, index of the set, 0 or 1) of all lists that the chosen sets are in: those of their class and of the next larger one.

        A block speaks if it holds a shingle that isn't common. Of a link's groups with at most one difference there are
        more than `spare`; so if a set has at most that many groups with two silent blocks or three, one of those groups
        has two agreeing blocks of which one speaks, and lists of silent pairs can be left out.
        """
        owner, values = sets.flat(chosen)
        sums = np.concatenate(([U64(0)], np.cumsum(mix(values), dtype=U64)))
        rare = np.ones(len(values), bool) if common is None else ~common[counter(values)]
        spoken = np.concatenate(([0], np.cumsum(rare)))
        own = self.classes(sets.sizes[chosen])
        nothing = mix(np.zeros(1, U64))[0]
        keys, who, ups = [], [], []
        for up in (0, 1):
            k = own + up
            m = 3 * self.groups[k]
            block = (((values >> U64(32)) * m[owner].astype(U64)) >> U64(32)).astype(np.int64)
            at = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            end = np.append(at[1:], len(values))
            holder, group = owner[at], block[at] // 3
            new = (np.diff(holder, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0)
            place = np.cumsum(new) - 1
            holder, group = holder[new], group[new]
            content, speaks = np.zeros((len(group), 3), U64), np.zeros((len(group), 3), bool)
            content[place, block[at] % 3] = sums[end] - sums[at]
            speaks[place, block[at] % 3] = spoken[end] > spoken[at]
            silent = self.groups[k] - np.bincount(holder[speaks.sum(1) >= 2], minlength=len(chosen))
            all_lists = silent > self.spare[k]
            for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                live = speaks[:, i] | speaks[:, j] | all_lists[holder]
                keys.append(self._key(k[holder[live]], 3 * group[live] + pair, mix(content[live, i]) + content[live, j]))
                who.append(holder[live])
                ups.append(np.full(len(who[-1]), up))
            for x in np.flatnonzero(all_lists):  # groups without any shingle
                bare = np.setdiff1d(np.arange(self.groups[k[x]]), group[slice(*np.searchsorted(holder, [x, x + 1]))])
                names = 3 * np.repeat(bare, 3) + np.tile([0, 1, 2], len(bare))
                keys.append(self._key(np.full(len(names), k[x]), names, np.full(len(names), nothing)))
                who.append(np.full(len(names), x))
                ups.append(np.full(len(names), up))
        return np.concatenate(keys), chosen[np.concatenate(who)], np.concatenate(ups)

    @staticmethod
    def _key(k, block, content) -> np.ndarray:
        return mix(content + mix((k.astype(U64) << U64(32)) + block.astype(U64) + U64(1)))


def _row(kind, shard, block, ids=None, a=None, b=None, c=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((kind, shard, block, ids, a, b, c), _SCHEMA)], schema=_SCHEMA)


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending keys: where each new one starts, and where the first of the same is, for each that isn't the first."""
    new = np.diff(keys, prepend=keys[:1] ^ U64(1)) != 0
    start = np.flatnonzero(new)
    return new, np.repeat(start, np.diff(np.append(start, len(keys))))[~new]


class _Block:
    """The sets of some million characters: their rows, and one entry for each of their signatures."""

    def __init__(self, number: int, shards: int):
        self.number, self.shards, self.chars, self.seen = number, shards, 0, {}
        self.ids, self.sizes, self.of_text, self.keys, self.who = [], [], [], [], []

    def add(self, ids, texts, width, over, under, common):
        sets = Sets(texts, width)
        index = np.empty(len(texts), np.int64)
        chosen = []
        for i, (node, doc_id) in enumerate(zip(sets.nodes.tolist(), ids)):
            known = self.seen.get(node)
            if known is None:
                known = self.seen[node] = [len(self.seen), False]
            index[i] = known[0]
            if node and doc_id is not None and not known[1]:
                known[1] = True
                chosen.append(i)
        if chosen:
            keys, who, ups = Scheme(over, under, int(sets.sizes.max())).signatures(sets, np.array(chosen), common)
            self.keys.append(keys)
            self.who.append((2 * index[who] + ups).astype(np.int32))
        self.ids += ids
        self.sizes.append(sets.sizes)
        self.of_text.append(index)
        self.chars += sum(len(t or "") + 16 for t in texts)

    def rows(self):
        names = np.fromiter(self.seen, np.int64, len(self.seen))
        yield _row(1, self.number % self.shards, self.number, self.ids, planes(np.concatenate(self.sizes)), planes(np.concatenate(self.of_text).astype(np.int32)), names.tobytes())
        if not self.keys:
            return
        keys, who = np.concatenate(self.keys), np.concatenate(self.who)
        self.keys = self.who = None
        order = np.argsort(keys, kind="stable")
        keys, who = keys[order], who[order]
        new, leader = _starts(keys)
        pairs = np.unique((who[leader].astype(U64) << U64(32)) | who[~new].astype(U64))
        if len(pairs):
            here = np.full(len(pairs), self.number)
            yield _row(2, self.number % self.shards, self.number, None, _pairs(here, pairs >> U64(32)), _pairs(here, pairs & U64(0xFFFFFFFF)))
        keys, who = keys[new], who[new]
        shard = (((keys >> U64(32)) * U64(self.shards)) >> U64(32)).astype(np.int64)
        order = np.lexsort((who, shard))
        keys, who, shard = keys[order], who[order], shard[order]
        bounds = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            i, j = bounds[s], bounds[s + 1]
            yield _row(0, s, self.number, None, planes(keys[i:j], 5), planes(np.diff(who[i:j], prepend=np.int32(0))))


def _pairs(blocks: np.ndarray, places: np.ndarray) -> bytes:
    return np.stack([blocks.astype(np.int64), places.astype(np.int64)], axis=1).tobytes()


def _read(width: int, over: int, under: int, shards: int, block_chars: int, common: bytes):
    def run(batches):
        hot = np.unpackbits(np.frombuffer(common, np.uint8)).astype(bool)
        block = _Block(TaskContext.get().partitionId() << 20, shards)
        for ids, texts in in_blocks(batches, min(block_chars, PART_CHARS), 2):
            block.add(ids, texts, width, over, under, hot)
            if block.chars >= block_chars:
                yield from block.rows()
                block = _Block(block.number + 1, shards)
        if block.ids:
            yield from block.rows()
        tidy()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Stars of the sets that agree in a signature: (block, place) of the first one and of each other one. Other rows pass."""
    kind = table.column("kind")
    others = table.filter(pc.not_equal(kind, 0))
    table = table.filter(pc.equal(kind, 0))
    if not table.num_rows:
        return others
    number = table.column("block").to_numpy()
    keys, who = [], []
    for a, b in zip(table.column("a"), table.column("b")):
        keys.append(unplanes(a.as_buffer(), U64, 5))
        who.append(np.cumsum(unplanes(b.as_buffer(), np.int32), dtype=np.int32))
    row = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    keys, who = np.concatenate(keys), np.concatenate(who)
    del table
    if len(keys) < 1 << 24:  # the place beside the key: one plain sort
        keys <<= U64(24)
        keys |= np.arange(len(keys), dtype=U64)
        keys.sort()
        order = (keys & U64((1 << 24) - 1)).astype(np.int64)
        keys >>= U64(24)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new, leader = _starts(keys)
    x, y = order[leader], order[~new]
    del keys, order
    pack = lambda at: (row[at].astype(U64) << U64(32)) | who[at].astype(U64)
    x, y = pack(x), pack(y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (np.diff(x) != 0) | (np.diff(y) != 0)
    a, b = (_pairs(number[(v[fresh] >> U64(32)).astype(np.int64)], v[fresh] & U64(0xFFFFFFFF)) for v in (x, y))
    del row, who, x, y
    tidy()
    return pa.concat_tables([others, pa.Table.from_batches([_row(2, -1, -1, None, a, b)])]) if len(a) else others


def _texts(batches):
    for b in batches:
        for r in b.to_pylist():
            node = np.frombuffer(r["c"], np.int64)[unplanes(r["b"], np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(unplanes(r["a"], np.int64)), pa.array(node, mask=node == 0)], ["doc_id", "n_shingles", "node"])


def _places(over: int, under: int):
    """Of each set of each block and each of its two classes: its place in messages, its node, and both as a vertex of the class's graph."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                node = np.frombuffer(r["c"], np.int64)
                sizes = np.zeros(len(node), np.int64)
                sizes[unplanes(r["b"], np.int32)] = unplanes(r["a"], np.int64)
                own = Scheme(over, under, int(sizes.max(initial=1))).classes(sizes)
                for up in (0, 1):
                    vertex = mix(node.view(U64) + mix((own + up + 1).astype(U64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), r["block"])), pa.array(2 * np.arange(len(node)) + up), pa.array(node), pa.array(vertex)], ["block", "place", "node", "vertex"])

    return run


def _stars(batches):
    for b in batches:
        for r in b.to_pylist():
            x, y = (np.frombuffer(r[k], np.int64).reshape(-1, 2) for k in "ab")
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*x.T, *y.T)], ["block_a", "place_a", "block_b", "place_b"])


# --- families are compared --------------------------------------------------------------------------------------------


class Index:
    """Index lists of a family: per shared shingle the sets that hold it, numbered by size, so that those that a set can link with are one block."""

    def __init__(self, sets: Sets, scheme: Scheme):
        self.sets, self.scheme, n = sets, scheme, len(sets.sizes)
        self.n = n
        self.order = np.argsort(sets.sizes, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        self.sizes = sets.sizes[self.order]
        owner = np.repeat(np.arange(n), sets.sizes)
        values = sets.values
        if len(values) > 100_000:  # most shingles are in one set only
            slot = (values >> U64(44)).astype(np.int32)
            shared = np.bincount(slot, minlength=1 << 20)[slot] > 1
            values, owner = values[shared], owner[shared]
        _, shingle, counts = np.unique(values, return_inverse=True, return_counts=True)
        shared = counts[shingle] > 1
        self.shingle, owner = shingle[shared], owner[shared]  # ascending in each set
        self.first = np.searchsorted(owner, np.arange(n + 1))
        self.lists = np.sort(self.shingle * n + self.rank[owner])
        self.counts = counts
        self.weight = np.bincount(owner, weights=counts[self.shingle], minlength=n)

    def of(self, i: int) -> np.ndarray:
        return self.shingle[self.first[i] : self.first[i + 1]]

    def count(self, shingles: np.ndarray) -> np.ndarray:
        """How many of the shingles each set holds, by its number: a pass over their lists."""
        a, b = np.searchsorted(self.lists, shingles * self.n), np.searchsorted(self.lists, (shingles + 1) * self.n)
        length = b - a
        at = np.repeat(a - np.cumsum(length) + length, length) + np.arange(length.sum())
        return np.bincount(self.lists[at] - np.repeat(shingles * self.n, length), minlength=self.n)

    def derive(self, both: np.ndarray, i: int, j: int) -> np.ndarray:
        """What set j shares with all sets, from what set i shares: the lists of what they differ in, if that is less than all lists of j."""
        ours, theirs = self.of(i), self.of(j)
        less, more = np.setdiff1d(ours, theirs, True), np.setdiff1d(theirs, ours, True)
        if self.counts[less].sum() + self.counts[more].sum() >= self.weight[j]:
            return self.count(theirs)
        return both - self.count(less) + self.count(more)

    def links(self, i: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The other sets that link with set i, and how much each shares with it, most first."""
        size, over, under = int(self.sets.sizes[i]), self.scheme.over, self.scheme.under
        low = int(np.searchsorted(self.sizes, -(-over * size // under)))
        high = int(np.searchsorted(self.sizes, under * size // over, "right"))
        own = both[low:high]
        at = np.flatnonzero(under * own >= over * (size + self.sizes[low:high] - own))
        at = at[at + low != self.rank[i]]
        at = at[np.argsort(size + self.sizes[low:high][at] - 2 * own[at], kind="stable")]
        return self.order[at + low], own[at]


def link_family(sets: Sets, scheme: Scheme) -> list[tuple[int, int]]:
    """Links that connect all sets of a family which links connect.

    The set with the longest lists is answered by a pass over them. It answers for all sets that link with it: they are one
    component already, and a link of theirs to another set is found from that one's side. Every other set needs its answer.
    A set that linked with an answered one derives it from that one's; a set without such takes a pass of its own. It ends
    early when all sets are connected.
    """
    index = Index(sets, scheme)
    n = index.n
    label = np.arange(n)
    links: list[tuple[int, int]] = []
    live = np.flatnonzero(sets.sizes > 0)
    if len(live) < 2:
        return links
    start = int(np.argmax(index.weight))
    todo = np.zeros(n, bool)
    todo[live] = True
    done = np.zeros(n, bool)

    def join(i: int, found: np.ndarray) -> None:
        for j in found[label[found] != label[i]].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]

    both = index.count(index.of(start))
    found, _ = index.links(start, both)
    join(start, found)
    todo[start] = todo[found] = False
    for seed in np.flatnonzero(todo).tolist():
        if (label[live] == label[start]).all():
            break
        if done[seed]:
            continue
        i, both = seed, index.count(index.of(seed))
        while True:  # from each set to the one most like it
            done[i] = True
            found, _ = index.links(i, both)
            join(i, found)
            near = found[todo[found] & ~done[found]]
            if not len(near):
                break
            both = index.derive(both, i, int(near[0]))
            i = int(near[0])
    return links


def _compare(width: int, over: int, under: int):
    """Rows (task, node, text), a task's side by side: links within each task."""

    def run(batches):
        def close(tasks):
            nodes = [r for t in tasks for r in t[0]]
            sets = Sets([r for t in tasks for r in t[1]], width)
            right = sets.nodes == np.array(nodes, np.int64)  # not so where an id is of several texts
            scheme = Scheme(over, under, int(sets.sizes.max(initial=1)))
            at, a, b = 0, [], []
            for own, _ in tasks:
                chosen = np.arange(at, at + len(own))[right[at : at + len(own)]]
                chosen = chosen[np.unique(sets.nodes[chosen], return_index=True)[1]]
                at += len(own)
                for i, j in link_family(sets.some(chosen), scheme):
                    a.append(int(sets.nodes[chosen[i]]))
                    b.append(int(sets.nodes[chosen[j]]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        tasks, group, size = [], None, 0
        for b in batches:
            for task, node, text in zip(*(b.column(c).to_pylist() for c in ("task", "node", "text"))):
                if task != group:
                    if size >= PART_CHARS:
                        yield close(tasks)
                        tasks, size = [], 0
                    group = task
                    tasks.append(([], []))
                tasks[-1][0].append(node)
                tasks[-1][1].append(text)
                size += len(text or "")
        if tasks:
            yield close(tasks)
        tidy()

    return run


def _with(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the facts (one row a key) of their key, which may be that of a third of all rows: facts are sent to all if few, else the key is salted."""
    facts = cut(facts, "jaccard-facts")
    if facts.count() <= FEW:
        return rows.join(F.broadcast(facts), key)
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", (F.pmod(F.xxhash64("node"), F.lit(SALTS))).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def _numbers(count: str):
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def _rest(large: DataFrame, links: DataFrame, family_bytes: int) -> DataFrame:
    """Tasks (task, node, least) for sets of large families that links haven't joined with the most of them: shares of these sets beside each part."""
    group = components(links).withColumnRenamed("label", "group")
    found = cut(large.join(group, "node", "left").withColumn("group", F.coalesce("group", "node")), "jaccard-large")
    main = found.groupBy("label", "group").count().groupBy("label").agg(F.max_by("group", "count").alias("main"))
    rest = cut(_with(found, main, "label").filter("group <> main").drop("main"), "jaccard-rest")
    shares = rest.groupBy("label").agg(F.ceil(F.sum("bytes") / family_bytes).alias("shares"))
    parts = _with(found, shares, "label").withColumn("share", F.explode(_numbers("shares")))
    rest = _with(rest, shares, "label").withColumn("share", F.pmod(F.xxhash64("node"), "shares")).withColumn("part", F.explode(_numbers("parts")))
    return parts.drop("shares").unionByName(rest.drop("shares")).select(F.xxhash64("label", "part", "share").alias("task"), "node", "least")


def join(docs: DataFrame, width: int = WIDTH, over: int = OVER, under: int = UNDER, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES, family_bytes: int = FAMILY_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id. Two sets link if under * intersection >= over * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(SHARDS, -(-chars * 7 * (under - over) // ((under + over) * shard_bytes)))  # about 7 / 6 signatures of 6 bytes
    common = np.packbits(common_counters(docs, width)).tobytes()
    met = cut(docs.mapInArrow(_read(width, over, under, shards, block_chars, common), _MESSAGE).groupBy("shard").applyInArrow(_meet, _MESSAGE), "jaccard-stars")
    texts = met.filter("kind = 1").mapInArrow(_texts, "doc_id long, n_shingles long, node long")
    places = met.filter("kind = 1").mapInArrow(_places(over, under), "block long, place long, node long, vertex long")
    named = met.filter("kind = 2").mapInArrow(_stars, "block_a long, place_a long, block_b long, place_b long")
    for k in "ab":
        named = named.join(places.select(F.col("block").alias(f"block_{k}"), F.col("place").alias(f"place_{k}"), F.col("vertex").alias(k)), [f"block_{k}", f"place_{k}"])
    families = components(named.select("a", "b"))
    vertices = places.groupBy("vertex").agg(F.first("node").alias("node"))
    families = families.withColumnRenamed("node", "vertex").join(vertices, "vertex").select("node", "label")

    nodes = texts.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("size"), F.count("*").alias("copies"))
    members = nodes.join(families, "node").withColumn("bytes", F.col("size") * 16 + 400)
    totals = members.groupBy("label").agg(F.ceil(F.sum("bytes") / family_bytes).alias("parts"))
    members = cut(_with(members, totals, "label").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))), "jaccard-members")

    def compared(work: DataFrame) -> DataFrame:
        """Links between the sets of each task of work(task, node, least)."""
        wanted = work.select("node", F.col("least").alias("doc_id")).distinct()
        found = docs.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "doc_id")
        dealt = work.select("task", "node").join(found.select("node", "text"), "node").repartition("task").sortWithinPartitions("task")
        return cut(dealt.select("task", "node", "text").mapInArrow(_compare(width, over, under), "a long, b long"), "jaccard-links")

    own = F.xxhash64("label", "part").alias("task")
    large = members.filter("parts > 1")
    if large.isEmpty():
        links = compared(members.select(own, "node", "least"))
    else:
        centres = large.groupBy("label", "parts").agg(F.array(*(F.min(F.struct(F.xxhash64("node", F.lit(k)), "node", "least")) for k in range(CENTRES))).alias("c"))
        beside = centres.select("label", F.explode(_numbers("parts")).alias("part"), "c").select("label", "part", F.explode("c").alias("c"))
        links = compared(members.select(own, "node", "least").unionByName(beside.select(own, "c.node", "c.least")))
        links = links.unionByName(compared(_rest(large, links, family_bytes)))
    linked = components(links)

    labelled = nodes.join(linked, "node")
    whole = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    joined = _with(labelled.select("node", "label"), whole, "label").select("node", "component_id")
    answer = nodes.join(joined, "node", "left").select("node", "copies", F.coalesce("component_id", "least").alias("component_id"))
    answer = cut(answer, "jaccard-answers")
    named = texts.filter("doc_id is not null and node is not null")
    often = answer.filter(F.col("copies") >= OFTEN)
    if not 0 < often.count() <= FEW:
        done = named.join(answer, "node")
    else:  # a text of very many copies
        done = named.join(F.broadcast(often), "node").unionByName(named.join(F.broadcast(often), "node", "left_anti").join(answer.filter(F.col("copies") < OFTEN), "node"))
    done = done.select("doc_id", "n_shingles", "component_id")
    alone = texts.filter("doc_id is null or node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionByName(alone)
