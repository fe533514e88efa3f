"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the components of its links.

1. Every document becomes a set of 64-bit hashes of its five-word shingles. Equal sets (matched by
   a 128-bit digest) are one class from then on, stood for by its smallest document id.
2. Most classes cannot link: a set of n needs ceil(t n) shingles in common with another one, so more than
   n - ceil(t n) shingles that no other document has rule it out. They are counted over half of the hash space,
   which can only miss some, by the shared ones that each bucket of hashes returns. What is left is ordered by document frequency: two sets that
   link share one of their first n - ceil(t n) + 1 shingles, rare ones first, so that common passages
   bring no strangers together. The shared ones are matched by aggregation and a join, and the candidate groups
   are closed by distributed components. Groups are not links yet, only what must be compared.
3. Each group is searched by DivideSkip: the short inverted lists are heap-merged, candidates with
   enough occurrences are probed in the long lists by binary search, and those that reach the
   required overlap are links. Members are compared with leaders first; a leader's cluster is searched by
   members of another one only if the distance of the leaders allows a link between the two.
   A group of more than ``GROUP`` classes is dealt out by hash first: parts are clustered each for itself, then
   the leaders of any two parts are compared in a task of their own, and then the members of those clusters that may still link.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, lean, map_text, materialize, shrunk, small_batches, unzipped
from .components import components
from .wordcache import BATCH_CHARS, runs, spans

N = 5
PERCENT = 80
_SPACE = re.compile(r"[\t-\r ]")
_MIDDLE = np.uint64(1 << 63)
#: Least number of hash buckets, whatever the number of partitions.
BUCKETS = 64
#: Classes that one task compares at a time.
GROUP = 1000
#: Rows of the table of large groups up to which it is broadcast (two numbers each).
MAX_BROADCAST = 100_000

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(N)], np.uint64)


class Shingler:
    """Hash sets of whole texts; each distinct word of a batch is hashed once."""

    def __init__(self, n: int = N):
        self.n = n

    def many(self, texts: list[str | None], chars: int = BATCH_CHARS) -> list[np.ndarray]:
        """Sorted distinct shingle hashes (uint64) of each text; empty for null or a text without words."""
        out = []
        for at, cut in spans(texts, chars):
            if cut == at + 1:
                parts = [self._words([run])[0] for run in runs(texts[at] or "", chars, _SPACE)]
                out.append(self._shingles(np.concatenate(parts)))
                continue
            x, counts = self._words([t or "" for t in texts[at:cut]])
            stops = np.cumsum(counts).tolist()
            every = self._mixed(x, self.n) if len(x) >= self.n else None
            for a, b in zip([0, *stops], stops, strict=False):
                out.append(np.unique(every[a : b - self.n + 1]) if b - a >= self.n else self._shingles(x[a:b]))
        return out

    def hashes(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of words of each text."""
        plain = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        split = pc.ascii_split_whitespace(plain)
        words = split.flatten()
        counts = pc.list_value_length(split).to_numpy() - pc.equal(plain, "").cast(pa.int64()).to_numpy()  # no word splits into one empty one
        coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
        digests = b"".join(map(xxhash.xxh3_64_digest, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        return np.frombuffer(digests, np.uint64)[coded.indices.to_numpy()], counts

    def _shingles(self, x: np.ndarray) -> np.ndarray:
        return np.unique(self._mixed(x, min(self.n, len(x)))) if len(x) else x

    @staticmethod
    def _mixed(x: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.full(len(x) - n + 1, n, np.uint64)
            for k in range(n):
                total += x[k : len(x) - n + 1 + k] * _POWERS[k]
            total ^= total >> np.uint64(31)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(29)
        return total


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """What a set of n needs in common with any set it links to."""
    return -(-percent * n // 100)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def shingle_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, how many of them are in the lower half of the hash space, and the digest
    (d1, d2) of the set, which names its class."""
    fields = [T.StructField(n, T.LongType()) for n in ("n_shingles", "n_half", "d1", "d2")]

    def make():
        shingler = Shingler()

        def work(texts):
            sets = shingler.many(texts)
            digests = [_digest(s) for s in sets]
            return [[len(s) for s in sets], [int(np.searchsorted(s, _MIDDLE)) for s in sets], [d[0] for d in digests], [d[1] for d in digests]]

        return work

    return map_text(docs.select("doc_id", "text"), make, fields, keep=["doc_id"])


def _half(buckets: int):
    """Map over texts: for each batch and bucket one row of packed class names, counts, 48-bit hashes, and the hashes that the
    batch itself has twice. Copies inside of a batch are sent once.

    Of a hash that several classes of the batch have, only the hash is sent on: it is shared, and the classes' own counts of such
    hashes are rows without hashes (in a bucket below zero). A hash that all documents have makes one entry for each batch so.
    """

    def run(batches):
        shingler, part, rest = Shingler(), TaskContext.get().partitionId(), 0
        for batch in batches:
            found = shingler.many(batch.column(0).to_pylist())
            sets = list({_digest(s)[0]: s[: np.searchsorted(s, _MIDDLE)] for s in found if len(s)}.items())
            if not sets:
                continue
            names = np.array([d for d, _ in sets], np.int64)
            h = np.concatenate([s for _, s in sets])
            order = np.argsort(h, kind="stable")
            owner = np.repeat(np.arange(len(sets)), [len(s) for _, s in sets])[order]
            h = h[order]
            edge = np.ones(len(h) + 1, bool)
            edge[1:-1] = h[1:] != h[:-1]
            alone = edge[1:] & edge[:-1]
            twice = h[edge[:-1] & ~alone]
            within = np.bincount(owner[~alone], minlength=len(sets))
            h, owner = h[alone], owner[alone]
            order = np.lexsort((owner, _bucket(h, buckets)))
            h, owner = h[order], owner[order]
            rest += 1
            rows: list[list] = [[-1 - (part + rest * 7919)], [names.tobytes()], [within.astype(np.uint32).tobytes()], [b""], [b""]]
            low, again = (x.view(np.uint8).reshape(-1, 8)[:, :6] for x in (h, twice))
            ends = np.arange(1, buckets + 1)
            cuts, more = (np.concatenate([[0], np.searchsorted(_bucket(x, buckets), ends)]) for x in (h, twice))
            for k in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(more) > 0)).tolist():
                who, counts = np.unique(owner[cuts[k] : cuts[k + 1]], return_counts=True)
                packed = names[who], counts.astype(np.uint32), low[cuts[k] : cuts[k + 1]], again[more[k] : more[k + 1]]
                for c, v in zip(rows, (k, *(x.tobytes() for x in packed)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=_HALF)

    return run


_HALF = ["bucket", "names", "counts", "hashes", "again"]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes in the lower half, in the order of the hashes."""
    return ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(15)).astype(np.int64)


def _shared_counts(batches):
    """Rows of some buckets to (d1, n_shared): hashes that another document of the corpus has too, for each bucket."""

    def whole(raw, bucket):
        low = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        h = np.zeros((len(low), 8), np.uint8)
        h[:, :6] = low
        return h.view(np.uint64).ravel(), np.full(len(low), bucket, np.int64)

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for bucket, names, counts, hashes, again in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            names, counts = np.frombuffer(names, np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["d1", "n_shared"])
                continue
            h, b = whole(hashes, bucket)
            held.append((b, h, np.repeat(names, counts), np.ones(len(h), bool)))
            h, b = whole(again, bucket)
            held.append((b, h, np.zeros(len(h), np.int64), np.zeros(len(h), bool)))
    if held:
        b, h, who, counted = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h, b))
        b, h = b[order], h[order]
        same = (h[1:] == h[:-1]) & (b[1:] == b[:-1])
        shared = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & counted[order]
        names, counts = np.unique(who[order][shared], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["d1", "n_shared"])


def possible_classes(docs: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """(d1, d2, node) of the classes that may link; node is the smallest id of the class."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_batches(docs.sparkSession)
    packed = docs.where("doc_id is not null").select("text").mapInArrow(lean(_half(max(parts, BUCKETS))), "bucket long, names binary, counts binary, hashes binary, again binary")
    dealt = packed.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    # Counts of d1 alone: should two classes have the same d1, both counts are too high, and both pass to the next step.
    shared = dealt.mapInArrow(lean(_shared_counts), "d1 long, n_shared long").groupBy("d1").agg(F.sum("n_shared").alias("n_shared"))
    classes = (
        told.where("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.max("n_half").alias("n_half"), F.count("*").alias("copies"))
    )
    # A class with copies is sent by several batches, so that its own count says nothing: it passes to the next step.
    unique = F.when(F.col("copies") > 1, 0).otherwise(F.col("n_half") - F.coalesce("n_shared", F.lit(0)))
    allowed = F.col("n") - F.ceil(F.col("n") * percent / 100)
    return classes.join(shared, "d1", "left").where(unique <= allowed).select("d1", "d2", "node")


def _own_texts(batches):
    """Rows (name, d1, d2, compressed text) of which the text has that digest (ids may repeat with other texts), with their size."""
    shingler = Shingler()
    for batch in batches:
        names, d1, d2 = (batch.column(k).to_pylist() for k in range(3))
        texts = [unzipped(z.as_py()).decode() for z in batch.column(3)]
        sets = shingler.many(texts)
        keep = [i for i, s in enumerate(sets) if len(s) and _digest(s) == (d1[i], d2[i])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in keep], pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([texts[i] for i in keep], pa.string())],
            names=["name", "n", "text"],
        )


def candidate_groups(texts: DataFrame, percent: int) -> DataFrame:
    """(node, root) over class names: classes of which some chain of prefixes is shared."""

    def postings(batches):
        shingler = Shingler()
        for batch in batches:
            names, n, texts = (batch.column(k).to_pylist() for k in range(3))
            for at, cut in spans(texts):
                sets = shingler.many(texts[at:cut])
                sizes = [len(s) for s in sets]
                columns = np.repeat(names[at:cut], sizes), np.repeat(n[at:cut], sizes), np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["name", "n", "h"])

    rows = texts.mapInArrow(lean(postings), "name long, n long, h long")
    shared = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    own = Window.partitionBy("name")
    ranked = rows.join(shared, "h").withColumns(
        {
            "shared": F.count("*").over(own),
            "k": F.row_number().over(own.orderBy(F.floor(F.log2("c")), "h")),
        }
    )
    # Shingles that no other class has come first in the order and take n - shared places of the prefix.
    prefix = materialize(ranked.where(F.col("k") <= F.col("shared") - F.ceil(F.col("n") * percent / 100) + 1).select("name", "h"), "prefixes")
    ends = prefix.groupBy("h").agg(F.min("name").alias("a"), F.max("name").alias("z")).where("a < z").select("h", "a")
    out = components(prefix.join(ends, "h").select("a", F.col("name").alias("b")).where("a != b"))
    discard(prefix)
    return out


class Index:
    """Inverted lists over numbered sets; numbers are added in ascending order."""

    def __init__(self):
        self.lists: dict[int, array] = defaultdict(lambda: array("i"))
        self.size: dict[int, int] = {}

    def add(self, number: int, items: list[int], size: int) -> None:
        self.size[number] = size
        for x in items:
            self.lists[x].append(number)

    def search(self, items: list[int], least: int) -> list[tuple[int, int]]:
        """(number, overlap) of each indexed set that has at least ``least`` of the items.

        The short lists are merged by a heap; what comes up often enough there is looked for in the long lists by binary
        search, for all such sets at once, and falls out as soon as the lists left cannot make up what is missing.
        """
        get = self.lists.get
        lists = sorted((x for x in map(get, items) if x), key=len)
        if least < 1 or len(lists) < least:
            return []
        longest = len(lists[-1])
        n_long = min(least - 1, int(least / (0.0085 * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = ((number, sum(1 for _ in same)) for number, same in groupby(heapq.merge(*short)))
        often = [(number, count) for number, count in merged if count >= least - n_long]
        if not often:
            return []
        numbers, counts = (np.array(x) for x in zip(*often, strict=True))
        for left, x in zip(range(n_long, 0, -1), reversed(long), strict=True):  # the longest first: there a hit is likeliest
            alive = counts + left >= least
            if not alive.all():
                numbers, counts = numbers[alive], counts[alive]
                if not len(numbers):
                    return []
            held = np.frombuffer(x, np.int32)
            counts = counts + (held[np.minimum(np.searchsorted(held, numbers), len(held) - 1)] == numbers)
        enough = counts >= least
        return list(zip(numbers[enough].tolist(), counts[enough].tolist(), strict=True))


class Groups:
    """Union-find by smallest number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


class Clusters:
    """The sets of one candidate group: their components, and for each its leader and the distance to it."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.sizes = percent, [len(s) for s in sets]
        _, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = n[inverse] > 1  # what only one set has is never in common
        cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.items = [inverse[a:b][shared[a:b]].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        # By size, so that every indexed set is at most as large as the one that searches.
        self.order = sorted(range(len(sets)), key=lambda i: (self.sizes[i], i))
        self.found = Groups(len(sets))
        self.leaders, self.radius = Index(), {}
        self.leader, self.distance = list(range(len(sets))), [0.0] * len(sets)

    def linked(self, n: int, m: int, overlap: int) -> bool:
        return 100 * overlap >= self.percent * (n + m - overlap)

    def assign(self) -> None:
        """Every set joins all leaders it links to and the cluster of the nearest, or leads one."""
        for rank, i in enumerate(self.order):
            n = self.sizes[i]
            close = [(k, o) for k, o in self.leaders.search(self.items[i], least_overlap(n, self.percent)) if self.linked(n, self.leaders.size[k], o)]
            for k, _ in close:
                self.found.join(i, self.order[k])
            if close:
                k, o = max(close, key=lambda x: x[1])
                self.leader[i], self.distance[i] = self.order[k], 1 - o / (n + self.leaders.size[k] - o)
                self.radius[k] = max(self.radius[k], self.distance[i])
            else:
                self.leaders.add(rank, self.items[i], n)
                self.radius[rank] = 0.0

    def near(self, radius: dict[int, float]) -> Iterator[tuple[int, int]]:
        """Pairs of leaders in different components of which members may link: Jaccard distance is a metric, so that the
        leaders of two linked members are at most the two radii and one link apart.

        Only leaders outside of the largest component search: one side of every such pair is outside of it.
        """
        reach, widest = 1 - self.percent / 100, max(radius.values(), default=0.0)
        counts = Counter(self.found.root(self.order[k]) for k in radius)
        largest = max(counts, key=counts.get, default=None)
        for k in radius:
            i = self.order[k]
            if self.found.root(i) == largest:
                continue
            least = 1 - (radius[k] + widest + reach) - 1e-9
            for other, o in self.leaders.search(self.items[i], max(1, int(np.ceil(least * self.sizes[i])))):
                j = self.order[other]
                if self.found.root(i) != self.found.root(j) and 1 - o / (self.sizes[i] + self.sizes[j] - o) <= radius[k] + radius[other] + reach + 1e-9:
                    yield i, j

    def finish(self) -> None:
        """Links between members of clusters that are not joined yet: the members of all clusters that may hold one are indexed
        once, and those outside of the largest component search."""
        if max(self.radius.values(), default=0.0) == 0:
            return
        members = list(range(len(self.sizes)))
        if len(members) > 4 * len(self.radius):  # else to search all is less work than to compare leaders
            open_clusters = {x for pair in self.near(self.radius) for x in pair}
            members = [i for i in members if self.leader[i] in open_clusters]
            if not members:
                return
        largest = Counter(map(self.found.root, members)).most_common(1)[0][0]
        searching = [i for i in members if self.found.root(i) != largest]
        index = index_of(members, self.items, self.sizes)
        for i in searching:
            for j, o in index.search(self.items[i], least_overlap(self.sizes[i], self.percent)):
                if self.found.root(i) != self.found.root(j) and self.linked(self.sizes[i], self.sizes[j], o):
                    self.found.join(i, j)

    def roots(self) -> list[int]:
        return [self.found.root(i) for i in range(len(self.sizes))]


def index_of(numbers: list[int], items: list[list[int]], sizes: list[int]) -> Index:
    out = Index()
    for x in sorted(numbers):
        out.add(x, items[x], sizes[x])
    return out


def link_group(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Component of each set among the sets of one candidate group (all non-empty)."""
    c = Clusters(sets, percent)
    c.assign()
    c.finish()
    return c.roots()


def _by_group(work, names: list[str], width: int):
    """Map over rows sorted by a group of ``width`` columns: ``work(group, shingler, rows)`` yields output rows as tuples."""

    def run(batches):
        shingler, group, rows = Shingler(), None, []

        def flush():
            out = list(zip(*work(group, shingler, rows), strict=True)) or [()] * len(names)
            kinds = [pa.float64() if n in ("distance", "radius") else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != group:
                    if rows:
                        yield flush()
                    group, rows = row[:width], []
                rows.append(row[width:])
        if rows:
            yield flush()

    return run


def _cluster_part(percent: int):
    def work(group, shingler, rows):
        names = [r[0] for r in rows]
        c = Clusters([shingler.hashes(r[1]) for r in rows], percent)
        c.assign()
        c.finish()
        for i, root in enumerate(c.roots()):
            yield group[0], group[1], names[i], names[root], names[c.leader[i]], c.distance[i]

    return work


def _compare_leaders(percent: int):
    """Leaders of two parts (side, leader, component, radius, members, text) to (root, p, q, side, a, b): links a, b that join
    components of the two (side -1), and then the leaders ``a`` of clusters that may still hold one, with the component ``b`` by now."""

    def work(group, shingler, rows):
        c = Clusters([shingler.hashes(r[5]) for r in rows], percent)
        first: dict[int, int] = {}
        for i, r in enumerate(rows):
            c.found.join(i, first.setdefault(r[2], i))
        one, other = ([i for i, r in enumerate(rows) if r[0] == side] for side in (0, 1))
        index = index_of(one, c.items, c.sizes)
        for i in other:
            for j, o in index.search(c.items[i], least_overlap(c.sizes[i], percent)):
                if c.found.root(i) != c.found.root(j) and c.linked(c.sizes[i], c.sizes[j], o):
                    c.found.join(i, j)
                    yield *group, -1, rows[i][1], rows[j][1]
        roots = set(map(c.found.root, range(len(rows))))
        if len(roots) == 1 or not any(r[3] for r in rows):
            return  # without members beside them, leaders have been compared already
        if sum(r[4] for r in rows) <= 4 * len(rows):  # to search all members is less work than to compare leaders
            open_leaders = range(len(rows))
        else:
            reach, widest = 1 - percent / 100 + 1e-9, max(rows[j][3] for j in one)
            open_leaders = set()
            for i in other:
                radius = rows[i][3] + reach
                for j, o in index.search(c.items[i], max(1, int(np.ceil((1 - radius - widest) * c.sizes[i])))):
                    if c.found.root(i) != c.found.root(j) and 1 - o / (c.sizes[i] + c.sizes[j] - o) <= radius + rows[j][3]:
                        open_leaders |= {i, j}
        for i in sorted(open_leaders):
            yield *group, rows[i][0], rows[i][1], rows[c.found.root(i)][1]

    return work


def _compare_members(percent: int):
    """Members of clusters of two parts (side, label, name, text), those of one label being linked already, to links that join labels."""

    def work(group, shingler, rows):
        c = Clusters([shingler.hashes(r[3]) for r in rows], percent)
        first: dict[int, int] = {}
        for i, r in enumerate(rows):
            c.found.join(i, first.setdefault(r[1], i))
        one, other = ([i for i, r in enumerate(rows) if r[0] == side] for side in (0, 1))
        index = index_of(one, c.items, c.sizes)
        for i in other:
            for j, o in index.search(c.items[i], least_overlap(c.sizes[i], percent)):
                if c.found.root(i) != c.found.root(j) and c.linked(c.sizes[i], c.sizes[j], o):
                    c.found.join(i, j)
                    yield rows[i][2], rows[j][2]

    return work


def class_links(texts: DataFrame, groups: DataFrame, percent: int, group: int) -> DataFrame:
    """(name, root) of the classes in candidate groups: the components of their links."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = groups.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > group)
    sizes = materialize(sizes.select(F.col("root").alias("big"), F.ceil(F.col("n") / group).alias("n_parts")), "large-groups")
    placed = groups.join(sizes, groups["root"] == sizes["big"], "left").select(
        "root", F.when(F.col("n_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("n_parts"))).cast("long").alias("part"), F.col("node").alias("name")
    )
    rows = placed.join(texts.select("name", "text"), "name").select("root", "part", "name", "text")
    dealt = rows.repartition(parts, "root", "part").sortWithinPartitions("root", "part", "name")
    schema = "root long, part long, name long, component long, leader long, distance double"
    own = materialize(dealt.mapInArrow(lean(_by_group(_cluster_part(percent), [c.split()[0] for c in schema.split(", ")], 2)), schema), "clusters")
    local = own.select("name", F.col("component").alias("root")).distinct()
    if not sizes.limit(1).count():
        return local
    large = own.join(sizes, own["root"] == sizes["big"], "left_semi")
    leaders = large.groupBy("root", "part", "leader").agg(F.min("component").alias("component"), F.max("distance").alias("radius"), F.count("*").alias("members"))
    # Any two parts of a group meet in a task of their own, which holds the leaders of those two and no more.
    every = F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)
    met = F.explode(F.transform(every, lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q"))))
    led = leaders.join(F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST else sizes, leaders["root"] == sizes["big"]).withColumn("met", met).where("met.p < met.q")
    side = F.when(F.col("part") == F.col("met.p"), 0).otherwise(1).cast("long").alias("side")
    led = led.join(texts.select(F.col("name").alias("leader"), "text"), "leader").select("root", "met.p", "met.q", side, "leader", "component", "radius", "members", "text")
    dealt = led.repartition(parts, "root", "p", "q").sortWithinPartitions("root", "p", "q", "side", "leader")
    schema = "root long, p long, q long, side long, a long, b long"
    pairs = materialize(dealt.mapInArrow(lean(_by_group(_compare_leaders(percent), [c.split()[0] for c in schema.split(", ")], 3)), schema), "leader-pairs")
    # The members of clusters that may still hold a link, once for each two parts.
    members = large.select(F.col("leader").alias("a"), "name")
    both = pairs.where("side >= 0").join(members, "a").select("root", "p", "q", "side", "b", "name").join(texts.select("name", "text"), "name")
    dealt = both.select("root", "p", "q", "side", "b", "name", "text").repartition(parts, "root", "p", "q").sortWithinPartitions("root", "p", "q", "side", "name")
    members_met = dealt.mapInArrow(lean(_by_group(_compare_members(percent), ["x", "y"], 3)), "x long, y long")
    edges = local.select(F.col("name").alias("a"), F.col("root").alias("b")).unionByName(pairs.where("side < 0").select("a", "b")).unionByName(members_met.toDF("a", "b"))
    joined = components(edges).withColumnRenamed("node", "name")
    return joined.unionByName(local.where("name = root").join(joined.select("name"), "name", "left_anti"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Two documents link when 100 * |A & B| >= percent * |A | B|. Documents without text or words have
    no shingles and are components of their own. Rows that share an id keep a component each.
    A null id has its count but a null component and no links. Extra columns are left out.
    """
    docs = docs.select("doc_id", "text")
    told = materialize(shingle_table(docs), "shingles")
    # A stored number names the class from here on.
    possible = materialize(possible_classes(docs, told, percent).withColumn("name", F.monotonically_increasing_id()), "possible")
    met = shrunk(docs, ["doc_id"]).join(possible.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id").select("name", "d1", "d2", "z")
    texts = materialize(met.mapInArrow(lean(_own_texts), "name long, n long, text string"), "texts")
    groups = materialize(candidate_groups(texts, percent), "groups")
    links = materialize(class_links(texts, groups, percent, group), "links")
    discard(texts)
    nodes = possible.join(links, "name")
    roots = nodes.groupBy("root").agg(F.min("node").alias("component"))
    found = materialize(nodes.join(roots, "root").select("d1", "d2", "component"), "roots")
    for done in (possible, groups, links):
        discard(done)
    copies = told.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"))
    # Stored, so that the last join has a shuffle on either side and Spark can split the partition of a class of many copies.
    component = F.coalesce("component", "first").alias("component")
    classes = materialize(copies.join(found, ["d1", "d2"], "left").select("d1", "d2", component), "components").hint("merge")
    discard(found)
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return told.join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays, the one with the smallest id, with its own columns.

    Rows with a null id stay; an id goes if any of its rows is in the component of a smaller one.
    """
    found = jaccard_components(docs, percent).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def keep_one_row(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component stays, one of those with the smallest id, with its own columns.

    Rows are told apart by a number of their own, not by id: exact copies that share an id or have none leave one row,
    and a text that links to nothing stays whatever other rows have its id. A null id comes after all others.
    """
    row = free_name(docs, "row")
    stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # the same numbers at each reading
    own = stored.select(F.col(row).alias("doc_id"), "text")
    found = materialize(jaccard_components(own, percent).select(F.col("doc_id").alias("n"), "component_id"), "row-components")
    ids = stored.select(F.col(row).alias("n"), F.col("doc_id").alias("id"))
    linked = materialize(found.join(ids, "n").select("n", "component_id", F.struct(F.col("id").isNull().alias("none"), "id", "n").alias("place")), "linked-rows")
    first = linked.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.n").alias("n"))
    gone = materialize(linked.select("n").join(first, "n", "left_anti").withColumnRenamed("n", row), "removed-rows")
    for done in (found, linked):
        discard(done)
    return stored.join(gone, row, "left_anti").select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(a[i : i + 4], ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS i) WHERE len(a) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)
), c AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT c.a, e.b FROM c JOIN e ON c.b = e.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM c GROUP BY 1) m USING (doc_id)
"""
