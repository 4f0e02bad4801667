"""N-gram Jaccard join by prefix trees, and the near-duplicate groups that it gives.

1. Sets.  Every text becomes the set of its distinct n-word shingles (hashes).  Equal sets
   are one class; only its smallest doc_id is joined, copies stay members.  Sets are kept
   in block files in the shared folder, so texts are gone through once.
2. Global order.  All shingles are counted over all documents - blocks send their distinct
   shingles, packed by hash range, so no shingle is a hot key - and ordered by rising
   frequency, then hash.
3. Dealing.  With Jaccard >= t, sets that link share one of the first n - ceil(t n) + 1
   shingles of each in that order.  Shingles that no other document has come first; a
   set with that many of them links with nothing.  The others are dealt by what is left
   of that prefix.  Sets that share a prefix shingle, directly or over others, form a
   candidate group.
4. Trie join.  A group's sets are stored in a prefix tree in one order (falling frequency
   in the group, which shares the longest paths).  Each set walks the tree; sets below a
   node share the overlap found so far; a subtree is left when overlap plus what can
   still come - what is left of the set, or of the subtree's longest set - is below the
   least overlap that its smallest set needs.
5. Components of the links; members take the component of their class.

Groups beyond ``GROUP`` sets are cut into bands of sizes, so wide that sets which link are in
one band or in two neighbours, and bands into blocks.  Pairs of blocks of one band or of
neighbours are tasks of their own, so no task holds a large group, and blocks whose sizes
cannot link never meet.  Hash ranges and tasks are counted from the bytes of text.  Since the result is components, a walk passes over subtrees
whose sets are all linked to it already; copies and links inside a component are never
expanded to all pairs, and no link between components is lost.

Edge cases: null, empty and word-less texts have no shingles and link with nothing;
texts of fewer than n words are one shingle; rows with the same doc_id are taken as one
document, a row each stays; rows with a null doc_id link with nothing of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import WordCache, bit_table, filesystem, flatten, fresh_path, in_table, n_buckets, n_tasks, pick, slices, text_bytes, tidy, tidy_group, tuned, written
from millrace.llm.components import components
from millrace.llm.packing import expand, expand48, pack, read_sections, squeeze, squeeze48, unpack, write_sections
from millrace.llm.subwords import BASE, mix

GROUP = 1000
BLOCK_CHARS = 8_000_000
#: Bits of a shingle's hash.
HASH = 48


def words_of(text: str | None) -> list[bytes]:
    """Words of a text between ASCII white space, A-Z lower-cased and nothing else: what bytes do."""
    return (text or "").encode().lower().split()


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.ones(len(words), np.int64)


def word_cache() -> WordCache:
    return WordCache(_hashes, "uint64")


def shingle_sets(texts: list[str | None], n: int, cache: WordCache) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, counts = flatten(map(words_of, texts))  # bytes serve the cache as well
    codes = cache.codes(words)
    ids = cache.flat[cache.starts[codes]]
    joined = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        joined = joined * BASE + ids[k : len(ids) - n + 1 + k] if len(joined) else joined
    joined = mix(joined)
    out, end = [], 0
    for count in counts.tolist():
        start, end = end, end + count
        if count >= n:
            out.append(np.unique(joined[start : end - n + 1] >> np.uint64(64 - HASH)))
        elif count:
            h = np.zeros(1, np.uint64)
            for x in ids[start:end]:
                h = h * BASE + x
            out.append(mix(h ^ np.uint64(count)) >> np.uint64(64 - HASH))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Trie:
    """Prefix tree of sets of ordered small integers; one node per run without branches."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """sets in lexicographic order; sizes are the full sizes, of which sets hold the shared part."""
        self.sets, self.sizes = sets, sizes
        self.runs: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.ends: list[list[int]] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.below: list[int] = []
        self.uniform: list[int] = []
        self._build(0, len(sets), 0)

    def _node(self, run: np.ndarray) -> int:
        self.runs.append(run)
        self.children.append([])
        self.ends.append([])
        self.least.append(0)
        self.most.append(0)
        self.below.append(0)
        self.uniform.append(-1)
        return len(self.runs) - 1

    def _build(self, a: int, b: int, depth: int) -> None:
        """Builds the tree of sets a..b from the common prefixes of neighbours, without recursion."""
        work = [(a, b, depth, -1)]
        while work:
            a, b, depth, parent = work.pop()
            first, last = self.sets[a], self.sets[b - 1]
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:n] != last[depth:n])
            end = depth + int(differ[0]) if len(differ) else n
            node = self._node(first[depth:end])
            self.least[node], self.most[node] = int(self.sizes[a:b].min()), int(self.sizes[a:b].max())
            self.below[node] = max(len(self.sets[i]) for i in range(a, b)) - end
            if parent >= 0:
                self.children[parent].append(node)
            i = a
            while i < b and len(self.sets[i]) == end:
                self.ends[node].append(i)
                i += 1
            while i < b:
                token, j = self.sets[i][end], i + 1
                while j < b and self.sets[j][end] == token:
                    j += 1
                work.append((i, j, end, node))
                i = j


def _least_overlap(a: int, b: int, num: int, den: int) -> int:
    """The least intersection with which sets of sizes a and b link."""
    return -(-num * (a + b) // (num + den))


def trie_join(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever links connect: pairs of places of sets with
    den * intersection >= num * union.

    sets hold distinct integers.  With ``other`` (a flag a set) only links between
    flagged and unflagged sets are looked for.
    """
    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    shared = counts[place] > 1
    owner = np.repeat(np.arange(len(sets)), lengths)[shared]
    ranks = rank[place][shared]
    order = np.lexsort((ranks, owner))
    kept = np.bincount(owner, minlength=len(sets))
    ordered = np.split(ranks[order], np.cumsum(kept)[:-1])
    by = sorted(range(len(sets)), key=lambda i: ordered[i].astype(">u4").tobytes())
    trie = Trie([ordered[i] for i in by], np.asarray(sizes)[by])
    flags = None if other is None else np.asarray(other)[by]
    root = list(range(len(by)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    mark = np.zeros(len(tokens), bool)
    for x in range(len(by)):
        if flags is not None and not flags[x]:
            continue
        own, size = trie.sets[x], int(trie.sizes[x])
        mark[own] = True
        work = [(0, 0)]
        while work:
            node, overlap = work.pop()
            if trie.uniform[node] >= 0 and find(trie.uniform[node]) == find(x):
                continue
            low, high = max(trie.least[node], -(-size * num // den)), min(trie.most[node], size * den // num)
            if low > high:
                continue
            run = trie.runs[node]
            overlap += int(mark[run].sum())
            after = len(own) - int(np.searchsorted(own, run[-1], "right")) if len(run) else len(own)
            if overlap + min(after, trie.below[node]) < _least_overlap(size, low, num, den):
                continue
            for y in trie.ends[node]:
                if y != x and (flags is None or not flags[y]) and overlap >= _least_overlap(size, int(trie.sizes[y]), num, den) and find(x) != find(y):
                    root[find(y)] = find(x)
                    links.append((by[x], by[y]))
            work += [(c, overlap) for c in trie.children[node]]
        mark[own] = False
        if x % 16 == 0:
            _unify(trie, find)
            if trie.uniform[0] >= 0:
                break
    return links


def _unify(trie: Trie, find) -> None:
    """Notes the subtrees whose sets are all of one component by now.  Children come after parents."""
    for node in range(len(trie.runs) - 1, -1, -1):
        if trie.uniform[node] < 0:
            some = trie.ends[node][:1] or [trie.uniform[c] for c in trie.children[node][:1]]
            if some and some[0] >= 0:
                top = find(some[0])
                if all(find(y) == top for y in trie.ends[node]) and all(trie.uniform[c] >= 0 and find(trie.uniform[c]) == top for c in trie.children[node]):
                    trie.uniform[node] = some[0]


HASHES = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("hashes", pa.binary())])
KEYS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("token", pa.int64())])


class Block:
    """Sets of documents that are written together."""

    def __init__(self, number: int = 0) -> None:
        self.number = number
        self.ids: list[int | None] = []
        self.sets: list[np.ndarray] = []
        self.chars = 0

    def write(self, folder: str, buckets: int) -> pa.RecordBatch:
        """Writes the sets to a file; returns its distinct hashes and their documents, a row a hash range."""
        import xxhash

        flat = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        sections = [
            np.array([i or 0 for i in self.ids], "<i8").tobytes(), np.array([i is None for i in self.ids], np.uint8).tobytes(),
            squeeze(np.fromiter(map(len, self.sets), np.uint32, len(self.sets))), b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in self.sets), squeeze48(flat),
        ]
        name = write_sections(folder, sections, "sets", self.number)
        hashes, counts = np.unique(flat, return_counts=True)
        cuts = np.searchsorted(hashes, np.array([(k << HASH) // buckets for k in range(buckets + 1)], np.uint64)).tolist()
        rows = [(k, pack(counts[a:b], squeeze48(hashes[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a or not k]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=HASHES)


def read_block(name: str) -> tuple[list[int | None], np.ndarray, list[bytes], np.ndarray]:
    """Document ids, sizes, set keys and joined sets of a block file."""
    ids, null, sizes, keys, flat = read_sections(name)
    ids = [None if no else i for i, no in zip(np.frombuffer(ids, "<i8").tolist(), null)]
    return ids, expand(sizes).astype(np.int64), [keys[i : i + 16] for i in range(0, len(keys), 16)], expand48(flat)


def shingle_counts(texts: DataFrame, n: int) -> DataFrame:
    """(block, bucket, hashes): per block its shingles that more than one document has, with
    how many have them; every block has a row.  Writes the block files on the way."""
    size = text_bytes(texts)
    buckets, tasks = n_buckets(size), n_tasks(texts.sparkSession, size)
    folder = fresh_path(texts.sparkSession, "sets")
    store, local = filesystem(folder)
    store.create_dir(local)

    def sign(batches):
        cache, block = word_cache(), Block()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                if block.chars > BLOCK_CHARS:
                    yield block.write(folder, buckets)
                    block = Block(block.number + 1)
                block.sets += shingle_sets(texts[a:b], n, cache)
                block.ids += ids[a:b]
                block.chars += sum(map(len, texts[a:b]))
        if block.ids:
            yield block.write(folder, buckets)

    def count(table: pa.Table) -> pa.Table:
        counts, hashes = zip(*((c, expand48(h)) for c, h in map(unpack, table.column("hashes").to_pylist())))
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts)).astype(np.int64)[place] if len(place) else place
        out = []
        for own, df in zip(hashes, np.split(total, np.cumsum([len(h) for h in hashes])[:-1])):
            more = df > 1
            out.append(pack(df[more], squeeze48(own[more])))
        return pa.Table.from_arrays([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], schema=HASHES)

    sent = texts.mapInArrow(tidy(sign), "block string, bucket int, hashes binary")
    return written(sent.repartitionById(tasks, F.col("bucket")).groupBy("bucket").applyInArrow(tidy_group(count), "block string, bucket int, hashes binary"), "shingle-counts")


def set_keys(blocks: DataFrame) -> DataFrame:
    """(doc_id, n, key) of all documents: size and a hash of the whole set, null where it is empty."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                ids, sizes, keys, _ = read_block(name)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([k if n else None for k, n in zip(keys, sizes)], pa.binary())], schema=KEYS)

    return blocks.mapInArrow(tidy(run), "doc_id long, n long, key binary")


def prefix_tokens(counts: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, token): what is left of each set's prefix after the shingles that no other document has."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, _, flat = read_block(table.column("block")[0].as_py())
        parts = [(c, expand48(h)) for c, h in map(unpack, table.sort_by("bucket").column("hashes").to_pylist())]
        known, df = np.concatenate([h for _, h in parts]), np.concatenate([c for c, _ in parts])
        at = np.searchsorted(known, flat)
        shared = np.zeros(len(flat), bool)
        inside = at < len(known)
        shared[inside] = known[at[inside]] == flat[inside]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        left = (sizes - -(-sizes * num // den) + 1) - (sizes - np.bincount(owner[shared], minlength=len(sizes)))
        use = np.flatnonzero(shared & (left > 0)[owner])
        order = use[np.lexsort((flat[use], df[at[use]], owner[use]))]
        own = owner[order]
        counts = np.bincount(own, minlength=len(sizes))
        rank = np.arange(len(order)) - (np.cumsum(counts) - counts)[own]
        kept = order[rank < left[own]]
        docs = np.array([i if i is not None else 0 for i in ids], np.int64)[owner[kept]]
        valid = np.array([i is not None for i in ids], bool)[owner[kept]]
        return pa.Table.from_arrays([pa.array(docs[valid]), pa.array(flat[kept][valid].astype(np.int64))], schema=TOKENS)

    return counts.groupBy("block").applyInArrow(tidy_group(run), "doc_id long, token long")


def _sets(blocks: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc_id, n, found) of the documents whose id is in a bit table: their sets as bytes."""
    shared = blocks.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                ids, sizes, _, flat = read_block(name)
                valid = np.array([i is not None for i in ids], bool)
                keep = np.flatnonzero(valid & in_table(shared.value, np.array([i or 0 for i in ids], np.int64)))
                ends = np.cumsum(sizes)
                found = [flat[ends[i] - sizes[i] : ends[i]].tobytes() for i in keep.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep.tolist()], pa.int64()), pa.array(sizes[keep], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "found"])

    return blocks.mapInArrow(tidy(run), "doc_id long, n long, found binary")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
TASK = ("group", "left_band", "i", "right_band", "j")


def _task_links(tasks: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of every task: rows (TASK, right, doc_id, n, found), dealt and sorted by task; ``right`` tells the sides apart."""

    def run(batches):
        def join(key, rows):
            sets = [np.frombuffer(r["found"], np.uint64) for r in rows]
            across = None if key[1:3] == key[3:] else np.array([r["right"] for r in rows])
            ids = [r["doc_id"] for r in rows]
            found = trie_join(sets, np.array([r["n"] for r in rows]), num, den, across)
            return [{"a": ids[x], "b": ids[y]} for x, y in found if ids[x] != ids[y]]

        held, key = [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = tuple(row[c] for c in TASK)
                if now != key and held:
                    out += join(key, held)
                    held = []
                key = now
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, LINKS)
        if held:
            yield pa.RecordBatch.from_pylist(join(key, held), LINKS)

    dealt = tasks.repartition(*TASK).sortWithinPartitions(*TASK, "doc_id")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def candidate_groups(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component): classes that share prefix tokens, directly or over others.

    Each token links its sets to the first of them: minima by partial aggregation, then a
    join that may be split, so a token that many sets have is no hot group.
    """
    ones = written(tokens.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "prefix-tokens")
    first = ones.groupBy("token").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("token", "first")
    met = ones.join(first, "token").where("first <> doc_id").select("doc_id", "first").distinct()
    return written(components(met, "first", "doc_id"), "groups")


def class_links(blocks: DataFrame, groups: DataFrame, num: int, den: int, group_size: int = GROUP, sizes: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between classes of the candidate groups, by trie joins.

    A group of at most ``group_size`` sets is one task.  In larger ones a set goes to a task
    for each block of its own band and of the two bands beside it.  sizes holds (doc_id, n).
    """
    members = groups.select(F.col("component").alias("group"), F.col("node").alias("doc_id"))
    large = written(members.groupBy("group").count().where(F.col("count") > group_size).select("group", F.lit(True).alias("large")), "large-groups")
    # a band is a little wider than the largest ratio of sizes that link, so rounding parts no link by two bands
    width = math.log(den / num) * 1.0001 if num < den else 1e-9
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long")
    sizes = set_keys(blocks) if sizes is None else sizes
    counts = members.join(large, "group").join(sizes.select("doc_id", "n"), "doc_id").groupBy("group", band.alias("band")).agg(F.ceil(F.count("*") / group_size).cast("int").alias("k"))
    counts = written(counts, "bands")
    sets = _sets(blocks, bit_table(members, "doc_id")).join(members.hint("merge"), "doc_id").join(large, "group", "left")
    dealt = sets.withColumn("band", F.when(F.col("large"), band).otherwise(F.lit(0)))
    for d, name in ((0, "k"), (1, "below"), (-1, "above")):
        dealt = dealt.join(counts.select("group", (F.col("band") + d).alias("band"), F.col("k").alias(name)), ["group", "band"], "left")
    own = F.when(F.col("k") > 0, F.pmod(F.xxhash64("doc_id"), F.coalesce("k", F.lit(1))).cast("int")).otherwise(F.lit(0))
    dealt = dealt.withColumn("block", own)
    to = lambda left, i, right, j, side: F.struct(left.alias("left_band"), i.alias("i"), right.alias("right_band"), j.alias("j"), side.alias("right"))
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here, block = F.col("band"), F.col("block")
    same = F.transform(upto(F.coalesce("k", F.lit(1))), lambda o: to(here, F.least(block, o), here, F.greatest(block, o), block > o))
    lower = F.transform(upto(F.col("below")), lambda o: to(here - 1, o, here, block, F.lit(True)))
    upper = F.transform(upto(F.col("above")), lambda o: to(here, block, here + 1, o, F.lit(False)))
    tasks = dealt.select("group", "doc_id", "n", "found", F.explode(F.concat(same, lower, upper)).alias("t")).select("group", "t.*", "doc_id", "n", "found")
    return written(_task_links(tasks, num, den), "class-links")


def near_duplicates(df: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row.

    Texts link when den * intersection >= num * union of their n-word shingle sets.
    class_id is the smallest doc_id with the same set, component_id the smallest one
    reachable by links.
    """
    texts = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    counts = shingle_counts(texts, n)
    blocks = written(counts.select("block").distinct(), "blocks")
    blocks = blocks.repartition(max(1, blocks.count()), "block")
    signed = written(set_keys(blocks), "set-keys")
    classes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    groups = candidate_groups(prefix_tokens(counts, num, den), classes)
    ends = components(class_links(blocks, groups, num, den, sizes=signed))
    ends = ends.select(F.col("node").alias("rep"), "component")
    named = classes.join(ends, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n", "key").join(named, "key", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")
