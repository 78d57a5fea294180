"""Near dedup: a chosen-path set similarity join over word shingles, then connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, session_conf, staged, worker_cache

#: Words whose hashes a worker keeps.
CACHE = 100_000
#: Minwise hash functions of a signature; two bits of each make up a sketch.
HASHES = 64
#: Shingles after which a task hands on the sets it has.
FLUSH = 200_000
#: Bytes of texts that Spark hands to a task at once: the batch is held by the executor and by its Python worker.
BATCH = "8m"
#: Members of a node that tell where its middle is, on average.
SAMPLE = 32
#: Classes of the members of a node, each of which has a centre.
CENTRES = 4
#: Columns of a member of a node: its id and component, the size of its set, its sketch.
MEMBER = ["rid", "comp", "n", "s1", "s2"]
#: One set in so many tells which tokens are common, those that COMMON of them have, the MOST_COMMON most frequent ones.
ORDER_SAMPLE, COMMON, MOST_COMMON = 16, 3, 50_000
#: Trees end when one set in so many, or fewer, are left in them: these take the exact path.
LEFT = 16
_ODD = np.random.default_rng(20240131).integers(0, 2**63, (3, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """Sets are distinct shingles of `words` words; documents are linked if their Jaccard similarity is percent / 100 or
    more. trees independent trees are built. Nodes of at most leaf members are compared exhaustively; larger ones with
    `pivots` members, and branch with `reps` representatives of each component by up to `path` tokens a level, as many as
    bring members of similarity `expected` down to leaf. A pair of similarity j shares a root with a probability of
    1 - (1 - j) ** trees, above 1 - 1e-7 at the threshold, and a child of a shared node with about 1 - 1 / e at the
    threshold and more above it."""

    words: int = 5
    percent: int = 80
    trees: int = 10
    leaf: int = 64
    pivots: int = 4
    reps: int = 4
    path: int = 8
    expected: float = 0.75
    seed: int = 1

    @property
    def most_bits(self) -> int:
        """Differing sketch bits that a pair at the threshold exceeds with four standard deviations."""
        away = 1 - self.percent / 100
        return int(np.ceil(HASHES * away + 4 * np.sqrt(HASHES * (1.5 * away - away * away))))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z in lower case; a text with fewer words is one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    mixed = np.full(len(h) - n + 1, 0x9E3779B97F4A7C15 * n % 2**64, np.uint64)
    for i in range(n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - n + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 4096):
        part = found[i : i + 4096]
        least = np.minimum(least, (part[None, :] * _ODD[0][:, None] + _ODD[1][:, None]).min(1))
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """128 bits: two of each smallest value, mixed anew."""
    two = ((least * _ODD[2]) >> np.uint64(62)).astype(np.uint8)
    return np.packbits(np.stack([two & 1, two >> 1], 1).ravel()).view(np.int64)


def _worker_hashes() -> _Hashes:
    cache = worker_cache("shingle-words")
    return cache.get("hashes") or cache.setdefault("hashes", _Hashes())


def shingle_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n (size of the set), digest (of the set), sig (32 bits of each minwise value), s1, s2 (the sketch), set."""
    import pyarrow as pa

    names = ["doc_id", "n", "digest", "sig", "s1", "s2", "set"]

    def made(ids: pa.Array, sets: list[np.ndarray], sigs: list[np.ndarray], bits: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        listed = lambda parts, dtype, each: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(np.concatenate(parts).view(dtype)))
        digests = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())
        two = np.stack(bits)
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), digests, listed(sigs, np.int32, np.full(len(sets), HASHES)), pa.array(two[:, 0]), pa.array(two[:, 1]), listed(sets, np.int64, sizes)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _worker_hashes()
        for batch in batches:
            first, held, sets, sigs, bits = 0, 0, [], [], []
            for i in range(batch.num_rows):
                found = shingles(batch.column(1)[i].as_py() or "", s.words, hashes)
                least = signature(found)
                sets.append(found)
                sigs.append((least >> np.uint64(32)).astype(np.uint32))
                bits.append(sketch(least))
                held += len(found)
                if held >= FLUSH or i + 1 == batch.num_rows:
                    yield made(batch.column(0)[first : i + 1].cast(pa.int64()), sets, sigs, bits)
                    first, held, sets, sigs, bits = i + 1, 0, [], [], []
            del batch  # the next one comes while this one would be held
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, sig array<int>, s1 long, s2 long, set array<long>")


def _apart(a, b) -> Column:
    """Differing bits of two sketches."""
    return F.bit_count(a("s1").bitwiseXOR(b("s1"))) + F.bit_count(a("s2").bitwiseXOR(b("s2")))


def _near(a, b, s: Settings) -> Column:
    """Neither the sizes of two sets nor their sketches rule a link out."""
    return (100 * F.least(a("n"), b("n")) >= s.percent * F.greatest(a("n"), b("n"))) & (_apart(a, b) <= s.most_bits)


def _own(name: str) -> Column:
    return F.col(name)


def _of(name: str):
    return lambda field: F.col(f"{name}.{field}")


def _nodes(rows: DataFrame, s: Settings) -> DataFrame:
    """Per node that holds more than one component: node, m (members) and its pivots p0, p1, …: the members with the
    smallest of several hashes of node and id."""
    least = [F.min(F.struct(F.xxhash64("rid", "node", F.lit(j)).alias("h"), *MEMBER)).alias(f"p{j}") for j in range(s.pivots)]
    return rows.groupBy("node").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *least).where("lo < hi").drop("lo", "hi")


def _settle(rows: DataFrame, s: Settings) -> DataFrame:
    """Members of open nodes, with m, the members of the node, big (more than leaf), and the nearest pivot of another
    component (bits, rid) if sizes and sketches allow a link."""
    nodes = staged(_nodes(rows, s), "nodes")
    each = [F.when((F.col(f"p{j}.comp") != F.col("comp")) & _near(_own, _of(f"p{j}"), s), F.struct(_apart(_own, _of(f"p{j}")).alias("bits"), F.col(f"p{j}.rid").alias("rid"))) for j in range(s.pivots)]
    return staged(rows.join(nodes, "node").select("node", *MEMBER, "m", (F.col("m") > s.leaf).alias("big"), F.array_min(F.array(*each)).alias("nearest")), "members")


def _centres(members: DataFrame, s: Settings) -> DataFrame:
    """Rows (node, member): the members in the middle of each larger node, one of each of CENTRES classes, which are
    pivots as well: those whose sketches differ least from those of about SAMPLE members. In a group of near copies these
    are the text that the others come from, if the node has it, and its nearest copies."""
    big = members.where("big").select("node", *MEMBER, "m")
    h = F.xxhash64("rid", "node", F.lit(s.seed))
    sample = staged(big.where(F.pmod(h, F.col("m")) < SAMPLE).groupBy("node").agg(F.collect_list(F.struct("s1", "s2")).alias("sample")), "node-samples")
    far = F.aggregate("sample", F.lit(0), lambda acc, x: acc + _apart(_own, lambda c: x[c]))
    rows = big.join(sample, "node").select("node", F.pmod(F.xxhash64(h), F.lit(CENTRES)).alias("class"), F.struct(far.alias("far"), h.alias("h"), *MEMBER).alias("c"))
    return rows.groupBy("node", "class").agg(F.min("c").alias("c")).select("node", *[F.col(f"c.{c}").alias(c) for c in MEMBER])


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _met(members: DataFrame, pivots: DataFrame, s: Settings) -> DataFrame:
    """Members x of larger nodes and pivots y of theirs, of another component, where sizes and sketches allow a link."""
    x, y = members.where("big").alias("x"), pivots.alias("y")
    return x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _near(_of("x"), _of("y"), s))


def _nearest_pairs(members: DataFrame, centres: DataFrame, s: Settings) -> DataFrame:
    """Each member with what is nearest by sketch among the pivots and centres of all its nodes: one pair a member."""
    middle = _met(members, centres, s).select("x.rid", F.struct(_apart(_of("x"), _of("y")).alias("bits"), F.col("y.rid").alias("rid")).alias("nearest"))
    best = members.where(F.col("nearest").isNotNull()).select("rid", "nearest").unionByName(middle)
    return best.groupBy("rid").agg(F.min("nearest").alias("nearest")).select(*_pair(F.col("rid"), F.col("nearest.rid"))).distinct()


def _leaf_pairs(members: DataFrame, s: Settings) -> DataFrame:
    """All pairs of different components in nodes of at most leaf members."""
    x, y = (members.where(~F.col("big")).select("node", *MEMBER).alias(k) for k in "xy")
    return x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.rid") < F.col("y.rid")) & (F.col("x.comp") != F.col("y.comp")) & _near(_of("x"), _of("y"), s)).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))


def _pivots(members: DataFrame, s: Settings) -> DataFrame:
    """The pivots of larger nodes that hold more than one component, as rows (node, member)."""
    each = F.array_distinct(F.array(*[F.struct(*[F.col(f"p{j}.{c}").alias(c) for c in MEMBER]) for j in range(s.pivots)]))
    return _nodes(members.where("big"), s).select("node", F.explode(each).alias("p")).select("node", "p.*")


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows with the component known of each so far, itself at first."""
    if comps is None:
        return rows.withColumn("comp", F.col("rid"))
    return rows.drop("comp").join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))


def _children(members: DataFrame, pivots: DataFrame, reps: DataFrame, s: Settings, level: int) -> DataFrame:
    """Branches nodes of more than leaf members, which have been compared with their pivots: pivots are done here and go no
    further, and each component sends its representatives, the members with the smallest of several hashes, so that what
    has joined isn't branched as a whole. A node takes up to `path` tokens at once, as its size asks for, and
    (1 / threshold) ** tokens such choices on average, as the same steps one by one would; members that share all
    tokens of a choice share the child. A node that has become small is compared as it is."""
    left = members.where("big").select("node", *MEMBER).join(pivots.select("node", "rid"), ["node", "rid"], "left_anti")
    hashed = [F.min(F.struct(F.xxhash64("rid", "node", F.lit(-1 - j)).alias("h"), "rid", "n", "s1", "s2")).alias(f"r{j}") for j in range(s.reps)]
    plain = F.array_distinct(F.array(*[F.struct(*[F.col(f"r{j}.{c}").alias(c) for c in ("rid", "n", "s1", "s2")]) for j in range(s.reps)]))
    left = staged(left.groupBy("node", "comp").agg(*hashed).select("node", "comp", F.explode(plain).alias("r")).select("node", "comp", "r.*"), "node-reps")
    sizes = left.groupBy("node").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node", "m")
    left = left.join(staged(sizes, "node-sizes"), "node")
    small = left.where(F.col("m") <= s.leaf).select(F.xxhash64("node", F.lit(level)).alias("node"), *MEMBER)

    q = F.least(F.lit(s.path), F.ceil(F.log(F.col("m") / s.leaf) / -np.log(s.expected)).cast("int"))
    many = F.pow(F.lit(100 / s.percent), q)
    u = F.pmod(F.xxhash64("node", F.lit(s.seed)), F.lit(10_000)) / 10_000
    choices = F.sequence(F.lit(1), F.greatest(F.lit(1), (many + u).cast("int")))
    rows = left.where(F.col("m") > s.leaf).join(reps.select("rid", "sig"), "rid").select("node", *MEMBER, "sig", q.alias("q"), F.explode(choices).alias("choice"))
    at = [F.pmod(F.xxhash64("node", "choice", F.lit(k), F.lit(s.seed)), F.lit(HASHES)).cast("int") + 1 for k in range(s.path)]
    tokens = [F.when(F.col("q") > k, F.element_at("sig", at[k])) for k in range(s.path)]
    return rows.select(F.xxhash64("node", "choice", *tokens).alias("node"), *MEMBER).unionByName(small)


def verify(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose whole sets (rid, set) are similar enough. pairs must be distinct and staged."""
    ids = staged(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "rid"), "pair-ids")
    sets = sets.join(ids, "rid", "left_semi")
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("k", shared).where((F.col("k") > 0) & (100 * F.col("k") >= s.percent * (F.size("x") + F.size("y") - F.col("k")))).select("a", "b")


def _spread(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Each node takes the smallest label that it or a neighbour has; edges go both ways."""
    near = edges.join(comps.select(F.col("rid").alias("u"), "comp"), "u").select(F.col("v").alias("rid"), "comp")
    return near.unionByName(comps).groupBy("rid").agg(F.min("comp").alias("comp"))


def components(edges: DataFrame) -> DataFrame:
    """rid, comp: the smallest id of the connected component of each id in edges (a, b). Labels spread to neighbours and
    then jump to the label of their label, until none changes: few rounds, even for chains."""
    ways = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    now = staged(ways.groupBy(F.col("u").alias("rid")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "comps")
    while True:
        new = staged(_spread(ways, now), "spread")
        jump = new.select(F.col("rid").alias("comp"), F.col("comp").alias("next"))
        new = new.join(jump, "comp", "left").select("rid", F.coalesce("next", "comp").alias("comp"))
        new = staged(new.join(now.select("rid", F.col("comp").alias("was")), "rid"), "comps")
        now = new.select("rid", "comp")
        if new.where("comp != was").isEmpty():
            return now


def _merged(links: DataFrame, comps: DataFrame | None) -> DataFrame:
    """comps (rid, comp) with further links (a, b): only what links join is computed anew."""
    if comps is None:
        return components(links)
    ids = links.select("a").union(links.select("b")).distinct().withColumnRenamed("a", "rid")
    comps = staged(ids.join(comps, "rid", "left_anti").select("rid", F.col("rid").alias("comp")).unionByName(comps), "comps")
    ends = links
    for end in "ab":
        ends = ends.join(comps.select(F.col("rid").alias(end), F.col("comp").alias(f"c{end}")), end)
    edges = staged(ends.where("ca != cb").select(*_pair(F.col("ca"), F.col("cb"))).distinct(), "comp-edges")
    if edges.isEmpty():
        return comps
    moved = components(edges).select(F.col("rid").alias("comp"), F.col("comp").alias("to"))
    return staged(comps.join(moved, "comp", "left").select("rid", F.coalesce("to", "comp").alias("comp")), "comps")


def _shared_ids(usable: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the sets of rows that share a doc_id."""
    h = F.xxhash64("digest")
    several = usable.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo < hi").select("doc_id")
    several = staged(several, "ids-with-sets")
    if several.isEmpty():
        return reps.select(F.col("rid").alias("a"), F.col("rid").alias("b")).where("false")
    of = usable.join(several, "doc_id").select("doc_id", "digest").distinct().join(reps.select("digest", "rid"), "digest")
    first = of.groupBy("doc_id").agg(F.min("rid").alias("a"))
    return of.join(first, "doc_id").select("a", F.col("rid").alias("b")).where("a < b").distinct()


def _prefixes(sets: DataFrame, s: Settings) -> DataFrame:
    """rid, n, prefix: the tokens of each set (rid, set) of which a similar set has one as well: the first n - ceil(n x threshold) + 1
    in an order that all sets share, in which tokens that are common in a sample come last, the most frequent ones at the end.
    Any such order is exact; this one keeps common tokens out of most sets."""
    import pyarrow as pa

    sample = sets.where(F.pmod(F.xxhash64("rid", F.lit(s.seed)), F.lit(ORDER_SAMPLE)) == 0).select(F.explode("set").alias("token"))
    common = sample.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST_COMMON)
    found = sorted((r["token"], r["count"]) for r in common.collect())
    common, often = np.array([t for t, _ in found], np.int64), np.array([c for _, c in found], np.int64)
    percent = s.percent

    def ordered(x: np.ndarray) -> np.ndarray:
        if not len(common):
            return x
        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
        late = common[at] == x
        return np.concatenate([x[~late], x[late][np.argsort(often[at[late]], kind="stable")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            sizes = np.diff(first)
            # all sets are in the order of their values, which breaks ties
            parts = [ordered(values[first[i] : first[i + 1]])[: n - -(-percent * n // 100) + 1] for i, n in enumerate(sizes)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), prefix], ["rid", "n", "prefix"])

    return sets.mapInArrow(run, "rid long, n int, prefix array<long>")


def _rest_pairs(usable: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """All pairs of sets that may be similar, of different components, one of which is marked rest in labels (rid, comp, rest; all sets
    of a component alike): they share a token of those that similar sets share, and neither their sizes nor what follows the token in
    each rules a link out. Tokens of one component alone are left out, and members of a component meet only those of others. Sets get
    their labels as a whole; their tokens are dealt once, and only those that two components share are staged."""
    post = _prefixes(usable.select("rid", "set"), s).join(labels, "rid").select("rid", "comp", "rest", "n", F.posexplode("prefix").alias("at", "token"))
    of = Window.partitionBy("token")
    post = post.withColumns({"lo": F.min("comp").over(of), "hi": F.max("comp").over(of), "any": F.max("rest").over(of)}).where("lo < hi AND any")
    post = staged(post.select("token", "rid", "comp", "rest", (F.col("at") + 1).alias("at"), "n"), "live-postings")
    comps = post.groupBy("token", "comp").agg(F.max("rest").alias("rest"))
    x, y = comps.where("rest").select("token", F.col("comp").alias("cx")), comps.select("token", F.col("comp").alias("cy"), F.col("rest").alias("too"))
    two = x.join(y, "token").where("cx <> cy AND (NOT too OR cx < cy)").drop("too")
    side = lambda c, rows: rows.select("token", F.col("comp").alias(f"c{c}"), F.col("rid").alias(c), F.col("at").alias(f"at_{c}"), F.col("n").alias(f"n_{c}"))
    both = two.join(side("x", post.where("rest")), ["token", "cx"]).join(side("y", post), ["token", "cy"])
    left = 1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    fits = (100 * F.least("n_x", "n_y") >= s.percent * F.greatest("n_x", "n_y")) & ((100 + s.percent) * left >= s.percent * (F.col("n_x") + F.col("n_y")))
    return both.where(fits).select(*_pair(F.col("x"), F.col("y"))).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents with equal sets are one member. Each tree first splits the members by their minwise tokens at one position.
    In every node all members are compared with the node's pivots, the nearest by sketch first; nodes of at most leaf
    members are compared exhaustively, where that can still join components; larger ones branch by further tokens, with
    representatives of what has joined, until few sets are left in open nodes. Sketches rule pairs out; every link is
    confirmed on full sets. What trees don't follow to the end, all members of components and the sets left in open nodes,
    then meets all sets of other components by an exact prefix join without sketches. component_id is the smallest doc_id reachable over links; kept marks it. In trees the pairs of a
    member are bounded by leaf and pivots in each of its nodes, whatever the size of a group of copies.

    Null and empty texts, and texts of white space, have empty sets and are linked with nothing. Rows that share a doc_id
    are one document, linked by any of its texts; rows without an id are kept and linked with nothing. Texts of any
    length are read whole. Other columns are ignored, whatever their names. An empty table gives no rows."""
    s = settings
    with session_conf(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH}):
        all_ = staged(shingle_sets(docs, s).withColumn("rid", F.monotonically_increasing_id()), "shingle-sets", "snappy", **{"parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 25)})
    usable = all_.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    reps = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("rid", "n", "sig", "s1", "s2")).alias("r")).select("digest", "doc_id", "r.rid", F.col("r.n").cast("int").alias("n"), "r.sig", "r.s1", "r.s2")
    reps, sets, comps = staged(reps, "shingle-reps"), all_.select("rid", "set"), None
    tested: DataFrame | None = None

    def compare(pairs: DataFrame) -> None:
        nonlocal comps, tested
        pairs = staged(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = staged(verify(pairs, sets, s), "links")
            if not links.isEmpty():
                comps = _merged(links, comps)

    same = staged(_shared_ids(usable, reps), "shared-ids")
    if not same.isEmpty():
        comps = _merged(same, comps)
    step = max(1, HASHES // s.trees)
    roots = F.array(*[F.xxhash64(F.lit(t), F.element_at("sig", 1 + t * step % HASHES)) for t in range(s.trees)])
    rows = _labelled(reps.select(F.explode(roots).alias("node"), "rid", "n", "s1", "s2"), comps)
    level, all_reps, open_ = 0, reps.count(), None
    while True:
        members = _settle(rows, s)
        centres = staged(_centres(members, s), "centres")
        compare(_nearest_pairs(members, centres, s))
        members = staged(_labelled(members.drop("nearest"), comps), "members")
        pivots = staged(_pivots(members, s), "pivots")
        pivots = staged(pivots.unionByName(_labelled(centres, comps).join(pivots.select("node"), "node", "left_semi").select("node", *MEMBER)).distinct(), "pivots")
        met = _met(members, pivots, s).select(*_pair(F.col("x.rid"), F.col("y.rid")))
        compare(_leaf_pairs(members, s).unionByName(met).distinct())
        if pivots.isEmpty():
            break
        level += 1
        rows = staged(_children(_labelled(members.where("big"), comps), pivots, reps, s, level), "children")
        if LEFT * rows.select("rid").distinct().count() <= all_reps:
            open_ = rows.select("rid")
            break
    rest = [x for x in (open_, None if comps is None else comps.select("rid")) if x is not None]
    if rest:
        rest = rest[0] if len(rest) == 1 else rest[0].unionByName(rest[1])
        labels = _labelled(reps.select("rid"), comps).join(rest.distinct().withColumn("rest", F.lit(True)), "rid", "left").withColumn("rest", F.coalesce("rest", F.lit(False)))
        compare(_rest_pairs(usable, staged(labels, "set-labels"), s))
    of = _labelled(reps.select("digest", "rid", "doc_id"), comps)
    of = staged(of, "set-components")
    least = of.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = all_.select("doc_id", "n", "digest").join(of.join(least, "comp").select("digest", "component_id"), "digest", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
