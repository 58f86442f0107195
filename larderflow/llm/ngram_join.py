"""N-gram Jaccard join: texts whose sets of word shingles are similar, found by prefixes under several token orders.

Two sets with Jaccard similarity of at least t share at least ceil(t n) tokens of the one with n tokens. So whatever
global order the tokens are put in, the first n - ceil(t n) + 1 tokens of both sets (their prefixes) share a token. That
holds for each order alone, so a pair must pass all of them before its sets are compared in full. The orders used here
begin alike with the tokens that only one set has, which match nothing and need not be looked at again; then come all
others, (0) by ascending number of sets, (1) by value and (2) by a hash. Candidates are drawn from order 0 and must pass
orders 1 and 2.

Sets are compared, not documents: documents with equal sets are one class from the start. In dense classes of near
copies not all pairs are looked at. The sets sharing a prefix token are first compared with one anchor; what that joins
is one component, and only sets that still lie in different components are compared afterwards, in tiles. So every two
components with a link between them are joined, and components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from larderflow.llm import text as tx
from larderflow.llm.components import components
from larderflow.session import written

SIZE = 5
THRESHOLD = 75
# Tokens that one task sorts in memory; the number of tasks follows from the counted tokens.
TOKENS_PER_TASK = 2_000_000
# Tokens of the sets of a tile; a tile with a single longer set is larger.
TILE_TOKENS = 400_000
ORDERS = ("by_count", "by_value", "by_hash")
# Tokens gathered before they are dealt out to tasks.
TOKENS_PER_PACK = 1_000_000
# A token in more than 1 of so many sets is common. At most RARITY * (mean set size) tokens can be, at any corpus size.
RARITY = 1000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_sets(column: pa.Array, size: int = SIZE) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For each slice of a text column: the sorted distinct 64-bit tokens of each text, and the sets' 64-bit digests.

    A-Z are lower-cased and words are runs of other than white space. A text with fewer words than ``size`` has its
    whole sequence as its only token; one without words has none. Equal sets have equal digests; for N different sets
    the chance of any two sharing one is about N * N / 2 ** 65.
    """
    data, offsets = tx.utf8(column)
    for i, j in tx.slices(offsets):
        part, own = tx.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, at = tx.words(part, own)
        hashes = tx.span_hashes(part, starts, ends)
        grams = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size):
            grams += hashes[k : k + len(grams)] * _FACTORS[k % 5] * np.uint64(2 * (k // 5) + 1)
        grams = tx.mix(grams)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                sets.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                short = (hashes[a:b] * _FACTORS[np.arange(b - a) % 5]).sum(dtype=np.uint64) + np.uint64(b - a)
                sets.append(tx.mix(np.array([short])))
            else:
                sets.append(grams[:0])
        digests = np.array([tx.mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) for s in sets], np.uint64)
        sizes = np.array([len(s) for s in sets], np.uint64)
        yield sets, tx.mix(digests + sizes)


def _summarise(size: int):
    """Id, number of shingles and digest of each text; and rows (token, sets) for tokens that many sets of a task have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        total = 0

        def row_batch(ids: pa.Array, sizes: list[int], sids: np.ndarray, tokens: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
            a, b = len(sids), len(tokens)
            return pa.record_batch(
                [
                    pa.concat_arrays([ids, pa.nulls(b, ids.type)]),
                    pa.concat_arrays([pa.array(sizes, pa.int64()), pa.nulls(b, pa.int64())]),
                    pa.concat_arrays([pa.array(sids, pa.int64()), pa.nulls(b, pa.int64())]),
                    pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(tokens, pa.int64())]),
                    pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(sets, pa.int64())]),
                ],
                ["id", "n", "sid", "token", "sets"],
            )

        none = np.zeros(0, np.int64)
        ids = None
        for batch in batches:
            ids, sizes, digests = batch.column(0), [], [none]
            for sets, own in shingle_sets(batch.column(1), size):
                sizes += map(len, sets)
                digests.append(own.view(np.int64))
                for sid, tokens in zip(own.tolist(), sets, strict=True):
                    if len(tokens) and sid not in seen:
                        seen.add(sid)
                        held.append(tokens)
                        total += len(tokens)
                if total >= 2 * TOKENS_PER_PACK:
                    yield row_batch(ids[:0], [], none, *_frequent(held))
                    seen, held, total = set(), [], 0
            yield row_batch(ids, sizes, np.concatenate(digests), none, none)
        if held:
            yield row_batch(ids[:0], [], none, *_frequent(held))

    return run


def _frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    often = counts > max(3, len(sets) / (2 * RARITY))
    return tokens[often].view(np.int64), counts[often]


def _blobs(keys: np.ndarray, n_keys: int, columns: dict[str, np.ndarray], runs: np.ndarray, heads: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (key, packed columns): the entries of each key, with one head per run of entries of the same set."""
    order = np.argsort(keys, kind="stable")
    keys, runs = keys[order], runs[order]
    at = np.searchsorted(keys, np.arange(n_keys + 1))
    filled = np.flatnonzero(at[1:] > at[:-1])
    fresh = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])]) if len(keys) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[fresh, len(keys)]).astype(np.int32)
    run_at = np.searchsorted(fresh, at)
    out: dict[str, list] = {"key": [int(k) for k in filled], "length": [lengths[run_at[k] : run_at[k + 1]].tobytes() for k in filled]}
    for name, values in heads.items():
        own = values[runs[fresh]]
        out[name] = [own[run_at[k] : run_at[k + 1]].tobytes() for k in filled]
    for name, values in columns.items():
        own = values[order]
        out[name] = [own[at[k] : at[k + 1]].tobytes() for k in filled]
    types = {"key": pa.int32()}
    return pa.record_batch([pa.array(v, types.get(k, pa.binary())) for k, v in out.items()], list(out))


def _unpack(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _pack(size: int, n_keys: int, common: np.ndarray):
    """Deal the tokens of the sets out by token value; equal sets met together are sent once."""

    def flush(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        sids = np.fromiter(held, np.int64, len(held))
        sizes = np.fromiter(map(len, held.values()), np.int32, len(held))
        tokens = np.concatenate(list(held.values()))
        runs = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        if len(common):  # tokens known to be common need no counting
            place = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            rest = common[place] != tokens
            tokens, runs = tokens[rest], runs[rest]
        keys = (tokens % np.uint64(n_keys)).astype(np.int32)
        return _blobs(keys, n_keys, {"token": tokens}, runs, {"sid": sids, "n": sizes})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        for batch in batches:
            for sets, digests in shingle_sets(batch.column(0), size):
                for sid, tokens in zip(digests.view(np.int64).tolist(), sets, strict=True):
                    if len(tokens) and sid not in held:
                        held[sid] = tokens
                        total += len(tokens)
                        if total >= TOKENS_PER_PACK:
                            yield flush(held)
                            held, total = {}, 0
        if held:
            yield flush(held)

    return run


def _shared(n_keys: int):
    """Of the tokens dealt to one task, those in two different sets at least, dealt out again by set."""

    def run(table: pa.Table) -> pa.Table:
        tokens, lengths = _unpack(table, "token", np.uint64), _unpack(table, "length", np.int32)
        sids, sizes = _unpack(table, "sid", np.int64), _unpack(table, "n", np.int32)
        runs = np.repeat(np.arange(len(sids), dtype=np.int32), lengths)
        order = np.argsort(tokens, kind="stable")
        tokens, runs = tokens[order], runs[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        own = sids[runs]
        different = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        counts = np.diff(np.r_[first, len(tokens)])
        kept = np.repeat(different, counts)
        counts = np.repeat(counts, counts)[kept].astype(np.int32)
        tokens, runs = tokens[kept], runs[kept]
        back = np.argsort(runs, kind="stable")
        tokens, runs, counts = tokens[back], runs[back], counts[back]
        keys = (sids[runs].view(np.uint64) % np.uint64(n_keys)).astype(np.int32)
        return pa.Table.from_batches([_blobs(keys, n_keys, {"token": tokens, "sets": counts}, runs, {"sid": sids, "n": sizes})])

    return run


def _prefixes(threshold: int, common: np.ndarray):
    """The sets of one task whose prefixes hold shared tokens: all shared tokens, and the prefixes in the three orders."""

    def run(table: pa.Table) -> pa.Table:
        tokens, counts = _unpack(table, "token", np.uint64), _unpack(table, "sets", np.int32)
        lengths, sids, sizes = _unpack(table, "length", np.int32), _unpack(table, "sid", np.int64), _unpack(table, "n", np.int32)
        order = np.lexsort((tokens, np.repeat(sids, lengths)))
        own, tokens = np.repeat(sids, lengths)[order], tokens[order]
        counts, n = counts[order], np.repeat(sizes, lengths)[order]
        once = np.r_[True, (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])]  # equal sets may have come from two tasks
        own, tokens, counts, n = own[once], tokens[once], counts[once], n[once]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        shared = np.diff(np.r_[first, len(own)])
        total = n[first].astype(np.int64)
        needed = (threshold * total + 99) // 100
        length = shared - needed + 1  # what the tokens of one set only leave of n - needed + 1
        rows = {"sid": [], "n": [], "tokens": [], "by_count": [], "by_value": [], "by_hash": []}
        for k in np.flatnonzero(length > 0).tolist():
            a, b, p = first[k], first[k] + shared[k], int(length[k])
            whole = tokens[a:b]
            rows["sid"].append(int(own[a]))
            rows["n"].append(int(total[k]))
            rows["tokens"].append(whole.view(np.int64))
            rows["by_count"].append(whole[np.lexsort((whole, counts[a:b]))[:p]].view(np.int64))
            rows["by_value"].append(whole[:p].view(np.int64))
            hashed = tx.mix(whole + np.uint64(0x2545F4914F6CDD1D))
            rows["by_hash"].append(whole[np.argsort(hashed)[:p]].view(np.int64))
        longs = pa.list_(pa.int64())
        types = {"sid": pa.int64(), "n": pa.int64()}
        return pa.table({k: pa.array(v, types.get(k, longs)) for k, v in rows.items()})

    return run


def _similar(a: str, b: str, threshold: int) -> Column:
    """Sizes that a similar pair can have."""
    return (100 * F.least(a, b) >= threshold * F.greatest(a, b))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) that pass the prefix filters of all orders and then the comparison of their whole sets."""
    names = ("n", "tokens", "by_value", "by_hash")
    u = sets.select(F.col("sid").alias("u"), *[F.col(x).alias(f"u_{x}") for x in names])
    v = sets.select(F.col("sid").alias("v"), *[F.col(x).alias(f"v_{x}") for x in names])
    both = pairs.join(u, "u").join(v, "v")
    filtered = both.filter(F.arrays_overlap("u_by_value", "v_by_value") & F.arrays_overlap("u_by_hash", "v_by_hash"))
    common = F.size(F.array_intersect("u_tokens", "v_tokens"))
    return filtered.filter(100 * common >= threshold * (F.col("u_n") + F.col("v_n") - common)).select("u", "v")


def candidate_sets(docs: DataFrame, sets: DataFrame, text: str, size: int, threshold: int) -> DataFrame:
    """Sets with shared tokens in their prefixes: (sid, n, tokens, by_count, by_value, by_hash).

    ``docs`` is read once more for its tokens: they are dealt out by value, counted, and those that two sets share come
    back to their sets. Common tokens (see RARITY) come last in order 0, so their counts are not needed and no task
    gathers the sets of one; they go straight to their sets.
    """
    totals = sets.filter("n > 0").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets")).first()
    n_keys = max(1, -(-(totals.tokens or 0) // TOKENS_PER_TASK))
    texts = docs.select(text)
    often = sets.filter("token IS NOT NULL").groupBy("token").agg(F.sum("sets").alias("sets"))
    often = often.filter((F.col("sets") > 1000) & (F.col("sets") * RARITY > totals.sets)).select("token")
    common = np.sort(np.array([r.token for r in often.toLocalIterator()], np.int64).view(np.uint64))
    packed = texts.mapInArrow(_pack(size, n_keys, common), "key int, length binary, sid binary, n binary, token binary")
    shared = packed.groupBy("key").applyInArrow(
        _shared(n_keys), "key int, length binary, sid binary, n binary, token binary, sets binary"
    )
    if len(common):
        shared = shared.unionAll(texts.mapInArrow(_common_runs(size, n_keys, common), shared.schema))
    found = shared.groupBy("key").applyInArrow(
        _prefixes(threshold, common),
        "sid long, n long, tokens array<long>, by_count array<long>, by_value array<long>, by_hash array<long>",
    )
    return written(found, "sets")


def _common_runs(size: int, n_keys: int, common: np.ndarray):
    """The common tokens of every set, dealt out by set."""

    def flush(held: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sids = np.fromiter(held, np.int64, len(held))
        sizes = np.array([n for n, _ in held.values()], np.int32)
        tokens = np.concatenate([t for _, t in held.values()])
        runs = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for _, t in held.values()])
        keys = (sids[runs].view(np.uint64) % np.uint64(n_keys)).astype(np.int32)
        counts = np.full(len(tokens), np.iinfo(np.int32).max, np.int32)
        return _blobs(keys, n_keys, {"token": tokens, "sets": counts}, runs, {"sid": sids, "n": sizes})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        total = 0
        for batch in batches:
            for sets, digests in shingle_sets(batch.column(0), size):
                for sid, tokens in zip(digests.view(np.int64).tolist(), sets, strict=True):
                    if len(tokens) and sid not in held:
                        own = np.intersect1d(tokens, common, assume_unique=True)
                        if len(own):
                            held[sid] = (len(tokens), own)
                            total += len(own)
                if total >= TOKENS_PER_PACK:
                    yield flush(held)
                    held, total = {}, 0
        if held:
            yield flush(held)

    return run


def links(found: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, component) of the sets in ``found`` that are similar to another one."""
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / threshold))).alias("step")
    posted = written(found.select("sid", "n", step, F.explode("by_count").alias("token")), "postings")
    # 1: every set against the anchors of its tokens: the smallest set of its own and of the next smaller step of sizes.
    anchors = posted.groupBy("token", "step").agg(F.min(F.struct("n", "sid")).alias("anchor"))
    near = posted.select("token", "sid", "n", F.explode(F.array("step", F.col("step") - 1)).alias("step"))
    pairs = (
        near.join(anchors, ["token", "step"])
        .filter((F.col("sid") != F.col("anchor.sid")) & _similar("n", "anchor.n", threshold))
        .select(F.greatest("sid", "anchor.sid").alias("u"), F.least("sid", "anchor.sid").alias("v"))
        .distinct()
    )
    tried = written(pairs, "pairs")
    first = written(_verified(tried, found, threshold), "links")
    joined = written(components(first), "components")
    # 2: what is still apart.
    told = posted.select("token", "sid").join(joined.withColumnRenamed("node", "sid"), "sid", "left")
    told = written(told.withColumn("component", F.coalesce("component", "sid")), "postings")
    return components(first.unionAll(_links_apart(told, found, threshold)))


def _links_apart(posted: DataFrame, found: DataFrame, threshold: int) -> DataFrame:
    """A link (u, v) for every two components (token, sid, component) that have one, at least where it joins them.

    Tokens of one component only have nothing to tell. The others tie sets together that must be compared: such a
    cluster is cut into tiles of bounded size, and pairs of tiles are compared, each in one task. Sets of a component
    are put together, so that tiles of the same component alone are not paired. No pair of sets becomes a row unless it
    links two components.
    """
    mixed = posted.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("sid").alias("anchor"))
    mixed = mixed.filter("a < b").select("token", "anchor")
    ties = written(posted.join(mixed, "token").select(F.col("sid").alias("u"), F.col("anchor").alias("v"), "component"), "ties")
    clusters = components(ties.select("u", "v")).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    inside = ties.select(F.col("u").alias("sid"), "component").distinct().join(clusters, "sid")
    inside = written(inside.join(found, "sid").withColumn("weight", F.size("tokens").cast("long")), "clusters")
    total = inside.groupBy("cluster", "component").agg(F.sum("weight").alias("weight"))
    large = total.filter(F.col("weight") > TILE_TOKENS).select("cluster", "component", F.ceil(F.col("weight") / TILE_TOKENS).alias("parts"))
    small = total.filter(F.col("weight") <= TILE_TOKENS).groupBy("cluster").agg(F.ceil(F.sum("weight") / TILE_TOKENS).alias("buckets"))
    placed = inside.join(large, ["cluster", "component"], "left").join(small, "cluster", "left")
    home = F.when(F.col("parts").isNotNull(), F.struct("component", F.pmod(F.hash("sid"), "parts").alias("part")))
    home = F.coalesce(home, F.struct(F.lit(None).cast("long").alias("component"), F.pmod(F.hash("component"), "buckets").alias("part")))
    tiles = written(
        placed.withColumn("home", F.xxhash64("cluster", home))
        .groupBy("cluster", "home").applyInArrow(_tile, "cluster long, home long, low long, high long, sids binary, components binary, "
            "sizes binary, lengths binary, tokens binary, orders array<binary>"),
        "tiles",
    )
    marks = tiles.select("cluster", "home", "low", "high")
    others = marks.select("cluster", F.col("home").alias("other"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    pairs = marks.join(others, "cluster").filter("home <= other AND NOT (low = high AND low = o_low AND low = o_high)")
    names = ("sids", "components", "sizes", "lengths", "tokens", "orders")
    left = tiles.select("cluster", "home", F.struct(*names).alias("left"))
    right = tiles.select("cluster", F.col("home").alias("other"), F.struct(*names).alias("right"))
    met = pairs.select("cluster", "home", "other").join(left, ["cluster", "home"]).join(right, ["cluster", "other"])
    return met.select("left", "right").mapInArrow(_compare(threshold), "u long, v long")


def _tile(table: pa.Table) -> pa.Table:
    """The sets of a tile, packed: ids, components, sizes, tokens and their three prefixes."""

    def packed(name: str) -> tuple[bytes, bytes]:
        lists = table.column(name).to_pylist()
        flat = np.concatenate([np.array(x, np.int64) for x in lists])
        return np.array([len(x) for x in lists], np.int64).tobytes(), flat.tobytes()

    component = table.column("component").to_numpy()
    lengths, tokens = packed("tokens")
    orders = [x for name in ORDERS for x in packed(name)]
    return pa.table(
        {
            "cluster": table.column("cluster")[:1], "home": table.column("home")[:1], "low": [component.min()], "high": [component.max()],
            "sids": [table.column("sid").to_numpy().tobytes()], "components": [component.tobytes()],
            "sizes": [table.column("n").to_numpy().tobytes()], "lengths": [lengths], "tokens": [tokens], "orders": [orders],
        }
    )


def _common_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of two lists of sets (lengths, tokens), how many tokens each two sets share."""
    total = np.zeros((len(left[0]), len(right[0])), np.float32)
    both = np.intersect1d(left[1], right[1])
    sides = []
    for lengths, tokens in (left, right):
        place = np.minimum(np.searchsorted(both, tokens), max(len(both) - 1, 0))
        hit = both[place] == tokens if len(both) else np.zeros(len(tokens), bool)
        place, owner = place[hit], np.repeat(np.arange(len(lengths)), lengths)[hit]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], owner[order], len(lengths)))
    for start in range(0, len(both), 2048):
        parts = []
        for place, owner, n in sides:
            a, b = np.searchsorted(place, [start, start + 2048])
            part = np.zeros((n, min(2048, len(both) - start)), np.float32)
            part[owner[a:b], place[a:b] - start] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total


def _compare(threshold: int):
    """Links between sets of different components in pairs of tiles: one for each two components."""

    def longs(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, np.int64)

    def links_of(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
        sides = [{k: longs(side[k]) for k in ("sids", "components", "sizes", "lengths", "tokens")} for side in (left, right)]
        a, b = sides
        small, large = np.minimum.outer(a["sizes"], b["sizes"]), np.maximum.outer(a["sizes"], b["sizes"])
        open_ = (a["components"][:, None] != b["components"][None]) & (100 * small >= threshold * large)
        for k in range(len(ORDERS)):
            if not open_.any():
                return longs(b""), longs(b"")
            prefixes = [(longs(side["orders"][2 * k]), longs(side["orders"][2 * k + 1])) for side in (left, right)]
            open_ &= _common_counts(*prefixes) > 0
        common = _common_counts((a["lengths"], a["tokens"]), (b["lengths"], b["tokens"]))
        u, v = np.nonzero(open_ & (100 * common.astype(np.int64) >= threshold * (small + large - common.astype(np.int64))))
        ties = np.stack([a["components"][u], b["components"][v]], 1)
        _, one = np.unique(np.sort(ties, 1), axis=0, return_index=True)
        return a["sids"][u[one]], b["sids"][v[one]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                u, v = links_of(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def jaccard_sets(docs: DataFrame, id: str, text: str, size: int, threshold: int) -> DataFrame:
    """(id, n, sid, component) of each row: size and digest of its set, and the least digest reachable by links.

    Texts without words have n = 0 and a null component.
    """
    kind = docs.schema[id].dataType.simpleString()
    told = docs.select(id, text).mapInArrow(_summarise(size), f"id {kind}, n long, sid long, token long, sets long")
    sets = written(told, "documents")
    found = candidate_sets(docs, sets, text, size, threshold)
    joined = written(links(found, threshold), "components").withColumnRenamed("node", "sid")
    rows = sets.filter("n IS NOT NULL").join(joined, "sid", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "sid"))
    return written(rows.select("id", "n", "sid", component.alias("component")), "members")


def jaccard_classes(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, threshold: int = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` (long) and ``component_id``, the smallest id reachable by links.

    Two texts link when 100 * |intersection| >= threshold * |union| of their sets of ``size``-word shingles. Texts
    without words, null ones included, link with nothing and stand for themselves. Repeated rows all come back. A row
    with a null id takes part, but never names a component: a component of such rows only has a null ``component_id``.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    told = jaccard_sets(docs, id, text, size, threshold)
    least = told.filter("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    named = told.filter("n > 0").join(least, "component").select("id", "n", "component_id")
    empty = told.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return named.unionAll(empty).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def distinct_texts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, threshold: int = THRESHOLD
) -> DataFrame:
    """One row of each group of linked rows, with all its columns: that of the smallest id, nulls last.

    Rows without words are in no group and all stay. Of repeated rows one stays.
    """
    told = jaccard_sets(docs, id, text, size, threshold)
    sid, n, first_id, first_sid = _unused(docs.columns, "sid", "n", "first_id", "first_sid")
    first = told.filter("n > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "sid")).alias("first"))
    first = first.select(F.col("first.id").alias(first_id), F.col("first.sid").alias(first_sid))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes = [np.zeros(0, np.uint64)], []
            for sets, own in shingle_sets(batch.column(place), size):
                digests.append(own)
                sizes += map(len, sets)
            yield pa.record_batch(
                [*batch.columns, pa.array(np.concatenate(digests).view(np.int64)), pa.array(sizes, pa.int64())],
                [*batch.schema.names, sid, n],
            )

    schema = StructType([*docs.schema.fields, StructField(sid, LongType()), StructField(n, LongType())])
    marked = docs.mapInArrow(run, schema)
    same = F.col(id).eqNullSafe(F.col(first_id)) & (F.col(sid) == F.col(first_sid))
    kept = marked.filter(F.col(n) > 0).join(first, same, "left_semi").dropDuplicates([id, sid])
    return kept.unionAll(marked.filter(F.col(n) == 0)).select(docs.columns)


def _unused(columns: list[str], *names: str) -> list[str]:
    """Names that no column has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out
