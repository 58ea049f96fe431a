"""N-gram Jaccard join by universe partition and the pigeonhole principle, verified exactly.

A text's set is its distinct word n-grams, as 64-bit hashes. Two sets within the threshold differ in at most H tokens,
H from their sizes. Within a size band (sizes from a power of two to the next) the universe of hashes is cut into
segments, ranges of hashes. Segments carry weight: an exact one 1, a one-deletion one 2. If two sets differ in at most
H tokens, the segments in which they are equal (exact) or differ in one token at most (one-deletion) weigh all but H
of the total. A set therefore puts into the index

* of its exact segments those with most tokens, all but (total weight - H - 1) of them: the best segment that two sets
  share is skipped by neither, as the rank of a segment only depends on its content;
* of each one-deletion segment the whole and everything that is left when one token is taken out.

A set near the upper end of its band goes into the next band, too, if a partner may lie there. How many one-deletion
segments and how many segments to spare a band has is chosen by cost: rows written, and pairs expected by accident
from the number of sets and how many tokens two sets share on average, both measured over all sets.

Sets that share an index entry are candidates. Equal sets are one node from the start. Links only matter as far as
they join components, so candidates are verified in rounds: first each node against the entry's smallest node that it
shares most entries with, then against one node of another component. Nodes that share an entry but still lie in
different components are then compared by parities, in blocks: a set's tokens are counted modulo 2 in hash classes, two
to four times as many as tokens, and two sets differ in at least as many tokens as classes. Of the pairs that this
allows, a comparison gives away a forest: pairs enough to join all that the allowed pairs join. If they all verify, the
comparison is settled, as its other allowed pairs lie within components. Where some fail, the nodes that still may link
across components meet again with their tokens, are verified there pair by pair, and a forest of the links comes out.
So each comparison gives fewer rows than it takes. Each round's links are a table in the shared folder; no link between
components is lost, and no group of copies is expanded into all its pairs.

Defined cases: null and blank texts have an empty set and link with nothing; rows without ``doc_id`` are returned with
no component; equal rows are equal; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, merged, rooted
from .texts import hashed_words, mix, own_columns, shingle_hashes, signed, text_chunks, written

#: One token in so many is counted to learn how many tokens two sets share.
PROBE = 1024
#: What a pair to verify costs, in index rows.
PAIR_COST = 40.0
STAR_ROUNDS = 1
#: Nodes of an entry that are compared in one task with as many others.
BLOCK = 4096
#: Tokens of an entry's nodes that are verified in one task with as many others.
TOKENS = 1 << 21
#: Pairs that leave a comparison at once.
PAIRS = 50_000


@dataclass(frozen=True)
class Likeness:
    """Sets link if 100 * intersection >= percent * union."""

    size: int = 4
    percent: int = 85

    def partner(self, n: int) -> int:
        """Size of the largest set that may link with one of n tokens."""
        return n * 100 // self.percent

    def difference(self, a: int, b: int) -> int:
        """Most tokens in which linked sets of these sizes may differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def allowance(self, n: int, band: int) -> int:
        """Most tokens in which a set of n tokens may differ from partners that it meets in a band."""
        return self.difference(n, max(n, min(self.partner(n), (2 << band) - 1)))

    def bands(self, n: int) -> range:
        return range(n.bit_length() - 1, self.partner(n).bit_length())

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


@dataclass(frozen=True)
class Layout:
    """Segments of a band: exact ones, and one-deletion ones before them."""

    exact: int
    loose: int

    @property
    def weight(self) -> int:
        return self.exact + 2 * self.loose


def layout(like: Likeness, band: int, sets: float, tokens: float, share: float) -> Layout:
    """The cheapest layout for ``sets`` sets of ``tokens`` tokens on average, a token of one being in another with chance ``share``."""
    need = like.allowance((2 << band) - 1, band) + 1
    options = [Layout(need - 2 * loose + spare, loose) for loose in {0, need // 4, need // 2} for spare in {0, 1, 2, need // 32, need // 16, need // 8, need // 4} if need - 2 * loose + spare >= 0]
    return min((o for o in options if o.exact + o.loose), key=lambda o: (_cost(o, need, sets, tokens, share), o.loose, o.exact))


def _cost(o: Layout, need: int, sets: float, tokens: float, share: float) -> float:
    each = tokens / (o.exact + o.loose)
    odds = [math.exp(-each) * each**e / math.factorial(e) for e in range(12)]
    rows, accident, skip = 0.0, 0.0, float(o.weight - need)
    for e, p in enumerate(odds):  # the smallest segments are skipped first
        kept = max(0.0, o.exact * p - skip)
        skip = max(0.0, skip - o.exact * p)
        accident += kept * share**e + o.loose * p * (share**e + e * share ** max(0, e - 1))
    rows = max(0.0, o.exact - (o.weight - need)) + o.loose * (1 + each)
    return sets * rows + PAIR_COST * sets * sets / 2 * accident


def entries(tokens: np.ndarray, like: Likeness, layouts: dict[int, Layout]) -> np.ndarray:
    """Index entries of a set of sorted hashes."""
    n = len(tokens)
    out = []
    spread = mix(tokens)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(spread, out=sums[1:])
    for band in like.bands(n):
        plan = layouts[band]
        segments = plan.exact + plan.loose
        place = ((tokens >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        cuts = np.searchsorted(place, np.arange(segments + 1, dtype=np.uint64))
        sizes = np.diff(cuts)
        whole = sums[cuts[1:]] - sums[cuts[:-1]]
        salt = mix(np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 40))
        keys = mix(whole + salt + sizes.astype(np.uint64))
        keep = plan.exact - (plan.weight - like.allowance(n, band) - 1)
        if keep > 0:
            out.append(keys[plan.loose + np.argsort(-sizes[plan.loose :], kind="stable")[:keep]])
        if plan.loose:
            out.append(keys[: plan.loose])
            owner = place[: cuts[plan.loose]].astype(np.int64)
            out.append(mix(whole[owner] - spread[: len(owner)] + salt[owner] + (sizes[owner] - 1).astype(np.uint64)))
    return np.concatenate(out)


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The set of each text in turn, as sorted hashes."""
    for first, behind, data, offsets in text_chunks(texts):
        words, begins = hashed_words(data, offsets)
        runs = shingle_hashes(words, size) if len(words) >= size else words[:0]
        for i in range(behind - first):
            a, b = begins[i], begins[i + 1]
            yield np.unique(runs[a : b - size + 1] if b - a >= size else shingle_hashes(words[a:b], size))


def node_of(tokens: np.ndarray) -> int:
    """Number of a set: 64 bits of its content and size."""
    total = np.add.reduce(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
    return int(mix(np.array([total], dtype=np.uint64) + np.uint64(len(tokens)))[0].astype(np.int64))


def digests(docs: DataFrame, like: Likeness) -> DataFrame:
    """``doc_id, n, node, probe`` of every row; probe holds the tokens that are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, probes = [], [], []
            for tokens in sets_of(batch.column(1), like.size):
                sizes.append(len(tokens))
                nodes.append(node_of(tokens))
                probes.append(signed(tokens[tokens % np.uint64(PROBE) == 0]))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(probes, pa.list_(pa.int64()))], ["doc_id", "n", "node", "probe"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, node bigint, probe array<bigint>")


def layouts_for(nodes: DataFrame, like: Likeness) -> dict[int, Layout]:
    """A layout for every band that a set may go into; ``nodes`` has ``n`` and ``probe`` of each different set."""
    sizes = nodes.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("band")).agg(F.count("*").alias("sets"), F.avg("n").alias("tokens"), F.max("n").alias("most")).collect()
    total = sum(r.sets for r in sizes)
    seen = nodes.select(F.explode("probe").alias("token")).groupBy("token").count()
    pairs = (seen.agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1))).first()[0] or 0.0) * PROBE
    mean = sum(r.sets * r.tokens for r in sizes) / max(total, 1)
    share = min(0.5, max(1e-9, pairs / max(total * (total - 1), 1) / max(mean, 1.0)))
    found = {r.band: r for r in sizes}
    out = {}
    for band in range(max((like.partner(r.most).bit_length() for r in sizes), default=0) + 1):
        r = found.get(band)
        out[band] = layout(like, band, r.sets if r else 1, r.tokens if r else 1.5 * (1 << band), share)
    return out


def indexed(docs: DataFrame, like: Likeness, layouts: dict[int, Layout]) -> DataFrame:
    """``key, node`` of every index entry; equal sets of one batch are indexed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            keys, nodes = [], []
            held = 0
            for tokens in sets_of(batch.column(0), like.size):
                if len(tokens) and (node := node_of(tokens)) not in seen:
                    seen.add(node)
                    keys.append(entries(tokens, like, layouts))
                    nodes.append(np.full(len(keys[-1]), node, dtype=np.int64))
                    held += len(keys[-1])
                    if held > 100_000:
                        yield pa.record_batch([signed(np.concatenate(keys)), np.concatenate(nodes)], ["key", "node"])
                        keys, nodes, held = [], [], 0
            if keys:
                yield pa.record_batch([signed(np.concatenate(keys)), np.concatenate(nodes)], ["key", "node"])

    return docs.select("text").mapInArrow(run, "key bigint, node bigint")


def with_parity(texts: DataFrame, like: Likeness) -> DataFrame:
    """``texts`` (``node, n, text``) with the parities of the sets; texts that are not the node's go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bits, good = batch.column(0).to_pylist(), [], []
            for k, tokens in enumerate(sets_of(batch.column(2), like.size)):
                if node_of(tokens) == nodes[k]:  # an id may be shared by several texts
                    good.append(k)
                    bits.append(parity(tokens))
            kept = batch.take(pa.array(good, pa.int64()))
            yield pa.record_batch([*kept.columns, pa.array(bits, pa.binary())], ["node", "n", "text", "bits"])

    return texts.mapInArrow(run, "node bigint, n bigint, text string, bits binary")


def verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs ``a, b`` of nodes that link; ``texts`` has ``node, n, text``."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("text").alias(f"text_{x}"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * like.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(sets_of(batch.column(2), like.size), sets_of(batch.column(3), like.size), strict=True)
            good = [k for k, (a, b) in enumerate(sides) if like.linked(a, b)]
            yield pa.record_batch([batch.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], ["a", "b"])

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def parity(tokens: np.ndarray) -> bytes:
    """Parities of the tokens per hash class, two to four classes a token. Sets that differ in d tokens differ in at most d classes."""
    bits = 1 << min(max(len(tokens).bit_length() + 1, 6), 16)
    odd = np.bincount(((tokens >> np.uint64(16)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the entries that still lie in several components, with their root, the entry's smallest root and a node of it."""
    rooted = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    ends = rooted.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("node", "root").alias("rep"), F.count("*").alias("many")
    ).filter("low != high")
    return written(rooted.join(ends, "key"), "mixed")


def _met(rows: DataFrame, marks: DataFrame, limit: int) -> DataFrame:
    """``key, i, j, node, root, own`` and the columns of ``marks`` but its node, in order: each two blocks ``i, j`` of an entry's nodes.

    ``rows`` has ``key, node, root`` and ``many``, the entry's weight; its nodes fall into blocks of about ``limit``.
    """
    blocks = F.ceil(F.col("many") / limit).cast("int")
    rows = rows.select("key", "node", "root", blocks.alias("blocks"), F.pmod(F.hash("node"), blocks).alias("own"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "node", "root", "own", meets).join(marks, "node")
    more = [c for c in marks.columns if c != "node"]
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "own", *more)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").select("key", "i", "j", "node", "root", "own", *more)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """``(key, i, j)`` and the rows of each comparison in turn."""
    group, now = [], None
    for batch in batches:
        for key, i, j, *row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (key, i, j) != now:
                if group:
                    yield now, group
                group, now = [], (key, i, j)
            group.append(row)
    if group:
        yield now, group


def _forest(mixed: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """``key, a, b``: nodes of different components that share an entry and whose parities allow a link, of each comparison a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, group in _groups(batches):
            for pairs in _allowed(group, now, like, best=True):
                yield pa.record_batch([pa.array(np.full(pairs.num_rows, now[0], dtype=np.int64)), *pairs.columns], ["key", "a", "b"])

    return _met(mixed, texts.select("node", "n", "bits"), BLOCK).mapInArrow(run, "key bigint, a bigint, b bigint")


def _unsettled(mixed: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """``key, node`` of the nodes whose parities allow a link to a node of another component in their entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, group in _groups(batches):
            found = np.zeros(0, dtype=np.int64)
            for pairs in _allowed(group, now, like, best=False):
                found = np.union1d(found, np.concatenate([column.to_numpy() for column in pairs.columns]))
            if len(found):
                yield pa.record_batch([pa.array(np.full(len(found), now[0], dtype=np.int64)), pa.array(found)], ["key", "node"])

    return _met(mixed, texts.select("node", "n", "bits"), BLOCK).mapInArrow(run, "key bigint, node bigint").distinct()


def _exact_links(unsettled: DataFrame, roots: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Links ``a, b`` that join all that the nodes ``key, node`` of an entry join; verified by their tokens where they meet."""

    def with_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pa.array([t.tobytes() for t in sets_of(batch.column(3), like.size)], pa.binary())
            yield pa.record_batch([*batch.columns[:3], tokens], ["node", "n", "bits", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, group in _groups(batches):
            yield from _linked(group, now, like)

    rows = unsettled.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")).join(texts.select("node", "n"), "node")
    rows = rows.join(rows.groupBy("key").agg(F.sum("n").alias("many")), "key").select("key", "node", "root", "many")
    wanted = texts.join(unsettled.select("node").distinct(), "node").select("node", "n", "bits", "text")
    marks = wanted.mapInArrow(with_tokens, "node bigint, n bigint, bits binary, tokens binary")
    return _met(rows, marks, TOKENS).mapInArrow(run, "a bigint, b bigint").distinct()


def _linked(group: list[list], key: tuple, like: Likeness) -> Iterator[pa.RecordBatch]:
    """A forest of the links between a group's rows ``node, root, own, n, bits, tokens`` of different roots."""
    sets = {row[0]: np.frombuffer(row[5], dtype=np.uint64) for row in group}
    own = {row[0]: row[1] for row in group}
    above = {root: root for root in own.values()}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    found = []
    for pairs in _allowed(group, key, like, best=False):
        for a, b in zip(*(column.to_pylist() for column in pairs.columns), strict=True):
            x, y = top(own[a]), top(own[b])
            if x != y and like.linked(sets[a], sets[b]):
                above[max(x, y)] = min(x, y)
                found.append((a, b))
    if found:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _allowed(group: list[list], key: tuple | None, like: Likeness, best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a group's rows ``node, root, own, n, bits`` whose parities allow a link: of different roots, and of both blocks if it has two.

    With ``best`` a forest of them, which joins the roots that they join; each row gives its nearest of a root that is not joined yet.
    They leave in batches of about ``PAIRS``, so that two full blocks in which all may link are never held.
    """
    if len({row[1] for row in group}) < 2:
        return
    cross = key[1] != key[2]
    least = min(len(row[4]) for row in group)
    marks = np.empty((len(group), least // 8), dtype=np.uint64)
    for k, row in enumerate(group):  # longer parities are folded to the shortest one's classes
        marks[k] = np.bitwise_xor.reduce(np.frombuffer(row[4], dtype=np.uint64).reshape(-1, least // 8), axis=0)
    node, root, own, n = (np.array([row[c] for row in group], dtype=np.int64) for c in range(4))
    part = np.unique(root, return_inverse=True)[1]
    firsts, seconds, held = [], [], 0
    for k in range(len(group)):
        others = k + np.flatnonzero((part[k:] != part[k]) & ((own[k:] != own[k]) if cross else True))
        if not len(others):
            continue
        far = np.bitwise_count(marks[others] ^ marks[k]).sum(axis=1, dtype=np.int64)
        near = far <= (100 - like.percent) * (n[others] + n[k]) // (100 + like.percent)
        others, far = others[near], far[near]
        if best and len(others):
            order = np.argsort(far, kind="stable")
            others = others[order][np.unique(part[others][order], return_index=True)[1]]
            part[np.isin(part, part[others])] = part[k]
        firsts.append(np.minimum(node[others], node[k]))
        seconds.append(np.maximum(node[others], node[k]))
        held += len(others)
        if held >= PAIRS:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in (firsts, seconds)], ["a", "b"])
            firsts, seconds, held = [], [], 0
    if held:
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in (firsts, seconds)], ["a", "b"])


def clustered(docs: DataFrame, like: Likeness = Likeness(), layouts: dict[int, Layout] | None = None, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    digest, classes = _classes(docs, like, layouts, star_rounds)
    label = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return digest.join(classes.drop("root"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"))


def _classes(docs: DataFrame, like: Likeness, layouts: dict[int, Layout] | None = None, star_rounds: int = STAR_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The digests of all rows, and ``node, root, component_id`` of each different set that has an id: its component's node and smallest id."""
    own = own_columns(docs, "doc_id", "text")
    digest = written(digests(own, like), "digests")
    named = digest.filter("doc_id is not null and n > 0")
    nodes = written(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("probe").alias("probe")), "nodes")
    layouts = layouts or layouts_for(nodes, like)
    nodes = nodes.select("node", "doc_id", "n")
    index = indexed(own.filter("doc_id is not null"), like, layouts)
    shared = index.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("last")).filter("rep != last").drop("last")
    members = written(index.join(shared, "key"), "members")
    wanted = members.select("node").distinct().join(nodes, "node")
    texts = written(with_parity(own.join(wanted, "doc_id").select("node", "n", "text"), like), "texts")

    # each node with the smallest node of an entry, the one it shares most entries with
    votes = members.filter("node != rep").groupBy("node", "rep").count().groupBy("node").agg(F.max_by("rep", F.struct("count", "rep")).alias("rep"))
    tested = written(votes.select(F.col("rep").alias("a"), F.col("node").alias("b")), "pairs")
    roots = components(written(verified(tested, texts, like), "linked"))
    members = members.drop("rep")

    def verify(found: DataFrame) -> None:
        nonlocal tested
        new = written(found.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(new)
        add(verified(new, texts, like))

    def add(found: DataFrame) -> None:
        nonlocal roots
        more = written(found, "linked")
        if not more.isEmpty():
            roots = merged(roots, more)

    for _ in range(star_rounds):
        mixed = _mixed(members, roots)
        if mixed.isEmpty():
            break
        members = mixed.select("key", "node")
        verify(mixed.filter("root != low").select(F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b")).distinct())
    mixed = _mixed(members, roots)
    forest = written(_forest(mixed, texts, like), "forest")
    if not forest.isEmpty():
        verify(forest.select("a", "b").distinct())
        apart = rooted(forest, roots).filter("root_a != root_b")
        mixed = _mixed(mixed.select("key", "node").join(apart.select("key").distinct(), "key", "left_semi"), roots)
        unsettled = written(_unsettled(mixed, texts, like), "unsettled")
        if not unsettled.isEmpty():
            add(_exact_links(unsettled, roots, texts, like))

    least = nodes.join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return digest, nodes.join(roots.join(least, "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row of each component, that of the smallest id, and all rows without id; all columns as they were.

    An id may be shared by several texts: each is judged by its own component, and of those of one component under its
    smallest id the one with the least key stays. Texts without shingles are in no component; equal ones of an id are one.
    """
    _, classes = _classes(docs, like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(tokens), node_of(tokens)) for tokens in sets_of(batch.column(1), like.size)]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.record_batch([batch.column(0), batch.column(2), *columns], ["doc_id", "text_key", "n", "node"])

    key = F.xxhash64(F.col("text").cast("string")).alias("text_key")
    own = own_columns(docs, "doc_id", "text").filter("doc_id is not null")
    rows = written(own.select("doc_id", "text", key).mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, node bigint"), "rows")
    named = rows.filter("n > 0").join(classes.withColumnRenamed("component_id", "doc_id"), ["node", "doc_id"])
    found = named.groupBy("doc_id", "root").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key")
    found = written(found.unionByName(rows.filter("n = 0").select("doc_id", "text_key").distinct()), "found")
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = whole.join(found, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return kept.unionByName(whole.filter("doc_id is null")).select("_row.*")
