"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items are read as lower-case runs of letters and digits. A hit names a diagonal, the distance
between the places in text and item. Every diagonal that is hit is compared word by word over the whole item: equal
words count 1, different ones ``-MISMATCH``, and the best-scoring stretch is the overlap. It is a leak if it has
``MATCHES`` equal words, or ``SHARE`` of the item's words if that is less.

A seed is a hash of the 4 words that a fixed mask selects; the words at the other places may differ. No leak is without
a seed: a best stretch never scores below 0 on its way, so its first 10 equal words (9 and 8 in items of 12 and 11
words) come with 4 different ones at most, and each of the 416 orders in which they can stand holds one of the two masks; items of
8 to 10 words are looked up by the first mask and by runs of three words, of which every leak of theirs holds one
(``tests/llm/test_decontaminate.py`` goes through all of them). The masks are sums of shifts (``SHIFTS``), so a seed array is
made of passes over the word hashes, each joining a place with one a shift further on; masks share their first passes.

The item side is broadcast in blocks of items with at most ``BLOCK_SEEDS`` seeds (about 16 MB); a larger benchmark
takes several passes over the documents. Documents are only moved for hits.

Defined cases: null and blank texts have no seeds; items with fewer words than ``SHORTEST`` leak by a run of all their
words, and are ``telling`` only with ``TELLING_WORDS`` words or ``TELLING_CHARS`` characters: a text that merely holds "yes" is reported but
stays in the corpus; which masks an item is looked up by depends on that item alone; a very long text is compared with an item only along
the diagonals that are hit; rows and items are told apart by id and text, so equal rows are one and a null id stands;
equal overlaps go to the earliest place; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listingspark.functions.rows import with_once

from .texts import own_columns, written

#: Masks as shifts: 11011 and 110000011.
SHIFTS = ((0, 1, 3), (0, 1, 7))
#: Runs of 3 words, for items of fewer than SPAN words, which are looked up by the first mask as well.
RUN = (1, 1)
#: Runs of 1 to 7 words, each for items of as many words.
WHOLE = ((), (1,), (1, 1), (1, 2), (1, 1, 2), (1, 2, 2), (1, 2, 3))
SPAN = 11
SHORTEST = 8
TELLING_WORDS = 4
TELLING_CHARS = 20
MISMATCH = 2
MATCHES = 10
SHARE = 0.7
BLOCK_SEEDS = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _joined(hashes: str, shift: int) -> Column:
    many = F.greatest(F.size(hashes) - shift, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, many), F.slice(hashes, shift + 1, many), lambda a, b: F.xxhash64(a, b))


def seeds(rows: DataFrame, masks: tuple) -> DataFrame:
    """Column ``_words`` replaced by an array ``seeds`` for each mask, ``_s0``, ``_s1`` and so on."""
    steps = [tuple(shift for shift in mask if shift) for mask in masks]
    depth = max(len(s) for s in steps)
    names = {(): "_words"}
    for many in range(1, depth + 1):  # arrays of one shift more, made once for all masks that begin so
        longer = {s[:many]: "_at" + "_".join(map(str, s[:many])) for s in steps if len(s) >= many}
        rows = with_once(rows, **{name: _joined(names[s[:-1]], s[-1]) for s, name in longer.items()})
        names |= longer
    keep = [c for c in rows.columns if c not in names.values()]
    return rows.select(*keep, *[F.col(names[s]).alias(f"_s{k}") for k, s in enumerate(steps)])


def placed(rows: DataFrame, masks: tuple, *key: str) -> DataFrame:
    """``key, seed, place, mask``, a row for each seed."""
    rows = seeds(rows, masks)
    first, rest = F.col("_s0"), [F.col(f"_s{k}") for k in range(1, len(masks))]
    sizes = [F.size(f"_s{k}").alias(f"_n{k}") for k in range(len(masks))]
    # one array for all masks: places are told apart by the sizes of the arrays before
    flat = rows.select(*key, *sizes, F.concat(first, *rest).alias("_all")).select(*key, *[f"_n{k}" for k in range(len(masks))], F.posexplode("_all").alias("_at", "seed"))
    before, cases = F.lit(0), []
    for k in range(len(masks)):
        cases.append((before, F.col(f"_n{k}")))
        before = before + F.col(f"_n{k}")
    mask, place = F.lit(len(masks) - 1), F.col("_at") - cases[-1][0]
    for k in range(len(masks) - 2, -1, -1):
        within = F.col("_at") < cases[k][0] + cases[k][1]
        mask, place = F.when(within, F.lit(k)).otherwise(mask), F.when(within, F.col("_at") - cases[k][0]).otherwise(place)
    return flat.select(*key, "seed", place.cast("int").alias("place"), mask.cast("int").alias("mask"))


def row_key(id_: str = "doc_id") -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64(F.col(id_).cast("bigint"), F.col("text").cast("string"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks: ``row_key, doc_id, item_id, matches, length, doc_start, item_start, item_words, telling``, the best for each row and item."""
    telling = (F.size(_words(F.col("text"))) >= TELLING_WORDS) | (F.length(F.array_join(_words(F.col("text")), " ")) >= TELLING_CHARS)
    named = own_columns(benchmark, "item_id", "text").select(row_key("item_id").alias("item_key"), "item_id", word_hashes(F.col("text")).alias("_words"), telling.alias("telling"))
    items = written(named.withColumn("item_words", F.size("_words")).filter(F.col("item_words") > 0).dropDuplicates(["item_key"]), "items")
    sizes = {r[0] for r in items.select(F.least("item_words", F.lit(SPAN))).distinct().collect()}
    short = [n for n in sorted(sizes) if n < SHORTEST]
    masks = SHIFTS + ((RUN,) if any(SHORTEST <= n < SPAN for n in sizes) else ()) + tuple(WHOLE[n - 1] for n in short)
    at = {n: len(masks) - len(short) + k for k, n in enumerate(short)} | {n: len(SHIFTS) for n in range(SHORTEST, SPAN)}
    by_size = F.col("mask") == F.element_at(F.create_map(*[F.lit(x) for n in at.items() for x in n]), F.col("item_words"))
    own_mask = F.when(F.col("item_words") >= SPAN, F.col("mask") < len(SHIFTS)).otherwise(by_size | ((F.col("item_words") >= SHORTEST) & (F.col("mask") == 0)))
    blocks = int((items.agg(F.sum("item_words")).first()[0] or 0) * len(masks) // BLOCK_SEEDS) + 1
    rows = own_columns(docs, "doc_id", "text").filter(F.col("text").isNotNull())
    spots = placed(rows.select(row_key().alias("row_key"), word_hashes(F.col("text")).alias("_words")), masks, "row_key")
    hits = None
    for block in range(blocks):
        some = items.filter(F.pmod("item_key", F.lit(blocks)) == block) if blocks > 1 else items
        known = placed(some.select("item_key", "item_words", "_words"), masks, "item_key", "item_words").filter(own_mask).withColumnRenamed("place", "item_place")
        diagonal = F.col("place") - F.col("item_place")
        # of a whole short item the first place is enough, however often it occurs
        once = F.when(F.col("item_words") >= SHORTEST, diagonal)
        met = spots.join(F.broadcast(known), ["seed", "mask"]).select("row_key", "item_key", diagonal.alias("diagonal"), once.alias("_once"))
        found = met.groupBy("row_key", "item_key", "_once").agg(F.min("diagonal").alias("diagonal")).drop("_once")
        hits = found if hits is None else hits.unionByName(found)
    hits = written(hits, "hits")
    own = rows.withColumn("row_key", row_key()).join(hits.select("row_key").distinct(), "row_key", "left_semi")
    own = own.dropDuplicates(["row_key"]).select("row_key", "doc_id", word_hashes(F.col("text")).alias("_words"))
    compared = hits.join(own, "row_key").join(items.withColumnRenamed("_words", "_item"), "item_key")
    best = with_once(compared, best=_best(F.col("_words"), F.col("_item"), F.col("diagonal"))).drop("_words", "_item")
    enough = F.when(F.col("item_words") < SHORTEST, F.col("item_words")).otherwise(F.least(F.lit(MATCHES), F.ceil(F.col("item_words") * SHARE)))
    leaks = best.filter(F.col("best.matches") >= enough)
    order = F.struct(F.col("best.matches").alias("m"), (-F.col("best.first") - F.col("diagonal")).alias("p"), F.col("best.first").alias("f"), F.col("best.last").alias("l"), F.col("diagonal").alias("d"))
    top = leaks.groupBy("row_key", "doc_id", "item_key", "item_id", "item_words", "telling").agg(F.max(order).alias("t"))
    return top.select(
        "row_key", "doc_id", "item_id", F.col("t.m").cast("long").alias("matches"), (F.col("t.l") - F.col("t.f") + 1).cast("long").alias("length"),
        (F.col("t.f") + F.col("t.d")).cast("long").alias("doc_start"), F.col("t.f").cast("long").alias("item_start"), F.col("item_words").cast("long").alias("item_words"), "telling",
    )


def _best(words: Column, item: Column, diagonal: Column) -> Column:
    """The best-scoring stretch of the item on a diagonal, of those the one with most equal words: places ``first`` and ``last`` in the item, and equal words."""
    def step(s: Column, same: Column) -> Column:
        begin = s["score"] < 0
        score = F.greatest(s["score"], F.lit(0)) + F.when(same, 1).otherwise(-MISMATCH)
        at = s["at"]
        start = F.when(begin, at).otherwise(s["from"])
        equal = F.when(begin, 0).otherwise(s["equal"]) + F.when(same, 1).otherwise(0)
        better = (score > s["best"]) | ((score == s["best"]) & (equal > s["matches"]))
        return F.struct(
            (at + 1).alias("at"), score.alias("score"), start.alias("from"), equal.alias("equal"), F.greatest(score, s["best"]).alias("best"),
            F.when(better, start).otherwise(s["first"]).alias("first"), F.when(better, at).otherwise(s["last"]).alias("last"), F.when(better, equal).otherwise(s["matches"]).alias("matches"),
        )

    matched = F.transform(item, lambda w, i: F.coalesce((i + diagonal >= 0) & (F.get(words, i + diagonal) == w), F.lit(False)))
    zero = F.struct(*[F.lit(0).alias(f) for f in ("at", "score", "from", "equal", "best", "first", "last", "matches")])
    return F.aggregate(matched, zero, step)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a telling leak, all their columns as they were."""
    leaks = overlaps(docs, benchmark).filter("telling").select("row_key").distinct()
    whole = docs.select(row_key().alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return whole.join(leaks, "row_key", "left_anti").select("_row.*")
