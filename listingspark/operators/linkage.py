"""One posting listed by several sources: record linkage with blocking that loses no link.

Listings that agree in company, title, place and description are one class; of each class one row goes on. Two rows of different
sources are linked when their weighted agreement reaches ``Weights.least``. Agreement in a text is the Jaccard index of its distinct
words, for descriptions that of runs of three words. What the other parts can add at most tells how much each part must agree,
so rows that link share a company word and one of the rarest title words. A block of more than ``hot`` rows is split by what else its
links must share: a place word or, without one, the whole description; then by description runs, rarest within the block first, where that leaves fewer pairs.

A row links to at most one row of each other source, to which it is also the best. A component of links keeps one listing:
the one nearest to its employer, then the oldest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rows import with_once
from ..functions.text import let, normalized_text
from ..session import cut_lineage
from .joins import HOT_KEYS, spread_join

#: Words that tell a company's legal form, not its name.
LEGAL_FORMS = "ag bv co company corp corporation gmbh inc incorporated limited llc ltd plc pty sa sarl se spa srl the".split()
#: Feeds that the employer runs, then boards of its applicant system; all others are aggregators.
EMPLOYER_FEEDS = ("JSON-LD", "Careers", "Browser", "CapturedApi")
BOARD_FEEDS = ("Greenhouse", "Lever", "Ashby", "Workable", "Personio", "SmartRecruiters", "Rippling")
RUN = 3


@dataclass(frozen=True)
class Weights:
    """Parts of the agreement, 1 in all, and the least agreement that links."""

    title: float = 0.45
    company: float = 0.2
    place: float = 0.15
    description: float = 0.2
    least: float = 0.85

    def need(self, part: str, **at_most: float) -> float:
        """How far a part must agree when the others do as far as given, wholly by default."""
        others = sum(getattr(self, n) * at_most.get(n, 1.0) for n in ("title", "company", "place", "description") if n != part)
        return max(0.0, (self.least - others) / getattr(self, part))

    def either(self) -> tuple[float, float]:
        """A share of places and of descriptions, one of which a link reaches: together they are just not enough."""
        left = self.least - self.title - self.company
        share = left / (self.place + self.description)
        return share, share


def _words(text: Column) -> Column:
    """Words in order; spaces are no part of them, so the text need not be rid of any."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def words_of(text: Column) -> Column:
    """Distinct words of letters and digits, in small letters."""
    return F.array_distinct(_words(text))


def runs_of(text: Column) -> Column:
    """Distinct hashes of all runs of three words; of a shorter text, of all its words."""

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (RUN - 1)), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.array_distinct(F.when(F.size(w) >= RUN, runs).otherwise(short))

    return let(_words(text), hashes)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two distinct arrays; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / union)


def nearness(provider: Column) -> Column:
    """0 for feeds of the employer, 1 for boards of its applicant system, 2 for the rest."""
    return F.when(provider.isin(*EMPLOYER_FEEDS), 0).when(provider.isin(*BOARD_FEEDS), 1).otherwise(2)


def classes(listings: DataFrame) -> DataFrame:
    """The listings with their class (``class_id``), a hash of what they say, and their ``rank`` to survive."""
    company = F.array_except(words_of(F.col("company")), F.array(*[F.lit(w) for w in LEGAL_FORMS]))
    sort = lambda c: F.array_join(F.sort_array(c), " ")
    said = [sort(company), sort(words_of(F.col("title"))), sort(words_of(F.col("location"))), F.sha2(normalized_text(F.coalesce("description", F.lit(""))), 256)]
    rank = F.struct(nearness(F.col("provider")).alias("near"), F.col("discovered_at").alias("at"), F.col("job_id").alias("job_id"))
    return listings.withColumns({"class_id": F.sha2(F.concat_ws("\x1f", *said), 256), "rank": rank})


def representatives(marked: DataFrame) -> DataFrame:
    """One row of each class, first by rank, with its words; a large class is reduced in each task before the shuffle.

    The hashes of a description take more room than its text, so of them only the number (``runs``) and a hash of all (``said``) go along.
    """
    first = marked.groupBy("class_id").agg(F.min_by(F.struct("rank", "source_id", "company", "title", "location", "description"), "rank").alias("r"))
    legal = F.array(*[F.lit(w) for w in LEGAL_FORMS])
    summary = let(F.sort_array(runs_of(F.col("r.description"))), lambda d: F.struct(F.size(d).alias("runs"), F.xxhash64(d).alias("said")))
    return with_once(first, summary=summary).select(
        "class_id", F.col("r.rank").alias("rank"), F.col("r.source_id").alias("source_id"), F.array_except(words_of(F.col("r.company")), legal).alias("company"),
        words_of(F.col("r.title")).alias("title"), words_of(F.col("r.location")).alias("place"), F.col("r.description").alias("description"), "summary.runs", "summary.said",
    )


def numbered(reps: DataFrame) -> DataFrame:
    """The representatives under a short number (``row``), without their descriptions."""
    return cut_lineage(reps.select(F.monotonically_increasing_id().alias("row"), "class_id", "source_id", "title", "company", "place", "runs", "said"), "linkage-rows")


def _rarest(tokens: DataFrame) -> DataFrame:
    """Of each row's tokens in a block, the rarest: as many as its partner in a link, which has ``share`` of them, cannot lack altogether."""
    named = tokens.withColumn("token", F.xxhash64("block", "token"))
    counts = named.groupBy("token").agg(F.count("*").alias("many"))
    own = Window.partitionBy("row", "block", "share")
    hot = counts.orderBy(F.desc("many"), "token").limit(HOT_KEYS).select("token", F.lit(True).alias("_hot"))
    ranked = spread_join(named, counts, "token", "row", hot=hot).withColumns({
        "n": F.row_number().over(own.orderBy("many", "token")), "size": F.count("*").over(own),
    })
    kept = ranked.filter(F.col("n") <= F.col("size") - F.ceil(F.col("share") * F.col("size") - 1e-9) + 1)
    return kept.select("row", "source_id", "block", "token")


def _some(column: str) -> Column:
    """Hashes of the words of a part; one for none, as two parts without words agree."""
    return F.when(F.size(column) == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(column, lambda w: F.xxhash64(w)))


def _tokens(rows: DataFrame, column: str, share: float, block: Column) -> DataFrame:
    return rows.select("row", "source_id", block.alias("block"), F.lit(share).alias("share"), F.explode(_some(column)).alias("token"))


def _renamed(split: DataFrame) -> DataFrame:
    return split.select("row", "source_id", F.col("token").alias("block"))


def _over(level: DataFrame, hot: int, rows: DataFrame | None = None) -> DataFrame:
    """``block, large`` of the blocks of more than ``hot`` rows; with ``rows`` only those with fewer runs in all than half their pairs."""
    if rows is None:
        return cut_lineage(level.groupBy("block").agg(F.count("*").alias("many")).filter(F.col("many") > hot).select("block", F.lit(True).alias("large")), "linkage-large")
    sizes = level.join(rows.select("row", "runs"), "row").groupBy("block").agg(F.count("*").alias("many"), F.sum("runs").alias("runs"))
    return cut_lineage(sizes.filter((F.col("many") > hot) & (F.col("runs") * 4 < F.col("many") * F.col("many"))).select("block", F.lit(True).alias("large")), "linkage-large")


def _parted(level: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = spread_join(level, large, "block", "row", "left")
    return marked.filter("large is null").drop("large"), marked.filter("large").drop("large")


def blocks(reps: DataFrame, weights: Weights, hot: int, rows: DataFrame | None = None) -> DataFrame:
    """``row, source_id, block``: rows that may link share a block. ``rows``: the representatives as :func:`numbered`, where they are already.

    A block of more than ``hot`` rows is split by what else its links must share: a word of the place, or else so much of the description as links
    without one need, which is all of it by default. What is still large is split by the rarest runs of its descriptions, where that leaves fewer pairs:
    near copies share nearly all of their runs, so there each run would bring up the same pairs again.
    """
    rows = numbered(reps) if rows is None else rows
    named = _rarest(_tokens(rows.withColumn("word", F.explode(_some("company"))), "title", weights.need("title"), F.col("word")))
    level = cut_lineage(_renamed(named).distinct(), "linkage-blocks")
    done, held = _parted(level, _over(level, hot))

    def with_runs(some: DataFrame) -> DataFrame:
        ids = rows.select("row", "class_id").join(some.select("row").distinct(), "row")
        return some.join(reps.select("class_id", "description").join(ids, "class_id").select("row", runs_of(F.col("description")).alias("description")), "row")

    placeless = weights.need("description", place=0.0)
    words = held.join(rows.select("row", "place"), "row").withColumn("token", F.explode(_some("place")))
    split = words.select("row", "source_id", F.xxhash64("block", F.lit("place"), "token").alias("block"))
    if placeless >= 1 - 1e-9:
        same = held.join(rows.select("row", "said"), "row").select("row", "source_id", F.xxhash64("block", F.lit("description"), "said").alias("block"))
    else:
        same = _renamed(_rarest(_tokens(with_runs(held), "description", placeless, F.xxhash64("block", F.lit("description")))))
    level = cut_lineage(split.unionByName(same).distinct(), "linkage-blocks")
    large = _over(level, hot, rows)
    if large.isEmpty():
        return done.unionByName(level)
    small, held = _parted(level, large)
    runs = cut_lineage(_rarest(_tokens(with_runs(held), "description", weights.need("description"), F.col("block"))), "linkage-blocks")
    after = runs.groupBy("block", "token").agg(F.count("*").alias("many")).groupBy("block").agg(F.sum(F.col("many") * F.col("many")).alias("after"))
    before = held.groupBy("block").agg(F.count("*").alias("many"))
    pays = cut_lineage(before.join(after, "block").filter(F.col("after") < F.col("many") * F.col("many")).select("block", F.lit(True).alias("large")), "linkage-large")
    whole, _ = _parted(held, pays)
    _, finer = _parted(runs, pays)
    return done.unionByName(small).unionByName(whole).unionByName(_renamed(finer))


def duplicate_pairs(reps: DataFrame, weights: Weights = Weights(), hot: int = 200) -> DataFrame:
    """``a, b, score`` of all representatives that agree enough, of different sources; a < b."""
    rows = numbered(reps)
    keyed = blocks(reps, weights, hot, rows)
    left = keyed.select("block", F.col("row").alias("x"), F.col("source_id").alias("x_source"))
    right = keyed.select("block", F.col("row").alias("y"), F.col("source_id").alias("y_source"))
    met = left.join(right, "block").filter((F.col("x") < F.col("y")) & (F.col("x_source") != F.col("y_source"))).select("x", "y").distinct()
    short = ("title", "company", "place")
    side = lambda n: rows.select(F.col("row").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("class_id", "runs", *short)])
    scored = met.join(side("x"), "x").join(side("y"), "y").withColumn(
        "part", sum((F.lit(getattr(weights, c)) * jaccard(F.col(f"x_{c}"), F.col(f"y_{c}")) for c in short), F.lit(0.0))
    )
    # descriptions are fetched only for pairs that they can still decide: what two of them share is at most the smaller one
    fewer, more = F.least("x_runs", "y_runs"), F.greatest("x_runs", "y_runs")
    at_most = F.when(more == 0, F.lit(1.0)).otherwise(fewer.cast("double") / more)
    open_pairs = cut_lineage(scored.filter(F.col("part") + weights.description * at_most >= weights.least - 1e-9).select(
        F.least("x_class_id", "y_class_id").alias("a"), F.greatest("x_class_id", "y_class_id").alias("b"), "part"
    ), "linkage-open")
    asked = open_pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    read = reps.select("class_id", "description").join(asked, "class_id", "left_semi").select("class_id", runs_of(F.col("description")).alias("description"))
    said = lambda n: read.select(F.col("class_id").alias(n), F.col("description").alias(f"{n}_description"))
    whole = open_pairs.join(said("a"), "a").join(said("b"), "b")
    score = F.round(F.col("part") + F.lit(weights.description) * jaccard(F.col("a_description"), F.col("b_description")), 9)
    return whole.select("a", "b", score.alias("score")).filter(F.col("score") >= weights.least)


def one_to_one(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs in which each row is the other's best of its source; ties go to the smaller class."""
    sources = reps.select("class_id", "source_id")
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    sided = both.join(sources.select(F.col("class_id").alias("b"), F.col("source_id").alias("b_source")), "b")
    best = sided.groupBy("a", "b_source").agg(F.min_by("b", F.struct(-F.col("score"), F.col("b"))).alias("b")).select("a", "b")
    mutual = best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").filter("a < b")
    return pairs.join(mutual, ["a", "b"], "left_semi")


def survivors(links: DataFrame, reps: DataFrame) -> DataFrame:
    """``class_id, survivor`` for every linked class: the best rank that its links lead to, round by round until nothing changes."""
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "linkage-edges")
    now = cut_lineage(reps.join(edges.select(F.col("a").alias("class_id")).distinct(), "class_id", "left_semi").select("class_id", F.col("rank").alias("best")), "linkage-best")
    while True:
        heard = edges.join(now.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.min("best").alias("heard"))
        after = cut_lineage(now.join(heard, "class_id").select("class_id", F.least("best", "heard").alias("best"), (F.col("heard") < F.col("best")).alias("moved")), "linkage-best")
        if after.filter("moved").isEmpty():
            return after.select("class_id", F.col("best.job_id").alias("survivor"))
        now = after.drop("moved")


def duplicate_listings(listings: DataFrame, weights: Weights = Weights(), hot: int = 200) -> DataFrame:
    """One row a listing: ``job_id, class_id, survivor_id, links``.

    ``listings``: ``job_id, source_id, provider, company, title, location, description, discovered_at``. The survivor is the listing
    itself unless a better one of its class or its links exists. Nulls count as empty texts; a listing without a source links with none.
    """
    marked = classes(listings)
    reps = cut_lineage(representatives(marked), "linkage-representatives")
    pairs = cut_lineage(duplicate_pairs(reps, weights, hot), "linkage-pairs")
    links = cut_lineage(one_to_one(pairs, reps), "linkage-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    known = reps.select("class_id", F.col("rank.job_id").alias("own")).join(survivors(links, reps), "class_id", "left").join(ends, "class_id", "left")
    found = known.select("class_id", F.coalesce("survivor", "own").alias("survivor_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    members = cut_lineage(marked.select("job_id", "class_id"), "linkage-members")
    return spread_join(members, found, "class_id", "job_id").select("job_id", "class_id", "survivor_id", "links")
