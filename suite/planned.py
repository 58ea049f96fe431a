"""What the listing pipeline grows into: one posting of several sources, structured places, repair of sources, fair claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import gazetteer
from listingspark.operators import linkage, places as place_ops, repair, vector_index
from listingspark.operators.contracts import FACTORS, INTEREST, QUALIFICATION
from listingspark.plans import evaluate
from listingspark.session import cut_lineage

from . import duck
from .gating import BLOCKED, EVENTS_AS_OF, coverage_ctes, instant, preferences
from .joined import EVAL_SQL
from .scalars import LISTING_SQL
from .totals import targets
from .views import PLACES, pick, sql, view

c = F.col

# Postings: every document is listed once; some are listed again by an aggregator or on the employer's own page, spelt otherwise.
_FIRM = "concat(source, CASE WHEN doc_id % 3 = 0 THEN ' Group' ELSE concat(' Works ', doc_id % 41) END)"
_PLACE = pick(PLACES, "doc_id")
_TEXT = "coalesce(text, '')"
POSTINGS = (
    (None, "doc_id", "doc_id % 20", pick("Greenhouse|Lever|Remotive|Adzuna", "doc_id"), _FIRM, f"substr({_TEXT}, 1, 60)", _PLACE, _TEXT, "doc_id * 37 % 1000"),
    ("doc_id % 4 = 1", "1000000000 + doc_id", "20 + doc_id % 5", "'Adzuna'", f"concat(upper({_FIRM}), ', Inc.')", f"concat('* ', substr({_TEXT}, 1, 60), '!')", _PLACE, f"concat({_TEXT}, ' Apply now.')", "doc_id * 41 % 1000"),
    ("doc_id % 6 = 2", "2000000000 + doc_id", "30 + doc_id % 3", "'JSON-LD'", _FIRM, f"concat(substr({_TEXT}, 1, 60), ' -')", f"lower({_PLACE})", f"substr({_TEXT}, 1, length({_TEXT}) - 10)", "doc_id * 43 % 1000"),
    ("doc_id % 10 = 3", "3000000000 + doc_id", "doc_id % 20", "'Remotive'", _FIRM, f"substr({_TEXT}, 1, 60)", _PLACE, _TEXT, "doc_id * 47 % 1000"),
)
_NAMES = ("job_id", "source_id", "provider", "company", "title", "location", "description", "discovered_at")


def postings(spark, sf):
    docs = view(spark, sf, "documents")
    parts = [(docs.filter(where) if where else docs).selectExpr(*[f"{e} AS {n}" for n, e in zip(_NAMES, row)]) for where, *row in POSTINGS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumns({n: c(n).cast("bigint") for n in ("job_id", "source_id", "discovered_at")})


_POSTINGS_SQL = "post AS (" + " UNION ALL ".join(
    "SELECT " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" if n in ("job_id", "source_id", "discovered_at") else f"{e} AS {n}" for n, e in zip(_NAMES, row)) + " FROM documents" + (f" WHERE {where}" if where else "")
    for where, *row in POSTINGS
) + ")"


def duplicate_pairs(spark, sf):
    reps = cut_lineage(linkage.representatives(linkage.classes(postings(spark, sf))), "suite-representatives")
    rows = linkage.duplicate_pairs(reps)
    ids = reps.select("class_id", c("rank.job_id").alias("job_id"))
    named = rows.join(ids.select(c("class_id").alias("a"), c("job_id").alias("a_job")), "a").join(ids.select(c("class_id").alias("b"), c("job_id").alias("b_job")), "b")
    return named.select(F.least("a_job", "b_job").alias("first_id"), F.greatest("a_job", "b_job").alias("second_id"), "score")


def duplicate_listings(spark, sf):
    return linkage.duplicate_listings(postings(spark, sf)).select("job_id", "survivor_id", "links")


def _all_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({duck.normalized(x)}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)"


_LEGAL = "[" + ", ".join(duck.q(w) for w in linkage.LEGAL_FORMS) + "]"
LINKAGE_CTES = (
    _POSTINGS_SQL,
    f"worded AS (SELECT *, list_filter(list_distinct({_all_words('company')}), lambda w: NOT list_contains({_LEGAL}, w)) AS cw, list_distinct({_all_words('title')}) AS tw, "
    f"list_distinct({_all_words('location')}) AS pw, {_all_words('description')} AS dw, sha256({duck.normalized('description')}) AS dh, "
    f"CASE WHEN provider IN ({', '.join(map(duck.q, linkage.EMPLOYER_FEEDS))}) THEN 0 WHEN provider IN ({', '.join(map(duck.q, linkage.BOARD_FEEDS))}) THEN 1 ELSE 2 END AS near FROM post)",
    "classed AS (SELECT *, sha256(concat_ws(chr(31), array_to_string(list_sort(cw), ' '), array_to_string(list_sort(tw), ' '), array_to_string(list_sort(pw), ' '), dh)) AS class_id FROM worded)",
    "reps AS MATERIALIZED (SELECT class_id, source_id, job_id, cw, tw, pw, near, discovered_at, list_distinct(CASE WHEN len(dw) >= 3 THEN list_transform(range(1, len(dw) - 1), lambda i: array_to_string(dw[i:i + 2], ' ')) "
    "WHEN len(dw) > 0 THEN [array_to_string(dw, ' ')] ELSE [] END) AS runs FROM classed QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY near, discovered_at, job_id) = 1)",
    f"open_pairs AS MATERIALIZED (SELECT a.class_id AS a, b.class_id AS b, 0.45::DOUBLE * {_jaccard('a.tw', 'b.tw')} + 0.2::DOUBLE * {_jaccard('a.cw', 'b.cw')} + 0.15::DOUBLE * {_jaccard('a.pw', 'b.pw')} AS part "
    "FROM reps a JOIN reps b ON a.class_id < b.class_id AND a.source_id <> b.source_id WHERE part >= 0.649::DOUBLE)",
    f"pairs AS MATERIALIZED (SELECT a, b, x.job_id AS aj, y.job_id AS bj, x.source_id AS sa, y.source_id AS sb, round(part + 0.2::DOUBLE * {_jaccard('x.runs', 'y.runs')}, 9) AS score "
    "FROM open_pairs JOIN reps x ON x.class_id = a JOIN reps y ON y.class_id = b WHERE score >= 0.85::DOUBLE)",
)
_SIDES = "sides AS (SELECT a, b, sb AS other, score FROM pairs UNION ALL SELECT b, a, sa, score FROM pairs)"
_BEST = "best AS (SELECT a, b FROM sides QUALIFY row_number() OVER (PARTITION BY a, other ORDER BY score DESC, b) = 1)"
_LINKS = "links AS MATERIALIZED (SELECT x.a, x.b FROM best x JOIN best y ON x.a = y.b AND x.b = y.a)"
_REACH = "reach AS (SELECT class_id AS a, class_id AS b FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)"

# Locations that name cities, regions, codes and several places at once.
_MORE = "|Toronto, ON|London, Ontario|Portland, OR or Portland, Maine|San Francisco, CA / New York|CA|Paris, TX; Paris|Remote, Canada|North America Remote|St. Thomas, U.S. Virgin Islands|Join us in Dublin|Cambridge, Massachusetts|Work in or near Munich, Bavaria|DE|Atlanta, Georgia;Tbilisi, Georgia|nowhere at all|"
_SPOT = {"job_id": "doc_id", "location": f"CASE WHEN doc_id % 2 = 0 THEN {_PLACE} ELSE {pick(_MORE, 'doc_id DIV 2')} END", "country": "CASE WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 7 = 0 THEN 'us/ca' WHEN doc_id % 11 = 0 THEN 'Canada, Narnia' ELSE '' END"}


def structured_places(spark, sf):
    rows = view(spark, sf, "documents").selectExpr(*[f"{e} AS {n}" for n, e in _SPOT.items()])
    found = place_ops.structured_places(rows, gazetteer.gazetteer(spark))
    return found.select("job_id", c("n").cast("bigint").alias("n"), "country", "region", "city", "remote", "confidence", "evidence", "matched", F.array_join("applicants", ",").alias("applicants"))


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else duck.q(v)
    return ", ".join("(" + ", ".join(map(show, row)) + ")" for row in rows)


def _place_name(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), '.', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _hit_ctes(tag: str, parts: str, kinds: str, stated: str) -> list[str]:
    inside = "((y.kind = 'country' AND x.kind IN ('region', 'city') AND x.country = y.country) OR (y.kind = 'region' AND x.kind = 'city' AND x.country = y.country AND x.region = y.region))"
    mutual = inside + " OR " + inside.replace("x.", "@.").replace("y.", "x.").replace("@.", "y.")
    return [
        f"{tag}_met AS (SELECT DISTINCT p.country AS c0, p.location AS l0, p.n, i AS start, k AS long, g.name, g.kind, g.country, coalesce(g.region, '') AS region, coalesce(g.city, '') AS city, g.weight, g.weak, len(p.w) AS size "
        f"FROM {parts} p, range(0, len(p.w)) r(i), range(1, 7) q(k) JOIN gaz g ON g.name = array_to_string(p.w[i + 1:i + k], ' ') WHERE i + k <= len(p.w) AND {kinds})",
        f"{tag}_kept AS (SELECT * FROM {tag}_met h WHERE NOT EXISTS (SELECT 1 FROM {tag}_met o WHERE o.c0 = h.c0 AND o.l0 = h.l0 AND o.n = h.n AND o.start < h.start + h.long AND h.start < o.start + o.long AND (o.long > h.long OR (o.long = h.long AND o.start < h.start))))",
        f"{tag}_rated AS (SELECT x.*, (SELECT count(DISTINCT y.start) FROM {tag}_kept y WHERE y.c0 = x.c0 AND y.l0 = x.l0 AND y.n = x.n AND y.start <> x.start AND ({mutual})) + {stated} AS support FROM {tag}_kept x)",
        f"{tag}_graded AS (SELECT *, CASE WHEN weak AND support = 0 THEN CASE kind WHEN 'country' THEN 3 ELSE 1 END ELSE CASE kind WHEN 'city' THEN 3 WHEN 'region' THEN 2 WHEN 'country' THEN 1 ELSE 0 END END AS specific FROM {tag}_rated)",
        f"{tag}_place AS (SELECT * FROM {tag}_graded WHERE NOT weak OR support > 0 OR long = size QUALIFY row_number() OVER (PARTITION BY c0, l0, n ORDER BY support DESC, weak, specific DESC, weight DESC, start, coalesce(country, ''), region, city, kind, name) = 1)",
    ]


def _place_parts(name: str, column: str, separators: str) -> str:
    return (
        f"{name} AS (SELECT country, location, unnest(range(len(ps))) AS n, string_split(unnest(ps), ' ') AS w FROM (SELECT country, location, "
        f"list_filter(list_transform(regexp_split_to_array({column}, '{separators}'), lambda p: {_place_name('p')}), lambda p: p <> '') AS ps FROM texts))"
    )


PLACES_SQL = (
    "WITH spots AS (SELECT " + ", ".join(f"{e.replace(' DIV ', ' // ')} AS {n}" for n, e in _SPOT.items()) + " FROM documents), texts AS (SELECT DISTINCT country, location FROM spots), "
    f"raw(name, kind, city, region, country, weight, weak) AS (VALUES {_values(gazetteer.rows())}), gaz AS MATERIALIZED (SELECT DISTINCT {_place_name('name')} AS name, kind, city, region, country, weight, weak FROM raw), "
    + ", ".join([
        _place_parts("fields", "country", "[,;/|]"), *_hit_ctes("f", "fields", "g.kind = 'country'", "0"),
        "told AS (SELECT c0, l0, list_sort(list(DISTINCT country)) AS stated FROM f_place GROUP BY ALL)",
        _place_parts("parts", "location", r"(?i)\s*[;|/]\s*|\s+or\s+"),
        *_hit_ctes("l", "parts", "true", "CASE WHEN list_contains((SELECT stated FROM told WHERE told.c0 = x.c0 AND told.l0 = x.l0), x.country) THEN 2 ELSE 0 END"),
        "near AS (SELECT p.country AS c0, p.location AS l0, p.n, coalesce(stated, []) AS stated, regexp_matches(array_to_string(p.w, ' '), '(^| )(remote|anywhere|worldwide|global|work from home|wfh)( |$)') AS remote, "
        "l.kind, l.support, l.country, l.region, l.city, l.name FROM parts p LEFT JOIN l_place l ON l.c0 = p.country AND l.l0 = p.location AND l.n = p.n LEFT JOIN told ON told.c0 = p.country AND told.l0 = p.location)",
        "judged AS (SELECT *, CASE WHEN kind IS NULL AND len(stated) = 1 THEN 'country field' WHEN kind IS NULL AND remote THEN 'remote' WHEN kind IS NULL THEN 'none' WHEN list_contains(stated, country) THEN 'country field' "
        "WHEN kind = 'city' AND support > 0 THEN 'city in context' WHEN kind = 'region' AND support > 0 THEN 'region in context' ELSE kind END AS evidence, "
        "CASE WHEN kind IS NULL AND len(stated) = 1 THEN stated[1] ELSE country END AS said FROM near)",
        "rows AS (SELECT c0, l0, n, said AS country, nullif(region, '') AS region, nullif(city, '') AS city, remote, evidence, name AS matched FROM judged "
        "UNION ALL SELECT c0, l0, unnest(range(len(stated))), unnest(stated), NULL, NULL, false, 'country field', NULL FROM told WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.country = c0 AND p.location = l0))",
    ])
    + " SELECT job_id, n, rows.country, region, city, remote, CASE evidence " + " ".join(f"WHEN {duck.q(k)} THEN {v}::DOUBLE" for k, v in place_ops.CONFIDENCE.items()) + " END AS confidence, evidence, matched, "
    "CASE WHEN evidence = 'area' THEN CASE matched " + " ".join(f"WHEN {duck.q(k)} THEN {duck.q(','.join(v))}" for k, v in gazetteer.AREAS.items()) + " END ELSE coalesce(rows.country, '') END AS applicants "
    "FROM spots JOIN rows ON rows.c0 = spots.country AND rows.l0 = spots.location"
)

CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


def _streaks(spark, sf):
    """Failures in a row over three batches of runs, each of which only knows the streaks that the one before left open."""
    runs = view(spark, sf, "v_runs").withColumn("started_at", c("started_at").cast("timestamp"))
    parts = runs.filter(c("started_at") < CUTS[0]), runs.filter((c("started_at") >= CUTS[0]) & (c("started_at") < CUTS[1])), runs.filter(c("started_at") >= CUTS[1])
    carried, found = None, None
    for part in parts:
        rows = repair.failure_streaks(part, carried)
        found = rows if found is None else found.unionByName(rows)
        carried = cut_lineage(repair.open_streaks(part, carried), "streaks")
    return found, carried


def failure_streaks(spark, sf):
    return _streaks(spark, sf)[0].select("source_id", "run_id", "streak")


def open_streaks(spark, sf):
    return _streaks(spark, sf)[1]


def repair_candidates(spark, sf):
    rows = repair.repaired_candidates(view(spark, sf, "v_candidates"), _streaks(spark, sf)[0])
    return rows.select("candidate_id", "next_status", "resets")


def fair_claims(spark, sf):
    """A queue in which one user holds most of what waits."""
    rows = view(spark, sf, "v_candidates").withColumn("user_id", F.expr("CASE WHEN candidate_id % 10 = 0 THEN user_id ELSE 3 END"))
    return repair.fair_claims(rows, instant(EVENTS_AS_OF), 40)


def source_conflicts(spark, sf):
    rows = view(spark, sf, "v_candidates").filter("status = 'Resolved'").withColumn("identity", F.expr("concat('Lever:board', candidate_id % 30)"))
    return repair.source_conflicts(rows)


def _answers(spark, sf):
    """What a model would say of each owned listing; it has no answer for some, and breaks its contract for a few."""
    factors = [f"CASE WHEN doc_id % 53 = 0 THEN 1.5 ELSE ((doc_id * {k}) % 101) / CAST(100 AS DOUBLE) END AS {f}" for k, f in zip((3, 5, 7, 11, 13, 17, 19, 23), FACTORS)]
    return view(spark, sf, "documents").filter("doc_id % 9 <> 4").selectExpr("doc_id % 20 AS user_id", "doc_id AS job_id", "concat('Reason ', doc_id % 7) AS reason", *factors)


def evaluate_job(spark, sf):
    """Matches of one evaluation: eligible batch, budget, scores, merge; and how many alerts each gave."""
    matches = view(spark, sf, "v_matches").selectExpr(
        "user_id", "job_id", "score", "timestamp_seconds(1704067200 + (job_id % 700) * 3700) AS evaluated_at", "CAST(cost_micros DIV 100 AS BIGINT) AS cost_micros", "reason")
    known = view(spark, sf, "v_listings").withColumn("description", F.coalesce("description", F.lit("")))
    wanted = targets(spark, sf).withColumn("target_text", F.concat(F.lit("Target of "), c("user_id").cast("string")))
    vectors = view(spark, sf, "embeddings").select(c("vec_id").alias("job_id"), "embedding")
    done = evaluate.evaluate(
        spark, known, view(spark, sf, "v_refs"), view(spark, sf, "v_sources").filter("enabled"), matches, preferences(spark, sf), wanted, vectors, _answers(spark, sf),
        view(spark, sf, "v_alerts"), instant("2024-01-31 12:00:00"))
    alerts = done.alerts.groupBy("user_id", "job_id").agg(F.count("*").alias("alerts"))
    scored = done.matches.filter("outcome <> 'missing'").select("user_id", "job_id", c("outcome").alias("merged"))
    rows = done.batch.join(scored, ["user_id", "job_id"], "left").join(alerts, ["user_id", "job_id"], "left")
    return rows.select("user_id", "job_id", "estimate", "outcome", "merged", F.coalesce("alerts", F.lit(0)).cast("bigint").alias("alerts"),
                       *[c(n).cast("bigint").alias(n) for n in ("overall_score", "qualification_score", "interest_score")])


STREAKS_SQL = (
    "done AS (SELECT source_id, run_id, started_at, status = 'Failed' AS failed FROM v_runs WHERE status <> 'Running')",
    "cut AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS breaks FROM done)",
    "streaks AS (SELECT source_id, run_id, row_number() OVER (PARTITION BY source_id, breaks ORDER BY started_at, run_id) AS streak FROM cut WHERE failed)",
)


def _group_score(names) -> str:
    total, earned = " + ".join(f"w_{n}" for n in names), " + ".join(f"{'role2' if n == 'role' else n} * w_{n}" for n in names)
    return f"CASE WHEN outcome NOT IN ('over_budget', 'no_answer') AND problem IS NULL AND {total} <> 0 THEN CAST(floor(({earned}) / ({total}) * 100 + 0.5) AS BIGINT) END"


_ANSWERS_SQL = "answers AS (SELECT doc_id AS job_id, concat('Reason ', doc_id % 7) AS reason, " + ", ".join(
    f"CASE WHEN doc_id % 53 = 0 THEN 1.5 ELSE ((doc_id * {k}) % 101) / CAST(100 AS DOUBLE) END AS {f}" for k, f in zip((3, 5, 7, 11, 13, 17, 19, 23), FACTORS)) + " FROM documents WHERE doc_id % 9 <> 4)"
EVALUATE_SQL = sql(
    "v_listings v_matches v_refs v_sources v_prefs v_alerts v_vectors",
    "SELECT r.user_id, r.job_id, estimate, o2 AS outcome, CASE WHEN o2 = 'scored' THEN CASE WHEN m.job_id IS NULL THEN 'added' ELSE 'updated' END END AS merged, "
    "CASE WHEN o2 = 'scored' AND notifications_enabled AND overall_score >= notify_min THEN 1 ELSE 0 END AS alerts, overall_score, qualification_score, interest_score "
    "FROM rated r LEFT JOIN mt m ON m.user_id = r.user_id AND m.job_id = r.job_id",
    "mt AS (SELECT user_id, job_id, make_timestamp(CAST((1704067200 + (job_id % 700) * 3700) * 1000000 AS BIGINT)) AS evaluated_at, cost_micros // 100 AS cost FROM v_matches)",
    EVAL_SQL, *coverage_ctes(), _ANSWERS_SQL,
    "tg AS (SELECT user_id, arg_min(embedding, vec_id) AS target FROM v_vectors GROUP BY user_id)",
    "picked AS (SELECT * FROM (SELECT l.* REPLACE (coalesce(description, '') AS description), p.* EXCLUDE (user_id, salary_min, currency), row_number() OVER (PARTITION BY l.owner_id ORDER BY l.discovered_at DESC, l.job_id) AS n "
    f"FROM ev l JOIN v_prefs p ON p.user_id = l.owner_id JOIN coverage cv ON cv.country = l.country AND cv.location = l.location WHERE ({BLOCKED}) IS NULL) WHERE n <= batch_size)",
    f"tokens AS (SELECT p.*, target, CAST(ceil(length(concat_ws(chr(10), CASE WHEN target IS NULL THEN '' ELSE concat('Target of ', p.owner_id) END, {LISTING_SQL})) / 4.0::DOUBLE) AS BIGINT) AS k FROM picked p LEFT JOIN tg ON tg.user_id = p.owner_id)",
    "priced AS (SELECT *, CAST(ceil((k + 200) * 0.75 + 700 * 4.5 + k * 0.02) AS BIGINT) AS estimate FROM tokens)",
    "spend AS (SELECT user_id, sum(cost) AS spent FROM mt WHERE evaluated_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1)",
    f"gated AS (SELECT p.owner_id AS user_id, p.job_id, estimate, notifications_enabled, notify_min, target, {', '.join('w_' + f for f in FACTORS)}, coalesce(spent, 0) + sum(estimate) OVER (PARTITION BY p.owner_id ORDER BY n) <= budget_micros AS affordable FROM priced p LEFT JOIN spend s ON s.user_id = p.owner_id)",
    "judged AS (SELECT g.*, a.* EXCLUDE (job_id), CASE WHEN v.embedding IS NULL OR target IS NULL THEN role ELSE role * 0.6 + (list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(target AS DOUBLE[])) + 1) / 2 * 0.4 END AS role2, "
    "CASE WHEN NOT affordable THEN 'over_budget' WHEN a.job_id IS NULL THEN 'no_answer' ELSE 'open' END AS outcome, "
    f"CASE WHEN abs({' + '.join('w_' + f for f in FACTORS)} - 100) >= 0.001 THEN 'weight_total' WHEN NOT ({' AND '.join(f + ' BETWEEN 0 AND 1' for f in FACTORS)}) THEN 'factor_range' END AS problem "
    "FROM gated g LEFT JOIN answers a ON a.job_id = g.job_id LEFT JOIN embeddings v ON v.vec_id = g.job_id)",
    f"rated AS (SELECT *, {_group_score(FACTORS)} AS overall_score, {_group_score(QUALIFICATION)} AS qualification_score, {_group_score(INTEREST)} AS interest_score, "
    "CASE WHEN outcome <> 'open' THEN outcome WHEN qualification_score IS NULL OR interest_score IS NULL THEN 'problem' ELSE 'scored' END AS o2 FROM judged)",
)

def vector_search(spark, sf):
    """The ten nearest of all vectors to every fiftieth one."""
    vectors = view(spark, sf, "embeddings")
    index = vector_index.build_index(vectors, lists=64)
    queries = vectors.filter("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "embedding")
    rows = vector_index.nearest(index, queries, k=10, probe=8, exact=True)
    return rows.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), c("rank").cast("bigint").alias("rank"))


QUERIES = {f.__name__: f for f in (vector_search, failure_streaks, open_streaks, repair_candidates, fair_claims, source_conflicts, evaluate_job)} | {"structured_places": structured_places, "duplicate_pairs": duplicate_pairs, "duplicate_listings": duplicate_listings}

ORACLE = {
    "vector_search": "SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS s, "
        "row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 10",
    "failure_streaks": sql("v_runs", "SELECT * FROM streaks", *STREAKS_SQL),
    "open_streaks": sql("v_runs", "SELECT source_id, count(*) FILTER (WHERE failed AND breaks = last) AS streak FROM (SELECT *, max(breaks) OVER (PARTITION BY source_id) AS last FROM cut) GROUP BY 1", *STREAKS_SQL),
    "repair_candidates": sql("v_runs v_candidates", "SELECT candidate_id, CASE WHEN coalesce(n, 0) > 0 AND status NOT IN ('Pending', 'Resolving') THEN 'Pending' ELSE status END AS next_status, coalesce(n, 0) AS resets "
        "FROM v_candidates k LEFT JOIN (SELECT source_id, count(*) AS n FROM streaks WHERE streak % 3 = 0 GROUP BY 1) s ON s.source_id = k.source_id", *STREAKS_SQL),
    "fair_claims": sql("v_candidates", "SELECT candidate_id, user_id, place + coalesce(ahead, 0) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, candidate_id) AS place FROM q WHERE due) w "
        "LEFT JOIN (SELECT user_id, count(*) AS ahead FROM q WHERE status = 'Resolving' AND NOT due GROUP BY 1) b USING (user_id) ORDER BY turn, created_at, candidate_id LIMIT 40",
        f"q AS (SELECT * REPLACE (CASE WHEN candidate_id % 10 = 0 THEN user_id ELSE 3 END AS user_id), status = 'Pending' OR (status = 'Resolving' AND last_checked_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 15 MINUTE) AS due FROM v_candidates)"),
    "source_conflicts": sql("v_candidates", "SELECT candidate_id, user_id, identity, holder FROM (SELECT *, arg_min(candidate_id, (created_at, candidate_id)) OVER (PARTITION BY user_id, identity) AS holder FROM "
        "(SELECT *, concat('Lever:board', candidate_id % 30) AS identity FROM v_candidates WHERE status = 'Resolved')) WHERE candidate_id <> holder"),
    "evaluate_job": EVALUATE_SQL,
    "structured_places": PLACES_SQL,
    "duplicate_pairs": sql("", "SELECT least(aj, bj) AS first_id, greatest(aj, bj) AS second_id, score FROM pairs", *LINKAGE_CTES),
    "duplicate_listings": "WITH RECURSIVE " + ", ".join([*LINKAGE_CTES, _SIDES, _BEST, _LINKS, _REACH]) +
        ", kept AS (SELECT reach.a, arg_min(r.job_id, (r.near, r.discovered_at, r.job_id)) AS survivor_id FROM reach JOIN reps r ON r.class_id = reach.b GROUP BY reach.a), "
        "many AS (SELECT a, count(*) AS links FROM links GROUP BY a) "
        "SELECT job_id, survivor_id, coalesce(links, 0) AS links FROM classed JOIN kept ON kept.a = class_id LEFT JOIN many ON many.a = class_id",
}
