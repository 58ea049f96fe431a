"""Feed normalization: payloads are built from the documents, the SQL computes the expected rows from the columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

import listingspark.sources.boards  # noqa: F401  registers the board mappings
import listingspark.sources.feeds  # noqa: F401  registers the feed mappings
from listingspark.session import cut_lineage
from listingspark.sources import registry

from . import duck
from .views import sql, view

H = duck.html_to_text
NS = "CAST(NULL AS STRING)"


def _items(good: dict[str, str], broken: str) -> str:
    """A JSON array of one good item and one that lacks a required field."""
    def struct(fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    return f"array({struct(good)}, {struct({**good, broken: NS})})"


def _xml(text: str) -> str:
    return f"concat('<![CDATA[', {text}, ']]>')"


COMPANY = "CASE WHEN company <> '' THEN company ELSE board END"

# provider -> (payload in Spark SQL, expected columns in the checking SQL, row filter)
FEEDS: dict[str, tuple[str, str, dict[str, str], str]] = {
    "Greenhouse": ("norm_greenhouse", "to_json(named_struct('jobs', " + _items({
        "id": "n", "title": "title", "absolute_url": "url", "company_name": "CASE WHEN n % 3 = 0 THEN concat('Acme ', n % 7) END",
        "content": "body", "first_published": "CASE WHEN n % 4 <> 0 THEN posted END", "updated_at": "'2023-12-31T00:00:00Z'",
        "location": "named_struct('name', CASE WHEN n % 2 = 0 THEN place ELSE '' END)",
        "offices": "array(named_struct('name', 'HQ'), named_struct('name', ''), named_struct('name', concat('Lab ', n % 3)))",
    }, "title") + "))", {
        "title": "title",
        "company": f"CASE WHEN n % 3 = 0 THEN concat('Acme ', n % 7) ELSE {COMPANY} END",
        "description": H("body"),
        "location": "CASE WHEN n % 2 = 0 AND place <> '' THEN place ELSE concat('HQ; Lab ', n % 3) END",
        "work_type": "CASE WHEN n % 2 = 0 AND lower(place) LIKE '%remote%' THEN 'Remote' ELSE 'Unknown' END",
        "posted_at": "CASE WHEN n % 4 <> 0 THEN posted ELSE '2023-12-31T00:00:00Z' END",
    }, "true"),
    "Lever": ("norm_lever", "to_json(" + _items({
        "id": "concat('lv', n)", "text": "title", "hostedUrl": "url",
        "categories": "named_struct('location', place, 'commitment', kind)",
        "country": "CASE WHEN n % 3 = 0 THEN 'US' END",
        "descriptionPlain": "CASE WHEN n % 2 = 0 THEN clean ELSE '' END", "description": "body",
        "workplaceType": "split_part('remote|hybrid|on-site|onsite|unspecified|elsewhere', '|', CAST(n % 6 AS INT) + 1)",
        "salaryRange": "CASE WHEN n % 4 <> 0 THEN named_struct('currency', cur, 'interval', unit, 'min', least(lo, hi), 'max', greatest(lo, hi)) END",
    }, "text") + ")", {
        "external_id": "concat('lv', n)",
        "title": "title",
        "company": COMPANY,
        "description": f"CASE WHEN n % 2 = 0 AND clean <> '' THEN clean ELSE {H('body')} END",
        "location": "place",
        "country": "CASE WHEN n % 3 = 0 THEN 'US' ELSE '' END",
        "employment_type": "CASE WHEN lower(kind) LIKE '%contract%' THEN 'Contract' WHEN kind LIKE '%part%' THEN 'Temporary' WHEN kind LIKE '%full%' THEN 'Full-time' ELSE 'Unknown' END",
        "work_type": "['Remote','Hybrid','On-site','On-site','Unknown'][n % 6 + 1]",
        "salary_min": "CASE WHEN n % 4 <> 0 THEN least(lo, hi) END",
        "salary_max": "CASE WHEN n % 4 <> 0 THEN greatest(lo, hi) END",
        "salary_period": "CASE WHEN n % 4 <> 0 AND lower(unit) IN ('year','hour','month','week','day') THEN lower(unit) ELSE 'unknown' END",
        "currency": "CASE WHEN n % 4 <> 0 THEN cur ELSE 'Unknown' END",
        "posted_at": "NULL",
    }, "n % 6 < 5"),
    "Ashby": ("norm_ashby", "to_json(named_struct('jobs', " + _items({
        "title": "title", "jobUrl": "url", "location": "place", "department": "dept",
        "workplaceType": "split_part('Remote|Hybrid|OnSite', '|', CAST(n % 3 AS INT) + 1)",
        "descriptionHtml": "body", "publishedAt": "CASE WHEN n % 5 <> 0 THEN posted ELSE 'soon' END",
        "employmentType": "split_part('FullTime|PartTime|Intern|Contract|Temporary', '|', CAST(n % 5 AS INT) + 1)",
        "compensation": "named_struct('summaryComponents', array("
            "named_struct('compensationType', 'EquityPercentage', 'interval', 'NONE', 'currencyCode', 'GBP', 'minValue', 1L, 'maxValue', 2L),"
            "named_struct('compensationType', CASE WHEN n % 3 <> 1 THEN 'Salary' ELSE 'Bonus' END, 'interval', CASE WHEN n % 2 = 0 THEN '1 YEAR' ELSE '1 HOUR' END, 'currencyCode', cur, 'minValue', least(lo, hi), 'maxValue', greatest(lo, hi))))",
    }, "jobUrl") + "))", {
        "external_id": "url",
        "title": "title",
        "company": COMPANY,
        "description": H("body"),
        "location": "place",
        "industry": "dept",
        "employment_type": "['Full-time','Temporary','Temporary','Contract','Temporary'][n % 5 + 1]",
        "work_type": "['Remote','Hybrid','On-site'][n % 3 + 1]",
        "salary_min": "CASE WHEN n % 3 <> 1 THEN least(lo, hi) END",
        "salary_max": "CASE WHEN n % 3 <> 1 THEN greatest(lo, hi) END",
        "salary_period": "CASE WHEN n % 3 <> 1 AND n % 2 = 0 THEN 'year' ELSE 'unknown' END",
        "currency": "CASE WHEN n % 3 <> 1 THEN cur ELSE 'Unknown' END",
        "posted_at": "CASE WHEN n % 5 <> 0 THEN posted END",
    }, "true"),
    "Workable": ("norm_workable", "to_json(named_struct('name', CASE WHEN n % 2 = 0 THEN 'Works &amp; Co' ELSE '' END, 'jobs', " + _items({
        "shortcode": "concat('W', n)", "title": "title", "url": "url", "description": "body", "employment_type": "kind",
        "telecommuting": "CASE WHEN n % 3 = 0 THEN true WHEN n % 3 = 1 THEN false END",
        "function": "dept", "industry": "CASE WHEN n % 2 = 0 THEN '' ELSE 'Tech' END",
        "city": "CASE WHEN n % 4 < 2 THEN 'Oslo' ELSE '' END", "state": "CASE WHEN n % 8 < 2 THEN 'Viken' END",
        "country": "CASE WHEN n % 4 = 1 THEN 'Norway' ELSE '' END",
        "published_on": "CASE WHEN n % 3 = 0 THEN substr(posted, 1, 10) END", "created_at": "posted",
    }, "shortcode") + "))", {
        "external_id": "concat('W', n)",
        "title": H("title"),
        "company": f"CASE WHEN n % 2 = 0 THEN 'Works & Co' ELSE {COMPANY} END",
        "description": H("body"),
        "location": "concat_ws(', ', CASE WHEN n % 4 < 2 THEN 'Oslo' END, CASE WHEN n % 8 < 2 THEN 'Viken' END, CASE WHEN n % 4 = 1 THEN 'Norway' END)",
        "country": "CASE WHEN n % 4 = 1 THEN 'Norway' ELSE '' END",
        "industry": "CASE WHEN n % 2 = 0 THEN dept ELSE 'Tech' END",
        "employment_type": "CASE WHEN regexp_matches(lower(kind), 'contract|freelance') THEN 'Contract' WHEN regexp_matches(kind, 'full[ -]?time') THEN 'Full-time' WHEN regexp_matches(lower(kind), 'part[ -]?time|intern|temporary') THEN 'Temporary' ELSE 'Unknown' END",
        "work_type": "CASE WHEN n % 3 = 0 THEN 'Remote' WHEN n % 4 < 2 THEN 'On-site' ELSE 'Unknown' END",
        "posted_at": "CASE WHEN n % 3 = 0 THEN concat(substr(posted, 1, 10), 'T00:00:00Z') ELSE posted END",
    }, "true"),
    "Personio": ("norm_personio", "concat('<workzag-jobs><position><id>', n, '</id><name>Role ', n % 97, '</name><office>', replace(place, '&', ''), '</office>"
        "<occupationCategory>', dept, '</occupationCategory><employmentType>', kind, '</employmentType><schedule>', CASE WHEN n % 2 = 0 THEN 'full-time' ELSE '' END, '</schedule>"
        "<jobDescriptions><jobDescription><name>Tasks</name><value>', " + _xml("concat('<p>', clean, '</p>&eacute;&amp;')") + ", '</value></jobDescription>"
        "<jobDescription><name>Empty</name><value> </value></jobDescription><jobDescription><name></name><value>Second body</value></jobDescription></jobDescriptions>"
        "<createdAt>', posted, '</createdAt></position><position><id>', n, '</id><name></name></position></workzag-jobs>')", {
        "title": "concat('Role ', n % 97)",
        "company": COMPANY,
        "description": "concat(CASE WHEN body2 <> '' THEN concat('Tasks', chr(10), body2, chr(10), chr(10)) ELSE '' END, 'Second body')",
        "location": "place",
        "industry": "dept",
        "employment_type": "CASE WHEN regexp_matches(k2, 'freelance|contract') THEN 'Contract' WHEN regexp_matches(k2, 'intern|trainee|working-student|temporary') THEN 'Temporary' WHEN k2 LIKE '%permanent%' THEN 'Permanent' WHEN k2 LIKE '%full%' THEN 'Full-time' ELSE 'Unknown' END",
        "work_type": "CASE WHEN lower(place) LIKE '%remote%' THEN 'Remote' ELSE 'Unknown' END",
        "job_url": "concat('https://', board, '.jobs.personio.de/job/', n)",
        "posted_at": "posted",
    }, "true"),
    "SmartRecruiters": ("norm_smartrecruiters", "to_json(named_struct('content', " + _items({
        "id": "CAST(n AS STRING)", "name": "title", "releasedDate": "posted", "company": "named_struct('name', CASE WHEN n % 2 = 0 THEN 'Smart' ELSE '' END)",
        "location": "named_struct('city', 'Rome', 'region', CASE WHEN n % 2 = 0 THEN 'Lazio' END, 'country', 'it', 'remote', n % 5 = 0, 'fullLocation', CASE WHEN n % 3 = 0 THEN place ELSE '' END)",
        "industry": "named_struct('label', dept)", "typeOfEmployment": "named_struct('label', kind)",
        "postingUrl": "CASE WHEN n % 2 = 0 THEN url END",
        "jobAd": "named_struct('sections', named_struct('companyDescription', named_struct('text', '<b>About</b>'), 'jobDescription', named_struct('text', body), 'qualifications', CASE WHEN n % 2 = 0 THEN named_struct('text', 'Needs') END))",
    }, "name") + "))", {
        "title": H("title"),
        "company": f"CASE WHEN n % 2 = 0 THEN 'Smart' ELSE {COMPANY} END",
        "description": H("concat_ws(concat(chr(10), chr(10)), body, CASE WHEN n % 2 = 0 THEN 'Needs' END, '<b>About</b>')"),
        "location": "CASE WHEN n % 3 = 0 AND place <> '' THEN place WHEN n % 2 = 0 THEN 'Rome, Lazio, it' ELSE 'Rome, it' END",
        "country": "'it'",
        "industry": "dept",
        "employment_type": "CASE WHEN regexp_matches(lower(kind), 'contract|freelance') THEN 'Contract' WHEN kind LIKE '%permanent%' THEN 'Permanent' WHEN regexp_matches(kind, 'full[ -]?time') THEN 'Full-time' WHEN regexp_matches(lower(kind), 'part[ -]?time|intern|temporary') THEN 'Temporary' ELSE 'Unknown' END",
        "work_type": "CASE WHEN n % 5 = 0 THEN 'Remote' ELSE 'On-site' END",
        "job_url": "CASE WHEN n % 2 = 0 THEN url ELSE concat('https://jobs.smartrecruiters.com/', board, '/', n) END",
        "posted_at": "posted",
    }, "true"),
    "Rippling": ("norm_rippling", "to_json(" + _items({
        "uuid": "concat('u-', n)", "name": "title", "url": "url", "description": "named_struct('company', '<i>Blurb</i>', 'role', body)",
        "companyName": "CASE WHEN n % 2 = 0 THEN 'Rip &amp; Co' END",
        "employmentType": "named_struct('id', split_part('SALARIED_FT|HOURLY_PT|TEMP|', '|', CAST(n % 4 AS INT) + 1), 'label', kind)",
        "department": "named_struct('label', dept)", "workLocations": "array(place, 'Depot')", "createdOn": "posted",
    }, "uuid") + ")", {
        "external_id": "concat('u-', n)",
        "title": H("title"),
        "company": f"CASE WHEN n % 2 = 0 THEN 'Rip & Co' ELSE {COMPANY} END",
        "description": H("concat(body, chr(10), chr(10), '<i>Blurb</i>')"),
        "location": "CASE WHEN place <> '' THEN concat(place, '; Depot') ELSE 'Depot' END",
        "industry": "dept",
        "employment_type": r"CASE WHEN regexp_matches(k3, 'contract|freelance|temp') THEN 'Contract' WHEN regexp_matches(k3, 'salaried|full[ -_]?time|ft\b') THEN 'Full-time' WHEN regexp_matches(k3, 'part[ -_]?time|intern|pt\b') THEN 'Temporary' ELSE 'Unknown' END",
        "work_type": "CASE WHEN lower(place) LIKE '%remote%' THEN 'Remote' ELSE 'On-site' END",
        "posted_at": "posted",
    }, "true"),
    "RemoteOK": ("norm_remoteok", "to_json(" + _items({
        "id": "CASE WHEN n >= 0 THEN CAST(n AS STRING) END", "slug": "concat('s', n)", "company": "concat('Rok ', n % 9)", "position": "title", "description": "body",
        "location": "place", "date": "posted", "url": "CASE WHEN n % 3 = 0 THEN '' ELSE url END", "apply_url": "CASE WHEN n % 2 = 0 THEN concat(url, '&apply=1') ELSE '' END",
        "salary_min": "CASE WHEN n % 4 = 0 THEN 0L ELSE least(lo, hi) END", "salary_max": "greatest(lo, hi)",
        "tags": "array(dept, CASE WHEN n % 5 = 0 THEN 'Part Time' ELSE 'x' END)",
    }, "slug") + ")", {
        "title": "title", "company": "concat('Rok ', n % 9)", "description": H("body"), "location": "place", "industry": "dept",
        "employment_type": "CASE WHEN n % 5 = 0 THEN 'Temporary' ELSE 'Full-time' END", "work_type": "'Remote'",
        "salary_min": "CASE WHEN n % 4 = 0 THEN NULL ELSE least(lo, hi) END", "salary_max": "greatest(lo, hi)",
        "salary_period": "'year'", "currency": "'USD'",
        "job_url": "CASE WHEN n % 3 = 0 THEN concat(url, '&apply=1') ELSE url END", "posted_at": "posted",
    }, "n % 3 <> 0 OR n % 2 = 0"),
    "Jobicy": ("norm_jobicy", "CASE WHEN n % 2 = 0 THEN to_json(named_struct('jobs', " + _items({
        "id": "n", "url": "url", "jobTitle": "title", "companyName": "concat('Jy &amp; ', n % 9)", "jobDescription": "body", "jobGeo": "place",
        "jobIndustry": "array(dept, 'Other')", "jobType": "array(kind, 'x')", "pubDate": "posted", "salaryMin": "least(lo, hi)", "salaryMax": "greatest(lo, hi)",
        "salaryCurrency": "cur", "salaryPeriod": "unit",
    }, "url") + ")) ELSE to_json(named_struct('jobs', " + _items({
        "id": "n", "url": "url", "jobTitle": "title", "companyName": "concat('Jy &amp; ', n % 9)", "jobDescription": "body", "jobGeo": "place",
        "jobIndustry": "dept", "jobType": "kind", "pubDate": "posted",
    }, "url") + ")) END", {
        "title": H("title"), "company": "concat('Jy & ', n % 9)", "description": H("body"), "location": "place",
        "industry": "CASE WHEN n % 2 = 0 THEN concat(dept, ', Other') ELSE dept END",
        "employment_type": "CASE WHEN regexp_matches(lower(kind), 'contract|freelance') THEN 'Contract' WHEN kind LIKE '%full%' THEN 'Full-time' ELSE 'Unknown' END",
        "work_type": "'Remote'", "salary_min": "CASE WHEN n % 2 = 0 THEN least(lo, hi) END", "salary_max": "CASE WHEN n % 2 = 0 THEN greatest(lo, hi) END",
        "salary_period": "CASE WHEN n % 2 = 1 THEN 'unknown' WHEN regexp_matches(lower(unit), 'year|annual') THEN 'year' WHEN lower(unit) LIKE '%hour%' THEN 'hour' WHEN lower(unit) LIKE '%month%' THEN 'month' ELSE 'unknown' END",
        "currency": "CASE WHEN n % 2 = 0 AND cur <> 'JPY' THEN cur ELSE 'Unknown' END", "posted_at": "posted",
    }, "true"),
    "Remotive": ("norm_remotive", "to_json(named_struct('jobs', " + _items({
        "id": "n", "url": "url", "title": "title", "company_name": "concat('Rv ', n % 9)", "description": "body", "category": "dept", "job_type": "replace(kind, ' ', '_')",
        "publication_date": "posted", "candidate_required_location": "place", "salary": "'$50-60/hr'",
    }, "company_name") + "))", {
        "title": H("title"), "company": "concat('Rv ', n % 9)", "description": H("body"), "location": "place", "industry": "dept",
        "employment_type": "CASE WHEN regexp_matches(lower(kind), 'contract|freelance') THEN 'Contract' WHEN regexp_matches(replace(kind, ' ', '_'), 'full[_ -]?time') THEN 'Full-time' WHEN regexp_matches(lower(replace(kind, ' ', '_')), 'part[_ -]?time|internship|temporary') THEN 'Temporary' ELSE 'Unknown' END",
        "work_type": "'Remote'", "posted_at": "posted",
    }, "true"),
    "TheMuse": ("norm_themuse", "to_json(named_struct('page_count', 99, 'results', " + _items({
        "id": "n", "name": "title", "contents": "body", "publication_date": "posted",
        "locations": "array(named_struct('name', CASE WHEN n % 7 = 0 THEN 'Flexible' ELSE place END), named_struct('name', ''))",
        "categories": "array(named_struct('name', dept), named_struct('name', 'Misc'))", "refs": "named_struct('landing_page', url)",
        "company": "named_struct('name', CASE WHEN n % 10 = 0 THEN '' ELSE concat('Muse ', n % 9) END)",
    }, "contents") + "))", {
        "title": H("title"), "company": "CASE WHEN n % 10 = 0 THEN '' ELSE concat('Muse ', n % 9) END", "description": H("body"),
        "location": "CASE WHEN n % 7 = 0 THEN 'Flexible' ELSE place END", "industry": "concat(dept, ', Misc')",
        "work_type": "CASE WHEN n % 7 = 0 OR lower(place) LIKE '%remote%' THEN 'Remote' WHEN place <> '' THEN 'On-site' ELSE 'Unknown' END",
        "posted_at": "posted", "problem": "CASE WHEN n % 10 = 0 THEN 'no_employer' END",
    }, "true"),
    "Himalayas": ("norm_himalayas", "to_json(named_struct('jobs', " + _items({
        "guid": "concat('https://him.example.com/', n)", "applicationLink": "CASE WHEN n % 2 = 0 THEN url END", "title": "title", "companyName": "concat('Him ', n % 9)",
        "description": "body", "employmentType": "kind", "minSalary": "CASE WHEN n % 3 <> 0 THEN lo END", "maxSalary": "CASE WHEN n % 3 <> 0 THEN hi END",
        "currency": "cur", "salaryPeriod": "unit", "locationRestrictions": "array(place, 'Norway')", "categories": "array(dept, 'b', 'c', 'd')",
        "pubDate": "unix_seconds(CAST(posted AS TIMESTAMP))",
    }, "title") + "))", {
        "external_id": "concat('https://him.example.com/', n)", "title": H("title"), "company": "concat('Him ', n % 9)", "description": H("body"),
        "location": "concat(place, ', Norway')", "industry": "concat(dept, ', b, c, d')",
        "employment_type": "CASE WHEN regexp_matches(lower(kind), 'contract|freelance') THEN 'Contract' WHEN regexp_matches(kind, 'full[ -]?time') THEN 'Full-time' WHEN regexp_matches(lower(kind), 'part[ -]?time|intern|temporary') THEN 'Temporary' ELSE 'Unknown' END",
        "work_type": "'Remote'", "salary_min": "CASE WHEN n % 3 <> 0 THEN least(lo, hi) END", "salary_max": "CASE WHEN n % 3 <> 0 THEN greatest(lo, hi) END",
        "salary_period": "CASE WHEN n % 3 = 0 THEN 'unknown' ELSE coalesce(['year','hour','month','year','week','day','unknown'][n % 7 + 1], '') END",
        "currency": "CASE WHEN cur <> 'JPY' THEN cur ELSE 'Unknown' END",
        "job_url": "CASE WHEN n % 2 = 0 THEN url ELSE concat('https://him.example.com/', n) END", "posted_at": "posted",
    }, "true"),
    "WeWorkRemotely": ("norm_wwr", "concat('<rss><channel><title>t</title><item><guid>g', n, '</guid><link>', url, '</link><title>', CASE WHEN n % 8 = 0 THEN 'No separator' ELSE concat('Emp ', n % 9, ': Role: ', n % 97) END, '</title><description>', "
        + _xml("concat('<p>', clean, '</p>')") + ", '</description><region>', CASE WHEN n % 2 = 0 THEN 'Europe Only' ELSE '' END, '</region><country>', lang_place, '</country><category>', dept, '</category><type>', kind, '</type><pubDate>Mon, ', substr(posted, 9, 2), ' Jan 2024 ', substr(posted, 12, 8), ' +0000</pubDate></item><item><guid></guid><title>x: y</title></item></channel></rss>')", {
        "external_id": "concat('g', n)", "title": "CASE WHEN n % 8 = 0 THEN 'No separator' ELSE concat('Role: ', n % 97) END",
        "company": "CASE WHEN n % 8 = 0 THEN '' ELSE concat('Emp ', n % 9) END",
        "description": duck.trim_all("regexp_replace(clean, ' +', ' ', 'g')"), "location": "CASE WHEN n % 2 = 0 THEN 'Europe Only' ELSE 'Spain' END",
        "country": "'Spain'", "industry": "dept",
        "employment_type": "CASE WHEN regexp_matches(lower(kind), 'contract|freelance') THEN 'Contract' WHEN regexp_matches(kind, 'full[ -]?time') THEN 'Full-time' WHEN regexp_matches(lower(kind), 'part[ -]?time|intern|temporary') THEN 'Temporary' ELSE 'Unknown' END",
        "work_type": "'Remote'", "posted_at": "posted", "problem": "CASE WHEN n % 8 = 0 THEN 'no_employer' END",
    }, "true"),
    "USAJOBS": ("norm_usajobs", "to_json(named_struct('SearchResult', named_struct('SearchResultItems', " + _items({
        "MatchedObjectId": "CAST(n AS STRING)", "MatchedObjectDescriptor": "named_struct('PositionTitle', title, 'PositionURI', url, 'PositionLocationDisplay', place, "
            "'OrganizationName', CASE WHEN n % 2 = 0 THEN 'Org' ELSE '' END, 'DepartmentName', CASE WHEN n % 3 = 0 THEN 'Department' END, "
            "'JobCategory', array(named_struct('Name', dept), named_struct('Name', 'Gov')), 'PositionSchedule', array(named_struct('Name', kind)), "
            "'QualificationSummary', 'Must qualify', 'PositionRemuneration', array(named_struct('MinimumRange', CASE WHEN n % 5 = 0 THEN 'n/a' ELSE concat(lo, '.0') END, 'MaximumRange', CASE WHEN n % 5 = 0 THEN '85k' ELSE CAST(hi AS STRING) END, 'RateIntervalCode', split_part('PA|ph|PM|PW|PD|XX', '|', CAST(n % 6 AS INT) + 1))), "
            "'PublicationStartDate', posted, 'UserArea', named_struct('Details', named_struct('JobSummary', body, 'MajorDuties', array('One', 'Two'))))",
    }, "MatchedObjectId") + ")))", {
        "title": H("title"), "company": "CASE WHEN n % 2 = 0 THEN 'Org' WHEN n % 3 = 0 THEN 'Department' ELSE 'USAJOBS' END",
        "description": H("concat(body, chr(10), chr(10), 'One', chr(10), 'Two', chr(10), chr(10), 'Must qualify')"), "location": "place", "country": "'United States'",
        "industry": "concat(dept, ', Gov')",
        "employment_type": "CASE WHEN regexp_matches(lower(kind), 'part[ -]?time|intern|temporary') THEN 'Temporary' WHEN regexp_matches(kind, 'full[ -]?time') THEN 'Full-time' ELSE 'Unknown' END",
        "work_type": "CASE WHEN lower(place) LIKE '%remote%' THEN 'Remote' ELSE 'On-site' END",
        "salary_min": "CASE WHEN n % 5 <> 0 THEN least(lo, hi) END", "salary_max": "CASE WHEN n % 5 <> 0 THEN greatest(lo, hi) END",
        "salary_period": "CASE WHEN n % 5 = 0 THEN 'unknown' ELSE ['year','hour','month','week','day','unknown'][n % 6 + 1] END", "currency": "'USD'", "posted_at": "posted",
    }, "true"),
    "Adzuna": ("norm_adzuna", "to_json(named_struct('results', " + _items({
        "id": "n", "title": "title", "description": "body", "redirect_url": "url", "created": "posted",
        "company": "named_struct('display_name', CASE WHEN n % 10 = 0 THEN '' ELSE concat('Adz ', n % 9) END)", "location": "named_struct('display_name', place)",
        "category": "named_struct('label', dept)", "contract_time": "CASE WHEN n % 2 = 0 THEN 'full_time' ELSE 'part_time' END", "contract_type": "CASE n % 3 WHEN 0 THEN 'permanent' WHEN 1 THEN 'contract' END",
        "salary_min": "lo", "salary_max": "hi", "salary_is_predicted": "CASE WHEN n % 4 = 0 THEN '1' ELSE '0' END",
    }, "title") + "))", {
        "title": H("title"), "company": "CASE WHEN n % 10 = 0 THEN '' ELSE concat('Adz ', n % 9) END", "description": H("body"), "location": "place", "industry": "dept",
        "employment_type": "CASE n % 3 WHEN 0 THEN 'Permanent' WHEN 1 THEN 'Contract' ELSE CASE WHEN n % 2 = 0 THEN 'Full-time' ELSE 'Temporary' END END",
        "work_type": "CASE WHEN lower(concat(title, ' ', place)) LIKE '%remote%' THEN 'Remote' WHEN place <> '' THEN 'On-site' ELSE 'Unknown' END",
        "salary_min": "CASE WHEN n % 4 <> 0 THEN least(lo, hi) END", "salary_max": "CASE WHEN n % 4 <> 0 THEN greatest(lo, hi) END",
        "salary_period": "CASE WHEN n % 4 <> 0 THEN 'year' ELSE 'unknown' END",
        "currency": "['USD','EUR','Unknown'][n % 3 + 1]", "posted_at": "posted", "problem": "CASE WHEN n % 10 = 0 THEN 'no_employer' END",
    }, "true"),
}

OUTPUT = (
    "external_id title company description_hash location country industry employment_type seniority work_type "
    "salary_min salary_max salary_period currency job_url posted_at violations"
).split()

EXPECTED_DEFAULTS = {
    "external_id": "CAST(n AS VARCHAR)", "location": "''", "country": "''", "industry": "''", "employment_type": "'Unknown'",
    "seniority": "'Unknown'", "work_type": "'Unknown'", "salary_min": "NULL", "salary_max": "NULL", "salary_period": "'unknown'",
    "currency": "'Unknown'", "job_url": "url", "posted_at": "NULL", "problem": "NULL",
}


def payloads(spark: SparkSession, sf: str, provider: str, feed: DataFrame | None = None) -> DataFrame:
    """Landed pages of one feed: one page per document with a good and a broken item. ``feed``: the view of the feeds, where it is read already."""
    feed = (view(spark, sf, "v_feed") if feed is None else feed).withColumn("lang_place", F.lit("Spain"))
    if provider == "Adzuna":
        feed = feed.withColumn("board", F.expr("split_part('us|DE|jp', '|', CAST(n % 3 AS INT) + 1)"))
    return feed.selectExpr("source_id", f"'{provider}' AS provider", "board", "company", "page_no", f"{FEEDS[provider][1]} AS payload")


def shown(rows: DataFrame) -> DataFrame:
    """The compared columns of normalized rows."""
    return rows.select(*[
        F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias(c) if c == "posted_at"
        else F.array_join(c, ",").alias(c) if c == "violations"
        else F.col(c).cast("bigint").alias(c) if c.startswith("salary_m") else F.col(c)
        for c in OUTPUT
    ])


def expected(provider: str) -> str:
    _, _, columns, where = FEEDS[provider]
    full = {**EXPECTED_DEFAULTS, **columns}
    body = ", ".join(f"{e} AS {c}" for c, e in full.items())
    picked = ", ".join({
        "description_hash": "sha256(description) AS description_hash",
        "violations": f"CASE WHEN problem IS NOT NULL THEN problem ELSE {duck.violations()} END AS violations",
        "posted_at": "replace(replace(posted_at, 'T', ' '), 'Z', '') AS posted_at",
        "salary_min": "CAST(salary_min AS BIGINT) AS salary_min",
        "salary_max": "CAST(salary_max AS BIGINT) AS salary_max",
        **{c: f"{duck.trim_all(c)} AS {c}" for c in ("title", "company", "location", "country", "industry")},
    }.get(c, c) for c in OUTPUT)
    return sql(
        "v_feed", f"SELECT {picked} FROM made",
        f"ready AS (SELECT *, {H('concat(chr(60), chr(112), chr(62), clean, chr(60), chr(47), chr(112), chr(62), chr(38), chr(101)) || ' + duck.q('acute;&amp;'))} AS body2, "
        "lower(trim(concat(kind, ' ', CASE WHEN n % 2 = 0 THEN 'full-time' ELSE '' END))) AS k2, "
        "lower(concat(split_part('SALARIED_FT|HOURLY_PT|TEMP|', '|', CAST(n % 4 AS INT) + 1), ' ', kind)) AS k3 FROM v_feed)",
        f"made AS (SELECT {body} FROM ready WHERE {where})",
    )


def _query(provider: str):
    return lambda spark, sf: shown(registry.normalize(payloads(spark, sf, provider), provider))


def norm_all(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of all feeds in one table, normalized in one plan; what came out of each feed."""
    feed = cut_lineage(view(spark, sf, "v_feed"), "suite-feed")
    landed = reduce(DataFrame.unionByName, [payloads(spark, sf, name, feed) for name in FEEDS])
    return registry.normalize_all(landed).groupBy("provider").agg(
        F.count("*").alias("items"), F.count_if(F.size("violations") == 0).alias("valid"), F.count_distinct("external_id", "description_hash").alias("contents")
    )


QUERIES = {key: _query(name) for name, (key, *_rest) in FEEDS.items()} | {"norm_all": norm_all}
ORACLE = {key: expected(name) for name, (key, *_rest) in FEEDS.items()} | {
    "norm_all": " UNION ALL ".join(
        f"SELECT '{name}' AS provider, count(*) AS items, count(*) FILTER (WHERE violations = '') AS valid, count(DISTINCT (external_id, description_hash)) AS contents FROM ({expected(name)})" for name in FEEDS
    )
}
