"""As-of role and employment look-ups, rosters, profiles and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.functions.joins import pattern_join, top_k_per_group
from parlour.functions.temporal import employed as employed_pred
from parlour.functions.temporal import role_active, today


def active_roles(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Role assignments valid on the as-of day (half-open), with their role type."""
    d = today(as_of)
    r = t["roles"].where(role_active(F.col("start_date"), F.col("end_date"), d))
    # role_definition is a tiny code table (one row per role type): always safe to broadcast
    return r.join(t["role_definition"], "rdid").select(
        "rid", "eid", "rdid", "role_type", "start_date", "end_date")


def employed(t: dict[str, DataFrame], as_of, inclusive: bool = True) -> DataFrame:
    """Employees still employed on the as-of day (``end >= d`` or, exclusive, ``end > d``)."""
    return t["employees"].where(employed_pred(F.col("employment_end"), today(as_of), inclusive))


PERSONAS = {  # Fixed values: persona -> role-type keywords (lower case).
    "management": ("manager",),
    "therapist": ("therapist", "doctor", "beautician"),
    "cashier": ("cashier",),
}


def persona_roster(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Employed staff (inclusive) by persona; one row per active role, several personas possible."""
    e = employed(t, as_of, inclusive=True).select("eid", "work_name", "name")
    j = e.join(active_roles(t, as_of).select("eid", "role_type"), "eid", "left")
    lt = F.lower(F.col("role_type"))
    tags = F.array_compact(F.array(*[
        F.when(F.greatest(*[lt.contains(k) for k in kws]) if len(kws) > 1 else lt.contains(kws[0]), F.lit(p))
        for p, kws in PERSONAS.items()]))
    return j.select(F.explode(tags).alias("persona"), "eid", "work_name", "name", "role_type")


def employee_profile(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Name, work name, start and the distinct active role types joined with ', ' (NULL if none)."""
    roles = active_roles(t, as_of).groupBy("eid").agg(
        F.array_join(F.array_sort(F.collect_set("role_type")), ", ").alias("roles"))
    return t["employees"].join(roles, "eid", "left").select("eid", "name", "work_name", "employment_start", "roles")


def employee_detail(t: dict[str, DataFrame], as_of) -> DataFrame:
    """E5: employee columns plus is_active (exclusive: end NULL or end > d)."""
    e = t["employees"]
    return e.select("eid", "nric_fin_passport_no", "name", "work_name", "gender", "mobile_number", "country_code",
                    "employment_start", "employment_end",
                    employed_pred(F.col("employment_end"), today(as_of), inclusive=False).alias("is_active"))


def role_history(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Every role of every employee, is_active = end NULL or end > d (start not tested)."""
    d = F.lit(today(as_of))
    return t["roles"].join(t["role_definition"], "rdid").select(
        "rid", "eid", "role_type", "start_date", "end_date",
        (F.col("end_date").isNull() | (F.col("end_date") > d)).alias("is_active"))


def search_employees(t: dict[str, DataFrame], terms: DataFrame, as_of, k: int = 10) -> DataFrame:
    """For each ``terms(term_id, q)``: employees whose work name or name ILIKE %q%, first
    ``k`` by work name, labelled Active/Inactive (exclusive). ``%`` and ``_`` in q stay wildcards."""
    q = terms.select("term_id", F.concat(F.lit("%"), F.col("q"), F.lit("%")).alias("asked"))
    j = pattern_join(t["employees"], ["work_name", "name"], _patterns(q), "pat").select("asked", "eid", "work_name", "name", "mobile_number",
                 F.when(employed_pred(F.col("employment_end"), today(as_of), inclusive=False), "Active")
                 .otherwise("Inactive").alias("status"))
    return _first_for_each(q, j, [F.asc("work_name"), F.asc("eid")], k)


def _patterns(asked: DataFrame) -> DataFrame:
    """(asked, pat): the distinct patterns. Each is searched for once, however many ask for it."""
    return asked.select("asked").where(F.col("asked").isNotNull()).distinct().withColumn("pat", F.col("asked"))


def _for_each(asked: DataFrame, found: DataFrame) -> DataFrame:
    """What was ``found`` for a pattern, for each row of ``asked`` that asks for it."""
    return asked.join(found, "asked").drop("asked")


def _first_for_each(asked: DataFrame, found: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows for each term of ``asked`` (term_id, asked): the first of each pattern, then of each term_id,
    which may come with several patterns."""
    first = top_k_per_group(found, ["asked"], order, k).drop("rn")
    return top_k_per_group(_for_each(asked, first), ["term_id"], order, k)


def search_customers(t: dict[str, DataFrame], terms: DataFrame, by: str = "name", k: int = 10) -> DataFrame:
    """For each ``terms(term_id, q)``: customers whose name (or mobile) ILIKE %trim(q)%,
    first ``k`` by name; a term shorter than 2 characters after trimming finds nothing."""
    col = "mobile_number" if by == "mobile" else "name"
    q = terms.select("term_id", F.regexp_replace("q", r"(?U)^\s+|\s+$", "").alias("q")).where(F.length("q") >= 2)
    q = q.select("term_id", F.concat(F.lit("%"), F.col("q"), F.lit("%")).alias("asked"))
    j = pattern_join(t["customers"], [col], _patterns(q), "pat").select(
        "asked", "cid", "name", "mobile_number", "nric_fin_passport_no", "country_code")
    return _first_for_each(q, j, [F.asc("name"), F.asc("cid")], k)


def find_customer(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Per ``requests(req_id, by, term)`` the matching customer with the lowest cid:
    ``by`` = 'mobile' or 'name' (ILIKE %term%), anything else the exact cid. Requests without a match and
    requests with an empty term are absent."""
    r = requests.select("req_id", "by", "term").where(F.length("term") > 0)
    c = t["customers"].select("cid", "name", "mobile_number")
    by_cid = r.where(~F.col("by").eqNullSafe("mobile") & ~F.col("by").eqNullSafe("name")).select(
        "req_id", F.col("term").try_cast("long").alias("cid"))
    j = c.join(by_cid, "cid").select("req_id", *c.columns)
    first = F.min(F.struct("cid", "name", "mobile_number")).alias("m")
    for by, col in (("mobile", "mobile_number"), ("name", "name")):
        q = r.where(F.col("by") == by).select("req_id", F.concat(F.lit("%"), F.col("term"), F.lit("%")).alias("asked"))
        found = pattern_join(c, [col], _patterns(q), "pat").groupBy("asked").agg(first)
        j = j.unionByName(_for_each(q, found).select("req_id", "m.*"))
    return j.groupBy("req_id").agg(first).select("req_id", "m.cid", "m.name", "m.mobile_number")


def service_catalog(t: dict[str, DataFrame], as_of, check_active_from: bool = False) -> DataFrame:
    """Bookable services: active_until NULL or >= d (active_from only tested on request)."""
    d = F.lit(today(as_of))
    s = t["services"].where(F.col("active_until").isNull() | (F.col("active_until") >= d))
    if check_active_from:
        s = s.where(F.col("active_from") <= d)
    return s.join(t["role_definition"], "rdid").select(
        "sid", "name", "base_cost", "duration_minutes", "rdid", "role_type")


def country_list(t: dict[str, DataFrame]) -> DataFrame:
    """S3: countries by name."""
    return t["nationcode"].select("country_code", "country_name").orderBy("country_name", "country_code")


def customer_list(t: dict[str, DataFrame]) -> DataFrame:
    """S3: customers by name."""
    return t["customers"].select("cid", "name", "mobile_number").orderBy("name", "cid")
