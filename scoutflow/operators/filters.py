"""Predicates and reason-code cascades over candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoutflow.functions import text as tx
from scoutflow.functions import urls

# Word lists and patterns that decide what a page is about.
PROGRAMME_TERMS = [
    "summer school", "summerschool", "winter school", "spring school", "autumn school", "seasonal school", "training school", "doctoral school",
    "field school", "research school", "short course", "advanced course", "practical course", "school of computing", "thematic school",
]
APPLICATION_TERMS = ["application", "deadline", "scholarship", "travel grant", "tuition waiver", "funding", "stipend"]
DEGREE_TERMS = [
    "phd position", "phd positions", "phd admission", "phd admissions", "doctoral admission", "doctoral admissions", "doctoral programme",
    "doctoral program", "graduate school enrollment", "apply for a phd",
]
LANGUAGE_TERMS = ["language course", "language training", "language school", "english language course", "foreign language course"]
DATA_TERMS = [
    "data science", "data analysis", "data integration", "data management", "data processing", "bioinformatics", "statistics", "machine learning",
    "scientific computing", "rna-seq", "omics",
]
DEGREE_WORDS = r"(?i)\bdegree program(?:me)?s?\b"
LEVEL_NAMES = ["a1", "a2", "b1", "b2", "c1", "c2"]
LEVEL_STEP = r"(?i)\b[abc][12]\+?\s*(?:→|->|–|—|-|to)\s*[abc][12]\+?"
AGGREGATORS = [
    "opportunitiescorners.com", "opportunitydesk.org", "scholarshippositions.com", "scholarshiproar.com", "scholarships.com",
    "opportunitiesforafricans.com", "youthop.com",
]
PROGRAMME = r"(?i)\b(summer|winter|spring|autumn|seasonal|training|field|doctoral|research) school\b|\b(short|advanced) course\b"
EXCLUDED_TYPE = r"(?i)\b(phd studentships?|phd positions?|doctoral positions?|degree programmes?|bachelors?|masters?|webinars?|conferences?|calls? for papers?)\b"
INSTITUTION = r"(?i)\b(university|institute|academy|faculty|department|research cent(?:er|re)|official|application|registration|programme dates|program dates|course dates)\b"
INSTITUTION_HOST = r"(?:\.edu|\.gov|\.ac\.[a-z]{2}|\.edu\.[a-z]{2}|\.int)$"
YEAR = r"\b20\d{2}\b"
GENERIC_TITLES = [
    "application process", "application", "apply", "useful information", "tuition fees, scholarships and financial support", "tuition fees",
    "scholarships & awards", "key dates & application",
]
MIN_DAYS, SOON_DAYS, MAX_FEE, MAX_FEE_PER_DAY = 5, 15, 400, 70


def excluded_programme(text: Column) -> Column:
    """Degree recruitment and language teaching. A degree page that names a school as well is kept, whatever else it says."""
    # Patterns are tried only on texts that hold a word that they need.
    says = lambda needs, pattern: tx.lowered(F.coalesce(text, F.lit("")), lambda t, low: tx.has_any(low, needs) & t.rlike(pattern))
    degree_page = says(["degree"], DEGREE_WORDS)
    language = tx.any_term(text, LANGUAGE_TERMS) | says(LEVEL_NAMES, LEVEL_STEP)
    return tx.any_term(text, DEGREE_TERMS) | F.when(degree_page, ~tx.any_term(text, PROGRAMME_TERMS)).otherwise(language)


def looks_like_opportunity(text: Column) -> Column:
    return ~excluded_programme(text) & tx.any_term(text, PROGRAMME_TERMS) & tx.any_term(text, APPLICATION_TERMS)


def workshop_title(title: Column) -> Column:
    return F.contains(F.lower(title), F.lit("workshop")) & ~tx.any_term(title, PROGRAMME_TERMS)


def link_score(label_and_url: Column, provider: Column | None = None) -> Column:
    """Two for each programme term, one for each application term; for a training provider three for each data term."""
    base = 2 * tx.count_terms(label_and_url, PROGRAMME_TERMS) + tx.count_terms(label_and_url, APPLICATION_TERMS)
    return base if provider is None else base + F.when(provider, 3 * tx.count_terms(label_and_url, DATA_TERMS)).otherwise(0)


def discovery_reason(title: Column, snippet: Column, url: Column, year: int) -> Column:
    """Why a search result is no source, by the first check that fails; empty where it may be one."""
    return tx.let(urls.safe_external(url), lambda safe: tx.let(F.concat_ws(" ", title, snippet, safe), lambda both: _discovery_reason(safe, both, year)))


def _discovery_reason(safe: Column, both: Column, year: int) -> Column:
    name = F.regexp_replace(urls.host(safe), r"^www\.", "")
    years = F.transform(F.regexp_extract_all(both, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))
    latest = F.array_max(years)
    official = name.rlike(INSTITUTION_HOST) | F.coalesce(latest >= year, F.lit(False)) | both.rlike(INSTITUTION)
    return (
        F.when(safe == "", "invalid_url")
        .when(urls.host_matches(name, urls.SOCIAL_HOSTS), "social_domain")
        .when(urls.host_matches(name, AGGREGATORS), "aggregator_domain")
        .when(both.rlike(EXCLUDED_TYPE), "excluded_programme_type")
        .when(~both.rlike(PROGRAMME), "missing_programme_signal")
        .when(latest < year, "past_year")
        .when(~official, "missing_official_signal")
        .otherwise("")
    )


def filter_discovery(results: DataFrame, year: int, order: str = "ord") -> DataFrame:
    """``results`` (``title, snippet, url`` and an order column) with ``reason``; later accepted rows of one URL are ``duplicate_url``."""
    judged = tx.staged(results.drop("reason"), reason=discovery_reason(F.col("title"), F.col("snippet"), F.col("url"), year))
    first = judged.filter("reason = ''").groupBy("url").agg(F.min(order).alias("__first"))
    joined = judged.join(first, "url", "left")
    return joined.withColumn("reason", F.when((F.col("reason") == "") & (F.col(order) > F.col("__first")), "duplicate_url").otherwise(F.col("reason"))).drop("__first")


def settled_status(status: Column, deadline: Column, start: Column, as_of: Column, soon_days: int = SOON_DAYS) -> Column:
    """An uncertain status without a deadline is closed once the start is near. Applying it again changes nothing."""
    near = F.coalesce(start <= F.date_add(as_of, soon_days), F.lit(False))
    return F.when((status == "uncertain") & deadline.isNull() & near, "closed").otherwise(status)


def hard_filter_reasons(min_days: int = MIN_DAYS, max_fee: float = MAX_FEE, online_allowed: bool = False, need_deadline: bool = True, need_money: bool = True) -> Column:
    """Ordered reasons why a candidate is no full match, over its columns ``deadline_status, duration_days, funding_available, fee_eur, fee, mode, topic_keywords``."""
    c = F.col
    funded = F.coalesce(c("funding_available"), F.lit(False))
    cheap = F.coalesce(c("fee_eur") <= max_fee, F.lit(False))
    checks: list[Column] = []
    if need_deadline:
        checks.append(F.when(c("deadline_status") == "closed", "application deadline has passed").when(c("deadline_status") == "not_open", "applications are not open yet").when(c("deadline_status") == "uncertain", "application deadline is uncertain"))
    checks.append(F.when(c("duration_days").isNull(), "duration is uncertain").when(c("duration_days") < min_days, f"duration is below {min_days} days"))
    if need_money:
        unclear = F.when(c("fee_eur").isNotNull(), f"fee exceeds EUR {max_fee:.0f} without explicit funding").when(F.coalesce(c("fee"), F.lit("")) != "", "funding is not explicit and fee equivalence is uncertain").otherwise("funding is not explicit and fee is uncertain")
        checks.append(F.when(~funded & ~cheap, unclear))
    if not online_allowed:
        checks.append(F.when(c("mode") == "online", "online-only").when(c("mode") == "uncertain", "in-person status is uncertain"))
    checks.append(F.when(F.coalesce(F.size("topic_keywords"), F.lit(0)) <= 0, "topic relevance is uncertain"))
    return F.array_compact(F.array(*checks))


def access_status(max_fee: float = MAX_FEE) -> Column:
    return F.when(F.coalesce(F.col("funding_available"), F.lit(False)), "funded").when(F.col("fee_eur") <= max_fee, "low-fee").otherwise("unresolved")


def risk_text() -> Column:
    c = F.col
    kinds = F.coalesce(c("funding_type"), F.array().cast("array<string>"))
    partial = F.when((F.size(kinds) > 0) & ~F.array_contains(kinds, "travel grant"), "Funding may be competitive or partial.")
    unfunded = ~F.coalesce(c("funding_available"), F.lit(False)) & c("fee_eur").isNotNull()
    fee = F.when(unfunded, F.concat(F.lit("No funding is explicit; fee is approximately EUR "), F.format_string("%.0f", c("fee_eur")), F.lit("."))).when(F.coalesce(c("fee"), F.lit("")) != "", F.concat(F.lit("Fee noted: "), c("fee"), F.lit(".")))
    return F.coalesce(F.nullif(F.concat_ws(" ", partial, fee), F.lit("")), F.lit("No major rule-based risk detected."))


def apply_hard_filters(candidates: DataFrame, as_of: Column, **profile) -> DataFrame:
    """Settle the status, then add ``failed_hard_conditions``, ``financial_access_status`` and ``risk_points``."""
    max_fee = profile.get("max_fee", MAX_FEE)
    settled = candidates
    if profile.get("need_deadline", True):
        settled = candidates.withColumn("deadline_status", settled_status(F.col("deadline_status"), F.col("deadline"), F.col("start_date"), as_of))
    failed = settled.withColumn("failed_hard_conditions", hard_filter_reasons(**profile)).withColumn("financial_access_status", access_status(max_fee))
    risk = F.when(F.size("failed_hard_conditions") > 0, F.array_join("failed_hard_conditions", "; ")).otherwise(risk_text())
    return failed.withColumn("risk_points", risk)


def tier(public: Column, qualified: Column, days: Column, funded: Column, per_day: Column) -> Column:
    """``qualified``, ``high`` (five days or more, funded or at most 70 a day), ``found``, or ``hidden``."""
    high = (F.coalesce(days, F.lit(0)) >= MIN_DAYS) & (F.coalesce(funded, F.lit(False)) | F.coalesce(per_day <= MAX_FEE_PER_DAY, F.lit(False)))
    return F.when(qualified, "qualified").when(public & high, "high").when(public, "found").otherwise("hidden")


def public_candidate(past: Column, online: Column, title: Column, days: Column) -> Column:
    return ~past & ~online & ~F.lower(F.trim(title)).isin(GENERIC_TITLES) & ~F.coalesce(days < MIN_DAYS, F.lit(False))


# How each tier is shown, and what a page of a training provider's catalogue says of a course.
TIER_LABELS = {"qualified": "Fully qualified", "high": "High quality"}
PROVIDER, COURSE_PAGE, COURSE_KIND, COURSE_SIGNS = "research_training_provider", "course overview", r"(?i)\b(?:advanced|practical|intensive)\s+course\b", ["apply", "application", "registration"]


def tier_label(tier_name: Column) -> Column:
    return F.coalesce(*[F.when(tier_name == name, label) for name, label in TIER_LABELS.items()], F.lit("Listed"))


def provider_course(text: Column, source_type: Column) -> Column:
    """Whether a page of a configured training provider is that of a course; pages of other sources never are."""
    named = tx.any_term(text, [COURSE_PAGE]) | F.coalesce(text.rlike(COURSE_KIND), F.lit(False)) & tx.any_term(text, COURSE_SIGNS)
    return F.coalesce(source_type == PROVIDER, F.lit(False)) & named


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order: an aggregation, so no key's rows meet in one task before they are reduced."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(whole, F.struct(*[F.col(o) for o in order])).alias("__row"))
    return best.select("__row.*")


def reject_histogram(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.filter(F.coalesce(F.col(reason), F.lit("")) != "").groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def ranked(partition: list[str], order: list[Column]) -> Column:
    return F.row_number().over(W.partitionBy(*partition).orderBy(*order) if partition else W.orderBy(*order))
