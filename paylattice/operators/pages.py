"""Listings from crawled pages.

A page is one row; everything found on it is collected in arrays inside that row
and exploded once, so none of these jobs shuffles.  The tags of a page are read once and
every part of it is then looked up among their intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import experience as E
from ..functions import markup as K
from ..functions import metadata as M
from ..functions import salary as S
from ..functions import text as X
from ..schemas import PAGE_PAYLOAD
from ..sources.io import append_master, conform, read_master
from .dedup import insert_if_absent, keep_with_salary, union_sources, with_key

# --- fixed values: where pay stands on a page, in order of trust --------------
PAY_CLASSES = ["salaryInfoAndJobType", "salary-snippet-container", "detailSalary", "salaryEstimate", "css-1bluz6i",
               "jobsearch-JobMetadataHeader-item", "salary-estimate", "compensation__salary"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
# --- fixed values: cards of a result page, in order of trust; only the first kind found counts ---
CARDS = [K.part("class", "job_result", "article"), K.part("class", "job_result", "div"), K.part("class", "JobCard", "article"),
         K.part("class", "job-listing", "div"), K.part("class", "job-listing", "li"), K.part("data-testid", "job", "div"),
         K.part("class", "job_card", "div")]
CARD_PARTS = {
    "title": [K.part("class", "title", "h2"), K.part("class", "job_link", "a"), K.part("class", "job_title"), K.part("data-testid", "title"), K.tag("h2", "h3")],
    "company": [K.part("class", "company"), K.part("class", "employer"), K.part("data-testid", "company"), K.part("class", "name", "span")],
    "location": [K.part("class", "location"), K.part("data-testid", "location")],
    "snippet": [K.part("class", "snippet"), K.part("class", "description"), K.tag("p")],
}


def plain_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, common entities decoded."""
    t = F.regexp_replace(html, K.HIDDEN, " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    return X.clean_text(t)


def embedded_jobs(pages: DataFrame) -> DataFrame:
    """Listings from the JSON payload that a page carries in its script element."""
    payload = F.regexp_extract(F.col("html"), r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    firms = F.from_json(F.nullif(payload, F.lit("")), PAGE_PAYLOAD)["props"]["pageProps"]["initialJobsData"]["results"]
    rows = pages.select("page_id", "location", firms.alias("_firms")).select(
        "page_id", "location", F.explode("_firms").alias("_firm")).select(
        "page_id", "location", F.coalesce("_firm.companyName", F.lit("")).alias("company_name"),
        F.coalesce("_firm.companyType", F.lit("")).alias("_type"), F.col("_firm.employeeCount").alias("_staff"),
        F.explode("_firm.jobs").alias("_job"),
    ).where(F.coalesce("_job.title", F.lit("")) != "")
    j = {c: F.col(f"_job.{c}") for c in ("minTotalSalary", "maxTotalSalary", "minBaseSalary", "maxBaseSalary")}
    j = {k: F.nullif(v, F.lit(0.0)) for k, v in j.items()}
    midpoint = F.coalesce((j["minTotalSalary"] + j["maxTotalSalary"]) / 2, (j["minBaseSalary"] + j["maxBaseSalary"]) / 2)

    def dollars(c: Column) -> Column:
        return F.concat(F.lit("$"), F.format_number(c, 0))

    ranges = F.concat(
        F.col("company_name"), F.lit(" ("), F.col("_type"), F.lit(", "),
        F.coalesce(F.nullif("_staff", F.lit(0)).cast("string"), F.lit("?")), F.lit(" employees). Base: "),
        dollars(j["minBaseSalary"]), F.lit("-"), dollars(j["maxBaseSalary"]), F.lit(". Total: "),
        dollars(j["minTotalSalary"]), F.lit("-"), dollars(j["maxTotalSalary"]), F.lit("."))
    title = F.col("_job.title")
    remote = M.remote_type_remote_first(F.coalesce("_job.workArrangement", F.lit("")))
    return rows.select(
        "page_id", title.alias("job_title"), "company_name",
        F.coalesce(F.get("_job.locations", F.lit(0)), F.col("location")).alias("location"),
        S.salary_label(midpoint).alias("salary"),
        F.coalesce("_job.baseSalaryCurrency", F.lit("USD")).alias("salary_currency"),
        E.infer_seniority(title).alias("seniority_level"), F.lit("Full-time").alias("employment_type"),
        remote.alias("remote_type"), F.lit("Technology").alias("industry"), F.lit(1).alias("has_equity"),
        F.lit(1).alias("has_bonus"), M.flag(remote.isin("Remote", "Hybrid")).alias("has_remote_benefits"),
        F.coalesce(ranges, F.concat(F.lit("Levels.fyi listing for "), title, F.lit(" at "), F.col("company_name")))
        .alias("job_description"),
        F.coalesce("_job.applicationUrl", F.lit("")).alias("job_link"), F.coalesce("_job.id", F.lit("")).alias("job_id"),
        X.source_key("levelsfyi", F.col("company_name"), title, F.coalesce("_job.id", F.lit(""))).alias("dedup_key"),
        X.identity_of(F.lit("levelsfyi"), X.strip(F.col("company_name")), X.strip(title), F.coalesce("_job.id", F.lit(""))).alias("identity"),
        F.lit("Levels.fyi").alias("source_website"),
        M.faang_flag(F.col("company_name")).alias("is_faang"),
        E.lookup(F.col("location"), vocab.CITY_COST, vocab.CITY_COST_DEFAULT).alias("cost_of_living_index"),
        F.col("_job.postingDate").alias("date_posted_raw"),
    )


def anchor_jobs(pages: DataFrame) -> DataFrame:
    """One listing per employer link with its average pay; the page median when there is none.

    The first link of an employer wins, found inside the page's own array.
    """
    anchors = F.filter(
        F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1)),
        lambda a: a.rlike(r"(?i)<a\b[^>]*href=[\"'][^\"']*/Salary/[a-f0-9]+/"))
    links = F.transform(anchors, lambda a: F.struct(
        F.regexp_extract(a, r"(?i)href=[\"']([^\"']*)", 1).alias("href"), plain_text(a).alias("text")))
    links = F.filter(links, lambda k: k["text"].rlike(r"Avg\.\s*Salary:\s*\$[\d,]+"))
    links = F.transform(links, lambda k: F.struct(
        X.strip(F.substring_index(k["text"], "Avg.", 1)).alias("company"), k["href"].alias("href"),
        S.number_of(F.regexp_extract(k["text"], r"Avg\.\s*Salary:\s*\$([\d,]+)", 1)).alias("pay")))
    links = F.filter(links, lambda k: (k["company"] != "") & k["pay"].isNotNull())
    chart = K.first(F.col("_nodes"), K.has_class("paycharts__value", "span"))
    median = X.let(plain_text(K.inner_html(F.col("html"), chart)), lambda text: S.salary_usd(text, F.col("usd_rate")))
    # only pages without links need their elements
    bare = F.when(F.size(links) == 0, F.col("html"))
    rows = pages.withColumn("_nodes", K.elements(bare)).withColumn("_links", links).withColumn("_names", F.transform("_links", lambda k: k["company"]))

    def fallback(pay: Column) -> Column:
        one = F.array(F.struct(F.lit(None).cast("string").alias("company"), F.col("url").alias("href"), pay.alias("pay")))
        return F.when(pay.isNotNull(), one)

    first = F.filter("_links", lambda k, i: F.array_position(F.col("_names"), k["company"]) == i + 1)
    rows = rows.select("page_id", "keyword", "location", F.explode(
        F.when(F.size("_links") > 0, first).otherwise(X.let(median, fallback))).alias("_k"))
    company, keyword = F.col("_k.company"), F.col("keyword")
    key = F.when(company.isNotNull(), X.source_key("payscale", company, keyword, X.strip(F.col("location")))).otherwise(
        X.key_of(F.lit("payscale"), keyword, F.col("location")))
    href = F.col("_k.href")
    return rows.select(
        "page_id", X.title_case(keyword).alias("job_title"), company.alias("company_name"), "location",
        S.salary_label(F.col("_k.pay")).alias("salary"), E.infer_seniority(keyword).alias("seniority_level"),
        F.lit("Full-time").alias("employment_type"), F.lit("On-site").alias("remote_type"),
        F.when(company.isNotNull() & href.startswith("/"), F.concat(F.lit("https://www.payscale.com"), href)).otherwise(href)
        .alias("job_link"), key.alias("dedup_key"),
        X.identity_of(F.lit("payscale"), X.strip(company), X.strip(keyword), X.strip(F.col("location"))).alias("identity"),
        F.lit("PayScale").alias("source_website"), M.faang_flag(company).alias("is_faang"),
        E.lookup(F.col("location"), vocab.CITY_COST, vocab.CITY_COST_DEFAULT).alias("cost_of_living_index"),
    )


def page_salary_range(pages: DataFrame) -> DataFrame:
    """First pay range among the page's table values."""
    nodes = K.every(F.col("_nodes"), K.has_class("tablerow__value", "div"))
    cells = F.transform(nodes, lambda n: plain_text(K.inner_html(F.col("html"), n)))
    cell = F.get(F.filter(cells, lambda c: c.rlike(vocab.PAGE_PAY_RANGE)), F.lit(0))
    return pages.withColumn("_nodes", K.elements(F.col("html"))).select("page_id", S.page_pay_range(cell).alias("_r")).select("page_id", "_r.range_min", "_r.range_max")


def card_jobs(pages: DataFrame, source: str = "ZipRecruiter", base: str = "https://www.ziprecruiter.com", currency: str = "USD") -> DataFrame:
    """Listings from result cards, enriched from the card text.

    Cards are those of the first selector that finds any on the page; one that stands inside
    another card of a different class is a part of that.  Relative links start at ``base``.
    """
    html, nodes = F.col("html"), F.col("_nodes")
    kinds = F.filter(F.array(*[K.every(nodes, kind) for kind in CARDS]), lambda found: F.size(found) > 0)

    def content(own: Column, *selectors) -> Column:
        return X.let(K.first(own, *selectors), lambda n: K.inner_html(html, n))

    def parts(card: Column) -> Column:
        return X.let(K.within(nodes, card), lambda own: F.struct(
            K.inner_html(html, card).alias("card"), K.first(own, K.link)["href"].alias("href"),
            *[content(own, *selectors).alias(name) for name, selectors in CARD_PARTS.items()]))

    rows = pages.withColumn("_nodes", K.elements(html)).withColumn("_cards", K.outermost(F.get(kinds, F.lit(0))))
    rows = rows.select("page_id", "location", "usd_rate", F.explode(F.transform("_cards", parts)).alias("_c"))
    rows = rows.select(
        "page_id", F.col("location").alias("_searched"), "usd_rate", plain_text(F.col("_c.card")).alias("_text"), F.col("_c.href").alias("_href"),
        plain_text(F.col("_c.title")).alias("job_title"), plain_text(F.col("_c.company")).alias("company_name"),
        F.coalesce(plain_text(F.col("_c.location")), F.col("location")).alias("location"), plain_text(F.col("_c.snippet")).alias("_snippet"),
    ).where(F.col("job_title").isNotNull())
    description = F.coalesce("_snippet", "_text")
    remote = M.remote_type_remote_first(F.col("_text"))
    own = [X.strip(F.coalesce("company_name", F.lit(""))), X.strip(F.col("job_title")), X.strip(F.col("_searched"))]
    return rows.select(
        "page_id", "job_title", "company_name", "location",
        S.salary_label(S.salary_from_text(F.col("_text"), F.col("usd_rate"))).alias("salary"), F.lit(currency).alias("salary_currency"),
        E.infer_seniority(F.col("job_title")).alias("seniority_level"),
        E.experience(description).alias("experience_required"), F.lit("Full-time").alias("employment_type"),
        remote.alias("remote_type"), F.lit(0).alias("has_equity"), M.flag(F.lower("_text").contains("bonus")).alias("has_bonus"),
        M.flag(remote.isin("Remote", "Hybrid")).alias("has_remote_benefits"),
        X.extract_skills(description).alias("skills_required"),
        description.alias("job_description"),
        F.when(F.col("_href").startswith("http"), F.col("_href")).otherwise(F.concat(F.lit(base), F.col("_href"))).alias("job_link"),
        X.key_of(*own).alias("job_id"), F.lit(source).alias("source_website"), X.key_of(*own).alias("dedup_key"),
        X.identity_of(*own).alias("identity"), F.lit(currency).alias("currency"),
        M.faang_flag(F.col("company_name")).alias("is_faang"),
        E.lookup(F.col("_searched"), vocab.CITY_COST, vocab.CITY_COST_DEFAULT).alias("cost_of_living_index"),
    )


def collect_listings(pages: DataFrame) -> DataFrame:
    """All listings of the pages in the canonical schema, one row per posting; rows that name pay win, then earlier pages."""
    found = [conform(job(pages)) for job in (embedded_jobs, anchor_jobs, card_jobs)]
    return keep_with_salary(with_key(union_sources(*found)), ["page_id", "job_title"])


def store_listings(pages: DataFrame, path: str, run: str) -> bool:
    """Append the listings of these pages that are not stored below ``path`` yet, as one run; False for a run stored before."""
    spark = pages.sparkSession
    fresh = collect_listings(pages)
    stored = read_master(spark, path, among=fresh)
    if stored is not None:
        fresh = insert_if_absent(stored, fresh, fresh.columns, ["page_id"])
    return append_master(fresh, path, run)


def page_salary_scan(pages: DataFrame) -> DataFrame:
    """Pay named on a page: marked elements in order of trust, then spans about money, then the whole text."""
    html, nodes = F.col("html"), F.col("_nodes")
    marked = F.concat(*[K.every(nodes, K.named(c)) for c in PAY_CLASSES])
    spans = F.filter(F.transform(K.every(nodes, K.tag("span")), lambda n: plain_text(K.inner_html(html, n))),
                     lambda t: t.rlike(f"(?i){vocab.PAY_MENTION}"))

    def first_pay(texts: Column) -> Column:
        return F.reduce(texts, F.lit(None).cast("double"),
                        lambda found, t: F.coalesce(found, S.salary_from_text(t, F.col("usd_rate"))))

    amount = F.coalesce(
        first_pay(F.transform(marked, lambda n: plain_text(K.inner_html(html, n)))), first_pay(spans),
        S.salary_from_text(plain_text(html), F.col("usd_rate")))
    return pages.withColumn("_nodes", K.elements(html)).select("page_id", amount.alias("salary_usd")).withColumn("salary", S.salary_label(F.col("salary_usd")))


def detail_enrich(rows: DataFrame) -> DataFrame:
    """Card plus detail page: layered pay, employment type, id from the link, experience fallback."""
    def has_symbol(c: Column) -> Column:
        return X.contains_any(c, vocab.PAY_SYMBOLS)

    def pay(c: Column) -> Column:
        return S.salary_from_text(c, F.col("usd_rate"))

    text = X.clean_text(F.col("description"))
    rows = rows.withColumn("_text", F.when(F.length(text) > 50, text))
    rows = rows.withColumn("_meta", M.simple_metadata(F.col("_text")))
    amount = F.coalesce(
        pay(F.when(has_symbol(F.col("card_salary")), F.col("card_salary"))),
        pay(F.when(has_symbol(F.col("detail_salary")), F.col("detail_salary"))), pay(F.col("_text")))
    level = E.infer_seniority(F.col("job_title"))
    date = X.clean_text(F.col("date_text"))
    remote = F.col("_meta.remote_type")
    return rows.select(
        "id", "job_title", "company_name", "location", S.salary_label(amount).alias("salary"),
        F.coalesce(M.ordered_type(F.col("card_snippet"), vocab.DETAIL_EMPLOYMENT),
                   M.ordered_type(F.col("detail_snippet"), vocab.DETAIL_EMPLOYMENT),
                   F.col("_meta.employment_type")).alias("employment_type"),
        remote.alias("remote_type"), F.col("_meta.education_required").alias("education_required"),
        F.col("_meta.has_equity").alias("has_equity"), F.col("_meta.has_bonus").alias("has_bonus"),
        M.flag(remote.isin("Remote", "Hybrid")).alias("has_remote_benefits"),
        X.extract_skills(F.col("_text")).alias("skills_required"), level.alias("seniority_level"),
        F.coalesce(E.experience(F.col("_text")), E.seniority_experience(level)).alias("experience_required"),
        F.col("_text").alias("job_description"),
        X.blank_to_null(F.regexp_extract("job_link", "jk=([a-f0-9]+)", 1)).alias("job_id"),
        F.when(X.contains_any(F.lower(date), vocab.DATE_WORDS), date).alias("date_posted_raw"),
        X.key_of(X.strip(F.col("company_name")), X.strip(F.col("job_title")), X.strip(F.col("location"))).alias("dedup_key"),
        X.identity_of(X.strip(F.col("company_name")), X.strip(F.col("job_title")), X.strip(F.col("location"))).alias("identity"),
    )
