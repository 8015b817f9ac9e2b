"""Feature table: nine numbers, flags, skills, target means, cities, sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import experience as E
from ..functions import metadata as M
from ..functions import text as X
from ..session import scratch_path
from .ranks import linear_percentiles, one_row

PAY = "salary_usd_numeric"
NUMERIC = ["experience_midpoint", "seniority_score", "description_word_count", "skill_count", "title_word_count",
           "col_index", "city_tier", "exp_seniority_interaction", "company_rating"]
ENCODED = {"city": "city_target_encoded", "job_title": "title_target_encoded", "role": "role_target_encoded"}
PERCENTS = [10, 25, 50, 75, 90]


def col_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def city_tier(city: Column, country: Column) -> Column:
    low = F.lower(F.coalesce(city, F.lit("")))
    return (
        F.when(low.rlike("|".join(vocab.TIER4_CITIES)), 4)
        .when(low.rlike("|".join(vocab.TIER3_CITIES)), 3)
        .when(country.isin(*vocab.TIER2_COUNTRIES), 2)
        .otherwise(1)
    )


def with_years(df: DataFrame) -> DataFrame:
    """Years of experience in a step of their own, because two features use them."""
    return df.withColumn("_years", E.experience_midpoint(F.col("experience_required"), F.col("job_description")))


def numeric_columns(df: DataFrame, rating_default: float = vocab.RATING_DEFAULT) -> dict[str, Column]:
    """Expects the column of ``with_years``."""
    years = F.col("_years")
    score = E.seniority_score(F.col("seniority_level"))
    skills = F.col("skills_required")
    return {
        "experience_midpoint": F.coalesce(years, F.lit(0.0)),
        "seniority_score": score,
        "description_word_count": X.word_count(F.col("job_description")),
        "skill_count": F.when(F.coalesce(skills, F.lit("")) == "", 0).otherwise(F.size(F.split(skills, ","))),
        "title_word_count": X.word_count(F.col("job_title")),
        "col_index": E.lookup(F.col("city"), vocab.CITY_COST, vocab.CITY_COST_DEFAULT),
        "city_tier": city_tier(F.col("city"), col_or_null(df, "country")),
        "exp_seniority_interaction": F.coalesce(years * score, F.lit(0.0)),
        "company_rating": F.coalesce(col_or_null(df, "company_rating", "double"), F.lit(float(rating_default))),
    }


def stored_flag(c: Column) -> Column:
    """Flags arrive as numbers, booleans or the words True and False."""
    t = F.lower(c.cast("string"))
    return F.when(t == "true", 1).when(t == "false", 0).otherwise(F.coalesce(t.try_cast("double").cast("int"), F.lit(0)))


def binary_columns(df: DataFrame) -> dict[str, Column]:
    out = {name: stored_flag(col_or_null(df, name)) for name in vocab.STORED_FLAGS}
    for name, (column, pattern) in vocab.FLAG_PATTERNS.items():
        out[name] = M.flag(F.lower(col_or_null(df, column)).rlike(f"(?U){pattern}"))
    skills = F.lower(F.col("skills_required"))
    for name, words in vocab.SKILL_CLUSTERS.items():
        out[name] = M.flag(X.contains_any(skills, words))
    return out


def skill_column(skill: str) -> str:
    return "skill_" + skill.lower().replace(" ", "_").replace("/", "_")


def skill_columns(df: DataFrame) -> dict[str, Column]:
    """Substring test on the skills text, so "r" also fires inside "docker"."""
    low = F.lower(col_or_null(df, "skills_required"))
    return {skill_column(s): M.flag(low.contains(s.lower())) for s in vocab.SKILLS}


def city_column(city: str) -> str:
    return "city_" + city.lower().replace(" ", "_").replace(",", "").replace(".", "")


def city_columns(df: DataFrame, cities: list[str]) -> dict[str, Column]:
    """Cities whose normalised names meet share one column."""
    slug = F.concat(F.lit("city_"), F.replace(F.replace(F.replace(
        F.lower(F.col("city")), F.lit(" "), F.lit("_")), F.lit(","), F.lit("")), F.lit("."), F.lit("")))
    return {name: M.flag(slug == name) for name in dict.fromkeys(city_column(c) for c in cities)}


def source_columns(df: DataFrame) -> dict[str, Column]:
    low = F.lower(col_or_null(df, "source_website"))
    return {f"source_{s}": M.flag(low.contains(s)) for s in vocab.SOURCE_FLAGS}


# --- encoders -----------------------------------------------------------------

def top_cities(df: DataFrame, n: int = vocab.TOP_CITY_COUNT) -> DataFrame:
    known = df.where(F.col("city").isNotNull())
    return known.groupBy("city").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "city").limit(n)


def salary_percentiles(df: DataFrame) -> DataFrame:
    return linear_percentiles(df, [], PAY, PERCENTS)


def rating_mean(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg("company_rating"), F.lit(vocab.RATING_DEFAULT)).alias("rating_mean"))


@dataclass
class Encoders:
    """Fitted state.  Scalars and the city list are small by definition; the
    target means grow with the data and stay distributed."""

    scalars: dict[str, float]
    cities: list[str]
    means: dict[str, DataFrame]
    mean_of_means: dict[str, float] = field(default_factory=dict)

    @property
    def feature_columns(self) -> list[str]:
        return [*NUMERIC, *FLAGS, *[skill_column(s) for s in vocab.SKILLS], *ENCODED.values(),
                *dict.fromkeys(city_column(c) for c in self.cities), *[f"source_{s}" for s in vocab.SOURCE_FLAGS]]

    def save(self, spark: SparkSession, path: str) -> None:
        for column, table in self.means.items():
            table.write.mode("overwrite").parquet(f"{path}/means_{column}")
        spark.createDataFrame([(k, float(v)) for k, v in self.scalars.items() if v is not None],
                              "name string, value double").write.mode("overwrite").parquet(f"{path}/scalars")
        spark.createDataFrame(list(enumerate(self.cities)), "position int, city string").write.mode("overwrite").parquet(
            f"{path}/cities")
        spark.createDataFrame([(k, v) for k, v in self.mean_of_means.items() if v is not None],
                              "name string, value double").write.mode("overwrite").parquet(f"{path}/mean_of_means")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Encoders":
        def small(name: str) -> dict:
            return {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/{name}").collect()}

        cities = [r["city"] for r in spark.read.parquet(f"{path}/cities").orderBy("position").collect()]
        means = {c: spark.read.parquet(f"{path}/means_{c}") for c in ENCODED}
        return cls(small("scalars"), cities, means, small("mean_of_means"))


FLAGS = ["is_remote", "is_hybrid", "is_faang", "has_equity", "has_bonus", "is_contract", "is_internship",
         "is_full_time", "requires_phd", "requires_masters", "requires_bachelors", "is_senior_title", "is_ml_role",
         "is_ds_role", "is_sde_role", "is_staff_principal", "is_manager_vp", "is_cloud_expert", "is_ai_expert",
         "is_backend_expert", "is_web_expert"]


def with_role(df: DataFrame) -> DataFrame:
    return df if "role" in df.columns else df.withColumn("role", F.lit(None).cast("string"))


def learn_means(df: DataFrame) -> DataFrame:
    """Mean pay and row count per city, title and role and over all rows, from one scan.

    ``encoder`` names the column, null stands for the row over everything.
    """
    names = list(ENCODED)
    sets = df.groupingSets([[F.col(c)] for c in names] + [[]], *[F.col(c) for c in names])
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in names:
        used = F.col(f"_g_{c}") == 0
        which, value = F.when(used, c).otherwise(which), F.when(used, F.col(c)).otherwise(value)
    return sets.agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in names], F.count(F.lit(1)).alias("n"), F.avg(PAY).alias("target_mean"),
        F.avg(col_or_null(df, "company_rating", "double")).alias("rating"),
    ).select(which.alias("encoder"), value.alias("value"), "n", "target_mean", "rating")


def fit(df: DataFrame) -> Encoders:
    """Learn encoder state.

    The learned means are written to the scratch folder: every later step reads
    them instead of going back to the postings.  Two small results reach the
    driver: one row of scalars and at most 100 city names.
    """
    df = with_role(df)
    spark = df.sparkSession
    path = scratch_path(spark, "encoder-means")
    learn_means(df).write.partitionBy("encoder").parquet(path)
    learned = spark.read.schema("value string, n bigint, target_mean double, rating double, encoder string").parquet(path)
    known = learned.where(F.col("value").isNotNull())
    overall = learned.where(F.col("encoder").isNull())
    row = one_row(
        salary_percentiles(df),
        overall.select(F.col("target_mean").alias("global_mean"),
                       F.coalesce("rating", F.lit(vocab.RATING_DEFAULT)).alias("rating_mean")),
        known.groupBy().agg(*[F.avg(F.when(F.col("encoder") == c, F.col("target_mean"))).alias(f"mean_{c}") for c in ENCODED]),
    ).first()
    cities = known.where("encoder = 'city'").orderBy(F.desc("n"), "value").limit(vocab.TOP_CITY_COUNT)
    means = {c: known.where((F.col("encoder") == c) & F.col("target_mean").isNotNull())
             .select(F.col("value").alias(c), "target_mean") for c in ENCODED}
    scalars = {k: row[k] for k in ["rating_mean", "global_mean", *[f"p{p}" for p in PERCENTS]]}
    return Encoders(scalars, [r["value"] for r in cities.collect()], means, {c: row[f"mean_{c}"] for c in ENCODED})


def target_encode(df: DataFrame, encoders: Encoders, fitting: bool = False) -> DataFrame:
    """Mean pay of the row's city, title and role.

    Unseen values take the overall mean while fitting and the mean of the stored
    means afterwards.  No broadcast hint: the tables grow with the data.
    """
    for column, name in ENCODED.items():
        default = encoders.scalars.get("global_mean") if fitting else encoders.mean_of_means.get(column)
        table = encoders.means[column].select(F.col(column).alias("_encoded"), F.col("target_mean").alias(name))
        # a missing value matches nothing; keys of their own keep such rows from meeting in one task
        alone = F.concat(F.lit("\x00"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
        df = df.withColumn("_encoded", F.coalesce(F.col(column), alone)).join(table, "_encoded", "left").drop("_encoded").withColumn(name, F.coalesce(F.col(name), F.lit(float(default or 0.0))))
    return df


def transform(df: DataFrame, encoders: Encoders, keep: list[str] | None = None, fitting: bool = False) -> DataFrame:
    """Feature columns in the frozen order, preceded by the columns in ``keep``."""
    df = with_years(with_role(df))
    exprs = {
        **numeric_columns(df, encoders.scalars.get("rating_mean") or vocab.RATING_DEFAULT), **binary_columns(df),
        **skill_columns(df), **city_columns(df, encoders.cities), **source_columns(df),
    }
    # the means join rows that are narrow already, without descriptions
    plain = [c for c in encoders.feature_columns if c in exprs]
    narrow = df.select(*(keep or []), *[c for c in ENCODED if c not in (keep or [])], *[exprs[c].alias(c) for c in plain])
    encoded = target_encode(narrow, encoders, fitting)
    return encoded.select(*(keep or []), *[F.col(f"`{c}`") for c in encoders.feature_columns])


def fit_transform(df: DataFrame, keep: list[str] | None = None, split: Column | None = None) -> tuple[Encoders, DataFrame]:
    """Fit on all rows, or on the rows of ``split`` only so that test rows do not leak into the means."""
    encoders = fit(df if split is None else df.where(split))
    return encoders, transform(df, encoders, keep, fitting=True)


def request_rows(requests: DataFrame) -> DataFrame:
    """Scoring requests in the shape of listings."""
    company = F.coalesce(col_or_null(requests, "company_name"), F.lit(""))
    skills = F.col("skills")
    remote = F.coalesce(col_or_null(requests, "remote_type"), F.lit("On-site"))
    return requests.select(
        "request_id", F.coalesce("job_title", F.lit("")).alias("job_title"),
        F.coalesce(col_or_null(requests, "role"), F.col("job_title")).alias("role"), company.alias("company_name"),
        "city", F.col("city").alias("location"), F.lit("USD").alias("salary_currency"),
        F.lit(None).cast("double").alias(PAY),
        F.coalesce(X.blank_to_null(F.col("seniority_level")), E.infer_seniority(F.col("job_title"))).alias("seniority_level"),
        F.concat(F.col("experience_years").cast("int").cast("string"), F.lit("+ years")).alias("experience_required"),
        F.coalesce(col_or_null(requests, "employment_type"), F.lit("Full-time")).alias("employment_type"),
        remote.alias("remote_type"),
        F.coalesce(col_or_null(requests, "education_required"), F.lit("")).alias("education_required"),
        stored_flag(col_or_null(requests, "has_equity")).alias("has_equity"),
        stored_flag(col_or_null(requests, "has_bonus")).alias("has_bonus"),
        M.flag(remote.isin("Remote", "Hybrid")).alias("has_remote_benefits"),
        F.when(F.size(skills) > 0, F.array_join(skills, ", ")).alias("skills_required"),
        F.lit("").alias("job_description"), F.lit("LinkedIn").alias("source_website"),
        M.faang_flag(company).alias("is_faang"),
        E.lookup(F.col("city"), vocab.CITY_COST, vocab.CITY_COST_DEFAULT).alias("cost_of_living_index"),
    )
